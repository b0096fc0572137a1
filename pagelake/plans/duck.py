"""DuckDB SQL fragments for the oracle queries.

These re-state the semantics in DuckDB's dialect (RE2 regexes, list
lambdas, alias reuse inside one SELECT) so every oracle is an independent
implementation, not a translation of the Spark plan.
"""

from __future__ import annotations

# Values of the semantics, stated here on their own; "&amp;" is decoded last.
ENTITIES = (("&nbsp;", "\u00a0"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&#x27;", "'"), ("&amp;", "&"))
TRACKING_KEYS = ("FE_SESSION", "fe_typo_user", "PHPSESSID", "utm_source", "utm_medium", "utm_campaign")
URI = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"
WS = r"[ \t\n\r\f\x{0B}\x{A0}]"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def strlist(xs) -> str:
    return "[" + ", ".join(q(x) for x in xs) + "]"


def part(expr: str, i: int) -> str:
    return f"regexp_extract({expr}, {q(URI)}, {i})"


def decode(expr: str) -> str:
    for ent, ch in ENTITIES:
        expr = f"replace({expr}, {q(ent)}, {q(ch)})"
    return expr


def trim_ws(expr: str) -> str:
    return f"regexp_replace({expr}, {q('^' + WS + '+|' + WS + '+$')}, '', 'g')"


def text(expr: str, sep: str = "") -> str:
    """Visible text: comments/scripts/styles dropped, tags split, nodes
    decoded + trimmed, empties dropped, joined."""
    e = f"regexp_replace({expr}, '(?s)<!--.*?-->', '', 'g')"
    e = f"regexp_replace({e}, {q(r'(?is)<script\b[^>]*>.*?</script\s*>')}, '', 'g')"
    e = f"regexp_replace({e}, {q(r'(?is)<style\b[^>]*>.*?</style\s*>')}, '', 'g')"
    e = f"string_split(regexp_replace({e}, '<[^>]*>', chr(1), 'g'), chr(1))"
    e = f"list_filter(list_transform({e}, lambda t: {trim_ws(decode('t'))}), lambda t: t <> '')"
    return f"array_to_string({e}, {q(sep)})"


def inner(expr: str, start: str, end: str) -> str:
    return f"regexp_extract({expr}, {q('(?is)' + start + '(.*?)' + end)}, 1)"


def form_dec(e: str) -> str:
    return f"url_decode(replace({e}, '+', ' '))"


def form_enc(e: str) -> str:
    return f"replace(url_encode({e}), '%20', '+')"


def canon_cols(raw: str, p: str, strip=TRACKING_KEYS) -> list[str]:
    """Select items computing ``{p}`` = canonical form of absolute URL ``raw``."""
    k_dec = form_dec("split_part(x, '=', 1)")
    v_dec = form_dec("substr(x, strpos(x, '=') + 1)")
    return [
        f"lower({part(raw, 1)}) AS {p}_s",
        f"lower({part(raw, 3)}) AS {p}_a0",
        f"CASE WHEN {p}_s = 'http' THEN regexp_replace({p}_a0, ':80$', '') "
        f"WHEN {p}_s = 'https' THEN regexp_replace({p}_a0, ':443$', '') ELSE {p}_a0 END AS {p}_a",
        f"CASE WHEN {part(raw, 4)} = '' THEN '/' ELSE {part(raw, 4)} END AS {p}_p",
        f"list_sort(list_filter(list_transform(list_filter(string_split({part(raw, 6)}, '&'), lambda x: x <> ''), "
        f"lambda x: {{'k': {k_dec}, "
        f"'v': CASE WHEN strpos(x, '=') > 0 THEN {v_dec} ELSE '' END}}), "
        f"lambda y: NOT list_contains({strlist(strip)}, y.k))) AS {p}_pairs",
        f"array_to_string(list_transform({p}_pairs, lambda y: {form_enc('y.k')} || '=' || {form_enc('y.v')}), '&') AS {p}_q",
        f"{p}_s || '://' || {p}_a || {p}_p || CASE WHEN {p}_q <> '' THEN '?' || {p}_q ELSE '' END AS {p}",
    ]


def resolve_cols(ref: str, base: str, p: str) -> list[str]:
    """``{p}`` = absolute form of ``ref`` against absolute ``base`` (forms in
    the data: absolute URL, network-path, absolute-path, query-only, relative
    path)."""
    return [
        f"trim({ref}) AS {p}_r",
        f"CASE WHEN regexp_matches({p}_r, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {p}_r "
        f"WHEN starts_with({p}_r, '//') THEN lower({part(base, 1)}) || ':' || {p}_r "
        f"WHEN starts_with({p}_r, '/') THEN lower({part(base, 1)}) || '://' || {part(base, 3)} || {p}_r "
        f"WHEN {p}_r = '' OR starts_with({p}_r, '#') THEN {base} "
        f"WHEN starts_with({p}_r, '?') THEN lower({part(base, 1)}) || '://' || {part(base, 3)} || {part(base, 4)} || {p}_r "
        f"ELSE lower({part(base, 1)}) || '://' || {part(base, 3)} || regexp_replace({part(base, 4)}, '[^/]*$', '') || {p}_r "
        f"END AS {p}",
    ]


def page_path(u: str, p: str) -> list[str]:
    """``{p}`` = bundle path of canonical URL ``u``."""
    return [
        f"regexp_replace({part(u, 4)}, '^/+', '') AS {p}_0",
        f"CASE WHEN {p}_0 = '' OR ends_with({p}_0, '/') THEN regexp_replace({p}_0 || 'index', '^/+', '') ELSE {p}_0 END AS {p}_1",
        f"CASE WHEN strpos({p}_1, '.') = 0 OR lower(split_part({p}_1, '.', -1)) NOT IN ('html', 'htm') "
        f"THEN {p}_1 || '.html' ELSE {p}_1 END AS {p}_2",
        f"CASE WHEN {part(u, 6)} <> '' THEN regexp_replace({p}_2, '\\.html$', '') || '~' || left(sha1({u}), 10) || '.html' "
        f"ELSE {p}_2 END AS {p}_3",
        f"regexp_replace(regexp_replace(replace({p}_3, '\\', '/'), '^/+', ''), '/{{2,}}', '/', 'g') AS {p}",
    ]


def sel(*groups) -> str:
    items = []
    for g in groups:
        items.extend([g] if isinstance(g, str) else g)
    return ",\n  ".join(items)

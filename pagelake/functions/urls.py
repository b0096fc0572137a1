"""URL expressions: split, resolve, canonicalise, key, map to bundle paths.

All functions take and return ``Column`` objects built from built-in Spark SQL
functions.  Steps that use a value more than once bind it with ``let``, a
higher-order function: that part is interpreted, but the plan stays linear.
"""

from __future__ import annotations

import mimetypes

from pyspark.sql import Column
from pyspark.sql import functions as F

# RFC 3986 appendix B split; groups: 1 scheme, 2 "//" marker, 3 authority,
# 4 path, 5 "?" marker, 6 query.  The fragment is matched and ignored.
URI_RE = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#.*)?$"


# Schemes whose URLs carry an authority part.
NETLOC_SCHEMES = ("", "ftp", "http", "gopher", "nntp", "telnet", "imap", "wais", "file", "mms",
                  "https", "shttp", "snews", "prospero", "rtsp", "rtsps", "rtspu", "rsync",
                  "svn", "svn+ssh", "sftp", "nfs", "git", "git+ssh", "ws", "wss", "itms-services")


def _g(c: Column, i: int) -> Column:
    return F.regexp_extract(c, URI_RE, i)


def scheme(c: Column) -> Column:
    return _g(c, 1)


def authority(c: Column) -> Column:
    return _g(c, 3)


def path(c: Column) -> Column:
    return _g(c, 4)


def query(c: Column) -> Column:
    return _g(c, 6)


def has_authority(c: Column) -> Column:
    return _g(c, 2) != F.lit("")


def host(c: Column) -> Column:
    """Lower-cased host without user info and port."""
    a = F.lower(authority(c))
    return F.regexp_extract(a, r"^(?:[^@]*@)?(\[[^\]]*\]|[^:]*)", 1)


def let(value: Column, fn) -> Column:
    """Bind ``value`` once and evaluate ``fn`` on it (keeps expression trees
    small: the bound value is computed once instead of being inlined into
    every use)."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def parts(c: Column) -> Column:
    """Struct of URL parts: s (scheme), has_a, a (authority), p (path),
    has_q, q (query).  One pass of the pattern: its groups are joined by a
    control character, which no URL holds, and split again."""
    cut = F.split(F.regexp_replace(F.translate(c, "\x01", ""), URI_RE, "$1\x01$2\x01$3\x01$4\x01$5\x01$6"), "\x01")
    return let(cut, lambda g: F.struct(
        F.get(g, F.lit(0)).alias("s"), (F.get(g, F.lit(1)) != "").alias("has_a"), F.get(g, F.lit(2)).alias("a"),
        F.get(g, F.lit(3)).alias("p"), (F.get(g, F.lit(4)) != "").alias("has_q"), F.get(g, F.lit(5)).alias("q")))


def _merge_path(base_path: Column, ref_path: Column) -> Column:
    """Merge a relative path onto the base directory and fold dot segments.

    Empty middle segments are dropped, ``..`` pops (never below empty),
    a trailing ``.``/``..`` keeps a final slash.
    """
    def merge(segs):
        n = F.size(segs)
        kept = F.filter(segs, lambda x, i: (i == 0) | (i == n - 1) | (x != F.lit("")))
        folded = F.aggregate(
            kept,
            F.array().cast("array<string>"),
            lambda acc, x: F.when(x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
            .when(x == ".", acc)
            .otherwise(F.concat(acc, F.array(x))),
        )
        last = F.element_at(kept, -1)
        folded = F.when(last.isin(".", ".."), F.concat(folded, F.array(F.lit("")))).otherwise(folded)
        joined = F.array_join(folded, "/")
        joined = F.when(joined == "", F.lit("/")).otherwise(joined)
        return F.when(joined.startswith("/"), joined).otherwise(F.concat(F.lit("/"), joined))

    def with_dir(bsegs):
        bdir = F.when(F.element_at(bsegs, -1) != F.lit(""),
                      F.slice(bsegs, 1, F.greatest(F.size(bsegs) - 1, F.lit(0)))).otherwise(bsegs)
        return F.when(ref_path.startswith("/"), F.split(ref_path, "/")).otherwise(
            F.concat(bdir, F.split(ref_path, "/")))

    return let(let(F.split(base_path, "/"), with_dir), merge)


def resolve(ref: Column, base: Column) -> Column:
    """Resolve a reference against a base URL (RFC 3986 / urljoin rules).

    The fragment of the result is dropped (the canonical form never keeps it).
    """
    def go(x):
        r, b, raw = x["r"], x["b"], x["raw"]
        no_frag = F.regexp_replace(raw, "#.*$", "")
        sch = F.when(r["s"] != "", F.lower(r["s"])).otherwise(F.lower(b["s"]))
        same_scheme = (r["s"] == "") | (F.lower(r["s"]) == F.lower(b["s"]))

        def build(a, p, q, has_q):
            return F.concat(sch, F.lit("://"), a, p,
                            F.when(has_q & (q != ""), F.concat(F.lit("?"), q)).otherwise(F.lit("")))

        return (
            F.when(x["base"].isNull() | (x["base"] == ""), no_frag)
            .when(~same_scheme, no_frag)
            .when(r["has_a"], F.concat(sch, F.lit(":"), F.regexp_replace(
                F.regexp_replace(no_frag, r"^[A-Za-z][A-Za-z0-9+.\-]*:", ""), "#.*$", "")))
            .when(r["p"] == "", build(b["a"], b["p"], F.when(r["has_q"], r["q"]).otherwise(b["q"]),
                                      r["has_q"] | b["has_q"]))
            .otherwise(build(b["a"], _merge_path(b["p"], r["p"]), r["q"], r["has_q"]))
        )

    t = F.trim(ref)
    return let(F.struct(t.alias("raw"), base.alias("base"), parts(t).alias("r"),
                        parts(F.coalesce(base, F.lit(""))).alias("b")), go)


def form_encode(c: Column) -> Column:
    """application/x-www-form-urlencoded encoding (space as '+', '~' kept)."""
    return F.replace(F.replace(F.url_encode(c), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def lone_percent(c: Column) -> Column:
    """A '%' that starts no escape, made an escape of itself."""
    return F.regexp_replace(c, "%(?![0-9A-Fa-f]{2})", "%25")


def form_decode(c: Column) -> Column:
    """Decode a form-encoded component; a malformed escape stays as it is, the
    others are decoded."""
    return F.coalesce(F.try_url_decode(lone_percent(c)), F.replace(c, F.lit("+"), F.lit(" ")))


def without_params(p: Column) -> Column:
    """A path without the parameters (';...') of its last segment."""
    return F.regexp_replace(p, ";[^/]*$", "")


def canonical_query(q: Column, strip_keys: tuple[str, ...]) -> Column:
    """Parse pairs (blank values kept), drop stripped keys, sort by (key, value),
    re-encode.  Returns '' for no remaining pairs."""
    pieces = F.filter(F.split(q, "&"), lambda x: x != "")
    pairs = F.transform(pieces, lambda x: F.struct(
        form_decode(F.substring_index(x, "=", 1)).alias("k"),
        F.when(F.instr(x, "=") > 0, form_decode(F.substring(x, F.instr(x, "=") + 1, 1 << 30)))
        .otherwise(F.lit("")).alias("v"),
    ))
    if strip_keys:
        keys = F.array(*[F.lit(k) for k in strip_keys])
        pairs = F.filter(pairs, lambda p: ~F.array_contains(keys, p["k"]))
    pairs = F.array_sort(pairs)
    enc = F.transform(pairs, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])))
    return F.array_join(enc, "&")


def _canonical_abs(u: Column, strip_keys: tuple[str, ...]) -> Column:
    def build(pt):
        sch = F.lower(pt["s"])
        a = F.lower(pt["a"])
        a = F.when((sch == "http") & a.endswith(":80"), F.regexp_replace(a, ":80$", "")).when(
            (sch == "https") & a.endswith(":443"), F.regexp_replace(a, ":443$", "")).otherwise(a)
        p = F.when(pt["p"] == "", F.lit("/")).otherwise(pt["p"])
        q = canonical_query(pt["q"], strip_keys)
        slashes = pt["has_a"] | (a != "") | (sch.isin(*NETLOC_SCHEMES) & p.startswith("/"))
        head = F.concat(F.when(sch != "", F.concat(sch, F.lit(":"))).otherwise(F.lit("")),
                        F.when(slashes, F.concat(F.lit("//"), a)).otherwise(F.lit("")))
        return F.concat(head, p, F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))

    return let(parts(u), build)


def canonical(url: Column, strip_keys: tuple[str, ...] = (), base: Column | None = None) -> Column:
    """P-1: one canonical form per logical page.

    Resolve against ``base`` when given, drop the fragment, lower-case scheme
    and authority, drop the default port, strip listed query keys, sort the
    remaining pairs, re-encode them and turn an empty path into '/'.
    """
    u = resolve(url, base) if base is not None else F.regexp_replace(F.trim(url), "#.*$", "")
    return let(u, lambda v: _canonical_abs(v, strip_keys))


def url_key(c: Column) -> Column:
    """P-3: storage key = sha1 hex of the canonical URL."""
    return F.sha1(F.encode(c, "UTF-8"))


def same_site(url: Column, base: Column) -> Column:
    """FLT-2: lower-cased authority (port included) equal."""
    return F.lower(authority(url)) == F.lower(authority(base))


def scope_target(url: Column) -> Column:
    """P-5: URL-decoded ``path[?query]`` without parameters; '+' stays '+'."""
    return let(url, _scope_target)


def _scope_target(url: Column) -> Column:
    q = query(url)
    raw = F.concat(without_params(path(url)), F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")))
    return F.coalesce(F.try_url_decode(F.replace(lone_percent(raw), F.lit("+"), F.lit("%2B"))), raw)


def _entry_path(url: Column) -> Column:
    """Where a URL's path points inside the bundle: forward slashes, single ones,
    none in front; '' or a final slash stands for a directory."""
    p = F.replace(without_params(path(url)), F.lit("\\"), F.lit("/"))
    return F.regexp_replace(F.regexp_replace(p, "/{2,}", "/"), "^/", "")


def _variant(url: Column) -> Column:
    """Suffix that tells a URL with a query from the one without."""
    return F.when(query(url) != "", F.concat(F.lit("~"), F.substring(url_key(url), 1, 10))).otherwise(F.lit(""))


def page_path(url: Column) -> Column:
    """P-6: bundle path of a canonical page URL."""
    return let(url, _page_path)


def _page_path(url: Column) -> Column:
    def build(p):
        stem = F.regexp_replace(p, r"(?<=^|/)$", "index")
        is_htm = F.lower(stem).rlike(r"\.html?$")
        # a query variant goes before ".html"; other suffixes stay part of the name
        base = F.when(is_htm & ((query(url) == "") | stem.endswith(".html")), F.regexp_replace(stem, r"\.[^.]*$", "")).otherwise(stem)
        ext = F.when(is_htm & (query(url) == ""), F.regexp_extract(stem, r"(\.[^.]*)$", 1)).otherwise(F.lit(".html"))
        return F.concat(base, _variant(url), ext)

    return let(_entry_path(url), build)


def asset_path(url: Column, ext: Column) -> Column:
    """P-7: bundle path of a canonical asset URL with its extension."""
    return let(F.struct(url.alias("u"), ext.alias("e")), lambda x: _asset_path(x["u"], x["e"]))


def _asset_path(url: Column, ext: Column) -> Column:
    return let(_entry_path(url), lambda p: (
        F.when((p == "") | p.endswith("/"), F.concat(F.lit("assets/"), url_key(url), ext))
        .when(query(url) != "", F.concat(F.regexp_replace(p, r"\.[^./]+$", ""), _variant(url), ext))
        .otherwise(p)))


def _mime_ext() -> dict[str, str]:
    """Content type -> extension: the standard library's own table (no system
    files), and common types that it lacks."""
    known = mimetypes.MimeTypes(filenames=())
    table = {t: known.guess_extension(t) for t in sorted(set(known.types_map[1].values()))}
    return {**table, "application/javascript": ".js", "image/x-icon": ".ico", "font/woff": ".woff", "font/woff2": ".woff2"}


MIME_EXT = _mime_ext()


def guess_ext(url: Column, content_type: Column) -> Column:
    """P-8: URL suffix of 1-5 alphanumerics, else by content type, else .bin."""
    suffix = F.regexp_extract(path(url), r"\.([A-Za-z0-9]{1,5})$", 1)
    ct = F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))
    mime = F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in MIME_EXT.items())), F.lit("\x02"), F.lit("\x03"))
    return F.when(suffix != "", F.concat(F.lit("."), F.lower(suffix))).otherwise(
        F.coalesce(F.try_element_at(mime, ct), F.lit(".bin")))


def title_from_url(url: Column) -> Column:
    """P-9: last non-empty segment, runs of -/_ to one space, title case."""
    return let(url, _title_from_url)


def _title_from_url(url: Column) -> Column:
    seg = F.try_element_at(F.filter(F.split(url, "/"), lambda s: s != ""), F.lit(-1))
    return let(F.initcap(F.trim(F.regexp_replace(seg, "[-_]+", " "))),
               lambda t: F.when(t.isNull() | (t == ""), url).otherwise(t))


def up_prefix(bundle_path: Column) -> Column:
    """P-19: '../' once per '/' in the current bundle path."""
    depth = F.length(bundle_path) - F.length(F.replace(bundle_path, F.lit("/"), F.lit("")))
    return F.repeat(F.lit("../"), depth)

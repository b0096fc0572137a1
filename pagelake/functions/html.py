"""HTML-to-text expressions for flat markup (no DOM).

Text of an element = its text nodes, each decoded and trimmed, empty ones
dropped, joined with a separator.  Comments, scripts and styles carry no text.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from .urls import let

# Whitespace trimmed from text nodes (ASCII whitespace, VT and no-break space).
WS = r"[ \t\n\r\f\x{0B}\x{A0}]"
NODE_BREAK = "\u0001"

# A character reference after its '&': decimal, hexadecimal or named, up to ';'.
REFERENCE = r"^(#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});"
# Names of the references: the standard library's table and "apos".
NAMED = {**{n: chr(c) for n, c in name2codepoint.items()}, "apos": "'"}


def code_point(c: Column) -> Column:
    """The character of an integer code point; U+FFFD where there is none."""
    valid = ((c > 0) & (c < 0xD800)) | ((c > 0xDFFF) & (c <= 0x10FFFF))
    safe = F.when(valid, c).otherwise(F.lit(0xFFFD))
    return F.decode(F.unhex(F.lpad(F.hex(safe), 8, "0")), "UTF-32")


def _reference(name: Column) -> Column:
    """Text of one reference (without '&' and ';'), null when unknown."""
    # one literal instead of some hundred: plans hold this many times
    table = F.str_to_map(F.lit("\x02".join(f"{k}\x03{v}" for k, v in NAMED.items())), F.lit("\x02"), F.lit("\x03"))
    num = F.when(F.lower(F.substring(name, 2, 1)) == "x", F.conv(F.substring(name, 3, 6), 16, 10)).otherwise(
        F.substring(name, 2, 7))
    return F.when(name.startswith("#"), code_point(num.try_cast("int"))).otherwise(F.try_element_at(table, name))


def decode_entities(c: Column) -> Column:
    """Decode every character reference once ("&amp;lt;" gives "&lt;").

    The text is split at '&'; texts without one are returned as they are.
    """
    def one(x, i):
        name = F.regexp_extract(x, REFERENCE, 1)
        char = F.when((i > 0) & (name != ""), _reference(name))
        return F.when(i == 0, x).when(char.isNull(), F.concat(F.lit("&"), x)).otherwise(
            F.concat(char, F.substring(x, F.length(name) + 2, 1 << 30)))

    return F.when(F.contains(c, F.lit("&")), F.array_join(F.transform(F.split(c, "&"), one), "")).otherwise(c)


def trim_ws(c: Column) -> Column:
    return F.regexp_replace(c, f"^{WS}+|{WS}+$", "")


def drop_comments(c: Column) -> Column:
    return F.regexp_replace(c, r"(?s)<!--.*?-->", "")


def drop_invisible(c: Column) -> Column:
    """Remove comments, scripts and styles (they have no visible text)."""
    c = drop_comments(c)
    c = F.regexp_replace(c, r"(?is)<script\b[^>]*>.*?</script\s*>", "")
    return F.regexp_replace(c, r"(?is)<style\b[^>]*>.*?</style\s*>", "")


def text_nodes(fragment: Column) -> Column:
    """Array of decoded, trimmed, non-empty text nodes of a fragment."""
    parts = F.split(F.regexp_replace(drop_invisible(fragment), r"<[^>]*>", NODE_BREAK), NODE_BREAK)
    parts = F.transform(parts, lambda x: trim_ws(decode_entities(x)))
    return F.filter(parts, lambda x: x != "")


def text(fragment: Column, sep: str = "") -> Column:
    """P-16: visible text of a fragment joined with ``sep`` (null stays null)."""
    return F.array_join(text_nodes(fragment), sep)


def inner(html: Column, start_tag: str, end_tag: str) -> Column:
    """Inner markup of the first element opened by ``start_tag`` and closed
    by the first following ``end_tag`` (flat elements)."""
    return F.regexp_extract(html, f"(?is){start_tag}(.*?){end_tag}", 1)


def has_element(html: Column, start_tag: str) -> Column:
    return F.coalesce(html.rlike(f"(?is){start_tag}"), F.lit(False))


def _value_re(name: str) -> str:
    """An attribute and, as group 1, its value as it is written, with its quotes."""
    return rf"""(?is)\s{name}\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)"""


def _unquoted(raw: Column) -> Column:
    def bare(x):
        quoted = x.startswith('"') | x.startswith("'")
        return decode_entities(F.when(quoted, F.substring(x, 2, F.length(x) - 2)).otherwise(x))
    return let(raw, bare)


def attr(tag_markup: Column, name: str) -> Column:
    """Value of attribute ``name`` inside one start tag ('' when absent);
    double, single and unquoted forms; entities decoded."""
    return _unquoted(F.regexp_extract(tag_markup, _value_re(name), 1))


def has_class(tag_markup: Column, css_class: str) -> Column:
    """Whether a start tag has a class."""
    return tag_markup.rlike(rf"""(?is)\sclass\s*=\s*["']?(?:[^"'>]*\s)?{css_class}(?:[\s"'>]|$)""")


def all_attr(html: Column, name: str) -> Column:
    """Values of attribute ``name`` on every element, in document order."""
    return F.transform(F.regexp_extract_all(html, F.lit(_value_re(name)), 1), _unquoted)


def _anchor_pieces(fragment: Column) -> Column:
    """Markup from each anchor's attributes on; comments, scripts and styles hold no anchor."""
    return F.filter(F.split(drop_invisible(fragment), r"(?i)<a(?=[\s>])"), lambda x, i: i > 0)


def _anchor_tag(piece: Column) -> Column:
    return F.concat(F.lit(" "), F.regexp_extract(piece, r"(?s)^([^>]*)>", 1))


def hrefs(fragment: Column) -> Column:
    """References of all anchors that have one, '' ones too, in document order."""
    raw = F.transform(_anchor_pieces(fragment), lambda p: F.regexp_extract(_anchor_tag(p), _value_re("href"), 1))
    return F.transform(F.filter(raw, lambda x: x != ""), _unquoted)


def anchors(fragment: Column) -> Column:
    """Array<struct<href, has_href, text>> of every ``<a>`` in document order.
    ``hrefs`` is cheaper where the references will do."""
    def one(p):
        def fields(raw):
            return F.struct(_unquoted(raw).alias("href"), (raw != "").alias("has_href"),
                            text(F.regexp_extract(p, r"(?is)^[^>]*>(.*?)(?:</a\s*>|$)", 1)).alias("text"))
        return let(F.regexp_extract(_anchor_tag(p), _value_re("href"), 1), fields)

    return F.transform(_anchor_pieces(fragment), one)

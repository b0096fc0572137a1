"""Small text expressions: blanks, integers, labels, timestamps, truncation."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .html import trim_ws
from .urls import let

ELLIPSIS = "…"


def nullif_blank(c: Column) -> Column:
    """P-4: trimmed, empty -> null."""
    return let(trim_ws(c), lambda t: F.when(t != "", t))


def digits_int(c: Column) -> Column:
    """P-12: integer made of all digits in the text, null when none."""
    d = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(d != "", d.try_cast("bigint"))


def after_label(c: Column, label: str) -> Column:
    """P-13: text after ``label`` (optional colon) to the end of that line,
    trimmed, trailing dots removed, empty -> null."""
    at = F.instr(c, label)
    behind = F.when(at > 0, F.substring(c, at + len(label), 1 << 30))
    value = F.substring_index(trim_ws(F.ltrim(trim_ws(behind), F.lit(":"))), "\n", 1)
    return let(trim_ws(F.rtrim(trim_ws(value), F.lit("."))), lambda x: F.when(x != "", x))


def clean_title(c: Column, noise: str) -> Column:
    """P-10: drop trailing counters, collapse whitespace, trim."""
    t = F.regexp_replace(F.coalesce(c, F.lit("")), noise, "")
    return trim_ws(F.regexp_replace(t, r"(?U)\s+", " "))


# The timestamp format of posts, in a byline and anywhere.
POSTED_RE = r"(\d{2}-\d{2}-\d{4}\s+\d{2}:\d{2})"
TS_RE = r"(\d{2})-(\d{2})-(\d{4})(?:\s+(\d{2}):(\d{2}))?"


def parse_ts(c: Column) -> Column:
    """P-14: first ``DD-MM-YYYY[ HH:MM]`` in the text; invalid dates -> null."""
    return let(c, _parse_ts)


def _parse_ts(c: Column) -> Column:
    has = F.coalesce(c.rlike(TS_RE), F.lit(False))

    def part(i):
        g = F.regexp_extract(c, TS_RE, i)
        return F.when(g == "", F.lit(0)).otherwise(g.cast("int"))

    ts = F.try_make_timestamp_ntz(part(3), part(2), part(1), part(4), part(5), F.lit(0))
    return F.when(has, ts)


def truncate(c: Column, n: int, marker: str = ELLIPSIS) -> Column:
    """P-15: keep ``n`` characters and append ``marker`` when longer."""
    return let(c, lambda x: F.when(F.length(x) > n, F.concat(F.substring(x, 1, n), F.lit(marker))).otherwise(x))


def author_slug(name: Column) -> Column:
    """P-18: ASCII alnum runs joined by '-', lower-cased, at most 40 chars,
    'author' when empty, plus 6 key chars of the name."""
    return let(name, _author_slug)


def _author_slug(name: Column) -> Column:
    words = F.filter(F.split(name, "[^a-zA-Z0-9]+"), lambda w: w != "")
    base = F.lower(F.array_join(words, "-"))
    return let(base, lambda b: F.concat(
        F.lit("authors/"), F.substring(F.when(b == "", F.lit("author")).otherwise(b), 1, 40), F.lit("-"),
        F.substring(F.sha1(F.encode(name, "UTF-8")), 1, 6), F.lit(".html")))


def html_escape(c: Column) -> Column:
    """P-20: escape text for generated HTML ('&' first)."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c

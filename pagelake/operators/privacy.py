"""Privacy jobs: PII masking (PRV-1), e-mail element redaction (PRV-2),
block stripping (PRV-3), address decoding (PRV-4/5), login walls (FLT-10)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pii as PII
from ..functions.urls import let
from ..profile import SiteProfile
from . import nodes as N

# Fixed value: what stands for a redacted address.
PLACEHOLDER = "[email hidden]"


def scrub_text(df: DataFrame, col: str, rules=PII.DEFAULT_RULES, out: str | None = None) -> DataFrame:
    return df.withColumn(out or col, PII.scrub(F.col(col), rules))


def pii_report(df: DataFrame, id_col: str, col: str, rules=PII.DEFAULT_RULES) -> DataFrame:
    """Per-row hit counts by rule, rows with at least one hit."""
    hits = PII.rule_hits(F.col(col), rules)
    r = df.select(id_col, *hits)
    any_hit = F.lit(False)
    for name, _, _ in rules:
        any_hit = any_hit | (F.col(f"n_{name}") > 0)
    return r.where(any_hit)


def redact_emails(html: Column, profile: SiteProfile) -> Column:
    """PRV-2: elements carrying an address token/vector and mailto links are
    replaced by a placeholder (free text is left alone)."""
    h = html
    for a in (profile.email_token_attr, profile.email_vector_attr):
        h = F.regexp_replace(h, rf"(?is)<([a-z0-9]+)\b[^>]*\s{a}\s*=[^>]*>.*?</\1\s*>", PLACEHOLDER)
    return F.regexp_replace(h, r"""(?is)<a\b[^>]*\shref\s*=\s*["']?mailto:[^>]*>.*?</a\s*>""", PLACEHOLDER)


def count_redactions(before: Column, after: Column) -> Column:
    return F.regexp_count(after, F.lit(re.escape(PLACEHOLDER))) - F.regexp_count(before, F.lit(re.escape(PLACEHOLDER)))


def strip_blocks(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """PRV-3: ``pages`` without the profile's blocks, each with all it holds up to its own end
    tag; one that is never closed goes with what is left of the element around it."""
    if not profile.strip_blocks:
        return pages
    def block(x):
        found = F.lit(False)
        for start in profile.strip_blocks:
            found = found | N.is_tag(x["token"], start)
        return found

    # the page's other columns as one, whatever their names are
    rest = [F.col(f"`{c}`") for c in pages.columns if c != "html"]
    p = N.dealt(pages.select(F.struct(F.lit(1).alias("_one"), *rest).alias("_page"), "html"), "_page")
    left = let(N.page_nodes(F.col("html")), lambda ns: F.when(F.size(ns) > 0, F.array_join(
        F.transform(N.outside_blocks(ns, block), lambda x: x["token"]), "")))
    out = p.select("_page", left.alias("_html"))
    return out.select(*[F.col("_html").alias(c) if c == "html" else F.col(f"_page.`{c}`") for c in pages.columns])


def login_wall(status: Column, content_type: Column, html: Column, password_field: str = "pass") -> Column:
    """FLT-10: 401/403, or an HTML 200 page with a password input (a logout
    form or a mere extension name does not count)."""
    pw = rf"""(?is)<input\b[^>]*\sname\s*=\s*["']?{password_field}["'\s/>]"""
    is_html = F.lower(F.coalesce(content_type, F.lit(""))).contains("html")
    return (status.isin(401, 403)
            | ((status == 200) & is_html & F.coalesce(html.rlike(pw), F.lit(False))))

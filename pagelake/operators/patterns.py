"""Scope by pattern tables (SET-5, FLT-3, FLT-4): any number of include and exclude patterns as rows.

``patterns`` has (site, kind, pattern): a lower-cased host or '*' for every site, 'include' or
'exclude', and a regular expression that is searched in a URL's decoded path and query.

A pattern can only match where each *literal* that all its matches hold occurs.  The longest such
literal is its factor; one trigram of it, the rarest in the URLs at hand, is its key.
URLs meet a pattern by an equi-join of their own trigrams and sites with the keys, and only then
is the expression tried.  Patterns without a factor of three characters are joined by site.

So the work follows the URLs that hold a pattern's rarest trigram, not URLs times patterns.
Trigrams are counted only if some pattern could use them.  A null URL has no verdict (false).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U

EVERY = "*"
#: Shares that the URLs of one trigram or site are dealt to; the patterns go to all of them.
SHARES = 32
_GAP = "\u0001"


def factor(pattern: Column) -> Column:
    """The longest literal that every match of a pattern holds; '' if none can be told.

    Escapes, classes, groups, repeated or optional characters and anchors break literals; an
    alternative outside of groups, an inline flag or an escape that names a character leaves none."""
    p = F.regexp_replace(pattern, r"\\[^A-Za-z0-9]|\\[dDwWsSbBAzZ]", _GAP)
    # a class, its quantifier, and what is left of one after groups
    p = F.regexp_replace(p, r"\[\^?\]?[^\]]*\]", _GAP)
    flags = p.contains("(?") | p.contains("\\")
    for _ in range(8):
        p = F.regexp_replace(p, r"\([^()]*\)", _GAP)
    p = F.regexp_replace(p, f"[^{_GAP}](?:[?*]|\\{{[^}}]*\\}})", _GAP)
    pieces = F.split(F.regexp_replace(p, r"[.^$+*?{}]", _GAP), _GAP)
    best = F.array_max(F.transform(pieces, lambda x: F.struct(F.length(x).alias("n"), x.alias("x"))))["x"]
    return F.when(flags | p.contains("|") | p.rlike(r"[()\[\]]"), F.lit("")).otherwise(F.coalesce(best, F.lit("")))


def trigrams(text: Column) -> Column:
    """All distinct runs of three characters of a text."""
    places = F.when(F.length(text) >= 3, F.sequence(F.lit(1), F.length(text) - 2)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.substring(text, i, 3)))


def pattern_keys(patterns: DataFrame, grams: DataFrame) -> DataFrame:
    """pattern rows with their key, the trigram of their factor that the fewest URLs hold (``grams``:
    gram, n), null where there is no factor."""
    p = patterns.select(F.lower("site").alias("site"), "kind", "pattern").distinct().withColumn("factor", factor(F.col("pattern")))
    own = p.withColumn("gram", F.explode_outer(trigrams(F.col("factor")))).join(grams, "gram", "left")
    return own.groupBy("site", "kind", "pattern", "factor").agg(
        F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g")))["g"].alias("key"))


def replacing(patterns: DataFrame) -> DataFrame:
    """SET-5: the sites (host) whose own include patterns replace those for every site."""
    return patterns.where((F.col("kind") == "include") & (F.col("site") != EVERY)).select(F.lower("site").alias("host")).distinct()


def scope(urls: DataFrame, patterns: DataFrame, url_col: str = "url", base_col: str | None = None) -> DataFrame:
    """``urls`` with ``excluded`` (FLT-4) and ``in_scope`` (FLT-3): the same site as ``base_col`` (if given),
    no exclude pattern and some include pattern of its site matches."""
    u = urls.select(F.col(url_col).alias("_u")).where(F.col("_u").isNotNull()).distinct()
    u = u.select("_u", U.host(F.col("_u")).alias("_host"), U.scope_target(F.col("_u")).alias("_t"))
    wanted = patterns.select(F.explode(trigrams(factor(F.col("pattern")))).alias("gram")).distinct()
    asked = u.select("_u", "_host", "_t", F.explode(trigrams(F.col("_t"))).alias("gram")).join(wanted, "gram", "left_semi")
    keyed = pattern_keys(patterns, asked.groupBy("gram").agg(F.count(F.lit(1)).alias("n")))
    # a trigram or a pattern for every site may be held by most URLs
    keyed = keyed.withColumn("_share", F.explode(F.sequence(F.lit(0), F.lit(SHARES - 1))))
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("_u"), F.lit(SHARES)).cast("int"))
    here = (F.col("site") == EVERY) | (F.col("site") == F.col("_host"))
    by_gram = asked.join(keyed.where(F.col("key").isNotNull()), (F.col("gram") == F.col("key")) & (F.col("_part") == F.col("_share"))).where(
        here & F.contains("_t", "factor")).select("_u", "_host", "_t", "site", "kind", "pattern")
    # patterns without a key meet the URLs of their site
    sites = u.select("_u", "_host", "_t", F.explode(F.array("_host", F.lit(EVERY))).alias("_s"),
                     F.pmod(F.xxhash64("_u"), F.lit(SHARES)).cast("int").alias("_part"))
    by_site = sites.join(keyed.where(F.col("key").isNull()), (F.col("_s") == F.col("site")) & (F.col("_part") == F.col("_share"))).select(*by_gram.columns)
    hits = by_gram.unionByName(by_site).where(F.regexp_like("_t", "pattern"))
    found = lambda kind, own: F.max((F.col("kind") == kind) & (F.col("site") != EVERY) if own else F.col("kind") == kind)
    said = hits.groupBy("_u").agg(found("exclude", False).alias("_ex"), found("include", False).alias("_any"),
                                  found("include", True).alias("_own"))
    replaced = replacing(patterns).withColumn("_replaced", F.lit(True))
    verdict = u.join(said, "_u", "left").join(replaced, F.col("_host") == F.col("host"), "left")
    no = F.lit(False)
    verdict = verdict.select("_u", F.coalesce("_ex", no).alias("excluded"), F.coalesce(
        F.when(F.col("_replaced"), F.col("_own")).otherwise(F.col("_any")), no).alias("_included"))
    out = urls.join(verdict, F.col(url_col) == F.col("_u"), "left").drop("_u")
    same = U.same_site(F.col(url_col), F.col(base_col)) if base_col else F.lit(True)
    return (out.withColumn("excluded", F.coalesce("excluded", no))
            .withColumn("in_scope", F.coalesce(same & F.col("_included") & ~F.col("excluded"), no)).drop("_included"))

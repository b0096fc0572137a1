"""Scope and policy filters (FLT-*), as predicates on canonical URLs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..profile import SiteProfile


def any_match(target: Column, patterns) -> Column:
    """Regex *search*: true when any pattern is found in the target."""
    c = F.lit(False)
    for p in patterns:
        c = c | target.rlike(p)
    return c


def excluded(url: Column, profile: SiteProfile, extra_exclude=()) -> Column:
    """FLT-4: an exclude pattern is found in the decoded path?query."""
    pats = tuple(profile.exclude) + tuple(extra_exclude)
    return U.let(U.scope_target(url), lambda t: any_match(t, pats))


def in_scope(url: Column, profile: SiteProfile, base: Column | None = None,
             include=None, extra_exclude=()) -> Column:
    """FLT-3: same site, no exclude match, some include match.

    ``include`` replaces the profile's include list when given (SET-5)."""
    site = base if base is not None else F.lit(profile.base_url)
    inc = tuple(include) if include else tuple(profile.include)
    exc = tuple(profile.exclude) + tuple(extra_exclude)

    def test(x):
        return U.let(U.scope_target(x["u"]), lambda t: U.same_site(x["u"], x["b"])
                     & ~any_match(t, exc) & any_match(t, inc))

    return U.let(F.struct(url.alias("u"), site.alias("b")), test)


def prune_excluded(df: DataFrame, profile: SiteProfile, url_col: str = "url", extra_exclude=()) -> DataFrame:
    """FLT-6: drop excluded stored pages (the store itself is untouched)."""
    return df.where(~excluded(F.col(url_col), profile, extra_exclude))


def category_ids(seeds: DataFrame, profile: SiteProfile, url_col: str = "url") -> DataFrame:
    """FLT-5: distinct category ids of the seeds that name one; a final slash is
    added to a seed's path first."""
    t = F.regexp_replace(U.scope_target(F.col(url_col)), r"/*(\?.*)?$", "/$1")
    cid = F.regexp_extract(t, profile.category_seed, 1)
    return seeds.select(cid.alias("cid")).where(F.col("cid") != "").distinct()


def category_scope(df: DataFrame, seeds: DataFrame, profile: SiteProfile, include=(), url_col: str = "url") -> DataFrame:
    """FLT-5: rows of ``df`` with ``in_scope``: the decoded path?query matches a
    pattern of the user's ``include``, names a category of a seed, or is a topic.

    The category ids in a URL are extracted and joined with the seeds' ids by
    value, so no URL meets a pattern that is not its own; whole ids are
    compared, so category 4 is not category 40.
    """
    ids = category_ids(seeds, profile)
    if ids.isEmpty():
        raise ValueError("no seed yields a category pattern")
    target = U.scope_target(F.col(url_col))
    named = df.select(F.col(url_col).alias("_u"), F.explode(F.array_distinct(
        F.regexp_extract_all(target, F.lit(profile.category_id), 1))).alias("cid"))
    hits = named.join(ids, "cid", "left_semi").select("_u").distinct().withColumn("_hit", F.lit(True))
    fixed = U.let(target, lambda t: any_match(t, (*include, profile.topic_pattern)))
    out = df.join(hits, F.col(url_col) == F.col("_u"), "left")
    return out.withColumn("in_scope", F.coalesce("_hit", F.lit(False)) | F.coalesce(fixed, F.lit(False))).drop("_u", "_hit")


def robots_allowed(pages: DataFrame, rules: DataFrame, agent: str, url_col: str = "url") -> DataFrame:
    """FLT-9: a URL is allowed unless the first matching rule of its host's
    applicable group disallows it.  ``rules``: (host, agent, rule_no, allow,
    path_prefix) with host '*' for every host.  The group is the rules
    naming ``agent`` when any exist for the host, else the '*' rules; host
    rules come before '*' rules, then rule_no; no rule = allowed.

    A URL meets only rules that match it: the join is on the host and on the
    first characters of the path, once for each length that a prefix has (there
    are at most as many lengths as the longest prefix has characters).
    """
    r = rules.where(F.col("agent").isin(agent, "*")).select(
        F.col("host").alias("_h"), (F.col("agent") == agent).alias("_ours"), "rule_no", "allow",
        F.col("path_prefix").alias("_p"))
    lengths = [x[0] for x in r.select(F.length("_p")).distinct().collect()]
    urls = pages.select(F.col(url_col).alias("_u")).distinct()
    urls = urls.withColumn("_host", U.host(F.col("_u")))
    t = U.scope_target(F.col("_u"))
    hosts = F.array(F.col("_host"), F.lit("*"))
    asked = urls.select("_u", F.explode(hosts).alias("_k"), t.alias("_t"))
    asked = asked.select("_u", "_k", F.explode(F.array(*[F.substring("_t", 1, n) for n in lengths] or [F.lit("")])).alias("_q"))
    hits = asked.distinct().join(r, (F.col("_k") == F.col("_h")) & (F.col("_q") == F.col("_p")))
    first = F.struct((F.col("_k") == "*").alias("w"), F.col("rule_no").alias("n"), F.col("allow").alias("a"))
    said = hits.groupBy("_u").agg(F.min(F.when(F.col("_ours"), first)).alias("ours"),
                                  F.min(F.when(~F.col("_ours"), first)).alias("every"))
    named = r.where("_ours").select(F.col("_h").alias("_n")).distinct()
    everywhere = not named.where(F.col("_n") == "*").isEmpty()
    own = urls.join(named, F.col("_host") == F.col("_n"), "left").select(
        F.col("_u").alias("_v"), (F.col("_n").isNotNull() | F.lit(everywhere)).alias("has_ours"))
    verdict = own.join(said, F.col("_v") == F.col("_u"), "left").select("_v", F.coalesce(
        F.when(F.col("has_ours"), F.col("ours.a")).otherwise(F.col("every.a")), F.lit(True)).alias("allowed"))
    out = pages.join(verdict, F.col(url_col) == F.col("_v"), "left").drop("_v")
    return out.withColumn("reason", F.when(~F.col("allowed"), F.lit("robots-disallowed")))

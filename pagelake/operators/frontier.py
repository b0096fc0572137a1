"""Frontier maintenance (JOIN-1, SET-2, WIN-1): discovered in-scope links
enter the queue once, in first-seen order."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..profile import SiteProfile
from . import scope as S
from . import extract as X
from .order import global_rank


def candidates(pages: DataFrame, profile: SiteProfile) -> DataFrame:
    """SET-2: links of each page and its next-page link (last), each once per page."""
    p = X.with_page_url(pages, profile)
    h, base = F.col("html"), F.col("page_url")
    nxt = X.next_page(h, base, profile)
    links = F.array_distinct(F.concat(X.link_targets(h, base, profile), F.when(nxt.isNotNull(), F.array(nxt)).otherwise(
        F.array().cast("array<string>"))))
    return p.select("page_id", "page_url", F.posexplode(links).alias("seq", "dst"))


def new_urls(edges: DataFrame, seen: DataFrame, profile: SiteProfile, base_col: str = "page_url") -> DataFrame:
    """``edges`` (page_url, key?, seq, dst) -> URLs not yet seen, ranked by
    first discovery (source key, then position)."""
    src_key = F.col("key") if "key" in edges.columns else F.sha1(F.encode(F.col(base_col), "UTF-8"))
    sc = edges.where(S.in_scope(F.col("dst"), profile, base=F.col(base_col))).select(
        F.col("dst").alias("url"), F.struct(src_key.alias("k"), F.col("seq").alias("s")).alias("first"))
    firsts = sc.groupBy("url").agg(F.min("first").alias("first"))
    fresh = firsts.join(seen.select("url"), "url", "left_anti")
    return global_rank(fresh, F.col("first"), F.col("url")).select("url", "rank")

"""Category discovery (WIN-4, SRC-6, SRT-4, PUB-4): three sources merged
with precedence category list > sitemap > menu, first wins per URL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import urls as U
from ..profile import SiteProfile
from .order import global_rank

LOC_RE = r"<loc>\s*([^<\s]+)\s*</loc>"


def sitemap_locs(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """SRC-6: every <loc> of a urlset / sitemapindex document, in order."""
    ok = F.col(text_col).contains("<urlset") | F.col(text_col).contains("<sitemapindex")
    return docs.where(ok).select("*", F.posexplode(F.regexp_extract_all(F.col(text_col), F.lit(LOC_RE), 1))
                                 .alias("loc_pos", "loc"))


def merge_sources(cats: DataFrame, sitemap: DataFrame, menu: DataFrame) -> DataFrame:
    """Each input: (url, title, seq).  Precedence by source, then seq; the
    result is ordered by URL (rank)."""
    u = (cats.select("url", "title", "seq", F.lit(0).alias("src"))
         .unionByName(sitemap.select("url", "title", "seq", F.lit(1).alias("src")))
         .unionByName(menu.select("url", "title", "seq", F.lit(2).alias("src"))))
    best = u.groupBy("url").agg(F.min_by(F.struct("title", "src"), F.struct("src", "seq")).alias("b"))
    best = best.select("url", F.col("b.title").alias("title"),
                       F.element_at(F.array(F.lit("catlist"), F.lit("sitemap"), F.lit("menu")),
                                    F.col("b.src") + 1).alias("source"))
    return global_rank(best, F.col("url"))


def seed_frontier(seeds: DataFrame, profile: SiteProfile, order_col: str) -> DataFrame:
    """SRC-7: seeds canonicalised and deduplicated, first occurrence wins."""
    c = seeds.select(U.canonical(F.col("url"), profile.strip_query_keys).alias("url"), F.col(order_col).alias("o"))
    firsts = c.groupBy("url").agg(F.min("o").alias("o"))
    return global_rank(firsts, F.col("o"), F.col("url")).select("url", "rank")

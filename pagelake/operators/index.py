"""Home-index jobs: labels, dates, topic/category collapse, totals (AGG-4..9).

Collapsing paginated pages is a plain ``groupBy`` with ``min_by`` on struct
keys, so partial aggregation runs map-side and a hot topic costs one small
aggregation buffer, not a list.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions import text as T
from ..functions import urls as U
from ..profile import SiteProfile
from .order import global_rank


def page_label(url, title, breadcrumb, profile: SiteProfile):
    """P-11: non-generic title -> last breadcrumb -> title without the site
    suffix -> URL tail -> URL.  FLT-12 is the generic-title test."""
    def chain(x):
        t, last, u = x["t"], x["last"], x["u"]
        generic = t.rlike(profile.generic_title)
        tail = F.substring_index(u, "/", -1)
        return U.let(H.trim_ws(F.regexp_replace(t, profile.site_suffix, "")), lambda unsuffixed: (
            F.when((t != "") & ~generic, T.clean_title(t, profile.title_noise))
            .when(last.isNotNull() & (H.trim_ws(last) != ""), T.clean_title(last, profile.title_noise))
            .when((t != "") & (unsuffixed != ""), T.clean_title(unsuffixed, profile.title_noise))
            .when(tail != "", tail)
            .otherwise(u)))

    return U.let(F.struct(
        H.trim_ws(F.coalesce(title, F.lit(""))).alias("t"),
        F.try_element_at(F.coalesce(breadcrumb, F.array().cast("array<string>")), F.lit(-1)).alias("last"),
        url.alias("u")), chain)


def classify(meta: DataFrame, profile: SiteProfile) -> DataFrame:
    """SET-4 + P-17: section (topic/category/other), group id and page no."""
    u = F.col("url")
    tid = F.regexp_extract(u, profile.topic_url, 1)
    cid = F.regexp_extract(u, profile.category_url, 1)
    is_t = u.rlike(profile.topic_url)
    is_c = ~is_t & u.rlike(profile.category_url)
    if profile.page_param:
        no = F.regexp_extract(u, profile.page_param, 1)
        t_no, c_no = no, no
    else:
        t_no = F.regexp_extract(u, profile.topic_url, 2)
        c_no = F.concat(F.regexp_extract(u, profile.category_url, 2), F.regexp_extract(u, profile.category_url, 3))
    page_no = (F.when(is_t, F.when(t_no != "", t_no.try_cast("bigint")).otherwise(F.lit(1)))
               .when(is_c, F.when(c_no != "", c_no.try_cast("bigint")).otherwise(F.lit(1))))
    return meta.select(
        "*",
        F.when(is_t, F.lit("topic")).when(is_c, F.lit("category")).otherwise(F.lit("other")).alias("section"),
        F.when(is_t, tid).when(is_c, cid).alias("group_id"),
        page_no.alias("page_no"),
    )


def collapse(classified: DataFrame, section: str) -> DataFrame:
    """AGG-4/5: one row per group id: first-page path (lowest page no, then
    key), page count, earliest date, label (first with a space, key order)."""
    g = classified.where(F.col("section") == section)
    return g.groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.min("date").alias("date"),
        F.min_by("path", F.struct("page_no", "key")).alias("path"),
        F.min_by("label", F.struct(~F.col("label").contains(" "), F.col("key"))).alias("label"),
        F.min("key").alias("first_key"),
    )


def topic_index(classified: DataFrame) -> DataFrame:
    """SRT-1: newest topic first, undated last; ties in first-seen key order.

    The rank comes from a distributed range sort (see ``order.global_rank``)."""
    t = collapse(classified, "topic")
    return global_rank(t, F.col("date").desc_nulls_last(), F.col("first_key"))


def category_index(classified: DataFrame) -> DataFrame:
    """SRT-2: categories by lower-cased label."""
    c = collapse(classified, "category")
    return global_rank(c, F.lower("label"), F.col("first_key"))


def other_pages(classified: DataFrame) -> DataFrame:
    o = classified.where(F.col("section") == "other").select("key", "path", "label")
    return global_rank(o, F.lower("label"), F.col("key"))


def home_totals(classified: DataFrame) -> DataFrame:
    """AGG-9: pages, topics, categories in the index."""
    return classified.agg(
        F.count(F.lit(1)).alias("n_pages"),
        F.count_distinct(F.when(F.col("section") == "topic", F.col("group_id"))).alias("n_topics"),
        F.count_distinct(F.when(F.col("section") == "category", F.col("group_id"))).alias("n_categories"),
        F.count_if(F.col("section") == "other").alias("n_other"),
    )


def page_dates(posts: DataFrame, key_cols=("page_id",), ts_col: str = "timestamp") -> DataFrame:
    """AGG-6: earliest parseable post timestamp per page."""
    return posts.groupBy(*key_cols).agg(F.min(T.parse_ts(F.col(ts_col))).alias("date"))


def display_date(c):
    return F.date_format(c, "dd-MM-yyyy")

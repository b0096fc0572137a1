"""Incremental change detection and upserts (JOIN-4, JOIN-5, SNK-1, SNK-2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.buckets import BucketTable
from .order import last_row


def diff(prior: DataFrame, fetched: DataFrame) -> DataFrame:
    """JOIN-4: classify each fetched page against the stored one by key:
    new (no prior), unchanged (validators and content equal), changed.
    Inputs: (key, url, etag, last_modified, content_sha)."""
    p = prior.select(F.col("key").alias("_k"), F.col("etag").alias("p_etag"), F.col("last_modified").alias("p_lm"),
                     F.col("content_sha").alias("p_sha"))
    j = fetched.join(p, F.col("key") == F.col("_k"), "left")
    same = (F.col("etag").eqNullSafe(F.col("p_etag")) & F.col("last_modified").eqNullSafe(F.col("p_lm"))
            & F.col("content_sha").eqNullSafe(F.col("p_sha")))
    change = F.when(F.col("_k").isNull(), F.lit("new")).when(same, F.lit("unchanged")).otherwise(F.lit("changed"))
    return j.select("key", "url", change.alias("change"))


def upsert(current: DataFrame, incoming: DataFrame, version_col: str = "version") -> DataFrame:
    """SNK-1/SNK-2: union and keep the last write per key, one row a key."""
    return last_row(current.unionByName(incoming), "key", version_col)


def versioned_table(spark: SparkSession, root: str, schema: str, version_col: str = "version", **sizes) -> BucketTable:
    """Pages or assets by the bucket of their key: an upsert writes the buckets it touches again,
    each key with its last version, and leaves all others as they are."""
    return BucketTable(spark, root, schema, "key", lambda rows: last_row(rows, "key", version_col), **sizes)

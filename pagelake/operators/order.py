"""Distributed global ranking.

``row_number()`` over an un-partitioned window moves every row into one
task.  Here the frame is range-sorted (distributed), written to the shared
checkpoint folder so both passes see the same layout, each partition is
counted, and the rank is the partition's offset plus the row's position.  The
offsets, one row a partition, are joined; nothing reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


def global_rank(df: DataFrame, *order: Column, name: str = "rank") -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    tagged = (df.orderBy(*order)
              .withColumn("_pid", F.spark_partition_id())
              .withColumn("_mid", F.monotonically_increasing_id()))
    tagged = tagged.checkpoint(eager=True)
    counts = tagged.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_pid")) - F.col("_n")
    offsets = counts.select(F.col("_pid").alias("_q"), before.alias("_before"))
    local = F.col("_mid") - F.shiftleft(F.col("_pid").cast("bigint"), 33)
    return (tagged.join(offsets, F.col("_pid") == F.col("_q"))
            .withColumn(name, (F.col("_before") + local + 1).cast("bigint"))
            .drop("_pid", "_mid", "_q", "_before"))


def last_row(df: DataFrame, key: str, order_col: str) -> DataFrame:
    """WIN-2: one row a key, that with the highest ``order_col`` (nulls lowest); rows tied there are
    told apart by a hash of their contents.  Each task keeps its best row of a key before the exchange."""
    w = Window.partitionBy(key).orderBy(F.col(order_col).desc_nulls_last(), F.xxhash64(*df.columns))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")

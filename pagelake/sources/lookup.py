"""Point lookup of stored rows by key (SRC-4).

``write_sorted`` lays a table down in the order of its key: files and row groups cover ranges that
do not overlap, and each row group has a Parquet Bloom filter of its keys.  A lookup states
its keys as equalities, which Parquet's reader tests against each row group's range and filter
before it reads any column, so it reads row groups in proportion to its keys, whatever the
size of the table.  Keys are stated ``AT_ONCE`` a scan; more than ``STATED`` are joined instead.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keys stated in one scan, and in all before a join reads the whole table.
AT_ONCE, STATED = 64, 4096


def write_sorted(df: DataFrame, path: str, key: str, files: int, group_bytes: int = 8 << 20, rows_a_group: int = 1 << 16) -> None:
    """Write ``df`` as ``files`` range-partitioned files in the order of ``key``, with small row groups that have filters."""
    (df.repartitionByRange(files, key).sortWithinPartitions(key).write
     .option("parquet.block.size", group_bytes)
     .option(f"parquet.bloom.filter.enabled#{key}", "true")
     .option(f"parquet.bloom.filter.expected.ndv#{key}", rows_a_group)
     .parquet(path))


def _either(conditions):
    """The conditions joined by OR as a balanced tree."""
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _either(conditions[:half]) | _either(conditions[half:])


def lookup(spark: SparkSession, path: str, key: str, keys: DataFrame, *columns: str) -> DataFrame:
    """The rows of the table at ``path`` whose key is among ``keys`` (a column ``key``; nulls match nothing)."""
    table = spark.read.parquet(path)
    shown = columns or ["*"]
    asked = keys.select(key).where(F.col(key).isNotNull()).distinct()
    some = [r[0] for r in asked.limit(STATED + 1).collect()]
    if len(some) > STATED:
        return table.join(asked, key, "left_semi").select(*shown)
    parts = [table.where(_either([F.col(key) == k for k in some[i:i + AT_ONCE]])) for i in range(0, len(some), AT_ONCE)]
    return (reduce(DataFrame.unionByName, parts) if parts else table.limit(0)).select(*shown)

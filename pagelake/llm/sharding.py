"""Sharding (operator 4): exact histogram sort into shards of near-equal bytes.

Rows are ordered by a 62-bit key: 38 bits of the text's hash, then 24 bits of
the id's hash.  Equal texts are therefore neighbours, yet a group of copies
larger than a shard can still be cut.  The splitters come from probing: every
round counts the exact bytes below a set of candidate boundaries in all
partitions (one small aggregate), keeps for each splitter the interval that
holds its target, and probes that interval finer, until the boundary is
within tolerance.  Then the rows are exchanged once, each to the partition of
its interval, and numbered with the counts that the probes have given.

What reaches the driver: a count for each probe, ``PROBES`` a splitter.

Defined results: null text has size 1 and the checksum of the empty text; a
null id sorts first; rows alike in text and id are placed one by one and keep
their number; an empty table gives no rows; extra columns travel along, also
under the names used here (see ``shard_documents``).
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

GROUP_BITS = 24
KEY_TOP = 1 << 62
PROBES = 128


def sort_key(doc_id, text):
    """38 bits of the text's hash, then 24 bits of the id's."""
    group = F.shiftrightunsigned(F.xxhash64(text), 64 - 38)
    member = F.shiftrightunsigned(F.xxhash64(doc_id, F.lit("row")), 64 - GROUP_BITS)
    return F.shiftleft(group, GROUP_BITS).bitwiseOR(member)


def count_between(keyed: DataFrame, bounds: list[int]) -> np.ndarray:
    """Exact (bytes, rows) in each gap between sorted ``bounds``; one pass."""
    edges = np.array(bounds, dtype=np.int64)

    def count(batches):
        total = np.zeros((len(edges) + 1, 2), dtype=np.int64)
        for b in batches:
            at = np.searchsorted(edges, b["k"].to_numpy(), side="right")
            np.add.at(total[:, 0], at, b["size"].to_numpy())
            np.add.at(total[:, 1], at, 1)
        seen = np.flatnonzero(total[:, 1])
        yield pd.DataFrame({"gap": seen, "b": total[seen, 0], "n": total[seen, 1]})

    rows = (keyed.select("k", "size").mapInPandas(count, "gap long, b long, n long")
            .groupBy("gap").agg(F.sum("b").alias("b"), F.sum("n").alias("n")).collect())
    out = np.zeros((len(edges) + 1, 2), dtype=np.int64)
    for r in rows:
        out[r["gap"]] = (r["b"], r["n"])
    return out


def find_splitters(keyed: DataFrame, targets: list[int], slack: list[int]) -> list[tuple[int, int]]:
    """For each target the boundary key whose bytes below come within its slack,
    with the exact number of rows below it.

    Boundaries between groups of equal texts are tried first; a group is cut
    only where no boundary between groups is near enough.  A boundary is final
    when it is within slack or its interval has no key left to probe.
    """
    # lo, bytes and rows below lo, hi, bytes and rows below hi
    ends = count_between(keyed, [])[0]
    spans = [(0, 0, 0, KEY_TOP, int(ends[0]), int(ends[1])) for _ in targets]
    done: list[tuple[int, int] | None] = [None] * len(targets)
    while True:
        asked: set[int] = set()
        for i, (lo, lb, ln, hi, hb, hn) in enumerate(spans):
            if done[i] is not None:
                continue
            near = (lo, lb, ln) if targets[i] - lb <= hb - targets[i] else (hi, hb, hn)
            if abs(near[1] - targets[i]) <= slack[i] or hi - lo <= 1:
                done[i] = (near[0], near[2])
                continue
            step = 1 << GROUP_BITS if hi - lo > 1 << GROUP_BITS else 1
            first, last = lo // step + 1, (hi - 1) // step
            n = min(PROBES, last - first + 1)
            asked.update(step * (first + (last - first) * j // max(1, n - 1)) for j in range(n))
        if not asked:
            return [d for d in done if d is not None]
        probes = sorted(asked)
        below = np.cumsum(count_between(keyed, probes), axis=0)
        for i, (lo, lb, ln, hi, hb, hn) in enumerate(spans):
            for j in range(bisect_right(probes, lo), bisect_left(probes, hi)):
                b, n = int(below[j][0]), int(below[j][1])
                if b > targets[i]:
                    hi, hb, hn = probes[j], b, n
                    break
                lo, lb, ln = probes[j], b, n
            spans[i] = (lo, lb, ln, hi, hb, hn)


def shard_documents(docs: DataFrame, n_shards: int = 16, tolerance: float = 0.005,
                    part_bytes: int = 64 << 20) -> DataFrame:
    """Rows of ``docs`` with size, text_crc32, law, shard, slot and grown_shard.

    Shards differ from the mean by at most ``tolerance`` of it and the bytes of
    one row, unless rows alike in text and id cannot be told apart.  ``slot``
    counts from 0 without gaps in each shard, in key order.  Each shard is cut
    further into pieces of about ``part_bytes`` for the exchange, so that no
    task takes a whole shard.  A column of ``docs`` under one of the new names
    is replaced.
    """
    new = ("size", "text_crc32", "law", "shard", "slot", "grown_shard")
    text = C.text_of()
    keyed = docs.select(C.whole_row(docs, *new).alias("_row"), F.col("doc_id").alias("_id"),
                        sort_key(F.col("doc_id"), text).alias("_k"),
                        (F.octet_length(text) + 1).cast("long").alias("size"),
                        F.crc32(text.cast("binary")).alias("text_crc32"))
    probed = C.materialised(keyed.select(F.col("_k").alias("k"), "size"))
    total = int(count_between(probed, [])[0][0])
    pieces = max(1, -(-total // (n_shards * part_bytes)))
    mean = total / (n_shards * pieces)
    ids = range(1, n_shards * pieces)
    found = find_splitters(
        probed, [int(mean * i) for i in ids],
        [int(tolerance * mean * pieces) // 2 if i % pieces == 0 else int(mean / 4) for i in ids])
    keys = np.maximum.accumulate(np.array([k for k, _ in found], dtype=np.int64)) if found else np.zeros(0, np.int64)
    below = [0, *np.maximum.accumulate([n for _, n in found]).tolist()] if found else [0]
    start = [below[i] - below[i - i % pieces] for i in range(n_shards * pieces)]

    @F.pandas_udf("int")
    def piece_of(k: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(keys, k.to_numpy(), side="right").astype("int32"))

    n = n_shards * pieces
    spread = keyed.withColumn("_p", piece_of("_k")).repartition(n, "_p")
    in_piece = F.row_number().over(Window.partitionBy("_p").orderBy("_k", "_id"))
    first = F.lit(start)[F.col("_p")] if n > 1 else F.lit(0)
    return spread.select(
        "_row.*", "size", "text_crc32", F.lit("bytes").alias("law"),
        F.floor(F.col("_p") / pieces).cast("int").alias("shard"),
        (first + in_piece - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return (shard_documents(docs)
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"))

"""Keyed table in hash buckets with a committed manifest (STM-1, STM-4, SNK-1, SNK-2).

A row's bucket is a hash of its key.  The data of a write are one folder, a *part*, with a file for
each bucket it touches; a manifest names, for every bucket, the parts that hold it.  A write
becomes visible when the manifest of the next version is committed, so a failed one leaves the table
as it was, and the manifest keeps the number of the last batch, so a replayed batch changes nothing.
One writer at a time.

``append`` adds a part (rows of one key are merged when read, and in the bucket itself once it has
``max_parts`` parts); ``upsert`` writes the touched buckets again, merged, and leaves the files of
all others alone.  When buckets hold more than ``bucket_rows`` rows on average, the write doubles
their number.  So a batch reads and writes in proportion to the buckets it touches, which
stay of one size however large the table grows.

Each part has a Bloom filter a bucket, kept as rows (bucket, word, bits).  ``absent`` asks the
filters of the touched buckets first and reads the data of those buckets only that may
hold one of the keys.

The driver holds the manifest: a few names a bucket.  Null keys are not stored; an empty table
has no version and reads as no rows.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from typing import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store as ST

#: Bits and probes a key of the Bloom filters: about one key in a hundred is looked up in vain.
BITS, PROBES = 10, 7
_MANIFEST = "batch long, n_buckets int, bucket int, part string, n_rows long"
_FILTER = "bucket int, word int, bits long"


@dataclass
class Manifest:
    version: int = 0
    batch: int = -1
    n_buckets: int = 0
    #: bucket -> part -> rows
    parts: dict[int, dict[str, int]] = field(default_factory=dict)

    def n_rows(self) -> int:
        return sum(n for parts in self.parts.values() for n in parts.values())


class BucketTable:
    """``merge`` makes one row a key of several; ``key`` is the name of a string column of ``schema``."""

    def __init__(self, spark: SparkSession, root: str, schema: str, key: str, merge: Callable[[DataFrame], DataFrame],
                 n_buckets: int = 16, bucket_rows: int = 1 << 16, max_parts: int = 8):
        self.spark, self.root, self.schema, self.key, self.merged = spark, root.rstrip("/"), schema, key, merge
        self.first_buckets, self.bucket_rows, self.max_parts = n_buckets, bucket_rows, max_parts
        self.words = -(-BITS * bucket_rows // 64)

    # ---- manifest
    def manifest(self) -> Manifest:
        versions = ST.committed_versions(self.spark, f"{self.root}/manifest")
        if not versions:
            return Manifest(n_buckets=self.first_buckets)
        rows = self.spark.read.schema(_MANIFEST).parquet(f"{self.root}/manifest/version={versions[-1]}").collect()
        parts: dict[int, dict[str, int]] = {}
        for r in rows:
            if r["bucket"] >= 0:
                parts.setdefault(r["bucket"], {})[r["part"]] = r["n_rows"]
        return Manifest(versions[-1], rows[0]["batch"], rows[0]["n_buckets"], parts)

    def _commit(self, new: Manifest) -> None:
        rows = [(new.batch, new.n_buckets, -1, "", 0)]
        rows += [(new.batch, new.n_buckets, b, p, n) for b, parts in sorted(new.parts.items()) for p, n in parts.items()]
        ST.write_version(self.spark.createDataFrame(rows, _MANIFEST).coalesce(1), f"{self.root}/manifest", new.version)

    # ---- buckets and files
    def bucket(self, n_buckets: int) -> Column:
        return F.pmod(F.xxhash64(self.key), F.lit(n_buckets)).cast("int")

    def touched(self, keys: DataFrame, n_buckets: int) -> list[int]:
        return [r[0] for r in keys.where(F.col(self.key).isNotNull()).select(self.bucket(n_buckets)).distinct().collect()]

    def _paths(self, of: Manifest, kind: str, buckets=None) -> list[str]:
        chosen = of.parts if buckets is None else [b for b in buckets if b in of.parts]
        return [f"{self.root}/{kind}/{p}/bucket={b}" for b in chosen for p in of.parts[b]]

    def _load(self, paths: list[str], schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def rows(self, buckets=None, of: Manifest | None = None) -> DataFrame:
        """Stored rows, one a key."""
        return self.merged(self._load(self._paths(of or self.manifest(), "data", buckets), self.schema))

    def _write(self, rows: DataFrame, batch: int, n_buckets: int) -> tuple[str, dict[int, int]]:
        """A new part of these rows, with its filters; its name and its rows a bucket."""
        part = f"{batch}-{uuid.uuid4().hex[:8]}"
        own = rows.where(F.col(self.key).isNotNull()).withColumn("bucket", self.bucket(n_buckets))
        (own.repartition("bucket").sortWithinPartitions("bucket", self.key)
         .write.partitionBy("bucket").parquet(f"{self.root}/data/{part}"))
        data = self.spark.read.schema(f"{self.schema}, bucket int").parquet(f"{self.root}/data/{part}")
        probe = data.select("bucket", F.explode(self._places()).alias("place"))
        (probe.groupBy("bucket", F.col("place.word").alias("word")).agg(F.bit_or("place.bit").alias("bits"))
         .repartition("bucket").sortWithinPartitions("bucket", "word").write.partitionBy("bucket").parquet(f"{self.root}/filter/{part}"))
        return part, {r["bucket"]: r["count"] for r in data.groupBy("bucket").count().collect()}

    def _places(self) -> Column:
        """Words of a key's filter, and its bit in each."""
        # two hashes give all probes; a word has 64 bits
        first, second = F.xxhash64(F.lit(1), self.key), F.xxhash64(F.lit(2), self.key)
        at = [F.pmod(first % F.lit(1 << 40) + F.lit(i) * (second % F.lit(1 << 40)), F.lit(self.words * 64)) for i in range(PROBES)]
        return F.array(*[F.struct(F.shiftright(x, 6).cast("int").alias("word"), F.call_function(
            "shiftleft", F.lit(1).cast("long"), (x % 64).cast("int")).alias("bit")) for x in at])

    # ---- reading
    def may_hold(self, keys: DataFrame, of: Manifest, buckets: list[int]) -> DataFrame:
        """Keys that some part's filter cannot exclude."""
        paths = self._paths(of, "filter", buckets)
        if not paths:
            return keys.limit(0)
        place = [F.regexp_extract("_metadata.file_path", r"/filter/([^/]+)/bucket=(\d+)/", i) for i in (1, 2)]
        filters = (self.spark.read.schema("word int, bits long").parquet(*paths)
                   .select(place[0].alias("part"), place[1].cast("int").alias("bucket"), "word", "bits"))
        probes = keys.select(self.key, self.bucket(of.n_buckets).alias("bucket"), F.explode(self._places()).alias("place"))
        probes = probes.select(self.key, "bucket", "place.word", "place.bit").groupBy(self.key, "bucket", "word").agg(
            F.bit_or("bit").alias("bit"))
        wanted = probes.groupBy(self.key).agg(F.count(F.lit(1)).alias("n_words"))
        hit = probes.join(filters, ["bucket", "word"]).where(F.col("bits").bitwiseAND(F.col("bit")) == F.col("bit"))
        full = hit.groupBy(self.key, "part").agg(F.count(F.lit(1)).alias("n")).join(wanted, self.key).where("n = n_words")
        return full.select(self.key).distinct()

    def absent(self, keys: DataFrame) -> DataFrame:
        """The distinct non-null keys (one column) that the table does not hold."""
        of = self.manifest()
        keys = keys.select(self.key).where(F.col(self.key).isNotNull()).distinct()
        buckets = self.touched(keys, of.n_buckets) if of.parts else []
        found = self.touched(self.may_hold(keys, of, buckets), of.n_buckets) if of.parts else []
        held = self._load(self._paths(of, "data", found), self.schema).select(self.key)
        return keys.join(held, self.key, "left_anti")

    def lookup(self, keys: DataFrame) -> DataFrame:
        """Stored rows of these keys, one a key."""
        of = self.manifest()
        keys = keys.select(self.key).distinct()
        found = self._load(self._paths(of, "data", self.touched(keys, of.n_buckets) if of.parts else []), self.schema)
        return self.merged(found.join(keys, self.key, "left_semi"))

    # ---- writing
    def append(self, rows: DataFrame, batch: int) -> bool:
        """Add a batch; False if it has been added before."""
        return self._add(rows, batch, rewrite=False)

    def upsert(self, rows: DataFrame, batch: int) -> bool:
        """Merge a batch into the buckets it touches; False if that has been done before."""
        return self._add(rows, batch, rewrite=True)

    def _add(self, rows: DataFrame, batch: int, rewrite: bool) -> bool:
        old = self.manifest()
        if batch <= old.batch:
            return False
        part, count = self._write(self.merged(rows), batch, old.n_buckets)
        parts = {b: dict(ps) for b, ps in old.parts.items()}
        for b, n in count.items():
            parts.setdefault(b, {})[part] = n
        new = Manifest(old.version + 1, batch, old.n_buckets, parts)
        full = [b for b in count if len(parts[b]) > 1 and (rewrite or len(parts[b]) > self.max_parts)]
        n_buckets = new.n_buckets
        while new.n_rows() > n_buckets * self.bucket_rows:
            n_buckets *= 2
        if n_buckets > new.n_buckets:
            part, count = self._write(self.rows(of=new), batch, n_buckets)
            new = Manifest(new.version, batch, n_buckets, {b: {part: n} for b, n in count.items()})
        elif full:
            part, count = self._write(self.rows(full, new), batch, n_buckets)
            new.parts.update({b: {part: n} for b, n in count.items()})
        self._commit(new)
        return True

    def vacuum(self, keep: int = 2) -> None:
        """Drop all but the newest manifests, and the parts that none of these names."""
        versions = ST.committed_versions(self.spark, f"{self.root}/manifest")
        for v in versions[:-keep]:
            ST.delete(self.spark, f"{self.root}/manifest/version={v}")
        named = {r[0] for v in versions[-keep:] for r in self.spark.read.schema(_MANIFEST).parquet(
            f"{self.root}/manifest/version={v}").select("part").distinct().collect()}
        for kind in ("data", "filter"):
            for part in ST.names(self.spark, f"{self.root}/{kind}"):
                if part not in named:
                    ST.delete(self.spark, f"{self.root}/{kind}/{part}")

"""MinHash near-duplicates (operator 3): SuperMinHash, banding, verification, union-find.

1. Each text becomes the set of its shingle hashes.  Texts with equal sets are
   one class; only classes go on, each with a text of one member.
2. SuperMinHash signatures (``superminhash``), 32 bands of 5 values: two sets
   of similarity 0.8 share no band with probability 3e-6.
3. In each bucket all members are compared with one of them, first the one of
   the smallest id, then, where the links found leave a bucket of ``LARGE`` or
   more in several components, with ``PIVOTS`` others at once.  Links are confirmed on the full sets, read once for each
   pair; a set that many are compared with is copied to several tasks.
4. Where these links leave a bucket in several components, its members' sets
   are joined by prefix: in an order of shingles with rare ones first, two
   sets of similarity 0.8 or more share a shingle among the first fifth of
   each, at places that leave enough shingles behind them for the overlap that
   is needed.  Sets that merely share a passage or a template have enough
   shingles of their own to meet nobody there, so that no bucket's pairs are
   listed, and none is left out.  How rare a shingle is comes from a table of
   ``SLOTS`` counts; any order would be right, a good one is fast.
5. Components of the links (``components``).

Defined results: texts without words (null, too) have an empty set, are linked
with nothing and are their own component; rows alike in id and text belong to
one component and are all kept or none; a null id is reachable but never names
a component, unless no member has an id: then component_id is null and the row
is kept; an empty table gives no rows; extra columns are not carried on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import scratch_path

from . import common as C
from . import superminhash as S
from .components import components

PERCENT = 80
#: Members of a bucket that all others are compared with, after the first one.
PIVOTS = 3
LARGE = 32
#: Counts that tell rare shingles from frequent ones.
SLOTS = 1 << 20
#: Members that one task compares with one set.
SALT_ROWS = 500


def set_id(s: np.ndarray) -> int:
    """Identity of a set, as a signed 64-bit number."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).view(np.int64))


def signed(docs: DataFrame, n: int = S.SHINGLE) -> DataFrame:
    """doc_id, text_id, n_shingles, h (the set's identity, null if empty) and bands."""

    def sign(batches):
        for b in batches:
            for at in range(0, len(b), 256):
                part = b.slice(at, 256)
                sets = [S.shingle_hashes(S.tokens(t.as_py()), n) for t in part.column("text")]
                full = [s for s in sets if len(s)]
                keys = iter(S.band_keys(S.signatures(full)).tolist() if full else ())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_id"), pa.array([len(s) for s in sets], pa.int64()),
                     pa.array([set_id(s) if len(s) else None for s in sets], pa.int64()),
                     pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "text_id", "n_shingles", "h", "bands"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_id"),
                       F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(sign, "doc_id long, text_id long, n_shingles long, h long, bands array<long>")


def class_texts(docs: DataFrame, wanted: DataFrame, n: int) -> DataFrame:
    """(h, text): one text for each wanted class, found by the id and text of one member."""

    def keep(batches):
        for b in batches:
            mask = [set_id(S.shingle_hashes(S.tokens(t.as_py()), n)) == h.as_py()
                    for t, h in zip(b.column("text"), b.column("h"), strict=True)]
            yield b.filter(pa.array(mask, pa.bool_()))

    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64("text").alias("_t"),
                       F.col("text").cast("binary").alias("text"))
    rows = rows.join(wanted, F.col("_id").eqNullSafe(F.col("first_id")) & (F.col("_t") == F.col("first_text"))).select("h", "text")
    return rows.mapInArrow(keep, "h long, text binary").dropDuplicates(["h"])


def confirmed(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets are linked.

    Rows of a group are read in order, ``a`` first: a task holds two sets.
    """
    tasks = pairs.groupBy("a").count().select(F.col("a").alias("_a"), F.ceil(F.col("count") / SALT_ROWS).alias("n"))
    pairs = pairs.join(tasks, F.col("a") == F.col("_a")).select(
        "a", "b", F.pmod(F.xxhash64("b"), F.col("n")).alias("salt"))
    members = pairs.join(texts, F.col("b") == F.col("h")).select("a", "salt", "b", "text")
    heads = pairs.select("a", "salt").distinct().join(texts, F.col("a") == F.col("h"))
    heads = heads.select("a", "salt", F.lit(None).cast("long").alias("b"), "text")
    rows = heads.unionByName(members).repartition("a", "salt")
    rows = rows.sortWithinPartitions("a", "salt", F.col("b").asc_nulls_first())

    def compare(batches):
        key = head = None
        for batch in batches:
            found = []
            for a, salt, b, text in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                s = S.shingle_hashes(S.tokens(text), n)
                if b is None:
                    key, head = (a, salt), s
                elif key == (a, salt) and S.linked(head, s, percent):
                    found.append((a, b))
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return rows.mapInArrow(compare, "a long, b long")


def open_members(buckets: DataFrame, labels: DataFrame) -> DataFrame:
    """(h, c): members of buckets that lie in two components or more, with their component."""
    named = buckets.select("key", "h").join(labels, F.col("h") == F.col("node"), "left").select(
        "key", "h", F.coalesce("root", "h").alias("c"))
    split = (named.groupBy("key").agg(F.min("c").alias("_min"), F.max("c").alias("_max"))
             .filter("_min <> _max").select(F.col("key").alias("_k")))
    return named.join(split, F.col("key") == F.col("_k")).select("h", "c").distinct()


def star_pairs(buckets: DataFrame) -> DataFrame:
    """(a, b): each member of a bucket, b, with the one of the smallest id, a, and in large
    buckets with ``PIVOTS`` others."""
    by_id = F.coalesce("first_id", F.lit((1 << 63) - 1))
    others = [F.min_by("h", F.xxhash64("h", F.lit(i))).alias(f"p{i}") for i in range(PIVOTS)]
    first = buckets.groupBy("key").agg(F.count("h").alias("n"), F.min_by("h", by_id).alias("p"), *others)
    large = F.col("n") >= LARGE
    heads = F.array(F.col("p"), *[F.when(large, F.col(f"p{i}")) for i in range(PIVOTS)])
    first = first.select(F.col("key").alias("_k"), F.array_distinct(F.array_compact(heads)).alias("heads"))
    pairs = buckets.join(first, F.col("key") == F.col("_k")).select(F.explode("heads").alias("a"), F.col("h").alias("b"))
    return pairs.filter("a <> b").distinct()


def shingle_counts(sets: DataFrame, n: int) -> np.ndarray:
    """How many sets have a shingle of each slot."""

    def count(batches):
        seen = np.zeros(SLOTS, np.int64)
        for b in batches:
            for text in b.column("text"):
                np.add.at(seen, (S.shingle_hashes(S.tokens(text.as_py()), n) % np.uint64(SLOTS)).astype(np.int64), 1)
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(slots), "n": pa.array(seen[slots])})

    rows = sets.select("text").mapInArrow(count, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n"))
    out = np.zeros(SLOTS, np.int64)
    table = rows.toArrow()
    out[table.column("slot").to_numpy()] = table.column("n").to_numpy()
    return out


def prefix_pairs(open_: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """Pairs (a, b) of different components that can be similar, by prefix and place.

    Of sets that share a shingle, most may be in one component already; pairs
    are sought between the others and all.
    """
    sets = open_.join(texts.withColumnRenamed("h", "_h"), F.col("h") == F.col("_h")).select("h", "c", "text")
    sets = C.materialised(sets)
    counts = sets.sparkSession.sparkContext.broadcast(shingle_counts(sets, n))

    def prefix(batches):
        for b in batches:
            for h, c, text in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                s = S.shingle_hashes(S.tokens(text), n)
                seen = counts.value[(s % np.uint64(SLOTS)).astype(np.int64)]
                first = np.lexsort((s, seen))[:len(s) - -(-len(s) * percent // 100) + 1]
                place = np.flatnonzero(seen[first] > 1)
                first = first[place]
                yield pa.RecordBatch.from_pydict({
                    "h": pa.array(np.full(len(first), h), pa.int64()), "c": pa.array(np.full(len(first), c), pa.int64()),
                    "size": pa.array(np.full(len(first), len(s)), pa.int64()),
                    "place": pa.array(place, pa.int64()), "s": pa.array(s.view(np.int64)[first])})

    rows = C.materialised(sets.mapInArrow(prefix, "h long, c long, size long, place long, s long"))
    most = rows.groupBy("s", "c").count().groupBy("s").agg(
        F.max_by("c", F.struct("count", "c")).alias("major"), F.count(F.lit(1)).alias("n"))
    most = most.filter("n > 1").select(F.col("s").alias("_s"), "major")
    rows = rows.join(most, F.col("s") == F.col("_s")).drop("_s")
    x = rows.filter("c <> major").select("s", F.col("h").alias("a"), F.col("c").alias("ca"), F.col("size").alias("na"),
                                         F.col("place").alias("pa"), "major")
    y = rows.select(F.col("s").alias("_s"), F.col("h").alias("b"), F.col("c").alias("cb"), F.col("size").alias("nb"),
                    F.col("place").alias("pb"))
    left = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    fits = ((100 + percent) * left >= percent * (F.col("na") + F.col("nb")))
    apart = (F.col("ca") != F.col("cb")) & ((F.col("cb") == F.col("major")) | (F.col("a") < F.col("b")))
    return x.join(y, (F.col("s") == F.col("_s")) & apart & fits).select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` after further links between their components."""
    if links.isEmpty():
        return labels
    one = labels.select(F.col("node").alias("_a"), F.col("root").alias("x"))
    two = labels.select(F.col("node").alias("_b"), F.col("root").alias("y"))
    ends = links.join(one, F.col("a") == F.col("_a"), "left").join(two, F.col("b") == F.col("_b"), "left")
    over = components(ends.select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b")))
    over = over.withColumnsRenamed({"node": "_n", "root": "_r"})
    known = labels.join(over, F.col("root") == F.col("_n"), "left").select("node", F.coalesce("_r", "root").alias("root"))
    return known.unionByName(over.select(F.col("_n").alias("node"), F.col("_r").alias("root"))).groupBy("node").agg(
        F.min("root").alias("root"))


def near_duplicates(docs: DataFrame, shingle: int = S.SHINGLE, percent: int = PERCENT) -> DataFrame:
    """doc_id, text_id, n_shingles, h, component_id and kept of each row of ``docs`` (doc_id, text).

    The bands are made for ``percent`` of 80 or more.
    """
    spark = docs.sparkSession
    rows = C.materialised(signed(docs, shingle))
    classes = rows.filter("h IS NOT NULL").groupBy("h").agg(
        F.min("doc_id").alias("first_id"), F.coalesce(F.min_by("text_id", "doc_id"), F.min("text_id")).alias("first_text"),
        F.first("bands").alias("bands"))
    member = classes.select("h", "first_id", "first_text", F.explode("bands").alias("key"))
    shared = member.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("key").alias("_k"))
    buckets = C.materialised(member.join(shared, F.col("key") == F.col("_k")).drop("_k"))
    path = scratch_path(spark, f"neardup-{uuid.uuid4().hex}")
    class_texts(docs, buckets.select("h", "first_id", "first_text").dropDuplicates(["h"]), shingle).write.parquet(path)
    texts = spark.read.parquet(path)

    C.release(spark)
    links = C.materialised(confirmed(star_pairs(buckets), texts, shingle, percent))
    labels = components(links)
    open_ = C.materialised(open_members(buckets, labels))
    C.release(spark)
    if not open_.isEmpty():
        more = C.materialised(confirmed(prefix_pairs(open_, texts, shingle, percent), texts, shingle, percent))
        labels = merged(labels, more)
        C.release(spark)
    of = classes.select("h", "first_id").join(labels, F.col("h") == F.col("node"), "left")
    of = of.select("h", "first_id", F.coalesce("root", "h").alias("root"))
    named = of.groupBy("root").agg(F.min("first_id").alias("component_id")).select(F.col("root").alias("_r"), "component_id")
    of = of.join(named, F.col("root") == F.col("_r")).select(F.col("h").alias("_h"), "component_id")
    out = rows.drop("bands").join(of, F.col("h") == F.col("_h"), "left")
    component = F.when(F.col("h").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return (out.withColumn("component_id", component).drop("_h")
            .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())))


def one_of_each(docs: DataFrame, **params) -> DataFrame:
    """The rows of ``docs`` that stay, all their columns as they are: of each
    component one row, of rows with an empty set one for each id and text."""
    found = near_duplicates(docs, **params).filter("kept")
    nameless = F.when(F.col("component_id").isNull(), F.col("h"))
    stay = found.groupBy("component_id", "doc_id", nameless.alias("_n")).agg(F.min("text_id").alias("_t"))
    stay = stay.select(F.col("doc_id").alias("_i"), "_t").distinct()
    rows = docs.select(C.whole_row(docs).alias("_row"), F.col("doc_id").cast("long").alias("_id"),
                       F.xxhash64("text").alias("_text"))
    rows = rows.join(stay, F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text") == F.col("_t")))
    first = F.row_number().over(Window.partitionBy("_id", "_text").orderBy(F.lit(0)))
    return rows.withColumn("_at", first).filter("_at = 1").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END)) AS g FROM d),
c AS (SELECT min(doc_id) AS c, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
x AS (SELECT c, n, unnest(g) AS z FROM c),
l AS (SELECT a.c AS a, b.c AS b FROM x a JOIN x b ON a.z = b.z AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(c, reach) AS (SELECT c, c FROM c UNION SELECT r.c, e.b FROM r JOIN e ON e.a = r.reach),
k AS (SELECT c, min(reach) AS component FROM r GROUP BY c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(k.component, s.doc_id) AS component_id, coalesce(k.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN c ON c.g = s.g LEFT JOIN k USING (c)
"""

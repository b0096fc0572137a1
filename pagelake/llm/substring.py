"""Substring deduplication (operator 6): FM-index per shard of equal content.

A window is ``WINDOW`` consecutive words.  Its anchor is the group of ``GRAM``
words in it whose hash is smallest (the leftmost of equal ones), so equal
windows have equal anchors at the same place, and consecutive windows mostly
share one: they form a segment.

1. Every document is cut into segments; a narrow row for each goes to the
   task of its anchor; equal ones within a document go anywhere, for all but
   the first are known to be repeats.  Of equal segments all but the earliest
   are repeats as a whole.  Earliest segments whose anchor also begins other segments go on.
2. Those segments' words are shipped to the shard of their anchor.  A shard
   builds an FM-index (``fmindex``) of its segments, streams them through
   backward search and reports the windows that also start earlier.  A shard
   is read in the order of its anchors, some thousand segments at a time; of
   an anchor that goes on, the segments stay.  Anchors with more than ``HOT``
   segments are split into single windows first, which go to shards by their
   own hash, and of which only the earliest of equal ones stays in the index.
   So are anchors that a sample of the documents shows to be frequent, such as
   a line that many share: their segments are dealt to several tasks in step 1
   already.  The sample decides on that only, never on a result.
3. The reported intervals are gathered for each document and its words cut.

A document is an id and a text, by 64 bits of its hash: equal rows find the same marks once, so the
work follows the rows, also where many share an id.  Texts are shuffled once, by both.  Nothing
is collected.

Defined results: a null text has no words; rows with the same id and text
count as one document: each keeps and loses the same words; rows with the same
id and other texts are documents of their own, in the order of the text's
hash; a null id counts as the hash of its text; an empty table gives no rows; extra columns are not
carried on.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import scratch_path

from . import common as C
from .fmindex import FMIndex
from .superminhash import mix, word_hashes

WINDOW = 20
GRAM = 6
HOT = 1000
#: Anchors with this share of a sample's segments are dealt to SALTS tasks: 2000 at most.
FREQUENT = 0.0005
SALTS = 64
#: Tasks to which a document's further copies of one segment are dealt.
AGAIN = 4096
SAMPLE = 50
#: Segments that are indexed at once.
CHUNK = 6_000
#: Words of a document that are cut into segments at once.
BLOCK = 1 << 20
#: Words of which documents are cut together, as many as the caches hold.
TOGETHER = 1 << 15
_PLACE = 24
#: Bits below a row's number in the places of its words.
_ROW = 32
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_ONE = np.uint64(1)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = _ONE
    return np.multiply.accumulate(out)


def span_hashes(h: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """A hash of the words [start, end) for each pair, from one prefix sum."""
    sums = np.concatenate([[np.uint64(0)], np.add.accumulate(h * powers(_BASE, len(h)))])
    inverse = powers(_INVERSE, len(h) + 1)
    return mix((sums[end] - sums[start]) * inverse[start], 3) ^ mix((end - start).astype(np.uint64), 5)


def segments(h: np.ndarray, sizes: np.ndarray, window: int = WINDOW, gram: int = GRAM):
    """(text, anchor, segment hash, first window, windows) of each run of windows with one anchor.

    h: the hashes of the words of several texts, one text after the other; sizes: their words, a
    window at least; windows are numbered from 0 in each text."""
    ends = np.cumsum(sizes)
    g = h[:len(h) - gram + 1]
    for i in range(1, gram):
        g = g * _BASE + h[i:len(h) - gram + 1 + i]
    g = mix(g, 11)
    key = (g >> np.uint64(_PLACE) << np.uint64(_PLACE)) | np.arange(len(g), dtype=np.uint64)
    width, have = window - gram + 1, 1
    while have < width:
        step = min(have, width - have)
        key, have = np.minimum(key[:len(key) - step], key[step:]), have + step
    place = (key & np.uint64((1 << _PLACE) - 1)).astype(np.int64)
    place[(ends[:-1, None] - np.arange(1, window)).reshape(-1)] = -1  # they end in the next text
    first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
    count = np.diff(np.append(first, len(place)))
    whole = place[first] >= 0
    first, count = first[whole], count[whole]
    anchor = (g[place[first]] >> np.uint64(_PLACE)).astype(np.int64)
    text = np.searchsorted(ends, first, side="right")
    return text, anchor, span_hashes(h, first, first + count + window - 1).view(np.int64), first - (ends - sizes)[text], count


def frequent_anchors(docs: DataFrame, window: int) -> frozenset[int]:
    """Anchors that many segments of a sample have."""
    some = docs.filter(F.pmod(F.xxhash64("doc_id", "tid"), F.lit(SAMPLE)) == 0)
    counts = C.materialised(cut(some, window, frozenset()).groupBy("anchor").count())
    whole = counts.agg(F.sum("count")).first()[0] or 0
    often = counts.filter(F.col("count") >= max(16, whole * FREQUENT))
    return frozenset(r["anchor"] for r in often.collect())


def cut(docs: DataFrame, window: int, frequent: frozenset[int]) -> DataFrame:
    """anchor, salt, again, seg, doc_id, tid, at of every segment; at holds start and windows, in
    this order; again: the document has had it before.  Those have salts of their own, as have
    the segments of frequent anchors, equal segments equal ones; for the others it is 0."""
    often = np.array(sorted(frequent), np.int64)

    def cuts(held):
        doc, tid, lo, h = zip(*held, strict=True)
        text, anchor, seg, first, count = segments(np.concatenate(h), np.array([len(x) for x in h]), window)
        order = np.argsort(seg, kind="stable")
        same = (seg[order[1:]] == seg[order[:-1]]) & (text[order[1:]] == text[order[:-1]])
        again = np.zeros(len(seg), bool)
        again[order[1:][same]] = True
        first = first + np.array(lo)[text]
        salt = np.where(again, 1 + SALTS + first % AGAIN, np.where(np.isin(anchor, often), 1 + seg % SALTS, 0))
        return pa.RecordBatch.from_arrays(
            [pa.array(anchor), pa.array(salt), pa.array(again), pa.array(seg),
             *(pa.array(np.array(x, np.int64)[text]) for x in (doc, tid)), pa.array(first << 11 | count)],
            ["anchor", "salt", "again", "seg", "doc_id", "tid", "at"])

    def rows(batches):
        held, n = [], 0  # texts that are cut together, and their words
        for b in batches:
            for doc, tid, text in zip(b.column("doc_id"), b.column("tid"), b.column("text"), strict=True):
                words = (text.as_py() or b"").split()
                if len(words) < window:
                    continue
                h = word_hashes(words)
                for lo in range(0, len(h) - window + 1, BLOCK):
                    held.append((doc.as_py(), tid.as_py(), lo, h[lo:lo + BLOCK + window - 1]))
                    n += len(held[-1][3])
                    if n >= TOGETHER:
                        yield cuts(held)
                        held, n = [], 0
        if held:
            yield cuts(held)

    return docs.mapInArrow(rows, "anchor long, salt long, again boolean, seg long, doc_id long, tid long, at long")


def repeats(cuts: DataFrame) -> DataFrame:
    """doc_id, tid and the marks of that text: segments that are repeats, or have to be searched
    (first: true); those of equal rows are one another's."""
    same = Window.partitionBy("anchor", "salt", "seg").orderBy("doc_id", "tid", "at")
    group = Window.partitionBy("anchor", "salt").orderBy("seg").rowsBetween(
        Window.unboundedPreceding, Window.unboundedFollowing)
    rows = cuts.repartition("anchor", "salt").withColumn("first", ~F.col("again") & (F.rank().over(same) == 1))
    rows = (rows.withColumn("others", (F.col("salt") > 0) | (F.min("seg").over(group) != F.max("seg").over(group)))
            .withColumn("n", F.count(F.when(F.col("first"), 1)).over(group)))
    rows = rows.filter(~F.col("first") | F.col("others"))
    split = (F.col("salt") > 0) | (F.col("n") > HOT)
    mark = F.struct("at", F.col("first"), F.when(split, F.lit(None)).otherwise(F.col("anchor")).alias("anchor"))
    return rows.groupBy("doc_id", "tid").agg(F.collect_set(mark).alias("marks"))


def marks_of(marks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """Row, at, first and anchor of each mark of the rows."""
    each = marks.flatten()
    return (np.repeat(np.arange(len(marks)), marks.value_lengths().fill_null(0).to_numpy()),
            each.field("at").to_numpy(), each.field("first").to_numpy(zero_copy_only=False), each.field("anchor"))


def stretches(row: np.ndarray, at: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, start and end of the stretches of words that the windows in ``at`` cover, in order."""
    start = row << _ROW | at >> 11
    order = np.argsort(start)
    end = np.maximum.accumulate((start + (at & 2047) + window - 1)[order])
    start = start[order]
    edge = np.flatnonzero(np.append(True, start[1:] > end[:-1])[:len(start)])
    start, end = start[edge], end[np.append(edge[1:], len(end))[:len(edge)] - 1]
    return start >> _ROW, start & ((1 << _ROW) - 1), end & ((1 << _ROW) - 1)


def to_search(marked: DataFrame, window: int) -> DataFrame:
    """key, doc_id, tid, at, words of the marked segments that are first of their kind."""

    def rows(batches):
        for b in batches:
            out = ([], [], [], [], [])
            row, at, first, anchor = marks_of(b.column(4))
            row, at, anchor = row[first], at[first], anchor.filter(pa.array(first)).to_pylist()
            edge = np.searchsorted(row, np.arange(b.num_rows + 1)).tolist()
            start, count = (at >> 11).tolist(), (at & 2047).tolist()
            docs, tids = b.column(1).to_pylist(), b.column(2).to_pylist()
            for i in np.unique(row).tolist():
                words = b.column(3)[i].as_py().split()
                for k in range(edge[i], edge[i + 1]):
                    if anchor[k] is not None:
                        parts = [(anchor[k], start[k], count[k])]
                    else:
                        h = word_hashes(words[start[k]:start[k] + count[k] + window - 1])
                        each = np.arange(count[k])
                        keys = span_hashes(h, each, each + window).view(np.int64).tolist()
                        parts = [(key, start[k] + j, 1) for j, key in enumerate(keys)]
                    for key, lo, n in parts:
                        for col, x in zip(out, (key, docs[i], tids[i], lo << 11 | n,
                                                b" ".join(words[lo:lo + n + window - 1])), strict=True):
                            col.append(x)
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(c, pa.int64()) for c in out[:4]), pa.array(out[4], pa.binary())],
                ["key", "doc_id", "tid", "at", "words"])

    # all columns of the texts' exchange, so that it is the same one as at the end
    return marked.select("given_id", "doc_id", "tid", "text", "marks").mapInArrow(
        rows, "key long, doc_id long, tid long, at long, words binary")


def search(rows: list[tuple], window: int) -> list[tuple]:
    """(row, doc_id, tid, at) of the windows of ``rows`` that also start earlier in them; at for one
    run of windows.  Rows (key, doc_id, tid, at, words) are in the order of key and document."""
    texts = [r[4].split() for r in rows]
    symbol: dict[bytes, int] = {}
    ids = [[symbol.setdefault(w, len(symbol) + 1) for w in t] + [0] for t in texts]
    text = np.concatenate([np.array(x, np.int64) for x in ids])
    begin = np.cumsum([0, *map(len, ids)])[:-1]
    counts = np.array([r[3] & 2047 for r in rows])
    owner = np.repeat(np.arange(len(rows)), counts)
    inside = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    found = FMIndex(text, window).earlier(text, begin[owner] + inside + window - 1, window)
    out = []
    hits, owners = np.flatnonzero(found), owner[found]
    if len(hits):
        edge = np.flatnonzero(np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (owners[1:] != owners[:-1])]))
        for i, n in zip(edge, np.diff(np.append(edge, len(hits))), strict=True):
            _, doc, tid, at, _ = rows[owners[i]]
            out.append((int(owners[i]), doc, tid, (at >> 11 << 11) + (int(inside[hits[i]]) << 11) | int(n)))
    return out


def searched(segs: DataFrame, window: int) -> DataFrame:
    """doc_id, tid, found: windows that the shards' indexes report."""

    def run(batches):
        held: list[tuple] = []
        kept = 0  # rows at the front that were reported before

        def report():
            hits = [h for h in search(held, window) if h[0] >= kept]
            return pa.RecordBatch.from_arrays(
                [pa.array([h[i] for h in hits], pa.int64()) for i in (1, 2, 3)], ["doc_id", "tid", "at"])

        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if held and held[-1][:4] == row[:4]:
                    continue  # a repeated row of one document
                held.append(row)
                if len(held) - kept >= CHUNK:
                    yield report()
                    seen: dict[bytes, tuple] = {}
                    for r in held:
                        if r[0] == row[0]:
                            seen.setdefault(r[4], r)
                    held = list(seen.values())
                    kept = len(held)
        if len(held) > kept:
            yield report()

    rows = segs.repartition("key").sortWithinPartitions("key", "doc_id", "tid", "at")
    found = rows.mapInArrow(run, "doc_id long, tid long, at long")
    return found.groupBy("doc_id", "tid").agg(F.collect_set("at").alias("found"))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, spans (start and words of each removed stretch) and kept_text of each row."""
    spark = docs.sparkSession
    named = F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("given_id"), named.alias("doc_id"),
                       F.xxhash64("text").alias("tid"),
                       F.col("text").cast("binary").alias("text"))
    path = scratch_path(spark, f"substring-{uuid.uuid4().hex}")
    repeats(cut(rows, window, frequent_anchors(rows, window))).write.parquet(path)
    marks = spark.read.parquet(path)
    marked = rows.join(marks, ["doc_id", "tid"], "left")
    found = searched(to_search(marked, window), window)
    both = marked.join(found, ["doc_id", "tid"], "left")

    def remove(batches):
        for b in batches:
            row, at, first, _ = marks_of(b.column(2))
            more = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().fill_null(0).to_numpy())
            owner, start, end = stretches(np.append(row[~first], more),
                                          np.append(at[~first], b.column(3).flatten().to_numpy()), window)
            edge = np.searchsorted(owner, np.arange(b.num_rows + 1))
            starts, ends, edges = start.tolist(), end.tolist(), edge.tolist()
            texts, sizes = [], []
            for i, text in enumerate(b.column(1)):
                words, kept, done = (text.as_py() or b"").split(), [], 0
                for k in range(edges[i], edges[i + 1]):
                    kept += words[done:starts[k]]
                    done = ends[k]
                texts.append(b" ".join(kept + words[done:] if done else words))
                sizes.append(len(words))
            spans = pa.ListArray.from_arrays(pa.array(edge, pa.int32()), pa.StructArray.from_arrays(
                [pa.array(start), pa.array(end - start)], ["start", "words"]))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(sizes, pa.int64()), spans,
                 pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "spans", "kept_text"])

    return both.select("given_id", "text", "marks", "found").mapInArrow(
        remove, "doc_id long, n_words long, spans array<struct<start: long, words: long>>, kept_text string")


def query(spark, sf_dir: str) -> DataFrame:
    rows = deduplicated(C.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["words"])
    return rows.select("doc_id", "n_words", removed.alias("n_removed"),
                       F.sha2("kept_text", 256).alias("kept_sha256"))


ORACLE = r"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM d),
k AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS h FROM w),
late AS (SELECT doc_id, i FROM (SELECT *, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM k) WHERE r > 1),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 20)) AS p FROM late) GROUP BY doc_id),
pos AS (SELECT doc_id, ws, coalesce(ps, []) AS ps FROM d LEFT JOIN gone USING (doc_id)),
kept AS (SELECT doc_id, p, ws[p] AS word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS p FROM d) ANTI JOIN (SELECT DISTINCT doc_id, unnest(ps) AS p FROM gone) USING (doc_id, p))
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - count(p) AS BIGINT) AS n_removed,
  sha256(coalesce(string_agg(word, ' ' ORDER BY p), '')) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) GROUP BY d.doc_id, ws
"""

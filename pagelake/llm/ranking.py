"""Ranked lexical search (operator 13): item tiles times document tiles by dense matrix products.

The items are taken in blocks.  A block's distinct terms are its compact vocabulary; its weights
are a dense matrix (terms x items).  One pass over all documents counts how many have terms, all
their terms and, for each term of the vocabulary, the documents that hold it.  A second pass
builds, for each tile of documents, the dense matrix of their impacts on the terms that occur
in the tile, and multiplies it with those rows of the weights in float64.  Impacts are below
10^6 and weights bounded by the corpus, so a product over ``tile_terms`` terms stays
below 2^53 and is exact; larger vocabularies are cut into such tiles, whose sums are added
as 64-bit integers.  Each task keeps the best ``k`` rows of each item, ties by id, which is safe
since a row that a task drops is behind k others; they are ranked first in groups of tasks, then
overall.

Bounds: a block has at most ``CELLS`` weights (or is one item), a task holds one block, one
batch of texts, one tile and k rows an item; what reaches the driver are the
terms of a block and a count for each.  Findings of a block are written to the shared folder
before the next one is begun, so one block is broadcast at a time.

Defined results: null and empty texts have no terms, match nothing and are not counted;
every row of documents and items stands for itself, repeated ones too; equal scores go by
ascending doc_id, null ids last; texts of any length are read whole; empty tables give no rows;
extra columns are not carried on.
"""

from __future__ import annotations

import math
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagelake.session import scratch_path

from . import common as C

K = 10
#: Weights (terms x items) of a block of items.
CELLS = 1 << 22
#: Documents and terms of a tile.
TILE_DOCS, TILE_TERMS = 256, 4096
#: Bytes of a text that are cut into words at once.
PIECE = 1 << 20
#: Groups of tasks whose best rows are ranked together before the overall ranking.
GROUPS = 1024
#: Fixed values of the score: a term's impact is EXACT * tf div (SCALE * tf + 8 * m), m = 100 - SLOPE + SLOPE * n * N div L.
EXACT, SCALE, SLOPE = 1_000_000_000, 1000, 90

_TERM = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def pieces(text: bytes | None):
    """Lists of a text's terms, in order, each from about ``PIECE`` bytes of it."""
    data, at = (text or b"").translate(_TERM), 0
    while at < len(data):
        end = data.find(b" ", at + PIECE)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


class Block:
    """Some items: their ids, the compact vocabulary of their terms, and which items hold a term."""

    def __init__(self):
        self.items: list[int | None] = []
        self.vocabulary: dict[bytes, int] = {}
        self.held: list[tuple[int, int]] = []

    def add(self, item_id, terms) -> None:
        self.held += [(self.vocabulary.setdefault(t, len(self.vocabulary)), len(self.items)) for t in terms]
        self.items.append(item_id)

    def cells_with(self, terms) -> int:
        return (len(self.items) + 1) * (len(self.vocabulary) + sum(t not in self.vocabulary for t in terms))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id and the distinct terms of each item that has any."""
    @F.arrow_udf("array<binary>")
    def distinct(text: pa.Array) -> pa.Array:
        return pa.array([sorted({t for piece in pieces(x.as_py()) for t in piece}) for x in text], pa.list_(pa.binary()))

    return (items.select("item_id", distinct(F.col("text").cast("binary")).alias("terms"))
            .where(F.size("terms") > 0))


def item_blocks(items: DataFrame, cells: int = CELLS):
    block = Block()
    for row in item_terms(items).toLocalIterator():
        terms = [bytes(t) for t in row["terms"]]
        if block.items and block.cells_with(terms) > cells:
            yield block
            block = Block()
        block.add(row["item_id"], terms)
    if block.items:
        yield block


def corpus_counts(docs: DataFrame, vocabulary: dict[bytes, int]) -> tuple[int, int, np.ndarray]:
    """Documents with terms, all their terms, and how many documents hold each term of the vocabulary."""
    def count(batches):
        held, n_docs, n_terms = np.zeros(len(vocabulary), np.int64), 0, 0
        for batch in batches:
            for text in batch["text"]:
                present, n = set(), 0
                for piece in pieces(text):
                    n += len(piece)
                    present.update(vocabulary.keys() & piece)
                n_docs, n_terms = n_docs + (n > 0), n_terms + n
                held[[vocabulary[t] for t in present]] += 1
        some = np.flatnonzero(held)
        yield pd.DataFrame({"term": [-2, -1, *some], "n": [n_docs, n_terms, *held[some]]})

    rows = (docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "term long, n long")
            .groupBy("term").agg(F.sum("n").alias("n")).collect())
    n = {r["term"]: r["n"] for r in rows}
    return n.get(-2, 0), n.get(-1, 0), np.array([n.get(t, 0) for t in range(len(vocabulary))], np.int64)


def term_weights(n_docs: int, held: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * h + 1))) for h in held.tolist()], np.int64)


def tile_terms(heaviest: int) -> int:
    """Terms whose weights times impacts (below EXACT / SCALE) add up to less than 2^53 for sure."""
    return max(1, min(TILE_TERMS, (2 ** 53 - 1) // max(1, heaviest * (EXACT // SCALE))))


class Tile:
    """Documents whose impacts are multiplied together."""

    def __init__(self, block: Block, weights: np.ndarray, n_docs: int, n_terms: int):
        self.vocabulary, self.n_items = block.vocabulary, len(block.items)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.width = tile_terms(int(weights.max(initial=1)))
        self.matrix = np.zeros((len(weights), self.n_items))
        terms, items = np.array(block.held, np.int64).reshape(-1, 2).T
        self.matrix[terms, items] = weights[terms]
        self.clear()

    def clear(self) -> None:
        self.ids, self.terms, self.docs, self.impacts = [], [], [], []

    def add(self, doc_id, text: bytes | None) -> None:
        """Take a document in, unless it holds no term of the vocabulary."""
        of, found, n = self.vocabulary.get, [], 0
        for piece in pieces(text):
            n += len(piece)
            found.append(np.array([t for t in map(of, piece) if t is not None], np.int64))
        if n == 0 or not any(map(len, found)):
            return
        terms, tf = np.unique(np.concatenate(found), return_counts=True)
        m = 100 - SLOPE + SLOPE * n * self.n_docs // self.n_terms
        self.terms.append(terms)
        self.impacts.append(EXACT * tf // (SCALE * tf + 8 * m))
        self.docs.append(np.full(len(terms), len(self.ids)))
        self.ids.append(doc_id)

    def scores(self) -> np.ndarray:
        """Exact scores (documents x items) of the documents taken in."""
        total = np.zeros((len(self.ids), self.n_items), np.int64)
        columns, place = np.unique(np.concatenate(self.terms), return_inverse=True)
        docs, impacts = np.concatenate(self.docs), np.concatenate(self.impacts)
        for low in range(0, len(columns), self.width):
            here = (place >= low) & (place < low + self.width)
            own = columns[low:low + self.width]
            tile = np.zeros((len(self.ids), len(own)))
            tile[docs[here], place[here] - low] = impacts[here]
            total += (tile @ self.matrix[own]).astype(np.int64)
        return total


class Best:
    """The best ``k`` (score, id) of each item so far; equal scores by id, null ids last."""

    def __init__(self, n_items: int, k: int):
        self.k, self.floor = k, np.ones(n_items, np.int64)
        self.item = self.score = self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    def take(self, scores: np.ndarray, ids: list) -> None:
        doc, item = np.nonzero(scores >= self.floor)
        if not len(doc):
            return
        null = np.array([i is None for i in ids])[doc]
        number = np.array([0 if i is None else i for i in ids], np.int64)[doc]
        item = np.concatenate([self.item, item])
        score = np.concatenate([self.score, scores[scores >= self.floor]])
        number, null = np.concatenate([self.id, number]), np.concatenate([self.null, null])
        order = np.lexsort((number, null, -score, item))
        item = item[order]
        first = np.searchsorted(item, item)
        rank = np.arange(len(item)) - first
        kept = order[rank < self.k]
        last = rank == self.k - 1
        self.floor[item[last]] = score[order[last]]
        self.item, self.score, self.id, self.null = item[rank < self.k], score[kept], number[kept], null[kept]


ROWS = "item int, item_id long, doc_id long, score long"


def block_ranks(docs: DataFrame, block: Block, n_docs: int, n_terms: int, held: np.ndarray, k: int):
    """The broadcast block, and the best k documents of each item of a block: item (its place in the block), item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((block, term_weights(n_docs, held)))

    def score(batches):
        of, weights = shared.value
        tile, best = Tile(of, weights, n_docs, n_terms), Best(len(of.items), k)

        def close():
            if tile.ids:
                best.take(tile.scores(), tile.ids)
                tile.clear()

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                tile.add(doc_id.as_py(), text.as_py())
                if len(tile.ids) == TILE_DOCS:
                    close()
        close()
        yield pa.RecordBatch.from_arrays([
            pa.array(best.item.astype(np.int32)), pa.array([of.items[i] for i in best.item], pa.int64()),
            pa.array(best.id, mask=best.null), pa.array(best.score)], names=["item", "item_id", "doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(score, ROWS)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    # two steps: no task ranks the rows of all tasks for one item
    rows = rows.withColumn("part", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    for keys in (["item", "part"], ["item"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= k)
    return shared, rows.select("item", "item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, items: DataFrame, k: int = K, cells: int = CELLS) -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents (doc_id, text) of each item (item_id, text)."""
    spark = docs.sparkSession
    base = scratch_path(spark, f"ranking-{uuid.uuid4().hex}")
    written = []
    for number, block in enumerate(item_blocks(items, cells)):
        n_docs, n_terms, held = corpus_counts(docs, block.vocabulary)
        shared, rows = block_ranks(docs, block, n_docs, n_terms, held, k)
        written.append(f"{base}/{number}")
        rows.write.parquet(written[-1])
        shared.destroy()
    names = ["item_id", "rank", "doc_id", "score"]
    if not written:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return spark.read.parquet(*written).select(*names)


def query(spark, sf_dir: str) -> DataFrame:
    return ranked(C.read_table(spark, sf_dir, "documents", "doc_id", "text"),
                  C.read_table(spark, sf_dir, "benchmark", "item_id", "text"))


_TERMS = ("regexp_extract_all(translate(coalesce({0}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), "
          "'[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')")
ORACLE = f"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS.format('d')} AS terms FROM documents d),
items AS (SELECT row_number() OVER () AS i, item_id, list_distinct({_TERMS.format('b')}) AS terms FROM benchmark b),
corpus AS (SELECT count(*) FILTER (len(terms) > 0) AS n, sum(len(terms))::BIGINT AS l FROM docs),
words AS (SELECT r, doc_id, len(terms) AS n, unnest(terms) AS term FROM docs),
tf AS (SELECT r, doc_id, n, term, count(*) AS tf FROM words GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
weights AS (SELECT i, item_id, term, floor(1000 * ln((2 * c.n + 2) / (2 * df + 1)))::BIGINT AS w
            FROM (SELECT i, item_id, unnest(terms) AS term FROM items) JOIN df USING (term), corpus c),
scores AS (
    SELECT i, item_id, r, doc_id,
           sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * tf.n * c.n) // c.l))))::BIGINT AS score
    FROM weights JOIN tf USING (term), corpus c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0
QUALIFY rank <= 10
"""

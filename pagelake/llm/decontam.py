"""Benchmark decontamination (operator 9): latent semantic retrieval, then alignment.

1. Document frequencies of hashed words are counted over all documents.
2. Items are cut into pieces of ``PIECE`` words at most, each judged like an
   item, and the pieces dealt into blocks of ``BLOCK_ITEMS``, so an item may span
   blocks.  A task for each block takes the sparse TF-IDF vectors of its pieces'
   passages (``PASSAGE`` words, a new one every ``ITEM_STEP``), finds their
   leading directions by a randomised SVD and folds the passages into that
   space.  If some passage keeps less than ``KEPT`` of its norm there, the block
   is halved, so that ``RANK`` suffices whatever the items are.
3. Documents are cut into passages (a new one every ``STEP`` words, the last
   one ending with the text).  A passage of which words of the benchmark make
   up at least ``MASS`` of the squared weight is folded into the space and
   compared with all passages of the block; pairs of a cosine of ``CUT`` or
   more are candidates.  The cosine divides by the passage's full length, not
   by that of its image, so passages about other things stay below.
4. Of each candidate, the longest common subsequence of the item and the part
   of the document around the passage is found, and how many of the words of
   the item's last sentence, its answer, that part holds.  A document is
   contaminated by the item if the subsequence makes up ``LCS_SHARE`` of the
   item, or ``PARAPHRASE_SHARE`` of it and ``ANSWER_SHARE`` of the answer.  It
   also is if the part holds, in order, ``EXCERPT_SHARE`` of the item's passage
   that came near, so that an excerpt counts however long the item is.
5. Every run of ``RUN`` words of an item, or the whole item if it is shorter,
   is also looked up exactly, by rolling hashes of its words, whatever these
   words weigh; the words are compared after that, and a document that holds
   one is contaminated.

The frequencies have ``HASHED`` slots.  A block has at most ``BLOCK_ITEMS`` x
``PIECE`` words and its factors ``RANK`` columns, and blocks go to the tasks
``AT_ONCE`` at a time, so what is broadcast has a bound whatever the benchmark's
size and its items' lengths are; a larger benchmark takes more passes.  The
products of one block's SVD are made in one task.  Documents' texts are never
shuffled.

Defined results: null and empty texts match nothing, and items without words
are matched by nothing; a text or item shorter than a passage is one passage;
rows with the same id give one result for the id; items with the same id are
looked up each, their results joined; a null id is a document like any other;
a pair found by exact look-up alone has the cosine 1; of an excerpt the shares
are those of the whole item, and may be small; of an item of several pieces
they are those of the piece that the text holds best;
empty tables give no rows; extra columns are not carried on.
"""

from __future__ import annotations

import pickle
import re
import zlib
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.operators.order import global_rank

from . import common as C
from .licenses import words_of as ascii_words

HASHED = 1 << 16
PASSAGE = 16
STEP = 8
ITEM_STEP = 4
RANK = 384
OVERSAMPLE = 16
KEPT = 0.7
PIECE = 128
BLOCK_ITEMS = 200
AT_ONCE = 8
MASS = 0.5
CUT = 0.4
LCS_SHARE = 0.6
PARAPHRASE_SHARE = 0.4
ANSWER_SHARE = 0.8
EXCERPT_SHARE = 0.8
RUN = 13
#: Documents whose passages are compared at once.
TOGETHER = 128
#: Of the rolling hashes of runs: the base, and the bits that a first look takes.
BASE = np.uint64(0x9E3779B97F4A7C15)
LOOK_BITS = 20


def words_of(text: bytes | None) -> list[bytes]:
    """Words in lower case, of any script."""
    return ascii_words((text or b"").decode("utf-8", "replace").lower().encode())


def coded(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(zlib.crc32, words), dtype=np.int64, count=len(words))


def hashed(words: list[bytes]) -> np.ndarray:
    return coded(words) & (HASHED - 1)


def starts(n: int, step: int) -> np.ndarray:
    """Where passages of a text of n words begin; the last one ends with the text."""
    if n <= PASSAGE:
        return np.zeros(min(n, 1), np.int64)
    at = np.arange(0, n - PASSAGE + 1, step)
    return at if at[-1] == n - PASSAGE else np.append(at, n - PASSAGE)


def passages(ids: list[np.ndarray], step: int):
    """(passage's words, each once, padded with HASHED; its text; its start)."""
    begin = [starts(len(x), step) for x in ids]
    owner = np.repeat(np.arange(len(ids)), [len(b) for b in begin])
    start = np.concatenate([np.zeros(0, np.int64), *begin])
    offset = np.cumsum([0, *(len(x) + PASSAGE for x in ids)])[:-1]
    flat = np.concatenate([x for i in ids for x in (i, np.full(PASSAGE, HASHED))] or [np.zeros(0, np.int64)])
    return flat, offset[owner] + start, owner, start


def once(flat: np.ndarray, at: np.ndarray) -> np.ndarray:
    rows = np.sort(flat[at[:, None] + np.arange(PASSAGE)], axis=1)
    rows[:, 1:][rows[:, 1:] == rows[:, :-1]] = HASHED
    return rows


def word_weights(docs: DataFrame) -> np.ndarray:
    """IDF of each slot over all documents; the slot HASHED, for padding, weighs nothing."""

    def count(batches):
        seen, n = np.zeros(HASHED, np.int64), 0
        for b in batches:
            for text in b.column("text"):
                seen[np.unique(hashed(words_of(text.as_py())))] += 1
                n += 1
        slots = np.flatnonzero(seen)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(np.append(slots, -1)), "n": pa.array(np.append(seen[slots], n))})

    rows = (docs.select(F.col("text").cast("binary").alias("text")).mapInArrow(count, "slot long, n long")
            .groupBy("slot").agg(F.sum("n").alias("n")).collect())
    df, total = np.zeros(HASHED), 0
    for slot, n in rows:
        if slot < 0:
            total = n
        else:
            df[slot] = n
    return np.append(np.log((1 + total) / (1 + df)) + 1e-3, 0).astype(np.float32)


class Sparse:
    """A matrix of at most as many entries a row as ``slot`` has columns; multiplies dense ones."""

    def __init__(self, slot: np.ndarray, weight: np.ndarray, width: int):
        self.slot, self.weight, self.shape = slot, weight, (len(slot), width)

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((len(self.slot), q.shape[1]))
        for i in range(self.slot.shape[1]):
            out += self.weight[:, i, None] * q[self.slot[:, i]]
        return out

    @property
    def T(self):  # noqa: N802
        return Transposed(self)


class Transposed:
    def __init__(self, a: Sparse):
        self.shape = a.shape[::-1]
        row, column = np.nonzero(a.weight)
        slot = a.slot[row, column]
        order = np.argsort(slot, kind="stable")
        self.row, self.slot, self.weight = row[order], slot[order], a.weight[row, column][order]

    def __matmul__(self, q: np.ndarray) -> np.ndarray:
        out = np.zeros((self.shape[0], q.shape[1]))
        for lo in range(0, len(self.slot), 8192):
            slot = self.slot[lo:lo + 8192]
            first = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
            terms = self.weight[lo:lo + 8192, None] * q[self.row[lo:lo + 8192]]
            out[slot[first]] += np.add.reduceat(terms, first, axis=0)
        return out


def randomised_svd(a: np.ndarray | Sparse, rank: int, seed: int = 0) -> np.ndarray:
    """Leading right singular vectors of ``a``, as columns."""
    k, across = min(rank + OVERSAMPLE, *a.shape), a.T
    q = np.random.default_rng(seed).normal(size=(a.shape[0], k))
    for _ in range(3):
        q = np.linalg.qr(across @ q)[0]  # columns span the rows of a
        q = np.linalg.qr(a @ q)[0]
    return np.linalg.svd((across @ q).T, full_matrices=False)[2][:rank].T


def answer_words(text: str) -> list[bytes]:
    """Distinct words of the last sentence."""
    for part in reversed(re.split(r"[.?!\n]", text)):
        if words := words_of(part.encode()):
            return list(dict.fromkeys(words))
    return []


class Piece(NamedTuple):
    """Some words of an item."""

    item_id: int | None
    words: list[bytes]  # and, after the piece's own, as many more as a run that begins in it takes
    own: int
    at: int  # where the piece begins in the item
    total: int  # words of the item
    answer: list[bytes]


def pieces_of(item_id: int | None, text: str) -> list[Piece]:
    """An item in pieces of about the same length."""
    words, answer = words_of(text.encode()), answer_words(text)
    n = -(-len(words) // PIECE)
    cuts = [len(words) * i // n for i in range(n + 1)] if n else []
    return [Piece(item_id, words[lo:hi + RUN - 1], hi - lo, lo, len(words), answer) for lo, hi in zip(cuts, cuts[1:], strict=False)]


def latent_block(items: list[tuple[int | None, str]], idf: np.ndarray) -> dict:
    """The space of (item_id, text) and their passages in it."""
    return latent_space([p for i, t in items for p in pieces_of(i, t)], idf)[0]


def latent_space(pieces: list[Piece], idf: np.ndarray) -> tuple[dict, float]:
    """The space of some pieces with their passages in it, and the least share of a norm that it keeps."""
    flat, at, owner, start = passages([hashed(p.words[:p.own]) for p in pieces], ITEM_STEP)
    rows = once(flat, at)
    vocabulary = np.unique(rows[rows < HASHED])
    weight = np.where(rows < HASHED, idf[rows], 0).astype(np.float64)
    weight /= np.linalg.norm(weight, axis=1, keepdims=True)
    slot = np.minimum(np.searchsorted(vocabulary, rows), len(vocabulary) - 1)
    # a piece counts once, however many passages it has
    even = weight / np.sqrt(np.bincount(owner)[owner])[:, None]
    v = randomised_svd(Sparse(slot, even, len(vocabulary)), RANK)
    image = Sparse(slot, weight, len(vocabulary)) @ v
    kept = np.linalg.norm(image, axis=1, keepdims=True)
    image /= np.maximum(kept, 1e-9)
    return {"pieces": pieces, "vocabulary": vocabulary, "v": v.astype(np.float32), "image": image.astype(np.float32),
            "owner": owner, "start": start}, float(kept.min())


def latent_spaces(pieces: list[Piece], idf: np.ndarray) -> list[dict]:
    """Spaces of some pieces, as many as it takes to keep ``KEPT`` of each passage."""
    space, kept = latent_space(pieces, idf)
    if kept >= KEPT or len(pieces) == 1:
        return [space]
    half = len(pieces) // 2
    return latent_spaces(pieces[:half], idf) + latent_spaces(pieces[half:], idf)


def latent_blocks(items: DataFrame, idf: np.ndarray) -> DataFrame:
    """One row a space: its number and the space (pickled); a task holds one block."""
    shared = items.sparkSession.sparkContext.broadcast(idf)

    def cut(batches):
        for b in batches:
            rows = [(i, b" ".join(p.words), p.own, p.at, p.total, b" ".join(p.answer))
                    for i, t in zip(b.column("item_id").to_pylist(), b.column("text").to_pylist(), strict=True)
                    for p in pieces_of(None, t)]
            kinds = [pa.string(), pa.binary(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)],
                                             ["item_id", "words", "own", "at", "total", "answer"])

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        names = ["item_id", "words", "own", "at", "total", "answer"]
        pieces = [Piece(None if pd.isna(i) else int(i), bytes(w).split(), own, at, total, bytes(a).split())
                  for i, w, own, at, total, a in zip(*(rows[n].tolist() for n in names), strict=True)]
        pieces.sort(key=lambda p: (p.item_id is not None, p.item_id or 0, p.at, p.words))
        made = [pickle.dumps(s) for s in latent_spaces(pieces, shared.value)]
        return pd.DataFrame({"block": rows["block"].iloc[:1].repeat(len(made)), "part": range(len(made)), "space": made})

    # ids go as texts: a null among them would make the others floating-point numbers
    rows = items.filter("text IS NOT NULL").select(F.col("item_id").cast("long").cast("string").alias("item_id"), "text")
    rows = rows.mapInArrow(cut, "item_id string, words binary, own int, at int, total int, answer binary")
    rows = global_rank(rows, F.xxhash64("words"), F.col("item_id"), F.col("at"))
    rows = rows.withColumn("block", F.floor((F.col("rank") - 1) / BLOCK_ITEMS).cast("int"))
    made = rows.groupBy("block").applyInPandas(build, "block int, part int, space binary")
    return made.select((F.col("block").cast("long") * BLOCK_ITEMS + F.col("part")).alias("block"), "space")


def lcs(item: list[bytes], text: list[bytes]) -> int:
    """Length of the longest common subsequence, a bit for each word of the item."""
    where: dict[bytes, int] = {}
    for i, w in enumerate(item):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(item)) - 1
    v = full
    for w in text:
        u = v & where.get(w, 0)
        v = (v + u | v - u) & full
    return len(item) - v.bit_count()


def candidates(block: dict, table: np.ndarray, idf: np.ndarray, ids: list[np.ndarray], mass: float, cut: float):
    """(text, item, where the item would begin, cosine) of the passages that come near."""
    for text, q, at, cosine in near_passages(block, table, idf, ids, mass, cut):
        yield text, block["owner"][q], at - block["start"][q], cosine


def near_passages(block: dict, table: np.ndarray, idf: np.ndarray, ids: list[np.ndarray], mass: float, cut: float):
    """(text, passage of the block, where the text's passage begins, cosine) of those that come near."""
    flat, at, owner, start = passages(ids, STEP)
    square = idf ** 2
    whole = np.concatenate([[0], np.cumsum(square[flat], dtype=np.float64)])
    known = np.concatenate([[0], np.cumsum(np.where(table[flat] >= 0, square[flat], 0), dtype=np.float64)])
    end = at + PASSAGE
    near = np.flatnonzero(known[end] - known[at] >= mass * (whole[end] - whole[at]) - 1e-6)
    for lo in range(0, len(near), 2048):
        pick = near[lo:lo + 2048]
        rows = once(flat, at[pick])
        weight = idf[rows]
        image = np.zeros((len(rows), block["v"].shape[1]), np.float32)
        for i in range(PASSAGE):
            slot = table[rows[:, i]]
            image += np.where(slot >= 0, weight[:, i], 0)[:, None] * block["v"][np.maximum(slot, 0)]
        image /= np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-9)
        cosine = image @ block["image"].T
        for p, q in zip(*np.nonzero(cosine >= cut), strict=True):
            k = pick[p]
            yield owner[k], q, start[k], float(cosine[p, q])


def runs_of(item: list[bytes]) -> list[tuple[int, int]]:
    """(start, length) of the runs of an item's words that are looked up exactly."""
    n = min(RUN, len(item))
    return [(i, n) for i in range(len(item) - n + 1)]


def rolling(codes: np.ndarray, most: int):
    """(length, hashes of all runs of so many words), for lengths up to ``most``."""
    h = np.zeros(len(codes), np.uint64)
    for length in range(1, min(most, len(codes)) + 1):
        h = h[:len(codes) - length + 1] * BASE + codes[length - 1:]
        yield length, h


class Runs:
    """Finds runs of items word for word."""

    def __init__(self, items: list[list[bytes]]):
        self.items, found = items, {}
        for i, item in enumerate(items):
            runs = runs_of(item)
            of_length = dict(rolling(coded(item).astype(np.uint64), max((n for _, n in runs), default=0)))
            for start, n in runs:
                found.setdefault(n, []).append((int(of_length[n][start]), i, start))
        self.tables = {}
        for n, rows in found.items():
            rows.sort()
            keys = np.array([k for k, _, _ in rows], np.uint64)
            seen = np.zeros(1 << LOOK_BITS, bool)
            seen[self.short(keys)] = True
            self.tables[n] = (keys, seen, [(i, start) for _, i, start in rows])

    @staticmethod
    def short(hashes: np.ndarray) -> np.ndarray:
        return (hashes * BASE) >> np.uint64(64 - LOOK_BITS)

    def found(self, words: list[list[bytes]], codes: list[np.ndarray]):
        """(text, item, where the item would begin) once for each text that holds a run of an item."""
        flat = np.concatenate([np.zeros(0, np.int64), *codes]).astype(np.uint64)
        end = np.cumsum([len(c) for c in codes])
        done = set()
        for n, h in rolling(flat, max(self.tables, default=0)):
            if n not in self.tables:
                continue
            keys, seen, places = self.tables[n]
            near = np.flatnonzero(seen[self.short(h)])
            lo, hi = (np.searchsorted(keys, h[near], side) for side in ("left", "right"))
            hit = np.flatnonzero(hi > lo)
            texts = np.searchsorted(end, near[hit], "right")
            for k, text in zip(hit.tolist(), texts.tolist(), strict=True):
                at = int(near[k]) - int(end[text]) + len(words[text])
                for item, start in places[lo[k]:hi[k]]:
                    if (text, item) not in done and words[text][at:at + n] == self.items[item][start:start + n]:
                        done.add((text, item))
                        yield text, item, at - start


def around(words: list[bytes], begin: int, n: int) -> list[bytes]:
    """The part of a text where n words would begin at ``begin``, with some slack."""
    slack = STEP + n // 4
    return words[max(0, begin - slack):max(0, begin + n + slack)]


def aligned(words: list[bytes], piece: Piece, begin: int) -> tuple[float, float]:
    """Shares of the piece, around ``begin``, and of the answer, around the item, that the text holds."""
    share = lcs(piece.words[:piece.own], around(words, begin, piece.own)) / piece.own
    have = set(around(words, begin - piece.at, piece.total))
    return share, sum(w in have for w in piece.answer) / max(1, len(piece.answer))


def excerpt(words: list[bytes], passage: list[bytes], begin: int) -> bool:
    """Whether the text holds the passage of an item around ``begin``, in order."""
    return lcs(passage, around(words, begin, len(passage))) >= EXCERPT_SHARE * len(passage)


class Retrieval:
    """Looks texts up in some blocks' spaces; made once for each task."""

    def __init__(self, spaces: list[dict], idf: np.ndarray, mass: float, cut: float):
        self.idf, self.mass, self.cut = idf, mass, cut
        self.spaces = []
        for s in spaces:
            table = np.full(HASHED + 1, -1, np.int64)
            table[s["vocabulary"]] = np.arange(len(s["vocabulary"]))
            self.spaces.append((s, table))
        self.pieces = [p for s in spaces for p in s["pieces"]]
        self.runs = Runs([p.words for p in self.pieces])

    def found(self, texts: list[bytes | None]):
        """(text, item_id, cosine or None, lcs_share, answer_share, whether an excerpt stands there) of all candidates."""
        words = [words_of(t) for t in texts]
        codes = [coded(w) for w in words]
        for text, run, begin in self.runs.found(words, codes):
            piece = self.pieces[run]
            yield text, piece.item_id, None, *aligned(words[text], piece, begin), True
        ids = [c & (HASHED - 1) for c in codes]
        for s, table in self.spaces:
            tried = {}
            for text, q, at, cosine in near_passages(s, table, self.idf, ids, self.mass, self.cut):
                item, begin = s["owner"][q], s["start"][q]
                piece = s["pieces"][item]
                held = excerpt(words[text], piece.words[begin:min(begin + PASSAGE, piece.own)], at)
                if (text, item, at - begin) not in tried:
                    tried[text, item, at - begin] = aligned(words[text], piece, at - begin)
                elif not held:
                    continue
                yield int(text), piece.item_id, cosine, *tried[text, item, at - begin], held


def holds(lcs_share, answer_share, held):
    """Whether the shares, or an excerpt, tell that a text holds an item; for numbers and columns."""
    return held | (lcs_share >= LCS_SHARE) | ((lcs_share >= PARAPHRASE_SHARE) & (answer_share >= ANSWER_SHARE))


def near_items(docs: DataFrame, spaces: list[dict], idf: np.ndarray, mass: float = MASS, cut: float = CUT) -> DataFrame:
    """doc_id, item_id, cosine, lcs_share, answer_share, held of the candidates in ``spaces``."""
    shared = docs.sparkSession.sparkContext.broadcast((spaces, idf))
    names = ["doc_id", "item_id", "cosine", "lcs_share", "answer_share", "held"]

    def search(batches):
        look = Retrieval(*shared.value, mass, cut)
        for b in batches:
            for lo in range(0, len(b), TOGETHER):
                part = b.slice(lo, TOGETHER)
                ids = part.column("doc_id").to_pylist()
                rows = [(ids[t], *rest) for t, *rest in look.found(part.column("text").to_pylist())]
                kinds = [pa.int64()] * 2 + [pa.float64()] * 3 + [pa.bool_()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], kind) for j, kind in enumerate(kinds)], names)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    return rows.mapInArrow(search, "doc_id long, item_id long, cosine double, lcs_share double, answer_share double, held boolean")


def spaces_at_once(items: DataFrame, idf: np.ndarray):
    """The spaces of ``AT_ONCE`` blocks after the other."""
    blocks = C.materialised(latent_blocks(items, idf))
    numbers = sorted(r["block"] for r in blocks.select("block").collect())
    for at in range(0, len(numbers), AT_ONCE):
        rows = blocks.filter(F.col("block").isin(numbers[at:at + AT_ONCE])).orderBy("block").collect()
        yield [pickle.loads(r["space"]) for r in rows]


def contaminated(docs: DataFrame, items: DataFrame, mass: float = MASS, cut: float = CUT) -> DataFrame:
    """One row for each document and each item that it holds, with the shares found."""
    idf = word_weights(docs)
    found = None
    for spaces in spaces_at_once(items, idf):
        some = near_items(docs, spaces, idf, mass, cut)
        found = some if found is None else found.unionByName(some)
    if found is None:
        found = near_items(docs, [], idf).limit(0)
    found = found.filter(holds(F.col("lcs_share"), F.col("answer_share"), F.col("held"))).groupBy("doc_id", "item_id").agg(
        *(F.round(F.max(c), 6).alias(c) for c in ("cosine", "lcs_share", "answer_share")))
    return found.withColumn("cosine", F.coalesce("cosine", F.lit(1.0)))


def cleaner(shared, mass: float, cut: float):
    """A column function: whether a text holds none of the items of the broadcast spaces."""

    @F.arrow_udf("boolean")
    def clean(text: pa.Array) -> pa.Array:
        look = Retrieval(*shared.value, mass, cut)
        out = np.ones(len(text), bool)
        for lo in range(0, len(text), TOGETHER):
            for t, _, _, share, answer, held in look.found(text.slice(lo, TOGETHER).to_pylist()):
                if holds(share, answer, held):
                    out[lo + t] = False
        return pa.array(out)

    return clean


def clean_documents(docs: DataFrame, items: DataFrame, mass: float = MASS, cut: float = CUT) -> DataFrame:
    """The rows of ``docs`` that hold no item, all their columns as they are; no text moves."""
    idf = word_weights(docs)
    for spaces in spaces_at_once(items, idf):
        shared = docs.sparkSession.sparkContext.broadcast((spaces, idf))
        docs = docs.filter(cleaner(shared, mass, cut)(F.col("text").cast("binary")))
    return docs


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    return contaminated(docs, C.read_table(spark, sf_dir, "benchmark", "item_id", "text"))

"""Cross-tokenizer alignment (operator 11): common token ends of two tokenizers, by galloping.

A document is encoded twice, by a byte-level BPE (A) and a piece model with byte fallback (B),
both over the bytes of a space and the text.  The ends of the tokens are two rising lists of
byte offsets.  Each end of the shorter list looks for itself in the longer one: from a
place by its rank, in steps that double, then by halving the bracket found (``gallop``, for all
ends at once).  Ends that both lists have cut the tokens into groups: their indices slice
both lists, and the differences of successive indices are the numbers of a group's tokens.
Tokens that end together are linked.

*Encoding.*  Texts are cut at spaces that begin a word (after a visible character, before a
letter): A's pattern begins a match there, and no piece of B goes on behind a space mark, so
the parts are encoded as they would be within the text.  The parts, mostly words, repeat, so a
task encodes each only once while it remembers it, many new ones joined to one text.  Where a
vocabulary does not warrant this (``cuts``), texts are encoded whole.

*Counts.*  A linked pair ends together, so the bytes of one of its tokens end with those of the other.
These pairs can be listed from the vocabularies alone (``possible``), at most one for each byte
of both vocabularies' tokens and further tokens of equal bytes, so a corpus-wide count is one
vector of that length, whatever the corpus is.  Each document's links are written once, as numbers in
that list; the counts are summed over these, sent to the tasks, and a last pass over the links
finds each document's figures.  Texts are read and encoded once and never exchanged.

Bounds: the two vocabulary files and the count vector are broadcast, the count vector is
collected; a task holds some megabytes of texts or a single one with its tokens, and at most
``REMEMBERED`` parts with ``TOKENS`` tokens beside those of one such batch.  The files are read where the driver runs, so tasks need no path.

Defined results: a null or empty text, or one whose tokens' joined bytes differ from the space and the
text, has no tokens: all figures are 0 and the digest is ''.  Every row stands for itself,
repeated rows and ids too, and counts in the corpus-wide counts.  Ties for a token's highest
count all count as best.  Texts of any length are encoded whole.  An empty table gives no
rows; extra columns are not carried on.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import uuid
from itertools import groupby

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelake.session import scratch_path

from . import common as C

#: Folder of the vocabulary files, and their names.
VOCABULARIES, FILE_A, FILE_B = "/opt/tokenizers", "byte_bpe_50k.json", "piece_bpe_32k.model"
#: Characters of texts that are encoded together, and parts and tokens that a task remembers.
TOGETHER, REMEMBERED, TOKENS = 1 << 21, 400_000, 1 << 22
#: Characters of parts that are encoded as one text, and tokens whose digest text is joined, at once.
JOINED, WRITTEN = 1 << 10, 1 << 18
MARK = "▁"

#: Characters before and after a space that begins a word; such a space, and a part between two of them.
_BEFORE, _AFTER = "[!-~À-ÖØ-öø-ÿ]", "[A-Za-zÀ-ÖØ-öø-ÿ]"
_CUT = re.compile(f"(?<={_BEFORE}) (?={_AFTER})")
_INNER = re.compile(f"{_AFTER}(?:.*{_BEFORE})?", re.S)


def ragged(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The slices of ``flat`` of these starts and sizes, one after the other."""
    ends = np.cumsum(sizes)
    return flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)]


def letter_bytes() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones for
    themselves, the others in order from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in visible]
    return {**{chr(b): b for b in visible}, **{chr(256 + i): b for i, b in enumerate(hidden)}}


def gallop(ends: np.ndarray, among: np.ndarray) -> np.ndarray:
    """For each of ``ends`` the first place in the rising list ``among`` that is not below it."""
    n = len(among)
    at = np.arange(len(ends)) * n // max(1, len(ends))
    up = among[at] < ends
    # bracket: what stands at ``low`` is below the end, what stands at ``high`` is not
    low, high = np.where(up, at, -1), np.where(up, n, at)
    todo, step = np.arange(len(ends)), 1
    while len(todo):
        here = up[todo]
        probe = np.where(here, at[todo] + step, at[todo] - step)
        inside = (probe >= 0) & (probe < n)
        todo, probe, here = todo[inside], probe[inside], here[inside]
        below = among[probe] < ends[todo]
        low[todo[below]] = probe[below]
        high[todo[~below]] = probe[~below]
        todo = todo[below == here]
        step *= 2
    while True:
        todo = np.flatnonzero(high - low > 1)
        if not len(todo):
            return high
        middle = (low[todo] + high[todo]) // 2
        below = among[middle] < ends[todo]
        low[todo[below]] = middle[below]
        high[todo[~below]] = middle[~below]


def common_ends(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The indices in both rising lists of the values that both have."""
    if len(a) > len(b):
        at_b, at_a = common_ends(b, a)
        return at_a, at_b
    if not len(a):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    place = gallop(a, b)
    hit = (place < len(b)) & (b[np.minimum(place, len(b) - 1)] == a)
    return np.flatnonzero(hit), place[hit]


class Aligner:
    """Both tokenizers, the bytes of their tokens and the list of pairs that can be linked."""

    def __init__(self, json_a: str, model_b: bytes):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_str(json_a)
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=model_b)
        spec, code = json.loads(json_a), letter_bytes()
        tokens = {i: t for t, i in spec["model"]["vocab"].items()}
        self.bytes_a = [bytes(code[c] for c in tokens[i]) if i in tokens and all(c in code for c in tokens[i]) else b""
                        for i in range(self.a.get_vocab_size())]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [b"" if self.b.is_control(i) or self.b.is_unknown(i) else
                        bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(MARK, " ").encode()
                        for i, p in enumerate(pieces)]
        first = spec.get("pre_tokenizer") or {}
        self.cuts = (spec.get("normalizer") is None and first.get("type") == "ByteLevel" and first.get("use_regex", True)
                     and not first.get("add_prefix_space") and not any(MARK in p.lstrip(MARK) for p in pieces))
        self.length_a = np.array([len(x) for x in self.bytes_a])
        self.length_b = np.array([len(x) for x in self.bytes_b])
        self.pairs = self.possible()
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        self.signs = np.array([b"%d%s" % (i, s) for n, both in ((n_a, b",|"), (n_b, b",;")) for s in (both[:1], both[1:])
                               for i in range(n)])
        # known parts by number: their ids (A, B) in a row, whether their bytes are the part's, how often they were used
        self.known: dict[str, int] = {}
        self.flat, self.size = [np.zeros(0, np.int64)] * 2, [np.zeros(0, np.int64)] * 2
        self.right, self.used = np.zeros(0, bool), np.zeros(0, np.int64)

    def possible(self) -> np.ndarray:
        """All pairs of which one token's bytes end with the other's, as rising numbers a * size of B + b."""
        ids: list[dict[bytes, list[int]]] = []
        for tokens in (self.bytes_a, self.bytes_b):
            ids.append({})
            for i, x in enumerate(tokens):
                if x:
                    ids[-1].setdefault(x, []).append(i)
        found, n = set(), len(self.bytes_b)
        for x, own in ids[0].items():
            found.update(i * n + j for k in range(len(x)) for j in ids[1].get(x[k:], ()) for i in own)
        for x, own in ids[1].items():
            found.update(i * n + j for k in range(1, len(x)) for i in ids[0].get(x[k:], ()) for j in own)
        return np.array(sorted(found), np.int64)

    def parts(self, text: str) -> list[str]:
        return _CUT.split(text) if self.cuts else [text]

    def forget(self) -> None:
        """Forget the half of the parts that were used least."""
        kept = np.sort(np.argsort(-self.used, kind="stable")[:len(self.used) // 2])
        names = list(self.known)
        self.known = {names[i]: k for k, i in enumerate(kept.tolist())}
        for side in (0, 1):
            size = self.size[side]
            self.flat[side] = ragged(self.flat[side], (np.cumsum(size) - size)[kept], size[kept])
            self.size[side] = size[kept]
        self.right, self.used = self.right[kept], (self.used[kept] + 1) // 2

    def _encode(self, texts: list[str]):
        """A's and B's ids of a space and each text, as one array a side, and whether all have the text's bytes."""
        a = [e.ids for e in self.a.encode_batch([" " + t for t in texts], add_special_tokens=False)]
        both = a, self.b.encode(texts, num_threads=1)
        right = [all(b"".join(map(of.__getitem__, ids)) == want for of, ids in ((self.bytes_a, x), (self.bytes_b, y)))
                 for x, y, want in zip(*both, ((" " + t).encode() for t in texts))]
        return both, right

    def learn(self, parts: list[str]) -> None:
        """Encode new parts: many that stand between spaces at which texts are cut as one text, others alone."""
        inner = [p for p in parts if self.cuts and _INNER.fullmatch(p)]
        number = np.cumsum([len(p) + 1 for p in inner]) // JOINED
        groups = [[p for _, p in g] for _, g in groupby(zip(number.tolist(), inner), key=lambda x: x[0])]
        both, right = self._encode([" ".join(g) for g in groups])
        groups = [g for g, ok in zip(groups, right) if ok]
        ends = np.cumsum([len(p.encode()) + 1 for g in groups for p in g])
        flat, size = [], []
        for side, length in ((0, self.length_a), (1, self.length_b)):
            ids = np.array([i for ids, ok in zip(both[side], right) if ok for i in ids], np.int64)
            flat.append([ids])
            size.append([np.diff(np.searchsorted(np.cumsum(length[ids]), ends) + 1, prepend=0)])
        joined = dict.fromkeys(p for g in groups for p in g)
        alone = [p for p in parts if p not in joined]
        own, ok = self._encode(alone)
        for side in (0, 1):
            self.flat[side] = np.concatenate([self.flat[side], *flat[side], *[np.array(x, np.int64) for x in own[side]]])
            self.size[side] = np.concatenate([self.size[side], *size[side], np.array([len(x) for x in own[side]], np.int64)])
        for p in [*joined, *alone]:
            self.known[p] = len(self.known)
        self.right = np.concatenate([self.right, np.ones(len(joined), bool), np.array(ok, bool)])
        self.used = np.concatenate([self.used, np.zeros(len(joined) + len(alone), np.int64)])

    def tokens(self, texts: list[str | None]):
        """(A's ids, B's ids) of each text as arrays, empty where the text has no tokens."""
        while self.known and (len(self.known) > REMEMBERED or sum(map(len, self.flat)) > TOKENS):
            self.forget()
        cut = [self.parts(t) if t else [] for t in texts]
        new = dict.fromkeys(p for ps in cut for p in ps if p not in self.known)
        if new:
            self.learn(list(new))
        start = [np.cumsum(size) - size for size in self.size]
        for ps in cut:
            at = np.fromiter(map(self.known.__getitem__, ps), np.int64, len(ps))
            np.add.at(self.used, at, 1)
            at = at if self.right[at].all() else at[:0]
            yield tuple(ragged(self.flat[side], start[side][at], self.size[side][at]) for side in (0, 1))

    def ends(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the tokens of both lists that end a group."""
        return common_ends(np.cumsum(self.length_a[a]), np.cumsum(self.length_b[b]))

    def links(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        """Places of the linked pairs in the list of pairs that can be linked, rising."""
        return np.searchsorted(self.pairs, np.sort(a[at_a] * len(self.bytes_b) + b[at_b]))

    def digest(self, a: np.ndarray, b: np.ndarray, at_a: np.ndarray, at_b: np.ndarray) -> str:
        """SHA-256 of the groups as text: A's ids, a bar, B's ids; groups apart by semicolons."""
        if not len(a):
            return ""
        n_a, n_b = len(self.bytes_a), len(self.bytes_b)
        size_a, size_b = np.diff(at_a, prepend=-1), np.diff(at_b, prepend=-1)
        place_a = np.arange(len(a)) + np.repeat(np.concatenate([[0], at_b[:-1] + 1]), size_a)
        place_b = np.arange(len(b)) + np.repeat(at_a + 1, size_b)
        sign = np.empty(len(a) + len(b), np.int64)
        sign[place_a], sign[place_b] = a, b + 2 * n_a
        sign[place_a[at_a]] += n_a
        sign[place_b[at_b[:-1]]] += n_b
        hashed = hashlib.sha256()
        for low in range(0, len(sign), WRITTEN):
            # signs are padded with zero bytes to one length
            part = self.signs[sign[low:low + WRITTEN]].tobytes().translate(None, b"\0")
            hashed.update(part if low + WRITTEN < len(sign) else part[:-1])
        return hashed.hexdigest()


class Vocabularies:
    """The contents of both vocabulary files, and in each process one aligner made of them."""
    _made: dict[str, Aligner] = {}

    def __init__(self, path_a: str, path_b: str):
        with open(path_a, encoding="utf-8") as file:
            self.json_a = file.read()
        with open(path_b, "rb") as file:
            self.model_b = file.read()
        self.key = hashlib.sha256(self.json_a.encode() + self.model_b).hexdigest()

    def aligner(self) -> Aligner:
        if self.key not in self._made:
            self._made[self.key] = Aligner(self.json_a, self.model_b)
        return self._made[self.key]


def vocabularies(folder: str = VOCABULARIES) -> Vocabularies:
    return Vocabularies(f"{folder}/{FILE_A}", f"{folder}/{FILE_B}")


def portions(batches):
    """doc_ids and texts of some rows at a time: up to ``TOGETHER`` characters, or one row."""
    for batch in batches:
        ids, texts, size = [], [], 0
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            text = text.as_py()
            if ids and size + len(text or "") > TOGETHER:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc_id.as_py())
            texts.append(text)
            size += len(text or "")
        if ids:
            yield ids, texts


def align_documents(docs: DataFrame, vocab: Vocabularies) -> DataFrame:
    """doc_id and the groups of each row of ``docs`` (doc_id, text), in order: byte range, A's ids, B's ids."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)
    group = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("a", pa.list_(pa.int32())), ("b", pa.list_(pa.int32()))])

    def run(batches):
        aligner = shared.value.aligner()
        for ids, texts in portions(batches):
            rows = []
            for a, b in aligner.tokens(texts):
                at_a, at_b = aligner.ends(a, b)
                ends = np.cumsum(aligner.length_a[a])[at_a].tolist()
                rows.append([{"start": s, "end": e, "a": x.tolist(), "b": y.tolist()} for s, e, x, y in zip(
                    [0, *ends], ends, np.split(a, at_a + 1), np.split(b, at_b + 1))])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(rows, pa.list_(group))], names=["doc_id", "groups"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        run, "doc_id long, groups array<struct<start: long, end: long, a: array<int>, b: array<int>>>")


LINKED = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links binary"


def linked_documents(docs: DataFrame, vocab: Vocabularies) -> DataFrame:
    """Each row's figures and its links: places in the list of possible pairs, as differences in rising order.
    Written to the shared folder, so that nothing is encoded twice."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(vocab)

    def run(batches):
        aligner = shared.value.aligner()
        for ids, texts in portions(batches):
            figures, digests, links = [], [], []
            for a, b in aligner.tokens(texts):
                at_a, at_b = aligner.ends(a, b)
                found = aligner.links(a, b, at_a, at_b)
                figures.append((len(a), len(b), len(at_a), len(found)))
                digests.append(aligner.digest(a, b, at_a, at_b))
                links.append(np.diff(found, prepend=0).astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), *[pa.array(f, pa.int64()) for f in zip(*figures)], pa.array(digests), pa.array(links, pa.binary())],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])

    path = scratch_path(spark, f"alignment-{uuid.uuid4().hex}")
    (docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, LINKED)
     .write.option("compression", "zstd").parquet(path))
    return spark.read.parquet(path)


def _places(links: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(links, "<i4"), dtype=np.int64)


def pair_counts(linked: DataFrame, n_pairs: int) -> np.ndarray:
    """How many links hold each pair: one vector, summed in the tasks and then over them."""
    def count(batches):
        n = np.zeros(n_pairs, np.int64)
        for batch in batches:
            for links in batch["links"]:
                np.add.at(n, _places(links), 1)
        some = np.flatnonzero(n)
        yield pd.DataFrame({"pair": some, "n": n[some]})

    rows = linked.select("links").mapInPandas(count, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(n_pairs, np.int64)
    out[rows["pair"].to_numpy(np.int64)] = rows["n"].to_numpy(np.int64)
    return out


def best_pairs(pairs: np.ndarray, counts: np.ndarray, n_b: int) -> np.ndarray:
    """Whether a pair has the highest count of its token of B."""
    highest = np.zeros(n_b, np.int64)
    np.maximum.at(highest, pairs % n_b, counts)
    return (counts == highest[pairs % n_b]) & (counts > 0)


def score_documents(docs: DataFrame, vocab: Vocabularies) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of each row."""
    spark = docs.sparkSession
    linked = linked_documents(docs, vocab)
    aligner = vocab.aligner()
    counts = pair_counts(linked, len(aligner.pairs))
    shared = spark.sparkContext.broadcast((counts, best_pairs(aligner.pairs, counts, len(aligner.bytes_b))))

    @F.arrow_udf("struct<n_best: long, count_sum: long>")
    def figures(links: pa.Array) -> pa.Array:
        n, best = shared.value
        places = [_places(x.as_py()) for x in links]
        return pa.StructArray.from_arrays([pa.array([int(best[p].sum()) for p in places], pa.int64()),
                                           pa.array([int(n[p].sum()) for p in places], pa.int64())], names=["n_best", "count_sum"])

    return (linked.withColumn("f", figures("links"))
            .select("doc_id", "n_a", "n_b", "n_groups", "n_links", "f.n_best", "f.count_sum", "groups_sha256"))


def query(spark, sf_dir: str, folder: str = VOCABULARIES) -> DataFrame:
    return score_documents(C.read_table(spark, sf_dir, "documents", "doc_id", "text"), vocabularies(folder))

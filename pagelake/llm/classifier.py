"""Quality classifier (operator 5): a factorisation machine.

Features of a text: its words, hashed into ``HASHED`` slots, weighted by the
logarithm of their count and scaled to length 1; figures of its structure; and
its length as the metadata give it.  A score is the logistic of

    w0 + sum_i w_i x_i + 1/2 sum_f ((sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2)

so that all pairs of features interact at a cost linear in the text.

The machine is fitted on ``MAX_TRAIN`` labelled rows at most, chosen by hash
from those whose crc32 of the id is not divisible by 5; features are made in
the tasks, and the driver gets those of the chosen rows only.  All rows are
scored where they are, in one pass.  Labels, language, source and id are never
features.

Defined results: a null text is the empty one, which has a score like any
other; a null length is taken from the text; a null id counts as held out;
with no labelled rows every score is 0.5; repeated rows get the same score;
an empty table gives no rows; ``score_documents`` keeps all other columns and
replaces one named score.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

HASHED = 1 << 14
RANK = 8
MAX_TRAIN = 8_000
EPOCHS = 8
BATCH = 128
RATE = 0.02
DECAY = 1e-4
CUT = 0.3
#: Texts whose features are held at once.
TOGETHER = 256

_UPPER = bytes(range(65, 91))
_LOWER = bytes(range(97, 123))
_DIGIT = bytes(range(48, 58))
_SIGNS = b"#*$%&|<>"
_ENDS = b".,;:!?"
N_STATS = 12


def structure(data: bytes, words: list[bytes], seen: Counter, n_chars: float | None) -> np.ndarray:
    """Figures of a text's form; all are finite for an empty text."""
    size, n = max(len(data), 1), max(len(words), 1)
    share = lambda chars: (len(data) - len(data.translate(None, chars))) / size
    lines = [x for x in data.split(b"\n") if x.strip()]
    return np.array([
        np.log1p(len(data) if n_chars is None or not n_chars >= 0 else n_chars), np.log1p(len(words)),
        sum(map(len, words)) / n, share(_UPPER), share(_LOWER), share(_DIGIT), share(_SIGNS), share(_ENDS),
        share(b"!"), len(seen) / n, sum(map(eq, words, words[1:])) / n,
        1 - len(set(lines)) / max(len(lines), 1)], dtype=np.float32)


def features(text: bytes | None, n_chars: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words, their values, and the structure figures."""
    data = text or b""
    words = data.split()
    seen = Counter(words)
    slots = np.fromiter(map(zlib.crc32, seen), dtype=np.int64, count=len(seen)) & (HASHED - 1)
    values = np.log1p(np.fromiter(seen.values(), dtype=np.float32, count=len(seen)))
    summed = np.bincount(slots, weights=values, minlength=1)
    slots = np.flatnonzero(summed)
    values = summed[slots]
    return (slots.astype(np.int32), (values / max(np.sqrt((values ** 2).sum()), 1e-9)).astype(np.float32),
            structure(data, words, seen, n_chars))


@dataclass
class Machine:
    w0: float
    w: np.ndarray
    v: np.ndarray
    mean: np.ndarray
    scale: np.ndarray

    def rows(self, feats: list) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All features in a row: slots, values, and where each text begins."""
        own = np.arange(HASHED, HASHED + N_STATS)
        stats = [np.clip((s - self.mean) / self.scale, -4, 4) for _, _, s in feats]
        slots = np.concatenate([x for s, _, _ in feats for x in (s, own)])
        values = np.concatenate([x for (_, v, _), z in zip(feats, stats, strict=True) for x in (v, z / N_STATS ** 0.5)])
        starts = np.cumsum([0, *(len(s) + N_STATS for s, _, _ in feats[:-1])])
        return slots, values.astype(np.float32), starts

    def parts(self, slots, values, starts):
        z = self.v[slots] * values[:, None]
        sums = np.add.reduceat(z, starts)
        linear = np.add.reduceat(self.w[slots] * values, starts)
        return sums, self.w0 + linear + 0.5 * ((sums ** 2).sum(1) - np.add.reduceat((z ** 2).sum(1), starts))

    def scores(self, feats: list) -> np.ndarray:
        if not feats:
            return np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(self.parts(*self.rows(feats))[1].astype(np.float64), -30, 30)))


def fit(feats: list, labels: np.ndarray, seed: int = 0) -> Machine:
    """Logistic loss, Adam on small batches; the same rows give the same machine."""
    rng = np.random.default_rng(seed)
    d = HASHED + N_STATS
    m = Machine(0.0, np.zeros(d, np.float32), rng.normal(0, 0.05, (d, RANK)).astype(np.float32),
                np.zeros(N_STATS, np.float32), np.ones(N_STATS, np.float32))
    if not len(feats):
        m.v[:] = 0
        return m
    stats = np.stack([s for _, _, s in feats])
    m.mean, m.scale = stats.mean(0), stats.std(0) + 1e-3
    share = (labels.sum() + 1) / (len(labels) + 2)
    m.w0 = float(np.log(share / (1 - share)))
    theta = np.concatenate([m.v, m.w[:, None]], axis=1)
    one, two, step = np.zeros_like(theta), np.zeros_like(theta), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(feats))
        for at in range(0, len(order), BATCH):
            pick = order[at:at + BATCH]
            m.v, m.w = theta[:, :RANK], theta[:, RANK]
            slots, values, starts = m.rows([feats[i] for i in pick])
            sums, y = m.parts(slots, values, starts)
            g = (1 / (1 + np.exp(-np.clip(y, -30, 30))) - labels[pick]) / len(pick)
            row = np.repeat(np.arange(len(pick)), np.diff([*starts, len(slots)]))
            x, gr = values, g[row]
            grad = np.empty_like(theta)
            for f in range(RANK):
                pull = gr * x * (sums[row, f] - m.v[slots, f] * x)
                grad[:, f] = np.bincount(slots, weights=pull, minlength=d)
            grad[:, RANK] = np.bincount(slots, weights=gr * x, minlength=d)
            grad += DECAY * theta
            step += 1
            one = 0.9 * one + 0.1 * grad
            two = 0.99 * two + 0.01 * grad ** 2
            theta = theta - RATE * (one / (1 - 0.9 ** step)) / (np.sqrt(two / (1 - 0.99 ** step)) + 1e-8)
            m.w0 -= RATE * float(g.sum())
    m.v, m.w = theta[:, :RANK].astype(np.float32).copy(), theta[:, RANK].astype(np.float32).copy()
    return m


def held_out(doc_id: str = "doc_id") -> Column:
    """True for ids whose crc32 as text is divisible by 5, and for a null id."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> tuple[list, np.ndarray]:
    """Features and labels of ``most`` labelled rows at most that are not held out."""
    one = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").filter(~held_out())
    one = one.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    one = one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = F.broadcast(one.select(F.col("doc_id").alias("_id"), "quality"))
    rows = docs.select("doc_id", F.col("text").cast("binary").alias("text"), "n_chars")
    rows = rows.join(one, F.col("doc_id") == F.col("_id"))
    # one row an id, however many the table has: that with the smallest hash of its text
    first = F.min(F.struct(F.xxhash64("text").alias("h"), F.col("text").alias("t"), F.col("n_chars").alias("n")))
    rows = rows.groupBy("doc_id", "quality").agg(first.alias("r")).select(
        "doc_id", "quality", F.col("r.t").alias("text"), F.col("r.n").alias("n_chars"))

    def extract(batches):
        for b in batches:
            out = [[x.tobytes() for x in features(t.as_py(), n.as_py())]
                   for t, n in zip(b.column("text"), b.column("n_chars"), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), b.column("quality"),
                 *(pa.array([o[i] for o in out], pa.binary()) for i in range(3))],
                ["doc_id", "quality", "slots", "values", "stats"])

    found = rows.select("doc_id", "quality", "text", "n_chars").mapInArrow(
        extract, "doc_id long, quality int, slots binary, values binary, stats binary").collect()
    found.sort(key=lambda r: (r["doc_id"], bytes(r["slots"]), bytes(r["values"])))
    feats = [(np.frombuffer(r["slots"], np.int32), np.frombuffer(r["values"], np.float32),
              np.frombuffer(r["stats"], np.float32)) for r in found]
    return feats, np.array([min(1, max(0, r["quality"])) for r in found], dtype=np.float32)


def scorer(shared):
    """The broadcast machine as a function of the columns text (binary) and n_chars (double)."""

    @F.arrow_udf("double")
    def score(text: pa.Array, n_chars: pa.Array) -> pa.Array:
        out = []
        for lo in range(0, len(text), TOGETHER):
            some = zip(text.slice(lo, TOGETHER), n_chars.slice(lo, TOGETHER), strict=True)
            out.append(shared.value.scores([features(t.as_py(), n.as_py()) for t, n in some]))
        return pa.array(np.round(np.concatenate(out) if out else np.zeros(0), 6), pa.float64())

    return score


def score_of(docs: DataFrame, machine: Machine) -> Column:
    """The score of each row of ``docs``, from 0 to 1."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)
    return scorer(shared)(F.col("text").cast("binary"), F.col("n_chars").cast("double"))


def score_documents(docs: DataFrame, machine: Machine) -> DataFrame:
    """``docs`` with score."""
    return docs.withColumn("score", score_of(docs, machine))


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    return fit(*training_rows(docs, labels))


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text", "n_chars")
    machine = train(docs, C.read_table(spark, sf_dir, "labels", "doc_id", "quality"))
    scored = score_documents(docs, machine)
    return scored.select("doc_id", held_out().alias("held_out"), "score",
                         (F.col("score") >= CUT).cast("int").alias("predicted"))

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from pagelake.llm import substring
from pagelake.llm.fmindex import FMIndex
from tests.llm.helpers import documents, odd_documents, words


def brute(rows, window=20):
    """n_words, n_removed and kept text of each row; rows alike in id and text are one document."""
    named = lambda i, t: i if i is not None else (xxhash.xxh64((t or "").encode(), seed=42).intdigest() + 2**63) % 2**64 - 2**63
    order = sorted({(i is not None, named(i, t), t or "") for i, t in rows}, key=lambda x: x[1])
    seen, out = set(), {}
    for has, i, t in order:
        ws = words(t)
        gone = [False] * len(ws)
        for j in range(len(ws) - window + 1):
            k = tuple(ws[j:j + window])
            if k in seen:
                gone[j:j + window] = [True] * window
            seen.add(k)
        out[(i if has else None, t)] = (len(ws), sum(gone), " ".join(w for w, g in zip(ws, gone, strict=True) if not g))
    return out


def check(spark, rows, window=20):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, window)
    got = substring.deduplicated(docs, window).collect()
    assert len(got) == len(rows)
    key = lambda r: (str(r[0]), *r[1:])
    have = sorted(((r["doc_id"], r["n_words"], sum(s["words"] for s in r["spans"]), r["kept_text"]) for r in got), key=key)
    assert have == sorted(((i, *want[(i, t or "")]) for i, t in rows), key=key)
    return got


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(3000)}"
    text = lambda n: [word() for _ in range(n)]
    line, passage = text(9), text(70)
    rows = []
    for k in range(120):
        t = text(rng.randrange(5, 200))
        if k % 2:
            t[rng.randrange(len(t)):0] = line
        if k % 3 == 0:
            at, lo = rng.randrange(len(t)), rng.randrange(20)
            t[at:at] = passage[lo:lo + rng.randrange(15, 51)]
        if k % 10 == 0:
            t = t + t[:60] + ["same"] * rng.randrange(50)
        rows.append(" ".join(t))
    for k in range(20):  # near copies
        t = rows[k].split()
        t[rng.randrange(len(t))] = word()
        rows.append(" ".join(t))
    rows += rows[:4]
    rng.shuffle(rows)
    return [(7 * k % 1009, t) for k, t in enumerate(rows)]


def test_windows_that_start_earlier_go(spark, corpus):
    got = check(spark, corpus)
    assert sum(bool(r["spans"]) for r in got) > 30


def test_hot_anchors_and_small_shards(spark, corpus, monkeypatch):
    for name, value in (("HOT", 3), ("CHUNK", 16), ("BLOCK", 50), ("SAMPLE", 1), ("SALTS", 3)):
        monkeypatch.setattr(substring, name, value)
    check(spark, corpus, window=12)


def test_given_documents(spark):
    rows = [(r["doc_id"], r["text"]) for r in documents(spark).collect()]
    check(spark, rows)
    want = {i: hashlib.sha256(brute(rows)[(i, t)][2].encode()).hexdigest() for i, t in rows}
    from tests.llm.helpers import SF
    assert {r["doc_id"]: r["kept_sha256"] for r in substring.query(spark, SF).collect()} == want


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    check(spark, [(r["doc_id"], r["text"]) for r in docs.filter("doc_id IS NULL OR doc_id <> 10").collect()])
    # two texts under one id: the one with the smaller hash comes first
    both = [(10, f"{x} " + " ".join(f"w{i}" for i in range(30))) for x in ("one", "two")]
    got = substring.deduplicated(spark.createDataFrame(both, "doc_id long, text string")).collect()
    assert sorted(sum(s["words"] for s in r["spans"]) for r in got) == [0, 30] and all(r["n_words"] == 31 for r in got)
    assert substring.deduplicated(docs.limit(0)).count() == 0


def test_many_equal_rows_and_many_texts_under_one_id(spark):
    text = " ".join(f"w{i % 97} x{i % 89}" for i in range(130))
    rows = (spark.range(10_000).selectExpr("7L AS doc_id", f"'{text}' AS text")
            .unionByName(spark.range(10_000).selectExpr("8L AS doc_id", "concat_ws(' ', transform(sequence(1, 30), i -> concat('t', id, 'n', i))) AS text"))
            .unionByName(spark.createDataFrame([(9, "before " + text)], "doc_id long, text string")))
    got = substring.deduplicated(rows.repartition(6)).selectExpr("doc_id", "aggregate(spans, 0L, (n, s) -> n + s.words) AS gone")
    n = {(r["doc_id"], r["gone"]): r["count"] for r in got.groupBy("doc_id", "gone").count().collect()}
    assert n == {(7, 0): 10_000, (8, 0): 10_000, (9, 260): 1}


def test_documents_are_cut_together(monkeypatch):
    """Short documents share the arrays and the batches that are made for them, and each is cut as if it were alone."""
    class Frame:
        def mapInArrow(self, rows, _):
            return rows

    def cuts(texts):
        docs = pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in texts], pa.int64()), pa.array([-i for i, _ in texts], pa.int64()),
             pa.array([t for _, t in texts], pa.binary())], ["doc_id", "tid", "text"])
        return list(substring.cut(Frame(), 20, frozenset())(iter([docs.slice(0, 100), docs.slice(100)])))

    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(40)}" for _ in range(n)).encode()
    texts = [(i, text(rng.randrange(60))) for i in range(300)]
    texts += [(300, None), (301, b""), (302, text(20)), (303, b"same " * 50), (304, text(30) + b" " + b"again " * 60)]
    texts += [(400 + i, t) for i, t in texts]
    together = cuts(texts)
    assert len(together) == 1
    alone = [b for t in texts for b in cuts([t])]
    assert pa.Table.from_batches(together).equals(pa.Table.from_batches(alone).combine_chunks())
    for n in (1, 100, 5000):
        monkeypatch.setattr(substring, "TOGETHER", n)
        assert pa.Table.from_batches(cuts(texts)).combine_chunks().equals(pa.Table.from_batches(alone).combine_chunks())


@pytest.mark.parametrize("window", (5, 20))
def test_stretches_are_those_of_marked_words(window):
    rng = random.Random(9)
    marks = [(rng.randrange(40), rng.randrange(400), rng.randrange(1, 16)) for _ in range(150)]
    gone = {(r, w) for r, s, n in marks for w in range(s, s + n + window - 1)}
    got = substring.stretches(np.array([m[0] for m in marks]), np.array([s << 11 | n for _, s, n in marks]), window)
    got = list(zip(*(x.tolist() for x in got), strict=True))
    assert {(r, w) for r, s, e in got for w in range(s, e)} == gone
    assert got == sorted(got) and all((r, s - 1) not in gone and (r, e) not in gone for r, s, e in got)
    none = substring.stretches(*[np.zeros(0, np.int64)] * 2, window)
    assert [len(x) for x in none] == [0, 0, 0]


def test_index_finds_earlier_starts():
    rng = np.random.default_rng(2)
    for top in (2, 5, 300):
        text = np.append(rng.integers(1, top + 1, 2000), 0)
        ends = np.arange(5, 2000)
        got = FMIndex(text, 6).earlier(text, ends, 6)
        seen, want = set(), []
        for e in ends:
            k = tuple(text[e - 5:e + 1])
            want.append(k in seen)
            seen.add(k)
        assert got.tolist() == want

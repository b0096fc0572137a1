import random

import numpy as np
import pytest

from pagelake.llm import decontam
from pagelake.llm.decontam import words_of
from tests.llm.helpers import odd_documents


def test_every_leak_is_found_and_no_clean_document(spark):
    sf = "/root/testdata/sf0.01"
    flat = lambda t: b" " + b" ".join(words_of(t.encode())) + b" "
    docs = [(r["doc_id"], flat(r["text"])) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    items = [(r["item_id"], flat(r["text"])) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, x in items if x in t}
    got = {(r["doc_id"], r["item_id"]) for r in decontam.query(spark, sf).collect()}
    assert got >= want and {d for d, _ in got} == {d for d, _ in want} and len(want) > 10


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(8)
    word = lambda: f"f{rng.randrange(40)}" if rng.random() < 0.4 else f"t{rng.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    items = [text(rng.randrange(12, 70)) for _ in range(60)]
    docs, leaks = [], set()
    for k in range(200):
        d = text(rng.randrange(0, 300))
        if k % 4 == 0:
            i = rng.randrange(60)
            leak = [w if rng.random() > 0.15 else text(1)[0] for w in items[i]]  # a paraphrase
            at = rng.randrange(len(d) + 1)
            d[at:at] = leak
            leaks.add((k, i))
        docs.append((k, " ".join(d)))
    return docs, [(i, " ".join(x)) for i, x in enumerate(items)], leaks


def test_paraphrases(spark, planted):
    docs, items, leaks = planted
    found = decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                  spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r["doc_id"], r["item_id"]) for r in found}
    assert len(got & leaks) >= 0.9 * len(leaks) and len(got - leaks) <= 1


def test_retrieval_recall_against_all_passages(spark, planted):
    """Candidates hold at least 0.9 of the pairs that full TF-IDF cosines bring up."""
    docs, items, _ = planted
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    idf = decontam.word_weights(frame)
    space = decontam.latent_block(items, idf)
    ids = [decontam.hashed(words_of(t.encode())) for _, t in docs]
    table = np.full(decontam.HASHED + 1, -1, np.int64)
    table[space["vocabulary"]] = np.arange(len(space["vocabulary"]))
    got = {(int(t), int(i)) for t, i, _, _ in decontam.candidates(space, table, idf, ids, decontam.MASS, decontam.CUT)}

    def vectors(texts, step):
        flat, at, owner, _ = decontam.passages(texts, step)
        rows = decontam.once(flat, at)
        v = np.zeros((len(rows), decontam.HASHED + 1), np.float32)
        v[np.arange(len(rows))[:, None], rows] = idf[rows]
        v[:, -1] = 0
        return v / np.maximum(np.linalg.norm(v, axis=1, keepdims=True), 1e-9), owner

    a, of_doc = vectors(ids, decontam.STEP)
    b, of_item = vectors([decontam.hashed(words_of(t.encode())) for _, t in items], decontam.ITEM_STEP)
    near = np.argwhere(a @ b.T >= 0.75)
    want = {(int(of_doc[p]), int(of_item[q])) for p, q in near}
    assert len(want) > 30 and len(want & got) >= 0.9 * len(want)


def test_blocks_of_items_give_what_one_gives(spark, planted, monkeypatch):
    docs = spark.createDataFrame(planted[0], "doc_id long, text string")
    items = spark.createDataFrame(planted[1], "item_id long, text string")
    pairs = lambda: {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(docs, items).collect()}
    whole = pairs()
    assert len(whole & planted[2]) >= 0.9 * len(planted[2])
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 9)
    monkeypatch.setattr(decontam, "AT_ONCE", 2)
    assert len(pairs() & planted[2]) >= 0.9 * len(planted[2])
    bad = {d for d, _ in pairs()}
    assert {r["doc_id"] for r in decontam.clean_documents(docs, items).collect()} == {i for i, _ in planted[0]} - bad


def test_longest_common_subsequence():
    rng = random.Random(1)
    for _ in range(50):
        a, b = ([rng.choice("abcd").encode() for _ in range(rng.randrange(80))] for _ in range(2))
        best = [0] * (len(b) + 1)
        for x in a:
            row = [0]
            for j, y in enumerate(b):
                row.append(best[j] + 1 if x == y else max(best[j + 1], row[j]))
            best = row
        assert decontam.lcs(a, b) == best[-1]


def test_leading_directions():
    rng = np.random.default_rng(0)
    a = rng.normal(size=(60, 8)) @ rng.normal(size=(8, 90)) + 0.01 * rng.normal(size=(60, 90))
    v = decontam.randomised_svd(a, 8)
    exact = np.linalg.svd(a, full_matrices=False)[2][:8]
    assert np.allclose(np.linalg.svd(exact @ v)[1], 1, atol=1e-4)


def test_odd_rows_and_empty_tables(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "quick brown fox jumps over the lazy dog and runs far away", 0), (1, None, 0), (None, "the lazy dog and runs", 0),
                                   (3, "", 0), (4, "!!", 0), (5, "one two", 0)], "item_id long, text string, doc_id int")
    rows = decontam.contaminated(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} >= {(1, 1), (2, 1), (8, 1), (None, 1), (5, 5)}
    assert not {r["doc_id"] for r in rows} & {3, 4, 6, 7, 9}
    clean = decontam.clean_documents(docs, items)
    assert clean.columns == docs.columns
    assert {3, 4, 6, 7, 9} <= {r["doc_id"] for r in clean.collect()}
    assert decontam.contaminated(docs.limit(0), items).count() == 0
    assert decontam.contaminated(docs, items.limit(0)).count() == 0
    assert decontam.clean_documents(docs, items.limit(0)).count() == docs.count()


def test_short_items_word_for_word(spark):
    rng = random.Random(3)
    text = lambda n: [f"t{rng.randrange(900)}" for _ in range(n)]
    items = [[f"q{i}w{j}" if j % 4 == 0 else f"t{rng.randrange(900)}" for j in range(n)]
             for i, n in enumerate([*range(1, 13)] * 4)]
    docs = [(k, text(rng.randrange(200, 400))) for k in range(96)]
    for i, item in enumerate(items):
        at = rng.randrange(150)
        docs[2 * i][1][at:at] = item
    docs.append((96, text(50) + items[0]))
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()}
    assert got >= {(2 * i, i) for i in range(len(items))} | {(96, 0)} and {d for d, _ in got} == {*range(0, 96, 2), 96}
    clean = {r["doc_id"] for r in decontam.clean_documents(frame, bench).collect()}
    assert clean == set(range(1, 96, 2))


def test_excerpts_of_long_items(spark):
    rng = random.Random(4)
    text = lambda n: [f"t{rng.randrange(4000)}" for _ in range(n)]
    items = [text(n) for n in (40, 60, 300) for _ in range(8)]
    docs = [(k, text(rng.randrange(200, 400))) for k in range(120)]
    for i, item in enumerate(items):
        half, at = item[:len(item) // 2], rng.randrange(150)
        docs[3 * i][1][at:at] = half
        if len(item) == 300:  # with a word in twelve replaced, so that no run of thirteen is left
            docs[3 * i + 1][1][at:at] = ["other" if k % 12 == 5 else w for k, w in enumerate(half)]
        docs[3 * i + 2][1][at:at] = item[20:20 + decontam.RUN]
    frame = spark.createDataFrame([(k, " ".join(d)) for k, d in docs], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(items)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(frame, bench).collect()}
    want = {(3 * i + j, i) for i in range(24) for j in (0, 2)} | {(3 * i + 1, i) for i in range(16, 24)}
    assert got == want
    clean = {r["doc_id"] for r in decontam.clean_documents(frame, bench).collect()}
    assert clean == set(range(120)) - {d for d, _ in want}


def test_blocks_are_bounded_by_words_and_keep_each_passage():
    rng = random.Random(6)
    text = " ".join(f"t{rng.randrange(10**6)}" for _ in range(16000))
    pieces = decontam.pieces_of(1, text)
    words = words_of(text.encode())
    assert [w for p in pieces for w in p.words[:p.own]] == words and max(p.own for p in pieces) <= decontam.PIECE
    rows, wide = decontam.runs_of(words), {(p.at + i, n) for p in pieces for i, n in decontam.runs_of(p.words)}
    assert wide == set(rows)
    idf = np.append(np.ones(decontam.HASHED), 0).astype(np.float32)
    spaces = decontam.latent_spaces(pieces, idf)
    assert len(spaces) > 1 and [p for s in spaces for p in s["pieces"]] == pieces
    for s in spaces:
        assert s["v"].shape[1] <= decontam.RANK and decontam.latent_space(s["pieces"], idf)[1] >= decontam.KEPT


def test_sparse_products():
    rng = np.random.default_rng(2)
    slot = np.argsort(rng.random((300, 50)), axis=1)[:, :16]
    weight = rng.random((300, 16)) * (rng.random((300, 16)) < 0.8)
    a = np.zeros((300, 50))
    np.add.at(a, (np.arange(300)[:, None], slot), weight)
    s = decontam.Sparse(slot, weight, 50)
    x, y = rng.random((50, 7)), rng.random((300, 7))
    assert np.allclose(s @ x, a @ x) and np.allclose(s.T @ y, a.T @ y)

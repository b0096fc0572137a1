import math
import re

import numpy as np

from pagelake.llm import ranking
from tests.llm.helpers import SF, ascii_lower, documents, odd_documents

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall(ascii_lower(text))


def brute(docs, items, k=10):
    """(item_id, rank, doc_id, score) by the formula, document by document."""
    texts = [(d, terms(t)) for d, t in docs]
    n_docs, n_terms = sum(bool(t) for _, t in texts), sum(len(t) for _, t in texts)
    df = {}
    for _, ts in texts:
        for t in set(ts):
            df[t] = df.get(t, 0) + 1
    out = []
    for item_id, text in items:
        rows = []
        for d, ts in texts:
            score = 0
            for t in set(terms(text)) & set(ts):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * len(ts) * n_docs) // n_terms
                score += w * ((1000000000 * ts.count(t)) // (1000 * ts.count(t) + 8 * m))
            if score > 0:
                rows.append((-score, d is None, d, -score))
        rows.sort(key=lambda r: (r[0], r[1], r[2] or 0))
        out += [(item_id, i + 1, d, -s) for i, (s, _, d, _) in enumerate(rows[:k])]
    return sorted(out, key=str)


def pairs(df, key):
    return [(r[key], r["text"]) for r in df.collect()]


def found(df):
    return sorted(((r["item_id"], r["rank"], r["doc_id"], r["score"]) for r in df.collect()), key=str)


def test_query_against_the_formula(spark):
    items = spark.read.parquet(f"{SF}/benchmark.parquet")
    assert found(ranking.query(spark, SF)) == brute(pairs(documents(spark), "doc_id"), pairs(items, "item_id"))


def test_blocks_tiles_and_pieces_change_nothing(spark, monkeypatch):
    docs, items = documents(spark).limit(60), spark.read.parquet(f"{SF}/benchmark.parquet").limit(12)
    docs, items = spark.createDataFrame(docs.collect(), docs.schema), spark.createDataFrame(items.collect(), items.schema)
    want = brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert found(ranking.ranked(docs.repartition(5), items, cells=200)) == want
    for name, value in [("TILE_DOCS", 7), ("TILE_TERMS", 3), ("PIECE", 5), ("GROUPS", 2)]:
        monkeypatch.setattr(ranking, name, value)
    held = ranking.Block()
    held.add(1, [b"a", b"b"])
    assert ranking.tile_terms(5) == 3 and held.cells_with([b"b", b"c"]) == 6
    rows = list(zip([1, 2, 3], [b"a b b", b"b", b"none"]))
    tile = ranking.Tile(held, np.array([500, 200]), 3, 5)
    for d, text in rows:
        tile.add(d, text)
    assert tile.ids == [1, 2] and tile.scores().shape == (2, 1)


def test_ties_go_by_id_and_null_ids_come_last(spark):
    docs = spark.createDataFrame([(i, "same words here") for i in (5, 3, None, 9, 3, 7, 1, 20, 30, 40, 50, 60)]
                                 + [(100 + i, f"other {i}") for i in range(40)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "words"), (1, "words"), (2, "Same, unknown"), (None, "here"), (3, None), (4, "")], "item_id long, text string")
    got = found(ranking.ranked(docs.repartition(6), items))
    assert got == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert [d for i, _, d, _ in sorted(got, key=lambda r: (str(r[0]), r[1])) if i == 2] == [1, 3, 3, 5, 7, 9, 20, 30, 40, 50]


def test_sums_near_the_bound_are_exact():
    weights = np.array([ranking.TILE_TERMS * 1000] * 3)
    assert ranking.tile_terms(2 ** 53) == 1
    assert ranking.tile_terms(int(weights.max())) * int(weights.max()) * 10 ** 6 < 2 ** 53


def test_odd_rows(spark):
    docs = odd_documents(spark)
    items = spark.createDataFrame([(1, "Quick fox", "a"), (2, "x", "b"), (3, "日本語 été", "c"), (4, None, "d"), (None, "another", "e")],
                                  "item_id long, text string, score string")
    assert found(ranking.ranked(docs, items)) == brute(pairs(docs, "doc_id"), pairs(items, "item_id"))
    assert found(ranking.ranked(docs.limit(0), items)) == found(ranking.ranked(docs, items.limit(0))) == []
    assert found(ranking.ranked(docs.where("text IS NULL"), items)) == []

import random
from itertools import combinations

import numpy as np
import pytest

from pagelake.llm import components, neardup
from pagelake.llm import superminhash as S
from tests.llm.helpers import ascii_lower, documents, odd_documents, words


def shingles(text, n):
    ws = words(ascii_lower(text))
    return frozenset(tuple(ws[i:i + n]) for i in range(max(1, len(ws) - n + 1))) if ws else frozenset()


def brute(rows, n=4, percent=80):
    """Component of each (doc_id, set), by comparing all pairs."""
    sets = {shingles(t, n) for _, t in rows} - {frozenset()}
    up = {s: s for s in sets}

    def root(s):
        while up[s] is not s:
            s = up[s]
        return s

    for a, b in combinations(sets, 2):
        both = len(a & b)
        if 100 * both >= percent * (len(a) + len(b) - both):
            up[root(a)] = root(b)
    least = {}
    for i, t in rows:
        s = shingles(t, n)
        if s and i is not None:
            least[root(s)] = min(i, least.get(root(s), i))
    return {(i, s): (least.get(root(s)) if s else i) for i, s in ((i, shingles(t, n)) for i, t in rows)}


def check(spark, rows, n=4):
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, n)
    got = neardup.near_duplicates(docs, shingle=n).collect()
    by_id = {}
    for (i, s), c in want.items():
        by_id.setdefault(i, set()).add((len(s), c))
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_shingles"], r["component_id"]) in by_id[r["doc_id"]]
        assert r["kept"] == (r["component_id"] is None or r["doc_id"] == r["component_id"])
    return got


def edited(rng, base, share, vocabulary=5000):
    return " ".join(f"w{rng.randrange(vocabulary)}" if rng.random() < share else w for w in base.split())


@pytest.fixture(scope="module")
def corpus():
    """Chains of near copies around the threshold, and texts that share a long passage."""
    rng = random.Random(3)
    rows = []
    for g in range(4):
        base = " ".join(f"b{g}x{rng.randrange(300)}" for _ in range(150))
        rows += [edited(rng, base, 0.005 + 0.008 * (k % 6)) for k in range(60)]
    passage = " ".join(f"p{rng.randrange(400)}" for _ in range(60))
    for k in range(80):
        rows.append(" ".join(f"v{rng.randrange(9000)}" for _ in range(15)) + " " + passage + " "
                    + " ".join(f"v{rng.randrange(9000)}" for _ in range(k % 12)))
    rows += rows[:5] + ["one two three four five"] * 3 + ["", " \t "]
    return list(enumerate(rows, 100))


def test_components_are_those_of_all_pairs(spark, corpus):
    got = check(spark, corpus)
    assert 10 < len({r["component_id"] for r in got}) < len(got) - 100


def test_given_documents(spark):
    check(spark, [(r["doc_id"], r["text"]) for r in documents(spark).collect()], n=5)


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    check(spark, [(r["doc_id"], r["text"]) for r in docs.collect()])
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    stay = neardup.one_of_each(docs)
    assert stay.columns == docs.columns
    ids = sorted((r["doc_id"] or 0, r["text"] or "") for r in stay.collect())
    assert [i for i, _ in ids].count(2) == 0 and [i for i, _ in ids].count(1) == 1  # 2 and 8 copy 1
    assert {3, 4, 5, 6, 7, 9} <= {i for i, _ in ids}
    assert neardup.one_of_each(docs.limit(0)).count() == 0


def test_one_of_each_group_stays(spark, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    stay = {r["doc_id"] for r in neardup.one_of_each(docs).collect()}
    assert stay == {c for c in brute(corpus).values()}


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    for share in (0.2, 0.5, 0.8):
        gaps = []
        for _ in range(30):
            pool = rng.integers(0, 2**63, 400, dtype=np.uint64)
            k = int(400 * share)
            cut = k + (400 - k) // 2
            a, b = np.unique(pool[:cut]), np.unique(np.concatenate([pool[:k], pool[cut:]]))
            one, two = S.signatures([a, b])
            gaps.append((one == two).mean() - k / 400)
        assert abs(np.mean(gaps)) < 0.02 and np.std(gaps) < 0.05


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (1, 3, 40, 163, 900, 5000)]
    together = S.signatures(sets)
    assert all((S.signatures([s])[0] == row).all() for s, row in zip(sets, together, strict=True))


def test_components_of_long_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(1000, 1400)] + [(5, 2000 + i) for i in range(300)] + [(-7, 5), (9, 9)]
    rows = components.components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()
    got = {r["node"]: r["root"] for r in rows}
    assert all(got.get(i, 1000) == 1000 for i in range(1000, 1401))
    assert all(got[2000 + i] == -7 for i in range(300)) and got[5] == -7
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0

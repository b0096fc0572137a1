import zlib

from pagelake.llm import mixing, sharding
from tests.llm.helpers import SF, documents, odd_documents, words


def check_shards(rows, n, slack):
    size = lambda r: len((r["text"] or "").encode()) + 1
    total, shards = sum(map(size, rows)), {}
    for r in rows:
        assert r["size"] == size(r) and r["law"] == "bytes" and r["grown_shard"] is None
        assert r["text_crc32"] == zlib.crc32((r["text"] or "").encode())
        shards.setdefault(r["shard"], []).append(r)
    assert set(shards) <= set(range(n))
    for rs in shards.values():
        assert sorted(r["slot"] for r in rs) == list(range(len(rs)))
        assert abs(sum(map(size, rs)) - total / n) <= slack
    return shards


def test_shards_have_equal_bytes_and_gapless_slots(spark):
    rows = sharding.shard_documents(documents(spark), n_shards=4, part_bytes=20_000).collect()
    assert len(rows) == documents(spark).count()
    check_shards(rows, 4, max(r["size"] for r in rows))


def test_reruns_agree(spark):
    one, two = ({(r["doc_id"], r["shard"], r["slot"]) for r in sharding.query(spark, SF).collect()} for _ in range(2))
    assert one == two


def test_a_group_larger_than_a_shard_is_cut(spark):
    docs = odd_documents(spark, [(i, "copy " * 10) for i in range(400)])
    rows = sharding.shard_documents(docs, n_shards=8).collect()
    assert len(check_shards(rows, 8, 51)) == 8


def test_small_groups_stay_together(spark):
    docs = odd_documents(spark, [(i, f"text {i % 500} " * 5) for i in range(1000)])
    rows = sharding.shard_documents(docs, n_shards=4, tolerance=0.02).collect()
    check_shards(rows, 4, 0.02 * sum(r["size"] for r in rows) / 4 + 200)
    where = {}
    for r in rows:
        where.setdefault(r["text"], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = sharding.shard_documents(docs, n_shards=3).collect()
    assert len(rows) == docs.count() and rows[0]["_k"] == "c" and rows[0]["score"] == "b"
    assert sharding.shard_documents(docs.limit(0)).count() == 0


def water_fill(sizes, weights, budget):
    """Targets by raising one source after the other to its cap."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    left, free, target = budget * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        full = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not full:
            return {**target, **{s: level * weight[s] for s in free}}
        for s in full:
            target[s] = 2 * sizes[s]
            left -= target[s]
        free -= full
    return target


def check_mix(rows, docs, slack):
    size = {}
    for r in docs:
        size[r["source"]] = size.get(r["source"], 0) + len(words(r["text"]))
    target = water_fill(size, (5, 2, 1), 1.5)
    taken = {}
    for r in rows:
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
    for s, t in target.items():
        assert abs(taken[s] - t) <= slack
    return taken


def test_mix_meets_targets(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 3)
    monkeypatch.setattr(mixing, "TIME_BUCKETS", 8)
    docs = documents(spark)
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count()
    most = max(r["size"] for r in rows)
    check_mix(rows, docs.collect(), most + 1)
    again = mixing.taken_words(docs).collect()
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(map(key, rows)) == sorted(map(key, again))


def test_mix_emits_what_it_takes_in_order(spark):
    docs = documents(spark)
    taken = {r["doc_id"]: r["taken"] for r in mixing.taken_words(docs).collect()}
    out = mixing.mix_documents(docs)
    assert out.columns == [*docs.columns, "finish"]
    rows = out.collect()
    assert [r["finish"] for r in rows] == sorted(r["finish"] for r in rows)
    got = {}
    for r in rows:
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + len(words(r["text"]))
    assert got == {k: v for k, v in taken.items() if v}


def test_mix_of_odd_rows_and_empty_table(spark):
    docs = odd_documents(spark)
    rows = mixing.taken_words(docs).collect()
    assert len(rows) == docs.count() and sum(r["taken"] for r in rows) > 0
    check_mix(rows, docs.collect(), 5001)
    assert set(mixing.mix_documents(docs).columns) == set(docs.columns)
    assert mixing.taken_words(docs.limit(0)).count() == 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0
    assert all(r["taken"] == 0 for r in mixing.taken_words(docs.filter("text IS NULL")).collect())

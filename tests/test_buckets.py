"""The bucketed table: batches, replays, filters, copy-on-write, growth."""

import os

import pytest
from pyspark.sql import functions as F

from pagelake.operators import incremental as INC
from pagelake.sources import store as ST
from pagelake.sources.buckets import BucketTable
from pagelake.streaming import streams as SS


def seen(spark, root, **sizes):
    return SS.seen_table(spark, str(root), **sizes)


def urls(spark, lo, hi, origin="queued"):
    return spark.range(lo, hi).select(F.concat(F.lit("https://h.example/"), F.col("id").cast("string")).alias("url"),
                                      F.lit(origin).alias("origin"))


def files(root):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, fs in os.walk(root) for f in fs if f.endswith(".parquet")}


def test_absent_keys_are_exactly_those_not_held(spark, tmp_path):
    t = seen(spark, tmp_path, n_buckets=4, bucket_rows=200, max_parts=2)
    assert t.absent(urls(spark, 0, 3)).count() == 3 and t.rows().count() == 0
    for batch, (lo, hi) in enumerate([(0, 100), (50, 180), (180, 400), (400, 1500), (1490, 1600)]):
        assert t.append(urls(spark, lo, hi), batch)
    assert t.rows().count() == 1600
    assert t.manifest().n_buckets >= 8
    asked = urls(spark, 1300, 1900).unionByName(spark.createDataFrame([(None, None)], "url string, origin string"))
    assert sorted(int(r.url[18:]) for r in t.absent(asked).collect()) == list(range(1600, 1900))
    assert t.lookup(urls(spark, 1598, 1605)).count() == 2


def test_a_replayed_batch_changes_nothing(spark, tmp_path):
    t = seen(spark, tmp_path)
    assert t.append(urls(spark, 0, 10), 0)
    before = files(tmp_path)
    assert not t.append(urls(spark, 5, 99), 0) and files(tmp_path) == before
    assert t.append(urls(spark, 5, 12, "stored"), 1)
    assert {r.url[18:]: r.origin for r in t.rows().collect()} == {str(i): "queued" if i < 5 else "stored" for i in range(12)}


def test_a_write_that_was_not_committed_is_not_seen(spark, tmp_path, monkeypatch):
    t = seen(spark, tmp_path)
    t.append(urls(spark, 0, 10), 0)
    with monkeypatch.context() as m:
        m.setattr(BucketTable, "_commit", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            t.append(urls(spark, 10, 20), 1)
    assert t.rows().count() == 10 and t.absent(urls(spark, 9, 12)).count() == 2
    assert t.append(urls(spark, 10, 20), 1) and t.rows().count() == 20
    t.vacuum(keep=1)
    assert t.rows().count() == 20 and len(ST.names(spark, f"{tmp_path}/data")) == 2


def test_what_a_batch_reads_does_not_grow_with_the_table(spark, tmp_path):
    t = seen(spark, tmp_path, n_buckets=4, bucket_rows=100, max_parts=2)
    sizes = []
    for batch, (lo, hi) in enumerate([(0, 1000), (1000, 10000)]):
        t.append(urls(spark, lo, hi), batch)
        of = t.manifest()
        # a batch of ten URLs, half of them new: what its buckets hold, filters and data
        asked = urls(spark, lo + 3, lo + 8).unionByName(urls(spark, 90000, 90005))
        assert t.absent(asked).count() == 5
        touched = t.touched(asked, of.n_buckets)
        paths = [p for kind in ("filter", "data") for p in t._paths(of, kind, touched)]
        sizes.append(sum(os.path.getsize(f) for p in paths for f in files(p)))
        maybe = t.may_hold(asked.select("url"), of, touched)
        assert {r.url for r in maybe.collect()} >= {r.url for r in urls(spark, lo + 3, lo + 8).collect()}
    # ten times the table: as many buckets a batch at most as it has URLs, each of one size
    assert sizes[1] < 2.5 * sizes[0]


def test_upsert_leaves_untouched_buckets_alone(spark, tmp_path):
    t = INC.versioned_table(spark, str(tmp_path), "key string, html string, version int", n_buckets=16)
    rows = lambda lo, hi, v: spark.range(lo, hi).select(
        F.sha1(F.col("id").cast("string")).alias("key"), F.concat(F.lit(f"v{v} "), F.col("id").cast("string")).alias("html"), F.lit(v).alias("version"))
    t.upsert(rows(0, 500, 1), 0)
    before, old = files(tmp_path / "data"), t.manifest()
    assert t.upsert(rows(3, 5, 2).unionByName(rows(3, 5, 2)), 1)
    new = t.manifest()
    touched = t.touched(rows(3, 5, 2), 16)
    assert all(new.parts[b] == old.parts[b] for b in old.parts if b not in touched)
    assert all(len(new.parts[b]) == 1 and new.parts[b] != old.parts[b] for b in touched)
    assert all(files(tmp_path / "data")[f] == m for f, m in before.items())
    assert not t.upsert(rows(0, 9, 3), 1) and t.manifest().version == new.version
    got = {r.html for r in t.rows().collect()}
    assert len(got) == 500 and {"v2 3", "v2 4", "v1 5"} <= got
    # an older version that arrives late does not replace a newer one
    t.upsert(rows(3, 5, 1), 2)
    assert {r.html for r in t.rows().collect()} == got
    assert t.upsert(rows(0, 0, 1), 3) and t.rows().count() == 500


def test_one_row_a_key_in_spite_of_ties(spark):
    df = spark.createDataFrame([("k", 1, "a"), ("k", 1, "a"), ("k", 1, "b"), ("l", None, "c"), ("l", 0, "d"), (None, 1, "e")], "key string, version int, html string")
    got = INC.upsert(df, df).collect()
    assert sorted(str(r.key) for r in got) == ["None", "k", "l"] and {r.key: r.html for r in got}["l"] == "d"

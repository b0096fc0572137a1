"""Scope filters (FLT-3/4/5) and the ledger fold (STM-2, JOIN-2/3, STM-3, WIN-3)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from pagelake.operators import ledger as LG
from pagelake.operators import closure as CL
from pagelake.operators import scope as S
from pagelake.profile import FORUM


def flags(spark, urls, **kw):
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    return [r.f for r in df.select(S.in_scope(F.col("u"), FORUM, **kw).alias("f")).collect()]


def test_scope_in_out(spark):
    urls = ["https://forum.example.org/board/cat/4/page",
            "https://forum.example.org/board/topic/12",
            "https://forum.example.org/",
            "https://elsewhere.example.org/board/topic/12",
            "https://forum.example.org/board?board%5Bas%5D=rss&x=%zz",
            "https://forum.example.org/board/files/a.iso;v=2"]
    assert flags(spark, urls) == [True, True, False, False, False, False]


def test_category_only_scope(spark):
    pages = spark.createDataFrame([(1, "https://forum.example.org/board/cat/4/page"),
                                   (2, "https://forum.example.org/board/cat/40/page"),
                                   (3, "https://forum.example.org/board/topic/7"),
                                   (4, "https://forum.example.org/board"),
                                   (5, "https://forum.example.org/board/news/1")], "page_id long, url string")
    for seed in ("https://forum.example.org/board/cat/4/page", "https://forum.example.org/board/cat/4",
                 "https://forum.example.org/board/cat/4?view=1"):
        seeds = spark.createDataFrame([(seed,)], "url string")
        got = {r.page_id: r.in_scope for r in S.category_scope(pages, seeds, FORUM, include=("/news/",)).collect()}
        assert got == {1: True, 2: False, 3: True, 4: False, 5: True}
    with pytest.raises(ValueError):
        S.category_scope(pages, spark.createDataFrame([("https://forum.example.org/board",)], "url string"), FORUM)


def test_robots_rules(spark):
    rules = spark.createDataFrame([("*", "*", 1, True, "/a/ok"), ("*", "*", 2, False, "/a"), ("h1", "*", 1, False, ""),
                                   ("h2", "bot", 1, False, "/b"), ("h2", "*", 1, False, "/c"), ("h1", "other", 0, True, "/z")],
                                  "host string, agent string, rule_no int, allow boolean, path_prefix string")
    urls = {"http://h0/a/ok/1": True, "http://h0/a/no": False, "http://h0/x": True, "http://h1/z": False, "http://h2/a": True,
            "http://h2/b/1": False, "http://h2/c": True, "http://h0/": True}
    pages = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r.url: r.allowed for r in S.robots_allowed(pages, rules, "bot").collect()} == urls
    assert all(r.allowed for r in S.robots_allowed(pages, rules.limit(0), "bot").collect())


def test_extra_excludes_and_replacing_includes(spark):
    url = "https://forum.example.org/board/x"
    df = spark.createDataFrame([(url,), (url + "?board[do]=move",)], "u string")
    flags = lambda **kw: [r.f for r in df.select(S.in_scope(F.col("u"), FORUM, **kw).alias("f")).collect()]
    assert flags() == [True, False]
    assert flags(include=("/news",)) == [False, False]
    assert flags(extra_exclude=("/x$",)) == [False, False]


def test_closure_runs_to_the_end_of_a_long_chain(spark):
    n = 60
    seeds = spark.createDataFrame([("u0",)], "url string")
    edges = spark.createDataFrame([(f"u{i}", f"u{i + 1}", i) for i in range(n)] + [("u5", "u2", 99), ("x", "y", 1)],
                                  "src string, dst string, k int")
    got = {r.url: r.depth for r in CL.crawl_closure(seeds, edges).collect()}
    assert got == {f"u{i}": i for i in range(n + 1)}


def test_page_cap_follows_the_order_of_discovery(spark):
    seeds = spark.createDataFrame([("b", 1), ("a", 2), ("c", 3)], "url string, order int")
    edges = spark.createDataFrame([("b", "z", 1), ("a", "y", 2), ("b", "x", 3)], "src string, dst string, k int")
    urls = lambda n: {r.url for r in CL.crawl_closure(seeds, edges, max_pages=n).collect()}
    assert urls(2) == {"a", "b"} and urls(4) == {"a", "b", "c", "z"} and urls(0) == set("abcxyz")


def log(spark, rows):
    t0 = dt.datetime(2024, 1, 1)
    data = [(u, k, t0 + dt.timedelta(seconds=s), i, True) for i, (u, k, s) in enumerate(rows)]
    return spark.createDataFrame(data, "url string, kind string, ts timestamp_ntz, tid long, moved boolean")


def test_fold_claim_complete_fail(spark):
    lg = log(spark, [("a", "add", 0), ("b", "add", 1), ("c", "add", 2), ("a", "claim", 3), ("b", "claim", 4),
                     ("a", "complete", 5), ("b", "fail", 6)])
    st = {r.url: r for r in LG.fold(lg).collect()}
    assert st["a"].completed and not st["a"].in_flight and not st["a"].pending
    assert st["b"].error and not st["b"].in_flight
    assert st["c"].pending and not st["c"].in_flight
    s = LG.stats(LG.fold(lg)).first()
    assert (s.pending, s.in_flight, s.completed, s.errors, s.remaining) == (1, 0, 1, 1, 1)
    assert s.progress_pct == 50.0


def test_claim_order_and_recovery(spark):
    lg = log(spark, [("a", "add", 0), ("b", "add", 1), ("c", "add", 2), ("x", "add", 3), ("x", "claim", 4),
                     ("x", "stale", 5)])
    st = LG.fold(lg)
    batch = [r.url for r in LG.claim_batch(st, 2).orderBy("rank").collect()]
    assert batch == ["x", "a"]
    lg2 = log(spark, [("a", "add", 0), ("a", "claim", 1), ("b", "add", 2), ("b", "claim", 3), ("b", "complete", 4)])
    rec = {r.url: r.moved for r in LG.recover_in_flight(LG.fold(lg2)).collect()}
    assert rec == {"a": True}


def test_retry_and_stale(spark):
    lg = log(spark, [("a", "add", 0), ("a", "claim", 1), ("a", "fail", 2), ("b", "add", 3), ("b", "claim", 4),
                     ("b", "fail", 5), ("c", "add", 6), ("c", "claim", 7)])
    st = LG.fold(lg)
    assert sorted(r.url for r in LG.retry_errors(st).where("moved").collect()) == ["a", "b"]
    now = F.lit(dt.datetime(2024, 1, 1, 0, 10))
    assert [r.url for r in LG.lease_expiry(st, now, 300).collect()] == ["c"]
    assert [r.url for r in LG.lease_expiry(st, now, -1).collect()] == ["c"]

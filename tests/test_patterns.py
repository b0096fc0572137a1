"""Pattern tables, robots texts, point lookups and raw trees."""

import random
import re

import pytest
from pyspark.sql import functions as F

from pagelake.operators import patterns as PT
from pagelake.operators import scope as S
from pagelake.sources import lookup as LK
from pagelake.sources import robots as RB
from pagelake.sources import store as ST


@pytest.mark.parametrize("pattern, factor", [
    (r"/cat/4/", "/cat/4/"), (r"\.(zip|exe)$", ""), (r"^/en/\d+\.html$", "html"), ("a|bcdef", ""), ("(?i)abc", ""), ("abcd?ef", "abc"),
    ("abc+def", "abc"), ("ab[xy]cdef", "cdef"), ("x(yz)?abc", "abc"), ("((a)(b|c))long", "long"), (r"[\]abc]defg", "defg"), ("", ""),
    ("abcx{0,2}de", "abc"), (r"a\x41bc", ""), ("[^a]]bcd", "]bcd")])
def test_factors_are_in_every_match(spark, pattern, factor):
    got = spark.createDataFrame([(pattern,)], "p string").select(PT.factor(F.col("p")).alias("f")).first().f
    assert got == factor or (len(got) < 3 and len(factor) < 3) or (got in pattern and len(got) <= len(factor))


def brute(urls, patterns):
    own = {s.lower() for s, k, _ in patterns if k == "include" and s != "*"}
    out = {}
    for u in urls:
        host, target = re.match(r"https?://([^/]*)(.*)", u).groups()
        hit = lambda kind, sites: any(k == kind and s.lower() in sites and re.search(p, target) for s, k, p in patterns)
        ex = hit("exclude", ("*", host))
        out[u] = (ex, not ex and hit("include", (host,) if host in own else ("*", host)))
    return out


def test_pattern_table_is_a_plain_search(spark):
    rnd = random.Random(2)
    words = ["cat", "topic", "news", "en", "es", "x", "page", "forum"]
    urls = sorted({f"https://{rnd.choice(['a.example', 'b.example', 'c.example'])}/" + "/".join(rnd.choice(words) for _ in range(rnd.randint(0, 4)))
                   + rnd.choice(["", "/", ".html", "?page=2", "/12"]) for _ in range(400)})
    patterns = [("*", "include", "/cat/"), ("*", "include", "^/[^/]+$"), ("*", "exclude", r"\.html$"), ("B.example", "include", "/news/(en|es)"),
                ("b.example", "exclude", "forum|page"), ("c.example", "exclude", "x"), ("a.example", "exclude", "(?i)TOPIC"),
                ("*", "exclude", "page=[0-9]+$")] + [("a.example", "exclude", f"/{a}/{b}/{c}") for a in words for b in words[:5] for c in words[:4]]
    df = spark.createDataFrame([(u,) for u in [*urls, urls[0], None]], "url string")
    table = spark.createDataFrame(patterns, "site string, kind string, pattern string")
    rows = PT.scope(df, table).collect()
    assert len(rows) == len(urls) + 2
    want = brute(urls, patterns)
    assert {r.url: (r.excluded, r.in_scope) for r in rows} == {**want, None: (False, False)}
    assert any(ok for _, ok in want.values()) and any(ex for ex, _ in want.values())
    assert PT.scope(df, table.limit(0)).where("excluded OR in_scope").count() == 0


ROBOTS = """# all
Disallow: /before
User-agent: one   # first
user-AGENT: TWO

# between
Unknown: x
Allow: /a/b
Disallow: /a
User-agent: three
Disallow:
Crawl-delay: 4
User-agent: *
Disallow: /%7Eu
"""


def test_robots_lines_to_rules(spark):
    files = spark.createDataFrame([("h.example", ROBOTS), ("i.example", ROBOTS.replace("\n", "\r\n")), ("j.example", ""), ("k.example", None)], "host string, text string")
    rules = RB.robots_rules(files).collect()
    for host in ("h.example", "i.example"):
        got = {}
        for r in sorted((r for r in rules if r.host == host), key=lambda r: r.rule_no):
            got.setdefault(r.agent, []).append((r.allow, r.path_prefix))
        assert got == {"one": [(True, "/a/b"), (False, "/a")], "two": [(True, "/a/b"), (False, "/a")], "three": [(True, "")], "*": [(False, "/~u")]}
    assert {r.host for r in rules} == {"h.example", "i.example"}
    pages = spark.createDataFrame([(f"https://h.example{p}",) for p in ("/a/b/c", "/a/x", "/~u/1", "/z")], "url string")
    allowed = {a: [r.allowed for r in S.robots_allowed(pages, RB.robots_rules(files), a).orderBy("url").collect()] for a in ("one", "three", "nine")}
    assert allowed == {"one": [True, False, True, True], "three": [True] * 4, "nine": [True, True, True, False]}


def test_lookup_by_key(spark, tmp_path):
    df = spark.range(5000).select(F.sha1(F.col("id").cast("string")).alias("key"), "id")
    LK.write_sorted(df, f"{tmp_path}/t", "key", 4)
    asked = df.where("id % 50 = 7").select("key").unionByName(spark.createDataFrame([("none",), (None,)], "key string"))
    assert sorted(r.id for r in LK.lookup(spark, f"{tmp_path}/t", "key", asked).collect()) == list(range(7, 5000, 50))
    assert LK.lookup(spark, f"{tmp_path}/t", "key", asked.limit(0)).count() == 0
    assert LK.lookup(spark, f"{tmp_path}/t", "key", df.select("key"), "id").count() == 5000


def test_raw_tree(spark, tmp_path):
    for kind, names in {"meta": {"k1.json": '{"url": "u1"}', "k2.json": '{"url": "u2"}', "k3.json": "broken", "k4.json.tmp": '{"url": "u4"}'},
                        "html": {"k1.html": "<p>\n1", "k3.html": "3", "k4.html": "4", "k2.html.tmp": "2"}}.items():
        (tmp_path / kind / "sub").mkdir(parents=True)
        for i, (name, text) in enumerate(names.items()):
            (tmp_path / kind / ("sub" if i % 2 else "") / name).write_text(text)
    assert [tuple(r) for r in ST.scan_tree(spark, str(tmp_path), "url string").where("url IS NOT NULL").collect()] == [("k1", "u1", "<p>\n1")]

import base64
import hashlib
import uuid

import duckdb

from pagelake.llm import urlfilter, warc
from pagelake.session import scratch_path
from tests.llm.helpers import SF

PAGES = "page_id long, url string, html string, payload_bytes string"


def expected(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(i, last.get(html or "", i))
    out = []
    for i, _, html in rows:
        data, top = (html or "").encode(), last.get(html or "")
        same = i == top or top is None
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if same else "revisit", None if same else top))
    return sorted(out, key=repr)


def archived(spark, rows, name, **params):
    path = scratch_path(spark, f"test-{name}-{uuid.uuid4().hex}")
    warc.write_warc(spark.createDataFrame(rows, PAGES.replace(", payload_bytes string", "")), path, **params)
    got = warc.page_records(warc.read_warc(spark, path))
    return sorted((tuple(r)[:5] for r in got.collect()), key=repr), path


NESTED = ("a" * 50 + warc.MAGIC + "WARC-Type: response\r\nWARC-Record-ID: <urn:pagelake:page:99>\r\nContent-Length: 4\r\n\r\nfake\r\n\r\n"
          + warc.MAGIC + "no header " + warc.MAGIC + "Content-Length: 999999\r\n\r\nb")


def test_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "x"), (2, "http://b/", "x"), (3, None, None), (4, "http://c/\r\nX: y", ""),
            (5, "http://d/", NESTED), (6, "http://e/", NESTED), (7, "http://f/", "\r\n\r\n" + warc.MAGIC), (None, "http://g/", "z"),
            (None, "http://h/", "x"), (8, "http://i/", "é\U0001f600" * 9000), (8, "http://i/", "é\U0001f600" * 9000),
            (9, "http://j/", warc.MAGIC)]
    got, _ = archived(spark, rows, tmp_path.name)
    assert got == expected(rows)


def test_records_across_blocks(spark, tmp_path):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "3000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = [(i, f"http://a/{i}", ("p%d " % (i % 90)) * (i % 700) + NESTED * (i % 17 == 0)) for i in range(150)]
        got, path = archived(spark, rows, tmp_path.name, compression="none")
        assert spark.read.text(path).selectExpr("_metadata.file_block_start").distinct().count() > 20
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert got == expected(rows)


def test_claimed_lengths_that_no_file_holds(spark, tmp_path):
    head = warc.MAGIC + "Content-Length: {}\r\n\r\n"
    claims = [2 ** 63 - 1, 2 ** 63, 2 ** 31, 2 ** 31 - 1, -1, 0, 5, 10 ** 30, "x", "", "1e3"]
    rows = [(i, "http://a/", "page " + head.format(n) + "rest") for i, n in enumerate(claims)]
    rows.append((99, "http://b/", "".join(head.format(n) for n in claims)))
    got, _ = archived(spark, rows, tmp_path.name)
    assert got == expected(rows)


def test_pointers_jump_between_the_parts_of_a_file(spark, tmp_path, monkeypatch):
    rounds = []
    kept = warc.C.materialised
    monkeypatch.setattr(warc, "PART", 3)
    monkeypatch.setattr(warc.C, "materialised", lambda df: rounds.append(df.columns) or kept(df))
    rows = [(i, "http://a/", f"p{i}" + NESTED * (i % 5 == 0)) for i in range(40)]
    got, _ = archived(spark, rows, tmp_path.name)
    assert got == expected(rows)
    assert sum("leaves" in c for c in rounds) > 3


def test_small_payloads_are_all_responses(spark, tmp_path):
    got, _ = archived(spark, [(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abc"), (4, "u", "abc")], tmp_path.name, least_bytes=3)
    assert [r[3] for r in got] == ["response", "response", "revisit", "response"]


def test_no_pages(spark, tmp_path):
    assert archived(spark, [], tmp_path.name)[0] == []


def test_every_page_comes_back(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.sql(warc.ORACLE)
    got = warc.query(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)


def verdicts(spark, urls, rules=urlfilter.RULES):
    rows = spark.createDataFrame([(i, u, "x") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = urlfilter.judge_urls(rows, rules).collect()
    assert len(out) == len(urls)
    return {r["page_id"]: r for r in out}


def test_rules_and_parts(spark):
    urls = ["http://A.Example.COM/en/1?x#y", "https://www.example.com/en/1", "http://x.net/es/1", "ftp://x.net/de/2#a", None,
            "no scheme", "http://example.com", "http://notexample.com/en/3", "http://h.org?/q", "http://x.net/fr/", "://", ""]
    got = verdicts(spark, urls)
    assert [got[i]["rule"] for i in range(len(urls))] == [
        "example.com/en/", "www.example.com/en/", "net/es/", None, None, None, None, "com/", None, "net/fr/", None, None]
    assert (got[0]["host"], got[0]["path"]) == ("a.example.com", "/en/1")
    assert (got[3]["host"], got[3]["path"]) == ("x.net", "/de/2")
    assert (got[4]["host"], got[4]["path"], got[6]["path"], got[8]["host"]) == ("", "", "", "h.org")
    assert [got[i]["verdict"] for i in (0, 1, 2, 3, 4)] == ["block", "allow", "block", "allow", "allow"]


def test_templates_with_bad_neighbours_are_rejected(spark):
    # /shop/<name>/<n>: 20 names are one variable segment; the rules name 15 of them
    rules = tuple(("block", "h.org", f"/shop/n{chr(97 + i)}/") for i in range(15))
    urls = [f"http://h.org/shop/n{chr(97 + i)}/{i}" for i in range(20)] + ["http://h.org/about/1", "http://g.org/shop/nz/1"]
    got = verdicts(spark, urls, rules)
    assert {got[i]["template"] for i in range(20)} == {"/shop/*/<n>"}
    assert all(got[i]["verdict"] == "block" for i in range(20))
    assert got[20]["verdict"] == got[21]["verdict"] == "allow"


def test_similar_branches_are_merged(spark):
    # one labelled page does not suffice to reject, two branches with one each do
    rules = (("block", "h.org", "/a/1"), ("block", "h.org", "/b/1"))
    urls = ["http://h.org/a/1", "http://h.org/a/9", "http://h.org/b/1", "http://h.org/c/9"]
    assert verdicts(spark, urls[:2], rules)[1]["verdict"] == "allow"
    got = verdicts(spark, urls, rules)
    assert got[1]["verdict"] == "block" and got[3]["verdict"] == "allow"


def test_no_urls(spark):
    assert verdicts(spark, []) == {}


def test_urls_match_sql(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{SF}/pages.parquet')")
    want = con.sql(urlfilter.ORACLE)
    got = urlfilter.query(spark, SF).select(*want.columns).collect()
    assert sorted(map(tuple, got), key=repr) == sorted(want.fetchall(), key=repr)

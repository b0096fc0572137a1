"""Extraction, privacy and index jobs on own-written forum fixtures."""

import datetime as dt
import re

from pyspark.sql import functions as F

from pagelake.functions import pii as PII
from pagelake.operators import authors as A
from pagelake.operators import extract as X
from pagelake.operators import incremental as INC
from pagelake.operators import index as IX
from pagelake.operators import links as L
from pagelake.operators import privacy as PR
from pagelake.profile import FORUM

TOPIC = """<html><head><title>Spring fair | Riverside board</title></head><body>
<ul class="forum-crumbs"><li><a href="/board">Board</a></li><li><a href="/board/cat/4/page">Events</a></li>
<li>Campus</li><li> </li></ul>
<h1 class="topic-title">Spring fair [120 views]</h1>
<ul class="pager"><li><a href="/board/topic/7/page">1</a></li><li><a href="/board/topic/7/page/2">2</a></li></ul>
<ul><li class="post" data-post-id="p1"><div class="post-byline">Posted 13-06-2024 16:41 by Dana Lee</div>
<div class="post-info"><span data-mail-token="nbjmup;ebob/mffAfybnqmf/psh">dana&lt;at&gt;example.org</span>
Updated: -<br>Role: Staff.</div>
<div class="post-body">See <a href="/board/topic/9">the plan</a> and <a href="https://other.example.net/x">this</a>.
<a href="/files/map.png">map</a></div>
<a href="/board/x?board[do]=answer">reply</a></li></ul>
<div class="login-frame">Logged in as dana <form action="/board?signout=1"></form></div>
</body></html>"""


def topic_df(spark):
    return spark.createDataFrame([(1, "https://forum.example.org/board/topic/7/page", TOPIC)],
                                 "page_id long, url string, html string")


def test_titles_and_crumbs(spark):
    r = X.page_records(topic_df(spark), FORUM).first()
    assert r.title == "Spring fair [120 views]"
    assert r.breadcrumb == ["Board", "Events", "Campus"]
    assert "https://forum.example.org/board/topic/9" in r.links
    assert r.links.count("https://forum.example.org/board/topic/9") == 1


def test_post_fields(spark):
    p = X.posts(topic_df(spark), FORUM).first()
    assert p.post_id == "p1" and p.author == "Dana Lee" and p.timestamp == "13-06-2024 16:41"
    assert p.email_obfuscated == "nbjmup;ebob/mffAfybnqmf/psh" and p.email is None
    assert p.email_visible == "dana<at>example.org"
    assert p.department == "Staff" and p.updated == "-"
    assert p.attachments == ["https://forum.example.org/files/map.png"]
    revealed = X.posts(topic_df(spark), FORUM, reveal_email=True).first()
    assert revealed.email == "dana.lee@example.org"


def test_next_page(spark):
    df = X.with_page_url(topic_df(spark), FORUM)
    assert df.select(X.next_page(F.col("html"), F.col("page_url"), FORUM).alias("n")).first().n == \
        "https://forum.example.org/board/topic/7/page/2"


def test_decode_tokens(spark):
    df = spark.createDataFrame([("nbjmup;ebob/mffAfybnqmf/psh",), (None,), ("bcd",)], "t string")
    got = [r.d for r in df.select(PII.decode_mail_token(F.col("t")).alias("d")).collect()]
    assert got == ["dana.lee@example.org", None, None]


def test_scrub(spark):
    text = ("In room 27 ask for 12345678901; pay to GR16 0110 1250 0000 0001 2300 695 and call 2101234567 or "
            "6912345678, else write to jo.doe@example.com")
    out = spark.createDataFrame([(text,)], "t string").select(PII.scrub(F.col("t")).alias("s")).first().s
    for secret in ("jo.doe@example.com", "6912345678", "2101234567", "12345678901", "GR16"):
        assert secret not in out
    assert "room 27" in out and out.count("[redacted-phone]") == 2
    again = spark.createDataFrame([(out,)], "t string").select(PII.scrub(F.col("t")).alias("s")).first().s
    assert again == out


def test_login_wall_and_strip(spark):
    login = '<form><input type="password" name="pass"></form>'
    logout = '<form action="/x?signout=1"><input type="submit"></form>'
    df = spark.createDataFrame([(200, "text/html", login), (200, "text/html", logout), (403, "text/html", "")],
                               "s int, ct string, h string")
    assert [r.w for r in df.select(PR.login_wall(F.col("s"), F.col("ct"), F.col("h")).alias("w")).collect()] == \
        [True, False, True]
    nested = TOPIC.replace("Logged in as dana", "<div>hi <div>there</div></div>Logged in as dana<div></div>")
    df = spark.createDataFrame([(1, TOPIC, "x"), (2, nested, "x"), (3, None, "x"), (4, "", None)], "row int, html string, token string")
    rows = {r.row: r.html for r in PR.strip_blocks(df, FORUM).collect()}
    assert all("Logged in as" not in rows[n] and "dana <form" not in rows[n] and "Spring fair" in rows[n] for n in (1, 2))
    assert rows[1] == rows[2] and rows[3] is None and rows[4] in ("", None) and len(rows) == 4


def one(spark, html, fn, url="https://forum.example.org/board/topic/7/page"):
    df = X.with_page_url(spark.createDataFrame([(1, url, html)], "page_id long, url string, html string"), FORUM)
    return df.select(fn(F.col("html"), F.col("page_url")).alias("x")).first().x


def test_next_page_without_paginator_and_on_the_last_page(spark):
    nxt = lambda h, b: X.next_page(h, b, FORUM)
    pager = '<ul class="pager"><li><a href="/p/1">1</a></li><li>2</li></ul>'
    assert one(spark, "<p>none</p>", nxt) is None
    assert one(spark, pager, nxt) is None
    assert one(spark, pager + '<a rel="next" href="/p/9">more</a>', nxt) == "https://forum.example.org/p/9"
    assert one(spark, '<!-- <a rel="next" href="/p/9">x</a> -->', nxt) is None


def test_links_in_comments_and_scripts_are_none(spark):
    html = """<!-- <a href="/no1">x</a> --><script>var s = '<a href="/no2">x</a>';</script><a href='/yes?a=1&amp;b=2'>y</a>"""
    assert one(spark, html, lambda h, b: X.link_targets(h, b, FORUM)) == ["https://forum.example.org/yes?a=1&b=2"]


def test_attachments_by_block_class_and_directory(spark):
    html = """<a href="/files/a">1</a><a class="big attachment" href="/b">2</a><a class="attachments" href="/no">3</a>
    <div class="attachments"><div><a href="/c">4</a></div></div><a href="/no">5</a>"""
    df = spark.createDataFrame([(1, "https://forum.example.org/board/topic/7/page", html)], "page_id long, url string, html string")
    got = [r.dst for r in X.attachment_edges(df, FORUM).orderBy("seq").collect()]
    assert got == [f"https://forum.example.org/{x}" for x in ("files/a", "b", "c")]


def test_category_without_link_is_skipped(spark):
    html = """<ul><li class="cat-group"><h2>G</h2><ul><li class="cat-item"><h3>no link</h3></li>
    <li class="cat-item" data-cat-id="4"><h3><a href="/board/cat/4/">Trips</a></h3><span class="topic-count">1.204 topics</span></li></ul></li></ul>"""
    df = spark.createDataFrame([(1, "https://forum.example.org/board", html)], "page_id long, url string, html string")
    rows = X.categories(df, FORUM).collect()
    assert [(r.title, r.cat_id, r.topic_count) for r in rows] == [("Trips", "4", 1204)]


def test_labels_and_page_numbers_never_fail(spark):
    rows = [("https://forum.example.org/board/topic/7/page/99999999999999999999", "", []),
            ("https://forum.example.org/board/topic/7/page/99999999999", None, None), ("", "Welcome to the board", ["x", " "])]
    df = spark.createDataFrame(rows, "url string, title string, bc array<string>")
    out = IX.classify(df, FORUM).select("page_no", IX.page_label(F.col("url"), F.col("title"), F.col("bc"), FORUM).alias("l")).collect()
    assert [r.page_no for r in out] == [None, 99999999999, None] and out[0].l == "99999999999999999999"


def test_post_with_quote_footer_and_entities(spark):
    html = """<ul><li class="post" data-post-id="p"><div class="post-byline">Posted 01-02-2024 10:00 by Zo&eacute; &#945;&#x3b2;</div>
    <div class="post-body"><div class="quote">q <ul><li>in</li></ul></div>after &amp;lt;</div></li></ul><footer><a href="/files/legal.pdf">x</a></footer>"""
    df = spark.createDataFrame([(1, "https://forum.example.org/board/topic/1/page", html)], "page_id long, url string, html string")
    p = X.posts(df, FORUM).first()
    assert p.text_excerpt == "q in after &lt;" and p.attachments == [] and p.author == "Zoé αβ"


def test_rewrite_in_all_quotings_and_public_pages(spark):
    html = """<a class=x href='/board/b'>1</a><a href=/board/b>2</a><img src = "/i.png"><a href="/board/c?a=1&amp;b=2">3</a>
<a href="https://else.example/">4</a><p href="/board/b"></p><div class="login-frame"><div>x</div>Logged in as dana</div>
<a href="mailto:a@b.gr">m</a> <span data-mail-token="q">dana at b</span> call 6912345678"""
    pages = spark.createDataFrame([(1, "https://forum.example.org/board/a", "board/a.html", html)],
                                  "page_id long, page_url string, path string, html string")
    maps = spark.createDataFrame([("https://forum.example.org/board/b", "board/b.html"),
                                  ("https://forum.example.org/board/c?a=1&b=2", "board/c~1.html")], "url string, path string")
    assets = spark.createDataFrame([("https://forum.example.org/i.png", "i.png")], "url string, path string")
    r = L.rewrite_pages(pages, maps, FORUM, assets).first()
    assert r.n_rewritten == 4
    assert """<a class=x href="../board/b.html">1</a><a href="../board/b.html">2</a><img src = "../i.png"><a href="../board/c~1.html">3</a>
<a href="https://else.example/">4</a><p href="/board/b"></p>""" in r.html
    r = L.rewrite_pages(pages, maps, FORUM, assets, rules=PII.DEFAULT_RULES).first()
    assert r.n_rewritten == 4 and "dana" not in r.html and "6912345678" not in r.html and r.html.count(PR.PLACEHOLDER) == 2


def test_stored_page_without_validators_is_not_new(spark):
    prior = spark.createDataFrame([("k1", None, None, None), ("k2", "e", None, "s")], "key string, etag string, last_modified string, content_sha string")
    new = spark.createDataFrame([("k1", "u", "e", None, "s"), ("k2", "u", "e", None, "s"), ("k3", "u", None, None, None)],
                                "key string, url string, etag string, last_modified string, content_sha string")
    assert {r.key: r.change for r in INC.diff(prior, new).collect()} == {"k1": "changed", "k2": "unchanged", "k3": "new"}


def test_author_documents_are_linked(spark):
    rows = [(f"Ann {i % 2}", f"k{i:03}", 0, "p.html", "t", "", "e") for i in range(25)] + [("../x", "k", 0, "p", "<", "", "")]
    ap = spark.createDataFrame(rows, "author string, key string, pos int, path string, title string, ts string, excerpt string")
    docs = {r.path: r for r in A.author_pages(ap, chunk=5).collect()}
    index = A.author_index(ap)
    slugs = {r.author: r.slug for r in index.collect()}
    assert set(slugs.values()) <= set(docs) and docs[slugs["Ann 0"]].n_items == 5
    assert sum(r.n_items for r in docs.values()) == 26
    directory = A.author_directory(index, chunk=2).collect()
    assert sorted(r.path for r in directory) == ["authors/index-2.html", "authors/index.html"]
    for r in [*docs.values(), *directory]:
        for ref in re.findall(r'rel="(?:next|prev)" href="../([^"]*)"', r.content):
            assert ref in docs or ref in {d.path for d in directory}


def test_paths_are_unique(spark):
    urls = spark.createDataFrame([("https://h/a", "a.html"), ("https://h/a.html", "a.html"), ("https://h/", "index.html"), ("https://h/b", "b.html")],
                                 "url string, path string")
    got = {r.url: r.path for r in L.unique_paths(urls).collect()}
    assert got["https://h/a"] == "a.html" and got["https://h/b"] == "b.html" and len(set(got.values())) == 4
    assert got["https://h/"] != "index.html" and got["https://h/"].endswith(".html")


def test_shift_is_safe_for_all_characters(spark):
    df = spark.createDataFrame([("βγ\U0001f601",), ("\x01",), ("",)], "t string")
    assert [r.s for r in df.select(PII.shift_chars(F.col("t"), -1).alias("s")).collect()] == ["αβ\U0001f600", None, ""]


def test_topic_collapse(spark):
    rows = [("https://forum.example.org/board/topic/7/page/2", "k1", "Spring fair", dt.datetime(2024, 6, 20)),
            ("https://forum.example.org/board/topic/7/page", "k2", "Spring", dt.datetime(2024, 6, 13)),
            ("https://forum.example.org/board/topic/8/page", "k3", "Late news", dt.datetime(2024, 7, 1)),
            ("https://forum.example.org/board/cat/4/page", "k4", "Events", None)]
    df = spark.createDataFrame(rows, "url string, key string, label string, date timestamp_ntz")
    df = df.withColumn("path", F.concat(F.col("key"), F.lit(".html")))
    c = IX.classify(df, FORUM)
    t = {r.group_id: r for r in IX.topic_index(c).collect()}
    assert t["7"].n_pages == 2 and t["7"].path == "k2.html" and t["7"].label == "Spring fair"
    assert t["7"].date == dt.datetime(2024, 6, 13)
    assert t["8"].rank == 1 and t["7"].rank == 2
    cats = IX.category_index(c).collect()
    assert [r.group_id for r in cats] == ["4"]

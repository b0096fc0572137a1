"""The page node table against the standard library's parser."""

import random
from html.parser import HTMLParser

from pyspark.sql import functions as F

from pagelake.operators import nodes as N

PARTS = ["<div>", "</div>", "<DIV class='a>b'>", "</div >", "<ul>", "</ul>", "<li>", "</li>", "<p>", "<b>", "</b>", "<i>", "</i>", "<br>", "<img src=x>",
         "text ", "a &amp; b", "1 < 2", "<!-- <div> -->", "<script>if (a < b) '<div>'</script>", "<style>p > a {}</style>", "\n", "<a href=\"/x?a=1>2\">", "</a>"]


class Reference(HTMLParser):
    """Elements as (name, place of the start tag, place behind the end tag or None), in characters."""

    def __init__(self, html):
        super().__init__(convert_charrefs=False)
        self.starts = [0]
        for line in html.split("\n"):
            self.starts.append(self.starts[-1] + len(line) + 1)
        self.open, self.elements = {}, []
        self.feed(html)
        self.close()

    def place(self):
        line, column = self.getpos()
        return self.starts[line - 1] + column

    def handle_starttag(self, tag, attrs):
        at = self.place()
        if tag in N.VOID or tag in N.WHOLE:
            self.elements.append([tag, at, at])
            return
        self.elements.append([tag, at, None])
        self.open.setdefault(tag, []).append(self.elements[-1])

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag):
        if self.open.get(tag) and tag not in N.WHOLE:
            self.open[tag].pop()[2] = self.place()


def table(spark, pages):
    """Nodes of each page by number, with the place of each token in characters."""
    df = spark.createDataFrame(list(enumerate(pages)), "n int, html string").repartition(3)
    out = {}
    for r in N.tree(df, "n").collect():
        out.setdefault(r["row"], []).append(r)
    got = {}
    for rows in out.values():
        rows.sort(key=lambda r: -1 if r["pos"] is None else r["pos"])
        at, places = 0, []
        for r in rows:
            places.append(at)
            at += len(r["token"] or "")
        got[rows[0]["n"]] = (rows, [*places, at])
    return got


def test_elements_are_those_of_the_standard_parser(spark):
    rnd = random.Random(5)
    pages = ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    got = table(spark, pages)
    assert len(got) == len(pages)
    for n, html in enumerate(pages):
        rows, places = got[n]
        assert "".join(r["token"] or "" for r in rows) == html
        want = [tuple(e) for e in Reference(html).elements]
        mine = []
        for r in rows:
            if r["kind"] == N.START:
                alone = r["name"] in N.VOID or r["name"] in N.WHOLE
                end = places[r["pos"]] if alone else places[r["stop"] - 1] if r["closed"] else None
                mine.append((r["name"], places[r["pos"]], end))
        assert mine == want, html


def test_unclosed_elements_end_with_what_is_around_them(spark):
    pages = ["<div><p>a<ul><li>b<li>c</ul>d</div>e<p>f", "</b><i>x</b>y", "<b><i>x</b>y</i>z"]
    got = table(spark, pages)
    stops = [[(r["name"], r["pos"], r["stop"], r["depth"], r["parent"]) for r in got[n][0] if r["kind"] == N.START] for n in range(3)]
    assert stops[0] == [("div", 0, 11, 0, None), ("p", 1, 10, 1, 0), ("ul", 3, 9, 1, 0), ("li", 4, 8, 2, 3), ("li", 6, 8, 2, 3), ("p", 12, N.PAGE_END, 0, None)]
    assert stops[1] == [("i", 1, N.PAGE_END, 0, None)]
    assert stops[2] == [("b", 0, 4, 0, None), ("i", 1, 6, 1, 0)]


def test_depth_and_parent_of_nested_elements(spark):
    html = "<div><ul><li><a>x</a></li><li>y</li></ul><br>z</div>w"
    rows, _ = table(spark, [html])[0]
    by = {r["token"]: (r["depth"], r["parent"]) for r in rows if r["kind"] in (N.START, N.TEXT)}
    assert by == {"<div>": (0, None), "<ul>": (1, 0), "<li>": (2, 1), "<a>": (3, 2), "x": (4, 3), "y": (3, 7), "<br>": (1, 0), "z": (1, 0), "w": (0, None)}


def test_odd_pages(spark):
    pages = [None, "", "<", "a<b", "<div", "<!--", "<a href='x", "&lt;", "<p/>x</p>", "<script>", "< div>x</ div>", "x" * 200000, "<b>" * 3000 + "y" + "</b>" * 3000,
             "<a title=\"" + "q" * 100000 + "\">z</a>"]
    got = table(spark, pages)
    assert len(got) == len(pages)
    for n, html in enumerate(pages):
        assert "".join(r["token"] or "" for r in got[n][0]) == (html or "")
    assert all(r["closed"] for r in got[12][0] if r["kind"] == N.START)


def test_equal_rows_stay_apart(spark):
    html = "<ul><li class='k'>a</li></ul>"
    df = spark.createDataFrame([(1, html)] * 3 + [(2, html)], "page_id long, html string")
    rows = N.node_arrays(df, "page_id").select("page_id", F.size("nodes").alias("k"), N.text_of(
        N.first_block(F.col("nodes"), "<li")).alias("t")).collect()
    assert sorted((r.page_id, r.k, r.t) for r in rows) == [(1, 5, "a")] * 3 + [(2, 5, "a")]
    assert N.node_arrays(df.limit(0), "page_id").count() == 0


def test_pages_are_read_within_their_rows(spark, capsys):
    """Tokens are neither exchanged nor sorted between pages: a task holds those of one page."""
    from pagelake.operators import extract as X
    from pagelake.operators import privacy as PR
    from pagelake.profile import FORUM
    df = spark.createDataFrame([(1, "https://a.example/", "<b>x</b>")], "page_id long, url string, html string")
    for job in (N.nodes(df, "page_id"), N.node_arrays(df, "page_id"), X.attachment_edges(df, FORUM), X.categories(df, FORUM),
                X.posts(df, FORUM), PR.strip_blocks(df, FORUM)):
        job.explain()
        plan = capsys.readouterr().out
        assert plan.count("Exchange") == 1 and not any(x in plan for x in ("Window", "Sort ", "Aggregate")), plan


def test_long_pages_take_steps_in_proportion(spark):
    """A pass over an array copies a bounded part of it at each step."""
    n = 20000
    df = spark.createDataFrame([("<i>" * n + "<b>x</b>" + "</i>" * (n - 1),)], "html string")
    ns = N.nodes(df).agg(F.count("*").alias("n"), F.count_if("closed").alias("closed"), F.max("depth").alias("depth"),
                         F.min(F.when(F.col("name") == "i", F.col("stop"))).alias("stop")).first()
    assert tuple(ns) == (2 * n + 2, n, n, n + 4)


def test_running_states(spark):
    xs = F.transform(F.sequence(F.lit(1), F.col("n")), lambda x: x.cast("int"))
    for n in (1, N.RUN - 1, N.RUN, N.RUN + 1, 5 * N.RUN + 3):
        df = spark.createDataFrame([(n,)], "n int")
        got = df.select(N.running(xs, F.lit(0), lambda s, x: s + x).alias("r")).first()["r"]
        assert got == [i * (i + 1) // 2 for i in range(1, n + 1)]
    none = spark.range(1).select(N.running(F.array().cast("array<int>"), F.lit(0), lambda s, x: s + x).alias("r")).first()
    assert none["r"] == []

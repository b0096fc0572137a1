"""Page node table: the tree of a page as rows with intervals (EXT-5/6/8/10, PRV-3).

One pass of one pattern cuts a page's markup into tokens: comments, scripts and styles whole,
tags, and the text between.  A token's number is its place.  An element reaches from its start
tag's place to ``stop``, the place behind its end tag, so that what an element holds is what
stands between (``pos`` < place < ``stop``): no selector has to look for an end again.

End tags are found by prefix sums.  Over the tags of one name, start tags count +1 and
end tags -1, never below 0: the sum is the tag's level, and the start tag of a level is closed by the
next tag of that name and level.  End tags that close nothing are left as they are.  An
element that is never closed ends where the closed element around it does, else with the
page; elements without content (``br``, ``img``, ...) end at once.  So crossed tags both
reach to their own end tags.

All of this is done within the page's row, by sorted arrays and passes over them: a task holds the
tokens of one page, and none are exchanged or sorted between pages.  The work on a page is that of
sorting its tokens.  Pages are dealt out once, by the page's row.  Rows of equal content stay
apart.  A null page has no tokens.  ``page_nodes`` gives the array, ``nodes`` its rows, ``tree`` the
rows with parent, ``node_arrays`` one array a page for jobs that cut blocks out of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import html as H
from ..functions.urls import let

_NAME = "[A-Za-z][^\\s/>]*+"
#: Attributes of a tag; a '>' inside quotes does not end it.
_REST = r"""[^'">]*+(?:(?:"[^"]*+"|'[^']*+')[^'">]*+)*+"""
_PLAIN = r"[^<]*+(?:<(?![A-Za-z/!?])[^<]*+)*+"
#: Every character of a page belongs to one match: a comment, a script or style, a tag, text, or a broken rest.
TOKEN = "(?is)" + "|".join([
    r"<!--.*?(?:-->|\z)",
    rf"<(script|style)(?=[\s/>]){_REST}>.*?(?:</\1\s*>|\z)",
    rf"</?{_NAME}{_REST}>",
    r"<[!?/][^>]*+>",
    rf"[^<]{_PLAIN}",
    rf"<(?![A-Za-z/!?]){_PLAIN}",
    r"<[^<]*+"])

# Elements that hold nothing (HTML standard), and those read as one token.
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr")
WHOLE = ("script", "style")
#: Behind the last token of any page.
PAGE_END = (1 << 31) - 1

START, END, TEXT = 1, -1, 0


def token_array(html: Column) -> Column:
    """All tokens of a page, in order; joined they are the page again."""
    return F.regexp_extract_all(html, F.lit(TOKEN), F.lit(0))


def start_tags(html: Column, *names: str) -> Column:
    """Start tags of these elements, in document order; none from comments, scripts and styles."""
    return F.filter(token_array(html), lambda t: t.rlike(f"(?i)^<(?:{'|'.join(names)})[\\s/>]"))


#: Elements that are put together to one array before the next is begun: an array that grows is copied.
RUN = 64


def running(xs: Column, zero: Column, step) -> Column:
    """The states of a pass over an array: ``step(state, x)`` for each element, from the state before it
    (``zero``, whose type all have).  The copies made are RUN / 2 an element, not half the array."""
    last = lambda a: F.get(a, F.size(a) - 1)

    def go(all_):
        starts = F.sequence(F.lit(1), F.greatest(F.size(all_), F.lit(1)), F.lit(RUN))
        runs = F.aggregate(starts, F.array(F.array(zero)), lambda runs, at: F.concat(runs, F.array(F.aggregate(
            F.slice(all_, at, RUN), F.array(last(last(runs))), lambda run, x: F.concat(run, F.array(step(last(run), x)))))))
        return F.flatten(F.transform(runs, lambda r: F.slice(r, 2, RUN)))  # a run begins with the state before it
    return let(xs, go)


def _int(x) -> Column:
    return (x if isinstance(x, Column) else F.lit(x)).cast("int")


def _tokens(html: Column) -> Column:
    """token, name (of a tag, lower-cased), kind (START, END, TEXT; null for comments and broken tags) of every token."""
    def one(token):
        kind = (F.when(token.rlike(r"(?s)^</?[A-Za-z].*>\z"), F.when(token.startswith("</"), END).otherwise(START))
                .when(~token.rlike("^<[A-Za-z/!?]"), TEXT))
        return let(kind, lambda k: F.struct(token.alias("token"), F.when(
            k != TEXT, F.lower(F.regexp_extract(token, f"^</?({_NAME})", 1))).alias("name"), _int(k).alias("kind")))
    return F.transform(token_array(html), one)


def _partners(ts: Column) -> Column:
    """By place: step (+1 start, -1 end tag, else 0) and partner, the place of the tag that closes a start
    tag or that an end tag closes."""
    step = lambda t: F.when(t["name"].isNull() | t["name"].isin(*VOID, *WHOLE), 0).otherwise(F.coalesce(t["kind"], F.lit(0)))
    named = F.sort_array(F.transform(ts, lambda t, i: F.struct(
        F.coalesce(t["name"], F.lit("")).alias("name"), _int(i).alias("pos"), _int(step(t)).alias("step"))))
    # of the tags of one name: how many are open, never below 0
    zero = F.struct(F.lit("").alias("name"), _int(-1).alias("pos"), _int(0).alias("step"), _int(0).alias("open"))
    opened = running(named, zero, lambda s, x: F.struct(x["name"].alias("name"), x["pos"].alias("pos"), x["step"].alias(
        "step"), F.greatest(F.lit(0), F.when(s["name"] == x["name"], s["open"]).otherwise(0) + x["step"]).alias("open")))
    levels = F.sort_array(F.transform(opened, lambda s: F.struct(
        s["name"].alias("name"), (s["open"] + F.when(s["step"] == END, 1).otherwise(0)).alias("level"), s["pos"].alias("pos"), s["step"].alias("step"))))

    def pair(all_):
        def of(x, i):
            other = F.get(all_, _int(i) + x["step"])
            both = (x["step"] != 0) & (other["name"] == x["name"]) & (other["level"] == x["level"]) & (other["step"] == -x["step"])
            return F.struct(x["pos"].alias("pos"), x["step"].alias("step"), F.when(both, other["pos"]).alias("partner"))
        return F.sort_array(F.transform(all_, of))
    return let(levels, pair)


def _arounds(ps: Column, depth: Column) -> Column:
    """By place: where the innermost closed element around it ends, as far as one begun at its depth."""
    rows = F.sort_array(F.transform(ps, lambda p, i: F.struct(F.get(depth, _int(i)).alias("open"), p["pos"].alias("pos"), F.when(
        p["step"] == START, p["partner"]).alias("ends"))))
    zero = F.struct(_int(0).alias("open"), _int(-1).alias("pos"), F.lit(None).cast("int").alias("ends"))
    found = running(rows, zero, lambda s, x: F.struct(x["open"].alias("open"), x["pos"].alias("pos"), F.coalesce(
        x["ends"], F.when(s["open"] == x["open"], s["ends"])).alias("ends")))
    by_place = F.sort_array(F.transform(found, lambda s: F.struct(s["pos"].alias("pos"), s["ends"].alias("ends"))))
    return F.transform(by_place, lambda x: x["ends"])


def page_nodes(html: Column) -> Column:
    """The nodes of a page by place: pos, token, name, kind, and for start tags ``stop``, the place behind
    the element (its end tag is at stop - 1 where ``closed``); depth, the closed elements around it."""
    def build(ts, ps, opens, arounds):
        def one(t, i):
            p, opened, around = F.get(ps, _int(i)), F.get(opens, _int(i)), F.get(arounds, _int(i))
            closed = (p["step"] == START) & p["partner"].isNotNull()
            rest = F.when((opened > 0) & (around > i), around).otherwise(F.lit(PAGE_END))
            stop = F.when(t["kind"] == START, F.when(p["step"] == 0, i + 1).when(closed, p["partner"] + 1).otherwise(rest))
            return F.struct(_int(i).alias("pos"), t["token"].alias("token"), t["name"].alias("name"), t["kind"].alias("kind"),
                            _int(stop).alias("stop"), closed.alias("closed"), _int(opened - F.when(closed, 1).otherwise(0)).alias("depth"))
        return F.transform(ts, one)

    def with_partners(ts, ps):
        # closed elements alone: how many are open
        opens = running(ps, _int(0), lambda s, p: s + F.when(p["partner"].isNotNull(), p["step"]).otherwise(0))
        unclosed = F.exists(ps, lambda p: (p["step"] == START) & p["partner"].isNull())
        return let(opens, lambda o: let(F.when(unclosed, _arounds(ps, o)), lambda a: build(ts, ps, o, a)))

    return let(_tokens(html), lambda ts: let(_partners(ts), lambda ps: with_partners(ts, ps)))


def dealt(pages: DataFrame, *keep: str) -> DataFrame:
    """The pages with their number, ``row``, dealt out by it to as many tasks as a shuffle has: few
    bytes are much work here, so that they are not to be merged by their size."""
    n = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pages.select(F.monotonically_increasing_id().alias("row"), *keep, *({"html"} - set(keep))).repartition(n, "row")


def nodes(pages: DataFrame, *keep: str) -> DataFrame:
    """row, ``keep`` and the columns of ``page_nodes``, one row a node.  A page without tokens has one
    row with null in all other columns."""
    return dealt(pages, *keep).select("row", *keep, F.inline_outer(page_nodes(F.col("html"))))


def tree(pages: DataFrame, *keep: str) -> DataFrame:
    """``nodes`` with depth, the number of closed elements around a node, and parent, the place of
    the innermost of them (null: none)."""
    n = nodes(pages, *keep)
    # an element stands among its siblings, and once more among what it holds
    own = n.withColumn("_holds", F.array(F.struct(F.col("depth").alias("at"), F.lit(False).alias("self")), F.struct(
        (F.col("depth") + 1).alias("at"), F.lit(True).alias("self"))))
    both = own.withColumn("_h", F.explode(F.when(F.col("closed"), F.col("_holds")).otherwise(F.slice("_holds", 1, 1))))
    w = Window.partitionBy("row", "_h.at").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parent = F.last(F.when(F.col("_h.self"), F.col("pos")), ignorenulls=True).over(w)
    return both.withColumn("parent", F.when(F.col("depth") > 0, parent)).where(~F.col("_h.self")).drop("_holds", "_h")


def is_tag(token: Column, start_tag: str) -> Column:
    """Whether a token is a start tag that the profile's pattern names."""
    return F.coalesce(token.rlike(f"(?is)^{start_tag}"), F.lit(False))


def in_blocks(nodes: Column, block) -> Column:
    """By place: whether a node stands inside an element for which ``block`` holds, its own tags
    included; null for all if there is no such element."""
    reach = lambda s, x: F.greatest(s, F.when((x["kind"] == START) & block(x), x["stop"]))
    held = F.exists(nodes, lambda x: (x["kind"] == START) & block(x))
    return F.when(held, F.transform(running(nodes, _int(0), reach), lambda r, i: i < r))


def outside_blocks(nodes: Column, block) -> Column:
    """The nodes that stand in no element for which ``block`` holds."""
    return let(in_blocks(nodes, block), lambda inside: F.filter(nodes, lambda x: ~F.coalesce(F.get(inside, x["pos"]), F.lit(False))))


def node_arrays(pages: DataFrame, *keep: str) -> DataFrame:
    """One row a page: ``keep`` and its nodes by place (pos, stop, name, token of a start tag, text of
    a text, decoded and trimmed)."""
    one = lambda x: F.struct(x["pos"].alias("pos"), x["stop"].alias("stop"), x["name"].alias("name"), F.when(
        x["kind"] == START, x["token"]).alias("token"), F.when(x["kind"] == TEXT, H.trim_ws(H.decode_entities(x["token"]))).alias("text"))
    found = F.transform(F.coalesce(page_nodes(F.col("html")), F.array()), one)
    return dealt(pages, *keep).select(*keep, found.alias("nodes"))


# ---- within an array of nodes, whose first one stands at place nodes[0].pos
def cut(nodes: Column, of: Column) -> Column:
    """The element ``of`` and all it holds, from an array that starts at a smaller or equal place."""
    first = F.get(nodes, F.lit(0))["pos"]
    return F.slice(nodes, of["pos"] - first + 1, F.least(of["stop"] - of["pos"], F.size(nodes)))


def elements(nodes: Column, start_tag: str) -> Column:
    """Start tags within an array of nodes that a pattern names."""
    return F.filter(nodes, lambda x: is_tag(x["token"], start_tag))


def first_block(nodes: Column, start_tag: str) -> Column:
    """The first element that a pattern names, with all it holds; null if there is none."""
    return let(nodes, lambda all_: let(F.get(elements(all_, start_tag), F.lit(0)), lambda x: F.when(x.isNotNull(), cut(all_, x))))


def text_of(nodes: Column, sep: str = "") -> Column:
    """P-16: visible texts joined by ``sep``; null stays null."""
    return F.array_join(F.transform(F.filter(nodes, lambda x: F.coalesce(x["text"] != "", F.lit(False))), lambda x: x["text"]), sep)


def attrs(nodes: Column, tag: str, name: str) -> Column:
    """Non-empty values of an attribute on all elements of a name within an array of nodes."""
    own = F.filter(nodes, lambda x: F.coalesce((x["name"] == tag) & x["token"].isNotNull(), F.lit(False)))
    return F.filter(F.transform(own, lambda x: H.attr(x["token"], name)), lambda v: v != "")

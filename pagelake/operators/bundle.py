"""Offline bundle as a parquet table of entries (SNK-5, SNK-6, JOIN-11, PUB-3).

Entries: rewritten pages, assets, author documents and the home index.  The
home index lists topics, categories and other pages, at most ``INDEX_CHUNK``
entries a document, each document linked with the next, so that no row has to
hold every topic of a very large archive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from ..functions import text as T
from .authors import document_path, part_links
from .index import display_date
from .order import global_rank

#: Entries of one document of the home index.
INDEX_CHUNK = 1000
ENTRY_COLS = ("path", "title", "mimetype", "content", "is_front")
SECTIONS = ("topic", "category", "other")
HEADINGS = {"topic": "Topics", "category": "Categories", "other": "Other pages"}


def entries(path: Column, title: Column, content: Column, mimetype: Column | str = "text/html", front: bool = True) -> list[Column]:
    kind = F.lit(mimetype) if isinstance(mimetype, str) else mimetype
    return [path.alias("path"), title.alias("title"), kind.alias("mimetype"), content.alias("content"), F.lit(front).alias("is_front")]


def page_entries(rewritten: DataFrame) -> DataFrame:
    """(path, title, url, html) -> entries; rows without a path are skipped."""
    return rewritten.where(F.col("path").isNotNull()).select(*entries(
        F.col("path"), F.coalesce("title", "url"), F.encode("html", "UTF-8")))


def asset_entries(assets: DataFrame) -> DataFrame:
    """(path, content_type, content) -> entries that are no front pages."""
    kind = F.coalesce("content_type", F.lit("application/octet-stream"))
    return assets.select(*entries(F.col("path"), F.col("path"), F.col("content"), kind, front=False))


def document_entries(documents: DataFrame) -> DataFrame:
    """(path, title, content) of generated documents -> entries."""
    return documents.select(*entries(F.col("path"), F.col("title"), F.encode("content", "UTF-8")))


def home_index(topics: DataFrame, categories: DataFrame, others: DataFrame) -> DataFrame:
    """SET-4: the three ranked sections as one list: pos, section, path, label, date, n_pages."""
    def part(df, i, date, n):
        return df.select(F.lit(i).alias("s"), F.col("rank").alias("r"), "path", "label", date.alias("date"), n.alias("n_pages"))

    none = F.lit(None).cast("timestamp_ntz")
    rows = (part(topics, 0, F.col("date").cast("timestamp_ntz"), F.col("n_pages"))
            .unionByName(part(categories, 1, none, F.col("n_pages")))
            .unionByName(part(others, 2, none, F.lit(1).cast("bigint"))))
    ranked = global_rank(rows, F.col("s"), F.col("r"), name="pos")
    names = F.array(*[F.lit(s) for s in SECTIONS])
    return ranked.select("pos", F.get(names, F.col("s")).alias("section"), "path", "label", "date", "n_pages")


def home_documents(index: DataFrame, totals: DataFrame, title: str, authors: bool = False, chunk: int = INDEX_CHUNK) -> DataFrame:
    """PUB-3: documents (path, title, content) of at most ``chunk`` entries of the
    home index; the first one also states the totals and links to the authors."""
    note = F.concat_ws(", ", F.when(F.col("date").isNotNull(), display_date(F.col("date"))),
                       F.when(F.col("n_pages") > 1, F.concat(F.col("n_pages").cast("string"), F.lit(" pages"))))
    entry = F.concat(F.lit('<tr><td><a href="'), T.html_escape(F.col("path")), F.lit('">'), T.html_escape(F.col("label")),
                     F.lit("</a><td>"), note, F.lit("</tr>"))
    c = index.withColumn("chunk", F.floor((F.col("pos") - 1) / chunk).cast("bigint"))
    g = c.groupBy("chunk", "section").agg(
        F.min("pos").alias("first"), F.array_sort(F.collect_list(F.struct("pos", entry.alias("e")))).alias("items"))
    heading = F.element_at(F.create_map(*[F.lit(x) for kv in HEADINGS.items() for x in kv]), F.col("section"))
    table = F.concat(F.lit("<h2>"), heading, F.lit("</h2><table>"),
                     F.array_join(F.transform("items", lambda x: x["e"]), ""), F.lit("</table>"))
    d = g.groupBy("chunk").agg(F.array_sort(F.collect_list(F.struct("first", table.alias("t")))).alias("tables"))
    n = F.concat(F.lit("<p>"), F.concat_ws(", ", *[F.concat(F.col(c).cast("string"), F.lit(" " + c[2:])) for c in
                 ("n_pages", "n_topics", "n_categories", "n_other")]), F.lit("</p>"))
    head = totals.select(n.alias("said"), (F.floor((F.col("n_topics") + F.col("n_categories") + F.col("n_other") - 1)
                                                   / chunk)).cast("bigint").alias("last"), F.lit(0).alias("_z"))
    d = d.withColumn("_z", F.lit(0)).join(F.broadcast(head), "_z")  # totals are one row
    first = F.lit("index.html")
    extra = F.lit('<p><a href="authors/index.html">Authors</a></p>' if authors else "")
    return d.select(
        document_path(first, F.col("chunk")).alias("path"), F.lit(title).alias("title"),
        F.concat(F.lit("<!doctype html><title>"), T.html_escape(F.lit(title)), F.lit("</title>"),
                 F.when(F.col("chunk") == 0, F.concat("said", extra)).otherwise(F.lit("")),
                 F.array_join(F.transform("tables", lambda x: x["t"]), ""),
                 part_links(first, F.col("chunk"), F.col("last"))).alias("content"))


def write_parts(root: str, parts: dict[str, DataFrame], observed: dict[str, Observation]) -> dict[str, int]:
    """SNK-5 + AGG-10: append each part's entries to the bundle.  The number of its entries is
    observed as it is written (by the part's name); so are the metrics of ``observed``, whose
    observations the parts' plans hold.  No pass but the writing one."""
    totals = {}
    for name, part in parts.items():
        own = Observation(f"bundle-{name}")
        part.observe(own, F.count(F.lit(1)).alias(name)).write.mode("append").parquet(root)
        totals.update(own.get)
    for o in observed.values():
        totals.update(o.get)
    return totals


def main_path(page_map: DataFrame, main_url: str | None, default: str = "index.html") -> str:
    """JOIN-11: path of the main URL if it is archived, else the home index."""
    row = page_map.where(F.col("url") == main_url).select("path").first() if main_url else None
    return row["path"] if row else default


def verify(entries: DataFrame, main: str) -> DataFrame:
    """SNK-6: entries, paths that occur twice, and whether the main entry is there."""
    return entries.groupBy("path").count().agg(
        F.coalesce(F.sum("count"), F.lit(0)).alias("n_entries"), F.count_if(F.col("count") > 1).alias("n_twice"),
        F.coalesce(F.max(F.col("path") == main), F.lit(False)).alias("main_found")).withColumn("main_path", F.lit(main))


def check(verified: DataFrame) -> None:
    r = verified.first()
    if not r or r["n_entries"] == 0 or r["n_twice"] or not r["main_found"]:
        raise RuntimeError(f"bundle verification failed: {r}")

"""WARC archives (operator 10): writer with revisits, reader with chain verification.

Writing: one record a page; of pages with equal payloads the one with the
largest id is a response and the others refer to it.  Files hold whole records
and at most ``FILE_RECORDS`` of them; each is one gzip stream.

Reading: archives are cut at every occurrence of the version line, wherever it
stands, also inside payloads.  Each task turns its pieces into candidates: the
offset of the piece and, from its Content-Length, the offset of its successor.
A candidate is a record only if it can be reached from the start of its file.
Within a part of a file, up to ``PART`` candidates, the chains are followed at once; from
part to part pointers jump, doubling their reach each round, until nothing new is
reached.  Pieces that are not reached are parts of payloads and are put back there.

Payloads never leave the task that reads them, but for those that hold a
version line and thus have to be put together from several pieces.  A record has to fit a Spark
string, 2 GB; a longer one is not returned.

Defined results: a null payload is the empty one; a null page id or url is
written as an empty value and read back as null; of rows alike in payload and
largest id each is a response; a last record cut short, and all that stands
before the first version line or after a broken length, is not returned; an
empty table gives no rows; extra columns of pages are not archived.
"""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagelake.session import scratch_path

from . import common as C

MAGIC = "WARC/1.1\r\n"
BREAK = "\r\n\r\n"
URN = "urn:pagelake:page:"
FILE_RECORDS = 20_000
#: Candidates of a file whose chains one task follows; from one such part to the next pointers jump.
PART = 4096
#: Bytes that no record's block exceeds: a larger claim is a broken length.
LONGEST = 1 << 50
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def sha1_base32(c: Column) -> Column:
    """Upper-case base32 of the SHA-1: 160 bits as 60 + 60 + 40."""
    h = F.sha1(c)
    parts = [F.lpad(F.conv(F.substring(h, at, n), 16, 32), w, "0")
             for at, n, w in ((1, 15, 12), (16, 15, 12), (31, 10, 8))]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV",
                       "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def with_revisits(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``pages`` (page_id, url, html) with payload_bytes, payload_digest, refers_to."""
    pages = pages.select("page_id", "url", C.text_of("html").alias("html"))
    body = F.col("html").cast("binary")
    pages = pages.withColumn("payload_bytes", F.octet_length(body).cast("long"))
    pages = pages.withColumn("payload_digest", sha1_base32(body))
    same = (pages.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest")
            .agg(F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n"))
            .filter("_n > 1").select(F.col("payload_digest").alias("_d"), "_last"))
    other = F.col("_last").isNotNull() & ~F.col("_last").eqNullSafe(F.col("page_id"))
    return (pages.join(same, F.col("payload_digest") == F.col("_d"), "left")
            .withColumn("refers_to", F.when(other, F.col("_last"))).drop("_d", "_last"))


def record(revisit: Column) -> Column:
    """The bytes of one record."""
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit("\r\n"))
    urn = lambda c: F.concat(F.lit(f"<{URN}"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"),
                    F.lit("Content-Length: "), F.col("payload_bytes").cast("string"), F.lit(BREAK))
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("html")))
    url = F.replace(F.replace(F.coalesce("url", F.lit("")), F.lit("\r"), F.lit("%0D")),
                    F.lit("\n"), F.lit("%0A"))
    refers = F.concat(line("WARC-Refers-To", urn(F.col("refers_to"))),
                      line("WARC-Profile", F.lit(PROFILE)))
    return F.concat(
        F.lit(MAGIC), line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", urn(F.col("page_id"))), line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", url),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, refers).otherwise(F.lit("")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block).cast("string"), F.lit(BREAK), block, F.lit(BREAK))


def write_warc(pages: DataFrame, path: str, least_bytes: int = 0, compression: str = "gzip") -> None:
    """Archive files below ``path``; Spark's text writer ends each record with its own last byte."""
    rows = with_revisits(pages, least_bytes)
    data = record(F.col("refers_to").isNotNull())
    whole = rows.select(data.alias("value"))
    (whole.select(F.expr("substring(cast(value AS binary), 1, octet_length(value) - 1)")
                  .cast("string").alias("value"))
     .write.option("lineSep", "\n").option("compression", compression)
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between version lines: file, block, its order in the block, value."""
    raw = spark.read.option("lineSep", MAGIC).text(path)
    return raw.select(F.col("_metadata.file_path").alias("file"),
                      F.col("_metadata.file_block_start").alias("block"),
                      F.monotonically_increasing_id().alias("at"), "value")


def header(head: Column, name: str) -> Column:
    return F.regexp_extract(head, f"(?i)(?:^|\\r\\n){name}:[ \\t]*([^\\r\\n]*?)[ \\t]*(?:\\r\\n|$)", 1)


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """One narrow row a piece: where it stands, what its header claims, its payload's digest."""
    head = F.substring_index("value", BREAK, 1)
    p = pieces(spark, path).withColumn("size", F.octet_length("value").cast("long"))
    p = p.withColumn("head", F.when(F.instr("value", BREAK) > 0, head))
    p = p.withColumn("length", F.nullif(header(F.col("head"), "Content-Length"), F.lit("")))
    # what no file can hold is a broken length, also one that overflows
    p = p.withColumn("length", F.expr("try_cast(length AS bigint)"))
    p = p.withColumn("length", F.when(F.col("length").between(0, LONGEST), F.col("length")))
    own = F.octet_length("head") + 4 + F.col("length")
    p = p.withColumn("span", own + 4 + len(MAGIC))
    p = p.withColumn("whole", F.col("size") == own + 4)
    block = F.expr("substring(cast(value AS binary), octet_length(head) + 5, try_cast(length AS int))").cast("string")
    p = p.select("file", "block", "at", "size", "span", "whole", "head", "length",
                 F.xxhash64("value").alias("hash"),
                 F.when(F.col("whole"), block).alias("http"))
    return C.materialised(p.select(
        "file", "block", "at", "size", "span", "whole", "length", "hash",
        header(F.col("head"), "WARC-Type").alias("record_type"),
        header(F.col("head"), "WARC-Record-ID").alias("record_id"),
        header(F.col("head"), "WARC-Target-URI").alias("uri"),
        header(F.col("head"), "WARC-Refers-To").alias("refers"),
        header(F.col("head"), "WARC-Payload-Digest").alias("claimed"),
        F.octet_length("head").alias("head_bytes"), *payload_columns()))


def payload_columns() -> list[Column]:
    """Of column ``http``, a record's block: its head's Content-Length, the payload's bytes and digest."""
    head = F.substring_index("http", BREAK, 1)
    body = F.expr("substring(cast(http AS binary), octet_length(substring_index(http, '\\r\\n\\r\\n', 1)) + 5)")
    return [header(head, "Content-Length").alias("http_length"),
            F.octet_length(body).cast("long").alias("body_bytes"), sha1_base32(body).alias("digest")]


def with_offsets(found: DataFrame) -> DataFrame:
    """Adds ``off``, where the version line before a piece begins, ``end``, the file's bytes, and
    ``part``, up to ``PART`` neighbours of a block."""
    step = F.col("size") + len(MAGIC)
    blocks = found.groupBy("file", "block").agg(F.sum(step).alias("bytes"))
    by_file = Window.partitionBy("file")
    blocks = blocks.select("file", "block", (F.sum("bytes").over(by_file) - len(MAGIC)).alias("end"),
                           (F.sum("bytes").over(by_file.orderBy("block")) - F.col("bytes")).alias("first"))
    here = Window.partitionBy("file", "block").orderBy("at")
    inside = F.sum(step).over(here) - step
    part = F.concat_ws("-", "block", F.floor((F.row_number().over(here) - 1) / PART))
    return (found.join(blocks, ["file", "block"]).withColumn("part", part)
            .withColumn("off", F.col("first") + inside - len(MAGIC)).drop("first"))


def exits(rows: pd.DataFrame) -> pd.DataFrame:
    """For each candidate of a part the first offset that its chain reaches beyond the part."""
    rows = rows.sort_values("off", ascending=False)
    to: dict[int, int | None] = {}
    last = rows["off"].iloc[0]
    for off, nxt in zip(rows["off"], rows["nxt"], strict=True):
        to[off] = None if pd.isna(nxt) else int(nxt) if nxt > last else to.get(int(nxt))
    out = rows.assign(leaves=pd.array([to[o] for o in rows["off"]], dtype="Int64"))
    return out[["file", "part", "off", "nxt", "leaves", "reached"]]


def walk(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a part on a chain from one that is reached."""
    nxt = dict(zip(rows["off"], rows["nxt"], strict=True))
    seen = set()
    for off in rows["off"][rows["reached"]]:
        while off in nxt and off not in seen:
            seen.add(off)
            off = nxt[off]
    on = rows[rows["off"].isin(seen)]
    return on[["file", "off"]]


def reachable(found: DataFrame) -> DataFrame:
    """(file, off) of the candidates on the chain from their file's start.

    Rounds: the logarithm of the parts that a chain crosses.
    """
    links = found.filter("off >= 0 AND span IS NOT NULL AND off + span <= end").select(
        "file", "part", "off", (F.col("off") + F.col("span")).alias("nxt"),
        (F.col("off") == 0).alias("reached"))
    schema = "file string, part string, off long, nxt long, leaves long, reached boolean"
    table = C.materialised(links.groupBy("file", "part").applyInPandas(exits, schema))
    reached = table.filter("reached").count()
    while reached:
        to = table.select(F.col("file").alias("_f"), F.col("off").alias("_o"),
                          F.col("leaves").alias("_leaves"))
        hit = (table.filter("reached AND leaves IS NOT NULL")
               .select(F.col("file").alias("_hf"), F.col("leaves").alias("_ho")).distinct())
        table = C.materialised(
            table.join(to, (F.col("file") == F.col("_f")) & (F.col("leaves") == F.col("_o")), "left")
            .join(hit, (F.col("file") == F.col("_hf")) & (F.col("off") == F.col("_ho")), "left")
            .select("file", "part", "off", "nxt", F.col("_leaves").alias("leaves"),
                    (F.col("reached") | F.col("_ho").isNotNull()).alias("reached")))
        before, reached = reached, table.filter("reached").count()
        if reached == before:
            break
    return table.groupBy("file", "part").applyInPandas(walk, "file string, off long")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row a record: file, off, record_type, record_id, uri, refers, claimed (its
    digest header), http_length, and body_bytes and digest of the payload it holds."""
    cols = ["file", "off", "record_type", "record_id", "uri", "refers", "claimed",
            "http_length", "body_bytes", "digest"]
    found = C.materialised(with_offsets(candidates(spark, path)))
    chain = reachable(found).withColumnsRenamed({"file": "_f", "off": "_o"})
    found = C.materialised(found.join(
        chain, (F.col("file") == F.col("_f")) & (F.col("off") == F.col("_o")), "left")
        .withColumn("is_record", F.col("_f").isNotNull()).drop("_f", "_o"))
    whole = found.filter("is_record AND whole").select(*cols)
    cut = found.filter("is_record AND NOT whole")
    if cut.isEmpty():
        return whole
    texts = assembled(spark, path, found)
    texts = texts.select("file", "owner", *payload_columns())
    texts = texts.withColumnRenamed("owner", "off")
    cut = cut.drop("http_length", "body_bytes", "digest").join(texts, ["file", "off"])
    return whole.unionByName(cut.select(*cols))


def assembled(spark: SparkSession, path: str, found: DataFrame) -> DataFrame:
    """file, owner, http: blocks of the records that were cut at version lines inside them."""
    mark = found.withColumn("start", F.when(F.col("is_record"), F.struct("off", "whole", "head_bytes", "length")))
    blocks = mark.groupBy("file", "block").agg(F.max("start").alias("last"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.max("last").over(before).alias("carried"))
    inside = Window.partitionBy("file", "block").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owned = (mark.withColumn("own", F.max("start").over(inside)).join(blocks, ["file", "block"])
             .withColumn("own", F.coalesce("own", "carried"))
             .filter("own IS NOT NULL AND NOT own.whole AND off < own.off + own.head_bytes + 8 + own.length")
             .select("file", "block", "hash", "size", "off", "own"))
    text = (pieces(spark, path)
            .select("file", "block", F.xxhash64("value").alias("hash"),
                    F.octet_length("value").cast("long").alias("size"), "value"))
    need = owned.select("file", "block", "hash", "size").distinct()
    text = text.join(need, ["file", "block", "hash", "size"], "left_semi")
    text = text.groupBy("file", "block", "hash", "size").agg(F.first("value").alias("value"))
    whole = owned.join(text, ["file", "block", "hash", "size"]).groupBy("file", "own").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", "value"))),
                                 lambda x: x["value"]), MAGIC).alias("all"))
    return whole.select("file", F.col("own.off").alias("owner"), F.expr(
        "substring(cast(all AS binary), own.head_bytes + 5, try_cast(own.length AS int))").cast("string").alias("http"))


def page_records(records: DataFrame) -> DataFrame:
    """The records of archived pages; bytes and digest are those of the full payload."""
    def page_id(c):
        return F.expr(f"try_cast(nullif(regexp_extract({c}, '<{URN}(-?[0-9]*)>', 1), '') AS bigint)")
    revisit = F.col("record_type") == "revisit"
    said = F.regexp_replace("claimed", "^sha1:", "")
    return records.select(
        page_id("record_id").alias("page_id"),
        F.when(revisit, F.expr("try_cast(http_length AS bigint)")).otherwise(F.col("body_bytes")).alias("payload_bytes"),
        F.when(revisit, said).otherwise(F.col("digest")).alias("payload_digest"),
        "record_type", page_id("refers").alias("refers_to"), "uri")


def query(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, f"warc-{uuid.uuid4().hex}")
    write_warc(C.read_table(spark, sf_dir, "pages", "page_id", "url", "html"), path)
    return page_records(read_warc(spark, path)).drop("uri")


ORACLE = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS last
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
     1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1), '' ORDER BY i)
   FROM range(32) r(i)) AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> last THEN last END AS refers_to
FROM p
"""

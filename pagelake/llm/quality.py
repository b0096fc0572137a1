"""Quality rules (operator 2): counted rules, then a hashed n-gram likelihood ratio.

Words and pairs of neighbouring words are hashed into ``BUCKETS`` buckets.  Two
multinomials over the buckets are counted: one from every document, one from
the trusted ones.  A document's verdict is the sum of log(trusted / raw) over
its n-grams, divided by their number, against a fixed threshold.

Counts of the raw corpus come from all documents, those of the trusted ones
from all that are labelled good and not toxic, in a pass of its own: texts whose
id is in a bitmap of the trusted ids, which has one size whatever the corpus is,
are exchanged and joined with the ids by value, the same way at every size.  The
counts, one number a bucket, are the only thing that reaches the driver.  Repeats
are found within a row.  Native DataFrame code.

Defined results: null and empty texts have no words and fail; a null id is
never trusted; repeated rows are judged one by one; without any trusted
document the ratio is 0 for all and only the counted rules decide; an empty
table gives no rows; extra columns are not carried on.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common as C

BUCKETS = 1 << 14
#: Bits of the bitmap of trusted ids, 2 MB.
BITS = 1 << 24
SMOOTH = 1.0
THRESHOLD = -0.15
LEAST_WORDS = 20
WINDOW = 8
SYMBOLS = "#*$%&|<>"


def grams() -> Column:
    """Bucket of each word and of each pair of neighbours, from the words' hashes."""
    one = f"transform(words, x -> pmod(x, {BUCKETS}))"
    two = ("zip_with(slice(words, 1, greatest(size(words) - 1, 0)), slice(words, 2, greatest(size(words) - 1, 0)),"
           f" (x, y) -> pmod(xxhash64(x, y), {BUCKETS}))")
    return F.expr(f"concat({one}, {two})")


def with_words(docs: DataFrame) -> DataFrame:
    """Adds words: the 64-bit hash of each word; all else works on these."""
    return docs.withColumn("words", F.transform(C.words(C.text_of()), lambda w: F.xxhash64(w)))


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Ids of all documents labelled good and not toxic."""
    good = labels.filter("quality = 1 AND coalesce(toxic, 0) = 0 AND doc_id IS NOT NULL")
    return good.select("doc_id").distinct()


def perhaps_trusted(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose id has its bit in a bitmap of ``BITS`` bits, whatever the number of ids is:
    all trusted ones and, while the bitmap is not full, few others."""
    place = lambda c: F.pmod(F.xxhash64(c.cast("long")), F.lit(BITS))
    bits = (ids.select(place(F.col("_id")).alias("p"))
            .groupBy(F.bitmap_bucket_number("p").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("_bits")))
    at = docs.withColumn("_p", place(F.col("doc_id")))
    at = at.withColumn("_bucket", F.bitmap_bucket_number("_p")).withColumn("_p", F.bitmap_bit_position("_p"))
    byte = F.conv(F.hex(F.substring("_bits", F.shiftright("_p", 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = at.join(F.broadcast(bits), "_bucket")  # BITS / 8 bytes
    return found.where(byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), F.col("_p").cast("int") % 8)) != 0).drop("_bucket", "_p", "_bits")


def gram_counts(docs: DataFrame) -> dict[int, int]:
    rows = with_words(docs).select(F.explode(grams()).alias("b")).groupBy("b").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r["b"]: r["n"] for r in rows}


def log_ratios(docs: DataFrame, trusted: DataFrame) -> list[float]:
    """log(trusted share / raw share) of each bucket, smoothed."""
    ids = trusted.select(F.col("doc_id").alias("_id"))
    docs = docs.select("doc_id", "text")
    # a semi join would be moved in front of the bitmap; the ids are distinct
    good_docs = perhaps_trusted(docs, ids).join(ids.hint("merge"), F.col("doc_id") == F.col("_id")).select("text")
    raw_counts, good_counts = gram_counts(docs), gram_counts(good_docs)
    raw, good = ([of.get(b, 0) for b in range(BUCKETS)] for of in (raw_counts, good_counts))
    if not sum(good):
        return [0.0] * BUCKETS
    a, b = sum(good) + SMOOTH * BUCKETS, sum(raw) + SMOOTH * BUCKETS
    return [round(math.log((g + SMOOTH) / a) - math.log((r + SMOOTH) / b), 4)
            for g, r in zip(good, raw, strict=True)]


def repeat_words() -> Column:
    """Words covered by windows that occur twice or more, from the windows' hashes.

    Only rows that have such a window sort them; the sorted (hash, start) pairs
    give the starts of repeated ones, and each adds the words up to the next start.
    """
    starts = ("sort_array(transform(filter(s, (e, i) -> (i > 0 AND s[greatest(i - 1, 0)].h = e.h)"
              " OR (i + 1 < size(s) AND s[least(i + 1, size(s) - 1)].h = e.h)), e -> e.i))")
    pairs = "sort_array(transform(windows, (h, i) -> struct(h AS h, i AS i)))"
    covered = (f"aggregate(zip_with(p, slice(p, 2, greatest(size(p) - 1, 0)),"
               f" (a, b) -> least({WINDOW}, coalesce(b - a, {WINDOW}))), 0L, (n, x) -> n + x)")
    return F.expr(
        f"CASE WHEN size(array_distinct(windows)) < size(windows) THEN"
        f" transform(transform(array({pairs}), s -> {starts}), p -> {covered})[0] ELSE 0L END")


def counted(docs: DataFrame) -> DataFrame:
    """``docs`` (with words) and the counts of the base rules."""
    text = C.text_of()
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))
    windows = F.expr(f"CASE WHEN size(words) >= {WINDOW} THEN transform(sequence(1, size(words) - {WINDOW - 1}),"
                     f" i -> xxhash64(slice(words, i, {WINDOW}))) ELSE array() END")
    return (docs.withColumn("n_words", F.size("words").cast("long"))
            .withColumn("word_chars", F.length(F.translate(text, C.SPACES, "")).cast("long"))
            .withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
            .withColumn("lines", lines)
            .withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long"))
            .withColumn("windows", windows)
            .withColumn("n_repeat_words", repeat_words().cast("long"))
            .drop("lines", "windows"))


def judge_quality(docs: DataFrame, trusted: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, the counts, base_failed, kept and llr (per n-gram) of each row."""
    docs = docs.select("doc_id", "text")
    table = ",".join(map(str, log_ratios(docs, trusted)))
    ratios = F.split(F.lit(table), ",").cast("array<double>")
    total = F.aggregate("grams", F.lit(0.0), lambda s, b: s + F.get(ratios, b.cast("int")))
    rows = counted(with_words(docs)).withColumn("grams", grams())
    rows = rows.withColumn("llr", F.round(total / F.greatest(F.size("grams"), F.lit(1)), 6))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
                       failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "text")
    labels = C.read_table(spark, sf_dir, "labels", "doc_id", "quality", "toxic")
    return judge_quality(docs, trusted_ids(labels))

"""Fixtures shared by the tests of the training-data operators."""

import re

SF = "/root/testdata/sf0.001"
SPACE = re.compile("[\x20\x09-\x0d]+")
ODD = "doc_id long, text string, lang string, source string, n_chars long, size string, score string, _k string, h string, finish string"


def words(text):
    return [w for w in SPACE.split(text or "") if w]


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def odd_documents(spark, rows=None):
    """Nulls in every column, empty and long texts, ties, repeated rows, clashing names."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from all the other animals in the wood today"
    texts = [(1, base), (2, base), (2, base), (3, None), (4, ""), (None, base + " again"), (None, None), (5, "one two"),
             (6, "x " * 5000), (7, " \t\n\x0b\x0c\r "), (8, base.upper()), (9, "été 日本語 \U0001f600 " * 30),
             (10, base + "\n" + base), (10, "another text under the same id")]
    rows = texts if rows is None else rows
    return spark.createDataFrame(
        [(i, t, None if k % 3 else "en", f"s{k % 2}" if k % 5 else None, None if k % 4 else len(t or ""),
          "a", "b", "c", "d", "e") for k, (i, t) in enumerate(rows)], ODD)


def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")

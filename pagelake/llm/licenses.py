"""Licence scan (operator 1): positional index of licence notices, rarest words first.

Templates are short notices; the index holds, for each of their words, in
which template it stands and where.  How rare a word is (IDF) is counted over
all documents.  For each file and each template that enough of the file's
words belong to, the template's rarest words in the file are looked up; each
place of such a word proposes the place where the template would start, and
the proposals of the words are intersected.  A place is a match if enough of
the template's words stand there and every mandatory phrase stands whole
within it.  Phrases count only if all their words stand in a row, so all their
places are found.

The templates are broadcast with the code; what reaches the driver is one
count for each licence word.

Defined results: a null text is the empty one, without words or places; every
row is judged by itself, repeated ones too; an empty table gives no rows;
extra columns of the input are not carried on.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

#: Rare words that are looked up for a template in a file, at least.
LOOKED_UP = 3
#: Share of a notice's words that have to stand at their places.
COVERAGE = 0.7


@dataclass(frozen=True)
class Template:
    label: str
    text: str
    keys: tuple[str, ...] = ()
    phrase: bool = False


PHRASES = (Template("mit", "mit license", phrase=True),
           Template("apache", "apache license", phrase=True),
           Template("gpl", "general public license", phrase=True))

NOTICES = (
    Template("mit-notice", "released under the mit license", ("mit license",)),
    Template("mit-text", "permission is hereby granted free of charge to any person obtaining a copy of this software "
             "and associated documentation files", ("hereby granted free of charge",)),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    Template("gpl-2.0", "this work is licensed under the gnu general public license version 2",
             ("general public license version 2",)),
    Template("gpl-3.0", "this work is licensed under the gnu general public license version 3",
             ("general public license version 3",)),
    Template("lgpl", "licensed under the gnu lesser general public license", ("lesser general public license",)),
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3",
             ("affero general public license",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("bsd", "redistribution and use in source and binary forms with or without modification are permitted "
             "provided that the following conditions are met", ("source and binary forms",)),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0",
             ("mozilla public license",)),
    Template("isc", "permission to use copy modify and or distribute this software for any purpose with or without "
             "fee is hereby granted", ("with or without fee",)),
    Template("unlicense", "this is free and unencumbered software released into the public domain",
             ("unencumbered software", "public domain")),
)

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased (A-Z) runs of ASCII letters, digits and all that is not ASCII."""
    return (text or b"").translate(_WORD).split()


class Index:
    """Word -> (template, position), and each word's weight."""

    def __init__(self, templates, idf: dict[bytes, float] | None = None):
        self.templates = list(templates)
        self.words = [words_of(t.text.encode()) for t in self.templates]
        self.keys = [[words_of(k.encode()) for k in t.keys] for t in self.templates]
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for t, ws in enumerate(self.words):
            for at, w in enumerate(ws):
                self.postings.setdefault(w, []).append((t, at))
        self.vocabulary = frozenset(self.postings)
        self.idf = idf or {}

    def weight(self, w: bytes) -> float:
        return self.idf.get(w, 1.0)

    def places(self, words: list[bytes]) -> list[tuple[int, int, float]]:
        """(template, start, coverage) of every match in a file's words."""
        present = self.vocabulary.intersection(words)
        if not present:
            return []
        wanted: dict[bytes, set[int]] = {}
        for t, ws in enumerate(self.words):
            own = [w for w in dict.fromkeys(ws) if w in present]
            if sum(w in present for w in ws) < self.least(t) * len(ws):
                continue
            for w in sorted(own, key=lambda w: (-self.weight(w), w))[:self.looked_up(t)]:
                wanted.setdefault(w, set()).add(t)
        here: dict[bytes, list[int]] = {w: [] for w in wanted}
        for i, x in enumerate(words):
            if x in here:
                here[x].append(i)
        votes: dict[int, Counter] = {}
        for w, of in wanted.items():
            for t, at in self.postings[w]:
                if t in of:
                    votes.setdefault(t, Counter()).update(i - at for i in here[w])
        found = []
        for t, starts in votes.items():
            asked = sum(t in of for of in wanted.values())
            for start, n in starts.items():
                # a notice may lack some of its words, a phrase none
                if n >= (asked if self.templates[t].phrase else min(2, asked)):
                    share = self.coverage(t, start, words)
                    if share >= self.least(t) and self.has_keys(t, start, words):
                        found.append((t, start, share))
        return found

    def least(self, t: int) -> float:
        return 1.0 if self.templates[t].phrase else COVERAGE

    def looked_up(self, t: int) -> int:
        """So many words that a place which lacks as many as it may still has two of them."""
        return max(LOOKED_UP, int((1 - self.least(t)) * len(self.words[t]) + 1e-9) + 2)

    def coverage(self, t: int, start: int, words: list[bytes]) -> float:
        ws = self.words[t]
        return sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(ws)) / len(ws)

    def has_keys(self, t: int, start: int, words: list[bytes]) -> bool:
        span = words[max(0, start):start + len(self.words[t])]
        return all(any(span[i:i + len(k)] == k for i in range(len(span) - len(k) + 1)) for k in self.keys[t])


def word_weights(docs: DataFrame, index: Index) -> dict[bytes, float]:
    """IDF of the index's words over all of ``docs``."""
    vocabulary = index.vocabulary

    def count(batches):
        seen, n = Counter(), 0
        for b in batches:
            n += len(b)
            for text in b["text"]:
                seen.update(vocabulary.intersection(words_of(text)))
        yield pd.DataFrame({"word": [None, *seen], "n": [n, *seen.values()]})

    rows = (docs.select(F.col("text").cast("binary").alias("text")).mapInPandas(count, "word binary, n long")
            .groupBy("word").agg(F.sum("n").alias("n")).collect())
    n = {None if r["word"] is None else bytes(r["word"]): r["n"] for r in rows}
    total = n.pop(None, 0)
    return {w: math.log((1 + total) / (1 + n.get(w, 0))) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates=(*PHRASES, *NOTICES)) -> DataFrame:
    """doc_id, n_words and matches (label, phrase, start, words, coverage; in order) of each row."""
    index = Index(templates, word_weights(docs, Index(templates)))
    kind = pa.struct([("n_words", pa.int64()), ("matches", pa.list_(pa.struct(
        [("start", pa.int64()), ("words", pa.int64()), ("label", pa.string()), ("phrase", pa.bool_()),
         ("coverage", pa.float64())])))])

    @F.arrow_udf("struct<n_words: long, matches: array<struct<start: long, words: long, label: string,"
                 " phrase: boolean, coverage: double>>>")
    def scan(text: pa.Array) -> pa.Array:
        out = []
        for value in text:
            ws = words_of(value.as_py())
            out.append({"n_words": len(ws), "matches": [
                {"start": at, "words": len(index.words[t]), "label": index.templates[t].label,
                 "phrase": index.templates[t].phrase, "coverage": share}
                for t, at, share in sorted(index.places(ws), key=lambda m: (m[1], m[0]))]})
        return pa.array(out, type=kind)

    return docs.select("doc_id", scan(F.col("text").cast("binary")).alias("s")).select("doc_id", "s.*")


def query(spark, sf_dir: str) -> DataFrame:
    found = scan_licenses(C.read_table(spark, sf_dir, "documents", "doc_id", "text"))
    base = F.filter("matches", lambda m: m["phrase"])
    starts = F.transform(base, lambda m: m["start"])
    labels = lambda ms: F.array_join(F.array_sort(F.array_distinct(F.transform(ms, lambda m: m["label"]))), ",")
    score = F.coalesce(F.array_max(F.transform("matches", lambda m: m["coverage"])), F.lit(0.0))
    return found.select("doc_id", "n_words", F.size(base).cast("long").alias("n_base"),
                        F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
                        labels(base).alias("base_labels"), labels(F.col("matches")).alias("labels"),
                        score.alias("score"))

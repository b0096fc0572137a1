"""Corpus pipeline: from ``documents`` to a sharded training mix.

Each stage takes (spark, docs, sf_dir), works on all rows its predecessor kept
and returns their columns as they are; the last one adds shard and slot.
"""

from __future__ import annotations

import uuid

from pagelake.llm import classifier, decontam, mixing, neardup, sharding
from pagelake.llm.common import importable
from pagelake.session import scratch_path

SHINGLE = 5


def _table(spark, sf_dir, name):
    importable(spark)
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def quality(spark, docs, sf_dir):
    """Documents that the factorisation machine, fitted on the labels, does not reject."""
    machine = classifier.train(docs, _table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return docs.filter(classifier.score_of(docs, machine) >= classifier.CUT)


def near_duplicates(spark, docs, sf_dir):
    """One document of each group of near copies: five-word shingles, similarity 0.8."""
    importable(spark)
    return neardup.one_of_each(docs, shingle=SHINGLE)


def decontaminate(spark, docs, sf_dir):
    """Documents that hold no item of the benchmark."""
    return decontam.clean_documents(docs, _table(spark, sf_dir, "benchmark").select("item_id", "text"))


def mix(spark, docs, sf_dir):
    """Documents as the mix takes them: none, one or two copies of each, in the mix's order."""
    return mixing.mix_documents(docs, finish=None)


def shard(spark, docs, sf_dir):
    """All copies with their shard and slot."""
    importable(spark)
    return sharding.shard_documents(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate),
          ("mix", mix), ("shard", shard)]
ORACLE_SQL = None


def run(spark, sf_dir):
    """The stages applied to ``documents``, each written as Parquet and read again."""
    docs = _table(spark, sf_dir, "documents")
    base = scratch_path(spark, f"pipeline-{uuid.uuid4().hex}")
    for i, (name, stage) in enumerate(STAGES):
        out = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            out.write.parquet(f"{base}/{i}-{name}")
            out = spark.read.parquet(f"{base}/{i}-{name}")
        docs = out
    return docs

"""Mixing sources to target weights (operator 8): weighted fair queueing.

Every source is a queue of its shuffled documents, followed by the same
documents shuffled anew for the second round.  A copy's virtual finish time is
the source's cumulative tokens up to and with it, divided by the source's
target: it says which part of the source's target is served when it ends.  The
copies of all sources are range-sorted by that time, and the mix ends where
the total budget is used up.

The running sums never put a source into one task.  A source is cut into
buckets by the shuffle's hash (their number follows its rows), the buckets'
sums give each bucket its offset, and only rows of one bucket are summed one
by one.  The end of the budget is found in the same way: buckets of the finish
time first, then the rows of the one bucket where the budget ends.

Native DataFrame code.  Defined results: null text has size 0; a null source
is a source of its own, last in the order of weights; documents of size 0 take
0 words; repeated rows are mixed one by one; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
BUDGET = 1.5
MOST_ROUNDS = 2
BUCKET_ROWS = 2_000
TIME_BUCKETS = 4096


def source_targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET,
                   cap: float = MOST_ROUNDS) -> DataFrame:
    """Per source: its size, rows and target (one row a source).

    Shares follow the weights; a target stops at ``cap`` times the source's
    size, and what it leaves is shared again by weight until none is above.
    That end is found at once: sources are ordered by cap / weight, and the
    first n of them are capped, for the smallest n at which the next one's
    share is not above its cap.  The windows run over one row a source.
    """
    per = (sizes.groupBy("source")
           .agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("source_rows")))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    per = per.withColumn("weight", F.array(*[F.lit(float(w)) for w in weights])[
        F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))])
    per = per.withColumn("cap", F.col("source_size") * float(cap))
    every = Window.partitionBy(F.lit(0))
    by_level = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = (F.sum("source_size").over(every) * budget
            - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    weight_left = (F.sum("weight").over(every)
                   - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("level", left / weight_left)
    # levels rise up to the first source whose share its cap holds, then fall: that is the line
    fits = F.col("level") * F.col("weight") <= F.col("cap")
    per = per.withColumn("line", F.max(F.when(fits, F.col("level"))).over(every))
    target = F.least(F.col("cap"), F.coalesce(F.col("line") * F.col("weight"), F.col("cap")))
    return per.select("source", "source_size", "source_rows", target.alias("target"))


def running(df: DataFrame, keys: list[str], order: list[Column], value: str, out: str,
            bucket: str) -> DataFrame:
    """``out``: running sum of ``value`` within ``keys`` along ``bucket`` then ``order``.

    Only sums of buckets go through a window over the whole key.
    """
    sums = df.groupBy(*keys, bucket).agg(F.sum(value).alias("_in"))
    at = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(bucket)
    sums = sums.withColumn("_before", F.sum("_in").over(at) - F.col("_in")).drop("_in")
    sums = sums.withColumnsRenamed({k: f"_r_{k}" for k in [*keys, bucket]})
    on = [F.col(k).eqNullSafe(F.col(f"_r_{k}")) for k in [*keys, bucket]]
    here = Window.partitionBy(*keys, bucket).orderBy(*order)
    joined = df.join(sums, on).drop(*[f"_r_{k}" for k in [*keys, bucket]])
    summed = F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, 0))
    return joined.withColumn(out, F.col("_before") + summed).drop("_before")


def fair_queue(sizes: DataFrame, seed: int = 0, weights=WEIGHTS, budget: float = BUDGET,
               cap: int = MOST_ROUNDS) -> DataFrame:
    """One row for each copy that the mix takes: the columns of ``sizes``, its
    source's source_size and target, round and finish; ``finish`` orders the mix.

    ``sizes`` is what ``document_sizes`` gives.  The finish time is that of a
    copy's middle word, so that a source ends half a document from its target
    at most, above or below.
    """
    targets = source_targets(sizes, weights, budget, cap)
    total = targets.agg(F.sum("source_size"), F.sum("target")).first()
    most = min((total[0] or 0) * budget, total[1] or 0)
    rounds = F.explode(F.sequence(F.lit(0), F.lit(int(cap) - 1))).alias("round")
    t = targets.withColumnRenamed("source", "_s")
    queue = (sizes.filter(F.col("size") > 0).select("*", rounds)
             .join(t, F.col("source").eqNullSafe(F.col("_s"))).drop("_s"))
    # texts tell documents without an id apart
    shuffle = F.xxhash64("doc_id", F.when(F.col("doc_id").isNull(), F.col("text_id")), "round", F.lit(seed))
    n = F.ceil(F.col("source_rows") / BUCKET_ROWS)
    part = F.floor(F.shiftrightunsigned(shuffle, 33) * n / float(1 << 31))
    queue = (queue.withColumn("part", F.col("round") * n + part)
             .withColumn("at", F.shiftrightunsigned(shuffle, 1)))
    queue = running(queue, ["source"], [F.col(c) for c in ("at", "doc_id", "text_id", "size", "copy")],
                    "size", "served", "part")
    queue = queue.withColumn("finish", (F.col("served") - F.col("size") / 2) / F.col("target"))
    queue = (queue.filter(F.col("finish") <= 1)
             .withColumn("when", F.floor(F.col("finish") * TIME_BUCKETS))
             .drop("part", "at", "served", "source_rows"))
    return within_budget(C.materialised(queue), most).drop("when")


def within_budget(queue: DataFrame, most: float) -> DataFrame:
    """The first copies by finish time, as long as their middle lies within ``most``."""
    sums = queue.groupBy("when").agg(F.sum("size").alias("_in"))
    upto = F.sum("_in").over(Window.orderBy("when"))
    edge = sums.select("when", "_in", upto.alias("upto")).filter(F.col("upto") > most)
    edge = edge.orderBy("when").select("when", (F.col("upto") - F.col("_in")).alias("b")).first()
    if edge is None:
        return queue
    last = queue.filter(F.col("when") == edge["when"])
    # many copies may end in this one bucket: it is summed in finer buckets of its own
    last = last.withColumn("fine", F.floor(F.col("finish") * TIME_BUCKETS * TIME_BUCKETS))
    order = [F.col("finish"), F.col("source").asc_nulls_last(), F.col("doc_id"), F.col("text_id"), F.col("copy")]
    last = running(last, [], order, "size", "upto", "fine")
    last = last.filter(F.col("upto") + edge["b"] - F.col("size") / 2 <= most)
    return queue.filter(F.col("when") < edge["when"]).unionByName(last.drop("fine", "upto"))


KEY = ("doc_id", "source", "size", "text_id", "copy")


def sized(docs: DataFrame, *carried) -> DataFrame:
    """``KEY`` of each row, and ``carried``: copy is 1, 2, ... among rows alike in all else."""
    text = C.text_of()
    rows = docs.select("doc_id", "source", C.n_words(text).alias("size"), F.xxhash64(text).alias("text_id"), *carried)
    return rows.withColumn("copy", F.row_number().over(Window.partitionBy(*KEY[:-1]).orderBy(F.lit(0))))


def document_sizes(docs: DataFrame) -> DataFrame:
    """``KEY`` of each document: size in words, all narrow (checkpointed)."""
    return C.materialised(sized(docs))


def taken_words(docs: DataFrame, **params) -> DataFrame:
    """Per document: doc_id, size, source, source_size, target and taken."""
    sizes = document_sizes(docs)
    taken = fair_queue(sizes, **params).groupBy(*KEY).agg(F.sum("size").alias("taken"))
    taken = taken.withColumnsRenamed({k: f"_t_{k}" for k in KEY})
    per = source_targets(sizes, *(params[k] for k in ("weights", "budget", "cap") if k in params))
    per = per.withColumnRenamed("source", "_s")
    return (sizes.join(taken, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in KEY], "left")
            .join(per, F.col("source").eqNullSafe(F.col("_s")))
            .select("doc_id", "size", "source", "source_size", "target",
                    F.coalesce("taken", F.lit(0)).cast("long").alias("taken")))


def mix_documents(docs: DataFrame, finish: str | None = "finish", **params) -> DataFrame:
    """The mix itself: the rows of ``docs`` that it takes, each once or more, range-sorted
    by finish time, which the last column holds under the name given, if one is.  A column
    of ``docs`` under that name is replaced, all others are as they are."""
    sizes = document_sizes(docs)
    queue = (fair_queue(sizes, **params).select(*KEY, "finish")
             .withColumnsRenamed({k: f"_t_{k}" for k in (*KEY,)}))
    rows = sized(docs, C.whole_row(docs, finish or "").alias("_row"))
    joined = rows.join(queue, [F.col(k).eqNullSafe(F.col(f"_t_{k}")) for k in KEY])
    last = [F.col("finish").alias(finish)] if finish else []
    return joined.orderBy("finish", "doc_id").select("_row.*", *last)


def query(spark, sf_dir: str) -> DataFrame:
    docs = C.read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return taken_words(docs).select("doc_id", "size", "source_size", "target", "taken")

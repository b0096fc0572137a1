"""Crawl-state ledger as a fold over a transition log (STM-2, AGG-1..3,
WIN-3, JOIN-1..3, STM-3).

The log has one row per transition ``(url, kind, ts, tid, moved)`` with
kinds add / claim / complete / fail / recover / retry / stale.  The state
of a URL is decided by the *last* transition of each kind, so the fold is a
``groupBy(url)`` of conditional struct maxima: partial maxima merge
map-side and across micro-batches (the streaming fold re-uses it).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

KINDS = ("add", "claim", "complete", "fail", "recover", "retry", "stale")
MOVED_KINDS = ("add", "recover", "retry", "stale")
FRONT_KINDS = ("recover", "stale")


def _seq(ts: Column, tid: Column) -> Column:
    return F.struct(ts.alias("ts"), tid.alias("tid"))


def last_by_kind(log: DataFrame) -> DataFrame:
    """Per URL: the last (ts, tid) of every kind (null when absent), the last
    claim time, and the last pending-entry transition."""
    seq = _seq(F.col("ts"), F.col("tid"))
    aggs = [F.max(F.when(F.col("kind") == k, seq)).alias(f"last_{k}") for k in KINDS]
    entry = F.when(F.col("kind").isin(*MOVED_KINDS) & F.col("moved"),
                   F.struct(seq.alias("seq"), F.col("kind").alias("kind")))
    aggs.append(F.max(entry).alias("last_entry"))
    return log.groupBy("url").agg(*aggs)


def merge_rows(partials: DataFrame) -> DataFrame:
    """``last_by_kind`` rows of several parts of a log, one a URL."""
    cols = [f"last_{k}" for k in KINDS] + ["last_entry"]
    return partials.groupBy("url").agg(*[F.max(c).alias(c) for c in cols])


def _gt(a: Column, *others: Column) -> Column:
    """a > max(others) with absent (null) = minus infinity."""
    cond = a.isNotNull()
    for o in others:
        cond = cond & (o.isNull() | (a > o))
    return cond


def states(last: DataFrame) -> DataFrame:
    """Flags per URL (they may overlap: a failed URL can stay completed)."""
    c = lambda k: F.col(f"last_{k}")
    entry_seq = F.col("last_entry.seq")
    return last.select(
        "url",
        c("complete").isNotNull().alias("completed"),
        _gt(c("fail"), c("complete"), c("retry")).alias("error"),
        _gt(c("claim"), c("complete"), c("fail"), c("recover"), c("stale")).alias("in_flight"),
        _gt(entry_seq, c("claim")).alias("pending"),
        c("claim.ts").alias("last_claim_ts"),
        F.col("last_entry.kind").alias("entry_kind"),
        entry_seq.alias("entry_seq"),
    )


def fold(log: DataFrame) -> DataFrame:
    s = states(last_by_kind(log))
    return s.withColumn("claimed_at", F.when(F.col("in_flight"), F.col("last_claim_ts"))).drop("last_claim_ts")


def stats(st: DataFrame) -> DataFrame:
    """AGG-1..3: counts, remaining, progress (errors not counted)."""
    a = st.agg(
        F.count_if("pending").alias("pending"),
        F.count_if("in_flight").alias("in_flight"),
        F.count_if("completed").alias("completed"),
        F.count_if("error").alias("errors"),
    )
    return progress(a)


def progress(counts: DataFrame, *keep: str) -> DataFrame:
    """AGG-2/3 beside the counts of the states: remaining, progress (errors not counted)."""
    total = F.greatest(F.lit(1), F.col("completed") + F.col("pending") + F.col("in_flight"))
    return counts.select(*keep, "pending", "in_flight", "completed", "errors", (F.col("pending") + F.col("in_flight")).alias("remaining"),
                         F.round(F.lit(100.0) * F.col("completed") / total, 1).alias("progress_pct"))


def claim_order(st: DataFrame) -> list[Column]:
    """WIN-3 order: re-queued at the front (latest first), then the FIFO tail."""
    front = F.col("entry_kind").isin(*FRONT_KINDS)
    return [F.when(front, 0).otherwise(1),
            F.when(front, F.col("entry_seq")).desc_nulls_last(),
            F.when(~front, F.col("entry_seq")).asc_nulls_last(),
            F.col("url")]


def claim_batch(st: DataFrame, n: int = 16) -> DataFrame:
    """WIN-3 + LIM-2: the first ``n`` pending URLs (a top-n, no full sort)."""
    top = st.where("pending").orderBy(*claim_order(st)).limit(n)
    # a window over the n rows of the batch
    return top.select(F.row_number().over(Window.orderBy(*claim_order(top))).cast("bigint").alias("rank"), "url")


def outcome_message(status: Column, error: Column) -> Column:
    """FLT-11: "http-<code>" where a server answered with an error, else what went wrong."""
    return F.when(status >= 400, F.concat(F.lit("http-"), status.cast("string"))).otherwise(error)


def recover_in_flight(st: DataFrame) -> DataFrame:
    """JOIN-2: in-flight URLs go back to pending unless completed or pending."""
    return st.where("in_flight").select("url", (~F.col("completed") & ~F.col("pending")).alias("moved"))


def retry_errors(st: DataFrame) -> DataFrame:
    """JOIN-3: errored URLs go back to the queue end unless completed or pending."""
    return st.where("error").select("url", (~F.col("completed") & ~F.col("pending")).alias("moved"))


def lease_expiry(st: DataFrame, now: Column, timeout_sec: int = 300) -> DataFrame:
    """STM-3: in-flight longer than the timeout -> stale (front of the queue)."""
    age = F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("claimed_at").cast("timestamp"))
    return (st.where("in_flight").select("url", "claimed_at", (age / 1e6).alias("age_sec"))
            .where(F.col("age_sec") > timeout_sec))


def seen_set(st: DataFrame) -> DataFrame:
    """SET-1: URLs that discovery must not add again.  ``seen`` includes
    in-flight URLs (quirk Q3 fixed); ``seen_reference`` leaves them out."""
    return st.where("pending OR completed OR error OR in_flight").select(
        "url", (F.col("pending") | F.col("completed") | F.col("error")).alias("seen_reference"))

"""Benchmark: headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Each query is run to completion through the ``noop`` sink (every row is
computed, nothing is collected): one warm-up run, then the median of
$BENCH_REPEAT timed runs.  ``control`` is a fixed Spark job that no change of
this package touches, to tell the machine's speed from that of the queries; it
is not part of the sum.  Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["url_canonical", "link_edges", "pii_scrub", "link_resolution", "topic_index",
            "ledger_fold", "crawl_closure", "page_rewrite", "posts", "scope_filter"]


def control(spark, sf_dir):
    """Sort and count hashes of a fixed range: CPU, one exchange."""
    from pyspark.sql import functions as F
    rows = spark.range(8_000_000).select(F.xxhash64("id").alias("h")).withColumn("s", F.sha1(F.col("h").cast("string")))
    return rows.groupBy(F.substring("s", 1, 4).alias("g")).agg(F.max("h").alias("h"), F.count(F.lit(1)).alias("n")).orderBy("h")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    from pagelake.plans.catalog import QUERIES
    from pagelake.session import build_session
    spark = build_session(f"local[{cpus}]", max(cpus, 8))
    times = {}
    jobs = {**QUERIES, "control": control}
    for name in [*names, "control"]:
        def run():
            t0 = time.perf_counter()
            jobs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0
        run()
        times[name] = round(statistics.median(run() for _ in range(repeat)), 3)
    control_sec = times.pop("control")
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_sec", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "control_sec": control_sec}))


if __name__ == "__main__":
    main()

"""Offline crawl closure (JOIN-13, LIM-1): from the seeds, follow stored
in-scope edges breadth-first until no new URL appears (or a page cap).

One round = frontier JOIN edges (shuffle on the source URL) -> distinct
targets -> anti-join with every earlier round.  Each round is written with
``checkpoint()`` to the shared checkpoint folder, so lineage stays one round
deep and a lost executor only recomputes the current round.  The visited set is
the union of the round tables, written as one every few rounds."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ensure_checkpoint_dir


#: Rounds after which the table of visited URLs is written anew as one.
COMPACT = 8


def crawl_closure(seeds: DataFrame, edges: DataFrame, max_pages: int = 0) -> DataFrame:
    """``seeds``: (url) or (url, order); ``edges``: (src, dst, k) with ``k`` a
    first-seen order key of the edge.  Returns (url, depth).  Runs until a round
    finds nothing new, or ``max_pages`` (LIM-1) are reached: then the last round
    is cut in order of discovery, the seeds in their own order.

    The edges are written once, partitioned by source; a round joins only its
    own new URLs with them.
    """
    ensure_checkpoint_dir(seeds.sparkSession)
    e = edges.select("src", "dst", "k").repartition("src").checkpoint(eager=True)
    order = F.min("order") if "order" in seeds.columns else F.min("url")
    frontier = seeds.groupBy("url").agg(order.alias("first")).checkpoint(eager=True)
    rounds, total, depth = [], 0, 0
    visited = frontier.select("url")
    since = 0
    while True:
        n = frontier.count()
        if max_pages and total + n >= max_pages:
            cut = frontier.orderBy("first", "url").limit(max_pages - total)
            rounds.append(cut.select("url", F.lit(depth).alias("depth")))
            break
        if n == 0:
            break
        rounds.append(frontier.select("url", F.lit(depth).alias("depth")))
        total, depth, since = total + n, depth + 1, since + 1
        if since == COMPACT:
            visited, since = visited.checkpoint(eager=True), 0
        found = (frontier.select(F.col("url").alias("src")).join(e, "src")
                 .groupBy(F.col("dst").alias("url")).agg(F.min("k").alias("first")))
        frontier = found.join(visited, "url", "left_anti").checkpoint(eager=True)
        visited = visited.unionByName(frontier.select("url"))
    return reduce(lambda a, b: a.unionByName(b), rounds) if rounds else seeds.select("url", F.lit(0).alias("depth")).limit(0)

"""Robots files to rules (FLT-9): lines of texts are grouped by gaps and islands.

Successive ``User-agent`` lines open one group; the ``Allow`` and ``Disallow`` lines up to the next
agent line are its rules, in their order, for each of its agents.  Comments and blank or unknown lines
neither open nor end a group; rules before any agent line belong to nobody.  An empty
``Disallow`` allows everything, so that the group counts as its agent's own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What a robots file's folder is named after, where a Spark writer laid the files down.
FOLDER = r"/host=([^/]+)/[^/]*$"


def read_robots(spark: SparkSession, root: str) -> DataFrame:
    """host and whole text of each robots file below ``root`` (host=<host>/...)."""
    texts = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    host = F.regexp_extract("_metadata.file_path", FOLDER, 1)
    return texts.select(F.lower(F.try_url_decode(host)).alias("host"), F.col("value").alias("text"))


def robots_rules(files: DataFrame) -> DataFrame:
    """(host, text) -> host, agent, rule_no, allow, path_prefix, as ``scope.robots_allowed`` takes them.
    A host's several files are read as one, in the order of their texts."""
    whole = files.groupBy("host").agg(F.array_join(F.array_sort(F.collect_set("text")), "\n").alias("text"))
    lines = whole.select("host", F.posexplode(F.split("text", r"\r\n|\r|\n")).alias("line", "raw"))
    bare = F.trim(F.regexp_replace("raw", "#.*$", ""))
    lines = lines.select("host", "line", F.lower(F.trim(F.regexp_extract(bare, r"^([^:]*):", 1))).alias("field"),
                         F.trim(F.regexp_extract(bare, r"^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("field").isin("user-agent", "allow", "disallow"))
    by_line = Window.partitionBy("host").orderBy("line")
    is_agent = F.col("field") == "user-agent"
    opens = is_agent & ~F.coalesce(F.lag(is_agent).over(by_line), F.lit(False))
    grouped = lines.withColumn("opens", opens).withColumn("group", F.count_if("opens").over(by_line))
    agents = grouped.where(is_agent & (F.col("value") != "")).select(F.col("host").alias("_h"), F.col("group").alias("_g"),
                                                                   F.lower("value").alias("agent")).distinct()
    rules = grouped.where(~is_agent & (F.col("group") > 0)).select(
        "host", "group", "line", ((F.col("field") == "allow") | (F.col("value") == "")).alias("allow"),
        F.when(F.col("value") == "", "").otherwise(F.coalesce(F.try_url_decode(F.replace("value", F.lit("+"), F.lit("%2B"))), "value")).alias("path_prefix"))
    out = rules.join(agents, (F.col("host") == F.col("_h")) & (F.col("group") == F.col("_g")))
    return out.select("host", "agent", F.col("line").cast("int").alias("rule_no"), "allow", "path_prefix")

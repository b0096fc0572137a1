"""URL filter (operator 7): rules, and a path-template tree for what no rule names.

Pages that a rule names are the labelled ones.  Per host, paths become
templates: digits are one wildcard, and a segment is variable where its parent
has ``VARIABLE`` or more different children.  Templates that differ only in
their last literal segment are branches of one node; labelled branches whose
share of blocked pages does not differ from the node's (two-sided test at
``Z``) are merged.  A template is rejected if the share of blocked pages among
the labelled ones of its merged branch, smoothed by ``STRENGTH`` pages of
share ``PRIOR``, is ``REJECT`` or more.  A branch without labels is judged by
the prior alone, whatever its neighbours are.

The tree is built from one row for each host and path shape, so that a host
with a third of all pages weighs no more than another.  Native DataFrame code.

Defined results: a null url or one without ``://`` has empty host and path; an
empty host has templates like any other; a url's letter case counts in its
path; repeated rows are judged one by one; an empty table gives no rows; extra
columns are not carried on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: verdict, host, path
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
VARIABLE = 16
Z = 1.96
PRIOR = 0.25
STRENGTH = 4.0
REJECT = 0.5


def host_and_path(url: str = "url") -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr(f"substring({url}, instr({url}, '://') + 3)")).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return (C.ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0)),
            F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1))


def fits(host: str, path: str) -> Column:
    on_host = (F.col("host") == host) | F.col("host").endswith(f".{host}")
    return on_host & F.col("path").startswith(path)


def with_rule(pages: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict of the longest rule that fits."""
    order = sorted(rules, key=lambda r: (-len(r[1] + r[2]), r))
    rule = F.coalesce(*[F.when(fits(h, p), F.lit(h + p)) for _, h, p in order], F.lit(None).cast("string"))
    verdict = F.coalesce(*[F.when(fits(h, p), F.lit(v)) for v, h, p in order], F.lit(None).cast("string"))
    return pages.withColumn("rule", rule).withColumn("rule_verdict", verdict)


def templates(shapes: DataFrame) -> DataFrame:
    """host, shape -> template (a string) and node (the template less its last literal)."""
    seg = shapes.select("host", "shape", F.posexplode(F.split("shape", "/")).alias("pos", "seg"),
                        F.split("shape", "/").alias("all"))
    seg = seg.withColumn("parent", F.array_join(F.slice("all", 1, F.col("pos")), "/")).drop("all")
    kids = (seg.select("host", "pos", "parent", "seg").distinct()
            .groupBy("host", "pos", "parent").count().filter(F.col("count") >= VARIABLE)
            .select(F.col("host").alias("_h"), F.col("pos").alias("_p"), F.col("parent").alias("_q")))
    seg = seg.join(kids, (F.col("host") == F.col("_h")) & (F.col("pos") == F.col("_p"))
                   & (F.col("parent") == F.col("_q")), "left")
    name = F.when(F.col("_h").isNotNull(), F.lit("*")).otherwise(F.col("seg"))
    parts = seg.groupBy("host", "shape").agg(F.sort_array(F.collect_list(F.struct("pos", name.alias("s")))).alias("a"))
    parts = parts.withColumn("s", F.transform("a", lambda x: x["s"]))
    literal = F.transform("s", lambda x, i: F.when(~x.rlike("[*<]") & (x != ""), i))
    parts = parts.withColumn("last", F.array_max(literal))
    node = F.transform("s", lambda x, i: F.when(i == F.col("last"), F.lit("~")).otherwise(x))
    return parts.select("host", "shape", F.array_join("s", "/").alias("template"),
                        F.array_join(node, "/").alias("node"))


def judged_templates(labelled: DataFrame) -> DataFrame:
    """host, shape, template, blocked_share, reject from (host, shape, bad: 1, 0 or null)."""
    counts = (labelled.groupBy("host", "shape")
              .agg(F.count("bad").alias("n"), F.coalesce(F.sum("bad"), F.lit(0)).alias("n_bad")))
    of = templates(counts.select("host", "shape"))
    both = ["host", "shape"]
    per = counts.join(of, both).groupBy("host", "node", "template").agg(
        F.sum("n").alias("n"), F.sum("n_bad").alias("n_bad"))
    node = Window.partitionBy("host", "node")
    share = F.sum("n_bad").over(node) / F.greatest(F.sum("n").over(node), F.lit(1))
    per = per.withColumn("p", share)
    gap = F.abs(F.col("n_bad") / F.greatest("n", F.lit(1)) - F.col("p"))
    per = per.withColumn("similar", (F.col("n") > 0) & (
        gap <= Z * F.sqrt(F.col("p") * (1 - F.col("p")) / F.greatest("n", F.lit(1))) + 1e-12))
    merged = Window.partitionBy("host", "node", "similar")
    pooled = lambda c: F.when(F.col("similar"), F.sum(c).over(merged)).otherwise(F.col(c))
    per = per.withColumn("m", pooled("n")).withColumn("m_bad", pooled("n_bad"))
    smooth = (F.col("m_bad") + PRIOR * STRENGTH) / (F.col("m") + STRENGTH)
    per = per.select("host", "template", smooth.alias("blocked_share"))
    return (of.select("host", "shape", "template").join(per, ["host", "template"])
            .withColumn("reject", F.col("blocked_share") >= REJECT))


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template and blocked_share for each row of ``pages``."""
    host, path = host_and_path()
    rows = with_rule(pages.select("page_id", host.alias("host"), path.alias("path")), rules)
    rows = rows.withColumn("shape", F.regexp_replace("path", "[0-9]+", "<n>"))
    bad = F.when(F.col("rule_verdict") == "block", 1).when(F.col("rule_verdict") == "allow", 0)
    tree = judged_templates(rows.select("host", "shape", bad.alias("bad")))
    method = F.when(F.col("reject"), F.lit("block")).otherwise(F.lit("allow"))
    return rows.join(tree, ["host", "shape"]).select(
        "page_id", "host", "path", "rule", F.coalesce("rule_verdict", method).alias("verdict"),
        "template", "blocked_share")


def query(spark, sf_dir: str) -> DataFrame:
    return judge_urls(C.read_table(spark, sf_dir, "pages", "page_id", "url"))


ORACLE = """
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
r(v, h, pre) AS (VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
g AS (
  SELECT page_id, host, path, regexp_replace(path, '[0-9]+', '<n>', 'g') AS shape,
    (SELECT h || pre FROM r WHERE ends_with('.' || p.host, '.' || h) AND starts_with(p.path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS rule,
    (SELECT v FROM r WHERE ends_with('.' || p.host, '.' || h) AND starts_with(p.path, pre) ORDER BY length(h || pre) DESC LIMIT 1) AS rv
  FROM p),
c AS (SELECT host, shape, count(rv) AS n, count(*) FILTER (rv = 'block') AS n_bad FROM g GROUP BY ALL),
s AS (
  SELECT host, shape, i AS pos, string_split(shape, '/')[i] AS seg, array_to_string(string_split(shape, '/')[1:i - 1], '/') AS parent
  FROM c, LATERAL (SELECT unnest(range(1, 1 + len(string_split(shape, '/')))) AS i)),
k AS (SELECT host, pos, parent FROM s GROUP BY ALL HAVING count(DISTINCT seg) >= 16),
w AS (
  SELECT s.host, shape, s.pos, CASE WHEN k.pos IS NULL THEN seg ELSE '*' END AS seg
  FROM s LEFT JOIN k ON s.host = k.host AND s.pos = k.pos AND s.parent = k.parent),
l AS (
  SELECT *, max(CASE WHEN seg <> '' AND NOT regexp_matches(seg, '[*<]') THEN pos END) OVER (PARTITION BY host, shape) AS last FROM w),
t AS (
  SELECT host, shape, string_agg(seg, '/' ORDER BY pos) AS template,
         string_agg(CASE WHEN pos = last THEN '~' ELSE seg END, '/' ORDER BY pos) AS node FROM l GROUP BY ALL),
per AS (SELECT host, node, template, sum(n) AS n, sum(n_bad) AS n_bad FROM c JOIN t USING (host, shape) GROUP BY ALL),
q AS (SELECT *, sum(n_bad) OVER n / greatest(sum(n) OVER n, 1) AS p FROM per WINDOW n AS (PARTITION BY host, node)),
sim AS (SELECT *, n > 0 AND abs(n_bad / greatest(n, 1) - p) <= 1.96 * sqrt(p * (1 - p) / greatest(n, 1)) + 1e-12 AS alike FROM q),
m AS (
  SELECT host, template, CASE WHEN alike THEN sum(n) OVER n ELSE n END AS n, CASE WHEN alike THEN sum(n_bad) OVER n ELSE n_bad END AS n_bad
  FROM sim WINDOW n AS (PARTITION BY host, node, alike))
SELECT g.page_id, g.host, g.path, g.rule, t.template, CAST((m.n_bad + 1.0) / (m.n + 4.0) AS DOUBLE) AS blocked_share,
  coalesce(g.rv, CASE WHEN (m.n_bad + 1.0) / (m.n + 4.0) >= 0.5 THEN 'block' ELSE 'allow' END) AS verdict
FROM g JOIN t USING (host, shape) JOIN m USING (host, template)
"""

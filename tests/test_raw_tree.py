"""Raw trees of files: laid down and scanned."""

import pytest
from pyspark.sql import functions as F

from pagelake.sources import store as ST


def test_a_tree_is_listed_and_read_once(spark, tmp_path, capsys):
    rows = spark.createDataFrame([(i, f"<p>{i}</p>") for i in range(6)], "i int, html string")
    name = lambda ext: F.concat(F.lit("k"), F.col("i").cast("string"), F.lit(ext))
    ST.lay_files(rows.select(F.to_json(F.struct("i")).alias("value"), name(ST.META_EXT).alias("file_name")), f"{tmp_path}/meta")
    kept = F.when(F.col("i") == 4, ".html.tmp").otherwise(ST.HTML_EXT)
    ST.lay_files(rows.where("i != 2").select(F.col("html").alias("value"), name(kept).alias("file_name")), f"{tmp_path}/html")
    tree = ST.scan_tree(spark, str(tmp_path), "i int")
    assert sorted(map(tuple, tree.collect())) == [(f"k{i}", i, f"<p>{i}</p>\n") for i in (0, 1, 3, 5)]
    capsys.readouterr()
    tree.where("i >= 0").explain()
    assert capsys.readouterr().out.count("FileScan binaryFile") == 1


def test_files_stand_by_themselves(spark, tmp_path):
    """One folder, checksum and process a file took longer than the rest of the job."""
    rows = spark.range(0, 500, 1, 3).select((F.col("id") % 400).cast("string").alias("value"), F.concat("value", F.lit(".css")).alias("file_name"))
    ST.lay_files(rows, f"{tmp_path}/t")
    found = [p for p in (tmp_path / "t").rglob("*") if p.is_file()]
    # a name that comes in two tasks is two files, as are names of their own
    assert len(found) == 500 and all(p.name == p.read_text().strip() + ".css" for p in found)
    assert len({p.parent for p in found}) <= 3 * 16 and {p.parent.parent for p in found} == {tmp_path / "t"}


def test_files_of_any_name(spark, tmp_path):
    rows = [("a", "x.css"), ("b", "x.css"), ("c", None), (None, "n.css"), ("d", "_x.css"), ("e", ".h.css"), ("f", "u/v=1.css"), ("g", "t.css.tmp"), ("", "z.css"), ("h\ni", "é.css"), ("", "")]
    df = spark.createDataFrame(rows, "value string, file_name string").coalesce(1)
    ST.lay_files(df, f"{tmp_path}/new")
    df.write.partitionBy("file_name").text(f"{tmp_path}/old")
    new, old = (sorted((r.file_name, r.length, bytes(r.content)) for r in ST.scan_assets(spark, f"{tmp_path}/{x}").collect()) for x in ("new", "old"))
    assert new == old and ("x.css", 4, b"a\nb\n") in new and len(new) == 8
    with pytest.raises(FileExistsError):
        ST.lay_files(df, f"{tmp_path}/new")
    ST.lay_files(df.where("value = 'none'"), f"{tmp_path}/none")
    assert ST.scan_assets(spark, f"{tmp_path}/none").collect() == []


def test_a_task_that_fails_leaves_no_files(spark, tmp_path):
    bad = spark.range(0, 40, 1, 1).select(F.col("id").cast("string").alias("value"), F.when(F.col("id") < 39, F.concat("id", F.lit(".css"))).otherwise(F.repeat(F.lit("x"), 300)).alias("file_name"))
    with pytest.raises(Exception, match="File name too long"):
        ST.lay_files(bad, f"{tmp_path}/t")
    assert [p for p in (tmp_path / "t").rglob("*") if p.is_file()] == []


def test_small_files_are_read_by_few_tasks(spark, tmp_path):
    ST.lay_files(spark.range(0, 3000, 1, 2).select(F.lit("x").alias("value"), F.concat("id", F.lit(".css")).alias("file_name")), f"{tmp_path}/t")
    scanned = ST.scan_assets(spark, f"{tmp_path}/t")
    assert scanned.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert scanned.select("file_name").distinct().count() == 3000 and {bytes(r.content) for r in scanned.collect()} == {b"x\n"}


def test_markup_is_measured_where_it_is_read(spark, tmp_path):
    rows = spark.createDataFrame([(1, "<p>é</p>"), (2, None)], "i int, html string")
    ST.lay_files(rows.select(F.to_json(F.struct("i")).alias("value"), F.concat("i", F.lit(".json")).alias("file_name")), f"{tmp_path}/meta")
    ST.lay_files(rows.select(F.col("html").alias("value"), F.concat("i", F.lit(".html")).alias("file_name")), f"{tmp_path}/html")
    assert sorted(map(tuple, ST.scan_tree(spark, str(tmp_path), "i int", n=F.octet_length("html")).collect())) == [("1", 1, 10), ("2", 2, 1)]

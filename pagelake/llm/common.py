"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import gc
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelake.session import ensure_checkpoint_dir

#: Characters that end a word in the texts of ``documents`` (space, tab to CR).
SPACES = " \t\n\x0b\x0c\r"
SPACE_RE = "[\\x20\\x09-\\x0D]+"


def importable(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver has it.  That serves
    local masters and folders that all machines share; else ship it with --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


def read_table(spark: SparkSession, sf_dir: str, name: str, *cols: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet").select(*cols)


def materialised(df: DataFrame) -> DataFrame:
    """Cut lineage: a reliable checkpoint in the folder all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint()


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle and checkpoint files of finished steps: its cleaner does so
    once the driver's garbage is collected, which may else be long after they are needed."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def whole_row(df: DataFrame, *without: str) -> Column:
    """All columns of ``df`` but some, as one struct, whatever their names are."""
    gone = {c.lower() for c in without}
    names = [c for c in df.columns if c.lower() not in gone]
    return F.struct(*[F.col("`" + c.replace("`", "``") + "`") for c in names])


def text_of(col: str = "text") -> Column:
    """The text, a null as the empty text."""
    return F.coalesce(F.col(col), F.lit(""))


def ascii_lower(c: Column) -> Column:
    """Only A-Z are lowered, so that every engine gives the same bytes."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(c: Column) -> Column:
    """Words of a text: runs of anything but space and tab to CR."""
    return F.array_remove(F.split(c, SPACE_RE), "")


def n_words(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")

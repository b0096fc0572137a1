"""Versioned table snapshots (SNK-4/SRC-5), the JSON-lines manifest
(SNK-3/SRC-2) and raw asset trees (SRC-3).

Snapshots are written as ``<root>/version=<n>``; a version counts only
once its ``_SUCCESS`` marker exists, so readers never see a partial write
and a failed job can simply be re-run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _fs(spark: SparkSession, root: str):
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(root)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path, jvm


def committed_versions(spark: SparkSession, root: str) -> list[int]:
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    out = []
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("version=") and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
            out.append(int(name.split("=", 1)[1]))
    return sorted(out)


def names(spark: SparkSession, root: str) -> list[str]:
    """Names of what stands in a folder; none if there is no such folder."""
    fs, path, _ = _fs(spark, root)
    return sorted(st.getPath().getName() for st in fs.listStatus(path)) if fs.exists(path) else []


def is_written(spark: SparkSession, folder: str) -> bool:
    """Whether a Spark job has written this folder to its end."""
    fs, path, jvm = _fs(spark, folder)
    return fs.exists(jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))


def delete(spark: SparkSession, root: str) -> None:
    fs, path, _ = _fs(spark, root)
    fs.delete(path, True)


def write_version(df: DataFrame, root: str, version: int | None = None) -> int:
    """SNK-4: write a new snapshot version (overwrite only that version)."""
    spark = df.sparkSession
    v = version if version is not None else (max(committed_versions(spark, root), default=0) + 1)
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/version={v}")
    return v


def read_latest(spark: SparkSession, root: str, schema: T.StructType | None = None) -> DataFrame:
    """SRC-5: newest committed version; an empty frame of ``schema`` if none."""
    vs = committed_versions(spark, root)
    if not vs:
        if schema is None:
            raise FileNotFoundError(root)
        return spark.createDataFrame([], schema)
    return spark.read.parquet(f"{root.rstrip('/')}/version={vs[-1]}")


def _committed(spark: SparkSession, root: str, kind: str) -> list[int]:
    fs, path, jvm = _fs(spark, root)
    if not fs.exists(path):
        return []
    names = [st.getPath() for st in fs.listStatus(path)]
    return sorted(int(n.getName().split("=", 1)[1]) for n in names
                  if n.getName().startswith(f"{kind}=") and fs.exists(jvm.org.apache.hadoop.fs.Path(n, "_SUCCESS")))


def write_delta(df: DataFrame, root: str, batch: int) -> None:
    """What one micro-batch adds to a state; a batch that is run again writes the same delta."""
    df.write.mode("overwrite").parquet(f"{root.rstrip('/')}/delta={batch}")


def read_state(spark: SparkSession, root: str, schema, before: int | None = None) -> DataFrame:
    """Rows of the newest base, which holds the deltas up to its number, and of the deltas
    after it (and before ``before``); the caller merges rows of one key."""
    bases = _committed(spark, root, "base")
    base = bases[-1] if bases else -1
    paths = [f"{root.rstrip('/')}/base={base}"] if bases else []
    paths += [f"{root.rstrip('/')}/delta={d}" for d in _committed(spark, root, "delta")
              if d > base and (before is None or d < before)]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def compact_state(spark: SparkSession, root: str, schema, batch: int, merge) -> None:
    """Write base and deltas up to ``batch`` as a new base, then drop what it replaces."""
    merge(read_state(spark, root, schema, batch + 1)).write.mode("overwrite").parquet(f"{root.rstrip('/')}/base={batch}")
    fs, _, jvm = _fs(spark, root)
    old = [f"base={b}" for b in _committed(spark, root, "base") if b < batch]
    old += [f"delta={d}" for d in _committed(spark, root, "delta") if d <= batch]
    for name in old:
        fs.delete(jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/{name}"), True)


# Fixed values (SNK-7): fields never written with run metadata.
PRIVATE_CONFIG = ("password", "secret", "site")


def public_config(cfg: DataFrame) -> DataFrame:
    return cfg.drop(*[c for c in PRIVATE_CONFIG if c in cfg.columns])


MANIFEST_SCHEMA = T.StructType([
    T.StructField("type", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("key", T.StringType()), T.StructField("ext", T.StringType()),
    T.StructField("content_type", T.StringType()), T.StructField("seq", T.LongType()),
    T.StructField("_corrupt_record", T.StringType()),
])


def append_manifest(records: DataFrame, root: str) -> None:
    """SNK-3: append records as JSON lines."""
    records.write.mode("append").json(root)


def read_manifest_assets(spark: SparkSession, root: str) -> DataFrame:
    """SRC-2: malformed lines skipped, type='asset' only, last record per URL."""
    m = spark.read.schema(MANIFEST_SCHEMA).option("mode", "PERMISSIVE") \
        .option("columnNameOfCorruptRecord", "_corrupt_record").json(root)
    m = m.where(F.col("_corrupt_record").isNull() & (F.col("type") == "asset") & F.col("url").isNotNull())
    best = m.groupBy("url").agg(F.max_by(F.struct("key", "ext", "content_type"), F.col("seq")).alias("r"))
    return best.select("url", "r.key", F.coalesce("r.ext", F.lit(".bin")).alias("ext"), "r.content_type")


def lay_files(files: DataFrame, root: str) -> None:
    """Write each ``value`` and a line feed as a file called ``file_name``; what comes under one name in one
    task goes to one file.  Names that Spark's readers pass over, or that hold more than plain characters,
    become a folder ``file_name=...`` with the file in it.

    Below a local or mounted folder the tasks write the files themselves, each in folders of its own, which get
    their place at the task's end.  Spark's writer makes a folder, a checksum and two renames for each file there,
    and starts a process for each to set its mode.  On other file systems it writes a folder for each file."""
    spark = files.sparkSession
    fs, path, _ = _fs(spark, root)
    if fs.getUri().getScheme() != "file":
        # tasks put their files in place; else the driver would move all of them, one after another, at the end
        files.write.option("mapreduce.fileoutputcommitter.algorithm.version", "2").partitionBy("file_name").text(root)
        return
    if fs.exists(path):
        raise FileExistsError(root)
    fs.mkdirs(path)
    top = fs.makeQualified(path).toUri().getPath()

    def lay(batches):
        import os
        import re
        import shutil
        import zlib

        from pyspark import TaskContext
        task = TaskContext.get()
        part, own = f"{task.partitionId():05d}", f"{top}/_{task.partitionId()}-{task.taskAttemptId()}"
        odd = "[\x00-\x1f\x7f\"#%'*/:=?\\\\{\\[\\]^]"  # what Spark's writer escapes
        made = set()

        def place(name):
            chunk = f"{own}/{part}-{zlib.crc32(name.encode()) % 16:02d}"
            if plain := re.fullmatch("[A-Za-z0-9][A-Za-z0-9.~-]*", name):
                folder = chunk
            else:
                folder = f"{chunk}/file_name=" + (re.sub(odd, lambda m: f"%{ord(m[0]):02X}", name) or "__HIVE_DEFAULT_PARTITION__")
            if not plain or folder not in made:
                os.makedirs(folder, exist_ok=True)
                made.add(chunk)
            return f"{folder}/{name if plain else 'part'}"

        try:
            for batch in batches:
                for value, name in zip(*batch.columns, strict=True):
                    with open(place(name.as_py() or ""), "ab") as f:
                        f.write((value.as_buffer() or b"") if value.is_valid else b"")
                        f.write(b"\n")
            for chunk in os.listdir(own) if made else ():
                if not os.path.exists(f"{top}/{chunk}"):  # else an earlier attempt at this task has put it there
                    os.rename(f"{own}/{chunk}", f"{top}/{chunk}")
        finally:
            shutil.rmtree(own, ignore_errors=True)
        return iter(())

    files.select(F.col("value").cast("binary"), "file_name").mapInArrow(lay, "n int").write.format("noop").mode("overwrite").save()


# Fixed value: so many of the reader's partitions at most are one task's.
_PARTS_A_TASK = 64


def _files(spark: SparkSession, source: str, root: str, **options) -> DataFrame:
    """All files below a folder.  The reader takes each for 4 MB at least and so deals few small ones to a task;
    tasks here get several of its partitions, of as many bytes as it allows, while all cores have some."""
    files = spark.read.format(source).options(recursiveFileLookup="true", **options).load(root)
    parts, jdf = files.rdd.getNumPartitions(), files._jdf
    size = int(jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    most = jdf.sparkSession().sessionState().conf().filesMaxPartitionBytes()
    tasks = max(spark.sparkContext.defaultParallelism, size // most, parts // _PARTS_A_TASK)
    return _named(files).coalesce(tasks) if tasks < parts else _named(files)


def scan_assets(spark: SparkSession, root: str) -> DataFrame:
    """SRC-3: stored asset files (temporary ``.tmp`` files ignored).  A file is
    named by itself or, where a Spark writer laid it down, by the folder
    ``file_name=...`` around it."""
    df = _files(spark, "binaryFile", root)
    return df.select("file_name", "length", "content").where(~F.col("file_name").endswith(".tmp"))


# Names of a stored page's files, its key and one of these.
META_EXT, HTML_EXT = ".json", ".html"
_FOLDER = r"/file_name=([^/]+)/[^/]*$"


def _named(files: DataFrame) -> DataFrame:
    """Files with their name: their own or, where a Spark writer laid them down, that of the folder around them."""
    path = F.col("_metadata.file_path")
    folder = F.regexp_extract(path, _FOLDER, 1)
    return files.withColumn("file_name", F.when(folder != "", folder).otherwise(F.element_at(F.split(path, "/"), -1)))


def scan_tree(spark: SparkSession, root: str, schema: str, **of_html: Column) -> DataFrame:
    """SRC-1: pages of a raw tree: records ``<key>.json`` below ``meta`` (fields of ``schema``) with the
    markup of ``<key>.html`` below ``html``.  Pages without markup and temporary files are left out.

    Each tree is listed and read once.  ``of_html``: columns made of ``html`` where a file is read, which then
    come in its place, so that they are exchanged and not the markup."""
    def tree(kind, source, ext, **options):
        files = _files(spark, source, f"{root}/{kind}", **options).where(F.col("file_name").endswith(ext))
        return files.withColumn("key", F.regexp_replace("file_name", r"\.[a-z]+$", ""))

    meta = tree("meta", "text", META_EXT, wholetext="true").select("key", "value")
    meta = meta.select("key", F.from_json("value", schema).alias("m")).where(F.col("m").isNotNull())
    markup = tree("html", "binaryFile", HTML_EXT).select("key", F.col("content").cast("string").alias("html"))
    kept = of_html or {"html": F.col("html")}
    markup = markup.select("key", *[c.alias(name) for name, c in kept.items()])
    return meta.join(markup, "key").select("key", "m.*", *kept)

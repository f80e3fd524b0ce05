"""Reading reports, pairing them, and publishing verdicts."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType


REPORT = ["report_id", "study_id", "report_type", "filename", "size_bytes", "text", "uploaded_at"]


def role(filename: Column) -> Column:
    """The role of a report by its file's name: a rewrite, unless it says otherwise."""
    return F.when(filename.rlike("(?i)original"), "ORIGINAL").when(filename.rlike("(?i)amendment|adenda"), "AMENDMENT").otherwise("HUMANIZED")


def read_reports(spark: SparkSession, path: str, format: str = "text", names: dict[str, str] | None = None) -> DataFrame:
    """Reports with the columns ``REPORT``, whole.

    ``format`` "text": a file is a report; its folder is its study, size and time are the file's. "parquet": a row is a
    report; ``names`` tells which column a field comes from if not from one of its own name. Fields that the table lacks
    are null, but for the size (bytes of the text) and the role (by the file's name).
    """
    if format == "text":
        rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "text")
        rows = rows.select("text", F.col("_metadata.file_name").alias("filename"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("size_bytes"), F.col("_metadata.file_modification_time").alias("uploaded_at"))
        rows = rows.withColumns({
            "report_id": F.regexp_replace("filename", r"\.[^.]*$", ""), "study_id": F.regexp_extract("path", r"([^/]+)/[^/]*$", 1), "report_type": role(F.col("filename"))
        })
        return rows.select(*REPORT)
    rows = spark.read.format(format).load(path)
    names = {f: (names or {}).get(f, f) for f in REPORT}
    kinds = {"size_bytes": "long", "uploaded_at": "timestamp"}
    got = {f: F.col(f"`{c}`").cast(kinds.get(f, "string")) if c in rows.columns else F.lit(None).cast(kinds.get(f, "string")) for f, c in names.items()}
    got["size_bytes"] = F.coalesce(got["size_bytes"], F.octet_length(got["text"]).cast("long"))
    got["report_type"] = F.coalesce(got["report_type"], role(got["filename"]))
    return rows.select(*[got[f].alias(f) for f in REPORT])


def build_pairs(originals: DataFrame, rewrites: DataFrame) -> DataFrame:
    """Every rewrite with the original of its study, both whole: ``(study_id, report_id, text)`` on either side."""
    o = originals.select("study_id", F.col("report_id").alias("original_id"), F.col("text").alias("original_text"))
    h = rewrites.select("study_id", F.col("report_id").alias("humanized_id"), F.col("text").alias("humanized_text"))
    return o.join(h, "study_id").withColumn("pair_id", F.concat_ws("/", "original_id", "humanized_id"))


def read_uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Uploads by the listing of ``path``, whose files lie as ``<person>/<study>/<file>``.

    ``(study_id, dni, n_bytes, report_type, filename, uploaded_at)``. Files are listed, never opened: names, sizes and
    times are the file system's. ``pattern`` picks files by name. Files that lie less deep have no person or study; Spark's
    readers pass over files without bytes, so these aren't listed.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    part = lambda n: F.nullif(F.regexp_extract("path", r"([^/:]+)/+([^/]+)/+([^/]+)$", n), F.lit(""))
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(
        part(2).alias("study_id"), part(1).alias("dni"), F.col("length").alias("n_bytes"), role(name).alias("report_type"), name.alias("filename"), F.col("modificationTime").alias("uploaded_at")
    )


def _instances(n_bytes: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(n_bytes / 524288)).cast("long")


def _folder(dni: Column) -> Column:
    return F.concat(F.lit("folder-"), dni.cast("string"))


def ingest_manifest(uploads: DataFrame) -> DataFrame:
    """Rows for uploads ``(study_id, dni, n_bytes, report_type, filename)``: instances of half a MiB, folder, file name."""
    name = F.coalesce("filename", F.concat(F.lit("informe_"), F.lower("report_type"), F.lit(".pdf")))
    return uploads.select(
        "study_id", _instances(F.col("n_bytes")).alias("n_instances"), _folder(F.col("dni")).alias("folder_id"), name.alias("filename"), F.col("n_bytes").cast("long").alias("size_bytes"))


def study_manifest(uploads: DataFrame) -> DataFrame:
    """One row per study: its files, bytes and instances, its person's folder, and which roles its reports have.

    A study whose files name several persons lies in the folder of the first by name. Null sizes count as 0.
    """
    size = F.sum(F.coalesce("n_bytes", F.lit(0))).cast("long")
    out = uploads.groupBy("study_id").agg(
        F.count("*").alias("n_files"), size.alias("size_bytes"), F.min(F.col("dni").cast("string")).alias("dni"), F.array_sort(F.collect_set("report_type")).alias("report_types"))
    return out.select("study_id", "n_files", "size_bytes", _instances(F.col("size_bytes")).alias("n_instances"), _folder(F.col("dni")).alias("folder_id"), "report_types")


COMMITTED = "_COMMITTED"


def _path(spark: SparkSession, path: str):
    """A Hadoop path and its file system, whichever store it is in."""
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark._jsc.hadoopConfiguration())


def write_verdicts(df: DataFrame, path: str, run: str | None = None, by: tuple[str, ...] = ("decision",), level: str = "run") -> None:
    """Publishes a run's verdicts under ``path/run=<run>``, by decision, so blocked rewrites lie apart from accepted ones.

    Other runs stay as they are; a run that is written again replaces all of its own, decisions that it no longer has
    included. A mark is set last: until then ``read_verdicts`` doesn't see the run, so readers never get half of one.
    Without a ``run`` all of ``path`` is one, and is replaced. ``level`` names the folders' column.
    """
    if run is not None and not re.fullmatch(r"[A-Za-z0-9][A-Za-z0-9._-]*", run):
        raise ValueError(f"{run!r} can't name a folder")
    target = path if run is None else f"{path}/{level}={run}"
    df.write.mode("overwrite").partitionBy(*by).parquet(target)
    mark, store = _path(df.sparkSession, f"{target}/{COMMITTED}")
    store.create(mark, True).close()


def committed_runs(spark: SparkSession, path: str, level: str = "run") -> list[str]:
    """The runs under ``path`` that were written whole."""
    folder, store = _path(spark, path)
    if not store.exists(folder):
        return []
    names = [s.getPath().getName() for s in store.listStatus(folder)]
    return sorted(n.split("=", 1)[1] for n in names if n.startswith(f"{level}=") and store.exists(_path(spark, f"{path}/{n}/{COMMITTED}")[0]))


def read_verdicts(spark: SparkSession, path: str, runs: list[str] | None = None, level: str = "run") -> DataFrame:
    """Verdicts of all committed runs, or of the named ones, with their names as strings; only their folders are listed.

    There is nothing to tell the columns from if all of them are without verdicts; that is an error, as is a missing run.
    """
    known = committed_runs(spark, path, level)
    if missing := sorted(set(runs or []) - set(known)):
        raise ValueError(f"not committed: {', '.join(missing)}")
    wanted = known if runs is None else sorted(set(runs))
    if not wanted:
        raise ValueError(f"no committed run in {path}")
    folders = [f"{path}/{level}={r}" for r in wanted]
    found = spark.read.option("basePath", path).parquet(*folders).schema
    found = StructType([StructField(f.name, StringType() if f.name == level else f.dataType) for f in found])  # a run named 007 isn't 7
    return spark.read.schema(found).option("basePath", path).parquet(*folders)

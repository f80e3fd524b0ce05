"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words as the contracts define them: runs of anything but ASCII white space. ``bytes.split()`` cuts exactly there.
WORD = r"[^\x20\x09-\x0D]+"
#: Files that any table may have, and rows of a narrow table that are worth a file of their own beyond that.
FEW_FILES, FILE_ROWS = 8, 50_000
#: Most keys that ``join_skewed`` broadcasts; bytes of a batch of texts.
HOT_KEYS, BATCH_BYTES = 1_000, 4_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, or the context's checkpoint folder.

    Where neither is set, a local session (one machine) gets a folder of its own; a cluster has to name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="fidelis-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


def written(df: DataFrame, name: str, rows: int | None = None) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage and survives the loss of any executor.

    If ``df`` is narrow and known to have about ``rows`` rows, the tasks that write it have ``FILE_ROWS`` or more to
    write each, so that a small table isn't as many files as a shuffle has partitions. The folder goes when the driver's
    JVM ends, as the returned table may be read until then.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(FEW_FILES, rows // FILE_ROWS))
    path = f"{shared_dir(spark)}/fidelis-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Whole texts go to Python in batches of ``BATCH_BYTES``, however long each is, and of 1,000 rows at most.

    Spark's own bounds (10,000 rows, 64 MB) can take hundreds of megabytes of a worker. A setting that somebody has
    chosen otherwise stays. Like any setting it holds for the session from then on, as plans read it when they run.
    """
    for name, usual, ours in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864", str(BATCH_BYTES))):
        name = f"spark.sql.execution.arrow.{name}"
        if spark.conf.get(name).rstrip("bB") == usual:
            spark.conf.set(name, ours)


_KEPT: dict[object, object] = {}


def let_go() -> None:
    """Frees in a worker what ``kept`` holds, and what Arrow holds for later: workers outlive the stages of an operator."""
    if _KEPT:
        _KEPT.clear()
        gc.collect()
    pa.default_memory_pool().release_unused()


def kept(key: object, make: Callable[[], object]) -> object:
    """What ``make`` builds for ``key``, kept in a worker between tasks until another is asked for, or ``let_go``."""
    if key not in _KEPT:
        let_go()
        _KEPT[key] = make()
    return _KEPT[key]


def bounded(df: DataFrame, most: int, weight: Column | None = None) -> DataFrame:
    """``df`` to be broadcast if its rows (or the sum of ``weight`` over them) are counted to be ``most`` at most."""
    size = df.limit(most + 1).count() if weight is None else df.agg(F.sum(weight)).first()[0] or 0
    return F.broadcast(df) if size <= most else df


def join_skewed(many: DataFrame, one: DataFrame, on: list[str], n: str, how: str = "inner", broadcast_rows: int = 0) -> DataFrame:
    """``many`` joined (inner or left) with ``one``, whose keys are unique and never null, by way of a split.

    ``one`` has a column ``n``, the rows of ``many`` with its key, which isn't returned. Keys with a thousandth of those
    rows or more are hot; there are at most 1,000 of them, so their rows are broadcast, and no task gets a hot key's
    rows. The others are joined as Spark sees fit. Both sides are read twice and should be written tables. If ``one`` is
    counted to have ``broadcast_rows`` rows at most, all of it is broadcast.
    """
    if one.limit(broadcast_rows + 1).count() <= broadcast_rows:
        return many.join(F.broadcast(one.drop(n)), on, how)
    least = (one.agg(F.sum(n)).first()[0] or 0) / HOT_KEYS
    hot = F.broadcast(one.filter(F.col(n) >= least).drop(n))
    rest = many.join(F.broadcast(hot.select(*on)), on, "left_anti").join(one.filter(F.col(n) < least).drop(n), on, how)
    return many.join(hot, on).unionByName(rest)


def sampled(docs: DataFrame, each: DataFrame, kind: str, most: dict[bool, int], chars: int) -> list[tuple[bool, str]]:
    """``(kind, text)`` of labelled documents ``each(doc_id, kind)``: at most so many of a kind, and so many characters."""
    order = F.xxhash64("doc_id", F.lit(kind))
    picked = [each.filter(F.col(kind) == yes).orderBy(order, "doc_id").limit(n) for yes, n in most.items()]
    ids = picked[0].unionAll(picked[1])
    found = docs.select("doc_id", "text").filter("text is not null").join(F.broadcast(ids), "doc_id")  # ids: the sum of ``most``
    sizes = sorted((order_, i, n) for i, order_, n in found.select("doc_id", order, F.length("text")).collect())
    within, total = [], 0
    for _, i, n in sizes:
        if total + n <= chars:
            within.append(i)
            total += n
    rows = found.filter(F.col("doc_id").isin(sorted(set(within)))).collect() if within else []
    return [(r[kind], r["text"]) for r in sorted(rows, key=lambda r: (r["doc_id"], r["text"]))]

"""Contiguous shards of near-equal bytes by global prefix sums.

Documents are put into one global order by the digest of their text and their id, so copies lie side by side, and the
order has nothing to do with where documents came from. Spark sorts them by ranges; each task adds up sizes within its
partition as rows stream by. The partitions' totals, one row each, give every partition its offset, and so every
document its place among all bytes. Shards are cut at equal targets.

A group of equal texts that a target falls into goes to one side whole if that moves the cut by no more than ``slack``
of a shard; a larger group is split at the target, since sizes come first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import small_batches, written


def sized(docs: DataFrame, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, text_crc32, digest, *carry)``: UTF-8 bytes plus one; a null text is an empty one."""
    data = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return docs.select(
        F.col("doc_id"), (F.octet_length(data) + 1).cast("long").alias("size"), F.crc32(data).alias("text_crc32"), F.unhex(F.md5(data)).alias("digest"), *carry
    )


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the partition, and the bytes and rows that come before each row in it."""
    from pyspark import TaskContext

    part, held, seen = TaskContext.get().partitionId(), 0, 0
    for batch in batches:
        sizes = batch.column("size").to_numpy()
        ends = held + np.cumsum(sizes)
        before = ends - sizes
        more = [pa.array(np.full(len(sizes), part, np.int32)), pa.array(before), pa.array(seen + np.arange(len(sizes), dtype=np.int64))]
        yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "__part", "__bytes", "__rows"])
        if len(sizes):
            held, seen = int(ends[-1]), seen + len(sizes)


def cuts(placed: DataFrame, total: int, shards: int, slack: float) -> list[int]:
    """Where shards end but for the last one, in bytes from the start, given ``placed(digest, size, start)``.

    At most ``shards - 1`` documents, and their groups' first and last bytes, come to the driver.
    """
    targets = [total * i // shards for i in range(1, shards)]
    if not targets:
        return []
    inside = [(F.col("start") <= t) & (F.col("start") + F.col("size") > t) for t in targets]
    at = placed.filter(sum((i.cast("int") for i in inside), F.lit(0)) > 0).select("digest").distinct()
    groups = placed.join(F.broadcast(at), "digest").groupBy("digest").agg(F.min("start").alias("first"), F.max(F.col("start") + F.col("size")).alias("last")).collect()
    out = []
    for t in targets:
        ends = [e for g in groups if g["first"] <= t < g["last"] for e in (g["first"], g["last"])]
        near = min(ends, key=lambda e: (abs(e - t), e), default=t)
        out.append(near if abs(near - t) <= slack * total / shards else t)
    return out


def shard(docs: DataFrame, shards: int = 8, slack: float = 0.005, carry: tuple[str, ...] = ()) -> DataFrame:
    """``(doc_id, size, text_crc32, law, shard, slot, grown_shard, *carry)``, a row for each row of ``docs(doc_id, text)``.

    The law is ``bytes``: two shards differ by no more than twice ``slack`` of an equal share and the longest document.
    ``slot`` counts a shard's documents from 0. ``grown_shard`` is null, as shards by bytes are cut anew when there are
    more of them. Null and empty texts have a size of 1. Rows that repeat an id and a text lie side by side, ids may be
    null, and a table with fewer documents than shards leaves some shards empty; an empty table has no rows. Documents
    longer than a shard's share are put where they begin. Columns of ``docs`` are ignored but for those named in
    ``carry``, which go with their rows; ``carry`` may not name one of the result's own.
    """
    small_batches(docs.sparkSession)
    rows = sized(docs, carry)
    if not carry:  # finding the ranges reads the rows once more: narrow ones rather than all texts
        rows = written(rows, "sized")
    ordered = rows.repartitionByRange("digest", "doc_id").sortWithinPartitions("digest", "doc_id")
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    ordered = written(ordered.mapInArrow(_running, f"{fields}, __part int, __bytes long, __rows long"), "ordered")
    # One row for each partition of the sort.
    totals = sorted(ordered.groupBy("__part").agg(F.sum("size"), F.count("*")).collect())
    offsets, bytes_, n = [], 0, 0
    for part, size, count in totals:
        offsets.append((part, bytes_, n))
        bytes_, n = bytes_ + size, n + count
    named = docs.sparkSession.createDataFrame(offsets, "__part int, __b long, __n long")
    placed = ordered.join(F.broadcast(named), "__part").withColumns({"start": F.col("__bytes") + F.col("__b"), "nth": F.col("__rows") + F.col("__n")})
    ends = cuts(placed.select("digest", "size", "start"), bytes_, shards, slack)
    number = _count(ends, F.col("start"))
    firsts = {r["shard"]: r["nth"] for r in placed.groupBy(number.alias("shard")).agg(F.min("nth").alias("nth")).collect()}
    first = F.lit([firsts.get(i, 0) for i in range(shards)]).cast("array<long>")
    out = placed.withColumn("shard", number)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("nth") - first[F.col("shard")]).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), *carry,
    )


def _count(ends: list[int], start: Column) -> Column:
    """How many cuts lie at or before a document's first byte."""
    return F.size(F.filter(F.lit(ends).cast("array<long>"), lambda e: e <= start)).cast("int") if ends else F.lit(0)


def write_shards(docs: DataFrame, path: str, shards: int = 8, slack: float = 0.005) -> None:
    """Writes ``docs`` with ``slot`` as Parquet, a folder ``shard=i`` for each shard that isn't empty, in order of slots within a file.

    Columns of ``docs`` named like one of ``shard`` (``size``, ``law``, ``slot``, ``shard``, ``text_crc32``,
    ``grown_shard``, ``digest``) are left out. Texts are moved once, by the sort.
    """
    own = {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard", "digest"}
    found = shard(docs, shards, slack, tuple(c for c in docs.columns if c not in own))
    found.drop("size", "text_crc32", "law", "grown_shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

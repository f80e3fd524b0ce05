"""How quality filters interact, whatever order they run in, by sorted posting lists.

Each filter keeps, for each part of the corpus and each range of ids, the sorted list of the documents that fail it. What
a filter removes after others is its list less the union of theirs. One galloping merge of all lists of a range finds
the runs of documents that fail just the same filters: the list that is behind jumps ahead by doubling steps to the end
of its run, or to where another list goes on. Sizes of unions and differences are sums of run lengths, and those of
ranges add up to those of a part.

Filters: A under 100 words, B many words repeat, C many capitals, D a symbol, E a copy of a document with a smaller id.

Texts are read once. Then only ids move, with a bit for each filter: once to find copies, once to be counted, once to be
put in order by part and id. Ranges are cut from that order, so parts of any size are dealt out over tasks, and a task
holds one range. Places in a list are numbers of documents within their range.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import join_skewed, small_batches, written

FILTERS = "ABCDE"
#: Documents in a range; what stands for a null id, before all others.
RANGE_ROWS, NO_ID = 65_536, -(1 << 63)
CAPITALS, SYMBOLS, CONTINUED = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|", bytes(range(0x80, 0xC0))
POSTINGS = "part string, low long, high long, n_rows int, times array<long>, fails array<array<int>>, good array<int>, toxic array<int>"
SIZES = "part string, filter int, others int, removed long, good long, toxic long"


def failures(data: bytes) -> int:
    """A bit for each of the filters A to D that a text fails."""
    words = data.split()
    n = len(words)
    bits = (n < 100) | (100 * len(set(words)) < 80 * n) << 1
    capitals, points = len(data) - len(data.translate(None, CAPITALS)), len(data.translate(None, CONTINUED))
    bits |= (100 * capitals > 10 * points) << 2
    return bits | (len(data.translate(None, SYMBOLS)) < len(data)) << 3


def _judged(docs: DataFrame) -> DataFrame:
    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [t or b"" for t in batch.column("data").to_pylist()]
            bits = pa.array(map(failures, texts), pa.int32())
            digests = pa.array([hashlib.blake2b(t, digest_size=16).digest() for t in texts], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), bits, digests], names=["doc_id", "part", "bits", "digest"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), F.col("text").cast("binary").alias("data"))
    return rows.mapInArrow(judged, "doc_id long, part string, bits int, digest binary")


def failing(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(part, doc_id, bits, good, toxic, times)``: documents with a bit for each filter they fail; equal rows once, counted."""
    small_batches(docs.sparkSession)
    judged = written(_judged(docs), "judged")
    copies = judged.filter("doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).filter("n > 1")
    known = join_skewed(judged, written(copies, "copies", judged.count()), ["digest"], "n", "left")
    copied = F.coalesce((F.col("doc_id") > F.col("first")).cast("int"), F.lit(0))
    bits = F.col("bits").bitwiseOR(F.shiftleft(copied, 4))
    counted = known.select("part", "doc_id", bits.alias("bits")).groupBy("part", "doc_id", "bits").agg(F.count("*").alias("times"))
    marks = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
    mark = lambda c: F.coalesce(c, F.lit(False)).alias(c)
    return counted.join(marks, "doc_id", "left").select("part", "doc_id", "bits", mark("good"), mark("toxic"), "times")


def postings(rows: DataFrame) -> DataFrame:
    """The lists of ``failing``'s rows, a row for each range of ids of a part, in order of ids; null ids come first.

    ``fails`` has a sorted list of places for each filter, ``good`` and ``toxic`` those of labelled documents, ``times``
    how many rows stand at each place.
    """

    def ranged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            for start in _starts(batch["part"]):
                piece = batch.iloc[slice(*start)]
                while len(piece):
                    if held and (held[-1]["part"].iat[0] != piece["part"].iat[0] or n == RANGE_ROWS):
                        yield _range(pd.concat(held))
                        held, n = [], 0
                    held.append(piece.iloc[: RANGE_ROWS - n])
                    piece = piece.iloc[RANGE_ROWS - n :]
                    n += len(held[-1])
        if held:
            yield _range(pd.concat(held))

    order = ["part", "doc_id", "bits"]
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))  # pandas has no nulls among integers
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInPandas(ranged, POSTINGS)


def _starts(parts: pd.Series) -> list[tuple[int, int]]:
    """From where to where rows of a part follow each other."""
    at = [0, *(np.flatnonzero((parts != parts.shift()).to_numpy()[1:]) + 1).tolist(), len(parts)]
    return list(zip(at, at[1:]))


def _range(rows: pd.DataFrame) -> pd.DataFrame:
    bits = rows["bits"].to_numpy()
    places = lambda mask: np.flatnonzero(mask).astype(np.int32)
    return pd.DataFrame({
        "part": [rows["part"].iat[0]], "low": [rows["doc_id"].iat[0]], "high": [rows["doc_id"].iat[-1]],
        "n_rows": [len(rows)], "times": [rows["times"].to_numpy()], "fails": [[places(bits >> f & 1) for f in range(len(FILTERS))]],
        "good": [places(rows["good"])], "toxic": [places(rows["toxic"])],
    })


def _leap(found: list[int], at: int, stop: int) -> int:
    """How many places of a list, from ``at`` on, follow one another without a gap and lie before ``stop``, by doubling steps."""
    base, n, step = found[at], len(found) - at, 1
    going = lambda i: i < n and found[at + i] == base + i and base + i < stop
    while going(step):
        step *= 2
    low, high = step // 2, min(step, n)
    while high - low > 1:
        middle = (low + high) // 2
        low, high = (middle, high) if going(middle) else (low, middle)
    return low + 1


def merged(lists: list[list[int]]) -> Iterator[tuple[int, int, int]]:
    """``(members, first, end)``: runs of places that stand in just the lists whose bits are set, in order."""
    at = [0] * len(lists)
    live = [i for i, found in enumerate(lists) if found]
    while live:
        first = min(lists[i][at[i]] for i in live)
        heads = [i for i in live if lists[i][at[i]] == first]
        stop = min((lists[i][at[i]] for i in live if i not in heads), default=1 << 62)
        run = min(_leap(lists[i], at[i], stop) for i in heads)
        yield sum(1 << i for i in heads), first, first + run
        for i in heads:
            at[i] += run
        live = [i for i in live if at[i] < len(lists[i])]


def union_size(lists: list[list[int]]) -> int:
    return sum(end - first for _, first, end in merged(lists))


def difference_size(one: list[int], others: list[list[int]]) -> int:
    return sum(end - first for members, first, end in merged([one, *others]) if members == 1)


def sizes(lists: DataFrame) -> DataFrame:
    """``SIZES``: what each filter removes after each set of others (``others``: bits), per part.

    A row with the number of filters for its filter counts all documents of the part.
    """
    subsets = 1 << len(FILTERS)
    pairs = [(f, s) for f in range(len(FILTERS)) for s in range(subsets) if not s >> f & 1]
    into = {m: [i for i, (f, s) in enumerate(pairs) if m >> f & 1 and not m & s] for m in range(1, subsets)}

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.itertuples(index=False):
                times = np.asarray(row.times, np.int64)
                marked = np.zeros((3, len(times) + 1), np.int64)
                marked[0, 1:] = times
                for k, places in ((1, row.good), (2, row.toxic)):
                    at = np.asarray(places, np.int64)
                    marked[k, at + 1] = times[at]
                sums = marked.cumsum(axis=1)
                by_members = np.zeros((subsets, 3), np.int64)
                for members, first, end in merged([np.asarray(x).tolist() for x in row.fails]):
                    by_members[members] += sums[:, end] - sums[:, first]
                out = np.zeros((len(pairs), 3), np.int64)
                for members, at in into.items():
                    out[at] += by_members[members]
                found = [*((f, s, *map(int, n)) for (f, s), n in zip(pairs, out)), (len(FILTERS), 0, *map(int, sums[:, -1]))]
                yield pd.DataFrame([(row.part, *f) for f in found], columns=["part", "filter", "others", "removed", "good", "toxic"])

    found = lists.select("part", "times", "fails", "good", "toxic").mapInPandas(counted, SIZES)
    return found.groupBy("part", "filter", "others").agg(F.sum("removed").alias("removed"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))


def orders(spark) -> DataFrame:
    """``(filter_order, step, filter, others)``: every order of the filters, its steps, and what ran before each (bits)."""
    n = len(FILTERS)
    rows = [("".join(FILTERS[f] for f in p), k + 1, p[k], sum(1 << f for f in p[:k])) for p in permutations(range(n)) for k in range(n)]
    return spark.createDataFrame(rows, "filter_order string, step int, filter int, others int")


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """A row for each part, order of the filters and step: ``(part, filter_order, step, kept, removed, redundant,
    unique_fails, good_lost, toxic_lost, shapley)``.

    ``docs(doc_id, text, lang)``; ``labels(doc_id, quality, toxic)``. A part is a value of ``lang``, null counting as an
    empty string. A null text is an empty one. Rows that repeat an id are documents of their own, and no copies of each
    other; a row without an id is no copy and has no labels. A document is good or toxic if any row of labels says so.
    Other columns are ignored; an empty table has no parts.
    """
    lists = written(postings(written(failing(docs, labels), "failing")), "postings")
    found = written(sizes(lists), "sizes")
    n, full = len(FILTERS), (1 << len(FILTERS)) - 1
    cell = lambda test, value: F.coalesce(F.sum(F.when(test, F.col(value))), F.lit(0))
    # A filter's removals over all orders: others that ran before it can be ordered in so many ways, those after it too.
    ways = F.lit([factorial(k) * factorial(n - 1 - k) for k in range(n)])[F.bit_count("others").cast("int")]
    facts = found.groupBy("part", "filter").agg(
        cell(F.col("others") == 0, "removed").alias("fails"), cell(F.col("others").bitwiseOR(F.lit([1 << f for f in range(n)] + [0])[F.col("filter")]) == full, "removed").alias("unique_fails"),
        F.sum(F.col("removed") * ways).alias("shapley"),
    )
    totals = found.filter(F.col("filter") == n).select("part", F.col("removed").alias("total"))
    lost = found.filter(F.col("filter") < n).join(facts, ["part", "filter"]).join(totals, "part")
    steps = lost.join(F.broadcast(orders(docs.sparkSession)), ["filter", "others"])  # 600 rows
    # What is kept after a step follows from what its order has removed by then.
    done = F.aggregate(F.filter("run", lambda r: r["step"] <= F.col("one.step")), F.lit(0).cast("long"), lambda a, r: a + r["removed"])
    fields = ["step", "total", "removed", "good", "toxic", "fails", "unique_fails", "shapley"]
    runs = steps.groupBy("part", "filter_order").agg(F.collect_list(F.struct(*fields)).alias("run")).withColumn("one", F.explode("run"))
    return runs.select(
        "part", "filter_order", "one.step", (F.col("one.total") - done).alias("kept"), "one.removed", (F.col("one.fails") - F.col("one.removed")).alias("redundant"),
        "one.unique_fails", F.col("one.good").alias("good_lost"), F.col("one.toxic").alias("toxic_lost"), "one.shapley",
    )

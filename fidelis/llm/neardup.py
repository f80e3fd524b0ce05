"""MinHash near-duplicates by an inverted join of signature coordinates.

1. *Signatures.* A task turns each text into its set of word shingles (64-bit hashes), a 128-bit digest of the set and
   ``coordinates`` minima. Documents of equal sets are one class, named by its smallest id; only classes go on.
2. *Posting.* A class is posted under each (coordinate, value) pair. Two classes with ``need`` equal coordinates out of
   ``k`` must share one of the ``k - need + 1`` rarest pairs of either (*prefix*), so the other lists, the long ones
   among them, are skipped; so is every class that has too few pairs in common with anything at all.
3. *Counting.* Classes that share a prefix pair meet in one group. A group is dealt out in blocks of bounded size, each
   with the group's first class, so that near-copies of that one are connected in one pass. Only classes that are not
   connected to it then meet the other blocks, two blocks in a task. In a meeting, equal coordinates are counted; pairs
   below ``need`` and pairs already connected are skipped (*skip merging*), the rest confirmed on the full sets. It
   returns a spanning forest of its links, not all its pairs.
4. *Components* of the links, and of the copies within the classes.

``need`` is the largest count that a pair at the threshold misses with a probability below ``miss``: 17 of 32 at 0.85.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import comb

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import bounded, join_skewed, let_go, written
from fidelis.llm.components import components

#: Classes and bytes of sets in a block; meetings up to which the classes' texts aren't shuffled to fetch them.
BLOCK_ROWS, BLOCK_BYTES, BROADCAST_MEETS = 1_000, 8_000_000, 500_000


def shingles(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of ``size``-word shingles of the whole text; of the whole sequence if it is shorter."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    size = min(size, len(words))
    known: dict[bytes, int] = {w: xxhash.xxh3_64_intdigest(w) for w in set(words)}
    h = np.array([known[w] for w in words], dtype=np.uint64)
    out = np.zeros(len(h) - size + 1, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(size):  # each place has its own odd factor, then the bits are mixed
            out = (out ^ (h[i : len(h) - size + 1 + i] * np.uint64(0x9E3779B97F4A7C15 + 2 * i))) * np.uint64(0xD6E8FEB86659FD93)
            out ^= out >> np.uint64(32)
        out += np.uint64(size)
    return np.unique(out)


def signature(found: np.ndarray, factors: np.ndarray) -> np.ndarray:
    """The minimum of the set under each factor, 32 bits each."""
    with np.errstate(over="ignore"):
        parts = [((found[at : at + 4096, None] * factors) >> np.uint64(32)).min(axis=0) for at in range(0, len(found), 4096)]
    return np.minimum.reduce(parts).astype(np.uint32)


def factors(coordinates: int) -> np.ndarray:
    return np.random.default_rng(20_011).integers(1, 2**63, size=coordinates, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def needed(coordinates: int, threshold: float, miss: float) -> int:
    """Equal coordinates that a pair at the threshold has but for a probability of ``miss`` at most."""
    at, below = 0, 0.0
    while below + (p := comb(coordinates, at) * threshold**at * (1 - threshold) ** (coordinates - at)) <= miss:
        below, at = below + p, at + 1
    return max(1, at)


def _signed(docs: DataFrame, size: int, coordinates: int) -> DataFrame:
    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        by = factors(coordinates)
        place = np.arange(coordinates, dtype=np.int64) << 32
        for batch in batches:
            sets = [shingles(t, size) for t in batch["text"]]
            yield pd.DataFrame({
                "doc_id": batch["doc_id"].astype("Int64"),
                "n_shingles": [len(s) for s in sets],
                "digest": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                "posts": [signature(s, by).astype(np.int64) + place if len(s) else None for s in sets],
            })

    return docs.mapInPandas(sign, "doc_id long, n_shingles long, digest binary, posts array<long>")


def _grouped(classes: DataFrame, coordinates: int, need: int) -> DataFrame:
    """``(doc_id, groups)``: for each class that may have a partner, the groups where it meets its candidates."""
    posts = classes.select("doc_id", F.explode("posts").alias("post"))
    lists = posts.groupBy("post").agg(F.count("*").alias("n"), F.min("doc_id").alias("head")).filter("n > 1")
    mine = posts.join(lists, "post").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("n", "post", "head"))).alias("posts"))
    # Posts that nobody else has are the rarest, so they come first in the prefix.
    left = F.size("posts") - (need - 1)
    prefix = F.slice("posts", F.lit(1), left)
    return mine.filter(left > 0).select("doc_id", F.array_distinct(F.transform(prefix, lambda p: p["head"])).alias("groups"))


def _blocks(n: str, size: str) -> Column:
    return F.ceil(F.greatest(F.col(n) / BLOCK_ROWS, F.col(size) / BLOCK_BYTES)).cast("int")


def _members(groups: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """``(head, doc_id, bytes, first, blocks, own)``: a class in a group, the group's first class and blocks, and its own block."""
    each = groups.select("doc_id", F.explode("groups").alias("head")).join(classes.select("doc_id", (F.col("n_shingles") * 8).alias("bytes")), "doc_id")
    each = written(each, "members", rows)
    sizes = each.groupBy("head").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum"), F.min("doc_id").alias("first")).filter("n > 1")
    sizes = written(sizes.select("head", "n", "first", _blocks("n", "sum").alias("blocks")), "sizes", rows)
    placed = join_skewed(each, sizes, ["head"], "n")
    return placed.withColumn("own", F.pmod(F.xxhash64("doc_id", F.lit(7)), "blocks").cast("int"))


def _meet(others: Column, row: Callable, col: Callable, own: Column, part: str) -> Column:
    return F.transform(others, lambda o: F.struct("head", row(o).alias("row"), col(o).alias("col"), own.alias("own"), F.col(part).alias("part")))


def _within(members: DataFrame) -> DataFrame:
    """``(doc_id, meets)``: each class meets those of its own block; a group's first class goes to all of its blocks."""
    blocks = F.when(F.col("doc_id") == F.col("first"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("own"))
    return members.select("doc_id", _meet(blocks, lambda o: o, lambda o: o, F.col("own"), "doc_id").alias("meets")).groupBy("doc_id").agg(
        F.flatten(F.collect_list("meets")).alias("meets")
    )


def _between(members: DataFrame, found: DataFrame, n_rows: int) -> DataFrame | None:
    """``(doc_id, meets)`` of what is left between the blocks of a group once ``found(node, component)`` is known.

    Classes connected to their group's first one need not meet each other again. The rest is dealt into blocks of its
    own, which meet one another and the blocks of the connected ones. None where nothing is left.
    """
    found = found.select(F.col("node"), F.col("component"))
    split = members.filter("blocks > 1")
    part = split.join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left").withColumn("part", F.coalesce("component", "doc_id"))
    part = written(part.drop("component"), "parts", n_rows)
    lead = part.filter("doc_id = first").select("head", F.col("part").alias("lead"))
    loose = part.join(bounded(lead, BROADCAST_MEETS), "head").withColumn("rest", F.col("part") != F.col("lead"))
    sizes = loose.filter("rest").groupBy("head").agg(F.count("*").alias("n"), F.sum("bytes").alias("sum"))
    sizes = written(sizes.select("head", _blocks("n", "sum").alias("loose")), "rest", n_rows)
    if sizes.isEmpty():
        return None
    dealt = loose.join(bounded(sizes, BROADCAST_MEETS), "head").withColumn("mine", F.pmod(F.xxhash64("doc_id", F.lit(11)), "loose").cast("int"))
    mine, other = F.col("mine"), F.col("loose") + F.col("own")
    every = F.sequence(F.lit(0), F.col("loose") + F.col("blocks") - 1)
    left = _meet(every, lambda o: F.least(mine, o), lambda o: F.greatest(mine, o), mine, "part")
    settled = _meet(F.sequence(F.lit(0), F.col("loose") - 1), lambda o: o, lambda o: other, other, "part")
    return dealt.select("doc_id", F.when(F.col("rest"), left).otherwise(settled).alias("meets")).groupBy("doc_id").agg(
        F.flatten(F.collect_list("meets")).alias("meets")
    )


def _linked(met: DataFrame, size: int, coordinates: int, need: int, percent: int) -> DataFrame:
    """Links ``(a, b)`` between classes that meet: ``met(doc_id, text, meets)``."""

    def spread(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        columns = ["doc_id", "head", "row", "col", "own", "part", "data"]
        for batch in batches:
            rows, held = [], 0
            for doc, text, meets in batch[["doc_id", "text", "meets"]].itertuples(index=False):
                data = shingles(text, size).tobytes()
                for m in meets:
                    rows.append((doc, m["head"], m["row"], m["col"], m["own"], m["part"], data))
                    held += len(data) + 100
                    if held >= BLOCK_BYTES:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
            if rows:
                yield pd.DataFrame(rows, columns=columns)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        by, key, held = factors(coordinates), None, []
        for batch in batches:
            out = []
            for doc, head, row, col, own, part, data in batch.itertuples(index=False):
                if (head, row, col) != key:
                    out += forest(held, key, by, need, percent)
                    key, held = (head, row, col), []
                held.append((doc, own, part, data))
            yield pd.DataFrame(out, columns=["a", "b"], dtype="int64")
        yield pd.DataFrame(forest(held, key, by, need, percent), columns=["a", "b"], dtype="int64")

    rows = met.mapInPandas(spread, "doc_id long, head long, row int, col int, own int, part long, data binary")
    rows = rows.repartition("head", "row", "col").sortWithinPartitions("head", "row", "col")
    return rows.mapInPandas(link, "a long, b long")


def forest(held: list, key: tuple | None, by: np.ndarray, need: int, percent: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among the members of a meeting, between its two blocks where they differ.

    Members of one part are connected already.
    """
    if len(held) < 2:
        return []
    sets = [np.frombuffer(data, np.uint64) for *_, data in held]
    signs = np.stack([signature(s, by) for s in sets])
    own = np.array([o for _, o, *_ in held])
    lengths = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    names, codes = np.unique(np.concatenate(sets), return_inverse=True)
    marked = np.zeros(len(names), np.int64)
    root, out = np.unique([part for _, _, part, _ in held], return_inverse=True)[1], []
    for i in range(len(held) - 1):
        near = i + 1 + np.flatnonzero((signs[i + 1 :] == signs[i]).sum(axis=1) >= need)
        near = near[root[near] != root[i]]
        if key[1] != key[2]:
            near = near[own[near] != own[i]]
        if not len(near):
            continue
        marked[codes[starts[i] : starts[i] + lengths[i]]] = 1
        if len(near) * 4 > len(held) - i:  # most of the rest: one pass over all of it
            rest = codes[starts[i + 1] :]
            both = np.add.reduceat(marked[rest], starts[i + 1 :] - starts[i + 1])[near - i - 1]
        else:
            both = np.array([marked[codes[starts[j] : starts[j] + lengths[j]]].sum() for j in near])
        marked[codes[starts[i] : starts[i] + lengths[i]]] = 0
        for j in near[100 * both >= percent * (lengths[i] + lengths[near] - both)]:
            if root[i] != root[j]:
                root[root == root[j]] = root[i]
                out.append((held[i][0], held[j][0]))
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, coordinates: int = 32, miss: float = 1e-5) -> DataFrame:
    """``(doc_id, n_shingles, component_id, kept)``, a row for each row of ``docs(doc_id, text)``; other columns are ignored.

    Documents are linked where ``100 * |A and B| >= percent * |A or B|`` over their sets of ``size``-word shingles.
    ``component_id`` is the smallest ``doc_id`` reachable over links, ``kept`` whether that is the row's own.
    A null, empty or blank text has an empty set and is linked with nothing. Texts may be of any length. Rows that
    repeat a ``doc_id`` are one document with all their links. A row without ``doc_id`` is linked with nothing, has a
    null component and is kept. An empty table gives an empty table.
    """
    need = needed(coordinates, percent / 100, miss)
    docs = docs.select("doc_id", "text")
    signed = written(_signed(docs, size, coordinates), "signatures")
    rows = signed.count()
    named = signed.filter("doc_id is not null and digest is not null")
    sets = written(named.groupBy("digest").agg(F.min("doc_id").alias("class"), F.count("*").alias("n")), "sets", rows)
    classes = named.join(sets.select("digest", F.col("class").alias("doc_id")), ["digest", "doc_id"]).dropDuplicates(["doc_id", "digest"])
    classes = written(classes.select("doc_id", "n_shingles", "posts"), "classes", rows)
    groups = written(_grouped(classes, coordinates, need), "groups", rows)
    inside = written(_members(groups, classes.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")), rows), "inside", rows)

    def linked(meets: DataFrame) -> DataFrame:
        meets = bounded(written(meets, "meets", rows), BROADCAST_MEETS, F.size("meets"))
        return _linked(docs.join(meets, "doc_id"), size, coordinates, need, percent)

    # A document is where its class is, so copies don't take part in the components, but for ids with several texts.
    members = written(join_skewed(named.select("doc_id", "digest"), sets, ["digest"], "n").select("doc_id", "class").distinct(), "members", rows)
    several = members.groupBy("doc_id").agg(F.count("*").alias("k")).filter("k > 1").select("doc_id")
    across = members.join(several, "doc_id").select(F.col("doc_id").alias("a"), F.col("class").alias("b"))
    sizes = members.groupBy("class").agg(F.count("*").alias("n"))
    connected = components(linked(_within(inside)).unionAll(across), rows)
    if (left := _between(inside, connected, rows)) is not None:
        connected = components(linked(left).unionAll(connected.select(F.col("node").alias("a"), F.col("component").alias("b"))), rows)
    found = written(connected.withColumnRenamed("node", "class").join(sizes, "class"), "found", rows)
    placed = join_skewed(members, found, ["class"], "n", "left").groupBy("doc_id").agg(F.min(F.coalesce("component", "class")).alias("component"))
    out = signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))

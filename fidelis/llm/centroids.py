"""Centroid clustering with an incrementally kept matrix of dot products.

Components are integers, so everything is exact. Next to each vector stand its dot products with all centroids. When a
centroid moves, only the components in which it moved change them: the product with the change's nonzero components is
added. The nearest centroid is then the smallest ``|c|^2 - 2 v.c``, as the vector's own norm is the same for all. The
matrix starts from centroids of zeros, whose products are 0.

Each round writes the vectors with their products and clusters as a table, so a lost executor costs one round's share.
Between rounds only sums of components by cluster come to the driver: ``k`` rows, whatever the number of vectors.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import written

#: Magnitude of components below which all products, distances and their differences fit into 64 bits, for 64 components.
MOST = 2**27
STATE = "vec_id long, q array<int>, norm long, dots array<long>, cluster int"


def quantised(vectors: DataFrame, dims: int = 64, scale: int = 64, vector: str = "embedding") -> DataFrame:
    """``(vec_id, q, norm)``: ``floor(scale * x)`` of the vectors with ``dims`` components, none null, NaN or infinite."""
    fit = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    least = F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")))
    rows = vectors.filter(F.coalesce(fit, F.lit(False))).select(F.col("vec_id").cast("long").alias("vec_id"), least.alias("q"))
    large = F.exists("q", lambda x: F.abs(x) >= MOST)
    said = F.raise_error(F.lit(f"a component of {MOST // scale:,} or more in magnitude can't be clustered exactly"))
    narrow = F.when(large, said.cast("array<int>")).otherwise(F.col("q").cast("array<int>"))
    return rows.select("vec_id", narrow.alias("q")).withColumn("norm", F.aggregate("q", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x.cast("long")))


def changes(before: list[list[int]], after: list[list[int]]) -> list[tuple[list[int], list[int]]]:
    """For each centroid the components in which it moved, and by how much."""
    out = []
    for one, other in zip(before, after):
        moved = [i for i, (a, b) in enumerate(zip(one, other)) if a != b]
        out.append((moved, [other[i] - one[i] for i in moved]))
    return out


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]), pa.array(values.ravel(), kind))


def moved(moves: list[tuple[list[int], list[int]]], norms: list[int]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Updates the dot products of a state's batches and assigns each vector to the nearest centroid, the first of equals."""

    def step(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, length = len(moves), np.array(norms, np.int64)
        for batch in batches:
            if not batch.num_rows:
                continue
            q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            dots = batch.column("dots").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, k).copy()
            for c, (at, by) in enumerate(moves):
                if at:
                    dots[:, c] += q[:, at].astype(np.int64) @ np.array(by, np.int64)
            cluster = (length - 2 * dots).argmin(axis=1).astype(np.int32)
            columns = [batch.column("vec_id"), batch.column("q"), batch.column("norm"), _lists(dots, pa.int64()), pa.array(cluster)]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "q", "norm", "dots", "cluster"])

    return step


def seeds(kept: DataFrame, k: int, salt: str) -> list[list[int]]:
    """The ``k`` vectors with the smallest SHA-256 of ``salt:vec_id``, in that order; those without an id come last."""
    digest = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("vec_id").cast("string")), 256)
    return [list(r["q"]) for r in kept.select("q", digest.alias("digest")).orderBy(F.asc_nulls_last("digest"), "q").limit(k).collect()]


def means(state: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """The exact floor of the mean of each cluster's vectors; the old centroid where it has none."""
    sums = [F.sum(F.col("q")[i].cast("long")).alias(f"s{i}") for i in range(len(centroids[0]))]
    out = list(centroids)
    for row in state.groupBy("cluster").agg(F.count("*").alias("n"), *sums).collect():
        out[row["cluster"]] = [row[f"s{i}"] // row["n"] for i in range(len(centroids[0]))]
    return out


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, dims: int = 64, scale: int = 64, salt: str = "1", vector: str = "embedding") -> DataFrame:
    """``(vec_id, cluster, distance, cluster_inertia, inertia, centroid, centroid_sha256)``, a row for each kept vector.

    Vectors are kept if they have ``dims`` components, none null, NaN or infinite, and count as ``floor(scale * x)``; a
    component that doesn't fit into 27 bits then ends the job with an error, since distances would not be exact. A sum of
    distances that doesn't fit into a long is null.
    ``rounds`` times every vector goes to the nearest centroid (squared Euclidean distance, the smaller number of
    equals) and every centroid that has vectors moves to the floor of their mean; then vectors are assigned once more.
    With fewer than ``k`` vectors there are as many centroids. Repeated rows are vectors of their own, ids may be null
    or repeat, equal vectors share a cluster, other columns are ignored, and a table without kept vectors has no rows.
    """
    kept = quantised(vectors, dims, scale, vector)
    centroids = seeds(kept, k, salt)
    none = [[0] * dims for _ in centroids]
    state = kept.withColumns({"dots": F.array_repeat(F.lit(0).cast("long"), len(centroids)), "cluster": F.lit(0)})
    if not centroids:
        named = {"distance": "long", "cluster_inertia": "long", "inertia": "long", "centroid": "array<int>", "centroid_sha256": "string"}
        return state.select("vec_id", "cluster", *[F.lit(None).cast(t).alias(n) for n, t in named.items()]).limit(0)
    before = none
    for at in range(rounds + 1):
        norms = [sum(x * x for x in c) for c in centroids]
        state = written(state.mapInArrow(moved(changes(before, centroids), norms), STATE), "dots")
        if at == rounds or (after := means(state, centroids)) == centroids:
            break  # centroids that stay leave every later round as it is
        before, centroids = centroids, after
    distance = F.col("norm") - 2 * F.col("dots")[F.col("cluster")] + F.lit(norms).cast("array<long>")[F.col("cluster")]
    near = state.select("vec_id", "cluster", distance.alias("distance"))
    sums = {r["cluster"]: int(r["d"]) for r in near.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(20,0)")).alias("d")).collect()}
    long = lambda n: n if n < 1 << 63 else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = lambda values, kind: F.array(*map(F.lit, values)).cast(f"array<{kind}>")[F.col("cluster")]
    return near.select(
        "vec_id", "cluster", "distance",
        own([long(sums.get(c, 0)) for c in range(len(centroids))], "long").alias("cluster_inertia"), F.lit(long(sum(sums.values()))).cast("long").alias("inertia"),
        F.array(*[F.lit(c) for c in centroids])[F.col("cluster")].alias("centroid"), own(digests, "string").alias("centroid_sha256"),
    )

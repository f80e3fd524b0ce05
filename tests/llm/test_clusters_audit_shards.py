"""Centroids, filter audits and shards against brute force, with ties, repeated rows, nulls, empty tables and clashing columns."""

import hashlib
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fidelis.llm import centroids, filteraudit, sharding
from fidelis.llm.queries import QUERIES

VECTORS = "vec_id long, embedding array<double>, cluster string, dots string, q string"
DOCS = "doc_id long, text string, lang string, part string, bits string, shard string"
LABELS = "doc_id long, quality int, toxic int"


# ---- 11 centroids


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, tuple(math.floor(64 * x) for x in v)) for i, v, *_ in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centers = [v for _, v in order[:k]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    near = lambda: [min(range(len(centers)), key=lambda c: (far(v, centers[c]), c)) for _, v in kept]
    for _ in range(rounds):
        found = near()
        for c in range(len(centers)):
            own = [v for (_, v), x in zip(kept, found) if x == c]
            if own:
                centers[c] = tuple(sum(xs) // len(own) for xs in zip(*own))
    found = near()
    out = [(i, c, far(v, centers[c])) for (i, v), c in zip(kept, found)]
    sums = Counter()
    for _, c, d in out:
        sums[c] += d
    name = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centers]
    return Counter((i, c, d, sums[c], sum(sums.values()), name[c]) for i, c, d in out)


def vectors(rng, n, dims):
    rows = [(i, [rng.gauss(i % 5, 0.4) for _ in range(dims)]) for i in range(n)]
    rows += [(3, rows[3][1]), (3, rows[4][1]), (None, rows[7][1]), (None, rows[7][1])]  # repeated rows, ids and vectors
    rows += [(n + i, [float(i % 2)] * dims) for i in range(12)]  # ties
    bad = [None, [], [0.5] * (dims - 1), [0.5] * (dims + 1), [None] + [0.1] * (dims - 1), [math.nan] + [0.1] * (dims - 1), [-math.inf] + [0.1] * (dims - 1)]
    return [(i, v, "x", "y", "z") for i, v in rows + [(1000 + i, v) for i, v in enumerate(bad)]]


@pytest.mark.parametrize("n, k, rounds, dims", [(80, 6, 3, 4), (3, 16, 3, 3), (60, 16, 5, 8), (40, 1, 2, 2), (40, 5, 0, 3)])
def test_clusters_equal_brute_force(spark, n, k, rounds, dims):
    rows = vectors(random.Random(n), n, dims) if n > 3 else [(i, [float(i)] * dims, None, None, None) for i in range(n)]
    found = centroids.cluster(spark.createDataFrame(rows, VECTORS).repartition(3), k, rounds, dims)
    got = Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect())
    assert got == plain_clusters(rows, k, rounds, dims)


def test_clusters_of_nothing_and_of_large_numbers(spark):
    none = spark.createDataFrame([(1, None, None, None, None), (2, [1.0], None, None, None)], VECTORS)
    assert centroids.cluster(none).count() == 0 and centroids.cluster(none.limit(0)).columns == centroids.cluster(none).columns
    edge = float(centroids.MOST - 1) / 64
    large = [(i, [edge * (1 if i % 3 else -1)] * 64, None, None, None) for i in range(20)]  # the largest distances there can be
    found = centroids.cluster(spark.createDataFrame(large, VECTORS), k=1)
    assert Counter(r["distance"] for r in found.collect()) == Counter(r[2] for r in plain_clusters(large, 1, 3, 64).elements())
    with pytest.raises(Exception, match="exactly"):
        centroids.cluster(spark.createDataFrame([(1, [1e300] * 64, None, None, None)], VECTORS)).collect()


def test_only_moved_components_are_updated():
    before, after = [[1, 2, 3], [4, 5, 6]], [[1, 0, 3], [4, 5, 6]]
    assert centroids.changes(before, after) == [([1], [-2]), ([], [])]


# ---- 12 filter audit


def plain_audit(docs, labels):
    low = {}
    for i, text, *_ in docs:
        if i is not None:
            low[text or ""] = min(low.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = defaultdict(list)
    for i, text, lang, *_ in docs:
        text = text or ""
        words = text.encode().split()
        fails = {"A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text)}
        fails |= {"D": any(c in "#$%&*|" for c in text), "E": i is not None and i > low[text]}
        rows[lang or ""].append(({f for f, x in fails.items() if x}, i in good, i in toxic))
    out, shapley = {}, Counter()
    for part, found in rows.items():
        for order in itertools.permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = set(order[:k])
                here = [r for r in found if f in r[0] and not r[0] & gone]
                again = sum(1 for r in found if f in r[0] and r[0] & gone)
                kept = sum(1 for r in found if not r[0] & (gone | {f}))
                only = sum(1 for r in found if r[0] == {f})
                out[part, "".join(order), k + 1] = [kept, len(here), again, only, sum(r[1] for r in here), sum(r[2] for r in here)]
                shapley[part, f] += len(here)
    return {key: (*v, shapley[key[0], key[1][key[2] - 1]]) for key, v in out.items()}


def audited(found):
    fields = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
    rows = found.collect()
    out = {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in fields) for r in rows}
    assert len(out) == len(rows)
    return out


def audit_rows(rng, n):
    docs = []
    for i in range(n):
        words = [rng.choice(["ab", "Cd", "EFG", "é", "x%", "zz", f"w{rng.randrange(400)}"]) for _ in range(rng.choice([0, 3, 99, 100, 140]))]
        if rng.random() < 0.5:
            words = [f"u{rng.randrange(10**6)}" for _ in words]
        docs.append((rng.randrange(3 * n) if i % 10 else None, rng.choice([" ", "\n", "\x0b", " "]).join(words) if i % 9 else None, rng.choice(["en", "fr", "", None, "a'b"]), "x", "y", "z"))
    docs += [(10**15 + i, rng.choice(docs)[1], "en", "x", "y", "z") for i in range(n)] + docs[:5] + [docs[0]] * 20
    docs += [(-(1 << 63), "least", "fr", "x", "y", "z"), (7, "A" * 300_000, "fr", "x", "y", "z"), (9, "Few capitals here", None, "x", "y", "z"), (11, "ÉÉé Ab" + "é" * 4, None, "x", "y", "z"), (8, "b " * 200_000, "fr", "x", "y", "z")]
    labels = [(rng.choice(docs)[0], rng.choice([0, 1, None]), rng.choice([0, 1, None])) for _ in range(n)]
    return docs, labels


@pytest.mark.parametrize("ranges", [None, 7])
def test_audit_equals_brute_force(spark, monkeypatch, ranges):
    docs, labels = audit_rows(random.Random(4), 60)
    if ranges:
        monkeypatch.setattr(filteraudit, "RANGE_ROWS", ranges)
    found = filteraudit.audit(spark.createDataFrame(docs, DOCS).repartition(4), spark.createDataFrame(labels, LABELS))
    assert audited(found) == plain_audit(docs, labels)


def test_audit_of_nothing(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert filteraudit.audit(none, labels).count() == 0
    nulls = [(None, None, None, None, None, None)] * 3
    assert audited(filteraudit.audit(spark.createDataFrame(nulls, DOCS), labels)) == plain_audit(nulls, [])


def test_merges_equal_sets():
    rng = random.Random(8)
    for _ in range(200):
        lists = [sorted(rng.sample(range(60), rng.choice([0, 1, 5, 30, 60]))) for _ in range(rng.randint(1, 6))]
        if rng.random() < 0.5:  # long runs, over which the merge leaps
            lists[0] = list(range(rng.randrange(5), rng.randrange(100, 2_000)))
        runs = list(filteraudit.merged(lists))
        want = {p: sum(1 << i for i, x in enumerate(lists) if p in set(x)) for x in lists for p in x}
        assert {p: m for m, a, b in runs for p in range(a, b)} == want and all(b > a for _, a, b in runs)
        assert filteraudit.union_size(lists) == len(want)
        assert filteraudit.difference_size(lists[0], lists[1:]) == len(set(lists[0]).difference(*lists[1:]))
    long = list(range(1_000_000))
    assert list(filteraudit.merged([long, [500_000]])) == [(1, 0, 500_000), (3, 500_000, 500_001), (1, 500_001, 1_000_000)]


# ---- 13 shards


def plain_shards(docs, n, slack):
    rows = sorted(((hashlib.md5((t or "").encode()).digest(), i is not None, i or 0, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in docs))
    total, at, spans = sum(r[3] for r in rows), 0, {}
    starts = []
    for r in rows:
        starts.append(at)
        at += r[3]
        first, _ = spans.get(r[0], (starts[-1], 0))
        spans[r[0]] = (first, at)
    ends = []
    for k in range(1, n):
        t = total * k // n
        near = [e for a, b in spans.values() if a <= t < b for e in (a, b)]
        best = min(near, key=lambda e: (abs(e - t), e)) if near else t
        ends.append(best if abs(best - t) <= slack * total / n else t)
    seen, out = Counter(), Counter()
    for r, start in zip(rows, starts):
        shard = sum(e <= start for e in ends)
        out[r[2] if r[1] else None, r[3], r[4], "bytes", shard, seen[shard], None] += 1
        seen[shard] += 1
    return out


def shard_rows(rng, n):
    docs = [(rng.randrange(10**9) if i % 11 else None, "é" * rng.randrange(200) + str(i) if i % 7 else None, None, "x", "y", "z") for i in range(n)]
    docs += [(10**12 + i, "the same text " * 9, None, "x", "y", "z") for i in range(n // 2)] + docs[:9] + [docs[1]] * 6
    return docs


@pytest.mark.parametrize("n, slack", [(8, 0.005), (3, 0.2), (1, 0.005), (200, 0.005)])
def test_shards_equal_brute_force(spark, n, slack):
    docs = shard_rows(random.Random(6), 90)
    found = sharding.shard(spark.createDataFrame(docs, DOCS).repartition(5), n, slack)
    got = Counter(tuple(r) for r in found.select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())
    assert got == plain_shards(docs, n, slack)


def test_shards_are_balanced_and_keep_small_groups_whole(spark):
    docs = [(i, f"text {i % 1500} " + "w" * (i % 1500 % 97), None, None, None, None) for i in range(3_000)]  # two copies each
    rows = sharding.shard(spark.createDataFrame(docs, DOCS), 8, 0.02).collect()
    sizes, of = Counter(), defaultdict(set)
    for r in rows:
        sizes[r["shard"]] += r["size"]
        of[r["size"], r["text_crc32"]].add(r["shard"])
    share = sum(sizes.values()) / 8
    assert len(sizes) == 8 and max(sizes.values()) - min(sizes.values()) <= 2 * 0.02 * share + 200
    assert all(len(s) == 1 for s in of.values())


def test_a_hot_group_is_split_and_long_documents_stand_alone(spark):
    docs = [(i, "copy", None, None, None, None) for i in range(1_000)] + [(5_000, "long " * 50_000, None, None, None, None)]
    rows = sharding.shard(spark.createDataFrame(docs, DOCS), 4).collect()
    assert sorted(r["slot"] for r in rows if r["size"] == 5) != [] and len(rows) == 1_001
    even = sharding.shard(spark.createDataFrame(docs[:-1], DOCS), 4).groupBy("shard").count().collect()
    assert {r["shard"]: r["count"] for r in even} == {0: 250, 1: 250, 2: 250, 3: 250}


def test_shards_of_nothing_and_written_shards(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    docs = spark.createDataFrame(shard_rows(random.Random(9), 40), DOCS)
    sharding.write_shards(docs, f"{tmp_path}/out", 4)
    back = spark.read.parquet(f"{tmp_path}/out")
    assert Counter(map(tuple, back.select("doc_id", "text", "lang").collect())) == Counter(map(tuple, docs.select("doc_id", "text", "lang").collect()))
    want = Counter((r["doc_id"], r["shard"], r["slot"]) for r in sharding.shard(docs, 4).collect())
    assert Counter((r["doc_id"], r["shard"], r["slot"]) for r in back.collect()) == want


def test_the_registered_queries_on_the_smallest_tables(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    assert audited(QUERIES["op12_filter_audit"](spark, sf)) == plain_audit(docs, labels)
    got = Counter(tuple(r) for r in QUERIES["op13_prefix_shards"](spark, sf).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard").collect())
    assert got == plain_shards(docs, 8, 0.005)
    found = QUERIES["op11_centroids"](spark, sf)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert Counter((r["vec_id"], r["cluster"], r["distance"], r["cluster_inertia"], r["inertia"], r["centroid_sha256"]) for r in found.collect()) == plain_clusters(rows, 16, 3, 64)

"""Benchmark decontamination by spaced-seed hashing; DataFrame functions only.

A fixed mask of ones and zeros slides over the tokens; a hash of the tokens under its ones is a seed, so a replaced
token under a zero does not spoil it. The seeds of the test items and of the training texts are joined. Around every
hit, the item is laid along the text, and the share of equal tokens is taken over every stretch of ``window`` item
tokens (the whole item if it is shorter) that holds the hit. A stretch with ``share`` or more equal tokens is an
overlap. With the two masks below, every stretch of 16 tokens with at most 3 replaced holds a hit, so none is missed.
Shorter items have masks of their own (``short_mask``): of 6 to 15 tokens with a fifth replaced three in a row are
left, of 5 two, and fewer tokens have to be there all. Texts are only hashed with masks that some item needs.

Only a seed's place leaves a text at first, so the work grows with its length. Texts with a hit are read again and laid
along their items. The test side is broadcast only if its seeds are counted to be ``broadcast_rows`` at most; with more,
the seeds are joined by a shuffle. The same goes for the hits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import bounded, written

MASKS = ("111011", "110111")


def tokens(text: Column) -> Column:
    """Runs of letters and digits of the whole lower-cased text; of a null text none."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hashes(text: Column) -> Column:
    return F.transform(tokens(text), lambda w: F.xxhash64(w))


def short_mask(tokens: int) -> str:
    """The mask for items of so many tokens, fewer than 16: so many in a row are left if a fifth of them is replaced."""
    return "1" * (3 if tokens > 5 else 2 if tokens == 5 else tokens)


def _seeds(df: DataFrame, keep: list[str], place: str, masks: tuple[str, ...]) -> DataFrame:
    """A row ``(*keep, place, seed)`` for each mask and place of the array ``h``."""
    def placed(mask: str) -> Column:
        ones = [i for i, c in enumerate(mask) if c == "1"]
        last = F.size("h") - len(mask)
        at = F.when(last >= 0, F.sequence(F.lit(0), F.greatest(last, F.lit(0)))).otherwise(F.array().cast("array<int>"))
        return F.transform(at, lambda i: F.struct(i.alias(place), F.xxhash64(F.lit(mask), *[F.get("h", i + k) for k in ones]).alias("seed")))

    return df.select(*keep, F.inline(F.concat(*map(placed, masks))))


def overlaps(docs: DataFrame, items: DataFrame, window: int = 16, share: float = 0.8, masks: tuple[str, ...] = MASKS, broadcast_rows: int = 500_000) -> DataFrame:
    """``(doc_id, item_id, matched, compared, doc_at, text_hash)``: the best overlap of each text with each item.

    Takes ``docs(doc_id, text)`` and ``items(item_id, text)``; other columns are ignored. ``matched`` of ``compared``
    tokens are equal, from token ``doc_at`` of the text on; of equal overlaps the first counts. Texts may be of any
    length. Null and empty texts and items overlap with nothing. Repeated rows give one row; a null ``doc_id`` or
    ``item_id`` is kept as such, and ``text_hash`` tells apart texts that share an id. Empty tables give an empty table.
    """
    tests = items.select("item_id", _hashes(F.col("text")).alias("h")).filter(F.size("h") > 0).dropDuplicates()
    tests = written(tests.withColumn("item", F.xxhash64("item_id", F.to_json("h"))), "items")
    short = sorted(r["n"] for r in tests.select(F.size("h").alias("n")).filter(F.col("n") < window).distinct().collect())  # below ``window``
    groups = [(masks, F.size("h") >= window)] + [((m,), F.size("h").isin([n for n in short if short_mask(n) == m])) for m in sorted({short_mask(n) for n in short})]
    seeds = [_seeds(tests.filter(fit), ["item"], "q", m).withColumn("wide", F.lit(max(map(len, m)))) for m, fit in groups]
    test_seeds = seeds[0]
    for more in seeds[1:]:
        test_seeds = test_seeds.unionAll(more)
    texts = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    used = tuple(m for ms, _ in groups for m in ms)
    placed = _seeds(texts.select("doc_id", "text_hash", _hashes(F.col("text")).alias("h")), ["doc_id", "text_hash"], "p", used)
    hits = placed.join(bounded(test_seeds, broadcast_rows), "seed").select("doc_id", "text_hash", "item", "wide", "q", (F.col("p") - F.col("q")).alias("d"))
    # Where an item lies along a text, hits of one diagonal start alike; each covers the stretches that hold its seed.
    hits = hits.groupBy("doc_id", "text_hash", "item", "wide", "d").agg(F.collect_set("q").alias("qs"))
    hits = written(hits.withColumnsRenamed({"doc_id": "id", "text_hash": "hash"}), "hits")
    found = texts.join(bounded(hits.select("id", "hash").distinct(), broadcast_rows), F.expr("doc_id <=> id and text_hash = hash"), "left_semi")
    found = found.dropDuplicates(["doc_id", "text_hash"]).select("doc_id", "text_hash", _hashes(F.col("text")).alias("h"))
    hits = found.join(hits, F.expr("doc_id <=> id and text_hash = hash")).drop("id", "hash")
    hits = hits.join(bounded(tests.select("item", "item_id", F.col("h").alias("ih")), broadcast_rows // 10), "item")
    length = F.least(F.size("ih"), F.lit(window))
    last = F.size("ih") - length

    def holding(q: Column) -> Column:
        high = F.least(q, last)
        return F.sequence(F.least(F.greatest(F.lit(0), q + F.col("wide") - length), high), high)

    starts = F.array_distinct(F.flatten(F.transform("qs", holding)))
    equal = lambda s, k: (F.get("h", F.col("d") + s + k) == F.get("ih", s + k)).cast("int")
    count = lambda s: F.aggregate(F.sequence(F.lit(0), length - 1), F.lit(0), lambda n, k: n + F.coalesce(equal(s, k), F.lit(0)))
    best = F.array_max(F.transform(starts, lambda s: F.struct(count(s).alias("matched"), (-(F.col("d") + s)).alias("back"))))
    found = hits.select("doc_id", "text_hash", "item_id", best.alias("best"), length.alias("compared"))
    found = found.filter(F.col("best.matched") >= F.ceil(F.lit(share) * F.col("compared") - 1e-9))
    out = found.groupBy("doc_id", "text_hash", "item_id").agg(F.max(F.struct("best.matched", "best.back", "compared")).alias("best"))
    return out.select("doc_id", "item_id", F.col("best.matched").cast("long").alias("matched"), F.col("best.compared").cast("long").alias("compared"), (-F.col("best.back")).cast("long").alias("doc_at"), "text_hash")


def decontaminate(docs: DataFrame, items: DataFrame, broadcast_rows: int = 500_000, **how) -> DataFrame:
    """The rows of ``docs`` whose text overlaps with no item, all columns as they are.

    Null and empty texts stay, as do all rows if there are no items. Rows that repeat stay or go together; of rows that
    share an id, or have none, each is judged by its own text. The texts are not shuffled while the ids of those to drop
    are ``broadcast_rows`` at most. An empty table gives an empty table.
    """
    hits = overlaps(docs, items, broadcast_rows=broadcast_rows, **how).select(F.col("doc_id").alias("__id"), F.col("text_hash").alias("__hash")).distinct()
    hits = bounded(written(hits, "overlapping"), broadcast_rows)
    return docs.join(hits, docs["doc_id"].eqNullSafe(F.col("__id")) & (F.xxhash64(docs["text"]) == F.col("__hash")), "left_anti")

"""Language identification by hyperdimensional profiles.

Every letter has a random vector of +1 and -1. An n-gram is bound from the vectors of its letters, each permuted
(rotated) by its place, by multiplication; a text is the bundle (sum) of its n-grams, spaces at word ends included; a
language is the bundle of the texts labelled with it. A text is predicted to be in the language whose prototype has the
largest cosine with the text's vector, both less the mean of the prototypes, which all languages share.

Letters get their vectors from their code points, so workers agree without exchanging tables. Tasks sum the vectors of
their texts by language and send one partial sum each, so training covers every labelled row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import kept

#: Dimensions, letters in an n-gram, n-gram vectors remembered in a worker (as bytes: 64 MB).
DIMENSIONS, ORDER, REMEMBERED = 1024, 3, 65_536
#: Languages whose prototypes are held in a worker (as doubles: 32 MB).
MOST_LANGUAGES = 4_096
#: A cosine margin between the first and the second language that gives a score of about 0.73.
TEMPERATURE = 0.1


class Space:
    """Vectors of letters and n-grams in one worker."""

    def __init__(self, dimensions: int = DIMENSIONS, order: int = ORDER) -> None:
        self.dimensions, self.order = dimensions, order
        self.letters: dict[int, np.ndarray] = {}
        self.place: dict[int, int] = {}
        self.table = np.empty((1024, dimensions), np.int8)
        self.gap = regex.compile(r"\P{L}+")

    def letter(self, code: int) -> np.ndarray:
        if code not in self.letters:
            if len(self.letters) > 100_000:
                self.letters.clear()
            self.letters[code] = np.random.default_rng(code + 1).integers(0, 2, self.dimensions, np.int8) * 2 - 1
        return self.letters[code]

    def bound(self, gram: int) -> np.ndarray:
        out = np.ones(self.dimensions, np.int8)
        for n in range(self.order):
            out *= np.roll(self.letter((gram >> (21 * n)) & 0x1FFFFF), n)
        return out

    def rows(self, grams: np.ndarray) -> np.ndarray:
        """Places of n-grams in the table, which forgets everything when it is full."""
        fresh = [g for g in grams.tolist() if g not in self.place]
        if len(self.place) + len(fresh) > REMEMBERED:
            self.place.clear()
            fresh = grams.tolist()
        while len(self.table) < len(self.place) + len(fresh):
            self.table = np.concatenate((self.table, np.empty_like(self.table)))
        for g in fresh:
            self.table[len(self.place)] = self.bound(g)
            self.place[g] = len(self.place)
        return np.fromiter(map(self.place.__getitem__, grams.tolist()), np.int64, len(grams))

    def vector(self, text: str | None) -> np.ndarray | None:
        """The bundle of the whole text's n-grams; None without letters."""
        cut = self.gap.sub(" ", (text or "").lower()).strip()
        if not cut:
            return None
        codes = np.frombuffer(f" {cut} ".encode("utf-32-le"), np.uint32).astype(np.int64)
        grams = np.zeros(len(codes) - self.order + 1, np.int64)
        for n in range(self.order):
            grams |= codes[n : len(codes) - self.order + 1 + n] << (21 * n)
        grams, counts = np.unique(grams, return_counts=True)
        out = np.zeros(self.dimensions, np.float32)
        for at in range(0, len(grams), 2048):
            rows = self.rows(grams[at : at + 2048])
            out += counts[at : at + 2048].astype(np.float32) @ self.table[rows].astype(np.float32)
        return out


def _space() -> Space:
    return kept("letters", Space)


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> dict[str, np.ndarray]:
    """A prototype for each non-null ``lang``, from every row that has one and a text with letters.

    Only the sums come to the driver: ``DIMENSIONS`` numbers for each language. Each text counts by its direction, so a
    very long one weighs no more than others. Null labels and texts, and texts without letters, are left out; repeated
    rows count each time; an empty table, or one without labels, gives no prototypes. Other columns are ignored.
    """

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for t, label in zip(batch["text"], batch["lang"]):
                if (v := _space().vector(t)) is not None and (n := np.linalg.norm(v)):
                    total[label] = total.get(label, 0) + np.round(v.astype(np.float64) / n * 2**20).astype(np.int64)
        if total:  # a partition without a labelled row has nothing to say
            yield pd.DataFrame({"lang": list(total), "sums": list(total.values())})

    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    partial = rows.mapInPandas(sums, "lang string, sums array<long>").select("lang", F.posexplode("sums"))
    summed = partial.groupBy("lang", "pos").agg(F.sum("col").alias("v")).groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("pos", "v"))).alias("v"))
    rows = summed.limit(MOST_LANGUAGES + 1).collect()
    if len(rows) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages; their prototypes don't fit in a worker")
    return {r["lang"]: np.array([x["v"] for x in r["v"]], np.float64) for r in rows}


def predict(docs: DataFrame, prototypes: dict[str, np.ndarray], text: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred``, ``score`` (0 to 1) and ``similarity``, the cosine with the language's prototype.

    ``und``, 0 and 0 for null texts and texts without letters, or without prototypes. Whole texts of any length are
    bundled, distinct n-grams at a time. Of equal cosines the first name
    counts. Columns with these names are replaced; rows repeat as they do in ``docs``; an empty table gives an empty one.
    """
    names = sorted(prototypes)
    units = np.stack([prototypes[n] / (np.linalg.norm(prototypes[n]) or 1) for n in names]) if names else np.zeros((0, DIMENSIONS))
    mean = units.mean(axis=0) if len(names) > 1 else np.zeros(DIMENSIONS)
    sides = units - mean
    sides /= np.maximum(np.linalg.norm(sides, axis=1, keepdims=True), 1e-12)

    @F.pandas_udf("lang_pred string, score double, similarity double")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for t in batch:
                v = _space().vector(t) if names else None
                if v is None or not (n := np.linalg.norm(v)):
                    out.append(("und", 0.0, 0.0))
                    continue
                unit = v / n
                own = unit - mean
                cosines = sides @ (own / (np.linalg.norm(own) or 1))
                best = int(cosines.argmax())
                shares = np.exp((cosines - cosines[best]) / TEMPERATURE)
                out.append((names[best], float(1 / shares.sum()), float(units[best] @ unit)))
            yield pd.DataFrame(out, columns=["lang_pred", "score", "similarity"])

    # Marked as not deterministic so that a filter on the result doesn't make Spark run it a second time.
    found = docs.withColumn("__guess", guess.asNondeterministic()(F.col(f"`{text}`")))
    return found.withColumns({c: F.col(f"__guess.{c}") for c in ("lang_pred", "score", "similarity")}).drop("__guess")


def fold(doc_id: Column, folds: int) -> Column:
    """The fold of a document: crc32 of its id as text, modulo ``folds``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % folds

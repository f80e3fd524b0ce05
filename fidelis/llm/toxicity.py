"""Toxicity by compression distance.

Two zstandard dictionaries are trained apart. The ordinary one is trained on windows of ordinary text. The toxic one is
trained on toxic text from which what ordinary text has as well is taken out first: most words of a toxic text are
ordinary, and zstandard's trainer, given them all, would spend the dictionary on those (figures in the README). What is
left are letter segments that ``LIFT`` times as large a share of toxic documents has, with a log likelihood of ``GAIN``.
The toxic dictionary is laid behind a copy of the ordinary one, so that what both kinds of text share costs the same and
cancels out: a window of a few words is compressed with each, and the bytes that the toxic one saves are its distance.

A document's evidence is what its windows save, those that save enough, for each window that it has. Two thresholds are
calibrated on documents that the toxic dictionary in question hasn't seen, each half of the sample with one from the
other half: from which saving on a window counts, and from which evidence on a document is toxic (best F0.5, which
weighs precision more). The final dictionaries are trained on all of the sample.

Labels are learned from a bounded sample (``sample`` toxic documents and twice as many ordinary ones, those with the
smallest digests of their ids), whole texts of it; every whole text is scored, a window at a time.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import kept, sampled

#: Words in a window and from one window to the next.
WINDOW, STEP = 6, 3
#: Letters in a marking segment; how much more often (by documents) toxic text has it, and the log likelihood of that.
SEGMENT, LIFT, GAIN = (5, 6, 7), 4.0, 6.0
#: Bytes of the dictionaries, which zstandard's trainer fills with the commonest parts; how much text it wants for each
#: byte; compression level, shortest match, bits of the tables; windows that every document is taken to have in addition,
#: so that a very short one needs more than one of its few.
ORDINARY_BYTES, TOXIC_BYTES, WANTED, LEVEL, MIN_MATCH, TABLE, SMOOTHING = 32_768, 1_024, 100, 3, 5, 18, 10


def windows(text: str | None) -> Iterator[bytes]:
    """Windows over all words, each with a space before and after."""
    words = (text or "").lower().split()
    for at in range(0, max(len(words) - WINDOW + STEP, 1) if words else 0, STEP):
        yield (" " + " ".join(words[at : at + WINDOW]) + " ").encode()


def segments(words: set[str]) -> set[str]:
    return {w[i : i + n] for w in (f" {w} " for w in words) for n in SEGMENT for i in range(len(w) - n + 1)}


def counted(texts: list[str]) -> Counter:
    """How many of the texts have each segment.

    A word counts once with the words beside it, so a text's copies and near-copies don't make its rare words common.
    """
    out, seen = Counter(), set()
    for t in texts:
        words = ["", *t.lower().split(), ""]
        fresh = set()
        for before, word, after in zip(words, words[1:], words[2:]):
            if (place := xxhash.xxh3_64_intdigest(f"{before} {word} {after}")) not in seen:
                seen.add(place)
                fresh.add(word)
        out.update(segments(fresh))
    return out


def marks(have: Counter, lack: Counter, n_toxic: int, n_ordinary: int) -> set[str]:
    """Segments that toxic texts have more often than ordinary ones, by more than chance gives."""
    share = n_toxic / max(1, n_toxic + n_ordinary)
    out = set()
    for piece, n in have.items():
        expected = (n + lack[piece] + 1) * share
        if n * (n_ordinary or 1) >= LIFT * (lack[piece] + 1) * n_toxic and n * np.log(n / expected) - (n - expected) >= GAIN:
            out.add(piece)
    return out


def marked(text: str, found: set[str]) -> list[bytes]:
    """The parts of a text that marking segments cover."""
    out = []
    for word in text.lower().split():
        w = f" {word} "
        cover = np.zeros(len(w), bool)
        for n in SEGMENT:
            for i in range(len(w) - n + 1):
                if w[i : i + n] in found:
                    cover[i : i + n] = True
        if cover.any():
            out.append("".join(c for c, yes in zip(w, cover) if yes).encode())
    return out


def trained(samples: list[bytes], size: int) -> bytes:
    """zstandard's dictionary of ``size`` bytes or, where there is too little to train on, of the next smaller size that it can fill.

    A small sample is repeated, as the trainer wants much more text than the dictionary has bytes.
    """
    again = max(1, WANTED * size // max(1, sum(map(len, samples))))
    while samples and size >= 256:
        try:
            return zstandard.train_dictionary(size, samples * min(again, WANTED)).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b""


def compressor(content: bytes) -> zstandard.ZstdCompressor:
    # The same tables for every dictionary, with room for all of it, so that lengths differ by the content alone.
    how = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, window_log=18, hash_log=TABLE, chain_log=TABLE, min_match=MIN_MATCH, write_content_size=False, write_checksum=False, write_dict_id=False
    )
    held = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    held.precompute_compress(compression_params=how)
    return zstandard.ZstdCompressor(dict_data=held, compression_params=how)


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    #: The saving from which on a window counts, the evidence from which on a document is toxic.
    window: int
    document: float


class Scorer:
    """A model in one worker."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self.plain, self.both = compressor(model.ordinary), compressor(model.ordinary + model.toxic)

    def savings(self, text: str | None) -> list[int]:
        plain, both = self.plain.compress, self.both.compress
        return [len(plain(w)) - len(both(w)) for w in windows(text)]

    def score(self, text: str | None) -> float:
        found = evidence(self.savings(text), self.model.window)
        return found / (found + self.model.document)


def evidence(savings: list[int], least: int) -> float:
    return sum(s for s in savings if s >= least) / (len(savings) + SMOOTHING)


def toxic_dictionary(toxic: list[str], found: set[str]) -> bytes:
    return trained([b"".join(p) for t in toxic if (p := marked(t, found))], TOXIC_BYTES)


def fit(toxic: list[str], ordinary: list[str], beta: float = 0.5) -> Model:
    """Dictionaries from all of the sample, thresholds from each half of it with a toxic dictionary from the other half.

    ``beta`` weighs precision against recall, as in the F measure: below 1, precision counts for more. The ordinary
    dictionary is in both of a comparison's sides, so the halves share it.
    """
    plain = trained([w for t in ordinary for w in windows(t)], ORDINARY_BYTES)
    halves = [[texts[half::2] for half in (0, 1)] for texts in (toxic, ordinary)]
    have, lack = ([counted(texts) for texts in kind] for kind in halves)
    each: list[tuple[bool, list[int]]] = []
    for half in (0, 1):
        found = marks(have[half], lack[half], len(halves[0][half]), len(halves[1][half]))
        scorer = Scorer(Model(plain, toxic_dictionary(halves[0][half], found), 1 << 20, 1.0))
        each += [(kind, scorer.savings(t)) for kind, texts in ((True, halves[0]), (False, halves[1])) for t in texts[1 - half]]
    kinds, best = np.array([kind for kind, _ in each], bool), (0.0, 1 << 20, 1.0)
    for least in range(2, 9):
        sums = np.array([evidence(savings, least) for _, savings in each])
        order = np.argsort(-sums, kind="stable")
        fits = (1 + beta**2) * kinds[order].cumsum() / (np.arange(1, len(order) + 1) + beta**2 * max(1, kinds.sum()))
        last = np.append(sums[order][:-1] > sums[order][1:], True) & (sums[order] > 0)  # a threshold takes all of equal evidence
        if last.any():
            at = int(np.where(last, fits, -1).argmax())
            best = max(best, (float(fits[at]), least, float(sums[order][at])))
    found = marks(have[0] + have[1], lack[0] + lack[1], len(toxic), len(ordinary))
    return Model(plain, toxic_dictionary(toxic, found), best[1], best[2])


def _scorer(model: Model) -> Scorer:
    return kept((model.ordinary, model.toxic, model.window, model.document), lambda: Scorer(model))


def train(docs: DataFrame, labels: DataFrame, sample: int = 2_000, sample_chars: int = 50_000_000) -> Model:
    """A model from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    At most ``sample`` toxic and twice as many ordinary documents, by the smallest digests of their ids, come to the
    driver, and no more of them than have ``sample_chars`` characters together (whole texts, in that order). Null ids,
    labels and texts are left out; an id that is labelled more than once counts as toxic if one label says so. Without
    toxic and ordinary labels every text scores 0.
    """
    each = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    rows = sampled(docs, each, "toxic", {True: sample, False: 2 * sample}, sample_chars)
    return fit([t for kind, t in rows if kind], [t for kind, t in rows if not kind])


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with ``score`` (0 to 1; higher: toxic is likelier) and ``predicted`` (1 from 0.5 on).

    Whole texts are scored. Null, empty and blank texts have no windows, so no evidence, and score 0.
    Rows repeat as they do in ``docs``, columns of these names are replaced, an empty table gives an empty table.
    """
    model = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = _scorer(model.value)
        for batch in batches:
            yield pd.Series([own.score(t) for t in batch], dtype="float64")

    found: Column = scored.asNondeterministic()(F.col(f"`{text}`"))
    return docs.withColumn("score", found).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))

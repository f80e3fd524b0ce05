"""Quality rules with line labels from a linear-chain conditional random field.

A document is a chain of its lines. Each line has a few numbers (length, symbols, capitals, separators, repetition, line
ends); a linear-chain CRF weighs them, and the labels of neighbouring lines, and Viterbi decoding marks each line as
content or boilerplate. A document is kept if its base rules hold and enough of its words are in content lines.

The field is trained here on all lines of a bounded sample of labelled documents. Lines get weak labels of their own, as
good documents hold some boilerplate and bad ones some content: a logistic regression of the document's label on the
line's numbers says which lines look like those of good documents, and those count as content wherever they are; a bad
document keeps its least such line as boilerplate. The field is fitted to these mixed chains by its exact gradient
(forward and backward sums). The share of content from which on a document is kept is the one that divides the sample
best. Decoding covers every line of every text; the counts of the base rules cover the whole text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import sampled

#: Lines in a piece of a chain: training cuts long chains into consecutive pieces, all of them used, to bound padding.
PIECE = 64
SYMBOLS = str.maketrans("", "", "#*$%&|<>")
MARKS = re.compile(r"[^\w\s]")
FEATURES = 14


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words`` of the whole text."""
    text = text or ""
    words = text.encode().split()
    n_symbols = len(text) - len(text.translate(SYMBOLS))
    seen: set[bytes] = set()
    dup = 0
    for line in text.encode().split(b"\n"):
        if line.strip(b" \t\n\r\x0b\x0c"):
            dup += line in seen
            seen.add(line)
    return len(words), sum(len(w.decode()) for w in words), n_symbols, dup, repeated_words(words)


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a three-word window found twice or more."""
    if len(words) < 4:
        return 0
    known: dict[bytes, int] = {}
    ids = np.array([known.setdefault(w, len(known)) for w in words], np.int64)
    pairs = np.unique(ids[:-1] * len(known) + ids[1:], return_inverse=True)[1].astype(np.int64)
    windows, counts = np.unique(pairs[:-1] * len(known) + ids[2:], return_inverse=True, return_counts=True)[1:]
    twice = counts[windows] > 1
    cover = np.zeros(len(words), bool)
    for at in range(3):
        cover[at : len(words) - 2 + at] |= twice
    return int(cover.sum())


def line_features(text: str) -> tuple[np.ndarray, np.ndarray]:
    """``(features, words)``: a row for each line with a word, and its number of words."""
    rows, sizes, seen = [], [], set()
    for line in text.split("\n"):
        words = line.split()
        if not words:
            continue
        n, chars = len(words), len(line)
        marks = len(MARKS.findall(line))
        upper = sum(map(str.isupper, words))
        bare = len(set(words)) / n
        symbols = chars - len(line.translate(SYMBOLS))
        loud = line.count("!!")
        rows.append((
            1.0, min(n, 50) / 50, n <= 3, symbols / n, min(symbols / n, 0.5) * 2, marks / chars, upper / n, loud / n,
            bare, n > 20 and bare < 0.5, chars / n / 10, words[-1][-1] in ".!?:\"", line in seen, line.count("|") / n,
        ))
        sizes.append(n)
        seen.add(line)
    return np.array(rows, np.float64).reshape(-1, FEATURES), np.array(sizes, np.int64)


@dataclass
class Field:
    """Weights of the features for content (against boilerplate), of label pairs, and of the first label."""

    lines: np.ndarray
    pairs: np.ndarray
    first: np.ndarray
    #: The share of words in content lines from which on a document is kept.
    share: float = 0.5


def viterbi(field: Field, features: np.ndarray) -> np.ndarray:
    """The likeliest labels of a chain: 1 content, 0 boilerplate. Ties go to content."""
    if not len(features):
        return np.zeros(0, np.int64)
    gains = (features @ field.lines).tolist()
    (p00, p01), (p10, p11) = field.pairs.tolist()
    zero, one = field.first[0], field.first[1] + gains[0]
    back = []
    for g in gains[1:]:
        from0, from1 = (zero + p00 > one + p10), (zero + p01 > one + p11)
        back.append((0 if from0 else 1, 0 if from1 else 1))
        zero, one = (zero + p00 if from0 else one + p10), (zero + p01 if from1 else one + p11) + g
    out = [1 if one >= zero else 0]
    for pointers in reversed(back):
        out.append(pointers[out[-1]])
    return np.array(out[::-1])


def _gradient(field: Field, chains: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> Field:
    """The mean gradient of the log likelihood over padded chains ``(chains, lines, features)`` with a label for each line."""
    docs, most, _ = chains.shape
    score = np.zeros((docs, most, 2))
    score[:, :, 1] = chains @ field.lines
    ahead = np.zeros((docs, most, 2))
    ahead[:, 0] = field.first + score[:, 0]
    for t in range(1, most):
        ahead[:, t] = np.logaddexp(ahead[:, t - 1, :1] + field.pairs[0], ahead[:, t - 1, 1:] + field.pairs[1]) + score[:, t]
    behind = np.zeros((docs, most, 2))
    for t in range(most - 2, -1, -1):
        nxt = behind[:, t + 1] + score[:, t + 1]
        step = np.stack([np.logaddexp(nxt[:, 0] + field.pairs[i, 0], nxt[:, 1] + field.pairs[i, 1]) for i in (0, 1)], axis=1)
        behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
    total = np.logaddexp(*ahead[np.arange(docs), lengths - 1].T)
    inside = np.arange(most) < lengths[:, None]
    share = np.exp(ahead + behind - total[:, None, None]) * inside[:, :, None]
    lines = ((labels * inside - share[:, :, 1])[:, :, None] * chains).sum(axis=(0, 1))
    pairs = np.zeros((2, 2))
    both = inside[:, 1:]
    for i in (0, 1):
        for j in (0, 1):
            p = np.exp(ahead[:, :-1, i] + field.pairs[i, j] + score[:, 1:, j] + behind[:, 1:, j] - total[:, None])
            pairs[i, j] = (both * ((labels[:, :-1] == i) * (labels[:, 1:] == j) - p)).sum()
    first = np.array([(labels[:, 0] == i).sum() for i in (0, 1)]) - share[:, 0].sum(axis=0)
    return Field(lines / docs, pairs / docs, first / docs)


def line_labels(good: list[np.ndarray], bad: list[np.ndarray]) -> list[np.ndarray]:
    """Weak labels of the lines of good and then of bad documents: 1 where a line looks like those of good documents."""
    x = np.concatenate(good + bad)
    y = np.concatenate([np.full(len(f), int(kind)) for kind, docs in ((True, good), (False, bad)) for f in docs])
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    w = np.zeros(FEATURES)
    for _ in range(30):  # Newton's method with a small penalty
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.eye(FEATURES), x.T @ (weight * (p - y)) + w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    out = []
    for n, f in enumerate(good + bad):
        labels = (f @ w >= 0).astype(np.int64)
        if n >= len(good):
            labels[int((f @ w).argmin())] = 0
        out.append(labels)
    return out


def fit(good: list[str], bad: list[str], rounds: int = 150, penalty: float = 0.002) -> Field:
    """A field trained by ascent with a momentum and a penalty; both kinds weigh as they come."""
    field = Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    kinds = [[found for t in texts if len((found := line_features(t))[0])] for texts in (good, bad)]
    if not any(kinds):
        return field
    labelled = line_labels([f for f, _ in kinds[0]], [f for f, _ in kinds[1]])
    pieces = [(f[at : at + PIECE], y[at : at + PIECE]) for (f, _), y in zip(kinds[0] + kinds[1], labelled) for at in range(0, len(f), PIECE)]
    lengths = np.array([len(y) for _, y in pieces])
    chains, labels = np.zeros((len(pieces), int(lengths.max()), FEATURES)), np.full((len(pieces), int(lengths.max())), -1)
    for i, (f, y) in enumerate(pieces):
        chains[i, : len(f)], labels[i, : len(y)] = f, y
    push = Field(np.zeros(FEATURES), np.zeros((2, 2)), np.zeros(2))
    for _ in range(rounds):
        slope = _gradient(field, chains, lengths, labels)
        for name in ("lines", "pairs", "first"):
            step = 0.9 * getattr(push, name) + 0.05 * (getattr(slope, name) - penalty * getattr(field, name))
            setattr(push, name, step)
            setattr(field, name, getattr(field, name) + step)
    shares = [np.sort([sizes[viterbi(field, f) == 1].sum() / sizes.sum() for f, sizes in kind]) for kind in kinds]
    field.share = dividing(*shares)
    return field


def dividing(good: np.ndarray, bad: np.ndarray) -> float:
    """The share that keeps most of the good and drops most of the bad documents; of equals the one nearest to a half."""
    if not len(good) or not len(bad):
        return 0.5
    found = np.unique(np.concatenate((good, bad)))
    bounds = [b for b in (found[:-1] + found[1:]) / 2 if 0.01 <= b <= 0.99] or [0.5]
    return float(max(bounds, key=lambda b: (round((good >= b).mean() + (bad < b).mean(), 9), -abs(b - 0.5))))


def train(docs: DataFrame, labels: DataFrame, sample: int = 600, sample_chars: int = 20_000_000) -> Field:
    """A field from ``docs(doc_id, text)`` and ``labels(doc_id, quality)``.

    At most ``sample`` bad documents and twice as many good ones, by the smallest digests of their ids, come to the
    driver, and no more of them than have ``sample_chars`` characters together (whole texts, in that order). Null ids,
    labels and texts are left out; an id labelled more than once counts as bad if one label says so. Without labels
    every line is content.
    """
    each = labels.filter("doc_id is not null and quality is not null").groupBy("doc_id").agg((F.min("quality") > 0).alias("quality"))
    rows = sampled(docs, each, "quality", {False: sample, True: 2 * sample}, sample_chars)
    return fit([t for kind, t in rows if kind], [t for kind, t in rows if not kind])


COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long, n_content_lines long, content_words long"


def judge(docs: DataFrame, field: Field, min_share: float | None = None, text: str = "text") -> DataFrame:
    """``docs`` with the counts ``COUNTS``, ``base_failed``, ``content_share`` and ``kept``.

    ``base_failed``: under 50 words, or over half of the words in repeated three-word windows. ``kept``: not that, and
    ``min_share`` of the words (the field's ``share`` unless given) or more in content lines. Null, empty and blank texts have no words and fail. Columns of
    these names are replaced; rows repeat as they do in ``docs``; an empty table gives an empty table.
    """

    @F.pandas_udf(COUNTS)
    def counted(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        names = [c.split(" ")[0] for c in COUNTS.split(", ")]
        for batch in batches:
            out = []
            for t in batch:
                features, sizes = line_features(t or "")
                content = viterbi(field, features) == 1
                out.append((*base_counts(t), len(sizes), int(content.sum()), int(sizes[content].sum())))
            yield pd.DataFrame(out, columns=names)

    found = docs.withColumn("__c", counted.asNondeterministic()(F.col(f"`{text}`")))
    found = found.withColumns({c: F.col(f"__c.{c}") for c in [c.split(" ")[0] for c in COUNTS.split(", ")]}).drop("__c")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    words = F.col("content_words") / F.greatest(F.col("n_words"), F.lit(1))
    found = found.withColumn("base_failed", failed).withColumn("content_share", F.least(words, F.lit(1.0)))
    return found.withColumn("kept", ~F.col("base_failed") & (F.col("content_share") >= F.lit(float(field.share if min_share is None else min_share))))

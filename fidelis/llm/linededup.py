"""Line dedup by a log-template tree.

A line is parsed at a fixed depth: by its number of tokens, then by its leading tokens, where a token with a digit
counts as a variable field. Lines that end in one leaf and have ``similarity`` or more of their tokens in common share
a template, in which the tokens that differ become variable fields. A template found in ``min_docs`` documents or more
recurs: its lines stay in the document with the smallest id that has one, and are dropped from all others.

Spark counts the lines by digest, so no text is shuffled for counting. Only leaves with several different lines send
them to a task, each line once however often it occurs, sorted by leaf. A leaf of any size is compared whole: its lines
pass through the task one by one, which holds the leaf's templates but not its lines, and finds the templates a line
can match by an index. Lines that are equal but for their digits share a template in any case. At last the numbers of
the lines to drop go back to their documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import join_skewed, let_go, written

#: Leading tokens that lines of a leaf share; templates in a leaf from which they are indexed; rows of digests of lines
#: to compare, of lines with another line's template, and of recurring templates up to which these are broadcast.
DEPTH, INDEXED, BROADCAST_ROWS = 3, 64, 300_000
FIELD, FIELD_CODE = "<*>", np.uint64(0)
DIGIT = re.compile(rb"[0-9]")
SIGNED = 1 << 63


def parse(line: str) -> tuple[list[bytes], int, int, int] | None:
    """Tokens (those with a digit as variable fields), the two halves of their digest, and the leaf.

    In a line of numbers only, they are no fields of anything: its tokens stay as they are.
    """
    words = line.encode().split()
    if not words:
        return None
    if DIGIT.search(line.encode()):
        fields = [FIELD.encode() if DIGIT.search(w) else w for w in words]
        words = words if all(f == FIELD.encode() for f in fields) else fields
    whole = xxhash.xxh3_128_intdigest(b" ".join(words))
    h1, h2, n = (whole >> 64) - SIGNED, (whole & (2 * SIGNED - 1)) - SIGNED, len(words)
    # A line no longer than the depth is alone in its leaf.
    leaf = xxhash.xxh3_64_intdigest(b"%d %d %s" % (n, DEPTH, b" ".join(words[:DEPTH]))) - SIGNED if n > DEPTH else h1
    return words, h1, h2, leaf


def _doc() -> Column:
    """A row without an id counts as a document of its own text, after all others."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.xxhash64("text")).alias("id"))


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(_doc()["unnamed"].alias("unnamed"), _doc()["id"].alias("id"), F.xxhash64("text").alias("row"), "text").filter("text is not null")


def _marks(docs: DataFrame) -> DataFrame:
    """The lines with a token: where they are, the digest of their tokens, and their leaf."""

    def marked(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        let_go()
        for batch in batches:
            out = []
            for unnamed, doc, row, text in batch[["unnamed", "id", "row", "text"]].itertuples(index=False):
                for at, line in enumerate(text.split("\n")):
                    if found := parse(line):
                        out.append((unnamed, doc, row, at, found[1], found[2], found[3]))
            yield pd.DataFrame(out, columns=["unnamed", "id", "row", "at", "h1", "h2", "leaf"])

    found = _rows(docs).mapInPandas(marked, "unnamed boolean, id long, row long, at int, h1 long, h2 long, leaf long")
    return found


def _lines(docs: DataFrame) -> DataFrame:
    """``(h1, h2, line)`` of the lines with a token, those with equal digests in a batch once."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = {}
            for text in batch["text"]:
                for line in text.split("\n"):
                    if found := parse(line):
                        out[found[1], found[2]] = b" ".join(found[0]).decode()
            yield pd.DataFrame([(*k, v) for k, v in out.items()], columns=["h1", "h2", "line"])

    return _rows(docs).mapInPandas(read, "h1 long, h2 long, line string")


def _leaves(digests: DataFrame) -> DataFrame:
    """``(h1, h2, leaf)`` of different lines that share a leaf with others."""
    shared = digests.groupBy("leaf").agg(F.count("*").alias("size")).filter("size > 1")
    return digests.join(shared, "leaf").select("h1", "h2", "leaf")


class Templates:
    """The templates of a leaf, whose lines have ``width`` tokens each, the first ``lead`` of them in common.

    A line goes to the template that it has most tokens in common with, the oldest of several, or founds one. It may
    differ from its template in ``misses`` tokens, so of any ``misses + 1`` groups of places it matches one whole. The
    places are cut into groups in two ways, side by side and in turns; either way finds all templates that a line can
    match, so each line takes the way that has fewer to compare.
    """

    def __init__(self, width: int, similarity: float, lead: int = 0) -> None:
        self.misses = min(width, max(-1, int(width - np.ceil(width * (similarity - 1e-9)))))
        self.count, self.rows, self.index = 0, np.empty((2, width), np.uint64), None
        groups = max(1, self.misses + 1)
        bounds = [lead + (width - lead) * g // groups for g in range(groups + 1)]
        self.ways = [[slice(a, b) for a, b in zip(bounds, bounds[1:])], [slice(lead + g, None, groups) for g in range(groups)]]

    def _keys(self, row: np.ndarray, way: int) -> list[int]:
        return [xxhash.xxh3_64_intdigest(row[part].tobytes(), seed=2 * g + way) for g, part in enumerate(self.ways[way])]

    def _post(self, at: int, before: np.ndarray | None = None) -> None:
        for way in (0, 1):
            known = set() if before is None else set(self._keys(before, way))
            for key in set(self._keys(self.rows[at], way)) - known:
                self.index.setdefault(key, []).append(at)

    def _candidates(self, row: np.ndarray) -> np.ndarray | None:
        """Places of the templates that the row can match, in order; None for all."""
        if self.index is None:
            return None
        fewest, least = None, self.count
        for way in (0, 1):
            lists = [found for key in self._keys(row, way) if (found := self.index.get(key))]
            if (size := sum(map(len, lists))) < least:
                fewest, least = lists, size
        return None if fewest is None else np.array(sorted(set().union(*fewest)), np.int64)

    def place(self, words: list[str]) -> int:
        """The number of the template that the line goes to; it is the count of those before where the line founds it."""
        row = np.array([FIELD_CODE if w == FIELD else xxhash.xxh3_64_intdigest(w) for w in words], np.uint64)
        near = self._candidates(row)
        some = self.rows[: self.count] if near is None else self.rows[near]
        if len(some):
            same = (some == row).sum(axis=1)  # a variable field matches just itself
            best = int(same.argmax())
            if same[best] >= len(row) - self.misses:
                best = best if near is None else int(near[best])
                before = self.rows[best].copy()
                self.rows[best][before != row] = FIELD_CODE
                if self.index is not None and (self.rows[best] != before).any():
                    self._post(best, before)
                return best
        if self.count == len(self.rows):
            self.rows = np.concatenate((self.rows, np.empty_like(self.rows)))
        self.rows[self.count] = row
        self.count += 1
        if self.index is not None:
            self._post(self.count - 1)
        elif self.count >= INDEXED:
            self.index = {}
            for at in range(self.count):
                self._post(at)
        return self.count - 1


def generalise(lines: list[str], similarity: float) -> list[int]:
    """For each line of a leaf (all of as many tokens, in a fixed order) the place of the line that founded its template."""
    rows, founders, out = [line.split(" ") for line in lines], [], []
    templates = Templates(len(rows[0]), similarity) if rows else None
    for at, words in enumerate(rows):
        found = templates.place(words)
        if found == len(founders):
            founders.append(at)
        out.append(founders[found])
    return out


def _templates(leaves: DataFrame, similarity: float) -> DataFrame:
    """``(h1, h2, t1, t2)``: the lines whose template another line founded, with that line's digest."""

    def grouped(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        leaf, templates, founders = None, None, []
        for batch in batches:
            out = []
            for found, h1, h2, line in batch.itertuples(index=False):
                words = line.split(" ")
                if found != leaf:
                    leaf, templates, founders = found, Templates(len(words), similarity, DEPTH), []
                at = templates.place(words)
                if at == len(founders):
                    founders.append((h1, h2))
                else:
                    out.append((h1, h2, *founders[at]))
            yield pd.DataFrame(out, columns=["h1", "h2", "t1", "t2"], dtype="int64")

    dealt = leaves.select("leaf", "h1", "h2", "line").repartition("leaf").sortWithinPartitions("leaf", "h1", "h2")
    return dealt.mapInPandas(grouped, "h1 long, h2 long, t1 long, t2 long")


def _recurring(found: DataFrame, min_docs: int) -> DataFrame:
    """``(t1, t2, n, first_unnamed, first_id)`` of the templates in ``min_docs`` documents or more, with their first document."""
    ids = {kind: F.when(F.col("unnamed") == unnamed, F.col("id")) for kind, unnamed in (("named", False), ("unnamed", True))}
    ends = [end(c).alias(f"{name}_{kind}") for kind, c in ids.items() for name, end in (("low", F.min), ("high", F.max))]
    each = found.groupBy("t1", "t2").agg(F.count("*").alias("n"), *ends)
    if min_docs <= 2:
        fit = "low_named < high_named or low_unnamed < high_unnamed or (low_named is not null and low_unnamed is not null)"
        each = each.filter(fit if min_docs == 2 else F.lit(True))
    else:
        docs = found.select("t1", "t2", "unnamed", "id").distinct().groupBy("t1", "t2").agg(F.count("*").alias("docs"))
        each = each.join(docs.filter(F.col("docs") >= min_docs).select("t1", "t2"), ["t1", "t2"])
    return each.select("t1", "t2", "n", F.col("low_named").isNull().alias("first_unnamed"), F.coalesce("low_named", "low_unnamed").alias("first_id"))


def dedup_lines(docs: DataFrame, min_docs: int = 2, similarity: float = 0.8) -> DataFrame:
    """``docs`` with the text less the dropped lines, and the columns ``n_lines`` and ``n_dropped`` (lines with a token).

    A row for each row of ``docs``, whose columns stay (``n_lines`` and ``n_dropped`` are replaced if they are there).
    Lines are cut at ``\\n``; blank lines and null or empty texts are left as they are. A text all of whose lines are
    dropped becomes empty. Rows that repeat an id count as one document, so none of them loses a line for the others'
    sake; a row without an id counts as a document of its own text. Ties in ``doc_id`` cannot arise otherwise. Lines may
    be of any length, and a leaf may hold any number of them. An empty table gives an empty table.
    """
    marks = written(_marks(docs.select("doc_id", "text")), "lines")
    rows = marks.count()
    digests = written(marks.groupBy("h1", "h2").agg(F.min("leaf").alias("leaf"), F.count("*").alias("n")), "digests", rows)
    shared = written(_leaves(digests), "leaves", rows)
    small = shared.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    compared = _lines(docs.select("doc_id", "text")).join(F.broadcast(shared) if small else shared, ["h1", "h2"])
    moved = written(_templates(compared.dropDuplicates(["leaf", "h1", "h2"]), similarity), "templates")
    moved = written(moved.join(digests.select("h1", "h2", "n"), ["h1", "h2"]), "moved", rows)
    found = join_skewed(marks.drop("leaf"), moved, ["h1", "h2"], "n", "left", BROADCAST_ROWS)
    found = found.select("unnamed", "id", "row", "at", F.coalesce("t1", "h1").alias("t1"), F.coalesce("t2", "h2").alias("t2"))
    recurring = written(_recurring(found, min_docs), "recurring", rows)
    drop = join_skewed(found, recurring, ["t1", "t2"], "n", broadcast_rows=BROADCAST_ROWS).filter("unnamed <> first_unnamed or id <> first_id")
    drop = drop.groupBy("unnamed", "id", "row").agg(F.collect_set("at").alias("__gone"))
    drop = drop.select(F.col("unnamed").alias("__unnamed"), F.col("id").alias("__id"), F.col("row").alias("__row"), "__gone")
    keyed = docs.withColumns({"__unnamed": _doc()["unnamed"], "__id": _doc()["id"], "__row": F.xxhash64("text")})
    joined = keyed.join(drop, ["__unnamed", "__id", "__row"], "left")
    cut = F.split("text", "\n")
    left = F.filter(cut, lambda line, at: ~F.array_contains("__gone", at))
    spoken = F.size(F.filter(cut, lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    joined = joined.withColumns({
        "n_lines": F.when(F.col("text").isNull(), 0).otherwise(spoken).cast("long"),
        "n_dropped": F.when(F.col("__gone").isNull(), 0).otherwise(F.size("__gone")).cast("long"),
    })
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.withColumn("text", text).drop("__unnamed", "__id", "__row", "__gone")

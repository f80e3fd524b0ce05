"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Running sums of the turns' tokens give, for each window, the turns that
fit its budget; a turn is never cut, so one that alone is over the budget has a window to itself. Each window but the
first begins with the conversation's system turn and repeats a limited number of the turns before it. Repeated turns are
marked and masked: every assistant text is a target exactly once.

A turn is written ``### role:``, newline, text, ``</turn>``, newline; a repeated one has ``<again>`` after its role.
Backslash, ``#``, ``<`` in texts and roles (in roles ``:`` too) get a backslash before them, so no text can look like a
mark, and taking the backslashes away gives every text back.

A conversation of ``LONG`` turns at most is formatted where its turns meet. Of longer ones only the turns' numbers of
tokens pass through one task, which places them into windows holding no more than a window's history; the texts are then
dealt out by window. Both ways place turns by the same steps, so a conversation's windows don't depend on its length.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fidelis.llm.common import bounded, written

#: Turns up to which a conversation is formatted in one task; turn numbers that are put in order together beyond that.
LONG = 4_096
TURN = re.compile(r"### ((?:[^\\<:]|\\.)*)(<again>)?:\n((?:[^\\<]|\\.)*)</turn>\n", re.S)
#: Ids of long conversations that are broadcast.
BROADCAST_LONG = 1_000_000
PLACES = "conv_id long, window int, at int, again boolean, chunk long, place int"
WINDOWS = "conv_id long, window int, formatted string, loss array<struct<start:int,end:int>>, n_turns int, n_again int, n_tokens long"


def escape(text: str, more: str = "") -> str:
    return re.sub(rf"[\\#<{more}]", lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def estimated_tokens(text: Column) -> Column:
    """A quarter of the bytes, and four tokens for the marks of the turn."""
    return (F.ceil(F.octet_length(text) / 4) + 4).cast("long")


class Placer:
    """Puts the turns of one conversation, as they come, into windows; it remembers a window's history only."""

    def __init__(self, budget: int, history: int, history_tokens: int) -> None:
        self.budget, self.history_tokens = budget, history_tokens
        self.window, self.used, self.system, self.recent = -1, 0, None, deque(maxlen=history)

    def place(self, key: object, tokens: int, system: bool) -> list[tuple[int, bool, object]]:
        """``(window, again, key)`` of what the turn adds: what its window repeats if it opens one, then itself."""
        out = []
        if self.window < 0 or self.used + tokens > self.budget:
            self.window += 1
            before, self.used = [], self.system[1] if self.system else 0
            for k, n in reversed(self.recent):
                held = sum(x for _, x in before)
                if held + n > self.history_tokens or self.used + held + n + tokens > self.budget:  # the new turn goes before history
                    break
                if not (self.system and k == self.system[0]):
                    before.append((k, n))
            self.used += sum(n for _, n in before)
            out = [(self.window, True, k) for k in ([self.system[0]] if self.system else []) + [k for k, _ in reversed(before)]]
        self.used += tokens
        if system and not self.system:
            self.system = (key, tokens)
        self.recent.append((key, tokens))
        return [*out, (self.window, False, key)]


def _written(role: str, text: str, again: bool) -> tuple[str, int, int]:
    head = f"### {escape(role, ':')}{'<again>' if again else ''}:\n"
    body = escape(text)
    return f"{head}{body}</turn>\n", len(head), len(head) + len(body)


def _window(conv, window: int, turns: list[tuple[bool, str, str, int]]) -> tuple:
    """A row of ``WINDOWS`` from turns ``(again, role, text, tokens)``."""
    parts, loss, at = [], [], 0
    for again, role, text, _ in turns:
        piece, a, b = _written(role, text, again)
        if role == "assistant" and not again:
            loss.append((at + a, at + b))
        parts.append(piece)
        at += len(piece)
    again = sum(t[0] for t in turns)
    return conv, window, "".join(parts), loss, len(turns) - again, again, sum(t[3] for t in turns)


def _id(value) -> int | None:
    """A null is NaN or None in pandas; it is told from numbers by being unequal to itself."""
    return None if value is None or value != value else int(value)


def _grouped(batches: Iterator[pd.DataFrame], keys: list[str]) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """The rows of consecutive equal keys, as tuples of the other columns; rows stream."""
    rows = (row for batch in batches for row in batch.itertuples(index=False, name=None))
    for key, group in itertools.groupby(rows, key=lambda row: tuple(map(_id, row[: len(keys)]))):
        yield key, (row[len(keys) :] for row in group)


def _framed(rows: Iterator[tuple], schema: str, size: int = 256) -> Iterator[pd.DataFrame]:
    names = re.findall(r"(\w+) (?:long|int|string|boolean|array)", schema)
    while some := list(itertools.islice(rows, size)):
        frame = pd.DataFrame(some, columns=names)
        yield frame.astype({c: "Int64" for c in ("conv_id", "chunk") if c in names})


def format_conversations(turns: DataFrame, budget: int = 1_024, history: int = 2, history_tokens: int = 256, tokens: Column | None = None) -> DataFrame:
    """Windows of ``turns(conv_id, turn, role, text)``: ``WINDOWS``.

    ``loss`` holds the code-point spans of ``formatted`` that are targets; ``window`` counts within a conversation.
    ``tokens`` is a column of the tokens of a turn (``estimated_tokens`` of ``text`` unless given).
    Null texts and roles count as empty. Turns are ordered by turn (null first), then role and text; repeated rows are
    repeated turns. The system turn that is retained is the first by that order. A null ``conv_id`` is one conversation.
    Other columns are ignored, long texts stay whole, an empty table gives no windows.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
                        (estimated_tokens(F.coalesce("text", F.lit(""))) if tokens is None else tokens).cast("long").alias("tokens"))
    sizes = rows.groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n")).filter(F.col("n") > LONG)
    sizes = bounded(written(sizes.select("id"), "long"), BROADCAST_LONG)
    is_long = F.expr("conv_id <=> id")

    def short_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (conv,), held in _grouped(batches, ["conv_id"]):
                held, placer = list(held), Placer(budget, history, history_tokens)
                places = (p for i, (role, _, n) in enumerate(held) for p in placer.place(i, n, role == "system"))
                for window, group in itertools.groupby(places, key=lambda p: p[0]):
                    yield _window(conv, window, [(again, *held[i]) for _, again, i in group])

        yield from _framed(found(), WINDOWS)

    short = rows.join(sizes, is_long, "left_anti").repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    short = short.select("conv_id", "role", "text", "tokens").mapInPandas(short_windows, WINDOWS)

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def found() -> Iterator[tuple]:
            for (conv,), held in _grouped(batches, ["conv_id"]):
                placer, window, at = Placer(budget, history, history_tokens), -1, 0
                for chunk, place, n, system in held:
                    for w, again, key in placer.place((_id(chunk), place), n, system):
                        window, at = w, at + 1 if w == window else 0
                        yield conv, w, at, again, *key

        yield from _framed(found(), PLACES, 4_096)

    def long_windows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from _framed((_window(conv, window, list(held)) for (conv, window), held in _grouped(batches, ["conv_id", "window"])), WINDOWS)

    ordered = W.partitionBy("conv_id", "chunk").orderBy("turn", "role", "text")
    numbered = rows.join(sizes, is_long, "left_semi").withColumn("chunk", F.floor(F.col("turn") / LONG).cast("long"))
    numbered = written(numbered.withColumn("place", F.row_number().over(ordered)).drop("turn"), "turns")
    narrow = numbered.select("conv_id", "chunk", "place", "tokens", (F.col("role") == "system").alias("system"))
    narrow = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "chunk", "place")
    places = narrow.mapInPandas(placed, PLACES).withColumnsRenamed({"conv_id": "c", "chunk": "k", "place": "p"})
    long = numbered.join(places, F.expr("conv_id <=> c and chunk <=> k and place = p")).select("conv_id", "window", "at", "again", "role", "text", "tokens")
    long = long.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "at").drop("at")
    return short.unionAll(long.mapInPandas(long_windows, WINDOWS))


def read_back(formatted: str) -> list[tuple[str, bool, str]]:
    """``(role, repeated, text)`` of the turns of a window."""
    found = [(unescape(m[1]), bool(m[2]), unescape(m[3])) for m in TURN.finditer(formatted)]
    if sum(m.end() - m.start() for m in TURN.finditer(formatted)) != len(formatted):
        raise ValueError("not a formatted window")
    return found


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"


def digests(windows: DataFrame) -> DataFrame:
    """What the windows of each conversation say when they are read back, first occurrences only: ``DIGESTS``.

    A digest needs the conversation's windows in order; they stream through a task, which keeps only running digests.
    A null ``conv_id`` is one conversation; other columns are ignored; no windows give no rows.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None

        def done() -> list[tuple]:
            return [(key[0], state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4], state[5])] if key else []

        def framed(found: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(found, columns=[c.split(" ")[0] for c in DIGESTS.split(", ")]).astype({"conv_id": "Int64"})

        for batch in batches:
            found = []
            for conv, formatted, loss in batch[["conv_id", "formatted", "loss"]].itertuples(index=False):
                now = (None if conv is None or conv != conv else int(conv),)
                if now != key:
                    found += done()
                    key, state = now, [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, again, text in read_back(formatted):
                    if not again:
                        state[0] += 1
                        state[1].update(f"{role}\n{text}\n".encode())
                for span in loss:
                    text = unescape(formatted[span["start"] : span["end"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += 1
            yield framed(found)
        yield framed(done())

    return windows.repartition("conv_id").sortWithinPartitions("conv_id", "window").mapInPandas(read, DIGESTS)

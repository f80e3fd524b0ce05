"""BPE encoding and decoding by a prefix-sharing trie.

The words of a batch of texts are made distinct and inserted into a trie, so that a prefix that many words share is
one path; the trie is held as its leaves in order. A depth-first walk gives every node its *last-token state*: the last token of the encoding of the bytes from
the root to that node. The state of a node follows from those of its ancestors: token ``t`` of ``n`` bytes is the last
one just if it is a suffix of the path and merging would not join it with the last token of the ancestor ``n`` bytes
above. An encoding is read by jumping from a word's node back from token to token, so the work on a shared prefix is
done once however many words start with it.

Spark deals out the texts; each task keeps only the trie of a bounded run of words and a bounded memo.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fidelis.llm.common import kept

#: Words in a trie at once, encodings remembered in a worker, texts whose new words are gathered first.
TRIE_WORDS, MEMO_WORDS, BATCH_TEXTS = 10_000, 250_000, 128
#: The split of byte-level BPE (public; the same for every vocabulary of this family).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"


@lru_cache(maxsize=1)
def _byte_letters() -> dict[str, int]:
    """The letters that stand for bytes in vocabulary files: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_vocabulary(path: str) -> dict:
    """Vocabulary, merges and special tokens of a byte-level BPE file."""
    with open(path, encoding="utf-8") as f:
        return parsed(f.read(), path)


def parsed(source: str, path: str = "vocabulary") -> dict:
    spec = json.loads(source)
    pre = spec["pre_tokenizer"]
    if spec["model"]["type"] != "BPE" or spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"]:
        raise ValueError(f"{path}: only byte-level BPE without a normalizer or a prefix space is supported")
    merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"vocab": spec["model"]["vocab"], "merges": merges, "special": special}


def _sent(df: DataFrame, path: str):
    """The file's text as a broadcast (50,257 entries, 2 MB): workers keep the tables built from it, not its objects."""
    read_vocabulary(path)
    with open(path, encoding="utf-8") as f:
        return df.sparkSession.sparkContext.broadcast(f.read())


class Coder:
    """Encodes and decodes in one worker."""

    def __init__(self, spec: dict) -> None:
        letters = _byte_letters()
        raw = {name: bytes(letters[c] for c in name) for name in spec["vocab"]}
        self.special = {k: i.to_bytes(4, "little") for k, i in spec["special"].items()}
        self.id_of = {raw[name]: i for name, i in spec["vocab"].items()}
        self.bytes_of = {i: b for b, i in self.id_of.items()} | {i: k.encode() for k, i in spec["special"].items()}
        self.length_of = {i: len(b) for b, i in self.id_of.items()}
        self.longest = max(map(len, self.id_of))
        self.packed = {i: i.to_bytes(4, "little") for i in self.length_of}
        ids = spec["vocab"]
        #: pair of ids -> (rank, id of the merged token); and back: the pair, with the rank, that makes a token
        self.merge = {(ids[a], ids[b]): (n, ids[a + b]) for n, (a, b) in enumerate(spec["merges"])}
        self.made_by: dict[int, tuple[int, int, int]] = {}
        for (a, b), (rank, made) in self.merge.items():
            self.made_by.setdefault(made, (rank, a, b))
        self.apart: dict[int, bool] = {}
        self.memo: dict[str, bytes] = {}
        self.cut = regex.compile(SPLIT)
        # A token that merging its own bytes doesn't give is never the last token of anything.
        self.last_of = {b: i for b, i in self.id_of.items() if self.merged(b) == [i]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None

    # ---- the test of two neighbouring tokens

    def merged(self, data: bytes) -> list[int]:
        """Plain merging of a few bytes, lowest rank first; used for single tokens only."""
        out = [self.id_of[bytes([b])] for b in data]
        while len(out) > 1:
            best = min(((self.merge.get(p, (1 << 60,))[0], i) for i, p in enumerate(zip(out, out[1:]))))
            if best[0] == 1 << 60:
                break
            pair, joined, i = (out[best[1]], out[best[1] + 1]), [], 0
            while i < len(out):
                if tuple(out[i : i + 2]) == pair:
                    joined.append(self.merge[pair][1])
                    i += 2
                else:
                    joined.append(out[i])
                    i += 1
            out = joined
        return out

    def stay_apart(self, left: int, right: int) -> bool:
        """Whether merging leaves ``left`` and ``right`` as two tokens where they meet.

        Runs the merges of both tokens backwards, latest first, looking only at the two pieces that touch. If those
        pieces themselves could merge sooner than the merge that takes one of them away, they would have joined.
        """
        a, b, due, made_by, merge = left, right, 1 << 60, self.made_by, self.merge
        while True:
            rank = merge.get((a, b), (1 << 60,))[0]
            # The piece on the left is taken first where ranks tie: equal pairs are merged from the left.
            if rank < due or (rank == due and due != 1 << 60 and last_side == "right"):
                found = False
                break
            undo_a, undo_b = made_by.get(a), made_by.get(b)
            if undo_a is None and undo_b is None:
                found = True
                break
            if undo_b is None or (undo_a is not None and undo_a[0] > undo_b[0]):
                due, a, last_side = undo_a[0], undo_a[2], "left"
            else:
                due, b, last_side = undo_b[0], undo_b[1], "right"
        self.apart[left << 32 | right] = found
        return found

    # ---- the trie

    def learn(self, words: list[str]) -> None:
        """Puts the encodings of distinct words into the memo."""
        leaves = sorted((w.encode(), w) for w in words)
        for at in range(0, len(leaves), TRIE_WORDS):
            self._walk(leaves[at : at + TRIE_WORDS])

    def _walk(self, leaves: list[tuple[bytes, str]]) -> None:
        """Goes through a trie depth first. It is given by its leaves in order: from one word to the next, the walk goes
        up to the node where their paths part, whose states are kept, and down the new branch."""
        last_of, length_of, longest, apart, memo, packed = self.last_of, self.length_of, self.longest, self.apart, self.memo, self.packed
        state: list[int] = [-1] * (1 + max(len(path) for path, _ in leaves))  # last tokens along the path, by depth
        before = b""
        for path, word in leaves:
            parted = 0
            for one, other in zip(before, path):
                if one != other:
                    break
                parted += 1
            for depth in range(parted + 1, len(path) + 1):
                for at in range(depth - 1, depth - longest - 1 if depth > longest else -1, -1):
                    token = last_of.get(path[at:depth])
                    if token is not None:
                        if at and (fits := apart.get(state[at] << 32 | token)) is not True:
                            if fits is False or not self.stay_apart(state[at], token):
                                continue
                        state[depth] = token
                        break
            found, depth = [], len(path)
            while depth:
                found.append(state[depth])
                depth -= length_of[state[depth]]
            memo[word] = b"".join([packed[t] for t in reversed(found)])
            before = path

    # ---- whole texts

    def parts(self, text: str) -> list[tuple[bool, list[str] | str]]:
        if self.specials is None:
            return [(False, self.cut.findall(text))]
        return [(True, p) if p in self.special else (False, self.cut.findall(p)) for p in self.specials.split(text) if p]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers; the new words of these texts share their tries."""
        if len(self.memo) > MEMO_WORDS or len(self.apart) > 2 * MEMO_WORDS:
            self.memo.clear()
            self.apart.clear()
        cut, memo = [self.parts(t) for t in texts], self.memo
        self.learn(list({w for parts in cut for special, p in parts if not special for w in p if w not in memo}))
        one = lambda special, p: self.special[p] if special else b"".join(map(memo.__getitem__, p))
        return [b"".join(one(*p) for p in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        found = memoryview(ids).cast("I").tolist()
        return b"".join(map(self.bytes_of.__getitem__, found)).decode("utf-8", "replace")


def _coder(key: str, source) -> Coder:
    return kept(("tokens", key), lambda: Coder(parsed(source.value)))


def _encoded(coder: Coder, texts: list[str]) -> list[bytes]:
    return [ids for at in range(0, len(texts), BATCH_TEXTS) for ids in coder.encode(texts[at : at + BATCH_TEXTS])]


def encode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids") -> DataFrame:
    """``df`` with a binary column ``ids``: the tokens of the whole text, little-endian unsigned 32-bit integers.

    A null or empty text has no tokens (an empty binary). Special tokens inside a text count as such, none is added.
    Texts may be of any length: the time of a word is linear in it, and a batch of texts shares its words. Repeated rows stay; a column already named ``ids`` is replaced; an empty table gives an empty table.
    """
    source = _sent(df, tokenizer_path)

    @F.pandas_udf("binary")
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(tokenizer_path, source)
        for batch in batches:
            yield pd.Series(_encoded(coder, batch.fillna("").tolist()), dtype=object)

    return df.withColumn(ids, encoded.asNondeterministic()(F.col(f"`{text}`")))


def round_trip(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids", back: str = "decoded") -> DataFrame:
    """``encode`` and ``decode`` in one pass, so that a worker holds one set of tables.

    A null or empty text has no tokens and decodes to an empty text. Texts may be of any length. Repeated rows stay;
    columns already named ``ids`` or ``back`` are replaced, others stay; an empty table gives an empty table.
    """
    source = _sent(df, tokenizer_path)

    @F.pandas_udf("ids binary, back string")
    def both(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        coder = _coder(tokenizer_path, source)
        for batch in batches:
            found = _encoded(coder, batch.fillna("").tolist())
            yield pd.DataFrame({"ids": found, "back": list(map(coder.decode, found))}, dtype=object)

    coded = df.withColumn("__coded", both.asNondeterministic()(F.col(f"`{text}`")))
    return coded.withColumns({ids: F.col("__coded.ids"), back: F.col("__coded.back")}).drop("__coded")


def decode(df: DataFrame, tokenizer_path: str, ids: str = "token_ids", text: str = "decoded") -> DataFrame:
    """``df`` with a string column ``text`` decoded from ``ids``; null ids give null, bytes that are no UTF-8 U+FFFD.

    Empty ids give an empty text. Repeated rows stay; a column already named ``text`` is replaced; an empty table gives
    an empty table.
    """
    source = _sent(df, tokenizer_path)

    @F.pandas_udf("string")
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        coder = _coder(tokenizer_path, source)
        for batch in batches:
            yield batch.map(lambda b: None if b is None else coder.decode(b)).astype(object)

    return df.withColumn(text, decoded.asNondeterministic()(F.col(f"`{ids}`")))

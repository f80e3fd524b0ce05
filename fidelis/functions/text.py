"""Text preparation as column expressions."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.rules.knee import ABBREVIATIONS, STOP_WORDS

# What each pass takes away or leaves, in the order in which the passes run.
MARKDOWN: list[tuple[str, str]] = [
    (r"```[\s\S]*?```", ""),
    (r"`[^`]*`", ""),
    (r"(?m)^\s*\|.*\|\s*$", ""),
    (r"(?m)^\s*[-=*_]{3,}\s*$", ""),
    (r"(?m)^\s*#{1,6}\s+", ""),
    (r"\[([^\]]+)\]\([^)]+\)", "$1"),
    (r"\*\*(.+?)\*\*", "$1"),
    (r"__(.+?)__", "$1"),
    (r"\*([^*\n]+?)\*", "$1"),
    (r"_([^_\n]+?)_", "$1"),
    (r"(?m)^\s*[-*+]\s+", ""),
    (r"(?m)^\s*\d+\.\s+", ""),
    (r"<[^>]+>", ""),
    (r"\n{3,}", "\n\n"),
]


def strip_markdown_col(text: Column) -> Column:
    """The text without Markdown and HTML marks; bold runs that cross a line stay. Null stays null."""
    for pattern, left in MARKDOWN:
        text = F.regexp_replace(text, "(?Ud)" + pattern, left)
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _folds() -> tuple[str, str]:
    """Letters of Latin-1 and Latin Extended-A with marks, and the letters below the marks."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def fold(text: Column) -> Column:
    """Lower case without accents, for Latin letters; combining marks go too."""
    return F.lower(F.translate(F.regexp_replace(text, r"\p{Mn}+", ""), *_folds()))


@lru_cache(maxsize=1)
def _decompositions() -> tuple[str, str, dict[str, str], str]:
    """Letters that decompose into one that is no mark, those letters, the others, and a class of all marks.

    Worked out from the Unicode data that Python has, for all scripts; Hangul syllables follow a rule of their own.
    """
    one, many, marks = {}, {}, []
    for code in range(0x80, 0x110000):
        c = chr(code)
        if unicodedata.category(c) == "Mn":
            if marks and marks[-1][1] == code - 1:
                marks[-1][1] = code
            else:
                marks.append([code, code])
        elif not HANGUL[0] <= code <= HANGUL[1] and (apart := unicodedata.normalize("NFD", c)) != c:
            left = "".join(x for x in apart if unicodedata.category(x) != "Mn")
            (one if len(left) == 1 else many)[c] = left
    span = lambda a, b: rf"\x{{{a:X}}}-\x{{{b:X}}}"
    # A class asks its ranges one by one, so ranges are asked about in groups, and first whether it can be a mark at all.
    groups = [marks[i : i + 20] for i in range(0, len(marks), 20)]
    kinds = "".join(f"[{span(g[0][0], g[-1][1])}&&[{''.join(span(a, b) for a, b in g)}]]" for g in groups)
    return "".join(one), "".join(one.values()), many, f"[{span(marks[0][0], marks[-1][1])}&&[{kinds}]]"


#: First and last Hangul syllable; the first of its leading, middle and trailing letters, and how many there are.
HANGUL = 0xAC00, 0xD7A3
JAMO = [(0x1100, 19), (0x1161, 21), (0x11A7, 28)]


def _syllables_apart(text: Column) -> Column:
    """Hangul syllables as their letters."""
    leading, middle, trailing = (F.array(*[F.lit(chr(first + i) if (first, i) != (0x11A7, 0) else "") for i in range(n)]) for first, n in JAMO)
    at = lambda c: F.ascii(c) - HANGUL[0]
    parts = lambda c: F.concat(leading[F.floor(at(c) / 588).cast("int")], middle[F.floor(at(c) % 588 / 28).cast("int")], trailing[(at(c) % 28).cast("int")])
    one = lambda c: F.when(F.ascii(c).between(*HANGUL), parts(c)).otherwise(c)
    return F.when(text.rlike("[\uac00-\ud7a3]"), F.array_join(F.transform(F.split(text, ""), one), "")).otherwise(text)


def unmarked(text: Column) -> Column:
    """The text in canonical decomposition (NFD) without its combining marks, for all scripts.

    ASCII has nothing to decompose. Syllables and letters that leave several behind are only asked for where one is seen.
    """
    letters, plain, many, marks = _decompositions()
    apart = text
    for c, left in many.items():
        apart = F.replace(apart, F.lit(c), F.lit(left))
    bare = lambda t: F.regexp_replace(t, f"{marks}+", "")
    rare = text.rlike(f"[{min(many)}-{max(many)}&&[{''.join(many)}{chr(HANGUL[0])}-{chr(HANGUL[1])}]]")
    whole = _syllables_apart(F.translate(apart, letters, plain))
    return F.when(F.octet_length(text) == F.length(text), text).when(rare, bare(whole)).otherwise(bare(F.translate(text, letters, plain)))


def normalize_surface(text: Column) -> Column:
    """Decomposed without marks, in lower case, white space collapsed, trimmed."""
    # Single blanks stay as they are and need no replacing.
    return F.trim(F.regexp_replace(F.lower(unmarked(text)), r"(?U)[^\S ]\s*| \s+", " "))


def sentences(text: Column) -> Column:
    """Array of the sentences of three words or more, in order.

    Paragraphs end at blank lines; a sentence ends at ``.!?`` before white space and a capital or an inverted mark,
    but not after an abbreviation. A null text has no sentences.
    """
    short = "|".join(re.escape(a[:-1]) for a in ABBREVIATIONS)
    ends = rf"(?U)(?<=[.!?])(?<!(?:^|\s)(?i:{short})\.)\s+(?=[A-ZÁÉÍÓÚÑÜ¿¡])"
    paragraphs = F.transform(F.split(F.coalesce(text, F.lit("")), r"(?U)\n\s*\n+"), lambda p: F.trim(F.regexp_replace(p, r"(?U)\s+", " ")))
    cut = F.flatten(F.transform(paragraphs, lambda p: F.split(p, ends)))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.size(F.split(s, " ")) >= 3)


def sentence_rows(df: DataFrame, text: str, *keys: str) -> DataFrame:
    """``(*keys, pos, sentence)``: a row for each sentence."""
    return df.select(*keys, F.posexplode(sentences(F.col(text))).alias("pos", "sentence"))


def content_words(text: Column, stop_words: list[str] = STOP_WORDS, least: int = 3) -> Column:
    """The distinct folded words of ``least`` letters or more that are no stop words."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?U)\b[a-zA-ZÀ-ſ][a-zA-ZÀ-ſ'\-]*\b"), F.lit(0))
    # All words are folded at once: they are of Latin letters, so none has a blank or a combining mark.
    words = F.split(F.lower(F.translate(F.array_join(found, " "), *_folds())), " ")
    kept = lambda w: (F.length(w) >= max(least, 1)) & ~w.isin(stop_words) if stop_words else F.length(w) >= max(least, 1)
    return F.array_distinct(F.filter(words, kept))


#: Letters that equal a plain one when case is ignored, besides its capital (fixed values).
ALIKE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def any_word(words: list[str]) -> str:
    """A pattern for any of the words in any case, each a plain text that may stand between ``\\b``.

    Words share their beginnings, case is spelled out in classes, and a look at up to three letters goes first: an
    alternation that ignores case takes many times as long.
    """
    alike = lambda c: c.upper() + c + ALIKE.get(c, "") if c.isalpha() else re.escape(c)
    tree: dict = {}
    for word in words:
        node = tree
        for part in re.findall(r"\\b|.", word):
            node = node.setdefault(part if part == r"\b" else f"[{alike(part)}]", {})
        node[""] = {}

    def spelled(node: dict) -> str:
        ways = [] if "" in node else [part + spelled(rest) for part, rest in node.items()]
        return f"(?:{'|'.join(ways)})" if len(ways) > 1 else "".join(ways)

    columns = list(zip(*(w.replace(r"\b", "") for w in words)))[:3]
    return f"(?U)(?={''.join('[' + ''.join(map(alike, dict.fromkeys(c))) + ']' for c in columns)})" + spelled(tree)


def passages(text: Column, words: list[str]) -> Column:
    """The runs between full stops that hold any of the words, in order, joined by full stops.

    Patterns that match no full stop and always match one of the words find the same in them as in the text.
    """
    found = any_word(words)
    return F.array_join(F.filter(F.split(text, r"\."), lambda run: run.rlike(found)), ".")


def searched(text: Column, rules: list) -> Column:
    """The text, null as empty, or as much of it as the rules can match, where all of them have words."""
    text, words = F.coalesce(text, F.lit("")), list(dict.fromkeys(w for r in rules for w in r.words))
    return passages(text, words) if words and all(r.words for r in rules) else text


def n_words(text: Column) -> Column:
    """Words once punctuation is taken away: the runs without white space that have a letter, a digit or a line."""
    return F.regexp_count(text, F.lit(r"(?U)\w\S*+"))

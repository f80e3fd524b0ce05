"""Entity mentions by lexicon, and recall of the original's entities in the rewrite."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.text import any_word, normalize_surface
from fidelis.rules import Term

FLAGS = "(?iU)"


def _plain(phrase: str) -> str:
    import unicodedata

    return "".join(c for c in unicodedata.normalize("NFD", phrase) if unicodedata.category(c) != "Mn")


def expand_synonyms(lexicon: list[Term], synonyms: dict[str, list[str]]) -> list[Term]:
    """The lexicon with a pattern for each lay phrase, and for the phrase without accents where that differs."""
    out = []
    for term in lexicon:
        phrases = [v for p in synonyms.get(term.canonical, []) for v in dict.fromkeys((p, _plain(p)))]
        # Letters and single spaces stand for themselves in Java's and Python's patterns alike.
        # The words of a term say nothing of its lay phrases, so they are left out.
        out.append(Term(term.canonical, term.entity_type, [*term.patterns, *[rf"\b{re.escape(p)}\b".replace(r"\ ", " ") for p in phrases]], [] if phrases else term.words))
    return out


def canonicals(text: Column, lexicon: list[Term]) -> Column:
    """The distinct canonical terms that a text mentions, in the lexicon's order, each found by one alternation.

    A term that has words is only looked for in texts that hold one; ``searched`` cuts long texts down to such stretches.
    """
    text = F.coalesce(text, F.lit(""))
    met = lambda t: text.rlike(FLAGS + "|".join(f"(?:{p})" for p in t.patterns))
    tests = [F.when(text.rlike(any_word(t.words)) & met(t) if t.words else met(t), F.lit(t.canonical)) for t in lexicon]
    return F.array_compact(F.array(*tests))


def literal(pattern: str) -> tuple[bool, str, bool] | None:
    """``(boundary before, text, boundary after)`` of a pattern that is a plain phrase, maybe between ``\\b``; else None."""
    found = re.fullmatch(r"(\\b)?((?:[^\W_]|[ _]|\\[-.,'/ ])+)(\\b)?", pattern)
    return found and (bool(found[1]), re.sub(r"\\(.)", r"\1", found[2]), bool(found[3]))


#: Letters that equal a plain one when case is ignored, though their lower case is another (fixed values).
ALIKE = str.maketrans({"\u0130": "i", "\u0131": "i", "\u017f": "s", "\u212a": "k"})


def _lower(text: str) -> str:
    """Lower case, letter by letter, so that places stay."""
    low = text.translate(ALIKE).lower()
    return low if len(low) == len(text) else "".join(c.lower() if len(c.lower()) == 1 else c for c in text.translate(ALIKE))


class Finder:
    """All matches of many patterns in a text: one pass of an automaton for phrases, and one look for all other patterns.

    Each pattern's matches are those of ``re.finditer`` without regard to case; matches of different patterns overlap.
    """

    def __init__(self, terms: list[Term]) -> None:
        import ahocorasick

        self.phrases, self.others = ahocorasick.Automaton(), []
        rules = [(t.canonical, t.entity_type, p) for t in terms for p in t.patterns]
        by_text: dict[str, list] = {}
        for n, (canonical, kind, pattern) in enumerate(rules):
            if (plain := literal(pattern)) is not None:
                by_text.setdefault(_lower(plain[1]), []).append((n, canonical, kind, plain[0], plain[2]))
            else:
                self.others.append((canonical, kind, re.compile(pattern, re.I)))
        for text, owners in by_text.items():
            self.phrases.add_word(text, (len(text), owners))
        self.any_phrase = bool(by_text)
        if by_text:
            self.phrases.make_automaton()
        # Where patterns have groups, joining them would renumber what they refer back to.
        joined = [p.pattern for _, _, p in self.others if not re.search(r"\\\d|\(\?P", p.pattern)]
        self.any_other = re.compile("|".join(f"(?:{p})" for p in joined), re.I) if len(joined) == len(self.others) > 1 else None
        self.letter = re.compile(r"\w")

    def _bounded(self, text: str, at: int) -> bool:
        before, after = at > 0 and self.letter.match(text[at - 1]), at < len(text) and self.letter.match(text[at])
        return bool(before) != bool(after)

    def find(self, text: str) -> Iterator[tuple[str, str, str, int, int]]:
        if self.any_phrase:
            ends: dict[int, int] = {}
            for last, (size, owners) in self.phrases.iter(_lower(text)):
                start, end = last + 1 - size, last + 1
                for n, canonical, kind, before, after in owners:
                    if start >= ends.get(n, 0) and (not before or self._bounded(text, start)) and (not after or self._bounded(text, end)):
                        ends[n] = end
                        yield canonical, kind, text[start:end], start, end
        if self.any_other is None or self.any_other.search(text):
            for canonical, kind, pattern in self.others:
                for m in pattern.finditer(text):
                    yield canonical, kind, m[0], m.start(), m.end()


def extract_entities(df: DataFrame, lexicon: list[Term], key: str = "report_id", text: str = "text") -> DataFrame:
    """A row for each match of each pattern: ``(key, canonical, entity_type, surface, start, end)``; overlaps all count.

    Texts are read once for all phrases of the lexicon, and once to see whether any other pattern matches. Rows leave a
    task 10,000 at a time, so a text with any number of mentions needs no more memory. Null texts mention nothing.
    """
    kind = df.schema[key].dataType.simpleString()

    def found(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, columns = Finder(lexicon), [key, "canonical", "entity_type", "surface", "start", "end"]
        for batch in batches:
            every = ((k, *m) for k, t in zip(batch[key], batch[text]) if t for m in finder.find(t))
            while rows := list(islice(every, 10_000)):
                yield pd.DataFrame(rows, columns=columns)

    return df.select(key, text).mapInPandas(found, f"`{key}` {kind}, canonical string, entity_type string, surface string, start int, end int")


def external_entities(spans: DataFrame, texts: DataFrame, label_map: dict[str, str], key: str = "report_id") -> DataFrame:
    """Mentions from a model's spans ``(key, start, end, word, entity_group)``: the text's own words where offsets hold."""
    both = spans.join(texts.select(key, "text"), key, "left")
    valid = (F.col("start") >= 0) & (F.col("end") > F.col("start")) & (F.col("end") <= F.length("text"))
    surface = F.trim(F.when(valid, F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))).otherwise(F.coalesce("word", F.lit(""))))
    kinds = F.create_map(*[F.lit(x) for kv in label_map.items() for x in kv]) if label_map else None
    kind = F.coalesce(F.try_element_at(kinds, F.col("entity_group")), F.lit("HALLAZGO")) if label_map else F.lit("HALLAZGO")
    out = both.withColumn("surface", surface).filter("surface <> ''")
    return out.select(key, normalize_surface(F.col("surface")).alias("canonical"), kind.alias("entity_type"), "surface", "start", "end")


def entity_recall(pairs: DataFrame, original: str = "original_entities", humanized: str = "humanized_entities") -> DataFrame:
    """``pairs`` with the preserved, omitted and added canonicals and the recall; 1.0 where the original has none."""
    o, h = F.array_distinct(original), F.array_distinct(humanized)
    out = pairs.withColumns({
        "preserved": F.array_sort(F.array_intersect(o, h)), "omitted": F.array_sort(F.array_except(o, h)),
        "added": F.array_sort(F.array_except(h, o)), "n_original": F.size(o),
    })
    return out.withColumn("recall", F.when(F.col("n_original") == 0, 1.0).otherwise(F.size("preserved") / F.col("n_original")))


def entity_recall_by_type(mentions: DataFrame, pairs: DataFrame, key: str = "report_id") -> DataFrame:
    """Recall per pair and entity type, over the types of either side: a full join of the distinct canonicals."""
    once = mentions.select(F.col(key).alias("id"), "entity_type", "canonical").distinct()
    side = lambda c: pairs.join(once, pairs[c] == once["id"]).select("pair_id", "entity_type", "canonical", F.lit(True).alias(c[0]))
    both = side("original_id").join(side("humanized_id"), ["pair_id", "entity_type", "canonical"], "full")
    o, h = F.coalesce("o", F.lit(False)), F.coalesce("h", F.lit(False))
    out = both.groupBy("pair_id", "entity_type").agg(
        F.count_if(o).alias("n_original"), F.count_if(h).alias("n_humanized"), F.count_if(o & h).alias("n_preserved"),
        F.array_sort(F.collect_list(F.when(o & ~h, F.col("canonical")))).alias("omitted"),
        F.array_sort(F.collect_list(F.when(h & ~o, F.col("canonical")))).alias("added"),
    )
    return out.withColumn("recall", F.when(F.col("n_original") == 0, 1.0).otherwise(F.col("n_preserved") / F.col("n_original")))

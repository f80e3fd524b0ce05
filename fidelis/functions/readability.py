"""Readability of Spanish reports, as columns.

Published formulas over words W, sentences S, syllables Y and letters L. Syllables are counted by runs of vowels, one
at least for each word, where a leading vowel that would stand alone doesn't count as a syllable of its own: one before
a single consonant, or before two that open a syllable together. Scores differ by up to 1.5 points from those with a
hyphenation dictionary, which isn't public domain for us to include.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.text import n_words, strip_markdown_col

TARGET = 55.0
# Bands of the INFLESZ score and their labels.
BANDS: list[tuple[float, str]] = [
    (40.0, "muy dificil (nivel universitario)"),
    (55.0, "algo dificil (nivel bachillerato)"),
    (65.0, "normal (nivel ESO, recomendado para textos de salud)"),
    (80.0, "bastante facil (nivel 6 primaria)"),
]
EASIEST = "muy facil"
VOWELS = "aeiouáéíóúüàèìòùâêîôûäëïöAEIOUÁÉÍÓÚÜÀÈÌÒÙÂÊÎÔÛÄËÏÖ"


def inflesz_band(score: Column) -> Column:
    out = F.lit(EASIEST)
    for least, label in reversed(BANDS):
        out = F.when(score < least, label).otherwise(out)
    return out


def rounded(score: Column, places: int) -> Column:
    """Rounded as binary floating point has it, not by decimal digits."""
    return F.floor(score * 10**places + 0.5) / float(10**places)


#: Consonants that open a syllable together.
OPENING = "[bcdfgkpt][lr]|ch|ll|rr"
#: A sentence of three words or more: words are runs without white space that have a letter, a digit or a line.
SENTENCE = r"\b\w[^\s.!?]*+(?:\s[^\w.!?]*+\w[^\s.!?]*+){2}[^.!?]*+[.!?]*+"


def measures(text: Column) -> dict[str, Column]:
    """Counts of a plain text: characters, letters, words, sentences, syllables. Each is one pass that copies nothing."""
    count = lambda pattern: F.regexp_count(text, F.lit(f"(?U){pattern}"))
    lone = count(rf"\b[{VOWELS}](?=(?:(?i:{OPENING})|[^{VOWELS}\W\d_])[{VOWELS}])")
    # Words without a vowel: runs without one, less those of punctuation only.
    mute = count(rf"(?<!\S)[^\s{VOWELS}]++(?!\S)") - count(r"(?<!\S)[^\s\w]++(?!\S)")
    return {
        "n_chars_no_space": F.length(text) - count(r"\s"),
        "n_letters": count(r"\w"),
        "n_words": n_words(text),
        "n_sentences": F.greatest(count(SENTENCE), F.lit(1)),
        "n_syllables": count(f"[{VOWELS}]+") - lone + mute,
    }


def readability(df: DataFrame, text: str = "text", strip_md: bool = True) -> DataFrame:
    """``df`` with the 13 readability fields; a text without words scores 0. A null text counts as empty."""
    plain = F.coalesce(F.col(text), F.lit(""))
    df = df.withColumn("__plain", strip_markdown_col(plain) if strip_md else plain)
    df = df.withColumns(measures(F.col("__plain")))
    w, s, y, letters = (F.col(c).cast("double") for c in ("n_words", "n_sentences", "n_syllables", "n_letters"))
    some = F.col("n_words") > 0
    score = lambda x: F.when(some, x).otherwise(0.0)
    df = df.withColumn("__sp", score(206.835 - 62.3 * (y / w) - w / s))
    return df.withColumns({
        "avg_words_per_sentence": rounded(score(w / s), 2),
        "avg_syllables_per_word": rounded(score(y / w), 3),
        "fernandez_huerta": rounded(score(206.84 - 60 * (y / w) - 1.02 * (w / s)), 2),
        "szigriszt_pazos": rounded(F.col("__sp"), 2),
        "gutierrez_polini": rounded(score(95.2 - 9.7 * (letters / w) - 0.35 * (w / s)), 2),
        "crawford_school_years": rounded(score(-0.205 * (100 * s / w) + 0.049 * (100 * y / w) - 3.407), 2),
        "flesch_kincaid_grade": rounded(score(0.39 * (w / s) + 11.8 * (y / w) - 15.59), 2),
        "inflesz_category": inflesz_band(F.col("__sp")),
        "meets_healthcare_target": F.col("__sp") >= TARGET,
    }).drop("__plain", "__sp", "n_letters")


def compare_readability(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Changes from original to rewrite for ``pairs(pair_id, original_id, humanized_id)``; ``scores`` by ``report_id``.

    Positive is easier: rewrite less original for the ease scores, original less rewrite for grades and averages.
    """
    ease = {"delta_inflesz": "szigriszt_pazos", "delta_fernandez_huerta": "fernandez_huerta", "delta_gutierrez_polini": "gutierrez_polini"}
    load = {"delta_crawford_years": "crawford_school_years", "delta_fkgl_grades": "flesch_kincaid_grade", "delta_avg_wps": "avg_words_per_sentence", "delta_avg_spw": "avg_syllables_per_word"}
    fields = [*ease.values(), *load.values(), "meets_healthcare_target"]
    side = lambda p: scores.select(F.col("report_id").alias(f"{p}_id"), F.struct(*fields).alias(p))
    both = pairs.select("pair_id", "original_id", "humanized_id").join(side("original"), "original_id").join(side("humanized"), "humanized_id")
    return both.select(
        "pair_id",
        *[F.round(F.col(f"humanized.{c}") - F.col(f"original.{c}"), 2).alias(n) for n, c in ease.items()],
        *[F.round(F.col(f"original.{c}") - F.col(f"humanized.{c}"), 3 if n.endswith("spw") else 2).alias(n) for n, c in load.items()],
        F.col("original.meets_healthcare_target").alias("original_meets_target"),
        F.col("humanized.meets_healthcare_target").alias("humanized_meets_target"),
    )


def corpus_card(df: DataFrame, key: str = "report_id", text: str = "text") -> DataFrame:
    """Characters, words and INFLESZ per report."""
    found = readability(df.withColumn("n_chars", F.length(text)), text)
    return found.select(key, "n_chars", "n_words", "n_sentences", "szigriszt_pazos", "inflesz_category", "meets_healthcare_target")

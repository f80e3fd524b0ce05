"""Sentence counts of the gate, rules that are only looked for where a text holds their words, and normalized texts."""

import random
import re
import time
import unicodedata
from dataclasses import replace
from re import _parser as parser

from pyspark.sql import functions as F

from fidelis.functions.text import any_word, content_words, fold, normalize_surface, passages, searched
from fidelis.operators import checklist, entities
from fidelis.plans import gate
from fidelis.plans.further import KNEE
from fidelis.plans.queries import FINDINGS, LEXICON, h3_route
from fidelis.rules import Finding, Term, knee


# ---- counts of the gate


def test_measured_sentences_are_those_that_the_gate_cuts(spark):
    # A stop before a letter that opens no sentence: readability counts two runs there, the gate sees one sentence.
    texts = ["Uno dos tres. Èl cuatro cinco seis. Siete ocho nueve.", "Uno dos tres. cuatro cinco seis", "", None]
    pairs = spark.createDataFrame([(str(i), "Uno dos tres.", t) for i, t in enumerate(texts)], "pair_id string, original_text string, humanized_text string")
    got = {r["pair_id"]: r["n_sentences"] for r in gate.measure_pairs(pairs, FINDINGS, LEXICON).collect()}
    assert got == {"0": 2, "1": 1, "2": 0, "3": 0}


# ---- words of rules


def example(pattern, rng):
    """A text that a pattern's letters and gaps could match; what is between boundaries and look-arounds is ignored."""
    out = []
    for op, arg in pattern:
        name = str(op)
        if name == "LITERAL":
            out.append(chr(arg))
        elif name == "NOT_LITERAL":
            assert chr(arg) == "."
            out.append("x")
        elif name == "IN":
            out.append(rng.choice([chr(v) for o, v in arg if str(o) == "LITERAL"] or [" ", "\n", "\u00a0"]))
        elif name == "MAX_REPEAT":
            low, high, what = arg
            out += [example(what, rng) for _ in range(rng.randint(low, min(int(high), low + 3)))]
        elif name == "SUBPATTERN":
            out.append(example(arg[3], rng))
        elif name == "BRANCH":
            out.append(example(rng.choice(arg[1]), rng))
        else:
            assert name in ("AT", "ASSERT", "ASSERT_NOT"), name
    return "".join(out)


def patterns_of(rule):
    return rule.patterns if isinstance(rule, Term) else [*rule.presence, *rule.correctness, *rule.attenuation]


def test_every_match_of_a_knee_rule_holds_one_of_its_words_and_no_full_stop():
    rng = random.Random(4)
    for rule in [*knee.FINDINGS, *knee.LEXICON]:
        assert rule.words
        found = re.compile(any_word(rule.words).removeprefix("(?U)"))
        for pattern in patterns_of(rule):
            for _ in range(60):
                text = example(parser.parse(pattern), rng)
                assert found.search(text) and found.search(text.upper()) and "." not in text, (pattern, text)


def knee_texts(rng, n, size):
    """Texts of made-up words with knee phrases in them, some without stops, some with letters that only resemble others."""
    odd = [("i", "\u0131"), ("I", "\u0130"), ("s", "\u017f"), ("o", "ó"), ("í", "Í"), (" ", "\u00a0"), (" ", "\n"), (". ", " "), (".", "..")]
    lay = ["calca", "forma", "agua de la rodilla", "no", "sin", "grado", "III", "menisco", "hueso", "roto", "\u212aelvin", ""]
    out = []
    for _ in range(n):
        some = [rng.choice(KNEE) if rng.random() < 0.3 else rng.choice(lay) + rng.choice([" ", ".", ". ", " era "]) for _ in range(size)]
        text = "".join(some)
        for _ in range(2):
            text = text.replace(*rng.choice(odd))
        out.append(rng.choice([str, str.upper, str.lower])(text))
    return [*out, "", ".", "...", None, "sin.LCM rotura completa", "LCM sin rotura completa.no rotura completa LCM", "RM", "la rm.", "xRM", "grado I.I"]


def test_rules_with_words_find_what_they_find_without(spark):
    texts = spark.createDataFrame(list(enumerate(knee_texts(random.Random(5), 250, 7))), "pair_id int, text string").repartition(4).cache()
    rules, lexicon = [[replace(r, words=[]) for r in rs] for rs in (knee.FINDINGS, knee.LEXICON)]
    for evidence in (False, True):
        one, other = (checklist.check_findings(texts, r, with_evidence=evidence) for r in (knee.FINDINGS, rules))
        assert one.columns == other.columns
        assert sorted(map(str, one.collect())) == sorted(map(str, other.collect()))
    summed = [sorted(map(str, checklist.with_summary(texts, r).collect())) for r in (knee.FINDINGS, rules)]
    assert summed[0] == summed[1]
    text = F.col("text")
    both = texts.select("pair_id", searched(text, knee.LEXICON).alias("s"), text).select(
        "pair_id", entities.canonicals(F.col("s"), knee.LEXICON).alias("a"), entities.canonicals(text, knee.LEXICON).alias("b"), entities.canonicals(text, lexicon).alias("c"))
    rows = both.collect()
    assert all(r["a"] == r["b"] == r["c"] for r in rows) and len({str(r["c"]) for r in rows}) > 50


def test_passages_are_the_runs_that_hold_a_word(spark):
    text = "Uno rmn dos. La RM. Tres. \u017fIN resto.Fin \u212aA\n b"
    got = lambda words: spark.range(1).select(passages(F.lit(text), words)).first()[0]
    assert got([r"\brm\b", "sin"]) == " La RM. \u017fIN resto" and got(["ka", "rmn", "x-y"]) == "Uno rmn dos.Fin \u212aA\n b" and got(["cuatro"]) == ""
    some = [Finding("a", "", ["x"], [], [], words=["x"]), Finding("b", "", ["y"], [], [])]
    assert "array_join" not in str(searched(F.col("t"), some)) and "array_join" in str(searched(F.col("t"), some[:1]))
    assert entities.expand_synonyms([Term("t", "x", ["t"], ["t"])], {"t": ["lay"]})[0].words == []


def test_long_texts_are_not_searched_for_every_pattern(spark):
    plain = "Palabras de un texto que no trata de nada y que sigue sin llegar a ningún sitio. " * 400
    texts = spark.createDataFrame([(i, plain + KNEE[i % len(KNEE)]) for i in range(60)], "pair_id int, text string").repartition(4).cache()
    texts.count()

    def seconds(rules):
        began = time.time()
        checklist.check_findings(texts, rules).write.format("noop").mode("overwrite").save()
        return time.time() - began

    without = [replace(r, words=[]) for r in knee.FINDINGS]
    seconds(knee.FINDINGS), seconds(without)
    assert min(seconds(knee.FINDINGS) for _ in range(2)) < 0.5 * min(seconds(without) for _ in range(2))


# ---- normalized texts


def test_normalized_texts_equal_a_plain_version(spark):
    rng = random.Random(6)
    bits = ["Cóndilo", "ABC", "한국", "\u0bca", "e\u0301", "Ắ", "\u0f73x", "\u302e", "’", "—", "ß", "日本", "Ж", "\U0001d160", "\u20d0a", "x\U000e0100"]
    gaps = [" ", "  ", "\n", "\t ", " \t", "\u00a0", "\u2003 ", " \u00a0 ", "", "\r\n", "\u0085"]
    texts = ["".join(rng.choice(bits[: rng.choice([2, len(bits)])]) + rng.choice(gaps) for _ in range(rng.randint(0, 12))) for _ in range(600)]
    rows = list(enumerate(texts)) + [(-1, None), (-2, ""), (-3, " "), (-4, " \n "), (-5, "a  b"), (-6, "a \nb")]
    got = dict(spark.createDataFrame(rows, "id int, t string").select("id", normalize_surface(F.col("t"))).collect())
    bare = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    assert got == {i: None if t is None else re.sub(r"\s+", " ", bare(t).lower()).strip(" ") for i, t in rows}


def test_normalizing_takes_no_more_than_a_few_times_as_long_as_lower_case(spark):
    text = "Él está aquí — la más «pequeña» de las señales, según él. " * 600
    texts = spark.createDataFrame([(text,)] * 200, "t string").repartition(4).cache()
    texts.count()

    def seconds(column):
        began = time.time()
        texts.select(column.alias("x")).select(F.length("x")).write.format("noop").mode("overwrite").save()
        return time.time() - began

    least = lambda column: min(seconds(column) for _ in range(3))
    took, lower = least(normalize_surface(F.col("t"))), least(F.lower("t"))
    assert took < 25 * lower


# ---- routes and words


def test_routing_measures_each_pair_once(spark, tmp_path):
    turns = [(1, i, "user", f"The study number {i} was made with care. That section shows the state of things.") for i in range(4)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    routed = h3_route(spark, str(tmp_path))
    assert routed._jdf.queryExecution().optimizedPlan().toString().count("ArrowEvalPython") == 1
    assert sum(r["n"] for r in routed.collect()) == 3
    verdicts = spark.createDataFrame([("a", "APPROVE"), ("b", "REVIEW"), ("c", "REJECT")], "pair_id string, decision string")
    for strict in (False, True):
        sides = [{r["pair_id"] for r in side.collect()} for side in gate.route(verdicts, strict)]
        both = {(r["pair_id"], r["routed"]) for r in gate.with_route(verdicts, strict).collect()}
        assert both == {(p, "accepted") for p in sides[0]} | {(p, "blocked") for p in sides[1]}


def test_words_folded_together_are_those_folded_one_by_one(spark):
    rng = random.Random(7)
    bits = ["Él", "está", "ESTÁ", "\u0130stanbul", "\u0131", "e\u0301a", "l'aigua", "co-op", "ŉam", "Ŀall", "ſal", "Ħô", "σας", "x2y", "para", "Para", "¿qué?", "-a-", "''", "ÿŸ"]
    texts = ["".join(rng.choice(bits) + rng.choice([" ", ".", "", "\n"]) for _ in range(rng.randint(0, 15))) for _ in range(400)] + ["", None, " "]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    found = F.regexp_extract_all(F.coalesce("t", F.lit("")), F.lit(r"(?U)\b[a-zA-ZÀ-ſ][a-zA-ZÀ-ſ'\-]*\b"), F.lit(0))
    for stop, least in ((knee.STOP_WORDS, 3), ([], 1), ([], 0), (["sta"], 4)):
        kept = F.filter(F.transform(found, fold), lambda w: F.length(w) >= least)  # noqa: B023
        plain = F.array_distinct(F.array_except(kept, F.array(*map(F.lit, stop))) if stop else kept)
        assert all(r[0] == r[1] for r in rows.select(content_words(F.col("t"), stop, least), plain).collect())

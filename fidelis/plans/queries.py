"""Registered queries of the report-fidelity jobs over the driver's tables, with their DuckDB SQL.

A pair is a turn of a conversation and the turn after it. Rules and lexicon are literals that occur in those texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions.readability import BANDS, EASIEST, OPENING, VOWELS, compare_readability, readability
from fidelis.functions.text import MARKDOWN, content_words, n_words, normalize_surface, sentence_rows, strip_markdown_col
from fidelis.operators import checklist, delivery, entities, judge, sentences
from fidelis.plans import gate
from fidelis.rules import Finding, Term
from fidelis.rules.knee import STOP_WORDS
from fidelis.sources.reports import ingest_manifest

EDGE = r"(?:^|[^\p{L}\p{N}_])", r"(?:[^\p{L}\p{N}_]|$)"


def word(w: str) -> str:
    """A whole word, in a form that both engines read alike."""
    return f"{EDGE[0]}{w}{EDGE[1]}"


LEXICON = [
    Term("that", "ANATOMIA", [word("that")]), Term("with", "ANATOMIA", [word("with")]), Term("from", "HALLAZGO", [word("from")]),
    Term("this", "HALLAZGO", [word("this")]), Term("was", "SEVERIDAD", [word("was")]), Term("are", "PROCEDIMIENTO", [word("are")]),
    Term("tion", "HALLAZGO", ["tion"]), Term("thea", "ANATOMIA", ["thea"]),
]
ANCHORS = [t for t in LEXICON if t.entity_type == "ANATOMIA"]
FINDINGS = [
    Finding("the", "a", [word("the")], [f"{word('the')}[^.]{{0,40}}{word('of')}"], [f"{word('the')}[^.]{{0,20}}{word('was')}"]),
    Finding("and", "b", [word("and")], [word("and") + "[^.]{0,60}tion"], [word("and") + "[^.]{0,10}ing"], severity_optional=True),
    Finding("que", "c", [word("que")], [word("que")], [word("que") + "[^.]{0,20}" + word("la")]),
]
TERMS = ["the", "Of", "que", "und", "ation"]
T = gate.Thresholds(nli_score_threshold=0.10)
# The lexical and semantic profile ask for scores of 0.30 and 0.50, a rate of 0.50, and 16 or 4 unsupported at most.
PROFILES = {
    "belt": T, "lexical": gate.Thresholds(nli_min_entailment_rate=0.50), "semantic": gate.Thresholds(nli_min_entailment_rate=0.50, nli_max_hallucinations=4, nli_score_threshold=0.50),
    "loose": gate.Thresholds(ner_min_recall=0.3, nli_min_entailment_rate=0.05), "loose at 0.50": gate.Thresholds(ner_min_recall=0.3, nli_min_entailment_rate=0.05, nli_score_threshold=0.50),
}


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adjacent(_t(spark, sf_dir, "conversations"))


def adjacent(c: DataFrame) -> DataFrame:
    """Each turn with the one after it."""
    a = c.select("conv_id", "turn", F.col("text").alias("original_text"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("humanized_text"))
    key = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return a.join(b, ["conv_id", "turn"]).select(key.alias("pair_id"), key.alias("original_id"), "original_text", "humanized_text")


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.measure_pairs(pairs(spark, sf_dir), FINDINGS, LEXICON, T.nli_score_threshold)


def b1_strip_markdown(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    s = strip_markdown_col(F.col("text"))
    return d.select("doc_id", F.length(s).cast("long").alias("n_chars"), F.md5(s.cast("binary")).alias("digest"))


def b2_sentences(spark, sf_dir):
    rows = sentence_rows(_t(spark, sf_dir, "documents"), "text", "doc_id")
    return rows.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum(F.length("sentence")).alias("n_chars"), F.max("sentence").alias("last_sorted"))


def b3_content_words(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumn("w", content_words(F.col("text")))
    return c.select("conv_id", "turn", F.size("w").cast("long").alias("n"), F.array_join(F.array_sort("w"), " ").alias("words"))


def b4_normalize_surface(spark, sf_dir):
    d, c = _t(spark, sf_dir, "documents"), _t(spark, sf_dir, "conversations")
    rows = d.select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text").unionAll(c.select(F.lit("c"), F.col("conv_id") * 1000 + F.col("turn"), "text"))
    rows = rows.select("kind", "id", normalize_surface(F.col("text")).alias("s"))
    return rows.select("kind", "id", F.length("s").cast("long").alias("n_chars"), F.md5(F.col("s").cast("binary")).alias("digest"))


READ = [
    "n_chars_no_space", "n_words", "n_sentences", "n_syllables", "avg_words_per_sentence", "avg_syllables_per_word", "szigriszt_pazos", "fernandez_huerta",
    "gutierrez_polini", "crawford_school_years", "flesch_kincaid_grade", "inflesz_category", "meets_healthcare_target",
]


def c1_readability(spark, sf_dir):
    r = readability(_t(spark, sf_dir, "documents").select("doc_id", "text"), strip_md=False)
    return r.select("doc_id", *[F.col(c).cast("long") if c.startswith("n_") else F.col(c) for c in READ])


def c3_compare_readability(spark, sf_dir):
    p = pairs(spark, sf_dir)
    one = lambda c, s: p.select(F.concat("pair_id", F.lit(s)).alias("report_id"), F.col(c).alias("text"))
    scores = readability(one("original_text", "o").unionAll(one("humanized_text", "h")), strip_md=False)
    named = p.select("pair_id", F.concat("pair_id", F.lit("o")).alias("original_id"), F.concat("pair_id", F.lit("h")).alias("humanized_id"))
    return compare_readability(scores, named).select("pair_id", "delta_inflesz", "delta_fernandez_huerta", "delta_crawford_years", "delta_fkgl_grades", "delta_avg_wps", "delta_avg_spw", "original_meets_target", "humanized_meets_target")


def d1_check_findings(spark, sf_dir):
    checks = checklist.check_findings(pairs(spark, sf_dir), FINDINGS, "pair_id", "humanized_text")
    return checks.select("pair_id", "finding", "mentioned", "severity_preserved", "attenuation_detected", "status")


def d5_checklist_summary(spark, sf_dir):
    s = checklist.checklist_summary(checklist.check_findings(pairs(spark, sf_dir), FINDINGS, "pair_id", "humanized_text"))
    return s.select("pair_id", "n_findings", "n_mentioned", "n_correct", "n_attenuated", "n_omitted", "n_wrong_severity", "overall_pass")


def d8_finding_profile(spark, sf_dir):
    s = checklist.finding_profile(checklist.check_findings(pairs(spark, sf_dir), FINDINGS, "pair_id", "humanized_text"))
    return s.select("finding", "n_findings", "n_mentioned", "n_correct", "n_attenuated", "n_omitted", "n_wrong_severity")


def d8_levels(spark, sf_dir):
    s = checklist.checklist_levels(checklist.check_findings(pairs(spark, sf_dir), FINDINGS, "pair_id", "humanized_text"))
    return s.select("level", "pair_id", "finding", "n_findings", "n_mentioned", "n_correct", "n_attenuated", "n_omitted", "n_wrong_severity")


def d9_key_terms(spark, sf_dir):
    k = checklist.key_term_preservation(pairs(spark, sf_dir), TERMS)
    return k.select("pair_id", F.array_join("present", ",").alias("present"), F.array_join("missing", ",").alias("missing"))


MENTIONS = [Term("tion", "HALLAZGO", ["tion", "ation"]), Term("the", "ANATOMIA", ["the"]), Term("and", "SEVERIDAD", [r"\band\b", "an[dt]"]), Term("ther", "ANATOMIA", ["ther"])]


def e1_mentions(spark, sf_dir):
    """Every mention with its place: phrases with and without word boundaries, a pattern, overlaps."""
    return entities.extract_entities(_t(spark, sf_dir, "documents"), MENTIONS, "doc_id").select("doc_id", "canonical", "entity_type", "surface", "start", "end")


def e4_entity_recall(spark, sf_dir):
    p = pairs(spark, sf_dir)
    sides = p.select("pair_id", *[entities.canonicals(F.col(f"{s}_text"), LEXICON).alias(f"{s}_entities") for s in ("original", "humanized")])
    r = entities.entity_recall(sides)
    return r.select("pair_id", F.round("recall", 4).alias("recall"), *[F.array_join(c, ",").alias(c) for c in ("preserved", "omitted", "added")])


def e5_recall_by_type(spark, sf_dir):
    p = pairs(spark, sf_dir)
    tag = lambda side, s: p.select(F.concat("pair_id", F.lit(s)).alias("report_id"), F.explode(entities.canonicals(F.col(side), LEXICON)).alias("canonical"))
    kinds = F.create_map(*[F.lit(x) for t in LEXICON for x in (t.canonical, t.entity_type)])
    m = tag("original_text", "o").unionAll(tag("humanized_text", "h")).withColumn("entity_type", kinds[F.col("canonical")])
    named = p.select("pair_id", F.concat("pair_id", F.lit("o")).alias("original_id"), F.concat("pair_id", F.lit("h")).alias("humanized_id"))
    r = entities.entity_recall_by_type(m, named)
    return r.select("pair_id", "entity_type", "n_original", "n_humanized", "n_preserved", F.round("recall", 4).alias("recall"), F.array_join("omitted", ",").alias("omitted"))


def f4_entailment_report(spark, sf_dir):
    p = pairs(spark, sf_dir)
    r = sentences.entailment_report(sentences.sentence_verdicts(p, LEXICON, 0.10, texts=False), p)
    return r.select("pair_id", "n_sentences", "n_assessed", "n_entailed", "n_unsupported", F.round("entailment_rate", 4).alias("entailment_rate"))


def f3_sentence_scores(spark, sf_dir):
    v = sentences.sentence_verdicts(pairs(spark, sf_dir), LEXICON, 0.10, texts=False)
    return v.groupBy("pair_id").agg(F.round(F.sum("score"), 4).alias("total"), F.count_if(F.col("skip_reason") == sentences.SHORT).alias("n_short"), F.count_if(F.col("skip_reason") == sentences.PLAIN).alias("n_plain"))


def f6_contradictions(spark, sf_dir):
    p = pairs(spark, sf_dir)
    hyp = sentence_rows(p, "humanized_text", "pair_id", "original_id")
    prem = sentence_rows(p, "original_text", "original_id")
    met, alone = sentences.contradiction_candidates(hyp, prem, ANCHORS)
    scored = met.withColumn("contradiction", (F.length("sentence") * 7 + F.length("premise") * 13) % 100 / 100.0)
    report = sentences.contradiction_report(p, hyp, sentences.worst_premise(scored, 0.9))
    skipped = alone.groupBy("pair_id").agg(F.count("*").alias("n_skipped"))
    return report.join(skipped, "pair_id", "left").select("pair_id", "n_sentences", "n_assessed", "n_contradictions", F.coalesce("n_skipped", F.lit(0)).alias("n_skipped"))


def _responses(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").select("doc_id", "n_chars").filter("doc_id is not null")
    one = lambda f, s: F.concat(F.lit(f'{{"finding":"{f}","status":"'), s, F.lit('","confidence":0.'), (F.col("doc_id") % 10).cast("string"), F.lit("}"))
    status = F.element_at(F.array(*map(F.lit, [*judge.STATUSES, "odd"])), (F.col("doc_id") % 6 + 1).cast("int"))
    many = F.concat(F.lit("["), one("x", status), F.lit(","), one("y", F.lit("preserved")), F.lit("]"))
    raw = F.when(F.col("doc_id") % 7 == 0, "no json").when(F.col("doc_id") % 7 == 1, F.concat(F.lit("```json\n"), many, F.lit("\n```"))).when(F.col("doc_id") % 7 == 2, one("x", status)).otherwise(many)
    n = F.col("n_chars")
    return d.select(F.col("doc_id").cast("string").alias("pair_id"), raw.alias("raw"), (n / 1000).alias("latency_s"), n.alias("input_tokens"), (n % 50).alias("output_tokens"))


def g4_judge_report(spark, sf_dir):
    r = _responses(spark, sf_dir)
    v = judge.complete_judge(judge.parse_judge(r), r, ["x", "y"])
    out = judge.judge_report(v, r)
    return out.select("pair_id", *[f"n_{s}" for s in [*judge.STATUSES, judge.ERROR]], "verdict", "input_tokens", "output_tokens")


def h1_gate(spark, sf_dir):
    d = gate.decide(measures(spark, sf_dir), T)
    return d.select("pair_id", "checklist_passed", "ner_passed", "nli_passed", F.col("votes").cast("long").alias("votes"), "decision")


def h3_route(spark, sf_dir):
    return gate.with_route(gate.decide(measures(spark, sf_dir), T)).groupBy("routed", "decision").agg(F.count("*").alias("n"))


def h4_sweep(spark, sf_dir):
    s = gate.sweep_thresholds(measures(spark, sf_dir), PROFILES)
    return s.groupBy("profile", "decision").agg(F.count("*").alias("n"), F.sum("n_entailed").alias("n_entailed"), F.sum("n_unsupported").alias("n_unsupported"))


def h6_expected(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pair_id"), F.when(F.col("quality") == 1, 0).alias("expected"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), F.regexp_count("text", F.lit("!!")).cast("int").alias("n"))
    return gate.expected_vs_actual(docs, labels).groupBy("expected", "ok").agg(F.count("*").alias("n"))


def a3_manifest(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    up = o.select(F.col("o_orderkey").alias("study_id"), F.col("o_custkey").alias("dni"), F.floor(F.col("o_totalprice") * 100).alias("n_bytes"), F.col("o_orderstatus").alias("report_type"), F.lit(None).cast("string").alias("filename"))
    return ingest_manifest(up)


def i1_delivery(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    studies = o.select(F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").alias("issued_at"))
    rid = F.concat_ws("/", F.col("l_orderkey").cast("string"), F.lpad(F.col("l_linenumber").cast("string"), 3, "0"))
    reports = li.select(F.col("l_orderkey").alias("study_id"), rid.alias("report_id"), F.when(F.col("l_linenumber") == 1, "ORIGINAL").otherwise("HUMANIZED").alias("report_type"))
    m = delivery.delivery_manifest(studies, reports, li.filter("l_quantity > 25").select(rid.alias("report_id")).distinct())
    return m.select("study_id", F.array_join("report_ids", ",").alias("report_ids"), F.date_format("expires_at", "yyyy-MM-dd").alias("expires_on"), "error")


def i3_constraints(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select("event_id", F.col("value").alias("confidence"), F.substring(F.col("event_type"), 1, 3).alias("pin"), (F.col("user_id") % 900).alias("max_chars"))
    v = delivery.check_constraints(e).select(F.explode("violations").alias("rule"))
    return v.groupBy("rule").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        b1_strip_markdown, b2_sentences, b3_content_words, b4_normalize_surface, c1_readability, c3_compare_readability, d1_check_findings,
        d5_checklist_summary, d8_finding_profile, d8_levels, d9_key_terms, e1_mentions, e4_entity_recall, e5_recall_by_type, f3_sentence_scores, f4_entailment_report,
        f6_contradictions, g4_judge_report, h1_gate, h3_route, h4_sweep, h6_expected, a3_manifest, i1_delivery, i3_constraints,
    )
}

# ---- DuckDB SQL

Q = lambda s: "'" + s.replace("'", "''") + "'"
PAIRS = """pairs AS (SELECT a.conv_id || '-' || a.turn AS pair_id, coalesce(a.text, '') AS o, coalesce(b.text, '') AS h
 FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {Q('(?is)' + pattern)})"


def _checks() -> str:
    rows = []
    for f in FINDINGS:
        any_of = lambda ps: "(" + " OR ".join(_has("h", p) for p in ps) + ")"
        rows.append(f"SELECT pair_id, {Q(f.name)} AS finding, {str(f.severity_optional).lower()} AS opt, {any_of(f.presence)} AS m, {any_of(f.correctness)} AS c, {any_of(f.attenuation)} AS a FROM pairs")
    body = " UNION ALL ".join(rows)
    return f"{PAIRS}, checks AS (SELECT pair_id, finding, m, a, CASE WHEN opt AND m AND NOT a THEN true ELSE c END AS p FROM ({body}))"


COUNTS = """count(*) AS n_findings, count(*) FILTER (m) AS n_mentioned, count(*) FILTER (m AND p AND NOT a) AS n_correct, count(*) FILTER (a) AS n_attenuated,
 count(*) FILTER (NOT m) AS n_omitted, count(*) FILTER (m AND NOT p AND NOT a) AS n_wrong_severity"""


def _canon(text: str, lexicon: list[Term] = LEXICON) -> str:
    tests = ", ".join(f"CASE WHEN {_has(text, t.patterns[0])} THEN {Q(t.canonical)} END" for t in lexicon)
    return f"list_filter([{tests}], lambda x: x IS NOT NULL)"


SENTS = r"""list_filter(flatten(list_transform(string_split_regex({0}, '\n\s*\n+'), lambda p: string_split(regexp_replace(trim(regexp_replace(p, '\s+', ' ', 'g')),
 '([.!?])\s+([A-ZÁÉÍÓÚÑÜ¿¡])', '\1' || chr(1) || '\2', 'g'), chr(1)))), lambda s: len(string_split(trim(s), ' ')) >= 3)"""
STOPS = "[" + ", ".join(Q(w) for w in STOP_WORDS) + "]"
WORDS = "list_distinct(list_filter(regexp_extract_all(strip_accents(lower({0})), '[a-zß][a-zß''\\-]*'), lambda w: length(w) >= 3 AND NOT list_contains(" + STOPS + ", w)))"
SENTENCE_CTE = f"""{PAIRS}, hs AS (SELECT pair_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT pair_id, {SENTS.format('h')} AS x FROM pairs)),
 ps AS (SELECT pair_id, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT pair_id, {SENTS.format('o')} AS x FROM pairs))"""
VERDICT_CTE = f"""{SENTENCE_CTE}, hw AS (SELECT pair_id, pos, {WORDS.format('s')} AS w, {" OR ".join(_has('s', t.patterns[0]) for t in LEXICON)} AS e FROM hs),
 g AS (SELECT *, CASE WHEN len(w) < 4 THEN 'short' WHEN NOT e THEN 'plain' END AS r FROM hw), pw AS (SELECT pair_id, {WORDS.format('s')} AS w FROM ps),
 best AS (SELECT g.pair_id, g.pos, max(len(list_intersect(g.w, pw.w)) / len(g.w)) AS b FROM g JOIN pw USING (pair_id) WHERE r IS NULL GROUP BY ALL),
 v AS (SELECT g.pair_id, g.pos, r, CASE WHEN r IS NOT NULL THEN 1.0 ELSE coalesce(b, 0.0) END AS score FROM g LEFT JOIN best USING (pair_id, pos)),
 rep AS (SELECT p.pair_id, count(v.pair_id) AS n_sentences, count(*) FILTER (v.pair_id IS NOT NULL AND r IS NULL) AS n_assessed,
  count(*) FILTER (v.pair_id IS NOT NULL AND r IS NULL AND score >= 0.10) AS n_entailed, count(*) FILTER (v.pair_id IS NOT NULL AND r IS NULL AND score < 0.10) AS n_unsupported
  FROM pairs p LEFT JOIN v USING (pair_id) GROUP BY p.pair_id),
 entail AS (SELECT *, CASE WHEN n_assessed = 0 THEN 1.0 ELSE n_entailed / n_assessed END AS rate FROM rep)"""
RECALL_CTE = f"""ents AS (SELECT pair_id, {_canon('o')} AS oe, {_canon('h')} AS he FROM pairs),
 rec AS (SELECT pair_id, oe, he, CASE WHEN len(oe) = 0 THEN 1.0 ELSE len(list_intersect(oe, he)) / len(oe) END AS recall FROM ents)"""


def _measured() -> str:
    checks = _checks().split(", checks AS", 1)[1]
    return f"""WITH {VERDICT_CTE}, {RECALL_CTE}, checks AS{checks}, sums AS (SELECT pair_id, {COUNTS} FROM checks GROUP BY pair_id),
 meas AS (SELECT pair_id, n_omitted = 0 AND n_attenuated = 0 AND n_wrong_severity = 0 AS c, recall, rate, n_unsupported AS u FROM sums JOIN rec USING (pair_id) JOIN entail USING (pair_id))"""


def _voted(t: gate.Thresholds) -> str:
    """Votes under a profile, whose score threshold decides which of the scored sentences count as supported."""
    counts = f"count(*) FILTER (x.score IS NOT NULL) AS a, count(*) FILTER (x.score >= {t.nli_score_threshold}) AS e"
    scores = "(SELECT pair_id, score FROM v WHERE r IS NULL)"
    source = f"""(SELECT m.*, coalesce(a, 0) AS n_assessed, coalesce(e, 0) AS n_entailed, coalesce(a - e, 0) AS u, CASE WHEN coalesce(a, 0) = 0 THEN 1.0 ELSE e / a END AS rate
 FROM (SELECT pair_id, c, recall FROM meas) m LEFT JOIN (SELECT pair_id, {counts} FROM {scores} x GROUP BY pair_id) USING (pair_id))"""
    return f"""(SELECT *, c::INT + n::INT + l::INT AS votes, CASE c::INT + n::INT + l::INT WHEN 3 THEN 'APPROVE' WHEN 2 THEN 'REVIEW' ELSE 'REJECT' END AS decision
 FROM (SELECT pair_id, c, n_entailed, u, recall >= {t.ner_min_recall} AS n, rate >= {t.nli_min_entailment_rate} AND u <= {t.nli_max_hallucinations} AS l FROM {source}))"""


BARE = r"trim(regexp_replace(regexp_replace({0}, '[^\p{{L}}\p{{N}}_\s]+', '', 'g'), '\s+', ' ', 'g'))"
NWORDS = f"(CASE WHEN {BARE} = '' THEN 0 ELSE len(string_split({BARE}, ' ')) END)"
CONSONANTS = "b-df-hj-np-tv-zB-DF-HJ-NP-TV-ZñÑçÇß"
MEASURED = (
    "SELECT *, length(regexp_replace(t, '[^\\p{L}\\p{N}\\p{M}_]+', '', 'g')) AS l, " + NWORDS.format("t") + " AS w, greatest(1, len(list_filter(regexp_extract_all(t, '[^.!?]+[.!?]*'), lambda r: " + NWORDS.format("r") + " > 2))) AS s, "
    + f"len(regexp_extract_all(t, '[{VOWELS}]+')) - len(regexp_extract_all(t, '(?:^|[^\\p{{L}}\\p{{N}}_])[{VOWELS}](?:(?i:{OPENING})|[{CONSONANTS}])[{VOWELS}]'))"
    + " + len(list_filter(string_split(" + BARE.format("t") + f", ' '), lambda x: x <> '' AND NOT regexp_matches(x, '[{VOWELS}]'))) AS y"
)
SP = "(CASE WHEN w > 0 THEN 206.835 - 62.3 * (y::DOUBLE / w) - w::DOUBLE / s ELSE 0 END)"
FK = "(CASE WHEN w > 0 THEN 0.39 * (w::DOUBLE / s) + 11.8 * (y::DOUBLE / w) - 15.59 ELSE 0 END)"
ROUNDED = "floor((CASE WHEN w > 0 THEN {0} ELSE 0 END) * {1} + 0.5) / {1}.0"
BAND = "CASE " + " ".join(f"WHEN {SP} < {b} THEN {Q(label)}" for b, label in BANDS) + f" ELSE {Q(EASIEST)} END"


def _markdown() -> str:
    out = "text"
    for pattern, left in MARKDOWN:
        out = f"regexp_replace({out}, {Q(pattern)}, {Q(left).replace('$1', chr(92) + '1')}, 'g')" if "\n" not in left else f"regexp_replace({out}, {Q(pattern)}, chr(10) || chr(10), 'g')"
    return f"regexp_replace({out}, '^\\s+|\\s+$', '', 'g')"


STATUS = checklist.STATUS
EASE = ("delta_inflesz", "delta_fernandez_huerta")
SCORES = {
    "delta_inflesz": f"floor({SP} * 100 + 0.5) / 100.0", "delta_fernandez_huerta": ROUNDED.format("206.84 - 60 * (y::DOUBLE / w) - 1.02 * (w::DOUBLE / s)", 100),
    "delta_crawford_years": ROUNDED.format("-0.205 * (100 * s::DOUBLE / w) + 0.049 * (100 * y::DOUBLE / w) - 3.407", 100), "delta_fkgl_grades": f"floor({FK} * 100 + 0.5) / 100.0",
    "delta_avg_wps": ROUNDED.format("w::DOUBLE / s", 100), "delta_avg_spw": ROUNDED.format("y::DOUBLE / w", 1000),
}
ORACLE_SQL: dict[str, str] = {
    "b1_strip_markdown": f"SELECT doc_id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT doc_id, {_markdown()} AS s FROM documents)",
    "b2_sentences": f"SELECT doc_id, count(*) AS n_sentences, sum(length(trim(s)))::BIGINT AS n_chars, max(trim(s)) AS last_sorted FROM (SELECT doc_id, unnest({SENTS.format('text')}) AS s FROM documents) GROUP BY doc_id",
    "b3_content_words": f"SELECT conv_id, turn, len(w) AS n, array_to_string(list_sort(w), ' ') AS words FROM (SELECT conv_id, turn, {WORDS.format('text')} AS w FROM conversations)",
    "b4_normalize_surface": "SELECT kind, id, length(s) AS n_chars, md5(s) AS digest FROM (SELECT kind, id, trim(regexp_replace(strip_accents(lower(text)), '\\s+', ' ', 'g'), ' ') AS s FROM (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'c', conv_id * 1000 + turn, text FROM conversations))",
    "c1_readability": f"SELECT doc_id, length(regexp_replace(t, '\\s+', '', 'g')) AS n_chars_no_space, {ROUNDED.format('w::DOUBLE / s', 100)} AS avg_words_per_sentence, {ROUNDED.format('y::DOUBLE / w', 1000)} AS avg_syllables_per_word, {ROUNDED.format('-0.205 * (100 * s::DOUBLE / w) + 0.049 * (100 * y::DOUBLE / w) - 3.407', 100)} AS crawford_school_years, w AS n_words, s AS n_sentences, y AS n_syllables, floor({SP} * 100 + 0.5) / 100.0 AS szigriszt_pazos, floor((CASE WHEN w > 0 THEN 206.84 - 60 * (y::DOUBLE / w) - 1.02 * (w::DOUBLE / s) ELSE 0 END) * 100 + 0.5) / 100.0 AS fernandez_huerta, floor({FK} * 100 + 0.5) / 100.0 AS flesch_kincaid_grade, {ROUNDED.format('95.2 - 9.7 * (l::DOUBLE / w) - 0.35 * (w::DOUBLE / s)', 100)} AS gutierrez_polini, {BAND} AS inflesz_category, {SP} >= 55 AS meets_healthcare_target FROM ({MEASURED} FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents))",
    "c3_compare_readability": f"WITH {PAIRS}, sc AS (SELECT pair_id, k, {SP} AS sp, {', '.join(f'{x} AS {n}' for n, x in SCORES.items())} FROM ({MEASURED} FROM (SELECT pair_id, 'o' AS k, o AS t FROM pairs UNION ALL SELECT pair_id, 'h', h FROM pairs))) SELECT a.pair_id, "
    + ", ".join(f"round({'b' if n in EASE else 'a'}.{n} - {'a' if n in EASE else 'b'}.{n}, {3 if n.endswith('spw') else 2}) AS {n}" for n in SCORES)
    + ", a.sp >= 55 AS original_meets_target, b.sp >= 55 AS humanized_meets_target FROM sc a JOIN sc b ON a.pair_id = b.pair_id AND a.k = 'o' AND b.k = 'h'",
    "d1_check_findings": f"WITH {_checks()} SELECT pair_id, finding, m AS mentioned, p AS severity_preserved, a AS attenuation_detected, CASE WHEN a THEN {Q(STATUS['attenuated'])} WHEN NOT m THEN {Q(STATUS['omitted'])} WHEN NOT p THEN {Q(STATUS['wrong_severity'])} ELSE {Q(STATUS['ok'])} END AS status FROM checks",
    "d5_checklist_summary": f"WITH {_checks()} SELECT *, n_omitted = 0 AND n_attenuated = 0 AND n_wrong_severity = 0 AS overall_pass FROM (SELECT pair_id, {COUNTS} FROM checks GROUP BY pair_id)",
    "d8_finding_profile": f"WITH {_checks()} SELECT finding, {COUNTS} FROM checks GROUP BY finding",
    "d8_levels": f"WITH {_checks()} SELECT CASE WHEN grouping(pair_id) = 0 THEN 'report' WHEN grouping(finding) = 0 THEN 'finding' ELSE 'all' END AS level, pair_id, finding, {COUNTS} FROM checks GROUP BY GROUPING SETS ((pair_id), (finding), ())",
    "d9_key_terms": f"WITH {PAIRS}, k AS (SELECT pair_id, h, list_filter([{', '.join(map(Q, TERMS))}], lambda x: contains(lower(o), lower(x))) AS t FROM pairs) SELECT pair_id, array_to_string(list_filter(t, lambda x: contains(lower(h), lower(x))), ',') AS present, array_to_string(list_filter(t, lambda x: NOT contains(lower(h), lower(x))), ',') AS missing FROM k",
    "e1_mentions": "SELECT doc_id, canonical, entity_type, surface, (stop - length(surface))::INT AS start, stop::INT AS end FROM (" + " UNION ALL ".join(
        f"SELECT doc_id, {Q(t.canonical)} AS canonical, {Q(t.entity_type)} AS entity_type, found[i] AS surface, length(array_to_string(parts[1:i], '')) + length(array_to_string(found[1:i], '')) AS stop FROM (SELECT *, unnest(range(1, len(found) + 1)) AS i"
        f" FROM (SELECT doc_id, regexp_extract_all(text, {Q('(?i)' + p)}) AS found, string_split_regex(text, {Q('(?i)' + p)}) AS parts FROM documents))" for t in MENTIONS for p in t.patterns) + ")",
    "e4_entity_recall": f"WITH {PAIRS}, {RECALL_CTE} SELECT pair_id, round(recall, 4) AS recall, array_to_string(list_sort(list_filter(oe, lambda x: list_contains(he, x))), ',') AS preserved, array_to_string(list_sort(list_filter(oe, lambda x: NOT list_contains(he, x))), ',') AS omitted, array_to_string(list_sort(list_filter(he, lambda x: NOT list_contains(oe, x))), ',') AS added FROM rec",
    "e5_recall_by_type": f"WITH {PAIRS}, kinds(c, entity_type) AS (VALUES {', '.join(f'({Q(t.canonical)}, {Q(t.entity_type)})' for t in LEXICON)}), {RECALL_CTE}, x AS (SELECT pair_id, c, list_contains(oe, c) AS o, list_contains(he, c) AS h, entity_type FROM rec, kinds WHERE list_contains(oe, c) OR list_contains(he, c)) SELECT pair_id, entity_type, count(*) FILTER (o) AS n_original, count(*) FILTER (h) AS n_humanized, count(*) FILTER (o AND h) AS n_preserved, round(CASE WHEN count(*) FILTER (o) = 0 THEN 1.0 ELSE count(*) FILTER (o AND h) / count(*) FILTER (o) END, 4) AS recall, coalesce(string_agg(c, ',' ORDER BY c) FILTER (o AND NOT h), '') AS omitted FROM x GROUP BY ALL",
    "f3_sentence_scores": f"WITH {VERDICT_CTE} SELECT pair_id, round(sum(score), 4) AS total, count(*) FILTER (r = 'short') AS n_short, count(*) FILTER (r = 'plain') AS n_plain FROM v GROUP BY pair_id",
    "f4_entailment_report": f"WITH {VERDICT_CTE} SELECT pair_id, n_sentences, n_assessed, n_entailed, n_unsupported, round(rate, 4) AS entailment_rate FROM entail",
    "f6_contradictions": f"WITH {SENTENCE_CTE}, ha AS (SELECT *, {_canon('s', ANCHORS)} AS e FROM hs), pa AS (SELECT *, {_canon('s', ANCHORS)} AS e FROM ps), w AS (SELECT ha.pair_id, ha.pos, max((length(trim(ha.s)) * 7 + length(trim(pa.s)) * 13) % 100 / 100.0) AS c FROM ha JOIN pa ON ha.pair_id = pa.pair_id AND len(list_intersect(ha.e, pa.e)) > 0 GROUP BY ALL), r AS (SELECT p.pair_id, (SELECT count(*) FROM hs WHERE hs.pair_id = p.pair_id) AS n_sentences, (SELECT count(*) FROM w WHERE w.pair_id = p.pair_id) AS n_assessed, (SELECT count(*) FROM w WHERE w.pair_id = p.pair_id AND c >= 0.9) AS n_contradictions FROM pairs p) SELECT *, n_sentences - n_assessed AS n_skipped FROM r",
    "g4_judge_report": "WITH d AS (SELECT *, ['preserved', 'simplified', 'omitted', 'attenuated', 'hallucinated', 'parse_error'][doc_id % 6 + 1] AS s FROM documents WHERE doc_id IS NOT NULL), v AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'parse_error' ELSE s END AS s FROM d UNION ALL SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 2) THEN 'parse_error' ELSE 'preserved' END FROM d), c AS (SELECT doc_id, "
    + ", ".join(f"count(*) FILTER (s = '{s}') AS n_{s}" for s in [*judge.STATUSES, judge.ERROR])
    + " FROM v GROUP BY doc_id) SELECT doc_id::VARCHAR AS pair_id, c.* EXCLUDE (doc_id), CASE WHEN n_omitted + n_attenuated + n_hallucinated + n_parse_error > 0 THEN 'FAIL' ELSE 'PASS' END AS verdict, n_chars AS input_tokens, n_chars % 50 AS output_tokens FROM c JOIN d USING (doc_id)",
    "h1_gate": f"{_measured()} SELECT pair_id, c AS checklist_passed, n AS ner_passed, l AS nli_passed, votes::BIGINT AS votes, decision FROM {_voted(T)}",
    "h3_route": f"{_measured()} SELECT CASE WHEN decision = 'REJECT' THEN 'blocked' ELSE 'accepted' END AS routed, decision, count(*) AS n FROM {_voted(T)} GROUP BY ALL",
    "h4_sweep": _measured() + " " + " UNION ALL ".join(f"SELECT {Q(k)} AS profile, decision, count(*) AS n, sum(n_entailed)::BIGINT AS n_entailed, sum(u)::BIGINT AS n_unsupported FROM {_voted(t)} GROUP BY ALL" for k, t in PROFILES.items()),
    "h6_expected": "SELECT expected, CASE WHEN expected IS NULL THEN n >= 1 ELSE n = expected END AS ok, count(*) AS n FROM (SELECT CASE WHEN quality = 1 THEN 0 END AS expected, len(regexp_extract_all(text, '!!')) AS n FROM documents JOIN labels USING (doc_id)) GROUP BY ALL",
    "a3_manifest": "SELECT o_orderkey AS study_id, greatest(1, floor(b / 524288))::BIGINT AS n_instances, 'folder-' || o_custkey AS folder_id, 'informe_' || lower(o_orderstatus) || '.pdf' AS filename, b AS size_bytes FROM (SELECT *, floor(o_totalprice * 100)::BIGINT AS b FROM orders)",
    "i1_delivery": "SELECT o_orderkey AS study_id, coalesce(r, '') AS report_ids, strftime(o_orderdate + INTERVAL 168 HOUR, '%Y-%m-%d') AS expires_on, CASE WHEN r IS NULL THEN 'no report' END AS error FROM orders LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_orderkey || '/' || lpad(l_linenumber::VARCHAR, 3, '0'), ',' ORDER BY l_orderkey || '/' || lpad(l_linenumber::VARCHAR, 3, '0')) AS r FROM lineitem WHERE l_linenumber = 1 OR l_quantity > 25 GROUP BY 1) ON l_orderkey = o_orderkey",
    "i3_constraints": "SELECT rule, count(*) AS n FROM (SELECT 'confidence_range' AS rule FROM events WHERE value NOT BETWEEN 0 AND 1 UNION ALL SELECT 'pin_length' FROM events WHERE event_type IS NULL OR length(substr(event_type, 1, 3)) NOT BETWEEN 4 AND 8 UNION ALL SELECT 'max_chars_least' FROM events WHERE user_id % 900 < 500) GROUP BY rule",
}

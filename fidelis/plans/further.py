"""More registered queries of the report-fidelity jobs, with their DuckDB SQL: sources, rules, spans, modes, reports, stream."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.functions.readability import BANDS, corpus_card
from fidelis.functions.text import n_words, searched, sentence_rows
from fidelis.operators import checklist, delivery, entities, judge, sentences
from fidelis.plans import gate
from fidelis.plans import queries as base
from fidelis.plans.queries import ANCHORS, FINDINGS, LEXICON, PAIRS, Q, TERMS, T, _canon, _measured, _t, _voted, measures, pairs
from fidelis.rules import Finding, near
from fidelis.rules import knee
from fidelis.sources.reports import build_pairs, read_reports, read_verdicts, study_manifest, write_verdicts
from fidelis.streaming.gate import gate_stream, pair_stream

NEAR = [Finding("near", "", [near("the", "of", 12)], [near(r"\band\b", r"\bthe\b", 30)], [near("tion", "was", 5)])]
SYNONYMS = {"that": ["of the"], "tion": ["with a", "ière"], "thea": ["and the"]}
EXPANDED = entities.expand_synonyms(LEXICON, SYNONYMS)
LENIENT = gate.Thresholds(ner_min_recall=0.3, nli_min_entailment_rate=0.05, nli_score_threshold=0.05)
SEMANTIC = gate.Thresholds(ner_min_recall=0.4, nli_min_entailment_rate=0.2)
#: Phrases that the knee rules are about, some of them negated; they are put into texts.
KNEE = [
    "Rotura completa del LCA.", "Rotura parcial del LCA.", "El menisco interno tiene una rotura compleja.", "El menisco interno está intacto.",
    "Edema óseo en la meseta tibial.", "Distensión leve del LCM.", "Condromalacia grado II del cartílago.", "Derrame articular moderado.",
    "Sin derrame.", "Valorar por traumatología la reconstrucción del LCA.", "Basta con reposo y fisioterapia.", "Golpe en los huesos, grado I.",
    "LCM con rotura completa.", "LCM sin rotura completa.", "LCM no rotura completa.", "Grado II del LCM.", "LCM sin grado III.", "Lesión de grado III.", "LCI, no grado II, grado III.",
]


def _scratch(spark: SparkSession) -> str:
    """A folder of our own in the folder that all executors share; it goes when the driver ends."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        shared = "file://" + tempfile.mkdtemp(prefix="fidelis-")
    path = f"{shared}/fidelis-{uuid.uuid4().hex}"
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def a1_reports(spark, sf_dir):
    names = {"report_id": "doc_id", "study_id": "lang", "filename": "source"}
    r = read_reports(spark, f"{sf_dir}/documents.parquet", "parquet", names)
    return r.select("report_id", "study_id", "report_type", "filename", "size_bytes", F.md5(F.col("text").cast("binary")).alias("digest"), F.col("uploaded_at").isNull().alias("no_time"))


def a2_pairs(spark, sf_dir):
    c = _t(spark, sf_dir, "conversations").withColumns({"study_id": F.col("conv_id"), "report_id": F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string"))})
    p = build_pairs(c.filter("role = 'user'"), c.filter("role = 'assistant'"))
    return p.select("study_id", "pair_id", "original_id", "humanized_id", F.md5(F.concat("original_text", "humanized_text").cast("binary")).alias("digest"))


def a3_studies(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    files = li.join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    role = F.when(F.col("l_linenumber") == 1, "ORIGINAL").when(F.col("l_linenumber") == 2, "AMENDMENT").otherwise("HUMANIZED")
    up = files.select(F.col("l_orderkey").alias("study_id"), F.col("o_custkey").alias("dni"), F.floor(F.col("l_extendedprice") * 100).alias("n_bytes"), role.alias("report_type"))
    return study_manifest(up).withColumn("report_types", F.array_join("report_types", ","))


def a4_verdicts(spark, sf_dir):
    """Two runs, the second one written twice with other thresholds; both are read back."""
    path, m = _scratch(spark), measures(spark, sf_dir)
    decided = lambda t: gate.decide(m, t).select("pair_id", "votes", "decision")
    write_verdicts(decided(T), path, "2026-01-01")
    write_verdicts(decided(T).filter("decision = 'REJECT'"), path, "2026-01-02")
    write_verdicts(decided(LENIENT), path, "2026-01-02")
    return read_verdicts(spark, path).groupBy("run", "decision").agg(F.count("*").alias("n"), F.min("pair_id").alias("first_pair"))


def b5_corpus_totals(spark, sf_dir):
    d = _t(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(F.count("*").alias("n_docs"), F.sum(F.length("text")).alias("chars"), F.sum(n_words(F.coalesce("text", F.lit("")))).alias("words"))


def b5_corpus_card(spark, sf_dir):
    c = corpus_card(_t(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    return c.select("doc_id", *[F.col(n).cast("long") for n in ("n_chars", "n_words", "n_sentences")], "szigriszt_pazos", "inflesz_category", "meets_healthcare_target")


def d2_evidence(spark, sf_dir):
    checks = checklist.check_findings(pairs(spark, sf_dir), FINDINGS, "pair_id", "humanized_text", with_evidence=True)
    kinds = ("presence", "correctness", "attenuation")
    return checks.select("pair_id", "finding", *[F.array_join(f"{k}_evidence", "|").alias(k) for k in kinds])


def d6_near(spark, sf_dir):
    checks = checklist.check_findings(_t(spark, sf_dir, "documents"), NEAR, "doc_id")
    return checks.select("doc_id", "mentioned", "correct_matched", "attenuation_detected")


def _knee(spark, sf_dir):
    """Whole documents with two knee phrases put into each: one before its first blank, one at its end."""
    d = _t(spark, sf_dir, "documents").filter("doc_id is not null")
    phrase = lambda at: F.element_at(F.array(*map(F.lit, KNEE)), (F.pmod(at, F.lit(len(KNEE))) + 1).cast("int"))
    text = F.coalesce("text", F.lit(""))
    first = F.substring_index(text, " ", 1)
    rest = F.substring(text, F.length(first) + 1, F.length(text))
    return d.select("doc_id", F.concat(first, F.lit(". "), phrase(F.col("doc_id")), rest, F.lit(". "), phrase(F.floor(F.col("doc_id") / len(KNEE)) + F.length(text))).alias("text"))


def d7_knee_rules(spark, sf_dir):
    checks = checklist.check_findings(_knee(spark, sf_dir), knee.FINDINGS, "doc_id")
    return checks.select("doc_id", "finding", "mentioned", "correct_matched", "severity_preserved", "attenuation_detected")


def e2_synonyms(spark, sf_dir):
    p = pairs(spark, sf_dir)
    return p.select("pair_id", F.array_join(entities.canonicals(F.col("humanized_text"), EXPANDED), ",").alias("canonicals"))


def e3_knee_lexicon(spark, sf_dir):
    k = _knee(spark, sf_dir).select("doc_id", searched(F.col("text"), knee.LEXICON).alias("text"))
    return k.select("doc_id", F.array_join(entities.canonicals(F.col("text"), knee.LEXICON), ",").alias("canonicals"))


def e6_external(spark, sf_dir):
    d = _t(spark, sf_dir, "documents").filter("doc_id is not null")
    at = F.instr("text", "tion") - 1
    far = F.col("doc_id") % 3 == 0
    spans = d.select("doc_id", F.when(far, F.length("text") + 5).otherwise(at).cast("int").alias("start"), F.when(far, F.length("text") + 9).otherwise(at + 6).cast("int").alias("end"),
                     F.when(F.col("doc_id") % 2 == 0, " Ménisque  Interne ").otherwise("").alias("word"), F.when(F.col("doc_id") % 5 == 0, "ANAT").otherwise("X").alias("entity_group"))
    found = entities.external_entities(spans, d.select("doc_id", "text"), {"ANAT": "ANATOMIA"}, "doc_id")
    return found.select("doc_id", "canonical", "entity_type", "surface")


def f3_best_premise(spark, sf_dir):
    v = sentences.sentence_verdicts(pairs(spark, sf_dir), LEXICON, 0.10)
    reason = F.when(F.col("skip_reason") == sentences.SHORT, "short").when(F.col("skip_reason") == sentences.PLAIN, "plain")
    return v.select("pair_id", F.col("pos").cast("long").alias("pos"), "sentence", reason.alias("skipped"), F.round("score", 6).alias("score"), "best_premise", "entailed")


def f5_unsupported(spark, sf_dir):
    u = sentences.unsupported_sentences(sentences.sentence_verdicts(pairs(spark, sf_dir), LEXICON, 0.10), 5)
    return u.select("pair_id", F.col("rank").cast("long").alias("rank"), "sentence")


def _contradiction(premise: pd.Series, hypothesis: pd.Series) -> pd.Series:
    return (hypothesis.str.len() * 7 + premise.str.len() * 13) % 100 / 100.0


def f9_scorer(spark, sf_dir):
    p = pairs(spark, sf_dir)
    met, _ = sentences.contradiction_candidates(sentence_rows(p, "humanized_text", "pair_id", "original_id"), sentence_rows(p, "original_text", "original_id"), ANCHORS)
    scored = sentences.score_with(met, _contradiction)
    by_table = sentences.score_with(met, scored.filter("prem_pos = 0").select("pair_id", F.col("pos").alias("hyp_pos"), "prem_pos", "contradiction"))
    sums = lambda d, n: d.groupBy("pair_id").agg(F.count("*").alias("n"), F.round(F.sum("contradiction"), 4).alias(n))
    return sums(scored, "by_scorer").join(sums(by_table, "by_table").drop("n"), "pair_id")


def g1_requests(spark, sf_dir):
    r = judge.judge_requests(pairs(spark, sf_dir), TERMS)
    return r.select("pair_id", F.length("message").cast("long").alias("n_chars"), F.md5(F.col("message").cast("binary")).alias("digest"))


def h2_modes(spark, sf_dir):
    p = pairs(spark, sf_dir)
    n, m = F.length("humanized_text"), F.length("original_text")
    contradictions = p.filter(n % 3 == 0).select("pair_id", (n % 2).cast("long").alias("n_contradictions"))
    verdicts = p.filter(m % 4 == 0).select("pair_id", F.when(n % 5 < 3, "PASS").otherwise("FAIL").alias("verdict"), (n % 3).alias("n_preserved"), F.lit(1).alias("n_simplified"),
                                           (m % 2).alias("n_omitted"), F.lit(0).alias("n_attenuated"), (n % 2).alias("n_hallucinated"), F.lit(5).alias("n_findings"))
    d = gate.decide(measures(spark, sf_dir), T, contradictions, verdicts)
    return d.select("pair_id", "nli_mode", "nli_passed", F.col("votes").cast("long").alias("votes"), "decision", F.round("rate", 4).alias("rate"), F.col("unsupported").cast("long").alias("unsupported"))


def h5_backends(spark, sf_dir):
    m = measures(spark, sf_dir)
    c = gate.compare_backends(gate.decide(m, T), gate.decide(m.filter("n_sentences > 3"), SEMANTIC))
    return c.select("pair_id", "lexical_decision", F.col("semantic_votes").cast("long").alias("semantic_votes"), "semantic_decision", "change")


def h6_overall(spark, sf_dir):
    labels = _t(spark, sf_dir, "labels").select(F.col("doc_id").cast("string").alias("pair_id"), F.when(F.col("quality") == 1, 0).alias("expected"))
    docs = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("pair_id"), F.regexp_count("text", F.lit("!!")).cast("int").alias("n"))
    return gate.expectations_met(gate.expected_vs_actual(docs, labels))


def _verdicts(spark, sf_dir):
    return gate.evaluate_pairs(pairs(spark, sf_dir), FINDINGS, LEXICON, T)


def h7_decision_report(spark, sf_dir):
    r = gate.decision_report(_verdicts(spark, sf_dir), "inflesz_category")
    means = [F.round(c, p).alias(c) for c, p in (("mean_recall", 3), ("mean_rate", 3), ("mean_inflesz", 1))]
    return r.select("inflesz_category", "decision", "n", "n_checklist", "n_ner", "n_nli", *means)


def i2_audit(spark, sf_dir):
    o, li = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "lineitem")
    uploads = o.select(F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").alias("ts"), F.lit("upload").alias("event"), F.col("o_orderstatus").alias("detail"))
    reports = li.select(F.col("l_orderkey").alias("study_id"), F.col("l_shipdate").cast("timestamp").alias("ts"), F.lit("report").alias("event"), F.col("l_linenumber").alias("line"))
    log = delivery.audit_trail(uploads, reports)
    return log.select("study_id", F.date_format("ts", "yyyy-MM-dd").alias("on_day"), "event", "detail", F.col("line").cast("long").alias("line"))


def j1_stream(spark, sf_dir):
    """The gate over a stream in which a turn and the one before it never arrive together.

    The conversations are laid out as seven files or more by turn, which a micro-batch takes one of at a time.
    """
    path = _scratch(spark)
    at = F.timestamp_seconds((F.col("turn") + 1_000_000) * 60)
    name = lambda t: F.concat_ws("-", F.col("conv_id").cast("string"), t.cast("string"))
    turns = _t(spark, sf_dir, "conversations").filter("conv_id is not null and turn is not null").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"), at.alias("uploaded_at"))
    turns.repartitionByRange(7, "turn").write.parquet(f"{path}/turns")
    arriving = lambda: spark.readStream.schema(turns.schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/turns")
    report = lambda d, t: d.select(name(t).alias("study_id"), F.col("turn").cast("string").alias("report_id"), "text", "uploaded_at")
    met = pair_stream(report(arriving(), F.col("turn")), report(arriving(), F.col("turn") - 1), late="1 hour", wait="1 hour")
    gate_stream(met, FINDINGS, LEXICON, f"{path}/out", f"{path}/state", T).awaitTermination()
    return read_verdicts(spark, f"{path}/out", level="batch").groupBy("routed", "decision").agg(F.count("*").alias("n"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        a1_reports, a2_pairs, a3_studies, a4_verdicts, b5_corpus_totals, b5_corpus_card, d2_evidence, d6_near, d7_knee_rules, e2_synonyms, e3_knee_lexicon, e6_external,
        f3_best_premise, f5_unsupported, f9_scorer, g1_requests, h2_modes, h5_backends, h6_overall, h7_decision_report, i2_audit, j1_stream,
    )
}


#: A pattern's look-behind, and the same as a group: what must not come before, and what follows.
BEHIND = r"(?<!sin\s)(?<!no\s)"


def _plain(pattern: str) -> str:
    """A pattern without look-around, for texts that ``_masked`` has gone over; ``(?!I)`` before a boundary says nothing new."""
    return pattern.replace(BEHIND, "").replace("(?!I)", "")


def _masked(text: str, patterns: list[str]) -> str:
    """``text`` without what a pattern's look-behind keeps it from matching."""
    for pattern in patterns:
        if BEHIND in pattern:
            after = re.match(r"\(\?:(?:[^()]|\([^()]*\))*\)\\b", pattern.split(BEHIND, 1)[1])[0]
            text = f"regexp_replace({text}, {Q(r'(?is)(sin|no)\s' + after)}, '\\1', 'g')"
    return text


def _any(text: str, patterns: list[str]) -> str:
    return "(" + " OR ".join(base._has(_masked(text, [p]), _plain(p)) for p in patterns) + ")" if patterns else "false"


def _canonicals(text: str, lexicon) -> str:
    tests = ", ".join(f"CASE WHEN {_any(text, t.patterns)} THEN {Q(t.canonical)} END" for t in lexicon)
    return f"array_to_string(list_filter([{tests}], lambda x: x IS NOT NULL), ',')"


def _seen(patterns: list[str]) -> str:
    found = "list_concat(" + ", ".join(f"regexp_extract_all(h, {Q('(?is)' + p)})" for p in patterns) + ")" if len(patterns) > 1 else f"regexp_extract_all(h, {Q('(?is)' + patterns[0])})"
    tidy = f"list_transform({found}, lambda m: trim(regexp_replace(m, '\\s+', ' ', 'g')))"
    return f"array_to_string(list_filter({tidy}, lambda x, i: list_position({tidy}, x) = i)[1:3], '|')"


_KNEE_SQL = f"""knee AS (SELECT doc_id, f || '. ' || p[doc_id % {len(KNEE)} + 1] || x[length(f) + 1:] || '. ' || p[(doc_id // {len(KNEE)} + length(x)) % {len(KNEE)} + 1] AS t
 FROM (SELECT doc_id, coalesce(text, '') AS x, split_part(coalesce(text, ''), ' ', 1) AS f FROM documents WHERE doc_id IS NOT NULL), (SELECT [{', '.join(map(Q, KNEE))}] AS p))"""
_BEST = f"""WITH {base.VERDICT_CTE}, pt AS (SELECT pair_id, pos, trim(s) AS s, {base.WORDS.format('s')} AS w FROM ps),
 ranked AS (SELECT g.pair_id, g.pos, pt.s, row_number() OVER (PARTITION BY g.pair_id, g.pos ORDER BY len(list_intersect(g.w, pt.w)) DESC, pt.pos) AS k, len(list_intersect(g.w, pt.w)) AS b
  FROM g JOIN pt USING (pair_id) WHERE r IS NULL),
 full_v AS (SELECT v.pair_id, v.pos, trim(hs.s) AS sentence, v.r, v.score, CASE WHEN ranked.b > 0 THEN ranked.s ELSE '' END AS premise
  FROM v JOIN hs USING (pair_id, pos) LEFT JOIN ranked ON ranked.pair_id = v.pair_id AND ranked.pos = v.pos AND k = 1)"""
_MEAS = _measured() + f""", texts AS (SELECT * FROM pairs), read AS (SELECT pair_id, floor({base.SP} * 100 + 0.5) / 100.0 AS sp, {base.BAND} AS band FROM ({base.MEASURED} FROM (SELECT pair_id, {base._markdown().replace('text', 'h')} AS t FROM pairs)))"""
_NEAR = {k: _any("t", getattr(NEAR[0], k)) for k in ("presence", "correctness", "attenuation")}

ORACLE_SQL: dict[str, str] = {
    "a1_reports": "SELECT doc_id::VARCHAR AS report_id, lang AS study_id, CASE WHEN source IS NULL THEN 'HUMANIZED' WHEN regexp_matches(source, '(?i)original') THEN 'ORIGINAL' WHEN regexp_matches(source, '(?i)amendment|adenda') THEN 'AMENDMENT' ELSE 'HUMANIZED' END AS report_type, source AS filename, strlen(text) AS size_bytes, md5(text) AS digest, true AS no_time FROM documents",
    "a2_pairs": "SELECT a.conv_id AS study_id, a.conv_id || ':' || a.turn || '/' || b.conv_id || ':' || b.turn AS pair_id, a.conv_id || ':' || a.turn AS original_id, b.conv_id || ':' || b.turn AS humanized_id, md5(a.text || b.text) AS digest FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.role = 'user' AND b.role = 'assistant'",
    "a3_studies": "SELECT l_orderkey AS study_id, count(*) AS n_files, sum(b)::BIGINT AS size_bytes, greatest(1, sum(b) // 524288)::BIGINT AS n_instances, 'folder-' || any_value(o_custkey) AS folder_id, string_agg(DISTINCT r, ',' ORDER BY r) AS report_types FROM (SELECT l_orderkey, o_custkey, floor(l_extendedprice * 100)::BIGINT AS b, CASE l_linenumber WHEN 1 THEN 'ORIGINAL' WHEN 2 THEN 'AMENDMENT' ELSE 'HUMANIZED' END AS r FROM lineitem JOIN orders ON l_orderkey = o_orderkey) GROUP BY l_orderkey",
    "a4_verdicts": f"{_measured()} SELECT '2026-01-01' AS run, decision, count(*) AS n, min(pair_id) AS first_pair FROM {_voted(T)} GROUP BY decision UNION ALL SELECT '2026-01-02', decision, count(*), min(pair_id) FROM {_voted(LENIENT)} GROUP BY decision",
    "b5_corpus_totals": f"SELECT lang, count(*) AS n_docs, sum(length(text))::BIGINT AS chars, sum({base.NWORDS.format('text')})::BIGINT AS words FROM documents GROUP BY lang",
    "b5_corpus_card": f"SELECT doc_id, n_chars, w AS n_words, s AS n_sentences, floor({base.SP} * 100 + 0.5) / 100.0 AS szigriszt_pazos, {base.BAND} AS inflesz_category, {base.SP} >= 55 AS meets_healthcare_target FROM ({base.MEASURED} FROM (SELECT doc_id, length(text) AS n_chars, coalesce({base._markdown()}, '') AS t FROM documents))",
    "d2_evidence": f"WITH {PAIRS} " + " UNION ALL ".join(f"SELECT pair_id, {Q(f.name)} AS finding, {_seen(f.presence)} AS presence, {_seen(f.correctness)} AS correctness, {_seen(f.attenuation)} AS attenuation FROM pairs" for f in FINDINGS),
    "d6_near": f"SELECT doc_id, {_NEAR['presence']} AS mentioned, {_NEAR['correctness']} AS correct_matched, {_NEAR['attenuation']} AS attenuation_detected FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents)",
    "d7_knee_rules": f"WITH {_KNEE_SQL} SELECT doc_id, finding, m AS mentioned, c AS correct_matched, CASE WHEN opt THEN (m AND NOT a) OR c ELSE c END AS severity_preserved, a AS attenuation_detected FROM ("
    + " UNION ALL ".join(f"SELECT doc_id, {Q(f.name)} AS finding, {str(f.severity_optional).lower()} AS opt, {_any('t', f.presence)} AS m, {_any('t', f.correctness)} AS c, {_any('t', f.attenuation)} AS a FROM knee" for f in knee.FINDINGS) + ")",
    "e2_synonyms": f"WITH {PAIRS} SELECT pair_id, {_canonicals('h', EXPANDED)} AS canonicals FROM pairs",
    "e3_knee_lexicon": f"WITH {_KNEE_SQL} SELECT doc_id, {_canonicals('t', knee.LEXICON)} AS canonicals FROM knee",
    "e6_external": """WITH s AS (SELECT doc_id, text, CASE WHEN doc_id % 3 = 0 THEN length(text) + 5 ELSE instr(text, 'tion') - 1 END AS a, CASE WHEN doc_id % 3 = 0 THEN length(text) + 9 ELSE instr(text, 'tion') + 5 END AS b,
 CASE WHEN doc_id % 2 = 0 THEN ' Ménisque  Interne ' ELSE '' END AS w, CASE WHEN doc_id % 5 = 0 THEN 'ANATOMIA' ELSE 'HALLAZGO' END AS entity_type FROM documents WHERE doc_id IS NOT NULL),
 f AS (SELECT doc_id, entity_type, trim(CASE WHEN a >= 0 AND b > a AND b <= length(text) THEN substr(text, (a + 1)::BIGINT, (b - a)::BIGINT) ELSE w END, ' ') AS surface FROM s)
 SELECT doc_id, trim(regexp_replace(strip_accents(lower(surface)), '\\s+', ' ', 'g')) AS canonical, entity_type, surface FROM f WHERE surface <> ''""",
    "f3_best_premise": f"{_BEST} SELECT pair_id, (pos - 1)::BIGINT AS pos, sentence, r AS skipped, round(score, 6) AS score, premise AS best_premise, r IS NOT NULL OR score >= 0.10 AS entailed FROM full_v",
    "f5_unsupported": f"{_BEST} SELECT pair_id, k AS rank, sentence FROM (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY pos) AS k FROM full_v WHERE r IS NULL AND score < 0.10) WHERE k <= 5",
    "f9_scorer": f"WITH {base.SENTENCE_CTE}, ha AS (SELECT *, {_canon('s', ANCHORS)} AS e FROM hs), pa AS (SELECT *, {_canon('s', ANCHORS)} AS e FROM ps), m AS (SELECT ha.pair_id, pa.pos, (length(trim(ha.s)) * 7 + length(trim(pa.s)) * 13) % 100 / 100.0 AS c FROM ha JOIN pa ON ha.pair_id = pa.pair_id AND len(list_intersect(ha.e, pa.e)) > 0) SELECT pair_id, count(*) AS n, round(sum(c), 4) AS by_scorer, round(coalesce(sum(c) FILTER (pos = 1), 0), 4) AS by_table FROM m GROUP BY pair_id",
    "g1_requests": f"WITH {PAIRS}, r AS (SELECT pair_id, 'ORIGINAL:' || chr(10) || o || chr(10) || chr(10) || 'REWRITE:' || chr(10) || h || chr(10) || chr(10) || 'FINDINGS:' || chr(10) || {Q('|'.join('- ' + t for t in TERMS))} AS m FROM pairs) SELECT pair_id, length(replace(m, '|- ', chr(10) || '- ')) AS n_chars, md5(m2) AS digest FROM (SELECT pair_id, m, left(m, length(m) - length({Q('|'.join('- ' + t for t in TERMS))})) || {Q('- ' + TERMS[0])} || " + " || ".join(f"chr(10) || {Q('- ' + t)}" for t in TERMS[1:]) + " AS m2 FROM r)",
    "h2_modes": f"""{_measured()}, j AS (SELECT pair_id, length(h) AS n, length(o) AS m FROM pairs),
 l AS (SELECT pair_id, c, recall >= {T.ner_min_recall} AS ner, rate, u, n, m % 4 = 0 AS is_j, n % 3 = 0 AS is_c, m FROM meas JOIN j USING (pair_id)),
 x AS (SELECT *, CASE WHEN is_j THEN 'judge' WHEN is_c THEN 'contradiction' ELSE 'entailment' END AS nli_mode,
  CASE WHEN is_j THEN n % 5 < 3 WHEN is_c THEN n % 2 <= 0 ELSE rate >= {T.nli_min_entailment_rate} AND u <= {T.nli_max_hallucinations} END AS p FROM l)
 SELECT pair_id, nli_mode, p AS nli_passed, (c::INT + ner::INT + p::INT)::BIGINT AS votes, CASE c::INT + ner::INT + p::INT WHEN 3 THEN 'APPROVE' WHEN 2 THEN 'REVIEW' ELSE 'REJECT' END AS decision,
  round(CASE WHEN is_j THEN (n % 3 + 1) / 5.0 ELSE rate END, 4) AS rate, (CASE WHEN is_j THEN m % 2 + n % 2 ELSE u END)::BIGINT AS unsupported FROM x""",
    "h5_backends": f"""{_measured()}, lex AS (SELECT * FROM {_voted(T)}), sem AS (SELECT * FROM {_voted(SEMANTIC)}), n AS (SELECT pair_id, n_sentences > 3 AS has FROM rep),
 x AS (SELECT lex.pair_id, lex.votes AS lv, lex.decision AS lexical_decision, CASE WHEN has THEN sem.votes ELSE lex.votes END AS sv FROM lex JOIN sem USING (pair_id) JOIN n USING (pair_id))
 SELECT pair_id, lexical_decision, sv::BIGINT AS semantic_votes, CASE sv WHEN 3 THEN 'APPROVE' WHEN 2 THEN 'REVIEW' ELSE 'REJECT' END AS semantic_decision,
  CASE WHEN greatest(sv, 1) > greatest(lv, 1) THEN 'upgraded' WHEN greatest(sv, 1) = greatest(lv, 1) THEN 'same' ELSE 'other' END AS change FROM x""",
    "h6_overall": "SELECT count(*) AS n_pairs, count(*) FILTER (ok) AS n_ok, count(*) = count(*) FILTER (ok) AS overall_ok FROM (SELECT CASE WHEN quality = 1 THEN n = 0 ELSE n >= 1 END AS ok FROM (SELECT quality, len(regexp_extract_all(text, '!!')) AS n FROM documents JOIN labels USING (doc_id)))",
    "h7_decision_report": f"{_MEAS} SELECT band AS inflesz_category, decision, count(*) AS n, count(*) FILTER (c) AS n_checklist, count(*) FILTER (n) AS n_ner, count(*) FILTER (l) AS n_nli, round(round(avg(round(rc, 4)), 4), 3) AS mean_recall, round(round(avg(round(rt, 4)), 4), 3) AS mean_rate, round(round(avg(sp), 2), 1) AS mean_inflesz FROM (SELECT y.*, read.band, read.sp, meas.recall AS rc, meas.rate AS rt FROM {_voted(T)} y JOIN read USING (pair_id) JOIN meas USING (pair_id)) GROUP BY ROLLUP (band, decision)",
    "i2_audit": "SELECT o_orderkey AS study_id, strftime(o_orderdate, '%Y-%m-%d') AS on_day, 'upload' AS event, o_orderstatus AS detail, NULL::BIGINT AS line FROM orders UNION ALL SELECT l_orderkey, strftime(l_shipdate, '%Y-%m-%d'), 'report', NULL, l_linenumber::BIGINT FROM lineitem",
    "j1_stream": f"{_measured()} SELECT CASE WHEN decision = 'REJECT' THEN 'blocked' ELSE 'accepted' END AS routed, decision, count(*) AS n FROM {_voted(T)} GROUP BY ALL",
}

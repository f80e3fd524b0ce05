"""Operators of the report-fidelity jobs against plain Python, and their less common ways."""

import random

import pytest
from pyspark.sql import functions as F

from fidelis.operators import delivery
from fidelis.operators import sentences as fidelity
from fidelis.plans import gate
from fidelis.rules import Term
from fidelis.sources.reports import read_reports, write_verdicts

PAIRS = "pair_id string, original_id string, original_text string, humanized_text string"


@pytest.fixture(scope="module")
def pairs(spark):
    rng = random.Random(3)
    words = [a + b + c for a in ("ro", "me", "li", "ca") for b in ("do", "ni", "sta") for c in ("lar", "men", "tic")]
    text = lambda n: " ".join(" ".join(rng.choice(words) for _ in range(rng.randint(2, 9))).capitalize() + "." for _ in range(n))
    originals = [text(rng.randint(0, 12)) for _ in range(6)]
    rows = [(f"p{i}", f"o{i % 6}", originals[i % 6], text(rng.randint(0, 9))) for i in range(40)]
    rows += [("same", "o1", originals[1], originals[1]), ("none", "x", None, None), ("blank", "y", "", " \n ")]
    return spark.createDataFrame(rows, PAIRS)


@pytest.mark.parametrize("lexicon", [None, [Term("lar", "ANATOMIA", ["lar"])]])
def test_support_within_the_row_equals_the_join(pairs, lexicon):
    joined = fidelity.entailment_report(fidelity.sentence_verdicts(pairs, lexicon, 0.4, texts=False), pairs)
    inline = fidelity.with_support(pairs, lexicon, 0.4)
    columns = ["pair_id", "n_sentences", "n_assessed", "n_entailed", "n_unsupported", "entailment_rate"]
    one, other = ({r["pair_id"]: tuple(r) for r in d.select(*columns).collect()} for d in (joined, inline))
    assert one == other and len(one) == 43 and one["none"][1:] == (0, 0, 0, 0, 1.0) and one["same"][5] == 1.0


def test_scores_equal_the_overlap_table(pairs):
    """The packed aggregate against the plain join, its best premise and the first of equals."""
    hyp = fidelity.sentence_gate(fidelity.sentence_words(pairs, "humanized_text", "pair_id", "original_id"), None).filter("skip_reason is null")
    prem = fidelity.sentence_words(pairs.dropDuplicates(["original_id"]), "original_text", "original_id")
    want = {(r["pair_id"], r["pos"]): (pytest.approx(r["score"]), r["prem_pos"]) for r in fidelity.best_premise(fidelity.overlap_scores(hyp, prem)).collect()}
    got = fidelity.sentence_scores(pairs, None).filter("skip_reason is null").collect()
    assert {(r["pair_id"], r["pos"]): (r["score"], r["prem_pos"]) for r in got if r["prem_pos"] is not None} == want
    assert all(r["score"] == 0 for r in got if r["prem_pos"] is None)


def test_measured_once(pairs):
    """A profile more copies rows; it doesn't measure again."""
    m = gate.measure_pairs(pairs, [], [Term("lar", "ANATOMIA", ["lar"])])
    plan = gate.sweep_thresholds(m, {str(k): gate.Thresholds(ner_min_recall=k / 5) for k in range(5)})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Scan") == m._jdf.queryExecution().executedPlan().toString().count("Scan") and "Exchange" not in plan


def test_scorer_sees_every_couple_once(spark):
    rows = [("p", "o", 0, "uno dos", 0, "tres"), ("q", "o", 0, "uno dos", 0, "tres"), ("p", "o", 1, "cuatro", 0, "tres")]
    c = spark.createDataFrame(rows, "pair_id string, original_id string, pos int, sentence string, prem_pos int, premise string")
    got = fidelity.score_with(c, lambda premise, sentence: (premise.str.len() + sentence.str.len()) / 100.0)
    assert sorted((r["pair_id"], r["pos"], r["contradiction"]) for r in got.collect()) == [("p", 0, 0.11), ("p", 1, 0.1), ("q", 0, 0.11)]


def test_modes_go_judge_first(spark):
    m = spark.createDataFrame([(k, True, 0.9, 0.5, 0) for k in "abc"], "pair_id string, overall_pass boolean, recall double, entailment_rate double, n_unsupported int")
    judged = spark.createDataFrame([("a", "FAIL", 1, 1, 1, 0, 0, 3)], "pair_id string, verdict string, n_preserved int, n_simplified int, n_omitted int, n_attenuated int, n_hallucinated int, n_findings int")
    contra = spark.createDataFrame([("a", 0), ("b", 2)], "pair_id string, n_contradictions int")
    got = {r["pair_id"]: (r["nli_mode"], r["nli_passed"], r["votes"], r["unsupported"]) for r in gate.decide(m, contradictions=contra, judge=judged).collect()}
    assert got == {"a": ("judge", False, 2, 1), "b": ("contradiction", False, 2, 0), "c": ("entailment", True, 3, 0)}


def test_expectations_and_reports(spark, pairs):
    checked = gate.expected_vs_actual(spark.createDataFrame([("a", 0), ("b", 3)], "pair_id string, n int"), spark.createDataFrame([("a", 0), ("b", None)], "pair_id string, expected int"))
    assert tuple(gate.expectations_met(checked).first()) == (2, 2, True)
    v = gate.evaluate_pairs(pairs, [], [Term("lar", "ANATOMIA", ["lar"])])
    report = gate.decision_report(v).collect()
    assert sum(r["n"] for r in report if r["decision"] is not None) == 43 and all(r["mean_inflesz"] is not None for r in report)


def test_verdicts_are_written_by_decision(spark, tmp_path):
    df = spark.createDataFrame([("a", "APPROVE"), ("b", "REJECT")], "pair_id string, decision string")
    write_verdicts(df, str(tmp_path / "v"))
    assert {p.name for p in (tmp_path / "v").iterdir() if p.is_dir()} == {"decision=APPROVE", "decision=REJECT"}


def test_reports_from_tables_and_files(spark, tmp_path):
    spark.createDataFrame([(7, "hola", "x_adenda.pdf")], "id long, body string, filename string").write.parquet(str(tmp_path / "t"))
    r = read_reports(spark, str(tmp_path / "t"), "parquet", {"report_id": "id", "text": "body"}).first()
    assert (r["report_id"], r["report_type"], r["size_bytes"], r["study_id"]) == ("7", "AMENDMENT", 4, None)
    (tmp_path / "study").mkdir()
    (tmp_path / "study" / "a_Original.md").write_text("línea uno\nlínea dos", encoding="utf-8")
    r = read_reports(spark, str(tmp_path / "study")).first()
    assert (r["report_id"], r["study_id"], r["report_type"], r["size_bytes"], r["text"]) == ("a_Original", "study", "ORIGINAL", 21, "línea uno\nlínea dos")


def test_option_enums(spark):
    rows = spark.createDataFrame([("es", "formal_usted", "ESO"), ("fr", "rude", None)], "target_language string, tone string, reading_level string")
    assert [r["violations"] for r in delivery.check_constraints(rows).collect()] == [[], ["target_language_enum", "tone_enum"]]


def test_batches_are_routed(spark, tmp_path, pairs):
    from fidelis.streaming.gate import gate_stream

    pairs.withColumn("original_text", F.lit("La rodilla duele")).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAIRS).parquet(str(tmp_path / "in"))
    gate_stream(stream, [], [Term("lar", "ANATOMIA", ["lar"])], str(tmp_path / "out"), str(tmp_path / "cp"), require_approve=True).awaitTermination(120)
    out = spark.read.parquet(str(tmp_path / "out/batch=0"))
    assert out.count() == 43 and out.filter("(routed = 'accepted') <> (decision = 'APPROVE')").count() == 0

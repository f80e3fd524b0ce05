import datetime

import pytest
from pyspark.sql import functions as F

from fidelis.functions.readability import inflesz_band, readability
from fidelis.functions.text import content_words, normalize_surface, sentences, strip_markdown_col
from fidelis.operators import checklist, delivery, entities, judge
from fidelis.operators import sentences as fidelity
from fidelis.plans import gate
from fidelis.rules import Finding, Term, near
from fidelis.rules.knee import FINDINGS, LEXICON, SYNONYMS
from fidelis.sources.reports import build_pairs, ingest_manifest

PAIRS = "pair_id string, original_id string, original_text string, humanized_text string"


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "text string").select(column(F.col("text")).alias("x")).first()["x"]


def test_markdown_goes_and_content_stays(spark):
    out = one(spark, "# Título\n\n- **rotura** del *LCA*\n\n| a | b |\n|---|---|\n\n\n\nfin `x` [enlace](u) <b>y</b>", strip_markdown_col)
    assert "#" not in out and "**" not in out and "|" not in out and "\n\n\n" not in out
    assert "rotura del LCA" in out and "enlace y" in out
    assert one(spark, None, strip_markdown_col) is None and one(spark, "", strip_markdown_col) == ""


def test_sentences_keep_abbreviations_and_drop_short_ones(spark):
    text = "El Dr. Pérez ve una rotura. No. ¿Hay algo más que ver? Sí hay más cosas.\n\nOtro párrafo con\nvarias líneas"
    assert one(spark, text, sentences) == ["El Dr. Pérez ve una rotura.", "¿Hay algo más que ver?", "Sí hay más cosas.", "Otro párrafo con varias líneas"]
    assert one(spark, None, sentences) == []


def test_words_and_surfaces_are_folded(spark):
    assert sorted(one(spark, "La Rótula y el LCA, la rótula abc1 de él", content_words)) == ["lca", "rotula"]
    assert one(spark, "  Cóndilo \n FEMORAL ", normalize_surface) == "condilo femoral"


def test_readability(spark):
    df = spark.createDataFrame([("a", "La rodilla duele mucho. El paciente no puede andar bien."), ("b", None), ("c", "")], "report_id string, text string")
    rows = {r["report_id"]: r for r in readability(df).collect()}
    assert rows["a"]["n_words"] == 10 and rows["a"]["n_sentences"] == 2 and rows["a"]["szigriszt_pazos"] > 55 and rows["a"]["meets_healthcare_target"]
    assert rows["b"]["szigriszt_pazos"] == rows["c"]["szigriszt_pazos"] == 0.0
    bands = spark.createDataFrame([(39.9,), (40.0,), (64.9,), (80.0,)], "x double").select(inflesz_band(F.col("x")).alias("b")).collect()
    assert [b["b"][:5] for b in bands] == ["muy d", "algo ", "norma", "muy f"]


def test_checklist_policies(spark):
    rules = [Finding("x", "", ["alfa"], ["beta"], ["gama"], severity_optional=True), Finding("y", "", ["delta"], ["beta"], ["gama"])]
    df = spark.createDataFrame([("1", "ALFA delta"), ("2", "alfa delta beta"), ("3", "gama"), ("4", None)], "pair_id string, text string")
    checks = checklist.check_findings(df, rules, with_evidence=True)
    status = {(r["pair_id"], r["finding"]): r["status"] for r in checks.collect()}
    s = checklist.STATUS
    assert [status[p, f] for p in "1234" for f in "xy"] == [s["ok"], s["wrong_severity"], s["ok"], s["ok"], s["attenuated"], s["attenuated"], s["omitted"], s["omitted"]]
    summary = {r["pair_id"]: r for r in checklist.checklist_summary(checks).collect()}
    assert summary["2"]["overall_pass"] and not summary["1"]["overall_pass"]
    assert (summary["3"]["n_attenuated"], summary["3"]["n_omitted"]) == (2, 2)  # both counters
    assert checks.filter("pair_id = '1' and finding = 'x'").first()["presence_evidence"] == ["ALFA"]


def test_near_is_bounded_and_either_way(spark):
    rule = [Finding("n", "", [near("uno", "dos", 5)], [], [])]
    df = spark.createDataFrame([("a", "uno y dos"), ("b", "dos uno"), ("c", "uno muy lejos de dos"), ("d", "uno. dos")], "pair_id string, text string")
    assert {r["pair_id"]: r["mentioned"] for r in checklist.check_findings(df, rule).collect()} == {"a": True, "b": True, "c": False, "d": False}


def test_knee_rules(spark):
    faithful = "Rotura completa del LCA. Rotura del menisco interno, grado III. Edema óseo. Distensión del LCM. Condromalacia grado II. Derrame moderado. Valorar por traumatología el tratamiento del menisco."
    weak = "Rotura parcial del LCA. El menisco interno está intacto. Edema óseo."
    df = spark.createDataFrame([("f", faithful), ("w", weak)], "pair_id string, text string")
    got = {r["pair_id"]: r for r in checklist.checklist_summary(checklist.check_findings(df, FINDINGS)).collect()}
    assert got["f"]["overall_pass"] and got["f"]["n_findings"] == 7
    assert got["w"]["n_attenuated"] == 2 and got["w"]["n_omitted"] == 4


def test_entities_overlap_and_synonyms(spark):
    lexicon = entities.expand_synonyms(LEXICON, SYNONYMS)
    df = spark.createDataFrame([("a", "ligamento cruzado anterior"), ("b", "ligamento cruzado posterior"), ("c", "ACUMULACIÓN DE LÍQUIDO en la RÓTULA"), ("d", None)], "report_id string, text string")
    m = entities.extract_entities(df, lexicon).collect()
    assert sum(r["report_id"] == "a" and r["canonical"] == "LCA" for r in m) == 3
    assert {r["canonical"] for r in m if r["report_id"] == "b"} == {"LCA", "LCP"}
    assert {r["canonical"] for r in m if r["report_id"] == "c"} == {"derrame", "rotula"}
    inline = {r["report_id"]: set(r["c"]) for r in df.select("report_id", entities.canonicals(F.col("text"), lexicon).alias("c")).collect()}
    assert inline == {"a": {"LCA"}, "b": {"LCA", "LCP"}, "c": {"derrame", "rotula"}, "d": set()}


def test_recall_edges(spark):
    df = spark.createDataFrame([("a", ["x", "y"], ["y", "z"]), ("b", [], ["z"]), ("c", ["x"], [])], "pair_id string, original_entities array<string>, humanized_entities array<string>")
    got = {r["pair_id"]: (r["recall"], r["omitted"], r["added"]) for r in entities.entity_recall(df).collect()}
    assert got == {"a": (0.5, ["x"], ["z"]), "b": (1.0, [], ["z"]), "c": (0.0, ["x"], [])}


def test_external_entities(spark):
    texts = spark.createDataFrame([("a", "la Rótula izquierda")], "report_id string, text string")
    spans = spark.createDataFrame([("a", 3, 9, "x", "ANAT"), ("a", 50, 60, " Menisco ", "?"), ("a", 0, 0, "", "?")], "report_id string, start int, end int, word string, entity_group string")
    got = {(r["canonical"], r["entity_type"]) for r in entities.external_entities(spans, texts, {"ANAT": "ANATOMIA"}).collect()}
    assert got == {("rotula", "ANATOMIA"), ("menisco", "HALLAZGO")}


def test_sentence_verdicts(spark):
    lexicon = [Term("rodilla", "ANATOMIA", [r"\brodilla\b"])]
    original = "La rodilla derecha presenta rotura completa. La rodilla derecha presenta rotura completa antigua."
    rewrite = "La rodilla derecha presenta rotura. Gato perro casa mesa silla. La rodilla baila alegre cantando siempre. Va muy bien."
    pairs = spark.createDataFrame([("p", "o", original, rewrite), ("q", "o", original, "")], PAIRS)
    rows = fidelity.sentence_verdicts(pairs, lexicon, 0.4).orderBy("pos").collect()
    assert [r["skip_reason"] for r in rows] == [None, fidelity.PLAIN, None, fidelity.SHORT]
    assert rows[0]["score"] == 1.0 and rows[0]["best_premise"].endswith("completa.")  # the first of equals
    assert rows[2]["score"] == pytest.approx(1 / 5) and not rows[2]["entailed"]
    report = {r["pair_id"]: r for r in fidelity.entailment_report(fidelity.sentence_verdicts(pairs, lexicon), pairs).collect()}
    assert report["p"]["entailment_rate"] == 0.5 and report["q"]["entailment_rate"] == 1.0 and report["q"]["n_sentences"] == 0


def test_contradictions(spark):
    hyp = spark.createDataFrame([("p", "o", 0, "la rodilla está sana"), ("p", "o", 1, "nada que decir")], "pair_id string, original_id string, pos int, sentence string")
    prem = spark.createDataFrame([("o", 0, "rotura en la rodilla"), ("o", 1, "rodilla inflamada"), ("o", 2, "menisco")], "original_id string, pos int, sentence string")
    met, alone = fidelity.contradiction_candidates(hyp, prem, [Term("rodilla", "ANATOMIA", [r"\brodilla\b"])])
    assert met.count() == 2 and [r["pos"] for r in alone.collect()] == [1]
    scores = spark.createDataFrame([("p", 0, 0, 0.7), ("p", 0, 1, 0.7)], "pair_id string, hyp_pos int, prem_pos int, contradiction double")
    worst = fidelity.worst_premise(fidelity.score_with(met, scores))
    assert worst.first()["prem_pos"] == 0 and worst.first()["contradicts"]
    pairs = hyp.select("pair_id").distinct()
    r = fidelity.contradiction_report(pairs, hyp, worst).first()
    assert (r["n_sentences"], r["n_assessed"], r["n_contradictions"]) == (2, 1, 1)
    r = fidelity.contradiction_report(pairs, hyp, None).first()
    assert (r["n_assessed"], r["backend_supported"]) == (0, False)


def test_judge(spark):
    raws = {
        "ok": '[{"finding":"a","status":"preserved","confidence":0.9,"evidence":"e"},{"finding":"b","status":"simplified"}]',
        "fenced": '```json\n[{"finding":"a","status":"omitted"},{"finding":"b","status":"preserved"}]\n```',
        "lone": 'Here: {"finding":"a","status":"preserved"}', "junk": "no", "odd": '[{"finding":"a","status":"great"},{"finding":"c","status":"preserved","confidence":"x"}]',
    }
    r = spark.createDataFrame([(k, v, 1.0, 2, 3) for k, v in raws.items()], "pair_id string, raw string, latency_s double, input_tokens int, output_tokens int")
    v = judge.complete_judge(judge.parse_judge(r), r, ["a", "b"])
    got = {x["pair_id"]: x for x in judge.judge_report(v, r).collect()}
    assert {k: x["verdict"] for k, x in got.items()} == {"ok": "PASS", "fenced": "FAIL", "lone": "FAIL", "junk": "FAIL", "odd": "FAIL"}
    assert got["junk"]["n_parse_error"] == 2 and got["lone"]["n_parse_error"] == 1 and got["odd"]["n_parse_error"] == 2 and got["odd"]["n_findings"] == 2


def test_gate_votes_modes_and_routes(spark):
    m = spark.createDataFrame(
        [("a", True, 0.9, 0.5, 0), ("b", False, 0.9, 0.5, 0), ("c", False, 0.1, 0.5, 20)], "pair_id string, overall_pass boolean, recall double, entailment_rate double, n_unsupported int"
    )
    d = gate.decide(m)
    assert [r["decision"] for r in d.orderBy("pair_id").collect()] == ["APPROVE", "REVIEW", "REJECT"]
    assert [gate.route(d, strict)[0].count() for strict in (False, True)] == [2, 1]
    contra = spark.createDataFrame([("a", 1)], "pair_id string, n_contradictions int")
    r = gate.decide(m, contradictions=contra).filter("pair_id = 'a'").first()
    assert (r["nli_mode"], r["votes"]) == ("contradiction", 2)
    assert gate.sweep_thresholds(m, {"x": gate.Thresholds(), "y": gate.Thresholds(ner_min_recall=0.95)}).count() == 6
    assert {r["pair_id"]: r["change"] for r in gate.compare_backends(d, d.filter("pair_id = 'a'")).collect()} == {"a": "same", "b": "same", "c": "same"}


def test_identical_pair_is_approved(spark):
    text = "Rotura completa del LCA en la rodilla. Rotura del menisco interno, grado III. Edema óseo. Distensión del LCM. Condromalacia grado II. Derrame moderado. Valorar por traumatología la reconstrucción del LCA."
    v = gate.evaluate_pairs(spark.createDataFrame([("p", "o", text, text)], PAIRS), FINDINGS, LEXICON).first()
    assert (v["decision"], v["ner_recall_global"], v["nli_entailment_rate"]) == ("APPROVE", 1.0, 1.0)


def test_delivery_and_constraints(spark):
    ts = datetime.datetime(2026, 1, 1)
    studies = spark.createDataFrame([("s", ts), ("t", ts)], "study_id string, issued_at timestamp")
    reports = spark.createDataFrame([("s", "o", "ORIGINAL"), ("s", "h", "HUMANIZED"), ("s", "x", "HUMANIZED")], "study_id string, report_id string, report_type string")
    m = {r["study_id"]: r for r in delivery.delivery_manifest(studies, reports, reports.filter("report_id = 'h'")).collect()}
    assert m["s"]["report_ids"] == ["o", "h"] and m["s"]["expires_at"] == datetime.datetime(2026, 1, 8) and m["t"]["error"] == "no report"
    rows = spark.createDataFrame([("M", "2S7B3", 0.5), ("Z", "12", 2.0), (None, None, None)], "sex string, pin string, confidence double")
    assert [r["violations"] for r in delivery.check_constraints(rows).collect()] == [[], ["sex_enum", "confidence_range", "pin_length"], ["pin_length"]]
    log = delivery.audit_trail(studies.select("study_id", F.col("issued_at").alias("ts")), spark.createDataFrame([("s", ts, "x")], "study_id string, ts timestamp, what string"))
    assert log.count() == 3


def test_sources(spark):
    o = spark.createDataFrame([("s", "o", "x")], "study_id string, report_id string, text string")
    h = spark.createDataFrame([("s", "h1", "y"), ("s", "h2", "z"), ("t", "h3", "w")], "study_id string, report_id string, text string")
    assert build_pairs(o, h).count() == 2
    up = spark.createDataFrame([("s", "1Z", 1048580, "ORIGINAL", None)], "study_id string, dni string, n_bytes long, report_type string, filename string")
    r = ingest_manifest(up).first()
    assert (r["n_instances"], r["folder_id"], r["filename"]) == (2, "folder-1Z", "informe_original.pdf")


def test_stream(spark, tmp_path):
    from fidelis.streaming.gate import gate_stream

    spark.createDataFrame([("p", "o", "La rodilla duele", "La rodilla duele")], PAIRS).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(PAIRS).parquet(str(tmp_path / "in"))
    gate_stream(stream, FINDINGS, LEXICON, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out/batch=0")).count() == 1


def test_entry_points(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "h1_gate" in e.queries()

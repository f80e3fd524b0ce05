"""Thresholds read from summaries, long pairs, one-pass mentions, decompositions, runs, streams, levels and uploads."""

import random
import re
import time
import unicodedata
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from fidelis.functions.readability import measures
from fidelis.functions.text import normalize_surface, unmarked
from fidelis.operators import checklist, delivery, entities, sentences
from fidelis.plans import gate
from fidelis.plans.further import KNEE
from fidelis.plans.queries import FINDINGS
from fidelis.rules import Term, knee
from fidelis.sources.reports import committed_runs, ingest_manifest, read_uploads, read_verdicts, study_manifest, write_verdicts
from fidelis.streaming.gate import gate_stream, pair_stream

TOPICS = ["rotura", "menisco", "rodilla", "derrame", "hueso", "edema", "lesion", "cartilago", "condilo", "ligamento", "dolor", "grado"]


def report(rng, n):
    return " ".join(("El " + " ".join(rng.choice(TOPICS) for _ in range(rng.randint(3, 9))) + ".") for _ in range(n))


# ---- thresholds


def test_profiles_honour_their_score_threshold(spark):
    rng = random.Random(1)
    rows = [(str(i), report(rng, 6), report(rng, 5)) for i in range(40)] + [("none", None, None), ("empty", "", "")]
    pairs = spark.createDataFrame(rows, "pair_id string, original_text string, humanized_text string")
    profiles = {f"{s}": gate.Thresholds(nli_score_threshold=s, nli_min_entailment_rate=0.6) for s in (0.1, 0.3, 0.5, 0.7, 1.0)}
    lexicon = [Term("x", "ANATOMIA", ["menisco|rodilla|hueso"])]
    measured = gate.measure_pairs(pairs, FINDINGS, lexicon, 0.10)
    swept = gate.sweep_thresholds(measured, profiles)
    got = {(r["profile"], r["pair_id"]): (r["n_entailed"], r["n_unsupported"], r["decision"]) for r in swept.collect()}
    for name, t in profiles.items():  # each profile measured on its own
        alone = gate.decide(gate.measure_pairs(pairs, FINDINGS, lexicon, t.nli_score_threshold).drop("support_scores"), t)
        assert {r["pair_id"]: (r["n_entailed"], r["n_unsupported"], r["decision"]) for r in alone.collect()} == {p: v for (n, p), v in got.items() if n == name}
    totals = [sum(v[0] for (n, _), v in got.items() if n == name) for name in profiles]
    assert totals == sorted(totals, reverse=True) and len(set(totals)) > 3
    plan = swept._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("_best(") == 1  # measured once
    with pytest.raises(ValueError, match="support_scores"):
        gate.sweep_thresholds(measured.drop("support_scores"), profiles)


def test_summaries_by_join_and_in_parts_are_those_of_the_row(spark):
    rng = random.Random(2)
    rows = [(str(i), str(i), report(rng, 4), report(rng, 7)) for i in range(10)] + [("z", "z", None, "")]
    pairs = spark.createDataFrame(rows, "pair_id string, original_id string, original_text string, humanized_text string")
    in_row = sentences.with_support(pairs, None).select("pair_id", "n_sentences", "support_scores")
    scores = sentences.sentence_scores(pairs, None)
    summed = sentences.score_summary(scores, pairs)
    parts = sentences.score_summary(scores.filter("pos % 2 = 0"), pairs).unionAll(sentences.score_summary(scores.filter("pos % 2 = 1"), pairs))
    want = {r[0]: tuple(r) for r in in_row.collect()}
    assert {r[0]: tuple(r) for r in summed.collect()} == want == {r[0]: tuple(r) for r in sentences.merge_summaries(parts).collect()}
    at = sentences.at_threshold(summed, 0.5).collect()
    assert all(r["n_entailed"] == sum(s >= 0.5 for s in r["support_scores"]) and r["n_assessed"] == len(r["support_scores"]) for r in at)


# ---- overlaps


def test_best_matches_equal_all_comparisons():
    rng = random.Random(3)
    for _ in range(300):
        pool = [f"w{i}" for i in range(rng.choice([3, 10, 60]))]
        draw = lambda n: [sorted({rng.choice(pool) for _ in range(rng.randint(0, 9))}) for _ in range(n)]
        source, sentence = draw(rng.randint(0, 12)), draw(rng.randint(0, 8)) + [None]
        want = []
        for s in sentence:
            both = [len(set(s) & set(p)) for p in source] if s is not None else None
            want.append(None if both is None else (max(both, default=0), both.index(max(both)) if both and max(both) else -1))
        assert sentences.best_matches(sentence, source) == want


def test_long_pairs_are_not_compared_all_with_all(spark):
    rng = random.Random(4)
    common = ["rotura", "menisco", "rodilla"]
    line = lambda i: "El " + " ".join([*common, *(f"palabra{chr(97 + (i * k) % 26)}{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}" for k in (1, 3, 7))]) + "."
    source = [line(i) for i in range(5_000)]
    sentence = [line(rng.randrange(5_000)) for _ in range(5_000)]
    one = spark.createDataFrame([("p", "o", " ".join(source), " ".join(sentence))], "pair_id string, original_id string, original_text string, humanized_text string")
    began = time.time()
    rows = sentences.sentence_scores(one, None).collect()
    assert len(rows) == 5_000 and all(r["score"] == 1.0 for r in rows) and time.time() - began < 60  # 25 million pairs


def test_scorer_sees_each_couple_once_and_texts_stop_there(spark):
    rows = [("p", "o", i, f"s{i % 3}", j, f"t{j % 2}") for i in range(6) for j in range(4)]
    met = spark.createDataFrame(rows, "pair_id string, original_id string, pos int, sentence string, prem_pos int, premise string")
    scored = sentences.score_with(met, lambda premise, hypothesis: pd.Series([len(p) / 10 + int(h[1]) for p, h in zip(premise, hypothesis)]))
    assert "premise" not in scored.columns and Counter(r["contradiction"] for r in scored.collect()) == Counter({0.2: 8, 1.2: 8, 2.2: 8})


# ---- entities


def test_mentions_equal_every_pattern_on_its_own(spark):
    rng = random.Random(5)
    terms = [*knee.LEXICON, *entities.expand_synonyms([Term("derrame", "HALLAZGO", [])], knee.SYNONYMS), Term("x", "Y", ["aa", "k", r"\bla\b", r"(l)a\1?"]), Term("s", "Z", ["s"])]
    texts = [" ".join(rng.choice([*KNEE, "aaaa", "LA la", "ligamento cruzado posterior", "líquido en la articulación", "Kelvin İ ſ ñÑ"]) for _ in range(8)) for _ in range(30)]
    texts += [None, "", "x" * 300_000, "la " * 60_000]
    df = spark.createDataFrame(list(enumerate(texts)), "report_id long, text string")
    got = Counter(tuple(r) for r in entities.extract_entities(df, terms).collect())
    want = Counter((i, t.canonical, t.entity_type, m[0], m.start(), m.end()) for i, x in enumerate(texts) for t in terms for p in t.patterns for m in re.finditer(p, x or "", re.I))
    assert got == want


@pytest.mark.parametrize("pattern, plain", [(r"\bligamento cruzado\b", (True, "ligamento cruzado", True)), ("LCA", (False, "LCA", False)), (r"a\-b", (False, "a-b", False)), ("a.b", None), ("a+", None), (r"\s", None), ("ñu", (False, "ñu", False))])
def test_phrases_are_told_from_patterns(pattern, plain):
    assert entities.literal(pattern) == plain


def test_knee_rules_equal_plain_expressions(spark):
    """Look-arounds included: negated phrases, and those that differ in a grade only."""
    texts = [f"{a} {b}" for a in KNEE for b in KNEE]
    df = spark.createDataFrame(list(enumerate(texts)), "pair_id long, text string")
    found = lambda patterns, t: any(re.search(p, t, re.I | re.S) for p in patterns)
    got = {(r["pair_id"], r["finding"]): (r["mentioned"], r["correct_matched"], r["attenuation_detected"]) for r in checklist.check_findings(df, knee.FINDINGS).collect()}
    assert got == {(i, f.name): (found(f.presence, t), found(f.correctness, t), found(f.attenuation, t)) for i, t in enumerate(texts) for f in knee.FINDINGS}
    assert len({v for v in got.values()}) > 4
    terms = df.select("pair_id", entities.canonicals(F.col("text"), knee.LEXICON).alias("c")).collect()
    assert {r["pair_id"]: r["c"] for r in terms} == {i: [t.canonical for t in knee.LEXICON if found(t.patterns, x)] for i, x in enumerate(texts)}


# ---- texts


def test_decomposition_equals_unicodedata(spark):
    codes = [c for c in range(0x21, 0x30000) if not 0xD800 <= c <= 0xDFFF and unicodedata.category(chr(c)) not in ("Cn", "Cc", "Zs", "Zl", "Zp")]
    rows = [(i, "x".join(map(chr, codes[i : i + 500]))) for i in range(0, len(codes), 500)]
    rows += [(-1, "Tiếng Việt ĐẶC BIỆT"), (-2, "Ἀθηναίων ΌΔΟΣ"), (-3, "Ёлка й"), (-4, "한국어 텍스트 각"), (-5, None), (-6, "")]
    plain = lambda t: "".join(c for c in unicodedata.normalize("NFD", t) if unicodedata.category(c) != "Mn")
    out = spark.createDataFrame(rows, "id long, t string").select("id", unmarked(F.col("t")).alias("u"), normalize_surface(F.col("t")).alias("n")).collect()
    want = {i: None if t is None else plain(t) for i, t in rows}
    assert {r["id"]: r["u"] for r in out} == want
    assert all(r["n"] == re.sub(r"\s+", " ", want[r["id"]].lower()).strip() for r in out if r["id"] in (-1, -2, -3, -4, -6))


def test_counts_equal_a_plain_version(spark):
    rng = random.Random(6)
    bits = ["Hola", "aéreo", "otra", "ella", "una", "agua", "¿qué?", "3.5", "--", "mm", "e-o", "...", "fin.", "¡Sí!", "\n\n", "LCA", "(abril)", "y", "Ábrego", "'"]
    texts = [rng.choice(["", " ", "  "]).join(rng.choice(bits) + rng.choice([" ", " ", "\n", ""]) for _ in range(rng.randint(0, 40))) for _ in range(400)] + ["", " ", "-" * 100_000, "a " * 50_000, "a." * 50_000]
    vowels = "aeiouáéíóúü"

    def plain(t):
        words = lambda x: re.sub(r"[^\w\s]+", "", x).split()
        runs = re.findall(r"\b[^.!?]+[.!?]*", t)
        lone = len(re.findall(rf"\b[{vowels}](?=(?:[bcdfgkpt][lr]|ch|ll|rr|[^{vowels}\W\d_])[{vowels}])", t, re.I))
        mute = sum(1 for w in t.split() if re.search(r"\w", w) and not re.search(f"[{vowels}]", w, re.I))
        return (len(re.sub(r"\s+", "", t)), len(re.sub(r"\W", "", t)), len(words(t)), max(1, sum(len(words(r)) > 2 for r in runs)), len(re.findall(f"[{vowels}]+", t, re.I)) - lone + mute)

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, t string")
    got = {r["id"]: tuple(r)[1:] for r in df.select("id", *[c.alias(n) for n, c in measures(F.col("t")).items()]).collect()}
    assert got == {i: plain(t) for i, t in enumerate(texts)}


# ---- runs, uploads, levels, log


def test_runs_are_kept_and_replace_only_their_own(spark, tmp_path):
    path = f"{tmp_path}/verdicts"
    rows = lambda *r: spark.createDataFrame(list(r), "pair_id string, decision string")
    assert committed_runs(spark, path) == []
    write_verdicts(rows(("a", "APPROVE"), ("b", "REJECT")), path, "007")
    write_verdicts(rows(("a", "APPROVE"), ("c", "REVIEW")), path, "2026-01-02")
    write_verdicts(rows(("d", "APPROVE")), path, "2026-01-02")  # no REVIEW any more
    read = lambda *a: sorted(tuple(r) for r in read_verdicts(spark, path, *a).select("run", "pair_id", "decision").collect())
    assert read() == [("007", "a", "APPROVE"), ("007", "b", "REJECT"), ("2026-01-02", "d", "APPROVE")]
    rows(("x", "APPROVE")).write.partitionBy("decision").parquet(f"{path}/run=half")  # a run that never came to its end
    assert committed_runs(spark, path) == ["007", "2026-01-02"] and len(read()) == 3 and read(["007"]) == read()[:2]
    with pytest.raises(ValueError):
        read(["half"])
    with pytest.raises(ValueError):
        write_verdicts(rows(("x", "APPROVE")), path, "../other")


def test_uploads_by_listing(spark, tmp_path):
    for name, size in (("p1/s1/a original.dcm", 1_200_000), ("p1/s1/b.dcm", 5), ("p2/s2/adenda.txt", 3), ("p2/s2/empty.txt", 0), ("p2/s2/skip.log", 7)):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x" * size)
    found = read_uploads(spark, str(tmp_path), "*.{dcm,txt}")
    rows = {r["filename"]: (r["study_id"], r["dni"], r["n_bytes"], r["report_type"]) for r in found.collect()}
    assert rows == {"a original.dcm": ("s1", "p1", 1_200_000, "ORIGINAL"), "b.dcm": ("s1", "p1", 5, "HUMANIZED"), "adenda.txt": ("s2", "p2", 3, "AMENDMENT")}
    assert "content" not in found._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    studies = {r["study_id"]: (r["n_files"], r["size_bytes"], r["n_instances"], r["folder_id"], r["report_types"]) for r in study_manifest(found).collect()}
    assert studies == {"s1": (2, 1_200_005, 2, "folder-p1", ["HUMANIZED", "ORIGINAL"]), "s2": (1, 3, 1, "folder-p2", ["AMENDMENT"])}
    assert {r["filename"] for r in ingest_manifest(found).collect()} == set(rows)


def test_levels_in_one_pass(spark):
    rows = [("a", "x", True, True, False), ("a", "y", False, False, True), ("b", "x", True, False, False), (None, "x", True, True, False)]
    checks = spark.createDataFrame(rows, "pair_id string, finding string, mentioned boolean, severity_preserved boolean, attenuation_detected boolean")
    checks = checks.withColumns({"severity_optional": F.lit(False), "correct_matched": F.col("severity_preserved")})
    found = checklist.checklist_levels(checks)
    got = {(r["level"], r["pair_id"], r["finding"]): (r["n_findings"], r["n_correct"], r["n_omitted"]) for r in found.collect()}
    assert got == {("report", "a", None): (2, 1, 1), ("report", "b", None): (1, 0, 0), ("report", None, None): (1, 1, 0), ("finding", None, "x"): (3, 2, 0), ("finding", None, "y"): (1, 0, 1), ("all", None, None): (4, 2, 1)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_log_has_one_order(spark):
    events = spark.createDataFrame([(1, 5, "b", 2), (1, 5, "a", 9), (1, 5, "a", 3), (1, 4, "z", 0)], "study_id int, ts int, event string, line int")
    for n in (1, 3):
        assert [tuple(r) for r in delivery.audit_trail(events.repartition(n)).select("event", "line").collect()] == [("z", 0), ("a", 3), ("a", 9), ("b", 2)]


# ---- streams


def arrive(spark, folder, rows, files):
    """The reports in so many files, originals and rewrites in any order."""
    for n in range(files):
        part = spark.createDataFrame(rows[n::files], "side string, study_id string, report_id string, text string, minute int").coalesce(1)
        part.withColumn("uploaded_at", F.timestamp_seconds((F.col("minute") + 1_000_000) * 60)).write.mode("append").parquet(folder)


def judged(spark, base, late="1 hour", wait="1 hour"):
    schema = "side string, study_id string, report_id string, text string, minute int, uploaded_at timestamp"
    side = lambda s: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/in").filter(F.col("side") == s)
    met = pair_stream(side("o"), side("h"), late, wait)
    gate_stream(met, [], [Term("menisco", "ANATOMIA", ["menisco"])], f"{base}/out", f"{base}/state").awaitTermination()
    return sorted((r["pair_id"], r["decision"], r["routed"]) for r in read_verdicts(spark, f"{base}/out", level="batch").collect())


def test_stream_pairs_across_batches_and_restarts(spark, tmp_path):
    rng = random.Random(7)
    rows = [(s, f"s{i}", f"{s}{i}-{k}", report(rng, 4), i) for i in range(14) for s, n in (("o", 1), ("h", 2)) for k in range(n)] + [("h", None, "x", "no study", 1)]
    rng.shuffle(rows)
    found = {}
    for files in (1, 2, 7):
        arrive(spark, f"{tmp_path}/{files}/in", rows, files)
        found[files] = judged(spark, f"{tmp_path}/{files}")
    assert len(found[1]) == 28 and found[1] == found[2] == found[7]
    base = f"{tmp_path}/again"  # half of the reports, a stop, the other half
    arrive(spark, f"{base}/in", rows[:20], 2)
    first = judged(spark, base)
    arrive(spark, f"{base}/in", rows[20:], 3)
    assert len(first) < 28 and judged(spark, base) == found[1] == judged(spark, base)


def test_stream_leaves_out_what_is_too_late_or_too_far(spark, tmp_path):
    base = f"{tmp_path}/late"
    arrive(spark, f"{base}/in", [("o", "a", "o1", "Uno dos tres.", 0), ("h", "a", "h1", "Uno dos tres.", 50), ("h", "a", "h2", "Uno dos tres.", 70)], 1)  # h2 is 70 minutes from its original
    first = judged(spark, base)
    assert [p for p, *_ in first] == ["o1/h1"]
    arrive(spark, f"{base}/in", [("o", "z", "o9", "Uno dos tres.", 10_000), ("h", "z", "h9", "Uno dos tres.", 10_000)], 1)
    judged(spark, base)
    arrive(spark, f"{base}/in", [("h", "a", "h3", "Uno dos tres.", 10)], 1)  # its time is far behind the watermark by now
    assert [p for p, *_ in judged(spark, base)] == ["o1/h1", "o9/h9"]

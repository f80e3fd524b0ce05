"""Whole reports through the gate: made-up ones with known decisions, and the published three where they are present.

The published reports lie outside the repository; $FIDELIS_REPORTS names their folder (``*original*``, ``*gold*``,
``*adversarial*``). Where they aren't there, only the made-up ones are tested.
"""

import os
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from fidelis.operators import checklist, entities
from fidelis.plans import gate
from fidelis.rules.knee import FINDINGS, LEXICON, SYNONYMS
from fidelis.sources.reports import build_pairs, read_reports

PUBLISHED = Path(os.environ.get("FIDELIS_REPORTS", Path(__file__).resolve().parent.parent.parent / "reference" / "data" / "reports"))
# decision, votes, entities preserved of 25, assessed and entailed sentences, INFLESZ
WANTED = {
    "gold": ("APPROVE", 3, 20, 21, 8, 62.5),
    "adversarial": ("REJECT", 1, 12, 11, 4, 57.9),
    "original": ("APPROVE", 3, 25, 23, 23, 38.5),
}

ORIGINAL = """# Informe de resonancia

**Hallazgos**

- Rotura completa del LCA con discontinuidad de sus fibras.
- Rotura compleja del cuerno posterior del menisco interno, de grado III.
- Edema óseo en el cóndilo femoral y en la meseta tibial por contusión.
- Distensión de grado I del LCM, sin rotura de sus fibras.
- Condromalacia grado II del cartílago del cóndilo femoral interno.
- Derrame articular moderado en la rodilla.

Se recomienda valoración por traumatología para la reconstrucción del LCA con fisioterapia posterior.
"""
FAITHFUL = """# Su informe

Usted tiene una rotura completa del LCA, con discontinuidad de sus fibras.

El menisco interno tiene una rotura compleja en el cuerno posterior, de grado III.

Hay edema óseo en el cóndilo femoral y en la meseta tibial, causado por la contusión.

El LCM tiene una distensión de grado I, sin rotura de las fibras.

El cartílago del cóndilo femoral interno tiene condromalacia grado II.

Hay un derrame articular moderado en la rodilla.

Le recomendamos una valoración por traumatología para la reconstrucción del LCA y fisioterapia posterior.
"""
WEAKENED = """# Su informe

El LCA tiene una rotura parcial que suele curarse sola con paciencia.

El menisco interno está intacto y puede usted caminar con normalidad.

Los huesos están bien y tampoco presentan ninguna fractura importante.

Basta con reposo durante algunas semanas antes de volver al deporte.
"""


@pytest.fixture(scope="module", params=["made up", *(["published"] if list(PUBLISHED.glob("*original*.md")) else [])])
def reports(request, spark, tmp_path_factory):
    folder = PUBLISHED
    if request.param == "made up":
        folder = tmp_path_factory.mktemp("reports") / "study-1"
        folder.mkdir()
        for name, text in (("original", ORIGINAL), ("gold", FAITHFUL), ("adversarial", WEAKENED)):
            (folder / f"knee_{name}.md").write_text(text, encoding="utf-8")
    found = read_reports(spark, str(folder / "*.md")).filter("lower(filename) rlike 'original|gold|adversarial'")
    return request.param, found.withColumn("name", F.regexp_extract("filename", "original|gold|adversarial", 0)).cache()


def test_reports_are_read_whole(reports):
    kind, found = reports
    rows = {r["name"]: r for r in found.collect()}
    lengths = {"original": 3541, "gold": 3602, "adversarial": 2118} if kind == "published" else {"original": len(ORIGINAL), "gold": len(FAITHFUL), "adversarial": len(WEAKENED)}
    assert {n: len(r["text"]) for n, r in rows.items()} == lengths
    assert {n: r["report_type"] for n, r in rows.items()} == {"original": "ORIGINAL", "gold": "HUMANIZED", "adversarial": "HUMANIZED"}
    assert all(r["size_bytes"] >= len(r["text"]) and r["uploaded_at"] and r["study_id"] for r in rows.values())


def test_decisions(reports):
    kind, found = reports
    named = found.select("study_id", F.col("name").alias("report_id"), "text")
    pairs = build_pairs(named.filter("report_id = 'original'"), named)
    verdicts = {v["pair_id"].split("/")[1]: v for v in gate.evaluate_pairs(pairs, FINDINGS, entities.expand_synonyms(LEXICON, SYNONYMS)).collect()}
    assert {n: v["decision"] for n, v in verdicts.items()} == {n: w[0] for n, w in WANTED.items()}
    assert verdicts["original"]["votes"] == verdicts["gold"]["votes"] == 3 and verdicts["original"]["ner_recall_global"] == 1.0
    for name, v in verdicts.items():
        decision, votes, preserved, assessed, entailed, inflesz = WANTED[name]
        if kind == "published":
            assert (v["votes"], v["n_assessed"], v["n_entailed"]) == (votes, assessed, entailed), name
            assert v["ner_recall_global"] == pytest.approx(preserved / 25) and v["nli_entailment_rate"] == pytest.approx(entailed / assessed, abs=1e-4)
            assert abs(v["inflesz_score"] - inflesz) <= 1.5 and (v["inflesz_score"] >= 55) == (inflesz >= 55)
        else:
            assert v["n_assessed"] >= 2 and v["n_entailed"] == (v["n_assessed"] if name != "adversarial" else 0), name


def test_findings(reports):
    kind, found = reports
    s = {r["name"]: r for r in checklist.checklist_summary(checklist.check_findings(found, FINDINGS, "name"), "name").collect()}
    counts = {n: (r["n_findings"], r["n_mentioned"], r["n_correct"], r["n_attenuated"], r["n_omitted"]) for n, r in s.items()}
    assert counts["original"] == counts["gold"] == (7, 7, 7, 0, 0)
    assert counts["adversarial"] == ((7, 5, 3, 2, 2) if kind == "published" else (7, 2, 0, 4, 5))

"""The gate: three layers vote on each pair, readability informs."""

from __future__ import annotations

from dataclasses import asdict, dataclass, fields

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.readability import readability
from fidelis.functions.text import strip_markdown_col
from fidelis.operators.checklist import with_summary
from fidelis.operators.entities import canonicals, entity_recall
from fidelis.operators.sentences import at_threshold, with_support
from fidelis.rules import Finding, Term
from fidelis.rules.knee import STOP_WORDS


@dataclass(frozen=True)
class Thresholds:
    """Fixed values of the shipped profile."""

    ner_min_recall: float = 0.65
    nli_max_contradictions: int = 0
    nli_contradiction_threshold: float = 0.5
    nli_min_entailment_rate: float = 0.30
    nli_max_hallucinations: int = 16
    nli_score_threshold: float = 0.30


def measure_pairs(pairs: DataFrame, rules: list[Finding], lexicon: list[Term], score_threshold: float = 0.30, stop_words: list[str] = STOP_WORDS, gate_lexicon: list[Term] | None = None) -> DataFrame:
    """What the layers measure of ``pairs(pair_id, original_text, humanized_text)``, one narrow row a pair.

    All layers are worked out within the row: ``pairs`` is read once and nothing is shuffled. Null texts count as empty.
    ``support_scores`` lets ``decide`` count supported sentences at any threshold; ``score_threshold`` is that of the
    counts returned here.
    """
    plain = lambda c: strip_markdown_col(F.coalesce(F.col(c), F.lit("")))
    rows = pairs.select("pair_id", plain("original_text").alias("original_text"), plain("humanized_text").alias("text"))
    rows = with_support(rows, gate_lexicon or lexicon, score_threshold, stop_words, rewrite="text")
    rows = with_summary(rows, rules)
    rows = rows.withColumns({"original_entities": canonicals(F.col("original_text"), lexicon), "humanized_entities": canonicals(F.col("text"), lexicon)})
    # Readability counts sentences of its own under the same name.
    rows = readability(entity_recall(rows).drop("original_text").withColumnRenamed("n_sentences", "__n_sentences"), strip_md=False)
    return rows.select(
        "pair_id", "overall_pass", "n_findings", "n_mentioned", "n_correct", "n_attenuated", "n_omitted", "n_wrong_severity", "coverage_pct",
        "recall", "omitted", "added", "szigriszt_pazos", "inflesz_category", "meets_healthcare_target",
        F.col("__n_sentences").alias("n_sentences"), "n_assessed", "n_entailed", "n_unsupported", "entailment_rate", "support_scores")


def decide(measures: DataFrame, t: Thresholds = Thresholds(), contradictions: DataFrame | None = None, judge: DataFrame | None = None) -> DataFrame:
    """Votes and decision. A judge's report goes before contradictions, those before entailment, where a pair has them.

    Supported sentences are counted anew at the profile's score threshold from ``support_scores``; measures without that
    column are taken to have been counted at that threshold.
    """
    if "support_scores" in measures.columns:
        measures = at_threshold(measures, t.nli_score_threshold).drop("support_scores")
    out = measures.withColumns({"rate": F.col("entailment_rate"), "unsupported": F.col("n_unsupported")})
    mode, passed = F.lit("entailment"), (F.col("entailment_rate") >= t.nli_min_entailment_rate) & (F.col("n_unsupported") <= t.nli_max_hallucinations)
    if contradictions is not None:
        out = out.join(contradictions.select("pair_id", "n_contradictions"), "pair_id", "left")
        has = F.col("n_contradictions").isNotNull()
        mode, passed = F.when(has, "contradiction").otherwise(mode), F.when(has, F.col("n_contradictions") <= t.nli_max_contradictions).otherwise(passed)
    if judge is not None:
        j = judge.select("pair_id", F.col("verdict").alias("judge_verdict"), ((F.col("n_preserved") + F.col("n_simplified")) / F.col("n_findings")).alias("j_rate"),
                         (F.col("n_omitted") + F.col("n_attenuated") + F.col("n_hallucinated")).alias("j_unsupported"))
        out = out.join(j, "pair_id", "left")
        has = F.col("judge_verdict").isNotNull()
        mode, passed = F.when(has, "judge").otherwise(mode), F.when(has, F.col("judge_verdict") == "PASS").otherwise(passed)
        out = out.withColumns({"rate": F.when(has, F.col("j_rate")).otherwise(F.col("rate")), "unsupported": F.when(has, F.col("j_unsupported")).otherwise(F.col("unsupported"))})
    out = out.withColumns({"checklist_passed": F.col("overall_pass"), "ner_passed": F.col("recall") >= t.ner_min_recall, "nli_passed": passed, "nli_mode": mode})
    votes = sum((F.col(c).cast("int") for c in ("checklist_passed", "ner_passed", "nli_passed")), F.lit(0))
    out = out.withColumn("votes", votes)
    decision = F.when(F.col("votes") == 3, "APPROVE").when(F.col("votes") == 2, "REVIEW").otherwise("REJECT")
    return out.withColumn("decision", decision)


def evaluate_pairs(pairs: DataFrame, rules: list[Finding], lexicon: list[Term], thresholds: Thresholds = Thresholds(), contradictions: DataFrame | None = None, judge: DataFrame | None = None) -> DataFrame:
    """A verdict per pair, with rounded measures and a summary line; comparisons use the unrounded ones."""
    out = decide(measure_pairs(pairs, rules, lexicon, thresholds.nli_score_threshold), thresholds, contradictions, judge)
    summary = F.format_string("%s (%d/3): checklist %s, entities %.1f%%, sentences %.1f%% (%s)", "decision", "votes", F.col("checklist_passed").cast("string"), F.col("recall") * 100, F.col("rate") * 100, "nli_mode")
    return out.select(
        "pair_id", "decision", "votes", "checklist_passed", "ner_passed", "nli_passed", "nli_mode", "n_attenuated", "n_omitted",
        F.round("coverage_pct", 2).alias("coverage_pct"), F.round("recall", 4).alias("ner_recall_global"), F.col("omitted").alias("ner_omissions"),
        F.col("added").alias("ner_additions"), "n_assessed", "n_entailed", F.round("rate", 4).alias("nli_entailment_rate"), "unsupported",
        F.col("szigriszt_pazos").alias("inflesz_score"), "inflesz_category", summary.alias("summary"))


def accepted(require_approve: bool = False) -> Column:
    """Whether a verdict lets the rewrite through."""
    return F.col("decision").isin(["APPROVE"] if require_approve else ["APPROVE", "REVIEW"])


def route(verdicts: DataFrame, require_approve: bool = False) -> tuple[DataFrame, DataFrame]:
    """Accepted and blocked verdicts; REVIEW is accepted unless approval is required."""
    fit = accepted(require_approve)
    return verdicts.filter(fit), verdicts.filter(~fit)


def with_route(verdicts: DataFrame, require_approve: bool = False) -> DataFrame:
    """``verdicts`` with ``routed``, ``accepted`` or ``blocked``: both sides of ``route`` in one pass over the verdicts."""
    return verdicts.withColumn("routed", F.when(accepted(require_approve), "accepted").otherwise("blocked"))


def sweep_thresholds(measures: DataFrame, profiles: dict[str, Thresholds]) -> DataFrame:
    """The same measures decided under each named profile: a row's measures are copied per profile, so measured once.

    Profiles may differ in any threshold. Those that differ in the score threshold need the measures' ``support_scores``.
    """
    if "support_scores" not in measures.columns and len({t.nli_score_threshold for t in profiles.values()}) > 1:
        raise ValueError("profiles with several score thresholds need measures with support_scores")
    named = [F.struct(F.lit(name).alias("profile"), *[F.lit(v).alias(k) for k, v in asdict(t).items()]) for name, t in profiles.items()]
    each = measures.withColumn("__t", F.explode(F.array(*named)))
    out = decide(each, Thresholds(**{f.name: F.col(f"__t.{f.name}") for f in fields(Thresholds)}))
    return out.withColumn("profile", F.col("__t.profile")).drop("__t")


def compare_backends(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """Both backends' decisions side by side; a missing semantic layer's vote falls back to the lexical one."""
    rank = {"REJECT": 0, "REVIEW": 1, "APPROVE": 2}
    level = lambda c: F.create_map(*[F.lit(x) for kv in rank.items() for x in kv])[F.col(c)]
    layers = ["checklist_passed", "ner_passed", "nli_passed"]
    s = semantic.select("pair_id", *[F.col(c).alias(f"s_{c}") for c in layers])
    out = lexical.select("pair_id", *layers, F.col("decision").alias("lexical_decision")).join(s, "pair_id", "left")
    votes = sum((F.coalesce(f"s_{c}", c).cast("int") for c in layers), F.lit(0))
    out = out.withColumn("semantic_votes", votes)
    out = out.withColumn("semantic_decision", F.when(F.col("semantic_votes") == 3, "APPROVE").when(F.col("semantic_votes") == 2, "REVIEW").otherwise("REJECT"))
    change = level("semantic_decision") - level("lexical_decision")
    return out.withColumn("change", F.when(change > 0, "upgraded").when(change == 0, "same").otherwise("other")).drop(*[f"s_{c}" for c in layers])


def expected_vs_actual(results: DataFrame, expected: DataFrame) -> DataFrame:
    """``results(pair_id, n)`` against ``expected(pair_id, expected)``; an expectation of null means one or more."""
    ok = F.when(F.col("expected").isNull(), F.col("n") >= 1).otherwise(F.col("n") == F.col("expected"))
    return results.join(expected, "pair_id").withColumn("ok", ok)


def expectations_met(checked: DataFrame) -> DataFrame:
    """One row for the whole of ``expected_vs_actual``: how many pairs, how many as expected, and whether all are."""
    out = checked.agg(F.count("*").alias("n_pairs"), F.count_if("ok").alias("n_ok"))
    return out.withColumn("overall_ok", F.col("n_pairs") == F.col("n_ok"))


def decision_report(verdicts: DataFrame, *groups: str) -> DataFrame:
    """Decisions, pass counts and mean measures over all pairs and by group."""
    return verdicts.rollup(*groups, "decision").agg(
        F.count("*").alias("n"), F.count_if("checklist_passed").alias("n_checklist"), F.count_if("ner_passed").alias("n_ner"), F.count_if("nli_passed").alias("n_nli"),
        F.round(F.avg("ner_recall_global"), 4).alias("mean_recall"), F.round(F.avg("nli_entailment_rate"), 4).alias("mean_rate"),
        F.round(F.avg("inflesz_score"), 2).alias("mean_inflesz"))

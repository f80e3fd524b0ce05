"""Checklist of findings: presence, severity and attenuation, as literal pattern expressions per finding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fidelis.functions.text import any_word, searched
from fidelis.rules import Finding

FLAGS = "(?iUs)"
STATUS = {"attenuated": "atenuado", "omitted": "omitido", "wrong_severity": "severidad incorrecta", "ok": "ok"}


def _any(text: Column, patterns: list[str], words: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(FLAGS + p)
    return text.rlike(any_word(words)) & out if words else out


def evidence(text: Column, patterns: list[str], most: int = 3) -> Column:
    """The first ``most`` distinct matches, white space collapsed, in the order of the patterns."""
    if not patterns:
        return F.array().cast("array<string>")
    found = F.concat(*[F.regexp_extract_all(text, F.lit(FLAGS + p), F.lit(0)) for p in patterns])
    return F.slice(F.array_distinct(F.transform(found, lambda m: F.trim(F.regexp_replace(m, r"(?U)\s+", " ")))), 1, most)


def _check(text: Column, f: Finding, with_evidence: bool) -> Column:
    mentioned, correct, weak = (_any(text, patterns, f.words) for patterns in (f.presence, f.correctness, f.attenuation))
    parts = [
        F.lit(f.name).alias("finding"), F.lit(f.severity_label).alias("severity_label"), F.lit(f.severity_optional).alias("severity_optional"),
        mentioned.alias("mentioned"), correct.alias("correct_matched"), weak.alias("attenuation_detected"),
    ]
    if with_evidence:
        parts += [evidence(text, getattr(f, k)).alias(f"{k}_evidence") for k in ("presence", "correctness", "attenuation")]
    return F.struct(*parts)


def _checked(text: Column, rules: list[Finding], with_evidence: bool) -> Column:
    """An array of the checks, each pattern asked once; a typed empty one if there are no rules."""
    if rules:
        return F.array(*[_check(text, f, with_evidence) for f in rules])
    found = ", ".join(f"{c}_evidence: array<string>" for c in ("presence", "correctness", "attenuation")) if with_evidence else ""
    kind = "finding: string, severity_label: string, severity_optional: boolean, mentioned: boolean, correct_matched: boolean, attenuation_detected: boolean"
    return F.array().cast(f"array<struct<{', '.join(filter(None, [kind, found]))}>>")


def _preserved(c: Column) -> Column:
    """Whether a check's severity is preserved."""
    return F.when(c["severity_optional"], (c["mentioned"] & ~c["attenuation_detected"]) | c["correct_matched"]).otherwise(c["correct_matched"])


def finding_status(mentioned: Column, preserved: Column, attenuated: Column) -> Column:
    """Attenuated goes before omitted, omitted before wrong severity."""
    return F.when(attenuated, STATUS["attenuated"]).when(~mentioned, STATUS["omitted"]).when(~preserved, STATUS["wrong_severity"]).otherwise(STATUS["ok"])


def check_findings(df: DataFrame, rules: list[Finding], key: str = "pair_id", text: str = "text", with_evidence: bool = False) -> DataFrame:
    """A row for each report and finding. A null text counts as empty; an empty table gives no rows."""
    rows = df.select(F.col(key), searched(F.col(text), rules).alias("__text")).select(key, _checked(F.col("__text"), rules, with_evidence).alias("__c"))
    rows = rows.select(key, F.explode("__c").alias("c"))
    found = [f"c.{k}_evidence" for k in ("presence", "correctness", "attenuation")] if with_evidence else []
    rows = rows.select(
        key, "c.finding", "c.severity_label", "c.severity_optional", "c.mentioned", "c.correct_matched", _preserved(F.col("c")).alias("severity_preserved"),
        "c.attenuation_detected", *found)
    return rows.withColumn("status", finding_status(F.col("mentioned"), F.col("severity_preserved"), F.col("attenuation_detected")))


def _counters() -> list[Column]:
    m, p, a = F.col("mentioned"), F.col("severity_preserved"), F.col("attenuation_detected")
    return [
        F.count("*").alias("n_findings"),
        F.count_if(m).alias("n_mentioned"),
        F.count_if(m & p & ~a).alias("n_correct"),
        F.count_if(a).alias("n_attenuated"),
        F.count_if(~m).alias("n_omitted"),
        F.count_if(m & ~p & ~a).alias("n_wrong_severity"),
        F.count_if(F.col("severity_optional") & m & ~a & ~F.col("correct_matched")).alias("n_severity_optional_not_checked"),
    ]


def _rates(counted: DataFrame) -> DataFrame:
    n = F.greatest("n_findings", F.lit(1))
    return counted.withColumns({
        "overall_pass": (F.col("n_omitted") == 0) & (F.col("n_attenuated") == 0) & (F.col("n_wrong_severity") == 0),
        "coverage_pct": 100.0 * F.col("n_mentioned") / n,
        "correctness_pct": 100.0 * F.col("n_correct") / n,
    })


def checklist_summary(checks: DataFrame, *keys: str) -> DataFrame:
    """Counters per key (``pair_id`` unless given; ``finding`` gives a profile); a weakened finding that isn't mentioned counts twice."""
    return _rates(checks.groupBy(*(keys or ("pair_id",))).agg(*_counters()))


def checklist_levels(checks: DataFrame, report: str = "pair_id", finding: str = "finding") -> DataFrame:
    """The counters by report, by finding, and over all, in one pass over the checks.

    ``level`` is ``report``, ``finding`` or ``all``; the keys that a level doesn't have are null. A report whose own key
    is null still has its row. The row over all is there even if there are no checks, with counts of 0.
    """
    level = F.when(F.grouping(report) == 0, "report").when(F.grouping(finding) == 0, "finding").otherwise("all")
    sets = [[F.col(report)], [F.col(finding)], []]
    return _rates(checks.groupingSets(sets, report, finding).agg(level.alias("level"), *_counters()))


def with_summary(df: DataFrame, rules: list[Finding], text: str = "text") -> DataFrame:
    """``df`` with the counters of ``checklist_summary``, counted within the row: nothing is exploded or grouped."""
    df = df.withColumn("__t", searched(F.col(text), rules)).withColumn("__c", _checked(F.col("__t"), rules, False)).drop("__t")
    count = lambda test: F.size(F.filter("__c", test)).cast("long")
    df = df.withColumns({
        "n_findings": F.lit(len(rules)).cast("long"),
        "n_mentioned": count(lambda c: c["mentioned"]),
        "n_correct": count(lambda c: c["mentioned"] & _preserved(c) & ~c["attenuation_detected"]),
        "n_attenuated": count(lambda c: c["attenuation_detected"]),
        "n_omitted": count(lambda c: ~c["mentioned"]),
        "n_wrong_severity": count(lambda c: c["mentioned"] & ~_preserved(c) & ~c["attenuation_detected"]),
    }).drop("__c")
    failed = (F.col("n_omitted") > 0) | (F.col("n_attenuated") > 0) | (F.col("n_wrong_severity") > 0)
    return df.withColumns({"overall_pass": ~failed, "coverage_pct": 100.0 * F.col("n_mentioned") / max(len(rules), 1)})


def finding_profile(checks: DataFrame) -> DataFrame:
    """The counters by finding over all reports."""
    return checklist_summary(checks, "finding")


def key_term_preservation(pairs: DataFrame, terms: list[str]) -> DataFrame:
    """Per pair, the key terms of the original that the rewrite has and lacks; terms the original lacks are left out."""
    low = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    there = F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains(low("original_text"), F.lower(t)))
    kept = F.filter(there, lambda t: F.contains(low("humanized_text"), F.lower(t)))
    return pairs.select("pair_id", kept.alias("present"), F.array_except(there, kept).alias("missing"))

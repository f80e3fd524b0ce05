"""Delivery manifests, the audit trail, and constraint checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType


def delivery_manifest(studies: DataFrame, reports: DataFrame, accepted: DataFrame, ttl_hours: int = 168) -> DataFrame:
    """Per study ``(study_id, issued_at)``: its originals, and rewrites whose ``report_id`` is accepted; a study without reports is an error."""
    fit = reports.join(accepted.select("report_id", F.lit(True).alias("ok")), "report_id", "left")
    fit = fit.filter("report_type = 'ORIGINAL' or (report_type = 'HUMANIZED' and ok)")
    ids = fit.groupBy("study_id").agg(F.array_sort(F.collect_set(F.struct((F.col("report_type") != "ORIGINAL").alias("o"), "report_id"))).alias("r"))
    out = studies.join(ids, "study_id", "left").withColumn("report_ids", F.coalesce(F.transform("r", lambda x: x["report_id"]), F.array().cast("array<string>")))
    until = F.col("issued_at") + F.make_interval(hours=F.lit(ttl_hours))
    return out.select("study_id", "report_ids", until.alias("expires_at"), F.when(F.size("report_ids") == 0, "no report").alias("error"))


def audit_trail(*events: DataFrame) -> DataFrame:
    """One log of all events, by study and time; those of one time in the order of their other columns, by name."""
    out = events[0]
    for e in events[1:]:
        out = out.unionByName(e, allowMissingColumns=True)
    rest = sorted(f.name for f in out.schema if f.name not in ("study_id", "ts") and not isinstance(f.dataType, (MapType, VariantType)))
    return out.orderBy("study_id", "ts", *rest)


# What the fields may hold.
LANGUAGES, TONES, LEVELS = ["es", "es-AST", "en"], ["formal_usted", "informal_tu"], ["primario", "ESO", "bachillerato"]
ENUMS = {
    "sex": ["M", "F", "O"], "modality": ["MR", "CT", "CR", "US", "MG"], "report_type": ["ORIGINAL", "HUMANIZED", "AMENDMENT"],
    "decision": ["APPROVE", "REVIEW", "REJECT"],
    "target_language": LANGUAGES, "tone": TONES, "reading_level": LEVELS,
}


def constraints() -> dict[str, tuple[str, Column]]:
    """Rule name to the column it needs and the condition that must not be false."""
    some = lambda c: F.col(c).isNull()
    return {f"{c}_enum": (c, some(c) | F.col(c).isin(v)) for c, v in ENUMS.items()} | {
        "n_instances_nonnegative": ("n_instances", F.col("n_instances") >= 0),
        "size_bytes_nonnegative": ("size_bytes", F.col("size_bytes") >= 0),
        "confidence_range": ("confidence", some("confidence") | F.col("confidence").between(0, 1)),
        "pin_length": ("pin", F.length("pin").between(4, 8)),
        "max_chars_least": ("max_chars", some("max_chars") | (F.col("max_chars") >= 500)),
    }


def check_constraints(df: DataFrame, rules: dict[str, tuple[str, Column]] | None = None) -> DataFrame:
    """``df`` with ``violations``: the names of the rules, of those whose column is there, that a row breaks."""
    fit = {n: cond for n, (c, cond) in (rules or constraints()).items() if c in df.columns}
    tests = [F.when(~F.coalesce(cond, F.lit(False)), F.lit(n)) for n, cond in fit.items()]
    return df.withColumn("violations", F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>"))


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid rows, and the others with their violations."""
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)

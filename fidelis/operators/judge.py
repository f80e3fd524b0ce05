"""Tables for a model judge: requests, parsed answers, completed verdicts, reports. The model itself is called outside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The statuses of a finding.
STATUSES = ["preserved", "simplified", "omitted", "attenuated", "hallucinated"]
ERROR = "parse_error"
ANSWER = "array<struct<finding:string,status:string,confidence:string,evidence:string>>"


def judge_requests(pairs: DataFrame, findings: list[str]) -> DataFrame:
    """One message per pair: the original, the rewrite, the findings as bullets."""
    bullets = "\n".join(f"- {f}" for f in findings)
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    message = F.concat(F.lit("ORIGINAL:\n"), text("original_text"), F.lit("\n\nREWRITE:\n"), text("humanized_text"), F.lit(f"\n\nFINDINGS:\n{bullets}"))
    return pairs.select("pair_id", message.alias("message"))


def _json(raw: Column) -> Column:
    """The outermost array of an answer, or else its outermost object; code fences go."""
    plain = F.trim(F.regexp_replace(F.coalesce(raw, F.lit("")), r"(?m)^\s*```[a-zA-Z]*\s*$|```(?:json)?", ""))
    many, one = F.regexp_extract(plain, r"(?s)(\[.*\])", 1), F.regexp_extract(plain, r"(?s)(\{.*\})", 1)
    return F.when(many != "", many).otherwise(one)


def parse_judge(responses: DataFrame) -> DataFrame:
    """``(pair_id, n, finding, status, confidence, evidence)``; no row for an answer that can't be read."""
    rows = responses.select("pair_id", F.posexplode(F.from_json(_json(F.col("raw")), ANSWER)).alias("n", "v"))
    status = F.lower(F.trim(F.coalesce("v.status", F.lit(""))))
    confidence = F.when(F.col("v.confidence").isNull(), 0.5).otherwise(F.expr("try_cast(v.confidence as double)"))
    sound = status.isin(STATUSES) & confidence.isNotNull()
    return rows.filter("v is not null").select(
        "pair_id", "n", F.coalesce("v.finding", F.lit("")).alias("finding"), F.when(sound, status).otherwise(ERROR).alias("status"),
        F.coalesce(confidence, F.lit(0.0)).alias("confidence"), F.coalesce("v.evidence", F.lit("")).alias("evidence"))


def complete_judge(verdicts: DataFrame, responses: DataFrame, findings: list[str]) -> DataFrame:
    """Verdicts with an error row for each finding that is missing, in pairs with fewer verdicts than findings."""
    spark = verdicts.sparkSession
    wanted = spark.createDataFrame([(f,) for f in findings], "finding string")
    counts = responses.select("pair_id").distinct().join(verdicts.groupBy("pair_id").agg(F.count("*").alias("found")), "pair_id", "left").na.fill(0)
    few = counts.filter(F.col("found") < len(findings)).select("pair_id")
    rows = few.withColumn("finding", F.explode(F.array(*map(F.lit, findings)))) if findings else few.join(wanted)
    missing = rows.join(verdicts.select("pair_id", "finding"), ["pair_id", "finding"], "left_anti")
    missing = missing.select("pair_id", F.lit(None).cast("int").alias("n"), "finding", F.lit(ERROR).alias("status"), F.lit(0.0).alias("confidence"), F.lit("").alias("evidence"))
    return verdicts.unionByName(missing)


def judge_report(verdicts: DataFrame, responses: DataFrame, fail_on: tuple[str, ...] = ("omitted", "attenuated", "hallucinated")) -> DataFrame:
    """Counts per status, the verdict, and what the call cost; any error fails."""
    out = verdicts.groupBy("pair_id").agg(*[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in [*STATUSES, ERROR]], F.count("*").alias("n_findings"))
    bad = sum((F.col(f"n_{s}") for s in [*fail_on, ERROR]), F.lit(0))
    out = out.withColumn("verdict", F.when(bad > 0, "FAIL").otherwise("PASS"))
    return out.join(responses.select("pair_id", "latency_s", "input_tokens", "output_tokens"), "pair_id", "left")

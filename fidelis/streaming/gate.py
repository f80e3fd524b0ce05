"""The gate over reports that keep arriving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fidelis.plans.gate import Thresholds, evaluate_pairs, with_route
from fidelis.rules import Finding, Term
from fidelis.sources.reports import write_verdicts


def pair_stream(originals: DataFrame, rewrites: DataFrame, late: str = "1 hour", wait: str = "1 day") -> DataFrame:
    """Pairs of two streams of reports ``(study_id, report_id, text, uploaded_at)``, whichever side arrives first.

    A report waits for others of its study that were uploaded within ``wait`` before or after it. The watermark trails
    the latest upload by ``late``: reports that arrive later than that are left out, and those that nothing can join any
    more leave the state, so it holds the texts of ``wait`` and ``late`` and no more. The state is dealt out by study;
    reports without a study are in no pair. Each pair comes out once, restarts from a checkpoint included.
    """
    side = lambda d, name: d.withWatermark("uploaded_at", late).select(
        F.col("study_id").alias(f"{name}_study"), F.col("report_id").alias(f"{name}_id"), F.col("text").alias(f"{name}_text"), F.col("uploaded_at").alias(f"{name}_at"))
    near = F.col("humanized_at").between(F.col("original_at") - F.expr(f"INTERVAL {wait}"), F.col("original_at") + F.expr(f"INTERVAL {wait}"))
    both = side(originals, "original").join(side(rewrites, "humanized"), (F.col("original_study") == F.col("humanized_study")) & near)
    pair = F.concat_ws("/", "original_id", "humanized_id")
    return both.select(F.col("original_study").alias("study_id"), pair.alias("pair_id"), "original_id", "humanized_id", "original_text", "humanized_text")


def gate_stream(stream: DataFrame, rules: list[Finding], lexicon: list[Term], out: str, checkpoint: str, thresholds: Thresholds = Thresholds(),
                require_approve: bool = False) -> StreamingQuery:
    """Judges each micro-batch of pairs and publishes its verdicts under ``out/batch=<number>``, by route and decision.

    ``stream`` has ``(pair_id, original_text, humanized_text)``, from ``pair_stream`` say. ``routed`` is ``accepted`` or
    ``blocked``. A batch that runs again after a failure replaces its own verdicts; ``read_verdicts`` with the level
    ``batch`` reads them all.
    """

    def judge(batch: DataFrame, number: int) -> None:
        verdicts = with_route(evaluate_pairs(batch, rules, lexicon, thresholds), require_approve)
        write_verdicts(verdicts, out, str(number), ("routed", "decision"), "batch")

    return stream.writeStream.foreachBatch(judge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Held-out figures of the trained operators: ``python -m fidelis.llm.heldout sf_dir`` prints them for the registered queries."""

from __future__ import annotations

import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm.common import table
from fidelis.llm.queries import QUERIES


def toxicity_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: documents and toxic ones among the labelled held out, the area under the ROC curve, recall, and the share of others flagged.

    The area is worked out from counts by score, so no scores are collected; equal scores count half.
    """
    scored = QUERIES["op5_compression"](spark, sf_dir).filter("held_out").drop("held_out")
    kinds = table(spark, sf_dir, "labels").filter("toxic is not null").groupBy("doc_id").agg((F.max("toxic") > 0).alias("toxic"))
    by = scored.join(kinds, "doc_id").groupBy("score", "predicted").agg(F.count_if("toxic").alias("yes"), F.count_if(~F.col("toxic")).alias("no"))
    below = F.expr("sum(no) over (order by score rows between unbounded preceding and 1 preceding)")
    ranked = by.withColumn("pairs", F.col("yes") * (F.coalesce(below, F.lit(0)) + F.col("no") / 2))
    yes, no = F.sum("yes"), F.sum("no")
    flagged = lambda c: F.sum(F.when(F.col("predicted") == 1, F.col(c)).otherwise(0))
    return ranked.agg((yes + no).alias("documents"), yes.alias("toxic"), F.round(F.sum("pairs") / (yes * no), 4).alias("auc"),
                      F.round(flagged("yes") / yes, 4).alias("recall"), F.round(flagged("no") / no, 4).alias("flagged"))


def language_figures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row: held-out documents with a language, and the share predicted right."""
    found = QUERIES["op3_hyperdimensional"](spark, sf_dir).filter("held_out")
    known = table(spark, sf_dir, "documents").filter("lang is not null and text is not null").select("doc_id", "lang")
    return found.join(known, "doc_id").agg(F.count("*").alias("documents"), F.round(F.avg((F.col("lang_pred") == F.col("lang")).cast("int")), 4).alias("accuracy"))


if __name__ == "__main__":
    session = SparkSession.builder.config("spark.ui.enabled", "false").getOrCreate()
    for figures in (language_figures, toxicity_figures):
        print(figures.__name__, figures(session, sys.argv[1]).first().asDict())
    session.stop()

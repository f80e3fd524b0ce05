"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, tokens.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as Parquet and read again as the
next stage's ``docs``. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fidelis.llm import bpe, decontam, langid, linededup, neardup
from fidelis.llm.common import bounded, small_batches, table, written
from fidelis.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Cosine with the language's prototype below which a text of so many letters or more is taken to be in no learned language.
LEAST_SIMILARITY, LEAST_LETTERS = 0.05, 40
#: Ids of documents to drop that are broadcast, rather than shuffled together with all texts.
BROADCAST_IDS = 1_000_000


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without letters and texts unlike every language; ``lang`` becomes the predicted one.

    Null, empty and blank texts have no letters. Rows with a null id, and repeated rows, are judged like any other.
    Without a labelled row nothing can be predicted, and every text is rejected. Other columns than those of
    ``documents`` are dropped, as in all stages; an empty table gives an empty table.
    """
    small_batches(spark)
    found = langid.predict(docs.drop("lang"), langid.train(docs))
    letters = F.length(F.regexp_replace("text", r"\P{L}+", ""))
    kept = found.filter((F.col("lang_pred") != "und") & ((F.col("similarity") >= LEAST_SIMILARITY) | (letters < LEAST_LETTERS)))
    return kept.withColumnRenamed("lang_pred", "lang").select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops recurring lines but for their first document, and documents that have nothing left.

    Null, empty and blank texts have no lines to lose and stay as they are; rows that repeat an id are one document,
    rows without an id documents of their own text, after all others. ``n_chars`` is counted again.
    """
    small_batches(spark)
    found = linededup.dedup_lines(docs)
    kept = found.filter((F.col("n_dropped") == 0) | (F.col("n_dropped") < F.col("n_lines")))
    return kept.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near-copies: five-word shingles, a similarity of 0.8.

    It is the one with the smallest id. Null, empty and blank texts are copies of nothing and stay, as do rows without
    an id; rows that repeat an id stay or go together.
    """
    small_batches(spark)
    found = neardup.near_duplicates(docs).select(F.col("doc_id").alias("id"), "kept").groupBy("id").agg(F.max("kept").alias("kept"))
    gone = bounded(written(found.filter("not kept").select("id"), "copies"), BROADCAST_IDS)
    return docs.join(gone, docs["doc_id"] == gone["id"], "left_anti").select(*COLUMNS)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a passage of a benchmark item.

    Null, empty and blank texts hold none and stay; rows that share an id, or have none, are judged by their own texts.
    """
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The tokens of what is left, and whether they decode to the same text.

    A null or empty text has no tokens and decodes to an empty text. Rows repeat as they come.
    """
    small_batches(spark)
    coded = bpe.round_trip(docs, tokenizer_file())
    return coded.select(
        *COLUMNS, "token_ids", (F.octet_length("token_ids") / 4).cast("long").alias("n_tokens"),
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("benchmark", benchmark), ("tokens", tokens)]

#: SQL can't express the stages (trained prototypes, template trees, merging of tokens).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs

"""The corpus pipeline: five stages, each an operator of ``hexflow.llm``.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; between
stages the documents are written as Parquet and read again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hexflow.llm import decontaminate, jaccard_join, line_dedup, sentencepiece_dropout, toxicity
from hexflow.llm.shared import Tables


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar doesn't reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that match an earlier one; n_chars follows the text."""
    return line_dedup.dedup_lines(docs).select(*[F.length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return jaccard_join.drop_near_duplicates(docs)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule passes."""
    return decontaminate.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces: doc_id, n_pieces, ids."""
    encoded = sentencepiece_dropout.encode(docs, sentencepiece_dropout.Pieces.load(seed=1, dropout=0.1))
    return encoded.select(F.col("id").alias("doc_id"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_pieces"), "ids")


STAGES = [
    ("toxicity", toxicity_stage),
    ("line_dedup", line_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("benchmark_decontamination", benchmark_stage),
    ("sentencepiece_encoding", encoding_stage),
]

#: Learned weights and set-similarity components have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage keeps is written under spark.checkpoint.dir and goes once the next one is."""
    docs, tables, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), Tables(spark), None
    for _, stage in STAGES[:-1]:
        docs = tables.keep(stage(spark, docs, sf_dir))
        if before is not None:
            tables.drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)

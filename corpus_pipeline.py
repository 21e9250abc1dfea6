"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.  Whoever runs the stages may write each one's rows and read them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from sparkweave.llm import decontaminate, lines, mixing, near_dup, quality
from sparkweave.llm._blocks import shared_checkpoint_dir
from sparkweave.llm.queries import mix_weights, source_levels

#: The mix draws from documents more than once, so the last stage's rows are not SQL over documents.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or the certified cutoffs go."""
    return quality.good_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller doc_id holds too go; n_chars follows the text."""
    return lines.without_repeated_lines(docs, min_chars=10).withColumn("n_chars", F.length("text").cast("long"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays."""
    return near_dup.one_of_each_class(docs, similarity=0.8, words=5)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage close to a benchmark item go."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), max_edits=0.2)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The weighted mix: a row for each document and epoch that it is drawn in."""
    return mixing.mix(docs, source_levels(), mix_weights(spark), share=0.9, max_epochs=2)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what one keeps is checkpointed for the next."""
    shared_checkpoint_dir(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = docs.checkpoint()
    return docs

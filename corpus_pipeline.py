"""From raw documents to packed sequences: the text operators as stages, each over all that the one before kept.

Null and empty texts, repeated rows and empty tables pass through every stage as its operator defines; further columns
of ``documents`` are kept by all stages but the last, which returns the pieces of packed sequences.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import common, decontamination, line_dedup, packing, quality_model, simhash_dedup

#: The tokenizer that texts are packed with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = quality_model.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality_model.score(docs, model, keep=tuple(docs.columns), into="score__")
    return scored.where(quality_model.predicted(score="score__") == 1).drop("score__")


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that nearly repeat an earlier one go; every document stays, and n_chars follows its text."""
    kept = line_dedup.deduplicated(docs).drop("gone__")
    return kept.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else kept


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies stays: five-word shingles, Jaccard similarity 0.8 or more."""
    return simhash_dedup.deduplicated(docs, shingle=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark passage go, whether its words match exactly or each within the operator's slack."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    items = items.withColumn("item_id", F.coalesce(F.col("item_id").cast("string"), F.lit("")))  # near_items lists no null id
    found = decontamination.annotate(docs, items, keep=tuple(docs.columns), prefix="found__")
    return found.where((F.size("found__hit_runs") == 0) & (F.size("found__near_items") == 0)).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All remaining documents, cut into sequences."""
    return packing.pack(docs, TOKENIZER)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", quality),
    ("line dedup", lines),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("packing", pack),
]

#: The classifier's scores and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each but the last written as Parquet in the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        since = common.mark()
        docs = common.written_last(stage(spark, docs, sf_dir), name.replace(" ", "-"), since)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Five stages from raw documents to packed training sequences, each over all that the one before kept."""

from __future__ import annotations

import uuid
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from feedloom.llm import leaks, lines, neardup, packing, quality
from feedloom.llm.common import shared_dir


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    labels = quality.training_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.keep_quality(docs, quality.fit(docs, labels))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the boilerplate lines of their source; n_chars follows the text.

    The near-duplicates of a text are one page: the next stage keeps one of them, and its lines are
    not boilerplate for being in all of them.
    """
    key, component = (f"{name}_{uuid.uuid4().hex}" for name in ("key", "component"))  # no column of docs has these names
    groups = neardup.near_duplicates(docs).where("doc_id is not null").groupBy(F.col("doc_id").alias(key)).agg(F.min("component_id").alias(component))
    found = docs.join(groups, F.col("doc_id") == F.col(key), "left")
    page = F.coalesce(F.col(component).cast("string"), F.concat(F.lit("t"), F.col("text")))
    cleaned = lines.dedup_lines(found, page=page).select(*docs.columns)
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return cleaned


def neardup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: the least doc_id. Rows that repeat it stay together."""
    found = neardup.near_duplicates(docs)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, "doc_id", "left_anti").select(*docs.columns)


def leak_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return leaks.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents in sequences of 1024."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage), ("lines", line_stage), ("near_duplicates", neardup_stage), ("leaks", leak_stage), ("packing", packing_stage),
]

ORACLE_SQL: str | None = None  # trained models, minima and tokens are beyond SQL; tests hold each stage against plain code


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    root = f"{shared_dir(spark).rstrip('/')}/corpus-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        result = stage(spark, docs, sf_dir)
        result.write.parquet(f"{root}/{k}-{name}")
        docs = spark.read.schema(result.schema).parquet(f"{root}/{k}-{name}")
    return docs

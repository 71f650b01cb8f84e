"""Corpus pipeline: quality, line dedup, near-duplicates, decontamination, encoding; each stage one operator."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from afluente.llm import decontaminate, lines, pieces, quality, similar
from afluente.session import written


def _as_documents(rows: DataFrame) -> DataFrame:
    """The columns of documents, the length of the text counted again."""
    return rows.select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, trained on these documents' labels, scores at the threshold or above."""
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _as_documents(quality.keep_good(docs, model))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that three or more of them share but in the last one."""
    return _as_documents(lines.drop_repeated_lines(docs))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near SimHash fingerprints that have a 5-word Jaccard similarity of 0.8 or more."""
    return _as_documents(similar.without_near_duplicates(docs))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any item of the benchmark."""
    return _as_documents(decontaminate.without_contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document that is left, and the text decoded from them."""
    return pieces.encode_documents(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("simhash near-dedup", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("sentencepiece encoding and decoding", encoding_stage),
]

ORACLE_SQL = None  # classifier, fingerprints and encoding have no SQL


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""The corpus pipeline: from documents to piece ids, one operator a stage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from riskbench.llm import decontaminate, ngram_join, personal_data, quality, sentence_pieces
from riskbench.llm.common import table
from riskbench.llm.queries import tokenizer
from riskbench.session import new_path


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts. Rows with a null doc_id go: later stages could not name them."""
    scored = quality.classify(docs, table(spark, sf_dir, "labels"))
    accepted = scored.where((F.col("predicted") == 1) & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(accepted, "doc_id", "left_semi").select(docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates."""
    kept = ngram_join.components(docs).where(F.col("doc_id") == F.col("component_id")).select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.clean(docs, decontaminate.find_leaks(docs, table(spark, sf_dir, "benchmark")))


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what gives it away rewritten."""
    return personal_data.sanitise(docs)


def piece_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and the piece ids of each document."""
    return sentence_pieces.encode(docs, tokenizer("piece_bpe_32k.model"), remembered=100_000)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", good_quality),
    ("n-gram Jaccard join", one_of_each_group),
    ("benchmark decontamination", without_benchmark),
    ("PII", without_personal_data),
    ("SentencePiece encoding", piece_ids),
]

ORACLE_SQL = None  # a trained classifier and tokenizer are no SQL; tests/llm compares with a brute-force version


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; the rows of the last."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = new_path(spark, f"stage-{k}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

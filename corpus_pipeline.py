"""A corpus pipeline: toxic and poor documents go, one of each group of near copies stays, sources are mixed, texts become tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tideline.llm import bpe, mixing, neardup, quality, toxicity
from tideline.llm.queries import vocabulary_path
from tideline.session import cut_lineage


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below 0.3; the machine learns from ``labels`` on the documents at hand."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    columns = [c for c in docs.columns if c not in ("score", "predicted")]
    return toxicity.score(docs.select(columns), model).filter("predicted = 0").select(columns)


def poor_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and whose host is not rejected."""
    judged = quality.judge(docs)
    return judged.filter("kept").select([c for c in docs.columns if c in judged.columns])


def copies_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: five-word shingles, similarity 0.8 or more."""
    return neardup.one_per_group(docs, words=5)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes, a row per document and round."""
    return mixing.mixed_texts(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids of every row of the mix, and their digests. Rows of one document hold the words that different rounds took of it."""
    return bpe.round_trip(docs.select("doc_id", "source", "text"), vocabulary_path(), with_ids=True).drop("text")


STAGES = [("toxicity", toxic_out), ("quality rules", poor_out), ("near duplicates", copies_out), ("mixing sources", mixed), ("tokens", encoded)]
ORACLE_SQL = None  # a trained machine, sketches and tokens are not SQL; tests/llm compares stages with brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = cut_lineage(docs)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

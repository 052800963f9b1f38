"""The operators of this subpackage applied to whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
VOCABULARY = "byte_bpe_50k.json"


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def documents(spark: SparkSession, folder: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet").select(*columns)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


@query
def op5_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.tokens import count_tokens

    return count_tokens(documents(spark, folder, "doc_id", "text"), vocabulary_path()).drop("text")


@query
def op7_bpe_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.bpe import round_trip

    return round_trip(documents(spark, folder, "doc_id", "text"), vocabulary_path()).drop("text")


SHARD_LIMIT = 1 << 20
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


@query
def op2_shards(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm import sharding

    rows = documents(spark, folder, "doc_id", "text").select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), sharding.hash_bits("doc_id", "text").alias("hash"))
    return sharding.shard_rows(rows, SHARD_LIMIT)


@query
def op6_mixed_sources(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.mixing import taken

    return taken(documents(spark, folder, "doc_id", "source", "text")).drop("source")


@query
def op10_url_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """A page whose address ends in the number of a labelled document has that document's label."""
    from tideline.llm.urls import judge_urls, path_of

    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    labels = spark.read.parquet(f"{folder}/labels.parquet").groupBy(F.col("doc_id").cast("string").alias("_doc")).agg(
        F.min(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)).alias("good"))
    doc = F.nullif(F.regexp_extract(path_of(F.col("url")), r"/(\d+)(?:\.html)?/?$", 1), F.lit(""))
    labelled = pages.withColumn("_doc", doc).join(labels, "_doc", "left").drop("_doc")
    return judge_urls(labelled, RULES, label="good").select("page_id", "host", "path", "rule", "verdict", "template", "purity")


@query
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.quality import FEATURES, judge_ids

    return judge_ids(documents(spark, folder, "doc_id", "source", "text")).select("doc_id", *FEATURES, "base_failed", "kept")


@query
def op3_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.neardup import near_duplicates

    return near_duplicates(documents(spark, folder, "doc_id", "text"), words=4).drop("group_key", "row_key")


@query
def op4_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm import toxicity

    docs = documents(spark, folder, "doc_id", "text")
    model = toxicity.train(docs, spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


@query
def op8_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.fingerprints import edit_report, lexicon

    docs = documents(spark, folder, "doc_id", "text")
    return edit_report(docs, lexicon(docs))


@query
def op9_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.lm import language_scores

    return language_scores(documents(spark, folder, "doc_id", "text"))


@query
def op11_language_ids(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm import language
    from tideline.llm.toxicity import held_out

    docs = documents(spark, folder, "doc_id", "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    profiles = language.learn(docs.filter(~F.col("held_out")))
    return language.predict(docs.drop("lang"), profiles).drop("text")


@query
def op13_phrases(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.phrases import phrases

    return phrases(documents(spark, folder, "text", "lang"))


@query
def op12_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    from tideline.llm.tries import prefix_trie

    return prefix_trie(spark.read.parquet(f"{folder}/conversations.parquet"))


def _oracles() -> None:
    from tideline.llm import phrases, quality, sharding, tries

    ORACLES["op12_conversation_trie"] = tries.oracle_sql()

    ORACLES["op13_phrases"] = phrases.oracle_sql()

    ORACLES["op1_quality_rules"] = quality.oracle_sql()
    ORACLES["op2_shards"] = sharding.oracle_sql(SHARD_LIMIT)


_oracles()

"""Keyword routing of whole messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.text import fold_key


def keyword_dim(spark: SparkSession, rows) -> DataFrame:
    """(keyword, route, language or null); a list in the code, so Catalyst knows how small it is."""
    return spark.createDataFrame(rows, "keyword string, route string, kw_lang string")


def route_keyword(messages: DataFrame, keywords: DataFrame, text: str) -> DataFrame:
    """Adds ``route`` and ``kw_lang``: set only where the whole message is a keyword."""
    return (messages.withColumn("_folded", fold_key(text))
            .join(keywords, F.col("_folded") == F.col("keyword"), "left").drop("_folded", "keyword"))

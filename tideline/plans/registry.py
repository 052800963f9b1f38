"""Where queries and their SQL twins are collected."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a plan under ``name``; ``sql`` is the same question for another engine."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def quoted(values) -> str:
    """SQL list of string literals."""
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# SQL fragments shared by the twins.
SQL_NON_WORD = r"[^\p{L}\p{N}_]+"


def sql_norm(text: str) -> str:
    return f"trim(regexp_replace(lower({text}), '{SQL_NON_WORD}', ' ', 'g'))"


def sql_strip(text: str) -> str:
    return rf"regexp_replace({text}, '^\s+|\s+$', '', 'g')"


def sql_phrases(text: str, phrases, plural: bool = False) -> str:
    body = "|".join(p.replace("'", "''") for p in phrases)
    return (rf"regexp_matches({text}, '(?i)(^|[^\p{{L}}\p{{N}}_])(?:{body}){'s?' if plural else ''}"
            rf"($|[^\p{{L}}\p{{N}}_])')")


def sql_hits(text: str, phrases) -> str:
    return " + ".join(f"CAST({sql_phrases(text, [p], plural=True)} AS INT)" for p in phrases)

"""Token usage and cost estimates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.dims import fixed


def text_tokens(chars: Column) -> Column:
    return chars / fixed.CHARS_PER_TOKEN


def image_tokens(width: Column, height: Column) -> Column:
    """Tokens of an image: its area after the long edge is scaled down, up to the cap."""
    longest = F.greatest(width, height)
    scale = F.when(longest > fixed.IMAGE_LONG_EDGE, fixed.IMAGE_LONG_EDGE / longest).otherwise(F.lit(1.0))
    return F.least(F.ceil(width * scale * (height * scale) / fixed.IMAGE_PIXELS_PER_TOKEN), F.lit(fixed.IMAGE_TOKEN_CAP))


def max_output_tokens(n: Column) -> Column:
    return 200 + 120 * n


def expected_output_tokens(n: Column) -> Column:
    return 70 + 55 * n


def usage_means(df: DataFrame, by: str, tokens_in: str, tokens_out: str) -> DataFrame:
    """Mean tokens per call and number of calls, calls without usage left out."""
    used = df.filter(F.col(tokens_in).isNotNull() & F.col(tokens_out).isNotNull())
    return used.groupBy(by).agg(F.round(F.avg(tokens_in), 6).alias("mean_in"), F.round(F.avg(tokens_out), 6).alias("mean_out"),
                                F.count("*").alias("calls"))


def with_rates(df: DataFrame, rates: DataFrame, model: str, override: tuple[float | None, float | None] = (None, None)) -> DataFrame:
    """Adds ``rate_in`` and ``rate_out`` per million tokens; an unknown model has none.

    An override counts only if both of its parts are given.
    """
    out = df.join(rates.select(F.col("model").alias(model), "rate_in", "rate_out"), model, "left")
    if None in override:
        return out
    return out.withColumn("rate_in", F.lit(float(override[0]))).withColumn("rate_out", F.lit(float(override[1])))


def usd(tokens_in: Column, tokens_out: Column) -> Column:
    return (tokens_in * F.col("rate_in") + tokens_out * F.col("rate_out")) / 1e6


def cost_estimate(calls: DataFrame, by: str) -> DataFrame:
    """Totals per group: expected, worst and batch cost of calls with ``tokens_in``, ``out_expected``,
    ``out_max`` and their rates."""
    expected = F.sum(usd(F.col("tokens_in"), F.col("out_expected")))
    worst = F.sum(usd(F.col("tokens_in"), F.col("out_max")))
    return calls.groupBy(by).agg(
        F.count("*").alias("calls"), F.round(F.sum("tokens_in"), 4).alias("total_in"), F.sum("out_expected").alias("total_out"),
        F.round(expected, 6).alias("usd_expected"), F.round(worst, 6).alias("usd_worst"),
        F.round(expected * fixed.BATCH_DISCOUNT, 6).alias("usd_batch"))

"""Token and cost reports over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import cost as cs
from tideline.plans.registry import query, table

RATES = [("model-s", 1.0, 5.0), ("model-m", 3.0, 15.0)]  # per million tokens: in, out
SQL_RATES = "(VALUES " + ", ".join(f"('{m}', {a}::DOUBLE, {b}::DOUBLE)" for m, a, b in RATES) + ") r(model, rate_in, rate_out)"
SQL_CALLS = """calls AS (SELECT doc_id, lang, CASE CAST(substr(source, 4) AS INT) % 3 WHEN 0 THEN 'model-s' WHEN 1 THEN 'model-m' ELSE 'model-x' END AS model,
      n_chars / 3.5::DOUBLE + least(ceil((200 + n_chars) * s * (400 * s) / 750), 1600) AS tokens_in, n,
      70 + 55 * n AS out_expected, 200 + 120 * n AS out_max
    FROM (SELECT *, n_chars % 3 + 1 AS n, CASE WHEN greatest(200 + n_chars, 400) > 1568 THEN 1568 / greatest(200 + n_chars, 400)::DOUBLE ELSE 1.0::DOUBLE END AS s
          FROM documents))"""


def rates(spark):
    return spark.createDataFrame(RATES, "model string, rate_in double, rate_out double")


def calls(spark, sf):
    """One model call per document: its text, and an image as wide as the text is long."""
    n = F.col("n_chars") % 3 + 1
    model = F.element_at(F.array(F.lit("model-s"), F.lit("model-m"), F.lit("model-x")), F.regexp_extract("source", r"(\d+)", 1).cast("int") % 3 + 1)
    return table(spark, sf, "documents").select(
        "doc_id", "lang", model.alias("model"), n.alias("n"),
        (cs.text_tokens(F.col("n_chars")) + cs.image_tokens(F.col("n_chars") + 200, F.lit(400))).alias("tokens_in"),
        cs.expected_output_tokens(n).alias("out_expected"), cs.max_output_tokens(n).alias("out_max"))


@query("usage_means", f"WITH {SQL_CALLS} SELECT model, round(avg(tokens_in), 6) AS mean_in, round(avg(out_expected), 6) AS mean_out, count(*) AS calls FROM calls GROUP BY 1")
def _(spark, sf):
    return cs.usage_means(calls(spark, sf), "model", "tokens_in", "out_expected")


@query("price_usage", f"""WITH {SQL_CALLS} SELECT doc_id, model, round((tokens_in * rate_in + out_expected * rate_out) / 1e6, 9) AS usd
    FROM calls LEFT JOIN {SQL_RATES} USING (model)""")
def _(spark, sf):
    priced = cs.with_rates(calls(spark, sf), rates(spark), "model")
    return priced.select("doc_id", "model", F.round(cs.usd(F.col("tokens_in"), F.col("out_expected")), 9).alias("usd"))


@query("cost_estimate", f"""WITH {SQL_CALLS} SELECT model, count(*) AS calls, round(sum(tokens_in), 4) AS total_in, CAST(sum(out_expected) AS BIGINT) AS total_out,
      round(sum((tokens_in * rate_in + out_expected * rate_out) / 1e6), 6) AS usd_expected,
      round(sum((tokens_in * rate_in + out_max * rate_out) / 1e6), 6) AS usd_worst,
      round(sum((tokens_in * rate_in + out_expected * rate_out) / 1e6) * 0.5::DOUBLE, 6) AS usd_batch
    FROM calls LEFT JOIN {SQL_RATES} USING (model) GROUP BY 1""")
def _(spark, sf):
    return cs.cost_estimate(cs.with_rates(calls(spark, sf), rates(spark), "model"), "model")


@query("cost_override", f"""WITH {SQL_CALLS} SELECT lang, count(*) AS calls, round(sum(tokens_in), 4) AS total_in, CAST(sum(out_expected) AS BIGINT) AS total_out,
      round(sum((tokens_in * 2.0::DOUBLE + out_expected * 8.0::DOUBLE) / 1e6), 6) AS usd_expected,
      round(sum((tokens_in * 2.0::DOUBLE + out_max * 8.0::DOUBLE) / 1e6), 6) AS usd_worst,
      round(sum((tokens_in * 2.0::DOUBLE + out_expected * 8.0::DOUBLE) / 1e6) * 0.5::DOUBLE, 6) AS usd_batch FROM calls GROUP BY 1""")
def _(spark, sf):
    return cs.cost_estimate(cs.with_rates(calls(spark, sf), rates(spark), "model", (2.0, 8.0)), "lang")

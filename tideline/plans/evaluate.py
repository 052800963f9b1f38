"""Evaluation reports over the scored embeddings; latency and delivery over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.functions import decision as dec
from tideline.operators import evaluate as ev
from tideline.operators import score as sc
from tideline.operators import splits as sp
from tideline.plans.registry import query, table
from tideline.plans.score import CLASSES, OTHER, SAVED, SQL_OPINIONS, SQL_SCORED, TEMP, opinions, scored, sql_scored
from tideline.plans.text import sql_decide


def sql_pred(source="scored", t=SAVED):
    return f"(SELECT *, CASE WHEN entropy > {t} THEN 'unknown' ELSE top END AS pred FROM {source})"


def judged(spark, sf, **kw):
    return sc.abstain(scored(spark, sf, **kw)[0], SAVED)


@query("outcome_rates", f"""
    WITH {SQL_SCORED}, o AS (SELECT *, CASE WHEN pred = 'unknown' THEN 'abstain' WHEN pred = truth THEN 'correct' ELSE 'error' END AS o
      FROM {sql_pred()}),
    c AS (SELECT count(*) AS n, count(*) FILTER (o = 'correct') AS correct, count(*) FILTER (o = 'error') AS errors,
      count(*) FILTER (o = 'abstain') AS handoffs, count(*) FILTER (o = 'abstain' AND truth = '{OTHER}') AS handoffs_on_other,
      count(*) FILTER (o = 'error' AND pred = '{OTHER}' AND truth <> '{OTHER}') AS missed FROM o)
    SELECT *, round(correct / n, 6) AS correct_rate, round(errors / n, 6) AS error_rate, round(handoffs / n, 6) AS handoff_rate,
      round(correct / nullif(correct + errors, 0), 6) AS accuracy_answered FROM c""")
def _(spark, sf):
    return ev.outcome_rates(judged(spark, sf), other=OTHER)


@query("threshold_sweep", f"""
    WITH {SQL_SCORED}, grid AS (SELECT unnest([0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.45, 1.0])::DOUBLE AS threshold)
    SELECT threshold, threshold = 0.45::DOUBLE AS saved,
      round(count(*) FILTER (entropy <= threshold AND top = truth) / nullif(count(*) FILTER (entropy <= threshold), 0), 6) AS precision,
      round(count(*) FILTER (entropy > threshold) / count(*), 6) AS handoff_rate,
      round(count(*) FILTER (entropy <= threshold AND top <> truth) / count(*), 6) AS error_rate
    FROM scored, grid GROUP BY 1""")
def _(spark, sf):
    return ev.threshold_sweep(scored(spark, sf)[0], saved=0.45)


@query("confusion_matrix", f"WITH {SQL_SCORED} SELECT truth, " + ", ".join(
    f"count(*) FILTER (pred = '{c}') AS {c}" for c in (*CLASSES, "unknown")) + f" FROM {sql_pred()} GROUP BY truth")
def _(spark, sf):
    return ev.confusion_matrix(judged(spark, sf), CLASSES)


@query("outcomes_by_label", f"""WITH {SQL_SCORED} SELECT truth, count(*) FILTER (pred = truth) AS correct,
      count(*) FILTER (pred <> truth AND pred <> 'unknown') AS error, count(*) FILTER (pred = 'unknown') AS abstain
    FROM {sql_pred()} GROUP BY truth""")
def _(spark, sf):
    return ev.outcomes_by_label(judged(spark, sf))


@query("classification_report", f"""
    WITH {SQL_SCORED}, c AS (SELECT l.cls AS label, (SELECT count(*) FROM scored WHERE truth = l.cls AND top = l.cls) AS hit,
        (SELECT count(*) FROM scored WHERE truth = l.cls) AS support, (SELECT count(*) FROM scored WHERE top = l.cls) AS said
      FROM (SELECT DISTINCT cls FROM coef) l),
    pr AS (SELECT *, coalesce(hit / nullif(said, 0), 0) AS p, coalesce(hit / nullif(support, 0), 0) AS r FROM c)
    SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(coalesce(2 * p * r / nullif(p + r, 0), 0), 6) AS f1, support FROM pr""")
def _(spark, sf):
    return ev.classification_report(scored(spark, sf)[0])


@query("log_loss", f"WITH {SQL_SCORED} SELECT round(avg(-ln(greatest(p_true, 1e-15))), 6) AS log_loss, count(*) AS n FROM scored")
def _(spark, sf):
    rows, head = scored(spark, sf, keep_proba=True)
    return ev.log_loss(rows, head.classes)


T_GRID = (0.02, 0.03, 0.05, 0.1, 0.3, 1.0)


@query("temperature_grid", f"""
    WITH {SQL_SCORED}, nll AS (SELECT t, vec_id, ln(sum(exp((z - m) / t))) - max(z - m) FILTER (cls = truth) / t AS v
      FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS m FROM logit), (SELECT unnest({list(T_GRID)})::DOUBLE AS t) GROUP BY 1, 2)
    SELECT t AS temperature, round(avg(v), 6) AS nll FROM nll GROUP BY 1""")
def _(spark, sf):
    rows, head = scored(spark, sf, temperature=1.0, keep_proba=True)
    idx = sc.true_index(F.col("truth"), head.classes)
    wide = rows.agg(*[F.avg(sc.nll(F.col("logits"), idx, t)).alias(f"t{i}") for i, t in enumerate(T_GRID)])
    lines = F.explode(F.array(*[F.struct(F.lit(t).alias("temperature"), F.round(f"t{i}", 6).alias("nll")) for i, t in enumerate(T_GRID)]))
    return wide.select(lines.alias("r")).select("r.*")


def sql_fit(rounds: int = 4, points: int = 12) -> str:
    """The rounds of the fit one after the other; ``b<rounds>`` has the fitted temperature."""
    lo, hi = fixed.TEMPERATURE_BOUNDS
    steps = [f"top_ AS MATERIALIZED (SELECT vec_id, truth, cls, z, max(z) OVER (PARTITION BY vec_id) AS m FROM logit), b0 AS (SELECT ln({lo}::DOUBLE) AS lo, ln({hi}::DOUBLE) AS hi)"]
    for i in range(1, rounds + 1):
        steps.append(f"""g{i} AS MATERIALIZED (SELECT lo, hi, (hi - lo) / {points - 1} AS step, exp(lo + k * ((hi - lo) / {points - 1})) AS t FROM b{i - 1}, (SELECT unnest(range({points})) AS k)),
    n{i} AS (SELECT t, avg(v) AS v FROM (SELECT t, vec_id, ln(sum(exp((z - m) / t))) - max(z - m) FILTER (cls = truth) / t AS v FROM top_, g{i} GROUP BY 1, 2) GROUP BY 1),
    b{i} AS MATERIALIZED (SELECT best, greatest(lo, ln(best) - step) AS lo, least(hi, ln(best) + step) AS hi FROM (SELECT arg_min(t, v) AS best FROM n{i}), (SELECT DISTINCT lo, hi, step FROM g{i}))""")
    return ",\n    ".join(steps)


@query("fit_temperature", f"""
    WITH {SQL_SCORED}, {sql_fit()}
    SELECT CAST(floor(p_top * 10) AS BIGINT) AS tenth, count(*) AS n, max(t) AS temperature
    FROM (SELECT vec_id, 1 / sum(exp((z - m) / best)) AS p_top, round(max(best), 6) AS t FROM top_, b4 GROUP BY 1) GROUP BY 1""")
def _(spark, sf):
    """Rows scored at the fitted temperature: how the confidence spreads."""
    rows, head = scored(spark, sf, temperature=1.0, keep_proba=True)
    t = sc.fit_temperature(rows, head.classes, "truth")
    again = sc.score_linear(table(spark, sf, "embeddings").select("vec_id", "embedding"), head.with_temperature(t))
    return again.groupBy(F.floor(F.col("p_top") * 10).alias("tenth")).agg(F.count("*").alias("n"), F.lit(round(t, 6)).alias("temperature"))


def sql_threshold(target: float) -> str:
    return f"""WITH {SQL_SCORED}, cand AS (SELECT DISTINCT round_even(entropy, 4) AS t FROM scored UNION SELECT 1.0),
    cov AS (SELECT t, count(*) FILTER (entropy <= t) AS k, count(*) FILTER (entropy <= t AND top = truth) AS ok, count(*) AS n
      FROM scored, cand GROUP BY t),
    usable AS (SELECT t, k / n AS cov, ok / k AS acc FROM cov WHERE k >= 0.3 * n),
    best AS (SELECT *, acc >= {target} AS reached FROM usable
      ORDER BY reached DESC, CASE WHEN acc >= {target} THEN cov ELSE acc END DESC, cov DESC, t LIMIT 1)
    SELECT t::DOUBLE AS threshold, round(cov, 6) AS coverage, round(acc, 6) AS accuracy, reached FROM best"""


@query("choose_threshold", sql_threshold(0.99))
def _(spark, sf):
    return ev.choose_threshold(scored(spark, sf)[0], 0.99)


@query("choose_threshold_reached", sql_threshold(0.25))
def _(spark, sf):
    return ev.choose_threshold(scored(spark, sf)[0], 0.25)


@query("recall_by_label", f"""
    WITH {SQL_SCORED} SELECT truth, count(*) AS n, round(count(*) FILTER (pred = truth) / count(*), 6) AS recall
    FROM {sql_pred()} WHERE CAST('0x' || substr(sha256('0:' || vec_id), 1, 8) AS BIGINT) >= CAST(floor(0.7::DOUBLE * 4294967296) AS BIGINT)
    GROUP BY 1""")
def _(spark, sf):
    held = sp.hash_splits(judged(spark, sf), "vec_id").filter("split <> 'train'")
    return ev.recall_by_label(held)


@query("compare_runs", f"""
    WITH {SQL_SCORED}, {sql_scored(temp=0.1, suffix='2')}, j AS (SELECT a.truth, a.pred AS a, b.pred AS b
      FROM {sql_pred('scored')} a JOIN {sql_pred('scored2')} b USING (vec_id)),
    m AS (SELECT 'correct' AS metric, count(*) FILTER (a = truth) AS a, count(*) FILTER (b = truth) AS b, count(*) AS n,
            count(*) FILTER (a <> b) AS changed FROM j
      UNION ALL SELECT 'error', count(*) FILTER (a <> truth AND a <> 'unknown'), count(*) FILTER (b <> truth AND b <> 'unknown'), count(*),
            count(*) FILTER (a <> b) FROM j
      UNION ALL SELECT 'handoff', count(*) FILTER (a = 'unknown'), count(*) FILTER (b = 'unknown'), count(*), count(*) FILTER (a <> b) FROM j)
    SELECT metric, round(a / n, 6) AS before, round(b / n, 6) AS after, round((b - a) * 100.0::DOUBLE / n, 6) AS points, changed FROM m""")
def _(spark, sf):
    return ev.compare_runs(judged(spark, sf), judged(spark, sf, temperature=0.1), "vec_id")


@query("changed_rows", f"""
    WITH {SQL_SCORED}, {sql_scored(temp=0.1, suffix='2')} SELECT vec_id, a.pred AS before, b.pred AS after
    FROM {sql_pred('scored')} a JOIN {sql_pred('scored2')} b USING (vec_id) WHERE a.pred <> b.pred""")
def _(spark, sf):
    return ev.changed_rows(judged(spark, sf), judged(spark, sf, temperature=0.1), "vec_id")


@query("chain_summary", f"""
    WITH {SQL_OPINIONS} SELECT lang, count(*) AS n, count(*) FILTER (label = truth) AS classifier_ok,
      count(*) FILTER (llm_label = truth) AS second_ok,
      count(*) FILTER (truth <> 'other' AND decision = 'answer' AND label = truth) AS correct_advice,
      count(*) FILTER (truth <> 'other') AS should_answer, count(*) FILTER (decision = 'answer' AND label <> truth) AS wrong_advice,
      round(avg(n_chars / 1000.0::DOUBLE), 6) AS mean_seconds, count(*) FILTER (decision = 'answer') AS n_answer,
      count(*) FILTER (decision = 'clarify') AS n_clarify, count(*) FILTER (decision = 'escalate') AS n_escalate
    FROM {sql_decide('both_', 'false')} JOIN documents ON doc_id = vec_id GROUP BY lang""")
def _(spark, sf):
    v = dec.decide("label", "proba", "llm_label", "llm_sure", False)
    rows = opinions(spark, sf).withColumn("decision", v["decision"]).withColumn(
        "expected", F.when(F.col("truth") != "other", "answer").otherwise("escalate"))
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), "lang", (F.col("n_chars") / 1000.0).alias("seconds"))
    return ev.chain_summary(rows.join(docs, "vec_id"), "lang")


@query("latency_stats", """SELECT event_type, round(median(value), 6) AS median, max(value) AS worst, round(avg(value), 6) AS mean,
    count(*) AS n FROM events GROUP BY 1""")
def _(spark, sf):
    return ev.latency_stats(table(spark, sf, "events"), "event_type", "value")


@query("delivery_report", """
    SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN status >= 300 THEN 'refused' WHEN k % 4 = 0 THEN 'unreadable'
      WHEN k % 4 IN (1, 2) THEN 'nobody' ELSE 'delivered' END AS outcome
      FROM (SELECT 200 + CAST(floor(value) AS INT) AS status, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)) GROUP BY 1""")
def _(spark, sf):
    k = F.get_json_object("props", "$.k").cast("int")
    body = (F.when(k % 8 == 0, "<html>").when(k % 4 == 0, F.col("props"))
             .when(k % 4 == 1, '{"SMSMessageData": {"Message": "none", "Recipients": []}}')
             .when(k % 4 == 2, '{"SMSMessageData": {"Message": "InvalidSenderId"}}')
             .otherwise(F.format_string('{"SMSMessageData": {"Recipients": [{"number": "%d"}]}}', "user_id")))
    rows = table(spark, sf, "events").select((F.lit(200) + F.floor("value")).alias("status"), body.alias("body"))
    return rows.groupBy(ev.delivery_outcome(F.col("status"), F.col("body")).alias("outcome")).agg(F.count("*").alias("n"))

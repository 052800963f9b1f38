"""Centroid head over the embeddings table: scoring, abstention, second opinions."""

from __future__ import annotations

import math


from pyspark.sql import functions as F

from tideline.functions import decision as dec
from tideline.operators import score as sc
from tideline.operators import splits as sp
from tideline.plans.registry import query, table

DIM, HALF, TEMP, SAVED, OTHER = 64, 32, 0.05, 0.5, "c0"
CLASSES = tuple(f"c{i}" for i in range(10))


def vectors(spark, sf):
    return table(spark, sf, "embeddings").select("vec_id", F.concat(F.lit("c"), "label").alias("truth"), "embedding")


def scored(spark, sf, dim=DIM, temperature=TEMP, keep_proba=False):
    """Every vector scored by the centroid head of its first ``dim`` numbers."""
    rows = vectors(spark, sf)
    part = F.slice("embedding", 1, dim) if dim < DIM else F.col("embedding")
    head = sc.centroid_head(rows, "truth", F.col("embedding"), dim, temperature)
    return sc.score_linear(rows, head, part, keep_proba).drop("embedding"), head


def sql_scored(dim: int = DIM, temp: float = TEMP, suffix: str = "") -> str:
    """CTEs ``probs`` (one row per vector and class) and ``scored`` (one row per vector)."""
    s = suffix
    return f"""cells{s} AS (SELECT vec_id, 'c' || label AS truth, unnest(embedding[1:{dim}])::DOUBLE AS x,
        unnest(range(1, {dim} + 1)) AS i FROM embeddings),
    mean{s} AS (SELECT truth AS cls, i, avg(x) AS m FROM cells{s} GROUP BY 1, 2),
    coef{s} AS (SELECT cls, i, m / sqrt(sum(m * m) OVER (PARTITION BY cls)) AS w FROM mean{s}),
    logit{s} AS (SELECT vec_id, truth, cls, sum(x * w) AS z FROM cells{s} JOIN coef{s} USING (i) GROUP BY 1, 2, 3),
    probs{s} AS (SELECT vec_id, truth, cls, z, e / sum(e) OVER (PARTITION BY vec_id) AS p FROM (
        SELECT *, exp(z / {temp}::DOUBLE - max(z / {temp}::DOUBLE) OVER (PARTITION BY vec_id)) AS e FROM logit{s})),
    scored{s} AS (SELECT vec_id, truth, arg_max(cls, p) AS top, max(p) AS p_top,
        -sum(p * ln(greatest(p, 1e-12))) / ln({len(CLASSES)}) AS entropy,
        max(p) FILTER (cls = truth) AS p_true FROM probs{s} GROUP BY 1, 2)"""


SQL_SCORED = sql_scored()


@query("score_linear", f"WITH {SQL_SCORED} SELECT vec_id, truth, top, round(p_top, 6) AS p_top, round(entropy, 6) AS entropy FROM scored")
def _(spark, sf):
    return scored(spark, sf)[0].select("vec_id", "truth", "top", F.round("p_top", 6).alias("p_top"), F.round("entropy", 6).alias("entropy"))


@query("class_probabilities", f"WITH {SQL_SCORED} SELECT vec_id, cls, round(p, 6) AS p FROM probs")
def _(spark, sf):
    rows, head = scored(spark, sf, keep_proba=True)
    return (rows.select("vec_id", F.posexplode("proba").alias("i", "p"))
            .select("vec_id", F.concat(F.lit("c"), "i").alias("cls"), F.round("p", 6).alias("p")))


@query("centroid_head", f"WITH {SQL_SCORED} SELECT cls, CAST(i AS INT) AS i, round(w, 6) AS w FROM coef")
def _(spark, sf):
    rows = vectors(spark, sf)
    means = rows.groupBy(F.col("truth").alias("cls")).agg(F.array(*[
        F.avg(F.get("embedding", F.lit(i)).cast("double")) for i in range(DIM)]).alias("m"))
    norm = F.sqrt(F.aggregate("m", F.lit(0.0), lambda a, x: a + x * x))
    return (means.select("cls", norm.alias("norm"), F.posexplode("m").alias("pos", "m"))
            .select("cls", (F.col("pos") + 1).alias("i"), F.round(F.col("m") / F.col("norm"), 6).alias("w")))


@query("abstain", f"""WITH {SQL_SCORED} SELECT 'entropy' AS rule, CASE WHEN entropy > {SAVED} THEN 'unknown' ELSE top END AS pred,
      count(*) AS n FROM scored GROUP BY 2
    UNION ALL SELECT 'probability', CASE WHEN p_top >= 0.8 THEN top ELSE 'other' END, count(*) FROM scored GROUP BY 2""")
def _(spark, sf):
    rows = scored(spark, sf)[0]
    a = sc.abstain(rows, SAVED).select(F.lit("entropy").alias("rule"), "pred")
    b = sc.abstain_on_probability(rows, 0.8).select(F.lit("probability").alias("rule"), "pred")
    return a.unionByName(b).groupBy("rule", "pred").agg(F.count("*").alias("n"))


def opinions(spark, sf):
    """First opinion: all dimensions. Second: the first half, and only where it is not too vague."""
    first = scored(spark, sf)[0]
    second = (scored(spark, sf, HALF)[0].filter("p_top >= 0.3")
              .select("vec_id", F.col("top").alias("llm_label"), (F.col("p_top") >= 0.6).alias("llm_sure")))
    name = lambda c: F.when(F.col(c) == OTHER, dec.OTHER).otherwise(F.col(c))
    both = first.join(second, "vec_id", "left")
    return both.select("vec_id", name("truth").alias("truth"), name("top").alias("label"), F.col("p_top").alias("proba"),
                       name("llm_label").alias("llm_label"), "llm_sure")


SQL_OPINIONS = f"""{SQL_SCORED}, {sql_scored(HALF, TEMP, '2')},
    both_ AS (SELECT a.vec_id, CASE a.truth WHEN '{OTHER}' THEN 'other' ELSE a.truth END AS truth,
        CASE a.top WHEN '{OTHER}' THEN 'other' ELSE a.top END AS label, a.p_top AS proba,
        CASE b.top WHEN '{OTHER}' THEN 'other' ELSE b.top END AS llm_label, b.p_top >= 0.6 AS llm_sure
      FROM scored a LEFT JOIN (SELECT * FROM scored2 WHERE p_top >= 0.3) b USING (vec_id))"""

from tideline.plans.text import sql_decide  # noqa: E402


@query("two_model_agreement", f"""WITH {SQL_OPINIONS} SELECT label, decision, reason, template_id, count(*) AS n
    FROM {sql_decide('both_', 'false')} GROUP BY ALL""")
def _(spark, sf):
    v = dec.decide("label", "proba", "llm_label", "llm_sure", False)
    return (opinions(spark, sf).select(v.alias("v")).select("v.label", "v.decision", "v.reason", "v.template_id")
            .groupBy("label", "decision", "reason", "template_id").agg(F.count("*").alias("n")))


@query("pick_evidence", f"""WITH {SQL_SCORED}, {sql_scored(HALF, TEMP, '2')}
    SELECT vec_id, CASE WHEN alone THEN al ELSE cl END AS label, round(CASE WHEN alone THEN ap ELSE cp END, 6) AS proba,
           CASE WHEN alone THEN 'answer' ELSE 'combined' END AS evidence
    FROM (SELECT *, al <> 'other' AND ap >= 0.8 AND ap > cp AS alone FROM (
      SELECT a.vec_id, CASE b.top WHEN '{OTHER}' THEN 'other' ELSE b.top END AS al, b.p_top AS ap,
             CASE a.top WHEN '{OTHER}' THEN 'other' ELSE a.top END AS cl, a.p_top AS cp
      FROM scored a JOIN scored2 b USING (vec_id)))""")
def _(spark, sf):
    name = lambda c: F.when(F.col(c) == OTHER, dec.OTHER).otherwise(F.col(c))
    whole = scored(spark, sf)[0].select("vec_id", name("top").alias("cl"), F.col("p_top").alias("cp"))
    reply = scored(spark, sf, HALF)[0].select("vec_id", name("top").alias("al"), F.col("p_top").alias("ap"))
    return (whole.join(reply, "vec_id").select("vec_id", dec.pick_evidence(("al", "ap"), ("cl", "cp")).alias("e"))
            .select("vec_id", "e.label", F.round("e.proba", 6).alias("proba"), "e.evidence"))


@query("train_head", """
    SELECT split, count(*) AS n, true AS learnt, true AS optimal FROM (SELECT CASE WHEN p < CAST(floor(0.7::DOUBLE * 4294967296) AS BIGINT) THEN 'train'
      WHEN p < CAST(floor(0.85::DOUBLE * 4294967296) AS BIGINT) THEN 'calib' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(sha256('0:' || vec_id), 1, 8) AS BIGINT) AS p FROM embeddings)) GROUP BY 1""")
def _(spark, sf):
    """Logistic regression trained on one split, penalty chosen on the next: rows scored per split, whether on the training rows the
    loss is below that of a head of zeros, and whether the gradient of the penalised loss vanishes, which it does at the one best head only."""
    rows = sp.hash_splits(vectors(spark, sf), "vec_id")
    train = rows.filter("split = 'train'")
    head, losses = sc.train_head(train, rows.filter("split = 'calib'"), "truth")
    pred = sc.score_linear(rows, head, keep_proba=True)
    loss = sc.nll_by_temperature(pred.filter("split = 'train'"), head.classes, "truth", [1.0])[0][1]
    steepest = sc.head_gradient(train, head, "truth", min(losses, key=losses.get)).agg(F.max(F.abs("gradient"))).first()[0]
    return pred.groupBy("split").agg(F.count("*").alias("n")).withColumns(
        {"learnt": F.lit(bool(loss < math.log(len(head.classes)))), "optimal": F.lit(bool(steepest < 1e-5))})


@query("split_counts", """
    SELECT split, 'c' || label AS label, count(*) AS n FROM (SELECT *, CASE WHEN p < CAST(floor(0.7::DOUBLE * 4294967296) AS BIGINT) THEN 'train'
      WHEN p < CAST(floor(0.85::DOUBLE * 4294967296) AS BIGINT) THEN 'calib' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(sha256('0:' || vec_id), 1, 8) AS BIGINT) AS p FROM embeddings)) GROUP BY 1, 2""")
def _(spark, sf):
    rows = sp.hash_splits(vectors(spark, sf), "vec_id")
    return rows.groupBy("split", F.col("truth").alias("label")).agg(F.count("*").alias("n"))

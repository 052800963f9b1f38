"""Linear heads over embeddings: fitting, calibrated scoring, temperature, abstention."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.functions.vector import let, total
from tideline.session import cut_lineage

MAX_CLASSES = 10_000
_SCORE_TYPE = "struct<logits:array<double>,proba:array<double>,top:int,p_top:double,entropy:double>"


@dataclass(frozen=True)
class LinearHead:
    """A fitted linear classifier: k x d numbers, so it may travel with the plan."""

    classes: tuple[str, ...]
    coef: np.ndarray
    intercept: np.ndarray
    temperature: float = 1.0
    entropy_threshold: float = 1.0
    reject: str = "unknown"

    def with_temperature(self, t: float) -> LinearHead:
        return replace(self, temperature=t)


def score_linear(df: DataFrame, head: LinearHead, embedding="embedding", keep_proba: bool = False) -> DataFrame:
    """Adds ``top`` (class of the largest probability), ``p_top`` and ``entropy``; on request
    ``logits`` and ``proba`` too.

    The k x d products run as one matrix product per Arrow batch; array lambdas do them one
    number at a time.
    """
    coef, bias, temp = np.asarray(head.coef, dtype=np.float64), np.asarray(head.intercept), head.temperature
    k, d = coef.shape

    @F.arrow_udf(_SCORE_TYPE)
    def score(vectors: pa.Array) -> pa.Array:
        if isinstance(vectors, pa.ChunkedArray):
            vectors = vectors.combine_chunks()
        given = vectors.drop_null()
        x = np.asarray(given.flatten(), dtype=np.float64).reshape(len(given), d)
        logits = x @ coef.T + bias
        z = logits / temp
        e = np.exp(z - z.max(axis=1, keepdims=True)) if len(z) else z
        p = e / e.sum(axis=1, keepdims=True)
        h = -(p * np.log(np.maximum(p, 1e-12))).sum(axis=1) / math.log(k)
        top = p.argmax(axis=1) if len(p) else np.zeros(0, dtype=np.int64)
        offsets = pa.array(np.arange(len(z) + 1, dtype=np.int32) * k, type=pa.int32())
        lists = [pa.ListArray.from_arrays(offsets, pa.array(m.ravel())) for m in (logits, p)]
        best = p.max(axis=1) if len(p) else np.zeros(0)
        out = pa.StructArray.from_arrays([*lists, pa.array(top.astype(np.int32)), pa.array(best), pa.array(h)],
                                          names=["logits", "proba", "top", "p_top", "entropy"])
        if not vectors.null_count:
            return out
        missing = np.asarray(vectors.is_null())
        return out.take(pa.array(np.cumsum(~missing) - 1, mask=missing))  # a missing vector has no score

    vec = F.col(embedding) if isinstance(embedding, str) else embedding
    names = F.array(*[F.lit(c) for c in head.classes])
    out = df.withColumn("_s", score(vec))
    cols = [F.get(names, F.col("_s.top")).alias("top"), F.col("_s.p_top"), F.col("_s.entropy")]
    if keep_proba:
        cols += [F.col("_s.logits"), F.col("_s.proba")]
    return out.select(*df.columns, *cols)


def abstain(df: DataFrame, threshold: float, reject: str = "unknown") -> DataFrame:
    """Adds ``pred``: the top class, or the reject label where the entropy is above the threshold."""
    return df.withColumn("pred", F.when(F.col("entropy") > threshold, F.lit(reject)).otherwise(F.col("top")))


def abstain_on_probability(df: DataFrame, threshold: float, reject: str = "other") -> DataFrame:
    """The serving rule: the top class only with enough probability."""
    return df.withColumn("pred", F.when(F.col("p_top") >= threshold, F.col("top")).otherwise(F.lit(reject)))


def centroid_head(df: DataFrame, label: str, embedding: Column, dim: int, temperature: float) -> LinearHead:
    """The unit-length mean vector per class as a head.

    One aggregate with a mean per dimension: no row is exploded, map tasks send k rows each.
    """
    means = (df.groupBy(F.col(label).alias("label"))
             .agg(*[F.avg(F.get(embedding, F.lit(i)).cast("double")).alias(f"m{i}") for i in range(dim)])
             .limit(MAX_CLASSES + 1).collect())
    if len(means) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes: not a classification target")
    means.sort(key=lambda r: r["label"])
    coef = np.array([[r[f"m{i}"] for i in range(dim)] for r in means])
    coef /= np.linalg.norm(coef, axis=1, keepdims=True)
    return LinearHead(tuple(str(r["label"]) for r in means), coef, np.zeros(len(means)), temperature)


def true_index(label: Column, classes: Sequence[str]) -> Column:
    """Zero-based class number of a label."""
    return F.array_position(F.array(*[F.lit(c) for c in classes]), label).cast("int") - 1


def nll(logits: Column, index: Column, temperature: float) -> Column:
    """Negative log likelihood of the true class at a temperature, shifted by the largest logit."""
    t = F.lit(float(temperature))
    return let(logits, lambda zs: let(F.array_max(zs), lambda top: F.ln(total(F.transform(
        zs, lambda z: F.exp((z - top) / t)))) - (F.get(zs, index) - top) / t))


def nll_by_temperature(df: DataFrame, classes: Sequence[str], label: str, grid: Sequence[float]) -> list[tuple[float, float]]:
    """Mean NLL for each temperature in one pass over the logits."""
    idx = true_index(F.col(label), classes)
    row = df.agg(*[F.avg(nll(F.col("logits"), idx, t)).alias(f"t{i}") for i, t in enumerate(grid)]).first()
    return [(t, row[f"t{i}"]) for i, t in enumerate(grid)]


def fit_temperature(df: DataFrame, classes: Sequence[str], label: str, rounds: int = 4, points: int = 12) -> float:
    """The temperature of least NLL, by a grid on the log scale narrowed each round."""
    lo, hi = (math.log(b) for b in fixed.TEMPERATURE_BOUNDS)
    stored = cut_lineage(df.select(label, "logits"))
    for _ in range(rounds):
        step = (hi - lo) / (points - 1)
        grid = [math.exp(lo + i * step) for i in range(points)]
        best = min(nll_by_temperature(stored, classes, label, grid), key=lambda p: p[1])[0]
        lo, hi = max(lo, math.log(best) - step), min(hi, math.log(best) + step)
    return best


def train_head(train: DataFrame, calib: DataFrame, label: str, embedding: str = "embedding",
               c_grid: Sequence[float] = fixed.C_GRID, max_iter: int = 200) -> tuple[LinearHead, dict[float, float]]:
    """Balanced multinomial logistic regression; the penalty with the least calibration log loss wins."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    counts = {r[0]: r[1] for r in train.groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    if len(counts) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    classes, n = tuple(sorted(counts)), sum(counts.values())
    rows = cut_lineage(train.select(
        true_index(F.col(label), classes).cast("double").alias("label"), balanced_weight(counts, F.col(label)).alias("weight"),
        embedding)).withColumn("features", array_to_vector(embedding))
    held, losses, heads = cut_lineage(calib.select(label, embedding)), {}, {}
    for c in c_grid:
        model = LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (c * n), standardization=False,
                                   maxIter=max_iter).fit(rows)
        heads[c] = LinearHead(classes, model.coefficientMatrix.toArray(), model.interceptVector.toArray())
        losses[c] = nll_by_temperature(score_linear(held, heads[c], embedding, keep_proba=True), classes, label, [1.0])[0][1]
    return heads[min(losses, key=losses.get)], losses


def balanced_weight(counts: dict[str, int], label: Column) -> Column:
    """The weight that gives every class the same total."""
    n = sum(counts.values())
    return F.element_at(F.create_map(*[F.lit(x) for c, m in counts.items() for x in (c, n / (len(counts) * m))]), label)


def head_gradient(df: DataFrame, head: LinearHead, label: str, c: float, embedding: str = "embedding") -> DataFrame:
    """The gradient of the training loss of ``train_head`` at ``head``, one row per class and input: zero where the head is optimal.

    ``i`` counts inputs from 0, the intercept is -1. Map tasks send one partial sum for each class and input.
    """
    counts = {r[0]: r[1] for r in df.groupBy(label).count().limit(MAX_CLASSES + 1).collect()}
    n = sum(counts.values())
    errors = F.transform("proba", lambda p, k: p - (k == true_index(F.col(label), head.classes)).cast("double"))
    rows = score_linear(df, head, embedding, keep_proba=True).select(
        balanced_weight(counts, F.col(label)).alias("w"), errors.alias("e"), F.concat(F.array(F.lit(1.0)), F.col(embedding).cast("array<double>")).alias("x"))
    sums = rows.select("w", "e", F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.array(*[F.sum(F.col("w") * F.get("e", F.lit(k)) * F.col("x")) / n for k in range(len(head.classes))]).alias("g"))
    classes = [F.lit(x) for x in head.classes]
    penalty = [F.get(F.array(*[F.lit(float(v)) for v in (0.0, *row)]), F.col("i")) for row in head.coef / (c * n)]
    cells = sums.select("i", F.array(*[F.struct(x.alias("cls"), (F.get("g", F.lit(k)) + pull).alias("gradient")) for k, (x, pull) in enumerate(zip(classes, penalty, strict=True))]).alias("cells"))
    return cells.select((F.col("i") - 1).alias("i"), F.explode("cells").alias("cell")).select("cell.cls", "i", "cell.gradient")

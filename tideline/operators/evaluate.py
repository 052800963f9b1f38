"""Evaluation of scored rows: truth, top, pred, p_top, entropy."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.session import cut_lineage


def share(part: Column, whole: Column, digits: int = 6) -> Column:
    return F.round(F.try_divide(part, whole), digits)


def outcome(reject: str) -> Column:
    return (F.when(F.col("pred") == reject, "abstain").when(F.col("pred") == F.col("truth"), "correct").otherwise("error"))


def outcome_rates(df: DataFrame, reject: str = "unknown", other: str = "other") -> DataFrame:
    """Correct, confident errors and handoffs; accuracy on answered; what the errors and handoffs hit."""
    o = df.select("truth", "pred", outcome(reject).alias("o"))
    n = F.count(F.lit(1))
    ok, err, handed = (F.count_if(F.col("o") == x) for x in ("correct", "error", "abstain"))
    on_other = F.count_if((F.col("o") == "abstain") & (F.col("truth") == other))
    missed = F.count_if((F.col("o") == "error") & (F.col("pred") == other) & (F.col("truth") != other))
    return o.agg(n.alias("n"), ok.alias("correct"), err.alias("errors"), handed.alias("handoffs"),
                 share(ok, n).alias("correct_rate"), share(err, n).alias("error_rate"), share(handed, n).alias("handoff_rate"),
                 share(ok, ok + err).alias("accuracy_answered"), on_other.alias("handoffs_on_other"), missed.alias("missed"))


def threshold_sweep(df: DataFrame, saved: float, grid: Sequence[float] = fixed.SWEEP) -> DataFrame:
    """Precision, handoff and confident-error rate per threshold, all counted in one pass."""
    points = sorted(set(grid) | {round(saved, 3)})
    right = F.col("top") == F.col("truth")
    aggs = [F.count(F.lit(1)).alias("n")]
    for i, t in enumerate(points):
        inside = F.col("entropy") <= t
        aggs += [F.count_if(inside).alias(f"k{i}"), F.count_if(inside & right).alias(f"ok{i}")]
    line = F.explode(F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"k{i}").alias("k"), F.col(f"ok{i}").alias("ok"),
                                        F.lit(abs(t - round(saved, 3)) < 1e-9).alias("saved")) for i, t in enumerate(points)]))
    rows = df.agg(*aggs).select("n", line.alias("r")).select("n", "r.*")
    return rows.select("threshold", "saved", share(F.col("ok"), F.col("k")).alias("precision"),
                       share(F.col("n") - F.col("k"), F.col("n")).alias("handoff_rate"),
                       share(F.col("k") - F.col("ok"), F.col("n")).alias("error_rate"))


def confusion_matrix(df: DataFrame, classes: Sequence[str], reject: str = "unknown") -> DataFrame:
    return df.groupBy("truth").pivot("pred", [*classes, reject]).agg(F.count(F.lit(1))).fillna(0)


def outcomes_by_label(df: DataFrame, reject: str = "unknown") -> DataFrame:
    o = df.select("truth", outcome(reject).alias("o"))
    return o.groupBy("truth").pivot("o", ["correct", "error", "abstain"]).agg(F.count(F.lit(1))).fillna(0)


def classification_report(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and support per class; a division by nothing counts as 0.

    Both margins come from the (truth, top) counts, so the rows are read once.
    """
    cells = df.groupBy("truth", "top").agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("truth").alias("label"), F.col("n").alias("support"), F.lit(0).alias("said")),
                             F.struct(F.col("top").alias("label"), F.lit(0).alias("support"), F.col("n").alias("said"))))
    per = (cells.select("truth", "top", "n", side.alias("s"))
           .groupBy("s.label").agg(F.sum("s.support").alias("support"), F.sum("s.said").alias("said"),
                                   (F.sum(F.when(F.col("truth") == F.col("top"), F.col("n")).otherwise(0)) / 2).alias("hit")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    p, r = zero(F.try_divide("hit", "said")), zero(F.try_divide("hit", "support"))
    return per.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"),
                      F.round(zero(F.try_divide(2 * p * r, p + r)), 6).alias("f1"), "support")


def log_loss(df: DataFrame, classes: Sequence[str], eps: float = 1e-15) -> DataFrame:
    at = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col("truth")).cast("int")
    return df.agg(F.round(F.avg(-F.ln(F.greatest(F.element_at("proba", at), F.lit(eps)))), 6).alias("log_loss"),
                  F.count(F.lit(1)).alias("n"))


def choose_threshold(df: DataFrame, target: float, least_share: float = 0.3) -> DataFrame:
    """The entropy threshold that answers most rows at the target accuracy, else the most accurate one.

    Candidates lie on a grid of 1/10000, so counts per grid step (at most 10,001 rows) hold all
    that is needed; only those are cumulated in one place.
    """
    steps = 10_000
    right = F.col("top") == F.col("truth")
    first = F.least(F.greatest(F.ceil(F.col("entropy") * steps), F.lit(0)), F.lit(steps + 1)).cast("int")
    near = F.least(F.bround(F.col("entropy") * steps), F.lit(float(steps))).cast("int")
    events = F.explode(F.array(
        F.struct(first.alias("m"), F.lit(1).alias("k"), right.cast("int").alias("ok"), F.lit(0).alias("cand")),
        F.struct(near.alias("m"), F.lit(0).alias("k"), F.lit(0).alias("ok"), F.lit(1).alias("cand"))))
    per = (df.select(events.alias("e")).groupBy("e.m")
           .agg(F.sum("e.k").alias("k"), F.sum("e.ok").alias("ok"), F.max("e.cand").alias("cand")))
    one = df.sparkSession.range(1).select(F.lit(steps).alias("m"), F.lit(0).cast("long").alias("k"),
                                          F.lit(0).cast("long").alias("ok"), F.lit(1).alias("cand"))
    per = per.unionByName(one).groupBy("m").agg(F.sum("k").alias("k"), F.sum("ok").alias("ok"), F.max("cand").alias("cand"))
    upto = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, 0)
    everything = Window.orderBy("m").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    cum = per.select("m", "cand", F.sum("k").over(upto).alias("k"), F.sum("ok").over(upto).alias("ok"),
                     F.sum("k").over(everything).alias("n"))
    cand = (cum.filter("cand = 1 AND k > 0").filter(F.col("k") >= least_share * F.col("n"))
            .select((F.col("m") / steps).alias("t"), (F.col("k") / F.col("n")).alias("cov"), (F.col("ok") / F.col("k")).alias("acc")))
    good = F.col("acc") >= target
    best_ok = F.max_by(F.struct("t", "cov", "acc"), F.when(good, F.struct("cov", -F.col("t"))))
    best_any = F.max_by(F.struct("t", "cov", "acc"), F.struct("acc", "cov", -F.col("t")))
    return (cand.agg(best_ok.alias("a"), best_any.alias("b")).select(F.coalesce("a", "b").alias("s"), F.col("a").isNotNull().alias("reached"))
            .select(F.col("s.t").alias("threshold"), F.round("s.cov", 6).alias("coverage"), F.round("s.acc", 6).alias("accuracy"), "reached"))


def recall_by_label(df: DataFrame) -> DataFrame:
    return df.groupBy("truth").agg(F.count(F.lit(1)).alias("n"),
                                   share(F.count_if(F.col("pred") == F.col("truth")), F.count(F.lit(1))).alias("recall"))


def compare_runs(before: DataFrame, after: DataFrame, row_id: str, reject: str = "unknown") -> DataFrame:
    """Rates of two runs over the same rows, the change in points and the number of changed predictions."""
    pairs = (before.select(row_id, "truth", F.col("pred").alias("a")).join(after.select(row_id, F.col("pred").alias("b")), row_id))
    n = F.count(F.lit(1))
    aggs = [n.alias("n"), F.count_if(F.col("a") != F.col("b")).alias("changed")]
    for side in ("a", "b"):
        c = F.col(side)
        aggs += [F.count_if(c == F.col("truth")).alias(f"correct_{side}"),
                 F.count_if((c != F.col("truth")) & (c != reject)).alias(f"error_{side}"),
                 F.count_if(c == reject).alias(f"handoff_{side}")]
    wide = pairs.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"{m}_a").alias("a"), F.col(f"{m}_b").alias("b"))
                               for m in ("correct", "error", "handoff")]))
    return (wide.select("n", "changed", rows.alias("r")).select(
        "r.metric", share(F.col("r.a"), F.col("n")).alias("before"), share(F.col("r.b"), F.col("n")).alias("after"),
        F.round((F.col("r.b") - F.col("r.a")) * 100.0 / F.col("n"), 6).alias("points"), "changed"))


def changed_rows(before: DataFrame, after: DataFrame, row_id: str) -> DataFrame:
    return (before.select(row_id, F.col("pred").alias("before")).join(after.select(row_id, F.col("pred").alias("after")), row_id)
            .filter("before <> after"))


def chain_summary(df: DataFrame, by: str) -> DataFrame:
    """Per language: accuracy of both models, advice given and wrong, latency, decisions."""
    n = F.count(F.lit(1))
    ok, ok2 = F.col("label") == F.col("truth"), F.coalesce(F.col("llm_label") == F.col("truth"), F.lit(False))
    answered, expected = F.col("decision") == "answer", F.col("expected") == "answer"
    return df.groupBy(by).agg(
        n.alias("n"), F.count_if(ok).alias("classifier_ok"), F.count_if(ok2).alias("second_ok"),
        F.count_if(expected & answered & ok).alias("correct_advice"), F.count_if(expected).alias("should_answer"),
        F.count_if(answered & ~ok).alias("wrong_advice"), F.round(F.avg("seconds"), 6).alias("mean_seconds"),
        *[F.count_if(F.col("decision") == d).alias(f"n_{d}") for d in ("answer", "clarify", "escalate")])


def median_brackets(rows: DataFrame, most: int, cuts: int = 256) -> DataFrame:
    """Per group ``_g`` of ``rows`` (``_g``, ``_x``) the values among which its middle lies: from ``_lo`` to below ``_hi`` (null: no bound), with ``_n`` rows
    in the group, ``_before`` of them below ``_lo`` and at most ``most`` between ``_lo`` and ``_hi``.

    Bounds come from a sketch of the rows that are left, so they follow the values, however far the tails reach; exact counts per cell then
    tell which cell holds the middle. A round leaves about one in ``cuts`` rows; a value that many rows share becomes a lower bound.
    """
    all_rows = rows.groupBy("_g").agg(F.count(F.lit(1)).alias("_n"))
    none = F.lit(None).cast("double")
    found = cut_lineage(all_rows.select("_g", "_n", F.lit(0).cast("long").alias("_before"), none.alias("_lo"), none.alias("_hi"), F.col("_n").alias("_inside")))
    while not (wide := found.filter(F.col("_inside") > most)).isEmpty():
        left = in_bracket(rows, wide)
        bounds = left.groupBy("_g").agg(F.percentile_approx("_x", [i / cuts for i in range(cuts + 1)], 10_000).alias("_cuts"))
        placed = left.join(bounds, "_g").withColumn("_cell", F.size(F.filter("_cuts", lambda c: c <= F.col("_x"))))
        low = F.get("_cuts", F.col("_cell") - 1)
        hist = placed.groupBy("_g", "_cell").agg(F.count(F.lit(1)).alias("_k"), F.count_if(F.col("_x") > F.coalesce(low, F.col("_lo"), F.lit(float("-inf")))).alias("_open"),
                                                 *[F.first(c).alias(c) for c in ("_n", "_before", "_lo", "_hi")])
        line = Window.partitionBy("_g").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as there are cuts
        hist = hist.withColumn("_below", F.col("_before") + F.coalesce(F.sum("_k").over(line), F.lit(0)))
        middle = [F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2)]
        held = hist.filter(reduce(Column.__or__, [(F.col("_below") <= p) & (p < F.col("_below") + F.col("_k")) for p in middle]))
        held = held.join(bounds, "_g").withColumn("_from", F.coalesce(F.get("_cuts", F.col("_cell") - 1), "_lo")).withColumn("_to", F.coalesce(F.get("_cuts", F.col("_cell")), "_hi"))
        narrow = held.groupBy("_g").agg(F.first("_n").alias("_n"), F.min("_below").alias("_before"), F.min_by("_from", "_cell").alias("_lo"),
                                        F.max_by("_to", "_cell").alias("_hi"), F.sum("_open").alias("_inside"))
        found = cut_lineage(found.filter(F.col("_inside") <= most).unionByName(narrow.select(found.columns)))
    return found


def in_bracket(rows: DataFrame, brackets: DataFrame) -> DataFrame:
    x = F.col("_x")
    return rows.join(brackets, "_g").filter((F.col("_lo").isNull() | (x >= F.col("_lo"))) & (F.col("_hi").isNull() | (x < F.col("_hi"))))


def exact_median(df: DataFrame, by: str, value: str, most: int = 1 << 16) -> DataFrame:
    """(by, median) without holding a group's values in one place.

    Brackets around the middle are narrowed until one holds at most ``most`` rows above its lower bound; only their
    different values, with counts, are then put in order.
    """
    # The group is a struct, so that a null group joins with itself.
    rows = df.filter(F.col(value).isNotNull()).select(F.struct(by).alias("_g"), F.col(value).cast("double").alias("_x"))
    values = in_bracket(rows, median_brackets(rows, most)).groupBy("_g", "_n", "_before", "_x").agg(F.count(F.lit(1)).alias("_k"))
    upto = Window.partitionBy("_g").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    values = values.withColumn("_before", F.col("_before") + F.coalesce(F.sum("_k").over(upto), F.lit(0)))
    inside = lambda p: (F.col("_before") <= p) & (p < F.col("_before") + F.col("_k"))
    picked = [F.max(F.when(inside(p), F.col("_x"))) for p in (F.floor((F.col("_n") - 1) / 2), F.floor(F.col("_n") / 2))]
    return values.groupBy("_g").agg(((picked[0] + picked[1]) / 2).alias("median")).select(F.col("_g")[by].alias(by), "median")


def latency_stats(df: DataFrame, by: str, value: str, accuracy: int | None = None) -> DataFrame:
    """Median, worst and mean; with ``accuracy`` the median is a sketch of that size."""
    aggs = [F.max(value).alias("worst"), F.round(F.avg(value), 6).alias("mean"), F.count(F.lit(1)).alias("n")]
    if accuracy is not None:
        return df.groupBy(by).agg(F.percentile_approx(value, 0.5, accuracy).alias("median"), *aggs)
    mid = exact_median(df, by, value).select(F.col(by).alias("_by"), F.round("median", 6).alias("median"))
    return df.groupBy(by).agg(*aggs).join(mid, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def delivery_outcome(status: Column, body: Column) -> Column:
    """What a gateway answer means: a refusal may hide in the body of a success code."""
    data = F.get_json_object(body, "$.SMSMessageData")
    recipients = F.from_json(F.get_json_object(body, "$.SMSMessageData.Recipients"), "array<string>")
    return (F.when(status >= 300, "refused").when(data.isNull(), "unreadable")
             .when(F.coalesce(F.size(recipients), F.lit(0)) < 1, "nobody").otherwise("delivered"))

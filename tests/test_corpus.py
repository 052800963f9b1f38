"""Scans, splits and duplicates against plain Python on skewed fixtures."""

import hashlib
import random

import pytest

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.operators import corpus as co
from tideline.operators import evaluate as ev
from tideline.operators import splits as sp


def skewed(spark, n=3000):
    """A third of the rows under one key."""
    rng = random.Random(5)
    rows = [(i, "hot" if rng.random() < 0.34 else rng.choice([None, *(f"k{j}" for j in range(50))]), rng.choice([None, True, False]), rng.randrange(9)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, key string, flag boolean, x int")


def test_exact_median_on_ties_and_skew(spark):
    df = skewed(spark).withColumn("v", F.when(F.col("key") == "hot", F.floor(F.col("x") / 4) * 1.0).otherwise(F.col("id") / 7.0))
    want = {r[0]: r[1] for r in df.groupBy("key").agg(F.median("v")).collect()}
    got = {r[0]: r[1] for r in ev.exact_median(df, "key", "v", most=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)


def place(units, ratios, seed, existing):
    """The placing rule, one unit after the other."""
    out = dict(existing)
    for label in sorted({u[0] for u in units}):
        mine = {u: w for lab, u, w in units if lab == label}
        have = {s: sum(w for u, w in mine.items() if out.get(u) == s) for s in ratios}
        order = sorted((u for u in mine if u not in out), key=lambda u: (-mine[u], hashlib.sha256(f"{seed}:{u}".encode()).hexdigest()))
        for u in order:
            total = sum(have.values()) + mine[u]
            best = max(ratios, key=lambda s: ratios[s] * total - have[s])
            out[u], have[best] = best, have[best] + mine[u]
    return out


def test_allocate_splits_equals_the_sequential_rule(spark):
    rng = random.Random(1)
    units = [(f"l{i % 3}", f"u{i}", rng.choice([1, 1, 1, 2, 5, 40])) for i in range(400)]
    frozen = {f"u{i}": rng.choice(fixed.SPLITS) for i in range(0, 400, 7)}
    df = spark.createDataFrame(units, "label string, unit string, weight long")
    fz = spark.createDataFrame(list(frozen.items()), "unit string, split string")
    for existing, arg in (({}, None), (frozen, fz)):
        got = {r.unit: r.split for r in sp.allocate_splits(df, arg, seed=3).collect()}
        assert got == place(units, fixed.RATIOS, 3, existing)


def test_exact_median_under_heavy_tails(spark):
    """Lognormal values, outliers at 1e12, one value that half of a group shares: exact, and no bracket holds more than was asked."""
    rng = random.Random(8)
    rows = [(g, rng.lognormvariate(0, 3) if rng.random() < 0.99 else 1e12) for g in ("a", "a", "b", None) for _ in range(900)]
    rows += [("ties", 5.0 if i % 2 else rng.random() * 10) for i in range(901)] + [("one", 3.0), ("same", 1.0), ("same", 1.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    want = {r[0]: r[1] for r in df.groupBy("g").agg(F.median("v")).collect()}
    for most in (8, 100):
        got = {r[0]: r[1] for r in ev.exact_median(df, "g", "v", most=most).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) <= 1e-12 * abs(want[k]) for k in want)
        found = ev.median_brackets(df.select(F.struct("g").alias("_g"), F.col("v").alias("_x")), most, cuts=16)
        held = ev.in_bracket(df.select(F.struct("g").alias("_g"), F.col("v").alias("_x")), found).groupBy("_g").agg(F.countDistinct("_x").alias("n"))
        assert max(r.n for r in held.collect()) <= 2 * (most + 1)


@pytest.mark.parametrize("ratios", [[0.7, 0.15, 0.15], [0.5, 0.5], [0.8, 0.1, 0.05, 0.05], [0.333, 0.667], [0.123, 0.877], [1.0]])
def test_patterns_equal_the_rule_unit_by_unit(ratios):
    """Random runs and frozen starts far from their shares, ties included, against the rule one unit after the other."""
    rng, parts = random.Random(len(ratios)), [r / sum(ratios) for r in ratios]
    for _ in range(15):
        have = [rng.choice([0, 0, 7, 900]) for _ in ratios]
        runs = [(w, rng.choice([1, 3, 50, 2500])) for w in sorted(rng.sample(range(1, 60), 4), reverse=True)]
        got = [r.pattern[i % len(r.pattern)] for _, rs in sp.placing(ratios, have, runs) for r in rs for i in range(r.length)]
        want, placed = [], sum(have)
        for w, n in runs:
            for _ in range(n):
                placed += w
                lack = [r * placed - h for r, h in zip(parts, have)]
                best = lack.index(max(lack))
                have[best] += w
                want.append(best)
        assert got == want


def test_a_run_takes_few_steps_however_long_it_is():
    runs = list(sp.placing(list(fixed.RATIOS.values()), [0, 10**6, 5], [(7, 10**7), (1, 10**9)]))
    assert sum(r.length for _, rs in runs for r in rs) == 10**9 + 10**7 and sum(len(rs) for _, rs in runs) < 400


def test_gap_drops_only_rows_near_a_foreign_block(spark):
    rows = [(i, "photo", f"d/1_{i}.jpg", "a", "train" if i < 100 else "test") for i in range(60, 140)] + [(999, "sms", "s", "a", "train")]
    df = spark.createDataFrame(rows, "id long, kind string, source_id string, label string, split string")
    units = spark.createDataFrame([("a-blk0000", "train"), ("a-blk0001", "test")], "unit string, split string")
    kept = {r.id for r in sp.gap_exclusion(df, units, 100, 20).collect()}
    assert kept == {*range(60, 80), *range(120, 140), 999}
    same = units.withColumn("split", F.lit("train"))
    assert sp.gap_exclusion(df.withColumn("split", F.lit("train")), same, 100, 20).count() == 81


def test_dedup_keeps_the_most_protected_copy(spark):
    rows = [(1, "A b!", "train"), (2, "a B", "test"), (3, "a  b", "test"), (4, "c", "calib"), (5, "C?", "train")]
    df = spark.createDataFrame(rows, "id long, text string, split string")
    assert {r.id for r in co.dedup_protected(df, fixed.PROTECTED_ORDER).collect()} == {2, 4}


def test_holdout_takes_a_quarter_of_few_rows(spark):
    df = spark.range(22)
    parts = [r.part for r in co.seeded_holdout(df, 50, 4, seed=1).collect()]
    assert len(parts) == 22 and parts.count("test") == 5


def test_budget_keeps_the_row_that_crosses(spark):
    df = spark.range(10).withColumn("cost", F.lit(1.0))
    assert co.budget_cutoff(df, "cost", 2.5).count() == 3


def test_service_topics_and_blocks(spark):
    topic = "replies to an advisor: better"
    rows = [(i, f"message {i}", topic, "handwritten") for i in range(6)] + [(6, " x ", topic, "handwritten"), (7, "late one", topic, "generated"),
                                                                             (8, "hello", "no such topic", "generated"), (9, None, topic, "generated"), (10, "no topic", None, "generated")]
    df = spark.createDataFrame(rows, "id long, text string, topic string, source string")
    got = {r.source_id: (r.label, r.group, r.reason) for r in co.sms_rows(df, fixed.TOPIC_LABELS).collect()}
    assert [got[f"sms#{i}"][1][-3:] for i in (0, 3, 4, 5, 7)] == ["000", "000", "001", "001", "000"]
    assert got["sms#0"][1] == "sms-replies-to-an-advisor-better-000" and got["sms#0"][0] == "other"
    assert [got[f"sms#{i}"][2] for i in (5, 6, 8, 9, 10)] == [None, "too_short", "unmapped_topic", "too_short", "unmapped_topic"]


def test_winners_for_ids_of_every_size(spark):
    rows = [(2**60, "a", "test"), (5, "b", "train"), (-3, "c", "train"), (-2**63, "a", "train"), (2**63 - 1, "a", "test"), (7, "b", "calib"), (9, "b", "calib"), (-9, "c", "other")]
    got = co.dedup_protected(spark.createDataFrame(rows, "id long, text string, split string"), ("test", "calib", "train")).collect()
    assert sorted(r.id for r in got) == [-3, 7, 2**60]


def test_splits_keep_nulls_and_refuse_doubled_units(spark):
    units = spark.createDataFrame([("a", "u1", 5), (None, "u2", 3), ("a", None, 2), ("b", "u3", 9)], "label string, unit string, weight long")
    got = sp.allocate_splits(units)
    assert got.count() == 4 and sp.apply_splits(units, got).count() == 4
    frozen = spark.createDataFrame([("u2", "test"), (None, "calib")], "unit string, split string")
    assert {r.unit: r.split for r in sp.allocate_splits(units, frozen).collect() if r.unit in (None, "u2")} == {"u2": "test", None: "calib"}
    with pytest.raises(ValueError, match="u1"):
        sp.allocate_splits(units.union(spark.createDataFrame([("b", "u1", 1)], units.schema)))

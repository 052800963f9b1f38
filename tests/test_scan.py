"""Scans over an order: equal to one window per key, in chunks of bounded size."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline.operators import corpus as co
from tideline.operators import dialog as dg
from tideline.operators.scan import cut, row_position, running

ROWS = 1500


def table(spark, kind):
    """id, key, flag, x: a third of the rows under one key; ids dense, far apart, or all but a few within one narrow span."""
    number = {"dense": "id", "sparse": "id * id * 1000003", "busy": "if(id % 50 = 0, id * 10000000, 20000000000 + id)"}[kind]
    key = "if(id % 3 = 0, 'hot', if(id % 7 = 0, null, concat('k', id % 41)))"
    return spark.range(ROWS).selectExpr(f"{number} AS id", f"{key} AS key", "if(id % 5 = 0, id % 2 = 0, null) AS flag", "id % 9 AS x")


def windowed(df, keys):
    w = Window.partitionBy(*keys).orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    return df.select("id", F.coalesce(F.sum("x").over(w), F.lit(0)).alias("s"), F.last("flag", ignorenulls=True).over(w).alias("f"))


@pytest.mark.parametrize("kind", ["dense", "sparse", "busy"])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_equal_to_a_window(spark, kind, keys):
    df = table(spark, kind)
    got = running(df, keys, ["id"], sums={"s": F.col("x")}, lasts={"f": F.col("flag")}, rows=128).select("id", "s", "f")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed(df, keys).collect()))


@pytest.mark.parametrize("kind", ["dense", "sparse", "busy"])
@pytest.mark.parametrize("keys", [[], ["key"]])
def test_no_chunk_is_larger_than_asked(spark, kind, keys):
    chunks = cut(table(spark, kind), keys, ["id"], 128)
    sizes = [r["count"] for r in chunks.groupBy("_chunk").count().collect()]
    assert max(sizes) <= 128 and sum(sizes) == ROWS
    bounds = chunks.groupBy(*keys, "_chunk").agg(F.min("id").alias("low"), F.max("id").alias("high")).collect()
    by_key = {}
    for r in bounds:
        by_key.setdefault(tuple(r[k] for k in keys), []).append((r["_chunk"], r.low, r.high))
    for pieces in by_key.values():
        pieces.sort()
        assert all(a[2] < b[1] for a, b in zip(pieces, pieces[1:]))


def test_more_chunks_than_a_task_takes(spark):
    """Totals that are themselves more than ``rows`` are scanned in turn."""
    df = table(spark, "sparse")
    got = running(df, [], ["id"], sums={"s": F.col("x")}, lasts={"f": F.col("flag")}, rows=16).select("id", "s", "f")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed(df, []).collect()))


def test_empty_and_null_orders(spark):
    df = spark.createDataFrame([("a", None, 1), ("a", 5, 2), ("a", 3, 4), (None, None, 7)], "key string, id long, x int")
    got = {(r.key, r.id): r.s for r in running(df, ["key"], ["id"], sums={"s": F.col("x")}, rows=1).collect()}
    assert got == {("a", None): 0, ("a", 3): 1, ("a", 5): 5, (None, None): 0}
    assert row_position(df.limit(0), ["key"], ["id"], "n").count() == 0


def test_operators_on_sparse_ids(spark):
    """Budget and blocks go by the order of the ids, however far apart they are."""
    df = table(spark, "sparse").withColumn("topic", F.coalesce("key", F.lit("none")))
    kept = co.budget_cutoff(df, "x", 1000)
    w = Window.orderBy("id").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("spent_before", F.coalesce(F.sum("x").over(w), F.lit(0))).filter("spent_before < 1000")
    assert sorted(r.id for r in kept.collect()) == sorted(r.id for r in want.collect())
    blocks = co.block_groups(df, "topic", 10).groupBy("block").count()
    assert blocks.filter("count > 10").count() == 0 and blocks.count() == sum(-(-r["count"] // 10) for r in df.groupBy("topic").count().collect())


def test_state_of_a_hot_sender(spark):
    """One sender with a third of all messages, all within one hour: mute and language as by a plain window."""
    df = spark.range(1500).selectExpr(
        "id", "if(id % 3 = 0, 1L, 2 + id % 40) AS phone", "1700006400000000L + id AS at", "1700006400L AS epoch",
        "CASE id % 11 WHEN 0 THEN 'STOP' WHEN 4 THEN 'START' WHEN 7 THEN 'HELP' END AS kw", "if(id % 13 = 0, if(id % 2 = 0, 'lg', 'en'), null) AS lang_event")
    chunks = cut(df, ["phone"], ["at", "id"], 128)
    assert chunks.groupBy("_chunk").count().agg(F.max("count")).first()[0] <= 128
    w = Window.partitionBy("phone").orderBy("at", "id")
    want = df.withColumn("m", F.coalesce(F.last(dg.mute_flag(), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)) & dg.is_plain()) \
        .withColumn("l", F.coalesce(F.last("lang_event", ignorenulls=True).over(w), F.lit("en")))
    muted, lang = dg.mute_state(df), dg.language_state(df)
    assert sorted((r.id, r.muted) for r in muted.collect()) == sorted((r.id, r.m) for r in want.collect())
    assert sorted((r.id, r.lang) for r in lang.collect()) == sorted((r.id, r.l) for r in want.collect())

"""Connected components of a table of links, in rounds of joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def _state(links: DataFrame) -> tuple:
    """Numbers that change whenever the links do."""
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the least id it is connected with) of every node of ``links`` (longs ``a`` and ``b``).

    Large-star then small-star: each node hands its larger, then its smaller neighbours to its least neighbour,
    until each hangs on its root. The number of rounds grows with the logarithm of the longest chain. A node
    never gathers its neighbours in one place: its least neighbour is an aggregate, and handing on is a join that
    Spark may split. Links are stored after each round. No links give an empty table.
    """
    at = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(at)
    while state[0]:
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        large = cut_lineage(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        at = cut_lineage(small.filter("u <> v").distinct())
        new = _state(at)
        if new == state:
            break
        state = new
    return at.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()

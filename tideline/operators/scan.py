"""Running values over an order, without one task per key.

A plain window puts all rows of a key into one task, and a key may hold a third of a table. Here
the rows are cut into chunks of like size, whatever their keys and order values: a range partition by (key, order)
takes its bounds from a sample of the rows themselves, so sparse numbers, a busy hour or a hot key make more or fewer
chunks, not larger ones. The cut rows are stored, as bounds differ from run to run. Totals per (key, chunk) are
carried forward and joined back, and the row-level window runs per (key, chunk).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage

CHUNK_ROWS = 1 << 16
LEAST_SCAN = 100  # totals of so few chunks are summed in one task, however small the chunks are


def cut(df: DataFrame, keys: Sequence[str], order: Sequence[str], rows: int = CHUNK_ROWS) -> DataFrame:
    """``df`` stored with ``_chunk``: numbers that never decrease along (``keys``, ``order``), for at most ``rows`` rows each.

    Bounds are sampled, so twice as many chunks are asked for as would hold the rows; only rows alike in ``keys`` and ``order`` share a
    chunk whatever their number. Nulls come first, as in Spark's ascending sorts.
    """
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-2 * df.count() // rows))
    chunk = F.spark_partition_id().cast("long").alias("_chunk", metadata={"parts": parts})  # their number is read off the stored schema
    return cut_lineage(df.repartitionByRange(parts, *keys, *order).select(*df.columns, chunk))


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], sums: dict[str, Column] | None = None,
            lasts: dict[str, Column] | None = None, rows: int = CHUNK_ROWS) -> DataFrame:
    """Adds, over the rows of a key strictly before each row, sums and last non-null values.

    ``order`` must be total within a key. A ``df`` that ``cut`` has cut by these keys and this order is not cut again and keeps its ``_chunk``.
    The totals of a key are as many as its chunks; where even those are more than ``rows``, they are a scan of their own.
    """
    sums, lasts, keys, columns = sums or {}, lasts or {}, list(keys), df.columns
    if "_chunk" not in columns:
        df = cut(df, keys, order, rows)
    # Key and chunk travel as one struct: unlike a bare null key, a struct holding null joins with its like.
    parts = df.schema["_chunk"].metadata["parts"]
    df = df.withColumn("_at", F.struct(*keys, "_chunk"))
    for name, value in {**sums, **lasts}.items():
        df = df.withColumn(f"_v_{name}", value)
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    totals = df.groupBy("_at").agg(
        *[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in sums],
        *[F.max_by(f"_v_{n}", F.when(F.col(f"_v_{n}").isNotNull(), place)).alias(f"_c_{n}") for n in lasts])
    if parts > max(rows, LEAST_SCAN):
        flat = totals.select(F.col("_at").alias("_outer"), *[F.col("_at")[k].alias(k) for k in keys], F.col("_at")["_chunk"].alias("_no"), *[f"_c_{n}" for n in (*sums, *lasts)])
        carried = running(flat, keys, ["_no"], {f"_b_{n}": F.col(f"_c_{n}") for n in sums}, {f"_b_{n}": F.col(f"_c_{n}") for n in lasts}, rows) \
            .select(F.col("_outer").alias("_at"), *[f"_b_{n}" for n in (*sums, *lasts)])
    else:
        before = (Window.partitionBy(*[F.col("_at")[k] for k in keys]).orderBy(F.col("_at")["_chunk"])
                  .rowsBetween(Window.unboundedPreceding, -1))
        carried = totals.select(
            "_at", *[F.sum(f"_c_{n}").over(before).alias(f"_b_{n}") for n in sums],
            *[F.last(f"_c_{n}", ignorenulls=True).over(before).alias(f"_b_{n}") for n in lasts])
    inside = Window.partitionBy("_at").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = df.join(carried, "_at")
    new = [(F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) + F.coalesce(f"_b_{n}", F.lit(0))).alias(n) for n in sums]
    new += [F.coalesce(F.last(f"_v_{n}", ignorenulls=True).over(inside), f"_b_{n}").alias(n) for n in lasts]
    return out.select(*columns, *new)


def row_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, rows: int = CHUNK_ROWS) -> DataFrame:
    """Zero-based position of each row within its key."""
    return running(df, keys, order, sums={name: F.lit(1).cast("long")}, rows=rows)

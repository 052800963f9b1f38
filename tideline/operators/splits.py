"""Leakage-free frozen splits: units placed greedily by weight, per label."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.functions.text import image_number
from tideline.functions.vector import let
from tideline.operators.scan import row_position
from tideline.session import cut_lineage

TIES_AT_ONCE = 1 << 20
LONGEST_WINDOW = 2048  # choices; beyond, ratios have no short period and windows repeat as far as they do


def _join_like(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Joins on keys in which a null meets a null: as a struct a null is a value like others."""
    left, right = left.withColumn("_like", F.struct(*keys)), right.withColumn("_like", F.struct(*keys)).drop(*keys)
    return left.join(right, "_like", how).drop("_like")


def unit_weights(corpus: DataFrame) -> DataFrame:
    return corpus.groupBy("label", "unit").agg(F.count("*").alias("weight"))


class Run(NamedTuple):
    """Units at positions ``start`` to ``start + length`` of a label go to the splits of ``pattern``, over and over."""

    start: int
    length: int
    pattern: list[int]


def whole_shares(ratios: list[float]) -> tuple[list[int], int]:
    """Ratios as written, as whole shares of a whole."""
    parts = [Fraction(str(r)) for r in ratios]
    parts = [p / sum(parts) for p in parts]
    whole = math.lcm(*[p.denominator for p in parts])
    return [int(p * whole) for p in parts], whole


def placing(ratios: list[float], have: list[int], runs: Iterable[tuple[int, int]]) -> Iterator[tuple[int, list[Run]]]:
    """The split of each unit in turn, the one furthest below its share (the first on a tie), per run of equal weights.

    Within a run the lacks change by constant steps, so choices settle into patterns. A window of choices is played; every one of
    its decisions has a margin, and the window moves each margin by a fixed amount, so it repeats exactly as often as no margin changes
    sign, which a division tells. A run thus takes a few windows, however many units it has. Margins are whole numbers, parts of the whole.
    Where splits of different ratios tie exactly, the rule's own products, rounded as they are, decide; ``ties_hold`` says how
    long they decide alike.
    """
    shares, whole = whole_shares(ratios)
    parts, k = [r / sum(ratios) for r in ratios], len(ratios)
    have, placed = list(have), sum(have)
    window, at = min(whole * math.lcm(*range(1, k + 1)), LONGEST_WINDOW), 0
    for weight, n in runs:
        out, end = [], at + n
        while at < end:
            pattern, seen, before = [], [], list(have)
            for _ in range(min(window, end - at)):
                placed += weight
                lack = [s * placed - whole * h for s, h in zip(shares, have)]
                tied = [i for i in range(k) if lack[i] == max(lack)]
                best = max(tied, key=lambda i: (parts[i] * placed - have[i], -i))
                seen.append((best, lack, placed, list(have)))
                have[best] += weight
                pattern.append(best)
            grown, span = [h - b for h, b in zip(have, before)], len(pattern) * weight
            moved = [s * span - whole * g for s, g in zip(shares, grown)]
            times = (end - at) // len(pattern) - 1
            for best, lack, then, had in seen:
                for j in range(k):
                    margin, slips = lack[best] - lack[j], moved[j] - moved[best]  # over split j, and what a window costs of it
                    if j != best and slips > 0:
                        times = min(times, max(0, (margin - 1) // slips))
                    elif j != best and slips == margin == 0 and shares[j] != shares[best]:
                        times = ties_hold(times, parts, (best, j), then, had, span, grown)
            have, placed = [h + times * g for h, g in zip(have, grown)], placed + times * span
            out.append(Run(at, len(pattern) * (1 + times), pattern))
            at += out[-1].length
        yield weight, out


def ties_hold(times: int, parts: list[float], pair: tuple[int, int], placed: int, have: list[int], span: int, grown: list[int]) -> int:
    """In how many of the next ``times`` windows an exact tie is decided for the same split."""
    best, j = pair
    for low in range(1, times + 1, TIES_AT_ONCE):
        m = np.arange(low, min(low + TIES_AT_ONCE, times + 1), dtype=np.int64)
        mine, other = (parts[i] * (placed + m * span) - (have[i] + m * grown[i]) for i in pair)
        turned = np.flatnonzero((mine < other) | ((mine == other) & (j < best)))
        if len(turned):
            return low + int(turned[0]) - 1
    return times


def allocate_splits(units: DataFrame, frozen: DataFrame | None = None, ratios: dict[str, float] | None = None,
                    seed: int = 0) -> DataFrame:
    """(label, unit, weight, split): frozen units keep their split, new ones follow the ratios.

    New units are taken largest first, ties in seeded hash order. The choice depends only on the
    sequence of weights, so a task receives per label the few (weight, number of units) runs and answers each with the pattern of
    its choices; units find theirs by position. No task goes through the units. Null labels and units are
    values like others. A unit under two labels raises, as no split could hold it without a leak.
    """
    ratios = ratios or fixed.RATIOS
    names, given = list(ratios), list(ratios.values())
    # The units are read for their starts, runs and positions; they are few next to the rows behind them.
    units = cut_lineage(units)
    both = units.groupBy("unit").agg(F.count(F.lit(1)).alias("labels")).filter("labels > 1").select("unit").limit(5).collect()
    if both:
        raise ValueError(f"units under more than one label: {[r.unit for r in both]}")
    if frozen is None:
        known = units.withColumn("_split", F.lit(None).cast("string"))
    else:
        known = _join_like(units, frozen.select("unit", F.col("split").alias("_split")), ["unit"], "left")
    todo = known.filter(F.col("_split").isNull()).drop("_split")
    start = known.groupBy("label").agg(*[
        F.coalesce(F.sum(F.when(F.col("_split") == s, F.col("weight"))), F.lit(0)).alias(f"_h{i}") for i, s in enumerate(names)])
    runs = (todo.groupBy("label", "weight").agg(F.count("*").alias("n"))
            .groupBy("label").agg(F.sort_array(F.collect_list(F.struct("weight", "n")), asc=False).alias("runs")))
    plan = _join_like(runs, start, ["label"]).select(
        "label", F.transform("runs", lambda r: r["weight"]).alias("weights"), F.transform("runs", lambda r: r["n"]).alias("ns"),
        F.array(*[F.col(f"_h{i}") for i in range(len(names))]).alias("start"))

    def place(batches):
        for pdf in batches:
            for label, weights, ns, begin in pdf.itertuples(index=False):
                told = placing(given, [int(b) for b in begin], zip(map(int, weights), map(int, ns)))
                found = [(label, weight, [r._asdict() for r in runs]) for weight, runs in told]
                yield pd.DataFrame(found, columns=["label", "weight", "patterns"])

    chosen = plan.repartition("label").mapInPandas(place, "label string, weight long, patterns array<struct<start:long,length:long,pattern:array<int>>>")
    ordered = todo.withColumn("_hash", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("unit")), 256)).withColumn("_big", -F.col("weight"))
    placed = row_position(ordered, ["label"], ["_big", "_hash"], "pos")
    mine = F.filter("patterns", lambda r: (r["start"] <= F.col("pos")) & (F.col("pos") < r["start"] + r["length"]))[0]
    choice = let(mine, lambda r: F.get(r["pattern"], ((F.col("pos") - r["start"]) % F.size(r["pattern"])).cast("int")))
    split = F.element_at(F.array(*[F.lit(n) for n in names]), choice + 1)
    new = _join_like(placed, chosen, ["label", "weight"]).select("label", "unit", "weight", split.alias("split"))
    if frozen is None:
        return cut_lineage(new)
    old = known.filter(F.col("_split").isNotNull()).select("label", "unit", "weight", F.col("_split").alias("split"))
    return cut_lineage(old.unionByName(new))


def hash_splits(df: DataFrame, unit: str, ratios: dict[str, float] | None = None, seed: int = 0) -> DataFrame:
    """Adds ``split`` from the unit's hash alone: no pass over the units, ratios met on average."""
    ratios = ratios or fixed.RATIOS
    point = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(unit).cast("string")), 256), 1, 8), 16, 10).cast("long")
    cum, case, total = 0.0, None, sum(ratios.values())
    for name, r in ratios.items():
        cum += r / total
        cut = int(cum * (1 << 32))
        case = F.when(point < cut, name) if case is None else case.when(point < cut, name)
    return df.withColumn("split", case.otherwise(name))


def apply_splits(corpus: DataFrame, assignment: DataFrame) -> DataFrame:
    """Adds the split of the row's unit under the row's label, so no row is doubled; rows without one are left out."""
    return _join_like(corpus, assignment.select("label", "unit", "split"), ["label", "unit"])


def near_foreign_block(corpus: DataFrame, assignment: DataFrame, block: int = 100, gap: int = 20) -> DataFrame:
    """Adds ``near_other``: a photo within ``gap`` numbers of a block that went to another split.

    The neighbour is looked up by equality on its unit name. Rows without a neighbour get a
    spread-out key that matches nothing, so they do not pile up under null.
    """
    n = F.when(F.col("kind") == "photo", image_number("source_id"))
    b, pos = F.floor(n / block), F.pmod(n, F.lit(block))
    name = lambda no: F.format_string("%s-blk%04d", F.col("label"), no)
    below, above = F.when(pos < gap, name(b - 1)), F.when(pos >= block - gap, name(b + 1))
    sides = [F.coalesce(below, above)] if 2 * gap <= block else [below, above]
    out = corpus.withColumn("near_other", F.lit(False))
    spread = F.concat(F.lit("~"), F.pmod(F.xxhash64("id"), F.lit(4096)).cast("string"))
    names = assignment.select(F.col("unit").alias("_next"), F.col("split").alias("_next_split"))
    for side in sides:
        out = (out.withColumn("_next", F.coalesce(side, spread)).join(names, "_next", "left")
               .withColumn("near_other", F.col("near_other") | F.coalesce(F.col("_next_split") != F.col("split"), F.lit(False)))
               .drop("_next", "_next_split"))
    return out


def gap_exclusion(corpus: DataFrame, assignment: DataFrame, block: int = 100, gap: int = 20) -> DataFrame:
    return near_foreign_block(corpus, assignment, block, gap).filter(~F.col("near_other")).drop("near_other")

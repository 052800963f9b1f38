"""Near duplicates: the first of each group leads, later ones join it.

An item joins the earliest leader near to it, else it becomes a leader itself. The result depends
on the item order only, and here it is reached without comparing all pairs:

* Blocks. Near items share a block key, so only items of one block are compared.
* Rounds. The first open item of a block is compared with the rest of that block, one comparison
  per member. An item that comes first in all of its blocks leads for certain, and what is near it
  leaves. A group of very many copies is gone after one round.
* Pairs. What is then open shares blocks with few others; those pairs are checked and the earliest
  are taken as leaders until none is left open.
"""

from __future__ import annotations

import difflib
import itertools
import math
from collections.abc import Callable, Iterator, Sequence
from functools import reduce
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import clean_generated, generated_reason, norm_text
from tideline.functions.vector import let
from tideline.session import cut_lineage

HOT_BLOCK, MAX_ROUNDS, GOOD_ROUND = 256, 6, 0.9
FEW = 500_000  # near pairs whose leaders are told in one task
ROUGH, CELLS = 2, 65_536  # words by which all pairs of codes are compared first, pairs that are compared at once
STRETCH, PAIRS = 32_768, 20_000_000  # nodes of the first stretch of the order, near pairs that a stretch may write
BLOCK = 2048  # nodes of the first stretch that are led at once
TILE, LEAST_TILE = 131_072, 32_768  # codes compared with as many others in one group


def greedy_leaders(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node) of the leaders among ``nodes``, given all near pairs (a, b) with a before b. Rounds leave ever fewer pairs; the last ``FEW`` go through one task."""
    open_, left = cut_lineage(nodes.select("node")), cut_lineage(edges.select("a", "b"))
    found = []
    while left.count() > FEW:
        first = open_.join(left.select(F.col("b").alias("node")).distinct(), "node", "left_anti")
        first = cut_lineage(first)
        gone = left.join(first.withColumnRenamed("node", "a"), "a", "left_semi").select(F.col("b").alias("node")).distinct()
        decided = cut_lineage(first.unionByName(gone))
        found.append(first)
        open_ = cut_lineage(open_.join(decided, "node", "left_anti"))
        left = cut_lineage(left.join(decided.withColumnRenamed("node", "a"), "a", "left_anti")
                           .join(decided.withColumnRenamed("node", "b"), "b", "left_anti"))
    follow = left.coalesce(1).mapInArrow(followers, T.StructType([T.StructField("node", left.schema["b"].dataType)]))
    open_ = open_.join(follow, "node", "left_anti")
    for f in found:
        open_ = open_.unionByName(f)
    return open_


def followers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The nodes that are near an earlier leader, given all near pairs in one task."""
    gone: dict = {}
    pairs = [pair for batch in batches for pair in zip(batch.column("b").to_pylist(), batch.column("a").to_pylist(), strict=True)]
    for b, a in sorted(pairs):
        if a not in gone and b not in gone:
            gone[b] = None
    if gone:
        yield pa.RecordBatch.from_arrays([pa.array(list(gone))], ["node"])


Blocks = tuple[DataFrame, DataFrame]


def assign_leaders(nodes: DataFrame, blocks: Blocks, near: Callable[[DataFrame], DataFrame],
                   finer: Callable[[DataFrame], Blocks] | None = None) -> DataFrame:
    """(node, leader) for every node.

    ``blocks`` are two tables (node, block): where a node is looked for as a leader and where it looks
    for one. ``near`` keeps the pairs (a, b), a before b, that are near. A node's number is its
    place in the order. Blocks that stay large though they hold no copies are not paired up: a
    near pair that shares no other block has both its nodes in such blocks, and those nodes get the
    longer keys of ``finer``.
    """
    lead, member = blocks
    state = nodes.select("node", F.lit(None).cast("long").alias("leader"))
    open_count = state.count()
    for _ in range(MAX_ROUNDS):
        fresh = state.filter("leader IS NULL").select("node")
        heads = cut_lineage(lead.join(fresh, "node", "left_semi").groupBy("block").agg(F.min("node").alias("head"), F.count("*").alias("n")))
        if (heads.agg(F.max("n")).first()[0] or 0) <= HOT_BLOCK:
            break
        earliest = (member.join(fresh, "node", "left_semi").join(heads, "block").groupBy("node").agg(F.min("head").alias("head")))
        sure = cut_lineage(earliest.filter("head = node").select("node"))
        tests = (heads.join(sure.withColumnRenamed("node", "head"), "head", "left_semi").join(member, "block").filter("node > head")
                 .select(F.col("head").alias("a"), F.col("node").alias("b")).distinct())
        joined = near(tests).groupBy(F.col("b").alias("node")).agg(F.min("a").alias("_new"))
        state = cut_lineage(state.join(joined, "node", "left").join(sure.withColumn("_lead", F.lit(True)), "node", "left")
                            .select("node", F.when(F.col("_lead"), F.col("node")).when(F.col("leader") == F.col("node"), F.col("leader"))
                                    .otherwise(F.least("leader", "_new")).alias("leader")))
        before, open_count = open_count, state.filter("leader IS NULL").count()
        if open_count > GOOD_ROUND * before:
            break  # what is left is not made of copies; pairs settle it
    fresh = state.filter("leader IS NULL").select("node")
    followers = state.filter("leader IS NULL OR leader <> node").select("node")


    def candidates(lead: DataFrame, member: DataFrame) -> DataFrame:
        a = lead.join(fresh, "node", "left_semi").select(F.col("node").alias("a"), "block")
        b = member.join(followers, "node", "left_semi").select(F.col("node").alias("b"), "block")
        return a.join(b, "block").filter("a < b").select("a", "b")

    large = cut_lineage(lead.join(fresh, "node", "left_semi").groupBy("block").agg(F.count("*").alias("n"))
                        .filter(F.col("n") > HOT_BLOCK).select("block"))
    if finer is None or large.isEmpty():
        pairs = candidates(lead, member)
    else:
        inside = cut_lineage(lead.unionByName(member).join(large, "block", "left_semi").select("node").distinct())
        pairs = candidates(*(t.join(large, "block", "left_anti") for t in blocks)).unionByName(candidates(*finer(inside)))
    edges = cut_lineage(near(pairs.distinct()))
    among = edges.join(fresh.withColumnRenamed("node", "b"), "b", "left_semi")
    leaders = cut_lineage(greedy_leaders(fresh, among))
    joined = (edges.join(leaders.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("_new")))
    return (state.join(joined, "node", "left").join(leaders.withColumn("_lead", F.lit(True)), "node", "left")
            .select("node", F.when(F.col("_lead"), F.col("node")).when(F.col("leader") == F.col("node"), F.col("leader"))
                    .otherwise(F.least("leader", "_new")).alias("leader")))


# ---- fingerprints ---------------------------------------------------------------------------
def band_keys(words: Column, n_words: int, word_bits: int, max_distance: int, agree: int) -> Column:
    """Block keys of a code of ``n_words`` words.

    Two codes within the distance differ in at most so many of ``max_distance + agree`` bands, so
    they have ``agree`` bands in common; each choice of that many bands is a key. More agreeing
    bands make keys longer, which keeps blocks small on larger tables.
    """
    bits, m = n_words * word_bits, max_distance + agree
    if m > bits:
        raise ValueError("more bands than bits")
    cuts = [bits * i // m for i in range(m + 1)]
    text = F.array_join(F.transform(words, lambda w: F.lpad(F.bin(w), word_bits, F.lit("0"))), "")
    spans = F.array(*[F.struct(F.lit(a + 1).alias("at"), F.lit(b - a).alias("len")) for a, b in itertools.pairwise(cuts)])
    choices = F.array(*[F.array(*[F.lit(i) for i in c]) for c in itertools.combinations(range(m), agree)])
    bands = let(text, lambda t: F.transform(spans, lambda s: F.substring(t, s["at"], s["len"])))
    return let(bands, lambda bs: F.transform(choices, lambda c: F.xxhash64(c, F.transform(c, lambda i: F.get(bs, i)))))


def orientations(side: int) -> list[list[int]]:
    """The eight flips and quarter turns of a ``side`` x ``side`` grid: for each, which cell comes to stand where (its own first)."""
    last = side - 1
    turned = []
    for swap, down, across in itertools.product((False, True), repeat=3):
        cells = []
        for y, x in itertools.product(range(side), repeat=2):
            row, col = (x, y) if swap else (y, x)
            cells.append((last - row if down else row) * side + (last - col if across else col))
        turned.append(cells)
    return turned


def orbits(side: int) -> list[list[int]]:
    """Cells that turn into each other, larger orbits first. Every orientation maps an orbit onto itself."""
    turned = orientations(side)
    seen = {tuple(sorted({cells[i] for cells in turned})) for i in range(side * side)}
    return [list(o) for o in sorted(seen, key=lambda o: (-len(o), o))]


def orbit_bands(side: int, m: int) -> list[list[int]]:
    """The cells in ``m`` bands of whole orbits, of sizes as like as orbits allow."""
    every = orbits(side)
    if m > len(every):
        raise ValueError("more bands than orbits")
    bands: list[list[int]] = [[] for _ in range(m)]
    for o in every:
        min(bands, key=len).extend(o)
    return bands


def picked(bits: Column, cells: Sequence[int]) -> Column:
    """The string of the given cells of an array of single characters."""
    return F.array_join(F.transform(F.array(*[F.lit(c) for c in cells]), lambda i: F.get(bits, i)), "")


def turned_codes(code: Column, side: int) -> Column:
    """All orientations of a code given as a string of ``side * side`` zeros and ones, its own first."""
    return let(F.split(code, ""), lambda bits: F.array(*[picked(bits, cells) for cells in orientations(side)]))


def orbit_keys(code: Column, side: int, max_distance: int, agree: int) -> Column:
    """Block keys that are the same for all orientations of a code, so a code has one set of them, not eight.

    Bands are made of whole orbits, so an orientation moves bits inside their bands only. Codes that are within the distance in
    some orientation agree there in ``agree`` whole bands; the least of a choice of bands over all orientations is then
    the same for both.
    """
    bands = orbit_bands(side, max_distance + agree)
    at = list(itertools.accumulate([1, *map(len, bands)]))
    order = [c for band in bands for c in band]
    views = lambda bits: F.array(*[picked(bits, [cells[c] for c in order]) for cells in orientations(side)])
    spans = F.array(*[F.struct(F.lit(a).alias("at"), F.lit(len(b)).alias("len")) for a, b in zip(at, bands, strict=False)])
    cut = lambda view: F.transform(spans, lambda s: F.substring(view, s["at"], s["len"]))
    choices = F.array(*[F.array(*[F.lit(i) for i in c]) for c in itertools.combinations(range(len(bands)), agree)])
    least = lambda vs, c: F.array_min(F.transform(vs, lambda v: F.array_join(F.transform(c, lambda i: F.get(v, i)), "")))
    return let(F.split(code, ""), lambda bits: let(F.transform(views(bits), cut), lambda vs: F.transform(choices, lambda c: F.xxhash64(c, least(vs, c)))))


def words_of(code: Column, bits: int) -> Column:
    """A string of zeros and ones as an array of 64-bit words."""
    starts = F.array(*[F.lit(i) for i in range(1, bits + 1, 64)])
    return F.transform(starts, lambda i: F.conv(F.substring(code, i, F.lit(64)), 2, -10).cast("long"))


def closest(a: Column, views: Column, n_views: int, n_words: int) -> Column:
    """Least distance of a code to any view of another one, written out so that it compiles to one loop-free expression."""
    apart = lambda v, w: F.bit_count(F.get(a, F.lit(w)).bitwiseXOR(F.get(F.get(views, F.lit(v)), F.lit(w))))
    return F.least(*[reduce(lambda x, y: x + y, [apart(v, w) for w in range(n_words)]) for v in range(n_views)])


def bands_to_agree(nodes: int, bits: int, max_distance: int, per_block: int = 256) -> int:
    """Fewest agreeing bands whose key is long enough for blocks of ``per_block`` nodes on average."""
    for agree in (1, 2):
        if 2 ** (bits * agree // (max_distance + agree)) * per_block >= nodes:
            return agree
    return 3


def orbit_bands_to_agree(nodes: int, side: int, max_distance: int, per_block: int = 256) -> int:
    """As ``bands_to_agree`` for ``orbit_keys``: a band tells its bits less the three that name an orientation."""
    for agree in (1, 2):
        if 2 ** max(0, side * side * agree // (max_distance + agree) - 3) * per_block >= nodes:
            return agree
    return 3


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def fingerprint_groups(items: DataFrame, max_distance: int = 20, n_words: int = 4, word_bits: int = 64,
                       agree: int | None = None) -> DataFrame:
    """(id, label, leader): near-duplicate groups within a label.

    Items are (id, label, views): the codes of an item in all its orientations, its own first. A
    leader's own code is compared with every orientation of a later item. Items with equal codes
    are one node, so copies cost one row each.
    """
    keyed = cut_lineage(items.withColumn("_code", F.sha2(F.concat_ws("|", F.col("label").cast("string"), F.array_join(F.flatten("views"), ",")), 256)))
    nodes = cut_lineage(keyed.groupBy("_code").agg(F.min("id").alias("node"), F.first("label").alias("label"), F.first("views").alias("views")))
    agree = agree or bands_to_agree(nodes.count(), n_words * word_bits, max_distance)
    own_code = F.get("views", F.lit(0))

    def blocks(some: DataFrame, agree: int) -> Blocks:
        keys = lambda v: band_keys(v, n_words, word_bits, max_distance, agree)
        block = lambda ks: F.explode(F.transform(ks, lambda k: F.xxhash64(k, F.col("label")))).alias("block")
        lead = some.select("node", block(keys(own_code)))
        member = some.select("node", block(F.array_distinct(F.flatten(F.transform("views", keys)))))
        return cut_lineage(lead), cut_lineage(member)

    def finer(inside: DataFrame) -> Blocks:
        return blocks(nodes.join(inside, "node", "left_semi"), agree + 1)

    own = nodes.select(F.col("node").alias("a"), F.col("label").alias("_la"), own_code.alias("_code_a"))
    all_ = nodes.select(F.col("node").alias("b"), F.col("label").alias("_lb"), F.col("views").alias("_views_b"))

    def near(pairs: DataFrame) -> DataFrame:
        closest = F.array_min(F.transform("_views_b", lambda v: hamming(F.col("_code_a"), v)))
        return (pairs.join(own, "a").join(all_, "b").filter(F.col("_la") == F.col("_lb")).filter(closest <= max_distance).select("a", "b"))

    led = assign_leaders(nodes, blocks(nodes, agree), near, finer)
    return (keyed.select("id", "label", "_code").join(nodes.select("_code", "node"), "_code").join(led, "node").select("id", "label", "leader"))


def bits_of(words: np.ndarray, bits: int) -> np.ndarray:
    """Rows of 64-bit words (the last one may be shorter) as rows of zeros and ones."""
    sizes = [min(64, bits - at) for at in range(0, bits, 64)]
    return np.hstack([(words[:, k, None] >> np.arange(n - 1, -1, -1, dtype=np.uint64) & np.uint64(1)).astype(np.uint8) for k, n in enumerate(sizes)])


class Codes(NamedTuple):
    """Codes in the order of their ones: row numbers, ones, orbits' ones first, and all orientations, own first."""

    at: np.ndarray
    ones: np.ndarray
    flat: np.ndarray
    views: list[np.ndarray]

    def only(self, keep: np.ndarray) -> Codes:
        return Codes(self.at[keep], self.ones[keep], self.flat[keep], [v[keep] for v in self.views])


def packed(bits: np.ndarray) -> np.ndarray:
    """Rows of zeros and ones as rows of 64-bit words that only serve to tell in how many cells rows differ."""
    full = np.zeros((len(bits), math.ceil(bits.shape[1] / 64) * 64), np.uint8)
    full[:, :bits.shape[1]] = bits
    return np.packbits(full, axis=1).view(np.uint64)


def ones_first(bits: np.ndarray, side: int) -> np.ndarray:
    """Rows of zeros and ones with the ones of each orbit moved to its first cells."""
    return np.hstack([bits[:, o].sum(axis=1, dtype=np.uint8)[:, None] > np.arange(len(o), dtype=np.uint8) for o in orbits(side)])


def telling(words: np.ndarray, side: int) -> np.ndarray:
    """The cells of ``ones_first`` by how well they tell codes apart, judged by some of the given ones. Any order gives the same pairs."""
    share = ones_first(bits_of(words[::math.ceil(len(words) / 4096)], side * side), side).mean(axis=0)
    return np.argsort(-share * (1 - share), kind="stable")


def codes_of(words: np.ndarray, side: int, order: np.ndarray, turned: bool) -> Codes:
    """``words`` made ready, with all orientations or only their own."""
    ones, flat, views, kept = [], [], [], orientations(side)[:None if turned else 1]
    for at in range(0, len(words), 8192):
        bits = bits_of(words[at:at + 8192], side * side)
        ones.append(bits.sum(axis=1, dtype=np.int64))
        flat.append(packed(ones_first(bits, side)[:, order]))
        views.append([packed(bits[:, cells]) for cells in kept])
    found = Codes(np.arange(len(words)), np.concatenate(ones), np.concatenate(flat), [np.concatenate(v) for v in zip(*views, strict=True)])
    return found.only(np.argsort(found.ones, kind="stable"))


def near_codes(a: Codes, b: Codes, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the near pairs of ``a`` and ``b``, some at a time; both made ready with one order, ``b`` with all orientations.

    An orientation moves bits inside their orbits only, so the differences of two codes' numbers of ones per orbit add up to at most their
    distance in every orientation. With the ones of each orbit first, they add up to the number of cells that differ. The words of the
    cells that tell most are compared for all pairs whose ones are not too far apart, the others for what is left, then all orientations.
    """
    lows, highs = np.searchsorted(b.ones, a.ones - max_distance), np.searchsorted(b.ones, a.ones + max_distance, "right")
    words = [(np.ascontiguousarray(x), np.ascontiguousarray(y)) for x, y in zip(a.flat.T[:ROUGH], b.flat.T[:ROUGH], strict=True)]
    left: list[tuple[np.ndarray, np.ndarray]] = []
    held = at = 0
    while at < len(a.at):
        low = lows[at]
        end = min(len(a.at), at + max(1, CELLS // max(1, highs[at] - low)))
        high = highs[end - 1]
        if low < high:
            apart = reduce(np.add, (np.bitwise_count(x[at:end, None] ^ y[low:high]) for x, y in words))
            found = np.flatnonzero(apart <= max_distance)
            if len(found):
                i, j = np.divmod(found, high - low)
                left.append((i + at, j + low))
                held += len(found)
        at = end
        if held > CELLS or held and at == len(a.at):
            i, j = (np.concatenate(x) for x in zip(*left, strict=True))
            left, held = [], 0
            for k in range(0, len(i), CELLS):
                p, q = i[k:k + CELLS], j[k:k + CELLS]
                keep = differing(a.flat, b.flat, p, q) <= max_distance
                p, q = p[keep], q[keep]
                keep = reduce(np.minimum, (differing(a.views[0], v, p, q) for v in b.views)) <= max_distance
                yield a.at[p[keep]], b.at[q[keep]]


def differing(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a.take(i, axis=0) ^ b.take(j, axis=0)).sum(axis=1, dtype=np.int64)


def near_in_tile(a: np.ndarray, b: np.ndarray, side: int, max_distance: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers of the pairs of codes (words of ``a`` and of ``b``) that are within the distance in some orientation, some pairs at a time."""
    if len(a) and len(b):
        order = telling(b, side)
        yield from near_codes(codes_of(a, side, order, False), codes_of(b, side, order, True), max_distance)


def led_in_order(words: np.ndarray, side: int, max_distance: int) -> np.ndarray:
    """The row number of the leader of each of a bounded number of codes that stand in their order, in one process: block by block, each
    against the leaders so far, what is left of it against itself."""
    leader, heads = np.full(len(words), -1), []
    order = telling(words, side) if len(words) else None
    for at in range(0, len(words), BLOCK):
        mine = codes_of(words[at:at + BLOCK], side, order, True)
        best = np.full(len(mine.at), len(words))
        for start, head in heads:
            for p, q in near_codes(head, mine, max_distance):
                np.minimum.at(best, q, start + p)
        mine = mine.only(best[mine.at] == len(words))
        pairs = [(p, q) for p, q in near_codes(mine, mine, max_distance)]
        p, q = (np.concatenate(x) for x in zip(*pairs, strict=True)) if pairs else (np.empty(0, int), np.empty(0, int))
        p, q = p[p < q], q[p < q]
        by = np.lexsort((p, q))
        p, q = p[by], q[by]
        firsts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]][:len(q)])
        leads = best == len(words)
        for k, end in itertools.pairwise([*firsts.tolist(), len(q)]):
            before = p[k:end][leads[p[k:end]]]
            if len(before):
                leads[q[k]], best[q[k]] = False, at + before[0]
        own = np.arange(at, at + len(best))
        leader[own] = np.where(leads, own, best)
        heads.append((at, mine.only(leads[mine.at])))
    return leader


def word_rows(t: pa.Table, names: Sequence[str]) -> np.ndarray:
    return np.stack([t[k].to_numpy().view(np.uint64) for k in names], axis=1)


def near_by_tiles(first: DataFrame, second: DataFrame | None, side: int, max_distance: int, tile: int = TILE) -> DataFrame:
    """(a, b) of nodes of one label within the distance, a before b: all pairs among ``first``, or for each node of ``second`` its earliest near one in ``first``.

    Nodes are (node, label, _words). They are dealt into tiles of some ``tile`` nodes at most; each pair of tiles is a group of its own, so
    memory is bounded by two tiles and work is spread over as many groups as there are pairs of tiles. Small tables get smaller tiles, to
    keep all cores busy; large ones send every node to as many groups as the other side has tiles.
    """
    within, wide = second is None, math.ceil(side * side / 64)
    second = first if within else second
    sizes, spread = [max(1, t.count()) for t in (first, second)], 2 * first.sparkSession.sparkContext.defaultParallelism
    tile = max(min(tile, LEAST_TILE), min(tile, math.ceil(math.sqrt(sizes[0] * sizes[1] / spread / (2 if within else 1)))))
    n, m = (math.ceil(s / tile) for s in sizes)
    words = [F.get("_words", F.lit(k)).alias(f"w{k}") for k in range(wide)]
    dealt = lambda many: F.pmod(F.xxhash64("node"), F.lit(many).cast("long"))
    others = lambda low, high: F.explode(F.sequence(low, F.lit(high).cast("long") if isinstance(high, int) else high))
    none = F.lit(0).cast("long")  # tiles are longs on both sides, as numbers of other types go to other partitions
    # Both sides may be the same table, so every column gets a name of its own. Among themselves, tile i meets those from i on.
    named = lambda t, k, many: t.select(dealt(many).alias(k), F.col("node").alias(f"{k}_node"), F.col("label").alias(f"{k}_label"), *words)
    left = named(first, "i", n).withColumn("j", others(F.col("i") if within else none, m - 1))
    right = named(second, "j", m).withColumn("i", others(none, F.col("j") if within else n - 1))
    parts = min(2 * n * m, 8 * spread)
    group = lambda t, k: t.repartition(parts, "i", "j", f"{k}_label").groupBy("i", "j", f"{k}_label")

    def met(x: pa.Table, y: pa.Table) -> pa.Table:
        words_of_table = lambda t: word_rows(t, [f"w{k}" for k in range(wide)])
        found_a, found_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if x.num_rows and y.num_rows:
            a, b, same = x["i_node"].to_numpy(), y["j_node"].to_numpy(), within and x["i"][0].as_py() == x["j"][0].as_py()
            for p, q in near_in_tile(words_of_table(x), words_of_table(y), side, max_distance):
                p, q = a[p], b[q]
                if within:  # a pair of two tiles is met once, one inside a tile both ways
                    some = p < q if same else p != q
                    p, q = np.minimum(p, q)[some], np.maximum(p, q)[some]
                else:
                    order = np.lexsort((p, q))
                    p, q = p[order], q[order]
                    some = np.r_[True, q[1:] != q[:-1]][:len(q)]
                    p, q = p[some], q[some]
                found_a.append(p)
                found_b.append(q)
        return pa.table({"a": np.concatenate(found_a), "b": np.concatenate(found_b)})

    pairs = group(left, "i").cogroup(group(right, "j")).applyInArrow(met, "a long, b long")
    return pairs if within else pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b")


def first_led(nodes: DataFrame, side: int, max_distance: int) -> DataFrame:
    """(node, leader) for a bounded number of nodes (node, label, _words), one task a label."""
    wide = math.ceil(side * side / 64)

    def led(t: pa.Table) -> pa.Table:
        t = t.sort_by("node")
        at = led_in_order(word_rows(t, [f"w{k}" for k in range(wide)]), side, max_distance)
        return pa.table({"node": t["node"], "leader": t["node"].take(pa.array(at))})

    words = [F.get("_words", F.lit(k)).alias(f"w{k}") for k in range(wide)]
    return nodes.select("node", "label", *words).groupBy("label").applyInArrow(led, "node long, leader long")


def leaders_by_tiles(nodes: DataFrame, side: int, max_distance: int, first: int = STRETCH, most: int = PAIRS) -> DataFrame:
    """(node, leader) for every node (node, label, _words); a node's number is its place in the order.

    The order is gone through in stretches, each about as long as all before it. The first one, of bounded length, is led in one task a label. Nodes near a
    leader of an earlier stretch join the earliest such one; only what is left meets among itself. So where very many nodes are near each other, few pairs are written: those before have led.
    A stretch that would still write over ``most`` pairs, told by ``first`` of its nodes, is gone through in two.
    """
    steps = max(0, math.ceil(math.log2(max(1, nodes.count()) / first)))
    cuts = sorted({int(c) for c in nodes.approxQuantile("node", [2.0 ** -k for k in range(1, steps + 1)], 0.001)}) if steps else []
    todo, leaders, done = list(itertools.pairwise([None, *cuts, None]))[::-1], None, []
    while todo:
        low, high = todo.pop()
        mine = nodes if low is None else nodes.filter(F.col("node") > low)
        mine = cut_lineage((mine if high is None else mine.filter(F.col("node") <= high)).select("node", "label", "_words"))
        if leaders is None:
            led = cut_lineage(first_led(mine, side, max_distance))
            done.append(led)
            leaders = cut_lineage(mine.join(led.filter("node = leader").select("node"), "node", "left_semi"))
            continue
        joined = cut_lineage(near_by_tiles(leaders, mine, side, max_distance).select(F.col("b").alias("node"), F.col("a").alias("leader")))
        mine = cut_lineage(mine.join(joined, "node", "left_anti"))
        share = mine.count() / first
        if share > 1:
            some = mine.filter(F.pmod(F.xxhash64("node", F.lit(1)), F.lit(math.ceil(share))) == 0)
            middle = int(mine.approxQuantile("node", [0.5], 0.01)[0])
            if near_by_tiles(some, None, side, max_distance).count() * share ** 2 > most and not mine.filter(F.col("node") > middle).isEmpty():
                todo += [(middle, high), (low, middle)]
                continue
        done.append(joined)
        edges = cut_lineage(near_by_tiles(mine, None, side, max_distance))
        lead = cut_lineage(greedy_leaders(mine.select("node"), edges))
        done.append(lead.select("node", F.col("node").alias("leader")))
        done.append(cut_lineage(edges.join(lead.withColumnRenamed("node", "a"), "a", "left_semi").groupBy(F.col("b").alias("node")).agg(F.min("a").alias("leader"))))
        mine = mine.join(lead, "node", "left_semi")
        leaders = cut_lineage(leaders.unionByName(mine))
    return reduce(DataFrame.unionByName, done)


def least_views(items: DataFrame, side: int) -> DataFrame:
    """Items with ``_code``, a string of ``side * side`` zeros and ones or null, replaced by the least of its orientations in bytes, and its ``_words``."""
    bits, wide = side * side, math.ceil(side * side / 64)
    cut = [min(64, bits - at) for at in range(0, bits, 64)]
    schema = T.StructType([f for f in items.schema if f.name != "_code"]).add("_code", T.BinaryType()).add("_words", T.ArrayType(T.LongType()))

    def words(rows: np.ndarray) -> np.ndarray:
        full = np.zeros((len(rows), wide, 64), np.uint8)
        for k, n in enumerate(cut):
            full[:, k, 64 - n:] = rows[:, 64 * k:64 * k + n]
        return np.packbits(full, axis=2).view(">u8").reshape(len(rows), wide).astype(np.uint64)

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code = batch.column("_code")
            there = np.flatnonzero(code.is_valid().to_numpy(zero_copy_only=False))
            rows = (np.frombuffer("".join(code.drop_null().to_pylist()).encode(), np.uint8) - 48).reshape(-1, bits)
            best = words(rows)
            for cells in orientations(side)[1:]:
                view = words(rows[:, cells])
                differ = view != best
                at = np.argmax(differ, axis=1)[:, None]
                less = np.take_along_axis(view, at, 1)[:, 0] < np.take_along_axis(best, at, 1)[:, 0]
                best[less] = view[less]
            keys, lists = np.full(batch.num_rows, None, object), np.full(batch.num_rows, None, object)
            for i, key, row in zip(there.tolist(), best.astype(">u8"), best.view(np.int64), strict=True):
                keys[i], lists[i] = key.tobytes(), row
            rest = [batch.column(k) for k in range(batch.num_columns) if batch.schema.names[k] != "_code"]
            names = [k for k in batch.schema.names if k != "_code"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(keys, pa.binary()), pa.array(lists, pa.list_(pa.int64()))], [*names, "_code", "_words"])

    return items.mapInArrow(least, schema)


def turned_groups(items: DataFrame, max_distance: int = 20, side: int = 16, agree: int | None = None) -> DataFrame:
    """(id, label, leader): near-duplicate groups within a label, whichever way round an item lies.

    Items are (id, label, code), codes strings of ``side * side`` zeros and ones. The distance of two codes is the least over the eight
    orientations of the later one; as these form a group it is the same both ways, and all orientations of a code are one
    node, named by the least of them. Ids are unique. A null label is a label of its own; a null code or one of another
    length is near nothing and leads itself. ``agree`` is taken for the sake of older callers and changes nothing.
    """
    known = F.col("code").rlike(f"^[01]{{{side * side}}}$")
    keyed = cut_lineage(least_views(items.select("id", "label", F.when(known, F.col("code")).alias("_code")), side))
    alone = keyed.filter("_code IS NULL").select("id", "label", F.col("id").alias("leader"))
    coded = keyed.filter("_code IS NOT NULL")
    nodes = cut_lineage(coded.groupBy("label", "_code").agg(F.min("id").alias("node"), F.first("_words").alias("_words")))
    led = leaders_by_tiles(nodes, side, max_distance)
    named = nodes.select(F.col("label").alias("_l"), F.col("_code").alias("_c"), "node").join(led, "node")
    return (coded.join(named, F.col("label").eqNullSafe(F.col("_l")) & (F.col("_code") == F.col("_c"))).select("id", "label", "leader")
            .unionByName(alone))


# ---- texts within a batch -------------------------------------------------------------------
def gram_ranges(ratio: float) -> list[tuple[int, int, int | None]]:
    """(n-gram length, shortest text, longest text) by which texts meet, for any ratio above 2/3.

    Of n-grams of length g two near texts share at least one if the shorter has more than (g - 1) / (1 - g (1 - ratio)) characters.
    Short texts therefore go by single characters, longer ones by longer n-grams, which fewer texts share. The shorter of a
    near pair has more than ``ratio`` of the longer's length, so ranges overlap by that much and each near pair
    lies in one of them together.
    """
    ranges, low = [], 1
    for gram, longer, usual in ((1, 3, 4), (3, 6, 39), (6, None, None)):
        share = 0.0 if longer is None else 1 - longer * (1 - ratio)
        if share <= 1e-9:
            return [*ranges, (gram, low, None)]
        high = max(usual, math.ceil((math.floor((longer - 1) / share) + 1) / ratio))
        ranges.append((gram, low, high))
        low = math.floor(ratio * (high + 1) + 1e-9)
    return ranges


def similar(a: Column, b: Column, ratio: float) -> Column:
    """Edit similarity ``1 - distance / longer`` strictly above ``ratio``; lengths are compared first."""
    longer, gap = F.greatest(F.char_length(a), F.char_length(b)), F.abs(F.char_length(a) - F.char_length(b))
    return (gap < (1 - ratio) * longer + 1) & (1 - F.levenshtein(a, b) / longer > ratio)


def block_ratio(a: Column, b: Column) -> Column:
    """Matching-block similarity 2 M / T: M characters in the longest common block and, on both sides of it, in the blocks of what is left.

    The measure is the standard library's, whose first argument is the later text; the order matters where blocks tie.
    """
    @F.pandas_udf("double")
    def ratio(first: pd.Series, second: pd.Series) -> pd.Series:
        return pd.Series([difflib.SequenceMatcher(None, x, y).ratio() for x, y in zip(first, second, strict=True)], dtype="float64")

    return ratio(a, b)


def rare_grams(nodes: DataFrame, ratio: float, gram: int, shortest: int, longest: int | None) -> DataFrame:
    """(node, block): the rarest character n-grams of a text, as many as a near text cannot all miss.

    With fewer than (1 - ratio) * M edits, M the longer length, two texts share all but ``gram``
    n-grams per edit. Taken in one order of rarity, their first so many n-grams then meet.
    """
    size = F.char_length("_norm")
    n = size - gram + 1
    nodes = nodes.filter(size >= shortest) if longest is None else nodes.filter(size.between(shortest, longest))
    grams = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring("_norm", i, F.lit(gram)))
    rows = nodes.select("batch", "node", n.alias("n"), F.explode(grams).alias("gram"))
    counted = rows.groupBy("batch", "node", "n", "gram").agg(F.count("*").alias("times"))
    # Repeated n-grams are told apart by their number, so that common ones are counted with repeats.
    each = counted.select("batch", "node", "n", F.explode(F.transform(F.sequence(F.lit(1).cast("long"), "times"), lambda i: F.struct("gram", i.alias("no")))).alias("g"))
    freq = each.groupBy("batch", "g").agg(F.count("*").alias("df"))
    ranked = each.join(freq, ["batch", "g"]).groupBy("batch", "node", "n").agg(F.sort_array(F.collect_list(F.struct("df", "g"))).alias("gs"))
    share = 1 - gram * (1 - ratio)
    must = F.ceil(F.round(share * (F.col("n") + gram - 1), 6)) - (gram - 1)
    head = F.slice("gs", F.lit(1), (F.col("n") - must + 1).cast("int"))
    return ranked.select("node", "batch", F.explode(head).alias("x")).select("node", F.xxhash64("batch", "x.g").alias("block"))


def dedup_in_batches(msgs: DataFrame, banned: str, ratio: float = 0.9, longest: int = 320, measure: str = "edits") -> DataFrame:
    """(id, batch, outcome) of generated messages (id, batch, text): kept, or why not.

    Cleaned first; then a message is a duplicate if an earlier kept one of its batch has the same
    normal form or is similar to it. Batches of every size go by their rare n-grams. A null text counts as empty.

    Similar is, with the measure "edits", an edit similarity above ``ratio``, with "blocks" a matching-block ratio 2 M / T above it.
    Matching blocks stand in the same order in both texts, so T - 2 M edits turn one into the other: above ``ratio`` these are fewer than
    (1 - ratio) T, at most 2 (1 - ratio) of the longer text. Pairs by blocks thus are among those of edit similarity above
    2 ``ratio`` - 1, which meet by n-grams and are counted inside the JVM; only those are measured in Python.
    """
    if measure not in ("edits", "blocks"):
        raise ValueError("measure is edits or blocks")
    blocks_above = ratio if measure == "blocks" else None
    if blocks_above is not None:
        ratio = round(2 * ratio - 1, 9)
    if ratio <= 2 / 3:
        raise ValueError("ratio too low for n-grams")
    marked = msgs.select("id", "batch", clean_generated(F.coalesce("text", F.lit(""))).alias("_text"))
    marked = marked.withColumn("_why", generated_reason("_text", banned, longest)).withColumn("_norm", norm_text("_text"))
    usable = marked.filter(F.col("_why").isNull())
    nodes = cut_lineage(usable.groupBy("batch", "_norm").agg(F.min("id").alias("node")))
    parts = [rare_grams(nodes, ratio, *part) for part in gram_ranges(ratio)]
    blocks = reduce(DataFrame.unionByName, parts)
    blocks = cut_lineage(blocks)
    texts = nodes.select(F.col("node").alias("a"), F.col("batch").alias("_ba"), F.col("_norm").alias("_a"))

    def near(pairs: DataFrame) -> DataFrame:
        other = texts.select(F.col("a").alias("b"), F.col("_ba").alias("_bb"), F.col("_a").alias("_b"))
        close = (pairs.join(texts, "a").join(other, "b").filter(F.col("_ba") == F.col("_bb"))
                 .filter(similar(F.col("_a"), F.col("_b"), ratio)))
        if blocks_above is not None:
            close = close.filter(block_ratio(F.col("_b"), F.col("_a")) > blocks_above)
        return close.select("a", "b")

    led = assign_leaders(nodes, (blocks, blocks), near).filter("node = leader").select(F.col("node").alias("id"), F.lit(True).alias("_kept"))
    return (marked.join(led, "id", "left")
            .select("id", "batch", F.when(F.col("_why").isNotNull(), F.col("_why")).when(F.col("_kept"), "kept").otherwise("duplicate").alias("outcome")))

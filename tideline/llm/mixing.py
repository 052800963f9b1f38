"""Mixing sources to target weights by fixed-length blocks of words.

The words of a source, document after document, are packed into blocks. The mix is a row of block slots
cut into output shards. Each shard draws how many of its slots every source gets (one multinomial draw per
shard), the slots of a source are numbered through all shards, and slot number k takes the block that
a pseudorandom permutation of the source's block numbers puts at k. A source's permutation
differs in each round through its blocks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tideline.functions.vector import let
from tideline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
PRIMES = (999999999999999989, 999999999999999967, 999999999999999877, 999999999999999863, 999999999999999809)  # larger than any block count
CELLS = 1024  # of the slot range, by which a draw meets its source
ROWS_PER_BUCKET = 20_000
SLOTS_PER_TASK = 1 << 18


def number(*parts: Column | str) -> Column:
    """A pseudorandom 60-bit number of some values: the first 15 digits of their md5."""
    values = [F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("-")) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws(":", *values)), 1, 15), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0) -> DataFrame:
    """One row per source: ``source``, ``source_size``, ``weight``, ``target``.

    Sources in code-point order, null last, take the weights in turn. A target is the source's share of all
    words by weight, at most ``most`` times its size; what is cut off goes to the others by weight.
    That is one level per unit of weight above which the cut sources lie: cut sources come first in the order of
    ``most * size / weight``, and the level is what they leave over the weights of the rest.
    """
    sums = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = sums.withColumn("_rank", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    order = W.orderBy(F.col("cap") / F.col("weight"), "_rank")
    ranked = ranked.withColumn("_total", F.sum("source_size").over(W.partitionBy())) \
        .withColumn("_cut", F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) \
        .withColumn("_rest", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    ranked = ranked.withColumn("_level", (F.col("_total") - F.col("_cut")) / F.col("_rest"))
    # A source is cut if the level without the sources before it still exceeds its own cap.
    ranked = ranked.withColumn("_over", F.col("_level") * F.col("weight") > F.col("cap"))
    level = F.max(F.when(~F.col("_over"), F.col("_level"))).over(W.partitionBy())
    return ranked.withColumn("target", F.when(F.col("_over"), F.col("cap")).otherwise(F.coalesce(level, F.lit(0.0)) * F.col("weight"))) \
        .select("source", "source_size", "weight", "_rank", "target")


def placed(df: DataFrame, seed: str) -> DataFrame:
    """Adds ``place``: the words of the source before this row, in a pseudorandom order of its rows.

    ``df`` has ``source``, ``size``, ``doc_id`` and ``tie`` (tells rows of one doc_id apart). The order's own number cuts a
    source into buckets of few rows; bucket totals are summed on, and the row-level window runs inside
    a bucket, so a source with a third of all rows is spread like the others.
    """
    buckets = min(65_536, max(1, -(-df.count() // ROWS_PER_BUCKET)))
    df = df.withColumn("_at", number(seed, F.col("doc_id"))).withColumn("_bucket", F.floor(F.col("_at") / F.lit(float(1 << 60)) * buckets))
    totals = df.groupBy("source", "_bucket").agg(F.sum("size").alias("_sum"))
    before = W.partitionBy("source").orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("source", "_bucket", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_start"))
    inside = W.partitionBy("source", "_bucket").orderBy("_at", "doc_id", "tie").rowsBetween(W.unboundedPreceding, -1)
    rows = df.withColumn("_inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    met = rows.alias("r").join(starts.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & (F.col("r._bucket") == F.col("s._bucket")))
    return met.select("r.*", (F.col("_inside") + F.col("_start")).alias("place")).drop("_at", "_bucket", "_inside")


def plan(sizes: DataFrame, block: int, weights: Sequence[float], most: float) -> DataFrame:
    """Targets with ``blocks`` and ``slots`` of each source and the slot numbers ``low`` to ``high`` that stand for it in a draw."""
    told = targets(sizes, weights, most).withColumn("blocks", F.ceil(F.col("source_size") / block).cast("long"))
    slots = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.round(F.col("blocks") * F.col("target") / F.col("source_size"))).cast("long")
    upto = W.orderBy("_rank").rowsBetween(W.unboundedPreceding, 0)
    told = told.withColumn("slots", slots).withColumn("high", F.sum("slots").over(upto))
    return told.withColumn("low", F.col("high") - F.col("slots"))


def drawn_slots(spark, told: DataFrame, shard_slots: int, seed: str) -> DataFrame:
    """One row per slot: ``shard``, ``_rank`` (of the source) and ``k`` (number of the slot within its source).

    Every slot draws its source with the probability of the source's share, which makes the counts of a shard a
    multinomial draw. Over all shards a source may be drawn somewhat more or less often than its target
    says; slots beyond it are then handed on, in order, to the sources that lack some, so totals are exact.
    """
    all_slots = told.agg(F.max("high")).first()[0] or 0
    width = max(1, -(-all_slots // CELLS))
    slots = spark.range(all_slots).select(F.floor(F.col("id") / shard_slots).alias("shard"), (number(seed, F.col("id")) % max(1, all_slots)).alias("_r"))
    ranges = told.filter("slots > 0").select("_rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("_cell"))
    counts = slots.withColumn("_cell", F.floor(F.col("_r") / width)).join(ranges, "_cell").filter("_r >= low and _r < high") \
        .groupBy("shard", "_rank").agg(F.count(F.lit(1)).alias("count"))
    counts = cut_lineage(counts)  # what each shard drew from each source
    numbered = counts.withColumn("_end", F.sum("count").over(W.partitionBy("_rank").orderBy("shard").rowsBetween(W.unboundedPreceding, 0)))
    # Dealt out by shard before the slots are written out: a task gets the few rows of its shards, not all of a source. The
    # number is given, as these rows are few until then and would else be put together again.
    each = numbered.repartition(max(1, -(-all_slots // SLOTS_PER_TASK)), "shard").select("shard", "_rank", F.explode(F.sequence(F.col("_end") - F.col("count"), F.col("_end") - 1)).alias("k")) \
        .join(told.select("_rank", "slots"), "_rank")
    drawn = counts.groupBy("_rank").agg(F.sum("count").alias("drawn"))
    balance = told.select("_rank", "slots").join(drawn, "_rank", "left").fillna(0, ["drawn"])
    earlier = W.orderBy("_rank").rowsBetween(W.unboundedPreceding, -1)
    extra = balance.withColumn("_base", F.coalesce(F.sum(F.greatest(F.col("drawn") - F.col("slots"), F.lit(0))).over(earlier), F.lit(0))).select("_rank", "_base")
    spare = each.filter("k >= slots").join(extra, "_rank").select("shard", (F.col("_base") + F.col("k") - F.col("slots")).alias("_turn"))
    lacking = balance.withColumn("_lack", F.greatest(F.col("slots") - F.col("drawn"), F.lit(0))) \
        .withColumn("_from", F.coalesce(F.sum("_lack").over(earlier), F.lit(0))).filter("_lack > 0") \
        .select("_rank", "_from", "drawn", F.explode(F.sequence(F.col("_from"), F.col("_from") + F.col("_lack") - 1)).alias("_turn")) \
        .select("_turn", "_rank", (F.col("drawn") + F.col("_turn") - F.col("_from")).alias("k"))
    return each.filter("k < slots").select("shard", "_rank", "k").unionByName(spare.join(lacking, "_turn").select("shard", "_rank", "k"))


def drawn_blocks(slots: DataFrame, told: DataFrame, seed: str) -> DataFrame:
    """Adds ``round`` and ``block``: the k-th slot takes block (a * k + b) modulo the source's blocks, where a is a prime, hence
    without a common factor, and both change with source and round. Products are taken as decimals."""
    rows = slots.join(told.select("_rank", "blocks"), "_rank").withColumn("round", F.floor(F.col("k") / F.col("blocks")))
    x = (F.col("k") % F.col("blocks")).cast("decimal(19,0)")
    mixed = number(seed, F.lit("round"), F.col("_rank"), F.col("round"))
    a = (F.element_at(F.array(*[F.lit(p) for p in PRIMES]), (mixed % len(PRIMES) + 1).cast("int")) % F.col("blocks")).cast("decimal(18,0)")
    b = (mixed % F.col("blocks")).cast("decimal(18,0)")
    return rows.withColumn("block", ((a * x + b) % F.col("blocks").cast("decimal(18,0)")).cast("long")).drop("blocks")


def mix(df: DataFrame, weights: Sequence[float] = (5, 2, 1), most: float = 3.0, block: int = 32, shard_slots: int = 8192,
        seed: str = "mix") -> tuple[DataFrame, DataFrame]:
    """Mixes the rows of ``df`` (``doc_id``, ``source``, ``text``, any others).

    Returns two tables. The first has a row per input row, without its text: ``doc_id``, ``source``, ``tie``, ``size`` (words),
    ``place``, ``source_size``, ``target``. The second has the spans of the mix: ``shard``, ``round``, ``block`` and, for each
    row that the block cuts, ``source``, ``place``, ``first`` (number of the first word taken) and ``n_words``; it holds a span as
    often as it is taken. A row of size s is taken at most ceil(most) * s words, as no block comes more often.

    A null text has no words; a source without words has target 0; null sources are one source, sorted
    last. Repeated rows are rows of their own: each has its own place. An empty table gives two empty ones.
    The same input gives the same result on every run: all choices come from md5 of seeds and numbers.
    """
    spark = df.sparkSession
    size = F.coalesce(F.regexp_count(F.col("text"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = cut_lineage(df.select("doc_id", "source", size.alias("size"), F.md5("text").alias("tie")))
    told = cut_lineage(plan(rows.select("source", "size"), block, weights, most))
    at = cut_lineage(placed(rows, seed))
    labels = told.select("source", "_rank", "source_size", "target")
    at = at.alias("r").join(labels.alias("t"), F.col("r.source").eqNullSafe(F.col("t.source"))).select("r.*", "_rank", "source_size", "target")
    pieces = at.filter("size > 0").select("_rank", "source", "place", "size", F.explode(F.sequence(
        F.floor(F.col("place") / block), F.floor((F.col("place") + F.col("size") - 1) / block))).alias("block"))
    low = F.greatest(F.col("place"), F.col("block") * block)
    high = F.least(F.col("place") + F.col("size"), (F.col("block") + 1) * block)
    pieces = pieces.select("_rank", "source", "block", "place", (low - F.col("place")).alias("first"), (high - low).alias("n_words"))
    blocks = drawn_blocks(drawn_slots(spark, told, shard_slots, seed), told, seed)
    spans = blocks.join(pieces, ["_rank", "block"]).select("shard", "round", "block", "source", "_rank", "place", "first", "n_words")
    return at, spans


def taken(df: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``size``, ``source_size``, ``target`` and ``taken`` (words of the row in the mix, repeats counted) of every row."""
    rows, spans = mix(df, **options)
    sums = spans.groupBy("_rank", "place").agg(F.sum("n_words").alias("taken"))
    # Rows without words share the place of the next row, so only rows with words may meet the sums.
    joined = rows.withColumn("_with", F.when(F.col("size") > 0, F.col("place"))).alias("r").join(
        sums.alias("s"), (F.col("r._rank") == F.col("s._rank")) & (F.col("r._with") == F.col("s.place")), "left")
    return joined.select("doc_id", "r.source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mixed_texts(df: DataFrame, **options) -> DataFrame:
    """The mix as documents: for every row and round in which words of it are taken, a row with all columns of ``df``, its ``text``
    cut down to the words taken, in their order with single spaces (unchanged if all are taken), and ``n_chars`` set anew.

    Rows without a taken word are absent. Options and odd cases are those of ``mix``.
    """
    rows, spans = mix(df, **options)
    parts = spans.groupBy("_rank", "place", "round").agg(F.array_sort(F.collect_list(F.struct("first", "n_words"))).alias("_spans"), F.sum("n_words").alias("_taken"))
    named = rows.filter("size > 0").select("_rank", "place", "doc_id", "source", "tie", "size").join(parts, ["_rank", "place"])
    texts = df.withColumn("_tie", F.md5("text")).dropDuplicates(["doc_id", "source", "_tie"])
    met = texts.alias("d").join(named.alias("n"), F.col("d.doc_id").eqNullSafe(F.col("n.doc_id")) & F.col("d.source").eqNullSafe(F.col("n.source"))
                                & (F.col("d._tie") == F.col("n.tie")))
    words = F.regexp_extract_all("d.text", F.lit(WORD), 0)
    # Bound by ``let``, as an expression inside a lambda would split the text anew for every span.
    cut = let(words, lambda w: F.array_join(F.flatten(F.transform("n._spans", lambda s: F.slice(w, (s["first"] + 1).cast("int"), s["n_words"].cast("int")))), " "))
    text = F.when(F.col("n._taken") == F.col("n.size"), F.col("d.text")).otherwise(cut)
    new = {"text": text, "n_chars": F.length(text).cast("long")}
    return met.select([new[c].alias(c) if c in new else F.col(f"d.{c}").alias(c) for c in df.columns])

"""Near duplicates by bottom-k sketches.

One hash function is applied to the word shingles of a document, and its sketch holds the k least values.
Inverted lists of the first retained values give overlaps between documents; pairs with enough
overlap are estimated on their union sketch (the k least values of both), and what passes is confirmed by the exact
Jaccard similarity of the full sets. Linked documents form groups.

Documents with equal sets are one node from the start. A list longer than ``HOT`` (a passage that very many texts
share, or a large family of near copies) is not paired. A pair that shares a short list too is found there; a pair whose common
values may all lie in long lists is found among the "hot" nodes, which are blocked by the first values of
their sketches and compared chunk by chunk with their full sets, whatever their number.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.components import components
from tideline.llm.worker import kept, slices, texts_of
from tideline.session import cut_lineage

SKETCH = 64  # values of a sketch
INDEX = 32  # of them in inverted lists
# Two sets of similarity 0.8 have in common, of the 32 least values of their union, 25.6 on average; fewer than 13 happen
# once in 10^7 pairs, and fewer than 35 of 64 once in 10^6. Sets of at most as many values are compared exactly.
LEAST_COMMON, LEAST_SHARE = 13, 35 / 64
HOT = 128  # entries of a list that is still paired
KEYS = 12  # values by which hot nodes are blocked
CHUNK_ROWS, CHUNK_SHINGLES = 768, 500_000


class _Hashes(dict):
    def __missing__(self, word):
        if len(self) > 150_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, words: int) -> np.ndarray:
    """Sorted distinct hashes of the runs of ``words`` words, A-Z lower-cased; of the whole text if it has fewer."""
    found = text.encode().lower().split()
    if not found:
        return np.empty(0, np.int64)
    h = np.fromiter(map(kept("word hashes", _Hashes).__getitem__, found), np.uint64, len(found))
    width = min(words, len(found))
    n = len(found) - width + 1
    mixed = np.full(n, width, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(width):
            mixed = (mixed ^ h[j:j + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xFF51AFD7ED558CCD)
        mixed ^= mixed >> np.uint64(33)
    return np.unique(mixed.view(np.int64))


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, arrays)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int64)))


def sketches(df: DataFrame, words: int, carry: list[str], text: str = "text") -> DataFrame:
    """``carry`` and ``n_shingles``, ``digest`` (of the full set, null if empty), ``sketch``."""
    source = df.select(*carry, F.col(text).alias("_text"))

    def run(batches):
        for batch in slices(batches):
            sets = [shingle_set(t, words) for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(map(len, sets), pa.int64()),
                 pa.array([xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets], pa.binary()),
                 _lists([s[:SKETCH] for s in sets])], names=[*carry, "n_shingles", "digest", "sketch"])

    schema = source.drop("_text").schema.add("n_shingles", "long").add("digest", "binary").add("sketch", T.ArrayType(T.LongType()))
    return source.mapInArrow(run, schema)


def _required(n: Column) -> Column:
    """Values that two similar sets, the larger of ``n``, have at least in common among the indexed ones."""
    return F.when(n <= INDEX, F.ceil(n * 0.8)).otherwise(F.lit(LEAST_COMMON))


def _left_by_partner(n: Column) -> Column:
    """Values that a set of ``n`` has at least in common with a similar one, of which the partner may be too large to index all."""
    return F.when(n * 100 <= INDEX * 80, F.ceil(n * 0.8)).otherwise(F.lit(LEAST_COMMON))


def overlapping_pairs(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pairs ``a`` < ``b`` with enough overlap in short lists, and the ids of hot nodes.

    ``nodes`` has ``id``, ``n_shingles``, ``sketch``.
    """
    entries = nodes.select("id", "n_shingles", F.explode(F.slice("sketch", 1, INDEX)).alias("value"))
    lengths = entries.groupBy("value").agg(F.count(F.lit(1)).alias("length")).filter("length > 1")
    entries = cut_lineage(entries.join(lengths, "value").select("value", "id", "n_shingles", F.col("length") > HOT, "length").toDF(
        "value", "id", "n_shingles", "is_hot", "length"))
    hot = entries.filter("is_hot").groupBy("id").agg(F.count(F.lit(1)).alias("hot"), F.first("n_shingles").alias("n_shingles"))
    hot = cut_lineage(hot)
    short = entries.filter("not is_hot").select("value", "id", "n_shingles")
    left = short.select("value", F.col("id").alias("a"), F.col("n_shingles").alias("na"))
    right = short.select("value", F.col("id").alias("b"), F.col("n_shingles").alias("nb"))
    similar = (F.col("a") < F.col("b")) & (F.col("na") * 100 >= F.col("nb") * 80) & (F.col("nb") * 100 >= F.col("na") * 80)
    counted = left.join(right, "value").filter(similar).groupBy("a", "b").agg(
        F.count(F.lit(1)).alias("common"), F.greatest(F.first("na"), F.first("nb")).alias("n"))
    of = hot.select("id", "hot")
    counted = counted.join(of.toDF("a", "hot_a"), "a", "left").join(of.toDF("b", "hot_b"), "b", "left").fillna(0, ["hot_a", "hot_b"])
    enough = F.col("common") + F.least("hot_a", "hot_b") >= _required(F.col("n"))
    return counted.filter(enough).select("a", "b"), hot.filter(F.col("hot") >= _left_by_partner(F.col("n_shingles"))).select("id")


def estimated(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose union sketch lets a similarity of 0.8 seem possible."""
    own = nodes.select("id", "sketch")
    met = pairs.join(own.toDF("a", "sa"), "a").join(own.toDF("b", "sb"), "b")
    union = F.slice(F.array_sort(F.array_union("sa", "sb")), 1, SKETCH)
    common = F.size(F.array_intersect(F.array_intersect("sa", "sb"), union))
    return met.filter(common >= F.size(union) * LEAST_SHARE).select("a", "b")


def full_sets(df: DataFrame, needed: DataFrame, words: int) -> DataFrame:
    """``id`` and ``shingles`` of the nodes in ``needed`` (``row_key``, ``id``); texts of other rows are not shuffled to Python."""
    rows = df.withColumn("row_key", row_key()).select("row_key", "text").join(needed, "row_key").select("id", "text")

    def run(batches):
        for batch in slices(batches, 256):
            yield pa.RecordBatch.from_arrays([batch.column(0), _lists([shingle_set(t, words) for t in texts_of(batch.column(1))])], names=["id", "shingles"])

    return rows.mapInArrow(run, "id long, shingles array<long>").dropDuplicates(["id"])


def row_key() -> Column:
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs with 100 * intersection >= 80 * union."""
    met = pairs.join(sets.toDF("a", "sa"), "a").join(sets.toDF("b", "sb"), "b")
    met = met.select("a", "b", F.size("sa").cast("long").alias("na"), F.size("sb").cast("long").alias("nb"), F.size(F.array_intersect("sa", "sb")).cast("long").alias("c"))
    return met.filter(F.col("c") * 100 >= (F.col("na") + F.col("nb") - F.col("c")) * 80).select("a", "b")


def hot_links(nodes: DataFrame, hot: DataFrame, sets: DataFrame) -> DataFrame:
    """Links among hot nodes that connect whatever is similar.

    Of the ``KEYS`` least values of their union two similar sets have one in common (but once in 10^8 pairs), so nodes that are not
    connected by such values are never compared. What is connected is cut into chunks of rows of like size; each two chunks meet in
    one group, and sizes too far apart do not meet. A group compares full sets exactly and returns a spanning forest, not its pairs.
    """
    own = nodes.join(hot, "id").select("id", "n_shingles", F.slice("sketch", 1, KEYS).alias("s"))
    keyed = own.select("id", F.explode("s").alias("value"))
    heads = keyed.groupBy("value").agg(F.min("id").alias("head"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    cluster = components(keyed.join(heads, "value").select(F.col("id").alias("a"), F.col("head").alias("b")).distinct())
    # Of sets in one class or in neighbouring ones the smaller may have 0.8 of the larger.
    size_class = F.floor(F.log(F.col("n_shingles")) / F.log(F.lit(1.25))).cast("int")
    placed = cut_lineage(own.select("id", "n_shingles").join(cluster, "id").withColumn("size_class", size_class))
    parts = placed.groupBy("root", "size_class").agg(F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK_ROWS), F.ceil(F.sum("n_shingles") / CHUNK_SHINGLES)).alias("parts"))
    chunked = placed.join(parts, ["root", "size_class"]).withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")))
    above = parts.select("root", (F.col("size_class") - 1).alias("size_class"), F.col("parts").alias("parts_above"))
    below = parts.select("root", (F.col("size_class") + 1).alias("size_class"), F.col("parts").alias("parts_below"))
    chunked = chunked.join(above, ["root", "size_class"], "left").join(below, ["root", "size_class"], "left").fillna(0, ["parts_above", "parts_below"])
    meet = lambda count, one: F.when(count > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(count, F.lit(1)) - 1), one)).otherwise(F.array())
    same = meet(F.col("parts"), lambda p: F.struct(F.col("size_class").alias("c"), F.least(p, F.col("part")).alias("i"), F.col("size_class").alias("d"), F.greatest(p, F.col("part")).alias("j")))
    up = meet(F.col("parts_above"), lambda p: F.struct(F.col("size_class").alias("c"), F.col("part").alias("i"), (F.col("size_class") + 1).alias("d"), p.alias("j")))
    down = meet(F.col("parts_below"), lambda p: F.struct((F.col("size_class") - 1).alias("c"), p.alias("i"), F.col("size_class").alias("d"), F.col("part").alias("j")))
    groups = chunked.select("id", "root", F.explode(F.concat(same, up, down)).alias("g")).select("id", "root", "g.*")
    met = groups.join(sets, "id")

    def compare(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        lists = table.column("shingles").combine_chunks()
        n = np.diff(lists.offsets.to_numpy())
        values, at, times = np.unique(lists.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), n)
        shared = times[at] > 1
        column = (np.cumsum(times > 1) - 1)[at[shared]]
        row = row[shared]
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        common = np.zeros((len(ids), len(ids)), np.float32)
        wide = 4096
        for start in range(0, int(column[-1]) + 1 if len(column) else 0, wide):
            lo, hi = np.searchsorted(column, [start, start + wide])
            block = np.zeros((len(ids), wide), np.float32)
            block[row[lo:hi], column[lo:hi] - start] = 1
            common += block @ block.T
        linked = np.argwhere(np.triu(100 * common >= 80 * (n[:, None] + n[None, :] - common), 1))
        parent = list(range(len(ids)))

        def root(i):
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        out = []
        for i, j in linked.tolist():
            x, y = root(i), root(j)
            if x != y:
                parent[y] = x
                out.append((ids[i], ids[j]))
        return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})

    return met.groupBy("root", "c", "i", "d", "j").applyInArrow(lambda t: compare(t), "a long, b long")


def near_duplicates(df: DataFrame, words: int = 5) -> DataFrame:
    """Per row of ``df`` (``doc_id``, ``text``, any others): ``doc_id``, ``n_shingles``, ``component_id``, ``kept``, ``group_key``, ``row_key``.

    ``component_id`` is the least ``doc_id`` that is reachable through links, the row's own if it has none;
    ``kept`` is true where they are equal. A null or wordless text has an empty set and is linked with nothing. Rows
    that repeat a doc_id each keep their line, and all of them with ``component_id = doc_id`` are kept. A null doc_id never
    lends its name unless its group has no other, and such a row is kept only if its group has no id at all. ``group_key`` tells
    groups apart without ids, ``row_key`` joins back to rows. An empty table gives an empty one.
    """
    rows = cut_lineage(sketches(df.select("doc_id", "text", row_key().alias("row_key")), words, ["doc_id", "row_key"]))
    nodes = cut_lineage(rows.filter("digest is not null").dropDuplicates(["digest"]).select(
        F.monotonically_increasing_id().alias("id"), "digest", "row_key", "n_shingles", "sketch"))
    overlapping, hot = overlapping_pairs(nodes)
    pairs, hot = cut_lineage(estimated(overlapping, nodes)), cut_lineage(hot)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).unionByName(hot).distinct()
    sets = cut_lineage(full_sets(df, nodes.join(ids, "id").select("row_key", "id"), words))
    links = confirmed(pairs, sets)
    if not hot.isEmpty():
        links = links.unionByName(hot_links(nodes, hot, sets))
    grouped = nodes.select("id", "digest").join(components(links), "id").select("digest", "root")
    named = rows.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("least"))
    named = named.join(grouped, "digest", "left")
    heads = named.filter("root is not null").groupBy("root").agg(F.min("least").alias("head"))
    named = cut_lineage(named.join(heads, "root", "left").select("digest", "root", F.coalesce("head", "least").alias("component_id")))
    out = rows.select("doc_id", "n_shingles", "digest", "row_key").join(named, "digest", "left")
    component = F.when(F.col("digest").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    group = F.when(F.col("digest").isNull(), F.concat(F.lit("row "), F.col("row_key"))).when(F.col("root").isNotNull(), F.concat(F.lit("group "), F.col("root"))) \
        .otherwise(F.concat(F.lit("set "), F.hex("digest")))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"), group.alias("group_key"), "row_key")


def one_per_group(df: DataFrame, words: int = 5) -> DataFrame:
    """The rows of ``df`` with the least ``doc_id`` of each group (null ids last), all columns; equal rows count as one."""
    told = near_duplicates(df, words)
    best = told.groupBy("group_key").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key")).alias("best")).select("best.row_key")
    keyed = df.withColumn("_row_key", row_key())
    return keyed.join(best.toDF("_row_key"), "_row_key", "left_semi").dropDuplicates(["_row_key"]).select(df.columns)

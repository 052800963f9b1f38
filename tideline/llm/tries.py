"""The trie of conversation prefixes, summed up along an Euler tour.

Conversations share their first turns: a node stands for a distinct sequence of first turns, its members are
the conversations that begin so. Each node has an arc in and an arc out; an arc's successor on the tour follows from first children,
next siblings and parents. The tour is ranked as a linked list: parts of it that lie within one bounded chunk of arcs shrink to
one element each, again and again, until one chunk holds the rest; then positions go back down. Prefix sums by position give
every subtree's leaves and savings as the difference between its two arcs.

No conversation, parent or list of members is held by one task: turns, siblings and members are scanned in measured cuts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.scan import CHUNK_ROWS, cut, row_position, running
from tideline.session import cut_lineage

WORD = r"[^\x20\x09-\x0D]+"
GROUP, MOST_SHARED = 20, 3  # conversations of a group, turns that one may take over from the group's first
SUMS = ("s0", "s1", "s2", "s3")
NONE = -1


def halves(*parts: Column) -> list[Column]:
    """Four 32-bit numbers that stand for the values; sums of two billion of them fit a long."""
    low = F.lit(0xFFFFFFFF)
    a, b = F.xxhash64(*parts), F.xxhash64(F.lit(1), *parts)
    return [a.bitwiseAND(low), F.shiftrightunsigned(a, 32), b.bitwiseAND(low), F.shiftrightunsigned(b, 32)]


def key_of(depth: Column, sums: list[Column]) -> Column:
    """What tells one sequence of turns from others: its length and the sums over its turns' hashes, each taken with its place."""
    return F.md5(F.concat_ws(",", depth, *sums))


def turns_of(df: DataFrame, rows: int) -> DataFrame:
    """``conv``, ``pos`` (from 0), ``t1``, ``t2`` (hash of role and text) and ``words`` of every turn, in order of turn (null first), role, text."""
    text, role = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("text", "role"))
    flat = df.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), text.alias("text"))
    flat = row_position(flat, ["conv"], ["turn", "role", "text"], "pos", rows)
    return flat.select("conv", "pos", F.xxhash64("role", "text").alias("t1"), F.xxhash64(F.lit(1), "text", "role").alias("t2"),
                       F.regexp_count("text", F.lit(WORD)).cast("long").alias("words"))


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations that take their first turns from the first of their group.

    Returns the turns (``conv``, ``depth`` from 1, ``t1``, ``t2``, ``words``, ``length`` of the conversation) and the conversations (``conv``, ``length``),
    those without a turn included.
    """
    shared = F.crc32(F.col("conv").cast("string")) % 4
    first = turns.filter((F.col("conv") % GROUP == 0) & (F.col("pos") < MOST_SHARED)).groupBy(F.col("conv").alias("leader")) \
        .agg(F.sort_array(F.collect_list(F.struct("pos", "t1", "t2", "words"))).alias("lead"))  # three turns at most
    convs = turns.groupBy("conv").agg(F.count(F.lit(1)).alias("own")).withColumn("h", shared).withColumn("leader", F.col("conv") - F.col("conv") % GROUP)
    convs = convs.join(first, "leader", "left").withColumn("lead", F.slice(F.coalesce("lead", F.array().cast("array<struct<pos:bigint,t1:bigint,t2:bigint,words:bigint>>")), 1, F.col("h").cast("int")))
    convs = cut_lineage(convs.withColumn("took", F.size("lead")).select(
        "conv", "h", "lead", "took", (F.greatest(F.col("own") - F.col("h"), F.lit(0)) + F.col("took")).alias("length")))
    own = turns.join(convs.select("conv", "h", "took", "length"), "conv").filter("pos >= h") \
        .select("conv", (F.col("pos") - F.col("h") + F.col("took") + 1).alias("depth"), "t1", "t2", "words", "length")
    taken = convs.select("conv", "length", F.explode("lead").alias("x")).select("conv", (F.col("x.pos") + 1).alias("depth"), "x.t1", "x.t2", "x.words", "length")
    return own.unionByName(taken), convs.select("conv", "length")


def prefixes(turns: DataFrame, rows: int) -> DataFrame:
    """Adds ``key`` of the turns up to each one and ``parent_key`` of those before it."""
    for name, value in zip(SUMS, halves(F.col("depth"), F.col("t1"), F.col("t2"))):
        turns = turns.withColumn(f"v_{name}", value)
    at = running(turns, ["conv"], ["depth"], sums={s: F.col(f"v_{s}") for s in SUMS}, rows=rows)
    before, upto = [F.col(s) for s in SUMS], [F.col(s) + F.col(f"v_{s}") for s in SUMS]
    return at.select("conv", "depth", "words", "length", key_of(F.col("depth"), upto).alias("key"), key_of(F.col("depth") - 1, before).alias("parent_key"))


def end_hashes(ends: DataFrame, rows: int) -> DataFrame:
    """``key`` and ``ends_sha256``: the SHA-256 of the numbers ``conv`` of a key, ascending, with commas.

    Cuts of the ordered numbers are joined to strings where they lie. SHA-256 reads its input in order, so one task feeds a
    key's strings to it one after the other, holding one at a time.
    """
    pieces = cut(ends, ["key"], ["conv"], rows).groupBy("key", "_chunk").agg(F.concat_ws(",", F.transform(F.sort_array(F.collect_list("conv")), lambda c: c.cast("string"))).alias("ids"))

    def run(batches) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            keys, out = [], []
            for key, ids in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key == now:
                    digest.update(b",")
                else:
                    if now is not None:
                        keys.append(now)
                        out.append(digest.hexdigest())
                    now, digest = key, hashlib.sha256()
                digest.update(ids.as_py().encode())
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now]), pa.array([digest.hexdigest()])], names=["key", "ends_sha256"])

    return pieces.repartition("key").sortWithinPartitions("key", "_chunk").select("key", "ids").mapInArrow(run, "key string, ends_sha256 string")


def contracted(batch: pa.Table) -> pa.Table:
    """One chunk of a list (``id``, ``next``, ``len``): every element gets the ``head`` of its run within the chunk and its ``offset`` from it;
    heads also get what follows the run and the run's length. Runs are found by pointer doubling."""
    ids, nxt, length = (batch.column(c).to_numpy() for c in ("id", "next", "len"))
    order = np.argsort(ids)
    ids, nxt, length = ids[order], nxt[order], length[order]
    n = len(ids)
    at = np.minimum(np.searchsorted(ids, nxt), n - 1)
    inside = ids[at] == nxt
    to = np.where(inside, at, np.arange(n))  # the last of a run points at itself
    ahead = np.where(inside, length, 0)  # from the element to where the pointer leads
    while True:
        far = to[to]
        if (far == to).all():
            break
        ahead, to = ahead + ahead[to], far
    head = np.ones(n, bool)
    head[at[inside]] = False
    first = np.empty(n, np.int64)
    first[to[head]] = np.flatnonzero(head)  # by the run's last element
    h = first[to]
    null = ~head
    return pa.table({"id": pa.array(ids), "head": pa.array(ids[h]), "offset": pa.array(ahead[h] - ahead),
                     "next": pa.array(nxt[to], mask=null), "len": pa.array(ahead + length[to], mask=null)})


def merged_pairs(items: DataFrame, turn: int) -> DataFrame:
    """A round that shrinks any list: of neighbours, the later one that drew tails joins an earlier one that drew heads, about a quarter
    of all. The same columns as ``contracted``."""
    drew = F.xxhash64("id", F.lit(turn)) % 2 == 0
    a = items.filter(drew).alias("a")
    b = items.filter(~drew).select(F.col("id").alias("b_id"), F.col("next").alias("b_next"), F.col("len").alias("b_len"))
    pairs = cut_lineage(a.join(b, F.col("a.next") == F.col("b_id")).select("id", "b_id", "b_next", "b_len", "len"))
    gone = pairs.select(F.col("b_id").alias("id"), F.col("id").alias("head"), F.col("len").alias("offset"), F.lit(None).cast("long").alias("next"), F.lit(None).cast("long").alias("len"))
    left = items.join(gone.select("id"), "id", "left_anti").join(pairs.select("id", "b_next", "b_len"), "id", "left").select(
        "id", F.col("id").alias("head"), F.lit(0).cast("long").alias("offset"), F.coalesce("b_next", "next").alias("next"),
        (F.col("len") + F.coalesce("b_len", F.lit(0))).alias("len"))
    return left.unionByName(gone)


def ranks(arcs: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """``id`` and ``pos`` (from 0) of every element of a linked list ``arcs`` (``id``, ``next``; -1 after the last).

    A round cuts the list by id into chunks of at most ``rows`` elements and shrinks each chunk's runs to one element. If ids
    do not follow the list and a round leaves over three quarters, a round of random pairs comes before the next. At last one chunk
    holds all. So rounds grow with the logarithm of the list at worst, and no task gets more than ``rows`` elements.
    """
    schema = "id long, head long, offset long, next long, len long"
    items, levels, turn = cut_lineage(arcs.select("id", "next", F.lit(1).cast("long").alias("len"))), [], 0
    count, slow = items.count(), False
    while True:
        if slow:
            level = cut_lineage(merged_pairs(items, turn))
        else:
            chunks = cut(items, [], ["id"], rows) if count > rows else items.withColumn("_chunk", F.lit(0).cast("long"))
            level = cut_lineage(chunks.groupBy("_chunk").applyInArrow(contracted, schema))
        levels.append(level)
        if not slow and count <= rows:
            break
        items = cut_lineage(level.filter("id = head").select("id", "next", "len"))
        left = items.count()
        slow, count, turn = not slow and left > 0.75 * count, left, turn + 1
    at = levels.pop().select("id", F.col("offset").alias("pos"))
    while levels:
        at = cut_lineage(levels.pop().select("id", "head", "offset").join(at.select(F.col("id").alias("head"), "pos"), "head")
                         .select("id", (F.col("pos") + F.col("offset")).alias("pos")))
    return at


def tour(nodes: DataFrame, rows: int) -> DataFrame:
    """The arcs of the Euler tour of ``nodes`` (``id``, ``parent``, ``first``: least child or null): ``id`` (2 id for the way in, 2 id + 1 for the way out) and ``next``.

    A node's next sibling is the last value before it in descending order of the parent's children, a scan like others.
    """
    near = running(nodes.select("id", "parent", "first", (-F.col("id")).alias("_back")), ["parent"], ["_back"], lasts={"sibling": F.col("id")}, rows=rows)
    way_in = F.coalesce(2 * F.col("first"), 2 * F.col("id") + 1)
    way_out = F.when(F.col("parent").isNull(), NONE).otherwise(F.coalesce(2 * F.col("sibling"), 2 * F.col("parent") + 1))
    both = F.array(F.struct((2 * F.col("id")).alias("id"), way_in.alias("next")), F.struct((2 * F.col("id") + 1).alias("id"), way_out.alias("next")))
    return near.select(F.explode(both).alias("x")).select("x.*")


def prefix_trie(df: DataFrame, rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per node of the trie of rebuilt conversations: ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``,
    ``n_leaves``, ``saved_tokens``, ``ends_sha256``.

    ``df`` has ``conv_id``, ``turn``, ``role``, ``text``; other columns are ignored. Conversation c begins with the first h turns of conversation
    c - c % 20 (fewer if it has fewer, none if it is absent) and goes on with its own turns after its first h, with h = crc32(c) % 4.
    A null role or text is empty; a null turn comes first; equal turns go by role and text; repeated rows are turns of their own.
    Rows without a conv_id belong to no conversation. Texts are hashed and counted whole, so a long one is no more than others.
    Conversations of any length are cut into chunks of ``rows`` turns. An empty table gives an empty one, without a root.
    Sequences of turns are told by 128 bits and their length.
    """
    turns, convs = rebuilt(cut_lineage(turns_of(df, rows)))
    at = cut_lineage(prefixes(turns, rows))
    root = key_of(F.lit(0), [F.lit(0)] * len(SUMS))
    nodes = at.groupBy("key").agg(F.min("conv").alias("conv_id"), F.first("depth").alias("depth"), F.first("parent_key").alias("parent_key"),
                                  F.count(F.lit(1)).alias("n_convs"), F.first("words").alias("words"))
    top = convs.agg(F.min("conv").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).filter("n_convs > 0").select(
        root.alias("key"), "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("string").alias("parent_key"), "n_convs", F.lit(0).cast("long").alias("words"))
    # In order of member and depth, a conversation's own nodes have numbers in a row, as they have on the tour.
    nodes = cut_lineage(row_position(nodes.unionByName(top), [], ["conv_id", "depth"], "id", rows).drop("_chunk"))
    parents = nodes.select(F.col("key").alias("parent_key"), F.col("id").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    nodes = cut_lineage(nodes.join(parents, "parent_key", "left"))
    children = nodes.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("id")).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n_children"))
    nodes = cut_lineage(nodes.join(children, "id", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long"))))
    arcs = cut_lineage(tour(nodes, rows))
    places = ranks(arcs, rows)
    worth = nodes.select((2 * F.col("id")).alias("id"), (F.col("n_children") == 0).cast("long").alias("leaf"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    weighed = places.join(worth, "id", "left").fillna(0, ["leaf", "saved"])
    passed = running(weighed, [], ["pos"], sums={"leaves": F.col("leaf"), "worth": F.col("saved")}, rows=rows)
    sign = F.when(F.col("id") % 2 == 1, 1).otherwise(-1)
    subtrees = passed.groupBy(F.shiftright("id", 1).alias("id")).agg(F.sum(sign * F.col("leaves")).alias("n_leaves"), F.sum(sign * F.col("worth")).alias("saved_tokens"))
    ends = at.filter("depth = length").select("key", "conv").unionByName(convs.filter("length = 0").select(root.alias("key"), "conv"))
    empty = hashlib.sha256(b"").hexdigest()
    return nodes.join(subtrees, "id").join(end_hashes(ends, rows), "key", "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


def oracle_sql() -> str:
    """DuckDB SQL for ``prefix_trie``: prefixes as lists of turns, subtrees through each node's ancestors. The checksum of a number's digits is
    folded over its bytes, each followed by eight shifts."""
    return r"""
    WITH turns AS (
        SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
        FROM conversations WHERE conv_id IS NOT NULL),
    convs AS (
        SELECT c, c - c % 20 AS leader, xor(list_reduce(
            list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(c::VARCHAR, ''), lambda d: list_prepend(ord(d)::BIGINT, [-1::BIGINT for x in range(8)])))),
            lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) WHEN s & 1 = 1 THEN xor(s >> 1, 3988292384) ELSE s >> 1 END), 4294967295) % 4 AS h
        FROM (SELECT DISTINCT c FROM turns)),
    line AS (
        SELECT v.c, 0 AS part, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.leader AND t.pos < v.h
        UNION ALL SELECT v.c, 1, t.pos, t.role, t.text FROM convs v JOIN turns t ON t.c = v.c AND t.pos >= v.h),
    made AS (
        SELECT c, row_number() OVER w AS depth, list({'r': role, 't': text}) OVER w AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
               count(*) OVER (PARTITION BY c) AS length
        FROM line WINDOW w AS (PARTITION BY c ORDER BY part, pos ROWS UNBOUNDED PRECEDING)),
    member AS (
        SELECT c, depth, path, words, length FROM made
        UNION ALL SELECT c, 0, [], 0, (SELECT count(*) FROM line l WHERE l.c = convs.c) FROM convs),
    node AS (
        SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
               coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE depth = length), '') AS ends
        FROM member GROUP BY path, depth),
    up AS (  -- every node with each node above it and itself
        SELECT n.conv_id, n.depth, a.conv_id AS above, a.depth AS above_depth
        FROM node n JOIN member m ON m.c = n.conv_id AND m.depth <= n.depth JOIN node a ON a.path = m.path AND a.depth = m.depth),
    kids AS (SELECT above, above_depth, count(*) AS n_children FROM up WHERE depth = above_depth + 1 GROUP BY ALL),
    told AS (SELECT n.*, coalesce(k.n_children, 0) AS n_children FROM node n LEFT JOIN kids k ON k.above = n.conv_id AND k.above_depth = n.depth)
    SELECT t.conv_id, t.depth, p.above AS parent_conv_id, t.n_convs, t.n_children, s.n_leaves, s.saved_tokens, sha256(t.ends) AS ends_sha256
    FROM told t
    JOIN (SELECT above, above_depth, count(*) FILTER (WHERE d.n_children = 0) AS n_leaves, sum((d.n_convs - 1) * d.words)::BIGINT AS saved_tokens
          FROM up JOIN told d USING (conv_id, depth) GROUP BY ALL) s ON s.above = t.conv_id AND s.above_depth = t.depth
    LEFT JOIN up p ON p.conv_id = t.conv_id AND p.depth = t.depth AND p.above_depth = t.depth - 1"""

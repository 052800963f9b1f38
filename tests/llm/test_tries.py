"""The trie of conversation prefixes: by definition, list ranking on its own, hot and odd rows. The SQL twin is compared in test_rules.py."""

import collections
import hashlib
import random
import re
import zlib

import pytest

from tideline.llm import tries

SCHEMA = "conv_id long, turn long, role string, text string"


def plain(rows):
    """Nodes by definition, on lists."""
    turns = collections.defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            turns[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(ts, key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))] for c, ts in turns.items()}
    made = {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        leader = c - (c % 20 if c >= 0 else -(-c % 20))
        made[c] = tuple(own.get(leader, [])[:h] + own[c][h:])
    members = collections.defaultdict(list)
    for c, line in made.items():
        for d in range(len(line) + 1):
            members[line[:d]].append(c)
    kids, leaves, saved = collections.Counter(), collections.Counter(), collections.Counter()
    for p in members:
        if p:
            kids[p[:-1]] += 1
    for p, ms in members.items():
        worth = (len(ms) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        for d in range(len(p) + 1):
            leaves[p[:d]] += not kids[p]
            saved[p[:d]] += worth
    ends = lambda p: hashlib.sha256(",".join(str(c) for c in sorted(members[p]) if len(made[c]) == len(p)).encode()).hexdigest()
    return sorted((min(ms), len(p), min(members[p[:-1]]) if p else -1, len(ms), kids[p], leaves[p], saved[p], ends(p)) for p, ms in members.items())


def rows_of(df):
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in df.collect())


def made(kind):
    rng = random.Random(3)
    words = ["hi there", "", "a b  c\td", "go on", None, "x " * 300]
    if kind == "few":  # every kind of null, tie, negative number and repeated row
        rows = [(rng.choice([-45, -20, -3, 0, 1, 5, 19, 20, 27, 41, None]), rng.choice([None, 0, 1, 2, 2, -1]), rng.choice(["user", "bot", None]), rng.choice(words)) for _ in range(120)]
        return rows + rows[:10]
    if kind == "copies":  # one third of all conversations alike
        return [(c, t, "user", f"t{t}" if c % 3 == 0 else f"t{t} {c % 7}") for c in range(90) for t in range(3)]
    return [(40 if i % 2 else i % 25, i, "user", f"turn {i % 11}") for i in range(240)]  # one conversation with half of all turns


@pytest.mark.parametrize("kind,rows", [("few", 1 << 16), ("few", 16), ("copies", 16), ("long", 24)])
def test_by_definition(spark, kind, rows):
    data = made(kind)
    assert rows_of(tries.prefix_trie(spark.createDataFrame(data, SCHEMA).repartition(3), rows)) == plain(data)


@pytest.mark.parametrize("shuffled", [False, True])
def test_ranks_of_a_list(spark, shuffled):
    """Ids that follow the list and ids that do not; the list is far longer than a chunk."""
    ids = list(range(500))
    if shuffled:
        random.Random(1).shuffle(ids)
    df = spark.createDataFrame(list(zip(ids, ids[1:] + [-1])), "id long, next long")
    assert [r.id for r in tries.ranks(df, rows=40).orderBy("pos").collect()] == ids
    assert sorted(r.pos for r in tries.ranks(df, rows=1 << 16).collect()) == list(range(500))


def test_hash_of_many_members(spark):
    ends = spark.createDataFrame([("k", c) for c in range(-300, 700)] + [("one", 5)], "key string, conv long").repartition(5)
    got = {r.key: r.ends_sha256 for r in tries.end_hashes(ends, 64).collect()}
    assert got == {"k": hashlib.sha256(",".join(map(str, range(-300, 700))).encode()).hexdigest(), "one": hashlib.sha256(b"5").hexdigest()}


def test_odd_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert tries.prefix_trie(empty).count() == 0
    assert tries.prefix_trie(spark.createDataFrame([(None, 1, "user", "x")], SCHEMA)).count() == 0
    turnless = next(c for c in range(21, 40) if zlib.crc32(str(c).encode()) % 4)  # takes turns from an absent conversation and drops its own
    data = [(turnless, 0, "user", "gone")]
    assert rows_of(tries.prefix_trie(spark.createDataFrame(data, SCHEMA))) == plain(data) == [(turnless, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]
    clash = spark.createDataFrame([(*r, 1, "x", 2, 3) for r in made("few")], SCHEMA + ", depth int, key string, n_convs int, _chunk int")
    assert rows_of(tries.prefix_trie(clash)) == plain(made("few"))

"""Near-duplicate leaders against the one-by-one rule."""

import difflib
import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tideline.operators import neardup as nd
from tideline.plans import neardup as plan


@pytest.mark.parametrize("hot", [2, 8])
def test_fingerprints_with_orientations_and_a_hot_group(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT_BLOCK", hot)
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(30)]
    items = []
    for i in range(260):
        code = base[0] if rng.random() < 0.34 else rng.choice(base)
        for _ in range(rng.randrange(4)):
            code ^= 1 << rng.randrange(64)
        other = rng.choice(base) ^ (1 << rng.randrange(64))
        views = [code, other] if rng.random() < 0.5 else [code]
        items.append((i, rng.choice("ab"), views))
    want, leaders = {}, {"a": [], "b": []}
    for i, label, views in items:
        hit = next((j for j, c in leaders[label] if min((c ^ v).bit_count() for v in views) <= 5), None)
        if hit is None:
            leaders[label].append((i, views[0]))
        want[i] = i if hit is None else hit
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(i, lab, [[signed(v)] for v in vs]) for i, lab, vs in items], "id long, label string, views array<array<long>>")
    got = {r.id: r.leader for r in nd.fingerprint_groups(df, max_distance=5, n_words=1, word_bits=64, agree=1).collect()}
    assert got == want


def test_bands_always_share_a_key(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        a = rng.getrandbits(60)
        b = a
        for bit in rng.sample(range(60), 6):
            b ^= 1 << bit
        rows.append((i, [a], [b]))
    df = spark.createDataFrame(rows, "i int, a array<long>, b array<long>")
    for agree in (1, 2, 3):
        keys = df.select(nd.band_keys(df.a, 1, 60, 6, agree).alias("ka"), nd.band_keys(df.b, 1, 60, 6, agree).alias("kb")).collect()
        assert all(set(r.ka) & set(r.kb) for r in keys)


def turned(code, side):
    """All orientations by turning and mirroring the grid itself."""
    grid, out = [code[i:i + side] for i in range(0, side * side, side)], []
    for _ in range(4):
        grid = ["".join(row) for row in zip(*grid[::-1], strict=True)]
        out += ["".join(grid), "".join(row[::-1] for row in grid)]
    return out


@pytest.mark.parametrize("side", [3, 4, 16])
def test_orientations_are_the_turns_of_the_grid(side):
    code = [chr(200 + i) for i in range(side * side)]
    made = ["".join(code[c] for c in cells) for cells in nd.orientations(side)]
    assert made[0] == "".join(code) and sorted(made) == sorted(turned("".join(code), side))
    assert sorted(c for o in nd.orbits(side) for c in o) == list(range(side * side))
    assert sorted(c for b in nd.orbit_bands(side, 3) for c in b) == list(range(side * side))


def test_orbit_keys_are_shared_by_all_near_codes_in_any_orientation(spark):
    rng = random.Random(8)
    rows = []
    for i in range(60):
        a = "".join(rng.choice("01") for _ in range(256))
        b = list(a)
        for c in rng.sample(range(256), 20):
            b[c] = "10"[int(b[c])]
        rows.append((i, a, rng.choice(turned("".join(b), 16)), rng.choice(turned(a, 16))))
    df = spark.createDataFrame(rows, "i int, a string, b string, c string")
    for agree in (1, 2):
        for r in df.select(*[nd.orbit_keys(df[x], 16, 20, agree).alias(x) for x in "abc"]).collect():
            assert r.a == r.c and set(r.a) & set(r.b)


@pytest.mark.parametrize("hot", [2, 256])
def test_turned_copies_join_the_earliest_leader(spark, monkeypatch, hot):
    monkeypatch.setattr(nd, "HOT_BLOCK", hot)
    rng = random.Random(9)
    base = ["".join(rng.choice("01") for _ in range(64)) for _ in range(20)]
    rows = []
    for i in range(220):
        code = list(base[0] if rng.random() < 0.34 else rng.choice(base))
        for c in rng.sample(range(64), rng.randrange(5)):
            code[c] = "10"[int(code[c])]
        rows.append((i, rng.choice(["a", "b", None]), rng.choice(turned("".join(code), 8))))
    rows += [(500, "a", None), (501, "a", "01"), (502, None, ""), (503, "a", None)]
    want, leaders = {500: 500, 501: 501, 502: 502, 503: 503}, {"a": [], "b": [], None: []}
    for i, label, code in rows[:220]:
        views = turned(code, 8)
        hit = next((j for j, c in leaders[label] if min(sum(x != y for x, y in zip(c, v, strict=True)) for v in views) <= 4), None)
        if hit is None:
            leaders[label].append((i, code))
        want[i] = i if hit is None else hit
    assert len(set(want.values())) < 150
    df = spark.createDataFrame(rows, "id long, label string, code string")
    assert {r.id: r.leader for r in nd.turned_groups(df, 4, 8, agree=1).collect()} == want
    assert nd.turned_groups(df.limit(0), 4, 8).count() == 0


def words64(code):
    return [int(code[i:i + 64], 2) - (1 << 64 if code[i:i + 64][0] == "1" and len(code[i:i + 64]) == 64 else 0) for i in range(0, len(code), 64)]


@pytest.mark.parametrize("side,far", [(8, 4), (16, 20), (16, 300), (9, 7)])
def test_tiles_find_every_near_pair(side, far):
    """Also the emptiest and the fullest codes, whose numbers of ones leave a byte."""
    rng, bits = random.Random(side + far), side * side
    codes = ["0" * bits, "1" * bits, "0" * (bits - 1) + "1"]
    for density in (0.03, 0.3, 0.9):
        base = ["".join("1" if rng.random() < density else "0" for _ in range(bits)) for _ in range(20)]
        for b in base:
            code = list(rng.choice(turned(b, side)))
            for c in rng.sample(range(bits), rng.randrange(min(bits, 2 * far // 3 + 4))):
                code[c] = "10"[int(code[c])]
            codes += [b, "".join(code)]
    a, b = (np.array([words64(c) for c in x], np.int64).view(np.uint64) for x in (codes, codes[5:]))
    got = {(i, j) for x, y in nd.near_in_tile(a, b, side, far) for i, j in zip(x.tolist(), y.tolist(), strict=True)}
    assert got == {(i, j) for i, c in enumerate(codes) for j, d in enumerate(codes[5:]) if min(sum(x != y for x, y in zip(c, v, strict=True)) for v in turned(d, side)) <= far}


@pytest.mark.parametrize("first,most,tile", [(1000, 10, 1000), (20, 10**9, 30), (25, 40, 1000), (30, 0, 40)])
def test_stretches_of_the_order_agree_with_the_rule(spark, monkeypatch, first, most, tile):
    """Stretches, halved ones and tiles of any size give the same leaders; half of the codes are near each other, most of them late in the order."""
    monkeypatch.setattr(nd.near_by_tiles, "__defaults__", (tile,))
    rng, rows, leaders, want = random.Random(5), [], [], {}
    for i in range(120):
        few = rng.random() < (0.9 if i > 70 else 0.1)
        rows.append((i * 3 + 1, rng.choice(["a", None]), "".join("1" if rng.random() < (0.05 if few else 0.5) else "0" for _ in range(64))))
    for node, label, code in rows:
        hit = next((n for n, l, c in leaders if l == label and min(sum(x != y for x, y in zip(c, v, strict=True)) for v in turned(code, 8)) <= 5), None)
        want[node] = node if hit is None else hit
        if hit is None:
            leaders.append((node, label, code))
    nodes = spark.createDataFrame([(n, l, words64(c)) for n, l, c in rows], "node long, label string, _words array<long>")
    got = nd.leaders_by_tiles(nodes, 8, 5, first, most).collect()
    assert len(got) == len(rows) and {r.node: r.leader for r in got} == want


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diag, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diag, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diag + (x != y))
    return row[-1]


@pytest.mark.parametrize("ratio", [0.75, 0.84, 0.9, 0.95])
def test_batches_agree_with_the_rule(spark, ratio):
    rng = random.Random(4)
    seeds = ["".join(rng.choice("abcdefg ") for _ in range(rng.randrange(2, 70))).strip() or "x" for _ in range(25)]
    rows = []
    for i in range(180):
        t = list(seeds[0] if rng.random() < 0.34 else rng.choice(seeds))
        for _ in range(rng.randrange(4)):
            t[rng.randrange(len(t))] = rng.choice("abcdefg")
        rows.append((i, rng.randrange(2), "".join(t)))
    rows += [(1000, 7, "r" + "qwerty uiop asdf ghjkl zxcvb nmqwert"), (1001, 7, "r" + "qwerty uiop asdf ghjkl zxcvb nmqwert" + "yuiopz")]
    want, kept = {}, {0: [], 1: [], 7: []}
    for i, batch, t in rows:
        norm = " ".join(t.split())
        dup = any(k == norm or 1 - distance(k, norm) / max(len(k), len(norm)) > ratio for k in kept[batch])
        want[i] = "duplicate" if dup else "kept"
        if not dup:
            kept[batch].append(norm)
    df = spark.createDataFrame(rows, "id long, batch int, text string")
    assert {r.id: r.outcome for r in nd.dedup_in_batches(df, r"(?!)", ratio).collect()} == want


@pytest.mark.parametrize("ratio", [0.86, 0.9])
def test_matching_blocks_agree_with_the_rule_on_all_pairs(spark, ratio):
    rng = random.Random(11)
    seeds = ["".join(rng.choice("abcdefg ") for _ in range(n)).strip() or "x" for n in [*range(1, 24), 60, 150, 230, 300]]
    rows = []
    for i in range(220):
        t = seeds[-2] if rng.random() < 0.2 else rng.choice(seeds)
        for _ in range(rng.randrange(5)):
            at, kind = rng.randrange(len(t)), rng.randrange(4)
            t = (t[:at] + rng.choice("abcdefg") + t[at + (kind != 1):] if kind < 2 else t[:at] + t[at + 1:] if kind == 2 else t[at:] + t[:at]) or "x"
        rows.append((i, rng.randrange(2), t))
    rows += [(300, 5, None), (301, 5, ""), (302, 5, "one of its own")]
    want, kept, by_edits = {300: "empty_or_long", 301: "empty_or_long", 302: "kept"}, {0: [], 1: []}, 0
    for i, batch, t in rows[:220]:
        norm = " ".join(t.split())
        dup = any(k == norm or difflib.SequenceMatcher(None, norm, k).ratio() > ratio for k in kept[batch])
        by_edits += dup != any(k == norm or 1 - distance(k, norm) / max(len(k), len(norm)) > ratio for k in kept[batch])
        want[i] = "empty_or_long" if not norm else "duplicate" if dup else "kept"
        if norm and not dup:
            kept[batch].append(norm)
    assert by_edits  # the measures differ on these texts
    df = spark.createDataFrame(rows, "id long, batch int, text string")
    assert {r.id: r.outcome for r in nd.dedup_in_batches(df, r"(?!)", ratio, measure="blocks").collect()} == want


def code_by_rule(texts):
    cells = Counter(int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % 256 for t in texts for w in re.sub(r"\W+", " ", t.lower()).strip().split(" "))
    return "".join("1" if cells[c] > cells[c + 1] * (c < 255) else "0" for c in range(256))


@pytest.mark.parametrize("batch_bytes", [20, 1 << 20])
def test_fingerprints_agree_with_the_rule(spark, monkeypatch, batch_bytes):
    """Rows of one id are one document, wherever they lie; words do not leave their row before they are counted."""
    monkeypatch.setattr(plan, "BATCH_BYTES", batch_bytes)
    rng = random.Random(3)
    texts = [(rng.choice([None, *range(25)]), " ".join(rng.choice("abcdefghij") + rng.choice(["", "é", "7", "!?"]) for _ in range(rng.randrange(30)))) for _ in range(60)]
    texts += [(100, ""), (101, "?!"), (102, None), (103, "w " * 700 + "v"), (103, "u"), (104, "w " * 200), (104, "w " * 200)]
    rows, by_id = [(i, "en", t) for i, t in texts], defaultdict(list)
    for i, t in texts:
        if t is not None:
            by_id[i].append(t)
    got = plan.fingerprints(spark.createDataFrame(rows, "doc_id long, lang string, text string").repartition(4))
    found = got.collect()
    assert len(found) == len(by_id) and {r.id: r.code for r in found} == {i: code_by_rule(ts) for i, ts in by_id.items()}
    assert {r.label for r in found} == {"en"}
    assert "Generate" not in got._jdf.queryExecution().toString()


@pytest.mark.parametrize("block", [1, 7, 1000])
def test_one_task_leads_the_first_stretch(monkeypatch, block):
    monkeypatch.setattr(nd, "BLOCK", block)
    rng, leaders, want = random.Random(6), [], []
    codes = ["".join("1" if rng.random() < rng.choice([0.05, 0.5]) else "0" for _ in range(64)) for _ in range(60)]
    for i, code in enumerate(codes):
        hit = next((j for j in leaders if min(sum(x != y for x, y in zip(codes[j], v, strict=True)) for v in turned(code, 8)) <= 12), i)
        want.append(hit)
        leaders += [i] * (hit == i)
    assert 1 < len(leaders) < 60
    assert nd.led_in_order(np.array([words64(c) for c in codes], np.int64).view(np.uint64), 8, 12).tolist() == want
    assert nd.led_in_order(np.empty((0, 1), np.uint64), 8, 12).tolist() == []


@pytest.mark.parametrize("few", [0, 10, 10**6])
def test_leaders_by_rounds_and_in_one_task(spark, monkeypatch, few):
    monkeypatch.setattr(nd, "FEW", few)
    rng = random.Random(8)
    pairs = sorted({tuple(sorted(rng.sample(range(40), 2))) for _ in range(50)})
    leaders = set()
    for n in range(40):
        if not any(a in leaders for a, b in pairs if b == n):
            leaders.add(n)
    got = nd.greedy_leaders(spark.range(40).withColumnRenamed("id", "node"), spark.createDataFrame(pairs, "a long, b long")).collect()
    assert sorted(r.node for r in got) == sorted(leaders)

"""Near duplicates, toxicity, fingerprints and language scores against brute force; the pipeline stage by stage."""

import collections
import hashlib
import itertools
import math
import os
import random
import struct
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
import xxhash

import corpus_pipeline
from tideline.llm import fingerprints, lm, neardup, queries, toxicity

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, folder=SF):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()]


def odd(spark):
    long = " ".join(f"word{i % 977} the of" for i in range(20_000))
    rows = [(1, "a b c d e", "en", "x", 5), (1, "a b c d e", "en", "x", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", "x", 1),
            (None, "a b c d e", None, "y", 0)]
    return spark.createDataFrame([(*r, "mine", 7, 9) for r in rows], DOC + ", kept string, row_key int, score int")


def plain_groups(docs, words):
    """Shingle counts and groups by comparing every pair that shares a shingle."""
    sets = []
    for i, t in docs:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k:k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()))
    lists, parent = collections.defaultdict(list), {i: i for i, _ in docs}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for n, (i, s) in enumerate(sets):
        common = collections.Counter(itertools.chain.from_iterable(lists[x] for x in s))
        for m, c in common.items():
            if 100 * c >= 80 * (len(s) + len(sets[m][1]) - c):
                a, b = sorted((root(i), root(sets[m][0])))
                parent[b] = a
        for x in s:
            lists[x].append(n)
    return {i: (len(s), root(i)) for i, s in sets}


def family(seed=3, members=160):
    """Near copies of one text from light to heavy edits, all distinct, and texts that share a passage only."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(120)]
    out = []
    for i in range(members):
        words = [w if rng.random() > rng.choice((0.002, 0.01, 0.03, 0.08)) else f"e{rng.random()}" for w in base]
        out.append((i, " ".join(words)))
    return out + [(1000 + i, " ".join([*base[:40], *(f"o{i}x{k}" for k in range(60))])) for i in range(60)]


@pytest.mark.parametrize("hot", [128, 5])
def test_groups_are_those_of_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(neardup, "HOT", hot)
    docs = docs_of(spark) + [(10_000 + i, t) for i, t in family()]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()
    want = plain_groups(docs, 4)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_small_set_and_its_larger_copies(spark):
    base = [f"b{i}" for i in range(35)]  # 32 shingles, all in each of 200 sets of 40
    docs = [(0, " ".join(base))] + [(1 + i, " ".join(base + [f"x{i}y{k}" for k in range(8)])) for i in range(200)]
    got = neardup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=4).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_groups(docs, 4) and {r.component_id for r in got} == {0}


def test_groups_of_odd_rows(spark):
    got = neardup.near_duplicates(odd(spark), words=4).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.kept) for r in got) == [
        ("1", 2, "1", True), ("1", 2, "1", True), ("2", 0, "2", True), ("3", 977 * 3, "3", True), ("None", 0, "None", True), ("None", 2, "1", False)]
    kept = neardup.one_per_group(odd(spark), words=4)
    assert kept.columns == odd(spark).columns and sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "None"]
    assert neardup.near_duplicates(odd(spark).limit(0)).count() == neardup.one_per_group(odd(spark).limit(0)).count() == 0


def test_kernel_by_definition():
    def plain(s, t):
        total = 0.0
        for i in itertools.combinations(range(len(s)), 3):
            for j in itertools.combinations(range(len(t)), 3):
                if all(s[a] == t[b] for a, b in zip(i, j, strict=True)):
                    total += toxicity.DECAY ** (i[2] - i[0] + 1 + j[2] - j[0] + 1)
        return total

    pairs = [("loser", "losser"), ("loser", "lxoxsxer"), ("abc", "abcabc"), ("scum", "loser")]
    left, right = toxicity.letters([a for a, _ in pairs], 8, -1), toxicity.letters([b for _, b in pairs], 8, -2)
    assert np.allclose(toxicity.kernel(left, right), [plain(*p) for p in pairs], rtol=1e-5)


def toxic_table(spark):
    rng = random.Random(2)
    syllables = "an en or ti the re st on ha er is wo ly".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randint(1, 4)))
    docs, labels = [], []
    for i in range(900):
        words = [word() for _ in range(60)]
        bad = i % 4 == 0
        if bad:
            for _ in range(3):
                words[rng.randrange(60)] = rng.choice(["grublex", "snorvik", "plumwit"])
        docs.append((i, " ".join(words) + ".", bad))
        labels.append((i, int(bad)))
    return docs, spark.createDataFrame(docs, "doc_id long, text string, bad boolean"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_texts_under_one_id_are_learnt_from_alike_in_any_order(spark):
    docs, _, labels = toxic_table(spark)
    rows = [(i, text) for i, text, _ in docs] + [(i, f"zz {text} other words") for i, text, _ in docs]
    one, two, alone = (toxicity.train(spark.createDataFrame(r, "doc_id long, text string").repartition(n), labels)
                       for r, n in ((rows, 3), (rows[::-1], 7), ([(i, min(t for j, t in rows if j == i)) for i, _, _ in docs], 2)))
    assert one.landmarks == two.landmarks == alone.landmarks != ()
    assert np.allclose(one.weights, two.weights, atol=1e-6) and np.allclose(one.weights, alone.weights, atol=1e-6)


def test_held_out_toxic_documents_are_found(spark):
    docs, df, labels = toxic_table(spark)
    model = toxicity.train(df, labels)
    got = toxicity.score(df, model).withColumn("held", toxicity.held_out(queries.F.col("doc_id"))).collect()
    held = [r for r in got if r.held]
    assert {r.doc_id for r in held} == {i for i, _, _ in docs if zlib.crc32(str(i).encode()) % 4 == 2}
    assert np.mean([r.predicted == int(r.bad) for r in held]) > 0.98
    gapped = toxicity.score(spark.createDataFrame([("you g r u b l e x",), ("a s-n-o-r-v-i-k",), ("a plummwit here",), ("the re st on",)], "text string"), model).collect()
    assert [r.predicted for r in sorted(gapped, key=lambda r: r.text)] == [1, 1, 0, 1]
    strange = toxicity.score(odd(spark), model)
    assert strange.count() == 6 and all(0 <= r.score <= 1 for r in strange.collect())
    assert toxicity.score(odd(spark).limit(0), model).count() == 0
    assert toxicity.train(df.limit(0), labels).landmarks == () == toxicity.train(df, labels.limit(0)).landmarks


def test_all_sentences_of_clean_documents_are_learnt_from(spark, monkeypatch):
    docs, _, labels = toxic_table(spark)
    long = [(2000 + i, "a snorwikk. " * 60, False) for i in range(40)]
    seen, fit = [], toxicity.fit_machine
    monkeypatch.setattr(toxicity, "fit_machine", lambda features, *rest: seen.extend(map(len, features)) or fit(features, *rest))
    df = spark.createDataFrame(docs + long, "doc_id long, text string, bad boolean")
    model = toxicity.train(df, labels.unionByName(spark.createDataFrame([(i, 0) for i, _, _ in long], "doc_id long, toxic int")))
    assert max(seen) >= 60
    unseen = spark.createDataFrame([("a snorwikk. " * 300,), ("the re snorvik st.",)], "text string")
    assert {len(r.text) > 100: r.predicted for r in toxicity.score(unseen, model).collect()} == {True: 0, False: 1}


def test_letters_dealt_over_a_long_document_are_joined():
    clean = "the re st on ha. wo ly er is. " * 20
    marks = ("snorvik", "grublex")
    assert 0.35 <= toxicity.likeness(["snoxriv"], list(marks), toxicity.own_norms(list(marks)))["snoxriv"][1].max() < 0.9
    dealt = ["s. n. o. r. v. i. k", "s - n - o - r - v - i - k", "s * n * o * r * v * i * k"]
    plain, *found = toxicity.sentence_features([f"{clean}the snoxriv er. {x} is wo. {clean}" for x in ("st", *dealt)], marks, "test dealt")
    assert len(plain) == 1 and plain.max() < 0.9
    assert all(f[:, 0].max() > 0.9 for f in found)


def test_edits_and_fingerprints(spark):
    docs = sorted(docs_of(spark), key=lambda d: -d[0])
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    assert len(got) == len(docs)
    same = {}
    for (i, text), (_, other) in zip(docs, docs[1:] + docs[:1], strict=True):
        n = len(text)
        changed = text[:n - n // 3] + other[:n // 3]
        assert (got[i].n_chars, got[i].edited_sha256) == (n, hashlib.sha256(changed.encode()).hexdigest())
        assert same.setdefault(text, got[i].fingerprint) == got[i].fingerprint
        assert got[i].near_edited == fingerprints.likeness(bytes.fromhex(got[i].fingerprint), bytes.fromhex(got[i].edited_fingerprint))
    assert np.mean([r.near_edited for r in got.values()]) > 0.3 > 0.05 > np.mean([r.near_next for r in got.values()])


def plain_fingerprint(text, lexicon):
    """I-Match with sets and plain integers: words, document counts and subsets one by one."""
    terms = sorted({xxhash.xxh64_intdigest(w) for w in (text or "").encode().lower().split()})

    def holds(term, k, density):
        x = term ^ (k * 0x9E3779B97F4A7C15 % 2**64)
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
        return (x ^ (x >> 31)) % density == 0

    out = b""
    for some, densities, kind, most in (([t for t in terms if t in lexicon], (8, 32, 128, 512), "<I", 0xFFFFFFFF), (terms, (8, 32), "<H", 0xFFFF)):
        for k in range(16 * len(densities)):
            held = [t for t in some if holds(t, k + 1, densities[k // 16])]
            out += struct.pack(kind, (xxhash.xxh32_intdigest(b"".join(struct.pack("<Q", t) for t in held)) & most or 1) if held else 0)
    return out.hex()


def test_fingerprints_against_a_plain_version(spark):
    docs = docs_of(spark)
    counts = collections.Counter(w for _, t in docs for w in set((t or "").encode().lower().split()))
    lexicon = {xxhash.xxh64_intdigest(w) for w, n in counts.items() if max(2, 0.001 * len(docs)) <= n <= max(2, 0.1 * len(docs))}
    got = {r.doc_id: r for r in queries.op8_fingerprints(spark, SF).collect()}
    docs.sort(key=lambda d: -d[0])
    for (i, text), (_, other) in list(zip(docs, docs[1:] + docs[:1], strict=True))[:40]:
        n = len(text) // 3
        assert got[i].fingerprint == plain_fingerprint(text, lexicon)
        assert got[i].edited_fingerprint == plain_fingerprint(text[:len(text) - n] + other[:n], lexicon)


def test_texts_lose_no_more_than_the_slots_of_a_term_that_goes():
    lex = np.sort(np.array([xxhash.xxh64_intdigest(f"w{i}") for i in range(500)], np.uint64))
    table = fingerprints.members(lex)
    for n in (1, 7, 8, 9, 40):  # whatever the number of terms in the band
        whole = fingerprints.slots_of(fingerprints.fingerprint_of(" ".join(f"w{i}" for i in range(n)) + " a b c d e f g", lex, table))
        less = fingerprints.slots_of(fingerprints.fingerprint_of(" ".join(f"w{i}" for i in range(n - 1)) + " a b c d e f g", lex, table))
        gone = np.array([xxhash.xxh64_intdigest(f"w{n - 1}")], np.uint64)
        touched = np.concatenate([fingerprints.members(gone)[0], fingerprints.members(gone, fingerprints.WIDE)[0]])
        assert ((whole != less) == touched).all()
    many = np.arange(40_000, dtype=np.uint64)
    assert (fingerprints.members(many) == np.concatenate([fingerprints.members(many[i:i + 1000]) for i in range(0, 40_000, 1000)])).all()


def test_lexicon_is_the_band(spark):
    rows = [(f"common w{i % 5} rare{i}",) for i in range(50)]
    lex = fingerprints.lexicon(spark.createDataFrame(rows, "text string"), 0.1, 0.5)
    assert sorted(lex.tolist()) == sorted(fingerprints.terms_of("w0 w1 w2 w3 w4").tolist())


def test_fingerprints_of_odd_rows(spark):
    lex = fingerprints.lexicon(odd(spark))
    got = fingerprints.edit_report(odd(spark), lex).collect()
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == [("1", 9), ("1", 9), ("2", 0), ("3", len(" ".join(f"word{i % 977} the of" for i in range(20_000)))), ("None", 0), ("None", 9)]
    one = fingerprints.edit_report(odd(spark).filter("doc_id = 3"), lex).collect()
    assert len(one) == 1 and one[0].near_next == 1.0
    assert fingerprints.edit_report(odd(spark).limit(0), lex).count() == 0 == fingerprints.fingerprints(odd(spark).limit(0), lex).count()


def test_language_scores(spark):
    docs = docs_of(spark)
    words = {i: (t or "").encode().lower().split() + [b" end"] for i, t in docs}
    counts = collections.Counter(w for i, ws in words.items() if zlib.crc32(str(i).encode()) % 10 for w in ws)
    total, distinct = sum(counts.values()), len(counts)
    got = queries.op9_language_scores(spark, SF).collect()
    assert len(got) == len(docs)
    for r in got:
        ws = words[r.doc_id]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in ws)
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(ws), sum(w in counts for w in ws), total, zlib.crc32(str(r.doc_id).encode()) % 10 == 0)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and r.score < 0
    assert sum(r.score for r in got if r.held_out) > sum(r.base_score for r in got if r.held_out)


def test_tokens_of_a_column():
    """Distinct words are hashed once a column; the tokens are those of each text alone."""
    texts = [" A b\t\n c\x0b\x0cD\r e ", "", "  ", "é x\x1c y\x85z Éé", None, "x", "the The THE cat", "\u00a0 \u3000\u4e2d", "aé é"]
    for column in (pa.array(texts), pa.array(["no", *texts, "no"]).slice(1, len(texts)), pa.array(texts).cast(pa.large_string()), pa.array([], pa.string())):
        tokens, code, sizes = lm.tokens_in(column)
        want = [lm.tokens_of(t or "") for t in column.to_pylist()]
        assert sizes.tolist() == [len(w) for w in want] and tokens[code].tolist() == [x for w in want for x in w.tolist()]


@pytest.mark.parametrize("scale", [1, 40, 400])
def test_normalising_without_the_greatest_logit(scale):
    """Sums of powers agree with exact ones, also where powers of the logits as they stand leave the range of numbers."""
    rng = np.random.default_rng(scale)
    make = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    m = lm.Weights(make(30, 4), make(50, 4), make(50) * scale - 2 * scale, make(1, 4), make(1), np.ones((2, 4), np.float32))
    w, h1, h2 = rng.integers(0, 50, 400), rng.integers(0, 30, 400), rng.integers(0, 30, 400)
    logits = m.predicted(h1, h2).astype(float) @ m.output.T.astype(float) + m.bias
    top = logits.max(axis=1, keepdims=True)
    want = (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))[np.arange(400), w]
    assert np.allclose(lm.log_probabilities(m, w, h1, h2, block=64), want, rtol=1e-5, atol=1e-4)


@pytest.mark.parametrize("scale", [1, 30])
def test_powers_are_taken_per_token_and_not_per_pair(scale, monkeypatch):
    """Sums after two tokens are those of whole logits, for often used tokens, rare ones and both; their powers are taken once a token."""
    rng = np.random.default_rng(3)
    make = lambda *shape: rng.normal(0, 1, shape).astype(np.float32)
    m = lm.Weights(make(60, 4) * scale, make(50, 4), make(50), make(1, 4), make(1), make(2, 4))
    h1, h2 = (x.ravel() for x in np.meshgrid(np.arange(60), np.arange(60)))
    w = rng.integers(0, 50, len(h1))
    logits = m.predicted(h1, h2).astype(float) @ m.output.T.astype(float) + m.bias
    top = logits.max(axis=1, keepdims=True)
    want = (logits - top - np.log(np.exp(logits - top).sum(axis=1, keepdims=True)))[np.arange(len(w)), w]
    taken, exp = [], np.exp
    monkeypatch.setattr(lm.np, "exp", lambda x, **more: taken.append(np.size(x)) or exp(x, **more))
    for often in (60, 40, 1, 0):
        taken.clear()
        got = lm.log_probabilities(m, w, h1, h2, norms=lm.Norms(m, np.arange(often), 16))
        assert np.allclose(got, want, rtol=1e-4, atol=1e-3)
        if often == 60 and scale == 1:
            assert sum(taken) == 2 * 60 * 50  # of 3,600 pairs


def test_a_step_is_that_of_plain_loops(spark):
    """Steps of whole arrays move the weights as loops over tokens, outputs and nodes do, and count the rows used."""
    rnd = random.Random(8)
    df = spark.createDataFrame([(" ".join(rnd.choices([f"w{i}" for i in range(300)], k=2000)),)], "text string")
    corpus = lm.corpus_of(lm.token_counts(df), 10, lm.LEAST_SHARE)
    learner = lm.Learner(lm.start_weights(corpus, 6), corpus, corpus.noise, samples=5, batch=40)
    m = lm.start_weights(corpus, 6)
    rng = np.random.default_rng(1)
    w, h1, h2 = (rng.integers(0, corpus.places, 100) for _ in range(3))
    learner.learn(w, h1, h2, np.random.default_rng(2))
    parts = [m.context, m.output, m.bias, m.node, m.node_bias, m.position]
    seen, used = [np.ones(x.shape) for x in parts], [np.zeros(len(x), int) for x in (m.context, m.output, m.node, m.position)]
    draws, chances, shift = np.random.default_rng(2), np.cumsum(corpus.noise), np.log(5 * corpus.noise)
    on = lambda x: 1 / (1 + math.exp(-x))
    for at in range(0, 100, 40):
        grads = [np.zeros(x.shape) for x in parts]
        false = (chances / chances[-1]).searchsorted(draws.random(5), "right")
        context, output, bias, node, node_bias, position = grads
        np.add.at(used[1], false, 1)
        for a, b, c in zip(w[at:at + 40], h1[at:at + 40], h2[at:at + 40], strict=True):
            q = m.position[0] * m.context[b] + m.position[1] * m.context[c]
            dq = np.zeros(6)
            for o, true in [(corpus.output_of[a], 1), *((x, 0) for x in false)]:
                err = on(q @ m.output[o] + m.bias[o] - shift[o]) - true
                dq += err * m.output[o]
                output[o] += err * q
                bias[o] += err
            for x, left in zip(corpus.nodes[a], corpus.left[a], strict=True):
                if x >= 0:
                    err = on(q @ m.node[x] + m.node_bias[x]) - left
                    dq += err * m.node[x]
                    node[x] += err * q
                    node_bias[x] += err
                    used[2][x] += 1
            for i, h in enumerate((b, c)):
                context[h] += dq * m.position[i]
                position[i] += dq * m.context[h]
                used[0][h] += 1
            used[1][corpus.output_of[a]] += 1
            used[3] += 1
        for value, total, grad in zip(parts, seen, grads, strict=True):
            total += grad * grad
            value -= 0.15 * grad / np.sqrt(total)
    assert (corpus.nodes >= 0).any() and np.allclose(learner.weights.rows(), m.rows(), rtol=1e-3, atol=1e-4)
    assert learner.moved().tolist() == np.concatenate(used).tolist()


def test_distinct_keys_of_a_step():
    keys, marks = np.array([5, 2, 5, 9, 2, 5]), np.full(10, 7)
    some, at, times = lm.several(keys, marks)
    assert some[at].tolist() == keys.tolist() and dict(zip(some.tolist(), times.tolist())) == {5: 3, 2: 2, 9: 1}


def test_probabilities_add_up(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHORTLIST", 20)
    text = " ".join(random.Random(1).choices([f"w{i}" for i in range(60)], k=3000))
    counts = lm.token_counts(spark.createDataFrame([(text,)], "text string"))
    corpus = lm.corpus_of(counts, 20, 0.01)
    weights = lm.start_weights(corpus, 8)
    outputs = np.arange(corpus.outputs)
    assert math.isclose(np.exp(lm.log_probabilities(weights, outputs, np.full_like(outputs, 3), np.full_like(outputs, 5))).sum(), 1, rel_tol=1e-4)
    held = {r.token: r.n for r in counts.collect()}
    short = set(corpus.shortlist.view(np.int64).tolist())
    for c in range(lm.CLASSES):  # the places in a class add up to it, with one unknown token
        assert math.isclose(sum(n + lm.ADD for t, n in held.items() if t not in short and t & lm.CLASS_BITS == c) + lm.ADD, corpus.mass[c])


def test_tokens_below_the_shortlist_are_learnt(spark):
    rng = random.Random(4)
    pairs = [(f"l{i}a", f"r{i}b") for i in range(40)]  # all on the right are in one class, none is in the shortlist
    rows = [(i, " ".join(w for _ in range(100) for w in rng.choice(pairs))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    counts = lm.token_counts(df)
    corpus = lm.corpus_of(counts, 5, lm.LEAST_SHARE)
    weights = lm.train(df, corpus)
    place = lambda word: corpus.ids(lm.tokens_of(word)[:1])
    chance = lambda m, word, before: np.exp(lm.log_probabilities(m, corpus.output_of[place(word)], place(before), place("none"))
                                            + lm.path_log_probabilities(m, corpus, place(word), place(before), place("none")))[0]
    told = [(chance(weights, r, a), chance(weights, r, b)) for (a, r), (b, _) in zip(pairs, pairs[1:] + pairs[:1], strict=True) if corpus.output_of[place(r)[0]] >= 5]
    assert len(told) > 30 and np.mean([x > 2 * y for x, y in told]) > 0.9
    every = np.arange(corpus.places)  # all places after one context add up to one
    h = np.full_like(every, 7)
    whole = np.exp(lm.log_probabilities(weights, corpus.output_of[every], h, h) + lm.path_log_probabilities(weights, corpus, every, h, h))
    assert math.isclose(whole.sum(), 1, rel_tol=1e-4)


def test_language_scores_of_odd_rows(spark):
    got = lm.language_scores(odd(spark)).collect()
    assert len(got) == 6 and sorted(r.n_tokens for r in got) == [1, 1, 6, 6, 6, 60_001]
    assert lm.language_scores(odd(spark).limit(0)).count() == 0
    unknown = lm.language_scores(odd(spark), queries.F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens) for r in unknown} == {(0, 0)} and all(math.isfinite(r.score) for r in unknown)


def test_workers_need_not_have_the_package(tmp_path):
    """A session that was started in another folder, whose workers cannot import this package."""
    code = f"""
import sys
sys.path.insert(0, {str(Path(__file__).resolve().parents[2])!r})
from tideline.llm import language, lm, phrases
from tideline.session import build_session
spark = build_session("elsewhere", "local[2]", spark__sql__shuffle__partitions=2, spark__ui__enabled="false")
docs = spark.createDataFrame([(i, "the cat sat on the mat and the dog " * 3, "en") for i in range(40)], "doc_id long, text string, lang string")
assert lm.language_scores(docs).count() == language.predict(docs, language.learn(docs)).count() == 40 and phrases.phrases(docs).count() > 0
print("done")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    ran = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert ran.stdout.strip().endswith("done"), ran.stderr[-2000:]


def test_pipeline_stage_by_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    for (name, stage), check in zip(corpus_pipeline.STAGES, (None, "poor", "copies", "mix", "tokens"), strict=True):
        made = corpus_pipeline.cut_lineage(stage(spark, docs, SF))
        before = {r.doc_id: r.text for r in docs.collect()} if check in ("poor", "copies") else None
        after = made.collect()
        if check != "tokens":
            assert made.columns == columns, name
        if check == "poor":
            hosts_fine = {r.doc_id for r in after}
            short = {i for i, t in before.items() if len(t.split()) < 20}
            assert not hosts_fine & short and len(after) > 0.8 * len(before)
        if check == "copies":
            assert {r.doc_id for r in after} == {g for _, g in plain_groups(list(before.items()), 5).values()}
        if check == "mix":
            assert all(r.n_chars == len(r.text) for r in after)
        docs = made
    assert docs.columns == ["doc_id", "source", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and docs.count() > 0
    assert all(len(r.ids) == r.n_tokens and hashlib.sha256(struct.pack(f"<{len(r.ids)}I", *r.ids)).hexdigest() == r.ids_sha256 for r in docs.limit(50).collect())


def test_pipeline_stages_on_odd_rows(spark):
    """Nulls in every column, empty texts, repeated rows, added columns with the names the stages use, and no rows at all."""
    clean = " ".join(f"word{i}" for i in range(60))
    rows = [(1, clean, "en", "x", 5), (1, clean, "en", "x", 5), (None, None, None, None, None), (None, clean + " more", None, None, 0), (2, "", "en", "y", 0),
            (3, clean.replace("word7", "other"), "en", "y", 9), (4, " ".join(f"own{i}" for i in range(80)), "de", "x", 1)]
    names = ("score", "predicted", "kept", "n_words", "size", "place", "group_key", "ids", "_tie", "n_tokens")
    docs = spark.createDataFrame([(*r, *(7,) * len(names)) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} int" for n in names))
    for df in (docs, docs.limit(0)):
        at, left = df, []
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, at, SF)
            assert name == "tokens" or set(made.columns) <= set(docs.columns) and {"doc_id", "text", "source", "n_chars"} <= set(made.columns), (name, made.columns)
            at = corpus_pipeline.cut_lineage(made)
            left.append(at.count())
        if df is docs:
            assert left[0] == 7 and left[1] == 5  # too short ones go
            assert left[2] == 2  # copies and near copies of one text are one document
            assert {len(r.ids) == r.n_tokens for r in at.collect()} == {True}
        else:
            assert left == [0] * 5


def test_wide_subsets_of_lexicon_terms_are_read_not_made(monkeypatch):
    """Terms of the band have their wide subsets in the table already; only the others' are worked out."""
    text, made, members = "a b c d e f", [], fingerprints.members
    lex = fingerprints.terms_of("a b c d e")
    table = members(lex)
    monkeypatch.setattr(fingerprints, "members", lambda terms, *rest: made.append(len(terms)) or members(terms, *rest))
    assert fingerprints.fingerprint_of(text, lex, table).hex() == plain_fingerprint(text, set(lex.tolist()))
    assert sum(made) == 1

"""Phrases: by definition on strings, long texts in stretches, odd rows. The SQL twin is compared in test_rules.py."""

import collections
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tideline.llm import phrases as ph

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows, longest=3, least=10, top=2000):
    f, total = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(UPPER)):
            w = re.findall("[^ \t]+", piece)
            total[lang] += len(w)
            for n in range(1, longest + 1):
                f.update((lang, *w[i:i + n]) for i in range(len(w) - n + 1))
    candidates = {p: a for p, a in f.items() if len(p) > 2 and a >= least}
    longer = collections.Counter()
    for (lang, *w), a in candidates.items():
        for n in range(2, len(w)):
            for i in range(len(w) - n + 1):
                longer[(lang, *w[i:i + n])] = max(longer[(lang, *w[i:i + n])], a)
    out = collections.defaultdict(list)
    for p, a in candidates.items():
        if 100 * longer[p] >= 50 * a and longer[p]:
            continue
        lang, w = p[0], p[1:]
        score, k = min((10**6 * a * a // (f[(lang, *w[:k])] * f[(lang, *w[k:])]), k) for k in range(1, len(w)))
        out[lang].append((-score, -a, " ".join(w).encode(), f[(lang, *w[:k])], f[(lang, *w[k:])]))
    return sorted((lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for lang, ps in out.items() for i, (s, a, p, l, r) in enumerate(sorted(ps)[:top]))


def rows_of(df):
    return sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in df.collect())


def made(n=300, seed=4):
    rng, out = random.Random(seed), []
    words = ["The", "of", "cat", "éa", "x", "naïve", "dog-s", "汉字", "1", " y"]
    for _ in range(n):
        parts = [rng.choice(words) + rng.choice([" ", "  ", "\t", " ", " ", ", ", ".", "\n", "!? "]) for _ in range(rng.randrange(60))]
        out.append((rng.choice(["en", "en", "fr", None, "und"]), rng.choice(["", " ", "."]) + "".join(parts)))
    return out


@pytest.mark.parametrize("longest,least,top", [(3, 10, 2000), (4, 3, 25), (2, 5, 2000)])
def test_by_definition(spark, longest, least, top):
    rows = made()
    got = ph.phrases(spark.createDataFrame(rows, "lang string, text string").repartition(3), longest=longest, least=least, top=top)
    assert rows_of(got) == plain(rows, longest, least, top)


@pytest.mark.parametrize("piece", [1, 5, 40, 300])
def test_stretches_hold_every_run_once(piece, monkeypatch):
    """Long texts are cut between words; runs over a cut are found once, at their own word number."""
    from tideline.llm import worker

    texts = [t for _, t in made(12, 9)] + ["w" * 100 + " " + "a b c " * 60, "", "one"]
    monkeypatch.setattr(ph, "PIECE", piece)
    monkeypatch.setattr(ph, "kept", lambda name, make, tables=ph._tables(): tables)
    assert worker.HELD
    for n in (1, 2, 3):
        got, before = collections.Counter(), {}
        for data, offsets, rows, old in ph.stretches(pa.array(texts)):
            w = ph.Words(data, offsets)
            counted = len(ph.word_starts(data[:old]))
            start = before.get(rows[0], 0) - counted if old else 0
            before = {rows[0]: start + len(w.starts)}
            first = w.runs(n)
            first = first[first + n > counted]
            base = np.searchsorted(w.doc, np.arange(len(rows)))
            for i in first.tolist():
                d = w.doc[i]
                got[int(rows[d]), int(i - base[d] + start), w.line[w.starts[i]:w.ends[i + n - 1]].tobytes().decode()] += 1
        want = collections.Counter()
        for r, t in enumerate(texts):
            k = 0
            for p in re.split("[.,;:!?\x0a-\x0d]", t.translate(UPPER)):
                w = re.findall("[^ \t]+", p)
                want.update((r, k + i, " ".join(w[i:i + n])) for i in range(len(w) - n + 1))
                k += len(w)
        assert got == want


def test_counted_fingerprints_are_handed_on_in_small_batches(monkeypatch):
    """No batch is larger than ``HANDED`` rows, and together they hold each fingerprint of a language once, with a place where it stands."""
    monkeypatch.setattr(ph, "HANDED", 100)
    rng = np.random.default_rng(3)
    a, code = rng.integers(1, 400, 3000), rng.integers(0, 2, 3000)
    held = [(a[i::2], a[i::2] * 5, code[i::2], a[i::2] + 1000, a[i::2] + code[i::2]) for i in range(2)]
    got = list(ph.told(held, ["en", None]))
    assert not held and len(got) > 5 and max(b.num_rows for b in got) <= 100
    rows = [tuple(r.values()) for b in got for r in b.to_pylist()]
    want = collections.Counter(zip(a.tolist(), code.tolist()))
    assert sorted(rows, key=str) == sorted(((["en", None][c], x, x * 5, n, x + 1000, x + c) for (x, c), n in want.items()), key=str)


def test_fingerprints_are_those_of_the_text():
    """The same run has the same numbers wherever it stands, and other runs have others."""
    w = ph.Words(np.frombuffer(b"a b  a\tb. ab a b c", np.uint8), np.array([0]))
    two = dict(zip(w.runs(2).tolist(), zip(*(x.tolist() for x in w.prints(w.runs(2), 2)))))
    assert two[0] == two[2] == two[5] and len(set(two.values())) == 4 and 3 not in two


def test_a_text_key_shared_by_two_texts(spark):
    """The fingerprint is checked where the phrase stands, so the right one of two texts is read."""
    docs = spark.createDataFrame([(7, "x y z"), (7, "the cat sat"), (7, "the cat sat"), (8, "nothing here")], "text_key long, text string")
    w = ph.Words(np.frombuffer(b"the cat", np.uint8), np.array([0]))
    a, b = (int(x[0]) for x in w.prints(np.array([0]), 2))
    asked = spark.createDataFrame([("en", a, b, 12, 2, 7, 0), ("en", a + 1, b, 12, 2, 8, 0)], "lang string, a long, b long, f long, n long, text_key long, word long")
    assert [(r.phrase, r.f) for r in ph.written_out(docs, asked).collect()] == [("the cat", 12)]


def test_bits_never_deny_a_frequent_one(spark):
    rows = [("en" if i % 2 else "fr", i * 7919, i * 104729) for i in range(5000)]
    bits = ph.frequent_bits(spark.createDataFrame(rows, "lang string, a long, b long"))
    lang = np.array([ph.lang_number(r[0]) for r in rows], np.uint64)
    a, b = (np.array([r[k] for r in rows], np.int64) for k in (1, 2))
    assert bits.has(a, b, lang).all() and bits.has(a + 1, b, lang).mean() < 0.1
    none = ph.frequent_bits(spark.createDataFrame([], "lang string, a long, b long"))
    assert not none.has(a, b, lang).any()


def test_odd_rows(spark):
    long = "new york city " * 30_000
    rows = [(None, None, 1), ("en", None, 1), ("en", "", 2), ("en", " .,;", 3), (None, "New York " * 12, 4), ("en", long, 5), ("en", long, 5)]
    df = spark.createDataFrame([(*r, "mine", 1) for r in rows], "lang string, text string, doc_id long, phrase string, rank int")
    assert rows_of(ph.phrases(df)) == plain([r[:2] for r in rows])
    assert ph.phrases(df.limit(0)).count() == 0
    hot = spark.createDataFrame([("en", "good morning all")] * 500 + [("en", f"good w{i}") for i in range(200)], "lang string, text string")
    assert rows_of(ph.phrases(hot)) == plain([tuple(r) for r in hot.collect()])

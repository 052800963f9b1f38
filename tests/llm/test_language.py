"""Rank-order profiles: by definition, on held-out documents, odd rows."""

import collections
import unicodedata
import zlib

import numpy as np
import pytest

from tideline.llm import language, queries

SF = "/root/testdata/sf0.01"


def plain_grams(text):
    """N-grams by definition, on strings."""
    words, word = [], ""
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    out, line = collections.Counter(), "\x01" + "".join(w + "\x01" for w in words)
    for n in (1, 2, 3):
        for i in range(len(line) - n + 1):
            g = line[i:i + n]
            if g != "\x01" and "\x01" not in g[1:-1]:
                out[g] += 1
    return out


def plain_profile(counts, size):
    code = lambda g: [0] * (3 - len(g)) + [ord(c) for c in g]
    return sorted(counts, key=lambda g: (-counts[g], len(g), code(g)))[:size]


def plain_distance(top, profile, size):
    rank = {g: i for i, g in enumerate(profile)}
    return sum(abs(rank[g] - i) if g in rank else size for i, g in enumerate(top))


TEXTS = ["Hello, hello wörld!", "", "1234 --", "éa é", "नमस्ते दुनिया", "汉字汉字", "İSTANBUL straße", "a", "a" * 50, "\x01ab\x01", "𝔘𝔫𝔦 x"]


@pytest.mark.parametrize("text", TEXTS)
@pytest.mark.parametrize("piece", [1, 2, 3, 7, 1 << 18])
def test_grams_by_definition(text, piece, monkeypatch):
    monkeypatch.setattr(language, "PIECE", piece)
    keys, counts, letter = language.grams(text)
    got = {"".join(chr(k >> b & 0x1FFFFF) for b in (42, 21, 0) if k >> b): n for k, n in zip(keys.tolist(), counts.tolist())}
    assert got == {g: n for g, n in plain_grams(text).items() if g.strip("\x01")} and letter == any(unicodedata.category(c)[0] == "L" for c in text)
    assert (np.diff(keys) > 0).all()


@pytest.fixture(scope="module")
def scored(spark):
    return queries.op11_language_ids(spark, SF).collect()


def test_predictions_by_definition(spark, scored):
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    size, per = language.SIZE, {}
    for i, d in docs.items():
        if zlib.crc32(str(i).encode()) % 4 != 2 and d.lang is not None and d.text is not None:
            per.setdefault(d.lang, collections.Counter()).update(plain_grams(d.text))
    profiles = {lang: plain_profile(c, size) for lang, c in per.items()}
    assert len(scored) == len(docs)
    for r in sorted(scored, key=lambda r: r.doc_id)[::7]:
        top = plain_profile(plain_grams(docs[r.doc_id].text or ""), size)
        if not any(unicodedata.category(c)[0] == "L" for c in docs[r.doc_id].text or ""):
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        d, best = min((plain_distance(top, p, size), lang) for lang, p in profiles.items())
        assert r.lang_pred == best and abs(r.score - (1 - d / (size * len(top)))) < 1e-12


def test_held_out_documents(spark, scored):
    lang = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    held = [r for r in scored if r.held_out]
    assert {r.doc_id for r in held} == {i for i in lang if zlib.crc32(str(i).encode()) % 4 == 2}
    right = sum(r.lang_pred == lang[r.doc_id][0] for r in held)
    assert right >= 0.97 * len(held) and all(0 <= r.score <= 1 for r in scored)


def test_odd_rows(spark):
    long = "der die das und ist nicht ein eine " * 40_000
    rows = [(1, "the cat and the dog", "en"), (1, "the cat and the dog", "en"), (None, None, None), (2, "", "en"), (3, long, "de"), (4, "12 --- 34", None),
            (5, "der hund und die katze", "de"), (6, "the the", None), (7, "ωωω", None)]
    df = spark.createDataFrame([(*r, "mine", 7.0) for r in rows], "doc_id long, text string, lang string, lang_pred string, score double")
    profiles = language.learn(df)
    got = language.predict(df, profiles).collect()
    assert profiles.langs == ["de", "en"] and len(got) == 9 and got[0].asDict().keys() == {"doc_id", "text", "lang", "lang_pred", "score"}
    by = {r.doc_id: (r.lang_pred, r.score) for r in got}
    assert by[1][0] == by[6][0] == "en" and by[3][0] == by[5][0] == "de" and by[None] == by[2] == by[4] == ("und", 0.0)
    assert by[7] == ("de", 0.0)  # nothing known: all languages are equally far
    assert language.predict(df.limit(0), profiles).count() == 0
    empty = language.learn(df.limit(0))
    assert empty.langs == [] and {r.lang_pred for r in language.predict(df, empty).collect()} == {"und"}

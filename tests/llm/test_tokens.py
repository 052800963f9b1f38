"""Token operators against the library for the vocabulary file."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tideline.llm import bpe, bytebpe, queries, tokens
from tideline.llm.worker import Recent

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
LETTERS = [*"abcdefghilmnorst  '\n\t.!?0123éñßü日本　\x85\x1c😀", "'ll", "'s", "<|endoftext|>", "<|endof", " the", "ing", "tion"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return bytebpe.ByteBpe(PATH)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    return ["".join(rng.choices(LETTERS, k=rng.randint(0, 60))) for _ in range(400)] + ["", "a" * 3000, "=" * 500, "<|endoftext|>" * 3]


def test_encoding_is_the_librarys(library, vocabulary, texts):
    got = bpe.encode_texts(vocabulary, texts, Recent(100), bpe.Verdicts(vocabulary))
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == want
    assert [bpe.decode_ids(vocabulary, g) for g in got] == [library.decode(w, skip_special_tokens=False) for w in want]


def test_only_failing_words_are_merged(vocabulary, monkeypatch):
    words = [" the", " undesirable", "hello"]
    want = [vocabulary.exact(w.encode()) for w in words]
    verdicts = bpe.Verdicts(vocabulary)
    bpe.encode_words(vocabulary, words, verdicts)
    again = [w.encode() for w in words if bpe.propose(vocabulary, w.encode()) == vocabulary.exact(w.encode())]
    merged, plain = [], vocabulary.exact
    monkeypatch.setattr(vocabulary, "exact", lambda w: merged.append(w) or plain(w))
    assert bpe.encode_words(vocabulary, words, verdicts) == want
    assert not set(merged) & set(again)


def test_ids_that_are_no_text_decode_like_the_library(library, vocabulary):
    ids = [447, 50256, 11737, 199]
    assert bpe.decode_ids(vocabulary, np.array(ids, "<u4").tobytes()) == library.decode(ids, skip_special_tokens=False)


def test_counts_at_every_prefix(library, vocabulary, texts):
    for text in texts[:150]:
        want = [len(library.encode(text[:i], add_special_tokens=False).ids) for i in range(len(text) + 1)]
        assert tokens.prefix_counts(vocabulary, text) == want
        if "<|endoftext|>" not in text:
            for limit in (1, 4, 9, 30):
                assert tokens.fitting(vocabulary, text, limit) == max(i for i, c in enumerate(want) if c <= limit)


def test_queries_against_the_library(spark, library):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    ids = {k: library.encode(t or "", add_special_tokens=False).ids for k, t in docs.items()}
    got = {r.doc_id: r for r in queries.op5_token_counts(spark, SF).collect()}
    assert {k: (r.n_bytes, r.n_tokens, r.over_limit) for k, r in got.items()} == \
        {k: (len((docs[k] or "").encode()), len(i), len(i) > 512) for k, i in ids.items()}
    for k, r in got.items():
        cut = docs[k][:r.fit_chars]
        assert len(library.encode(cut, add_special_tokens=False).ids) <= 512
        assert cut == docs[k] or len(library.encode(docs[k][:r.fit_chars + 1], add_special_tokens=False).ids) > 512
    trip = {r.doc_id: r for r in queries.op7_bpe_round_trip(spark, SF).collect()}
    for k, i in ids.items():
        assert trip[k].n_tokens == len(i)
        assert trip[k].ids_sha256 == hashlib.sha256(np.array(i, "<u4").tobytes()).hexdigest()
        assert trip[k].decoded_sha256 == hashlib.sha256(library.decode(i, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark):
    df = spark.createDataFrame([(None, None, 1), (1, "", 2), (1, "", 2), (2, "a b" * 4000, None)], "doc_id long, text string, n_tokens int")
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df, PATH).collect())
    assert got == [(0, 0, 0, False), (1, 0, 0, False), (1, 0, 0, False), (2, 12000, 4001, True)]
    trip = bpe.round_trip(df, PATH)
    assert trip.columns == ["doc_id", "text", "n_tokens", "ids_sha256", "decoded_sha256"] and trip.count() == 4
    back = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert all(r.decoded == (r.text or "") for r in back)
    none = df.limit(0)
    assert tokens.count_tokens(none, PATH).count() == bpe.round_trip(none, PATH).count() == 0


def test_new_words_cost_no_call_each(library, vocabulary, texts, monkeypatch):
    """Failing words are merged together: once tokens and neighbours are known, only long words are merged one by one."""
    verdicts = bpe.Verdicts(vocabulary)
    first = bpe.encode_texts(vocabulary, texts, Recent(100), verdicts)
    merged, plain = [], vocabulary.exact
    monkeypatch.setattr(vocabulary, "exact", lambda w: merged.append(w) or plain(w))
    assert bpe.encode_texts(vocabulary, texts, Recent(100), verdicts) == first
    assert all(len(w) > bytebpe.SHORT for w in merged)


def test_merging_many_words_is_merging_each(vocabulary, monkeypatch):
    rng = random.Random(7)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(1, 20))).encode() for _ in range(3000)]
    words += [b"a", b"", bytes(range(256)), b"e" * 48, b"e" * 49, b" th" * 16, b"ing" * 16 + b"i", b"\xff\xfe"]
    monkeypatch.setattr(bytebpe, "AT_ONCE", 700)
    got = [np.frombuffer(p, "<u4").tolist() for p in vocabulary.exact_all(words)]
    assert got == [vocabulary.exact(w) for w in words]
    assert vocabulary.exact_all([]) == []


def test_proposals_are_the_longest_tokens_from_the_left(vocabulary):
    def longest(word):
        out, at = [], 0
        while at < len(word):
            end = next(e for e in range(len(word), at, -1) if word[at:e] in vocabulary.ids)
            out.append(vocabulary.ids[word[at:end]])
            at = end
        return out

    rng = random.Random(8)
    words = ["".join(rng.choices(LETTERS, k=rng.randint(1, 12))).encode() for _ in range(500)] + [b"undesirable", b" undesirable", b"\xff"]
    flat, owner = bpe.propose_all(vocabulary, words)
    assert [flat[owner == i].tolist() for i in range(len(words))] == [longest(w) for w in words]
    assert [bpe.propose(vocabulary, w) for w in words] == [longest(w) for w in words]


def test_pieces_of_near_letters_are_those_of_all(vocabulary):
    near = [chr(c) for c in range(0x250)]
    some = [a + b + c for a in near for b in ("", " ", "a", "1", "'", "\n", "!") for c in ("", "s", " ", "é", "½", "\x1c", "\t")]
    rng = random.Random(9)
    some += ["".join(rng.choices([*near, *" '" * 60, *"stremvld" * 9, "日", "１"], k=12)) for _ in range(5000)]
    assert [vocabulary.pieces(t) for t in some] == [vocabulary.far_pieces(t) for t in some]


def test_recent_values_stay_and_old_ones_go():
    cache = Recent(20 * 200, lambda v: 0)
    cache.put_all({str(i): i for i in range(1500)})  # more than is entered at once
    assert cache.find(["1499", "x", "1499"]) == ({"1499": 1499}, ["x"])
    for i in range(2000, 2100):
        cache.put_all({str(i): i})
        assert cache.find(["1499"])[0]
    assert cache.find(["0", "2000"]) == ({}, ["0", "2000"])
    assert len(cache.new) + len(cache.old) <= 2 * 25

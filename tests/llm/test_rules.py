"""Quality rules, shards, mixing and url verdicts: SQL twins, brute force, odd rows."""

import collections
import hashlib
import re

import duckdb
import pytest
from check_oracle import TABLES, compare
from pyspark.sql import functions as F

from tideline.llm import mixing, quality, queries, sharding, urls

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    """Nulls in every column, an empty and a long text, a repeated row, clashing extra columns."""
    long = " ".join(f"word{i % 977} the of" for i in range(20_000))
    rows = [(1, "a b c", "en", "x", 5), (1, "a b c", "en", "x", 5), (None, None, None, None, None), (2, "", "en", None, 0), (3, long, "en", "x", len(long)),
            (4, "one two three " * 30, None, "y", 0)]
    return spark.createDataFrame([(*r, "mine", 7) for r in rows], DOC + ", kept string, size int")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_sql_twin(spark, con, name):
    ok, rows, _, note = compare(spark, con, queries.QUERIES[name], queries.ORACLES[name], SF)
    assert ok and not note, note


def test_hosts_are_judged_by_shrunken_rates(spark):
    good = " ".join(f"w{i}" for i in range(30))
    rows = [(i, good if i % 10 else "short", "good") for i in range(100)] + [(100 + i, "short" if i < 90 else good, "bad") for i in range(100)] + \
        [(200 + i, good if i % 8 else "short", f"h{i // 20}") for i in range(100)] + [(300, "short", "one"), (301, good, None)]
    got = {r.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[195].host_rejected and not got[195].kept and not got[195].base_failed
    assert not got[300].host_rejected and not got[300].kept  # one failure of one document does not damn a host
    assert got[301].kept and got[1].kept and not got[0].kept


def test_quality_of_odd_rows(spark):
    got = quality.judge(odd(spark)).collect()
    assert len(got) == 6 and all(r.kept is not None for r in got)
    assert [(r.n_words, r.base_failed) for r in got if r.doc_id is None] == [(0, True)]
    assert next(r for r in got if r.doc_id == 4).n_repeat_words == 90
    assert quality.judge(odd(spark).limit(0)).count() == 0


def test_repeated_words_by_definition():
    words = "a b c d e f g h i a b c d e f g h z a b c d e f g".split()
    raw = [w.encode() for w in words]
    windows = collections.Counter(tuple(raw[i:i + 8]) for i in range(len(raw) - 7))
    want = {j for i in range(len(raw) - 7) if windows[tuple(raw[i:i + 8])] > 1 for j in range(i, i + 8)}
    assert quality.repeated_words(raw) == len(want) == 16


@pytest.mark.parametrize("limit", [1 << 16, 3000])
def test_shards_by_definition(spark, limit):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    bits = {i: bin(int(hashlib.md5(f"={i}\n={t}".encode()).hexdigest()[:14], 16))[2:].zfill(56) for i, t in docs}
    size = {i: len(t.encode()) for i, t in docs}

    def split(prefix, ids):
        if sum(size[i] for i in ids) <= limit or len(ids) == 1:
            return {i: prefix for i in ids}
        return {i: p for b in "01" for i, p in split(prefix + b, [i for i in ids if bits[i][len(prefix)] == b]).items()} if ids else {}

    got = sharding.shard(spark.read.parquet(f"{SF}/documents.parquet"), limit).collect()
    assert {r.doc_id: r.shard for r in got} == split("", list(size))
    assert all(r.shard_fits == (r.shard_bytes <= limit) and (r.shard_fits or r.shard_rows == 1) for r in got)


def test_shards_of_odd_rows(spark):
    got = sharding.shard(odd(spark), 100).collect()
    assert len(got) == 6 and {r.shard_fits for r in got if r.doc_id in (1, 2)} == {True}
    assert [r.shard_fits for r in got if r.doc_id == 3] == [False]
    same = sharding.shard(spark.createDataFrame([(1, "x" * 80)] * 3, "doc_id long, text string"), 100).collect()
    assert {(r.shard_depth, r.shard_bytes, r.shard_fits) for r in same} == {(56, 240, False)}
    assert sharding.shard(odd(spark).limit(0), 100).count() == 0


def poured(sizes, weights=(5, 2, 1)):
    """Targets by pouring the excess on, again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, cut, open_ = sum(sizes.values()), {}, set(order)
    while True:
        left, all_w = total - sum(cut.values()), sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / all_w > 3 * sizes[s]}
        if not over:
            return cut | {s: left * weight[s] / all_w for s in open_}
        cut |= {s: 3.0 * sizes[s] for s in over}
        open_ -= over


def test_mix_of_the_documents(spark):
    got = queries.op6_mixed_sources(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    sizes = {i: len(re.findall(r"[^\x20\x09-\x0D]+", d.text or "")) for i, d in docs.items()}
    per = collections.Counter()
    for i, d in docs.items():
        per[d.source] += sizes[i]
    want, taken = poured(per), collections.Counter()
    for r in got:
        s = docs[r.doc_id].source
        assert (r.size, r.source_size) == (sizes[r.doc_id], per[s]) and abs(r.target - want[s]) < 1e-6 and r.taken <= 3 * r.size
        taken[s] += r.taken
    assert len(got) == len(docs) and all(abs(taken[s] - want[s]) <= 40 + 0.01 * want[s] for s in want)
    assert sorted(map(tuple, got)) == sorted(map(tuple, queries.op6_mixed_sources(spark, SF).collect()))


def test_mix_keeps_caps_blocks_and_odd_rows(spark):
    rows = [(i, "tiny", "w " * 40) for i in range(3)] + [(10 + i, f"s{i % 4}", "w " * (50 + 97 * i)) for i in range(40)] + [(None, None, None), (99, "none", "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    at, spans = mixing.mix(df, block=8, shard_slots=50)
    got = mixing.taken(df, block=8, shard_slots=50).collect()
    sizes = collections.Counter()
    for _, s, t in rows:
        sizes[s] += len((t or "").split())
    want, taken = poured(sizes), collections.Counter()
    for r in got:
        assert abs(r.target - want[r.source]) < 1e-6 and r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= 16 for s in want)
    # In a round no block comes twice, and spans lie inside their rows.
    drawn = spans.groupBy("source", "round", "block", "place").count().collect()
    assert max(r["count"] for r in drawn) == 1
    placed = {(r.source, r.place): r.size for r in at.filter("size > 0").collect()}
    assert all(r.first >= 0 and r.first + r.n_words <= placed[r.source, r.place] for r in spans.collect())
    texts = mixing.mixed_texts(df, block=8, shard_slots=50)
    assert texts.columns == df.columns
    assert texts.agg(F.sum(F.size(F.split(F.trim("text"), " ")))).first()[0] == sum(taken.values())
    assert mixing.taken(odd(spark)).count() == 6 and mixing.mixed_texts(odd(spark)).columns == odd(spark).columns
    assert mixing.taken(odd(spark).limit(0)).count() == mixing.mixed_texts(odd(spark).limit(0)).count() == 0


def plain_parts(url):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "", re.S)
    return ("".join(c.lower() if "A" <= c <= "Z" else c for c in m[1]), m[2]) if m else ("", "")


def plain_rule(host, path):
    fits = [(r, v) for r, v in queries.RULES for d, _, p in [r.partition("/")] if (host == d or host.endswith("." + d)) and path.startswith("/" + p)]
    return max(fits, key=lambda f: len(f[0]), default=(None, None))


def test_urls_of_the_pages(spark):
    got = queries.op10_url_verdicts(spark, SF).collect()
    pages = {r.page_id: r.url for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    assert len(got) == len(pages)
    for r in got:
        assert (r.host, r.path) == plain_parts(pages[r.page_id])
        rule, verdict = plain_rule(r.host, r.path)
        assert r.rule == rule and r.verdict in ("allow", "block") and (verdict is None or r.verdict == verdict)


def test_bad_templates_are_learnt(spark):
    rows = [(f"http://h.org/good/{i}", 1.0) for i in range(40)] + [(f"http://h.org/spam/{i}.html", 0.0) for i in range(40)] + \
        [(f"http://h.org/news/{i}", 1.0) for i in range(40)] + [("http://h.org/spam/777", None), ("http://h.org/good/777", None), ("http://h.org/rare", None),
                                                                ("http://new.org/a/b", None), (None, None), ("no scheme", None), ("HTTP://EXAMPLE.com/EN/x", None), ("http://com", None)]
    df = spark.createDataFrame([(*r, "mine") for r in rows], "url string, good double, host string")
    got = urls.judge_urls(df, queries.RULES, label="good").collect()
    of = {r.url: r for r in got}
    assert len(got) == len(rows) and of["http://h.org/spam/777"].verdict == "block" and of["http://h.org/good/777"].verdict == "allow"
    assert of["http://h.org/good/3"].template == of["http://h.org/news/3"].template == "/{good|news}/*"  # alike branches are one
    assert of["http://h.org/spam/3.html"].template == "/spam/*" and of["http://new.org/a/b"].verdict == "allow"
    assert (of[None].host, of[None].path, of[None].rule) == ("", "", None) == (of["no scheme"].host, of["no scheme"].path, of["no scheme"].rule)
    assert (of["HTTP://EXAMPLE.com/EN/x"].host, of["HTTP://EXAMPLE.com/EN/x"].rule) == ("example.com", "com/") and of["http://com"].rule is None
    assert urls.judge_urls(df.limit(0), queries.RULES, label="good").count() == 0


def test_small_sections_are_told_apart_by_their_labels(spark):
    rows = [(f"http://{host}.org/s{chr(97 + k)}/{i}", float((k == 7) == (host == "bad"))) for host in ("good", "bad") for k in range(25) for i in range(40)]
    df = spark.createDataFrame([*rows, ("http://good.org/sh/777", None), ("http://bad.org/sh/777", None)], "url string, good double")
    of = {r.url: r for r in urls.judge_urls(df, (), label="good").collect()}
    assert (of["http://good.org/sh/777"].learnt, of["http://bad.org/sh/777"].learnt) == ("block", "allow")
    assert (of["http://good.org/sa/3"].learnt, of["http://bad.org/sa/3"].learnt) == ("allow", "block")
    assert of["http://good.org/sh/777"].template == "/sh/*"


def test_deep_branches_are_told_apart(spark):
    rows = [(f"http://h.org/a/b/c/d/e/{s}/{i}", g) for s, g in (("good", 1.0), ("spam", 0.0)) for i in range(40)] + [("http://h.org/" + "x/" * 60, None)]
    of = {r.url: r for r in urls.judge_urls(spark.createDataFrame(rows, "url string, good double"), (), label="good").collect()}
    assert (of["http://h.org/a/b/c/d/e/good/3"].learnt, of["http://h.org/a/b/c/d/e/spam/3"].learnt) == ("allow", "block")
    assert of["http://h.org/a/b/c/d/e/spam/3"].template == "/a/b/c/d/e/spam/*" and of["http://h.org/" + "x/" * 60].template == "/*" * 60

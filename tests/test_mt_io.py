"""Translation metrics, readers and sinks on small inputs."""

import random
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators import content as ct
from tideline.operators import cost as cs
from tideline.operators import mt
from tideline.plans import io as pio
from tideline.plans.io import write_images
from tideline.sources import readers as rd
from tideline.sources import sinks as sk
from tideline.streaming.inbound import inbound_stream


def grams(s, n):
    return Counter(tuple(s[i:i + n]) for i in range(len(s) - n + 1))


def test_chrf_sentence(spark):
    cases = [("a", "the cat sat", "the cat sat"), ("b", "The  Cat", "the cat sat down"), ("c", "", "x"), ("d", "zz", "xx"), ("e", "añb", "a ñ b 😀")]
    df = spark.createDataFrame(cases, "pair_id string, hyp string, ref string")
    got = {r.pair_id: r.chrf for r in mt.chrf_sentence(df).collect()}
    for key, hyp, ref in cases:
        hyp, ref = (" ".join(t.lower().split()) for t in (hyp, ref))
        both = [(grams(hyp, n), grams(ref, n)) for n in range(1, 7)]
        both = [(h, r, (h & r).total()) for h, r in both if h and r]
        p, r = (sum(m / x[i].total() for x in both for m in [x[2]]) / len(both) if both else 0 for i in (0, 1))
        want = 500 * p * r / (4 * p + r) if p + r else 0
        assert abs(got[key] - want) < 1e-9, key


@pytest.mark.parametrize("units", [1, 30, 1 << 19])
@pytest.mark.parametrize("words", [False, True])
def test_counts_of_a_batch_by_definition(units, words, monkeypatch):
    """All pairs of a batch at once, in stretches of any size, with empty sides, nulls and letters beyond the first plane."""
    monkeypatch.setattr(mt, "UNITS", units)
    rng = random.Random(units)
    draw = lambda: None if rng.random() < 0.1 else [rng.choice(["a", "b", "é", "𝔘", "ab"]) for _ in range(rng.choice([0, 1, 3, 12, 40]))]
    sides = [(draw(), draw()) for _ in range(60)]
    kind = pa.list_(pa.string()) if words else pa.string()
    made = [pa.array([x if words or x is None else "".join(x) for x in side], kind) for side in zip(*sides)]
    got = mt._counted(made[0].slice(3), made[1].slice(3), 5).to_pylist()
    for (h, r), counts in zip(sides[3:], got):
        h, r = (tuple(x or ()) if words else "".join(x or ()) for x in (h, r))
        assert counts == [{"n": n, "matched": (grams(h, n) & grams(r, n)).total(), "said": max(0, len(h) - n + 1), "wanted": max(0, len(r) - n + 1)} for n in range(1, 6)]
    assert mt._counted(made[0].slice(0, 0), made[1].slice(0, 0), 5).to_pylist() == []


def test_a_pair_too_long_for_one_number(monkeypatch):
    """Ranks and places that do not fit one number are sorted by their places."""
    h, r = pa.array(["ab" * 50, "x"]), pa.array(["ba" * 60, "x"])
    want = mt._counted(h, r, 6).to_pylist()
    monkeypatch.setattr(mt, "_in_order", lambda high, at: (np.sort(high), at[np.argsort(high, kind="stable")]))
    assert mt._counted(h, r, 6).to_pylist() == want


def test_bleu_identity_and_smoothing(spark):
    df = spark.createDataFrame([("a", "The cat, sat on it.", "The cat, sat on it."), ("b", "no", "yes")], "pair_id string, hyp string, ref string")
    assert mt.bleu_corpus(df.filter("pair_id = 'a'")).first().bleu == 100.0
    row = mt.bleu_corpus(spark.createDataFrame([("a", "a b c d e", "a x b y c")], "pair_id string, hyp string, ref string")).first()
    # 3 of 5 words match; higher orders have no match: 1/2, 1/4, 1/8 of a match.
    want = 100 * (3 / 5 * (1 / 8) * (1 / 12) * (1 / 16)) ** 0.25
    assert abs(row.bleu - want) < 1e-6 and row.brevity == 1.0
    assert mt.bleu_corpus(df.filter("pair_id = 'b'")).first().bleu == 0.0


def test_tokens_13a(spark):
    df = spark.createDataFrame([('He said &quot;3.5, no-one&quot; (ok).',)], "t string")
    assert df.select(mt.tokens_13a("t")).first()[0] == ["He", "said", '"', "3.5", ",", "no-one", '"', "(", "ok", ")", "."]


def test_read_jsonl(spark, tmp_path):
    f = tmp_path / "x.jsonl"
    f.write_text('{"a": 1, "t": "x"}\n\n{"a": 2, "error": "late"}\n{"a": 3, "t"\n{"t": "y", "other": 5}\n')
    rows = rd.read_jsonl(spark, str(f), "a long, t string")
    assert sorted((r.a or 0, r.t) for r in rows.collect()) == [(0, "y"), (1, "x")]
    assert rd.read_jsonl(spark, str(f), "a long, t string", keep_bad=True).filter("_corrupt_record IS NOT NULL").count() == 1
    assert rd.read_jsonl(spark, str(tmp_path / "none.jsonl"), "a long").count() == 0


def test_read_labelled_csv(spark, tmp_path):
    f = tmp_path / "x.csv"
    f.write_text('label,SMS\na,"one, ""two""\nlines"\nb,\n')
    assert [(r.text, r.label) for r in rd.read_labelled_csv(spark, str(f)).collect()] == [('one, "two"\nlines', "a")]
    (tmp_path / "y.csv").write_text("first,second\nq,w\n")
    assert rd.read_labelled_csv(spark, str(tmp_path / "y.csv")).first().text == "q"


def test_read_dictionary_and_templates(spark, tmp_path):
    f = tmp_path / "t.json"
    f.write_text('{\n "hi": {"en": "Hello {name}", "lg": "", "lg_verified": false},\n "bye": {"en": "Bye", "lg": "Weeraba", "lg_verified": true}}')
    wide = rd.read_dictionary(spark, str(f), "struct<en:string,lg:string,lg_verified:boolean>", key="template_id")
    dim = rd.template_rows(wide)
    asked = spark.createDataFrame([("hi", "lg"), ("bye", "lg"), ("hi", "en"), ("no", "en")], "template_id string, lang string")
    assert sorted(r.text for r in ct.render_reply(asked, dim).collect()) == ["Hello {name}", "Hello {name}", "Weeraba"]
    assert ct.lint_report(ct.template_lint(wide)).first().asDict() == {
        "templates": 2, "missing_language": 1, "too_long": 0, "other_placeholders": 1, "unverified": 1}
    f.write_text("not json")
    assert rd.read_dictionary(spark, str(f), "struct<en:string>").count() == 0
    assert rd.read_dictionary(spark, str(tmp_path / "no.json"), "struct<en:string>").count() == 0


def test_image_catalog(spark, tmp_path):
    for p in ("Healthy/a.jpg", "set/Leaf Rust/healthy_x/b.PNG", "misc/c.jpg", "phoma/d.jpg:Zone.Identifier", "phoma/e.txt", "phoma/f.webp"):
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b"x")
    got = {r.id.rsplit("/", 1)[-1]: r.label for r in rd.read_image_catalog(spark, str(tmp_path)).collect()}
    assert got == {"a.jpg": "healthy", "b.PNG": "healthy", "c.jpg": None, "f.webp": "phoma"}
    assert rd.drop_unreadable_images(spark, str(tmp_path / "Healthy")).count() == 0


def test_inbound_payloads(spark):
    df = spark.createDataFrame([("0700", None, "hi", "1"), (" ", "+256701", "yo", None), ("0700", None, " ", "2"), (None, None, "x", "3")],
                               "from string, msisdn string, text string, id string")
    assert sorted((r.msg_id, r.phone) for r in inbound_stream(df).collect()) == [("", "+256701"), ("1", "+256700")]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("test", "b", "g", "s1", "t"), ("calib", "a", "g", "s2", "t"), ("test", "a", "g", "s3", "t")],
                               "split string, label string, group string, source_id string, text string")
    sk.write_sorted_corpus(df, str(tmp_path / "sorted"))
    lines = [x for f in sorted((tmp_path / "sorted").glob("part-*")) for x in f.read_text().splitlines()]
    assert [x.split('"source_id":"')[1][:2] for x in lines] == ["s2", "s3", "s1"]
    counts = {(r.split, r.label): r.n for r in sk.write_split_partitioned(df, str(tmp_path / "parts")).collect()}
    assert counts == {("test", "b"): 1, ("calib", "a"): 1, ("test", "a"): 1} and (tmp_path / "parts" / "split=calib").exists()
    batch = spark.createDataFrame([("reply", 1), ("alert", 1), ("muted", 2)], "kind string, id int")
    assert sk.erase_phone(batch.withColumnRenamed("id", "phone"), spark.createDataFrame([(1,)], "phone int")).count() == 1


def test_price_board_and_costs(spark):
    rows = [("m", "A", 1500.0, None, None), ("m", "B", 15500.0, 15000.0, 16000.0), ("n", None, None, None, None)]
    df = spark.createDataFrame(rows, "market string, grade string, price double, low double, high double")
    got = {r.market: r.board for r in ct.price_board(df, "market", F.lit("On 1 May: {body}"), F.lit("none")).collect()}
    assert got == {"m": "On 1 May: B 15,000-16,000; A 1,500", "n": "none"}
    sizes = spark.createDataFrame([(750, 10), (3136, 1568), (20, 20)], "w int, h int")
    assert [r[0] for r in sizes.select(cs.image_tokens(F.col("w"), F.col("h"))).collect()] == [10, 1600, 1]


def test_stages_are_removed_on_request(spark):
    from tideline.session import cut_lineage, drop_stages

    cut_lineage(spark.range(3))
    assert drop_stages(spark) >= 1 and drop_stages(spark) == 0


def test_price_replies_are_filled(spark):
    from tideline.operators import content
    from tideline.plans import load

    got = load()[0]["render_reply"](spark, "/root/testdata/sf0.001").collect()
    assert any(r.template_id == "prices" for r in got) and not [r.text for r in got if "{" in r.text]
    rows = [("prices", "en", "On {date}: {body}"), ("prices", "lg", "Ku {date}: {body}"), ("prices_unavailable", "en", "none"), ("help", "en", "{date}")]
    templates = spark.createDataFrame(rows, "template_id string, lang string, text string")
    board = spark.createDataFrame([("prices", "1 May", "A 5")], "template_id string, date string, body string")
    filled = {(r.template_id, r.lang): r.text for r in content.filled_templates(templates, board).collect()}
    assert filled["prices", "lg"] == "Ku 1 May: A 5" and filled["help", "en"] == "{date}"
    empty = {(r.template_id, r.lang): r.text for r in content.filled_templates(templates, board.limit(0)).collect()}
    assert empty["prices", "en"] == "none"


def test_a_batch_counts_once(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, ""), (3, "c")], "id int, text string")
    reason = F.when(F.col("text") == "", "empty")
    to = sk.good_bad_table(spark, str(tmp_path / "t"), df.schema)
    assert to.read().count() == 0 and to.committed().count() == 0
    assert sk.write_good_bad(df, reason, to, "run 1/0") and not sk.write_good_bad(df, reason, to, "run 1/0")
    assert sk.write_good_bad(df.filter("id < 0"), reason, to, "empty") and sk.write_good_bad(df.filter("id > 2"), reason, to, "run 2/0")
    got = sorted((r.sink, r.id, r.error) for r in sk.good_bad_table(spark, str(tmp_path / "t"), df.schema).read().collect())
    assert got == [("bad", 2, "empty"), ("good", 1, None), ("good", 3, None), ("good", 3, None)]
    assert {r.batch for r in to.committed().collect()} == {"run 1/0", "empty", "run 2/0"}


def test_an_attempt_without_a_name_is_not_seen(spark, tmp_path, monkeypatch):
    """One writer is killed before it takes the name, another loses the name to a faster one while it writes."""
    to = sk.BatchTable(spark, str(tmp_path / "t"), "id int")
    row = lambda n: spark.createDataFrame([(n,)], "id int")
    take = sk.BatchTable._take

    def killed(self, attempt, batch):
        raise RuntimeError("killed")

    monkeypatch.setattr(sk.BatchTable, "_take", killed)
    with pytest.raises(RuntimeError, match="killed"):
        to.commit(row(1), "0")
    assert to.read().count() == 0

    def overtaken(self, attempt, batch):
        monkeypatch.setattr(sk.BatchTable, "_take", take)
        assert self.commit(row(2), batch)
        return take(self, attempt, batch)

    monkeypatch.setattr(sk.BatchTable, "_take", overtaken)
    assert not to.commit(row(3), "0")
    assert [r.id for r in to.read().collect()] == [2]


def test_image_files(spark, tmp_path):
    pages = spark.createDataFrame([(1, "http://a.b/en/1"), (6, "http://a.b/xx/1"), (7, "http://a.b/en/2"), (8, "nothing"), (9, None)], "page_id long, url string")
    path = str(tmp_path / "im ages+%")
    write_images(pages, path)
    report = rd.catalog_report(rd.read_image_catalog(spark, path), rd.drop_unreadable_images(spark, path))
    assert sorted(map(tuple, report.collect())) == [("healthy", 2, 1, 2, 2), ("unlabelled", 3, 3, 3 * 2 + 1 * 3 + 2 * 3, 3)]


def test_images_lie_in_folders_of_one_task(spark, tmp_path):
    """No folder is written by two tasks, so a commit moves folders, and none holds more than 1,024 files."""
    pages = spark.range(2_100).repartition(2).select(F.col("id").alias("page_id"), F.lit("http://a.b/en/1").alias("url"))
    write_images(pages, str(tmp_path / "images"))
    files = [f for f in (tmp_path / "images").rglob("part-*")]
    by_folder, tasks = Counter(f.parent for f in files), defaultdict(set)
    for f in files:
        tasks[f.parent].add(f.name.split("-")[1])
    assert len(files) == 2_100 and max(by_folder.values()) <= 1_024 and all(len(t) == 1 for t in tasks.values())


def test_images_of_a_local_folder_have_no_files_beside_them(spark, tmp_path):
    """Spark's writer sets the mode of a file and of its sum by processes of their own; tasks write the files without. An empty table gives an empty folder."""
    pages = spark.range(40).repartition(3).select(F.col("id").alias("page_id"), F.lit("http://a.b/en/1").alias("url"))
    for k, some in enumerate((pages, pages.limit(0))):
        path = f"file://{tmp_path}/{k}"
        write_images(some, path)
        assert rd.read_image_catalog(spark, path).count() == some.count()
    found = [f.name for f in tmp_path.rglob("*") if f.is_file()]
    assert len(found) == 40 and all(f.startswith("part-") and f.endswith(".png") for f in found)
    with pytest.raises(FileExistsError):
        write_images(pages, f"file://{tmp_path}/0")


def test_a_task_that_runs_again_leaves_one_copy(tmp_path, monkeypatch):
    monkeypatch.setattr(pio.TaskContext, "get", lambda: SimpleNamespace(partitionId=lambda: 3))
    rows = [pa.RecordBatch.from_pylist([{"folder": "Leaf Rust", "shard": i // 2, "bytes": t} for i, t in enumerate(["a", None, "b"])])]
    for _ in range(2):
        assert [b.to_pylist() for b in pio.write_files(iter(rows), str(tmp_path))] == [[{"files": 3}]]
    got = {str(f.relative_to(tmp_path)): f.read_bytes() for f in tmp_path.rglob("*") if f.is_file()}
    assert got == {"folder=Leaf Rust/shard=0/part-00003-00000000.png": b"a\n", "folder=Leaf Rust/shard=0/part-00003-00000001.png": b"\n",
                   "folder=Leaf Rust/shard=1/part-00003-00000002.png": b"b\n"}
    assert [f.name for f in tmp_path.iterdir()] == ["folder=Leaf Rust"]

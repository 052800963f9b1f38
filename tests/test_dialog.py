"""Journeys of single senders, in batch and on a stream in several micro-batches."""

import json

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import dialog as dg
from tideline.plans import stream as ps
from tideline.plans.dialog import CONVERSATION_COLUMNS, conversation, message_columns, messages, pair_verdict
from tideline.streaming.conversation import Conversation, conversation_stream
from tideline.streaming.replay import ordered_stream, run_to_end
from tideline.streaming.inbound import dedup_inbound, file_stream

DAY, START = 86400, 1_700_006_400  # a midnight in UTC
SCHEMA = ("id long, phone long, at long, epoch long, kw string, price boolean, digit string, lang_event string, price_en boolean, "
          "label string, decision string, template_id string, "
          "opinion struct<label:string,proba:double,llm_label:string,llm_sure:boolean,price_en:boolean>")
KINDS = {  # text -> kw, price, digit, language, label, probability, price in English
    "stop": ("STOP", False, None, None, "other", 0.1, False), "start": ("START", False, None, None, "other", 0.1, False),
    "price": ("PRICE", False, None, None, "other", 0.1, False), "help": ("HELP", False, None, None, "other", 0.1, False),
    "clear": (None, False, None, "en", "phoma", 0.9, False), "vague": (None, False, None, "lg", "phoma", 0.3, False),
    "strange": (None, False, None, None, "other", 0.9, False), "sale": (None, False, None, None, "other", 0.2, True),
    "howmuch": (None, True, None, None, "other", 0.2, False), "erase": ("ERASE", False, None, None, "other", 0.1, False),
    "1": (None, False, "1", None, "other", 0.1, False), "3": (None, False, "3", None, "other", 0.1, False),
}


def log(*texts, phone=1, first_id=1):
    """Messages of one sender: (seconds after START, text)."""
    out = []
    for i, (after, text) in enumerate(texts):
        kw, price, digit, lang, label, proba, price_en = KINDS[text]
        if label == "other":
            decision = "escalate" if proba >= 0.8 else "clarify"
        else:
            decision = "answer" if proba >= 0.8 else "clarify"
        template = {"answer": f"adv_{label}", "escalate": "unsure", "clarify": "clarify"}[decision]
        out.append((first_id + i, phone, (START + after) * 1_000_000, START + after, kw, price, digit, lang, price_en, label, decision, template,
                    (label, proba, None, None, price_en)))
    return out


def actions(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    got = dg.conversation(df, pair_verdict).orderBy("id").collect()
    return [r.action for r in got], got


@pytest.mark.parametrize("texts,want", [
    ([(0, "vague"), (5, "clear")], ["clarify", "answer"]),
    ([(0, "vague"), (5, "vague"), (9, "vague")], ["clarify", "escalate", "clarify"]),
    ([(0, "vague"), (5, "price"), (6, "help"), (9, "clear")], ["clarify", "prices", "help", "answer"]),
    ([(0, "vague"), (5, "stop"), (6, "clear"), (7, "start"), (9, "vague")], ["clarify", "stop_ack", "muted", "start_ack", "clarify"]),
    ([(0, "clear"), (4 * DAY, "3")], ["answer", "followup_worse"]),
    ([(0, "clear"), (4 * DAY, "1"), (4 * DAY + 1, "1")], ["answer", "followup_ok", "clarify"]),
    ([(0, "clear"), (4 * DAY, "vague"), (4 * DAY + 9, "clear")], ["answer", "clarify", "answer"]),
    ([(0, "clear"), (DAY, "stop"), (DAY + 1, "start"), (4 * DAY, "1")], ["answer", "stop_ack", "start_ack", "clarify"]),
    ([(0, "clear"), (DAY, "vague"), (4 * DAY, "1")], ["answer", "clarify", "followup_ok"]),
    ([(0, "clear"), (DAY, "1")], ["answer", "clarify"]),
    ([(0, "sale"), (5, "howmuch"), (6, "strange")], ["prices", "prices", "escalate"]),
])
def test_journeys(spark, texts, want):
    assert actions(spark, log(*texts))[0] == want


def test_welcome_language_and_isolation(spark):
    rows = log((0, "start"), (1, "vague"), (2, "help"), phone=1) + log((0, "stop"), (1, "clear"), (2, "start"), (3, "clear"), phone=2, first_id=10)
    _, got = actions(spark, rows)
    assert [r.id for r in got if r.welcome] == [2, 13]
    assert [r.lang for r in got if r.phone == 1] == ["en", "lg", "lg"]
    assert [r.alert for r in got if r.phone == 1] == [False, False, True]


def stream_rows(spark, tmp_path, batches):
    """Each list of messages becomes one file and one micro-batch."""
    folder = str(tmp_path / "in")
    for i, rows in enumerate(batches):
        df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("epoch"))
        df.coalesce(1).write.mode("append").parquet(folder)
    src = file_stream(spark, folder, spark.read.parquet(folder).schema, max_files=1).withWatermark("ts", "1 minute")
    return spark.read.parquet(ps.run_to_end(spark, conversation_stream(src)))


def test_stream_keeps_state_between_batches_and_fires_once(spark, tmp_path):
    batches = [log((0, "vague")), log((60, "clear"), first_id=2), log((5 * DAY, "help"), phone=2, first_id=3), log((6 * DAY, "3"), first_id=4),
               log((7 * DAY, "price"), phone=2, first_id=5)]
    got = stream_rows(spark, tmp_path, batches).collect()
    assert {(r.id, r.action) for r in got if r.kind == "reply"} == {(1, "clarify"), (2, "answer"), (3, "help"), (4, "followup_worse"), (5, "prices")}
    assert [(r.phone, r.template_id) for r in got if r.kind == "followup"] == [(1, "followup_q")]
    assert sorted(r.action for r in got if r.kind == "alert") == ["followup_worse", "help"]


def test_stop_and_erase_cancel_timers(spark, tmp_path):
    batches = [log((0, "clear")) + log((0, "clear"), phone=2, first_id=10), log((60, "stop"), first_id=2) + log((60, "erase"), phone=2, first_id=11),
               log((5 * DAY, "clear"), phone=2, first_id=12), log((6 * DAY, "help"), phone=3, first_id=20)]
    got = stream_rows(spark, tmp_path, batches).collect()
    assert not [r for r in got if r.kind == "followup"]
    assert [r.welcome for r in got if r.id == 12] == [True]  # erased: a new sender again


def test_replay_of_interleaved_files_equals_the_batch_fold(spark, tmp_path, monkeypatch):
    sf, folder = "/root/testdata/sf0.001", str(tmp_path / "ev")
    events = spark.read.parquet(f"{sf}/events.parquet")
    for part in range(4):  # each file spans the whole time
        events.filter(F.col("event_id") % 4 == part).coalesce(1).write.mode("append").parquet(folder)
    msgs = message_columns(spark.read.parquet(folder))
    want = sorted(map(str, conversation(spark, sf).collect()))
    for rows in (250, 10_000):
        got = spark.read.parquet(ps.replay(spark, msgs, rows=rows))
        assert sorted(map(str, got.filter("kind IN ('reply', 'muted')").select(*CONVERSATION_COLUMNS).collect())) == want


def test_late_rows_are_not_dropped_in_silence(spark, tmp_path):
    with pytest.raises(RuntimeError, match="later than the watermark"):
        folder = str(tmp_path / "in")
        progress, path = str(tmp_path / "p"), str(tmp_path / "o")
        for rows in (log((5 * DAY, "help")), log((0, "clear"), first_id=2), log((6 * DAY, "help"), first_id=3)):
            df = spark.createDataFrame(rows, SCHEMA).withColumn("ts", F.timestamp_seconds("epoch"))
            df.coalesce(1).write.mode("append").parquet(folder)
            src = file_stream(spark, folder, df.schema, max_files=1).withWatermark("ts", "1 minute")
            ps.run_to_end(spark, conversation_stream(src), path=path, progress=progress)


def test_cuts_change_nothing(spark):
    """Messages of all days pushed into two hours and a third of them under one sender, cut every 40 rows or not at all."""
    msgs = messages(spark, "/root/testdata/sf0.001")
    busy = msgs.withColumn("phone", F.when(F.col("id") % 3 == 0, F.lit(1).cast(msgs.schema["phone"].dataType)).otherwise(F.col("phone"))) \
        .withColumn("epoch", F.lit(START) + F.floor((F.col("epoch") - START) % 7000)).withColumn("at", F.col("epoch") * 1_000_000)
    for df in (msgs, busy):
        a, b = (dg.conversation(df, pair_verdict, cut_rows=n).select(*CONVERSATION_COLUMNS) for n in (1 << 16, 40))
        assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_followups_skip_stops_and_the_future(spark):
    msgs = messages(spark, "/root/testdata/sf0.001")
    jobs = spark.createDataFrame([(1, 10, 1, 100), (1, 50_000_000, 2, 100), (2, 10, 3, 100), (3, 10, 4, 900)], "phone long, at long, id long, due long")
    stops = spark.createDataFrame([(1, 20, 9), (2, 100_000_000, 8)], "phone long, at long, id long")
    assert {r.id for r in dg.due_followups(jobs, stops, as_of=500).collect()} == {2, 3}
    assert msgs.filter("kw = 'STOP'").count() > 0


def test_dedup_keeps_blank_ids(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [("a", 1), ("a", 2), ("", 3), ("", 4), ("b", 5)]
    df = spark.createDataFrame(rows, "msg_id string, n int").withColumn("ts", F.timestamp_seconds(F.lit(START)))
    for _ in range(2):
        df.coalesce(1).write.mode("append").parquet(folder)
    for horizon in (None, "1 day"):
        src = file_stream(spark, folder, df.schema, max_files=1)
        out = spark.read.parquet(ps.run_to_end(spark, dedup_inbound(src, horizon=horizon)))
        assert sorted(r.msg_id for r in out.collect()) == ["", "", "", "", "a", "b"]


def test_alert_text(spark):
    df = spark.createDataFrame([("+1", "asked", "nfuufu", "dust", "other", 0.456, ""), ("+2", "", "hi", None, None, None, None)],
                               "p string, n string, o string, e string, l string, pr double, r string")
    got = [r[0] for r in df.select(dg.alert_text(*[F.col(c) for c in ("p", "n", "o", "e", "l", "pr", "r")])).collect()]
    assert got[0].split("\n") == ["+1 needs a human.", "asked", "Said: nfuufu", "English: dust", "Proposed: other (p=0.46)"]
    assert got[1].split("\n") == ["+2 needs a human.", "Said: hi"]


def test_batches_of_a_replay_follow_the_order(spark, tmp_path):
    """One query; each batch is a range of its own behind the one before, and the closing rows come last."""
    rows = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("at"))
    seen = []
    stream = ordered_stream(spark, rows, "at", rows=100, last=spark.createDataFrame([(5,)], "at long"))
    run_to_end(spark, stream, lambda df, n, path: seen.append(tuple(df.agg(F.min("at"), F.max("at"), F.count("at")).first())))
    assert seen[-1] == (5, 5, 1) and sum(n for _, _, n in seen) == 1001 and len(seen) > 8
    assert all(a[1] < b[0] for a, b in zip(seen[:-2], seen[1:-1], strict=True)) and max(n for _, _, n in seen) < 200


def test_replay_of_nothing(spark):
    assert spark.read.parquet(ps.replay(spark, messages(spark, "/root/testdata/sf0.001").limit(0))).count() == 0


class State:
    """The state of one group of senders, as the stream hands it over."""

    def __init__(self):
        self.get, self.exists, self.hasTimedOut, self.until, self.watermark = None, False, False, None, 0

    def getCurrentWatermarkMs(self):
        return self.watermark

    def update(self, value):
        self.get, self.exists = value, True

    def setTimeoutTimestamp(self, ms):
        self.until = ms

    def remove(self):
        self.get, self.exists = None, False


def test_senders_of_one_group_keep_their_own_state():
    """Many senders share a group, its state and its timer; each is answered, muted, followed up and erased alone."""
    said = {"label": "phoma", "proba": 0.9, "llm_label": None, "llm_sure": None, "price_en": False}

    def message(at, phone, kw=None):
        return json.dumps({"id": at * 100 + (phone or 0), "phone": phone, "at": at, "epoch": at, "kw": kw, "label": "phoma", "decision": "answer", "template_id": "adv_phoma", "opinion": said})

    def run(messages, watermark=0):
        state.watermark, state.hasTimedOut = watermark * 1000, not messages
        out = [r for pdf in talk((0,), iter([pd.DataFrame({"message": messages})]), state) for r in pdf.itertuples()]
        return sorted((r.phone or 0, r.kind, r.action, r.welcome) for r in out)

    talk, state = Conversation(), State()
    assert run([message(2, 3, "STOP"), message(1, 2), message(1, 1), message(0, 3), message(0, None), message(9, None, "TICK")]) == [
        (0, "reply", "answer", True), (1, "reply", "answer", True), (2, "reply", "answer", True), (3, "reply", "answer", True), (3, "reply", "stop_ack", False)]
    due = state.until // 1000
    assert run([message(5, 2, "ERASE"), message(6, 3), message(7, 1)]) == [(1, "reply", "answer", False), (3, "muted", "muted", False)]
    assert run([], due) == [(0, "followup", "followup_q", False), (1, "followup", "followup_q", False), (1, "followup", "followup_q", False)]
    assert run([message(due + 1, 2), message(due + 2, 3, "START")], due) == [(2, "reply", "answer", True), (3, "reply", "start_ack", False)]

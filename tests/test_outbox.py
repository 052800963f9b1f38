"""The keyed outbox: nothing goes out twice, whatever is run again."""

import collections

import pytest
from pyspark.sql import functions as F
from test_dialog import DAY, SCHEMA, log

from tideline.plans import stream as ps
from tideline.streaming.conversation import OUTPUT
from tideline.streaming.outbox import Outbox, outbound, sending

TEMPLATES = [(t, lang, f"{t} in {lang}") for t in ("help", "welcome", "followup_q", "adv_phoma", "unsure", "agent_requested", "stop_ack", "prices", "clarify_phoma") for lang in ("en", "lg")]


@pytest.fixture(scope="module")
def templates(spark):
    return spark.createDataFrame(TEMPLATES, "template_id string, lang string, text string")


def batch(spark, ids, day=10):
    return spark.createDataFrame([("reply", i, f"reply:{i}", f"text {i}", day) for i in ids] + [("welcome", 1, "welcome:1", "hello", day)],
                                 "kind string, phone long, key string, text string, day long")


def keys(df):
    return collections.Counter(r.key for r in df.collect())


def test_repeated_rows_go_out_once(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    box.put(batch(spark, [1, 2, 2]))
    box.put(batch(spark, [2, 3]))
    Outbox(spark, str(tmp_path / "box")).put(batch(spark, [1, 3, 4]))  # started anew, without a memory of its own
    assert keys(box.sent()) == {"reply:1": 1, "reply:2": 1, "reply:3": 1, "reply:4": 1, "welcome:1": 1}
    assert box.in_doubt().count() == 0
    box.put(batch(spark, []).limit(0))
    assert box.sent().count() == 5


def test_a_batch_killed_after_its_claim_sends_nothing_twice(spark, tmp_path):
    """The gateway fails with half of the rows handed over; the batch is run again."""
    handed = []

    def gateway(df, fail=False):
        rows = [r.key for r in df.orderBy("key").collect()]
        handed.extend(rows[:1] if fail else rows)
        if fail:
            raise RuntimeError("lost the connection")

    path = str(tmp_path / "box")
    with pytest.raises(RuntimeError):
        Outbox(spark, path, lambda df: gateway(df, True)).put(batch(spark, [1, 2]))
    box = Outbox(spark, path, gateway)
    box.put(batch(spark, [1, 2]))
    box.put(batch(spark, [1, 2, 3]))
    assert handed == ["reply:1", "reply:3"]
    assert keys(box.in_doubt()) == {"reply:1": 1, "reply:2": 1, "welcome:1": 1} and keys(box.sent()) == {"reply:3": 1}


def test_a_log_is_finished_from_its_claims(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "box")
    with monkeypatch.context() as m:
        m.setattr(Outbox, "_log", lambda self, attempt: (_ for _ in ()).throw(KeyboardInterrupt))
        with pytest.raises(KeyboardInterrupt):
            Outbox(spark, path).put(batch(spark, [1, 2]))
    box = Outbox(spark, path)
    box.put(batch(spark, [1, 2]))
    assert keys(box.sent()) == {"reply:1": 1, "reply:2": 1, "welcome:1": 1}


def test_a_claim_that_was_not_completed_counts_for_nothing(spark, tmp_path):
    path = tmp_path / "box"
    box = Outbox(spark, str(path))
    name = box.claim(batch(spark, [1]))
    (path / "claims" / name / "_SUCCESS").unlink()  # as a writer leaves it that is killed before its commit
    box.put(batch(spark, [1]))
    assert keys(box.sent()) == {"reply:1": 1, "welcome:1": 1} and box.in_doubt().count() == 0


def test_keys_of_other_days_do_not_meet(spark, tmp_path):
    box = Outbox(spark, str(tmp_path / "box"))
    box.put(batch(spark, [1], day=10))
    box.put(batch(spark, [2], day=900))
    box.put(batch(spark, [1], day=10))
    assert keys(box.sent()) == {"reply:1": 1, "reply:2": 1, "welcome:1": 2}  # the key of another day is another message's


def test_texts_of_all_kinds(spark, templates):
    rows = [dict(kind="reply", id=1, action="help", template_id="help", lang="lg", welcome=True, epoch=DAY),
            dict(kind="followup", id=None, action="followup", template_id="followup_q", lang="en", due=3 * DAY, epoch=3 * DAY), dict(kind="muted", id=2, action="muted", epoch=DAY),
            dict(kind="alert", id=1, action="help", said="help me", epoch=DAY),
            dict(kind="alert", id=3, action="escalate", label="phoma", said="bulwadde", english="disease", proba=0.5, reason="no second opinion", epoch=DAY)]
    names = [f.split()[0] for f in OUTPUT.split(", ")]
    got = {r.key: (r.phone, r.day, r.text) for r in outbound(spark.createDataFrame([tuple({"phone": 7, **r}.get(n) for n in names) for r in rows], OUTPUT), templates).collect()}
    assert got == {"reply:1": (7, 1, "help in lg"), "welcome:1": (7, 1, "welcome in lg"), f"followup:7:{3 * DAY}": (7, 3, "followup_q in en"),
                   "alert:1": (7, 1, "7 needs a human.\nasked for HELP\nSaid: help me"),
                   "alert:3": (7, 1, "7 needs a human.\nSaid: bulwadde\nEnglish: disease\nProposed: phoma (p=0.50)\nWhy: no second opinion")}


def test_a_stream_that_starts_over_sends_nothing_twice(spark, templates, tmp_path):
    """The same log is replayed into one outbox by two queries; the second has neither checkpoint nor state of the first."""
    msgs = spark.createDataFrame(log((0, "help"), (60, "clear"), (120, "clear"), (5 * DAY, "help"), phone=1) + log((30, "clear"), (6 * DAY, "help"), phone=2, first_id=50), SCHEMA)
    box = Outbox(spark, str(tmp_path / "box"))
    for _ in range(2):
        ps.replay(spark, msgs, lambda df, n, p: box.put(outbound(df, templates)), rows=3)
    sent = box.sent()
    assert max(keys(sent).values()) == 1
    assert {r["kind"]: r["count"] for r in sent.groupBy("kind").count().collect()} == {"reply": 6, "welcome": 2, "followup": 2, "alert": 3}
    assert sent.filter(F.col("text").isNull() | (F.col("text") == "")).count() == 0


def test_a_batch_is_computed_once(spark, templates, tmp_path):
    """What the outbox reads of a batch is stored before; every other use would run the conversations of the batch again."""
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    names = [f.split()[0] for f in OUTPUT.split(", ")]
    rows = [dict(kind="reply", id=1, phone=7, action="help", template_id="help", lang="en", welcome=True, epoch=DAY), dict(kind="alert", id=1, phone=7, action="help", said="x", epoch=DAY)]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], OUTPUT).mapInArrow(counted, OUTPUT)
    box = Outbox(spark, str(tmp_path / "box"))
    sending(box, templates)(df, 0, "")
    assert seen.value == 2 and keys(box.sent()) == {"reply:1": 1, "welcome:1": 1, "alert:1": 1}

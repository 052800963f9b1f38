"""Conversation state per sender on a stream, with follow-up timers.

Senders are dealt into ``BUCKETS`` groups, and a group is handled by one task at a time: what Spark does for every group and batch
then does not grow with the senders, and rows and state travel in Arrow batches. The state holds, for each sender of a group, the
flags, what is pending and the open follow-ups, and for each time that follow-ups are due the senders they go to; a batch
decodes the senders it has rows of. A micro-batch, whose size the source bounds, is put in arrival order before it is applied.
"""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupStateTimeout

from tideline.dims import fixed
from tideline.functions.decision import OTHER, THRESHOLD

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTPUT = ("phone long, id long, kind string, action string, label string, decision string, template_id string, "
          "original_id long, lang string, welcome boolean, alert boolean, due long, epoch long, said string, english string, proba double, reason string")
COLUMNS = [c.split()[0] for c in OUTPUT.split(", ")]
BUCKETS = 4096
STATE = "conversations map<string,string>, due map<long,array<string>>"  # a sender's part is JSON
FACTS = ("said", "english", "reason")  # what an alert tells of the message, where the input has it
REQUIRED = ("id", "phone", "at", "epoch", "kw", "price", "digit", "lang_event", "price_en", "label", "decision", "template_id", "opinion")


class Message(NamedTuple):
    id: int | None = None
    phone: int | None = None
    at: int | None = None
    epoch: int | None = None
    kw: str | None = None
    price: bool | None = None
    digit: str | None = None
    lang_event: str | None = None
    price_en: bool | None = None
    label: str | None = None
    decision: str | None = None
    template_id: str | None = None
    opinion: dict | None = None
    said: str | None = None
    english: str | None = None
    reason: str | None = None


class Opinion(NamedTuple):
    label: str
    proba: float
    llm_label: str | None
    llm_sure: bool | None
    price_en: bool


class Verdict(NamedTuple):
    label: str
    decision: str
    template_id: str
    price_en: bool


def packed(columns: list[str]) -> Column:
    """The message as JSON. Spark hands rows to Python value by value, so one string costs far less than sixteen values."""
    return F.to_json(F.struct(*[c for c in Message._fields if c in columns]))


def opinion_of(given: dict) -> Opinion:
    known = {c: given.get(c) for c in Opinion._fields}
    return Opinion(**known)._replace(proba=None if known["proba"] is None else float(known["proba"]))  # JSON has NaN as a word


def reply_verdict(earlier: Opinion, reply: Opinion) -> Verdict:
    """Verdict on a report and the reply to our question: never another question.

    Takes the reply's labels and the better probability.
    """
    proba = max(earlier.proba, reply.proba)
    agreed = reply.llm_label in (None, reply.label)
    answer = reply.label != OTHER and proba >= THRESHOLD and agreed
    return Verdict(reply.label, "answer" if answer else "escalate", f"adv_{reply.label}" if answer else "unsure",
                   earlier.price_en or reply.price_en)


class Conversation:
    def __init__(self, pair: Callable[[Opinion, Opinion], Verdict] = reply_verdict, start_lang: str = "en", live: bool = False):
        self.pair, self.start_lang, self.live = pair, start_lang, live

    def _new(self) -> dict:
        return dict(stopped=False, welcomed=False, lang=self.start_lang, pending="", asked_id=None, asked=None, open=[])

    def _load(self, kept: str | None) -> dict:
        if kept is None:
            return self._new()
        s = json.loads(kept)
        return s | {"asked": Opinion(*s["asked"]) if s["asked"] is not None else None}

    def _fire(self, s: dict, phone, until: int):
        """Open follow-ups due by ``until``: each is sent once and leaves the state."""
        for due in sorted(d for d in s["open"] if d <= until):
            s["open"].remove(due)
            s.update(pending="followup", asked_id=None, asked=None)
            yield self._row(phone, None, "followup", "followup_q", s, template="followup_q", due=due, epoch=due)

    @staticmethod
    def _row(phone, row_id, kind, action, s, label=None, decision=None, template=None, original=None, welcome=False, alert=False, due=None, epoch=None,
             said=None, english=None, proba=None, reason=None):
        return phone, row_id, kind, action, label, decision, template, original, s["lang"], welcome, alert, due, epoch, said, english, proba, reason

    def __call__(self, key, batches, state):
        """The output of one batch for a group of senders: its rows in order, then the follow-ups that are due."""
        known, due = state.get if state.exists else ({}, {})
        known, due = dict(known), {at: set(names) for at, names in due.items()}
        rows = [] if state.hasTimedOut else [Message(**json.loads(m)) for b in batches for m in b["message"]]
        out = list(self._rows(rows, known, due))
        now = state.getCurrentProcessingTimeMs() if self.live else state.getCurrentWatermarkMs()
        for at in sorted(at for at in due if at * 1000 <= now):
            for name in sorted(due.pop(at)):
                s = self._load(known.get(name))
                fired = list(self._fire(s, int(name) if name else None, at))
                if fired:
                    known[name] = json.dumps(s)
                    out.extend(fired)
        if known:
            state.update((known, {at: sorted(names) for at, names in due.items()}))
            if due and self.live:
                state.setTimeoutDuration(max(1, min(due) * 1000 - now))
            elif due:
                state.setTimeoutTimestamp(min(due) * 1000)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=COLUMNS, dtype=object)

    def _rows(self, rows: list[Message], known: dict[str, str], due: dict[int, set[str]]):
        """Applies the rows to what is ``known`` of their senders, and notes when follow-ups are ``due``."""
        name_of = lambda r: "" if r.phone is None else str(r.phone)  # noqa: E731  (no sender is a sender of its own)
        rows = [r for r in rows if r.kw != "TICK"]  # a row that only moves time on
        rows.sort(key=lambda r: (name_of(r), r.at, r.id))
        for name, mine in itertools.groupby(rows, key=name_of):
            s = self._load(known.get(name))
            for r in mine:
                if r.kw == "ERASE":
                    known.pop(name, None)
                    s = self._new()
                    continue
                yield from self._fire(s, r.phone, r.epoch)
                yield from self._message(s, r.phone, r)
            if name in known or s != self._new():
                known[name] = json.dumps(s)
            for at in s["open"]:
                due.setdefault(at, set()).add(name)

    def _message(self, s, phone, r):
        s["lang"] = r.lang_event or s["lang"]
        if r.kw in ("STOP", "START"):
            s["stopped"] = r.kw == "STOP"
            action = "stop_ack" if s["stopped"] else "start_ack"
            if s["stopped"]:
                s.update(pending="", asked_id=None, asked=None, open=[])
            yield self._row(phone, r.id, "reply", action, s, template=action, epoch=r.epoch)
            return
        if s["stopped"]:
            yield self._row(phone, r.id, "muted", "muted", s, epoch=r.epoch)
            return
        welcome, s["welcomed"] = not s["welcomed"], True
        quick = {"PRICE": "prices", "HELP": "help", "AGENT": "agent_requested"}.get(r.kw) or ("prices" if r.price else None)
        if quick is None and s["pending"] == "followup":
            s["pending"] = ""
            if r.digit is not None:
                quick = "followup_worse" if fixed.FOLLOWUP_ANSWERS[r.digit] == "worse" else "followup_ok"
        if quick:
            yield from self._emit(phone, r, quick, s, template=quick, welcome=welcome)
            return
        mine, original = opinion_of(r.opinion), None
        proba = mine.proba
        if s["pending"] == "clarify":
            v, original, proba = self.pair(s["asked"], mine), s["asked_id"], max(s["asked"].proba, mine.proba)
            s.update(pending="", asked_id=None, asked=None)
        else:
            v = Verdict(r.label, r.decision, r.template_id, r.price_en)
        due = None
        if v.label == OTHER and v.price_en:
            action = template = "prices"
        else:
            action, template = v.decision, v.template_id
            if action == "clarify":
                s.update(pending="clarify", asked_id=r.id, asked=mine)
            elif action == "answer" and v.label in fixed.FOLLOWED_UP:
                due = self._schedule(s, r.epoch)
        yield from self._emit(phone, r, action, s, v.label, v.decision, template, original, welcome, due, proba)

    def _schedule(self, s, epoch):
        due = (epoch + 3 * 86400 + 3 * 3600) // 86400 * 86400 + 15 * 3600
        s["open"].append(due)
        return due

    def _emit(self, phone, r, action, s, label=None, decision=None, template=None, original=None, welcome=False, due=None, proba=None):
        """The reply, and the alert if a human is needed."""
        alert = action in ("help", "agent_requested", "followup_worse", "escalate")
        yield self._row(phone, r.id, "reply", action, s, label, decision, template, original, welcome, alert, due, r.epoch)
        if alert:
            facts = {c: getattr(r, c) for c in FACTS if c == "said" or label is not None}
            yield self._row(phone, r.id, "alert", action, s, label, decision, template, original, alert=True, epoch=r.epoch, proba=proba, **facts)


def conversation_stream(msgs: DataFrame, pair: Callable[[Opinion, Opinion], Verdict] = reply_verdict, live: bool = False) -> DataFrame:
    """Replies, alerts, muted messages and follow-ups of a message stream, one row each.

    ``live`` fires follow-ups by the clock; otherwise by the watermark of ``ts``, which a replay needs.
    """
    rest = [c for c in msgs.columns if c not in Message._fields]  # the event time among them
    rows = msgs.select(F.pmod(F.xxhash64("phone"), F.lit(BUCKETS)).alias("bucket"), *rest, packed(msgs.columns).alias("message"))
    timeout = GroupStateTimeout.ProcessingTimeTimeout if live else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("bucket").applyInPandasWithState(Conversation(pair, live=live), OUTPUT, STATE, "append", timeout)


def alerts(out: DataFrame) -> DataFrame:
    """What goes to a human."""
    return out.filter(F.col("kind") == "alert")

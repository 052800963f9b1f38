"""Conversation state per sender, over a stored message log.

Messages carry: ``id``, ``phone``, ``at`` (microseconds, with ``id`` the arrival order), ``epoch``
(seconds), ``kw`` (STOP, START, PRICE, HELP, AGENT or null), ``price`` (free-text price question),
``digit`` (the text is a follow-up answer 1, 2 or 3, else null), ``lang_event`` (language the
message decides, or null), ``label``, ``decision``, ``template_id`` (verdict on the message
alone) and ``price_en`` (its English asks for prices).

A sender may have written a third of all messages, so nothing here keeps a sender in one task.
"Last value before" is a scan over cuts of like size. What a message means depends on what is pending, and that
has three states only (nothing, a question, a follow-up), so each piece of a sender's messages (an hour, or the part of it in
one cut) is summarised as a function of the state it starts in; the few summaries of a sender are folded in order, which
gives each piece its starting state; the rows of a piece then need only that.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.functions.clock import followup_due_epoch
from tideline.functions.decision import OTHER
from tideline.operators.scan import CHUNK_ROWS, cut, running
from tideline.session import cut_lineage

ORDER = ["at", "id"]
HOUR = 3600
NOTHING, QUESTION, FOLLOWUP = 0, 1, 2


def hour_of(epoch="epoch") -> Column:
    return F.floor(F.col(epoch) / HOUR)


def mute_flag() -> Column:
    return F.when(F.col("kw") == "STOP", True).when(F.col("kw") == "START", False)


def is_plain() -> Column:
    """No control word: STOP is always acknowledged and START always lifts it, so neither is ever muted."""
    return ~F.coalesce(F.col("kw").isin("STOP", "START"), F.lit(False))


def mute_state(msgs: DataFrame) -> DataFrame:
    """Adds ``muted``: the sender is stopped and this message gets no reply."""
    out = running(msgs, ["phone"], ORDER, lasts={"_stopped": mute_flag()})
    return out.withColumn("muted", F.coalesce("_stopped", F.lit(False)) & is_plain()).drop("_stopped")


def first_contact(msgs: DataFrame) -> DataFrame:
    """(phone, at, id) of the message that is welcomed: the first one that is no control word and not muted."""
    first = msgs.filter(is_plain() & ~F.col("muted")).groupBy("phone").agg(F.min(F.struct(*ORDER)).alias("f"))
    return first.select("phone", "f.*")


def language_state(msgs: DataFrame, start: str = "en") -> DataFrame:
    """Adds ``lang``: the last decided language up to and including the message, muted or not."""
    out = running(msgs, ["phone"], ORDER, lasts={"_lang": F.col("lang_event")})
    return out.withColumn("lang", F.coalesce("lang_event", "_lang", F.lit(start))).drop("_lang")


def due_followups(jobs: DataFrame, stops: DataFrame, as_of: int | None = None) -> DataFrame:
    """Jobs (phone, at, id, due) that fire: due by ``as_of`` and no STOP from their message until then.

    The next STOP of each job comes from one backward scan, so jobs and stops of a busy sender
    are never paired with each other.
    """
    rows = (jobs.select("phone", "at", "id", "due", F.lit(None).cast("long").alias("stop_at"))
            .unionByName(stops.select("phone", "at", "id", F.lit(None).cast("long").alias("due"), F.col("at").alias("stop_at")))
            .select("*", (-F.col("at")).alias("_back"), (-F.col("id")).alias("_backid")))
    nxt = running(rows, ["phone"], ["_back", "_backid"], lasts={"next_stop": F.col("stop_at")})
    fired = nxt.filter(F.col("due").isNotNull() & (F.col("next_stop").isNull() | (F.col("next_stop") >= F.col("due") * 1_000_000)))
    if as_of is not None:
        fired = fired.filter(F.col("due") <= as_of)
    return fired.select("phone", "at", "id", "due")


def _by_state(state: Column, digit: Column, nothing: Column, question: Column, answered: Column) -> Column:
    """What a report row does in each pending state; a follow-up that is not 1, 2 or 3 is a fresh report."""
    return (F.when(state == QUESTION, question).when((state == FOLLOWUP) & digit, answered).otherwise(nothing))


def conversation(msgs: DataFrame, pair: Callable[[Column], Column], start: str = "en", cut_rows: int = CHUNK_ROWS) -> DataFrame:
    """One row per message: what was done about it.

    ``pair`` maps the struct of the earlier message (``label proba llm_label llm_sure price_en``
    and whatever else ``msgs`` holds under ``opinion``) to the verdict on both together, a struct of
    label, decision, template_id and price_en. A question is always about the report just before,
    since any report in between would have used it up, so that verdict can be formed for every
    report before it is known which ones answer a question.

    A piece is an hour of a sender, since follow-ups fall due on full hours and none falls inside one, cut further where
    the hour holds more than ``cut_rows`` messages.
    """
    # Each scan reads its input twice, for the chunk totals and for the rows, so what one scan
    # yields is stored before the next one starts. Both go by the same cuts.
    msgs = cut(msgs, ["phone"], ORDER, cut_rows)
    known = running(msgs, ["phone"], ORDER, lasts={"_stopped": mute_flag(), "_lang": F.col("lang_event")}, rows=cut_rows)
    known = known.withColumn("muted", F.coalesce("_stopped", F.lit(False)) & is_plain())
    known = cut_lineage(known.withColumn("lang", F.coalesce("lang_event", "_lang", F.lit(start))).drop("_stopped", "_lang"))
    report = F.col("kw").isNull() & ~F.col("price") & ~F.col("muted")
    met = is_plain() & ~F.col("muted")
    known = running(known.withColumn("_report", report), ["phone"], ORDER, sums={"_met": met.cast("long")}, lasts={
        "_prev": F.when(F.col("_report"), F.struct(F.col("id").alias("id"), F.col("opinion").alias("opinion")))}, rows=cut_rows)
    known = known.withColumn("welcome", met & (F.col("_met") == 0))
    solo_asks = (F.col("decision") == "clarify") & ~((F.col("label") == OTHER) & F.col("price_en"))
    job = lambda label, decision: (decision == "answer") & label.isin(*fixed.FOLLOWED_UP)
    rows = (known.withColumn("_pair", pair(F.col("_prev.opinion"))).withColumn("_piece", F.struct(hour_of().alias("hour"), F.col("_chunk").alias("cut")))
            .withColumn("_stop", F.coalesce(F.col("kw") == "STOP", F.lit(False)))
            .withColumn("_asks", F.col("_report") & solo_asks).withColumn("_digit", F.col("digit").isNotNull())
            .withColumn("_due", followup_due_epoch("epoch")))
    for name, cond in (("_job_solo", job(F.col("label"), F.col("decision"))), ("_job_pair", job(F.col("_pair.label"), F.col("_pair.decision")))):
        rows = rows.withColumn(name, F.coalesce(F.col("_report") & cond, F.lit(False)))

    # Runs of asking reports alternate between question and answer; any other report or a STOP ends a run.
    span = Window.partitionBy("phone", "_piece").orderBy(*ORDER)
    before = span.rowsBetween(Window.unboundedPreceding, -1)
    ends = F.col("_stop") | (F.col("_report") & ~F.col("_asks"))
    rows = (rows.withColumn("_run", F.coalesce(F.sum(ends.cast("int")).over(before), F.lit(0)))
            .withColumn("_stops", F.coalesce(F.sum(F.col("_stop").cast("int")).over(before), F.lit(0))))
    in_run = Window.partitionBy("phone", "_piece", "_run").orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, -1)
    rows = (rows.withColumn("_q", F.coalesce(F.sum(F.col("_asks").cast("int")).over(in_run), F.lit(0)))
            .withColumn("_lead_digit", F.coalesce(F.first(F.when(F.col("_asks"), F.col("_digit")), ignorenulls=True).over(in_run), F.lit(False))))
    rows = cut_lineage(rows)

    def state_of(start: Column) -> Column:
        """Pending state just before the row, if its piece starts in ``start``."""
        even, first_run = F.col("_q") % 2 == 0, F.col("_run") == 0
        used = (start == QUESTION) | ((start == FOLLOWUP) & F.col("_lead_digit"))
        later = F.when(first_run & used, ~even).otherwise(even)
        return F.when(first_run & (F.col("_q") == 0), start).when(later, NOTHING).otherwise(QUESTION)

    def jobs_of(state: Column) -> Column:
        return _by_state(state, F.col("_digit"), F.col("_job_solo"), F.col("_job_pair"), F.lit(False))

    def after(state: Column) -> Column:
        asks = F.when(F.col("_asks"), QUESTION).otherwise(NOTHING)
        return F.when(F.col("_stop"), NOTHING).otherwise(_by_state(state, F.col("_digit"), asks, F.lit(NOTHING), F.lit(NOTHING)))

    starts = [F.lit(s) for s in (NOTHING, QUESTION, FOLLOWUP)]
    acting = rows.filter("_report OR _stop")
    per_stop = acting.groupBy("phone", "_piece", "_stops").agg(
        F.max_by(F.struct(*[after(state_of(s)).alias(f"s{i}") for i, s in enumerate(starts)], F.col("_stop").alias("stop")),
                 F.struct(*ORDER)).alias("exit"),
        F.struct(*[F.count_if(jobs_of(state_of(s))).alias(f"j{i}") for i, s in enumerate(starts)]).alias("jobs"),
        F.max("_due").alias("due"))
    # Only jobs after the last STOP of the piece stay open.
    hours = per_stop.groupBy("phone", "_piece").agg(F.max_by(F.struct("exit", "jobs", "due"), "_stops").alias("h"), F.max("_stops").alias("n"))
    hours = hours.select("phone", F.struct(
        F.col("_piece").alias("piece"), F.array(*[F.col(f"h.exit.s{i}") for i in range(3)]).alias("exits"),
        # A STOP as the last act of the piece closes everything before it.
        F.array(*[F.when(F.col("h.exit.stop"), 0).otherwise(F.col(f"h.jobs.j{i}")) for i in range(3)]).alias("jobs"),
        ((F.col("n") > 0) | F.col("h.exit.stop")).alias("stopped"), F.col("h.due").alias("due")).alias("h"))
    line = hours.groupBy("phone").agg(F.sort_array(F.collect_list("h")).alias("hs"))
    zero = F.struct(F.lit(NOTHING).alias("state"), F.array().cast("array<bigint>").alias("open"),
                    F.array().cast("array<struct<piece:struct<hour:bigint,cut:bigint>,state:int>>").alias("starts"))

    def step(acc, h):
        began = h["piece"]["hour"] * HOUR
        start = F.when(F.exists(acc["open"], lambda d: d <= began), FOLLOWUP).otherwise(acc["state"])
        still = F.when(h["stopped"], F.array().cast("array<bigint>")).otherwise(F.filter(acc["open"], lambda d: d > began))
        opened = F.when(F.get(h["jobs"], start) > 0, F.array(h["due"])).otherwise(F.array().cast("array<bigint>"))
        return F.struct(F.get(h["exits"], start).alias("state"), F.array_union(still, opened).alias("open"),
                        F.concat(acc["starts"], F.array(F.struct(h["piece"].alias("piece"), start.alias("state")))).alias("starts"))

    folded = line.select("phone", F.explode(F.aggregate("hs", zero, step)["starts"]).alias("s"))
    started = folded.select("phone", F.col("s.piece").alias("_piece"), F.col("s.state").alias("_start"))
    rows = rows.join(started, ["phone", "_piece"], "left").withColumn("_state", state_of(F.coalesce("_start", F.lit(NOTHING))))
    return rows.select("id", "phone", "at", "epoch", "kw", "lang", "muted", "welcome", *_reply())


def _reply() -> list[Column]:
    """Action, verdict and side effects of a row whose pending state is known."""
    digit, report = F.col("digit"), F.col("_report")
    paired = report & (F.col("_state") == QUESTION)
    answered = report & (F.col("_state") == FOLLOWUP) & F.col("_digit")
    analysed = report & ~answered
    pick = lambda name: F.when(analysed, F.when(paired, F.col(f"_pair.{name}")).otherwise(F.col(name)))
    label, decision = pick("label"), pick("decision")
    board = analysed & (label == OTHER) & F.coalesce(pick("price_en"), F.lit(False))
    action = (F.when(F.col("kw") == "STOP", "stop_ack").when(F.col("kw") == "START", "start_ack")
               .when(F.col("muted"), "muted").when((F.col("kw") == "PRICE") | (F.col("kw").isNull() & F.col("price")), "prices")
               .when(F.col("kw") == "HELP", "help").when(F.col("kw") == "AGENT", "agent_requested")
               .when(answered & (digit == "3"), "followup_worse").when(answered, "followup_ok")
               .when(board, "prices").otherwise(decision))
    template = F.when(action.isin("answer", "clarify", "escalate"), pick("template_id")).when(action == "muted", None).otherwise(action)
    alert = action.isin("help", "agent_requested", "followup_worse", "escalate")
    due = F.when((action == "answer") & label.isin(*fixed.FOLLOWED_UP), F.col("_due"))
    return [action.alias("action"), label.alias("label"), decision.alias("decision"), template.alias("template_id"),
            F.when(paired, F.col("_prev.id")).alias("original_id"), alert.alias("alert"), due.alias("due")]


# Why a human is called, by action; an escalated report speaks through its verdict.
ALERT_NOTES = {"help": "asked for HELP", "agent_requested": "asked for an agent", "followup_worse": "follow-up: getting worse"}


def alert_text(phone, note, original, english, label, proba, reason) -> Column:
    """What a human needs to act on, one fact per line; absent facts take no line."""
    line = lambda head, c: F.when(c.isNotNull() & (c != ""), F.concat(F.lit(head), c))
    proposed = F.when(label.isNotNull(), F.concat(label, F.lit(" (p="), F.format_string("%.2f", F.floor(F.coalesce(proba, F.lit(0.0)) * 100 + 0.5) / 100), F.lit(")")))
    return F.concat_ws("\n", F.concat(phone.cast("string"), F.lit(" needs a human.")), F.when(note != "", note), line("Said: ", original),
                       F.when(label.isNotNull(), F.concat(F.lit("English: "), F.coalesce(english, original))), line("Proposed: ", proposed), line("Why: ", reason))


def transcript(msgs: DataFrame, phone: str = "phone", row_id: str = "id") -> DataFrame:
    """Messages per sender in arrival order, not in time order."""
    return msgs.orderBy(phone, row_id)

"""Streams over the events table, run to the end of what is stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators.dialog import ALERT_NOTES
from tideline.plans.content import SQL_REPLIES, SQL_TEMPLATES, sent_templates
from tideline.plans.dialog import CONVERSATION_COLUMNS, SQL_CONVERSATION, SQL_MESSAGES, messages
from tideline.plans.registry import query, table
from tideline.session import fresh_path
from tideline.streaming.conversation import conversation_stream
from tideline.streaming.inbound import dedup_inbound, file_stream, inbound_stream
from tideline.streaming.outbox import Outbox, sending
from tideline.streaming.replay import ROWS_PER_BATCH, ordered_stream, run_to_end

LATENESS = "10 minutes"
TICK = "TICK"  # keyword of a row that only moves time on


def events_stream(spark, sf):
    """The table's files as a stream; the star lets one file and a folder of files be read alike."""
    return file_stream(spark, f"{sf}/events.parquet*", table(spark, sf, "events").schema)


def replay(spark, msgs, write=None, rows=ROWS_PER_BATCH):
    """Runs stored messages through the conversation stream in order of time, whatever files they lie in, and returns the path of its rows.

    One query reads ranges of time with about ``rows`` rows each, one a batch. No row is late, as a range starts where the
    watermark has not been yet. A last row of no sender moves the watermark on, so that all follow-ups due by the end of the log are sent.
    """
    msgs = msgs.withColumn("ts", F.timestamp_seconds("epoch"))
    end = msgs.agg(F.max("epoch").alias("_end")).filter("_end IS NOT NULL")
    tick = end.select(*[(F.timestamp_seconds("_end") + F.expr(f"INTERVAL {LATENESS}")).alias(c) if c == "ts"
                        else F.lit(TICK if c == "kw" else None).cast(t).alias(c) for c, t in msgs.dtypes])
    stream = ordered_stream(spark, msgs, "epoch", rows, tick).withWatermark("ts", LATENESS)
    return run_to_end(spark, conversation_stream(stream), write)


@query("stream_conversation", SQL_CONVERSATION)
def _(spark, sf):
    path = replay(spark, messages(spark, sf))
    return spark.read.parquet(path).filter("kind IN ('reply', 'muted')").select(*CONVERSATION_COLUMNS)


@query("stream_followups", f"""
    WITH c AS ({SQL_CONVERSATION}), m AS ({'WITH ' + SQL_MESSAGES} SELECT phone, id, n, kw, epoch FROM msgs)
    SELECT c.phone, c.due, count(*) AS n FROM c JOIN m ON m.id = c.id WHERE c.due IS NOT NULL
      AND c.due <= (SELECT max(epoch) FROM m)
      AND NOT EXISTS (SELECT 1 FROM m s WHERE s.phone = c.phone AND s.kw = 'STOP' AND s.n > m.n AND s.epoch < c.due) GROUP BY 1, 2""")
def _(spark, sf):
    rows = spark.read.parquet(replay(spark, messages(spark, sf))).filter("kind = 'followup'")
    return rows.groupBy("phone", "due").agg(F.count("*").alias("n"))


SQL_FIRED = f"""(WITH c AS ({SQL_CONVERSATION}), m AS ({'WITH ' + SQL_MESSAGES} SELECT phone, id, n, kw, epoch, lang_event FROM msgs)
    SELECT DISTINCT c.phone, c.due, coalesce((SELECT arg_max(l.lang_event, l.n) FROM m l WHERE l.phone = c.phone AND l.epoch < c.due AND l.lang_event IS NOT NULL), 'en') AS lang
    FROM c JOIN m ON m.id = c.id WHERE c.due <= (SELECT max(epoch) FROM m)
      AND NOT EXISTS (SELECT 1 FROM m s WHERE s.phone = c.phone AND s.kw = 'STOP' AND s.n > m.n AND s.epoch < c.due))"""
SQL_ALERT_NOTE = "CASE action " + " ".join(f"WHEN '{a}' THEN '{n}'" for a, n in ALERT_NOTES.items()) + " END"


def sql_said(template: str, lang: str) -> str:
    return f"(SELECT CASE WHEN {lang} = 'lg' AND t.lg <> '' THEN t.lg ELSE t.en END FROM {SQL_TEMPLATES} WHERE template_id = '{template}')"


@query("stream_outbound", f"""
    SELECT 'reply' AS kind, phone, 'reply:' || id AS key, text FROM {SQL_REPLIES}
    UNION ALL SELECT 'welcome', phone, 'welcome:' || c.id, {sql_said('welcome', 'c.lang')} FROM ({SQL_CONVERSATION}) c WHERE welcome
    UNION ALL SELECT 'followup', phone, 'followup:' || phone || ':' || due, {sql_said('followup_q', 'f.lang')} FROM {SQL_FIRED} f
    UNION ALL SELECT 'alert', c.phone, 'alert:' || c.id, concat_ws(chr(10), c.phone || ' needs a human.', {SQL_ALERT_NOTE}, 'Said: ' || m.kind || ' #' || m.k,
        CASE WHEN c.label IS NOT NULL THEN 'English: ' || CASE WHEN m.lang_event = 'lg' THEN 'in English #' || m.k ELSE m.kind || ' #' || m.k END END,
        'Proposed: ' || c.label || printf(' (p=%.2f)', floor(greatest(m.proba, o.proba) * 100 + 0.5) / 100), CASE WHEN c.label IS NOT NULL AND m.k % 5 = 0 THEN 'Why: no second opinion' END)
      FROM ({SQL_CONVERSATION}) c JOIN (WITH {SQL_MESSAGES} SELECT * FROM msgs) m USING (id) LEFT JOIN (WITH {SQL_MESSAGES} SELECT id, proba FROM msgs) o ON o.id = c.original_id
      WHERE c.alert""")
def _(spark, sf):
    """All that goes out over the log, with the price board of the first market in the price message."""
    templates = sent_templates(spark, sf)
    box = Outbox(spark, fresh_path(spark, "outbox"))
    replay(spark, messages(spark, sf, facts=True), sending(box, templates))
    return box.sent().select("kind", "phone", "key", "text")


@query("stream_dedup", """
    SELECT user_id, count(*) AS n FROM (SELECT user_id FROM events WHERE event_type = 'error'
      UNION ALL SELECT DISTINCT user_id FROM events WHERE event_type <> 'error') GROUP BY 1""")
def _(spark, sf):
    # The sender doubles as gateway id; errors come without one.
    raw = events_stream(spark, sf).select(
        F.col("user_id").cast("string").alias("from"), F.col("event_type").alias("text"), "user_id", F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("event_type") != "error", F.concat(F.lit("gw-"), "user_id")).alias("id"))
    path = run_to_end(spark, dedup_inbound(inbound_stream(raw)).select("user_id"))
    return spark.read.parquet(path).groupBy("user_id").agg(F.count("*").alias("n"))

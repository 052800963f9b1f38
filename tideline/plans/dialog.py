"""Events as a message log: mutes, languages, welcomes, follow-ups, the whole conversation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.functions import decision as dec
from tideline.functions.clock import epoch_of
from tideline.operators import dialog as dg
from tideline.plans.registry import query, table
from tideline.plans.text import SQL_LABEL_LIST, SQL_OPINIONS, event_opinions, sql_decide

# The labels of the follow-up rule, by the test tables' label names.
NAMES = {"alpha": "leaf_rust", "beta": "phoma", "gamma": "healthy", "other": "other"}


def message_columns(events, keep=(), facts=False):
    """Message columns of dialog from an events frame; row-level only, so a stream can use it too.

    ``facts`` adds what an alert tells: the message, its English and why the two opinions led to no answer.
    """
    rows = event_opinions(events)
    rename = lambda c: F.element_at(F.create_map(*[F.lit(x) for kv in NAMES.items() for x in kv]), F.col(c))
    k, kind = F.col("k"), F.col("event_type")
    kw = (F.when(kind == "signup", "START").when((kind == "error") & (k % 3 == 0), "STOP")
           .when((kind == "purchase") & (k % 10 == 0), "HELP").when((kind == "purchase") & (k % 10 == 1), "AGENT")
           .when((kind == "purchase") & (k % 2 == 0), "PRICE"))
    rows = rows.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("phone"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
        epoch_of("ts").alias("epoch"), kw.alias("kw"), (kw.isNull() & (kind == "purchase")).alias("price"), rename("label").alias("label"),
        F.when(kind == "view", F.col("proba") / 2).otherwise(F.col("proba")).alias("proba"), rename("llm_label").alias("llm_label"),
        *keep, kind.alias("said"), F.col("llm_sure"), (k % 11 == 0).alias("price_en"), (kind.isin("click", "view", "error") & kw.isNull() & (k % 6 == 0)).alias("_d"), k)
    rows = rows.select("*", F.when(F.col("_d"), (k % 3 + 1 + F.pmod(F.floor(k / 6), F.lit(3))).cast("string")).alias("digit0"))
    lang = (F.when(F.col("_d"), None).when(F.col("kw").isNotNull(), F.when(k % 4 == 0, "lg"))
             .when(k % 3 == 0, "en").when(k % 3 == 1, "lg"))
    v = dec.decide("label", "proba", "llm_label", "llm_sure", False)
    return (rows.withColumn("digit", F.when(F.col("digit0").isin("1", "2", "3"), F.col("digit0")))
            .withColumn("lang_event", lang).withColumn("_v", v)
            .select(*keep, *([F.concat_ws(" #", "said", "k").alias("said"), F.when(F.col("lang_event") == "lg", F.concat(F.lit("in English #"), "k")).alias("english"),
                              F.when(k % 5 == 0, "no second opinion").alias("reason")] if facts else []), "id", "phone", "at", "epoch", "kw", "price", "digit", "lang_event", "price_en", "label", "_v.decision", "_v.template_id",
                    F.struct("label", "proba", "llm_label", "llm_sure", "price_en").alias("opinion")))


def messages(spark, sf, facts=False):
    return message_columns(table(spark, sf, "events"), facts=facts)


def pair_verdict(earlier):
    """Both messages together: the reply's labels, the better probability, never another question."""
    v = dec.decide("label", F.greatest(F.col("opinion.proba"), earlier["proba"]), "opinion.llm_label", "opinion.llm_sure", True)
    return F.when(earlier.isNotNull(), F.struct(v["label"].alias("label"), v["decision"].alias("decision"), v["template_id"].alias("template_id"),
                                                (F.col("price_en") | earlier["price_en"]).alias("price_en")))


_NAME = "CASE {0} WHEN 'alpha' THEN 'leaf_rust' WHEN 'beta' THEN 'phoma' WHEN 'gamma' THEN 'healthy' ELSE {0} END"
SQL_MESSAGES = f"""base AS (SELECT event_id AS id, user_id AS phone, ts, CAST(floor(epoch(ts)) AS BIGINT) AS epoch, k, event_type AS kind,
      {_NAME.format('label')} AS label, CASE event_type WHEN 'view' THEN proba / 2 ELSE proba END AS proba,
      {_NAME.format('llm_label')} AS llm_label, llm_sure, k % 11 = 0 AS price_en,
      CASE WHEN event_type = 'signup' THEN 'START' WHEN event_type = 'error' AND k % 3 = 0 THEN 'STOP'
           WHEN event_type = 'purchase' AND k % 10 = 0 THEN 'HELP' WHEN event_type = 'purchase' AND k % 10 = 1 THEN 'AGENT'
           WHEN event_type = 'purchase' AND k % 2 = 0 THEN 'PRICE' END AS kw FROM {SQL_OPINIONS}),
    marked AS (SELECT *, kw IS NULL AND kind = 'purchase' AS price, kind IN ('click', 'view', 'error') AND kw IS NULL AND k % 6 = 0 AS d FROM base),
    msgs AS (SELECT *, CASE WHEN d AND k % 3 + 1 + (k // 6) % 3 <= 3 THEN CAST(k % 3 + 1 + (k // 6) % 3 AS VARCHAR) END AS digit,
      CASE WHEN d THEN NULL WHEN kw IS NOT NULL THEN CASE WHEN k % 4 = 0 THEN 'lg' END WHEN k % 3 = 0 THEN 'en' WHEN k % 3 = 1 THEN 'lg' END AS lang_event,
      row_number() OVER (PARTITION BY phone ORDER BY ts, id) AS n FROM marked)"""
SQL_MUTED = f"""{SQL_MESSAGES}, muted_ AS (SELECT *, coalesce(last_value(CASE kw WHEN 'STOP' THEN true WHEN 'START' THEN false END IGNORE NULLS)
      OVER (PARTITION BY phone ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false)
      AND coalesce(kw NOT IN ('STOP', 'START'), true) AS muted FROM msgs)"""


@query("mute_state", f"WITH {SQL_MUTED} SELECT id, phone, muted FROM muted_")
def _(spark, sf):
    return dg.mute_state(messages(spark, sf).select("id", "phone", "at", "epoch", "kw")).select("id", "phone", "muted")


@query("first_contact", f"""WITH {SQL_MUTED} SELECT phone, id FROM (SELECT *, row_number() OVER (PARTITION BY phone ORDER BY n) AS r
    FROM muted_ WHERE NOT muted AND coalesce(kw NOT IN ('STOP', 'START'), true)) WHERE r = 1""")
def _(spark, sf):
    return dg.first_contact(dg.mute_state(messages(spark, sf).select("id", "phone", "at", "epoch", "kw"))).select("phone", "id")


@query("language_state", f"""WITH {SQL_MESSAGES} SELECT id, phone, coalesce(last_value(lang_event IGNORE NULLS)
    OVER (PARTITION BY phone ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'en') AS lang FROM msgs""")
def _(spark, sf):
    return dg.language_state(messages(spark, sf).select("id", "phone", "at", "epoch", "lang_event")).select("id", "phone", "lang")


AS_OF = 1706313600  # 2024-01-27 00:00 UTC


@query("due_followups", f"""
    WITH {SQL_MESSAGES}, jobs AS (SELECT phone, n, ts, id, (epoch + 270000) // 86400 * 86400 + 54000 AS due FROM msgs WHERE kind = 'click')
    SELECT phone, id, due FROM jobs j WHERE due <= {AS_OF} AND NOT EXISTS (SELECT 1 FROM msgs s WHERE s.kw = 'STOP' AND s.phone = j.phone
      AND s.n > j.n AND epoch_us(s.ts) < due * 1000000)""")
def _(spark, sf):
    from tideline.functions.clock import followup_due_epoch
    msgs, clicks = messages(spark, sf), table(spark, sf, "events").filter("event_type = 'click'")
    jobs = clicks.select(F.col("user_id").alias("phone"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                         F.col("event_id").alias("id"), followup_due_epoch(epoch_of("ts")).alias("due"))
    return dg.due_followups(jobs, msgs.filter("kw = 'STOP'"), AS_OF).select("phone", "id", "due")


SQL_JOINED = """(SELECT m.phone, m.n, m.id, m.kw, m.price, m.digit, m.label, m.proba, m.llm_label, m.llm_sure, m.price_en,
    m.decision, m.template_id, m.epoch, w.stopped, w.welcomed, coalesce(m.lang_event, w.lang) AS lang,
    CASE WHEN len(list_filter(w.jobs, lambda d: d <= m.epoch)) > 0 THEN 'F' ELSE w.pend END AS pend,
    w.oid, coalesce(w.oproba, 0) AS oproba, w.oprice, list_filter(w.jobs, lambda d: d > m.epoch) AS jobs,
    m.kw IS NULL AND NOT m.price AND NOT w.stopped AS report,
    NOT w.welcomed AND NOT w.stopped AND coalesce(m.kw NOT IN ('STOP', 'START'), true) AS welcome
  FROM walk w JOIN ready m ON m.phone = w.phone AND m.n = w.n + 1)"""
SQL_PAIRED = f"""(SELECT j.*, p.decision AS pdecision, p.template_id AS ptemplate FROM {SQL_JOINED} j JOIN
    {sql_decide("(SELECT id, label, llm_label, llm_sure, greatest(proba, oproba) AS proba FROM " + SQL_JOINED + ")", 'true')} p USING (id))"""
SQL_FOLLOWED = "(action = 'answer' AND vlabel IN ('leaf_rust', 'phoma'))"
SQL_DUE_AT = "((epoch + 270000) // 86400 * 86400 + 54000)"


def sql_asked(new: str, old: str, none: str) -> str:
    """What a question was about stays with it while messages that are no reports pass."""
    return f"CASE WHEN kw = 'STOP' THEN {none} WHEN NOT report THEN {old} WHEN action = 'clarify' THEN {new} ELSE {none} END"


SQL_CONVERSATION = f"""WITH RECURSIVE {SQL_MESSAGES}, ready AS (SELECT * FROM {sql_decide('msgs', 'false')}),
    walk AS (
      SELECT phone, 0::BIGINT AS n, NULL::BIGINT AS id, false AS stopped, false AS welcomed, 'en' AS lang, 'N' AS pend,
        NULL::BIGINT AS oid, NULL::DOUBLE AS oproba, false AS oprice, []::BIGINT[] AS jobs, ''::VARCHAR AS action,
        NULL::VARCHAR AS vlabel, NULL::VARCHAR AS vdecision, NULL::VARCHAR AS vtemplate, NULL::BIGINT AS original_id,
        false AS welcome, NULL::BIGINT AS due FROM (SELECT DISTINCT phone FROM msgs)
      UNION ALL
      SELECT phone, n, id, CASE kw WHEN 'STOP' THEN true WHEN 'START' THEN false ELSE stopped END, welcomed OR welcome, lang,
        CASE WHEN kw = 'STOP' THEN 'N' WHEN NOT report THEN pend WHEN action = 'clarify' THEN 'C' ELSE 'N' END,
        {sql_asked('id', 'oid', 'NULL')}, {sql_asked('proba', 'oproba', 'NULL')}, {sql_asked('price_en', 'oprice', 'false')},
        CASE WHEN kw = 'STOP' THEN []::BIGINT[] WHEN {SQL_FOLLOWED} THEN list_append(jobs, {SQL_DUE_AT}) ELSE jobs END,
        action, vlabel, vdecision,
        CASE WHEN action IN ('answer', 'clarify', 'escalate') THEN vtemplate WHEN action = 'muted' THEN NULL ELSE action END,
        CASE WHEN report AND pend = 'C' THEN oid END, welcome, CASE WHEN {SQL_FOLLOWED} THEN {SQL_DUE_AT} END
      FROM (SELECT *, CASE WHEN kw = 'STOP' THEN 'stop_ack' WHEN kw = 'START' THEN 'start_ack' WHEN stopped THEN 'muted'
          WHEN kw = 'PRICE' OR price THEN 'prices' WHEN kw = 'HELP' THEN 'help' WHEN kw = 'AGENT' THEN 'agent_requested'
          WHEN pend = 'F' AND digit = '3' THEN 'followup_worse' WHEN pend = 'F' AND digit IS NOT NULL THEN 'followup_ok'
          WHEN vlabel = 'other' AND vprice THEN 'prices' ELSE vdecision END AS action
        FROM (SELECT *, CASE WHEN used THEN label END AS vlabel,
            CASE WHEN used THEN CASE WHEN pend = 'C' THEN pdecision ELSE decision END END AS vdecision,
            CASE WHEN pend = 'C' THEN ptemplate ELSE template_id END AS vtemplate, price_en OR (pend = 'C' AND oprice) AS vprice
          FROM (SELECT *, report AND NOT (pend = 'F' AND digit IS NOT NULL) AS used FROM {SQL_PAIRED}))))
    SELECT id, phone, action, vlabel AS label, vdecision AS decision, vtemplate AS template_id, original_id, lang, welcome,
           action IN ('help', 'agent_requested', 'followup_worse', 'escalate') AS alert, due FROM walk WHERE n > 0"""
CONVERSATION_COLUMNS = ["id", "phone", "action", "label", "decision", "template_id", "original_id", "lang", "welcome", "alert", "due"]


def conversation(spark, sf):
    return dg.conversation(messages(spark, sf), pair_verdict).select(*CONVERSATION_COLUMNS)


query("conversation", SQL_CONVERSATION)(conversation)


@query("transcript", "SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS place FROM conversations")
def _(spark, sf):
    from tideline.operators.scan import row_position
    conv = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return dg.transcript(row_position(conv, ["conv_id"], ["turn"], "place"), "conv_id", "turn")

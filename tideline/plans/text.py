"""Text, routing, language and decision columns over documents, conversations and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.dims import tables as dim
from tideline.functions import decision as dec
from tideline.functions import text as tx
from tideline.functions.clock import epoch_of, followup_due_epoch
from tideline.functions.language import tag_language
from tideline.operators.routing import keyword_dim, route_keyword
from tideline.plans.registry import query, quoted, sql_hits, sql_norm, sql_phrases, sql_strip, table


def sql_language(source: str, text: str, default: str, keep: str) -> str:
    """A query over ``source`` that adds ``tagged``; ``keep`` lists the columns to carry along."""
    hits = []
    for lx in dim.LEXICONS:
        cond = f"w IN ({quoted(sorted(lx.words))})"
        if lx.prefix:
            cond += (f" OR (length(w) >= {lx.min_prefix_len} AND w NOT IN ({quoted(sorted(lx.not_in))}) "
                     f"AND regexp_matches(w, '{lx.prefix}'))")
        h = f"len(list_filter(ws, lambda w: {cond}))"
        if lx.elision:
            pattern = lx.elision.replace("'", "''")
            h += f" + len(list_filter(ws, lambda w: regexp_matches(w, '{pattern}')))"
        hits.append(f"{h} AS h_{lx.lang}")
    names = [f"h_{lx.lang}" for lx in dim.LEXICONS]
    top = f"greatest({', '.join(names)})"
    level = " + ".join(f"CAST({n} = {top} AS INT)" for n in names)
    case = " ".join(f"WHEN {n} = {top} THEN '{n[2:]}'" for n in names)
    pattern = dim.WORD_PATTERN.replace("'", "''")
    return f"""
    SELECT {keep}, CASE WHEN {level} > 1 THEN {default} {case} END AS tagged FROM (
      SELECT *, {', '.join(hits)} FROM (
        SELECT *, list_filter(list_transform(regexp_extract_all(lower({text}), '{pattern}'),
                  lambda w: trim(w, '''')), lambda w: w <> '') AS ws FROM {source}))"""


def sql_hint_case(text: str) -> tuple[str, str]:
    """SQL of the best hint label and of its hits."""
    parts = {lab: f"({sql_hits(text, ph)})" for lab, ph in dim.HINTS.items()}
    top = f"greatest({', '.join(parts.values())})"
    case = " ".join(f"WHEN {p} = {top} THEN '{lab}'" for lab, p in parts.items())
    return f"CASE {case} END", top


DOC_LANG = lambda t="text": tag_language(t, dim.LEXICONS, "en", dim.WORD_PATTERN)


@query("norm_text", f"SELECT doc_id, {sql_norm('text')} AS norm FROM documents")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.norm_text("text").alias("norm"))


SQL_FOLD = r"trim(regexp_replace(strip_accents(lower({})), '[^\x00-\x7F]', '', 'g'), ' .!?')"


@query("fold_key", f"""
    SELECT 'documents' AS src, doc_id AS id, 0 AS seq, {SQL_FOLD.format(sql_strip('text'))} AS folded FROM documents
    UNION ALL
    SELECT 'conversations', conv_id, CAST(turn AS INT), {SQL_FOLD.format(sql_strip('text'))} FROM conversations""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(0).alias("seq"), "text")
    conv = table(spark, sf, "conversations").select(
        F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), F.col("turn").cast("int").alias("seq"), "text")
    return docs.unionByName(conv).select("src", "id", "seq", tx.fold_key("text").alias("folded"))


SQL_RAW_PHONE = """CASE c_nationkey % 5 WHEN 0 THEN '0' || c_custkey WHEN 1 THEN '256-' || c_custkey
    WHEN 2 THEN '+256 ' || c_custkey WHEN 3 THEN '00256 ' || c_custkey || ' x' ELSE '' END"""


def raw_phone():
    n, k = F.col("c_nationkey") % 5, F.col("c_custkey").cast("string")
    return (F.when(n == 0, F.concat(F.lit("0"), k)).when(n == 1, F.concat(F.lit("256-"), k))
             .when(n == 2, F.concat(F.lit("+256 "), k)).when(n == 3, F.concat(F.lit("00256 "), k, F.lit(" x")))
             .otherwise(F.lit("")))


SQL_PHONE = f"""SELECT *, CASE WHEN p LIKE '00%' THEN '+' || substr(p, 3) WHEN p LIKE '0%' THEN '+256' || substr(p, 2)
    WHEN p <> '' AND p NOT LIKE '+%' THEN '+' || p ELSE p END AS phone
    FROM (SELECT *, regexp_replace({SQL_RAW_PHONE}, '[^0-9+]', '', 'g') AS p FROM customer)"""


@query("norm_phone", f"SELECT c_custkey, phone FROM ({SQL_PHONE})")
def _(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", tx.norm_phone(raw_phone()).alias("phone"))


@query("number_scope", f"""SELECT c_mktsegment, count(*) AS n FROM ({SQL_PHONE})
    WHERE phone LIKE '+2561%' OR phone = '+25670' GROUP BY 1""")
def _(spark, sf):
    df = table(spark, sf, "customer").withColumn("phone", tx.norm_phone(raw_phone()))
    return (df.filter(tx.number_scope("phone", "+2561", "+25670"))
              .groupBy("c_mktsegment").agg(F.count("*").alias("n")))


@query("clean_inbound", f"""
    SELECT conv_id, turn, substr({sql_strip('text')}, 1, 1000) AS body FROM conversations
    WHERE {sql_strip('text')} <> '' AND conv_id IS NOT NULL""")
def _(spark, sf):
    body = tx.clean_inbound("text")
    return (table(spark, sf, "conversations").filter(F.col("conv_id").isNotNull())
            .select("conv_id", "turn", body.alias("body")).filter(F.col("body") != ""))


SQL_KEYWORD_DIM = "(VALUES " + ", ".join(
    f"('{w}', '{r}', {'NULL' if lang is None else repr(lang)})" for w, r, lang in dim.KEYWORDS) + ") k(word, route, lang)"
SQL_FIRST_WORD = f"{SQL_FOLD.format(sql_strip('split_part(text, chr(32), 1)'))}"


@query("route_keyword", f"""
    SELECT 'documents' AS src, doc_id AS id, CAST(0 AS BIGINT) AS seq, route, k.lang AS kw_lang
    FROM documents JOIN {SQL_KEYWORD_DIM} ON {SQL_FIRST_WORD} = k.word
    UNION ALL
    SELECT 'conversations', conv_id, turn, route, k.lang
    FROM conversations JOIN {SQL_KEYWORD_DIM} ON {SQL_FIRST_WORD} = k.word WHERE role = 'user'""")
def _(spark, sf):
    first = F.split_part(F.col("text"), F.lit(" "), F.lit(1)).alias("message")
    docs = table(spark, sf, "documents").select(
        F.lit("documents").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("seq"), first)
    conv = table(spark, sf, "conversations").filter("role = 'user'").select(
        F.lit("conversations").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("seq"), first)
    return (route_keyword(docs.unionByName(conv), keyword_dim(spark, dim.KEYWORDS), "message")
            .filter(F.col("route").isNotNull()).select("src", "id", "seq", "route", "kw_lang"))


@query("price_intent", f"""SELECT lang, count(*) AS n, count(*) FILTER ({sql_phrases('text', dim.PRICE_PHRASES)}) AS asks
    FROM documents GROUP BY lang""")
def _(spark, sf):
    ask = tx.is_price_intent("text", dim.PRICE_PHRASES)
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.count_if(ask).alias("asks"))


@query("tag_language", f"""SELECT lang, tagged, count(*) AS n
    FROM ({sql_language('documents', 'text', "'en'", 'doc_id, lang')}) GROUP BY 1, 2""")
def _(spark, sf):
    return (table(spark, sf, "documents").select("lang", DOC_LANG().alias("tagged"))
            .groupBy("lang", "tagged").agg(F.count("*").alias("n")))


@query("needs_translation", r"""SELECT doc_id, lang <> 'en' AND regexp_matches(text, '\p{L}') AS translate FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", tx.needs_translation("text", "lang").alias("translate"))


GLOSSARY_WORDS = r"[\p{L}]+"
SQL_GLOSSARY = "[" + ", ".join(
    f"{{'stem': '{s}', 'term': '{e}', 'inside': {'true' if len(s) > 3 else 'false'}}}" for s, e in dim.GLOSSARY.items()) + "]"
SQL_TERMS = f"""list_reduce(list_transform(regexp_extract_all(lower(text), '{GLOSSARY_WORDS}'), lambda w: [w]),
    lambda acc, w: list_concat(acc, list_transform(list_filter({SQL_GLOSSARY}, lambda g:
        (CASE WHEN g.inside THEN contains(w[1], g.stem) ELSE suffix(w[1], g.stem) END)
        AND NOT list_contains(acc, g.term)), lambda g: g.term)[1:1]), CAST([] AS VARCHAR[]))"""


@query("glossary_terms", f"SELECT doc_id, array_to_string({SQL_TERMS}, '|') AS terms FROM documents")
def _(spark, sf):
    terms = tx.glossary_terms("text", dim.GLOSSARY, GLOSSARY_WORDS)
    return table(spark, sf, "documents").select("doc_id", F.array_join(terms, "|").alias("terms"))


@query("append_missing_terms", f"""
    SELECT doc_id, md5(text || CASE WHEN len(missing) > 0 THEN ' (' || array_to_string(missing, ', ') || ')' ELSE '' END)
           AS completed
    FROM (SELECT doc_id, text, list_filter({SQL_TERMS}, lambda t: NOT contains(lower(text), t)) AS missing FROM documents)""")
def _(spark, sf):
    terms = tx.glossary_terms("text", dim.GLOSSARY, GLOSSARY_WORDS)
    return (table(spark, sf, "documents").select("doc_id", "text", terms.alias("terms"))
            .select("doc_id", F.md5(tx.append_missing_terms("text", "terms").cast("binary")).alias("completed")))


HINT_LABEL, HINT_HITS = sql_hint_case("lower(text)")


@query("hint_score", f"SELECT doc_id, {HINT_LABEL} AS label, {HINT_HITS} AS hits FROM documents")
def _(spark, sf):
    return (table(spark, sf, "documents").select("doc_id", tx.hint_score("text", dim.HINTS).alias("s"))
            .select("doc_id", "s.label", "s.hits"))


def sql_keyword_decide(source: str, text: str, second: str, keep: str) -> str:
    label, hits = sql_hint_case(f"lower({text})")
    outside = f"(({sql_hits(f'lower({text})', dim.OUT_OF_SCOPE)}) > 0)"
    return f"""
    SELECT *, CASE WHEN hits > 0 THEN best ELSE 'other' END AS label,
      CASE WHEN hits > 0 THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS proba,
      CASE WHEN hits > 0 THEN 'answer' WHEN outside OR {second} THEN 'escalate' ELSE 'clarify' END AS decision,
      CASE WHEN hits > 0 THEN 'adv_' || best WHEN outside OR {second} THEN 'unsure' ELSE 'clarify' END AS template_id,
      CASE WHEN hits > 0 THEN '' WHEN outside THEN 'out_of_scope' WHEN {second} THEN 'still_unclear'
           ELSE 'unreadable' END AS reason
    FROM (SELECT {keep}, {label} AS best, {hits} AS hits, {outside} AS outside FROM {source})"""


@query("keyword_decide", f"""
    SELECT 'documents' AS src, label, decision, template_id, reason, count(*) AS n, round(avg(proba), 6) AS mean_proba
    FROM ({sql_keyword_decide('documents', 'text', 'false', 'doc_id')}) GROUP BY 2, 3, 4, 5
    UNION ALL
    SELECT 'conversations', label, decision, template_id, reason, count(*), round(avg(proba), 6)
    FROM ({sql_keyword_decide("(SELECT * FROM conversations WHERE role = 'user')", 'text', '(turn > 1)', 'turn')})
    GROUP BY 2, 3, 4, 5""")
def _(spark, sf):
    def summary(df, src, second):
        v = dec.keyword_decide("text", dim.HINTS, dim.OUT_OF_SCOPE, second)
        return (df.select(v.alias("v")).select("v.*").groupBy("label", "decision", "template_id", "reason")
                .agg(F.count("*").alias("n"), F.round(F.avg("proba"), 6).alias("mean_proba"))
                .withColumn("src", F.lit(src)))
    docs, conv = table(spark, sf, "documents"), table(spark, sf, "conversations").filter("role = 'user'")
    return summary(docs, "documents", False).unionByName(summary(conv, "conversations", F.col("turn") > 1))


# ---- verdicts derived from events: two opinions per message ---------------------------------
def event_opinions(events):
    """Two opinions per event: labels and sureness from the payload, probability from the value."""
    k = F.get_json_object("props", "$.k").cast("int")
    names = F.array(*[F.lit(x) for x in dim.LABELS])
    llm = F.when(k % 5 == 0, None).when(k % 3 == 0, F.get(names, (k + 1) % 4)).otherwise(F.get(names, k % 4))
    return events.select(
        "event_id", "user_id", "ts", "event_type", F.get(names, k % 4).alias("label"),
        F.least(F.col("value") / 60, F.lit(1.0)).alias("proba"), llm.alias("llm_label"),
        F.when(k % 7 != 0, k % 2 == 0).alias("llm_sure"), (k % 4 == 3).alias("second"), k.alias("k"))


SQL_LABEL_LIST = "[" + quoted(dim.LABELS) + "]"
SQL_OPINIONS = f"""(SELECT *, {SQL_LABEL_LIST}[k % 4 + 1] AS label, least(value / 60, 1.0) AS proba,
    CASE WHEN k % 5 = 0 THEN NULL WHEN k % 3 = 0 THEN {SQL_LABEL_LIST}[(k + 1) % 4 + 1]
         ELSE {SQL_LABEL_LIST}[k % 4 + 1] END AS llm_label,
    CASE WHEN k % 7 <> 0 THEN k % 2 = 0 END AS llm_sure, k % 4 = 3 AS second
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def sql_decide(source: str, second: str = "second", label="label", proba="proba", llm="llm_label",
               sure="llm_sure", t: float = 0.8) -> str:
    """``source`` with decision, reason and template columns added."""
    confident = f"({proba} >= {t})"
    return f"""(SELECT *, CASE decision WHEN 'answer' THEN 'adv_' || {label} WHEN 'escalate' THEN 'unsure'
        ELSE 'clarify' END AS template_id FROM (SELECT *,
      CASE WHEN {label} = 'other' THEN CASE WHEN {second} OR ({confident} AND ({llm} IS NULL
              OR ({llm} = 'other' AND coalesce({sure}, true)))) THEN 'escalate' ELSE 'clarify' END
           WHEN {confident} AND ({llm} IS NULL OR {llm} = {label}) THEN 'answer'
           WHEN {second} THEN 'escalate' ELSE 'clarify' END AS decision,
      CASE WHEN {label} = 'other' THEN CASE WHEN {second} OR ({confident} AND ({llm} IS NULL
              OR ({llm} = 'other' AND coalesce({sure}, true)))) THEN 'other' ELSE 'unclear' END
           WHEN {confident} AND {llm} = {label} THEN 'agree' WHEN {confident} AND {llm} IS NULL THEN 'llm_unavailable'
           WHEN {confident} THEN 'disagree' ELSE 'low_confidence' END AS reason FROM {source}))"""


@query("decide", f"""SELECT event_id, decision, reason, template_id FROM {sql_decide(SQL_OPINIONS)}""")
def _(spark, sf):
    v = dec.decide("label", "proba", "llm_label", "llm_sure", "second")
    return (event_opinions(table(spark, sf, "events")).select("event_id", v.alias("v"))
            .select("event_id", "v.decision", "v.reason", "v.template_id"))


@query("decision_grid", f"""
    SELECT label, proba >= 0.8 AS confident, coalesce(llm_label, '-') AS llm, llm_sure, second, decision, reason,
           template_id, count(*) AS n
    FROM {sql_decide(SQL_OPINIONS)} GROUP BY ALL""")
def _(spark, sf):
    v = dec.decide("label", "proba", "llm_label", "llm_sure", "second")
    return (event_opinions(table(spark, sf, "events"))
            .select("label", (F.col("proba") >= 0.8).alias("confident"), F.coalesce("llm_label", F.lit("-")).alias("llm"),
                    "llm_sure", "second", v.alias("v"))
            .select("label", "confident", "llm", "llm_sure", "second", "v.decision", "v.reason", "v.template_id")
            .groupBy("label", "confident", "llm", "llm_sure", "second", "decision", "reason", "template_id")
            .agg(F.count("*").alias("n")))


def raw_verdict():
    """A verdict whose parts may be missing, from document columns."""
    n = F.col("n_chars")
    return (F.when(n % 6 == 0, "reply").when(n % 6 == 1, None).otherwise(F.element_at(
        F.array(*[F.lit(d) for d in dec.DECISIONS]), (n % 3 + 1).cast("int"))).alias("decision"),
        F.when(n % 5 == 0, "").when(n % 7 == 0, None).otherwise(F.concat(F.lit("adv_"), F.col("source"))).alias("template_id"))


SQL_RAW_VERDICT = """(SELECT *, CASE WHEN n_chars % 6 = 0 THEN 'reply' WHEN n_chars % 6 = 1 THEN NULL
    ELSE ['answer', 'clarify', 'escalate'][n_chars % 3 + 1] END AS d0,
    CASE WHEN n_chars % 5 = 0 THEN '' WHEN n_chars % 7 = 0 THEN NULL ELSE 'adv_' || source END AS t0 FROM documents)"""


@query("contract_guard", f"""
    SELECT CASE WHEN ok THEN source ELSE 'other' END AS label, CASE WHEN ok THEN 0.9::DOUBLE ELSE 0.0::DOUBLE END AS proba,
      CASE WHEN ok THEN d0 ELSE 'escalate' END AS decision, CASE WHEN ok THEN t0 ELSE 'unsure' END AS template_id,
      CASE WHEN ok THEN lang ELSE 'unusable_verdict' END AS reason, count(*) AS n
    FROM (SELECT *, coalesce(d0 IN ('answer', 'clarify', 'escalate') AND t0 <> '', false) AS ok FROM {SQL_RAW_VERDICT})
    GROUP BY ALL""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", *raw_verdict())
    v = dec.contract_guard("source", F.lit(0.9), "decision", "template_id", "lang")
    return (docs.select(v.alias("v")).select("v.*")
            .groupBy("label", "proba", "decision", "template_id", "reason").agg(F.count("*").alias("n")))


ALLOWED = ("src0", "src1", "src2", "src3", "src5", "src8")


@query("label_guard", f"""
    SELECT doc_id, CASE WHEN source IN ({quoted(ALLOWED)}) THEN source END AS label,
      CASE WHEN source IN ({quoted(ALLOWED)}) THEN source ELSE 'clarify' END AS question, substr(text, 1, 80) AS reason
    FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", dec.label_guard("source", ALLOWED).alias("label"),
        dec.label_guard("source", ALLOWED, "clarify").alias("question"), dec.short_reason("text").alias("reason"))


FLAG_RE, BANNED_RE = tx.whole("|".join(dim.FLAG_WORDS)), tx.whole("|".join(dim.BANNED_WORDS))


def sql_word_matches(text, words):
    return (f"list_filter(regexp_extract_all(lower({text}), '[\\p{{L}}\\p{{N}}_]+'), "
            f"lambda w: regexp_full_match(w, '{'|'.join(words)}'))")


@query("flag_terms", f"""SELECT doc_id, array_to_string(list_sort(list_distinct(
    {sql_word_matches('text', dim.FLAG_WORDS)})), '|') AS flags FROM documents""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", F.array_join(tx.flag_terms(F.array("text"), FLAG_RE), "|").alias("flags"))


SQL_CLEANED = r"trim(trim(regexp_replace(text, '\s+', ' ', 'g')), '\"“”')".replace('\\"', '"')


@query("clean_generated", f"""
    SELECT coalesce(CASE WHEN c = '' OR length(c) > 320 THEN 'empty_or_long'
                         WHEN len({sql_word_matches('c', dim.BANNED_WORDS)}) > 0 THEN 'banned' END, 'kept') AS outcome,
           count(*) AS n, CAST(sum(length(c)) AS BIGINT) AS chars
    FROM (SELECT {SQL_CLEANED} AS c FROM documents) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(tx.clean_generated("text").alias("c"))
    return (docs.groupBy(F.coalesce(tx.generated_reason("c", BANNED_RE), F.lit("kept")).alias("outcome"))
            .agg(F.count("*").alias("n"), F.sum(F.char_length("c")).cast("long").alias("chars")))


@query("length_window", rf"""
    SELECT doc_id, (CASE WHEN t = '' THEN 0 ELSE len(string_split(t, ' ')) END) BETWEEN 3 AND 30 AND length(text) <= 160
           AS fits, length({sql_strip('text')}) >= 3 AS long_enough
    FROM (SELECT doc_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM documents)""")
def _(spark, sf):
    return table(spark, sf, "documents").select(
        "doc_id", tx.length_window("text").alias("fits"), (F.char_length(tx.strip("text")) >= 3).alias("long_enough"))


@query("unit_key", """
    SELECT doc_id, CASE WHEN lang IN ('de', 'es') THEN source ELSE format('{}-blk{:04d}', lang, doc_id // 100) END AS unit
    FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    kind = F.when(F.col("lang").isin("de", "es"), "sms").otherwise("photo")
    sid = F.concat(F.lit("set/"), F.col("n_chars"), F.lit("_"), F.col("doc_id"), F.lit(".jpg"))
    return docs.select("doc_id", tx.unit_key(kind, sid, "lang", "source").alias("unit"))


@query("topic_slug", """
    SELECT p_partkey, substr(trim(regexp_replace(lower(p_type || ' & ' || p_name || ' (' || p_brand || ')'),
           '[^a-z]+', '-', 'g'), '-'), 1, 28) AS slug FROM part""")
def _(spark, sf):
    topic = F.concat("p_type", F.lit(" & "), "p_name", F.lit(" ("), "p_brand", F.lit(")"))
    return table(spark, sf, "part").select("p_partkey", tx.topic_slug(topic).alias("slug"))


@query("menu_route", """
    SELECT entry, count(*) AS n, count(free_text) AS with_text, count(DISTINCT free_text) AS texts FROM (
      SELECT CASE WHEN c = '1' THEN 'prices' WHEN c = '2' AND s = '' THEN 'ask_report' WHEN c = '2' THEN 'report'
                  WHEN c = '3' THEN 'agent' ELSE 'menu' END AS entry, CASE WHEN c = '2' AND s <> '' THEN s END AS free_text
      FROM (SELECT CAST(user_id % 5 AS VARCHAR) AS c, CASE event_type WHEN 'view' THEN '' ELSE event_type END AS s
            FROM events)) GROUP BY 1""")
def _(spark, sf):
    choice = (F.col("user_id") % 5).cast("string")
    session = F.when(F.col("event_type") == "view", choice).otherwise(F.concat_ws("*", choice, "event_type"))
    return (table(spark, sf, "events").select(tx.menu_route(session).alias("m")).select("m.*")
            .groupBy("entry").agg(F.count("*").alias("n"), F.count("free_text").alias("with_text"),
                                  F.count_distinct("free_text").alias("texts")))


SQL_DUE = "CAST(floor(({e} + 270000) / 86400.0) AS BIGINT) * 86400 + 54000"
SQL_EPOCH = "CAST(floor(epoch({})) AS BIGINT)"


@query("followup_due", f"""
    SELECT 'events' AS src, event_id AS id, {SQL_DUE.format(e=SQL_EPOCH.format('ts'))} AS due FROM events
    UNION ALL
    SELECT 'orders', o_orderkey, {SQL_DUE.format(e=SQL_EPOCH.format('o_orderdate'))} FROM orders""")
def _(spark, sf):
    ev = table(spark, sf, "events").select(
        F.lit("events").alias("src"), F.col("event_id").alias("id"), followup_due_epoch(epoch_of("ts")).alias("due"))
    od = table(spark, sf, "orders").select(
        F.lit("orders").alias("src"), F.col("o_orderkey").alias("id"), followup_due_epoch(epoch_of("o_orderdate")).alias("due"))
    return ev.unionByName(od)


# ---- the whole chain on inbound messages ----------------------------------------------------
SQL_TRIAGE = f"""
    SELECT decision, label, tagged, count(*) AS n FROM (
      SELECT CASE WHEN route IS NOT NULL THEN lower(route) WHEN asks THEN 'price' ELSE decision END AS decision,
             CASE WHEN route IS NULL AND NOT asks THEN label ELSE '-' END AS label, coalesce(kw_lang, tagged) AS tagged
      FROM (SELECT m.*, k.route, k.lang AS kw_lang, {sql_phrases('body', dim.PRICE_PHRASES)} AS asks
            FROM ({sql_keyword_decide(
                "(" + sql_language("(SELECT *, substr(" + sql_strip('text') + ", 1, 1000) AS body FROM conversations "
                                   "WHERE role = 'user')", 'body', "'en'", 'conv_id, turn, body') + ")",
                'body', '(turn > 1)', 'conv_id, turn, body, tagged')}) m
            LEFT JOIN {SQL_KEYWORD_DIM} ON {SQL_FOLD.format("split_part(m.body, chr(32), 1)")} = k.word)
      WHERE body <> '') GROUP BY 1, 2, 3"""


def triage_mix(spark, sf):
    """Inbound user messages: clean, route, tag, decide; counts per outcome, label and language."""
    inbound = (table(spark, sf, "conversations").filter("role = 'user'")
               .select("turn", tx.clean_inbound("text").alias("body")).filter(F.col("body") != "")
               .withColumn("message", F.split_part("body", F.lit(" "), F.lit(1))))
    routed = route_keyword(inbound, keyword_dim(spark, dim.KEYWORDS), "message")
    verdict = dec.keyword_decide("body", dim.HINTS, dim.OUT_OF_SCOPE, F.col("turn") > 1)
    asks = tx.is_price_intent("body", dim.PRICE_PHRASES)
    scored = routed.select("route", asks.alias("asks"), verdict.alias("v"),
                           F.coalesce("kw_lang", DOC_LANG("body")).alias("tagged"))
    routed_away = F.col("route").isNotNull() | F.col("asks")
    return (scored.select(
        F.when(F.col("route").isNotNull(), F.lower("route")).when(F.col("asks"), "price")
         .otherwise(F.col("v.decision")).alias("decision"),
        F.when(routed_away, "-").otherwise(F.col("v.label")).alias("label"), "tagged")
        .groupBy("decision", "label", "tagged").agg(F.count("*").alias("n")))


query("triage_mix", SQL_TRIAGE)(triage_mix)

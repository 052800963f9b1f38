"""Replies, transcripts, price boards and checks over the given tables."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import functions as F

from tideline.operators import content as ct
from tideline.plans.dialog import SQL_CONVERSATION, conversation
from tideline.plans.registry import query, table
from tideline.session import cut_lineage
from tideline.sources.readers import template_rows

TEMPLATES = json.loads((Path(__file__).parent.parent / "dims" / "templates.json").read_text(encoding="utf-8"))


def templates_wide(spark):
    rows = [(k, v.get("en"), v.get("lg"), v.get("lg_verified")) for k, v in TEMPLATES.items()]
    return spark.createDataFrame(rows, "template_id string, en string, lg string, lg_verified boolean")


def lit(v):
    return "'" + (v or "").replace("'", "''") + "'"


PRICE_DATE = "1 May"
# Grades and their prices by market; the first market's board goes into the price message.
SQL_LINES = """g AS (SELECT p_brand, p_type AS grade, max(p_retailprice) AS price, min(p_retailprice) FILTER (p_size > 10) AS low,
        max(p_retailprice) FILTER (p_size > 45) AS high FROM part GROUP BY 1, 2),
    l AS (SELECT p_brand, -price AS o, grade AS g, CASE WHEN low > 0 AND high > 0 THEN format('{:,}', CAST(round(low) AS BIGINT)) || '-'
        || format('{:,}', CAST(round(high) AS BIGINT)) ELSE format('{:,}', CAST(round(price) AS BIGINT)) END AS a FROM g)"""
SQL_VALUES = "(VALUES " + ", ".join(f"({lit(k)}, {lit(v.get('en'))}, {lit(v.get('lg'))})" for k, v in TEMPLATES.items()) + ") v(template_id, en, lg)"


def sql_filled(lang: str) -> str:
    return (f"CASE WHEN template_id = 'prices' THEN coalesce(replace(replace({lang}, '{{date}}', '{PRICE_DATE}'), '{{body}}', body), "
            f"{lit(TEMPLATES['prices_unavailable'].get(lang))}) ELSE {lang} END AS {lang}")


SQL_TEMPLATES = f"""(WITH {SQL_LINES}, b AS (SELECT string_agg(g || ' ' || a, '; ' ORDER BY o, g) AS body FROM l WHERE p_brand = (SELECT min(p_brand) FROM part))
    SELECT template_id, {sql_filled('en')}, {sql_filled('lg')} FROM {SQL_VALUES} LEFT JOIN b ON true) t"""
SQL_REPLIES = f"""(SELECT c.id, c.phone, c.template_id, c.lang, CASE WHEN c.lang = 'lg' AND t.lg <> '' THEN t.lg ELSE t.en END AS text
    FROM ({SQL_CONVERSATION}) c JOIN {SQL_TEMPLATES} USING (template_id) WHERE t.en <> '' OR (c.lang = 'lg' AND t.lg <> ''))"""


def market_grades(spark, sf):
    return (table(spark, sf, "part").groupBy("p_brand", F.col("p_type").alias("grade"))
            .agg(F.max("p_retailprice").alias("price"), F.min(F.when(F.col("p_size") > 10, F.col("p_retailprice"))).alias("low"),
                 F.max(F.when(F.col("p_size") > 45, F.col("p_retailprice"))).alias("high")))


def sent_templates(spark, sf):
    """The service's templates with the price message of the first market."""
    first = table(spark, sf, "part").agg(F.min("p_brand").alias("p_brand"))
    body = ct.price_board(market_grades(spark, sf).join(first, "p_brand", "left_semi"), "p_brand", F.lit("{body}"), F.lit(None).cast("string"))
    board = body.select(F.lit("prices").alias("template_id"), F.lit(PRICE_DATE).alias("date"), F.col("board").alias("body"))
    return cut_lineage(ct.filled_templates(template_rows(templates_wide(spark)), board))  # a few rows that the plan meets twice


def replies(spark, sf):
    rows = conversation(spark, sf).select("id", "phone", "template_id", "lang").filter("template_id IS NOT NULL")
    return ct.render_reply(rows, sent_templates(spark, sf))


@query("render_reply", f"SELECT id, phone, template_id, lang, text FROM {SQL_REPLIES}")
def _(spark, sf):
    return replies(spark, sf).select("id", "phone", "template_id", "lang", "text")


@query("reverse_template", f"""SELECT r.id, r.text, b.en AS english FROM {SQL_REPLIES} r LEFT JOIN
    (SELECT text, arg_min(en, template_id) AS en FROM (SELECT template_id, en, unnest([en, lg]) AS text FROM {SQL_TEMPLATES})
     WHERE text <> '' GROUP BY 1) b USING (text)""")
def _(spark, sf):
    return ct.reverse_template(replies(spark, sf).select("id", "text"), sent_templates(spark, sf)).select("id", "text", "english")


# A conversation log: assistant turns that open a talk are template texts, other texts may be cached.
@query("transcript_english", """
    WITH m AS (SELECT conv_id, turn, CASE role WHEN 'assistant' THEN 'out' ELSE 'in' END AS direction, text,
        CASE WHEN length(text) > 100 THEN md5(text) END AS text_en FROM conversations),
    t AS (SELECT text, 'T:' || text AS en FROM (SELECT DISTINCT text FROM conversations WHERE role = 'assistant' AND turn = 1)),
    c AS (SELECT DISTINCT text, 'C:' || text AS en FROM conversations WHERE turn > 2)
    SELECT conv_id, turn, CASE WHEN direction = 'out' AND t.en IS NOT NULL THEN t.en ELSE coalesce(c.en, text_en) END AS english,
      CASE WHEN direction = 'out' AND t.en IS NOT NULL THEN 'template' WHEN c.en IS NOT NULL THEN 'cache' WHEN text_en IS NOT NULL THEN 'model' END AS via
    FROM m LEFT JOIN t USING (text) LEFT JOIN c USING (text)""")
def _(spark, sf):
    conv = table(spark, sf, "conversations")
    msgs = conv.select("conv_id", "turn", F.when(F.col("role") == "assistant", "out").otherwise("in").alias("direction"), "text",
                       F.when(F.char_length("text") > 100, F.md5(F.col("text").cast("binary"))).alias("text_en"))
    made = lambda head: F.concat(F.lit(head), "text")
    opening = conv.filter("role = 'assistant' AND turn = 1").select("text").distinct()
    templates = opening.select(F.sha2("text", 256).alias("template_id"), F.explode(F.array(
        F.struct(F.lit("lg").alias("lang"), F.col("text")), F.struct(F.lit("en").alias("lang"), made("T:").alias("text")))).alias("t"))
    cache = conv.filter("turn > 2").select("text", made("C:").alias("translated")).distinct()
    return ct.transcript_english(msgs, templates.select("template_id", "t.*"), cache).select("conv_id", "turn", "english", "via")


@query("price_board", f"WITH {SQL_LINES} SELECT p_brand, 'Prices on {PRICE_DATE}: ' || string_agg(g || ' ' || a, '; ' ORDER BY o, g) AS board FROM l GROUP BY 1")
def _(spark, sf):
    return ct.price_board(market_grades(spark, sf), "p_brand", F.lit(f"Prices on {PRICE_DATE}: {{body}}"), F.lit("No prices today."))


# Templates made from the part names: long ones, ones without a translation, ones with other placeholders.
def part_templates(spark, sf):
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("template_id"), F.concat("p_name", F.lit(" costs {price} on {date}"), F.repeat(F.lit("!"), F.col("p_size").cast("int") * 4)).alias("en"),
        F.when(k % 7 != 0, F.concat(F.lit("{date} "), "p_name", F.when(k % 5 == 0, "").otherwise(" {price}"))).alias("lg"),
        (F.col("p_size") > 25).alias("lg_verified"))


SQL_PART_TEMPLATES = """(SELECT p_partkey AS template_id, p_name || ' costs {price} on {date}' || repeat('!', p_size * 4) AS en,
    CASE WHEN p_partkey % 7 <> 0 THEN '{date} ' || p_name || CASE WHEN p_partkey % 5 = 0 THEN '' ELSE ' {price}' END END AS lg, p_size > 25 AS ok FROM part)"""


@query("template_lint", f"""SELECT count(*) AS templates, count(*) FILTER (en = '' OR lg IS NULL OR lg = '') AS missing_language,
    count(*) FILTER (length(en) > 160 OR length(coalesce(lg, '')) > 160) AS too_long,
    count(*) FILTER (lg IS NULL OR NOT contains(lg, '{{price}}')) AS other_placeholders, count(*) FILTER (NOT ok) AS unverified FROM {SQL_PART_TEMPLATES}""")
def _(spark, sf):
    return ct.lint_report(ct.template_lint(part_templates(spark, sf)))


@query("citation_check", """
    SELECT DISTINCT l_orderkey AS entry_id, l_partkey AS source FROM lineitem
    WHERE l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size <= 40)""")
def _(spark, sf):
    # An order cites the parts of its lines; small parts form the registry.
    entries = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("entry_id"), F.array("l_partkey").alias("sources"))
    return ct.citation_check(entries, table(spark, sf, "part").filter("p_size <= 40"), key="p_partkey")

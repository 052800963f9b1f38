"""Message templates, price boards, transcripts and their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PLACEHOLDER = r"\{[a-z_]+\}"


def render_reply(replies: DataFrame, templates: DataFrame, base: str = "en") -> DataFrame:
    """Adds ``text`` for (template_id, lang): that language, else the base language.

    A reply without any text is not sent, so its row is left out. Template rows are (template_id,
    lang, text), one per pair.
    """
    own = templates.select("template_id", "lang", F.nullif("text", F.lit("")).alias("_own"))
    other = templates.filter(F.col("lang") == base).select("template_id", F.nullif("text", F.lit("")).alias("_base"))
    out = replies.join(own, ["template_id", "lang"], "left").join(other, "template_id", "left")
    return out.withColumn("text", F.coalesce("_own", "_base")).filter(F.col("text").isNotNull()).drop("_own", "_base")


def filled_templates(templates: DataFrame, board: DataFrame, key: str = "prices", unavailable: str = "prices_unavailable") -> DataFrame:
    """The templates as they are sent: that of the prices filled with the date and body of the day's board.

    ``board`` has (template_id, date, body), a row for ``key`` or none; without a row or a body the unavailable text of the language stands in.
    """
    spare = templates.filter(F.col("template_id") == unavailable).select(F.lit(key).alias("template_id"), "lang", F.col("text").alias("_spare"))
    out = templates.join(board, "template_id", "left").join(spare, ["template_id", "lang"], "left")
    full = F.replace(F.replace("text", F.lit("{date}"), F.col("date")), F.lit("{body}"), F.col("body"))
    text = F.when(F.col("template_id") != key, F.col("text")).when(F.col("body").isNull(), F.col("_spare")).otherwise(full)
    return out.select("template_id", "lang", text.alias("text"))


def reverse_template(sent: DataFrame, templates: DataFrame, text: str = "text", base: str = "en") -> DataFrame:
    """Adds ``english``: the base text of the template a sent text came from, in whatever language."""
    english = templates.filter(F.col("lang") == base).select("template_id", F.col("text").alias("_en"))
    # Two templates may share a text; the first by id speaks for it.
    by_text = (templates.filter("text <> ''").join(english, "template_id").groupBy(F.col("text").alias(text))
               .agg(F.min_by("_en", "template_id").alias("english")))
    return sent.join(by_text, text, "left")


def transcript_english(messages: DataFrame, templates: DataFrame, cache: DataFrame) -> DataFrame:
    """Adds ``english`` and ``via``: template for what we sent, else the translation cache, else the
    translation stored with the message.

    ``cache`` is (text, translated), one row per text. Both lookups are by equality of the text.
    """
    out = reverse_template(messages, templates).withColumnRenamed("english", "_t")
    out = out.withColumn("_t", F.when(F.col("direction") == "out", F.col("_t")))
    out = out.join(cache.select("text", F.col("translated").alias("_c")), "text", "left")
    return (out.withColumn("english", F.coalesce("_t", "_c", "text_en"))
            .withColumn("via", F.when(F.col("_t").isNotNull(), "template").when(F.col("_c").isNotNull(), "cache")
                        .when(F.col("text_en").isNotNull(), "model")).drop("_t", "_c"))


def grouped_number(amount: Column) -> Column:
    return F.format_number(amount.cast("decimal(18,0)"), 0)


def price_board(prices: DataFrame, by: str, template: Column, unavailable: Column) -> DataFrame:
    """One message per board: grades by falling price, a range where both ends are known.

    Price rows are (grade, price, low, high); a board whose rows have no price is unavailable.
    A board lists the grades of one market, so its rows are aggregated to grades before they are collected.
    """
    amount = (F.when((F.col("low") > 0) & (F.col("high") > 0), F.concat(grouped_number(F.col("low")), F.lit("-"), grouped_number(F.col("high"))))
               .otherwise(grouped_number(F.col("price"))))
    line = F.when(F.col("price").isNotNull(), F.struct((-F.col("price")).alias("o"), F.col("grade").alias("g"), amount.alias("a")))
    boards = prices.groupBy(by).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    body = F.array_join(F.transform("lines", lambda x: F.concat_ws(" ", x["g"], x["a"])), "; ")
    return boards.select(by, F.when(F.size("lines") == 0, unavailable).otherwise(F.replace(template, F.lit("{body}"), body)).alias("board"))


def placeholders(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))))


def template_lint(templates: DataFrame, base: str = "en", local: str = "lg", longest: int = 160) -> DataFrame:
    """One row per template with its faults: a language missing, too long, other placeholders, unverified.

    Template rows are (template_id, en, lg, lg_verified), wide.
    """
    en, lg = F.coalesce(F.col(base), F.lit("")), F.coalesce(F.col(local), F.lit(""))
    return templates.select(
        "template_id", ((en == "") | (lg == "")).alias("missing_language"),
        ((F.char_length(en) > longest) | (F.char_length(lg) > longest)).alias("too_long"),
        (placeholders(en) != placeholders(lg)).alias("other_placeholders"),
        (~F.coalesce(F.col("lg_verified"), F.lit(False))).alias("unverified"))


def lint_report(lint: DataFrame) -> DataFrame:
    return lint.agg(F.count("*").alias("templates"), *[F.count_if(F.col(c)).alias(c) for c in
                                                       ("missing_language", "too_long", "other_placeholders", "unverified")])


def citation_check(entries: DataFrame, registry: DataFrame, sources: str = "sources", key: str = "source_id") -> DataFrame:
    """(entry_id, source) of every citation that no registry row backs."""
    cited = entries.select("entry_id", F.explode(sources).alias("source"))
    return cited.join(registry.select(F.col(key).alias("source")).distinct(), "source", "left_anti").select("entry_id", "source").distinct()

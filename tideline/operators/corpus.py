"""Corpus curation: union, decontamination, ambiguity, duplicates, capping, reports."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions.text import strip, text_key, topic_slug
from tideline.operators.scan import row_position, running


def union_sources(*frames: DataFrame) -> DataFrame:
    """All sources in one schema; a column a source lacks is null."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


CORPUS_COLUMNS = ("text", "label", "group", "source_id", "kind", "reason")
MIN_CHARS = 3


def photo_rows(records: DataFrame, flagged: str, **keep) -> DataFrame:
    """Corpus rows of described photos (id, label, group, descriptions, image_quality, label_consistency).

    ``reason`` says why a row is left out, null if it is not.
    """
    rows = records.withColumn("text", F.explode("descriptions"))
    reason = quality_reason(F.col("label_consistency"), F.col("image_quality"), F.col("text").rlike(flagged), **keep)
    return rows.select("text", "label", "group", F.col("id").alias("source_id"), F.lit("photo").alias("kind"), reason.alias("reason"))


def batch_rows(records: DataFrame) -> DataFrame:
    """Corpus rows of generated batches (batch_id, group, kind, label, messages)."""
    rows = records.select("*", F.posexplode("messages").alias("_no", "text"))
    return rows.select("text", "label", "group", F.concat_ws("#", "batch_id", "_no").alias("source_id"), F.coalesce("kind", F.lit("other")).alias("kind"),
                       F.when(F.char_length(strip("text")) < MIN_CHARS, "too_short").alias("reason"))


def sms_rows(records: DataFrame, labels: dict[str, str], block: int = 8, small_block: int = 4, small_source: str = "handwritten") -> DataFrame:
    """Corpus rows of messages (id, text, topic, source): the label comes from the topic, a group is
    a block of a topic's usable messages in order, with smaller blocks for the small source."""
    names = F.str_to_map(F.lit("\x02".join(f"{k}\x01{v}" for k, v in labels.items())), F.lit("\x02"), F.lit("\x01"))
    text = strip(F.coalesce("text", F.lit("")))
    rows = records.select("id", text.alias("text"), "topic", "source", F.try_element_at(names, F.coalesce("topic", F.lit(""))).alias("label"))
    reason = F.when(F.col("label").isNull(), "unmapped_topic").when(F.char_length("text") < MIN_CHARS, "too_short")
    rows = rows.withColumn("reason", reason)
    rows = running(rows, ["topic"], ["id"], sums={"_n": F.col("reason").isNull().cast("long")})
    size = F.when(F.col("source") == small_source, small_block).otherwise(block)
    group = F.format_string("sms-%s-%03d", topic_slug("topic"), F.floor(F.col("_n") / size))
    return rows.select("text", "label", group.alias("group"), F.concat(F.lit("sms#"), "id").alias("source_id"), F.lit("sms").alias("kind"), "reason")


def quality_reason(consistency: Column, image_quality: Column, flagged: Column, keep_flagged: bool = False,
                   keep_inconsistent: bool = False) -> Column:
    """Why a described photo is left out, or null. ``flagged``: its text holds a word it should not."""
    reason = F.lit(None).cast("string") if keep_flagged else F.when(flagged, "flagged")
    if keep_inconsistent:
        return reason
    return (F.when(F.coalesce(consistency == "no", F.lit(False)), "inconsistent")
             .when(F.coalesce(image_quality == "poor", F.lit(False)), "poor_image").otherwise(reason))


def decontaminate(corpus: DataFrame, heldout: DataFrame, key: Column | None = None) -> DataFrame:
    """Rows whose normal form equals no held-out text.

    ``key`` is given where the comparison key is already a column of both sides. Held-out keys are
    made distinct first. Whether they are broadcast is left to the sizes AQE measures.
    """
    key = text_key("text") if key is None else key
    keys = heldout.select(key.alias("_key")).distinct()
    return corpus.withColumn("_key", key).join(keys, "_key", "left_anti").drop("_key")


def ambiguous_keys(corpus: DataFrame, key: str, label: str) -> DataFrame:
    """Keys seen under two labels or more. Pairs are made distinct on the map side, so a text
    with very many copies sends a few rows."""
    return corpus.groupBy(key).agg(F.count_distinct(label).alias("labels")).filter("labels > 1").select(key)


def drop_ambiguous(corpus: DataFrame, key: Column | None = None, label: str = "label") -> DataFrame:
    """Drops every copy of a text that is seen under two labels."""
    keyed = corpus.withColumn("_key", text_key("text") if key is None else key)
    return keyed.join(ambiguous_keys(keyed, "_key", label), "_key", "left_anti").drop("_key")


def first_per_key(df: DataFrame, key: Column, row_id: str, priority: Column | None = None, priorities: int = 1) -> DataFrame:
    """One row per key: the best priority (0 to ``priorities`` - 1), then the smallest id.

    The winner is found from key, priority and id by a hash aggregate that combines on the map side: the least id of
    each priority, of which the first that exists wins. Full rows move once, by their id, which is never skewed.
    """
    rank = F.lit(0) if priority is None else priority
    least = [F.min(F.when(rank == p, F.col(row_id))).alias(f"_least{p}") for p in range(priorities)]
    best = df.groupBy(key.alias("_key")).agg(*least)
    return df.join(best.select(F.coalesce(*[f"_least{p}" for p in range(priorities)]).alias(row_id)), row_id, "left_semi")


def dedup_protected(df: DataFrame, order: Sequence[str], key: Column | None = None, split: str = "split",
                    row_id: str = "id") -> DataFrame:
    """One row per normal form, kept in the most protected split."""
    rank = F.lit(len(order))
    for i, name in reversed(list(enumerate(order))):
        rank = F.when(F.col(split) == name, i).otherwise(rank)
    return first_per_key(df, text_key("text") if key is None else key, row_id, rank, len(order) + 1)


def seeded(seed: int, key) -> Column:
    """Repeatable random order of rows."""
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")), 256)


def pick_per_group(df: DataFrame, group: Sequence[str], n: int, seed: int, row_id: str = "id") -> DataFrame:
    """At most ``n`` rows per group in seeded order.

    The filter on the rank lets Spark keep n rows per group in every map task before the shuffle.
    """
    w = Window.partitionBy(*group).orderBy(seeded(seed, row_id), row_id)
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")


def shuffled_limit(df: DataFrame, n: int, seed: int, row_id: str = "id") -> DataFrame:
    """The first ``n`` rows of the seeded order (a pilot selection)."""
    return df.orderBy(seeded(seed, row_id), row_id).limit(n)


def block_groups(df: DataFrame, topic: str, size: int, row_id: str = "id") -> DataFrame:
    """Adds ``block``: the n-th row of a topic belongs to block n div size."""
    out = row_position(df, [topic], [row_id], "_n")
    return out.withColumn("block", F.format_string("%s-%03d", F.col(topic), F.floor(F.col("_n") / size))).drop("_n")


def budget_cutoff(df: DataFrame, cost: str, limit, row_id: str = "id") -> DataFrame:
    """Rows started before the spend reached the limit; the row that crosses it is kept."""
    out = running(df, [], [row_id], sums={"spent_before": F.col(cost)})
    return out.filter(F.col("spent_before") < limit)


def resume_todo(jobs: DataFrame, done: DataFrame, on: str, fold_case: bool = False) -> DataFrame:
    """Jobs whose id (or case-folded text) is not done yet."""
    fold = (lambda c: F.unhex(F.sha2(F.lower(c), 256))) if fold_case else (lambda c: F.col(c))
    return (jobs.withColumn("_id", fold(on)).join(done.select(fold(on).alias("_id")).distinct(), "_id", "left_anti")
            .drop("_id"))


def batch_plan(topics: DataFrame, topic: str, wanted: str, batch: int) -> DataFrame:
    """Batches to request per topic, the last one smaller."""
    n = F.ceil(F.col(wanted) / batch)
    rows = topics.withColumn("batch_no", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)))
    return (rows.withColumn("requested", F.least(F.lit(batch).cast("long"), F.col(wanted) - F.col("batch_no") * batch))
            .withColumn("batch_id", F.concat_ws("-", topic, "batch_no")))


def upsample(small: DataFrame, times: int) -> DataFrame:
    return small.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.lit(times)))).drop("_copy")


def seeded_holdout(df: DataFrame, at_most: int, share: int, seed: int, row_id: str = "id") -> DataFrame:
    """Adds ``part``: the first min(at_most, n div share) rows of the seeded order are the test part.

    The test rows are few by definition (``at_most``); every task keeps no more than that.
    """
    first = df.select(row_id).orderBy(seeded(seed, row_id), row_id).limit(min(at_most, df.count() // share))
    return (df.join(first.withColumn("_test", F.lit(True)), row_id, "left")
            .withColumn("part", F.when(F.col("_test"), "test").otherwise("train")).drop("_test"))


# ---- reports --------------------------------------------------------------------------------
def split_report(df: DataFrame, splits: Sequence[str]) -> DataFrame:
    """Texts and different groups per label and split."""
    return (df.groupBy("label").pivot("split", list(splits))
            .agg(F.count(F.lit(1)).alias("texts"), F.count_distinct("group").alias("groups")).fillna(0))


def drop_report(df: DataFrame, reason: str) -> DataFrame:
    return (df.filter(F.col(reason).isNotNull()).groupBy(F.col(reason).alias("reason"))
            .agg(F.count("*").alias("dropped")).orderBy(F.desc("dropped"), "reason"))


def balance_warnings(df: DataFrame, splits: Sequence[str], least: int = 30, train: str = "train") -> DataFrame:
    """One row per warning: small cell, empty cell, unbalanced training classes.

    The rows are counted once; everything after works on one row per label.
    """
    wide = df.groupBy("label").pivot("split", list(splits)).agg(F.count(F.lit(1))).fillna(0)
    labels = Window.partitionBy(F.lit(1))
    # Classes without a training row do not count for the balance, they are reported as empty.
    held = F.when(F.col(train) > 0, F.col(train))
    wide = wide.select("*", F.max(held).over(labels).alias("_hi"), F.min(held).over(labels).alias("_lo"), F.min("label").over(labels).alias("_first"))

    def warning(cond, label, split, name, n):
        return F.when(cond, F.struct(label.alias("label"), F.lit(split).alias("split"), F.lit(name).alias("warning"), n.cast("long").alias("n")))

    found = [warning(F.col(s) < least, F.col("label"), s, "small", F.col(s)) for s in splits if s != train]
    found += [warning(F.col(s) == 0, F.col("label"), s, "empty", F.col(s)) for s in splits]
    found.append(warning((F.col("_hi") > 2 * F.col("_lo")) & (F.col("label") == F.col("_first")), F.lit("*"), train, "unbalanced", F.col("_hi")))
    return wide.select(F.explode(F.array_compact(F.array(*found))).alias("w")).select("w.*")


def straddling_groups(df: DataFrame, by: str = "group") -> DataFrame:
    """Groups with rows in more than one split."""
    return df.groupBy(by).agg(F.count_distinct("split").alias("splits")).filter("splits > 1")


def without_straddling(df: DataFrame, by: str = "group") -> DataFrame:
    """``df`` itself; raises, with some of the groups, if a group has rows in more than one split. ``df`` is read for it, so store it first."""
    torn = straddling_groups(df.select(by, "split"), by).limit(5).collect()
    if torn:
        raise ValueError("in more than one split: " + ", ".join(sorted(str(r[by]) for r in torn)))
    return df


def group_label_check(df: DataFrame) -> DataFrame:
    """Groups that appear under two labels; must be empty before a split is made."""
    return df.groupBy("group").agg(F.count_distinct("label").alias("labels")).filter("labels > 1")


def group_report(df: DataFrame) -> DataFrame:
    """Items, groups, largest group and groups of one, per label."""
    sizes = df.groupBy("label", "group").agg(F.count("*").alias("size"))
    return sizes.groupBy("label").agg(F.sum("size").alias("items"), F.count("*").alias("groups"),
                                      F.max("size").alias("largest"), F.count_if(F.col("size") == 1).alias("singletons"))


def largest_groups(df: DataFrame, group: Column, n: int) -> DataFrame:
    return (df.groupBy(group.alias("group")).agg(F.count("*").alias("size"))
            .orderBy(F.desc("size"), "group").limit(n))


def topic_draw(df: DataFrame, weights: dict[str, float], seed: int, row_id: str = "id") -> DataFrame:
    """Adds ``topic``: a weighted draw that is the same on every run.

    The hash gives each row a point in [0, 1); cumulated weights cut that line.
    """
    total = sum(weights.values())
    point = F.conv(F.substring(seeded(seed, row_id), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    cum, case = 0.0, None
    for name, weight in weights.items():
        cum += weight / total
        case = F.when(point < cum, name) if case is None else case.when(point < cum, name)
    return df.withColumn("topic", case.otherwise(name))


def distinct_in_order(df: DataFrame, text: str, row_id: str = "id") -> DataFrame:
    """Distinct texts, each with its first row."""
    return first_per_key(df, F.unhex(F.sha2(F.col(text), 256)), row_id)



"""Corpus curation over documents: filters, duplicates, splits, reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.dims import fixed
from tideline.functions import text as tx
from tideline.operators import corpus as co
from tideline.operators import splits as sp
from tideline.operators.scan import row_position
from tideline.plans.registry import query, quoted, sql_norm, sql_strip, table
from tideline.plans.text import FLAG_RE, dim, sql_word_matches
from tideline.session import cut_lineage

BLOCK, GAP = 20, 4
HELD_OUT = ("src0", "src1")
SPLITS = fixed.SPLITS
BANNED_RE_SQL = f"len({sql_word_matches('c', dim.BANNED_WORDS)}) > 0"


def corpus(spark, sf):
    """Documents as a labelled corpus: half of the sources photo captions, half messages."""
    src = F.regexp_extract("source", r"(\d+)", 1).cast("int")
    kind = F.when(src < 10, "photo").otherwise("sms")
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), "text", F.col("lang").alias("label"), "source", "n_chars",
        F.concat_ws("-", "lang", "source").alias("group"), kind.alias("kind"),
        F.concat(F.lit("docs/"), "n_chars", F.lit("_"), "doc_id", F.lit(".jpg")).alias("source_id"))
    return docs.withColumn("unit", tx.unit_key("kind", "source_id", "label", "group", BLOCK))


SQL_CORPUS = f"""corpus AS (SELECT *, CASE WHEN kind = 'photo' THEN format('{{}}-blk{{:04d}}', label, id // {BLOCK})
      ELSE "group" END AS unit, {sql_norm('text')} AS key
    FROM (SELECT doc_id AS id, text, lang AS label, source, n_chars, lang || '-' || source AS "group",
          CASE WHEN CAST(substr(source, 4) AS INT) < 10 THEN 'photo' ELSE 'sms' END AS kind,
          'docs/' || n_chars || '_' || doc_id || '.jpg' AS source_id FROM documents))"""


def sql_walk(units: str, name: str = "placed", start: str | None = None) -> str:
    """Recursive placement of ``units`` (label, unit, weight); needs WITH RECURSIVE."""
    pick = "CASE WHEN la >= lb AND la >= lc THEN 'train' WHEN lb >= lc THEN 'calib' ELSE 'test' END"
    first = start or "SELECT DISTINCT label, 0::HUGEINT AS a, 0::HUGEINT AS b, 0::HUGEINT AS c FROM " + units
    return f"""{name}_u AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY weight DESC, sha256('0:' || unit)) AS k
      FROM {units}),
    {name}_w AS (
      SELECT label, 0::BIGINT AS k, a, b, c, ''::VARCHAR AS unit, 0::BIGINT AS weight, ''::VARCHAR AS split FROM ({first})
      UNION ALL
      SELECT label, k, a + CASE WHEN s = 'train' THEN weight ELSE 0 END, b + CASE WHEN s = 'calib' THEN weight ELSE 0 END,
             c + CASE WHEN s = 'test' THEN weight ELSE 0 END, unit, weight, s
      FROM (SELECT *, {pick} AS s FROM (
        SELECT u.label, u.k, w.a, w.b, w.c, u.unit, u.weight,
               0.7::DOUBLE * (w.a + w.b + w.c + u.weight)::DOUBLE - w.a::DOUBLE AS la,
               0.15::DOUBLE * (w.a + w.b + w.c + u.weight)::DOUBLE - w.b::DOUBLE AS lb,
               0.15::DOUBLE * (w.a + w.b + w.c + u.weight)::DOUBLE - w.c::DOUBLE AS lc
        FROM {name}_w w JOIN {name}_u u ON u.label = w.label AND u.k = w.k + 1))),
    {name} AS (SELECT label, unit, weight, split FROM {name}_w WHERE k > 0)"""


SQL_UNITS = "units AS (SELECT label, unit, count(*) AS weight FROM corpus GROUP BY 1, 2)"
SQL_SPLIT = f"""{SQL_CORPUS}, {SQL_UNITS}, {sql_walk('units')},
    rows_ AS (SELECT c.*, p.split FROM corpus c JOIN placed p USING (unit))"""


def split_corpus(spark, sf):
    rows = corpus(spark, sf)
    assignment = sp.allocate_splits(sp.unit_weights(rows))
    return sp.apply_splits(rows, assignment), assignment


# ---- filters --------------------------------------------------------------------------------
@query("quality_filter", f"""
    SELECT coalesce(CASE WHEN toxic = 1 THEN 'inconsistent' WHEN quality = 0 THEN 'poor_image'
        WHEN len({sql_word_matches('text', dim.FLAG_WORDS)}) > 0 THEN 'flagged' END, 'kept') AS reason,
        count(*) AS n FROM documents LEFT JOIN labels USING (doc_id) GROUP BY 1""")
def _(spark, sf):
    # The text is judged before the join, so only the verdict is shuffled.
    docs = table(spark, sf, "documents").select("doc_id", F.col("text").rlike(FLAG_RE).alias("flagged"))
    docs = docs.join(table(spark, sf, "labels"), "doc_id", "left")
    reason = co.quality_reason(F.when(F.col("toxic") == 1, "no").otherwise("yes"),
                               F.when(F.col("quality") == 0, "poor").otherwise("ok"), F.col("flagged"))
    return docs.groupBy(F.coalesce(reason, F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("drop_report", f"""
    SELECT reason, count(*) AS dropped FROM (
      SELECT CASE WHEN toxic = 1 THEN 'inconsistent' WHEN quality = 0 THEN 'poor_image'
        WHEN length(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) < 3 THEN 'too_short'
        WHEN len({sql_word_matches('text', dim.BANNED_WORDS)}) > 0 THEN 'banned' END AS reason
      FROM documents LEFT JOIN labels USING (doc_id)) WHERE reason IS NOT NULL GROUP BY 1""")
def _(spark, sf):
    own = F.when(F.char_length(tx.strip("text")) < 3, "too_short").when(F.col("text").rlike(tx.whole("|".join(dim.BANNED_WORDS))), "banned")
    docs = table(spark, sf, "documents").select("doc_id", own.alias("own")).join(table(spark, sf, "labels"), "doc_id", "left")
    quality = co.quality_reason(F.when(F.col("toxic") == 1, "no"), F.when(F.col("quality") == 0, "poor"), F.lit(False), keep_flagged=True)
    return co.drop_report(docs.select(F.coalesce(quality, "own").alias("why")), "why")


@query("decontaminate", f"""
    WITH {SQL_CORPUS} SELECT id, source FROM corpus WHERE source NOT IN ({quoted(HELD_OUT)})
      AND key NOT IN (SELECT key FROM corpus WHERE source IN ({quoted(HELD_OUT)}))""")
def _(spark, sf):
    rows = corpus(spark, sf).select("id", "source", "text")
    held = F.col("source").isin(*HELD_OUT)
    return co.decontaminate(rows.filter(~held), rows.filter(held)).select("id", "source")


@query("drop_ambiguous", f"""
    WITH {SQL_CORPUS} SELECT id, source AS label FROM corpus
    WHERE key NOT IN (SELECT key FROM corpus GROUP BY key HAVING count(DISTINCT source) > 1)""")
def _(spark, sf):
    rows = corpus(spark, sf).select("id", "text", F.col("source").alias("label"))
    return co.drop_ambiguous(rows).select("id", "label")


@query("resume_todo", """
    SELECT doc_id, 'id' AS by FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
    UNION ALL
    SELECT d.doc_id, 'text' FROM documents d WHERE lower(d.text) NOT IN
      (SELECT lower(text) FROM documents WHERE source IN ('src2', 'src3'))""")
def _(spark, sf):
    docs = table(spark, sf, "documents")
    by_id = co.resume_todo(docs.select("doc_id"), table(spark, sf, "labels"), "doc_id").withColumn("by", F.lit("id"))
    done = docs.filter(F.col("source").isin("src2", "src3"))
    by_text = co.resume_todo(docs.select("doc_id", "text"), done, "text", fold_case=True)
    return by_id.unionByName(by_text.select("doc_id", F.lit("text").alias("by")))


@query("batch_plan", """
    SELECT source || '-' || b AS batch_id, least(15, n - b * 15) AS requested
    FROM (SELECT source, n, unnest(range(0, CAST(ceil(n / 15.0) AS BIGINT))) AS b
          FROM (SELECT source, count(*) AS n FROM documents GROUP BY 1))""")
def _(spark, sf):
    wanted = table(spark, sf, "documents").groupBy("source").agg(F.count("*").alias("n"))
    return co.batch_plan(wanted, "source", "n", 15).select("batch_id", "requested")


# ---- set operations -------------------------------------------------------------------------
@query("union_sources", """
    SELECT origin, count(*) AS n, count(label) AS labelled, count(role) AS with_role, CAST(sum(length(text)) AS BIGINT) AS chars
    FROM (SELECT 'doc' AS origin, text, lang AS label, NULL AS role FROM documents
          UNION ALL SELECT 'bench', text, NULL, NULL FROM benchmark
          UNION ALL SELECT 'conv', text, NULL, role FROM conversations) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.lit("doc").alias("origin"), "text", F.col("lang").alias("label"))
    bench = table(spark, sf, "benchmark").select(F.lit("bench").alias("origin"), "text")
    conv = table(spark, sf, "conversations").select(F.lit("conv").alias("origin"), "text", "role")
    return (co.union_sources(docs, bench, conv).groupBy("origin")
            .agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.count("role").alias("with_role"),
                 F.sum(F.char_length("text")).alias("chars")))


# Documents as described photos (a line is a description), turns as generated batches (a line is a
# message), parts as messages with a topic.
PART_TOPICS = {"ECONOMY": "leaf_rust", "SMALL": "phoma", "LARGE": "healthy", "PROMO": "other"}


@query("load_rows", f"""
    WITH p AS (SELECT unnest(string_split(text, chr(10))) AS text, lang AS label, source AS "group", 'd' || doc_id AS source_id, 'photo' AS kind,
        toxic = 1 AS bad, quality = 0 AS poor FROM documents LEFT JOIN labels USING (doc_id)),
    b AS (SELECT conv_id, turn, role, list_zip(string_split(text, chr(10)), range(len(string_split(text, chr(10))))) AS ms FROM conversations),
    s AS (SELECT *, CASE WHEN label IS NULL THEN 'unmapped_topic' WHEN length(text) < 3 THEN 'too_short' END AS reason FROM (
        SELECT p_partkey AS id, p_name AS text, p_type AS topic, p_size, CASE p_type {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in PART_TOPICS.items())} END AS label
        FROM part)),
    n AS (SELECT *, count(*) FILTER (reason IS NULL) OVER (PARTITION BY topic ORDER BY id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS n FROM s)
    SELECT md5(text) AS text_md5, label, "group", source_id, kind,
      CASE WHEN bad THEN 'inconsistent' WHEN poor THEN 'poor_image' WHEN len({sql_word_matches('text', dim.FLAG_WORDS)}) > 0 THEN 'flagged' END AS reason FROM p
    UNION ALL
    SELECT md5(m[1]), 'other', 'c' || conv_id, 'c' || conv_id || '-' || turn || '#' || m[2], CASE role WHEN 'user' THEN 'ask' ELSE 'other' END,
      CASE WHEN length(regexp_replace(m[1], '^\\s+|\\s+$', '', 'g')) < 3 THEN 'too_short' END FROM (SELECT *, unnest(ms) AS m FROM b)
    UNION ALL
    SELECT md5(text), label, format('sms-{{}}-{{:03d}}', lower(topic), n // CASE WHEN p_size > 40 THEN 4 ELSE 8 END), 'sms#' || id, 'sms', reason FROM n""")
def _(spark, sf):
    docs = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    photos = docs.select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("lang").alias("label"), F.col("source").alias("group"),
                         F.split("text", "\n").alias("descriptions"), F.when(F.col("quality") == 0, "poor").alias("image_quality"),
                         F.when(F.col("toxic") == 1, "no").alias("label_consistency"))
    batches = table(spark, sf, "conversations").select(
        F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("batch_id"), F.concat(F.lit("c"), "conv_id").alias("group"),
        F.when(F.col("role") == "user", "ask").alias("kind"), F.lit("other").alias("label"), F.split("text", "\n").alias("messages"))
    sms = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("text"), F.col("p_type").alias("topic"),
                                          F.when(F.col("p_size") > 40, "handwritten").otherwise("generated").alias("source"))
    rows = co.union_sources(co.photo_rows(photos, FLAG_RE), co.batch_rows(batches), co.sms_rows(sms, PART_TOPICS))
    return rows.select(F.md5(F.col("text").cast("binary")).alias("text_md5"), "label", "group", "source_id", "kind", "reason")


@query("upsample", """
    SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM (
      SELECT source, n_chars FROM documents WHERE lang = 'en'
      UNION ALL SELECT source, n_chars FROM documents, range(3) WHERE lang <> 'en') GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("source", "lang", "n_chars")
    both = docs.filter("lang = 'en'").unionByName(co.upsample(docs.filter("lang <> 'en'"), 3))
    return both.groupBy("source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


@query("distinct_in_order", "SELECT min(doc_id) AS id, md5(text) AS text_md5 FROM documents GROUP BY text")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return co.distinct_in_order(docs, "text").select("id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


@query("todo_except_done", "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels"), "doc_id", "left_anti")


@query("seeded_holdout", """
    SELECT id, CASE WHEN r <= least(50, n // 4) THEN 'test' ELSE 'train' END AS part FROM (
      SELECT doc_id AS id, row_number() OVER (ORDER BY sha256('7:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)""")
def _(spark, sf):
    return co.seeded_holdout(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), 50, 4, seed=7)


# ---- per-group picks and order-dependent groups ---------------------------------------------
@query("one_per_group", """
    SELECT doc_id AS id, source FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY sha256('0:' || doc_id), doc_id) AS r
      FROM documents) WHERE r = 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return co.pick_per_group(docs, ["source"], 1, seed=0)


@query("cap_per_class", """
    SELECT id, lang FROM (SELECT doc_id AS id, lang, row_number() OVER (PARTITION BY lang ORDER BY sha256('3:' || doc_id), doc_id) AS r
      FROM documents) WHERE r <= 40 ORDER BY sha256('4:' || id), id LIMIT 100""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "lang")
    return co.shuffled_limit(co.pick_per_group(docs, ["lang"], 40, seed=3), 100, seed=4)


@query("block_groups", """
    SELECT doc_id AS id, source || '-' || format('{:03d}', (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8)
      AS block FROM documents""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "source")
    return co.block_groups(docs, "source", 8).select("id", "block")


@query("budget_cutoff", """
    SELECT id, round(before, 6) AS spent_before FROM (SELECT doc_id AS id,
      coalesce(sum(n_chars / 3.5::DOUBLE * 0.001::DOUBLE) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM documents) WHERE before < 250""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(
        F.col("doc_id").alias("id"), (F.col("n_chars") / 3.5 * 0.001).alias("cost"))
    return co.budget_cutoff(docs, "cost", 250).select("id", F.round("spent_before", 6).alias("spent_before"))


@query("topic_draw", """
    SELECT topic, count(*) AS n FROM (SELECT CASE WHEN p < 0.5::DOUBLE THEN 'yield' WHEN p < 0.5::DOUBLE + 0.3::DOUBLE THEN 'price'
      ELSE 'greeting' END AS topic FROM (SELECT CAST('0x' || substr(sha256('11:' || doc_id), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS p
      FROM documents)) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"))
    return co.topic_draw(docs, {"yield": 5, "price": 3, "greeting": 2}, seed=11).groupBy("topic").agg(F.count("*").alias("n"))


# ---- splits ---------------------------------------------------------------------------------
@query("allocate_splits", f"WITH RECURSIVE {SQL_CORPUS}, {SQL_UNITS}, {sql_walk('units')} SELECT label, unit, weight, split FROM placed")
def _(spark, sf):
    return sp.allocate_splits(sp.unit_weights(corpus(spark, sf)))


FROZEN_CASE = "CASE WHEN label = 'fr' THEN 'train' WHEN unit LIKE '%src1_' THEN 'test' WHEN unit LIKE '%blk___3' THEN 'calib' END"


@query("frozen_splits", f"""
    WITH RECURSIVE {SQL_CORPUS}, {SQL_UNITS}, known AS (SELECT *, {FROZEN_CASE} AS frozen FROM units),
    todo AS (SELECT label, unit, weight FROM known WHERE frozen IS NULL),
    {sql_walk('todo', start='''SELECT label, coalesce(sum(weight) FILTER (frozen = 'train'), 0) AS a,
      coalesce(sum(weight) FILTER (frozen = 'calib'), 0) AS b, coalesce(sum(weight) FILTER (frozen = 'test'), 0) AS c
      FROM known GROUP BY label''')}
    SELECT label, unit, weight, split FROM placed
    UNION ALL SELECT label, unit, weight, frozen FROM known WHERE frozen IS NOT NULL""")
def _(spark, sf):
    units = sp.unit_weights(corpus(spark, sf))
    frozen = units.select("unit", F.expr(FROZEN_CASE).alias("split")).filter("split IS NOT NULL")
    return sp.allocate_splits(units, frozen)


@query("hash_splits", """
    SELECT split, count(*) AS n FROM (SELECT CASE WHEN p < CAST(floor(0.7::DOUBLE * 4294967296) AS BIGINT) THEN 'train'
      WHEN p < CAST(floor(0.85::DOUBLE * 4294967296) AS BIGINT) THEN 'calib' ELSE 'test' END AS split
      FROM (SELECT CAST('0x' || substr(sha256('0:' || vec_id), 1, 8) AS BIGINT) AS p FROM embeddings)) GROUP BY 1""")
def _(spark, sf):
    return sp.hash_splits(table(spark, sf, "embeddings").select("vec_id"), "vec_id").groupBy("split").agg(F.count("*").alias("n"))


SQL_NEIGHBOUR = f"""near_ AS (SELECT r.*, n.split IS NOT NULL AND n.split <> r.split AS near_other FROM
      (SELECT *, CASE WHEN kind = 'photo' AND id % {BLOCK} < {GAP} THEN format('{{}}-blk{{:04d}}', label, id // {BLOCK} - 1)
         WHEN kind = 'photo' AND id % {BLOCK} >= {BLOCK - GAP} THEN format('{{}}-blk{{:04d}}', label, id // {BLOCK} + 1) END AS nb
       FROM rows_) r LEFT JOIN placed n ON n.unit = r.nb)"""


@query("gap_exclusion", f"WITH RECURSIVE {SQL_SPLIT}, {SQL_NEIGHBOUR} SELECT id, unit, split FROM near_ WHERE NOT near_other")
def _(spark, sf):
    rows, assignment = split_corpus(spark, sf)
    return sp.gap_exclusion(rows, assignment, BLOCK, GAP).select("id", "unit", "split")


SQL_DEDUP = """(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY
      CASE split WHEN 'test' THEN 0 WHEN 'calib' THEN 1 ELSE 2 END, id) AS rn FROM {}) WHERE rn = 1)"""


@query("dedup_protected", f"WITH RECURSIVE {SQL_SPLIT} SELECT id, split FROM {SQL_DEDUP.format('rows_')}")
def _(spark, sf):
    rows, _ = split_corpus(spark, sf)
    return co.dedup_protected(rows.select("id", "text", "split"), fixed.PROTECTED_ORDER).select("id", "split")


def pivot_sql(source: str) -> str:
    cells = ", ".join(f"count(*) FILTER (split = '{s}') AS {s}_texts, count(DISTINCT \"group\") FILTER (split = '{s}') AS {s}_groups"
                      for s in SPLITS)
    return f"SELECT label, {cells} FROM {source} GROUP BY label"


@query("split_report", f"WITH RECURSIVE {SQL_SPLIT} {pivot_sql('rows_')}")
def _(spark, sf):
    return co.split_report(split_corpus(spark, sf)[0].select("label", "split", "group"), SPLITS)


SQL_CURATED = f"""{SQL_CORPUS.replace('corpus AS', 'base AS', 1)},
    clean AS (SELECT * FROM base WHERE source NOT IN ({quoted(HELD_OUT)}) AND length(text) >= 3
      AND key NOT IN (SELECT key FROM base WHERE source IN ({quoted(HELD_OUT)}))),
    corpus AS (SELECT * FROM clean WHERE key NOT IN (SELECT key FROM clean GROUP BY key HAVING count(DISTINCT label) > 1)),
    {SQL_UNITS}, {sql_walk('units')}, rows_ AS (SELECT c.*, p.split FROM corpus c JOIN placed p USING (unit)),
    {SQL_NEIGHBOUR}, gapped AS (SELECT * EXCLUDE (nb, near_other) FROM near_ WHERE NOT near_other),
    final AS {SQL_DEDUP.format('gapped')}"""


def curated(spark, sf):
    """The whole chain in its fixed order: held-out texts, ambiguity, units, splits, gap, duplicates.

    From the first step on a text is its 32-byte key. The clean rows feed the unit weights, the
    placing and the split rows, so they are stored once instead of being derived three times.
    """
    key = F.col("key")
    rows = (corpus(spark, sf).withColumn("key", tx.text_key("text")).filter(F.char_length("text") >= 3)
            .drop("text", "n_chars"))
    held = F.col("source").isin(*HELD_OUT)
    clean = co.decontaminate(rows.filter(~held), rows.filter(held), key)
    clean = cut_lineage(co.drop_ambiguous(clean, key))
    assignment = sp.allocate_splits(sp.unit_weights(clean))
    placed = sp.gap_exclusion(sp.apply_splits(clean, assignment), assignment, BLOCK, GAP)
    kept = cut_lineage(co.dedup_protected(placed, fixed.PROTECTED_ORDER, key))
    return co.without_straddling(kept, "unit")


@query("curated_corpus", f"WITH RECURSIVE {SQL_CURATED} {pivot_sql('final')}")
def _(spark, sf):
    return co.split_report(curated(spark, sf), SPLITS)


@query("balance_warnings", f"""
    WITH RECURSIVE {SQL_SPLIT}, counts AS (SELECT label, split, count(*) AS n FROM rows_ GROUP BY 1, 2),
    cells AS (SELECT label, split, coalesce(n, 0) AS n FROM (SELECT DISTINCT label FROM counts)
      CROSS JOIN (VALUES ('train'), ('calib'), ('test')) s(split) LEFT JOIN counts USING (label, split))
    SELECT label, split, 'small' AS warning, n FROM cells WHERE n < 30 AND split <> 'train'
    UNION ALL SELECT label, split, 'empty', n FROM cells WHERE n = 0
    UNION ALL SELECT '*', 'train', 'unbalanced', hi FROM (SELECT max(n) AS hi, min(n) AS lo FROM counts WHERE split = 'train')
      WHERE hi > 2 * lo""")
def _(spark, sf):
    return co.balance_warnings(split_corpus(spark, sf)[0].select("label", "split"), SPLITS)


@query("straddling_groups", f"""WITH RECURSIVE {SQL_SPLIT} SELECT "group", count(DISTINCT split) AS splits FROM rows_
    GROUP BY 1 HAVING count(DISTINCT split) > 1""")
def _(spark, sf):
    return co.straddling_groups(split_corpus(spark, sf)[0].select("group", "split"))


@query("group_label_check", """SELECT source AS "group", count(DISTINCT lang) AS labels FROM documents GROUP BY 1
    HAVING count(DISTINCT lang) > 1""")
def _(spark, sf):
    return co.group_label_check(table(spark, sf, "documents").select(F.col("source").alias("group"), F.col("lang").alias("label")))


@query("group_report", f"""
    SELECT label, CAST(sum(size) AS BIGINT) AS items, count(*) AS groups, max(size) AS largest, count(*) FILTER (size = 1) AS singletons
    FROM (SELECT lang AS label, {sql_norm('text')} AS k, count(*) AS size FROM documents GROUP BY 1, 2) GROUP BY 1""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("lang").alias("label"), tx.text_key("text").alias("group"))
    return co.group_report(docs)


# ---- sorts and limits -----------------------------------------------------------------------
@query("largest_groups", f"""
    SELECT sha256({sql_norm('text')}) AS "group", count(*) AS size FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 12""")
def _(spark, sf):
    return co.largest_groups(table(spark, sf, "documents"), F.sha2(tx.norm_text("text"), 256), 12)


@query("first_pairs", """
    SELECT conv_id, turn, text FROM conversations WHERE role = 'user' AND text <> '' ORDER BY conv_id, turn LIMIT 30""")
def _(spark, sf):
    return (table(spark, sf, "conversations").filter("role = 'user' AND text <> ''")
            .orderBy("conv_id", "turn").limit(30).select("conv_id", "turn", "text"))


@query("capped_items", f"""
    SELECT 'doc' AS src, doc_id AS id, CAST(0 AS BIGINT) AS seq, substr(text, 1, 500) AS head FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300)
    UNION ALL SELECT 'conv', conv_id, turn, body FROM (SELECT *, {sql_strip('text')} AS body FROM conversations
      WHERE length({sql_strip('text')}) BETWEEN 1 AND 500 ORDER BY conv_id, turn LIMIT 300)""")
def _(spark, sf):
    """The first 300 of each: documents cut at 500 characters, messages that have at most so many; a longer message is refused, not cut."""
    docs = table(spark, sf, "documents").orderBy("doc_id").limit(300).select(
        F.lit("doc").alias("src"), F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("seq"), F.substring("text", 1, 500).alias("head"))
    said = table(spark, sf, "conversations").withColumn("head", tx.strip("text")).filter(F.char_length("head").between(1, 500))
    return docs.unionByName(said.orderBy("conv_id", "turn").limit(300).select(F.lit("conv").alias("src"), F.col("conv_id").alias("id"), F.col("turn").alias("seq"), "head"))


@query("price_order", "SELECT p_partkey, p_retailprice, row_number() OVER (ORDER BY p_retailprice DESC, p_partkey) AS place FROM part")
def _(spark, sf):
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice", (-F.col("p_retailprice")).alias("_down"))
    placed = row_position(parts, [], ["_down", "p_partkey"], "place")
    return placed.select("p_partkey", "p_retailprice", (F.col("place") + 1).alias("place"))

"""Translation metrics: each conversation turn scored against the next one."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.operators import mt
from tideline.operators import splits as sp
from tideline.plans.registry import query, sql_norm, table


def turn_pairs(spark, sf):
    """Turn t as the translation, turn t + 1 as the reference."""
    conv = table(spark, sf, "conversations")
    nxt = conv.select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("ref"))
    return (conv.select("conv_id", "turn", F.col("text").alias("hyp")).join(nxt, ["conv_id", "turn"])
            .select(F.concat_ws(":", "conv_id", "turn").alias("pair_id"), "hyp", "ref"))


SQL_PAIRS = """pairs AS (SELECT a.conv_id || ':' || a.turn AS pair_id, a.text AS hyp, b.text AS ref FROM conversations a
    JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def sql_counts(hyp: str, ref: str, max_n: int, words: bool) -> str:
    """CTE ``counts``; ``hyp`` and ``ref`` are SQL texts, or token lists when ``words``."""
    size = "len({0})" if words else "length({0})"
    gram = "array_to_string({0}[i:i + n - 1], ' ')" if words else "substr({0}, i, n)"
    side = lambda c: (f"SELECT pair_id, n, {gram.format(c)} AS gram FROM (SELECT pair_id, {c}, n, unnest(range(1, {size.format(c)} - n + 2)) AS i "  # noqa: E731
                      f"FROM units, (SELECT unnest(range(1, {max_n + 1})) AS n))")
    return f"""units AS (SELECT pair_id, {hyp} AS h, {ref} AS r FROM pairs),
    grams AS (SELECT pair_id, n, gram, sum(a) AS a, sum(b) AS b FROM (SELECT *, 1 AS a, 0 AS b FROM ({side('h')})
      UNION ALL SELECT *, 0, 1 FROM ({side('r')})) GROUP BY 1, 2, 3),
    counts AS (SELECT pair_id, n, sum(least(a, b)) AS m, sum(a) AS s, sum(b) AS w FROM grams GROUP BY 1, 2)"""


_LOW = r"trim(regexp_replace(lower({}), '\s+', ' ', 'g'))"
_BARE = r"regexp_replace({}, '\s+', '', 'g')"
_F = "coalesce(100 * 5.0::DOUBLE * p * r / nullif(4.0::DOUBLE * p + r, 0), 0)"


@query("chrf_sentence", f"""WITH {SQL_PAIRS}, {sql_counts(_LOW.format('hyp'), _LOW.format('ref'), 6, False)},
    pr AS (SELECT pair_id, avg(m / s) FILTER (s > 0 AND w > 0) AS p, avg(m / w) FILTER (s > 0 AND w > 0) AS r FROM counts GROUP BY 1)
    SELECT pair_id, round(coalesce({_F}, 0), 6) AS chrf FROM pairs LEFT JOIN pr USING (pair_id)""")
def _(spark, sf):
    return mt.chrf_sentence(turn_pairs(spark, sf)).select("pair_id", F.round("chrf", 6).alias("chrf"))


@query("chrf_corpus", f"""WITH {SQL_PAIRS}, {sql_counts(_BARE.format('hyp'), _BARE.format('ref'), 6, False)},
    t AS (SELECT n, sum(m) AS m, sum(s) AS s, sum(w) AS w FROM counts GROUP BY n),
    pr AS (SELECT avg(m / s) AS p, avg(m / w) AS r FROM t WHERE s > 0 AND w > 0) SELECT round({_F}, 6) AS chrf FROM pr""")
def _(spark, sf):
    return mt.chrf_corpus(turn_pairs(spark, sf))


def _sql_13a(c: str) -> str:
    t = c
    for old, new in (("'<skipped>'", "''"), ("'-' || chr(10)", "''"), ("chr(10)", "' '"), ("'&quot;'", "'\"'"), ("'&amp;'", "'&'"),
                     ("'&lt;'", "'<'"), ("'&gt;'", "'>'")):
        t = f"replace({t}, {old}, {new})"
    t = f"(' ' || {t} || ' ')"
    for pattern, new in ((r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", r" \1 "), (r"([^0-9])([\.,])", r"\1 \2 "), (r"([\.,])([^0-9])", r" \1 \2"),
                         (r"([0-9])(-)", r"\1 \2 ")):
        t = f"regexp_replace({t}, '{pattern}', '{new}', 'g')"
    return rf"list_filter(string_split(trim(regexp_replace({t}, '\s+', ' ', 'g')), ' '), lambda w: w <> '')"


@query("bleu_corpus", f"""WITH {SQL_PAIRS}, {sql_counts(_sql_13a('hyp'), _sql_13a('ref'), 4, True)},
    t AS (SELECT n, sum(m) AS m, sum(s) AS s, sum(w) AS w FROM counts GROUP BY n),
    k AS (SELECT *, sum(CAST(m = 0 AS INT)) OVER (ORDER BY n) AS misses FROM t),
    l AS (SELECT count(*) AS orders, sum(m) AS hits, sum(ln(CASE WHEN m = 0 THEN 1 / (2.0::DOUBLE ** misses * s) ELSE m / s END)) AS logs,
      max(s) FILTER (n = 1) AS c, max(w) FILTER (n = 1) AS r FROM k WHERE s > 0),
    b AS (SELECT *, CASE WHEN c < r THEN exp(1 - r / c) ELSE 1.0::DOUBLE END AS bp FROM l)
    SELECT round(CASE WHEN orders = 4 AND hits > 0 THEN bp * exp(logs / 4) * 100 ELSE 0 END, 6) AS bleu, round(bp, 6) AS brevity,
      CAST(c AS BIGINT) AS hyp_tokens, CAST(r AS BIGINT) AS ref_tokens FROM b""")
def _(spark, sf):
    return mt.bleu_corpus(turn_pairs(spark, sf))


@query("heldout_pairs", f"""
    WITH d AS (SELECT *, {sql_norm('text')} AS key, CASE WHEN p < CAST(floor(0.7::DOUBLE * 4294967296) AS BIGINT) THEN 'train'
      WHEN p < CAST(floor(0.85::DOUBLE * 4294967296) AS BIGINT) THEN 'calib' ELSE 'test' END AS split
      FROM (SELECT *, CAST('0x' || substr(sha256('0:' || source), 1, 8) AS BIGINT) AS p FROM documents))
    SELECT doc_id FROM d WHERE key IN (SELECT key FROM d WHERE split <> 'train')""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text", "source")
    return mt.heldout_pairs(docs, sp.hash_splits(docs, "source")).select("doc_id")

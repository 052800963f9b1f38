"""Quality rules per document, and verdicts on whole hosts from shrunken failure rates.

A host is judged by the share of its documents that fail a rule. Shares of small hosts are unsure, so each
is shrunk by a beta prior whose mean and strength are fitted to all hosts. A document is kept if it
passes the base rules itself and no rule's shrunken rate of its host is above the limit.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.worker import slices, texts_of
from tideline.session import cut_lineage

WHITE, SYMBOLS, WINDOW = b" \t\n\r\x0b\x0c", b"#*$%&|<>", 8
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
# Rules, each a condition on the features. The first two are the base rules.
RULES = {
    "too_short": "n_words < 20",
    "repetitive": "100 * n_repeat_words > 30 * n_words",
    "symbols": "10 * n_symbols > n_words",
    "repeated_lines": "n_dup_lines > 5 and 10 * n_dup_lines > n_words",
    "odd_words": "n_words > 0 and (word_chars < 2 * n_words or word_chars > 15 * n_words)",
}
LEAST_STRENGTH = 10.0  # documents that the prior counts for at least, so a host of few documents is never damned by them alone
BASE = ("too_short", "repetitive")


def repeated_words(words: list[bytes]) -> int:
    """Words that lie in a window of eight words found twice or more, the first occurrence included."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    h = np.fromiter(map(hash, words), np.int64, len(words)).view(np.uint64)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for j in range(WINDOW):
            mixed = mixed * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n]
    order = np.argsort(mixed, kind="stable")
    same = mixed[order[1:]] == mixed[order[:-1]]
    if not same.any():
        return 0
    maybe = np.zeros(n, bool)
    maybe[order[1:][same]] = maybe[order[:-1][same]] = True
    seen: dict[tuple, int] = {}
    twice = np.zeros(n, bool)
    for i in np.flatnonzero(maybe).tolist():  # equal numbers are checked on the words themselves
        first = seen.setdefault(tuple(words[i:i + WINDOW]), i)
        if first != i:
            twice[first] = twice[i] = True
    covered = np.zeros(len(words) + 1, np.int64)
    at = np.flatnonzero(twice)
    np.add.at(covered, at, 1)
    np.add.at(covered, at + WINDOW, -1)
    return int((np.cumsum(covered) > 0).sum())


def features_of(text: str) -> tuple[int, int, int, int, int]:
    raw = text.encode()
    words = raw.split()  # at exactly the six white-space bytes
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return (len(words), len(text) - (len(raw) - len(raw.translate(None, WHITE))), len(raw) - len(raw.translate(None, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def with_features(df: DataFrame, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns ``carry`` (all unless given) and the counts; a null text counts as empty, so all are 0."""
    keep = [c for c in (df.columns if carry is None else carry) if c not in FEATURES]
    source = df.select(*keep, F.col(text).alias("_measured"))

    def run(batches):
        for batch in slices(batches):
            cols = zip(*map(features_of, texts_of(batch.column(batch.num_columns - 1))), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(c, pa.int64()) for c in cols)], names=[*keep, *FEATURES])

    schema = source.drop("_measured").schema
    for name in FEATURES:
        schema = schema.add(name, "long")
    return source.mapInArrow(run, schema)


def host_verdicts(measured: DataFrame, host: str, limit: float) -> DataFrame:
    """Per host: its documents, the shrunken failure rate of each rule, and ``host_rejected``.

    For each rule the prior has the mean of all documents and the strength that fits the spread of the host
    rates beyond chance (method of moments, hosts weighted by their documents). A host is one row after the
    aggregation that combines in the map tasks; the priors are one row per rule.
    """
    fails = [F.sum(F.expr(test).cast("long")).alias(name) for name, test in RULES.items()]
    hosts = measured.groupBy(F.col(host).alias("_host")).agg(F.count(F.lit(1)).alias("host_docs"), *fails)
    each = hosts.select("_host", "host_docs", F.explode(F.array(*[F.struct(F.lit(r).alias("rule"), F.col(r).alias("failed")) for r in RULES])).alias("r")) \
        .select("_host", "host_docs", "r.rule", "r.failed")
    each = cut_lineage(each)
    rate = F.col("failed") / F.col("host_docs")
    # Sums of n, x, n r^2 and the number of hosts give the mean and the spread of the rates.
    told = each.groupBy("rule").agg(F.sum("host_docs").alias("n"), F.sum("failed").alias("x"), F.sum(F.col("failed") * rate).alias("q"),
                                    F.count(F.lit(1)).alias("k"))
    mean = F.col("x") / F.col("n")
    beyond = (F.col("q") - F.col("n") * mean * mean - (F.col("k") - 1) * mean * (1 - mean)) / F.col("n")
    # Without spread beyond chance the hosts are alike and the prior is as strong as all documents.
    strength = F.when(beyond > 0, F.least(F.greatest(mean * (1 - mean) / beyond - 1, F.lit(LEAST_STRENGTH)), F.col("n").cast("double"))).otherwise(F.col("n").cast("double"))
    priors = told.select("rule", mean.alias("mean"), strength.alias("strength"))
    shrunk = each.join(priors, "rule").select("_host", "host_docs", "rule", ((F.col("failed") + F.col("mean") * F.col("strength"))
                                                                             / (F.col("host_docs") + F.col("strength"))).alias("rate"))
    return shrunk.groupBy("_host").agg(F.max("host_docs").alias("host_docs"), F.max("rate").alias("host_worst_rate"),
                                       (F.max("rate") > limit).alias("host_rejected"))


def judge(df: DataFrame, host: str = "source", text: str = "text", limit: float = 0.5) -> DataFrame:
    """Adds the features, ``base_failed``, ``host_worst_rate``, ``host_rejected`` and ``kept``.

    Every row stays, repeated rows too, and counts for its host; a null host is a host of its own. A null text is
    empty and fails as too short. Columns with the added names are replaced; an empty table gives an empty one.
    """
    added = ("base_failed", "host_docs", "host_worst_rate", "host_rejected", "kept", *FEATURES)
    df = df.select([c for c in df.columns if c not in added])
    measured = with_features(df, text)
    return attach(measured, host_verdicts(with_features(df, text, [host]), host, limit), host)


def attach(measured: DataFrame, hosts: DataFrame, host: str = "source") -> DataFrame:
    """Joins host verdicts back to documents."""
    base = F.expr(" or ".join(f"({RULES[r]})" for r in BASE))
    met = measured.alias("d").join(hosts.alias("h"), F.col(f"d.{host}").eqNullSafe(F.col("h._host")), "left")
    return met.select("d.*", base.alias("base_failed"), "host_worst_rate", "host_rejected", (~base & ~F.col("host_rejected")).alias("kept"))


def judge_ids(df: DataFrame, limit: float = 0.5) -> DataFrame:
    """The same for ``doc_id``, ``source`` and ``text``, without the text in the result: the texts are read once."""
    measured = cut_lineage(with_features(df, "text", ["doc_id", "source"]))
    return attach(measured, host_verdicts(measured, "source", limit))


def oracle_sql(limit: float = 0.5) -> str:
    """The same question for another engine, over the table ``documents``."""
    word = r"[^\x20\x09-\x0D]+"
    fails = ", ".join(f"sum(CAST(({test}) AS INT)) AS {name}" for name, test in RULES.items())
    rules = " UNION ALL ".join(f"SELECT source, host_docs, '{name}' AS rule, {name} AS failed FROM hosts" for name in RULES)
    base = " OR ".join(f"({RULES[r]})" for r in BASE)
    return rf"""
    WITH docs AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
    w AS (SELECT doc_id, regexp_extract_all(text, '{word}') AS words FROM docs),
    windows AS (SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS part
                FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM w WHERE len(words) >= 8)),
    twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, part) AS n FROM windows) WHERE n > 1),
    covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS place FROM twice) GROUP BY doc_id),
    lines AS (SELECT doc_id, [x FOR x IN string_split(text, chr(10)) IF regexp_matches(x, '{word}')] AS l FROM docs),
    f AS (SELECT d.doc_id, d.source, len(w.words) AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
                 length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                 len(l.l) - len(list_distinct(l.l)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
          FROM docs d JOIN w USING (doc_id) JOIN lines l USING (doc_id) LEFT JOIN covered c USING (doc_id)),
    hosts AS (SELECT source, count(*) AS host_docs, {fails} FROM f GROUP BY source),
    rates AS ({rules}),
    sums AS (SELECT rule, CAST(sum(host_docs) AS DOUBLE) AS n, sum(failed) / CAST(sum(host_docs) AS DOUBLE) AS m,
                    sum(failed * (failed / CAST(host_docs AS DOUBLE))) AS q, count(*) AS k FROM rates GROUP BY rule),
    beyond AS (SELECT rule, n, m, (q - n * m * m - (k - 1) * m * (1 - m)) / n AS b FROM sums),
    priors AS (SELECT rule, m, CASE WHEN b > 0 THEN least(greatest(m * (1 - m) / b - 1, {LEAST_STRENGTH}), n) ELSE n END AS s FROM beyond),
    verdicts AS (SELECT r.source, max((r.failed + p.m * p.s) / (r.host_docs + p.s)) AS rate FROM rates r JOIN priors p USING (rule) GROUP BY r.source)
    SELECT f.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
           CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, ({base}) AS base_failed,
           NOT ({base}) AND NOT (v.rate > {limit}) AS kept
    FROM f JOIN verdicts v ON f.source IS NOT DISTINCT FROM v.source
    """

"""Near duplicates among documents."""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.text import norm_text
from tideline.operators import neardup as nd
from tideline.plans.corpus import BANNED_RE_SQL
from tideline.plans.registry import query, sql_norm, table
from tideline.plans.text import BANNED_RE, SQL_CLEANED

SIDE, DISTANCE = 16, 20
BATCH_BYTES = 32 << 20  # of texts whose words are told apart at once


def fingerprints(docs):
    """A 256-bit difference code per document: are there more words in a hash cell than in the next one. Cells fill a 16 x 16 grid row by row.

    Words are told apart and hashed a batch at a time, so one row per document and batch travels instead of one per cell. Rows of one id are
    one document: their counts add up where the rows meet, sorted by id.
    """
    texts = docs.filter(F.col("text").isNotNull()).select(F.col("doc_id").alias("id"), F.col("lang").alias("label"), norm_text("text").alias("norm"))
    kept = [texts.schema["id"], texts.schema["label"]]
    counted = texts.mapInArrow(cell_counts, T.StructType([*kept, T.StructField("cells", T.BinaryType())]))
    return counted.repartition("id").sortWithinPartitions("id", "label").mapInArrow(cell_codes, T.StructType([*kept, T.StructField("code", T.StringType())]))


def first_rows(ids: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For every row the number of its id in the order of their first rows, and these rows."""
    numbers = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()
    return numbers, np.unique(numbers, return_index=True)[1]


def cell_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, cells) from (id, label, norm): the words of an id in each of the cells, as bytes, or as longer numbers where one is over 255."""
    for whole in batches:
        ends = np.cumsum(pc.binary_length(whole.column("norm")).to_numpy())
        cuts = np.flatnonzero(np.diff(ends // BATCH_BYTES, append=-1)) + 1
        for start, end in itertools.pairwise([0, *cuts.tolist()]):
            batch = whole.slice(start, end - start)
            numbers, firsts = first_rows(batch.column("id"))
            lists = pc.split_pattern(batch.column("norm"), " ")
            words = lists.flatten().dictionary_encode()
            # The least of the first four bytes of a hash is what is left of them after division by 256.
            cell = np.array([hashlib.md5(w).digest()[3] for w in words.dictionary.cast(pa.binary()).to_pylist()], np.int64)
            at = np.repeat(numbers * np.int64(SIDE * SIDE), pc.list_value_length(lists).to_numpy()) + cell[words.indices.to_numpy()]
            counts = np.bincount(at, minlength=len(firsts) * SIDE * SIDE).reshape(len(firsts), SIDE * SIDE)
            small, wide = counts.astype(np.uint8), counts.max(axis=1) > 255
            cells = [counts[i].tobytes() if wide[i] else small[i].tobytes() for i in range(len(firsts))]
            taken = pa.array(firsts)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(taken), batch.column("label").take(taken), pa.array(cells, pa.binary())], ["id", "label", "cells"])


def cell_codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, code) from (id, label, cells) sorted by id. The last id of a batch may go on in the next one."""
    def coded(ids, labels, counts):
        after = np.hstack([counts[:, 1:], np.zeros((len(counts), 1), np.int64)])
        codes = [row.tobytes().decode() for row in (counts > after).astype(np.uint8) + np.uint8(48)]
        return pa.RecordBatch.from_arrays([ids, labels, pa.array(codes, pa.string())], ["id", "label", "code"])

    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        numbers, firsts = first_rows(batch.column("id"))
        rows = [np.frombuffer(c, np.uint8 if len(c) == SIDE * SIDE else np.int64) for c in batch.column("cells").to_pylist()]
        counts = np.add.reduceat(np.array(rows, np.int64), firsts, axis=0)
        taken = pa.array(firsts)
        ids, labels = batch.column("id").take(taken), batch.column("label").take(taken)
        if held is not None:
            if held[0][0].as_py() == ids[0].as_py():
                counts[0] += held[2][0]
                labels = pa.concat_arrays([held[1], labels[1:]])
            else:
                yield coded(*held)
        if len(ids) > 1:
            yield coded(ids[:-1], labels[:-1], counts[:-1])
        held = ids[-1:], labels[-1:], counts[-1:]
    if held is not None:
        yield coded(*held)


SQL_CODES = f"""w AS (SELECT doc_id AS id, lang AS label, unnest(string_split({sql_norm('text')}, ' ')) AS w FROM documents),
    c AS (SELECT id, label, CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 256 AS cell, count(*) AS n FROM w GROUP BY 1, 2, 3),
    m AS (SELECT i.id, i.label, g.cell, coalesce(c.n, 0) AS n FROM (SELECT DISTINCT id, label FROM w) i CROSS JOIN (SELECT unnest(range(256)) AS cell) g
      LEFT JOIN c ON c.id = i.id AND c.cell = g.cell),
    bits AS (SELECT a.id, a.label, string_agg(CASE WHEN a.n > coalesce(b.n, 0) THEN '1' ELSE '0' END, '' ORDER BY a.cell) AS code
      FROM m a LEFT JOIN m b ON a.id = b.id AND b.cell = a.cell + 1 GROUP BY 1, 2),
    codes AS (SELECT id, label, code, row_number() OVER (PARTITION BY label ORDER BY id) AS k,
      list_transform(range(8), lambda v: array_to_string(list_transform(range(256), lambda p:
        substr(code, CAST(xor(CASE WHEN v >= 4 THEN p % 16 ELSE p // 16 END, CASE WHEN v % 2 = 1 THEN 15 ELSE 0 END) * 16
          + xor(CASE WHEN v >= 4 THEN p // 16 ELSE p % 16 END, CASE WHEN v // 2 % 2 = 1 THEN 15 ELSE 0 END) + 1 AS BIGINT), 1)), '')) AS views FROM bits)"""
SQL_GROUPS = f"""{SQL_CODES}, walk AS (
      SELECT label, 0::BIGINT AS k, NULL::BIGINT AS id, NULL::BIGINT AS leader, []::STRUCT(id BIGINT, code VARCHAR)[] AS leaders FROM (SELECT DISTINCT label FROM codes)
      UNION ALL
      SELECT label, k, id, coalesce(hit, id), CASE WHEN hit IS NULL THEN list_append(leaders, {{'id': id, 'code': code}}) ELSE leaders END FROM (
        SELECT c.label, c.k, c.id, c.code, w.leaders, list_filter(w.leaders, lambda l:
          list_min(list_transform(c.views, lambda v: hamming(l.code, v))) <= {DISTANCE})[1].id AS hit
        FROM walk w JOIN codes c ON c.label = w.label AND c.k = w.k + 1))"""


@query("near_dup_fingerprints", f"WITH RECURSIVE {SQL_GROUPS} SELECT id, label, leader FROM walk WHERE k > 0")
def _(spark, sf):
    codes = fingerprints(table(spark, sf, "documents").select("doc_id", "lang", "text"))
    return nd.turned_groups(codes, DISTANCE, SIDE)


@query("near_dup_batches", f"""
    WITH RECURSIVE cleaned AS (SELECT doc_id AS id, source AS batch, {SQL_CLEANED} AS c FROM documents),
    judged AS (SELECT id, batch, CASE WHEN c = '' OR length(c) > 320 THEN 'empty_or_long' WHEN {BANNED_RE_SQL} THEN 'banned' END AS why,
      {sql_norm('c')} AS norm FROM cleaned),
    usable AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY id) AS k FROM judged WHERE why IS NULL),
    walk AS (
      SELECT batch, 0::BIGINT AS k, NULL::BIGINT AS id, false AS dup, []::VARCHAR[] AS kept FROM (SELECT DISTINCT batch FROM usable)
      UNION ALL
      SELECT batch, k, id, dup, CASE WHEN dup THEN kept ELSE list_append(kept, norm) END FROM (
        SELECT u.batch, u.k, u.id, u.norm, w.kept, len(list_filter(w.kept, lambda t: t = u.norm
          OR 1 - levenshtein(t, u.norm) / greatest(length(t), length(u.norm)) > 0.9)) > 0 AS dup
        FROM walk w JOIN usable u ON u.batch = w.batch AND u.k = w.k + 1))
    SELECT id, batch, why AS outcome FROM judged WHERE why IS NOT NULL
    UNION ALL SELECT id, batch, CASE WHEN dup THEN 'duplicate' ELSE 'kept' END FROM walk WHERE k > 0""")
def _(spark, sf):
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("batch"), "text")
    return nd.dedup_in_batches(docs, BANNED_RE)


@query("near_dup_matching_blocks")
def _(spark, sf):
    """The batches again by matching blocks. SQL has no such measure; a test compares the operator with the rule on all pairs."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("batch"), "text")
    return nd.dedup_in_batches(docs, BANNED_RE, measure="blocks")

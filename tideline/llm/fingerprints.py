"""Document fingerprints by I-Match: hashes of a document's sorted distinct terms, after common and rare terms are left out.

A lexicon keeps the terms whose document frequency lies in a band. Several random subsets of the lexicon, dense and
sparse ones, each give one hash of a document's terms in the subset. Equal documents agree in all; edited
ones still agree in the subsets that hold none of the changed terms, in sparse subsets if they are long.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.worker import kept, slices, texts_of
from tideline.session import cut_lineage

DENSITIES, WIDE, EACH = (8, 32, 128, 512), (8, 32), 16  # a subset of density d keeps one term in d
FEW_SLOTS = 6
NARROW = 4 * len(DENSITIES) * EACH  # bytes of the lexicon's subsets, four each; those of the wide band, of every term, follow with two each
LEXICON_LIMIT = 2_000_000


def terms_of(text: str) -> np.ndarray:
    """Sorted hashes of the distinct words, A-Z lower-cased."""
    found = set(text.encode().lower().split())
    terms = np.sort(np.fromiter(map(xxhash.xxh64_intdigest, found), np.uint64, len(found)))  # hashing is faster than a look-up in a large table
    return np.unique(terms) if (terms[1:] == terms[:-1]).any() else terms


def members(terms: np.ndarray, densities: tuple[int, ...] = DENSITIES) -> np.ndarray:
    """Which subsets hold which terms: a row per term, a column per subset. Made in slices, so temporaries stay small."""
    marks = np.arange(1, len(densities) * EACH + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    rest = np.repeat(np.array(densities, np.uint64) - np.uint64(1), EACH)  # densities are powers of two
    out = np.empty((len(terms), len(marks)), bool)
    for at in range(0, len(terms), 16_384):
        x = terms[at:at + 16_384, None] ^ marks[None, :]
        for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x ^= x >> np.uint64(shift)
            x *= np.uint64(by)
        x ^= x >> np.uint64(31)
        out[at:at + 16_384] = (x & rest[None, :]) == 0
    return out


def document_frequencies(df: DataFrame, text: str = "text") -> DataFrame:
    """``term`` (hash, as a long) and ``n`` (documents that hold it) over all rows; counts are summed per task first."""
    def run(batches):
        held, size = [], 0

        def told():
            terms, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(terms.view(np.int64)), pa.array(n)], names=["term", "n"])

        for batch in slices(batches):
            for t in texts_of(batch.column(0)):
                held.append(terms_of(t))
                size += len(held[-1])
            if size > 8_000_000:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return df.select(text).mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


def lexicon(df: DataFrame, low: float = 0.001, high: float = 0.1, text: str = "text") -> np.ndarray:
    """Hashes of the terms in at least ``low`` (and two) and at most ``high`` of the documents, sorted.

    Its size is bounded whatever the input: documents hold d distinct terms on average, so at most d / low terms occur in a
    share ``low`` of them. Should d be so large that this exceeds ``LEXICON_LIMIT``, ``low`` is raised to keep the limit.
    """
    counts = cut_lineage(document_frequencies(df, text))
    pairs, documents = counts.agg(F.sum("n")).first()[0] or 0, df.count()
    least = max(2, low * documents, pairs / LEXICON_LIMIT)
    rows = counts.filter((F.col("n") >= least) & (F.col("n") <= max(2, high * documents))).select("term").toPandas()
    return np.sort(rows["term"].to_numpy(np.int64).view(np.uint64))


def fingerprint_of(text: str, lex: np.ndarray, table: np.ndarray) -> bytes:
    """Four bytes for each subset of the lexicon, then two for each subset of all terms; zeros where it holds no term of the text.

    Every text has both parts, whatever it holds: the band tells texts apart that have terms in it, the wide band the others.
    """
    terms = terms_of(text)
    at = np.searchsorted(lex, terms)
    at[at == len(lex)] = 0
    inside = lex[at] == terms if len(lex) else np.zeros(len(terms), bool)
    banded, wide = table[at[inside]], np.empty((len(terms), EACH * len(WIDE)), bool)
    wide[inside], wide[~inside] = banded[:, :wide.shape[1]], members(terms[~inside], WIDE)  # the wide subsets are the lexicon's first ones
    out = []
    for kind, some, rows in (("<u4", terms[inside], banded), ("<u2", terms, wide)):
        most = int(np.iinfo(kind).max)
        by_subset = np.ascontiguousarray(rows.T)
        marked = np.flatnonzero(by_subset)  # the terms of each subset, one subset after the other
        held = memoryview(some[marked % max(1, len(some))].tobytes())
        ends = (8 * np.searchsorted(marked, len(some) * np.arange(1, len(by_subset) + 1))).tolist()
        slots = [xxhash.xxh32_intdigest(held[a:b]) & most or 1 if a < b else 0 for a, b in zip([0, *ends], ends)]
        out.append(np.array(slots, kind).tobytes())
    return b"".join(out)


def slots_of(made: bytes) -> np.ndarray:
    """The values of a fingerprint's subsets, the lexicon's first."""
    return np.concatenate([np.frombuffer(made[:NARROW], "<u4"), np.frombuffer(made[NARROW:], "<u2")])


def likeness(a: bytes, b: bytes) -> float:
    """0 to 1: of the subsets that hold a term of either, the share in which both agree, in the best density.

    A density of the lexicon counts if at least ``FEW_SLOTS`` of its subsets hold a term; where none does, as the texts have hardly a term
    in the band, densities of the wide band count likewise; else all subsets count together. Equal fingerprints have likeness 1.
    """
    if a == b:
        return 1.0
    x, y = slots_of(a), slots_of(b)
    used = ((x > 0) | (y > 0)).reshape(-1, EACH).sum(axis=1)
    same = ((x == y) & (x > 0)).reshape(-1, EACH).sum(axis=1)
    enough = used >= FEW_SLOTS
    if enough[:len(DENSITIES)].any():
        enough[len(DENSITIES):] = False
    if enough.any():
        return float((same[enough] / used[enough]).max())
    return float(same.sum() / used.sum()) if used.sum() else 1.0


def edited(text: str, other: str) -> str:
    """The last third of the code points replaced by the first as many of ``other``, or all it has."""
    m = len(text) // 3
    return text[:len(text) - m] + other[:m]


NAMES = ("n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double"


def _pair(doc_id, text: str, own: bytes, other: str, others: bytes, lex, table) -> tuple:
    changed = edited(text, other)
    print_changed = own if changed == text else fingerprint_of(changed, lex, table)
    return (doc_id, len(text), hashlib.sha256(changed.encode()).hexdigest(), own, print_changed, likeness(own, print_changed), likeness(own, others))


def _tables(words) -> tuple[np.ndarray, np.ndarray]:
    lex = words.value
    return lex, kept(f"lexicon subsets:{xxhash.xxh64_hexdigest(lex.tobytes())}", lambda: members(lex))


def fingerprints(df: DataFrame, lex: np.ndarray, text: str = "text") -> DataFrame:
    """Adds ``fingerprint`` (lower-case hex). Every row stays; a null text counts as empty. A column of that name is replaced."""
    keep = [c for c in df.columns if c != "fingerprint"]
    source, words = df.select(*keep, F.col(text).alias("_printed")), df.sparkSession.sparkContext.broadcast(lex)

    def run(batches):
        own, table = _tables(words)
        for batch in slices(batches):
            made = [fingerprint_of(t, own, table).hex() for t in texts_of(batch.column(batch.num_columns - 1))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(made, pa.string())], names=[*keep, "fingerprint"])

    return source.mapInArrow(run, source.drop("_printed").schema.add("fingerprint", "string"))


def edit_report(df: DataFrame, lex: np.ndarray) -> DataFrame:
    """Per row of ``df`` (``doc_id``, ``text``): how its fingerprint stands to that of an edited text and of the next document.

    The next document is the one with the next smaller doc_id, after the last the first; null ids come last, rows of one id
    follow each other by text. A null text counts as empty; every row has its line; a single row is its own next. Rows are
    range-partitioned and sorted once; a task walks through its rows in order, and only the last row of each
    task meets the first of the next in a second small step.
    """
    spark = df.sparkSession
    words = spark.sparkContext.broadcast(lex)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = F.col("doc_id").desc_nulls_last()
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(n, order).sortWithinPartitions(order, "text")
    schema = f"kind string, part int, {RESULT}, text string"

    def walk(batches):
        own, table = _tables(words)
        part = TaskContext.get().partitionId()
        before = None
        for batch in slices(batches):
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1)), strict=True):
                made = fingerprint_of(text, own, table)
                if before is None:
                    out.append(("first", part, doc_id, None, None, made, None, None, None, text))
                else:
                    out.append(("row", part, *_pair(*before, text, made, own, table), None))
                before = doc_id, text, made
            yield _batch(out, schema)
        if before is not None:
            yield _batch([("last", part, before[0], None, None, before[2], None, None, None, before[1])], schema)

    walked = cut_lineage(rows.mapInArrow(walk, schema))
    parts = sorted(r[0] for r in walked.filter("kind = 'first'").select("part").collect())  # one number per task
    follow = spark.createDataFrame([(p, parts[(i + 1) % len(parts)]) for i, p in enumerate(parts)], "part int, next int")
    first = walked.filter("kind = 'first'").select(F.col("part").alias("next"), F.col("text").alias("other"), F.col("fingerprint").alias("others"))
    ends = walked.filter("kind = 'last'").select("part", "doc_id", "text", "fingerprint").join(follow, "part").join(first, "next") \
        .select("doc_id", "text", "fingerprint", "other", "others")

    def meet(batches):
        own, table = _tables(words)
        for batch in slices(batches):
            yield _batch([_pair(*r, own, table) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)], RESULT)

    told = walked.filter("kind = 'row'").select("doc_id", *NAMES).unionByName(ends.mapInArrow(meet, RESULT))
    return told.withColumns({c: F.lower(F.hex(c)) for c in ("fingerprint", "edited_fingerprint")})


KINDS = {"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "double": pa.float64(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, KINDS[k]) for c, (_, k) in zip(cols, fields, strict=True)], names=[f for f, _ in fields])

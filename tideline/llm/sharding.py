"""Shards by extendible hashing: a directory of hash prefixes in which only oversized buckets split.

A bucket is a prefix of the bits of a hash. The directory starts with one bucket; a bucket whose bytes
exceed the limit is replaced by its two halves, one bit longer, until every shard fits. The
shard of a row is therefore the shortest prefix of its hash whose rows fit together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.session import cut_lineage

BITS = 56  # of the hash; a prefix of this length is never split further
STEP = 12  # bits that one pass over the open rows can add
SPREAD = 8  # bits of a row's cell beyond the shallowest bucket


def hash_bits(*columns: str) -> Column:
    """The first 56 bits of an md5 of the columns, as a long; nulls count as a text of their own."""
    parts = [F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-")) for c in columns]
    return F.conv(F.substring(F.md5(F.concat_ws("\n", *parts)), 1, BITS // 4), 16, 10).cast("long")


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """The buckets of rows with ``hash`` and ``n_bytes``: depth, prefix, n_rows, n_bytes, fits.

    Per pass the open rows are summed in cells of at most ``STEP`` more bits than decided so far, which
    combines before the shuffle; the cells are summed again for every shorter prefix, and each open bucket
    takes the shortest prefixes that fit. Cells that still exceed the limit are opened in the
    next pass; there is one pass for every ``STEP`` bits of the deepest bucket. A bucket whose rows all share
    one hash cannot split: it ends at the last bit with ``fits`` false unless it is small enough.
    """
    done, open_rows, base = None, rows.select("hash", "n_bytes"), 0
    while True:
        depth = min(BITS, base + STEP)
        cells = open_rows.groupBy(F.shiftright("hash", BITS - depth).alias("cell")) \
            .agg(F.count(F.lit(1)).alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        # A bucket decided in an earlier pass lies above ``base``, so prefixes start there.
        lengths = F.sequence(F.lit(base), F.lit(depth))
        sums = cells.select("cell", "n_rows", "n_bytes", F.explode(lengths).alias("depth")) \
            .withColumn("prefix", F.expr(f"shiftright(cell, {depth} - depth)")) \
            .groupBy("depth", "prefix").agg(F.sum("n_rows").alias("n_rows"), F.sum("n_bytes").alias("n_bytes"))
        sums = cut_lineage(sums)
        fit = (F.col("n_bytes") <= limit) | (F.col("n_rows") == 1) | (F.col("depth") == BITS)
        # A prefix is a bucket if it fits and its parent does not; the parent of a first prefix is open.
        parents = sums.filter(~fit).select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("above"))
        chosen = sums.filter(fit).withColumn("above", F.shiftright("prefix", 1))
        buckets = chosen.filter(F.col("depth") > base).join(parents, ["depth", "above"], "left_semi") \
            .unionByName(chosen.filter(F.col("depth") == base)).drop("above")
        done = buckets if done is None else done.unionByName(buckets)
        large = sums.filter(~fit & (F.col("depth") == depth)).select(F.col("prefix").alias("cell"))
        if depth == BITS or large.isEmpty():
            break
        base = depth
        open_rows = open_rows.withColumn("cell", F.shiftright("hash", BITS - depth)).join(large, "cell", "left_semi").select("hash", "n_bytes")
    return done.withColumn("fits", F.col("n_bytes") <= limit)


def shard(df: DataFrame, limit: int, key: tuple[str, ...] = ("doc_id", "text"), text: str = "text") -> DataFrame:
    """Adds ``n_bytes`` (UTF-8, a null text 0), ``shard`` (its prefix as bits, empty for an undivided table),
    ``shard_depth``, ``shard_rows``, ``shard_bytes`` and ``shard_fits``.

    ``shard_fits`` is false only for a single row above the limit, or rows that are equal in the key and
    exceed it together: no bit tells them apart. Every row stays; columns with these names are replaced.
    An empty table gives an empty one.
    """
    added = ("n_bytes", "hash", "shard", "shard_depth", "shard_rows", "shard_bytes", "shard_fits", "_depth", "_cell")
    keep = [c for c in df.columns if c not in added]
    rows = df.select(*keep, F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("n_bytes"), hash_bits(*key).alias("hash"))
    return shard_rows(rows, limit)


def shard_rows(rows: DataFrame, limit: int) -> DataFrame:
    """The same for rows that carry ``hash`` and ``n_bytes``."""
    found = cut_lineage(directory(rows, limit)).select(
        F.col("depth").alias("shard_depth"), F.col("prefix").alias("_prefix"), F.col("n_rows").alias("shard_rows"),
        F.col("n_bytes").alias("shard_bytes"), F.col("fits").alias("shard_fits"))
    least, most = found.agg(F.min("shard_depth"), F.max("shard_depth")).first()
    # Rows meet their bucket in a cell of one common length: a shorter bucket covers a run of cells, a longer one
    # shares its cell with its neighbours and is told from them by the bounds of its hashes.
    at = min(most or 0, (least or 0) + SPREAD)
    wide = F.col("shard_depth") <= at
    first = F.when(wide, F.expr(f"shiftleft(_prefix, greatest(0, {at} - shard_depth))")).otherwise(
        F.expr(f"shiftright(_prefix, greatest(0, shard_depth - {at}))"))
    last = F.when(wide, F.expr(f"shiftleft(_prefix + 1, greatest(0, {at} - shard_depth)) - 1")).otherwise(first)
    cells = found.select("*", F.explode(F.sequence(first, last)).alias("_cell"), F.expr(f"shiftleft(_prefix, {BITS} - shard_depth)").alias("_low"),
                         F.expr(f"shiftleft(_prefix + 1, {BITS} - shard_depth)").alias("_high"))
    met = rows.withColumn("_cell", F.shiftright("hash", BITS - at)).alias("r").join(
        cells.alias("c"), (F.col("r._cell") == F.col("c._cell")) & (F.col("hash") >= F.col("_low")) & (F.col("hash") < F.col("_high")))
    return _named(met.drop("_cell", "_low", "_high"))


def _named(df: DataFrame) -> DataFrame:
    bits = F.lpad(F.bin(F.col("_prefix")), F.col("shard_depth"), F.lit("0"))
    return df.withColumn("shard", F.when(F.col("shard_depth") == 0, F.lit("")).otherwise(bits)).drop("_prefix", "hash")


def oracle_sql(limit: int) -> str:
    """The same question for another engine, over the table ``documents`` with the key (doc_id, text)."""
    return f"""
    WITH h AS (SELECT doc_id, coalesce(strlen(text), 0) AS n_bytes,
                      CAST('0x' || substr(md5(coalesce('=' || CAST(doc_id AS VARCHAR), '-') || chr(10) || coalesce('=' || text, '-')), 1, {BITS // 4}) AS BIGINT) AS hash
               FROM documents),
    p AS (SELECT depth, hash >> ({BITS} - depth) AS prefix, sum(n_bytes) AS bytes, count(*) AS n
          FROM (SELECT *, unnest(range(0, {BITS + 1})) AS depth FROM h) GROUP BY ALL),
    f AS (SELECT h.doc_id, h.n_bytes, p.depth, p.prefix, p.n, p.bytes, row_number() OVER (PARTITION BY h.doc_id, h.hash ORDER BY p.depth) AS k
          FROM h JOIN p ON p.prefix = h.hash >> ({BITS} - p.depth) WHERE p.bytes <= {limit} OR p.n = 1 OR p.depth = {BITS})
    SELECT doc_id, CAST(n_bytes AS BIGINT) AS n_bytes, CAST(depth AS INT) AS shard_depth, CAST(n AS BIGINT) AS shard_rows, CAST(bytes AS BIGINT) AS shard_bytes,
           bytes <= {limit} AS shard_fits, CASE WHEN depth = 0 THEN '' ELSE lpad(bin(prefix), CAST(depth AS INT), '0') END AS shard
    FROM f WHERE k = 1
    """

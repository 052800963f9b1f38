"""Translation metrics from clipped n-gram counts."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import strip, text_key
from tideline.functions.vector import let

_COUNTS = pa.list_(pa.struct([("n", pa.int32()), ("matched", pa.int64()), ("said", pa.int64()), ("wanted", pa.int64())]))

UNITS = 1 << 19  # characters or words counted at once


def squeeze(text, lower: bool = True) -> Column:
    """White space to single spaces, none at the ends."""
    t = F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))
    return F.regexp_replace(strip(F.lower(t) if lower else t), r"\s+", " ")


def tokens_13a(text) -> Column:
    """Tokens of the mteval-v13a rules: punctuation apart, except inside numbers."""
    t = F.col(text) if isinstance(text, str) else text
    # The public mteval-v13a replacements, in order.
    for pattern, new in (
        ("<skipped>", ""), ("-\n", ""), ("\n", " "), ("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"),
    ):
        t = F.replace(t, F.lit(pattern), F.lit(new))
    t = F.concat(F.lit(" "), t, F.lit(" "))
    for pattern, new in (
        (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "), (r"([^0-9])([\.,])", "$1 $2 "), (r"([\.,])([^0-9])", " $1 $2"), (r"([0-9])(-)", "$1 $2 "),
    ):
        t = F.regexp_replace(t, pattern, new)
    return tokens(t)


def tokens(text) -> Column:
    return F.filter(F.split(squeeze(text, lower=False), " "), lambda w: w != "")


def _units(side: pa.Array) -> tuple[np.ndarray | pa.Array, np.ndarray]:
    """All units of a column, one text after the other, and the length of each text: code points of strings, words of arrays."""
    if pa.types.is_list(side.type):
        return side.flatten(), pc.fill_null(pc.list_value_length(side), 0).to_numpy().astype(np.int64)
    codes = np.frombuffer("".join(pc.fill_null(side, "").to_pylist()).encode("utf-32-le"), np.uint32)
    return codes, pc.fill_null(pc.utf8_length(side), 0).to_numpy().astype(np.int64)


def _numbered(h, r) -> tuple[np.ndarray, np.ndarray]:
    """The units of both sides as small whole numbers."""
    if isinstance(h, pa.Array):
        number = pa.concat_arrays([h, r]).dictionary_encode().indices.to_numpy().astype(np.int64)
        return number[:len(h)], number[len(h):]
    seen = np.zeros(0x110000, bool)
    seen[h] = seen[r] = True
    number = np.cumsum(seen) - 1
    return number[h], number[r]


def _in_order(high: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``high`` ascending and ``at`` likewise: as one number where both fit, since plain sorting is faster than sorting places."""
    bits = int(at.max(initial=0)).bit_length()
    if int(high.max(initial=0)).bit_length() + bits < 64:
        both = np.sort(high << bits | at)
        return both >> bits, both & ((1 << bits) - 1)
    order = np.argsort(high, kind="stable")
    return high[order], at[order]


def _clipped(units: np.ndarray, pair: np.ndarray, end: np.ndarray, refs: int, pairs: int, max_n: int) -> np.ndarray:
    """Clipped matches, a row per pair and a column per order, of all pairs at once.

    ``units`` holds all hypotheses, then from ``refs`` on all references; ``pair`` and ``end`` tell each place's pair and the end of its text.
    An n-gram's number is its rank among (rank of its first n - 1 units, last unit). The first ranks are the pairs, so
    equal numbers mean equal n-grams of one pair, and one sort per order counts them for every pair.
    """
    base, out = int(units.max(initial=0)) + 1, np.zeros((pairs, max_n), np.int64)
    rank, at = pair.copy(), np.arange(len(units))
    for n in range(1, max_n + 1):
        at = at[at + n <= end[at]]
        if not len(at):
            break
        grams, places = _in_order(rank[at] * base + units[at + n - 1], at)
        first = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        rank[places] = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(grams)]))
        wanted = np.add.reduceat((places >= refs).astype(np.int64), first)
        said = np.diff(np.r_[first, len(grams)]) - wanted
        out[:, n - 1] = np.bincount(pair[places[first]], weights=np.minimum(said, wanted), minlength=pairs)
    return out


def _counted(h: pa.Array, r: pa.Array, max_n: int) -> pa.Array:
    """Counts of the pairs of a batch; a stretch of pairs with about ``UNITS`` units is counted at once."""
    orders, rows = np.arange(1, max_n + 1), []
    sizes = [_units(x)[1] for x in (h, r)]
    upto, low = np.cumsum(sizes[0] + sizes[1]), 0
    while low < len(h):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + UNITS, "right")))
        n, both = high - low, [_units(x.slice(low, high - low)) for x in (h, r)]
        lengths = np.concatenate([both[0][1], both[1][1]])
        pair, end = np.repeat(np.r_[np.arange(n), np.arange(n)], lengths), np.repeat(np.cumsum(lengths), lengths)
        numbers = _numbered(both[0][0], both[1][0])
        matched = _clipped(np.concatenate(numbers), pair, end, len(numbers[0]), n, max_n)
        rows.append([np.tile(orders, n), matched.ravel(), *(np.maximum(x[1][:, None] + 1 - orders, 0).ravel() for x in both)])
        low = high
    columns = [np.concatenate(c) for c in zip(*rows)] if rows else [np.empty(0, np.int64)] * 4
    flat = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _COUNTS.value_type)], fields=list(_COUNTS.value_type))
    return pa.ListArray.from_arrays(pa.array(np.arange(len(h) + 1) * max_n, pa.int32()), flat)


def gram_counts(pairs: DataFrame, hyp: Column, ref: Column, max_n: int) -> DataFrame:
    """``pairs`` with ``counts``: per order n, clipped matches and n-gram totals of both sides.

    Characters if the sides are strings, words if they are arrays. A pair is scored where it lies:
    its n-grams, several times its text, are neither exploded nor shuffled.
    """
    @F.arrow_udf("array<struct<n:int,matched:long,said:long,wanted:long>>")
    def count(hs: pa.Array, rs: pa.Array) -> pa.Array:
        return _counted(hs, rs, max_n)

    return pairs.withColumn("counts", count(hyp, ref))


def _f_score(p: Column, r: Column, beta: float) -> Column:
    return F.coalesce(F.try_divide((1 + beta ** 2) * p * r, beta ** 2 * p + r), F.lit(0.0)) * 100


def _mean_share(counts: Column, total: str) -> Column:
    """Mean of matched over total, over the orders both sides have."""
    shares = F.transform(F.filter(counts, lambda c: (c["said"] > 0) & (c["wanted"] > 0)), lambda c: c["matched"] / c[total])
    return let(shares, lambda xs: F.try_divide(F.aggregate(xs, F.lit(0.0), lambda a, x: a + x), F.size(xs)))


def chrf_sentence(pairs: DataFrame, max_n: int = 6, beta: float = 2) -> DataFrame:
    """(pair_id, chrf): mean precision and recall over the orders both sides have."""
    counted = gram_counts(pairs, squeeze("hyp"), squeeze("ref"), max_n).select("pair_id", "counts")
    means = counted.select("pair_id", _mean_share(F.col("counts"), "said").alias("p"), _mean_share(F.col("counts"), "wanted").alias("r"))
    return means.select("pair_id", _f_score(F.col("p"), F.col("r"), beta).alias("chrf"))


def _corpus_counts(counted: DataFrame) -> DataFrame:
    per = counted.select(F.explode("counts").alias("c"))
    return per.groupBy("c.n").agg(*[F.sum(f"c.{x}").alias(x) for x in ("matched", "said", "wanted")])


def chrf_corpus(pairs: DataFrame, max_n: int = 6, beta: float = 2) -> DataFrame:
    """Corpus score: counts summed over all pairs first; white space does not count."""
    bare = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", "")
    counts = _corpus_counts(gram_counts(pairs, bare("hyp"), bare("ref"), max_n))
    both = (F.col("said") > 0) & (F.col("wanted") > 0)
    p, r = (F.avg(F.when(both, F.col("matched") / F.col(c))) for c in ("said", "wanted"))
    return counts.agg(p.alias("p"), r.alias("r")).select(F.round(_f_score(F.col("p"), F.col("r"), beta), 6).alias("chrf"))


def bleu_corpus(pairs: DataFrame, max_n: int = 4, tokenize=tokens_13a) -> DataFrame:
    """Corpus BLEU with brevity penalty; an order without a match is smoothed by halving."""
    counts = _corpus_counts(gram_counts(pairs, tokenize("hyp"), tokenize("ref"), max_n))
    total = counts.agg(*[F.coalesce(F.sum(F.when(F.col("n") == n, F.col(c))), F.lit(0)).alias(f"{c}{n}")
                         for n in range(1, max_n + 1) for c in ("matched", "said", "wanted")])
    logs, misses, usable = F.lit(0.0), F.lit(0), F.lit(True)
    for n in range(1, max_n + 1):
        hit, said = F.col(f"matched{n}"), F.col(f"said{n}")
        misses = misses + F.when(hit == 0, 1).otherwise(0)
        precision = F.when(hit == 0, F.try_divide(F.lit(1.0), F.pow(F.lit(2.0), misses) * said)).otherwise(F.try_divide(hit, said))
        usable = usable & (said > 0)
        logs = logs + F.ln(precision)
    shorter = F.col("said1") < F.col("wanted1")
    penalty = F.when(shorter, F.exp(1 - F.try_divide("wanted1", "said1"))).otherwise(1.0)
    any_hit = sum((F.col(f"matched{n}") for n in range(2, max_n + 1)), F.col("matched1")) > 0
    score = F.when(usable & any_hit, penalty * F.exp(logs / max_n) * 100).otherwise(0.0)
    return total.select(F.round(score, 6).alias("bleu"), F.round(penalty, 6).alias("brevity"), F.col("said1").alias("hyp_tokens"),
                        F.col("wanted1").alias("ref_tokens"))


def heldout_pairs(pairs: DataFrame, corpus: DataFrame, splits=("calib", "test"), text: str = "text") -> DataFrame:
    """Pairs whose text belongs to a held-out split of the corpus."""
    held = corpus.filter(F.col("split").isin(*splits)).select(text_key(text).alias("_key")).distinct()
    return pairs.withColumn("_key", text_key(text)).join(held, "_key", "left_semi").drop("_key")

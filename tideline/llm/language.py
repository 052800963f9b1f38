"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent n-grams of one to three characters, a document's profile likewise.
Their distance is the sum, over the document's n-grams, of how far out of place each is in the language's list; one that
is absent counts as much as the list is long. The nearest language wins.

Characters are lower-cased; runs of anything but letters and marks are one boundary, which n-grams may begin or end with.
Three code points and their order fit a 64-bit number, so n-grams are compared exactly.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.worker import kept, slices, texts_of

SIZE = 400  # n-grams of a profile
BOUNDARY, BITS = 1, 21  # a control character, which is no letter; a code point has 21 bits
PIECE = 1 << 18  # code points handled at once
HELD = 1 << 20  # counted n-grams a task holds before it hands them on
MOST_LANGUAGES = 5000  # more distinct values are no language names
UNKNOWN = "und"


def _kinds() -> np.ndarray:
    """2 for letters, 1 for marks, 0 for all other code points."""
    kind = {"L": 2, "M": 1}
    return np.fromiter((kind.get(unicodedata.category(chr(c))[0], 0) for c in range(0x110000)), np.uint8, 0x110000)


def summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in ascending order, each with the sum of its counts."""
    k, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(k, kind="stable")
    k, n = k[order], n[order]
    first = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    return k[first], np.add.reduceat(n, first)


def grams(text: str) -> tuple[np.ndarray, np.ndarray, bool]:
    """Distinct n-grams of a whole text in ascending order, their counts, and whether it has a letter.

    The text is read piece by piece, so memory follows its distinct n-grams and one piece.
    """
    kinds = kept("character kinds", _kinds)
    text = text.lower()
    tail, keys, counts, letter = np.array([BOUNDARY], np.int64), [], [], False
    for at in range(0, len(text), PIECE):
        codes = np.frombuffer(text[at:at + PIECE].encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        if at + PIECE >= len(text):
            codes = np.append(codes, BOUNDARY)
        kind = kinds[codes]
        letter = letter or bool((kind == 2).any())
        codes[kind == 0] = BOUNDARY
        new = codes[(codes != BOUNDARY) | (np.r_[tail[-1], codes[:-1]] != BOUNDARY)]
        if not len(new):
            continue
        s = np.r_[tail, new]
        fresh = len(tail)  # n-grams that end here or later are new
        two = (s[:-1] << BITS | s[1:])[fresh - 1:]
        three = (s[:-2] << 2 * BITS | s[1:-1] << BITS | s[2:])[s[1:-1] != BOUNDARY] if len(s) > 2 else s[:0]
        k, n = np.unique(np.concatenate([new[new != BOUNDARY], two, three]), return_counts=True)
        keys.append(k)
        counts.append(n)
        tail = s[-2:]
        if len(keys) == 16:
            k, n = summed(keys, counts)
            keys, counts = [k], [n]
    if not keys:
        return np.empty(0, np.int64), np.empty(0, np.int64), False
    return (keys[0], counts[0], letter) if len(keys) == 1 else (*summed(keys, counts), letter)


def ranked(keys: np.ndarray, counts: np.ndarray, size: int) -> np.ndarray:
    """The most frequent n-grams in order, equally frequent ones by their numbers."""
    return keys[np.argsort(-counts, kind="stable")[:size]]


@dataclass
class Profiles:
    langs: list[str]
    grams: np.ndarray  # all n-grams of any profile, ascending
    ranks: np.ndarray  # a row per n-gram, a column per language; ``size`` where it is absent
    size: int


def gram_counts(df: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """``lang``, ``gram``, ``n`` over all rows with a text and a language; tasks add up their own counts first."""
    def run(batches) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def told():
            for name, (k, n) in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([name], pa.string()).take(pa.array(np.zeros(len(k), np.int32))), pa.array(k), pa.array(n)],
                                                 names=["lang", "gram", "n"])

        for batch in slices(batches):
            rows: dict[str, list[str]] = {}
            for name, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows.setdefault(name, []).append(words)
            for name, words in rows.items():
                k, n, _ = grams("\n".join(words))
                held[name] = summed([held[name][0], k], [held[name][1], n]) if name in held else (k, n)
            if sum(len(k) for k, _ in held.values()) > HELD:
                yield from told()
                held.clear()
        yield from told()

    rows = df.filter(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("_text"))
    return rows.mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def learn(df: DataFrame, text: str = "text", lang: str = "lang", size: int = SIZE) -> Profiles:
    """Profiles of all languages in ``df``, from whole texts.

    Rows without a text or a language teach nothing; an empty table gives no language. The driver
    receives ``size`` rows per language; over 5,000 languages raise, as such values are no language names.
    """
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = gram_counts(df, text, lang).withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < size)
    rows = top.select("lang", "gram", "rank").limit(MOST_LANGUAGES * size + 1).toArrow()
    names = np.array(rows["lang"].to_pylist(), object)
    langs = sorted(set(names.tolist()), key=lambda x: x.encode())
    if len(langs) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages in column {lang}")
    number = {x: i for i, x in enumerate(langs)}
    all_grams, at = np.unique(rows["gram"].to_numpy(), return_inverse=True)
    ranks = np.full((len(all_grams), len(langs)), size, np.int32)
    if langs:
        ranks[at, [number[x] for x in names]] = rows["rank"].to_numpy()
    return Profiles(langs, all_grams, ranks, size)


def distances(top: np.ndarray, grams: np.ndarray, ranks: np.ndarray, size: int) -> np.ndarray:
    """Out-of-place distance of a document's ranked n-grams to each language."""
    at = np.minimum(np.searchsorted(grams, top), len(grams) - 1)
    place = np.where((grams[at] == top)[:, None], ranks[at], size)
    return np.where(place == size, size, np.abs(place - np.arange(len(top))[:, None])).sum(axis=0)


def predict(df: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """Adds ``lang_pred`` and ``score`` (1 less the distance as a share of the largest possible one).

    A null text and a text without a letter are ``und`` with score 0, and so is every text where no language was learnt. Languages
    at the same distance go by their names. Texts of any length are read whole; repeated rows stay; columns with
    the added names are replaced; an empty table gives an empty one.
    """
    keep = [c for c in df.columns if c not in ("lang_pred", "score")]
    langs, known, ranks, size = list(profiles.langs), profiles.grams, profiles.ranks, profiles.size

    def judged(t: str | None) -> tuple[str, float]:
        k, n, letter = grams(t or "")
        if not (letter and langs):
            return UNKNOWN, 0.0
        top = ranked(k, n, size)
        d = distances(top, known, ranks, size)
        best = int(d.argmin())
        return langs[best], 1.0 - float(d[best]) / (size * len(top))

    def run(batches):
        for batch in slices(batches):
            names, scores = zip(*map(judged, texts_of(batch.column(batch.num_columns - 1))), strict=True)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*keep, "lang_pred", "score"])

    source = df.select(*keep, F.col(text).alias("_judged"))
    return source.mapInArrow(run, source.drop("_judged").schema.add("lang_pred", "string").add("score", "double"))

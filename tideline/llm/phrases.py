"""Frequent phrases and how firmly their words belong together, by Rabin-Karp fingerprints.

A text's words are written one after the other with single spaces; prefix sums of its bytes times powers of a base, modulo
a prime, give the fingerprint of any run of words by two look-ups. Four such polynomials make two numbers of 62 bits
per phrase. Tasks count fingerprints and keep for each one occurrence (text and word number); a shuffle adds the
counts up. Runs of n words are counted only if both their runs of n - 1 words may be frequent, which a bit table of
bounded size tells without ever denying a frequent one. Only frequent phrases become text: their occurrences
are looked up, fingerprints are checked against what stands there, and scores follow from the counts of the parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.llm.worker import kept
from tideline.session import cut_lineage

PRIMES = (2147483647, 2147483629, 2147483587, 2147483579)
BASES = (1103515245, 1664525023, 1291040389, 1812433253)
PIECE = 1 << 17  # bytes hashed at once
HELD = 1 << 17  # fingerprints a task holds before it counts them and hands them on
HANDED = 1 << 14  # rows handed on at once, as the JVM holds a whole batch of them outside its heap
LEAST_BITS, MOST_BITS = 20, 27  # of the table of frequent fingerprints: 16 MB at most
SPACES, BREAKS = b" \t", b".,;:!?\n\x0b\x0c\r"
UNKNOWN = "und"


def _tables() -> dict:
    """Byte classes, lower-casing, and per polynomial the powers of its base and of the base's inverse."""
    kind = np.zeros(256, np.uint8)
    kind[list(SPACES)], kind[list(BREAKS)] = 1, 2
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32

    def powers(base: int, prime: int) -> np.ndarray:
        out = np.ones(2 * PIECE, np.int64)
        m = 1
        while m < len(out):
            out[m:2 * m] = out[:min(m, len(out) - m)] * pow(base, m, prime) % prime
            m *= 2
        return out

    return {"kind": kind, "lower": lower, "up": [powers(b, p) for b, p in zip(BASES, PRIMES)],
            "down": [powers(pow(b, -1, p), p) for b, p in zip(BASES, PRIMES)]}


class Words:
    """The words of a stretch of bytes: ``starts`` and ``ends`` in ``line`` (words with single spaces), ``piece`` of each word, ``doc`` of each
    word, and sums of the polynomials up to every byte of ``line``."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        t = kept("phrase tables", _tables)
        kind = t["kind"][data]
        word = kind == 0
        begins = np.zeros(len(data) + 1, bool)
        begins[offsets] = True
        after = np.r_[False, word[:-1]] & ~begins[:-1]  # the byte before belongs to a word of the same text
        start, gap = word & ~after, ~word & after
        bounds = np.flatnonzero((kind == 2) | begins[:-1])
        at = np.flatnonzero(start)
        self.piece, self.doc = np.searchsorted(bounds, at, "right"), np.searchsorted(offsets, at, "right") - 1
        stays = word | gap
        self.line = t["lower"][data[stays]]
        self.line[gap[stays]] = 32
        self.starts = np.flatnonzero(start[stays])
        ends = np.append(self.starts[1:], len(self.line))[:len(self.starts)]
        self.ends = ends - (self.line[ends - 1] == 32)
        values = self.line.astype(np.int64) + 1
        up = t["up"] if len(values) <= 2 * PIECE else self._longer(len(values))
        self.sums = [np.concatenate([[0], np.cumsum(values * u[:len(values)])]) for u in up]
        self.down = t["down"] if len(values) <= 2 * PIECE else self._longer(len(values), True)

    @staticmethod
    def _longer(n: int, inverse: bool = False) -> list[np.ndarray]:
        """Powers for a single word longer than the tables."""
        out = []
        for b, p in zip(BASES, PRIMES):
            x, one = np.ones(n, np.int64), pow(b, -1, p) if inverse else b
            m = 1
            while m < n:
                x[m:2 * m] = x[:min(m, n - m)] * pow(one, m, p) % p
                m *= 2
            out.append(x)
        return out

    def prints(self, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Both numbers of the runs of ``n`` words that begin with the words ``first``."""
        s, e = self.starts[first], self.ends[first + n - 1]
        a, b, c, d = [(sums[e] - sums[s]) % p * down[s] % p for sums, down, p in zip(self.sums, self.down, PRIMES)]
        return a << 31 | b, c << 31 | d

    def runs(self, n: int) -> np.ndarray:
        """First words of all runs of ``n`` words within a piece."""
        if len(self.piece) < n:
            return np.empty(0, np.int64)
        return np.flatnonzero(self.piece[:len(self.piece) - n + 1] == self.piece[n - 1:])


def stretches(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
    """A column of texts in stretches of about ``PIECE`` bytes: bytes, offsets of its texts, their row numbers, and how many
    bytes of a longer text's words before the stretch are repeated at its start.

    A longer text is cut between words. What is repeated are its last words before the cut, of the same piece, so that
    the caller can find the runs of words that span it.
    """
    texts = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(texts):
        low = offsets[row]
        last = max(row + 1, int(np.searchsorted(offsets, low + PIECE, "right")) - 1)
        if offsets[last] - low <= PIECE:
            yield data[low:offsets[last]], offsets[row:last] - low, np.arange(row, last), 0
        else:
            yield from ((x, np.array([0]), np.array([row]), old) for x, old in _cuts(data[low:offsets[last]]))
        row = last


def _cuts(data: np.ndarray, words: int = 16) -> Iterator[tuple[np.ndarray, int]]:
    """One long text in parts that end between words, each led by the ``words`` words before it, whose bytes are the second value."""
    kind = kept("phrase tables", _tables)["kind"]
    at = lead = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and kind[data[end]] == 0:  # to the end of the word, however long
            stop = np.flatnonzero(kind[data[end:end + PIECE]])
            end += int(stop[0]) if len(stop) else min(PIECE, len(data) - end)
        yield data[lead:end], at - lead
        starts = word_starts(data[lead:end])
        lead, at = end if not words else lead + int(starts[-words]) if len(starts) >= words else lead, end


def word_starts(data: np.ndarray) -> np.ndarray:
    word = kept("phrase tables", _tables)["kind"][data] == 0
    return np.flatnonzero(word & ~np.r_[False, word[:-1]])


def mixed(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = x.astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def places(a: np.ndarray, b: np.ndarray, lang: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two bits that stand for a fingerprint of a language (given as a 64-bit number)."""
    return mixed(a.view(np.uint64) ^ lang) >> np.uint64(64 - bits), mixed(b.view(np.uint64) + lang) >> np.uint64(64 - bits)


def lang_number(name: str) -> int:
    return xxhash.xxh64_intdigest(name)


class FrequentBits:
    """A bounded table that holds every frequent fingerprint and a few others."""

    def __init__(self, words: np.ndarray, bits: int):
        self.words, self.bits = words, bits

    def has(self, a: np.ndarray, b: np.ndarray, lang: np.ndarray) -> np.ndarray:
        x, y = places(a, b, lang, self.bits)
        one = np.uint64(1)
        found = (self.words[x >> np.uint64(6)] >> (x & np.uint64(63))) & (self.words[y >> np.uint64(6)] >> (y & np.uint64(63))) & one
        return found.astype(bool)


def frequent_bits(frequent: DataFrame) -> FrequentBits:
    """The bit table of ``lang``, ``a``, ``b``: sixteen bits a row, within bounds; rows are turned to words of bits in Spark."""
    bits = int(np.clip(int(np.ceil(np.log2(16 * max(1, frequent.count())))), LEAST_BITS, MOST_BITS))

    def run(batches):
        for batch in batches:
            lang = np.array([lang_number(x) for x in batch.column(0).to_pylist()], np.uint64)
            x = np.concatenate(places(batch.column(1).to_numpy(), batch.column(2).to_numpy(), lang, bits)) if len(lang) else np.empty(0, np.uint64)
            yield pa.RecordBatch.from_arrays([pa.array((x >> np.uint64(6)).astype(np.int64)), pa.array((np.uint64(1) << (x & np.uint64(63))).view(np.int64))], names=["word", "set"])

    rows = frequent.select("lang", "a", "b").mapInArrow(run, "word long, set long").groupBy("word").agg(F.bit_or("set").alias("set")).toArrow()
    words = np.zeros(1 << (bits - 6), np.uint64)
    words[rows["word"].to_numpy()] = rows["set"].to_numpy().view(np.uint64)
    return FrequentBits(words, bits)


RUN = ["lang", "a", "b", "f", "text_key", "word"]


def told(held: list[tuple], langs: list[str]) -> Iterator[pa.RecordBatch]:
    """The fingerprints of ``held`` (both numbers, code of the language, text key, word), which it empties, counted; ``HANDED`` rows a batch."""
    a, b, code, key, word = (np.concatenate(x) for x in zip(*held))
    held.clear()
    order = np.argsort(a ^ mixed(code).view(np.int64), kind="stable")  # equal fingerprints of a language are neighbours
    a, b, code = a[order], b[order], code[order]
    new = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (code[1:] != code[:-1])])
    count = np.diff(np.r_[new, len(a)])
    names = pa.array(langs, pa.string())
    for at in range(0, len(new), HANDED):
        x = new[at:at + HANDED]
        y = order[x]
        yield pa.RecordBatch.from_arrays([names.take(pa.array(code[x])), *map(pa.array, (a[x], b[x], count[at:at + HANDED], key[y], word[y]))], names=RUN)


def run_counts(df: DataFrame, n: int, below: FrequentBits | None) -> DataFrame:
    """``lang``, ``a``, ``b`` (fingerprint), ``f`` (occurrences) and, for runs of several words, ``text_key`` and ``word``: one place where it stands.

    ``df`` has ``lang``, ``text_key`` and ``text``. ``below`` knows the frequent runs of n - 1 words. With n = 1 a row of fingerprint 0, 0
    counts all words of the language.
    """
    packed = None if below is None else df.sparkSession.sparkContext.broadcast((below.words, below.bits))

    def run(batches):
        bits = None if packed is None else FrequentBits(*packed.value)
        held, size, codes, totals = [], 0, {}, {}
        for batch in batches:
            code = np.array([codes.setdefault(x, len(codes)) for x in batch.column(0).to_pylist()], np.int64)
            numbers = np.array([lang_number(x) for x in codes], np.uint64)
            keys = batch.column(1).to_numpy(zero_copy_only=False)
            words_before = 0  # of a long text, before its next stretch
            for data, offsets, rows, old in stretches(batch.column(2)):
                w = Words(data, offsets)
                counted = len(word_starts(data[:old]))
                before = words_before - counted if old else 0
                words_before = before + len(w.starts)
                if n == 1:
                    for x, many in zip(*np.unique(code[rows[w.doc[counted:]]], return_counts=True)):
                        totals[int(x)] = totals.get(int(x), 0) + int(many)
                first = w.runs(n)
                first = first[first + n > counted]
                if bits is not None and len(first):
                    shorter = w.runs(n - 1)
                    ok = np.zeros(len(w.starts) + 1, bool)
                    ok[shorter] = bits.has(*w.prints(shorter, n - 1), numbers[code[rows[w.doc[shorter]]]])
                    first = first[ok[first] & ok[first + 1]]
                if not len(first):
                    continue
                base, doc = np.searchsorted(w.doc, np.arange(len(rows))), w.doc[first]
                held.append((*w.prints(first, n), code[rows[doc]], keys[rows[doc]], first - base[doc] + before))
                size += len(first)
                if size >= HELD:
                    yield from told(held, list(codes))
                    held, size = [], 0
            batch = data = w = keys = None  # the next batch comes when this one is gone
        if held:
            yield from told(held, list(codes))
        if totals:
            zero = pa.array(np.zeros(len(totals), np.int64))
            each = [list(codes)[x] for x in totals]
            yield pa.RecordBatch.from_arrays([pa.array(each, pa.string()), zero, zero, pa.array(list(totals.values()), pa.int64()), zero, zero], names=RUN)

    rows = df.select("lang", "text_key", "text").mapInArrow(run, "lang string, a long, b long, f long, text_key long, word long")
    place = [F.first(c).alias(c) for c in ("text_key", "word")] if n > 1 else []  # both of the same row
    return rows.groupBy("lang", "a", "b").agg(F.sum("f").alias("f"), *place)


def written_out(df: DataFrame, frequent: DataFrame) -> DataFrame:
    """The frequent phrases (``lang``, ``a``, ``b``, ``f``, ``n``, ``text_key``, ``word``) as text: adds ``phrase``, ``cuts`` (after each of its words the
    fingerprints of both parts) and ``inside`` (fingerprints of its shorter phrases).

    Each phrase is read where it occurs and its fingerprint is checked against what stands there, so a text key that two
    texts share leads to the right one. Copies of a text are read once.
    """
    wanted = frequent.groupBy("text_key").agg(F.collect_list(F.struct("lang", "a", "b", "f", "n", "word")).alias("at"))  # no more than the text has words
    # Copies become one in the map tasks; two texts under one key stay two.
    texts = df.groupBy("text_key").agg(F.collect_set("text").alias("texts"))
    met = texts.join(wanted, "text_key").select(F.explode("texts").alias("text"), "at").select(F.col("text").cast("binary").alias("text"), "at")
    schema = ("lang string, a long, b long, f long, n long, phrase string, cuts array<struct<k:long,la:long,lb:long,ra:long,rb:long>>, "
              "inside array<struct<a:long,b:long>>")
    long, sides = pa.int64(), ("k", "la", "lb", "ra", "rb")
    arrow = pa.schema([("lang", pa.string()), ("a", long), ("b", long), ("f", long), ("n", long), ("phrase", pa.string()),
                       ("cuts", pa.list_(pa.struct([(x, long) for x in sides]))), ("inside", pa.list_(pa.struct([("a", long), ("b", long)])))])

    def checked(asked: list[dict], found: list[bytes]) -> Iterator[dict]:
        """Rows of the phrases whose fingerprints are those asked for."""
        w = Words(np.frombuffer(b"".join(found), np.uint8), np.cumsum([0, *map(len, found)])[:-1])
        base = np.searchsorted(w.doc, np.arange(len(found) + 1))
        length = np.diff(base)
        for n in set(q["n"] for q in asked):
            which = np.array([i for i, q in enumerate(asked) if q["n"] == n and length[i] == n], np.int64)
            part = {(k, m): [x.tolist() for x in w.prints(base[which] + k, m)] for m in range(1, n + 1) for k in range(n - m + 1)}
            for j, i in enumerate(which.tolist()):
                q, at = asked[i], lambda k, m: (part[k, m][0][j], part[k, m][1][j])  # noqa: B023
                if at(0, n) == (q["a"], q["b"]):
                    yield {"lang": q["lang"], "a": q["a"], "b": q["b"], "f": q["f"], "n": n, "phrase": found[i].decode("utf-8", "replace"),
                           "cuts": [dict(zip(sides, (k, *at(0, k), *at(k, n - k)))) for k in range(1, n)],
                           "inside": [dict(zip("ab", at(k, m))) for k, m in part if 1 < m < n]}

    def run(batches):
        for batch in batches:
            asked, found, size = [], [], 0
            for text, wishes in zip(batch.column(0), batch.column(1)):
                line, starts, ends = _read(text.as_py())
                for q in wishes.as_py():
                    if q["word"] + q["n"] <= len(starts):
                        asked.append(q)
                        found.append(line[starts[q["word"]]:ends[q["word"] + q["n"] - 1]].tobytes())
                        size += len(found[-1])
                if size > PIECE or len(asked) > 1 << 14:
                    yield pa.RecordBatch.from_pylist(list(checked(asked, found)), schema=arrow)
                    asked, found, size = [], [], 0
            if asked:
                yield pa.RecordBatch.from_pylist(list(checked(asked, found)), schema=arrow)

    return met.mapInArrow(run, schema).dropDuplicates(["lang", "a", "b"])


def _read(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All words of a whole text: bytes of the line, starts and ends."""
    lines, starts, ends, size = [], [], [], 0
    data = np.frombuffer(text, np.uint8)
    for part, old in _cuts(data, 0) if len(data) > PIECE else [(data, 0)]:
        w = Words(part, np.array([0]))
        lines.append(w.line)
        starts.append(w.starts + size)
        ends.append(w.ends + size)
        size += len(w.line)
    return np.concatenate(lines), np.concatenate(starts), np.concatenate(ends)


def integer_score(a: Column, left: Column, right: Column) -> Column:
    """floor(1000000 a a / (l r)), exact: products are decimals of up to 38 digits (counts below 10^15)."""
    wide = lambda c: c.cast("decimal(15,0)")
    return F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (wide(a) * wide(a)), wide(left) * wide(right))


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", longest: int = 3, least: int = 10, top: int = 2000, inside_percent: int = 50) -> DataFrame:
    """Per language the first ``top`` phrases of two to ``longest`` words: ``lang``, ``rank``, ``phrase``, ``a``, ``l``, ``r``, ``n``, ``score``.

    A-Z are lower-cased, texts split at ``.,;:!?`` and line ends into pieces and these at blanks into words. ``a`` counts a phrase's occurrences
    (at least ``least``), overlaps included; the lowest of the scores floor(10^6 a a / (l r)) over its cuts counts (first cut on ties), with
    ``l`` and ``r`` the counts of both parts; ``n`` counts the language's words. Phrases inside a longer candidate with at least ``inside_percent``
    per cent of their occurrences are left out. Order: score, a (both descending), phrase by bytes.

    A null language is ``und``, a null text empty. Repeated rows count each; texts are read whole, long ones in stretches; other columns are
    ignored; an empty table gives an empty one. Equal phrases are told by 124 bits of fingerprint.
    """
    docs = df.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text")).filter("text IS NOT NULL") \
        .select("lang", F.xxhash64("text").alias("text_key"), "text")
    counted, below, frequent = [], None, []
    for n in range(1, longest + 1):
        found = cut_lineage(run_counts(docs, n, below).filter((F.col("f") >= least) | ((F.col("a") == 0) & (F.col("b") == 0))))
        real = found.filter("a <> 0 OR b <> 0")
        counted.append(real.select("lang", "a", "b", "f"))
        if n == 1:
            totals = found.filter("a = 0 AND b = 0").select("lang", F.col("f").alias("total"))
        else:
            frequent.append(real.withColumn("n", F.lit(n).cast("long")))
        if n < longest:
            below = frequent_bits(real)
    candidates, counts = frequent[0], counted[0]
    for f, c in zip(frequent[1:], counted[1:-1]):
        candidates, counts = candidates.unionByName(f), counts.unionByName(c)
    candidates = cut_lineage(written_out(docs, candidates))
    longer = candidates.filter("n > 2").select("lang", "f", F.explode("inside").alias("i")).groupBy("lang", "i.a", "i.b").agg(F.max("f").alias("_longer"))
    free = candidates.join(longer, ["lang", "a", "b"], "left").filter(F.col("_longer").isNull() | (100 * F.col("_longer") < inside_percent * F.col("f")))
    cuts = free.select("lang", "phrase", F.col("f").alias("a"), F.explode("cuts").alias("c")).select("lang", "phrase", "a", "c.*")
    side = lambda x, name: counts.select("lang", F.col("a").alias(f"{x}a"), F.col("b").alias(f"{x}b"), F.col("f").alias(name))
    scored = cuts.join(side("l", "l"), ["lang", "la", "lb"]).join(side("r", "r"), ["lang", "ra", "rb"]) \
        .withColumn("score", integer_score(F.col("a"), F.col("l"), F.col("r")))
    best = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.score", "x.a", "x.l", "x.r")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")


def oracle_sql(least: int = 10, top: int = 2000) -> str:
    """DuckDB SQL for ``phrases`` of two and three words."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return f"""
    WITH pieces AS (
        SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS w FROM (
            SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, '{upper}', '{lower}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents)),
    spots AS (SELECT lang, w, unnest(generate_series(1, len(w))) AS i FROM pieces WHERE len(w) > 0),
    runs AS (SELECT lang, n, w[i:i + n - 1] AS p FROM spots, (VALUES (1), (2), (3)) AS s(n) WHERE i + n - 1 <= len(w)),
    f AS (SELECT lang, n, p, count(*) AS f FROM runs GROUP BY ALL),
    totals AS (SELECT lang, sum(f)::BIGINT AS total FROM f WHERE n = 1 GROUP BY lang),
    candidates AS (SELECT * FROM f WHERE n > 1 AND f >= {least}),
    longer AS (SELECT lang, p[k:k + 1] AS p, max(f) AS longer FROM candidates, (VALUES (1), (2)) AS s(k) WHERE n = 3 GROUP BY ALL),
    free AS (SELECT c.* FROM candidates c LEFT JOIN longer l ON c.n = 2 AND c.lang = l.lang AND c.p = l.p WHERE l.longer IS NULL OR 100 * l.longer < 50 * c.f),
    cuts AS (SELECT c.lang, c.p, c.f AS a, k, l.f AS l, r.f AS r, (1000000::HUGEINT * c.f * c.f) // (l.f::HUGEINT * r.f) AS score
        FROM free c, (VALUES (1), (2)) AS s(k), f l, f r
        WHERE k < c.n AND l.lang = c.lang AND l.p = c.p[1:k] AND r.lang = c.lang AND r.p = c.p[k + 1:c.n]),
    best AS (SELECT lang, array_to_string(p, ' ') AS phrase, a, l, r, score FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, k) = 1),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
    SELECT lang, rank, phrase, a, l, r, total AS n, score::BIGINT AS score FROM ranked JOIN totals USING (lang) WHERE rank <= {top}"""

"""Token counts by prefix dynamic programming.

For every prefix of a piece the last token of its encoding is found from shorter prefixes: of
the tokens that end there, exactly one is compatible with the last token before it. That gives the
exact count at every prefix, so truncation and budgets need no further encoding.
"""

from __future__ import annotations

from bisect import bisect_left
from itertools import accumulate, islice

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm.bytebpe import CHUNKS, WHITE, ByteBpe, recent, vocabulary
from tideline.llm.worker import slices, texts_of

ADDED = ("n_bytes", "n_tokens", "over_limit", "fit_chars")


def piece_counts(v: ByteBpe, piece: bytes) -> list[int]:
    """Tokens of each prefix of a piece, the empty one first."""
    last, count, done, pairs = [-1] * (len(piece) + 1), [0] * (len(piece) + 1), 0, v.pairs
    for at, (t, size) in v.endings().iter(piece.decode("latin-1")):  # of each place, the tokens that end there
        end = at + 1
        if end == done:
            continue
        begin = at + 1 - size
        if begin:
            ok = pairs.get(last[begin] << 32 | t)
            if not (v.compatible(last[begin], t) if ok is None else ok):
                continue
        last[end], count[end], done = t, count[begin] + 1, end
    return count


def prefix_counts(v: ByteBpe, text: str) -> list[int]:
    """Exact token count of every prefix of ``text`` by code points, the empty prefix first."""
    out, done = [0], 0
    parts = v.split_special(text)
    for at, part in enumerate(parts):
        if part in v.special:
            tail = prefix_counts_plain(v, part, "")  # until its last letter it is ordinary text
            before = parts[at - 1]
            if before:
                joined = prefix_counts_plain(v, before + part[:-1], "")
                base = out[-1] - joined[len(before)]
                tail = [0, *(c + base - done for c in joined[len(before) + 1:]), 1]
            out += [done + c for c in tail[1:-1]] + [done + 1]
            done += 1
        else:
            out += [done + c for c in prefix_counts_plain(v, part, "")[1:]]
            done = out[-1]
    return out


def prefix_counts_plain(v: ByteBpe, text: str, before: str) -> list[int]:
    """The same for text without special strings."""
    out, base, spaces = [0], 0, before
    for piece in v.pieces(text):
        own = _piece_prefixes(v, piece)
        if spaces and piece[0] in WHITE:
            # Cut behind the white space of this piece, that space joins the run before it.
            run = _piece_prefixes(v, spaces + piece[0])[-1] - _piece_prefixes(v, spaces)[-1]
            own = [0, run, *own[2:]]
        out += [base + c for c in own[1:]]
        spaces = piece if piece[-1] in WHITE else ""
        base += _piece_prefixes(v, piece)[-1]
    return out


def _piece_prefixes(v: ByteBpe, piece: str) -> list[int]:
    raw = piece.encode()
    counts = piece_counts(v, raw)
    if piece in ("'re", "'ve", "'ll"):  # a contraction cut short is a mark and a letter
        return [0, counts[1], counts[1] + piece_counts(v, raw[1:2])[1], counts[-1]]
    if len(raw) == len(piece):
        return counts
    ends = accumulate((len(c.encode()) for c in piece), initial=0)
    return [counts[e] for e in ends]


def fitting(v: ByteBpe, text: str, limit: int, cache=None) -> int:
    """Code points of the longest prefix of at most ``limit`` tokens that does not end inside a special
    string, from counts at chunk ends and the prefix counts of the two chunks before the limit."""
    if limit < 1:
        return 0
    done = at = best = 0
    for part in v.split_special(text):
        if part in v.special:
            if done >= limit:
                break
            done, at = done + 1, at + len(part)
            best = at
            continue
        if done >= limit:
            break
        found = list(islice(CHUNKS.finditer(part), limit - done + 2))  # each chunk is a token at least
        found = [m.group() for m in found]
        table = chunk_counts(v, found, cache)
        sums = [done, *accumulate((table[c] for c in found), initial=done)][1:]
        stop = bisect_left(sums, limit + 1)
        if stop < len(sums):  # the limit lies in the chunk that ends at ``stop``
            cuts = [0, *accumulate(map(len, found))]
            first = max(0, stop - 2)
            tail = prefix_counts_plain(v, "".join(found[first:stop]), "")
            fits = [i for i, c in enumerate(tail) if sums[first] + c <= limit]
            return max(best, at + cuts[first] + max(fits))
        done, at = sums[-1], at + len(part)
        best = at
    return best


def chunk_counts(v: ByteBpe, found: list[str], cache=None) -> dict[str, int]:
    """Tokens of each chunk."""
    known, unknown = cache.find(found) if cache else ({}, list(dict.fromkeys(found)))
    if not unknown:
        return known
    cut = [v.pieces(chunk) for chunk in unknown]
    pieces = list(dict.fromkeys(p for own in cut for p in own))
    of, new = cache.find(pieces) if cache else ({}, pieces)
    for piece in new:
        of[piece] = piece_counts(v, piece.encode())[-1]
        if cache and len(piece) <= 64:
            cache.put(piece, of[piece])
    for chunk, own in zip(unknown, cut, strict=True):
        known[chunk] = total = sum(map(of.__getitem__, own))
        if cache and len(own) > 1 and len(chunk) <= 64:
            cache.put(chunk, total)
    return known


def count_tokens(df: DataFrame, path: str, text: str = "text", limit: int = 512) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens``, ``over_limit`` (more than ``limit`` tokens) and ``fit_chars`` (code
    points of the longest prefix within the limit).

    Every row stays, repeated rows too; a null text counts as empty (0, 0, false, 0). Columns with the
    added names are replaced, all others pass. Work and memory are those of a slice of rows; nothing is
    shuffled.
    """
    keep = [c for c in df.columns if c not in ADDED]
    source = df.select(*keep, F.col(text).alias("_counted"))

    def run(batches):
        v, cache = vocabulary(path), recent("chunk counts", path, lambda n: 0)
        for batch in slices(batches):
            rows = []
            for t in texts_of(batch.column(batch.num_columns - 1)):
                total = 0
                for part in v.split_special(t):
                    if part in v.special:
                        total += 1
                    elif part:
                        found = CHUNKS.findall(part)
                        total += sum(map(chunk_counts(v, found, cache).__getitem__, found))
                rows.append((len(t.encode()), total, total > limit, len(t) if total <= limit else fitting(v, t, limit, cache)))
            cols = list(zip(*rows, strict=True))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *(pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int64(), pa.bool_(), pa.int64()), strict=True))],
                names=[*keep, *ADDED])

    schema = source.drop("_counted").schema
    for name, kind in zip(ADDED, ("long", "long", "boolean", "long"), strict=True):
        schema = schema.add(name, kind)
    return source.mapInArrow(run, schema)

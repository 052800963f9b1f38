"""Byte-pair encoding by speculation: propose tokens greedily, verify all neighbours, merge the rest.

The longest token that fits is proposed at each place, by an automaton that goes through all new words
of a slice. The proposal is the encoding exactly if all its neighbours are compatible, which is checked
for all these words at once in sorted arrays. Only words with a failing pair are merged by the
definition, side by side.
"""

from __future__ import annotations

import hashlib
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.llm.bytebpe import CHUNKS, OWNER, ByteBpe, cut, recent, vocabulary
from tideline.llm.worker import kept, slices, texts_of

ADDED = ("ids", "decoded")
BETWEEN = "\u0100"  # no byte, so no token goes over it


def propose(v: ByteBpe, word: bytes) -> list[int]:
    """Greedy longest match from the left."""
    return [t for _, t in v.greedy().iter_long(word.decode("latin-1"))]


def propose_all(v: ByteBpe, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The proposals for many words, one after the other, and the number of the word that each token is from."""
    found = v.greedy().iter_long(BETWEEN.join([w.decode("latin-1") for w in words]))
    flat = np.fromiter((t for _, t in found), np.int64)
    word_ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
    return flat, np.searchsorted(word_ends, np.cumsum(v.lengths[flat]))


class Verdicts:
    """Known verdicts on neighbours: sorted keys with their answers, and the newest ones beside them."""

    def __init__(self, v: ByteBpe):
        self.v, self.keys, self.right = v, np.empty(0, np.int64), np.empty(0, bool)

    def of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys, back = np.unique(left << 32 | right, return_inverse=True)
        if not len(keys):
            return np.empty(0, bool)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        told = np.zeros(len(keys), bool)
        told[known] = self.right[at[known]]
        new = np.flatnonzero(~known)
        if len(new):
            of = self.v.bytes_of
            merged = self.v.exact_all([of[k >> 32] + of[k & 0xFFFFFFFF] for k in keys[new].tolist()])
            pairs = cut(np.stack([keys[new] >> 32, keys[new] & 0xFFFFFFFF], 1).ravel(), np.full(len(new), 2))
            told[new] = [m == pair for m, pair in zip(merged, pairs, strict=True)]
            if len(self.keys) + len(new) > 2_000_000:
                self.keys, self.right = keys, told
            else:
                self.keys = np.insert(self.keys, at[new], keys[new])
                self.right = np.insert(self.right, at[new], told[new])
        return told[back]


def encode_words(v: ByteBpe, words: list[str], verdicts: Verdicts) -> list[list[int]]:
    """Encodings of pieces, and the same as merging by definition."""
    return [np.frombuffer(p, "<u4").tolist() for p in pack_words(v, words, verdicts)]


def pack_words(v: ByteBpe, words: list[str], verdicts: Verdicts) -> list[bytes]:
    """The same as little-endian unsigned 32-bit numbers."""
    words = [w.encode() for w in words]
    flat, owner = propose_all(v, words)
    inner = owner[1:] == owner[:-1]
    fails = np.zeros(len(words), bool)
    ok = verdicts.of(flat[:-1][inner], flat[1:][inner])
    fails[owner[1:][inner][~ok]] = True
    used = np.unique(flat)
    fails[owner[~np.array([v.stands(t) for t in used.tolist()], bool)[np.searchsorted(used, flat)]]] = True
    found = cut(flat, np.bincount(owner, minlength=len(words)))
    failing = np.flatnonzero(fails).tolist()
    for i, merged in zip(failing, v.exact_all([words[i] for i in failing]), strict=True):
        found[i] = merged
    return found


def encode_texts(v: ByteBpe, texts: list[str], cache, verdicts: Verdicts) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit numbers."""
    split = [[(part, None if part in v.special else CHUNKS.findall(part)) for part in v.split_special(t) if part] for t in texts]
    known, unknown = cache.find([c for parts in split for _, found in parts if found for c in found])
    if unknown:
        parted = {c: own for c in unknown if len(own := v.pieces(c)) > 1}
        packed, new = cache.find([*chain.from_iterable(parted.values()), *(c for c in unknown if c not in parted)])
        fresh = dict(zip(new, pack_words(v, new, verdicts), strict=True))
        packed |= fresh
        joined = {c: b"".join(map(packed.__getitem__, own)) for c, own in parted.items()}
        cache.put_all({c: ids for c, ids in (fresh | joined).items() if len(c) <= 64})
        known |= packed | joined
    special = {s: np.array([i], "<u4").tobytes() for s, i in v.special.items()}
    return [b"".join(special[part] if found is None else b"".join(map(known.__getitem__, found)) for part, found in parts)
            for parts in split]


def decode_ids(v: ByteBpe, ids: bytes) -> str:
    """Text of ids; bytes that are no text become replacement characters."""
    told = v.letters.take(pa.array(np.frombuffer(ids, "<u4")))
    if told.null_count:
        raise KeyError("an id without a token")
    return told.buffers()[2].to_pybytes().decode("utf-8", "replace") if len(ids) else ""


def ids_array(packed: list[bytes]) -> pa.ListArray:
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(packed), "<u4").astype(np.int32)))


def _encoder(path: str):
    v = vocabulary(path)
    return v, recent("chunk ids", path), kept(f"verdicts:{path}", lambda: Verdicts(v), OWNER)


def encode(df: DataFrame, path: str, text: str = "text") -> DataFrame:
    """Adds ``ids`` (array of int). Every row stays; a null text is the empty one. A column ``ids`` is replaced."""
    keep = [c for c in df.columns if c != "ids"]

    def run(batches):
        v, cache, verdicts = _encoder(path)
        for batch in slices(batches):
            packed = encode_texts(v, texts_of(batch.column(batch.num_columns - 1)), cache, verdicts)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids_array(packed)], names=[*keep, "ids"])

    source = df.select(*keep, F.col(text).alias("_encoded"))
    return source.mapInArrow(run, source.drop("_encoded").schema.add("ids", T.ArrayType(T.IntegerType())))


def decode(df: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """Adds ``decoded``. Null ids give the empty text."""
    keep = [c for c in df.columns if c != "decoded"]

    def run(batches):
        v = vocabulary(path)
        for batch in slices(batches):
            texts = [decode_ids(v, np.array(x or (), "<u4").tobytes()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], names=[*keep, "decoded"])

    source = df.select(*keep, F.col(ids).alias("_decoded"))
    return source.mapInArrow(run, source.drop("_decoded").schema.add("decoded", "string"))


def round_trip(df: DataFrame, path: str, text: str = "text", with_ids: bool = False) -> DataFrame:
    """Adds ``n_tokens``, ``ids_sha256`` (of the ids as little-endian unsigned 32-bit numbers) and
    ``decoded_sha256`` (of the text that the ids give back), without passing ids between processes; with ``with_ids`` also ``ids`` (array of int).

    Every row stays, repeated rows too; a null text counts as empty. Columns with these names are replaced.
    """
    added = (*(["ids"] if with_ids else []), "n_tokens", "ids_sha256", "decoded_sha256")
    keep = [c for c in df.columns if c not in added]

    def run(batches):
        v, cache, verdicts = _encoder(path)
        for batch in slices(batches):
            packed = encode_texts(v, texts_of(batch.column(batch.num_columns - 1)), cache, verdicts)
            new = [ids_array(packed)] if with_ids else []
            new += [pa.array([len(p) // 4 for p in packed], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                    pa.array([hashlib.sha256(decode_ids(v, p).encode()).hexdigest() for p in packed], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *new], names=[*keep, *added])

    source = df.select(*keep, F.col(text).alias("_encoded"))
    schema = source.drop("_encoded").schema
    if with_ids:
        schema = schema.add("ids", T.ArrayType(T.IntegerType()))
    schema = schema.add("n_tokens", "long").add("ids_sha256", "string").add("decoded_sha256", "string")
    return source.mapInArrow(run, schema)

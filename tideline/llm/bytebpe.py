"""Byte-pair vocabulary: reading it, splitting text into pieces, exact merging, pair checks.

The vocabulary file is a parameter and is read on each worker. Two facts carry both token
operators: a sequence of tokens is the encoding of its bytes exactly if every token encodes to
itself and every two neighbours encode to themselves, and text is cut at pieces that never merge.
"""

from __future__ import annotations

import heapq
import json
import re

import numpy as np
import pyarrow as pa

from tideline.llm.worker import Recent, kept

# The split pattern of this kind of vocabulary and the white space it knows.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space belongs to the word after it, so text may be cut here before the finer split.
CHUNKS = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
# The same split for text whose characters all lie below U+0250, told by lists of its letters and numbers.
LETTERS, NUMBERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe"
NEAR = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACE}{LETTERS}{NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
FAR = re.compile("[^\0-\u024f]")
WHITE = {chr(c) for c in range(0x3001) if re.match(f"[{SPACE}]", chr(c))}
NONE = 1 << 62
SHORT = 48  # bytes of words that are merged many at once
AT_ONCE = 4096  # words merged at once
PLACES = 64  # a rank and a place below this make one number
PAIRS_KEPT = 1_000_000
BYTES_KEPT = 40 << 20  # of words and their tokens, twice
OWNER = "tokens"  # of what a worker keeps: counting and encoding share it


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in vocabulary files: printable bytes stand for themselves."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {chr(b): b for b in own}
    for i, b in enumerate(b for b in range(256) if b not in set(own)):
        table[chr(256 + i)] = b
    return table


def cut(flat: np.ndarray, sizes: np.ndarray) -> list[bytes]:
    """Tokens that follow each other as little-endian unsigned 32-bit numbers, the first ``sizes[0]`` of them, and so on."""
    packed, ends = flat.astype("<u4").tobytes(), (4 * np.cumsum(sizes)).tolist()
    return [packed[a:b] for a, b in zip([0, *ends], ends, strict=False)]


class ByteBpe:
    """A vocabulary with its merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        letters = byte_letters()
        model = told["model"]
        if model["type"] != "BPE" or told["normalizer"] or told["pre_tokenizer"] != {
                "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            raise ValueError("only byte-level vocabularies without a normalizer are read")
        if model.get("ignore_merges"):
            raise ValueError("whole-word tokens without merges are not read")
        as_bytes = lambda token: bytes(letters[c] for c in token)
        self.ids = {as_bytes(t): i for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        if any(t[k] for t in told["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
            raise ValueError("added tokens with options are not read")
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.size = max(self.bytes_of) + 1
        self.letters = pa.array([self.bytes_of.get(i) for i in range(self.size)], pa.large_binary())
        self.lengths = np.array([len(self.bytes_of.get(i, b"")) for i in range(self.size)])
        self.merges: dict[int, int] = {}  # of two ids: the rank and the id made, in one number
        for rank, pair in enumerate(model["merges"]):
            left, right = map(as_bytes, pair.split(" ") if isinstance(pair, str) else pair)
            self.merges[self.ids[left] << 32 | self.ids[right]] = rank << 32 | self.ids[left + right]
        self.one = [self.ids[bytes([b])] for b in range(256)]
        self.far_pieces = regex.compile(PIECES).findall
        self.split_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split \
            if self.special else lambda text: [text]
        self.pairs: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self._endings = self._greedy = self._ranked = None

    def pieces(self, text: str) -> list[str]:
        """The finer split of a text without special strings."""
        return self.far_pieces(text) if FAR.search(text) else NEAR.findall(text)

    def greedy(self):
        """An automaton that gives the longest tokens from the left."""
        if self._greedy is None:
            import ahocorasick

            self._greedy = ahocorasick.Automaton(ahocorasick.STORE_INTS)
            for t, i in self.ids.items():
                self._greedy.add_word(t.decode("latin-1"), i)
            self._greedy.make_automaton()
        return self._greedy

    def endings(self):
        """An automaton that gives, for each place of a byte string, the tokens that end there, longest first.

        Tokens whose own bytes encode otherwise never occur in an encoding and are left out.
        """
        if self._endings is None:
            import ahocorasick

            found = ahocorasick.Automaton()
            for t, i in self.ids.items():
                if self.stands(i):
                    found.add_word(t.decode("latin-1"), (i, len(t)))
            found.make_automaton()
            self._endings = found
        return self._endings

    def exact(self, word: bytes) -> list[int]:
        """The encoding by definition: merge the neighbours of lowest rank, leftmost first, until none merge."""
        ids = [self.one[b] for b in word]
        n, merges = len(ids), self.merges
        if n < 2:
            return ids
        if n > 48:
            return self._exact_long(ids)
        get = merges.get
        told = [get(a << 32 | b, NONE) for a, b in zip(ids, ids[1:], strict=False)]
        while told:
            least = min(told)
            if least == NONE:
                break
            at = told.index(least)
            ids[at] = made = least & 0xFFFFFFFF
            del ids[at + 1], told[at]
            if at < len(told):
                told[at] = get(made << 32 | ids[at + 1], NONE)
            if at:
                told[at - 1] = get(ids[at - 1] << 32 | made, NONE)
        return ids

    def _exact_long(self, ids: list[int]) -> list[int]:
        """The same with a heap and links, for words of any length."""
        n, merges = len(ids), self.merges
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []

        def offer(i: int, j: int) -> None:
            m = merges.get(ids[i] << 32 | ids[j])
            if m is not None:
                heapq.heappush(heap, (m >> 32, i, ids[i], ids[j], m & 0xFFFFFFFF))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = made, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                offer(i, k)
            if before[i] >= 0:
                offer(before[i], i)
        return [t for t in ids if t >= 0]

    def _ranks(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Sorted pairs that merge and the rank of each, the tokens made by rank, and the ranks of all pairs of bytes."""
        if self._ranked is None:
            pairs = np.fromiter(self.merges, np.int64, len(self.merges))
            told = np.fromiter(self.merges.values(), np.int64, len(self.merges))
            order, by_rank = np.argsort(pairs), np.argsort(told)
            ranks = np.argsort(by_rank)[order]
            one = np.array(self.one)
            self._ranked = np.append(pairs[order], NONE), np.append(ranks, 0), told[by_rank] & 0xFFFFFFFF, None
            self._ranked = *self._ranked[:3], self._rank(np.repeat(one, 256), np.tile(one, 256))
        return self._ranked

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, beyond the last rank for pairs that do not merge."""
        pairs, ranks, _, _ = self._ranked
        wanted = left << 32 | right
        at = np.searchsorted(pairs, wanted)
        return np.where(pairs[at] == wanted, ranks[at], len(ranks))

    def exact_all(self, words: list[bytes]) -> list[bytes]:
        """``exact`` of many words, each as little-endian unsigned 32-bit numbers. Words of like length are merged side by side, each by one merge a step."""
        out = [b"" if len(w) <= SHORT else np.array(self.exact(w), "<u4").tobytes() for w in words]
        short = sorted((i for i, w in enumerate(words) if len(w) <= SHORT), key=lambda i: len(words[i]))
        for at in range(0, len(short), AT_ONCE):
            own = short[at:at + AT_ONCE]
            for i, ids in zip(own, self._side_by_side([words[i] for i in own]), strict=True):
                out[i] = ids
        return out

    def _side_by_side(self, words: list[bytes]) -> list[bytes]:
        """Merges words of at most ``SHORT`` bytes: a column a word, its tokens linked, and of each token the rank with the next one."""
        _, ranks, made_by, first = self._ranks()
        n, sizes = len(words), np.fromiter(map(len, words), np.int64, len(words))
        high, none = int(sizes.max()), len(ranks) * PLACES
        letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        column = np.repeat(np.arange(n), sizes)
        row = np.arange(len(column)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        ids = np.full((high + 1, n), self.size)  # a token that merges with none, also in the last row
        ids[row, column] = np.array(self.one)[letters]
        told = np.full((high + 1, n), none)
        inner = column[1:] == column[:-1]
        told[row[:-1][inner], column[1:][inner]] = (first[letters[:-1] << 8 | letters[1:]] * PLACES + row[:-1])[inner]
        after = np.repeat(np.arange(1, high + 2), n)
        before = np.repeat(np.arange(-1, high), n)
        before[:n] = high
        flat_ids, flat_told = ids.ravel(), told.ravel()
        while True:
            least = told.min(axis=0)
            live = np.flatnonzero(least < none)
            if not len(live):
                break
            place, made = least[live] % PLACES, made_by[least[live] // PLACES]
            here = place * n + live
            gone = after[here] * n + live
            behind = after[gone]
            flat_ids[here], flat_ids[gone], flat_told[gone] = made, -1, none
            after[here], before[behind * n + live] = behind, place
            flat_told[here] = self._rank(made, flat_ids[behind * n + live]) * PLACES + place
            ahead = before[here]
            flat_told[ahead * n + live] = self._rank(flat_ids[ahead * n + live], made) * PLACES + ahead
        left = ((ids >= 0) & (ids < self.size)).T
        return cut(ids.T[left], left.sum(axis=1))

    def stands(self, token: int) -> bool:
        """Whether the bytes of a token encode to that token."""
        told = self.alone.get(token)
        if told is None:
            told = self.alone[token] = self.exact(self.bytes_of[token]) == [token]
        return told

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of two tokens that stand encode to these two."""
        key = a << 32 | b
        told = self.pairs.get(key)
        if told is None:
            if len(self.pairs) >= PAIRS_KEPT:
                self.pairs.clear()
            told = self.pairs[key] = self.exact(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return told


def vocabulary(path: str) -> ByteBpe:
    """The vocabulary of this worker process, read once."""
    return kept(f"bytebpe:{path}", lambda: ByteBpe(path), OWNER)


def recent(name: str, path: str, weigh=len) -> Recent:
    return kept(f"{name}:{path}", lambda: Recent(BYTES_KEPT, weigh), OWNER)

"""Scores of a log-bilinear language model, trained in numpy with noise-contrastive estimation.

The model predicts the next token from the two before it: their vectors, weighed by position, add up to a predicted
vector, whose products with the vectors of all outputs, plus a bias, are normalised to probabilities. Outputs are the most frequent
tokens and, for all other tokens, classes by their last letters. The frequent tokens of a class are the leaves of a binary tree,
whose nodes have vectors and biases too: the same predicted vector decides at each node on the way to a token. One more leaf is for
the tokens of the class below the least share; there a token has its share of their counts, with one place for unknown
ones. So probabilities over all tokens add up to one, and as a context every frequent token has its own vector.

Training reads every training document: each task makes one pass of noise-contrastive steps over its own
documents from common values (at the nodes of trees plain logistic steps), and each row of values is averaged over
the tasks that moved it, by how often they did. Counts of tokens are a shuffled table that grows
with the corpus; only the frequent tokens, whose number is bounded by their share, travel to the tasks.
"""

from __future__ import annotations

import itertools
import uuid
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.worker import kept, slices
from tideline.session import cut_lineage

CLASSES, CLASS_BITS = 64, 63
ADD = 0.1  # added to every count
END = xxhash.xxh64_intdigest(b" end") & ~CLASS_BITS  # no word holds a space


class _Tokens(dict):
    def __missing__(self, word):
        if len(self) > 400_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word) & ~CLASS_BITS | xxhash.xxh32_intdigest(word[-2:]) & CLASS_BITS
        return value


def tokens_of(text: str) -> np.ndarray:
    """A 64-bit number for each word, A-Z lower-cased, and one for the end; the last six bits are its class."""
    found = text.encode().lower().split()
    out = np.empty(len(found) + 1, np.uint64)
    out[:-1] = np.fromiter(map(kept("lm tokens", _Tokens).__getitem__, found), np.uint64, len(found))
    out[-1] = END
    return out


def _endings() -> np.ndarray:
    """Classes of the words that end in two given bytes, and of those of a single byte."""
    two = [xxhash.xxh32_intdigest(bytes(x)) for x in itertools.product(range(256), repeat=2)]
    return np.array(two + [xxhash.xxh32_intdigest(bytes([x])) for x in range(256)], np.uint64) & np.uint64(CLASS_BITS)


def _numbers(words: pa.BinaryArray) -> np.ndarray:
    """The numbers of different words, as in ``tokens_of``."""
    out = np.fromiter(map(xxhash.xxh64_intdigest, words.to_numpy(zero_copy_only=False)), np.uint64, len(words)) & ~np.uint64(CLASS_BITS)
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset:words.offset + len(words) + 1].astype(np.int64)
    data, at = np.frombuffer(words.buffers()[2] or b"", np.uint8), np.flatnonzero(np.diff(ends))
    last = ends[at + 1] - 1
    single = last == ends[at]
    ending = np.where(single, 65536, data[np.maximum(last - 1, 0)].astype(np.int64) << 8) + data[last]
    out[at] |= kept("lm endings", _endings)[ending]
    return out


def tokens_in(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``tokens_of`` for a column, a null as the empty text: its distinct tokens, the number of each token's among these, tokens per text.

    Words are told apart in Arrow, so that each different one of a batch is hashed once. The end is the last of the distinct tokens.
    """
    words = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.string()).fill_null("")))
    told = words.flatten().dictionary_encode()
    found = told.dictionary.cast(pa.binary())
    tokens = np.append(_numbers(found), np.uint64(END))
    code = told.indices.to_numpy()
    lengths = np.diff(words.offsets.to_numpy())
    owner = np.repeat(np.arange(len(lengths)), lengths)
    empty = pc.index(found, b"").as_py()
    if empty >= 0:  # before a first and after a last blank
        word = code != empty
        code, owner = code[word], owner[word]
    sizes = np.bincount(owner, minlength=len(lengths)) + 1
    out = np.empty(sizes.sum(), np.int64)
    out[np.arange(len(code)) + owner] = code
    out[np.cumsum(sizes) - 1] = len(tokens) - 1
    return tokens, out, sizes


@dataclass
class Corpus:
    """Counts of the training documents. ``frequent`` tokens are sorted, ``times`` their counts; the first ``short`` outputs are tokens."""

    total: int
    distinct: int
    frequent: np.ndarray
    times: np.ndarray
    shortlist: np.ndarray  # sorted
    short_times: np.ndarray
    mass: np.ndarray  # of each class: counts of its tokens outside the shortlist with ADD each, and ADD for an unknown one
    class_times: np.ndarray
    rest: np.ndarray  # of each class: what ``mass`` is without the frequent tokens
    output_of: np.ndarray  # of each place (the frequent tokens, then the rest of each class): its output
    nodes: np.ndarray  # of each place: the nodes from the top of its class's tree, filled up with -1
    left: np.ndarray  # whether the place is on the left of them
    node_bias: np.ndarray  # logits of the counts on the left

    @property
    def outputs(self) -> int:
        return len(self.shortlist) + CLASSES

    @property
    def places(self) -> int:
        return len(self.frequent) + CLASSES

    def ids(self, tokens: np.ndarray) -> np.ndarray:
        at, found = lookup(self.frequent, tokens)
        return np.where(found, at, len(self.frequent) + (tokens & np.uint64(CLASS_BITS)).astype(np.int64))

    def often(self, most: int) -> np.ndarray:
        """The places, at most ``most``, that occur most often."""
        return np.sort(np.argsort(-np.r_[self.times, self.rest], kind="stable")[:most])

    @property
    def noise(self) -> np.ndarray:
        p = np.concatenate([self.short_times, self.class_times]) + 1.0
        return p / p.sum()


def lookup(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(table):
        return np.zeros(len(keys), np.int64), np.zeros(len(keys), bool)
    at = np.searchsorted(table, keys)
    at[at == len(table)] = 0
    return at, table[at] == keys


def trees(of_class: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``nodes``, ``left`` and ``node_bias`` of one binary tree a class; leaves in the order of their mass, halved by mass at each node.

    ``of_class`` has the class of each leaf, or -1 for what is in no tree.
    """
    order = np.lexsort((-mass, of_class))
    order = order[of_class[order] >= 0]
    sums = np.r_[0.0, np.cumsum(mass[order])]
    lo = np.flatnonzero(np.r_[True, np.diff(of_class[order]) != 0]) if len(order) else np.empty(0, np.int64)
    hi, made, levels = np.r_[lo[1:], len(order)] if len(order) else lo, 0, []
    while len(lo):
        lo, hi = lo[hi - lo > 1], hi[hi - lo > 1]
        mid = np.clip(np.searchsorted(sums, (sums[lo] + sums[hi]) / 2), lo + 1, hi - 1)
        size = hi - lo
        leaf = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
        node = np.full(len(mass), -1, np.int32)
        side = np.zeros(len(mass), bool)
        node[order[leaf]] = np.repeat(made + np.arange(len(lo)), size)
        side[order[leaf]] = leaf < np.repeat(mid, size)
        levels.append((node, side, np.log(sums[mid] - sums[lo]) - np.log(sums[hi] - sums[mid])))
        made += len(lo)
        lo, hi = np.concatenate([lo, mid]), np.concatenate([mid, hi])
    levels = [x for x in levels if len(x[2])]
    if not levels:
        return np.empty((len(mass), 0), np.int32), np.empty((len(mass), 0), bool), np.empty(0)
    return np.stack([x[0] for x in levels], axis=1), np.stack([x[1] for x in levels], axis=1), np.concatenate([x[2] for x in levels])


@dataclass
class Weights:
    """Vectors of contexts (one more than places: the start), outputs and nodes, biases, and weights of the two positions."""

    context: np.ndarray
    output: np.ndarray
    bias: np.ndarray
    node: np.ndarray
    node_bias: np.ndarray
    position: np.ndarray

    def predicted(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        return self.position[0] * self.context.take(h1, axis=0) + self.position[1] * self.context.take(h2, axis=0)

    def rows(self) -> np.ndarray:
        """All values as rows of one width."""
        wide = lambda x, bias: np.hstack([x, bias[:, None]])
        return np.vstack([wide(self.context, np.zeros(len(self.context))), wide(self.output, self.bias), wide(self.node, self.node_bias),
                          wide(self.position, np.zeros(2))]).astype(np.float32)

    @staticmethod
    def of(rows: np.ndarray, corpus: Corpus) -> Weights:
        context, output, node, position = np.split(rows.astype(np.float32), np.cumsum([corpus.places + 1, corpus.outputs, len(corpus.node_bias)]))
        parts = (context[:, :-1], output[:, :-1], output[:, -1], node[:, :-1], node[:, -1], position[:, :-1])
        return Weights(*map(np.ascontiguousarray, parts))


def start_weights(corpus: Corpus, size: int) -> Weights:
    """Nodes start at the counts below them; contexts that may be rare start at nothing."""
    rng, n = np.random.default_rng(7), corpus.outputs
    small = lambda rows: rng.normal(0, 0.5, (rows, size)).astype(np.float32)
    context = np.zeros((corpus.places + 1, size), np.float32)
    often = np.r_[np.flatnonzero(corpus.output_of[:len(corpus.frequent)] < len(corpus.shortlist)), np.arange(len(corpus.frequent), corpus.places + 1)]
    context[often] = small(n + 1)
    return Weights(context, small(n), np.log(corpus.noise).astype(np.float32), np.zeros((len(corpus.node_bias), size), np.float32),
                   corpus.node_bias.astype(np.float32), np.full((2, size), 1.0, np.float32))


def contexts(w: np.ndarray, sizes: np.ndarray, start: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens ``w`` of documents of ``sizes`` in a row, the one before each and the one before that; ``start`` stands before a document."""
    h1, h2 = np.empty_like(w), np.empty_like(w)
    h1[1:], h2[2:] = w[:-1], w[:-2]
    begin = np.cumsum(sizes) - sizes
    h1[begin] = h2[begin] = start
    h2[begin[sizes > 1] + 1] = start
    return w, h1, h2


@dataclass
class Learner:
    """Noise-contrastive steps at the outputs and logistic ones in the trees, with step sizes that fall by the gradients seen."""

    weights: Weights
    corpus: Corpus
    noise: np.ndarray
    samples: int = 32
    batch: int = 1024
    rate: float = 0.15
    seen: list = field(default_factory=list)
    used: list = field(default_factory=list)
    marks: list = field(default_factory=list)

    def learn(self, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, rng: np.random.Generator) -> None:
        """``w``, ``h1`` and ``h2`` are places. What no step changes, as draws and counts, is told for all steps at once."""
        m, told, starts = self.weights, self.corpus, range(0, len(w), self.batch)
        if not self.seen:
            self.seen = [np.full(x.shape, 1.0, np.float32) for x in (m.output, m.bias, m.position, m.context, m.node, m.node_bias)]
            self.used = [np.zeros(n, np.int64) for n in (len(m.context), len(m.output), told.places)]
            self.marks = [np.zeros(len(x), np.int32) for x in (m.context, m.node)]
            self.depth = (told.nodes >= 0).sum(axis=1)
            self.chances = np.cumsum(self.noise)
            self.chances /= self.chances[-1]
            self.shift = np.log(self.samples * self.noise).astype(np.float32)
        false = self.chances.searchsorted(rng.random((len(starts), self.samples)), "right")
        o, depth = told.output_of.take(w), self.depth.take(w)
        for at, wrong in zip(starts, false, strict=True):
            part = slice(at, at + self.batch)
            self.step(w[part], o[part], depth[part], h1[part], h2[part], wrong)
        for used, places in zip(self.used, ((h1, h2), (o, false.ravel()), (w,)), strict=True):
            for x in places:
                used += np.bincount(x, minlength=len(used))

    def moved(self) -> np.ndarray:
        """For each row of the weights, how often it was used."""
        on = self.corpus.nodes >= 0
        node = np.bincount(self.corpus.nodes[on], np.repeat(self.used[2], self.depth), len(self.weights.node)).astype(np.int64)  # sums stay below 2^53
        return np.concatenate([*self.used[:2], node, np.full(len(self.weights.position), self.used[2].sum())])

    def step(self, w, o, depth, h1, h2, false) -> None:
        m, told, shift, n = self.weights, self.corpus, self.shift, len(w)
        before = np.concatenate([h1, h2])
        near = m.context.take(before, axis=0)
        q = m.position[0] * near[:n] + m.position[1] * near[n:]
        outputs, wrong = m.output.take(o, axis=0), m.output.take(false, axis=0)
        true_err = sigmoid(np.einsum("ij,ij->i", q, outputs) + (m.bias - shift).take(o)) - 1
        false_err = q @ wrong.T
        false_err += m.bias[false] - shift[false]
        false_err = sigmoid(false_err)
        outputs *= true_err[:, None]
        dq = false_err @ wrong
        dq += outputs
        both = np.concatenate([o, false])
        out = scatter(both, np.concatenate([true_err[:, None] * q, false_err.T @ q]), m.output.shape)
        bias = np.bincount(both, np.concatenate([true_err, false_err.sum(0)]), len(m.bias))
        tail = np.flatnonzero(depth)
        if len(tail):
            long, after = depth[tail], q.take(tail, axis=0)
            nodes, left = (x.take(w[tail], axis=0)[:, :long.max()] for x in (told.nodes, told.left))
            on = nodes >= 0
            vectors = m.node.take(nodes, axis=0)
            err = sigmoid(np.matmul(vectors, after[:, :, None])[:, :, 0] + m.node_bias.take(nodes)) - left
            err *= on
            dq[tail] += np.matmul(err[:, None, :], vectors)[:, 0]
            node, err = nodes[on].astype(np.int64), err[on]
            grad = after.take(np.repeat(np.arange(len(tail)), long), axis=0)
            grad *= err[:, None]
            some, at, _ = several(node, self.marks[1])
            self.move(m.node, 4, scatter(at, grad, (len(some), q.shape[1])), some)
            self.move(m.node_bias, 5, np.bincount(at, err, len(some)), some)
        position = np.stack([np.diagonal(dq.T @ x) for x in (near[:n], near[n:])])
        some, at, _ = several(before, self.marks[0])
        np.multiply(dq, m.position[0], out=near[:n])
        np.multiply(dq, m.position[1], out=near[n:])
        self.move(m.context, 3, scatter(at, near, (len(some), q.shape[1])), some)
        for i, (value, grad) in enumerate(((m.output, out), (m.bias, bias), (m.position, position))):
            self.move(value, i, grad)

    def move(self, value, which, grad, rows=None) -> None:
        seen, grad = self.seen[which], grad.astype(np.float32, copy=False)
        if rows is None:
            seen += grad * grad
            value -= self.rate * grad / np.sqrt(seen)
        else:
            step = grad * grad
            step += seen.take(rows, axis=0)
            put(seen, rows, step)
            np.sqrt(step, out=step)
            np.divide(grad, step, out=step)
            step *= -self.rate
            step += value.take(rows, axis=0)
            put(value, rows, step)


def put(table: np.ndarray, rows: np.ndarray, values: np.ndarray) -> None:
    """Writes whole rows of a table, each as a single value, which is faster than one number after the other."""
    row = np.dtype((np.void, table[:1].nbytes))
    table.view(row).ravel()[rows] = values.view(row).ravel()


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In the place of ``x``."""
    np.negative(x, out=x)
    np.minimum(x, 30, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


def several(keys: np.ndarray, marks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, for each key its number among these, and their counts; ``marks`` is room for all possible keys, whatever it holds."""
    each = np.arange(len(keys), dtype=marks.dtype)
    marks[keys] = each
    some = keys[marks.take(keys) == each]
    marks[some] = each[:len(some)]
    at = marks.take(keys).astype(np.int64)
    return some, at, np.bincount(at, minlength=len(some))


def scatter(rows: np.ndarray, values: np.ndarray, shape: tuple[int, int]) -> np.ndarray:
    """Sums of the rows of ``values`` that have the same number; two columns are added at once, as a complex number."""
    if shape[1] % 2 or values.dtype != np.float32:
        flat = np.arange(shape[0] * shape[1]).reshape(shape).take(rows, axis=0)
        return np.bincount(flat.ravel(), values.ravel(), shape[0] * shape[1]).reshape(shape)
    out = np.zeros(shape[0] * shape[1] // 2, np.complex64)
    np.add.at(out, np.arange(len(out)).reshape(shape[0], -1).take(rows, axis=0).ravel(), np.ascontiguousarray(values).view(np.complex64).ravel())
    return out.view(np.float32).reshape(shape)


class Norms:
    """Logarithms of the sums, over all outputs, of the powers of their logits after two tokens.

    The two tokens' shares of a logit add up, so their powers multiply: powers are taken once for a token at a position, and the sum is
    the product of two rows. Sums after two of the ``often`` used places are made once in a matrix product. Where both are rare, or a sum leaves the
    range of numbers, powers are taken of whole logits.
    """

    def __init__(self, m: Weights, often: np.ndarray, block: int = 512):
        self.m, self.block = m, block
        self.turned = np.ascontiguousarray(np.hstack([m.output, m.bias[:, None]]).T)
        self.one = np.ones(len(m.output), np.float32)
        self.number = np.full(len(m.context), -1, np.int64)
        self.number[often] = np.arange(len(often))
        self.often = [self.powers(often, i) for i in (0, 1)]
        self.table = self.often[0][0] @ self.often[1][0].T

    def powers(self, places: np.ndarray, position: int) -> tuple[np.ndarray, np.ndarray]:
        """Powers of the places' shares of all logits, and the greatest share of each, which is taken off before; biases belong to the first position."""
        x = self.m.context.take(places, axis=0)
        x *= self.m.position[position]
        x = x @ self.turned[:-1]
        if not position:
            x += self.turned[-1]
        top = x.max(axis=1, initial=-np.inf)
        x -= top[:, None]
        return np.exp(x, out=x), top

    def of(self, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
        a, b = self.number.take(h1), self.number.take(h2)
        total, top = np.zeros(len(h1), np.float32), np.zeros(len(h1), np.float32)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        total[at] = self.table.take(a[at] * len(self.table) + b[at]) if len(at) else 0
        top[at] = self.often[0][1].take(a[at]) + self.often[1][1].take(b[at]) if len(at) else 0
        for position, rare, other, known in ((0, h1, b, (a < 0) & (b >= 0)), (1, h2, a, (a >= 0) & (b < 0))):
            at = np.flatnonzero(known)
            at = at[np.argsort(rare[at], kind="stable")]
            powers, tops = self.often[1 - position]
            for begin in range(0, len(at), self.block):
                part = at[begin:begin + self.block]
                places = rare[part]
                new = np.r_[True, places[1:] != places[:-1]]
                own, own_top = self.powers(places[new], position)
                back = np.cumsum(new) - 1
                total[part] = np.vecdot(own.take(back, axis=0), powers.take(other[part], axis=0))
                top[part] = own_top.take(back) + tops.take(other[part])
        left = np.flatnonzero(~(total > 1e-25))
        total[left] = 1
        out = np.log(total, out=total)
        out += top
        room = np.empty((128, len(self.one)), np.float32)  # stays in the cache
        for begin in range(0, len(left), len(room)):
            part = left[begin:begin + len(room)]
            out[part] = self.whole(h1[part], h2[part], room)
        return out

    def whole(self, h1: np.ndarray, h2: np.ndarray, room: np.ndarray) -> np.ndarray:
        q = np.ones((len(h1), len(self.turned)), np.float32)  # the last column takes the bias
        q[:, :-1] = self.m.predicted(h1, h2)
        logits, top = np.matmul(q, self.turned, out=room[:len(q)]), 0
        with np.errstate(over="ignore"):
            total = np.exp(logits, out=logits) @ self.one
        if not ((total > 1e-25) & np.isfinite(total)).all():  # too large or too small for its powers: the greatest logit is taken off
            logits = q @ self.turned
            top = logits.max(axis=1)
            total = np.exp(logits - top[:, None]) @ self.one
        return top + np.log(total)


def log_probabilities(m: Weights, w: np.ndarray, h1: np.ndarray, h2: np.ndarray, block: int = 512, norms: Norms | None = None) -> np.ndarray:
    """Normalised natural log-probability of each output after its context; every different context is normalised once."""
    n = len(m.context)
    norms = norms or Norms(m, np.empty(0, np.int64), block)
    pairs, back = np.unique(h1 * n + h2, return_inverse=True)
    norm = norms.of(pairs // n, pairs % n)
    out = np.empty(len(w))
    for at in range(0, len(w), 8192):
        part = slice(at, at + 8192)
        logits = np.einsum("ij,ij->i", m.predicted(h1[part], h2[part]), m.output.take(w[part], axis=0)) + m.bias.take(w[part])
        out[part] = logits - norm.take(back[part])
    return out


def path_log_probabilities(m: Weights, corpus: Corpus, w: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """Natural log-probability of each place within its output: 0 for tokens of the shortlist, else along the way through the tree."""
    out = np.zeros(len(w))
    tail = np.flatnonzero(corpus.output_of[w] >= len(corpus.shortlist))
    for start in range(0, len(tail), 8192):
        at = tail[start:start + 8192]
        depth = (corpus.nodes.take(w[at], axis=0) >= 0).sum(axis=1)
        order = np.argsort(-depth, kind="stable")  # those that go further down come first
        at, open_ = at[order], np.searchsorted(-depth[order], -np.arange(corpus.nodes.shape[1]))
        nodes, left = corpus.nodes.take(w[at], axis=0), corpus.left.take(w[at], axis=0)
        q = m.predicted(h1[at], h2[at])
        found = np.zeros(len(at))
        for level, k in enumerate(open_.tolist()):
            node = nodes[:k, level]
            x = np.einsum("ij,ij->i", q[:k], m.node.take(node, axis=0)) + m.node_bias.take(node)
            x = np.where(left[:k, level], -x, x)
            found[:k] -= np.maximum(x, 0) + np.log(1 + np.exp(-np.abs(x)))
        out[at] = found
    return out


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 10 == 0, F.lit(False))


def token_counts(train: DataFrame) -> DataFrame:
    """``token`` and ``n`` over all training texts; counts are summed per task first."""
    def run(batches):
        held, size = [], 0

        def told():
            tokens, n = (np.concatenate(x) for x in zip(*held))
            tokens, at = np.unique(tokens, return_inverse=True)
            n = np.bincount(at, n).astype(np.int64)  # sums stay below 2^53
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n)], names=["token", "n"])

        for batch in slices(batches):
            tokens, code, _ = tokens_in(batch.column(0))
            times = np.bincount(code, minlength=len(tokens))
            held.append((tokens[times > 0], times[times > 0]))
            size += len(held[-1][0])
            if size > 1_000_000:
                yield told()
                held, size = [], 0
        if size:
            yield told()

    return train.select("text").mapInArrow(run, "token long, n long").groupBy("token").agg(F.sum("n").alias("n"))


def corpus_of(counts: DataFrame, shortlist: int, least_share: float) -> Corpus:
    """Frequent tokens have at least ``least_share`` of all, so there are at most 1 / least_share of them."""
    total, distinct = counts.agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    rows = counts.filter(F.col("n") >= max(1, least_share * total)).toPandas()
    tokens, times = rows["token"].to_numpy(np.int64).view(np.uint64), rows["n"].to_numpy(np.int64)
    order = np.argsort(tokens)
    tokens, times = tokens[order], times[order]
    best = np.sort(np.lexsort((tokens, -times))[:shortlist])
    per_class = {r[0]: r[1:] for r in counts.groupBy((F.col("token").bitwiseAND(CLASS_BITS)).alias("c")).agg(F.sum("n"), F.count(F.lit(1))).collect()}
    held = np.array([per_class.get(c, (0, 0)) for c in range(CLASSES)], float)
    np.add.at(held, (tokens[best] & np.uint64(CLASS_BITS)).astype(np.int64), np.stack([-times[best], -np.ones(len(best))], axis=1).reshape(-1, 2))
    mass, class_times = held[:, 0] + ADD * held[:, 1] + ADD, held[:, 0].copy()
    own = (tokens & np.uint64(CLASS_BITS)).astype(np.int64)
    tail = np.ones(len(tokens), bool)
    tail[best] = False
    np.add.at(held, own[tail], np.stack([-times[tail], -np.ones(tail.sum())], axis=1).reshape(-1, 2))
    rest = held[:, 0] + ADD * held[:, 1] + ADD
    output_of = np.r_[len(best) + own, len(best) + np.arange(CLASSES)]
    output_of[best] = np.arange(len(best))
    of_class = np.r_[np.where(tail, own, -1), np.arange(CLASSES)]
    return Corpus(total, distinct, tokens, times, tokens[best], times[best], mass, class_times, rest, output_of, *trees(of_class, np.r_[times + ADD, rest]))


def train(df: DataFrame, corpus: Corpus, size: int = 16, passes: int = 1) -> Weights:
    """Weights after ``passes`` rounds over all training texts, each task on its own documents, averaged row by row."""
    weights, spark = start_weights(corpus, size), df.sparkSession
    if not corpus.total:
        return weights
    for turn in range(passes):
        shared = spark.sparkContext.broadcast((vars(corpus), weights.rows()))

        def run(batches, shared=shared, turn=turn):
            fields, rows = shared.value  # plain arrays: a broadcast names classes, which workers need not have
            told = Corpus(**fields)
            learner, rng = Learner(Weights.of(rows, told), told, told.noise, rate=0.15 / (turn + 1)), None
            for batch in slices(batches):
                if batch.num_rows:
                    tokens, code, sizes = tokens_in(batch.column(0))
                    w, h1, h2 = contexts(told.ids(tokens)[code], sizes, told.places)
                    rng = rng or np.random.default_rng([turn, len(w), int(w[:64].sum())])
                    learner.learn(w, h1, h2, rng)
            if rng:
                n, moved = learner.moved(), learner.weights.rows() - rows
                for at in np.array_split(np.flatnonzero(n), max(1, np.count_nonzero(n) // 20_000)):
                    made = moved[at]
                    offsets = pa.array(np.arange(len(made) + 1, dtype=np.int32) * made.shape[1])
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(n[at]), pa.ListArray.from_arrays(offsets, pa.array(made.ravel()))],
                                                     names=["i", "n", "v"])

        made = df.select("text").mapInArrow(run, "i int, n long, v array<float>")
        mean = made.groupBy("i").agg(*[(F.sum(F.col("n") * F.col("v")[j]) / F.sum("n")).alias(f"v{j}") for j in range(size + 1)])
        told = mean.toPandas()  # one row per context, output and node
        rows = weights.rows()
        rows[told["i"].to_numpy()] += told.drop(columns="i").to_numpy()
        weights = Weights.of(rows, corpus)
    return weights


def score(df: DataFrame, counts: DataFrame, corpus: Corpus, weights: Weights) -> DataFrame:
    """Per row of ``df`` (``doc_id``, ``text``): ``n_tokens``, ``n_known``, ``base_score``, ``score``.

    Frequent tokens are counted where the text is read. The others, each a small share of all, meet their counts
    in a join and are summed per row.
    """
    shared, this = df.sparkSession.sparkContext.broadcast((vars(corpus), weights.rows())), uuid.uuid4().hex
    schema = "_row long, doc_id long, n_tokens long, known long, base double, model double, rare array<long>, times array<int>"

    def run(batches):
        fields, rows = shared.value
        told = Corpus(**fields)
        m = Weights.of(rows, told)
        held = kept("lm norms", dict, _endings.__module__)
        if this not in held:  # of another model, if any
            held.clear()
            held[this] = Norms(m, told.often(OFTEN))
        log_times, log_rest = np.log10(told.times + ADD), np.log10(told.rest)
        row = TaskContext.get().partitionId() << 40
        for batch in slices(batches):
            tokens, code, sizes = tokens_in(batch.column(1))
            docs = range(batch.num_rows)
            owner = np.repeat(np.arange(len(docs)), sizes)
            w, h1, h2 = contexts(told.ids(tokens)[code], sizes, told.places)
            tokens = tokens[code]
            model = (log_probabilities(m, told.output_of[w], h1, h2, norms=held[this]) + path_log_probabilities(m, told, w, h1, h2)) / np.log(10)
            frequent = w < len(told.frequent)
            own = np.zeros(len(w))
            own[frequent] = log_times[w[frequent]]
            model[~frequent] -= log_rest[w[~frequent] - len(told.frequent)]
            per = lambda x: np.bincount(owner, x, len(docs))
            rare_owner, rare = owner[~frequent], tokens[~frequent]
            order = np.lexsort((rare, rare_owner))
            rare_owner, rare = rare_owner[order], rare[order]
            first = np.flatnonzero(np.r_[True, (rare[1:] != rare[:-1]) | (rare_owner[1:] != rare_owner[:-1])]) if len(rare) else np.empty(0, np.int64)
            times = np.diff(np.r_[first, len(rare)]).astype(np.int32)
            offsets = pa.array(np.searchsorted(rare_owner[first], np.arange(len(docs) + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [pa.array(row + np.arange(len(docs))), batch.column(0), pa.array(sizes.astype(np.int64)), pa.array(per(frequent.astype(float)).astype(np.int64)),
                 pa.array(per(own)), pa.array(per(model)), pa.ListArray.from_arrays(offsets, pa.array(rare[first].view(np.int64))),
                 pa.ListArray.from_arrays(offsets, pa.array(times))], names=["_row", "doc_id", "n_tokens", "known", "base", "model", "rare", "times"])
            row += len(docs)

    rows = cut_lineage(df.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema))
    rare = rows.select("_row", F.explode(F.arrays_zip("rare", "times")).alias("r")).select("_row", F.col("r.rare").alias("token"), F.col("r.times").alias("times"))
    below = counts.filter(F.col("n") < max(1, LEAST_SHARE * corpus.total))
    met = rare.join(below, "token", "left")
    c = F.coalesce(F.col("n"), F.lit(0))
    sums = met.groupBy("_row").agg(F.sum(F.col("times") * F.log10(c + ADD)).alias("rare_sum"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("rare_known"))
    out = rows.select("_row", "doc_id", "n_tokens", "known", "base", "model").join(sums, "_row", "left").fillna(0, ["rare_sum", "rare_known"])
    whole = float(np.log10(corpus.total + ADD * (corpus.distinct + 1)))
    return out.select("doc_id", "n_tokens", (F.col("known") + F.col("rare_known")).alias("n_known"),
                      (F.col("base") + F.col("rare_sum") - F.col("n_tokens") * F.lit(whole)).alias("base_score"), (F.col("model") + F.col("rare_sum")).alias("score"))


LEAST_SHARE, SHORTLIST = 1 / 500_000, 768
OFTEN = 4096  # places of which a worker keeps the sums after any two: 64 MB


def language_scores(df: DataFrame, is_held_out: Column | None = None) -> DataFrame:
    """Trains on the rows of ``df`` (``doc_id``, ``text``) that are not held out and scores all rows.

    Adds nothing to ``df``: the result has ``doc_id``, ``held_out``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``. A null
    text counts as empty and has the end as its only token; rows with a null id are learnt from; repeated rows each count.
    Without training rows every token is unknown. An empty table gives an empty one.
    """
    out = held_out(F.col("doc_id")) if is_held_out is None else is_held_out
    learnt = df.filter(~out).select("text")
    counts = cut_lineage(token_counts(learnt))
    corpus = corpus_of(counts, SHORTLIST, LEAST_SHARE)
    scored = score(df, counts, corpus, train(learnt, corpus))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", F.lit(corpus.total).cast("long").alias("train_tokens"), "base_score", "score")

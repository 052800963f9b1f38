"""Toxicity by a support vector machine on a subsequence string kernel, made linear with Nyström landmarks.

The kernel of two words counts the letter triples both contain in order, each weighed down by the
letters it stretches over, so an insult keeps most of its likeness when letters are put in between. A sentence is
described by its words' kernel values with a few landmark strings, the largest per landmark; multiplied with the
inverse root of the landmarks' own kernel matrix these are the coordinates in which the machine is linear. A
document is judged by its worst sentence and by how many come near the border.

Landmarks, machine and calibration are fitted on a bounded sample of labelled documents; every document is scored whole.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.llm.worker import Recent, kept, slices, texts_of
from tideline.session import cut_lineage

TRIPLE, DECAY = 3, 0.7
LONGEST = 40  # letters of a word handled at once; longer ones are cut with an overlap of half of it
LEAST = 0.35  # smaller kernel values count as 0
SENTENCES = re.compile(r"[.!?\n]+(?=\s|$)")
EDGES = " .,;:!?\"'()[]{}<>|*_-#%&$/\\"


def _double_sum(x: np.ndarray) -> np.ndarray:
    """For each place (i, j): the sum over earlier i' and j' of x, decayed with the distance on both sides."""
    out = np.zeros_like(x)
    run = np.zeros_like(x[:, 0, :])
    for i in range(1, x.shape[1]):
        run = DECAY * (run + x[:, i - 1, :])
        out[:, i, :] = run
    run = np.zeros_like(x[:, :, 0])
    both = np.zeros_like(x)
    for j in range(1, x.shape[2]):
        run = DECAY * (run + out[:, :, j - 1])
        both[:, :, j] = run
    return both


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Subsequence kernel of pairs of words, given as rows of letter numbers filled up with -1 and -2."""
    match = (left[:, :, None] == right[:, None, :]).astype(np.float32)
    ways = match
    for _ in range(TRIPLE - 1):
        ways = match * _double_sum(ways)
    return DECAY ** 2 * ways.sum(axis=(1, 2), dtype=np.float64)


def letters(words: list[str], width: int, fill: int) -> np.ndarray:
    flat = np.frombuffer("".join(w.ljust(width, "\0") for w in words).encode("utf-32-le"), "<u4").astype(np.int32).reshape(len(words), width)
    return np.where(flat == 0, fill, flat)


def own_norms(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words))
    for at, width in _by_length(words):
        some = [words[i] for i in at]
        out[at] = kernel(letters(some, width, -1), letters(some, width, -2))
    return np.sqrt(out)


def _by_length(words: list[str], most: int = 2048):
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    low = 0
    for high in (6, 9, 13, 20, LONGEST):
        at = np.flatnonzero((sizes > low) & (sizes <= high))
        low = high
        for start in range(0, len(at), most):
            yield at[start:start + most], high


def masks(words: list[str]) -> np.ndarray:
    """The letters of a word as bits, by their number modulo 64."""
    return np.fromiter((_mask(w) for w in words), np.uint64, len(words))


def _mask(word: str) -> int:
    m = 0
    for c in word:
        m |= 1 << (ord(c) & 63)
    return m


def likeness(words: list[str], landmarks: list[str], norms: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Of the words like some landmark: the landmarks' numbers and the normalised kernel values of at least ``LEAST``.

    A word that lacks two or more letters of a landmark is not compared with it and counts as unlike.
    """
    out: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    if not words or not landmarks:
        return out
    own, marks = masks(words), masks(landmarks)
    need = np.bitwise_count(marks) - 1
    width = max(map(len, landmarks))
    right = letters(landmarks, width, -2)
    hit = np.bitwise_count(own[:, None] & marks[None, :]) >= need[None, :]
    some = np.flatnonzero(hit.any(axis=1))
    short = [words[i] for i in some]
    norm = own_norms(short)
    for at, size in _by_length(short, 1 << 30):
        left = letters([short[i] for i in at], size, -1)
        rows, cols = np.nonzero(hit[some[at]])
        value = np.zeros(len(rows))
        for start in range(0, len(rows), 2048):
            r, c = rows[start:start + 2048], cols[start:start + 2048]
            value[start:start + 2048] = kernel(left[r], right[c]) / np.maximum(norm[at][r] * norms[c], 1e-12)
        keep = value >= LEAST
        rows, cols, value = rows[keep], cols[keep], value[keep]
        for row, begin, end in zip(*_runs(rows), strict=True):
            out[short[at[row]]] = cols[begin:end], value[begin:end]
    return out


def _runs(rows: np.ndarray) -> tuple[list[int], list[int], list[int]]:
    if not len(rows):
        return [], [], []
    starts = np.flatnonzero(np.r_[True, rows[1:] != rows[:-1]])
    return rows[starts].tolist(), starts.tolist(), [*starts[1:].tolist(), len(rows)]


def words_of(text: str) -> list[str]:
    """Lower-cased words without marks at their ends; runs of single letters also as one word, words with
    marks inside also without them; long words cut."""
    found = [w for w in (w.strip(EDGES) for w in text.lower().split()) if w]
    singles = bytes([len(w) == 1 for w in found])
    if b"\1\1\1" in singles:
        for run in re.finditer(b"\1{3,}", singles):
            found.append("".join(found[run.start():run.end()]))
    found += ["".join(filter(str.isalnum, w)) for w in found if not w.isalnum()]
    if any(len(w) > LONGEST for w in found):
        found = [p for w in found for p in ([w] if len(w) <= LONGEST else [w[i:i + LONGEST] for i in range(0, len(w) - LONGEST // 2, LONGEST // 2)])]
    return [w for w in found if len(w) >= TRIPLE]


@dataclass(frozen=True)
class Model:
    """A fitted machine: landmarks, the Nyström root folded into the weights, bias, and the calibration."""

    landmarks: tuple[str, ...] = ()
    weights: np.ndarray = None
    bias: float = -1.0
    slopes: tuple[float, float] = (0.0, 0.0)
    offset: float = -30.0

    def probability(self, sentences: list[np.ndarray]) -> np.ndarray:
        """Of documents, from the landmark values of their sentences."""
        x = np.array([evidence(f @ self.weights + self.bias if len(f) else (), self.bias) for f in sentences]).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(x @ np.array(self.slopes) + self.offset, -30, 30)))


def evidence(decisions, bias: float) -> tuple[float, float]:
    """What the decisions on its sentences say of a document: the worst one, and how much all those near the border add up to."""
    if not len(decisions):
        return bias, 0.0
    return max(bias, float(decisions.max())), math.log1p(float(np.maximum(decisions + 1, 0).sum()))


def sentence_features(texts: list[str], landmarks: tuple[str, ...], name: str) -> list[np.ndarray]:
    """For each text a matrix with a row for each sentence that has a word like some landmark (none: no rows), and one for
    such words that only the whole text has, as the cut of sentences takes them apart."""
    cache = kept(f"toxic words:{name}", lambda: Recent(40 << 20, lambda v: 112 + 8 * len(v) if len(v) else 0))
    marks = list(landmarks)
    norms = kept(f"toxic norms:{name}", lambda: own_norms(marks))
    words = [words_of(t) for t in texts]
    known, unknown = cache.find([w for own in words for w in own])
    like = likeness(unknown, marks, norms)
    for w in unknown:
        cache.put(w, like.get(w, ()))
    like |= {w: v for w, v in known.items() if v}
    out = []
    for text, own in zip(texts, words, strict=True):
        rows = []
        if not like.keys().isdisjoint(own):
            left = {w for w in own if w in like}
            for sentence in SENTENCES.split(text):
                found = [w for w in words_of(sentence) if w in like]
                left.difference_update(found)
                if found:
                    rows.append(_row([like[w] for w in found], len(marks)))
            if left:
                rows.append(_row([like[w] for w in left], len(marks)))
        out.append(np.array(rows) if rows else np.zeros((0, len(marks))))
    return out


def _row(found: list[tuple[np.ndarray, np.ndarray]], width: int) -> np.ndarray:
    row = np.zeros(width)
    for cols, values in found:
        np.maximum.at(row, cols, values)
    return row


def pick_landmarks(toxic: dict[str, int], clean: dict[str, int], n_toxic: int, n_clean: int, most: int, others: int) -> list[str]:
    """Landmarks: strings tied to toxic documents, each unlike those before it, and the clean strings most like them.

    ``toxic`` and ``clean`` count the sampled documents of each class that hold a string.
    """
    def tie(s: str) -> float:
        odds = math.log((toxic[s] + 0.5) / (n_toxic + 1)) - math.log((clean.get(s, 0) + 0.5) / (n_clean + 1))
        return odds * math.sqrt(toxic[s])

    share, strings = n_toxic / (n_toxic + n_clean), len(toxic) + len(clean)

    def sure(s: str) -> bool:
        """Whether the tie is beyond what chance gives the best of so many strings."""
        t, c = toxic[s], clean.get(s, 0)
        gain = t * math.log(t / (t + c) / share) + (c * math.log(c / (t + c) / (1 - share)) if c else 0)
        return t / n_toxic > 4 * c / n_clean and gain > math.log(max(1000, strings)) + 4

    ranked = sorted(filter(sure, toxic), key=lambda s: (-tie(s), s))[:4000]
    chosen: list[str] = []
    norms = dict(zip(ranked, own_norms(ranked), strict=True)) if ranked else {}
    for s in ranked:
        if len(chosen) == most:
            break
        near = likeness([s], chosen, np.array([norms[c] for c in chosen])) if chosen else {}
        if s not in near or near[s][1].max() < 0.6:
            chosen.append(s)
    if not chosen:
        return []
    # Among the clean strings the likest are the ones a machine must tell from insults.
    common = sorted((s for s in clean if clean[s] >= 3 and s not in toxic or clean[s] > 5 * toxic.get(s, 0)), key=lambda s: (-clean[s], s))[:20_000]
    near = likeness(common, chosen, np.array([norms[c] for c in chosen]))
    return chosen + sorted(near, key=lambda s: (-near[s][1].max(), s))[:others]


def fit_machine(features: list[np.ndarray], labels: np.ndarray, shares: tuple[float, float], landmarks: list[str]) -> Model:
    """The machine and its calibration from the sentences of sampled documents.

    Only a document is labelled, so of a toxic one the sentence that speaks most for it is the positive example, picked
    anew after a first fit; all kept sentences of clean ones are negative. ``shares`` are the true shares of the classes.
    """
    if not landmarks or len(set(labels.tolist())) < 2:
        rate = shares[1]
        return Model(offset=math.log((rate + 1e-9) / (1 - rate + 1e-9)) if 0 < rate < 1 else (30.0 if rate else -30.0))
    m = len(landmarks)
    marks, norms = letters(landmarks, max(map(len, landmarks)), -2), own_norms(landmarks)
    gram = np.array([kernel(np.where(np.repeat(marks[i:i + 1], m, 0) == -2, -1, marks[i:i + 1]), marks) for i in range(m)]) / np.outer(norms, norms)
    values, vectors = np.linalg.eigh((gram + gram.T) / 2)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 0.05))) @ vectors.T
    scores = [f.max(axis=1) if len(f) else np.zeros(0) for f in features]
    weights, bias = np.zeros(m), -1.0
    for _ in range(3):
        x, y = [], []
        for f, s, label in zip(features, scores, labels, strict=True):
            if label and len(f):
                x.append(f[[int(s.argmax())]])
                y.append(np.ones(1))
            elif not label:
                x.append(np.vstack([f, np.zeros((1, m), f.dtype)]))
                y.append(-np.ones(len(f) + 1))
        x, y = np.vstack(x), np.concatenate(y)
        x = x @ root.astype(x.dtype)
        own, bias = squared_hinge(x, y, 1000.0)
        weights = root @ own
        scores = [f @ weights + bias for f in features]
    slopes, offset = calibrate(np.array([evidence(s, bias) for s in scores]), labels, shares)
    return Model(tuple(landmarks), weights, bias, slopes, offset)


def squared_hinge(x: np.ndarray, y: np.ndarray, c: float) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear machine with squared hinge loss, classes weighed alike, by Newton steps."""
    weight = np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum()))) * c / len(y) * 100
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    w, ridge = np.zeros(x1.shape[1]), np.diag(np.r_[np.ones(x.shape[1]), 1e-6])
    for _ in range(50):
        left, right = ridge.copy(), np.zeros(len(w))
        for at in range(0, len(x1), 16_384):  # rows may be many and of single precision
            part = x1[at:at + 16_384].astype(float)
            active = y[at:at + 16_384] * (part @ w) < 1
            a = part[active] * weight[at:at + 16_384][active, None]
            left += a.T @ part[active]
            right += a.T @ y[at:at + 16_384][active]
        new = np.linalg.solve(left, right)
        if np.abs(new - w).max() < 1e-9:
            break
        w = new
    return w[:-1], float(w[-1])


def calibrate(found: np.ndarray, labels: np.ndarray, shares: tuple[float, float]) -> tuple[tuple[float, float], float]:
    """Logistic slopes and offset, with sampled classes weighed back to their true shares and softened targets."""
    n1, n0 = max(1, int((labels == 1).sum())), max(1, int((labels == 0).sum()))
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(labels == 1, shares[1] / n1, shares[0] / n0) * len(labels)
    x = np.hstack([found, np.ones((len(found), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + 1e-4 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (weight * (target - p)) - 1e-4 * w)
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return (float(w[0]), float(w[1])), float(w[2])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def train(df: DataFrame, labels: DataFrame, per_class: int = 3000, landmarks: int = 64, others: int = 32) -> Model:
    """Fits on at most ``per_class`` labelled documents of each class, taken in the order of a hash of their id.

    ``labels`` has ``doc_id`` and ``toxic``; held-out ids are not learnt from, and of several texts
    under one id the least is taken, so reruns agree. The words of the sample are counted in Spark;
    the driver receives at most 20,000 counted strings and, of each sampled document, the landmark values of all
    sentences that have any (those that are not 0). Without labels of both classes the model gives the share of toxic labels (0 without labels).
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))) \
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("label"))
    count = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    total = sum(count.values())
    shares = (count.get(0, 0) / total, count.get(1, 0) / total) if total else (1.0, 0.0)
    if len(count) < 2:
        return fit_machine([], np.zeros(0), shares, [])
    parts = [known.filter(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for c in (0, 1)]
    picked = parts[0].unionByName(parts[1])  # 2 * per_class pairs of numbers at most
    sample = cut_lineage(df.select("doc_id", "text").join(F.broadcast(picked), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text")))

    def strings(batches):
        for batch in slices(batches):
            label, out = batch.column(0).to_pylist(), {0: {}, 1: {}}
            for c, text in zip(label, texts_of(batch.column(1)), strict=True):
                found = set(words_of(text))
                for s in found | {w[:k] for w in found for k in (4, 5, 6) if len(w) > k}:
                    out[c][s] = out[c].get(s, 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([s for c in out for s in out[c]], pa.string()), pa.array([c for c in out for _ in out[c]], pa.int32()),
                                              pa.array([n for c in out for n in out[c].values()], pa.int64())], names=["s", "label", "n"])

    counted = sample.select("label", "text").mapInArrow(strings, "s string, label int, n long").groupBy("s").agg(
        F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0)).alias("toxic"), F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0)).alias("clean"))
    counted = cut_lineage(counted.filter("toxic >= 3 or clean >= 3"))
    bad = {r.s: (r.toxic, r.clean) for r in counted.filter("toxic > 4 * clean").orderBy(F.desc("toxic"), "s").limit(10_000).collect()}
    good = {r.s: (r.toxic, r.clean) for r in counted.filter("toxic <= 4 * clean").orderBy(F.desc("clean"), "s").limit(10_000).collect()}
    both = bad | good
    of = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    marks = pick_landmarks({s: t for s, (t, _) in both.items() if t}, {s: c for s, (_, c) in both.items() if c}, of.get(1, 0) or 1, of.get(0, 0) or 1, landmarks, others)
    if not marks or len(of) < 2:
        return fit_machine([], np.zeros(0), shares, [])
    fixed, name = tuple(marks), "|".join(marks)

    def valued(batches):
        for batch in slices(batches):
            rows = [f.astype(np.float32) for f in sentence_features(texts_of(batch.column(1)), fixed, name)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(f) for f in rows], pa.int32()),
                                              pa.array([np.flatnonzero(f).astype("<i4").tobytes() for f in rows], pa.binary()),
                                              pa.array([f[f != 0].astype("<f4").tobytes() for f in rows], pa.binary())], names=["label", "n", "places", "f"])

    found = sample.select("label", "text").mapInArrow(valued, "label int, n int, places binary, f binary").collect()
    found.sort(key=lambda r: (r.label, r.n, bytes(r.places), bytes(r.f)))
    features = []
    for r in found:
        f = np.zeros((r.n, len(marks)), np.float32)
        f.ravel()[np.frombuffer(r.places, "<i4")] = np.frombuffer(r.f, "<f4")
        features.append(f)
    return fit_machine(features, np.array([r.label for r in found]), shares, marks)


def score(df: DataFrame, model: Model, text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Adds ``score`` (0 to 1) and ``predicted`` (1 from ``threshold`` on).

    Every row stays, repeated rows too; a null or empty text has no words and gets the score of a document without any likeness.
    Columns with the added names are replaced.
    """
    keep = [c for c in df.columns if c not in ("score", "predicted")]
    source = df.select(*keep, F.col(text).alias("_scored"))
    name = "|".join(model.landmarks)

    def run(batches):
        for batch in slices(batches, 256):
            found = sentence_features(texts_of(batch.column(batch.num_columns - 1)), model.landmarks, name) if model.landmarks else [()] * batch.num_rows
            p = model.probability(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*keep, "score", "predicted"])

    return source.mapInArrow(run, source.drop("_scored").schema.add("score", "double").add("predicted", "integer"))

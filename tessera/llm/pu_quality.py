"""Quality from trusted positives and unlabelled text: a linear model that minimises the non-negative unbiased risk.

With class prior p and logistic loss l, the risk of f is p E+[l(f)] + max(0, Eu[l(-f)] - p E+[l(-f)]): the bracket is what
unlabelled text says of the negatives, and it is kept from falling below zero, where it would only mean overfitting. No negative
label is used. The prior is estimated from the scores, out of fold, of a classifier of positives against unlabelled text: the
part of unlabelled text over a threshold, divided by the part of positives over it, where the bound of that ratio is least.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import draw, drawn

_MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_CLASSES = 38  # other bytes, lower case, upper case, digits, space, line end, and each mark
_CLASS = np.zeros(256, np.int32)
_CLASS[ord("a") : ord("z") + 1] = 1
_CLASS[ord("A") : ord("Z") + 1] = 2
_CLASS[ord("0") : ord("9") + 1] = 3
_CLASS[[9, 11, 12, 13, 32]] = 4
_CLASS[10] = 5
_CLASS[[ord(c) for c in _MARKS]] = np.arange(6, 38)
PAIRS = _CLASSES * _CLASSES
STATS = ("log_words", "word_chars", "distinct_words", "distinct_pairs", "commonest_word", "distinct_lines", "line_words", "sentence_ends", "long_words", "one_char_words", "same_as_before")
WIDTH = PAIRS + len(STATS)
_PART = 1 << 22


def features(text: str | None) -> np.ndarray:
    """Root frequencies of pairs of neighbouring byte classes, which know marks, case and digits but no language; and shares of
    words and lines. Null is the empty text. Memory is bounded by parts of four million bytes and the words of the text."""
    data = (text or "").encode("utf-8", "surrogatepass")
    counts = np.zeros(PAIRS)
    for k in range(0, len(data), _PART):
        c = _CLASS[np.frombuffer(data[k : k + _PART + 1], np.uint8)]
        counts += np.bincount(c[:-1] * _CLASSES + c[1:], minlength=PAIRS)
    out = np.zeros(WIDTH, np.float32)
    out[:PAIRS] = np.sqrt(counts / max(counts.sum(), 1.0))
    words = data.lower().split()
    if n := len(words):
        h = np.fromiter(map(hash, words), np.int64, n)
        names, times = np.unique(h, return_counts=True)
        pairs = len(np.unique(h[:-1] * 31 + h[1:]))
        lines = [x for x in data.split(b"\n") if x.strip()]
        sizes = np.fromiter(map(len, words), np.int64, n)
        ends = sum(data.count(e) for e in (b".", b"!", b"?"))
        out[PAIRS:] = (np.log1p(n), np.log1p(sizes.mean()), len(names) / n, pairs / max(n - 1, 1), times.max() / n, len(set(lines)) / len(lines), np.log1p(n / len(lines)), min(ends / n, 2.0), (sizes > 20).mean(), (sizes == 1).mean(), (h[1:] == h[:-1]).sum() / n)
    return out


@dataclass(frozen=True)
class Model:
    centre: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # the last one is the bias
    prior: float

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _logistic(_standard(x, self.centre, self.scale) @ self.weights[:-1] + self.weights[-1])


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _standard(x: np.ndarray, centre: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.clip((x - centre) / scale, -10, 10).astype(np.float32)


def nn_pu(positive: np.ndarray, unlabelled: np.ndarray, prior: float, steps: int = 3000, batch: int = 512, rate: float = 3e-3, ridge: float = 1e-3, seed: int = 23) -> np.ndarray:
    """Weights (the bias last) by Adam on batches of the non-negative risk. Where a batch's risk of negatives is below zero, the
    step goes up that part's gradient instead, which takes back what was fitted too far."""
    rng = np.random.default_rng(seed)
    w = np.zeros(positive.shape[1] + 1)
    w[-1] = np.log(prior / (1 - prior))
    first, second, total = np.zeros_like(w), np.zeros_like(w), np.zeros_like(w)
    ones = lambda x: np.hstack([x, np.ones((len(x), 1), x.dtype)])
    positive, unlabelled = ones(positive), ones(unlabelled)
    for step in range(1, steps + 1):
        p = positive[rng.integers(0, len(positive), min(batch, len(positive)))]
        u = unlabelled[rng.integers(0, len(unlabelled), min(batch, len(unlabelled)))]
        now = w.astype(np.float32)  # float32 as the features are, so that no product copies them
        zp, zu = p @ now, u @ now
        up, down = _logistic(zp), _logistic(zu)
        as_negative = p.T @ up / len(p)  # gradient of E+[l(-f)]
        negatives = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        fall = u.T @ down / len(u) - prior * as_negative
        if negatives >= 0:
            grad = prior * (p.T @ (up - 1)) / len(p) + fall
        else:
            grad = -fall
        grad[:-1] += ridge * w[:-1]
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad * grad
        w = w - rate * (1 - step / (steps + 1)) * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
        if step > steps // 2:
            total += w
    return total / (steps - steps // 2)


def _against(x: np.ndarray, y: np.ndarray, steps: int = 60, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression of y by accelerated gradient steps; each class weighs half."""
    x1 = np.hstack([x, np.ones((len(x), 1), x.dtype)])
    weigh = np.where(y > 0, 0.5 / max((y > 0).sum(), 1), 0.5 / max((y < 1).sum(), 1)).astype(np.float32)
    y = y.astype(np.float32)
    probe = np.ones(x1.shape[1], np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = x1.T @ (weigh * (x1 @ probe))
        top = np.linalg.norm(probe)
        probe /= max(top, 1e-12)
    w = ahead = np.zeros(x1.shape[1], np.float32)
    t = 1.0
    for _ in range(steps):
        grad = x1.T @ (weigh * (_logistic(x1 @ ahead) - y)) + np.float32(ridge) * np.r_[ahead[:-1], np.float32(0)]
        new = ahead - grad / np.float32(top / 4 + ridge)
        t, before = (1 + (1 + 4 * t * t) ** 0.5) / 2, t
        w, ahead = new, new + np.float32((before - 1) / t) * (new - w)
    return w


def class_prior(positive: np.ndarray, unlabelled: np.ndarray, folds: int = 3, risk: float = 0.1) -> float:
    """The share of positives in unlabelled text, between 0.01 and 0.99. Over a threshold that hardly a negative passes, the two
    parts' ratio is that share; the threshold is the one at which ratio plus its sampling error is least."""
    x = np.vstack([positive, unlabelled])
    y = np.r_[np.ones(len(positive)), np.zeros(len(unlabelled))]
    fold = np.r_[np.arange(len(positive)) % folds, np.arange(len(unlabelled)) % folds]
    z = np.zeros(len(x))
    for f in range(folds):
        if (fold != f).any() and (fold == f).any():
            w = _against(x[fold != f], y[fold != f])
            z[fold == f] = x[fold == f] @ w[:-1] + w[-1]
    p, u = np.sort(z[y > 0]), np.sort(z[y < 1])
    at = np.unique(p)
    over_p = 1 - np.searchsorted(p, at, "left") / len(p)
    over_u = 1 - np.searchsorted(u, at, "left") / len(u)
    slack = np.sqrt(np.log(4 / risk) / 2) * (len(p) ** -0.5 + len(u) ** -0.5)
    best = np.argmin((over_u + 1.01 * slack) / over_p)
    return float(np.clip(over_u[best] / over_p[best], 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    centre, scale = unlabelled.mean(axis=0), unlabelled.std(axis=0)
    scale = np.where(scale > 1e-6, scale, np.inf)  # a constant feature says nothing
    positive, unlabelled = _standard(positive, centre, scale), _standard(unlabelled, centre, scale)
    prior = class_prior(positive, unlabelled)
    return Model(centre, scale, nn_pu(positive, unlabelled, prior), prior)


def _vectors(rows: DataFrame, most: int, seed: int) -> np.ndarray:
    """Features of at most `most` distinct rows (id, text), as a matrix in a fixed order; no text reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column(1)]
            at = [np.flatnonzero(v).astype(np.int16) for v in x]
            yield pa.RecordBatch.from_arrays([
                pa.array([xxhash.xxh3_64_intdigest(f"{seed}:{i}".encode()) >> 1 for i in batch.column(0).to_pylist()], pa.int64()),
                pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].tobytes() for v, i in zip(x, at, strict=True)], pa.binary()),
            ], names=["turn", "at", "value"])

    got = rows.select(F.col("id").cast("string").alias("id"), "text").dropDuplicates().mapInArrow(run, "turn long, at binary, value binary").orderBy("turn", "at", "value").limit(most).toPandas()
    x = np.zeros((len(got), WIDTH), np.float32)
    for k, (i, v) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[k, np.frombuffer(i, np.int16)] = np.frombuffer(v, np.float32)
    return x


def training_rows(docs: DataFrame, labels: DataFrame, learnable: Column, most_positive: int, most_unlabelled: int, id_col: str, text_col: str, label_col: str, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of trusted positives (ids that are labelled 1 and never 0) and of unlabelled text (learnable documents, drawn by hash whatever their labels)."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).where(learnable)
    trusted = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)").where(learnable)
    trusted = trusted.groupBy("id").agg(F.min("y").alias("y")).where("y = 1").select("id")
    chosen = drawn(trusted, most_positive, seed, "id")
    own = rows.join(F.broadcast(chosen), "id")
    share = min(1.0, 1.5 * most_unlabelled / max(rows.select("id").count(), 1))
    other = rows.where(draw(seed + 1, "id", "text") < share)
    return _vectors(own, most_positive, seed), _vectors(other, most_unlabelled, seed)


def score(docs: DataFrame, labels: DataFrame, learnable: Column | None = None, most_positive: int = 4_000, most_unlabelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 29) -> DataFrame:
    """One row a document: id, score (0 to 1, the odds that its label is 1), predicted (1 from a score of 0.5). It learns from at most
    `most_positive` documents labelled 1 and `most_unlabelled` others, both where `learnable` (over id) holds; scores are
    of whole texts.

    Null texts are empty ones; empty texts get the score of a text without features. Ids labelled both 1 and 0 are not
    trusted; null labels and ids teach nothing. Without trusted positives all scores are 0. Repeated rows give a row each; an
    empty table gives an empty one; other columns are not read. A map, no shuffle.
    """
    positive, unlabelled = training_rows(docs, labels, F.lit(True) if learnable is None else learnable, most_positive, most_unlabelled, id_col, text_col, label_col, seed)
    model = fit(positive, unlabelled) if len(positive) and len(unlabelled) else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for k in range(0, whole.num_rows, 1024):
                batch = whole.slice(k, 1024)
                p = model.scores(np.stack([features(t.as_py()) for t in batch.column(1)])) if model else np.zeros(batch.num_rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p.astype(float)), pa.array((p >= 0.5).astype(np.int32))], names=["id", "score", "predicted"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, score double, predicted int").withColumnRenamed("id", id_col)

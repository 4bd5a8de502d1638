"""Toxicity by a classifier chain: categories are predicted one after the other, each linear model also seeing the
probabilities of the earlier ones. In training those are out-of-fold, so a later model learns how far to trust them."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import drawn
from tessera.llm.words import WordHashes, shingles, words_of

#: Words that mark a category in a document labelled toxic (weak labels for the first links of the chain).
SEEDS = {
    "insult": "idiot moron loser clown stupid fool dumb imbecile jerk coward liar ugly lazy",
    "degrading": "worthless pathetic scum trash disgusting garbage filth vermin useless subhuman disgrace",
}
_WORD = re.compile(r"[^\W\d_]+")


def words_in(text: str | None) -> set[str]:
    return set(_WORD.findall(text.lower())) if text else set()


def _hash(word: str) -> int:
    return xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) >> 1


class Vocabulary(dict):
    """word -> its column, or -1; remembers up to `most` words."""

    def __init__(self, hashes: np.ndarray, most: int = 400_000):
        super().__init__()
        self.columns, self.most = {int(h): k for k, h in enumerate(hashes)}, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        k = self[word] = self.columns.get(_hash(word), -1)
        return k

    def matrix(self, texts: list[str | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.columns)))
        for row, text in enumerate(texts):
            at = [k for k in map(self.__getitem__, words_in(text)) if k >= 0]
            out[row, at] = 1
        return out


def fit_linear(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 25) -> np.ndarray:
    """Logistic regression by damped Newton steps; the last weight is the bias. Rows of one kind give a constant."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x1.shape[1])
    share = (y.sum() + 0.5) / (len(y) + 1)
    w[-1] = np.log(share / (1 - share))
    if y.min() == y.max():
        return w
    penalty = np.r_[np.full(x.shape[1], ridge), 1e-6]
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x1 @ w, -30, 30)))
        grad = x1.T @ (p - y) + penalty * w
        step = np.linalg.solve((x1 * (p * (1 - p) + 1e-9)[:, None]).T @ x1 + np.diag(penalty), grad)
        w -= step * min(1.0, 4 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w


def apply_linear(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))


@dataclass(frozen=True)
class Chain:
    names: tuple[str, ...]
    hashes: np.ndarray
    weights: tuple[np.ndarray, ...]
    threshold: float

    def predict(self, x: np.ndarray) -> np.ndarray:
        for w in self.weights:
            x = np.hstack([x, apply_linear(x, w)[:, None]])
        return x[:, x.shape[1] - len(self.weights) :]


def choose_words(sets: list[np.ndarray], y: np.ndarray, most: int = 256, least_docs: int = 8) -> np.ndarray:
    """Hashes of the words most tied to y = 1 by chi-square, each in `least_docs` documents at least."""
    flat = np.concatenate(sets) if sets else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    words, inverse = np.unique(flat, return_inverse=True)
    n1 = np.bincount(inverse, weights=y[row], minlength=len(words))
    n = np.bincount(inverse, minlength=len(words))
    expected = n * y.mean()
    with np.errstate(divide="ignore", invalid="ignore"):
        chi = np.where((n >= least_docs) & (n1 > expected), (n1 - expected) ** 2 / np.maximum(expected, 1e-9), 0.0)
    order = np.lexsort((words, -chi))
    order = order[chi[order] > 15][:most]
    return np.sort(words[order])


def fit_chain(sets: list[np.ndarray], toxic: np.ndarray, fold: np.ndarray, folds: int = 5) -> Chain:
    """sets: hashes of each document's words. The last link is `toxic` itself."""
    names = (*SEEDS, "toxic")
    hashes = choose_words(sets, toxic)
    x = np.zeros((len(sets), len(hashes)))
    for k, s in enumerate(sets):
        at = np.searchsorted(hashes, s)
        at = at[(at < len(hashes))]
        x[k, at[np.isin(hashes[at], s)]] = 1
    weights = []
    for name in names:
        if name == "toxic":
            y = toxic.astype(float)
        else:
            seeds = np.array([_hash(w) for w in SEEDS[name].split()])
            y = np.array([float(t and np.isin(seeds, s).any()) for t, s in zip(toxic, sets, strict=True)])
        held = np.zeros(len(y))
        for f in range(folds):
            held[fold == f] = apply_linear(x[fold == f], fit_linear(x[fold != f], y[fold != f])) if (fold != f).any() else y.mean()
        weights.append(fit_linear(x, y))
        x = np.hstack([x, held[:, None]])
    # the threshold with the best F0.5 of the out-of-fold probabilities: precision counts more
    best = (-1.0, 0.5)
    for t in np.unique(np.round(held, 3)):
        if not 0.1 <= t <= 0.9:
            continue
        hit = held >= t
        tp = (hit & (toxic > 0)).sum()
        if tp:
            p, r = tp / hit.sum(), tp / (toxic > 0).sum()
            best = max(best, (1.25 * p * r / (0.25 * p + r), float(t)))
    return Chain(names, hashes, tuple(weights), best[1])


def training_rows(docs: DataFrame, labels: DataFrame, max_labelled: int, id_col: str, text_col: str, label_col: str, seed: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Word sets, labels and folds of at most `max_labelled` labelled documents, one of each group of near copies (a group
    shares its smallest hashed five-word shingle), for copies would count a rare word many times."""
    chosen = labels.select(labels[id_col].alias("id"), labels[label_col].cast("int").alias("y")).where("id is not null and y in (0, 1)")
    chosen = drawn(chosen, max_labelled, seed, "id", "y")
    own = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).join(F.broadcast(chosen), "id").dropDuplicates(["id", "text", "y"])

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            h = [np.sort(np.array([_hash(w) for w in words_in(t)], np.int64)).tobytes() for t in texts]
            s = [shingles(cache.of(words_of(t))) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(h, pa.binary()), pa.array([int(v.min() >> np.uint64(1)) if len(v) else 0 for v in s], pa.int64())], names=["id", "y", "words", "sketch"])

    got = own.select(F.col("id").cast("long").alias("id"), "text", "y").mapInArrow(sets, "id long, y int, words binary, sketch long").orderBy("id", "y", "sketch").limit(max_labelled).toPandas().sort_values(["id", "y"], kind="stable").drop_duplicates("sketch")
    fold = np.array([xxhash.xxh32_intdigest(str(i)) % 5 for i in got["id"]], int)
    return [np.frombuffer(w, np.int64) for w in got["words"]], got["y"].to_numpy(int), fold


def score(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", seed: int = 17) -> DataFrame:
    """One row a document: id, p_insult, p_degrading, p_toxic (double), toxic (boolean: p_toxic at or over the threshold that
    was best out of fold). The chain learns from at most `max_labelled` labelled documents; whole texts are scored.

    Null and empty texts, and all where nothing is labelled: probabilities as the data's shares (0 without labels), toxic
    false. Repeated rows give a row each; an empty table gives an empty one; other columns are not read. A map, no shuffle.
    """
    sets, y, fold = training_rows(docs, labels, max_labelled, id_col, text_col, label_col, seed)
    chain = fit_chain(sets, y, fold) if len(y) else None
    names = [f"p_{n}" for n in (*SEEDS, "toxic")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(chain.hashes) if chain else None
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                texts = batch.column(1).to_pylist()
                p = chain.predict(vocabulary.matrix(texts)) if chain else np.zeros((len(texts), len(names)))
                some = np.array([bool(t) for t in texts], bool)
                hit = (p[:, -1] >= chain.threshold) & some if chain else np.zeros(len(texts), bool)
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(names))], pa.array(hit)], names=["id", *names, "toxic"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean").withColumnRenamed("id", id_col)

"""Language by hierarchical discrimination: the family first, then one-versus-one linear SVMs among its languages.

All SVMs look at the relative frequencies of hashed byte n-grams (1 to 3) of the lower-cased text, so a text's score in every
SVM is a sum over its n-grams of table look-ups: one pass over the bytes in numpy, whatever the length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import draw

#: Families of ISO 639-1 languages. A language that is not listed is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fo af fy lb yi", "romance": "fr es it pt ro ca gl oc", "slavic": "ru uk be pl cs sk bg sr hr bs sl mk",
    "baltic": "lt lv", "uralic": "fi et hu", "celtic": "ga gd cy br", "turkic": "tr az kk uz ky tk tt", "indic": "hi bn ur mr gu pa ne si as or",
    "iranian": "fa ku ps tg", "semitic": "ar he mt am", "dravidian": "ta te kn ml", "malayic": "id ms jv su", "sinitic": "zh yue",
}
_FAMILY = {lang: family for family, langs in FAMILIES.items() for lang in langs.split()}
BUCKETS = 1 << 13
_NOT_TEXT = re.compile(r"[^\w\s'-]+|\d+")


def has_letter(text: str) -> bool:
    """Whether some character is alphabetic; digits, fractions, raised and Roman numerals are not."""
    return any(map(str.isalpha, text))


def family_of(lang: str) -> str:
    return _FAMILY.get(lang.lower().split("-")[0].split("_")[0], lang)


def grams(data: bytes) -> np.ndarray:
    """Buckets of the 1-, 2- and 3-grams that begin at each byte; data ends in two spaces, which begin none."""
    b = np.frombuffer(data, np.uint8).astype(np.uint32)
    one = b[:-2] * np.uint32(0x9E3779B1)
    two = (one ^ (b[1:-1] * np.uint32(0x85EBCA77))) * np.uint32(0xC2B2AE3D)
    three = (two ^ (b[2:] * np.uint32(0x27D4EB2F))) * np.uint32(0x165667B1)
    shift = np.uint32(32 - 13)
    return np.concatenate([one >> shift, two >> shift, three >> shift])


def cleaned(text: str) -> bytes:
    """Lower-cased, with digits and marks as spaces; spaces around it, two at its end for grams()."""
    return b" " + _NOT_TEXT.sub(" ", text.lower()).encode("utf-8", "surrogatepass") + b"  "


def frequencies(text: str) -> np.ndarray:
    g = grams(cleaned(text))
    return np.bincount(g, minlength=BUCKETS).astype(np.float32) * np.float32(3 / max(len(g), 1))


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    pairs: tuple[tuple[str, tuple[int, ...], tuple[int, ...]], ...]  # scope ("" among families), languages for and against
    weights: np.ndarray  # (BUCKETS, pairs)
    bias: np.ndarray

    def decide(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Language numbers and scores in 0..1 for rows of margins: votes weighed by the logistic of each margin."""
        families = sorted({family_of(x) for x in self.langs})
        of = np.array([families.index(family_of(x)) for x in self.langs])
        p = 1 / (1 + np.exp(-4 * np.clip(margins, -8, 8)))
        fam = np.full((len(p), len(families)), 1.0 if len(families) == 1 else 0.0)
        lang = np.zeros((len(p), len(self.langs)))
        rivals = np.array([max((of == f).sum() - 1, 0) for f in of])
        for k, (scope, a, b) in enumerate(self.pairs):
            if scope == "":
                fam[:, of[a[0]]] += p[:, k] / (len(families) - 1)
                fam[:, of[b[0]]] += (1 - p[:, k]) / (len(families) - 1)
            else:
                lang[:, a[0]] += p[:, k] / rivals[a[0]]
                lang[:, b[0]] += (1 - p[:, k]) / rivals[b[0]]
        lang[:, rivals == 0] = 1
        chosen = fam.argmax(axis=1)
        lang[of[None, :] != chosen[:, None]] = -1
        best = lang.argmax(axis=1)
        at = np.arange(len(p))
        return best, np.clip(fam[at, chosen] * lang[at, best], 0, 1)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, epochs: int = 30, seed: int = 5) -> tuple[np.ndarray, float]:
    """L1-loss linear SVM by dual coordinate descent; y in -1, 1. A last constant column serves as bias. Classes weigh alike."""
    rows = [np.flatnonzero(r) for r in x]
    vals = [r[i] for r, i in zip(x, rows, strict=True)]
    w, b, alpha = np.zeros(x.shape[1]), 0.0, np.zeros(len(x))
    q = np.array([float(v @ v) + 1.0 for v in vals])
    upper = np.where(y > 0, c * len(y) / (2 * max((y > 0).sum(), 1)), c * len(y) / (2 * max((y < 0).sum(), 1)))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for k in rng.permutation(len(x)):
            g = y[k] * (w[rows[k]] @ vals[k] + b) - 1
            new = min(max(alpha[k] - g / q[k], 0.0), upper[k])
            if d := new - alpha[k]:
                w[rows[k]] += d * y[k] * vals[k]
                b += d * y[k]
                alpha[k] = new
                moved = max(moved, abs(d))
        if moved < 1e-3:
            break
    return w, b


def fit(x: np.ndarray, langs: list[str]) -> Model:
    names = tuple(sorted(set(langs)))
    y = np.array([names.index(v) for v in langs])
    members: dict[str, list[int]] = {}
    for k, v in enumerate(names):
        members.setdefault(family_of(v), []).append(k)
    pairs = [("", tuple(members[a]), tuple(members[b])) for a, b in combinations(sorted(members), 2)]
    pairs += [(f, (a,), (b,)) for f in sorted(members) for a, b in combinations(members[f], 2)]
    weights, bias = np.zeros((BUCKETS, len(pairs)), np.float32), np.zeros(len(pairs), np.float32)
    x = np.sqrt(x)
    for k, (_, a, b) in enumerate(pairs):
        own = np.isin(y, a + b)
        w, bias[k] = fit_svm(x[own], np.where(np.isin(y[own], a), 1.0, -1.0))
        weights[:, k] = w
    return Model(names, tuple(pairs), weights, bias)


def training_rows(docs: DataFrame, learnable, per_lang: int, most_langs: int, id_col: str, text_col: str, lang_col: str, seed: int) -> tuple[np.ndarray, list[str]]:
    """Frequencies and languages of about `per_lang` texts of each language, chosen by hashed id; vectors of BUCKETS numbers, never texts, reach the driver."""
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang")).where(learnable).where("lang is not null and text is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(most_langs + 1).collect()}
    if len(counts) > most_langs:
        raise ValueError(f"the table has more than most_langs={most_langs} languages; none is left out, so the model grows with their number")
    share = F.create_map(*[x for lang, n in sorted(counts.items()) for x in (F.lit(lang), F.lit(min(1.0, per_lang / n)))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    chosen = rows.where(draw(seed, "id") < F.coalesce(share[F.col("lang")], F.lit(0.0)))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [k for k, t in enumerate(batch.column(1).to_pylist()) if has_letter(t)]
            sparse = [frequencies(batch.column(1)[k].as_py()) for k in keep]
            at = [np.flatnonzero(v).astype(np.int16) for v in sparse]
            yield pa.RecordBatch.from_arrays([
                pa.array([batch.column(0)[k].as_py() for k in keep], pa.int64()), pa.array([batch.column(2)[k].as_py() for k in keep], pa.string()),
                pa.array([i.tobytes() for i in at], pa.binary()), pa.array([v[i].astype(np.float32).tobytes() for v, i in zip(sparse, at, strict=True)], pa.binary()),
            ], names=["id", "lang", "at", "value"])

    got = chosen.select(F.col("id").cast("long").alias("id"), "text", "lang").mapInArrow(vectors, "id long, lang string, at binary, value binary").toPandas().sort_values(["id", "lang"], kind="stable")
    x = np.zeros((len(got), BUCKETS), np.float32)
    for k, (i, v) in enumerate(zip(got["at"], got["value"], strict=True)):
        x[k, np.frombuffer(i, np.int16)] = np.frombuffer(v, np.float32)
    return x, list(got["lang"])


def identify(docs: DataFrame, learnable=None, per_lang: int = 400, most_langs: int = 200, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", seed: int = 13) -> DataFrame:
    """One row a document: id, lang_pred, score. Learns from `lang` of rows where `learnable` (over id, text, lang) holds,
    about `per_lang` of each language (the bound of the sample, with `most_langs`: more languages than that are an error, none is
    left out).

    Null text or one without a letter: `und`, score 1. Without learnable rows: `und`, score 0, everywhere. Empty tables
    give empty ones; repeated rows give a row each; other columns are not read. A prediction sees the text alone.
    """
    learnable = F.lit(True) if learnable is None else learnable
    x, langs = training_rows(docs, learnable, per_lang, most_langs, id_col, text_col, lang_col, seed)
    model = fit(x, langs) if langs else None
    if model is not None:
        tables = np.ascontiguousarray(model.weights.T)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                text = text.as_py()
                if not text or not has_letter(text):
                    langs.append("und")
                    scores.append(1.0)
                elif model is None:
                    langs.append("und")
                    scores.append(0.0)
                else:
                    v = np.sqrt(frequencies(text))
                    best, score = model.decide((tables @ v + model.bias)[None])
                    langs.append(model.langs[int(best[0])])
                    scores.append(float(score[0]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, lang_pred string, score double").withColumnRenamed("id", id_col)

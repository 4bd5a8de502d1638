"""Quality rules: statistics of a text as Spark columns, and a decision list learned from labelled statistics.

Everything a document passes through is a DataFrame expression. Only the learning of the rules runs in the driver, on the
statistics (numbers, never texts) of at most `max_labelled` labelled documents.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.store import drawn, free_prefix

SPACE = r"[\x20\x09-\x0D]+"
SYMBOLS = "[#*$%&|<>]"
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _per(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) / F.nullif(F.col(b), F.lit(0)), F.lit(0.0))


def measures() -> dict[str, Column]:
    return {
        "words": F.col("n_words").cast("double"), "mean_word_chars": _per("word_chars", "n_words"), "symbols_per_word": _per("n_symbols", "n_words"),
        "dup_line_share": _per("n_dup_lines", "n_lines"), "repeat_word_share": _per("n_repeat_words", "n_words"), "distinct_word_share": _per("n_distinct_words", "n_words"),
        "adjacent_repeat_share": _per("n_adjacent_repeats", "n_words"), "shouts_per_word": _per("n_shouts", "n_words"),
    }


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs with the columns n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct_words,
    n_adjacent_repeats and n_shouts (long). Null text: all 0. Columns of docs with these names are replaced.

    n_repeat_words: each window of five words is hashed; where a text has no two equal windows (most) that ends it. Else the
    windows are sorted by (hash, place), neighbours compared by hash, and the words that the repeated windows cover are counted
    from their sorted places: n log n in the words of a text, at any length, without a shuffle.
    """
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    tmp = free_prefix(docs) + "q_"
    c = lambda name: F.col(tmp + name)

    def repeated(x: Column, k: Column) -> Column:
        return F.coalesce(F.get(c("placed"), k - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(c("placed"), k + 1)["h"] == x["h"], F.lit(False))

    out = docs.withColumn(tmp + "text", text)
    out = out.withColumn(tmp + "words", F.filter(F.split(c("text"), SPACE), lambda w: w != "")).withColumn(tmp + "lines", F.filter(F.split(c("text"), "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")))
    out = out.withColumn(tmp + "hashes", F.transform(c("words"), lambda w: F.xxhash64(w)))
    window = lambda i: F.xxhash64(*[F.get(c("hashes"), i + j) for j in range(5)])
    out = out.withColumn(tmp + "windows", F.when(F.size(c("hashes")) >= 5, F.transform(F.sequence(F.lit(0), F.size(c("hashes")) - 5), window)).otherwise(F.array().cast("array<bigint>")))
    out = out.withColumn(tmp + "placed", F.when(F.size(F.array_distinct(c("windows"))) < F.size(c("windows")), F.sort_array(F.transform(c("windows"), lambda x, i: F.struct(x.alias("h"), i.alias("i"))))))
    out = out.withColumn(tmp + "starts", F.sort_array(F.transform(F.filter(c("placed"), repeated), lambda x: x["i"].cast("long"))))
    covered = F.aggregate(F.transform(c("starts"), lambda x, k: F.least(F.lit(5).cast("long"), F.coalesce(F.get(c("starts"), k + 1) - x, F.lit(5).cast("long")))), F.lit(0).cast("long"), lambda a, x: a + x)
    out = out.withColumns({
        "n_words": F.size(c("words")).cast("long"),
        "word_chars": F.length(F.array_join(c("words"), "")).cast("long"),
        "n_symbols": F.regexp_count(c("text"), F.lit(SYMBOLS)).cast("long"),
        "n_dup_lines": (F.size(c("lines")) - F.size(F.array_distinct(c("lines")))).cast("long"),
        "n_repeat_words": F.coalesce(covered, F.lit(0).cast("long")),
        "n_lines": F.size(c("lines")).cast("long"),
        "n_distinct_words": F.size(F.array_distinct(c("hashes"))).cast("long"),
        "n_adjacent_repeats": F.size(F.filter(c("hashes"), lambda x, i: F.coalesce(F.get(c("hashes"), i - 1) == x, F.lit(False)))).cast("long"),
        "n_shouts": F.regexp_count(c("text"), F.lit("!")).cast("long"),
        # not deterministic, and so a fence: a filter on the verdict must not be pushed below, where it would repeat all of the above inside itself
        tmp + "fence": F.monotonically_increasing_id() >= 0,
    })
    out = out.withColumn("n_words", F.when(c("fence"), F.col("n_words")))
    return out.drop(*[tmp + x for x in ("text", "words", "lines", "hashes", "windows", "placed", "starts", "fence")])


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


# ------------------------------------------------------------------ learning


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self, of: dict[str, Column]) -> Column:
        return of[self.measure] >= F.lit(self.threshold) if self.above else of[self.measure] <= F.lit(self.threshold)

    def holds(self, x: np.ndarray) -> np.ndarray:
        return x >= self.threshold if self.above else x <= self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<='} {self.threshold:.6g}"


Rule = tuple[Condition, ...]


def _covers(rule: Rule, x: np.ndarray, names: list[str]) -> np.ndarray:
    hit = np.ones(len(x), bool)
    for c in rule:
        hit &= c.holds(x[:, names.index(c.measure)])
    return hit


def _grow(x: np.ndarray, bad: np.ndarray, names: list[str], longest: int, cuts: int) -> Rule:
    """Adds the condition of largest FOIL gain until only bad rows are covered."""
    rule: Rule = ()
    hit = np.ones(len(x), bool)
    while len(rule) < longest:
        p0, n0 = (hit & bad).sum(), (hit & ~bad).sum()
        if not p0 or not n0:
            break
        best, found = 1e-9, None
        for k, name in enumerate(names):
            v = np.unique(x[hit, k])
            mids = (v[1:] + v[:-1]) / 2
            for t in mids if len(mids) <= cuts else np.unique(np.quantile(mids, np.linspace(0, 1, cuts), method="nearest")):
                for above in (True, False):
                    c = Condition(name, above, float(t))
                    now = hit & c.holds(x[:, k])
                    p, n = (now & bad).sum(), (now & ~bad).sum()
                    if p and (gain := p * (np.log2(p / (p + n)) - np.log2(p0 / (p0 + n0)))) > best:
                        best, found = gain, c
        if found is None:
            break
        rule += (found,)
        hit &= found.holds(x[:, names.index(found.measure)])
    return rule


def _pruned(rule: Rule, x: np.ndarray, bad: np.ndarray, names: list[str]) -> Rule:
    """The leading conditions with the best (p - n) / (p + n) on rows that the growing did not see; the shortest of equals."""

    def worth(r: Rule) -> float:
        hit = _covers(r, x, names)
        p, n = (hit & bad).sum(), (hit & ~bad).sum()
        return (p - n) / (p + n) if p + n else -1.0

    return max((rule[:k] for k in range(1, len(rule) + 1)), key=lambda r: (worth(r), -len(r)), default=())


def learn_rules(x: np.ndarray, bad: np.ndarray, names: list[str], most: int = 12, longest: int = 4, cuts: int = 48, precision: float = 0.9, least: int = 5, seed: int = 11) -> list[Rule]:
    """Sequential covering: grow a conjunction on two thirds of the rows left, prune it on the other third, keep it where
    it is right on at least `precision` of all rows left that it covers (`least` at least), take its rows away, go on."""
    rules: list[Rule] = []
    order = np.random.default_rng(seed).permutation(len(x))
    x, bad = x[order], bad[order].astype(bool)
    misses = 0
    while len(rules) < most and bad.sum() >= least and misses < 3:
        third = (np.arange(len(x)) + misses) % 3 == 0
        rule = _pruned(_grow(x[~third], bad[~third], names, longest, cuts), x[third], bad[third], names)
        hit = _covers(rule, x, names) if rule else np.zeros(len(x), bool)
        if hit.sum() >= least and bad[hit].mean() >= precision:
            rules.append(rule)
            x, bad = x[~hit], bad[~hit]
        else:
            misses += 1
    return rules


def fitted(docs: DataFrame, labels: DataFrame, max_labelled: int = 8_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", seed: int = 11) -> list[Rule]:
    """Rules learned from at most `max_labelled` labelled documents (those of smallest hashed id); label 0 is bad.

    The labels chosen are at most `max_labelled` rows, so they are broadcast; documents are read once, and only numbers
    come to the driver. No labels, or labels of one kind: no rules.
    """
    chosen = labels.select(labels[id_col].alias("__id"), labels[label_col].cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    chosen = drawn(chosen, max_labelled, seed, "__id", "__y")
    own = docs.select(docs[id_col].alias("__id"), docs[text_col].alias("__text")).join(F.broadcast(chosen), "__id")
    of = measures()
    # ids that many documents share give a row for each distinct text at most, and `max_labelled` in all
    found = with_statistics(own.dropDuplicates(["__id", "__text", "__y"]), "__text").select("__id", "__y", *[v.alias(k) for k, v in of.items()])
    rows = found.orderBy("__id", "__y", *of).limit(max_labelled).toPandas().sort_values(["__id", "__y"], kind="stable")
    if rows["__y"].nunique() < 2:
        return []
    return learn_rules(rows[list(of)].to_numpy(float), (rows["__y"] == 0).to_numpy(), list(of), seed=seed)


def verdict(rules: list[Rule]) -> Column:
    """Number of the first rule that holds, from 1; 0 where none does."""
    of, out = measures(), None
    for k, rule in enumerate(rules, 1):
        holds = F.lit(True)
        for c in rule:
            holds = holds & c.column(of)
        out = F.when(holds, k) if out is None else out.when(holds, k)
    return F.lit(0) if out is None else out.otherwise(0)


def judge(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs with the statistics, `base_failed`, `rule` (of the learned list, 0 for none) and `kept`.

    base_failed: fewer than ten words, or over a fifth of the words in repeated windows; kept: neither that nor a rule.
    Null and empty texts have no words, so they fail. Ties and repeated rows are judged alike, each on its own; an empty
    table gives an empty one. Columns of docs with the names of new ones are replaced. A map: documents are not shuffled.
    """
    rules = fitted(docs, labels, id_col=id_col, text_col=text_col, **options)
    out = with_statistics(docs, text_col).withColumn("base_failed", base_failed()).withColumn("rule", verdict(rules))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))

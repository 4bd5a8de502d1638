"""Benchmark passages in documents: SimHash of item-sized windows, a multi-index of Hamming blocks, exact confirmation.

An item of L words belongs to a window width w with a stride s, w + s - 1 <= L. Documents are cut into windows of w words at
every s-th word, and an item has the fingerprints of its first s windows: however a passage lies in a document, one of the
document's windows starts where one of the item's does. A fingerprint within `radius` of an item's has a 16-bit block within
radius // 4, so four tables of 65,536 flags let through all such windows; the rest is held against the item word for word.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.words import WordHashes, shingles, words_of

K = 5


def stride(width: int) -> int:
    return max(1, width // 6)


def width_of(words: int) -> int:
    """The largest width of the grid (1 to 12, then by fifths) that an item of so many words can have."""
    best, w = 1, 1
    while w + stride(w) - 1 <= words:
        best = w
        w = w + 1 if w < 12 else w + w // 5
    return best


def bit_counts(hashes: np.ndarray, wide: bool) -> np.ndarray:
    """Running sums of the hashes' bits in lanes of 8 (or 16) bits, eight (or four) lanes a long; row 0 is zero. Differences of
    two rows are exact while a window has at most 255 (or 65,535) words, whatever has wrapped around before."""
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.astype(np.uint16).view(np.uint64) if wide else bits.view(np.uint64)
    out = np.zeros((len(hashes) + 1, lanes.shape[1]), np.uint64)
    np.cumsum(lanes, axis=0, out=out[1:])
    return out


def fingerprints(sums: np.ndarray, start: np.ndarray, width, wide: bool) -> np.ndarray:
    """SimHash of the windows: a bit is set where more than half of the words have it."""
    counts = (sums[start + width] - sums[start]).view(np.uint16 if wide else np.uint8)
    half = width // 2 if np.isscalar(width) else (width // 2)[:, None]
    return np.packbits(counts > half, axis=1, bitorder="little").view("<u8").ravel()


def near_flags(values: np.ndarray, off: int) -> np.ndarray:
    """65,536 flags: which 16-bit values are within `off` bits of one of these."""
    flips = np.array([sum(1 << b for b in c) for n in range(off + 1) for c in combinations(range(16), n)], np.uint16)
    out = np.zeros(1 << 16, bool)
    out[(np.unique(values)[:, None] ^ flips[None, :]).ravel()] = True
    return out


def counted_shingles(items: list[tuple[int, str]]) -> tuple[np.ndarray, np.ndarray, int]:
    """Shingles of all items, how many items have each, and how many items have any; so weights do not depend on the passes."""
    cache = WordHashes()
    sets = [np.unique(shingles(cache.of(words_of(t)), K)) for _, t in items]
    known, holders = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_counts=True)
    return known, holders, sum(len(s) > 0 for s in sets)


class Index:
    """The items of one pass, by width."""

    def __init__(self, items: list[tuple[int, str]], radius: int, counted: tuple[np.ndarray, np.ndarray, int]):
        self.radius = radius
        cache = WordHashes()
        hashes = {i: cache.of(words_of(t)) for i, t in items}
        hashes = {i: h for i, h in hashes.items() if len(h)}
        bags = {i: np.unique(shingles(h, K), return_counts=True) for i, h in hashes.items()}
        every = np.concatenate([b[0] for b in bags.values()]) if bags else np.zeros(0, np.uint64)
        self.known = np.unique(every)
        of_all, holders, n = counted
        self.weights = np.log1p(n / holders[np.searchsorted(of_all, self.known)])
        self.unknown = float(np.log1p(n)) or 1.0
        self.items = {i: (len(h), *bags[i], self.weigh(bags[i][0])) for i, h in hashes.items()}
        self.widths: dict[int, tuple] = {}
        by: dict[int, list[int]] = {}
        for i, h in hashes.items():
            by.setdefault(width_of(len(h)), []).append(i)
        for w, own in sorted(by.items()):
            prints, who = [], []
            for i in own:
                start = np.arange(min(stride(w), len(hashes[i]) - w + 1))
                prints.append(fingerprints(bit_counts(hashes[i], w > 255), start, w, w > 255))
                who += [i] * len(start)
            prints = np.concatenate(prints)
            flags = [near_flags((prints >> np.uint64(16 * b)).astype(np.uint16), radius // 4) for b in range(4)]
            self.widths[w] = (prints, np.array(who), flags)

    def weigh(self, tokens: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.full(len(tokens), self.unknown)
        at = np.minimum(np.searchsorted(self.known, tokens), len(self.known) - 1)
        return np.where(self.known[at] == tokens, self.weights[at], self.unknown)

    def candidates(self, hashes: np.ndarray, begin: np.ndarray, size: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(text, word of it, item) for windows within the radius; the texts lie one after the other in hashes."""
        narrow = bit_counts(hashes, False)
        wide = bit_counts(hashes, True) if max(self.widths, default=0) > 255 else None
        for w, (prints, who, flags) in self.widths.items():
            s, big = stride(w), w > 255
            count = np.where(size >= w, (size - w) // s + 1, 0)
            short = np.flatnonzero((size < w) & (4 * size >= 3 * w))  # a text that is a little shorter is one window
            text = np.concatenate([np.repeat(np.arange(len(size)), count), short])
            first = np.cumsum(count) - count
            word = np.concatenate([(np.arange(count.sum()) - np.repeat(first, count)) * s, np.zeros(len(short), np.int64)])
            width = np.concatenate([np.full(count.sum(), w), size[short]]) if len(short) else w
            if not len(text):
                continue
            found = fingerprints(wide if big else narrow, begin[text] + word, width, big)
            pieces = found.view(np.uint16).reshape(-1, 4)
            hit = flags[0][pieces[:, 0]] | flags[1][pieces[:, 1]] | flags[2][pieces[:, 2]] | flags[3][pieces[:, 3]]
            at = np.flatnonzero(hit)
            for a in range(0, len(at), max(1, 2_000_000 // len(prints))):
                part = at[a : a + max(1, 2_000_000 // len(prints))]
                i, j = np.divmod(np.flatnonzero(np.bitwise_count(found[part][:, None] ^ prints[None, :]) <= self.radius), len(prints))
                yield from zip(text[part[i]].tolist(), word[part[i]].tolist(), who[j].tolist(), strict=True)

    def similarity(self, hashes: np.ndarray, item: int) -> float:
        """Weighted Jaccard similarity of the bags of shingles."""
        _, tokens, counts, weights = self.items[item]
        own, n = np.unique(shingles(hashes, K), return_counts=True)
        at = np.minimum(np.searchsorted(tokens, own), len(tokens) - 1)
        same = tokens[at] == own
        both = float((np.minimum(n[same], counts[at[same]]) * weights[at[same]]).sum())
        total = float((n * self.weigh(own)).sum() + (counts * weights).sum())
        return both / (total - both)

    def best(self, hashes: np.ndarray, places: np.ndarray, tokens: np.ndarray, starts: set[int], item: int, threshold: float) -> tuple[float, int] | None:
        """The best similarity of an item-sized window that starts near one of `starts`, and its first word; None where no
        window can reach the threshold. places and tokens: where the text has shingles that some item has. What a window
        shares with the item weighs `threshold` times the item at least if it is that similar."""
        length, own, counts, weights = self.items[item]
        if length < K:  # one shingle, of its own length: such windows hold nothing of it or all
            found = [p for p in sorted(starts) if p + length <= len(hashes)]
            return max(((self.similarity(hashes[p : p + length], item), -p) for p in found), default=None)
        mine = np.isin(tokens, own)
        if not mine.any():
            return None
        places, weight = places[mine], np.concatenate([[0.0], np.cumsum(self.weigh(tokens[mine]))])
        w = width_of(length)
        tries = np.unique(np.clip((np.array(sorted(starts))[:, None] + np.arange(-stride(w), stride(w) + 1)).ravel(), 0, max(len(hashes) - length, 0)))
        shared = weight[np.searchsorted(places, tries + length)] - weight[np.searchsorted(places, tries)]
        tries = tries[shared >= threshold * float((counts * weights).sum()) - 1e-6].tolist()
        return max(((self.similarity(hashes[p : p + length], item), -p) for p in tries), key=lambda x: (round(x[0], 12), x[1]), default=None)


def _matches(batches: Iterator[pa.RecordBatch], index: Index, threshold: float, words_a_turn: int) -> Iterator[pa.RecordBatch]:
    cache = WordHashes()
    for batch in batches:
        ids, rows = batch.column(0).to_pylist(), []
        turn: list[tuple[int, np.ndarray]] = []
        held = 0

        def look() -> None:
            nonlocal turn, held
            if held:
                sizes = np.array([len(h) for _, h in turn], np.int64)
                found: dict[int, dict[int, set[int]]] = {}
                for text, word, item in index.candidates(np.concatenate([h for _, h in turn]), np.cumsum(sizes) - sizes, sizes):
                    found.setdefault(text, {}).setdefault(item, set()).add(word)
                for text, items in sorted(found.items()):
                    h = turn[text][1]
                    own = shingles(h, K)
                    at = np.minimum(np.searchsorted(index.known, own), len(index.known) - 1)
                    places = np.flatnonzero(index.known[at] == own)
                    for item, starts in sorted(items.items()):
                        best = index.best(h, places, own[places], starts, item, threshold)
                        if best and best[0] >= threshold - 1e-9:
                            rows.append((ids[turn[text][0]], item, -best[1], index.items[item][0], best[0]))
            turn, held = [], 0

        for k, text in enumerate(batch.column(1)):
            h = cache.of(words_of(text.as_py()))
            if len(h):
                turn.append((k, h))
                held += len(h)
            if held >= words_a_turn:
                look()
        look()
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()))], names=["id", "item_id", "start_word", "n_words", "similarity"])


def _named(batches: Iterator[pa.RecordBatch], names: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Matches with the items' ids in place of their numbers."""
    for batch in batches:
        numbers = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names[numbers], pa.int64()), *batch.columns[2:]], names=batch.schema.names)


def contaminated(docs: DataFrame, benchmark: DataFrame, radius: int = 11, threshold: float = 0.75, items_a_pass: int = 5_000, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", words_a_turn: int = 60_000) -> DataFrame:
    """A row for each document and benchmark item that a window of it repeats: id, item_id, start_word (where the best such
    window starts), n_words (of the item), similarity (weighted Jaccard of the bags of five-word shingles, `threshold` at
    least; a shingle weighs less the more items have it).

    Texts are compared lower-cased (A-Z), whole, as words of non-space characters. Null and empty texts and items without a
    word match nothing. Items of fewer than five words are one shingle and are looked for at their own length, so every text that
    has their words in a row matches with similarity 1. Columns of other names are not read, whatever they are called. Repeated document rows give their rows each; of items
    with one id every text is looked for, and each that is found gives a row (equal texts of an id are one). Items are broadcast `items_a_pass` at a time and documents read once for
    each pass, so memory is bounded for any benchmark. No shuffle of documents. An empty table gives an empty one.
    """
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    items = [(r["i"], r["t"]) for r in benchmark.select(benchmark[item_col].cast("long").alias("i"), benchmark[item_text_col].cast("string").alias("t")).where("i is not null and t is not null").distinct().orderBy("i", "t").collect()]
    # texts go by their number within the pass, so that several may share an id
    out, counted = None, counted_shingles(items)
    for a in range(0, max(len(items), 1), items_a_pass):
        own = items[a : a + items_a_pass]
        index = docs.sparkSession.sparkContext.broadcast(Index([(n, t) for n, (_, t) in enumerate(own)], radius, counted))
        names = docs.sparkSession.sparkContext.broadcast(np.array([i for i, _ in own], np.int64))
        found = rows.mapInArrow(lambda batches, index=index, names=names: _named(_matches(batches, index.value, threshold, words_a_turn), names.value), "id long, item_id long, start_word long, n_words long, similarity double")
        out = found if out is None else out.union(found)
    return out.withColumnRenamed("id", id_col)

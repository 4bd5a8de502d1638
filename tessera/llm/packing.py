"""Documents packed into token sequences by the linear grouping scheme.

The plan is made for the histogram of piece lengths (at most `capacity` numbers, whatever the corpus): large lengths are
rounded up within groups of equal cardinality, a configuration linear program over the few group sizes is solved by column
generation, actual lengths take the places of the rounded ones, and small lengths fill the gaps best-fit. Spark then gives
every piece its rank among the pieces of its length, and a look-up of (length, rank) in the plan is its place.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.store import saved

#: Fixed value: how byte-level BPE splits a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class Tokens:
    """ids of a byte-level BPE vocabulary in the tokenizers JSON format.

    The merges run in tiktoken, whose ids are the same and which takes a quarter of the time; texts with the string of a
    special token, and those that tiktoken gives up on, go to tokenizers itself. The file's parts and the order of its merges
    are compared with what tiktoken does at the start."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        self.exact.no_truncation()
        self.exact.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        back = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
        self.fast = tiktoken.Encoding("pieces", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        before, model = spec["pre_tokenizer"] or {}, spec["model"]
        same = spec["normalizer"] is None and spec.get("post_processor") is None and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
        same &= not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        # merges in the order of the ids that they make: then the lowest id is the first merge, which is what tiktoken takes
        made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
        same &= all(a < b for a, b in zip(made, made[1:], strict=False)) and len(made) + 256 == len(ranks)
        probe = "It's a pröbe,  with\n\n 12345 words… and ☃ don't"
        if not same:
            raise ValueError(f"{path} is not a byte-level BPE that tiktoken can run")
        if self.fast.encode_ordinary(probe) != self.exact.encode(probe, add_special_tokens=False).ids:
            raise ValueError(f"{path} is not a byte-level BPE that tiktoken can run")

    def ids(self, text: str) -> np.ndarray:
        if any(s in text for s in self.special):
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")
        try:
            return np.asarray(self.fast.encode_to_numpy(text, disallowed_special=()), "<u4")
        except ValueError:  # its regex has a stack, which white space of some 800,000 characters exhausts
            return np.array(self.exact.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=2)
def tokens_of(path: str) -> Tokens:
    return Tokens(path)


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n tokens: one if they fit, else full ones after a first that may be shorter."""
    first = n % capacity or capacity
    return [(0, first)] + [(a, capacity) for a in range(first, n, capacity)]


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32 of every piece. Null text: empty, one piece of the end id alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(tokenizer_path)
        end = np.array([end_id], "<u4")
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([tokens.ids(text.as_py() or ""), end])
                rows += [(doc, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cut(len(ids), capacity))]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)] if rows else [pa.array([], t) for t in (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, piece int, start long, length long, ids_crc32 long")


# ------------------------------------------------------------------ the plan


def groups_of(counts: dict[int, int], k: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Lengths from the longest in k groups of equal cardinality: (rounded length, [(length, count)])."""
    total = sum(counts.values())
    share, out, own, have = -(-total // k), [], [], 0
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            take = min(left, share - have)
            own.append((n, take))
            left, have = left - take, have + take
            if have == share:
                out.append((own[0][0], own))
                own, have = [], 0
    if own:
        out.append((own[0][0], own))
    merged: list[tuple[int, list[tuple[int, int]]]] = []
    for size, items in out:  # groups that round to one length are one group
        if merged and merged[-1][0] == size:
            merged[-1][1].extend(items)
        else:
            merged.append((size, list(items)))
    return merged


def _best_pattern(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each size with the most worth that fit, by layers of one more item (sizes are large, so layers are few)."""
    most = capacity // int(sizes.min())
    value = np.zeros(capacity + 1)
    came = []
    at = np.arange(capacity + 1)[None, :] - sizes[:, None]
    ok = at >= 0
    for _ in range(most):
        with_one = np.where(ok, value[np.where(ok, at, 0)] + worth[:, None], -1.0)
        pick = with_one.argmax(axis=0)
        new = with_one[pick, np.arange(capacity + 1)]
        better = new > value + 1e-12
        came.append(np.where(better, pick, -1))
        value = np.where(better, new, value)
    out, room = np.zeros(len(sizes), np.int64), capacity
    for pick in reversed(came):
        if (k := int(pick[room])) >= 0:
            out[k] += 1
            room -= int(sizes[k])
    return out


def configurations(sizes: list[int], demand: list[int], capacity: int, rounds: int = 3000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used: min sum x with sum x * pattern >= demand, by column generation."""
    s, n, k = np.array(sizes), np.array(demand, float), len(sizes)
    basis = np.diag(capacity // s).astype(float)
    inverse = np.diag(1.0 / np.diag(basis))
    for step in range(rounds):
        duals = np.maximum(inverse.sum(axis=0), 0)
        pattern = _best_pattern(s, duals, capacity).astype(float)
        if pattern @ duals <= 1 + 1e-9:
            break
        direction, x = inverse @ pattern, inverse @ n
        ratio = np.where(direction > 1e-9, x / np.maximum(direction, 1e-9), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        basis[:, out] = pattern
        if step % 50 == 49:
            inverse = np.linalg.inv(basis)
        else:
            row = inverse[out] / direction[out]
            inverse -= np.outer(direction, row)
            inverse[out] = row
    x = inverse @ n
    return [(basis[:, j].astype(np.int64), float(x[j])) for j in range(k) if x[j] > 1e-9]


class _Open:
    """Sequences alike, with room left: the least room first. Each entry: how many, and the slots (length, first rank)."""

    def __init__(self) -> None:
        self.rooms: list[int] = []
        self.of: dict[int, list[list]] = defaultdict(list)

    def add(self, room: int, count: int, slots: list[tuple[int, int]]) -> None:
        if not self.of[room]:
            insort(self.rooms, room)
        self.of[room].append([count, slots])

    def tightest(self, length: int) -> int | None:
        k = bisect_left(self.rooms, length)
        return self.rooms[k] if k < len(self.rooms) else None

    def take(self, room: int, most: int) -> tuple[int, list[tuple[int, int]]]:
        count, slots = own = self.of[room][-1]
        got = min(count, most)
        if got < count:
            own[0], own[1] = count - got, [(n, r + got) for n, r in slots]
        else:
            self.of[room].pop()
            if not self.of[room]:
                self.rooms.remove(room)
        return got, slots


def _fill(open_: _Open, counts: dict[int, int], rank: dict[int, int], capacity: int) -> None:
    """Best-fit, longest first: every length goes where the least room is left, else into new sequences."""
    for n in sorted(counts, reverse=True):
        left = counts[n]
        while left:
            room = open_.tightest(n)
            if room is None:
                each = capacity // n
                new = max(1, left // each)
                use = min(each, left)
                open_.add(capacity - use * n, new, [(n, rank[n] + j * new) for j in range(use)])
                rank[n] += new * use
                left -= new * use
            else:
                got, slots = open_.take(room, left)
                open_.add(room - n, got, [*slots, (n, rank[n])])
                rank[n] += got
                left -= got


def plan(counts: dict[int, int], capacity: int, large: int, groups: int) -> tuple[np.ndarray, int]:
    """Rows (length, first rank, last rank + 1, sequence of the first rank, offset), and the number of sequences."""
    rank: dict[int, int] = defaultdict(int)
    open_ = _Open()
    big = {n: c for n, c in counts.items() if n > large}
    small = {n: c for n, c in counts.items() if n <= large and c}
    if big:
        grouped = groups_of(big, groups)
        queues = [list(items) for _, items in grouped]

        def draw(group: int, most: int) -> list[tuple[int, int, int]]:
            """(length, first rank, count) of the next items of a group, `most` at most."""
            out = []
            while most and queues[group]:
                n, c = queues[group][0]
                got = min(c, most)
                out.append((n, rank[n], got))
                rank[n] += got
                most -= got
                if got == c:
                    queues[group].pop(0)
                else:
                    queues[group][0] = (n, c - got)
            return out

        found = configurations([s for s, _ in grouped], [sum(c for _, c in items) for _, items in grouped], capacity)
        for pattern, x in sorted(found, key=lambda p: -p[1]):
            times = int(x + 1e-6)
            if not times:
                continue
            runs = [draw(g, times) for g in np.flatnonzero(pattern) for _ in range(pattern[g])]
            edges = sorted({0, times, *(int(e) for run in runs for e in np.cumsum([c for _, _, c in run]))})
            place = [0] * len(runs)
            begun = [0] * len(runs)
            for a, b in zip(edges, edges[1:], strict=False):
                slots = []
                for j, run in enumerate(runs):
                    if place[j] < len(run):
                        n, r, c = run[place[j]]
                        slots.append((n, r + a - begun[j]))
                        if b == begun[j] + c:
                            begun[j], place[j] = b, place[j] + 1
                if slots:
                    open_.add(capacity - sum(n for n, _ in slots), b - a, slots)
        rest: dict[int, int] = defaultdict(int)
        for queue in queues:
            for n, c in queue:
                rest[n] += c
        _fill(open_, rest, rank, capacity)
    _fill(open_, small, rank, capacity)
    rows, sequence = [], 0
    for room in list(open_.of):
        for count, slots in open_.of[room]:
            offset = 0
            for n, r in slots:
                rows.append((n, r, r + count, sequence, offset))
                offset += n
            sequence += count
    return np.array(sorted(rows), np.int64).reshape(-1, 5), sequence


def best_plan(counts: dict[int, int], capacity: int, tries: tuple[tuple[int, int], ...] = ((2, 64), (3, 64), (3, 128))) -> np.ndarray:
    """The plan with the fewest sequences among (large: over capacity / d, number of groups) of `tries`."""
    best = None
    least = -(-sum(n * c for n, c in counts.items()) // capacity)
    for d, groups in tries:
        rows, used = plan(counts, capacity, capacity // d, groups)
        if best is None or used < best[0]:
            best = (used, rows)
        if best[0] == least:
            break
    return best[1] if best else np.zeros((0, 5), np.int64)


# ------------------------------------------------------------------ the assignment


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", rows_a_block: int = 1_000_000, least_blocks: int = 64) -> DataFrame:
    """A row a piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    Null and empty texts are one piece of the end id; repeated rows are pieces of their own (which of equal rows gets which
    place is open); an empty table gives an empty one; other columns are not read. The driver sees the histogram of lengths
    (`capacity` rows at most). A piece's rank is its rank in a hashed block of its length plus the sizes of the blocks
    before, so a length that a third of all pieces have is spread over as many tasks as there are blocks.
    """
    own = saved(pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    total = own.count()
    blocks = max(least_blocks, -(-total // rows_a_block))
    keyed = own.withColumn("block", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(blocks)).cast("int"))
    sizes = saved(keyed.groupBy("length", "block").agg(F.count("*").alias("n")), "piece-counts")
    counts = {r["length"]: r["n"] for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rows = best_plan(counts, capacity)
    before = F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("length", "block", F.coalesce(before, F.lit(0)).alias("before"))
    in_block = F.row_number().over(Window.partitionBy("length", "block").orderBy("id", "piece", "start", "ids_crc32"))
    ranked = keyed.withColumn("rank", in_block - 1).join(starts, ["length", "block"]).select("id", "piece", "start", "length", "ids_crc32", (F.col("rank") + F.col("before")).alias("rank"))
    key = rows[:, 0] << 44 | rows[:, 1]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, rank = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in (3, 5))
            at = np.searchsorted(key, n << 44 | rank, side="right") - 1
            if len(n) and not ((rows[at, 0] == n) & (rank < rows[at, 2])).all():
                raise ValueError("a piece has no place in the plan")
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(rows[at, 3] + rank - rows[at, 1]), pa.array(rows[at, 4])], names=["id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, "id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long").withColumnRenamed("id", id_col)

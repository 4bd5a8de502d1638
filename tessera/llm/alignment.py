"""Token groups and links between two tokenizers over the same texts, found by relational joins on byte offsets.

A text is taken apart into spans where both tokenizers cut whatever comes before and after: in front of a single space that
follows a character other than white space. No pretoken of the byte-level vocabulary and no piece of the other one crosses such
a place (the pieces are looked through for one that does), so a text's tokens are those of its spans in a row, and so are its
groups and links. Each distinct span is therefore tokenized and aligned once, and counts as often as it occurs:

    posexplode tokens -> windowed sums of their lengths -> equi-join of both on (span, end) -> running count of the common ends as
    group id -> links by group where one side has one token, by a range join on blocks of bytes where both have more.

Links are then counted by id pair over the corpus, and each text's row is put together from the rows of its spans.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.packing import tokens_of
from tessera.llm.store import removed, saved

_CUT = re.compile(r"(?<=\S) (?=.)", re.S)
_PLAIN = re.compile(r"\s |^ | $")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")
SPACE = "▁"
_MARKS = str.maketrans("abc", ",|;")
BLOCK = 64  # bytes; tokens of a group are joined by the blocks that they lie in
DEALT = 40_000  # spans of a task that sorts and sums their tokens
NUMBERS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")


def spans_of(text: str) -> list[str]:
    """The spans of a text, each without the space in front of it (that of the first is the one that both encoders add)."""
    if not text:
        return []
    return _CUT.split(text) if _PLAIN.search(text) else text.split(" ")


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the varint and bytes fields of a protocol buffer message; fixed-width fields are passed over."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        elif key & 7 == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            at += 8 if key & 7 == 1 else 4


def changes_nothing(model: bytes) -> bool:
    """Whether a sentencepiece model reads texts as they are, but for the space put in front: no character map, no white space removed.
    Fixed values: the message's field 3 is the normalizer, whose fields 2 to 5 are map, prefix, removal and escaping."""
    spec = next((dict(_fields(v)) for n, v in _fields(model) if n == 3), {})
    return not spec.get(2) and bool(spec.get(3, 1)) and not spec.get(4, 1) and bool(spec.get(5, 1))


class Pair:
    """Both tokenizers, with the bytes of each of their ids."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece

        self.a = tokens_of(a_path)
        self.a.exact.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        self.as_it_is = changes_nothing(self.b.serialized_model_proto())
        self.b_bytes = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if re.search(f"[^{SPACE}]{SPACE}", piece):
                raise ValueError(f"the piece {piece!r} holds a space behind another character, so spans can't be told apart")
            self.b_bytes.append(bytes([int(m[1], 16)]) if self.b.is_byte(i) and (m := _BYTE.fullmatch(piece)) else piece.replace(SPACE, " ").encode())

    def whole(self, text: str | None) -> bool:
        """Whether the text has tokens: neither null nor empty, and B gives back every byte of it."""
        return bool(text) and SPACE not in text and (self.as_it_is or self.b.normalize(text) == SPACE + text.replace(" ", SPACE))

    def encode_a(self, text: str) -> list[int]:
        try:
            return self.a.fast.encode_ordinary(text)
        except ValueError:  # white space of some 800,000 characters
            return self.a.exact.encode(text, add_special_tokens=False).ids

    def lengths_a(self, ids: list[int]) -> list[int]:
        return [len(self.a.fast.decode_single_token_bytes(i)) for i in ids]


@lru_cache(maxsize=1)
def pair_of(a_path: str, b_path: str) -> Pair:
    return Pair(a_path, b_path)


def span_counts(docs: DataFrame, a_path: str, b_path: str, text_col: str, most: int = 100_000) -> DataFrame:
    """span, n: the distinct spans of all texts that have tokens. Tasks count before the shuffle, up to `most` spans at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, seen = pair_of(a_path, b_path), Counter()
        for batch in batches:
            for text in batch.column(0):
                if pair.whole(text := text.as_py()):
                    seen.update(spans_of(text))
                    if len(seen) >= most:
                        yield from _counted(seen)
                        seen = Counter()
        yield from _counted(seen)

    texts = docs.select(docs[text_col].cast("string").alias("text"))
    return texts.mapInArrow(run, "span string, n long").groupBy("span").agg(F.sum("n").alias("n"))


def _counted(seen: Counter) -> Iterator[pa.RecordBatch]:
    spans, n = list(seen), np.fromiter(seen.values(), np.int64, len(seen))
    for k in range(0, len(spans), 20_000):
        yield pa.RecordBatch.from_arrays([pa.array(spans[k : k + 20_000], pa.string()), pa.array(n[k : k + 20_000])], names=["span", "n"])


def tokenized(spans: DataFrame, a_path: str, b_path: str) -> DataFrame:
    """cid, span, n, and of either tokenizer the ids and the byte lengths of the span's tokens, the space in front of it included."""
    ints = pa.list_(pa.int32())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = pair_of(a_path, b_path)
        for whole in batches:
            for k in range(0, whole.num_rows, 4096):
                batch = whole.slice(k, 4096)
                spans = batch.column(1).to_pylist()
                a = [pair.encode_a(" " + s) for s in spans]
                b = pair.b.encode(spans, num_threads=1)
                la, lb = [pair.lengths_a(x) for x in a], [[len(pair.b_bytes[i]) for i in x] for x in b]
                for s, x, y in zip(spans, la, lb, strict=True):
                    if not sum(x) == sum(y) == len(s.encode()) + 1:
                        raise ValueError(f"tokens of {s[:80]!r} do not give back its bytes")
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(x, ints) for x in (a, la, b, lb)]], names=["cid", "span", "n", "a", "a_len", "b", "b_len"])

    named = spans.select(F.monotonically_increasing_id().alias("cid"), "span", "n")
    return named.mapInArrow(run, "cid long, span string, n long, a array<int>, a_len array<int>, b array<int>, b_len array<int>")


def token_ends(tokens: DataFrame) -> DataFrame:
    """cid, end, and a and b: start, end and id of the token of either tokenizer that ends there, null where none does.

    Tokens of both are exploded from one table that is dealt by span; windowed sums of their lengths are their ends; and the full
    equi-join of both sides on (span, end) is one aggregate over their union, so that all of it takes a single exchange of rows
    that still hold whole token lists. Partitions have about DEALT spans, for a few MB of lists are hundreds of MB of rows to sort."""
    listed = lambda s, of_b: F.zip_with(s, s + "_len", lambda i, n: F.struct(F.lit(of_b).alias("of_b"), i.alias("id"), n.alias("len")))
    both = F.concat(listed("a", False), listed("b", True))
    dealt = tokens.select("cid", "a", "a_len", "b", "b_len").repartition(max(-(-tokens.count() // DEALT), 1), "cid")  # plain lists of numbers, a fifth of what structs take
    rows = dealt.select("cid", F.posexplode(both).alias("pos", "t")).select("cid", "pos", "t.*")
    upto = Window.partitionBy("cid", "of_b").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum("len").over(upto).cast("int"))
    side = lambda k, c: F.max(F.when(F.col("of_b") == F.lit(k), F.col(c)))
    met = rows.groupBy("cid", "end").agg(side(False, "id").alias("ia"), side(False, "len").alias("la"), side(True, "id").alias("ib"), side(True, "len").alias("lb"))
    token = lambda s: F.when(F.col("i" + s).isNotNull(), F.struct((F.col("end") - F.col("l" + s)).alias("start"), "end", F.col("i" + s).alias("id"))).alias(s)
    return met.select("cid", "end", token("a"), token("b"))


def token_groups(tokens: DataFrame) -> DataFrame:
    """cid, g, a, b: the tokens of each group, in order. Groups end where a token of each tokenizer does."""
    cut = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), 1).otherwise(0)
    before = F.sum(cut).over(Window.partitionBy("cid").orderBy("end").rowsBetween(Window.unboundedPreceding, 0)) - cut
    grouped = token_ends(tokens).withColumn("g", before.cast("int")).groupBy("cid", "g")
    return grouped.agg(F.sort_array(F.collect_list("a")).alias("a"), F.sort_array(F.collect_list("b")).alias("b"))


def links_between(groups: DataFrame) -> DataFrame:
    """cid, a, b: a row for each two tokens of a group (cid, g, a, b) whose bytes overlap. Tokens meet in the
    blocks of BLOCK bytes that they touch, and count in the one in which the later of them starts, so a group of any length
    has at most BLOCK * BLOCK comparisons a block."""
    first, last = F.floor(F.col("t.start") / BLOCK), F.floor((F.col("t.end") - 1) / BLOCK)
    side = lambda s: groups.select("cid", "g", F.explode(s).alias("t")).select("cid", "g", F.col("t").alias(s), F.explode(F.sequence(first, last)).alias("block"))
    met = side("a").join(side("b"), ["cid", "g", "block"])
    later = F.greatest("a.start", "b.start")
    return met.where((F.col("a.start") < F.col("b.end")) & (F.col("b.start") < F.col("a.end")) & (F.floor(later / BLOCK) == F.col("block"))).select("cid", F.col("a.id").alias("a"), F.col("b.id").alias("b"))


def aligned_spans(tokens: DataFrame, most_pairs: int = 1_000_000) -> tuple[DataFrame, DataFrame]:
    """(spans, pairs): a row a span with its numbers, its groups (see packed) and its count n; a row an id pair with its count over the
    corpus and whether that is the highest of its B id. Pairs are broadcast where there are `most_pairs` at most (a bound
    for any two vocabularies that is checked), and joined by shuffles beyond."""
    ids = lambda s: F.array_join(F.transform(s, lambda t: t["id"].cast("string")), ",")
    single = F.least(F.size("a"), F.size("b")) == 1
    every = F.flatten(F.transform("a", lambda x: F.transform("b", lambda y: F.struct(x["id"].alias("a"), y["id"].alias("b")))))
    rows = token_groups(tokens).select(
        "cid", "g", F.size("a").alias("na"), F.size("b").alias("nb"), F.concat_ws("|", ids("a"), ids("b")).alias("text"), F.when(single, every).otherwise(F.array().cast("array<struct<a:int,b:int>>")).alias("links"),
        F.when(~single, F.struct("g", "a", "b")).alias("several"),
    )
    spans = saved(rows.groupBy("cid").agg(
        F.sum("na").alias("n_a"), F.sum("nb").alias("n_b"), F.count("*").alias("n_groups"), F.flatten(F.collect_list("links")).alias("links"),
        packed(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("g", "text"))), lambda x: x["text"]), ";")).alias("groups"), F.collect_list("several").alias("several"),
    ).join(tokens.select("cid", "span", "n"), "cid"), "aligned", tidy=True)
    wide = links_between(spans.where(F.size("several") > 0).select("cid", F.explode("several").alias("x")).select("cid", "x.*"))
    wide = saved(wide.groupBy("cid").agg(F.collect_list(F.struct("a", "b")).alias("more")), "wide-links", tidy=True)
    linked = spans.join(wide, "cid", "left").select("cid", "n", F.explode(F.concat("links", F.coalesce("more", F.array().cast("array<struct<a:int,b:int>>")))).alias("x"))
    counts = saved(linked.groupBy("x.a", "x.b").agg(F.sum("n").alias("count")), "pair-counts", tidy=True)
    highest = counts.groupBy("b").agg(F.max("count").alias("highest"))
    pairs = saved(counts.join(highest, "b").select("a", "b", "count", (F.col("count") == F.col("highest")).alias("best")), "pairs", tidy=True)
    known = F.broadcast(pairs) if pairs.count() <= most_pairs else pairs
    sums = linked.select("cid", "x.a", "x.b").join(known, ["a", "b"]).groupBy("cid").agg(F.count("*").alias("n_links"), F.count_if("best").alias("n_best"), F.sum("count").alias("count_sum"))
    out = saved(spans.drop("links", "several").join(sums, "cid").drop("cid"), "spans", tidy=True)
    removed(spans, wide, counts)
    return out, pairs


def packed(groups: Column) -> Column:
    """The text of groups in half its bytes: digits and the three marks between them are four bits each (a last d fills up a byte)."""
    marks = F.translate(groups, ",|;", "abc")
    return F.unhex(F.when(F.length(marks) % 2 == 1, F.concat(marks, F.lit("d"))).otherwise(marks))


def unpacked(data: bytes) -> str:
    return data.hex().rstrip("d").translate(_MARKS)


def least_count(spans: DataFrame, most: int) -> int:
    """The smallest power of 1.05 from which on not more than `most` spans occur so often; a few hundred sums decide it."""
    step = F.floor(F.log(1.05, F.col("n").cast("double")) + 1e-9)
    found, least = 0, 1 << 62
    for r in spans.groupBy(step.alias("step")).agg(F.count("*").alias("spans"), F.min("n").alias("n")).orderBy(F.desc("step")).collect():
        found += r["spans"]
        if found > most:
            break
        least = r["n"]
    return least


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", frequent: int = 1 << 17) -> DataFrame:
    """One row a document: id, n_a, n_b, n_groups, n_links, n_best, count_sum (long) and groups, its groups as
    `a1,a2|b1;a3|b2,b3` (ids of A and B). A is a byte-level BPE file that reads space + text, B a sentencepiece model that adds
    that space itself; special tokens are never made.

    Null and empty texts, and those that B does not give back byte for byte, have no tokens: zeros and an empty string, and
    their links do not count. Repeated rows give a row each and count each time. Empty tables give empty ones; other
    columns are not read. The rows of the `frequent` commonest spans of up to 512 bytes go to the tasks (about 60 MB at most with
    the usual 131,072); all others are joined by span, where a span is not among the commonest, so it has a small part of all occurrences. Texts are
    told apart by 64-bit hashes for that join only.
    """
    tokens = saved(tokenized(span_counts(docs, a_path, b_path, text_col), a_path, b_path), "span-tokens", tidy=True)
    spans, _ = aligned_spans(tokens)
    removed(tokens)
    top = spans.where((F.col("n") >= least_count(spans, frequent)) & (F.octet_length("span") <= 512)).drop("n").toPandas()
    names, known_groups = top["span"].tolist(), [unpacked(bytes(x)) for x in top["groups"]]
    numbers = top[list(NUMBERS)].to_numpy(np.int64).reshape(-1, len(NUMBERS))

    def rare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, seen = set(names), set()  # copies of a text in one task give their spans once
        for whole in batches:
            for k in range(0, whole.num_rows, 512):
                batch = whole.slice(k, 512)
                found: tuple[list, list, list] = ([], [], [])
                for th, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if th in seen or not (text := text.as_py()):
                        continue
                    if len(seen) >= 500_000:
                        seen.clear()
                    seen.add(th)
                    missing = [(p, s) for p, s in enumerate(spans_of(text)) if s not in index]
                    found[0].extend([th] * len(missing))
                    found[1].extend([p for p, _ in missing])
                    found[2].extend([s for _, s in missing])
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(found, (pa.int64(), pa.int32(), pa.string()), strict=True)], names=["th", "pos", "span"])

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    wanted = rows.select("th", "text").mapInArrow(rare, "th long, pos int, span string").repartition("span").dropDuplicates(["span", "th", "pos"])
    # place (four bytes) and groups in one value, numbers already summed: what is exchanged are a few dozen bytes a rare span
    known = spans.select("span", *NUMBERS, "groups")
    found = wanted.join(known, "span").groupBy("th").agg(*[F.sum(c).alias(c) for c in NUMBERS], F.collect_list(F.concat(F.unhex(F.lpad(F.hex("pos"), 8, "0")), F.col("groups"))).alias("rare"))
    both = rows.join(found, "th", "left").select("id", "text", "rare", *NUMBERS)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, index = pair_of(a_path, b_path), {s: k for k, s in enumerate(names)}
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                batch = whole.slice(k, 256)
                out, groups = np.zeros((batch.num_rows, len(NUMBERS)), np.int64), []
                for r in range(batch.num_rows):
                    text = batch.column(1)[r].as_py()
                    if not pair.whole(text):
                        groups.append("")
                        continue
                    at = np.fromiter((index.get(s, -1) for s in spans_of(text)), np.int64)
                    missing = np.flatnonzero(at < 0)
                    parts = [known_groups[i] if i >= 0 else "" for i in at.tolist()]
                    out[r] = numbers[at[at >= 0]].sum(axis=0)
                    if len(missing):
                        own = {int.from_bytes(x[:4], "big"): x[4:] for x in batch.column(2)[r].as_py() or ()}
                        if len(own) != len(missing):
                            raise ValueError("a span of a text was not aligned")
                        out[r] += [batch.column(c)[r].as_py() for c in range(3, 3 + len(NUMBERS))]
                        for p in missing.tolist():
                            parts[p] = unpacked(own[p])
                    groups.append(";".join(parts))
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(np.ascontiguousarray(out[:, c])) for c in range(len(NUMBERS))], pa.array(groups, pa.string())], names=["id", *NUMBERS, "groups"])

    kind = docs.schema[id_col].dataType.simpleString()
    return both.mapInArrow(put, f"id {kind}, " + ", ".join(f"{c} long" for c in NUMBERS) + ", groups string").withColumnRenamed("id", id_col)

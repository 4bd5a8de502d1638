"""Documents whose sets of word shingles have a Jaccard similarity of at least num/den, as connected groups.

The document by n-gram incidence is multiplied with its transpose in blocks of n-grams. Two products are formed:

1. over the prefixes: with n-grams in one global order (common ones last), a set of n can only reach the similarity with a
   set that shares one of its first n - ceil(num/den n) + 1 n-grams. The overlaps accumulated there, with the sizes, bound
   the whole overlap from above; pairs that cannot reach the least overlap for their sizes are discarded;
2. over the whole sets of the documents that are left in some pair, which gives their overlaps exactly.

In a block, n-grams that the same documents have are one row with a weight, so a passage costs its pairs once and not once
a word. N-grams that very many documents have ("common") make no pairs: each document that cannot do without them in its
prefix is compared with the one of its n-gram's documents that has most of them, and what could still be linked across
groups is compared after that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.components import components
from tessera.llm.store import saved
from tessera.llm.words import WordHashes, shingle_set, signature, words_of

NUM, DEN = 75, 100  # Jaccard similarity of at least 0.75
_BLOCK = "block int, tokens binary, slot binary, docs binary"


def least_overlap(total, num: int = NUM, den: int = DEN):
    """Least overlap of two sets of `total` n-grams together: overlap >= num/den * (total - overlap)."""
    return -(-num * total // (num + den))


def _sets(texts: pa.Array, cache: WordHashes, k: int) -> Iterator[np.ndarray]:
    for text in texts:
        yield shingle_set(cache.of(words_of(text.as_py())), k)


def profile(docs: DataFrame, k: int, share: float, least: int) -> DataFrame:
    """kind 0: id, n (size of the set), sig (name of the set); kind 1: sig (an n-gram), n (documents of this batch that have
    it, where that is `share` of them and `least` at least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            ids, sizes, names, seen = batch.column(0), [], [], {}
            for s in _sets(batch.column(1), cache, k):
                name = signature(s) if len(s) else None
                sizes.append(len(s))
                names.append(name)
                if name is not None:
                    seen.setdefault(name, s)
            tokens = np.sort(np.concatenate(list(seen.values()))) if seen else np.zeros(0, np.uint64)
            at = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]])) if len(tokens) else np.zeros(0, np.int64)
            counts = np.diff(np.append(at, len(tokens)))
            often = counts >= max(least, share * len(seen))
            heavy, n = tokens[at[often]].view(np.int64), counts[often]
            yield pa.RecordBatch.from_arrays([
                pa.array([0] * len(ids) + [1] * len(heavy), pa.int8()), pa.concat_arrays([ids, pa.nulls(len(heavy), pa.int64())]),
                pa.array(sizes + n.tolist(), pa.int64()), pa.array(names + heavy.tolist(), pa.int64()),
            ], names=["kind", "id", "n", "sig"])

    return docs.mapInArrow(run, "kind byte, id long, n long, sig long")


class _Blocks:
    """Postings of one task, dealt into blocks by n-gram. A block's documents are listed once, postings name their slot."""

    def __init__(self, blocks: int, most: int):
        self.blocks, self.most = blocks, most
        self.clear()

    def clear(self) -> None:
        self.tokens: list[np.ndarray] = []
        self.docs: list[tuple[int, int]] = []
        self.held = 0

    def add(self, tokens: np.ndarray, sig: int, n: int, common: int) -> None:
        self.tokens.append(tokens)
        self.docs.append((sig, n << 32 | common))
        self.held += len(tokens)

    def rows(self) -> Iterator[tuple[int, bytes, bytes, bytes]]:
        if self.held:
            tokens = np.concatenate(self.tokens)
            doc = np.repeat(np.arange(len(self.docs)), [len(t) for t in self.tokens])
            docs = np.array(self.docs, np.int64)
            block = (tokens % np.uint64(self.blocks)).astype(np.int64)
            order = np.argsort(block, kind="stable")
            tokens, doc = tokens[order], doc[order]
            edges = np.searchsorted(block[order], np.arange(self.blocks + 1))
            for b in range(self.blocks):
                own = slice(edges[b], edges[b + 1])
                if edges[b] < edges[b + 1]:
                    named, slot = np.unique(doc[own], return_inverse=True)
                    yield b, tokens[own].tobytes(), slot.astype(np.int32).tobytes(), docs[named].tobytes()
        self.clear()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate((pa.int32(), pa.binary(), pa.binary(), pa.binary()))], names=["block", "tokens", "slot", "docs"])


def _split(s: np.ndarray, common: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The set's other n-grams, and the numbers of its common ones."""
    if not len(common) or not len(s):
        return s, np.zeros(0, np.int64)
    at = np.searchsorted(common, s)
    at[at == len(common)] = 0
    hit = common[at] == s
    return s[~hit], at[hit]


def prefix_postings(docs: DataFrame, common, k: int, blocks: int, num: int, den: int, most: int = 1_000_000) -> DataFrame:
    """Blocks of the prefixes' uncommon n-grams. In a block below 0 a row a document that has common ones: docs holds (sig,
    n and number of common ones), tokens the common ones, slot which of them are in its prefix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, seen = WordHashes(), _Blocks(blocks, most), set()
        for batch in batches:
            rows = []
            for s in _sets(batch.column(1), cache, k):
                n = len(s)
                name = signature(s) if n else None
                if name is None or name in seen:
                    continue
                if len(seen) < 1_000_000:  # copies met again are only work, so forgetting some is no loss
                    seen.add(name)
                light, heavy = _split(s, common.value)
                first = n - (-(-num * n // den)) + 1
                out.add(light[:first], name, n, len(heavy))
                if len(heavy):
                    rows.append((-1 - name % blocks, common.value[heavy].tobytes(), np.arange(max(0, first - len(light)), dtype=np.int32).tobytes(), np.array([name, n << 32 | len(heavy)], np.int64).tobytes()))
                if out.held >= most:
                    rows += out.rows()
            yield _batch(rows)
        yield _batch(list(out.rows()))

    return docs.mapInArrow(run, _BLOCK)


def full_postings(docs: DataFrame, common, k: int, blocks: int, most: int = 1_000_000) -> DataFrame:
    """Blocks of all uncommon n-grams; docs has id, text and sig, and only texts that have that name count."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, out, seen = WordHashes(), _Blocks(blocks, most), set()
        for batch in batches:
            rows = []
            for s, sig in zip(_sets(batch.column(1), cache, k), batch.column(2).to_pylist(), strict=True):
                if len(s) and sig not in seen and signature(s) == sig:
                    seen.add(sig)
                    light, heavy = _split(s, common.value)
                    out.add(light, sig, len(s), len(heavy))
                    if out.held >= most:
                        rows += out.rows()
            yield _batch(rows)
        yield _batch(list(out.rows()))

    return docs.mapInArrow(run, _BLOCK)


def _unpacked(docs: bytes) -> np.ndarray:
    """sig, n, common of each document of a block: n and common share a long."""
    d = np.frombuffer(docs, np.int64).reshape(-1, 2)
    return np.column_stack([d[:, 0], d[:, 1] >> 32, d[:, 1] & 0xFFFFFFFF])


_MEMBER = pa.struct([("sig", pa.int64()), ("n", pa.int32()), ("common", pa.int32())])


def rows_of_blocks(postings: DataFrame, longest: int) -> DataFrame:
    """Rows of the blocks' incidence: members (sig, n, common of each document) and weight (n-grams of the block that just
    these have). An n-gram that more than `longest` have is named by token instead, its members in chunks of that size.
    Of blocks below 0: a row a document, with its common n-grams, and those of its prefix (first)."""

    def run(table: pa.Table) -> pa.Table:
        found: list[tuple] = []  # token, members, weight, heavy, first
        columns = [table.column(c).to_pylist() for c in ("tokens", "slot", "docs")]
        if table.column("block")[0].as_py() < 0:
            seen = set()
            for t, slot, d in zip(*columns, strict=True):
                if d not in seen:
                    seen.add(d)
                    heavy = np.frombuffer(t, np.int64)
                    found.append((None, _unpacked(d), 0, heavy, heavy[np.frombuffer(slot, np.int32)]))
        else:
            token = np.concatenate([np.frombuffer(t, np.uint64) for t in columns[0]])
            doc = np.concatenate([_unpacked(d)[np.frombuffer(slot, np.int32)] for _, slot, d in zip(*columns, strict=True)])
            order = np.argsort(token)
            token, doc = token[order], doc[order]
            at = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
            size = np.diff(np.append(at, len(token)))
            alike: dict[bytes, int] = {}
            for a, n in zip(at[size > 1].tolist(), size[size > 1].tolist(), strict=True):
                own = doc[a : a + n]
                own = own[np.argsort(own[:, 0])]
                own = own[np.concatenate([[True], own[1:, 0] != own[:-1, 0]])]
                if len(own) > longest:
                    found += [(int(token[a].view(np.int64)), own[b : b + longest], 1, None, None) for b in range(0, len(own), longest)]
                elif len(own) > 1:
                    key = own.tobytes()
                    alike[key] = alike.get(key, 0) + 1
            found += [(None, np.frombuffer(key, np.int64).reshape(-1, 3), w, None, None) for key, w in alike.items()]
        flat = np.concatenate([r[1] for r in found]) if found else np.zeros((0, 3), np.int64)
        offsets = np.concatenate([[0], np.cumsum([len(r[1]) for r in found])]).astype(np.int32)
        members = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1].astype(np.int32)), pa.array(flat[:, 2].astype(np.int32))], fields=list(_MEMBER)))
        longs = pa.list_(pa.int64())
        return pa.table([pa.array([r[0] for r in found], pa.int64()), members, pa.array([r[2] for r in found], pa.int64()), pa.array([r[3] for r in found], longs), pa.array([r[4] for r in found], longs)], names=["token", "members", "weight", "heavy", "first"])

    return postings.groupBy("block").applyInArrow(run, "token long, members array<struct<sig:long,n:int,common:int>>, weight long, heavy array<long>, first array<long>")


def overlaps(rows: DataFrame, num: int, den: int) -> DataFrame:
    """a, b, na, nb, ca, cb, c: overlaps accumulated over rows of several members, pairs of unfit sizes left out."""
    alike = rows.groupBy(F.xxhash64("members").alias("h"), F.transform("members", lambda m: m["sig"]).alias("sigs")).agg(F.first("members").alias("members"), F.sum("weight").alias("weight"))
    schema = "a long, b long, na int, nb int, ca int, cb int, w long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        upper = {}
        for batch in batches:
            members, weight = batch.column(0), batch.column(1).to_numpy()
            offsets = members.offsets.to_numpy() - members.offsets[0].as_py()
            flat = members.flatten()
            sig, n, common = (flat.field(c).to_numpy() for c in range(3))
            parts, held = [], 0
            for r in range(len(members)):
                a, size = offsets[r], offsets[r + 1] - offsets[r]
                if size not in upper:
                    upper[size] = np.triu_indices(size, 1)
                i, j = upper[size][0] + a, upper[size][1] + a
                fit = den * np.minimum(n[i], n[j]).astype(np.int64) >= num * np.maximum(n[i], n[j]).astype(np.int64)
                i, j = i[fit], j[fit]
                parts.append((sig[i], sig[j], n[i], n[j], common[i], common[j], np.full(len(i), weight[r])))
                held += len(i)
                if held > 200_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["a", "b", "na", "nb", "ca", "cb", "w"])
                    parts, held = [], 0
            if parts:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*parts, strict=True)], names=["a", "b", "na", "nb", "ca", "cb", "w"])

    made = alike.select("members", "weight").mapInArrow(run, schema)
    return made.groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.sum("w").alias("c"))


def _least(num: int, den: int):
    return F.ceil((F.lit(num) * (F.col("na") + F.col("nb"))) / F.lit(num + den))


def _full(n: str, common: str, num: int, den: int):
    """Whether a document's prefix holds all its uncommon n-grams, and common ones too."""
    return F.col(common) >= F.ceil(num * F.col(n) / den)


def _reach(num: int, den: int, c, both_common, both_long):
    """The most that two sets can overlap whose prefixes share c uncommon n-grams (and at most both_long of those with many
    documents). Both full: nothing is left but common ones. Else: what lies behind the prefix of the larger."""
    behind = F.greatest(F.ceil(num * F.col("na") / den), F.ceil(num * F.col("nb") / den)) - 1
    return c + both_long + F.when(_full("na", "ca", num, den) & _full("nb", "cb", num, den), both_common).otherwise(behind)


def with_long(pairs: DataFrame, counts: DataFrame | None) -> DataFrame:
    """pairs with la and lb: how many n-grams of many documents each side has in its prefix."""
    if counts is None:
        return pairs.withColumns({"la": F.lit(0), "lb": F.lit(0)})
    for x in "ab":
        pairs = pairs.join(counts.select(F.col("sig").alias(x), F.col("long").alias(f"l{x}")), x, "left").fillna(0, [f"l{x}"])
    return pairs


def decided(pairs: DataFrame, extra: DataFrame, any_long: bool, num: int, den: int) -> DataFrame:
    """Linked ones among pairs with their overlap c; the sets of further n-grams (extra) are compared where they decide."""
    need = _least(num, den)
    sure = pairs.where(F.col("c") >= need).select("a", "b")
    left = pairs.where(F.col("c") < need) if any_long else pairs.where((F.col("c") < need) & (F.col("c") + F.least("ca", "cb") >= need))
    met = left.join(extra.select(F.col("sig").alias("a"), F.col("extra").alias("ea")), "a").join(extra.select(F.col("sig").alias("b"), F.col("extra").alias("eb")), "b")
    return sure.union(met.where(F.col("c") + F.size(F.array_intersect("ea", "eb")) >= need).select("a", "b"))


def sets_of(docs: DataFrame, k: int) -> DataFrame:
    """sig, tokens of docs (id, text, sig) whose text has that name."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            got = {sig: s.view(np.int64) for s, sig in zip(_sets(batch.column(1), cache, k), batch.column(2).to_pylist(), strict=True) if len(s) and signature(s) == sig}
            yield pa.RecordBatch.from_arrays([pa.array(list(got), pa.int64()), pa.array(list(got.values()), pa.list_(pa.int64()))], names=["sig", "tokens"])

    return docs.mapInArrow(run, "sig long, tokens array<long>")


def _texts(rows: DataFrame, groups: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The names' classes (sig, id of a document, n), and those documents' texts with sig."""
    chosen = saved(names.distinct().join(groups, "sig").select("sig", F.col("rep").alias("id"), "n"), "chosen")
    side = chosen.select("id", "sig")
    if chosen.count() <= 300_000:  # 16 bytes a row, so 5 MB at most; beyond that a shuffled join
        side = F.broadcast(side)
    return chosen, rows.join(side, "id").select("id", "text", "sig")


def verified(pairs: DataFrame, rows: DataFrame, groups: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """Linked ones among pairs (a, b, na, nb), by their whole sets."""
    _, texts = _texts(rows, groups, pairs.select(F.col("a").alias("sig")).union(pairs.select(F.col("b").alias("sig"))))
    sets = saved(sets_of(texts, k).dropDuplicates(["sig"]), "sets")
    met = pairs.join(sets.select(F.col("sig").alias("b"), F.col("tokens").alias("tb")), "b").join(sets.select(F.col("sig").alias("a"), F.col("tokens").alias("ta")), "a")
    return met.where(F.size(F.array_intersect("ta", "tb")) >= _least(num, den)).select("a", "b")


def classes(docs: DataFrame, k: int = 5, num: int = NUM, den: int = DEN, id_col: str = "doc_id", text_col: str = "text", longest: int = 128, most_common: int = 1 << 18, postings_a_block: int = 500_000) -> DataFrame:
    """One row a document: id, n_shingles, component_id (the least id reachable by links, itself included).

    Null and empty texts and texts without a word have no shingles and are linked with nothing; with fewer words than k the
    whole sequence is one shingle. Equal sets are one class from the start. Repeated ids are documents of their own that
    share the number; a null id never becomes a component's number unless it is alone. Other columns are not read; an empty
    table gives an empty one. N-grams are compared by 64-bit hashes.

    `longest` and `most_common` steer the work and not the result: n-grams that more than `longest` documents have in their
    prefixes, and the at most `most_common` n-grams found frequent in batches, make no pairs among all their documents.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("id"), docs[text_col].cast("string").alias("text"))
    first = saved(profile(rows, k, 0.0, 4), "profile")
    own = first.where("kind = 0").select("id", "n", "sig")
    groups = saved(own.where("sig is not null").groupBy("sig").agg(F.min("id").alias("rep"), F.max("n").alias("n")), "groups")
    often = saved(first.where("kind = 1").groupBy("sig").agg(F.sum("n").alias("n")).where(F.col("n") > longest // 2), "often")
    sizes = {r["b"]: r["n"] for r in often.groupBy(F.floor(F.log2("n") * 4).alias("b")).agg(F.count("*").alias("n")).collect()}  # a few hundred rows: counts by quarters of powers of two
    floor, taken = max(sizes, default=0) + 1, 0
    for b in sorted(sizes, reverse=True):
        if (taken := taken + sizes[b]) > most_common:
            break
        floor = b
    often = often.where(F.floor(F.log2("n") * 4) >= floor)
    common = spark.sparkContext.broadcast(np.sort(np.array([r["sig"] for r in often.select("sig").collect()], np.int64).view(np.uint64)))
    total = groups.agg(F.sum("n")).first()[0] or 0
    per = lambda postings: int(max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), postings // postings_a_block + 1))

    # 1. the prefixes
    blocks = per(total * (den - num) // den)
    parts = saved(rows_of_blocks(prefix_postings(rows, common, k, blocks, num, den), longest), "prefix-rows")
    with_common = parts.where("heavy is not null").select(F.col("members")[0]["sig"].alias("sig"), F.col("members")[0]["n"].alias("n"), F.col("members")[0]["common"].alias("common"), "heavy", "first")
    many = parts.where("token is not null").select(F.explode("members").alias("m"), "token").select("m.sig", "m.n", "m.common", "token")
    any_many = not many.isEmpty()
    counts = saved(many.groupBy("sig").agg(F.count("*").cast("int").alias("long")), "long-counts") if any_many else None
    shared = with_long(overlaps(parts.where("token is null and heavy is null"), num, den), counts)
    reach = _reach(num, den, F.col("c"), F.least("ca", "cb"), F.least("la", "lb"))
    possible = saved(shared.where(reach >= _least(num, den)).select("a", "b", "na", "nb", "ca", "cb"), "possible")

    # 2. the whole sets of documents in such pairs
    chosen, texts = _texts(rows, groups, possible.select(F.col("a").alias("sig")).union(possible.select(F.col("b").alias("sig"))))
    blocks = per(chosen.agg(F.sum("n")).first()[0] or 0)
    whole = saved(rows_of_blocks(full_postings(texts, common, k, blocks), longest), "whole-rows")
    counted = overlaps(whole.where("token is null"), num, den).withColumn("wanted", F.lit(0))
    wanted = possible.select("a", "b", "na", "nb", "ca", "cb", F.lit(0).cast("long").alias("c"), F.lit(1).alias("wanted"))
    exact = counted.union(wanted).groupBy("a", "b", "na", "nb", "ca", "cb").agg(F.sum("c").alias("c"), F.max("wanted").alias("wanted")).where("wanted = 1")
    more = whole.where("token is not null").select(F.explode("members").alias("m"), "token").select("m.sig", "token")
    extra = with_common.select("sig", F.col("heavy").alias("extra"))
    if any_long := not more.isEmpty():
        extra = extra.select("sig", F.explode("extra").alias("token")).union(more).groupBy("sig").agg(F.collect_set("token").alias("extra"))
    links = saved(decided(exact, extra, any_long, num, den), "links")

    # 3. n-grams that many documents have: a star around the document with fewest others, then what is left across groups
    posted = with_common.select("sig", "n", "common", F.explode("first").alias("token"))
    if any_many:
        posted = posted.union(many)
    posted = saved(posted, "posted")
    if not posted.isEmpty():
        hub = posted.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("common")).alias("rest"), F.col("sig").alias("b"), F.col("n").alias("nb"))).alias("hub"))
        star = saved(posted.join(hub, "token").select(F.col("sig").alias("a"), "hub.b", F.col("n").alias("na"), "hub.nb").where("a != b").distinct(), "star")
        links = saved(links.union(verified(star, rows, groups, k, num, den)), "links")
        placed = posted.join(components(links).withColumnRenamed("node", "sig"), "sig", "left").withColumn("g", F.coalesce("component", "sig")).drop("component")
        placed = saved(placed, "placed")
        split = placed.groupBy("token").agg(F.min("g").alias("lo"), F.max("g").alias("hi")).where("lo < hi").select("token")
        size = placed.groupBy("sig").agg(F.count("*").alias("p"))
        left = placed.join(split, "token").join(size, "sig")
        left = with_long(left.withColumnRenamed("sig", "a").withColumn("b", F.col("a")), counts).withColumnRenamed("a", "sig").withColumnRenamed("la", "l")
        left = saved(left.select("token", "sig", "n", "common", "g", "p", "l").where(F.col("common") + F.col("l") > 0), "across")
        x, y = (left.select("token", *[F.col(c).alias(c2) for c, c2 in (("sig", s), ("n", f"n{s}"), ("common", f"c{s}"), ("g", f"g{s}"), ("l", f"l{s}"), ("p", f"p{s}"))]) for s in "ab")
        full = _full("na", "ca", num, den) & _full("nb", "cb", num, den)
        most = F.when(full, F.least(F.col("ca") + F.col("la"), F.col("cb") + F.col("lb"))).otherwise(_reach(num, den, F.least("pa", "pb"), F.lit(0), F.lit(0)))
        rest = x.join(y, "token").where((F.col("a") < F.col("b")) & (F.col("ga") != F.col("gb")) & (den * F.least("na", "nb") >= num * F.greatest("na", "nb")) & (most >= _least(num, den)))
        rest = saved(rest.select("a", "b", "na", "nb").distinct(), "rest")
        if not rest.isEmpty():
            links = saved(links.union(verified(rest, rows, groups, k, num, den)), "links")
    named = saved(groups.join(components(links).withColumnRenamed("node", "sig"), "sig", "left").select("sig", "rep", F.coalesce("component", "sig").alias("g")), "named")
    least = named.groupBy("g").agg(F.min("rep").alias("component_id"))
    of_sig = saved(named.join(least, "g").select("sig", "component_id"), "of-sig")
    out = own.where("sig is not null").join(of_sig, "sig").select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")
    return out.union(own.where("sig is null").select("id", "n", F.col("id").alias("component_id")))

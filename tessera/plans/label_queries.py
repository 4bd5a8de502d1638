"""Queries over sparse labels, splits, samples, collation and packing, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.operators import collate, graphs, labels, packed, splits
from tessera.plans.graph_queries import EDGES, NODES
from tessera.plans.registry import query

TASKS = """t AS (SELECT md5(text) AS mol_id, doc_id AS row_ord, quality, toxic FROM documents JOIN labels USING (doc_id))"""


def _read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _tasks(spark: SparkSession, d: str) -> dict[str, DataFrame]:
    both = _read(spark, d, "documents").join(_read(spark, d, "labels"), "doc_id").select(F.md5("text").alias("mol_id"), F.col("doc_id").alias("row_ord"), "quality", "toxic")
    return {"quality": both.where("row_ord % 3 <> 0").select("mol_id", "row_ord", F.col("quality").alias("label")), "toxic": both.where("row_ord % 3 <> 1").select("mol_id", "row_ord", F.col("toxic").alias("label"))}


@query(f"""WITH {TASKS}, u AS (SELECT mol_id, row_ord, 'q' AS k, quality AS v FROM t WHERE row_ord % 3 <> 0 UNION ALL SELECT mol_id, row_ord, 't', toxic FROM t WHERE row_ord % 3 <> 1)
    SELECT mol_id, CAST(arg_max(v, row_ord) FILTER (k = 'q') AS DOUBLE) AS quality, CAST(arg_max(v, row_ord) FILTER (k = 't') AS DOUBLE) AS toxic, count(*) AS n_rows FROM u GROUP BY mol_id""")
def multitask_outer_merge(spark, d):
    return labels.merge_tasks(_tasks(spark, d))


@query("SELECT doc_id, md5(text) AS mol_id, first_value(length(text)) OVER (PARTITION BY md5(text) ORDER BY doc_id) AS size FROM documents")
def dedup_join_back(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("mol_id"), "text")
    return labels.once_then_back(rows.select("doc_id", "mol_id"), "mol_id", lambda first: first.join(rows.select("doc_id", "text"), "doc_id").select("mol_id", F.length("text").cast("long").alias("size")), "doc_id").select("doc_id", "mol_id", "size")


@query("SELECT source, arg_max(doc_id, n_chars * 1000000 + doc_id) AS doc_id FROM documents GROUP BY source")
def last_wins_merge(spark, d):
    return labels.keep(_read(spark, d, "documents").select("source", "doc_id", "n_chars"), ["source"], [F.desc("n_chars"), F.desc("doc_id")]).select("source", "doc_id")


@query("SELECT doc_id, n_chars FROM documents WHERE n_chars >= 200 AND n_chars <= 5000")
def failed_row_filter(spark, d):
    rows = _read(spark, d, "documents").select("doc_id", "n_chars").withColumn("error", F.when(F.col("n_chars") < 200, "too short").when(F.col("n_chars") > 5000, "too long"))
    return rows.where("error is null").select("doc_id", "n_chars")


@query("SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey HAVING count(*) = 1 + l_orderkey % 4 OR l_orderkey % 11 = 0")
def size_mismatch_filter(spark, d):
    """Orders whose label array (one entry more than the key mod 4; a missing entry in every eleventh) fits their items."""
    g = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    filled = F.transform(F.sequence(F.lit(0).cast("long"), F.col("l_orderkey") % 4), lambda i: F.when((i == 0) & (F.col("l_orderkey") % 11 == 0), None).otherwise(i.cast("double")))
    return g.where(labels.fits(filled, F.col("n"))).select("l_orderkey", "n")


@query("SELECT conv_id, list_extract(list(CAST(length(text) AS DOUBLE) ORDER BY turn), 1) AS a, list_extract(list(CAST(length(text) AS DOUBLE) ORDER BY turn), 2) AS b, list_extract(list(CAST(length(text) AS DOUBLE) ORDER BY turn), 3) AS c FROM conversations GROUP BY conv_id")
def label_extract_pad(spark, d):
    turns = F.array_sort(F.collect_list(F.struct("turn", F.length("text").cast("double").alias("n"))))
    cells = _read(spark, d, "conversations").groupBy("conv_id").agg(labels.padded(F.transform(turns, lambda x: x["n"]), 3).alias("v"))
    return cells.select("conv_id", *[F.col("v")[k].alias(c) for k, c in enumerate("abc")])


@query("SELECT min(o_totalprice) AS o_totalprice_min, max(o_totalprice) AS o_totalprice_max, round(avg(o_totalprice), 4) AS o_totalprice_mean, round(stddev_pop(o_totalprice), 4) AS o_totalprice_std, count(o_totalprice) AS o_totalprice_n FROM orders")
def label_stats(spark, d):
    return labels.label_statistics(_read(spark, d, "orders"), ["o_totalprice"]).withColumns({c: F.round(c, 4) for c in ("o_totalprice_mean", "o_totalprice_std")})


def _with_stats(spark, d):
    o = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"))
    s = o.agg(F.min("x").alias("min"), F.max("x").alias("max"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return o.crossJoin(F.broadcast(s)), {c: F.col(c) for c in ("min", "max", "mean", "std")}  # one row


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders) SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS z FROM orders, s")
def normalize_zscore(spark, d):
    rows, s = _with_stats(spark, d)
    return rows.select("o_orderkey", F.round(labels.normalised(F.col("x"), s, "normal"), 6).alias("z"))


@query("WITH s AS (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders WHERE o_orderkey % 10 < 8) SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split, round((o_totalprice - m) / s, 6) AS z FROM orders, s")
def normalize_by_train(spark, d):
    """The train split's statistics scale all splits."""
    k = F.col("o_orderkey") % 10
    o = _read(spark, d, "orders").select("o_orderkey", F.col("o_totalprice").alias("x"), F.when(k < 8, "train").when(k == 8, "val").otherwise("test").alias("split"))
    out = labels.normalised_by(o, "x", "normal", F.col("split") == "train")
    return out.select("o_orderkey", "split", F.round("x", 6).alias("z"))


@query("SELECT o_orderkey, round((least(greatest(o_totalprice, 1000.0::DOUBLE), 200000.0::DOUBLE) - 1000.0::DOUBLE) / 199000.0::DOUBLE, 6) AS u FROM orders")
def normalize_unit_clip(spark, d):
    rows, s = _with_stats(spark, d)
    return rows.select("o_orderkey", F.round(labels.normalised(F.col("x"), s, "unit", 1000.0, 200000.0), 6).alias("u"))


@query("SELECT o_orderkey, round(o_totalprice, 2) AS x FROM orders")
def denormalize(spark, d):
    rows, s = _with_stats(spark, d)
    return rows.select("o_orderkey", F.round(labels.denormalised(labels.normalised(F.col("x"), s, "normal"), s, "normal"), 2).alias("x"))


@query("WITH p AS (SELECT avg(toxic) AS p FROM labels) SELECT doc_id, round(CASE toxic WHEN 0 THEN p ELSE 1 / p END / greatest(p, 1 / p), 6) AS weight FROM labels, p")
def class_weights(spark, d):
    return labels.balance_weights(_read(spark, d, "labels"), "toxic").select("doc_id", F.round("weight", 6).alias("weight"))


@query("SELECT p_partkey, CASE WHEN z > 6 THEN 4 WHEN z > 3 THEN 3 WHEN z > -3 THEN 2 WHEN z > -6 THEN 1 ELSE 0 END AS class FROM (SELECT p_partkey, p_size - 25 AS z FROM part)")
def bucketize(spark, d):
    return _read(spark, d, "part").select("p_partkey", labels.bucket(F.col("p_size") - 25, [-6, -3, 3, 6]).alias("class"))


@query("SELECT o_orderkey, CAST(o_orderstatus = 'F' AS INTEGER) AS is_f, CAST(o_orderstatus = 'O' AS INTEGER) AS is_o, CAST(o_orderstatus NOT IN ('F', 'O') AS INTEGER) AS other FROM orders")
def onehot_bucket(spark, d):
    v = labels.one_of_k(F.col("o_orderstatus"), ["F", "O"])
    return _read(spark, d, "orders").select("o_orderkey", *[F.get(v, F.lit(k)).alias(n) for k, n in enumerate(("is_f", "is_o", "other"))])


_H = lambda seed, key: f"md5('{seed}|' || {key})"


@query(f"SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY {_H(42, 'doc_id')}, doc_id) AS r FROM documents) WHERE r <= 100")
def sub_sample_n(spark, d):
    return splits.sub_sample(_read(spark, d, "documents").select("doc_id"), 100, "doc_id")


_SPLIT = "CASE WHEN r < floor(n * 0.2::DOUBLE) THEN 'val' WHEN r < floor(n * 0.2::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'test' ELSE 'train' END"


@query(f"SELECT doc_id, {_SPLIT} AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY {_H(42, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER () AS n FROM documents)")
def split_random(spark, d):
    return splits.random_split(_read(spark, d, "documents").select("doc_id"), "doc_id", 0.2, 0.1)


@query(f"""WITH seen AS (SELECT DISTINCT lang, md5(text) AS k FROM documents WHERE doc_id % 4 = 0), r AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 4 <> 0), u AS (SELECT k FROM r WHERE k NOT IN (SELECT k FROM seen))
    SELECT k, {_SPLIT} AS split FROM (SELECT k, row_number() OVER (ORDER BY {_H(42, 'k')}, k) - 1 AS r, count(*) OVER () AS n FROM u) UNION ALL SELECT k, 'test_seen' FROM r WHERE k IN (SELECT k FROM seen)""")
def split_test_seen(spark, d):
    docs = _read(spark, d, "documents").select("doc_id", F.md5("text").alias("k"))
    return splits.split_unseen(docs.where("doc_id % 4 <> 0").select("k").distinct(), docs.where("doc_id % 4 = 0"), "k", 0.2, 0.1)


@query(f"""WITH seen AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 4 = 0), r AS (SELECT DISTINCT md5(text) AS k FROM documents WHERE doc_id % 4 <> 0), u AS (SELECT k FROM r WHERE k NOT IN (SELECT k FROM seen WHERE k IS NOT NULL) OR k IS NULL)
    SELECT k, {_SPLIT} AS split FROM (SELECT k, row_number() OVER (ORDER BY {_H(42, 'k')}, k) - 1 AS r, count(*) OVER () AS n FROM u) UNION ALL SELECT k, 'train' FROM r WHERE k IN (SELECT k FROM seen)""")
def split_overlap_to_train(spark, d):
    docs = _read(spark, d, "documents").where("text is not null").select("doc_id", F.md5("text").alias("k"))
    return splits.split_overlap_to_train(docs.where("doc_id % 4 <> 0").select("k").distinct(), docs.where("doc_id % 4 = 0"), "k", 0.2, 0.1)


@query(f"WITH {NODES}, g AS (SELECT DISTINCT graph_id FROM nodes), s AS (SELECT graph_id, slot FROM g, (SELECT unnest(range(20)) AS slot)) SELECT s.graph_id, CAST(s.slot AS INTEGER) AS slot, coalesce(n.q, -1.0) AS q, coalesce(n.d, -1.0) AS d, n.node_id IS NOT NULL AS mask FROM s LEFT JOIN nodes n ON n.graph_id = s.graph_id AND n.node_id = s.slot")
def dense_batch(spark, d):
    """Twenty slots a graph, filled with -1 where it has fewer nodes."""
    return collate.to_dense(graphs.order_nodes(_read(spark, d, "lineitem")), ["q", "d"], 20, -1.0)


@query(f"WITH {NODES} SELECT graph_id, CAST(node_id AS INTEGER) AS node_id, q, d FROM nodes")
def dense_to_sparse(spark, d):
    return collate.from_dense(dense_batch(spark, d), ["q", "d"])


@query("SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM documents")
def split_file(spark, d):
    docs = _read(spark, d, "documents").select("doc_id")
    one = lambda m: F.when(F.col("doc_id") % 3 == m, F.col("doc_id").cast("double")).otherwise(F.lit(float("nan")))
    return splits.file_split(docs, docs.select(one(0).alias("train"), one(1).alias("val"), one(2).alias("test")), "doc_id")


@query(f"SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_H(3, 'doc_id')}, doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM documents) WHERE r < floor(n * CASE source WHEN 'src0' THEN 0.5::DOUBLE WHEN 'src1' THEN 0.25::DOUBLE ELSE 1.0::DOUBLE END)")
def task_subsample(spark, d):
    return splits.task_sample(_read(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", {"src0": 0.5, "src1": 0.25}, epoch=3)


@query("SELECT l_partkey, round(avg(l_quantity), 4) AS mean_quantity, arg_min(l_returnflag, (l_orderkey * 100 + l_linenumber) * 100000 + l_suppkey) AS first_flag FROM lineitem GROUP BY l_partkey")
def assay_mean_first(spark, d):
    return _read(spark, d, "lineitem").groupBy("l_partkey").agg(F.round(F.avg("l_quantity"), 4).alias("mean_quantity"), F.min_by("l_returnflag", F.struct("l_orderkey", "l_linenumber", "l_suppkey")).alias("first_flag"))


@query("SELECT l_partkey, count(*) AS n FROM lineitem GROUP BY l_partkey ORDER BY n DESC, l_partkey LIMIT 20")
def topk_value_counts(spark, d):
    return _read(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l_partkey").limit(20)


_ROW_STD = "sqrt((pow(l_quantity - m, 2) + pow(l_discount * 100 - m, 2) + pow(l_tax * 100 - m, 2)) / 3)"


@query(f"SELECT l_suppkey, l_partkey, std FROM (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY std DESC, l_partkey, l_orderkey, l_linenumber) AS r FROM (SELECT *, round({_ROW_STD}, 6) AS std FROM (SELECT *, (l_quantity + l_discount * 100 + l_tax * 100) / 3 AS m FROM lineitem))) WHERE r = 1")
def keep_highest_std(spark, d):
    x = F.array("l_quantity", F.col("l_discount") * 100, F.col("l_tax") * 100)
    rows = _read(spark, d, "lineitem").withColumn("x", x).withColumn("m", F.aggregate("x", F.lit(0.0), lambda a, v: a + v) / 3)
    rows = rows.withColumn("std", F.round(F.sqrt(F.aggregate("x", F.lit(0.0), lambda a, v: a + (v - F.col("m")) * (v - F.col("m"))) / 3), 6))
    return labels.keep(rows.select("l_suppkey", "l_partkey", "l_orderkey", "l_linenumber", "std"), ["l_suppkey"], [F.desc("std"), F.col("l_partkey"), F.col("l_orderkey"), F.col("l_linenumber")]).select("l_suppkey", "l_partkey", "std")


@query("SELECT l_returnflag, round(corr(l_quantity, l_extendedprice), 5) AS quantity_price, round(corr(l_quantity, l_discount), 5) AS quantity_discount, round(corr(l_discount, l_tax), 5) AS discount_tax FROM lineitem GROUP BY l_returnflag")
def corr_matrix(spark, d):
    c = lambda a, b: F.round(F.corr(f"l_{a}" if a != "price" else "l_extendedprice", f"l_{b}" if b != "price" else "l_extendedprice"), 5).alias(f"{a}_{b}")
    return _read(spark, d, "lineitem").groupBy("l_returnflag").agg(c("quantity", "price"), c("quantity", "discount"), c("discount", "tax"))


@query("SELECT l_orderkey, n, rn, CAST(sum(n) OVER (PARTITION BY rn // 64 ORDER BY rn ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS node_offset FROM (SELECT l_orderkey, count(*) AS n, row_number() OVER (ORDER BY l_orderkey) - 1 AS rn FROM lineitem GROUP BY l_orderkey)")
def collate_offsets(spark, d):
    sizes = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return collate.batched(sizes, "l_orderkey", 64, "n").select("l_orderkey", "n", "rn", "node_offset")


@query("SELECT doc_id, t.task, CASE t.task WHEN 'quality' THEN CAST(quality AS DOUBLE) ELSE CAST(toxic AS DOUBLE) END AS label FROM documents LEFT JOIN labels USING (doc_id), (VALUES ('quality'), ('toxic')) t(task)")
def collate_missing_labels(spark, d):
    l = _read(spark, d, "labels")
    long = l.select("doc_id", F.explode(F.array(*[F.struct(F.lit(t).alias("task"), F.col(t).cast("double").alias("label")) for t in ("quality", "toxic")])).alias("x")).select("doc_id", "x.*")
    return collate.fill_slots(_read(spark, d, "documents").select("doc_id"), long, "doc_id", ["quality", "toxic"])


@query(f"WITH {NODES}, g AS (SELECT graph_id, row_number() OVER (ORDER BY graph_id) - 1 AS batch FROM (SELECT DISTINCT graph_id FROM nodes)) SELECT graph_id, node_id, batch * 20 + node_id AS idx FROM nodes JOIN g USING (graph_id)")
def dense_index(spark, d):
    return collate.dense_index(graphs.order_nodes(_read(spark, d, "lineitem")), 20)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY n, l_orderkey) - 1 AS rn, count(*) OVER () AS total FROM s), k AS (SELECT *, rn // 500 AS stratum FROM r)
    SELECT l_orderkey, n, stratum, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || l_orderkey), l_orderkey) - 1 AS pack_id FROM k""")
def pack_fast(spark, d):
    sizes = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return collate.pack_fast(sizes, "l_orderkey", "n", 500, 7)


@query("""WITH s AS (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY n, l_orderkey) - 1 AS rn FROM s), k AS (SELECT *, rn // 500 AS stratum FROM r),
    p AS (SELECT *, row_number() OVER (PARTITION BY stratum ORDER BY md5('7|' || l_orderkey), l_orderkey) - 1 AS pack_id FROM k) SELECT pack_id, CAST(sum(n) AS BIGINT) AS n_nodes, count(*) AS n_graphs FROM p GROUP BY pack_id""")
def pack_sizes(spark, d):
    sizes = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return collate.pack_fast(sizes, "l_orderkey", "n", 500, 7).groupBy("pack_id").agg(F.sum("n").alias("n_nodes"), F.count("*").alias("n_graphs"))


# packs of about 64 graphs, dealt as pack_fast does, and where each graph of a pack begins
_PACKS = """s AS (SELECT l_orderkey AS graph_id, count(*) AS n FROM lineitem GROUP BY l_orderkey), r AS (SELECT *, row_number() OVER (ORDER BY n, graph_id) - 1 AS rn, (count(*) OVER () + 63) // 64 AS packs FROM s),
    p AS (SELECT graph_id, n, row_number() OVER (PARTITION BY rn // packs ORDER BY md5('7|' || graph_id), graph_id) - 1 AS pack_id FROM r), st AS (SELECT *, CAST(sum(n) OVER (PARTITION BY pack_id ORDER BY graph_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - n AS start FROM p),
    big AS (SELECT CAST((max(total) + 32) // 32 * 32 AS BIGINT) AS size FROM (SELECT sum(n) AS total FROM p GROUP BY pack_id))"""


def _real_packs(spark, d) -> DataFrame:
    """graph_id, n, pack_id of order graphs: strata by size dealt over as many packs as hold 64 graphs each."""
    sizes = _read(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("graph_id")).agg(F.count("*").alias("n"))
    return collate.pack_fast(sizes, "graph_id", "n", max(1, -(-sizes.count() // 64)), 7).select("graph_id", "n", "pack_id")


def _room(packs: DataFrame) -> int:
    """A size that holds every pack and at least one node of padding: the next multiple of 32."""
    return packed.largest(packs) // 32 * 32 + 32


@query(f"WITH {NODES}, {_PACKS} SELECT graph_id, node_id, pack_id, start + node_id AS place FROM nodes JOIN st USING (graph_id)")
def node_to_pack(spark, d):
    """Pack and place of each node: its number after the sizes of the pack's graphs before."""
    return packed.index(graphs.order_nodes(_read(spark, d, "lineitem")).select("graph_id", "node_id"), _real_packs(spark, d))


@query(f"WITH {_PACKS} SELECT pack_id, CAST(sum(n) AS BIGINT) AS n_nodes, CAST(any_value(size) - sum(n) AS BIGINT) AS n_fill FROM p, big GROUP BY pack_id")
def pad_fixed(spark, d):
    """Nodes that each pack lacks to the size of all."""
    packs = _real_packs(spark, d)
    rows = packed.index(graphs.order_nodes(_read(spark, d, "lineitem")).select("graph_id", "node_id"), packs)
    return collate.filler(rows, "pack_id", _room(packs))


@query(f"""WITH {NODES}, {_PACKS}, placed AS (SELECT pack_id, start + node_id AS slot, graph_id, q, p FROM nodes JOIN st USING (graph_id)), every AS (SELECT DISTINCT pack_id, unnest(range(size)) AS slot FROM p, big)
    SELECT e.pack_id, CAST(e.slot AS INTEGER) AS slot, coalesce(a.graph_id, -1) AS graph_id, CASE WHEN a.graph_id IS NULL THEN -1.0 ELSE a.q END AS q, CASE WHEN a.graph_id IS NULL THEN -1.0 ELSE a.p END AS p, a.graph_id IS NOT NULL AS mask FROM every e LEFT JOIN placed a ON a.pack_id = e.pack_id AND a.slot = e.slot""")
def packed_dense(spark, d):
    """Every slot of every pack, -1 where no node is."""
    packs = _real_packs(spark, d)
    placed = packed.index(graphs.order_nodes(_read(spark, d, "lineitem")).select("graph_id", "node_id", "q", "p"), packs)
    return packed.to_packed(placed, ["q", "p"], _room(packs), -1.0).drop("node_id").withColumn("graph_id", F.coalesce("graph_id", F.lit(-1)))


@query(f"WITH {_PACKS} SELECT pack_id, start + unnest(range(n)) AS place, size - n AS masked, start AS first_seen FROM st, big")
def packed_attention_rows(spark, d):
    """The mask's row of each node, told by how many places it hides and which it shows first."""
    packs = _real_packs(spark, d)
    rows = packed.attention_rows(packs, _room(packs))
    return rows.select("pack_id", "place", F.size(F.array_remove("masked", False)).cast("long").alias("masked"), (F.array_position("masked", False) - 1).cast("long").alias("first_seen"))


_ROOM = "graphs_ AS (SELECT max(c) + 1 AS most FROM (SELECT count(*) AS c FROM p GROUP BY pack_id)), edges_ AS (SELECT 2 * max(c) + 8 AS most FROM (SELECT sum(n - 1) AS c FROM p GROUP BY pack_id))"


@query(f"""WITH {EDGES}, {_PACKS}, {_ROOM}, e AS (SELECT pack_id, count(*) AS real, sum((start + src) * 3 + start + dst) AS mark FROM edges JOIN st USING (graph_id) GROUP BY pack_id), g AS (SELECT pack_id, count(*) AS graphs, sum(n) AS total FROM p GROUP BY pack_id),
      q AS (SELECT pack_id, sum(q * (start + node_id)) AS weighed FROM nodes JOIN st USING (graph_id) GROUP BY pack_id), l AS (SELECT pack_id, sum(o_totalprice) AS price FROM p JOIN orders ON o_orderkey = graph_id GROUP BY pack_id)
    SELECT g.pack_id, CAST(size AS BIGINT) AS slots, CAST(total AS BIGINT) AS nodes, CAST(edges_.most AS BIGINT) AS edge_slots, coalesce(real, 0) AS edges, CAST(coalesce(mark, 0) + (edges_.most - coalesce(real, 0)) * 4 * (size - 1) AS BIGINT) AS edge_mark, CAST(graphs_.most AS BIGINT) AS graph_slots, graphs, CAST(size AS BIGINT) AS graph_nodes, round(weighed, 3) AS weighed, round(price, 2) AS price
    FROM g LEFT JOIN e USING (pack_id) JOIN q USING (pack_id) JOIN l USING (pack_id), big, graphs_, edges_""")
def combined_batch(spark, d):
    """Packing, collation and padding of orders, each pack told by sums over its nodes, edges and graphs, padding included."""
    prices = _read(spark, d, "orders").select(F.col("o_orderkey").alias("graph_id"), F.col("o_totalprice").alias("price"))
    packs = _real_packs(spark, d)
    nodes = graphs.order_nodes(_read(spark, d, "lineitem"))
    most = packs.groupBy("pack_id").agg(F.count("*").alias("c"), F.sum(F.col("n") - 1).alias("e")).agg(F.max("c"), F.max("e")).first()
    size = _room(packs)
    b = packed.combined(nodes, graphs.path_edges(nodes), packs.join(prices, "graph_id"), ["q"], size, 2 * (most[1] or 0) + 8, (most[0] or 0) + 1, ["price"])
    n = b.nodes.groupBy("pack_id").agg(F.count("*").alias("slots"), F.count_if("node_is_true").alias("nodes"), F.round(F.sum(F.when(F.col("node_is_true"), F.col("q") * F.col("place"))), 3).alias("weighed"))
    e = b.edges.groupBy("pack_id").agg(F.count("*").alias("edge_slots"), F.count_if("edge_is_true").alias("edges"), F.sum(F.col("src") * 3 + F.col("dst")).alias("edge_mark"))
    g = b.graphs.groupBy("pack_id").agg(F.count("*").alias("graph_slots"), F.count_if("graph_is_true").alias("graphs"), F.sum("n").alias("graph_nodes"), F.round(F.sum("price"), 2).alias("price"))
    return n.join(e, "pack_id").join(g, "pack_id")


@query("""WITH s AS (SELECT l_orderkey AS key, count(*) AS n FROM lineitem GROUP BY l_orderkey), t AS (SELECT key, n, unnest(range(4)) AS trial FROM s), u AS (SELECT *, md5('5|' || trial || '|' || key) AS turn FROM t),
    r AS (SELECT *, (row_number() OVER (PARTITION BY trial ORDER BY turn, key) - 1) // 256 AS lot FROM u), f AS (SELECT *, count(*) OVER (PARTITION BY trial, lot) AS held FROM r), k AS (SELECT *, (row_number() OVER (PARTITION BY trial, lot ORDER BY n, key) - 1) // 16 AS stratum FROM f WHERE held = 256),
    p AS (SELECT *, row_number() OVER (PARTITION BY trial, lot, stratum ORDER BY md5('5|' || turn), key) AS pack FROM k), z AS (SELECT trial, lot, sum(n) AS total FROM p GROUP BY trial, lot, pack)
    SELECT CAST(trial AS INTEGER) AS trial, count(DISTINCT lot) AS n_batches, CAST(max(total) AS BIGINT) AS largest FROM z GROUP BY trial""")
def largest_pack(spark, d):
    """Four shuffles of all orders in combined batches of 256, each packed into 16 packs."""
    sizes = _read(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n"))
    return packed.estimate_largest(sizes, "l_orderkey", "n", 16, 256, 4, 5)


@query("""WITH p AS (SELECT avg(quality) AS a, avg(toxic) AS b FROM labels), w AS (SELECT doc_id, CASE quality WHEN 1 THEN 1 / a WHEN 0 THEN a ELSE 1 END * CASE toxic WHEN 1 THEN 1 / b WHEN 0 THEN b ELSE 1 END AS w FROM labels, p) SELECT doc_id, round(w / (SELECT max(w) FROM w), 6) AS weight FROM w""")
def class_weights_product(spark, d):
    """Weights of rows by both labels together."""
    return labels.balance_weights_all(_read(spark, d, "labels"), ["quality", "toxic"]).select("doc_id", F.round("weight", 6).alias("weight"))

"""One query an operator: opN_<name>(spark, sf_dir), each over its whole table, with the digest columns of its contract."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import alignment, decontam, langid, licenses, line_dedup, ngram_join, packing, pii, pu_quality, quality, toxicity, warc, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _joined(spans, kinds: tuple[str, ...]):
    """kind:start:end, by start and then kind as listed, comma-joined."""
    order = F.create_map(*[x for k, kind in enumerate(kinds) for x in (F.lit(kind), F.lit(k))])
    keyed = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), order[s["kind"]].alias("k"), s["end"].alias("b"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(keyed, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["b"].cast("string"))), ",")


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", *map(count, pii.KINDS[:4]),
        F.sha2(_joined(F.col("base"), pii.KINDS), 256).alias("base_sha256"),
        _joined(F.concat("base", "added"), pii.KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_secret"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"), radius=None)
    return kept.select("doc_id", "n_lines", "n_removed", F.length("text").cast("long").alias("chars_kept"), F.sha2("text", 256).alias("text_sha256"))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def tokenizer_path() -> str:
    """The public vocabulary that the queries use; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) == 1
    learnable = F.coalesce(F.pmod(F.crc32(F.col("id").cast("string").cast("binary")), F.lit(3)) != 1, F.lit(False))
    return langid.identify(docs, learnable).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archives(spark, _table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text"), _table(spark, sf_dir, "labels"))
    return judged.select("doc_id", *quality.STATISTICS, "base_failed", "kept", "rule")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = alignment.align(_table(spark, sf_dir, "documents"), tokenizer_path(), public_tokenizers.path("piece_bpe_32k.model"))
    return found.select("doc_id", *alignment.NUMBERS, F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256"))


def _held_out(doc_id: str) -> Column:
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1


def op12_pu_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    learnable = F.coalesce(~_held_out("id"), F.lit(False))
    scored = pu_quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), learnable)
    return scored.select("doc_id", F.coalesce(_held_out("doc_id"), F.lit(False)).alias("held_out"), "score", "predicted")


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").cast("long"))


QUERIES: dict[str, Query] = {"op1_pii": op1_pii, "op2_line_dedup": op2_line_dedup, "op3_ngram_jaccard": op3_ngram_jaccard, "op4_toxicity": op4_toxicity, "op5_packing": op5_packing, "op6_decontamination": op6_decontamination, "op7_licenses": op7_licenses, "op8_language": op8_language, "op9_warc": op9_warc, "op10_quality": op10_quality, "op11_alignment": op11_alignment, "op12_pu_quality": op12_pu_quality, "op13_whitening": op13_whitening}

ORACLE_SQL: dict[str, str] = {
    # base 32 of the SHA-1: five hex digits are twenty bits, four letters
    "op9_warc": """
        WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
             d AS (SELECT page_id, octet_length(body) AS payload_bytes, sha1(body) AS h FROM p),
             f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS first_id FROM d)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
               array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
                   CAST(1 + ((CAST('0x' || substr(h, CAST((i // 4) * 5 + 1 AS BIGINT), 5) AS BIGINT) >> (15 - 5 * (i % 4))) & 31) AS BIGINT), 1)), '') AS payload_digest,
               CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
        FROM f""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)

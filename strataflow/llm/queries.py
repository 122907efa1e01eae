"""The operators' queries, each over its whole table with production parameters, and SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from strataflow.llm import cuckoo, dropout, langid, media, packing, pii, simhash, suffix, tokenfiles, warc
from strataflow.llm.common import documents


def op1_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropout.encode_documents(documents(spark, sf_dir))


def op2_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(documents(spark, sf_dir))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cuckoo.exact_dedup(documents(spark, sf_dir))


def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.harmonic_pack(documents(spark, sf_dir))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(documents(spark, sf_dir))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfiles.token_roundtrip(documents(spark, sf_dir))


def op9_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_roundtrip(documents(spark, sf_dir))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir))


QUERIES: tuple[Callable[[SparkSession, str], DataFrame], ...] = (
    op1_merge_dropout,
    op2_warc_zip,
    op3_language_id,
    op4_exact_dedup,
    op5_harmonic_packing,
    op6_pii,
    op7_suffix_dedup,
    op8_token_files,
    op9_media_columns,
    op10_simhash,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {q.__name__: q for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {
        "op2_warc_zip": """
            WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
                 q AS (SELECT *, CASE WHEN n >= 1000 THEN max(page_id) OVER (PARTITION BY d) END AS m FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
                   CASE WHEN m IS NOT NULL AND coalesce(page_id, m - 1) < m THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN coalesce(page_id, m - 1) < m THEN m END AS refers_to
            FROM q""",
        "op4_exact_dedup": r"""
            WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents),
                 g AS (SELECT *, min(doc_id) OVER (PARTITION BY h) AS k, count(*) OVER (PARTITION BY h) AS c FROM d)
            SELECT doc_id, k AS keep_id, CAST(c AS BIGINT) AS group_size, doc_id IS NOT DISTINCT FROM k AS kept, h AS text_sha256 FROM g""",
    }

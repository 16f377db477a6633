"""Queries of the operators on vectors, web archives and two tokenizers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rankspark.llm.token_alignment import align_tokens
from rankspark.llm.warc import archive_pages
from rankspark.llm.whitening import whiten, whitened_components


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_components(whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def tokenizer_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = align_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), *tokenizer_paths())
    return made.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


OP12_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, payload, octet_length(encode(payload)) AS payload_bytes, min(page_id) OVER (PARTITION BY payload) AS first_id,
    list_transform(range(0, 40, 5), lambda i: CAST('0x' || hex[i + 1:i + 5] AS INTEGER)) AS bits
  FROM p
)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda k: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((bits[1 + k // 4] >> (15 - 5 * (k % 4))) & 31)]), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM d
"""

QUERIES = {"op11_embedding_whitening": op11, "op12_warc_index": op12, "op13_token_alignment": op13}
ORACLES = {"op12_warc_index": OP12_SQL}

"""Queries and SQL of the operators made of DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.exact_dedup import exact_dedup
from rankspark.llm.line_dedup import line_dedup
from rankspark.llm.mixing import mix_sources
from rankspark.llm.pii import KINDS, private_spans, written


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("n_chunks")


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "copies", "source")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup(documents(spark, sf_dir)).select(
        "doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").cast("long").alias("n_dropped"), F.sha2("_kept", 256).alias("kept_sha256"),
    )


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = private_spans(documents(spark, sf_dir))
    ranks = F.transform("base", lambda s: s["rank"])
    counts = [(F.size(ranks) - F.size(F.array_remove(ranks, i))).cast("long").alias(f"n_{kind}") for i, kind in enumerate(KINDS)]
    spans = F.sort_array(F.concat("base", "terms"))
    return found.select("doc_id", *counts, F.sha2(written(F.col("base")), 256).alias("base_sha256"), written(spans).alias("spans"))


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
  FROM documents
), g AS (
  SELECT doc_id, text_sha256, count(*) OVER w AS group_size,
    first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id
  FROM d WINDOW w AS (PARTITION BY text_sha256)
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, pos, lines[pos] AS line,
    translate(trim(lines[pos], E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, lines, unnest(range(1, len(lines) + 1)) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), E'\n') AS lines FROM documents))
), f AS (
  SELECT key, max(doc_id) AS last_doc FROM l WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), k AS (
  SELECT l.doc_id, l.pos, l.line, f.key IS NULL OR l.doc_id = f.last_doc AS stays FROM l LEFT JOIN f ON l.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT stays) AS n_dropped,
  sha256(coalesce(string_agg(line, E'\n' ORDER BY pos) FILTER (stays), '')) AS kept_sha256
FROM k GROUP BY doc_id
"""

QUERIES = {"op1_exact_dedup": op1, "op3_source_mixing": op3, "op6_line_dedup": op6, "op9_private_data": op9}
ORACLES = {"op1_exact_dedup": OP1_SQL, "op6_line_dedup": OP6_SQL}

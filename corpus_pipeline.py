"""A training-data pipeline over documents: each stage is one operator of rankspark.llm.

A stage takes what its predecessor kept, as written and read again, and all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.line_dedup import line_dedup
from rankspark.llm.mixing import mix_sources
from rankspark.llm.near_dedup import near_components
from rankspark.llm.packing import pack
from rankspark.llm.queries_text import tokenizer_path
from rankspark.llm.toxicity import drop_toxic
from rankspark.session import new_folder


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents the toxicity network rejects go."""
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines repeated across documents go except in their largest doc_id; a document may be left empty."""
    return line_dedup(docs).withColumns({"text": F.col("_kept"), "n_chars": F.length("_kept").cast("long")}).select(*docs.columns)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of each near-duplicate component stays."""
    gone = near_components(docs).where("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stands as often as its rounded rate says; rows that share a doc_id take the larger of their copies."""
    copies = mix_sources(docs).groupBy(F.col("doc_id").alias("_id")).agg(F.max("copies").cast("int").alias("_copies"))
    rows = docs.join(copies, F.col("doc_id").eqNullSafe(F.col("_id"))).where("_copies > 0")
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces placed in sequences of at most 4096."""
    return pack(docs, tokenizer_path())


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_repeated_lines),
    ("near dedup", remove_near_duplicates),
    ("mixing", mix),
    ("packing", pack_sequences),
]

# The trained network, the Newton steps and the tokenizer are beyond SQL; tests/llm compares run() with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        folder = new_folder(spark, "stage")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return STAGES[-1][1](spark, docs, sf_dir)

"""Line dedup with levelled sorted runs of line hashes.

Batches of documents arrive one after the other. A batch's line hashes are merge-anti-joined with the runs written so far:
unseen hashes become a new sorted run at level 0, hashes seen before only add a count. When FANOUT runs stand at a level they are
merged into one run of the next. Runs are bucketed and sorted tables in the shared folder, so the merge joins neither
shuffle nor sort them again.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.llm.text import ascii_lower, strip_space, text_of
from rankspark.session import cut_lineage, new_folder, shuffle_width

MIN_CHARS = 40
MIN_DOCS = 5
BATCHES = 4
FANOUT = 3
KEY = ["a", "b"]


def line_key(line: Column) -> Column:
    return ascii_lower(strip_space(line))


def key_hash(key: Column) -> Column:
    """128 bits as two longs."""
    return F.struct(F.xxhash64(key).alias("a"), F.xxhash64(F.lit("line"), key).alias("b"))


class LineRuns:
    """Runs of (a, b, n_docs, last_doc): each line hash stands in exactly one run; what later batches add is in repeats."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT, buckets: int | None = None):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or shuffle_width(spark)
        self.levels: list[list[str]] = [[]]
        self.repeats: list[DataFrame] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        rows.repartition(self.buckets, *KEY).write.format("parquet").bucketBy(self.buckets, *KEY).sortBy(*KEY).option(
            "path", new_folder(self.spark, "run")
        ).saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs_at(self, level: int) -> list[DataFrame]:
        return [self.spark.table(name) for name in self.levels[level]]

    def runs(self) -> list[DataFrame]:
        return [run for level in range(len(self.levels)) for run in self.runs_at(level)]

    def add(self, doc_lines: DataFrame) -> None:
        """Take the distinct (doc_id, a, b) of one batch; a document must lie in one batch only."""
        batch = cut_lineage(doc_lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("last_doc")))
        fresh = reduce(lambda left, run: left.join(run.select(*KEY), KEY, "left_anti"), self.runs(), batch)
        self._write(fresh, 0)
        self.repeats.append(cut_lineage(batch.join(self.runs_at(0)[-1].select(*KEY), KEY, "left_anti")))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            self._write(reduce(DataFrame.unionByName, self.runs_at(level)), level + 1)
            self.levels[level] = []
            for name in old:
                self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def frequent(self, min_docs: int) -> DataFrame:
        """a, b, n_docs, last_doc of the hashes found in at least min_docs documents."""
        runs = self.runs()
        if not runs:
            raise ValueError("no batch was added")
        every = reduce(DataFrame.unionByName, runs + self.repeats)
        totals = every.groupBy(*KEY).agg(F.sum("n_docs").alias("n_docs"), F.max("last_doc").alias("last_doc"))
        return totals.where(F.col("n_docs") >= min_docs)


def document_lines(docs: DataFrame, doc_id: str, text: str, min_chars: int, batches: int) -> DataFrame:
    """Distinct (doc_id, a, b, batch) of the keys with at least min_chars code points."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.split(text_of(text), "\n", -1)).alias("line"))
    keys = lines.where(F.length("line") >= min_chars).select("doc_id", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    hashed = keys.select("doc_id", key_hash(F.col("key")).alias("k")).select("doc_id", "k.*")
    return hashed.distinct().withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int"))


def line_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_chars: int = MIN_CHARS,
               min_docs: int = MIN_DOCS, batches: int = BATCHES) -> DataFrame:
    """Every row of docs with its own columns and `_n_lines`, `_n_dropped`, `_kept` (the text that stays).

    A line's key is the line stripped of space and U+0009 to U+000D, A-Z lower-cased. Keys of at least min_chars code points found in
    at least min_docs documents lose all their lines except in the largest doc_id holding them. A null or empty text is
    one empty line; a text whose lines all go becomes empty. Rows that share a doc_id count as one document, and so do all rows
    with a null doc_id, which is below every other and never the holder while another holds the key. Empty tables pass through."""
    spark = docs.sparkSession
    folder = new_folder(spark, "lines")
    document_lines(docs, doc_id, text, min_chars, batches).write.partitionBy("batch").parquet(folder)
    schema = f"doc_id {dict(docs.dtypes)[doc_id]}, a bigint, b bigint, batch int"
    lines = spark.read.schema(schema).parquet(folder)
    runs = LineRuns(spark)
    for batch in range(batches):
        runs.add(lines.where(F.col("batch") == batch).drop("batch"))
    frequent = cut_lineage(runs.frequent(min_docs))
    gone = lines.join(frequent.select(*KEY, "last_doc"), KEY).where(~F.col("doc_id").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy(F.col("doc_id").alias("_gone_id")).agg(F.collect_list(F.struct(*KEY)).alias("_gone"))
    joined = docs.join(gone, F.col(doc_id).eqNullSafe(F.col("_gone_id")), "left")
    split = F.split(text_of(text), "\n", -1)
    stays = F.filter(split, lambda x: F.when(F.length(x) < min_chars, True).otherwise(~F.array_contains("_gone", key_hash(line_key(x)))))
    kept = F.when(F.col("_gone").isNull(), split).otherwise(stays)
    return joined.withColumns({"_n_lines": F.size(split).cast("long"), "_stay": kept}).withColumns(
        {"_n_dropped": F.col("_n_lines") - F.size("_stay"), "_kept": F.concat_ws("\n", "_stay")}
    ).drop("_gone", "_gone_id", "_stay")

"""Readers of the impression logs, the video dimension and the randomized log (CSV)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankspark.functions.scalars import flag01, fnum, hour_of
from rankspark.operators.features import with_author
from rankspark.operators.select import assign_split, mask_labels
from rankspark.session import cut_lineage

# ---- fixed values: file names by scale ----
SCALES = ["pure", "1k", "27k"]
LOGS = ["log_standard_4_08_to_4_21_{}.csv", "log_standard_4_22_to_5_08_{}.csv"]
RANDOM_LOG = "log_random_4_22_to_5_08_{}.csv"
VIDEO_BASIC = "video_features_basic_{}.csv"
REQUIRED = ["date", "user_id", "video_id", "tab", "duration_ms", "long_view"]
EXTENDED = ["hourmin", "time_ms", "is_click", "play_time_ms"]
# -------------------------------------------


def exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def detect_scale(spark: SparkSession, folder: str, requested: str | None = None) -> str:
    """Scale by the first video file found; asking for another one is an error."""
    found = next((s for s in SCALES if exists(spark, f"{folder}/{VIDEO_BASIC.format(s)}")), "pure")
    if requested and requested not in ("auto", found):
        raise ValueError(f"folder holds scale {found}, not {requested}")
    return found


def _read(spark: SparkSession, path: str, index: int) -> DataFrame:
    """All columns as text plus the position of each row: file, block and order inside the block."""
    raw = spark.read.option("header", True).csv(path)
    return raw.select(
        "*",
        F.lit(index).alias("_f"),
        F.col("_metadata.file_name").alias("_n"),
        F.col("_metadata.file_block_start").alias("_b"),
        F.monotonically_increasing_id().alias("_m"),
    )


def _need(df: DataFrame, columns: list[str], path: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"{path} lacks columns {missing}")
    return df


POSITION = ["_f", "_n", "_b"]


def _numbered(df: DataFrame, keys: list[str], out: str) -> DataFrame:
    """Zero-based numbers in file order (inside each key if given): rows are numbered per block and block counts are
    carried forward, one row per block."""
    sizes = df.groupBy(*keys, *POSITION).agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*keys).orderBy(*POSITION).rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, *POSITION, F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_s"))
    local = F.row_number().over(Window.partitionBy(*keys, *POSITION).orderBy("_m")) - 1
    placed = df.withColumn("_l", local).join(starts, [*keys, *POSITION])
    return placed.withColumn(out, (F.col("_l") + F.col("_s")).cast("long")).drop("_l", "_s")


def with_row_id(df: DataFrame, keys: list[str] = []) -> DataFrame:
    """`row_id`, dense and zero-based over all rows in file order; with keys also `split_row_id`, the same inside each key.

    The scan is written once, because block borders may differ between two scans of the same files."""
    out = _numbered(cut_lineage(df), [], "row_id")
    if keys:
        out = _numbered(out, keys, "split_row_id")
    return out.drop("_m", *POSITION)


def read_video_dim(spark: SparkSession, folder: str, scale: str | None = None) -> DataFrame:
    """video_id → author_id; a later duplicate wins; a file without these columns yields no rows."""
    path = f"{folder}/{VIDEO_BASIC.format(detect_scale(spark, folder, scale))}"
    raw = _read(spark, path, 0)
    if "video_id" not in raw.columns or "author_id" not in raw.columns:
        return spark.createDataFrame([], "video_id string, author_id string")
    return raw.groupBy("video_id").agg(F.max_by("author_id", F.struct("_n", "_b", "_m")).alias("author_id"))


def _typed(raw: DataFrame, extended: bool) -> list:
    cols = [
        F.col("date").try_cast("int").alias("date"),
        "user_id",
        "video_id",
        "tab",
        fnum("duration_ms").cast("float").alias("duration_ms"),
        flag01("long_view").alias("long_view"),
    ]
    if extended:
        cols += [
            fnum("time_ms").cast("long").alias("time_ms"),
            hour_of("hourmin").alias("hour"),
            flag01("is_click").alias("is_click"),
            fnum("play_time_ms").alias("play_time_ms"),
        ]
    return cols


def _logs(spark: SparkSession, folder: str, scale: str, extended: bool) -> DataFrame:
    parts = []
    for i, name in enumerate(LOGS):
        path = f"{folder}/{name.format(scale)}"
        if exists(spark, path):
            raw = _need(_read(spark, path, i), REQUIRED + (EXTENDED if extended else []), path)
            parts.append(raw.select(*_typed(raw, extended), *POSITION, "_m"))
    if not parts:
        raise FileNotFoundError(f"no impression log of scale {scale} in {folder}")
    return reduce(lambda a, b: a.unionByName(b), parts)


def read_impressions(
    spark: SparkSession, folder: str, scale: str | None = None, grants: DataFrame | None = None, extended: bool = False
) -> DataFrame:
    """Typed, split, label-masked impressions with their author, a `row_id` that is unique over all splits, and a dense
    `split_row_id` for submissions.

    Test rows appear only with an access grant, and their labels stay missing."""
    found = detect_scale(spark, folder, scale)
    rows = mask_labels(assign_split(_logs(spark, folder, found, extended)), grants)
    return with_author(with_row_id(rows, ["split"]), read_video_dim(spark, folder, found))


def read_random_log(spark: SparkSession, folder: str, scale: str | None = None) -> DataFrame | None:
    """Randomized-exposure rows as split `log_random`, or None when the folder has no such file."""
    found = detect_scale(spark, folder, scale)
    path = f"{folder}/{RANDOM_LOG.format(found)}"
    if not exists(spark, path):
        return None
    raw = _need(_read(spark, path, 0), REQUIRED + EXTENDED, path)
    rows = raw.select(*_typed(raw, True), *POSITION, "_m").withColumn("split", F.lit("log_random"))
    return with_author(with_row_id(rows), read_video_dim(spark, folder, found))


def split_rows(spark: SparkSession, folder: str, split: str, scale: str | None = None) -> DataFrame:
    """Only (row_id, date, user_id, video_id) of one split, for alignment checks."""
    found = detect_scale(spark, folder, scale)
    rows = assign_split(_logs(spark, folder, found, False)).where(F.col("split") == split)
    return with_row_id(rows.select("date", "user_id", "video_id", *POSITION, "_m"))


FILE_ROWS = 1 << 21  # rows of a date that one task writes


def write_impressions(df: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """The Parquet store: partitioned by split and date, so that split and date filters prune files. Rows meet by date and a
    salt first, of which a date has as many values as its rows fill files, so that a quiet date has one file and a busy date many tasks."""
    files = df.groupBy("split", "date").agg(F.ceil(F.count(F.lit(1)) / F.lit(file_rows)).cast("int").alias("_files"))
    sized = df.join(F.broadcast(files), ["split", "date"])  # one row per split and day
    salted = sized.withColumn("_salt", F.pmod(F.xxhash64("row_id"), F.col("_files"))).repartition("split", "date", "_salt")
    salted.select(*df.columns).write.mode("overwrite").partitionBy("split", "date").parquet(path)


def open_impressions(spark: SparkSession, path: str, splits: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    return df if splits is None else df.where(F.col("split").isin(splits))

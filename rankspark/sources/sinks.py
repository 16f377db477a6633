"""Writers and readers of score packs, submissions, ledgers and reports, and the submission check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ---- fixed values: published metrics of the official baseline per scale ----
BASELINES = [("pure", 0.6674, 0.5357, 0.6016), ("1k", None, None, 0.64203)]
# ------------------------------------------------------------------------------


def write_scores(df: DataFrame, path: str) -> None:
    df.write.mode("append").partitionBy("model_id").parquet(path)


def read_scores(spark: SparkSession, path: str, models: list[str] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.withColumn("model_id", F.col("model_id").cast("string"))
    return df if models is None else df.where(F.col("model_id").isin(models))


def submission(df: DataFrame) -> DataFrame:
    """row_id, user_id, video_id and the score at six significant digits."""
    score = F.format_string("%.5e", F.col("score").cast("double")).cast("double")
    return df.select("row_id", "user_id", "video_id", score.alias("score"))


def write_submission(df: DataFrame, path: str) -> None:
    """CSV with header; part files follow row_id, so reading them in name order gives the dense order."""
    submission(df).repartitionByRange("row_id").sortWithinPartitions("row_id").write.mode("overwrite").csv(path, header=True)


def check_submission(sub: DataFrame, rows: DataFrame) -> DataFrame:
    """Violations by full-outer alignment on row_id: missing, extra, misaligned, not finite."""
    left = sub.select("row_id", F.col("user_id").alias("_u"), F.col("video_id").alias("_v"), F.col("score").cast("double").alias("score"), F.lit(True).alias("_s"))
    right = rows.select("row_id", "user_id", "video_id", F.lit(True).alias("_r"))
    both = left.join(right, "row_id", "full_outer")
    finite = ~(F.isnan("score") | F.col("score").isin(float("inf"), float("-inf")))
    same = F.col("_u").eqNullSafe(F.col("user_id")) & F.col("_v").eqNullSafe(F.col("video_id"))
    problem = (
        F.when(F.col("_s").isNull(), "missing row")
        .when(F.col("_r").isNull(), "extra row")
        .when(~same, "misaligned")
        .when(F.col("score").isNull() | ~finite, "not finite")
    )
    return both.withColumn("violation", problem).where(F.col("violation").isNotNull()).select("row_id", "violation")


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append-only ledger, event, audit or change log."""
    df.write.mode("append").json(path)


def baseline_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(BASELINES, "scale string, base_gauc double, base_ndcg5 double, base_primary double")


def build_report(metrics: DataFrame, baseline: DataFrame) -> DataFrame:
    """Metrics next to the baseline of their scale, with deltas rounded to six digits."""
    out = metrics.join(baseline, "scale", "left")
    for name in ("gauc", "ndcg5", "primary"):
        out = out.withColumn(f"delta_{name}", F.round(F.col(name) - F.col(f"base_{name}"), 6))
    return out


def write_report(metrics: DataFrame, baseline: DataFrame, path: str) -> None:
    build_report(metrics, baseline).write.mode("overwrite").json(path)

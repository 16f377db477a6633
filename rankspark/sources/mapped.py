"""Impression, score, ledger and log views over the star-schema test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.scalars import UNKNOWN_AUTHOR, uniform
from rankspark.session import spread

TRAIN_LAST_DAY = 20240114
VALID_LAST_DAY = 20240121


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _millis(ts):
    """Epoch millis of a wall-clock timestamp, independent of the session time zone."""
    micros = (F.date_format(ts, "SSSSSS").cast("long") / 1000).cast("long")
    seconds = F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)
    days = F.datediff(F.to_date(ts), F.to_date(F.lit("1970-01-01"))).cast("long")
    return days * 86400000 + seconds.cast("long") * 1000 + micros


def raw_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions of all splits, labels still visible."""
    return map_events(table(spark, sf_dir, "events"))


def map_events(ev: DataFrame) -> DataFrame:
    """The impression columns of an events table or stream."""
    video = F.get_json_object("props", "$.k").cast("int")
    date = F.date_format("ts", "yyyyMMdd").cast("int")
    base = ev.select(
        F.col("event_id").alias("row_id"),
        date.alias("date"),
        _millis(F.col("ts")).alias("time_ms"),
        F.hour("ts").alias("hour"),
        "user_id",
        video.alias("video_id"),
        "event_type",
        "value",
    )
    return base.select(
        "row_id",
        "date",
        "time_ms",
        "hour",
        "user_id",
        "video_id",
        (F.col("row_id") % 3).cast("string").alias("tab"),
        ((F.col("video_id") + 1) * F.lit(1000.0)).alias("duration_ms"),
        (F.col("value") * 1000.0).alias("play_time_ms"),
        F.col("event_type").isin("click", "purchase").cast("int").alias("long_view"),
        F.col("event_type").isin("click", "purchase", "view").cast("int").alias("is_click"),
        F.when(F.col("date") <= TRAIN_LAST_DAY, "train")
        .when(F.col("date") <= VALID_LAST_DAY, "valid")
        .otherwise("test")
        .alias("split"),
        "value",
    )


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impressions with the author looked up and hidden-test labels missing."""
    raw = raw_impressions(spark, sf_dir)
    known = F.when(F.col("video_id") < 90, (F.col("video_id") % 10).cast("string"))
    return raw.withColumn("author_id", F.coalesce(known, F.lit(UNKNOWN_AUTHOR))).withColumn(
        "long_view", F.when(F.col("split") != "test", F.col("long_view"))
    )


def video_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """video_id → author_id for the videos seen in the log that have an author."""
    raw = raw_impressions(spark, sf_dir)
    return (
        raw.where(F.col("video_id") < 90)
        .select("video_id", (F.col("video_id") % 10).cast("string").alias("author_id"))
        .distinct()
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trial ledgers: 100 nodes per run, one row per node."""
    o = table(spark, sf_dir, "orders")
    key, cust = F.col("o_orderkey"), F.col("o_custkey")
    i = key % 100
    stage = (
        F.when(F.col("o_orderpriority") == "1-URGENT", "draft")
        .when(F.col("o_orderpriority") == "2-HIGH", "improve")
        .when(F.col("o_orderpriority") == "3-MEDIUM", "ablate")
        .when(F.col("o_orderpriority") == "4-NOT SPECIFIED", "ensemble")
        .otherwise("debug")
    )
    buggy = (F.col("o_orderstatus") == "F") & (i % 5 == 0)
    skip = i % 7 == 3
    config = F.create_map(
        F.lit("k"), F.element_at(F.array(F.lit("8"), F.lit("16"), F.lit("32")), (cust % 3 + 1).cast("int")),
        F.lit("loss"), F.when(cust % 2 == 0, '"logloss"').otherwise('"bpr"'),
        F.lit("seq_len"), F.element_at(F.array(F.lit("0"), F.lit("50"), F.lit("100")), (cust % 7 % 3 + 1).cast("int")),
        F.lit("use_time_decay"), F.when(cust % 5 == 0, "true").otherwise("false"),
        F.lit("seed"), (key % 3).cast("string"),
    )
    d = (uniform(key, 1) - 0.5) * 0.02
    se = 0.0005 + uniform(key, 2) * 0.002
    front = d + (uniform(key, 3) - 0.5) * 0.004
    back = d + (uniform(key, 4) - 0.5) * 0.004
    ensemble = stage == "ensemble"
    return o.select(
        F.floor(key / 100).cast("long").alias("run_id"),
        key.alias("seq"),
        key.alias("node_id"),
        F.when(i > 0, key - i + F.floor((i - 1) / 2)).cast("long").alias("parent_id"),
        stage.alias("stage"),
        F.when(cust % 10 == 4, "ablate").otherwise((cust % 10).cast("string")).alias("arm"),
        config.alias("config"),
        F.when(cust % 4 == 0, "h1").otherwise("h0").alias("source_hash"),
        (key % 3).cast("int").alias("seed"),
        (cust % 2).cast("int").alias("config_idx"),
        buggy.alias("is_buggy"),
        skip.alias("is_skip"),
        ((F.col("o_orderstatus") == "O") & (i % 4 == 0)).alias("confirmed"),
        F.when(~(buggy | skip), F.col("o_totalprice") / 1e6).alias("primary"),
        F.when((F.col("o_orderstatus") == "O") & (i % 4 == 0) & (key % 2 == 0) & ~(buggy | skip),
               F.col("o_totalprice") / 1e6 - 0.001).alias("confirmed_mean"),
        F.when(ensemble & (i >= 4), F.array(key - 1, key - 2, key - 3)).alias("members"),
        F.when(ensemble, F.element_at(
            F.array(F.lit("same_config"), F.lit("cross_identity"), F.lit("complementary")),
            (cust % 3 + 1).cast("int"))).alias("ensemble_kind"),
        F.when(i % 13 == 0, F.lit("timeout")).alias("exec_status"),
        (i % 11 == 0).alias("partial"),
        (key % 2 == 1).alias("weak_incumbent"),
        F.when(i > 0, d).alias("delta_primary"),
        ((uniform(key, 5) - 0.5) * 0.02).alias("delta_gauc"),
        ((uniform(key, 6) - 0.4) * 0.02).alias("delta_ndcg"),
        se.alias("se_val_delta"),
        (d - 1.96 * se).alias("ci95_lo"),
        (d + 1.96 * se).alias("ci95_hi"),
        F.when(key % 3 != 0, (uniform(key, 7) - 0.5) * 0.02).alias("expected_delta"),
        front.alias("delta_front"),
        back.alias("delta_back"),
        F.abs(front - back).alias("temporal_disagree"),
        (0.9 + 0.1 * uniform(key, 8)).alias("top1_agree"),
        ((uniform(key, 1) > 0.6) & (stage == "improve")).alias("screen_pass"),
        F.when(ensemble & (i % 2 == 0), uniform(key, 9)).alias("blend_alpha"),
        cust.alias("tokens_in"),
        (cust % 100).alias("tokens_out"),
        (F.col("o_totalprice") / 1000).alias("wall_seconds"),
    )


def error_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = spread(table(spark, sf_dir, "documents"))
    return d.select(
        F.col("doc_id").alias("trial_id"), F.col("text").alias("message"), (F.col("doc_id") % 4 != 0).alias("success")
    )


def error_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = table(spark, sf_dir, "benchmark")
    return b.select(F.col("item_id").alias("query_id"), F.col("text").alias("signature"))


def purchase_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume log: one impression per order line (user, item, author, day)."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("video_id"),
        F.col("l_suppkey").alias("author_id"),
        F.date_format("l_shipdate", "yyyyMMdd").cast("int").alias("date"),
        (F.col("l_returnflag") == "R").cast("int").alias("long_view"),
        F.col("l_linestatus").alias("tab"),
    )

"""Profiling queries over the split impression log."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def _split(sdf: DataFrame, name: str) -> DataFrame:
    return sdf.where(F.col("split") == name)


def pair_cover(sdf: DataFrame) -> DataFrame:
    """Share of distinct (user, video) pairs of valid that already occur in train."""
    pairs = _split(sdf, "valid").select("user_id", "video_id").distinct()
    seen = _split(sdf, "train").select("user_id", "video_id").distinct()
    hit = pairs.join(seen, ["user_id", "video_id"], "left_semi").agg(F.count(F.lit(1)).alias("n_seen"))
    return (
        pairs.agg(F.count(F.lit(1)).alias("n_pairs"))
        .crossJoin(hit)
        .withColumn("pair_cover", F.col("n_seen") / F.greatest("n_pairs", F.lit(1)))
    )


def cold_start(sdf: DataFrame) -> DataFrame:
    """Share of valid users and videos that train never saw."""

    def fresh(key: str, out: str) -> DataFrame:
        mine = _split(sdf, "valid").select(key).distinct()
        old = _split(sdf, "train").select(key).distinct()
        total = mine.agg(F.count(F.lit(1)).alias(f"n_{out}"))
        new = mine.join(old, key, "left_anti").agg(F.count(F.lit(1)).alias(f"n_new_{out}"))
        return total.crossJoin(new)

    both = fresh("video_id", "videos").crossJoin(fresh("user_id", "users"))
    return both.withColumn("new_video_frac", F.col("n_new_videos") / F.greatest("n_videos", F.lit(1))).withColumn(
        "new_user_frac", F.col("n_new_users") / F.greatest("n_users", F.lit(1))
    )


def key_overlap(sdf: DataFrame, keys: list[str]) -> DataFrame:
    """Distinct keys of train and valid in common, only in train, only in valid."""
    train = _split(sdf, "train").select(*keys)
    valid = _split(sdf, "valid").select(*keys)

    def size(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count(F.lit(1)).alias(name))

    return (
        size(train.intersect(valid), "n_both")
        .crossJoin(size(train.subtract(valid), "n_train_only"))
        .crossJoin(size(valid.subtract(train), "n_valid_only"))
    )


def nearest_rank(counts: DataFrame, key: str, value: str, probs: dict[str, float]) -> DataFrame:
    """Nearest-rank percentiles (half-even rounding of (n-1)p) from a histogram of the values, so only
    one row per distinct value is ever ordered."""
    hist = counts.groupBy(key, value).agg(F.count(F.lit(1)).alias("_f"))
    w = Window.partitionBy(key).orderBy(value)
    ranked = hist.withColumn("_hi", F.sum("_f").over(w)).withColumn(
        "_n", F.sum("_f").over(Window.partitionBy(key))
    )
    picks = []
    for name, p in probs.items():
        at = F.bround((F.col("_n") - 1) * F.lit(p), 0)
        picks.append(F.min(F.when(F.col("_hi") > at, F.col(value))).cast("double").alias(name))
    return ranked.groupBy(key).agg(*picks)


def split_profile(sdf: DataFrame) -> DataFrame:
    """Per split: rows, positive rate, users, rows per user (mean, p50, p90), single-impression share."""
    labelled = sdf.where(F.col("split").isin("train", "valid"))
    per_user = labelled.groupBy("split", "user_id").agg(
        F.count(F.lit(1)).alias("n"), F.sum("long_view").alias("pos")
    )
    main = per_user.groupBy("split").agg(
        F.sum("n").alias("n_rows"),
        (F.sum("pos") / F.sum("n")).alias("pos_rate"),
        F.count(F.lit(1)).alias("n_users"),
        F.avg("n").alias("rows_mean"),
        F.avg((F.col("n") == 1).cast("double")).alias("single_imp_frac"),
    )
    return main.join(nearest_rank(per_user, "split", "n", {"rows_p50": 0.5, "rows_p90": 0.9}), "split")


def profile(sdf: DataFrame, days: int = 3) -> DataFrame:
    """The whole profile as one row: sizes, coverage, cold start, percentiles and boundary drift."""
    by_split = split_profile(sdf)

    def side(name: str) -> DataFrame:
        cols = [c for c in by_split.columns if c != "split"]
        return by_split.where(F.col("split") == name).select(*[F.col(c).alias(f"{name}_{c}") for c in cols])

    return (
        side("train")
        .crossJoin(side("valid"))
        .crossJoin(pair_cover(sdf).select("pair_cover"))
        .crossJoin(cold_start(sdf).select("new_video_frac", "new_user_frac"))
        .crossJoin(pos_drift(sdf, days))
    )


def pos_drift(sdf: DataFrame, days: int = 3) -> DataFrame:
    """Positive rate of the last train days against the first valid days, from per-day totals."""
    daily = (
        sdf.where(F.col("split").isin("train", "valid"))
        .groupBy("split", "date")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("long_view").alias("pos"))
    )
    order = F.when(F.col("split") == "train", -F.col("date")).otherwise(F.col("date"))
    near = daily.withColumn("_rn", F.row_number().over(Window.partitionBy("split").orderBy(order))).where(
        F.col("_rn") <= days
    )

    def pick(name: str, col):
        return F.sum(F.when(F.col("split") == name, col).otherwise(0))

    def rate(name: str):
        n = pick(name, F.col("n"))
        return F.when(n > 0, pick(name, F.col("pos")) / n).otherwise(0.0)

    return near.agg(
        pick("train", F.lit(1)).cast("long").alias("train_tail_days"),
        pick("valid", F.lit(1)).cast("long").alias("valid_head_days"),
        rate("train").alias("train_tail_pos"),
        rate("valid").alias("valid_head_pos"),
        (rate("valid") - rate("train")).alias("pos_drift"),
    )


def user_mixed(train: DataFrame) -> DataFrame:
    """Users with both labels, only positives, only negatives, and the rows mixed users hold."""
    per_user = train.groupBy("user_id").agg(F.count(F.lit(1)).alias("c"), F.sum("long_view").alias("p"))
    mixed = (F.col("p") > 0) & (F.col("p") < F.col("c"))

    def n(cond):
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    return (
        per_user.agg(
            F.coalesce(F.sum("c"), F.lit(0)).alias("n_rows"),
            F.count(F.lit(1)).alias("users"),
            n(mixed).alias("mixed_users"),
            n((F.col("p") > 0) & (F.col("p") >= F.col("c"))).alias("pos_only_users"),
            n(F.col("p") <= 0).alias("neg_only_users"),
            F.coalesce(F.sum(F.when(mixed, F.col("c"))), F.lit(0)).alias("mixed_rows"),
        )
        .withColumn("frac_mixed_users", F.col("mixed_users") / F.greatest("users", F.lit(1)))
        .withColumn("frac_rows_in_mixed_users", F.col("mixed_rows") / F.greatest("n_rows", F.lit(1)))
    )


def sparse_counts(train: DataFrame, min_n: int = 5) -> DataFrame:
    """Rows whose user, video, or either has fewer than min_n rows. Rows first shrink to (user, video)
    counts, so the joins move pairs rather than impressions."""
    pairs = train.groupBy("user_id", "video_id").agg(F.count(F.lit(1)).alias("n"))
    users = pairs.groupBy("user_id").agg(F.sum("n").alias("n_user")).where(F.col("n_user") < min_n)
    videos = pairs.groupBy("video_id").agg(F.sum("n").alias("n_video")).where(F.col("n_video") < min_n)
    tagged = pairs.join(users, "user_id", "left").join(videos, "video_id", "left")
    thin_u, thin_v = F.col("n_user").isNotNull(), F.col("n_video").isNotNull()

    def rows(cond):
        return F.coalesce(F.sum(F.when(cond, F.col("n")).otherwise(0)), F.lit(0))

    return tagged.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
        rows(thin_u).alias("n_user_lt"),
        rows(thin_v).alias("n_video_lt"),
        rows(thin_u | thin_v).alias("n_either_lt"),
    ).select(
        "n_rows",
        *[
            (F.col(f"n_{c}_lt") / F.greatest("n_rows", F.lit(1))).alias(f"frac_rows_{c}_lt_min")
            for c in ("user", "video", "either")
        ],
    )

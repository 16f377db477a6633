"""Item co-occurrence over users' positive sets, and the scores built from it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join

BLOCK = 1000
BLEND_GRID = [0.0, 0.25, 0.5, 1.0, 2.0]


def positives(train: DataFrame) -> DataFrame:
    return train.where(F.col("long_view") == 1).select("user_id", "video_id").distinct()


def popularity(train: DataFrame) -> DataFrame:
    """Positive rows per video."""
    return train.where(F.col("long_view") == 1).groupBy("video_id").agg(F.count(F.lit(1)).alias("pop"))


def _blocked(pos: DataFrame, block: int) -> DataFrame:
    """Each user's items hashed into blocks, so that no join cell is larger than about block x block."""
    sizes = pos.groupBy("user_id").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("_nb"))
    return pos.join(sizes, "user_id").withColumn("_b", F.pmod(F.xxhash64("video_id"), F.col("_nb")).cast("int"))


def item_cooccurrence(train: DataFrame, block: int = BLOCK) -> DataFrame:
    """Users per unordered item pair, mirrored. A user's item set meets itself block by block, each cell
    in its own task, and every task counts its pairs before the shuffle."""
    parts = _blocked(positives(train), block)
    left = parts.select(
        "user_id", F.col("video_id").alias("a"), F.col("_b").alias("i"), F.explode(F.sequence("_b", F.col("_nb") - 1)).alias("j")
    )
    right = parts.select(
        "user_id", F.col("video_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("_b"))).alias("i"), F.col("_b").alias("j")
    )
    met = left.join(right, ["user_id", "i", "j"]).where((F.col("i") < F.col("j")) | (F.col("a") < F.col("b")))
    half = met.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.count(F.lit(1)).alias("n"))
    return half.unionByName(half.select(F.col("b").alias("a"), F.col("a").alias("b"), "n"))


def cooccurrence_of(train: DataFrame, items: DataFrame, block: int = BLOCK) -> DataFrame:
    """Users per ordered pair (v, video_id) with v among the given items (v); pairs of other items are never formed."""
    parts = _blocked(positives(train), block)
    every = F.explode(F.sequence(F.lit(0), F.col("_nb") - 1))
    wanted = parts.join(items.select(F.col("v").alias("video_id")).distinct(), "video_id", "left_semi")
    left = wanted.select("user_id", F.col("video_id").alias("v"), F.col("_b").alias("i"), every.alias("j"))
    right = parts.select("user_id", "video_id", every.alias("i"), F.col("_b").alias("j"))
    met = left.join(right, ["user_id", "i", "j"]).where("v <> video_id")
    return met.groupBy("v", "video_id").agg(F.count(F.lit(1)).alias("n"))


def item_cf_scores(sdf: DataFrame, split: str, block: int = BLOCK) -> DataFrame:
    """pop(v) plus the co-occurrence of v with every other positive of the user, for each target row."""
    train = sdf.where(F.col("split") == "train")
    rows = sdf.where(F.col("split") == split)
    targets = rows.select("user_id", F.col("video_id").alias("v")).distinct()
    parts = _blocked(positives(train), block)
    cells = parts.select("user_id", "_nb").distinct()
    spread = targets.join(cells, "user_id").withColumn("_b", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    need = spread.drop("_nb").join(parts.drop("_nb"), ["user_id", "_b"]).where(F.col("v") != F.col("video_id"))
    co = cooccurrence_of(train, targets, block)
    sums = need.join(co, ["v", "video_id"]).groupBy("user_id", "v").agg(F.sum("n").alias("_co"))
    scored = targets.join(sums, ["user_id", "v"], "left").join(
        popularity(train).withColumnRenamed("video_id", "v"), "v", "left"
    )
    cf = (F.coalesce("pop", F.lit(0)) + F.coalesce("_co", F.lit(0))).cast("double").alias("cf")
    return keyed_join(rows, scored.select("user_id", F.col("v").alias("video_id"), cf), ["user_id", "video_id"], "inner")

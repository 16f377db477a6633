"""Row and column selection, split assignment and label masking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import positions, prefix_sums
from rankspark.functions.scalars import uniform

# Inclusive date ranges of the splits.
SPLIT_RANGES = {"train": (20220408, 20220421), "valid": (20220422, 20220428), "test": (20220429, 20220508)}


def split_of(date: Column, ranges: dict[str, tuple[int, int]] = SPLIT_RANGES) -> Column:
    out = F.lit(None).cast("string")
    for name, (lo, hi) in reversed(list(ranges.items())):
        out = F.when(date.between(lo, hi), name).otherwise(out)
    return out


def assign_split(df: DataFrame, ranges: dict[str, tuple[int, int]] = SPLIT_RANGES) -> DataFrame:
    """Split by inclusive date range; rows outside every range are dropped."""
    return df.withColumn("split", split_of(F.col("date"), ranges)).where(F.col("split").isNotNull())


def mask_labels(sdf: DataFrame, grants: DataFrame | None = None) -> DataFrame:
    """Labels of the test split are missing, and its rows stay only when an access grant exists."""
    masked = sdf.withColumn("long_view", F.when(F.col("split") != "test", F.col("long_view")))
    kept = masked.where(F.col("split") != "test")
    if grants is None:
        return kept
    granted = grants.where(F.coalesce(F.trim("grant_id"), F.lit("")) != "").select(F.lit("test").alias("split")).distinct()
    return kept.unionByName(masked.where(F.col("split") == "test").join(granted, "split", "left_semi").select(*kept.columns))


def audit_grants(grants: DataFrame) -> DataFrame:
    """One audit record per grant, for the append-only log."""
    return grants.where(F.coalesce(F.trim("grant_id"), F.lit("")) != "").select(
        F.lit("test_access").alias("kind"), "grant_id", "reason", "issued_at"
    )


def tail_stop_split(sdf: DataFrame, cutoff: int, min_rows: int = 50) -> DataFrame:
    """The last train days become the early-stopping split when both sides are large enough."""
    is_train, late = F.col("split") == "train", F.col("date") >= cutoff
    sizes = sdf.where(is_train).agg(
        F.coalesce(F.sum(late.cast("long")), F.lit(0)).alias("_stop"), F.coalesce(F.sum((~late).cast("long")), F.lit(0)).alias("_fit")
    )
    wide = sdf.crossJoin(F.broadcast(sizes))
    enough = (F.col("_stop") >= min_rows) & (F.col("_fit") >= min_rows)
    return wide.withColumn("split", F.when(is_train & late & enough, "stop").otherwise(F.col("split"))).drop("_stop", "_fit")


def cap_rows(sdf: DataFrame, n: int) -> DataFrame:
    """First n train rows in row order; other splits untouched. This is a training-set size option."""
    train = prefix_sums(sdf.where(F.col("split") == "train"), [], ["row_id"], {"_at": F.lit(1.0)}, chunked=True)
    return train.where(F.col("_at") < n).drop("_at").unionByName(sdf.where(F.col("split") != "train"))


def sample_users(df: DataFrame, frac: float, seed: int) -> DataFrame:
    """All rows of a seeded share of the users: the max(1, round(n * frac)) smallest hash draws."""
    if frac >= 0.999:
        return df
    users = df.select("user_id").distinct().withColumn("_u", uniform("user_id", seed)).withColumn("_t", F.xxhash64("user_id"))
    total = users.agg(F.greatest(F.lit(1), F.bround(F.count(F.lit(1)) * F.lit(frac), 0)).alias("_k"))
    ranked = positions(users, [], "_u", "_p", tie="_t", chunked=True).crossJoin(F.broadcast(total))
    return keyed_join(df, ranked.where(F.col("_p") < F.col("_k")).select("user_id"), ["user_id"], "left_semi")


def drop_singletons(df: DataFrame) -> DataFrame:
    """Rows of users with at least two impressions: the (few) users to keep out are anti-joined."""
    single = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") < 2)
    return keyed_join(df, single.select("user_id"), ["user_id"], "left_anti")


def categorical_columns(df: DataFrame, columns: list[str], mode: str = "lowcard", limit: int = 1000,
                        approximate: bool = False) -> DataFrame:
    """Distinct values per column and whether a tree learner should treat it as categorical."""
    count = F.approx_count_distinct if approximate else F.count_distinct
    row = df.agg(*[count(F.col(c)).alias(c) for c in columns])
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("n_distinct")) for c in columns]))
    rule = {"none": F.lit(False), "all": F.lit(True)}.get(mode, F.col("n_distinct") < limit)
    return row.select(pairs.alias("_p")).select("_p.*").withColumn("categorical", rule)


def union_splits(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def group_sizes(df: DataFrame) -> DataFrame:
    return df.groupBy("user_id").agg(F.count(F.lit(1)).alias("size")).orderBy("user_id")

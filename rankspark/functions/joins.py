"""Equi-joins whose left side may hold a third of its rows under one key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.functions.ordered import has_large_group
from rankspark.session import group_rows, shuffle_width


def keyed_join(rows: DataFrame, side: DataFrame, keys: list[str], how: str = "left", large: bool | None = None) -> DataFrame:
    """Join rows to a table with at most one row per key.

    While no key is large this is a plain join. Otherwise the large keys (at most total / limit of them, so
    their side rows are safe to broadcast) are joined without moving the rows, and in the shuffled join for
    the remaining keys the rows already served are spread over salted keys that match nothing."""
    if large is None:
        large = has_large_group(rows, keys)
    if not large:
        return rows.join(side, keys, how)
    spark = rows.sparkSession
    cols = [c for c in side.columns if c not in keys]
    limit = group_rows(spark)
    hot = rows.groupBy(*keys).count().where(F.col("count") > limit).drop("count")
    hot_side = hot.join(side, keys, "left").select(
        *[F.col(k).alias(f"_h_{k}") for k in keys], F.struct(F.lit(True).alias("hit"), *[F.col(c) for c in cols]).alias("_hot"),
    )
    found = side.select(*keys, F.lit(True).alias("_found"))
    hot_side = hot_side.join(
        found.select(*[F.col(k).alias(f"_h_{k}") for k in keys], "_found"), [f"_h_{k}" for k in keys], "left"
    )
    cond = [F.col(k) == F.col(f"_h_{k}") for k in keys]
    first = rows.join(F.broadcast(hot_side), cond, "left").drop(*[f"_h_{k}" for k in keys])
    # The salt comes from the row's own values, so a replayed task sends its rows the same way.
    plain = [c for c, t in rows.dtypes if "map<" not in t and "variant" not in t]
    lacks = reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])
    spread_to = 1 + F.pmod(F.xxhash64(*plain), F.lit(4 * shuffle_width(spark)))
    salt = F.when(F.col("_hot").isNotNull() | lacks, spread_to).otherwise(0)
    salted = first.withColumn("_salt", salt.cast("long"))
    cold = side.select(*keys, F.lit(0).cast("long").alias("_salt"), F.struct(*cols).alias("_cold"), F.lit(True).alias("_met")) if cols else side.select(
        *keys, F.lit(0).cast("long").alias("_salt"), F.lit(True).alias("_met")
    )
    both = salted.join(cold, [*keys, "_salt"], "left")
    matched = F.when(F.col("_hot").isNotNull(), F.coalesce("_found", F.lit(False))).otherwise(F.coalesce("_met", F.lit(False)))
    if how in ("inner", "left_semi"):
        both = both.where(matched)
    elif how == "left_anti":
        both = both.where(~matched)
    elif how != "left":
        raise ValueError(f"unsupported join {how}")
    if how in ("left_semi", "left_anti") or not cols:
        return both.select(*rows.columns)
    picked = [F.when(F.col("_hot").isNotNull(), F.col(f"_hot.{c}")).otherwise(F.col(f"_cold.{c}")).alias(c) for c in cols]
    kept = [c for c in rows.columns]
    return both.select(*kept, *picked)

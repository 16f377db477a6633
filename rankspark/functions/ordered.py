"""Ordered operations inside groups of any size.

A window over a key sorts the whole key in one task. That is the right plan while every group is
small, so the helpers check the largest group first. Beyond the limit they cut each group into
chunks that keep the order (value ranges, row-id blocks), work inside the chunks, and carry chunk
totals forward: only one row per chunk ever meets in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.session import chunk_rows, group_rows, shuffle_width

CHUNK = ["_c0", "_c1", "_c2"]


def has_large_group(df: DataFrame, keys: list[str], limit: int | None = None) -> bool:
    """One partial aggregation over the key columns; True when some group exceeds the limit."""
    if not keys:
        return True
    limit = group_rows(df.sparkSession) if limit is None else limit
    return not df.groupBy(*keys).count().where(F.col("count") > limit).isEmpty()


def lower_bound(value: Column, bounds: list[float]) -> Column:
    """How many sorted bounds lie strictly below the value, by bisection over a literal array."""
    if not bounds:
        return F.lit(0)
    steps = [1 << b for b in range(len(bounds).bit_length() - 1, -1, -1)]
    edges = F.lit([float(b) for b in bounds])
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, step: F.when(F.coalesce(F.get(edges, at + step - 1) < value, F.lit(False)), at + step).otherwise(at),
    )


def order_bounds(df: DataFrame, value: Column) -> list[float]:
    """Sketched quantiles of the ordering value: at most one per shuffle partition, kept as literals
    so that every branch of a plan cuts at the same points."""
    n = max(2, min(shuffle_width(df.sparkSession), 4096))
    probs = [i / n for i in range(1, n)]
    found = df.select(value.cast("double").alias("v")).approxQuantile("v", probs, 1.0 / (4 * n))
    return sorted(set(found))


def value_chunks(df: DataFrame, value: Column, tie: str) -> DataFrame:
    """Order-preserving chunks for (value, tie). A value frequent enough to fill a chunk is itself a
    bound; its rows form their own run of chunks, split by blocks of the unique tie column."""
    bounds = order_bounds(df, value)
    size = chunk_rows(df.sparkSession)
    low = lower_bound(value.cast("double"), bounds)
    out = df.withColumn("_c0", low)
    edges = F.lit(bounds) if bounds else F.array().cast("array<double>")
    equal = F.coalesce(F.get(edges, F.col("_c0")) == value.cast("double"), F.lit(False))
    return out.withColumn("_c1", equal.cast("int")).withColumn(
        "_c2", F.when(equal, F.floor(F.col(tie) / size)).otherwise(F.lit(0)).cast("long")
    )


def row_chunks(df: DataFrame, lead: str | None, row: str = "row_id") -> DataFrame:
    """Order-preserving chunks for (lead, row): blocks of the unique row id, so no chunk is larger."""
    size = chunk_rows(df.sparkSession)
    first = F.col(lead).cast("long") if lead else F.lit(0).cast("long")
    return (
        df.withColumn("_c0", first)
        .withColumn("_c1", F.floor(F.col(row) / size).cast("long"))
        .withColumn("_c2", F.lit(0).cast("long"))
    )


def _before(keys: list[str], order: list) -> Window:
    return Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def join_chunks(df: DataFrame, side: DataFrame, keys: list[str]) -> DataFrame:
    """Null-safe equi-join on keys and chunk, so NULL keys keep their rows."""
    on = keys + CHUNK
    renamed = side.select(*[F.col(c).alias(f"_j_{c}") if c in on else F.col(c) for c in side.columns])
    cond = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(f"_j_{c}")) for c in on])
    return df.join(renamed, cond, "left").drop(*[f"_j_{c}" for c in on])


def prefix_sums(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column],
    lead: str | None = None,
    chunked: bool | None = None,
) -> DataFrame:
    """Exclusive running sums (0 at the start) in (lead, row) order; `order` names those columns."""
    if chunked is None:
        chunked = has_large_group(df, keys)
    if not chunked:
        w = _before(keys, [F.col(c) for c in order])
        return df.withColumns({n: F.coalesce(F.sum(c).over(w), F.lit(0.0)) for n, c in sums.items()})
    cut = row_chunks(df, lead, order[-1])
    return _carry_sums(cut, keys, order, sums)


def _carry_sums(cut: DataFrame, keys: list[str], order: list, sums: dict[str, Column]) -> DataFrame:
    inner = Window.partitionBy(*keys, *CHUNK).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    totals = cut.groupBy(*keys, *CHUNK).agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
    outer = _before(keys, [F.col(c) for c in CHUNK])
    carried = totals.select(
        *keys, *CHUNK, *[F.coalesce(F.sum(f"_t_{n}").over(outer), F.lit(0.0)).alias(f"_p_{n}") for n in sums]
    )
    local = cut.withColumns({f"_l_{n}": F.coalesce(F.sum(c).over(inner), F.lit(0.0)) for n, c in sums.items()})
    joined = join_chunks(local, carried, keys)
    out = joined.withColumns({n: F.col(f"_l_{n}") + F.col(f"_p_{n}") for n in sums})
    return out.drop(*CHUNK, *[f"_l_{n}" for n in sums], *[f"_p_{n}" for n in sums])


def positions(
    df: DataFrame,
    keys: list[str],
    value: str,
    out: str,
    descending: bool = False,
    tie: str = "row_id",
    chunked: bool | None = None,
) -> DataFrame:
    """Zero-based position by (value, tie) inside the key; ties never share a position."""
    key = -F.col(value) if descending else F.col(value)
    if chunked is None:
        chunked = has_large_group(df, keys)
    if not chunked:
        w = Window.partitionBy(*keys).orderBy(key, F.col(tie))
        return df.withColumn(out, (F.row_number().over(w) - 1).cast("long"))
    cut = value_chunks(df, key, tie)
    done = _carry_sums(cut, keys, [key, F.col(tie)], {out: F.lit(1.0)})
    return done.withColumn(out, F.col(out).cast("long"))


def value_prefix_sums(
    df: DataFrame, keys: list[str], value: str, sums: dict[str, Column], tie: str, descending: bool = False
) -> DataFrame:
    """Exclusive running sums in (value, tie) order, always chunked (for groups that are whole tables)."""
    key = -F.col(value) if descending else F.col(value)
    return _carry_sums(value_chunks(df, key, tie), keys, [key, F.col(tie)], sums)


def chunk_tails(cut: DataFrame, keys: list[str], order: list[str], value: str, k: int) -> DataFrame:
    """For every chunk, the last k non-null values of the same key in earlier chunks."""
    cells = cut.groupBy(*keys, *CHUNK).agg(F.count(F.lit(1)).alias("_rows"))
    latest = Window.partitionBy(*keys, *CHUNK).orderBy(*[F.col(c).desc() for c in order])
    ends = (
        cut.where(F.col(value).isNotNull())
        .select(*keys, *CHUNK, *order, F.col(value).alias("_v"), F.row_number().over(latest).alias("_rn"))
        .where(F.col("_rn") <= k)
        .groupBy(*keys, *CHUNK)
        .agg(F.sort_array(F.collect_list(F.struct(-F.col("_rn"), F.col("_v")))).alias("_e"))
        .withColumn("_tail", F.transform("_e", lambda e: e["_v"]))
        .drop("_e")
    )
    by_chunk = Window.partitionBy(*keys).orderBy(*CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    near = Window.partitionBy(*keys).orderBy("_filled").rangeBetween(-k, -1)
    joined = join_chunks(cells, ends, keys).withColumn("_filled", F.count("_tail").over(by_chunk))
    pieces = joined.withColumn("_flat", F.flatten(F.collect_list("_tail").over(near)))
    return pieces.select(*keys, *CHUNK, last_items(F.col("_flat"), k).alias("tail"))


def last_items(arr: Column, k: int | Column) -> Column:
    size = F.size(arr)
    take = F.least(size, F.lit(k) if isinstance(k, int) else k)
    return F.slice(arr, size - take + 1, take)


def running_records(df: DataFrame, keys: list[str], order: str, value: str, chunked: bool | None = None) -> DataFrame:
    """Rows whose value exceeds every earlier value of the key (strict running maxima)."""
    if chunked is None:
        chunked = has_large_group(df, keys)
    if not chunked:
        w = _before(keys, [F.col(order)])
        peak = F.max(value).over(w)
        return df.withColumn("_m", peak).where(F.col("_m").isNull() | (F.col(value) > F.col("_m"))).drop("_m")
    cut = row_chunks(df, None, order)
    inner = Window.partitionBy(*keys, *CHUNK).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = cut.groupBy(*keys, *CHUNK).agg(F.max(value).alias("_t"))
    carried = tops.select(*keys, *CHUNK, F.max("_t").over(_before(keys, [F.col(c) for c in CHUNK])).alias("_p"))
    out = join_chunks(cut.withColumn("_m", F.max(value).over(inner)), carried, keys)
    peak = F.greatest("_m", "_p")
    return out.where(peak.isNull() | (F.col(value) > peak)).drop(*CHUNK, "_m", "_p")

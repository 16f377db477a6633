"""Leakage-safe features: smoothed and causal rates, decay, momentum, histories, list ranks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import (
    CHUNK,
    chunk_tails,
    has_large_group,
    join_chunks,
    last_items,
    positions,
    prefix_sums,
    row_chunks,
    value_chunks,
)
from rankspark.functions.scalars import EMPTY_RATE, UNKNOWN_AUTHOR, beta_rate, day_ordinal, loo_rate

# Fixed values of the recency features.
HALFLIFE = 2.5
TAB_HALFLIFE = 3.0
SAMPLE_HALFLIFE = 3.0
SAMPLE_POWER = 0.75
LAST_K = 5
MS_PER_DAY = 86400000.0


def with_author(sdf: DataFrame, dim: DataFrame) -> DataFrame:
    """Left lookup of the author; the join strategy is left to the optimizer's size estimate. A stream cannot
    be measured beforehand and takes the plain join."""
    joined = sdf.join(dim, "video_id", "left") if sdf.isStreaming else keyed_join(sdf, dim, ["video_id"])
    return joined.withColumn("author_id", F.coalesce("author_id", F.lit(UNKNOWN_AUTHOR)))


# ---- rates -------------------------------------------------------------------------


def rate_stats(train: DataFrame) -> DataFrame:
    """Count and positives of observed labels by user, video, (user, author) and overall, in one pass."""
    seen = train.where(F.col("long_view").isNotNull())
    return seen.groupingSets(
        [["user_id"], ["video_id"], ["user_id", "author_id"], []], "user_id", "video_id", "author_id"
    ).agg(
        F.expr(
            "case grouping_id(user_id, video_id, author_id) when 3 then 'user' when 5 then 'video' "
            "when 2 then 'user_author' else 'all' end"
        ).alias("level"),
        F.count(F.lit(1)).alias("cnt"),
        F.coalesce(F.sum("long_view"), F.lit(0)).alias("pos"),
    )


def _key_counts(train: DataFrame, key: str) -> DataFrame:
    return (
        train.where(F.col("long_view").isNotNull())
        .groupBy(key)
        .agg(F.count(F.lit(1)).cast("double").alias(f"_{key}_cnt"), F.sum("long_view").cast("double").alias(f"_{key}_pos"))
    )


def global_rate(train: DataFrame) -> DataFrame:
    return train.agg(F.coalesce(F.avg("long_view"), F.lit(EMPTY_RATE)).alias("p_global"))


def lookup_rates(rows: DataFrame, train: DataFrame, keys: list[str], loo: bool = False) -> DataFrame:
    """Train rates of each row's keys (`user_id` → `user_rate`, …); leave the row's own label out on request."""
    out = rows.crossJoin(global_rate(train))
    for key in keys:
        name = key.removesuffix("_id")
        out = keyed_join(out, _key_counts(train, key), [key], large=has_large_group(rows, [key]))
        y = F.col("long_view").cast("double") if loo else None
        rate = loo_rate(F.col(f"_{key}_cnt"), F.col(f"_{key}_pos"), F.col("p_global"), y)
        out = out.withColumn(f"{name}_rate", rate).drop(f"_{key}_cnt", f"_{key}_pos")
    return out.drop("p_global")


def running_global_rate(train: DataFrame) -> DataFrame:
    """Global positive rate of the rows before each row in (date, row) order; 0.5 at the start."""
    y = F.col("long_view").cast("double")
    sums = {"_gp": y, "_gc": F.col("long_view").isNotNull().cast("double")}
    out = prefix_sums(train, [], ["date", "row_id"], sums, lead="date", chunked=True)
    return out.withColumn("p_now", F.when(F.col("_gc") > 0, F.col("_gp") / F.col("_gc")).otherwise(EMPTY_RATE)).drop(
        "_gp", "_gc"
    )


def causal_rates(train: DataFrame, chunked: bool | None = None) -> DataFrame:
    """User and video rates from earlier rows only; sparse keys take the running global rate."""
    out = running_global_rate(train)
    y = F.col("long_view").cast("double")
    seen = F.col("long_view").isNotNull().cast("double")
    for key in ("user_id", "video_id"):
        large = has_large_group(train, [key]) if chunked is None else chunked
        out = prefix_sums(out, [key], ["date", "row_id"], {"_kp": y, "_kc": seen}, lead="date", chunked=large)
        out = out.withColumn(
            key.replace("_id", "_rate"), loo_rate(F.col("_kc"), F.col("_kp"), F.col("p_now"))
        ).drop("_kp", "_kc")
    return out


# ---- recency -----------------------------------------------------------------------


# A block of days is DECAY_BITS half-lives long. Blocks lie in eras of ERA_BITS half-lives: weights relative to an era's first day still fit a double, and
# what is older than two eras is zero in one.
DECAY_BITS, ERA_BITS = 12, 960


def daily_decay(sdf: DataFrame, keys: list[str], halflife: float, pos_only: bool = False) -> DataFrame:
    """Decayed positives and totals of earlier days, one row per key and day that occurs.

    Rows shrink to day totals first; a day never sees itself. A day weighs the days of its own block of 12 half-lives and of the one before singly, as far as they
    are in its era. Older ones count by running sums, with weights relative to the first day of their era, so long histories neither overflow nor vanish and
    no sum is taken twice. A day's work is bounded, whatever the length of the history."""
    step = max(1, int(DECAY_BITS * halflife))
    era = max(1, int(ERA_BITS * halflife / step))
    fields = ["_p"] if pos_only else ["_p", "_t"]
    daily = (
        sdf.groupBy(*keys, "date")
        .agg(
            F.coalesce(F.sum("long_view"), F.lit(0)).cast("double").alias("_p"),
            F.count("long_view").cast("double").alias("_t"),
        )
        .withColumn("_d", day_ordinal("date"))
        .withColumn("_b", F.floor(F.col("_d") / step).cast("long"))
        .withColumn("_e", F.floor(F.col("_b") / era).cast("long"))
    )

    def weight(days: Column) -> Column:
        return F.pow(F.lit(0.5 ** (1.0 / halflife)), days.cast("double"))

    since = F.col("_d") - F.col("_e") * (era * step)
    scaled = daily.withColumns({f"{f}w": F.col(f) / weight(since) for f in fields})
    eras = Window.partitionBy(*keys).orderBy("_e")
    own = Window.partitionBy(*keys, "_e").orderBy("_b").rangeBetween(Window.unboundedPreceding, -2)
    near = Window.partitionBy(*keys, "_e").orderBy("_d").rangeBetween(1 - 2 * step, -1)

    def total(field: str, over) -> Column:
        return F.coalesce(F.sum(f"{field}w").over(over), F.lit(0.0))

    out = scaled.withColumns({f"{f}{i}": total(f, eras.rangeBetween(-i, -i)) for f in fields for i in (1, 2)})
    out = out.withColumns({f"{f}0": total(f, own) for f in fields})
    out = out.withColumn("_near", F.collect_list(F.struct("_d", "_b", *fields)).over(near))
    whole = weight(F.lit(era * step))

    def decayed(field: str) -> Column:
        far = (F.col(f"{field}0") + (F.col(f"{field}1") + F.col(f"{field}2") * whole) * whole) * weight(since)
        return F.aggregate(
            F.filter("_near", lambda e: e["_b"] >= F.col("_b") - 1), far, lambda acc, e: acc + e[field] * weight(F.col("_d") - e["_d"])
        )

    cols = [*keys, "date", decayed("_p").alias("decay_pos")]
    if not pos_only:
        cols.append(decayed("_t").alias("decay_tot"))
    return out.select(*cols)


def decay(sdf: DataFrame, keys: list[str] = ["user_id"], halflife: float = HALFLIFE, pos_only: bool = False) -> DataFrame:
    """Day-blind exponential decay joined back to the rows."""
    return keyed_join(sdf, daily_decay(sdf, keys, halflife, pos_only), [*keys, "date"])


def asof_decay(sdf: DataFrame, halflife: float = HALFLIFE, keys: list[str] = ["user_id"]) -> DataFrame:
    """Evaluation rows read the train-end state decayed to their day. Since the state only decays after
    train, one weighted sum per key anchored at the last train day is the exact as-of value."""
    train = sdf.where(F.col("split") == "train").where(F.col("long_view").isNotNull())
    last = train.agg(F.max(day_ordinal("date")).alias("_end"))
    rate = 0.5 ** (1.0 / halflife)
    aged = F.pow(F.lit(rate), (F.col("_end") - day_ordinal("date")).cast("double"))
    state = (
        train.crossJoin(last)
        .groupBy(*keys)
        .agg(F.sum(aged * F.col("long_view")).alias("_p"), F.sum(aged).alias("_t"), F.max("_end").alias("_end"))
    )
    since = F.pow(F.lit(rate), (day_ordinal("date") - F.col("_end")).cast("double"))
    rest = keyed_join(sdf.where(F.col("split") != "train"), state, keys)
    return rest.withColumn("decay_pos", F.coalesce(F.col("_p") * since, F.lit(0.0))).withColumn(
        "decay_tot", F.coalesce(F.col("_t") * since, F.lit(0.0))
    ).drop("_p", "_t", "_end")


def user_decay_weights(train: DataFrame, halflife: float = SAMPLE_HALFLIFE, power: float = SAMPLE_POWER) -> DataFrame:
    """Recency-weighted positive mass per user, flattened by a power."""
    last = train.agg(F.max(day_ordinal("date")).alias("_end"))
    aged = F.pow(F.lit(0.5), (F.col("_end") - day_ordinal("date")) / F.lit(float(halflife)))
    return (
        train.crossJoin(last)
        .where(F.col("long_view") == 1)
        .groupBy("user_id")
        .agg(F.pow(F.sum(aged), F.lit(float(power))).alias("weight"))
    )


# ---- momentum ----------------------------------------------------------------------


def momentum(sdf: DataFrame, k: int = LAST_K, chunked: bool | None = None) -> DataFrame:
    """Before each row of a user in (time, row) order: last observed label (-1 if none), sum and count of
    the last k observed labels, their rate, and the gap to the previous impression in days."""
    if chunked is None:
        chunked = has_large_group(sdf, ["user_id"])
    order = ["time_ms", "row_id"]
    if not chunked:
        before = Window.partitionBy("user_id").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        lag = Window.partitionBy("user_id").orderBy(*order)
        out = sdf.withColumn("_c", F.count("long_view").over(before)).withColumn(
            "last1", F.coalesce(F.last("long_view", ignorenulls=True).over(before), F.lit(-1))
        ).withColumn("_gap", F.col("time_ms") - F.lag("time_ms").over(lag))
        recent = Window.partitionBy("user_id").orderBy("_c").rangeBetween(-k, -1)
        out = out.withColumn("lastk_sum", F.coalesce(F.sum("long_view").over(recent), F.lit(0)).cast("double"))
        out = out.withColumn("lastk_cnt", F.least("_c", F.lit(k)).cast("double"))
    else:
        out = _momentum_chunked(sdf, k, order)
    return (
        out.withColumn("lastk_rate", beta_rate("lastk_sum", "lastk_cnt"))
        .withColumn("gap_days", F.col("_gap") / F.lit(MS_PER_DAY))
        .drop("_c", "_gap")
    )


def _momentum_chunked(sdf: DataFrame, k: int, order: list[str]) -> DataFrame:
    keys = ["user_id"]
    cut = value_chunks(sdf, F.col("time_ms"), "row_id")
    tails = chunk_tails(cut, keys, order, "long_view", k).withColumnRenamed("tail", "_tail")
    seen = chunk_tails(cut, keys, order, "time_ms", 1).withColumn("_prev", F.get("tail", F.lit(0))).drop("tail")
    part = [*keys, *CHUNK]
    before = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    lag = Window.partitionBy(*part).orderBy(*order)
    local = (
        cut.withColumn("_lc", F.count("long_view").over(before))
        .withColumn("_l1", F.last("long_view", ignorenulls=True).over(before))
        .withColumn("_lt", F.lag("time_ms").over(lag))
    )
    recent = Window.partitionBy(*part).orderBy("_lc").rangeBetween(-k, -1)
    local = local.withColumn("_ls", F.coalesce(F.sum("long_view").over(recent), F.lit(0)))
    out = join_chunks(join_chunks(local, tails, keys), seen, keys)
    need = F.greatest(F.lit(k) - F.col("_lc"), F.lit(0)).cast("int")
    borrowed = last_items(F.col("_tail"), need)
    out = out.withColumn(
        "lastk_sum", (F.col("_ls") + F.aggregate(borrowed, F.lit(0), lambda a, e: a + e)).cast("double")
    )
    out = out.withColumn("lastk_cnt", F.least(F.col("_lc") + F.size("_tail"), F.lit(k)).cast("double"))
    out = out.withColumn("last1", F.coalesce("_l1", F.element_at(F.concat(F.array(F.lit(-1)), "_tail"), -1)))
    out = out.withColumn("_gap", F.col("time_ms") - F.coalesce("_lt", "_prev"))
    return out.drop(*CHUNK, "_tail", "_prev", "_lc", "_l1", "_lt", "_ls")


def histories(sdf: DataFrame, length: int, chunked: bool | None = None) -> DataFrame:
    """The user's previous `length` videos across train, valid, test in row order, left-padded with 0,
    with a 0/1 mask."""
    if chunked is None:
        chunked = has_large_group(sdf, ["user_id"])
    rank = F.when(F.col("split") == "train", 0).when(F.col("split") == "valid", 1).otherwise(2)
    placed = sdf.withColumn("_s", rank)
    order = ["_s", "row_id"]
    if not chunked:
        w = Window.partitionBy("user_id").orderBy(*order).rowsBetween(-length, -1)
        out = placed.withColumn("_h", F.collect_list("video_id").over(w)).drop("_s")
    else:
        cut = row_chunks(placed, "_s", "row_id")
        tails = chunk_tails(cut, ["user_id"], order, "video_id", length)
        w = Window.partitionBy("user_id", *CHUNK).orderBy(*order).rowsBetween(-length, -1)
        local = cut.withColumn("_loc", F.collect_list("video_id").over(w))
        joined = join_chunks(local, tails, ["user_id"])
        out = joined.withColumn("_h", last_items(F.concat("tail", "_loc"), length)).drop(*CHUNK, "_loc", "tail", "_s")
    pad = F.lit(length) - F.size("_h")
    return (
        out.withColumn("hist", F.concat(F.array_repeat(F.lit(0), pad), "_h"))
        .withColumn("mask", F.concat(F.array_repeat(F.lit(0), pad), F.transform("_h", lambda _: F.lit(1))))
        .drop("_h")
    )


# ---- lists -------------------------------------------------------------------------


def list_quantile(df: DataFrame, value: str, out: str = "list_q", by: list[str] = ["split", "user_id"],
                  chunked: bool | None = None) -> DataFrame:
    """Position of the value inside the user's list scaled to [0,1]; 0.5 for a single row."""
    if chunked is None:
        chunked = has_large_group(df, by)
    placed = positions(df, by, value, "_p", chunked=chunked)
    placed = _with_size(placed, df, by, "_n", chunked)
    q = F.when(F.col("_n") <= 1, 0.5).otherwise(F.col("_p") / (F.col("_n") - 1))
    return placed.withColumn(out, q).drop("_p", "_n")


def _with_size(df: DataFrame, source: DataFrame, by: list[str], out: str, chunked: bool) -> DataFrame:
    if not chunked:
        return df.withColumn(out, F.count(F.lit(1)).over(Window.partitionBy(*by)))
    return keyed_join(df, source.groupBy(*by).agg(F.count(F.lit(1)).alias(out)), by, large=True)


def list_length(sdf: DataFrame, by: list[str] = ["split", "user_id"], out: str = "list_len",
                chunked: bool | None = None) -> DataFrame:
    if chunked is None:
        chunked = has_large_group(sdf, by)
    return _with_size(sdf, sdf, by, out, chunked)

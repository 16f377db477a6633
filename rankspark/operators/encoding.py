"""Quantile edges, buckets, vocabularies and the composed field encoder."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group, lower_bound, order_bounds
from rankspark.functions.scalars import beta_rate
from rankspark.operators import features as X
from rankspark.session import cut_lineage, group_rows, shuffle_width

RATE_BINS = 10
RECENCY_BINS = 20


# ---- quantile edges ----------------------------------------------------------------


def exact_quantiles(df: DataFrame, col: str, probs: list[float], by: list[str] = []) -> DataFrame:
    """Linear-interpolated quantiles as an array (one row, or one per group), computed from a distributed
    histogram: values are counted, cut into ranges, and only range totals are ordered together."""
    v = F.col(col).cast("double")
    hist = df.where(F.col(col).isNotNull()).groupBy(*by, v.alias("_v")).agg(F.count(F.lit(1)).alias("_f"))
    hist = hist.withColumn("_c", lower_bound(F.col("_v"), order_bounds(df, F.col(col))))
    totals = hist.groupBy(*by, "_c").agg(F.sum("_f").alias("_s"))
    # At most one row per range bound (<= 4096) meets in a group.
    before = Window.partitionBy(*by).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    base = totals.select(
        *by, "_c", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_b"), F.sum("_s").over(Window.partitionBy(*by)).alias("_n")
    )
    inner = F.sum("_f").over(Window.partitionBy(*by, "_c").orderBy("_v"))
    placed = hist.withColumn("_i", inner).join(base, [*by, "_c"]).withColumn("_hi", F.col("_i") + F.col("_b"))
    low = F.col("_hi") - F.col("_f")
    picks, edges = [], []
    for i, p in enumerate(probs):
        h = (F.col("_n") - 1) * F.lit(p)
        at = F.floor(h)
        for name, rank in ((f"_l{i}", at), (f"_u{i}", F.least(at + 1, F.col("_n") - 1))):
            picks.append(F.max(F.when((rank >= low) & (rank < F.col("_hi")), F.col("_v"))).alias(name))
        picks.append(F.max(h - at).alias(f"_w{i}"))
        edges.append(F.col(f"_l{i}") + (F.col(f"_u{i}") - F.col(f"_l{i}")) * F.col(f"_w{i}"))
    return placed.groupBy(*by).agg(*picks).select(*by, F.array(*edges).alias("q"))


def fit_edges(train: DataFrame, cols: list[str], bins: int | dict[str, int] = RATE_BINS) -> DataFrame:
    """One row of de-duplicated inner quantile edges per column (`<col>_edges`); bins may differ by column.

    Columns with few distinct values use the built-in percentile (its memory is one entry per value);
    the rest use the distributed histogram."""
    each = bins if isinstance(bins, dict) else dict.fromkeys(cols, bins)
    probs = {c: [i / n for i in range(1, n)] for c, n in each.items()}
    limit = group_rows(train.sparkSession) // 4
    sizes = train.agg(*[F.approx_count_distinct(c).alias(c) for c in cols]).first()
    small = [c for c in cols if sizes[c] <= limit]
    parts = []
    if small:
        parts.append(train.agg(*[F.percentile(F.col(c).cast("double"), F.lit(probs[c])).alias(f"{c}_edges") for c in small]))
    for c in cols:
        if c not in small:
            parts.append(exact_quantiles(train, c, probs[c]).withColumnRenamed("q", f"{c}_edges"))
    row = reduce(lambda a, b: a.crossJoin(b), parts)
    default = F.array(F.lit(0.5))
    return row.select(*[F.coalesce(F.array_sort(F.array_distinct(f"{c}_edges")), default).alias(f"{c}_edges") for c in cols])


def bucket_of(value: Column, edges: Column) -> Column:
    """Number of edges strictly below the value."""
    return F.size(F.filter(edges, lambda e: e < value))


def bucketize(df: DataFrame, edges: DataFrame, cols: list[str]) -> DataFrame:
    out = df.crossJoin(F.broadcast(edges))  # one row of at most a few dozen numbers
    for c in cols:
        out = out.withColumn(f"{c}_bucket", bucket_of(F.col(c), F.col(f"{c}_edges")))
    return out.drop(*[f"{c}_edges" for c in cols])


# ---- vocabularies ------------------------------------------------------------------


def fit_vocab(train: DataFrame, col: str) -> DataFrame:
    """Distinct values as text in lexicographic order with dense ids.

    Up to the group limit one task orders them; beyond it the values are range-partitioned, written
    once (so the ranges cannot move), and numbered from per-range counts."""
    spark = train.sparkSession
    words = train.select(F.col(col).cast("string").alias("value")).where(F.col("value").isNotNull()).distinct()
    if words.count() <= group_rows(spark):
        return words.select("value", (F.row_number().over(Window.orderBy("value")) - 1).cast("int").alias("id"))
    ranged = cut_lineage(words.repartitionByRange(shuffle_width(spark), "value").withColumn("_r", F.spark_partition_id()))
    base = ranged.groupBy("_r").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_r").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    base = base.select("_r", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_b"))
    local = F.row_number().over(Window.partitionBy("_r").orderBy("value")) - 1
    return ranged.withColumn("_l", local).join(base, "_r").select("value", (F.col("_l") + F.col("_b")).cast("int").alias("id"))


def encode(df: DataFrame, vocab: DataFrame, col: str, out: str, offset: Column | int = 0) -> DataFrame:
    """Ids by left join; unseen values take the slot after the vocabulary."""
    size = vocab.agg(F.count(F.lit(1)).cast("int").alias("_unk"))
    ids = vocab.select(F.col("value").alias("_w"), F.col("id").alias("_id"))
    start = F.lit(offset) if isinstance(offset, int) else offset
    joined = keyed_join(df.withColumn("_w", F.col(col).cast("string")), ids, ["_w"]).crossJoin(F.broadcast(size))
    return joined.withColumn(out, F.coalesce("_id", "_unk") + start).drop("_w", "_id", "_unk")


def bucket_vocab(train: DataFrame, cols: list[str]) -> DataFrame:
    """One row of bucket names seen in train, sorted as text (`<col>_vocab`); a few dozen entries each."""
    return train.agg(*[F.array_sort(F.collect_set(F.col(f"{c}_bucket").cast("string"))).alias(f"{c}_vocab") for c in cols])


def bucket_ids(df: DataFrame, vocab: DataFrame, cols: list[str]) -> DataFrame:
    """Local id of each bucket and the field size (vocabulary plus the unknown slot)."""
    out = df.crossJoin(F.broadcast(vocab))
    for c in cols:
        at = F.array_position(F.col(f"{c}_vocab"), F.col(f"{c}_bucket").cast("string")).cast("int")
        size = F.size(f"{c}_vocab")
        out = out.withColumn(f"{c}_id", F.when(at > 0, at - 1).otherwise(size)).withColumn(f"{c}_size", size + 1)
    return out.drop(*[f"{c}_vocab" for c in cols])


def bucket_fields(df: DataFrame, cols: list[str], bins: int | dict[str, int] = RATE_BINS) -> DataFrame:
    """Edges and vocabularies fitted on train, applied to every split.

    Edges, the id of every bucket and the field sizes are one written row. The columns of a row are placed together, as arrays, so that the code of the pass over
    all rows stays small enough to be compiled, however many columns there are."""
    table = cut_lineage(df)
    train = table.where(F.col("split") == "train")
    edges = cut_lineage(fit_edges(train, cols, bins))
    values = F.array(*[F.col(c).cast("double") for c in cols])
    every = edges.select(F.array(*[f"{c}_edges" for c in cols]).alias("_edges"))  # one row of at most a few dozen numbers a column
    seen = train.crossJoin(F.broadcast(every)).select(F.zip_with(values, "_edges", bucket_of).alias("_at"))
    vocab = bucket_vocab(seen.select(*[F.get("_at", F.lit(i)).alias(f"{c}_bucket") for i, c in enumerate(cols)]), cols)

    def codes(c: str) -> Column:
        known = F.col(f"{c}_vocab")

        def code(bucket: Column) -> Column:
            at = F.array_position(known, bucket.cast("string")).cast("int")
            return F.when(at > 0, at - 1).otherwise(F.size(known))

        return F.transform(F.sequence(F.lit(0), F.size(f"{c}_edges")), code)

    key = cut_lineage(
        edges.crossJoin(vocab).select(
            F.array(*[f"{c}_edges" for c in cols]).alias("_edges"),
            F.array(*[codes(c) for c in cols]).alias("_codes"),
            F.array(*[F.size(f"{c}_vocab") + 1 for c in cols]).alias("_sizes"),
        )
    )
    ids = F.zip_with(F.zip_with(values, "_edges", bucket_of), "_codes", lambda bucket, code: F.get(code, bucket))
    out = table.crossJoin(F.broadcast(key)).withColumn("_ids", ids)  # one row
    named = {f"{c}_{n}": F.get(f"_{n}s", F.lit(i)) for i, c in enumerate(cols) for n in ("id", "size")}
    return out.withColumns(named).drop("_edges", "_codes", "_sizes", "_ids")


# ---- field groups ------------------------------------------------------------------


def rate_columns(sdf: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Causal rates on train rows, fitted rates on the others."""
    train = sdf.where(F.col("split") == "train")
    causal = X.causal_rates(train, chunked).drop("p_now")
    rest = X.lookup_rates(sdf.where(F.col("split") != "train"), train, ["user_id", "video_id"])
    return causal.unionByName(rest)


def rate_fields(sdf: DataFrame, chunked: bool | None = None) -> DataFrame:
    return bucket_fields(rate_columns(sdf, chunked), ["user_rate", "video_rate"], RATE_BINS)


def rank_columns(sdf: DataFrame, chunked: bool | None = None, rated: DataFrame | None = None) -> DataFrame:
    """List position and length by video rate; rated is sdf with its rate columns, if they are there already."""
    rated = rate_columns(sdf, chunked) if rated is None else rated
    by = ["split", "user_id"]
    large = has_large_group(sdf, by) if chunked is None else chunked
    ranked = X.list_quantile(rated, "video_rate", "list_q", chunked=large)
    return X.list_length(ranked, chunked=large)


def rank_fields(sdf: DataFrame, chunked: bool | None = None) -> DataFrame:
    return bucket_fields(rank_columns(sdf, chunked), ["list_q", "list_len"], RATE_BINS)


RECENCY = ["decay_rate", "decay_tot", "tab_decay", "lastk_rate", "gap"]


def recency_columns(sdf: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Decay, tab decay, momentum. Only train labels feed the state; other rows read the train end."""
    train_only = sdf.withColumn("_y", F.col("long_view")).withColumn(
        "long_view", F.when(F.col("split") == "train", F.col("long_view"))
    )
    out = X.decay(train_only, ["user_id"], X.HALFLIFE)
    tab = X.daily_decay(train_only, ["user_id", "tab"], X.TAB_HALFLIFE, pos_only=True)
    out = keyed_join(out, tab.withColumnRenamed("decay_pos", "tab_decay"), ["user_id", "tab", "date"], large=has_large_group(sdf, ["user_id", "tab", "date"]))
    out = X.momentum(out, chunked=chunked)
    return (
        out.withColumn("decay_rate", beta_rate("decay_pos", "decay_tot"))
        .withColumn("gap", F.coalesce("gap_days", F.lit(0.0)))
        .withColumn("long_view", F.col("_y"))
        .drop("_y", "decay_pos", "lastk_sum", "lastk_cnt", "gap_days")
    )


def recency_fields(sdf: DataFrame, chunked: bool | None = None) -> DataFrame:
    out = bucket_fields(recency_columns(sdf, chunked), RECENCY, RECENCY_BINS)
    # Last label: fixed three-value vocabulary -1, 0, 1.
    return out.withColumn("last1_id", (F.col("last1") + 1).cast("int")).withColumn("last1_size", F.lit(3))


BASE = ["user_id", "video_id", "author_id", "tab"]


def base_fields(sdf: DataFrame) -> DataFrame:
    """Id fields and a duration bucket, each with its own vocabulary and unknown slot.

    Every vocabulary is fitted and written once, and large keys are looked for in sdf itself."""
    train = sdf.where(F.col("split") == "train")
    out = sdf
    for col in BASE:
        vocab = cut_lineage(fit_vocab(train, col))
        name = col.removesuffix("_id")
        size = vocab.agg((F.count(F.lit(1)) + 1).cast("int").alias(f"{name}_size"))
        ids = vocab.select(F.col("value").alias("_w"), F.col("id").alias("_id"))
        joined = keyed_join(out.withColumn("_w", F.col(col).cast("string")), ids, ["_w"], large=has_large_group(sdf, [col]))
        out = joined.crossJoin(F.broadcast(size)).withColumn(f"{name}_fid", F.coalesce("_id", F.col(f"{name}_size") - 1)).drop("_w", "_id")
    edges = fit_edges(train, ["duration_ms"], RATE_BINS)
    placed = bucketize(out, edges, ["duration_ms"])
    vocab = bucket_vocab(bucketize(train, edges, ["duration_ms"]), ["duration_ms"])
    return (
        bucket_ids(placed, vocab, ["duration_ms"])
        .withColumnRenamed("duration_ms_id", "dur_fid")
        .withColumnRenamed("duration_ms_size", "dur_size")
        .drop("duration_ms_bucket")
    )


def hour_field(sdf: DataFrame) -> DataFrame:
    """Hour of day with the train hours as vocabulary, in numeric order."""
    hours = sdf.where(F.col("split") == "train").agg(F.array_sort(F.collect_set("hour")).alias("_hv"))
    at = F.array_position("_hv", F.col("hour")).cast("int")
    return (
        sdf.crossJoin(F.broadcast(hours))  # at most 24 values
        .withColumn("hour_fid", F.when(at > 0, at - 1).otherwise(F.size("_hv")))
        .withColumn("hour_size", F.size("_hv") + 1)
        .drop("_hv")
    )


def aux_targets(sdf: DataFrame) -> DataFrame:
    return sdf.select("row_id", "split", F.col("is_click").alias("click"), F.col("play_time_ms").alias("play"),
                      F.col("duration_ms").alias("dur"))


def encode_all(
    sdf: DataFrame,
    use_hour: bool = False,
    use_rates: bool = False,
    use_ranks: bool = False,
    use_recency: bool = False,
    seq_len: int = 0,
    need_aux: bool = False,
    chunked: bool | None = None,
) -> DataFrame:
    """Every requested field as an id in one shared id space, in a fixed field order.

    Features are added to the rows one after the other, so nothing is joined back on row_id: rates feed the list ranks, and all
    numeric columns share one written table from which edges and bucket vocabularies are fitted. row_id must be unique over all splits.
    The result carries `fields` (ARRAY<INT>), `dim` and, on request, numeric, history and aux columns."""
    if chunked is None:
        chunked = has_large_group(sdf, ["user_id"])
    pairs = [(f"{n}_fid", f"{n}_size") for n in ("user", "video", "author", "tab", "dur")]
    extra: list[str] = []
    bins: dict[str, int] = {}
    out = base_fields(sdf)
    if use_hour:
        out = hour_field(out)
        pairs.append(("hour_fid", "hour_size"))
    if use_rates or use_ranks:
        out = cut_lineage(rate_columns(cut_lineage(out), chunked))
    if use_rates:
        bins |= dict.fromkeys(["user_rate", "video_rate"], RATE_BINS)
        extra += ["user_rate", "video_rate"]
    if use_ranks:
        out = rank_columns(sdf, chunked, rated=out)
        bins |= dict.fromkeys(["list_q", "list_len"], RATE_BINS)
    if use_recency:
        out = recency_columns(out, chunked)
        # Rounded, so that the order in which sums met cannot move a value across an edge.
        out = out.withColumns({c: F.round(c, 11 if c == "gap" else 9) for c in RECENCY})
        bins |= dict.fromkeys(RECENCY, RECENCY_BINS)
        extra += [*RECENCY, "last1"]
    if seq_len > 0:
        out = X.histories(out.withColumn("_video", F.col("video_id")).withColumn("video_id", F.col("video_fid")), seq_len, chunked)
        out = out.withColumn("video_id", F.col("_video")).drop("_video")
        extra += ["hist", "mask"]
    if bins:
        out = bucket_fields(out, list(bins), bins)
        pairs += [(f"{c}_id", f"{c}_size") for c in bins]
    if use_recency:
        out = out.withColumns({"last1_id": (F.col("last1") + 1).cast("int"), "last1_size": F.lit(3)})
        pairs.append(("last1_id", "last1_size"))
    if need_aux:
        extra += ["is_click", "play_time_ms", "duration_ms"]
    # Starts are carried along one array instead of being written out per field.
    ids, sizes = F.array(*[F.col(i).cast("int") for i, _ in pairs]), F.array(*[F.col(n).cast("int") for _, n in pairs])
    state = F.struct(F.array().cast("array<int>").alias("f"), F.lit(0).alias("s"))
    step = lambda acc, size: F.struct(F.array_append(acc["f"], F.get(out_ids, F.size(acc["f"])) + acc["s"]).alias("f"), (acc["s"] + size).alias("s"))
    out_ids = F.col("_ids")
    out = out.withColumns({"_ids": ids, "_sizes": sizes}).withColumn("_all", F.aggregate("_sizes", state, step))
    return out.select("row_id", "split", "user_id", "long_view", F.col("_all.f").alias("fields"), F.col("_all.s").alias("dim"), *extra)

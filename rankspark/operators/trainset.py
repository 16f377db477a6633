"""Training sets: user batches, ranking pairs, model scoring and losses."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group, positions, prefix_sums, value_prefix_sums
from rankspark.functions.scalars import uniform, watch_targets

PAIRS_CAP = 32


# ---- weights and batches -----------------------------------------------------------


def play_weights(df: DataFrame, by: list[str] = []) -> DataFrame:
    """Positives weigh log1p(play) over the median positive, clipped to [0.25, 8]; negatives weigh 1."""
    from rankspark.operators.encoding import exact_quantiles, fit_edges

    raw = F.log1p(F.greatest("play_time_ms", F.lit(0.0)))
    pos = df.where(F.col("long_view") == 1)
    if by:
        large = has_large_group(df, by)
        if large:
            med = exact_quantiles(pos.select(*by, raw.alias("_raw")), "_raw", [0.5], by).select(*by, F.get("q", F.lit(0)).alias("_med"))
        else:
            med = pos.groupBy(*by).agg(F.percentile(raw, F.lit(0.5)).alias("_med"))
        out = keyed_join(df, med, by, large=large)
    else:
        med = fit_edges(pos.select(raw.alias("_raw")), ["_raw"], 2).select(F.get("_raw_edges", F.lit(0)).alias("_med"))
        out = df.crossJoin(F.broadcast(med))
    scale = F.when(F.col("_med") > 1e-6, F.col("_med")).otherwise(1.0)
    clipped = F.least(F.greatest(raw / scale, F.lit(0.25)), F.lit(8.0))
    return out.withColumn("weight", F.when(F.col("long_view") == 1, clipped).otherwise(1.0)).drop("_med")


def weighted_user_key(users: DataFrame, weights: DataFrame | None, seed: int) -> DataFrame:
    """Exponential-race sort key per user: ln(u) / weight, larger first; missing weights count as 1."""
    out = users if weights is None else users.join(weights, "user_id", "left")
    w = F.lit(1.0) if weights is None else F.greatest(F.coalesce("weight", F.lit(1.0)), F.lit(1e-9))
    draw = F.greatest(uniform("user_id", seed), F.lit(1e-12))
    return out.withColumn("key", F.log(draw) / w)


def weighted_user_order(users: DataFrame, weights: DataFrame | None, seed: int) -> DataFrame:
    keyed = weighted_user_key(users.select("user_id").distinct(), weights, seed).withColumn("_t", F.xxhash64("user_id"))
    return positions(keyed, [], "key", "place", descending=True, tie="_t", chunked=True).select("user_id", "key", "place")


def user_batches(df: DataFrame, batch_rows: int, seed: int, weights: DataFrame | None = None) -> DataFrame:
    """Whole users packed into batches of about `batch_rows` rows in weighted shuffled order."""
    sizes = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("_n"))
    keyed = weighted_user_key(sizes, weights, seed).withColumn("_t", F.xxhash64("user_id"))
    packed = value_prefix_sums(keyed, [], "key", {"_before": F.col("_n").cast("double")}, "_t", descending=True)
    batch = F.floor(F.col("_before") / batch_rows).cast("long").alias("batch_id")
    return keyed_join(df, packed.select("user_id", batch), ["user_id"], "inner")


# ---- pairs -------------------------------------------------------------------------


def _indexed(df: DataFrame, keys: list[str], chunked: bool | None) -> DataFrame:
    """Zero-based index of each row among the rows with its label inside the key."""
    out = prefix_sums(df, [*keys, "label"], ["row_id"], {"_i": F.lit(1.0)}, chunked=chunked)
    return out.withColumn("_i", F.col("_i").cast("long"))


def bpr_pairs(df: DataFrame, cap: int = PAIRS_CAP, seed: int = 0, chunked: bool | None = None) -> DataFrame:
    """Up to min(n_pos * n_neg, cap) seeded (positive, negative) draws per user, with replacement.

    Only the drawn positions are joined back to rows; no list is ever paired with itself."""
    if chunked is None:
        chunked = has_large_group(df, ["user_id"])
    counts = df.groupBy("user_id").agg(
        F.sum((F.col("label") == 1).cast("long")).alias("_np"), F.sum((F.col("label") == 0).cast("long")).alias("_nn")
    )
    n = F.least(F.col("_np") * F.col("_nn"), F.lit(cap))
    draws = (
        counts.where((F.col("_np") > 0) & (F.col("_nn") > 0))
        .withColumn("draw", F.explode(F.sequence(F.lit(1).cast("long"), n)))
        .withColumn("_k", F.concat_ws("|", F.col("user_id").cast("string"), F.col("draw").cast("string")))
        .withColumn("_ip", F.floor(uniform(F.concat("_k", F.lit("|p")), seed) * F.col("_np")).cast("long"))
        .withColumn("_in", F.floor(uniform(F.concat("_k", F.lit("|n")), seed) * F.col("_nn")).cast("long"))
    )
    rows = _indexed(df.select("user_id", "row_id", "label"), ["user_id"], chunked)
    pos = rows.where(F.col("label") == 1).select("user_id", F.col("_i").alias("_ip"), F.col("row_id").alias("pos_row"))
    neg = rows.where(F.col("label") == 0).select("user_id", F.col("_i").alias("_in"), F.col("row_id").alias("neg_row"))
    return draws.join(pos, ["user_id", "_ip"]).join(neg, ["user_id", "_in"]).select("user_id", "draw", "pos_row", "neg_row")


def global_pairs(df: DataFrame, by: list[str] = []) -> DataFrame:
    """The i-th positive with the i-th negative in row order, across users (inside each batch if given)."""
    rows = _indexed(df.select(*by, "row_id", "label"), by, True)
    pos = rows.where(F.col("label") == 1).select(*by, "_i", F.col("row_id").alias("pos_row"))
    neg = rows.where(F.col("label") == 0).select(*by, "_i", F.col("row_id").alias("neg_row"))
    return pos.join(neg, [*by, "_i"]).withColumnRenamed("_i", "pair_idx")


def _idcg(n_pos: Column, k: int) -> Column:
    sums, total = [0.0], 0.0
    for i in range(k):
        total += 1.0 / math.log2(i + 2)
        sums.append(total)
    return F.get(F.lit(sums), F.least(n_pos, F.lit(k)).cast("int"))


def lambda_pairs(scores: DataFrame, cap: int = PAIRS_CAP, seed: int = 0, k: int = 5, chunked: bool | None = None) -> DataFrame:
    """Drawn pairs weighted by how much swapping the two rows would change nDCG@k at the current scores."""
    if chunked is None:
        chunked = has_large_group(scores, ["user_id"])
    ranked = positions(scores.select("user_id", "row_id", "label", "score"), ["user_id"], "score", "_r", descending=True,
                       chunked=chunked)
    disc = F.when(F.col("_r") < k, 1.0 / F.log2(F.col("_r") + 2.0)).otherwise(0.0)
    item = ranked.select("row_id", disc.alias("_d"))
    n_pos = scores.groupBy("user_id").agg(F.sum("label").alias("_np"))
    pairs = bpr_pairs(scores, cap, seed, chunked).join(n_pos, "user_id")
    for side in ("pos", "neg"):
        pairs = pairs.join(item.select(F.col("row_id").alias(f"{side}_row"), F.col("_d").alias(f"_d_{side}")), f"{side}_row")
    delta = F.abs(F.col("_d_pos") - F.col("_d_neg")) / _idcg(F.col("_np"), k)
    return pairs.select("user_id", "draw", "pos_row", "neg_row", delta.alias("delta")).where(F.col("delta") > 0)


# ---- scoring -----------------------------------------------------------------------


def _add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def fm_score(encoded: DataFrame, factors: DataFrame, bias: float = 0.0) -> DataFrame:
    """Factorization-machine score from a table (feature, w, v). A row gathers only its own few fields."""
    fields = encoded.select("row_id", F.posexplode("fields").alias("_f", "feature"))
    # A field with few values (tab, hour) puts a large share of the exploded rows under one feature.
    joined = keyed_join(fields, factors, ["feature"], "inner")
    item = F.struct("_f", F.col("w").alias("w"), F.col("v").cast("array<double>").alias("v"))
    packed = joined.groupBy("row_id").agg(F.sort_array(F.collect_list(item)).alias("_p"))
    first = F.get("_p", F.lit(0))["v"]
    zero = F.transform(first, lambda _: F.lit(0.0))
    total = F.aggregate("_p", zero, lambda acc, e: _add(acc, e["v"]))
    squares = F.aggregate("_p", F.lit(0.0), lambda acc, e: acc + dot(e["v"], e["v"]))
    linear = F.aggregate("_p", F.lit(0.0), lambda acc, e: acc + e["w"])
    return packed.select("row_id", linear.alias("_l"), total.alias("_s"), squares.alias("_q")).select(
        "row_id", (F.lit(float(bias)) + F.col("_l") + 0.5 * (dot(F.col("_s"), F.col("_s")) - F.col("_q"))).alias("score")
    )


def history_context(rows: DataFrame, emb: DataFrame, mode: str = "pool") -> DataFrame:
    """Masked mean of the history's vectors, or their softmax attention against the target's vector.

    `rows` has (row_id, target, hist, mask); a row gathers at most its own bounded history."""
    items = rows.select("row_id", "target", F.posexplode(F.arrays_zip("hist", "mask")).alias("_i", "_h")).where(
        F.col("_h.mask") == 1
    )
    flat = items.select("row_id", "target", "_i", F.col("_h.hist").alias("item"))
    vec = emb.select("item", F.col("vec").cast("array<double>").alias("_v"))
    large = has_large_group(flat, ["item"])
    got = keyed_join(flat, vec, ["item"], "inner", large)
    if mode == "din":
        tgt = vec.select(F.col("item").alias("target"), F.col("_v").alias("_t"))
        got = keyed_join(got, tgt, ["target"], "inner", large).withColumn("_s", dot(F.col("_v"), F.col("_t")))
    else:
        got = got.withColumn("_s", F.lit(0.0))
    packed = got.groupBy("row_id").agg(F.sort_array(F.collect_list(F.struct("_i", "_s", "_v"))).alias("_p"))
    top = F.array_max(F.transform("_p", lambda e: e["_s"]))
    weighed = packed.withColumn("_m", top).withColumn(
        "_p",
        F.transform("_p", lambda e: F.struct(F.exp(F.greatest(e["_s"] - F.col("_m"), F.lit(-30.0))).alias("w"), e["_v"].alias("v"))),
    )
    mass = F.aggregate("_p", F.lit(0.0), lambda acc, e: acc + e["w"])
    zero = F.transform(F.get("_p", F.lit(0))["v"], lambda _: F.lit(0.0))
    ctx = F.aggregate("_p", zero, lambda acc, e: _add(acc, F.transform(e["v"], lambda x: x * e["w"])))
    return weighed.select("row_id", mass.alias("_mass"), ctx.alias("_c")).select(
        "row_id", F.transform("_c", lambda x: x / (F.col("_mass") + 1e-9)).alias("context")
    )


# ---- losses ------------------------------------------------------------------------


def sigmoid(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-F.least(F.greatest(z, F.lit(-30.0)), F.lit(30.0))))


def logloss(scores: DataFrame, weight: str | None = None) -> DataFrame:
    p, y = sigmoid(F.col("score")), F.col("label").cast("double")
    bce = -(y * F.log(p + 1e-9) + (1.0 - y) * F.log(1.0 - p + 1e-9))
    if weight is None:
        return scores.agg(F.avg(bce).alias("loss"))
    w = F.col(weight)
    return scores.agg((F.sum(bce * w) / (F.sum(w) + 1e-6)).alias("loss"))


def pair_loss(pairs: DataFrame, scores: DataFrame, delta: str | None = None, weight: str | None = None) -> DataFrame:
    """-log sigmoid of the score margin over drawn pairs, weighted by the positive row and the pair's delta."""
    cols = ["score"] + ([weight] if weight else [])
    for side in ("pos", "neg"):
        names = [F.col("row_id").alias(f"{side}_row"), *[F.col(c).alias(f"_{c}_{side}") for c in cols]]
        pairs = pairs.join(scores.select(*names), f"{side}_row")
    w = (F.col(f"_{weight}_pos") if weight else F.lit(1.0)) * (F.col(delta) if delta else F.lit(1.0))
    margin = sigmoid(F.col("_score_pos") - F.col("_score_neg"))
    return pairs.agg((F.sum(-w * F.log(margin + 1e-9)) / F.sum(w)).alias("loss"))


def listwise_loss(scores: DataFrame) -> DataFrame:
    """Softmax cross-entropy per mixed user list, averaged over users. Lists are summarised, then joined
    back, so that no list has to fit in one task."""
    y = F.col("label").cast("double")
    head = scores.groupBy("user_id").agg(F.max("score").alias("_m"), F.sum(y).alias("_np"), F.count(F.lit(1)).alias("_n"))
    mixed = head.where((F.col("_n") >= 2) & (F.col("_np") > 0) & (F.col("_np") < F.col("_n")))
    large = has_large_group(scores, ["user_id"])
    e = keyed_join(scores, mixed, ["user_id"], "inner", large).withColumn("_e", F.exp(F.greatest(F.col("score") - F.col("_m"), F.lit(-30.0))))
    mass = e.groupBy("user_id").agg(F.sum("_e").alias("_z"))
    p = F.col("_e") / F.col("_z")
    per_user = keyed_join(e.where(F.col("label") == 1), mass, ["user_id"], "inner", large).groupBy("user_id").agg(
        F.sum(-F.log(p + 1e-9) / F.col("_np")).alias("_loss")
    )
    return per_user.agg(F.avg("_loss").alias("loss"), F.count(F.lit(1)).alias("n_lists"))


# Exponents of the complementary error function's fit in t = 1 / (1 + z / 2), constant first, with a
# relative error below 1.2e-7 everywhere.
ERFC = [
    -1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277,
]


def normal_tail(x: Column) -> Column:
    """Upper tail of the standard normal distribution."""
    z = F.abs(x) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.5 * z)
    power = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        power = power * t + c
    half = 0.5 * t * F.exp(power - z * z)
    return F.when(x >= 0, half).otherwise(1.0 - half)


def log_survival(x: Column) -> Column:
    """-ln of the normal upper tail, floored at 1e-6."""
    return -F.log(F.least(F.greatest(normal_tail(x), F.lit(1e-6)), F.lit(1.0)))


def watch_nll(df: DataFrame, pred: str) -> DataFrame:
    """Censored watch-time loss: half squared error, or -ln of the survival where the video was finished."""
    rows = df.select(F.col(pred).alias("_p"), *watch_targets())
    resid = F.col("_p") - F.col("y_log")
    loss = F.when(F.col("censored"), log_survival(F.col("c_log") - F.col("_p"))).otherwise(0.5 * resid * resid)
    return rows.agg(F.avg(loss).alias("loss"), F.avg(F.col("censored").cast("double")).alias("censored_share"))

"""Within-user ranking metrics, paired statistics, bootstrap and temporal halves.

Score tables carry (model_id, row_id, user_id, label, score[, date]); many models are one job.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.ordered import has_large_group, lower_bound, order_bounds, positions
from rankspark.session import shuffle_width

MODEL = ["model_id"]
HALF_BLOCK = 1 << 16  # row ids per block in which the border of the halves is looked up


def _ideal(n_pos: Column, k: int) -> Column:
    """Ideal DCG of a binary list: the first min(n_pos, k) discounts."""
    sums, total = [0.0], 0.0
    for i in range(k):
        total += 1.0 / math.log2(i + 2)
        sums.append(total)
    return F.get(F.lit(sums), F.least(n_pos, F.lit(k)).cast("int"))


def _finish(agg: DataFrame, k: int) -> DataFrame:
    n, pos = F.col("n"), F.col("n_pos")
    return agg.withColumn(
        "auc", F.when((pos > 0) & (pos < n), F.col("_wins") / (pos * (n - pos)))
    ).withColumn("ndcg", F.when(pos > 0, F.col("_dcg") / _ideal(pos, k)).otherwise(0.0)).drop("_wins", "_dcg")


def user_metrics(scores: DataFrame, by: list[str] = MODEL, k: int = 5, chunked: bool | None = None) -> DataFrame:
    """Per user: n, n_pos, AUC with mid-ranks (NULL for one-class lists) and nDCG@k."""
    keys = [*by, "user_id"]
    if chunked is None:
        chunked = has_large_group(scores, keys)
    gain = F.col("label").cast("double")
    if chunked:
        return _user_metrics_chunked(scores, keys, k)
    # One sort serves all: ranks and ties read a prefix of the first window's order, and mid-ranks from below are the list length plus one minus those from
    # above. The user leads the order, because two of its rows seldom meet in a comparison.
    placed = Window.partitionBy("user_id", *by).orderBy(F.col("score").desc(), "row_id")
    desc = Window.partitionBy("user_id", *by).orderBy(F.col("score").desc())
    peers = F.count(F.lit(1)).over(desc.rangeBetween(Window.currentRow, Window.currentRow))
    ordered = scores.select(*keys, "label", "score", F.row_number().over(placed).alias("_pos"))
    ranked = ordered.select(*keys, "label", "_pos", (F.rank().over(desc) + (peers - 1) / 2.0).alias("_mid"))
    pos, n = F.sum(gain), F.count(F.lit(1))
    agg = ranked.groupBy(*keys).agg(
        n.alias("n"),
        pos.alias("n_pos"),
        ((n + 1.0) * pos - F.sum(F.col("_mid") * gain) - pos * (pos + 1.0) / 2.0).alias("_wins"),
        F.sum(F.when(F.col("_pos") <= k, gain / F.log2(F.col("_pos") + 1.0)).otherwise(0.0)).alias("_dcg"),
    )
    return _finish(agg, k)


def _user_metrics_chunked(scores: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Same numbers when one user holds a large share of the rows: ties merge before the shuffle,
    score ranges are counted apart and carried, and the top k is cut on the map side."""
    gain = F.col("label").cast("double")
    bounds = order_bounds(scores, F.col("score"))
    cells = (
        scores.groupBy(*keys, "score")
        .agg(F.sum(gain).alias("p"), F.sum(1.0 - gain).alias("q"))
        .withColumn("_c", lower_bound(F.col("score"), bounds))
    )
    inner = Window.partitionBy(*keys, "_c").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("_w", F.col("p") * (F.coalesce(F.sum("q").over(inner), F.lit(0.0)) + F.col("q") / 2.0))
    chunks = local.groupBy(*keys, "_c").agg(F.sum("_w").alias("_w"), F.sum("p").alias("p"), F.sum("q").alias("q"))
    outer = Window.partitionBy(*keys).orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)
    carried = chunks.withColumn("_w", F.col("_w") + F.col("p") * F.coalesce(F.sum("q").over(outer), F.lit(0.0)))
    wins = carried.groupBy(*keys).agg(
        F.sum(F.col("p") + F.col("q")).cast("long").alias("n"), F.sum("p").alias("n_pos"), F.sum("_w").alias("_wins")
    )
    top = Window.partitionBy(*keys).orderBy(F.col("score").desc(), "row_id")
    dcg = (
        scores.select(*keys, gain.alias("_g"), F.row_number().over(top).alias("_pos"))
        .where(F.col("_pos") <= k)
        .groupBy(*keys)
        .agg(F.sum(F.col("_g") / F.log2(F.col("_pos") + 1.0)).alias("_dcg"))
    )
    return _finish(wins.join(dcg, keys), k)


def _weighted(weight: Column | None = None) -> list[Column]:
    """GAUC numerator/denominator, nDCG sum and user mass, optionally weighted per user."""
    w = F.lit(1.0) if weight is None else weight
    mixed = F.col("auc").isNotNull()
    return [
        F.sum(F.when(mixed, w * F.col("auc") * F.col("n_pos")).otherwise(0.0)).alias("_gn"),
        F.sum(F.when(mixed, w * F.col("n_pos")).otherwise(0.0)).alias("_gd"),
        F.sum(w * F.col("ndcg")).alias("_nn"),
        F.sum(w).alias("_nd"),
    ]


def _gauc() -> Column:
    return F.when(F.col("_gd") > 0, F.col("_gn") / F.col("_gd")).otherwise(0.5)


def _ndcg() -> Column:
    return F.when(F.col("_nd") > 0, F.col("_nn") / F.col("_nd")).otherwise(0.0)


def summarize_users(per_user: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """GAUC (positive-weighted over mixed users), mean nDCG over all users, and their mean."""
    return finish_summary(per_user.groupBy(*by).agg(F.count(F.lit(1)).alias("n_users"), *_weighted()), by)


def finish_summary(sums: DataFrame, by: list[str]) -> DataFrame:
    """Metrics from n_users and the sums of _weighted."""
    return sums.select(
        *by,
        "n_users",
        _gauc().alias("gauc"),
        _ndcg().alias("ndcg5"),
        ((_gauc() + _ndcg()) * 0.5).alias("primary"),
    )


def ranking_metrics(scores: DataFrame, by: list[str] = MODEL, chunked: bool | None = None) -> DataFrame:
    return summarize_users(user_metrics(scores, by, chunked=chunked), by)


def paired_users(per_user: DataFrame, incumbent: str) -> DataFrame:
    """Every other model's per-user metrics next to the incumbent's."""
    inc = per_user.where(F.col("model_id") == incumbent).select(
        "user_id", *[F.col(c).alias(f"{c}_inc") for c in ("n", "n_pos", "auc", "ndcg")]
    )
    return per_user.where(F.col("model_id") != incumbent).join(inc, "user_id")


def paired_signs(pairs: DataFrame) -> DataFrame:
    """Mean per-user delta, share and number of users improved or worsened, for nDCG and AUC."""
    d_nd = F.col("ndcg") - F.col("ndcg_inc")
    d_auc = F.col("auc") - F.col("auc_inc")

    def hits(cond: Column) -> Column:
        return F.coalesce(F.sum(cond.cast("long")), F.lit(0))

    return (
        pairs.groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("n_users"),
            F.avg(d_nd).alias("mean_user_delta"),
            hits(d_nd > 0).alias("n_users_pos"),
            hits(d_nd < 0).alias("n_users_neg"),
            F.count(d_auc).alias("n_auc_users"),
            F.coalesce(F.avg(d_auc), F.lit(0.0)).alias("mean_user_auc_delta"),
            hits(d_auc > 0).alias("n_auc_pos"),
            hits(d_auc < 0).alias("n_auc_neg"),
        )
        .withColumn("frac_users_positive", F.col("n_users_pos") / F.col("n_users"))
        .withColumn(
            "frac_users_auc_positive",
            F.when(F.col("n_auc_users") > 0, F.col("n_auc_pos") / F.col("n_auc_users")).otherwise(0.0),
        )
    )


def poisson_weights(users: DataFrame, replicates: int, seed: int) -> DataFrame:
    """One row per (user, replicate) with a reproducible Poisson(1) weight; weight-0 rows dropped.

    One digest serves four replicates: each takes its own 32 bits."""
    cumulative, p, total = [], math.exp(-1.0), 0.0
    for i in range(12):
        total += p
        cumulative.append(total)
        p /= i + 1
    block = users.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4))))
    digest = F.md5(F.concat_ws("|", F.col("user_id").cast("string"), F.lit(str(seed)), F.col("_b").cast("string")))
    hashed = block.withColumn("_h", digest)
    cells = [
        F.struct((F.col("_b") * 4 + q).alias("rep"), F.conv(F.substring("_h", 8 * q + 1, 8), 16, 10).cast("double").alias("u"))
        for q in range(4)
    ]
    draws = hashed.select(*users.columns, F.inline(F.array(*cells))).withColumn("u", F.col("u") / F.lit(4294967296.0))
    # Draws under the first bound have weight 0 and leave before the other bounds are compared.
    kept = draws.where((F.col("rep") < replicates) & (F.col("u") >= cumulative[0]))
    weight = sum([(F.col("u") >= c).cast("int") for c in cumulative[1:]], F.lit(1))
    return kept.select(*users.columns, "rep", weight.alias("w"))


def bootstrap_replicates(pairs: DataFrame, replicates: int = 500, seed: int = 0) -> DataFrame:
    """Δprimary of every resample, from per-user statistics only (no score rows are copied).

    A user's candidates travel together (one entry per model), so the weights are drawn once per user. The
    fixed partition count keeps small user tables from being merged into one task before they expand."""
    entry = F.struct("model_id", "n_pos", "auc", "ndcg", "n_pos_inc", "auc_inc", "ndcg_inc")
    placed = pairs.repartition(shuffle_width(pairs.sparkSession), "user_id")
    packed = placed.groupBy("user_id").agg(F.collect_list(entry).alias("_m"))
    drawn = poisson_weights(packed, replicates, seed).select("rep", "w", F.inline("_m"))
    w = F.col("w").cast("double")

    def sums(suffix: str) -> list[Column]:
        auc, pos, nd = F.col(f"auc{suffix}"), F.col(f"n_pos{suffix}"), F.col(f"ndcg{suffix}")
        mixed = auc.isNotNull()
        return [
            F.sum(F.when(mixed, w * auc * pos).otherwise(0.0)).alias(f"gn{suffix}"),
            F.sum(F.when(mixed, w * pos).otherwise(0.0)).alias(f"gd{suffix}"),
            F.sum(w * nd).alias(f"nn{suffix}"),
        ]

    agg = drawn.groupBy("model_id", "rep").agg(F.sum(w).alias("mass"), *sums(""), *sums("_inc"))

    def primary(suffix: str) -> Column:
        gauc = F.when(F.col(f"gd{suffix}") > 0, F.col(f"gn{suffix}") / F.col(f"gd{suffix}")).otherwise(0.5)
        return (gauc + F.col(f"nn{suffix}") / F.col("mass")) * 0.5

    return agg.select("model_id", "rep", (primary("") - primary("_inc")).alias("delta"))


def paired_bootstrap(pairs: DataFrame, replicates: int = 500, seed: int = 0, min_users: int = 8) -> DataFrame:
    """Paired user bootstrap of Δprimary: mean, SE (ddof 1) and the 95 % interval; NULL for models of fewer than min_users
    users, which stay in the result."""
    users = pairs.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_users"))
    enough = F.broadcast(users.where(F.col("n_users") >= min_users).select("model_id"))  # one row per compared model
    reps = bootstrap_replicates(pairs.join(enough, "model_id", "left_semi"), replicates, seed)
    stats = reps.groupBy("model_id").agg(
        F.stddev_samp("delta").alias("se_val_delta"),
        F.percentile("delta", F.lit(0.025)).alias("ci95_lo"),
        F.percentile("delta", F.lit(0.975)).alias("ci95_hi"),
        F.avg("delta").alias("mean_delta"),
        F.count(F.lit(1)).alias("replicates"),
    )
    return users.join(stats, "model_id", "left").select(*stats.columns, "n_users")


def with_halves(scores: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """Front/back half of each model's rows: cut at the number of rows dated up to the median date,
    or in the middle when that leaves a side under 16 rows; models under 32 rows are dropped. The broadcast
    tables hold one row per compared model.

    The last row of the front is looked up: blocks of row ids are counted, and only the block it lies in is ordered."""
    med = scores.groupBy(*by).agg(F.percentile("date", F.lit(0.5)).alias("_mid"), F.count(F.lit(1)).alias("_n"))
    block = F.floor(F.col("row_id") / HALF_BLOCK).cast("long")
    dated = scores.join(F.broadcast(med), by).where(F.col("_n") >= 32).withColumn("_k", block)
    cells = dated.groupBy(*by, "_k").agg(
        F.sum((F.col("date") <= F.col("_mid")).cast("long")).alias("_f"), F.count(F.lit(1)).alias("_rows"), F.first("_n").alias("_n")
    )
    whole, before = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    counted = cells.withColumns({"_f": F.coalesce(F.sum("_f").over(whole), F.lit(0)), "_past": F.coalesce(F.sum("_rows").over(before), F.lit(0))})
    uneven = (F.col("_f") < 16) | (F.col("_n") - F.col("_f") < 16)
    counted = counted.withColumn("_left", F.when(uneven, F.floor(F.col("_n") / 2).cast("long")).otherwise(F.col("_f")) - F.col("_past"))
    holds = counted.where((F.col("_left") >= 1) & (F.col("_left") <= F.col("_rows"))).select(*by, "_k", "_left")
    inside = scores.select(*by, "row_id", block.alias("_k")).join(F.broadcast(holds), [*by, "_k"])
    ranked = inside.withColumn("_at", F.row_number().over(Window.partitionBy(*by).orderBy("row_id")))
    last = ranked.where(F.col("_at") == F.col("_left")).select(*by, F.col("row_id").alias("_last"))
    return scores.join(F.broadcast(last), by).withColumn("half", F.when(F.col("row_id") <= F.col("_last"), "front").otherwise("back")).drop("_last")


def half_primaries(scores: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Primary of each half; NULL for models too small to be halved, which stay in the result."""
    per_half = ranking_metrics(with_halves(scores), ["model_id", "half"], chunked=chunked)
    halves = per_half.groupBy("model_id").agg(
        F.max(F.when(F.col("half") == "front", F.col("primary"))).alias("primary_front"),
        F.max(F.when(F.col("half") == "back", F.col("primary"))).alias("primary_back"),
    )
    return scores.select("model_id").distinct().join(halves, "model_id", "left")


def temporal_halves(scores: DataFrame, incumbent: str, chunked: bool | None = None) -> DataFrame:
    """Front and back Δprimary against the incumbent, and how far they disagree."""
    halves = half_primaries(scores, chunked)
    inc = halves.where(F.col("model_id") == incumbent).select(
        F.col("primary_front").alias("_f"), F.col("primary_back").alias("_b")
    )
    front, back = F.col("primary_front") - F.col("_f"), F.col("primary_back") - F.col("_b")
    return (
        halves.where(F.col("model_id") != incumbent)
        .crossJoin(F.broadcast(inc))  # one row
        .select(
            "model_id",
            front.alias("delta_front"),
            back.alias("delta_back"),
            F.abs(front - back).alias("temporal_disagree"),
        )
    )


def spearman(scores: DataFrame, incumbent: str) -> DataFrame:
    """Rank correlation with the incumbent over positional ranks; 1 for tiny or constant inputs."""
    ranked = positions(scores.select("model_id", "row_id", "score"), MODEL, "score", "rk", chunked=True)
    inc = ranked.where(F.col("model_id") == incumbent).select(
        "row_id", F.col("score").alias("_s"), F.col("rk").alias("_r")
    )
    agg = (
        ranked.where(F.col("model_id") != incumbent)
        .join(inc, "row_id")
        .groupBy("model_id")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.stddev_pop("score").alias("_sa"),
            F.stddev_pop("_s").alias("_sb"),
            F.corr(F.col("rk").cast("double"), F.col("_r").cast("double")).alias("_c"),
        )
    )
    flat = (F.col("_n") < 3) | (F.col("_sa") == 0) | (F.col("_sb") == 0)
    return agg.select("model_id", F.when(flat, 1.0).otherwise(F.col("_c")).alias("spearman"))


def top_lists(scores: DataFrame, k: int) -> DataFrame:
    """Ordered top-k row ids per model and user, for users with at least two rows."""
    top = Window.partitionBy("model_id", "user_id").orderBy(F.col("score").desc(), "row_id")
    picked = (
        scores.select("model_id", "user_id", "row_id", F.row_number().over(top).alias("_rn"))
        .where(F.col("_rn") <= k)
        .groupBy("model_id", "user_id")
        .agg(F.sort_array(F.collect_list(F.struct("_rn", "row_id"))).alias("_t"))
    )
    sized = scores.groupBy("model_id", "user_id").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= 2)
    return picked.join(sized.drop("_n"), ["model_id", "user_id"]).select(
        "model_id", "user_id", F.transform("_t", lambda e: e["row_id"]).alias("top")
    )


def topk_agreement(scores: DataFrame, incumbent: str, k: int = 1) -> DataFrame:
    """Share of users whose ordered top-k equals the incumbent's; 0 when no user has two rows."""
    tops = top_lists(scores, k)
    inc = tops.where(F.col("model_id") == incumbent).select("user_id", F.col("top").alias("_inc"))
    agree = (
        tops.where(F.col("model_id") != incumbent)
        .join(inc, "user_id")
        .groupBy("model_id")
        .agg(F.avg((F.col("top") == F.col("_inc")).cast("double")).alias("agree"))
    )
    models = scores.where(F.col("model_id") != incumbent).select("model_id").distinct()
    return models.join(agree, "model_id", "left").select(
        "model_id", F.coalesce("agree", F.lit(0.0)).alias(f"top{k}_agree")
    )


def align_scores(scores: DataFrame, models: list[str]) -> DataFrame:
    """One row per impression with a column per model; rows some model lacks are rejected."""
    wide = scores.groupBy("row_id").pivot("model_id", models).agg(F.first("score"))
    return wide.dropna(subset=models)


def alignment_counts(scores: DataFrame) -> DataFrame:
    """Rows per model and whether they cover exactly the common rows."""
    n_models = scores.agg(F.countDistinct("model_id").alias("_m"))
    common = (
        scores.groupBy("row_id").agg(F.countDistinct("model_id").alias("_k")).crossJoin(n_models)
        .agg(F.sum((F.col("_k") == F.col("_m")).cast("long")).alias("n_common"))
    )
    return (
        scores.groupBy("model_id").agg(F.count(F.lit(1)).alias("n_rows")).crossJoin(common)
        .withColumn("aligned", F.col("n_rows") == F.col("n_common"))
    )


def pairwise_auc(scores: DataFrame, by: list[str] = MODEL) -> DataFrame:
    """AUC by counting won (positive, negative) comparisons, on score counts rather than row pairs."""
    keys = [*by, "user_id"]
    cells = scores.groupBy(*keys, "score").agg(
        F.sum(F.col("label").cast("double")).alias("p"), F.sum(1.0 - F.col("label").cast("double")).alias("q")
    )
    below = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("p") * (F.coalesce(F.sum("q").over(below), F.lit(0.0)) + 0.5 * F.col("q"))
    return (
        cells.select(*keys, "p", "q", won.alias("_w"))
        .groupBy(*keys)
        .agg(F.sum("p").alias("n_pos"), F.sum("q").alias("n_neg"), F.sum("_w").alias("_w"))
        .select(
            *keys,
            "n_pos",
            F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0), F.col("_w") / (F.col("n_pos") * F.col("n_neg"))).alias("auc"),
        )
    )

"""Score scaling, rank averaging, blend search, diversity filter and model comparison."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group, positions
from rankspark.functions.scalars import log1p_score
from rankspark.operators import metrics as M
from rankspark.operators.itemcf import BLEND_GRID
from rankspark.session import cut_lineage, shuffle_width

# Fixed values of the fusion rules.
SWEEP_ALPHAS = [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]
SWEEP_GAMMAS = [0.0, 0.1, 0.2]
BLEND_SE = 2.0
TOO_SIMILAR = 0.98
REPRO_TOLERANCE = 0.001


def _scaled(df: DataFrame, by: list[str], aggs: list[Column]) -> DataFrame:
    """Attach per-group (or global, one-row) statistics."""
    if by:
        return keyed_join(df, df.groupBy(*by).agg(*aggs), by, "inner")
    return df.crossJoin(F.broadcast(df.agg(*aggs)))


def _zscored(df: DataFrame, cols: dict[str, str], by: list[str]) -> DataFrame:
    """Several columns standardised from one aggregation; 0 where a column is constant."""
    aggs = [f(c).alias(f"{p}{c}") for c in cols for f, p in ((F.avg, "_m_"), (F.stddev_pop, "_s_"))]
    out = _scaled(df, by, aggs)
    for c, name in cols.items():
        m, s = F.col(f"_m_{c}"), F.col(f"_s_{c}")
        out = out.withColumn(name, F.when(s < 1e-12, 0.0).otherwise((F.col(c) - m) / s))
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_m_", "_s_")])


def _ranged(df: DataFrame, cols: dict[str, str], by: list[str]) -> DataFrame:
    """Several columns scaled to [0, 1] from one aggregation; 0 where a column is constant."""
    aggs = [f(c).alias(f"{p}{c}") for c in cols for f, p in ((F.min, "_lo_"), (F.max, "_hi_"))]
    out = _scaled(df, by, aggs)
    for c, name in cols.items():
        lo, width = F.col(f"_lo_{c}"), F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        out = out.withColumn(name, F.when(width <= 1e-12, 0.0).otherwise((F.col(c) - lo) / width))
    return out.drop(*[f"{p}{c}" for c in cols for p in ("_lo_", "_hi_")])


def zscore(df: DataFrame, col: str, out: str, by: list[str] = []) -> DataFrame:
    return _zscored(df, {col: out}, by)


def minmax(df: DataFrame, col: str, out: str, by: list[str] = []) -> DataFrame:
    return _ranged(df, {col: out}, by)


def rank_average(scores: DataFrame, models: list[str] | None = None, groups: DataFrame | None = None,
                 chunked: bool | None = None) -> DataFrame:
    """Minus the mean zero-based descending position over models, per row. `groups` (model_id, identity) fuses several sets at once; a model may be in
    several and is ranked once."""
    picked = scores if models is None else scores.where(F.col("model_id").isin(models))
    if groups is not None:
        picked = picked.join(F.broadcast(groups.select("model_id").distinct()), "model_id", "left_semi")  # one row per compared model
    if chunked is None:
        chunked = has_large_group(picked, ["model_id", "user_id"])
    # Ranks and means of a user's rows are taken in one place; a user too large for one task is not gathered.
    placed = picked if chunked else picked.repartition("user_id")
    ranked = positions(placed, ["model_id", "user_id"], "score", "_p", descending=True, chunked=chunked)
    named = ranked.withColumn("_g", F.lit("fused")) if groups is None else ranked.join(
        F.broadcast(groups.select("model_id", F.col("identity").alias("_g"))), "model_id"
    )
    return (
        named.groupBy("_g", "user_id", "row_id")
        .agg(*[F.first(c).alias(c) for c in ("label", "date")], (-F.avg("_p")).alias("score"))
        .select(F.col("_g").alias("model_id"), "row_id", "user_id", "label", "score", "date")
    )


def pair_scores(scores: DataFrame, a: str, b: str) -> DataFrame:
    """Rows both models score, side by side as s_a and s_b."""
    left = scores.where(F.col("model_id") == a).select("row_id", "user_id", "label", "date", F.col("score").alias("s_a"))
    right = scores.where(F.col("model_id") == b).select("row_id", F.col("score").alias("s_b"))
    return left.join(right, "row_id")


def blend_score() -> Callable:
    """Score of (z1, z2, point) for columns or arrays, made anew so that it travels to workers by value."""
    return lambda z1, z2, point: (1.0 - point["alpha"]) * z1 + point["alpha"] * z2 + point["gamma"] * z1 * z2


def blend(z1: Column, z2: Column, alpha: Column, gamma: Column) -> Column:
    return blend_score()(z1, z2, {"alpha": alpha, "gamma": gamma})


def apply_blend(pairs: DataFrame, alpha: float, gamma: float) -> DataFrame:
    z = _ranged(pairs, {"s_a": "_z1", "s_b": "_z2"}, [])
    score = blend(F.col("_z1"), F.col("_z2"), F.lit(float(alpha)), F.lit(float(gamma)))
    return z.select("row_id", "user_id", "label", "date", score.alias("score"))


def _grid_sums(points: list[dict], score: Callable, by: list[str], k: int = 5) -> Callable:
    """Arrow batches of rows ordered by (*by, user_id, row_id) to sums over users, one row per key in by and grid point. Whole users are ranked together; only the
    rows of the last one wait for the next batch."""

    def changes(table: pa.Table, names: list[str]) -> np.ndarray:
        new = np.zeros(table.num_rows, dtype=bool)
        for c in names:
            codes = pc.dictionary_encode(table[c].combine_chunks(), null_encoding="encode").indices.to_numpy()
            new[1:] |= codes[1:] != codes[:-1]
        return new

    def order_class(column: pa.ChunkedArray) -> np.ndarray:
        """NaN before numbers before missing values, as Spark orders them downwards."""
        missing = pc.is_null(column).to_numpy()
        return np.where(missing, 2, np.where(np.isnan(column.to_numpy()), 0, 1))

    def sums(table: pa.Table) -> pa.RecordBatch:
        n = table.num_rows
        first = changes(table, [*by, "user_id"])
        first[0] = True
        user, starts = np.cumsum(first) - 1, np.flatnonzero(first)
        size = np.diff(np.append(starts, n))
        key_first = changes(table, by)
        key_first[0] = True
        key_rows = np.flatnonzero(key_first)
        key = (np.cumsum(key_first) - 1)[starts]
        gain = pc.fill_null(table["label"].cast(pa.float64()), 0.0).to_numpy()
        pos = np.bincount(user, weights=gain)
        mixed = (pos > 0) & (pos < size)
        ideal = np.array([0.0, *np.cumsum([1.0 / math.log2(i + 2) for i in range(k)])])[np.minimum(pos, k).astype(int)]
        place = np.arange(n) - starts[user]
        discount = np.where(place < k, 1.0 / np.log2(place + 2.0), 0.0)
        z1, z2 = table["_z1"].to_numpy(), table["_z2"].to_numpy()
        odd = np.maximum(order_class(table["_z1"]) == 2, order_class(table["_z2"]) == 2)
        found = []
        for point in points:
            value = score(z1, z2, point)
            kind = np.where(odd, 2, np.where(np.isnan(value), 0, 1))
            down = np.where(kind == 1, -value, 0.0)
            order = np.lexsort((down, kind, user))
            down, kind, got = down[order], kind[order], gain[order]
            tie = first.copy()
            tie[1:] |= (down[1:] != down[:-1]) | (kind[1:] != kind[:-1])
            runs = np.flatnonzero(tie)
            mid = (place[runs] + 1 + (np.diff(np.append(runs, n)) - 1) / 2.0)[np.cumsum(tie) - 1]
            wins = (size + 1) * pos - np.bincount(user, weights=mid * got) - pos * (pos + 1) / 2.0
            auc = np.divide(wins, pos * (size - pos), out=np.zeros(len(size)), where=mixed)
            dcg = np.bincount(user, weights=got * discount)
            ndcg = np.divide(dcg, ideal, out=np.zeros(len(size)), where=pos > 0)
            cells = [np.where(mixed, auc * pos, 0.0), np.where(mixed, pos, 0.0), ndcg]
            found.append([np.bincount(key, weights=c, minlength=len(key_rows)) for c in cells])
        keys = table.select(by).take(pa.array(np.tile(key_rows, len(points))))
        gn, gd, nn = [pa.array(np.concatenate([f[i] for f in found])) for i in range(3)]
        users = pa.array(np.tile(np.bincount(key, minlength=len(key_rows)), len(points)), pa.int64())
        at = pa.array(np.repeat([p["grid_idx"] for p in points], len(key_rows)), pa.int32())
        columns = [*[keys[c].combine_chunks() for c in by], at, users, gn, gd, nn, users.cast(pa.float64())]
        return pa.RecordBatch.from_arrays(columns, names=[*by, "grid_idx", "n_users", "_gn", "_gd", "_nn", "_nd"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.Table] = []
        for batch in batches:
            table = pa.Table.from_batches([batch])
            if not table.num_rows:
                continue
            ends = waiting[-1].slice(waiting[-1].num_rows - 1) if waiting else table.slice(0, 0)
            new = changes(pa.concat_tables([ends, table]), [*by, "user_id"])[ends.num_rows:]
            cuts = np.flatnonzero(new)
            if len(cuts) == 0:
                waiting.append(table)
                continue
            done = pa.concat_tables([*waiting, table.slice(0, int(cuts[-1]))])
            yield sums(done)
            waiting = [table.slice(int(cuts[-1]))]
        if waiting:
            yield sums(pa.concat_tables(waiting))

    return run


def grid_metrics(rows: DataFrame, points: list[dict], score: Callable, chunked: bool | None = None, by: list[str] = []) -> DataFrame:
    """Ranking metrics of one score, a function of (_z1, _z2, point), at every grid point (`grid_idx` plus its parameters), apart for each key in by. Rows are
    placed by user first and every user is ranked at all points where it lies, so no expanded row exists. A user too large for one task takes the chunked plan."""
    if chunked is None:
        chunked = has_large_group(rows, [*by, "user_id"])
    spark = rows.sparkSession
    grid = F.broadcast(spark.createDataFrame([tuple(p.values()) for p in points], ", ".join(f"{c} {'int' if c == 'grid_idx' else 'double'}" for c in points[0])))
    if chunked:
        value = score(F.col("_z1"), F.col("_z2"), {c: F.col(c) for c in points[0]})
        wide = rows.crossJoin(grid).select(*by, "grid_idx", "user_id", "row_id", "label", value.alias("score"))  # a few dozen fixed rows
        return M.ranking_metrics(wide, [*by, "grid_idx"], chunked=True).join(grid, "grid_idx")
    placed = rows.repartition(shuffle_width(spark), "user_id").sortWithinPartitions(*by, "user_id", "row_id")
    cells = placed.select(*by, "user_id", "label", *[F.col(c).cast("double").alias(c) for c in ("_z1", "_z2")])
    fields = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], "grid_idx int, n_users long, _gn double, _gd double, _nn double, _nd double"])
    found = cells.mapInArrow(_grid_sums(points, score, by), fields)
    return M.finish_summary(found.groupBy(*by, "grid_idx").agg(*[F.sum(c).alias(c) for c in ("n_users", "_gn", "_gd", "_nn", "_nd")]), [*by, "grid_idx"]).join(
        grid, "grid_idx"
    )


def sweep_grid() -> list[dict]:
    return [{"grid_idx": i * len(SWEEP_GAMMAS) + j, "alpha": a, "gamma": g} for i, a in enumerate(SWEEP_ALPHAS) for j, g in enumerate(SWEEP_GAMMAS)]


def sweep_metrics(pairs: DataFrame, chunked: bool | None = None) -> DataFrame:
    z = _ranged(pairs, {"s_a": "_z1", "s_b": "_z2"}, [])
    return grid_metrics(z.select("row_id", "user_id", "label", "_z1", "_z2"), sweep_grid(), blend_score(), chunked)


def first_best(df: DataFrame, value: str, order: str) -> DataFrame:
    """The row with the largest value, the earliest on ties."""
    cols = df.columns
    return df.agg(F.max_by(F.struct(*cols), F.struct(F.col(value), -F.col(order))).alias("_r")).select("_r.*")


def sweep_blend(pairs: DataFrame, chunked: bool | None = None) -> DataFrame:
    best = first_best(sweep_metrics(pairs, chunked), "primary", "grid_idx")
    return best.select(
        F.col("alpha").alias("blend_alpha"), F.col("gamma").alias("blend_gamma"), F.col("primary").alias("blend_primary")
    )


def alpha_metrics(rows: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Metrics of z(s_a) + alpha * z(log1p(s_b)) for every alpha of the fixed grid."""
    z = _zscored(rows.withColumn("_lb", log1p_score("s_b")), {"s_a": "_z1", "_lb": "_z2"}, [])
    points = [{"grid_idx": i, "alpha": a} for i, a in enumerate(BLEND_GRID)]
    return grid_metrics(z.select("row_id", "user_id", "label", "_z1", "_z2"), points, lambda z1, z2, p: z1 + p["alpha"] * z2, chunked)


def pick_alpha(rows: DataFrame, chunked: bool | None = None) -> DataFrame:
    best = first_best(alpha_metrics(rows, chunked), "primary", "grid_idx")
    return best.select("alpha", "gauc", "ndcg5", "primary")


# ---- diversity ---------------------------------------------------------------------


def model_agreements(scores: DataFrame, models: list[str], ks: tuple[int, ...] = (1, 2)) -> DataFrame:
    """Top-k agreement of every pair of the listed candidate models (the list is the caller's, and short)."""
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    out = None
    for k in ks:
        tops = M.top_lists(scores.where(F.col("model_id").isin(models)), k).withColumn("_i", order[F.col("model_id")])
        left = tops.select("user_id", F.col("model_id").alias("left_id"), F.col("_i").alias("_a"), F.col("top").alias("_ta"))
        right = tops.select("user_id", F.col("model_id").alias("right_id"), F.col("_i").alias("_b"), F.col("top").alias("_tb"))
        agree = (
            left.join(right, "user_id")
            .where(F.col("_a") < F.col("_b"))
            .groupBy("left_id", "right_id")
            .agg(F.avg((F.col("_ta") == F.col("_tb")).cast("double")).alias(f"top{k}_agree"))
        )
        out = agree if out is None else out.join(agree, ["left_id", "right_id"])
    return out


def keep_distinct(similar: DataFrame, models: list[str]) -> DataFrame:
    """Greedy pass over the ordered models: keep one unless it is too similar to a kept one.

    `similar` lists the (left_id, right_id) pairs that are too close, the better model left. In each round a model is dropped once a better neighbour is kept, and kept once
    all better neighbours are dropped, so no pair table and no list of kept models ever meets in one row. The best undecided model is decided in every round."""
    spark = similar.sparkSession
    place = spark.createDataFrame([(m, i) for i, m in enumerate(models)], "model_id string, _i int")
    a, b = [place.select(F.col("model_id").alias(c), F.col("_i").alias(f"_{c}")) for c in ("left_id", "right_id")]
    edges = cut_lineage(similar.join(a, "left_id").join(b, "right_id").where("_left_id < _right_id").select("left_id", "right_id").distinct())
    state = place.select("model_id", F.lit(None).cast("boolean").alias("kept"))
    while True:
        better = edges.join(state.select(F.col("model_id").alias("left_id"), F.col("kept").alias("_k")), "left_id").groupBy("right_id").agg(
            F.bool_or(F.coalesce("_k", F.lit(False))).alias("_lost"), F.bool_and(F.coalesce(~F.col("_k"), F.lit(False))).alias("_free")
        )
        seen = state.join(better.withColumnRenamed("right_id", "model_id"), "model_id", "left")
        decided = F.when(F.coalesce("_lost", F.lit(False)), False).when(F.coalesce("_free", F.lit(True)), True)
        state = cut_lineage(seen.select("model_id", F.coalesce("kept", decided).alias("kept")))
        if state.where("kept IS NULL").isEmpty():
            return state


def diversity_filter(scores: DataFrame, models: list[str], limit: float = TOO_SIMILAR) -> DataFrame:
    pairs = model_agreements(scores, models)
    return keep_distinct(pairs.where((F.col("top1_agree") > limit) & (F.col("top2_agree") > limit)), models)


def model_correlations(scores: DataFrame, models: list[str]) -> DataFrame:
    """Rank correlation of every pair of the listed models; each pack is ranked once and all pairs are one grouped job."""
    order = F.create_map(*[x for i, m in enumerate(models) for x in (F.lit(m), F.lit(i))])
    listed = scores.where(F.col("model_id").isin(models)).select("model_id", "row_id", "score")
    ranked = cut_lineage(positions(listed, ["model_id"], "score", "rk", chunked=True).withColumn("_i", order[F.col("model_id")]))
    left, right = [
        ranked.select("row_id", F.col("model_id").alias(f"{c}_id"), F.col("score").alias(f"_s{c}"), F.col("rk").cast("double").alias(f"_r{c}"), F.col("_i").alias(f"_i{c}"))
        for c in ("left", "right")
    ]
    agg = left.join(right, "row_id").where("_ileft < _iright").groupBy("left_id", "right_id").agg(
        F.count(F.lit(1)).alias("_n"), F.stddev_pop("_sleft").alias("_sa"), F.stddev_pop("_sright").alias("_sb"), F.corr("_rright", "_rleft").alias("_c")
    )
    flat = (F.col("_n") < 3) | (F.col("_sa") == 0) | (F.col("_sb") == 0)
    return agg.select("left_id", "right_id", F.when(flat, 1.0).otherwise(F.col("_c")).alias("spearman"))


def spearman_filter(scores: DataFrame, models: list[str], limit: float = TOO_SIMILAR) -> DataFrame:
    """The same filter on rank correlation, for score packs without users."""
    return keep_distinct(model_correlations(scores, models).where(F.col("spearman") > limit), models)


# ---- comparison and decisions over score packs -------------------------------------


def compare_all(scores: DataFrame, incumbent: str, replicates: int = 500, chunked: bool | None = None) -> DataFrame:
    """One row per candidate: paired statistics, rank agreement, metric deltas, bootstrap and halves."""
    if chunked is None:
        chunked = has_large_group(scores, ["model_id", "user_id"])
    per_user = M.user_metrics(scores, chunked=chunked)
    pairs = M.paired_users(per_user, incumbent)
    metrics = M.summarize_users(per_user)
    inc = metrics.where(F.col("model_id") == incumbent).select(
        F.col("primary").alias("_p"), F.col("gauc").alias("_g"), F.col("ndcg5").alias("_n")
    )
    deltas = (
        metrics.where(F.col("model_id") != incumbent)
        .crossJoin(F.broadcast(inc))
        .select(
            "model_id",
            "primary",
            (F.col("primary") - F.col("_p")).alias("delta_primary"),
            (F.col("gauc") - F.col("_g")).alias("delta_gauc"),
            (F.col("ndcg5") - F.col("_n")).alias("delta_ndcg"),
        )
    )
    boot = M.paired_bootstrap(pairs, replicates).select("model_id", "se_val_delta", "ci95_lo", "ci95_hi")
    parts = [
        deltas,
        M.paired_signs(pairs),
        M.spearman(scores, incumbent),
        M.topk_agreement(scores, incumbent, 1),
        boot,
        M.temporal_halves(scores, incumbent, chunked),
    ]
    return reduce(lambda a, b: a.join(b, "model_id", "left"), parts)


def beats_bag(blend_primary: Column, bag_primary: Column, se: Column) -> Column:
    """A scanned blend counts only two standard errors above the bag; no SE means no."""
    return F.coalesce((se > 0) & (blend_primary > bag_primary + BLEND_SE * se), F.lit(False))


def fuse_and_check(scores: DataFrame, models: list[str], expected: float, tol: float = REPRO_TOLERANCE,
                   chunked: bool | None = None) -> DataFrame:
    """Metrics of the fused members and whether they reproduce the value seen during search."""
    out = M.ranking_metrics(rank_average(scores, models, chunked=chunked), chunked=chunked)
    drift = F.abs(F.col("primary") - F.lit(float(expected)))
    return out.withColumn("drift", drift).withColumn("status", F.when(drift > tol, "drift").otherwise("ok"))


def paired_sides(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows both models of a pair score, side by side as s_a and s_b. `pairs` (pair, left_id, right_id) has at most one row per compared model."""
    few = F.broadcast(pairs)
    left = scores.join(few.withColumnRenamed("left_id", "model_id"), "model_id").select(
        "pair", "row_id", "user_id", "label", "date", F.col("score").alias("s_a")
    )
    right = scores.join(few.withColumnRenamed("right_id", "model_id"), "model_id").select("pair", "row_id", F.col("score").alias("s_b"))
    return left.join(right, ["pair", "row_id"])


def search_pairs(scores: DataFrame, pairs: DataFrame, replicates: int = 500, chunked: bool | None = None) -> DataFrame:
    """The best blend of every pair against its left model: pair, blend_alpha, blend_gamma, blend_primary, bag_primary, se_val_delta, ci95_lo, ci95_hi and
    robust (the weaker half). Sweep, bootstrap and halves are grouped by pair, so the number of jobs does not follow the number of pairs."""
    if chunked is None:
        chunked = has_large_group(scores, ["model_id", "user_id"])
    sides = cut_lineage(_ranged(paired_sides(scores, pairs), {"s_a": "_z1", "s_b": "_z2"}, ["pair"]))
    score = blend(F.col("_z1"), F.col("_z2"), F.col("alpha"), F.col("gamma"))
    swept = grid_metrics(sides.select("pair", "row_id", "user_id", "label", "_z1", "_z2"), sweep_grid(), blend_score(), chunked, ["pair"])
    best = F.max_by(F.struct("alpha", "gamma"), F.struct("primary", -F.col("grid_idx")))
    points = cut_lineage(swept.groupBy("pair").agg(best.alias("_p")).select("pair", "_p.alpha", "_p.gamma"))
    mixed = sides.join(F.broadcast(points), "pair").withColumn("score", score)  # one row per pair
    columns = ["pair", "row_id", "user_id", "label", "date", "score"]
    both = mixed.select(*columns, F.lit("blend").alias("side")).unionByName(
        sides.withColumn("score", F.col("s_a")).select(*columns, F.lit("bag").alias("side"))
    )
    per_user = cut_lineage(M.user_metrics(both, ["pair", "side"], chunked=chunked))
    total = M.summarize_users(per_user, ["pair", "side"])

    def value(side: str, name: str) -> DataFrame:
        return total.where(F.col("side") == side).select("pair", F.col("primary").alias(name))

    own = per_user.where("side = 'blend'").select(F.col("pair").alias("model_id"), "user_id", "n_pos", "auc", "ndcg")
    base = per_user.where("side = 'bag'").select(
        F.col("pair").alias("model_id"), "user_id", *[F.col(c).alias(f"{c}_inc") for c in ("n_pos", "auc", "ndcg")]
    )
    boot = M.paired_bootstrap(own.join(base, ["model_id", "user_id"]), replicates).select(
        F.col("model_id").alias("pair"), "se_val_delta", "ci95_lo", "ci95_hi"
    )
    halves = M.half_primaries(mixed.select(F.col("pair").alias("model_id"), *columns[1:]), chunked).select(
        F.col("model_id").alias("pair"), F.least("primary_front", "primary_back").alias("robust")
    )
    parts = [value("blend", "blend_primary"), value("bag", "bag_primary"), boot, halves]
    named = points.select("pair", F.col("alpha").alias("blend_alpha"), F.col("gamma").alias("blend_gamma"))
    return reduce(lambda x, y: x.join(y, "pair", "left"), parts, named)


def complementary_blend(scores: DataFrame, members: DataFrame, replicates: int = 500,
                        chunked: bool | None = None) -> DataFrame:
    """Best identity bag blended with its least-agreeing partner; accepted only two SE above the bag. One row, none with fewer than two identities.

    `members` maps model_id to (identity, primary). Best identity and partner stay rows of tables and are never read by the driver."""
    if chunked is None:
        chunked = has_large_group(scores, ["model_id", "user_id"])
    means = members.groupBy("identity").agg(F.avg("primary").alias("_m"))
    best = cut_lineage(means.agg(F.min_by("identity", F.struct(-F.col("_m"), F.col("identity"))).alias("best_identity")))
    # Several jobs read the bags, so they are written once.
    bags = cut_lineage(rank_average(scores, groups=members, chunked=chunked))
    one = F.broadcast(best)  # one row
    tops = M.top_lists(bags, 1).crossJoin(one)
    lead = tops.where(F.col("model_id") == F.col("best_identity")).select("user_id", F.col("top").alias("_inc"))
    agree = (
        tops.where(F.col("model_id") != F.col("best_identity")).join(lead, "user_id").groupBy("model_id").agg(F.avg((F.col("top") == F.col("_inc")).cast("double")).alias("_g"))
    )
    others = bags.select("model_id").distinct().crossJoin(one).where(F.col("model_id") != F.col("best_identity"))
    scored = others.join(agree, "model_id", "left").withColumn("_g", F.coalesce("_g", F.lit(0.0)))
    least = F.min_by(F.struct(F.col("model_id").alias("partner"), F.col("_g").alias("blend_top1")), F.struct("_g", "model_id"))
    pair = cut_lineage(scored.groupBy("best_identity").agg(least.alias("_p")).select("best_identity", "_p.partner", "_p.blend_top1"))
    found = search_pairs(bags, pair.select(F.lit("blend").alias("pair"), F.col("best_identity").alias("left_id"), F.col("partner").alias("right_id")), replicates, chunked)
    ok = beats_bag(F.col("blend_primary"), F.col("bag_primary"), F.col("se_val_delta"))
    return found.crossJoin(F.broadcast(pair)).select(  # one row
        "best_identity", "partner", "blend_top1", "bag_primary", "blend_primary", "se_val_delta", "ci95_lo", "ci95_hi",
        ok.alias("accepted"),
        F.when(ok, F.col("blend_alpha")).otherwise(0.0).alias("blend_alpha"),
        F.when(ok, F.col("blend_gamma")).otherwise(0.0).alias("blend_gamma"),
    )

"""Promotion gates and final selection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group
from rankspark.operators import fusion as B
from rankspark.operators import metrics as M
from rankspark.operators.ledger import COMPLEMENT_DELTA, EPSILON, NEAR_TOP_EPS, RUN, best_node, is_good, is_timeout, own_config, submit_score, yes
from rankspark.session import cut_lineage

# ---- fixed values ----
SCREEN_DELTA = 0.001
SCREEN_GAUC = 0.0008
NEAR_DUPLICATE = 0.97
HARD_SE = 4.0
SIGN_SE = 2.0
METRIC_TOLERANCE = 1e-4
# ----------------------


def temporal_unstable() -> Column:
    """The halves disagree by more than 4 SE, or by more than 2 SE with opposite signs."""
    se, gap = F.col("se_val_delta"), F.col("temporal_disagree")
    opposite = F.col("delta_front") * F.col("delta_back") < 0
    return yes((se > 0) & ((gap > HARD_SE * se) | yes(opposite & (gap > SIGN_SE * se))))


def screen(cmp: DataFrame) -> DataFrame:
    """One-seed screen with its reason; the checks apply in order."""
    weakest = F.least("delta_front", "delta_back")
    both = F.col("delta_front").isNotNull() & F.col("delta_back").isNotNull()
    passed = (F.coalesce("delta_primary", F.lit(0.0)) >= SCREEN_DELTA) & (F.coalesce("delta_gauc", F.lit(0.0)) >= SCREEN_GAUC)
    reason = (
        F.when(~is_good(), "buggy")
        .when(yes(F.col("top1_agree") > NEAR_DUPLICATE), "near duplicate")
        .when(temporal_unstable(), "unstable over time")
        .when(both & (weakest < SCREEN_DELTA), "a half misses")
        .when(yes(F.col("ci95_lo") <= 0), "interval covers zero")
        .when(yes(F.col("delta_ndcg") < 0), "ndcg down")
        .when(passed, "passed")
        .otherwise("missed")
    )
    return cmp.withColumn("reason", reason).withColumn("screen_ok", F.col("reason") == "passed")


def confirm(cmp: DataFrame) -> DataFrame:
    """Seed confirmation: `is_winner`, `n_pos_seeds`, `n_seeds` and `delta` decide; all-positive results below
    epsilon are weak."""
    n, pos, d = F.col("n_seeds"), F.col("n_pos_seeds"), F.col("delta")
    reason = (
        F.when(is_timeout(), "partial")
        .when(~yes("is_winner"), "not winner")
        .when(n < 3, "need 3 seeds")
        .when(pos == n, "all seeds agree")
        .when((d >= EPSILON) & (pos > n / 2), "majority above epsilon")
        .otherwise("mixed")
    )
    out = cmp.withColumn("reason", reason)
    out = out.withColumn("promote", F.col("reason").isin("all seeds agree", "majority above epsilon"))
    return out.withColumn("weak", (F.col("reason") == "all seeds agree") & (F.abs(d) < EPSILON))


def promote_ensemble(cmp: DataFrame) -> DataFrame:
    """Bag or blend promotion against `bar`; scanned blends must clear their bag by two standard errors."""
    delta = F.coalesce(F.col("primary") - F.col("bar"), F.lit(0.0))
    gauc = F.coalesce("delta_gauc", F.lit(0.0))
    scanned = F.coalesce("ensemble_kind", F.lit("same_config")).isin("complementary", "cross_identity") | (
        F.coalesce("blend_alpha", F.lit(0.0)) != 0
    )
    bag = F.coalesce("blend_bag_primary", "bar") if "blend_bag_primary" in cmp.columns else F.col("bar")
    clears = B.beats_bag(F.col("primary"), bag, F.col("se_val_delta"))
    reason = (
        F.when(F.col("primary").isNull(), "no metrics")
        .when(scanned & ~clears, "blend inside noise")
        .when(yes(F.col("ci95_lo") <= 0), "interval covers zero")
        .when((delta >= 0) & (gauc >= 0), "no loss")
        .when(delta >= EPSILON, "gain above epsilon")
        .otherwise("no gain")
    )
    return cmp.withColumn("reason", reason).withColumn("promote", F.col("reason").isin("no loss", "gain above epsilon"))


def overturns(ledger: DataFrame) -> DataFrame:
    """Nodes whose submit score exceeds the incumbent's."""
    inc = best_node(ledger).select(RUN, F.col("node_id").alias("incumbent"), F.col("submit").alias("_s"))
    return (
        keyed_join(ledger.withColumn("submit", submit_score()).select(RUN, "node_id", "submit"), inc, [RUN], "inner")
        .where((F.col("node_id") != F.col("incumbent")) & (F.col("submit") > F.col("_s")))
        .select(RUN, "node_id", "incumbent", "submit")
    )


def reconcile_metrics(claimed: DataFrame, scores: DataFrame, tol: float = METRIC_TOLERANCE) -> DataFrame:
    """Claimed primary against the one recomputed from the score pack."""
    trusted = M.ranking_metrics(scores).select("model_id", F.col("primary").alias("trusted"))
    status = (
        F.when(F.col("trusted").isNull(), "no scores")
        .when(yes(F.abs(F.col("claimed") - F.col("trusted")) > tol), "mismatch")
        .otherwise("ok")
    )
    return claimed.join(trusted, "model_id", "left").withColumn("status", status)


def pick_candidate(cands: DataFrame, eps: float = EPSILON) -> DataFrame:
    """Within eps of the best robust score: fewest flags, then the best score, then the best robust score."""
    best = cands.agg(F.max("robust").alias("_b"))
    near = cands.crossJoin(F.broadcast(best)).where(F.col("robust") >= F.col("_b") - eps)
    cols = [c for c in cands.columns]
    return near.agg(F.max_by(F.struct(*cols), F.struct(-F.col("n_flags"), "score", "robust")).alias("_r")).select("_r.*")


def identity_bags(scores: DataFrame, members: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Rank-averaged scores of every identity with at least two seed packs, written once."""
    enough = members.groupBy("identity").agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 2)
    return cut_lineage(B.rank_average(scores, groups=members.join(enough, "identity"), chunked=chunked))


def bag_candidates(bags: DataFrame, members: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Per identity bag: primary, robust (weaker half) score and flag count.

    `members` maps model_id to (identity, config)."""
    configs = members.groupBy("identity").agg(F.first("config").alias("config"))
    primary = M.ranking_metrics(bags, chunked=chunked).select("model_id", F.col("primary").alias("score"))
    halves = M.half_primaries(bags, chunked).select("model_id", F.least("primary_front", "primary_back").alias("robust"))
    return (
        primary.join(halves, "model_id", "left")
        .join(configs.select(F.col("identity").alias("model_id"), "config"), "model_id")
        .select(
            F.col("model_id").alias("candidate"),
            "score",
            F.coalesce("robust", "score").alias("robust"),
            E.extra_flag_count("config").alias("n_flags"),
            F.lit("bag").alias("kind"),
        )
    )


def candidate_pairs(members: DataFrame, bags: DataFrame) -> DataFrame:
    """(pair, left_id, right_id, n_flags): the best bag with every other in the window that shares no leak-prone flag with it. The window is narrow where two bags are
    close to the best, else wide."""
    best = bags.agg(F.min_by(F.struct("candidate", "score"), F.struct(-F.col("score"), F.col("candidate"))).alias("_t"))
    near = bags.crossJoin(F.broadcast(best)).agg(
        F.first("_t").alias("_t"), F.sum((F.col("score") >= F.col("_t.score") - NEAR_TOP_EPS).cast("long")).alias("_near")
    )
    window = F.when(F.col("_near") >= 2, NEAR_TOP_EPS).otherwise(COMPLEMENT_DELTA)
    configs = members.groupBy("identity").agg(F.first("config").alias("config"))
    others = bags.crossJoin(F.broadcast(near)).where(  # one row
        (F.col("candidate") != F.col("_t.candidate")) & (F.col("score") >= F.col("_t.score") - window)
    ).select(F.col("_t.candidate").alias("left_id"), F.col("candidate").alias("right_id"))
    a, b = [configs.select(F.col("identity").alias(i), F.col("config").alias(c)) for i, c in (("left_id", "_a"), ("right_id", "_b"))]
    return others.join(a, "left_id").join(b, "right_id").where(~E.leak_overlap("_a", "_b")).select(
        F.concat_ws("+", "left_id", "right_id").alias("pair"), "left_id", "right_id", E.extra_flag_count(E.overlay("_a", "_b")).alias("n_flags")
    )


def blend_candidates(fused: DataFrame, members: DataFrame, bags: DataFrame, chunked: bool | None = None) -> DataFrame:
    """Blends of candidate_pairs that clear the best bag by two standard errors; all pairs are searched together."""
    pairs = cut_lineage(candidate_pairs(members, bags))
    found = B.search_pairs(fused, pairs.drop("n_flags"), chunked=chunked).join(pairs.select("pair", "n_flags"), "pair")
    best = bags.agg(F.max("score").alias("_b"))
    kept = found.crossJoin(F.broadcast(best)).where(B.beats_bag(F.col("blend_primary"), F.col("_b"), F.col("se_val_delta")))
    return kept.select(
        F.col("pair").alias("candidate"), F.col("blend_primary").alias("score"), F.coalesce("robust", "blend_primary").alias("robust"), "n_flags",
        F.lit("blend").alias("kind"),
    )


def ensemble_candidates(ledger: DataFrame, bags: DataFrame) -> DataFrame:
    """Ensemble nodes of the ledger by the score they recorded. Those over several configs must clear the best bag by two standard errors."""
    best = bags.agg(F.max("score").alias("_b"))
    nodes = ledger.where((F.col("stage") == "ensemble") & F.col("primary").isNotNull() & ~F.col("is_skip")).crossJoin(F.broadcast(best))
    clears = B.beats_bag(F.col("primary"), F.col("_b"), F.col("se_val_delta"))
    kept = nodes.where((F.coalesce("ensemble_kind", F.lit("same_config")) == "same_config") | clears)
    return kept.join(own_config(ledger), [RUN, "node_id"]).select(
        F.col("node_id").cast("string").alias("candidate"), F.col("primary").alias("score"), F.col("primary").alias("robust"),
        F.coalesce(E.extra_flag_count("own_config"), F.lit(0)).alias("n_flags"), F.lit("node").alias("kind"),
    )


def final_candidates(scores: DataFrame, members: DataFrame, ledger: DataFrame | None = None, chunked: bool | None = None) -> DataFrame:
    """Everything the submission is picked from: candidate, score, robust, n_flags, kind. Seed bags, admissible blends and, where a ledger is given, its
    ensemble nodes."""
    if chunked is None:
        chunked = has_large_group(scores, ["model_id", "user_id"])
    fused = identity_bags(scores, members, chunked)
    bags = cut_lineage(bag_candidates(fused, members, chunked))
    out = bags.unionByName(blend_candidates(fused, members, bags, chunked))
    return out if ledger is None else out.unionByName(ensemble_candidates(ledger, bags))


def pick_final(scores: DataFrame, members: DataFrame, eps: float = EPSILON, chunked: bool | None = None, ledger: DataFrame | None = None) -> DataFrame:
    """The submission: by robust score, parsimony and score. The candidates, one row per identity, pair and ensemble node, are written once."""
    return pick_candidate(cut_lineage(final_candidates(scores, members, ledger, chunked)), eps)

"""Queries over append-only trial ledgers; `run_id` separates runs, `seq` is the order inside a run.

Runs are summarised with aggregations (max_by, min_by, conditional counts), not by gathering a run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group, positions, running_records, value_prefix_sums
from rankspark.session import cut_lineage, group_rows

RUN = "run_id"

# ---- fixed values ----
NON_SEED_STAGES = ["ensemble", "eda", "debug", "finalize", "research", "read_paper", "diagnose"]
FREE_STAGES = ["eda", "ablate", "research", "read_paper"]
UNBILLED_STREAK_STAGES = ["eda", "research", "read_paper", "diagnose", "ablate"]
TIMEOUT_STATES = ["timeout", "partial"]
EPSILON = 0.002
NEAR_TOP_EPS = 0.002
COMPLEMENT_DELTA = 0.03
MAX_CROSSOVERS = 3
SCALES = ["pure", "1k", "27k"]
# ----------------------


def yes(c) -> Column:
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(False))


def ablate_child() -> Column:
    return (F.col("stage") == "improve") & (F.col("arm") == "ablate")


def is_timeout() -> Column:
    return yes("partial") | yes(F.col("exec_status").isin(TIMEOUT_STATES))


def is_good() -> Column:
    return ~F.col("is_buggy") & F.col("primary").isNotNull()


def usable_seed() -> Column:
    return is_good() & ~is_timeout() & ~F.col("is_skip") & F.col("seed").isNotNull()


def is_billed() -> Column:
    """Steps that consume the trial budget: bags, profiling and ablation children are free."""
    return ~(F.col("stage").isin("eda", "ensemble") | ablate_child())


def is_falsified() -> Column:
    return yes(F.col("ci95_hi") < 0) & F.col("delta_primary").isNotNull()


def submit_score() -> Column:
    """Bag or blend primary, else the confirmed mean, else the node's own primary."""
    bag = (F.col("stage") == "ensemble") | (F.coalesce(F.size("members"), F.lit(0)) > 0)
    return F.coalesce(F.when(bag, F.col("primary")), F.col("confirmed_mean"), F.col("primary"))


def has_members() -> Column:
    return F.coalesce(F.size("members"), F.lit(0)) > 0


def leaves(ledger: DataFrame) -> DataFrame:
    """Nodes no other node of the run names as parent."""
    parents = ledger.where(F.col("parent_id").isNotNull()).select(RUN, F.col("parent_id").alias("node_id")).distinct()
    return ledger.join(parents, [RUN, "node_id"], "left_anti")


def buggy_leaves(ledger: DataFrame) -> DataFrame:
    parents = ledger.where(F.col("parent_id").isNotNull()).select(RUN, F.col("parent_id").alias("node_id")).distinct()
    return ledger.where(F.col("is_buggy")).join(parents, [RUN, "node_id"], "left_anti")


def ledger_flags(ledger: DataFrame) -> DataFrame:
    leaf = buggy_leaves(ledger).select(RUN, "node_id", F.lit(True).alias("buggy_leaf"))
    return (
        ledger.withColumn("billed", is_billed())
        .withColumn("good", is_good())
        .withColumn("confirmed_good", is_good() & yes("confirmed"))
        .withColumn("usable_seed", usable_seed())
        .withColumn("timed_out", is_timeout())
        .withColumn("falsified", is_falsified())
        .withColumn("submit", submit_score())
        .join(leaf, [RUN, "node_id"], "left")
        .withColumn("buggy_leaf", yes("buggy_leaf"))
    )


def drafts(ledger: DataFrame) -> DataFrame:
    """Root drafts, whether they are live, and whether they stay worth probing (not 2 SE below the bar)."""
    se, d = F.col("se_val_delta"), F.col("delta_primary")
    open_ = ~F.col("is_buggy") & ~yes("confirmed") & ~yes("screen_pass") & d.isNotNull() & (F.coalesce(se, F.lit(0.0)) != 0)
    return (
        ledger.where(F.col("parent_id").isNull() & (F.col("stage") == "draft"))
        .withColumn("live", is_good())
        .withColumn("probe", open_ & ~yes((se > 0) & (d < -2.0 * se)))
    )


# ---- trees: pointer doubling, so a chain of depth d takes about log2(d) joins. Nodes whose walk has ended leave the join, and a node that very many
# others point to is answered apart (keyed_join) ---------------------------------------


def debug_depth(ledger: DataFrame) -> DataFrame:
    """Number of consecutive debug nodes from each node upwards."""
    active = ledger.where((F.col("stage") == "debug") & F.col("parent_id").isNotNull())
    state = cut_lineage(
        active.select(RUN, "node_id", F.col("parent_id").alias("ptr"), F.lit(1).alias("depth"), F.lit(True).alias("_walks"))
    )
    for _ in range(30):  # chains of up to 2 ** 30 nodes
        hop = state.select(F.col(RUN), F.col("node_id").alias("ptr"), F.col("ptr").alias("_p"), F.col("depth").alias("_d"))
        joined = keyed_join(state.where("_walks"), hop, [RUN, "ptr"])
        moved = joined.select(
            RUN, "node_id", F.coalesce("_p", "ptr").alias("ptr"), (F.col("depth") + F.coalesce("_d", F.lit(0))).alias("depth"),
            F.col("_p").isNotNull().alias("_walks"),
        )
        state = cut_lineage(moved.unionByName(state.where("NOT _walks")))
        if state.where("_walks").isEmpty():
            break
    else:
        raise ValueError("parent links form a cycle")
    state = state.drop("_walks")
    return ledger.select(RUN, "node_id", "stage").join(state.drop("ptr"), [RUN, "node_id"], "left").withColumn(
        "depth", F.coalesce("depth", F.lit(0))
    )


def crash_leaves(ledger: DataFrame, max_depth: int) -> DataFrame:
    """Buggy leaves that did not time out and sit below the debug-depth cap."""
    depth = debug_depth(ledger).select(RUN, "node_id", "depth")
    return buggy_leaves(ledger).where(~is_timeout()).join(depth, [RUN, "node_id"]).where(F.col("depth") < max_depth)


def own_config(ledger: DataFrame) -> DataFrame:
    """Each node's config; bags without one inherit their first member's that has one."""
    mine = ledger.select(RUN, "node_id", "config", "members")
    empty = F.coalesce(F.size("config"), F.lit(0)) <= 0
    lists = mine.where(empty).select(RUN, "node_id", F.posexplode("members").alias("_i", "_m"))
    donors = mine.where(~empty).select(RUN, F.col("node_id").alias("_m"), F.col("config").alias("_c"))
    inherited = lists.join(donors, [RUN, "_m"]).groupBy(RUN, "node_id").agg(F.min_by("_c", "_i").alias("_c"))
    return (
        mine.drop("members")
        .join(inherited, [RUN, "node_id"], "left")
        .select(RUN, "node_id", F.when(empty, F.col("_c")).otherwise(F.col("config")).alias("own_config"))
    )


def confirmed_identity(ledger: DataFrame) -> DataFrame:
    """Config of the nearest confirmed or ensemble node on the way up, the node's own config otherwise."""
    cfg = own_config(ledger)
    ends = (yes("confirmed") | (F.col("stage") == "ensemble")) & (F.coalesce(F.size("own_config"), F.lit(0)) > 0)
    nodes = ledger.join(cfg, [RUN, "node_id"]).select(
        RUN, "node_id", ends.alias("done"), F.when(ends, F.col("node_id")).otherwise(F.col("parent_id")).alias("ptr")
    )
    state = cut_lineage(nodes.withColumn("_walks", ~F.col("done") & F.col("ptr").isNotNull()))
    for _ in range(64):
        if state.where("_walks").isEmpty():
            break
        hop = state.select(F.col(RUN), F.col("node_id").alias("ptr"), F.col("done").alias("_done"), F.col("ptr").alias("_p"))
        joined = keyed_join(state.where("_walks"), hop, [RUN, "ptr"])
        # A walk ends at a pointer that is done, or where it runs out of parents.
        moved = joined.select(
            RUN, "node_id", "done", F.when(yes("_done"), F.col("ptr")).otherwise(F.col("_p")).alias("ptr"),
            (~yes("_done") & F.col("_p").isNotNull()).alias("_walks"),
        )
        state = cut_lineage(moved.unionByName(state.where("NOT _walks")))
    else:
        raise ValueError("parent links form a cycle")
    state = state.drop("_walks")
    source = cfg.select(F.col(RUN), F.col("node_id").alias("ptr"), F.col("own_config").alias("_c"))
    return (
        keyed_join(state, source, [RUN, "ptr"])
        .join(cfg, [RUN, "node_id"])
        .select(RUN, "node_id", F.col("ptr").alias("identity_node"), F.coalesce("_c", "own_config").alias("identity"))
    )


# ---- best, incumbent, pending --------------------------------------------------------


def best_node(ledger: DataFrame) -> DataFrame:
    """Per run: confirmed nodes first, then submit score, bags, firm incumbents, and the earliest on ties."""
    key = F.struct(
        yes("confirmed").alias("c"),
        submit_score().alias("s"),
        ((F.col("stage") == "ensemble") | has_members()).alias("b"),
        (~yes("weak_incumbent")).alias("w"),
        (-F.col("seq")).alias("q"),
    )
    pick = F.struct("node_id", "stage", "primary", "confirmed_mean", "members", "config", "source_hash", submit_score().alias("submit"))
    return ledger.where(is_good()).groupBy(RUN).agg(F.max_by(pick, key).alias("_b")).select(RUN, "_b.*")


def incumbent(ledger: DataFrame) -> DataFrame:
    """The incumbent's numbers: submit score, bar, seed-0 primary of the node or of its members."""
    best = best_node(ledger)
    lists = best.where(has_members()).select(RUN, "node_id", F.posexplode("members").alias("_i", "_m"))
    nodes = ledger.where(F.col("primary").isNotNull()).select(RUN, F.col("node_id").alias("_m"), F.col("seed"), F.col("primary").alias("_p"))
    seed0 = (
        lists.join(nodes, [RUN, "_m"])
        .groupBy(RUN)
        .agg(F.min_by("_p", F.struct(F.coalesce("seed", F.lit(0)) != 0, F.col("_i"))).alias("_s"), F.avg("_p").alias("member_mean"))
    )
    return best.join(seed0, RUN, "left").select(
        RUN,
        "node_id",
        has_members().alias("is_bag"),
        F.col("primary").alias("submit_primary"),
        F.col("submit").alias("screen_bar"),
        F.when(has_members(), F.col("_s")).otherwise(F.col("primary")).alias("seed0_primary"),
        "member_mean",
        "confirmed_mean",
    )


def _ablated(ledger: DataFrame) -> DataFrame:
    return ledger.where((F.col("stage") == "ablate") & F.col("parent_id").isNotNull()).select(
        RUN, F.col("parent_id").alias("node_id")
    ).distinct()


def pending_screen(ledger: DataFrame) -> DataFrame:
    """Latest screen-passed node that was neither ablated nor confirmed, per run."""
    open_ = ledger.where(yes("screen_pass") & ~yes("confirmed")).join(_ablated(ledger), [RUN, "node_id"], "left_anti")
    return open_.groupBy(RUN).agg(F.max_by("node_id", "seq").alias("node_id"))


def pending_core_confirm(ledger: DataFrame) -> DataFrame:
    """Latest one-seed node with a core key that is not falsified and still needs its seeds, per run."""
    open_ = ledger.where(
        (F.col("arm") != "ablate")
        & F.col("stage").isin("improve", "draft")
        & ~F.col("is_skip")
        & is_good()
        & ~yes("partial")
        & ~yes("confirmed")
        & E.is_core(E.canonical_patch("config"))
        & ~yes(F.col("ci95_hi") < 0)
    ).join(_ablated(ledger), [RUN, "node_id"], "left_anti")
    return open_.groupBy(RUN).agg(F.max_by("node_id", "seq").alias("node_id"))


# ---- streaks -------------------------------------------------------------------------


def skip_streak(ledger: DataFrame) -> DataFrame:
    """Skips at the end of each run, free stages ignored."""
    steps = ledger.where(~F.col("stage").isin(FREE_STAGES))
    last = steps.groupBy(RUN).agg(F.max(F.when(~F.col("is_skip"), F.col("seq"))).alias("_last"))
    tail = keyed_join(steps.where(F.col("is_skip")).select(RUN, "seq"), last, [RUN], "inner")
    n = tail.where(F.col("_last").isNull() | (F.col("seq") > F.col("_last"))).groupBy(RUN).agg(F.count(F.lit(1)).alias("_n"))
    return last.join(n, RUN, "left").select(RUN, F.coalesce("_n", F.lit(0)).alias("skip_streak"))


FOLD_RECORDS = 10_000  # running maxima of a run that may be folded in one row


def _folded_moves(records: DataFrame, eps: float) -> DataFrame:
    seqs = records.groupBy(RUN).agg(F.sort_array(F.collect_list(F.struct("seq", "_v"))).alias("_r"))
    start = F.struct(F.get("_r", F.lit(0))["seq"].alias("at"), F.get("_r", F.lit(0))["_v"].alias("best"))
    fold = F.aggregate(
        "_r",
        start,
        lambda acc, e: F.when(e["_v"] > acc["best"] + F.lit(eps), F.struct(e["seq"].alias("at"), e["_v"].alias("best"))).otherwise(acc),
    )
    return seqs.select(RUN, fold["at"].alias("_at"))


def _composed_moves(records: DataFrame, eps: float) -> DataFrame:
    """The same without a row per run: each record is a threshold step, the map from it to the record that would move the best next. The map is composed
    with itself, so that after k rounds it takes 2 ** k moves at once, until no run's first record gets any further."""
    ranked = cut_lineage(positions(records, [RUN], "_v", "_i", tie="seq", chunked=True))
    late = 1 << 40  # places a threshold behind the records of its own value
    steps = ranked.select(RUN, F.col("_v").alias("_x"), F.col("seq").cast("long").alias("_tie"), F.lit(None).cast("long").alias("_i"))
    asks = ranked.select(RUN, (F.col("_v") + F.lit(eps)).alias("_x"), (F.col("seq") + F.lit(late)).cast("long").alias("_tie"), "_i")
    below = value_prefix_sums(steps.unionByName(asks), [RUN], "_x", {"_to": F.col("_i").isNull().cast("double")}, "_tie")
    ends = ranked.groupBy(RUN).agg(F.count(F.lit(1)).alias("_n"))
    asked = keyed_join(below.where(F.col("_i").isNotNull()).select(RUN, "_i", F.col("_to").cast("long").alias("_to")), ends, [RUN], "inner")
    # A record no other one moves points to itself.
    jumps = cut_lineage(asked.select(RUN, "_i", F.when(F.col("_to") < F.col("_n"), F.col("_to")).otherwise(F.col("_i")).alias("_to")))
    while True:
        far = jumps.select(RUN, F.col("_i").alias("_to"), F.col("_to").alias("_far"))
        moving = keyed_join(jumps.where("_i <> _to"), far, [RUN, "_to"], "inner")
        after = cut_lineage(
            moving.select(RUN, "_i", F.col("_far").alias("_to"), (F.col("_far") != F.col("_to")).alias("_moved")).unionByName(
                jumps.where("_i = _to").select(RUN, "_i", "_to", F.lit(False).alias("_moved"))
            )
        )
        jumps = after.drop("_moved")
        if after.where("_i = 0 AND _moved").isEmpty():
            break
    last = jumps.where("_i = 0").select(RUN, F.col("_to").alias("_i"))
    return ranked.select(RUN, "_i", F.col("seq").alias("_at")).join(last, [RUN, "_i"]).select(RUN, "_at")


def _streak(steps: DataFrame, eps: float, out: str) -> DataFrame:
    """Steps after the last move of the best value, where it moves only by more than eps.

    Only strict running maxima can move it: anything else is at most eps above the best. Runs with few of them are folded in a row, and where a run has
    many the moves are composed."""
    records = cut_lineage(running_records(steps.where(F.col("_v").isNotNull()).select(RUN, "seq", "_v"), [RUN], "seq", "_v"))
    many = has_large_group(records, [RUN], min(FOLD_RECORDS, group_rows(steps.sparkSession)))
    moves = _composed_moves(records, eps) if many else _folded_moves(records, eps)
    after = keyed_join(steps.select(RUN, "seq"), moves, [RUN], "inner").where(F.col("seq") > F.col("_at")).groupBy(RUN).agg(F.count(F.lit(1)).alias("_n"))
    return moves.join(after, RUN, "left").select(RUN, F.coalesce("_n", F.lit(0)).alias(out))


def no_improve_streak(ledger: DataFrame, eps: float = EPSILON) -> DataFrame:
    value = F.coalesce("confirmed_mean", "primary")
    steps = ledger.where(yes("confirmed") & (F.col("stage") != "eda") & ~ablate_child() & value.isNotNull())
    return _streak(steps.withColumn("_v", value), eps, "no_improve")


def billed_no_improve_streak(ledger: DataFrame, eps: float = EPSILON) -> DataFrame:
    """As above over all billed steps; skips and unscored steps lengthen the streak."""
    steps = ledger.where(~(F.col("stage").isin(UNBILLED_STREAK_STAGES) | ablate_child()))
    value = F.when(~F.col("is_skip"), F.coalesce("confirmed_mean", "primary"))
    return _streak(steps.withColumn("_v", value), eps, "billed_no_improve")


# ---- identities and seeds --------------------------------------------------------------


def with_identity(ledger: DataFrame) -> DataFrame:
    return ledger.withColumn("fp", E.fingerprint("config"))


def _seed_rows(ledger: DataFrame) -> DataFrame:
    return with_identity(ledger.where(~F.col("stage").isin(NON_SEED_STAGES) & usable_seed()))


def _trial_groups(ledger: DataFrame) -> DataFrame:
    """Identities with at least two seed trials."""
    return (
        _seed_rows(ledger)
        .groupBy(RUN, "fp")
        .agg(F.count(F.lit(1)).alias("n_trials"), F.avg("primary").alias("mean"), F.min("seq").alias("first_seq"))
        .where(F.col("n_trials") >= 2)
    )


def _near_best(groups: DataFrame, eps: float) -> DataFrame:
    best = groups.groupBy(RUN).agg(F.max("mean").alias("_b"))
    near = groups.join(best, RUN).where(F.col("mean") >= F.col("_b") - eps).drop("_b")
    sizes = near.groupBy(RUN).agg(F.count(F.lit(1)).alias("_k")).where(F.col("_k") >= 2).drop("_k")
    return near.join(sizes, RUN)


def near_top(ledger: DataFrame, eps: float = NEAR_TOP_EPS) -> DataFrame:
    """Identities with at least two seed trials whose mean is within eps of the best, where two or more are."""
    return _near_best(_trial_groups(ledger), eps)


def seed_map(ledger: DataFrame) -> DataFrame:
    """First usable node per identity and seed."""
    first = F.min_by(F.struct("node_id", "primary", "stage", "ci95_hi", "seq"), "seq")
    return _seed_rows(ledger).groupBy(RUN, "fp", "seed").agg(first.alias("_f")).select(RUN, "fp", "seed", "_f.*")


def seed_groups(ledger: DataFrame) -> DataFrame:
    """Identities with two or more seeds and their seed-deduplicated mean."""
    return (
        seed_map(ledger)
        .groupBy(RUN, "fp")
        .agg(F.count(F.lit(1)).alias("n_seeds"), F.avg("primary").alias("mean"), F.min_by("node_id", "seed").alias("lead_node"))
        .where(F.col("n_seeds") >= 2)
    )


def _member_identities(bags: DataFrame, ledger: DataFrame) -> DataFrame:
    lists = bags.select(RUN, F.explode("members").alias("node_id"))
    return lists.join(with_identity(ledger).select(RUN, "node_id", "fp"), [RUN, "node_id"]).select(RUN, "fp").distinct()


def _live_bags(ledger: DataFrame, kind: str) -> DataFrame:
    return ledger.where(
        (F.col("stage") == "ensemble") & ~F.col("is_buggy") & ~F.col("is_skip")
        & (F.coalesce("ensemble_kind", F.lit("same_config")) == kind)
    )


def unbagged_groups(ledger: DataFrame, eps: float = NEAR_TOP_EPS) -> DataFrame:
    """Seed groups near the best group's mean that no same-config bag covers yet."""
    groups = seed_groups(ledger)
    best = groups.groupBy(RUN).agg(F.max("mean").alias("_b"))
    bagged = _member_identities(_live_bags(ledger, "same_config"), ledger)
    return (
        groups.join(bagged, [RUN, "fp"], "left_anti").join(best, RUN).where(F.col("mean") >= F.col("_b") - eps).drop("_b")
    )


def complementary_set(ledger: DataFrame, eps: float = NEAR_TOP_EPS, delta: float = COMPLEMENT_DELTA) -> DataFrame:
    """Near-top identities; the wider window only for runs without a near-top pair.

    The groups are written once. Both windows are read off in one pass over a run, unless a run has too many identities for one task."""
    groups = cut_lineage(_trial_groups(ledger).where(F.col(RUN).isNotNull()).select(RUN, "fp", "mean"))
    if has_large_group(groups, [RUN]):
        near = _near_best(groups, eps).select(RUN, "fp")
        wide = _near_best(groups, delta).select(RUN, "fp").join(near.select(RUN).distinct(), RUN, "left_anti")
        return near.unionByName(wide)
    run = Window.partitionBy(RUN)
    best = F.max("mean").over(run)
    marked = groups.withColumns({"_near": F.col("mean") >= best - eps, "_wide": F.col("mean") >= best - delta})
    counted = marked.withColumns({f"{c}_n": F.sum(F.col(c).cast("long")).over(run) for c in ("_near", "_wide")})
    close = F.col("_near_n") >= 2
    return counted.where((close & F.col("_near")) | (~close & (F.col("_wide_n") >= 2) & F.col("_wide"))).select(RUN, "fp")


def complementary_stale(ledger: DataFrame, eps: float = NEAR_TOP_EPS, delta: float = COMPLEMENT_DELTA) -> DataFrame:
    """Runs whose complementary set is not contained in the last complementary blend."""
    want = complementary_set(ledger, eps, delta)
    bags = _live_bags(ledger, "complementary").where(F.col("primary").isNotNull())
    last = bags.groupBy(RUN).agg(F.max_by("members", "seq").alias("members"))
    covered = _member_identities(last, ledger)
    return want.join(covered, [RUN, "fp"], "left_anti").select(RUN).distinct()


def seed_fill(ledger: DataFrame, delta: float = NEAR_TOP_EPS) -> DataFrame:
    """Near-top one-seed identities that still need their other seeds."""
    groups = (
        seed_map(ledger)
        .groupBy(RUN, "fp")
        .agg(
            F.count(F.lit(1)).alias("n_seeds"),
            F.avg("primary").alias("mean"),
            F.min_by(F.struct("node_id", "stage", "ci95_hi"), "seed").alias("_f"),
        )
    )
    best = groups.groupBy(RUN).agg(F.max("mean").alias("_b"))
    open_ = (F.col("n_seeds") < 2) & (F.col("mean") >= F.col("_b") - delta) & (F.col("_f.stage") != "draft")
    return groups.join(best, RUN).where(open_ & ~yes(F.col("_f.ci95_hi") < 0)).select(
        RUN, "fp", F.col("_f.node_id").alias("node_id"), "mean"
    )


def consolidation(ledger: DataFrame, eps: float = NEAR_TOP_EPS, delta: float = COMPLEMENT_DELTA) -> DataFrame:
    """What each run should consolidate next: bag seeds, refresh the blend, fill seeds, or nothing."""

    def mark(df: DataFrame, name: str) -> DataFrame:
        return df.select(RUN).distinct().withColumn(name, F.lit(True))

    runs = ledger.select(RUN).distinct()
    out = (
        runs.join(mark(unbagged_groups(ledger, eps), "_u"), RUN, "left")
        .join(mark(complementary_stale(ledger, eps, delta), "_c"), RUN, "left")
        .join(mark(seed_fill(ledger, eps), "_s"), RUN, "left")
    )
    state = F.when(yes("_u"), "same_config").when(yes("_c"), "complementary").when(yes("_s"), "seed_fill").otherwise("")
    return out.select(RUN, state.alias("pending"))


# ---- duplicates, caches, grids ---------------------------------------------------------


def solution_key() -> Column:
    return E.fingerprint("config", "source_hash")


def find_duplicates(ledger: DataFrame) -> DataFrame:
    """Nodes whose solution an earlier, not skipped node of the run already has."""
    keyed = ledger.withColumn("_k", solution_key())
    first = keyed.where(~F.col("is_skip")).groupBy(RUN, "_k").agg(
        F.min_by("node_id", "seq").alias("first_node"), F.min("seq").alias("_s")
    )
    return keyed.join(first, [RUN, "_k"]).where(F.col("seq") > F.col("_s")).select(RUN, "node_id", "first_node")


def lookup_seed(jobs: DataFrame, ledger: DataFrame) -> DataFrame:
    """Latest reusable ablation result per job (run, parent, config, seed, code version)."""
    done = ledger.where(ablate_child() & is_good() & ~is_timeout()).select(
        RUN, F.col("parent_id"), E.fingerprint("config").alias("fp"), F.coalesce("seed", F.lit(0)).alias("seed"),
        F.col("source_hash").alias("_v"), "node_id", "seq",
    )
    hit = (
        jobs.join(done, [RUN, "parent_id", "fp", "seed"])
        .where(F.col("_v").isNull() | (F.col("_v") == F.col("version")))
        .groupBy("job_id")
        .agg(F.max_by("node_id", "seq").alias("cached_from"))
    )
    return jobs.join(hit, "job_id", "left")


def _grid_rows(bases: DataFrame, grid: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Every base config with every patch of the (short, literal) grid."""
    cells = [
        F.struct(F.lit(arm).alias("arm"), F.create_map(*[F.lit(x) for kv in patch.items() for x in kv]).alias("patch"))
        for arm, patch in grid
    ]
    return bases.withColumn("_g", F.explode(F.array(*cells))).select(*bases.columns, "_g.arm", "_g.patch")


def untried(ledger: DataFrame, grid: list[tuple[str, dict[str, str]]], graves: DataFrame | None = None) -> DataFrame:
    """Patches of the grid that, merged into the incumbent, give a solution the run has not tried; graves (scale,
    fingerprint) bury a patch only at the incumbent's own data scale."""
    tried = ledger.where(~F.col("is_skip")).select(RUN, solution_key().alias("_k")).distinct()
    cells = _grid_rows(best_node(ledger).select(RUN, "config", "source_hash"), grid)
    cells = cells.withColumn("_k", E.fingerprint(E.overlay("config", "patch"), "source_hash"))
    out = cells.join(tried, [RUN, "_k"], "left_anti").withColumn("patch_fp", E.fingerprint("patch"))
    if graves is not None:
        named = F.lower(F.regexp_replace(F.try_element_at("config", F.lit("data_scale")), '"', ""))
        own = F.when(named.isin(SCALES), named).otherwise("pure")
        dead = graves.select(F.col("scale").alias("_scale"), F.col("fingerprint").alias("patch_fp")).distinct()
        out = out.withColumn("_scale", own).join(dead, ["_scale", "patch_fp"], "left_anti")
    return out.select(RUN, "arm", "patch_fp")


def unsettled(ledger: DataFrame, grid: list[tuple[str, dict[str, str]]]) -> DataFrame:
    """Patches not yet tried on the incumbent itself, without those that would change nothing."""
    best = best_node(ledger).select(RUN, F.col("node_id").alias("parent_id"), "config")
    fp = E.fingerprint("config")
    tried = ledger.where(~F.col("is_skip") & F.col("parent_id").isNotNull()).select(RUN, "parent_id", fp.alias("patch_fp")).distinct()
    cells = _grid_rows(best, grid).withColumn("patch_fp", E.fingerprint("patch"))
    moves = F.col("patch_fp") != ""
    changes = E.fingerprint(E.overlay("config", "patch")) != fp
    return cells.where(moves & changes).join(tried, [RUN, "parent_id", "patch_fp"], "left_anti").select(
        RUN, "parent_id", "arm", "patch_fp"
    )


def exhausted_arms(ledger: DataFrame, grid: list[tuple[str, dict[str, str]]], graves: DataFrame | None = None) -> DataFrame:
    """Arms of the grid with no untried patch left, per run."""
    arms = F.explode(F.array(*[F.lit(a) for a in sorted({arm for arm, _ in grid})]))
    runs = best_node(ledger).select(RUN, arms.alias("arm"))
    return runs.join(untried(ledger, grid, graves).select(RUN, "arm").distinct(), [RUN, "arm"], "left_anti")


def tried_by_parent(ledger: DataFrame) -> DataFrame:
    """Every canonical patch tried per parent and arm, with its place in order of first trial."""
    rows = with_identity(ledger.where(~F.col("is_skip"))).where(F.col("fp") != "")
    first = rows.groupBy(RUN, "parent_id", "arm", "fp").agg(F.min("seq").alias("_s"))
    w = Window.partitionBy(RUN, "parent_id", "arm").orderBy("_s")
    return first.withColumn("place", F.row_number().over(w)).drop("_s")


def crossover_candidates(ledger: DataFrame, eps: float = NEAR_TOP_EPS, most: int = MAX_CROSSOVERS) -> DataFrame:
    """Flags of near-top partners the incumbent identity lacks and no node of the run has merged yet (`crossover_delta`).
    Runs in which `most` crossovers have been run (`crossover`) get none."""
    keep = best_node(ledger).select(RUN, "node_id").join(confirmed_identity(ledger), [RUN, "node_id"]).select(
        RUN, F.col("identity").alias("_keep")
    )
    partners = near_top(ledger, eps).select(RUN, "fp", "first_seq")
    firsts = with_identity(ledger).select(RUN, F.col("seq").alias("first_seq"), F.col("config").alias("_other"))
    merged = (
        partners.join(firsts, [RUN, "first_seq"])
        .join(keep, RUN)
        .where(F.col("fp") != E.fingerprint("_keep"))
        .withColumn("delta_fp", E.fingerprint(E.merge_delta("_keep", "_other")))
        .where(F.col("delta_fp") != "")
    )
    first = merged.groupBy(RUN, "delta_fp").agg(F.min("first_seq").alias("_s"), F.min_by("fp", "first_seq").alias("partner"))
    done = ledger.where(F.col("crossover_delta").isNotNull()).select(RUN, F.col("crossover_delta").alias("delta_fp")).distinct()
    spent = ledger.where(yes("crossover")).groupBy(RUN).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= most).select(RUN)
    open_ = first.join(done, [RUN, "delta_fp"], "left_anti").join(spent, RUN, "left_anti")
    w = Window.partitionBy(RUN).orderBy("_s")
    return open_.withColumn("place", F.row_number().over(w)).select(RUN, "delta_fp", "partner", "place")


def expand_jobs(
    specs: DataFrame, graves: DataFrame | None = None, max_configs: int | None = None, max_seeds: int | None = None
) -> DataFrame:
    """Ablation jobs from specs (run_id, pending, configs, seeds): the pending config first, repeats and
    graves after it dropped; all configs and seeds unless a job format sets its own most."""
    order = F.when(F.col("pending").isNotNull(), F.concat(F.array("pending"), "configs")).otherwise(F.col("configs"))
    rows = specs.select(RUN, F.posexplode(order).alias("_i", "config"), "seeds").withColumn("fp", E.fingerprint("config"))
    first = rows.groupBy(RUN, "fp").agg(F.min("_i").alias("_i"), F.min_by("seeds", "_i").alias("seeds"))
    if graves is not None:
        dead = graves.select(F.col("fingerprint").alias("fp")).distinct().withColumn("_dead", F.lit(True))
        first = first.join(dead, "fp", "left").where((F.col("_i") == 0) | ~yes("_dead")).drop("_dead")
    w = Window.partitionBy(RUN).orderBy("_i")
    kept = first.withColumn("config_idx", F.row_number().over(w) - 1)
    if max_configs is not None:
        kept = kept.where(F.col("config_idx") < max_configs)
    seeds = F.col("seeds") if max_seeds is None else F.slice("seeds", 1, max_seeds)
    return kept.select(RUN, "config_idx", "fp", F.explode(seeds).alias("seed")).withColumn("label", F.format_string("c%d_s%d", "config_idx", "seed"))


# ---- seed tables and winners -----------------------------------------------------------


def seed_table(runs: DataFrame, by: list[str]) -> DataFrame:
    """Per config: seeds, how many beat the bar, mean and population deviation. Input has `primary`, `bar`."""
    scored = runs.where(F.col("primary").isNotNull() & F.col("seed").isNotNull())
    return scored.groupBy(*by, "config_idx").agg(
        F.count(F.lit(1)).alias("n_seeds"),
        F.coalesce(F.sum((F.col("primary") > F.col("bar")).cast("long")), F.lit(0)).alias("n_pos_seeds"),
        F.avg("primary").alias("mean"),
        F.stddev_pop("primary").alias("std"),
        F.first("bar").alias("bar"),
    )


def pairwise_seed_table(runs: DataFrame, by: list[str]) -> DataFrame:
    """Configs against each other on matched seeds; the latest result of a seed counts."""
    scored = runs.where(F.col("primary").isNotNull() & F.col("seed").isNotNull())
    last = scored.groupBy(*by, "config_idx", "seed").agg(F.max_by("primary", "seq").alias("_p"))
    left = last.select(*by, "seed", F.col("config_idx").alias("left_idx"), F.col("_p").alias("_l"))
    right = last.select(*by, "seed", F.col("config_idx").alias("right_idx"), F.col("_p").alias("_r"))
    d = F.col("_r") - F.col("_l")
    return (
        left.join(right, [*by, "seed"])
        .where(F.col("left_idx") < F.col("right_idx"))
        .groupBy(*by, "left_idx", "right_idx")
        .agg(
            F.count(F.lit(1)).alias("n_seeds"),
            F.sum((d > 0).cast("long")).alias("n_pos_right"),
            F.sum((d < 0).cast("long")).alias("n_neg_right"),
            F.avg(d).alias("mean_delta"),
        )
    )


def ablation_winner(table: DataFrame, pairwise: DataFrame, by: list[str]) -> DataFrame:
    """The challenger wins only 3/3 against config 0; else config 0 if 3/3 over the bar. A lone config wins
    3/3 over the bar, or with a majority and at least 0.002."""
    all_pos = (F.col("n_seeds") >= 3) & (F.col("n_pos_seeds") == F.col("n_seeds"))
    wide = table.withColumn("_ap", all_pos)
    configs = wide.groupBy(*by).agg(
        F.count(F.lit(1)).alias("_k"),
        F.max(F.when(F.col("config_idx") == 0, F.col("_ap"))).alias("_c0"),
        F.max(F.when(F.col("config_idx") == 1, F.lit(True))).alias("_has1"),
        F.max_by(
            F.struct("config_idx", "_ap", "mean", "bar", "n_seeds", "n_pos_seeds"), F.struct("_ap", "mean")
        ).alias("_top"),
    )
    duel = pairwise.where((F.col("left_idx") == 0) & (F.col("right_idx") == 1)).select(
        *by, ((F.col("n_seeds") >= 3) & (F.col("n_pos_right") == F.col("n_seeds"))).alias("_duel")
    )
    both = configs.join(duel, by, "left")
    top = F.col("_top")
    majority = (top["mean"] - top["bar"] >= EPSILON) & (top["n_pos_seeds"] > top["n_seeds"] / 2)
    winner = (
        F.when((F.col("_k") >= 2) & yes("_has1") & yes("_duel"), F.lit(1))
        .when((F.col("_k") >= 2) & yes("_c0"), F.lit(0))
        .when((F.col("_k") == 1) & (top["_ap"] | yes(majority)), top["config_idx"])
    )
    return both.select(*by, winner.cast("int").alias("winner"))


# ---- counters --------------------------------------------------------------------------


def cost_totals(cost: DataFrame, by: list[str] = []) -> DataFrame:
    return cost.groupBy(*by).agg(
        F.coalesce(F.sum("tokens_in"), F.lit(0)).cast("double").alias("tokens_in"),
        F.coalesce(F.sum("tokens_out"), F.lit(0)).cast("double").alias("tokens_out"),
        (F.coalesce(F.sum("wall_seconds"), F.lit(0.0)) / 3600.0).alias("compute_hours"),
    )


def stack_coverage(ledger: DataFrame) -> DataFrame:
    """Billed, skipped and scored steps per run and arm, with run totals in the same pass."""
    steps = ledger.where((F.col("stage") != "eda") & ~ablate_child()).withColumn("arm", F.coalesce("arm", "stage"))

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    return steps.rollup(RUN, "arm").agg(
        F.grouping_id().cast("int").alias("level"),
        n(is_billed()).alias("billed"),
        n(F.col("is_skip")).alias("skip"),
        n(~F.col("is_skip") & F.col("primary").isNotNull()).alias("scored"),
    )


def run_summary(ledger: DataFrame) -> DataFrame:
    """Per run: steps, budget used, useful steps, tokens, tokens per useful step and hours."""

    def n(cond: Column) -> Column:
        return F.sum(cond.cast("long"))

    agg = ledger.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("nodes"),
        n(is_billed()).alias("iterations"),
        n(is_billed() & ~F.col("is_skip")).alias("useful"),
        n(F.col("stage") == "research").alias("n_research"),
        n(F.col("stage") == "ablate").alias("n_ablate"),
        n(is_good() & yes("confirmed")).alias("n_confirmed"),
        F.sum(F.col("tokens_in") + F.col("tokens_out")).alias("tokens_total"),
        (F.sum("wall_seconds") / 3600.0).alias("compute_hours"),
    )
    best = best_node(ledger).select(RUN, F.col("node_id").alias("incumbent"), F.col("submit").alias("incumbent_score"))
    return agg.withColumn(
        "tokens_per_useful", F.when(F.col("useful") > 0, F.col("tokens_total") / F.col("useful"))
    ).join(best, RUN, "left")


def is_runtime(kind="kind", phase="phase") -> Column:
    k, p = F.col(kind), F.col(phase)
    return F.when(yes(p == "runtime"), True).when(yes(p == "build-time"), False).otherwise(~yes(k == "human_ablate"))


def interventions(df: DataFrame) -> DataFrame:
    return df.groupBy(F.when(is_runtime(), "runtime").otherwise("build_time").alias("phase_kind")).agg(
        F.count(F.lit(1)).alias("n")
    )


def calibration(ledger: DataFrame) -> DataFrame:
    """How often the predicted delta fell inside the interval, and its mean bias, per run."""
    exp, d = F.col("expected_delta"), F.col("delta_primary")
    rows = ledger.where(exp.isNotNull() & d.isNotNull())
    inside = yes((F.col("ci95_lo") <= exp) & (exp <= F.col("ci95_hi")))
    agg = rows.groupBy(RUN).agg(
        F.count(F.lit(1)).alias("n"), F.sum(inside.cast("long")).alias("within"), F.avg(exp - d).alias("mean_bias")
    )
    return agg.withColumn("tag", F.when(F.col("mean_bias") > 0, "over-optimistic").otherwise("under-optimistic"))


def arm_posterior(ledger: DataFrame, priors: DataFrame) -> DataFrame:
    """Prior successes and failures plus credits: a passed screen counts for, a delta two SE below the bar or
    a skip counts against, everything else leaves the arm unchanged."""
    ran = (F.col("stage") == "improve") & (F.col("arm") != "ablate") & ~F.col("is_skip") & ~F.col("is_buggy") & ~is_timeout()
    won = ran & yes("screen_pass")
    se, d = F.col("se_val_delta"), F.col("delta_primary")
    lost = (ran & ~yes("screen_pass") & yes((se > 0) & (d < -2.0 * se))) | F.col("is_skip")
    credit = ledger.groupBy("arm").agg(F.sum(won.cast("long")).alias("_a"), F.sum(lost.cast("long")).alias("_b"))
    return priors.join(credit, "arm", "left").select(
        "arm",
        (F.col("alpha") + F.coalesce("_a", F.lit(0))).alias("alpha"),
        (F.col("beta") + F.coalesce("_b", F.lit(0))).alias("beta"),
    )


def recent_facts(ledger: DataFrame, lengths: dict[str, int] | None = None) -> DataFrame:
    """The facts of each run by kind with their age (1 is the latest): screens, falsified patches, timeouts, ablations, and
    confirmed nodes without an age. A report may ask for fewer by kind, as in {"screen": 12}."""
    improve = (F.col("stage") == "improve") & (F.col("arm") != "ablate")
    rows = with_identity(ledger).where(F.col("fp").isNotNull())

    def latest(df: DataFrame, kind: str) -> DataFrame:
        out = df.select(RUN, "node_id", "seq", F.lit(kind).alias("fact"))
        if kind == "confirmed":
            return out.withColumn("age", F.lit(None).cast("int"))
        out = out.withColumn("age", F.row_number().over(Window.partitionBy(RUN).orderBy(F.col("seq").desc())))
        return out.where(F.col("age") <= lengths[kind]) if lengths and kind in lengths else out

    dead = rows.where(improve & ~F.col("is_skip") & is_falsified())
    dead = dead.groupBy(RUN, "fp").agg(F.min_by("node_id", "seq").alias("node_id"), F.min("seq").alias("seq"))
    parts = [
        latest(rows.where(improve & ~F.col("is_skip")), "screen"),
        latest(dead, "falsified"),
        latest(rows.where(is_timeout()), "timeout"),
        latest(rows.where(F.col("stage") == "ablate"), "ablate"),
        latest(rows.where(is_good() & yes("confirmed")), "confirmed"),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out

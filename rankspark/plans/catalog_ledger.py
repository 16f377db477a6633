"""Ledger and decision queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.operators import decisions as D
from rankspark.operators import fusion as B
from rankspark.operators import ledger as L
from rankspark.plans.catalog_metrics import BOOT, RM, UM
from rankspark.plans.views import LEDGER, SCORES, score_table, summary_sql, tidy, user_metrics_sql
from rankspark.session import cut_lineage
from rankspark.sources.mapped import ledger, table

QUERIES, ORACLES = {}, {}

# The mapped scores spread over 0..0.5, so a wider epsilon than the default finds near-top pairs.
EPS = 0.02
WIDE = 0.1

GRID = [
    ("capacity", {"k": "8"}),
    ("capacity", {"k": "32"}),
    ("capacity", {"k": "64"}),
    ("loss", {"loss": '"bpr"'}),
    ("sequence", {"seq_len": "50"}),
    ("sequence", {"seq_len": "100"}),
    ("features", {"use_time_decay": "true"}),
]


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


GOOD = "NOT is_buggy AND prim IS NOT NULL"
TIMEOUT = "(partial OR coalesce(exec_status IN ('timeout', 'partial'), false))"
USABLE = f"({GOOD} AND NOT {TIMEOUT} AND NOT is_skip)"
PARENTS = "pars AS (SELECT DISTINCT parent_id FROM ledger WHERE parent_id IS NOT NULL)"
BEST = f"""best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY confirmed DESC, submit DESC,
  (stage = 'ensemble' OR members IS NOT NULL) DESC, NOT weak_incumbent DESC, seq) AS brn FROM ledger WHERE {GOOD}) WHERE brn = 1)"""


@query(
    "submit_score",
    f"WITH {LEDGER} SELECT node_id, round(submit, 9) AS submit FROM ledger WHERE submit IS NOT NULL",
)
def submit_score(spark, sf):
    out = ledger(spark, sf).select("node_id", L.submit_score().alias("submit"))
    return tidy(out.where(F.col("submit").isNotNull()))


@query(
    "ledger_flags",
    f"""WITH {LEDGER}, {PARENTS} SELECT node_id, NOT (stage IN ('eda', 'ensemble') OR is_child) AS billed, ({GOOD}) AS good,
    ({GOOD} AND confirmed) AS confirmed_good, {USABLE} AS usable_seed, {TIMEOUT} AS timed_out,
    (ci95_hi < 0 AND delta_primary IS NOT NULL) AS falsified,
    (is_buggy AND node_id NOT IN (SELECT parent_id FROM pars)) AS buggy_leaf FROM ledger""",
)
def ledger_flags(spark, sf):
    return L.ledger_flags(ledger(spark, sf)).select(
        "node_id", "billed", "good", "confirmed_good", "usable_seed", "timed_out", "falsified", "buggy_leaf"
    )


@query(
    "drafts",
    f"""WITH {LEDGER} SELECT node_id, ({GOOD}) AS live, (NOT is_buggy AND NOT confirmed AND NOT screen_pass AND delta_primary IS NOT NULL
      AND NOT (d < -2 * se)) AS probe FROM (SELECT * REPLACE (d AS delta_primary) FROM ledger) WHERE parent_id IS NULL AND stage = 'draft'""",
)
def drafts(spark, sf):
    """Roots have no delta in the mapping; the paired delta of the same draw stands in."""
    rows = ledger(spark, sf).withColumn("delta_primary", (E.uniform("seq", 1) - 0.5) * 0.02)
    return L.drafts(rows).select("node_id", "live", "probe")


DEPTH = """dep AS (WITH RECURSIVE r(node_id, cur, depth) AS (
  SELECT node_id, parent_id, 1 FROM ledger WHERE stage = 'debug' AND parent_id IS NOT NULL UNION ALL
  SELECT r.node_id, l.parent_id, r.depth + 1 FROM r JOIN ledger l ON l.node_id = r.cur WHERE l.stage = 'debug' AND l.parent_id IS NOT NULL)
  SELECT node_id, max(depth) AS depth FROM r GROUP BY 1)"""


@query("debug_depth", f"WITH {LEDGER}, {DEPTH} SELECT l.node_id, CAST(coalesce(depth, 0) AS BIGINT) AS depth FROM ledger l LEFT JOIN dep USING (node_id)")
def debug_depth(spark, sf):
    return tidy(L.debug_depth(ledger(spark, sf)).select("node_id", "depth"))


@query(
    "crash_leaves",
    f"""WITH {LEDGER}, {DEPTH}, {PARENTS} SELECT l.node_id FROM ledger l LEFT JOIN dep USING (node_id)
    WHERE is_buggy AND node_id NOT IN (SELECT parent_id FROM pars) AND NOT {TIMEOUT} AND coalesce(depth, 0) < 2""",
)
def crash_leaves(spark, sf):
    return L.crash_leaves(ledger(spark, sf), 2).select("node_id")


@query(
    "confirmed_identity",
    f"""WITH {LEDGER}, w AS (WITH RECURSIVE r(node_id, cur, dist) AS (SELECT node_id, node_id, 0 FROM ledger UNION ALL
      SELECT r.node_id, l.parent_id, r.dist + 1 FROM r JOIN ledger l ON l.node_id = r.cur
      WHERE NOT (l.confirmed OR l.stage = 'ensemble') AND l.parent_id IS NOT NULL) SELECT * FROM r),
    hit AS (SELECT w.node_id, min_by(cur, dist) AS h FROM w JOIN ledger l ON l.node_id = cur WHERE l.confirmed OR l.stage = 'ensemble' GROUP BY 1)
    SELECT a.node_id, h AS identity_node, coalesce(b.fp, a.fp) AS fp FROM ledger a LEFT JOIN hit USING (node_id) LEFT JOIN ledger b ON b.node_id = h""",
)
def confirmed_identity(spark, sf):
    out = L.confirmed_identity(ledger(spark, sf))
    return out.select("node_id", "identity_node", E.fingerprint("identity").alias("fp"))


@query("best_node", f"WITH {LEDGER}, {BEST} SELECT run_id, node_id, round(submit, 9) AS submit FROM best")
def best_node(spark, sf):
    return tidy(L.best_node(ledger(spark, sf)).select("run_id", "node_id", "submit"))


@query(
    "incumbent",
    f"""WITH {LEDGER}, {BEST}, mem AS (SELECT b.run_id, unnest(members) AS m, unnest(range(len(members))) AS i FROM best b WHERE members IS NOT NULL),
    ms AS (SELECT mem.run_id, arg_min(prim, (CASE WHEN seed = 0 THEN 0 ELSE 1 END) * 100 + i) AS s0, avg(prim) AS mm
      FROM mem JOIN ledger l ON l.node_id = m WHERE prim IS NOT NULL GROUP BY 1)
    SELECT run_id, node_id, members IS NOT NULL AS is_bag, round(prim, 9) AS submit_primary, round(submit, 9) AS screen_bar,
    round(CASE WHEN members IS NOT NULL THEN s0 ELSE prim END, 9) AS seed0_primary, round(mm, 9) AS member_mean FROM best LEFT JOIN ms USING (run_id)""",
)
def incumbent(spark, sf):
    return tidy(L.incumbent(ledger(spark, sf)).drop("confirmed_mean"))


ABL = "abl AS (SELECT DISTINCT parent_id FROM ledger WHERE stage = 'ablate' AND parent_id IS NOT NULL)"


@query(
    "pending_screen",
    f"""WITH {LEDGER}, {ABL} SELECT run_id, max(node_id) AS node_id FROM ledger WHERE screen_pass AND NOT confirmed
    AND node_id NOT IN (SELECT parent_id FROM abl) GROUP BY 1""",
)
def pending_screen(spark, sf):
    return L.pending_screen(ledger(spark, sf))


@query(
    "pending_core_confirm",
    f"""WITH {LEDGER}, {ABL} SELECT run_id, max(node_id) AS node_id FROM ledger WHERE arm <> 'ablate' AND stage IN ('improve', 'draft') AND NOT is_skip
    AND {GOOD} AND NOT partial AND NOT confirmed AND (seq_len <> '0' OR utd = 'true') AND NOT (ci95_hi < 0)
    AND node_id NOT IN (SELECT parent_id FROM abl) GROUP BY 1""",
)
def pending_core_confirm(spark, sf):
    return L.pending_core_confirm(ledger(spark, sf))


@query(
    "skip_streak",
    f"""WITH {LEDGER}, s AS (SELECT * FROM ledger WHERE stage NOT IN ('eda', 'ablate', 'research', 'read_paper')),
    l AS (SELECT run_id, max(seq) FILTER (NOT is_skip) AS last FROM s GROUP BY 1)
    SELECT l.run_id, count(s.seq) AS skip_streak FROM l LEFT JOIN s ON s.run_id = l.run_id AND s.is_skip AND (last IS NULL OR s.seq > last) GROUP BY 1""",
)
def skip_streak(spark, sf):
    return L.skip_streak(ledger(spark, sf))


def _fold_sql(steps: str, eps: float, out: str) -> str:
    return f"""WITH {LEDGER}, st AS ({steps}),
    f AS (SELECT run_id, list_reduce(list(CASE WHEN v IS NULL THEN [NULL, NULL]::DOUBLE[] ELSE [v, 0]::DOUBLE[] END ORDER BY seq),
      lambda a, x: CASE WHEN a[1] IS NULL THEN x WHEN x[1] IS NOT NULL AND x[1] > a[1] + {eps} THEN [x[1], 0]::DOUBLE[] ELSE [a[1], a[2] + 1]::DOUBLE[] END) AS r FROM st GROUP BY 1)
    SELECT run_id, CAST(r[2] AS BIGINT) AS {out} FROM f WHERE r[1] IS NOT NULL"""


@query(
    "no_improve_streak",
    _fold_sql(
        "SELECT run_id, seq, coalesce(confirmed_mean, prim) AS v FROM ledger WHERE confirmed AND stage <> 'eda' AND NOT is_child AND coalesce(confirmed_mean, prim) IS NOT NULL",
        EPS,
        "no_improve",
    ),
)
def no_improve_streak(spark, sf):
    return L.no_improve_streak(ledger(spark, sf), EPS)


@query(
    "billed_no_improve_streak",
    _fold_sql(
        "SELECT run_id, seq, CASE WHEN NOT is_skip THEN coalesce(confirmed_mean, prim) END AS v FROM ledger WHERE stage <> 'ablate' AND NOT is_child",
        EPS,
        "billed_no_improve",
    ),
)
def billed_no_improve_streak(spark, sf):
    return L.billed_no_improve_streak(ledger(spark, sf), EPS)


SEEDS = f"""sr AS (SELECT * FROM ledger WHERE stage NOT IN ('ensemble', 'debug') AND {USABLE}),
sm AS (SELECT run_id, fp, seed, arg_min(node_id, seq) AS node_id, arg_min(prim, seq) AS prim, arg_min(stage, seq) AS stage, arg_min(ci95_hi, seq) AS hi FROM sr GROUP BY 1, 2, 3),
sg AS (SELECT run_id, fp, count(*) AS n_seeds, avg(prim) AS mean, arg_min(node_id, seed) AS lead_node, arg_min(stage, seed) AS lstage, arg_min(hi, seed) AS lhi FROM sm GROUP BY 1, 2)"""


def _near(eps: float, name: str) -> str:
    return f"""{name}g AS (SELECT run_id, fp, count(*) AS n_trials, avg(prim) AS mean, min(seq) AS first_seq FROM sr GROUP BY 1, 2 HAVING count(*) >= 2),
{name}k AS (SELECT g.* FROM {name}g g JOIN (SELECT run_id, max(mean) AS b FROM {name}g GROUP BY 1) USING (run_id) WHERE mean >= b - {eps}),
{name} AS (SELECT * FROM {name}k WHERE run_id IN (SELECT run_id FROM {name}k GROUP BY 1 HAVING count(*) >= 2))"""


@query(
    "near_top",
    f"WITH {LEDGER}, {SEEDS}, {_near(EPS, 'nt')} SELECT run_id, fp, n_trials, round(mean, 9) AS mean, first_seq FROM nt",
)
def near_top(spark, sf):
    return tidy(L.near_top(ledger(spark, sf), EPS))


@query(
    "seed_groups",
    f"WITH {LEDGER}, {SEEDS} SELECT run_id, fp, n_seeds, round(mean, 9) AS mean, lead_node FROM sg WHERE n_seeds >= 2",
)
def seed_groups(spark, sf):
    return tidy(L.seed_groups(ledger(spark, sf)))


BAGGED = """bgd AS (SELECT DISTINCT l.run_id, l.fp FROM (SELECT run_id, unnest(members) AS m FROM ledger WHERE stage = 'ensemble' AND NOT is_buggy
  AND NOT is_skip AND ensemble_kind = 'same_config') b JOIN ledger l ON l.node_id = b.m AND l.run_id = b.run_id),
ub AS (SELECT g.* FROM sg g JOIN (SELECT run_id, max(mean) AS b FROM sg WHERE n_seeds >= 2 GROUP BY 1) USING (run_id) ANTI JOIN bgd USING (run_id, fp)
  WHERE n_seeds >= 2 AND mean >= b - %s)""" % WIDE


@query("unbagged_groups", f"WITH {LEDGER}, {SEEDS}, {BAGGED} SELECT run_id, fp, n_seeds, round(mean, 9) AS mean FROM ub")
def unbagged_groups(spark, sf):
    return tidy(L.unbagged_groups(ledger(spark, sf), WIDE).drop("lead_node"))


CONS = f"""{_near(EPS, 'nt')}, {_near(WIDE, 'nw')},
cset AS (SELECT run_id, fp FROM nt UNION ALL SELECT run_id, fp FROM nw WHERE run_id NOT IN (SELECT run_id FROM nt)),
lastc AS (SELECT run_id, arg_max(members, seq) AS members FROM ledger WHERE stage = 'ensemble' AND NOT is_buggy AND NOT is_skip AND ensemble_kind = 'complementary'
  AND prim IS NOT NULL GROUP BY 1),
cov AS (SELECT DISTINCT l.run_id, l.fp FROM (SELECT run_id, unnest(members) AS m FROM lastc) c JOIN ledger l ON l.node_id = c.m AND l.run_id = c.run_id),
stale AS (SELECT DISTINCT run_id FROM cset ANTI JOIN cov USING (run_id, fp)),
fill AS (SELECT g.run_id, fp, lead_node AS node_id, mean FROM sg g JOIN (SELECT run_id, max(mean) AS b FROM sg GROUP BY 1) USING (run_id)
  WHERE n_seeds < 2 AND mean >= b - {EPS} AND lstage <> 'draft' AND NOT (lhi < 0))"""


@query("complementary_set", f"WITH {LEDGER}, {SEEDS}, {CONS} SELECT run_id, fp FROM cset")
def complementary_set(spark, sf):
    return L.complementary_set(ledger(spark, sf), EPS, WIDE)


@query("seed_fill", f"WITH {LEDGER}, {SEEDS}, {CONS} SELECT run_id, fp, node_id, round(mean, 9) AS mean FROM fill")
def seed_fill(spark, sf):
    return tidy(L.seed_fill(ledger(spark, sf), EPS))


@query(
    "consolidation",
    f"""WITH {LEDGER}, {SEEDS}, {CONS}, {BAGGED.replace(str(WIDE), str(EPS))} SELECT run_id, CASE WHEN run_id IN (SELECT run_id FROM ub) THEN 'same_config'
    WHEN run_id IN (SELECT run_id FROM stale) THEN 'complementary' WHEN run_id IN (SELECT run_id FROM fill) THEN 'seed_fill' ELSE '' END AS pending
    FROM (SELECT DISTINCT run_id FROM ledger)""",
)
def consolidation(spark, sf):
    return L.consolidation(ledger(spark, sf), EPS, WIDE)


@query(
    "find_duplicates",
    f"""WITH {LEDGER}, f AS (SELECT run_id, fp || '|' || source_hash AS k, min(seq) AS s FROM ledger WHERE NOT is_skip GROUP BY 1, 2)
    SELECT l.run_id, l.node_id, f.s AS first_node FROM ledger l JOIN f ON f.run_id = l.run_id AND f.k = l.fp || '|' || l.source_hash WHERE l.seq > f.s""",
)
def find_duplicates(spark, sf):
    return L.find_duplicates(ledger(spark, sf))


@query(
    "lookup_seed",
    f"""WITH {LEDGER}, jobs AS (SELECT DISTINCT node_id AS job_id, run_id, parent_id, fp, seed, 'h0' AS version FROM ledger WHERE stage = 'ablate'),
    done AS (SELECT * FROM ledger WHERE is_child AND {GOOD} AND NOT {TIMEOUT})
    SELECT job_id, (SELECT max(d.node_id) FROM done d WHERE d.run_id = j.run_id AND d.parent_id // 3 = j.parent_id // 3 AND d.source_hash = 'h0' AND d.seed = j.seed) AS cached_from
    FROM jobs j""",
)
def lookup_seed(spark, sf):
    """Parents are grouped by three and configs dropped so that the mapped ledger has cache hits."""
    rows = ledger(spark, sf).withColumn("parent_id", F.floor(F.col("parent_id") / 3).cast("long"))
    rows = rows.withColumn("config", F.create_map(F.lit("seed"), F.lit("0")))
    jobs = rows.where(F.col("stage") == "ablate").select(
        F.col("node_id").alias("job_id"), "run_id", "parent_id", E.fingerprint("config").alias("fp"), "seed", F.lit("h0").alias("version")
    )
    return L.lookup_seed(jobs, rows).select("job_id", "cached_from")


GRID_SQL = """grid(arm, key, val) AS (VALUES ('capacity', 'k', '8'), ('capacity', 'k', '32'), ('capacity', 'k', '64'), ('loss', 'loss', '"bpr"'),
  ('sequence', 'seq_len', '50'), ('sequence', 'seq_len', '100'), ('features', 'use_time_decay', 'true')),
cell AS (SELECT b.run_id, b.node_id AS parent_id, b.fp AS base_fp, source_hash, arm, key || '=' || val AS patch_fp,
  CASE WHEN key = 'k' THEN val ELSE k END AS k, CASE WHEN key = 'loss' THEN val ELSE loss END AS loss,
  CASE WHEN key = 'seq_len' THEN val ELSE seq_len END AS seq_len, CASE WHEN key = 'use_time_decay' THEN val ELSE utd END AS utd
  FROM best b, grid g(arm, key, val)),
cells AS (SELECT *, concat_ws(';', CASE WHEN k <> '16' THEN 'k=' || k END, CASE WHEN loss <> '"logloss"' THEN 'loss=' || loss END,
  CASE WHEN seq_len <> '0' THEN 'seq_len=' || seq_len END, CASE WHEN utd = 'true' THEN 'use_time_decay=true' END) AS fp FROM
  (SELECT c.* REPLACE (c.arm AS arm) FROM cell c)),
untr AS (SELECT run_id, arm, patch_fp FROM cells c WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE l.run_id = c.run_id AND NOT l.is_skip
  AND l.fp = c.fp AND l.source_hash = c.source_hash))"""
GRID_SQL = GRID_SQL.replace("b.source_hash", "source_hash").replace("source_hash, arm,", "b.source_hash, g.arm,").replace("FROM best b, grid g(arm, key, val))", "FROM best b, grid g)")


@query("untried_patches", f"WITH {LEDGER}, {BEST}, {GRID_SQL} SELECT run_id, arm, patch_fp FROM untr")
def untried_patches(spark, sf):
    return L.untried(ledger(spark, sf), GRID)


GRAVES = "dead AS (SELECT DISTINCT fp FROM ledger WHERE ci95_hi < -0.009 AND ci95_hi >= -0.0095)"


@query(
    "untried_without_graves",
    f"WITH {LEDGER}, {BEST}, {GRID_SQL}, {GRAVES} SELECT run_id, arm, patch_fp FROM untr WHERE patch_fp NOT IN (SELECT fp FROM dead)",
)
def untried_without_graves(spark, sf):
    rows = ledger(spark, sf)
    scale = F.when(F.col("ci95_hi") < -0.0095, "1k").otherwise("pure")  # graves of another scale bury nothing here
    graves = rows.where(F.col("ci95_hi") < -0.009).select(scale.alias("scale"), E.fingerprint("config").alias("fingerprint"))
    return L.untried(rows, GRID, graves)


@query(
    "unsettled_patches",
    f"""WITH {LEDGER}, {BEST}, {GRID_SQL} SELECT run_id, parent_id, arm, patch_fp FROM cells c WHERE fp <> base_fp AND NOT EXISTS
    (SELECT 1 FROM ledger l WHERE l.run_id = c.run_id AND l.parent_id = c.parent_id AND NOT l.is_skip AND l.fp = c.patch_fp)""",
)
def unsettled_patches(spark, sf):
    return L.unsettled(ledger(spark, sf), GRID)


@query(
    "exhausted_arms",
    f"""WITH {LEDGER}, {BEST}, {GRID_SQL} SELECT b.run_id, a.arm FROM best b, (SELECT DISTINCT arm FROM grid) a
    WHERE NOT EXISTS (SELECT 1 FROM untr u WHERE u.run_id = b.run_id AND u.arm = a.arm)""",
)
def exhausted_arms(spark, sf):
    return L.exhausted_arms(ledger(spark, sf), GRID)


@query(
    "tried_by_parent",
    f"""WITH {LEDGER}, t AS (SELECT run_id, parent_id, arm, fp, min(seq) AS s FROM ledger WHERE NOT is_skip AND fp <> '' GROUP BY 1, 2, 3, 4)
    SELECT run_id, parent_id, arm, fp, row_number() OVER (PARTITION BY run_id, parent_id, arm ORDER BY s) AS place FROM t""",
)
def tried_by_parent(spark, sf):
    return tidy(L.tried_by_parent(ledger(spark, sf)))


@query(
    "crossover_candidates",
    f"""WITH {LEDGER}, {BEST}, {SEEDS}, {_near(WIDE, 'nt')},
    w AS (WITH RECURSIVE r(node_id, cur, dist) AS (SELECT node_id, node_id, 0 FROM best UNION ALL
      SELECT r.node_id, l.parent_id, r.dist + 1 FROM r JOIN ledger l ON l.node_id = r.cur
      WHERE NOT (l.confirmed OR l.stage = 'ensemble') AND l.parent_id IS NOT NULL) SELECT * FROM r),
    hit AS (SELECT w.node_id, min_by(cur, dist) AS h FROM w JOIN ledger l ON l.node_id = cur WHERE l.confirmed OR l.stage = 'ensemble' GROUP BY 1),
    keep AS (SELECT b.run_id, k.fp, k.seq_len, k.utd FROM best b LEFT JOIN hit USING (node_id) JOIN ledger k ON k.node_id = coalesce(h, b.node_id)),
    m AS (SELECT nt.run_id, nt.fp AS partner, nt.first_seq, concat_ws(';', CASE WHEN o.seq_len <> '0' AND o.seq_len <> keep.seq_len THEN 'seq_len=' || o.seq_len END,
      CASE WHEN o.utd = 'true' AND keep.utd <> 'true' THEN 'use_time_decay=true' END) AS delta_fp
      FROM nt JOIN keep USING (run_id) JOIN ledger o ON o.seq = nt.first_seq WHERE nt.fp <> keep.fp),
    d AS (SELECT run_id, delta_fp, min(first_seq) AS s, arg_min(partner, first_seq) AS partner FROM m WHERE delta_fp <> '' GROUP BY 1, 2),
    spent AS (SELECT run_id FROM ledger WHERE seq % 40 = 7 GROUP BY 1 HAVING count(*) >= 3),
    done AS (SELECT DISTINCT run_id FROM ledger WHERE seq % 3 = 1 AND run_id % 2 = 0)
    SELECT run_id, delta_fp, partner, row_number() OVER (PARTITION BY run_id ORDER BY s) AS place FROM d
    WHERE run_id NOT IN (SELECT run_id FROM spent) AND NOT (delta_fp = 'use_time_decay=true' AND run_id IN (SELECT run_id FROM done))""",
)
def crossover_candidates(spark, sf):
    merged = (F.col("seq") % 3 == 1) & (F.col("run_id") % 2 == 0)
    rows = ledger(spark, sf).withColumns(
        {"crossover": F.col("seq") % 40 == 7, "crossover_delta": F.when(merged, "use_time_decay=true")}
    )
    return tidy(L.crossover_candidates(rows, WIDE))


@query(
    "expand_jobs",
    f"""WITH {LEDGER}, c AS (SELECT run_id, fp, min(seq) AS s FROM ledger WHERE stage = 'improve' GROUP BY 1, 2),
    r AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY s) - 1 AS config_idx FROM c)
    SELECT run_id, config_idx, fp, seed, printf('c%d_s%d', config_idx, seed) AS label FROM (SELECT *, unnest([0, 1, 2, 3, 4]::BIGINT[]) AS seed FROM r)""",
)
def expand_jobs(spark, sf):
    """Specs from the ledger: the first improve config is pending, the first later ones follow."""
    rows = ledger(spark, sf).where(F.col("stage") == "improve")
    per_fp = rows.groupBy("run_id", E.fingerprint("config").alias("fp")).agg(
        F.min("seq").alias("s"), F.min_by("config", "seq").alias("config")
    )
    listed = per_fp.groupBy("run_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("s", "fp"))), lambda e: e["fp"]).alias("fps"),
        F.min_by("config", "s").alias("pending"),
        F.map_from_entries(F.collect_list(F.struct("fp", "config"))).alias("by_fp"),
    )
    specs = listed.select(
        "run_id", "pending", F.transform("fps", lambda f: F.col("by_fp")[f]).alias("configs"), F.array(*[F.lit(i) for i in range(5)]).alias("seeds")
    )
    return tidy(L.expand_jobs(specs))


ST = f"""bar AS (SELECT run_id, submit AS bar FROM best),
runs AS (SELECT l.*, bar / 2 AS bar FROM ledger l JOIN bar USING (run_id) WHERE stage = 'ablate' AND prim IS NOT NULL),
stt AS (SELECT run_id, config_idx, count(*) AS n_seeds, count(*) FILTER (prim > bar) AS n_pos_seeds, avg(prim) AS mean, stddev_pop(prim) AS std, any_value(bar) AS bar FROM runs GROUP BY 1, 2),
sl AS (SELECT run_id, config_idx, seed, arg_max(prim, seq) AS p FROM runs GROUP BY 1, 2, 3),
pwt AS (SELECT a.run_id, a.config_idx AS left_idx, b.config_idx AS right_idx, count(*) AS n_seeds, count(*) FILTER (b.p > a.p) AS n_pos_right,
  count(*) FILTER (b.p < a.p) AS n_neg_right, avg(b.p - a.p) AS mean_delta FROM sl a JOIN sl b ON a.run_id = b.run_id AND a.seed = b.seed AND a.config_idx < b.config_idx GROUP BY 1, 2, 3)"""


def _runs(spark, sf):
    """Ablation rows with half the incumbent's score as the bar."""
    rows = ledger(spark, sf)
    bar = L.best_node(rows).select("run_id", (F.col("submit") / 2).alias("bar"))
    return rows.where(F.col("stage") == "ablate").join(bar, "run_id")


@query(
    "seed_table",
    f"WITH {LEDGER}, {BEST}, {ST} SELECT run_id, config_idx, n_seeds, n_pos_seeds, round(mean, 9) AS mean, round(std, 9) AS std FROM stt",
)
def seed_table(spark, sf):
    return tidy(L.seed_table(_runs(spark, sf), ["run_id"]).drop("bar"))


@query(
    "pairwise_seed_table",
    f"WITH {LEDGER}, {BEST}, {ST} SELECT run_id, left_idx, right_idx, n_seeds, n_pos_right, n_neg_right, round(mean_delta, 9) AS mean_delta FROM pwt",
)
def pairwise_seed_table(spark, sf):
    return tidy(L.pairwise_seed_table(_runs(spark, sf), ["run_id"]))


@query(
    "ablation_winner",
    f"""WITH {LEDGER}, {BEST}, {ST}, c AS (SELECT run_id, count(*) AS k, max(CASE WHEN config_idx = 0 THEN n_seeds >= 3 AND n_pos_seeds = n_seeds END) AS c0,
      max(config_idx) AS mx, any_value(config_idx) AS one, any_value(n_seeds >= 3 AND n_pos_seeds = n_seeds) AS ap,
      any_value(mean - bar >= 0.002 AND n_pos_seeds > n_seeds / 2) AS maj FROM stt GROUP BY 1)
    SELECT c.run_id, CASE WHEN k >= 2 AND mx = 1 AND d.n_seeds >= 3 AND d.n_pos_right = d.n_seeds THEN 1 WHEN k >= 2 AND c0 THEN 0
      WHEN k = 1 AND (ap OR maj) THEN one END::BIGINT AS winner FROM c LEFT JOIN pwt d ON d.run_id = c.run_id AND left_idx = 0 AND right_idx = 1""",
)
def ablation_winner(spark, sf):
    runs = _runs(spark, sf)
    return tidy(L.ablation_winner(L.seed_table(runs, ["run_id"]), L.pairwise_seed_table(runs, ["run_id"]), ["run_id"]))


@query(
    "cost_totals",
    f"""WITH {LEDGER} SELECT run_id, sum(tokens_in)::DOUBLE AS tokens_in, sum(tokens_out)::DOUBLE AS tokens_out, round(sum(wall_seconds) / 3600, 9) AS compute_hours
    FROM ledger GROUP BY 1""",
)
def cost_totals(spark, sf):
    return tidy(L.cost_totals(ledger(spark, sf), ["run_id"]))


@query(
    "stack_coverage",
    f"""WITH {LEDGER} SELECT run_id, arm, CAST(grouping_id(run_id, arm) AS BIGINT) AS level, count(*) FILTER (NOT (stage IN ('eda', 'ensemble') OR is_child)) AS billed,
    count(*) FILTER (is_skip) AS skip, count(*) FILTER (NOT is_skip AND prim IS NOT NULL) AS scored FROM ledger WHERE NOT is_child GROUP BY ROLLUP (run_id, arm)""",
)
def stack_coverage(spark, sf):
    return tidy(L.stack_coverage(ledger(spark, sf)))


@query(
    "run_summary",
    f"""WITH {LEDGER}, {BEST}, a AS (SELECT run_id, count(*) AS nodes, count(*) FILTER (NOT (stage IN ('eda', 'ensemble') OR is_child)) AS iterations,
      count(*) FILTER (NOT (stage IN ('eda', 'ensemble') OR is_child) AND NOT is_skip) AS useful, count(*) FILTER (stage = 'ablate') AS n_ablate,
      count(*) FILTER ({GOOD} AND confirmed) AS n_confirmed, sum(tokens_in + tokens_out)::BIGINT AS tokens_total, sum(wall_seconds) / 3600 AS ch FROM ledger GROUP BY 1)
    SELECT a.run_id, nodes, iterations, useful, CAST(0 AS BIGINT) AS n_research, n_ablate, n_confirmed, tokens_total, round(ch, 9) AS compute_hours,
    round(tokens_total / useful, 9) AS tokens_per_useful, b.node_id AS incumbent, round(b.submit, 9) AS incumbent_score FROM a LEFT JOIN best b USING (run_id)""",
)
def run_summary(spark, sf):
    return tidy(L.run_summary(ledger(spark, sf)))


@query(
    "interventions",
    """WITH c AS (SELECT CASE WHEN role = 'user' THEN 'human_ablate' ELSE 'note' END AS kind, CASE turn % 3 WHEN 0 THEN 'runtime' WHEN 1 THEN 'build-time' END AS phase FROM conversations)
    SELECT CASE WHEN phase = 'runtime' THEN 'runtime' WHEN phase = 'build-time' THEN 'build_time' WHEN kind <> 'human_ablate' THEN 'runtime' ELSE 'build_time' END AS phase_kind,
    count(*) AS n FROM c GROUP BY 1""",
)
def interventions(spark, sf):
    rows = table(spark, sf, "conversations").select(
        F.when(F.col("role") == "user", "human_ablate").otherwise("note").alias("kind"),
        F.when(F.col("turn") % 3 == 0, "runtime").when(F.col("turn") % 3 == 1, "build-time").alias("phase"),
    )
    return L.interventions(rows)


@query(
    "calibration",
    f"""WITH {LEDGER}, c AS (SELECT run_id, count(*) AS n, count(*) FILTER (ci95_lo <= expected_delta AND expected_delta <= ci95_hi) AS within,
      avg(expected_delta - delta_primary) AS b FROM ledger WHERE expected_delta IS NOT NULL AND delta_primary IS NOT NULL GROUP BY 1)
    SELECT run_id, n, within, round(b, 9) AS mean_bias, CASE WHEN b > 0 THEN 'over-optimistic' ELSE 'under-optimistic' END AS tag FROM c""",
)
def calibration(spark, sf):
    return tidy(L.calibration(ledger(spark, sf)))


RAN = f"(stage = 'improve' AND arm <> 'ablate' AND NOT is_skip AND NOT is_buggy AND NOT {TIMEOUT})"


@query(
    "arm_posterior",
    f"""WITH {LEDGER}, c AS (SELECT arm, count(*) FILTER ({RAN} AND screen_pass) AS a,
      count(*) FILTER (({RAN} AND NOT screen_pass AND delta_primary < -2 * se) OR is_skip) AS b FROM ledger GROUP BY 1)
    SELECT arm, (2.0 + a)::DOUBLE AS alpha, (3.0 + b)::DOUBLE AS beta FROM c""",
)
def arm_posterior(spark, sf):
    rows = ledger(spark, sf)
    priors = rows.select("arm").distinct().withColumn("alpha", F.lit(2.0)).withColumn("beta", F.lit(3.0))
    return L.arm_posterior(rows, priors)


@query(
    "recent_facts",
    f"""WITH {LEDGER}, imp1 AS (SELECT * FROM ledger WHERE stage = 'improve' AND arm <> 'ablate'),
    s AS (SELECT run_id, node_id, 'screen' AS fact, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM imp1 WHERE NOT is_skip),
    f0 AS (SELECT run_id, fp, min(seq) AS seq FROM imp1 WHERE NOT is_skip AND ci95_hi < 0 AND delta_primary IS NOT NULL GROUP BY 1, 2),
    f AS (SELECT run_id, seq AS node_id, 'falsified' AS fact, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM f0),
    t AS (SELECT run_id, node_id, 'timeout' AS fact, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM ledger WHERE {TIMEOUT}),
    a AS (SELECT run_id, node_id, 'ablate' AS fact, row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) AS age FROM ledger WHERE stage = 'ablate')
    SELECT * FROM s UNION ALL SELECT * FROM f UNION ALL SELECT * FROM t UNION ALL SELECT * FROM a
    UNION ALL SELECT run_id, node_id, 'confirmed', NULL FROM ledger WHERE {GOOD} AND confirmed""",
)
def recent_facts(spark, sf):
    return tidy(L.recent_facts(ledger(spark, sf)).drop("seq"))


# ---- gates -----------------------------------------------------------------------------

UNSTABLE = "(se > 0 AND (temporal_disagree > 4 * se OR (delta_front * delta_back < 0 AND temporal_disagree > 2 * se)))"


@query("temporal_unstable", f"WITH {LEDGER} SELECT node_id, {UNSTABLE} AS unstable FROM ledger")
def temporal_unstable(spark, sf):
    return ledger(spark, sf).select("node_id", D.temporal_unstable().alias("unstable"))


@query(
    "screen_gate",
    f"""WITH {LEDGER} SELECT node_id, CASE WHEN NOT ({GOOD}) THEN 'buggy' WHEN top1_agree > 0.97 THEN 'near duplicate' WHEN {UNSTABLE} THEN 'unstable over time'
    WHEN least(delta_front, delta_back) < 0.001 THEN 'a half misses' WHEN ci95_lo <= 0 THEN 'interval covers zero' WHEN delta_ndcg < 0 THEN 'ndcg down'
    WHEN coalesce(delta_primary, 0) >= 0.001 AND delta_gauc >= 0.0008 THEN 'passed' ELSE 'missed' END AS reason FROM ledger""",
)
def screen_gate(spark, sf):
    return D.screen(ledger(spark, sf)).select("node_id", "reason")


@query(
    "confirm_gate",
    f"""WITH {LEDGER}, c AS (SELECT *, 1 + seq % 4 AS ns, (seq // 4) % (2 + seq % 4) AS np, seq % 5 <> 0 AS win FROM ledger),
    r AS (SELECT *, CASE WHEN {TIMEOUT} THEN 'partial' WHEN NOT win THEN 'not winner' WHEN ns < 3 THEN 'need 3 seeds' WHEN np = ns THEN 'all seeds agree'
      WHEN d >= 0.002 AND np > ns / 2 THEN 'majority above epsilon' ELSE 'mixed' END AS reason FROM c)
    SELECT node_id, reason, reason IN ('all seeds agree', 'majority above epsilon') AS promote, (reason = 'all seeds agree' AND abs(d) < 0.002) AS weak FROM r""",
)
def confirm_gate(spark, sf):
    rows = ledger(spark, sf)
    cmp = rows.withColumns(
        {
            "delta": (E.uniform("seq", 1) - 0.5) * 0.02,
            "n_seeds": 1 + F.col("seq") % 4,
            "n_pos_seeds": F.floor(F.col("seq") / 4) % (2 + F.col("seq") % 4),
            "is_winner": F.col("seq") % 5 != 0,
        }
    )
    return D.confirm(cmp).select("node_id", "reason", "promote", "weak")


ENS = """CASE WHEN prim IS NULL THEN 'no metrics' WHEN (ensemble_kind IN ('complementary', 'cross_identity') OR coalesce(blend_alpha, 0) <> 0)
  AND NOT (se > 0 AND prim > 0.25 + 2 * se) THEN 'blend inside noise' WHEN ci95_lo <= 0 THEN 'interval covers zero' WHEN prim - 0.25 >= 0 AND delta_gauc >= 0 THEN 'no loss'
  WHEN prim - 0.25 >= 0.002 THEN 'gain above epsilon' ELSE 'no gain' END"""


@query(
    "ensemble_gate",
    f"""WITH {LEDGER} SELECT node_id, {ENS} AS reason, {ENS} IN ('no loss', 'gain above epsilon') AS promote FROM ledger WHERE stage = 'ensemble'""",
)
def ensemble_gate(spark, sf):
    rows = ledger(spark, sf).where(F.col("stage") == "ensemble").withColumn("bar", F.lit(0.25))
    return D.promote_ensemble(rows).select("node_id", "reason", "promote")


@query(
    "overturns",
    f"""WITH {LEDGER}, {BEST} SELECT l.run_id, l.node_id, b.node_id AS incumbent, round(l.submit, 9) AS submit FROM ledger l JOIN best b USING (run_id)
    WHERE l.node_id <> b.node_id AND l.submit > b.submit""",
)
def overturns(spark, sf):
    return tidy(D.overturns(ledger(spark, sf)))


@query(
    "reconcile_metrics",
    f"""WITH {SCORES}, {UM}, {RM}, c(model_id, d) AS (VALUES ('m0', 0.0), ('m1', 0.00005), ('m2', 0.001), ('m9', 0.0))
    SELECT c.model_id, round(rm."primary", 9) AS trusted, CASE WHEN rm."primary" IS NULL THEN 'no scores' WHEN abs(d) > 0.0001 THEN 'mismatch' ELSE 'ok' END AS status
    FROM c LEFT JOIN rm USING (model_id)""",
)
def reconcile_metrics(spark, sf):
    """Claims are the true values shifted by a known amount, and one model without a score pack."""
    from rankspark.operators.metrics import ranking_metrics

    scores = score_table(spark, sf)
    shift = F.create_map(F.lit("m0"), F.lit(0.0), F.lit("m1"), F.lit(0.00005), F.lit("m2"), F.lit(0.001))
    true = ranking_metrics(scores).where(F.col("model_id") != "m3")
    claimed = true.select("model_id", (F.col("primary") + shift[F.col("model_id")]).alias("claimed"))
    ghost = scores.select(F.lit("m9").alias("model_id"), F.lit(0.5).alias("claimed")).distinct()
    return tidy(D.reconcile_metrics(claimed.unionByName(ghost), scores).select("model_id", "trusted", "status"))


def _members(spark, sf):
    """Every confirmed ledger node names a score pack by size and seed; nodes of equal size, loss and decay flag are the seeds of one identity. Small
    models count without time decay and larger ones with it, so that no two identities have the same packs."""
    of = lambda key: F.col("config")[key]
    rows = ledger(spark, sf).where(F.col("confirmed") & ~((of("loss") == '"bpr"') & (F.col("seed") == 2)))
    rows = rows.where((of("k") == "8") == (of("use_time_decay") == "false"))
    size = F.when(of("k") == "8", 0).when(of("k") == "16", 1).otherwise(2)
    pack = F.concat(F.lit("m"), ((size + F.col("seed")) % 4).cast("string"))
    config = F.map_filter("config", lambda k, v: k.isin("k", "loss", "use_time_decay"))
    named = rows.select(pack.alias("model_id"), F.concat_ws("/", of("k"), of("loss"), of("use_time_decay")).alias("identity"), config.alias("config"), "primary")
    return named.groupBy("model_id", "identity").agg(F.first("config").alias("config"), F.avg("primary").alias("primary"))


MEMBERS = """mem AS (SELECT 'm' || ((CASE k WHEN '8' THEN 0 WHEN '16' THEN 1 ELSE 2 END + seed) % 4) AS model_id, k || '/' || loss || '/' || utd AS ident, k, loss, utd, avg(prim) AS prim
  FROM ledger WHERE confirmed AND NOT (loss = '"bpr"' AND seed = 2) AND (k = '8') = (utd = 'false') GROUP BY ALL)"""

BAGS = f"""{MEMBERS}, many AS (SELECT ident FROM mem GROUP BY 1 HAVING count(*) >= 2),
rp AS (SELECT s.*, ident, row_number() OVER (PARTITION BY ident, s.model_id, user_id ORDER BY score DESC, row_id) - 1 AS p FROM scores s JOIN mem USING (model_id) WHERE ident IN (SELECT ident FROM many)),
bags AS (SELECT ident AS model_id, row_id, user_id, any_value(label) AS label, -avg(p) AS score, any_value(date) AS date FROM rp GROUP BY 1, 2, 3),
{user_metrics_sql('bags', 'model_id', 'bm')}, {summary_sql('bm', 'model_id', 'br')}"""


def _halves_sql(src: str, name: str) -> str:
    """Weaker half of every model of src."""
    return f"""{name}c AS (SELECT model_id, quantile_cont(date, 0.5) AS md, count(*) AS n FROM {src} GROUP BY 1),
{name}f AS (SELECT s.model_id, any_value(n) AS n, count(*) FILTER (date <= md) AS f FROM {src} s JOIN {name}c USING (model_id) GROUP BY 1),
{name}b AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY s.model_id ORDER BY row_id) <= CASE WHEN f < 16 OR n - f < 16 THEN n // 2 ELSE f END THEN 'front' ELSE 'back' END AS half
  FROM {src} s JOIN {name}f USING (model_id) WHERE n >= 32),
{user_metrics_sql(f'{name}b', 'model_id, half', f'{name}m')}, {summary_sql(f'{name}m', 'model_id, half', f'{name}r')},
{name} AS (SELECT model_id, min("primary") AS robust FROM {name}r GROUP BY 1)"""


FLAGS = """(k <> '16')::INT + (loss <> '"logloss"')::INT + (utd = 'true')::INT"""
CAND = f"""{BAGS}, {_halves_sql('bags', 'hb')},
cand AS (SELECT br.model_id AS candidate, br."primary" AS score, coalesce(robust, br."primary") AS robust, {FLAGS} AS n_flags, k, loss, utd
  FROM br LEFT JOIN hb USING (model_id) JOIN (SELECT DISTINCT ident, k, loss, utd FROM mem) c ON c.ident = br.model_id)"""


@query(
    "bag_candidates",
    f"WITH {SCORES}, {LEDGER}, {CAND} SELECT candidate, round(score, 9) AS score, round(robust, 9) AS robust, CAST(n_flags AS BIGINT) AS n_flags FROM cand",
)
def bag_candidates(spark, sf):
    members = _members(spark, sf)
    return tidy(D.bag_candidates(D.identity_bags(score_table(spark, sf), members), members).drop("kind"))


def _search_sql(pairs: str) -> str:
    """Sweep, bootstrap and halves of the pairs (pair, l, r) of bags; `found` has a row per pair."""
    return f"""sd AS (SELECT pair, a.row_id, a.user_id, a.label, a.date, a.score AS sa, b.score AS sb FROM {pairs} JOIN bags a ON a.model_id = l JOIN bags b ON b.model_id = r AND b.row_id = a.row_id),
pz AS (SELECT *, (sa - min(sa) OVER w) / (max(sa) OVER w - min(sa) OVER w) AS z1, (sb - min(sb) OVER w) / (max(sb) OVER w - min(sb) OVER w) AS z2 FROM sd WINDOW w AS (PARTITION BY pair)),
gr AS (SELECT pair, row_id, user_id, label, alpha, gamma, (1.0 - alpha) * z1 + alpha * z2 + gamma * z1 * z2 AS score
  FROM pz, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS alpha), (SELECT unnest([0.0, 0.1, 0.2]::DOUBLE[]) AS gamma)),
{user_metrics_sql('gr', 'pair, alpha, gamma', 'gm')}, {summary_sql('gm', 'pair, alpha, gamma', 'grm')},
pt AS (SELECT pair, alpha, gamma FROM grm QUALIFY row_number() OVER (PARTITION BY pair ORDER BY grm."primary" DESC, alpha, gamma) = 1),
fz AS (SELECT pair AS model_id, row_id, user_id, label, date, (1.0 - alpha) * z1 + alpha * z2 + gamma * z1 * z2 AS score FROM pz JOIN pt USING (pair)),
{user_metrics_sql('fz', 'model_id', 'um')}, {summary_sql('um', 'model_id', 'tr')},
bz AS (SELECT pair AS model_id, row_id, user_id, label, sa AS score FROM sd), {user_metrics_sql('bz', 'model_id', 'ub')}, {summary_sql('ub', 'model_id', 'tb')},
pairs AS (SELECT a.model_id, a.user_id, a.n_pos, a.auc, a.ndcg, b.n_pos AS n_pos_inc, b.auc AS auc_inc, b.ndcg AS ndcg_inc FROM um a JOIN ub b USING (model_id, user_id)), {BOOT},
bt AS (SELECT model_id, stddev_samp(delta) AS se, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM deltas GROUP BY 1), {_halves_sql('fz', 'fh')},
found AS (SELECT tr.model_id AS pair, alpha, gamma, tr."primary" AS blend, tb."primary" AS bag, se, lo, hi, robust
  FROM tr JOIN tb USING (model_id) JOIN pt ON pt.pair = tr.model_id LEFT JOIN bt USING (model_id) LEFT JOIN fh USING (model_id))"""


PICK = f"""{CAND}, rkd AS (SELECT *, row_number() OVER (ORDER BY score DESC, candidate) AS rn, max(score) OVER () AS best FROM cand),
nr AS (SELECT count(*) AS n FROM rkd WHERE score >= best - 0.002),
prs AS (SELECT t.candidate || '+' || o.candidate AS pair, t.candidate AS l, o.candidate AS r, o.n_flags FROM rkd o, rkd t, nr
  WHERE t.rn = 1 AND o.rn > 1 AND o.score >= o.best - CASE WHEN n >= 2 THEN 0.002 ELSE 0.03 END AND NOT (o.utd = 'true' AND t.utd = 'true')),
{_search_sql('prs')},
allc AS (SELECT candidate, score, robust, n_flags, 'bag' AS kind FROM cand
  UNION ALL SELECT pair, blend, coalesce(robust, blend), n_flags, 'blend' FROM found JOIN prs USING (pair) WHERE se > 0 AND blend > (SELECT max(score) FROM cand) + 2 * se
  UNION ALL SELECT CAST(node_id AS VARCHAR), prim, prim, (k <> '16')::INT + (loss <> '"logloss"')::INT + (seq_len <> '0')::INT + (utd = 'true')::INT, 'node' FROM ledger
    WHERE stage = 'ensemble' AND prim IS NOT NULL AND NOT is_skip AND (ensemble_kind = 'same_config' OR (se > 0 AND prim > (SELECT max(score) FROM cand) + 2 * se)))"""


@query(
    "final_candidates",
    f"WITH {SCORES}, {LEDGER}, {PICK} SELECT candidate, round(score, 8) AS score, round(robust, 8) AS robust, CAST(n_flags AS BIGINT) AS n_flags, kind FROM allc",
)
def final_candidates(spark, sf):
    return tidy(D.final_candidates(cut_lineage(score_table(spark, sf)), _members(spark, sf), ledger(spark, sf)), 8)


@query(
    "blend_pairs",
    f"""WITH {SCORES}, {LEDGER}, {PICK} SELECT pair, alpha AS blend_alpha, gamma AS blend_gamma, round(blend, 7) AS blend_primary, round(bag, 7) AS bag_primary,
    round(se, 7) AS se_val_delta, round(lo, 7) AS ci95_lo, round(hi, 7) AS ci95_hi, round(robust, 7) AS robust FROM found""",
)
def blend_pairs(spark, sf):
    """Every admissible blend of the best bag, won or not."""
    members = _members(spark, sf)
    fused = D.identity_bags(cut_lineage(score_table(spark, sf)), members)
    pairs = D.candidate_pairs(members, cut_lineage(D.bag_candidates(fused, members)))
    return tidy(B.search_pairs(fused, pairs.drop("n_flags")), 7)


@query(
    "pick_final",
    f"""WITH {SCORES}, {LEDGER}, {PICK} SELECT candidate, round(score, 8) AS score, round(robust, 8) AS robust, CAST(n_flags AS BIGINT) AS n_flags, kind FROM allc
    WHERE robust >= (SELECT max(robust) FROM allc) - 0.002 ORDER BY n_flags, allc.score DESC, allc.robust DESC LIMIT 1""",
)
def pick_final(spark, sf):
    return tidy(D.pick_final(cut_lineage(score_table(spark, sf)), _members(spark, sf), ledger=ledger(spark, sf)), 8)


@query(
    "complementary_blend",
    f"""WITH {SCORES}, {LEDGER}, {BAGS.replace('HAVING count(*) >= 2', '')}, mean AS (SELECT ident, avg(prim) AS m FROM mem GROUP BY 1),
    tk AS (SELECT model_id, user_id, row_id, count(*) OVER (PARTITION BY model_id, user_id) AS c, row_number() OVER (PARTITION BY model_id, user_id ORDER BY score DESC, row_id) AS pos FROM bags),
    t1 AS (SELECT * FROM tk WHERE pos = 1 AND c >= 2), best AS (SELECT ident AS b FROM mean ORDER BY m DESC, ident LIMIT 1),
    ga AS (SELECT r.model_id, avg(CASE WHEN l.row_id = r.row_id THEN 1.0 ELSE 0 END) AS agree FROM best JOIN t1 l ON l.model_id = b JOIN t1 r ON l.user_id = r.user_id AND r.model_id <> b GROUP BY 1),
    one AS (SELECT 'blend' AS pair, b AS l, model_id AS r, agree FROM ga, best ORDER BY agree, model_id LIMIT 1), {_search_sql('one')},
    ok AS (SELECT *, coalesce(se > 0 AND blend > bag + 2 * se, false) AS won FROM found JOIN one USING (pair))
    SELECT l AS best_identity, r AS partner, round(agree, 7) AS blend_top1, round(bag, 7) AS bag_primary, round(blend, 7) AS blend_primary, round(se, 7) AS se_val_delta,
    round(lo, 7) AS ci95_lo, round(hi, 7) AS ci95_hi, won AS accepted, CASE WHEN won THEN alpha ELSE 0 END AS blend_alpha, CASE WHEN won THEN gamma ELSE 0 END AS blend_gamma FROM ok""",
)
def complementary_blend(spark, sf):
    return tidy(B.complementary_blend(cut_lineage(score_table(spark, sf)), _members(spark, sf)), 7)

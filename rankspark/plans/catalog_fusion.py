"""Item-CF, score scaling, fusion, blend search and model comparison queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import fusion as B
from rankspark.operators import itemcf as C
from rankspark.plans.catalog_metrics import BOOT, HALF, PAIRS, RM, UM, _agree_sql
from rankspark.plans.views import IMP, SCORES, score_table, summary_sql, tidy, train_rows, user_metrics_sql
from rankspark.session import cut_lineage
from rankspark.sources.mapped import impressions

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


POS = """pos AS (SELECT DISTINCT user_id, video_id FROM imp WHERE split = 'train' AND long_view = 1),
pop AS (SELECT video_id, count(*) AS pop FROM imp WHERE split = 'train' AND long_view = 1 GROUP BY 1),
co AS (SELECT a.video_id AS a, b.video_id AS b, count(*) AS n FROM pos a JOIN pos b ON a.user_id = b.user_id AND a.video_id <> b.video_id GROUP BY 1, 2)"""


@query("popularity", f"WITH {IMP}, {POS} SELECT CAST(video_id AS BIGINT) AS video_id, pop FROM pop")
def popularity(spark, sf):
    return tidy(C.popularity(train_rows(spark, sf)))


@query("item_cooccurrence", f"WITH {IMP}, {POS} SELECT CAST(a AS BIGINT) AS a, CAST(b AS BIGINT) AS b, n FROM co")
def item_cooccurrence(spark, sf):
    return tidy(C.item_cooccurrence(train_rows(spark, sf)))


CF = f"""{POS}, cf AS (SELECT i.row_id, i.user_id, i.video_id, i.long_view AS label, i.date, i.value,
  (coalesce(any_value(p.pop), 0) + coalesce(sum(co.n), 0))::DOUBLE AS cf
  FROM imp i LEFT JOIN pop p ON p.video_id = i.video_id LEFT JOIN pos h ON h.user_id = i.user_id AND h.video_id <> i.video_id
  LEFT JOIN co ON co.a = i.video_id AND co.b = h.video_id WHERE i.split = 'valid' GROUP BY 1, 2, 3, 4, 5, 6)"""


@query("item_cf_scores", f"WITH {IMP}, {CF} SELECT row_id, cf FROM cf")
def item_cf_scores(spark, sf):
    return C.item_cf_scores(impressions(spark, sf), "valid").select("row_id", "cf")


@query(
    "zscore",
    f"""WITH {SCORES} SELECT model_id, row_id, round((score - avg(score) OVER (PARTITION BY model_id)) / stddev_pop(score) OVER (PARTITION BY model_id), 9) AS z FROM scores""",
)
def zscore(spark, sf):
    return tidy(B.zscore(score_table(spark, sf), "score", "z", ["model_id"]).select("model_id", "row_id", "z"))


@query(
    "minmax",
    f"""WITH {SCORES} SELECT model_id, row_id, round((score - min(score) OVER (PARTITION BY model_id)) /
    (max(score) OVER (PARTITION BY model_id) - min(score) OVER (PARTITION BY model_id)), 9) AS z FROM scores""",
)
def minmax(spark, sf):
    return tidy(B.minmax(score_table(spark, sf), "score", "z", ["model_id"]).select("model_id", "row_id", "z"))


RA = """rp AS (SELECT *, row_number() OVER (PARTITION BY model_id, user_id ORDER BY score DESC, row_id) - 1 AS p FROM scores),
fused AS (SELECT 'fused' AS model_id, row_id, user_id, any_value(label) AS label, -avg(p) AS score, any_value(date) AS date FROM rp
  WHERE model_id IN ('m0', 'm1', 'm3') GROUP BY row_id, user_id)"""


@query("rank_average", f"WITH {SCORES}, {RA} SELECT row_id, user_id, round(score, 9) AS score FROM fused")
def rank_average(spark, sf):
    return tidy(B.rank_average(score_table(spark, sf), ["m0", "m1", "m3"]).select("row_id", "user_id", "score"))


# Scores of one candidate grid are rounded before ranking so that both engines see the same ties.
AGRID = f"""{CF}, zs AS (SELECT c.*, s.m0, (s.m0 - avg(s.m0) OVER ()) / stddev_pop(s.m0) OVER () AS z1,
  (ln(1 + c.cf) - avg(ln(1 + c.cf)) OVER ()) / stddev_pop(ln(1 + c.cf)) OVER () AS z2 FROM cf c JOIN sbase s USING (row_id)),
ag AS (SELECT alpha, row_id, user_id, label, round(z1 + alpha * z2, 9) AS score FROM zs, (SELECT unnest([0.0, 0.25, 0.5, 1.0, 2.0]::DOUBLE[]) AS alpha)),
{user_metrics_sql('ag', 'alpha', 'am')}, {summary_sql('am', 'alpha', 'ar')}"""


def _pairs(spark, sf):
    """Two score packs side by side, written once as a trial's packs are."""
    return cut_lineage(B.pair_scores(score_table(spark, sf), "m0", "m3"))


def _cf_pairs(spark, sf):
    cf = C.item_cf_scores(impressions(spark, sf), "valid").select("row_id", F.col("cf").alias("s_b"))
    m0 = score_table(spark, sf).where(F.col("model_id") == "m0")
    return cut_lineage(m0.select("row_id", "user_id", "label", "date", F.col("score").alias("s_a")).join(cf, "row_id"))


@query(
    "cf_blend_grid",
    f"""WITH {SCORES}, {AGRID} SELECT alpha, n_users, round(gauc, 7) AS gauc, round(ndcg5, 7) AS ndcg5, round("primary", 7) AS "primary" FROM ar""",
)
def cf_blend_grid(spark, sf):
    return tidy(B.alpha_metrics(_cf_pairs(spark, sf)).drop("grid_idx"), 7)


@query(
    "pick_alpha",
    f"""WITH {SCORES}, {AGRID} SELECT alpha, round(gauc, 7) AS gauc, round(ndcg5, 7) AS ndcg5, round("primary", 7) AS "primary"
    FROM ar ORDER BY ar."primary" DESC, alpha LIMIT 1""",
)
def pick_alpha(spark, sf):
    return tidy(B.pick_alpha(_cf_pairs(spark, sf)), 7)


def _sweep_sql(a: str, b: str) -> str:
    return f"""pz AS (SELECT a.row_id, a.user_id, a.label, a.date, (a.score - min(a.score) OVER ()) / (max(a.score) OVER () - min(a.score) OVER ()) AS z1,
  (b.score - min(b.score) OVER ()) / (max(b.score) OVER () - min(b.score) OVER ()) AS z2
  FROM {a} a JOIN {b} b ON a.row_id = b.row_id),
gr AS (SELECT row_id, user_id, label, alpha, gamma, (1.0 - alpha) * z1 + alpha * z2 + gamma * z1 * z2 AS score
  FROM pz, (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]::DOUBLE[]) AS alpha),
  (SELECT unnest([0.0, 0.1, 0.2]::DOUBLE[]) AS gamma)),
{user_metrics_sql('gr', 'alpha, gamma', 'gm')}, {summary_sql('gm', 'alpha, gamma', 'grm')}"""


SWEEP = f"""s0 AS (SELECT * FROM scores WHERE model_id = 'm0'), s3 AS (SELECT * FROM scores WHERE model_id = 'm3'), {_sweep_sql('s0', 's3')}"""


@query(
    "blend_sweep_grid",
    f"""WITH {SCORES}, {SWEEP} SELECT alpha, gamma, n_users, round(gauc, 7) AS gauc, round(ndcg5, 7) AS ndcg5, round("primary", 7) AS "primary" FROM grm""",
)
def blend_sweep_grid(spark, sf):
    return tidy(B.sweep_metrics(_pairs(spark, sf)).drop("grid_idx"), 7)


@query(
    "sweep_blend",
    f"""WITH {SCORES}, {SWEEP} SELECT alpha AS blend_alpha, gamma AS blend_gamma, round("primary", 7) AS blend_primary
    FROM grm ORDER BY grm."primary" DESC, alpha, gamma LIMIT 1""",
)
def sweep_blend(spark, sf):
    return tidy(B.sweep_blend(_pairs(spark, sf)), 7)


@query(
    "apply_blend",
    f"""WITH {SCORES}, {SWEEP} SELECT row_id, round((1.0 - 0.3) * z1 + 0.3 * z2 + 0.1 * z1 * z2, 9) AS score FROM pz""",
)
def apply_blend(spark, sf):
    return tidy(B.apply_blend(_pairs(spark, sf), 0.3, 0.1).select("row_id", "score"))


# A copy of m0 that keeps its order (m0b) is dropped by the filter; the others stay.
DIV = """sc2 AS (SELECT model_id, row_id, user_id, label, score FROM scores UNION ALL
  SELECT 'm0b', row_id, user_id, label, score * 2 + 1 FROM scores WHERE model_id = 'm0')"""


def _with_copy(spark, sf):
    s = cut_lineage(score_table(spark, sf))
    copy = s.where(F.col("model_id") == "m0").withColumn("model_id", F.lit("m0b")).withColumn("score", F.col("score") * 2 + 1)
    return s.unionByName(copy)


@query(
    "model_agreements",
    f"""WITH {SCORES}, {DIV}, tk AS (SELECT model_id, user_id, row_id, count(*) OVER (PARTITION BY model_id, user_id) AS c,
      row_number() OVER (PARTITION BY model_id, user_id ORDER BY score DESC, row_id) AS pos FROM sc2),
    t1 AS (SELECT model_id, user_id, list(row_id ORDER BY pos) FILTER (pos <= 1) AS a, list(row_id ORDER BY pos) FILTER (pos <= 2) AS b FROM tk WHERE c >= 2 GROUP BY 1, 2)
    SELECT l.model_id AS left_id, r.model_id AS right_id, round(avg(CASE WHEN l.a = r.a THEN 1.0 ELSE 0 END), 9) AS top1_agree,
    round(avg(CASE WHEN l.b = r.b THEN 1.0 ELSE 0 END), 9) AS top2_agree FROM t1 l JOIN t1 r ON l.user_id = r.user_id AND l.model_id < r.model_id GROUP BY 1, 2""",
)
def model_agreements(spark, sf):
    return tidy(B.model_agreements(_with_copy(spark, sf), ["m0", "m0b", "m1", "m2", "m3"]))


@query("diversity_filter")
def diversity_filter(spark, sf):
    return B.diversity_filter(_with_copy(spark, sf), ["m0", "m0b", "m1", "m2", "m3"])


@query(
    "spearman_filter",
    f"""WITH {SCORES}, {DIV}, rk AS (SELECT model_id, row_id, row_number() OVER (PARTITION BY model_id ORDER BY score, row_id)::DOUBLE AS r FROM sc2),
    c AS (SELECT l.model_id AS l, r.model_id AS r, corr(l.r, r.r) AS c FROM rk l JOIN rk r ON l.row_id = r.row_id AND l.model_id < r.model_id GROUP BY 1, 2),
    k1 AS (SELECT 'm0' AS m), k2 AS (SELECT m FROM k1 UNION ALL SELECT 'm0b' WHERE NOT EXISTS (SELECT 1 FROM c, k1 WHERE l = m AND r = 'm0b' AND c > 0.98)),
    k3 AS (SELECT m FROM k2 UNION ALL SELECT 'm1' WHERE NOT EXISTS (SELECT 1 FROM c, k2 WHERE l = m AND r = 'm1' AND c > 0.98)),
    k4 AS (SELECT m FROM k3 UNION ALL SELECT 'm2' WHERE NOT EXISTS (SELECT 1 FROM c, k3 WHERE l = m AND r = 'm2' AND c > 0.98)),
    k5 AS (SELECT m FROM k4 UNION ALL SELECT 'm3' WHERE NOT EXISTS (SELECT 1 FROM c, k4 WHERE l = m AND r = 'm3' AND c > 0.98))
    SELECT model_id, model_id IN (SELECT m FROM k5) AS kept FROM (SELECT DISTINCT model_id FROM sc2)""",
)
def spearman_filter(spark, sf):
    return B.spearman_filter(_with_copy(spark, sf), ["m0", "m0b", "m1", "m2", "m3"])


# The greedy rule, unrolled over the measured agreements.
ORACLES["diversity_filter"] = f"""WITH c AS (SELECT left_id AS l, right_id AS r FROM ({ORACLES['model_agreements']}) WHERE top1_agree > 0.98 AND top2_agree > 0.98),
    k1 AS (SELECT 'm0' AS m), k2 AS (SELECT m FROM k1 UNION ALL SELECT 'm0b' WHERE NOT EXISTS (SELECT 1 FROM c, k1 WHERE l = m AND r = 'm0b')),
    k3 AS (SELECT m FROM k2 UNION ALL SELECT 'm1' WHERE NOT EXISTS (SELECT 1 FROM c, k2 WHERE l = m AND r = 'm1')),
    k4 AS (SELECT m FROM k3 UNION ALL SELECT 'm2' WHERE NOT EXISTS (SELECT 1 FROM c, k3 WHERE l = m AND r = 'm2')),
    k5 AS (SELECT m FROM k4 UNION ALL SELECT 'm3' WHERE NOT EXISTS (SELECT 1 FROM c, k4 WHERE l = m AND r = 'm3'))
    SELECT model_id, model_id IN (SELECT m FROM k5) AS kept FROM (SELECT unnest(['m0', 'm0b', 'm1', 'm2', 'm3']) AS model_id)"""


@query(
    "compare_all",
    f"""WITH {SCORES}, {UM}, {RM}, {PAIRS}, {BOOT}, {HALF}, {_agree_sql(1)},
    rk AS (SELECT model_id, row_id, row_number() OVER (PARTITION BY model_id ORDER BY score, row_id)::DOUBLE AS r FROM scores),
    sp AS (SELECT a.model_id, corr(a.r, b.r) AS spearman FROM rk a JOIN rk b ON a.row_id = b.row_id AND b.model_id = 'm0' WHERE a.model_id <> 'm0' GROUP BY 1),
    bt AS (SELECT model_id, stddev_samp(delta) AS se, quantile_cont(delta, 0.025) AS lo, quantile_cont(delta, 0.975) AS hi FROM deltas GROUP BY 1),
    ps AS (SELECT model_id, count(*) AS n_users, avg(ndcg - ndcg_inc) AS mean_user_delta FROM pairs GROUP BY 1)
    SELECT m.model_id, round(m."primary" - i."primary", 9) AS delta_primary, round(m.gauc - i.gauc, 9) AS delta_gauc, round(m.ndcg5 - i.ndcg5, 9) AS delta_ndcg,
    ps.n_users, round(mean_user_delta, 9) AS mean_user_delta, round(spearman, 9) AS spearman, round(agree, 9) AS top1_agree, round(se, 9) AS se_val_delta,
    round(lo, 9) AS ci95_lo, round(hi, 9) AS ci95_hi, round(a.pf - b.pf, 9) AS delta_front, round(a.pb - b.pb, 9) AS delta_back
    FROM rm m JOIN rm i ON i.model_id = 'm0' JOIN ps ON ps.model_id = m.model_id JOIN sp ON sp.model_id = m.model_id JOIN ag1 ON ag1.model_id = m.model_id
    JOIN bt ON bt.model_id = m.model_id JOIN hp a ON a.model_id = m.model_id JOIN hp b ON b.model_id = 'm0' WHERE m.model_id <> 'm0'""",
)
def compare_all(spark, sf):
    out = B.compare_all(cut_lineage(score_table(spark, sf)), "m0")
    return tidy(
        out.select(
            "model_id", "delta_primary", "delta_gauc", "delta_ndcg", "n_users", "mean_user_delta", "spearman", "top1_agree",
            "se_val_delta", "ci95_lo", "ci95_hi", "delta_front", "delta_back",
        )
    )


@query(
    "fuse_and_check",
    f"""WITH {SCORES}, {RA}, {user_metrics_sql('fused')}, {RM} SELECT model_id, n_users, round(gauc, 9) AS gauc, round(ndcg5, 9) AS ndcg5,
    round("primary", 9) AS "primary", round(abs("primary" - 0.5), 9) AS drift,
    CASE WHEN abs("primary" - 0.5) > 0.001 THEN 'drift' ELSE 'ok' END AS status FROM rm""",
)
def fuse_and_check(spark, sf):
    return tidy(B.fuse_and_check(score_table(spark, sf), ["m0", "m1", "m3"], 0.5))

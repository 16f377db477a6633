"""Ranking metrics, paired comparison and fusion queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import metrics as M
from rankspark.plans.views import SCORES, score_table, summary_sql, tidy, user_metrics_sql
from rankspark.session import cut_lineage

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


UM = user_metrics_sql()
RM = summary_sql()
PAIRS = """pairs AS (SELECT a.model_id, a.user_id, a.n_pos, a.auc, a.ndcg, b.n_pos AS n_pos_inc, b.auc AS auc_inc, b.ndcg AS ndcg_inc
  FROM um a JOIN um b ON a.user_id = b.user_id AND b.model_id = 'm0' WHERE a.model_id <> 'm0')"""


@query(
    "user_auc",
    f"WITH {SCORES}, {UM} SELECT model_id, user_id, round(auc, 9) AS auc FROM um WHERE auc IS NOT NULL",
)
def user_auc(spark, sf):
    per_user = M.user_metrics(score_table(spark, sf))
    return tidy(per_user.where(F.col("auc").isNotNull()).select("model_id", "user_id", "auc"))


@query("user_ndcg", f"WITH {SCORES}, {UM} SELECT model_id, user_id, round(ndcg, 9) AS ndcg FROM um")
def user_ndcg(spark, sf):
    return tidy(M.user_metrics(score_table(spark, sf)).select("model_id", "user_id", "ndcg"))


@query(
    "ranking_metrics",
    f"""WITH {SCORES}, {UM}, {RM} SELECT model_id, n_users, round(gauc, 9) AS gauc, round(ndcg5, 9) AS ndcg5,
    round("primary", 9) AS "primary" FROM rm""",
)
def ranking_metrics(spark, sf):
    return tidy(M.ranking_metrics(score_table(spark, sf)))


@query(
    "pairwise_auc",
    f"""WITH {SCORES}, pr AS (SELECT a.model_id, a.user_id, count(*) AS n,
      sum(CASE WHEN a.score > b.score THEN 1.0 WHEN a.score = b.score THEN 0.5 ELSE 0 END)::DOUBLE AS w
      FROM scores a JOIN scores b ON a.model_id = b.model_id AND a.user_id = b.user_id AND a.label = 1 AND b.label = 0 GROUP BY 1, 2)
    SELECT model_id, user_id, round(w / n, 9) AS auc FROM pr""",
)
def pairwise_auc(spark, sf):
    out = M.pairwise_auc(score_table(spark, sf)).where(F.col("auc").isNotNull())
    return tidy(out.select("model_id", "user_id", "auc"))


@query(
    "paired_signs",
    f"""WITH {SCORES}, {UM}, {PAIRS} SELECT model_id, count(*) AS n_users, round(avg(ndcg - ndcg_inc), 9) AS mean_user_delta,
    count(*) FILTER (ndcg - ndcg_inc > 0) AS n_users_pos, count(*) FILTER (ndcg - ndcg_inc < 0) AS n_users_neg,
    count(auc - auc_inc) AS n_auc_users, round(avg(auc - auc_inc), 9) AS mean_user_auc_delta,
    count(*) FILTER (auc - auc_inc > 0) AS n_auc_pos, count(*) FILTER (auc - auc_inc < 0) AS n_auc_neg,
    round(count(*) FILTER (ndcg - ndcg_inc > 0) / count(*), 9) AS frac_users_positive,
    round(count(*) FILTER (auc - auc_inc > 0) / count(auc - auc_inc), 9) AS frac_users_auc_positive
    FROM pairs GROUP BY 1""",
)
def paired_signs(spark, sf):
    return tidy(M.paired_signs(M.paired_users(M.user_metrics(score_table(spark, sf)), "m0")))


@query(
    "paired_users",
    f"""WITH {SCORES}, {UM}, {PAIRS} SELECT model_id, user_id, round(ndcg - ndcg_inc, 9) AS d_ndcg,
    round(auc - auc_inc, 9) AS d_auc FROM pairs""",
)
def paired_users(spark, sf):
    pairs = M.paired_users(M.user_metrics(score_table(spark, sf)), "m0")
    return tidy(
        pairs.select(
            "model_id",
            "user_id",
            (F.col("ndcg") - F.col("ndcg_inc")).alias("d_ndcg"),
            (F.col("auc") - F.col("auc_inc")).alias("d_auc"),
        )
    )


def _poisson_sql(u: str) -> str:
    cuts, p, total = [], 2.718281828459045 ** -1, 0.0
    import math

    p = math.exp(-1.0)
    for i in range(12):
        total += p
        cuts.append(f"CASE WHEN {u} >= {total!r}::DOUBLE THEN 1 ELSE 0 END")
        p /= i + 1
    return " + ".join(cuts)


BOOT = f"""reps AS (SELECT range AS rep FROM range(500)),
hs AS (SELECT DISTINCT user_id, rep, CAST(('0x' || substr(md5(user_id || '|0|' || (rep // 4)), CAST(1 + 8 * (rep % 4) AS BIGINT), 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM (SELECT DISTINCT user_id FROM pairs), reps),
ws AS (SELECT user_id, rep, ({_poisson_sql('u')}) AS w FROM hs),
agg AS (SELECT model_id, rep, sum(w) AS mass,
  sum(CASE WHEN auc IS NOT NULL THEN w * auc * n_pos END) AS gn, sum(CASE WHEN auc IS NOT NULL THEN w * n_pos END) AS gd, sum(w * ndcg) AS nn,
  sum(CASE WHEN auc_inc IS NOT NULL THEN w * auc_inc * n_pos_inc END) AS gni, sum(CASE WHEN auc_inc IS NOT NULL THEN w * n_pos_inc END) AS gdi, sum(w * ndcg_inc) AS nni
  FROM pairs JOIN ws USING (user_id) WHERE w > 0 GROUP BY 1, 2),
deltas AS (SELECT model_id, rep, 0.5 * (gn / gd + nn / mass) - 0.5 * (gni / gdi + nni / mass) AS delta FROM agg)"""


@query(
    "paired_bootstrap",
    f"""WITH {SCORES}, {UM}, {PAIRS}, {BOOT}
    SELECT model_id, round(stddev_samp(delta), 9) AS se_val_delta, round(quantile_cont(delta, 0.025), 9) AS ci95_lo,
    round(quantile_cont(delta, 0.975), 9) AS ci95_hi, round(avg(delta), 9) AS mean_delta, count(*) AS replicates,
    (SELECT count(DISTINCT user_id) FROM pairs) AS n_users FROM deltas GROUP BY 1""",
)
def paired_bootstrap(spark, sf):
    return tidy(M.paired_bootstrap(M.paired_users(M.user_metrics(score_table(spark, sf)), "m0")))


HALF = """hc AS (SELECT model_id, quantile_cont(date, 0.5) AS md, count(*) AS n FROM scores GROUP BY 1),
hf AS (SELECT s.model_id, any_value(n) AS n, count(*) FILTER (date <= md) AS f FROM scores s JOIN hc USING (model_id) GROUP BY 1),
hcut AS (SELECT model_id, CASE WHEN f < 16 OR n - f < 16 THEN n // 2 ELSE f END AS cut FROM hf WHERE n >= 32),
hs2 AS (SELECT s.*, CASE WHEN row_number() OVER (PARTITION BY model_id ORDER BY row_id) <= cut THEN 'front' ELSE 'back' END AS half
  FROM scores s JOIN hcut USING (model_id)),
""" + user_metrics_sql("hs2", "model_id, half", "hm") + ", " + summary_sql("hm", "model_id, half", "hr") + """,
hp AS (SELECT model_id, max(CASE WHEN half = 'front' THEN "primary" END) AS pf, max(CASE WHEN half = 'back' THEN "primary" END) AS pb FROM hr GROUP BY 1)"""


@query(
    "half_primaries",
    f"WITH {SCORES}, {HALF} SELECT model_id, round(pf, 9) AS primary_front, round(pb, 9) AS primary_back FROM hp",
)
def half_primaries(spark, sf):
    return tidy(M.half_primaries(cut_lineage(score_table(spark, sf))))


@query(
    "temporal_halves",
    f"""WITH {SCORES}, {HALF} SELECT a.model_id, round(a.pf - b.pf, 9) AS delta_front, round(a.pb - b.pb, 9) AS delta_back,
    round(abs((a.pf - b.pf) - (a.pb - b.pb)), 9) AS temporal_disagree
    FROM hp a JOIN hp b ON b.model_id = 'm0' WHERE a.model_id <> 'm0'""",
)
def temporal_halves(spark, sf):
    return tidy(M.temporal_halves(cut_lineage(score_table(spark, sf)), "m0"))


RANKS = """rk AS (SELECT model_id, row_id, row_number() OVER (PARTITION BY model_id ORDER BY score, row_id) - 1 AS r FROM scores)"""


@query(
    "spearman",
    f"""WITH {SCORES}, {RANKS} SELECT a.model_id, round(corr(a.r::DOUBLE, b.r::DOUBLE), 9) AS spearman
    FROM rk a JOIN rk b ON a.row_id = b.row_id AND b.model_id = 'm0' WHERE a.model_id <> 'm0' GROUP BY 1""",
)
def spearman(spark, sf):
    return tidy(M.spearman(cut_lineage(score_table(spark, sf)), "m0"))


@query("ordinal_rank", f"WITH {SCORES}, {RANKS} SELECT model_id, row_id, r AS rk FROM rk")
def ordinal_rank(spark, sf):
    from rankspark.functions.ordered import positions

    return positions(score_table(spark, sf), ["model_id"], "score", "rk", chunked=True).select("model_id", "row_id", "rk")


def _agree_sql(k: int) -> str:
    return f"""tk{k} AS (SELECT model_id, user_id, list(row_id ORDER BY pos) AS top, any_value(c) AS c FROM (
      SELECT model_id, user_id, row_id, count(*) OVER (PARTITION BY model_id, user_id) AS c,
      row_number() OVER (PARTITION BY model_id, user_id ORDER BY score DESC, row_id) AS pos FROM scores) WHERE pos <= {k} AND c >= 2 GROUP BY 1, 2),
    ag{k} AS (SELECT a.model_id, avg(CASE WHEN a.top = b.top THEN 1.0 ELSE 0.0 END) AS agree
      FROM tk{k} a JOIN tk{k} b ON a.user_id = b.user_id AND b.model_id = 'm0' WHERE a.model_id <> 'm0' GROUP BY 1)"""


@query(
    "topk_agreement",
    f"""WITH {SCORES}, {_agree_sql(1)}, {_agree_sql(2)} SELECT model_id, round(ag1.agree, 9) AS top1_agree,
    round(ag2.agree, 9) AS top2_agree FROM ag1 JOIN ag2 USING (model_id)""",
)
def topk_agreement(spark, sf):
    s = cut_lineage(score_table(spark, sf))
    return tidy(M.topk_agreement(s, "m0", 1).join(M.topk_agreement(s, "m0", 2), "model_id"))


@query(
    "align_scores",
    f"""WITH {SCORES} SELECT row_id, round(max(CASE WHEN model_id = 'm0' THEN score END), 9) AS m0,
    round(max(CASE WHEN model_id = 'm1' THEN score END), 9) AS m1, round(max(CASE WHEN model_id = 'm3' THEN score END), 9) AS m3
    FROM scores GROUP BY 1""",
)
def align_scores(spark, sf):
    return tidy(M.align_scores(score_table(spark, sf), ["m0", "m1", "m3"]))


@query(
    "alignment_counts",
    f"""WITH {SCORES}, s2 AS (SELECT * FROM scores WHERE NOT (model_id = 'm2' AND label = 1)),
    c AS (SELECT count(*) AS nc FROM (SELECT row_id FROM s2 GROUP BY 1 HAVING count(DISTINCT model_id) = 4))
    SELECT model_id, count(*) AS n_rows, any_value(nc) AS n_common, count(*) = any_value(nc) AS aligned FROM s2 CROSS JOIN c GROUP BY 1""",
)
def alignment_counts(spark, sf):
    s = score_table(spark, sf).where(~((F.col("model_id") == "m2") & (F.col("label") == 1)))
    return M.alignment_counts(s)

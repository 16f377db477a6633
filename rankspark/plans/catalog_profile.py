"""Profiling queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import profile as P
from rankspark.plans.views import IMP, tidy, train_rows
from rankspark.sources.mapped import impressions

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


PAIRS = """tp AS (SELECT DISTINCT user_id, video_id FROM imp WHERE split = 'train'),
vp AS (SELECT DISTINCT user_id, video_id FROM imp WHERE split = 'valid')"""


@query(
    "pair_cover",
    f"""WITH {IMP}, {PAIRS} SELECT (SELECT count(*) FROM vp) AS n_pairs,
    (SELECT count(*) FROM vp SEMI JOIN tp USING (user_id, video_id)) AS n_seen,
    round((SELECT count(*) FROM vp SEMI JOIN tp USING (user_id, video_id)) / (SELECT count(*) FROM vp), 9) AS pair_cover""",
)
def pair_cover(spark, sf):
    return tidy(P.pair_cover(impressions(spark, sf)))


COLD = """cv AS (SELECT count(*) AS n, count(*) FILTER (video_id NOT IN (SELECT video_id FROM imp WHERE split = 'train')) AS f
  FROM (SELECT DISTINCT video_id FROM imp WHERE split = 'valid')),
cu AS (SELECT count(*) AS n, count(*) FILTER (user_id NOT IN (SELECT user_id FROM imp WHERE split = 'train')) AS f
  FROM (SELECT DISTINCT user_id FROM imp WHERE split = 'valid'))"""


@query(
    "cold_start",
    f"""WITH {IMP}, {COLD} SELECT cv.n AS n_videos, cv.f AS n_new_videos, cu.n AS n_users, cu.f AS n_new_users,
    round(cv.f / cv.n, 9) AS new_video_frac, round(cu.f / cu.n, 9) AS new_user_frac FROM cv, cu""",
)
def cold_start(spark, sf):
    return tidy(P.cold_start(impressions(spark, sf)))


@query(
    "key_overlap",
    f"""WITH {IMP}, {PAIRS} SELECT (SELECT count(*) FROM (SELECT * FROM tp INTERSECT SELECT * FROM vp)) AS n_both,
    (SELECT count(*) FROM (SELECT * FROM tp EXCEPT SELECT * FROM vp)) AS n_train_only,
    (SELECT count(*) FROM (SELECT * FROM vp EXCEPT SELECT * FROM tp)) AS n_valid_only""",
)
def key_overlap(spark, sf):
    return P.key_overlap(impressions(spark, sf), ["user_id", "video_id"])


SPLITS = """pu AS (SELECT split, user_id, count(*) AS n, sum(long_view) AS pos FROM imp WHERE split <> 'test' GROUP BY 1, 2),
po AS (SELECT split, n, row_number() OVER (PARTITION BY split ORDER BY n) - 1 AS r, count(*) OVER (PARTITION BY split) AS c FROM pu),
pct AS (SELECT split, max(CASE WHEN r = round_even((c - 1) * 0.5, 0) THEN n END)::DOUBLE AS p50,
  max(CASE WHEN r = round_even((c - 1) * 0.9, 0) THEN n END)::DOUBLE AS p90 FROM po GROUP BY 1),
sp AS (SELECT split, sum(n)::BIGINT AS n_rows, sum(pos) / sum(n) AS pos_rate, count(*) AS n_users, avg(n) AS rows_mean,
  avg(CASE WHEN n = 1 THEN 1.0 ELSE 0 END) AS single_imp_frac, any_value(p50) AS rows_p50, any_value(p90) AS rows_p90
  FROM pu JOIN pct USING (split) GROUP BY 1)"""


@query(
    "split_profile",
    f"""WITH {IMP}, {SPLITS} SELECT split, n_rows, round(pos_rate, 9) AS pos_rate, n_users, round(rows_mean, 9) AS rows_mean,
    round(single_imp_frac, 9) AS single_imp_frac, rows_p50, rows_p90 FROM sp""",
)
def split_profile(spark, sf):
    return tidy(P.split_profile(impressions(spark, sf)))


USER_DAY = "(user_id * 100000000 + date)"


@query(
    "split_profile_day_lists",
    f"""WITH {IMP}, {SPLITS.replace("SELECT split, user_id, count(*)", f"SELECT split, {USER_DAY} AS user_id, count(*)")}
    SELECT split, n_rows, round(pos_rate, 9) AS pos_rate, n_users, round(rows_mean, 9) AS rows_mean,
    round(single_imp_frac, 9) AS single_imp_frac, rows_p50, rows_p90 FROM sp""",
)
def split_profile_day_lists(spark, sf):
    """One list per user and day, so that many lists hold a single row."""
    return tidy(P.split_profile(impressions(spark, sf).withColumn("user_id", F.expr(USER_DAY))))


DRIFT = """dy AS (SELECT split, date, count(*) AS n, sum(long_view) AS pos FROM imp WHERE split <> 'test' GROUP BY 1, 2),
dt AS (SELECT count(*) AS d, sum(pos) / sum(n) AS r FROM (SELECT * FROM dy WHERE split = 'train' ORDER BY date DESC LIMIT 3)),
dv AS (SELECT count(*) AS d, sum(pos) / sum(n) AS r FROM (SELECT * FROM dy WHERE split = 'valid' ORDER BY date LIMIT 3))"""


@query(
    "pos_drift",
    f"""WITH {IMP}, {DRIFT} SELECT dt.d AS train_tail_days, dv.d AS valid_head_days, round(dt.r, 9) AS train_tail_pos,
    round(dv.r, 9) AS valid_head_pos, round(dv.r - dt.r, 9) AS pos_drift FROM dt, dv""",
)
def pos_drift(spark, sf):
    return tidy(P.pos_drift(impressions(spark, sf)))


def _side(name: str) -> str:
    cols = ["n_rows", "n_users", "rows_p50", "rows_p90"]
    rounded = ["pos_rate", "rows_mean", "single_imp_frac"]
    parts = [f"{name}.{c} AS {name}_{c}" for c in cols] + [f"round({name}.{c}, 9) AS {name}_{c}" for c in rounded]
    return ", ".join(parts)


@query(
    "profile",
    f"""WITH {IMP}, {PAIRS}, {COLD}, {SPLITS}, {DRIFT}, train AS (SELECT * FROM sp WHERE split = 'train'),
    valid AS (SELECT * FROM sp WHERE split = 'valid')
    SELECT {_side('train')}, {_side('valid')},
    round((SELECT count(*) FROM vp SEMI JOIN tp USING (user_id, video_id)) / (SELECT count(*) FROM vp), 9) AS pair_cover,
    round(cv.f / cv.n, 9) AS new_video_frac, round(cu.f / cu.n, 9) AS new_user_frac,
    dt.d AS train_tail_days, dv.d AS valid_head_days, round(dt.r, 9) AS train_tail_pos,
    round(dv.r, 9) AS valid_head_pos, round(dv.r - dt.r, 9) AS pos_drift
    FROM train, valid, cv, cu, dt, dv""",
)
def profile(spark, sf):
    return tidy(P.profile(impressions(spark, sf)))


@query(
    "user_mixed",
    f"""WITH {IMP}, t AS (SELECT user_id, count(*) AS c, sum(long_view) AS p FROM imp WHERE split = 'train' GROUP BY 1)
    SELECT sum(c)::BIGINT AS n_rows, count(*) AS users, count(*) FILTER (p > 0 AND p < c) AS mixed_users,
    count(*) FILTER (p >= c) AS pos_only_users, count(*) FILTER (p = 0) AS neg_only_users,
    coalesce(sum(c) FILTER (p > 0 AND p < c), 0)::BIGINT AS mixed_rows,
    round(count(*) FILTER (p > 0 AND p < c) / count(*), 9) AS frac_mixed_users,
    round(coalesce(sum(c) FILTER (p > 0 AND p < c), 0) / sum(c), 9) AS frac_rows_in_mixed_users FROM t""",
)
def user_mixed(spark, sf):
    return tidy(P.user_mixed(train_rows(spark, sf)))


@query(
    "sparse_counts",
    f"""WITH {IMP}, t AS (SELECT count(*) OVER (PARTITION BY user_id) AS u, count(*) OVER (PARTITION BY video_id) AS v
      FROM imp WHERE split = 'train')
    SELECT count(*) AS n_rows, round(avg(CASE WHEN u < 30 THEN 1.0 ELSE 0 END), 9) AS frac_rows_user_lt_min,
    round(avg(CASE WHEN v < 30 THEN 1.0 ELSE 0 END), 9) AS frac_rows_video_lt_min,
    round(avg(CASE WHEN u < 30 OR v < 30 THEN 1.0 ELSE 0 END), 9) AS frac_rows_either_lt_min FROM t""",
)
def sparse_counts(spark, sf):
    """Threshold 30 instead of 5: the test lists are long."""
    return tidy(P.sparse_counts(train_rows(spark, sf), min_n=30))

"""Shared inputs of the catalogue: score tables on Spark, and the same views as SQL text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankspark.functions.scalars import uniform
from rankspark.operators.features import lookup_rates
from rankspark.sources.mapped import impressions

SCORE_COLUMNS = ["model_id", "row_id", "user_id", "label", "score", "date"]


def tidy(df: DataFrame, digits: int = 9) -> DataFrame:
    """Comparable output: integers as BIGINT, fractions as DOUBLE rounded to a fixed number of digits."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.DoubleType, T.FloatType, T.DecimalType)):
            c = F.round(c.cast("double"), digits)
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("long")
        cols.append(c.alias(f.name))
    return df.select(*cols)


def train_rows(spark: SparkSession, sf: str) -> DataFrame:
    return impressions(spark, sf).where(F.col("split") == "train")


def score_table(spark: SparkSession, sf: str) -> DataFrame:
    """Four models on the valid rows: smoothed video rate, a hash draw, a coarse value, the value."""
    imp = impressions(spark, sf)
    valid = lookup_rates(imp.where(F.col("split") == "valid"), imp.where(F.col("split") == "train"), ["video_id"])
    models = F.array(
        F.struct(F.lit("m0").alias("model_id"), F.col("video_rate").alias("score")),
        F.struct(F.lit("m1").alias("model_id"), uniform("row_id", 1).alias("score")),
        F.struct(F.lit("m2").alias("model_id"), F.floor(F.col("value") / 10).cast("double").alias("score")),
        F.struct(F.lit("m3").alias("model_id"), F.col("value").alias("score")),
    )
    return valid.select("row_id", "user_id", F.col("long_view").alias("label"), "date", F.explode(models).alias("_m")).select(
        F.col("_m.model_id"), "row_id", "user_id", "label", F.col("_m.score"), "date"
    )


# ---- SQL text ----------------------------------------------------------------------


def u_sql(key: str, seed) -> str:
    return f"(CAST(('0x' || substr(md5(CAST({key} AS VARCHAR) || '|{seed}'), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE)"


IMP = """ev AS (
  SELECT event_id AS row_id, CAST(strftime(ts, '%Y%m%d') AS INTEGER) AS date, epoch_us(ts) // 1000 AS time_ms,
         CAST(hour(ts) AS INTEGER) AS hour, user_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS video_id,
         event_type, value, CAST(strftime(ts, '%Y%m%d') AS INTEGER) <= 20240114 AS is_train,
         CAST(strftime(ts, '%Y%m%d') AS INTEGER) BETWEEN 20240115 AND 20240121 AS is_valid,
         CAST(ts AS DATE) AS day FROM events),
imp AS (
  SELECT row_id, date, time_ms, hour, user_id, video_id, CAST(row_id % 3 AS VARCHAR) AS tab,
         (1 + video_id) * 1000.0::DOUBLE AS duration_ms, value * 1000.0::DOUBLE AS play_time_ms,
         CASE WHEN is_train OR is_valid THEN CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END END AS long_view,
         CASE WHEN event_type IN ('click','purchase','view') THEN 1 ELSE 0 END AS is_click,
         CASE WHEN is_train THEN 'train' WHEN is_valid THEN 'valid' ELSE 'test' END AS split, value, day,
         CASE WHEN video_id < 90 THEN CAST(video_id % 10 AS VARCHAR) ELSE 'UNK' END AS author_id FROM ev)"""

VSTATS = """pg AS (SELECT avg(long_view::DOUBLE) AS p FROM imp WHERE split = 'train'),
vstats AS (SELECT video_id, count(*)::DOUBLE AS c, sum(long_view)::DOUBLE AS s FROM imp WHERE split = 'train' GROUP BY 1),
ustats AS (SELECT user_id, count(*)::DOUBLE AS c, sum(long_view)::DOUBLE AS s FROM imp WHERE split = 'train' GROUP BY 1)"""

SCORES = f"""{IMP}, {VSTATS},
sbase AS (SELECT i.*, CASE WHEN coalesce(v.c, 0) < 5 THEN pg.p ELSE (v.s + 20 * pg.p) / (v.c + 20) END AS m0
          FROM imp i LEFT JOIN vstats v USING (video_id) CROSS JOIN pg WHERE split = 'valid'),
scores AS (
  SELECT 'm0' AS model_id, row_id, user_id, long_view AS label, m0 AS score, date FROM sbase UNION ALL
  SELECT 'm1', row_id, user_id, long_view, {u_sql('row_id', 1)}, date FROM sbase UNION ALL
  SELECT 'm2', row_id, user_id, long_view, floor(value / 10), date FROM sbase UNION ALL
  SELECT 'm3', row_id, user_id, long_view, value, date FROM sbase)"""


def user_metrics_sql(src: str = "scores", by: str = "model_id", name: str = "um") -> str:
    return f"""{name}_r AS (
  SELECT {by}, user_id, label,
         rank() OVER (PARTITION BY {by}, user_id ORDER BY score) +
         (count(*) OVER (PARTITION BY {by}, user_id, score) - 1) / 2.0 AS mid,
         row_number() OVER (PARTITION BY {by}, user_id ORDER BY score DESC, row_id) AS pos,
         row_number() OVER (PARTITION BY {by}, user_id ORDER BY label DESC, row_id) AS ipos FROM {src}),
{name} AS (
  SELECT {by}, user_id, count(*) AS n, sum(label)::DOUBLE AS n_pos,
         CASE WHEN sum(label) > 0 AND sum(label) < count(*) THEN
           (sum(mid * label)::DOUBLE - sum(label)::DOUBLE * (sum(label) + 1) / 2) / (sum(label)::DOUBLE * (count(*) - sum(label))) END AS auc,
         CASE WHEN sum(label) > 0 THEN sum(CASE WHEN pos <= 5 THEN label / log2(pos + 1.0) ELSE 0 END)
           / sum(CASE WHEN ipos <= 5 THEN label / log2(ipos + 1.0) ELSE 0 END) ELSE 0 END AS ndcg
  FROM {name}_r GROUP BY {by}, user_id)"""


def summary_sql(src: str = "um", by: str = "model_id", name: str = "rm") -> str:
    return f"""{name} AS (SELECT {by}, count(*) AS n_users,
  coalesce(sum(CASE WHEN auc IS NOT NULL THEN auc * n_pos END) / nullif(sum(CASE WHEN auc IS NOT NULL THEN n_pos END), 0), 0.5) AS gauc,
  avg(ndcg) AS ndcg5,
  0.5 * (coalesce(sum(CASE WHEN auc IS NOT NULL THEN auc * n_pos END) / nullif(sum(CASE WHEN auc IS NOT NULL THEN n_pos END), 0), 0.5) + avg(ndcg)) AS "primary"
  FROM {src} GROUP BY {by})"""


CFG = """['k=' || k, 'loss=' || loss, 'seq_len=' || seq_len, 'use_time_decay=' || utd]"""

LEDGER = f"""lraw AS (
  SELECT o_orderkey AS seq, o_custkey AS cust, o_orderkey % 100 AS i, o_orderstatus AS st, o_orderpriority AS pr,
         o_totalprice AS price FROM orders),
ledger0 AS (
  SELECT seq // 100 AS run_id, seq, seq AS node_id, CASE WHEN i > 0 THEN seq - i + (i - 1) // 2 END AS parent_id,
    CASE pr WHEN '1-URGENT' THEN 'draft' WHEN '2-HIGH' THEN 'improve' WHEN '3-MEDIUM' THEN 'ablate'
            WHEN '4-NOT SPECIFIED' THEN 'ensemble' ELSE 'debug' END AS stage,
    CASE WHEN cust % 10 = 4 THEN 'ablate' ELSE CAST(cust % 10 AS VARCHAR) END AS arm,
    CASE cust % 3 WHEN 0 THEN '8' WHEN 1 THEN '16' ELSE '32' END AS k,
    CASE WHEN cust % 2 = 0 THEN '"logloss"' ELSE '"bpr"' END AS loss,
    CASE cust % 7 % 3 WHEN 0 THEN '0' WHEN 1 THEN '50' ELSE '100' END AS seq_len,
    CASE WHEN cust % 5 = 0 THEN 'true' ELSE 'false' END AS utd,
    CASE WHEN cust % 4 = 0 THEN 'h1' ELSE 'h0' END AS source_hash,
    seq % 3 AS seed, cust % 2 AS config_idx,
    (st = 'F' AND i % 5 = 0) AS is_buggy, i % 7 = 3 AS is_skip, (st = 'O' AND i % 4 = 0) AS confirmed,
    CASE WHEN NOT ((st = 'F' AND i % 5 = 0) OR i % 7 = 3) THEN price / 1e6 END AS prim,
    CASE WHEN st = 'O' AND i % 4 = 0 AND seq % 2 = 0 AND NOT ((st = 'F' AND i % 5 = 0) OR i % 7 = 3) THEN price / 1e6 - 0.001 END AS confirmed_mean,
    CASE WHEN pr = '4-NOT SPECIFIED' AND i >= 4 THEN [seq - 1, seq - 2, seq - 3] END AS members,
    CASE WHEN pr = '4-NOT SPECIFIED' THEN CASE cust % 3 WHEN 0 THEN 'same_config' WHEN 1 THEN 'cross_identity' ELSE 'complementary' END END AS ensemble_kind,
    CASE WHEN i % 13 = 0 THEN 'timeout' END AS exec_status, i % 11 = 0 AS partial, seq % 2 = 1 AS weak_incumbent,
    CASE WHEN i > 0 THEN ({u_sql('seq', 1)} - 0.5) * 0.02 END AS delta_primary, ({u_sql('seq', 1)} - 0.5) * 0.02 AS d,
    ({u_sql('seq', 5)} - 0.5) * 0.02 AS delta_gauc, ({u_sql('seq', 6)} - 0.4) * 0.02 AS delta_ndcg,
    0.0005 + {u_sql('seq', 2)} * 0.002 AS se,
    CASE WHEN seq % 3 <> 0 THEN ({u_sql('seq', 7)} - 0.5) * 0.02 END AS expected_delta,
    ({u_sql('seq', 3)} - 0.5) * 0.004 AS e3, ({u_sql('seq', 4)} - 0.5) * 0.004 AS e4,
    0.9 + 0.1 * {u_sql('seq', 8)} AS top1_agree,
    ({u_sql('seq', 1)} > 0.6 AND pr = '2-HIGH') AS screen_pass,
    CASE WHEN pr = '4-NOT SPECIFIED' AND i % 2 = 0 THEN {u_sql('seq', 9)} END AS blend_alpha,
    cust AS tokens_in, cust % 100 AS tokens_out, price / 1000 AS wall_seconds FROM lraw),
ledger AS (
  SELECT *, d - 1.96 * se AS ci95_lo, d + 1.96 * se AS ci95_hi, d + e3 AS delta_front, d + e4 AS delta_back,
    abs((d + e3) - (d + e4)) AS temporal_disagree,
    concat_ws(';', CASE WHEN k <> '16' THEN 'k=' || k END, CASE WHEN loss <> '"logloss"' THEN 'loss=' || loss END,
      CASE WHEN seq_len <> '0' THEN 'seq_len=' || seq_len END, CASE WHEN utd = 'true' THEN 'use_time_decay=true' END) AS fp,
    CASE WHEN stage = 'ensemble' AND prim IS NOT NULL THEN prim WHEN members IS NOT NULL AND prim IS NOT NULL THEN prim
         WHEN confirmed_mean IS NOT NULL THEN confirmed_mean ELSE prim END AS submit,
    (stage = 'improve' AND arm = 'ablate') AS is_child
  FROM ledger0)"""

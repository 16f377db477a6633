"""Selection, training-set, scoring, loss and model queries."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.operators import encoding as E
from rankspark.operators import features as X
from rankspark.operators import keyed_fm as K
from rankspark.operators import metrics as M
from rankspark.operators import models as L
from rankspark.operators import select as S
from rankspark.operators import trainset as R
from rankspark.plans.views import IMP, SCORES, score_table, summary_sql, tidy, train_rows, u_sql, user_metrics_sql
from rankspark.session import cut_lineage
from rankspark.sources.mapped import impressions, raw_impressions, table

QUERIES, ORACLES = {}, {}

SPLITS = {"train": (20240101, 20240110), "valid": (20240111, 20240115), "test": (20240116, 20240125)}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "assign_split",
    f"""WITH {IMP} SELECT row_id, CASE WHEN date <= 20240110 THEN 'train' WHEN date <= 20240115 THEN 'valid' ELSE 'test' END AS split
    FROM imp WHERE date BETWEEN 20240101 AND 20240125""",
)
def assign_split(spark, sf):
    return S.assign_split(raw_impressions(spark, sf).drop("split"), SPLITS).select("row_id", "split")


@query(
    "mask_labels",
    f"WITH {IMP} SELECT row_id, split, CAST(long_view AS BIGINT) AS long_view FROM imp WHERE split <> 'test'",
)
def mask_labels(spark, sf):
    return tidy(S.mask_labels(raw_impressions(spark, sf)).select("row_id", "split", "long_view"))


@query(
    "mask_labels_granted",
    f"WITH {IMP} SELECT split, count(*) AS n_rows, count(long_view) AS n_labels FROM imp GROUP BY 1",
)
def mask_labels_granted(spark, sf):
    """Grants: one row per loyalty label of the customer table."""
    grants = table(spark, sf, "customer").select(
        F.col("c_name").alias("grant_id"), F.lit("finalize").alias("reason"), F.lit("2024-02-01").alias("issued_at")
    )
    out = S.mask_labels(raw_impressions(spark, sf), grants)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.count("long_view").alias("n_labels"))


@query(
    "audit_grants",
    """SELECT 'test_access' AS kind, c_name AS grant_id, CASE WHEN c_custkey % 2 = 0 THEN 'finalize' ELSE 'report' END AS reason,
    CAST(CAST(DATE '2024-01-01' + CAST(c_custkey % 28 AS INTEGER) AS DATE) AS VARCHAR) AS issued_at FROM customer WHERE c_custkey % 3 <> 0""",
)
def audit_grants(spark, sf):
    """A grant per customer; every third has an empty id and opens nothing."""
    name = F.when(F.col("c_custkey") % 3 != 0, F.col("c_name")).otherwise(F.when(F.col("c_custkey") % 2 == 0, "  "))
    grants = table(spark, sf, "customer").select(
        name.alias("grant_id"), F.when(F.col("c_custkey") % 2 == 0, "finalize").otherwise("report").alias("reason"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("c_custkey") % 28).cast("int")).cast("string").alias("issued_at"),
    )
    return S.audit_grants(grants)


@query(
    "tail_stop_split",
    f"""WITH {IMP} SELECT row_id, CASE WHEN split = 'train' AND date >= 20240112 THEN 'stop' ELSE split END AS split FROM imp""",
)
def tail_stop_split(spark, sf):
    return S.tail_stop_split(impressions(spark, sf), 20240112).select("row_id", "split")


@query(
    "cap_rows",
    f"""WITH {IMP}, t AS (SELECT *, row_number() OVER (PARTITION BY split ORDER BY row_id) AS rn FROM imp)
    SELECT split, count(*) AS n_rows, sum(row_id)::BIGINT AS row_sum FROM t WHERE split <> 'train' OR rn <= 1000 GROUP BY 1""",
)
def cap_rows(spark, sf):
    """The first-N option of the trainer; all rows are read and numbered."""
    out = S.cap_rows(impressions(spark, sf), 1000)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("row_id").alias("row_sum"))


@query(
    "sample_users",
    f"""WITH {IMP}, us AS (SELECT DISTINCT user_id FROM imp), k AS (SELECT user_id FROM us
      QUALIFY row_number() OVER (ORDER BY {u_sql('user_id', 7)}) <= greatest(1, round_even((SELECT count(*) FROM us) * 0.3, 0)))
    SELECT user_id, count(*) AS n_rows FROM imp SEMI JOIN k USING (user_id) GROUP BY 1""",
)
def sample_users(spark, sf):
    return S.sample_users(impressions(spark, sf), 0.3, 7).groupBy("user_id").agg(F.count(F.lit(1)).alias("n_rows"))


@query(
    "drop_singletons",
    f"""WITH {IMP}, t AS (SELECT row_id, count(*) OVER (PARTITION BY user_id, date) AS c FROM imp) SELECT row_id FROM t WHERE c >= 2""",
)
def drop_singletons(spark, sf):
    """One list per user and day."""
    rows = impressions(spark, sf).withColumn("user_id", F.col("user_id") * 100000000 + F.col("date"))
    return S.drop_singletons(rows).select("row_id")


@query(
    "categorical_columns",
    f"""WITH {IMP}, c AS (SELECT 'user_id' AS "column", count(DISTINCT user_id) AS n_distinct FROM imp UNION ALL
      SELECT 'video_id', count(DISTINCT video_id) FROM imp UNION ALL SELECT 'row_id', count(DISTINCT row_id) FROM imp UNION ALL
      SELECT 'hour', count(DISTINCT hour) FROM imp) SELECT *, n_distinct < 1000 AS categorical FROM c""",
)
def categorical_columns(spark, sf):
    return S.categorical_columns(impressions(spark, sf), ["user_id", "video_id", "row_id", "hour"])


@query(
    "union_splits",
    f"""WITH {IMP} SELECT split, count(*) AS n_rows FROM imp GROUP BY 1 UNION ALL SELECT 'log_random', count(*) FROM imp WHERE tab = '2'""",
)
def union_splits(spark, sf):
    imp = impressions(spark, sf)
    random = imp.where(F.col("tab") == "2").withColumn("split", F.lit("log_random")).drop("author_id")
    return S.union_splits(imp, random).groupBy("split").agg(F.count(F.lit(1)).alias("n_rows"))


@query("group_sizes", f"WITH {IMP} SELECT user_id, count(*) AS size FROM imp WHERE split = 'train' GROUP BY 1")
def group_sizes(spark, sf):
    return S.group_sizes(train_rows(spark, sf))


PW = """med AS (SELECT median(ln(1 + greatest(play_time_ms, 0))) AS m FROM imp WHERE split = 'train' AND long_view = 1),
pw AS (SELECT i.*, CASE WHEN long_view = 1 THEN least(greatest(ln(1 + greatest(play_time_ms, 0)) / CASE WHEN m > 1e-6 THEN m ELSE 1 END, 0.25), 8) ELSE 1 END AS weight
  FROM imp i, med WHERE split = 'train')"""


@query("play_weights", f"WITH {IMP}, {PW} SELECT row_id, round(weight::DOUBLE, 9) AS weight FROM pw")
def play_weights(spark, sf):
    return tidy(R.play_weights(train_rows(spark, sf)).select("row_id", "weight"))


@query(
    "play_weights_by_tab",
    f"""WITH {IMP}, med AS (SELECT tab, median(ln(1 + greatest(play_time_ms, 0))) AS m FROM imp WHERE split = 'train' AND long_view = 1 GROUP BY 1)
    SELECT row_id, round((CASE WHEN long_view = 1 THEN least(greatest(ln(1 + greatest(play_time_ms, 0)) / m, 0.25), 8) ELSE 1 END)::DOUBLE, 9) AS weight
    FROM imp JOIN med USING (tab) WHERE split = 'train'""",
)
def play_weights_by_tab(spark, sf):
    return tidy(R.play_weights(train_rows(spark, sf), ["tab"]).select("row_id", "weight"))


@query(
    "watch_targets",
    f"""WITH {IMP} SELECT row_id, round(ln(greatest(play_time_ms, 0) + 1), 9) AS y_log, round(ln(greatest(duration_ms, 1) + 1), 9) AS c_log,
    play_time_ms >= 0.95 * greatest(duration_ms, 1) AS censored FROM imp""",
)
def watch_targets(spark, sf):
    from rankspark.functions.scalars import watch_targets as targets

    return tidy(impressions(spark, sf).select("row_id", *targets()))


UW = """uw AS (SELECT user_id, pow(sum(pow(0.5, (DATE '2024-01-14' - day) / 3.0)), 0.75) AS weight
  FROM imp WHERE split = 'train' AND long_view = 1 GROUP BY 1)"""
UKEY = f"""uk AS (SELECT user_id, n, ln(greatest({u_sql('user_id', 3)}, 1e-12)) / greatest(coalesce(weight, 1), 1e-9) AS key
  FROM (SELECT user_id, count(*) AS n FROM imp WHERE split = 'train' GROUP BY 1) LEFT JOIN uw USING (user_id))"""


@query(
    "weighted_user_order",
    f"""WITH {IMP}, {UW}, {UKEY} SELECT user_id, round(key, 9) AS key, row_number() OVER (ORDER BY key DESC) - 1 AS place FROM uk""",
)
def weighted_user_order(spark, sf):
    train = train_rows(spark, sf)
    return tidy(R.weighted_user_order(train, X.user_decay_weights(train), 3))


@query(
    "user_batches",
    f"""WITH {IMP}, {UW}, {UKEY}, b AS (SELECT user_id, CAST(floor((sum(n) OVER (ORDER BY key DESC) - n) / 512) AS BIGINT) AS batch_id FROM uk)
    SELECT batch_id, count(*) AS n_rows, count(DISTINCT user_id) AS n_users FROM imp JOIN b USING (user_id) WHERE split = 'train' GROUP BY 1""",
)
def user_batches(spark, sf):
    train = train_rows(spark, sf)
    out = R.user_batches(train, 512, 3, X.user_decay_weights(train))
    return out.groupBy("batch_id").agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct("user_id").alias("n_users"))


def _m3(spark, sf):
    return score_table(spark, sf).where(F.col("model_id") == "m3")


BPR = f"""m3 AS (SELECT * FROM scores WHERE model_id = 'm3'),
ix AS (SELECT user_id, row_id, label, row_number() OVER (PARTITION BY user_id, label ORDER BY row_id) - 1 AS i FROM m3),
cn AS (SELECT user_id, count(*) FILTER (label = 1) AS np, count(*) FILTER (label = 0) AS nn FROM m3 GROUP BY 1),
dr AS (SELECT *, {u_sql("(user_id || '|' || draw || '|p')", 0)} AS up, {u_sql("(user_id || '|' || draw || '|n')", 0)} AS un
  FROM (SELECT *, unnest(range(1, least(np * nn, 32) + 1)) AS draw FROM cn WHERE np > 0 AND nn > 0)),
bp AS (SELECT d.user_id, d.draw, p.row_id AS pos_row, n.row_id AS neg_row, d.np FROM dr d
  JOIN ix p ON p.user_id = d.user_id AND p.label = 1 AND p.i = floor(up * np) JOIN ix n ON n.user_id = d.user_id AND n.label = 0 AND n.i = floor(un * nn))"""


@query("bpr_pairs", f"WITH {SCORES}, {BPR} SELECT user_id, draw, pos_row, neg_row FROM bp")
def bpr_pairs(spark, sf):
    return tidy(R.bpr_pairs(_m3(spark, sf)))


GP = """gi AS (SELECT row_id, label, row_number() OVER (PARTITION BY label ORDER BY row_id) - 1 AS i FROM scores WHERE model_id = 'm3'),
gp AS (SELECT p.i AS pair_idx, p.row_id AS pos_row, n.row_id AS neg_row FROM gi p JOIN gi n ON p.i = n.i AND p.label = 1 AND n.label = 0)"""


@query("global_pairs", f"WITH {SCORES}, {GP} SELECT pair_idx, pos_row, neg_row FROM gp")
def global_pairs(spark, sf):
    return tidy(R.global_pairs(_m3(spark, sf)))


LAM = """rk3 AS (SELECT row_id, CASE WHEN r < 5 THEN 1 / log2(r + 2.0) ELSE 0 END AS d FROM (
  SELECT row_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, row_id) - 1 AS r FROM m3)),
lp AS (SELECT bp.*, abs(a.d - b.d) / list_sum(list_transform(range(1, least(np, 5) + 1), lambda x: 1 / log2(x + 1.0))) AS delta
  FROM bp JOIN rk3 a ON a.row_id = pos_row JOIN rk3 b ON b.row_id = neg_row WHERE abs(a.d - b.d) > 0)"""


@query("lambda_pairs", f"WITH {SCORES}, {BPR}, {LAM} SELECT user_id, draw, pos_row, neg_row, round(delta, 9) AS delta FROM lp")
def lambda_pairs(spark, sf):
    return tidy(R.lambda_pairs(_m3(spark, sf)))


# Losses are evaluated on z = (score - 20) / 10 so that the logits are moderate.
def _logits(spark, sf):
    return _m3(spark, sf).withColumn("score", (F.col("score") - 20.0) / 10.0)


Z = """zz AS (SELECT row_id, user_id, label, (score - 20.0) / 10.0 AS z FROM scores WHERE model_id = 'm3'),
zp AS (SELECT *, 1 / (1 + exp(-least(greatest(z, -30), 30))) AS p FROM zz)"""


@query("logloss", f"WITH {SCORES}, {Z} SELECT round(avg(-(label * ln(p + 1e-9) + (1 - label) * ln(1 - p + 1e-9))), 9) AS loss FROM zp")
def logloss(spark, sf):
    return tidy(R.logloss(_logits(spark, sf)))


@query(
    "weighted_logloss",
    f"""WITH {SCORES}, {Z} SELECT round(sum(w * -(label * ln(p + 1e-9) + (1 - label) * ln(1 - p + 1e-9))) / (sum(w) + 1e-6), 9) AS loss
    FROM (SELECT *, 1.0 + row_id % 3 AS w FROM zp)""",
)
def weighted_logloss(spark, sf):
    return tidy(R.logloss(_logits(spark, sf).withColumn("w", 1.0 + F.col("row_id") % 3), "w"))


@query(
    "bpr_loss",
    f"""WITH {SCORES}, {BPR}, {Z} SELECT round(avg(-ln(1 / (1 + exp(-least(greatest(a.z - b.z, -30), 30))) + 1e-9)), 9) AS loss
    FROM bp JOIN zz a ON a.row_id = pos_row JOIN zz b ON b.row_id = neg_row""",
)
def bpr_loss(spark, sf):
    s = _logits(spark, sf)
    return tidy(R.pair_loss(R.bpr_pairs(s), s))


@query(
    "global_pair_loss",
    f"""WITH {SCORES}, {GP}, {Z} SELECT round(avg(-ln(1 / (1 + exp(-least(greatest(a.z - b.z, -30), 30))) + 1e-9)), 9) AS loss
    FROM gp JOIN zz a ON a.row_id = pos_row JOIN zz b ON b.row_id = neg_row""",
)
def global_pair_loss(spark, sf):
    s = _logits(spark, sf)
    return tidy(R.pair_loss(R.global_pairs(s), s))


@query(
    "lambda_loss",
    f"""WITH {SCORES}, {BPR}, {LAM}, {Z} SELECT round(sum(-delta * ln(1 / (1 + exp(-least(greatest(a.z - b.z, -30), 30))) + 1e-9)) / sum(delta), 9) AS loss
    FROM lp JOIN zz a ON a.row_id = pos_row JOIN zz b ON b.row_id = neg_row""",
)
def lambda_loss(spark, sf):
    s = _logits(spark, sf)
    return tidy(R.pair_loss(R.lambda_pairs(s), s, delta="delta"))


@query(
    "listwise_loss",
    f"""WITH {SCORES}, {Z}, e AS (SELECT *, exp(greatest(z - max(z) OVER (PARTITION BY user_id), -30)) AS e,
      sum(label) OVER (PARTITION BY user_id) AS np, count(*) OVER (PARTITION BY user_id) AS n FROM zz),
    q AS (SELECT *, e / sum(e) OVER (PARTITION BY user_id) AS p FROM e),
    l AS (SELECT user_id, sum(-label / np * ln(p + 1e-9)) AS l FROM q WHERE n >= 2 AND np > 0 AND np < n GROUP BY 1)
    SELECT round(avg(l), 9) AS loss, count(*) AS n_lists FROM l""",
)
def listwise_loss(spark, sf):
    return tidy(R.listwise_loss(_logits(spark, sf)))


def _erfc_sql(z: str) -> str:
    t = f"(1.0::DOUBLE / (1.0 + 0.5 * {z}))"
    power = repr(R.ERFC[-1])
    for c in reversed(R.ERFC[:-1]):
        power = f"({power} * {t} + {c!r})"
    return f"{t} * exp({power} - {z} * {z})"


@query(
    "watch_nll",
    f"""WITH {IMP}, w AS (SELECT ln(greatest(play_time_ms, 0) + 1) AS y, ln(greatest(duration_ms, 1) + 1) AS c, play_time_ms >= 0.95 * greatest(duration_ms, 1) AS full_watch,
      7.0::DOUBLE + (video_id % 7) * 0.5 AS p FROM imp),
    z AS (SELECT *, abs(c - p) / sqrt(2.0::DOUBLE) AS z FROM w), h AS (SELECT *, 0.5 * {_erfc_sql('z')} AS half FROM z),
    l AS (SELECT full_watch, CASE WHEN full_watch THEN -ln(least(greatest(CASE WHEN c >= p THEN half ELSE 1 - half END, 1e-6), 1.0)) ELSE 0.5 * (p - y) * (p - y) END AS loss FROM h)
    SELECT round(avg(loss), 9) AS loss, round(avg(full_watch::INT), 9) AS censored_share FROM l""",
)
def watch_nll(spark, sf):
    rows = impressions(spark, sf).withColumn("pred", 7.0 + (F.col("video_id") % 7) * 0.5)
    return tidy(R.watch_nll(rows, "pred"))


def _factors(spark, sf):
    emb = table(spark, sf, "embeddings")
    return emb.select(F.col("vec_id").alias("feature"), F.col("embedding")[0].cast("double").alias("w"), F.col("embedding").alias("v"))


@query(
    "fm_score",
    f"""WITH {IMP}, x AS (SELECT row_id, unnest([video_id, 100 + hour, 200 + user_id % 50]) AS feature FROM imp WHERE split = 'valid'),
    f AS (SELECT row_id, embedding[1]::DOUBLE AS w, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM x JOIN embeddings ON vec_id = feature),
    s AS (SELECT row_id, j, sum(v) AS sv, sum(v * v) AS sq FROM f GROUP BY 1, 2),
    lin AS (SELECT row_id, sum(w) AS lw FROM f WHERE j = 0 GROUP BY 1)
    SELECT row_id, round(0.25 + any_value(lw) + 0.5 * (sum(sv * sv) - sum(sq)), 6) AS score FROM s JOIN lin USING (row_id) GROUP BY 1""",
)
def fm_score(spark, sf):
    rows = impressions(spark, sf).where(F.col("split") == "valid")
    encoded = rows.select("row_id", F.array(F.col("video_id").cast("long"), F.col("hour") + 100, F.col("user_id") % 50 + 200).alias("fields"))
    return tidy(R.fm_score(encoded, _factors(spark, sf), 0.25), 6)


CTX = """hh AS (SELECT row_id, split, video_id AS target, list(video_id) OVER (PARTITION BY user_id ORDER BY row_id ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS l FROM imp),
hx AS (SELECT row_id, target, unnest(l) AS item, unnest(range(len(l))) AS i FROM hh WHERE split = 'valid')"""


@query(
    "history_pool",
    f"""WITH {IMP}, {CTX}, v AS (SELECT row_id, unnest(embedding)::DOUBLE AS v, unnest(range(len(embedding))) AS j FROM hx JOIN embeddings ON vec_id = item),
    c AS (SELECT row_id, j, sum(v) / (count(*) + 1e-9) AS c FROM v GROUP BY 1, 2)
    SELECT row_id, round(sum(c), 6) AS ctx_sum, round(sum(c * c), 6) AS ctx_norm FROM c GROUP BY 1""",
)
def history_pool(spark, sf):
    return _context(spark, sf, "pool")


@query(
    "history_attention",
    f"""WITH {IMP}, {CTX}, d AS (SELECT row_id, i, e.embedding AS emb, list_sum(list_transform(list_zip(e.embedding, t.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE)) AS s
      FROM hx JOIN embeddings e ON e.vec_id = item JOIN embeddings t ON t.vec_id = target),
    w AS (SELECT *, exp(greatest(s - max(s) OVER (PARTITION BY row_id), -30)) AS w FROM d),
    v AS (SELECT row_id, w, unnest(emb)::DOUBLE AS v, unnest(range(len(emb))) AS j FROM w),
    c AS (SELECT row_id, j, sum(v * w) / (sum(w) + 1e-9) AS c FROM v GROUP BY 1, 2)
    SELECT row_id, round(sum(c), 6) AS ctx_sum, round(sum(c * c), 6) AS ctx_norm FROM c GROUP BY 1""",
)
def history_attention(spark, sf):
    return _context(spark, sf, "din")


def _context(spark, sf, mode):
    past = X.histories(impressions(spark, sf), 5).where(F.col("split") == "valid")
    rows = past.select("row_id", F.col("video_id").alias("target"), "hist", "mask")
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("item"), F.col("embedding").alias("vec"))
    out = R.history_context(rows, emb, mode)
    total = F.aggregate("context", F.lit(0.0), lambda a, x: a + x)
    return tidy(out.select("row_id", total.alias("ctx_sum"), R.dot(F.col("context"), F.col("context")).alias("ctx_norm")), 6)


@query(
    "offpolicy_metrics",
    f"""WITH {SCORES}, r AS (SELECT s.* FROM scores s JOIN imp i USING (row_id) WHERE tab = '2'), {user_metrics_sql('r')}, {summary_sql()}
    SELECT model_id, n_users, round(gauc, 9) AS gauc, round(ndcg5, 9) AS ndcg5, round("primary", 9) AS "primary" FROM rm""",
)
def offpolicy_metrics(spark, sf):
    """Tab 2 plays the randomized-exposure surface."""
    from rankspark.plans.lifecycle import offpolicy_metrics as run

    surface = impressions(spark, sf).select("row_id", F.when(F.col("tab") == "2", "log_random").otherwise("valid").alias("split"))
    tagged = score_table(spark, sf).join(surface, "row_id")
    return tidy(run(tagged))


def _model_rows(spark, sf):
    # Rates, vocabularies and fitting pass over the rows many times, so impressions, rated rows and encoded rows are each written once.
    kept = impressions(spark, sf).where(F.col("split") != "test")
    imp = cut_lineage(kept.select("row_id", "date", "user_id", "video_id", "author_id", "tab", "duration_ms", "play_time_ms", "long_view", "split"))
    return cut_lineage(E.base_fields(cut_lineage(E.rate_columns(imp))))


FACTS = f"""WITH {IMP}, v AS (SELECT * FROM imp WHERE split = 'valid')
SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_users, count(*) AS n_finite, true AS fits, true AS ranked FROM v"""


def _facts(train: DataFrame, valid: DataFrame):
    """What a fitted ranker must show on any engine: one finite score per valid row, on its train rows a loss no worse than the best
    constant's, and a metric inside its range."""
    p = F.least(F.greatest("score", F.lit(1e-6)), F.lit(1 - 1e-6))
    y = F.col("label").cast("double")
    w = F.col("weight") if "weight" in train.columns else F.lit(1.0)
    loss = train.where(y.isNotNull()).agg(
        (F.sum(-w * (y * F.log(p) + (1 - y) * F.log(1 - p))) / F.sum(w)).alias("loss"), (F.sum(w * y) / F.sum(w)).alias("q")
    )
    q = F.col("q")
    fits = loss.select((F.col("loss") <= -(q * F.log(q) + (1 - q) * F.log(1 - q)) + 1e-6).alias("fits"))
    seen = valid.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("n_users"),
        F.sum((F.abs("score") < float("inf")).cast("long")).alias("n_finite"),
    )
    metric = M.ranking_metrics(valid.withColumn("model_id", F.lit("m"))).select(F.col("primary").between(0.0, 1.0).alias("ranked"))
    return tidy(seen.crossJoin(F.broadcast(fits)).crossJoin(F.broadcast(metric)))  # one row each


FM_K, FM_STEP, FM_L2, FM_SEED, FM_EPOCHS = 2, 0.5, 1e-4, 3, 3
FM_IDS = ["CAST(user_id AS VARCHAR)", "CAST(video_id AS VARCHAR)", "author_id", "tab"]


def fm_sql() -> str:
    """Three epochs of the keyed machine, step by step, and the scores of its factors on the valid rows."""
    ids = ", ".join(f"coalesce({e}, chr(0)) AS f{i}" for i, e in enumerate(FM_IDS))
    cells = "[" + ", ".join(f"{{'field': {i}, 'id': f{i}}}" for i in range(len(FM_IDS))) + "]"
    starts = ", ".join(f"({u_sql('field || chr(124) || id', f'{FM_SEED}|{j}')} - 0.5) * {K.SPREAD} AS v{j}" for j in range(FM_K))
    many, js, fs = len(FM_IDS), range(FM_K), range(len(FM_IDS))
    parts = [
        f"""tr AS MATERIALIZED (SELECT long_view::DOUBLE AS y, {ids} FROM imp WHERE split = 'train' AND long_view IS NOT NULL)""",
        f"""va AS (SELECT row_id, {ids} FROM imp WHERE split = 'valid')""",
        f"""p0 AS MATERIALIZED (SELECT field, id, 0.0::DOUBLE AS w, {starts} FROM (SELECT DISTINCT c.field AS field, c.id AS id FROM (SELECT unnest({cells}) AS c FROM tr)))""",
        "b0 AS MATERIALIZED (SELECT 0.0::DOUBLE AS b)",
    ]

    def logits(t: int, rows: str, keep: str) -> str:
        w = " + ".join(f"coalesce(a{i}.w, 0)" for i in fs)
        s = ", ".join(" + ".join(f"coalesce(a{i}.v{j}, 0)" for i in fs) + f" AS s{j}" for j in js)
        q = " + ".join(f"coalesce(a{i}.v{j} ** 2, 0)" for i in fs for j in js)
        joins = " ".join(f"LEFT JOIN p{t} a{i} ON a{i}.field = {i} AND a{i}.id = r.f{i}" for i in fs)
        half = " + ".join(f"s{j} ** 2" for j in js)
        return f"SELECT *, l + 0.5 * ({half} - q) AS z FROM (SELECT {keep}, b + {w} AS l, {s}, {q} AS q FROM {rows} r {joins} CROSS JOIN b{t})"

    for t in range(FM_EPOCHS):
        sums = ", ".join(f"sum(e * s{j}) AS gs{j}, sum(h * s{j}) AS hs{j}, sum(h * s{j} ** 2) AS hss{j}" for j in js)
        v = ", ".join(
            f"v{j} - {FM_STEP} * (gs{j} - v{j} * g + {FM_L2} * n * v{j}) / ({many} * greatest(hss{j} - 2 * v{j} * hs{j} + v{j} ** 2 * h, 0) + {FM_L2 + K.DAMP_V} * n) AS v{j}"
            for j in js
        )
        parts += [
            f"z{t} AS MATERIALIZED (SELECT *, 1 / (1 + exp(-z)) AS pr FROM ({logits(t, 'tr', 'r.*')}))",
            f"""g{t} AS MATERIALIZED (SELECT c.field AS field, c.id AS id, count(*) AS n, sum(e) AS g, sum(h) AS h, {sums}
              FROM (SELECT unnest({cells}) AS c, pr - y AS e, pr * (1 - pr) AS h, * FROM z{t}) GROUP BY 1, 2)""",
            f"p{t + 1} AS MATERIALIZED (SELECT field, id, w - {FM_STEP} * (g + {FM_L2} * n * w) / ({many} * h + {FM_L2 + K.DAMP_W} * n) AS w, {v} FROM p{t} JOIN g{t} USING (field, id))",
            f"b{t + 1} AS MATERIALIZED (SELECT any_value(b) - {FM_STEP} * sum(g) / ({many + 1} * sum(h) + {K.DAMP_W} * sum(n)) AS b FROM g{t} CROSS JOIN b{t} WHERE field = 0)",
        ]
    return f"WITH {IMP}, {', '.join(parts)} SELECT row_id, round(1 / (1 + exp(-z)), 7) AS score FROM ({logits(FM_EPOCHS, 'va', 'row_id')})"


@query("fm_ranker", fm_sql())
def fm_ranker(spark, sf):
    """Scores of three epochs at half steps, each of which lowers the loss."""
    rows = impressions(spark, sf)
    model = K.fit_keyed_fm(rows.where(F.col("split") == "train"), k=FM_K, epochs=FM_EPOCHS, l2=FM_L2, step=FM_STEP, seed=FM_SEED)
    return K.predict_keyed_fm(model, rows.where(F.col("split") == "valid")).select("row_id", F.round("score", 7).alias("score"))


@query("gbt_ranker", FACTS)
def gbt_ranker(spark, sf):
    rows = _model_rows(spark, sf)
    columns = ["video_fid", "author_fid", "tab_fid", "dur_fid", "user_rate", "video_rate"]
    train = cut_lineage(R.play_weights(S.drop_singletons(rows.where(F.col("split") == "train"))))
    model = L.fit_gbt(train, columns, "weight", rounds=5, depth=3)
    own = model.transform(train).select(F.col("long_view").alias("label"), "weight", vector_to_array("probability")[1].alias("score"))
    return _facts(own, L.predict(model, rows.where(F.col("split") == "valid")))


@query("pairwise_ranker", FACTS)
def pairwise_ranker(spark, sf):
    """The loss is that of the drawn pairs, whose best constant is a score of one half."""
    rows = _model_rows(spark, sf)
    columns = ["user_rate", "video_rate"]
    train = rows.where(F.col("split") == "train")
    pairs = R.bpr_pairs(train.select("user_id", "row_id", F.col("long_view").alias("label")))
    # Both the fit and its loss read the differences.
    differences = cut_lineage(L.pair_differences(pairs, train, columns)).select("label", array_to_vector("diff").alias("features"))
    model = L.fit_differences(differences, epochs=20)
    probability = vector_to_array("probability")[1].alias("score")
    return _facts(model.transform(differences).select("label", probability), L.pairwise_scores(model, rows.where(F.col("split") == "valid"), columns))

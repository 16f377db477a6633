"""Feature and encoding queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import encoding as E
from rankspark.operators import features as X
from rankspark.operators import metrics as M
from rankspark.plans.views import IMP, SCORES, VSTATS, score_table, summary_sql, tidy, train_rows, user_metrics_sql
from rankspark.sources.mapped import impressions, purchase_log, raw_impressions, video_dim

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


@query(
    "rate_baseline",
    f"""WITH {SCORES}, {user_metrics_sql()}, {summary_sql()} SELECT round(gauc, 9) AS gauc, round(ndcg5, 9) AS ndcg5,
    round("primary", 9) AS "primary", n_users FROM rm WHERE model_id = 'm0'""",
)
def rate_baseline(spark, sf):
    imp = impressions(spark, sf)
    rated = X.lookup_rates(imp.where(F.col("split") == "valid"), imp.where(F.col("split") == "train"), ["video_id"])
    scores = rated.select(
        F.lit("m0").alias("model_id"), "row_id", "user_id", F.col("long_view").alias("label"), F.col("video_rate").alias("score")
    )
    return tidy(M.ranking_metrics(scores).drop("model_id"))


@query(
    "author_lookup",
    f"WITH {IMP} SELECT row_id, author_id FROM imp",
)
def author_lookup(spark, sf):
    return X.with_author(raw_impressions(spark, sf), video_dim(spark, sf)).select("row_id", "author_id")


@query(
    "rate_stats",
    f"""WITH {IMP} SELECT CASE grouping_id(user_id, video_id, author_id) WHEN 3 THEN 'user' WHEN 5 THEN 'video'
      WHEN 2 THEN 'user_author' ELSE 'all' END AS level, user_id, CAST(video_id AS BIGINT) AS video_id, author_id,
      count(*) AS cnt, sum(long_view)::BIGINT AS pos
    FROM imp WHERE split = 'train' GROUP BY GROUPING SETS ((user_id), (video_id), (user_id, author_id), ())""",
)
def rate_stats(spark, sf):
    return tidy(X.rate_stats(train_rows(spark, sf)).select("level", "user_id", "video_id", "author_id", "cnt", "pos"))


@query(
    "lookup_rates",
    f"""WITH {IMP}, {VSTATS} SELECT row_id,
    round(CASE WHEN coalesce(u.c, 0) < 5 THEN p ELSE (u.s + 20 * p) / (u.c + 20) END, 9) AS user_rate,
    round(CASE WHEN coalesce(v.c, 0) < 5 THEN p ELSE (v.s + 20 * p) / (v.c + 20) END, 9) AS video_rate
    FROM imp i LEFT JOIN ustats u USING (user_id) LEFT JOIN vstats v USING (video_id) CROSS JOIN pg WHERE split <> 'train'""",
)
def lookup_rates(spark, sf):
    imp = impressions(spark, sf)
    out = X.lookup_rates(imp.where(F.col("split") != "train"), train_rows(spark, sf), ["user_id", "video_id"])
    return tidy(out.select("row_id", "user_rate", "video_rate"))


@query(
    "leave_one_out_rates",
    f"""WITH {IMP}, {VSTATS} SELECT row_id,
    round(CASE WHEN v.c < 5 OR v.c - 1 <= 0 THEN p ELSE (greatest(v.s - long_view, 0) + 20 * p) / (greatest(v.c - 1, 1) + 20) END, 9) AS video_rate
    FROM imp i JOIN vstats v USING (video_id) CROSS JOIN pg WHERE split = 'train'""",
)
def leave_one_out_rates(spark, sf):
    train = train_rows(spark, sf)
    return tidy(X.lookup_rates(train, train, ["video_id"], loo=True).select("row_id", "video_rate"))


PNOW = """pn AS (SELECT *, coalesce(sum(long_view) OVER w / nullif(count(long_view) OVER w, 0), 0.5)::DOUBLE AS p_now
  FROM imp WHERE split = 'train' WINDOW w AS (ORDER BY date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


@query("running_global_rate", f"WITH {IMP}, {PNOW} SELECT row_id, round(p_now, 9) AS p_now FROM pn")
def running_global_rate(spark, sf):
    return tidy(X.running_global_rate(train_rows(spark, sf)).select("row_id", "p_now"))


def _causal(key: str) -> str:
    w = f"(PARTITION BY {key} ORDER BY date, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""CASE WHEN count(long_view) OVER {w} < 5 THEN p_now
      ELSE (sum(long_view) OVER {w} + 20 * p_now) / (count(long_view) OVER {w} + 20) END"""


CAUSAL = f"{PNOW}, cr AS (SELECT *, {_causal('user_id')} AS user_rate, {_causal('video_id')} AS video_rate FROM pn)"


@query(
    "causal_rates",
    f"WITH {IMP}, {CAUSAL} SELECT row_id, round(user_rate, 9) AS user_rate, round(video_rate, 9) AS video_rate FROM cr",
)
def causal_rates(spark, sf):
    return tidy(X.causal_rates(train_rows(spark, sf)).select("row_id", "user_rate", "video_rate"))


def _decay_sql(src: str, keys: str, h: float, label: str = "long_view") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    rate = 0.5 ** (1.0 / h)
    return f"""dd AS (SELECT {keys}, date, any_value(day) AS day, sum({label}) AS p, count({label}) AS t FROM {src} GROUP BY {keys}, date),
    de AS (SELECT {a_keys}, a.date, coalesce(sum(b.p * pow({rate!r}, a.day - b.day)), 0) AS decay_pos,
      coalesce(sum(b.t * pow({rate!r}, a.day - b.day)), 0) AS decay_tot FROM dd a LEFT JOIN dd b ON {on} AND b.day < a.day GROUP BY {a_keys}, a.date)"""


@query(
    "daily_decay",
    f"""WITH {IMP}, {_decay_sql('imp', 'user_id', 2.5)} SELECT row_id, round(decay_pos, 9) AS decay_pos, round(decay_tot, 9) AS decay_tot
    FROM imp JOIN de USING (user_id, date)""",
)
def daily_decay(spark, sf):
    return tidy(X.decay(impressions(spark, sf)).select("row_id", "decay_pos", "decay_tot"))


@query(
    "tab_decay",
    f"""WITH {IMP}, {_decay_sql('imp', 'user_id, tab', 3.0)} SELECT row_id, round(decay_pos, 9) AS decay_pos
    FROM imp JOIN de USING (user_id, tab, date)""",
)
def tab_decay(spark, sf):
    out = X.decay(impressions(spark, sf), ["user_id", "tab"], X.TAB_HALFLIFE, pos_only=True)
    return tidy(out.select("row_id", "decay_pos"))


@query(
    "purchase_decay",
    f"""WITH pl AS (SELECT o_custkey AS user_id, CAST(l_shipdate AS DATE) AS day, CAST(strftime(l_shipdate, '%Y%m%d') AS BIGINT) AS date,
      CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS long_view FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
    {_decay_sql('pl', 'user_id', 2.5)} SELECT user_id, date, round(decay_pos, 9) AS decay_pos, round(decay_tot, 9) AS decay_tot FROM de""",
)
def purchase_decay(spark, sf):
    return tidy(X.daily_decay(purchase_log(spark, sf), ["user_id"], X.HALFLIFE))


@query(
    "asof_decay",
    f"""WITH {IMP}, tr AS (SELECT user_id, sum(long_view * pow(0.5, (DATE '2024-01-14' - day) / 2.5)) AS p,
      sum(pow(0.5, (DATE '2024-01-14' - day) / 2.5)) AS t FROM imp WHERE split = 'train' GROUP BY 1)
    SELECT row_id, round(coalesce(p * pow(0.5, (day - DATE '2024-01-14') / 2.5), 0), 9) AS decay_pos,
    round(coalesce(t * pow(0.5, (day - DATE '2024-01-14') / 2.5), 0), 9) AS decay_tot
    FROM imp LEFT JOIN tr USING (user_id) WHERE split <> 'train'""",
)
def asof_decay(spark, sf):
    return tidy(X.asof_decay(impressions(spark, sf)).select("row_id", "decay_pos", "decay_tot"))


@query(
    "user_decay_weights",
    f"""WITH {IMP} SELECT user_id, round(pow(sum(pow(0.5, (DATE '2024-01-14' - day) / 3.0)), 0.75), 9) AS weight
    FROM imp WHERE split = 'train' AND long_view = 1 GROUP BY 1""",
)
def user_decay_weights(spark, sf):
    return tidy(X.user_decay_weights(train_rows(spark, sf)))


def _momentum_sql(src: str, y: str) -> str:
    return f"""mo AS (SELECT *, lag(time_ms) OVER (PARTITION BY user_id ORDER BY time_ms, row_id) AS pt,
      list({y}) FILTER ({y} IS NOT NULL) OVER (PARTITION BY user_id ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ys FROM {src}),
    mm AS (SELECT *, coalesce(ys[-1], -1) AS last1, coalesce(list_sum(ys[-5:]), 0)::DOUBLE AS s, least(coalesce(len(ys), 0), 5)::DOUBLE AS c,
      (time_ms - pt) / 86400000.0 AS gap_days FROM mo)"""


@query(
    "momentum",
    f"""WITH {IMP}, {_momentum_sql('imp', 'long_view')} SELECT row_id, CAST(last1 AS BIGINT) AS last1, s AS lastk_sum, c AS lastk_cnt,
    round((s + 0.5) / (c + 1), 9) AS lastk_rate, CAST(time_ms - pt AS BIGINT) AS gap_ms FROM mm""",
)
def momentum(spark, sf):
    out = X.momentum(impressions(spark, sf)).withColumn("gap_ms", F.round(F.col("gap_days") * X.MS_PER_DAY).cast("long"))
    return tidy(out.select("row_id", "last1", "lastk_sum", "lastk_cnt", "lastk_rate", "gap_ms"))


@query(
    "histories",
    f"""WITH {IMP}, h AS (SELECT row_id, coalesce(list(video_id) OVER (PARTITION BY user_id ORDER BY row_id ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING), []) AS l FROM imp)
    SELECT row_id, array_to_string(list_concat(list_transform(range(20 - len(l)), lambda x: 0), l), ',') AS hist,
    array_to_string(list_concat(list_transform(range(20 - len(l)), lambda x: 0), list_transform(l, lambda x: 1)), ',') AS mask FROM h""",
)
def histories(spark, sf):
    out = X.histories(impressions(spark, sf), 20)
    return out.select(
        "row_id",
        F.array_join(F.col("hist").cast("array<string>"), ",").alias("hist"),
        F.array_join(F.col("mask").cast("array<string>"), ",").alias("mask"),
    )


def _list_q(src: str, col: str) -> str:
    return f"""lq AS (SELECT *, CASE WHEN count(*) OVER (PARTITION BY split, user_id) <= 1 THEN 0.5 ELSE
      (row_number() OVER (PARTITION BY split, user_id ORDER BY {col}, row_id) - 1) / (count(*) OVER (PARTITION BY split, user_id) - 1) END::DOUBLE AS list_q,
      count(*) OVER (PARTITION BY split, user_id) AS list_len FROM {src})"""


RATED = f"""{VSTATS}, {CAUSAL}, rated AS (SELECT row_id, split, user_id, long_view, user_rate, video_rate FROM cr UNION ALL
  SELECT row_id, split, user_id, long_view, CASE WHEN coalesce(u.c, 0) < 5 THEN p ELSE (u.s + 20 * p) / (u.c + 20) END,
    CASE WHEN coalesce(v.c, 0) < 5 THEN p ELSE (v.s + 20 * p) / (v.c + 20) END
  FROM imp i LEFT JOIN ustats u USING (user_id) LEFT JOIN vstats v USING (video_id) CROSS JOIN pg WHERE split <> 'train')"""


@query(
    "list_quantile",
    f"WITH {IMP}, {RATED}, {_list_q('rated', 'video_rate')} SELECT row_id, round(list_q, 9) AS list_q FROM lq",
)
def list_quantile(spark, sf):
    return tidy(X.list_quantile(E.rate_columns(impressions(spark, sf)), "video_rate").select("row_id", "list_q"))


@query("list_length", f"WITH {IMP} SELECT row_id, count(*) OVER (PARTITION BY split, user_id) AS list_len FROM imp")
def list_length(spark, sf):
    return X.list_length(impressions(spark, sf)).select("row_id", "list_len")


def _edges_sql(src: str, cols: list[str], bins: int, name: str = "eg") -> str:
    probs = "[" + ", ".join(repr(i / bins) for i in range(1, bins)) + "]"
    picks = ", ".join(f"list_sort(list_distinct(quantile_cont({c}::DOUBLE, {probs}))) AS {c}_e" for c in cols)
    return f"{name} AS (SELECT {picks} FROM {src} WHERE split = 'train')"


def _bucket_sql(src: str, cols: list[str], name: str = "bk", edges: str = "eg") -> str:
    picks = ", ".join(f"len(list_filter({c}_e, lambda e: e < {c})) AS {c}_b" for c in cols)
    return f"{name} AS (SELECT s.*, {picks} FROM {src} s CROSS JOIN {edges})"


def _ids_sql(cols: list[str], src: str = "bk", name: str = "idt") -> str:
    voc = ", ".join(f"list_sort(list(DISTINCT CAST({c}_b AS VARCHAR))) AS {c}_v" for c in cols)
    picks = ", ".join(
        f"coalesce(nullif(list_position({c}_v, CAST({c}_b AS VARCHAR)), 0) - 1, len({c}_v)) AS {c}_id, len({c}_v) + 1 AS {c}_size" for c in cols
    )
    return f"""{name}_v AS (SELECT {voc} FROM {src} WHERE split = 'train'), {name} AS (SELECT b.*, {picks} FROM {src} b CROSS JOIN {name}_v)"""


@query(
    "quantile_edges",
    f"""WITH {IMP}, {_edges_sql('imp', ['duration_ms', 'play_time_ms'], 10)}
    SELECT 'duration_ms' AS field, unnest(duration_ms_e) AS edge FROM eg UNION ALL SELECT 'play_time_ms', round(unnest(play_time_ms_e), 9) FROM eg""",
)
def quantile_edges(spark, sf):
    cols = ["duration_ms", "play_time_ms"]
    row = E.fit_edges(train_rows(spark, sf), cols, 10)
    parts = [row.select(F.lit(c).alias("field"), F.explode(f"{c}_edges").alias("edge")) for c in cols]
    return tidy(parts[0].unionByName(parts[1]))


@query(
    "distributed_quantiles",
    f"""WITH {IMP} SELECT round(unnest(quantile_cont(play_time_ms, [0.1, 0.25, 0.5, 0.9, 0.99])), 6) AS q FROM imp WHERE split = 'train'""",
)
def distributed_quantiles(spark, sf):
    q = E.exact_quantiles(train_rows(spark, sf), "play_time_ms", [0.1, 0.25, 0.5, 0.9, 0.99])
    return tidy(q.select(F.explode("q").alias("q")), 6)


@query(
    "bucketize",
    f"""WITH {IMP}, {_edges_sql('imp', ['play_time_ms'], 10)}, {_bucket_sql('imp', ['play_time_ms'])} SELECT row_id, play_time_ms_b AS bucket FROM bk""",
)
def bucketize(spark, sf):
    imp = impressions(spark, sf)
    edges = E.fit_edges(imp.where(F.col("split") == "train"), ["play_time_ms"], 10)
    return tidy(E.bucketize(imp, edges, ["play_time_ms"]).select("row_id", F.col("play_time_ms_bucket").alias("bucket")))


@query(
    "vocabulary",
    f"""WITH {IMP}, d AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS value FROM imp WHERE split = 'train')
    SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM d""",
)
def vocabulary(spark, sf):
    return tidy(E.fit_vocab(train_rows(spark, sf), "user_id"))


@query(
    "encode_unseen",
    f"""WITH {IMP}, k AS (SELECT row_id, split, user_id || '@' || hour AS slot FROM imp),
    v AS (SELECT slot, row_number() OVER (ORDER BY slot) - 1 AS id FROM (SELECT DISTINCT slot FROM k WHERE split = 'train'))
    SELECT row_id, 7 + coalesce(id, (SELECT count(*) FROM v)) AS slot_fid FROM k LEFT JOIN v USING (slot)""",
)
def encode_unseen(spark, sf):
    """User-hour slots: many of the later splits' slots never occur in train."""
    slots = impressions(spark, sf).withColumn("slot", F.concat_ws("@", F.col("user_id").cast("string"), F.col("hour").cast("string")))
    vocab = E.fit_vocab(slots.where(F.col("split") == "train"), "slot")
    return tidy(E.encode(slots, vocab, "slot", "slot_fid", 7).select("row_id", "slot_fid"))


RATE_COLS = ["user_rate", "video_rate"]


@query(
    "rate_fields",
    f"""WITH {IMP}, {RATED}, {_edges_sql('rated', RATE_COLS, 10)}, {_bucket_sql('rated', RATE_COLS)}, {_ids_sql(RATE_COLS)}
    SELECT row_id, round(user_rate, 9) AS user_rate, round(video_rate, 9) AS video_rate, user_rate_id, video_rate_id FROM idt""",
)
def rate_fields(spark, sf):
    out = E.rate_fields(impressions(spark, sf))
    return tidy(out.select("row_id", "user_rate", "video_rate", "user_rate_id", "video_rate_id"))


RANK_COLS = ["list_q", "list_len"]


@query(
    "rank_fields",
    f"""WITH {IMP}, {RATED}, {_list_q('rated', 'video_rate')}, {_edges_sql('lq', RANK_COLS, 10)}, {_bucket_sql('lq', RANK_COLS)}, {_ids_sql(RANK_COLS)}
    SELECT row_id, list_q_id, list_len_id FROM idt""",
)
def rank_fields(spark, sf):
    return tidy(E.rank_fields(impressions(spark, sf)).select("row_id", "list_q_id", "list_len_id"))


REC = ["decay_rate", "decay_tot", "tab_decay", "lastk_rate", "gap"]
RECENCY = f"""ti AS (SELECT * REPLACE (CASE WHEN split = 'train' THEN long_view END AS long_view) FROM imp),
{_decay_sql('ti', 'user_id', 2.5)},
{_decay_sql('ti', 'user_id, tab', 3.0).replace('dd', 'dt2').replace('de AS', 'dte AS')},
{_momentum_sql('ti', 'long_view')},
rec AS (SELECT m.row_id, m.split, m.last1, (de.decay_pos + 0.5) / (de.decay_tot + 1.0) AS decay_rate, de.decay_tot,
  dte.decay_pos AS tab_decay, (s + 0.5) / (c + 1.0) AS lastk_rate, coalesce(gap_days, 0)::DOUBLE AS gap
  FROM mm m JOIN de USING (user_id, date) JOIN dte ON dte.user_id = m.user_id AND dte.tab = m.tab AND dte.date = m.date)"""


@query(
    "recency_columns",
    f"""WITH {IMP}, {RECENCY} SELECT row_id, CAST(last1 AS BIGINT) AS last1, {", ".join(f"round({c}, 9) AS {c}" for c in REC[:4])},
    CAST(round(gap * 86400000) AS BIGINT) AS gap_ms FROM rec""",
)
def recency_columns(spark, sf):
    gap_ms = F.round(F.col("gap") * X.MS_PER_DAY).cast("long").alias("gap_ms")
    return tidy(E.recency_columns(impressions(spark, sf)).select("row_id", "last1", *REC[:4], gap_ms))


@query(
    "recency_fields",
    f"""WITH {IMP}, {RECENCY},
    rrec AS (SELECT row_id, split, last1, {", ".join(f"round({c}, {11 if c == 'gap' else 9}) AS {c}" for c in REC)} FROM rec),
    {_edges_sql('rrec', REC, 20)}, {_bucket_sql('rrec', REC)}, {_ids_sql(REC)}
    SELECT row_id, {", ".join(f"{c}_id" for c in REC)}, CAST(last1 + 1 AS BIGINT) AS last1_id FROM idt""",
)
def recency_fields(spark, sf):
    """Features rounded to nine digits first, so that both engines cut at the same edges."""
    raw = E.recency_columns(impressions(spark, sf))
    rounded = raw.select("row_id", "split", "last1", *[F.round(c, 11 if c == "gap" else 9).alias(c) for c in REC])
    out = E.bucket_fields(rounded, REC, E.RECENCY_BINS)
    return tidy(out.select("row_id", *[f"{c}_id" for c in REC], (F.col("last1") + 1).alias("last1_id")))


def _voc(col: str) -> str:
    return f"""voc_{col} AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS id FROM
      (SELECT DISTINCT CAST({col} AS VARCHAR) AS value FROM imp WHERE split = 'train'))"""


def _vid(col: str) -> str:
    return f"coalesce((SELECT id FROM voc_{col} WHERE value = CAST(b.{col} AS VARCHAR)), (SELECT count(*) FROM voc_{col}))"


def _vsize(col: str) -> str:
    return f"(SELECT count(*) + 1 FROM voc_{col})"


BASE_SQL = f"""{_voc('user_id')}, {_voc('video_id')}, {_voc('author_id')}, {_voc('tab')},
{_edges_sql('imp', ['duration_ms'], 10, 'egd')}, {_bucket_sql('imp', ['duration_ms'], 'bkd', 'egd')}, {_ids_sql(['duration_ms'], 'bkd', 'idd')},
bf AS (SELECT b.*, {_vid('user_id')} AS user_fid, {_vid('video_id')} AS video_fid, {_vid('author_id')} AS author_fid,
  {_vid('tab')} AS tab_fid, duration_ms_id AS dur_fid FROM idd b)"""


@query("base_fields", f"WITH {IMP}, {BASE_SQL} SELECT row_id, user_fid, video_fid, author_fid, tab_fid, dur_fid FROM bf")
def base_fields(spark, sf):
    out = E.base_fields(impressions(spark, sf))
    return tidy(out.select("row_id", "user_fid", "video_fid", "author_fid", "tab_fid", "dur_fid"))


# Every column of the encoder with the id of its field, in field order; sizes add up to the next field's start.
FIELD_IDS = [("user_fid", "s1"), ("video_fid", "s2"), ("author_fid", "s3"), ("tab_fid", "s4"), ("dur_fid", "bf.duration_ms_size"),
             ("coalesce(nullif(list_position(h, hour), 0) - 1, len(h))", "len(h) + 1")]
FIELD_IDS += [(f"{c}_id", f"{c}_size") for c in (*RATE_COLS, *RANK_COLS, *REC)] + [("last1 + 1", "3")]
STARTS = [" + ".join(["0", *[size for _, size in FIELD_IDS[:i]]]) for i in range(len(FIELD_IDS) + 1)]


@query(
    "encode_all",
    f"""WITH {IMP}, {BASE_SQL}, {RATED}, {_list_q('rated', 'video_rate')},
    {_edges_sql('rated', RATE_COLS, 10, 'er')}, {_bucket_sql('rated', RATE_COLS, 'br', 'er')}, {_ids_sql(RATE_COLS, 'br', 'ir')},
    {_edges_sql('lq', RANK_COLS, 10, 'ek')}, {_bucket_sql('lq', RANK_COLS, 'bk', 'ek')}, {_ids_sql(RANK_COLS, 'bk', 'ik')}, {RECENCY},
    rrec AS (SELECT row_id, split, last1, {", ".join(f"round({c}, {11 if c == 'gap' else 9}) AS {c}" for c in REC)} FROM rec),
    {_edges_sql('rrec', REC, 20, 'ec')}, {_bucket_sql('rrec', REC, 'bc', 'ec')}, {_ids_sql(REC, 'bc', 'ic')},
    hv AS (SELECT list_sort(list(DISTINCT hour)) AS h FROM imp WHERE split = 'train'),
    z AS (SELECT {_vsize('user_id')} AS s1, {_vsize('video_id')} AS s2, {_vsize('author_id')} AS s3, {_vsize('tab')} AS s4),
    hist AS (SELECT row_id, coalesce(list(video_fid) OVER (PARTITION BY user_id ORDER BY row_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING), []) AS l FROM bf)
    SELECT row_id, array_to_string([{", ".join(f"{start} + {fid}" for (fid, _), start in zip(FIELD_IDS, STARTS))}], ',') AS fields,
    CAST({STARTS[-1]} AS BIGINT) AS dim, round(ir.user_rate, 9) AS user_rate, round(decay_tot, 6) AS decay_tot, CAST(last1 AS BIGINT) AS last1, bf.play_time_ms,
    array_to_string(list_concat(list_transform(range(10 - len(l)), lambda x: 0), l), ',') AS hist
    FROM bf JOIN ir USING (row_id) JOIN ik USING (row_id) JOIN ic USING (row_id) JOIN hist USING (row_id) CROSS JOIN hv CROSS JOIN z""",
)
def encode_all(spark, sf):
    out = E.encode_all(impressions(spark, sf), True, True, True, True, seq_len=10, need_aux=True)
    text = [F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("fields", "hist")]
    rounded = [F.round("user_rate", 9).alias("user_rate"), F.round("decay_tot", 6).alias("decay_tot")]
    return tidy(out.select("row_id", "dim", "last1", "play_time_ms", *text, *rounded))


@query("aux_targets", f"WITH {IMP} SELECT row_id, split, CAST(is_click AS BIGINT) AS click, play_time_ms AS play, duration_ms AS dur FROM imp")
def aux_targets(spark, sf):
    return tidy(E.aux_targets(impressions(spark, sf)))

"""Reader, writer and streaming queries. Files are derived by Spark from the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.operators import ledger as L
from rankspark.plans.catalog_metrics import RM, UM
from rankspark.plans.views import IMP, LEDGER, SCORES, score_table, tidy
from rankspark.session import new_folder
from rankspark.sources import impressions as I
from rankspark.sources import logs as G
from rankspark.sources import sinks as K
from rankspark.sources.mapped import impressions, ledger, raw_impressions, table
from rankspark.streaming import jobs as J

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# Event dates moved onto the calendar of the CSV logs: day of January d becomes April 7 + d.
LOGROWS = f"""{IMP}, lg AS (SELECT e.*, CASE WHEN date - 20240100 <= 23 THEN 20220407 + (date - 20240100) ELSE 20220500 + (date - 20240123) END AS d2,
  CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END AS y FROM ev e),
sp AS (SELECT *, CASE WHEN d2 <= 20220421 THEN 'train' WHEN d2 <= 20220428 THEN 'valid' ELSE 'test' END AS split FROM lg WHERE d2 BETWEEN 20220408 AND 20220508)"""


def write_logs(spark, sf: str) -> str:
    """The mapped impressions as two CSV logs, a randomized log and a video file."""
    folder = new_folder(spark, "logs")
    day = F.col("date") - 20240100
    moved = F.when(day <= 23, 20220407 + day).otherwise(20220500 + day - 23)
    rows = (
        raw_impressions(spark, sf)
        .withColumn("date", moved)
        .select(
            "row_id", "user_id", "video_id", "date", "tab", (F.col("hour") * 100 + 5).alias("hourmin"), "time_ms", "is_click", "long_view",
            "play_time_ms", "duration_ms",
        )
    )
    ordered = rows.repartitionByRange("row_id").sortWithinPartitions("row_id")
    body = ordered.drop("row_id")
    body.where(F.col("date") <= 20220421).write.csv(f"{folder}/{I.LOGS[0].format('pure')}", header=True)
    body.where(F.col("date") > 20220421).write.csv(f"{folder}/{I.LOGS[1].format('pure')}", header=True)
    ordered.where(F.col("tab") == "2").drop("row_id").write.csv(f"{folder}/{I.RANDOM_LOG.format('pure')}", header=True)
    dim = rows.select("video_id").distinct().where(F.col("video_id") < 90)
    dim.select("video_id", (F.col("video_id") % 10).alias("author_id")).write.csv(f"{folder}/{I.VIDEO_BASIC.format('pure')}", header=True)
    return folder


@query(
    "read_impressions",
    f"""WITH {LOGROWS} SELECT split, row_number() OVER (ORDER BY row_id) - 1 AS row_id, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS split_row_id, CAST(d2 AS BIGINT) AS date, CAST(user_id AS VARCHAR) AS user_id,
    CAST(video_id AS VARCHAR) AS video_id, CASE WHEN video_id < 90 THEN CAST(video_id % 10 AS VARCHAR) ELSE 'UNK' END AS author_id,
    (1 + video_id) * 1000.0::DOUBLE AS duration_ms, CAST(y AS BIGINT) AS long_view FROM sp WHERE split <> 'test'""",
)
def read_impressions(spark, sf):
    out = I.read_impressions(spark, write_logs(spark, sf))
    return tidy(out.select("split", "row_id", "split_row_id", "date", "user_id", "video_id", "author_id", "duration_ms", "long_view"))


@query(
    "read_impressions_extended",
    f"""WITH {LOGROWS} SELECT split, row_number() OVER (ORDER BY row_id) - 1 AS row_id, row_number() OVER (PARTITION BY split ORDER BY row_id) - 1 AS split_row_id, CAST(hour AS BIGINT) AS hour, time_ms,
    CAST(CASE WHEN event_type IN ('click','purchase','view') THEN 1 ELSE 0 END AS BIGINT) AS is_click, round(value * 1000.0, 6) AS play_time_ms,
    CASE WHEN split <> 'test' THEN CAST(y AS BIGINT) END AS long_view FROM sp""",
)
def read_impressions_extended(spark, sf):
    """With a grant from the customer table: test rows appear, their labels stay missing."""
    grants = table(spark, sf, "customer").select(F.col("c_name").alias("grant_id"))
    out = I.read_impressions(spark, write_logs(spark, sf), grants=grants, extended=True)
    return tidy(out.select("split", "row_id", "split_row_id", "hour", "time_ms", "is_click", "play_time_ms", "long_view"), 6)


@query(
    "read_random_log",
    f"""WITH {LOGROWS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(user_id AS VARCHAR) AS user_id, CAST(video_id AS VARCHAR) AS video_id,
    CAST(y AS BIGINT) AS long_view FROM lg WHERE row_id % 3 = 2""",
)
def read_random_log(spark, sf):
    out = I.read_random_log(spark, write_logs(spark, sf))
    return tidy(out.select("row_id", "user_id", "video_id", "long_view"))


@query(
    "split_rows",
    f"""WITH {LOGROWS} SELECT row_number() OVER (ORDER BY row_id) - 1 AS row_id, CAST(d2 AS BIGINT) AS date, CAST(user_id AS VARCHAR) AS user_id,
    CAST(video_id AS VARCHAR) AS video_id FROM sp WHERE split = 'test'""",
)
def split_rows(spark, sf):
    return tidy(I.split_rows(spark, write_logs(spark, sf), "test").select("row_id", "date", "user_id", "video_id"))


@query(
    "read_video_dim",
    f"""WITH {IMP} SELECT DISTINCT CAST(video_id AS VARCHAR) AS video_id, CAST(video_id % 10 AS VARCHAR) AS author_id FROM imp WHERE video_id < 90""",
)
def read_video_dim(spark, sf):
    return I.read_video_dim(spark, write_logs(spark, sf))


@query(
    "impression_store",
    f"""WITH {IMP} SELECT split, CAST(date AS BIGINT) AS date, count(*) AS n_rows, sum(long_view)::BIGINT AS pos FROM imp WHERE split IN ('train', 'valid') GROUP BY 1, 2""",
)
def impression_store(spark, sf):
    """Written partitioned, read back with partition pruning on the split."""
    path = new_folder(spark, "store")
    I.write_impressions(impressions(spark, sf), path)
    out = I.open_impressions(spark, path, ["train", "valid"])
    return tidy(out.groupBy("split", "date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("long_view").alias("pos")))


def write_ledger_json(spark, sf: str) -> str:
    """The mapped ledger as JSON lines in the shape of a run journal, with a text metric to be dropped."""
    path = new_folder(spark, "ledger")
    l = ledger(spark, sf)
    cfg = F.struct(
        F.col("config")["k"].cast("int").alias("k"),
        F.regexp_replace(F.col("config")["loss"], '"', "").alias("loss"),
        F.col("config")["seq_len"].cast("int").alias("seq_len"),
        (F.col("config")["use_time_decay"] == "true").alias("use_time_decay"),
        F.col("seed").alias("seed"),
        F.lit(0.001).alias("lr"),
        F.lit(1e-6).alias("l2"),
    )
    out = l.select(
        F.col("node_id").cast("string").alias("node_id"),
        F.col("parent_id").cast("string").alias("parent_id"),
        "stage", "arm", F.lit("h").alias("hypothesis"),
        F.when(F.col("is_skip"), "skip").otherwise("").alias("diff"),
        F.when(
            F.col("primary").isNotNull(),
            F.struct(F.col("primary").alias("primary"), (F.col("primary") * 2).alias("GAUC"), F.lit("text").alias("note"), F.col("delta_gauc").alias("delta_gauc")),
        ).alias("metrics"),
        "is_buggy", "tokens_in", "tokens_out", F.col("wall_seconds").alias("gpu_seconds"),
        F.struct(
            cfg.alias("config_patch"), "confirmed", "confirmed_mean", "source_hash", "ci95_hi", "delta_primary",
            F.transform("members", lambda m: m.cast("string")).alias("members"), "ensemble_kind", "exec_status", "partial", "seed",
        ).alias("extra"),
    )
    out.write.json(path)
    return path


@query(
    "read_ledger",
    f"""WITH {LEDGER} SELECT CAST(node_id AS VARCHAR) AS node_id, CAST(parent_id AS VARCHAR) AS parent_id, stage, is_skip, round(prim, 9) AS "primary",
    round(prim * 2, 9) AS gauc, fp, confirmed, round(ci95_hi, 9) AS ci95_hi, coalesce(len(members), 0) AS n_members,
    CASE WHEN prim IS NOT NULL THEN 1 ELSE 0 END::BIGINT AS n_extra FROM ledger""",
)
def read_ledger(spark, sf):
    from rankspark.functions.scalars import fingerprint

    view = G.ledger_view(G.read_ledger(spark, write_ledger_json(spark, sf)))
    return tidy(
        view.select(
            "node_id", "parent_id", "stage", "is_skip", "primary", "gauc", fingerprint("config").alias("fp"), "confirmed", "ci95_hi",
            F.coalesce(F.size("members"), F.lit(0)).cast("long").alias("n_members"),
            F.coalesce(F.size("extra_metrics"), F.lit(0)).alias("n_extra"),
        )
    )


@query(
    "read_jsonl_lenient",
    """SELECT turn, count(*) AS n FROM conversations WHERE conv_id % 7 <> 3 GROUP BY 1""",
)
def read_jsonl_lenient(spark, sf):
    """Conversations as JSON lines; every seventh conversation's lines are cut in half, some are blank."""
    path = new_folder(spark, "jsonl")
    c = table(spark, sf, "conversations")
    line = F.to_json(F.struct("conv_id", "turn", "role", "text"))
    broken = F.when(F.col("conv_id") % 14 == 3, F.concat(F.lit("{"), F.substring(line, 1, 10))).otherwise("")
    c.select(F.when(F.col("conv_id") % 7 == 3, broken).otherwise(line).alias("value")).write.text(path)
    out = G.read_jsonl_lenient(spark, path, "conv_id long, turn long, role string, text string")
    return out.where(F.col("conv_id").isNotNull()).groupBy("turn").agg(F.count(F.lit(1)).alias("n"))


CURVES = """cu AS (SELECT 't' || (o_custkey % 50) AS trial_id, o_orderkey, o_totalprice / 1e6 AS p, o_orderkey % 9 = 0 AS bad, o_custkey % 50 % 4 = 0 AS lost FROM orders)"""


def _curves(spark, sf):
    """Trials with a curve; every fourth trial only has a log, and some curve rows are unreadable."""
    o = table(spark, sf, "orders")
    base = o.select(
        F.concat(F.lit("t"), (F.col("o_custkey") % 50).cast("string")).alias("trial_id"),
        F.col("o_orderkey").alias("epoch"),
        F.round(F.col("o_totalprice") / 1e6, 6).alias("p"),
        (F.col("o_orderkey") % 9 == 0).alias("bad"),
        (F.col("o_custkey") % 50 % 4 == 0).alias("lost"),
    )
    path = new_folder(spark, "curves")
    rows = base.where(~F.col("lost")).select(
        "trial_id", "epoch", F.lit(0.5).alias("loss"), F.when(F.col("bad"), "oops").otherwise(F.col("p").cast("string")).alias("primary"),
        (F.col("p") + 0.1).alias("GAUC"), (F.col("p") - 0.1).alias("nDCG@5"), F.lit(4).alias("sec"),
    )
    rows.write.partitionBy("trial_id").csv(path, header=True)
    text = F.format_string("epoch %d loss 0.5 valid GAUC %.6f nDCG@5 %.6f primary %.6f", "epoch", F.col("p") + 0.1, F.col("p") + 0.2, F.col("p"))
    return path, base.select("trial_id", text.alias("value"))


@query(
    "read_curves",
    f"WITH {CURVES} SELECT 'trial_id=' || trial_id AS trial_id, count(*) AS n, round(max(round(p, 6)), 6) AS best FROM cu WHERE NOT lost AND NOT bad GROUP BY 1",
)
def read_curves(spark, sf):
    path, _ = _curves(spark, sf)
    out = G.read_curves(spark, f"{path}/*")
    return tidy(out.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.max("primary").alias("best")), 6)


@query(
    "best_epoch",
    f"""WITH {CURVES}, c AS (SELECT trial_id, max(round(p, 6)) AS b FROM cu WHERE NOT lost AND NOT bad GROUP BY 1), l AS (SELECT trial_id, max(round(p, 6)) AS b FROM cu GROUP BY 1)
    SELECT l.trial_id, round(coalesce(c.b, l.b), 6) AS "primary", round(coalesce(c.b, l.b) + 0.1, 6) AS gauc, CASE WHEN c.b IS NULL THEN 'log' ELSE 'curve' END AS source
    FROM l LEFT JOIN c USING (trial_id)""",
)
def best_epoch(spark, sf):
    path, lines = _curves(spark, sf)
    curves = G.read_curves(spark, f"{path}/*").withColumn("trial_id", F.regexp_replace("trial_id", "^trial_id=", ""))
    return tidy(G.best_epoch(curves, G.parse_training_log(lines)).select("trial_id", "primary", "gauc", "source"), 6)


@query(
    "parse_training_log",
    f"WITH {CURVES} SELECT trial_id, count(*) AS n, round(sum(round(p, 6)), 6) AS total FROM cu GROUP BY 1",
)
def parse_training_log(spark, sf):
    _, lines = _curves(spark, sf)
    noise = lines.withColumn("value", F.lit("valid GAUC - nDCG@5 - primary -"))
    out = G.parse_training_log(lines.unionByName(noise))
    return tidy(out.groupBy("trial_id").agg(F.count(F.lit(1)).alias("n"), F.sum("primary").alias("total")), 6)


def _progress_lines(spark, sf):
    l = ledger(spark, sf)
    i = (F.col("seq") % 100).cast("int")
    wall = F.format_string("wall=%.2fh", F.col("wall_seconds") / 100.0)
    done = F.concat(
        F.format_string("12:00:00 [%d/100] DONE %d %s/%s primary=%.8f dP=%+.5f", i, "node_id", "stage", "arm", "primary", F.coalesce("delta_primary", F.lit(0.0))),
        F.format_string(" inc=%d:0.50000 streak=%d ", "node_id", i), wall,
    )
    start = F.format_string("12:00:00 [%d/100] START %s %d arm=%s parent=%d phase=search", i, "stage", "node_id", "arm", F.coalesce("parent_id", F.lit(0)))
    skip = F.format_string("12:00:00 [%d/100] SKIP %d arm=%s reason=arm is empty", i, "node_id", "arm")
    stop = F.concat(F.format_string("12:00:00 STOP reason=cap billed=%d/100 incumbent=%d mean=na ", i, "node_id"), wall)
    line = F.when(i == 99, stop).when(F.col("is_skip"), skip).when(F.col("primary").isNull(), start).otherwise(done)
    return l.select("run_id", "seq", line.alias("value"))


PROG = f"""{LEDGER}, pl AS (SELECT *, seq % 100 AS i, CASE WHEN seq % 100 = 99 THEN 'STOP' WHEN is_skip THEN 'SKIP' WHEN prim IS NULL THEN 'START' ELSE 'DONE' END AS kind FROM ledger)"""


@query(
    "parse_progress",
    f"""WITH {PROG} SELECT seq, kind, CAST(i AS BIGINT) AS billed, CAST(100 AS BIGINT) AS cap, CASE WHEN kind <> 'STOP' THEN CAST(node_id AS VARCHAR) END AS trial,
    CASE WHEN kind IN ('DONE', 'START') THEN stage END AS stage, CASE WHEN kind <> 'STOP' THEN arm END AS arm, CASE WHEN kind = 'DONE' THEN round(prim, 8) END AS "primary",
    CASE kind WHEN 'SKIP' THEN 'arm is empty' WHEN 'STOP' THEN 'cap' END AS reason, CASE WHEN kind = 'DONE' THEN CAST(i AS BIGINT) END AS streak,
    CASE WHEN kind IN ('DONE', 'STOP') THEN round(wall_seconds / 100, 2) END AS wall_hours FROM pl""",
)
def parse_progress(spark, sf):
    out = G.parse_progress(_progress_lines(spark, sf))
    return tidy(out.select("seq", "kind", "billed", "cap", "trial", "stage", "arm", "primary", "reason", "streak", "wall_hours"), 8)


@query(
    "wall_high_water",
    f"""WITH {PROG} SELECT run_id, round(greatest(max(CASE WHEN kind IN ('DONE', 'STOP') THEN round(wall_seconds / 100, 2) ELSE 0 END) * 3600, max(CASE WHEN seq % 100 = 0 THEN cast(run_id * 300 AS DOUBLE) END)), 6) AS wall_seconds
    FROM pl GROUP BY 1""",
)
def wall_high_water(spark, sf):
    lines = _progress_lines(spark, sf)
    kept = ledger(spark, sf).where(F.col("seq") % 100 == 0).select("run_id", (F.col("run_id") * 300.0).alias("agent_wall_seconds"))
    return tidy(G.wall_high_water(lines, kept), 6)


@query(
    "score_pack_round_trip",
    f"WITH {SCORES} SELECT model_id, row_id, user_id, CAST(label AS BIGINT) AS label, round(score, 9) AS score, CAST(date AS BIGINT) AS date FROM scores WHERE model_id IN ('m0', 'm2')",
)
def score_pack_round_trip(spark, sf):
    path = new_folder(spark, "scores")
    K.write_scores(score_table(spark, sf), path)
    return tidy(K.read_scores(spark, path, ["m0", "m2"]).select("model_id", "row_id", "user_id", "label", "score", "date"))


@query(
    "submission_round_trip",
    f"""WITH {SCORES}, t AS (SELECT row_number() OVER (ORDER BY row_id) - 1 AS rid, user_id, score, row_id FROM scores WHERE model_id = 'm1')
    SELECT rid AS row_id, t.user_id, CAST(i.video_id AS BIGINT) AS video_id, CAST(printf('%.5e', score) AS DOUBLE) AS score FROM t JOIN imp i ON i.row_id = t.row_id""",
)
def submission_round_trip(spark, sf):
    from rankspark.functions.ordered import prefix_sums

    s = score_table(spark, sf).where(F.col("model_id") == "m1")
    rows = s.join(impressions(spark, sf).select("row_id", "video_id"), "row_id")
    dense = prefix_sums(rows, [], ["row_id"], {"_at": F.lit(1.0)}, chunked=True).withColumn("row_id", F.col("_at").cast("long"))
    path = new_folder(spark, "submission")
    K.write_submission(dense, path)
    return spark.read.schema("row_id long, user_id long, video_id long, score double").option("header", True).csv(path)


@query(
    "check_submission",
    f"""WITH {IMP}, v AS (SELECT row_id FROM imp WHERE split = 'valid') SELECT row_id, CASE WHEN row_id % 50 = 1 THEN 'missing row' WHEN row_id % 50 = 2 THEN 'misaligned'
    ELSE 'not finite' END AS violation FROM v WHERE row_id % 50 IN (1, 2, 3) UNION ALL SELECT -1 - row_id, 'extra row' FROM v WHERE row_id % 50 = 4""",
)
def check_submission(spark, sf):
    """A submission with one fault of each kind every fifty rows."""
    rows = impressions(spark, sf).where(F.col("split") == "valid").select("row_id", "user_id", "video_id", F.lit(0.5).alias("score"))
    m = F.col("row_id") % 50
    bad = (
        rows.where(m != 1)
        .withColumn("video_id", F.when(m == 2, F.col("video_id") + 1).otherwise(F.col("video_id")))
        .withColumn("score", F.when(m == 3, F.lit(float("nan"))).otherwise(F.col("score")))
    )
    extra = rows.where(m == 4).withColumn("row_id", -1 - F.col("row_id"))
    return K.check_submission(bad.unionByName(extra), rows)


@query(
    "report",
    f"""WITH {SCORES}, {UM}, {RM} SELECT model_id, CASE WHEN model_id IN ('m0', 'm1') THEN 'pure' ELSE '1k' END AS scale,
    round(gauc - CASE WHEN model_id IN ('m0', 'm1') THEN 0.6674 END, 6) AS delta_gauc,
    round("primary" - CASE WHEN model_id IN ('m0', 'm1') THEN 0.6016 ELSE 0.64203 END, 6) AS delta_primary FROM rm""",
)
def report(spark, sf):
    from rankspark.operators.metrics import ranking_metrics

    m = ranking_metrics(score_table(spark, sf)).withColumn("scale", F.when(F.col("model_id").isin("m0", "m1"), "pure").otherwise("1k"))
    path = new_folder(spark, "report")
    K.write_report(m, K.baseline_table(spark), path)
    back = spark.read.schema("model_id string, scale string, delta_gauc double, delta_primary double").json(path)
    return tidy(back, 6)


@query(
    "append_ledger",
    f"WITH {LEDGER} SELECT stage, 2 * count(*) AS n FROM ledger GROUP BY 1",
)
def append_ledger(spark, sf):
    """The same nodes appended twice: an append log keeps both."""
    path = new_folder(spark, "append")
    rows = ledger(spark, sf).select("node_id", "stage", "arm", "primary")
    K.append_jsonl(rows, path)
    K.append_jsonl(rows, path)
    return spark.read.schema("node_id long, stage string").json(path).groupBy("stage").agg(F.count(F.lit(1)).alias("n"))


# ---- streaming ---------------------------------------------------------------------------


def event_stream(spark, sf: str):
    """The events table as a file stream, mapped to impressions."""
    from rankspark.sources.mapped import map_events

    schema = table(spark, sf, "events").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return map_events(raw)


@query(
    "stream_user_counts",
    f"WITH {IMP} SELECT split, user_id, count(*) AS n, sum(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END)::BIGINT AS pos FROM imp JOIN ev USING (row_id, user_id) GROUP BY 1, 2",
)
def stream_user_counts(spark, sf):
    return tidy(J.run_to_table(J.user_counts(event_stream(spark, sf)), "update", ["split", "user_id"]))


@query(
    "stream_user_sparsity",
    f"""WITH {IMP}, u AS (SELECT split, user_id, count(*) AS n, sum(CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END) AS pos FROM imp JOIN ev USING (row_id, user_id) GROUP BY 1, 2)
    SELECT split, count(*) AS n_users, sum(n)::BIGINT AS n_rows, round(avg(n), 9) AS rows_per_user, round(avg((n = 1)::INT), 9) AS single_share,
    round(avg((pos = 0 OR pos = n)::INT), 9) AS one_class_share FROM u GROUP BY 1""",
)
def stream_user_sparsity(spark, sf):
    """What the profile of users stands at after the last micro-batch."""
    cells = J.user_sparsity(event_stream(spark, sf))
    columns = [c for c in cells.columns if c not in ("split", "batch_id")]
    last = cells.groupBy("split").agg(F.max_by(F.struct(*columns), "batch_id").alias("_r"))
    return tidy(last.select("split", "_r.*"))


@query(
    "stream_daily_rate",
    f"""WITH {IMP}, d AS (SELECT date, count(*) AS n, avg(CASE WHEN event_type IN ('click','purchase') THEN 1.0 ELSE 0 END) AS r FROM ev GROUP BY 1)
    SELECT CAST(date AS BIGINT) AS date, n, round(r, 9) AS pos_rate FROM d WHERE date < (SELECT max(date) FROM d)""",
)
def stream_daily_rate(spark, sf):
    """The last day stays open behind the watermark and is not emitted."""
    return tidy(J.run_to_table(J.daily_rate(event_stream(spark, sf).withColumn("ts", F.timestamp_millis("time_ms"))), "append"))


@query(
    "stream_momentum",
    f"""WITH {IMP}, m AS (SELECT row_id, time_ms - lag(time_ms) OVER w AS g, list(y) OVER (PARTITION BY user_id ORDER BY time_ms, row_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ys
      FROM (SELECT *, CASE WHEN event_type IN ('click','purchase') THEN 1 ELSE 0 END AS y FROM ev) WINDOW w AS (PARTITION BY user_id ORDER BY time_ms, row_id))
    SELECT row_id, CAST(coalesce(ys[-1], -1) AS BIGINT) AS last1, coalesce(list_sum(ys[-5:]), 0)::DOUBLE AS lastk_sum, least(coalesce(len(ys), 0), 5)::DOUBLE AS lastk_cnt, coalesce(g, -1) AS gap_ms FROM m""",
)
def stream_momentum(spark, sf):
    return tidy(J.momentum_table(event_stream(spark, sf)).drop("user_id"))


@query("stream_author", f"WITH {IMP} SELECT row_id, author_id FROM imp")
def stream_author(spark, sf):
    from rankspark.sources.mapped import video_dim

    return J.run_to_table(J.enrich_author(event_stream(spark, sf), video_dim(spark, sf)).select("row_id", "author_id"), "append")


@query(
    "stream_cost",
    f"WITH {LEDGER} SELECT arm, sum(tokens_in)::BIGINT AS tokens_in, sum(tokens_out)::BIGINT AS tokens_out, round(sum(wall_seconds) / 3600, 9) AS compute_hours FROM ledger GROUP BY 1",
)
def stream_cost(spark, sf):
    """Cost lines appended by the batch ledger, read back as a stream of JSON files."""
    path = new_folder(spark, "cost")
    K.append_jsonl(ledger(spark, sf).select("arm", "tokens_in", "tokens_out", "wall_seconds"), path)
    stream = spark.readStream.schema("arm string, tokens_in long, tokens_out long, wall_seconds double").json(path)
    return tidy(J.run_to_table(J.cost_counters(stream, ["arm"]), "update", ["arm"]))


@query(
    "stream_findings",
    f"WITH {LEDGER} SELECT DISTINCT fp AS key FROM ledger WHERE ci95_hi < 0 AND delta_primary IS NOT NULL",
)
def stream_findings(spark, sf):
    from rankspark.functions.scalars import fingerprint

    path = new_folder(spark, "findings")
    rows = ledger(spark, sf).where(L.is_falsified()).select(fingerprint("config").alias("key"), F.timestamp_seconds("seq").alias("ts"))
    K.append_jsonl(rows, path)
    stream = spark.readStream.schema("key string, ts timestamp").json(path)
    return J.run_to_table(J.first_findings(stream).select("key"), "append")

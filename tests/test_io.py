"""Readers, writers and streams on small files."""

import pytest
from pyspark.sql import functions as F

from rankspark.operators import encoding as E
from rankspark.operators import features as X
from rankspark.operators import knowledge as N
from rankspark.sources import impressions as I
from rankspark.sources import logs as G
from rankspark.sources import sinks as K
from rankspark.streaming import jobs as J
from tests.conftest import rows

HEADER = "user_id,video_id,date,hourmin,time_ms,is_click,long_view,play_time_ms,duration_ms,tab"
LOG = [
    ("u0", 1, 20220410, 1, 1), ("u0", 2, 20220411, 0, 0), ("u1", 1, 20220412, 1, 1), ("u1", 2, 20220412, 0, 1),
    ("u0", 1, 20220423, 1, 1), ("u0", 2, 20220424, 0, 0), ("u1", 2, 20220430, 1, 1), ("u1", 1, 20220430, 0, 0),
]


@pytest.fixture
def folder(tmp_path):
    lines = [f"{u},{v},{d},1200,{1649000000000 + i},{c},{y},{1000 if y else 100},2000,1" for i, (u, v, d, y, c) in enumerate(LOG)]
    (tmp_path / "log_standard_4_08_to_4_21_pure.csv").write_text("\n".join([HEADER, *lines[:4]]) + "\n")
    (tmp_path / "log_standard_4_22_to_5_08_pure.csv").write_text("\n".join([HEADER, *lines[4:]]) + "\n")
    (tmp_path / "video_features_basic_pure.csv").write_text("video_id,author_id\n1,x\n2,b\n1,a\n")
    return tmp_path


def test_read_impressions(spark, folder):
    got = rows(I.read_impressions(spark, str(folder)), "split", "split_row_id", "row_id", "user_id", "video_id", "author_id", "long_view")
    assert got == [
        ("train", 0, 0, "u0", "1", "a", 1), ("train", 1, 1, "u0", "2", "b", 0), ("train", 2, 2, "u1", "1", "a", 1), ("train", 3, 3, "u1", "2", "b", 0),
        ("valid", 0, 4, "u0", "1", "a", 1), ("valid", 1, 5, "u0", "2", "b", 0),
    ]


def test_grant_and_extended(spark, folder):
    grants = spark.createDataFrame([("g",)], "grant_id string")
    df = I.read_impressions(spark, str(folder), grants=grants, extended=True).where("split = 'test'")
    assert rows(df, "split_row_id", "hour", "time_ms", "is_click", "play_time_ms", "long_view") == [
        (0, 12, 1649000000006, 1, 1000.0, None), (1, 12, 1649000000007, 0, 100.0, None),
    ]


def test_reader_to_encoder(spark, folder):
    """From CSV through every switch of the encoder: as many rows as the log, each with its own features."""
    grants = spark.createDataFrame([("g",)], "grant_id string")
    log = I.read_impressions(spark, str(folder), grants=grants, extended=True)
    for chunked in (False, True):
        out = E.encode_all(log, True, True, True, True, seq_len=3, need_aux=True, chunked=chunked)
        assert out.count() == log.count() == 8 and out.select("row_id").distinct().count() == 8
        assert out.where("size(fields) = 16 and size(hist) = 3").count() == 8
    parts = E.base_fields(log)
    both = out.select("row_id", "fields").join(parts.select("row_id", "user_fid", "user_size", "video_fid"), "row_id")
    assert both.where("fields[0] <> user_fid or fields[1] <> user_size + video_fid").isEmpty()


def test_scale_and_missing_pieces(spark, folder):
    assert I.detect_scale(spark, str(folder)) == "pure"
    with pytest.raises(ValueError):
        I.detect_scale(spark, str(folder), "1k")
    assert I.read_random_log(spark, str(folder)) is None
    (folder / "log_standard_4_22_to_5_08_pure.csv").write_text("user_id,date\nu0,20220423\n")
    with pytest.raises(ValueError):
        I.read_impressions(spark, str(folder))


def test_row_ids_follow_blocks(spark, folder):
    """Blocks of a few bytes, so that one file is read by many tasks."""
    lines = [f"u{i % 7},{i},20220410,0,{i},0,1,1,1,1" for i in range(500)]
    (folder / "log_standard_4_08_to_4_21_pure.csv").write_text("\n".join([HEADER, *lines]) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = I.read_impressions(spark, str(folder)).where("split = 'train'").select("row_id", F.col("video_id").cast("long").alias("v"))
        assert rows(got) == [(i, i) for i in range(500)] or sorted(got.collect()) == [(i, i) for i in range(500)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_ledger_json(spark, tmp_path):
    path = tmp_path / "journal.jsonl"
    path.write_text(
        '{"node_id": "n0", "parent_id": null, "stage": "draft", "arm": "draft", "hypothesis": "h", "metrics": {"GAUC": 0.66, "primary": 0.6, "note": "x", '
        '"alpha": 1}, "is_buggy": false, "tokens_in": 3, "tokens_out": 1, "gpu_seconds": 2.5, "extra": {"config_patch": {"k": 8, "loss": "bpr"}, "confirmed": true, '
        '"members": ["n1", "n2"]}}\n\n'
        '{"node_id": "n1", "stage": "improve", "arm": "loss", "hypothesis": "h", "is_buggy": true, "diff": "skip"}\n'
    )
    first, second = G.ledger_view(G.read_ledger(spark, str(path))).orderBy("seq").collect()
    assert first["primary"] == 0.6 and first["extra_metrics"] == {"alpha": 1.0} and first["config"] == {"k": "8", "loss": '"bpr"'}
    assert first["confirmed"] and first["members"] == ["n1", "n2"] and not first["is_skip"]
    assert second["primary"] is None and second["is_skip"]


def test_lenient_jsonl(spark, tmp_path):
    path = tmp_path / "f.jsonl"
    path.write_text('{"key": "a"}\n\nnot json\n{"key": "b"}\n')
    assert rows(G.read_jsonl_lenient(spark, str(path), "key string")) == [("a",), ("b",)]


def test_curves_and_log(spark, tmp_path):
    (tmp_path / "t1").mkdir()
    (tmp_path / "t1" / "curves.csv").write_text("epoch,loss,primary,GAUC,nDCG@5,sec\n6,0.5,oops,1,1,1\n7,0.48,0.6031,0.6693,0.5369,40\n8,0.47,0.6,0.6,0.5,40\n")
    curves = G.read_curves(spark, f"{tmp_path}/*/curves.csv")
    assert curves.count() == 2
    lines = spark.createDataFrame([("t1", "valid GAUC 0.9 nDCG@5 0.9 primary 0.9"), ("t2", "x valid GAUC 0.5 nDCG@5 0.4 primary 0.45")], "trial_id string, value string")
    best = {r["trial_id"]: (r["primary"], r["source"]) for r in G.best_epoch(curves, G.parse_training_log(lines)).collect()}
    assert best == {"t1": (0.6031, "curve"), "t2": (0.45, "log")}


def test_scores_and_submission(spark, tmp_path):
    s = spark.createDataFrame([("m", i, "u", i % 2, i / 3, 1) for i in range(40)], "model_id string, row_id long, user_id string, label int, score double, date int")
    K.write_scores(s, str(tmp_path / "s"))
    assert rows(K.read_scores(spark, str(tmp_path / "s"), ["m"]), *s.columns) == rows(s)
    K.write_submission(s.withColumn("video_id", F.lit("v")), str(tmp_path / "sub"))
    text = []
    for f in sorted((tmp_path / "sub").glob("part-*.csv")):
        text += f.read_text().splitlines()[1:]
    assert [int(t.split(",")[0]) for t in text] == list(range(40))
    assert float(text[1].split(",")[3]) == 0.333333


def test_catalog_bytes(spark, folder):
    path = str(folder / "log_standard_4_08_to_4_21_pure.csv")
    files = N.log_files(spark.read.option("header", True).csv(path)).withColumn("scale", F.lit("pure"))
    imp = spark.read.option("header", True).csv(path).withColumn("scale", F.lit("pure"))
    got = {r["scale"]: r for r in N.dataset_catalog(imp, files).collect()}
    assert got["pure"]["log_bytes"] == (folder / "log_standard_4_08_to_4_21_pure.csv").stat().st_size and got["pure"]["n_rows"] == 4
    assert not got["27k"]["present"]


def test_stream_momentum_over_many_batches(spark, tmp_path):
    """Ten files in time order, one per micro-batch: the carried state must equal the batch windows."""
    log = spark.range(300).select(
        F.col("id").alias("row_id"), (F.col("id") * 1000).alias("time_ms"), (F.col("id") % 4).alias("user_id"),
        F.when(F.col("id") % 5 != 0, (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int")).alias("long_view"),
    )
    for i in range(10):
        part = log.where((F.col("row_id") >= 30 * i) & (F.col("row_id") < 30 * i + 30)).coalesce(1)
        part.write.mode("append").json(str(tmp_path / "in"))
    schema = "row_id long, time_ms long, user_id long, long_view int"
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    got = J.run_to_table(J.momentum(stream), "append")
    batch = X.momentum(log).withColumn("gap_ms", F.coalesce(F.round(F.col("gap_days") * X.MS_PER_DAY).cast("long"), F.lit(-1)))
    cols = ["row_id", "last1", "lastk_sum", "lastk_cnt", "gap_ms"]
    assert rows(got, *cols) == rows(batch, *cols)


def test_stream_counts_over_many_batches(spark, tmp_path):
    log = spark.range(100).select(F.lit("train").alias("split"), (F.col("id") % 3).alias("user_id"), (F.col("id") % 2).cast("int").alias("long_view"))
    for i in range(4):
        log.write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("split string, user_id long, long_view int").option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    got = J.run_to_table(J.user_counts(stream), "update", ["split", "user_id"])
    want = log.groupBy("split", "user_id").agg((4 * F.count(F.lit(1))).alias("n"), (4 * F.sum("long_view")).alias("pos"))
    assert rows(got, "split", "user_id", "n", "pos") == rows(want)


def momentum_source(spark, path, n=300, per_file=30):
    log = spark.range(n).select(
        F.col("id").alias("row_id"), (F.col("id") * 1000).alias("time_ms"), F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 4).alias("user_id"),
        F.when(F.col("id") % 5 != 0, (F.pmod(F.xxhash64("id"), F.lit(2))).cast("int")).alias("long_view"),
    )
    for i in range(n // per_file):
        log.where((F.col("row_id") >= per_file * i) & (F.col("row_id") < per_file * (i + 1))).coalesce(1).write.mode("append").json(path)
    return log, lambda: spark.readStream.schema("row_id long, time_ms long, user_id long, long_view int").option("maxFilesPerTrigger", 1).json(path)


@pytest.mark.parametrize("limit", ["20", None])
def test_momentum_table_restarts_and_replays(spark, tmp_path, limit):
    """The stream stops after half of its input and starts again from its folder; user 0 holds half of all rows."""
    if limit:
        spark.conf.set("spark.rankspark.groupRows", limit)
        spark.conf.set("spark.rankspark.chunkRows", "16")
    try:
        src, folder = str(tmp_path / "in"), str(tmp_path / "out")
        log, stream = momentum_source(spark, src, 120)
        J.momentum_table(stream(), folder)
        more, _ = momentum_source(spark, str(tmp_path / "more"), 240, 30)
        more.where("row_id >= 120").coalesce(1).write.mode("append").json(src)
        got = J.momentum_table(stream(), folder)
        batch = X.momentum(more).withColumn("gap_ms", F.coalesce(F.round(F.col("gap_days") * X.MS_PER_DAY).cast("long"), F.lit(-1)))
        cols = ["row_id", "last1", "lastk_sum", "lastk_cnt", "gap_ms"]
        assert rows(got, *cols) == rows(batch, *cols)
        # The last micro-batch is run again, as after a failure before its commit.
        last = max(int(p.name) for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir() if p.name.isdigit())
        for p in (tmp_path / "out" / "checkpoint" / "commits").iterdir():
            if str(last) in p.name:
                p.unlink()
        assert rows(J.momentum_table(stream(), folder), *cols) == rows(batch, *cols)
    finally:
        spark.conf.unset("spark.rankspark.groupRows")
        spark.conf.unset("spark.rankspark.chunkRows")


def test_user_sparsity_after_each_batch(spark, tmp_path):
    for i, users in enumerate([[1, 1, 2], [2, 3], [4]]):
        data = [("train", u, (u + i) % 2) for u in users]
        spark.createDataFrame(data, "split string, user_id long, long_view int").coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema("split string, user_id long, long_view int").option("maxFilesPerTrigger", 1).option("latestFirst", "false").json(str(tmp_path / "in"))
    got = {r.batch_id: r for r in J.user_sparsity(stream, str(tmp_path / "out")).collect()}
    assert [(got[b].n_users, got[b].n_rows) for b in (0, 1, 2)] == [(2, 3), (3, 5), (4, 6)]
    assert [got[b].single_share for b in (0, 1, 2)] == pytest.approx([0.5, 1 / 3, 0.5])
    assert [got[b].one_class_share for b in (0, 1, 2)] == pytest.approx([1.0, 2 / 3, 0.75])


def test_store_files_follow_the_rows_of_a_date(spark, tmp_path):
    log = spark.range(1000).selectExpr(
        "id AS row_id", "'train' AS split", "IF(id < 900, 20240101, 20240102) AS date", "1L AS user_id", "2 AS video_id"
    )
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join these few rows again
    try:
        I.write_impressions(log, str(tmp_path / "s"), file_rows=100)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = {d: len(list((tmp_path / "s" / "split=train" / f"date={d}").glob("*.parquet"))) for d in (20240101, 20240102)}
    assert files[20240102] == 1 and 3 <= files[20240101] <= 9
    assert rows(I.open_impressions(spark, str(tmp_path / "s"), ["train"]), "row_id", "date") == rows(log, "row_id", "date")

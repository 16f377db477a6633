"""Groups that hold a large share of the rows: the chunked plans must give the plain plans' results."""

import datetime
import random

import pytest
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group, positions, prefix_sums, running_records
from rankspark.operators import encoding as E
from rankspark.operators import features as X
from rankspark.operators import fusion as B
from rankspark.operators import itemcf as C
from rankspark.operators import ledger as L
from rankspark.operators import metrics as M
from rankspark.operators import select as S
from rankspark.operators import trainset as R
from tests.conftest import rows


@pytest.fixture(scope="module")
def log(spark):
    """900 impressions; user 0 owns more than a third, labels are sometimes missing, scores tie heavily."""
    i = F.col("id")
    h = F.pmod(F.xxhash64("id"), F.lit(1000))
    return (
        spark.range(900)
        .select(
            i.alias("row_id"),
            (F.lit(20240101) + F.floor(i / 90)).cast("int").alias("date"),
            (i * 1000 + F.when(i % 7 == 0, 0).otherwise(h)).alias("time_ms"),
            F.when(i % 5 < 2, 0).otherwise(i % 37).alias("user_id"),
            (h % 23).cast("int").alias("video_id"),
            (i % 3).cast("string").alias("tab"),
            F.when(h % 4 == 0, F.lit(None)).otherwise((h % 3 == 0).cast("int")).alias("long_view"),
            F.when(i < 600, "train").when(i < 800, "valid").otherwise("test").alias("split"),
            (h * 10.0).alias("play_time_ms"),
        )
        .cache()
    )


@pytest.fixture(scope="module")
def scores(log):
    m = F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c")))
    s = (
        F.when(F.col("model_id") == "a", F.col("video_id") * 1.0)
        .when(F.col("model_id") == "b", F.lit(0.5))
        .otherwise(F.pmod(F.xxhash64("row_id", F.lit(7)), F.lit(100000)) / 7.0)
    )
    return (
        log.select("*", m.alias("model_id"))
        .select("model_id", "row_id", "user_id", F.coalesce("long_view", F.lit(0)).alias("label"), s.alias("score"), "date")
        .cache()
    )


def test_check_finds_the_large_group(log, small_groups):
    assert has_large_group(log, ["user_id"])
    assert not has_large_group(log, ["user_id"], 500)
    assert has_large_group(log, [])


@pytest.mark.parametrize("descending", [False, True])
def test_positions(scores, small_groups, descending):
    keys = ["model_id", "user_id"]
    a = positions(scores, keys, "score", "p", descending, chunked=False)
    b = positions(scores, keys, "score", "p", descending, chunked=True)
    assert rows(a, "model_id", "row_id", "p") == rows(b, "model_id", "row_id", "p")


def test_prefix_sums(log, small_groups):
    sums = {"s": F.col("play_time_ms"), "n": F.lit(1.0)}
    a = prefix_sums(log, ["user_id"], ["date", "row_id"], sums, lead="date", chunked=False)
    b = prefix_sums(log, ["user_id"], ["date", "row_id"], sums, lead="date", chunked=True)
    assert rows(a, "row_id", "s", "n") == rows(b, "row_id", "s", "n")


def test_prefix_sums_keep_null_keys(log, small_groups):
    holes = log.withColumn("user_id", F.when(F.col("user_id") != 0, F.col("user_id")))
    a = prefix_sums(holes, ["user_id"], ["date", "row_id"], {"n": F.lit(1.0)}, lead="date", chunked=False)
    b = prefix_sums(holes, ["user_id"], ["date", "row_id"], {"n": F.lit(1.0)}, lead="date", chunked=True)
    assert rows(a, "row_id", "n") == rows(b, "row_id", "n")


def test_running_records(log, small_groups):
    a = running_records(log, ["user_id"], "row_id", "play_time_ms", chunked=False)
    b = running_records(log, ["user_id"], "row_id", "play_time_ms", chunked=True)
    assert rows(a, "row_id") == rows(b, "row_id")


def test_user_metrics(scores, small_groups):
    cols = ["model_id", "user_id", "n", "n_pos", "auc", "ndcg"]
    assert rows(M.user_metrics(scores, chunked=False), *cols) == rows(M.user_metrics(scores, chunked=True), *cols)


def test_momentum(log, small_groups):
    cols = ["row_id", "last1", "lastk_sum", "lastk_cnt", "lastk_rate", "gap_days"]
    assert rows(X.momentum(log, chunked=False), *cols) == rows(X.momentum(log, chunked=True), *cols)


def test_momentum_with_long_unlabelled_tail(log, small_groups):
    masked = log.withColumn("long_view", F.when(F.col("split") == "train", F.col("long_view")))
    cols = ["row_id", "last1", "lastk_sum", "lastk_cnt", "gap_days"]
    assert rows(X.momentum(masked, chunked=False), *cols) == rows(X.momentum(masked, chunked=True), *cols)


@pytest.mark.parametrize("length", [1, 5, 40])
def test_histories(log, small_groups, length):
    a, b = X.histories(log, length, chunked=False), X.histories(log, length, chunked=True)
    assert rows(a, "row_id", "hist", "mask") == rows(b, "row_id", "hist", "mask")


def test_causal_rates(log, small_groups):
    train = log.where(F.col("split") == "train")
    cols = ["row_id", "user_rate", "video_rate"]
    assert rows(X.causal_rates(train, chunked=False), *cols) == rows(X.causal_rates(train, chunked=True), *cols)


def test_list_quantile_and_length(log, small_groups):
    a, b = X.list_quantile(log, "play_time_ms", chunked=False), X.list_quantile(log, "play_time_ms", chunked=True)
    assert rows(a, "row_id", "list_q") == rows(b, "row_id", "list_q")
    a, b = X.list_length(log, chunked=False), X.list_length(log, chunked=True)
    assert rows(a, "row_id", "list_len") == rows(b, "row_id", "list_len")


def test_rank_average_and_pairs(scores, small_groups):
    a, b = B.rank_average(scores, chunked=False), B.rank_average(scores, chunked=True)
    assert rows(a, "row_id", "score") == rows(b, "row_id", "score")
    one = scores.where(F.col("model_id") == "c")
    assert rows(R.bpr_pairs(one, chunked=False)) == rows(R.bpr_pairs(one, chunked=True))
    assert rows(R.lambda_pairs(one, chunked=False)) == rows(R.lambda_pairs(one, chunked=True))


def test_quantiles(log, small_groups):
    probs = [0.0, 0.1, 0.37, 0.5, 0.9, 1.0]
    exact = log.agg(F.percentile("play_time_ms", F.lit(probs)).alias("q")).first()["q"]
    assert E.exact_quantiles(log, "play_time_ms", probs).first()["q"] == pytest.approx(exact)
    ties = log.withColumn("play_time_ms", F.when(F.col("row_id") % 3 > 0, 5.0).otherwise(F.col("row_id") * 1.0))
    exact = ties.agg(F.percentile("play_time_ms", F.lit(probs)).alias("q")).first()["q"]
    assert E.exact_quantiles(ties, "play_time_ms", probs).first()["q"] == pytest.approx(exact)


def test_vocabulary_by_ranges(spark, log):
    plain = rows(E.fit_vocab(log, "row_id"), "value", "id")
    spark.conf.set("spark.rankspark.groupRows", "20")
    try:
        assert rows(E.fit_vocab(log, "row_id"), "value", "id") == plain
    finally:
        spark.conf.unset("spark.rankspark.groupRows")


def test_cooccurrence_blocks(log):
    train = log.where(F.col("split") == "train")
    sets = {}
    for r in train.where("long_view = 1").select("user_id", "video_id").distinct().collect():
        sets.setdefault(r[0], set()).add(r[1])
    want = {}
    for items in sets.values():
        for a in items:
            for b in items:
                if a != b:
                    want[a, b] = want.get((a, b), 0) + 1
    for block in (2, 3, 1000):
        got = {(r["a"], r["b"]): r["n"] for r in C.item_cooccurrence(train, block).collect()}
        assert got == want
    assert rows(C.item_cf_scores(log, "valid", 2), "row_id", "cf") == rows(C.item_cf_scores(log, "valid"), "row_id", "cf")


def test_result_does_not_depend_on_partitions(spark, log):
    got = []
    for n in ("1", "16"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        out = X.causal_rates(log.where(F.col("split") == "train").repartition(int(n) + 1))
        got.append(rows(out, "row_id", "user_rate", "video_rate"))
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert got[0] == got[1]


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_keyed_join(log, small_groups, how):
    """User 0 is large and present on the side, user 36 is absent, and some keys are NULL."""
    left = log.select("row_id", F.when(F.col("row_id") % 50 != 7, F.col("user_id")).alias("user_id"))
    side = log.select("user_id").distinct().where("user_id < 30 and user_id % 3 = 0").withColumn("w", F.when(F.col("user_id") != 3, F.col("user_id") * 2))
    cols = ["row_id", "user_id"] + (["w"] if how in ("left", "inner") else [])
    for s in (side, side.where("user_id <> 0")):
        a, b = keyed_join(left, s, ["user_id"], how, large=False), keyed_join(left, s, ["user_id"], how, large=True)
        assert rows(a, *cols) == rows(b, *cols)


def factors(spark):
    i = F.col("id")
    return spark.range(60).select(i.alias("feature"), (i / 10).alias("w"), F.array(i / 7, i / 11).alias("v"))


def past(log):
    return X.histories(log, 3).select("row_id", F.col("video_id").cast("long").alias("target"), "hist", "mask")


def test_large_groups_through_whole_operators(spark, log, scores):
    """Operators that decide for themselves give the same rows with tiny limits as with the defaults."""
    train, rest = log.where("split = 'train'"), log.where("split <> 'train'")
    one = scores.where(F.col("model_id") == "c")

    def run():
        return [
            rows(X.lookup_rates(rest, train, ["user_id", "video_id"]), "row_id", "user_rate", "video_rate"),
            rows(X.decay(log), "row_id", "decay_pos", "decay_tot"),
            rows(X.asof_decay(log), "row_id", "decay_pos", "decay_tot"),
            rows(R.user_batches(train, 64, 1), "row_id", "batch_id"),
            rows(R.listwise_loss(one)),
            rows(S.sample_users(log, 0.4, 3), "row_id"),
            rows(S.drop_singletons(log.where("video_id < 3")), "row_id"),
            rows(C.item_cf_scores(log, "valid"), "row_id", "cf"),
            rows(M.half_primaries(scores)),
            rows(R.play_weights(log.where("long_view is not null"), ["tab"]), "row_id", "weight"),
            rows(R.fm_score(log.select("row_id", F.array(F.col("user_id"), F.col("video_id") % 2 + 40).alias("fields")), factors(spark))),
            *[rows(R.history_context(past(log), factors(spark).select(F.col("feature").alias("item"), F.col("v").alias("vec")), m)) for m in ("pool", "din")],
        ]

    plain = run()
    spark.conf.set("spark.rankspark.groupRows", "20")
    spark.conf.set("spark.rankspark.chunkRows", "16")
    try:
        assert run() == plain
    finally:
        spark.conf.unset("spark.rankspark.groupRows")
        spark.conf.unset("spark.rankspark.chunkRows")


def test_decay_of_a_key_with_thousands_of_days(spark):
    """5,000 days in a row, gaps of years, and half-lives from far below a day to far above a block."""
    days = [datetime.date(1990, 1, 1) + datetime.timedelta(days=d) for d in range(5000)]
    labels = {d: [i % 3 == 0, i % 7 == 0][: 1 + i % 2] for i, d in enumerate(days) if not 1000 < i < 2200}
    log = [(1, int(d.strftime("%Y%m%d")), int(y)) for d, ys in labels.items() for y in ys] + [(2, 19900103, 1), (2, 20200103, 0), (None, 19900101, 1), (None, 19900102, 0)]
    sdf = spark.createDataFrame(log, "user_id int, date int, long_view int")
    for halflife in (7.0, 0.02, 400.0):
        got = {(r.user_id, r.date): (r.decay_pos, r.decay_tot) for r in X.daily_decay(sdf, ["user_id"], halflife).collect()}
        rate, pos, tot, last = 0.5 ** (1.0 / halflife), 0.0, 0.0, None
        for d, ys in labels.items():
            gap = (d - last).days if last else 0
            pos, tot = pos * rate**gap, tot * rate**gap
            assert got[1, int(d.strftime("%Y%m%d"))] == pytest.approx((pos, tot), rel=1e-9, abs=1e-300)
            pos, tot, last = pos + sum(ys), tot + len(ys), d
        assert got[None, 19900102] == pytest.approx((rate, rate))
        assert got[2, 20200103] == pytest.approx((rate**10957, rate**10957), rel=1e-6, abs=1e-300)


def ledger_steps(spark, values):
    return spark.createDataFrame([(r, i, v) for r, vs in values.items() for i, v in enumerate(vs)], "run_id string, seq bigint, _v double")


def streak_by_hand(values, eps):
    best, after = None, 0
    for v in values:
        if v is not None and (best is None or v > best + eps):
            best, after = v, 0
        elif best is not None:
            after += 1
    return after


def test_streaks_are_composed_in_long_rising_runs(spark, small_groups):
    """A run that rises all the way has as many running maxima as steps: none of them may be gathered in a row."""
    rng = random.Random(1)
    runs = {
        "rising": [0.001 * i for i in range(700)], "dense": [1 + 1e-6 * i for i in range(300)], "ragged": [rng.random() for _ in range(200)],
        "stairs": [i // 5 * 0.002 + rng.random() * 0.0019 for i in range(400)], "one": [0.3], "missing": [None, 0.1, None, 0.5, None], "equal": [0.5] * 40,
    }
    for eps in (0.0, 0.0015, 0.002, 0.3):
        steps = ledger_steps(spark, runs)
        want = sorted((r, streak_by_hand(v, eps)) for r, v in runs.items())
        assert sorted(tuple(r) for r in L._streak(steps, eps, "n").select("run_id", "n").collect()) == want
        spark.conf.set("spark.rankspark.groupRows", "100000")
        assert sorted(tuple(r) for r in L._streak(steps, eps, "n").select("run_id", "n").collect()) == want
        spark.conf.set("spark.rankspark.groupRows", "20")


def star_ledger(spark, n=120):
    """A root that a third of all nodes hang on, and chains below some of them."""
    nodes = [("r", 0, None, "draft", True)] + [("r", i, 0 if i % 3 == 0 else i - 1 if i % 3 == 1 else max(0, i - 2), "debug" if i % 2 else "improve", i % 17 == 0) for i in range(1, n)]
    rows = [(r, i, p, s, c, {"lr": str(i)} if c or i % 5 else None, None) for r, i, p, s, c in nodes]
    return spark.createDataFrame(rows, "run_id string, node_id int, parent_id int, stage string, confirmed boolean, config map<string,string>, members array<int>"), nodes


def test_walks_in_a_star_ledger(spark, small_groups):
    ledger, nodes = star_ledger(spark)
    by = {i: (p, s, c) for _, i, p, s, c in nodes}

    def depth(i):
        n = 0
        while i is not None and by[i][1] == "debug" and by[i][0] is not None:
            n, i = n + 1, by[i][0]
        return n

    def identity(i):
        while i is not None and not by[i][2]:
            i = by[i][0]
        return i

    assert {r.node_id: r.depth for r in L.debug_depth(ledger).collect()} == {i: depth(i) for i in by}
    got = {r.node_id: r.identity_node for r in L.confirmed_identity(ledger).collect()}
    assert got == {i: identity(i) for i in by}
    loop = spark.createDataFrame([("r", 1, 2, "debug"), ("r", 2, 1, "debug")], "run_id string, node_id int, parent_id int, stage string")
    with pytest.raises(ValueError, match="cycle"):
        L.debug_depth(loop)


def test_statistics_of_a_large_group(scores, small_groups):
    for fn in (B.zscore, B.minmax):
        got = rows(fn(scores, "score", "z", ["model_id"]), "model_id", "row_id", "z")
        scores.sparkSession.conf.set("spark.rankspark.groupRows", "100000")
        assert rows(fn(scores, "score", "z", ["model_id"]), "model_id", "row_id", "z") == got
        scores.sparkSession.conf.set("spark.rankspark.groupRows", "20")


def test_decay_takes_old_days_from_running_sums(spark):
    """Only the days of two blocks are listed for a day; the rest, over the borders of eras, comes from sums that are carried on."""
    from datetime import date, timedelta

    from rankspark.operators import features as X

    start = date(1996, 4, 13) - timedelta(days=2450)  # days 7150 to 12100, over the eras that start with days 7200, 9600 and 12000
    days = [start + timedelta(days=k) for k in range(0, 4950, 7)]
    sdf = spark.createDataFrame([(1, int(d.strftime("%Y%m%d")), k % 2) for k, d in enumerate(days)], "user_id long, date int, long_view int")
    out = X.daily_decay(sdf, ["user_id"], 2.5)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("collect_list(") == 1
    got = {r.date: (r.decay_pos, r.decay_tot) for r in out.collect()}
    rate = 0.5 ** (1.0 / 2.5)
    for i, d in enumerate(days):
        ages = [(j, (d - days[j]).days) for j in range(i)]
        pos, tot = sum(rate**a for j, a in ages if j % 2), sum(rate**a for _, a in ages)
        found = got[int(d.strftime("%Y%m%d"))]
        assert abs(found[0] - pos) < 1e-14 and abs(found[1] - tot) < 1e-14

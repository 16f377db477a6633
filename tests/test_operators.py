"""Hand-sized inputs with results worked out by hand."""

import math

import pytest
from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.operators import decisions as D
from rankspark.operators import features as X
from rankspark.operators import fusion as B
from rankspark.operators import itemcf as C
from rankspark.operators import knowledge as N
from rankspark.operators import ledger as L
from rankspark.operators import metrics as M
from rankspark.operators import profile as P
from rankspark.operators import select as S
from rankspark.operators import trainset as R
from tests.conftest import rows


def impressions(spark, data):
    cols = "row_id long, date int, user_id string, video_id string, long_view int, split string"
    return spark.createDataFrame([(i, *r) for i, r in enumerate(data)], cols)


def packs(spark, users, labels, **models):
    data = [
        (m, i, u, y, float(s), 20220422)
        for m, scores in models.items()
        for i, (u, y, s) in enumerate(zip(users, labels, scores))
    ]
    return spark.createDataFrame(data, "model_id string, row_id long, user_id string, label int, score double, date int")


def test_profile_counts(spark):
    df = impressions(
        spark,
        [
            (20220419, "u0", "1", 1, "train"), (20220420, "u0", "2", 0, "train"), (20220421, "u1", "1", 1, "train"),
            (20220422, "u0", "1", 1, "valid"), (20220423, "u0", "3", 0, "valid"), (20220424, "u2", "1", 1, "valid"),
        ],
    )
    r = P.profile(df).first()
    assert r["pair_cover"] == pytest.approx(1 / 3)
    assert r["new_video_frac"] == pytest.approx(0.5) and r["new_user_frac"] == pytest.approx(0.5)
    assert r["train_n_rows"] == 3 and r["valid_single_imp_frac"] == pytest.approx(0.5)
    assert r["pos_drift"] == pytest.approx(0.0)


def test_user_mixed(spark):
    df = impressions(spark, [(1, "a", "x", 1, "train"), (1, "a", "y", 0, "train"), (1, "b", "x", 1, "train"), (1, "b", "y", 1, "train"), (1, "c", "x", 0, "train")])
    r = P.user_mixed(df).first()
    assert (r["users"], r["mixed_users"], r["pos_only_users"], r["neg_only_users"]) == (3, 1, 1, 1)


def test_smooth_and_sparse_fallback(spark):
    r = spark.range(1).select(E.smooth(F.lit(1.0), F.lit(1.0), F.lit(0.3)).alias("r")).first()["r"]
    assert r == pytest.approx(7 / 21)
    train = impressions(spark, [(1, "u0", "v1", 1, "train"), (1, "u1", "v1", 0, "train")])
    for loo in (False, True):
        assert {r["video_rate"] for r in X.lookup_rates(train, train, ["video_id"], loo).collect()} == {0.5}


def test_decay_same_day_and_missing(spark):
    same = impressions(spark, [(20220410, "u", "1", 1, "train"), (20220410, "u", "2", 0, "train")])
    assert rows(X.decay(same), "decay_pos", "decay_tot") == [(0.0, 0.0), (0.0, 0.0)]
    gap = impressions(spark, [(20220410, "u", "1", 1, "train"), (20220429, "u", "2", None, "test"), (20220430, "u", "3", None, "test")])
    got = {r["row_id"]: r["decay_pos"] for r in X.decay(gap).collect()}
    assert got[2] == pytest.approx(got[1] * 0.5 ** (1 / 2.5)) and got[1] > 0
    asof = {r["row_id"]: r["decay_pos"] for r in X.asof_decay(gap).collect()}
    assert asof[1] == pytest.approx(got[1]) and asof[2] == pytest.approx(got[2])


def test_momentum_rows(spark):
    df = spark.createDataFrame([(0, "u", 10, 1), (1, "u", 20, 0)], "row_id long, user_id string, time_ms long, long_view int")
    first, second = X.momentum(df).orderBy("row_id").collect()
    assert first["last1"] == -1 and first["gap_days"] is None
    assert second["last1"] == 1 and second["lastk_rate"] > 0.4 and second["gap_days"] > 0


def test_hidden_labels_do_not_change_features(spark):
    from rankspark.operators.encoding import rate_columns, recency_columns

    base = [(20220410 + i % 10, f"u{i % 3}", f"v{i % 4}", i % 2, "train") for i in range(30)]
    tail = [(20220422, f"u{i % 3}", f"v{i % 4}", 1, "valid") for i in range(6)]
    df = impressions(spark, base + tail).withColumn("time_ms", F.col("row_id") * 1000).withColumn("tab", F.lit("1"))
    blind = df.withColumn("long_view", F.when(F.col("split") == "train", F.col("long_view")))
    cols = ["row_id", "decay_rate", "decay_tot", "tab_decay", "lastk_rate", "gap", "last1"]
    assert rows(recency_columns(df), *cols) == rows(recency_columns(blind), *cols)
    cols = ["row_id", "user_rate", "video_rate"]
    assert rows(rate_columns(df), *cols) == rows(rate_columns(blind), *cols)


def test_item_cf(spark):
    df = impressions(
        spark,
        [(1, "u0", "a", 1, "train"), (1, "u0", "b", 1, "train"), (1, "u1", "a", 1, "train"), (2, "u0", "b", 0, "valid"), (2, "u0", "z", 0, "valid")],
    )
    got = {r["video_id"]: r["cf"] for r in C.item_cf_scores(df, "valid").collect()}
    assert got == {"b": 2.0, "z": 0.0}


def test_play_weights(spark):
    df = spark.createDataFrame([(0, 1, 10.0), (1, 1, 80000.0), (2, 0, 80000.0)], "row_id long, long_view int, play_time_ms double")
    w = [r["weight"] for r in R.play_weights(df).orderBy("row_id").collect()]
    assert w[1] > w[0] and w[2] == 1.0


def test_constant_scores_give_half(spark):
    r = M.ranking_metrics(packs(spark, "uuvv", [1, 0, 1, 0], m=[0.3] * 4)).first()
    assert r["gauc"] == pytest.approx(0.5)


def test_all_negative_user_counts_for_ndcg(spark):
    r = M.ranking_metrics(packs(spark, "uuv", [1, 0, 0], m=[0.9, 0.1, 0.5])).first()
    assert r["ndcg5"] == pytest.approx(0.5) and r["gauc"] == pytest.approx(1.0) and r["n_users"] == 2


def test_ndcg_by_hand(spark):
    s = packs(spark, "u" * 6, [0, 1, 0, 0, 1, 1], m=[6, 5, 4, 3, 2, 1])
    want = (1 / math.log2(3) + 1 / math.log2(6)) / (1 + 1 / math.log2(3) + 0.5)
    assert M.user_metrics(s).first()["ndcg"] == pytest.approx(want)


def test_rank_average_order(spark):
    s = packs(spark, "aabb", [1, 0, 0, 1], x=[0.9, 0.1, 0.2, 0.8], y=[0.8, 0.2, 0.1, 0.9])
    got = {r["row_id"]: r["score"] for r in B.rank_average(s).collect()}
    assert got[0] > got[1] and got[3] > got[2]


def test_topk_agreement_skips_singletons(spark):
    s = packs(spark, "abb", [1, 0, 1], inc=[0.5, 0.9, 0.1], cand=[0.5, 0.1, 0.9])
    assert M.topk_agreement(s, "inc").first()["top1_agree"] == 0.0
    lone = packs(spark, "abc", [1, 0, 1], inc=[0.5, 0.9, 0.1], cand=[0.5, 0.9, 0.1])
    assert M.topk_agreement(lone, "inc").first()["top1_agree"] == 0.0


def test_spearman_filter_drops_the_copy(spark):
    x = [i / 10 for i in range(10)]
    s = packs(spark, "a" * 10, [0] * 10, p=x, q=[v + 0.001 for v in x])
    assert [r["kept"] for r in B.spearman_filter(s, ["p", "q"]).orderBy("model_id").collect()] == [True, False]


def test_bootstrap(spark):
    users = [f"u{i // 4}" for i in range(80)]
    labels = [1, 0, 1, 0] * 20
    up = [0.9, 0.1, 0.8, 0.2] * 20
    s = packs(spark, users, labels, inc=up, same=up, worse=[-v for v in up])
    got = {r["model_id"]: r for r in M.paired_bootstrap(M.paired_users(M.user_metrics(s), "inc")).collect()}
    assert got["same"]["mean_delta"] == 0 and got["same"]["ci95_lo"] <= 0 <= got["same"]["ci95_hi"]
    assert got["worse"]["mean_delta"] < 0 and got["worse"]["ci95_hi"] < 0


def test_bootstrap_se_matches_theory(spark):
    """One-positive lists with nDCG 1 or less: the SE of the mean nDCG delta is sd / sqrt(n)."""
    users = [f"u{i // 2}" for i in range(600)]
    labels = [1, 0] * 300
    inc = [0.9, 0.1] * 300
    cand = [x for i in range(300) for x in ((0.9, 0.1) if i % 3 else (0.1, 0.9))]
    pairs = M.paired_users(M.user_metrics(packs(spark, users, labels, inc=inc, cand=cand)), "inc")
    se = M.paired_bootstrap(pairs).first()["se_val_delta"]
    d = (1 - 1 / math.log2(3) + 1.0) / 2
    want = d * math.sqrt((1 / 3) * (2 / 3) / 300)
    assert se == pytest.approx(want, rel=0.15)


def test_few_users_give_no_bootstrap(spark):
    s = packs(spark, "aabb", [1, 0, 1, 0], inc=[1, 0, 1, 0], cand=[0, 1, 0, 1])
    assert M.paired_bootstrap(M.paired_users(M.user_metrics(s), "inc")).where("se_val_delta IS NULL AND replicates IS NULL AND n_users > 0").count() == 1


def test_alpha_zero_keeps_the_model(spark):
    s = packs(spark, "aabb", [1, 0, 0, 1], m=[0.9, 0.1, 0.2, 0.8]).withColumnRenamed("score", "s_a").withColumn("s_b", F.col("row_id") * 1.0)
    by_alpha = {r["alpha"]: r["primary"] for r in B.alpha_metrics(s).collect()}
    assert by_alpha[0.0] == pytest.approx(1.0)
    assert B.pick_alpha(s).first()["alpha"] == 0.0


# ---- ledger ------------------------------------------------------------------------

NODE = {
    "run_id": 0, "seq": 0, "node_id": 0, "parent_id": None, "stage": "improve", "arm": "loss", "config": {}, "source_hash": "", "seed": 0,
    "is_buggy": False, "is_skip": False, "confirmed": False, "primary": None, "confirmed_mean": None, "members": None, "ensemble_kind": None,
    "exec_status": None, "partial": False, "weak_incumbent": False, "delta_primary": None, "se_val_delta": None, "ci95_lo": None, "ci95_hi": None,
    "expected_delta": None, "screen_pass": False,
}
NODE_SCHEMA = (
    "run_id long, seq long, node_id long, parent_id long, stage string, arm string, config map<string,string>, source_hash string, seed int, "
    "is_buggy boolean, is_skip boolean, confirmed boolean, primary double, confirmed_mean double, members array<long>, ensemble_kind string, "
    "exec_status string, partial boolean, weak_incumbent boolean, delta_primary double, se_val_delta double, ci95_lo double, ci95_hi double, "
    "expected_delta double, screen_pass boolean"
)


def nodes(spark, *changes):
    names = list(NODE)
    return spark.createDataFrame(
        [tuple({**NODE, "seq": i, "node_id": i, **c}[n] for n in names) for i, c in enumerate(changes)], NODE_SCHEMA
    )


def test_best_prefers_confirmed_then_first(spark):
    l = nodes(spark, {"primary": 0.7}, {"primary": 0.6, "confirmed": True}, {"primary": 0.6, "confirmed": True})
    assert L.best_node(l).first()["node_id"] == 1


def test_incumbent_seed0_of_members(spark):
    l = nodes(
        spark, {"primary": 0.60, "seed": 1}, {"primary": 0.61, "seed": 0}, {"primary": 0.62, "stage": "ensemble", "members": [0, 1], "confirmed": True}
    )
    r = L.incumbent(l).first()
    assert r["is_bag"] and r["seed0_primary"] == 0.61 and r["screen_bar"] == 0.62


def test_streaks(spark):
    l = nodes(
        spark,
        {"primary": 0.600, "confirmed": True}, {"primary": 0.601, "confirmed": True}, {"primary": 0.6025, "confirmed": True},
        {"primary": 0.604, "confirmed": True}, {"is_skip": True},
    )
    assert L.no_improve_streak(l, 0.002).first()["no_improve"] == 1
    assert L.billed_no_improve_streak(l, 0.002).first()["billed_no_improve"] == 2
    assert L.skip_streak(l).first()["skip_streak"] == 1


def test_debug_depth_chain(spark):
    l = nodes(spark, {"stage": "draft"}, *[{"stage": "debug", "parent_id": i} for i in range(9)])
    assert [r["depth"] for r in L.debug_depth(l).orderBy("node_id").collect()] == list(range(10))


def test_bag_without_config_inherits_member(spark):
    l = nodes(spark, {"config": {"k": "8"}, "primary": 0.5}, {"stage": "ensemble", "members": [0]}, {"parent_id": 1, "config": {"k": "64"}})
    got = {r["node_id"]: r["identity"] for r in L.confirmed_identity(l).collect()}
    assert got[1] == {"k": "8"} and got[2] == {"k": "8"} and got[0] == {"k": "8"}


def test_falsified_needs_negative_interval(spark):
    l = nodes(spark, {"delta_primary": -0.01, "ci95_hi": -0.001}, {"delta_primary": -0.01, "ci95_hi": 0.001})
    assert [r["f"] for r in l.select(L.is_falsified().alias("f")).collect()] == [True, False]


def test_ablation_winner_rules(spark):
    def run(c0, c1):
        data = [(0, i, s, p, 0.5, s) for i, ps in ((0, c0), (1, c1)) for s, p in enumerate(ps)]
        df = spark.createDataFrame(data, "run_id int, config_idx int, seed int, primary double, bar double, seq int")
        return L.ablation_winner(L.seed_table(df, ["run_id"]), L.pairwise_seed_table(df, ["run_id"]), ["run_id"]).first()["winner"]

    assert run([0.6, 0.6, 0.6], [0.61, 0.61, 0.61]) == 1
    assert run([0.6, 0.6, 0.6], [0.61, 0.61, 0.59]) == 0
    assert run([0.6, 0.4, 0.6], [0.61, 0.61, 0.59]) is None
    assert run([0.51, 0.51, 0.499], []) == 0
    assert run([0.5001, 0.5001, 0.4999], []) is None


def test_screen_reasons(spark):
    base = {"is_buggy": False, "primary": 0.6, "top1_agree": 0.9, "se_val_delta": 0.001, "temporal_disagree": 0.0005, "delta_front": 0.002,
            "delta_back": 0.002, "ci95_lo": 0.0005, "delta_ndcg": 0.001, "delta_primary": 0.002, "delta_gauc": 0.001}
    cases = {
        "passed": {}, "buggy": {"is_buggy": True}, "near duplicate": {"top1_agree": 0.98}, "unstable over time": {"temporal_disagree": 0.0041},
        "a half misses": {"delta_back": 0.0009}, "interval covers zero": {"ci95_lo": 0.0}, "ndcg down": {"delta_ndcg": -0.1}, "missed": {"delta_gauc": 0.0007},
    }
    schema = ", ".join(f"{k} {'boolean' if k == 'is_buggy' else 'double'}" for k in base) + ", want string"
    df = spark.createDataFrame([(*{**base, **c}.values(), w) for w, c in cases.items()], schema)
    for r in D.screen(df).collect():
        assert r["reason"] == r["want"]


def test_blend_rule(spark):
    df = spark.createDataFrame([(0.61, 0.60, 0.004), (0.61, 0.60, 0.006), (0.61, 0.60, None)], "a double, b double, se double")
    assert [r["ok"] for r in df.select(B.beats_bag(F.col("a"), F.col("b"), F.col("se")).alias("ok")).collect()] == [True, False, False]


def test_pick_candidate_prefers_few_flags(spark):
    df = spark.createDataFrame(
        [("x", 0.605, 0.604, 3), ("y", 0.604, 0.603, 1), ("z", 0.600, 0.600, 0)], "candidate string, score double, robust double, n_flags int"
    )
    assert D.pick_candidate(df).first()["candidate"] == "y"


# ---- configs, findings, text ---------------------------------------------------------


def test_config_numbers_compare_by_value(spark):
    df = spark.sql("""select parse_json('{"l2": 1e-6, "k": 16.0, "loss": "bpr", "use_hour": false, "seed": 3, "x": null}') as v""")
    assert df.select(E.fingerprint(E.config_map("v")).alias("f")).first()["f"] == 'loss="bpr"'


def test_signature(spark):
    df = spark.createDataFrame([("  Error\t at 0xAF12 line 42 ",)], "t string")
    assert df.select(E.normalize_signature("t").alias("s")).first()["s"] == "error at NxADDR line N"


def test_similar_errors_ranks_by_overlap(spark):
    q = spark.createDataFrame([(0, "shape mismatch in matmul")], "query_id long, signature string")
    c = spark.createDataFrame(
        [(1, "matmul shape mismatch", True), (2, "shape only", True), (3, "shape mismatch in matmul", False), (4, "none", True)],
        "trial_id long, message string, success boolean",
    )
    assert [(r["trial_id"], r["place"]) for r in N.similar_errors(q, c).orderBy("place").collect()] == [(1, 1), (2, 2)]


def test_graveyard_reads_old_keys(spark):
    recs = spark.createDataFrame(
        [('falsified:root:loss="bpr"', "measured-1seed", None, None), ("falsified:1k:7:k=8", "measured-1seed", None, None),
         ("falsified:pure:7:", "measured-1seed", "", "pure"), ("confirmed:k=64", "measured-3seed", "k=64", None)],
        "key string, tag string, fingerprint string, scale string",
    )
    assert rows(N.graveyard(recs), "scale", "fingerprint") == [("1k", "k=8"), ("pure", 'loss="bpr"')]


def test_graveyard_reads_every_form(spark):
    recs = spark.createDataFrame(
        [('falsified:[["k", 8], ["loss", "bpr"]]', None, None, None, None), ('falsified:1k:root:[["k", 9.0]]', "", None, None, "pure"),
         ("x", None, '{"k": 16, "seq_len": 20, "seed": 1}', None, "27k"), ("y", "[]", None, "was {'use_hour': True, 'k': 5}", ""),
         ("z", '[["k", 7]]', "not json", "no patch {k}", "27K")],
        "key string, fingerprint string, patch string, text string, scale string",
    ).withColumn("tag", F.lit("measured-1seed"))
    assert rows(N.graveyard(recs), "scale", "fingerprint") == [
        ("27k", "k=16;seq_len=20"), ("27k", "k=7"), ("27k", "seq_len=20"), ("pure", 'k=5;use_hour=true'), ("pure", 'k=8;loss="bpr"'), ("pure", "k=9"),
    ]


def test_similar_errors_reads_whole_texts(spark):
    long = "common " * 100
    q = spark.createDataFrame([(1, long + " needle"), (2, "common words only")], "query_id long, signature string")
    c = spark.createDataFrame(
        [(k, "common words", True) for k in range(20)] + [(50, "needle", True), (51, "common needle haystack", True), (52, "needle", False)],
        "trial_id long, message string, success boolean",
    )
    got = {(r.query_id, r.place): (r.trial_id, r.overlap) for r in N.similar_errors(q, c).collect()}
    assert got == {(1, 1): (51, 2), (1, 2): (0, 1), (1, 3): (1, 1), (2, 1): (0, 2), (2, 2): (1, 2), (2, 3): (2, 2)}


def test_small_models_stay_with_nulls(spark):
    s = spark.createDataFrame(
        [(m, i, f"u{i % 3}", i % 2, float(i), 1) for m, n in (("inc", 40), ("a", 40), ("b", 10)) for i in range(n)],
        "model_id string, row_id long, user_id string, label int, score double, date int",
    )
    got = {r.model_id: r for r in M.temporal_halves(s, "inc").collect()}
    assert got["a"].delta_front == 0.0 and got["b"].delta_front is None and len(got) == 2


def test_validate_drops_tree_keys_with_family(spark):
    p = spark.createDataFrame([(0, "architecture", {"model_family": '"gbm"', "gbm_leaves": "7", "seed": "1"})], "patch_id long, arm string, patch map<string,string>")
    assert N.validate_patches(p).first()["clean"] == {"model_family": '"gbm"'}


def test_grants_gate_the_test_split(spark):
    df = impressions(spark, [(1, "u", "a", 1, "train"), (2, "u", "a", 1, "test")])
    assert S.mask_labels(df).count() == 1
    empty = spark.createDataFrame([("  ",)], "grant_id string")
    assert S.mask_labels(df, empty).count() == 1
    grant = spark.createDataFrame([("g1",)], "grant_id string")
    assert rows(S.mask_labels(df, grant), "split", "long_view") == [("test", None), ("train", 1)]


def test_tail_stop_needs_both_sides(spark):
    df = impressions(spark, [(20220410 + i % 12, "u", "a", 1, "train") for i in range(60)])
    assert S.tail_stop_split(df, 20220419).where("split = 'stop'").count() == 0
    assert S.tail_stop_split(df, 20220419, 10).where("split = 'stop'").count() == 15


def test_sample_users_takes_whole_users(spark):
    df = impressions(spark, [(1, f"u{i % 10}", "a", 1, "train") for i in range(50)])
    got = S.sample_users(df, 0.3, 1)
    assert got.select("user_id").distinct().count() == 3 and got.count() == 15


def test_bucket_names_are_looked_up_once_per_bucket(spark):
    """Rows take ids by bucket number. Values outside train, missing values and NaN keep their buckets; unseen buckets the last id."""
    from rankspark.operators import encoding

    data = [(i, "train" if i < 30 else "test", float(i % 9), float(i * i % 7)) for i in range(40)]
    data += [(90, "test", None, float("nan")), (91, "test", -5.0, 1e9)]
    df = spark.createDataFrame(data, "row_id long, split string, a double, b double")
    cols, bins = ["a", "b"], {"a": 4, "b": 3}
    out = encoding.bucket_fields(df, cols, bins)
    assert "array_position(" not in out._jdf.queryExecution().optimizedPlan().toString()
    train = df.where("split = 'train'")
    edges = encoding.fit_edges(train, cols, bins)
    placed = encoding.bucketize(df, edges, cols)
    plain = encoding.bucket_ids(placed, encoding.bucket_vocab(placed.where("split = 'train'"), cols), cols)
    names = ["row_id", "a_id", "a_size", "b_id", "b_size"]
    assert rows(out, *names) == rows(plain, *names)

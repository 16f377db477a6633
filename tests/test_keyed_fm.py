"""The factorization machine whose parameters are a keyed table."""

import math
import random

import pytest

from rankspark.operators import keyed_fm as K
from rankspark.operators import models as L

SCHEMA = "row_id bigint, user_id int, video_id int, author_id string, tab string, long_view int, date int"


def log_of(spark, rows):
    return spark.createDataFrame([(i, u, v, a, t, y, 20240101) for i, (u, v, a, t, y) in enumerate(rows)], SCHEMA)


@pytest.fixture(scope="module")
def taste(spark):
    """Labels follow a product of hidden tastes, so no sum over single ids can order them; one tab holds half of all rows."""
    rng = random.Random(2)
    users, videos = [rng.choice((-1, 1)) for _ in range(40)], [rng.choice((-1, 1)) for _ in range(30)]
    rows = []
    for _ in range(3000):
        u, v = rng.randrange(40), rng.randrange(30)
        tab = "home" if rng.random() < 0.5 else str(rng.randrange(3))
        rows.append((u, v, None if v % 4 == 0 else f"a{v % 4}", tab, int(users[u] * videos[v] > 0)))
    return log_of(spark, rows).repartition(4).cache()


def auc_of(scores):
    rows = sorted((r.score, r.label) for r in scores.collect())
    pos = [s for s, y in rows if y == 1]
    neg = [s for s, y in rows if y == 0]
    return sum((p > n) + 0.5 * (p == n) for p in pos for n in neg) / (len(pos) * len(neg))


def test_separable_tastes_are_learnt(taste):
    train, rest = taste.where("row_id % 5 <> 0"), taste.where("row_id % 5 = 0")
    model = K.fit_keyed_fm(train, k=2, epochs=20)
    assert all(b < a for a, b in zip(model.losses, model.losses[1:])) and len(model.losses) > 5
    assert model.losses[0] == pytest.approx(math.log(2), abs=0.01) and model.losses[-1] < 0.25
    assert auc_of(K.predict_keyed_fm(model, rest)) > 0.97
    assert auc_of(K.predict_keyed_fm(K.fit_keyed_fm(train, k=2, epochs=0), rest)) < 0.7


def test_hot_ids_take_the_other_join_and_give_the_same_scores(spark, taste):
    train = taste.where("row_id % 5 <> 0")
    plain = K.predict_keyed_fm(K.fit_keyed_fm(train, k=2, epochs=2), taste)
    want = {r.row_id: r.score for r in plain.collect()}
    spark.conf.set("spark.rankspark.groupRows", "300")
    try:
        got = {r.row_id: r.score for r in K.predict_keyed_fm(K.fit_keyed_fm(train, k=2, epochs=2), taste).collect()}
    finally:
        spark.conf.unset("spark.rankspark.groupRows")
    assert got.keys() == want.keys() and max(abs(got[i] - want[i]) for i in want) < 1e-9


def test_agrees_with_the_dense_machine(spark):
    """On a small log with effects of single ids both machines order the rows nearly alike."""
    rng = random.Random(5)
    pull = [rng.gauss(0, 1.2) for _ in range(12)]
    rows = []
    for _ in range(1500):
        u, v = rng.randrange(10), rng.randrange(12)
        rows.append((u, v, f"a{v % 3}", str(u % 2), int(rng.random() < 1 / (1 + math.exp(-pull[v] - 0.5 * (u % 3 - 1))))))
    log = log_of(spark, rows)
    dense_rows = log.selectExpr("*", "user_id AS user_fid", "video_id AS video_fid", "video_id % 3 AS author_fid", "user_id % 2 AS tab_fid", "0 AS dur_fid")
    dense = L.predict(L.fit_fm(dense_rows, k=2, epochs=60), dense_rows)
    keyed = K.predict_keyed_fm(K.fit_keyed_fm(log, k=2, epochs=15), log)
    a, b = auc_of(dense), auc_of(keyed)
    assert b > 0.7 and b > a - 0.02
    both = {r.row_id: r.score for r in dense.collect()}
    pairs = [(both[r.row_id], r.score) for r in keyed.collect()]
    n = len(pairs)
    mean = [sum(p[i] for p in pairs) / n for i in (0, 1)]
    cov = sum((x - mean[0]) * (y - mean[1]) for x, y in pairs) / n
    spread = [math.sqrt(sum((p[i] - mean[i]) ** 2 for p in pairs) / n) for i in (0, 1)]
    assert cov / (spread[0] * spread[1]) > 0.9


def test_missing_unseen_and_empty(spark):
    log = log_of(spark, [(None, 1, None, "x", 1), (None, 2, None, None, 0), (3, 1, "a", "x", None), (4, 2, "a", "x", 1)])
    model = K.fit_keyed_fm(log, k=2, epochs=3)
    got = {r.row_id: r.score for r in K.predict_keyed_fm(model, log).collect()}
    assert len(got) == 4 and all(0 < s < 1 for s in got.values())
    assert {r.id for r in model.params.where("field = 0").collect()} == {"\x00", "4"}
    strange = K.predict_keyed_fm(model, log_of(spark, [(99, 99, "zz", "zz", None)])).first()
    assert strange.score == pytest.approx(1 / (1 + math.exp(-model.bias)))
    empty = K.fit_keyed_fm(log.where("false"), k=2)
    assert empty.losses == [] and {r.score for r in K.predict_keyed_fm(empty, log).collect()} == {0.5}

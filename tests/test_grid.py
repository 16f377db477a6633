"""The blend grid ranks users where they lie."""

import random

from pyspark.sql import functions as F

from rankspark.operators import fusion as B
from rankspark.operators import metrics as M
from tests.conftest import rows

POINTS = [{"grid_idx": 0, "alpha": 0.0, "gamma": 0.0}, {"grid_idx": 1, "alpha": 0.3, "gamma": 0.2}, {"grid_idx": 2, "alpha": 1.0, "gamma": 0.1}]


def _sides(spark, many=400):
    draw = random.Random(5)
    values = [0.0, -0.0, 0.25, 0.5, 0.75, 1.0]
    made = [
        (f"p{i % 2}", i, draw.choice([1, 2, 3, 4, 5, None]), draw.choice([0, 1, 1, None]) if i % 50 == 0 else draw.randint(0, 1), draw.choice(values), draw.choice(values))
        for i in range(many)
    ]
    made += [("p0", 1000, 1, 1, float("nan"), 0.5), ("p0", 1001, 1, 0, float("nan"), 0.25), ("p0", 1002, 2, 1, None, 0.5), ("p1", 1003, 99, 1, 0.5, 0.5)]
    return spark.createDataFrame(made, "pair string, row_id long, user_id long, label int, _z1 double, _z2 double")


def test_grid_equals_the_metrics_of_expanded_rows(spark):
    sides = _sides(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")  # users lie across batches
    try:
        got = B.grid_metrics(sides, POINTS, B.blend_score(), False, ["pair"])
        assert "Window" not in got._jdf.queryExecution().executedPlan().toString()
        for point in POINTS:
            score = B.blend(F.col("_z1"), F.col("_z2"), F.lit(point["alpha"]), F.lit(point["gamma"]))
            want = M.ranking_metrics(sides.withColumn("score", score), ["pair"], chunked=False)
            names = ["pair", "n_users", "gauc", "ndcg5", "primary"]
            assert rows(got.where(F.col("grid_idx") == point["grid_idx"]), *names) == rows(want, *names)
        one = B.grid_metrics(sides.where("pair = 'p1'"), POINTS, B.blend_score(), False)
        assert rows(one, "grid_idx", "primary") == rows(got.where("pair = 'p1'"), "grid_idx", "primary")
        assert B.grid_metrics(sides.where("false"), POINTS, B.blend_score(), False, ["pair"]).isEmpty()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_border_of_the_halves_is_looked_up_in_one_block(spark, monkeypatch):
    monkeypatch.setattr(M, "HALF_BLOCK", 8)
    draw = random.Random(3)
    made = [(m, i * 3 + (m == "b"), 20240101 + draw.randint(0, i // 30)) for m, n in (("a", 101), ("b", 64), ("c", 40), ("d", 31)) for i in range(n)]
    made = [(m, i, 7 if m == "c" else d) for m, i, d in made]
    got = M.with_halves(spark.createDataFrame(made, "model_id string, row_id long, date int"))
    want = []
    for m in "abc":
        mine = sorted((i, d) for k, i, d in made if k == m)
        days = sorted(d for _, d in mine)
        n = len(days)
        middle = (days[(n - 1) // 2] + days[n // 2]) / 2
        cut = sum(d <= middle for d in days)
        cut = n // 2 if cut < 16 or n - cut < 16 else cut
        want += [(m, i, "front" if at < cut else "back") for at, (i, _) in enumerate(mine)]
    assert rows(got, "model_id", "row_id", "half") == sorted(want, key=repr)
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Window") == 2 + 1  # over counted blocks, and inside one block

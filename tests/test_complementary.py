"""The complementary set in one pass and by joins."""

from rankspark.operators import ledger as L
from rankspark.sources.mapped import ledger
from tests.conftest import rows


def test_complementary_set_reads_its_groups_once(spark, monkeypatch):
    """Both forms agree with the definition over near_top, and the result reads written groups without another join."""
    nodes = ledger(spark, "/root/testdata/sf0.001")
    eps, delta = 0.02, 0.1
    near = L.near_top(nodes, eps).select("run_id", "fp")
    wide = L.near_top(nodes, delta).select("run_id", "fp").join(near.select("run_id").distinct(), "run_id", "left_anti")
    want = rows(near.unionByName(wide))
    one = L.complementary_set(nodes, eps, delta)
    assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    assert rows(one) == want and want
    monkeypatch.setattr(L, "has_large_group", lambda *a, **k: True)
    assert rows(L.complementary_set(nodes, eps, delta)) == want

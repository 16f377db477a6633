"""Number texts of finding keys."""

from pyspark.sql import functions as F

from rankspark.operators import knowledge as N
from tests.conftest import rows


def test_keys_hold_the_number_as_c_and_python_print_it(spark):
    values = [0.260055, 0.177695, 0.447445, 0.5, 0.000005, -0.000005, 0.0, -1e-9, 12345.678905, 0.03125, 1.0 / 64, 3.0 / 64, 2.5e11, None]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    found = [r["t"] for r in df.select("i", N._num("v").alias("t")).orderBy("i").collect()]
    assert found == ["na" if v is None else f"{v:.5f}" for v in values]


def test_merged_keys_do_not_depend_on_the_formatter(spark):
    """A record whose key was written by another program meets its own key again."""
    records = "key string, tag string, run_id long, text string, fingerprint string, scale string, pos long"
    told = spark.createDataFrame([(f"incumbent:7:{0.447445:.5f}", "measured-3seed", 1, "told", None, None, 1)], records)
    mine = spark.createDataFrame([(7, 0.447445)], "node long, v double")
    key = F.concat(F.lit("incumbent:"), F.col("node").cast("string"), F.lit(":"), N._num("v"))
    none = F.lit(None).cast("string")
    again = mine.select(
        key.alias("key"), F.lit("measured-3seed").alias("tag"), F.lit(2).cast("long").alias("run_id"), F.lit("mine").alias("text"),
        none.alias("fingerprint"), none.alias("scale"), F.lit(2).cast("long").alias("pos"),
    )
    assert rows(N.merge_findings(told, again), "key", "run_id") == [("incumbent:7:0.44744", 1)]

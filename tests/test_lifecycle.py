"""A trial from rows to a screened ledger line, and a checked submission."""

from pyspark.sql import functions as F

from rankspark.plans import lifecycle as Y
from rankspark.sources import sinks as K


def log(spark):
    i = F.col("id")
    return spark.range(600).select(
        i.alias("row_id"),
        F.when(i < 400, 20220410).when(i < 520, 20220423).otherwise(20220430).alias("date"),
        (i % 12).cast("string").alias("user_id"),
        (F.pmod(F.xxhash64("id"), F.lit(20))).cast("string").alias("video_id"),
        (i % 5).cast("string").alias("author_id"),
        F.lit("1").alias("tab"),
        ((i % 7) * 1000.0).alias("duration_ms"),
        F.when(i < 520, (F.pmod(F.xxhash64("id"), F.lit(20)) < 9).cast("int")).alias("long_view"),
        F.when(i < 400, "train").when(i < 520, "valid").otherwise("test").alias("split"),
    )


def test_trial_and_submission(spark, tmp_path):
    sdf = log(spark).cache()
    packs, journal = str(tmp_path / "packs"), str(tmp_path / "ledger")
    base = sdf.where("split = 'valid'").select(
        F.lit("base").alias("model_id"), "row_id", "user_id", F.col("long_view").alias("label"), (F.col("row_id") % 11 * 1.0).alias("score"), "date"
    )
    K.write_scores(base, packs)
    out = Y.run_trial(spark, sdf, packs, journal, "fm", "base", k=2, epochs=30, lr=0.1).collect()
    assert len(out) == 1 and out[0]["delta_primary"] > 0 and out[0]["reason"]
    assert spark.read.json(journal).count() == 1

    test_rows = sdf.where("split = 'test'").select((F.col("row_id") - 520).alias("row_id"), "user_id", "video_id")
    a = test_rows.select(F.lit("a").alias("model_id"), "row_id", "user_id", F.lit(None).cast("int").alias("label"), (F.col("row_id") % 7 * 1.0).alias("score"), F.lit(20220430).alias("date"))
    b = a.withColumn("model_id", F.lit("b")).withColumn("score", F.col("row_id") % 5 * 1.0)
    path = str(tmp_path / "submission")
    assert Y.finalize(a.unionByName(b), ["a", "b"], test_rows, path).count() == 0
    assert spark.read.option("header", True).csv(path).count() == 80
    broken = test_rows.where("row_id < 79")
    assert [r["violation"] for r in Y.finalize(a.unionByName(b), ["a", "b"], broken, str(tmp_path / "no")).collect()] == ["extra row"]


def test_cuts_are_dropped(spark):
    from rankspark.session import cut_lineage, drop_cuts, new_folder

    drop_cuts(spark)
    cut = cut_lineage(spark.range(3))
    assert cut.count() == 3
    new_folder(spark, "never-written")
    assert drop_cuts(spark) == 1 and drop_cuts(spark) == 0

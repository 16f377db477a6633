"""Composed jobs: one trial from log to screened ledger row, finalising, and the off-policy check."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.operators import decisions as D
from rankspark.operators import encoding as E
from rankspark.operators import fusion as B
from rankspark.operators import metrics as M
from rankspark.operators import models as L
from rankspark.session import cut_lineage
from rankspark.sources import sinks as K


def offpolicy_metrics(scores: DataFrame) -> DataFrame:
    """The same ranking metrics on the randomized-exposure rows only."""
    return M.ranking_metrics(scores.where(F.col("split") == "log_random").drop("split"))


def trial_scores(sdf: DataFrame, model_id: str, k: int = 16, epochs: int = 40, lr: float = 0.05, seed: int = 0) -> DataFrame:
    """Fit the factorization machine on train and score the other splits."""
    rows = cut_lineage(E.base_fields(sdf))
    model = L.fit_fm(rows.where(F.col("split") == "train"), k=k, epochs=epochs, lr=lr, seed=seed)
    scored = model.transform(rows.where(F.col("split") != "train"))
    from pyspark.ml.functions import vector_to_array

    return scored.select(
        F.lit(model_id).alias("model_id"), "row_id", "user_id", "video_id", F.col("long_view").alias("label"),
        vector_to_array("probability")[1].alias("score"), "date", "split",
    )


def run_trial(spark: SparkSession, sdf: DataFrame, score_path: str, ledger_path: str, model_id: str, incumbent: str, **fit) -> DataFrame:
    """Score a trial, store its pack, compare it with the incumbent's pack, screen it and append the result."""
    pack = trial_scores(sdf, model_id, **fit).where(F.col("split") == "valid").drop("split", "video_id")
    K.write_scores(pack, score_path)
    both = cut_lineage(K.read_scores(spark, score_path, [incumbent, model_id]))
    compared = B.compare_all(both, incumbent).withColumn("is_buggy", F.lit(False))
    screened = cut_lineage(D.screen(compared))
    K.append_jsonl(screened, ledger_path)
    return screened


def finalize(scores: DataFrame, members: list[str], rows: DataFrame, path: str, expected: float | None = None) -> DataFrame:
    """Fuse the members, check the fused test scores against the rows to submit, and write the submission when
    nothing is violated. Returns the violations (none on success)."""
    fused = cut_lineage(B.rank_average(scores, members).join(rows.select("row_id", "video_id"), "row_id", "left"))
    if expected is not None:
        check = B.fuse_and_check(scores.where(F.col("label").isNotNull()), members, expected).first()
        if check["status"] != "ok":
            raise ValueError(f"fused primary {check['primary']:.5f} drifts from {expected:.5f}")
    problems = cut_lineage(K.check_submission(fused, rows))
    if problems.isEmpty():
        K.write_submission(fused, path)
    return problems



"""Rankers fitted with Spark ML on encoded impressions."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import FMClassifier, GBTClassifier, LogisticRegression
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ID_FIELDS = ["user_fid", "video_fid", "author_fid", "tab_fid", "dur_fid"]


def _score(model, rows: DataFrame) -> DataFrame:
    return model.transform(rows).select(
        "row_id", "user_id", F.col("long_view").alias("label"), vector_to_array("probability")[1].alias("score"), "date"
    )


def fit_fm(train: DataFrame, fields: list[str] = ID_FIELDS, k: int = 16, lr: float = 0.05, l2: float = 1e-6,
           epochs: int = 40, seed: int = 0):
    """Factorization-machine classifier on sparse one-hot fields."""
    hot = OneHotEncoder(inputCols=fields, outputCols=[f"{f}_v" for f in fields], handleInvalid="keep", dropLast=False)
    pack = VectorAssembler(inputCols=[f"{f}_v" for f in fields], outputCol="features")
    fm = FMClassifier(labelCol="long_view", factorSize=k, stepSize=lr, regParam=l2, maxIter=epochs, seed=seed)
    return Pipeline(stages=[hot, pack, fm]).fit(train.where(F.col("long_view").isNotNull()))


def fit_gbt(train: DataFrame, columns: list[str], weight: str | None = None, rounds: int = 20, depth: int = 4, seed: int = 0):
    """Boosted trees on id and numeric columns (pointwise; rows may carry play-time weights)."""
    pack = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="keep")
    gbt = GBTClassifier(labelCol="long_view", maxIter=rounds, maxDepth=depth, seed=seed)
    if weight:
        gbt = gbt.setWeightCol(weight)
    return Pipeline(stages=[pack, gbt]).fit(train.where(F.col("long_view").isNotNull()))


def predict(model, rows: DataFrame) -> DataFrame:
    return _score(model, rows)


def pair_differences(pairs: DataFrame, rows: DataFrame, columns: list[str]) -> DataFrame:
    """Feature differences of drawn pairs, once per direction with labels 1 and 0."""
    vec = F.array(*[F.col(c).cast("double") for c in columns])
    pos = rows.select(F.col("row_id").alias("pos_row"), vec.alias("_p"))
    neg = rows.select(F.col("row_id").alias("neg_row"), vec.alias("_n"))
    diff = pairs.join(pos, "pos_row").join(neg, "neg_row").select(
        F.zip_with("_p", "_n", lambda a, b: a - b).alias("d")
    )
    both = F.explode(
        F.array(F.struct(F.lit(1.0).alias("y"), F.lit(1.0).alias("s")), F.struct(F.lit(0.0).alias("y"), F.lit(-1.0).alias("s")))
    )
    return diff.withColumn("_e", both).select(
        F.col("_e.y").alias("label"), F.transform("d", lambda x: x * F.col("_e.s")).alias("diff")
    )


def fit_pairwise(pairs: DataFrame, rows: DataFrame, columns: list[str], epochs: int = 50, l2: float = 0.0):
    """Linear pairwise ranker: logistic regression without intercept on pair differences."""
    return fit_differences(pair_differences(pairs, rows, columns).select("label", array_to_vector("diff").alias("features")), epochs, l2)


def fit_differences(data: DataFrame, epochs: int = 50, l2: float = 0.0):
    return LogisticRegression(fitIntercept=False, maxIter=epochs, regParam=l2, standardization=False).fit(data)


def pairwise_scores(model, rows: DataFrame, columns: list[str]) -> DataFrame:
    score = sum((F.col(c) * float(w) for c, w in zip(columns, model.coefficients)), F.lit(0.0))
    return rows.select("row_id", "user_id", F.col("long_view").alias("label"), score.alias("score"), "date")

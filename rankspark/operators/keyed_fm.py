"""Factorization machine whose parameters are a keyed table.

Parameters lie in rows (field, id, w, v), so neither their number nor a field's number of ids meets a vector or a driver. An epoch joins each field's
rows to the training rows, sums gradients and curvatures per (field, id) with map-side combining, and writes the next table. All coordinates move at
once along their own damped Newton step; an epoch that does not lower the loss is taken back and tried with half the step. The driver reads one row an epoch.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.functions.joins import keyed_join
from rankspark.functions.ordered import has_large_group
from rankspark.functions.scalars import uniform
from rankspark.session import cut_lineage

FIELDS = ["user_id", "video_id", "author_id", "tab"]
LABEL = "long_view"
SPREAD = 0.2  # width of the interval of starting factors
DAMP_W, DAMP_V = 0.01, 0.1  # curvature added per row, so that a flat direction takes a bounded step
SHORTEST = 1.0 / 1024  # step below which training has converged


@dataclass
class FactorModel:
    params: DataFrame  # field, id, w, v
    bias: float
    fields: list[str]
    k: int
    losses: list[float] = field(default_factory=list)  # of the starting point and of every epoch kept, per row, penalty included


def _id(name: str) -> Column:
    """A field's id as text; a missing id is an id of its own."""
    return F.coalesce(F.col(name).cast("string"), F.lit("\x00"))


def _keyed(rows: DataFrame, fields: list[str]) -> DataFrame:
    return rows.withColumns({f"_f{i}": _id(name) for i, name in enumerate(fields)})


def starting_params(train: DataFrame, fields: list[str], k: int, seed: int) -> DataFrame:
    """w 0 and hashed factors for every id of the training rows."""
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_f{i}").alias("id")) for i in range(len(fields))]))
    ids = train.select(cells.alias("c")).select("c.field", "c.id").distinct()
    key = F.concat_ws("|", F.col("field").cast("string"), F.col("id"))
    v = [(uniform(key, f"{seed}|{j}") - 0.5) * SPREAD for j in range(k)]
    return ids.select("field", "id", F.lit(0.0).alias("w"), F.array(*v).alias("v"))


def _dot(a: Column, b: Column, k: int) -> Column:
    return sum((F.get(a, F.lit(j)) * F.get(b, F.lit(j)) for j in range(1, k)), F.get(a, F.lit(0)) * F.get(b, F.lit(0)))


def with_logits(rows: DataFrame, params: DataFrame, bias: float, n_fields: int, k: int, large: list[bool]) -> DataFrame:
    """rows with _z (logit), _s (sum of factors) and _r (squared norm of the row's parameters). An id without parameters adds nothing."""
    out = rows
    for i in range(n_fields):
        side = params.where(F.col("field") == i).select(F.col("id").alias(f"_f{i}"), F.col("w").alias(f"_w{i}"), F.col("v").alias(f"_v{i}"))
        out = keyed_join(out, side, [f"_f{i}"], large=large[i])
    w = [F.coalesce(f"_w{i}", F.lit(0.0)) for i in range(n_fields)]
    v = [[F.coalesce(F.get(f"_v{i}", F.lit(j)), F.lit(0.0)) for j in range(k)] for i in range(n_fields)]
    total = [sum(v[i][j] for i in range(1, n_fields)) + v[0][j] for j in range(k)]
    squares = sum((v[i][j] * v[i][j] for i in range(n_fields) for j in range(k)), F.lit(0.0))
    out = out.select(
        *rows.columns, F.array(*total).alias("_s"), squares.alias("_q"), sum(w, F.lit(float(bias))).alias("_l"), sum((x * x for x in w), squares).alias("_r")
    )
    return out.withColumn("_z", F.col("_l") + 0.5 * (_dot(F.col("_s"), F.col("_s"), k) - F.col("_q"))).drop("_q", "_l")


def epoch_sums(scored: DataFrame, n_fields: int, k: int, l2: float) -> DataFrame:
    """Per (field, id): rows n, sums of the residual g and the curvature h, of both times the factor sums, and of the loss."""
    z, y = F.col("_z"), F.col(LABEL).cast("double")
    p = 1 / (1 + F.exp(-z))
    # log(1 + exp(z)) - y z, written so that neither end overflows.
    loss = F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z))) - y * z + F.lit(l2 / 2) * F.col("_r")
    rows = scored.select(*[f"_f{i}" for i in range(n_fields)], "_s", (p - y).alias("_e"), (p * (1 - p)).alias("_h"), loss.alias("_loss"))
    cell = F.explode(F.array(*[F.struct(F.lit(i).alias("field"), F.col(f"_f{i}").alias("id")) for i in range(n_fields)]))
    s = [F.get("_s", F.lit(j)) for j in range(k)]
    return (
        rows.select(cell.alias("c"), "_s", "_e", "_h", "_loss")
        .groupBy(F.col("c.field").alias("field"), F.col("c.id").alias("id"))
        .agg(
            F.count(F.lit(1)).alias("n"), F.sum("_e").alias("g"), F.sum("_h").alias("h"), F.sum("_loss").alias("loss"),
            F.array(*[F.sum(F.col("_e") * x) for x in s]).alias("gs"), F.array(*[F.sum(F.col("_h") * x) for x in s]).alias("hs"),
            F.array(*[F.sum(F.col("_h") * x * x) for x in s]).alias("hss"),
        )
    )


def moved(params: DataFrame, sums: DataFrame, step: float, n_fields: int, k: int, l2: float) -> DataFrame:
    """Every coordinate's damped Newton step; curvatures are multiplied by the number of fields, since all fields of a row move together."""
    both = params.join(sums, ["field", "id"])
    n, many, eta = F.col("n"), F.lit(float(n_fields)), F.lit(float(step))
    w = F.col("w") - eta * (F.col("g") + l2 * n * F.col("w")) / (many * F.col("h") + (l2 + DAMP_W) * n)
    v = []
    for j in range(k):
        x, gs, hs, hss = (F.get(c, F.lit(j)) for c in ("v", "gs", "hs", "hss"))
        bend = hss - 2 * x * hs + x * x * F.col("h")
        v.append(x - eta * (gs - x * F.col("g") + l2 * n * x) / (many * F.greatest(bend, F.lit(0.0)) + (l2 + DAMP_V) * n))
    return both.select("field", "id", w.alias("w"), F.array(*v).alias("v"))


def fit_keyed_fm(train: DataFrame, fields: list[str] = FIELDS, k: int = 8, epochs: int = 20, l2: float = 1e-4, step: float = 1.0, seed: int = 0) -> FactorModel:
    """Fit on the rows whose label is known. Missing ids are an id; without rows the model scores one half everywhere."""
    names = [f"_f{i}" for i in range(len(fields))]
    rows = cut_lineage(_keyed(train.where(F.col(LABEL).isNotNull()), fields).select(LABEL, *names))
    large = [has_large_group(rows, [c]) for c in names]
    params, bias = cut_lineage(starting_params(rows, fields, k, seed)), 0.0
    model = FactorModel(params, bias, fields, k)

    def measured(params: DataFrame, bias: float) -> tuple[DataFrame, float | None, float]:
        scored = with_logits(rows, params, bias, len(fields), k, large)
        sums = cut_lineage(epoch_sums(scored, len(fields), k, l2))
        # Every row has one id of the first field, so its sums are those of all rows.
        r = sums.where("field = 0").agg(F.sum("n").alias("n"), F.sum("g").alias("g"), F.sum("h").alias("h"), F.sum("loss").alias("loss")).first()
        if not r.n:
            return sums, None, 0.0
        return sums, r.loss / r.n, r.g / ((len(fields) + 1) * r.h + DAMP_W * r.n)

    sums, loss, pull = measured(params, bias)
    if loss is None:
        return model
    model.losses.append(loss)
    while len(model.losses) <= epochs and step >= SHORTEST:
        params, bias = cut_lineage(moved(model.params, sums, step, len(fields), k, l2)), model.bias - step * pull
        next_sums, next_loss, next_pull = measured(params, bias)
        if next_loss < model.losses[-1]:
            model.params, model.bias, sums, pull = params, bias, next_sums, next_pull
            model.losses.append(next_loss)
        else:
            step /= 2
    return model


def predict_keyed_fm(model: FactorModel, rows: DataFrame) -> DataFrame:
    """row_id, user_id, label, score (probability), date."""
    keyed = _keyed(rows, model.fields)
    large = [has_large_group(keyed, [f"_f{i}"]) for i in range(len(model.fields))]
    scored = with_logits(keyed, model.params, model.bias, len(model.fields), model.k, large)
    return scored.select("row_id", "user_id", F.col(LABEL).alias("label"), (1 / (1 + F.exp(-F.col("_z")))).alias("score"), "date")

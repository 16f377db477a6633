"""Streaming counters, drift, momentum, enrichment, cost and finding jobs.

Each function maps a streaming DataFrame to a streaming DataFrame; `run_to_table` drives one to completion
over the available input and returns what it wrote."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rankspark.operators.features import LAST_K, MS_PER_DAY, with_author
from rankspark.operators.features import momentum as features_momentum
from rankspark.session import cut_lineage, new_folder


def user_counts(stream: DataFrame) -> DataFrame:
    """Rows and positives per split and user."""
    return stream.groupBy("split", "user_id").agg(F.count(F.lit(1)).alias("n"), F.sum("long_view").alias("pos"))


def _utc_date(ts):
    """yyyymmdd of a UTC instant, whatever the session time zone."""
    day = F.date_from_unix_date(F.floor(F.unix_seconds(ts) / 86400).cast("int"))
    return F.date_format(day, "yyyyMMdd").cast("int")


def daily_rate(stream: DataFrame, ts: str = "ts", delay: str = "1 hour") -> DataFrame:
    """Positive rate per day of event time; rows later than the watermark are dropped."""
    w = F.window(ts, "1 day")
    return (
        stream.withWatermark(ts, delay)
        .groupBy(w)
        .agg(F.count(F.lit(1)).alias("n"), F.avg("long_view").alias("pos_rate"))
        .select(_utc_date(F.col("window.start")).alias("date"), "n", "pos_rate")
    )


MOMENTUM_OUT = "row_id long, user_id long, last1 int, lastk_sum double, lastk_cnt double, gap_ms long"
MOMENTUM_STATE = "labels array<int>, prev long"


def _momentum(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """One user's new rows of a micro-batch, in time order; the state is five labels and a time."""
    labels, prev = (list(state.get[0]), state.get[1]) if state.exists else ([], None)
    rows = pd.concat(list(batches)).sort_values(["time_ms", "row_id"])
    label, time = rows["long_view"].to_numpy(float), rows["time_ms"].to_numpy("int64")
    known = ~np.isnan(label)
    seen = np.concatenate([np.array(labels, dtype=float), label[known]])
    before = len(labels) + np.cumsum(known) - known  # labels seen before each row
    first = np.maximum(0, before - LAST_K)
    total = np.concatenate([[0.0], np.cumsum(seen)])
    gap = np.diff(time, prepend=time[0] + 1 if prev is None else prev)
    state.update((seen[-LAST_K:].astype(int).tolist(), int(time[-1])))
    yield pd.DataFrame({
        "row_id": rows["row_id"].to_numpy(), "user_id": key[0], "last1": np.where(before > 0, np.append(seen, -1.0)[before - 1], -1).astype("int32"),
        "lastk_sum": total[before] - total[first], "lastk_cnt": (before - first).astype(float), "gap_ms": gap,
    })


def momentum(stream: DataFrame) -> DataFrame:
    """Last label, last-k sum and count, and gap before each row, from per-user state. A row is emitted before
    its own label enters the state. Input must arrive in time order across micro-batches; a user's rows of one micro-batch meet in one
    task, so a micro-batch is to be bounded by the source's trigger options. momentum_table has no such frame."""
    cols = stream.select("user_id", "row_id", "time_ms", F.col("long_view").cast("double").alias("long_view"))
    return cols.groupBy("user_id").applyInPandasWithState(
        _momentum, MOMENTUM_OUT, MOMENTUM_STATE, "append", GroupStateTimeout.NoTimeout
    )


def stateful_table(stream: DataFrame, folder: str, step: Callable[[DataFrame, DataFrame | None], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """Drive step(batch, state) -> (rows, new state) over the available input, with the state as a table per micro-batch.

    A micro-batch reads the state its predecessor wrote and overwrites its own rows and state, so a batch that is run again after a failure changes nothing. The
    stream's checkpoint lies in the folder: starting again there goes on where it stopped. Only the last two states are kept."""
    spark = stream.sparkSession

    def path(kind: str, batch_id: int) -> str:
        return f"{folder}/{kind}/_b={batch_id}"

    def run(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        state = session.read.parquet(path("state", batch_id - 1)) if batch_id else None
        rows, after = step(cut_lineage(batch), state)
        after.write.mode("overwrite").parquet(path("state", batch_id))
        rows.write.mode("overwrite").parquet(path("rows", batch_id))
        old = session._jvm.org.apache.hadoop.fs.Path(path("state", batch_id - 2))
        old.getFileSystem(session._jsc.hadoopConfiguration()).delete(old, True)

    query = stream.writeStream.option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(run).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    return spark.read.parquet(f"{folder}/rows")


def _momentum_step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The batch operator over a user's last k labels, its last row and the new rows. The state is such rows: (user_id, row_id, time_ms, long_view)."""
    new = batch.select("user_id", "row_id", "time_ms", F.col("long_view").cast("int").alias("long_view"), F.lit(True).alias("_new"))
    log = new if state is None else new.unionByName(state.withColumn("_new", F.lit(False)))
    made = features_momentum(log).where("_new")
    gap = F.coalesce(F.round(F.col("gap_days") * MS_PER_DAY).cast("long"), F.lit(-1))
    latest = Window.partitionBy("user_id").orderBy(F.desc("time_ms"), F.desc("row_id"))  # the first k are cut before the exchange
    tops = [log.where(c).withColumn("_n", F.row_number().over(latest)).where(F.col("_n") <= n).drop("_n", "_new") for c, n in (("long_view IS NOT NULL", LAST_K), ("true", 1))]
    out = made.select("row_id", "user_id", F.col("last1").cast("int").alias("last1"), "lastk_sum", "lastk_cnt", gap.alias("gap_ms"))
    return out, tops[0].unionByName(tops[1]).distinct()


def momentum_table(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """momentum without Python workers or a frame per user: large users take the chunked plan of the batch operator inside each micro-batch, and the
    state holds at most k + 1 rows per user."""
    return stateful_table(stream, folder or new_folder(stream.sparkSession, "stream-momentum"), _momentum_step).drop("_b")


def user_sparsity(stream: DataFrame, folder: str | None = None) -> DataFrame:
    """user_counts carried to the profile of users after each micro-batch: per batch and split the number of users and rows, mean rows per user, and users with one
    impression and with a single label class."""

    def step(batch: DataFrame, state: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        new = user_counts(batch)
        both = new if state is None else new.unionByName(state)
        after = cut_lineage(both.groupBy("split", "user_id").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")))
        one_class = (F.coalesce("pos", F.lit(0)) == 0) | (F.col("pos") == F.col("n"))
        out = after.groupBy("split").agg(
            F.count(F.lit(1)).alias("n_users"), F.sum("n").alias("n_rows"), F.avg("n").alias("rows_per_user"),
            F.avg((F.col("n") == 1).cast("double")).alias("single_share"), F.avg(one_class.cast("double")).alias("one_class_share"),
        )
        return out, after

    return stateful_table(stream, folder or new_folder(stream.sparkSession, "stream-users"), step).withColumnRenamed("_b", "batch_id")


def enrich_author(stream: DataFrame, dim: DataFrame) -> DataFrame:
    return with_author(stream, dim)


def cost_counters(stream: DataFrame, by: list[str] = []) -> DataFrame:
    return stream.groupBy(*by).agg(
        F.sum("tokens_in").alias("tokens_in"), F.sum("tokens_out").alias("tokens_out"), (F.sum("wall_seconds") / 3600.0).alias("compute_hours")
    )


def first_findings(stream: DataFrame, ts: str = "ts", delay: str = "3650 days") -> DataFrame:
    """First record of each key while its watermark holds."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["key"])


def run_to_table(out: DataFrame, mode: str, keys: list[str] | None = None) -> DataFrame:
    """Run a streaming query over what is available and return its result as a table.

    Append results go straight to files. Update results are written per micro-batch and the latest row per
    key is read back. All folders lie in the shared checkpoint folder."""
    spark: SparkSession = out.sparkSession
    data, state = new_folder(spark, "stream-out"), new_folder(spark, "stream-state")
    writer = out.writeStream.outputMode(mode).option("checkpointLocation", state).trigger(availableNow=True)
    if mode == "append":
        query = writer.format("parquet").option("path", data).start()
    else:

        def save(batch: DataFrame, batch_id: int) -> None:
            batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite").parquet(f"{data}/_b={batch_id}")

        query = writer.foreachBatch(save).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    if mode == "append":
        return spark.read.schema(out.schema).parquet(data)
    table = spark.read.parquet(data).drop("_b")
    cols = [c for c in out.columns if c not in (keys or [])]
    latest = F.max_by(F.struct(*cols), "_batch").alias("_r")
    if keys:
        return table.groupBy(*keys).agg(latest).select(*keys, "_r.*")
    return table.agg(latest).select("_r.*")

"""Readers of ledgers, findings, learning curves and text logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankspark.functions.scalars import config_map

# ---- fixed values: log line patterns and metric names ----
EPOCH_LINE = r"valid GAUC\s+([0-9.]+)\s+nDCG@5\s+([0-9.]+)\s+primary\s+([0-9.]+)"
WALL_MARK = r"\b(?:DONE|STOP)\b.*\bwall=([0-9]*\.?[0-9]+)h"
KNOWN_METRICS = ["GAUC", "nDCG@5", "primary"]
# -----------------------------------------------------------

LEDGER_SCHEMA = (
    "node_id string, parent_id string, stage string, arm string, hypothesis string, diff string, "
    "metrics map<string,string>, is_buggy boolean, recovery string, error string, tokens_in long, tokens_out long, "
    "gpu_seconds double, extra string"
)

COST_SCHEMA = "tokens_in long, tokens_out long, wall_seconds double, gpu_seconds double"
FINDING_SCHEMA = "key string, tag string, run string, text string, fingerprint string, patch string, scale string"


def read_jsonl_lenient(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines; blank and corrupt lines are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def _line_order():
    """Order of lines inside a file: a later block starts at a higher byte, and a task reads fewer lines than
    a block has bytes, so block start plus line index never crosses into the next block."""
    return F.col("_metadata.file_block_start") + F.monotonically_increasing_id() % F.lit(1 << 33)


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """Ledger nodes with the three ranking metrics, the other numeric metrics as a map, and `extra` as VARIANT."""
    raw = spark.read.schema(LEDGER_SCHEMA).json(path).where(F.col("node_id").isNotNull())
    known = F.array(*[F.lit(k) for k in KNOWN_METRICS])
    numeric = F.transform_values(
        F.map_filter("metrics", lambda k, v: ~F.array_contains(known, k) & v.try_cast("double").isNotNull()),
        lambda k, v: v.cast("double"),
    )

    def metric(name: str):
        return F.try_element_at("metrics", F.lit(name)).try_cast("double")

    return raw.select(
        F.col("_metadata.file_path").alias("run_id"),
        _line_order().alias("seq"),
        "node_id", "parent_id", "stage", "arm", "hypothesis", "diff", "is_buggy", "recovery", "error", "tokens_in", "tokens_out",
        F.col("gpu_seconds").alias("elapsed_seconds"),
        metric("GAUC").alias("gauc"),
        metric("nDCG@5").alias("ndcg5"),
        metric("primary").alias("primary"),
        numeric.alias("extra_metrics"),
        F.try_parse_json(F.coalesce("extra", F.lit("{}"))).alias("extra"),
    )


def ledger_view(nodes: DataFrame) -> DataFrame:
    """The typed columns the ledger operators read, taken from `extra`."""

    def get(name: str, kind: str):
        return F.try_variant_get("extra", f"$.{name}", kind)

    flags = ["confirmed", "partial", "weak_incumbent", "screen_pass", "blend_rejected", "crossover"]
    numbers = [
        "confirmed_mean", "delta_primary", "delta_gauc", "delta_ndcg", "se_val_delta", "ci95_lo", "ci95_hi", "expected_delta",
        "delta_front", "delta_back", "temporal_disagree", "blend_alpha", "blend_gamma", "blend_bag_primary", "submit_bag_primary",
        "member_mean",
    ]
    full = F.coalesce(F.try_variant_get("extra", "$.full_config", "variant"), F.try_variant_get("extra", "$.config_patch", "variant"))
    return nodes.select(
        "*",
        ((F.coalesce("diff", F.lit("")) == "skip") | (F.coalesce(get("action", "string"), F.lit("")) == "skip")).alias("is_skip"),
        *[F.coalesce(get(f, "boolean"), F.lit(False)).alias(f) for f in flags],
        *[get(n, "double").alias(n) for n in numbers],
        get("top1_agree_vs_inc", "double").alias("top1_agree"),
        get("seed", "int").alias("seed"),
        get("config_idx", "int").alias("config_idx"),
        get("source_hash", "string").alias("source_hash"),
        get("ensemble_kind", "string").alias("ensemble_kind"),
        get("crossover_delta", "string").alias("crossover_delta"),
        F.coalesce(get("exec_status", "string"), F.when(F.col("error") == "timeout", "timeout")).alias("exec_status"),
        F.try_variant_get("extra", "$.members", "array<string>").alias("members"),
        config_map(full).alias("config"),
        F.col("elapsed_seconds").alias("wall_seconds"),
    )


def read_curves(spark: SparkSession, path: str) -> DataFrame:
    """Learning curves, one row per epoch; rows without a readable primary are skipped. The trial is the
    folder the file lies in."""
    raw = spark.read.option("header", True).csv(path)
    trial = F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)

    def num(name: str, default: float | None = None):
        value = F.col(f"`{name}`").try_cast("double") if name in raw.columns else F.lit(None).cast("double")
        return value if default is None else F.coalesce(value, F.lit(default))

    return raw.select(
        trial.alias("trial_id"),
        F.col("epoch").try_cast("int").alias("epoch"),
        num("loss").alias("loss"),
        num("primary").alias("primary"),
        num("GAUC", 0.0).alias("gauc"),
        num("nDCG@5", 0.0).alias("ndcg5"),
        num("sec").alias("sec"),
    ).where(F.col("primary").isNotNull())


def parse_training_log(lines: DataFrame) -> DataFrame:
    """Epoch metrics from text lines (`value` plus any key columns)."""
    keys = [c for c in lines.columns if c != "value"]

    def part(i: int):
        return F.regexp_extract("value", EPOCH_LINE, i).try_cast("double")

    return lines.where(F.col("value").rlike(EPOCH_LINE)).select(
        *keys, part(1).alias("gauc"), part(2).alias("ndcg5"), part(3).alias("primary")
    )


def parse_progress(lines: DataFrame) -> DataFrame:
    """START / DONE / SKIP / STOP lines of a progress log as columns."""
    keys = [c for c in lines.columns if c != "value"]
    line = F.col("value")

    def take(pattern: str):
        return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))

    kind = take(r"^\d\d:\d\d:\d\d (?:\[\d+/\d+\] )?(START|DONE|SKIP|STOP)\b")
    trial = F.when(kind == "START", take(r" START \S+ (\S+)")).otherwise(take(r" (?:DONE|SKIP) (\S+)"))
    return lines.select(
        *keys,
        take(r"^(\d\d:\d\d:\d\d) ").alias("ts"),
        kind.alias("kind"),
        F.coalesce(take(r"\[(\d+)/\d+\]"), take(r"billed=(\d+)/")).cast("int").alias("billed"),
        F.coalesce(take(r"\[\d+/(\d+)\]"), take(r"billed=\d+/(\d+)")).cast("int").alias("cap"),
        trial.alias("trial"),
        F.coalesce(take(r" DONE \S+ (\S+)/\S+ "), take(r" START (\S+) ")).alias("stage"),
        F.coalesce(take(r" DONE \S+ [^/ ]+/(\S+) "), take(r" arm=(\S+)")).alias("arm"),
        take(r" parent=(\S+)").alias("parent"),
        take(r" primary=(\S+)").try_cast("double").alias("primary"),
        take(r" dP=(\S+)").try_cast("double").alias("delta_primary"),
        take(r" reason=(.*?)(?: billed=.*)?$").alias("reason"),
        take(r" streak=(\d+)").cast("int").alias("streak"),
        take(r" wall=([0-9.]+)h").try_cast("double").alias("wall_hours"),
    ).where(F.col("kind").isNotNull())


def best_epoch(curves: DataFrame, log: DataFrame) -> DataFrame:
    """Best epoch per trial: from the curve if it has one, else from the training log."""

    def best(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy("trial_id").agg(F.max_by(F.struct("primary", "gauc", "ndcg5"), "primary").alias(name))

    both = best(curves, "_c").join(best(log, "_l"), "trial_id", "full_outer")
    source = F.when(F.col("_c").isNotNull(), "curve").otherwise("log")
    return both.select("trial_id", F.coalesce("_c", "_l").alias("_b"), source.alias("source")).select("trial_id", "_b.*", "source")


def wall_high_water(lines: DataFrame, persisted: DataFrame | None = None) -> DataFrame:
    """Largest wall-clock seconds per run over the log lines and the persisted value; never below 0."""
    hours = F.regexp_extract("value", WALL_MARK, 1).try_cast("double")
    seen = lines.select("run_id", (F.coalesce(hours, F.lit(0.0)) * 3600.0).alias("s"))
    if persisted is not None:
        seen = seen.unionByName(persisted.select("run_id", F.coalesce("agent_wall_seconds", F.lit(0.0)).alias("s")))
    return seen.groupBy("run_id").agg(F.greatest(F.max("s"), F.lit(0.0)).alias("wall_seconds"))

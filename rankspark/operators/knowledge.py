"""Error memory, findings, graveyard, claim cards, patch validation and the dataset catalogue."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.operators import ledger as L
from rankspark.operators.ledger import RUN, SCALES, yes
from rankspark.session import cut_lineage

# ---- fixed values: published size of each dataset scale ----
PUBLISHED = [
    ("pure", 1436609, 27285, 7551),
    ("1k", 11713045, 1000, 4369953),
    ("27k", 322278385, 27285, 32038725),
]

# Legal patch keys per arm.
ARM_KEYS = {
    "optimizer": ["lr", "batch", "epochs", "patience"],
    "regularization": ["l2"],
    "loss": ["loss", "bpr_pairs_cap", "listwise_gain", "bpr_decay_sample"],
    "capacity": ["k"],
    "time_shift": ["use_hour"],
    "sequence": ["seq_len", "seq_mode"],
    "multitask": ["aux_click", "aux_click_weight"],
    "watch_time": ["cwm_censor", "cwm_weight", "cwm_head", "wlr_play"],
    "architecture": [
        "arch",
        "model_family",
        "gbm_leaves",
        "gbm_rounds",
        "gbm_min_data",
        "gbm_feat_frac",
        "gbm_bag_frac",
        "gbm_lr",
        "gbm_cat",
        "data_scale",
        "torch_device",
    ],
    "features": ["use_itemcf", "use_beh_cross", "use_beh_rank", "use_time_decay"],
}
OPEN_ARMS = ["draft", "ablate"]
EXTRA_KEYS = ["seed"]
PROTOCOL_KEYS = ["train_tail_stop"]
BOOL_KEYS = [
    "use_hour",
    "aux_click",
    "cwm_censor",
    "use_itemcf",
    "use_beh_cross",
    "use_beh_rank",
    "use_time_decay",
    "wlr_play",
    "bpr_decay_sample",
    "train_tail_stop",
]
FLOAT_KEYS = ["lr", "l2", "gbm_feat_frac", "gbm_bag_frac", "gbm_lr", "aux_click_weight", "cwm_weight"]
INT_KEYS = ["k", "epochs", "batch", "patience", "seed", "bpr_pairs_cap", "gbm_leaves", "gbm_rounds", "gbm_min_data"]
ENUM_KEYS = {
    "loss": ["logloss", "bpr", "bpr_global", "listwise"],
    "listwise_gain": ["uniform", "ndcg"],
    "seq_mode": ["none", "pool", "din"],
    "seq_len": ["0", "10", "20", "50", "100"],
    "cwm_head": ["shared", "independent"],
    "arch": ["fm", "deepfm", "dcnv2"],
    "model_family": ["fm", "gbm", "torch"],
    "gbm_cat": ["none", "lowcard", "all"],
    "data_scale": ["pure", "1k", "27k"],
    "torch_device": ["auto", "cpu", "cuda"],
}
# A patch that sets the model family may not tune the boosted trees as well.
FAMILY_EXCLUDES = ["gbm_leaves", "gbm_rounds", "gbm_min_data", "gbm_feat_frac", "gbm_bag_frac", "gbm_lr", "gbm_cat"]
# ------------------------------------------------------------


# ---- patch validation ------------------------------------------------------------------


def legal_keys(spark) -> DataFrame:
    """The rules as a table (arm, key, type, values); `*` stands for arms without their own list."""
    every = sorted({k for keys in ARM_KEYS.values() for k in keys} | set(EXTRA_KEYS) | set(PROTOCOL_KEYS))
    rows = []
    arms = {**ARM_KEYS, **{a: every for a in OPEN_ARMS}, "ensemble": [], "*": every}
    for arm, keys in arms.items():
        for key in dict.fromkeys([*keys, *PROTOCOL_KEYS]):
            kind = "bool" if key in BOOL_KEYS else "float" if key in FLOAT_KEYS else "int" if key in INT_KEYS else "enum"
            rows.append((arm, key, kind, ENUM_KEYS.get(key, [])))
    return spark.createDataFrame(rows, "arm string, key string, kind string, allowed array<string>")


def validate_patches(patches: DataFrame) -> DataFrame:
    """Keep the legal keys of each proposed patch (patch_id, arm, patch) with typed values; drop the rest.

    Values are JSON scalars as text. The rule table is a few hundred fixed rows."""
    rules = legal_keys(patches.sparkSession)
    known = F.array(*[F.lit(a) for a in [*ARM_KEYS, *OPEN_ARMS, "ensemble"]])
    rule_arm = F.when(F.array_contains(known, F.col("arm")), F.col("arm")).otherwise("*")
    family = F.array_contains(F.map_keys("patch"), "model_family")
    items = patches.select(
        "patch_id", "arm", rule_arm.alias("_arm"), F.explode("patch").alias("key", "raw"),
    )
    joined = items.join(
        F.broadcast(rules.withColumnRenamed("arm", "_arm")), ["_arm", "key"]
    )
    bare = F.regexp_replace("raw", '^"|"$', "")
    quoted = F.col("raw").startswith('"')
    value = (
        F.when(
            F.col("kind") == "bool",
            F.when(F.col("raw").isin("true", "1", "1.0"), "true").when(F.col("raw").isin("false", "0", "0.0"), "false"),
        )
        .when(F.col("kind") == "float", bare.try_cast("double").cast("string"))
        .when(F.col("kind") == "int", bare.try_cast("double").try_cast("long").cast("string"))
        .otherwise(F.when(F.array_contains("allowed", bare), F.when(quoted, F.col("raw")).otherwise(bare)))
    )
    typed = joined.withColumn("value", value).where(F.col("value").isNotNull())
    has_family = typed.where(F.col("key") == "model_family").select("patch_id").distinct().withColumn("_fam", F.lit(True))
    drop = F.array(*[F.lit(k) for k in FAMILY_EXCLUDES])
    kept = typed.join(has_family, "patch_id", "left").where(~(yes("_fam") & F.array_contains(drop, F.col("key"))))
    clean = kept.groupBy("patch_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("clean"))
    return patches.select("patch_id", "arm").join(clean, "patch_id", "left").withColumn(
        "clean", F.coalesce("clean", F.create_map().cast("map<string,string>"))
    )


# ---- error memory ----------------------------------------------------------------------

RARE_TOKENS = 3  # of each query's tokens; they only set the first bound


def similar_errors(queries: DataFrame, cases: DataFrame, k: int = 3) -> DataFrame:
    """Top-k past cases per query by number of shared tokens of the whole texts, solved cases only.

    A query's n tokens that occur at all are ordered from rare to frequent. Cases holding one of the first few give a
    k-th best overlap t; a case with overlap t or more must then hold one of the first n - t + 1, so only those tokens
    are looked up, and the overlaps of what they find are counted on the full token sets. Frequent tokens
    are looked up only where nothing rarer decides."""
    text = F.concat_ws(" ", E.normalize_signature("message"), F.col("message"))
    sets = cut_lineage(cases.where(yes("success")).select("trial_id", E.token_set(text).alias("held")))
    index = cut_lineage(sets.select("trial_id", F.explode("held").alias("token")))
    found = index.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    asked = queries.select("query_id", E.token_set("signature").alias("asked"))
    tokens = asked.select("query_id", F.explode("asked").alias("token")).join(found, "token")
    place = Window.partitionBy("query_id")  # the tokens of one query
    tokens = cut_lineage(tokens.select(
        "query_id", "token", F.row_number().over(place.orderBy("df", "token")).alias("rank"), F.count(F.lit(1)).over(place).alias("n"),
    ))

    def overlaps(looked: DataFrame) -> DataFrame:
        pairs = looked.select("query_id", "token").join(index, "token").select("query_id", "trial_id").distinct()
        both = pairs.join(asked, "query_id").join(sets, "trial_id")
        return both.select("query_id", "trial_id", F.size(F.array_intersect("asked", "held")).cast("long").alias("overlap"))

    def top(df: DataFrame) -> DataFrame:
        best = Window.partitionBy("query_id").orderBy(F.col("overlap").desc(), "trial_id")
        return df.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k)

    bound = top(overlaps(tokens.where(F.col("rank") <= RARE_TOKENS))).where(F.col("place") == k).select("query_id", F.col("overlap").alias("t"))
    needed = tokens.join(cut_lineage(bound), "query_id", "left").where(F.col("rank") <= F.col("n") - F.coalesce("t", F.lit(1)) + 1)
    return top(overlaps(needed))


# ---- findings --------------------------------------------------------------------------


SPLITTER = 134217729.0  # 2 ** 27 + 1 cuts a double into two halves of at most 26 bits


def _num(c: str) -> Column:
    """Five decimals of the value the double really holds, as C and Python print them. Java's formatter rounds the shortest decimal form half up, so that
    0.260055 (in truth a little less) would become 0.26006."""
    x, value = F.col(c), F.abs(F.col(c))
    scaled = value * F.lit(1e5)
    high = value * F.lit(SPLITTER) - (value * F.lit(SPLITTER) - value)
    error = (high * F.lit(1e5) - scaled) + (value - high) * F.lit(1e5)  # exact: what the product lost
    units = F.floor(scaled)
    rest = scaled - units
    odd = units % 2 == 1
    up = (rest > 0.5) | ((rest == 0.5) & ((error > 0) | ((error == 0) & odd)))
    whole = units + up.cast("long")
    digits = F.concat(F.floor(whole / F.lit(100000)).cast("string"), F.lit("."), F.lpad((whole % 100000).cast("string"), 5, "0"))
    sign = F.when(x.cast("string").startswith("-"), "-").otherwise("")
    # Beyond 1e10, past any metric, and for infinities the units no longer fit.
    return F.when(x.isNull(), "na").when(value < 1e10, F.concat(sign, digits)).otherwise(F.format_string("%.5f", x))


def findings(ledger: DataFrame) -> DataFrame:
    """Finding records of every run: incumbent, confirmed nodes, falsified patches, calibration."""
    inc = L.incumbent(ledger)
    three = F.col("is_bag") | F.col("confirmed_mean").isNotNull()
    none = F.lit(None).cast("string")

    def record(df: DataFrame, key: Column, tag: Column, text: Column, fp: Column = none, scale: Column = none) -> DataFrame:
        return df.select(
            key.alias("key"), tag.alias("tag"), F.col(RUN).alias("run_id"), text.alias("text"), fp.alias("fingerprint"), scale.alias("scale")
        )

    node = F.col("node_id").cast("string")
    seeds = F.when(three, "measured-3seed").otherwise("measured-1seed")
    first = record(
        inc.where(F.col("submit_primary").isNotNull()),
        F.concat_ws(":", F.lit("incumbent"), node, _num("submit_primary")),
        seeds,
        F.concat(node, F.lit(" submit="), _num("submit_primary"), F.lit(" seed0="), _num("seed0_primary")),
    )
    rows = L.with_identity(ledger)
    done = rows.where(L.is_good() & yes("confirmed"))
    done_tag = F.when(F.col("confirmed_mean").isNotNull() | L.has_members(), "measured-3seed").otherwise("measured-1seed")
    confirmed = record(
        done,
        F.concat_ws(":", F.lit("confirmed"), F.col("fp")),
        done_tag,
        F.concat(node, F.lit(" mean="), _num("confirmed_mean")),
        F.col("fp"),
    )
    dead = rows.where(
        (F.col("arm") != "ablate") & F.col("stage").isin("improve", "draft") & ~F.col("is_skip")
        & ~((F.col("stage") == "draft") & yes("confirmed")) & L.is_falsified() & (F.col("fp") != "")
    )
    one = dead.groupBy(RUN, "fp").agg(F.min_by(F.struct("node_id", "parent_id", "delta_primary", "ci95_hi", "config"), "seq").alias("_f"))
    one = one.select(RUN, "fp", "_f.*")
    scale = F.coalesce(F.regexp_replace(F.try_element_at("config", F.lit("data_scale")), '"', ""), F.lit("pure"))
    parent = F.coalesce(F.col("parent_id").cast("string"), F.lit("root"))
    falsified = record(
        one,
        F.concat_ws(":", F.lit("falsified"), scale, parent, F.col("fp")),
        F.lit("measured-1seed"),
        F.concat(node, F.lit(" delta="), _num("delta_primary"), F.lit(" ci_hi="), _num("ci95_hi")),
        F.col("fp"),
        scale,
    )
    cal = L.calibration(ledger)
    line = F.concat(
        F.col("within").cast("string"), F.lit("/"), F.col("n").cast("string"), F.lit(" within, bias="), _num("mean_bias"), F.lit(" "), F.col("tag")
    )
    calibrated = record(cal, F.concat(F.lit("calibration:"), line), F.lit("diagnosis"), line)
    return reduce(lambda a, b: a.unionByName(b), [first, confirmed, falsified, calibrated])


def merge_findings(old: DataFrame, new: DataFrame) -> DataFrame:
    """Keep the first record of each key, old before new; the text stands in for a missing key. Both inputs
    carry `pos`, their position."""
    both = old.withColumn("_o", F.lit(0)).unionByName(new.withColumn("_o", F.lit(1)))
    key = F.coalesce(F.when(F.col("key") != "", F.col("key")), F.col("text"))
    cols = [c for c in both.columns if c not in ("_o", "pos")]
    first = F.min_by(F.struct(*cols), F.struct("_o", "pos"))
    return both.withColumn("_k", key).where(F.coalesce(F.col("_k"), F.lit("")) != "").groupBy("_k").agg(first.alias("_r")).select("_r.*")


def graveyard(records: DataFrame) -> DataFrame:
    """Falsified fingerprints per scale: from the key, whose identity may be spelled key=value or as a list of pairs, from the
    stored fingerprint, and from the patch, given as JSON or written in the text, in raw and canonical form. Records
    without a known scale count as pure; the empty (default) identity is never a grave."""
    none = F.lit(None).cast("string")
    col = {c: F.col(c) if c in records.columns else none for c in ("patch", "text", "fingerprint", "scale")}
    from_key = F.regexp_extract("key", r"^falsified:(pure|1k|27k):", 1)
    scale = F.lower(F.trim(F.coalesce(F.when(col["scale"] != "", col["scale"]), from_key)))
    scale = F.when(scale.isin(SCALES), scale).otherwise("pure")
    body = F.regexp_extract("key", r"^falsified:(?:(?:pure|1k|27k):)?(?:[^:=\[]*:)?([^:\[]*=.*|\[.*)$", 1)

    def spelled(text: Column) -> Column:
        return F.when(text.startswith("["), E.fingerprint(E.pairs_map(text))).otherwise(text)

    patch = F.coalesce(E.config_map(F.try_parse_json(col["patch"])), E.literal_patch(col["text"]))
    fps = F.array(spelled(body), spelled(col["fingerprint"]), E.raw_fingerprint(patch), E.fingerprint(patch))
    rows = records.where(F.col("tag") == "measured-1seed").select(scale.alias("scale"), F.explode(F.array_compact(fps)).alias("fingerprint"))
    return rows.where(F.col("fingerprint") != "").distinct()


def claim_cards(ledger: DataFrame) -> DataFrame:
    """One card per (parent, patch): falsified, confirmed, or a complementary blend, with its evidence."""
    rows = L.with_identity(ledger).where(~F.col("is_skip") & (F.size("config") > 0))
    first = rows.groupBy(RUN, "parent_id", "fp").agg(
        F.min_by(F.struct("node_id", "ci95_hi", "delta_primary", "confirmed", "confirmed_mean"), "seq").alias("_f")
    ).select(RUN, "parent_id", F.col("fp").alias("claim"), "_f.*")
    status = F.when(L.is_falsified(), "falsified-1seed").when(
        yes("confirmed") & F.col("confirmed_mean").isNotNull(), "confirmed-3seed"
    )
    value = F.when(F.col("status") == "falsified-1seed", F.col("delta_primary")).otherwise(F.col("confirmed_mean"))
    cards = first.withColumn("status", status).where(F.col("status").isNotNull()).select(
        RUN, "claim", "status", F.coalesce(F.col("parent_id").cast("string"), F.lit("root")).alias("scope"),
        F.col("node_id").alias("evidence"), value.alias("value"),
    )
    blends = ledger.where(
        (F.col("stage") == "ensemble") & (F.col("ensemble_kind") == "complementary") & F.col("blend_alpha").isNotNull()
    ).select(
        RUN, F.lit("complementary-blend").alias("claim"), F.lit("measured-1seed").alias("status"), F.lit("run").alias("scope"),
        F.col("node_id").alias("evidence"), F.col("blend_alpha").alias("value"),
    )
    return cards.unionByName(blends)


def dataset_catalog(impressions: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """Actual rows, users and items per scale next to the published counts; log bytes when file sizes
    (scale, path, bytes) are given."""
    spark = impressions.sparkSession
    seen = impressions.groupBy("scale").agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("video_id").alias("items")
    )
    published = spark.createDataFrame(PUBLISHED, "scale string, published_rows long, published_users long, published_items long")
    out = published.join(seen, "scale", "left")
    if files is not None:
        size = files.dropDuplicates(["scale", "path"]).groupBy("scale").agg(F.sum("bytes").alias("log_bytes"))
        out = out.join(size, "scale", "left")
    return out.withColumn("present", F.col("n_rows").isNotNull())


def log_files(df: DataFrame) -> DataFrame:
    """Path and size of the files behind a file-based table."""
    return df.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("bytes")).distinct()

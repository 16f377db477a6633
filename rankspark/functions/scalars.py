"""Scalar expressions: lenient coercions, labels, rates, signatures, configs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values -------------------------------------------------------------------
RATE_PRIOR = 20.0
RATE_MIN_COUNT = 5.0
EMPTY_RATE = 0.5
UNKNOWN_AUTHOR = "UNK"

IGNORED_KEYS = [
    "seed",
    "smoke",
    "max_train_rows",
    "finalize",
    "eval_split",
    "infer_split",
    "budget_epochs",
    "budget_patience",
    "eval_every",
    "eval_user_frac",
]

# Config values are JSON scalars as text: strings keep their quotes, whole numbers have no fraction.
CONFIG_DEFAULTS = {
    "loss": '"logloss"',
    "seq_mode": '"none"',
    "seq_len": "0",
    "use_hour": "false",
    "use_itemcf": "false",
    "use_beh_cross": "false",
    "use_beh_rank": "false",
    "use_time_decay": "false",
    "wlr_play": "false",
    "bpr_decay_sample": "false",
    "aux_click": "false",
    "cwm_censor": "false",
    "cwm_head": '"independent"',
    "arch": '"fm"',
    "listwise_gain": '"uniform"',
    "model_family": '"fm"',
    "gbm_leaves": "31",
    "gbm_rounds": "80",
    "gbm_min_data": "20",
    "gbm_feat_frac": "1",
    "gbm_bag_frac": "1",
    "gbm_lr": "0.05",
    "gbm_cat": '"lowcard"',
    "data_scale": '"pure"',
    "torch_device": '"auto"',
    "k": "16",
    "lr": "0.001",
    "l2": "1.0E-6",
    "epochs": "40",
    "batch": "8192",
    "patience": "4",
    "bpr_pairs_cap": "32",
    "train_tail_stop": "false",
}

LEAKY_FLAGS = [
    "use_time_decay",
    "wlr_play",
    "use_beh_rank",
    "use_beh_cross",
    "use_itemcf",
    "bpr_decay_sample",
    "aux_click",
]

# Keys a merge keeps from the incumbent.
PROTECTED_KEYS = [
    "model_family",
    "arch",
    "loss",
    "listwise_gain",
    "k",
    "lr",
    "l2",
    "seed",
    "data_scale",
    "torch_device",
]

CORE_KEYS = [
    "use_time_decay",
    "bpr_decay_sample",
    "wlr_play",
    "use_beh_rank",
    "use_beh_cross",
    "use_hour",
    "model_family",
    "seq_len",
    "arch",
]
# ---- end of fixed values ------------------------------------------------------------


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform(key, seed) -> Column:
    """Reproducible draw in [0,1): the first 32 bits of md5(key|seed)."""
    text = F.concat(_col(key).cast("string"), F.lit("|"), F.lit(seed).cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def flag01(c) -> Column:
    return F.when(F.trim(F.coalesce(_col(c).cast("string"), F.lit(""))).isin("", "0", "0.0"), 0).otherwise(1)


def fnum(c, default: float = 0.0) -> Column:
    return F.coalesce(F.trim(_col(c).cast("string")).try_cast("double"), F.lit(float(default)))


def observed_label(c) -> Column:
    """0/1 for an observed label, NULL for a missing one (blank, unreadable or negative)."""
    value = _col(c).cast("string").try_cast("int")
    return F.when(value < 0, F.lit(None)).otherwise((value == 1).cast("int"))


def day_ordinal(c) -> Column:
    """Days since 1970-01-01 of a yyyymmdd integer."""
    return F.datediff(F.to_date(_col(c).cast("string"), "yyyyMMdd"), F.to_date(F.lit("1970-01-01")))


def hour_of(c) -> Column:
    return F.floor(fnum(c) / 100).cast("int")


def smooth(pos, cnt, p, prior: float = RATE_PRIOR) -> Column:
    return (_col(pos) + prior * _col(p)) / (_col(cnt) + prior)


def beta_rate(pos, tot, alpha: float = 0.5) -> Column:
    return (_col(pos) + alpha) / (_col(tot) + 2.0 * alpha)


def loo_rate(cnt, pos, p, y=None, min_count: float = RATE_MIN_COUNT) -> Column:
    """Shrunk rate; the global rate for sparse keys, judged on the count before leaving a row out."""
    cnt, pos, p = F.coalesce(_col(cnt), F.lit(0.0)), F.coalesce(_col(pos), F.lit(0.0)), _col(p)
    if y is None:
        left_cnt, left_pos = cnt, pos
    else:
        left_cnt, left_pos = cnt - 1.0, pos - _col(y)
    shrunk = smooth(F.greatest(left_pos, F.lit(0.0)), F.greatest(left_cnt, F.lit(1.0)), p)
    return F.when((cnt < min_count) | (left_cnt <= 0), p).otherwise(shrunk)


def log1p_score(c) -> Column:
    return F.log1p(F.greatest(_col(c), F.lit(0.0)))


def watch_targets(play="play_time_ms", dur="duration_ms") -> list[Column]:
    play, dur = _col(play), F.greatest(_col(dur), F.lit(1.0))
    return [
        F.log(F.greatest(play, F.lit(0.0)) + 1.0).alias("y_log"),
        F.log(dur + 1.0).alias("c_log"),
        (play >= 0.95 * dur).alias("censored"),
    ]


def normalize_signature(c) -> Column:
    compact = F.trim(F.regexp_replace(F.lower(_col(c)), r"\s+", " "))
    compact = F.regexp_replace(compact, r"0x[0-9a-f]+", "0xADDR")
    compact = F.regexp_replace(compact, r"\d+", "N")
    return F.substring(compact, 1, 400)


def token_set(c) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(_col(c)), F.lit(r"[a-z_]{3,}"), 0))


# ---- configs (MAP<STRING,STRING> of JSON scalars) -----------------------------------


def json_scalar(text: Column) -> Column:
    """One spelling per number, so that 16, 16.0 and 1.6e1 compare equal."""
    number = text.try_cast("double")
    whole = (number == F.floor(number)) & (F.abs(number) < 1e15)
    return F.when(number.isNull(), text).when(whole, number.cast("long").cast("string")).otherwise(number.cast("string"))


def config_map(variant) -> Column:
    """MAP of JSON scalars from a JSON object held as VARIANT; NULL values are dropped."""
    return _scalar_values(F.try_variant_get(_col(variant), "$", "map<string,variant>"))


def _scalar_values(items: Column) -> Column:
    texts = F.transform_values(items, lambda k, v: json_scalar(F.to_json(v)))
    return F.map_filter(texts, lambda k, v: v.isNotNull() & (v != "null"))


def pairs_map(text) -> Column:
    """A config from its list form, a JSON array of [key, value] pairs; NULL when the text is none."""
    pairs = F.try_variant_get(F.try_parse_json(_col(text)), "$", "array<array<variant>>")
    keyed = F.transform(
        F.filter(pairs, lambda p: F.size(p) == 2), lambda p: F.struct(F.try_variant_get(F.get(p, F.lit(0)), "$", "string").alias("key"), F.get(p, F.lit(1)).alias("value"))
    )
    return _scalar_values(F.map_from_entries(F.filter(keyed, lambda e: e["key"].isNotNull())))


LITERAL_DICT = r"\{[^{}]+\}"  # fixed value: what counts as a written dictionary


def literal_patch(text) -> Column:
    """The first flat dictionary written in a text, in the spelling of JSON or else of Python; NULL when there is none. In Python's spelling strings in single quotes
    get double ones, with inner double quotes escaped, and words are changed outside of strings only."""
    found = F.regexp_extract(_col(text), LITERAL_DICT, 0)
    # Strings keep their place in the text: a piece is a string or what lies between two of them.
    pieces = F.regexp_extract_all(found, F.lit(r"""("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|[^"']+|["'])"""), F.lit(1))

    def quoted(p: Column) -> Column:
        inner = F.replace(F.replace(p.substr(F.lit(2), F.length(p) - 2), F.lit("\\'"), F.lit("'")), F.lit('"'), F.lit('\\"'))
        return F.concat(F.lit('"'), inner, F.lit('"'))

    def plain(p: Column) -> Column:
        for pattern, into in ((r"\bTrue\b", "true"), (r"\bFalse\b", "false"), (r"\bNone\b", "null")):
            p = F.regexp_replace(p, pattern, into)
        return p

    def piece(p: Column) -> Column:
        return F.when(p.startswith('"'), p).when(p.startswith("'") & (F.length(p) > 1), quoted(p)).otherwise(plain(p))

    python = F.array_join(F.transform(pieces, piece), "")
    return config_map(F.coalesce(F.try_parse_json(found), F.try_parse_json(python)))


def raw_fingerprint(c) -> Column:
    """Like fingerprint, but with keys at their default kept; only the seed is left out."""
    kept = F.map_filter(_col(c), lambda k, v: k != "seed")
    return F.array_join(F.array_sort(F.transform(F.map_entries(kept), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")


def defaults_map() -> Column:
    pairs = [F.lit(x) for kv in CONFIG_DEFAULTS.items() for x in kv]
    return F.create_map(*pairs)


def _keys(names: list[str]) -> Column:
    return F.array(*[F.lit(n) for n in names])


def canonical_patch(c) -> Column:
    """Drop run-only keys and keys equal to their default."""
    base = defaults_map()
    return F.map_filter(
        _col(c),
        lambda k, v: ~F.array_contains(_keys(IGNORED_KEYS), k) & ~F.coalesce(base[k] == v, F.lit(False)),
    )


def fingerprint(c, source=None) -> Column:
    """Canonical text of a config: sorted key=value, optionally bound to a source hash."""
    parts = F.transform(F.map_entries(canonical_patch(c)), lambda e: F.concat_ws("=", e["key"], e["value"]))
    text = F.array_join(F.array_sort(parts), ";")
    if source is None:
        return text
    return F.concat(text, F.lit("|"), F.coalesce(_col(source), F.lit("")))


def extra_flag_count(c) -> Column:
    known = _keys([k for k in CONFIG_DEFAULTS if k not in IGNORED_KEYS])
    base = defaults_map()
    return F.size(F.map_filter(_col(c), lambda k, v: F.array_contains(known, k) & (base[k] != v)))


def leak_flags(c) -> Column:
    cfg = _col(c)
    return F.filter(_keys(LEAKY_FLAGS), lambda f: F.coalesce(F.try_element_at(cfg, f) == "true", F.lit(False)))


def leak_overlap(a, b) -> Column:
    return F.arrays_overlap(leak_flags(a), leak_flags(b))


def _without(c: Column, names: list[str]) -> Column:
    return F.map_filter(c, lambda k, v: ~F.array_contains(_keys(names), k))


def overlay(base, top) -> Column:
    """Keys of `top` win; built from entries so it does not rely on the session's duplicate-key policy."""
    base, top = _col(base), _col(top)
    kept = F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(top), k))
    return F.map_concat(kept, top)


def apply_identity(base, identity) -> Column:
    """Reset every identity key to its default, then set the confirmed identity's keys."""
    reset = _without(defaults_map(), IGNORED_KEYS)
    return overlay(overlay(base, reset), _without(_col(identity), IGNORED_KEYS))


def merge_delta(keep, other) -> Column:
    """Flags of `other` the incumbent does not have yet, protected keys left alone."""
    mine = canonical_patch(keep)
    return F.map_filter(
        canonical_patch(other),
        lambda k, v: ~F.array_contains(_keys(PROTECTED_KEYS), k) & ~F.coalesce(F.try_element_at(mine, k) == v, F.lit(False)),
    )


def is_core(c) -> Column:
    return F.arrays_overlap(F.map_keys(_col(c)), _keys(CORE_KEYS))

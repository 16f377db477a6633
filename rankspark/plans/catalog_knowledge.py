"""Expression, error-memory, finding, card and catalogue queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from rankspark.functions import scalars as E
from rankspark.operators import knowledge as N
from rankspark.operators import ledger as L
from rankspark.plans.catalog_ledger import BEST, GOOD
from rankspark.plans.views import IMP, LEDGER, tidy, u_sql
from rankspark.sources.mapped import error_cases, error_queries, impressions, ledger, raw_impressions, table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return add


# ---- expressions -------------------------------------------------------------------------


@query(
    "coerce_flags",
    """WITH t AS (SELECT event_id, CASE event_id % 6 WHEN 0 THEN '' WHEN 1 THEN ' 0 ' WHEN 2 THEN '0.0' WHEN 3 THEN '1' WHEN 4 THEN NULL ELSE event_type END AS raw FROM events)
    SELECT event_id, CAST(CASE WHEN trim(coalesce(raw, '')) IN ('', '0', '0.0') THEN 0 ELSE 1 END AS BIGINT) AS flag FROM t""",
)
def coerce_flags(spark, sf):
    ev = table(spark, sf, "events")
    m = F.col("event_id") % 6
    raw = F.when(m == 0, "").when(m == 1, " 0 ").when(m == 2, "0.0").when(m == 3, "1").when(m == 4, F.lit(None)).otherwise(F.col("event_type"))
    return tidy(ev.select("event_id", E.flag01(raw).alias("flag")))


@query(
    "coerce_numbers",
    """WITH t AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type WHEN 2 THEN NULL ELSE ' ' || CAST(event_id AS VARCHAR) || '.5' END AS raw FROM events)
    SELECT event_id, coalesce(try_cast(trim(raw) AS DOUBLE), 1.0) AS num FROM t""",
)
def coerce_numbers(spark, sf):
    ev = table(spark, sf, "events")
    m = F.col("event_id") % 4
    text = F.concat(F.lit(" "), F.col("event_id").cast("string"), F.lit(".5"))
    raw = F.when(m == 0, "").when(m == 1, F.col("event_type")).when(m == 2, F.lit(None)).otherwise(text)
    return ev.select("event_id", E.fnum(raw, 1.0).alias("num"))


@query(
    "observed_labels",
    """WITH t AS (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '-1' WHEN 1 THEN 'x' WHEN 2 THEN '1' WHEN 3 THEN '0' ELSE '3' END AS raw FROM events)
    SELECT event_id, CAST(CASE WHEN try_cast(raw AS INTEGER) < 0 THEN NULL ELSE CASE WHEN try_cast(raw AS INTEGER) = 1 THEN 1 WHEN try_cast(raw AS INTEGER) IS NOT NULL THEN 0 END END AS BIGINT) AS y FROM t""",
)
def observed_labels(spark, sf):
    ev = table(spark, sf, "events")
    raw = F.element_at(F.array(*[F.lit(x) for x in ("-1", "x", "1", "0", "3")]), (F.col("event_id") % 5 + 1).cast("int"))
    return tidy(ev.select("event_id", E.observed_label(raw).alias("y")))


@query(
    "calendar_parts",
    f"""WITH {IMP} SELECT row_id, CAST(day - DATE '1970-01-01' AS BIGINT) AS day_ord, CAST(hour AS BIGINT) AS hour FROM imp""",
)
def calendar_parts(spark, sf):
    imp = impressions(spark, sf)
    return tidy(imp.select("row_id", E.day_ordinal("date").alias("day_ord"), E.hour_of(F.col("hour") * 100 + 59).alias("hour")))


@query(
    "rate_formulas",
    f"""WITH {IMP}, c AS (SELECT user_id, count(*)::DOUBLE AS n, sum(long_view)::DOUBLE AS s FROM imp WHERE split = 'train' GROUP BY 1)
    SELECT user_id, round((s + 20 * 0.3) / (n + 20), 9) AS smoothed, round((s + 0.5) / (n + 1), 9) AS jeffreys, round(ln(1 + greatest(s - 20, 0)), 9) AS logged FROM c""",
)
def rate_formulas(spark, sf):
    train = impressions(spark, sf).where(F.col("split") == "train")
    c = train.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("long_view").cast("double").alias("s"))
    return tidy(
        c.select(
            "user_id", E.smooth("s", "n", F.lit(0.3)).alias("smoothed"), E.beta_rate("s", "n").alias("jeffreys"), E.log1p_score(F.col("s") - 20).alias("logged")
        )
    )


@query("uniform_draws", f"SELECT event_id, round({u_sql('event_id', 5)}, 9) AS u FROM events")
def uniform_draws(spark, sf):
    return tidy(table(spark, sf, "events").select("event_id", E.uniform("event_id", 5).alias("u")))


# Java and RE2 agree on these ASCII classes; the whole text of every document is normalised.
NORM = r"""substr(regexp_replace(regexp_replace(trim(regexp_replace(lower({c}), '\s+', ' ', 'g'), ' '), '0x[0-9a-f]+', '0xADDR', 'g'), '\d+', 'N', 'g'), 1, 400)"""


@query("normalize_signature", f"SELECT doc_id, md5({NORM.format(c='text')}) AS sig FROM documents")
def normalize_signature(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.md5(E.normalize_signature("text")).alias("sig"))


@query(
    "token_set",
    """SELECT doc_id, len(list_distinct(regexp_extract_all(lower(text), '[a-z_]{3,}'))) AS n_tokens,
    md5(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(text), '[a-z_]{3,}'))), ' ')) AS h FROM documents""",
)
def token_set(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", E.token_set("text").alias("t"))
    return d.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join(F.array_sort("t"), " ")).alias("h"))


@query("fingerprint", f"WITH {LEDGER} SELECT node_id, fp, fp || '|' || source_hash AS solution FROM ledger")
def fingerprint(spark, sf):
    return ledger(spark, sf).select("node_id", E.fingerprint("config").alias("fp"), L.solution_key().alias("solution"))


@query(
    "canonical_patch",
    f"""WITH {LEDGER} SELECT node_id, (k <> '16')::INT::BIGINT + (loss <> '"logloss"')::INT + (seq_len <> '0')::INT + (utd = 'true')::INT AS n_keys,
    CASE WHEN k <> '16' THEN k END AS k FROM ledger""",
)
def canonical_patch(spark, sf):
    c = E.canonical_patch("config")
    return ledger(spark, sf).select("node_id", F.size(c).cast("long").alias("n_keys"), F.try_element_at(c, F.lit("k")).alias("k"))


@query(
    "config_flags",
    f"""WITH {LEDGER} SELECT node_id, (k <> '16')::INT::BIGINT + (loss <> '"logloss"')::INT + (seq_len <> '0')::INT + (utd = 'true')::INT AS n_flags,
    CASE WHEN utd = 'true' THEN 'use_time_decay' ELSE '' END AS leaks, seq_len IS NOT NULL AS core FROM ledger""",
)
def config_flags(spark, sf):
    return tidy(
        ledger(spark, sf).select(
            "node_id", E.extra_flag_count("config").cast("long").alias("n_flags"), F.array_join(E.leak_flags("config"), ",").alias("leaks"), E.is_core("config").alias("core")
        )
    )


@query(
    "leak_overlap",
    f"""WITH {LEDGER} SELECT c.node_id, (c.utd = 'true' AND p.utd = 'true') AS shared FROM ledger c JOIN ledger p ON p.node_id = c.parent_id""",
)
def leak_overlap(spark, sf):
    l = ledger(spark, sf)
    p = l.select(F.col("node_id").alias("parent_id"), F.col("config").alias("_p"))
    return l.join(p, "parent_id").select("node_id", E.leak_overlap("config", "_p").alias("shared"))


@query(
    "apply_identity",
    f"""WITH {LEDGER} SELECT c.node_id, p.k, p.loss, p.seq_len, p.utd AS use_time_decay, CAST(c.seed AS VARCHAR) AS seed, '"fm"' AS arch FROM ledger c JOIN ledger p ON p.node_id = c.parent_id""",
)
def apply_identity(spark, sf):
    l = ledger(spark, sf)
    p = l.select(F.col("node_id").alias("parent_id"), F.col("config").alias("_p"))
    m = l.join(p, "parent_id").select("node_id", E.apply_identity("config", "_p").alias("m"))
    return m.select("node_id", *[F.col("m")[c].alias(c) for c in ("k", "loss", "seq_len", "use_time_decay", "seed", "arch")])


@query(
    "merge_delta",
    f"""WITH {LEDGER} SELECT c.node_id, concat_ws(';', CASE WHEN p.seq_len <> '0' AND p.seq_len <> c.seq_len THEN 'seq_len=' || p.seq_len END,
    CASE WHEN p.utd = 'true' AND c.utd <> 'true' THEN 'use_time_decay=true' END) AS delta FROM ledger c JOIN ledger p ON p.node_id = c.parent_id""",
)
def merge_delta(spark, sf):
    l = ledger(spark, sf)
    p = l.select(F.col("node_id").alias("parent_id"), F.col("config").alias("_p"))
    return l.join(p, "parent_id").select("node_id", E.fingerprint(E.merge_delta("config", "_p")).alias("delta"))


ARM_OF = "CASE o_custkey % 5 WHEN 0 THEN 'capacity' WHEN 1 THEN 'loss' WHEN 2 THEN 'sequence' WHEN 3 THEN 'features' ELSE 'draft' END"


@query(
    "validate_patches",
    f"""WITH p AS (SELECT o_orderkey AS id, {ARM_OF} AS arm, o_custkey AS c FROM orders)
    SELECT id AS patch_id, arm, concat_ws(';',
      CASE WHEN arm IN ('capacity', 'draft') AND c % 7 <> 0 THEN 'k=' || (c % 3) END,
      CASE WHEN arm IN ('loss', 'draft') AND c % 2 = 0 THEN 'loss="bpr"' END,
      CASE WHEN arm IN ('sequence', 'draft') AND c % 3 <> 2 THEN 'seq_len=' || CASE c % 3 WHEN 0 THEN '50' ELSE '100' END END,
      CASE WHEN arm IN ('features', 'draft') AND c % 4 <> 3 THEN 'use_time_decay=' || CASE c % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'true' ELSE 'false' END END) AS clean FROM p""",
)
def validate_patches(spark, sf):
    """Every patch proposes all four keys; the arm, the enum values and the types decide what stays."""
    o, c = table(spark, sf, "orders"), F.col("o_custkey")
    arm = F.element_at(F.array(*[F.lit(a) for a in ("capacity", "loss", "sequence", "features", "draft")]), (c % 5 + 1).cast("int"))
    patch = F.create_map(
        F.lit("k"), F.when(c % 7 == 0, F.lit('"many"')).otherwise((c % 3).cast("string")),
        F.lit("loss"), F.when(c % 2 == 0, '"bpr"').otherwise('"hinge"'),
        F.lit("seq_len"), F.element_at(F.array(F.lit("50"), F.lit("100"), F.lit("33")), (c % 3 + 1).cast("int")),
        F.lit("use_time_decay"), F.element_at(F.array(F.lit("true"), F.lit("1"), F.lit("0"), F.lit('"yes"')), (c % 4 + 1).cast("int")),
        F.lit("unknown_key"), F.lit("1"),
    )
    out = N.validate_patches(o.select(F.col("o_orderkey").alias("patch_id"), arm.alias("arm"), patch.alias("patch")))
    text = F.array_join(F.array_sort(F.transform(F.map_entries("clean"), lambda e: F.concat_ws("=", e["key"], e["value"]))), ";")
    return out.select("patch_id", "arm", text.alias("clean"))


# ---- error memory ------------------------------------------------------------------------


@query(
    "similar_errors",
    f"""WITH q AS (SELECT item_id AS query_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z_]{{3,}}'))) AS token FROM benchmark),
    c AS (SELECT doc_id AS trial_id, unnest(list_distinct(regexp_extract_all(lower({NORM.format(c='text')} || ' ' || text), '[a-z_]{{3,}}'))) AS token FROM documents WHERE doc_id % 4 <> 0),
    o AS (SELECT query_id, trial_id, count(*) AS overlap FROM q JOIN c USING (token) GROUP BY 1, 2)
    SELECT query_id, trial_id, overlap, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, trial_id) AS place FROM o QUALIFY place <= 3""",
)
def similar_errors(spark, sf):
    return tidy(N.similar_errors(error_queries(spark, sf), error_cases(spark, sf)))


# ---- findings ----------------------------------------------------------------------------

FALS = f"""fz AS (SELECT run_id, fp, min(seq) AS node_id FROM ledger WHERE arm <> 'ablate' AND stage IN ('improve', 'draft') AND NOT is_skip AND NOT (stage = 'draft' AND confirmed)
  AND ci95_hi < 0 AND delta_primary IS NOT NULL AND fp <> '' GROUP BY 1, 2)"""
FIND = f"""{BEST}, {FALS}, mem AS (SELECT b.run_id, unnest(members) AS m, unnest(range(len(members))) AS i FROM best b WHERE members IS NOT NULL),
fnd AS (SELECT 'incumbent:' || node_id || ':' || printf('%.5f', prim) AS key, CASE WHEN members IS NOT NULL OR confirmed_mean IS NOT NULL THEN 'measured-3seed' ELSE 'measured-1seed' END AS tag,
  run_id, NULL AS fingerprint, NULL AS scale FROM best UNION ALL
  SELECT 'confirmed:' || fp, CASE WHEN members IS NOT NULL OR confirmed_mean IS NOT NULL THEN 'measured-3seed' ELSE 'measured-1seed' END, run_id, fp, NULL FROM ledger WHERE {GOOD} AND confirmed UNION ALL
  SELECT 'falsified:pure:' || coalesce(CAST(l.parent_id AS VARCHAR), 'root') || ':' || fz.fp, 'measured-1seed', fz.run_id, fz.fp, 'pure' FROM fz JOIN ledger l USING (node_id) UNION ALL
  SELECT 'calibration:' || within || '/' || n || ' within, bias=' || printf('%.5f', b) || CASE WHEN b > 0 THEN ' over-optimistic' ELSE ' under-optimistic' END, 'diagnosis', run_id, NULL, NULL
  FROM (SELECT run_id, count(*) AS n, count(*) FILTER (ci95_lo <= expected_delta AND expected_delta <= ci95_hi) AS within, avg(expected_delta - delta_primary) AS b
    FROM ledger WHERE expected_delta IS NOT NULL AND delta_primary IS NOT NULL GROUP BY 1))"""


@query(
    "findings",
    f"WITH {LEDGER}, {FIND} SELECT key, tag, run_id, fingerprint, scale FROM fnd",
)
def findings(spark, sf):
    return N.findings(ledger(spark, sf)).select("key", "tag", "run_id", "fingerprint", "scale")


@query(
    "merge_findings",
    f"""WITH {LEDGER}, {FIND}, k AS (SELECT key, min(run_id) AS run_id FROM fnd GROUP BY 1) SELECT key, run_id FROM k""",
)
def merge_findings(spark, sf):
    """Merging the findings with themselves in run order keeps the first record of every key."""
    out = N.findings(ledger(spark, sf)).withColumn("pos", F.col("run_id"))
    merged = N.merge_findings(out, out)
    return merged.select("key", "run_id")


@query(
    "graveyard",
    f"""WITH {LEDGER}, {FALS} SELECT DISTINCT 'pure' AS scale, fp AS fingerprint FROM fz UNION SELECT DISTINCT '1k', fp || ';x=1' FROM fz
    UNION SELECT '27k', 'k=' || (seq + 100) || ';x=true' FROM ledger WHERE stage = 'improve'
    UNION SELECT '1k', 'k=' || (seq + 200) || ';loss="bpr"' FROM ledger WHERE stage = 'improve'
    UNION SELECT 'pure', 'k=' || (seq + 300) || ';use_hour=true' FROM ledger WHERE stage = 'improve'""",
)
def graveyard(spark, sf):
    """Current records, the same as scoped keys of the 1k scale without a stored fingerprint, and records with a key in list
    form, with a patch, and with a patch in the text."""
    recs = N.findings(ledger(spark, sf)).where(F.col("key").startswith("falsified:"))
    scoped = recs.select(
        F.concat(F.regexp_replace("key", "^falsified:pure:", "falsified:1k:"), F.lit(";x=1")).alias("key"),
        "tag", "run_id", "text", F.lit(None).cast("string").alias("fingerprint"), F.lit(None).cast("string").alias("scale"),
    )
    node = ledger(spark, sf).where(F.col("stage") == "improve")
    one = F.lit("measured-1seed").alias("tag")
    listed = node.select(F.format_string('falsified:27k:[["k", %d], ["x", true]]', F.col("seq") + 100).alias("key"), one)
    patched = node.select(
        F.format_string("falsified:%d", "seq").alias("key"), one, F.lit(" 1K").alias("scale"),
        F.format_string('{"k": %d.0, "loss": "bpr", "seed": 3}', F.col("seq") + 200).alias("patch"),
    )
    told = node.select(F.lit("").alias("key"), one, F.format_string("tried {'k': %d, 'use_hour': True} again", F.col("seq") + 300).alias("text"))
    every = recs.unionByName(scoped)
    for part in (listed, patched, told):
        every = every.unionByName(part, allowMissingColumns=True)
    return N.graveyard(every)


@query(
    "claim_cards",
    f"""WITH {LEDGER}, f AS (SELECT run_id, parent_id, fp, min(seq) AS node_id FROM ledger WHERE NOT is_skip GROUP BY 1, 2, 3),
    c AS (SELECT l.* FROM f JOIN ledger l USING (node_id))
    SELECT run_id, fp AS claim, CASE WHEN ci95_hi < 0 AND delta_primary IS NOT NULL THEN 'falsified-1seed' ELSE 'confirmed-3seed' END AS status,
      coalesce(CAST(parent_id AS VARCHAR), 'root') AS scope, node_id AS evidence, round(CASE WHEN ci95_hi < 0 AND delta_primary IS NOT NULL THEN delta_primary ELSE confirmed_mean END, 9) AS value
    FROM c WHERE (ci95_hi < 0 AND delta_primary IS NOT NULL) OR (confirmed AND confirmed_mean IS NOT NULL) UNION ALL
    SELECT run_id, 'complementary-blend', 'measured-1seed', 'run', node_id, round(blend_alpha, 9) FROM ledger WHERE ensemble_kind = 'complementary' AND blend_alpha IS NOT NULL""",
)
def claim_cards(spark, sf):
    return tidy(N.claim_cards(ledger(spark, sf)))


@query(
    "dataset_catalog",
    f"""WITH {IMP}, s AS (SELECT CASE WHEN row_id % 3 = 0 THEN 'pure' ELSE '1k' END AS scale, count(*) AS n_rows, count(DISTINCT user_id) AS users, count(DISTINCT video_id) AS items FROM imp GROUP BY 1),
    p(scale, published_rows, published_users, published_items) AS (VALUES ('pure', 1436609, 27285, 7551), ('1k', 11713045, 1000, 4369953), ('27k', 322278385, 27285, 32038725))
    SELECT scale, published_rows::BIGINT AS published_rows, published_users::BIGINT AS published_users, published_items::BIGINT AS published_items, coalesce(n_rows, 0) AS n_rows,
    coalesce(users, 0) AS users, coalesce(items, 0) AS items, n_rows IS NOT NULL AS present FROM p LEFT JOIN s USING (scale)""",
)
def dataset_catalog(spark, sf):
    imp = impressions(spark, sf).withColumn("scale", F.when(F.col("row_id") % 3 == 0, "pure").otherwise("1k"))
    out = N.dataset_catalog(imp)
    return out.fillna(0, ["n_rows", "users", "items"])

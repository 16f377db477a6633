"""Mixing sources to target weights by entropy balancing.

Of all document rates between 0 and a cap, those closest in relative entropy to "every document once" that meet the
sources' token targets are min(cap, exp(l * size)), with one multiplier l per source. The multipliers maximise a concave dual,
solved by Newton steps as aggregations over (source, size) counts, which stay small whatever one source holds.
Rates are then rounded into copies, with the rounding error carried from long documents to short ones.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.text import count_words, text_of
from rankspark.session import cut_lineage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
CAP = 2
TOLERANCE = 1e-7
MAX_STEPS = 60
GROUP_DOCS = 500


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP) -> DataFrame:
    """One row per source: source, n_docs, source_size, target. Sources weigh by code-point order, null last; a target
    above cap times its source stops there and the excess goes to the others by weight, until none is above.
    The single ordered window holds one row per source."""
    per = sizes.groupBy("source").agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum("size").alias("source_size"), F.min(F.when(F.col("size") > 0, F.col("size"))).alias("least"),
    )
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    sources = cut_lineage(per.withColumn("weight", weight))
    total, all_weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    budget = share * (total or 0)
    level, before = (budget / all_weight if all_weight else 0.0), None
    limit = F.lit(float(cap)) * F.col("source_size")
    while level != before:  # each round stops at least one more source
        before = level
        above = limit < F.lit(level) * F.col("weight")
        stopped, free = sources.agg(F.sum(F.when(above, limit)), F.sum(F.when(~above, F.col("weight")))).first()
        level = max(level, (budget - (stopped or 0.0)) / free) if free else level
    return sources.withColumn("target", F.least(limit, F.lit(level) * F.col("weight")))


def rate(size: Column, lam: Column, unit: Column, cap: int) -> Column:
    return F.when(lam.isNull(), F.lit(float(cap))).otherwise(F.least(F.lit(float(cap)), F.exp(lam * size / unit)))


def solve_multipliers(counts: DataFrame, targets: DataFrame, cap: int = CAP, tolerance: float = TOLERANCE) -> DataFrame:
    """targets with lam and unit (the source's mean size): the dual's maximum per source. lam is null, meaning every
    rate is cap, where the target takes the whole of cap times the source. Newton steps that leave the bracket known
    so far are replaced by its middle."""
    unit = F.col("source_size") / F.col("n_docs")
    bound = F.when(F.col("least").isNotNull(), unit / F.col("least"))
    open_ = (F.col("source_size") > 0) & (F.col("target") < F.col("source_size") * F.lit(cap * (1 - 1e-12)))
    state = cut_lineage(targets.select(
        "source", "target", unit.alias("unit"), F.when(open_, F.lit(0.0)).alias("lam"),
        (-40.0 * bound).alias("lo"), (math.log(cap) * bound).alias("hi"), (~open_).alias("done"),
    ))
    for _ in range(MAX_STEPS):
        if state.where("NOT done").isEmpty():
            break
        moving = counts.join(state.where("NOT done"), F.col("csource").eqNullSafe(F.col("source")))
        w = rate(F.col("size"), F.col("lam"), F.col("unit"), cap)
        mass = F.col("n") * F.col("size") * w
        sums = moving.groupBy("csource").agg(
            F.sum(mass).alias("mass"), F.sum(F.when(w < cap, mass * F.col("size") / F.col("unit")).otherwise(0.0)).alias("slope"),
        )
        gap = F.col("mass") - F.col("target")
        joined = state.join(sums, F.col("csource").eqNullSafe(F.col("source")), "left").select(
            *state.columns, gap.alias("gap"), "slope",
            F.when(gap < 0, F.col("lam")).otherwise(F.col("lo")).alias("lo2"),
            F.when(gap > 0, F.col("lam")).otherwise(F.col("hi")).alias("hi2"),
        )
        step = F.col("lam") - F.try_divide(F.col("gap"), F.col("slope"))
        inside = F.coalesce((step > F.col("lo2")) & (step < F.col("hi2")), F.lit(False))
        met = F.col("done") | F.coalesce(F.abs("gap") <= F.col("target") * tolerance, F.lit(True))
        state = cut_lineage(joined.select(
            "source", "target", "unit",
            F.when(met, F.col("lam")).when(inside, step).otherwise((F.col("lo2") + F.col("hi2")) / 2).alias("lam"),
            F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), met.alias("done"),
        ))
    # Rounded so that the order in which partial sums met cannot reach the rounding into copies.
    return targets.join(
        state.select(F.col("source").alias("ssource"), F.round("lam", 7).alias("lam"), "unit"), F.col("source").eqNullSafe(F.col("ssource")), "left"
    ).drop("ssource")


def rounded_copies(rows: DataFrame, cap: int, group_docs: int) -> DataFrame:
    """Rates to whole copies in groups of about group_docs documents of one source: longest first, each document takes
    the floor or ceiling of its rate that brings the group's running total nearer to its ideal."""
    item = F.struct((-F.col("size")).alias("order"), "doc_id", "size", "rate")
    grouped = rows.groupBy("source", "source_size", "target", "part").agg(F.sort_array(F.collect_list(item)).alias("items"))

    def take(acc: Column, x: Column) -> Column:
        want = acc["carry"] + x["rate"] * x["size"]
        copies = F.least(F.greatest(F.round(want / x["size"]), F.floor(x["rate"])), F.ceil(x["rate"]), F.lit(cap)).cast("long")
        return F.struct((want - copies * x["size"]).alias("carry"), F.array_append(acc["copies"], copies).alias("copies"))

    start = F.struct(F.lit(0.0).alias("carry"), F.array().cast("array<bigint>").alias("copies"))
    copies = F.aggregate("items", start, take)["copies"]
    return grouped.select("source", "source_size", "target", F.explode(F.arrays_zip("items", copies.alias("copies"))).alias("x")).select(
        F.col("x.items.doc_id").alias("doc_id"), F.col("x.items.size").alias("size"), "source", "source_size", "target",
        F.col("x.items.rate").alias("rate"), F.col("x.copies").alias("copies"),
    )


def mix_sources(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
                weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: int = CAP, group_docs: int = GROUP_DOCS) -> DataFrame:
    """One row per row of docs: doc_id, size, source, source_size, target, rate, copies (0 to cap), taken = size * copies.

    Sizes are words; a null or blank text has size 0, keeps one copy and takes nothing. A null source is a source of its own,
    last in order. Repeated rows and doc_ids are separate documents; ties in size go by doc_id. An empty table gives an empty
    result; other columns of docs are not read."""
    sizes = cut_lineage(docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), count_words(text_of(text)).alias("size"),
    ))
    counts = cut_lineage(sizes.where("size > 0").groupBy(F.col("source").alias("csource"), "size").agg(F.count(F.lit(1)).alias("n")))
    solved = cut_lineage(solve_multipliers(counts, source_targets(sizes, weights, share, cap), cap)).withColumnRenamed("source", "tsource")
    # One row per source: broadcast by Spark below its size limit, else joined with adaptive splitting of large sources.
    rows = sizes.join(solved, F.col("source").eqNullSafe(F.col("tsource")), "left")
    parts = F.ceil(F.col("n_docs") / F.lit(group_docs))
    placed = rows.where("size > 0").select(
        "doc_id", "size", "source", "source_size", "target", rate(F.col("size"), F.col("lam"), F.col("unit"), cap).alias("rate"),
        F.pmod(F.xxhash64("doc_id", "size"), parts).alias("part"),
    )
    blank = rows.where("size = 0").select(
        "doc_id", "size", "source", "source_size", "target", F.lit(1.0).alias("rate"), F.lit(1).cast("long").alias("copies")
    )
    mixed = rounded_copies(placed, cap, group_docs).unionByName(blank)
    return mixed.withColumn("taken", F.col("size") * F.col("copies"))

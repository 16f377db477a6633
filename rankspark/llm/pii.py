"""Personal data: base patterns and information-theoretic sanitisation.

Base spans come from four patterns. Around every span lies a context of words; over the whole corpus the words' co-occurrence with
the value found there says how much they reveal of it: with a unit of one line, a term t discloses a value e by
PMI(t, e) / IC(e) = log(n_te * N / (n_t * n_e)) / log(N / n_e), which is 1 when t occurs with e only. DISCOUNT is taken off n_te, so
that pairs seen a few times count for less. Terms beyond a threshold, seen with the value in two different texts, are added as spans in every document that holds the term, with or without the value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.text import text_of
from rankspark.session import cut_lineage

# The base kinds in order, and their patterns. Runs are matched from their first character and possessively,
# which finds the same leftmost matches in linear time.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "[A-Za-z0-9._%+-]"
LABEL = "[A-Za-z0-9-]"
PATTERNS = {
    "email": rf"(?:(?<!{LOCAL})|\G){LOCAL}++@{LABEL}++(?:\.{LABEL}++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
TERM = "term"
CONTEXT_CHARS, CONTEXT_WORDS = 240, 10
MIN_CONTEXTS, DISCOUNT, DISCLOSURE = 2, 0.5, 0.8
WORD = r"[\p{L}\p{N}]+"
MIN_TERM_CHARS = 3


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    rev = F.reverse(number)

    def weigh(i: Column) -> Column:
        d = F.substr(rev, i, F.lit(1)).cast("int")
        twice = d * 2
        return F.when(i % 2 == 1, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))

    return F.aggregate(F.sequence(F.lit(1), F.length(number)), F.lit(0), lambda acc, i: acc + weigh(i)) % 10 == 0


def holds(kind: str, value: Column) -> Column:
    number = digits(value)
    if kind == "ip":
        return F.forall(F.split(value, r"\."), lambda x: x.cast("double") <= 255)
    if kind == "card":
        return F.when(F.length(number).between(12, 19), luhn(number)).otherwise(False)
    if kind == "phone":
        return F.length(number).between(9, 15)
    return F.lit(True)


SPAN = "struct<start:bigint,rank:int,end:bigint,value:string>"


def matches(text: Column, pattern: Column, rank: int, keep) -> Column:
    """Sorted spans of a pattern. The pieces between matches and the matches' own lengths give the code-point positions."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast(f"array<{SPAN}>").alias("spans"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["pieces"])
        end = begin + F.length(x["found"])
        span = F.struct(begin.cast("bigint").alias("start"), F.lit(rank).alias("rank"), end.cast("bigint").alias("end"), x["found"].alias("value"))
        return F.struct(
            end.cast("bigint").alias("at"), F.when(keep(x["found"]), F.array_append(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    zipped = F.filter(F.arrays_zip(pieces.alias("pieces"), found.alias("found")), lambda x: x["found"].isNotNull())
    return F.aggregate(zipped, start, step)["spans"]


def base_spans(text: Column) -> Column:
    """All spans of the base kinds, by start, then kind. A text without a kind's telling character is not searched for it."""
    need = {"email": F.contains(text, F.lit("@")), "ip": F.contains(text, F.lit(".")) & text.rlike(r"[0-9]\.[0-9]"), "card": text.rlike("[0-9][0-9 -]"),
            "phone": F.contains(text, F.lit("+"))}
    parts = [
        F.when(need[kind], matches(text, F.lit(PATTERNS[kind]), i, lambda v, kind=kind: holds(kind, v))).otherwise(F.array().cast(f"array<{SPAN}>"))
        for i, kind in enumerate(KINDS)
    ]
    return F.sort_array(F.concat(*parts))


def written(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in (*KINDS, TERM)])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["rank"] + 1), s["start"], s["end"])), ",")


def entity(span: Column) -> Column:
    """The protected value, however written: kind and lower-cased address or bare digits."""
    kind = span["rank"]
    value = F.when(kind == 0, F.lower(span["value"])).when(kind == 1, span["value"]).otherwise(digits(span["value"]))
    return F.concat_ws(":", kind, value)


def terms_near(text: Column, span: Column) -> Column:
    """Distinct words of the same line near the span: CONTEXT_WORDS on either side, within CONTEXT_CHARS."""
    from_ = F.greatest(span["start"] - CONTEXT_CHARS, F.lit(0))
    left = F.substr(text, (from_ + 1).cast("int"), (span["start"] - from_).cast("int"))
    right = F.substr(text, (span["end"] + 1).cast("int"), F.lit(CONTEXT_CHARS))
    before = F.regexp_extract_all(F.substring_index(left, "\n", -1), F.lit(WORD), F.lit(0))
    after = F.regexp_extract_all(F.substring_index(right, "\n", 1), F.lit(WORD), F.lit(0))
    before = F.slice(before, F.greatest(F.size(before) - CONTEXT_WORDS + 1, F.lit(1)), CONTEXT_WORDS)
    near = F.transform(F.concat(before, F.slice(after, 1, CONTEXT_WORDS)), lambda w: F.lower(w))
    return F.array_distinct(F.filter(near, lambda w: F.length(w) >= MIN_TERM_CHARS))


def found_spans(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, own (a hash of the text), n_lines, spans and notes (per span: entity and the terms near it)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text"))
    rows = rows.withColumn("spans", base_spans(F.col("text")))
    notes = F.transform("spans", lambda s: F.struct(entity(s).alias("entity"), terms_near(F.col("text"), s).alias("terms")))
    lines = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1
    return rows.select("doc_id", F.xxhash64("text").alias("own"), lines.cast("bigint").alias("n_lines"), "spans", F.when(F.size("spans") > 0, notes).alias("notes"))


def words_of(rows: DataFrame) -> DataFrame:
    """One row per distinct word of each row's words, as term, beside the row's other columns."""
    return rows.select(
        *[c for c in rows.columns if c != "words"], F.explode(F.array_distinct(F.split(F.lower("words"), r"[^\p{L}\p{N}]+"))).alias("term")
    )


def disclosing_terms(docs: DataFrame, found: DataFrame, text: str, min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """entity, term, ratio of the pairs beyond the threshold, from counts over every line of the corpus.

    A term stands in at least as many lines as there are documents with it in a context, which bounds its ratio from above; only
    terms that this bound leaves are counted in all lines, so frequent words drop out before."""
    notes = found.where("notes IS NOT NULL").select("doc_id", "own", F.explode("notes").alias("n")).select("doc_id", "own", "n.*")
    total = found.agg(F.sum("n_lines").cast("double").alias("total"))
    held = notes.select("doc_id", F.explode("terms").alias("term")).distinct().groupBy("term").agg(F.count("doc_id").alias("n_held"))

    def ratio(n_t: Column) -> Column:
        return F.try_divide(
            F.log((F.col("n_te") - DISCOUNT) * F.col("total") / (n_t * F.col("n_e"))), F.log(F.col("total") / F.col("n_e"))
        )

    n_e = notes.groupBy("entity").agg(F.count(F.lit(1)).alias("n_e")).where(F.col("n_e") >= min_contexts)
    often = notes.join(n_e, "entity")
    pairs = often.select("entity", "n_e", "own", F.explode("terms").alias("term"))
    # Copies of a document are one text; only different texts count as evidence.
    pairs = pairs.groupBy("entity", "n_e", "term", "own").agg(F.count(F.lit(1)).alias("n")).groupBy("entity", "n_e", "term").agg(
        F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("contexts")
    ).where(F.col("contexts") >= min_contexts)
    pairs = pairs.join(held, "term").crossJoin(F.broadcast(total))  # one row
    pairs = pairs.where((F.col("total") > F.col("n_e")) & (ratio(F.greatest("n_held", F.lit(1))) >= disclosure))
    pairs = cut_lineage(pairs.select("entity", "term", "n_e", "n_te", "total"))
    wanted = pairs.select("term").distinct()
    n_t = words_of(docs.select(F.explode(F.split(text_of(text), "\n", -1)).alias("words"))).groupBy("term").agg(F.count(F.lit(1)).alias("n_t")).join(wanted, "term")
    scored = pairs.join(n_t, "term").withColumn("ratio", ratio(F.col("n_t")))
    return scored.select("entity", "term", "ratio").where(F.col("ratio") >= disclosure)


def term_spans(text: Column, terms: Column) -> Column:
    alternatives = F.array_join(F.transform(terms, lambda t: F.concat(F.lit("\\Q"), t, F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), alternatives, F.lit(r")(?![\p{L}\p{N}])"))
    return matches(text, pattern, len(KINDS), lambda v: F.lit(True))


def private_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_contexts: int = MIN_CONTEXTS, disclosure: float = DISCLOSURE) -> DataFrame:
    """One row per row of docs: doc_id, base (spans of the base kinds), terms (added spans), each by start.

    Positions are code points of the whole text. Terms of a value are looked for in every document, whether it holds the value or not,
    since they disclose it there too; those overlapping a base span are left out. Null and empty texts have no spans. Rows that share a doc_id, null included, are
    searched for the terms of all of them. An empty table gives an empty result; other columns of docs are not read."""
    found = cut_lineage(found_spans(docs, doc_id, text))
    told = cut_lineage(disclosing_terms(docs, found, text, min_contexts, disclosure))
    held = words_of(docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("words")))
    by_doc = held.join(told.select("term").distinct(), "term").groupBy(F.col("doc_id").alias("_id")).agg(F.sort_array(F.collect_set("term")).alias("_terms"))
    by_doc = cut_lineage(by_doc)
    looked = docs.select(F.col(doc_id).alias("doc_id"), text_of(text).alias("text")).join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")))
    added = looked.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_own"), term_spans(F.col("text"), F.col("_terms")).alias("_added"))
    added = added.groupBy("_id", "_own").agg(F.first("_added").alias("_added"))
    joined = found.join(added, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("own") == F.col("_own")), "left")
    clear = F.filter(
        F.coalesce("_added", F.array().cast(f"array<{SPAN}>")),
        lambda t: ~F.exists("spans", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"])),
    )
    return joined.select("doc_id", F.col("spans").alias("base"), clear.alias("terms"))


def sanitise(text: Column, spans: Column) -> Column:
    """The text with base spans generalised to their kind and terms removed. Spans must be sorted; of overlapping ones the first wins."""
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS], F.lit(""))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<string>").alias("parts"))

    def step(acc: Column, s: Column) -> Column:
        between = F.substr(text, (acc["at"] + 1).cast("int"), (s["start"] - acc["at"]).cast("int"))
        grown = F.struct(
            s["end"].alias("at"), F.concat(acc["parts"], F.array(between, F.element_at(names, s["rank"] + 1))).alias("parts"),
        )
        return F.when(s["start"] >= acc["at"], grown).otherwise(acc)

    return F.aggregate(
        spans, start, step, lambda acc: F.concat(F.array_join(acc["parts"], ""), F.substr(text, (acc["at"] + 1).cast("int"), F.length(text))),
    )

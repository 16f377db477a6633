"""Exact dedup by content-defined chunk recipes.

A normalised text is cut where its own characters say so, so equal passages give equal chunks wherever they stand.
Chunks are de-duplicated once, and content under the same 64-bit hash is compared, which makes (hash, rank among the
contents of that hash) a verified identifier. From then on only ordered identifier lists move: texts are equal exactly
when their lists are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.text import SPACE, text_of
from rankspark.session import cut_lineage

# A chunk has MIN_CHUNK to MAX_CHUNK characters and ends behind sentence punctuation or two characters of a fixed class.
MIN_CHUNK, MAX_CHUNK = 512, 4096
BOUNDARY = "(?<=[.!?]|[cksCKS3]{2})"


def chunk_pattern(least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> str:
    return f"(?s).{{{least},{most}}}?{BOUNDARY}|.{{1,{most}}}"


def chunk_hash(chunk: Column, bits: int) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else F.pmod(h, F.lit(1 << bits))


def chunked(docs: DataFrame, doc_id: str, text: str, least: int, most: int) -> DataFrame:
    norm = F.regexp_replace(text_of(text), f"[{SPACE}]+", "")
    return docs.select(
        F.col(doc_id).alias("doc_id"),
        F.length(text_of(text)).cast("long").alias("n_chars"),
        norm.alias("norm"),
    ).select(
        "doc_id", "n_chars", F.sha2("norm", 256).alias("text_sha256"),
        F.regexp_extract_all("norm", F.lit(chunk_pattern(least, most)), F.lit(0)).alias("chunks"),
    )


def ambiguous_hashes(parts: DataFrame, bits: int = 64) -> DataFrame:
    """One row: a map from every hash with more than one content to its sorted contents. Each content moves once and
    repeats are removed before the shuffle. At 64 bits a trillion chunks are expected to share about 27,000 hashes."""
    pieces = parts.select(F.explode("chunks").alias("chunk"))
    by_hash = pieces.groupBy(chunk_hash(F.col("chunk"), bits).alias("h")).agg(F.collect_set("chunk").alias("contents"))
    several = by_hash.where(F.size("contents") > 1).select("h", F.sort_array("contents").alias("contents"))
    return several.agg(F.map_from_entries(F.collect_list(F.struct("h", "contents"))).alias("ambiguous"))


def recipes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHUNK, most: int = MAX_CHUNK,
            bits: int = 64) -> DataFrame:
    """doc_id, n_chars, text_sha256 and recipe: the ordered verified identifiers of the document's chunks. The chunks are
    written once, since both the comparison of contents and the recipes read them and chunking costs more than reading."""
    parts = cut_lineage(chunked(docs, doc_id, text, least, most))
    known = F.broadcast(ambiguous_hashes(parts, bits))

    def identify(chunk: Column) -> Column:
        h = chunk_hash(chunk, bits)
        rank = F.coalesce(F.array_position(F.element_at("ambiguous", h), chunk), F.lit(0))
        return F.struct(h.alias("h"), rank.cast("int").alias("r"))

    return parts.crossJoin(known).select("doc_id", "n_chars", "text_sha256", F.transform("chunks", identify).alias("recipe"))


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", least: int = MIN_CHUNK,
                most: int = MAX_CHUNK, bits: int = 64) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256, n_chunks.

    Texts are equal when they agree after deleting every space and U+0009 to U+000D. Of equal texts the one with most
    code points stays, then the smallest doc_id (a null doc_id last). A null text counts as empty; empty texts form
    one group like any other. Rows that repeat both the kept doc_id and its text all say kept. An empty table gives an
    empty result; other columns of docs are not read."""
    rows = cut_lineage(recipes(docs, doc_id, text, least, most, bits))
    first = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id"))
    groups = cut_lineage(
        rows.groupBy("recipe").agg(F.count(F.lit(1)).alias("group_size"), first.alias("first"))
        .where("group_size > 1").select("recipe", "group_size", F.col("first.doc_id").alias("first_id"), F.lit(True).alias("shared"))
    )
    keep = F.when(F.col("shared"), F.col("first_id")).otherwise(F.col("doc_id"))
    return rows.join(groups, "recipe", "left").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("doc_id").eqNullSafe(keep).alias("kept"), "text_sha256", F.size("recipe").cast("long").alias("n_chunks"),
    )

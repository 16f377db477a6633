"""MinHash near-dedup with odd sketches.

A document is the set of its five-word shingles. 128 MinHash samples in 32 bands of 4 find candidates (a pair at similarity 0.75
shares no band once in 190,000), an odd sketch of the same samples estimates each candidate pair's similarity from the bits in
which two parity bitmaps differ, and pairs it does not rule out are confirmed on their full sets.

Equal sets are one class from the start. A bucket is never expanded into all its pairs. First every member meets the bucket's
smallest member, which joins what lies around it into components. Then only members outside the bucket's largest component are left
to be compared: as a query set, in blocks of a few dozen, each meets the bucket's members of other components, and what their sketches let through is
compared on the full sets where they meet. A member takes at most four of the components a block links it to, the
components are joined, and only members that had to leave links behind meet the same blocks again.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.words import batches, blocks, by_text, encoded, hash_words, mix
from rankspark.session import cut_lineage

SHINGLE_WORDS = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 32, 4
SAMPLES, SKETCH_BITS = BANDS * ROWS, 1024  # of the sketch made from the band samples
FINE_SAMPLES, FINE_BITS = 768, 3072  # of the sketch made for documents that share a band with another
SIGMAS = 4.5
BLOCK = 32  # members of a bucket compared together
LINKS = 4  # components a member may be joined to by one block in one round
_SEED = np.arange(1, 2 * FINE_SAMPLES + 1, dtype=np.uint64)
_A = mix(_SEED[:FINE_SAMPLES] * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_B = mix(_SEED[FINE_SAMPLES:] * np.uint64(0xD1342543DE82EF95))


def shingle_sets(texts: list[bytes], words: int = SHINGLE_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, its sorted distinct 64-bit shingle hashes); texts without words give an empty array."""
    for a, b in blocks(texts):
        table = hash_words([t.lower() for t in texts[a:b]])  # bytes.lower changes A-Z only
        edges = by_text(table.text, b - a)
        h = table.hash
        h5 = np.zeros(max(0, len(h) - words + 1), dtype=np.uint64)
        for j in range(words):
            h5 = mix(h5 + h[j : len(h) - words + 1 + j]) if len(h5) else h5
        for i in range(b - a):
            lo, hi = edges[i], edges[i + 1]
            if hi - lo >= words:
                yield a + i, np.unique(h5[lo : hi - words + 1])
            elif hi > lo:
                short = np.uint64(hi - lo)
                for x in h[lo:hi]:
                    short = mix(np.array([short]) + x)[0]
                yield a + i, np.array([short], dtype=np.uint64)
            else:
                yield a + i, np.zeros(0, dtype=np.uint64)


def minhash(items: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    out = np.full(samples, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(items), 512):
        np.minimum(out, (items[i : i + 512, None] * _A[:samples] + _B[:samples]).min(axis=0), out=out)
    return out >> np.uint64(16)


def band_keys(samples: np.ndarray) -> np.ndarray:
    rows = samples.reshape(BANDS, ROWS)
    key = np.arange(BANDS, dtype=np.uint64)
    for j in range(ROWS):
        key = mix(key + rows[:, j])
    return key.view(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Every sample flips one bit, chosen by its value and its number."""
    bit = mix(samples + _SEED[: len(samples)] * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(bits)
    parity = np.bincount(bit.astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8)).view("<i8")


def allowed_difference(threshold: float, samples: int = SAMPLES, bits: int = SKETCH_BITS, sigmas: float = SIGMAS) -> int:
    """Differing bits that a pair at the threshold exceeds about once in 300,000. Of the samples a pair at similarity s
    differs in samples * (1 - s) on average, and each differing sample flips two random bits, of which odd counts show."""
    flips = 2 * samples * (1 - threshold)
    left = (1 - 2 / bits) ** flips
    shown = (1 - left) / 2
    noise = bits * shown * (1 - shown) + bits * (bits - 1) * ((1 - 4 / bits) ** flips - left**2) / 4
    spread = 2 * left * np.sqrt(samples * threshold * (1 - threshold))
    return int(np.ceil(bits * shown + sigmas * np.sqrt(noise + spread**2)))


SIGNATURE = pa.schema([("n_shingles", pa.int64()), ("cls", pa.binary()), ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64()))])


def signatures(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, text_hash, n_shingles, cls (128-bit hash of the set, null when empty), bands, sketch."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(source):
            rows = []
            for _, items in shingle_sets(encoded(part.column(1))):
                if len(items):
                    samples = minhash(items)
                    rows.append((len(items), hashlib.blake2b(items.tobytes(), digest_size=16).digest(), band_keys(samples), odd_sketch(samples)))
                else:
                    rows.append((0, None, None, None))
            cols = [pa.array(c, type=f.type) for c, f in zip(zip(*rows), SIGNATURE)]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *cols], names=["doc_id", "text_hash", *SIGNATURE.names])

    kind = dict(docs.dtypes)[doc_id]
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text).alias("text_hash")).mapInArrow(
        work, f"doc_id {kind}, text_hash bigint, n_shingles bigint, cls binary, bands array<bigint>, sketch array<bigint>"
    )


def full_sets(docs: DataFrame, doc_id: str, text: str, wanted: DataFrame) -> DataFrame:
    """cls, bands, sketch, items, fine: sets and fine sketches of the classes in wanted (cls, bands, sketch, and the id and
    text hash of one document of each), from a second reading of the texts."""
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).alias("text"), F.xxhash64(text).alias("_hash"))
    picked = rows.join(wanted, (F.col("_hash") == F.col("one.text_hash")) & F.col("_id").eqNullSafe(F.col("one.doc_id")))
    longs = pa.list_(pa.int64())

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(source, 64):
            keep, sets, fine = [], [], []
            cls = part.column(1).to_pylist()
            for i, items in shingle_sets(encoded(part.column(0))):
                if hashlib.blake2b(items.tobytes(), digest_size=16).digest() == cls[i]:  # another row may share id and hash
                    keep.append(i)
                    sets.append(items.view(np.int64))
                    fine.append(odd_sketch(minhash(items, FINE_SAMPLES), FINE_BITS))
            kept = part.take(pa.array(keep, pa.int32()))
            yield pa.RecordBatch.from_arrays(
                [kept.column(1), kept.column(2), kept.column(3), pa.array(sets, longs), pa.array(fine, longs)],
                names=["cls", "bands", "sketch", "items", "fine"],
            )

    schema = "cls binary, bands array<bigint>, sketch array<bigint>, items array<bigint>, fine array<bigint>"
    made = picked.select("text", "cls", "bands", "sketch").mapInArrow(work, schema)
    return made.dropDuplicates(["cls"])


def differing_bits(a: Column, b: Column, bits: int) -> Column:
    parts = [F.bit_count(F.get(a, i).bitwiseXOR(F.get(b, i))) for i in range(bits // 64)]
    return sum(parts[1:], parts[0])


def may_link(a: Column, b: Column, percent: int) -> Column:
    """Whether sizes and sketches (structs of n, sketch, fine) leave a similarity of percent possible; the cheapest test comes first."""
    sizes = 100 * F.least(a["n"], b["n"]) >= percent * F.greatest(a["n"], b["n"])
    coarse = differing_bits(a["sketch"], b["sketch"], SKETCH_BITS) <= allowed_difference(percent / 100)
    fine = differing_bits(a["fine"], b["fine"], FINE_BITS) <= allowed_difference(percent / 100, FINE_SAMPLES, FINE_BITS)
    return sizes & coarse & fine


def first_shared(a: Column, b: Column) -> Column:
    """The first band key two members have in common."""
    return F.get(F.array_compact(F.zip_with(a, b, lambda x, y: F.when(x == y, x))), F.lit(0))


def star_pairs(entries: DataFrame, members: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """(x, y) pairs of each bucket's smallest member with its others, and those smallest members by key. Members are (cls, m)
    with m a struct of n, bands, sketch and fine."""
    lead = cut_lineage(entries.groupBy("key").agg(F.min("cls").alias("x")))
    pairs = entries.join(lead, "key").where("cls <> x").select("x", F.col("cls").alias("y")).distinct()
    x, y = [members.select(F.col("cls").alias(c), F.col("m").alias(f"{c}_m")) for c in "xy"]
    near = pairs.join(x, "x").join(y, "y").where(may_link(F.col("x_m"), F.col("y_m"), percent))
    return near.select("x", "y"), lead


def shares_enough(a: Column, b: Column, percent: int) -> Column:
    """100 * intersection >= percent * union of two arrays of distinct items."""
    shared = F.size(F.array_intersect(a, b))
    return 100 * shared >= percent * (F.size(a) + F.size(b) - shared)


def mixed_buckets(entries: DataFrame, lead: DataFrame, members: DataFrame, labels: DataFrame) -> DataFrame:
    """(key, cls, m, label, asks, block): members of buckets with several components, apart from the smallest member, which has met them all. Those
    outside the bucket's largest component ask, in blocks."""
    rest = entries.join(lead.select("key", F.col("x").alias("cls")), ["key", "cls"], "left_anti")
    named = rest.join(labels, "cls")
    parts = named.groupBy("key", "label").agg(F.count(F.lit(1)).alias("size"))
    largest = parts.groupBy("key").agg(F.max_by("label", F.struct("size", "label")).alias("top"), F.sum("size").alias("total"), F.max("size").alias("most"))
    mixed = largest.where("total > most").select("key", "top", F.ceil((F.col("total") - F.col("most")) / BLOCK).alias("blocks"))
    block = F.pmod(F.xxhash64("cls"), F.col("blocks")).alias("block")
    return named.join(mixed, "key").join(members, "cls").select("key", "cls", "m", "label", (F.col("label") != F.col("top")).alias("asks"), block)


def asking(live: DataFrame, again: DataFrame | None) -> DataFrame:
    """The members that ask; of blocks named in again only."""
    asks = live.where("asks").select("key", "block", "cls", "label", "m")
    return asks if again is None else asks.join(again.select("key", "block").distinct(), ["key", "block"], "left_semi")


def block_hits(live: DataFrame, percent: int, again: DataFrame | None = None) -> DataFrame:
    """(key, block, cls, label, hit): what of a block the sketches leave possible for a member, with classes of other components only. again limits the
    comparison to its (key, block, cls) rows."""
    asked = asking(live, again).groupBy("key", "block").agg(F.collect_list(F.struct("cls", "label", "m")).alias("asked"))
    rows = live.select("key", "cls", "label", "asks", "m")
    if again is None:
        met = rows.join(asked, "key")
    else:
        met = rows.join(again.select("key", "cls", "block"), ["key", "cls"]).join(asked, ["key", "block"])
    # Of two that ask only one is met by the other, the one with the larger cls, and a pair is compared in the first of its buckets only.
    hits = F.filter(
        "asked",
        lambda q: (q["label"] != F.col("label")) & (~F.col("asks") | (q["cls"] > F.col("cls"))) & may_link(q["m"], F.col("m"), percent)
        & (first_shared(q["m"]["bands"], F.col("m.bands")) == F.col("key")),
    )
    return met.select("key", "block", "cls", "label", F.transform(hits, lambda q: q["cls"]).alias("hit")).where(F.size("hit") > 0)


def block_links(live: DataFrame, hits: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b) components linked on full sets, at most LINKS for each member and block, with more saying that the block links the member to
    further components. Only the sets of members with hits and of the blocks that hold them are moved."""
    items = sets.select("cls", "items")
    asked = asking(live, hits).join(items, "cls").groupBy("key", "block").agg(F.collect_list(F.struct("cls", "label", "items")).alias("asked"))
    met = hits.join(items, "cls").join(asked, ["key", "block"])
    linked = F.filter("asked", lambda q: F.array_contains("hit", q["cls"]) & shares_enough(q["items"], F.col("items"), percent))
    found = met.select("key", "block", "cls", "label", F.array_distinct(F.transform(linked, lambda q: q["label"])).alias("to")).where(F.size("to") > 0)
    # Members choose by hash, so that those of one component together take nearly all of the links.
    ranked = F.array_sort(F.transform("to", lambda x: F.struct(F.xxhash64(x, "cls").alias("h"), x.alias("x"))))
    chosen = F.explode(F.transform(F.slice(ranked, 1, LINKS), lambda e: e["x"]))
    return found.select("key", "block", "cls", F.col("label").alias("a"), chosen.alias("b"), (F.size("to") > LINKS).alias("more"))


def join_outsiders(entries: DataFrame, lead: DataFrame, members: DataFrame, sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """(cls, label) after every pair that shares a bucket and could join two components has been compared."""
    live, again = cut_lineage(mixed_buckets(entries, lead, members, labels)), None
    while True:
        links = cut_lineage(block_links(live, cut_lineage(block_hits(live, percent, again)), sets, percent))
        if links.isEmpty():
            return labels
        labels = connect(links, labels)
        again = links.where("more").select("key", "block", "cls").distinct()
        if again.isEmpty():
            return labels
        left = live.join(again.select("key").distinct(), "key", "left_semi").drop("label")
        live = cut_lineage(left.join(labels, "cls"))


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sets meet 100 * intersection >= percent * union. Only the sets of these pairs are moved; a set
    wanted by very many pairs is split by the adaptive join."""
    wanted = pairs.select(F.explode(F.array("x", "y")).alias("cls")).distinct()
    sets = cut_lineage(sets.select("cls", "items").join(wanted, "cls", "left_semi"))
    a, b = [sets.select(F.col("cls").alias(c), F.col("items").alias(f"{c}_items")) for c in "xy"]
    both = pairs.join(a, "x").join(b, "y")
    return both.where(shares_enough(F.col("x_items"), F.col("y_items"), percent)).select("x", "y")


def between(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b): the components at the two ends of (x, y) edges."""
    return edges.join(labels.select(F.col("cls").alias("x"), F.col("label").alias("a")), "x").join(
        labels.select(F.col("cls").alias("y"), F.col("label").alias("b")), "y"
    ).where("a <> b").select("a", "b")


def connect(ends: DataFrame, labels: DataFrame) -> DataFrame:
    """New (cls, label) after joining the components a and b of every row of ends, by smallest neighbouring label and pointer jumping."""
    ends = ends.select("a", "b")
    links = cut_lineage(ends.unionByName(ends.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    nodes = cut_lineage(links.select("a", F.col("a").alias("root")).distinct())
    while True:
        near = links.join(nodes.select(F.col("a").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        hooked = cut_lineage(nodes.join(near, "a").select("a", F.col("root").alias("old"), F.least("root", "r").alias("root")))
        jump = hooked.select(F.col("a").alias("root"), F.col("root").alias("top"))
        nodes = cut_lineage(hooked.join(jump, "root").select("a", F.col("top").alias("root"), (F.col("top") != F.col("old")).alias("moved")))
        if nodes.where("moved").isEmpty():
            break
    return cut_lineage(labels.join(nodes.select(F.col("a").alias("label"), "root"), "label", "left").select(
        "cls", F.coalesce("root", "label").alias("label")
    ))


def near_components(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = THRESHOLD_PERCENT) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z, shingles five words; a shorter text is one shingle of all its words. Two
    texts are linked when 100 * shared >= percent * union on their full shingle sets. Null and blank texts have no shingle, are
    linked with nothing and kept. Repeated rows have equal sets and so one component; rows that repeat the kept doc_id all say kept;
    null doc_ids never name a component unless it has no other. An empty table gives an empty result; other columns are not read."""
    signed = cut_lineage(signatures(docs, doc_id, text))
    classes = signed.where("cls IS NOT NULL").groupBy("cls").agg(
        F.min(F.struct("doc_id", "text_hash")).alias("one"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    entries = classes.select("cls", F.explode("bands").alias("key"))
    several = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    entries = cut_lineage(entries.join(several, "key").select("key", "cls"))
    wanted = classes.join(entries.select("cls").distinct(), "cls", "left_semi")
    sets = cut_lineage(full_sets(docs, doc_id, text, wanted))
    members = sets.select("cls", F.struct(F.size("items").alias("n"), "bands", "sketch", "fine").alias("m"))
    labels = sets.select("cls", F.col("cls").alias("label"))
    near, lead = star_pairs(entries, members, percent)
    labels = connect(between(cut_lineage(confirmed(cut_lineage(near), sets, percent)), labels), labels)
    labels = join_outsiders(entries, lead, members, sets, labels, percent)
    named = signed.select("doc_id", "n_shingles", "cls").join(labels, "cls", "left").select(
        "doc_id", "n_shingles", F.coalesce("label", "cls").alias("label")
    )
    firsts = cut_lineage(named.where("label IS NOT NULL").groupBy("label").agg(F.min("doc_id").alias("component_id")))
    joined = named.join(firsts, "label", "left")
    component = F.when(F.col("label").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )

"""Document fingerprints: a homomorphic multiset hash of paragraphs.

Every paragraph gives a wide vector; a document's fingerprint is their sum, lane by lane, modulo 2**32. So the
order of paragraphs does not matter, and inserting or deleting one is an addition or a subtraction. The vector has two
parts: SEAL lanes taken from an extendable-output hash of the paragraph, which decide equality, and SKETCH
lanes to which each three-word shingle of the paragraph adds +1 or -1, which give the likeness of two sums.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.words import batches, blocks, hash_words, mix
from rankspark.session import shuffle_width

SEAL, SKETCH, SHINGLE = 64, 256, 3
NEWLINE = 10


def seals(texts: list[bytes]) -> np.ndarray:
    parts = [[p for p in t.split(b"\n") if p] for t in texts]
    digests = b"".join(hashlib.shake_128(p).digest(4 * SEAL) for ps in parts for p in ps)
    lanes = np.frombuffer(digests, dtype="<u4").reshape(-1, SEAL)
    out = np.zeros((len(texts), SEAL), dtype=np.uint32)
    counts = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    full = np.flatnonzero(counts)
    if len(full):
        first = np.concatenate([[0], np.cumsum(counts[full])[:-1]])
        out[full] = np.add.reduceat(lanes, first, axis=0, dtype=np.uint32)
    return out


def sketches(texts: list[bytes]) -> np.ndarray:
    out = np.zeros((len(texts), SKETCH), dtype=np.uint32)
    for a, b in blocks(texts):
        words = hash_words(texts[a:b])
        if not len(words.hash):
            continue
        line = np.searchsorted(np.flatnonzero(words.data == NEWLINE), words.start)
        n = len(line)
        # A shingle starts at every word with two more in its paragraph; shorter paragraphs are one shingle.
        first = np.flatnonzero(np.concatenate([[True], line[1:] != line[:-1]]))
        size = np.diff(np.append(first, n))
        place = np.arange(n) - np.repeat(first, size)
        left = np.repeat(size, size) - place
        starts = np.flatnonzero((left >= SHINGLE) | (place == 0))
        h = np.zeros(len(starts), dtype=np.uint64)
        for j in range(SHINGLE):
            inside = left[starts] > j
            at = np.minimum(starts + j, n - 1)
            h = mix(h + np.where(inside, words.hash[at], np.uint64(j)))
        lane = (h & np.uint64(SKETCH - 1)).astype(np.int64)
        sign = np.where(h >> np.uint64(63), 1.0, -1.0)
        sums = np.bincount(words.text[starts] * SKETCH + lane, weights=sign, minlength=(b - a) * SKETCH)
        out[a:b] = sums.astype(np.int64).astype(np.uint32).reshape(b - a, SKETCH)
    return out


Sum = tuple[np.ndarray, np.ndarray]


def fingerprint(texts: list[bytes]) -> Sum:
    """Row i is the sum of the paragraph vectors of text i; empty paragraphs add nothing."""
    return seals(texts), sketches(texts)


def plus(a: Sum, b: Sum) -> Sum:
    return a[0] + b[0], a[1] + b[1]


def minus(a: Sum, b: Sum) -> Sum:
    """Deletion: what plus(minus(a, b), b) undoes exactly."""
    return a[0] - b[0], a[1] - b[1]


def written(total: Sum) -> list[str]:
    rows = np.concatenate([total[0].astype("<u4").view(np.uint8), total[1].astype("<u4").view(np.uint8)], axis=1)
    return [base64.b64encode(r.tobytes()).decode() for r in rows]


def likeness(a: Sum, b: Sum) -> np.ndarray:
    """1 for equal sums, else the cosine of the sketches, at least 0."""
    same = (a[0] == b[0]).all(axis=1) & (a[1] == b[1]).all(axis=1)
    x, y = a[1].view(np.int32).astype(np.float64), b[1].view(np.int32).astype(np.float64)
    norm = np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))
    cos = np.divide((x * y).sum(axis=1), norm, out=np.zeros(len(norm)), where=norm > 0)
    return np.where(same, 1.0, np.clip(cos, 0.0, 1.0))


def edits(texts: list[str], following: list[str]) -> tuple[list[str], Sum, Sum]:
    """SHA-256 of the edited texts, and the sums of the texts and of the edited texts. Both share the paragraphs before the
    cut, which are hashed once."""
    head, tail, edited_tail, edited = [], [], [], []
    for text, nxt in zip(texts, following):
        half = len(text) // 2
        cut = len(text) - half
        new = text[:cut] + nxt[:half]
        border = text.rfind("\n", 0, cut) + 1
        head.append(text[:border].encode())
        tail.append(text[border:].encode())
        edited_tail.append(new[border:].encode())
        edited.append(hashlib.sha256(new.encode()).hexdigest())
    shared = fingerprint(head)
    return edited, plus(shared, fingerprint(tail)), plus(shared, fingerprint(edited_tail))


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = ["bigint", "string", "string", "string", "double", "double"]
GROUP = 64


def _neighbours(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by bucket; the row behind a bucket's last own row is a copy of the document that follows it."""
    held: list[tuple[int, int, object, str]] = []  # rows whose next is not known yet, up to the latest row seen

    def flush() -> pa.RecordBatch | None:
        pairs = [(x, y) for x, y in zip(held, held[1:]) if x[1] == 0 and x[0] == y[0]]
        if not pairs:
            return None
        texts = [x[3] for x, _ in pairs]
        sha, own, changed = edits(texts, [y[3] for _, y in pairs])
        # The next text is mostly the following pair's own, whose sum is known.
        known = [i + 1 < len(pairs) and pairs[i][1] is pairs[i + 1][0] for i in range(len(pairs))]
        rest = fingerprint([y[3].encode() for (_, y), k in zip(pairs, known) if not k])
        at = np.array([i + 1 if k else len(pairs) + known[:i].count(False) for i, k in enumerate(known)])
        nxt = tuple(np.concatenate([o, r])[at] for o, r in zip(own, rest))
        columns = [
            pa.array([x[2] for x, _ in pairs], type=id_type), pa.array([len(t) for t in texts], type=pa.int64()), pa.array(sha),
            pa.array(written(own)), pa.array(written(changed)), pa.array(likeness(own, changed)), pa.array(likeness(own, nxt)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=NAMES)

    id_type = None
    for batch in batches(source, GROUP):
        id_type = batch.schema.field("doc_id").type
        held += zip(*[c.to_pylist() for c in batch.columns])
        out = flush()
        held = held[-1:]
        if out is not None:
            yield out


def _counted(sizes: list[int], value: Column, bounds: Column, n: int) -> Column:
    """Number of sorted bounds at most value, by binary search."""
    return F.aggregate(
        F.array(*[F.lit(s) for s in sizes]), F.lit(0),
        lambda low, s: F.when((low + s <= n) & (F.try_element_at(bounds, low + s) <= value), low + s).otherwise(low),
    )


def with_following(docs: DataFrame, doc_id: str, text: str, buckets: int) -> DataFrame:
    """bucket, turn, doc_id, text: documents in contiguous doc_id ranges, each text moved once. The first document of a range is also
    copied behind the previous range (turn 1), and the first of all behind the last range (turn 2)."""
    ids = docs.select(F.col(doc_id).alias("doc_id"))
    quantiles = F.percentile_approx("doc_id", F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 10_000) if buckets > 1 else F.lit(None)
    q, low, nulls = ids.agg(quantiles, F.min("doc_id"), F.max(F.col("doc_id").isNull())).first()
    borders = sorted(set(q or []))
    n = len(borders)
    sizes = [1 << i for i in reversed(range(n.bit_length()))] or [1]
    bounds = F.array(*[F.lit(b) for b in borders]) if borders else F.array().cast("array<bigint>")
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), bounds.alias("bounds"))
    rows = rows.withColumn("own", F.coalesce(_counted(sizes, F.col("doc_id"), F.col("bounds"), n), F.lit(0)))
    opens = F.coalesce((F.col("own") > 0) & (F.try_element_at("bounds", F.greatest("own", F.lit(1))) == F.col("doc_id")), F.lit(False))
    first = F.col("doc_id").isNull() if nulls else F.coalesce(F.col("doc_id") == F.lit(low), F.lit(False))
    place = lambda bucket, turn: F.struct(bucket.cast("int").alias("bucket"), F.lit(turn).alias("turn"))
    places = F.concat(
        F.array(place(F.col("own"), 0)), F.when(opens, F.array(place(F.col("own") - 1, 1))).otherwise(F.array()),
        F.when(first, F.array(place(F.lit(n), 2))).otherwise(F.array()),
    )
    placed = rows.select(F.explode(places).alias("p"), "doc_id", "text").select("p.bucket", "p.turn", "doc_id", "text")
    return placed.repartition("bucket").sortWithinPartitions(
        "bucket", "turn", F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), "text"
    )


def edited_fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A null text counts as empty. Null doc_ids come first; repeated doc_ids follow each other by a hash of the text,
    then the text, so repeated rows have each other as next. The last document's next is the first, a single
    document's its own. Empty texts have the zero fingerprint and are alike only to texts without paragraphs. An
    empty table gives an empty result; other columns of docs are not read. doc_id must be numeric."""
    n = buckets or min(4095, 4 * shuffle_width(docs.sparkSession))
    rows = with_following(docs, doc_id, text, n)
    return rows.mapInArrow(_neighbours, ", ".join(f"{c} {t}" for c, t in zip(NAMES, [dict(docs.dtypes)[doc_id], *TYPES])))

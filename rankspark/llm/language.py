"""Language ID: multinomial naive Bayes over hashed character n-grams.

Counting is a Spark job over every training document; each task adds up its own counts per language first. The model, one row of log
probabilities per bin and one column per language, has a size fixed by the number of bins and languages and is broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankspark.llm.text import fold_of, text_of
from rankspark.llm.words import batches, blocks, mix

BINS = 1 << 15
ORDERS = (1, 2, 3)
SMOOTH = 0.5
MAX_LANGUAGES = 512
UNKNOWN = "und"


def ngram_bins(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(text number, bins of its character n-grams). Texts are lower-cased; every maximal run of anything but letters counts as
    one space, so digits, marks and white space carry no weight of their own."""
    raw = [t.lower() for t in texts]
    for a, b in blocks(raw, 1 << 19):
        chars = np.frombuffer("\n".join(raw[a:b]).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        edges = np.concatenate([[0], np.cumsum([len(t) + 1 for t in raw[a:b]])])
        letter = _letters(chars)
        codes = np.where(letter, chars, np.uint32(32)).astype(np.uint64)
        if not len(codes):
            continue
        keep = letter.copy()
        keep[1:] |= letter[:-1]  # the first of a run of spaces
        at = np.flatnonzero(keep)
        codes = codes[at]
        h, grams = codes * np.uint64(0x9E3779B97F4A7C15), []
        for n in ORDERS:
            if n > 1:
                h = h[:-1] * np.uint64(0xD1342543DE82EF95) + codes[n - 1 :]
            grams.append((mix(h + np.uint64(n)) % np.uint64(BINS)).astype(np.int64))
        for i in range(b - a):
            lo, hi = np.searchsorted(at, (edges[i], edges[i + 1] - 1))
            yield a + i, np.concatenate([g[lo : max(lo, hi - n + 1)] for n, g in zip(ORDERS, grams)])


_LETTER_TABLE: np.ndarray | None = None


def _letters(chars: np.ndarray) -> np.ndarray:
    global _LETTER_TABLE
    if _LETTER_TABLE is None:
        _LETTER_TABLE = np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER_TABLE[chars]


def count_ngrams(train: DataFrame, text: Column, lang: Column) -> DataFrame:
    """lang, bin, n over all training rows; bin -1 counts documents."""

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for part in batches(source):
            langs = part.column(1).to_pylist()
            for i, bins in ngram_bins(part.column(0).to_pylist()):
                own = counts.setdefault(langs[i], np.zeros(BINS + 1, dtype=np.int64))
                own[:BINS] += np.bincount(bins, minlength=BINS)
            for name in langs:
                counts.setdefault(name, np.zeros(BINS + 1, dtype=np.int64))[BINS] += 1
        for name, own in counts.items():
            used = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(used), pa.string()), pa.array(np.where(used == BINS, -1, used), pa.int32()), pa.array(own[used], pa.int64())],
                names=["lang", "bin", "n"],
            )

    parts = train.select(text.alias("text"), lang.alias("lang")).mapInArrow(work, "lang string, bin int, n bigint")
    return parts.groupBy("lang", "bin").agg(F.sum("n").alias("n"))


def fit(counts: DataFrame, max_languages: int = MAX_LANGUAGES) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages in order, log prior, and log probabilities (bins x languages). At most max_languages * (bins + 1) counts reach the driver."""
    table = counts.toArrow()
    langs = sorted(set(table.column("lang").to_pylist()))
    if len(langs) > max_languages:
        raise ValueError(f"{len(langs)} languages; raise max_languages")
    place = {name: i for i, name in enumerate(langs)}
    full = np.zeros((BINS + 1, len(langs)))
    cols = np.fromiter((place[x] for x in table.column("lang").to_pylist()), dtype=np.int64, count=table.num_rows)
    full[table.column("bin").to_numpy(), cols] = table.column("n").to_numpy()
    docs, grams = full[BINS], full[:BINS] + SMOOTH  # bin -1 is the last row
    return langs, np.log(docs / max(docs.sum(), 1.0)), np.log(grams / grams.sum(axis=0))


def identify_languages(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", folds: int = 5, held_out: int = 0) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score (posterior probability of lang_pred).

    Rows whose crc32(doc_id) mod folds is held_out, and rows without lang or text, are never learnt from. Texts that are
    null or hold no letter get `und` with score 0; so does everything when nothing can be learnt. Equal posteriors go to the
    first language in order. Repeated rows are scored alike; an empty table gives an empty result; other columns are not read."""
    spark = docs.sparkSession
    fold = fold_of(doc_id, folds)
    train = docs.where((fold != held_out) & F.col(lang).isNotNull() & F.col(text).isNotNull())
    langs, prior, logp = fit(count_ngrams(train, F.col(text), F.col(lang)))
    model = spark.sparkContext.broadcast((langs, prior, logp.astype(np.float32)))
    kind = dict(docs.dtypes)[doc_id]
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (fold == held_out).alias("held_out"), F.col(text).alias("text"), text_of(text).rlike(r"\p{L}").alias("readable"),
    )

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, start, table = model.value
        for part in batches(source):
            readable = part.column(3).to_pylist()
            texts = [t if ok else "" for t, ok in zip(part.column(2).to_pylist(), readable)]
            picked, score = [UNKNOWN] * part.num_rows, [0.0] * part.num_rows
            if names:
                for i, bins in ngram_bins(texts):
                    if readable[i]:
                        used, n = _sparse(bins)
                        total = start + n @ table[used].astype(np.float64)
                        best = int(np.argmax(total))
                        picked[i], score[i] = names[best], float(1.0 / np.exp(total - total[best]).sum())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(picked, pa.string()), pa.array(score, pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    return rows.mapInArrow(work, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def _sparse(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if len(bins) < 2048:
        return np.unique(bins, return_counts=True)
    n = np.bincount(bins, minlength=BINS)
    used = np.flatnonzero(n)
    return used, n[used]

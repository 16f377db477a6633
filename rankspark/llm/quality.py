"""Quality classifier by positive-unlabelled learning.

Trusted positives are documents labelled good; everything else, whatever its label, is unlabelled web text. A small network on text
statistics minimises the non-negative unbiased risk  prior * E_p[l(+)] + max(0, E_u[l(-)] - prior * E_p[l(-)]). The class prior is estimated
first: a positive-against-unlabelled model orders documents, and among the best of them the unlabelled share per positive share is
smallest where no bad document is left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.text import fold_of
from rankspark.llm.words import _IS_SPACE, batches, blocks, by_text, encoded, hash_words

MAX_POSITIVE, MAX_UNLABELLED = 4000, 6000  # the training sample
HIDDEN, EPOCHS, BATCH, RATE, SEED = 16, 30, 256, 0.005, 11
THRESHOLD = 0.7
N_STATS = 14
N_FEATURES = 256 + N_STATS


def features(texts: list[bytes]) -> np.ndarray:
    """Per text: square roots of its byte shares, then shares of letter cases, digits, marks and space, and how far words, word
    pairs and lines repeat. Every statistic is over the whole text."""
    out = np.zeros((len(texts), N_FEATURES), dtype=np.float32)
    for a, b in blocks(texts):
        table = hash_words(texts[a:b])
        size = np.fromiter((len(t) + 1 for t in texts[a:b]), dtype=np.int64, count=b - a)
        owner = np.repeat(np.arange(b - a), size)
        share = np.bincount(owner * 256 + table.data, minlength=(b - a) * 256).reshape(b - a, 256).astype(np.float64)
        share[:, 10] -= 1  # the line feed that ends the text in the block
        total = np.maximum(share.sum(axis=1), 1)
        share /= total[:, None]
        out[a:b, :256] = np.sqrt(share)
        edges = by_text(table.text, b - a)
        ends_mark = _MARK[table.data[table.end - 1]] if len(table.end) else np.zeros(0, dtype=bool)
        only_marks = _marked_only(table)
        for i in range(b - a):
            lo, hi = edges[i], edges[i + 1]
            h, n = table.hash[lo:hi], max(1, hi - lo)
            lines = texts[a + i].split(b"\n")
            distinct = len(np.unique(h))
            pairs = len(np.unique(h[1:] ^ (h[:-1] * np.uint64(3)))) if hi - lo > 1 else 1
            row = share[i]
            out[a + i, 256:] = [
                row[65:91].sum(), row[97:123].sum(), row[128:].sum(), row[48:58].sum(), row[_MARK].sum(), row[_IS_SPACE].sum(), row[_ODD].sum(),
                distinct / n, pairs / max(1, n - 1), len(set(lines)) / len(lines), np.log1p(hi - lo) / 10,
                (table.end[lo:hi] - table.start[lo:hi]).sum() / n / 10, ends_mark[lo:hi].sum() / n, only_marks[lo:hi].sum() / n,
            ]
    return out


_MARK = np.array([b < 128 and not chr(b).isalnum() and not _IS_SPACE[b] for b in range(256)])
_ODD = np.array([b < 128 and chr(b) in "#$%&*|^~<>{}[]=+_\\/@" for b in range(256)])


def _marked_only(table) -> np.ndarray:
    marks = np.concatenate([[0], np.cumsum(_MARK[table.data])])
    return marks[table.end] - marks[table.start] == table.end - table.start


class Network:
    """One hidden layer on standardised features; the output is the logit of being good."""

    def __init__(self, centre: np.ndarray, scale: np.ndarray, seed: int = SEED):
        rng = np.random.default_rng(seed)
        self.centre, self.scale = centre, scale
        n = len(centre)
        self.p = [rng.normal(0, n**-0.5, (n, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
        self.m = [(np.zeros_like(x), np.zeros_like(x)) for x in self.p]
        self.step = 0

    def forward(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        h = np.tanh(z @ self.p[0] + self.p[1])
        return z, h, h @ self.p[2] + self.p[3][0]

    def descend(self, z: np.ndarray, h: np.ndarray, delta: np.ndarray, rate: float) -> None:
        back = delta[:, None] * self.p[2] * (1 - h * h)
        grads = [z.T @ back + 1e-4 * self.p[0], back.sum(axis=0), h.T @ delta + 1e-4 * self.p[2], np.array([delta.sum()])]
        self.step += 1
        for p, g, (m, v) in zip(self.p, grads, self.m):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= rate * (m / (1 - 0.9**self.step)) / (np.sqrt(v / (1 - 0.99**self.step)) + 1e-8)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def risk_weights(logit_p: np.ndarray, logit_u: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray, bool]:
    """Derivatives of the risk by the logits of positives and unlabelled, with the logistic loss. When the estimate of the negative
    part falls below zero, the step climbs back along it instead (the non-negative correction)."""
    n_p, n_u = max(1, len(logit_p)), max(1, len(logit_u))
    up_p, up_u = sigmoid(logit_p), sigmoid(logit_u)  # derivative of l(-); that of l(+) is this minus 1
    loss = lambda x: np.logaddexp(0, x)
    negative = loss(logit_u).sum() / n_u - prior * loss(logit_p).sum() / n_p
    if negative < 0:
        return prior * up_p / n_p, -up_u / n_u, True
    return (prior * (up_p - 1) - prior * up_p) / n_p, up_u / n_u, False


def fit(xp: np.ndarray, xu: np.ndarray, prior: float, epochs: int = EPOCHS, seed: int = SEED) -> Network:
    both = np.concatenate([xp, xu])
    net = Network(both.mean(axis=0), both.std(axis=0) + 1e-3, seed)
    rng = np.random.default_rng(seed)
    steps = max(8, (len(both)) // BATCH)
    for epoch in range(epochs):
        order_p, order_u = rng.permutation(len(xp)), rng.permutation(len(xu))
        for part_p, part_u in zip(np.array_split(order_p, steps), np.array_split(order_u, steps)):
            z, h, out = net.forward(np.concatenate([xp[part_p], xu[part_u]]))
            dp, du, _ = risk_weights(out[: len(part_p)], out[len(part_p) :], prior)
            net.descend(z, h, np.concatenate([dp, du]), RATE * (1 - epoch / epochs) + 1e-4)
    return net


def estimate_prior(xp: np.ndarray, xu: np.ndarray, seed: int = SEED) -> float:
    """Share of good documents among the unlabelled. The model is fitted on one half and read on the other; a finite-sample margin is
    added to both shares, and only score levels that a fifth of the positives reach are looked at."""
    if len(xp) < 10 or len(xu) < 10:
        return 0.5
    net = fit(xp[::2], xu[::2], 0.5, epochs=8, seed=seed)
    sp, su = np.sort(net.forward(xp[1::2])[2]), np.sort(net.forward(xu[1::2])[2])
    levels = np.quantile(sp, np.linspace(0.01, 0.8, 80))
    share_p = 1 - np.searchsorted(sp, levels) / len(sp)
    share_u = 1 - np.searchsorted(su, levels) / len(su)
    margin = np.sqrt(np.log(20) / (2 * len(sp))) + np.sqrt(np.log(20) / (2 * len(su)))
    best = int(np.argmin((share_u + margin) / share_p))
    return float(np.clip(share_u[best] / share_p[best], 0.05, 0.97))


def training_features(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held_out: int,
                      max_positive: int, max_unlabelled: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the sample: at most max_positive documents labelled good and max_unlabelled of any label, all outside the
    held-out fold, first by a hash of doc_id."""
    own = fold_of("doc_id", folds) != held_out
    good = labels.where(own).groupBy("doc_id").agg(F.min(label).alias("_good")).where("_good = 1").select("doc_id")
    good = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive).select(F.col("doc_id").alias("_id"), F.lit(1).alias("_side"))
    rest = docs.select(F.col(doc_id).alias("doc_id")).where(own & F.col("doc_id").isNotNull())
    rest = rest.orderBy(F.xxhash64(F.lit(1), "doc_id"), "doc_id").limit(max_unlabelled).select(F.col("doc_id").alias("_id"), F.lit(0).alias("_side"))
    picked = good.unionByName(rest.distinct())
    rows = docs.select(F.col(doc_id).alias("_doc"), F.col(text).alias("_text"))
    found = rows.join(F.broadcast(picked), F.col("_doc") == F.col("_id")).select("_doc", "_side", "_text")

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(source):
            x = features(encoded(part.column(2)))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), N_FEATURES).cast(pa.list_(pa.float32()))],
                names=["_doc", "_side", "x"],
            )

    table = found.mapInArrow(work, f"_doc {dict(docs.dtypes)[doc_id]}, _side int, x array<float>").toArrow()
    table = table.sort_by([("_side", "ascending"), ("_doc", "ascending")])
    x = np.array(table.column("x").to_pylist(), dtype=np.float32).reshape(-1, N_FEATURES)
    side = table.column("_side").to_numpy()
    return x[side == 1], x[side == 0]


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", folds: int = 4,
                  held_out: int = 2, threshold: float = THRESHOLD, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only the text enters a score; a null text scores like an empty one. Labels of rows whose crc32(doc_id) mod folds is held_out are never
    read; a document with several label rows is good if all say so. Without trusted positives every score is 0. Repeated rows score
    alike; an empty table gives an empty result."""
    xp, xu = training_features(docs, labels, doc_id, text, label, folds, held_out, max_positive, max_unlabelled)
    net = fit(xp, xu, estimate_prior(xp, xu)) if len(xp) and len(xu) else None
    model = docs.sparkSession.sparkContext.broadcast(net)  # of fixed size

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = model.value
        for part in batches(source):
            score = sigmoid(net.forward(features(encoded(part.column(2))))[2]) if net else np.zeros(part.num_rows)
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, score double, predicted int")

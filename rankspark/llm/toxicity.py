"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word is the sum of a hashed word embedding and the sum of its hashed character n-gram embeddings over the root of their number, side by side. A window of words
runs through a gated recurrent unit in each direction; attention weights pool the states into one logit. A document's score is the
highest of all its overlapping windows. Labels are per document, so training alternates between picking each toxic document's most
suspect window and fitting those against the most suspect and random windows of clean documents.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.text import fold_of, text_of
from rankspark.llm.words import batches, blocks, hash_words, mix
from rankspark.session import cut_lineage

WORD_BINS, CHAR_BINS, NGRAMS = 1 << 14, 1 << 16, (3, 4, 5)
EMBED, HIDDEN = 8, 8
WINDOW = 16
MAX_PER_LABEL, MAX_TRAIN_CHARS = 1500, 8192  # the training sample: documents per label, and code points of each on average at most
EPOCHS, STEPS, BATCH, RATE, SEED = 6, 250, 128, 0.01, 7  # at least EPOCHS, and more until STEPS
THRESHOLD = 0.7
SEEN_TEXTS = 300_000
DECAY = 1e-4
MIN_BIN_TEXTS = 3  # embeddings of bins found in fewer training texts stay zero, as for unknown words

# Word bytes: ASCII letters, digits, apostrophe and everything beyond ASCII.
_APART = np.array([not (b >= 128 or chr(b).isalnum() or b == 39) for b in range(256)])


@dataclass
class Tokens:
    """Texts as word numbers: words of text i are index[edges[i]:edges[i + 1]] into the distinct words' features."""

    index: np.ndarray
    edges: np.ndarray
    word: np.ndarray  # bin of each distinct word
    gram: np.ndarray  # bins of the distinct words' n-grams, one after the other
    count: np.ndarray  # n-grams per distinct word


def tokens(texts: list[str]) -> Tokens:
    table = hash_words([t.lower().encode("utf-8", "replace") for t in texts], _APART)
    _, first, index = np.unique(table.hash, return_index=True, return_inverse=True)
    edges = np.searchsorted(table.text, np.arange(len(texts) + 1))
    # A separator stands before the first byte too, so that every word has a border on both sides.
    data = np.concatenate([[32], np.where(_APART[table.data], 32, table.data)]).astype(np.uint64)
    start, size = table.start[first], (table.end - table.start)[first]
    places, owners = [], []
    for n in NGRAMS:
        h = np.zeros(max(0, len(data) - n + 1), dtype=np.uint64)
        for j in range(n):
            h = h * np.uint64(0xD1342543DE82EF95) + data[j : len(data) - n + 1 + j]
        many = np.maximum(0, size + 3 - n)
        owner = np.repeat(np.arange(len(first)), many)
        at = start[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
        places.append((mix(h[at] + np.uint64(n)) % np.uint64(CHAR_BINS)).astype(np.int64))
        owners.append(owner)
    owner, gram = np.concatenate(owners), np.concatenate(places)
    order = np.argsort(owner, kind="stable")
    return Tokens(
        index.astype(np.int32), edges, (table.hash[first] % np.uint64(WORD_BINS)).astype(np.int64), gram[order], np.bincount(owner, minlength=len(first)),
    )


def windows(edges: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, length and text of every window: one starts at each word that has a whole window ahead, and texts shorter than
    that are one window."""
    n = np.diff(edges)
    many = np.where(n > 0, np.maximum(0, n - WINDOW) + 1, 0)
    text = np.repeat(np.arange(len(n)), many)
    step = np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many)
    first = edges[text] + step
    return first.astype(np.int32), np.minimum(WINDOW, edges[text + 1] - first).astype(np.int8), text.astype(np.int32)


Params = dict[str, np.ndarray]


def start_params(rng: np.random.Generator) -> Params:
    d, h = 2 * EMBED, HIDDEN
    p = {"word": rng.normal(0, 0.1, (WORD_BINS, EMBED)), "char": rng.normal(0, 0.1, (CHAR_BINS, EMBED)), "v": np.zeros(2 * h),
         "out": rng.normal(0, 0.3, 2 * h), "bias": np.zeros(1)}
    for side in "fb":
        p |= {f"{side}x": rng.normal(0, d**-0.5, (d, 3 * h)), f"{side}b": np.zeros(3 * h), f"{side}u": rng.normal(0, h**-0.5, (h, 3 * h))}
    return {k: v.astype(np.float32) for k, v in p.items()}


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


def word_vectors(p: Params, t: Tokens) -> np.ndarray:
    chars = np.zeros((len(t.word), EMBED), dtype=np.float32)
    full = np.flatnonzero(t.count)
    if len(full):
        chars[full] = np.add.reduceat(p["char"][t.gram], (np.cumsum(t.count) - t.count)[full], axis=0) / np.sqrt(t.count[full, None])
    return np.concatenate([p["word"][t.word], chars], axis=1)


def run(p: Params, side: str, at: np.ndarray, ready: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States (steps, windows, HIDDEN) of one direction. at holds word numbers (windows, steps), -1 where a window has ended;
    ready holds the distinct words' input sums. keep collects what the gradient needs."""
    n, steps = at.shape
    h = np.zeros((n, HIDDEN), dtype=np.float32)
    out = np.zeros((steps, n, HIDDEN), dtype=np.float32)
    u = p[f"{side}u"]
    for s in range(steps) if side == "f" else reversed(range(steps)):
        live = at[:, s] >= 0
        some = not live.all()
        rows = np.flatnonzero(live) if some else slice(None)
        old = h[rows]
        a, b = ready[at[rows, s]], old @ u
        gates = sigmoid(a[:, : 2 * HIDDEN] + b[:, : 2 * HIDDEN])
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        c = b[:, 2 * HIDDEN :]
        new = np.tanh(a[:, 2 * HIDDEN :] + r * c)
        state = new + z * (old - new)
        if keep is not None:
            keep.append((s, rows, old, z, r, c, new))
        if some:
            h[rows] = state
            out[s, rows] = state
        else:
            h = state
            out[s] = state
    return out


def logits(p: Params, at: np.ndarray, vectors: np.ndarray, tape: dict | None = None) -> np.ndarray:
    keeps = {"f": [], "b": []} if tape is not None else {"f": None, "b": None}
    states = np.concatenate([run(p, s, at, vectors @ p[f"{s}x"] + p[f"{s}b"], keeps[s]) for s in "fb"], axis=2)
    score = states @ p["v"]
    score[at.T < 0] = -np.inf
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = (weight[:, :, None] * states).sum(axis=0)
    if tape is not None:
        tape |= {"keeps": keeps, "states": states, "weight": weight, "pooled": pooled}
    return pooled @ p["out"] + p["bias"][0]


def gradients(p: Params, at: np.ndarray, vectors: np.ndarray, label: np.ndarray) -> tuple[Params, np.ndarray]:
    """Gradients of the mean logistic loss, and of the distinct words' vectors."""
    tape: dict = {}
    delta = ((sigmoid(logits(p, at, vectors, tape)) - label) / len(label)).astype(np.float32)
    states, weight, pooled = tape["states"], tape["weight"], tape["pooled"]
    g: Params = {"out": pooled.T @ delta, "bias": np.array([delta.sum()], dtype=np.float32)}
    back = delta[:, None] * p["out"]
    inner = (states * back).sum(axis=2)
    score = weight * (inner - (weight * inner).sum(axis=0))
    g["v"] = np.einsum("sn,snh->h", score, states)
    d_states = weight[:, :, None] * back + score[:, :, None] * p["v"]
    d_vectors = np.zeros_like(vectors)
    for k, side in enumerate("fb"):
        u, d_ready = p[f"{side}u"], np.zeros((len(vectors), 3 * HIDDEN), dtype=np.float32)
        gu = np.zeros_like(u)
        flow = np.zeros((at.shape[0], HIDDEN), dtype=np.float32)
        for s, rows, old, z, r, c, new in reversed(tape["keeps"][side]):
            d = flow[rows] + d_states[s, rows, k * HIDDEN : (k + 1) * HIDDEN]
            d_new = d * (1 - z) * (1 - new * new)
            d_gates = np.concatenate([d * (old - new) * z * (1 - z), d_new * c * r * (1 - r)], axis=1)
            d_b = np.concatenate([d_gates, d_new * r], axis=1)
            gu += old.T @ d_b
            flow[rows] = d * z + d_b @ u.T
            np.add.at(d_ready, at[rows, s], np.concatenate([d_gates, d_new], axis=1))
        g |= {f"{side}u": gu, f"{side}x": vectors.T @ d_ready, f"{side}b": d_ready.sum(axis=0)}
        d_vectors += d_ready @ p[f"{side}x"].T
    return g, d_vectors


def grid(t: Tokens, first: np.ndarray, length: np.ndarray) -> np.ndarray:
    steps = np.arange(int(length.max()))
    at = first[:, None] + steps
    return np.where(steps < length[:, None], t.index[np.minimum(at, len(t.index) - 1)], -1)


def stream_logits(p: Params, index: np.ndarray, vectors: np.ndarray, chunk: int = 2048, block: int = 1024) -> np.ndarray:
    """logits() of the windows that start at each word of one stream of words, the last WINDOW - 1 aside. Neighbouring windows read
    shifted slices of the same input sums, and of each state only its attention score and its part of the logit are kept. Products
    are taken in blocks below the size from which the linear algebra library starts threads."""
    n = len(index) - WINDOW + 1
    h2, h3 = 2 * HIDDEN, 3 * HIDDEN
    # sigmoid(x) = 1 / (1 + exp(-x)) and tanh(x) = 2 / (1 + exp(-2 x)) - 1, the factors taken into the weights.
    scale = np.concatenate([np.full(h2, -1.0), np.full(HIDDEN, -2.0), np.ones(2)]).astype(np.float32)
    ready, weights, alone = {}, {}, {}
    for k, side in enumerate("fb"):
        ready[side] = (vectors @ p[f"{side}x"] + p[f"{side}b"]) * scale[:h3]
        # A window's first state depends on its first word only, so it is made once for each distinct word.
        first = 2 / (1 + np.exp(ready[side][:, h2:])) - 1
        alone[side] = first - first / (1 + np.exp(ready[side][:, :HIDDEN]))
        ends = np.stack([p[x][k * HIDDEN : (k + 1) * HIDDEN] for x in ("v", "out")], axis=1)
        weights[side] = np.ascontiguousarray((np.concatenate([p[f"{side}u"], ends], axis=1) * scale).T)
    out = np.empty(n, dtype=np.float32)
    for i in range(0, n, chunk):
        m = min(chunk, n - i)
        words = index[i : i + m + WINDOW - 1]
        inputs = {side: np.ascontiguousarray(ready[side][words].T) for side in "fb"}
        score, value = np.zeros((WINDOW, m), dtype=np.float32), np.zeros((WINDOW, m), dtype=np.float32)
        gates, new = np.empty((h2, m), dtype=np.float32), np.empty((HIDDEN, m), dtype=np.float32)
        for side in "fb":
            steps = range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1)
            b = np.empty((h3 + 2, m), dtype=np.float32)
            h = np.ascontiguousarray(alone[side][words[steps[0] : steps[0] + m]].T)
            for s in steps:
                if s != steps[0]:
                    a = inputs[side][:, s : s + m]
                    np.add(a[:h2], b[:h2], out=gates)
                    np.exp(gates, out=gates)
                    gates += 1
                    np.reciprocal(gates, out=gates)
                    np.multiply(gates[HIDDEN:], b[h2:h3], out=new)
                    new += a[h2:]
                    np.exp(new, out=new)
                    new += 1
                    np.divide(2, new, out=new)
                    new -= 1
                    h -= new
                    h *= gates[:HIDDEN]
                    h += new
                for j in range(0, m, block):
                    np.matmul(weights[side], h[:, j : j + block], out=b[:, j : j + block])
                score[s] += b[-2]
                value[s] += b[-1]
        score -= score.max(axis=0)
        np.exp(score, out=score)
        value *= score
        out[i : i + m] = value.sum(axis=0) / score.sum(axis=0)
    return out + p["bias"][0]


def window_scores(p: Params, t: Tokens, chunk: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Logit and text of every window. Texts of at least WINDOW words are read as one stream; windows over a border are left out."""
    first, length, text = windows(t.edges)
    out, vectors = np.empty(len(first), dtype=np.float32), word_vectors(p, t)
    size = np.diff(t.edges)
    if (size >= WINDOW).any():
        owner = np.repeat(np.arange(len(size)), size)
        long = size[owner] >= WINDOW
        with np.errstate(over="ignore"):  # exp(-x) may be infinite; the gate is 0 then
            value = stream_logits(p, t.index[long], vectors)
        out[length == WINDOW] = value[(np.cumsum(long) - 1)[first[length == WINDOW]]]
    short = np.flatnonzero(length < WINDOW)
    short = short[np.argsort(-length[short], kind="stable")]
    for i in range(0, len(short), chunk):
        part = short[i : i + chunk]
        out[part] = logits(p, grid(t, first[part], length[part]), vectors)
    return out, text


def spans(t: Tokens, gram_start: np.ndarray, used: np.ndarray) -> np.ndarray:
    """The n-gram bins of some words, one after the other."""
    many = t.count[used]
    return t.gram[np.repeat(gram_start[used], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]


def log_odds(t: Tokens, label: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For word and character bins: how much more often a bin stands in toxic texts, and which bins are found in enough texts to
    be learnt. Texts are counted one by one, so memory does not follow the sample."""
    found = {name: np.zeros((2, size), dtype=np.int64) for name, size in (("word", WORD_BINS), ("char", CHAR_BINS))}
    start = np.cumsum(t.count) - t.count
    for i in range(len(label)):
        words = np.unique(t.index[t.edges[i] : t.edges[i + 1]])
        found["word"][label[i], np.unique(t.word[words])] += 1
        found["char"][label[i], np.unique(spans(t, start, words))] += 1
    odds = {}
    for name, (neg, pos) in found.items():
        ratio = np.log((pos + 0.5) / ((label == 1).sum() + 1)) - np.log((neg + 0.5) / ((label == 0).sum() + 1))
        known = pos + neg >= MIN_BIN_TEXTS
        odds[name] = np.where(known, ratio, 0.0), known
    return odds


def train(texts: list[str], label: np.ndarray, epochs: int = EPOCHS, steps: int = STEPS, seed: int = SEED) -> Params | None:
    """None unless both labels occur."""
    if not len(label) or label.min() == label.max():
        return None
    rng = np.random.default_rng(seed)
    p, t = start_params(rng), tokens(texts)
    gram_start = np.cumsum(t.count) - t.count
    known = {}
    for name, (odds, enough) in log_odds(t, label).items():
        p[name][:, 0], known[name] = 0.5 * odds, enough[:, None]
        p[name] *= known[name]
    first, length, text = windows(t.edges)
    hint = word_vectors(p, t)
    hint = (hint[:, 0] + hint[:, EMBED])[t.index]
    suspect = np.full(len(first), -np.inf, dtype=np.float32)
    for j in range(WINDOW):
        inside = np.flatnonzero(length > j)
        suspect[inside] = np.maximum(suspect[inside], hint[first[inside] + j])
    heads = np.flatnonzero(np.diff(text, prepend=-1))  # windows lie text by text
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
    step = epoch = 0
    while len(first) and (epoch < epochs or step < steps):
        if epoch:
            suspect, _ = window_scores(p, t)
        highest = np.repeat(np.maximum.reduceat(suspect, heads), np.diff(np.append(heads, len(text))))
        hits = np.flatnonzero(suspect == highest)
        top = hits[np.flatnonzero(np.diff(text[hits], prepend=-1))]
        clean = label[text] == 0
        clean[top] = False
        clean = np.flatnonzero(clean)
        chosen = np.concatenate([top, rng.choice(clean, min(len(clean), len(top)), replace=False)])
        rng.shuffle(chosen)
        epoch += 1
        for i in range(0, len(chosen), BATCH):
            part = chosen[i : i + BATCH]
            at = grid(t, first[part], length[part])
            used, local = np.unique(at[at >= 0], return_inverse=True)
            at[at >= 0] = local
            sub = Tokens(used, used, t.word[used], spans(t, gram_start, used), t.count[used])
            vectors = word_vectors(p, sub)
            g, dv = gradients(p, at, vectors, label[text[part]].astype(np.float32))
            g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
            np.add.at(g["word"], sub.word, dv[:, :EMBED])
            np.add.at(g["char"], sub.gram, np.repeat(dv[:, EMBED:] / np.sqrt(np.maximum(sub.count, 1))[:, None], sub.count, axis=0))
            step += 1
            for k, x in g.items():
                m, v = moments[k]
                x = (x + DECAY * p[k]) * known[k] if k in known else x
                m += 0.1 * (x - m)
                v += 0.01 * (x * x - v)
                p[k] -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return p


def score_texts(p: Params, texts: list[str]) -> np.ndarray:
    """Highest window probability of each text; 0 for texts without words."""
    out = np.zeros(len(texts))
    for a, b in blocks(texts, 1 << 20):
        t = tokens(texts[a:b])
        if len(t.index):
            value, text = window_scores(p, t)
            best = np.full(b - a, -np.inf)
            np.maximum.at(best, text, value)
            out[a:b] = sigmoid(best)
    return out


def labelled_sample(docs: DataFrame, labels: DataFrame, column: str, doc_id: str, text: str, folds: int, held_out: int,
                    per_label: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """Texts and labels of at most per_label documents of each label outside the held-out fold, with at most per_label * max_chars code points
    together. Labels meet documents first; then documents within max_chars come before longer ones, each in the order of a hash, and longer
    ones are taken while the whole allowance lasts. Several label rows of a document count as its largest label, equal rows as one."""
    known = labels.where(F.col(column).isNotNull() & (fold_of("doc_id", folds) != held_out)).groupBy("doc_id").agg(F.max(column).alias("_label"))
    rows = docs.select(F.col(doc_id).alias("_doc"), text_of(text).alias("_text"))
    names = rows.select("_doc", F.length("_text").alias("_size"), F.xxhash64("_text").alias("_hash")).join(
        known.select(F.col("doc_id").alias("_doc"), "_label"), "_doc"
    ).distinct()
    order = [F.col("_size") > max_chars, F.xxhash64("_doc"), F.col("_doc"), F.col("_hash")]
    sides = []
    for side in (0, 1):
        first = names.where(F.col("_label") == side).orderBy(*order).limit(per_label)
        total = F.sum("_size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))  # over at most per_label rows
        sides.append(first.withColumn("_total", total).where(F.col("_total") <= per_label * max_chars))
    few = cut_lineage(sides[0].unionByName(sides[1]).select(F.col("_doc").alias("_id"), F.col("_hash").alias("_key"), "_label"))
    picked = rows.join(F.broadcast(few), (F.col("_doc") == F.col("_id")) & (F.xxhash64("_text") == F.col("_key")))  # at most 2 * per_label rows
    found = picked.select("_doc", "_text", "_label").dropDuplicates(["_doc", "_text"]).toArrow()
    found = found.sort_by([("_doc", "ascending"), ("_text", "ascending")])
    return found.column("_text").to_pylist(), found.column("_label").to_numpy().astype(np.int64)


def fitted(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str, folds: int, held_out: int, per_label: int, max_chars: int):
    """The trained network as a broadcast variable of fixed size: the tables of hashed embeddings."""
    p = train(*labelled_sample(docs, labels, label, doc_id, text, folds, held_out, per_label, max_chars))
    return docs.sparkSession.sparkContext.broadcast((uuid.uuid4().hex, p))


_SEEN: dict[str, dict[bytes, float]] = {}  # of the network in use, scores by text digest


def batch_scores(model: tuple[str, Params | None], column: pa.Array) -> np.ndarray:
    """Scores of a batch. A worker remembers the scores it gave, so that copies of a text are scored once while they are remembered."""
    name, p = model
    if p is None:
        return np.zeros(len(column))
    if name not in _SEEN:
        _SEEN.clear()
        _SEEN[name] = {}
    seen = _SEEN[name]
    if len(seen) > SEEN_TEXTS:
        seen.clear()
    texts = [t or "" for t in column.to_pylist()]
    keys = [hashlib.blake2b(t.encode(), digest_size=16).digest() for t in texts]
    new = {k: t for k, t in zip(keys, texts) if k not in seen}
    seen.update(zip(new, score_texts(p, list(new.values())).tolist()))
    return np.array([seen[k] for k in keys])


def score_toxicity(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3,
                   held_out: int = 1, threshold: float = THRESHOLD, per_label: int = MAX_PER_LABEL, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """One row per row of docs: doc_id, held_out, score, predicted.

    Only the text enters a score. Labels of rows whose crc32(doc_id) mod folds is held_out are never read; null labels are ignored.
    Null, empty and wordless texts score 0. Without labels of both kinds nothing can be learnt and every score is 0. Every text is
    scored whole, in every window of 16 words. Repeated rows score alike; an empty table gives an empty result."""
    model = fitted(docs, labels, doc_id, text, label, folds, held_out, per_label, max_chars)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(source):
            score = batch_scores(model.value, part.column(2))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), (fold_of(doc_id, folds) == held_out).alias("held_out"), F.col(text).alias("text"))
    return rows.mapInArrow(work, f"doc_id {dict(docs.dtypes)[doc_id]}, held_out boolean, score double, predicted int")


def drop_toxic(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic", folds: int = 3,
               held_out: int = 1, threshold: float = THRESHOLD, per_label: int = MAX_PER_LABEL, max_chars: int = MAX_TRAIN_CHARS) -> DataFrame:
    """The rows of docs, with their own columns, whose score is below the threshold; scores as in score_toxicity."""
    model = fitted(docs, labels, doc_id, text, label, folds, held_out, per_label, max_chars)
    place = docs.columns.index(text)

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in batches(source):
            yield part.filter(pa.array(batch_scores(model.value, part.column(place)) < threshold))

    return docs.mapInArrow(work, docs.schema)

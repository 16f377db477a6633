"""Harmonic packing of token sequences.

With a capacity C, class k holds pieces of at most C/k tokens, and k of them fill a bin. Documents are cut so that their pieces are exactly
C, C/2, C/4, ... down to C/64, where k pieces leave no room, and one tail below C/64; tails are the last class and are packed
next-fit. Every worker fills the bins of its own documents, class by class, so nothing is shuffled and no order is
shared. A worker's bins still open at its end are closed at lengths that are powers of two, which need no padding.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankspark.llm.words import batches

CAPACITY, LEAST, END_ID = 4096, 64, 2
CACHE_WORDS = 1_000_000
_CACHES: dict[str, "WordCache"] = {}


class WordCache:
    """Token ids of white-space-separated words, kept as little-endian bytes.

    The tokenizer drops white space and never joins across it, so a text's ids are its words' ids in order. New words are encoded
    together, separated by spaces, and told apart by the ids that end a word part, of which the tokenizer's own pattern gives the number. The cache is emptied when full."""

    def __init__(self, path: str, limit: int = CACHE_WORDS):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.limit, self.known = limit, {}
        vocab = self.tokenizer.get_vocab()
        split = json.loads(self.tokenizer.to_str())["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.parts = regex.compile(split).findall
        self.ends = np.zeros(max(vocab.values()) + 1, dtype=bool)
        for token, i in vocab.items():
            self.ends[i] = token.endswith("</w>")

    def _plain(self, text: str) -> np.ndarray:
        return np.asarray(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4")

    def learn(self, new: list[bytes]) -> None:
        if len(self.known) + len(new) > self.limit:
            self.known.clear()
        for i in range(0, len(new), 4096):
            part = new[i : i + 4096]
            texts = [w.decode() for w in part]
            ids = self._plain(" ".join(texts))
            stops = np.flatnonzero(self.ends[ids]) + 1
            parts = np.cumsum([len(self.parts(unicodedata.normalize("NFC", t))) for t in texts])
            if len(stops) == parts[-1]:  # the last id of each word's last part ends the word
                raw, a = ids.tobytes(), 0
                for w, b in zip(part, (4 * stops[parts - 1]).tolist()):
                    self.known[w] = raw[a:b]
                    a = b
            else:
                for w, t in zip(part, texts):
                    self.known[w] = self._plain(t).tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        # A text with "<|" may hold a special token, which is matched before lower-casing; it is encoded as it is.
        split = [None if "<|" in t else t.encode().lower().split() for t in texts]
        distinct = set().union(*filter(None, split))
        known = self.known
        new = [w for w in distinct if w not in known]
        if len(known) + len(new) > self.limit:
            new = list(distinct)
        if new:
            self.learn(new)
        get = known.__getitem__
        return [self._plain(t).tobytes() if ws is None else b"".join(map(get, ws)) for t, ws in zip(texts, split)]


def tokenizer_cache(path: str) -> WordCache:
    if path not in _CACHES:
        _CACHES[path] = WordCache(path)
    return _CACHES[path]


def cut_sizes(tokens: int, capacity: int = CAPACITY, least: int = LEAST) -> list[int]:
    """Piece lengths of a document: whole bins, then each reciprocal class at most once, then the tail."""
    sizes = [capacity] * (tokens // capacity)
    rest, size = tokens % capacity, capacity // 2
    while size >= least:
        if rest >= size:
            sizes.append(size)
            rest -= size
        size //= 2
    return sizes + [rest] if rest else sizes


Piece = tuple[object, int, int, bytes, int]  # doc_id, start, length, ids, doc_tokens


class Bins:
    """The open bins of one worker. put and close hand on finished pieces as (piece, sequence, offset)."""

    def __init__(self, emit: Callable[[Piece, int, int], None], first_sequence: int, capacity: int = CAPACITY, least: int = LEAST):
        self.emit, self.next, self.capacity, self.least = emit, first_sequence, capacity, least
        self.open: dict[int, list[Piece]] = {}
        self.tails: list[Piece] = []
        self.tail_tokens = 0

    def _sequence(self, pieces: list[Piece]) -> None:
        offset = 0
        for p in pieces:
            self.emit(p, self.next, offset)
            offset += p[2]
        self.next += 1

    def put(self, piece: Piece) -> None:
        size = piece[2]
        if size >= self.least:
            held = self.open.setdefault(size, [])
            held.append(piece)
            if len(held) * size == self.capacity:
                self._sequence(held)
                held.clear()
        else:
            if self.tail_tokens + size > self.capacity:
                self._sequence(self.tails)
                self.tails, self.tail_tokens = [], 0
            self.tails.append(piece)
            self.tail_tokens += size

    def close(self) -> None:
        for held in self.open.values():
            while held:
                n = 1 << (len(held).bit_length() - 1)
                self._sequence(held[:n])
                del held[:n]
        rest = self.tails
        while rest:
            room, taken = 1 << (sum(p[2] for p in rest).bit_length() - 1), []
            while room:
                doc, start, size, ids, total = rest.pop(0)
                if size > room:
                    rest.insert(0, (doc, start + room, size - room, ids[4 * room :], total))
                    size, ids = room, ids[: 4 * room]
                taken.append((doc, start, size, ids, total))
                room -= size
            self._sequence(taken)
        self.tails, self.tail_tokens = [], 0


def pack(docs: DataFrame, tokenizer_path: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, if asked for, ids.

    A document is its text's ids (null: empty) and the end id, so an empty text is one token. Sequences hold at most 4096 tokens;
    one whose length is a power of two needs no padding, every other is padded to 4096. Repeated rows and doc_ids are separate
    documents, null doc_ids stay null. sequence_id is the task's number and a counter; a lost task is redone alone and whole.
    Memory is bounded by one document's ids and fewer than 4096 tokens per class. An empty table gives an empty result."""
    kind = dict(docs.dtypes)[doc_id]
    fields = ["start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = tokenizer_cache(tokenizer_path)
        done: list[tuple] = []

        def emit(p: Piece, sequence: int, offset: int) -> None:
            row = (p[0], p[1], p[2], zlib.crc32(p[3]), p[4], sequence, offset)
            done.append(row + (np.frombuffer(p[3], dtype="<u4").astype(np.int32),) if with_ids else row)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows))
            arrays = [pa.array(cols[0], type=id_type)] + [pa.array(c, type=pa.int64()) for c in cols[1:7]]
            names = ["doc_id", *fields]
            if with_ids:
                arrays.append(pa.array(cols[7], type=pa.list_(pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        bins, id_type = Bins(emit, TaskContext.get().partitionId() << 36), None
        for part in batches(source, 64):
            id_type = part.schema.field(0).type
            texts = [t or "" for t in part.column(1).to_pylist()]
            end = np.array([END_ID], dtype="<u4").tobytes()
            for d, ids in zip(part.column(0).to_pylist(), cache.encode(texts)):
                ids += end
                total, start = len(ids) // 4, 0
                for size in cut_sizes(total):
                    bins.put((d, start, size, ids[4 * start : 4 * (start + size)], total))
                    start += size
            if len(done) >= 4096:
                yield batch(done)
                done.clear()
        bins.close()
        if done:
            yield batch(done)

    schema = f"doc_id {kind}, " + ", ".join(f"{c} bigint" for c in fields) + (", ids array<int>" if with_ids else "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)

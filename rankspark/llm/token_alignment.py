"""Alignment of the token sequences that two tokenizers make of one text.

Both sequences are lists of byte ends. At a given shift between their indices the lists are compared in steps that double while the ends agree and halve
where they do not, so a stretch of one-to-one tokens is jumped in a few comparisons of slices. At its end the irregular group is walked token by token
until both lists end at one byte again, which gives the next shift.

Words that follow a space are tokenized alone by both tokenizers, so a task encodes and aligns each word it has not met yet, many joined to one sequence,
and puts a text's groups and links together from its words. How many documents hold a pair of tokens linked is counted over the corpus; the counts
come back to the documents in blocks of bounded size.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rankspark.llm.words import batches
from rankspark.session import cut_lineage

BLOCK_ROWS = 1 << 21  # token pairs whose counts are broadcast at once
CACHE_WORDS, CACHE_BYTES = 250_000, 64 << 20  # of each of the two generations of words a worker keeps
JOINED = 2048  # new words encoded together
_SPACE = "▁"
_AFTER_WORD = re.compile(r"(?<=\S) ")
_CACHES: dict[tuple[str, str], "PairCache"] = {}


def group_stops(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Indices past the last token of each group in both lists of byte ends, which never fall and end alike. A group is a smallest run of tokens that
    ends at one byte in both lists."""
    stops_a: list[int] = []
    stops_b: list[int] = []
    i, j, n, m = 0, 0, len(a), len(b)
    while i < n and j < m:
        if a[i] == b[j]:
            shift, met, step, last = j - i, i + 1, 1, min(n, m - j + i)
            while met < last:  # probe ahead while the ends agree at this shift
                stop = min(met + step, last)
                if a[met:stop] == b[met + shift : stop + shift]:
                    met, step = stop, step * 2
                else:
                    break
            while met < last and step > 1:  # the first difference lies within the last step
                step //= 2
                stop = min(met + step, last)
                if a[met:stop] == b[met + shift : stop + shift]:
                    met = stop
            stops_a.extend(range(i + 1, met + 1))
            stops_b.extend(range(j + 1, met + shift + 1))
            i, j = met, met + shift
        else:
            x, y = a[i], b[j]
            while x != y:  # the irregular group, walked to its common end
                if x < y:
                    i += 1
                    x = a[i]
                else:
                    j += 1
                    y = b[j]
            i, j = i + 1, j + 1
            stops_a.append(i)
            stops_b.append(j)
    return stops_a, stops_b


def links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A index, B index and last byte of every pair of tokens with a common byte: between two neighbouring ends lies one token of each."""
    cuts = np.union1d(a, b)
    return np.searchsorted(a, cuts), np.searchsorted(b, cuts), cuts


def byte_level() -> dict[str, int]:
    """The byte-level characters: printable bytes stand for themselves, others follow from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


# What a text takes from one word (with the space before it): number of A and of B tokens, number of groups, groups as text, and a code
# per link, little-endian 32-bit numbers a * width + b.
WordPairs = tuple[int, int, int, str, bytes]


class PairCache:
    """Both tokenizers, and the aligned tokens of words met before; words that differ from what their tokens spell are None. Words are kept in two
    generations: when the younger is full it becomes the older, whose words come back when they are met again and are forgotten otherwise."""

    def __init__(self, byte_path: str, piece_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(byte_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=piece_path)
        table = byte_level()
        self.a_bytes = [b""] * (max(self.a.get_vocab().values()) + 1)
        for token, i in self.a.get_vocab().items():
            self.a_bytes[i] = bytes(table[c] for c in token) if all(c in table for c in token) else token.encode()
        self.width = self.b.vocab_size()
        self.b_bytes = [self._piece(i) for i in range(self.width)]
        self.a_sizes, self.b_sizes = [np.array([len(x) for x in t], dtype=np.int64) for t in (self.a_bytes, self.b_bytes)]
        self.a_names, self.b_names = [[str(i) for i in range(len(t))] for t in (self.a_bytes, self.b_bytes)]
        # No piece goes on with a space after another character, so no piece crosses from one word into the next.
        self.by_word = not any(_SPACE in p.lstrip(_SPACE) for p in map(self.b.id_to_piece, range(self.width)))
        self.known: dict[str, WordPairs | None] = {}
        self.older: dict[str, WordPairs | None] = {}
        self.held = 0

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(_SPACE, " ").encode()

    def ends(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray] | None:
        """Token ids and byte ends of a space and the text in both tokenizers; None where one does not spell it."""
        whole = b" " + text.encode()
        a = self.a.encode_batch_fast([" " + text], add_special_tokens=False)[0].ids
        b = self.b.encode(text)
        out = []
        for ids, table, sizes in ((a, self.a_bytes, self.a_sizes), (b, self.b_bytes, self.b_sizes)):
            if b"".join(map(table.__getitem__, ids)) != whole:
                return None
            ids = np.asarray(ids, dtype=np.int64)
            out += [ids, np.cumsum(sizes[ids])]
        return out[0], out[1], out[2], out[3]

    def learn(self, words: list[str]) -> list[WordPairs | None]:
        """Tokens of words that each follow a space, encoded and aligned as one text; halved where that text is not spelt or a word has no border."""
        found = self.ends(" ".join(words))
        if found is not None:
            made = self._split(words, *found)
            if made is not None:
                return made
        if len(words) == 1:
            return [None]
        half = len(words) // 2
        return self.learn(words[:half]) + self.learn(words[half:])

    def _split(self, words: list[str], a: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_end: np.ndarray) -> list[WordPairs] | None:
        ends = a_end.tolist()
        stops_a, stops_b = group_stops(ends, b_end.tolist())
        group_end = [ends[i - 1] for i in stops_a]
        borders = np.cumsum([1 + len(w.encode()) for w in words])
        last = np.searchsorted(group_end, borders)
        if last[-1] >= len(group_end) or (np.asarray(group_end)[last] != borders).any():
            return None
        names_a, names_b = list(map(self.a_names.__getitem__, a.tolist())), list(map(self.b_names.__getitem__, b.tolist()))
        texts, i, j = [], 0, 0
        for p, q in zip(stops_a, stops_b):
            texts.append(f"{names_a[i] if p - i == 1 else ','.join(names_a[i:p])}|{names_b[j] if q - j == 1 else ','.join(names_b[j:q])}")
            i, j = p, q
        in_a, in_b, cuts = links(a_end, b_end)
        codes = (a[in_a] * self.width + b[in_b]).astype("<u4").tobytes()
        bytes_at = (4 * (np.searchsorted(cuts, borders) + 1)).tolist()
        out, group, in_a, in_b, at = [], 0, 0, 0, 0
        for past, stop in zip((last + 1).tolist(), bytes_at):
            p, q = stops_a[past - 1], stops_b[past - 1]
            out.append((p - in_a, q - in_b, past - group, ";".join(texts[group:past]), codes[at:stop]))
            group, in_a, in_b, at = past, p, q, stop
        return out

    def tail(self, word: str) -> WordPairs | None:
        """A last word that is empty or ends in white space, encoded behind a letter, whose own tokens are left out."""
        found = self.ends("x " + word)
        if found is None:
            return None
        pair = self._split(["x", word], *found)
        return pair[1] if pair else None

    def words_of(self, text: str) -> list[str]:
        return _AFTER_WORD.split(text) if self.by_word else [text]

    def look_up(self, words: set[str]) -> dict[str, WordPairs | None]:
        if len(self.known) > CACHE_WORDS or self.held > CACHE_BYTES:
            self.older, self.known, self.held = self.known, {}, 0
        known, older, new = self.known, self.older, []
        for w in words:
            if w not in known:
                if w in older:
                    known[w] = older[w]
                else:
                    new.append(w)
        last = [w for w in new if not w or w[-1].isspace()]
        rest = [w for w in new if w and not w[-1].isspace()]
        made = [(w, self.tail(w)) for w in last] if self.by_word else list(zip(last, (self.learn([w])[0] for w in last)))
        at = 0
        while at < len(rest):
            part, size = [], 0
            while at < len(rest) and len(part) < JOINED and size < 1 << 16:
                part.append(rest[at])
                size += len(rest[at])
                at += 1
            made += zip(part, self.learn(part))
        known.update(made)
        self.held += sum(len(w) + (len(p[3]) + len(p[4]) if p else 0) for w, p in made)
        return known


def pair_cache(byte_path: str, piece_path: str) -> PairCache:
    if (byte_path, piece_path) not in _CACHES:
        _CACHES[byte_path, piece_path] = PairCache(byte_path, piece_path)
    return _CACHES[byte_path, piece_path]


def aligned_texts(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str, text: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, groups, groups_sha256, codes (distinct pairs, a * width of B + b), times (links of each)."""
    kind = dict(docs.dtypes)[doc_id]
    names = ["n_a", "n_b", "n_groups", "n_links", "groups_sha256", "codes", "times"]
    types = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]
    nothing = (0, 0, 0, 0, "", [], [])

    def row(cache: PairCache, text: str) -> tuple:
        if not text:
            return nothing
        words = cache.words_of(text)
        known = cache.look_up(set(words))
        parts = [known[w] for w in words]
        if None in parts:
            return nothing
        codes, times = np.unique(np.frombuffer(b"".join([p[4] for p in parts]), dtype="<u4"), return_counts=True)
        groups = ";".join([p[3] for p in parts])
        return (
            sum([p[0] for p in parts]), sum([p[1] for p in parts]), sum([p[2] for p in parts]), int(times.sum()),
            hashlib.sha256(groups.encode()).hexdigest(), codes.astype(np.int64), times.astype(np.int32),
        )

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = pair_cache(byte_path, piece_path)
        for part in batches(source, 64):
            rows = [row(cache, t or "") for t in part.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, type=t) for c, t in zip(zip(*rows), types))], names=["doc_id", *names])

    schema = f"doc_id {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, codes array<bigint>, times array<int>"
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(work, schema)


def linked_pairs(aligned: DataFrame, width: int) -> DataFrame:
    """code, n_docs (documents that hold the pair linked) and best: whether no other pair of its first token stands in more documents."""
    counts = aligned.select(F.explode("codes").alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n_docs"))
    first = Window.partitionBy(F.floor(F.col("code") / width))  # at most one row per token of the second vocabulary
    return counts.withColumn("best", F.col("n_docs") == F.max("n_docs").over(first))


def add_counts(rows: DataFrame, block: DataFrame) -> DataFrame:
    """rows with the links of one block of pairs added to n_best and count_sum."""
    table = block.select("code", "n_docs", "best").toArrow().combine_chunks()  # about BLOCK_ROWS rows
    order = np.argsort(table["code"].to_numpy())
    held = rows.sparkSession.sparkContext.broadcast(
        (table["code"].to_numpy()[order], table["n_docs"].to_numpy()[order], table["best"].to_numpy(zero_copy_only=False)[order])
    )
    place = {c: i for i, c in enumerate(rows.columns)}

    def work(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, n_docs, best = held.value
        for part in batches(source, 1024):
            codes, times = part.column(place["codes"]), part.column(place["times"])
            wanted, owner = codes.flatten().to_numpy(), np.repeat(np.arange(part.num_rows), codes.value_lengths().to_numpy())
            at = np.searchsorted(code, wanted)
            hit = np.flatnonzero(code[np.minimum(at, len(code) - 1)] == wanted) if len(code) else np.zeros(0, dtype=np.int64)
            at, owner, many = at[hit], owner[hit], times.flatten().to_numpy()[hit].astype(np.int64)
            added = []
            for name, value in (("n_best", many * best[at]), ("count_sum", many * n_docs[at])):
                total = part.column(place[name]).to_numpy().copy()
                np.add.at(total, owner, value)
                added.append(pa.array(total))
            kept = [c for c in part.schema.names if c not in ("n_best", "count_sum")]
            yield pa.RecordBatch.from_arrays([*(part.column(place[c]) for c in kept), *added], names=[*kept, "n_best", "count_sum"])

    return rows.mapInArrow(work, rows.schema)


def align_tokens(docs: DataFrame, byte_path: str, piece_path: str, doc_id: str = "doc_id", text: str = "text", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256, codes, times.

    A is the byte-level tokenizer on a space and the text, B the piece tokenizer on the text, which puts the space itself. Bytes at which tokens of both end
    cut them into groups; a link is an A and a B token with a common byte. codes are the linked id pairs as a * (vocabulary of B) + b, times how
    many links each has. n_docs of a pair counts the rows of docs that hold it linked, so repeated rows count as often as they stand; count_sum adds it over a row's links,
    n_best counts links whose pair has its A id's highest n_docs, ties included. A text that is null, empty or not spelt by the tokens of either tokenizer has zeros and
    an empty groups_sha256. Memory follows one text and a bounded cache. Null ids stay null, no other column is read, an empty table gives an empty result."""
    aligned = cut_lineage(aligned_texts(docs, byte_path, piece_path, doc_id, text))
    import sentencepiece

    width = sentencepiece.SentencePieceProcessor(model_file=piece_path).vocab_size()
    pairs = cut_lineage(linked_pairs(aligned, width))
    blocks = max(1, math.ceil(pairs.count() / block_rows))
    zero = F.lit(0).cast("long")
    rows = aligned.withColumns({"n_best": zero, "count_sum": zero})
    for k in range(blocks):
        block = pairs if blocks == 1 else pairs.where(F.pmod(F.xxhash64("code"), F.lit(blocks)) == k)
        rows = add_counts(rows, block)
        if k + 1 < blocks:
            rows = cut_lineage(rows)
    return rows

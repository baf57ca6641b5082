"""Byte-level BPE encoding and decoding in numpy.

A text is split by the vocabulary's pattern. The distinct pieces of a slice of texts are laid
out by length in padded matrices of token ids, and every row merges its leftmost pair of
minimum rank in each round: a pair's rank comes from an open-addressing hash table, the second
token of the merged pair is taken out by compacting the matrix (each live row loses one cell),
and rows without a mergeable pair leave. Decoding gathers the tokens' bytes.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from .shared import byte_slices, col, frugal, with_fields

PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

_NONE = np.int32(2**31 - 1)
#: Pieces of more bytes than this are merged with a heap, row by row: a matrix round would cost their whole width.
_WIDEST = 4096


class _Numbers(dict):
    """Numbers its keys in the order they are first asked for."""

    def __missing__(self, key: str) -> int:
        n = self[key] = len(self)
        return n


class ByteBPE:
    """Vocabulary of ``rank file`` lines (base64 token, blank, id); the id is the merge rank."""

    def __init__(self, rank_file: bytes, pattern: str = PATTERN) -> None:
        self.ranks = {base64.b64decode(t): int(i) for t, i in (line.split() for line in rank_file.splitlines() if line)}
        self.pattern = regex.compile(pattern)
        top = max(self.ranks.values()) + 1
        tokens = [b""] * top
        for t, i in self.ranks.items():
            tokens[i] = t
        self.size = np.array([len(t) for t in tokens], dtype=np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.size)[:-1]])
        self.bytes = np.frombuffer(b"".join(tokens), dtype=np.uint8)
        missing = [b for b in range(256) if bytes([b]) not in self.ranks]
        if missing:
            raise ValueError(f"the vocabulary lacks the single bytes {missing[:5]}")
        self.byte_id = np.array([self.ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [(a, b, i) for t, i in self.ranks.items() for k in range(1, len(t)) if (a := self.ranks.get(t[:k])) is not None and (b := self.ranks.get(t[k:])) is not None]
        self._build(np.array(pairs, dtype=np.int64).reshape(-1, 3))

    def _build(self, pairs: np.ndarray) -> None:
        bits = max(8, int(np.ceil(np.log2(4 * len(pairs) + 1))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, dtype=np.int64)
        self.values = np.full(1 << bits, _NONE, dtype=np.int32)
        left = np.arange(len(pairs))
        key = (pairs[:, 0] << 32) | pairs[:, 1]
        slot = self._slot(key)
        while len(left):
            free = self.keys[slot[left]] == -1
            want = left[free]
            _, first = np.unique(slot[want], return_index=True)
            put = want[first]
            self.keys[slot[put]] = key[put]
            self.values[slot[put]] = pairs[put, 2]
            left = left[self.keys[slot[left]] != key[left]]
            slot[left] = (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank (= merged id) of each pair, or the largest int32 where it doesn't merge; negative ids are padding."""
        key = (a.astype(np.int64) << 32) | (b.astype(np.int64) & 0xFFFFFFFF)
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.values[slot], _NONE)
        open_ = np.flatnonzero((found != key) & (found != -1))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            found = self.keys[slot[open_]]
            hit = found == key[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (found != -1)]
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def _matrix(self, rows: np.ndarray, out: list[tuple[np.ndarray, np.ndarray, np.ndarray]], index: np.ndarray) -> None:
        """Merge all rows of one padded matrix; appends (indices, token counts, tokens) to ``out``."""
        rank = self.rank_of(rows[:, :-1].ravel(), rows[:, 1:].ravel()).reshape(len(rows), -1)
        while True:
            n, width = rows.shape
            at = rank.argmin(axis=1) if width > 1 else np.zeros(n, dtype=np.int64)
            best = rank[np.arange(n), at] if width > 1 else np.full(n, _NONE)
            live = best != _NONE
            if not live.all():
                done = rows[~live]
                out.append((index[~live], (done >= 0).sum(axis=1), done[done >= 0]))
                rows, rank, index, at, best = rows[live], rank[live], index[live], at[live], best[live]
                n = len(rows)
            if not n:
                return
            r = np.arange(n)
            rows[r, at] = best
            keep = np.ones(rows.shape, dtype=bool)
            keep[r, at + 1] = False
            rows = rows[keep].reshape(n, width - 1)
            keep = np.ones(rank.shape, dtype=bool)
            keep[r, at] = False
            rank = rank[keep].reshape(n, width - 2)
            if width > 2:
                before = np.flatnonzero(at > 0)
                rank[before, at[before] - 1] = self.rank_of(rows[before, at[before] - 1], rows[before, at[before]])
                after = np.flatnonzero(at < width - 2)
                rank[after, at[after]] = self.rank_of(rows[after, at[after]], rows[after, at[after] + 1])

    def _long(self, piece: bytes) -> np.ndarray:
        """The same merges for one very long piece: a heap of (rank, place) over a linked list."""
        ids = self.byte_id[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.rank_of(np.array(ids[:-1], dtype=np.int32), np.array(ids[1:], dtype=np.int32))
        heap = [(int(k), i, ids[i], ids[i + 1]) for i, k in enumerate(first) if k != _NONE]
        heapq.heapify(heap)
        one = lambda a, b: self.ranks.get(self.token(a) + self.token(b))
        while heap:
            k, i, a, b = heapq.heappop(heap)
            j = after[i]
            if ids[i] != a or j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = k, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (m := one(k, ids[after[i]])) is not None:
                    heapq.heappush(heap, (m, i, k, ids[after[i]]))
            if before[i] >= 0 and (m := one(ids[before[i]], k)) is not None:
                heapq.heappush(heap, (m, before[i], ids[before[i]], k))
        return np.array([x for x in ids if x >= 0], dtype=np.int32)

    def token(self, i: int) -> bytes:
        return self.bytes[self.start[i] : self.start[i] + self.size[i]].tobytes()

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all pieces one after another, and where each piece starts (one more entry than pieces)."""
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), dtype=np.int32, count=len(pieces))
        known = np.flatnonzero(whole >= 0)
        out = [(known, np.ones(len(known), dtype=np.int64), whole[known])] if len(known) else []
        rest = np.flatnonzero(whole < 0)
        size = np.fromiter((len(pieces[i]) for i in rest), dtype=np.int64, count=len(rest))
        empty = rest[size == 0]
        if len(empty):
            out.append((empty, np.zeros(len(empty), dtype=np.int64), np.empty(0, dtype=np.int32)))
        low = 0
        for high in (4, 6, 8, 10, 12, 16, 24, 32, 64, 128, 256, 512, 1024, _WIDEST):
            chosen = rest[(size > low) & (size <= high)]
            wide = size[(size > low) & (size <= high)]
            low = high
            step = max(1, 4_000_000 // high)
            for k in range(0, len(chosen), step):
                part, n = chosen[k : k + step], wide[k : k + step]
                rows = np.full((len(part), int(n.max())), -1, dtype=np.int32)
                flat = np.frombuffer(b"".join([pieces[i] for i in part]), dtype=np.uint8)
                rows[np.arange(rows.shape[1]) < n[:, None]] = self.byte_id[flat]
                self._matrix(rows, out, part)
        for i in rest[size > _WIDEST]:
            ids = self._long(pieces[i])
            out.append((np.array([i]), np.array([len(ids)]), ids))
        counts = np.zeros(len(pieces) + 1, dtype=np.int64)
        for index, n, _ in out:
            counts[index + 1] = n
        start = np.cumsum(counts)
        tokens = np.empty(start[-1], dtype=np.int32)
        for index, n, ids in out:
            tokens[_spread(start[index], n)] = ids
        return tokens, start

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of all texts one after another, and where each text starts (one more entry than texts)."""
        number = _Numbers()
        places = [np.fromiter(map(number.__getitem__, self.pattern.findall(t)), dtype=np.int32) for t in texts]
        tokens, start = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in number])
        of = np.concatenate(places) if places else np.empty(0, dtype=np.int32)
        n = (start[1:] - start[:-1])[of]
        ends = np.concatenate([[0], np.cumsum(n)])
        return tokens[_spread(start[of], n)], ends[np.concatenate([[0], np.cumsum([len(p) for p in places])]).astype(np.int64)]

    def decode_bytes(self, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of all sequences one after another, and where each starts; an unknown id raises."""
        if len(ids) and (ids.min() < 0 or ids.max() >= len(self.size)):
            raise ValueError("a token id is outside the vocabulary")
        n = self.size[ids]
        ends = np.concatenate([[0], np.cumsum(n)])
        return self.bytes[_spread(self.start[ids], n)], ends[start]

    def decode(self, ids: list[int]) -> str:
        flat, _ = self.decode_bytes(np.asarray(ids, dtype=np.int64), np.array([0, len(ids)]))
        return flat.tobytes().decode("utf-8", "replace")


def _spread(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """start[0], start[0]+1, ... (n[0] of them), start[1], ..."""
    total = int(n.sum())
    ends = np.cumsum(n)
    return np.arange(total, dtype=np.int64) + np.repeat(start - (ends - n), n)


_LOADED: dict[bytes, ByteBPE] = {}


def _loaded(rank_file: bytes, pattern: str) -> ByteBPE:
    """One vocabulary a worker process, built once."""
    key = blake2b(rank_file + pattern.encode()).digest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBPE(rank_file, pattern)
    return _LOADED[key]


def encode_documents(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN, *, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Columns ``carry``, then n_tokens, token_ids and round_trip of every row.

    round_trip says whether decoding the ids gives the text's bytes again; it is true for
    every text. No shuffle: each batch of rows is encoded where it is read; the vocabulary
    (fixed, about 1 MB) is broadcast. Null text gives null in all three; empty text an empty
    list, 0 and true; repeated rows are encoded each; a carried column keeps its name, and a new
    one of the same name gets underscores.
    """
    spark = docs.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    picked = docs.select(*[col(docs, c) for c in carry], col(docs, text).cast("string").alias("__text"))
    schema = with_fields(docs.select(*[col(docs, c) for c in carry]), n_tokens=T.IntegerType(), token_ids=T.ArrayType(T.IntegerType()), round_trip=T.BooleanType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks.value, pattern)
        for batch in batches:
            for a, b in byte_slices(batch.column(len(carry))):
                part = batch.slice(a, b - a)
                column = part.column(len(carry))
                null = np.array(column.is_null())
                ids, start = bpe.encode([t or "" for t in column.to_pylist()])
                back, at = bpe.decode_bytes(ids, start)
                raw = pa.array(column.fill_null("")).cast(pa.large_binary())
                same = [back[at[i] : at[i + 1]].tobytes() == x.as_buffer().to_pybytes() for i, x in enumerate(raw)]
                lists = pa.ListArray.from_arrays(pa.array(start, pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null)) if len(part) else pa.array([], pa.list_(pa.int32()))
                n = pa.array((start[1:] - start[:-1]).astype(np.int32), mask=null)
                yield pa.RecordBatch.from_arrays([*[part.column(i) for i in range(len(carry))], n, lists, pa.array(same, mask=null)], names=schema.names)

    return picked.mapInArrow(frugal(run), schema)


def decode_documents(tokens: DataFrame, vocabulary: str = VOCABULARY, *, ids: str = "token_ids", into: str = "text") -> DataFrame:
    """``tokens`` with the decoded text in place of the ids. Null ids give null, none give empty text; bytes that are no UTF-8 become U+FFFD."""
    spark = tokens.sparkSession
    with open(vocabulary, "rb") as f:
        ranks = spark.sparkContext.broadcast(f.read())
    others = [c for c in tokens.columns if c != ids]
    picked = tokens.select(*[col(tokens, c) for c in others], col(tokens, ids).cast("array<int>").alias("__ids"))
    schema = with_fields(tokens.select(*[col(tokens, c) for c in others]), **{into: T.StringType()})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(ranks.value, PATTERN)
        for batch in batches:
            lists = batch.column(len(others))
            texts = [None if x is None else bpe.decode(x) for x in lists.to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(len(others))], pa.array(texts, pa.string())], names=schema.names)

    return picked.mapInArrow(frugal(run), schema)

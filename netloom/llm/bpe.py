"""Byte-level BPE encoding and decoding.

Two tiers. A pre-token that is in the vocabulary as a whole is found through a
minimal perfect hash (hash and displace: one table of displacements, exactly
one slot per token, the stored key is compared). A miss is merged from its
bytes: the bytes form a doubly linked list and a heap yields the adjacent pair
of lowest rank, leftmost first.

The vocabulary file is read on the driver (its size is fixed by the
vocabulary, under 1 MB for 50k tokens) and travels with the task closure; each
Python worker builds the hash once. Encoding is a map over documents: there is
no shuffle, and a lost executor only repeats its own partitions.

Defined cases: a null text counts as empty and gives no ids; every text,
whatever its length, is encoded whole, in blocks of pre-tokens; equal rows get
equal ids, rows with null or repeated ids are rows like all others; an empty
table gives an empty table; other columns are kept unless they have the name of
an output column, which the caller can choose.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm.common import slices, small_batches, with_fields

#: Distinct pre-tokens that one worker remembers; they are dropped by halves, the longest unused first.
CACHE_ENTRIES = 600_000
#: Longer pre-tokens are not remembered, which bounds the bytes of a cache and not only its entries.
LONGEST_CACHED = 64
#: Where two workers share a core's memory (encoding and decoding in one stage).
SMALL_CACHE = 200_000
#: Rows that a worker holds as Python lists at once.
ROWS = 256
#: Longer texts are cut into blocks of so many pre-tokens.
BLOCK_TOKENS = 65_536
BLOCK_CHARS = 1 << 20
MASK = (1 << 64) - 1


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys, n slots."""

    def __init__(self, keys: list[bytes]):
        self.n = n = max(1, len(keys))
        self.buckets = max(1, n // 3)
        h = self.hashes(keys)
        bucket = (h >> np.uint64(33)) % np.uint64(self.buckets)
        order = np.argsort(bucket, kind="stable")
        counts = np.bincount(bucket.astype(np.int64), minlength=self.buckets)
        starts = np.concatenate(([0], np.cumsum(counts)))
        self.shift = np.zeros(self.buckets, np.int64)
        slot_key = np.full(n, -1, np.int64)
        tries = np.arange(1, 257, dtype=np.uint64)
        for b in np.argsort(-counts, kind="stable"):
            if counts[b] < 2:
                break
            members = order[starts[b] : starts[b + 1]]
            first = 0
            while True:
                slots = self._slots(h[members][None, :], (tries + np.uint64(first))[:, None])
                free = (slot_key[slots] < 0).all(1)
                if len(members) > 1:
                    free &= (np.diff(np.sort(slots, 1), axis=1) > 0).all(1)
                if free.any():
                    at = int(free.argmax())
                    self.shift[b] = first + int(tries[at])
                    slot_key[slots[at]] = members
                    break
                first += len(tries)
        gaps = iter(np.flatnonzero(slot_key < 0))
        for b in np.flatnonzero(counts == 1):  # a bucket of one takes a free slot by number
            slot = next(gaps)
            self.shift[b] = -1 - slot
            slot_key[slot] = order[starts[b]]
        self.slot_key, self.shift = slot_key.tolist(), self.shift.tolist()

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), np.uint64, len(keys))

    def _slots(self, h: np.ndarray, shift: np.ndarray) -> np.ndarray:
        x = (h ^ (shift * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x >> np.uint64(32)) % np.uint64(self.n)).astype(np.int64)

    def find(self, key: bytes) -> int:
        """The number of the only stored key that ``key`` may equal."""
        h = xxhash.xxh3_64_intdigest(key)
        shift = self.shift[(h >> 33) % self.buckets]
        if shift < 0:
            return self.slot_key[-1 - shift]
        x = (h ^ (shift * 0x9E3779B97F4A7C15 & MASK)) * 0xD6E8FEB86659FD93 & MASK
        return self.slot_key[(x >> 32) % self.n]


def read_ranks(path: str) -> list[tuple[bytes, int]]:
    """(token, rank) pairs of a rank file: base64 and a decimal number on each line."""
    with open(path, "rb") as lines:
        return [(base64.b64decode(a), int(b)) for a, b in map(bytes.split, filter(bytes.strip, lines))]


class Known(dict):
    """Ids by pre-token, in two generations: what is missing here comes from the older one, else from the hash or a merge."""

    def __init__(self, codec: Codec, old: dict | None = None):
        super().__init__()
        self.codec, self.old = codec, old or {}

    def __missing__(self, name: str) -> tuple[int, ...]:
        ids = self.old.get(name)
        if ids is None:
            codec, piece = self.codec, name.encode()
            k = codec.whole.find(piece)
            ids = (codec.ids[k],) if codec.tokens[k] == piece else codec.merge(piece)
        if len(name) <= LONGEST_CACHED:
            self[name] = ids
        return ids


class Codec:
    """Encoder and decoder for one vocabulary of ranks and one splitting pattern."""

    def __init__(self, ranks: list[tuple[bytes, int]], pattern: str, cache: int = CACHE_ENTRIES):
        self.split, self.generation = regex.compile(pattern), max(1, cache // 2)
        self.tokens = [t for t, _ in ranks]
        self.ids = [r for _, r in ranks]
        self.rank = dict(ranks)
        self.token = [b""] * (max(self.ids) + 1)
        for t, r in ranks:
            self.token[r] = t
        self.known = Known(self)

    @cached_property
    def whole(self) -> PerfectHash:
        return PerfectHash(self.tokens)

    @cached_property
    def byte_id(self) -> list[int]:
        return [self.rank[bytes([b])] for b in range(256)]

    @cached_property
    def two(self) -> list[int]:
        """Ranks of all pairs of bytes, -1 where there is none."""
        return [self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of one pre-token: lowest-ranked adjacent pair first, leftmost among equals.

        ``after`` and ``before`` link the living parts by their first byte;
        ``pair`` holds the rank of the pair that begins at a part, which also
        tells whether an entry of the heap is still current.
        """
        n, get, two, push, pop = len(piece), self.rank.get, self.two, heapq.heappush, heapq.heappop
        ids = list(map(self.byte_id.__getitem__, piece))
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        pair = [two[a << 8 | b] for a, b in zip(piece, piece[1:])]
        pair.append(-1)
        heap = [r << 32 | i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        while heap:
            entry = pop(heap)
            i, r = entry & 0xFFFFFFFF, entry >> 32
            if pair[i] != r:
                continue
            j = after[i]
            end = after[i] = after[j]
            ids[i], pair[j] = r, -1
            if end < n:
                before[end] = i
                pair[i] = r = get(piece[i : after[end]], -1)
                if r >= 0:
                    push(heap, r << 32 | i)
            else:
                pair[i] = -1
            if (h := before[i]) >= 0:
                pair[h] = r = get(piece[h:end], -1)
                if r >= 0:
                    push(heap, r << 32 | h)
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return tuple(out)

    def blocks(self, text: str) -> Iterator[list[str]]:
        if len(text) <= BLOCK_CHARS:
            yield self.split.findall(text)
            return
        matches = (m.group() for m in self.split.finditer(text))
        while block := list(islice(matches, BLOCK_TOKENS)):
            yield block

    def encode_blocks(self, text: str) -> Iterator[list[int]]:
        for block in self.blocks(text):
            if len(self.known) > self.generation:
                self.known.old = {}
                self.known = Known(self, self.known)
            yield list(chain.from_iterable(map(self.known.__getitem__, block)))

    def encode(self, text: str | None) -> list[int]:
        return list(chain.from_iterable(self.encode_blocks(text or "")))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


#: The codec of this worker process, by vocabulary.
_codecs: dict[str, Codec] = {}


def _codec(key: str, ranks: list[tuple[bytes, int]], pattern: str, cache: int = CACHE_ENTRIES) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(ranks, pattern, cache)
    return _codecs[key]


@contextmanager
def _without_gc():
    """No garbage collection while a task runs: the cache holds no cycles, and walking its entries costs more than the merges."""
    on = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if on:
            gc.enable()


def _loaded(path: str, pattern: str) -> tuple[str, list[tuple[bytes, int]]]:
    ranks = read_ranks(path)
    key = hashlib.sha256(repr((ranks, pattern)).encode()).hexdigest()
    return key, ranks


def _kept(df: DataFrame, *new: str) -> DataFrame:
    return df.drop(*new)


def _slices(batches):
    with _without_gc():
        yield from slices(batches, ROWS)


def encode(df: DataFrame, vocabulary: str, pattern: str, text: str = "text", ids: str = "token_ids", count: str = "n_tokens") -> DataFrame:
    """``df``, an array<int> column of the ids of each whole text, and how many they are."""
    key, ranks = _loaded(vocabulary, pattern)
    rest = _kept(df, ids, count)
    at = rest.columns.index(text)
    schema = with_fields(rest, **{ids: "array<int>", count: "long"})

    def run(batches):
        codec = _codec(key + "e", ranks, pattern, SMALL_CACHE)
        for b in _slices(batches):
            out = [np.array(codec.encode(t), np.int32) for t in b.column(at).to_pylist()]
            sizes = np.array([len(x) for x in out], np.int64)
            ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(out) if out else np.empty(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*b.columns, lists, pa.array(sizes)], names=[*b.schema.names, ids, count])

    return small_batches(rest).mapInArrow(run, schema)


def decode(df: DataFrame, vocabulary: str, pattern: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """``df`` and a string column with the text that the ids stand for (null ids: null)."""
    key, ranks = _loaded(vocabulary, pattern)
    rest = _kept(df, out)
    at = rest.columns.index(ids)

    def run(batches):
        codec = _codec(key + "d", ranks, pattern, SMALL_CACHE)
        for b in _slices(batches):
            lists = b.column(at)
            texts = [codec.decode(x.values.to_numpy(zero_copy_only=False).tolist()).decode("utf-8", "replace") if x.is_valid else None for x in lists]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])

    return small_batches(rest).mapInArrow(run, with_fields(rest, **{out: "string"}))


def round_trip(df: DataFrame, vocabulary: str, pattern: str, key_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Digests of the ids and of the bytes decoded from them, block by block in constant memory."""
    key, ranks = _loaded(vocabulary, pattern)
    source = df.select(F.col(key_column).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))

    def run(batches):
        codec = _codec(key, ranks, pattern)
        names = list(map(str, range(len(codec.token))))
        for b in _slices(batches):
            counts, id_digests, byte_digests = [], [], []
            for t in b.column(1).to_pylist():
                n, id_hash, byte_hash = 0, hashlib.sha256(), hashlib.sha256()
                for ids in codec.encode_blocks(t):
                    id_hash.update((("," if n else "") + ",".join(map(names.__getitem__, ids))).encode())
                    byte_hash.update(codec.decode(ids))
                    n += len(ids)
                counts.append(n)
                id_digests.append(id_hash.hexdigest())
                byte_digests.append(byte_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), pa.array(id_digests), pa.array(byte_digests)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(source).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

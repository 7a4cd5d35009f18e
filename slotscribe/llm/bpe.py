"""Byte-level BPE encoding and decoding.

Text is cut into pre-tokens by the tokenizer's pattern. Two tiers resolve them:
a minimal perfect hash over the vocabulary answers for pre-tokens that are
tokens themselves, a batch at a time; the rest are merged by a heap over a
linked list of byte pieces, lowest rank first, leftmost first among equals.
Both tiers run once per distinct pre-token; its ids are decoded again there and then,
and the worker process remembers them, as digits, across its tasks.

The vocabulary (ranks, at most ``MAX_VOCAB_BYTES``) is read by the driver from
a path that is a parameter; the driver builds the hash and broadcasts both.

Defined results: NULL is encoded as empty; the empty text has no tokens and
decodes to nothing; special tokens are ordinary text; a pre-token of any length
takes time n log n. Decoding unknown ids is an error.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_batches, texts_of, with_columns

# Size up to which a vocabulary is broadcast; public ones take 1 to 4 MB.
MAX_VOCAB_BYTES = 64_000_000
# Distinct pre-tokens a worker remembers (some 230 bytes each), in two generations, and the characters of the longest it keeps.
REMEMBERED, LONGEST = 600_000, 1_000
# Keys per bucket of the perfect hash, on average.
BUCKET_KEYS = 4


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> id, from a rank file (base64 and number on each line)."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    return {base64.b64decode(token): int(rank) for token, rank in pairs}


def _mix(h: np.ndarray, seed) -> np.ndarray:
    """Hash of 64-bit hashes under a seed, element by element."""
    x = h ^ (np.asarray(seed, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


class PerfectHash:
    """Minimal perfect hash over byte strings: n keys, n slots, one probe.

    Keys fall into buckets. Largest bucket first, a seed is searched that sends
    all its keys to free slots; buckets of one key store the slot itself.
    """

    def __init__(self, keys: list[bytes]):
        self.n = len(keys)
        self.buckets = max(1, self.n // BUCKET_KEYS)
        self.seeds = np.zeros(self.buckets, dtype=np.int64)
        self.keys: list[bytes | None] = [None] * self.n
        hashes = self.hashes(keys)
        groups: dict[int, list[int]] = {}
        for i, b in enumerate((hashes % np.uint64(self.buckets)).tolist()):
            groups.setdefault(b, []).append(i)
        free, tries = np.ones(self.n, dtype=bool), np.arange(1, 257, dtype=np.uint64)
        singles = []
        for b, members in sorted(groups.items(), key=lambda g: -len(g[1])):
            if len(members) == 1:
                singles.append((b, members[0]))
                continue
            start = 0
            while True:
                slots = _mix(hashes[members][None, :], tries[:, None] + np.uint64(start)) % np.uint64(self.n)
                ordered = np.sort(slots, axis=1)
                good = free[slots].all(axis=1) & (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    break
                start += len(tries)
            k = int(np.argmax(good))
            self.seeds[b] = start + int(tries[k])
            for i, s in zip(members, slots[k].tolist()):
                free[s] = False
                self.keys[s] = keys[i]
        for (b, i), s in zip(singles, np.flatnonzero(free).tolist()):
            self.seeds[b] = -1 - s
            self.keys[s] = keys[i]

    @staticmethod
    def hashes(keys: list[bytes]) -> np.ndarray:
        return np.fromiter(map(xxhash.xxh3_64_intdigest, keys), dtype=np.uint64, count=len(keys))

    def slots(self, keys: list[bytes]) -> list[int]:
        """Slot of every key, -1 for strings that are not keys."""
        if not self.n or not keys:
            return [-1] * len(keys)
        h = self.hashes(keys)
        seed = self.seeds[(h % np.uint64(self.buckets)).astype(np.int64)]
        probed = (_mix(h, seed.astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)
        found = np.where(seed < 0, -1 - seed, probed).tolist()
        return [s if self.keys[s] == key else -1 for s, key in zip(found, keys)]


class Tokenizer:
    """Encoder and decoder of one vocabulary."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, pattern
        self.whole = PerfectHash(list(ranks))
        self._start()

    def _start(self) -> None:
        self.find = regex.compile(self.pattern).findall
        self.tokens = {i: token for token, i in self.ranks.items()}
        self.slot_ids = [self.ranks[key] for key in self.whole.keys]
        # Ids of single bytes, from ``unknown`` up for those that are no token, and the rank that two ids merge to.
        self.unknown = max(self.tokens, default=0) + 1
        self.bytes_ids = [self.ranks.get(bytes([b]), self.unknown + b) for b in range(256)]
        known = {**{bytes([b]): i for b, i in enumerate(self.bytes_ids)}, **self.ranks}.get
        self.pairs = {
            left << 32 | right: rank
            for token, rank in self.ranks.items() for cut in range(1, len(token))
            if (left := known(token[:cut])) is not None and (right := known(token[cut:])) is not None
        }
        # Per pre-token, its ids in decimal, joined by commas; and what was met before these.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.long: list[str] = []

    def __getstate__(self) -> tuple:
        return self.ranks, self.pattern, self.whole

    def __setstate__(self, state: tuple) -> None:
        self.ranks, self.pattern, self.whole = state
        self._start()

    def merge(self, piece: bytes) -> tuple[int, ...]:
        """Ids of a pre-token that is not a token itself."""
        ids, n, rank_of = list(map(self.bytes_ids.__getitem__, piece)), len(piece), self.pairs.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        # An entry is a rank and, in its low half, the place of the left piece.
        heap = [rank << 32 | i for i in range(n - 1) if (rank := rank_of(ids[i] << 32 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            entry = heapq.heappop(heap)
            i, rank = entry & 0xFFFFFFFF, entry >> 32
            j = after[i]
            # An entry is stale once either side has been merged otherwise.
            if ids[i] < 0 or j >= n or rank_of(ids[i] << 32 | ids[j]) != rank:
                continue
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (other := rank_of(rank << 32 | ids[k])) is not None:
                    heapq.heappush(heap, other << 32 | i)
            h = before[i]
            if h >= 0 and (other := rank_of(ids[h] << 32 | rank)) is not None:
                heapq.heappush(heap, other << 32 | h)
        left = tuple([x for x in ids if x >= 0])
        if max(left) >= self.unknown:
            raise ValueError(f"the vocabulary has no token for byte {max(left) - self.unknown}")
        return left

    def learn(self, pieces: set[str]) -> None:
        """Resolve pre-tokens not met before: the perfect hash first, then the heap."""
        for text in self.long:
            del self.known[text]
        new = list(pieces.difference(self.known))
        if len(self.known) + len(new) > REMEMBERED // 2:
            self.known, self.older = {}, self.known
            new = list(pieces)
        known, before = self.known, self.older.get
        unmet = []
        for text in new:
            if (digits := before(text)) is not None:
                known[text] = digits
            else:
                unmet.append(text)
        self.long = [p for p in unmet if len(p) > LONGEST]
        raw = [p.encode() for p in unmet]
        for text, piece, slot in zip(unmet, raw, self.whole.slots(raw)):
            ids = (self.slot_ids[slot],) if slot >= 0 else self.merge(piece)
            if self.decode(ids) != piece:
                raise ValueError(f"the ids of {text!r} decode to something else")
            known[text] = b",".join([b"%d" % i for i in ids])

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens of a text, all of them resolved."""
        found = self.find(text)
        self.learn(set(found))
        return found

    def listed(self, text: str) -> tuple[bytes, bytes]:
        """Ids of a text in decimal, joined by commas, and the bytes that the ids of its pre-tokens decode to."""
        found = self.pieces(text)
        return b",".join(map(self.known.__getitem__, found)), "".join(found).encode()

    def encode(self, texts: Iterable[str]) -> Iterator[list[int]]:
        """Ids of each text."""
        for text in texts:
            digits, _ = self.listed(text)
            yield list(map(int, digits.split(b","))) if digits else []

    def decode(self, ids: Iterable[int]) -> bytes:
        """Bytes of a list of ids."""
        return b"".join(map(self.tokens.__getitem__, ids))


def _shipped(df: DataFrame, path: str, pattern: str) -> Callable[[], Tokenizer]:
    ranks = read_ranks(path)
    size = sum(len(t) + 8 for t in ranks)
    if size > MAX_VOCAB_BYTES:
        raise ValueError(f"a vocabulary of {size} bytes is too large to broadcast")
    sent = df.sparkSession.sparkContext.broadcast(Tokenizer(ranks, pattern))
    return lambda: sent.value


def encode(docs: DataFrame, path: str, pattern: str, *, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with the ids of each text."""
    start = _shipped(docs, path, pattern)

    def make():
        tokenizer = start()
        return lambda batch: [pa.array(list(tokenizer.encode(texts_of(batch, text_col))), pa.list_(pa.int32()))]

    return with_columns(docs, [T.StructField(ids_col, T.ArrayType(T.IntegerType()))], make)


def decode(df: DataFrame, path: str, pattern: str, *, ids_col: str = "ids", bytes_col: str = "decoded") -> DataFrame:
    """``df`` with the bytes of each list of ids; NULL lists stay NULL."""
    start = _shipped(df, path, pattern)

    def make():
        tokenizer = start()

        def work(batch: pa.RecordBatch) -> list:
            lists = batch.column(batch.schema.get_field_index(ids_col)).to_pylist()
            return [[None if ids is None else tokenizer.decode(ids) for ids in lists]]

        return work

    return with_columns(df, [T.StructField(bytes_col, T.BinaryType())], make)


def tokenized(docs: DataFrame, path: str, pattern: str, *, keep: tuple[str, ...] = ("doc_id",), with_ids: bool = True, text_col: str = "text") -> DataFrame:
    """The columns ``keep``, the ids (unless left out), their number and digest, and the digest of what they decode to.

    Encodes and decodes in one task, so ids are not exchanged in between.
    """
    start = _shipped(docs, path, pattern)
    digests = T._parse_datatype_string("n_tokens bigint, ids_sha256 string, decoded_sha256 string").fields
    ids_field = [T.StructField("ids", T.ArrayType(T.IntegerType()))] if with_ids else []

    def make():
        tokenizer = start()

        def work(batch: pa.RecordBatch):
            rows, all_ids, ends = [], [], [0]
            for text in texts_of(batch, text_col):
                digits, decoded = tokenizer.listed(text)
                n = digits.count(b",") + 1 if digits else 0
                rows.append((n, hashlib.sha256(digits).hexdigest(), hashlib.sha256(decoded).hexdigest()))
                if with_ids:
                    all_ids.append(np.fromiter(map(int, digits.split(b",")), np.int32, n) if n else np.empty(0, np.int32))
                    ends.append(ends[-1] + n)
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.empty(0, np.int32), *all_ids])))] if with_ids else []
            yield [*batch.columns[: len(keep)], *lists, *([r[k] for r in rows] for k in range(3))]

        return work

    schema = T.StructType([*[docs.schema[c] for c in keep], *ids_field, *digests])
    return map_batches(docs.select(*keep, text_col), make, schema)


def report(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """Number and digest of the ids of every text, and digest of what they decode to."""
    return tokenized(docs, path, pattern, with_ids=False)

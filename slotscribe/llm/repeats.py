"""Removal of repeated passages: longest previous factors over sorted suffixes.

Every byte that a 50-byte string covers goes, if that string also starts in a
document with a smaller doc_id; the first document keeps it.

Finding candidates. Each 50-byte window has an anchor: its 24-byte string of
smallest hash, leftmost among equals. Equal windows have equal anchors, so all
copies of a window meet under its anchor. The windows of one anchor occurrence
are neighbours; the text they cover is its fragment. Anchors travel as packed
arrays of hashes, not as rows. Of a fragment that repeats as a whole only the
first document asks further; the others are settled. So are anchors of one
document. A window has 13 bytes or more on one side of its anchor; fragments that
share an anchor but neither the 13 bytes before nor those after it have no window
in common. What is left, mostly the ends of copied passages, sends its text.

Longest previous factors. Fragments are brought together by anchor and all their
windows sorted as suffixes (ranks of 8, 16, 32 and 50 bytes, each made of two of
the ranks before). In that order the previous and the next entry of a smaller
document are found by pointer jumping; if either is equal over 50 bytes, the
window has an earlier copy, else its longest previous factor is shorter. Fragments of
an anchor with more than ``CHUNK_BYTES`` of them are not brought together: each of their
windows is a row, and the smallest document of equal ones is found by partial aggregates.

Fragments are taken as equal by 96 bits of hash (32 of the anchor, 64 of the
fragment), within one range of anchors: where documents share an anchor, as at the
edge of a common passage, the 64 bits of the fragment alone tell them apart.

Defined results: NULL and empty texts have no bytes; texts under 50 bytes keep
all; rows without doc_id keep all and remove nothing; rows of one doc_id never
remove from each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, stage, texts_of

LENGTH = 50
ANCHOR = 24
# 24-byte strings in a window.
WINDOW = LENGTH - ANCHOR + 1
# Bytes before or after the anchor that every window has on one side at least.
SIDE = (LENGTH - ANCHOR) // 2
# Text of a unit whose anchors are packed together, and documents in it.
UNIT_BYTES, UNIT_DOCS = 6_000_000, 60_000
# Anchors of a range, which one step sorts; a text has one in WINDOW / 2 bytes.
RANGE_ANCHORS = 400_000
# Bytes of fragments that are sorted together, twice as many at most; an anchor with more goes window by window.
CHUNK_BYTES = 1_000_000
# Parts that the documents asking for one window are dealt into.
SALTS = 16
# What is known of an anchor occurrence, in the low bits of its code.
SETTLED, ASKS, SHOWS = 1, 2, 3

_LOW = np.uint64(0xFFFFFFFF)
_HIGH = np.uint64(0xFFFFFFFF00000000)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA3B195354A39B70D)
    return x ^ (x >> np.uint64(32))


def _code(anchor: np.ndarray, fragment: np.ndarray, sides: np.ndarray) -> np.ndarray:
    """Name of a fragment within a document; the two low bits are free."""
    place = (anchor & _LOW) << np.uint64(24) ^ sides
    return _mix(_mix(place + np.uint64(0x632BE59BD9B4E019)) ^ fragment * np.uint64(0x9E3779B97F4A7C15)) & ~np.uint64(3)


class Anchors:
    """Anchor occurrences of a text: hash of the anchor, first and last window, hash of the fragment, and sides.

    The sides have 12 bits of the bytes before the anchor and 12 of those after it; they only select what is compared.
    """

    def __init__(self, raw: bytes):
        n = len(raw)
        if n < LENGTH:
            self.hash = self.fragment = self.sides = self.code = np.empty(0, np.uint64)
            self.first = self.last = np.empty(0, np.int64)
            return
        load = np.ndarray((n - 7,), "<u8", raw, 0, (1,))
        words = [load[8 * k : n - ANCHOR + 1 + 8 * k] for k in range(3)]
        h = words[0] * np.uint64(0x9E3779B97F4A7C15)
        h = (h ^ (h >> np.uint64(29)) ^ words[1]) * np.uint64(0xA3B195354A39B70D)
        h = _mix(h ^ (h >> np.uint64(31)) ^ words[2])
        # Smallest hash of each window, leftmost among equals: minima over 2, 4, 8 and 16 places, then two of these.
        key = (h & _HIGH) | np.arange(len(h), dtype=np.uint64)
        width = 1
        while 2 * width <= WINDOW:
            key, width = np.minimum(key[:-width], key[width:]), 2 * width
        rest = WINDOW - width
        key = np.minimum(key[: len(key) - rest], key[rest:]) if rest else key
        place = (key & _LOW).astype(np.int64)
        starts = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
        self.first, self.last = starts, np.r_[starts[1:], len(place)] - 1
        at = place[starts]
        self.hash = _mix(h[at] + np.uint64(0x632BE59BD9B4E019))
        digest = xxhash.xxh3_64_intdigest
        own = [digest(raw[a:b]) for a, b in zip(starts.tolist(), (self.last + LENGTH).tolist())]
        self.fragment = _mix(np.array(own, np.uint64) + (at - starts).astype(np.uint64))
        # Where a text ends sooner there is no window that would need the side, and any value will do.
        before, after = np.maximum(at - SIDE, 0), np.minimum(at + ANCHOR + SIDE - 8, n - 8)
        left = _mix(load[before] * np.uint64(0x9E3779B97F4A7C15) ^ load[np.maximum(at - 8, 0)]) >> np.uint64(52)
        right = _mix(load[np.minimum(at + ANCHOR, n - 8)] * np.uint64(0x9E3779B97F4A7C15) ^ load[after]) >> np.uint64(52)
        self.sides = left << np.uint64(12) | right
        self.code = _code(self.hash, self.fragment, self.sides)


def pack(array: np.ndarray) -> bytes:
    """Bytes of an array plane by plane, compressed: high bytes of sorted values are alike."""
    planes = np.ascontiguousarray(array.view(np.uint8).reshape(-1, array.itemsize).T).tobytes()
    return pa.compress(planes, codec="zstd", asbytes=True)


def unpack(data: bytes, kind, n: int) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * size, codec="zstd", asbytes=True), np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


CLAIMS = "range int, n int, anchors binary, fragments binary, sides binary, owners binary, docs binary, doc_id bigint, codes binary"


def claims(docs: DataFrame, ranges: int) -> DataFrame:
    """Per unit of text and range of anchors the packed occurrences; and per document the codes already settled.

    Of a fragment that several documents of a unit hold, only the first claims it.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, size = [], 0
        for batch in slices(batches):
            for i, text in zip(batch.column(0).to_pylist(), texts_of(batch, "text")):
                raw = text.encode("utf-8", "surrogatepass")
                if i is None or len(raw) < LENGTH:
                    continue
                unit.append((i, raw))
                size += len(raw)
                if size > UNIT_BYTES or len(unit) >= UNIT_DOCS:
                    yield _unit(unit, ranges)
                    unit, size = [], 0
        if unit:
            yield _unit(unit, ranges)

    return docs.select("doc_id", "text").mapInArrow(run, CLAIMS)


def _unit(unit: list[tuple[int, bytes]], ranges: int) -> pa.RecordBatch:
    unit.sort(key=lambda u: u[0])
    ids = np.array([i for i, _ in unit], np.int64)
    found = [Anchors(raw) for _, raw in unit]
    owner = np.repeat(np.arange(len(unit), dtype=np.uint16), [len(f.hash) for f in found])
    anchor, fragment, sides = (np.concatenate([getattr(f, name) for f in found]) for name in ("hash", "fragment", "sides"))
    part = ((anchor >> np.uint64(32)) % np.uint64(ranges)).astype(np.int32)
    low = (anchor & _LOW).astype(np.uint32)
    # By anchor, fragment, sides and document; repeats inside a document count once.
    order = np.lexsort((sides << np.uint64(16) | owner, fragment, part.astype(np.uint64) << np.uint64(32) | low))
    part, low, fragment, sides, owner = part[order], low[order], fragment[order], sides[order], owner[order]
    same = np.r_[False, (part[1:] == part[:-1]) & (low[1:] == low[:-1]) & (fragment[1:] == fragment[:-1]) & (sides[1:] == sides[:-1])]
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
    later = same & (ids[owner] > ids[owner[head]])
    rows: list[tuple] = []
    by_doc = np.argsort(owner[later], kind="stable")
    settled = (_code(low[later].astype(np.uint64), fragment[later], sides[later]) | np.uint64(SETTLED))[by_doc]
    for i, codes in _groups(owner[later][by_doc], settled):
        rows.append((int(ids[i]) % ranges, None, None, None, None, None, None, int(ids[i]), np.unique(codes).tobytes()))
    part, low, fragment, sides, owner = part[~same], low[~same], fragment[~same], sides[~same].astype(np.uint32), owner[~same]
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        used, local = np.unique(owner[a:b], return_inverse=True)
        deltas = np.diff(low[a:b], prepend=np.uint32(0))
        columns = (deltas, fragment[a:b], sides[a:b], local.astype(np.uint16))
        rows.append((int(part[a]), b - a, *map(pack, columns), ids[used].tobytes(), None, None))
    return _batch(rows, CLAIMS)


_TYPES = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary(), "string": pa.string(), "boolean": pa.bool_()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], _TYPES[t]) for k, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def _groups(keys: np.ndarray, values: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Stretches of equal keys."""
    if len(keys):
        edges = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1], True])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            yield int(keys[a]), values[a:b]


TOLD = "doc_id bigint, code bigint"


def decide(claimed: DataFrame, partitions: int) -> DataFrame:
    """(doc_id, code): what each document has to know about its anchors, one range at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, []
        for batch in slices(batches):
            for part, n, anchors, pieces, sides, owners, docs, i, codes in zip(*(c.to_pylist() for c in batch.columns)):
                if codes is not None:
                    own = np.frombuffer(codes, np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), i, np.int64)), pa.array(own)], names=["doc_id", "code"])
                    continue
                if part != current and held:
                    yield _decide(held)
                    held = []
                current = part
                doc = np.frombuffer(docs, np.int64)[unpack(owners, np.uint16, n)]
                anchor = np.cumsum(unpack(anchors, np.uint32, n), dtype=np.uint32)
                held.append((anchor, unpack(pieces, np.uint64, n), unpack(sides, np.uint32, n), doc))
        if held:
            yield _decide(held)

    dealt = claimed.repartition(partitions, "range").sortWithinPartitions("range")
    return dealt.mapInArrow(run, TOLD)


def _decide(held: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    anchor, fragment, sides, doc = (np.concatenate([h[k] for h in held]) for k in range(4))
    order = np.lexsort((doc, fragment, anchor.astype(np.uint64) << np.uint64(24) | sides))
    anchor, fragment, sides, doc = anchor[order], fragment[order], sides[order], doc[order]
    first = np.r_[True, (anchor[1:] != anchor[:-1]) | (fragment[1:] != fragment[:-1]) | (sides[1:] != sides[:-1])]
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), 0))
    status = np.where(doc > doc[head], SETTLED, 0)
    # Among the first of each fragment: those that share a side with a smaller document ask, with a larger one show.
    heads = np.flatnonzero(first)
    asks, shows = np.zeros(len(heads), bool), np.zeros(len(heads), bool)
    for shift in (12, 0):
        key = anchor[heads].astype(np.uint64) << np.uint64(12) | (sides[heads] >> np.uint32(shift) & np.uint32(4095))
        by_key = np.argsort(key, kind="stable")
        starts = np.flatnonzero(np.r_[True, key[by_key][1:] != key[by_key][:-1]])
        group = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(by_key)]))
        d = doc[heads][by_key]
        asks[by_key] |= d > np.minimum.reduceat(d, starts)[group]
        shows[by_key] |= d < np.maximum.reduceat(d, starts)[group]
    status[heads] = np.where(asks, ASKS, np.where(shows, SHOWS, 0))
    tell = np.flatnonzero(status)
    codes = _code(anchor[tell].astype(np.uint64), fragment[tell], sides[tell].astype(np.uint64)) | status[tell].astype(np.uint64)
    return pa.RecordBatch.from_arrays([pa.array(doc[tell]), pa.array(codes.view(np.int64))], names=["doc_id", "code"])


PLACED = "rid bigint, doc_id bigint, n_bytes bigint, removed binary, text binary, shown binary, kept_sha256 string"


def place(docs: DataFrame, told: DataFrame) -> DataFrame:
    """Per document its settled removals, or its text and fragments while it still waits for an answer."""
    joined = docs.join(told, "doc_id", "left").withColumn("rid", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for rid, i, text, codes in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode("utf-8", "surrogatepass")
                gone, shown, waits = _apply(raw, codes)
                if waits:
                    rows.append((rid, i, len(raw), gone.tobytes(), raw, shown.tobytes(), None))
                else:
                    rows.append((rid, i, len(raw), gone.tobytes(), raw if len(shown) else None, shown.tobytes(), digest(raw, gone)))
            yield _batch(rows, PLACED)

    return joined.select("rid", "doc_id", "text", "codes").mapInArrow(run, PLACED)


def _apply(raw: bytes, codes: list[int] | None) -> tuple[np.ndarray, np.ndarray, bool]:
    """Removed (start, end) rows, fragments to send (anchor, first, last, status) and whether any asks."""
    if not codes:
        return np.empty((0, 2), np.int64), np.empty((0, 4), np.int64), False
    found = Anchors(raw)
    told = np.sort(np.array(codes, np.int64).view(np.uint64))
    at = np.minimum(np.searchsorted(told, found.code), len(told) - 1)
    status = np.where(told[at] & ~np.uint64(3) == found.code, told[at] & np.uint64(3), 0).astype(np.int64)
    gone, sends = status == SETTLED, status > SETTLED
    shown = np.stack([found.hash.view(np.int64), found.first, found.last, status], axis=1)[sends]
    return union(np.stack([found.first[gone], found.last[gone] + LENGTH], axis=1)), shown, bool((shown[:, 3] == ASKS).any())


def union(spans: np.ndarray) -> np.ndarray:
    """Maximal runs of (start, end) rows; runs that touch are one."""
    if not len(spans):
        return spans.reshape(0, 2).astype(np.int64)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    ends = np.maximum.accumulate(spans[:, 1])
    first = np.flatnonzero(np.r_[True, spans[1:, 0] > ends[:-1]])
    return np.stack([spans[first, 0], ends[np.r_[first[1:] - 1, len(ends) - 1]]], axis=1).astype(np.int64)


def digest(raw: bytes, gone: np.ndarray) -> str:
    """SHA-256 of what is left."""
    h, at = hashlib.sha256(), 0
    for a, b in gone.tolist():
        h.update(raw[at:a])
        at = b
    h.update(raw[at:])
    return h.hexdigest()


FRAGMENTS = "anchor bigint, rid bigint, doc_id bigint, first bigint, asks boolean, piece binary"


def _sent(shown: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, first, last, status) of everything a slice of documents sends, and the document of each."""
    packed = shown.to_pylist()
    return np.frombuffer(b"".join(packed), np.int64).reshape(-1, 4), np.repeat(np.arange(len(packed)), [len(x) // 32 for x in packed])


def sent_bytes(placed: DataFrame) -> DataFrame:
    """(anchor, bytes): how much text is sent under each anchor, from the places alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found, _ = _sent(batch.column(0))
            anchors, which = np.unique(found[:, 0], return_inverse=True)
            sizes = np.bincount(which, weights=found[:, 2] + LENGTH - found[:, 1], minlength=len(anchors)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(sizes)], names=["anchor", "bytes"])

    sized = placed.where(F.length("shown") > 0).select("shown").mapInArrow(run, "anchor bigint, bytes bigint")
    return sized.groupBy("anchor").agg(F.sum("bytes").alias("bytes"))


def fragments(placed: DataFrame, anchors: list[int], inside: bool) -> DataFrame:
    """(anchor, rid, doc_id, first, asks, piece) of everything that is sent under the given anchors, or under all others."""
    shipped = placed.sparkSession.sparkContext.broadcast(np.array(anchors, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        named = shipped.value
        for batch in slices(batches):
            found, which = _sent(batch.column(3))
            if inside or len(named):
                wanted = np.isin(found[:, 0], named) == inside
                found, which = found[wanted], which[wanted]
            if not len(found):
                continue
            raw = batch.column(2).to_pylist()
            pieces = [raw[k][a:b] for k, a, b in zip(which.tolist(), found[:, 1].tolist(), (found[:, 2] + LENGTH).tolist())]
            owner = pa.array(which)
            columns = [pa.array(found[:, 0]), batch.column(0).take(owner), batch.column(1).take(owner), pa.array(found[:, 1]), pa.array(found[:, 3] == ASKS)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(pieces, pa.binary())], names=[f.split()[0] for f in FRAGMENTS.split(", ")])

    sent = placed.where(F.length("shown") > 0).select("rid", "doc_id", "text", "shown")
    return sent.mapInArrow(run, FRAGMENTS)


def _rank(values: np.ndarray) -> np.ndarray:
    return np.unique(values, return_inverse=True)[1].astype(np.uint64)


def suffix_ranks(text: np.ndarray, places: np.ndarray | None = None) -> np.ndarray:
    """Rank of the ``LENGTH`` bytes from the given places on, or from all that have so many; equal strings have equal ranks.

    Shorter strings are ranked only where a longer one that is asked for needs them.
    """
    if places is None:
        places = np.arange(len(text) - LENGTH + 1)
    steps, width = [], 8
    while width < LENGTH:
        steps.append(min(width, LENGTH - width))
        width += steps[-1]
    wanted = [places]
    for step in reversed(steps):
        marked = np.zeros(len(text), bool)
        marked[wanted[-1]] = marked[wanted[-1] + step] = True
        wanted.append(np.flatnonzero(marked))
    at = wanted.pop()
    raw = np.ndarray((len(text) - 7,), ">u8", text.tobytes(), 0, (1,))
    held = np.empty(len(text), np.uint64)
    rank = _rank(raw[at].astype(np.uint64))
    for step in steps:
        held[at] = rank
        at = wanted.pop()
        rank = _rank(held[at] << np.uint64(32) | held[at + step])
    return rank


def nearest_smaller(docs: np.ndarray) -> np.ndarray:
    """Index of the nearest earlier entry with a smaller value, -1 without one, by pointer jumping."""
    before = np.arange(-1, len(docs) - 1)
    open_ = np.flatnonzero(before >= 0)
    while len(open_):
        open_ = open_[docs[before[open_]] >= docs[open_]]
        before[open_] = before[before[open_]]
        open_ = open_[before[open_] >= 0]
    return before


def has_earlier(ranks: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """For every suffix, whether its longest previous factor has the full length.

    In suffix order the nearest entries of smaller documents on both sides are
    those with the longest common prefixes among all smaller documents.
    """
    order = np.argsort(ranks, kind="stable")
    r, d = ranks[order], docs[order]
    back = nearest_smaller(d)
    ahead = nearest_smaller(d[::-1])
    ahead = np.where(ahead >= 0, len(d) - 1 - ahead, -1)[::-1]
    equal = ((back >= 0) & (r[back] == r)) | ((ahead >= 0) & (r[ahead] == r))
    out = np.empty(len(d), bool)
    out[order] = equal
    return out


def answer(sent: DataFrame, partitions: int) -> DataFrame:
    """(rid, spans): the removals that sorting the fragments' windows finds."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in slices(batches):
            anchors = batch.column(0).to_numpy()
            lengths = pc.binary_length(batch.column(5)).to_numpy()
            start, ends = 0, np.flatnonzero(anchors[1:] != anchors[:-1]) + 1
            follows = bool(held) and held[-1].column(0)[-1].as_py() == anchors[0]
            # A chunk ends where an anchor begins.
            for a, b in zip([0, *ends.tolist()], [*ends.tolist(), len(anchors)]):
                if size > CHUNK_BYTES and not (a == 0 and follows):
                    held.append(batch.slice(start, a - start))
                    yield _answer(held)
                    held, size, start = [], 0, a
                size += int(lengths[a:b].sum())
            held.append(batch.slice(start))
        if size:
            yield _answer(held)

    dealt = sent.select("anchor", "rid", "doc_id", "first", "asks", "piece").repartition(partitions, "anchor").sortWithinPartitions("anchor")
    return dealt.mapInArrow(run, "rid bigint, spans binary")


def _answer(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.Table.from_batches(held)
    rid, doc, first, asks = (rows.column(k).to_numpy() for k in range(1, 5))
    pieces = rows.column(5).to_pylist()
    sizes = np.array([len(p) for p in pieces])
    offsets = np.cumsum(sizes) - sizes
    count = sizes - LENGTH + 1
    which = np.repeat(np.arange(len(sizes)), count)
    inside = np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
    ranks = suffix_ranks(np.frombuffer(b"".join(pieces), np.uint8), offsets[which] + inside)
    dup = has_earlier(ranks, doc[which]) & asks[which]
    who, start = rid[which[dup]], first[which[dup]] + inside[dup]
    order = np.lexsort((start, who))
    out = [(i, union(np.stack([s, s + LENGTH], axis=1)).tobytes()) for i, s in _groups(who[order], start[order])]
    return _batch(out, "rid bigint, spans binary")


WINDOWS = "window binary, rid bigint, doc_id bigint, start bigint, asks boolean"


def answer_by_window(sent: DataFrame) -> DataFrame:
    """(rid, spans) as from ``answer``, without a task that holds all fragments of an anchor; windows are equal by 128 bits."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for rid, i, first, asks, piece in zip(*(c.to_pylist() for c in batch.columns)):
                rows += [(xxhash.xxh3_128_digest(piece[p : p + LENGTH]), rid, i, first + p, asks) for p in range(len(piece) - LENGTH + 1)]
            yield _batch(rows, WINDOWS)

    windows = sent.select("rid", "doc_id", "first", "asks", "piece").mapInArrow(run, WINDOWS)
    held = windows.groupBy("window").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    dealt = held.select("window", "least", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    asking = windows.where("asks").withColumn("salt", F.pmod(F.xxhash64("rid"), F.lit(SALTS)).cast("int"))
    gone = asking.join(dealt, ["window", "salt"]).where("doc_id > least").groupBy("rid").agg(F.collect_set("start").alias("starts"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            spans = [np.stack([s, s + LENGTH], axis=1) for s in (np.array(x, np.int64) for x in batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([union(x).tobytes() for x in spans], pa.binary())], names=["rid", "spans"])

    return gone.select("rid", "starts").mapInArrow(join, "rid bigint, spans binary")


RESULT = "doc_id bigint, n_bytes bigint, removed binary, kept_sha256 string"


def finish(placed: DataFrame, answers: DataFrame) -> DataFrame:
    """All documents with their removed runs and what is left of them."""
    waiting = placed.where("kept_sha256 is null").select("rid", "doc_id", "n_bytes", "removed", "text")
    joined = waiting.join(answers.groupBy("rid").agg(F.collect_list("spans").alias("spans")), "rid", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for i, n, gone, raw, spans in zip(*(c.to_pylist() for c in batch.columns)):
                all_ = union(np.concatenate([np.frombuffer(x, np.int64).reshape(-1, 2) for x in [gone, *(spans or [])]]))
                rows.append((i, n, all_.tobytes(), digest(raw, all_)))
            yield _batch(rows, RESULT)

    answered = joined.select("doc_id", "n_bytes", "removed", "text", "spans").mapInArrow(run, RESULT)
    return placed.where("kept_sha256 is not null").select("doc_id", "n_bytes", "removed", "kept_sha256").union(answered)


def find(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, removed, kept_sha256): removed runs of bytes as packed 64-bit (start, end) pairs."""
    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges = max(1, -(-2 * total // (WINDOW * RANGE_ANCHORS)))
    told = decide(claims(texts, ranges), ranges).groupBy("doc_id").agg(F.collect_list("code").alias("codes"))
    placed = stage(place(texts, told), "placed")
    chunks = max(1, -(-placed.agg(F.coalesce(F.sum(F.length("shown")), F.lit(0))).first()[0] // (CHUNK_BYTES // 2)))
    # One anchor per CHUNK_BYTES of fragments at most, so they are few.
    hot = [r["anchor"] for r in sent_bytes(placed).where(F.col("bytes") > CHUNK_BYTES).select("anchor").collect()]
    answers = answer(fragments(placed, hot, False), chunks)
    return finish(placed, answers.union(answer_by_window(fragments(placed, hot, True))) if hot else answers)


def report(docs: DataFrame) -> DataFrame:
    """Per document: bytes, removed bytes and runs, digest of the rest."""
    found = find(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column(2).to_pylist()]
            sizes = [int((s[:, 1] - s[:, 0]).sum()) for s in spans]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array([len(s) for s in spans], pa.int64()), batch.column(3)],
                names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
            )

    return found.mapInArrow(run, "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string")

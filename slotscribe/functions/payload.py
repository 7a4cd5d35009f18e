"""Columnar payload decoding: one Arrow function per type, all rows of a batch at once.

A ``Cursor`` holds one read position per row. Reading a type yields one Arrow
array for all rows and moves the positions, so the Python work per batch is
proportional to the number of fields, not to the number of rows.

Reading rules: values are little-endian and follow the eight discriminator
bytes; a fixed-width read that does not fit gives NULL and leaves the position
where it is; bytes after the last field are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from .base58 import encode_matrix, ragged
from .discriminators import DISCRIMINATOR_BYTES
from .idl_types import FIXED_WIDTH, OPAQUE_TYPE, spark_type, struct_members

# Codes of the ``decode_issues`` column, in the order they are listed there. After
# them come notes, ``code=text`` in reading order, with what a column cannot
# hold: the exact digits of a wide integer, the declared length of a list.
ISSUES = ("truncated", "bad_utf8", "int128_overflow", "vec_len_capped", "bad_flag")

_NUMPY = {"u8": "u1", "u16": "<u2", "u32": "<u4", "i8": "i1", "i16": "<i2", "i32": "<i4", "i64": "<i8", "f32": "<f4", "f64": "<f8"}
_LIMIT_128 = 10**38
_WORD = 1 << 64


class Cursor:
    """Read positions of a set of rows; ``row`` maps them to rows of the whole batch."""

    def __init__(self, buf, pos, end, row, issues, notes):
        self.buf, self.pos, self.end, self.row, self.issues, self.notes = buf, pos, end, row, issues, notes

    def flag(self, code: str, where: np.ndarray) -> None:
        if where.any():
            self.issues[code][self.row[where]] = True

    def note(self, code: str, where: np.ndarray, texts: list[str]) -> None:
        """Flag rows and keep a text for each of them."""
        self.flag(code, where)
        if texts:
            self.notes.append((self.row[where], [f"{code}={t}" for t in texts]))

    def at(self, rows: np.ndarray) -> "Cursor":
        return Cursor(self.buf, self.pos[rows], self.end[rows], self.row[rows], self.issues, self.notes)

    def fixed(self, width: int) -> tuple[np.ndarray, np.ndarray]:
        """((n, width) bytes, fits): rows that do not fit keep their position."""
        fits = self.pos + width <= self.end
        at = np.where(fits, self.pos, 0)
        raw = self.buf[at[:, None] + np.arange(width)]
        self.pos = self.pos + np.where(fits, width, 0)
        self.flag("truncated", ~fits)
        return raw, fits

    def length(self) -> tuple[np.ndarray, np.ndarray]:
        """(u32 length prefix, present); a missing prefix counts as zero."""
        raw, fits = self.fixed(4)
        return np.where(fits, np.ascontiguousarray(raw).view("<u4").ravel().astype(np.int64), 0), fits

    def slices(self, lengths: np.ndarray, take: np.ndarray) -> pa.Array:
        """Binary values of the given lengths; rows not taken are NULL and do not move."""
        sizes = np.where(take, lengths, 0)
        offsets = np.zeros(len(sizes) + 1, dtype=np.int64)
        np.cumsum(sizes, out=offsets[1:])
        index = np.repeat(self.pos - offsets[:-1], sizes) + np.arange(offsets[-1])
        self.pos = self.pos + sizes
        return pa.Array.from_buffers(
            pa.binary(), len(sizes),
            [_validity(take), pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(self.buf[index].tobytes())],
        )


def _validity(mask: np.ndarray) -> pa.Buffer:
    return pa.py_buffer(np.packbits(mask, bitorder="little").tobytes())


def _decimals(low: np.ndarray, high: np.ndarray, valid: np.ndarray, digits: int) -> pa.Array:
    words = np.empty((len(low), 2), dtype="<u8")
    words[:, 0], words[:, 1] = low, high
    return pa.Array.from_buffers(pa.decimal128(digits, 0), len(low), [_validity(valid), pa.py_buffer(words.tobytes())])


def _fits_38_digits(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Whether a non-negative 128-bit number given as two words is below 10**38."""
    top, rest = np.uint64(_LIMIT_128 // _WORD), np.uint64(_LIMIT_128 % _WORD)
    return (high < top) | ((high == top) & (low < rest))


def _read_fixed(kind: str, cur: Cursor) -> pa.Array:
    raw, fits = cur.fixed(FIXED_WIDTH[kind][0])
    raw = np.ascontiguousarray(raw)
    if kind == "bool":
        return pa.array(raw.ravel() != 0, mask=~fits)
    if kind == "pubkey":
        return encode_matrix(raw).take(pa.array(np.arange(len(raw)), mask=~fits))
    if kind == "u64":
        low = raw.view("<u8").ravel()
        return _decimals(low, np.zeros_like(low), fits, 20)
    if kind in ("u128", "i128"):
        words = raw.view("<u8").reshape(-1, 2)
        low, high = words[:, 0], words[:, 1]
        negative = (high >> np.uint64(63)).astype(bool) if kind == "i128" else np.zeros(len(low), bool)
        size_low = np.where(negative, ~low + np.uint64(1), low)
        size_high = np.where(negative, ~high + (low == 0), high)
        small = _fits_38_digits(size_low, size_high)
        wide = fits & ~small
        signed = kind == "i128"
        cur.note("int128_overflow", wide, [str(int.from_bytes(b, "little", signed=signed)) for b in map(bytes, raw[wide])])
        return _decimals(low, high, fits & small, 38)
    values = raw.view(_NUMPY[kind]).ravel()
    return pa.array(values, mask=~fits).cast(to_arrow_type(FIXED_WIDTH[kind][1]))


def _read_text(cur: Cursor) -> pa.Array:
    lengths, present = cur.length()
    take = present & (cur.pos + lengths <= cur.end)
    cur.flag("truncated", present & ~take)
    return _texts(cur, lengths, take)


def _texts(cur: Cursor, lengths: np.ndarray, take: np.ndarray) -> pa.Array:
    """Text of the given lengths; what is no UTF-8 is NULL and flagged."""
    raw = cur.slices(lengths, take)
    try:
        return raw.cast(pa.string())
    except pa.ArrowInvalid:
        good = _valid_halves(raw)
        cur.flag("bad_utf8", take & ~good)
        return raw.filter(pa.array(good)).cast(pa.string()).take(pa.array(np.cumsum(good) - 1, mask=~good))


def _valid_halves(raw: pa.Array) -> np.ndarray:
    """Which values are UTF-8: parts that are valid as a whole are not looked at further."""
    try:
        raw.cast(pa.string())
        return np.ones(len(raw), bool)
    except pa.ArrowInvalid:
        if len(raw) <= 8:
            return np.array([v is None or _utf8_or_none(v) is not None for v in raw.to_pylist()], bool)
        half = len(raw) // 2
        return np.concatenate([_valid_halves(raw[:half]), _valid_halves(raw[half:])])


def _utf8_or_none(value: bytes) -> str | None:
    try:
        return value.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _read_bytes(cur: Cursor) -> pa.Array:
    lengths, present = cur.length()
    take = cur.pos + lengths <= cur.end
    cur.flag("truncated", ~take)
    return cur.slices(lengths, take)


def _read_option(item: tuple, cur: Cursor) -> pa.Array:
    raw, fits = cur.fixed(1)
    some = np.flatnonzero(fits & (raw.ravel() != 0))
    inner = cur.at(some)
    values = read(item, inner)
    cur.pos[some] = inner.pos
    return _scatter(values, some, len(cur.pos))


def _scatter(values: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """An array of n with ``values`` at ``rows`` and NULL elsewhere."""
    slot = np.full(n, -1, dtype=np.int64)
    slot[rows] = np.arange(len(rows))
    return values.take(pa.array(slot, mask=slot < 0))


def _read_prefixed_list(kind: str, counts: np.ndarray, cur: Cursor) -> tuple[pa.Array, np.ndarray]:
    """(items, items held per row) of lists of texts or bytes.

    Each length tells where the next one is, so one pass over the bytes finds
    all items, and then they are cut out at once.
    """
    view, starts, lengths, takes = cur.buf.tobytes(), [], [], []
    held, missing = np.zeros(len(counts), dtype=np.int64), np.zeros(len(counts), dtype=bool)
    for i in np.flatnonzero(counts > 0).tolist():
        at, end, n = int(cur.pos[i]), int(cur.end[i]), 0
        for _ in range(int(counts[i])):
            if at + 4 > end:
                missing[i] = True
                break
            length = int.from_bytes(view[at : at + 4], "little")
            at += 4
            fits = at + length <= end
            starts.append(at)
            lengths.append(length)
            takes.append(fits)
            at += length if fits else 0
            n += 1
        cur.pos[i], held[i] = at, n
    rows = np.repeat(np.arange(len(counts)), held)
    take = np.array(takes, dtype=bool)
    inner = Cursor(cur.buf, np.array(starts, dtype=np.int64), cur.end[rows], cur.row[rows], cur.issues, cur.notes)
    cur.flag("truncated", missing)
    inner.flag("truncated", ~take)
    sizes = np.array(lengths, dtype=np.int64)
    return (_texts if kind == "string" else Cursor.slices)(inner, sizes, take), held


def _read_items(item: tuple, counts: np.ndarray, cur: Cursor, pad: bool) -> pa.Array:
    """Lists of up to ``counts`` items.

    Items that consume no bytes would repeat without end, so they are not
    materialised unless the layout fixes their number (``pad``).
    """
    width = FIXED_WIDTH[item[0]][0] if item[0] in FIXED_WIDTH else None
    if item[0] in ("string", "bytes") and not pad:
        values, held = _read_prefixed_list(item[0], counts, cur)
        parts, owners, order = [values], [np.repeat(np.arange(len(counts)), held)], [np.arange(len(values))]
    elif width:
        held = np.minimum(counts, np.maximum(cur.end - cur.pos, 0) // width)
        rows = np.repeat(np.arange(len(counts)), held)
        nth = np.arange(len(rows)) - np.repeat(np.cumsum(held) - held, held)
        inner = Cursor(cur.buf, cur.pos[rows] + nth * width, cur.end[rows], cur.row[rows], cur.issues, cur.notes)
        parts, owners, order = [read(item, inner)], [rows], [nth]
        cur.pos = cur.pos + held * width
    else:
        held = np.zeros(len(counts), dtype=np.int64)
        parts, owners, order = [], [], []
        rows, nth = np.flatnonzero(counts > 0), 0
        while len(rows):
            inner = cur.at(rows)
            start = inner.pos
            values = read(item, inner)
            keep = (inner.pos > start) | pad
            done = rows[keep]
            if not keep.all():
                values = values.filter(pa.array(keep))
            cur.pos[done] = inner.pos[keep]
            held[done] += 1
            parts.append(values)
            owners.append(done)
            order.append(np.full(len(done), nth))
            nth += 1
            rows = done[counts[done] > nth]
    short = counts > held
    missing = np.where(short & pad, counts - held, 0)
    if missing.any():
        rows = np.repeat(np.arange(len(counts)), missing)
        parts.append(pa.nulls(len(rows), to_arrow_type(spark_type(item))))
        owners.append(rows)
        order.append(np.full(len(rows), np.iinfo(np.int64).max))
    if pad:
        cur.flag("truncated", short)
    else:
        cur.note("vec_len_capped", short, [str(n) for n in counts[short].tolist()])
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(held + missing, out=offsets[1:])
    kind = to_arrow_type(spark_type(item))
    if parts:
        by_row = np.lexsort((np.concatenate(order), np.concatenate(owners)))
        flat = pa.concat_arrays([p.cast(kind) for p in parts]).take(pa.array(by_row))
    else:
        flat = pa.array([], kind)
    return pa.ListArray.from_arrays(pa.array(offsets), flat)


_HEX_DIGITS = np.array([f"{b:02x}".encode() for b in range(256)]).view("<u2")


def _hex(raw: pa.Array) -> pa.Array:
    """Lower-case hex of binary values: two digits per byte, offsets doubled."""
    data, offsets = ragged(raw)
    digits = _HEX_DIGITS[data[offsets[0] : offsets[-1]]].tobytes()
    moved = ((offsets - offsets[0]) * 2).astype(np.int32)
    valid = _validity(~raw.is_null().to_numpy(zero_copy_only=False))
    return pa.Array.from_buffers(pa.string(), len(raw), [valid, pa.py_buffer(moved), pa.py_buffer(digits)])


def _read_opaque(flag: bool, cur: Cursor) -> pa.Array:
    left = np.maximum(cur.end - cur.pos, 0)
    take = left > 0
    cur.flag("truncated", ~take)
    size = left.copy()
    raw = cur.slices(left, take)
    if flag:
        values = pa.array([v == b"\x01" if v is not None and len(v) == 1 else None for v in raw.to_pylist()], pa.bool_())
        cur.flag("bad_flag", size > 1)
        return values
    texts = _hex(raw)
    return pa.StructArray.from_arrays([texts], names=[OPAQUE_TYPE.names[0]], mask=pa.array(~take))


def read(tree: tuple, cur: Cursor) -> pa.Array:
    """Read one value per row and move the cursor."""
    kind = tree[0]
    if kind in FIXED_WIDTH:
        return _read_fixed(kind, cur)
    if kind == "string":
        return _read_text(cur)
    if kind == "bytes":
        return _read_bytes(cur)
    if kind == "option":
        return _read_option(tree[1], cur)
    if kind == "vec":
        counts, _ = cur.length()
        return _read_items(tree[1], counts, cur, pad=False)
    if kind == "array":
        return _read_items(tree[1], np.full(len(cur.pos), tree[2], dtype=np.int64), cur, pad=True)
    if kind == "opaque":
        return _read_opaque(tree[1], cur)
    if kind == "struct":
        values = {}
        for name, item in tree[1]:
            values[name] = read(item, cur)
        names = [name for name, _ in struct_members(tree)]
        if not names:
            return pa.array([{}] * len(cur.pos), pa.struct([]))
        return pa.StructArray.from_arrays([values[n] for n in names], names=names)
    return pa.nulls(len(cur.pos), pa.string())


def decode_batch(payload: pa.Array, fields: list[tuple[str | None, tuple]]) -> pa.Array:
    """Struct of the named fields plus ``decode_issues`` for a batch of payloads.

    Fields whose name is None are read for their bytes only.
    """
    data, offsets = ragged(payload)
    n = len(payload)
    buf = np.concatenate([data, np.zeros(32, np.uint8)])
    issues = {code: np.zeros(n, dtype=bool) for code in ISSUES}
    end = offsets[1:].copy()
    notes: list[tuple[np.ndarray, list[str]]] = []
    cur = Cursor(buf, np.minimum(offsets[:-1] + DISCRIMINATOR_BYTES, end), end, np.arange(n), issues, notes)
    columns, names = [], []
    for name, tree in fields:
        values = read(tree, cur)
        if name is not None:
            names.append(name)
            columns.append(values.cast(to_arrow_type(spark_type(tree))))
    flagged, which = np.nonzero(np.stack([issues[code] for code in ISSUES], axis=1))
    rows = np.concatenate([flagged, *[r for r, _ in notes]])
    texts = pa.array([*np.array(ISSUES)[which].tolist(), *[t for _, ts in notes for t in ts]], pa.string())
    counts = np.zeros(n + 1, dtype=np.int32)
    np.cumsum(np.bincount(rows, minlength=n), out=counts[1:])
    listed = pa.ListArray.from_arrays(pa.array(counts), texts.take(pa.array(np.argsort(rows, kind="stable"))))
    return pa.StructArray.from_arrays([*columns, listed], names=[*names, "decode_issues"])


def payload_type(fields: list[tuple[str | None, tuple]]) -> T.StructType:
    """Struct type produced for ``fields``."""
    named = [T.StructField(name, spark_type(tree)) for name, tree in fields if name is not None]
    return T.StructType([*named, T.StructField("decode_issues", T.ArrayType(T.StringType()))])


def payload_decoder(fields: list[tuple[str | None, tuple]]):
    """Arrow function payload -> struct of all fields of one type."""

    def decode(payload: pa.Array) -> pa.Array:
        return decode_batch(payload, fields)

    decode.__annotations__ = {"payload": pa.Array, "return": pa.Array}
    return arrow_udf(decode, returnType=payload_type(fields))

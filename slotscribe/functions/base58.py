"""Base58 text <-> bytes as Arrow functions over whole column batches.

Spark has no 256-bit arithmetic, so these are the only conversions that leave
the JVM. Both work on all rows of a batch at once: numbers are held as limb
columns and carried with numpy, never value by value.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType, StringType

# Fixed value: the base58 alphabet.
ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"

_CHARS = np.frombuffer(ALPHABET.encode(), dtype=np.uint8)
_DIGIT_OF = np.full(256, 255, dtype=np.uint8)
_DIGIT_OF[_CHARS] = np.arange(58, dtype=np.uint8)
_GROUP = 5  # base58 digits per limb: 58**5 < 2**30, so limb products fit in 64 bits
_GROUP_BASE = np.uint64(58**_GROUP)


def ragged(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a binary or string array; NULL slots are empty."""
    array = array.cast(pa.binary())
    n = len(array)
    offsets = np.frombuffer(array.buffers()[1], dtype=np.int32)[array.offset : array.offset + n + 1].astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, dtype=np.uint8) if raw is not None else np.zeros(0, np.uint8)
    return data, offsets


def from_rows(matrix: np.ndarray, keep: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Join the kept cells of each row into one binary/string value per row."""
    offsets = np.zeros(len(matrix) + 1, dtype=np.int32)
    np.cumsum(keep.sum(axis=1), out=offsets[1:])
    return pa.Array.from_buffers(kind, len(matrix), [None, pa.py_buffer(offsets), pa.py_buffer(matrix[keep].tobytes())])


def _leading(flags: np.ndarray) -> np.ndarray:
    """Number of leading True cells per row."""
    return np.where(flags.all(axis=1), flags.shape[1], (~flags).argmax(axis=1))


def _join_leading(count: np.ndarray, filler: np.uint8, cells: np.ndarray, skipped: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Per row: ``count`` fillers, then its cells after the ``skipped`` leading ones."""
    pad = int(count.max(initial=0))
    matrix = np.concatenate([np.full((len(cells), pad), filler), cells], axis=1)
    column = np.arange(matrix.shape[1])
    first = (pad + skipped)[:, None]
    keep = column >= first
    if pad:
        keep |= (column < pad) & (column >= (pad - count)[:, None])
    return from_rows(matrix, keep, kind)


def encode_matrix(raw: np.ndarray) -> pa.Array:
    """Base58 text of an (n, width) byte matrix; width is a multiple of four."""
    n, width = raw.shape
    words = np.ascontiguousarray(raw).view(">u4").astype(np.uint64)
    limbs = np.zeros((-(-width * 1366 // 1000 // _GROUP) + 1, n), dtype=np.uint64)
    for word in np.ascontiguousarray(words.T):
        carry = word
        for limb in limbs[::-1]:
            total = (limb << np.uint64(32)) + carry
            carry = total // _GROUP_BASE
            limb[:] = total - carry * _GROUP_BASE
    rest = limbs.astype(np.uint32)
    digits = np.empty((n, len(limbs), _GROUP), dtype=np.uint8)
    for place in range(_GROUP - 1, -1, -1):
        upper = rest // np.uint32(58)
        digits[:, :, place] = (rest - upper * np.uint32(58)).T
        rest = upper
    digits = digits.reshape(n, len(limbs) * _GROUP)
    return _join_leading(_leading(raw == 0), _CHARS[0], _CHARS[digits], _leading(digits == 0), pa.string())


def _decode_matrix(digits: np.ndarray, ones: np.ndarray) -> pa.Array:
    """Bytes of an (n, 5k) digit matrix that was left-padded with zero digits."""
    n, columns = digits.shape
    limbs = np.zeros((-(-columns * 733 // 1000 // 4) + 1, n), dtype=np.uint64)
    by_place = np.ascontiguousarray(digits.T).astype(np.uint32).reshape(-1, _GROUP, n)
    groups = by_place[:, 0]
    for place in range(1, _GROUP):
        groups = groups * np.uint32(58) + by_place[:, place]
    for group in groups.astype(np.uint64):
        carry = group
        for limb in limbs[::-1]:
            total = limb * _GROUP_BASE + carry
            limb[:] = total & np.uint64(0xFFFFFFFF)
            carry = total >> np.uint64(32)
    raw = np.ascontiguousarray(limbs.T.astype(">u4")).view(np.uint8).reshape(n, 4 * len(limbs))
    return _join_leading(ones, np.uint8(0), raw, _leading(raw == 0), pa.binary())


def decode_strings(array: pa.Array) -> pa.Array:
    """Bytes of each base58 string; invalid or NULL text gives empty bytes."""
    data, offsets = ragged(array)
    lengths = np.diff(offsets)
    if array.null_count:
        lengths = np.where(array.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    # Rows of similar length share one matrix, so padding at most doubles the work.
    size_class = np.ceil(np.log2(np.maximum(lengths, 8))).astype(int)
    parts, rows = [], []
    for size in np.unique(size_class):
        chosen = np.flatnonzero(size_class == size)
        width = -(-int(lengths[chosen].max()) // _GROUP) * _GROUP or _GROUP
        held = lengths[chosen]
        index = np.repeat(offsets[chosen] - (np.cumsum(held) - held), held) + np.arange(held.sum())
        digits = np.zeros((len(chosen), width), dtype=np.uint8)
        digits[np.arange(width) >= (width - held)[:, None]] = _DIGIT_OF[data[index]]
        bad = (digits == 255).any(axis=1)
        digits[bad] = 0
        ones = np.where(bad, 0, _leading(digits == 0) - (width - held))
        parts.append(_decode_matrix(digits, ones))
        rows.append(chosen)
    if not parts:
        return pa.array([], pa.binary())
    return pa.concat_arrays(parts).take(pa.array(np.argsort(np.concatenate(rows), kind="stable")))


@arrow_udf(returnType=BinaryType())
def base58_decode(text: pa.Array) -> pa.Array:
    """Base58 text to bytes; text that is not base58 gives empty bytes."""
    return decode_strings(text)


@arrow_udf(returnType=StringType())
def base58_encode_key(key: pa.Array) -> pa.Array:
    """32-byte keys to base58 text; any other length gives NULL."""
    data, offsets = ragged(key)
    good = np.flatnonzero(np.diff(offsets) == 32)
    text = encode_matrix(data[offsets[good][:, None] + np.arange(32)]) if len(good) else pa.array([], pa.string())
    slot = np.full(len(key), -1, dtype=np.int64)
    slot[good] = np.arange(len(good))
    return text.take(pa.array(slot, mask=slot < 0))

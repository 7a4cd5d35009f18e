"""Little-endian readers built from column expressions only (no Python at run time).

Every reader takes the payload column and a zero-based position and assumes the
bytes are there; callers guard with the payload length.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_POW64 = "18446744073709551616"


def _byte(data: Column, position: Column, width: int = 1) -> Column:
    return F.substring(data, position + 1, F.lit(width))


def big_endian_hex(data: Column, position: Column, width: int) -> Column:
    """Hex digits of a little-endian number, most significant byte first."""
    return F.hex(F.concat(*[_byte(data, position + k) for k in reversed(range(width))]))


def unsigned(data: Column, position: Column, width: int) -> Column:
    """Unsigned number of up to eight bytes as decimal text."""
    return F.conv(big_endian_hex(data, position, width), 16, 10)


def _signed64(data: Column, position: Column) -> Column:
    return F.conv(big_endian_hex(data, position, 8), 16, -10).cast("bigint")


def _signed(data: Column, position: Column, width: int) -> Column:
    value = unsigned(data, position, width).cast("bigint")
    half = 1 << (8 * width - 1)
    return F.when(value >= half, value - 2 * half).otherwise(value).cast("int")


def _base() -> Column:
    return F.lit(_POW64).cast("decimal(20,0)")


def wide_words(data: Column, position: Column) -> tuple[Column, Column]:
    """Both halves of a 128-bit number: the low one unsigned, DECIMAL(20,0), the high one as a BIGINT of the same bits."""
    return unsigned(data, position, 8).cast("decimal(20,0)"), _signed64(data, position + 8)


def _magnitude(low: Column, high: Column, signed: bool) -> tuple[Column, Column, Column]:
    """(negative, high, low) of a 128-bit number's magnitude; the high half keeps its bits, the low one may be 2**64."""
    if not signed:
        return F.lit(False), high, low
    negative = high < 0
    return negative, F.when(negative, F.bitwise_not(high)).otherwise(high), F.when(negative, _base() - low).otherwise(low)


def wide_value(low: Column, high: Column, signed: bool) -> Column:
    """128-bit number of its halves as DECIMAL(38,0); NULL from 10**38 on, without computing what does not fit."""
    negative, words, rest = _magnitude(low, high, signed)
    most, left = divmod(10**38, 1 << 64)
    fits = (words >= 0) & ((words < most) | ((words == most) & (rest < F.lit(str(left)).cast("decimal(20,0)"))))
    # Counting down from the next multiple keeps every partial result of a negative number as small as the value.
    times, plus = high.cast("decimal(20,0)"), low
    if signed:
        times, plus = F.when(negative, times + 1).otherwise(times).cast("decimal(20,0)"), F.when(negative, low - _base()).otherwise(low)
    return F.when(fits, ((times * _base()).cast("decimal(38,0)") + plus).cast("decimal(38,0)"))


def wide_digits(low: Column, high: Column, signed: bool, wanted: Column, bind: Callable[[Column], Column]) -> Column:
    """All digits of a 128-bit number as text, also from 10**38 on; only for rows that are ``wanted``.

    2**96 and 2**64 are split at 10**19, so that every product fits a decimal;
    the carry and the low 19 digits are cut from the text of the low part, which
    ``bind`` makes a column of its own because it is used several times.
    """
    negative, words, least = _magnitude(low, high, signed)
    middle, top = words.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(words, 32)
    times = lambda word, factor: (word.cast("decimal(10,0)") * F.lit(factor).cast("decimal(19,0)")).cast("decimal(38,0)")
    rest = times(top, (1 << 96) % 10**19) + times(middle, (1 << 64) % 10**19) + least
    text = bind(F.when(wanted, rest.cast("decimal(38,0)").cast("string")))
    size = F.char_length(text)
    carry = F.when(size > 19, F.left(text, size - 19).cast("decimal(20,0)")).otherwise(F.lit(0).cast("decimal(20,0)"))
    head = times(top, (1 << 96) // 10**19) + middle + carry
    return F.concat(F.when(negative, "-").otherwise(""), head.cast("decimal(38,0)").cast("string"), F.lpad(F.right(text, F.lit(19)), 19, "0"))


def _float(data: Column, position: Column, width: int) -> Column:
    """IEEE number from its sign, exponent and fraction bits; every step is exact."""
    fraction_bits, exponent_bits, bias = (52, 11, 1023) if width == 8 else (23, 8, 127)
    bits = _signed64(data, position) if width == 8 else unsigned(data, position, 4).cast("bigint")
    top = (1 << exponent_bits) - 1
    exponent = F.shiftrightunsigned(bits, fraction_bits).bitwiseAND(F.lit(top))
    fraction = bits.bitwiseAND(F.lit((1 << fraction_bits) - 1))
    sign = F.when(F.shiftrightunsigned(bits, fraction_bits + exponent_bits).bitwiseAND(F.lit(1)) == 1, -1.0).otherwise(1.0)
    special = F.when(fraction > 0, F.lit(float("nan"))).otherwise(sign * F.lit(float("inf")))
    scale = F.pow(F.lit(2.0), (F.greatest(exponent, F.lit(1)) - bias - fraction_bits).cast("double"))
    whole = F.when(exponent > 0, fraction + (1 << fraction_bits)).otherwise(fraction).cast("double")
    value = F.when(exponent == top, special).otherwise(sign * whole * scale)
    return value if width == 8 else value.cast("float")


def fixed_value(kind: str, data: Column, position: Column) -> Column:
    """Value of a fixed-width primitive other than a public key."""
    match kind:
        case "bool":
            return _byte(data, position) != F.lit(b"\x00")
        case "u8" | "u16":
            return unsigned(data, position, int(kind[1:]) // 8).cast("int")
        case "u32":
            return unsigned(data, position, 4).cast("bigint")
        case "u64":
            return unsigned(data, position, 8).cast("decimal(20,0)")
        case "i8" | "i16" | "i32":
            return _signed(data, position, int(kind[1:]) // 8)
        case "i64":
            return _signed64(data, position)
        case "u128" | "i128":
            return wide_value(*wide_words(data, position), kind == "i128")
        case "f32" | "f64":
            return _float(data, position, int(kind[1:]) // 8)
    raise ValueError(f"not a fixed-width number: {kind}")

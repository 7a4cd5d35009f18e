"""Decode a binary payload column into the typed columns of one instruction or account type.

Two engines give the same result:

* ``native``: column expressions only. Best for one or two values per row, or
  when no Python workers are wanted.
* ``arrow``: one columnar Arrow function per type. Best for whole rows, and the
  only one for lists of variable-width items.

crossover.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.base58 import base58_encode_key
from ..functions.discriminators import DISCRIMINATOR_BYTES
from ..functions.idl_types import FIXED_WIDTH, OPAQUE_TYPE, fixed_width, spark_type, struct_members
from ..functions.little_endian import fixed_value, unsigned, wide_digits, wide_value, wide_words
from ..functions.payload import ISSUES, payload_decoder

# Values per row up to which column expressions beat the Arrow round trip.
NATIVE_MAX_VALUES = 2


def native_supported(tree: tuple) -> bool:
    """Whether a type can be decoded with column expressions."""
    match tree[0]:
        case "vec" | "array":
            return fixed_width(tree[1]) is not None and tree[1][0] not in ("pubkey", "u128", "i128")
        case "option":
            return native_supported(tree[1])
        case "struct":
            return bool(tree[1]) and all(native_supported(item) for _, item in tree[1])
    return True


def _values(tree: tuple) -> int:
    """Rough number of values in a type; lists count as expensive."""
    match tree[0]:
        case "struct":
            return sum(_values(item) for _, item in tree[1])
        case "option":
            return 1 + _values(tree[1])
        case "vec" | "array" | "pubkey":
            return NATIVE_MAX_VALUES + 1
    return 1


class _Chain:
    """Adds position columns one projection at a time.

    Each position is used several times by the next one, so the optimizer keeps
    the projections apart and the expressions stay small however many fields
    there are.
    """

    def __init__(self, df: DataFrame, data: str):
        self.df, self.data, self.count = df, F.col(data), 0
        self.issues: dict[str, list[Column]] = {code: [] for code in ISSUES}
        self.notes: list[Column] = []
        self.end = self.bind(F.octet_length(self.data))

    def bind(self, expression: Column) -> Column:
        self.count += 1
        name = f"_at_{self.count}"
        self.df = self.df.select("*", expression.alias(name))
        return F.col(name)

    def flag(self, code: str, condition: Column, live: Column | None) -> None:
        self.issues[code].append(condition if live is None else live & condition)

    def note(self, code: str, condition: Column, live: Column | None, text: Column) -> None:
        """Flag rows and keep a text for each of them."""
        self.flag(code, condition, live)
        raised = condition if live is None else live & condition
        # A column of its own: inside the filter that collects the notes it would be interpreted, not compiled.
        self.notes.append(self.bind(F.when(F.coalesce(raised, F.lit(False)), F.concat(F.lit(f"{code}="), text))))

    def read(self, tree: tuple, at: Column, live: Column | None = None) -> tuple[Column, Column]:
        """(value, next position) of one field read at ``at``."""
        kind, data, end = tree[0], self.data, self.end
        if kind in FIXED_WIDTH:
            width = FIXED_WIDTH[kind][0]
            fits = at + width <= end
            self.flag("truncated", ~fits, live)
            if kind == "pubkey":
                value = base58_encode_key(F.when(fits, F.substring(data, at + 1, F.lit(width))))
            elif kind in ("u128", "i128"):
                # Bound, because all are used more than once and none is cheap.
                low, high = (self.bind(F.when(fits, word)) for word in wide_words(data, at))
                value = self.bind(wide_value(low, high, kind == "i128"))
                lost = fits & value.isNull()
                self.note("int128_overflow", lost, live, wide_digits(low, high, kind == "i128", lost, self.bind))
            else:
                value = F.when(fits, fixed_value(kind, data, at))
            return value, self.bind(F.when(fits, at + width).otherwise(at))
        if kind in ("string", "bytes"):
            present, length, start = self._prefix(at, live)
            take = start + length <= end
            if kind == "string":
                take = present & take
            self.flag("truncated", ~take, live)
            size = self.bind(F.when(take, length).otherwise(0).cast("int"))
            raw = F.substring(data, start + 1, size)
            if kind == "string":
                value = F.when(take, F.try_validate_utf8(raw.cast("string")))
                self.flag("bad_utf8", take & ~F.is_valid_utf8(raw.cast("string")), live)
            else:
                value = F.when(take, raw)
            return value, self.bind(start + size)
        if kind == "option":
            fits = at + 1 <= end
            self.flag("truncated", ~fits, live)
            some = self.bind(F.coalesce(fits & (F.substring(data, at + 1, F.lit(1)) != F.lit(b"\x00")), F.lit(False)))
            start = self.bind(F.when(fits, at + 1).otherwise(at))
            value, after = self.read(tree[1], start, some if live is None else live & some)
            return F.when(some, value), self.bind(F.when(some, after).otherwise(start))
        if kind == "vec":
            _, length, start = self._prefix(at, live)
            width = fixed_width(tree[1])
            held = self.bind(F.least(length, F.floor((end - start) / width)).cast("int"))
            self.note("vec_len_capped", length > held, live, length.cast("string"))
            items = F.transform(
                F.sequence(F.lit(0), F.greatest(held, F.lit(1)) - 1),
                lambda i: fixed_value(tree[1][0], data, start + i * width),
            )
            empty = F.array().cast(spark_type(tree))
            return F.when(held > 0, items).otherwise(empty), self.bind(start + held * width)
        if kind == "array":
            width, count = fixed_width(tree[1]), tree[2]
            if not count:
                return F.array().cast(spark_type(tree)), at
            held = self.bind(F.least(F.lit(count), F.floor((end - at) / width)).cast("int"))
            self.flag("truncated", held < count, live)
            items = F.transform(
                F.sequence(F.lit(0), F.lit(count - 1)),
                lambda i: F.when(i < held, fixed_value(tree[1][0], data, at + i * width)),
            )
            return items, self.bind(at + held * width)
        if kind == "opaque":
            left = at < end
            rest = F.substring(data, at + 1, F.greatest(end - at, F.lit(0)))
            self.flag("truncated", ~left, live)
            if tree[1]:
                value = F.when(end - at == 1, rest == F.lit(b"\x01"))
                self.flag("bad_flag", end - at > 1, live)
            else:
                value = F.when(left, F.struct(F.lower(F.hex(rest)).alias(OPAQUE_TYPE.names[0])))
            return value, self.bind(F.when(left, end).otherwise(at))
        if kind == "struct":
            members = {}
            for name, item in tree[1]:
                members[name], at = self.read(item, at, live)
            return F.struct(*[members[name].alias(name) for name, _ in struct_members(tree)]), at
        return F.lit(None).cast("string"), at

    def _prefix(self, at: Column, live: Column | None) -> tuple[Column, Column, Column]:
        """(present, length, start) of a u32 length prefix; a missing one counts as zero."""
        present = self.bind(at + 4 <= self.end)
        self.flag("truncated", ~present, live)
        length = self.bind(F.when(present, unsigned(self.data, at, 4).cast("bigint")).otherwise(F.lit(0).cast("bigint")))
        return present, length, self.bind(F.when(present, at + 4).otherwise(at))

    def issue_list(self) -> Column:
        raised = [
            F.when(F.coalesce(_any(conditions), F.lit(False)), F.lit(code))
            for code, conditions in self.issues.items()
            if conditions
        ]
        if not raised:
            return F.array().cast("array<string>")
        return F.filter(F.array(*raised, *self.notes), lambda code: code.isNotNull())


def _any(conditions: list[Column]) -> Column:
    combined = conditions[0]
    for condition in conditions[1:]:
        combined = combined | condition
    return combined


def _decode_native(df: DataFrame, fields: list[tuple[str | None, tuple]], data: str) -> DataFrame:
    base = df.columns
    chain = _Chain(df, data)
    at = chain.bind(F.least(F.lit(DISCRIMINATOR_BYTES), chain.end))
    columns = []
    for name, tree in fields:
        value, at_next = chain.read(tree, at)
        if name is not None:
            columns.append(value.cast(spark_type(tree)).alias(name))
        at = at_next
    kept = [F.col(f"`{c}`") for c in base if c != data]
    return chain.df.select(*kept, *columns, chain.issue_list().alias("decode_issues"))


def _decode_arrow(df: DataFrame, fields: list[tuple[str | None, tuple]], data: str) -> DataFrame:
    kept = [F.col(f"`{c}`") for c in df.columns if c != data]
    names = [name for name, _ in fields if name is not None]
    decoded = payload_decoder(fields)(F.col(data)).alias("_decoded")
    picked = [F.col("_decoded").getField(name).alias(name) for name in [*names, "decode_issues"]]
    return df.select(*kept, decoded).select(*kept, *picked)


def decode_payload(
    df: DataFrame,
    fields: list[tuple[str | None, tuple]],
    *,
    data: str = "data",
    columns: list[str] | None = None,
    engine: str = "auto",
) -> DataFrame:
    """Replace ``data`` by one column per named field and ``decode_issues``.

    ``fields`` are (column or None, type tree) in layout order. With ``columns``
    only those are produced, and nothing after the last of them is read.
    """
    if columns is not None:
        last = max((i for i, (name, _) in enumerate(fields) if name in columns), default=-1)
        fields = [(name if name in columns else None, tree) for name, tree in fields[: last + 1]]
    able = all(native_supported(tree) for _, tree in fields)
    if engine == "auto":
        engine = "native" if able and sum(_values(tree) for _, tree in fields) <= NATIVE_MAX_VALUES else "arrow"
    if engine == "native":
        if not able:
            raise ValueError("lists of variable-width items or keys need the arrow engine")
        return _decode_native(df, fields, data)
    return _decode_arrow(df, fields, data)

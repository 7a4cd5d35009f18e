"""Interface-description types: JSON text -> a small type tree, its label and its Spark type.

A type tree is a tuple whose first item is the kind: ``("u64",)``,
``("vec", item)``, ``("option", item)``, ``("array", item, n)``,
``("struct", ((name, type), ...))``, ``("opaque", flag)`` for a reference to a
named type, and ``("unknown",)``.
"""

from __future__ import annotations

import json

from pyspark.sql import types as T

# Byte width and Spark type of every fixed-width primitive.
FIXED_WIDTH = {
    "bool": (1, T.BooleanType()),
    "u8": (1, T.IntegerType()),
    "u16": (2, T.IntegerType()),
    "u32": (4, T.LongType()),
    "u64": (8, T.DecimalType(20, 0)),
    "u128": (16, T.DecimalType(38, 0)),
    "i8": (1, T.IntegerType()),
    "i16": (2, T.IntegerType()),
    "i32": (4, T.IntegerType()),
    "i64": (8, T.LongType()),
    "i128": (16, T.DecimalType(38, 0)),
    "f32": (4, T.FloatType()),
    "f64": (8, T.DoubleType()),
    "pubkey": (32, T.StringType()),
}
# Spelling variants, length-prefixed primitives, the flag type stored as opaque bytes.
ALIASES = {"publicKey": "pubkey"}
PREFIXED = {"string": T.StringType(), "bytes": T.BinaryType()}
OPAQUE_FLAG_NAME = "OptionBool"

OPAQUE_TYPE = T.StructType([T.StructField("raw_hex", T.StringType())])


def _as_json(text: str):
    """The parsed type; plain names come out of ``from_json`` unquoted and stay text."""
    if text[:1] in "{[":
        return json.loads(text)
    return text


def parse_type(text: str) -> tuple:
    """Type tree of the JSON text of one type."""
    return _tree(_as_json(text))


def _tree(node) -> tuple:
    if isinstance(node, str):
        name = ALIASES.get(node, node)
        return (name,) if name in FIXED_WIDTH or name in PREFIXED else ("unknown",)
    if not isinstance(node, dict):
        return ("unknown",)
    if "vec" in node:
        return ("vec", _tree(node["vec"]))
    if "option" in node:
        return ("option", _tree(node["option"]))
    pair = node.get("array")
    if isinstance(pair, list) and len(pair) == 2:
        count = pair[1] if isinstance(pair[1], int) and pair[1] > 0 else 0
        return ("array", _tree(pair[0]), count)
    if "defined" in node:
        named = node["defined"]
        return ("opaque", isinstance(named, dict) and named.get("name") == OPAQUE_FLAG_NAME)
    if isinstance(node.get("fields"), list):
        members = {}
        for number, field in enumerate(node["fields"]):
            if isinstance(field, dict) and "type" in field:
                members[number] = (field.get("name") or "_unknown", _tree(field["type"]))
        return ("struct", tuple(members.values()))
    return ("unknown",)


def type_label(text: str | None) -> str | None:
    """Readable type name for introspection: ``u64``, ``Vec<u8>``, ``[u8; 32]``, ``complex``."""
    return None if text is None else _label(_as_json(text))


def _label(node) -> str:
    match node:
        case str():
            return node
        case {"vec": item}:
            return f"Vec<{_label(item)}>"
        case {"option": item}:
            return f"Option<{_label(item)}>"
        case {"array": [item, count]}:
            return f"[{_label(item)}; {json.dumps(count)}]"
        case {"array": list()}:
            return "array"
        case {"defined": {"name": name}} if name == OPAQUE_FLAG_NAME:
            return name
        case {"raw_hex": str(text)} if len(text) == 2:
            return "bool"
        case dict():
            return "complex"
    return "unknown"


def spark_type(tree: tuple) -> T.DataType:
    """Column type holding a decoded value; every column is nullable."""
    kind = tree[0]
    if kind in FIXED_WIDTH:
        return FIXED_WIDTH[kind][1]
    if kind in PREFIXED:
        return PREFIXED[kind]
    if kind in ("vec", "array"):
        return T.ArrayType(spark_type(tree[1]))
    if kind == "option":
        return spark_type(tree[1])
    if kind == "opaque":
        return T.BooleanType() if tree[1] else OPAQUE_TYPE
    if kind == "struct":
        return T.StructType([T.StructField(name, spark_type(item)) for name, item in struct_members(tree)])
    return T.StringType()


def struct_members(tree: tuple) -> list[tuple[str, tuple]]:
    """Members by distinct name: of repeated names the last one gives the value."""
    return list(dict(tree[1]).items())


def fixed_width(tree: tuple) -> int | None:
    """Byte width of a fixed-width primitive, else None."""
    return FIXED_WIDTH[tree[0]][0] if tree[0] in FIXED_WIDTH else None

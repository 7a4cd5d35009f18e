"""Flat schemas from short text, usable before a session exists."""

from __future__ import annotations

from pyspark.sql import types as T

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(), "timestamp": T.TimestampType()}


def field(text: str) -> T.StructField:
    """``"slot bigint"`` as a field."""
    name, kind = text.split()
    return T.StructField(name, _TYPES[kind])


def schema(text: str) -> T.StructType:
    """``"slot bigint, err string"`` as a schema."""
    return T.StructType([field(part) for part in text.split(",")])

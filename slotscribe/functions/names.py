"""Identifier rules: snake case, table names and safe column names, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that may not be used as a bare column name.
RESERVED_WORDS = (
    "authorization", "between", "case", "cast", "check", "collate", "column",
    "constraint", "create", "cross", "current_date", "current_role",
    "current_time", "current_timestamp", "current_user", "data", "default",
    "desc", "distinct", "drop", "else", "end", "fetch", "for", "foreign",
    "from", "grant", "group", "in", "index", "into", "join", "like", "limit",
    "not", "null", "offset", "on", "only", "open", "or", "order", "primary",
    "references", "returning", "row", "select", "session", "some", "table",
    "then", "to", "trigger", "union", "unique", "user", "using", "value",
    "values", "where", "with",
)
# Longest column name, and longest remainder after the ``f_`` prefix.
MAX_COLUMN_CHARS = 59
MAX_PREFIXED_CHARS = 57
# Table name prefixes per entry kind.
TABLE_PREFIX = {"instruction": "ix_", "account": "acc_"}


def snake_case(name: Column) -> Column:
    """``_`` before every capital except a leading one, then lower case."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{IsUppercase})", "_$1"))


def column_name(name: Column) -> Column:
    """Snake case with every other character replaced by ``_``; reserved words get ``f_``."""
    clean = F.regexp_replace(snake_case(name), r"[^\p{IsAlphabetic}\p{N}_]", "_")
    return F.when(
        clean.isin(*RESERVED_WORDS),
        F.concat(F.lit("f_"), F.substring(clean, 1, MAX_PREFIXED_CHARS)),
    ).otherwise(F.substring(clean, 1, MAX_COLUMN_CHARS))


def table_name(kind: str, name: Column) -> Column:
    """Table of an instruction (``ix_``) or account (``acc_``) type."""
    return F.concat(F.lit(TABLE_PREFIX[kind]), snake_case(name))

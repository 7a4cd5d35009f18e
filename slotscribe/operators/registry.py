"""Interface descriptions -> registry: what each program's instructions and accounts look like.

``idl_registry`` is a Spark job over a table of JSON documents. ``load_program`` takes the few rows of one program to the driver as a
``Program``, which the decoding and writing jobs use to build their columns.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.discriminators import discriminator
from ..functions.idl_types import parse_type, spark_type, type_label
from ..functions.schema_text import field as schema_field
from ..functions.names import TABLE_PREFIX, column_name, table_name

# Upper bound on the entries of one program held on the driver and broadcast.
MAX_ENTRIES = 10_000

FIELD_LIST = "array<struct<name string, type string>>"
DOCUMENT = (
    "name string, version string, address string, metadata string,"
    "instructions array<string>, accounts array<string>, types array<string>"
)

# Columns every instruction / account table starts and ends with.
FIXED_COLUMNS = {
    "instruction": (["tx_sig string", "ix_index int", "slot bigint", "block_time bigint"], ["created_at timestamp"]),
    "account": (["address string", "slot bigint", "lamports bigint"], ["updated_at timestamp"]),
}
# Names a field column may not take because the table already has them.
TAKEN_COLUMNS = {
    "instruction": ("id", "tx_sig", "ix_index", "slot", "block_time", "created_at"),
    "account": ("address", "slot", "lamports", "updated_at"),
}
# Names this engine adds to stored tables.
ENGINE_COLUMNS = ("decode_issues", "slot_bucket", "writer", "batch_id")


def _entries(column: str, kind: str, fields) -> Column:
    """The JSON texts of ``column`` tagged with kind, place and the text of their field list."""
    return F.transform(
        F.coalesce(column, F.array().cast("array<string>")),
        lambda text, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("ordinal"),
            F.from_json(text, "name string, discriminator array<string>").alias("head"),
            fields(text).alias("fields_text"),
        ),
    )


def _account_fields(text: Column, types: Column) -> Column:
    """Field list text of an account: inline under ``type``, inline, or from the type of the same name."""
    name = F.get_json_object(text, "$.name")
    same_name = F.get(F.filter(types, lambda t: F.get_json_object(t, "$.name") == name), F.lit(0))
    return F.coalesce(
        F.get_json_object(text, "$.type.fields"),
        F.get_json_object(text, "$.fields"),
        F.get_json_object(same_name, "$.type.fields"),
        F.get_json_object(same_name, "$.fields"),
    )


def _address() -> Column:
    """The address a parsed document states, NULL if it states none."""
    return F.coalesce("doc.address", F.get_json_object("doc.metadata", "$.address"))


def stated_addresses(docs: DataFrame) -> DataFrame:
    """(program_id, address, accepted) of every document: one that states another address would be refused."""
    parsed = docs.select("program_id", F.from_json("idl", DOCUMENT).alias("doc")).select("program_id", _address().alias("address"))
    return parsed.select("program_id", "address", (F.coalesce("address", "program_id") == F.col("program_id")).alias("accepted"))


def idl_registry(docs: DataFrame, *, check_address: bool = True, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per named instruction and account type of every document.

    ``docs`` has ``program_id`` and ``idl`` (JSON text). A document that names
    another address than its ``program_id`` fails the job unless
    ``check_address`` is off. ``keep`` carries further columns through. There is
    no shuffle: a document is parsed and exploded where it is read.
    """
    parsed = docs.select("program_id", *keep, F.from_json("idl", DOCUMENT).alias("doc"))
    if check_address:
        address = _address()
        mismatch = F.concat(F.lit("document address "), address, F.lit(" is not program "), F.col("program_id"))
        parsed = parsed.where(
            F.when(F.coalesce(address, F.col("program_id")) == F.col("program_id"), F.lit(True)).otherwise(
                F.raise_error(mismatch).cast("boolean")
            )
        )
    entries = F.concat(
        _entries("doc.instructions", "instruction", lambda text: F.get_json_object(text, "$.args")),
        _entries("doc.accounts", "account", lambda text: _account_fields(text, F.col("doc.types"))),
    )
    rows = (
        parsed.select("program_id", *keep, F.coalesce("doc.name", F.lit("unknown")).alias("program_name"), F.explode(entries).alias("e"))
        .select("program_id", *keep, "program_name", "e.*")
        .where(F.col("head.name").isNotNull())
    )
    name, numbers = F.col("head.name"), F.col("head.discriminator")
    # Fields are those with a type, in layout order; ``column`` is NULL for nameless ones.
    typed = F.filter(F.from_json("fields_text", FIELD_LIST), lambda f: f["type"].isNotNull())
    fields = F.transform(
        F.coalesce(typed, F.array().cast(FIELD_LIST)),
        lambda f, i: F.struct(
            i.alias("ordinal"), f["name"].alias("name"), f["type"].alias("type"), column_name(f["name"]).alias("column")
        ),
    )

    def by_kind(build) -> Column:
        return F.when(F.col("kind") == "instruction", build("instruction")).otherwise(build("account"))

    return rows.select(
        "program_id", *keep, "program_name", "kind", "ordinal", name.alias("name"),
        by_kind(lambda kind: table_name(kind, name)).alias("table_name"),
        by_kind(lambda kind: discriminator(kind, name, numbers)).alias("discriminator"),
        F.col("fields_text").isNotNull().alias("has_table"),
        fields.alias("fields"),
    )


@F.pandas_udf(T.ArrayType(T.StringType()))
def _labels(types: pd.Series) -> pd.Series:
    return types.map(lambda row: None if row is None else [type_label(t) for t in row])


def introspect(docs: DataFrame, **options) -> DataFrame:
    """Per entry with a table: its name, table, and (name, type label) of its fields, as shown to clients."""
    registry = idl_registry(docs, **options).where("has_table")
    keep = [*options.get("keep", ()), "program_name"]
    labelled = registry.withColumn("labels", _labels(F.col("fields.type")))
    shown = F.transform(
        F.filter(F.arrays_zip("fields", "labels"), lambda p: p["fields"]["name"].isNotNull()),
        lambda p: F.struct(p["fields"]["name"].alias("name"), p["labels"].alias("ty")),
    )
    return labelled.select(
        "program_id", *keep, "kind", "ordinal", "name", "table_name", shown.alias("fields")
    )


@dataclass(frozen=True)
class Field:
    """One field in layout order; ``column`` is None when it is read for its bytes only."""

    name: str | None
    column: str | None
    type_text: str

    @property
    def tree(self) -> tuple:
        return parse_type(self.type_text)


@dataclass(frozen=True)
class Entry:
    """One instruction or account type."""

    kind: str
    ordinal: int
    name: str
    table: str
    discriminator: bytes
    has_table: bool
    fields: tuple[Field, ...]

    @property
    def layout(self) -> list[tuple[str | None, tuple]]:
        """(column or None, type tree) in layout order."""
        return [(f.column, f.tree) for f in self.fields]

    @property
    def table_schema(self) -> T.StructType:
        """Fixed columns, one column per named field, decode issues and the ingest time."""
        before, after = FIXED_COLUMNS[self.kind]
        schema = T.StructType([schema_field(c) for c in before])
        for f in self.fields:
            if f.column is not None:
                schema.add(f.column, spark_type(f.tree))
        schema.add("decode_issues", T.ArrayType(T.StringType()))
        for c in after:
            schema.add(schema_field(c))
        return schema


@dataclass(frozen=True)
class Program:
    """The registry rows of one program, on the driver."""

    program_id: str
    name: str
    entries: tuple[Entry, ...]

    @property
    def instructions(self) -> tuple[Entry, ...]:
        return tuple(e for e in self.entries if e.kind == "instruction")

    @property
    def accounts(self) -> tuple[Entry, ...]:
        return tuple(e for e in self.entries if e.kind == "account")

    def tables(self, kind: str) -> dict[str, list[Entry]]:
        """Table name -> the entries stored in it; names that derive to the same table share it."""
        found: dict[str, list[Entry]] = {}
        for e in self.entries:
            if e.kind == kind and e.has_table:
                found.setdefault(e.table, []).append(e)
        return found

    def table_schema(self, kind: str, table: str) -> T.StructType:
        """Columns of all entries of a table."""
        entries = self.tables(kind)[table]
        schema = entries[0].table_schema
        for e in entries[1:]:
            schema = merge_schema(schema, e.table_schema)
        return schema

    def resolve(self, kind: str, name: str) -> Entry:
        """Entry by exact name, else by the table that name derives to; unknown names are rejected."""
        for e in self.entries:
            if e.kind == kind and e.has_table and e.name == name:
                return e
        derived = TABLE_PREFIX[kind] + "".join(
            ("_" if i and c.isupper() else "") + c.lower() for i, c in enumerate(name)
        )
        for e in self.entries:
            if e.kind == kind and e.has_table and e.table == derived:
                return e
        raise ValueError(f"unknown {kind} type: {name!r}")

    def routing_table(self, spark: SparkSession, kind: str) -> DataFrame:
        """discriminator -> (entry name, table); of equal discriminators the first entry counts."""
        first: dict[bytes, Entry] = {}
        for e in self.entries:
            if e.kind == kind:
                first.setdefault(e.discriminator, e)
        rows = [(bytearray(d), e.name, e.table if e.has_table else None) for d, e in first.items()]
        return spark.createDataFrame(rows, "discriminator binary, entry_name string, table_name string")


def _columns(kind: str, fields: list) -> tuple[Field, ...]:
    """Give every named field its own column, clear of the fixed ones."""
    used = {*TAKEN_COLUMNS[kind], *ENGINE_COLUMNS}
    result = []
    for f in fields:
        column = f["column"]
        if column is not None:
            if column in used:
                column = f"f_{column}"
            number, base = 2, column
            while column in used:
                column, number = f"{base}_{number}", number + 1
            used.add(column)
        result.append(Field(f["name"], column, f["type"]))
    return tuple(result)


def load_program(registry: DataFrame, program_id: str) -> Program:
    """Collect one program's entries; more than ``MAX_ENTRIES`` is an error, not a truncation."""
    rows = registry.where(F.col("program_id") == program_id).limit(MAX_ENTRIES + 1).collect()
    if len(rows) > MAX_ENTRIES:
        raise ValueError(f"program {program_id} has more than {MAX_ENTRIES} entries")
    rows.sort(key=lambda r: (r["kind"] == "account", r["ordinal"]))
    entries = tuple(
        Entry(
            r["kind"], r["ordinal"], r["name"], r["table_name"], bytes(r["discriminator"]),
            r["has_table"], _columns(r["kind"], r["fields"]),
        )
        for r in rows
    )
    return Program(program_id, rows[0]["program_name"] if rows else "unknown", entries)


def program_from_json(spark: SparkSession, program_id: str, idl: str, **options) -> Program:
    """``Program`` of a single document."""
    docs = spark.createDataFrame([(program_id, idl)], "program_id string, idl string")
    return load_program(idl_registry(docs, **options), program_id)


def merge_schema(saved: T.StructType | None, current: T.StructType) -> T.StructType:
    """Additive evolution: saved columns keep their place and type, new ones follow."""
    if saved is None:
        return current
    have = set(saved.names)
    return T.StructType([*saved.fields, *[f for f in current.fields if f.name not in have]])

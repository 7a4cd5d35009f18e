"""Read the sample tables as chain data: transactions, calls, account versions, payloads, blocks.

Everything here is a row-wise projection of the given tables, so it scales with
them and adds no shuffle.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base58 import base58_encode_key
from ..functions.discriminators import derived_discriminator
from ..functions.little_endian import _POW64
from ..sources.blocks import block_schema

_SCHEMAS: dict[str, T.StructType] = {}

PROGRAM, OTHER_PROGRAM = "SampleProgram", "OtherProgram"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the sample tables. Its schema is looked up once per process, not on every read."""
    path = f"{sf_dir}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as transactions: the order day is the slot, status F counts as failed."""
    orders = table(spark, sf_dir, "orders")
    return orders.select(
        F.col("o_orderkey").alias("signature"),
        day("o_orderdate").alias("slot"),
        F.col("o_orderkey").alias("tx_index"),
        F.when(F.col("o_orderstatus") == "F", F.lit("failed")).alias("err"),
        F.col("o_custkey").alias("payer"),
    )


def day(column: str) -> Column:
    """Days since 1970 as a slot number."""
    return F.unix_date(F.col(column).cast("date")).cast("bigint")


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as instruction calls."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_sig"),
        F.col("event_id").alias("slot"),
        F.col("event_type").alias("ix_name"),
        F.col("user_id"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        F.col("value"),
        F.col("ts").alias("created_at"),
    )


def account_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as versions of the account of each user."""
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("address"),
        F.col("event_id").alias("slot"),
        F.round(F.col("value") * 100).cast("bigint").alias("lamports"),
        F.col("event_type"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def little_endian_hex(value: Column, width: int) -> Column:
    """Hex of a whole number, least significant byte first; negative numbers in two's complement."""
    turned = value.cast("bigint")
    # Neighbouring bytes, then pairs and halves change places: arithmetic on one long, no text per byte.
    for bits, mask in ((8, 0x00FF00FF00FF00FF), (16, 0x0000FFFF0000FFFF), (32, 0x00000000FFFFFFFF)):
        low = F.lit(mask).cast("bigint")
        turned = F.shiftleft(turned.bitwiseAND(low), bits).bitwiseOR(F.shiftrightunsigned(turned, bits).bitwiseAND(low))
    return F.substring(F.lpad(F.hex(turned), 16, "0"), 1, 2 * width)


def wide_hex(high: Column, low: Column) -> Column:
    """Hex of ``high * 2**64 + low`` as 16 bytes."""
    return F.concat(little_endian_hex(low, 8), little_endian_hex(high, 8))


def wide_value(high: str, low: str) -> str:
    """SQL text of ``high * 2**64 + low``."""
    return f"({high} * {_POW64} + {low})"


def text_hex(value: Column) -> Column:
    """Length prefix and UTF-8 bytes."""
    return F.concat(little_endian_hex(F.octet_length(value), 4), F.hex(value.cast("binary")))


def float_hex(value: Column, width: int) -> Column:
    """IEEE bits of a finite, non-negative number, from its exponent and fraction."""
    fraction_bits, bias = (52, 1023) if width == 8 else (23, 127)
    guess = F.floor(F.log2(value))
    power = F.when(value < F.pow(F.lit(2.0), guess), guess - 1).when(value >= F.pow(F.lit(2.0), guess + 1), guess + 1).otherwise(guess)
    fraction = ((value / F.pow(F.lit(2.0), power) - 1) * float(1 << fraction_bits)).cast("bigint")
    bits = F.when(value == 0, F.lit(0).cast("bigint")).otherwise(
        F.shiftleft((power + bias).cast("bigint"), fraction_bits) + fraction
    )
    return little_endian_hex(bits, width)


def payload(kind: str, name: Column, *parts: Column) -> Column:
    """Discriminator of ``name`` followed by the hex parts, as bytes."""
    return F.unhex(F.concat(F.hex(derived_discriminator(kind, name)), *parts))


# Interface of the sample program: one instruction per return flag of ``lineitem``.
FLAG_NAMES = {"A": "acceptLine", "N": "newLine", "R": "returnLine"}
LINE_ARGS = [{"name": "partKey", "type": "u64"}, {"name": "quantity", "type": "u64"}, {"name": "priceCents", "type": "i64"}]
SAMPLE_IDL = json.dumps(
    {
        "version": "0.1.0",
        "name": "sample",
        "instructions": [{"name": n, "args": LINE_ARGS} for n in FLAG_NAMES.values()],
        "accounts": [
            {
                "name": "SupplierVault",
                "type": {"kind": "struct", "fields": [{"name": "owner", "type": "publicKey"}, {"name": "balanceCents", "type": "i64"}, {"name": "active", "type": "bool"}, {"name": "label", "type": "string"}]},
            }
        ],
    }
)


def line_signature() -> Column:
    """Signature of a line: its five identifying values."""
    return F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.col("l_quantity").cast("int"))


def line_blocks(spark: SparkSession, sf_dir: str, failed: Column | None = None) -> DataFrame:
    """``lineitem`` as blocks of one transaction each, in the block layout; ``failed`` lines carry an error.

    The ship day is the slot. Open lines call the sample program, others another
    one. The payload of 32 bytes is written as base58 text, as on chain.
    """
    return as_blocks(lines(spark, sf_dir, failed))


def lines(spark: SparkSession, sf_dir: str, failed: Column | None = None) -> DataFrame:
    """The values of ``lineitem`` that ``as_blocks`` makes blocks of. They are narrow: what has to move is moved in this form."""
    return table(spark, sf_dir, "lineitem").select(
        day("l_shipdate").alias("slot"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
        "l_returnflag", "l_linestatus", (F.lit(False) if failed is None else failed).alias("failed"),
    )


def as_blocks(lines: DataFrame) -> DataFrame:
    """Every line as a block, row by row; a ``slot_bucket`` stays with it."""
    flag = F.col("l_returnflag")
    # A literal per name: its hash is taken once, not for every line.
    head = {f: F.hex(derived_discriminator("instruction", F.lit(name))) for f, name in FLAG_NAMES.items()}
    data = F.unhex(F.concat(
        F.when(flag == "A", head["A"]).when(flag == "N", head["N"]).otherwise(head["R"]),
        little_endian_hex(F.col("l_partkey"), 8),
        little_endian_hex(F.col("l_quantity"), 8),
        little_endian_hex(F.round(F.col("l_extendedprice") * 100), 8),
    ))
    encoded = lines.select(
        *(c for c in ("slot", "slot_bucket", "l_linestatus", "l_suppkey", "l_partkey", "l_orderkey") if c in lines.columns),
        line_signature().alias("signature"), base58_encode_key(data).alias("data"),
        F.when(F.col("failed"), F.lit("LineFailed")).alias("err"),
    )
    program = F.when(F.col("l_linestatus") == "O", PROGRAM).otherwise(OTHER_PROGRAM)
    keys = F.array(F.concat(F.lit("order"), "l_orderkey"), F.concat(F.lit("supp"), "l_suppkey"), program)
    instruction = F.struct(
        F.lit(2).alias("program_id_index"), F.array(F.lit(1), F.lit(3), F.lit(9)).alias("accounts"), F.col("data")
    )
    tx = F.struct(
        F.array("signature").alias("signatures"),
        keys.alias("account_keys"),
        F.struct(F.lit(1).alias("num_required_signatures"), F.lit(0).alias("num_readonly_signed"), F.lit(1).alias("num_readonly_unsigned")).alias("header"),
        F.array(instruction).alias("instructions"),
        F.struct(F.col("err"), F.array(F.concat(F.lit("part"), "l_partkey")).alias("loaded_writable"), F.array().cast("array<string>").alias("loaded_readonly")).alias("meta"),
        F.lit(False).alias("parsed"),
    )
    kind = block_schema()["transactions"].dataType
    bucket = [c for c in ("slot_bucket",) if c in lines.columns]
    return encoded.select("slot", (F.col("slot") * 86400).alias("block_time"), F.array(tx).cast(kind).alias("transactions"), *bucket)


def supplier_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``supplier`` as account snapshots, one per address."""
    owner = F.sha2(F.col("s_name").cast("binary"), 256)
    data = payload(
        "account", F.lit("SupplierVault"), owner,
        little_endian_hex(F.round(F.col("s_acctbal") * 100), 8), F.when(F.col("s_acctbal") > 0, "01").otherwise("00"), text_hex(F.col("s_name")),
    )
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("supp"), "s_suppkey").alias("address"), F.col("s_nationkey").cast("bigint").alias("lamports"), data.alias("data")
    )


def customer_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``customer`` as interface descriptions, one program per customer, covering both account layouts,
    explicit and derived discriminators, and entries without fields."""
    customer = table(spark, sf_dir, "customer")
    rich = F.col("c_acctbal") > 5000
    poor = F.col("c_acctbal") < 0
    fields = F.array(
        F.struct(F.lit("OwnerKey").alias("name"), F.lit("publicKey").alias("type")),
        F.struct(F.lit("order").alias("name"), F.lit("u64").alias("type")),
        F.struct(F.col("c_mktsegment").alias("name"), F.lit("bool").alias("type")),
    )
    args = F.array(F.struct(F.lit("amountIn").alias("name"), F.lit("u64").alias("type")), F.struct(F.lit("slot").alias("name"), F.lit("u32").alias("type")))
    nation = F.col("c_nationkey")
    explicit = F.array(nation, *[F.lit(i) for i in range(2, 9)])
    first = F.struct(F.concat(F.lit("set"), F.initcap(F.lower("c_mktsegment"))).alias("name"), F.lit(None).cast("array<int>").alias("discriminator"), args.alias("args"))
    second = F.struct(
        F.concat(F.lit("nationNo"), nation).alias("name"),
        F.when(rich, explicit).alias("discriminator"),
        F.when(~poor, F.slice(args, 1, 1)).alias("args"),
    )
    inline = F.struct(F.lit("CustomerState").alias("name"), F.when(rich, fields).alias("fields"))
    by_name = F.struct(F.lit("CustomerState").alias("name"), F.when(~rich & ~poor, F.struct(fields.alias("fields"))).alias("type"))
    document = F.struct(
        F.lit("0.1.0").alias("version"), F.col("c_name").alias("name"),
        F.when(rich, F.concat(F.lit("P"), "c_custkey")).alias("address"),
        F.array(first, second).alias("instructions"), F.array(inline).alias("accounts"), F.array(by_name).alias("types"),
    )
    return customer.select(F.concat(F.lit("P"), "c_custkey").alias("program_id"), F.to_json(document).alias("idl"))

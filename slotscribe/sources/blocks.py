"""Block tables: schema, readers, and the ways to select a program's transactions.

A block row holds its transactions as an array. Selections that only list
signatures explode first, so that the scan reads just the nested columns they
need; selections that need whole transactions shrink the array before exploding.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER = "struct<num_required_signatures:int,num_readonly_signed:int,num_readonly_unsigned:int>"
INSTRUCTION = "struct<program_id_index:int,accounts:array<int>,data:string>"
META = "struct<err:string,loaded_writable:array<string>,loaded_readonly:array<string>>"
TRANSACTION = (
    "struct<signatures:array<string>,account_keys:array<string>,"
    f"header:{HEADER},instructions:array<{INSTRUCTION}>,meta:{META},parsed:boolean>"
)
BLOCK_DDL = f"slot bigint, block_time bigint, transactions array<{TRANSACTION}>"

# One JSON object per block, as block dumps carry it, with the slot added.
DUMP_DDL = (
    "slot bigint, blockTime bigint, transactions array<struct<"
    "transaction:struct<signatures:array<string>,message:struct<accountKeys:array<string>,"
    "header:struct<numRequiredSignatures:int,numReadonlySignedAccounts:int,numReadonlyUnsignedAccounts:int>,"
    "instructions:array<struct<programIdIndex:int,accounts:array<string>,data:string>>>>,"
    "meta:struct<err:string,loadedAddresses:struct<writable:array<string>,readonly:array<string>>>>>"
)

SLOTS_PER_BUCKET = 100_000
# Where a table keeps its bucket size (readers pass over names that start so), and
# the key under which a DataFrame's ``slot_bucket`` column carries it.
LAYOUT = "_layout"
SIZE_KEY = "slots_per_bucket"


def block_schema() -> T.StructType:
    """Schema of a block table."""
    return T.StructType.fromDDL(BLOCK_DDL)


def slot_bucket(slot: Column | str = "slot", size: int = SLOTS_PER_BUCKET) -> Column:
    """Partition number of a slot."""
    column = F.col(slot) if isinstance(slot, str) else slot
    return F.floor(column / size).cast("bigint")


def read_layout(spark: SparkSession, path: str) -> int | None:
    """Bucket size a table was written with; None when it does not say."""
    try:
        row = spark.read.schema(f"{SIZE_KEY} bigint").json(f"{path}/{LAYOUT}").first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        row = None
    return row[0] if row else None


def keep_layout(spark: SparkSession, path: str, size: int, *, replace: bool = False) -> None:
    """Store the bucket size with a table; a table keeps the size it has."""
    known = None if replace else read_layout(spark, path)
    if known is not None and known != size:
        raise ValueError(f"{path} has {known} slots per bucket, not {size}")
    if known is None:
        spark.createDataFrame([(size,)], f"{SIZE_KEY} bigint").coalesce(1).write.mode("overwrite").json(f"{path}/{LAYOUT}")


def bucket_size_of(blocks: DataFrame, stated: int | None = None) -> int | None:
    """Slots per bucket of a table: its own, or the stated size if it does not say; both must agree."""
    if "slot_bucket" not in blocks.columns:
        return None
    known = blocks.schema["slot_bucket"].metadata.get(SIZE_KEY)
    if known is not None and stated is not None and known != stated:
        raise ValueError(f"the block table has {known} slots per bucket, not {stated}")
    return known if known is not None else stated


def read_blocks(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A block table in our layout from Parquet, ORC or JSON.

    Parquet and ORC tables written by ``write_blocks`` are partitioned by
    ``slot_bucket``; that column is kept, with the table's bucket size, so that
    slot ranges prune folders.
    """
    reader = spark.read.format(fmt)
    if fmt == "json":
        return reader.schema(block_schema()).load(path)
    blocks = reader.load(path)
    size = read_layout(spark, path) if "slot_bucket" in blocks.columns else None
    return blocks if size is None else blocks.withMetadata("slot_bucket", {SIZE_KEY: size})


def write_blocks(
    blocks: DataFrame, path: str, *, size: int = SLOTS_PER_BUCKET, fmt: str = "parquet", mode: str = "overwrite",
    widen: Callable[[DataFrame], DataFrame] | None = None,
) -> None:
    """Store blocks by slot bucket, sorted by slot inside each file; the bucket size is stored with them.

    With ``widen``, ``blocks`` are narrow rows with a ``slot``. They are dealt out and sorted as
    they are, and ``widen`` makes blocks of them afterwards, row by row, keeping ``slot_bucket``.
    """
    if mode == "append":
        keep_layout(blocks.sparkSession, path, size)
    dealt = blocks.withColumn("slot_bucket", slot_bucket(size=size)).hint("rebalance", "slot_bucket").sortWithinPartitions("slot_bucket", "slot")
    writer = (dealt if widen is None else widen(dealt)).write.partitionBy("slot_bucket").format(fmt).mode(mode)
    (writer.option("compression", "zstd") if fmt == "parquet" else writer).save(path)
    keep_layout(blocks.sparkSession, path, size, replace=mode == "overwrite")


def from_dump(raw: DataFrame) -> DataFrame:
    """Block dumps (``DUMP_DDL``) in our layout.

    In the parsed form account keys are objects; their ``pubkey`` counts for
    program membership, and the transaction is marked ``parsed``.
    """

    def convert(t: Column) -> Column:
        message = t["transaction"]["message"]
        keys = message["accountKeys"]
        header = message["header"]
        meta = t["meta"]
        return F.struct(
            t["transaction"]["signatures"].alias("signatures"),
            F.transform(keys, lambda k: F.when(k.startswith("{"), F.get_json_object(k, "$.pubkey")).otherwise(k)).alias("account_keys"),
            F.struct(
                header["numRequiredSignatures"].alias("num_required_signatures"),
                header["numReadonlySignedAccounts"].alias("num_readonly_signed"),
                header["numReadonlyUnsignedAccounts"].alias("num_readonly_unsigned"),
            ).alias("header"),
            F.transform(
                message["instructions"],
                lambda i: F.struct(
                    i["programIdIndex"].alias("program_id_index"),
                    F.transform(i["accounts"], lambda a: a.try_cast("int")).alias("accounts"),
                    i["data"].alias("data"),
                ),
            ).alias("instructions"),
            F.when(
                meta.isNotNull(),
                F.struct(
                    meta["err"].alias("err"),
                    meta["loadedAddresses"]["writable"].alias("loaded_writable"),
                    meta["loadedAddresses"]["readonly"].alias("loaded_readonly"),
                ),
            ).alias("meta"),
            F.exists(keys, lambda k: k.startswith("{")).alias("parsed"),
        )

    return raw.select("slot", F.col("blockTime").alias("block_time"), F.transform("transactions", convert).alias("transactions"))


def read_dump(spark: SparkSession, path: str) -> DataFrame:
    """Block dumps, one JSON object per line."""
    return from_dump(spark.read.schema(DUMP_DDL).json(path))


def in_slot_range(blocks: DataFrame, start: int | None, end: int | None) -> DataFrame:
    """Blocks with ``start <= slot <= end``; also prunes by bucket where the table has buckets."""
    if start is not None:
        blocks = blocks.where(F.col("slot") >= start)
    if end is not None:
        blocks = blocks.where(F.col("slot") <= end)
    return blocks


def prune_buckets(blocks: DataFrame, start: int | None, end: int | None, size: int | None = None) -> DataFrame:
    """``in_slot_range`` plus the matching range of slot buckets (folders), where the bucket size is known."""
    size = bucket_size_of(blocks, size)
    if size is not None:
        if start is not None:
            blocks = blocks.where(F.col("slot_bucket") >= start // size)
        if end is not None:
            blocks = blocks.where(F.col("slot_bucket") <= end // size)
    return in_slot_range(blocks, start, end)


def uses_program(account_keys: Column, program_id: str) -> Column:
    """Whether a transaction mentions the program among its static account keys."""
    return F.array_contains(account_keys, F.lit(program_id))


def first_signature(signatures: Column) -> Column:
    """First signature of a transaction, NULL if it has none."""
    return F.get(signatures, F.lit(0))


def program_signatures(blocks: DataFrame, program_id: str | None) -> DataFrame:
    """(signature, slot, tx_index, err, block_time) of every transaction that mentions the program, or of all."""
    exploded = blocks.select("slot", "block_time", F.posexplode("transactions").alias("tx_index", "tx"))
    return (
        exploded.where(F.lit(True) if program_id is None else uses_program(F.col("tx.account_keys"), program_id))
        .select(first_signature(F.col("tx.signatures")).alias("signature"), "slot", "tx_index", F.col("tx.meta.err").alias("err"), "block_time")
        .where(F.col("signature").isNotNull())
    )


def cursor_before(slot: int, tx_index: int) -> Column:
    """Rows strictly older than a position, in (slot, tx_index) order."""
    return (F.col("slot") <= slot) & ((F.col("slot") < slot) | (F.col("tx_index") < tx_index))


def cursor_after(slot: int, tx_index: int) -> Column:
    """Rows strictly newer than a position, in (slot, tx_index) order."""
    return (F.col("slot") >= slot) & ((F.col("slot") > slot) | (F.col("tx_index") > tx_index))


def signature_page(
    signatures: DataFrame, limit: int, *, before: tuple[int, int] | None = None, until: tuple[int, int] | None = None
) -> DataFrame:
    """Newest ``limit`` rows strictly between the ``until`` and ``before`` positions, newest first."""
    if before is not None:
        signatures = signatures.where(cursor_before(*before))
    if until is not None:
        signatures = signatures.where(cursor_after(*until))
    return signatures.orderBy(F.desc("slot"), F.desc("tx_index")).limit(limit)


def latest(signatures: DataFrame, count: int) -> DataFrame:
    """The newest ``count`` transactions."""
    return signature_page(signatures, count)


def since(signatures: DataFrame, position: tuple[int, int] | None) -> DataFrame:
    """Everything strictly newer than a checkpoint position; all of it without one."""
    return signatures if position is None else signatures.where(cursor_after(*position))


def position_of(signatures: DataFrame, signature, *, slot: int | None = None) -> tuple[int, int] | None:
    """(slot, tx_index) of a signature, newest if repeated; a known slot prunes the scan."""
    found = signatures.where(F.col("signature") == F.lit(signature))
    if slot is not None:
        found = found.where(F.col("slot") == slot)
    row = found.orderBy(F.desc("slot"), F.desc("tx_index")).select("slot", "tx_index").first()
    return None if row is None else (row["slot"], row["tx_index"])


def parse_signature_list(text: str) -> list[str]:
    """Comma-separated signatures, trimmed, empties dropped, in order."""
    return [part for part in (p.strip() for p in text.split(",")) if part]


def listed(spark: SparkSession, signatures: list[str]) -> DataFrame:
    """(signature, list_order): first place of every listed signature."""
    first = dict.fromkeys(signatures)
    return spark.createDataFrame([(s, i) for i, s in enumerate(first)], "signature string, list_order bigint")


# A listed signature is some 90 bytes, so this many stay below 1 MB.
BROADCAST_SIGNATURES = 10_000


def pick_signatures(txs: DataFrame, spark: SparkSession, signatures: list[str]) -> DataFrame:
    """Transactions of an explicit list, with their place in it as ``list_order``.

    The list is broadcast only while its length is below ``BROADCAST_SIGNATURES``.
    """
    wanted = listed(spark, signatures)
    if len(signatures) <= BROADCAST_SIGNATURES:
        wanted = F.broadcast(wanted)
    return txs.join(wanted, "signature")


def resume_slot(saved: int | None, start: int, end: int) -> int | None:
    """Where a slot range starts after a checkpoint; None when the range is done."""
    if saved is not None and saved >= end:
        return None
    if saved is not None and saved >= start:
        return saved + 1
    return start


def chunk_progress(spark: SparkSession, signatures: DataFrame, resume: int, end: int, chunk_slots: int) -> DataFrame:
    """(chunk, slot_start, slot_end, found) of every chunk of the range, also the empty ones.

    Counts are taken per chunk first; the dense chunk list joins those counts.
    """
    chunks = spark.range((end - resume) // chunk_slots + 1).select(
        F.col("id").alias("chunk"),
        (F.lit(resume) + F.col("id") * chunk_slots).alias("slot_start"),
        F.least(F.lit(resume) + (F.col("id") + 1) * chunk_slots - 1, F.lit(end)).alias("slot_end"),
    )
    found = (
        in_slot_range(signatures, resume, end)
        .groupBy(F.floor((F.col("slot") - resume) / chunk_slots).cast("bigint").alias("chunk"))
        .agg(F.count(F.lit(1)).alias("found"))
    )
    return chunks.join(found, "chunk", "left").select("chunk", "slot_start", "slot_end", F.coalesce("found", F.lit(0)).alias("found"))

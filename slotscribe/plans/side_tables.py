"""Small tables kept beside the rows of an index: keys, zones and current account states.

``keys`` says in which slot a signature or address stands. It is a bucketed table,
so looking one key up reads one bucket, and checking a large batch for stored keys
joins without moving the stored side. ``zones`` has a row per table, batch and slot
bucket with its number of rows and its bounds of slot and time, from which counts are
summed and time ranges become folders. Both are written for a batch before its
state row, from the rows the batch has just stored, and count from then on.

``current`` holds the newest state of every account by hash bucket; a batch
rewrites the buckets it touches once it is committed. The state table says up to
which batch each writer's rows are folded in, readers add what is not, and
folding a batch twice changes nothing.
"""

from __future__ import annotations

import zlib
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema_text import schema
from ..operators.lookups import newest_per_account

KEY_SCHEMA = schema("key string, slot bigint, item int, writer string, batch_id bigint, indexed string")
ZONE_SCHEMA = schema(
    "slot_bucket bigint, rows bigint, min_slot bigint, max_slot bigint, min_block_time bigint, max_block_time bigint, "
    "min_created_at timestamp, max_created_at timestamp, indexed string, writer string, batch_id bigint"
)
# Buckets of the keys and of the current states: at least so many, and one for so many transactions of an index's first batch.
KEY_BUCKETS = 16
BUCKET_TRANSACTIONS = 500_000
# Which column of a table is its key, in this order.
KEY_COLUMNS = ("signature", "address", "tx_sig")


def buckets_for(transactions: int) -> int:
    """Buckets of an index that does not state them, from the transactions it begins with: a task sorts the keys of one."""
    return max(KEY_BUCKETS, -(-transactions // BUCKET_TRANSACTIONS))


def key_column(columns: list[str]) -> str:
    """The key of a stored table."""
    return next(c for c in KEY_COLUMNS if c in columns)


def account_bucket(buckets: int, address: str = "address") -> Column:
    """Bucket of an address among the current states."""
    return F.pmod(F.xxhash64(address), F.lit(buckets)).cast("int")


class KeyTable:
    """The bucketed table of one index's keys.

    Buckets are known to Spark through its catalog only, so every session
    registers the folder under a name of its own; the files are the table, and
    dropping the name leaves them.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int):
        self.spark, self.path, self.buckets = spark, f"{root}/keys", buckets
        self.name = f"slotscribe_keys_{zlib.crc32(self.path.encode()):08x}_{buckets}"

    def _register(self) -> None:
        """Name the folder in this session's catalog and look at its files anew.

        Partitions are found by listing folders, not by registering each.
        """
        managed = "spark.sql.hive.manageFilesourcePartitions"
        usual = self.spark.conf.get(managed)
        self.spark.conf.set(managed, "false")
        try:
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in KEY_SCHEMA)
            path = self.path.replace("\\", "\\\\").replace("'", "\\'")
            self.spark.sql(
                f"CREATE TABLE IF NOT EXISTS {self.name} ({columns}) USING parquet OPTIONS (path '{path}', compression 'zstd') "
                f"PARTITIONED BY (writer, batch_id, indexed) CLUSTERED BY (key) SORTED BY (key) INTO {self.buckets} BUCKETS"
            )
        finally:
            self.spark.conf.set(managed, usual)
        self.spark.catalog.refreshTable(self.name)

    def rows(self) -> DataFrame:
        """All keys, also those of batches that do not count."""
        self._register()
        return self.spark.table(self.name)

    def append(self, found: DataFrame, writer: str, batch_id: int, transactions: int) -> None:
        """Add the keys (``found_keys``) of a batch: one file per bucket and table.

        A batch of more transactions than buckets are made for has several, each written by a task of its
        own: keys dealt into a multiple of the buckets stay in their bucket.
        """
        self._register()
        parts = max(1, -(-transactions // (self.buckets * BUCKET_TRANSACTIONS)))
        dealt = found.repartition(self.buckets * parts, "key").withColumns({"writer": F.lit(writer), "batch_id": F.lit(batch_id)})
        dealt.select(*KEY_SCHEMA.names).write.mode("append").insertInto(self.name)


def found_keys(rows: DataFrame, table: str) -> DataFrame:
    """Keys of the stored rows of a table; ``item`` tells calls of one transaction apart."""
    item = F.col("ix_index") if "ix_index" in rows.columns else F.lit(None).cast("int")
    return rows.select(F.lit(table).alias("indexed"), F.col(key_column(rows.columns)).alias("key"), "slot", item.alias("item"))


def zones_of(rows: DataFrame, table: str) -> DataFrame:
    """A row per slot bucket of stored rows."""
    block_time = F.col("block_time") if "block_time" in rows.columns else F.lit(None).cast("bigint")
    return rows.groupBy("slot_bucket", "writer", "batch_id").agg(
        F.count(F.lit(1)).alias("rows"), F.min("slot").alias("min_slot"), F.max("slot").alias("max_slot"),
        F.min(block_time).alias("min_block_time"), F.max(block_time).alias("max_block_time"),
        F.min("created_at").alias("min_created_at"), F.max("created_at").alias("max_created_at"),
    ).withColumn("indexed", F.lit(table)).select(*ZONE_SCHEMA.names)


def in_time(zones: DataFrame, time_col: str, low: Column | None, high: Column | None) -> DataFrame:
    """Zones that can hold rows between two times; zones without such a time hold none."""
    if time_col == "block_ts":
        least, most = F.timestamp_seconds("min_block_time"), F.timestamp_seconds("max_block_time")
    else:
        least, most = F.col("min_created_at"), F.col("max_created_at")
    tests = [least.isNotNull()]
    if low is not None:
        tests.append(most >= low.cast("timestamp"))
    if high is not None:
        tests.append(least <= high.cast("timestamp"))
    return zones.where(reduce(Column.__and__, tests))


def zone_counts(zones: DataFrame, tables: list[str]) -> DataFrame:
    """(table, calls): rows of every table, zero for those without."""
    known = zones.sparkSession.createDataFrame([(t,) for t in tables], "table string")
    counted = zones.groupBy(F.col("indexed").alias("table")).agg(F.sum("rows").alias("calls"))
    return known.join(counted, "table", "left").select("table", F.coalesce("calls", F.lit(0)).cast("bigint").alias("calls"))


class CurrentStates:
    """Newest state per account of one account table."""

    TIES = ("updated_at", "batch_id")

    def __init__(self, spark: SparkSession, root: str, table: str, columns: T.StructType, buckets: int):
        self.spark, self.path, self.buckets = spark, f"{root}/current/{table}", buckets
        self.schema = T.StructType([*columns.fields, *schema("writer string, batch_id bigint, key_bucket int").fields])

    def kept(self, empty: bool) -> DataFrame:
        """Rows of the table as it is; nothing before the first fold."""
        return self.spark.createDataFrame([], self.schema) if empty else self.spark.read.schema(self.schema).parquet(self.path)

    def merged(self, fresh: DataFrame, empty: bool) -> tuple[DataFrame, list[int]]:
        """Newest states of all accounts in buckets that ``fresh`` rows touch, and these buckets."""
        fresh = fresh.withColumn("key_bucket", account_bucket(self.buckets)).select(*self.schema.names)
        touched = sorted(r[0] for r in fresh.select("key_bucket").distinct().collect())
        before = self.kept(empty).where(F.col("key_bucket").isin(touched)) if touched else self.kept(True)
        return newest_per_account(before.unionByName(fresh), tie_breaks=self.TIES), touched

    def write(self, rows: DataFrame) -> None:
        """Replace the buckets the rows belong to; ``rows`` must not read this table."""
        (
            rows.repartition("key_bucket").sortWithinPartitions("address")
            .write.partitionBy("key_bucket").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(self.path)
        )

    def read(self, fresh: DataFrame | None, empty: bool) -> DataFrame:
        """Newest state of every account; only buckets that ``fresh`` rows touch are computed anew."""
        if fresh is None:
            return self.kept(empty)
        newest, touched = self.merged(fresh, empty)
        return self.kept(empty).where(~F.col("key_bucket").isin(touched)).unionByName(newest) if touched else self.kept(empty)

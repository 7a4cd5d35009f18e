"""The index on disk: one Parquet folder per table, a small state table, and side tables (``side_tables``).

Layout: ``<root>/<table>/writer=<w>/batch_id=<n>/slot_bucket=<k>/``. A batch
replaces its own ``writer``/``batch_id`` folder, so a repeated attempt leaves
nothing behind, and it counts only once the state table, written last, names
its id. Readers therefore never see part of a batch. Many small batches are
made one by ``maintenance.rewrite_index``, into a new folder.
"""

from __future__ import annotations

import json
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import reduce
from threading import Lock

from pyspark import inheritable_thread_target
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.schema_text import schema
from ..operators.registry import merge_schema
from ..session import list_folders, remove_folder
from ..sources.blocks import SLOTS_PER_BUCKET, keep_layout, read_layout, slot_bucket
from .side_tables import KEY_SCHEMA, ZONE_SCHEMA, CurrentStates, KeyTable, found_keys, in_time, zones_of

# Checkpoint keys.
LAST_SIG_KEY = "last_indexed_sig"
LAST_SLOT_KEY = "last_indexed_slot"
COMMIT_KEY = "committed_batch"
SCHEMA_KEY = "schema/"
# Keys of the side tables: their number of buckets (an index without it has none), and per writer the last batch folded
# into the current states.
BUCKETS_KEY = "key_buckets"
FOLDED_KEY = "folded/"
# Folders up to which a read names them one by one; beyond that it takes their range.
MAX_LISTED = 5_000

STATE_SCHEMA = schema("key string, value string, updated_at timestamp, writer string, batch_id bigint")
TRANSACTION_SCHEMA = schema(
    "signature string, slot bigint, block_time bigint, tx_index int, err string, created_at timestamp"
)
QUARANTINE_SCHEMA = schema(
    "tx_sig string, slot bigint, ix_index int, discriminator_hex string, reason string, created_at timestamp"
)
PARTITIONS = schema("writer string, batch_id bigint, slot_bucket bigint")


def latest_state(rows: DataFrame) -> DataFrame:
    """(key, value): the value of each key that was written last."""
    return rows.groupBy("key").agg(F.max_by("value", F.struct("updated_at", "batch_id")).alias("value"))


def _only_missing(error: AnalysisException) -> None:
    """Pass over a table that does not exist yet; raise anything else."""
    if error.getCondition() != "PATH_NOT_FOUND":
        raise error


@dataclass(frozen=True)
class IndexState:
    """One consistent view of the state table."""

    values: dict[str, str]
    committed: dict[str, int]

    @property
    def key_buckets(self) -> int | None:
        """Buckets of the side tables; None for an index without them."""
        known = self.values.get(BUCKETS_KEY)
        return None if known is None else int(known)

    @property
    def folded(self) -> dict[str, int]:
        """Per writer, the last batch whose account states are among the current ones."""
        return {k.removeprefix(FOLDED_KEY): int(v) for k, v in self.values.items() if k.startswith(FOLDED_KEY)}

    def visible(self, exclude: tuple[str, int] | None = None) -> Column:
        """Whether the batch of a row counts; ``exclude`` leaves out one (writer, batch_id). It selects folders, not rows."""
        counts = [(F.col("writer") == w) & (F.col("batch_id") <= n) for w, n in self.committed.items()]
        seen = reduce(Column.__or__, counts) if counts else F.lit(False)
        return seen if exclude is None else seen & ~((F.col("writer") == exclude[0]) & (F.col("batch_id") == exclude[1]))

    def table_schema(self, table: str, current: T.StructType) -> T.StructType:
        """Schema a table has grown to: saved columns first, then columns new in ``current``."""
        saved = self.values.get(SCHEMA_KEY + table)
        return merge_schema(T.StructType.fromJson(json.loads(saved)) if saved else None, current)


class IndexStore:
    """Reads and writes the tables of one index below ``root``."""

    def __init__(self, spark: SparkSession, root: str, *, slots_per_bucket: int | None = None, key_buckets: int | None = None):
        self.spark, self.root, self._stated, self._size = spark, root.rstrip("/"), slots_per_bucket, None
        # None: as many as the first batch asks for.
        self.key_buckets = key_buckets
        self._lock, self._kept = Lock(), False

    @property
    def slots_per_bucket(self) -> int:
        """Bucket size of the index: the one it was written with; a differing stated one is refused."""
        if self._size is None:
            known = read_layout(self.spark, self.root)
            if known is not None and self._stated not in (None, known):
                raise ValueError(f"the index has {known} slots per bucket, not {self._stated}")
            self._size, self._kept = known or self._stated or SLOTS_PER_BUCKET, known is not None
        return self._size

    def keep_layout(self) -> None:
        """Store the bucket size before the first table is written."""
        with self._lock:
            size = self.slots_per_bucket
            if not self._kept:
                keep_layout(self.spark, self.root, size)
                self._kept = True

    # -- state -----------------------------------------------------------------

    def state_rows(self) -> DataFrame:
        """All state rows ever written; empty before the first commit."""
        try:
            return self.spark.read.schema(STATE_SCHEMA).parquet(f"{self.root}/state")
        except AnalysisException as error:
            _only_missing(error)
            return self.spark.createDataFrame([], STATE_SCHEMA)

    def load(self) -> "IndexState":
        """Current values and last committed batches, in one small job: a handful of rows per table."""
        rows = self.state_rows().groupBy("key", F.when(F.col("key") == COMMIT_KEY, F.col("writer")).alias("writer"))
        latest = rows.agg(F.max_by("value", F.struct("updated_at", "batch_id")).alias("value"), F.max("batch_id").alias("n")).collect()
        return IndexState(
            {r["key"]: r["value"] for r in latest if r["key"] != COMMIT_KEY},
            {r["writer"]: r["n"] for r in latest if r["key"] == COMMIT_KEY},
        )

    def next_batch_id(self, writer: str) -> int:
        """The id after the last committed one; an attempt that failed is replaced."""
        return self.load().committed.get(writer, -1) + 1

    def write_state(self, values: dict[str, str], writer: str, batch_id: int) -> None:
        """Append state rows in one file; this is what makes the batch visible."""
        rows = [(k, v, writer, batch_id) for k, v in {**values, COMMIT_KEY: str(batch_id)}.items()]
        frame = self.spark.createDataFrame(rows, "key string, value string, writer string, batch_id bigint")
        stamped = frame.withColumn("updated_at", F.current_timestamp()).select(*STATE_SCHEMA.names)
        stamped.coalesce(1).write.mode("append").parquet(f"{self.root}/state")

    def compact_state(self) -> int:
        """Rewrite the state as its latest rows in one file; returns the number of files it replaces.

        The new file only repeats rows that are there, so it changes no answer,
        and the files it was made from go once it is written. What other
        writers add meanwhile stays. Readers that listed the files before may have to try again.
        """
        rows = self.state_rows().select("*", "_metadata.file_path")
        old = [r[0] for r in rows.select("file_path").distinct().collect()]
        if len(old) < 2:
            return 0
        newest = F.max_by(F.struct(*STATE_SCHEMA.names), F.struct("updated_at", "batch_id")).alias("row")
        last = F.max_by(F.struct(*STATE_SCHEMA.names), F.struct("batch_id", "updated_at")).alias("row")
        values = rows.where(F.col("key") != COMMIT_KEY).groupBy("key").agg(newest)
        commits = rows.where(F.col("key") == COMMIT_KEY).groupBy("writer").agg(last)
        latest = values.select("row.*").unionByName(commits.select("row.*"))
        latest.coalesce(1).write.mode("append").parquet(f"{self.root}/state")
        for path in old:
            remove_folder(self.spark, path)
        return len(old)

    # -- side tables -------------------------------------------------------------

    def keys(self, state: "IndexState", table: str | list[str], exclude: tuple[str, int] | None = None) -> DataFrame:
        """(key, slot, item) of the stored rows of a table, or of several with the name of each as ``indexed``."""
        columns = ["key", "slot", "item", *([] if isinstance(table, str) else ["indexed"])]
        if not state.committed:
            return self.spark.createDataFrame([], T.StructType([KEY_SCHEMA[c] for c in columns]))
        rows = KeyTable(self.spark, self.root, state.key_buckets).rows()
        named = F.col("indexed") == table if isinstance(table, str) else F.col("indexed").isin(table)
        return rows.where(state.visible(exclude)).where(named).select(*columns)

    def locate(self, state: "IndexState", table: str, key: str, newest: int = 1) -> list[int] | None:
        """The newest slots in which a key is stored, read from one bucket; None if the index keeps no keys."""
        if state.key_buckets is None:
            return None
        slots = self.keys(state, table).where(F.col("key") == key).select("slot").distinct()
        return [r["slot"] for r in slots.orderBy(F.desc("slot")).limit(newest).collect()]

    def zones(self, state: "IndexState") -> DataFrame:
        """Zones of all batches that count."""
        if not state.committed:
            return self.spark.createDataFrame([], ZONE_SCHEMA)
        return self.spark.read.schema(ZONE_SCHEMA).parquet(f"{self.root}/zones").where(state.visible())

    def buckets_in_time(self, state: "IndexState", table: str, time_col: str, low: Column | None, high: Column | None) -> list[int] | tuple[int, int] | None:
        """Slot buckets of a table that can hold rows between two times, for ``read``; None if the index keeps no zones."""
        if state.key_buckets is None:
            return None
        found = in_time(self.zones(state).where(F.col("indexed") == table), time_col, low, high).select("slot_bucket").distinct()
        listed = sorted(r[0] for r in found.limit(MAX_LISTED + 1).collect())
        return listed if len(listed) <= MAX_LISTED else tuple(found.agg(F.min("slot_bucket"), F.max("slot_bucket")).first())

    def write_side_tables(self, tables: dict[str, T.StructType], writer: str, batch_id: int, buckets: int, transactions: int) -> None:
        """Keys and zones of what a batch of so many transactions has stored in these tables, two jobs over their narrow columns."""
        for side in ("keys", "zones"):
            remove_folder(self.spark, f"{self.root}/{side}/writer={writer}/batch_id={batch_id}")
        if not tables:
            return
        stored = {t: self.batch_rows(t, columns, writer, batch_id) for t, columns in tables.items()}
        found = reduce(DataFrame.unionByName, [found_keys(rows, t) for t, rows in stored.items()])
        timed = [zones_of(rows, t) for t, rows in stored.items() if "created_at" in rows.columns]

        def write_zones() -> None:
            zones = reduce(DataFrame.unionByName, timed).drop("writer", "batch_id")
            zones.coalesce(1).write.mode("overwrite").parquet(f"{self.root}/zones/writer={writer}/batch_id={batch_id}")

        with ThreadPoolExecutor(2) as pool:
            jobs = [lambda: KeyTable(self.spark, self.root, buckets).append(found, writer, batch_id, transactions), *([write_zones] if timed else [])]
            for done in [pool.submit(inheritable_thread_target(self.spark)(job)) for job in jobs]:
                done.result()

    def current(self, table: str, columns: T.StructType, state: "IndexState") -> CurrentStates:
        """The table of current states of an account table."""
        return CurrentStates(self.spark, self.root, table, columns, state.key_buckets)

    def has_states(self, table: str) -> bool:
        """Whether states of an account table have been folded before."""
        return bool(list_folders(self.spark, f"{self.root}/current/{table}"))

    def unfolded(self, table: str, columns: T.StructType, state: "IndexState") -> DataFrame | None:
        """Account rows of batches that are not among the current states yet; None when there are no such batches."""
        late = {w: n for w, n in state.committed.items() if n > state.folded.get(w, -1)}
        if not late:
            return None
        since = reduce(Column.__or__, [(F.col("writer") == w) & (F.col("batch_id") > state.folded.get(w, -1)) for w in late])
        return self.read(table, columns, state=state).where(since).drop("slot_bucket")

    # -- tables ----------------------------------------------------------------

    def read(
        self,
        table: str,
        columns: T.StructType,
        *,
        state: IndexState | None = None,
        exclude: tuple[str, int] | None = None,
        buckets: list[int] | tuple[int | None, int | None] | None = None,
    ) -> DataFrame:
        """Committed rows of a table. Columns that older files lack are NULL.

        ``exclude`` leaves out one (writer, batch_id); ``buckets`` limits the
        read to a list of slot buckets or an inclusive range of them. All of
        these select folders, not rows.
        """
        state = state or self.load()
        rows = self._rows(table, columns).where(state.visible(exclude))
        if isinstance(buckets, tuple):
            low, high = buckets
            rows = rows if low is None else rows.where(F.col("slot_bucket") >= low)
            rows = rows if high is None else rows.where(F.col("slot_bucket") <= high)
        elif buckets is not None:
            rows = rows.where(F.col("slot_bucket").isin(buckets))
        return rows

    def _rows(self, table: str, columns: T.StructType) -> DataFrame:
        """All rows of a table, also those of batches that do not count."""
        full = T.StructType([*columns.fields, *PARTITIONS.fields])
        try:
            return self.spark.read.schema(full).parquet(f"{self.root}/{table}")
        except AnalysisException as error:
            _only_missing(error)
            return self.spark.createDataFrame([], full)

    def batch_rows(self, table: str, columns: T.StructType, writer: str, batch_id: int) -> DataFrame:
        """What one batch has written into a table, whether or not it counts yet."""
        full, path = T.StructType([*columns.fields, *PARTITIONS.fields]), f"{self.root}/{table}"
        return self.spark.read.schema(full).option("basePath", path).parquet(f"{path}/writer={writer}/batch_id={batch_id}")

    def buckets_of(self, low: int | None, high: int | None) -> tuple[int | None, int | None]:
        """Range of slot buckets of a range of slots, open where a bound is."""
        size = self.slots_per_bucket
        return (None if low is None else low // size, None if high is None else high // size)

    def drop_batch(self, table: str, writer: str, batch_id: int) -> None:
        """Remove what an unfinished attempt left in a table that this batch does not write."""
        remove_folder(self.spark, f"{self.root}/{table}/writer={writer}/batch_id={batch_id}")

    def write(self, df: DataFrame, table: str, writer: str, batch_id: int, *, sort: tuple[str, ...] = ("slot",), lookup: str | None = None) -> None:
        """Replace this batch's folder of a table.

        A ``lookup`` column has mostly distinct values. It gets a bloom filter
        in place of a dictionary, so that a search for one value skips the row
        groups that cannot hold it.

        Rebalancing by slot bucket lets the adaptive planner split a large
        bucket over several tasks and merge small ones, so files come out even.
        """
        self.keep_layout()
        bloom = {}
        if lookup:
            bloom = {f"parquet.bloom.filter.enabled#{lookup}": "true", f"parquet.enable.dictionary#{lookup}": "false"}
        (
            df.withColumn("slot_bucket", slot_bucket(size=self.slots_per_bucket))
            .hint("rebalance", "slot_bucket")
            .sortWithinPartitions("slot_bucket", *sort)
            .write.partitionBy("slot_bucket")
            .options(**bloom, compression="zstd")
            .mode("overwrite")
            .parquet(f"{self.root}/{table}/writer={writer}/batch_id={batch_id}")
        )

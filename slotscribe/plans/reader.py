"""Query interface of an index: every answer is a DataFrame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.idl_types import type_label
from ..operators import lookups
from ..operators.dedup import keep_last
from ..operators.lookups import CallFilter
from ..operators.registry import Entry, Program
from .side_tables import zone_counts
from .store import LAST_SIG_KEY, QUARANTINE_SCHEMA, TRANSACTION_SCHEMA, IndexState, IndexStore


class IndexReader:
    """Lookups, lists, series, account states and statistics of one program's index."""

    def __init__(self, store: IndexStore, program: Program):
        self.store, self.program = store, program

    # -- tables ----------------------------------------------------------------

    def _table(self, entry: Entry, state: IndexState | None = None, slots: tuple[int | None, int | None] | None = None) -> DataFrame:
        """Rows of a table; a range of slots limits the folders that are read."""
        state = state or self.store.load()
        buckets = self.store.buckets_of(*slots) if slots and slots != (None, None) else None
        return self.store.read(entry.table, self._schema(entry.kind, entry.table, state), state=state, buckets=buckets)

    def _schema(self, kind: str, table: str, state: IndexState) -> StructType:
        return state.table_schema(table, self.program.table_schema(kind, table))

    def transactions(self, state: IndexState | None = None, slots: tuple[int | None, int | None] = (None, None)) -> DataFrame:
        """All indexed transactions, or those in the buckets of a range of slots."""
        buckets = None if slots == (None, None) else self.store.buckets_of(*slots)
        return self.store.read("transactions", TRANSACTION_SCHEMA, state=state, buckets=buckets)

    def call_table(self, ix_name: str, *, with_block_ts: bool = False, slots: tuple[int | None, int | None] = (None, None)) -> DataFrame:
        """All calls of an instruction; ``block_ts`` is the chain time as a timestamp."""
        calls = self._table(self.program.resolve("instruction", ix_name), slots=slots)
        return calls.withColumn("block_ts", F.timestamp_seconds("block_time")) if with_block_ts else calls

    def account_table(self, account_type: str) -> DataFrame:
        """All states of an account type, the last written one per (address, slot)."""
        if not account_type:
            raise ValueError("an account type is required; see schema() for the available ones")
        states = self._table(self.program.resolve("account", account_type))
        return keep_last(states, ["address", "slot"], ["updated_at", "batch_id"])

    # -- answers ---------------------------------------------------------------

    def health(self) -> dict:
        """Program and last checkpoint; errors of the state table are raised, not hidden."""
        return {"status": "ok", "program_id": self.program.program_id, "last_checkpoint": self.store.load().values.get(LAST_SIG_KEY)}

    def schema(self) -> dict:
        """Program name, instructions and accounts with their tables and fields."""
        def shown(entry: Entry, fields: str) -> dict:
            listed = [{"name": f.name, "ty": type_label(f.type_text)} for f in entry.fields if f.name is not None]
            return {"name": entry.name, fields: listed, "table_name": entry.table}

        return {
            "program_name": self.program.name,
            "instructions": [shown(e, "args") for e in self.program.instructions if e.has_table],
            "accounts": [shown(e, "fields") for e in self.program.accounts if e.has_table],
        }

    def transaction(self, signature: str, slot: int | None = None) -> DataFrame:
        """The transaction with a signature, or no row; its slot, if not given, is looked up, and only that folder is read."""
        state = self.store.load()
        slots = self.store.locate(state, "transactions", signature) if slot is None else [slot]
        buckets = None if slots is None else self._buckets(slots)
        return lookups.transaction(self.store.read("transactions", TRANSACTION_SCHEMA, state=state, buckets=buckets), signature)

    def _buckets(self, slots: list[int]) -> list[int]:
        return sorted({s // self.store.slots_per_bucket for s in slots})

    def _bound(self, value) -> Column | None:
        return None if value is None else value if isinstance(value, Column) else F.lit(value)

    def calls(self, ix_name: str, f: CallFilter = CallFilter(), *, time_col: str = "created_at") -> DataFrame:
        """One page of calls of an instruction.

        Slot bounds, time bounds or a transaction's signature also limit the folders that are read.
        """
        entry, state = self.program.resolve("instruction", ix_name), self.store.load()
        buckets = None
        if f.from_slot is not None or f.to_slot is not None:
            buckets = self.store.buckets_of(f.from_slot, f.to_slot)
        elif f.tx_sig is not None:
            slots = self.store.locate(state, entry.table, f.tx_sig)
            buckets = None if slots is None else self._buckets(slots)
        elif f.from_time is not None or f.to_time is not None:
            buckets = self.store.buckets_in_time(state, entry.table, time_col, self._bound(f.from_time), self._bound(f.to_time))
        table = self._call_rows(entry, state, buckets, time_col)
        return lookups.list_calls(table, f, time_col=time_col).drop("writer", "batch_id", "slot_bucket")

    def _call_rows(self, entry: Entry, state: IndexState, buckets, time_col: str) -> DataFrame:
        rows = self.store.read(entry.table, self._schema(entry.kind, entry.table, state), state=state, buckets=buckets)
        return rows.withColumn("block_ts", F.timestamp_seconds("block_time")) if time_col == "block_ts" else rows

    def calls_json(self, ix_name: str, f: CallFilter = CallFilter(), *, time_col: str = "created_at") -> DataFrame:
        """One page of calls, each as one JSON object ``row``."""
        page = self.calls(ix_name, f, time_col=time_col)
        return page.select(lookups.row_json(page).alias("row"))

    def call_count(self, ix_name: str) -> DataFrame:
        """Number of calls of an instruction, summed from the zones."""
        state = self.store.load()
        if state.key_buckets is None:
            return lookups.call_count(self.call_table(ix_name))
        table = self.program.resolve("instruction", ix_name).table
        return zone_counts(self.store.zones(state), [table]).select("calls")

    def time_series(self, ix_name: str, from_time=None, to_time=None, bucket: str | None = None, *, time_col: str = "created_at") -> DataFrame:
        """Calls per hour, day or week, newest first; only folders with rows of that time are read."""
        entry, state = self.program.resolve("instruction", ix_name), self.store.load()
        low, high = lookups.series_bounds(from_time, to_time)
        table = self._call_rows(entry, state, self.store.buckets_in_time(state, entry.table, time_col, low, high), time_col)
        return lookups.time_series(table, ix_name, from_time, to_time, bucket, time_col=time_col)

    def call_stats(self, ix_name: str, from_time=None, to_time=None, bucket: str | None = None, *, time_col: str = "created_at") -> dict:
        """Name, table, total (a DataFrame), the bucket applied and the series (a DataFrame)."""
        return {
            "ix_name": ix_name,
            "table": self.program.resolve("instruction", ix_name).table,
            "total_calls": self.call_count(ix_name),
            "bucket": lookups.effective_bucket(bucket),
            "series": self.time_series(ix_name, from_time, to_time, bucket, time_col=time_col),
        }

    def accounts(self, account_type: str) -> DataFrame:
        """Newest state of every account of a type.

        The current states are read as they are; batches not folded into them
        yet are added bucket by bucket. Without current states all versions are
        ranked, in one shuffle.
        """
        if not account_type:
            raise ValueError("an account type is required; see schema() for the available ones")
        entry, state = self.program.resolve("account", account_type), self.store.load()
        if state.key_buckets is None:
            return lookups.account_rows(lookups.newest_per_account(self._table(entry, state), tie_breaks=("updated_at", "batch_id")))
        columns = self._schema("account", entry.table, state)
        current = self.store.current(entry.table, columns, state)
        rows = current.read(self.store.unfolded(entry.table, columns, state), not self.store.has_states(entry.table))
        return lookups.account_rows(rows.drop("key_bucket"))

    def account(self, account_type: str, address: str) -> DataFrame:
        """Newest state of one account, or no row; only the folder of its newest slot is read."""
        return lookups.account_rows(lookups.account_latest(self._one_account(account_type, address, 1), address))

    def account_history(self, account_type: str, address: str, limit: int | None = None) -> DataFrame:
        """Newest states of one account; only the folders of their slots are read."""
        newest = lookups.HISTORY_PAGE if limit is None else limit
        return lookups.account_rows(lookups.account_history(self._one_account(account_type, address, newest), address, limit))

    def _one_account(self, account_type: str, address: str, newest: int) -> DataFrame:
        if not account_type:
            raise ValueError("an account type is required; see schema() for the available ones")
        entry, state = self.program.resolve("account", account_type), self.store.load()
        slots = self.store.locate(state, entry.table, address, newest)
        rows = self.store.read(entry.table, self._schema("account", entry.table, state), state=state, buckets=None if slots is None else self._buckets(slots))
        return keep_last(rows.where(F.col("address") == address), ["address", "slot"], ["updated_at", "batch_id"])

    def stats(self) -> DataFrame:
        """Transactions, slots, calls per table and in total, last checkpoint: one row, summed from the zones."""
        state, last = self.store.load(), LAST_SIG_KEY
        tables = list(self.program.tables("instruction"))
        if state.key_buckets is None:
            rows = {t: self._table(self.program.tables("instruction")[t][0], state) for t in tables}
            return lookups.program_stats(self.transactions(state), rows, state.values.get(last))
        zones = self.store.zones(state)
        own = zones.where("indexed = 'transactions'").agg(
            F.coalesce(F.sum("rows"), F.lit(0)).alias("total_transactions"), F.min("min_slot").alias("first_indexed_slot"), F.max("max_slot").alias("last_indexed_slot")
        )
        return lookups.stats_row(own, zone_counts(zones, tables), state.values.get(last))

    def tables(self, state: IndexState | None = None) -> dict[str, StructType]:
        """All tables of this index with the schema they have grown to."""
        state = state or self.store.load()
        own = {table: self._schema(kind, table, state) for kind in ("instruction", "account") for table in self.program.tables(kind)}
        return {"transactions": TRANSACTION_SCHEMA, "quarantine": QUARANTINE_SCHEMA, **own}

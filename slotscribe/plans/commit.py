"""Write one batch of transactions into the index: all tables, then the state row."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field, replace
from datetime import datetime, timezone
from functools import partial, reduce

from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import normalize
from ..operators.decode import decode_payload
from ..operators.dedup import keep_first, not_keyed, not_stored
from ..operators.registry import FIXED_COLUMNS, Entry, Program
from ..session import Staging, remove_folder
from .side_tables import buckets_for
from .store import BUCKETS_KEY, FOLDED_KEY, LAST_SIG_KEY, LAST_SLOT_KEY, QUARANTINE_SCHEMA, SCHEMA_KEY, TRANSACTION_SCHEMA, IndexState, IndexStore

# Distinct slot buckets up to which a batch names them one by one when it looks
# for stored duplicates; beyond that it uses their range.
MAX_BUCKET_LIST = 5_000
# Touched addresses up to which they are broadcast: some 60 bytes each, 6 MB in all.
BROADCAST_ADDRESSES = 100_000
# Transactions of a batch up to which their signatures are broadcast to stored
# rows: some 90 bytes each, 9 MB in all.
BROADCAST_BATCH = 100_000
# Hashes of repeated signatures up to which they are broadcast to a batch: 8 bytes each, some 32 MB as a table.
BROADCAST_REPEATED = 1_000_000
# Tables written at the same time; each write is its own Spark job.
PARALLEL_WRITES = 4


@dataclass(frozen=True)
class CommitOptions:
    """How a batch is written."""

    # Key under which the first call wins. ("tx_sig",) keeps one call per
    # transaction and table, ("tx_sig", "ix_index") keeps repeated calls.
    call_key: tuple[str, ...] = ("tx_sig", "ix_index")
    # Processing order for first touches: oldest slot first, or newest first.
    newest_first: bool = False
    # Column of an explicit processing order (signature lists).
    order: str | None = None
    # Slot to record as scanned, even when the batch is empty.
    slot_checkpoint: int | None = None
    # Use snapshot versions not newer than the touch instead of current ones.
    as_of: bool = False
    # Stored duplicates are looked for in the whole table. A number limits that
    # to so many slots around the batch, for feeds whose transactions can only
    # land near the block they refer to.
    conflict_slack: int | None = None
    engine: str = "auto"
    # Failed transactions are indexed like others, or left out.
    include_failed: bool = True
    # Fold the batch's account states into the current ones once it is committed.
    fold_states: bool = True


@dataclass
class CommitResult:
    """What a commit recorded."""

    writer: str
    batch_id: int
    checkpoints: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class ConflictRange:
    """Where stored rows can conflict with a batch: slot buckets, and the slots inside them."""

    buckets: list[int] | tuple[int, int] | None
    low: int | None
    high: int | None

    def limit(self, stored: DataFrame) -> DataFrame:
        return stored if self.low is None else stored.where(F.col("slot").between(self.low, self.high))


def conflict_range(txs: DataFrame, size: int, slack: int | None) -> ConflictRange:
    """Slots within ``slack`` of the batch's own; everything when ``slack`` is None.

    Buckets are listed while they are few, so a sparse batch reads few folders.
    """
    if slack is None:
        return ConflictRange(None, None, None)
    low, high = txs.agg(F.min("slot"), F.max("slot")).first()
    if low is None:
        return ConflictRange([], 0, -1)
    own = txs.groupBy(F.floor(F.col("slot") / size)).agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"))
    near = F.sequence(F.floor((F.col("lo") - slack) / size), F.floor((F.col("hi") + slack) / size))
    buckets = own.select(F.explode(near).alias("b")).select(F.col("b").cast("bigint").alias("b")).distinct()
    listed = [r["b"] for r in buckets.limit(MAX_BUCKET_LIST + 1).collect()]
    if len(listed) > MAX_BUCKET_LIST:
        return ConflictRange(((low - slack) // size, (high + slack) // size), low - slack, high + slack)
    return ConflictRange(sorted(listed), low - slack, high + slack)


# Raised for a value that the saved type of its column cannot hold.
DOES_NOT_FIT = "does_not_fit"


def decode_entry(
    rows: DataFrame, entry: Entry, schema: T.StructType, engine: str = "auto", *, ingested: Column | None = None, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Routed rows of one type as rows of its table, in the table's schema.

    Only the fixed columns of its kind (and ``keep``) stand beside the payload
    while it is decoded, so fields may have any name. Types of saved columns
    never change: a value that no longer fits becomes NULL and is flagged.
    Columns the type no longer has stay, empty.
    """
    before, after = FIXED_COLUMNS[entry.kind]
    own = {c.split()[0] for c in after}
    fixed = [c for c in (*[b.split()[0] for b in before], *keep) if c in rows.columns]
    decoded = decode_payload(rows.select(*fixed, "data"), entry.layout, engine=engine)
    columns, misfits = {}, []
    for f in schema.fields:
        column = F.col(f"`{f.name}`")
        if f.name in decoded.columns:
            if decoded.schema[f.name].dataType != f.dataType:
                cast = column.try_cast(f.dataType)
                misfits.append(F.when(column.isNotNull() & cast.isNull(), F.lit(DOES_NOT_FIT)))
                column = cast
            columns[f.name] = column
        elif f.name in own:
            columns[f.name] = F.current_timestamp() if ingested is None else ingested
        else:
            columns[f.name] = F.lit(None).cast(f.dataType)
    if misfits and "decode_issues" in columns:
        raised = F.slice(F.filter(F.array(*misfits), lambda code: code.isNotNull()), 1, 1)
        columns["decode_issues"] = F.concat(columns["decode_issues"], raised)
    return decoded.select(*[c.alias(name) for name, c in columns.items()])


def decode_table(rows: DataFrame, entries: list[Entry], schema: T.StructType, engine: str = "auto", ingested: Column | None = None) -> DataFrame:
    """Routed rows of one table, each decoded with the layout of its own entry."""
    if len(entries) == 1:
        return decode_entry(rows, entries[0], schema, engine, ingested=ingested)
    parts = [decode_entry(rows.where(F.col("entry_name") == e.name), e, schema, engine, ingested=ingested) for e in entries]
    return reduce(DataFrame.unionByName, parts)


def stage_transactions(txs: DataFrame, staging: Staging) -> DataFrame:
    """Whole transactions staged with a number each. A commit of them, or of some, stages them no more."""
    return staging.put(txs.drop("header").withColumn("_row", F.monotonically_increasing_id()), "transactions")


def first_per_signature(txs: DataFrame, order: list[str | Column], staging: Staging) -> DataFrame:
    """The first transaction of each signature in ``order``, staged.

    Whole transactions stay where they were read. Hashes of signatures are
    counted, and only rows whose hash occurs again are compared, by their signature and
    place. Beyond ``BROADCAST_REPEATED`` such hashes whole rows are dealt out by signature.
    """
    read = txs if "_row" in txs.columns else stage_transactions(txs, staging)
    mark = F.xxhash64("signature").alias("_mark")
    repeated = staging.put(read.groupBy(mark).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("_mark"), "repeated")
    marks = repeated.limit(BROADCAST_REPEATED + 1).count()
    if marks == 0:
        return read.drop("_row")
    if marks > BROADCAST_REPEATED:
        return staging.put(keep_first(read, ["signature"], [*order, "_row"]).drop("_row"), "first")
    places = read.drop("accounts", "instructions").withColumn("_mark", F.xxhash64("signature"))
    again = places.join(F.broadcast(repeated), "_mark", "left_semi")
    first = staging.put(keep_first(again, ["signature"], [*order, "_row"]).select(F.col("signature").alias("_sig"), F.col("_row").alias("_first")), "first")
    matched = read.join(F.broadcast(first), F.col("signature").eqNullSafe(F.col("_sig")), "left")
    return matched.where(F.col("_first").isNull() | (F.col("_first") == F.col("_row"))).drop("_row", "_sig", "_first")


@dataclass(frozen=True)
class StoredAgain:
    """Keys of a batch that other batches have stored, of all its tables: (indexed, key, item, own_slot), the batch's slot being the last.

    They are found with one exchange of the batch's signatures and slots. The rows themselves are compared
    with these keys only: not at all without any, by broadcast while they are few. Many are
    joined by shuffle, and rows of slots that hold none pass without being moved.
    """

    keys: DataFrame
    count: int
    low: int | None
    high: int | None

    @classmethod
    def find(cls, txs: DataFrame, stored: DataFrame, few: bool, staging: Staging) -> "StoredAgain":
        """``stored`` are keys as ``IndexStore.keys`` has them, which are not moved; ``few`` transactions are sent to them."""
        own = txs.select(F.col("signature").alias("key"), F.col("slot").alias("own_slot"))
        own = F.broadcast(own) if few else own.hint("merge")
        keys = staging.put(stored.join(own, "key").select("indexed", "key", "item", "own_slot"), "stored_again")
        count = keys.limit(BROADCAST_BATCH + 1).count()
        return cls(keys, count, *(keys.agg(F.min("own_slot"), F.max("own_slot")).first() if count else (None, None)))

    def without(self, rows: DataFrame, table: str, key: str, item: str | None) -> DataFrame:
        """Rows whose key, or key and item, is not stored in the table."""
        if self.count == 0:
            return rows
        stored = self.keys.where(F.col("indexed") == table).select("key", "item")
        if self.count <= BROADCAST_BATCH:
            return not_keyed(rows, F.broadcast(stored), key, item)
        # A NULL slot is within no bounds, so its rows are compared.
        near = F.coalesce(F.col("slot").between(self.low, self.high), F.lit(True))
        return not_keyed(rows.where(near), stored, key, item).unionByName(rows.where(~near))


def route_calls(txs: DataFrame, program: Program) -> DataFrame:
    """Calls of the program with the table they belong to; NULL tables are for quarantine."""
    return normalize.route(normalize.calls(txs, program.program_id), program, "instruction")


def account_states(
    touches: DataFrame, snapshots: DataFrame, program: Program, staging: Staging, options: CommitOptions = CommitOptions()
) -> DataFrame:
    """Touched accounts with their routed snapshot payload."""
    first = staging.put(normalize.first_touch(touches, options.order, newest_first=options.newest_first), "touched")
    # The count decides: few addresses are sent to the snapshots, many are joined by shuffle.
    few = first.limit(BROADCAST_ADDRESSES + 1).count() <= BROADCAST_ADDRESSES
    if few:
        first = F.broadcast(first)
    pick = normalize.snapshots_as_of if options.as_of else normalize.current_snapshots
    return normalize.route(pick(first, snapshots, spread=not few), program, "account").where(F.col("table_name").isNotNull())


def commit_batch(
    store: IndexStore,
    program: Program,
    txs: DataFrame,
    *,
    writer: str,
    batch_id: int,
    snapshots: DataFrame | None = None,
    options: CommitOptions = CommitOptions(),
) -> CommitResult:
    """Index a batch of normalised transactions.

    The source is read once: deduplicated transactions are staged below the
    index (unless they come from ``stage_transactions``), and so are the routed calls, partitioned by table, so that each
    table's job reads only its own rows and tables without any get no job.
    Repeating a batch with the same writer and id replaces it; other batches
    are checked for stored keys. All rows of a batch have one ingest time.
    """
    with Staging(store.spark, f"commit-{writer}-{batch_id}", store.root) as staging:
        return _commit(store, program, txs, writer, batch_id, snapshots, options, staging)


def _commit(
    store: IndexStore, program: Program, txs: DataFrame, writer: str, batch_id: int,
    snapshots: DataFrame | None, options: CommitOptions, staging: Staging,
) -> CommitResult:
    order = [*([options.order] if options.order else []), "slot", "tx_index"]
    if options.newest_first and not options.order:
        order = [F.desc("slot"), F.desc("tx_index")]
    if not options.include_failed:
        txs = txs.where(F.col("err").isNull())
    staged = first_per_signature(txs, order, staging)
    size = staged.count()
    state = store.load()
    committed = state.committed
    # A new index keeps keys, zones and current states; one begun without them goes on so.
    buckets = state.key_buckets if committed else store.key_buckets or buckets_for(size)
    item = {("tx_sig", "ix_index"): "ix_index", ("tx_sig",): None}
    now = F.lit(datetime.now(timezone.utc))
    near = conflict_range(staged, store.slots_per_bucket, options.conflict_slack) if committed else None

    few = size <= BROADCAST_BATCH
    probe = staged.select("signature") if committed and few else None
    again = None
    if committed and buckets is not None:
        checked = ["transactions", "quarantine", *program.tables("instruction")]
        again = StoredAgain.find(staged, near.limit(store.keys(state, checked, (writer, batch_id))), few, staging)

    def fresh(rows: DataFrame, table: str, columns: T.StructType, key: tuple[str, ...]) -> DataFrame:
        """Rows that no other batch has stored."""
        if not committed:
            return rows
        if buckets is not None and (key in item or key == ("signature",)):
            return again.without(rows, table, key[0], item.get(key))
        known = near.limit(store.read(table, columns, state=state, exclude=(writer, batch_id), buckets=near.buckets))
        return not_stored(rows, known, list(key), probe)

    new_state: dict[str, str] = {} if committed else {BUCKETS_KEY: str(buckets)}
    written: dict[str, T.StructType] = {"transactions": TRANSACTION_SCHEMA}

    def write_transactions() -> None:
        rows = staged.withColumn("created_at", now).select(*TRANSACTION_SCHEMA.names)
        rows = fresh(rows, "transactions", TRANSACTION_SCHEMA, ("signature",))
        store.write(rows, "transactions", writer, batch_id, sort=("slot", "tx_index"), lookup="signature")

    routed = route_calls(staged, program)
    routed = staging.put(
        routed.withColumn("target", F.coalesce("table_name", F.lit("_quarantine"))), "calls", partition="target"
    )

    def write_quarantine() -> None:
        rows = normalize.quarantine(routed.where(F.col("target") == "_quarantine"))
        rows = rows.withColumn("created_at", now).select(*QUARANTINE_SCHEMA.names)
        rows = fresh(rows, "quarantine", QUARANTINE_SCHEMA, ("tx_sig", "ix_index"))
        store.write(rows, "quarantine", writer, batch_id)

    def write_calls(table: str, entries: list[Entry], columns: T.StructType) -> None:
        rows = routed.where(F.col("target") == table)
        if options.call_key != ("tx_sig", "ix_index"):
            rows = keep_first(rows, list(options.call_key), ["ix_index"])
        rows = fresh(rows, table, columns, options.call_key)
        store.write(decode_table(rows, entries, columns, options.engine, now), table, writer, batch_id, lookup="tx_sig")

    def grown_schema(kind: str, table: str) -> T.StructType:
        columns = state.table_schema(table, program.table_schema(kind, table))
        if state.values.get(SCHEMA_KEY + table) != columns.json():
            new_state[SCHEMA_KEY + table] = columns.json()
        return columns

    # One row per table: only the folder names of the staged calls are read.
    filled = {r["target"] for r in routed.select("target").distinct().collect()}
    jobs = [write_transactions]

    def add(there: bool, table: str, columns: T.StructType, job) -> None:
        jobs.append(job if there else partial(store.drop_batch, table, writer, batch_id))
        if there:
            written[table] = columns

    add("_quarantine" in filled, "quarantine", QUARANTINE_SCHEMA, write_quarantine)
    for table, entries in program.tables("instruction").items():
        columns = grown_schema("instruction", table)
        add(table in filled, table, columns, partial(write_calls, table, entries, columns))
    accounts: dict[str, T.StructType] = {}
    if snapshots is not None and program.accounts:
        states = staging.put(
            account_states(normalize.touched_accounts(routed, options.order), snapshots, program, staging, options),
            "accounts", partition="table_name",
        )

        def write_accounts(table: str, entries: list[Entry], columns: T.StructType) -> None:
            rows = decode_table(states.where(F.col("table_name") == table), entries, columns, options.engine, now)
            store.write(rows, table, writer, batch_id, sort=("address", "slot"), lookup="address")

        held = {r["table_name"] for r in states.select("table_name").distinct().collect()}
        for table, entries in program.tables("account").items():
            columns = accounts[table] = grown_schema("account", table)
            add(table in held, table, columns, partial(write_accounts, table, entries, columns))

    with ThreadPoolExecutor(PARALLEL_WRITES) as pool:
        for done in [pool.submit(inheritable_thread_target(store.spark)(job)) for job in jobs]:
            done.result()
    if buckets is not None:
        store.write_side_tables(written, writer, batch_id, buckets, size)

    newest = staged.agg(
        F.max_by("signature", F.struct("slot", "tx_index")).alias("signature"), F.max("slot").alias("slot")
    ).first()
    checkpoints = {}
    if newest["signature"] is not None:
        checkpoints[LAST_SIG_KEY] = newest["signature"]
        checkpoints[LAST_SLOT_KEY] = str(newest["slot"])
    if options.slot_checkpoint is not None:
        checkpoints[LAST_SLOT_KEY] = str(options.slot_checkpoint)
    store.write_state({**new_state, **checkpoints}, writer, batch_id)
    if buckets is not None and options.fold_states and any(table in written for table in accounts):
        fold_states(store, accounts, replace(state, committed={**committed, writer: max(batch_id, committed.get(writer, -1))}, values={**state.values, **new_state}))
    return CommitResult(writer, batch_id, checkpoints)


def fold_states(store: IndexStore, tables: dict[str, T.StructType], state: IndexState | None = None) -> None:
    """Bring the current states of these account tables up to date with all batches that count.

    Only buckets with an account of a batch that is not folded yet are
    rewritten. A run that fails part way is repeated by the next one; readers
    add unfolded batches themselves, so answers are the same before and after.
    One writer folds at a time, and ``rebuild_states`` starts over from all versions.
    """
    state = state or store.load()
    late = {w: n for w, n in state.committed.items() if n > state.folded.get(w, -1)}
    if not late:
        return
    with Staging(store.spark, "fold", store.root) as staging:
        for table, columns in tables.items():
            newest, touched = store.current(table, columns, state).merged(store.unfolded(table, columns, state), not store.has_states(table))
            if touched:
                store.current(table, columns, state).write(staging.put(newest, table))
    writer, batch_id = max(late.items(), key=lambda x: x[1])
    store.write_state({f"{FOLDED_KEY}{w}": str(n) for w, n in late.items()}, writer, batch_id)


def rebuild_states(store: IndexStore, tables: dict[str, T.StructType]) -> None:
    """Current states anew from all versions, in place of whatever is there."""
    state = store.load()
    for table, columns in tables.items():
        rows = store.read(table, columns, state=state).drop("slot_bucket")
        current = store.current(table, columns, state)
        everything, _ = current.merged(rows, True)
        with Staging(store.spark, "states", store.root) as staging:
            newest = staging.put(everything, table)
            remove_folder(store.spark, current.path)
            current.write(newest)
    if state.committed:
        writer, batch_id = max(state.committed.items(), key=lambda x: x[1])
        store.write_state({f"{FOLDED_KEY}{w}": str(n) for w, n in state.committed.items()}, writer, batch_id)

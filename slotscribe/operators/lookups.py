"""Query operators over transaction, call and account tables.

Each takes a DataFrame and returns a DataFrame, so Catalyst sees the whole
query; nothing is collected here.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Page sizes where none is asked for, and the default time window.
CALL_PAGE = 50
HISTORY_PAGE = 20
BUCKETS = ("hour", "day", "week")
DEFAULT_BUCKET = "hour"
DEFAULT_WINDOW = "7 days"

# Columns of an account row that are not decoded fields.
ACCOUNT_COLUMNS = ("address", "slot", "lamports", "updated_at")
# Stored columns that belong to the engine, not to the row.
HIDDEN_COLUMNS = ("decode_issues", "slot_bucket", "writer", "batch_id")


@dataclass(frozen=True)
class CallFilter:
    """Optional, inclusive call filters; absent ones add no predicate."""

    tx_sig: str | None = None
    from_slot: int | None = None
    to_slot: int | None = None
    from_time: object = None
    to_time: object = None
    limit: int | None = None
    offset: int = 0
    # Go on after this row of the page before, by its (time, slot, tx_sig, ix_index); a page costs the same at any depth.
    after: tuple | None = None


def bind_time(df: DataFrame, column: str, value) -> Column:
    """A time bound in the column's own type, so that it reaches the scan."""
    bound = value if isinstance(value, Column) else F.lit(value)
    return bound.cast(df.schema[column].dataType)


def _stored_bound(df: DataFrame, time_col: str, low: Column | None, high: Column | None) -> list[Column]:
    """Chain time is computed from the stored seconds, so its bounds are put to these too and reach the scan."""
    if time_col != "block_ts" or "block_time" not in df.columns:
        return []
    seconds = lambda bound: F.unix_seconds(bound.cast("timestamp"))
    return [c for c in (None if low is None else F.col("block_time") >= seconds(low), None if high is None else F.col("block_time") <= seconds(high)) if c is not None]


def transaction(txs: DataFrame, signature) -> DataFrame:
    """The transaction with this signature: zero or one row."""
    return txs.where(F.col("signature") == F.lit(signature))


def filter_calls(calls: DataFrame, f: CallFilter, *, time_col: str = "created_at") -> DataFrame:
    """Calls matching every given filter."""
    predicates = []
    if f.tx_sig is not None:
        predicates.append(F.col("tx_sig") == F.lit(f.tx_sig))
    if f.from_slot is not None:
        predicates.append(F.col("slot") >= f.from_slot)
    if f.to_slot is not None:
        predicates.append(F.col("slot") <= f.to_slot)
    if f.from_time is not None:
        low = bind_time(calls, time_col, f.from_time)
        predicates += [F.col(time_col) >= low, *_stored_bound(calls, time_col, low, None)]
    if f.to_time is not None:
        high = bind_time(calls, time_col, f.to_time)
        predicates += [F.col(time_col) <= high, *_stored_bound(calls, time_col, None, high)]
    return calls.where(reduce(Column.__and__, predicates)) if predicates else calls


def list_calls(calls: DataFrame, f: CallFilter = CallFilter(), *, time_col: str = "created_at", most: int | None = None) -> DataFrame:
    """One page of matching calls, newest first, with a total order.

    A limit is honoured as it is; a service that wants a maximum names it as ``most``.
    """
    limit = _page(f.limit, CALL_PAGE, most)
    order = page_order(calls, time_col)
    rows = filter_calls(calls, f, time_col=time_col)
    if f.after is not None:
        rows = rows.where(follows(rows, order, f.after))
    return rows.orderBy(*[F.desc(c) if newest else F.asc(c) for c, newest in order]).offset(f.offset).limit(limit)


def page_order(calls: DataFrame, time_col: str = "created_at") -> list[tuple[str, bool]]:
    """Columns that calls are listed by, and whether the greatest comes first."""
    order = [(time_col, True), ("slot", True), ("tx_sig", False), ("ix_index", False)]
    return [(c, newest) for c, newest in order if c in calls.columns]


def follows(calls: DataFrame, order: list[tuple[str, bool]], last: tuple) -> Column:
    """Whether a row comes after the one with these values in the order; the first column's bound reaches the scan."""
    if len(last) != len(order):
        raise ValueError(f"a page goes on after values of {[c for c, _ in order]}")
    bounds = [bind_time(calls, c, value) for (c, _), value in zip(order, last)]
    same, later = F.lit(True), F.lit(False)
    for (c, newest), bound in zip(order, bounds):
        later = later | (same & (F.col(c) < bound if newest else F.col(c) > bound))
        same = same & (F.col(c) == bound)
    (first, newest), bound = order[0], bounds[0]
    return (F.col(first) <= bound if newest else F.col(first) >= bound) & later


def _page(limit: int | None, usual: int, most: int | None) -> int:
    asked = usual if limit is None else limit
    return asked if most is None else min(asked, most)


def row_json(df: DataFrame, columns: list[str] | None = None) -> Column:
    """The row (or the given columns) as one JSON object, NULLs included."""
    names = columns if columns is not None else [c for c in df.columns if c not in HIDDEN_COLUMNS]
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in names]), {"ignoreNullFields": "false"})


def call_count(calls: DataFrame) -> DataFrame:
    """Number of calls in the table, whatever their time."""
    return calls.agg(F.count(F.lit(1)).alias("calls"))


def effective_bucket(bucket: str | None) -> str:
    """The bucket that is applied: unknown ones fall back to the hour."""
    return bucket if bucket in BUCKETS else DEFAULT_BUCKET


def series_bounds(from_time, to_time) -> tuple[Column, Column]:
    """Bounds of a series: those given, else the last seven days."""
    bounds = (
        F.current_timestamp() - F.expr(f"interval {DEFAULT_WINDOW}") if from_time is None else from_time,
        F.current_timestamp() if to_time is None else to_time,
    )
    return tuple(b if isinstance(b, Column) else F.lit(b) for b in bounds)


def time_series(
    calls: DataFrame,
    ix_name: str | Column | None = None,
    from_time=None,
    to_time=None,
    bucket: str | None = DEFAULT_BUCKET,
    *,
    time_col: str = "created_at",
    group: str | None = None,
    ordered: bool = True,
) -> DataFrame:
    """Calls per hour, day or week (from Monday), newest bucket first; empty buckets are left out.

    Without bounds the last seven days count. ``group`` keeps one series per
    value of that column instead of a single ``ix_name``.
    """
    kind = calls.schema[time_col].dataType
    low, high = (bind_time(calls, time_col, bound) for bound in series_bounds(from_time, to_time))
    period = F.date_trunc(effective_bucket(bucket), F.col(time_col)).cast(kind).alias("period")
    name = F.col(group) if group else (ix_name if isinstance(ix_name, Column) else F.lit(ix_name))
    series = (
        calls.where(reduce(Column.__and__, _stored_bound(calls, time_col, low, high), F.col(time_col).between(low, high)))
        .groupBy(name.cast("string").alias("ix_name"), period)
        .agg(F.count(F.lit(1)).alias("calls"))
    )
    return series.orderBy(F.desc("period"), "ix_name") if ordered else series


def _newest(*extra: str) -> list[Column]:
    return [F.desc("slot"), *[F.desc(c) for c in extra]]


def account_latest(accounts: DataFrame, address, *, tie_breaks: tuple[str, ...] = ()) -> DataFrame:
    """Newest state of one account."""
    return accounts.where(F.col("address") == F.lit(address)).orderBy(*_newest(*tie_breaks)).limit(1)


def account_history(
    accounts: DataFrame, address, limit: int | None = None, *, tie_breaks: tuple[str, ...] = (), most: int | None = None
) -> DataFrame:
    """Newest states of one account, up to ``limit`` (20 if not given)."""
    count = _page(limit, HISTORY_PAGE, most)
    return accounts.where(F.col("address") == F.lit(address)).orderBy(*_newest(*tie_breaks)).limit(count)


def newest_per_account(accounts: DataFrame, count: int = 1, *, tie_breaks: tuple[str, ...] = (), rank: str | None = None) -> DataFrame:
    """The ``count`` newest states of every account.

    The row-number filter becomes a group limit that runs before the shuffle,
    so a hot address sends at most ``count`` rows per map task.
    """
    numbered = accounts.withColumn(
        rank or "_rn", F.row_number().over(Window.partitionBy("address").orderBy(*_newest(*tie_breaks)))
    ).where(F.col(rank or "_rn") <= count)
    return numbered if rank else numbered.drop("_rn")


def account_rows(accounts: DataFrame) -> DataFrame:
    """Account rows as served: fixed columns plus the decoded fields as JSON ``data``."""
    fields = [c for c in accounts.columns if c not in (*ACCOUNT_COLUMNS, *HIDDEN_COLUMNS)]
    data = row_json(accounts, fields) if fields else F.lit("{}")
    kept = [c for c in ACCOUNT_COLUMNS if c in accounts.columns]
    return accounts.select(*kept, data.alias("data"))


def transaction_stats(txs: DataFrame) -> DataFrame:
    """Transaction count and first and last slot; the slots are NULL on an empty table."""
    return txs.agg(
        F.count(F.lit(1)).alias("total_transactions"),
        F.min("slot").cast("bigint").alias("first_indexed_slot"),
        F.max("slot").cast("bigint").alias("last_indexed_slot"),
    )


def call_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, calls) of every call table, zero for empty ones, in one job."""
    parts = [df.agg(F.count(F.lit(1)).alias("calls")).select(F.lit(name).alias("table"), "calls") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def call_totals(calls: DataFrame, column: str, total: str = "__total__") -> DataFrame:
    """Calls per value of ``column`` plus one total row, from a unified call table."""
    return (
        calls.rollup(column)
        .agg(F.count(F.lit(1)).alias("calls"), F.grouping(column).alias("_g"))
        .select(F.when(F.col("_g") == 1, F.lit(total)).otherwise(F.col(column)).alias("table"), "calls")
    )


def program_stats(txs: DataFrame, tables: dict[str, DataFrame], last_checkpoint: str | None = None) -> DataFrame:
    """One row: transactions, slots, calls per table and in total, last checkpoint.

    Every table is reduced to one row where it is read; only those rows meet.
    """
    parts = transaction_stats(txs).select(
        F.lit(None).cast("string").alias("table"), F.col("total_transactions").alias("n"),
        "first_indexed_slot", "last_indexed_slot",
    )
    if tables:
        counts = call_counts(tables).select(
            "table", F.col("calls").alias("n"),
            F.lit(None).cast("bigint").alias("first_indexed_slot"), F.lit(None).cast("bigint").alias("last_indexed_slot"),
        )
        parts = parts.unionByName(counts)
    is_tx = F.col("table").isNull()
    pairs = F.array_sort(F.collect_list(F.when(~is_tx, F.struct("table", "n"))))
    return parts.agg(
        F.sum(F.when(is_tx, F.col("n"))).alias("total_transactions"),
        F.coalesce(F.sum(F.when(~is_tx, F.col("n"))), F.lit(0)).cast("bigint").alias("total_ix_calls"),
        F.map_from_entries(pairs).alias("ix_call_counts"),
        F.min("first_indexed_slot").alias("first_indexed_slot"),
        F.max("last_indexed_slot").alias("last_indexed_slot"),
        F.lit(last_checkpoint).cast("string").alias("last_checkpoint"),
    )


def stats_row(transactions: DataFrame, counts: DataFrame, last_checkpoint: str | None = None) -> DataFrame:
    """``program_stats`` from counts that are known: one row of transactions, and (table, calls)."""
    calls = counts.agg(
        F.coalesce(F.sum("calls"), F.lit(0)).cast("bigint").alias("total_ix_calls"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("table", "calls")))).alias("ix_call_counts"),
    )
    both = transactions.withColumn("_one", F.lit(1)).join(calls.withColumn("_one", F.lit(1)), "_one")
    return both.select(
        "total_transactions", "total_ix_calls", "ix_call_counts", "first_indexed_slot", "last_indexed_slot",
        F.lit(last_checkpoint).cast("string").alias("last_checkpoint"),
    )


def issue_counts(df: DataFrame) -> DataFrame:
    """Rows per decode issue of a decoded table."""
    return df.select(F.explode("decode_issues").alias("issue")).groupBy("issue").agg(F.count(F.lit(1)).alias("rows"))

"""Periodic jobs that keep an index fast: one file of state, and one batch instead of many."""

from __future__ import annotations

from ..operators.dedup import keep_last
from .commit import fold_states
from .reader import IndexReader
from .side_tables import buckets_for
from .store import BUCKETS_KEY, COMMIT_KEY, FOLDED_KEY, PARTITIONS, IndexStore

REWRITER = "rewrite"


def compact_state(store: IndexStore) -> int:
    """Rewrite the state table as its latest rows; see ``IndexStore.compact_state``."""
    return store.compact_state()


def rewrite_index(reader: IndexReader, target: IndexStore) -> None:
    """Copy an index into a new folder as one batch, with its side tables and checkpoints.

    The many small folders of a live index become one per table and slot
    bucket. The old index stays as it is, so a run that fails costs nothing;
    readers move to the new folder when it is done. Streams go on in the new
    one: what they have committed before is found by its keys.
    """
    source, state = reader.store, reader.store.load()
    if target.load().committed:
        raise ValueError(f"{target.root} already holds an index")
    accounts, tables = set(reader.program.tables("account")), {}
    for table, columns in reader.tables(state).items():
        rows = source.read(table, columns, state=state)
        if table in accounts:
            rows = keep_last(rows, ["address", "slot"], ["updated_at", "batch_id"])
        rows = rows.drop(*PARTITIONS.names)
        if rows.isEmpty():
            continue
        tables[table] = columns
        lookup = next((c for c in ("signature", "address", "tx_sig") if c in columns.names), None)
        target.write(rows, table, REWRITER, 0, lookup=lookup)
    transactions = reader.transactions(state).count()
    buckets = target.key_buckets or buckets_for(transactions)
    target.write_side_tables(tables, REWRITER, 0, buckets, transactions)
    kept = {k: v for k, v in state.values.items() if k not in (COMMIT_KEY, BUCKETS_KEY) and not k.startswith(FOLDED_KEY)}
    target.write_state({**kept, BUCKETS_KEY: str(buckets)}, REWRITER, 0)
    fold_states(target, {t: c for t, c in tables.items() if t in accounts})

"""Batch index runs: by signature list, by slot range with resume, or the newest transactions."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import normalize
from ..operators.registry import Program
from ..sources import blocks as source
from .commit import CommitOptions, CommitResult, commit_batch
from .store import LAST_SIG_KEY, LAST_SLOT_KEY, TRANSACTION_SCHEMA, IndexStore

# Fixed value: transactions of the newest-N mode and slots per progress chunk.
BATCH_SIZE = 100


@dataclass(frozen=True)
class BatchRequest:
    """What to index. A signature list wins over a slot range; neither means the newest ``batch_size``."""

    signatures: tuple[str, ...] = ()
    start_slot: int | None = None
    end_slot: int | None = None
    batch_size: int = BATCH_SIZE
    # Slots per commit of a range; None commits the whole range at once. Long
    # ranges should name one: what is committed is not done again after a failure.
    chunk_slots: int | None = None


def saved_slot(store: IndexStore) -> int | None:
    """Last recorded slot, None when there is none or it is not a number."""
    text = store.load().values.get(LAST_SLOT_KEY)
    return int(text) if text is not None and text.isdigit() else None


def newest_signatures(blocks: DataFrame, program_id: str, count: int) -> DataFrame:
    """The newest ``count`` signatures of a program.

    A table with slot buckets is searched from its newest bucket backwards,
    doubling the stretch until it holds enough, so old folders stay unread.
    """
    everything = source.program_signatures(blocks, program_id)
    if "slot_bucket" not in blocks.columns:
        return source.latest(everything, count)
    bounds = blocks.agg(F.min("slot_bucket").alias("low"), F.max("slot_bucket").alias("high")).first()
    width = 1
    while bounds["high"] is not None and bounds["high"] - width >= bounds["low"]:
        recent = source.program_signatures(blocks.where(F.col("slot_bucket") > bounds["high"] - width), program_id)
        if recent.limit(count).count() >= count:
            return source.latest(recent, count)
        width *= 2
    return source.latest(everything, count)


# Slot buckets up to which a signature list names them one by one; beyond, their range is read.
MAX_LISTED_BUCKETS = 5_000


def listed_transactions(blocks: DataFrame, signatures: list[str], bucket_size: int | None = None) -> DataFrame:
    """Every listed transaction, whether or not it mentions a program, with its place in the list.

    Positions come from the narrow signature columns; only the buckets that
    hold one are then read in full.
    """
    spark = blocks.sparkSession
    found = source.pick_signatures(source.program_signatures(blocks, None), spark, signatures)
    positions = found.select("slot", "tx_index", "signature", "list_order")
    if len(signatures) > source.BROADCAST_SIGNATURES:
        return normalize.transactions(blocks, None).join(positions, ["slot", "tx_index", "signature"])
    size = source.bucket_size_of(blocks, bucket_size)
    held = positions.limit(MAX_LISTED_BUCKETS + 1).collect()
    if len(held) > MAX_LISTED_BUCKETS:
        low, high = positions.agg(F.min("slot"), F.max("slot")).first()
        return normalize.transactions(source.prune_buckets(blocks, low, high, size), None).join(positions, ["slot", "tx_index", "signature"])
    known = F.broadcast(spark.createDataFrame(held, positions.schema))
    near = blocks.where(F.col("slot").isin(sorted({r["slot"] for r in held})))
    if size is not None:
        near = near.where(F.col("slot_bucket").isin(sorted({r["slot"] // size for r in held})))
    return normalize.transactions(near, None).join(known, ["slot", "tx_index", "signature"])


def select_transactions(
    blocks: DataFrame, program: Program, request: BatchRequest, saved: int | None, *, bucket_size: int | None = None
) -> tuple[DataFrame, CommitOptions] | None:
    """Transactions of a request and the order they count in; None when a range is already done."""
    if request.signatures:
        return listed_transactions(blocks, list(request.signatures), bucket_size), CommitOptions(order="list_order")
    if request.start_slot is not None and request.end_slot is not None:
        start = source.resume_slot(saved, request.start_slot, request.end_slot)
        if start is None:
            return None
        ranged = source.prune_buckets(blocks, start, request.end_slot, bucket_size)
        return normalize.transactions(ranged, program.program_id), CommitOptions(slot_checkpoint=request.end_slot)
    newest = newest_signatures(blocks, program.program_id, request.batch_size)
    # At most ``batch_size`` positions decide which blocks are read in full.
    oldest = newest.agg(F.min("slot").alias("slot")).first()["slot"]
    recent = source.prune_buckets(blocks, oldest, None, bucket_size) if oldest is not None else blocks.where(F.lit(False))
    txs = normalize.transactions(recent, program.program_id)
    wanted = newest.select("slot", "tx_index")
    if request.batch_size <= source.BROADCAST_SIGNATURES:
        wanted = F.broadcast(wanted)
    return txs.join(wanted, ["slot", "tx_index"], "left_semi"), CommitOptions(newest_first=True)


def chunks(start: int, end: int, slots: int | None) -> Iterator[tuple[int, int]]:
    """Inclusive stretches of a slot range."""
    step = slots or end - start + 1
    for low in range(start, end + 1, step):
        yield low, min(low + step - 1, end)


def run_batch(
    store: IndexStore,
    program: Program,
    blocks: DataFrame,
    request: BatchRequest = BatchRequest(),
    *,
    snapshots: DataFrame | None = None,
    writer: str = "batch",
    options: CommitOptions = CommitOptions(),
    bucket_size: int | None = None,
) -> CommitResult | None:
    """Index what the request selects; None when the range was already indexed.

    A range is one commit, or with ``chunk_slots`` one for every chunk, also
    the empty ones, each with its slot checkpoint; the last one is returned. A
    run that fails starts over after the last committed chunk.
    """
    ranged = not request.signatures and request.start_slot is not None and request.end_slot is not None
    if ranged and request.chunk_slots:
        start = source.resume_slot(saved_slot(store), request.start_slot, request.end_slot)
        result = None
        for low, high in chunks(start, request.end_slot, request.chunk_slots) if start is not None else ():
            part = replace(request, start_slot=low, end_slot=high, chunk_slots=None)
            result = run_batch(store, program, blocks, part, snapshots=snapshots, writer=writer, options=options, bucket_size=bucket_size)
        return result
    selected = select_transactions(blocks, program, request, saved_slot(store), bucket_size=bucket_size)
    if selected is None:
        return None
    txs, mode = selected
    merged = replace(
        options, newest_first=mode.newest_first, order=mode.order,
        slot_checkpoint=mode.slot_checkpoint if mode.slot_checkpoint is not None else options.slot_checkpoint,
    )
    return commit_batch(
        store, program, txs, writer=writer, batch_id=store.next_batch_id(writer), snapshots=snapshots, options=merged
    )


def backfill(
    store: IndexStore, program: Program, blocks: DataFrame, *,
    snapshots: DataFrame | None = None, writer: str = "backfill", options: CommitOptions = CommitOptions(),
    bucket_size: int | None = None,
) -> CommitResult | None:
    """Index everything newer than the saved signature; None when there is no checkpoint.

    The index knows the slot of the saved signature from its keys; it narrows
    the search for the checkpoint's position and the blocks read after it. A signature the blocks do not hold means everything.
    """
    state = store.load()
    signature = state.values.get(LAST_SIG_KEY)
    if signature is None:
        return None
    slots = store.locate(state, "transactions", signature)
    if slots is None:
        stored = store.read("transactions", TRANSACTION_SCHEMA, state=state).where(F.col("signature") == signature)
        slots = [r["slot"] for r in stored.select("slot").limit(1).collect()]
    # The checkpoint may be a listed transaction that does not mention the program.
    near = source.prune_buckets(blocks, slots[0], slots[0], bucket_size) if slots else blocks
    position = source.position_of(source.program_signatures(near, None), signature)
    if position is None:
        fresh = normalize.transactions(blocks, program.program_id)
    else:
        newer = source.prune_buckets(blocks, position[0], None, bucket_size)
        fresh = source.since(normalize.transactions(newer, program.program_id), position)
    return commit_batch(
        store, program, fresh, writer=writer, batch_id=store.next_batch_id(writer), snapshots=snapshots, options=options
    )

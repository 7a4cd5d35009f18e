"""Index a live feed of blocks.

The stream only carries blocks; each micro-batch goes through the same
transformations and the same commit as a batch run. Duplicates are absorbed by
the commit, so there is no watermark and no late row is lost. The stream's
checkpoint is the cursor: a micro-batch repeated after a failure has the same
id and input, so it replaces what an unfinished attempt left and is skipped if
the attempt had finished. Each checkpoint writes under its own writer name, so
a stream started over with a new one never touches earlier batches.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize
from ..operators.registry import Program
from ..plans.commit import CommitOptions, commit_batch, stage_transactions
from ..plans.jobs import backfill
from ..plans.store import IndexStore
from ..session import Staging, list_folders
from ..sources.blocks import block_schema

# Flush interval of a micro-batch.
FLUSH_INTERVAL = "5 seconds"
# Commits a micro-batch can be cut into; their ids are the micro-batch's times this, and up.
MOST_COMMITS = 1 << 20


def stream_blocks(spark: SparkSession, path: str, fmt: str = "json", *, max_files: int | None = None, **options: str) -> DataFrame:
    """Blocks from files as they arrive; ``max_files`` bounds a micro-batch."""
    reader = spark.readStream.schema(block_schema()).format(fmt)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.options(**options).load(path)


def blocks_from_values(records: DataFrame, column: str = "value") -> DataFrame:
    """Blocks from a message stream (such as Kafka's ``value``) holding one JSON block each."""
    return records.select(F.from_json(F.col(column).cast("string"), block_schema()).alias("b")).select("b.*")


def writer_name(spark: SparkSession, name: str, checkpoint: str) -> str:
    """Writer of a stream: the id Spark keeps in its checkpoint tells restarts from new streams."""
    metadata = spark.read.text(f"{checkpoint}/metadata").first()["value"]
    return f"{name}-{json.loads(metadata)['id'][:8]}"


def slot_stretches(txs: DataFrame, max_rows: int) -> Iterator[tuple[int, int]]:
    """Stretches of slots, oldest first, with at most ``max_rows`` transactions each; a fuller slot stands alone.

    The driver walks over the counts per slot and keeps none of them.
    """
    low = high = None
    held = 0
    for slot, count in txs.groupBy("slot").count().orderBy("slot").toLocalIterator():
        if low is not None and held + count > max_rows:
            yield low, high
            low, held = None, 0
        low, high, held = slot if low is None else low, slot, held + count
    if low is not None:
        yield low, high


def commit_stretches(
    store: IndexStore, program: Program, txs: DataFrame, max_rows: int, *, writer: str, batch_id: int, snapshots: DataFrame | None, options: CommitOptions
) -> None:
    """Commit a micro-batch in stretches of slots; those committed before it was repeated are passed over.

    Stretches depend on the micro-batch's rows only, so a repeated one is cut in the same places.
    """
    with Staging(store.spark, f"stretches-{writer}-{batch_id}", store.root) as staging:
        staged = stage_transactions(txs, staging)
        done = store.load().committed.get(writer, -1)
        for k, (low, high) in enumerate(slot_stretches(staged, max_rows)):
            if k == MOST_COMMITS:
                raise ValueError(f"a micro-batch needs more than {MOST_COMMITS} commits of {max_rows} rows")
            number = batch_id * MOST_COMMITS + k
            if number > done:
                commit_batch(
                    store, program, staged.where(F.col("slot").between(low, high)), writer=writer, batch_id=number, snapshots=snapshots, options=options
                )


def start_index_stream(
    blocks: DataFrame,
    store: IndexStore,
    program: Program,
    checkpoint: str,
    *,
    name: str = "live",
    snapshots: DataFrame | None = None,
    options: CommitOptions = CommitOptions(),
    after_slot: int | None = None,
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
    max_rows: int | None = None,
) -> StreamingQuery:
    """Start indexing a block stream; its writer name is ``name`` and the start of the stream's id.

    ``available_now`` works off what is there and stops; otherwise a
    micro-batch runs every ``interval``, or sooner ones follow each other when
    the source is ahead. ``after_slot`` starts from a known tip. ``max_rows``
    bounds the transactions of a commit: a fuller micro-batch becomes several
    commits of consecutive slots, each with its own checkpoint.
    """
    if after_slot is not None:
        blocks = blocks.where(F.col("slot") > after_slot)

    def index(batch: DataFrame, batch_id: int) -> None:
        writer = writer_name(store.spark, name, checkpoint)
        done = store.load().committed.get(writer, -1)
        txs = normalize.transactions(batch, program.program_id)
        if max_rows is not None:
            commit_stretches(store, program, txs, max_rows, writer=writer, batch_id=batch_id, snapshots=snapshots, options=options)
            return
        number = batch_id
        if done >= MOST_COMMITS:
            # Cut into stretches before. This micro-batch may be stored in part: what is there stays as it is.
            number = max(batch_id * MOST_COMMITS, done + 1) if done < (batch_id + 1) * MOST_COMMITS else done
        if number > done:
            commit_batch(store, program, txs, writer=writer, batch_id=number, snapshots=snapshots, options=options)

    writer = blocks.writeStream.queryName(f"slotscribe-{name}").foreachBatch(index).option("checkpointLocation", checkpoint)
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def catch_up_then_follow(
    history: DataFrame,
    live: DataFrame,
    store: IndexStore,
    program: Program,
    checkpoint: str,
    *,
    bucket_size: int | None = None,
    **stream_options,
) -> StreamingQuery:
    """Backfill from the saved signature, then follow the live feed, both with the same snapshots and options.

    Without a saved signature nothing is backfilled: indexing starts at the
    newest slot that ``history`` holds.
    """
    done = backfill(
        store, program, history, snapshots=stream_options.get("snapshots"),
        options=stream_options.get("options", CommitOptions()), bucket_size=bucket_size,
    )
    if done is None and not store.load().committed:
        tip = history.agg(F.max("slot").alias("slot")).first()["slot"]
        stream_options.setdefault("after_slot", tip)
    return start_index_stream(live, store, program, checkpoint, **stream_options)


def live_time_series(calls: DataFrame, time_col: str, bucket: str = "hour") -> DataFrame:
    """Calls per bucket as a streaming aggregation for ``complete`` or ``update`` output.

    State grows with the number of buckets only. There is no watermark, so late
    calls still count.
    """
    period = F.date_trunc(bucket, F.col(time_col)).cast(calls.schema[time_col].dataType)
    return calls.groupBy(period.alias("period")).agg(F.count(F.lit(1)).alias("calls"))


def start_series_stream(
    calls: DataFrame,
    folder: str,
    checkpoint: str,
    *,
    time_col: str,
    bucket: str = "hour",
    group: str = "ix_name",
    delay: str = "1 hour",
    available_now: bool = False,
    interval: str = FLUSH_INTERVAL,
) -> StreamingQuery:
    """Keep the calls per ``group`` and period of a stream as a table of counts below ``folder``.

    A micro-batch adds its own counts, so no state is held however long the
    stream runs, and a repeated one replaces what it wrote. The watermark is the
    newest time of all earlier micro-batches less ``delay``; calls of a period
    that had ended by then are stored as late, not lost. A NULL time has the
    period NULL and is never late.
    """
    spark = calls.sparkSession

    def add(batch: DataFrame, batch_id: int) -> None:
        late = _ended(bucket, _newest(spark, folder, batch_id), delay)
        period = F.date_trunc(bucket, F.col(time_col)).cast(calls.schema[time_col].dataType)
        counted = batch.groupBy(F.col(group), period.alias("period")).agg(F.count(F.lit(1)).alias("calls"), F.max(time_col).alias("newest"))
        counted.withColumn("late", late).write.mode("overwrite").parquet(f"{folder}/batch_id={batch_id}")

    writer = calls.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint)
    return writer.trigger(**({"availableNow": True} if available_now else {"processingTime": interval})).start()


def _newest(spark: SparkSession, folder: str, before: int | None = None) -> F.Column | None:
    """Newest time among the counts below ``folder``, of micro-batches before one; None without any."""
    if not list_folders(spark, folder):
        return None
    held = spark.read.parquet(folder)
    newest = (held if before is None else held.where(F.col("batch_id") < before)).agg(F.max("newest").cast("string")).first()[0]
    return None if newest is None else F.lit(newest).cast(held.schema["newest"].dataType)


def _ended(bucket: str, newest: F.Column | None, delay: str) -> F.Column:
    """Whether a period had ended by the watermark, which is the newest time less ``delay``."""
    if newest is None:
        return F.lit(False)
    return F.coalesce(F.col("period") + F.expr(f"interval 1 {bucket}") <= newest - F.expr(f"interval {delay}"), F.lit(False))


def series_counts(spark: SparkSession, folder: str, *, bucket: str = "hour", group: str = "ix_name", delay: str = "1 hour") -> DataFrame:
    """(group, period, calls, late_calls, closed): what the stream has counted so far.

    ``calls`` holds the late ones too. ``closed`` periods ended before the
    watermark: only late calls can still be added to them.
    """
    sums = spark.read.parquet(folder).groupBy(group, "period").agg(
        F.sum("calls").alias("calls"), F.sum(F.when(F.col("late"), F.col("calls")).otherwise(0)).alias("late_calls")
    )
    return sums.withColumn("closed", _ended(bucket, _newest(spark, folder), delay))

import json

import pytest
from pyspark.sql import functions as F

import chain
from slotscribe.operators.registry import program_from_json
from slotscribe.plans.jobs import BatchRequest, run_batch
from slotscribe.plans.reader import IndexReader
from slotscribe.plans.store import IndexStore
from slotscribe.streaming.live import (
    blocks_from_values, catch_up_then_follow, live_time_series, series_counts, start_index_stream, start_series_stream, stream_blocks, writer_name,
)


@pytest.fixture(scope="module")
def program(spark):
    return program_from_json(spark, chain.PROGRAM, json.dumps(chain.IDL))


def feed(folder, blocks, name):
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("\n".join(json.dumps(b) for b in blocks))


def signatures(reader):
    return sorted(r["signature"] for r in reader.transactions().collect())


def test_stream_equals_batch_and_replay_changes_nothing(spark, program, tmp_path):
    blocks = chain.sample_blocks(range(100, 108))
    feed(tmp_path / "in", blocks[:3], "a.json")
    feed(tmp_path / "in", blocks[2:], "b.json")  # one block comes twice
    store = IndexStore(spark, str(tmp_path / "live"))
    source = stream_blocks(spark, str(tmp_path / "in"), max_files=1)
    for checkpoint in ("c1", "c2"):  # the second stream starts over and reads the whole feed again
        query = start_index_stream(source, store, program, str(tmp_path / checkpoint), available_now=True)
        assert query.awaitTermination(240)
    batch = IndexStore(spark, str(tmp_path / "batch"))
    run_batch(batch, program, chain.blocks_df(spark, blocks), BatchRequest(start_slot=100, end_slot=107))
    live, ref = IndexReader(store, program), IndexReader(batch, program)
    assert signatures(live) == signatures(ref) and len(signatures(live)) == len(set(signatures(live)))
    a, b = live.stats().first(), ref.stats().first()
    assert a["ix_call_counts"] == b["ix_call_counts"] and a["last_checkpoint"] == b["last_checkpoint"]
    first, second = (writer_name(spark, "live", str(tmp_path / c)) for c in ("c1", "c2"))
    assert store.load().committed == {first: 1, second: 1}
    assert {r["writer"] for r in live.transactions().select("writer").distinct().collect()} == {first}


def test_catch_up_then_follow(spark, program, tmp_path):
    blocks = chain.sample_blocks(range(100, 106))
    history = chain.blocks_df(spark, blocks[:4])
    store = IndexStore(spark, str(tmp_path / "i"))
    feed(tmp_path / "in", blocks[3:], "a.json")
    live = stream_blocks(spark, str(tmp_path / "in"))
    # First start without a checkpoint: from the tip of the history, no backfill.
    query = catch_up_then_follow(history, live, store, program, str(tmp_path / "c"), available_now=True)
    assert query.awaitTermination(240)
    reader = IndexReader(store, program)
    tip = blocks[3]["slot"]
    assert {r["slot"] for r in reader.transactions().select("slot").distinct().collect()} == {b["slot"] for b in blocks if b["slot"] > tip}
    # A later start with a checkpoint backfills what the history gained since.
    more = chain.blocks_df(spark, chain.sample_blocks(range(100, 109)))
    query = catch_up_then_follow(more, live, store, program, str(tmp_path / "c"), available_now=True)
    assert query.awaitTermination(240)
    assert reader.transactions().agg(F.max("slot")).first()[0] == 107
    assert len(signatures(reader)) == len(set(signatures(reader)))


def test_catch_up_passes_options_on(spark, program, tmp_path):
    from slotscribe.plans.commit import CommitOptions

    blocks = chain.sample_blocks(range(100, 106))
    store = IndexStore(spark, str(tmp_path / "i"))
    options = CommitOptions(call_key=("tx_sig",))
    run_batch(store, program, chain.blocks_df(spark, blocks[:1]), BatchRequest(start_slot=100, end_slot=100), options=options)
    feed(tmp_path / "in", blocks[3:], "a.json")
    live = stream_blocks(spark, str(tmp_path / "in"))
    query = catch_up_then_follow(
        chain.blocks_df(spark, blocks[:4]), live, store, program, str(tmp_path / "c"), available_now=True, options=options
    )
    assert query.awaitTermination(240)
    calls = IndexReader(store, program).call_table("buy")
    assert calls.count() == calls.select("tx_sig").distinct().count() > 0
    assert {r["slot"] for r in calls.select("slot").distinct().collect()} == {b["slot"] for b in blocks}


def test_blocks_from_messages(spark):
    block = chain.sample_blocks(range(100, 101))[0]
    got = blocks_from_values(spark.createDataFrame([(json.dumps(block).encode(),)], "value binary")).first()
    assert got["slot"] == 100 and len(got["transactions"]) == len(block["transactions"])


def test_live_series_complete_mode_counts_late_rows(spark, tmp_path):
    folder = tmp_path / "calls"
    folder.mkdir()
    for i, hours in enumerate(([3, 4, 4], [1, 1, 4])):
        (folder / f"{i}.json").write_text("\n".join(json.dumps({"ts": f"2024-01-01 {h:02d}:30:00"}) for h in hours))
    calls = spark.readStream.schema("ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
    query = live_time_series(calls, "ts").writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    assert query.awaitTermination(240)
    got = {str(r["period"])[11:13]: r["calls"] for r in spark.table("late").collect()}
    assert got == {"01": 2, "03": 1, "04": 3}


def test_series_stream_keeps_late_calls_apart(spark, tmp_path):
    import os
    import shutil

    folder = tmp_path / "calls"
    folder.mkdir()
    # The watermark stands at 03:30 for the second and third micro-batch and at 05:30 after the third.
    for i, hours in enumerate(([3, 4, 4], [1, 1, 4, None], [1, 3, 6])):
        rows = [{"ix_name": "buy", "ts": h and f"2024-01-01 {h:02d}:30:00"} for h in hours]
        (folder / f"{i}.json").write_text("\n".join(map(json.dumps, rows)))
        os.utime(folder / f"{i}.json", (1_700_000_000 + i, 1_700_000_000 + i))
    out, checkpoint = str(tmp_path / "series"), tmp_path / "c"

    def run():
        calls = spark.readStream.schema("ix_name string, ts timestamp").option("maxFilesPerTrigger", 1).json(str(folder))
        assert start_series_stream(calls, out, str(checkpoint), time_col="ts", available_now=True).awaitTermination(240)
        return {r["period"] and r["period"].hour: (r["calls"], r["late_calls"], r["closed"]) for r in series_counts(spark, out).collect()}

    want = {None: (1, 0, False), 1: (3, 3, True), 3: (2, 0, True), 4: (3, 0, True), 6: (1, 0, False)}
    assert run() == want
    shutil.rmtree(checkpoint / "commits")  # as if the stream had stopped right after the counts were written
    shutil.rmtree(tmp_path / "series" / "batch_id=2")
    assert run() == want
    assert run() == want


def test_repeated_micro_batch_is_skipped(spark, program, tmp_path):
    import shutil

    blocks = chain.sample_blocks(range(100, 104))
    feed(tmp_path / "in", blocks, "a.json")
    store = IndexStore(spark, str(tmp_path / "i"))
    checkpoint = tmp_path / "c"
    source = stream_blocks(spark, str(tmp_path / "in"))
    assert start_index_stream(source, store, program, str(checkpoint), available_now=True).awaitTermination(240)
    before = sorted(map(repr, IndexReader(store, program).transactions().collect()))
    shutil.rmtree(checkpoint / "commits")  # as if the stream had stopped right after the index was written
    assert start_index_stream(source, store, program, str(checkpoint), available_now=True).awaitTermination(240)
    assert sorted(map(repr, IndexReader(store, program).transactions().collect())) == before


def commits(store):
    zones = store.zones(store.load()).where("indexed = 'transactions'").groupBy("batch_id").agg(F.sum("rows").alias("n"), F.countDistinct("min_slot").alias("slots"))
    return {r["batch_id"]: r["n"] for r in zones.collect()}


def test_commits_are_bounded_by_rows_and_restart_between_them(spark, program, tmp_path, monkeypatch):
    from slotscribe.streaming import live

    blocks = chain.sample_blocks(range(100, 112))  # two transactions of the program a slot, three in some
    feed(tmp_path / "in", blocks[:6], "a.json")
    store = IndexStore(spark, str(tmp_path / "i"), key_buckets=2)
    source = stream_blocks(spark, str(tmp_path / "in"), max_files=1)
    run = lambda **options: start_index_stream(source, store, program, str(tmp_path / "c"), available_now=True, **options).awaitTermination(240)
    done, commit = [], live.commit_batch

    def failing(*a, **k):
        if len(done) == 2:
            raise RuntimeError("stopped")
        done.append(k["batch_id"])
        return commit(*a, **k)

    monkeypatch.setattr(live, "commit_batch", failing)
    with pytest.raises(Exception, match="stopped"):
        run(max_rows=5)
    assert len(commits(store)) == 2
    monkeypatch.setattr(live, "commit_batch", lambda *a, **k: (done.append(k["batch_id"]), commit(*a, **k))[1])
    run(max_rows=5)
    assert done == sorted(set(done)), "no commit is made twice"
    feed(tmp_path / "in", blocks[6:], "b.json")
    run(max_rows=1)  # a slot is never cut
    run()
    held = commits(store)
    per_slot = {b["slot"]: sum(chain.PROGRAM in t["account_keys"] for t in b["transactions"]) for b in blocks}
    first = [n for b, n in sorted(held.items()) if b < live.MOST_COMMITS]
    assert all(n <= 5 for n in first) and sum(first) == sum(per_slot[b["slot"]] for b in blocks[:6])
    assert [n for b, n in sorted(held.items()) if b >= live.MOST_COMMITS] == [per_slot[b["slot"]] for b in blocks[6:]]
    assert len(signatures(IndexReader(store, program))) == sum(per_slot.values())


def test_sample_stream_reads_the_stored_blocks(spark, tmp_path, monkeypatch):
    """The live feed is a part of the block table; it is not written a second time."""
    from slotscribe.plans import catalog

    rows = [(k, k % 9, k % 7, k % 4 + 1, float(k % 50), k + 0.25, "ANR"[k % 3], "OF"[k % 2], 9_200 + k * 7 % 1_200) for k in range(120)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, slot int"
    lines = spark.createDataFrame(rows, names).select("*", F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot")).cast("timestamp").alias("l_shipdate"))
    lines.drop("slot").write.parquet(str(tmp_path / "lineitem.parquet"))
    written, write = [], catalog.source.write_blocks
    monkeypatch.setattr(catalog.source, "write_blocks", lambda *a, **k: (written.append(a[1]), write(*a, **k))[1])
    stats = catalog.queries()["stream_catch_up"](spark, str(tmp_path)).first()
    open_slots = [r[-1] for r in rows if r[7] == "O"]
    # Slots up to 9400 by the run, up to 10000 by the backfill, from 9500 on by the stream.
    assert stats["total_transactions"] == stats["total_ix_calls"] == len(open_slots)
    assert (stats["first_indexed_slot"], stats["last_indexed_slot"]) == (min(open_slots), max(open_slots))
    assert len(written) == 1


def test_commits_of_a_micro_batch_share_what_is_staged(spark, program, tmp_path, monkeypatch):
    from slotscribe.session import Staging

    blocks = chain.sample_blocks(range(100, 106))
    feed(tmp_path / "in", blocks, "a.json")
    store = IndexStore(spark, str(tmp_path / "i"), key_buckets=2)
    staged, put = [], Staging.put
    monkeypatch.setattr(Staging, "put", lambda self, df, name, *a, **k: (staged.append(name), put(self, df, name, *a, **k))[1])
    run = start_index_stream(stream_blocks(spark, str(tmp_path / "in")), store, program, str(tmp_path / "c"), available_now=True, max_rows=5)
    assert run.awaitTermination(240)
    assert len(commits(store)) > 1 and staged.count("transactions") == 1
    wanted = sorted(t["signatures"][0] for b in blocks for t in b["transactions"] if chain.PROGRAM in t["account_keys"])
    assert signatures(IndexReader(store, program)) == wanted


def test_sample_stream_leaves_lines_without_a_slot_out(spark, tmp_path):
    from slotscribe.plans import catalog

    rows = [(k, 1, 1, 1, 5.0, 7.5, "A", "O", None if k % 4 == 0 else 9_200 + k) for k in range(48)]
    names = "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_returnflag string, l_linestatus string, slot int"
    lines = spark.createDataFrame(rows, names).select("*", F.date_add(F.lit("1970-01-01").cast("date"), F.col("slot")).cast("timestamp").alias("l_shipdate"))
    lines.drop("slot").write.parquet(str(tmp_path / "lineitem.parquet"))
    held = catalog.queries()["stream_row_bound"](spark, str(tmp_path)).collect()
    # 36 lines have a slot; a commit holds 16, a third of all 48.
    assert sorted((r["first_slot"], r["transactions"]) for r in held) == [(9_201, 16), (9_222, 16), (9_243, 4)]

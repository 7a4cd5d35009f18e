"""Keys, zones and current states of an index, and what they spare."""

import json
import re
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import chain
from slotscribe.operators import lookups, normalize
from slotscribe.operators.dedup import not_keyed
from slotscribe.operators.lookups import CallFilter
from slotscribe.operators.registry import program_from_json, stated_addresses
from slotscribe.plans import commit as commits
from slotscribe.plans.commit import CommitOptions, commit_batch, rebuild_states
from slotscribe.plans.jobs import BatchRequest, backfill, run_batch
from slotscribe.plans.maintenance import compact_state
from slotscribe.plans.reader import IndexReader
from slotscribe.plans.store import BUCKETS_KEY, IndexStore
from slotscribe.session import Staging


@pytest.fixture(scope="module")
def program(spark):
    return program_from_json(spark, chain.PROGRAM, json.dumps(chain.IDL))


@pytest.fixture()
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), slots_per_bucket=10, key_buckets=4)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def buckets(df):
    """Slot buckets that the scans of a query are limited to."""
    text = df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), "formatted")
    found = [re.search(r"slot_bucket#\d+L? (?:= (\d+)|IN(?:SET)? \(?([\d, ]+))", line) for line in text.split("\n") if line.startswith("PartitionFilters")]
    assert found and all(found), text
    return {n for m in found for n in re.findall(r"\d+", m[1] or m[2])}


def txs(spark, slots=range(100, 130), seed=1):
    return normalize.transactions(chain.blocks_df(spark, chain.sample_blocks(slots, seed)), chain.PROGRAM)


def lockers(spark, names, lamports=11):
    return spark.createDataFrame([(chain.key(n), 5, lamports, chain.locker(lamports)) for n in names], "address string, slot bigint, lamports bigint, data binary")


@pytest.mark.parametrize("few", [0, 100_000])
def test_conflicts_by_key(spark, program, store, monkeypatch, few):
    """Small batches broadcast their keys, large ones join bucket by bucket; both find every stored key."""
    monkeypatch.setattr(commits, "BROADCAST_BATCH", few)
    commit_batch(store, program, txs(spark), writer="a", batch_id=0)
    later = txs(spark, range(100, 140)).withColumn("slot", F.col("slot") + 5_000)
    commit_batch(store, program, later, writer="b", batch_id=0)
    commit_batch(store, program, later, writer="b", batch_id=0)
    reader = IndexReader(store, program)
    rows = {r["signature"]: r["slot"] for r in reader.transactions().collect()}
    assert len(rows) == reader.transactions().count()
    assert all((slot < 5_000) == (int(re.search(r"\d+", s)[0]) < 130) for s, slot in rows.items())
    for name in ("buy", "note"):
        calls = reader.call_table(name)
        assert calls.count() == calls.select("tx_sig", "ix_index").distinct().count()
        assert calls.join(reader.transactions().withColumnRenamed("signature", "tx_sig"), ["tx_sig", "slot"], "left_anti").count() == 0


def test_stored_side_of_a_large_batch_is_not_moved(spark, program, store):
    commit_batch(store, program, txs(spark), writer="a", batch_id=0)
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        new = txs(spark).select("signature", F.lit(1).alias("ix_index"))
        for item in (None, "ix_index"):
            text = plan(not_keyed(new, store.keys(store.load(), "transactions"), "signature", item))
            stored_side = text[text.index("LeftAnti") :].split("\n")
            scan = next(i for i, line in enumerate(stored_side) if "Bucketed: true" in line)
            last_exchange = max(i for i, line in enumerate(stored_side) if "Exchange" in line)
            # The only exchange belongs to the new rows, which come first.
            assert text.count("Exchange hashpartitioning") == 1 and last_exchange < scan
            assert "Exchange" not in "".join(stored_side[last_exchange + 1 : scan + 1])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)


def test_one_key_reads_one_bucket(spark, program, store):
    commit_batch(store, program, txs(spark), writer="a", batch_id=0, snapshots=lockers(spark, ["alice", "bob"]))
    state = store.load()
    text = plan(store.keys(state, "transactions").where(F.col("key") == "sig106a"))
    assert "SelectedBucketsCount: 1 out of 4" in text and "indexed" in text.split("PartitionFilters")[1]
    assert store.locate(state, "transactions", "sig106a") == [106] and store.locate(state, "transactions", "nope") == []
    reader = IndexReader(store, program)
    for found in (reader.transaction("sig106a"), reader.calls("buy", CallFilter(tx_sig="sig106a"))):
        assert found.count() and buckets(found) == {"10"}
    assert reader.transaction("nope").count() == 0 and reader.calls("buy", CallFilter(tx_sig="nope")).count() == 0
    one = reader.account("Locker", chain.key("alice"))
    assert one.first()["slot"] == 100 and buckets(one) == {"10"}


def test_history_reads_its_slots(spark, program, store):
    for n, slot in enumerate((100, 215, 330, 447)):
        block = chain.block(slot, chain.tx(f"s{slot}", [chain.buy(1)], touched=(0,)))
        commit_batch(store, program, normalize.transactions(chain.blocks_df(spark, [block]), chain.PROGRAM), writer="a", batch_id=n, snapshots=lockers(spark, ["alice"], slot))
    reader = IndexReader(store, program)
    history = reader.account_history("Locker", chain.key("alice"), 2)
    assert [(r["slot"], r["lamports"]) for r in history.collect()] == [(447, 447), (330, 330)]
    assert buckets(history) == {"33", "44"}
    assert [r["slot"] for r in reader.account_history("Locker", chain.key("alice")).collect()] == [447, 330, 215, 100]


def test_counts_come_from_zones(spark, program, store):
    commit_batch(store, program, txs(spark), writer="a", batch_id=0)
    commit_batch(store, program, txs(spark, range(110, 150), 2), writer="a", batch_id=1)
    reader = IndexReader(store, program)
    stats = reader.stats()
    assert {f.rpartition("/index/")[2].split("/")[0] for f in stats.inputFiles()} == {"zones"}
    row = stats.first()
    assert row["total_transactions"] == reader.transactions().count()
    assert row["ix_call_counts"] == {f"ix_{n}": reader.call_table(n).count() for n in ("buy", "note")}
    assert reader.call_count("buy").first()["calls"] == reader.call_table("buy").count()
    assert (row["first_indexed_slot"], row["last_indexed_slot"]) == tuple(reader.transactions().agg(F.min("slot"), F.max("slot")).first())


def test_time_ranges_become_folders(spark, program, store):
    commit_batch(store, program, txs(spark, range(100, 160)), writer="a", batch_id=0)
    reader = IndexReader(store, program)
    at = lambda slot: F.timestamp_seconds(F.lit(1_700_000_000 + slot))
    series = reader.time_series("buy", at(111), at(119), "hour", time_col="block_ts")
    assert buckets(series) == {"11"}
    assert sum(r["calls"] for r in series.collect()) == reader.call_table("buy").where("slot between 111 and 119").count()
    page = reader.calls("buy", CallFilter(from_time=at(141), to_time=at(149), limit=500), time_col="block_ts")
    assert buckets(page) == {"14"}
    assert page.count() == reader.call_table("buy").where("slot between 141 and 149").count()
    assert reader.time_series("buy", "1990-01-01", "1991-01-01").collect() == []
    assert sum(r["calls"] for r in reader.time_series("buy").collect()) == reader.call_table("buy").count()


def all_newest(store, program):
    rows = store.read("acc_locker", program.table_schema("account", "acc_locker"))
    newest = lookups.account_rows(lookups.newest_per_account(rows, tie_breaks=("updated_at", "batch_id")))
    return sorted(map(repr, newest.collect()))


def touching(spark, slot, name):
    block = chain.block(slot, chain.tx(f"s{slot}{name}", [chain.buy(1)], touched=(0,), keys=[chain.key(name)]))
    return normalize.transactions(chain.blocks_df(spark, [block]), chain.PROGRAM)


def test_current_states_follow_late_and_unfolded_batches(spark, program, store):
    reader = IndexReader(store, program)
    assert reader.accounts("Locker").count() == 0

    def put(n, slot, name, **options):
        commit_batch(store, program, touching(spark, slot, name), writer="a", batch_id=n, snapshots=lockers(spark, [name], slot), options=CommitOptions(**options))

    def equal(n):
        got = sorted(map(repr, reader.accounts("Locker").collect()))
        assert got == all_newest(store, program) and len(got) == n

    put(0, 500, "alice")
    equal(1)
    put(1, 300, "alice")  # older than what is known
    put(2, 700, "bob")
    equal(2)
    put(3, 900, "alice", fold_states=False)
    put(4, 50, "carol", fold_states=False)
    equal(3)
    put(5, 901, "bob")  # folds the two before it, too
    equal(3)
    before = {p: p.stat().st_mtime_ns for p in Path(store.root, "current").rglob("*.parquet")}
    put(6, 950, "alice")
    now = {p.parent.name for p in Path(store.root, "current").rglob("*.parquet") if p not in before}
    assert len(now) == 1, "one account, one bucket"
    equal(3)
    for p in Path(store.root, "current").rglob("*.parquet"):
        p.unlink()
    rebuild_states(store, {"acc_locker": program.table_schema("account", "acc_locker")})
    equal(3)


def test_index_without_side_tables_goes_on_without(spark, program, store, monkeypatch):
    """An index begun by an earlier version: no number of buckets among its values."""
    write = IndexStore.write_state
    monkeypatch.setattr(IndexStore, "write_state", lambda self, values, *a: write(self, {k: v for k, v in values.items() if k != BUCKETS_KEY}, *a))
    for n, part in enumerate((txs(spark, range(100, 120)), txs(spark))):
        commit_batch(store, program, part, writer="a", batch_id=n, snapshots=lockers(spark, ["alice", "bob"]))
    reader = IndexReader(store, program)
    assert store.load().key_buckets is None
    assert reader.stats().first()["total_transactions"] == reader.transactions().select("signature").distinct().count() == reader.transactions().count()
    assert reader.transaction("sig106a").count() == 1 and reader.accounts("Locker").count() == 2
    assert reader.account("Locker", chain.key("bob")).count() == 1 and reader.call_count("buy").first()["calls"] > 0


def test_state_is_compacted_without_changing(spark, program, store):
    for n in range(6):
        store.write_state({"a": str(n), f"k{n}": "x"}, "w", n)
    store.write_state({"a": "last"}, "v", 3)
    before = store.load()
    assert compact_state(store) == 7 and compact_state(store) == 0
    assert store.load() == before and before.committed == {"w": 5, "v": 3} and before.values["a"] == "last"
    assert len(list(Path(store.root, "state").glob("*.parquet"))) == 1
    store.write_state({"a": "after"}, "w", 6)
    assert store.load().values["a"] == "after" and store.load().committed["w"] == 6


def test_backfill_finds_its_position_by_key(spark, program, store, monkeypatch):
    blocks = chain.blocks_df(spark, chain.sample_blocks())
    run_batch(store, program, blocks, BatchRequest(start_slot=100, end_slot=110))
    read, whole = [], IndexStore.read
    monkeypatch.setattr(IndexStore, "read", lambda self, table, *a, **k: (read.append(table), whole(self, table, *a, **k))[1])
    backfill(store, program, blocks)
    assert "transactions" not in read
    assert IndexReader(store, program).transactions().agg(F.max("slot")).first()[0] == 128


def test_failed_transactions_can_be_left_out(spark, program, store):
    commit_batch(store, program, txs(spark), writer="a", batch_id=0, options=CommitOptions(include_failed=False))
    reader = IndexReader(store, program)
    assert reader.transactions().where("err is not null").count() == 0 < txs(spark).where("err is not null").count()
    assert reader.transactions().count() == txs(spark).where("err is null").select("signature").distinct().count()


def test_seek_pages_equal_offset_pages(spark):
    calls = spark.range(400).selectExpr(
        "concat('t', id % 37) as tx_sig", "cast(id % 3 as int) as ix_index", "id div 11 as slot", "timestamp_seconds(id div 29) as created_at", "id as n"
    )
    order = [c for c, _ in lookups.page_order(calls)]
    last, seen = None, []
    while page := lookups.list_calls(calls, CallFilter(limit=23, after=last)).collect():
        seen += page
        last = tuple(page[-1][c] for c in order)
    whole = lookups.list_calls(calls, CallFilter(limit=1_000)).collect()
    assert [tuple(r[c] for c in order) for r in seen] == [tuple(r[c] for c in order) for r in whole]
    assert "LessThanOrEqual(created_at" in plan(lookups.list_calls(calls.cache(), CallFilter(after=last))) or last
    with pytest.raises(ValueError):
        lookups.list_calls(calls, CallFilter(after=(1,)))


def test_foreign_addresses_are_told(spark):
    docs = spark.createDataFrame(
        [("A", '{"address":"A"}'), ("A", '{"metadata":{"address":"B"}}'), ("A", "{}"), ("A", None)], "program_id string, idl string"
    )
    assert sorted((r["address"] or "", r["accepted"]) for r in stated_addresses(docs).collect()) == [("", True), ("", True), ("A", True), ("B", False)]


def test_only_slots_with_stored_keys_are_compared(spark, program, store, monkeypatch, tmp_path):
    monkeypatch.setattr(commits, "BROADCAST_BATCH", 0)
    commit_batch(store, program, txs(spark), writer="a", batch_id=0)
    state, tables = store.load(), ["transactions", *program.tables("instruction")]
    extra = spark.createDataFrame([("sig106a", None), ("new", None)], "signature string, slot bigint")
    new = txs(spark, range(120, 150)).select("signature", "slot").unionByName(extra)
    with Staging(spark, "t", str(tmp_path)) as staging:
        again = commits.StoredAgain.find(new, store.keys(state, tables), False, staging)
        assert again.count and (again.low, again.high) == (120, 128)
        kept = again.without(new, "transactions", "signature", None)
        assert sorted(map(str, kept.collect())) == sorted(map(str, not_keyed(new, store.keys(state, "transactions"), "signature").collect()))
        found = {r["signature"]: r["slot"] for r in kept.collect()}
        assert found["new"] is None and "sig106a" not in found and all(s is None or s >= 130 for s in found.values())
        # Rows of other slots are beside the join, not in it.
        assert plan(kept).index("Union") < plan(kept).index("LeftAnti")
    later = txs(spark, range(130, 150))
    with Staging(spark, "t", str(tmp_path)) as staging:
        again = commits.StoredAgain.find(later, store.keys(state, tables), False, staging)
        assert again.count == 0 and "Join" not in plan(again.without(later, "transactions", "signature", None))


def test_keys_of_a_large_batch_have_several_files_per_bucket(spark, program, store, monkeypatch):
    from slotscribe.plans import side_tables

    commit_batch(store, program, txs(spark), writer="a", batch_id=0)
    monkeypatch.setattr(side_tables, "BUCKET_TRANSACTIONS", 3)
    commit_batch(store, program, txs(spark, range(120, 160)), writer="b", batch_id=0)
    files = lambda w: len(list(Path(store.root).glob(f"keys/writer={w}/batch_id=0/indexed=transactions/*.parquet")))
    assert files("a") <= 4 < files("b")
    state = store.load()
    assert store.keys(state, "transactions").count() == IndexReader(store, program).transactions().count()
    for slot in (b["slot"] for b in chain.sample_blocks(range(100, 160))):
        assert store.locate(state, "transactions", f"sig{slot}a") == [slot]

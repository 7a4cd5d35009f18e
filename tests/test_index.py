import json

import pytest
from pyspark.sql import functions as F

import chain
from slotscribe.operators import normalize
from slotscribe.operators.lookups import CallFilter
from slotscribe.operators.registry import program_from_json
from slotscribe.plans.commit import CommitOptions, commit_batch, conflict_range
from slotscribe.plans.maintenance import rewrite_index
from slotscribe.plans.jobs import BatchRequest, backfill, newest_signatures, run_batch
from slotscribe.plans.reader import IndexReader
from slotscribe.plans.store import IndexStore
from slotscribe.sources import blocks as source


@pytest.fixture(scope="module")
def program(spark):
    return program_from_json(spark, chain.PROGRAM, json.dumps(chain.IDL))


@pytest.fixture()
def store(spark, tmp_path):
    return IndexStore(spark, str(tmp_path / "index"), slots_per_bucket=10)


def snapshots(spark):
    return spark.createDataFrame(
        [(chain.key("alice"), 50, 11, chain.locker(500)), (chain.key("carol"), 50, 12, chain.locker(1)), (chain.key("bob"), 50, 13, b"\0" * 40)],
        "address string, slot bigint, lamports bigint, data binary",
    )


def signatures(blocks, pid=chain.PROGRAM):
    return [
        (t["signatures"][0], b["slot"], i)
        for b in blocks for i, t in enumerate(b["transactions"]) if pid in t["account_keys"]
    ]


def test_slot_range_run_and_reader(spark, program, store):
    blocks = chain.sample_blocks()
    df = chain.blocks_df(spark, blocks)
    result = run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=140), snapshots=snapshots(spark))
    assert result.checkpoints["last_indexed_slot"] == "140"
    reader = IndexReader(store, program)
    want = signatures(blocks)
    assert sorted(r["signature"] for r in reader.transactions().collect()) == sorted(s for s, _, _ in want)

    stats = reader.stats().first()
    full = [b for b in blocks]
    fives = sum(b["slot"] % 5 == 0 for b in full)
    assert stats["total_transactions"] == len(want)
    assert stats["ix_call_counts"] == {"ix_buy": 2 * len(full), "ix_note": 2 * len(full)}
    assert stats["total_ix_calls"] == 4 * len(full)
    assert (stats["first_indexed_slot"], stats["last_indexed_slot"]) == (100, max(b["slot"] for b in full))
    assert stats["last_checkpoint"] == max((s, i, g) for g, s, i in want)[2]
    assert reader.health()["last_checkpoint"] == stats["last_checkpoint"]

    held = store.read("quarantine", __import__("slotscribe.plans.store", fromlist=["x"]).QUARANTINE_SCHEMA)
    assert held.groupBy("reason", "discriminator_hex").count().count() == 3
    assert held.count() == 3 * fives

    page = reader.calls("buy", CallFilter(from_slot=105, to_slot=106, limit=3)).collect()
    assert len(page) == 3 and {r["slot"] for r in page} <= {105, 106}
    one = reader.calls("buy", CallFilter(tx_sig="sig106a")).collect()
    assert [(r["ix_index"], int(r["amount"]), int(r["max_cost"])) for r in one] == [(1, 106, 1), (2, 107, 1)]
    as_json = json.loads(reader.calls_json("note", CallFilter(tx_sig="sig106a")).first()["row"])
    assert as_json["text"] == "n106" and as_json["ix_index"] == 3
    assert reader.transaction("sig103b").first()["err"] == '{"InstructionError":[0,"Custom"]}'
    assert reader.transaction("nope").count() == 0
    assert reader.call_count("buy").first()["calls"] == 2 * len(full)
    series = reader.time_series("buy", "2000-01-01", "2100-01-01", "day").collect()
    assert sum(r["calls"] for r in series) == 2 * len(full)
    chain_series = reader.time_series("buy", "2000-01-01", "2100-01-01", "hour", time_col="block_ts").collect()
    assert sum(r["calls"] for r in chain_series) == 2 * len(full)
    assert reader.call_stats("buy", bucket="month")["bucket"] == "hour"

    states = reader.accounts("Locker").collect()
    assert [(r["address"], r["slot"], r["lamports"]) for r in states] == [(chain.key("alice"), 100, 11)]
    assert json.loads(states[0]["data"]) == {"units": 500, "sealed": True, "holder": "1" * 32}
    assert reader.account("Locker", chain.key("alice")).count() == 1
    assert reader.account("Locker", chain.key("bob")).count() == 0
    assert reader.account_history("Locker", chain.key("alice")).count() == 1
    with pytest.raises(ValueError):
        reader.accounts("")
    with pytest.raises(ValueError):
        reader.calls("missing")
    assert [i["table_name"] for i in reader.schema()["instructions"]] == ["ix_buy", "ix_note"]


def test_rerun_resume_and_replay_change_nothing(spark, program, store):
    blocks = chain.sample_blocks()
    df = chain.blocks_df(spark, blocks)
    run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=110))
    run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=129))
    assert run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=120)) is None
    reader = IndexReader(store, program)
    want = reader.stats().first()
    assert want["total_transactions"] == len(signatures(blocks))
    # Overlapping batch by another writer, then the same batch id once more.
    txs = normalize.transactions(df, chain.PROGRAM)
    commit_batch(store, program, txs, writer="again", batch_id=0)
    commit_batch(store, program, txs, writer="again", batch_id=0)
    commit_batch(store, program, txs.where("slot < 115"), writer="batch", batch_id=1)
    assert reader.stats().first()["ix_call_counts"] != {}
    keys = reader.call_table("buy").groupBy("tx_sig", "ix_index").count()
    assert keys.where("count > 1").count() == 0


def test_failed_attempt_stays_invisible_and_is_replaced(spark, program, store):
    df = chain.blocks_df(spark, chain.sample_blocks())
    txs = normalize.transactions(df, chain.PROGRAM)
    rows = txs.select("signature", "slot", "block_time", "tx_index", "err", F.current_timestamp().alias("created_at"))
    store.write(rows, "transactions", "batch", 0)
    assert IndexReader(store, program).transactions().count() == 0
    run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=101))
    assert IndexReader(store, program).transactions().count() == 3  # slot 101 holds no block


def test_signature_list_and_latest(spark, program, store):
    blocks = chain.sample_blocks()
    df = chain.blocks_df(spark, blocks)
    listed = source.parse_signature_list(" sig120a, ,sig105b,sig105b,unknown ,other105")
    assert listed == ["sig120a", "sig105b", "sig105b", "unknown", "other105"]
    run_batch(store, program, df, BatchRequest(signatures=tuple(listed), start_slot=1, end_slot=2), snapshots=snapshots(spark))
    reader = IndexReader(store, program)
    assert sorted(r["signature"] for r in reader.transactions().collect()) == ["other105", "sig105b", "sig120a"]
    assert reader.accounts("Locker").first()["slot"] == 120
    run_batch(store, program, df, BatchRequest(batch_size=4), snapshots=snapshots(spark))
    newest = sorted(signatures(blocks), key=lambda r: (r[1], r[2]))[-4:]
    assert {r["signature"] for r in reader.transactions().collect()} == {"other105", "sig105b", "sig120a", *[s for s, _, _ in newest]}
    assert reader.accounts("Locker").first()["slot"] == newest[-1][1]


def test_backfill_takes_only_newer(spark, program, store):
    blocks = chain.sample_blocks()
    df = chain.blocks_df(spark, blocks)
    assert backfill(store, program, df) is None
    run_batch(store, program, df, BatchRequest(signatures=("sig110b",)))
    backfill(store, program, df)
    got = {r["signature"] for r in IndexReader(store, program).transactions().collect()}
    assert got == {s for s, slot, i in signatures(blocks) if (slot, i) >= (110, 1)}


def test_pages_and_progress(spark):
    blocks = chain.sample_blocks()
    sigs = source.program_signatures(chain.blocks_df(spark, blocks), chain.PROGRAM)
    want = sorted(signatures(blocks), key=lambda r: (-r[1], -r[2]))
    page = [(r["signature"], r["slot"], r["tx_index"]) for r in source.signature_page(sigs, 5).collect()]
    assert page == want[:5]
    second = [r["signature"] for r in source.signature_page(sigs, 5, before=page[-1][1:], until=want[8][1:]).collect()]
    assert second == [s for s, _, _ in want[5:8]]
    progress = source.chunk_progress(spark, sigs, 100, 152, 5).orderBy("chunk").collect()
    assert len(progress) == 11 and progress[-1]["slot_end"] == 152 and progress[-1]["found"] == 0
    assert sum(r["found"] for r in progress) == len(want)


@pytest.mark.parametrize("saved,want", [(None, 10), (5, 10), (10, 11), (19, 20), (20, None), (25, None)])
def test_resume_rule(saved, want):
    assert source.resume_slot(saved, 10, 20) == want


def test_parity_key_keeps_one_call_per_transaction(spark, program, store):
    df = chain.blocks_df(spark, chain.sample_blocks())
    run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=129), options=CommitOptions(call_key=("tx_sig",)))
    calls = IndexReader(store, program).call_table("buy")
    assert calls.count() == calls.select("tx_sig").distinct().count()
    assert {r["ix_index"] for r in calls.select("ix_index").distinct().collect()} == {1}


def test_evolution_adds_columns_and_keeps_old_types(spark, program, store):
    df = chain.blocks_df(spark, chain.sample_blocks(range(100, 105)))
    run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=104))
    newer = json.loads(json.dumps(chain.IDL))
    newer["instructions"][0]["args"] = [{"name": "amount", "type": "u64"}, {"name": "low", "type": "u32"}, {"name": "high", "type": "u32"}]
    changed = program_from_json(spark, chain.PROGRAM, json.dumps(newer))
    more = chain.blocks_df(spark, chain.sample_blocks(range(105, 108)))
    run_batch(store, changed, more, BatchRequest(start_slot=105, end_slot=107))
    table = IndexReader(store, changed).call_table("buy")
    assert table.columns[:8] == ["tx_sig", "ix_index", "slot", "block_time", "amount", "max_cost", "decode_issues", "created_at"]
    assert table.where("slot < 105 and low is null and max_cost = 1").count() == table.where("slot < 105").count() > 0
    assert table.where("slot >= 105 and low = 1 and high = 0 and max_cost is null").count() == table.where("slot >= 105").count() > 0


def test_normalise_rules(spark):
    rows = [
        chain.block(
            1,
            chain.tx("no_meta", [chain.buy(1)], meta=False), chain.tx("parsed", [chain.buy(1)], parsed=True), chain.tx(None, [chain.buy(1)]),
            chain.tx("kept", [chain.buy(1)], loaded=(("w1",), ("r1",))),
        )
    ]
    df = chain.blocks_df(spark, rows)
    txs = normalize.transactions(df, chain.PROGRAM).collect()
    assert [(t["signature"], t["tx_index"]) for t in txs] == [("kept", 3)]
    assert txs[0]["accounts"][-2:] == ["w1", "r1"]
    listed = {r["signature"] for r in source.program_signatures(df, chain.PROGRAM).collect()}
    assert listed == {"no_meta", "parsed", "kept"}


def test_block_dump_reader(spark, tmp_path):
    raw = {
        "slot": 5, "blockTime": 9,
        "transactions": [
            {"transaction": {"signatures": ["s1"], "message": {"accountKeys": ["a", chain.PROGRAM], "header": {"numRequiredSignatures": 1, "numReadonlySignedAccounts": 0, "numReadonlyUnsignedAccounts": 1}, "instructions": [{"programIdIndex": 1, "accounts": [0, 1], "data": "2A"}]}}, "meta": {"err": {"Oops": 1}, "loadedAddresses": {"writable": ["w"], "readonly": []}}},
            {"transaction": {"signatures": ["s2"], "message": {"accountKeys": [{"pubkey": chain.PROGRAM, "signer": False}], "instructions": [{"parsed": {}, "program": "x"}]}}, "meta": {"err": None}},
        ],
    }
    (tmp_path / "b.json").write_text(json.dumps(raw))
    df = source.read_dump(spark, str(tmp_path / "b.json"))
    assert [r["signature"] for r in source.program_signatures(df, chain.PROGRAM).collect()] == ["s1", "s2"]
    txs = normalize.transactions(df, chain.PROGRAM).collect()
    assert [t["signature"] for t in txs] == ["s1"] and json.loads(txs[0]["err"]) == {"Oops": 1} and txs[0]["accounts"] == ["a", chain.PROGRAM, "w"]
    assert txs[0]["instructions"][0]["accounts"] == [0, 1]


def test_block_table_round_trip_and_pruning(spark, tmp_path):
    df = chain.blocks_df(spark, chain.sample_blocks())
    path = str(tmp_path / "blocks")
    source.write_blocks(df, path, size=10)
    back = source.prune_buckets(source.read_blocks(spark, path), 105, 112, 10)
    listed = source.program_signatures(back, chain.PROGRAM)
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(slot_bucket" in plan
    assert "instructions" not in plan.split("ReadSchema")[1]
    assert {r["slot"] for r in listed.collect()} == {s for s in range(105, 113) if s % 7 != 3}


def test_snapshots_as_of(spark):
    touches = spark.createDataFrame([("a", 10), ("b", 10)], "address string, slot bigint")
    versions = spark.createDataFrame(
        [("a", 3, 1, b"x"), ("a", 9, 2, b"y"), ("a", 11, 3, b"z"), ("b", 11, 4, b"w")], "address string, slot bigint, lamports bigint, data binary"
    )
    assert [(r["address"], r["slot"], r["lamports"]) for r in normalize.snapshots_as_of(touches, versions).collect()] == [("a", 10, 2)]


def test_versions_of_a_hot_address_are_spread(spark):
    touches = spark.range(50).selectExpr("concat('a', id) as address", "200 + id as slot")
    hot = "case when id % 3 = 0 then 'a7' else concat('a', id % 60) end as address"
    versions = spark.range(3_000).selectExpr(hot, "id as slot", "id * 2 as lamports", "cast('x' as binary) as data")
    for pick in (normalize.snapshots_as_of, normalize.current_snapshots):
        plain, spread = (sorted(tuple(r) for r in pick(touches, versions, spread=s).select("address", "slot", "lamports").collect()) for s in (False, True))
        assert plain == spread and len(plain) == 33
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = normalize._versions(touches, versions, True)
        assert "_part" in joined._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_account_roles(spark):
    df = spark.createDataFrame([(["a", "b", "c", "d"], [0, 1, 2, 3, 9])], "accounts array<string>, idx array<int>").withColumn(
        "header", F.expr("named_struct('num_required_signatures', 2, 'num_readonly_signed', 1, 'num_readonly_unsigned', 1)")
    )
    roles = df.select(normalize.account_roles(F.col("accounts"), F.col("idx"), F.col("header"))).first()[0]
    assert [tuple(r) for r in roles] == [("a", True, True), ("b", True, False), ("c", False, True), ("d", False, False)]


def test_account_keep_last_across_batches(spark, program, store):
    df = chain.blocks_df(spark, [chain.block(7, chain.tx("s7", [chain.buy(1)]))])
    run_batch(store, program, df, BatchRequest(signatures=("s7",)), snapshots=snapshots(spark))
    later = snapshots(spark).withColumn("lamports", F.col("lamports") + 100)
    txs = normalize.transactions(df, chain.PROGRAM)
    commit_batch(store, program, txs, writer="other", batch_id=0, snapshots=later)
    reader = IndexReader(store, program)
    assert [(r["slot"], r["lamports"]) for r in reader.accounts("Locker").collect()] == [(7, 111)]
    assert [(r["slot"], r["lamports"]) for r in reader.account_history("Locker", chain.key("alice")).collect()] == [(7, 111)]
    assert reader.account_table("Locker").count() == 1


def test_latest_reads_buckets_from_the_newest(spark, program, store, tmp_path):
    blocks = chain.sample_blocks()
    path = str(tmp_path / "blocks")
    source.write_blocks(chain.blocks_df(spark, blocks), path, size=5)
    for count in (1, 7, 500):
        got = newest_signatures(source.read_blocks(spark, path), chain.PROGRAM, count).collect()
        want = sorted(signatures(blocks), key=lambda r: (-r[1], -r[2]))[:count]
        assert [(r["signature"], r["slot"], r["tx_index"]) for r in got] == want


def test_conflict_range_lists_near_buckets(spark):
    txs = spark.createDataFrame([(5,), (95,), (96,), (1000,)], "slot bigint")
    near = conflict_range(txs, 10, 7)
    assert near.buckets == [-1, 0, 1, 8, 9, 10, 99, 100] and (near.low, near.high) == (-2, 1007)
    assert conflict_range(txs, 10, None).buckets is None
    assert conflict_range(txs.where("false"), 10, 7).buckets == []


def test_rewriting_keeps_every_answer(spark, program, store, tmp_path):
    blocks = chain.sample_blocks()
    df = chain.blocks_df(spark, blocks)
    for end in (104, 109, 114):
        run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=end), snapshots=snapshots(spark))

    def answers(reader):
        return (
            reader.stats().first(), sorted(map(repr, reader.call_table("buy").select("tx_sig", "ix_index", "amount").collect())),
            sorted(map(repr, reader.accounts("Locker").select("address", "slot", "data").collect())), reader.transaction("sig106a").count(),
        )

    before = answers(IndexReader(store, program))
    target = IndexStore(spark, str(tmp_path / "one"), slots_per_bucket=10, key_buckets=4)
    rewrite_index(IndexReader(store, program), target)
    reader = IndexReader(target, program)
    assert answers(reader) == before == answers(IndexReader(store, program))
    with pytest.raises(ValueError):
        rewrite_index(reader, target)
    # Later and repeated batches still see what was rewritten, and go on from its checkpoint.
    run_batch(target, program, df, BatchRequest(start_slot=100, end_slot=129))
    commit_batch(target, program, normalize.transactions(df, chain.PROGRAM), writer="batch", batch_id=3)
    assert reader.stats().first()["total_transactions"] == len(signatures(blocks))
    assert reader.transactions().select("batch_id", "writer").distinct().count() == 2


def test_staging_is_removed(spark, program, store):
    import os

    folder = f"{store.root}/_staging"
    run_batch(store, program, chain.blocks_df(spark, chain.sample_blocks(range(100, 102))), BatchRequest(start_slot=100, end_slot=101))
    assert not [f for f in os.listdir(folder) if f.startswith("commit-batch-0")]


def test_names_sharing_a_table_keep_their_own_layouts(spark, store):
    idl = {"instructions": [{"name": "doIt", "args": [{"name": "a", "type": "u8"}]}, {"name": "do_it", "args": [{"name": "b", "type": "u16"}]}]}
    shared = program_from_json(spark, chain.PROGRAM, json.dumps(idl))
    one, two = chain.disc("global:doIt") + b"\x05", chain.disc("global:do_it") + b"\x01\x02"
    df = chain.blocks_df(spark, [chain.block(1, chain.tx("s", [one, two]))])
    run_batch(store, shared, df, BatchRequest(start_slot=0, end_slot=5))
    reader = IndexReader(store, shared)
    rows = reader.call_table("doIt").orderBy("ix_index").select("a", "b").collect()
    assert [tuple(r) for r in rows] == [(5, None), (None, 513)]
    assert reader.stats().first()["ix_call_counts"] == {"ix_do_it": 2}


def test_point_lookup_columns_have_bloom_filters(spark, program, store):
    import duckdb

    run_batch(store, program, chain.blocks_df(spark, chain.sample_blocks()), BatchRequest(start_slot=100, end_slot=129))
    for table, column in (("transactions", "signature"), ("ix_buy", "tx_sig")):
        found = duckdb.connect().execute(
            f"select bloom_filter_offset from parquet_metadata('{store.root}/{table}/*/*/*/*.parquet') where path_in_schema = '{column}'"
        ).fetchall()
        # Tasks that start together share one configuration; a rare one misses the column's setting and writes a dictionary.
        assert sum(bool(r[0]) for r in found) >= max(1, len(found) - 1)


def stored(spark, tmp_path, blocks, size=10):
    path = str(tmp_path / "blocks")
    source.write_blocks(chain.blocks_df(spark, blocks), path, size=size)
    return source.read_blocks(spark, path)


def test_bucket_size_comes_from_the_table(spark, program, tmp_path):
    blocks = chain.sample_blocks()
    table = stored(spark, tmp_path, blocks)
    store = IndexStore(spark, str(tmp_path / "index"))
    run_batch(store, program, table, BatchRequest(start_slot=100, end_slot=140))
    assert IndexReader(store, program).transactions().count() == len(signatures(blocks))
    with pytest.raises(ValueError):
        run_batch(store, program, table, BatchRequest(start_slot=100, end_slot=200), bucket_size=7)
    with pytest.raises(ValueError):
        source.write_blocks(table.drop("slot_bucket"), str(tmp_path / "blocks"), size=3, mode="append")
    assert IndexStore(spark, store.root).slots_per_bucket == source.SLOTS_PER_BUCKET
    with pytest.raises(ValueError):
        IndexStore(spark, store.root, slots_per_bucket=10).slots_per_bucket
    # A table that does not say is searched without pruning.
    plain = chain.blocks_df(spark, blocks).withColumn("slot_bucket", F.col("slot") * 0)
    assert source.program_signatures(source.prune_buckets(plain, 105, 106), chain.PROGRAM).count() > 0


def test_conflicts_are_found_anywhere_in_the_table(spark, program, store):
    for slot in (100, 5_000):
        df = chain.blocks_df(spark, [chain.block(slot, chain.tx("twice", [chain.buy(1)]))])
        run_batch(store, program, df, BatchRequest(start_slot=slot, end_slot=slot))
    reader = IndexReader(store, program)
    assert [r["slot"] for r in reader.transactions().collect()] == [100]
    assert [r["slot"] for r in reader.call_table("buy").collect()] == [100]


def test_range_in_chunks_goes_on_after_a_failure(spark, program, tmp_path, monkeypatch):
    blocks = chain.sample_blocks()
    table = stored(spark, tmp_path, blocks)
    store = IndexStore(spark, str(tmp_path / "index"), slots_per_bucket=10)
    request = BatchRequest(start_slot=90, end_slot=139, chunk_slots=10)
    from slotscribe.plans import jobs

    commit, done = jobs.commit_batch, []

    def failing(*args, **kwargs):
        if len(done) == 3:
            raise RuntimeError("lost")
        done.append(kwargs["options"].slot_checkpoint)
        return commit(*args, **kwargs)

    monkeypatch.setattr(jobs, "commit_batch", failing)
    with pytest.raises(RuntimeError):
        run_batch(store, program, table, request)
    assert done == [99, 109, 119] and jobs.saved_slot(store) == 119
    done.clear()
    monkeypatch.setattr(jobs, "commit_batch", lambda *a, **k: (done.append(k["options"].slot_checkpoint), commit(*a, **k))[1])
    assert run_batch(store, program, table, request).checkpoints["last_indexed_slot"] == "139"
    assert done == [129, 139]
    assert run_batch(store, program, table, request) is None
    assert sorted(r["signature"] for r in IndexReader(store, program).transactions().collect()) == sorted(s for s, _, _ in signatures(blocks))


def test_arguments_may_have_any_name(spark, store):
    names = ["target", "discriminator", "touched", "txIndex", "entryName", "tableName", "listOrder", "data", "accounts", "slotBucket", "txSig", "_rn"]
    idl = {"instructions": [{"name": "odd", "args": [{"name": n, "type": "u8"} for n in names]}], "accounts": []}
    odd = program_from_json(spark, chain.PROGRAM, json.dumps(idl))
    payload = chain.disc("global:odd") + bytes(range(1, len(names) + 1))
    df = chain.blocks_df(spark, [chain.block(1, chain.tx("s", [payload]))])
    run_batch(store, odd, df, BatchRequest(start_slot=0, end_slot=5))
    run_batch(store, odd, df, BatchRequest(signatures=("s",)), writer="again")
    row = IndexReader(store, odd).call_table("odd").collect()
    assert len(row) == 1
    columns = [f.column for f in odd.instructions[0].fields]
    assert [row[0][c] for c in columns] == list(range(1, len(names) + 1))


def test_dropped_argument_named_like_an_ingest_time(spark, store):
    def version(args):
        return program_from_json(spark, chain.PROGRAM, json.dumps({"instructions": [{"name": "odd", "args": args}]}))

    one = version([{"name": "a", "type": "u8"}, {"name": "updatedAt", "type": "i64"}])
    two = version([{"name": "a", "type": "u8"}])
    payload = chain.disc("global:odd") + b"\x05" + (77).to_bytes(8, "little")
    for n, program in enumerate((one, two)):
        df = chain.blocks_df(spark, [chain.block(n, chain.tx(f"s{n}", [payload]))])
        run_batch(store, program, df, BatchRequest(start_slot=n, end_slot=n))
    rows = IndexReader(store, two).call_table("odd").orderBy("slot").select("a", "updated_at").collect()
    assert [tuple(r) for r in rows] == [(5, 77), (5, None)]


def test_rows_of_a_batch_share_their_ingest_time(spark, program, store):
    run_batch(store, program, chain.blocks_df(spark, chain.sample_blocks()), BatchRequest(start_slot=100, end_slot=140), snapshots=snapshots(spark))
    reader = IndexReader(store, program)
    times = {r[0] for df in (reader.transactions(), reader.call_table("buy"), reader.call_table("note")) for r in df.select("created_at").distinct().collect()}
    times |= {r[0] for r in reader.account_table("Locker").select("updated_at").collect()}
    assert len(times) == 1


def test_tables_without_rows_start_no_job(spark, program, store, monkeypatch):
    written = []
    write = IndexStore.write
    monkeypatch.setattr(IndexStore, "write", lambda self, df, table, *a, **k: (written.append(table), write(self, df, table, *a, **k))[1])
    df = chain.blocks_df(spark, [chain.block(1, chain.tx("s", [chain.buy(1)]))])
    run_batch(store, program, df, BatchRequest(start_slot=0, end_slot=5))
    assert sorted(written) == ["ix_buy", "transactions"]
    assert IndexReader(store, program).stats().first()["ix_call_counts"] == {"ix_buy": 1, "ix_note": 0}


def test_limits_are_honoured(spark):
    from slotscribe.operators import lookups

    calls = spark.range(3_000).selectExpr("cast(id as string) as tx_sig", "0 as ix_index", "id as slot", "timestamp_seconds(id) as created_at")
    assert lookups.list_calls(calls, CallFilter(limit=2_500)).count() == 2_500
    assert lookups.list_calls(calls, CallFilter(limit=2_500), most=1_000).count() == 1_000
    states = spark.range(300).selectExpr("'a' as address", "id as slot")
    assert lookups.account_history(states, "a", 250).count() == 250 and lookups.account_history(states, "a").count() == 20


def test_index_reads_are_pruned(spark, program, store):
    run_batch(store, program, chain.blocks_df(spark, chain.sample_blocks()), BatchRequest(start_slot=100, end_slot=140))
    reader = IndexReader(store, program)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    page = plan(reader.calls("buy", CallFilter(from_slot=105, to_slot=112)))
    assert "slot_bucket" in page.split("PartitionFilters")[1].split("PushedFilters")[0]
    lookup = plan(reader.transaction("sig106a", slot=106))
    assert "slot_bucket" in lookup.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert reader.transaction("sig106a", slot=106).count() == 1 and reader.transaction("sig106a", slot=125).count() == 0
    series = plan(reader.time_series("buy", "2023-11-01", "2023-12-01", "day", time_col="block_ts"))
    pushed = series.split("PushedFilters")[1]
    assert "GreaterThanOrEqual(block_time" in pushed and "LessThanOrEqual(block_time" in pushed


def test_narrow_rows_are_dealt_out_before_they_are_widened(spark, tmp_path):
    from pyspark.sql import types as T

    narrow = spark.createDataFrame([(s, f"sig{s}-{k}") for s in (25, 3, 14, 3, None) for k in range(3)], "slot bigint, signature string")

    def widen(rows):
        tx = F.struct(F.array("signature").alias("signatures"), *[F.lit(None).cast(f.dataType).alias(f.name) for f in source.block_schema()["transactions"].dataType.elementType.fields[1:]])
        kept = [c for c in ("slot_bucket",) if c in rows.columns]
        return rows.select("slot", F.col("slot").alias("block_time"), F.array(tx).alias("transactions"), *kept)

    source.write_blocks(narrow, str(tmp_path / "a"), size=10, widen=widen)
    source.write_blocks(widen(narrow), str(tmp_path / "b"), size=10)
    a, b = (source.read_blocks(spark, str(tmp_path / n)) for n in "ab")
    assert a.schema == b.schema and a.schema["slot"].dataType == T.LongType()
    assert a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty() and a.count() == 15


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_first_transactions_are_found_without_moving_whole_ones(spark, program, tmp_path, monkeypatch, most):
    from slotscribe.plans import commit
    from slotscribe.session import Staging

    monkeypatch.setattr(commit, "BROADCAST_REPEATED", most)
    blocks = [chain.block(s, *[chain.tx(g, [chain.buy(s)]) for g in ("hot", f"once{s}", "hot")]) for s in (5, 2, 9)]
    txs = normalize.transactions(chain.blocks_df(spark, blocks), chain.PROGRAM)
    listed = txs.withColumn("list_order", F.when(F.col("slot") == 9, 0).otherwise(F.col("slot")))
    for rows, order, want in (
        (txs, ["slot", "tx_index"], (2, 0)), (txs, [F.desc("slot"), F.desc("tx_index")], (9, 2)), (listed, ["list_order", "slot", "tx_index"], (9, 0)),
    ):
        with Staging(spark, "t", str(tmp_path)) as staging:
            first = commit.first_per_signature(rows, order, staging)
            found = {r["signature"]: (r["slot"], r["tx_index"]) for r in first.collect()}
            assert first.count() == 4 and found["hot"] == want and {found[f"once{s}"] for s in (2, 5, 9)} == {(2, 1), (5, 1), (9, 1)}
            assert set(first.columns) == set(rows.columns) - {"header"}
            # Counting and comparing move narrow rows; whole ones stay in the files they were staged in.
            if most:
                plan = first._jdf.queryExecution().executedPlan().toString()
                assert "hashpartitioning" not in plan and "BroadcastHashJoin" in plan


def test_buckets_follow_the_first_batch(spark, program, tmp_path, monkeypatch):
    from slotscribe.plans import side_tables

    monkeypatch.setattr(side_tables, "BUCKET_TRANSACTIONS", 2)
    df = chain.blocks_df(spark, chain.sample_blocks())
    many, stated = IndexStore(spark, str(tmp_path / "many"), slots_per_bucket=10), IndexStore(spark, str(tmp_path / "stated"), slots_per_bucket=10, key_buckets=4)
    for store in (many, stated):
        run_batch(store, program, df, BatchRequest(start_slot=100, end_slot=140), snapshots=snapshots(spark))
    n = IndexReader(many, program).transactions().count()
    assert many.load().key_buckets == -(-n // 2) > side_tables.KEY_BUCKETS and stated.load().key_buckets == 4
    assert IndexReader(many, program).transaction("sig106a").count() == 1
    target = IndexStore(spark, str(tmp_path / "one"), slots_per_bucket=10)
    rewrite_index(IndexReader(stated, program), target)
    assert target.load().key_buckets == -(-n // 2) and IndexReader(target, program).stats().first() == IndexReader(stated, program).stats().first()

"""Plan shapes that matter at scale."""

import json

import pytest
from pyspark.sql import functions as F

import chain
from slotscribe.operators import dedup, lookups, normalize
from slotscribe.operators.decode import decode_payload
from slotscribe.functions.idl_types import parse_type
from slotscribe.operators.registry import program_from_json
from slotscribe.plans import catalog, sample_chain
from slotscribe.sources import blocks as source

SAMPLE = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def stored_blocks(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("blocks") / "t")
    source.write_blocks(chain.blocks_df(spark, chain.sample_blocks()), path, size=10)
    return source.read_blocks(spark, path)


def test_filters_and_columns_reach_the_scan(spark):
    calls = sample_chain.calls(spark, SAMPLE)
    text = plan(lookups.time_series(calls, "view", "2024-01-02", "2024-01-03", "hour").select("period", "calls"))
    assert "GreaterThanOrEqual(ts" in text and "ReadSchema: struct<ts:timestamp_ntz>" in text
    text = plan(lookups.filter_calls(calls, lookups.CallFilter(tx_sig=5, from_slot=3)))
    assert "EqualTo(event_id,5)" in text


def test_lists_use_a_bounded_top_k(spark):
    assert "TakeOrderedAndProject" in plan(lookups.list_calls(sample_chain.calls(spark, SAMPLE)))
    assert "TakeOrderedAndProject" in plan(source.latest(sample_chain.transactions(spark, SAMPLE), 100))


def test_hot_keys_are_trimmed_before_the_shuffle(spark):
    accounts = sample_chain.account_versions(spark, SAMPLE)
    for df in (
        lookups.newest_per_account(accounts), lookups.newest_per_account(accounts, 100, rank="rn"),
        dedup.keep_first(accounts, ["address"], ["slot"]), dedup.keep_last(accounts, ["address", "slot"], ["lamports"]),
    ):
        text = plan(df)
        assert text.index("Final") < text.index("Exchange") < text.index("Partial"), text


def test_hot_address_keeps_one_row(spark):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("address"), F.col("id").alias("slot"), F.col("id").alias("lamports"))
    got = lookups.newest_per_account(rows)
    assert got.count() == 40_001 and got.where("address = 'hot'").first()["slot"] == 59_997
    first = normalize.first_touch(rows.select("address", "slot"))
    assert first.where("address = 'hot'").first()["slot"] == 0
    assert "partial_min" in plan(first) and "SortAggregate" not in plan(first)


def test_first_touch_with_order_stays_a_hash_aggregate(spark):
    rows = spark.range(10).select(F.col("id").alias("address"), F.col("id").alias("slot"), F.col("id").alias("list_order"))
    assert "HashAggregate" in plan(normalize.first_touch(rows, "list_order")) and "SortAggregate" not in plan(normalize.first_touch(rows, "list_order"))


def test_routing_moves_no_rows(spark, stored_blocks):
    program = program_from_json(spark, chain.PROGRAM, json.dumps(chain.IDL))
    calls = normalize.calls(normalize.transactions(stored_blocks, chain.PROGRAM), chain.PROGRAM)
    text = plan(normalize.route(calls, program, "instruction"))
    assert "BroadcastHashJoin" in text and "SortMergeJoin" not in text and "hashpartitioning" not in text


def test_one_python_stage_per_decoded_type(spark):
    fields = [(f"f{i}", parse_type("u64")) for i in range(6)]
    df = spark.createDataFrame([(b"\0" * 60,)], "data binary")
    assert plan(decode_payload(df, fields, engine="arrow")).count("ArrowEvalPython") == 1
    assert "Python" not in plan(decode_payload(df, fields, engine="native"))


def test_native_expressions_stay_linear(spark):
    df = spark.createDataFrame([(b"\0" * 200,)], "data binary")
    sizes = [len(plan(decode_payload(df, [(f"f{i}", parse_type("i32")) for i in range(n)], engine="native"))) for n in (5, 10, 20)]
    assert sizes[2] - sizes[1] < 6 * (sizes[1] - sizes[0])


def test_no_query_uses_a_cartesian_product(spark):
    if not __import__("os").path.exists(SAMPLE):
        pytest.skip("sample tables not present")
    light = [n for n in catalog.QUERIES if not n.startswith(("index_", "stream_", "evolve"))]
    for name in light:
        text = plan(catalog.queries()[name](spark, SAMPLE))
        assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text, name


def test_small_batches_filter_stored_keys_where_they_are_read(spark):
    stored = spark.range(100_000).select(F.col("id").cast("string").alias("tx_sig"), F.lit(0).alias("ix_index"))
    new = spark.range(99_990, 100_010).select(F.col("id").cast("string").alias("tx_sig"), F.lit(0).alias("ix_index"))
    for probe in (None, new.select("tx_sig")):
        left = dedup.not_stored(new, stored, ["tx_sig", "ix_index"], probe)
        assert sorted(int(r["tx_sig"]) for r in left.collect()) == list(range(100_000, 100_010))
    assert "LeftSemi" in plan(left)

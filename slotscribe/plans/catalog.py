"""Named queries over the sample tables, one or more per operator."""

from __future__ import annotations

import json
from functools import lru_cache, reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.base58 import base58_decode, base58_encode_key
from ..functions.discriminators import derived_discriminator
from ..functions.idl_types import parse_type
from ..functions.names import column_name, snake_case, table_name
from ..operators import dedup, lookups, normalize
from ..operators.decode import decode_payload
from ..operators.lookups import CallFilter
from ..operators.registry import Field, Entry, Program, idl_registry, introspect, program_from_json, stated_addresses
from ..session import apply_runtime_conf, scratch_path
from ..sources import blocks as source
from ..streaming.live import catch_up_then_follow, series_counts, start_index_stream, start_series_stream, stream_blocks
from . import maintenance
from . import sample_chain as sample
from .commit import CommitOptions, commit_batch, decode_entry
from .jobs import BatchRequest, run_batch
from .reader import IndexReader
from .store import IndexStore, latest_state

ALL_TIME = ("2000-01-01 00:00:00", "2100-01-01 00:00:00")


# -- query templates -----------------------------------------------------------

def _series(bucket: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        calls = sample.calls(spark, sf_dir)
        return lookups.time_series(calls, None, *ALL_TIME, bucket, group="ix_name", ordered=False)

    return query


def ix_time_series_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sample.calls(spark, sf_dir).where("ix_name = 'view'")
    return lookups.time_series(calls, "view", "2024-01-03 00:00:00", "2024-01-20 12:00:00", "fortnight")


def tx_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.transaction(sample.transactions(spark, sf_dir), 77)


def ix_list_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sample.calls(spark, sf_dir).where("ix_name = 'click'")
    page = CallFilter(from_slot=1, to_slot=10**9, from_time="2024-01-02 00:00:00", to_time="2024-01-30 00:00:00", limit=50, offset=10)
    return lookups.list_calls(calls, page)


def ix_list_by_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.list_calls(sample.calls(spark, sf_dir), CallFilter(tx_sig=42))


def ix_list_page_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.list_calls(sample.calls(spark, sf_dir), CallFilter(limit=5000), most=1000)


def ix_list_seek(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page after the first 400 calls, by the last row of these instead of an offset."""
    calls = sample.calls(spark, sf_dir)
    order = lookups.page_order(calls)
    last = lookups.list_calls(calls, CallFilter(limit=1, offset=399)).first()
    return lookups.list_calls(calls, CallFilter(limit=40, after=tuple(last[c] for c, _ in order)))


def ix_list_large_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit beyond any service's maximum is honoured."""
    return lookups.list_calls(sample.calls(spark, sf_dir), CallFilter(limit=5000))


def ix_filter_all_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sample.calls(spark, sf_dir)
    wanted = CallFilter(from_slot=1, from_time="2024-01-01 00:00:00", to_time="2024-01-29 23:59:59")
    return lookups.filter_calls(calls, wanted)


def ix_rows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sample.calls(spark, sf_dir)
    return calls.select("tx_sig", lookups.row_json(calls, ["tx_sig", "ix_name", "user_id", "k"]).alias("row"))


def ix_call_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.call_count(sample.calls(spark, sf_dir))


def account_get_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.account_latest(sample.account_versions(spark, sf_dir), 8)


def account_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.account_history(sample.account_versions(spark, sf_dir), 8)


def account_list_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.newest_per_account(sample.account_versions(spark, sf_dir))


def account_history_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = lookups.newest_per_account(sample.account_versions(spark, sf_dir), 20, rank="rn")
    return ranked.withColumn("rn", F.col("rn").cast("bigint"))


def account_rows_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.account_rows(sample.account_versions(spark, sf_dir))


def program_stats_tx(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.transaction_stats(sample.transactions(spark, sf_dir))


def program_stats_ix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookups.call_totals(sample.calls(spark, sf_dir), "ix_name")


def program_stats_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = sample.calls(spark, sf_dir)
    tables = {f"ix_{n}": calls.where(F.col("ix_name") == n) for n in ("click", "error", "purchase", "signup", "view")}
    stats = lookups.program_stats(sample.transactions(spark, sf_dir), tables, "tip")
    return stats.withColumn("ix_call_counts", F.to_json("ix_call_counts"))


# -- writes --------------------------------------------------------------------

def _two_attempts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders twice: as first seen, then with a changed price."""
    orders = sample.table(spark, sf_dir, "orders").select("o_orderkey", sample.day("o_orderdate").alias("slot"), F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"))
    first = orders.withColumn("seq", F.lit(1).cast("bigint"))
    second = orders.withColumn("cents", F.col("cents") + 1).withColumn("seq", F.lit(2).cast("bigint"))
    return first.unionByName(second)


def tx_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_first(_two_attempts(spark, sf_dir), ["o_orderkey"], ["seq"])


def account_keep_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.keep_last(_two_attempts(spark, sf_dir), ["o_orderkey", "slot"], ["seq"])


def ix_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample.table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_returnflag", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).cast("bigint").alias("ix_index")
    )
    return dedup.keep_first(lines, ["l_orderkey", "l_returnflag"], ["ix_index"])


def tx_insert_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = sample.transactions(spark, sf_dir)
    stored = txs.where("err is not null").withColumn("batch", F.lit(1).cast("bigint"))
    fresh = dedup.not_stored(txs, stored, ["signature"]).withColumn("batch", F.lit(2).cast("bigint"))
    return stored.unionByName(fresh).select("signature", "slot", "batch")


def tx_insert_far_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two batches, the second with every signature 5,000 slots later: the stored ones stay as they are."""
    none = {"header": source.HEADER, "instructions": f"array<{source.INSTRUCTION}>", "accounts": "array<string>", "err": "string"}
    txs = sample.transactions(spark, sf_dir).select(
        F.col("signature").cast("string").alias("signature"), "slot", F.lit(0).cast("bigint").alias("block_time"),
        F.lit(0).alias("tx_index"), *[F.lit(None).cast(kind).alias(name) for name, kind in none.items()],
    )
    store = IndexStore(spark, scratch_path(spark, "far-conflict"), slots_per_bucket=400)
    program = _program(spark, sample.SAMPLE_IDL)
    commit_batch(store, program, txs.where("cast(signature as bigint) % 2 = 1"), writer="sample", batch_id=0)
    commit_batch(store, program, txs.withColumn("slot", F.col("slot") + 5_000), writer="sample", batch_id=1)
    return IndexReader(store, program).transactions().select("signature", "slot")


def checkpoint_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sample.table(spark, sf_dir, "events").select(
        F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("value"), F.col("ts").alias("updated_at"), F.col("event_id").alias("batch_id")
    )
    return latest_state(rows)


def typed_coercion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """u64 values written into a table whose saved column is BIGINT: what does not fit is NULL and flagged."""
    entry = Entry("instruction", 0, "store", "ix_store", b"", True, (Field("amount", "amount", "u64"), Field("on", "on", "bool")))
    saved = T.StructType([
        T.StructField("event_id", T.LongType()), T.StructField("amount", T.LongType()), T.StructField("on", T.BooleanType()),
        T.StructField("memo", T.StringType()), T.StructField("decode_issues", T.ArrayType(T.StringType())),
    ])
    events = sample.table(spark, sf_dir, "events")
    top = F.col("user_id") % 2 * 128  # sets the highest bit for odd users
    parts = [sample.little_endian_hex(F.col("event_id"), 7), sample.little_endian_hex(top, 1), sample.little_endian_hex(F.col("user_id"), 1)]
    rows = events.select("event_id", sample.payload("instruction", F.lit("store"), *parts).alias("data"))
    stored = decode_entry(rows, entry, saved, keep=("event_id",)).withColumn("memo", F.col("memo").isNull())
    return stored.withColumn("issues", F.array_join("decode_issues", ",")).drop("decode_issues")


def evolve_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two commits, the second with one more column; all rows read with the grown schema."""
    orders = sample.table(spark, sf_dir, "orders").withColumn("slot", sample.day("o_orderdate"))
    store = IndexStore(spark, scratch_path(spark, "evolve"), slots_per_bucket=400)
    old = orders.where("o_orderstatus = 'F'").select("o_orderkey", "slot")
    new = orders.where("o_orderstatus <> 'F'").select("o_orderkey", "slot", "o_orderpriority")
    store.write(old, "ix_order", "sample", 0)
    store.write_state({}, "sample", 0)
    store.write(new, "ix_order", "sample", 1)
    store.write_state({}, "sample", 1)
    return store.read("ix_order", new.schema).select("o_orderkey", "slot", "o_orderpriority", "batch_id")


# -- names, discriminators, registry ---------------------------------------------

def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every name-like text of the sample tables."""
    parts = [
        sample.table(spark, sf_dir, t).select(F.col(c).alias("name"))
        for t, c in (
            ("customer", "c_name"), ("customer", "c_mktsegment"), ("supplier", "s_name"), ("part", "p_name"), ("part", "p_brand"),
            ("part", "p_type"), ("orders", "o_orderpriority"), ("nation", "n_name"), ("events", "event_type"), ("conversations", "role"),
            ("documents", "lang"),
        )
    ]
    names = parts[0]
    for p in parts[1:]:
        names = names.union(p)
    return names.distinct()


def registry_address_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every third document under a foreign program: refused where it states its own address."""
    docs = sample.customer_documents(spark, sf_dir)
    number = F.substring("program_id", 2, 20).cast("bigint")
    return stated_addresses(docs.withColumn("program_id", F.when(number % 3 == 0, F.lit("Foreign")).otherwise(F.col("program_id")))).select(
        "program_id", F.col("address"), "accepted"
    )


def snake_case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select(
        "name", snake_case(name).alias("snake"), column_name(name).alias("column_name"),
        table_name("instruction", name).alias("ix_table"), table_name("account", name).alias("acc_table"),
    )


def discriminators(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.col("name")
    return _names(spark, sf_dir).select(
        "name",
        F.lower(F.hex(derived_discriminator("instruction", name))).alias("ix_disc"),
        F.lower(F.hex(derived_discriminator("account", name))).alias("acc_disc"),
    )


def registry_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return idl_registry(sample.customer_documents(spark, sf_dir)).select(
        "program_id", "program_name", "kind", F.col("ordinal").cast("bigint").alias("ordinal"), "name", "table_name", "has_table",
        F.lower(F.hex("discriminator")).alias("disc"),
        F.array_join("fields.column", ",").alias("columns"),
        F.array_join("fields.type", ",").alias("types"),
    )


def schema_introspection(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = introspect(sample.customer_documents(spark, sf_dir))
    listed = F.transform("fields", lambda f: F.concat_ws(":", f["name"], f["ty"]))
    return shown.select("program_id", "program_name", "kind", "name", "table_name", F.array_join(listed, ",").alias("fields"))


# -- selection -------------------------------------------------------------------

def latest_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.latest(sample.transactions(spark, sf_dir), 100).select("signature", "slot")


def signature_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = sample.transactions(spark, sf_dir)
    before, until = source.position_of(txs, 500), source.position_of(txs, 100)
    newer, older = max(before, until), min(before, until)
    return source.signature_page(txs, 1000, before=newer, until=older).select("signature", "slot")


def backfill_since(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = sample.transactions(spark, sf_dir)
    return source.since(txs, source.position_of(txs, 100)).select("signature", "slot")


def signature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = source.parse_signature_list(" 9, 3,,12 ,9, 700,99999999")
    txs = sample.transactions(spark, sf_dir).withColumn("signature", F.col("signature").cast("string"))
    return source.pick_signatures(txs, spark, wanted).select("signature", "slot", "list_order")


def chunk_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = sample.transactions(spark, sf_dir)
    bounds = txs.agg(F.min("slot"), F.max("slot")).first()
    return source.chunk_progress(spark, txs, bounds[0], bounds[1] + 25, 10)


def program_filter_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source.program_signatures(_block_table(spark, sf_dir), sample.PROGRAM).select("signature", "slot", "block_time")


def loaded_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    txs = normalize.transactions(_block_table(spark, sf_dir), sample.PROGRAM)
    return txs.select("signature", F.posexplode("accounts").alias("pos", "address")).withColumn("pos", F.col("pos").cast("bigint"))


def account_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = sample.table(spark, sf_dir, "events")
    n = (F.col("event_id") % 5 + 3).cast("int")
    header = F.struct(F.lit(2).alias("num_required_signatures"), F.lit(1).alias("num_readonly_signed"), F.lit(1).alias("num_readonly_unsigned"))
    accounts = F.transform(F.sequence(F.lit(0), n - 1), lambda i: i.cast("string"))
    index = F.array((F.col("event_id") % 4).cast("int"))
    return events.select("event_id", F.explode(normalize.account_roles(accounts, index, header)).alias("r")).select("event_id", "r.*")


def touched_accounts_first_slot(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = sample.table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("address"), F.col("l_orderkey").alias("slot"),
        (F.col("l_linenumber") * 10**13 + F.col("l_partkey") * 10**7 + F.col("l_orderkey")).alias("ord"),
    )
    return normalize.first_touch(touches, "ord")


def touched_account_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    touches = sample.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("address"), sample.day("l_shipdate").alias("slot"))
    suppliers = sample.table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("address"), F.round(F.col("s_acctbal") * 100).cast("bigint").alias("lamports"), F.col("s_name").alias("data")
    )
    return normalize.current_snapshots(normalize.first_touch(touches), suppliers)


def account_snapshots_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = sample.table(spark, sf_dir, "lineitem").select(
        F.col("l_partkey").alias("address"), sample.day("l_shipdate").alias("slot"), F.col("l_quantity").cast("bigint").alias("lamports"), F.col("l_returnflag").alias("data")
    )
    touches = normalize.first_touch(lines.where("data = 'R'").select("address", "slot"))
    versions = lines.groupBy("address", "slot").agg(F.max("lamports").alias("lamports"), F.max("data").alias("data"))
    return normalize.snapshots_as_of(touches, versions)


# -- routing and decoding ----------------------------------------------------------

def _event_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a payload: discriminator of its type, then id, user and name."""
    data = sample.payload(
        "instruction", F.col("event_type"), sample.little_endian_hex(F.col("event_id"), 8),
        sample.little_endian_hex(F.col("user_id"), 4), sample.text_hex(F.col("event_type")),
    )
    return sample.table(spark, sf_dir, "events").select(
        F.col("event_id").alias("tx_sig"), F.col("event_id").alias("slot"), F.lit(0).alias("ix_index"), data.alias("data")
    )


EVENT_FIELDS = [("event_id", parse_type("i64")), ("user_id", parse_type("u32")), ("event_type", parse_type("string"))]
ROUTED_IDL = json.dumps({"instructions": [{"name": n, "args": []} for n in ("click", "purchase")] + [{"name": "view"}]})


@lru_cache
def _program(spark: SparkSession, idl: str) -> Program:
    """The sample program under a given description, loaded once per session."""
    return program_from_json(spark, sample.PROGRAM, idl)


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.route(_event_payloads(spark, sf_dir), _program(spark, ROUTED_IDL), "instruction")


def route_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    routed = _routed(spark, sf_dir)
    return routed.groupBy("entry_name", "table_name").agg(F.count(F.lit(1)).alias("calls"))


def unknown_discriminator(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.unknown_counts(_routed(spark, sf_dir))


def quarantined_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return normalize.quarantine(_routed(spark, sf_dir)).select("tx_sig", "discriminator_hex", "reason")


def _round_trip(engine: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = _event_payloads(spark, sf_dir).select("tx_sig", "data")
        return decode_payload(rows, EVENT_FIELDS, engine=engine).drop("decode_issues")

    return query


def decode_one_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One column of the payload: chosen engine reads no further than it must."""
    rows = _event_payloads(spark, sf_dir).select("tx_sig", "data")
    return decode_payload(rows, EVENT_FIELDS, columns=["event_id"]).drop("decode_issues")


def _scalars(engine: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """All integer widths and floats, from the numbers of ``events``."""
        user, event, signed = F.col("user_id"), F.col("event_id"), F.col("user_id") - F.col("event_id")
        value = F.col("value")
        layout = [
            ("flag", "bool", sample.little_endian_hex(user % 2, 1)), ("a8", "u8", sample.little_endian_hex(user, 1)),
            ("a16", "u16", sample.little_endian_hex(event, 2)), ("a32", "u32", sample.little_endian_hex(event * 1000, 4)),
            ("a64", "u64", sample.little_endian_hex(-1 - event, 8)), ("a128", "u128", sample.wide_hex(user, event)),
            ("b8", "i8", sample.little_endian_hex(signed, 1)), ("b16", "i16", sample.little_endian_hex(signed, 2)),
            ("b32", "i32", sample.little_endian_hex(signed, 4)), ("b64", "i64", sample.little_endian_hex(signed, 8)),
            ("b128", "i128", sample.wide_hex(-1 - user, event)),
            ("f4", "f32", sample.float_hex(value.cast("float").cast("double"), 4)), ("f8", "f64", sample.float_hex(value, 8)),
        ]
        data = sample.payload("instruction", F.lit("scalars"), *[part for _, _, part in layout])
        rows = sample.table(spark, sf_dir, "events").select("event_id", data.alias("data"))
        decoded = decode_payload(rows, [(name, parse_type(kind)) for name, kind, _ in layout], engine=engine)
        wide = [F.col(c).cast("string").alias(c) for c in ("a64", "a128", "b128")]
        others = [c for c in ("event_id", "flag", "a8", "a16", "a32", "b8", "b16", "b32", "b64", "f8")]
        return decoded.select(*others, *wide, F.col("f4").cast("double").alias("f4"), F.size("decode_issues").cast("bigint").alias("issues"))

    return query


NESTED_TYPES = [
    ("opt", '{"option":"u32"}'), ("items", '{"vec":"u16"}'), ("pair", '{"array":["u8",2]}'),
    ("inner", '{"kind":"struct","fields":[{"name":"id","type":"i64"},{"name":"tag","type":"string"}]}'), ("blob", "bytes"), ("rest", '{"defined":"Tail"}'), ("late", "u8"),
]


def _nested(engine: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Optional, list, array, struct, bytes and opaque fields, from ``events``."""
        user, event, kind = F.col("user_id"), F.col("event_id"), F.col("event_type")
        even = event % 2 == 0
        count = event % 4
        items = F.when(count == 0, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.lit(1), F.greatest(count, F.lit(1))), lambda i: sample.little_endian_hex(user + i, 2)), ""))
        parts = [
            F.when(even, F.concat(F.lit("01"), sample.little_endian_hex(user, 4))).otherwise("00"),
            sample.little_endian_hex(count, 4), items,
            sample.little_endian_hex(count, 1), sample.little_endian_hex(user, 1),
            sample.little_endian_hex(event, 8), sample.text_hex(kind),
            sample.text_hex(F.col("props")), F.hex(kind.cast("binary")),
        ]
        rows = sample.table(spark, sf_dir, "events").select("event_id", sample.payload("instruction", F.lit("nested"), *parts).alias("data"))
        decoded = decode_payload(rows, [(n, parse_type(t)) for n, t in NESTED_TYPES], engine=engine)
        return decoded.select(
            "event_id", "opt", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"),
            F.array_join(F.transform("pair", lambda i: i.cast("string")), ",").alias("pair"), F.col("inner.id").alias("inner_id"), F.col("inner.tag").alias("inner_tag"),
            F.lower(F.hex("blob")).alias("blob"), F.col("rest.raw_hex").alias("rest"), F.col("late").isNull().alias("late_missing"), F.array_join("decode_issues", ",").alias("issues"),
        )

    return query


def _wide_integers(engine: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Numbers at both ends of the 128-bit ranges: too wide for the column, kept as digits."""
        event = F.col("event_id")
        top, bottom, ones = F.lit(2**63 - 1), F.lit(-(2**63)), F.lit(-1)
        parts = [sample.wide_hex(ones, -1 - event), sample.wide_hex(top, -1 - event), sample.wide_hex(bottom, event)]
        rows = sample.table(spark, sf_dir, "events").select("event_id", sample.payload("instruction", F.lit("wide"), *parts).alias("data"))
        decoded = decode_payload(rows, [("a", parse_type("u128")), ("b", parse_type("i128")), ("c", parse_type("i128"))], engine=engine)
        empty = (F.col("a").isNull() & F.col("b").isNull() & F.col("c").isNull()).alias("empty")
        return decoded.select("event_id", empty, F.array_join("decode_issues", ",").alias("issues"))

    return query


def _short_lists(engine: str):
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        """Lists that declare more items than they hold keep both."""
        held = F.col("event_id") % 3
        items = F.array_join(F.transform(F.slice(F.array(*[F.lit(k) for k in (1, 2)]), 1, held.cast("int")), lambda i: sample.little_endian_hex(F.col("user_id") + i, 2)), "")
        parts = [sample.little_endian_hex(F.col("event_id") % 5, 4), items]
        rows = sample.table(spark, sf_dir, "events").where(held <= F.col("event_id") % 5).select("event_id", sample.payload("instruction", F.lit("short"), *parts).alias("data"))
        decoded = decode_payload(rows, [("items", parse_type('{"vec":"u16"}'))], engine=engine)
        return decoded.select("event_id", F.array_join(F.transform("items", lambda i: i.cast("string")), ",").alias("items"), F.array_join("decode_issues", ",").alias("issues"))

    return query


def decode_opaque(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts behind a reference to a named type, kept as hex."""
    data = sample.payload("account", F.lit("Doc"), F.hex(F.col("text").cast("binary")))
    rows = sample.table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    decoded = decode_payload(rows, [("rest", parse_type('{"defined":"Text"}'))])
    return decoded.select("doc_id", F.md5(F.col("rest.raw_hex").cast("binary")).alias("digest"))


def decode_text_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lists of texts of any length: whole conversations' words, one payload per turn."""
    words = F.split("text", " ")
    parts = [sample.little_endian_hex(F.size(words), 4), F.array_join(F.transform(words, sample.text_hex), "")]
    rows = sample.table(spark, sf_dir, "conversations").select("conv_id", "turn", sample.payload("instruction", F.lit("say"), *parts).alias("data"))
    decoded = decode_payload(rows, [("words", parse_type('{"vec":"string"}'))])
    return decoded.select("conv_id", "turn", F.array_join("words", " ").alias("text"), F.size("words").cast("bigint").alias("n_words"))


def decode_nameless(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calls as objects of their named arguments; a nameless one is read for its bytes only."""
    idl = {"name": "tracker", "instructions": [{"name": "track", "args": [{"name": "number", "type": "i64"}, {"type": "u32"}, {"name": "odd", "type": "bool"}]}]}
    entry = _program(spark, json.dumps(idl)).resolve("instruction", "track")
    parts = [sample.little_endian_hex(F.col("event_id"), 8), sample.little_endian_hex(F.col("user_id"), 4), F.when(F.col("user_id") % 2 == 1, "01").otherwise("00")]
    rows = sample.table(spark, sf_dir, "events").select("event_id", sample.payload("instruction", F.lit("track"), *parts).alias("data"))
    decoded = decode_payload(rows, entry.layout)
    named = [f.column for f in entry.fields if f.column is not None]
    return decoded.select("event_id", lookups.row_json(decoded, named).alias("args"))


def decode_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole document texts as string fields."""
    data = sample.payload("account", F.lit("Doc"), sample.text_hex(F.col("text")), sample.little_endian_hex(F.col("n_chars"), 8))
    rows = sample.table(spark, sf_dir, "documents").select("doc_id", data.alias("data"))
    decoded = decode_payload(rows, [("text", parse_type("string")), ("n_chars", parse_type("i64"))])
    return decoded.select("doc_id", F.md5(F.col("text").cast("binary")).alias("digest"), "n_chars")


def truncated_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads cut after ``user_id mod 13`` field bytes: what no longer fits is NULL, later narrower fields may fit."""
    full = sample.payload("instruction", F.lit("cut"), sample.little_endian_hex(F.col("event_id"), 8), sample.little_endian_hex(F.col("user_id"), 4), F.lit("07"))
    cut = (F.col("user_id") % 13).cast("int")
    rows = sample.table(spark, sf_dir, "events").select("event_id", cut.alias("kept"), F.substring(full, F.lit(1), cut + 8).alias("data"))
    fields = [("big", parse_type("i64")), ("mid", parse_type("u32")), ("tiny", parse_type("bool"))]
    return decode_payload(rows, fields).select("event_id", "big", "mid", "tiny", F.array_join("decode_issues", ",").alias("issues"))


def base58_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.unhex(F.sha2(F.col("event_id").cast("string").cast("binary"), 256))
    text = sample.table(spark, sf_dir, "events").select("event_id", base58_encode_key(key).alias("text"))
    return text.select("event_id", F.lower(F.hex(base58_decode("text"))).alias("key_hex"), (F.length("text") <= 44).alias("short_enough"))


# -- whole index runs ----------------------------------------------------------------

_BUILT: dict[tuple, str] = {}


def _block_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample blocks as a stored block table, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "blocks")
    if key not in _BUILT:
        path = scratch_path(spark, "blocks")
        source.write_blocks(sample.lines(spark, sf_dir), path, size=400, widen=sample.as_blocks)
        _BUILT[key] = path
    return source.read_blocks(spark, _BUILT[key])


def _index(spark: SparkSession, sf_dir: str, rebuild: bool = False) -> IndexReader:
    """Reader over the index of the sample program, built once per session."""
    key = (spark.sparkContext.applicationId, sf_dir, "index")
    program = _program(spark, sample.SAMPLE_IDL)
    if rebuild or key not in _BUILT:
        blocks = _block_table(spark, sf_dir)
        store = IndexStore(spark, scratch_path(spark, "index"), slots_per_bucket=400)
        run_batch(
            store, program, blocks, BatchRequest(start_slot=0, end_slot=10**6),
            snapshots=sample.supplier_snapshots(spark, sf_dir),
        )
        _BUILT[key] = store.root
    return IndexReader(IndexStore(spark, _BUILT[key]), program)


def index_build_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scan, route, decode and commit all sample blocks, then the program statistics."""
    stats = _index(spark, sf_dir, rebuild=True).stats()
    return stats.withColumn("ix_call_counts", F.to_json("ix_call_counts")).drop("last_checkpoint")


def index_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded calls of all instruction tables of the index."""
    reader = _index(spark, sf_dir)
    parts = [
        reader.call_table(name).select(F.lit(name).alias("ix_name"), "tx_sig", "slot", "block_time", F.col("part_key").cast("bigint").alias("part_key"), F.col("quantity").cast("bigint").alias("quantity"), "price_cents")
        for name in sample.FLAG_NAMES.values()
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def index_accounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Newest account states of the index, decoded from the supplier snapshots."""
    states = _index(spark, sf_dir).account_table("SupplierVault")
    owner = F.lower(F.hex(base58_decode("owner"))).alias("owner_hex")
    return states.select("address", "slot", "lamports", owner, "balance_cents", "active", "label")


def index_chain_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly calls by chain time from the index."""
    series = _index(spark, sf_dir).time_series("newLine", "1970-01-01", "2100-01-01", "week", time_col="block_ts")
    return series.withColumn("period", F.col("period").cast("timestamp_ntz"))


def index_range_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample blocks in two runs of several chunks, the second from the first one's checkpoint."""
    program, blocks = _program(spark, sample.SAMPLE_IDL), _block_table(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "resumed-index"), slots_per_bucket=400)
    for end in (9_599, 11_999):
        run_batch(store, program, blocks, BatchRequest(start_slot=8_000, end_slot=end, chunk_slots=1_600))
    return IndexReader(store, program).stats().withColumn("ix_call_counts", F.to_json("ix_call_counts")).drop("last_checkpoint")


def index_signature_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listed lines of both programs, all stored; calls of the sample program only."""
    wanted = sample.table(spark, sf_dir, "lineitem").where("l_orderkey between 1 and 40").select(sample.line_signature().alias("s"))
    store = IndexStore(spark, scratch_path(spark, "listed-index"), slots_per_bucket=400)
    program = _program(spark, sample.SAMPLE_IDL)
    run_batch(store, program, _block_table(spark, sf_dir), BatchRequest(signatures=tuple(sorted(r["s"] for r in wanted.collect()))))
    reader = IndexReader(store, program)
    calls = [reader.call_table(name).select("tx_sig", F.lit(1).alias("n")) for name in sample.FLAG_NAMES.values()]
    called = calls[0].unionByName(calls[1]).unionByName(calls[2]).groupBy(F.col("tx_sig").alias("signature")).agg(F.sum("n").alias("calls"))
    return reader.transactions().select("signature", "slot").join(called, "signature", "left").select("signature", "slot", F.coalesce("calls", F.lit(0)).alias("calls"))


def index_point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One transaction, its calls, one account and its history, found through the keys of the index."""
    reader = _index(spark, sf_dir)
    line = sample.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").select(
        F.min(F.struct(sample.line_signature().alias("signature"), F.col("l_suppkey"), F.col("l_returnflag")))
    ).first()[0]
    name, address = sample.FLAG_NAMES[line["l_returnflag"]], f"supp{line['l_suppkey']}"
    found = {
        "transaction": reader.transaction(line["signature"]).select(F.col("signature").alias("key"), "slot"),
        "call": reader.calls(name, CallFilter(tx_sig=line["signature"])).select(F.col("tx_sig").alias("key"), "slot"),
        "account": reader.account("SupplierVault", address).select(F.col("address").alias("key"), "slot"),
        "version": reader.account_history("SupplierVault", address).select(F.col("address").alias("key"), "slot"),
    }
    return reduce(DataFrame.unionByName, [rows.select(F.lit(kind).alias("kind"), "key", "slot") for kind, rows in found.items()])


def index_range_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily calls of one month of chain time: the zones say which folders hold it."""
    series = _index(spark, sf_dir).time_series("newLine", "1997-03-01 00:00:00", "1997-03-31 23:59:59", "day", time_col="block_ts")
    return series.withColumn("period", F.col("period").cast("timestamp_ntz"))


def index_current_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Current account states after two batches, the second with older slots."""
    program, blocks = _program(spark, sample.SAMPLE_IDL), _block_table(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "states-index"), slots_per_bucket=400)
    txs = normalize.transactions(blocks, program.program_id)
    for n, part in enumerate((txs.where("slot >= 9600"), txs.where("slot < 9600"))):
        commit_batch(store, program, part, writer="sample", batch_id=n, snapshots=sample.supplier_snapshots(spark, sf_dir))
    return IndexReader(store, program).accounts("SupplierVault").select("address", "slot", "lamports", F.get_json_object("data", "$.label").alias("label"))


def index_failed_left_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks with failed transactions, indexed with and without them."""
    program = _program(spark, sample.SAMPLE_IDL)
    txs = normalize.transactions(sample.line_blocks(spark, sf_dir, F.col("l_quantity") > 40), program.program_id)
    parts = []
    for kept in (True, False):
        store = IndexStore(spark, scratch_path(spark, "failed-index"), slots_per_bucket=400)
        commit_batch(store, program, txs, writer="sample", batch_id=0, options=CommitOptions(include_failed=kept))
        rows = IndexReader(store, program).transactions()
        parts.append(rows.groupBy("err").agg(F.count(F.lit(1)).alias("transactions"), F.min("slot").alias("first_slot")).withColumn("include_failed", F.lit(kept)))
    return parts[0].unionByName(parts[1])


def index_rewritten_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index of several batches rewritten as one, its state compacted: the same statistics."""
    program, blocks = _program(spark, sample.SAMPLE_IDL), _block_table(spark, sf_dir)
    store, target = (IndexStore(spark, scratch_path(spark, n), slots_per_bucket=400) for n in ("many-batches", "one-batch"))
    txs = normalize.transactions(blocks, program.program_id)
    for n, part in enumerate((txs.where("slot < 9900"), txs.where("slot >= 9700"))):
        commit_batch(store, program, part, writer="sample", batch_id=n)
    maintenance.compact_state(store)
    maintenance.rewrite_index(IndexReader(store, program), target)
    return IndexReader(target, program).stats().withColumn("ix_call_counts", F.to_json("ix_call_counts")).drop("last_checkpoint")


def _live_blocks(spark: SparkSession, sf_dir: str, from_slot: int) -> DataFrame:
    """The stored sample blocks from a slot on as a stream."""
    _block_table(spark, sf_dir)
    stored = stream_blocks(spark, _BUILT[(spark.sparkContext.applicationId, sf_dir, "blocks")], "parquet")
    return stored.where(F.col("slot") >= from_slot)


def stream_row_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample blocks as a stream whose commits hold a third of all transactions at most."""
    program = _program(spark, sample.SAMPLE_IDL)
    total = sample.table(spark, sf_dir, "lineitem").where("l_linestatus = 'O'").count()
    store = IndexStore(spark, scratch_path(spark, "bound-index"), slots_per_bucket=400)
    start_index_stream(
        _live_blocks(spark, sf_dir, 0), store, program, scratch_path(spark, "bound-checkpoint"), name="sample", available_now=True, max_rows=-(-total // 3)
    ).awaitTermination()
    zones = store.zones(store.load()).where("indexed = 'transactions'")
    commits = zones.groupBy("batch_id").agg(F.min("min_slot").alias("first_slot"), F.max("max_slot").alias("last_slot"), F.sum("rows").alias("transactions"))
    return commits.drop("batch_id")


def stream_catch_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A batch run up to a slot, a backfill of what the history gained since, then the live feed, which overlaps both."""
    program, blocks = _program(spark, sample.SAMPLE_IDL), _block_table(spark, sf_dir)
    store = IndexStore(spark, scratch_path(spark, "followed-index"), slots_per_bucket=400)
    run_batch(store, program, blocks, BatchRequest(start_slot=0, end_slot=9_400))
    live = _live_blocks(spark, sf_dir, 9_500)
    query = catch_up_then_follow(
        blocks.where("slot <= 10000"), live, store, program, scratch_path(spark, "followed-checkpoint"), name="sample", available_now=True
    )
    query.awaitTermination()
    return IndexReader(store, program).stats().withColumn("ix_call_counts", F.to_json("ix_call_counts")).drop("last_checkpoint")


def stream_index_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same blocks as a stream: worked off in micro-batches, then counted per instruction."""
    _block_table(spark, sf_dir)
    path = _BUILT[(spark.sparkContext.applicationId, sf_dir, "blocks")]
    program = _program(spark, sample.SAMPLE_IDL)
    store = IndexStore(spark, scratch_path(spark, "live-index"), slots_per_bucket=400)
    feed = stream_blocks(spark, path, "parquet", max_files=1000)
    query = start_index_stream(feed, store, program, scratch_path(spark, "live-checkpoint"), name="sample", available_now=True)
    query.awaitTermination()
    return IndexReader(store, program).stats().select(
        "total_transactions", "total_ix_calls", F.to_json("ix_call_counts").alias("ix_call_counts"), "first_indexed_slot", "last_indexed_slot"
    )


def stream_time_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily calls kept by a stream whose micro-batches are far out of order: on time and late ones together."""
    calls, arrived, folder = sample.calls(spark, sf_dir), scratch_path(spark, "arriving-calls"), scratch_path(spark, "live-series")
    calls.select("ix_name", "created_at", "tx_sig").repartition(8, "tx_sig").write.parquet(arrived)
    feed = spark.readStream.schema(calls.select("ix_name", "created_at").schema).option("maxFilesPerTrigger", 3).parquet(arrived)
    start_series_stream(
        feed, folder, scratch_path(spark, "series-checkpoint"), time_col="created_at", bucket="day", delay="12 hours", available_now=True
    ).awaitTermination()
    return series_counts(spark, folder, bucket="day", delay="12 hours").select("ix_name", "period", "calls")


QUERIES = {
    "ix_time_series_hour": _series("hour"),
    "ix_time_series_day": _series("day"),
    "ix_time_series_week": _series("week"),
    "ix_time_series_one": ix_time_series_one,
    "tx_lookup": tx_lookup,
    "ix_list_filtered": ix_list_filtered,
    "ix_list_by_tx": ix_list_by_tx,
    "ix_list_page_cap": ix_list_page_cap,
    "ix_list_large_page": ix_list_large_page,
    "ix_list_seek": ix_list_seek,
    "ix_filter_all_matching": ix_filter_all_matching,
    "ix_rows_json": ix_rows_json,
    "ix_call_count": ix_call_count,
    "account_get_latest": account_get_latest,
    "account_history": account_history,
    "account_list_latest": account_list_latest,
    "account_history_topk": account_history_topk,
    "account_rows_json": account_rows_json,
    "program_stats_tx": program_stats_tx,
    "program_stats_ix": program_stats_ix,
    "program_stats_overview": program_stats_overview,
    "tx_keep_first": tx_keep_first,
    "ix_keep_first": ix_keep_first,
    "account_keep_last": account_keep_last,
    "tx_insert_conflict": tx_insert_conflict,
    "tx_insert_far_conflict": tx_insert_far_conflict,
    "checkpoint_state": checkpoint_state,
    "typed_coercion": typed_coercion,
    "evolve_add_column": evolve_add_column,
    "snake_case_names": snake_case_names,
    "discriminators": discriminators,
    "registry_entries": registry_entries,
    "registry_address_check": registry_address_check,
    "schema_introspection": schema_introspection,
    "latest_n": latest_n,
    "signature_page": signature_page,
    "backfill_since": backfill_since,
    "signature_list": signature_list,
    "chunk_progress": chunk_progress,
    "program_filter_scan": program_filter_scan,
    "loaded_accounts": loaded_accounts,
    "account_roles": account_roles,
    "touched_accounts_first_slot": touched_accounts_first_slot,
    "touched_account_snapshots": touched_account_snapshots,
    "account_snapshots_as_of": account_snapshots_as_of,
    "route_counts": route_counts,
    "unknown_discriminator": unknown_discriminator,
    "quarantined_calls": quarantined_calls,
    "borsh_round_trip": _round_trip("arrow"),
    "borsh_round_trip_native": _round_trip("native"),
    "decode_one_column": decode_one_column,
    "decode_scalars": _scalars("arrow"),
    "decode_scalars_native": _scalars("native"),
    "decode_nested": _nested("arrow"),
    "decode_nested_native": _nested("native"),
    "decode_wide_integers": _wide_integers("arrow"),
    "decode_wide_integers_native": _wide_integers("native"),
    "decode_short_lists": _short_lists("arrow"),
    "decode_short_lists_native": _short_lists("native"),
    "decode_opaque": decode_opaque,
    "decode_text_lists": decode_text_lists,
    "decode_documents": decode_documents,
    "decode_nameless": decode_nameless,
    "truncated_payloads": truncated_payloads,
    "base58_round_trip": base58_round_trip,
    "index_build_stats": index_build_stats,
    "index_calls": index_calls,
    "index_accounts": index_accounts,
    "index_chain_time_series": index_chain_time_series,
    "index_range_resumed": index_range_resumed,
    "index_signature_list": index_signature_list,
    "index_point_lookup": index_point_lookup,
    "index_range_time_series": index_range_time_series,
    "index_current_states": index_current_states,
    "index_failed_left_out": index_failed_left_out,
    "index_rewritten_stats": index_rewritten_stats,
    "stream_index_counts": stream_index_counts,
    "stream_row_bound": stream_row_bound,
    "stream_time_series": stream_time_series,
    "stream_catch_up": stream_catch_up,
}


def queries():
    """Every named query, with the session settings applied first."""

    def bound(query):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return query(apply_runtime_conf(spark), sf_dir.rstrip("/"))

        run.__doc__ = query.__doc__
        return run

    return {name: bound(query) for name, query in QUERIES.items()}

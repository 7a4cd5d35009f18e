import hashlib
import json

import pytest

from slotscribe.operators.registry import (
    idl_registry, introspect, load_program, merge_schema, program_from_json,
)
from slotscribe.functions.names import column_name, snake_case
from pyspark.sql import functions as F
from pyspark.sql import types as T

BASIC = {
    "version": "0.1.0",
    "name": "weather_station",
    "instructions": [
        {"name": "recordReading", "accounts": [], "args": [{"name": "celsius", "type": "i32"}, {"name": "byHand", "type": "bool"}, {"name": "sensor", "type": "u16"}]},
        {"name": "noArgs"},
        {"name": "explicit", "discriminator": [1, 2, 3, 4, 5, 6, 7, 255], "args": []},
        {"name": "shortDisc", "discriminator": [1, 2], "args": [{"name": "slot", "type": "u8"}, {"name": "from", "type": {"vec": "u8"}}, {"type": "u8"}, {"name": "x"}]},
        {"args": []},
    ],
    "accounts": [
        {"name": "Station", "type": {"kind": "struct", "fields": [{"name": "readings", "type": "u64"}, {"name": "lastPressure", "type": "i64"}, {"name": "keeper", "type": "publicKey"}]}},
        {"name": "CalibrationCurve", "discriminator": [9] * 8},
        {"name": "Flat", "fields": [{"name": "a", "type": "i8"}]},
        {"name": "Ghost"},
    ],
    "types": [{"name": "CalibrationCurve", "type": {"kind": "struct", "fields": [{"name": "offsetMicros", "type": "u64"}, {"name": "done", "type": {"defined": {"name": "OptionBool"}}}]}}],
}


def test_registry_entries(spark):
    program = program_from_json(spark, "P1", json.dumps(BASIC))
    assert program.name == "weather_station"
    assert [(e.name, e.table, e.has_table) for e in program.instructions] == [
        ("recordReading", "ix_record_reading", True), ("noArgs", "ix_no_args", False),
        ("explicit", "ix_explicit", True), ("shortDisc", "ix_short_disc", True),
    ]
    by = {e.name: e for e in program.entries}
    assert by["recordReading"].discriminator.hex() == "b4b88ecf1c74d760"
    assert by["recordReading"].discriminator == hashlib.sha256(b"global:recordReading").digest()[:8]
    assert by["Station"].discriminator == hashlib.sha256(b"account:Station").digest()[:8]
    assert by["explicit"].discriminator == bytes([1, 2, 3, 4, 5, 6, 7, 255])
    assert by["shortDisc"].discriminator == hashlib.sha256(b"global:shortDisc").digest()[:8]
    assert [f.column for f in by["shortDisc"].fields] == ["f_slot", "f_from", None]
    assert [f.column for f in by["CalibrationCurve"].fields] == ["offset_micros", "done"]
    assert [f.column for f in by["Flat"].fields] == ["a"]
    assert not by["Ghost"].has_table and by["Ghost"].fields == ()
    assert by["Station"].table_schema.simpleString() == (
        "struct<address:string,slot:bigint,lamports:bigint,readings:decimal(20,0),last_pressure:bigint,keeper:string,"
        "decode_issues:array<string>,updated_at:timestamp>"
    )
    assert program.resolve("instruction", "shortDisc").table == "ix_short_disc"
    assert program.resolve("instruction", "short_disc").table == "ix_short_disc"
    with pytest.raises(ValueError):
        program.resolve("instruction", "noArgs; drop table x")


def test_address_check(spark):
    for doc in ({"address": "OTHER"}, {"metadata": {"address": "OTHER"}}):
        with pytest.raises(Exception, match="is not program P1"):
            program_from_json(spark, "P1", json.dumps({**BASIC, **doc}))
        assert program_from_json(spark, "P1", json.dumps({**BASIC, **doc}), check_address=False).entries
    assert program_from_json(spark, "P1", json.dumps({**BASIC, "address": "P1"})).entries


def test_empty_document(spark):
    program = program_from_json(spark, "P", "{}")
    assert program.entries == () and program.name == "unknown" and program.accounts == ()


def test_introspection(spark):
    docs = spark.createDataFrame([("P1", json.dumps(BASIC))], "program_id string, idl string")
    shown = {r["name"]: r for r in introspect(docs).collect()}
    assert set(shown) == {"recordReading", "explicit", "shortDisc", "Station", "CalibrationCurve", "Flat"}
    assert [tuple(f) for f in shown["CalibrationCurve"]["fields"]] == [("offsetMicros", "u64"), ("done", "OptionBool")]
    assert [tuple(f) for f in shown["shortDisc"]["fields"]] == [("slot", "u8"), ("from", "Vec<u8>")]


@pytest.mark.parametrize(
    "name,snake,column",
    [
        ("CalibrationCurve", "calibration_curve", "calibration_curve"), ("SiteLog", "site_log", "site_log"), ("read", "read", "read"),
        ("SensorGPS", "sensor_g_p_s", "sensor_g_p_s"), ("a-b c", "a-b c", "a_b_c"), ("Order", "order", "f_order"),
        ("data", "data", "f_data"), ("x" * 70, "x" * 70, "x" * 59), ("Äb", "äb", "äb"), ("aÄ", "a_ä", "a_ä"),
    ],
)
def test_names(spark, name, snake, column):
    row = spark.createDataFrame([(name,)], "n string").select(snake_case(F.col("n")), column_name(F.col("n"))).first()
    assert tuple(row) == (snake, column)


def test_many_documents_share_one_job(spark):
    docs = spark.range(50).select(F.concat(F.lit("P"), "id").alias("program_id"), F.lit(json.dumps(BASIC)).alias("idl"))
    registry = idl_registry(docs)
    assert registry.count() == 50 * 8
    assert len(load_program(registry, "P7").entries) == 8


def test_merge_schema_is_additive():
    old = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    new = T.StructType([T.StructField("b", T.LongType()), T.StructField("c", T.BooleanType())])
    assert merge_schema(old, new).simpleString() == "struct<a:bigint,b:string,c:boolean>"
    assert merge_schema(None, new) is new

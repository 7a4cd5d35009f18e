import math
import random

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from payloads import encode, expected, type_text
from slotscribe.functions.idl_types import parse_type, spark_type, type_label
from slotscribe.operators.decode import decode_payload, native_supported

DISC = b"DISCRIMI"
SCALARS = ["bool", "u8", "u16", "u32", "u64", "u128", "i8", "i16", "i32", "i64", "i128", "f32", "f64", "string", "publicKey", "bytes"]
INNER = {"kind": "struct", "fields": [{"name": "a", "type": "u64"}, {"name": "b", "type": "string"}, {"name": "c", "type": "u8"}]}
LAYOUTS = {
    "scalars": SCALARS,
    "short_tail": ["u64", "u32", "u16", "u8", "bool"],
    "nested": [{"option": "u64"}, {"vec": "u16"}, {"array": ["u32", 3]}, {"option": {"option": "string"}}, INNER, "i8"],
    "opaque": ["u8", {"defined": "Curve"}, "u8"],
    "flag": ["u16", {"defined": {"name": "OptionBool"}}],
    "unknown": ["u8", "mystery", "u16"],
    "lists": [{"vec": "bytes"}, {"vec": "string"}, {"vec": INNER}, {"array": ["publicKey", 2]}, {"vec": {"option": "u32"}}, {"array": [{"vec": "u8"}, 2]}, {"option": {"vec": "publicKey"}}, "u8"],
}


def make_value(rng, ty):
    if isinstance(ty, str):
        match ty:
            case "bool":
                return rng.random() < 0.5
            case "string":
                return "".join(rng.choice("abé漢😀z") for _ in range(rng.randrange(6)))
            case "bytes":
                return rng.randbytes(rng.randrange(6))
            case "publicKey":
                return rng.choice([bytes(32), rng.randbytes(32), bytes(3) + rng.randbytes(29)])
            case "f32" | "f64":
                return rng.choice([0.0, -0.0, 1.5, -2.25, math.inf, -math.inf, 1e-45 if ty == "f32" else 5e-324, 3.4e38, rng.uniform(-1e6, 1e6)])
            case "mystery":
                return None
        bits = int(ty[1:])
        low, high = (-(1 << bits - 1), (1 << bits - 1) - 1) if ty[0] == "i" else (0, (1 << bits) - 1)
        edge = [low, high, 0, 10**38 - 1, 10**38, -(10**38) + 1, -(10**38)]
        return rng.choice([v for v in edge if low <= v <= high] + [rng.randint(low, high)])
    if "vec" in ty:
        return [make_value(rng, ty["vec"]) for _ in range(rng.randrange(4))]
    if "option" in ty:
        return None if rng.random() < 0.3 else make_value(rng, ty["option"])
    if "array" in ty:
        return [make_value(rng, ty["array"][0]) for _ in range(ty["array"][1])]
    if "fields" in ty:
        return {f["name"]: make_value(rng, f["type"]) for f in ty["fields"]}
    return {"raw_hex": rng.randbytes(rng.randrange(1, 4)).hex()}


def plain(value):
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items()}
    if isinstance(value, bytearray):
        return bytes(value)
    if isinstance(value, list):
        return [plain(v) for v in value]
    return value


def same(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return (math.isnan(a) and math.isnan(b)) or (a == b and math.copysign(1, a) == math.copysign(1, b))
    if isinstance(a, dict) and isinstance(b, dict):
        return a.keys() == b.keys() and all(same(a[k], b[k]) for k in a)
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(map(same, a, b))
    return a == b


def payload_rows(types, seed, cases=12):
    rng = random.Random(seed)
    rows = []
    for _ in range(cases):
        body = b"".join(encode(t, make_value(rng, t)) for t in types if t != "mystery")
        rows.append(DISC + body + rng.randbytes(2))
        rows += [DISC + body[:cut] for cut in range(len(body) + 1)]
    for _ in range(40):
        rows.append(DISC + rng.randbytes(rng.randrange(60)))
    return [(i, r) for i, r in enumerate(rows)]


@pytest.mark.parametrize("layout", LAYOUTS)
@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_every_truncation_matches_plain_reader(spark, layout, engine):
    types = LAYOUTS[layout]
    fields = [(f"f{i}", parse_type(type_text(t))) for i, t in enumerate(types)]
    if engine == "native" and not all(native_supported(t) for _, t in fields):
        pytest.skip("arrow only")
    rows = payload_rows(types, seed=layout)
    df = spark.createDataFrame(rows, "id INT, data BINARY")
    got = {r["id"]: r for r in decode_payload(df, fields, engine=engine).collect()}
    assert len(got) == len(rows)
    for i, raw in rows:
        pos = 8
        for n, ty in enumerate(types):
            want, pos = expected(ty, raw, pos)
            assert same(plain(got[i][f"f{n}"]), want), (layout, i, n, ty, raw.hex(), plain(got[i][f"f{n}"]), want)


@pytest.mark.parametrize("layout", [k for k in LAYOUTS if k != "lists"])
def test_native_equals_arrow_including_issues(spark, layout):
    fields = [(f"f{i}", parse_type(type_text(t))) for i, t in enumerate(LAYOUTS[layout])]
    df = spark.createDataFrame(payload_rows(LAYOUTS[layout], seed=layout + "x", cases=5), "id INT, data BINARY")
    native, arrow = (
        sorted(map(repr, decode_payload(df, fields, engine=e).collect())) for e in ("native", "arrow")
    )
    assert native == arrow


def test_schema_matches_between_engines(spark):
    fields = [(f"f{i}", parse_type(type_text(t))) for i, t in enumerate(LAYOUTS["nested"])]
    df = spark.createDataFrame([(DISC,)], "data BINARY")
    kinds = [
        [f.dataType for f in decode_payload(df, fields, engine=e).schema.fields[:-1]] for e in ("native", "arrow")
    ]
    want = [spark_type(t) for _, t in fields]
    assert kinds[1] == want
    assert [T._parse_datatype_json_string(k.json()).simpleString() for k in kinds[0]] == [k.simpleString() for k in want]


def test_column_subset_reads_no_further(spark):
    fields = [("a", parse_type("u64")), ("b", parse_type("string")), ("c", parse_type("u8"))]
    raw = DISC + encode("u64", 7) + encode("string", "xy") + b"\x05"
    df = spark.createDataFrame([(raw,)], "data BINARY")
    assert decode_payload(df, fields, columns=["b"]).collect() == [Row(b="xy", decode_issues=[])]
    plan = decode_payload(df, fields, columns=["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_huge_declared_list_is_capped_and_flagged(spark):
    fields = [("v", parse_type('{"vec":"u16"}')), ("w", parse_type('{"vec":"string"}'))]
    raw = DISC + b"\xff\xff\xff\xff" + b"\x01\x00\x02\x00"
    for engine, used in (("arrow", fields), ("native", fields[:1]), ("arrow", fields[1:])):
        row = decode_payload(spark.createDataFrame([(raw,)], "data BINARY"), used, engine=engine).first()
        assert "vec_len_capped" in row["decode_issues"]
    row = decode_payload(spark.createDataFrame([(raw,)], "data BINARY"), fields[:1], engine="native").first()
    assert row["v"] == [1, 2]


@pytest.mark.parametrize("engine", ["arrow", "native"])
def test_wide_integers_keep_their_digits(spark, engine):
    values = {
        "u128": [0, 1, 10**19, 10**38 - 1, 10**38, 2**127, 2**128 - 1, 3 * 10**38 + 7, 2**96 + 10**38],
        "i128": [0, -1, 10**38 - 1, 10**38, -(10**38), -(10**38) + 1, 2**127 - 1, -(2**127), -(2**127) + 2**64],
    }
    for kind, numbers in values.items():
        fields = [("n", parse_type(kind)), ("o", parse_type(f'{{"option":"{kind}"}}'))]
        rows = [(i, DISC + encode(kind, v) + b"\1" + encode(kind, v)) for i, v in enumerate(numbers)]
        for r in decode_payload(spark.createDataFrame(rows, "id INT, data BINARY"), fields, engine=engine).collect():
            v = numbers[r["id"]]
            if abs(v) < 10**38:
                assert r["n"] == r["o"] == v and r["decode_issues"] == []
            else:
                assert r["n"] is None and r["decode_issues"] == ["int128_overflow", *[f"int128_overflow={v}"] * 2]


def test_short_lists_keep_their_length(spark):
    fields = [("v", parse_type('{"vec":"u16"}')), ("w", parse_type('{"vec":"mystery"}'))]
    rows = [(0, DISC + b"\x03\0\0\0" + b"\5\0"), (1, DISC + b"\1\0\0\0\7\0" + b"\x09\0\0\0")]
    df = spark.createDataFrame(rows, "id INT, data BINARY")
    got = {r["id"]: (r["v"], r["w"], r["decode_issues"]) for r in decode_payload(df, fields, engine="arrow").collect()}
    assert got[0] == ([5], [], ["truncated", "vec_len_capped", "vec_len_capped=3"])
    assert got[1] == ([7], [], ["vec_len_capped", "vec_len_capped=9"])
    native = decode_payload(df, fields[:1], engine="native").collect()
    arrow = decode_payload(df, fields[:1], engine="arrow").collect()
    assert sorted(map(repr, native)) == sorted(map(repr, arrow))


def test_long_list_of_texts_is_read_in_one_pass():
    import time

    import pyarrow as pa

    from slotscribe.functions.payload import decode_batch

    n = 200_000
    raw = DISC + n.to_bytes(4, "little") + b"\0\0\0\0" * (n - 1) + b"\2\0\0\0ab"
    begin = time.perf_counter()
    (row,) = decode_batch(pa.array([raw]), [("w", parse_type('{"vec":"string"}'))]).to_pylist()
    assert time.perf_counter() - begin < 2
    assert len(row["w"]) == n and row["w"][-1] == "ab" and row["decode_issues"] == []


def test_bad_texts_among_many(spark):
    texts = [b"ok", b"\xff", "é".encode(), b"", b"\xc3"] * 40
    rows = [(i, DISC + len(t).to_bytes(4, "little") + t) for i, t in enumerate(texts)]
    got = {r["id"]: (r["s"], r["decode_issues"]) for r in decode_payload(spark.createDataFrame(rows, "id INT, data BINARY"), [("s", parse_type("string"))], engine="arrow").collect()}
    for i, t in enumerate(texts):
        assert got[i] == ((None, ["bad_utf8"]) if t in (b"\xff", b"\xc3") else (t.decode(), []))


@pytest.mark.parametrize(
    "text,label",
    [
        ("u64", "u64"), ('{"vec":"u8"}', "Vec<u8>"), ('{"option":{"vec":"u8"}}', "Option<Vec<u8>>"),
        ('{"array":["u8",32]}', "[u8; 32]"), ('{"array":["u8"]}', "array"), ('{"defined":"X"}', "complex"),
        ('{"defined":{"name":"OptionBool"}}', "OptionBool"), ('{"defined":{"name":"Y"}}', "complex"), ("mystery", "mystery"),
    ],
)
def test_type_labels(text, label):
    assert type_label(text) == label


def test_type_map():
    kinds = {t: spark_type(parse_type(t)).simpleString() for t in ("u64", "u32", "bool", "publicKey", "u128", '{"option":"u64"}', '{"vec":"u8"}')}
    assert kinds == {"u64": "decimal(20,0)", "u32": "bigint", "bool": "boolean", "publicKey": "string", "u128": "decimal(38,0)", '{"option":"u64"}': "decimal(20,0)", '{"vec":"u8"}': "array<int>"}

import os
import random

import numpy as np
import pyarrow as pa

from payloads import base58
from slotscribe.functions.base58 import base58_decode, base58_encode_key, decode_strings, encode_matrix


def test_keys_and_leading_zeros():
    keys = [os.urandom(32) for _ in range(300)] + [bytes(32), bytes(5) + os.urandom(27), b"\xff" * 32, bytes(31) + b"\1"]
    matrix = np.frombuffer(b"".join(keys), np.uint8).reshape(-1, 32)
    assert encode_matrix(matrix).to_pylist() == [base58(k) for k in keys]


def test_decode_any_length_and_bad_text():
    values = [os.urandom(random.randrange(300)) for _ in range(500)] + [b"", b"\0", bytes(40), b"\0\0\1", b"\xff" * 1232]
    texts = [base58(v) for v in values] + ["0OIl", "abc é", "1 1", None, ""]
    assert decode_strings(pa.array(texts)).to_pylist() == values + [b""] * 5
    assert decode_strings(pa.array(texts).slice(10, 50)).to_pylist() == values[10:60]


def test_in_spark(spark):
    df = spark.createDataFrame([(bytes(32),), (b"\1" * 31,), (None,)], "k binary").select(base58_encode_key("k").alias("t"))
    assert [r["t"] for r in df.collect()] == ["1" * 32, None, None]
    assert [bytes(r[0]) for r in df.select(base58_decode("t")).collect()] == [bytes(32), b"", b""]

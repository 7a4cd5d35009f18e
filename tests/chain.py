"""A small hand-made chain for the pipeline tests."""

import hashlib
import json
import random
import struct

from payloads import base58
from slotscribe.sources.blocks import block_schema

PROGRAM = base58(hashlib.sha256(b"program").digest())
OTHER = base58(hashlib.sha256(b"other").digest())
IDL = {
    "version": "0.1.0",
    "name": "shop",
    "address": PROGRAM,
    "instructions": [
        {"name": "buy", "args": [{"name": "amount", "type": "u64"}, {"name": "maxCost", "type": "u64"}]},
        {"name": "note", "args": [{"name": "text", "type": "string"}]},
        {"name": "bare"},
    ],
    "accounts": [
        {"name": "Locker", "type": {"kind": "struct", "fields": [{"name": "units", "type": "u64"}, {"name": "sealed", "type": "bool"}, {"name": "holder", "type": "publicKey"}]}},
    ],
}


def key(label: str) -> str:
    return base58(hashlib.sha256(label.encode()).digest())


def disc(text: str) -> bytes:
    return hashlib.sha256(text.encode()).digest()[:8]


def buy(amount, cost=1):
    return disc("global:buy") + struct.pack("<QQ", amount, cost)


def note(text):
    raw = text.encode()
    return disc("global:note") + struct.pack("<I", len(raw)) + raw


def locker(units, sealed=True, holder=bytes(32)):
    return disc("account:Locker") + struct.pack("<Q", units) + bytes([sealed]) + holder


def tx(signature, payloads, *, touched=(0,), err=None, keys=None, meta=True, parsed=None, program=PROGRAM, loaded=((), ())):
    keys = keys or [key("alice"), key("bob")]
    account_keys = [*keys, program, OTHER]
    at = len(keys)
    instructions = [{"program_id_index": at, "accounts": list(touched), "data": base58(p)} for p in payloads]
    instructions.insert(0, {"program_id_index": at + 1, "accounts": [], "data": base58(buy(999))})
    instructions.append({"program_id_index": 77, "accounts": [], "data": base58(buy(998))})
    return {
        "signatures": [signature] if signature else [],
        "account_keys": account_keys,
        "header": {"num_required_signatures": 1, "num_readonly_signed": 0, "num_readonly_unsigned": 2},
        "instructions": instructions,
        "meta": {"err": err, "loaded_writable": list(loaded[0]), "loaded_readonly": list(loaded[1])} if meta else None,
        "parsed": parsed,
    }


def block(slot, *txs):
    return {"slot": slot, "block_time": 1_700_000_000 + slot, "transactions": list(txs)}


def blocks_df(spark, blocks):
    lines = spark.createDataFrame([(json.dumps(b),) for b in blocks], "value string")
    from pyspark.sql import functions as F

    return lines.select(F.from_json("value", block_schema()).alias("b")).select("b.*")


def sample_blocks(slots=range(100, 130), seed=1):
    rng = random.Random(seed)
    out = []
    for slot in slots:
        if slot % 7 == 3:
            continue
        txs = [
            tx(f"sig{slot}a", [buy(slot), buy(slot + 1), note(f"n{slot}")], touched=(0, 1, 9)),
            tx(f"sig{slot}b", [note("é" * rng.randrange(3))], err='{"InstructionError":[0,"Custom"]}' if slot % 2 else None),
            tx(f"other{slot}", [buy(5)], program=key("elsewhere")),
        ]
        if slot % 5 == 0:
            txs.append(tx(f"sig{slot}c", [b"\0" * 8, b"\1\2\3", disc("global:bare")]))
        out.append(block(slot, *txs))
    return out

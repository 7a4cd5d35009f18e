"""Independent, plain-Python encoder and reader used to check the Spark decoders."""

import json
import struct
from decimal import Decimal

ALPHABET = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
WIDTH = {"bool": 1, "u8": 1, "u16": 2, "u32": 4, "u64": 8, "u128": 16, "i8": 1, "i16": 2, "i32": 4, "i64": 8, "i128": 16, "f32": 4, "f64": 8, "publicKey": 32, "pubkey": 32}


def base58(raw: bytes) -> str:
    number, text = int.from_bytes(raw, "big"), ""
    while number:
        number, digit = divmod(number, 58)
        text = ALPHABET[digit] + text
    return "1" * (len(raw) - len(raw.lstrip(b"\0"))) + text


def encode(ty, value) -> bytes:
    if isinstance(ty, str):
        if ty == "string":
            raw = value.encode()
            return struct.pack("<I", len(raw)) + raw
        if ty == "bytes":
            return struct.pack("<I", len(value)) + value
        if ty in ("publicKey", "pubkey"):
            return value
        if ty in ("f32", "f64"):
            return struct.pack("<f" if ty == "f32" else "<d", value)
        return int(value).to_bytes(WIDTH[ty], "little", signed=ty.startswith("i"))
    if "vec" in ty:
        return struct.pack("<I", len(value)) + b"".join(encode(ty["vec"], v) for v in value)
    if "option" in ty:
        return b"\0" if value is None else b"\1" + encode(ty["option"], value)
    if "array" in ty:
        return b"".join(encode(ty["array"][0], v) for v in value)
    if "fields" in ty:
        return b"".join(encode(f["type"], value[f["name"]]) for f in ty["fields"])
    return bytes.fromhex(value["raw_hex"])


def expected(ty, raw: bytes, pos: int):
    """(value, next position) by the reading rules; lists stop at items that consume nothing."""
    if isinstance(ty, str):
        if ty in WIDTH:
            w = WIDTH[ty]
            if pos + w > len(raw):
                return None, pos
            b = raw[pos : pos + w]
            if ty == "bool":
                return b != b"\0", pos + w
            if ty in ("publicKey", "pubkey"):
                return base58(b), pos + w
            if ty in ("f32", "f64"):
                return struct.unpack("<f" if ty == "f32" else "<d", b)[0], pos + w
            n = int.from_bytes(b, "little", signed=ty[0] == "i")
            if ty in ("u64", "u128", "i128"):
                n = None if abs(n) >= 10**38 else Decimal(n)
            return n, pos + w
        if ty in ("string", "bytes"):
            if pos + 4 > len(raw):
                return (None if ty == "string" else b""), pos
            n = int.from_bytes(raw[pos : pos + 4], "little")
            pos += 4
            if pos + n > len(raw):
                return None, pos
            b = raw[pos : pos + n]
            if ty == "string":
                try:
                    b = b.decode()
                except UnicodeDecodeError:
                    b = None
            return b, pos + n
        return None, pos
    if "vec" in ty or "array" in ty:
        pad = "array" in ty
        if pad:
            n = ty["array"][1]
        else:
            n, pos = (0, pos) if pos + 4 > len(raw) else (int.from_bytes(raw[pos : pos + 4], "little"), pos + 4)
        items = []
        for _ in range(n):
            value, after = expected(ty["array"][0] if pad else ty["vec"], raw, pos)
            if after == pos and not pad:
                break
            items.append(value)
            pos = after
        return items, pos
    if "option" in ty:
        if pos + 1 > len(raw):
            return None, pos
        return expected(ty["option"], raw, pos + 1) if raw[pos] else (None, pos + 1)
    if "defined" in ty:
        rest = raw[pos:]
        if isinstance(ty["defined"], dict) and ty["defined"].get("name") == "OptionBool":
            return (rest == b"\1" if len(rest) == 1 else None), len(raw)
        return ({"raw_hex": rest.hex()} if rest else None), len(raw)
    if "fields" in ty:
        out = {}
        for f in ty["fields"]:
            out[f["name"]], pos = expected(f["type"], raw, pos)
        return out, pos
    return None, pos


def type_text(ty) -> str:
    return ty if isinstance(ty, str) else json.dumps(ty)

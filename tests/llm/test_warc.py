import gzip
import hashlib
import io
import random
import zlib

import pyarrow as pa
import pytest
from helpers import awkward, rows

from slotscribe.llm import warc as op

PAGES = "page_id bigint, url string, html string, payload__ string, offset string"


def pages(spark, given):
    return spark.createDataFrame([(i, u, h, "x", "y") for i, u, h in given], PAGES)


def expected(given):
    best = {}
    for i, _, h in given:
        if i is not None and len((h or "").encode()) >= 1000:
            best[h] = max(best.get(h, i), i)
    out = []
    for i, _, h in given:
        data, keeper = (h or "").encode(), best.get(h)
        revisit = keeper is not None and keeper != i
        out.append((i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if revisit else "response", keeper if revisit else None))
    return sorted(out, key=lambda r: tuple((x is None, str(x)) for x in r))


def test_round_trip_with_hot_payloads_and_odd_rows(spark):
    rng = random.Random(5)
    texts = awkward() + ["".join(rng.choice("abc é\r\n") for _ in range(rng.randrange(3000))) for _ in range(40)]
    given = [(i, f"http://h/{i}", t) for i, t in enumerate(texts)]
    given += [(1_000 + i, None, "hot " * 400) for i in range(200)] + [(5_000 + i, "u v\n", "cold") for i in range(20)]
    given += [(7, "again", texts[8]), (7, "again", texts[8]), (None, None, "hot " * 400), (None, None, "n" * 2000), (None, None, "n" * 2000), (-4, "", "WARC/1.1\r\n\r\n" * 200)]
    # A repeated row with the largest page_id of its payload.
    given += [(9_000, "r", "twice " * 300)] * 2 + [(8_999, "r", "twice " * 300)]
    assert rows(op.report(pages(spark, given).repartition(6))) == expected(given)


def test_empty_table(spark):
    assert op.report(pages(spark, [])).collect() == []


@pytest.mark.parametrize("range_bytes", [700, 5_000, 1 << 20])
def test_every_record_has_one_owner_whatever_the_ranges(spark, tmp_path, range_bytes):
    rng = random.Random(1)
    given = [(i, f"http://h/{i}", " ".join(str(rng.random()) for _ in range(rng.randrange(200)))) for i in range(120)]
    path = f"{tmp_path}/a"
    op.write(pages(spark, given).repartition(3), path)
    records = op.read(spark, path, range_bytes=range_bytes)
    assert rows(records.selectExpr("record_id", "target_uri", "cast(payload as string)")) == sorted((f"<urn:page:{i}>", u, h) for i, u, h in given)
    assert op.gaps(records).collect() == []


def test_plain_gzip_reads_what_is_written(spark, tmp_path):
    op.write(pages(spark, [(1, "u", "text " * 300), (2, "v", "text " * 300)]).coalesce(1), f"{tmp_path}/a")
    file = next(p for p in (tmp_path / "a").iterdir() if p.name.startswith("part-") and p.stat().st_size)
    content = gzip.decompress(file.read_bytes())
    assert content.count(b"WARC/1.1\r\n") == 2 and content.count(b"text " * 300) == 1 and b"WARC-Refers-To: <urn:page:2>" in content


def stored(data):
    packer = zlib.compressobj(0, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def resource(data):
    return b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x>\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(data), data)


def test_archives_inside_records_and_chance_magic_are_not_records():
    inner = b"".join(op.member(resource(b"inner %d" % i)) for i in range(5))
    noise = bytes(random.Random(2).randrange(256) for _ in range(3000)) + op.MAGIC + b"\x00" * 40
    outer = [stored(resource(inner + noise)), stored(resource(op.MAGIC * 50)), op.member(resource(b"last"))]
    data, want, at = b"".join(outer), [], 0
    for m in outer:
        want.append((at, at + len(m)))
        at += len(m)
    for step in (len(data), 2_000, 1_200):
        got = [x for s in range(0, len(data), step) for x in op.owned(io.BytesIO(data), s, min(s + step, len(data)), len(data))]
        assert got == want, step


def test_damage_leaves_a_gap(spark, tmp_path):
    members = [op.member(resource(b"record %d " % i * 50)) for i in range(6)]
    broken = bytearray(members[3])
    broken[len(broken) // 2] ^= 0xFF
    (tmp_path / "x.warc.gz").write_bytes(b"".join([*members[:3], bytes(broken), *members[4:]]))
    records = op.read(spark, str(tmp_path))
    assert records.count() == 5
    assert [(r["after"], r["offset"]) for r in op.gaps(records).collect()] == [(sum(map(len, members[:3])), sum(map(len, members[:4])))]


def test_payload_of_other_kinds():
    fields, block = op.parse(resource(b"a\r\n\r\nb"))
    assert op.payload_of(fields, block) == b"a\r\n\r\nb"
    assert pa.array([op.payload_of({"warc-type": "revisit"}, b"")]).null_count == 1

"""WARC archives: write pages as records, read archives back in byte ranges.

Writing. Every record is one gzip member. A payload that occurs more than once
is stored once, with the largest page_id; the other records revisit it. Members
are rows of Spark's text writer, so any file system Spark writes to will do and
the commit of a task decides what counts. That writer ends every row with a
separator, here an empty gzip member, which decompresses to nothing (the files
end in ``.txt``; readers of archives go by content).

Reading is splittable. A task takes byte ranges of files, looks for the magic of
gzip, and tries each place it finds: the member there has to decompress, with a
right checksum, and to begin with the header of a record. A range owns the
records that start inside it and reads past its end to finish the last one. From
a valid member on, members follow each other, so chance hits inside one are never
tried. An archive stored inside a record looks like members too; its chain ends
at bytes that are no member, and is then dropped. ``gaps`` lists bytes that no
record covers, for archives from elsewhere. Workers open files through pyarrow
(local, HDFS, S3 and others that it knows).

Only the 40 digits of a payload's digest and a page_id are shuffled to find
repeated payloads, with partial sums, so a payload that a third of all pages
share costs a row per task. Payloads themselves move only if so many are
repeated that their digests are no longer broadcast (``BROADCAST_DIGESTS``).

Defined results: NULL html is an empty payload; a NULL url gives no target URI;
NULL page_ids count below all others and are NULL again when read, and among
equal payloads that all lack one, each is a response. Rows that repeat a page_id are
separate records; if it is the largest of its payload, all of them are responses.
A record is held whole by the task that writes or reads it, up to Arrow's 2 GB.
Empty tables give an archive without records and no rows. Other columns are not read.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_batches, shared_dir, stage

# The magic of a gzip member and the profile of a revisit.
MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
# Payloads below this many bytes are always stored.
LEAST_REVISIT = 1_000
# Repeated digests up to which they are broadcast: some 120 bytes each, 12 MB in all.
BROADCAST_DIGESTS = 100_000
# Bytes read from a file at a time, bytes of payload in a batch that leaves a task.
READ_BYTES, BATCH_BYTES = 1 << 18, 1 << 22

RECORD = (
    "path string, offset bigint, length bigint, record_type string, record_id string, target_uri string, date string, "
    "refers_to string, declared_digest string, headers map<string,string>, payload binary"
)


def member(data: bytes) -> bytes:
    """``data`` as one gzip member, the same bytes every time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


SEPARATOR = member(b"")


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, date: str) -> bytes:
    """A page as the bytes of a response, or of a revisit when it refers to another page."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + payload if refers_to is None else http
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def repeated_payloads(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """(digest__, keeper__): payloads of ``least`` bytes or more that several rows have, and the largest page_id of each."""
    sized = pages.where(F.octet_length("payload__") >= least).select("page_id", F.sha1("payload__").alias("digest__"))
    found = sized.groupBy("digest__").agg(F.max("page_id").alias("keeper__"), F.count(F.lit(1)).alias("rows__"))
    return found.where("rows__ > 1 and keeper__ is not null").drop("rows__")


def write(pages: DataFrame, path: str, *, least: int = LEAST_REVISIT, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write (page_id, url, html) as archives below ``path``, one file per task."""
    pages = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload__"))
    repeated = stage(repeated_payloads(pages, least), "warc-digests")
    if repeated.limit(BROADCAST_DIGESTS + 1).count() <= BROADCAST_DIGESTS:
        repeated = F.broadcast(repeated)
    known = pages.withColumn("digest__", F.sha1("payload__")).join(repeated, "digest__", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("keeper__")), F.col("keeper__"))
    rows = known.select("page_id", "url", "payload__", "digest__", refers.alias("refers__"))

    def make():
        def pack(batch: pa.RecordBatch) -> Iterator[list]:
            for i in range(batch.num_rows):
                yield [[member(record(*(c[i].as_py() for c in batch.columns), date))]]

        return pack

    packed = map_batches(rows, make, "member binary")
    # The text writer puts the bytes of a string down as they are; the encoding is that of the separator.
    raw = packed.select(F.col("member").cast("string").alias("value"))
    raw.write.option("encoding", "ISO-8859-1").option("lineSep", SEPARATOR.decode("latin-1")).text(path)


def inflate(file, start: int, keep: bool = True) -> tuple[bytes, int] | None:
    """Content of the gzip member at an offset (its first bytes unless ``keep``) and the offset after it; None if there is none."""
    file.seek(start)
    unpacker, parts, fed, held = zlib.decompressobj(31), [], 0, 0
    while not unpacker.eof:
        data = file.read(READ_BYTES)
        if not data:
            return None
        fed += len(data)
        while data and not unpacker.eof:
            try:
                out = unpacker.decompress(data, BATCH_BYTES)
            except zlib.error:
                return None
            data = unpacker.unconsumed_tail
            if keep or held < 16:
                parts.append(out if keep else out[:16])
                held += len(out)
    return b"".join(parts), start + fed - len(unpacker.unused_data)


def is_record(content: bytes) -> bool:
    """Whether the content of a member begins like a record, or is empty."""
    return not content or content.startswith(b"WARC/")


def magic_at(file, start: int, end: int) -> int | None:
    """The first place of the magic that starts in ``[start, end)``."""
    while start < end:
        file.seek(start)
        data = file.read(min(READ_BYTES, end - start) + len(MAGIC) - 1)
        found = data.find(MAGIC)
        if found >= 0:
            return start + found
        start += READ_BYTES
    return None


def chain(file, start: int, end: int, size: int) -> tuple[list[tuple[int, int]], int]:
    """Members from ``start`` on that follow each other and begin before ``end``, and where they stop."""
    found = []
    while start < min(end, size) and (got := inflate(file, start, keep=False)) and is_record(got[0]):
        found.append((start, got[1]))
        start = got[1]
    return found, start


def owned(file, start: int, end: int, size: int) -> list[tuple[int, int]]:
    """(offset, end) of the members that start in a range.

    A chain that stops inside the range at bytes other than a magic belongs to
    an archive stored in a record and is dropped, except from the start of the file.
    """
    members, at = [], start
    while (at := magic_at(file, at, end)) is not None:
        found, stop = chain(file, at, end, size)
        file.seek(stop)
        if found and (at == 0 or stop >= min(end, size) or file.read(len(MAGIC)) == MAGIC):
            members += found
            at = max(stop, at + 1)
        else:
            at += 1
    return members


def parse(content: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block of a record."""
    head, _, rest = content.partition(b"\r\n\r\n")
    fields = {}
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        name, _, value = line.partition(":")
        fields[name.strip().lower()] = value.strip()
    length = fields.get("content-length", "")
    return fields, rest[: int(length)] if length.isdigit() else rest


def payload_of(fields: dict[str, str], block: bytes) -> bytes | None:
    """What a record carries: the body of a web answer, or the whole block; None for revisits."""
    if fields.get("warc-type") == "revisit":
        return None
    return block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block


def ranges(spark: SparkSession, path: str, range_bytes: int | None = None) -> DataFrame:
    """(path, size, start, end): byte ranges of all files below a path, dealt evenly over tasks.

    Unless stated, a range is as long as Spark would make a split.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", F.col("length").alias("size")).where("size > 0")
    if range_bytes is None:
        total = files.agg(F.sum("size")).first()[0] or 0
        most, least = (int(spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(f"spark.sql.files.{x}"))) for x in ("maxPartitionBytes", "openCostInBytes"))
        range_bytes = min(most, max(least, total // spark.sparkContext.defaultParallelism))
    cut = files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("size") - 1, F.lit(range_bytes).cast("bigint"))).alias("start"))
    cut = cut.withColumn("end", F.least(F.col("start") + range_bytes, "size"))
    return cut.repartition(max(1, cut.count()))


def read(spark: SparkSession, path: str, *, range_bytes: int | None = None) -> DataFrame:
    """All records of the archives below a path (``RECORD``).

    ``length`` counts the bytes to the next record. Digests are as declared, without their
    algorithm's name.
    """

    def make():
        def scan(batch: pa.RecordBatch) -> Iterator[list]:
            for path, size, start, end in zip(*(c.to_pylist() for c in batch.columns)):
                system, name = fs.FileSystem.from_uri(path)
                rows, held = [], 0
                with system.open_input_file(name) as file:
                    for offset, stop in owned(file, start, end, size):
                        content, _ = inflate(file, offset)
                        if not content:
                            continue
                        # Empty members after a record count as part of it.
                        while stop < size and (after := inflate(file, stop, keep=False)) and not after[0]:
                            stop = after[1]
                        fields, block = parse(content)
                        get = fields.get
                        payload = payload_of(fields, block)
                        rows.append((
                            path, offset, stop - offset, get("warc-type"), get("warc-record-id"), get("warc-target-uri"), get("warc-date"),
                            get("warc-refers-to"), get("warc-payload-digest", "").rpartition(":")[2] or None, list(fields.items()), payload,
                        ))
                        held += len(payload or b"") + 500
                        if held > BATCH_BYTES:
                            yield list(map(list, zip(*rows)))
                            rows, held = [], 0
                if rows:
                    yield list(map(list, zip(*rows)))

        return scan

    return map_batches(ranges(spark, path, range_bytes), make, RECORD)


def gaps(records: DataFrame) -> DataFrame:
    """(path, after, offset): stretches between records of one file that no record covers, or that two cover."""
    before = Window.partitionBy("path").orderBy("offset")
    ends = records.select("path", "offset", F.lag(F.col("offset") + F.col("length"), 1, 0).over(before).alias("after"))
    return ends.where("offset <> after").select("path", "after", "offset")


def resolved(records: DataFrame) -> DataFrame:
    """Record type, ids, and size and digest of the full payload: a response's own as read, a revisit's from the record it refers to.

    A revisit whose payload is not in the archives has neither.
    """
    own = records.select("record_type", "record_id", "refers_to", "declared_digest", F.octet_length("payload").cast("bigint").alias("n"), F.sha1("payload").alias("d"))
    own = stage(own, "warc-records")
    full = own.where("n is not null").groupBy(F.col("record_id").alias("refers_to"), F.col("d").alias("declared_digest")).agg(F.max("n").alias("n"))
    full = full.withColumn("d", F.col("declared_digest"))
    revisits = own.where("record_type = 'revisit'").drop("n", "d").join(full, ["refers_to", "declared_digest"], "left")
    return own.where("record_type <> 'revisit'").unionByName(revisits).select("record_type", "record_id", "refers_to", F.col("n").alias("payload_bytes"), F.col("d").alias("payload_digest"))


def report(pages: DataFrame) -> DataFrame:
    """Every page as its archive gives it back."""
    spark = pages.sparkSession
    path = f"{shared_dir(spark)}/corpus/warc-{uuid.uuid4().hex}"
    write(pages, path)
    page = lambda c: F.regexp_extract(c, r"<urn:page:(-?\d+)>", 1).try_cast("bigint")
    return resolved(read(spark, path)).select(
        page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to")
    )

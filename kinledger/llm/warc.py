"""WARC: a writer with revisits, and a reader that salvages damaged archives.

Archives are written and read through Spark's own sinks and sources, so any store that Spark
reaches will do. Each record is a gzip member; the text sink's separator between rows is
an empty gzip member, so a file is a plain multi-member gzip. Files are kept to
``records_per_file`` records, since a reader task holds one file's bytes.

The reader takes compressed and plain archives. It checks each member (deflate data,
CRC, size) and each record (version line, headers, Content-Length, closing blank lines,
payload digest). After a failed check it looks for the next member or version line that
passes, goes on from there, and logs the bytes between as a quarantined gap. The content of a
member is searched in the same way, so a bad record costs itself alone. What inflates of a
damaged member is kept, but its bytes are unchecked: there only a record whose payload digest
agrees passes.

Null payloads are empty, a null page_id is written as an empty one and read as null, and so
is a null url. Of pages with equal payloads, that with the least page_id is the response
and all others revisit it; rows that repeat this page are responses too. Without any
page_id there is nothing to refer to, and all are responses. A page without a page_id whose payload has a
response revisits it. Very long payloads are one record like others; other columns are left out.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, scratch_path, table, written

#: Payloads of at least so many bytes are written once.
LEAST_BYTES = 0
RECORDS_PER_FILE = 4000
_ID = "urn:kinledger:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY_MEMBER = bytes.fromhex("1f8b080000000000000303000000000000000000")
_VERSION = re.compile(rb"WARC/1\.[01]\r\n")
#: Headers that end later than this aren't looked for; lengths have at most 18 digits, so they fit a long.
HEAD_BYTES = 1 << 16
_NUMBER = re.compile(r"[0-9]{1,18}")
_HTTP = re.compile(rb"HTTP/[^\r\n]*\r\n(?:[^\r\n]+\r\n)*\r\n")


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in bare upper-case base32: four times 40 bits, digits renamed."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 10 * i + 1, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _line(text: str) -> bytes:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", text).encode()


def record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC record: an HTTP response, or a revisit that holds its head alone."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    head = [
        b"WARC/1.1",
        b"WARC-Type: " + (b"response" if refers_to is None else b"revisit"),
        f"WARC-Record-ID: <{_ID}{'' if page_id is None else page_id}>".encode(),
        b"WARC-Date: 1970-01-01T00:00:00Z",
        *([b"WARC-Target-URI: " + _line(url)] if url is not None else []),
        f"WARC-Payload-Digest: sha1:{digest}".encode(),
        *([f"WARC-Refers-To: <{_ID}{refers_to}>".encode(), b"WARC-Profile: " + _PROFILE.encode()] if refers_to is not None else []),
        b"Content-Type: application/http; msgtype=response",
        b"Content-Length: %d" % len(block),
    ]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def write_warc(pages: DataFrame, path: str, *, least_bytes: int = LEAST_BYTES, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write a record for each row of ``pages`` (page_id, url, payload: binary)."""
    known = pages.select("page_id", "url", F.coalesce("payload", F.lit(b"")).alias("payload"))
    known = known.withColumn("digest", base32_sha1(F.col("payload")))
    often = known.where(F.length("payload") >= least_bytes).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("first_id"))
    # written first: if it is small, payloads needn't be shuffled to meet it
    digests = written(often.where("n > 1 and first_id is not null").drop("n"), "warc-digests")
    known = known.join(digests, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("refers_to")

    def pack(batches):
        for batch in batches:
            columns = (batch[c] for c in ("page_id", "url", "payload", "digest", "refers_to"))
            members = []
            for row in zip(*columns):
                pack = zlib.compressobj(6, zlib.DEFLATED, 31)
                members.append(pack.compress(record(*(x.as_py() for x in row))) + pack.flush())
            yield pa.RecordBatch.from_arrays([pa.array(members, pa.binary())], ["value"])

    packed = known.select("page_id", "url", "payload", "digest", refers).mapInArrow(pack, "value binary")
    # the cast keeps bytes as they are, and the separator is their Latin-1 reading
    sink = packed.select(F.col("value").cast("string")).write.option("encoding", "ISO-8859-1")
    sink.option("lineSep", _EMPTY_MEMBER.decode("latin-1")).option("maxRecordsPerFile", records_per_file).text(path)
    discard(pages.sparkSession, digests)


class Damage(Exception):
    """A failed check."""


def _member(data: memoryview, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, where it ends, and what is wrong with it; of a damaged
    member what inflates, and where that ends."""
    unpack, out, pos, step = zlib.decompressobj(31), [], at, 65536
    while not unpack.eof:
        if pos >= len(data):
            return b"".join(out) + unpack.flush(), len(data), "truncated member"
        try:
            out.append(unpack.decompress(data[pos : pos + step]))
        except zlib.error as e:
            if step == 1:
                return b"".join(out), pos, f"bad member: {e}"
            # again to this piece, and through it byte by byte
            unpack, step = zlib.decompressobj(31), 1
            out = [unpack.decompress(data[at:pos])]
            continue
        pos += step
    return b"".join(out), min(pos, len(data)) - len(unpack.unused_data), None


def _record(data: bytes, at: int) -> tuple[dict, int]:
    """The record at ``at``, checked, and where it ends."""
    if not _VERSION.match(data, at):
        raise Damage("no version line")
    head_end = data.find(b"\r\n\r\n", at, at + HEAD_BYTES)
    if head_end < 0:
        raise Damage("no end of headers")
    fields = {}
    for line in data[at:head_end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            raise Damage("bad header")
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not _NUMBER.fullmatch(fields.get("content-length", "")) or "warc-type" not in fields:
        raise Damage("no length or type")
    start = head_end + 4
    end = start + int(fields["content-length"])
    if data[end : end + 4] != b"\r\n\r\n":
        raise Damage("no end of record")
    payload, size = data[start:end], end - start
    if "application/http" in fields.get("content-type", "") and (http := _HTTP.match(payload)):
        payload = payload[http.end() :]
        told = re.search(rb"(?im)^content-length:[ \t]*([0-9]{1,18})[ \t]*\r$", http[0])
        size = int(told[1]) if told and fields["warc-type"] == "revisit" else len(payload)
    digest = fields.get("warc-payload-digest", "")
    told = digest.startswith("sha1:") and fields["warc-type"] != "revisit"
    if told and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest[5:]:
        raise Damage("digest differs")
    return {"fields": fields, "payload": payload, "payload_bytes": size, "told": told}, end + 4


def _within(content: bytes, sound: bool) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """As ``salvage``, for the content of a member, with bytes of the content."""
    at, gap, reason = 0, None, ""
    while at < len(content):
        try:
            one, end = _record(content, at)
            if not sound and not one["told"]:
                raise Damage("no digest in a damaged member")
        except Damage as e:
            if gap is None:
                gap, reason = at, str(e)
            at = content.find(b"WARC/1.", at + 1)
            at = len(content) if at < 0 else at
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        yield at, end, one, None
        at = end
    if gap is not None:
        yield gap, len(content), None, reason


def salvage(data: bytes) -> Iterator[tuple[int, int, dict | None, str | None]]:
    """(start, end, record, None) for each record and (start, end, None, reason) for each gap, in order.

    Starts and ends are bytes of ``data``; records of one gzip member, and gaps between them, share
    them. The reason of such a gap names its bytes of the content. A damaged member of which
    records were kept is a gap besides.
    """
    view, at, gap, reason = memoryview(data), 0, None, ""
    known: dict[bytes, int] = {}

    def mark(what: bytes, after: int) -> int:
        """Where ``what`` stands next; a place found once is remembered until it is passed."""
        if known.get(what, -1) < after:
            found = data.find(what, after)
            known[what] = len(data) if found < 0 else found
        return known[what]

    while at < len(data):
        found, wrong, end, plain = [], None, at, at + 1
        if data[at : at + 2] == b"\x1f\x8b":
            content, end, wrong = _member(view, at)
            found = list(_within(content, wrong is None))
            kept = any(one for _, _, one, _ in found)
            if wrong is None and found and not kept:
                if gap is None:
                    gap, reason = at, found[0][3]
                at = end
                continue
            if wrong and kept:
                plain = max(end, at + 1)  # what inflated isn't looked for again as plain bytes
        else:
            try:
                one, end = _record(data, at)
                found = [(0, 0, one, None)]
            except Damage as e:
                wrong, kept = str(e), False
        if wrong:
            after = min(mark(b"\x1f\x8b\x08", at + 1), mark(b"WARC/1.", plain))
            if kept:
                if gap is not None:
                    yield gap, at, None, reason
                yield from ((at, after, one, None) for _, _, one, _ in found if one)
                gap = None
            if gap is None:
                gap, reason = at, wrong
            at = after
            continue
        if gap is not None:
            yield gap, at, None, reason
            gap = None
        for start, stop, one, why in found:
            yield at, end, one, why and f"{why}, bytes {start} to {stop} of the content"
        at = end
    if gap is not None:
        yield gap, len(data), None, reason


_READ = (
    "file string, start long, `end` long, is_gap boolean, reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, payload_digest string, payload_bytes long, payload binary"
)


def read_warc(spark: SparkSession, path: str, *, payloads: bool = True) -> DataFrame:
    """A row for each record that passes its checks and for each quarantined gap (is_gap, reason),
    with file and bytes. Without ``payloads``, payload is null; the digest is of the payload
    that was read, and a revisit's is the one it names."""
    kinds = [pa.string(), pa.int64(), pa.int64(), pa.bool_(), *[pa.string()] * 6, pa.int64(), pa.binary()]
    names = ["file", "start", "end", "is_gap", "reason", "record_type", "record_id", "refers_to", "target_uri", "payload_digest", "payload_bytes", "payload"]

    def rows(file: str, data: bytes):
        for start, end, one, reason in salvage(data):
            if one is None:
                yield (file, start, end, True, reason, *[None] * 7)
                continue
            fields, payload = one["fields"], one["payload"]
            revisit = fields["warc-type"] == "revisit"
            digest = fields.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
            ids = (fields.get(k, "").strip("<>") or None for k in ("warc-record-id", "warc-refers-to"))
            yield (file, start, end, False, None, fields["warc-type"], *ids, fields.get("warc-target-uri"), digest, one["payload_bytes"], payload if payloads else None)

    def parse(batches):
        for batch in batches:
            for file, data in zip(batch["path"], batch["content"]):
                held: list[tuple] = []
                for row in rows(file.as_py(), data.as_py()):
                    held.append(row)
                    if len(held) == 500:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held), kinds)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(parse, _READ)


def records(read: DataFrame) -> DataFrame:
    return read.where("not is_gap").drop("is_gap", "reason")


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: file, start, end, reason."""
    return read.where("is_gap").select("file", "start", "end", "reason")


def page_of(record_id: Column) -> Column:
    return F.regexp_extract(record_id, f"^{_ID}(-?[0-9]+)$", 1).try_cast("long")


def op1_warc(spark, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages").select("page_id", "url", F.col("html").cast("binary").alias("payload")), path)
    read = records(read_warc(spark, path, payloads=False))
    return read.select(page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", page_of(F.col("refers_to")).alias("refers_to"))


OP1_SQL = """
WITH page AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
named AS (
  SELECT page_id, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i // 4 AS INTEGER) * 5 + 1, 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest
  FROM page),
least AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM named)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id IS NOT DISTINCT FROM first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM least
"""

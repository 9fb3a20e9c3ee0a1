"""WARC archives: a writer that stores equal payloads once, and a reader that salvages.

The writer makes one record per page, ``response`` or, for a payload that another
page holds too, ``revisit``; archives are files of bounded size. The reader
checks every record (version line, header, length, end, digests). After a failed
check it searches for the next gzip member or version line that begins a valid
record, goes on from there and reports the bytes between as a gap. A gzip member
is decompressed as far as it goes and searched in the same way; its records and
gaps have the member's place in the file and their own in the decompressed bytes.

Null html is an empty payload, a null url becomes the record's own name. Null
page ids are archived as ``none`` and read back as null; beside other ids of the
same payload they are revisits. Rows that repeat the id and the payload of a
response are responses too. A file without bytes holds nothing.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ragloom.llm.common import byte_view, table, utf8
from ragloom.llm.registry import query
from ragloom.session import broadcast_within, scratch_path, written


@dataclass(frozen=True)
class WarcParams:
    min_bytes: int = 0  # payloads from this size on are stored once
    block_bytes: int = 4 << 20  # archive files are closed at this size
    gzip: bool = False  # one gzip member per record
    date: str = "2024-01-01T00:00:00Z"  # of the records
    role_bytes: int = 64 << 20  # sets of repeated payloads up to this size are sent to the pages


END = b"\r\n\r\n"
#: An empty gzip member, which stands between members where a file has line ends.
NOTHING = gzip.compress(b"", mtime=0)
VERSION = re.compile(rb"WARC/1\.[01]\r\n")
SIGN = re.compile(rb"WARC/1\.[01]\r\n|\x1f\x8b\x08")
NAME = "urn:ragloom:page:"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


@F.arrow_udf(T.StringType())
def payload_digest(payload: pa.Array) -> pa.Array:
    data, offsets = byte_view(payload)
    return pa.array([base32_sha1(data[a:b].tobytes()) for a, b in zip(offsets, offsets[1:])], pa.string())


# -- one record --------------------------------------------------------------


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to, revisit: bool, date: str) -> bytes:
    """The bytes of a record without the two line ends that close it."""
    name = f"{NAME}{'none' if page_id is None else page_id}"
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url) if url else name
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
        f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(body)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{NAME}{refers_to}>"]
    return "\r\n".join(head).encode() + END + body


class Broken(Exception):
    """What a check found."""


def parsed(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header, block and end of the record that begins at ``at``; all checks are made."""
    version = VERSION.match(data, at)
    if not version:
        raise Broken("no version line")
    close = data.find(END, version.end() - 2)
    if close < 0:
        raise Broken("header without end")
    head: dict[str, str] = {}
    for line in data[version.end() : close].split(b"\r\n"):
        key, colon, value = line.partition(b":")
        if not colon:
            raise Broken("header line without colon")
        head[key.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    if not head.get("content-length", "").isascii() or not head.get("content-length", "").isdigit():
        raise Broken("no content length")
    start = close + len(END)
    stop = start + int(head["content-length"])
    if stop > len(data):
        raise Broken("truncated block")
    if data[stop : stop + 4] != END:
        raise Broken("record without end")
    block = data[start:stop]
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise Broken("block digest differs")
    if head.get("warc-type") == "response" and "warc-payload-digest" in head:
        if head["warc-payload-digest"] != f"sha1:{base32_sha1(http_payload(block))}":
            raise Broken("payload digest differs")
    return head, block, stop + len(END)


def http_payload(block: bytes) -> bytes:
    return block.partition(END)[2]


def inflated(data: bytes, at: int) -> tuple[bytes, int, str]:
    """The bytes of the gzip member that begins at ``at`` as far as they go, where it ends or breaks, and what broke."""
    unzip, view, out, step = zlib.decompressobj(31), memoryview(data), [], 1 << 16
    while at < len(data):
        before = unzip.copy() if step > 1 else unzip
        try:
            out.append(unzip.decompress(view[at : at + step]))
        except zlib.error:
            if step == 1:
                return b"".join(out), at, "gzip member damaged"
            unzip, step = before, step >> 8  # nearer to the break
            continue
        at = min(at + step, len(data))
        if unzip.eof:
            return b"".join(out), at - len(unzip.unused_data), ""
    return b"".join(out), at, "gzip member truncated"


def salvage(data: bytes, zipped: bool = True) -> Iterator[tuple]:
    """Yield ("record", offset, size, "", header, block, inner) and ("gap", offset, size, reason, None, None, inner).

    ``inner`` is None, or the offset and size in the decompressed bytes of the gzip
    member that offset and size then stand for; the size is None where it broke off.
    """
    at, lost, reason, rescued, decoded = 0, -1, "", [], 0

    def passed(end: int) -> Iterator[tuple]:
        """What lies between two valid records: a gap, or a broken member with what was found in it."""
        for kind, inner, why, head, block in rescued or [("gap", None, reason, None, None)]:
            yield kind, lost, end - lost, why, head, block, inner

    while at < len(data):
        found, end, failed = [], at, ""
        if zipped and data[at : at + 2] == b"\x1f\x8b":
            inner, end, failed = inflated(data, at)
            found = [(kind, (a, n), why, head, block) for kind, a, n, why, head, block, _ in salvage(inner, False)]
            if failed and all(f[0] == "gap" for f in found):
                found = []
            if failed and found:
                found.append(("gap", (len(inner), None), failed, None, None))
        else:
            try:
                head, block, end = parsed(data, at)
                found = [("record", None, "", head, block)]
            except Broken as broken:
                failed = str(broken)
        # stored blocks of a broken member show its records a second time
        again = at < decoded and found and all(f[0] == "gap" or f[3:] in [r[3:] for r in rescued] for f in found)
        if found and not again:
            if lost >= 0:
                yield from passed(at)
                lost, rescued = -1, []
            if not failed:
                for kind, inner, why, head, block in found:
                    yield kind, at, end - at, why, head, block, inner
            else:
                lost, reason, rescued, decoded = at, failed, found, end
        elif not found and not failed:  # an empty member
            if lost >= 0:
                yield from passed(at)
                lost, rescued = -1, []
        elif lost < 0:
            lost, reason = at, failed
        if failed or again:
            following = (SIGN if zipped else VERSION).search(data, at + 1)
            at = following.start() if following else len(data)
        else:
            at = end
    if lost >= 0:
        yield from passed(len(data))


# -- tables ------------------------------------------------------------------


def roles(pages: DataFrame, params: WarcParams) -> DataFrame:
    """page_id, url, payload, digest, and for revisits the page that holds the payload."""
    rows = pages.select("page_id", "url", utf8(F.col("html")).alias("payload"))
    rows = rows.withColumn("digest", payload_digest("payload"))
    groups = rows.filter(F.length("payload") >= params.min_bytes).groupBy("digest")
    shared = groups.agg(F.max("page_id").alias("held_by"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    shared = written(shared, "warc-shared")
    shared = broadcast_within(shared, shared.count(), 96, params.role_bytes)
    return rows.join(shared, "digest", "left").withColumn("revisit", F.col("held_by").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("held_by")))


def write_archives(pages: DataFrame, path: str, params: WarcParams = WarcParams()) -> None:
    """Write a record per page to archive files below ``path``."""

    def blocks(batches):
        held, size = [], 0
        for batch in batches:
            for r in batch.to_pylist():
                made = record(r["page_id"], r["url"], r["payload"], r["digest"], r["held_by"], r["revisit"], params.date)
                held.append(gzip.compress(made + END, mtime=0) if params.gzip else made)
                size += len(held[-1])
                if size >= params.block_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["value"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([between.join(held)], pa.binary())], ["value"])

    between = b"" if params.gzip else END
    made = roles(pages, params).select("page_id", "url", "payload", "digest", "held_by", "revisit").mapInArrow(blocks, "value binary")
    # the text writer copies the bytes and closes each block with what WARC asks for between records
    writer = made.select(F.col("value").cast("string")).write.option("maxRecordsPerFile", 1)
    if params.gzip:
        writer.option("encoding", "ISO-8859-1").option("lineSep", NOTHING.decode("latin-1")).text(path)
    else:
        writer.option("lineSep", END.decode()).text(path)


FOUND = (
    "kind string, file string, offset long, size long, inner_offset long, inner_size long, reason string, record_type string, uri string, page_id long,"
    " refers_to long, payload_bytes long, payload_digest string, payload binary"
)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records and gaps of all archive files below ``path``; a file is read by one task."""

    def page(name: str | None) -> int | None:
        value = (name or "").strip("<>").removeprefix(NAME)
        return int(value) if re.fullmatch(r"-?\d+", value) else None

    def read(batches):
        for batch in batches:
            for file, data in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                rows, size = [], 0
                for kind, offset, n, reason, head, block, inner in salvage(data.as_py()):
                    row = {"kind": kind, "file": file, "offset": offset, "size": n, "reason": reason}
                    row |= dict(zip(("inner_offset", "inner_size"), inner or (None, None)))
                    if kind == "record":
                        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", block.partition(END)[0])
                        row |= {
                            "record_type": head.get("warc-type"), "uri": head.get("warc-target-uri"), "page_id": page(head.get("warc-record-id")),
                            "refers_to": page(head.get("warc-refers-to")), "payload_bytes": int(length[1]) if length else len(http_payload(block)),
                            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:"), "payload": http_payload(block),
                        }
                    rows.append(row)
                    size += n if inner is None else len(block or b"")
                    if size > 4 << 20:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows, size = [], 0
                yield pa.RecordBatch.from_pylist(rows, schema)

    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(T.StructType.fromDDL(FOUND))
    files = spark.read.format("binaryFile").load(path).filter("length > 0").select("path", "content")
    return files.mapInArrow(read, FOUND)


def records(found: DataFrame) -> DataFrame:
    return found.filter("kind = 'record'").drop("kind", "reason")


def gaps(found: DataFrame) -> DataFrame:
    """The quarantine log: the bytes that belong to no valid record: file, place in it and in its decompressed member, reason."""
    return found.filter("kind = 'gap'").select("file", "offset", "size", "inner_offset", "inner_size", "reason")


@query(
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h, sha1(coalesce(html, '')) AS x FROM pages),
    g AS (SELECT *, max(page_id) OVER (PARTITION BY x) AS held FROM p)
    SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               1 + ((CAST('0x' || substr(x, CAST(5 * (i // 4) + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = held THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = held THEN NULL ELSE held END AS refers_to
    FROM g
    """
)
def op2_warc(spark, sf_dir):
    """All pages written to archives and read back."""
    path = scratch_path(spark, "warc")
    write_archives(table(spark, sf_dir, "pages"), path)
    found = records(read_archives(spark, path))
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")

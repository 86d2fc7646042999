"""WARC records in seekable Zstandard bundles."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import maybe_broadcast, stored, tidy

#: Fixed values of the seekable Zstandard format.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
BUNDLE = "bundle_id string, data binary, records array<struct<record_id:string,page_id:long,frame:int,offset:long,length:long>>"


def seek_table(frames: list[tuple[int, int, int]]) -> bytes:
    """The skippable footer frame of (compressed size, size, checksum) entries."""
    body = b"".join(struct.pack("<III", *f) for f in frames) + struct.pack("<IBI", len(frames), 0x80, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed size, checksum) of each frame, from the footer alone."""
    count, flags, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE or flags & 0x7C:
        raise ValueError("not a seekable bundle")
    width = 12 if flags & 0x80 else 8
    at, start, out = len(data) - 9 - count * width, 0, []
    if at < 8 or struct.unpack("<II", data[at - 8 : at]) != (SKIPPABLE, count * width + 9):
        raise ValueError("bad seek table")
    for i in range(count):
        entry = struct.unpack("<III" if width == 12 else "<II", data[at + i * width : at + (i + 1) * width])
        out.append((start, entry[0], entry[2] if width == 12 else -1))
        start += entry[0]
    return out


def _checksum(data: bytes) -> int:
    import xxhash

    return xxhash.xxh64(data).intdigest() & 0xFFFFFFFF


def read_frame(data: bytes, table: list[tuple[int, int, int]], frame: int) -> bytes:
    """One frame, read on its own and tested against its checksum."""
    import zstandard

    start, size, check = table[frame]
    out = zstandard.ZstdDecompressor().decompress(data[start : start + size])
    if check >= 0 and _checksum(out) != check:
        raise ValueError(f"bad checksum in frame {frame}")
    return out


def record_id(page_id, digest: str, url: str) -> str:
    """A record's identifier; rows that repeat a page share it."""
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'{page_id}|{digest}|{url}'.encode()).digest(), version=4)}>"


def write_record(page_id, url: str | None, payload: bytes, refers_to, date: str = "1970-01-01T00:00:00Z") -> tuple[str, bytes]:
    """(record id, WARC/1.1 record): a response, or a revisit without its payload if ``refers_to`` is a page."""
    url = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "about:blank")
    sha = hashlib.sha1(payload)
    name = record_id(page_id, sha.hexdigest(), url)
    block = HTTP + (payload if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name}", f"WARC-Target-URI: {url}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(sha.digest()).decode()}", "Content-Type: application/http; msgtype=response", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    if refers_to is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page-ID: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(headers, payload) of a record; a response's payload is tested against its digest."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/1."):
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    size = int(fields["Content-Length"])
    block = rest[:size]
    if len(block) != size or rest[size:] != b"\r\n\r\n":
        raise ValueError("bad record length")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response" and fields["WARC-Payload-Digest"] != "sha1:" + base64.b32encode(hashlib.sha1(payload).digest()).decode():
        raise ValueError("bad payload digest")
    return fields, payload


def bundle_pages(pages: DataFrame, min_revisit: int = 1000, frame_bytes: int = 256 << 10, bundle_bytes: int = 8 << 20, level: int = 3) -> DataFrame:
    """Rows BUNDLE: the records of ``pages`` (page_id, url, html) in seekable Zstandard bundles.

    Each bundle is a run of independent frames of about ``frame_bytes`` of records and a footer seek table; ``records``
    maps each record's identifier to its frame and its offset and length in the frame's plain bytes.  Of pages with equal
    payloads of at least ``min_revisit`` bytes, that with the largest page_id is a response and the others are revisits;
    shorter ones are all responses.

    Every task bundles what it reads; the table of repeated digests is pre-aggregated, and the pages are shuffled only if
    it is too large to broadcast.  Cases: null html is an empty payload, null url about:blank; rows that share the largest
    page_id are all responses; a null page_id counts as the smallest, and pages that all have none are all responses;
    pages of any length have a record whole, longer ones a frame alone; extra columns are ignored; an empty table gives
    no bundles.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    keyed = pages.withColumn("_sha", F.when(F.octet_length("html") >= min_revisit, F.unhex(F.sha1("html"))))
    again = keyed.where("_sha is not null").groupBy("_sha", F.octet_length("html").alias("_size")).agg(F.max("page_id").alias("_first"), F.count("*").alias("n"))
    again = stored(again.where("n > 1").select("_sha", "_size", "_first"), "warc-again")
    joined = keyed.join(maybe_broadcast(again.select(F.col("_sha").alias("_s"), "_size", "_first")), (F.col("_sha") == F.col("_s")) & (F.octet_length("html") == F.col("_size")), "left")
    refers = F.when(F.col("_first").isNotNull() & ~F.coalesce(F.col("page_id") == F.col("_first"), F.lit(False)), F.col("_first"))
    joined = joined.select("page_id", "url", "html", refers.alias("refers"))

    def run(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=level)
        frames, table, index, frame, held, size = [], [], [], [], 0, 0

        def close_frame():
            nonlocal frame, held, size
            if frame:
                raw = b"".join(frame)
                data = packer.compress(raw)
                frames.append(data)
                table.append((len(data), len(raw), _checksum(raw)))
                frame, held, size = [], 0, size + len(data)

        def close_bundle():
            nonlocal frames, table, index, size
            row = pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([b"".join(frames) + seek_table(table)], pa.binary()), pa.array([index], kind)], ["bundle_id", "data", "records"])
            frames, table, index, size = [], [], [], 0
            return row

        kind = pa.list_(pa.struct([("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())]))
        for batch in batches:
            for page, url, html, refers_to in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw = html.as_buffer()
                name, record = write_record(page, url, bytes(raw) if raw is not None else b"", refers_to)
                if held and held + len(record) > frame_bytes:
                    close_frame()
                    if size >= bundle_bytes:
                        yield close_bundle()
                index.append({"record_id": name, "page_id": page, "frame": len(frames), "offset": held, "length": len(record)})
                frame.append(record)
                held += len(record)
        close_frame()
        if frames:
            yield close_bundle()

    return joined.mapInArrow(tidy(run), BUNDLE)


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, record_id string, bundle_id string, frame int, offset long"


def read_bundles(bundles: DataFrame) -> DataFrame:
    """Rows PAGE: every record of a table BUNDLE, found by its frame-relative offset and parsed from the frame's bytes.

    A response's digest is that of the payload read back; a revisit's digest and length are those in its headers.
    """

    def run(batches):
        for batch in batches:
            for bundle, value, entries in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                data = value.as_py()
                table, now, plain = read_seek_table(data), -1, b""
                cols: list[list] = [[] for _ in range(9)]
                for e in entries.as_py():
                    if e["frame"] != now:
                        now, plain = e["frame"], read_frame(data, table, e["frame"])
                    head, payload = parse_record(plain[e["offset"] : e["offset"] + e["length"]])
                    if head["WARC-Record-ID"] != e["record_id"]:
                        raise ValueError("the index names another record")
                    own = head["WARC-Type"] == "response"
                    digest = hashlib.sha1(payload).hexdigest() if own else base64.b32decode(head["WARC-Payload-Digest"][5:]).hex()
                    size = len(payload) if own else int(head["X-Payload-Length"])
                    row = (int(head["X-Page-ID"]) if head["X-Page-ID"] else None, size, digest, head["WARC-Type"], None if own else int(head["X-Refers-To-Page-ID"]), e["record_id"], bundle, e["frame"], e["offset"])
                    for col, v in zip(cols, row, strict=True):
                        col.append(v)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], [x.split()[0] for x in PAGE.split(", ")])

    return bundles.select("bundle_id", "data", "records").mapInArrow(tidy(run), PAGE)

"""WARC archives as seekable Zstandard bundles.

Records are written one after another into independent Zstandard frames of about
``frame_bytes``; frames make a bundle of about ``bundle_bytes``, closed by a skippable
frame with the seek table (sizes of all frames). An index maps each record identifier
to its bundle, its frame and the offset inside the unpacked frame, so that one record
is read by unpacking one frame.

Bundles are rows (bundle_id, archive, index) of a Parquet table, so they live in any
store that Spark reaches and a lost task is simply rewritten. ``archive`` is a
complete .warc.zst file.

Records of equal payload share one response: that with the largest page_id; the others
are revisits that carry no payload. Equality is by SHA-256 and length.
WARC-Date is a parameter, since pages carry no time of their own.

Each copy of a repeated row has a record identifier of its own; where a payload's largest
page_id is repeated, its revisits name that page but no single record. Reading checks every
response's payload against the digest in its header.

Defined cases: a null html is an empty payload; payloads below ``min_bytes`` are always
responses; a null page_id orders below all others and stays null; repeated rows that
hold the largest page_id of their payload are responses all; a null url has no target
header, control characters and spaces in a url are percent-encoded; an empty table
gives no bundle; other columns are ignored. A record longer than a frame has a frame
of its own.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import materialize, small_side

INDEX = "array<struct<record_id: string, page_id: bigint, frame: int, frame_start: bigint, frame_bytes: bigint, offset: bigint, length: bigint>>"
BUNDLE = f"bundle_id string, archive binary, index {INDEX}"
RECORD = "record_id string, page_id long, record_type string, target_uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
# Fixed values of the seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC = 0x184D2A5E, 0x8F92EAB1
_END = b"\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def seek_table(sizes: list[tuple[int, int]]) -> bytes:
    """sizes: packed and unpacked bytes of each frame."""
    body = b"".join(struct.pack("<II", *s) for s in sizes) + struct.pack("<IBI", len(sizes), 0, SEEKABLE_MAGIC)
    return struct.pack("<II", SKIPPABLE_MAGIC, len(body)) + body


def frame_ranges(archive: bytes) -> list[tuple[int, int, int]]:
    """Start, packed and unpacked bytes of each frame, by the seek table at the end."""
    count, flags, magic = struct.unpack("<IBI", archive[-9:])
    if magic != SEEKABLE_MAGIC or flags & 0x7F:
        raise ValueError("no seek table")
    entry = 12 if flags & 0x80 else 8
    at, start, out = len(archive) - 9 - count * entry, 0, []
    for k in range(count):
        packed, plain = struct.unpack_from("<II", archive, at + k * entry)
        out.append((start, packed, plain))
        start += packed
    return out


def _uuid(hexed: str) -> str:
    return f"<urn:uuid:{hexed[:8]}-{hexed[8:12]}-{hexed[12:16]}-{hexed[16:20]}-{hexed[20:32]}>"


def _record(row: dict, date: str, place: str) -> tuple[str, bytes]:
    record_id = _uuid(hashlib.md5(f"{row['record_key']}:{place}".encode()).hexdigest() if row["repeated"] else row["record_key"])
    revisit = row["is_revisit"]
    block = _HTTP + (b"" if revisit else row["payload"])
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id}",
        f"WARC-Date: {date}",
        "WARC-Payload-Digest: sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode(),
        f"X-Payload-Length: {row['payload_bytes']}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if row["page_id"] is not None:
        head.append(f"X-Page-ID: {row['page_id']}")
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if row["refers_key"] is not None:
            head.append(f"WARC-Refers-To: {_uuid(row['refers_key'])}")
        if row["refers_to"] is not None:
            head.append(f"X-Refers-To-Page: {row['refers_to']}")
    return record_id, "\r\n".join(head).encode() + _END + block + _END


def write_bundles(pages: DataFrame, min_bytes: int = 0, frame_bytes: int = 256 << 10, bundle_bytes: int = 4 << 20, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """pages (page_id, url, html) -> bundles (bundle_id, archive, index), not yet written."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload")).withColumns(
        {"payload_bytes": F.octet_length("payload").cast("long"), "same": F.unhex(F.sha2("payload", 256))}
    )
    copies = (
        rows.filter(F.col("payload_bytes") >= min_bytes)
        .groupBy("same", "payload_bytes", "page_id")
        .agg(F.count("*").alias("c"))
        .groupBy("same", "payload_bytes")
        .agg(F.max("page_id").alias("keeper"), F.sum("c").alias("n"), F.max_by("c", F.struct(F.col("page_id").isNotNull(), "page_id")).alias("keepers"), F.max("c").alias("most"))
        .filter("n > 1")
    )
    copies = small_side(materialize(copies, "warc-copies"))  # payloads that occur once need no entry
    key = lambda page: F.md5(F.concat_ws("|", F.coalesce(page.cast("string"), F.lit("-")), F.hex("same")).cast("binary"))
    revisit = F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    single = F.col("keepers") == 1
    # where a page's payload is repeated, the copies' identifiers take the place of writing in
    repeated = (F.col("most") > 1) & ~(single & F.col("page_id").eqNullSafe(F.col("keeper")))
    known = rows.join(copies, ["same", "payload_bytes"], "left").select(
        F.coalesce(repeated, F.lit(False)).alias("repeated"), "page_id", "url", "payload_bytes", F.sha1("payload").alias("sha1"), key(F.col("page_id")).alias("record_key"), revisit.alias("is_revisit"),
        F.when(revisit & single, key(F.col("keeper"))).alias("refers_key"), F.when(revisit, F.col("keeper")).alias("refers_to"),
        F.when(~revisit, F.col("payload")).alias("payload"),
    )

    def bundles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, written = TaskContext.get().partitionId(), 0, 0
        pack = zstandard.ZstdCompressor(level=3)
        done, sizes, index = bytearray(), [], []
        frame, inside = bytearray(), []

        def close_frame() -> None:
            if frame:
                packed = pack.compress(bytes(frame))
                index.extend({**x, "frame": len(sizes), "frame_start": len(done), "frame_bytes": len(packed)} for x in inside)
                sizes.append((len(packed), len(frame)))
                done.extend(packed)
                frame.clear()
                inside.clear()

        def close_bundle() -> pa.RecordBatch:
            nonlocal made
            close_frame()
            row = {"bundle_id": f"{part:06d}-{made:06d}", "archive": bytes(done) + seek_table(sizes), "index": list(index)}
            made += 1
            done.clear()
            sizes.clear()
            index.clear()
            return pa.RecordBatch.from_pylist([row], schema=arrow)

        for batch in batches:
            for row in (r for at in range(0, batch.num_rows, 256) for r in batch.slice(at, 256).to_pylist()):
                record_id, raw = _record(row, date, f"{part}:{written}")
                written += 1
                if frame and len(frame) + len(raw) > frame_bytes:
                    close_frame()
                    if len(done) >= bundle_bytes:
                        yield close_bundle()
                inside.append({"record_id": record_id, "page_id": row["page_id"], "offset": len(frame), "length": len(raw)})
                frame += raw
        if frame or done:
            yield close_bundle()

    arrow = pa.schema(
        [("bundle_id", pa.string()), ("archive", pa.binary()), ("index", pa.list_(pa.struct([
            ("record_id", pa.string()), ("page_id", pa.int64()), ("frame", pa.int32()), ("frame_start", pa.int64()),
            ("frame_bytes", pa.int64()), ("offset", pa.int64()), ("length", pa.int64())])))]
    )
    return known.mapInArrow(bundles, BUNDLE)


def parse_record(raw: bytes, at: int = 0) -> tuple[dict, int]:
    """The record that starts at ``at``, and where the next one starts."""
    split = raw.index(_END, at)
    lines = raw[at:split].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record")
    head = dict(x.split(": ", 1) for x in lines[1:])
    block = raw[split + 4 : split + 4 + int(head["Content-Length"])]
    payload = block[block.index(_END) + 4 :]
    number = lambda name: int(head[name]) if name in head else None
    full = head["WARC-Type"] == "response"
    digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
    if full and base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
        raise ValueError(f"payload of {head['WARC-Record-ID']} doesn't match its digest")
    return {
        "record_id": head["WARC-Record-ID"], "page_id": number("X-Page-ID"), "record_type": head["WARC-Type"], "target_uri": head.get("WARC-Target-URI"),
        "payload_bytes": len(payload) if full else number("X-Payload-Length"), "payload_digest": digest,
        "refers_to": number("X-Refers-To-Page"), "payload": payload if full else None,
    }, split + 4 + int(head["Content-Length"]) + 4


def _record_schema(with_payload: bool) -> tuple[pa.Schema, str]:
    ddl = RECORD if with_payload else RECORD.removesuffix(", payload binary")
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))]), ddl


def read_records(bundles: DataFrame, with_payload: bool = True) -> DataFrame:
    """All records of the bundles, read from the archives' bytes alone."""
    schema, ddl = _record_schema(with_payload)

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for archive in batch.column(0):
                raw = archive.as_py()
                for start, packed, plain in frame_ranges(raw):
                    frame, at, out = unpack.decompress(raw[start : start + packed], max_output_size=plain), 0, []
                    while at < len(frame):
                        record, at = parse_record(frame, at)
                        out.append({k: record[k] for k in schema.names})
                    yield pa.RecordBatch.from_pylist(out, schema=schema)

    return bundles.select("archive").mapInArrow(records, ddl)


def fetch_records(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """The records of the page ids in wanted (page_id): only their frames are unpacked.

    The index picks bundles and frames first; archives without a wanted record are not read on.
    """
    schema, ddl = _record_schema(True)
    hits = (
        bundles.select("bundle_id", F.explode("index").alias("i"))
        .select("bundle_id", "i.*")
        .join(wanted.select("page_id").distinct(), "page_id", "left_semi")
        .groupBy("bundle_id")
        .agg(F.collect_list(F.struct("frame_start", "frame_bytes", "offset")).alias("hits"))  # at most a bundle's own records
    )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for archive, own in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw, frames, out = archive.as_py(), {}, []
                for hit in own:
                    start = hit["frame_start"]
                    if start not in frames:
                        frames[start] = unpack.decompressobj().decompress(raw[start : start + hit["frame_bytes"]])
                    out.append(parse_record(frames[start], hit["offset"])[0])
                yield pa.RecordBatch.from_pylist(out, schema=schema)

    return bundles.select("bundle_id", "archive").join(hits, "bundle_id").select("archive", "hits").mapInArrow(records, ddl)


def round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write the archives to the shared folder, then read them back."""
    return read_records(materialize(write_bundles(pages, min_bytes), "warc-bundles"), with_payload=False)

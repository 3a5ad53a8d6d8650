import base64
import hashlib
import re

import pytest
import zstandard

from cadenza.llm import warc

ROWS = [(1, "http://a/x y\n", "same"), (5, None, "same"), (2, "http://b/", None), (3, "http://c/", ""), (4, "http://d/", "é" * 300_000), (None, "u", "only"), (None, "u", "same"), (9, "r", "twice"), (9, "r", "twice")]


def brute(rows, least=0):
    for page, _, html in rows:
        data = (html or "").encode()
        twins = [r[0] for r in rows if (r[2] or "").encode() == data]
        keeper = max((p for p in twins if p is not None), default=None)
        revisit = len(data) >= least and len(twins) > 1 and page != keeper
        yield page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", keeper if revisit else None


def rows_of(df):
    return sorted(map(str, [(r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()]))


def test_round_trip(spark):
    pages = spark.createDataFrame([(*r, 0) for r in ROWS], "page_id long, url string, html string, same int")
    assert rows_of(warc.round_trip(pages)) == sorted(map(str, brute(ROWS)))
    assert rows_of(warc.round_trip(pages, min_bytes=5)) == sorted(map(str, brute(ROWS, 5)))
    assert warc.round_trip(pages.limit(0)).count() == 0


def test_archives_are_plain_zstandard_and_seekable(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", f"page {i} " * 50) for i in range(400)], "page_id long, url string, html string").coalesce(1)
    bundles = warc.materialize(warc.write_bundles(pages, frame_bytes=4096, bundle_bytes=1 << 14), "t")
    for b in bundles.collect():
        raw = bytes(b.archive)
        frames = warc.frame_ranges(raw)
        assert len(frames) > 1 or bundles.count() == 1
        plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
        assert len(plain) == sum(f[2] for f in frames)
        for i in b["index"]:
            frame = zstandard.ZstdDecompressor().decompress(raw[i.frame_start : i.frame_start + i.frame_bytes], max_output_size=1 << 20)
            record, end = warc.parse_record(frame, i.offset)
            assert record["record_id"] == i.record_id and record["page_id"] == i.page_id and end - i.offset == i.length
    got = warc.fetch_records(bundles, spark.createDataFrame([(7,), (399,), (1000,)], "page_id long")).collect()
    assert {r.page_id: bytes(r.payload).decode() for r in got} == {7: "page 7 " * 50, 399: "page 399 " * 50}


def test_on_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    want = brute([(r.page_id, r.url, r.html) for r in pages.collect()])
    assert rows_of(warc.round_trip(pages)) == sorted(map(str, want))


def test_every_record_has_an_identifier_of_its_own(spark):
    rows = ROWS + [(None, "u", "again")] * 3 + [(7, "v", "again")] + [(8, "v", "both")] * 2 + [(6, "w", "both")]
    bundles = warc.materialize(warc.write_bundles(spark.createDataFrame(rows, "page_id long, url string, html string")), "t")
    ids = [i.record_id for b in bundles.collect() for i in b["index"]]
    assert len(ids) == len(set(ids)) == len(rows)
    raw = b"".join(zstandard.ZstdDecompressor().stream_reader(bytes(b.archive), read_across_frames=True).read() for b in bundles.collect())
    for refers in re.findall(rb"WARC-Refers-To: (\S+)", raw):
        assert refers.decode() in ids
    assert raw.count(b"X-Refers-To-Page: 8") == 1 and raw.count(b"WARC-Refers-To: ") < raw.count(b"X-Refers-To-Page: ")
    assert rows_of(warc.read_records(bundles)) == sorted(map(str, brute(rows)))


def test_a_spoilt_payload_is_noticed(spark):
    bundle = warc.write_bundles(spark.createDataFrame([(1, "http://h/", "abc")], "page_id long, url string, html string")).first()
    start, packed, plain = warc.frame_ranges(bytes(bundle.archive))[0]
    frame = zstandard.ZstdDecompressor().decompress(bytes(bundle.archive)[start : start + packed], max_output_size=plain)
    assert warc.parse_record(frame)[0]["payload"] == b"abc"
    with pytest.raises(ValueError, match="digest"):
        warc.parse_record(frame.replace(b"abc", b"abd"))

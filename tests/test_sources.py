"""FASTA in all line ends, streams, JSON lines and greedy batches."""

import json

import pytest

from cadenza.functions.sequence import sequence_status
from cadenza.operators.intervals import greedy_batches
from cadenza.sources.fasta import checked_records, read_fasta, write_jsonl
from cadenza.streaming.ingest import fasta_stream, write_stream


def read(spark, tmp_path, text, name="x.faa"):
    (tmp_path / name).write_bytes(text.encode())
    return sorted((r.record_id, r.sequence) for r in read_fasta(spark, str(tmp_path / name)).collect())


@pytest.mark.parametrize("end", ["\n", "\r\n", "\r"])
def test_line_ends_and_white_space(spark, tmp_path, end):
    lines = ["", "\t", ">a  first one ", "\tAC ", "", "dE*", "  >b\tx", " FG\t", ">c", "HIK", ""]
    assert read(spark, tmp_path, end.join(lines)) == [("a", "ACDE"), ("b", "FG"), ("c", "HIK")]
    assert checked_records(read_fasta(spark, str(tmp_path / "x.faa"))).count() == 3


@pytest.mark.parametrize("text", ["ACD\n>a\nACD\n", "\n\nACD\n>a\nACD", ">a\nACD\n>\nACD\n", ">a\nACD\n>a\nACD\n", ">a\nAC D\n", ">a\nAC*D\n", ">a\nACD**\n", ">a\n\n", "", ">a\n" + "A" * 2047])
def test_bad_files_are_refused(spark, tmp_path, text):
    (tmp_path / "bad.faa").write_text(text)
    with pytest.raises(ValueError, match="invalid records"):
        checked_records(read_fasta(spark, str(tmp_path / "bad.faa")))


def test_no_line_end_is_let_through(spark):
    df = spark.createDataFrame([("ACD\r",), ("ACD\n",), ("ACD",)], "s string")
    assert [r[0] for r in df.select(sequence_status(df.s)).collect()] == ["noncanonical", "noncanonical", "ok"]


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.faa").write_text(">a\r\nACD\r\n>b\r\nAXD*\r\n")
    write_stream(fasta_stream(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "seen")).awaitTermination()
    assert sorted((r.record_id, r.sequence, r.status) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [("a", "ACD", "ok"), ("b", "AXD", "noncanonical")]


def test_jsonl_is_strict_and_sorted_at_every_depth(spark, tmp_path):
    kind = "z struct<b: double, a: array<struct<y: double, x: int>>>, k map<string, double>, a string"
    row = ((1.5, [(2.0, 1), (None, 2)]), {"q": 1.0, "p": 2.0}, None)
    assert write_jsonl(spark.createDataFrame([row, (None, None, "t")], kind), str(tmp_path / "o")) == 2
    lines = sorted(line for f in (tmp_path / "o").glob("part-*") for line in f.read_text().splitlines())
    assert lines[1] == '{"a":null,"k":{"p":2.0,"q":1.0},"z":{"a":[{"x":1,"y":2.0},{"x":2,"y":null}],"b":1.5}}'
    assert json.loads(lines[0]) == {"a": "t", "k": None, "z": None}
    for bad in (((float("nan"), []), {}, ""), ((1.0, [(float("inf"), 1)]), {}, ""), ((1.0, []), {"q": float("nan")}, "")):
        with pytest.raises(Exception, match="finite"):
            write_jsonl(spark.createDataFrame([bad], kind), str(tmp_path / "p"), overwrite=True)


def test_batches_are_greedy_over_one_order(spark):
    lengths = [8, 10, 12] + [n for n in (3, 50, 51, 90, 400) for _ in range(37)] + [5000]
    rows = [(f"r{k:03d}", n) for k, n in enumerate(lengths)]
    for budget, most in ((300, 2), (40_000, 16), (10**9, 5)):
        want, batch, held, widest = {}, -1, 0, 0
        for key, n in sorted(rows, key=lambda r: (r[1], r[0])):
            wide = max(widest, n + 2)
            if not held or held >= most or wide * wide * (held + 1) > budget:
                batch, held, wide = batch + 1, 0, n + 2
            held, widest = held + 1, wide
            want[key] = batch
        got = greedy_batches(spark.createDataFrame(rows, "record_id string, length int").repartition(5), budget, most)
        assert {r.record_id: r.batch for r in got.collect()} == want

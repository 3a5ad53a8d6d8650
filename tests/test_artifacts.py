"""Manifests, the contract, the audited sink, and duplicate ids in a stream."""

import hashlib
import json
import os
import signal
import subprocess
import sys
import textwrap
import time
from datetime import timedelta
from importlib import resources

import pytest
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.sources import artifacts as af
from cadenza.sources import sink
from cadenza.streaming import ingest


def sha(data):
    return hashlib.sha256(data).hexdigest()


@pytest.fixture
def folder(tmp_path):
    files = {"a.bin": b"alpha", "deep/b c.json": b"{}", "deep/er/d": b""}
    for name, data in files.items():
        (tmp_path / "art" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "art" / name).write_bytes(data)
    (tmp_path / "art" / "SHA256SUMS").write_text("".join(f"{sha(d)}  {n}\n" for n, d in files.items()))
    return tmp_path / "art"


def test_folder_equals_its_manifest(spark, folder):
    found = af.require_verified(spark, str(folder), str(folder / "SHA256SUMS")).collect()
    assert {r["name"]: (r.observed, r.size) for r in found} == {n: (sha(d), len(d)) for n, d in (("a.bin", b"alpha"), ("deep/b c.json", b"{}"), ("deep/er/d", b""))}


def test_missing_changed_and_surplus_files_are_named(spark, folder):
    (folder / "a.bin").write_bytes(b"alpha!")
    (folder / "deep" / "b c.json").unlink()
    (folder / "new").write_bytes(b"x")
    with pytest.raises(ValueError, match="changed a.bin, missing deep/b c.json, surplus new"):
        af.require_verified(spark, str(folder), str(folder / "SHA256SUMS"))
    status = af.verification(af.digests(spark, str(folder)), af.manifest(spark, str(folder / "SHA256SUMS"))).collect()
    assert {r["name"]: r.status for r in status} == {"a.bin": "changed", "deep/b c.json": "missing", "deep/er/d": "ok", "new": "surplus", "SHA256SUMS": "surplus"}


def test_bad_manifests_are_refused(spark, tmp_path):
    for text, words in ((f"{sha(b'')}  a\n{sha(b'')}  a\n", "listed twice: a"), ("xyz  a\n", "not a manifest line")):
        (tmp_path / "m").write_text(text)
        with pytest.raises(Exception, match=words):
            af.manifest(spark, str(tmp_path / "m")).collect()


def test_contract_feeds_the_calibrations():
    text = (resources.files("cadenza") / "assets" / "contract.json").read_bytes()
    values = json.loads(text)
    assert cal.SPECTRUM[13]["slope"] == values["spectrum"]["13"]["slope"] and (13, 35) == cal.LAYERS
    assert values["teacher_logit"] == list(cal.TEACHER_LOGIT)
    with pytest.raises(ValueError, match="digest mismatch"):
        af.contract_of(text + b" ", sha(text))
    with pytest.raises(ValueError, match="version"):
        af.contract_of(json.dumps({**values, "schema_version": "other"}).encode())
    with pytest.raises(ValueError, match="keys differ"):
        af.contract_of(json.dumps({**values, "more": 1}).encode())
    with pytest.raises(ValueError, match="layers differ"):
        af.contract_of(json.dumps({**values, "layers": [13]}).encode())


def test_rows_and_audit_appear_together(spark, tmp_path):
    (tmp_path / "in.txt").write_bytes(b"input")
    out, rows = str(tmp_path / "out"), spark.range(50).select("id", (F.col("id") / 4).alias("v")).repartition(3)
    audit = sink.write_audited(rows, out, [str(tmp_path / "in.txt")], more={"note": "é"})
    assert audit == sink.read_audit(spark, out) and audit["records"] == 50 and audit["note"] == "é"
    assert audit["input_sha256"] == {str(tmp_path / "in.txt"): sha(b"input")}
    parts = sorted(sha(f.read_bytes()) for f in (tmp_path / "out").glob("part-*"))
    assert audit["output_sha256"] == (parts[0] if len(parts) == 1 else sha("".join(parts).encode()))
    assert sorted(map(tuple, spark.read.schema("id long, v double").json(out).collect())) == [(i, i / 4) for i in range(50)]
    with pytest.raises(FileExistsError, match="refusing to overwrite"):
        sink.write_audited(rows, out)
    sink.write_audited(spark.range(3).toDF("id"), out, overwrite=True)
    assert spark.read.json(out).count() == 3 and sorted(p.name for p in tmp_path.iterdir()) == ["in.txt", "out"]


def test_a_failed_run_leaves_no_output_and_keeps_the_old_one(spark, tmp_path):
    out = str(tmp_path / "out")
    sink.write_audited(spark.range(3).toDF("id"), out)
    bad = spark.range(9).select(F.when(F.col("id") == 7, F.raise_error(F.lit("torn"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="torn"):
        sink.write_audited(bad, out, overwrite=True)
    assert spark.read.json(out).count() == 3 and sink.read_audit(spark, out)["records"] == 3
    with pytest.raises(Exception, match="torn"):
        sink.write_audited(bad, str(tmp_path / "new"))
    assert not (tmp_path / "new").exists() and (tmp_path / ".new.partial").exists()
    with pytest.raises(FileExistsError, match="partial"):
        sink.write_audited(spark.range(3).toDF("id"), str(tmp_path / "new"))
    assert sink.write_audited(spark.range(2).toDF("id"), str(tmp_path / "new"), overwrite=True)["records"] == 2


def test_a_killed_run_leaves_no_readable_output(tmp_path):
    out = tmp_path / "out"
    program = f"""
        import time
        from pyspark.sql import functions as F
        from cadenza.session import local_session
        from cadenza.sources.sink import write_audited
        spark = local_session(2, 2)
        slow = F.udf(lambda x: (time.sleep(0.05), x)[1], "long")
        write_audited(spark.range(0, 4000, 1, 8).select(slow("id").alias("id")), {str(out)!r})
    """
    run = subprocess.Popen([sys.executable, "-c", textwrap.dedent(program)], start_new_session=True, stdout=subprocess.DEVNULL, stderr=subprocess.DEVNULL)
    partial = tmp_path / ".out.partial"
    until = time.time() + 90
    while not list(partial.rglob("part-*")) and time.time() < until:
        time.sleep(0.2)
    os.killpg(run.pid, signal.SIGKILL)
    run.wait()
    assert partial.exists() and not out.exists() and not (partial / sink.AUDIT).exists()


def fasta(path, ids, age):
    path.write_text("".join(f">{i}\nACDEF\n" for i in ids))
    now = time.time() - age
    os.utime(path, (now, now))


def test_ids_of_earlier_batches_are_marked_across_a_restart(spark, tmp_path):
    """Two files in two micro-batches, then the query starts anew from its checkpoint with a third file."""
    folder, out, seen = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "seen")
    folder.mkdir()
    run = lambda: ingest.write_stream(ingest.mark_repeats(ingest.fasta_stream(spark, str(folder), 1)), out, seen).awaitTermination()
    fasta(folder / "1.faa", ["a", "b"], 300)
    fasta(folder / "2.faa", ["c", "a", "a"], 200)
    run()
    counts = lambda: sorted((r.record_id, r.occurrence) for r in spark.read.parquet(out).collect())
    assert counts() == [("a", 0), ("a", 1), ("a", 2), ("b", 0), ("c", 0)]
    fasta(folder / "3.faa", ["b", "d", "a"], 100)
    run()
    assert counts() == [("a", 0), ("a", 1), ("a", 2), ("a", 3), ("b", 0), ("b", 1), ("c", 0), ("d", 0)]


def test_a_repeated_id_stops_the_stream_by_name(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    fasta(folder / "1.faa", ["a", "b"], 300)
    fasta(folder / "2.faa", ["c", "b"], 200)
    rows = ingest.refuse_repeats(ingest.fasta_stream(spark, str(folder), 1), remember=timedelta(days=1))
    query = ingest.write_stream(rows, str(tmp_path / "out"), str(tmp_path / "seen"))
    with pytest.raises(Exception, match="duplicate record: b"):
        query.awaitTermination()
    assert sorted(r.record_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "b"]

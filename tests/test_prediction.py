"""FASTA in, composed JSON rows out."""

import json
import subprocess
import sys

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.plans.prediction import flatten_features, teacher_states, topology_control_z
from cadenza.plugins import one_to_one


def test_from_fasta_to_json(spark, tmp_path):
    n, draw = 160, np.random.default_rng(1)
    (tmp_path / "in.faa").write_text(">a\n" + "ACDEFGHIKLMNPQRSTVWY" * 8 + "\n>b\n" + "ACDEFGHIKLMNPQRSTVWY" * 8 + "\n")
    cells = []
    for name in "ab":
        for layer in cal.LAYERS:
            x = draw.random((n, n))
            if name == "a":
                for s in (20, 40, 60):
                    x[np.arange(n - s), np.arange(s, n)] += 4
            x = (x + x.T) / 2
            cells += [(name, layer, i, j, float(x[i, j])) for i in range(n) for j in range(n)]
    names = ["record_id", "layer", "i", "j", "v"]
    kinds = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
    pq.write_table(pa.table([pa.array(c, k) for c, k in zip(zip(*cells), kinds)], names=names), tmp_path / "cells.parquet")
    pq.write_table(pa.table({"record_id": ["a", "b"], "state_probability": [0.7, 0.2], "global_probability": [0.6, 0.3]}), tmp_path / "p.parquet")
    out = str(tmp_path / "out")
    command = [sys.executable, "-m", "cadenza", str(tmp_path / "in.faa"), out, "--affinities", str(tmp_path / "cells.parquet"), "--probabilities", str(tmp_path / "p.parquet"), "--quiet"]
    done = subprocess.run(command, capture_output=True, text=True, timeout=400)
    assert done.returncode == 0, done.stderr[-3000:]
    rows = {r["record_id"]: r for f in (tmp_path / "out").glob("part-*") for r in map(json.loads, f.read_text().splitlines())}
    assert rows.keys() == {"a", "b"} and list(rows["a"]) == sorted(rows["a"])
    a = rows["a"]
    assert a["status"] == "ok" and min(abs(a["wedge_call"]["period"] - p) for p in (10, 20, 40)) <= 0.5 and a["registration"]["units"]
    logit = lambda p: np.log(p / (1 - p))
    for name, state, whole in (("a", 0.7, 0.6), ("b", 0.2, 0.3)):
        r = rows[name]
        sz, gz = ((logit(p) - m) / s for p, (m, s) in ((state, cal.TEACHER_LOGIT), (whole, cal.GLOBAL_LOGIT)))
        base = 0.5 * sz + 0.5 * r["topology_control_z"]
        assert r["primary_score"] == pytest.approx(0.75 * base + 0.25 * gz) and r["discovery_score"] == pytest.approx((sz + gz) / 2)
        assert r["primary_score_field"] == "discovery_score" and r["evidence_status"].startswith("UNVERIFIED") and r["interpretation"]
        assert r["length_scope"] == {"above_evaluated_length": False, "evaluated": 1732, "maximum": 2046}
        layers = r["frozen_spectrum"]["layers"]
        assert layers.keys() == {"13", "35"} and r["frozen_spectrum"]["score"] == pytest.approx(np.mean([v["length_residual_z"] for v in layers.values()]))
        assert r["candidate_periods"] == sorted(r["candidate_periods"]) and r["teacher_state_summary"] is None
    assert a["wedge_call"]["period"] in a["candidate_periods"]
    audit = [json.loads(x) for f in (tmp_path / "out.audit").glob("part-*") for x in f.read_text().splitlines()]
    assert audit[0]["records"] == 2 and audit[0]["elapsed"] > 0


def test_control_z_and_features(spark):
    df = spark.createDataFrame([("a", None, 1.5), ("b", 0.5, 2.5)], "record_id string, topology_control_z double, topology_development_control_z double")
    assert [r[0] for r in df.select(topology_control_z(df)).collect()] == [1.5, 0.5]
    with pytest.raises(Exception, match="no finite topology control z: c"):
        spark.createDataFrame([("c", float("nan"))], "record_id string, topology_control_z double").select(topology_control_z(df.drop("topology_development_control_z"))).collect()
    features = spark.createDataFrame([({"b": [3.0], "a": [1.0, 2.0]},)], "f map<string, array<double>>")
    assert features.select(flatten_features(F.col("f"), ["a", "b"]).alias("v")).first().v == [1.0, 2.0, 3.0]
    with pytest.raises(Exception, match="missing"):
        features.select(flatten_features(F.col("f"), ["a", "c"]).alias("v")).collect()
    with pytest.raises(ValueError, match="unique"):
        flatten_features(F.col("f"), ["a", "a"])


def test_scores_are_one_row_a_record(spark):
    records = spark.createDataFrame([("a",), ("b",)], "record_id string")
    scores = lambda rows: one_to_one(records, spark.createDataFrame(rows, "record_id string, p double")).collect()
    assert sorted(map(tuple, scores([("b", 0.5), ("a", None)]))) == [("a", None), ("b", 0.5)]
    for rows, words in (([("a", 0.1)], "no scores: b"), ([("a", 0.1), ("b", 0.1), ("a", 0.2)], "more than once: a"), ([("a", 0.1), ("b", 0.1), ("c", 0.2)], "of no record: c"), ([("a", 0.1), ("b", 0.1), (None, 0.2)], "of no record: null")):
        with pytest.raises(Exception, match=words):
            scores(rows)


def test_teacher_states_of_tiles(spark):
    draw = np.random.default_rng(3)
    x = draw.normal(size=(70, 4)) * 2
    rows = [("a", s, c, p - s + 32, p - s + 32, float(x[p, c])) for s in (0, 64) for p in range(s, min(s + 64, 70)) for c in range(4)]
    logits = spark.createDataFrame(rows, "record_id string, core_start int, channel int, ti int, tj int, logit double")
    out = teacher_states(logits, spark.createDataFrame([("a", 70)], "record_id string, length int"), ["p", "q", "r"]).first()
    state = 1 / (1 + np.exp(-x[:, 0]))
    power = np.exp(x[:, 1:])
    assert out.state_probability == pytest.approx(state.mean()) and out.teacher_state_summary.q90_probability == pytest.approx(np.quantile(state, 0.9))
    assert [out.class_means[c] for c in "pqr"] == pytest.approx(list((power / power.sum(1, keepdims=True)).mean(0)))
    hits = state >= 0.5
    runs = max(len(r) for r in "".join("x" if h else " " for h in hits).split(" "))
    assert out.teacher_state_summary.longest_run_length == runs and out.teacher_state_summary.longest_run_fraction == pytest.approx(runs / 70)

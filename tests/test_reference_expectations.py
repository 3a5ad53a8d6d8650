"""Expectations of the scoring, interval and source operators on small inputs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import calibration as cal
from cadenza.functions import sequence as sq
from cadenza.functions import spectral as sp
from cadenza.operators import intervals as iv
from cadenza.operators import matrices as mx
from cadenza.operators import wedge as wg
from cadenza.sources import fasta


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_score_composition_golden_row(spark):
    cols = cal.compose_score(F.lit(0.04407732159566165), F.lit(-0.6031273763779167), F.lit(0.08955977693987165), cal.TEACHER_LOGIT, cal.GLOBAL_LOGIT)
    got = one(spark, *[v.alias(k) for k, v in cols.items()])
    want = {"teacher_z": -0.43493506795904796, "global_z": 0.2068785172621904, "base_score": -0.5190312221684823, "primary_score": -0.33755378731081415}
    assert all(math.isclose(got[k], v, rel_tol=1e-9) for k, v in want.items())


def test_operational_scores(spark):
    config = {"intercept": 2.0, "coefficient": -0.5, "residual_sd": 2.0, "no_call": -3.0, "mean": 0.0, "sd": 1.0}
    for status, want in (("ok", (4 - (2 - 0.5 * math.log1p(3))) / 2), ("no_wedge_call", -3.0)):
        cols = cal.operational_scores(F.lit(status), F.lit(3), F.lit(4.0), F.lit(0.0), config)
        assert math.isclose(one(spark, cols["corrected_topology_score"].alias("c")).c, want)


def test_sequences(spark):
    assert one(spark, sq.noncanonical_residues(F.lit("AXZXXB")).alias("x")).x == ["B", "X", "Z"]
    assert one(spark, sq.strip_stop(F.lit("acd**")).alias("x")).x == "ACD*"
    for text, status in (("ACD", "ok"), ("", "empty"), ("ACDX", "noncanonical"), ("A" * 2047, "too_long")):
        assert one(spark, sq.sequence_status(F.lit(text)).alias("x")).x == status
    with pytest.raises(Exception, match="invalid sequence"):
        sq.require_canonical(spark.createDataFrame([("AX",)], "sequence string")).collect()


def test_architecture_labels(spark):
    got = [one(spark, cal.architecture_label(F.array(*[F.lit(c) for c in cs]).cast("array<string>")).alias("x")).x for cs in ([], ["3"], ["4", "3", "4"], ["99"])]
    assert got == ["non_repeat", "elongated_repeat", "mixed_repeat_architecture", "other_repeat_architecture"]


def test_intervals(spark):
    plan = {(r.start, r.end) for r in iv.window_plan(spark.createDataFrame([(300,)], "length int")).collect()}
    assert {(0, 300), (172, 300), (44, 300)} <= plan and all(0 <= a < b <= 300 for a, b in plan)
    spans = sorted((r.core_start, r.core_end) for r in iv.tile_spans(spark.createDataFrame([(130,)], "length int")).collect())
    assert spans == [(0, 64), (64, 128), (128, 130)]
    tiles = iv.periodic_tiles(spark.createDataFrame([(20, 4.0, 3.0)], "length int, period double, offset double")).collect()
    assert [(t.start, t.end) for t in tiles] == [(0, 3), (3, 7), (7, 11), (11, 15), (15, 19)]
    track = spark.createDataFrame([(1, i, v) for i, v in enumerate([0.1, 0.8, 0.7, 0.2, 0.6, 0.9, 0.8])], "key int, pos int, value double")
    s = iv.track_summary(track, "key", "pos", "value").first()
    assert (s.run_start, s.run_end) == (4, 7) and math.isclose(s.supported_fraction, 5 / 7) and math.isclose(s.run_fraction, 3 / 7)
    assert one(spark, iv.labels_from_runs(F.lit(8), F.array(F.array(F.lit(2), F.lit(3)), F.array(F.lit(6), F.lit(8)))).alias("x")).x == [0, 1, 1, 0, 0, 1, 1, 1]
    a, b = iv.expand_interval(F.lit(100), F.lit(200), F.lit(20.0), F.lit(400))
    assert tuple(one(spark, a.alias("a"), b.alias("b"))) == (90, 210)
    r = one(spark, iv.stopping_extension(F.array(*[F.lit(float(x)) for x in (1, -1, 3, -1, -1, 9)]), F.lit(2)).alias("r")).r
    assert (r.steps, r.inspected) == (3, 5)


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("a", 8), ("b", 10), ("c", 12)], "record_id string, length int")
    assert {r.record_id: r.batch for r in iv.greedy_batches(rows, 300, 2).collect()} == {"a": 0, "b": 0, "c": 1}


def test_spectra_and_comb_agree(spark):
    motif = "EVLDTLKRHPEVVEALKEAGVEVV" * 12
    calls = sp.comb_calls(sp._FACTORS[sp._codes(__import__("pandas").Series([motif]), len(motif))])
    z, _ = sp.robust_spectra(sp._FACTORS[sp._codes(__import__("pandas").Series([motif]), len(motif))])
    native = spark.createDataFrame([(z[0].tolist(),)], "z array<double>").select(sp.comb(F.col("z"), F.lit(len(motif)), high=len(motif) / 3).alias("c")).first().c
    assert math.isclose(native.score, calls[0]["score"]) and native.bin == calls[0]["bin"]
    assert any(abs(native.period - 24 * m) < 1.5 for m in (0.5, 1, 2))
    assert sp.comb_calls(np.zeros((1, 64, 1)))[0]["score"] == 0.0


def test_wedge_finds_the_planted_interval(spark):
    length, period, begin, end = 160, 10, 40, 120
    cells = [(0, 13, i, j, 1.0 if begin <= i and j < end and (j - i) % period == 0 else 0.05 * ((i * 7 + j * 13) % 5)) for i in range(length) for j in range(i + 1, min(length, i + 61))]
    matrix = spark.createDataFrame(cells, "rec long, layer int, i int, j int, v double")
    tracks = mx.fuse_tracks(mx.diagonal_tracks(matrix, 60))
    best = wg.best_interval(wg.start_scores(tracks, spark.createDataFrame([(0, length)], "rec long, length int"), spark.createDataFrame([(p, w) for p in (8.0, 10.0, 13.0) for w in (60, 80)], "period double, width int"))).first()
    assert best.period == 10.0 and best.start >= begin - 2 and best.end <= end + 2


def test_fasta_and_jsonl(spark, tmp_path):
    (tmp_path / "a.faa").write_text(">a description\nACDEFG*\n>b\nHIK\n\nLMN\n")
    rows = {r.record_id: r.sequence for r in fasta.checked_records(fasta.read_fasta(spark, str(tmp_path / "a.faa"))).collect()}
    assert rows == {"a": "ACDEFG", "b": "HIKLMN"}
    for bad in (">a\nACDX\n", ">a\nACD**\n", ">a\n", ">same\nAC\n>same\nAC\n", "AC\n"):
        (tmp_path / "bad.faa").write_text(bad)
        with pytest.raises(ValueError, match="invalid records"):
            fasta.checked_records(fasta.read_fasta(spark, str(tmp_path / "bad.faa")))
    out = str(tmp_path / "out")
    fasta.write_jsonl(spark.createDataFrame([(1.0, None)], "b double, a string"), out)
    assert [r.value for r in spark.read.text(out).collect()] == ['{"a":null,"b":1.0}']
    with pytest.raises(Exception, match="exist"):
        fasta.write_jsonl(spark.range(1), out)

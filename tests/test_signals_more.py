"""Amplitude features, extension diagnostics, peaks and spreads, and the wedge at full length, against loops."""

import resource
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import spectral as sp
from cadenza.functions.encoding import ATCHLEY
from cadenza.operators import registration as rg
from cadenza.operators import spectra as spx
from cadenza.operators import wedge as wg

RESIDUES = sorted(ATCHLEY)


def plain_amplitudes(text, low=5.0, high=250.0, cycles=3):
    """By a plain Fourier sum, bin by bin and factor by factor."""
    n = len(text)
    none = (0.0, -1, -1, -1.0, *[0.0] * 5)
    longest = min(high, n / cycles)
    if n < 4:
        return none
    norms = [np.sqrt(sum(ATCHLEY[r][f] ** 2 for r in RESIDUES)) for f in range(5)]
    rows = np.array([[2 / n * abs(sum(ATCHLEY[r][f] / norms[f] * np.exp(-2j * np.pi * b * k / n) for k, r in enumerate(text))) for f in range(5)] for b in range(1, n // 2 + 1)])
    sd = rows.std(0)
    z = (rows - rows.mean(0)) / np.where(sd < 1e-12, 1.0, sd)
    bins = [b for b in range(max(cycles, int(np.ceil(n / longest))), min(len(z), int(n // low)) + 1)]
    if not bins:
        return none
    best = max(((z[b - 1][f], -b, -f) for b in bins for f in range(5)))
    cells = [z[b - 1][f] for b in bins for f in range(5)]
    return (best[0], -best[1], -best[2] + 1, n / -best[1], *[np.mean([c > t for c in cells]) for t in sp.THRESHOLDS])


def test_amplitude_features_against_a_fourier_sum(spark):
    draw = np.random.default_rng(8)
    texts = ["".join(draw.choice(RESIDUES, n)) for n in (4, 5, 14, 15, 16, 31, 60, 60, 97, 128)] + ["ACDEFGH" * 12, "AAAA" * 10, "ACD", "W"]
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").repartition(3)
    got = {r.k: r.r for r in rows.select("k", sp.amplitude_features(F.col("s")).alias("r")).collect()}
    for k, text in enumerate(texts):
        want = plain_amplitudes(text)
        if len(set(text)) > 1:
            assert tuple(got[k])[1:4] == pytest.approx(want[1:4]), text
        assert tuple(got[k])[0] == pytest.approx(want[0], abs=1e-6) and tuple(got[k])[4:] == pytest.approx(want[4:], abs=1e-9)


def test_extension_says_what_decided(spark):
    length, xs = 120, np.random.default_rng(9).normal(size=120)
    xs[40:90] += 3
    calls = spark.createDataFrame([(0, length, 6.0, 50, 70), (1, length, 6.0, 50, 70)], "rec int, length int, period double, start int, end int")
    scores = spark.createDataFrame([(rec, p, float(v) if rec == 0 else 1.0) for rec in (0, 1) for p, v in enumerate(xs)], "rec int, pos int, score double")
    got = {r.rec: r for r in rg.extend_intervals(calls, scores, patience_periods=1.0, extra_periods=4.0).collect()}
    padded = np.concatenate([[xs[0]] * 3, xs, [xs[-1]] * 2])
    smooth = np.array([padded[p : p + 6].mean() for p in range(length)])
    base, ref = np.quantile(smooth, 0.4), np.quantile(smooth[50:70], 0.75)
    limit = base + 0.2 * (ref - base)

    def inspected(values):
        lost = 0
        for k, v in enumerate(values, 1):
            lost = 0 if v > 0 else lost + 1
            if lost >= 6:
                return k
        return len(values)

    r = got[0]
    assert (r.residue_baseline, r.residue_core_reference, r.residue_threshold) == pytest.approx((base, ref, limit))
    assert (r.pre_extension_start, r.pre_extension_end, r.seed_start, r.seed_end) == (50, 70, 47, 73)
    assert (r.patience_residues, r.maximum_extra_residues) == (6, 24)
    assert (r.left_inspected, r.right_inspected) == (inspected((smooth[:47][::-1] - limit)[:24]), inspected((smooth[73:] - limit)[:24]))
    flat = got[1]  # no reference above the baseline: nothing is inspected
    assert (flat.start, flat.end, flat.left_inspected, flat.right_inspected, flat.left_steps) == (47, 73, 0, 0, 0)
    free = rg.extend_intervals(calls.filter("rec = 0"), scores).first()
    assert free.patience_residues is None and free.maximum_extra_residues is None and free.left_inspected == 47


def test_peaks_spreads_and_layers_of_profiles(spark):
    draw = np.random.default_rng(10)
    profiles = [draw.random(63) for _ in range(4)]
    rows = [(k // 2, 13 if k % 2 else 35, 0, 64, 64, p.tolist()) for k, p in enumerate(profiles)] + [(9, 13, 0, 1, 1, [])]
    frame = spark.createDataFrame(rows, "rec int, layer int, start int, end int, window_size int, profile array<double>")
    got = {(r.rec, r.layer): r for r in spx.score_profiles(frame).collect()}
    for rec, layer, *_, p in rows:
        p = np.array(p)
        r = got[rec, layer]
        assert r.profile_mad == pytest.approx(np.median(np.abs(p - np.median(p))) if len(p) else 0.0)
        assert len(r.harmonic_z) >= 2 or r.period == -1
        if r.period != -1:
            k = np.arange(1, len(r.harmonic_z) + 1)
            assert r.score == pytest.approx(np.maximum(np.array(r.harmonic_z) - 1, 0) @ (1 / np.sqrt(k)) / np.sqrt((1 / k).sum()))
            assert r.n_harmonics == sum(z >= 2.5 for z in r.harmonic_z)
    fused = spx.fused_windows(spx.score_profiles(frame.filter("rec < 2")), spark.createDataFrame([(0, 64), (1, 64)], "rec int, length int")).collect()
    for r in fused:
        assert list(r.layer_residual_z) == ["13", "35"] and np.mean(list(r.layer_residual_z.values())) == pytest.approx(r.score)
        assert r.layer_residual_z[str(r.source_layer)] == max(r.layer_residual_z.values())


def test_wedge_at_full_length(spark):
    """A record of 2,046 positions, 256 diagonals, 24 periods and 14 widths: its scores equal loops, and workers stay within 2 GB."""
    length, most, planted = 2046, 256, 37
    rows = spark.range(1, most + 1).select(F.lit(0).alias("rec"), F.col("id").cast("int").alias("sep"), F.posexplode(F.sequence(F.lit(0), F.lit(length - 1) - F.col("id").cast("int"))).alias("pos", "x"))
    inside = (F.col("sep") % planted == 0) & F.col("pos").between(600, 1200)
    tracks = rows.select("rec", "sep", "pos", (F.pmod(F.xxhash64("sep", "pos"), F.lit(2001)) / 1000.0 - 1 + F.when(inside, 3.0).otherwise(0.0)).alias("z")).repartition(8)
    lengths = spark.createDataFrame([(0, length)], "rec int, length int")
    templates = spark.createDataFrame([(float(p), w) for p in [*range(8, 31), planted] for w in range(96, 513, 32)], "period double, width int")
    began = time.time()
    scores = wg.start_scores(tracks, lengths, templates)
    best = wg.best_interval(scores).first()
    assert best.period == planted and 550 <= best.start and best.end <= 1300
    count = scores.count()
    assert count == sum(length - w + 1 for w in range(96, 513, 32)) * 24
    z = {s: np.array([r.z for r in sorted(own, key=lambda r: r.pos)]) for s, own in ((s, tracks.filter(F.col("sep") == s).collect()) for s in (36, 37, 38, 55, 56, 57, 73, 74, 75))}
    part = [(s, sign, 1 / np.sqrt(k) / 3) for k, sign, mid in ((1, 1, 37), (1, -1, 56), (2, 1, 74)) for s in (mid - 1, mid, mid + 1)]
    for start in (0, 700):
        total = sum(sign * w * z[s][start : start + 96 - s].sum() for s, sign, w in part)
        spread = np.sqrt(sum(w * w * (96 - s) for s, _, w in part))
        got = scores.filter((F.col("period") == planted) & (F.col("width") == 96) & (F.col("start") == start)).first().score
        # the control at 2.5 periods lies within the limit's tolerance and has members of its own
        extra = [(s, 1 / np.sqrt(2) / 3) for s in (91, 92, 93)]
        more = {s: np.array([r.z for r in sorted(tracks.filter(F.col("sep") == s).collect(), key=lambda r: r.pos)]) for s, _ in extra}
        total -= sum(w * more[s][start : start + 96 - s].sum() for s, w in extra)
        spread = np.sqrt(spread**2 + sum(w * w * (96 - s) for s, w in extra))
        assert got == pytest.approx(total / spread, abs=1e-9)
    assert resource.getrusage(resource.RUSAGE_CHILDREN).ru_maxrss < 2 << 20  # kilobytes
    assert time.time() - began < 300

"""Operators without SQL, held against plain loops."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.functions import spectral as sp
from cadenza.functions.encoding import ATCHLEY, composition
from cadenza.operators import matrices as mx
from cadenza.operators import registration as rg
from cadenza.operators import spectra as spx
from cadenza.operators import wedge as wg


def matrix_rows(rec, cells, layer=35):
    return [(rec, layer, i, j, float(cells[i, j])) for i in range(len(cells)) for j in range(len(cells))]


def frame(spark, rows):
    return spark.createDataFrame(rows, "rec int, layer int, i int, j int, v double")


def plain_tiles(length, period, offset):
    first = offset - np.ceil(offset / period) * period
    edges = sorted({min(length, max(0, int(np.rint(first + k * period)))) for k in range(int(length / period) + 3)})
    return [(a, b) for a, b in zip(edges, edges[1:]) if b - a >= 0.45 * period]


def plain_phase(cells, tiles, begin, end):
    mids = [(a + b) / 2 for a, b in tiles]
    core = [k for k, m in enumerate(mids) if begin <= m <= end]
    if len(core) < 3:
        core = sorted(sorted(range(len(tiles)), key=lambda k: (abs(mids[k] - (begin + end) / 2), k))[:3])
    if len(core) < 3 or core != list(range(core[0], core[-1] + 1)):
        return None
    block = lambda x, y: cells[x[0] : x[1], y[0] : y[1]].mean()
    near = [block(x, y) for x, y in zip(tiles, tiles[1:])]
    back = [block(tiles[k], tiles[k + 2]) for k in range(max(0, core[0] - 1), min(len(tiles) - 2, core[-1]))]
    own = near[core[0] : core[-1]]
    reference, background = np.median(own), np.median(back) if back else 0.0
    eps = max(abs(reference) * 1e-9, 1e-12)
    contrast, cv = np.log((reference + eps) / (background + eps)), np.std(own) / (np.mean(own) + eps)
    return contrast - 0.1 * cv, contrast, cv, reference, background, core, near


def test_register_units_against_loops(spark):
    draw, rows, calls = np.random.default_rng(8), [], []
    planted = 0.05 + 0.01 * draw.random((40, 40))
    for k in range(5):
        a, b, c = 8 + 4 * k, 12 + 4 * k, 16 + 4 * k
        planted[a:b, b:c] = planted[b:c, a:b] = 1.0
    cells = {0: planted, 1: draw.random((61, 61)), 2: draw.random((50, 50)), 3: draw.random((9, 9))}
    for rec, own in cells.items():
        rows += matrix_rows(rec, own)
    calls = [(0, 40, 4.0, 13, 27), (1, 61, 8.5, 20, 45), (2, 50, 12.0, 24, 26), (3, 9, 6.0, 2, 7)]
    out = {r.rec: r for r in rg.register_units(frame(spark, rows), spark.createDataFrame(calls, "rec int, length int, period double, start int, end int")).collect()}
    for rec, length, period, begin, end in calls:
        found = []
        for offset in range(int(np.ceil(period))):
            tiles = plain_tiles(length, period, offset)
            if (p := plain_phase(cells[rec], tiles, begin, end)) is not None:
                found.append((-p[0], offset, tiles, p))
        if not found:
            assert rec not in out
            continue
        found.sort(key=lambda f: f[:2])
        _, offset, tiles, (objective, contrast, cv, reference, background, core, near) = found[0]
        low, high = core[0], core[-1]
        while low and near[low - 1] >= 0.5 * reference:
            low -= 1
        while high < len(tiles) - 1 and near[high] >= 0.5 * reference:
            high += 1
        r = out[rec]
        assert (r.offset, r.core_first, r.core_last, r.n_tiles) == (offset, core[0], core[-1], len(tiles))
        assert [tuple(u) for u in r.units] == tiles[low : high + 1]
        for got, want in ((r.objective, objective), (r.contrast, contrast), (r.edge_cv, cv), (r.core_reference, reference), (r.background, background), (r.threshold, 0.5 * reference)):
            assert got == pytest.approx(want, rel=1e-6, abs=1e-9)
        assert r.second_objective == pytest.approx(-found[1][0], rel=1e-6) and r.ambiguity_margin == pytest.approx(objective + found[1][0], abs=1e-6)
    assert [tuple(u) for u in out[0].units] == [(8 + 4 * k, 12 + 4 * k) for k in range(6)] and 3 not in out


def test_block_means_by_sums(spark):
    cells = np.random.default_rng(1).random((20, 20))
    blocks = [(0, k, a, a + h, b, b + w) for k, (a, h, b, w) in enumerate([(0, 20, 0, 20), (0, 1, 3, 2), (5, 4, 0, 3), (7, 6, 11, 9)])]
    got = mx.block_means_by_sums(mx.integral_sums(frame(spark, matrix_rows(0, cells))), spark.createDataFrame(blocks, "rec int, k int, r0 int, r1 int, c0 int, c1 int"))
    assert {r.k: pytest.approx(r["mean"]) for r in got.collect()} == {k: cells[a:b, c:d].mean() for _, k, a, b, c, d in blocks}


def test_distinct_loci_against_loops(spark):
    draw, rows = np.random.default_rng(5), []
    for rec in range(3):
        for period in (8.0, 11.5):
            for width in (20, 33):
                rows += [(rec, period, width, s, float(draw.integers(0, 12))) for s in range(90 - width)]
    got: dict = {}
    for r in wg.distinct_loci(spark.createDataFrame(rows, "rec int, period double, width int, start int, score double")).orderBy("rec", "rank").collect():
        got.setdefault(r.rec, []).append((r["rank"], r.period, r.width, r.start, r.score))
    for rec in range(3):
        offers = []
        for period in (8.0, 11.5):
            for width in (20, 33):
                own, mine = sorted((-v, s) for x, p, w, s, v in rows if (x, p, w) == (rec, period, width)), []
                for back, s in own:
                    if len(mine) < 3 and all(abs(s - t) >= round(width / 2) for t in mine):
                        mine.append(s)
                        offers.append((back, width, period, len(mine), s))
        taken: list = []
        for o in sorted(offers):
            shared = [max(0, min(o[4] + o[1], t[4] + t[1]) - max(o[4], t[4])) for t in taken]
            if len(taken) < 5 and all(x <= 0.3 * (o[1] + t[1] - x) for x, t in zip(shared, taken)):
                taken.append(o)
        assert got[rec] == [(k + 1, o[2], o[1], o[4], -o[0]) for k, o in enumerate(taken)]


def test_start_scores_against_loops(spark):
    length, draw = 70, np.random.default_rng(6)
    z = {s: draw.normal(size=length - s) for s in range(1, 60)}
    tracks = spark.createDataFrame([(0, s, p, float(v)) for s, own in z.items() for p, v in enumerate(own)], "rec int, sep int, pos int, z double")
    lengths = spark.createDataFrame([(0, length)], "rec int, length int")
    templates = [(11.5, 40), (16.0, 64), (40.0, 50)]
    got = {(r.period, r.width, r.start): r.score for r in wg.start_scores(tracks, lengths, spark.createDataFrame(templates, "period double, width int")).collect()}
    want = {}
    for period, width in templates:
        limit, parts = min(59, width - 1), []
        for k in range(1, 9):
            if k * period > limit + 1:
                break
            for sign, centre in ((1, k * period), (-1, (k + 0.5) * period)):
                mid = int(np.rint(centre))
                seps = [s for s in (mid - 1, mid, mid + 1) if 1 <= s <= limit and centre <= limit + 1]
                parts += [(k, sign, s, sign / np.sqrt(k) / len(seps)) for s in seps]
        if len({k for k, sign, _, _ in parts if sign == 1}) < 2:
            continue
        for start in range(length - width + 1):
            total = sum(w * z[s][start : start + width - s].sum() for _, _, s, w in parts)
            want[period, width, start] = total / np.sqrt(sum(w * w * (width - s) for _, _, s, w in parts))
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-9) for k in want)


def plain_spectrum(x):
    """Robust z of one real signal's log power, by a plain Fourier sum."""
    n = len(x)
    t = np.arange(n)
    x = x - np.polyval(np.polyfit(t, x, 1), t)
    taper = 0.5 - 0.5 * np.cos(2 * np.pi * t / (n - 1))
    x = x / x.std() * taper
    power = np.array([abs(sum(v * np.exp(-2j * np.pi * b * k / n) for k, v in enumerate(x))) ** 2 for b in range(n // 2 + 1)])
    level = np.log1p(power / (taper**2).sum())
    width = min(15, max(5, len(level) // 8 | 1))
    padded = np.concatenate([[level[0]] * (width // 2), level, [level[-1]] * (width // 2)])
    left = level - np.array([np.median(padded[b : b + width]) for b in range(len(level))])
    mid = np.median(left[2:])
    return (left - mid) / (1.4826 * np.median(np.abs(left[2:] - mid)))


def test_spectra_against_a_fourier_sum(spark):
    draw = np.random.default_rng(2)
    signals = [np.sin(2 * np.pi * np.arange(n) / 9) + 0.3 * draw.normal(size=n) + 0.02 * np.arange(n) for n in (60, 60, 97)] + [np.ones(40), np.arange(3.0)]
    rows = spark.createDataFrame([(k, s.tolist()) for k, s in enumerate(signals)], "k int, xs array<double>")
    got = {r.k: r.s for r in rows.select("k", sp.signal_spectrum(F.col("xs")).alias("s")).collect()}
    for k in range(3):
        assert np.allclose(got[k].z, plain_spectrum(signals[k]), atol=1e-6)
    assert got[3].scale == got[4].scale == 0.0 and not any(got[3].z)


def test_combs_agree_with_loops(spark):
    draw = np.random.default_rng(3)
    zs = [np.round(draw.normal(size=65) * 2, 2) for _ in range(6)] + [np.zeros(65)]
    rows = spark.createDataFrame([(k, z.tolist()) for k, z in enumerate(zs)], "k int, z array<double>")
    got = {r.k: r.c for r in rows.select("k", sp.comb(F.col("z"), F.lit(128), 5.0, 128 / 3).alias("c")).collect()}
    for k, z in enumerate(zs):
        best = (-1.0, 0, 0)
        for b in range(3, 26):
            hs = [h for h in range(1, 9) if h * b <= 64]
            if len(hs) < 2:
                continue
            peaks = [max(z[max(1, h * b - 1) : min(64, h * b + 1) + 1]) for h in hs]
            score = sum(max(0.0, p - 1) / np.sqrt(h) for h, p in zip(hs, peaks)) / np.sqrt(sum(1 / h for h in hs))
            if (score, sum(p >= 2.5 for p in peaks), -b) > best:
                best = (score, sum(p >= 2.5 for p in peaks), -b)
        assert got[k].score == pytest.approx(best[0]) and (got[k].n_significant, got[k].bin) == (best[1], -best[2])


def test_window_scores_find_a_planted_period(spark):
    unit = "EVLDTLKRHPEVVEALKEAGVEVV"
    shuffled = "".join(np.random.default_rng(0).permutation(list(unit * 12)))
    rows = spx.scan_sequences(spark.createDataFrame([("a", unit * 12), ("b", shuffled)], "record_id string, sequence string")).collect()
    best = {i: max((r for r in rows if r.record_id == i), key=lambda r: r.physical.score) for i in "ab"}
    assert best["a"].physical.score > best["b"].physical.score + 1
    assert min(abs(best["a"].physical.period - 24 * m) for m in (0.5, 1, 2)) < 2


def test_window_profiles_and_fused_windows(spark):
    draw = np.random.default_rng(7)
    cells = {layer: draw.random((64, 64)) for layer in (13, 35)}
    for own in cells.values():
        for s in (12, 24, 36):
            own[np.arange(64 - s), np.arange(s, 64)] += 2
    matrix = frame(spark, [r for layer, own in cells.items() for r in matrix_rows(0, own, layer)])
    windows = spark.createDataFrame([(0, 0, 64, 64), (0, 16, 56, 40)], "rec int, start int, end int, window_size int")
    profiles = spx.window_profiles(matrix, windows)
    for r in profiles.collect():
        part = cells[r.layer][r.start : r.end, r.start : r.end]
        assert np.allclose(r.profile, [np.diagonal(part, s).mean() for s in range(1, len(part))])
    scored = spx.score_profiles(profiles)
    each = {(r.layer, r.start): r for r in scored.collect()}
    lengths = spark.createDataFrame([(0, 64)], "rec int, length int")
    from cadenza.functions.calibration import LOCAL

    for r in spx.fused_windows(scored, lengths).collect():
        z = {}
        for layer, c in LOCAL.items():
            expected = c["coefficients"][0] + c["coefficients"][1] * np.log2(r.window_size) + c["coefficients"][2] * np.log2(64)
            z[layer] = (np.log1p(each[layer, r.start].score) - expected - c["mean"]) / c["sd"]
        assert r.score == pytest.approx(np.mean(list(z.values())))
        assert r.source_layer == max(z, key=lambda k: (z[k], -k)) and r.period == each[r.source_layer, r.start].period
    with pytest.raises(Exception, match="without all layers"):
        spx.fused_windows(scored.filter("layer = 13"), lengths).collect()


def test_phase_randomized_turns_tracks(spark):
    rows = [(0, 13, s, p, float(100 * s + p)) for s in (3, 4, 9) for p in range(20 - s)]
    tracks = spark.createDataFrame(rows, "rec int, layer int, sep int, pos int, z double")
    out = [[tuple(r) for r in mx.phase_randomized(tracks, seed).orderBy("sep", "pos").collect()] for seed in ("a", "a", "b")]
    assert out[0] == out[1] != out[2]
    for s in (3, 4, 9):
        n, turned = 20 - s, [r[4] for r in out[0] if r[2] == s]
        shift = int(turned.index(float(100 * s)))
        assert turned == [float(100 * s + (k - shift) % n) for k in range(n)]


@pytest.mark.parametrize("patience", [None, 1.0])
def test_extension_against_loops(spark, patience):
    length, xs = 160, np.random.default_rng(4).normal(size=160)
    xs[30:110] += 3
    calls = spark.createDataFrame([(0, length, 6.0, 60, 90)], "rec int, length int, period double, start int, end int")
    scores = spark.createDataFrame([(0, p, float(v)) for p, v in enumerate(xs)], "rec int, pos int, score double")
    got = rg.extend_intervals(calls, scores, patience_periods=patience, extra_periods=None if patience is None else 4.0).first()
    padded = np.concatenate([[xs[0]] * 3, xs, [xs[-1]] * 2])
    smooth = np.array([padded[p : p + 6].mean() for p in range(length)])
    base, ref = np.quantile(smooth, 0.4), np.quantile(smooth[60:90], 0.75)
    limit, room = base + 0.2 * (ref - base), length if patience is None else 24

    def steps(values):
        total = best = taken = lost = 0
        for k, v in enumerate(values, 1):
            total, lost = total + v, 0 if v > 0 else lost + 1
            if total > best:
                best, taken = total, k
            if lost >= (length + 1 if patience is None else 6):
                break
        return taken

    left, right = steps((smooth[:57][::-1] - limit)[:room]), steps((smooth[93:] - limit)[:room])
    assert (got.start, got.end, got.left_steps, got.right_steps) == (57 - left, 93 + right, left, right)


def test_half_precision(spark):
    rows = spark.createDataFrame([([0.123456, -0.333333, 65504.0],)], "x array<float>")
    assert rows.select(sp.half_precision(F.col("x")).alias("h")).first().h == np.array([0.123456, -0.333333, 65504.0], np.float16).astype(float).tolist()
    with pytest.raises(Exception, match="finite"):
        spark.createDataFrame([([70000.0],)], "x array<float>").select(sp.half_precision(F.col("x")).alias("h")).collect()


def test_composition(spark):
    rows = [(0, "AACDY"), (1, ""), (2, None), (3, "W" * 1000 + "XZ")]
    got = {(r.k, r.residue): r.n for r in composition(spark.createDataFrame(rows, "k int, s string"), "k", "s").collect()}
    assert got == {(k, r): s.count(r) for k, s in rows if s for r in ATCHLEY if r in s}


def _lone_values(spark, backwards: bool):
    """Diagonals of five cells, of which one isn't zero: the deviation is exactly 0.4 of it, z exactly 2.5."""
    rows = [(rec, 13, i, i + 91, float(v) if i == rec % 5 else 0.0) for rec, v in enumerate((468, 7, 1679, 1622, 2075, 1771, 2211, 3958, 211, 661)) for i in range(5)]
    return spark.createDataFrame(rows[::-1] if backwards else rows, "rec long, layer int, i int, j int, v double").coalesce(1)


@pytest.mark.parametrize("backwards", [False, True])
def test_diagonal_tracks_are_exact_in_any_order(spark, backwards):
    """A population deviation that came from running means was off in its last bits, by the order of rows, and the floor of thousandths fell to 2499."""
    z = F.floor(F.col("z") * 1000)
    out = mx.diagonal_tracks(_lone_values(spark, backwards), 95).select("rec", "pos", z.alias("z")).collect()
    assert sorted(map(tuple, out)) == [(rec, i, 2500 if i == rec % 5 else 0) for rec in range(10) for i in range(5)]


def test_turned_tracks_hold_exact_values_in_any_order(spark):
    """phase_randomize floors thousandths of the tracks it turns; each holds one 2500, however its rows came."""
    def turned(backwards):
        tracks = mx.diagonal_tracks(_lone_values(spark, backwards), 95).withColumn("z", F.floor(F.col("z") * 1000))
        return sorted(map(tuple, mx.phase_randomized(tracks, "null-1").select("rec", "layer", "sep", "pos", "z").collect()))

    out = turned(False)
    assert out == turned(True) and [r[4] for r in out if r[4]] == [2500] * 10

"""Scores of many windows at once, held against the functions that score a window by itself."""

import numpy as np
import pandas as pd
import pytest

from cadenza.functions import spectral as sp
from cadenza.functions import window_scan as ws
from cadenza.operators import spectra as spx


def _alike(got, want):
    return all(np.shape(got[k]) == np.shape(want[k]) and np.allclose(got[k], want[k], rtol=1e-7, atol=1e-7) for k in want)


def _drawn(n, count):
    draw = np.random.default_rng(n)
    shares = draw.dirichlet(np.ones(20) * 2)
    return ["".join(draw.choice(list(sp._RESIDUES), n, p=shares)) for _ in range(count)] + ["A" * n, ("ACDEF" * n)[:n], ("A" * n + "C")[-n:]]


@pytest.mark.parametrize("n", [1, 3, 4, 5, 9, 10, 16, 17, 31, 64, 95, 128, 256, 777, 1024])
def test_scores_agree_with_single_windows(n):
    texts = _drawn(n, 12)
    got = ws.scores_of(texts, [n] * len(texts), [np.array([0])] * len(texts)).flatten().to_pylist()
    own = pd.Series(texts)
    for name, f in (("physical", sp.factor_call), ("exact", sp.exact_call)):
        assert all(_alike(g[name], w) for g, w in zip(got, f.func(own).to_dict("records"), strict=True)), name
    for text, g, w in zip(texts, got, sp.single_factor_call.func(own).to_dict("records"), strict=True):
        tied = len(set(text)) < 3  # all factors of two residues have one spectrum, and rounding picks among them
        assert (tied or g["factor_max"]["factor"] == w["factor"]) and _alike(g["factor_max"]["call"], w["call"])


@pytest.mark.parametrize("width", [3, 5, 7, 9, 11, 13, 15])
def test_running_median(width):
    x = np.random.default_rng(width).integers(0, 9, (40, 33)).astype(float)
    assert (ws.running_median(x, width) == sp.rolling_median(x, width)).all()


def test_scan_scores_each_window_in_few_calls(spark, monkeypatch):
    """Windows are scored as strips of their sequence; one string and four functions for each window took 0.1 GB beyond any limit."""
    text, calls = _drawn(9000, 1)[0], []
    rows = {(r.start, r.end): r for r in spx.scan_sequences(spark.createDataFrame([("a", text), ("b", text[:50])], "record_id string, sequence string")).filter("record_id = 'a'").collect()}
    assert len(rows) == sum(len({*range(0, 9000 - n + 1, n // 4), 9000 - n}) for n in (128, 256, 512, 1024))
    some = sorted(rows)[::37]
    plain = spark.createDataFrame([(s, e, text[s:e]) for s, e in some], "start int, end int, window string")
    for r in spx.score_windows(plain).collect():
        for name in ("physical", "exact"):
            assert _alike(rows[r.start, r.end][name].asDict(), r[name].asDict())
        assert rows[r.start, r.end].repetita == pytest.approx(r.repetita)
    one = ws._piece
    monkeypatch.setattr(ws, "_piece", lambda codes, *a: calls.append(len(codes)) or one(codes, *a))
    ws.scores_of([text], [128], [np.arange(0, 8873, 32)])
    assert sum(calls) == 278 and len(calls) == 2


def test_amplitudes_agree(spark):
    texts = [t for n in (3, 4, 14, 15, 40, 200) for t in _drawn(n, 4)]
    got = ws.scores_of(texts, [len(t) for t in texts], [np.array([0])] * len(texts)).flatten().to_pylist()
    from pyspark.sql import functions as F

    rows = spark.createDataFrame(list(enumerate(texts)), "k int, s string").select("k", sp.amplitude_features(F.col("s")).alias("r")).collect()
    for r in rows:
        own, want = got[r.k]["repetita"], r.r.asDict()
        if abs(want["zmax"]) < 1e-12:  # where the largest amplitude is rounding, its place means nothing
            own, want = ({k: v for k, v in x.items() if k not in ("bin", "factor", "period")} for x in (own, want))
        assert _alike(own, want), (texts[r.k][:20], own, want)

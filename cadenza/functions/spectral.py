"""Spectra of signals: small array helpers behind Arrow functions, and the harmonic comb as a Column.

The transforms work on all signals of one length at once; everything after them
(combs, windows, calibration, ranking) is DataFrame work.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cadenza.functions.encoding import ATCHLEY

_RESIDUES = "".join(sorted(ATCHLEY))
_FACTORS = np.array([ATCHLEY[r] for r in _RESIDUES])
_DOUBLES = T.ArrayType(T.DoubleType())
SPECTRUM = T.StructType([T.StructField("z", _DOUBLES), T.StructField("scale", T.DoubleType())])
THRESHOLDS = (1.5, 2.1, 2.5, 3.0, 3.4)
#: Positions that are transformed at once, unless one value has more.
ROOM = 1 << 20


def rolling_median(x: np.ndarray, width: int) -> np.ndarray:
    """Centred running median along the last axis, ends repeated; odd width."""
    side = width // 2
    padded = np.pad(x, [(0, 0)] * (x.ndim - 1) + [(side, side)], mode="edge")
    return np.median(np.lib.stride_tricks.sliding_window_view(padded, width, axis=-1), axis=-1)


def robust_spectra(signals: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """signals (count, n, channels) -> robust z of the summed log power per bin, and its scale.

    Channels are detrended and standardised first, constant ones left out; a signal that is
    too short, has no channel left or no spread in its spectrum gives zeros and scale 0.
    """
    count, n, _ = signals.shape
    bins = n // 2 + 1
    if n < 4:
        return np.zeros((count, bins)), np.zeros(count)
    t = np.arange(n) - (n - 1) / 2
    x = signals - signals.mean(1, keepdims=True)
    x = x - t[None, :, None] * (np.einsum("wnc,n->wc", x, t) / (t @ t))[:, None, :]
    sd = x.std(1)
    live = sd > 1e-12
    x = np.where(live[:, None, :], x / np.where(live, sd, 1.0)[:, None, :], 0.0)
    taper = np.hanning(n)
    power = (np.abs(np.fft.rfft(x * taper[None, :, None], axis=1)) ** 2).sum(2)
    level = np.log1p(power / np.maximum((taper @ taper) * live.sum(1), 1e-12)[:, None])
    left = level - rolling_median(level, min(15, max(5, bins // 8 | 1)))
    body = left[:, 2:] if bins > 2 else left
    mid = np.median(body, axis=1)
    scale = 1.4826 * np.median(np.abs(body - mid[:, None]), axis=1)
    scale = np.where(scale < 1e-8, body.std(1), scale)
    ok = (scale >= 1e-8) & live.any(1)
    z = np.where(ok[:, None], (left - mid[:, None]) / np.where(ok, scale, 1.0)[:, None], 0.0)
    return z, np.where(ok, scale, 0.0)


def _by_length(values: pd.Series, work, empty) -> pd.DataFrame:
    """Apply ``work`` to all values of one length together; rows come back in order."""
    sizes, out = values.map(len), [empty] * len(values)
    for n, own in values.groupby(sizes):
        if n:
            step = max(1, min(256, ROOM // n))
            for at in range(0, len(own), step):
                part = own.iloc[at : at + step]
                for pos, row in zip(values.index.get_indexer(part.index), work(part, int(n)), strict=True):
                    out[pos] = row
    return pd.DataFrame(out)


def _codes(part: pd.Series, n: int) -> np.ndarray:
    raw = np.frombuffer("".join(part).encode(), np.uint8).reshape(len(part), n)
    return np.searchsorted(np.frombuffer(_RESIDUES.encode(), np.uint8), raw)


def _spectrum_rows(signals: np.ndarray) -> list[dict]:
    z, scale = robust_spectra(signals)
    return [{"z": a, "scale": b} for a, b in zip(z, scale, strict=True)]


_NONE = {"z": np.zeros(1), "scale": 0.0}


CALL = T.StructType([T.StructField(n, k) for n, k in (("score", T.DoubleType()), ("n_significant", T.IntegerType()), ("bin", T.IntegerType()), ("period", T.DoubleType()), ("n_tested", T.IntegerType()), ("scale", T.DoubleType()), ("harmonic_z", _DOUBLES))])
_NO_CALL = {"score": 0.0, "n_significant": 0, "bin": -1, "period": -1.0, "n_tested": 0, "scale": 0.0, "harmonic_z": []}


def comb_calls(signals: np.ndarray, low: float = 5.0, high: float = 250.0, cycles: int = 3, harmonics: int = 8) -> list[dict]:
    """What ``comb`` gives, for all signals (count, n, channels) at once: windows are many, and of few lengths."""
    n = signals.shape[1]
    z, scale = robust_spectra(signals)
    most = z.shape[1] - 1
    sides = np.pad(np.where(np.arange(most + 1) > 0, z, -np.inf), ((0, 0), (1, 1)), constant_values=-np.inf)
    peak = np.maximum(np.maximum(sides[:, :-2], sides[:, 1:-1]), sides[:, 2:])
    out = [{**_NO_CALL, "scale": float(s)} for s in scale]
    best, seen = np.full(len(z), -1.0), np.zeros(len(z), int)
    high = min(high, n / cycles)
    for b in range(max(cycles, int(np.ceil(n / high))), min(most, int(n // low)) + 1):
        tested = min(harmonics, most // b)
        if tested < 2:
            continue
        k = np.arange(1, tested + 1)
        own, weight = peak[:, b * k], 1 / np.sqrt(k)
        score, hits = np.maximum(own - 1.0, 0) @ weight / np.sqrt(weight @ weight), (own >= 2.5).sum(1)
        better = (score > best) | ((score == best) & (hits > seen))
        best, seen = np.where(better, score, best), np.where(better, hits, seen)
        for row in np.flatnonzero(better):
            out[row].update(score=float(score[row]), n_significant=int(hits[row]), bin=b, period=n / b, n_tested=tested, harmonic_z=own[row].tolist())
    return out


@F.pandas_udf(CALL)
def factor_call(sequences: pd.Series) -> pd.DataFrame:
    """Comb of the five physical factors of canonical sequences."""
    return _by_length(sequences, lambda p, n: comb_calls(_FACTORS[_codes(p, n)]), _NO_CALL)


@F.pandas_udf(CALL)
def exact_call(sequences: pd.Series) -> pd.DataFrame:
    """Comb of the twenty residue indicators."""
    return _by_length(sequences, lambda p, n: comb_calls(np.eye(20)[_codes(p, n)]), _NO_CALL)


@F.pandas_udf(T.StructType([T.StructField("factor", T.IntegerType()), T.StructField("call", CALL)]))
def single_factor_call(sequences: pd.Series) -> pd.DataFrame:
    """The best of the five single factors' combs (of equal ones the first), and its number from 1."""

    def work(p: pd.Series, n: int) -> list[dict]:
        x = _FACTORS[_codes(p, n)]
        each = [comb_calls(x[:, :, k : k + 1]) for k in range(5)]
        pick = [max(range(5), key=lambda k, i=i: (each[k][i]["score"], each[k][i]["n_significant"], -k)) for i in range(len(p))]
        return [{"factor": k + 1, "call": each[k][i]} for i, k in enumerate(pick)]

    return _by_length(sequences, work, {"factor": 1, "call": _NO_CALL})


@F.pandas_udf(SPECTRUM)
def signal_spectrum(signals: pd.Series) -> pd.DataFrame:
    """Spectrum of one-channel signals."""
    return _by_length(signals, lambda p, n: _spectrum_rows(np.stack(list(p)).astype(float)[:, :, None]), _NONE)


@F.pandas_udf(SPECTRUM)
def profile_spectrum(profiles: pd.Series) -> pd.DataFrame:
    """Spectrum of diagonal profiles, their smooth decay (running median, width 31) taken off first."""

    def work(p: pd.Series, n: int) -> list[dict]:
        x = np.stack(list(p)).astype(float)
        smooth = x.mean(1, keepdims=True) if n < 5 else rolling_median(x, max(5, min(31, n if n % 2 else n - 1)))
        return _spectrum_rows((x - smooth)[:, :, None])

    return _by_length(profiles, work, _NONE)


_RHO = tuple("rho_" + str(t).replace(".", "_") for t in THRESHOLDS)
AMPLITUDES = T.StructType([T.StructField("zmax", T.DoubleType()), T.StructField("bin", T.IntegerType()), T.StructField("factor", T.IntegerType()), T.StructField("period", T.DoubleType()), *[T.StructField(r, T.DoubleType()) for r in _RHO]])
_NO_AMPLITUDES = {"zmax": 0.0, "bin": -1, "factor": -1, "period": -1.0, **dict.fromkeys(_RHO, 0.0)}


def amplitude_features(sequence: Column, low: float = 5.0, high: float = 250.0, cycles: int = 3) -> Column:
    """struct (zmax, bin, factor, period, rho_..): the largest amplitude in the period band, and the share of the band above each threshold.

    An amplitude is that of one of the five factors (normalised over the residues) in one
    non-zero bin, in deviations over the bins. Of equal ones the lowest bin counts, then the
    first factor. A sequence below four residues, or without a bin in the band, has none. Nine
    numbers leave the worker for each sequence, never its bins.
    """
    unit = _FACTORS / np.sqrt((_FACTORS**2).sum(0))

    def work(p: pd.Series, n: int) -> list[dict]:
        longest = min(high, n / cycles)
        first, last = max(cycles, int(np.ceil(n / longest))), min(n // 2, int(n // low))
        if n < 4 or last < first:
            return [_NO_AMPLITUDES] * len(p)
        a = (2 * np.abs(np.fft.rfft(unit[_codes(p, n)], axis=1)) / n)[:, 1:]
        sd = a.std(1, keepdims=True)
        band = ((a - a.mean(1, keepdims=True)) / np.where(sd < 1e-12, 1.0, sd))[:, first - 1 : last].reshape(len(p), -1)
        top = band.argmax(1)
        shares = [(band > t).mean(1).tolist() for t in THRESHOLDS]
        return [
            {"zmax": float(row[k]), "bin": first + k // 5, "factor": k % 5 + 1, "period": n / (first + k // 5), **dict(zip(_RHO, share, strict=True))}
            for row, k, share in zip(band, top.tolist(), zip(*shares, strict=True), strict=True)
        ]

    def features(sequences: pd.Series) -> pd.DataFrame:
        return _by_length(sequences, work, _NO_AMPLITUDES)

    return F.pandas_udf(features, AMPLITUDES)(sequence)


def comb(z: Column, length: Column, low: float = 5.0, high: float | Column = 250.0, cycles: int = 3, harmonics: int = 8, floor: float = 1.0, significant: float = 2.5) -> Column:
    """The fundamental whose integer harmonics peak most: struct (score, n_significant, bin, period, n_tested, harmonic_z).

    A harmonic's peak is the largest z in its bin or the two beside it; the score is the
    weighted excess over the floor, weights 1/sqrt(k). Ties go to more significant
    harmonics, then to the lower bin; harmonic_z holds the peaks. Without a candidate: score 0, bin and period -1.
    """
    most = F.size(z) - 1
    high = high if isinstance(high, Column) else F.lit(high)
    first = F.greatest(F.lit(cycles), F.ceil(length / high)).cast("int")
    last = F.least(most, F.floor(length / F.lit(low)).cast("int"))

    def one(b: Column) -> Column:
        tested = F.least(F.lit(harmonics), F.floor(most / b).cast("int"))
        peaks = F.transform(F.sequence(F.lit(1), tested), lambda k: F.struct((1 / F.sqrt(k.cast("double"))).alias("w"), F.array_max(F.slice(z, F.greatest(F.lit(1), k * b - 1) + 1, F.least(most, k * b + 1) - F.greatest(F.lit(1), k * b - 1) + 1)).alias("v")))
        total = F.aggregate(peaks, F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("n"), F.lit(0).alias("c")), lambda a, p: F.struct((a["s"] + F.greatest(F.lit(0.0), p["v"] - floor) * p["w"]).alias("s"), (a["n"] + p["w"] * p["w"]).alias("n"), (a["c"] + (p["v"] >= significant).cast("int")).alias("c")))
        return F.struct((total["s"] / F.sqrt(total["n"])).alias("score"), total["c"].alias("n_significant"), (-b).alias("back"), tested.alias("n_tested"), F.transform(peaks, lambda p: p["v"]).alias("peaks"))

    bins = F.filter(F.when(last >= first, F.sequence(first, last)).otherwise(F.array().cast("array<int>")), lambda b: F.floor(most / b) >= 2)
    best = F.array_max(F.transform(bins, one))
    return F.struct(
        F.coalesce(best["score"], F.lit(0.0)).alias("score"), F.coalesce(best["n_significant"], F.lit(0)).alias("n_significant"), F.coalesce(-best["back"], F.lit(-1)).alias("bin"),
        F.coalesce(length / -best["back"], F.lit(-1.0)).alias("period"), F.coalesce(best["n_tested"], F.lit(0)).alias("n_tested"),
        F.coalesce(best["peaks"], F.array().cast("array<double>")).alias("harmonic_z"),
    )


@F.pandas_udf(T.ArrayType(T.FloatType()))
def half_precision(values: pd.Series) -> pd.Series:
    """A round trip through 16-bit floats; anything not finite stops the query."""

    def trip(x: np.ndarray) -> np.ndarray:
        out = np.asarray(x, np.float32).astype(np.float16).astype(np.float32)
        if not np.isfinite(out).all():
            raise ValueError("values must be finite in half precision")
        return out

    return values.map(trip)

"""Scores of many windows of one length at once: the calls of ``spectral`` with their transforms shared.

The five factors are transformed once for the summed and for the single calls. The twenty
residue indicators are transformed with the taper alone; their mean and slope, which the
spectrum is without, are taken off in the frequency domain. Combs of all candidate bins are
strided slices, one for each harmonic. Work goes in pieces of some thousand positions, which
stay in a core's cache.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from cadenza.functions import spectral as sp

#: Positions of windows that are scored together.
PIECE = 1 << 15
#: Positions that are transformed together, for each of 20 residues.
TRANSFORMED = 1 << 13
#: Values whose running medians are taken together.
BLOCK = 1 << 14
#: A first large block, freed at once: glibc then keeps smaller ones, instead of giving each back and having its pages made anew.
np.empty(31 << 20, np.uint8)

#: The summed factors, each of them, and the residue indicators.
_SPECTRA = 7
FLOOR, SIGNIFICANT, HARMONICS = 1.0, 2.5, 8


def _merged(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Two ascending lists of equal arrays, merged place by place (Batcher's odd-even merge)."""
    if not a or not b:
        return a or b
    if len(a) == len(b) == 1:
        return [np.minimum(a[0], b[0]), np.maximum(a[0], b[0])]
    odd, even = _merged(a[::2], b[::2]), _merged(a[1::2], b[1::2])
    out = [odd[0]]
    for k in range(max(len(odd) - 1, len(even))):
        if k < len(even) and k + 1 < len(odd):
            out += [np.minimum(even[k], odd[k + 1]), np.maximum(even[k], odd[k + 1])]
        else:
            out.append(even[k] if k < len(even) else odd[k + 1])
    return out


def _sorted_runs(size: int, known: dict[int, list[np.ndarray]]) -> list[np.ndarray]:
    """For each place the ``size`` values from there on, ascending; known: of 1, the values. The sorted halves of neighbours are shared."""
    if size not in known:
        half = 1 << (size - 1).bit_length() - 1
        a, b = _sorted_runs(half, known), _sorted_runs(size - half, known)
        n = len(known[1][0]) - size + 1
        known[size] = _merged([r[:n] for r in a], [r[half : half + n] for r in b])
    return known[size]


def running_median(x: np.ndarray, width: int) -> np.ndarray:
    """``spectral.rolling_median`` by minima and maxima of shifted arrays, some rows (count, bins) at a time, laid end to end; width odd, 3 at least."""
    side, n, out = width // 2, x.shape[1], np.empty_like(x)
    half, step = 1 << (width - 1).bit_length() - 1, max(1, BLOCK // x.shape[1])
    for row in range(0, len(x), step):
        padded = np.pad(x[row : row + step], ((0, 0), (side, side)), mode="edge")
        known = {1: [padded.ravel()]}
        places = padded.size - width + 1
        a = [r[:places] for r in _sorted_runs(half, known)]
        b = [r[half : half + places] for r in _sorted_runs(width - half, known)]
        # The k-th of both is the least of max(i-th of a, (k - i)-th of b).
        k, least = side + 1, np.full(padded.size, np.inf)
        own = least[:places]
        for i in range(max(0, k - len(b)), min(k, len(a)) + 1):
            np.minimum(own, b[k - 1] if i == 0 else a[k - 1] if i == k else np.maximum(a[i - 1], b[k - i - 1]), out=own)
        out[row : row + step] = least.reshape(padded.shape)[:, :n]  # what begins later reaches into the next row
    return out


def _median(x: np.ndarray) -> np.ndarray:
    """Medians along the last axis."""
    n = x.shape[-1]
    at = np.partition(x, (n // 2,) if n % 2 else (n // 2 - 1, n // 2), axis=-1)
    return at[..., n // 2] if n % 2 else (at[..., n // 2 - 1] + at[..., n // 2]) / 2


@functools.lru_cache(maxsize=64)
def _fixed(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a length: centred positions, the taper, and the transforms of the taper and of the tapered positions (as pairs of doubles)."""
    t, taper = np.arange(n) - (n - 1) / 2, np.hanning(n)
    return t, taper, np.fft.rfft([taper, taper * t]).view(float)


def _levels(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """codes (count, n) -> log power (count, 7, bins), whether it has a live channel (count, 7), and the amplitudes of the normalised factors (count, 5, bins)."""
    count, n = codes.shape
    codes = codes.astype(np.intp)
    t, taper, trend = _fixed(n)
    tt, residues = t @ t, len(sp._RESIDUES)
    at = codes + residues * np.arange(count)[:, None]
    shown = np.zeros(count * residues * n)
    shown[at * n + np.arange(n)] = taper
    held = np.bincount(at.ravel(), minlength=count * residues).reshape(count, residues)
    share = held / n
    slope = np.bincount(at.ravel(), np.tile(t, count), count * residues).reshape(count, residues) / tt
    made = np.fft.rfft(shown.reshape(count, residues, n)).view(float)
    made -= np.stack([share, slope], 2) @ trend

    second = share @ sp._FACTORS**2
    variance = second - (share @ sp._FACTORS) ** 2 - (slope @ sp._FACTORS) ** 2 * (tt / n)
    for row, k in zip(*np.nonzero(variance <= 1e-6 * second), strict=True):  # what the difference of large numbers doesn't tell
        x = sp._FACTORS[codes[row], k]
        x = x - x.mean()
        variance[row, k] = (x - t * (x @ t / tt)).var()
    live = variance > 1e-24
    each = sp._FACTORS.T @ made
    each *= each
    each *= np.where(live, 1 / np.where(live, variance, 1.0), 0.0)[:, :, None]
    changing = (held > 0) & (held < n)  # another indicator has no spread
    spread = share * (1 - share) - slope * slope * (tt / n)
    made *= made
    whole = np.where(changing, 1 / np.where(changing, spread, 1.0), 0.0)[:, None] @ made
    power = np.concatenate([each.sum(1, keepdims=True), each, whole], 1)
    channels = np.concatenate([live.sum(1)[:, None], live, changing.sum(1)[:, None]], 1)
    level = power[..., ::2] + power[..., 1::2]
    level /= np.maximum(taper @ taper * channels, 1e-12)[:, :, None]
    unit = (sp._FACTORS / np.sqrt((sp._FACTORS**2).sum(0))).T
    return np.log1p(level, out=level), channels > 0, 2 * np.abs(np.fft.rfft(unit[:, codes].swapaxes(0, 1))) / n


def _spectra(level: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Log power -> robust z per bin, and its scale, as ``spectral.robust_spectra``."""
    bins = level.shape[-1]
    left = level - running_median(level.reshape(-1, bins), min(15, max(5, bins // 8 | 1))).reshape(level.shape)
    body = left[..., 2:] if bins > 2 else left
    mid = _median(body)
    scale = 1.4826 * _median(np.abs(body - mid[..., None]))
    flat = scale < 1e-8
    if flat.any():
        scale[flat] = body[flat].std(-1)
    ok = (scale >= 1e-8) & live
    left -= mid[..., None]
    left *= np.where(ok, 1 / np.where(ok, scale, 1.0), 0.0)[..., None]
    return left, np.where(ok, scale, 0.0)


def _combs(z: np.ndarray, n: int, low: float = 5.0, high: float = 250.0, cycles: int = 3) -> dict[str, np.ndarray]:
    """z (.., bins) of windows of length n -> the fields of ``spectral.CALL``; harmonic_z has eight places, of which n_tested count."""
    shape, most = z.shape[:-1], z.shape[-1] - 1
    last = min(most // 2, int(n // low))
    first = max(cycles, int(np.ceil(n / min(high, n / cycles)))) if n else cycles
    if last < first:
        none = np.zeros(shape, np.int32)
        return {"score": np.zeros(shape), "n_significant": none, "bin": none - 1, "period": np.full(shape, -1.0), "n_tested": none, "harmonic_z": np.zeros((*shape, HARMONICS))}
    peak = np.full(z.shape, -np.inf)
    peak[..., 1:] = z[..., 1:]
    np.maximum(peak[..., 2:], z[..., 1:-1], out=peak[..., 2:])
    np.maximum(peak[..., 1:-1], z[..., 2:], out=peak[..., 1:-1])
    excess, high_peak = np.maximum(peak - FLOOR, 0), (peak >= SIGNIFICANT).astype(np.int8)
    wide = last - first + 1
    score, hits, norm = np.zeros((*shape, wide)), np.zeros((*shape, wide), np.int8), np.zeros(wide)
    for k in range(1, HARMONICS + 1):
        upto = min(last, most // k) - first + 1
        if upto <= 0:
            break
        at = slice(k * first, k * (first + upto - 1) + 1, k)
        score[..., :upto] += excess[..., at] * (1 / np.sqrt(k))
        hits[..., :upto] += high_peak[..., at]
        norm[:upto] += 1 / k
    score /= np.sqrt(norm)
    top = score.max(-1)
    pick = np.where(score == top[..., None], hits, np.int8(-1)).argmax(-1)
    bin_ = pick + first
    harmonic = np.minimum(bin_[..., None] * np.arange(1, HARMONICS + 1), most)
    return {
        "score": top, "n_significant": np.take_along_axis(hits, pick[..., None], -1)[..., 0].astype(np.int32), "bin": bin_.astype(np.int32), "period": n / bin_,
        "n_tested": np.minimum(HARMONICS, most // bin_).astype(np.int32), "harmonic_z": np.take_along_axis(peak, harmonic, -1),
    }


def _amplitudes(a: np.ndarray, n: int, low: float, high: float, cycles: int) -> dict[str, np.ndarray]:
    """Plain amplitudes (count, 5, bins) -> the fields of ``spectral.AMPLITUDES``."""
    count, last = len(a), min(n // 2, int(n // low))
    first = max(cycles, int(np.ceil(n / min(high, n / cycles)))) if n else cycles
    if n < 4 or last < first:
        none = np.full(count, -1, np.int32)
        return {"zmax": np.zeros(count), "bin": none, "factor": none, "period": np.full(count, -1.0), **{r: np.zeros(count) for r in sp._RHO}}
    a = a[:, :, 1:]
    sd = a.std(2, keepdims=True)
    band = (a[:, :, first - 1 : last] - a.mean(2, keepdims=True)) / np.where(sd < 1e-12, 1.0, sd)
    band = np.moveaxis(band, 2, 1).reshape(count, -1)
    top = band.argmax(1)
    bin_ = first + top // 5
    return {
        "zmax": band[np.arange(count), top], "bin": bin_.astype(np.int32), "factor": (top % 5 + 1).astype(np.int32), "period": n / bin_,
        **{r: np.count_nonzero(band > t, axis=1) / band.shape[1] for r, t in zip(sp._RHO, sp.THRESHOLDS, strict=True)},
    }


def _calls(calls: dict[str, np.ndarray], scale: np.ndarray) -> pa.StructArray:
    tested = calls["n_tested"]
    kept = calls["harmonic_z"][np.arange(HARMONICS) < tested[:, None]]
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(tested)]).astype(np.int32)), pa.array(kept))
    own = {**{k: pa.array(v) for k, v in calls.items() if k != "harmonic_z"}, "scale": pa.array(scale), "harmonic_z": lists}
    return pa.StructArray.from_arrays([own[f.name] for f in sp.CALL.fields], [f.name for f in sp.CALL.fields])


SCORES = T.StructType([
    T.StructField("physical", sp.CALL), T.StructField("exact", sp.CALL),
    T.StructField("factor_max", T.StructType([T.StructField("factor", T.IntegerType()), T.StructField("call", sp.CALL)])), T.StructField("repetita", sp.AMPLITUDES)])


def _piece(codes: np.ndarray, low: float, high: float, cycles: int) -> pa.StructArray:
    count, n = codes.shape
    z, scale, plain = np.zeros((count, _SPECTRA, n // 2 + 1)), np.zeros((count, _SPECTRA)), np.zeros((count, 5, n // 2 + 1))
    step = max(1, TRANSFORMED // max(n, 1))
    for at in range(0, count if n >= 4 else 0, step):
        part = slice(at, at + step)
        level, live, plain[part] = _levels(codes[part])
        z[part], scale[part] = _spectra(level, live)
    calls = _combs(z, n)
    best = np.zeros(count, int)
    for k in range(1, 5):  # of equal factors the first
        now, than = calls["score"][:, k + 1], calls["score"][np.arange(count), best + 1]
        more = calls["n_significant"][:, k + 1] > calls["n_significant"][np.arange(count), best + 1]
        best = np.where((now > than) | ((now == than) & more), k, best)
    rows = np.arange(count)
    of = lambda at: _calls({k: v[rows, at] for k, v in calls.items()}, scale[rows, at])
    single = pa.StructArray.from_arrays([pa.array((best + 1).astype(np.int32)), of(best + 1)], ["factor", "call"])
    features = _amplitudes(plain, n, low, high, cycles)
    amplitudes = pa.StructArray.from_arrays([pa.array(features[f.name]) for f in sp.AMPLITUDES.fields], [f.name for f in sp.AMPLITUDES.fields])
    return pa.StructArray.from_arrays([of(0), of(6), single, amplitudes], SCORES.fieldNames())


_PLACE = np.zeros(256, np.uint8)
_PLACE[np.frombuffer(sp._RESIDUES.encode(), np.uint8)] = np.arange(len(sp._RESIDUES))


def scores_of(texts: list[str], sizes: list[int], starts: list[np.ndarray], low: float = 5.0, high: float = 250.0, cycles: int = 3) -> pa.ListArray:
    """Of each text the scores of its windows of one size, which begin at the given places: a list of ``SCORES`` for each text."""
    codes = [_PLACE[np.frombuffer(t.encode(), np.uint8)] for t in texts]
    parts, order = [], []
    for n in sorted(set(sizes)):
        own = [k for k, s in enumerate(sizes) if s == n]
        windows = np.concatenate([np.lib.stride_tricks.sliding_window_view(codes[k], n)[starts[k]] if n else np.zeros((len(starts[k]), 0), np.uint8) for k in own])
        order += own
        step = max(1, PIECE // max(n, 1))
        parts += [_piece(windows[at : at + step], low, high, cycles) for at in range(0, len(windows), step)]
    counts = np.array([len(s) for s in starts], np.int64)
    ends = np.cumsum(counts[order])
    begin = np.empty(len(texts), np.int64)
    begin[order] = ends - counts[order]
    places = np.repeat(begin - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
    flat = pa.concat_arrays(parts).take(pa.array(places)) if parts else pa.array([], to_arrow_type(SCORES))
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), flat)


def window_scores(text: Column, size: Column, starts: Column, low: float = 5.0, high: float = 250.0, cycles: int = 3) -> Column:
    """Array of ``SCORES``: of a canonical text the windows of the given size that begin at ``starts`` (array of int, from 0)."""

    def scores(texts: pa.Array, sizes: pa.Array, places: pa.Array) -> pa.Array:
        at = places.offsets.to_numpy()
        own = [places.values[a:b].to_numpy() for a, b in zip(at[:-1], at[1:], strict=True)]
        return scores_of(texts.to_pylist(), sizes.to_pylist(), own, low, high, cycles)

    return F.arrow_udf(scores, T.ArrayType(SCORES))(text, size, starts)

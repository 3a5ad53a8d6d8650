"""Masked cropping, channels, dense tiles, and tile outputs back as tracks, against plain numpy."""

import numpy as np
import pytest

from cadenza.operators import matrices as mx
from cadenza.operators import tiles as tl

CELLS = "rec long, layer int, head int, i int, j int, v double"
CLASSES = ["bent", "coiled", "open"]


def cells_of(rec, layer, heads):
    return [(rec, layer, h, i, j, float(m[i, j])) for h, m in enumerate(heads) for i in range(len(m)) for j in range(len(m))]


def plain_apc(heads, kept, least):
    x = (heads + heads.transpose(0, 2, 1)) / 2
    x = x[:, kept][:, :, kept]
    row, col, total = x.sum(2, keepdims=True), x.sum(1, keepdims=True), x.sum((1, 2), keepdims=True) + 1e-12
    out = np.maximum(x - row * col / total, 0).mean(0)
    gap = np.abs(np.subtract.outer(range(len(kept)), range(len(kept))))
    out[gap < max(1, least)] = 0
    return out


@pytest.mark.parametrize(("kept", "least"), [([1, 2, 3, 4], 2), ([0, 2, 5], 1), ([3], 0), (range(6), 6)])
def test_apc_keeps_and_renumbers_masked_positions(spark, kept, least):
    """Sums run over kept positions alone; the special ends of a tokenised record are the usual case."""
    draw = np.random.default_rng(5)
    heads = {rec: draw.random((2, 6, 6)) for rec in (1, 2)}
    cells = spark.createDataFrame([c for r, m in heads.items() for c in cells_of(r, 13, m)], CELLS)
    mask = [(1, i, i not in kept, True) for i in range(6)] + [(2, i, False, i in kept) for i in range(6)]
    mask = spark.createDataFrame(mask, "rec long, i int, special boolean, attended boolean")
    lengths = spark.createDataFrame([(1, len(kept)), (2, len(kept))], "rec long, length int")
    out = mx.apc_head_mean(cells, least, mx.kept_positions(mask, lengths)).collect()
    for rec, m in heads.items():
        got = {(r.i, r.j): r.v for r in out if r.rec == rec}
        want = plain_apc(m, list(kept), least)
        assert got.keys() == {(i, j) for i in range(len(kept)) for j in range(len(kept))}
        assert all(v == pytest.approx(want[k], abs=1e-12) for k, v in got.items())


def test_masks_that_disagree_are_refused(spark):
    mask = spark.createDataFrame([(1, 0, True, True), (1, 1, False, None), (1, 2, None, True)], "rec long, i int, special boolean, attended boolean")
    assert mx.kept_positions(mask).first().place == [None, 0, None]
    with pytest.raises(Exception, match="kept positions disagree with the length of 1"):
        mx.kept_positions(mask, spark.createDataFrame([(1, 2)], "rec long, length int")).collect()
    with pytest.raises(Exception, match="kept positions disagree with the length of 7"):
        mx.kept_positions(mask, spark.createDataFrame([(1, 1), (7, 1)], "rec long, length int")).collect()
    with pytest.raises(Exception, match="mask positions"):
        mx.kept_positions(mask.filter("i <> 1")).collect()


def matrix_of(rec, layer, m):
    return [(rec, layer, i, j, float(m[i, j])) for i in range(len(m)) for j in range(len(m))]


MATRIX = "rec long, layer int, i int, j int, v double"


def test_channels_need_one_shape(spark):
    eye = lambda n: np.eye(n)
    good = spark.createDataFrame(matrix_of(1, 13, eye(3)) + matrix_of(1, 35, eye(3)) + matrix_of(2, 13, eye(4)) + matrix_of(2, 35, eye(4)), MATRIX)
    rows = tl.attention_channels(good).collect()
    assert {(r.rec, r.channel) for r in rows} == {(1, 0), (1, 1), (2, 0), (2, 1)} and len(rows) == 2 * 9 + 2 * 16
    assert all((r.c > 0) == (r.i == r.j) for r in rows)
    for bad, words in (
        (matrix_of(1, 13, eye(3)) + matrix_of(1, 35, eye(4)), "channel shapes disagree: 1"),
        (matrix_of(1, 13, eye(3))[:-1], "square and whole"),
        (matrix_of(1, 13, -eye(3)), "negative or not finite"),
        (matrix_of(1, 13, np.full((2, 2), np.nan)), "negative or not finite"),
    ):
        with pytest.raises(Exception, match=words):
            tl.attention_channels(spark.createDataFrame(bad, MATRIX)).collect()


def test_dense_tiles_are_padded_and_say_what_exists(spark):
    n, tile, core = 130, 128, 64
    channels = [(1, k, i, j, float((k + 1) * (1 + (i * 7 + j * 3) % 11))) for k in range(2) for i in range(n) for j in range(n)]
    frame = spark.createDataFrame(channels, "rec long, channel int, i int, j int, c double")
    lengths = spark.createDataFrame([(1, n), (2, 5)], "rec long, length int")  # the second has no cells at all
    got = {(r.rec, r.core_start): np.array(r.tile, "f4").reshape(3, tile, tile) for r in tl.dense_tiles(frame, lengths, 2).collect()}
    assert got.keys() == {(1, 0), (1, 64), (1, 128), (2, 0)}
    whole = np.array([c for *_, c in channels], "f4").reshape(2, n, n)
    for (rec, start), t in got.items():
        want, length, begin = np.zeros((3, tile, tile), "f4"), n if rec == 1 else 5, start - (tile - core) // 2
        lo, hi = max(0, -begin), min(tile, length - begin)
        want[2, lo:hi, lo:hi] = 1
        if rec == 1:
            want[:2, lo:hi, lo:hi] = whole[:, begin + lo : begin + hi, begin + lo : begin + hi]
        assert (t == want).all()
    assert (got[1, 0][:2, :32] == 0).all() and (got[1, 0][:2, :, :32] == 0).all() and (got[1, 0][2, 32:, 32:] == 1).all()


def logits_of(length, tile, core, seed, classes=3):
    """Outputs of all tiles, padding and off-diagonal cells included, and the track they stand for."""
    draw = np.random.default_rng(seed)
    margin, rows, track = (tile - core) // 2, [], np.zeros((length, 1 + classes))
    for start in range(0, length, core):
        out = draw.normal(size=(1 + classes, tile, tile)) * 4
        for t in range(tile):
            p = start + t - margin
            if margin <= t < margin + core and p < length:
                track[p] = out[:, t, t]
            for u in {t, max(0, t - 1), min(tile - 1, t + 1)}:
                rows += [(9, start, c, t, u, float(out[c, t, u])) for c in range(1 + classes)]
    return rows, track


LOGITS = "rec long, core_start int, channel int, ti int, tj int, logit double"


@pytest.mark.parametrize("length", [1, 8, 20, 33])
def test_tiles_decode_to_tracks_and_class_means(spark, length):
    rows, track = logits_of(length, 16, 8, length)
    lengths = spark.createDataFrame([(9, length)], "rec long, length int")
    out = tl.decode_tiles(spark.createDataFrame(rows, LOGITS), lengths, CLASSES, 16, 8)
    got = sorted(out.collect(), key=lambda r: r.pos)
    assert [r.pos for r in got] == list(range(length))
    power = np.exp(track[:, 1:] - track[:, 1:].max(1, keepdims=True))
    shares = power / power.sum(1, keepdims=True)
    assert np.allclose([r.state for r in got], 1 / (1 + np.exp(-track[:, 0])), atol=1e-12)
    assert np.allclose([[r.classes[c] for c in CLASSES] for r in got], shares, atol=1e-12)
    means = tl.class_means(out).first().class_means
    assert means.keys() == set(CLASSES) and np.allclose([means[c] for c in CLASSES], shares.mean(0), atol=1e-12)


def test_tiles_that_do_not_cover_once_are_refused(spark):
    rows, _ = logits_of(20, 16, 8, 1)
    lengths = spark.createDataFrame([(9, 20)], "rec long, length int")
    decode = lambda r: tl.decode_tiles(spark.createDataFrame(r, LOGITS), lengths, CLASSES, 16, 8).collect()
    for bad, words in (
        ([r for r in rows if r[1] != 8], "no tile covers 9"),
        (rows + [r for r in rows if r[1] == 8], "exactly once"),
        ([r for r in rows if r[2] != 3], "channels differ"),
        (rows + [(9, 0, 4, t, t, 0.0) for t in range(16)], "channels differ"),
        ([(*r[:5], float("nan")) if (r[1], r[3]) == (8, 6) else r for r in rows], "not finite at 9 10"),
    ):
        with pytest.raises(Exception, match=words):
            decode(bad)

"""Hashes of words and word shingles, straight from the bytes of Arrow text columns.

A word's hash is a polynomial over a random 64-bit value per byte (so that prefix sums
give all words at once), finished by a mixer; a shingle's hash mixes those of its words.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from cadenza.llm.packing import by_bytes

#: Bytes of text hashed at once; a longer text is hashed alone.
SLICE = 500_000
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@cache
def _bytes() -> tuple[np.ndarray, np.ndarray]:
    """Value of each byte (A-Z as a-z), and whether it belongs to a word."""
    values = np.random.default_rng(20240229).integers(1, 2**63, 256).astype(np.uint64) | np.uint64(1)
    values[65:91] = values[97:123]
    word = np.ones(256, bool)
    word[[0x20, *range(0x09, 0x0E)]] = False
    return values, word


_powers: list[np.ndarray] = []


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size, back = max(n, SLICE + 1), np.uint64(pow(int(_BASE), -1, 2**64))
        _powers[:] = [np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(size, b, np.uint64)])) for b in (_BASE, back)]
    return _powers[0][:n], _powers[1][: n + 1]


def _cut(data: np.ndarray) -> list[int]:
    """Bounds of pieces of about SLICE bytes, cut where no word runs on."""
    _, is_word = _bytes()
    bounds = [0]
    while len(data) - bounds[-1] > SLICE:
        at = bounds[-1] + SLICE
        while at < len(data):  # the next byte outside a word
            outside = np.flatnonzero(~is_word[data[at : at + SLICE]])
            if len(outside):
                at += int(outside[0])
                break
            at = min(len(data), at + SLICE)
        bounds.append(at)
    return [*bounds, len(data)] if bounds[-1] < len(data) else bounds


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in a row, and where each text's words end. A null text has none.

    A text longer than SLICE comes alone (see ``sliced``) and is hashed piece by piece.
    """
    if len(texts) == 1 and (pc.binary_length(texts)[0].as_py() or 0) > SLICE:
        raw = pc.cast(texts, pa.large_binary())
        data = np.frombuffer(raw.buffers()[2], np.uint8)[slice(*np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + 2])]
        bounds = _cut(data)
        found = [_hashes(pa.array([data[a:b].tobytes()], pa.large_binary()))[0] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
        return np.concatenate(found), np.array([sum(map(len, found))])
    return _hashes(texts)


def _hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    raw = pc.cast(pc.fill_null(texts, b"" if pa.types.is_large_binary(texts.type) else ""), pa.large_binary())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1] if len(raw) else np.zeros(1, np.int64)
    first, last = int(offsets[0]), int(offsets[-1])
    if first == last:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    data = np.frombuffer(raw.buffers()[2], np.uint8)[first:last]
    values, is_word = _bytes()
    inside = is_word[data]
    fresh = np.zeros(len(data) + 1, bool)
    fresh[offsets - first] = True  # a text's begin ends the word before
    start = np.flatnonzero(inside & (fresh[:-1] | np.concatenate([[True], ~inside[:-1]])))
    end = np.flatnonzero(inside & (fresh[1:] | np.concatenate([~inside[1:], [True]]))) + 1
    power, inverse = _power(len(data))
    sums = np.concatenate([[np.uint64(0)], np.cumsum(values[data] * power)])
    hashes = _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(np.uint64))
    return hashes, np.searchsorted(start, offsets[1:] - first)


def shingle_sets(texts: pa.Array, k: int = 5) -> Iterator[np.ndarray]:
    """The sorted distinct k-word shingles of each text; a shorter text's whole sequence is one."""
    words, ends = word_hashes(texts)
    weights = _mix(np.arange(1, k + 1, dtype=np.uint64))
    rolled = np.zeros(max(0, len(words) - k + 1), np.uint64)
    for j in range(k):
        rolled += words[j : j + len(rolled)] * weights[j]
    rolled = _mix(rolled)
    begin = 0
    for end in ends.tolist():
        n = end - begin
        if n >= k:
            yield np.unique(rolled[begin : end - k + 1])
        elif n:
            yield _mix(np.array([(words[begin:end] * weights[:n]).sum() + np.uint64(n)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)
        begin = end


def sliced(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    for a, b in by_bytes(batch.column(column), SLICE):
        yield batch.slice(a, b - a)

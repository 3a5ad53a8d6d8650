"""Packing documents into training sequences by best-fit decreasing.

A document's tokens are its ids and a closing id. Overlong documents are first cut
into full windows; each window is a sequence of its own. The rests go, longest first,
to the open sequence with the tightest room that takes them, found in a segment tree
indexed by remaining capacity. Packing runs on shards of about ``shard_docs``
documents, dealt by a hash (of every ``ALIKE`` equal rows of a task anew, so that a row
repeated without end is spread too), so that each shard is a bounded task; a shard leaves
at most a few sequences with room, below 1 % of its tokens where it holds a hundred
windows or more.

Only lengths and checksums are shuffled, never texts or ids.

Defined cases: a null text counts as empty and has the closing id alone; repeated rows
are packed once each; a null doc_id is packed like any other; an empty table gives an
empty table; other columns are ignored. Sequences are padded to the window, except
those whose filled length is a power of two, which stay as they are.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"
#: Equal documents of a task that are dealt to one shard, and distinct ones whose number is kept.
ALIKE, COUNTED = 64, 50_000
#: Bytes of a worker's word cache, about; it starts anew when full.
CACHE_BYTES = 64 << 20
#: Bytes of an entry besides its word and ids: dictionary slot, string and number objects, place.
_ENTRY_BYTES = 150
#: Bytes of text that are tokenised at once.
SLICE_BYTES = 2_000_000
#: Kinds of bytes: white space, letters, digits, marks, and those whose words the tokenizer cuts itself.
_BLANK, _LETTER, _DIGIT, _MARK, _OTHER = range(5)


def _kinds() -> np.ndarray:
    out = np.full(256, _OTHER, np.uint8)
    for k in range(0x21, 0x7F):
        c = chr(k)
        out[k] = _DIGIT if c.isdigit() else _OTHER if c in "'<" else _LETTER if c.isalpha() else _MARK
    out[[32, *range(9, 14)]] = _BLANK
    return out


class WordTokenizer:
    """Ids of texts by a tokenizer that drops white space, part by part.

    Such a tokenizer's pre-tokens never span white space, and its normaliser lower-cases, so
    a text's ids are those of its words in a row. A word of plain characters is cut here as
    its pre-tokenizer does: runs of letters, single digits, runs of marks; another (with an
    apostrophe, a ``<`` or a character beyond Latin-1's letters) is one part. Distinct parts are encoded
    once. A tokenizer of another make is refused.
    """

    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        whole, parts = ["Ab1 cD.\n\tEf g12-h..,_iÉß\"#z/9"], "ab 1 cd . ef g 1 2 - h ..,_ iéß \"# z / 9".split()
        ids = [[i for e in self.tokenizer.encode_batch_fast(x, add_special_tokens=False) for i in e.ids] for x in (whole, parts)]
        stop = self.tokenizer.encode(".", add_special_tokens=False).ids
        if ids[0] != ids[1] or len(stop) != 1:
            raise ValueError(f"this tokenizer doesn't treat a text as its lower-cased words in a row: {path}")
        self.stop, self.kinds = stop[0], _kinds()
        # words that may hold an added token are left whole
        self.kinds[[t.content.encode()[0] for t in self.tokenizer.get_added_tokens_decoder().values()]] = _OTHER
        self.known: dict[bytes, int] = {}
        self._reset()

    def _reset(self) -> None:
        self.known.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.starts = np.zeros(1 << 14, np.int64)
        self.used, self.count, self.bytes = 0, 0, 0

    def _learn(self, words: list[bytes]) -> None:
        """Encode distinct parts: many at once with stops between them, those that hold a stop one by one."""
        plain, dotted = [w for w in words if b"." not in w], [w for w in words if b"." in w]
        for at in range(0, len(plain), 20_000):
            part = plain[at : at + 20_000]
            texts = [b" . ".join([*part[k : k + 200], b""]).decode() for k in range(0, len(part), 200)]
            flat = np.fromiter(chain.from_iterable(e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)), np.uint32)
            stops = np.flatnonzero(flat == self.stop)  # no other part has this id
            if len(stops) != len(part):
                raise ValueError("the tokenizer's ids of a stop are ambiguous")
            self._append(part, np.delete(flat, stops), np.diff(stops, prepend=-1) - 1)
        for at in range(0, len(dotted), 20_000):
            part = dotted[at : at + 20_000]
            coded = [e.ids for e in self.tokenizer.encode_batch_fast([w.decode() for w in part], add_special_tokens=False)]
            self._append(part, np.fromiter(chain.from_iterable(coded), np.uint32), np.array([len(c) for c in coded]))

    def _append(self, words: list[bytes], flat: np.ndarray, lengths: np.ndarray) -> None:
        while self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        while self.count + len(words) + 1 > len(self.starts):
            self.starts = np.concatenate([self.starts, np.zeros_like(self.starts)])
        self.ids[self.used : self.used + len(flat)] = flat
        self.starts[self.count + 1 : self.count + 1 + len(words)] = self.used + np.cumsum(lengths)
        self.known.update(zip(words, range(self.count, self.count + len(words)), strict=True))
        self.count += len(words)
        self.used += len(flat)
        self.bytes += len(words) * _ENTRY_BYTES + sum(map(len, words)) + 4 * len(flat)

    def _entries(self, words: list[bytes]) -> np.ndarray:
        """Cache entries of distinct parts."""
        if self.bytes > CACHE_BYTES:
            self._reset()
        known = self.known
        if fresh := [w for w in words if w not in known]:
            self._learn(fresh)
        return np.fromiter(map(known.__getitem__, words), np.int64, len(words))

    def _parts(self, data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """The parts of all texts in a row, and where each text's parts end."""
        kinds = self.kinds[data]
        lead = np.flatnonzero(data == 0xC3)  # U+00C0 to U+00FF, letters but for two signs
        lead = lead[(data[lead + 1] & 0xDF) != 0x97]
        kinds[lead], kinds[lead + 1] = _LETTER, _LETTER
        ink = kinds != _BLANK
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        if len(other := np.flatnonzero(kinds == _OTHER)):  # their words stay whole
            cut = np.flatnonzero(np.append(~ink, True) | edge)  # white space, and the texts' first bytes
            blank = np.append(~ink, True)[cut]
            last = np.searchsorted(cut, other, "right") - 1
            inside = np.zeros(len(data) + 1, np.int32)
            np.add.at(inside, cut[last] + blank[last], 1)
            np.add.at(inside, cut[last + 1], -1)
            kinds[inside.cumsum()[:-1] > 0] = _OTHER
        begin = edge[:-1].copy()
        begin[1:] |= (kinds[1:] != kinds[:-1]) | (kinds[1:] == _DIGIT)
        begin &= ink
        filled = np.flatnonzero(ink)
        first = np.flatnonzero(begin[filled])
        starts = np.append(first, len(filled))
        parts = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data[filled])])
        return parts, np.searchsorted(filled[first], offsets[1:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (no nulls) in a row, and where each text's ids end."""
        parts, ends = self._parts(*_lowered(texts))
        flat = parts.dictionary_encode()
        if not len(flat):
            return np.zeros(0, np.uint32), ends
        entry = self._entries(flat.dictionary.to_pylist())
        at = flat.indices.to_numpy(zero_copy_only=False)
        starts = self.starts[entry]
        each = (self.starts[entry + 1] - starts)[at]
        until = np.append(0, np.cumsum(each))
        where = np.arange(until[-1]) + np.repeat(starts[at] - until[:-1], each)
        return self.ids[where], until[ends]


def _lowered(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of the texts with A-Z lower-cased, except where a special token may be spelt, and where each text begins and the last ends."""
    whole = pa.concat_arrays([pc.cast(texts, pa.large_binary()).take(pa.array(np.arange(len(texts))))])  # own buffers, from offset 0
    offsets = np.frombuffer(whole.buffers()[1], np.int64, len(whole) + 1) if len(whole) else np.zeros(1, np.int64)
    raw = whole.buffers()[2].to_pybytes() if len(whole) and whole.buffers()[2] else b""
    data = raw.lower()
    marked = np.flatnonzero(pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False))
    if len(marked):
        patched = bytearray(data)
        for k in marked.tolist():
            patched[offsets[k] : offsets[k + 1]] = raw[offsets[k] : offsets[k + 1]]
        data = bytes(patched)
    return np.frombuffer(data, np.uint8), offsets


_tokenizers: dict[str, WordTokenizer] = {}


def word_tokenizer(path: str) -> WordTokenizer:
    """One per worker process: its cache serves all tasks of the process."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def by_bytes(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of texts with about limit bytes, one row at least."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin, held = 0, 0
    for row, n in enumerate(size):
        if held and held + n > limit:
            yield begin, row
            begin, held = row, 0
        held += int(n)
    if begin < len(size):
        yield begin, len(size)


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2) -> DataFrame:
    """The pieces of all documents: full windows and a rest of each; deal is another number for every ``ALIKE`` equal documents of a task."""

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, alike = word_tokenizer(tokenizer_path), TaskContext.get().partitionId() + 1, {}
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1)
            for a, b in by_bytes(texts):
                ids, ends = coder.encode(pc.fill_null(texts.slice(a, b - a), ""))
                out: list[tuple] = []
                begin = 0
                for doc_id, end in zip(doc_ids.slice(a, b - a).to_pylist(), ends.tolist(), strict=True):
                    own = np.append(ids[begin:end], np.uint32(end_id)).astype("<u4")
                    begin = end
                    n = len(own)
                    sums = [zlib.crc32(own[s : s + window].tobytes()) for s in range(0, n, window)]
                    if len(alike) > COUNTED:
                        alike.clear()
                    key = doc_id, n, sums[0]
                    seen = alike[key] = alike.get(key, -1) + 1
                    deal = seen // ALIKE and part << 32 | seen // ALIKE
                    out += [(doc_id, s, min(window, n - s), c, n, deal) for s, c in zip(range(0, n, window), sums, strict=True)]
                cols = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pieces, PIECES + ", deal long")


def best_fit_decreasing(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (1..window), which must come in descending order.

    Open bins wait in a list per remaining capacity. A segment tree over the capacities
    (a node is set if a bin waits below it) gives the least capacity that suffices.
    """
    leaves = 1 << window.bit_length()
    tree = bytearray(2 * leaves)
    waiting: list[list[int]] = [[] for _ in range(leaves)]
    bins, offsets, opened = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for k, need in enumerate(lengths.tolist()):
        node = leaves + need
        if not tree[node]:
            while node > 1 and (node & 1 or not tree[node + 1]):  # up, until a right neighbour is set
                node >>= 1
            if node > 1:
                node += 1
                while node < leaves:
                    node = 2 * node if tree[2 * node] else 2 * node + 1
        if node > 1:
            room = node - leaves
            own = waiting[room].pop()
            if not waiting[room]:
                tree[node] = 0
                node >>= 1
                while node and not (tree[2 * node] or tree[2 * node + 1]):
                    tree[node] = 0
                    node >>= 1
        else:
            own, room, opened = opened, window, opened + 1
        bins[k], offsets[k] = own, window - room
        if left := room - need:
            waiting[left].append(own)
            node = leaves + left
            while node and not tree[node]:
                tree[node] = 1
                node >>= 1
    return bins, offsets


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = 4096, end_id: int = 2, shard_docs: int = 4096) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, padding."""
    shards = max(1, -(-docs.count() // shard_docs))
    pieces = cut_documents(docs, tokenizer_path, window, end_id)
    key = F.xxhash64("doc_id", "ids_crc32", "doc_tokens", F.when(F.col("length") == window, F.col("start")), "deal")
    dealt = pieces.withColumn("shard", F.pmod(key, F.lit(shards))).drop("deal")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "doc_id", "start", "ids_crc32"], ascending=[False, True, True, True], kind="stable")
        bins, offsets = best_fit_decreasing(pdf["length"].to_numpy(), window)
        filled = np.bincount(bins, weights=pdf["length"].to_numpy()).astype(np.int64)
        padding = np.where(filled & (filled - 1), window - filled, 0)
        return pdf.assign(sequence_id=pdf["shard"].astype(np.int64) * 2**32 + bins, offset=offsets, padding=padding[bins]).drop(columns="shard")

    return dealt.groupBy("shard").applyInPandas(pack, PIECES + ", sequence_id long, offset long, padding long")

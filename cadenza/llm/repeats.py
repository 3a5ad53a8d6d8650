"""Passages that documents repeat: located by sharded Aho-Corasick automata, and removed.

A window is ``WINDOW`` words in a row of one document. A window is a repeat where the same
words also start in a document with a smaller doc_id; repeats are judged on the input.

1. Each window has an anchor, the least-hashed of the ``ANCHOR``-word groups in it (the first
   of equal ones), so equal windows have equal anchors and neighbouring windows mostly share
   one. Anchors that two documents hold are found by one exchange of hashes, positions and
   document keys. Hashes only choose candidates: what they choose wrongly costs time.
2. Around such anchors documents are cut into pieces: the run of windows with one anchor. A
   piece goes to a shard by its anchor. Windows of the few anchors that are too frequent for
   a shard (their number is bounded, whatever the input) are pieces of their own and go by
   their own words.
3. A shard confirms, word by word, which windows two documents hold, joins
   those that go on together to passages, and compiles these into an Aho-Corasick automaton
   over word numbers (one to three symbols each, so that no node has many children) that knows
   each passage's least doc_id. All pieces stream through it; every occurrence with a greater
   doc_id is a repeat.

Batches are large, and of equal anchors or pieces in a batch one represents the others: the
least document of a batch is witness enough against the others there. So a passage that a
third of all documents hold comes to a shard once a batch, not once a document.

Defined cases: words are what lies between the six ASCII white-space characters, so a null
or empty text has none; fewer than ``WINDOW`` words hold no window; rows without doc_id are
neither searched nor a reason to remove anything, and keep all words; rows of one doc_id are
no reason against each other; an empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.session import bounded_batches, materialize, release_shuffles

WINDOW, ANCHOR = 13, 5
#: Bytes of documents for each bucket of anchors, and for each shard of pieces; bytes in a batch of a task.
BUCKET_BYTES, SHARD_BYTES, BATCH_TEXT = 32 << 20, 8 << 20, 16 << 20
#: Occurrences above which an anchor is too frequent for a shard, and how many such anchors there are at most.
FREQUENT, MOST_FREQUENT = 4096, 50_000
_CHUNK = 1 << 20

_draw = np.random.default_rng(11)
_BYTE = _draw.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


_POWER, _BACK = _powers(_BASE, _CHUNK), _powers(_INVERSE, _CHUNK)


class Words:
    """The words of texts in a row: where they lie, their hashes, and which text they are of."""

    def __init__(self, texts: pa.Array) -> None:
        texts = pc.fill_null(texts, "")
        _, offsets, data = texts.buffers()
        at = np.frombuffer(offsets, np.int32, len(texts) + 1, texts.offset * 4).astype(np.int64)
        data = np.zeros(0, np.uint8) if data is None else np.frombuffer(data, np.uint8)[at[0] : at[-1]]
        at -= at[0]
        space, edges = _SPACE[data], at[1:-1][at[1:-1] < len(data)]
        begin, end = ~space, ~space
        begin[1:] &= space[:-1]
        end[:-1] &= space[1:]
        begin[edges] = ~space[edges]
        end[edges[edges > 0] - 1] = ~space[edges[edges > 0] - 1]
        self.data, self.begin, self.end = data, np.flatnonzero(begin), np.flatnonzero(end) + 1
        self.first = np.searchsorted(self.begin, at)  # of each text
        self.text = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.hash = self._hashes(space)

    def _hashes(self, space: np.ndarray) -> np.ndarray:
        out, k = np.zeros(len(self.begin), np.uint64), 0
        while k < len(out):
            low = self.begin[k]
            stop = int(np.searchsorted(self.end, low + _CHUNK, "right"))
            if stop <= k:  # a word longer than a chunk
                out[k] = int.from_bytes(hashlib.blake2b(self.data[low : self.end[k]].tobytes(), digest_size=8).digest(), "little")
                k += 1
                continue
            x = _BYTE[self.data[low : self.end[stop - 1]]]
            x[space[low : self.end[stop - 1]]] = 0
            at = self.begin[k:stop] - low
            out[k:stop] = _mixed(np.add.reduceat(x * _POWER[: len(x)], at) * _BACK[at])
            k = stop
        return out

    def groups(self, size: int) -> np.ndarray:
        """Hash of the ``size`` words from each word on."""
        n = max(0, len(self.hash) - size + 1)
        out = np.zeros(n, np.uint64)
        for k in range(size):
            out = out * _BASE + self.hash[k : k + n]
        return _mixed(out)

    def anchors(self, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each window: the word it starts with, and the word its anchor starts with; the hashes of all possible anchors."""
        hashes = self.groups(ANCHOR)
        n = len(self.hash) - window + 1
        if n <= 0:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), hashes
        least, at, span, width = hashes, np.arange(len(hashes)), 1, window - ANCHOR + 1
        while span < width:
            step = min(span, width - span)
            left, right = least[:-step], least[step:]
            take = right < left
            at = np.where(take, at[step:], at[:-step])
            least, span = np.where(take, right, left), span + step
        whole = np.flatnonzero(self.text[:n] == self.text[window - 1 :])
        return whole, at[whole], hashes


def _sliced(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts are about 4 MB, or one text."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + (4 << 20), "right")))
        yield batch.slice(at, to - at)
        at = to


_FOUND = "key long, pos int, frequent long"
_ENTRY = np.dtype([("h", "<u8"), ("key", "<i8"), ("pos", "<i4")])
_MANY = np.dtype([("h", "<u8"), ("n", "<i8")])


def _starts(sorted_values: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], sorted_values[1:] != sorted_values[:-1]])) if len(sorted_values) else np.zeros(0, np.int64)


def _shared(h: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by hash, starts and sizes of equal hashes, and which of them several keys hold."""
    order = np.argsort(h, kind="stable")
    at = _starts(h[order])
    sizes = np.diff(np.append(at, len(h)))
    several = np.minimum.reduceat(key[order], at) != np.maximum.reduceat(key[order], at) if len(at) else np.zeros(0, bool)
    return order, at, sizes, several


def shared_anchors(keyed: DataFrame, window: int, buckets: int, batch_text: int = BATCH_TEXT, frequent: int = FREQUENT) -> DataFrame:
    """keyed (key, text) -> key, pos: words at which anchors start that another key has too; and the hashes of frequent ones."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def flush() -> pa.RecordBatch:
            entries = np.concatenate(held)
            order, at, sizes, several = _shared(entries["h"], entries["key"])
            entries, known = entries[order], np.repeat(several, sizes)
            # of anchors that several keys of the batch hold, the shard is told the number alone; known ones are dealt by key
            many = np.zeros(int(several.sum()), _MANY)
            many["h"], many["n"] = entries["h"][at[several]], sizes[several]
            bucket = np.where(known, _mixed(entries["key"].view(np.uint64)), entries["h"]) % np.uint64(buckets)
            cuts = np.lexsort((entries["h"], known, bucket))
            entries, known, bucket = entries[cuts], known[cuts], bucket[cuts]
            ends = np.searchsorted(bucket, np.arange(buckets + 1))
            sure = np.array([known[a:b].sum() for a, b in zip(ends[:-1], ends[1:], strict=True)], np.int64)
            own = np.argsort(many["h"] % np.uint64(buckets), kind="stable")
            many, tops = many[own], np.searchsorted((many["h"] % np.uint64(buckets))[own], np.arange(buckets + 1))
            blobs = [[entries[a : b - s].tobytes() for a, b, s in zip(ends[:-1], ends[1:], sure, strict=True)]]
            blobs.append([entries[b - s : b].tobytes() for b, s in zip(ends[1:], sure, strict=True)])
            blobs.append([many[a:b].tobytes() for a, b in zip(tops[:-1], tops[1:], strict=True)])
            return pa.RecordBatch.from_arrays([pa.array(range(buckets), pa.int32()), *[pa.array(b, pa.binary()) for b in blobs]], ["bucket", "open", "sure", "many"])

        for batch in batches:
            for part in _sliced(batch, "text"):
                words = Words(part.column("text"))
                _, at, hashes = words.anchors(window)
                at = np.unique(at)
                if len(at):
                    entries = np.zeros(len(at), _ENTRY)
                    entries["h"], entries["key"] = hashes[at], part.column("key").to_numpy()[words.text[at]]
                    entries["pos"] = at - words.first[words.text[at]]
                    held.append(entries)
                size += len(words.data)
                if size >= batch_text and held:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    def meet(rows: pa.Table) -> pa.Table:
        read = lambda name, kind: np.frombuffer(b"".join(rows.column(name).to_pylist()), kind)
        entries, many = read("open", _ENTRY), read("many", _MANY)
        # a number stands for two keys at least: here for the two ends of the range
        h = np.concatenate([entries["h"], many["h"], many["h"]])
        key = np.concatenate([entries["key"], np.full(len(many), np.iinfo(np.int64).min), np.full(len(many), np.iinfo(np.int64).max)])
        n = np.concatenate([np.ones(len(entries), np.int64), many["n"], np.zeros(len(many), np.int64)])
        order, at, sizes, several = _shared(h, key)
        total = np.add.reduceat(n[order], at) if len(at) else np.zeros(0, np.int64)
        often = several & (total > frequent)
        names, weight = h[order][at[often]], total[often]
        met = order[np.repeat(several, sizes)]
        found = np.concatenate([entries[met[met < len(entries)]], read("sure", _ENTRY)])
        return pa.table({
            "key": np.concatenate([found["key"], names.view(np.int64)]),
            "pos": pa.concat_arrays([pa.array(found["pos"], pa.int32()), pa.nulls(len(names), pa.int32())]),
            "frequent": pa.concat_arrays([pa.nulls(len(found), pa.int64()), pa.array(weight, pa.int64())]),
        })

    return keyed.select("key", "text").mapInArrow(send, "bucket int, open binary, sure binary, many binary").groupBy("bucket").applyInArrow(meet, _FOUND)


def _pieces(candidates: DataFrame, window: int, shards: int, frequent: np.ndarray, batch_text: int) -> DataFrame:
    """candidates (doc_id, key, text, pos) -> shard, text, doc_id, key, start, words: pieces; without text where they are repeats already."""
    schema = pa.schema([("shard", pa.int32()), ("text", pa.binary()), ("doc_id", pa.int64()), ("key", pa.int64()), ("start", pa.int32()), ("words", pa.int32())])
    shared = candidates.sparkSession.sparkContext.broadcast(frequent)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            out = [[] for _ in schema]
            for text, (shard, words, places) in held.items():
                least = min(places)[0]
                for doc, key, start in places:
                    # a piece of a smaller document of this batch is witness enough; such rows are dealt by key
                    row = (key % shards, None, doc, key, start, words) if doc > least else (shard, text, doc, key, start, words)
                    for column, value in zip(out, row, strict=True):
                        column.append(value)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

        for batch in batches:
            for part in _sliced(batch, "text"):
                words = Words(part.column("text"))
                begin, anchor, hashes = words.anchors(window)
                flags = np.zeros(len(words.hash) + 1, bool)
                pos = part.column("pos")
                flags[pos.flatten().to_numpy() + np.repeat(words.first[:-1], np.diff(pos.offsets.to_numpy()))] = True
                chosen = flags[anchor]
                begin, anchor = begin[chosen], anchor[chosen]
                if not len(begin):
                    continue
                often = np.isin(hashes[anchor], shared.value)
                fresh = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (begin[1:] != begin[:-1] + 1)]) | often
                at = np.flatnonzero(fresh)
                last = np.append(at[1:], len(begin)) - 1
                name = np.where(often[at], words.groups(window)[begin[at]], hashes[anchor[at]]) % np.uint64(shards)
                low, high = begin[at], begin[last] + window
                text, docs, keys = words.text[low], part.column("doc_id").to_pylist(), part.column("key").to_pylist()
                data = words.data.tobytes()
                for s, n, a, b, i in zip(name.tolist(), (high - low).tolist(), words.begin[low].tolist(), words.end[high - 1].tolist(), zip(text.tolist(), (low - words.first[text]).tolist(), strict=True), strict=True):
                    piece = b" ".join(data[a:b].split())
                    place = (docs[i[0]], keys[i[0]], i[1])
                    known = held.get(piece)
                    if known is None:
                        held[piece] = (s, n, [place])
                        size += len(piece)
                    else:
                        known[2].append(place)
                    size += 24
                if size >= batch_text:
                    yield flush()
                    held.clear()
                    size = 0
        if held:
            yield flush()

    return candidates.select("doc_id", "key", "text", "pos").mapInArrow(cut, "shard int, text binary, doc_id long, key long, start int, words int")


class Automaton:
    """Windows that two documents hold, with the least of them each, over a shard's distinct pieces in a row."""

    def __init__(self, pieces: pa.Array, least: np.ndarray, most: np.ndarray, window: int) -> None:
        """pieces: distinct texts; least and most: the ends of each one's doc_ids."""
        self.window = window
        lists = pc.split_pattern(pieces, " ")
        words = lists.flatten().dictionary_encode()
        ids = words.indices.to_numpy().astype(np.int64)
        #: Windows of each piece, and the word at which each window starts, in the pieces' order.
        self.count = np.diff(lists.offsets.to_numpy()).astype(np.int64) - window + 1
        self.piece = np.repeat(np.arange(len(pieces)), self.count)
        self.first = np.concatenate([[0], np.cumsum(self.count)])
        self.start = np.arange(len(self.piece)) + (self.piece * (window - 1))
        self.width = 1
        while 256**self.width < len(words.dictionary):
            self.width += 1
        digits = (ids[:, None] >> (8 * np.arange(self.width))) & 255
        self.text = digits.astype(np.uint8).tobytes().decode("latin-1")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for start, n, owner in self._confirmed(ids, least, most):
            self.automaton.add_word(self._words(start, n), (n, owner))
        if len(self.automaton):
            self.automaton.make_automaton()

    def _words(self, start: int, n: int) -> str:
        return self.text[start * self.width : (start + n) * self.width]

    def _confirmed(self, ids: np.ndarray, least: np.ndarray, most: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """Start, number of words and least document of passages: each window that two documents hold lies in one.

        Windows that a single piece has, and several documents by it, form a passage as far as
        they go on; a window that several pieces have is one by itself. Equal hashes are
        compared word by word.
        """
        n = len(ids) - self.window + 1
        h = np.zeros(n, np.uint64)
        for k in range(self.window):
            h = h * _BASE + _mixed(ids[k : k + n].astype(np.uint64) + np.uint64(1))
        order = np.argsort(h[self.start], kind="stable")
        at = _starts(h[self.start][order])
        low, high = np.minimum.reduceat(least[self.piece[order]], at), np.maximum.reduceat(most[self.piece[order]], at)
        begin = self.start[order]
        model = np.repeat(begin[at], np.diff(np.append(at, len(order))))
        other = np.zeros(len(order), bool)
        for k in range(self.window):
            other |= ids[begin + k] != ids[model + k]
        mixed = np.logical_or.reduceat(other, at)
        size = np.diff(np.append(at, len(order)))
        alone = np.zeros(len(order), bool)
        alone[order[at[(size == 1) & (low < high)]]] = True
        alone = np.flatnonzero(alone)
        fresh = np.concatenate([[True], (alone[1:] != alone[:-1] + 1) | (self.piece[alone[1:]] != self.piece[alone[:-1]])])[: len(alone)]
        heads, tails = alone[fresh], alone[np.append(fresh[1:], True)[: len(alone)]]
        yield from zip(self.start[heads].tolist(), (tails - heads + self.window).tolist(), least[self.piece[heads]].tolist(), strict=True)
        several = np.flatnonzero((size > 1) & (low < high) & ~mixed)
        yield from zip(begin[at[several]].tolist(), [self.window] * len(several), low[several].tolist(), strict=True)
        for g in np.flatnonzero(mixed).tolist():  # different windows of one hash
            held: dict[str, list[int]] = {}
            for i in order[at[g] : at[g] + size[g]].tolist():
                held.setdefault(self._words(self.start[i], self.window), []).append(i)
            for members in held.values():
                ends = least[self.piece[members]].min(), most[self.piece[members]].max()
                if ends[0] < ends[1]:
                    yield int(self.start[members[0]]), self.window, int(ends[0])

    def owners(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of the pieces: whether the automaton finds it, and its least doc_id."""
        found, owner = np.zeros(len(self.start), bool), np.zeros(len(self.start), np.int64)
        if len(self.automaton):
            hits = np.array([(e, n, d) for e, (n, d) in self.automaton.iter(self.text)], np.int64).reshape(-1, 3)
            hits = hits[(hits[:, 0] + 1) % self.width == 0]  # not between words
            count = hits[:, 1] - self.window + 1
            last = (hits[:, 0] + 1) // self.width - self.window
            start = np.repeat(last, count) - (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count))
            at = np.searchsorted(self.start, start)
            at[at == len(self.start)] = 0
            real = self.start[at] == start  # not across pieces
            found[at[real]], owner[at[real]] = True, np.repeat(hits[:, 2], count)[real]
        return found, owner


def _located(rows: pa.Table, window: int) -> pa.Table:
    """Pieces of a shard -> key, first, stop: words covered by repeats."""
    known = pc.is_null(rows.column("text"))
    sure, own = rows.filter(known), rows.filter(pc.invert(known))
    number = lambda t, c: t.column(c).to_numpy().astype(np.int64)
    key, first = number(sure, "key"), number(sure, "start")
    stop = first + number(sure, "words")
    if own.num_rows:
        texts = own.column("text").combine_chunks().dictionary_encode()
        piece, doc = texts.indices.to_numpy().astype(np.int64), number(own, "doc_id")
        order = np.argsort(piece, kind="stable")
        at = _starts(piece[order])
        automaton = Automaton(texts.dictionary, np.minimum.reduceat(doc[order], at), np.maximum.reduceat(doc[order], at), window)
        found, owner = automaton.owners()
        count = automaton.count[piece]
        row = np.repeat(np.arange(len(piece)), count)
        step = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        at = automaton.first[piece][row] + step
        hit = found[at] & (owner[at] < doc[row])
        row, step = row[hit], step[hit]
        if len(row):
            fresh = np.concatenate([[True], (row[1:] != row[:-1]) | (step[1:] != step[:-1] + 1)])
            last = np.append(fresh[1:], True)
            begin = number(own, "start")[row] + step
            key, first, stop = (np.concatenate(x) for x in ((key, number(own, "key")[row[fresh]]), (first, begin[fresh]), (stop, begin[last] + window)))
    return pa.table({"key": key, "first": first.astype(np.int32), "stop": stop.astype(np.int32)})


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of both; equal rows have one key and one result."""
    doc = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return doc.withColumn("key", F.xxhash64("doc_id", "text"))


def repeated_spans(docs: DataFrame, window: int = WINDOW, batch_text: int = BATCH_TEXT, frequent: int = FREQUENT) -> DataFrame:
    """docs (doc_id, text) -> key, spans: for rows with repeats (by ``key`` of ``_keyed``) the word ranges [first, stop) that repeats cover, which may overlap.

    ``batch_text``: bytes of a task's batch; ``frequent``: occurrences from which an anchor's windows are dealt one by one.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    release_shuffles(spark)  # what earlier queries left
    keyed = _keyed(docs).filter("doc_id is not null and text is not null")
    size = keyed.agg(F.sum(F.octet_length("text").cast("long")).alias("s")).first()["s"] or 0
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = materialize(shared_anchors(keyed, window, max(parts, -(-size // BUCKET_BYTES)), batch_text, frequent), "repeats-anchors", drop_shuffles=True)
    # frequent anchors: at most MOST_FREQUENT, for each stands for more than a share of all words
    floor = max(frequent, size // (2 * MOST_FREQUENT))
    often = np.array([r.key for r in found.filter(F.col("frequent") > floor).select("key").collect()], np.int64).view(np.uint64)
    places = found.filter("frequent is null").groupBy("key").agg(F.collect_list("pos").alias("pos"))
    # one plan for all sizes: the positions of a share of the keys are hashed, the texts stream by
    candidates = keyed.join(places.hint("shuffle_hash"), "key")
    # shards are several a task, so that tasks even out
    pieces = _pieces(candidates, window, max(4 * parts, -(-size // SHARD_BYTES)), often, batch_text)
    located = pieces.groupBy("shard").applyInArrow(lambda t: _located(t, window), "key long, first int, stop int")
    return located.groupBy("key").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))


def without_repeats(docs: DataFrame, window: int = WINDOW, **bounds: int) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_removed, kept: the words that no repeat covers, joined by one space. ``bounds``: see ``repeated_spans``."""
    spans = materialize(repeated_spans(docs, window, **bounds), "repeats-spans", drop_shuffles=True)
    known = _keyed(docs).withColumn("key", F.when(F.col("doc_id").isNotNull(), F.col("key"))).join(spans.hint("shuffle_hash"), "key", "left")
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[], [], []]
            for text, own in zip(batch.column("text"), batch.column("spans"), strict=True):
                words = (text.as_py() or "").encode().split()
                n = len(words)
                if own.is_valid:
                    gone = np.zeros(n + 1, np.int64)
                    cells = own.values.flatten()
                    np.add.at(gone, cells[0].to_numpy(), 1)
                    np.add.at(gone, cells[1].to_numpy(), -1)
                    words = [words[k] for k in np.flatnonzero(gone.cumsum()[:n] == 0).tolist()]
                for column, value in zip(out, (n, n - len(words), b" ".join(words).decode()), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(out, list(schema)[1:], strict=True)]], schema=schema)

    return known.select("doc_id", "text", "spans").mapInArrow(strip, "doc_id long, n_words long, n_removed long, kept string")

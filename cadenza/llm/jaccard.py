"""N-gram Jaccard self-join of documents by signature trees.

Documents with equal shingle sets form a class; links are searched between classes.

1. Leaves. Two sets with a Jaccard similarity of at least t share l of the first
   n - ceil(t n) + l elements under any common order, l being a tenth of the smaller
   size. The order puts often repeated shingles last. Only these prefixes are shuffled,
   by shingle (a shingle of many classes in lanes). A class that meets others at fewer than l of its shingles has no link;
   such classes go, and with them the documents that merely share a passage. Classes
   that still meet, within reach of each other's size, are under one root. Without this
   step a tree over all documents has nothing to prune: the OR of a few hundred unrelated
   bitmaps is full, so all pairs of upper nodes survive (see the README for figures).
2. Trees. Under a root the classes lie in order of size and are cut into chunks, the
   nodes that one task holds: ``GROUP`` classes or ``CHUNK_BYTES`` of sets at most. Inside
   a chunk nodes of ``_FAN`` children hold the OR of their sets' token bitmaps and the range
   of their sizes; chunks do so too, and so do blocks of chunks.
3. Dual traversal. A pair of nodes is dropped if the sizes exclude each other or if the
   largest possible overlap (common bits, and the tokens that share a bit) is below what
   the smallest sizes need. It runs inside each chunk, then over blocks of chunk nodes, and
   at last between the chunks that are left, of which no task holds more than two. Pairs of
   sets that survive are compared exactly. ``components_of`` skips pairs that are linked
   already: it joins neighbouring chunks first and leaves out pairs of chunks that have
   become one component; ``links_of`` skips nothing and gives every link.
4. Each task names its components; names that later links join are merged by
   alternating stars.

Nothing is sampled and no candidate is capped. The list of frequent shingles (at most
``COMMON``) and the candidate bitmap (2 MB) only order or filter work.

Defined cases: a null or wordless text has an empty set, size 0, and is its own
component; a text with fewer than k words is one shingle; repeated rows are in one
class; a null doc_id never names a component unless all ids of it are null; an empty
table gives an empty table; extra columns are ignored by ``components_of`` and
``links_of`` and kept by ``keep_one``. Sets are told apart by 128-bit, shingles by 64-bit
hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.components import connected_components
from cadenza.llm.frequent import most_frequent
from cadenza.llm.rows import packed_rows
from cadenza.llm.shingles import shingle_sets, sliced
from cadenza.session import materialize, small_side

#: Classes and bytes of sets in a chunk (one set at least); a task of the search holds two chunks at most.
GROUP, CHUNK_BYTES = 2048, 32 << 20
#: Chunk nodes in a block, and bits of their bitmaps.
BLOCK, NODE_BITS = 256, 1 << 16
#: Shingles that are ordered last.
COMMON = 65_536
#: Postings of a frequent shingle that make up a lane, a part that a task sorts on its own.
LANE_ROWS = 1 << 14
_BITMAP_BITS = 24
_FAN = 8


def _key(own: np.ndarray) -> bytes:
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest()


def _low(key: bytes) -> int:
    return int.from_bytes(key[:8], "little", signed=True)


def shared_least(n: int) -> int:
    """How many prefix elements two linked sets share at least, n being the smaller size; never falls with n."""
    return max(1, n // 10)


def prefix_length(n: int, percent: int) -> int:
    return n - -(-percent * n // 100) + shared_least(n)


def need(x: np.ndarray, y: np.ndarray, percent: int) -> np.ndarray:
    """The least overlap of sets of sizes x and y that are linked."""
    return -(-percent * (x + y) // (100 + percent))


def _scan(docs: DataFrame, k: int) -> DataFrame:
    """Rows of two kinds: documents (doc_id, n, key), and shingles repeated in a slice (shingle, n)."""
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("shingle", pa.int64()), ("n", pa.int64())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in sliced(batch, 1):
                sizes, keys, sets = [], [], {}
                for own in shingle_sets(part.column(1), k):
                    key = _key(own) if len(own) else None
                    sizes.append(len(own))
                    keys.append(key)
                    if key:
                        sets[key] = own
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.nulls(len(sizes), pa.int64()), pa.array(sizes, pa.int64())], schema=schema)
                if sets:
                    found, n = np.unique(np.concatenate(list(sets.values())), return_counts=True)
                    found, n = found[n > 1], n[n > 1]
                    yield pa.RecordBatch.from_arrays([pa.nulls(len(n), pa.int64()), pa.nulls(len(n), pa.binary()), pa.array(found.view(np.int64)), pa.array(n)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(scan, "doc_id long, key binary, shingle long, n long")


class Order:
    """Frequent shingles last, the most frequent at the very end; all others by hash.

    frequent: (shingle, number of sets), rarest first. A shingle of more than ``LANE_ROWS``
    sets has lanes: 1 and on, by class; all others have lane 0.
    """

    def __init__(self, frequent: list[tuple[int, int]]) -> None:
        shingles = np.array([s for s, _ in frequent], np.int64).view(np.uint64)
        at = np.argsort(shingles, kind="stable")
        self.shingles, self.ranks = shingles[at], at + 1
        counts = np.array([n for _, n in frequent], np.int64)[at]
        hot = counts > LANE_ROWS
        self.hot, self.lanes = self.shingles[hot], -(-counts[hot] // LANE_ROWS)

    def lane(self, shingles: np.ndarray, cls: np.ndarray) -> np.ndarray:
        if not len(self.hot):
            return np.zeros(len(shingles), np.int32)
        at = np.minimum(np.searchsorted(self.hot, shingles), len(self.hot) - 1)
        return np.where(self.hot[at] == shingles, 1 + cls % self.lanes[at], 0).astype(np.int32)

    def prefix(self, own: np.ndarray, length: int) -> np.ndarray:
        if not len(self.shingles):
            return own[:length]
        at = np.minimum(np.searchsorted(self.shingles, own), len(self.shingles) - 1)
        rank = np.where(self.shingles[at] == own, self.ranks[at], 0)
        return own[np.argsort(rank, kind="stable")[:length]]


def _postings(docs: DataFrame, k: int, percent: int, order: Order) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            for part in sliced(batch, 0):
                shingles, low, size = [], [], []
                for own in shingle_sets(part.column(0), k):
                    n = len(own)
                    if 100 * n >= percent * (n + 1) and (key := _key(own)) not in seen:  # smaller sets link to equal ones only
                        seen.add(key)
                        shingles.append(shared.value.prefix(own, prefix_length(n, percent)))
                        low.append(_low(key))
                        size.append(n)
                if shingles:
                    each = [len(s) for s in shingles]
                    flat, cls = np.concatenate(shingles), np.repeat(np.array(low, np.int64), each)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(flat.view(np.int64)), pa.array(shared.value.lane(flat, cls)), pa.array(np.repeat(np.array(size, np.int32), each)), pa.array(cls)],
                        ["shingle", "lane", "n", "cls"],
                    )

    return docs.select("text").mapInArrow(emit, "shingle long, lane int, n int, cls long")


def _run_starts(shingle: np.ndarray, lane: np.ndarray, n: np.ndarray, percent: int) -> np.ndarray:
    """Runs of one shingle and lane, cut where the next larger size is out of reach."""
    return np.flatnonzero(np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (lane[1:] != lane[:-1]) | (n[1:] * percent > n[:-1] * 100)]))


def _by_shingle(postings: DataFrame) -> DataFrame:
    order = ["shingle", "lane", "n", "cls"]
    return postings.select(*order).repartition("shingle", "lane").sortWithinPartitions(*order)


def _met(postings: DataFrame, percent: int) -> DataFrame:
    """The postings at which two classes or more meet, and all of shingles with lanes."""

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, sent = tuple(np.zeros(0, np.int64) for _ in range(4)), False
        for batch in batches:
            shingle, lane, n, cls = (np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True))
            if not len(shingle):
                continue
            new = np.concatenate([[True], (shingle[1:] != shingle[:-1]) | (cls[1:] != cls[:-1])])
            shingle, lane, n, cls = shingle[new], lane[new], n[new], cls[new]
            starts = _run_starts(shingle, lane, n, percent)
            count = np.diff([*starts, len(cls)])
            shared = (count > 1) | (lane[starts] > 0)
            out = np.repeat(shared, count)
            if sent:
                out[0] = False  # the held row is out already, and whoever joins it is not alone
            open_sent = bool(shared[-1]) or (sent and len(starts) == 1)
            if out.any():
                cols = shingle[out], lane[out].astype(np.int32), n[out].astype(np.int32), cls[out]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["shingle", "lane", "n", "cls"])
            held, sent = (shingle[-1:], lane[-1:], n[-1:], cls[-1:]), open_sent

    return _by_shingle(postings).mapInArrow(meet, "shingle long, lane int, n int, cls long")


_MASK = (1 << _BITMAP_BITS) - 1


def _bitmap(classes: DataFrame) -> DataFrame:
    """The classes' low bits as a bitmap (w, v): 2^18 rows at most, whatever the number of classes."""
    word = F.shiftright(F.col("cls").bitwiseAND(F.lit(_MASK)), 6)
    return classes.groupBy(word.alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(cls & 63 as int))")).alias("v"))


def _candidates(postings: DataFrame, percent: int) -> DataFrame:
    """The postings of classes that meet others often enough to have a link, and of a few others (bitmap)."""
    met = materialize(_met(postings, percent), "jaccard-met")
    smallest = F.ceil(F.col("n") * percent / 100)  # of the sets linked to one of size n
    often = met.groupBy("cls").agg(F.max("n").alias("n"), F.count("*").alias("hits")).filter(F.col("hits") >= F.greatest(F.lit(1), F.floor(smallest / 10)))
    bits = F.broadcast(_bitmap(often))  # 2^18 rows at most
    hit = met.join(bits, F.shiftright(F.col("cls").bitwiseAND(F.lit(_MASK)), 6) == F.col("w"))
    return hit.filter(F.expr("(shiftright(v, cast(cls & 63 as int)) & 1) = 1")).drop("w", "v")


def _meetings(postings: DataFrame, percent: int, lanes: bool) -> DataFrame:
    """Edges (a, b) between classes that share a prefix shingle and whose sizes allow a chain of links; some come twice.

    A lane's runs name the range of their sizes. Runs of all lanes of a shingle are chained
    where these ranges are within reach, as if the lanes had been sorted together.
    """

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = tuple(np.zeros(0, np.int64) for _ in range(4))
        for batch in batches:
            shingle, lane, n, cls = (np.concatenate([h, c.to_numpy().astype(np.int64)]) for h, c in zip(held, batch.columns, strict=True))
            if not len(shingle):
                continue
            starts = _run_starts(shingle, lane, n, percent)
            ends = np.append(starts[1:], len(cls))
            least = np.minimum.reduceat(cls, starts)
            root = np.repeat(least, ends - starts)
            pairs = np.stack([cls, root], 1)[cls != root]
            if len(pairs):
                pairs = np.unique(pairs, axis=0)
                none = pa.nulls(len(pairs), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy()), none, none, none], ["a", "b", "shingle", "low", "high"])
            hot = lane[starts] > 0
            if hot.any():
                own = pa.array(least[hot])
                yield pa.RecordBatch.from_arrays([own, own, pa.array(shingle[starts[hot]]), pa.array(n[starts[hot]]), pa.array(n[ends[hot] - 1])], ["a", "b", "shingle", "low", "high"])
            held = shingle[-1:], lane[-1:], n[-1:], least[-1:]  # the last run may go on: its least class stands for it

    found = _by_shingle(postings).mapInArrow(meet, "a long, b long, shingle long, low long, high long")
    if not lanes:
        return found.select("a", "b")
    found = materialize(found.distinct(), "jaccard-meetings")
    order = Window.partitionBy("shingle").orderBy("low", "high", "a")  # a row per lane and run of sizes
    reach = F.max("high").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = found.filter("shingle is not null").withColumn("cut", F.coalesce(F.col("low") * percent > reach * 100, F.lit(True)).cast("int"))
    chains = runs.withColumn("chain", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    named = chains.withColumn("b", F.min("a").over(Window.partitionBy("shingle", "chain")))
    return found.filter("shingle is null").select("a", "b").union(named.select("a", "b"))


def _sets(docs: DataFrame, k: int, nodes: DataFrame) -> DataFrame:
    """The sets of the classes in nodes (cls, ..), once each: the nodes' columns, key, own (bytes).

    A task writes a class once; of several tasks' copies a narrow aggregate picks one.
    """
    words = _bitmap(nodes).collect()  # 2^18 rows at most
    bits = np.zeros(1 << (_BITMAP_BITS - 6), np.uint64)
    if words:
        bits[[r.w for r in words]] = np.array([r.v for r in words], np.int64).view(np.uint64)
    shared = docs.sparkSession.sparkContext.broadcast(bits)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        table, seen, part_id = shared.value, set(), TaskContext.get().partitionId()
        for batch in batches:
            for part in sliced(batch, 0):
                rows = []
                for own in shingle_sets(part.column(0), k):
                    if len(own):
                        key = _key(own)
                        low = _low(key)
                        if key not in seen and int(table[(low & _MASK) >> 6]) >> (low & 63) & 1:
                            seen.add(key)
                            rows.append((low, key.hex(), part_id, own.tobytes()))
                if rows:
                    cols = list(zip(*rows, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.binary()), strict=True)], ["cls", "key", "part", "own"])

    found = materialize(docs.select("text").mapInArrow(emit, "cls long, key string, part int, own binary"), "jaccard-sets")
    picked = found.groupBy("cls", "key").agg(F.min("part").alias("part")).join(nodes, "cls")
    return found.join(small_side(materialize(picked, "jaccard-picked")), ["cls", "key", "part"]).drop("part")


_ONES = np.array([bin(i).count("1") for i in range(256)], np.uint8)


def _popcount(rows: np.ndarray) -> np.ndarray:
    return np.bitwise_count(rows).sum(axis=-1, dtype=np.int64) if hasattr(np, "bitwise_count") else _ONES[rows.view(np.uint8)].sum(axis=-1, dtype=np.int64)


class SignatureTree:
    """Levels of nodes over sets that are ordered by least shingle and size; level 0 holds the sets.

    tested, kept: pairs of nodes that the traversal has looked at, and those it could not drop.
    """

    def __init__(self, sets: list[np.ndarray]) -> None:
        self.order = sorted(range(len(sets)), key=lambda i: (int(sets[i][0]), len(sets[i])))
        sizes = np.array([len(sets[i]) for i in self.order], np.int64)
        width = 1 << int(np.clip(int(4 * sizes.max() - 1).bit_length(), 8, 16))
        bits = np.zeros((len(sets), width // 64), np.uint64)
        for row, i in enumerate(self.order):
            at = sets[i] % np.uint64(width)
            np.bitwise_or.at(bits[row], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
        self._grow(bits, sizes, sizes, sizes - _popcount(bits))

    @classmethod
    def over(cls, bits: np.ndarray, low: np.ndarray, high: np.ndarray, extra: np.ndarray) -> SignatureTree:
        """A tree whose level 0 are nodes: bitmaps, ranges of size, tokens beyond the bits at most."""
        self = cls.__new__(cls)
        self.order = list(range(len(bits)))
        self._grow(bits, low, high, extra)
        return self

    def _grow(self, bits: np.ndarray, low: np.ndarray, high: np.ndarray, extra: np.ndarray) -> None:
        self.levels, self.tested, self.kept = [(bits, low, high, extra)], 0, 0
        while len(self.levels[-1][0]) > 1:
            bits, low, high, extra = self.levels[-1]
            at = np.arange(0, len(bits), _FAN)
            self.levels.append((np.bitwise_or.reduceat(bits, at, axis=0), np.minimum.reduceat(low, at), np.maximum.reduceat(high, at), np.maximum.reduceat(extra, at)))

    def pairs(self, percent: int) -> Iterator[np.ndarray]:
        """Pairs of sets (positions in the order) that no bound excludes, by dual traversal."""
        level = len(self.levels) - 1
        stack = [(level, np.zeros((1, 2), np.int64))]
        while stack:
            level, pairs = stack.pop()
            self.tested += len(pairs)
            pairs = pairs[self._possible(level, pairs[:, 0], pairs[:, 1], percent)]
            self.kept += len(pairs)
            if level == 0:
                yield pairs[pairs[:, 0] != pairs[:, 1]]
                continue
            below = len(self.levels[level - 1][0])
            step = np.arange(_FAN)
            a = np.repeat((pairs[:, :1] * _FAN + step)[:, :, None], _FAN, 2).reshape(-1)
            b = np.repeat((pairs[:, 1:] * _FAN + step)[:, None, :], _FAN, 1).reshape(-1)
            keep = (a < below) & (b < below) & ((a < b) if level == 1 else (a <= b))
            children = np.stack([a[keep], b[keep]], 1)
            stack += [(level - 1, children[at : at + 2048]) for at in range(0, len(children), 2048)][::-1]

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
        bits, low, high, extra = self.levels[level]
        ok = (high[a] * 100 >= low[b] * percent) & (high[b] * 100 >= low[a] * percent)
        at = np.flatnonzero(ok)
        if not len(at):
            return ok
        a, b = a[at], b[at]
        common = _popcount(bits[a] & bits[b])
        ok[at] = common + np.minimum(extra[a], extra[b]) >= need(low[a], low[b], percent)
        return ok


def _fold(own: np.ndarray) -> tuple[np.ndarray, int]:
    """A set's bitmap of a chunk node, and its tokens beyond the bits."""
    at = own % np.uint64(NODE_BITS)
    bits = np.zeros(NODE_BITS // 64, np.uint64)
    np.bitwise_or.at(bits, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return bits, len(own) - len(np.unique(at))


def link_sets(sets: list[np.ndarray], labels: list, percent: int, every: bool = False) -> list[tuple[int, int]]:
    """Links that join all components of the sets, beyond those that equal labels already join; or every link."""
    root = list(range(len(sets)))

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    first: dict = {}
    for i, label in enumerate(labels):
        root[find(i)] = find(first.setdefault(label, i))
    out, tree = [], SignatureTree(sets)
    for pairs in tree.pairs(percent):
        for p, q in pairs.tolist():
            i, j = tree.order[p], tree.order[q]
            if every or find(i) != find(j):
                x, y = sets[i], sets[j]
                common = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * common >= percent * (len(x) + len(y) - common):
                    root[find(i)] = find(j)
                    out.append((i, j))
    return out


def _inside(sets: DataFrame, percent: int, every: bool) -> DataFrame:
    """Chunk by chunk, of sets (chunk, chunks, key, own): rows a, b, and a row (chunk, low, high, extra, bits) for the chunk's node.

    a, b: each linked key and the least key of its component in the chunk; or every linked
    pair. Chunks that are alone under their root need no node.
    """

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, own = pdf["key"].tolist(), [np.frombuffer(x, np.uint64) for x in pdf["own"]]
        pairs = [(keys[i], keys[j]) for i, j in link_sets(own, keys, percent, every)]
        if not every:
            near: dict[str, set[str]] = {}
            for x, y in pairs:
                whole = near.setdefault(x, {x}) | near.setdefault(y, {y})
                near.update(dict.fromkeys(whole, whole))
            pairs = [(key, least) for key, whole in near.items() if (least := min(whole)) != key]
        out = [(x, y, None, None, None, None, None) for x, y in pairs]
        if pdf["chunks"].iloc[0] > 1:
            sizes, bits, extra = list(map(len, own)), np.zeros(NODE_BITS // 64, np.uint64), 0
            for x in own:
                of, more = _fold(x)
                bits, extra = bits | of, max(extra, more)
            out.append((None, None, pdf["chunk"].iloc[0], min(sizes), max(sizes), extra, bits.tobytes()))
        return pd.DataFrame(out, columns=["a", "b", "node", "low", "high", "extra", "bits"], dtype=object)

    return sets.select("chunk", "chunks", "key", "own").groupBy("chunk").applyInPandas(search, "a string, b string, node string, low long, high long, extra long, bits binary")


def _node_pairs(nodes: DataFrame, chunks: DataFrame, percent: int) -> DataFrame:
    """Pairs of chunks under one root that no bound excludes: x, y, beside (neighbours in the order of size).

    nodes (node, low, high, extra, bits), chunks (chunk, grp). Blocks of nodes are joined
    within a root, and each pair of blocks is walked as a tree over its nodes.
    """
    order = Window.partitionBy("grp").orderBy("low", "node")
    placed = nodes.join(chunks, F.col("node") == F.col("chunk")).select("grp", "node", "low").withColumn("at", F.row_number().over(order) - 1)
    own = nodes.join(placed.drop("low"), "node").withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = own.groupBy("grp", "block").agg(F.collect_list(F.struct("at", "node", "low", "high", "extra", "bits")).alias("nodes"))  # BLOCK at most
    blocks = materialize(blocks, "jaccard-blocks")
    other = blocks.toDF("grp", "block2", "nodes2")
    joined = blocks.join(other, "grp").filter("block <= block2").select((F.col("block") == F.col("block2")).alias("same"), "nodes", "nodes2")

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                same, left, right = (c[row].as_py() for c in batch.columns)
                rows = left if same else left + right
                rows, split = sorted(rows, key=lambda n: (n["low"], n["at"])), {n["at"] for n in left}
                bits = np.stack([np.frombuffer(n["bits"], np.uint64) for n in rows])
                tree = SignatureTree.over(bits, *[np.array([n[c] for n in rows]) for c in ("low", "high", "extra")])
                out = [(rows[a], rows[b]) for pairs in tree.pairs(percent) for a, b in pairs.tolist()]
                out = [(x, y) for x, y in out if same or (x["at"] in split) != (y["at"] in split)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x["node"] for x, _ in out], pa.string()), pa.array([y["node"] for _, y in out], pa.string()), pa.array([abs(x["at"] - y["at"]) == 1 for x, y in out], pa.bool_())], ["x", "y", "beside"]
                )

    return joined.mapInArrow(walk, "x string, y string, beside boolean")


def _across(rows: DataFrame, pairs: DataFrame, percent: int, every: bool) -> DataFrame:
    """Links between the chunks of each pair (x, y): a, b, labels. rows (chunk, key, label, own)."""
    tasks = pairs.select(F.concat_ws(":", "x", "y").alias("task"), F.explode(F.array("x", "y")).alias("chunk"))

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        labels, chunk = pdf["label"].tolist(), pdf["chunk"].tolist()
        links = link_sets([np.frombuffer(x, np.uint64) for x in pdf["own"]], labels, percent, every)
        return pd.DataFrame([(labels[i], labels[j]) for i, j in links if chunk[i] != chunk[j] or not every], columns=["a", "b"], dtype=object)

    joined = rows.select("chunk", "label", "own").join(small_side(tasks), "chunk")
    return joined.groupBy("task").applyInPandas(search, "a string, b string")


def _chunked(nodes: DataFrame) -> DataFrame:
    """nodes (cls, grp, n) with chunk and chunks: neighbours by size under one root, cut by number and bytes."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, count, held, root = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            names = []
            for grp, n in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if root != grp or count == GROUP or held + 8 * n > CHUNK_BYTES:
                    made, count, held, root = made + 1, 0, 0, grp
                count, held = count + 1, held + 8 * n
                names.append(f"{part:06d}-{made:06d}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string())], ["cls", "grp", "n", "chunk"])

    order = ["grp", "n", "cls"]
    cut_up = nodes.select("cls", "grp", "n").repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(cut, "cls long, grp long, n int, chunk string")
    cut_up = materialize(cut_up, "jaccard-cut")
    sizes = cut_up.groupBy("grp").agg(F.count_distinct("chunk").cast("int").alias("chunks"))
    return materialize(cut_up.join(sizes, "grp"), "jaccard-nodes")


def _leaves(docs: DataFrame, k: int, percent: int, frequent: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
    """nodes (cls, grp, n, chunk, chunks) and sets (those, key, own) of all classes that may have a link."""
    order = Order(frequent)
    met = materialize(_candidates(_postings(docs, k, percent, order), percent), "jaccard-candidates")
    groups = connected_components(_meetings(met, percent, len(order.hot) > 0)).toDF("cls", "grp")
    nodes = _chunked(groups.join(met.groupBy("cls").agg(F.max("n").alias("n")), "cls"))
    return nodes, _sets(docs, k, nodes)


def _roots(docs: DataFrame, k: int, percent: int, frequent: list[tuple[int, int]]) -> DataFrame:
    """key, root: every linked class with the name of its component."""
    nodes, sets = _leaves(docs, k, percent, frequent)
    found = materialize(_inside(sets, percent, every=False), "jaccard-inside")
    first = found.filter("a is not null").select(F.col("a").alias("key"), F.col("b").alias("root"))
    if not nodes.filter("chunks > 1").limit(1).count():
        return first.union(first.select("root", "root").distinct())

    def labelled(rows: DataFrame, names: DataFrame, column: str) -> DataFrame:
        """rows with the name that names (key, root) gives to ``column`` as their label."""
        known = small_side(names.toDF("__key", "__root"))
        return rows.join(known, F.col(column) == F.col("__key"), "left").withColumn("label", F.coalesce("__root", column)).drop("__key", "__root")

    pairs = _node_pairs(found.filter("node is not null").drop("a", "b"), nodes.filter("chunks > 1").select("chunk", "grp").distinct(), percent)
    pairs = materialize(pairs, "jaccard-node-pairs")
    large = labelled(sets.filter("chunks > 1"), first, "key")
    joined = materialize(_across(large, pairs.filter("beside"), percent, every=False), "jaccard-joined")
    merged = connected_components(joined)
    apart = pairs.filter("not beside")
    if apart.limit(1).count():
        rows = labelled(large, merged, "label")
        parts = materialize(rows.groupBy("chunk").agg(F.min("label").alias("low"), F.max("label").alias("high")), "jaccard-parts")
        sides = [parts.toDF(side, f"low_{side}", f"high_{side}") for side in ("x", "y")]
        one = "low_x = high_x AND low_y = high_y AND low_x = low_y"  # both chunks are in one component already
        apart = materialize(apart.join(sides[0], "x").join(sides[1], "y").filter(f"NOT ({one})").select("x", "y"), "jaccard-apart")
        more = materialize(_across(rows, apart, percent, every=False), "jaccard-joined")
        if more.limit(1).count():
            merged = connected_components(joined.union(more))
    names = first.union(first.select("root", "root")).union(merged.select("node", "node")).distinct()
    return labelled(names, merged, "root").select("key", F.col("label").alias("root"))


def _scanned(docs: DataFrame, k: int) -> tuple[DataFrame, list[tuple[int, int]]]:
    """rows (doc_id, n, key), and the frequent shingles with their numbers, rarest first."""
    scanned = materialize(_scan(docs, k), "jaccard-scan")
    repeated = scanned.filter("shingle is not null").groupBy("shingle").agg(F.sum("n").alias("n"))
    top = most_frequent(repeated, COMMON, "shingle")
    return scanned.filter("shingle is null").select("doc_id", "n", F.lower(F.hex("key")).alias("key")), [(r.shingle, r.n) for r in reversed(top)]


def links_of(docs: DataFrame, k: int = 5, percent: int = 75) -> tuple[DataFrame, DataFrame]:
    """Every link between classes (a < b, keys of different sets), and the members (doc_id, n_shingles, key).

    Documents with equal keys are linked too; those without words have no key and no link.
    """
    rows, frequent = _scanned(docs, k)
    nodes, sets = _leaves(docs, k, percent, frequent)
    found = materialize(_inside(sets, percent, every=True), "jaccard-inside")
    links = found.filter("a is not null").select("a", "b")
    if nodes.filter("chunks > 1").limit(1).count():
        pairs = _node_pairs(found.filter("node is not null").drop("a", "b"), nodes.filter("chunks > 1").select("chunk", "grp").distinct(), percent)
        links = links.union(_across(sets.withColumn("label", F.col("key")), materialize(pairs, "jaccard-node-pairs"), percent, every=True))
    return links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), rows.select("doc_id", F.col("n").alias("n_shingles"), "key")


def _classes(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """key, copies, least and first (of its rows), component and keeper (of its component's rows)."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "key"))
    classes = rows.filter("key is not null").groupBy("key").agg(F.min("doc_id").alias("least"), first.alias("first"), F.count("*").alias("copies"))
    classes = materialize(classes.join(roots, "key", "left"), "jaccard-classes")
    linked = small_side(materialize(classes.filter("root is not null").groupBy("root").agg(F.min("least").alias("component"), F.min("first").alias("keeper")), "jaccard-linked"))
    named = classes.filter("root is not null or copies > 1").join(linked, "root", "left")
    return materialize(named.select("key", F.coalesce("component", "least").alias("component"), F.coalesce("keeper", "first").alias("keeper")), "jaccard-named")


def components_of(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """A row per document: doc_id, n_shingles, component_id."""
    rows, frequent = _scanned(docs, k)
    named = small_side(_classes(rows, _roots(docs, k, percent, frequent)).select("key", "component"))
    return rows.join(named, "key", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, k: int = 5, percent: int = 75) -> DataFrame:
    """Of each component one row stays; columns unchanged, whatever their names. Documents without words stay.

    That row has the smallest id (a null id comes last), of equal ids the smallest set key.
    Rows are decided by id where it names one row, and by id and set key where it is null or
    repeated, so rows of other components are left alone.
    """
    return _keep_one(packed_rows(docs, "doc_id", "text"), k, percent).select("row.*")


def _keep_one(docs: DataFrame, k: int, percent: int) -> DataFrame:
    rows, frequent = _scanned(docs, k)
    named = small_side(_classes(rows, _roots(docs, k, percent, frequent)))
    lost = ~F.col("keeper.doc_id").eqNullSafe(F.col("doc_id")) | (F.col("keeper.key") != F.col("key"))
    judged = rows.join(named, "key").select("doc_id", lost.alias("lost"))
    ids = materialize(rows.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select(F.col("doc_id").alias("__twice")), "jaccard-twice")
    gone = judged.filter("lost and doc_id is not null").select(F.col("doc_id").alias("__gone")).distinct()
    gone = small_side(materialize(gone.join(ids, F.col("__gone") == F.col("__twice"), "left_anti"), "jaccard-gone"))
    left = docs.join(gone, docs["doc_id"] == F.col("__gone"), "left_anti")
    vague = rows.filter("doc_id is null").limit(1).count() or ids.limit(1).count()
    if not vague:
        return left
    twice = small_side(ids)
    plain = left.filter("doc_id is not null").join(twice, left["doc_id"] == F.col("__twice"), "left_anti")
    unsure = left.filter("doc_id is null").unionByName(left.join(twice, left["doc_id"] == F.col("__twice"), "left_semi"))

    @F.pandas_udf("string")
    def set_key(texts: pd.Series) -> pd.Series:
        batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string(), from_pandas=True)], ["text"])
        return pd.Series([_key(own).hex() if len(own) else None for part in sliced(batch, 0) for own in shingle_sets(part.column(0), k)], dtype=object)

    keyed = unsure.withColumn("__key", set_key(F.col("text")))
    keepers = named.select(F.col("key").alias("__named"), F.col("keeper.doc_id").alias("__id"), F.col("keeper.key").alias("__first"))
    known = keyed.join(keepers, F.col("__key") == F.col("__named"), "left")
    kept = known.filter(F.col("__named").isNull() | (F.col("__id").eqNullSafe(F.col("doc_id")) & (F.col("__first") == F.col("__key"))))
    nth = F.row_number().over(Window.partitionBy("doc_id", "__key").orderBy("text"))
    single = kept.filter("__named is not null").withColumn("__nth", nth).filter("__nth = 1").select(*docs.columns)
    return plain.unionByName(kept.filter("__named is null").select(*docs.columns)).unionByName(single)

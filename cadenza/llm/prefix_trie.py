"""Trie of conversations' beginnings from padded matrices of turn ids.

A turn's id is 120 bits of the SHA-256 of its role and text. Conversations are cut into
strips of ``WIDTH`` turns; a strip's row starts from the digest of all turns before it, so a
conversation of any length is rows of bounded size and all strips are treated at once.
Rows are range-partitioned by (strip, digest, ids, id) into shards of about ``SHARD_ROWS``
rows: equal beginnings are neighbours, however many conversations share them, and a hot
beginning spreads over many shards. In a shard the ids form a padded matrix: lexsort orders
it, a change of a column against the row above, OR-accumulated over the columns, marks
where nodes start, and reduceat aggregates every depth. Each shard also sees the last row
before it and the first after it, so a start counts once over all shards and a node at a
boundary is the sum of its parts; those few nodes recombine in a grouped aggregate.

Defined cases: rows without conv_id belong to no conversation and are left out; turns of
one number (or none; these come first) are ordered by role and text; a null role or text is
empty; conversations whose rebuilt turns are none are members of the root alone; an empty
table gives an empty table; other columns are ignored. The digest of the conversations
that end in a node is sequential by its definition: their ids are joined in the shards,
and one pass over the joined pieces of a node hashes them, a piece at a time.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.merkle import CRC32_SQL
from cadenza.operators.order import numbered
from cadenza.session import bounded_batches, materialize, small_side

#: Turns of a strip, and rows of a shard, about.
WIDTH, SHARD_ROWS = 64, 32_768
#: Most turns that a rebuilt conversation takes from another.
MOST_SHARED = 5
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
_NO_ENDS = hashlib.sha256(b"").hexdigest()
#: Hex digits of a digest that name a node or a state.
_DIGITS = 30


def ordered_turns(rows: DataFrame) -> DataFrame:
    """conversations (conv_id, turn, role, text) -> conv_id, hi, lo (the turn's id), chars, place: turns of a conversation have consecutive places."""
    text = lambda name: F.coalesce(F.col(name).cast("string"), F.lit(""))
    clean = rows.filter(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", text("role").alias("role"), text("text").alias("text"))
    digest = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    part = lambda at: F.conv(F.substring(digest, at, 15), 16, 10).cast("long")
    columns = [F.col("conv_id"), part(1).alias("hi"), part(16).alias("lo"), F.char_length("text").cast("long").alias("chars")]
    return numbered(clean, [F.col("conv_id"), F.asc_nulls_first("turn"), F.col("role"), F.col("text")], "trie-turns", columns)


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: (conv_id, size) and their turns (conv_id, size, pos, hi, lo, chars).

    Conversation c takes its first crc32(c) % 6 turns from conversation c - c % 100.
    """
    sizes = materialize(turns.groupBy("conv_id").agg(F.min("place").alias("begin"), F.count("*").alias("n")), "trie-sizes")
    first = turns.filter("conv_id % 100 = 0").join(small_side(sizes), "conv_id").filter(F.col("place") - F.col("begin") < MOST_SHARED)
    heads = first.groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(F.struct("place", "hi", "lo", "chars"))).alias("head"))
    taken = F.crc32(F.col("conv_id").cast("string")) % (MOST_SHARED + 1)
    plan = sizes.select("*", taken.alias("taken"), (F.col("conv_id") - F.col("conv_id") % 100).alias("base")).join(heads, "base", "left")
    plan = plan.withColumn("shared", F.least("taken", F.coalesce(F.size("head"), F.lit(0)).cast("long")))
    plan = plan.withColumn("size", F.col("shared") + F.greatest(F.col("n") - F.col("taken"), F.lit(0)))
    plan = materialize(plan.select("conv_id", "begin", "taken", "shared", "size", F.slice("head", 1, F.col("shared").cast("int")).alias("head")), "trie-plan")
    other = plan.filter("shared > 0").select("conv_id", "size", F.posexplode("head").alias("pos", "t")).select("conv_id", "size", F.col("pos").cast("long").alias("pos"), "t.hi", "t.lo", "t.chars")
    own = turns.join(small_side(plan.select("conv_id", "begin", "taken", "shared", "size")), "conv_id")
    pos = F.col("place") - F.col("begin") - F.col("taken")
    own = own.filter(pos >= 0).select("conv_id", "size", (pos + F.col("shared")).alias("pos"), "hi", "lo", "chars")
    return plan.select("conv_id", "size"), own.unionByName(other)


def _chained(strips: DataFrame) -> DataFrame:
    """strips (conv_id, strip, digest) of long conversations -> conv_id, strip, state: the digest of all turns before the strip."""

    def chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for conv, digests in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                states, state = [], ""
                for d in digests[:-1]:
                    state = hashlib.sha256((state + d).encode()).hexdigest()[:_DIGITS]
                    states.append(state)
                k = len(states)
                yield pa.RecordBatch.from_arrays([pa.array([conv] * k, pa.int64()), pa.array(range(1, k + 1), pa.int64()), pa.array(states, pa.string())], ["conv_id", "strip", "state"])

    listed = strips.groupBy("conv_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("strip", "digest"))), lambda s: s["digest"]).alias("digests"))
    return listed.mapInArrow(chain, "conv_id long, strip long, state string")


def strip_rows(convs: DataFrame, turns: DataFrame, deep: bool, width: int) -> DataFrame:
    """conv_id, strip, state, ids, chars, goes: a row per conversation and strip; ``goes`` where it goes on after it."""
    cell = F.struct("pos", "hi", "lo", "chars")
    cut = turns.groupBy("conv_id", "size", F.expr(f"pos div {width}").alias("strip")).agg(F.sort_array(F.collect_list(cell)).alias("cells"))
    ids = F.transform("cells", lambda c: F.struct(c["hi"].alias("hi"), c["lo"].alias("lo")))
    rows = cut.select("conv_id", "strip", ids.alias("ids"), F.transform("cells", lambda c: c["chars"]).alias("chars"), ((F.col("strip") + 1) * width < F.col("size")).alias("goes"), "size")
    none = convs.filter("size = 0").select("conv_id", F.lit(0).cast("long"), F.expr("cast(array() as array<struct<hi: bigint, lo: bigint>>)"), F.expr("cast(array() as array<bigint>)"), F.lit(False), "size")
    rows = rows.unionAll(none)
    if deep:
        rows = materialize(rows, "trie-strips")
        digest = F.sha2(F.array_join(F.transform("ids", lambda c: F.concat(c["hi"].cast("string"), F.lit(":"), c["lo"].cast("string"))), ","), 256)
        states = _chained(rows.filter(F.col("size") > width).select("conv_id", "strip", digest.alias("digest")))
        later = rows.filter("strip > 0").join(materialize(states, "trie-states"), ["conv_id", "strip"])
        rows = rows.filter("strip = 0").withColumn("state", F.lit("")).unionByName(later)
    else:
        rows = rows.withColumn("state", F.lit(""))
    return rows.select("conv_id", "strip", "state", "ids", "chars", "goes")


class Matrix:
    """The sorted rows of a shard and its neighbours: where nodes start, and which rows end in a leaf."""

    def __init__(self, table: pa.Table) -> None:
        column = lambda name: table.column(name).combine_chunks()
        ids, chars = column("ids"), column("chars")
        self.length = np.diff(ids.offsets.to_numpy()).astype(np.int64)
        self.conv, self.strip, self.goes = (column(c).to_numpy(zero_copy_only=False) for c in ("conv_id", "strip", "goes"))
        self.side = column("side").to_numpy(zero_copy_only=False)
        states = np.array(column("state").to_pylist(), dtype=str)
        rank = np.unique(states, return_inverse=True)[1]
        width = int(self.length.max(initial=0))
        filled = np.arange(width) < self.length[:, None]
        hi, lo, size = np.full(filled.shape, -1), np.zeros(filled.shape, np.int64), np.zeros(filled.shape, np.int64)
        flat = ids.flatten()
        hi[filled], lo[filled] = (x.to_numpy(zero_copy_only=False) for x in flat.flatten())
        own = filled & (self.side == 0)[:, None]
        size[own] = chars.flatten().to_numpy(zero_copy_only=False)
        columns = [x[:, k] for k in reversed(range(width)) for x in (lo, hi)]
        order = np.lexsort((self.conv, self.goes, *columns, rank, self.strip, self.side))
        for name in ("length", "conv", "strip", "goes", "side"):
            setattr(self, name, getattr(self, name)[order])
        #: Leaves below each row's strip, and code points saved there.
        self.deep_leaves, self.deep_saved = (column(c).to_numpy()[order] if c in table.column_names else None for c in ("deep_leaves", "deep_saved"))
        self.state, self.hi, self.lo, self.size = states[order], hi[order], lo[order], size[order]
        rank = rank[order]
        # column k of ``start``: the first k turns differ from those of the row above
        start = np.ones((len(order), width + 1), bool)
        start[1:, 0] = (self.strip[1:] != self.strip[:-1]) | (rank[1:] != rank[:-1])
        start[1:, 1:] = (self.hi[1:] != self.hi[:-1]) | (self.lo[1:] != self.lo[:-1])
        self.start = np.logical_or.accumulate(start, axis=1)
        alike = np.zeros(len(order), bool)
        alike[:-1] = ~self.start[np.arange(1, len(order)), self.length[:-1]]
        self.leaf = ~self.goes & ~alike
        fresh = self.start[:, 1:] & (np.arange(width) < self.length[:, None])
        self.fresh = fresh
        self.saves = np.where(fresh, 0, self.size)  # code points of turns that the row above has too
        self.own = slice(int((self.side < 0).sum()), len(order) - int((self.side > 0).sum()))

    def key(self, row: int, k: int) -> str:
        """Name of the node of a row's first k turns."""
        if not k:
            return str(self.state[row])
        cells = ",".join(f"{a}:{b}" for a, b in zip(self.hi[row, :k].tolist(), self.lo[row, :k].tolist(), strict=True))
        return hashlib.sha256((str(self.state[row]) + hashlib.sha256(cells.encode()).hexdigest()).encode()).hexdigest()[:_DIGITS]


_PARTS = "depth long, key string, shard int, conv_id long, parent_key string, parent_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends string"


def _as_table(ddl: str, columns: list[list]) -> pa.Table:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string()}
    fields = [f.split() for f in ddl.split(", ")]
    return pa.table({name: pa.array(values, kinds[kind]) for (name, kind), values in zip(fields, columns, strict=True)})


def _row_sums(table: pa.Table) -> pa.Table:
    """What each row of a shard adds to all nodes above its strip: whether it ends in a leaf, and code points saved."""
    m = Matrix(table)
    at = m.own
    return _as_table("conv_id long, strip long, leaf long, saved long", [m.conv[at], m.strip[at], m.leaf[at].astype(np.int64), m.saves[at].sum(1)])


def _shard_nodes(table: pa.Table, width: int) -> pa.Table:
    """All nodes of a shard; those that other shards or strips have a part in carry a key, and the ids that end in them as text."""
    m, shard = Matrix(table), table.column("shard")[0].as_py()
    a, b = m.own.start, m.own.stop
    conv, length, goes, leaves = m.conv[m.own], m.length[m.own], m.goes[m.own], m.leaf[m.own] + m.deep_leaves[m.own]
    saved = np.concatenate([m.saves[m.own], np.zeros((b - a, 1), np.int64)], axis=1)[:, ::-1].cumsum(1)[:, ::-1] + m.deep_saved[m.own, None]
    out: list[list] = [[] for _ in range(11)]
    above = None  # of the depth before: starts, least ids, names
    for k in range(m.start.shape[1]):
        starts = m.start[a:b, k].copy()
        starts[0] = True
        at = np.flatnonzero(starts)
        size = np.diff(np.append(at, b - a))
        least, sums = np.minimum.reduceat(conv, at), lambda x: np.add.reduceat(x.astype(np.int64), at)  # noqa: B023
        children = sums(m.fresh[a:b, k]) if k < m.fresh.shape[1] else np.zeros(len(at), np.int64)
        ending = sums((length == k) & ~goes)
        n_leaves, n_saved, going = sums(leaves), sums(saved[:, max(k - 1, 0)]), sums(goes & (length == k))
        real = length[at] >= k
        shared = np.full(len(at), k == 0) | (going > 0)
        shared[0] |= a > 0 and not m.start[a, k]
        shared[-1] |= b < len(m.start) and not m.start[b, k]
        names = [m.key(a + i, k) if s and r else None for i, s, r in zip(at.tolist(), shared.tolist(), real.tolist(), strict=True)]
        parent = np.searchsorted(above[0], at, "right") - 1 if k else None
        for i in np.flatnonzero(real).tolist():
            row, strip = at[i], int(m.strip[a + at[i]])
            ends = ",".join(map(str, conv[row : row + ending[i]].tolist()))
            name = names[i]
            if k == 0 and strip:  # stands for the last node of the strip before, which has all but the children
                values = [0, children[i], 0, 0, ""]
            else:
                values = [size[i], children[i], n_leaves[i], n_saved[i], ends if name is not None else hashlib.sha256(ends.encode()).hexdigest() if ends else _NO_ENDS]
            up_name, up_id = (above[2][parent[i]], int(above[1][parent[i]])) if k else (None, None)
            record = [strip * width + k, name, shard, None if k == 0 and strip else int(least[i]), up_name, up_id if up_name is None else None, *values]
            for column, value in zip(out, record, strict=True):
                column.append(value)
        above = (at, least, names)
    return _as_table(_PARTS, out)


def _hashed_ends(parts: DataFrame) -> DataFrame:
    """parts (key, shard, ends) of nodes -> key, ends_sha256. A node's pieces come in order and are hashed one by one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        done = lambda: pa.RecordBatch.from_arrays([pa.array([key], pa.string()), pa.array([digest.hexdigest()], pa.string())], ["key", "ends_sha256"])
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if name != key:
                    if key is not None:
                        yield done()
                    key, digest = name, hashlib.sha256(text.encode())
                else:
                    digest.update(b"," + text.encode())
        if key is not None:
            yield done()

    pieces = parts.filter("ends <> ''").repartition("key").sortWithinPartitions("key", "shard").select("key", "ends")
    return pieces.mapInArrow(run, "key string, ends_sha256 string")


def _with_neighbours(rows: DataFrame) -> DataFrame:
    """rows of shards, and in each shard the last row before (side -1) and the first after it (side 1)."""
    whole = F.struct("strip", "state", "ids", "goes", "conv_id")
    ends = rows.groupBy("shard").agg(F.min(whole).alias("first"), F.max(whole).alias("last"))  # a row a shard
    by = Window.orderBy("shard")
    sides = ends.select("shard", F.lag("last").over(by).alias("before"), F.lead("first").over(by).alias("after"))
    near = sides.select("shard", F.explode(F.array(F.struct(F.lit(-1).alias("side"), F.col("before").alias("r")), F.struct(F.lit(1).alias("side"), F.col("after").alias("r")))).alias("n"))
    near = near.filter("n.r is not null").select("shard", "n.side", "n.r.*")
    return rows.withColumn("side", F.lit(0)).unionByName(near, allowMissingColumns=True).withColumn("chars", F.coalesce("chars", F.expr("cast(array() as array<bigint>)")))


def prefix_trie(conversations: DataFrame, width: int = WIDTH, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """All nodes of the trie of rebuilt conversations, as NODES."""
    spark = conversations.sparkSession
    bounded_batches(spark)
    convs, turns = rebuilt(ordered_turns(conversations))
    strips = F.greatest(F.ceil(F.col("size") / width), F.lit(1))
    size = convs.agg(F.count("*").alias("n"), F.sum(strips).alias("rows"), F.max("size").alias("longest")).first()
    if not size["n"]:
        return spark.createDataFrame([], NODES)
    deep, shards = size["longest"] > width, -(-size["rows"] // shard_rows)
    rows = strip_rows(convs, turns, deep, width).repartitionByRange(shards, "strip", "state", "ids", "goes", "conv_id")
    rows = materialize(rows.withColumn("shard", F.spark_partition_id()), "trie-rows")
    dealt = _with_neighbours(rows)
    no = F.lit(0).cast("long")
    if deep:
        sums = materialize(dealt.filter("strip > 0").groupBy("shard").applyInArrow(_row_sums, "conv_id long, strip long, leaf long, saved long"), "trie-sums")
        later = Window.partitionBy("conv_id").orderBy(F.desc("strip"))
        below = sums.select("conv_id", (F.col("strip") - 1).alias("strip"), F.lit(0).alias("side"), F.sum("leaf").over(later).alias("deep_leaves"), F.sum("saved").over(later).alias("deep_saved"))
        dealt = dealt.join(small_side(below), ["conv_id", "strip", "side"], "left").na.fill(0, ["deep_leaves", "deep_saved"])
    else:
        dealt = dealt.withColumns({"deep_leaves": no, "deep_saved": no})
    parts = materialize(dealt.groupBy("shard").applyInArrow(lambda t: _shard_nodes(t, width), _PARTS), "trie-parts")
    shared = parts.filter("key is not null")
    joined = shared.groupBy("key").agg(F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"), F.max("parent_key").alias("parent_key"), F.max("parent_id").alias("parent_id"), *[F.sum(c).alias(c) for c in ("n_convs", "n_children", "n_leaves", "saved_tokens")])
    joined = materialize(joined.join(_hashed_ends(shared), "key", "left").na.fill(_NO_ENDS, ["ends_sha256"]), "trie-shared")
    columns = ["depth", "conv_id", "parent_key", "parent_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    nodes = parts.filter("key is null").withColumnRenamed("ends", "ends_sha256").select(columns).unionByName(joined.select(columns))
    up = joined.select(F.col("key").alias("parent_key"), F.col("conv_id").alias("__up"))
    found = nodes.join(small_side(up), "parent_key", "left")
    return found.select("conv_id", "depth", F.coalesce("__up", "parent_id").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


SQL = f"""
WITH c AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
k AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS k FROM c),
s AS (SELECT conv_id, count(*) AS n, {CRC32_SQL.format(id="conv_id")} % 6 AS h, conv_id - conv_id % 100 AS base FROM k GROUP BY conv_id),
p AS (SELECT s.conv_id, h, base, least(h, coalesce(b.n, 0)) AS shared FROM s LEFT JOIN (SELECT conv_id AS base, n FROM s) b USING (base)),
r AS (SELECT p.conv_id, k.k AS pos, role, text FROM p JOIN k ON k.conv_id = p.base AND k.k < p.h
      UNION ALL SELECT p.conv_id, k.k - h + shared, role, text FROM p JOIN k ON k.conv_id = p.conv_id AND k.k >= h),
w AS (SELECT s.conv_id, coalesce(list({{'r': role, 't': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS path FROM s LEFT JOIN r USING (conv_id) GROUP BY s.conv_id),
n AS (SELECT conv_id, d, len(path) AS size, sha256(to_json(path[1:d])::VARCHAR) AS key, CASE WHEN d > 0 THEN len(path[d].t) ELSE 0 END AS chars
      FROM (SELECT *, unnest(range(0, len(path) + 1)) AS d FROM w)),
g AS (SELECT key, d, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * min(chars) AS saved,
        sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (size = d), '')) AS ends_sha256 FROM n GROUP BY key, d),
u AS (SELECT DISTINCT a.key AS up, b.key, b.d - a.d AS steps FROM n a JOIN n b ON a.conv_id = b.conv_id AND b.d >= a.d),
f AS (SELECT up AS key, count(*) FILTER (steps = 1) AS n_children FROM u GROUP BY up),
t AS (SELECT u.up AS key, count(*) FILTER (f.n_children = 0)::BIGINT AS n_leaves, sum(g.saved)::BIGINT AS saved_tokens FROM u JOIN g ON g.key = u.key JOIN f ON f.key = u.key GROUP BY u.up)
SELECT g.conv_id, g.d::BIGINT AS depth, o.conv_id AS parent_conv_id, g.n_convs, f.n_children, n_leaves, saved_tokens, g.ends_sha256
FROM g JOIN f USING (key) JOIN t USING (key) LEFT JOIN u ON u.key = g.key AND u.steps = 1 LEFT JOIN g o ON o.key = u.up
"""

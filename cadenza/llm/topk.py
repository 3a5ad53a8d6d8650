"""Exact top-k search by inner product over a pivot-distance index.

Components are quantised to integers, floor(scale * x), so scores are exact. Each vector
is keyed by its nearest pivot and the distance to it; sorted by that key the index is cut
into blocks of one pivot, and these into annuli of ``RING`` rows. For a query q and an
annulus of pivot p whose vectors lie at distances low..high from p and have norms of at
most m, the triangle inequality bounds every product:

    q.x  <=  q.p + |q| high      and      2 q.x  <=  |q|^2 + m^2 - gap^2,

gap being how far |q - p| lies outside low..high. A first round scores each query in the
blocks of largest bound and so finds a k-th score; the second sends a query block only to
those index blocks whose bound reaches it, and there each query walks the annuli by
falling bound, until the next one lies below the k-th score found so far.

Defined cases: see ``vectors``; a query is compared with all rows but those of its own
id; a repeated id is queried once, while its rows (repeated rows of one vector too, as far
as a result can hold them) are candidates each of its own and may take several ranks; fewer candidates than
k give fewer rows; ties go to the smaller id; an empty table gives an empty result; other
columns are ignored. Scores that leave the range of a long are set to its ends; products
beyond 2^53 are computed with Python's integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cadenza.llm.vectors import QUERY_BLOCK, Best, first_copies, matrix, packed, ranked, single_queries, valid_vectors
from cadenza.session import materialize, small_side

RESULT = "query_id long, rank int, vec_id long, score long"
#: Rows of an annulus, and of an index block.
RING, BLOCK = 64, 1024
#: Entries of the index's directory, beyond one for each pivot: index blocks of a pivot share an entry where there are more.
DIRECTORY = 8192
_LEAST, _MOST = -(2**63), 2**63 - 1
_ROUNDING = 1e-12


def quantised(embeddings: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, vec: integer components, as doubles without fraction."""
    return valid_vectors(embeddings).withColumn("vec", F.transform("vec", lambda x: F.floor(x * scale).cast("double")))


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a**2).sum(1)[:, None] - 2 * a @ b.T + (b**2).sum(1)[None, :], 0.0))


def choose_pivots(sample: np.ndarray, count: int, rounds: int = 5) -> np.ndarray:
    """k-means centres; the start is farthest-first."""
    pivots = [sample[0]]
    away = ((sample - pivots[0]) ** 2).sum(1)
    while len(pivots) < min(count, len(sample)):
        pivots.append(sample[int(away.argmax())])
        away = np.minimum(away, ((sample - pivots[-1]) ** 2).sum(1))
    out = np.array(pivots)
    for _ in range(rounds):
        own = _distances(sample, out).argmin(1)
        out = np.array([sample[own == p].mean(0) if (own == p).any() else out[p] for p in range(len(out))])
    return out


@dataclass
class Shells:
    """Annuli, or entries of several: their pivot and the limits of distance and norm."""

    pivot: np.ndarray
    low: np.ndarray
    high: np.ndarray
    norm: np.ndarray

    def bounds(self, queries: np.ndarray, pivots: np.ndarray) -> np.ndarray:
        """The largest product that each query may have in each shell, (queries, shells)."""
        own = (queries**2).sum(1)
        length, away, product = np.sqrt(own)[:, None], _distances(queries, pivots)[:, self.pivot], (queries @ pivots.T)[:, self.pivot]
        ball = product + length * self.high
        gap = np.maximum(0.0, np.maximum(away - self.high, self.low - away))
        shell = (own[:, None] + self.norm**2 - gap**2) / 2
        slack = 1e-9 * (1.0 + own[:, None] + self.norm**2 + (pivots**2).sum(1)[self.pivot])  # rounding
        return np.minimum(ball, shell) + slack


class PivotIndex:
    """blocks (block, pivot, vec_id, vec, away, norm), sorted by pivot and distance; entries (entry, block)."""

    def __init__(self, embeddings: DataFrame, copies: int, scale: int = 256, pivots: int = 128, sample: int = 8192) -> None:
        rows = materialize(first_copies(quantised(embeddings, scale), "vec", copies), "topk-rows")
        self.spark = rows.sparkSession
        self.scored = self.spark.sparkContext.accumulator(0)  # (query, row) pairs of the last round, for tests and reports
        # pivots come from a bounded sample; they steer the order of the search, never its result
        drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").collect()
        self.pivots = choose_pivots(np.array([r.vec for r in drawn]), pivots) if drawn else None
        if self.pivots is None:
            return
        order = ["pivot", "away", "vec_id"]
        ordered = self._keyed(rows).repartitionByRange(*order).sortWithinPartitions(*order)
        self.blocks = materialize(packed(ordered, ["vec_id", "vec", "away", "norm"], BLOCK, "pivot"), "topk-index")
        self.entries, self.shells, self.names = self._directory()

    def _keyed(self, rows: DataFrame) -> DataFrame:
        """rows (vec_id, vec, ..) with pivot, away, norm."""
        shared, names = self.spark.sparkContext.broadcast(self.pivots), rows.columns

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    x = matrix(batch.column("vec"))
                    away = _distances(x, shared.value)
                    yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(away.argmin(1).astype(np.int32)), pa.array(away.min(1)), pa.array(np.sqrt((x**2).sum(1)))], [*names, "pivot", "away", "norm"])

        return rows.mapInArrow(key, ", ".join(f"{n} {k}" for n, k in rows.dtypes) + ", pivot int, away double, norm double")

    def _directory(self) -> tuple[DataFrame, Shells, list[str]]:
        """entry -> block, and the limits of the entries: DIRECTORY and one a pivot at most, whatever the number of rows."""

        def limits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                away, norm = ([np.frombuffer(b) for b in batch.column(c).to_pylist()] for c in (2, 3))
                found = [[f(v) for v in x] for f, x in ((np.min, away), (np.max, away), (np.max, norm))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *[pa.array(x, pa.float64()) for x in found]], ["block", "pivot", "low", "high", "norm"])

        meta = materialize(self.blocks.select("block", "pivot", "away", "norm").mapInArrow(limits, "block string, pivot int, low double, high double, norm double"), "topk-limits")
        together = max(1, -(-meta.count() // DIRECTORY))
        nth = F.row_number().over(Window.partitionBy("pivot").orderBy("low", "block")) - 1
        named = materialize(meta.withColumn("entry", F.concat_ws(":", "pivot", F.floor(nth / together).cast("string"))), "topk-entries")
        rows = named.groupBy("entry", "pivot").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.max("norm").alias("norm")).orderBy("entry").collect()
        shells = Shells(np.array([r.pivot for r in rows]), *[np.array([r[c] for r in rows]) for c in ("low", "high", "norm")])
        return named.select("entry", "block"), shells, [r.entry for r in rows]

    def search(self, queries: DataFrame, k: int, first: int = 2) -> DataFrame:
        """queries (vec_id, vec) -> query_id, rank, vec_id, score. ``first``: entries of the first round, of each query."""
        if self.pivots is None:
            return self.spark.createDataFrame([], RESULT)
        own = materialize(self._keyed(single_queries(queries)).withColumn("bound", F.lit(float("-inf"))), "topk-queries")
        begun = self._round(own, k, first)
        kth = ranked(begun, k, "score", ascending=False).groupBy("query_id").agg(F.min("score").cast("double").alias("__kth"), F.count("*").alias("__n"))
        known = own.join(kth.filter(F.col("__n") == k), own["vec_id"] == F.col("query_id"), "left")
        # a little lower, for beyond 2^53 a double is rounded; a score at the least long may stand for a lower one
        bound = F.when(F.col("__kth") > float(_LEAST), F.col("__kth") - F.abs("__kth") * _ROUNDING).otherwise(F.col("bound"))
        bounded = known.select("vec_id", "vec", "pivot", "away", "norm", bound.alias("bound"))
        return ranked(self._round(materialize(bounded, "topk-bounded"), k, None), k, "score", ascending=False)

    def _round(self, queries: DataFrame, k: int, first: int | None) -> DataFrame:
        """queries (vec_id, vec, pivot, away, bound) -> query_id, vec_id, score of at least the k best at or above the bound, in the entries searched."""
        order = ["pivot", "away", "vec_id"]
        blocks = packed(queries.repartitionByRange(*order).sortWithinPartitions(*order), ["vec_id", "vec", "bound"], QUERY_BLOCK)
        blocks = materialize(blocks.toDF("query_block", "queries", "ids", "vecs", "bounds"), "topk-blocks")
        shared = self.spark.sparkContext.broadcast((self.pivots, self.shells, self.names))

        def reach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pivots, shells, names = shared.value
            for batch in batches:
                for block, n, vecs, least in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    top = shells.bounds(np.frombuffer(vecs).reshape(n, -1), pivots)
                    if first is None:
                        at = np.flatnonzero((top >= np.frombuffer(least)[:, None]).any(0))
                    else:
                        at = np.unique(np.argsort(-top, axis=1, kind="stable")[:, :first])
                    yield pa.RecordBatch.from_arrays([pa.array([block] * len(at), pa.string()), pa.array([names[i] for i in at], pa.string())], ["query_block", "entry"])

        pairs = blocks.select("query_block", "queries", "vecs", "bounds").mapInArrow(reach, "query_block string, entry string")
        pairs = pairs.join(small_side(self.entries), "entry").join(blocks, "query_block")
        joined = pairs.join(self.blocks, "block").select("ids", "vecs", "bounds", "pivot", "vec_id", "vec", "away", "norm")
        centres, scored = self.spark.sparkContext.broadcast(self.pivots), self.scored if first is None else None

        def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, vecs, least, pivot, own, x, away, norm in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                    ids, own = np.frombuffer(ids, np.int64), np.frombuffer(own, np.int64)
                    walk = Walk(ids, np.frombuffer(vecs).reshape(len(ids), -1), centres.value, np.frombuffer(least), k)
                    walk.block(own, np.frombuffer(x).reshape(len(own), -1), pivot, np.frombuffer(away), np.frombuffer(norm))
                    if scored is not None:
                        scored.add(walk.scored)
                    best = walk.best
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(ids[best.query]), pa.array(best.id), pa.array([max(_LEAST, min(_MOST, -int(c))) for c in best.cost], pa.int64())], ["query_id", "vec_id", "score"]
                    )

        return joined.mapInArrow(scan, "query_id long, vec_id long, score long")


class Walk:
    """A query block in an index block; costs are negated scores."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, least: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.pivots, self.k = ids, vectors, pivots, k
        self.best = Best(len(ids), k, -least)
        self.scored = 0

    def block(self, own: np.ndarray, x: np.ndarray, pivot: int, away: np.ndarray, norm: np.ndarray) -> None:
        at = np.arange(0, len(own), RING)
        shells = Shells(np.full(len(at), pivot), np.minimum.reduceat(away, at), np.maximum.reduceat(away, at), np.maximum.reduceat(norm, at))
        top = shells.bounds(self.vectors, self.pivots)
        order = np.argsort(-top, axis=1, kind="stable")  # each query's annuli by falling bound
        going = np.arange(len(self.ids))
        for step in range(len(at)):
            ring = order[going, step]
            open_ = top[going, ring] >= -self.best.bound[going]
            going, ring = going[open_], ring[open_]  # the others stop: all their further annuli are bounded lower
            for r in np.unique(ring):
                self._ring(going[ring == r], own, x, at[r], min(at[r] + RING, len(own)))
            if not len(going):
                break

    def _ring(self, queries: np.ndarray, own: np.ndarray, x: np.ndarray, a: int, b: int) -> None:
        own, x, q = own[a:b], x[a:b], self.vectors[queries]
        self.scored += len(q) * len(x)
        if np.abs(x).max() * np.abs(q).max() * x.shape[1] < 2.0**53:
            cost = -(q @ x.T)  # sums of integers below 2^53: exact
        else:
            cost = -np.array([[sum(int(u) * int(v) for u, v in zip(s, t, strict=True)) for t in x] for s in q], dtype=object)
        self_pair = self.ids[queries][:, None] == own[None, :]
        limit = self.best.bound[queries]
        if cost.dtype != object and cost.shape[1] > self.k:
            cost = np.where(self_pair, np.inf, cost)
            limit = np.minimum(limit, np.partition(cost, self.k - 1, axis=1)[:, self.k - 1])
        elif cost.dtype == object:
            limit = limit + np.abs(limit) * _ROUNDING
        row, col = np.nonzero((cost <= limit[:, None]) & ~self_pair)
        if len(row):
            self.best.add(queries[row], own[col], cost[row, col])


def top_k(embeddings: DataFrame, every: int = 50, k: int = 5, scale: int = 256) -> DataFrame:
    """The k highest inner products of each row whose id is divisible by ``every``, among all other rows."""
    index = PivotIndex(embeddings, copies=k, scale=scale)
    return index.search(quantised(embeddings, scale).filter(F.col("vec_id") % every == 0), k)

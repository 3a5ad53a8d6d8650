"""What both vector searches share: valid rows, copies, packing into blocks, best-k merging.

Valid rows have a non-null id and a vector without null or non-finite components, of
the most frequent length (of equally frequent ones, the longest); others take no part.
Rows and queries are packed into blocks (one row of a table each), so that a search is a
join of blocks whose tasks work on matrices; neither side is ever sent to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Queries of a block.
QUERY_BLOCK = 256


def valid_vectors(embeddings: DataFrame) -> DataFrame:
    """vec_id long, vec array<double>."""
    vec = F.transform(F.col("embedding"), lambda x: x.cast("double"))
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), vec.alias("vec")).filter(F.col("vec_id").isNotNull() & (F.size("vec") > 0) & finite)
    sizes = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    return rows.filter(F.size("vec") == (sizes["dim"] if sizes else 0))


def first_copies(rows: DataFrame, key: str, k: int) -> DataFrame:
    """Of rows with equal vectors: k of each id at most, and of these the 2 k with the smallest ids.

    A search for the k best needs no more of them: ties go to the smaller id, and a query
    leaves out the rows of its own id alone, k of them at most. The limits on the ranks also
    hold before the shuffles, so a hot vector and a hot id are cut early.
    """
    own = Window.partitionBy(key, "vec_id").orderBy("vec_id")
    order = Window.partitionBy(key).orderBy("vec_id")
    few = rows.withColumn("__nth", F.row_number().over(own)).filter(F.col("__nth") <= k).drop("__nth")
    return few.withColumn("__nth", F.row_number().over(order)).filter(F.col("__nth") <= 2 * k).drop("__nth")


def single_queries(queries: DataFrame) -> DataFrame:
    """A repeated query id counts once, with its smallest vector."""
    return queries.groupBy("vec_id").agg(F.min("vec").alias("vec"))


def matrix(column: pa.Array) -> np.ndarray:
    """Equally long lists as a matrix of doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _bytes(column: pa.Array) -> bytes:
    if pa.types.is_list(column.type):
        return matrix(column).tobytes()
    if pa.types.is_binary(column.type):
        return b"".join(column.to_pylist())
    return column.to_numpy(zero_copy_only=False).tobytes()


def packed(rows: DataFrame, columns: list[str], per: int, by: str | None = None) -> DataFrame:
    """rows -> block, n, [by,] and the columns' values as bytes; a row per ``per`` rows of a task, in their order.

    A block never holds two values of ``by`` (an int column by which the rows are sorted).
    """
    names = ["block", "n", *([by] if by else []), *columns]
    kinds = [pa.string(), pa.int32(), *([pa.int32()] if by else []), *[pa.binary()] * len(columns)]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, made, held, count, key = TaskContext.get().partitionId(), 0, [], 0, None

        def block() -> pa.RecordBatch:
            nonlocal made, held, count
            whole = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            row = [f"{part:06d}-{made:06d}", count, *([key] if by else []), *[_bytes(whole.column(c)) for c in columns]]
            made, held, count = made + 1, [], 0
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds, strict=True)], schema=schema)

        for batch in batches:
            keys = batch.column(by).to_numpy() if by else np.zeros(batch.num_rows, np.int32)
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if b > a and held and key != int(keys[a]):
                    yield block()
                while a < b:
                    key, take = int(keys[a]), min(b - a, per - count)
                    held.append(batch.slice(a, take))
                    a, count = a + take, count + take
                    if count == per:
                        yield block()
        if held:
            yield block()

    ddl = ", ".join(f"{n} {'string' if n == 'block' else 'int' if n in ('n', by) else 'binary'}" for n in names)
    return rows.select(*([by] if by else []), *columns).mapInArrow(pack, ddl)


class Best:
    """The k best (least cost, then least id) of each query so far."""

    def __init__(self, queries: int, k: int, bound: np.ndarray | None = None) -> None:
        self.k = k
        self.query, self.id, self.cost = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        self.bound = np.full(queries, np.inf) if bound is None else bound.copy()  # no cost above it is needed

    def add(self, query: np.ndarray, ids: np.ndarray, cost: np.ndarray) -> None:
        query, ids, cost = np.concatenate([self.query, query]), np.concatenate([self.id, ids]), np.concatenate([self.cost, cost])
        order = np.lexsort((ids, cost, query))
        query, ids, cost = query[order], ids[order], cost[order]
        first = np.searchsorted(query, query, "left")
        rank = np.arange(len(query)) - first
        last = rank == self.k - 1
        self.bound[query[last]] = np.minimum(self.bound[query[last]], cost[last].astype(float))
        keep = rank < self.k
        self.query, self.id, self.cost = query[keep], ids[keep], cost[keep]


def ranked(found: DataFrame, k: int, score: str, ascending: bool) -> DataFrame:
    """The k best of each query over all tasks."""
    order = Window.partitionBy("query_id").orderBy(F.asc(score) if ascending else F.desc(score), "vec_id")
    return found.withColumn("rank", F.row_number().over(order).cast("int")).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", score)

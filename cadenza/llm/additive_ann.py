"""Approximate nearest neighbours by additive quantisation.

A vector is coded as a sum of full-dimensional codewords, one of each codebook; each
codebook is trained on what the ones before it leave (residuals), and encoding keeps
the ``beam`` best partial sums. The index stores the codes and the squared norm of the
sum, so that a lookup table of query-codeword products scores a vector with one
addition per codebook. The index also keeps each row's coding error (its distance to the
sum) and its vector. By the triangle inequality a row is no nearer than the distance to
its sum less that error, so the scan compares only those rows exactly, in double precision
and on the original vectors, whose bound is within the k-th distance found so far; the
``shortlist`` best rows by their codes come first, which makes that distance small from
the start. So the result is exact for all data; what the codes tell decides on the time.

The codebooks are fitted on a bounded sample (``sample`` rows, those with the smallest
id hashes), around its mean; every row is indexed and scored. The result doesn't hang on
how the rows lie in partitions or batches.

Defined cases: see ``vectors``; zero vectors take no part either; a query is compared
with all rows but those of its own id; a repeated id is queried once, while its rows
(repeated rows of one vector too, as far as a result can hold them) are candidates each of
its own and may take several ranks; fewer candidates than k give fewer rows; ties go to the smaller id; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from cadenza.llm.vectors import Best, first_copies, matrix, packed, ranked, single_queries, valid_vectors
from cadenza.session import bounded_batches, materialize

RESULT = "query_id long, rank int, vec_id long, score double"
#: Rows of a block of the index, and rows of a lane: a query keeps its best of each lane.
BLOCK, LANE = 2048, 1 << 18
#: Queries of a block, and pairs that are compared exactly at once.
QUERIES, PAIRS = 64, 1 << 15


@dataclass
class Codebooks:
    words: np.ndarray  # (books, words, dims)

    def encode(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Codes (rows, books) and squared norms of the decoded sums."""
        return self.coded(x, beam)[:2]

    def coded(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Codes (rows, books), squared norms of the decoded sums, and the rows' distances to these.

        The search for codes runs in single precision, at the books' scale; the rest are doubles.
        """
        n, (books, size, _) = len(x), self.words.shape
        scale = float(np.abs(self.words).max()) or 1.0
        all_words = (self.words / scale).astype(np.float32)
        codes = np.zeros((n, 1, books), np.uint8)
        left = np.clip(x / scale, -1e15, 1e15).astype(np.float32)[:, None, :]
        rows = np.arange(n)[:, None]
        for m in range(books):
            words = all_words[m]
            cost = np.einsum("nbd,nbd->nb", left, left)[:, :, None] + ((words**2).sum(-1) - 2 * left @ words.T)
            cost = cost.reshape(n, -1)
            width = min(beam, cost.shape[1])
            best = np.argpartition(cost, width - 1, axis=1)[:, :width] if width < cost.shape[1] else np.tile(np.arange(width), (n, 1))
            parent, word = best // size, best % size
            codes = codes[rows, parent]
            codes[:, :, m] = word
            left = left[rows, parent] - words[word]
        picked = codes[np.arange(n), np.einsum("nbd,nbd->nb", left, left).argmin(1)]
        sums = np.zeros_like(x)
        for m in range(books):
            sums += self.words[m][picked[:, m]]
        return picked, (sums**2).sum(1), np.sqrt(((x - sums) ** 2).sum(1)) * (1 + 1e-9)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Products of queries and codewords: (books, queries, words)."""
        return queries @ self.words.transpose(0, 2, 1)


def fit(sample: np.ndarray, books: int = 32, size: int = 64, rounds: int = 5, seed: int = 7) -> Codebooks:
    """Residual k-means, book by book."""
    draw, left, out = np.random.default_rng(seed), sample.copy(), []
    for _ in range(books):
        words = left[draw.choice(len(left), size, replace=len(left) < size)].copy()
        for _ in range(rounds):
            own = (-2 * left @ words.T + (words**2).sum(1)).argmin(1)
            count = np.bincount(own, minlength=size)
            order = np.argsort(own, kind="stable")
            filled = np.flatnonzero(count)
            words[filled] = np.add.reduceat(left[order], (np.cumsum(count) - count)[filled]) / count[filled, None]
        out.append(words)
        left = left - words[(-2 * left @ words.T + (words**2).sum(1)).argmin(1)]
    return Codebooks(np.stack(out))


@dataclass
class Index:
    blocks: DataFrame  # block, n, vec_id, codes, norm, error, vec: blocks of rows
    books: Codebooks
    centre: np.ndarray
    kind: str  # of the vectors' components: f4, where the table holds such


def _kind(embeddings: DataFrame) -> str:
    return "f4" if isinstance(embeddings.schema["embedding"].dataType.elementType, FloatType) else "f8"


def build_index(embeddings: DataFrame, copies: int, books: int = 32, size: int = 64, beam: int = 4, sample: int = 8192) -> Index | None:
    rows = valid_vectors(embeddings).filter(F.exists("vec", lambda x: x != 0))
    rows = materialize(first_copies(rows, "vec", copies), "ann-rows")
    drawn = rows.orderBy(F.xxhash64("vec_id"), "vec_id", "vec").limit(sample).select("vec").collect()  # the bounded sample
    if not drawn:
        return None
    drawn, kind = np.array([r.vec for r in drawn]), _kind(embeddings)
    centre = drawn.mean(0)
    model = fit(drawn - centre, books, size)
    shared = rows.sparkSession.sparkContext.broadcast((model, centre))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, centre = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                x = matrix(part.column(1))
                codes, norm, error = model.coded(x - centre, beam)
                cells = [pa.array([c.tobytes() for c in v], pa.binary()) for v in (codes, x.astype(kind))]
                yield pa.RecordBatch.from_arrays([part.column(0), cells[0], pa.array(norm), pa.array(error), cells[1]], ["vec_id", "codes", "norm", "error", "vec"])

    coded = rows.select("vec_id", "vec").mapInArrow(encode, "vec_id long, codes binary, norm double, error double, vec binary")
    return Index(materialize(packed(coded, ["vec_id", "codes", "norm", "error", "vec"], BLOCK), "ann-index"), model, centre, kind)


class Scan:
    """The k nearest rows of each query of a block, over blocks of the index."""

    def __init__(self, books: Codebooks, centre: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int, shortlist: int) -> None:
        self.ids, self.queries, self.shortlist, self.best = ids, queries, shortlist, Best(len(ids), k)
        moved = queries - centre
        self.tables, self.norm = 2 * books.tables(moved), (moved**2).sum(1)
        # what rounding may add to a score
        self.slack = 1e-12 * (np.sqrt(self.norm) + np.sqrt((books.words**2).sum(2)).max(1).sum()) ** 2
        self.compared = 0

    def _compare(self, row: np.ndarray, col: np.ndarray, rows: np.ndarray, vectors: np.ndarray) -> None:
        for at in range(0, len(row), PAIRS):
            q, x = row[at : at + PAIRS], col[at : at + PAIRS]
            away = np.sqrt(((vectors[x] - self.queries[q]) ** 2).sum(1))
            self.compared += len(q)
            near = ~(away > self.best.bound[q])
            self.best.add(q[near], rows[x[near]], away[near])

    def see(self, rows: np.ndarray, codes: np.ndarray, norm: np.ndarray, error: np.ndarray, vectors: np.ndarray) -> None:
        codes, norm = codes.astype(np.intp), norm - error**2
        for at in range(0, len(self.ids), 32):
            part = slice(at, min(at + 32, len(self.ids)))
            # the squared distance to the sum, less the squares of the query and of the error
            score = np.repeat(norm[None, :], part.stop - at, 0)
            for m, code in enumerate(codes):
                score -= self.tables[m, part].take(code, axis=1)
            other = self.ids[part, None] != rows[None, :]
            if len(rows) > self.shortlist and not np.isfinite(self.best.bound[part]).all():
                first = np.zeros(score.shape, bool)
                np.put_along_axis(first, np.argpartition(score + error**2, self.shortlist - 1, axis=1)[:, : self.shortlist], True, axis=1)
                first &= other
                row, col = np.nonzero(first)
                self._compare(row + at, col, rows, vectors)
                other &= ~first
            bound = self.best.bound[part]
            # nearer than the bound only if the distance to the sum is at most bound + error; comparisons keep what isn't a number
            limit = bound**2 - self.norm[part] + self.slack[part]
            score -= 2 * bound[:, None] * error[None, :]
            row, col = np.nonzero(other & ~(score > limit[:, None]))
            self._compare(row + at, col, rows, vectors)


def _scanned(index: Index, queries: DataFrame, k: int, shortlist: int) -> DataFrame:
    """queries (vec_id, vec) -> query_id, vec_id, score: the k nearest rows of each lane.

    Blocks of the index lie in lanes, query blocks in rows of a grid; a cell of the grid is a
    join key. There are about two cells a shuffle partition, and so many rows of them that
    index blocks (sent to each row) and query blocks (sent to each lane) have equal weight.
    """
    spark = index.blocks.sparkSession
    blocks = materialize(packed(queries, ["vec_id", "vec"], QUERIES).toDF("query_block", "queries", "ids", "vecs"), "ann-queries")
    size = int(index.blocks.agg(F.sum("n")).first()[0])
    asked = blocks.agg(F.count("*"), F.coalesce(F.sum("queries"), F.lit(0))).first()
    cells = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = max(1, min(asked[0], cells, round((cells * 1.5 * asked[1] / size) ** 0.5)))
    lanes = max(-(-size // LANE), min(-(-cells // rows), -(-size // BLOCK)))
    rows = min(rows, max(1, cells // lanes))
    part = lambda name, of: F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
    every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
    spread = blocks.withColumns({"row": part("query_block", rows), "lane": every(lanes)})
    # a merge join gives each query block all blocks of its lane in a row
    joined = spread.hint("merge").join(index.blocks.withColumns({"row": every(rows), "lane": part("block", lanes)}), ["row", "lane"])
    shared, kind = spark.sparkContext.broadcast((index.books, index.centre)), index.kind

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, own = None, None

        def out() -> pa.RecordBatch:
            best = own.best
            return pa.RecordBatch.from_arrays([pa.array(own.ids[best.query]), pa.array(best.id), pa.array(best.cost)], ["query_id", "vec_id", "score"])

        with np.errstate(all="ignore"):
            for batch in batches:
                for at in range(batch.num_rows):
                    block, lane, ids, vecs, rows, codes, norm, error, vectors = (c[0].as_py() for c in batch.slice(at, 1).columns)
                    if (block, lane) != name:
                        if own is not None:
                            yield out()
                        name, ids = (block, lane), np.frombuffer(ids, np.int64)
                        own = Scan(*shared.value, ids, np.frombuffer(vecs).reshape(len(ids), -1), k, shortlist)
                    rows = np.frombuffer(rows, np.int64)
                    own.see(rows, np.frombuffer(codes, np.uint8).reshape(len(rows), -1).T, np.frombuffer(norm), np.frombuffer(error), np.frombuffer(vectors, kind).reshape(len(rows), -1).astype(float))
        if own is not None:
            yield out()

    found = joined.select("query_block", "lane", "ids", "vecs", "vec_id", "codes", "norm", "error", "vec")
    return found.mapInArrow(scan, "query_id long, vec_id long, score double")


def search(index: Index, queries: DataFrame, k: int = 10, shortlist: int = 200) -> DataFrame:
    """queries (vec_id, vec) -> query_id, rank, vec_id, score (Euclidean distance)."""
    bounded_batches(index.blocks.sparkSession, workers=False)
    single = materialize(single_queries(queries), "ann-single")
    return ranked(_scanned(index, single, k, max(shortlist, k)), k, "score", ascending=True)


def nearest(embeddings: DataFrame, every: int = 100, k: int = 10, shortlist: int = 200) -> DataFrame:
    """The k nearest of each row whose id is divisible by ``every``, among all other rows."""
    index = build_index(embeddings, copies=k)
    if index is None:
        return embeddings.sparkSession.createDataFrame([], RESULT)
    queries = valid_vectors(embeddings).filter(F.exists("vec", lambda x: x != 0) & (F.col("vec_id") % every == 0))
    return search(index, queries, k, shortlist)

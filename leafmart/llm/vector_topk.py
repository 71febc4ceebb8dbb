"""Exact top-k inner products by vector-approximation cells (operator 10)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from leafmart.llm.common import bounded_batches, staged

CELLS = 64
QUERY_BLOCK_BYTES = 32 << 20
#: Rows of queries and of vectors for which one matrix of bounds is held.
QUERY_ROWS, VECTOR_ROWS = 256, 4096
#: Exact vectors read between two looks at the k-th score.
STEP = 16


def scaled(vectors: DataFrame, id_col: str, vec_col: str, factor: float = 256.0) -> DataFrame:
    """(id, vec): each component as floor(factor * x). Rows without id or vector, or with a null or non-finite component, are left out."""
    bad = F.exists(F.col(vec_col), lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return vectors.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & ~bad).select(
        F.col(id_col).alias("id"), F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(factor))).alias("vec")
    )


def matrix(column: pa.Array) -> np.ndarray:
    """Lists of one length as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Search:
    """Running top k of one query block over the vectors of a task."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int, low: float, width: float):
        self.ids, self.queries, self.k, self.low, self.width = ids, queries.astype(np.float64), k, low, width
        self.above, self.below = np.maximum(self.queries, 0), np.minimum(self.queries, 0)
        self.scores = np.full((len(ids), k), -np.iinfo(np.int64).max)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)
        self.exact_reads = 0

    def scan(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        """Bounds from the cells first; exact vectors in the order of their bounds until the k-th score is certain."""
        cells = np.minimum((vectors - self.low) // self.width, CELLS - 1).astype(np.uint8)
        floor = self.low + cells * self.width
        roof = np.minimum(floor + self.width, self.low + CELLS * self.width)
        for a in range(0, len(self.ids), QUERY_ROWS):
            part = slice(a, a + QUERY_ROWS)
            most = self.above[part] @ roof.T + self.below[part] @ floor.T
            most += np.abs(most) * 1e-9 + 1e-6  # floating sums stay bounds
            most[self.ids[part, None] == ids[None, :]] = -np.inf
            order = None
            live = np.flatnonzero(most.max(axis=1) >= self.scores[part, -1])
            if len(live) == 0:
                continue
            order = np.argsort(-most[live], axis=1, kind="stable")
            for q, turn in zip(live, order, strict=True):
                self._visit(a + q, most[q], turn, ids, vectors)

    def _visit(self, q: int, most: np.ndarray, turn: np.ndarray, ids: np.ndarray, vectors: np.ndarray) -> None:
        at = 0
        while at < len(turn):
            take = turn[at : at + STEP]
            take = take[(most[take] >= self.scores[q, -1]) & (most[take] > -np.inf)]
            if len(take) == 0:
                return
            exact = vectors[take] @ self.queries[q].astype(np.int64)
            self.exact_reads += len(take)
            scores, found = np.concatenate((self.scores[q], exact)), np.concatenate((self.found[q], ids[take]))
            best = np.lexsort((found, -scores))[: self.k]
            self.scores[q], self.found[q] = scores[best], found[best]
            at += STEP

    def rows(self) -> pa.RecordBatch:
        q, j = np.nonzero(self.found != np.iinfo(np.int64).max)
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(self.found[q, j]), pa.array(self.scores[q, j])], ["query_id", "id", "score"])


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, id, score: the k largest inner products of each query, ties to the smaller id.

    Both inputs hold (id long, vec array<long>), as `scaled` makes them. All vectors but those with the query's own id are
    candidates; fewer than k give fewer rows. Repeated query ids count once (their smallest vector); repeated vectors with one
    id are one result each. Only vectors of the query's length meet it. Empty tables give no rows. Components are below 2**25
    in size, so that sums of products fit a long.

    Each vector falls into a grid of CELLS cells a dimension. A task scans the cells of its vectors for upper bounds, then
    reads exact vectors in the order of the bounds until none can beat the k-th score so far. Queries come in blocks of at
    most QUERY_BLOCK_BYTES; a task returns at most k rows a query, merged by a ranked window.
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    queries = staged(queries.where(F.size("vec") > 0).groupBy("id").agg(F.min("vec").alias("vec")).withColumn("n", F.size("vec")))
    shapes = [tuple(r) for r in queries.groupBy("n").agg(F.count("*").alias("rows")).orderBy("n").collect()]  # a row a vector length
    empty = spark.createDataFrame([], "query_id long, rank int, id long, score long")
    results = []
    for n, rows in shapes:
        own = vectors.where(F.size("vec") == n)
        low, high = own.agg(F.min(F.array_min("vec")), F.max(F.array_max("vec"))).first()
        if low is None:
            continue
        width = max(1.0, (high - low + 1) / CELLS)
        blocks = -(-rows * n * 8 // QUERY_BLOCK_BYTES)
        for b in range(blocks):
            block = queries.where((F.col("n") == n) & (F.pmod(F.xxhash64("id"), F.lit(blocks)) == b)).select("id", "vec").toArrow()
            ids, table = block["id"].to_numpy(), matrix(block["vec"])
            if len(ids) == 0:
                continue
            shared = spark.sparkContext.broadcast((ids, table))

            def scan(batches: Iterator[pa.RecordBatch], shared=shared, low=low, width=width) -> Iterator[pa.RecordBatch]:
                search = Search(*shared.value, k, float(low), width)
                for batch in batches:
                    for at in range(0, batch.num_rows, VECTOR_ROWS):
                        piece = batch.slice(at, VECTOR_ROWS)
                        search.scan(piece.column(0).to_numpy(zero_copy_only=False), matrix(piece.column(1)))
                yield search.rows()

            results.append(own.select("id", "vec").mapInArrow(scan, "query_id long, id long, score long"))
    if not results:
        return empty
    found = results[0]
    for other in results[1:]:
        found = found.unionByName(other)
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "id", "score")

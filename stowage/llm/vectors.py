"""Searches of a table of vectors by a stated set of queries: passes, blocks and best lists.

The queries go out in passes of at most ``PASS_BYTES``; in a pass each task reads its
rows in blocks and keeps the best ``k`` of each query, so what leaves a task is bounded
by queries and ``k``, and a window picks the best of all tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import ClassVar, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.llm.workers import tidy
from stowage.session import materialize, small_batches

#: Bytes of queries that are broadcast at once, rows in a block, queries in a block.
PASS_BYTES, ROWS, QUERIES = 32 * 2**20, 4096, 512


def usable(vectors: DataFrame, largest: float, zeros: bool = True) -> DataFrame:
    """``vec_id, embedding`` of the rows that take part: no nulls, no components beyond ``largest``."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(largest)))
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    rows = rows.filter(F.col("vec_id").isNotNull() & (F.size("embedding") > 0) & fine)
    return rows if zeros else rows.filter(F.exists("embedding", lambda x: x != 0.0))


class Best:
    """The best ``k`` of each query so far: the highest scores, ties to the smaller id. Scores are doubles or 64-bit integers.

    A row of the arrays is a query's list in order, and only the lists that get something new are sorted again.
    """

    def __init__(self, queries: int, k: int, kind: type = np.float64) -> None:
        self.k = k
        self.count = np.zeros(queries, np.int64)
        self.ident, self.score = np.zeros((queries, k), np.int64), np.zeros((queries, k), kind)

    def held(self, queries: np.ndarray) -> np.ndarray:
        """Which places of the lists of these queries are taken."""
        return np.arange(self.k) < self.count[queries, None]

    def add(self, query: np.ndarray, ident: np.ndarray, score: np.ndarray) -> None:
        touched = np.unique(query)
        old = self.held(touched)
        query = np.r_[np.repeat(touched, self.count[touched]), query]
        ident, score = np.r_[self.ident[touched][old], ident], np.r_[self.score[touched][old], score]
        order = np.lexsort((ident, -score, query))
        query, ident, score = query[order], ident[order], score[order]
        starts = np.searchsorted(query, touched)
        sizes = np.diff(np.r_[starts, len(query)])
        place = np.arange(len(query)) - np.repeat(starts, sizes)
        keep = place < self.k
        self.ident[query[keep], place[keep]], self.score[query[keep], place[keep]] = ident[keep], score[keep]
        self.count[touched] = np.minimum(sizes, self.k)

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Queries, ids and scores of all that is held."""
        every = self.held(np.arange(len(self.count)))
        return np.repeat(np.arange(len(self.count)), self.count), self.ident[every], self.score[every]

    def least(self, queries: slice | np.ndarray = slice(None)) -> np.ndarray:
        """The k-th best score of each query or, where doubles don't hold it, less; or minus infinity."""
        score = self.score[queries, -1]
        rounded = score.astype(np.float64)
        if score.dtype == np.int64:
            rounded = np.where(np.abs(rounded) < 2.0**53, rounded, np.nextafter(rounded, -np.inf))
        return np.where(self.count[queries] >= self.k, rounded, -np.inf)


class Search(Protocol):
    """The search of a block for rows of as many components as the queries have."""

    #: Names and Spark types of what ``code`` gives for a row besides the row itself.
    coded: ClassVar[dict[str, str]] = {}

    def code(self, rows: np.ndarray) -> list[np.ndarray]:
        """What the search needs of rows and can be stored: arrays by row, or of lists by row."""
        return []

    def run(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: list[np.ndarray], best: Best) -> None:
        """Add to the best lists, by a query's place."""


def _by_size(column: pa.ListArray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each number of components: the rows that have it, and their components."""
    sizes, flat = column.value_lengths().to_numpy(), column.flatten().to_numpy()
    ends = np.cumsum(sizes)
    for d in np.unique(sizes).tolist():
        mine = np.flatnonzero(sizes == d)
        yield d, mine, flat[(ends[mine] - d)[:, None] + np.arange(d)]


def search(vectors: DataFrame, wanted: Column, prepare: Callable[[int], Search], k: int, kind: type = np.float64) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each query the ``k`` rows of highest score.

    ``prepare(dimensions)`` gives the search of a block. Rows count for queries with as
    many components. Every different vector of a wanted vec_id is searched for, and the
    ``k`` are the best of all its searches, as in SQL that ranks by the query's id; rows
    with the query's vec_id are no candidates. Where there are several passes, codes are
    written once and read by each.
    """
    spark = vectors.sparkSession
    small_batches(spark)
    asked = materialize(vectors.filter(wanted).select("vec_id", "embedding").distinct(), "queries")
    size = asked.agg(F.sum(F.size("embedding") * 8)).first()[0] or 0
    passes = -(-size // PASS_BYTES) or 1
    rows = vectors.select("vec_id", "embedding")
    names = list(prepare(1).coded)

    @tidy
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, Search] = {}
        for batch in batches:
            for d, mine, part in _by_size(batch.column(1)):
                codes = known.setdefault(d, prepare(d)).code(part)
                columns = [pa.array(list(c)) if c.ndim > 1 else pa.array(c) for c in codes]
                yield pa.RecordBatch.from_arrays([*batch.take(pa.array(mine)).columns, *columns], names=["vec_id", "embedding", *names])

    if passes > 1 and names:
        kinds = ", ".join(f"{n} {t}" for n, t in prepare(1).coded.items())
        rows = materialize(rows.mapInArrow(code, f"vec_id long, embedding array<double>, {kinds}"), "codes")
    stored = len(rows.columns) > 2
    found = []
    for part in range(passes):
        some = asked.filter(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(passes)) == part).orderBy("vec_id", "embedding").toArrow()
        by: dict[int, tuple[list[int], list[list[float]]]] = {}
        for ident, vector in zip(some.column(0).to_pylist(), some.column(1).to_pylist(), strict=True):
            ids, many = by.setdefault(len(vector), ([], []))
            ids.append(ident)
            many.append(vector)
        shared = spark.sparkContext.broadcast({d: (np.array(ids), np.array(many)) for d, (ids, many) in by.items()})

        @tidy
        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            queries = shared.value
            best = {d: Best(len(ids), k, kind) for d, (ids, _) in queries.items()}
            searches = {d: prepare(d) for d in queries}
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS):
                    block = whole.slice(at, ROWS)
                    ids = block.column(0).to_numpy()
                    for d, mine, part in _by_size(block.column(1)):
                        if d not in queries:
                            continue
                        if stored:
                            there = block.take(pa.array(mine)).columns[2:]
                            codes = [c.flatten().to_numpy().reshape(len(mine), -1) if pa.types.is_list(c.type) else c.to_numpy() for c in there]
                        else:
                            codes = searches[d].code(part)
                        searches[d].run(*queries[d], ids[mine], part, codes, best[d])
            for d, b in best.items():
                query, ident, score = b.rows()
                yield pa.record_batch({"query_id": queries[d][0][query], "vec_id": ident, "score": score})

        score = "long" if kind is np.int64 else "double"
        near = rows.mapInArrow(run, f"query_id long, vec_id long, score {score}")
        found.append(materialize(near, "best") if passes > 1 else near)
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return every.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

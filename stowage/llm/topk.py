"""Exact top-k search without random access.

Scores are inner products of integer vectors. Every component of a block is a list
sorted by value; a query reads it from the top where its own component is positive and
from the bottom where it is negative, so it meets the largest contributions first.

At some depth a row's score has an upper bound, with the value at the depth for what is
not read yet, and a lower bound, with the list's last value. As the lists are sorted,
the upper bounds' terms are the larger of a value and the value at the depth (the
smaller, when reading from the bottom). Reading goes on, in steps, until the rows that
can still be among the best are few: outsiders, read or unread, have upper bounds below
the k-th lower bound, which counts what earlier blocks of the task gave. The last step
resolves the candidates' scores. At full depth the bounds are the scores, so it ends.

Integers are exact. Where a block's sums stay below 2**53, doubles hold them. Elsewhere
the bounds are widened by what doubles may round off, and the candidates' scores are
resolved in Python's integers. Scores are 64-bit integers, as in the SQL; where one of
2**63 - 1 or more in size is among the best, the query fails and says so.

Cases: null vectors and ids, empty vectors, and vectors with null or non-finite
components take no part; a query with fewer candidates gets them all; ties go to the
smaller vec_id; repeated rows are candidates each; an empty input gives an empty result.
Several vectors of one vec_id are all searched for, equal ones once, and are ranked
together; none of them is a candidate of that id.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm.vectors import QUERIES, Best, Search, search, usable

K = 5
EVERY = 50
#: Doubles hold integers below it; scores of this size or more don't fit the result.
EXACT, BEYOND = 2.0**53, 2**63 - 1
#: Shares of the lists that are read before the bounds are looked at: what is left halves, so a first block stops as well.
DEPTHS = (0.5, 0.75, 0.875, 0.9375)
#: Reading stops when a query has so many candidates in a block, at most.
FEW = 64
#: Pairs whose scores are resolved at once.
PAIRS = 100_000


def _kth(values: np.ndarray, k: int) -> np.ndarray:
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, -k]


def _whole(x: float) -> int:
    return math.floor(256 * x) if abs(x) < 2.0**900 else 256 * int(x)


def _scores(queries: np.ndarray, rows: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Exact scores of the pairs ``q, r`` of vectors; what doesn't fit becomes BEYOND or its negative."""
    out = np.empty(len(q), np.int64)
    for at in range(0, len(q), PAIRS):
        some = slice(at, at + PAIRS)
        with np.errstate(over="ignore", invalid="ignore"):
            a, b = np.floor(256 * queries[q[some]]), np.floor(256 * rows[r[some]])
            fits = np.einsum("ij,ij->i", np.abs(a), np.abs(b)) < EXACT / 2
        out[some][fits] = np.einsum("ij,ij->i", a[fits], b[fits])
        for i in at + np.flatnonzero(~fits):
            score = sum(_whole(x) * _whole(y) for x, y in zip(queries[q[i]].tolist(), rows[r[i]].tolist(), strict=True))
            out[i] = max(-BEYOND, min(BEYOND, score))
    return out


class NoRandomAccess(Search):
    """``stopped`` counts the queries by the share of a block's lists after which they needed no more."""

    def __init__(self, k: int) -> None:
        self.k = k
        self.stopped: Counter[float] = Counter()

    def run(self, query_ids: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, codes: list[np.ndarray], best: Best) -> None:
        k = self.k
        given_queries, given_rows = queries, rows
        with np.errstate(over="ignore"):
            rows, queries = np.floor(256 * rows), np.floor(256 * queries)
        n, d = rows.shape
        lists = np.sort(rows, axis=0)[::-1]
        rank = np.argsort(np.argsort(-rows, axis=0, kind="stable"), axis=0)
        with np.errstate(over="ignore", invalid="ignore"):
            most = np.abs(rows).max() * np.abs(queries).max(initial=0) * d
        kind = np.float32 if most < 2**24 else np.float64
        # Twice what the sums of d rounded products may be off by, as a share of the sum of their sizes.
        slack = 0.0 if most < EXACT else 4 * d * 2.0**-53
        least = best.least()
        waiting = np.arange(len(query_ids))
        for share in (*DEPTHS, 1.0) if most < 2.0**1000 else (1.0,):
            depth = min(n, max(k, int(np.ceil(share * n))))
            if not len(waiting):
                break
            top, bottom = lists[depth - 1], lists[n - depth]
            upper_top, upper_bottom = np.maximum(rows, top).astype(kind), np.minimum(rows, bottom).astype(kind)
            lower_top = np.where(rank < depth, rows, lists[-1]).astype(kind)
            lower_bottom = np.where(rank >= n - depth, rows, lists[0]).astype(kind)
            left = []
            for some in np.array_split(waiting, -(-len(waiting) // QUERIES)):
                up, down = np.maximum(queries[some], 0).astype(kind), np.minimum(queries[some], 0).astype(kind)
                own = query_ids[some][:, None] == ids

                def products(a: np.ndarray, b: np.ndarray, off: float, up=up, down=down) -> np.ndarray:
                    total = up @ a.T + down @ b.T
                    return total + off * (up @ np.abs(a).T - down @ np.abs(b).T) if off else total

                if most < 2.0**1000:
                    upper = products(upper_top, upper_bottom, slack)
                    upper[own] = -np.inf
                    if depth < n or slack:
                        lower = products(lower_top, lower_bottom, -slack)
                        lower[own] = -np.inf
                        bound = np.maximum(least[some], _kth(lower, k))
                    else:
                        bound = np.maximum(least[some], _kth(upper, k))
                    can = (upper >= bound[:, None]) & ~own
                else:
                    # Doubles don't hold the sums: all are candidates.
                    can = ~own
                done = can.sum(axis=1) <= FEW if depth < n else np.ones(len(some), bool)
                q, r = np.nonzero(can & done[:, None])
                best.add(some[q], ids[r], _scores(given_queries, given_rows, some[q], r))
                self.stopped[depth / n] += int(done.sum())
                left.append(some[~done])
            waiting = np.concatenate(left)


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K) -> DataFrame:
    """``query_id, rank, vec_id, score`` for the rows whose vec_id is divisible by ``every``."""
    found = search(usable(vectors, float("inf")), F.col("vec_id") % every == 0, lambda d: NoRandomAccess(k), k, np.int64)
    fails = F.raise_error(F.concat(F.lit("a score of vec_id "), F.col("query_id").cast("string"), F.lit(" does not fit 64 bits"))).cast("long")
    return found.withColumn("score", F.when(F.col("score").between(-BEYOND + 1, BEYOND - 1), F.col("score")).otherwise(fails))


def op1_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five highest inner products of every fiftieth embedding."""
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id % 50 = 0 AND q.vec_id <> v.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

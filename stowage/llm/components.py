"""Connected components of a table of links, by alternating stars.

Each round sends every neighbour of a node to the smallest node around it, first the
larger neighbours and then the smaller ones, so paths fold up and a component ends as
a star around its smallest node. The rounds are joins and sums by node, and each round's
links are a written table, so lineage stays short.

A round is some ten shuffles, whose plans, tasks and outputs the driver keeps account of.
So FEW links at most, a bound that doesn't follow the input, are joined up in the driver
instead, with the same result; more are never collected.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, functions as F

from stowage.session import discard, materialize

ROUNDS = 60
#: Distinct links that the driver joins up by itself at most, 16 bytes each.
FEW = 100_000


def _stars(links: DataFrame, large: bool) -> DataFrame:
    """Links ``u, v`` with u > v; the same after every node has passed on its neighbours."""
    if large:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        moved = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return moved.filter("u <> v").distinct()


def _joined(links: pa.Table) -> pa.Table:
    """``node, component`` of the links ``u, v``, by union and find."""
    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (above := up.setdefault(x, x)) != x:
            up[x] = up[above]
            x = up[x]
        return x

    for u, v in zip(links["u"].to_pylist(), links["v"].to_pylist(), strict=True):
        a, b = root(u), root(v)
        up[max(a, b)] = min(a, b)
    ends = [(x, least) for x in list(up) if (least := root(x)) != x]
    return pa.table({"node": pa.array([x for x, _ in ends], pa.int64()), "component": pa.array([least for _, least in ends], pa.int64())})


def components(links: DataFrame) -> DataFrame:
    """``node, component`` of the links ``x, y``: each node but its component's smallest, which names it."""
    spark = links.sparkSession
    distinct = links.filter("x <> y").select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()
    written = Observation()
    now = materialize(distinct.observe(written, F.count("*").alias("n")), "links")
    if written.get["n"] <= FEW:
        found = materialize(spark.createDataFrame(_joined(now.toArrow()), "node long, component long"), "components")
        discard(spark, now)
        return found
    before = None
    for _ in range(ROUNDS):
        last, seen = now, Observation()
        mark = F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum")
        now = materialize(_stars(_stars(now, True), False).observe(seen, *mark), "links")
        discard(spark, last)
        if seen.get == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = seen.get
    raise RuntimeError(f"the components did not settle in {ROUNDS} rounds")

"""Positions and running sums over a whole table, without a task that sees all of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.session import materialize


def _ranged(df: DataFrame, order: list[Column]) -> DataFrame:
    """``df`` range-sorted and written, with each row's range in ``__part`` and its place there in ``__row``."""
    keys = {f"__order_{i}": c for i, c in enumerate(order)}
    sorted_rows = df.withColumns(keys).repartitionByRange(*keys).sortWithinPartitions(*keys).drop(*keys)
    row = F.monotonically_increasing_id()
    return materialize(sorted_rows.withColumns({"__part": F.shiftright(row, 33), "__row": row.bitwiseAND(F.lit(2**33 - 1))}), "numbered")


def number(df: DataFrame, order: list[Column], name: str = "pos", sums: dict[str, str] | None = None) -> DataFrame:
    """``df`` with each row's place from 0 in ``order``, and exclusive running sums: a new name for each summed column.

    Ranges are sorted on their own; the totals of the ranges, one row for each
    partition, give every range its start. The order should leave no ties.
    """
    sums = sums or {}
    rows = _ranged(df, order)
    totals = rows.groupBy("__part").agg(F.count("*").alias("__n"), *[F.sum(c).alias(f"__sum_{n}") for n, c in sums.items()])
    earlier = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    start = lambda c: F.coalesce(F.sum(c).over(earlier), F.lit(0))
    starts = totals.select("__part", start("__n").alias("__n"), *[start(f"__sum_{n}").alias(f"__sum_{n}") for n in sums])
    before = Window.partitionBy("__part").orderBy("__row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumns({n: F.coalesce(F.sum(c).over(before), F.lit(0)) for n, c in sums.items()})
    # One row for each partition: small by construction.
    out = out.join(F.broadcast(starts), "__part")
    out = out.withColumns({name: F.col("__n") + F.col("__row"), **{n: F.col(n) + F.col(f"__sum_{n}") for n in sums}})
    return out.drop("__part", "__row", "__n", *[f"__sum_{n}" for n in sums])


def before(df: DataFrame, order: list[Column], column: str, name: str) -> DataFrame:
    """``df`` with the column's value in the row before in ``order``, null in the first row.

    The last row of each range gives its value to the first row of the next one.
    """
    rows = _ranged(df, order)
    last = rows.groupBy("__part").agg(F.max_by(column, "__row").alias("__last"))
    carried = last.select("__part", F.lag("__last").over(Window.orderBy("__part")).alias("__carried"))
    here = F.lag(column).over(Window.partitionBy("__part").orderBy("__row"))
    # One row for each partition: small by construction.
    out = rows.withColumn("__here", here).join(F.broadcast(carried), "__part")
    return out.withColumn(name, F.when(F.col("__row") == 0, F.col("__carried")).otherwise(F.col("__here"))).drop("__part", "__row", "__here", "__carried")


def traversal(path: Column) -> list[Column]:
    """The order of a walk that visits a folder before what is in it, names in byte order."""
    return [F.split(path, "/", -1)]

"""Mixing sources to target weights.

Every row gets a hash-random key. The key order within a source is the order in which
the mix takes rows; a source's budget is taken in whole epochs and then a part of one,
cut where the prefix sum of sizes reaches the budget, inside a row if need be, so the
words taken are the budget exactly.

The rows are range-sorted by source, key, doc_id, size, text and row, and the prefix sums
are distributed: ranges are summed on their own, and their totals, one for each range,
give every range its start. No two rows are equal in that order, so neither a source with a
third of all rows nor a third of rows without a doc_id is a hot spot. Targets come from
windows over the table of sources.

Cases: a null source is a source of its own, the last in order; a null or empty text
has size 0 and takes nothing; sources whose sizes are all 0 have target 0; rows of one
doc_id, and all without one, share a key and are ordered by size and a hash of the text,
rows that agree in these are interchangeable; an empty input gives an empty result.
Columns that are named as the plan's replace those of the input in the plan only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from stowage.operators import order
from stowage.session import materialize

#: A source is used at most so many times.
EPOCHS = 3
#: Weights by the place of the source in code point order, repeating.
WEIGHTS = (1, 2, 3)
#: Bytes of the table of sources up to which every task has a copy.
SOURCES_BYTES = 8 * 2**20
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _source_key(source: Column) -> Column:
    """Not null, and in the order of the code points with null last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source))


def targets(sizes: DataFrame) -> DataFrame:
    """``source_key, source_size`` with ``target``, by water filling, and ``source_start``, the size of the sources before.

    A source is full when its share by weight, among those not yet full, is above
    EPOCHS times its size. In the order of size by weight the full sources come first,
    so one running sum finds them all.
    """
    place = F.row_number().over(Window.orderBy("source_key")) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    whole = Window.partitionBy()
    before = Window.orderBy(F.col("source_size") / F.col("weight"), "source_key").rowsBetween(Window.unboundedPreceding, -1)
    cap = F.col("source_size") * EPOCHS
    ordered = (
        sizes.withColumn("weight", weight.cast("long"))
        .withColumn("all_size", F.sum("source_size").over(whole))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("left_size", F.col("all_size") - F.coalesce(F.sum(cap).over(before), F.lit(0)))
        .withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("full", F.col("weight").cast("double") * F.col("left_size") >= cap.cast("double") * F.col("left_weight"))
    )
    rest_size = F.col("all_size") - F.coalesce(F.sum(F.when(F.col("full"), cap)).over(whole), F.lit(0))
    rest_weight = F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(whole), F.lit(0))
    share = F.try_divide((F.col("weight") * rest_size).cast("double"), rest_weight.cast("double"))
    ahead = F.sum("source_size").over(Window.orderBy("source_key").rowsBetween(Window.unboundedPreceding, -1))
    return ordered.select(
        "source_key", "source_size", F.when(F.col("full"), cap.cast("double")).otherwise(share).alias("target"),
        F.coalesce(ahead, F.lit(0)).alias("source_start"),
    )


def _sized(docs: DataFrame) -> DataFrame:
    """What a plan needs of documents, which have a row number in ``row``."""
    return docs.select("row", "doc_id", _source_key(F.col("source")).alias("source_key"), words_in(F.col("text")).alias("size"), F.xxhash64("text").alias("content"))


def _planned(rows: DataFrame) -> DataFrame:
    """The plan of ``row, doc_id, source_key, size, content``; it has ``row`` too."""
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    goals = materialize(targets(rows.groupBy("source_key").agg(F.sum("size").alias("source_size"))), "targets")
    held = goals.agg(F.sum(F.octet_length("source_key") + 64)).first()[0] or 0
    by = [F.col(c) for c in ("source_key", "key", "doc_id", "size", "content", "row")]
    placed = order.number(rows.withColumn("key", key), by, "place", {"before": "size"})
    placed = placed.join(F.broadcast(goals) if held <= SOURCES_BYTES else goals, "source_key")
    start = F.col("before") - F.col("source_start")
    budget = F.floor("target").cast("long")
    epochs = F.coalesce(F.try_divide(budget - budget % F.greatest(F.col("source_size"), F.lit(1)), F.col("source_size")), F.lit(0)).cast("long")
    part = F.least(F.col("size"), F.greatest(F.lit(0), budget - F.col("epochs") * F.col("source_size") - start))
    return (
        placed.withColumn("epochs", epochs)
        .withColumn("taken", (F.col("epochs") * F.col("size") + part).cast("long"))
        .select("row", "doc_id", "source_key", "size", "key", "source_size", "target", "epochs", "taken")
    )


def plan_mix(docs: DataFrame) -> DataFrame:
    """``doc_id, source_key, size, key, source_size, target, epochs, taken`` for every row of documents."""
    rows = materialize(_sized(docs.select("doc_id", "source", "text").withColumn("row", F.monotonically_increasing_id())), "mix")
    return _planned(rows).drop("row")


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word."""
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    return F.array_join(F.slice(pieces, F.lit(1), n.cast("int")), "")


def apply_mix(docs: DataFrame) -> DataFrame:
    """The rows that the mix takes, with the columns of ``docs``.

    A row stands once for each whole time that it is taken; the row that a budget's
    end cuts stands once more with the words up to the cut. Of rows that agree in source,
    doc_id and text any may be the one that is cut.
    """
    numbered = materialize(docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc")).withColumn("row", F.monotonically_increasing_id()), "mixed")
    rows = materialize(_sized(numbered.select("row", "doc.doc_id", "doc.source", "doc.text")), "mix")
    plan = _planned(rows).filter("taken > 0").select("row", "size", "taken")
    size, taken = F.col("size"), F.col("taken")
    whole = F.try_divide(taken - taken % size, size).cast("int")
    copies = numbered.join(plan, "row").withColumn("left", F.explode(
        F.concat(F.array_repeat(size, whole), F.when(taken % size > 0, F.array(taken % size)).otherwise(F.array().cast("array<bigint>")))
    ))
    text = F.when(F.col("left") == size, F.col("doc.text")).otherwise(first_words(F.col("doc.text"), F.col("left")))
    return copies.select(*[text.alias("text") if c == "text" else F.col("doc")[c].alias(c) for c in docs.columns])


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mix of all documents, one row for each."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return plan_mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS s, (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, sum(s) OVER () - coalesce(sum(3 * s) OVER p, 0) AS ls, sum(w) OVER () - coalesce(sum(w) OVER p, 0) AS lw
  FROM s WINDOW p AS (ORDER BY s / w, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
c AS (SELECT *, w::DOUBLE * ls >= (3 * s)::DOUBLE * lw AS full_up FROM o),
t AS (
  SELECT source, s, CASE WHEN full_up THEN (3 * s)::DOUBLE
    ELSE (w * (sum(s) OVER () - coalesce(sum(3 * s) FILTER (full_up) OVER (), 0)))::DOUBLE
         / (sum(w) OVER () - coalesce(sum(w) FILTER (full_up) OVER (), 0))::DOUBLE END AS target
  FROM c),
r AS (
  SELECT d.*, t.s, t.target, floor(t.target)::BIGINT AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, s AS source_size, target,
       (CASE WHEN s = 0 THEN 0 ELSE budget // s END * size
        + least(size, greatest(0, budget - CASE WHEN s = 0 THEN 0 ELSE budget // s END * s - start)))::BIGINT AS taken
FROM r
"""

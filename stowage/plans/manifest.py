"""The driver's documents as members of an archive: files in folders, links, their places in the body."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.operators import order
from stowage.session import table

CHUNK = 4096


def members(spark: SparkSession, sf_dir: str, places: bool = True) -> DataFrame:
    """Ten folders, then each document as a file, every 17th as a hard link to the one before, every 23rd as a symlink.

    A few entries break rules on purpose, by their number; see ``SQL``, which makes the same rows.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", F.octet_length("text").cast("long").alias("n"))
    i = F.col("doc_id")
    path = lambda d: F.concat(F.lit("d"), (d % 10).cast("string"), F.lit("/f"), d.cast("string"))
    kind = F.when(i % 101 == 7, 9).when(i % 17 == 3, 4).when(i % 23 == 5, 3).otherwise(1)
    files = docs.select(
        (i + 10).alias("pos"), kind.cast("int").alias("type"),
        F.when(i % 89 == 11, F.concat(F.lit("d1/../f"), i.cast("string"))).when(i % 83 == 9, path(i - 1)).when(i % 79 == 2, F.concat(F.lit("none/f"), i.cast("string"))).otherwise(path(i)).alias("path"),
        F.when(kind == 4, F.when(i % 51 == 20, path(i + 1)).otherwise(path(i - 1))).when(kind == 3, F.when(i % 46 == 5, F.concat(F.lit("/f"), i.cast("string"))).otherwise(path(i + 1))).otherwise("").alias("link"),
        (F.lit(0o100600) + i % 64).alias("mode"), (i % 1000).alias("uid"), (i % 100).alias("gid"),
        ((i - 100) * 1_234_567_890_123).alias("mtime_ns"),
        F.when(kind.isin(1, 9), F.col("n")).otherwise(0).cast("long").alias("size_original"),
    )
    folders = docs.filter(i < 10).select(
        i.alias("pos"), F.lit(2).alias("type"), F.concat(F.lit("d"), i.cast("string")).alias("path"), F.lit("").alias("link"), F.lit(0o40755).cast("long").alias("mode"),
        F.lit(0).cast("long").alias("uid"), F.lit(0).cast("long").alias("gid"), F.lit(0).cast("long").alias("mtime_ns"), F.lit(0).cast("long").alias("size_original"),
    )
    rows = files.unionByName(folders)
    count = F.when(F.col("type") == 1, F.call_function("div", F.col("size_original") + (CHUNK - 1), F.lit(CHUNK).cast("long"))).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("chunk_count", count)
    sizes = F.when(F.col("chunk_count") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("chunk_count") - 1), lambda k: F.least(F.lit(CHUNK).cast("long"), F.col("size_original") - k * CHUNK)))
    rows = rows.withColumn("chunk_sizes", F.coalesce(sizes, F.array().cast("array<bigint>")))
    stored = F.when(F.col("type") == 1, F.col("size_original")).otherwise(F.lit(0).cast("long"))
    rows = rows.withColumn("body", stored).withColumn("size_compressed", stored + F.when((F.col("type") == 1) & (F.col("pos") % 97 == 13), 1).otherwise(0))
    if not places:
        return rows
    rows = order.number(rows, [F.col("pos")], "place", {"data_offset": "body"})
    at = F.col("data_offset") + 16 + F.when(F.col("pos") % 211 == 100, 1).otherwise(0)
    return rows.withColumn("data_offset", F.when(F.col("body") > 0, at).otherwise(F.lit(0).cast("long"))).drop("place", "body")


SQL = f"""
base AS (
  SELECT doc_id AS i, strlen(text) AS n,
    CASE WHEN doc_id % 101 = 7 THEN 9 WHEN doc_id % 17 = 3 THEN 4 WHEN doc_id % 23 = 5 THEN 3 ELSE 1 END AS kind FROM documents),
files AS (
  SELECT i + 10 AS pos, kind AS type,
    CASE WHEN i % 89 = 11 THEN 'd1/../f' || i WHEN i % 83 = 9 THEN 'd' || ((i - 1) % 10) || '/f' || (i - 1)
         WHEN i % 79 = 2 THEN 'none/f' || i ELSE 'd' || (i % 10) || '/f' || i END AS path,
    CASE WHEN kind = 4 AND i % 51 = 20 THEN 'd' || ((i + 1) % 10) || '/f' || (i + 1) WHEN kind = 4 THEN 'd' || ((i - 1) % 10) || '/f' || (i - 1)
         WHEN kind = 3 AND i % 46 = 5 THEN '/f' || i WHEN kind = 3 THEN 'd' || ((i + 1) % 10) || '/f' || (i + 1) ELSE '' END AS link,
    33152 + i % 64 AS mode, i % 1000 AS uid, i % 100 AS gid, (i - 100) * 1234567890123 AS mtime_ns,
    CASE WHEN kind IN (1, 9) THEN n ELSE 0 END AS size_original
  FROM base
  UNION ALL SELECT i, 2, 'd' || i, '', 16877, 0, 0, 0, 0 FROM base WHERE i < 10),
counted AS (SELECT *, CASE WHEN type = 1 THEN (size_original + {CHUNK - 1}) // {CHUNK} ELSE 0 END AS chunk_count, CASE WHEN type = 1 THEN size_original ELSE 0 END AS body FROM files),
members AS (
  SELECT * EXCLUDE (body), list_transform(range(chunk_count), lambda k: least({CHUNK}, size_original - k * {CHUNK})) AS chunk_sizes,
    body + CASE WHEN type = 1 AND pos % 97 = 13 THEN 1 ELSE 0 END AS size_compressed,
    CASE WHEN body > 0 THEN 16 + coalesce(sum(body) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + CASE WHEN pos % 211 = 100 THEN 1 ELSE 0 END ELSE 0 END::BIGINT AS data_offset
  FROM counted)
"""

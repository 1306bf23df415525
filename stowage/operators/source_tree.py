"""Entries of folders on their way to members: order, hard links, boundaries, changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from stowage.functions import paths


def boundary(entries: DataFrame, devices: DataFrame) -> DataFrame:
    """Entries without folders on another device than their root's, and without all below these.

    ``devices`` has ``root, root_dev``. The test goes along each entry's ancestors, so
    it costs one join, whatever the depth.
    """
    known = entries.join(devices, "root")
    off = known.filter((F.col("kind") == "dir") & (F.col("dev") != F.col("root_dev"))).select("root", F.col("member_path").alias("up"))
    up = F.concat(paths.ancestors(F.col("member_path")), F.array("member_path"))
    pruned = entries.select("root", "member_path", F.explode(up).alias("up")).join(off, ["root", "up"]).select("root", "member_path").distinct()
    return entries.join(pruned, ["root", "member_path"], "left_anti")


def classify(entries: DataFrame) -> DataFrame:
    """``action`` for each entry: dir, file, symlink, hardlink (with ``link``), or skip.

    A file is a hard link if an earlier entry of its root, by ``seq``, has its device
    and number; files with one name, or without a number, never are.
    """
    linked = (F.col("kind") == "file") & (F.col("nlink") > 1) & (F.col("ino") != 0)
    key = Window.partitionBy("root", "dev", "ino", linked, F.when(~linked, F.col("seq")))
    first = F.first("member_path").over(key.orderBy("seq"))
    rows = entries.withColumn("link", F.when(linked & (first != F.col("member_path")), first).when(F.col("kind") == "symlink", F.col("link_target")).otherwise(F.lit("")))
    action = F.when(linked & (F.col("link") != ""), "hardlink").when(F.col("kind").isin("dir", "file", "symlink"), F.col("kind")).otherwise("skip")
    return rows.withColumn("action", action)


def first_seen(rows: DataFrame, key: str, order: str, name: str) -> DataFrame:
    """For each row the ``name`` of the first row with its key, as if equal keys were one file."""
    first = rows.groupBy(key).agg(F.min_by(name, order).alias("first"))
    return rows.join(first, key)


def modified(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths of files whose size or time changed, or that are gone, in order of path."""
    new = after.select("member_path", F.col("size").alias("new_size"), F.col("mtime_ns").alias("new_mtime"))
    joined = before.filter("kind = 'file'").join(new, "member_path", "left")
    return joined.filter("NOT (size <=> new_size AND mtime_ns <=> new_mtime)").select("member_path")

"""Rules for members as DataFrames, and the first one that an archive breaks.

The stages follow the order in which a reader looks: entries by themselves (6), targets
of hard links (7), paths that occur twice (8), folders above (9), overlaps (13), types
of targets (14), gaps (15), digests of members without data (16).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from stowage.functions import paths
from stowage.functions.binary import CHUNK, HEADER, checked_sum, expected_chunks
from stowage.operators import chunks

FILE, FOLDER, SYMLINK, HARDLINK = 1, 2, 3, 4


def without_data() -> Column:
    return (F.col("type") != FILE) | (F.col("size_original") == 0)


def entry_code(index_offset: Column, chunk: int = CHUNK) -> Column:
    """The code of the first rule that an entry breaks by itself, or null."""
    kind, size, stored, at = F.col("type"), F.col("size_original"), F.col("size_compressed"), F.col("data_offset")
    link = F.when(kind == SYMLINK, paths.symlink_target_code(F.col("link"))).when(kind == HARDLINK, paths.hardlink_target_code(F.col("link")))
    path = paths.member_path_code(F.col("path"))
    total = F.aggregate("chunk_sizes", F.lit(0).cast("decimal(20,0)"), lambda a, x: (a + x.cast("decimal(20,0)")).cast("decimal(20,0)"))
    end = checked_sum(at, stored)
    return (
        F.when(~kind.isin(FILE, FOLDER, SYMLINK, HARDLINK), "FMT_MEMBER_TYPE")
        .when(path.isNotNull(), path)
        .when(link.isNotNull(), link)
        .when(without_data() & ((size != 0) | (stored != 0) | (at != 0) | (F.col("chunk_count") != 0)), "FMT_INDEX")
        .when(~without_data() & (F.col("chunk_count") != expected_chunks(size, chunk)), "FMT_INDEX")
        .when(~without_data() & (total != stored), "FMT_INDEX")
        .when(~without_data() & (end.isNull() | (at < HEADER) | (end > index_offset)), "FMT_INDEX")
    )


def _error(rows: DataFrame, stage: int, code: Column | str = "FMT_INDEX") -> DataFrame:
    shown = code if isinstance(code, Column) else F.lit(code)
    return rows.select(F.lit(stage).cast("int").alias("stage"), F.col("pos").cast("long"), shown.alias("code"))


def hardlink_targets(members: DataFrame) -> DataFrame:
    """Hard links with ``target_pos`` and ``target_type`` of the first member of that path, null if it is not before them."""
    first = members.groupBy(F.col("path").alias("link")).agg(F.min(F.struct("pos", "type")).alias("target"))
    joined = members.filter(F.col("type") == HARDLINK).join(first, "link", "left")
    before = F.col("target.pos") < F.col("pos")
    return joined.select("pos", "path", "link", F.when(before, F.col("target.pos")).alias("target_pos"), F.when(before, F.col("target.type")).alias("target_type"))


def duplicates(members: DataFrame) -> DataFrame:
    """Members whose path an earlier one has: ``path, pos, last_pos``."""
    order = Window.partitionBy("path").orderBy("pos")
    return members.select("path", "pos", F.lag("pos").over(order).alias("last_pos")).filter("last_pos IS NOT NULL")


def missing_ancestors(members: DataFrame) -> DataFrame:
    """``pos, ancestor, reason`` for folders above members that are missing, come after, or are no folders.

    Folders are judged once each, by the first member below them; only those that fail
    meet the members again. So a folder that is as it should be is no hot key.
    """
    below = members.select("pos", F.explode(paths.ancestors(F.col("path"))).alias("ancestor"))
    wanted = below.groupBy("ancestor").agg(F.min("pos").alias("first_pos"))
    first = members.groupBy(F.col("path").alias("ancestor")).agg(F.min(F.struct("pos", "type")).alias("up"))
    bad = wanted.join(first, "ancestor", "left").filter(F.col("up").isNull() | (F.col("up.type") != FOLDER) | (F.col("up.pos") >= F.col("first_pos")))
    reason = F.when(F.col("up").isNull(), "missing").when(F.col("up.pos") >= F.col("pos"), "after child").when(F.col("up.type") != FOLDER, "not a directory")
    return below.join(bad.select("ancestor", "up"), "ancestor").select("pos", "ancestor", reason.alias("reason")).filter("reason IS NOT NULL")


def errors(members: DataFrame, index_offset: int, chunk: int = CHUNK, empty_digest: bytes | None = None) -> DataFrame:
    """All broken rules: ``stage, pos, code``."""
    code = entry_code(F.lit(index_offset), chunk)
    targets = hardlink_targets(members)
    body = chunks.consecutive(members)
    found = [
        _error(members.withColumn("code", code).filter("code IS NOT NULL"), 6, F.col("code")),
        _error(targets.filter("target_pos IS NULL"), 7),
        _error(duplicates(members), 8),
        _error(missing_ancestors(members), 9),
        _error(chunks.overlaps(body), 13),
        _error(targets.filter((F.col("target_pos").isNotNull()) & (F.col("target_type") != FILE)), 14),
        _error(chunks.gaps(body, index_offset), 15),
    ]
    if empty_digest is not None:
        found.append(_error(members.filter(without_data() & (F.col("hash") != F.lit(empty_digest))), 16, "HASH_MEMBER"))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    return every.distinct()


def first_error(found: DataFrame) -> DataFrame:
    """The one error that a reader reports: the first stage, then the first member."""
    at = F.struct("stage", F.coalesce("pos", F.lit(2**62)), "code")
    row = found.agg(F.min(at).alias("e")).filter("e IS NOT NULL")
    return row.select(F.col("e.stage").alias("stage"), F.when(F.col("e.col2") < 2**62, F.col("e.col2")).alias("pos"), F.col("e.code").alias("code"))

"""Members by name: lookup, closure over hard links, conflicts with what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from stowage.functions import paths


def lookup(members: DataFrame, requested: DataFrame) -> DataFrame:
    """``request, path, pos``: for every request, repeated ones too, the first member of that path, or null."""
    first = members.groupBy("path").agg(F.min("pos").alias("pos"))
    return requested.join(first, "path", "left").select("request", "path", "pos")


def selection(members: DataFrame, requested: DataFrame) -> DataFrame:
    """Positions of the requested members and of the files that requested hard links point to."""
    chosen = members.join(requested.select("path").distinct(), "path", "left_semi")
    first = members.groupBy(F.col("path").alias("link")).agg(F.min("pos").alias("pos"))
    targets = chosen.filter("type = 4").select("link").join(first, "link").select("pos")
    return chosen.select("pos").union(targets).distinct()


def missing(members: DataFrame, requested: DataFrame) -> DataFrame:
    """Requested paths that no member has."""
    return requested.select("path").distinct().join(members.select("path"), "path", "left_anti")


def conflicts(members: DataFrame, selected: DataFrame, there: DataFrame, selective: bool = True) -> DataFrame:
    """``path, kind`` of what is in the way: selected members that exist, and folders above that are none.

    ``there`` has ``path, kind`` of the destination. Folders above are looked at when
    only some members are taken, as the others bring theirs along.
    """
    chosen = members.join(selected, "pos", "left_semi").select("path").distinct()
    existing = chosen.join(there, "path")
    if not selective:
        return existing
    above = chosen.select(F.explode(paths.ancestors(F.col("path"))).alias("path")).distinct().join(chosen, "path", "left_anti")
    return existing.union(above.join(there.filter("kind <> 'dir'"), "path"))

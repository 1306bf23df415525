"""Member paths and link targets as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

LONGEST = 1023


def parts(path: Column) -> Column:
    """The components, empty ones included."""
    return F.split(path, "/", -1)


def _first(path: Column, names: tuple[str, ...]) -> Column:
    return F.get(F.filter(parts(path), lambda c: c.isin(*names)), F.lit(0))


def member_path_code(path: Column) -> Column:
    """The code of the first rule that a member path breaks, or null; takes strings and raw bytes."""
    size, text, bad = F.octet_length(path), path.cast("string"), _first(path.cast("string"), ("", ".", ".."))
    return (
        F.when(size == 0, "FMT_INDEX")
        .when(size > LONGEST, "PATH_TOO_LONG")
        .when(text.startswith("/"), "PATH_ABSOLUTE")
        .when(text.endswith("/"), "FMT_INDEX")
        .when(F.instr(text, "\0") > 0, "FMT_INDEX")
        .when(~F.is_valid_utf8(path), "PATH_ENCODING")
        .when(bad == "..", "PATH_TRAVERSAL")
        .when(bad.isNotNull(), "FMT_INDEX")
    )


def symlink_target_code(target: Column) -> Column:
    """As above for a symlink target: dots, empty components and a last slash are allowed."""
    size, text = F.octet_length(target), target.cast("string")
    return (
        F.when((size == 0) | (size > LONGEST), "FMT_INDEX")
        .when(text.startswith("/"), "PATH_ABSOLUTE")
        .when(F.instr(text, "\0") > 0, "FMT_INDEX")
        .when(~F.is_valid_utf8(target), "PATH_ENCODING")
        .when(_first(text, ("..",)).isNotNull(), "PATH_TRAVERSAL")
    )


def hardlink_target_code(target: Column) -> Column:
    """As for a member path, but a long target is an error of the index."""
    return F.when(F.octet_length(target) > LONGEST, "FMT_INDEX").otherwise(member_path_code(target))


def ancestors(path: Column) -> Column:
    """All proper ancestors, the top one first."""
    split = parts(path)
    up = F.when(F.size(split) > 1, F.sequence(F.lit(1), F.size(split) - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(up, lambda n: F.array_join(F.slice(split, F.lit(1), n), "/"))


def basename(path: Column) -> Column:
    return F.element_at(parts(path), -1)


def parent(path: Column) -> Column:
    """The path up to the last slash; empty at the top."""
    split = parts(path)
    return F.array_join(F.slice(split, F.lit(1), F.size(split) - 1), "/")


def join(folder: Column, name: Column) -> Column:
    return F.when(folder == "", name).when(folder.endswith("/"), F.concat(folder, name)).otherwise(F.concat(folder, F.lit("/"), name))


def contains(root: Column, path: Column) -> Column:
    """Whether a path is the root or lies below it."""
    return (path == root) | path.startswith(F.concat(F.rtrim(root, F.lit("/")), F.lit("/")))


def below(root: Column, path: Column) -> Column:
    """The member path of an absolute path under the root; null elsewhere, and for the root itself."""
    top = F.concat(F.rtrim(root, F.lit("/")), F.lit("/"))
    return F.when(path.startswith(top) & (path != top), F.substring(path, F.length(top) + 1, F.lit(2**31 - 1)))

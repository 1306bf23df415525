"""The commands on archives as Spark plans: create, list, verify, extract."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.functions import codec, listing
from stowage.functions.errors import ArchiveError, from_tasks
from stowage.operators import order, source_tree
from stowage.session import ship
from stowage.sources import format as fmt
from stowage.sources.archive import ArchiveSink, read_archive, register
from stowage.sources.tree import Extraction

#: Levels of the two ways to compress.
LEVEL, FAST = 6, 1


def members(spark: SparkSession, *archives: str) -> DataFrame:
    register(spark)
    return spark.read.format("stowage_members").option("paths", "\n".join(archives)).load()


def chunks(spark: SparkSession, *archives: str) -> DataFrame:
    register(spark)
    return spark.read.format("stowage_chunks").option("paths", "\n".join(archives)).load()


def entries(spark: SparkSession, *sources: str) -> DataFrame:
    """What is below the sources, without what lies below folders of other devices, numbered as a walk would."""
    register(spark)
    rows = spark.read.format("stowage_tree").option("paths", "\n".join(sources)).load()
    roots = spark.createDataFrame([(os.path.realpath(s), i) for i, s in enumerate(sources)], "root string, source int")
    rows = rows.join(F.broadcast(roots), "root")
    numbered = order.number(rows, [F.col("source"), *order.traversal(F.col("member_path"))], "seq")
    return source_tree.classify(numbered)


def _pieces(rows: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    """Entries to rows of the archive writer: files are read and compressed chunk by chunk, the others have one row.

    Entries that are no members are named in ``skipped``, and files that changed while they were read in ``modified``.
    """
    names = ["pos", "chunk_index", "type", "mode", "uid", "gid", "mtime_ns", "size_original", "path", "link", "data"]
    types = {"dir": fmt.FOLDER, "file": fmt.FILE, "symlink": fmt.SYMLINK, "hardlink": fmt.HARDLINK}
    schema = pa.schema([(n, pa.int64()) for n in names[:2]] + [("type", pa.int32())] + [(n, pa.int64()) for n in names[3:8]] + [("path", pa.string()), ("link", pa.string()), ("data", pa.binary()), ("modified", pa.string()), ("skipped", pa.string())])
    for batch in rows:
        for e in batch.to_pylist():
            if e["action"] == "skip":
                yield pa.RecordBatch.from_pylist([{"pos": e["seq"], "path": e["member_path"], "skipped": e["abs_path"]}], schema)
                continue
            common = {
                "pos": e["seq"], "type": types[e["action"]], "mode": e["mode"], "uid": e["uid"], "gid": e["gid"], "mtime_ns": e["mtime_ns"],
                "path": e["member_path"], "link": e["link"], "size_original": e["size"] if e["action"] == "file" else 0,
            }
            if e["action"] != "file" or not e["size"]:
                yield pa.RecordBatch.from_pylist([common | {"chunk_index": 0, "data": None}], schema)
                continue
            with open(e["abs_path"], "rb") as f:
                left, i = e["size"], 0
                while left:
                    piece = f.read(min(fmt.CHUNK, left))
                    if not piece:
                        raise ArchiveError("IO_READ", "the file ends too early", e["abs_path"])
                    left -= len(piece)
                    yield pa.RecordBatch.from_pylist([common | {"chunk_index": i, "data": codec.encode(piece, level)}], schema)
                    i += 1
                now = os.fstat(f.fileno())
            if now.st_size != e["size"] or now.st_mtime_ns != e["mtime_ns"]:
                yield pa.RecordBatch.from_pylist([common | {"chunk_index": i, "modified": e["abs_path"]}], schema)


def create(spark: SparkSession, archive: str, *sources: str, fast: bool = False, hash_alg: int = fmt.BLAKE3) -> None:
    """An archive of the sources, in the order of a walk; it appears whole or not at all.

    Special files and folders of other devices are left out with a warning. Files that change while they
    are read make the archive fail in the end, with the paths of all of them.
    """
    ship(spark)
    target = os.path.realpath(archive)
    for s in sources:
        root = os.path.realpath(s)
        if target == root or target.startswith(root.rstrip("/") + "/"):
            raise ArchiveError("USAGE", "the archive would lie within a source", archive)
        if not os.path.lexists(root):
            raise ArchiveError("IO_OPEN", "no such source", s)
    level = FAST if fast else LEVEL
    rows = entries(spark, *sources)
    # Ranges of whole members: the writer's parts then follow each other.
    rows = rows.repartitionByRange("seq").sortWithinPartitions("seq")
    columns = "seq", "action", "member_path", "abs_path", "mode", "uid", "gid", "mtime_ns", "size", "link"
    written = rows.select(*columns).mapInArrow(lambda it: _pieces(it, level), f"{ArchiveSink({}).schema()}, modified string, skipped string")
    with from_tasks():
        written.write.format("stowage_archive").mode("append").option("path", archive).option("hash_alg", hash_alg).save()


def listing_of(spark: SparkSession, archive: str, requested: list[str] | None = None, verbose: bool = False, human: bool = False) -> DataFrame:
    """``line`` of each member in order; of requested ones in the order of the requests, repeats included."""
    rows = members(spark, archive)
    line = F.col("path") if not verbose else listing.verbose_line(F.col("type"), F.col("size_original"), F.col("mode"), F.col("mtime_ns"), F.col("path"), human)
    if not requested:
        return rows.select("pos", line.alias("line")).orderBy("pos").select("line")
    wanted = spark.createDataFrame(list(enumerate(requested)), "request long, path string")
    absent = wanted.join(rows, "path", "left_anti").orderBy("request").first()
    if absent:
        raise ArchiveError("FMT_INDEX", "no such member", absent.path)
    return wanted.join(rows, "path").select("request", line.alias("line")).orderBy("request").select("line")


_CHECKED = "archive_id string, pos long, path string, chunk_index long, kind int, code string"


def _check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Errors of chunks in order: length and decoding by chunk, then the digest by member."""
    now, hasher, seen = None, None, 0
    for batch in batches:
        for row in batch.to_pylist():
            if (row["archive_id"], row["pos"]) != now:
                now, hasher, seen = (row["archive_id"], row["pos"]), fmt.HASHERS[row["hash_alg"]](), 0
            found = []
            if len(row["data"]) > codec.bound(fmt.CHUNK):
                found.append((0, "FMT_INDEX"))
            else:
                out, used, code = codec.decode(row["data"], row["size_expected"], strict=True)
                if code or used != len(row["data"]) or len(out) != row["size_expected"]:
                    found.append((0, "FMT_DATA"))
            hasher.update(row["data"])
            seen += 1
            if seen == row["chunk_count"] and hasher.digest() != row["hash"]:
                found.append((1, "HASH_MEMBER"))
            if found:
                yield pa.RecordBatch.from_pylist(
                    [{"archive_id": row["archive_id"], "pos": row["pos"], "path": row["path"], "chunk_index": row["chunk_index"], "kind": k, "code": c} for k, c in found],
                    pa.schema([("archive_id", pa.string()), ("pos", pa.int64()), ("path", pa.string()), ("chunk_index", pa.int64()), ("kind", pa.int32()), ("code", pa.string())]),
                )


def selected(spark: SparkSession, archive: str, requested: list[str] | None) -> set[int] | None:
    """Positions of requested members and of the files that requested hard links need."""
    if not requested:
        return None
    _, found = read_archive(archive)
    first: dict[str, int] = {}
    for pos, m in enumerate(found):
        first.setdefault(m.path, pos)
    out = set()
    for path in requested:
        if path not in first:
            raise ArchiveError("FMT_INDEX", "no such member", path)
        out.add(first[path])
        if found[first[path]].type == fmt.HARDLINK:
            out.add(first[found[first[path]].link])
    return out


def damage(spark: SparkSession, archive: str, requested: list[str] | None = None) -> DataFrame:
    """Every error in the data of the (requested) members; an index that is not valid raises its own."""
    ship(spark)
    only = selected(spark, archive, requested)
    rows = chunks(spark, archive)
    if only is not None:
        rows = rows.filter(F.col("pos").isin(*only))
    rows = rows.repartition("archive_id", "pos").sortWithinPartitions("archive_id", "pos", "chunk_index")
    return rows.mapInArrow(_check, _CHECKED)


def verify(spark: SparkSession, archive: str, requested: list[str] | None = None) -> None:
    """Raise the first error in archive order, however the work was dealt out."""
    with from_tasks():
        worst = damage(spark, archive, requested).agg(F.min(F.struct("pos", "chunk_index", "kind", "code", "path")).alias("e")).first().e
    if worst:
        raise ArchiveError(worst.code, "the data is damaged", worst.path, pos=worst.pos)


def conflicts(dest: str, chosen: list[str], selective: bool) -> list[str]:
    """All chosen paths that exist below ``dest`` and, if not all members are taken, folders above them that are none, in order."""
    there = [path for path in chosen if os.path.lexists(os.path.join(dest, path))]
    if not selective:
        return there
    parts = [path.split("/") for path in chosen]
    above = dict.fromkeys("/".join(names[:n]) for names in parts for n in range(1, len(names)))
    known = set(chosen)
    places = {path: os.path.join(dest, path) for path in above if path not in known}
    return there + [path for path, at in places.items() if os.path.lexists(at) and (os.path.islink(at) or not os.path.isdir(at))]


def extract(spark: SparkSession, archive: str, dest: str, requested: list[str] | None = None, overwrite: bool = False) -> None:
    """Create the members below ``dest`` in archive order; after a failure what was made is gone again.

    The tasks decode; the driver, which holds one partition's chunks at a time, creates.
    """
    ship(spark)
    _, found = read_archive(archive)
    only = selected(spark, archive, requested)
    chosen = [(pos, m) for pos, m in enumerate(found) if only is None or pos in only]
    verify(spark, archive, requested)
    sink = Extraction(dest, overwrite)
    if not overwrite:
        taken = conflicts(sink.dest, [m.path for _, m in chosen], only is not None)
        if taken:
            raise ArchiveError("IO_OPEN", f"{len(taken)} places are taken already", taken[0], paths=tuple(taken))

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                out, _, code = codec.decode(row["data"], row["size_expected"], strict=True)
                if code:
                    raise ArchiveError(code, "a chunk can't be decoded", row["path"])
                yield pa.RecordBatch.from_pylist([{"pos": row["pos"], "chunk_index": row["chunk_index"], "data": out}], pa.schema([("pos", pa.int64()), ("chunk_index", pa.int64()), ("data", pa.binary())]))

    rows = chunks(spark, archive)
    if only is not None:
        rows = rows.filter(F.col("pos").isin(*only))
    plain = iter(rows.mapInArrow(decoded, "pos long, chunk_index long, data binary").orderBy("pos", "chunk_index").toLocalIterator())
    ahead = next(plain, None)

    def pieces(pos: int) -> Iterator[bytes]:
        nonlocal ahead
        while ahead is not None and ahead.pos == pos:
            yield bytes(ahead.data)
            ahead = next(plain, None)

    try:
        with from_tasks():
            for pos, m in chosen:
                sink.create(m, pieces(pos))
        sink.finish()
    except BaseException:
        sink.undo()
        raise

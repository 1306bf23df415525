"""Archives as Spark data sources: members, chunks, and a writer that commits one file.

``stowage_members`` reads indexes only. ``stowage_chunks`` adds the chunks' bytes, read
by seeking, in partitions of about equal bytes, so many small members share a task and
a large one is spread over several. Both push filters on ``path`` and ``pos`` down.
Paths may be of any store that pyarrow opens; without a scheme they are local.
"""

from __future__ import annotations

import os
import sys
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession, types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from stowage.functions.errors import ArchiveError
from stowage.sources import format as fmt

MEMBERS = (
    "archive_id string, pos long, type int, mode long, uid long, gid long, mtime_ns long, size_original long, size_compressed long, "
    "data_offset long, hash binary, path string, link string, chunk_count long, chunk_sizes array<long>, hash_alg int"
)
CHUNKS = (
    "archive_id string, pos long, path string, chunk_index long, offset long, size_compressed long, size_expected long, "
    "chunk_count long, hash binary, hash_alg int, data binary"
)
#: Bytes of chunks that a partition reads, about.
SPLIT = 64 * 2**20
#: Bytes that the commit copies at once.
COPY = 16 * 2**20


def store(path: str) -> tuple[fs.FileSystem, str]:
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def read_archive(path: str) -> tuple[int, list[fmt.Member]]:
    """The digest algorithm and the members of an archive; no data is read."""
    system, name = store(path)
    try:
        with system.open_input_file(name) as f:
            size = f.size()
            algorithm = fmt.read_header(f.read_at(fmt.HEADER, 0) if size >= fmt.HEADER else f.read())
            if size < fmt.HEADER + fmt.FOOTER:
                raise ArchiveError("FMT_TRUNCATED", "too short for a header and a footer", path, 2)
            offset, length, index_hash, count = fmt.read_footer(f.read_at(fmt.FOOTER, size - fmt.FOOTER), size)
            return algorithm, fmt.read_index(f.read_at(length, offset), count, index_hash, algorithm, offset)
    except OSError as e:
        raise ArchiveError("IO_READ", str(e), path) from e


def _paths(options: dict[str, str]) -> list[str]:
    return [p for p in options.get("paths", options.get("path", "")).split("\n") if p]


@dataclass
class ArchivePart(InputPartition):
    archive: str
    first: int = 0
    last: int = -1
    ranges: tuple = ()
    algorithm: int = 0


class _Filtered(DataSourceReader):
    """Keeps equality filters on path and pos for itself."""

    def __init__(self, options: dict[str, str]) -> None:
        self.archives = _paths(options)
        self.split = int(options.get("split", SPLIT))
        self.only: dict[str, set] = {}

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute in (("path",), ("pos",)):
                self._narrow(f.attribute[0], {f.value})
            elif isinstance(f, In) and f.attribute in (("path",), ("pos",)):
                self._narrow(f.attribute[0], set(f.value))
            else:
                yield f

    def _narrow(self, name: str, values: set) -> None:
        self.only[name] = self.only.get(name, values) & values

    def wants(self, pos: int, path: str) -> bool:
        return pos in self.only.get("pos", {pos}) and path in self.only.get("path", {path})


class MembersReader(_Filtered):
    def partitions(self) -> list[InputPartition]:
        return [ArchivePart(a) for a in self.archives]

    def read(self, part: ArchivePart) -> Iterator[tuple]:
        algorithm, members = read_archive(part.archive)
        for pos, m in enumerate(members):
            if self.wants(pos, m.path):
                yield (
                    part.archive, pos, m.type, m.mode, m.uid, m.gid, m.mtime_ns, m.size_original, m.size_compressed, m.data_offset,
                    m.hash, m.path, m.link, len(m.chunk_sizes), m.chunk_sizes, algorithm,
                )


class ChunksReader(_Filtered):
    def partitions(self) -> list[InputPartition]:
        parts = []
        for archive in self.archives:
            algorithm, members = read_archive(archive)
            ranges, held = [], 0
            for pos, m in enumerate(members):
                if not self.wants(pos, m.path):
                    continue
                offset = m.data_offset
                for i, size in enumerate(m.chunk_sizes):
                    expected = min(fmt.CHUNK, m.size_original - i * fmt.CHUNK)
                    ranges.append((pos, m.path, i, offset, size, expected, len(m.chunk_sizes), m.hash))
                    offset += size
                    held += size
                    if held >= self.split:
                        parts.append(ArchivePart(archive, ranges=tuple(ranges), algorithm=algorithm))
                        ranges, held = [], 0
            if ranges:
                parts.append(ArchivePart(archive, ranges=tuple(ranges), algorithm=algorithm))
        return parts

    def read(self, part: ArchivePart) -> Iterator[tuple]:
        system, name = store(part.archive)
        with system.open_input_file(name) as f:
            for pos, path, i, offset, size, expected, count, hashed in part.ranges:
                data = f.read_at(size, offset)
                if len(data) != size:
                    raise ArchiveError("IO_READ", "the data ends too early", path)
                yield part.archive, pos, path, i, offset, size, expected, count, hashed, part.algorithm, data


class MembersSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_members"

    def schema(self) -> str:
        return MEMBERS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return MembersReader(self.options)


class ChunksSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_chunks"

    def schema(self) -> str:
        return CHUNKS

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return ChunksReader(self.options)


@dataclass
class Written(WriterCommitMessage):
    part: str
    first: tuple
    size: int
    modified: list[tuple[int, str]]
    skipped: list[tuple[int, str]]


class ArchiveWriter(DataSourceWriter):
    """Rows of members and chunks, in the order of (pos, chunk_index) within each task and no member in two tasks.

    A task leaves the body of its members as one file and their index entries, with digests and
    with offsets from the body's start, as another. The commit joins the bodies as they are,
    moves the offsets, and renames the finished file into place once it is on the disk. So the
    target is there whole or not at all, and a failed job leaves nothing.

    Rows may have two more columns. One with a path in ``skipped`` is no member, and the commit warns of
    it. Where any has a path in ``modified``, the commit fails and names them all.
    """

    def __init__(self, options: dict[str, str]) -> None:
        self.target = options["path"]
        self.algorithm = int(options.get("hash_alg", fmt.BLAKE3))
        self.parts = f"{self.target}.parts-{uuid.uuid4().hex}"
        system, name = store(self.parts)
        system.create_dir(name)

    def write(self, rows: Iterator[T.Row]) -> WriterCommitMessage:
        system, name = store(f"{self.parts}/{uuid.uuid4().hex}")
        first: tuple = ()
        held: list[dict] = []
        noticed: dict[str, list[tuple[int, str]]] = {"modified": [], "skipped": []}
        with system.open_output_stream(f"{name}.body") as body, system.open_output_stream(f"{name}.index") as index, pa.ipc.new_stream(index, _ENTRIES) as entries:

            def noted() -> Iterator[T.Row]:
                nonlocal first
                for row in rows:
                    which = next((k for k in noticed if k in row and row[k]), None)
                    if which:
                        noticed[which].append((row.pos, row[which]))
                        continue
                    first = first or (row.pos, row.chunk_index or 0)
                    yield row

            for member in lay(body, noted(), self.algorithm):
                held.append(asdict(member))
                if len(held) == 1000:
                    entries.write_batch(pa.RecordBatch.from_pylist(held, _ENTRIES))
                    held = []
            if held:
                entries.write_batch(pa.RecordBatch.from_pylist(held, _ENTRIES))
            size = body.tell()
        return Written(f"{self.parts}/{os.path.basename(name)}", first, size, **noticed)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        parts = sorted((m for m in messages if m and m.first), key=lambda m: m.first)
        for _, path in sorted(s for m in messages if m for s in m.skipped):
            print(f"skipped, on another device or a special file: {path}", file=sys.stderr)
        changed = tuple(path for _, path in sorted(s for m in messages if m for s in m.modified))
        try:
            if changed:
                raise ArchiveError("MODIFIED", "files changed while they were read", changed[0], paths=changed)
            with replacing(self.target) as out:
                out.write(fmt.header(self.algorithm))
                for m in parts:
                    system, name = store(m.part)
                    with system.open_input_stream(f"{name}.body") as body:
                        while piece := body.read(COPY):
                            out.write(piece)
                write_index(out, _moved(parts), fmt.HEADER + sum(m.size for m in parts), self.algorithm)
        finally:
            self._clear()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        system, name = store(self.parts)
        if system.get_file_info(name).type != fs.FileType.NotFound:
            system.delete_dir(name)


_ENTRIES = pa.schema([
    ("path", pa.string()), ("type", pa.int32()), ("mode", pa.int64()), ("uid", pa.int64()), ("gid", pa.int64()), ("mtime_ns", pa.int64()),
    ("size_original", pa.int64()), ("size_compressed", pa.int64()), ("data_offset", pa.int64()), ("hash", pa.binary()), ("link", pa.string()),
    ("chunk_sizes", pa.list_(pa.int64())),
])


def _moved(parts: list[Written]) -> Iterator[fmt.Member]:
    """The members of all parts in order, with offsets in the finished file."""
    at = fmt.HEADER
    for m in parts:
        system, name = store(m.part)
        with system.open_input_stream(f"{name}.index") as f, pa.ipc.open_stream(f) as stream:
            for batch in stream:
                for row in batch.to_pylist():
                    member = fmt.Member(**row)
                    if member.size_compressed:
                        member.data_offset += at
                    yield member
        at += m.size


@contextmanager
def replacing(path: str) -> Iterator[Any]:
    """A stream whose bytes take the place of a file when the block ends, and are gone if it fails."""
    system, name = store(path)
    temporary = f"{name}.tmp-{uuid.uuid4().hex}"
    local = isinstance(system, fs.LocalFileSystem)
    try:
        with open(temporary, "wb") if local else system.open_output_stream(temporary) as out:
            yield out
            if local:
                out.flush()
                os.fsync(out.fileno())
        system.move(temporary, name)
        if local:
            folder = os.open(os.path.dirname(name), os.O_RDONLY)
            try:
                os.fsync(folder)
            finally:
                os.close(folder)
    finally:
        if system.get_file_info(temporary).type != fs.FileType.NotFound:
            system.delete_file(temporary)


def lay(out: Any, rows: Iterator[Any], algorithm: int) -> Iterator[fmt.Member]:
    """Write the chunks of rows in order; the members, each when it is whole, with offsets from where ``out`` began."""
    at, last, member, hasher = 0, None, None, None
    empty = fmt.digest(algorithm, b"")
    for row in rows:
        if row["pos"] != last:
            if member is not None:
                member.hash = hasher.digest() if hasher else empty
                yield member
            last, hasher = row["pos"], None
            size = (row["size_original"] or 0) if row["type"] == fmt.FILE else 0
            member = fmt.Member(row["path"], row["type"], row["mode"], row["uid"], row["gid"], row["mtime_ns"], size, link=row["link"] or "")
            if size:
                member.data_offset, hasher = at, fmt.HASHERS[algorithm]()
        if row["data"] is not None and hasher is not None:
            data = bytes(row["data"])
            out.write(data)
            hasher.update(data)
            at += len(data)
            member.size_compressed += len(data)
            member.chunk_sizes.append(len(data))
    if member is not None:
        member.hash = hasher.digest() if hasher else empty
        yield member


def write_index(out: Any, members: Iterator[fmt.Member], at: int, algorithm: int) -> None:
    """The index that begins at ``at``, entry by entry, and the footer."""
    hasher, length, count = fmt.HASHERS[algorithm](), 0, 0
    for member in members:
        entry = fmt.entry(member)
        out.write(entry)
        hasher.update(entry)
        length, count = length + len(entry), count + 1
    out.write(fmt.footer(at, length, hasher.digest(), count))


class ArchiveSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stowage_archive"

    def schema(self) -> str:
        return "pos long, chunk_index long, type int, mode long, uid long, gid long, mtime_ns long, size_original long, path string, link string, data binary"

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return ArchiveWriter(self.options)


def register(spark: SparkSession) -> None:
    """Make the sources known to a session, with filters pushed down to them."""
    from stowage.sources.tree import TreeSource

    for source in (MembersSource, ChunksSource, ArchiveSink, TreeSource):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")

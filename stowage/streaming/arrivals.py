"""Archives that arrive in a folder, as a stream.

A stream of file names comes from Spark's own source of files; each micro-batch opens
the archives that are new and appends their members, or the errors that their indexes
have, to a table. What was read is in the stream's checkpoint, so every archive counts
once, after a restart too.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from stowage.functions.errors import ArchiveError
from stowage.session import ship
from stowage.sources.archive import read_archive

MEMBERS = "archive string, pos long, type int, path string, link string, size_original long, size_compressed long, hash binary, code string"


def _open(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("archive", pa.string()), ("pos", pa.int64()), ("type", pa.int32()), ("path", pa.string()), ("link", pa.string()), ("size_original", pa.int64()),
        ("size_compressed", pa.int64()), ("hash", pa.binary()), ("code", pa.string()),
    ])
    for batch in batches:
        for archive in batch.column(0).to_pylist():
            try:
                _, members = read_archive(archive.removeprefix("file://").removeprefix("file:"))
                rows = [
                    {"archive": archive, "pos": i, "type": m.type, "path": m.path, "link": m.link, "size_original": m.size_original, "size_compressed": m.size_compressed, "hash": m.hash, "code": None}
                    for i, m in enumerate(members)
                ]
            except ArchiveError as e:
                rows = [{"archive": archive, "pos": e.pos, "path": e.path, "code": e.code}]
            yield pa.RecordBatch.from_pylist(rows, schema)


def members(names: DataFrame) -> DataFrame:
    """Members of the archives whose names are in the first column; an invalid one gives a row with its code."""
    return names.mapInArrow(_open, MEMBERS)


def arrivals(spark: SparkSession, folder: str, pattern: str = "*.arc") -> DataFrame:
    """The stream of names of archives in a folder. Only names are read here: contents stay closed."""
    ship(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", pattern).load(folder)
    return files.select("path")


def append_members(spark: SparkSession, folder: str, table: str, checkpoint: str, pattern: str = "*.arc") -> StreamingQuery:
    """Append the members of archives that arrive to a Parquet table; reads what is there now and ends."""
    stream = members(arrivals(spark, folder, pattern))
    return stream.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest(table: DataFrame) -> DataFrame:
    """The newest row of each path, by archive name: what a reader of all archives would see."""
    return table.filter("code IS NULL").groupBy("path").agg(F.max_by(F.struct("archive", "pos", "type", "size_original"), "archive").alias("m")).select("path", "m.*")

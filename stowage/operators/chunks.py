"""Members cut into chunks, their places in the body, and digests over chunks in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from stowage.functions import blake3
from stowage.functions.binary import CHUNK, HEADER, expected_chunks, expected_length
from stowage.operators import order

HASHERS = {"sha256": hashlib.sha256, "blake3": blake3.Hasher}
#: Digests of many whole messages at once.
MANY = {"sha256": lambda messages: [hashlib.sha256(m).digest() for m in messages], "blake3": blake3.digests}


def cut(df: DataFrame, data: str, chunk: int = CHUNK) -> DataFrame:
    """One row for each chunk: the columns of ``df`` but the data, with ``chunk_index, n, chunk``. No data, no row."""
    size = F.octet_length(data).cast("long")
    index = F.explode(F.when(size > 0, F.sequence(F.lit(0).cast("long"), expected_chunks(size, chunk) - 1)))
    rows = df.withColumn("chunk_index", index)
    rows = rows.withColumn("n", expected_length(size, F.col("chunk_index"), chunk))
    at = (F.col("chunk_index") * chunk + 1).cast("int")
    return rows.withColumn("chunk", F.substring(F.col(data).cast("binary"), at, F.lit(chunk))).drop(data)


def chunk_offsets(chunks: DataFrame, key: str, start: str, size: str) -> DataFrame:
    """``offset`` of each chunk: its member's start and what comes before it."""
    before = Window.partitionBy(key).orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, -1)
    return chunks.withColumn("offset", F.col(start) + F.coalesce(F.sum(size).over(before), F.lit(0)))


def digest_members(chunks: DataFrame, key: str, data: str, algorithm: str = "sha256") -> DataFrame:
    """``key, digest`` of each member over its chunks in order.

    One batch is held at a time: members that begin and end in it are digested together, the one that may go on is
    a stream.
    """
    rows = chunks.select(key, "chunk_index", F.col(data).cast("binary").alias(data))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, hasher = None, None

        def done(keys: list, values: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, arrow_type(kind)), pa.array(values, pa.binary())], names=[key, "digest"])

        for batch in batches:
            names, pieces = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            starts = [i for i, k in enumerate(names) if i == 0 or k != names[i - 1]]
            keys, values, whole, messages = [], [], [], []
            for first, end in zip(starts, [*starts[1:], len(names)], strict=True):
                member = b"".join(pieces[first:end])
                if hasher is not None and names[first] != now:
                    keys.append(now)
                    values.append(hasher.digest())
                    hasher = None
                if hasher is None and end < len(names):
                    whole.append(names[first])
                    messages.append(member)
                    continue
                if hasher is None:
                    now, hasher = names[first], HASHERS[algorithm]()
                hasher.update(member)
            if keys or whole:
                yield done(keys + whole, values + MANY[algorithm](messages))
        if hasher is not None:
            yield done([now], [hasher.digest()])

    return rows.repartition(key).sortWithinPartitions(key, "chunk_index").mapInArrow(run, f"`{key}` {kind}, digest binary")


def digest_all(df: DataFrame, key: str, data: str, chunk: int = CHUNK, algorithm: str = "sha256") -> DataFrame:
    """``key, digest`` of every row's data; null and empty data have the digest of empty input."""
    full = digest_members(cut(df.select(key, data), data, chunk), key, "chunk", algorithm)
    empty = F.lit(HASHERS[algorithm]().digest())
    return full.union(df.filter(F.coalesce(F.octet_length(data), F.lit(0)) == 0).select(key, empty.alias("digest")))


def arrow_type(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def ranges(members: DataFrame) -> DataFrame:
    """Byte ranges of the members that have data: ``pos, start, end``."""
    full = members.filter("type = 1 AND size_original > 0")
    return full.select("pos", F.col("data_offset").alias("start"), (F.col("data_offset") + F.col("size_compressed")).alias("end"))


def consecutive(members: DataFrame) -> DataFrame:
    """The ranges in the order (start, larger end first), each with the ``last_end`` of the one before it."""
    return order.before(ranges(members), [F.col("start"), -F.col("end"), F.col("pos")], "end", "last_end")


def overlaps(rows: DataFrame) -> DataFrame:
    """Of ``consecutive`` ranges those that start before the one before them ends."""
    return rows.filter("start < last_end")


def gaps(rows: DataFrame, index_offset: int | None = None) -> DataFrame:
    """Places where the body of ``consecutive`` ranges does not go on: ``pos, expected, start``; the end is a row without a pos."""
    found = rows.select("pos", F.coalesce("last_end", F.lit(HEADER).cast("long")).alias("expected"), "start")
    if index_offset is not None:
        end = rows.agg(F.coalesce(F.max("end"), F.lit(HEADER).cast("long")).alias("expected"))
        found = found.union(end.select(F.lit(None).cast("long").alias("pos"), "expected", F.lit(index_offset).cast("long").alias("start")))
    return found.filter("start <> expected")

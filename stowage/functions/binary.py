"""Integers in bytes, checksums and size bounds."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, functions as F, types as T

CHUNK = 2**20
BEYOND = 2**64
HEADER, FOOTER, FIXED = 16, 64, 79
#: Bytes that ``adler32_native`` takes without a loop; beyond the most that their weighted sum is.
UNROLLED, BOTH = 32, 2**20


def big(value: Column) -> Column:
    """A column that holds any unsigned 64-bit integer."""
    return value.cast("decimal(20,0)")


def little_endian(data: Column, at: int, size: int) -> Column:
    """The unsigned integer of ``size`` bytes at offset ``at``: a long up to 4 bytes, else a decimal."""
    text = F.concat(*[F.hex(F.substring(data, at + i + 1, 1)) for i in reversed(range(size))])
    number = F.conv(text, 16, 10)
    return number.cast("long") if size <= 4 else big(number)


def checked_sum(a: Column, b: Column) -> Column:
    """The sum of unsigned 64-bit integers; null where it overflows."""
    total = a.cast("decimal(20,0)") + b.cast("decimal(20,0)")
    return F.when(total < F.lit(str(BEYOND)).cast("decimal(21,0)"), big(total))


def expected_chunks(size: Column, chunk: int = CHUNK) -> Column:
    return F.call_function("div", size + (chunk - 1), F.lit(chunk).cast("long"))


def expected_length(size: Column, index: Column, chunk: int = CHUNK) -> Column:
    """Bytes of a decoded chunk: whole ones, then what is left."""
    return F.least(F.lit(chunk).cast("long"), size - index * chunk)


def deflate_bound(size: Column) -> Column:
    """The most that raw Deflate makes of ``size`` bytes: stored blocks and the last byte."""
    blocks = F.greatest(F.lit(1), F.call_function("div", size + 65534, F.lit(65535).cast("long")))
    return size + blocks * 5 + 1


def zlib_bound(size: Column) -> Column:
    return deflate_bound(size) + 6


def zlib_header_ok(data: Column) -> Column:
    """Whether the first two bytes are a zlib header: Deflate, a window of at most 32 KiB, the check."""
    first, second = little_endian(data, 0, 1), little_endian(data, 1, 1)
    return F.coalesce((F.octet_length(data) >= 2) & (first % 16 == 8) & (first < 128) & ((first * 256 + second) % 31 == 0), F.lit(False))


def zlib_header(window_bits: int, level: int, dictionary: bool = False) -> bytes:
    """The two header bytes: window, level class, dictionary flag, and the check."""
    first = (window_bits - 8) << 4 | 8
    kind = 0 if level < 2 else 1 if level < 6 else 2 if level == 6 else 3
    second = kind << 6 | (32 if dictionary else 0)
    return bytes([first, second + (31 - (first * 256 + second) % 31) % 31])


@F.pandas_udf(T.LongType())
def adler32(data: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """The Adler-32 checksum of bytes, by batches."""
    for batch in data:
        yield batch.map(lambda b: None if b is None else zlib.adler32(b)).astype("Int64")


def adler32_native(data: Column) -> Column:
    """The same without Python, from its closed form; for short values.

    The first ``UNROLLED`` bytes are terms of one sum in generated code, of which each gives its byte to both sums
    at once; only what is longer takes lambdas, which Spark interprets.
    """
    size = F.octet_length(data).cast("long")
    # Latin-1 has the bytes as its code points. Beyond the end are empty texts, of value 0.
    text = F.decode(F.substring(data, 1, UNROLLED), "ISO-8859-1")
    term = lambda i: F.ascii(F.substring(text, i, 1)) * F.lit(BOTH + UNROLLED + 1 - i).cast("long")
    both = sum((term(i) for i in range(2, 9)), term(1))
    for at in range(8, UNROLLED, 8):
        more = sum((term(i) for i in range(at + 2, at + 9)), term(at + 1))
        both = both + F.when(size > at, more).otherwise(F.lit(0).cast("long"))
    first = F.shiftright(both, BOTH.bit_length() - 1)
    byte = lambda i: F.ascii(F.decode(F.substring(data, i, F.lit(1)), "ISO-8859-1")).cast("long")
    places = F.sequence(F.lit(UNROLLED + 1), F.octet_length(data))
    rest = lambda step: F.when(size > UNROLLED, F.aggregate(places, F.lit(0).cast("long"), step)).otherwise(F.lit(0).cast("long"))
    low = first + 1 + rest(lambda s, i: (s + byte(i)) % 65521)
    # Weights count from the last unrolled byte; the end of the value is so much further, or nearer.
    high = size + both % BOTH + first * (size - UNROLLED) + rest(lambda s, i: (s + (size - i + 1) * byte(i)) % 65521)
    return high % 65521 * 65536 + low % 65521


def index_entry_size(path: Column, link: Column, kind: Column, chunks: Column) -> Column:
    """Bytes that a member takes in the index."""
    tail = F.when(kind.isin(3, 4), F.octet_length(link) + 2).otherwise(F.lit(0))
    return (F.octet_length(path) + tail + chunks * 4 + FIXED + 4).cast("long")


def header_code(data: Column) -> Column:
    """The code of the first rule that a header breaks, or null."""
    byte = lambda i: little_endian(data, i, 1)
    # Magic, major version, flags, compression, digests, reserved bytes.
    return (
        F.when(F.octet_length(data) != HEADER, "FMT_TRUNCATED")
        .when(F.substring(data, 1, 5) != F.lit(b"ark!\n"), "FMT_MAGIC")
        .when(byte(5) != 1, "FMT_VERSION")
        .when(byte(7) != 0, "FMT_RESERVED")
        .when(byte(8) != 1, "FMT_COMP_ALG")
        .when(~byte(9).isin(1, 2), "FMT_HASH_ALG")
        .when(F.substring(data, 11, 6) != F.lit(bytes(6)), "FMT_RESERVED")
    )


def footer_code(data: Column) -> Column:
    """The code of the first rule that a footer breaks, or null."""
    return (
        F.when(F.octet_length(data) != FOOTER, "FMT_TRUNCATED")
        .when(little_endian(data, 52, 4) != 0x4B52410A, "FMT_MAGIC")
        .when(F.substring(data, 57, 8) != F.lit(bytes(8)), "FMT_RESERVED")
    )


def layout_code(file_size: Column, index_offset: Column, index_size: Column, members: Column) -> Column:
    """The code of the first bound that a footer's numbers break, or null."""
    end = index_offset.cast("decimal(20,0)") + index_size.cast("decimal(20,0)")
    return (
        F.when(file_size < HEADER + FOOTER, "FMT_TRUNCATED")
        .when(index_offset < HEADER, "FMT_INDEX")
        .when((index_size == 0) & (index_offset != HEADER), "FMT_INDEX")
        .when(end != file_size - FOOTER, "FMT_INDEX")
        .when(members > index_size / (FIXED + 5), "FMT_INDEX")
    )

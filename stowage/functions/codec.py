"""Deflate and zlib as Arrow functions, whole values and streams."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from stowage.functions.inflate_strict import long_form_258, may_hold_258

FLUSH = {"none": zlib.Z_NO_FLUSH, "sync": zlib.Z_SYNC_FLUSH, "finish": zlib.Z_FINISH}
DECODED = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("used", T.LongType()), T.StructField("code", T.StringType())])


def bound(size: int) -> int:
    """The most that raw Deflate of ``size`` bytes may take: stored blocks and the last byte."""
    return size + 5 * max(1, -(-size // 65535)) + 1


def stored(data: bytes) -> bytes:
    """Raw Deflate without compression, in the largest blocks there are."""
    out = []
    for at in range(0, max(1, len(data)), 65535):
        piece = data[at : at + 65535]
        size = len(piece)
        out.append(bytes([at + 65535 >= len(data)]) + size.to_bytes(2, "little") + (size ^ 0xFFFF).to_bytes(2, "little") + piece)
    return b"".join(out)


def _header(window_bits: int, flags: int) -> bytes:
    """The two bytes of a zlib header; ``flags`` are its three upper bits."""
    first = (window_bits - 8) << 4 | 8
    return bytes([first, flags << 5 | -(first << 8 | flags << 5) % 31])


def encode(data: bytes, level: int = 6, window_bits: int = 15, wrapped: bool = False, dictionary: bytes = b"") -> bytes:
    """One value as raw Deflate, or in the zlib wrapping.

    With 8 window bits zlib takes 9, but then looks back 250 bytes at most, so only the wrapping's header needs them.
    """
    bits = window_bits if wrapped else -max(9, window_bits)
    coder = zlib.compressobj(level, zlib.DEFLATED, bits, 8, zlib.Z_DEFAULT_STRATEGY, dictionary) if dictionary else zlib.compressobj(level, zlib.DEFLATED, bits)
    out = coder.compress(data) + coder.flush()
    if wrapped and window_bits == 8:
        out = _header(8, out[1] >> 5) + out[2:]
    # zlib's smaller blocks can pass the bound on data that doesn't compress.
    return stored(data) if not wrapped and not dictionary and len(out) > bound(len(data)) else out


def decode(data: bytes, limit: int | None = None, wrapped: bool = False, dictionary: bytes = b"", strict: bool = False) -> tuple[bytes, int, str | None]:
    """The decoded value, the bytes used of the input, and FMT_DATA if it is no whole, valid stream.

    With ``limit`` a stream that decodes to more bytes is an error, found without
    decoding all of it. A wrapped stream that asks for a dictionary is one too, if none
    is given. ``strict`` also refuses length 258 in its long form, which zlib lets pass; it
    walks over the stream in Python, so it is for streams under suspicion.
    """
    bits = 15 if wrapped else -15
    coder = zlib.decompressobj(bits, dictionary) if dictionary else zlib.decompressobj(bits)
    try:
        out = coder.decompress(data, limit + 1 if limit is not None else 0)
        if not coder.eof and limit is not None and len(out) <= limit:
            out += coder.decompress(coder.unconsumed_tail, 1)
    except zlib.error:
        return b"", 0, "FMT_DATA"
    used = len(data) - len(coder.unused_data)
    if not coder.eof or (limit is not None and len(out) > limit):
        return out, used, "FMT_DATA"
    if strict and (dictionary or may_hold_258(out)) and long_form_258(data[2 + 4 * bool(data[1] & 32) : used - 4] if wrapped else data[:used]):
        return b"", 0, "FMT_DATA"
    return out, used, None


def _binary(fn: Callable[[bytes], bytes]) -> Callable[[Column], Column]:
    @F.arrow_udf(T.BinaryType())
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            yield pa.array([None if v is None else fn(v) for v in values.to_pylist()], pa.binary())

    return run


def deflate(data: Column, level: int = 6, window_bits: int = 15) -> Column:
    """Raw Deflate of a binary column."""
    return _binary(lambda v: encode(v, level, window_bits))(data)


def zlib_encode(data: Column, level: int = 6) -> Column:
    return _binary(lambda v: encode(v, level, wrapped=True))(data)


def _decoder(limit: int | None, wrapped: bool, strict: bool) -> Callable[[Column], Column]:
    @F.arrow_udf(DECODED)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for values in batches:
            rows = [None if v is None else dict(zip(("data", "used", "code"), decode(v, limit, wrapped, strict=strict), strict=True)) for v in values.to_pylist()]
            yield pa.array(rows, pa.struct([("data", pa.binary()), ("used", pa.int64()), ("code", pa.string())]))

    return run


def inflate(data: Column, limit: int | None = None, strict: bool = True) -> Column:
    """``data, used, code`` of raw Deflate; at most ``limit`` bytes are decoded."""
    return _decoder(limit, False, strict)(data)


def zlib_decode(data: Column, limit: int | None = None, strict: bool = True) -> Column:
    return _decoder(limit, True, strict)(data)


class Encoder:
    """A stream: pieces go in, bytes come out, flushed as asked; ``reset`` begins anew, with history if given."""

    def __init__(self, level: int = 6, wrapped: bool = False, dictionary: bytes = b"") -> None:
        self.made = (level, wrapped)
        self.reset(dictionary)

    def reset(self, dictionary: bytes = b"") -> None:
        level, wrapped = self.made
        extra = (8, zlib.Z_DEFAULT_STRATEGY, dictionary) if dictionary else ()
        self.coder = zlib.compressobj(level, zlib.DEFLATED, 15 if wrapped else -15, *extra)

    def write(self, piece: bytes, flush: str = "none") -> bytes:
        out = self.coder.compress(piece)
        return out if flush == "none" else out + self.coder.flush(FLUSH[flush])


class Decoder:
    """The other way; an error stays, and ``limit`` bounds what one call puts out."""

    def __init__(self, wrapped: bool = False, dictionary: bytes = b"", window_bits: int = 15) -> None:
        self.made = (wrapped, window_bits)
        self.reset(dictionary)

    def reset(self, dictionary: bytes = b"") -> None:
        wrapped, bits = self.made
        bits = bits if wrapped else -bits
        self.coder = zlib.decompressobj(bits, dictionary) if dictionary else zlib.decompressobj(bits)
        self.failed = False

    def read(self, piece: bytes, limit: int = 0) -> bytes:
        if self.failed:
            raise zlib.error("the stream has failed before")
        try:
            return self.coder.decompress(self.coder.unconsumed_tail + piece, limit)
        except zlib.error:
            self.failed = True
            raise

    @property
    def ended(self) -> bool:
        return self.coder.eof

    @property
    def window(self) -> int:
        """Bytes that the decoder looks back, at most."""
        return 2 ** self.made[1]


def dictionary_id(data: bytes) -> int | None:
    """The Adler-32 of the dictionary that a zlib stream asks for, or None if it asks for none."""
    return int.from_bytes(data[2:6], "big") if len(data) >= 6 and data[1] & 32 else None


def _stream(df: DataFrame, key: str, order: str, data: str, make: Callable[[], object], step: Callable[[object, bytes, bool], bytes]) -> DataFrame:
    """Run one stream for each key over its pieces in order; every piece keeps its row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, coder = None, None
        held: pa.RecordBatch | None = None

        def work(batch: pa.RecordBatch, following: object) -> pa.RecordBatch:
            nonlocal now, coder
            keys, out = batch.column(0).to_pylist(), []
            for i, (k, piece) in enumerate(zip(keys, batch.column(2).to_pylist(), strict=True)):
                if coder is None or k != now:
                    now, coder = k, make()
                last = (keys[i + 1] if i + 1 < len(keys) else following) != k
                out.append(step(coder, piece or b"", last))
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], names=batch.schema.names)

        nothing = object()
        for batch in batches:
            if not batch.num_rows:
                continue
            if held is not None:
                yield work(held, batch.column(0)[0].as_py())
            held = batch
        if held is not None:
            yield work(held, nothing)

    rows = df.select(F.col(key), F.col(order), F.col(data).cast("binary").alias(data))
    return rows.repartition(key).sortWithinPartitions(key, order).mapInArrow(run, rows.schema)


def stream_encode(df: DataFrame, key: str, order: str, data: str, level: int = 6, wrapped: bool = False, flush: str = "sync") -> DataFrame:
    """One compressed stream for each key: each piece's row holds what the stream puts out for it.

    ``flush`` is what ends a piece; the last piece of a key ends the stream.
    """
    return _stream(df, key, order, data, lambda: Encoder(level, wrapped), lambda c, piece, last: c.write(piece, "finish" if last else flush))


def stream_decode(df: DataFrame, key: str, order: str, data: str, wrapped: bool = False) -> DataFrame:
    """The other way: rows of a stream in order, decoded one by one with the window kept between them."""
    return _stream(df, key, order, data, lambda: Decoder(wrapped), lambda c, piece, last: c.read(piece))

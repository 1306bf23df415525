import hashlib
import os
import re
import zlib

import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from stowage.functions import binary, blake3, codec, listing, paths
from stowage.functions.blake3 import Hasher, digests
from stowage.functions.inflate_strict import long_form_258, may_hold_258
from stowage.operators import chunks


def pattern(n):
    return bytes(i % 251 for i in range(n))


# Published digests of the pattern above by length, the first eight bytes.
BLAKE3 = {0: "af1349b9f5f9a1a6", 1024: "42214739f095a406", 1025: "d00278ae47eb27b3", 102400: "bc3e3d41a1146b06"}


@pytest.mark.parametrize("size", BLAKE3)
def test_blake3_vectors(size):
    assert digests([pattern(size)])[0].hex().startswith(BLAKE3[size])


@given(st.lists(st.integers(0, 5000), min_size=1, max_size=5), st.integers(1, 3000))
@settings(max_examples=25, deadline=None)
def test_blake3_pieces_and_batches_agree(sizes, step):
    messages = [pattern(n) for n in sizes]
    for m, d in zip(messages, digests(messages), strict=True):
        h = Hasher()
        for i in range(0, len(m), step):
            h.update(m[i : i + step])
        assert h.digest() == d


@pytest.mark.parametrize("size", [256 * 1024, 256 * 1024 + 1, 700_001, 1_048_577])
def test_blake3_long_streams(size):
    h = Hasher()
    for i in range(0, size, 100_003):
        h.update(pattern(size)[i : i + 100_003])
    assert h.digest() == digests([pattern(size)])[0]


@given(st.binary(max_size=5000), st.integers(0, 9))
@settings(max_examples=50, deadline=None)
def test_deflate_round_trip_within_bound(data, level):
    packed = codec.encode(data, level)
    assert codec.decode(packed) == (data, len(packed), None)
    assert len(packed) <= codec.bound(len(data))
    assert codec.decode(codec.stored(data)) == (data, len(codec.stored(data)), None)


@given(st.binary(min_size=1, max_size=300))
@settings(max_examples=50, deadline=None)
def test_decoder_refuses_damage(data):
    packed = codec.encode(data)
    assert codec.decode(packed[:-1])[2] == "FMT_DATA"
    assert codec.decode(packed + b"x")[1] == len(packed)
    assert codec.decode(packed, limit=len(data) - 1)[2] == "FMT_DATA"


def _fixed_block(symbols):
    """A final block in the fixed code of literals, and (284, 31, distance 1) as length 258 in its long form."""
    bits = "1" + "10"
    for s in symbols:
        if s == "long":
            bits += format(0b11000000 + 284 - 280, "08b") + "11111" + "00000"
        elif s == "end":
            bits += "0000000"
        else:
            bits += format(0b00110000 + s, "08b")
    bits += "0" * (-len(bits) % 8)
    return bytes(int(bits[i : i + 8][::-1], 2) for i in range(0, len(bits), 8))


def test_long_form_of_length_258():
    stream = _fixed_block([97, "long", "end"])
    assert len(zlib.decompress(stream, -15)) == 259
    assert long_form_258(stream)
    assert codec.decode(stream)[2] is None
    assert codec.decode(stream, strict=True)[2] == "FMT_DATA"
    assert not long_form_258(codec.encode(b"a" * 10_000 + pattern(5000)))


def test_streams_keep_their_window_and_flush():
    out, back = codec.Encoder(), codec.Decoder()
    pieces = [b"hello " * 50, b"", b"hello again " * 20]
    packed = [out.write(p, "sync") for p in pieces[:-1]] + [out.write(pieces[-1], "finish")]
    assert [back.read(p) for p in packed] == pieces and back.ended
    assert len(packed[2]) < len(codec.encode(pieces[2], 1)) + 20


def test_streams_with_dictionary_and_reset():
    words = b"the quick brown fox"
    out, back = codec.Encoder(dictionary=words), codec.Decoder(dictionary=words)
    assert back.read(out.write(words, "finish")) == words
    out.reset()
    back.reset()
    assert back.read(out.write(b"x", "finish")) == b"x"


def test_stream_errors_stay():
    back = codec.Decoder()
    with pytest.raises(zlib.error):
        back.read(b"\xff" * 10)
    with pytest.raises(zlib.error):
        back.read(codec.encode(b"fine"))


def test_zlib_header():
    for bits in range(8, 16):
        for level in range(10):
            head = binary.zlib_header(bits, level)
            assert int.from_bytes(head, "big") % 31 == 0 and head[0] & 15 == 8
    assert binary.zlib_header(15, 6) == zlib.compress(b"", 6)[:2]


def test_path_codes(spark):
    cases = [
        (b"", "FMT_INDEX"), (b"a/b", None), (b"/a", "PATH_ABSOLUTE"), (b"a/", "FMT_INDEX"), (b"a//b", "FMT_INDEX"), (b"./a", "FMT_INDEX"),
        (b"a/../b", "PATH_TRAVERSAL"), (b"a/./../b", "FMT_INDEX"), (b"a\0b", "FMT_INDEX"), (b"\xc0\x80", "PATH_ENCODING"), (b"\xed\xa0\x80", "PATH_ENCODING"),
        (b"\xf4\x90\x80\x80", "PATH_ENCODING"), (b"x" * 1023, None), (b"x" * 1024, "PATH_TOO_LONG"), (b"..", "PATH_TRAVERSAL"), ("é".encode(), None), (b"a/..b", None),
    ]
    rows = spark.createDataFrame([(i, p) for i, (p, _) in enumerate(cases)], "i int, p binary")
    got = {r.i: (r.m, r.s, r.h) for r in rows.select("i", paths.member_path_code(F.col("p")).alias("m"), paths.symlink_target_code(F.col("p")).alias("s"), paths.hardlink_target_code(F.col("p")).alias("h")).collect()}
    from stowage.sources.format import path_code, target_code

    for i, (p, want) in enumerate(cases):
        assert got[i][0] == want == path_code(p), p
        assert got[i][1] == target_code(p), p
        assert got[i][2] == ("FMT_INDEX" if len(p) > 1023 else want), p


def test_sizes_and_times(spark):
    sizes = {0: "0B", 1023: "1023B", 1024: "1.0KB", 1075: "1.0KB", 1076: "1.1KB", 1024 * 1024 - 1: "1024.0KB", 2**20: "1.0MB", 5 * 2**30: "5.0GB", 2**42: "4096.0GB"}
    rows = spark.createDataFrame([(n,) for n in sizes], "n long").select("n", listing.human_size(F.col("n")).alias("h")).collect()
    assert {r.n: r.h for r in rows} == sizes
    times = {0: "1970-01-01T00:00:00Z", -1: "1969-12-31T23:59:59Z", 1_500_000_000: "1970-01-01T00:00:01Z", -1_500_000_000: "1969-12-31T23:59:58Z"}
    rows = spark.createDataFrame([(n,) for n in times], "n long").select("n", listing.human_time(F.col("n")).alias("h"), listing.mtime_nanos(F.col("n")).alias("ns")).collect()
    assert {r.n: r.h for r in rows} == times
    assert {r.n: r.ns for r in rows} == {n: n % 10**9 for n in times}
    row = spark.range(1).select(listing.encode_mtime(F.lit(16_725_225_600), F.lit(0)).alias("late"), listing.encode_mtime(F.lit(-1), F.lit(5)).alias("early")).first()
    assert row.late is None and row.early == -999_999_995


def test_checksums(spark):
    data = [b"", b"a", b"abc", b"Wikipedia", b"\xff" * 5552, b"\xff" * 5553]
    rows = spark.createDataFrame([(i, d) for i, d in enumerate(data)], "i int, d binary")
    got = rows.select("i", binary.adler32("d").alias("a"), binary.adler32_native(F.col("d")).alias("b")).collect()
    assert all(r.a == r.b == zlib.adler32(data[r.i]) for r in got)


def test_chunk_bounds(spark):
    sizes = [0, 1, 2**20, 2**20 + 1, 2**21]
    rows = spark.createDataFrame([(i, pattern(n)) for i, n in enumerate(sizes)], "i long, d binary")
    cut = chunks.cut(rows, "d")
    got = sorted((r.i, r.chunk_index, r.n) for r in cut.select("i", "chunk_index", "n").collect())
    assert got == [(1, 0, 1), (2, 0, 2**20), (3, 0, 2**20), (3, 1, 1), (4, 0, 2**20), (4, 1, 2**20)]
    for name, whole in (("sha256", lambda b: hashlib.sha256(b).digest()), ("blake3", lambda b: digests([b])[0])):
        found = {r.i: bytes(r.digest) for r in chunks.digest_members(cut, "i", "chunk", name).collect()}
        assert found == {i: whole(pattern(n)) for i, n in enumerate(sizes) if n}


def test_unsigned_arithmetic(spark):
    row = spark.sql("SELECT unhex('FFFFFFFFFFFFFFFF') AS b").select(
        binary.little_endian(F.col("b"), 0, 8).alias("n"), binary.checked_sum(binary.little_endian(F.col("b"), 0, 8), F.lit(1)).alias("over"), binary.checked_sum(F.lit(2**62), F.lit(2**62)).alias("fine"),
    ).first()
    assert int(row.n) == 2**64 - 1 and row.over is None and int(row.fine) == 2**63


def test_small_windows_look_back_no_further():
    data = pattern(3000) * 3
    for level in (1, 6, 9):
        assert zlib.decompressobj(-8).decompress(codec.encode(data, level, 8)) == data
        wrapped = codec.encode(data, level, 8, wrapped=True)
        assert wrapped[0] >> 4 == 0 and zlib.decompressobj(8).decompress(wrapped) == data
    assert codec.Decoder(window_bits=9).window == 512


def test_only_streams_that_may_hold_it_are_walked():
    long = _fixed_block([97, "long", "end"])
    assert may_hold_258(zlib.decompress(long, -15)) and not may_hold_258(pattern(200))
    filler = codec.Encoder()
    start = filler.write(bytes(range(256)) * 3, "sync")
    assert codec.decode(start + long, strict=True)[2] == "FMT_DATA" and codec.decode(start + long)[2] is None
    assert codec.decode(codec.encode(b"ab" * 5000), strict=True)[2] is None


def test_dictionary_id():
    words = b"some words of a dictionary"
    assert codec.dictionary_id(codec.encode(b"some words", wrapped=True, dictionary=words)) == zlib.adler32(words)
    assert codec.dictionary_id(codec.encode(b"some words", wrapped=True)) is None


@pytest.mark.parametrize("algorithm", ["sha256", "blake3"])
def test_members_over_batches_in_any_cut(spark, monkeypatch, algorithm):
    members = {k: os.urandom(n) for k, n in enumerate([1, 9000, 0, 64, 40_000, 1024, 1025, 300_000, 3])}
    rows = [(k, i, m[i * 4096 : (i + 1) * 4096]) for k, m in members.items() for i in range(max(1, -(-len(m) // 4096)))]
    run = _captured(spark, monkeypatch, algorithm)
    whole = hashlib.sha256 if algorithm == "sha256" else None
    want = {k: whole(m).digest() if whole else digests([m])[0] for k, m in members.items()}
    for size in (1, 2, 3, 7, len(rows)):
        found = [r for b in run(_batches(rows, size)) for r in b.to_pylist()]
        assert len(found) == len(want)
        assert {r["k"]: r["digest"] for r in found} == want


def test_blake3_members_of_a_batch_go_through_the_rounds_together(spark, monkeypatch):
    run = _captured(spark, monkeypatch, "blake3")
    calls, real = [], blake3.compress
    monkeypatch.setattr(blake3, "compress", lambda *a: calls.append(1) or real(*a))
    rows = [(k, 0, bytes([k % 251]) * (k + 1)) for k in range(400)]
    assert len([r for b in run(_batches(rows, 400)) for r in b.to_pylist()]) == 400
    # 16 blocks of a chunk for all members at once, as many for the last member, which may go on.
    assert len(calls) <= 32


def _captured(spark, monkeypatch, algorithm):
    """What ``digest_members`` runs on the batches of a task."""
    df, found = spark.createDataFrame([(1, 0, b"")], "k long, chunk_index long, d binary"), []
    with monkeypatch.context() as m:
        m.setattr(type(df), "mapInArrow", lambda self, fn, schema: found.append(fn))
        chunks.digest_members(df, "k", "d", algorithm)
    return found[0]


def _batches(rows, size):
    schema = pa.schema([("k", pa.int64()), ("chunk_index", pa.int64()), ("d", pa.binary())])
    for at in range(0, len(rows), size):
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[at : at + size]], schema)


def test_native_adler_loops_only_over_long_values(spark):
    data = [os.urandom(n) for n in range(70)] + [b"\xff" * n for n in range(70)] + [bytes(40), "\u00e9\u6f22|1".encode(), None]
    rows = spark.createDataFrame(list(enumerate(data)), "i int, d binary").select("i", binary.adler32_native(F.col("d")).alias("a"))
    assert {r.i: r.a for r in rows.collect()} == {i: None if d is None else zlib.adler32(d) for i, d in enumerate(data)}
    # Spark interprets these loops; each must be behind a question for the length.
    plan = rows._jdf.queryExecution().analyzed().toString()
    before = [plan[: m.start()] for m in re.finditer(r"\baggregate\(", plan)]
    assert before and all(re.search(r"octet_length\(d#\d+\)[^W]* > [^W]*32[^W]* THEN $", x) for x in before)

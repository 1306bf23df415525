"""Packing along a space-filling curve.

Documents become token ids. A document's ids are counted into a hashed vector, the
vector is projected to three dimensions by fixed random directions, and the point's
place on a Hilbert curve is the document's key. The documents are range-sorted by key
and packed in that order, so that a sequence holds documents that resemble each other.

Cuts are free, so each sorted range fills its sequences of 2,048 ids without a gap. Its
last ids, fewer than 2,048, go to sequences whose lengths are powers of two, which need
no padding. A range depends on no other range; a task holds one sequence at a time.

The range bounds come from (key, doc_id, row number), so that copies, which share one
key, spread over ranges.

Cases: a null or empty text has the single closing id; a null doc_id stays null; rows
with the same doc_id are packed each; an empty input gives an empty result. Other
columns of the input are not returned.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from stowage.llm.workers import give_back, kept, tidy
from stowage.session import materialize, shuffle_width, small_batches

LENGTH = 2048
CLOSING = 1
HASHED, DIMS, BITS = 256, 3, 10
#: Words whose ids a worker keeps, and the longest of them in bytes.
KEPT_WORDS, KEPT_BYTES = 600_000, 64
#: Documents whose vectors are made at once, documents laid at once, and bytes of ids in a range, about.
AT_ONCE, LAID, RANGE_BYTES = 1024, 256, 64 * 2**20

# The parts of a tokenizers file that encoding by words relies on.
BY_WORDS = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ]},
}
SUFFIX = "</w>"

#: Bytes of a text of Latin letters, digits, full stops and commas, and what must not be in it besides.
_PLAIN = b"abcdefghijklmnopqrstuvwxyz0123456789., \t\n\r\xc3" + bytes(range(0x80, 0xC0))
_PAIRS = (b"..", b".,", b",.", b",,", b"\xc3\x97", b"\xc3\xb7")
#: Marks that end a word of Latin letters.
_TAIL = re.compile(rb"([a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])([.,;:!?|]+)(?=[\x20\x09-\x0d]|$)")


def _parts(text: bytes) -> list[bytes]:
    """The text cut at white space and before marks that end a word."""
    if not text.translate(None, _PLAIN) and not any(pair in text for pair in _PAIRS):
        # Only letters, digits and single marks: each mark stands alone.
        return text.replace(b".", b" . ").replace(b",", b" , ").split()
    return _TAIL.sub(rb"\1 \2", text).split()


class WordEncoder:
    """Ids of texts by way of their words.

    Where the tokenizer's own pattern never joins characters across white space, nor a
    letter with a mark after it, a text's ids are the ids of such parts in order; each part
    is encoded once and then kept, in two generations of bounded size. A tokenizer of
    another make gets whole texts.
    """

    def __init__(self, model: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_str(model)
        made = json.loads(model)
        self.by_words = all(made[part] == known for part, known in BY_WORDS.items()) and made["model"].get("end_of_word_suffix") == SUFFIX
        vocabulary = self.model.get_vocab(True)
        most = max(vocabulary.values())
        self.width = np.dtype("<u2" if most < 2**16 else "<u4")
        self.ends = np.zeros(most + 1, bool)
        self.ends[[i for word, i in vocabulary.items() if word.endswith(SUFFIX)]] = True
        self.kept: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _alone(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, self.width).tobytes() for e in self.model.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of new words: words of letters many at once, told apart by the ids that end a word."""
        found: dict[bytes, bytes] = {}
        plain = [w for w in words if w.isalpha()]
        other = [w for w in words if not w.isalpha()]
        wide = [w for w in other if w.decode("utf-8", "replace").isalpha()]
        alone = set(other).difference(wide)
        plain += wide
        for at in range(0, len(plain), 500):
            some = plain[at : at + 500]
            ids = np.frombuffer(self._alone([b" ".join(some).decode("utf-8", "replace")])[0], self.width)
            ends = ((np.flatnonzero(self.ends[ids]) + 1) * self.width.itemsize).tolist()
            if len(ends) != len(some):
                alone.update(some)
                continue
            joined = ids.tobytes()
            found.update(zip(some, [joined[a:b] for a, b in zip([0, *ends], ends, strict=False)], strict=True))
        rest = list(alone)
        found.update(zip(rest, self._alone([w.decode("utf-8", "replace") for w in rest]), strict=True))
        return found

    def ids(self, texts: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return self._alone([t.decode("utf-8", "replace") for t in texts])
        # A special token's string is special only as it stands: such texts are not lowered.
        split = [_parts(t if b"<|" in t else t.lower()) for t in texts]
        # The words of these texts get a table of their own, which the processor's caches hold.
        words = list(set().union(*split))
        here = dict(zip(words, map(self.kept.get, words), strict=True))
        unknown = [w for w, ids in here.items() if ids is None]
        again = {w: self.old[w] for w in unknown if w in self.old}
        new = self._encode([w for w in unknown if w not in again])
        here |= again | new
        self.kept |= again
        self.kept.update((w, ids) for w, ids in new.items() if len(w) <= KEPT_BYTES)
        if len(self.kept) > KEPT_WORDS:
            self.old, self.kept = self.kept, {}
        return [b"".join(map(here.__getitem__, parts)) for parts in split]


def directions() -> np.ndarray:
    return np.random.default_rng(7).standard_normal((HASHED, DIMS))


def vectors(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Unit vectors of hashed id counts, damped by a logarithm, one for each document."""
    cell = ((ids.astype(np.uint32) * np.uint32(2654435769)) >> np.uint32(24)).astype(np.int64)
    owner = np.repeat(np.arange(len(lengths)), lengths)
    counts = np.log1p(np.bincount(owner * HASHED + cell, minlength=HASHED * len(lengths)).reshape(-1, HASHED))
    return counts / np.maximum(np.linalg.norm(counts, axis=1, keepdims=True), 1e-12)


def hilbert_keys(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Places on the Hilbert curve of integer points (rows), by rotating from the top bit down."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, low = 1 << shift, (1 << shift) - 1
        for d in range(dims):
            on = (x[d] & bit) != 0
            swap = np.where(on, 0, (x[0] ^ x[d]) & low)
            x[0] ^= np.where(on, low, swap)
            x[d] ^= swap
    for d in range(1, dims):
        x[d] ^= x[d - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where((x[-1] >> shift) & 1, (1 << shift) - 1, 0)
    x ^= flip
    key = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for d in range(dims):
            key = (key << 1) | ((x[d] >> shift) & 1)
    return key


def curve_keys(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    place = (vectors(ids, lengths) @ directions() + 2.5) / 5.0
    return hilbert_keys(np.clip(place * (1 << BITS), 0, (1 << BITS) - 1))


def tokenize(docs: DataFrame, model: str) -> DataFrame:
    """``doc_id, n, key, ids`` of documents; ids are little-endian, two bytes where the vocabulary allows."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = kept(shared.value, lambda: WordEncoder(shared.value))
        yield from encoded(encoder, batches)
        give_back()

    def encoded(encoder: WordEncoder, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        closing = np.array([CLOSING], encoder.width).tobytes()
        for whole in batches:
            for at in range(0, whole.num_rows, AT_ONCE):
                batch = whole.slice(at, AT_ONCE)
                ids = [x + closing for x in encoder.ids([t or b"" for t in batch.column(1).cast(pa.binary()).to_pylist()])]
                lengths = np.array([len(x) // encoder.width.itemsize for x in ids], np.int64)
                keys = curve_keys(np.frombuffer(b"".join(ids), encoder.width), lengths)
                yield pa.record_batch({"doc_id": batch.column(0), "n": lengths, "key": keys, "ids": pa.array(ids, pa.binary())})

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, n long, key long, ids binary")


def _pieces(length: int, rows: Iterator[tuple], first_id: int) -> Iterator[tuple]:
    """Rows (doc_id, n, ids) in order, cut into pieces (doc_id, start, ids, n, sequence, offset)."""
    waiting: list[tuple] = []
    filled, sequence = 0, first_id
    for doc, n, ids in rows:
        start = 0
        while start < n:
            take = min(length - filled, n - start)
            waiting.append((doc, start, ids[start : start + take], n))
            filled += take
            start += take
            if filled == length:
                yield from _laid(waiting, sequence)
                waiting, filled, sequence = [], 0, sequence + 1
    while filled:
        room = 1 << (filled.bit_length() - 1)
        head, rest, have = [], [], 0
        for doc, start, ids, n in waiting:
            take = min(len(ids), room - have)
            if take:
                head.append((doc, start, ids[:take], n))
            if take < len(ids):
                rest.append((doc, start + take, ids[take:], n))
            have += take
        yield from _laid(head, sequence)
        waiting, filled, sequence = rest, filled - room, sequence + 1


def _laid(waiting: list[tuple], sequence: int) -> Iterator[tuple]:
    offset = 0
    for doc, start, ids, n in waiting:
        yield doc, start, ids, n, sequence, offset
        offset += len(ids)


def pack(docs: DataFrame, tokenizer: str, length: int = LENGTH, with_ids: bool = True) -> DataFrame:
    """Pieces of documents in sequences; ``tokenizer`` is the path of a tokenizers file.

    A row is a piece: doc_id, start (ids of its document before it), length, ids_crc32,
    doc_tokens, sequence_id, offset, key, and ``ids`` if asked for.
    """
    if length & (length - 1):
        raise ValueError("the length of a sequence must be a power of two")
    with open(tokenizer, encoding="utf-8") as f:
        model = f.read()
    tokens = tokenize(docs, model).withColumn("row", F.monotonically_increasing_id())
    tokens = materialize(tokens, "tokens", "snappy")
    spark = docs.sparkSession
    ranges = max(shuffle_width(spark), -(-2 * (tokens.agg(F.sum("n")).first()[0] or 0) // RANGE_BYTES))

    @tidy
    def lay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_id = TaskContext.get().partitionId() << 32

        def rows() -> Iterator[tuple]:
            for batch in batches:
                for at in range(0, batch.num_rows, LAID):
                    for doc, n, ids in zip(*(column.to_pylist() for column in batch.slice(at, LAID).columns), strict=True):
                        yield doc, n, np.frombuffer(ids, "<u2" if len(ids) == 2 * n else "<u4")

        out: list[tuple] = []
        for piece in _pieces(length, rows(), first_id):
            out.append(piece)
            if len(out) == 2000:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        doc, start, ids, n, sequence, offset = zip(*out, strict=True)
        wide = [x.astype("<u4") for x in ids]
        columns = {
            "doc_id": pa.array(doc, pa.int64()), "start": pa.array(start, pa.int64()), "length": pa.array(map(len, ids), pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(x) for x in wide], pa.int64()), "doc_tokens": pa.array(n, pa.int64()),
            "sequence_id": pa.array(sequence, pa.int64()), "offset": pa.array(offset, pa.int64()),
        }
        if with_ids:
            columns["ids"] = pa.array([x.astype("<i4") for x in wide], pa.list_(pa.int32()))
        return pa.record_batch(columns)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    order = ["key", "doc_id", "row"]
    return tokens.repartitionByRange(ranges, *order).sortWithinPartitions(*order).select("doc_id", "n", "ids").mapInArrow(lay, schema)


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 2,048 ids."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=False)

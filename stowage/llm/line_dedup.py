"""Line dedup by a sharded minimal perfect hash.

A line's key is the line stripped of ASCII white space and with A-Z lower-cased; keys
of at least ten code points count. A line is dropped from every document but the one
with the smallest doc_id that holds its key.

1. Each task folds its documents' keys into 128-bit hashes with the smallest doc_id
   and the number of documents, so that a line found everywhere leaves a task once.
2. The hashes are dealt to shards. Each shard builds a minimal perfect hash over its
   distinct hashes (levels of bit arrays: a hash that is alone at its place in one
   level is settled there, the others go on to the next) and, in its order, arrays of
   32-bit fingerprints and counts, and the smallest doc_ids of the lines that count twice
   or more. That is about 9 bytes a line, and 8 more for a repeated one. The number of
   shards follows the number of lines, so that a shard holds SHARD_KEYS of them.
3. Documents send hashes, not lines, to the shards, which answer from the arrays: a line
   counted once stays, another goes unless the document is its smallest. Only what is to
   be dropped comes back. Lines that hold more than 1/20,000 of all line
   occurrences would overload their shard; there are at most 20,000 of them, and the
   documents look these up in a table of that bounded size that every task has.
4. The documents meet their drops by doc_id and are rewritten.

Cases: a null doc_id ranks after every other and stands for one document; a null text
is one empty line; rows with the same doc_id are one document; documents keep a row
when all of their lines go; an empty input gives an empty result. Other columns pass
through; columns of the input that are named like the two counts are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from stowage.llm.workers import texts, tidy
from stowage.session import discard, materialize, shuffle_width, small_batches

SPACE = b" \t\n\x0b\x0c\r"
LEAST = 10
NO_ID = 2**63 - 1
#: Keys that a task folds before it passes them on, and folded keys in a shard, about.
FOLD, SHARD_KEYS = 200_000, 250_000
#: A heavy line holds at least 1/HEAVY_SHARE of all occurrences, and at least HEAVY_LEAST.
HEAVY_SHARE, HEAVY_LEAST = 20_000, 1_000

_U = np.uint64
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("first_doc", pa.int64()), ("n", pa.int64())])
_SHARD = (
    "shard long, n_keys long, n_lines long, sizes array<long>, bits binary, fingerprints binary, counts binary, first_docs binary, "
    "heavy array<struct<h1: long, h2: long, first_doc: long, n: long>>"
)


def line_hash(line: bytes, least: int = LEAST) -> bytes | None:
    """The 128-bit hash of a line's key, or None if the key is too short to count."""
    key = line.strip(SPACE).lower()
    if len(key) < least or (len(key) < 4 * least and len(key.decode("utf-8", "replace")) < least):
        return None
    return xxhash.xxh3_128_digest(key)


def _scramble(h1: np.ndarray, h2: np.ndarray, level: int) -> np.ndarray:
    x = h1 ^ (h2 * _U(0x9E3779B97F4A7C15 + 2 * level) + _U(level))
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    x = (x ^ (x >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def build_index(h1: np.ndarray, h2: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Sizes and bits of the levels of a minimal perfect hash over distinct 128-bit keys."""
    sizes: list[int] = []
    words: list[np.ndarray] = []
    left = np.arange(len(h1))
    while len(left):
        if len(sizes) == 200:
            raise ValueError("keys are not distinct")
        size = (int(1.5 * len(left)) // 64 + 1) * 64
        at = (_scramble(h1[left], h2[left], len(sizes)) % _U(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        words.append(np.packbits(alone, bitorder="little").view(np.uint64))
        sizes.append(size)
        left = left[~alone[at]]
    return sizes, np.concatenate(words) if words else np.zeros(0, np.uint64)


def probe_index(sizes: list[int], words: np.ndarray, h1: np.ndarray, h2: np.ndarray) -> np.ndarray:
    """The place of each key, or -1 where no level has it."""
    ones = np.bitwise_count(words).astype(np.int64)
    before = np.cumsum(ones) - ones
    found = np.full(len(h1), -1, np.int64)
    left, base = np.arange(len(h1)), 0
    for level, size in enumerate(sizes):
        if not len(left):
            break
        at = _scramble(h1[left], h2[left], level) % _U(size)
        word, bit = base + (at >> _U(6)).astype(np.int64), at & _U(63)
        here = (words[word] >> bit) & _U(1) == 1
        low = words[word[here]] & ((_U(1) << bit[here]) - _U(1))
        found[left[here]] = before[word[here]] + np.bitwise_count(low).astype(np.int64)
        left = left[~here]
        base += size // 64
    return found


def _split(digests: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _rows(batch: pa.RecordBatch, id_col: str, text_col: str) -> Iterator[tuple[int, bytes]]:
    ids = batch.column(batch.schema.get_field_index(id_col)).to_pylist()
    for doc, text in zip(ids, texts(batch, text_col), strict=True):
        yield (NO_ID if doc is None else doc), text


@tidy
def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first: dict[bytes, int] = {}
    count: dict[bytes, int] = {}

    def flush() -> pa.RecordBatch:
        h1, h2 = _split(list(first))
        out = pa.record_batch([pa.array(h1), pa.array(h2), pa.array(list(first.values()), pa.int64()), pa.array(list(count.values()), pa.int64())], schema=_KEYS)
        first.clear()
        count.clear()
        return out

    for batch in batches:
        for doc, text in _rows(batch, "doc_id", "text"):
            for h in {line_hash(line) for line in text.split(b"\n")} - {None}:
                if h in first:
                    count[h] += 1
                    if doc < first[h]:
                        first[h] = doc
                else:
                    first[h], count[h] = doc, 1
            if len(first) >= FOLD:
                yield flush()
    if first:
        yield flush()


def _build_shard(key: tuple, rows: pa.Table) -> pa.Table:
    h1, h2, first, n = (rows.column(c).to_numpy() for c in ("h1", "h2", "first_doc", "n"))
    order = np.lexsort((h2, h1))
    h1, h2, first, n = h1[order], h2[order], first[order], n[order]
    starts = np.flatnonzero(np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])])
    h1, h2, first, n = h1[starts], h2[starts], np.minimum.reduceat(first, starts), np.add.reduceat(n, starts)
    u1, u2 = h1.view(np.uint64), h2.view(np.uint64)
    sizes, words = build_index(u1, u2)
    at = probe_index(sizes, words, u1, u2)
    prints, counts, docs = np.empty(len(at), np.uint32), np.empty(len(at), np.uint32), np.empty(len(at), np.int64)
    prints[at], counts[at], docs[at] = (u2 >> _U(32)).astype(np.uint32), np.minimum(n, 2**32 - 1), first
    docs = docs[counts > 1]
    heavy = [dict(zip(("h1", "h2", "first_doc", "n"), map(int, (h1[i], h2[i], first[i], n[i])), strict=True)) for i in np.flatnonzero(n >= HEAVY_LEAST)]
    return pa.table(
        {
            "shard": [key[0].as_py()], "n_keys": [len(at)], "n_lines": [int(n.sum())], "sizes": [sizes], "bits": [words.tobytes()],
            "fingerprints": [prints.tobytes()], "counts": [counts.tobytes()], "first_docs": [docs.tobytes()],
            "heavy": pa.array([heavy], pa.list_(pa.struct(list(_KEYS)))),
        }
    )


def index_lines(docs: DataFrame) -> DataFrame:
    """The arrays of all shards over the lines of ``doc_id, text``, one row for each shard."""
    return _sharded(docs)[0]


def _sharded(docs: DataFrame) -> tuple[DataFrame, int]:
    """The arrays of all shards, and the number of shards."""
    spark = docs.sparkSession
    small_batches(spark)
    keys = materialize(docs.select("doc_id", "text").mapInArrow(_fold, "h1 long, h2 long, first_doc long, n long"), "keys", "uncompressed")
    shards = max(4 * shuffle_width(spark), -(-keys.count() // SHARD_KEYS))
    dealt = keys.withColumn("shard", F.pmod("h1", F.lit(shards)))
    index = materialize(dealt.groupBy("shard").applyInArrow(_build_shard, _SHARD), "lines", "uncompressed")
    discard(spark, keys)
    return index, shards


def _heavy_lines(index: DataFrame) -> dict[bytes, int]:
    """Hash and smallest doc_id of the heavy lines, HEAVY_SHARE at most."""
    total = index.agg(F.sum("n_lines")).first()[0] or 0
    least = max(HEAVY_LEAST, -(-total // HEAVY_SHARE))
    rows = index.select(F.explode("heavy").alias("x")).select("x.*").filter(F.col("n") >= least).collect()
    return {np.array([r.h1, r.h2], np.int64).tobytes(): r.first_doc for r in rows}


def _answer(probes: pa.Table, index: pa.Table) -> pa.Table:
    if not index.num_rows:
        return probes.select(["doc", "h1"]).slice(0, 0)
    row = index.slice(0, 1).to_pylist()[0]
    h1, h2, doc = (probes.column(c).to_numpy() for c in ("h1", "h2", "doc"))
    u1, u2 = h1.view(np.uint64), h2.view(np.uint64)
    at = probe_index(row["sizes"], np.frombuffer(row["bits"], np.uint64), u1, u2)
    prints, counts, first = (np.frombuffer(row[c], t) for c, t in (("fingerprints", np.uint32), ("counts", np.uint32), ("first_docs", np.int64)))
    gone = at >= 0
    gone[gone] = prints[at[gone]] == (u2[gone] >> _U(32)).astype(np.uint32)
    gone[gone] = counts[at[gone]] > 1
    place = np.cumsum(counts > 1) - 1
    gone[gone] = first[place[at[gone]]] < doc[gone]
    return pa.table({"doc": doc[gone], "h1": h1[gone]})


def dedup_lines(docs: DataFrame, names: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """The documents with the repeated lines gone from ``text``, and two counts of ``names``: lines, and lines dropped."""
    spark = docs.sparkSession
    docs = docs.drop(*names)
    index, shards = _sharded(docs)
    heavy = spark.sparkContext.broadcast(_heavy_lines(index))

    @tidy
    def probes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            hashes: list[bytes] = []
            owners: list[int] = []
            for doc, text in _rows(batch, "doc_id", "text"):
                new = {line_hash(line) for line in text.split(b"\n")} - {None}
                new.difference_update(known)
                hashes.extend(new)
                owners.extend([doc] * len(new))
            if hashes:
                h1, h2 = _split(hashes)
                yield pa.record_batch({"h1": h1, "h2": h2, "doc": pa.array(owners, pa.int64())})

    asked = docs.select("doc_id", "text").mapInArrow(probes, "h1 long, h2 long, doc long").withColumn("shard", F.pmod("h1", F.lit(shards)))
    drops = asked.groupBy("shard").cogroup(index.groupBy("shard")).applyInArrow(_answer, "doc long, h1 long")
    drops = drops.distinct().groupBy("doc").agg(F.collect_list("h1").alias("__line_drops")).withColumnRenamed("doc", "__line_doc")
    columns = docs.columns
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in names)])

    @tidy
    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = heavy.value
        for batch in batches:
            kept, lines, dropped = [], [], []
            drops = batch.column(batch.num_columns - 1).to_pylist()
            for (doc, text), gone in zip(_rows(batch, "doc_id", "text"), drops, strict=True):
                parts, stay = text.split(b"\n"), []
                out = set(gone or ())
                for line in parts:
                    h = line_hash(line)
                    if h is None or not (int.from_bytes(h[:8], "little", signed=True) in out or known.get(h, NO_ID) < doc):
                        stay.append(line)
                kept.append(text if len(stay) == len(parts) else b"\n".join(stay))
                lines.append(len(parts))
                dropped.append(len(parts) - len(stay))
            cols = [pa.array(kept, pa.binary()).cast(pa.string()) if c == "text" else batch.column(i) for i, c in enumerate(columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], names=[*columns, *names])

    mine = docs.withColumn("__line_doc", F.coalesce(F.col("doc_id"), F.lit(NO_ID)))
    return mine.join(drops, "__line_doc", "left").select(*columns, "__line_drops").mapInArrow(rewrite, schema)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all documents and the digest of what stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, coalesce(first_doc < doc_id, false) AS gone FROM k LEFT JOIN f USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

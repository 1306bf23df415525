"""Suffix-array dedup: repeated passages by a common-prefix interval tree.

Every byte goes that is covered by a 50-byte string which also starts in a document
with a smaller doc_id. The result is exact.

Equal contexts, by their hashes, settle most of it (2); suffix arrays and the tree (3) see
only what differs between contexts of an anchor, 84 bytes at most. So the maximal repeats
of whole texts are removed but not listed as groups with all their occurrences.

1. Winnowing picks anchors: of the 16-byte strings within any 50 bytes, those with the
   smallest hash. So two equal 50-byte strings pick the same anchor at the same place.
   An anchor's context is all that the 50-byte strings which picked it cover, 84 bytes
   at most. Tasks fold what shares anchor and context.
2. Anchors meet by their hash. Where the whole context is found in a document with a
   smaller doc_id, all of its bytes go. The first document of a context goes on only if
   the anchor has other contexts that agree with it on one side.
3. The texts of these contexts, few against the input, are put into suffix arrays. A
   scan with a stack turns the array of common prefixes into the tree of its intervals;
   an interval of 50 bytes or more whose occurrences differ in the byte before is a
   maximal repeat, given with all its occurrences. In each, what does not belong to the
   smallest doc_id goes, for each place by the longest such repeat.
4. Anchors with more than 20,000 such contexts, as at the edge of a passage that half of
   the documents hold, would overload a task. Their 50-byte strings are summed by hash
   over all tasks instead, which gives the same result.

Cases: a null text is empty; a text under 50 bytes stays whole; a null doc_id ranks
after all others and stands for one document; rows with one doc_id are one document
and don't remove from each other; an empty input gives an empty result. Other columns
pass through; ``n_bytes``, ``n_removed``, ``n_spans`` and ``kept`` are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T
from pyspark.sql import Window

from stowage.llm.workers import texts, tidy
from stowage.session import discard, materialize, release, small_batches

LEAST = 50
GRAM = 16
SIDE = LEAST - GRAM
CONTEXT = GRAM + 2 * SIDE
#: Contexts that tell more than the anchor: half of what a repeat has beside it.
HALF = SIDE // 2
NO_ID = 2**63 - 1
#: Anchors that a task folds at once, contexts in one suffix array, and contexts of one anchor for that.
FOLD, AT_ONCE, CROWD = 500_000, 6_000, 20_000
#: Context hash of rows whose fate is known already.
GONE = -(2**63)
#: A row's x: where its context starts, how many strings it has besides the first, and hashes of the two halves.
START_BITS, MORE_BITS, HALF_BITS = 32, 6, 13

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_ROW = "a long, c long, doc long, part long, x long"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(32))) * _U(0xD6E8FEB86659FD93)
    return h ^ (h >> _U(29))


class Rolling:
    """Hashes of all substrings of a text of given lengths, by doubling."""

    def __init__(self, text: np.ndarray) -> None:
        self.levels = [text.astype(np.uint64) + _U(1)]

    def of(self, length: int) -> np.ndarray:
        size = len(self.levels[0]) - length + 1
        if size <= 0:
            return np.zeros(0, np.uint64)
        while 1 << len(self.levels) <= length:
            h, n = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(h[:-n] * _U(pow(_BASE, n, 2**64)) + h[n:])
        total, at = np.zeros(size, np.uint64), 0
        for level in range(length.bit_length() - 1, -1, -1):
            n = 1 << level
            if length & n:
                total = total * _U(pow(_BASE, n, 2**64)) + self.levels[level][at : at + size]
                at += n
        return total


class Powers:
    """Powers of the base of the hashes, and of its inverse."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def reach(self, n: int) -> None:
        if len(self.up) < n:
            step = np.full(2 * n, _BASE, np.uint64), np.full(2 * n, pow(_BASE, -1, 2**64), np.uint64)
            for powers in step:
                powers[0] = 1
            self.up, self.down = (np.multiply.accumulate(powers) for powers in step)


_POWERS = Powers()


def _spans(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of substrings of any lengths, by the place of the bytes within them."""
    _POWERS.reach(len(text) + 1)
    sums = np.zeros(len(text) + 1, np.uint64)
    np.cumsum((text.astype(np.uint64) + _U(1)) * _POWERS.down[: len(text)], out=sums[1:])
    return (sums[end] - sums[begin]) * _POWERS.up[begin]


def _slide(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    n = 1
    while 2 * n <= width:
        values = pick(values[:-n], values[n:])
        n *= 2
    return pick(values[: len(values) - (width - n)], values[width - n :]) if n < width else values


def anchors(text: bytes) -> tuple[np.ndarray, ...]:
    """Anchors' hashes, starts of their contexts, strings besides the first, and hashes of context, left and right half."""
    data = np.frombuffer(text, np.uint8)
    rolling = Rolling(data)
    grams = _mix(rolling.of(GRAM))
    width = LEAST - GRAM + 1
    if len(grams) < width:
        none = np.zeros(0, np.uint64)
        return none, none.astype(np.int64), none.astype(np.int64), none, none, none
    least = _slide(grams, width, np.minimum)
    edge = np.zeros(width - 1, np.uint64)
    at = np.flatnonzero(_slide(np.concatenate([edge, least, edge]), width, np.maximum) == grams)
    # The strings that picked an anchor are a run of starts, up to the anchor's own place.
    starts = at[:, None] - np.arange(width - 1, -1, -1)
    mine = (starts >= 0) & (starts < len(least))
    mine &= least[np.clip(starts, 0, len(least) - 1)] == grams[at][:, None]
    first = at - (width - 1) + mine.argmax(axis=1)
    last = at - mine[:, ::-1].argmax(axis=1)
    context = _spans(data, first, last + LEAST)
    context = _mix(context ^ ((last - first) << 8 | (at - first)).astype(np.uint64) * _U(0xA0761D6478BD642F))
    halves = rolling.of(GRAM + HALF)
    left, right = np.zeros(len(at), np.uint64), np.zeros(len(at), np.uint64)
    full = at >= HALF
    left[full] = _mix(halves[at[full] - HALF])
    full = at < len(halves)
    right[full] = _mix(halves[at[full]])
    return grams[at], first, last - first, context, left, right


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where a sorted table's rows differ from the row before."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = False
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return new


@tidy
def _find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Anchors of ``doc, part, text``, each with its context packed in x."""
    held: list[tuple[np.ndarray, ...]] = []
    count = 0

    def flush() -> pa.RecordBatch:
        a, c, doc, part, x = (np.concatenate(col) for col in zip(*held, strict=True))
        order = np.lexsort((doc, c, a))
        a, c, doc, part, x = a[order], c[order], doc[order], part[order], x[order]
        new = _starts(a, c)
        later = doc > doc[np.maximum.accumulate(np.where(new, np.arange(len(a)), 0))]
        # What a smaller doc_id of this task already settles need not meet the others of its anchor.
        a[later] = x[later].view(np.int64) ^ doc[later]
        c[later] = GONE
        return pa.record_batch({"a": a, "c": c, "doc": doc, "part": part, "x": x.view(np.int64)})

    for batch in batches:
        for doc, part, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), strict=True):
            if len(text) < LEAST:
                continue
            a, first, more, c, left, right = anchors(text)
            x = ((left >> _U(64 - HALF_BITS)) << _U(HALF_BITS) | right >> _U(64 - HALF_BITS)) << _U(START_BITS + MORE_BITS)
            x |= more.astype(np.uint64) << _U(START_BITS) | first.astype(np.uint64)
            held.append((a.view(np.int64), np.maximum(c.view(np.int64), GONE + 1), np.full(len(a), doc, np.int64), np.full(len(a), part, np.int64), x))
            count += len(a)
            if count >= FOLD:
                yield flush()
                held, count = [], 0
    if held:
        yield flush()


@tidy
def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted anchor rows: those that are gone, and the first document's rows of contexts of anchors with several."""
    last: tuple[int, int, int] | None = None  # anchor, context, smallest doc
    several = False
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        a, c, doc, part, x = (batch.column(i).to_numpy() for i in range(5))
        if not len(a):
            continue
        new_a, new = _starts(a), _starts(a, c)
        if last is not None and a[0] == last[0]:
            new_a[0] = False
            new[0] = c[0] != last[1]
        first = np.maximum.accumulate(np.where(new, np.arange(len(a)), -1))
        smallest = np.where(first < 0, last[2] if last else 0, doc[np.maximum(first, 0)])
        gone = (c == GONE) | (doc > smallest)
        # Whether an anchor has several contexts shows where one of its rows begins a second one.
        owner = np.cumsum(new_a)
        more = np.bincount(owner[new & ~new_a], minlength=owner[-1] + 1) > 0
        more[0] = more[0] or several
        # Of what is gone only the place counts from here on.
        kept = np.where(gone, 0, a), np.where(gone, 0, c), doc, part, np.where(gone, x & ((1 << START_BITS + MORE_BITS) - 1), x)
        table = pa.RecordBatch.from_arrays([pa.array(column) for column in kept], names=["a", "c", "doc", "part", "x"])
        if waiting and (more[0] or not (owner == 0).any() or owner[-1] > 0):
            if more[0]:
                yield from waiting
            waiting = []
        keep = ~gone & more[owner]
        open_now = ~gone & (owner == owner[-1]) & ~more[owner]
        if (gone | keep).any():
            out = pa.RecordBatch.from_arrays([*table.columns, pa.array(gone)], names=[*table.schema.names, "gone"])
            yield out.filter(pa.array(gone | keep))
        if open_now.any():
            rest = table.filter(pa.array(open_now))
            waiting.append(pa.RecordBatch.from_arrays([*rest.columns, pa.array(np.zeros(rest.num_rows, bool))], names=[*rest.schema.names, "gone"]))
        several = bool(more[owner[-1]])
        last = (int(a[-1]), int(c[-1]), int(smallest[-1]))


@tidy
def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The contexts that ``doc, part, text, wanted`` asks for, as ``a, crowd, doc, part, start, context``."""
    for batch in batches:
        out: list[tuple] = []
        for doc, part, text, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch), batch.column(3).to_pylist(), strict=True):
            for w in wanted:
                out.append((w["a"], w["crowd"], doc, part, w["begin"], text[w["begin"] : w["end"]]))
        if out:
            names = ["a", "crowd", "doc", "part", "start", "context"]
            kinds = [pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)


class SuffixArray:
    """Suffixes of short texts in order, with their common prefixes: those whose first LEAST bytes recur.

    Texts end in zeros; of suffixes that agree, the one that ends first stands first.
    """

    def __init__(self, texts: list[bytes]) -> None:
        n, columns = len(texts), np.arange(SIDE + 1)
        lengths = np.fromiter(map(len, texts), np.int64, n)
        stride = CONTEXT + SIDE
        flat = np.frombuffer(b"".join(t.ljust(stride, b"\0") for t in texts), np.uint8)
        row, column = np.nonzero(lengths[:, None] - columns >= LEAST)
        hashes = Rolling(flat).of(LEAST)[row * stride + column]
        _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
        again = np.flatnonzero(count[which] > 1)
        left = lengths[row[again]] - column[again]
        again = again[np.argsort(left, kind="stable")]
        at = (row[again] * stride + column[again])[:, None] + np.arange(CONTEXT)
        keys = flat[at]
        order = keys.view(f"S{CONTEXT}").ravel().argsort(kind="stable")
        self.row, self.column, keys = row[again][order], column[again][order], keys[order]
        left = lengths[self.row] - self.column
        #: common[i]: bytes that suffix i shares with the one before it, 0 if under LEAST.
        self.common = np.zeros(len(order) + 1, np.int64)
        differ = np.concatenate([keys[1:] != keys[:-1], np.ones((max(0, len(order) - 1), 1), bool)], axis=1).argmax(axis=1)
        same = np.minimum(differ, np.minimum(left[1:], left[:-1]))
        self.common[1:-1] = np.where(same >= LEAST, same, 0)
        place = self.row * stride + self.column
        self.before = np.where(self.column > 0, flat[place - 1].astype(np.int64), -1 - np.arange(len(order)))

    def maximal_repeats(self) -> Iterator[tuple[int, int, int]]:
        """Length and first and last suffix of every repeat that can't be extended, the longer ones of a place first."""
        common, before = self.common.tolist(), self.before.tolist()
        joins = np.flatnonzero(self.common)
        runs = np.split(joins, np.flatnonzero(np.diff(joins) > 1) + 1) if len(joins) else []
        for run in runs:
            first, last = int(run[0]) - 1, int(run[-1])
            # Open intervals: length, first suffix, and the byte before if all agree, else None.
            stack: list[list] = []
            for i in range(first, last + 2):
                length = common[i] if first < i <= last else 0
                start, letter = i - 1, before[i - 1]
                while stack and stack[-1][0] > length:
                    size, start, mine = stack.pop()
                    mine = mine if mine == letter else None
                    if mine is None:
                        yield size, start, i - 1
                    letter = mine
                if not length:
                    continue
                if stack and stack[-1][0] == length:
                    if stack[-1][2] != letter:
                        stack[-1][2] = None
                else:
                    stack.append([length, start, letter])


def _repeats(texts: list[bytes], doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, offset and length of what repeats a text with a smaller doc: the longest at each place."""
    array = SuffixArray(texts)
    owner = doc[array.row]
    best = np.zeros(len(owner), np.int64)
    for length, first, last in array.maximal_repeats():
        own = owner[first : last + 1]
        mine = best[first : last + 1]
        mine[(mine == 0) & (own > own.min())] = length
    found = best > 0
    return array.row[found], array.column[found], best[found]


@tidy
def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans to remove, of contexts in the order of their anchors."""
    held: list[pa.RecordBatch] = []
    count = 0

    def run(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches).combine_chunks()
        doc = rows.column("doc").to_numpy()
        row, column, length = _repeats(rows.column("context").to_pylist(), doc)
        begin = rows.column("start").to_numpy()[row] + column
        return pa.record_batch({"doc": doc[row], "part": rows.column("part").to_numpy()[row], "begin": begin, "end": begin + length})

    for batch in batches:
        a = batch.column(0).to_numpy()
        if not len(a):
            continue
        ends = np.flatnonzero(a[1:] != a[:-1]) + 1
        if held and held[-1].column(0)[-1].as_py() != a[0]:
            ends = np.r_[0, ends]
        done = 0
        for end in ends.tolist():
            if count + end - done >= AT_ONCE:
                held.append(batch.slice(done, end - done))
                yield run(held)
                held, count, done = [], 0, end
        if done < len(a):
            held.append(batch.slice(done))
            count += len(a) - done
    if held:
        yield run(held)


@tidy
def _strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The 50-byte strings of contexts, as hashes."""
    for batch in batches:
        out: list[tuple] = []
        for doc, part, start, context in zip(*(batch.column(i).to_pylist() for i in (2, 3, 4, 5)), strict=True):
            for i in range(len(context) - LEAST + 1):
                d = xxhash.xxh3_128_digest(context[i : i + LEAST])
                out.append((int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True), doc, part, start + i))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["h1", "h2", "doc", "part", "begin"])


def spans(rows: DataFrame) -> DataFrame:
    """``doc, part, spans`` (arrays of begin and end) of rows ``doc, part, text``; spans may overlap or pass the ends."""
    spark = rows.sparkSession
    small_batches(spark)
    found = rows.mapInArrow(_find, _ROW).repartition("a").sortWithinPartitions("a", "c", "doc")
    met = materialize(found.mapInArrow(_meet, _ROW + ", gone boolean"), "met")
    release(spark)
    begin = F.col("x").bitwiseAND(F.lit((1 << START_BITS) - 1))
    end = begin + F.shiftrightunsigned("x", START_BITS).bitwiseAND(F.lit((1 << MORE_BITS) - 1)) + LEAST
    right = F.shiftrightunsigned("x", START_BITS + MORE_BITS).bitwiseAND(F.lit((1 << HALF_BITS) - 1))
    left = F.shiftrightunsigned("x", START_BITS + MORE_BITS + HALF_BITS)
    whole = met.filter("gone").select("doc", "part", begin.alias("begin"), end.alias("end"))
    first = met.filter("NOT gone").select("a", "doc", "part", begin.alias("begin"), end.alias("end"), left.alias("left"), right.alias("right"))
    agree = (F.count("*").over(Window.partitionBy("a", "left")) > 1) | (F.count("*").over(Window.partitionBy("a", "right")) > 1)
    first = first.withColumn("agree", agree).filter("agree")
    first = first.withColumn("crowd", F.count("*").over(Window.partitionBy("a")) > CROWD)
    wanted = first.groupBy("doc", "part").agg(F.collect_list(F.struct("a", "begin", "end", "crowd")).alias("wanted"))
    contexts = rows.join(wanted, ["doc", "part"]).select("doc", "part", "text", "wanted")
    contexts = materialize(contexts.mapInArrow(_cut, "a long, crowd boolean, doc long, part long, start long, context binary"), "contexts")
    release(spark)
    edges = contexts.filter("NOT crowd").repartition("a").sortWithinPartitions("a", "doc").mapInArrow(_search, "doc long, part long, begin long, end long")
    strings = contexts.filter("crowd").mapInArrow(_strings, "h1 long, h2 long, doc long, part long, begin long")
    owners = strings.groupBy("h1", "h2").agg(F.min("doc").alias("owner"), F.max("doc").alias("other")).filter("owner < other").drop("other")
    crowded = strings.join(owners, ["h1", "h2"]).filter("doc > owner").select("doc", "part", "begin", (F.col("begin") + LEAST).alias("end"))
    every = whole.union(edges).union(crowded)
    out = materialize(every.groupBy("doc", "part").agg(F.collect_list(F.struct("begin", "end")).alias("spans")), "spans")
    discard(spark, met)
    discard(spark, contexts)
    release(spark)
    return out


def remove_repeats(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with ``n_bytes, n_removed, n_spans`` and the remaining bytes in ``kept``."""
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    columns = docs.columns
    # Texts of one doc_id are told apart by their hash; where every doc_id has one row, there is nothing to tell.
    repeated = not docs.groupBy("doc_id").count().filter("count > 1").isEmpty()
    mine = docs.withColumn("__doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))).withColumn("__part", F.xxhash64("text") if repeated else F.lit(0).cast("long"))
    rows = mine.select(F.col("__doc").alias("doc"), F.col("__part").alias("part"), "text")
    if repeated:
        rows = rows.dropDuplicates(["doc", "part"])
    found = spans(rows).withColumnsRenamed({"doc": "__doc", "part": "__part", "spans": "__spans"})
    schema = T.StructType([*docs.schema.fields, *(T.StructField(n, T.LongType()) for n in ("n_bytes", "n_removed", "n_spans")), T.StructField("kept", T.BinaryType())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_bytes, n_removed, n_spans, kept = [], [], [], []
            column = batch.column(batch.num_columns - 1)
            for i, text in enumerate(texts(batch)):
                size, removed, count, stay = len(text), 0, 0, text
                if column[i].is_valid:
                    items = column[i].values
                    begin, end = (np.clip(items.field(k).to_numpy(), 0, size) for k in (0, 1))
                    order = np.argsort(begin, kind="stable")
                    begin, end = begin[order], np.maximum.accumulate(end[order])
                    new = np.r_[True, begin[1:] > end[:-1]]
                    begin, end = begin[new], end[np.r_[np.flatnonzero(new)[1:] - 1, len(end) - 1]]
                    removed, count = int((end - begin).sum()), len(begin)
                    stay = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*begin.tolist(), size], strict=True))
                n_bytes.append(size)
                n_removed.append(removed)
                n_spans.append(count)
                kept.append(stay)
            longs = [pa.array(v, pa.int64()) for v in (n_bytes, n_removed, n_spans)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *longs, pa.array(kept, pa.binary())], names=[f.name for f in schema])

    joined = mine.join(found, ["__doc", "__part"], "left").select(*columns, "__spans")
    return joined.mapInArrow(run, schema)


def op10_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays of all documents without repeated passages."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return remove_repeats(docs).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))

"""N-gram Jaccard join by grouped prefixes.

A document is the set of its five-word shingles, as 64-bit hashes. Two documents link
when their sets' Jaccard similarity is at least 0.75; the result is exact.

1. Shingles are ordered by how full their cell of a counting table of fixed size is, the
   emptiest first, then by hash. Sets that are similar enough share a shingle of
   their prefixes, the first quarter in this order. Any order is right; this one keeps
   shingles that many documents share out of the prefixes.
2. Documents with equal sets fold into a class, and classes of equal size with equal
   prefixes into a group. Only one prefix of each group is posted, and only shingles
   posted by two groups or more go on.
3. Pairs that are likely to link are verified first: neighbours by one of four minimum
   hashes that agree in another, then, among the same documents and at last among all,
   neighbours in posting lists in random order that are not connected yet. They give
   components.
4. Then come all pairs of groups that share a prefix shingle and are not connected yet.
   Posting lists name, for each group, the larger components it meets there. A component
   of one group makes a pair, which the number of shared shingles, a bound of the
   overlap, must allow. A component of several is taken member by member, or through the
   posting lists again if these hold fewer. All are filtered by size and by bitmaps of
   the sets, which show shingles that the other lacks, expanded into classes and
   verified. So no link between different components is missed, and no pair within one is
   looked at.

Nothing grows but tables: the counting table has 2**22 cells at any size, posting lists
are joined by Spark (which splits hot ones), and sets are compared pair by pair.

Cases: a text without words is an empty set and links with nothing; fewer than five
words are one shingle; a null doc_id takes no part in links and has a null component;
rows with one doc_id are one document, which links by any of its texts; an empty input
gives an empty result. Other columns pass through where documents are kept or dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stowage.llm.components import components
from stowage.llm.workers import give_back, texts, tidy
from stowage.session import discard, materialize, release, small_batches

WORDS = 5
#: Cells of the counting table, and the pieces in which tasks hand it on.
CELLS, PIECES = 2**22, 64
#: Bits of the bitmap of a set, in 64-bit words.
BIT_WORDS = 8
#: Words whose hashes a task keeps.
KEPT_WORDS = 400_000
#: Rounds of neighbours in posting lists of suspects, each with a part of the shingles, before the round among all groups.
NEIGHBOUR_ROUNDS, PARTS = 1, 4

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hashes of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > KEPT_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(31))) * _ODD
    return h ^ (h >> _U(29))


def shingles(text: bytes, words: WordHashes, width: int = WORDS) -> np.ndarray:
    """Hashes of the shingles of a text, with repeats."""
    split = text.lower().split()
    if not split:
        return np.zeros(0, np.uint64)
    w = np.fromiter(map(words.__getitem__, split), np.uint64, len(split))
    if len(w) < width:
        return np.array([xxhash.xxh3_64_intdigest(w.tobytes())], np.uint64)
    h = w[: len(w) - width + 1].copy()
    for i in range(1, width):
        h = h * _ODD + w[i : len(w) - width + 1 + i]
    return _finish(h)


def _cell(h: np.ndarray) -> np.ndarray:
    return (h & _U(CELLS - 1)).astype(np.int64)


@tidy
def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words, cells, seen = WordHashes(), np.zeros(CELLS, np.uint32), False
    for batch in batches:
        for text in texts(batch):
            # In place, so a task holds one document's hashes beside the table.
            np.add.at(cells, _cell(shingles(text, words)), np.uint32(1))
            seen = True
    if seen:
        parts = np.minimum(cells, 2**16 - 1).astype("<u2").reshape(PIECES, -1)
        for i, part in enumerate(parts):
            yield pa.record_batch({"piece": pa.array([i], pa.int32()), "counts": pa.array([part.tobytes()], pa.binary())})


def _add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(CELLS // PIECES, np.int64)
    for batch in batches:
        for blob in batch.column(1).to_pylist():
            total += np.frombuffer(blob, "<u2")
    yield pa.record_batch({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())})


def commonness(docs: DataFrame) -> np.ndarray:
    """For each cell of shingle hashes how full it is, in quarters of the spread that chance alone would give.

    The table has two bytes for each of CELLS, whatever the size of the input.
    """
    parts = docs.select("text").mapInArrow(_count, "piece int, counts binary")
    rows = parts.groupBy("piece").applyInArrow(_add, "piece int, counts binary").collect()
    cells = np.zeros((PIECES, CELLS // PIECES), np.uint32)
    for row in rows:
        cells[row.piece] = np.frombuffer(row.counts, "<u4")
    del rows
    step = np.uint32(max(1, int(np.sqrt(cells.mean()) / 4)))
    cells //= step
    table = np.minimum(cells, 2**16 - 1, out=cells).astype(np.uint16).ravel()
    del cells
    give_back()
    return table


def bitmap(s: np.ndarray) -> list[int]:
    """Which of 64 * BIT_WORDS parts of the hashes a set has shingles in."""
    there = np.zeros(64 * BIT_WORDS, bool)
    there[(s >> _U(64 - 9)).astype(np.int64)] = True
    return np.packbits(there, bitorder="little").view(np.int64).tolist()


def prefix_length(n: int) -> int:
    return n - (3 * n + 3) // 4 + 1 if n else 0


_MADE = "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, low array<long>, bits array<long>, prefix binary"
# Odd multipliers that make the minimum hashes.
_SEEDS = tuple(_U(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def _longs(digest: bytes) -> tuple[int, int]:
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def describe(docs: DataFrame) -> DataFrame:
    """For each document the size of its set, digests of set and prefix, the minimum hashes, and the prefix."""
    shared = docs.sparkSession.sparkContext.broadcast(commonness(docs))

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, common = WordHashes(), shared.value
        for batch in batches:
            rows = []
            for text in texts(batch):
                s = np.unique(shingles(text, words))
                n = len(s)
                if not n:
                    rows.append((0, 0, 0, 0, 0, [0] * len(_SEEDS), [0] * BIT_WORDS, b""))
                    continue
                # Stable, so shingles whose cells are alike stand in the order of their hashes.
                prefix = s[np.argsort(common[_cell(s)], kind="stable")[: prefix_length(n)]].tobytes()
                low = np.array([_finish(s * seed).min() for seed in _SEEDS]).view(np.int64).tolist()
                rows.append((n, *_longs(xxhash.xxh3_128_digest(s.tobytes())), *_longs(xxhash.xxh3_128_digest(prefix)), low, bitmap(s), prefix))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:5]), *(pa.array(c, pa.list_(pa.int64())) for c in columns[5:7]), pa.array(columns[7], pa.binary())],
                names=["doc_id", "n", "s1", "s2", "p1", "p2", "low", "bits", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, _MADE)


@tidy
def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 1000):
            batch = whole.slice(at, 1000)
            blobs = batch.column(2).to_pylist()
            sizes = [len(b) // 8 for b in blobs]
            yield pa.record_batch({
                "token": np.frombuffer(b"".join(blobs), np.int64), "gid": np.repeat(batch.column(0).to_numpy(), sizes), "n": np.repeat(batch.column(1).to_numpy(), sizes),
            })


@tidy
def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of rows ``key, rank, id, label, sign`` in order: each with the one before it or else with the first of its key here.

    Both must have different labels and agree in two of the four 16-bit lanes of their signs.
    """
    last: tuple[int, ...] | None = None
    hub: tuple[int, ...] = (0, 0, 0)

    def alike(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        differ = (a ^ b).view(np.uint64)
        return sum(((differ >> _U(shift)) & _U(0xFFFF) == 0).astype(np.int8) for shift in (0, 16, 32, 48)) >= 2

    for batch in batches:
        key, node, label, sign = (batch.column(i).to_numpy() for i in (0, 2, 3, 4))
        if not len(key):
            continue
        if last is None or last[0] != key[0]:
            hub = (int(node[0]), int(label[0]), int(sign[0]))
        if last is not None:
            key, node, label, sign = (np.r_[x, column] for x, column in zip(last, (key, node, label, sign), strict=True))
        same = key[1:] == key[:-1]
        first = np.maximum.accumulate(np.where(np.r_[True, ~same], np.arange(len(key)), 0))
        hubs = [column[first] for column in (node, label, sign)]
        if last is not None and same[0]:
            hubs = [np.where(first == 0, x, column) for x, column in zip(hub, hubs, strict=True)]
        near = np.flatnonzero(same & (label[1:] != label[:-1]) & alike(sign[1:], sign[:-1]))
        paired = np.zeros(len(key), bool)
        paired[near + 1] = True
        far = np.flatnonzero(~paired & (hubs[1] != label) & alike(hubs[2], sign))
        out = {*zip(node[near].tolist(), node[near + 1].tolist(), strict=True), *zip(hubs[0][far].tolist(), node[far].tolist(), strict=True)}
        hub = tuple(int(column[-1]) for column in hubs)
        last = (int(key[-1]), int(node[-1]), int(label[-1]), int(sign[-1]))
        pairs = [(min(p), max(p)) for p in out if p[0] != p[1]]
        if pairs:
            yield pa.record_batch({"x": pa.array([p[0] for p in pairs], pa.int64()), "y": pa.array([p[1] for p in pairs], pa.int64())})


def neighbours(rows: DataFrame) -> DataFrame:
    """Likely pairs ``x, y`` of rows ``key, rank, id, label, sign``: next to each other under one key.

    Rows are range-sorted, so a hot key spreads over tasks; pairs across a bound are not needed here.
    """
    order = ["key", "rank", "id"]
    return rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_neighbours, "x long, y long").distinct()


@tidy
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = WordHashes()
    for batch in batches:
        yield pa.record_batch({"id": batch.column(0), "members": pa.array([np.unique(shingles(t, words)).tobytes() for t in texts(batch)], pa.binary())})


@tidy
def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            a, b = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(a, b, assume_unique=True))
            keep.append(100 * both >= 75 * (len(a) + len(b) - both))
        mask = pa.array(keep, pa.bool_())
        yield pa.record_batch({"x": batch.column(0).filter(mask), "y": batch.column(1).filter(mask)})


def overlap(a: str, b: str, words: int = BIT_WORDS) -> str:
    """An upper bound of the overlap of sets of nx and ny: either set without what the bits show the other to lack."""

    def lacking(one: str, other: str) -> str:
        return "coalesce(" + " + ".join(f"bit_count({one}[{i}] & ~{other}[{i}])" for i in range(words)) + ", 0)"

    return f"least(nx - {lacking(a, b)}, ny - {lacking(b, a)})"


def possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs ``x, y`` of classes ``cid, n, bits`` that sizes and bitmaps don't rule out."""
    left = classes.select(F.col("cid").alias("x"), F.col("n").alias("nx"), F.col("bits").alias("bx"))
    right = classes.select(F.col("cid").alias("y"), F.col("n").alias("ny"), F.col("bits").alias("by"))
    return pairs.join(left, "x").join(right, "y").filter(f"7 * {overlap('bx', 'by')} >= 3 * (nx + ny)").select("x", "y")


def sets_of(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """``id, members`` of the documents in pairs ``x, y``."""
    ids = pairs.select(F.col("x").alias("__id")).union(pairs.select("y")).distinct()
    mine = docs.select("doc_id", "text").join(ids, F.col("doc_id") == F.col("__id"), "left_semi")
    return materialize(mine.mapInArrow(_sets, "id long, members binary"), "sets", "uncompressed")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs ``x, y`` that link."""
    both = pairs.join(sets.select(F.col("id").alias("x"), F.col("members").alias("a")), "x")
    both = both.join(sets.select(F.col("id").alias("y"), F.col("members").alias("b")), "y").select("x", "y", "a", "b")
    return materialize(both.mapInArrow(_linked, "x long, y long").distinct(), "verified")


def link(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents as ``doc_id, n, cid`` (the smallest doc_id with the same set) and ``node, component`` of linked cids."""
    spark = docs.sparkSession
    small_batches(spark)
    made = materialize(describe(docs), "described", "uncompressed")
    full = made.filter("n > 0 AND doc_id IS NOT NULL")
    least = F.min(F.struct("doc_id", "n", "p1", "p2", "low", "bits", "prefix")).alias("first")
    classes = full.groupBy("s1", "s2").agg(least).select(
        "s1", "s2", F.col("first.doc_id").alias("cid"), "first.n", "first.p1", "first.p2", "first.low", "first.bits", "first.prefix"
    )
    classes = materialize(classes, "classes", "uncompressed")
    narrow = made.select("doc_id", "n", "s1", "s2")
    members = classes.select("s1", "s2", "cid")
    rows = materialize(narrow.join(members, ["s1", "s2"], "left").select("doc_id", "n", F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("cid")).alias("cid")), "rows")
    discard(spark, made)
    release(spark)

    grouped = classes.withColumn("gid", F.min("cid").over(Window.partitionBy("n", "p1", "p2")))
    lanes = [F.shiftleft(F.col("low")[i].bitwiseAND(F.lit(0xFFFF)), 16 * i) for i in range(len(_SEEDS))]
    grouped = grouped.withColumn("sign", lanes[0].bitwiseOR(lanes[1]).bitwiseOR(lanes[2]).bitwiseOR(lanes[3]))
    groups = materialize(grouped.select("cid", "gid", "n", "low", "bits", "sign", F.when(F.col("cid") == F.col("gid"), F.col("prefix")).alias("prefix")), "groups", "uncompressed")
    discard(spark, classes)
    posted = groups.filter("prefix IS NOT NULL").select("gid", "n", "prefix").mapInArrow(_post, "token long, gid long, n long")
    lists = posted.withColumn("m", F.count("*").over(Window.partitionBy("token"))).filter("m > 1").drop("m")
    lists = materialize(lists, "lists")
    release(spark)

    # Likely pairs: neighbours by minimum hash, neighbours within a group, several texts of one doc_id.
    keyed = groups.select(F.explode("low").alias("key"), F.col("n").alias("rank"), F.col("cid").alias("id"), F.col("cid").alias("label"), "sign")
    inside = groups.filter("cid <> gid").select(F.col("gid").alias("x"), F.col("cid").alias("y"))
    likely = materialize(possible(neighbours(keyed).union(inside), groups).distinct(), "pairs")
    sets = sets_of(likely, docs)
    first = rows.filter("cid IS NOT NULL").groupBy("doc_id").agg(F.min("cid").alias("x"))
    same = rows.join(first, "doc_id").filter("x < cid").select("x", F.col("cid").alias("y")).distinct()
    found = components(verify(likely, sets).union(same))
    suspects = groups.filter("cid = gid").join(sets.select("id"), F.col("gid") == F.col("id"), "left_semi").select("gid", "sign")
    shared = materialize(lists.join(suspects, "gid"), "suspects")
    discard(spark, likely)
    release(spark)

    def labelled(found: DataFrame) -> DataFrame:
        named = groups.select("cid", "gid", "n").join(found, F.col("cid") == F.col("node"), "left")
        return named.select("cid", "gid", "n", F.coalesce("component", "cid").alias("label"))

    def by_group(named: DataFrame) -> DataFrame:
        # A group whose classes are not all in one component is mixed and has a label of its own, which
        # may be that of a component too: only together with ``mixed`` do labels tell groups apart.
        mixed = F.min("label") < F.max("label")
        return named.groupBy("gid").agg(F.when(mixed, -1 - F.col("gid")).otherwise(F.min("label")).alias("label"), mixed.alias("mixed"))

    def merged(found: DataFrame, links: DataFrame) -> DataFrame:
        if links.isEmpty():
            return found
        return components(found.select(F.col("node").alias("x"), F.col("component").alias("y")).union(links))

    def unconnected(posted: DataFrame, found: DataFrame) -> DataFrame:
        # Neighbours in posting lists ``token, gid, sign`` in random order that no component has together yet.
        tagged = posted.join(by_group(labelled(found)).drop("mixed"), "gid")
        near = neighbours(tagged.select(F.col("token").alias("key"), F.xxhash64("gid", "token").alias("rank"), F.col("gid").alias("id"), "label", "sign"))
        return possible(near, groups)

    for turn in range(NEIGHBOUR_ROUNDS):
        found = merged(found, verify(unconnected(shared.filter(F.pmod("token", F.lit(PARTS)) == turn), found), sets))
        release(spark)
    discard(spark, sets)
    discard(spark, shared)
    # Once among all groups: one that was no suspect may link to a few of a large component only, and would meet every member below.
    every = lists.join(groups.filter("cid = gid").select("gid", "sign"), "gid")
    likely = materialize(unconnected(every, found), "pairs")
    sets = sets_of(likely, docs)
    found = merged(found, verify(likely, sets))
    discard(spark, likely)
    discard(spark, sets)
    release(spark)

    named = materialize(labelled(found), "labels")
    # A group of several classes, whose sets differ, has no bits.
    bits = groups.groupBy("gid").agg(F.first("n").alias("n"), F.when(F.count("*") == 1, F.first("bits")).alias("bits"))
    sized = by_group(named)
    # The groups of a component, or 0 for a mixed group, so that label and z are a key.
    z = F.when(F.col("mixed"), 0).otherwise(F.count("*")).alias("z")
    sized = sized.join(sized.groupBy("label", "mixed").agg(z), ["label", "mixed"]).drop("mixed")
    sized = materialize(sized.join(bits, "gid"), "sized")

    # Postings carry the bits folded in half.
    half = BIT_WORDS // 2
    folded = F.transform(F.slice("bits", 1, half), lambda x, i: x.bitwiseOR(F.col("bits")[i + half]))
    posted = lists.select("token", "gid").join(sized.select("gid", "n", "label", "z", folded.alias("bits")), "gid")
    held = posted.groupBy("token", F.col("label").alias("other"), F.col("z").alias("oz")).agg(
        F.count("*").alias("m"), F.min("n").alias("low"), F.max("n").alias("high"), F.first("bits").alias("by")
    )
    meets = posted.join(held, "token").filter("(z < oz OR (z = oz AND label < other)) AND 4 * n >= 3 * low AND 4 * high >= 3 * n")
    plausible = overlap("bits", "by", half).replace("nx", "n").replace("ny", "low")
    meets = meets.filter(f"oz > 1 OR 7 * {plausible} >= 3 * (n + low)")
    meets = materialize(meets.select("token", "gid", "n", "other", "oz", "m"), "meets")
    met = meets.groupBy("gid", "n", "other", "oz").agg(F.sum("m").alias("c"), F.count("*").alias("t"))
    # Beyond the shared prefix shingles, two sets share no more than what follows the prefix that ends first.
    count = "4 * least(nx, ny) >= 3 * greatest(nx, ny) AND 7 * ({} + greatest(ceil(3 * nx / 4), ceil(3 * ny / 4)) - 1) >= 3 * (nx + ny)"
    enough = f"{count} AND 7 * {overlap('bx', 'by')} >= 3 * (nx + ny)"
    mine = met.join(sized.select("gid", "bits"), "gid").select(F.col("gid").alias("x"), F.col("n").alias("nx"), "other", "oz", "c", "t", F.col("bits").alias("bx"))
    member = sized.select(F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("label").alias("other"), F.col("z").alias("oz"), F.col("bits").alias("by"))
    alone = mine.filter("oz <= 1").join(member, ["other", "oz"]).filter(enough.format("c"))
    # No member shares more than the shingles that a group shares with its whole component.
    several = mine.filter("oz > 1 AND c > oz").join(member, ["other", "oz"]).filter(enough.format("t"))
    rare = meets.join(met.filter("oz > 1 AND c <= oz").select("gid", "other", "oz"), ["gid", "other", "oz"], "left_semi")
    rare = rare.select("token", F.col("gid").alias("x"), F.col("n").alias("nx"), "other", "oz").join(
        posted.select("token", F.col("gid").alias("y"), F.col("n").alias("ny"), F.col("label").alias("other"), F.col("z").alias("oz")), ["token", "other", "oz"]
    )
    rare = rare.groupBy("x", "y", "nx", "ny").agg(F.count("*").alias("c")).filter(count.format("c"))
    pairs = alone.select("x", "y").union(several.select("x", "y")).union(rare.select("x", "y"))
    ends = named.select("gid", "cid", "label")
    left = ends.select(F.col("gid").alias("x"), F.col("cid").alias("cx"), F.col("label").alias("lx"))
    right = ends.select(F.col("gid").alias("y"), F.col("cid").alias("cy"), F.col("label").alias("ly"))
    expanded = pairs.join(left, "x").join(right, "y").filter("lx <> ly").select(F.least("cx", "cy").alias("x"), F.greatest("cx", "cy").alias("y"))
    # Classes of one group that are not connected yet: they share a prefix, so all such pairs are candidates.
    split = sized.filter("z = 0").select("gid")
    within = ends.join(split, "gid", "left_semi")
    within = within.select("gid", F.col("cid").alias("x"), F.col("label").alias("lx")).join(
        within.select("gid", F.col("cid").alias("y"), F.col("label").alias("ly")), "gid"
    ).filter("x < y AND lx <> ly").select("x", "y")
    left = materialize(expanded.union(within).distinct(), "pairs")
    sets = sets_of(left, docs)
    found = merged(found, verify(left, sets))
    discard(spark, left)
    discard(spark, sets)
    for old in (lists, groups, named, sized, meets):
        discard(spark, old)
    release(spark)
    return rows, found


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every document."""
    rows, found = link(docs)
    joined = rows.join(found, F.col("cid") == F.col("node"), "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component", "cid", "doc_id").alias("component_id"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

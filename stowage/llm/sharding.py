"""Sharding by a permutation-filled lookup table.

Every shard has a preference order over the slots of a table of prime size, a
permutation given by an offset and a stride that come from its name. The shards take
turns; each claims its most preferred free slot, until none is free. So all shards
hold the same number of slots, give or take one, and most keys stay where they are
when a shard is added or removed. A row is placed by one lookup: the slot of its key.

The table depends on parameters only. It goes out as a broadcast table of ``slots``
rows, whatever the size of the input, and the rows never move for the placement.

Cases: a null key is placed as the empty string; repeated rows and equal keys go to
the same shard; an empty input gives an empty result; columns of the input may have
any names but the two that are added, which replace columns of that name.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

SHARDS = 64
SLOTS = 4093


def _number(text: str) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def lookup_table(names: list[str], slots: int = SLOTS) -> list[int]:
    """Position in ``names`` of the shard that owns each slot."""
    if slots < 2 or any(slots % d == 0 for d in range(2, int(slots**0.5) + 1)):
        raise ValueError("the number of slots must be prime")
    if not names or len(set(names)) != len(names) or len(names) > slots:
        raise ValueError("shards need distinct names, at least one and at most as many as slots")
    offset = [_number(f"{n}/offset") % slots for n in names]
    stride = [_number(f"{n}/stride") % (slots - 1) + 1 for n in names]
    asked = [0] * len(names)
    owner = [-1] * slots
    free = slots
    while free:
        for shard in range(min(len(names), slots)):
            if not free:
                break
            while True:
                slot = (offset[shard] + asked[shard] * stride[shard]) % slots
                asked[shard] += 1
                if owner[slot] < 0:
                    owner[slot] = shard
                    free -= 1
                    break
    return owner


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """The slot of a key: 60 bits of its digest, reduced to the table."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary"))
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long") % F.lit(slots)


def table_of(spark: SparkSession, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The lookup table as rows ``slot, shard``."""
    owner = F.lit(lookup_table(names, slots))
    return spark.range(slots).select(
        F.col("id").alias("slot"), F.element_at(owner, (F.col("id") + 1).cast("int")).cast("long").alias("shard")
    )


def place(df: DataFrame, key: str, names: list[str], slots: int = SLOTS) -> DataFrame:
    """The rows of ``df`` with the columns ``slot`` and ``shard``, both long."""
    keyed = df.drop("slot", "shard").withColumn("slot", slot_of(F.col(key), slots))
    return keyed.join(F.broadcast(table_of(df.sparkSession, names, slots)), "slot").select(*keyed.columns, "shard")


def shard_names(n: int = SHARDS) -> list[str]:
    return [f"shard-{i}" for i in range(n)]


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Placement of all documents by doc_id on 64 shards."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return place(docs.select("doc_id"), "doc_id", shard_names())


ORACLE = f"""
WITH RECURSIVE shards AS (
  SELECT i, ('0x' || substr(md5('shard-' || i || '/offset'), 1, 15))::BIGINT % {SLOTS} AS o,
         ('0x' || substr(md5('shard-' || i || '/stride'), 1, 15))::BIGINT % {SLOTS - 1} + 1 AS k
  FROM range({SHARDS}) t(i)),
orders AS (SELECT list(o ORDER BY i) AS os, list(k ORDER BY i) AS ks FROM shards),
turns AS (
  SELECT 0::BIGINT AS turn, list_transform(range({SLOTS}), lambda x: -1::BIGINT) AS owner, -1::BIGINT AS claimed
  UNION ALL
  SELECT turn + 1, list_transform(owner, lambda x, p: CASE WHEN p - 1 = slot THEN turn % {SHARDS} ELSE x END), slot
  FROM (SELECT turn, owner,
               (os[turn % {SHARDS} + 1] + ks[turn % {SHARDS} + 1] * list_position(
                  list_transform(range({SLOTS}), lambda j: owner[(os[turn % {SHARDS} + 1] + j * ks[turn % {SHARDS} + 1]) % {SLOTS} + 1]),
                  -1::BIGINT) - ks[turn % {SHARDS} + 1]) % {SLOTS} AS slot
        FROM turns, orders WHERE turn < {SLOTS})),
placed AS (SELECT claimed AS slot, (turn - 1) % {SHARDS} AS shard FROM turns WHERE turn > 0)
SELECT doc_id, slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {SLOTS} AS slot FROM documents)
JOIN placed USING (slot)
"""

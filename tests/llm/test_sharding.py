from collections import Counter

import pytest

from stowage.llm.sharding import lookup_table, place, shard_names


def test_shards_hold_equal_shares():
    for n, slots in ((1, 2), (3, 7), (64, 4093), (10, 1009)):
        held = Counter(lookup_table(shard_names(n), slots))
        assert sum(held.values()) == slots and max(held.values()) - min(held.values()) <= 1


def test_few_keys_move_when_a_shard_goes():
    names = shard_names(20)
    before, after = lookup_table(names, 2003), lookup_table(names[:-1], 2003)
    moved = sum(a != b for a, b in zip(before, after, strict=True) if a != 19)
    assert moved < 0.25 * 2003


def test_bad_parameters():
    for names, slots in (([], 7), (["a", "a"], 7), (["a"], 8), (["a"] * 9, 7)):
        with pytest.raises(ValueError):
            lookup_table(names, slots)


def test_odd_rows(odd, empty):
    got = place(odd, "doc_id", shard_names())
    assert got.count() == odd.count()
    by = {}
    for r in got.collect():
        assert by.setdefault(r.doc_id, (r.slot, r.shard)) == (r.slot, r.shard)
    assert place(empty, "doc_id", shard_names()).count() == 0

import random

import pytest

from stowage.llm import suffix_dedup


def brute(rows):
    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    first = {}
    for d, (_, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(d, first.get(b[i : i + 50], d))
    out = []
    for d, (doc, t) in zip(ids, rows, strict=True):
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < d:
                gone[i : i + 50] = b"\1" * 50
        spans = sum(1 for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1]))
        out.append((doc, len(b), sum(gone), spans, bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return sorted(out, key=str)


def check(df):
    got = sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_documents(documents):
    check(documents.limit(120).select("doc_id", "text"))


def test_odd_rows(odd, empty):
    check(odd)
    assert suffix_dedup.remove_repeats(empty).count() == 0


def made(seed, alphabet, n=60):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(alphabet) for _ in range(rng.choice([30, 49, 50, 51, 70, 200]))) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages)[rng.randrange(3) :] if rng.random() < 0.6 else "".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(rng.randrange(5))]
        rows.append((i * 7 % 61, "".join(parts)))
    return rows


@pytest.mark.parametrize("alphabet", ["ab", "abcdefghijklmnop ", "é\0z"])
def test_repeats_of_all_kinds(spark, alphabet):
    check(spark.createDataFrame(made(4, alphabet), "doc_id long, text string").repartition(3))


def test_crowded_anchors_take_the_other_way(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", 3)
    check(spark.createDataFrame(made(5, "abcdefgh"), "doc_id long, text string").repartition(3))


def test_small_folds(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "AT_ONCE", 5)
    check(spark.createDataFrame(made(6, "abcdefgh"), "doc_id long, text string").repartition(2))


def test_maximal_repeats():
    a, b, c = b"x" * 3 + bytes(range(60)), b"y" * 3 + bytes(range(60)), b"z" + bytes(range(55))
    array = suffix_dedup.SuffixArray([a, b, c])
    found = {(n, tuple(sorted((int(array.row[i]), int(array.column[i])) for i in range(s, e + 1)))) for n, s, e in array.maximal_repeats()}
    assert found == {(60, ((0, 3), (1, 3))), (55, ((0, 3), (1, 3), (2, 1)))}

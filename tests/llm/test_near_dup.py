import random
import re
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import near_dup
from stowage.llm.components import components


def brute(rows):
    """Sizes and components by comparing all pairs of sets of word tuples."""
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if None in (rows[i][0], rows[j][0]):
                continue
            both = len(sets[i] & sets[j])
            if (sets[i] and 100 * both >= 75 * len(sets[i] | sets[j])) or rows[i][0] == rows[j][0]:
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(s), None if d is None else d if not s else least[find(i)]) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=str)


def check(df):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in near_dup.near_duplicates(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_documents(documents):
    check(documents.select("doc_id", "text"))


def test_odd_rows(odd, empty):
    # Here every doc_id has one text; a null one takes no part.
    check(odd.select("doc_id", "text").distinct())
    assert near_dup.near_duplicates(empty).count() == 0


def test_rows_of_one_document_link_it_by_any_text(spark):
    a, b = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen"
    rows = spark.createDataFrame([(5, a), (5, b), (3, a), (4, b), (9, "else")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id) for r in near_dup.near_duplicates(rows).collect()}
    assert got == {(5, 3), (3, 3), (4, 3), (9, 9)}


def test_near_copies_around_the_threshold(spark):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(400)]
    rows = []
    for g in range(12):
        base = [rng.choice(words) for _ in range(rng.choice([6, 20, 80, 150]))]
        for _ in range(14):
            t = list(base)
            for _ in range(rng.randrange(0, 4)):
                at = rng.randrange(len(t))
                t[at : at + rng.randrange(2)] = [rng.choice(words)]
            rows.append((len(rows) * 3 % 1001, " ".join(t)))
    check(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)]
    up = {}

    def find(i):
        up.setdefault(i, i)
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "x long, y long")).collect()}
    assert got == {i: find(i) for i in up if find(i) != i}
    assert components(spark.createDataFrame([], "x long, y long")).count() == 0


@pytest.mark.parametrize(("few", "writes"), [(0, None), (3000, 2)])
def test_few_links_are_joined_up_without_rounds(spark, monkeypatch, few, writes):
    module = sys.modules[components.__module__]
    made, write = [], module.materialize
    monkeypatch.setattr(module, "FEW", few)
    monkeypatch.setattr(module, "materialize", lambda df, *a: made.append(a) or write(df, *a))
    rng = random.Random(3)
    links = [(rng.randrange(-900, 900), rng.randrange(-900, 900)) for _ in range(800)] + [(5000 - i, 4999 - i) for i in range(60)] + [(7, 7), (2**62, -(2**62))]
    up = {}

    def find(i):
        while up.setdefault(i, i) != i:
            i = up[i]
        return i

    for a, b in links:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = components(spark.createDataFrame(links, "x long, y long").repartition(3))
    assert sorted(map(tuple, got.collect())) == sorted((i, find(i)) for i in up if find(i) != i)
    assert got.schema.simpleString() == "struct<node:bigint,component:bigint>"
    assert len(made) == writes if writes else len(made) > 2


def test_order_does_not_change_the_result(spark, documents, monkeypatch):
    rows = documents.select("doc_id", F.col("text"))
    usual = sorted(map(tuple, near_dup.near_duplicates(rows).collect()))
    monkeypatch.setattr(near_dup, "NEIGHBOUR_ROUNDS", 1)
    assert sorted(map(tuple, near_dup.near_duplicates(rows.repartition(7)).collect())) == usual


@pytest.mark.parametrize(("a", "b", "c", "n"), [(-30, -20, -10, 90), (4, 6, -5, 86), (-5, 6, 4, 86), (10, 20, 30, 90), (-(2**63), 2**63 - 1, 5, 90)])
def test_last_step_is_exact_for_any_ids(spark, monkeypatch, a, b, c, n):
    # Three texts whose rarest shingles are the same; the second and third link. No likely pairs.
    shared, first, second, third = ([f"{x}{i}" for i in range(m)] for x, m in (("p", 30), ("a", 60), ("b", 60), ("c", 5)))
    rows = [(a, shared + first), (b, shared + second), (c, (shared + second[:55] + third)[:n])]
    common = np.ones(near_dup.CELLS, np.uint16)
    common[near_dup._cell(near_dup.shingles(" ".join(shared).encode(), near_dup.WordHashes()))] = 0
    monkeypatch.setattr(near_dup, "commonness", lambda docs: common)
    monkeypatch.setattr(near_dup, "neighbours", lambda df: df.select(F.col("id").alias("x"), F.col("id").alias("y")).limit(0))
    check(spark.createDataFrame([(i, " ".join(t)) for i, t in rows], "doc_id long, text string"))

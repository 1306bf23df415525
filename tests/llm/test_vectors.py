import math

import numpy as np
import pytest

from stowage.llm import one_bit, topk

SCHEMA = "vec_id long, embedding array<float>, label int, score long, rank int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, 1, 1) for i, v in rows], SCHEMA)


def data(n, d, seed=0, step=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(max(1, n // 20), d))
    x = middle[rng.integers(0, len(middle), n)] + 0.5 * rng.normal(size=(n, d))
    return [(i * step, [float(np.float32(v)) for v in row / np.linalg.norm(row)]) for i, row in enumerate(x)]


def brute_top(rows, every, k):
    ids, x = np.array([i for i, _ in rows]), np.floor(256 * np.array([v for _, v in rows]))
    out = []
    for i in np.flatnonzero(ids % every == 0):
        s = x @ x[i]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != ids[i]][:k]
        out += [(int(ids[i]), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


@pytest.mark.parametrize(("n", "d"), [(1, 4), (4, 3), (300, 8), (1200, 64)])
def test_top_k_is_exact(spark, n, d):
    rows = data(n, d)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows).repartition(3), 5, 5).collect())
    assert got == brute_top(rows, 5, 5)


def test_ties_go_to_the_smaller_id(spark):
    rows = [(i, [0.5, 0.25] if i % 2 else [0.25, 0.5]) for i in range(40)]
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows), 10, 5).collect())
    assert got == brute_top(rows, 10, 5)


def test_several_passes(spark, monkeypatch):
    from stowage.llm import vectors

    monkeypatch.setattr(vectors, "PASS_BYTES", 2000)
    rows = data(400, 8, 3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows), 5, 5).collect())
    assert got == brute_top(rows, 5, 5)


ODD = [(0, None), (50, []), (100, [1.0, None]), (150, [float("nan"), 1.0]), (200, [float("inf"), 1.0]), (250, [0.0, 0.0]), (300, [1.0, 2.0]), (300, [1.0, 2.0]), (350, [1.0, 2.0, 3.0]), (400, [3.0, 1.0]), (None, [1.0, 1.0]), (401, [-1.0, 2.5])]


def test_odd_vectors(spark):
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, ODD)).collect())
    one = 256 * 256
    assert [g for g in got if g[0] == 250] == [(250, 1, 300, 0), (250, 2, 300, 0), (250, 3, 400, 0), (250, 4, 401, 0)]
    assert [g for g in got if g[0] == 300] == [(300, 1, 400, 5 * one), (300, 2, 401, 4 * one), (300, 3, 250, 0)]
    assert {g[0] for g in got} == {250, 300, 400}
    assert topk.top_k(table(spark, [])).count() == 0
    near = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in one_bit.nearest(table(spark, ODD)).collect())
    assert near == [(300, 1, 401, 2.0615528128088303), (300, 2, 400, 2.23606797749979), (400, 1, 300, 2.23606797749979), (400, 2, 300, 2.23606797749979), (400, 3, 401, 4.272001872658765)]
    assert one_bit.nearest(table(spark, [])).count() == 0


@pytest.mark.parametrize(("n", "d"), [(30, 5), (2000, 64), (1500, 100)])
def test_recall_and_distances(spark, n, d):
    rows = data(n, d, 5, 10)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    found = {}
    for r in one_bit.nearest(table(spark, rows).repartition(3)).collect():
        found.setdefault(r.query_id, []).append((r.rank, r.score, r.vec_id))
    hits = total = 0
    for i in np.flatnonzero(ids % 100 == 0):
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = [j for j in np.lexsort((ids, dist)) if j != i][:10]
        mine = sorted(found[ids[i]])
        assert [m[0] for m in mine] == list(range(1, len(order) + 1)) and mine == sorted(mine, key=lambda m: (m[1], m[2]))
        assert all(abs(m[1] - dist[np.flatnonzero(ids == m[2])[0]]) < 1e-12 for m in mine)
        hits += len({m[2] for m in mine} & set(ids[order].tolist()))
        total += len(order)
    assert hits >= 0.9 * total


def brute_whole(rows, every, k):
    """The best in Python's integers; rows are repeated neither by id nor by vector."""
    whole = {i: [math.floor(256 * x) for x in v] for i, v in rows}
    out = []
    for i in sorted(whole):
        if i % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(whole[i], w, strict=True)), j) for j, w in whole.items() if j != i)
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(scores[:k])]
    return out


def test_large_components_and_many_dimensions_are_exact(spark):
    def top(rows, every):
        return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows).repartition(3), every, 5).collect())

    rows = data(300, 8)
    rows[7], rows[10] = (7, [40000.0] * 8), (10, [-40000.0, 50000.0] * 4)
    got = top(rows, 5)
    assert got == brute_whole(rows, 5, 5) and {q for q, *_ in got} >= {10} and any(j == 7 for _, _, j, _ in got)

    # Sums pass 2**53, and scores differ by less than doubles there tell apart.
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in np.float32(30000 + rng.integers(0, 2, 512) / 256)]) for i in range(120)]
    assert top(rows, 5) == brute_whole(rows, 5, 5)
    rows = [(i, [float(x) for x in np.float32(rng.normal(size=16) * 2.0 ** rng.integers(-8, 21))]) for i in range(400)]
    assert top(rows, 5) == brute_whole(rows, 5, 5)


def test_scores_beyond_64_bits_fail(spark):
    rows = [(0, [1e30, 1.0]), (1, [1e30, 1.0]), (2, [1.0, 1.0])]
    with pytest.raises(Exception, match="does not fit 64 bits"):
        topk.top_k(table(spark, rows)).collect()
    # Those that are not among the best do no harm.
    rows = [(0, [1e30, 1.0]), *((i, [-1e30, 1.0]) for i in range(1, 4)), *((i, [0.0, float(i)]) for i in range(4, 9))]
    assert [(r.vec_id, r.score) for r in topk.top_k(table(spark, rows)).orderBy("rank").collect()] == [(i, 65536 * i) for i in range(8, 3, -1)]


def test_all_vectors_of_a_repeated_id_are_searched(spark, monkeypatch):
    duckdb = pytest.importorskip("duckdb")
    from stowage.llm import vectors

    rows = [(i % 60, v) for i, v in data(200, 6, 9)]
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    con.executemany("INSERT INTO embeddings VALUES (?, ?)", rows)
    want = sorted(con.sql(topk.ORACLE).fetchall())
    near = []
    for i in (0, 100):
        ranked = sorted((np.sqrt(((np.array(v) - np.array(w)) ** 2).sum()), j) for q, v in rows for j, w in rows if q == i and j != i)[:10]
        near += [(i, r + 1, j, pytest.approx(d, abs=1e-9)) for r, (d, j) in enumerate(ranked)]
    for size in (vectors.PASS_BYTES, 100):
        monkeypatch.setattr(vectors, "PASS_BYTES", size)
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(table(spark, rows)).collect()) == want
        assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in one_bit.nearest(table(spark, rows)).collect()) == near


def blocks(rows, size):
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    return ids, x, [slice(a, a + size) for a in range(0, len(rows), size)]


def test_reading_stops_before_the_end_in_first_and_later_blocks():
    from stowage.llm.vectors import Best

    ids, x, parts = blocks(data(2000, 64), 1000)
    asked = ids % 50 == 0
    best, nra = Best(int(asked.sum()), 5, np.int64), topk.NoRandomAccess(5)
    for part in parts:
        nra.stopped.clear()
        nra.run(ids[asked], x[asked], ids[part], x[part], [], best)
        assert sum(n for depth, n in nra.stopped.items() if depth < 1) >= 0.9 * asked.sum()


def test_few_pairs_are_reranked():
    from stowage.llm.vectors import Best

    ids, x, parts = blocks(data(10_000, 64, 5), 2500)
    asked = ids % 100 == 0
    search, best = one_bit.OneBit(64, x.mean(axis=0), 10), Best(int(asked.sum()), 10)
    for part in parts:
        search.run(ids[asked], x[asked], ids[part], x[part], search.code(x[part]), best)
    hits = 0
    for at, i in enumerate(np.flatnonzero(asked)):
        dist = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        dist[i] = np.inf
        hits += len(set(best.ident[at].tolist()) & set(ids[np.lexsort((ids, dist))[:10]].tolist()))
    assert search.looked == asked.sum() * len(ids)
    assert search.measured <= 0.05 * search.looked and hits >= 0.9 * 10 * asked.sum()


def test_products_with_codes_are_near_the_exact_ones():
    rng = np.random.default_rng(3)
    turned, signs = rng.normal(size=(7, 128)), rng.normal(size=(50, 128)) >= 0
    words = np.packbits(signs, axis=1, bitorder="little").view(np.uint64).T
    planes = one_bit.Planes(turned)
    got = planes.products(np.ascontiguousarray(words), signs.sum(axis=1))
    rounded = planes.least[:, None] + planes.step[:, None] * np.rint((turned - planes.least[:, None]) / planes.step[:, None])
    assert np.allclose(got, rounded @ (2.0 * signs.T - 1))


def test_best_lists():
    from stowage.llm.vectors import Best

    rng = np.random.default_rng(8)
    best, every = Best(6, 3, np.int64), []
    for _ in range(20):
        rows = [(int(q), int(i), int(s)) for q, i, s in zip(rng.integers(0, 5, 4), rng.integers(0, 99, 4), rng.integers(-4, 4, 4), strict=True)]
        every += rows
        best.add(*(np.array(c) for c in zip(*rows, strict=True)))
    want = [(q, i, s) for q in range(6) for s, i in sorted((-s, i) for p, i, s in every if p == q)[:3] for s in [-s]]
    assert list(zip(*(c.tolist() for c in best.rows()), strict=True)) == want
    assert best.least().tolist()[5] == -np.inf

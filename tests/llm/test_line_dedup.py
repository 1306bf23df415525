import numpy as np

from stowage.llm import line_dedup


def test_index_is_minimal_and_perfect():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 1000, 50_000):
        h1, h2 = rng.integers(0, 2**63, (2, n)).astype(np.uint64)
        sizes, words = line_dedup.build_index(h1, h2)
        at = line_dedup.probe_index(sizes, words, h1, h2)
        assert sorted(at.tolist()) == list(range(n))
    # One half of the key may agree.
    h1, h2 = np.zeros(500, np.uint64), np.arange(500, dtype=np.uint64)
    sizes, words = line_dedup.build_index(h1, h2)
    assert sorted(line_dedup.probe_index(sizes, words, h1, h2).tolist()) == list(range(500))


def brute(rows):
    def key(line):
        k = line.strip(" \t\n\x0b\x0c\r")
        return "".join(c.lower() if c.isascii() else c for c in k)

    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    first, many = {}, {}
    for d, (_, t) in zip(ids, rows, strict=True):
        for line in (t or "").split("\n"):
            if len(key(line)) >= 10:
                first[key(line)] = min(d, first.get(key(line), d))
                many.setdefault(key(line), set()).add(d)
    out = []
    for d, (doc, t) in zip(ids, rows, strict=True):
        lines = (t or "").split("\n")
        stay = [x for x in lines if len(key(x)) < 10 or len(many[key(x)]) < 2 or first[key(x)] == d]
        out.append((doc, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=str)


def check(df):
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == brute([(r.doc_id, r.text) for r in df.collect()])


def test_odd_rows(odd, empty):
    check(odd)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert set(line_dedup.dedup_lines(odd).columns) == set(odd.columns) | {"n_lines", "n_dropped"}


def test_heavy_lines_take_the_other_way(spark, documents, monkeypatch):
    monkeypatch.setattr(line_dedup, "HEAVY_LEAST", 3)
    rows = spark.createDataFrame([(i, f"the very common line\nown line number {i}\nthe very common line") for i in range(50)], "doc_id long, text string")
    index = line_dedup.index_lines(rows)
    # The shards were built with the usual bound; a lower one for the table finds what they noted.
    assert index.agg({"n_keys": "sum"}).first()[0] == 51
    check(rows)
    big = spark.range(1500).selectExpr("id AS doc_id", "concat('the very common line\n', id % 700, ' some other line') AS text")
    check(big)

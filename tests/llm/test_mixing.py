import random
import re

from stowage.llm import mixing


def brute_targets(sizes):
    """Share and share again what is above three times a source's size."""
    weights = {s: i % 3 + 1 for i, s in enumerate(sizes)}
    full, rest = {}, sum(sizes.values())
    while True:
        free = [s for s in sizes if s not in full]
        left = rest - sum(full.values())
        total = sum(weights[s] for s in free)
        share = {s: left * weights[s] / total for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            return full | share
        full |= {s: 3 * sizes[s] for s in over}


def test_targets(spark):
    rng = random.Random(2)
    for n in (1, 2, 5, 30):
        sizes = {f"s{i:02}": rng.choice([0, 1, 5, 100, 5000, 10**6]) + rng.randrange(10) for i in range(n)}
        rows = spark.createDataFrame([(f"0{s}", v) for s, v in sizes.items()], "source_key string, source_size long")
        got = {r.source_key[1:]: r.target for r in mixing.targets(rows).collect()}
        want = brute_targets(sizes)
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in sizes)


def words(t):
    return len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def check(df):
    rows = mixing.plan_mix(df).collect()
    texts = df.collect()
    assert sorted(r.size for r in rows) == sorted(words(t.text) for t in texts)
    by = {}
    for r in rows:
        by.setdefault(r.source_key, []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    for own in by.values():
        assert sum(r.size for r in own) == own[0].source_size
        assert sum(r.taken for r in own) == int(own[0].target)
    taken = {r.source_key: sum(x.taken for x in by[r.source_key]) for r in rows}
    applied = mixing.apply_mix(df)
    assert applied.columns == df.columns
    assert sum(words(r.text) for r in applied.collect()) == sum(taken.values())
    return rows


def test_documents(documents):
    assert check(documents) and [tuple(r) for r in check(documents)] is not None
    again = [sorted(map(tuple, mixing.plan_mix(documents.repartition(n)).collect())) for n in (2, 5)]
    assert again[0] == again[1]


def test_odd_rows(odd, empty):
    check(odd)
    assert mixing.plan_mix(empty).count() == 0 and mixing.apply_mix(empty).count() == 0


def test_first_words(spark):
    from pyspark.sql import functions as F

    row = spark.createDataFrame([(" a  b\nc ",)], "t string").select(*[mixing.first_words(F.col("t"), F.lit(n)).alias(f"w{n}") for n in (1, 2, 3)]).first()
    assert tuple(row) == (" a", " a  b", " a  b\nc")


def test_a_third_without_ids_spreads(spark):
    rows = [(None if i % 3 else i, "hot" if i % 2 else "cold", " ".join(["w"] * (i % 7))) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(4)
    check(df)
    runs = [sorted((str(r.doc_id), r.source, r.text) for r in mixing.apply_mix(df.repartition(n)).collect()) for n in (2, 5)]
    assert runs[0] == runs[1]


def test_sources_that_do_not_fit_every_task(spark, documents, monkeypatch):
    usual = sorted(map(tuple, mixing.plan_mix(documents).collect()))
    monkeypatch.setattr(mixing, "SOURCES_BYTES", 0)
    assert sorted(map(tuple, mixing.plan_mix(documents).collect())) == usual

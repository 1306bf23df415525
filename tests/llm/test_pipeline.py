import pytest

import corpus_pipeline
import __spark_entry__ as driver
from stowage import session
from stowage.llm import labelled, near_dup, quality


def test_stages_follow_each_other(spark, small, documents):
    docs = documents
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, small).cache()
        if i + 1 < len(corpus_pipeline.STAGES):
            assert out.columns == documents.columns
        if name == "quality":
            kept = {r.doc_id for r in out.collect()}
            scores = quality.score(docs, quality.train(docs, spark.read.parquet(f"{small}/labels.parquet"))).collect()
            assert kept == {r.doc_id for r in scores if r.score >= quality.THRESHOLD}
        if name == "line_dedup":
            assert out.count() == docs.count()
            assert all(r.n_chars == len(r.text) for r in out.collect())
        if name == "near_duplicates":
            groups = {}
            for r in near_dup.near_duplicates(docs).collect():
                groups.setdefault(r.component_id, []).append(r.doc_id)
            assert sorted(r.doc_id for r in out.collect()) == sorted(min(g) for g in groups.values())
        if name == "packing":
            assert {r.doc_id for r in out.collect()} == {r.doc_id for r in docs.collect()}
        docs = out


def test_registered_and_repeatable(spark, small):
    names = set(driver.queries())
    assert {f"op{n}" for n in range(1, 11)} == {n.split("_")[0] for n in names if n.startswith("op") and n[2].isdigit()}
    runs = [sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in driver.queries()["pipeline"](spark, small).collect()) for _ in range(2)]
    assert runs[0] and {r[0] for r in runs[0]} == {r[0] for r in runs[1]}


def test_stages_take_odd_rows(spark, small, odd, empty):
    for table in (odd, empty):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, table, small)
            assert out.count() <= 60 * odd.count()


def test_sample_is_bounded(documents, spark, small):
    labels = spark.read.parquet(f"{small}/labels.parquet")
    assert labelled.training_rows(documents, labels, "quality", 10).count() == 10


def test_repeated_ids_are_judged_by_row(spark, small):
    a, b, c = "one two three four five six seven eight", "nine ten eleven twelve thirteen fourteen", "some other text of its own words"
    rows = [(5, a, "x"), (5, c, "x"), (5, b, "z"), (5, b, "y"), (5, "", "x"), (5, "", "x"), (3, a, "x"), (7, b, "x"), (8, None, "x"), (8, None, "y"), (9, "", "x"), (None, a, "x"), (None, a, "x")]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    want = sorted([(5, c, "x"), (5, b, "y"), (5, "", "x"), (3, a, "x"), (8, None, "x"), (9, "", "x"), (None, a, "x"), (None, a, "x")], key=str)
    for n in (1, 4):
        assert sorted(map(tuple, corpus_pipeline.drop_near_duplicates(spark, table.repartition(n), small).collect()), key=str) == want


def test_counts_of_the_caller_stay(spark, small):
    table = spark.createDataFrame([(1, "a line that is long\nb", 99, "x"), (2, "a line that is long\nc", 98, "y")], "doc_id long, text string, n_lines long, n_dropped string")
    got = sorted(map(tuple, corpus_pipeline.drop_lines(spark, table, small).collect()))
    assert got == [(1, "a line that is long\nb", 99, "x"), (2, "c", 98, "y")]


def test_release_gives_native_memory_back(spark, monkeypatch):
    said = session.trim(spark)
    if said is None:
        pytest.skip("this JVM has no command for it")
    assert said.startswith("Trim native heap")
    asked = []
    monkeypatch.setattr(session, "trim", asked.append)
    session.release(spark)
    assert asked == [spark]

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.llm import labelled, quality, toxicity

BIGGER = "/root/testdata/sf0.01"


def auc(score, y):
    rank = np.argsort(np.argsort(score, kind="stable"), kind="stable") + 1
    ones = y == 1
    return (rank[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())


@pytest.mark.parametrize(("module", "label", "least"), [(quality, "quality", 0.95), (toxicity, "toxic", 0.75)])
def test_held_out_rows(spark, small, module, label, least):
    docs, labels = (spark.read.parquet(f"{BIGGER}/{t}.parquet") for t in ("documents", "labels"))
    model = module.train(docs, labels)
    scored = module.score(docs, model).join(labels, "doc_id").filter(labelled.held_out(F.col("doc_id"))).select("score", label).toPandas()
    assert scored.score.between(0, 1).all()
    assert auc(scored.score.to_numpy(), scored[label].to_numpy()) >= least


@pytest.mark.parametrize("module", [quality, toxicity])
def test_odd_rows(spark, odd, empty, documents, labels, module):
    model = module.train(documents, labels)
    got = module.score(odd, model)
    rows = got.collect()
    assert set(got.columns) == set(odd.columns) and len(rows) == odd.count()
    by = {}
    for r in rows:
        assert 0 <= r.score <= 1 and by.setdefault(r.text, r.score) == r.score
    assert by[None] == by[""]
    assert module.score(empty, model).count() == 0


@pytest.mark.parametrize(("module", "label"), [(quality, "quality"), (toxicity, "toxic")])
def test_few_or_no_labels(spark, documents, labels, module, label):
    for some in (labels.limit(0), labels.withColumn(label, F.lit(1)), labels.withColumn(label, F.lit(None).cast("int")), labels.limit(7)):
        model = module.train(documents, some, label)
        assert module.score(documents.limit(3), model).filter("score BETWEEN 0 AND 1").count() == 3
    assert module.score(documents.limit(3), module.train(documents.limit(0), labels, label)).count() == 3


def test_held_out_labels_are_never_read(spark, documents, labels):
    fold = labelled.held_out(F.col("doc_id"))
    assert labelled.training_rows(documents, labels, "quality").filter(fold).count() == 0
    flipped = labels.withColumn("quality", F.when(fold, 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = quality.train(documents, labels), quality.train(documents, flipped)
    assert all((x == y).all() for x, y in zip(a.tables, b.tables, strict=True))


def test_isotonic():
    x, y = toxicity.isotonic(np.array([0.0, 1, 2, 3, 4, 5]), np.array([0, 1, 0, 1, 1, 1]))
    assert (np.diff(y) >= 0).all() and (np.diff(x) > 0).all()


def test_words_behind_signs():
    assert toxicity.plain("St*pid!!") == ("stpid", True)
    assert toxicity.plain("1diot") == ("1diot", False)
    assert toxicity.plain("w0rthle55s.") == ("worthlesss", True)
    assert toxicity.plain("Über,") == ("über", False)


def test_pair_interactions_are_found():
    rng = np.random.default_rng(0)
    x = rng.random((3000, 3))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    model = quality.fit(x, y)
    assert (1, 0) in {(i, j) for i, j, _ in model.pairs}
    assert auc(model.scores(x), y) > 0.95


def test_scores_do_not_depend_on_kept_words(spark, documents, labels, monkeypatch):
    model = toxicity.train(documents, labels)
    some = [("you idiot fine day then",), ("you stupid fool, you worthless idiot " * 3,), (" ".join(f"w{i}" for i in range(50)) + " you idiot",)]
    rows = spark.createDataFrame([(i, t) for i, (t,) in enumerate(some * 2)], "doc_id long, text string")
    usual = {r.doc_id: r.score for r in toxicity.score(rows, model).collect()}
    lexicon = {"idiot": 5.0, "fool": 3.0}
    vectors = [toxicity.text_features(t.encode(), toxicity._Weights(lexicon)) for (t,) in some]
    monkeypatch.setattr(toxicity, "KEPT_WORDS", 3)
    weights = toxicity._Weights(lexicon)
    assert [toxicity.text_features(t.encode(), weights) for (t,) in some] == vectors
    assert vectors[0][toxicity.FEATURES.index("near_you")] == 0.2
    for n in (1, 3):
        assert {r.doc_id: r.score for r in toxicity.score(rows.repartition(n), model).collect()} == usual


def test_repeated_ids_keep_the_sample_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(300)] + [(1, None), (2, "b"), (3, None), (4, "d")], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 5)], "doc_id long, quality int")
    inside = {i for i in range(1, 5) if not spark.range(1).select(labelled.held_out(F.lit(i))).first()[0]}
    rows = {r.doc_id: r.text for r in labelled.training_rows(docs, labels, "quality", 10).collect()}
    assert rows == {i: t for i, t in {1: "text 0", 2: "b", 3: None, 4: "d"}.items() if i in inside}
    assert labelled.training_rows(docs, labels, "quality", 2).count() <= 2

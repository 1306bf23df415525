"""The corpus pipeline: filter by quality, drop repeated lines, drop near duplicates, mix, pack.

Each stage takes the documents that the stage before it kept and returns documents of
the same columns; the last returns pieces of sequences. Stages are written between, so
each can be run again by itself after a failure.

Cases: every stage takes null and empty texts, null and repeated doc_ids, and an empty
table, for which it returns an empty one. But for near duplicates, which its function
describes, rows of one doc_id are rows by themselves. Columns besides the text and its number of
characters pass through untouched, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from stowage.llm import line_dedup, mixing, near_dup, packing, quality
from stowage.operators import order
from stowage.session import materialize, ship


def _like(docs: DataFrame, before: DataFrame) -> DataFrame:
    """The columns of ``before``; the number of characters follows the text."""
    if "n_chars" in before.columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(before.schema["n_chars"].dataType))
    return docs.select(*before.columns)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, fitted on labelled ones among them, does not reject.

    Null and empty texts are scored like any other. Without labels of both kinds the score is
    their share of 1, or 0.5 without any, so all documents stay or all go.
    """
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = quality.score(docs, model, "__quality")
    return scored.filter(F.col("__quality") >= quality.THRESHOLD).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each line only in the first that holds it.

    A null text becomes an empty one. Lines of rows with the same doc_id, or without one, don't repeat
    each other: a line goes only where a smaller doc_id holds it.
    """
    return _like(line_dedup.dedup_lines(docs, ("__lines", "__lines_dropped")), docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group; documents without words or doc_id stay.

    Where a doc_id repeats, rows are documents: each is judged by its own text, and
    those of one doc_id rank by a hash of it. Of rows with the same doc_id and text the
    first by the other columns stays.
    """
    if docs.filter("doc_id IS NOT NULL").groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _first_of_groups(docs, "doc_id").select(*docs.columns)
    known = docs.filter("doc_id IS NOT NULL")
    ranked = Window.partitionBy("doc_id", "text").orderBy(*docs.columns)
    once = known.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1").drop("__rank")
    once = order.number(once, [F.col("doc_id"), F.sha2("text", 256)], "__place")
    return _first_of_groups(once, "__place").select(*docs.columns).union(docs.filter("doc_id IS NULL"))


def _first_of_groups(docs: DataFrame, key: str) -> DataFrame:
    """The rows of a unique ``key`` that is the smallest of its group, and those without words or key."""
    rows, found = near_dup.link(docs.select(F.col(key).alias("doc_id"), "text"))
    dropped = rows.join(found, F.col("cid") == F.col("node"), "left").filter("doc_id <> coalesce(component, cid)").select(F.col("doc_id").alias(key)).distinct()
    return docs.join(dropped, key, "left_anti")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, repeated as often as it takes them.

    Documents without words take no share and are not in the mix; a null source is one too.
    """
    return _like(mixing.apply_mix(docs), docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of token ids; a document without text has its closing id."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", keep_quality),
    ("line_dedup", drop_lines),
    ("near_duplicates", drop_near_duplicates),
    ("mixing", mix_sources),
    ("packing", pack),
]

#: The quality model and the tokenizer are beyond SQL; the tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{name}")
    return docs

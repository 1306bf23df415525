import pytest

import __spark_entry__ as driver
from stowage.plans import registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    same_rows(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])


def test_blake3_members_match_whole_messages(spark, small):
    from stowage.functions.blake3 import digests
    from stowage.session import table

    got = {r.doc_id: r.digest for r in registry.QUERIES["member_digest_blake3"](spark, small).collect()}
    docs = table(spark, small, "documents").filter("text <> ''").select("doc_id", "text").collect()
    want = dict(zip((r.doc_id for r in docs), (d.hex() for d in digests([r.text.encode() for r in docs])), strict=True))
    assert got == want


def test_blake3_of_members_without_bytes(spark, tmp_path):
    rows = [(1, "abc"), (2, ""), (3, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.digest for r in registry.QUERIES["member_digest_blake3"](spark, str(tmp_path)).collect()}
    empty = "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    assert got == {1: "6437b3ac38465133ffb63b75273a8db548c558465d79db03fd359c6cd5bd9d85", 2: empty, 3: empty}


def test_entry_runs(spark, small):
    assert driver.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_results_do_not_depend_on_partitions(spark, small):
    rows = [tuple(r) for r in registry.QUERIES["all_errors"](spark, small).collect()]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "11")
        again = [tuple(r) for r in registry.QUERIES["all_errors"](spark, small).collect()]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(rows, key=str) == sorted(again, key=str)

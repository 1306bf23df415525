import pytest
from pyspark.sql import Row

#: Texts that break things: nothing, white space, marks, controls, long words, long texts, other scripts.
ODD = [
    None, "", " ", "\n", "\n\n", "a", "a b c d", "a b c d e", "A b C d E", "\0\0\0", "x" * 300, "word " * 5000, "é" * 60, "漢字かな " * 40, "a\x1cb\x85c d",
    "it's we'll 3.14 $$$. “quoted.” <|endoftext|>. <|ENDOFTEXT|> éa. İstanbul ", "line one is long\nline one is long\nshort\n  LINE ONE IS LONG\t",
]


@pytest.fixture(scope="session")
def odd(spark):
    """Odd texts, each twice under different ids and once more as the same row, nulls everywhere, and columns whose names clash."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, score double, size long, kept string, n_lines long, rank int, slot int, doc long, a long, n long, x long"
    rows = []
    for i, t in enumerate(ODD):
        for d in (i, 100 + i, i, None):
            rows.append(Row(d, t, None, [None, "s", "t"][i % 3], None, None, 7, "k", None, 1, 2, 3, 4, 5, 6))
    return spark.createDataFrame(rows, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="session")
def labels(spark, small):
    return spark.read.parquet(f"{small}/labels.parquet")

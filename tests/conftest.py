import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)


@pytest.fixture(scope="session")
def spark():
    from stowage.session import local_session, ship

    session = local_session("4", 4)
    session.sparkContext.setLogLevel("ERROR")
    ship(session)
    return session


@pytest.fixture(scope="session")
def small():
    """The smallest driver tables."""
    path = "/root/testdata/sf0.001"
    if not os.path.isdir(path):
        pytest.skip("the driver's tables are not here")
    return path


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        table = name.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{small}/{name}'")
    return con


def same_rows(df, con, sql):
    """Compare a query's rows with those of its SQL, whatever their order."""
    columns = sorted(df.columns)

    def text(x):
        if isinstance(x, (bytes, bytearray)):
            return bytes(x).hex()
        return repr(round(x, 9)) if isinstance(x, float) else str(x)

    got = sorted(tuple(text(r[c]) for c in columns) for r in df.collect())
    rel = con.sql(sql)
    assert sorted(rel.columns) == columns
    order = [rel.columns.index(c) for c in columns]
    want = sorted(tuple(text(r[i]) for i in order) for r in rel.fetchall())
    assert got == want

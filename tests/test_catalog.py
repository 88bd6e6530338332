"""Every query with SQL is compared with DuckDB on the smallest tables; the others must run."""

import duckdb
import pytest

from ravelin import catalog
from tests.conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{TESTDATA}/{t}.parquet'")
    return c


def cell(v):
    return round(v, 9) if isinstance(v, float) else str(v) if hasattr(v, "isoformat") else v


def sorted_rows(rows):
    return sorted((tuple(cell(v) for v in r) for r in rows), key=lambda r: tuple(map(str, r)))


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_equals_sql(spark, db, name):
    df = catalog.QUERIES[name](spark, TESTDATA)
    want = db.sql(catalog.ORACLES[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    got = sorted_rows(df.select(*columns).collect())
    assert got == sorted_rows(want.project(", ".join(f'"{c}"' for c in columns)).fetchall())
    assert got


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, TESTDATA)
    assert df.count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0

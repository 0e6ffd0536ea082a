"""Every registered query against DuckDB on the smallest tables."""

import duckdb
import pytest

from tessera import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def rows(frame):
    cols = sorted(frame.columns)
    plain = frame[cols].astype(object).where(frame[cols].notna(), None)
    return cols, sorted(map(str, plain.values.tolist()))


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, db, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    assert name in catalog.ORACLES
    assert rows(got) == rows(db.execute(catalog.ORACLES[name]).df())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

"""Every registered query of the library against its SQL in DuckDB."""

import os

import duckdb
import pytest

from lectern.plans import catalog

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="session")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canonical(rows):
    return sorted(tuple("<null>" if v is None else repr(round(v, 6)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, sf_dir, duck, name):
    got = catalog.queries()[name](spark, sf_dir)
    columns = sorted(got.columns)
    rows = got.select(*columns).collect()
    sql = catalog.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    want = duck.sql(f"SELECT {', '.join(columns)} FROM ({sql})").fetchall()
    assert canonical(rows) == canonical(want)


def test_columns_have_names():
    assert all(sql.strip() for sql in catalog.oracle_sql().values()) and set(catalog.oracle_sql()) <= set(catalog.queries())

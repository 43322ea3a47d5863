"""Every registered query of the library against its SQL in DuckDB."""

from __future__ import annotations

import datetime
from pathlib import Path

import duckdb
import pytest

from quarry.plans import catalog

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in sorted(Path(FOLDER).glob("*.parquet")):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


def plain(v):
    return repr(v.replace(tzinfo=None)) if isinstance(v, datetime.datetime) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    columns = sorted(df.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in df.collect())
    if name not in catalog.ORACLE:
        assert rows
        return
    cursor = duck.execute(catalog.ORACLE[name])
    names = [x[0] for x in cursor.description]
    assert sorted(names) == columns
    assert rows == sorted([plain(r[names.index(c)]) for c in columns] for r in cursor.fetchall())


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())

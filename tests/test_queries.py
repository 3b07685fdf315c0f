"""Every registered query of the table operators against its SQL in DuckDB, on the smallest tables."""

import math
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from tablewarden import queries as q

DATA = "/root/testdata/sf0.001"


def norm(v):
    if isinstance(v, Decimal):
        v = float(v)
    return ("nan" if math.isnan(v) else round(v, 6)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    df = q.QUERIES[name](spark, DATA)
    columns = sorted(df.columns)
    ours = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=repr)
    relation = duck.sql(q.ORACLE_SQL[name])
    names, rows = relation.columns, relation.fetchall()
    assert sorted(names) == columns
    assert ours == sorted((tuple(norm(dict(zip(names, r))[c]) for c in columns) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(set(q.QUERIES) - set(q.ORACLE_SQL)))
def test_runs(spark, name):
    df = q.QUERIES[name](spark, DATA)
    assert df.columns
    df.collect()


def test_entry_imports_and_lists_queries():
    import __spark_entry__ as entry

    assert set(q.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())

"""Every registered query against its SQL in DuckDB on the smallest tables."""

import math

import duckdb
import pytest

from pulseloom.plans import oracles, queries

SF = "/root/testdata/sf0.001"
TYPES = {"bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


def plain(v):
    return (None if math.isnan(v) else round(v, 9)) if isinstance(v, float) else v


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "orders"):
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(queries.queries()))
def test_equals_sql(spark, con, name):
    df = queries.queries()[name](spark, SF)
    cols = sorted(df.columns)
    found = sorted([tuple(plain(r[c]) for c in cols) for r in df.collect()], key=repr)
    res = con.execute(oracles.oracle_sql()[name])
    kinds = {d[0]: str(d[1]) for d in res.description}
    names = [d[0] for d in res.description]
    assert sorted(names) == cols
    assert {c: TYPES[k] for c, k in df.dtypes} == kinds
    wanted = sorted([tuple(plain(r[names.index(c)]) for c in cols) for r in res.fetchall()], key=repr)
    assert found == wanted


def test_entry():
    import __spark_entry__ as e

    assert set(queries.queries()) <= set(e.queries())
    assert set(oracles.oracle_sql()) <= set(e.oracle_sql())

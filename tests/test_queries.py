"""Every query of the general part against its SQL on the smallest scale."""

import pathlib

import duckdb
import pytest

from compare import canon
from tideline.queries import banks, dealt, dealt_sql, evaluation, features, joins, learning, models, more, payload, registry, runs  # noqa: F401

QUERIES = {**dealt.QUERIES, **registry.QUERIES}
SQL = {**dealt_sql.SQL, **registry.SQL}


@pytest.fixture(scope="module")
def db(sf):
    con = duckdb.connect()
    for p in pathlib.Path(sf).glob("*.parquet"):
        con.sql(f"create view {p.stem} as from '{p}'")
    return con


@pytest.mark.parametrize("name", list(QUERIES))
def test_query(spark, sf, db, name):
    got = QUERIES[name](spark, sf).toPandas()
    if name not in SQL:
        assert len(got.columns)
        return
    a, b = canon(got), canon(db.sql(SQL[name]).df())
    assert list(a.columns) == list(b.columns)
    assert a.equals(b), a.merge(b, how="outer", indicator=True).query("_merge != 'both'").head().to_string()

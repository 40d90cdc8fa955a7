"""The training-data queries on the smallest scale, against their SQL where there is one."""

import pathlib

import duckdb
import pytest

from compare import canon
from tideline.llm import queries, sql


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_query(spark, sf, name):
    got = queries.QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in sql.SQL:
        con = duckdb.connect()
        for p in pathlib.Path(sf).glob("*.parquet"):
            con.sql(f"create view {p.stem} as from '{p}'")
        a, b = canon(got), canon(con.sql(sql.SQL[name]).df())
        assert list(a.columns) == list(b.columns) and a.equals(b)


def test_drawn_shares_add_up(spark, sf):
    shares = queries.p8_shares(spark, sf).toPandas()
    assert abs(shares.reached_share.sum() - 1) < 1e-9
    total = shares.available.sum()
    for x in shares.itertuples():
        assert x.drawn <= x.budget + 5000 and abs(x.budget - min(x.target_share * total, x.budget)) < 1e-6
        if x.available:  # within one document of the budget
            assert abs(x.drawn - x.budget) < 5000

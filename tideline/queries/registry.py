"""Where queries and their SQL are gathered."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

D = """d AS (
  SELECT o_orderpriority AS corridor, CAST(o_orderdate AS DATE) AS day, round(avg(o_totalprice), 4) AS price, count(*) AS n FROM orders GROUP BY 1, 2
)"""
H = """h AS (
  SELECT event_type AS corridor, date_trunc('hour', ts) AS hour, round(avg(value), 4) AS price, count(*) AS n FROM events GROUP BY 1, 2
)"""


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name; {D} and {H} in the SQL stand for the panels' common table expressions."""

    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql.replace("{D}", D).replace("{H}", H)
        return f

    return add

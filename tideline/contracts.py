"""Checks at the boundaries: fail closed, on aggregates only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class ContractError(ValueError):
    """Data that breaks a declared contract."""


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {', '.join(missing)}")
    return df


def assert_unique(df: DataFrame, *keys: str) -> DataFrame:
    """Raises if a key combination occurs twice; one row reaches the driver."""
    twice = df.groupBy(*keys).count().where("count > 1").limit(1).collect()
    if twice:
        raise ContractError(f"{keys} is not unique: {twice[0].asDict()}")
    return df


def assert_none(df: DataFrame, broken: Column, what: str) -> DataFrame:
    """Raises if any row is broken."""
    n = df.where(broken).limit(1).count()
    if n:
        raise ContractError(what)
    return df


def assert_causal(df: DataFrame, known_at: str, at: str) -> DataFrame:
    """Raises if a row uses what became known after its own time."""
    return assert_none(df, F.col(known_at) > F.col(at), f"{known_at} lies after {at}")


def join_validated(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", cardinality: str = "many_to_one") -> DataFrame:
    """A join that first checks the uniqueness its cardinality promises ('many_to_one', 'one_to_one')."""
    assert_unique(right, *on)
    if cardinality == "one_to_one":
        assert_unique(left, *on)
    return left.join(right, on, how)

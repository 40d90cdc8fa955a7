"""Quantiles over all earlier rows of a series."""

from __future__ import annotations

from bisect import insort
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from tideline.operators.models import bounded


def expanding_quantiles(rows: DataFrame, *, key: str, at: str, value: str, quantiles: dict[str, float], least: int) -> DataFrame:
    """rows (key, at, value) with one column per quantile (linear) of the values strictly before each row, null under `least` of them.

    A window frame without start would sort each prefix anew; here each value is put once into a sorted list. A group is one
    series of the calendar's length, which is checked. Null and not-a-number values are passed over; rows of equal `at` keep an arbitrary order.
    """
    schema = rows.select(key, at, value).schema
    for name in quantiles:
        schema = schema.add(name, "double")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = bounded(pdf).sort_values(at, kind="stable")
        seen: list[float] = []
        out = np.full((len(pdf), len(quantiles)), np.nan)
        for i, v in enumerate(pdf[value].to_numpy(float)):
            n = len(seen)
            if n >= least and n:
                for j, q in enumerate(quantiles.values()):
                    x = q * (n - 1)
                    k = floor(x)
                    out[i, j] = seen[k] if k + 1 >= n else seen[k] + (seen[k + 1] - seen[k]) * (x - k)
            if v == v:
                insort(seen, v)
        columns = {name: pd.Series(out[:, j], index=pdf.index).astype(object).where(~np.isnan(out[:, j]), None) for j, name in enumerate(quantiles)}
        return pdf.assign(**columns)

    return rows.select(key, at, value).groupBy(key).applyInPandas(run, schema)

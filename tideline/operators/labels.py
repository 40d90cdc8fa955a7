"""Outcomes of the rows that follow: labels that only look ahead."""

from __future__ import annotations

from pyspark.sql import Column, WindowSpec
from pyspark.sql import functions as F

from tideline.functions.windows import first_step, future, trailing


def ahead(x: Column, w: WindowSpec, h: int, agg: Column) -> Column:
    """agg over the next h rows where all of them exist."""
    return F.when(F.count(x).over(future(w, h)) == h, agg)


def regret_paid(x: Column, w: WindowSpec, h: int) -> Column:
    """Basis points of today's price that the best of the next h would have saved."""
    return ahead(x, w, h, F.greatest(F.lit(0.0), (x - F.min(x).over(future(w, h))) / x) * 10_000)


def regret_best(x: Column, w: WindowSpec, h: int) -> Column:
    """Basis points by which today's price exceeds the best of the next h."""
    return ahead(x, w, h, F.greatest(F.lit(0.0), x / F.min(x).over(future(w, h)) - 1) * 10_000)


def benefit_forward(x: Column, w: WindowSpec, h: int) -> Column:
    return ahead(x, w, h, (F.avg(x).over(future(w, h)) / x - 1) * 10_000)


def benefit_symmetric(x: Column, w: WindowSpec, h: int) -> Column:
    """Basis points of the mean of the h rows on either side over today's price."""
    past = trailing(w, h, 1)
    both = (F.count(x).over(future(w, h)) == h) & (F.count(x).over(past) == h)
    return F.when(both, ((F.sum(x).over(future(w, h)) + F.sum(x).over(past)) / (2 * h) / x - 1) * 10_000)


def triple_barrier(x: Column, w: WindowSpec, h: int, better: Column, worse: Column) -> Column:
    """0 if, of the next h rows, a price lower by `better` basis points comes before one higher by `worse`; else 1; null near the end."""
    frame = future(w, h)
    low = first_step(frame, x, lambda f: (x / f - 1) * 10_000 >= better)
    high = first_step(frame, x, lambda f: (x / f - 1) * 10_000 <= -worse)
    return ahead(x, w, h, F.when((low > 0) & ((high == 0) | (low <= high)), 0).otherwise(1))


def first_improvement(x: Column, w: WindowSpec, h: int, tolerance: float) -> Column:
    """Step of the first of the next h rows that is better by more than tolerance basis points, h + 1 if none, 0 near the end."""
    step = first_step(future(w, h), x, lambda f: (x / f - 1) * 10_000 > tolerance)
    return F.coalesce(ahead(x, w, h, F.when(step > 0, step).otherwise(h + 1)), F.lit(0))


def trend_t(x: Column, w: WindowSpec, h: int) -> Column:
    """t-statistic of the slope of the logs of today's and the next h - 1 prices, by closed sums of the index."""
    v = F.transform(F.collect_list(x).over(w.rowsBetween(0, h - 1)), lambda y: F.log(y))
    mean = F.aggregate(v, F.lit(0.0), lambda a, b: a + b) / h
    mid, sxx = (h - 1) / 2, h * (h * h - 1) / 12
    slope = F.aggregate(F.transform(v, lambda y, i: (i - mid) * (y - mean)), F.lit(0.0), lambda a, b: a + b) / sxx
    rss = F.aggregate(F.transform(v, lambda y, i: F.pow(y - mean - slope * (i - mid), F.lit(2.0))), F.lit(0.0), lambda a, b: a + b)
    return F.when(F.size(v) == h, F.try_divide(slope, F.nullif(F.sqrt(rss / (h - 2) / sxx), F.lit(0.0))))

"""Causal window features as column builders over a series' own order."""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F


def series(key: str, *order: str) -> WindowSpec:
    return Window.partitionBy(key).orderBy(*order)


def trailing(w: WindowSpec, n: int, lag: int = 0) -> WindowSpec:
    """The n rows that end `lag` rows before the current one."""
    return w.rowsBetween(1 - n - lag, -lag)


def future(w: WindowSpec, n: int) -> WindowSpec:
    return w.rowsBetween(1, n)


def full(value: Column, frame: WindowSpec, least: int, agg: Column) -> Column:
    """agg where at least `least` values of the frame are not null."""
    return F.when(F.count(value).over(frame) >= least, agg)


def change(x: Column, w: WindowSpec, k: int = 1) -> Column:
    """x over its value k rows earlier, less one."""
    return F.try_divide(x, F.lag(x, k).over(w)) - 1


def rolling(agg, x: Column, w: WindowSpec, n: int, least: int | None = None, lag: int = 0) -> Column:
    frame = trailing(w, n, lag)
    return full(x, frame, least or n, agg(x).over(frame))


def zscore(x: Column, w: WindowSpec, n: int, least: int | None = None, lag: int = 0) -> Column:
    """Deviation from the trailing mean in trailing (sample) standard deviations; null where they are zero. lag=1 keeps the current row out."""
    return F.try_divide(x - rolling(F.avg, x, w, n, least, lag), F.nullif(rolling(F.stddev_samp, x, w, n, least, lag), F.lit(0.0)))


def distance_to(agg, x: Column, w: WindowSpec, n: int) -> Column:
    return F.try_divide(x, rolling(agg, x, w, n)) - 1


def _share(values: Column, x: Column, half: bool) -> Column:
    """Share of an array at or below x; half counts ties by their middle rank."""
    least = F.size(F.filter(values, lambda v: v < x))
    ties = F.size(F.filter(values, lambda v: v == x))
    return (least + ((ties + 1) / 2 if half else ties)) / F.size(values)


def rank_average(x: Column, w: WindowSpec, n: int) -> Column:
    """Percentile rank in the trailing window, ties by their mean rank."""
    return full(x, trailing(w, n), n, _share(F.collect_list(x).over(trailing(w, n)), x, True))


def rank_max(x: Column, w: WindowSpec, n: int) -> Column:
    """Percentile rank in the trailing window, ties by their greatest rank."""
    return full(x, trailing(w, n), n, _share(F.collect_list(x).over(trailing(w, n)), x, False))


def causal_percentile(x: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Share of the n rows strictly before that do not exceed x."""
    frame = trailing(w, n, 1)
    return full(x, frame, least, _share(F.collect_list(x).over(frame), x, False))


def trailing_quantile(x: Column, w: WindowSpec, n: int, q: float, least: int) -> Column:
    """The q-quantile (linear) of the n rows strictly before."""
    frame = trailing(w, n, 1)
    return full(x, frame, least, F.percentile(x, F.lit(q)).over(frame))


def expanding_quantile(x: Column, w: WindowSpec, q: float) -> Column:
    return F.percentile(x, F.lit(q)).over(w.rowsBetween(Window.unboundedPreceding, -1))


def streak(hit: Column, w: WindowSpec, n: int) -> Column:
    """Whether the last n rows were all hits."""
    return F.sum(F.coalesce(hit, F.lit(False)).cast("int")).over(trailing(w, n)) == n


def onset(state: Column, w: WindowSpec) -> Column:
    """True where the state begins."""
    s = F.coalesce(state, F.lit(False))
    return s & ~F.lag(s, 1, False).over(w)


def fill_forward(x: Column, w: WindowSpec, limit: int | None = None) -> Column:
    return F.last(x, True).over(w.rowsBetween(Window.unboundedPreceding if limit is None else -limit, 0))


def beta(y: Column, x: Column, w: WindowSpec, n: int, least: int) -> Column:
    """Covariance of y and x over the variance of x in the trailing window, of rows where both are present."""
    frame = trailing(w, n)
    both = F.when(x.isNotNull() & y.isNotNull(), x)
    return F.when(F.count(both).over(frame) >= least, F.try_divide(F.covar_samp(y, x).over(frame), F.nullif(F.var_samp(both).over(frame), F.lit(0.0))))


def first_step(frame: WindowSpec, x: Column, cond) -> Column:
    """1-based index of the first value in the frame for which cond(value) holds, 0 if none."""
    return F.array_position(F.transform(F.collect_list(x).over(frame), cond), True)

"""Registry of indicators: each name builds a struct column (fired, strength) over a series' own order."""

from __future__ import annotations

import itertools
import json
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tideline.functions import windows as X

Builder = Callable[..., Column]
REGISTRY: dict[str, Builder] = {}


def indicator(name: str) -> Callable[[Builder], Builder]:
    """Registers a builder (price, window, **parameters) -> struct<fired, strength>; a name can be taken once."""

    def add(f: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"indicator {name} exists")
        REGISTRY[name] = f
        return f

    return add


def _out(fired: Column, value: Column, scale: Column | float) -> Column:
    """fired without nulls, strength = value / scale between 0 and 1, 0 where the scale is not positive."""
    s = F.lit(scale) if isinstance(scale, (int, float)) else scale
    strength = F.when(s > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), value / s))).otherwise(0.0)
    return F.struct(F.coalesce(fired, F.lit(False)).alias("fired"), F.coalesce(strength, F.lit(0.0)).alias("strength"))


@indicator("level_percentile")
def level(p: Column, w: WindowSpec, *, window: int, pct: float) -> Column:
    rank = X.rank_max(p, w, window) * 100
    return _out(rank <= pct, pct - rank, pct)


@indicator("momentum_streak")
def momentum(p: Column, w: WindowSpec, *, n: int) -> Column:
    before = F.lag(p, n).over(w)
    spread = X.rolling(F.stddev_samp, p, w, max(20, n)) / p
    return _out(X.streak(p < F.lag(p).over(w), w, n), (before - p) / before / n, spread)


@indicator("filter_rule")
def filter_rule(p: Column, w: WindowSpec, *, x: float) -> Column:
    r = X.change(p, w) * 100
    return _out(r <= -x, -r, 2 * x)


@indicator("reversal_from_low")
def reversal(p: Column, w: WindowSpec, *, lookback: int, bounce: float) -> Column:
    low = X.rolling(F.min, p, w, lookback, lag=1)
    sigma = X.rolling(F.stddev_samp, p, w, lookback, lag=1) / low
    rise = p / low - 1
    return _out(rise >= bounce * sigma, rise, 2 * bounce * sigma)


@indicator("volatility_regime")
def volatility(p: Column, w: WindowSpec, *, window: int, regime: str) -> Column:
    """The trailing standard deviation over the mean price, against the same of the window just before."""
    spread = X.rolling(F.stddev_samp, p, w, window) / X.rolling(F.avg, p, w, window)
    before = X.rolling(F.stddev_samp, p, w, window, lag=window) / X.rolling(F.avg, p, w, window, lag=window)
    ratio = F.try_divide(spread, F.nullif(before, F.lit(0.0)))
    return _out({"low": ratio < 0.75, "mid": ratio.between(0.75, 1.25), "high": ratio > 1.25}[regime], spread, 2 * before)


def expand_grid(config: dict[str, dict[str, list]]) -> list[tuple[str, dict]]:
    """(name, parameters) of every combination, parameter names in sorted order, values as listed."""
    out = []
    for name, params in config.items():
        keys = sorted(params)
        out += [(name, dict(zip(keys, values))) for values in itertools.product(*(params[k] for k in keys))]
    return out


def signals(panel: DataFrame, specs: list[tuple[str, dict]], *, key: str, at: str, price: str) -> DataFrame:
    """(key, at, indicator, params, strength) of every firing; all specs are columns of one pass over shared windows. A unknown name fails."""
    w = X.series(key, at)
    named = [(n, json.dumps(q, sort_keys=True, separators=(",", ":")), REGISTRY[n](F.col(price), w, **q)) for n, q in specs]
    wide = panel.select(key, at, F.array(*[F.struct(F.lit(n).alias("indicator"), F.lit(j).alias("params"), c.alias("o")) for n, j, c in named]).alias("_a"))
    rows = wide.select(key, at, F.inline(F.filter("_a", lambda x: x["o"]["fired"])))
    return rows.select(key, at, "indicator", "params", F.col("o.strength").alias("strength"))


def latest(found: DataFrame, panel: DataFrame, *, key: str, at: str, cut: Column) -> DataFrame:
    """The firings of each key's last row at or before the cut."""
    last = panel.where(F.col(at) <= cut).groupBy(key).agg(F.max(at).alias(at))
    return found.join(last, [key, at])


def tumbling(panel: DataFrame, *, key: str, at: str, size: int) -> DataFrame:
    """panel with `block` and `step` of consecutive windows of `size` rows."""
    n = F.row_number().over(Window.partitionBy(key).orderBy(at)) - 1
    return panel.withColumn("_n", n).withColumn("block", F.floor(F.col("_n") / size)).withColumn("step", F.col("_n") % size).drop("_n")

"""Ordered decisions that depend on the ones before: caps, cooldowns, cumulative sums, delayed weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SERIES_ROWS = 500_000  # most candidates of one key: centuries of days, decades of hours


def _bounded(array: Column) -> Column:
    """The array itself, if it is no longer than a series of days or hours can be."""
    return F.when(F.size(array) <= SERIES_ROWS, array).otherwise(F.raise_error(F.lit(f"a key with more than {SERIES_ROWS} rows; aggregate to days or hours first")))


def cap_and_cooldown(candidates: DataFrame, *, key: str, at: str, cooldown: int, cap: int | None, unit: str = "day") -> DataFrame:
    """The (key, at) kept when a key's candidates are taken in order: none beyond `cap` in an ISO week, none less than `cooldown` units after the last one kept.

    The order is folded over one sorted array a key; candidates are days or hours of a series, so its length is bounded by
    the calendar, which is checked. Repeated candidates of a key and time count once; nulls are left out.
    """
    seconds = {"day": 86_400, "hour": 3_600}[unit]
    t = F.unix_micros(F.col(at).cast("timestamp")) / F.lit(1_000_000)
    rows = candidates.where(F.col(key).isNotNull() & F.col(at).isNotNull()).select(F.col(key), F.col(at), t.cast("long").alias("_s")).distinct()
    arrays = rows.groupBy(key).agg(_bounded(F.array_sort(F.collect_list(F.struct("_s", at)))).alias("_c"))
    kind = rows.schema[at].dataType.simpleString()
    week = lambda s: F.floor((s + 3 * 86_400) / (7 * 86_400))
    start = F.struct(F.lit(None).cast("long").alias("last"), F.lit(None).cast("long").alias("week"), F.lit(0).alias("count"), F.array().cast(f"array<{kind}>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        w = week(x["_s"]).cast("long")
        taken = F.when(a["week"] == w, a["count"]).otherwise(0)
        free = F.lit(True) if cap is None else taken < cap
        ok = free & (a["last"].isNull() | (x["_s"] - a["last"] >= cooldown * seconds))
        return F.when(ok, F.struct(x["_s"].alias("last"), w.alias("week"), (taken + 1).alias("count"), F.array_append(a["kept"], x[at]).alias("kept"))).otherwise(a)

    return arrays.select(key, F.explode(F.aggregate("_c", start, step, lambda a: a["kept"])).alias(at))


def cusum(rows: DataFrame, *, key: str, at: str, change: str, sigma: str, multiple: float) -> DataFrame:
    """(key, at, fired): the two-sided cumulative sum of changes fires at multiple * sigma and starts anew; rows with null or non-positive sigma, or null change, are passed over."""
    arrays = rows.groupBy(key).agg(_bounded(F.array_sort(F.collect_list(F.struct(at, F.col(change).alias("x"), F.col(sigma).alias("s"))))).alias("_c"))
    kind = rows.schema[at].dataType.simpleString()
    start = F.struct(F.lit(0.0).alias("up"), F.lit(0.0).alias("down"), F.array().cast(f"array<struct<{at}:{kind},fired:boolean>>").alias("out"))

    def step(a: Column, r: Column) -> Column:
        usable = F.coalesce((r["s"] > 0) & r["x"].isNotNull(), F.lit(False))
        up = F.greatest(F.lit(0.0), a["up"] + F.coalesce(r["x"], F.lit(0.0)))
        down = F.least(F.lit(0.0), a["down"] + F.coalesce(r["x"], F.lit(0.0)))
        fired = usable & F.coalesce((up >= multiple * r["s"]) | (down <= -multiple * r["s"]), F.lit(False))
        keep = lambda new, old: F.when(fired, 0.0).when(usable, new).otherwise(old)
        return F.struct(keep(up, a["up"]).alias("up"), keep(down, a["down"]).alias("down"), F.array_append(a["out"], F.struct(r[at].alias(at), fired.alias("fired"))).alias("out"))

    return arrays.select(key, F.inline(F.aggregate("_c", start, step, lambda a: a["out"])))


def first_per_week(rows: DataFrame, *, key: str, at: str, n: int) -> DataFrame:
    """The first n rows of each key and week in order of time."""
    w = Window.partitionBy(key, F.date_trunc("week", F.col(at).cast("timestamp"))).orderBy(at)
    return rows.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def delayed_weights(losses: list[Column], w, delay: int, eta: float) -> list[Column]:
    """Exponential weights of several predictions from the losses that had matured `delay` rows ago: a window sum and a softmax."""
    past = w.rowsBetween(Window.unboundedPreceding, -delay)
    logs = [-eta * F.coalesce(F.sum(x).over(past), F.lit(0.0)) for x in losses]
    top = F.greatest(*logs) if len(logs) > 1 else logs[0]
    raw = [F.exp(x - top) for x in logs]
    total = sum(raw[1:], raw[0])
    return [x / total for x in raw]

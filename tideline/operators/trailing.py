"""Totals and means over trailing calendar periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def trailing_totals(
    rows: DataFrame,
    *,
    entity: str,
    day: str,
    values: dict[str, str],
    periods: tuple[int, ...] = (7, 30),
    latest: str | None = None,
) -> DataFrame:
    """One row per entity and calendar day from its first day to its last: (entity, day, day_no, then `<value>_sum_<n>`, `<value>_n_<n>`, `<value>_mean_<n>` for each value and period).

    `values` maps a column to the SQL condition under which it counts, written on the column's name, such as
    {"close": "close <> 0"}; nulls and not-a-number never count. Each (entity, day) counts once: of repeated rows the
    one with the greatest `latest` (nulls last, then the greatest values) is taken. day_no is 0 on the entity's first day.
    A sum without counted values is 0, its mean null.

    One row a day and entity leaves the map-side aggregation; the calendar is a sequence per entity between its own first
    and last day, so that a window holds at most the days of one entity's life however many rows it has.

    Defined cases: rows with null entity or day are left out; an empty table gives an empty result; other columns are ignored.
    """
    one = F.max(F.struct(*([F.col(latest).alias("_at")] if latest else []), *[F.col(c).cast("double").alias(c) for c in values])).alias("_v")
    daily = rows.where(F.col(entity).isNotNull() & F.col(day).isNotNull()).groupBy(F.col(entity).alias("entity"), F.col(day).cast("date").alias("day")).agg(one)
    daily = daily.select("entity", "day", *[F.col(f"_v.{c}").alias(c) for c in values])
    daily = daily.select("entity", "day", *[F.expr(f"case when not isnan({c}) and ({cond}) then {c} end").alias(c) for c, cond in values.items()])
    calendar = daily.groupBy("entity").agg(F.min("day").alias("first"), F.max("day").alias("last")).select("entity", F.explode(F.sequence("first", "last")).alias("day"))
    dense = calendar.join(daily, ["entity", "day"], "left")
    w = Window.partitionBy("entity").orderBy("day")
    out = [F.row_number().over(w).alias("row")]
    for c in values:
        for n in periods:
            frame = w.rowsBetween(1 - n, 0)
            out += [F.coalesce(F.sum(c).over(frame), F.lit(0.0)).alias(f"{c}_sum_{n}"), F.count(c).over(frame).alias(f"{c}_n_{n}")]
    wide = dense.select("entity", "day", *out)
    means = [F.try_divide(f"{c}_sum_{n}", F.col(f"{c}_n_{n}")).alias(f"{c}_mean_{n}") for c in values for n in periods]
    return wide.select("entity", "day", (F.col("row") - 1).alias("day_no"), *[x for x in wide.columns if x not in ("entity", "day", "row")], *means)

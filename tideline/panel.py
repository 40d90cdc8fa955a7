"""Bitemporal panels: what a value describes, and when it became known."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tideline.session import pin_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def daily_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(corridor, day, price, n): orders by priority and day. One row a day and corridor leaves the map-side aggregation, so the windows over it are as long as the calendar, whatever the table's size."""
    return (
        table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("corridor"), F.col("o_orderdate").cast("date").alias("day"))
        .agg(F.round(F.avg("o_totalprice"), 4).alias("price"), F.count("*").alias("n"))
    )


def hourly_panel(spark: SparkSession, sf: str) -> DataFrame:
    """(corridor, hour, price, n): events by type and hour."""
    return (
        table(spark, sf, "events").groupBy(F.col("event_type").alias("corridor"), F.date_trunc("hour", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("hour"))
        .agg(F.round(F.avg("value"), 4).alias("price"), F.count("*").alias("n"))
    )


def previous_business_day(day: Column) -> Column:
    """The business day before `day`: Monday, Sunday and Saturday all go back to Friday."""
    return F.when(F.weekday(day) == 0, F.date_sub(day, 3)).when(F.weekday(day) == 6, F.date_sub(day, 2)).otherwise(F.date_sub(day, 1))


def as_of(panel: DataFrame, known_at: str, cut: Column) -> DataFrame:
    """Only what was public at the cut; the filter stands first in the plan and reaches the scan."""
    return panel.where(F.col(known_at) <= cut)


def stale(panel: DataFrame, key: str, known_at: str, cut: Column, days: int) -> DataFrame:
    """(key, last_known, age_days, stale): how old each series is at the cut."""
    last = as_of(panel, known_at, cut).groupBy(key).agg(F.max(known_at).alias("last_known"))
    age = F.date_diff(cut.cast("date"), F.col("last_known").cast("date"))
    return last.select(key, "last_known", age.alias("age_days"), (age > days).alias("stale"))


def normalise_price(close: Column, mode: Column, facevalue: Column) -> Column:
    """Price per unit by mode ('raw', 'divide_by_facevalue'); an unknown mode or a missing face value is null, never a guess."""
    return F.when(mode == "raw", close).when((mode == "divide_by_facevalue") & (facevalue > 0), close / facevalue)


def position(key: str, *order: str) -> Column:
    """0-based row number in a series' order."""
    return F.row_number().over(Window.partitionBy(key).orderBy(*order)) - 1

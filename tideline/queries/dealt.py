"""Queries of the general data-processing problems over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators.faults import flag_faults
from tideline.operators.grid import micros, regular_grid
from tideline.operators.stamps import normalise_feeds
from tideline.operators.trailing import trailing_totals
from tideline.operators.versions import as_known
from tideline.session import pin_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _text(us: Column) -> Column:
    return F.date_format(F.timestamp_micros(us), "yyyy-MM-dd HH:mm:ss")


def p1_series(spark: SparkSession, sf: str) -> DataFrame:
    """The complete ten-minute series, filled or marked."""
    sources = table(spark, sf, "moex_universe").select("secid", F.col("availability.intraday_10m_from").alias("since"))
    return regular_grid(table(spark, sf, "intraday_readings"), sources, table(spark, sf, "trading_sessions")).withColumn("value", F.round("value", 6))


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return p1_series(spark, sf).where("mark <> 'observed'").select(F.col("source").alias("secid"), _text(F.col("slot_us")).alias("slot_start")).distinct()


def p2_instants(spark: SparkSession, sf: str) -> DataFrame:
    return normalise_feeds(table(spark, sf, "raw_stamps"), table(spark, sf, "feed_registry")).select("record_id", "feed", "stamp_text", "utc_micros", "stamp_status")


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_instants(spark, sf).where("utc_micros is not null").select("record_id", "utc_micros").distinct()


def p3_faults(spark: SparkSession, sf: str) -> DataFrame:
    return flag_faults(table(spark, sf, "moex_candles"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_faults(spark, sf).where("spike or wick or stuck or impossible").select(F.col("source").alias("secid"), _text(F.col("us")).alias("dt_msk")).distinct()


def _known(spark: SparkSession, sf: str) -> DataFrame:
    """Every quote with the release of its provider in force and public at its available_at."""
    releases = table(spark, sf, "provider_rates")
    public = F.greatest(micros(F.col("known_at")), micros(F.col("observation_date")))
    eligible = F.when(F.col("known_at").isNotNull() & F.col("observation_date").isNotNull(), public)
    return as_known(
        table(spark, sf, "bank_quotes"), releases, entity="provider", event_us=micros(F.col("available_at")), eligible_us=eligible,
        rank=["observation_date", "known_at", "release_id"], attributes=["release_id", "observation_date", "known_at", "policy_rate_pct"],
    )


def p5_known(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).withColumn("known_observation_date", F.col("known_observation_date").cast("string"))


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return _known(spark, sf).where("known_release_id is not null").select("quote_id", F.col("known_release_id").alias("release_id")).distinct()


def p6_trailing(spark: SparkSession, sf: str) -> DataFrame:
    values = {"regret_bps": "true", "close": "close <> 0"}
    return trailing_totals(table(spark, sf, "outcome_days"), entity="instrument_id", day="trade_date", values=values, latest="fetched_at")


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    t = p6_trailing(spark, sf).where("day_no >= 29")
    regret = (F.col("regret_bps_sum_30") >= 150) & (F.col("regret_bps_sum_7") >= 0.5 * F.col("regret_bps_sum_30"))
    close = F.coalesce(F.col("close_mean_7") > 1.03 * F.col("close_mean_30"), F.lit(False))
    named = t.select(F.col("entity").alias("instrument_id"), F.date_format("day", "yyyy-MM-dd").alias("day"), F.explode(F.array_compact(F.array(F.when(regret, "regret"), F.when(close, "close")))).alias("measure"))
    return named.distinct()


QUERIES = {f.__name__: f for f in (p1_found, p1_series, p2_found, p2_instants, p3_found, p3_faults, p5_found, p5_known, p6_found, p6_trailing)}

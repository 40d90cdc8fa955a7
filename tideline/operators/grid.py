"""Irregular readings onto a regular grid of slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

US = 1_000_000


def micros(c: Column) -> Column:
    """Wall-clock timestamp (with or without zone) as integer microseconds; the session runs in UTC."""
    return F.unix_micros(c.cast("timestamp"))


def session_table(sessions: DataFrame, day: str, open_at: str, close_at: str) -> DataFrame:
    """(session_day, open_us, close_us) of the open sessions; closed days (null hours) and empty ones fall out."""
    return (
        sessions.select(F.col(day).cast("date").alias("session_day"), micros(F.col(open_at)).alias("open_us"), micros(F.col(close_at)).alias("close_us"))
        .where("session_day is not null and open_us < close_us")
        .distinct()
    )


def source_sessions(sources: DataFrame, sessions: DataFrame, source: str, since: str, step_us: int) -> DataFrame:
    """Every (source, open_us, slots) from the source's first day on, with the number of slots of the session.

    Days come from a sequence per source and meet the sessions by an equi-join on the day; no product of the two tables is formed.
    """
    span = sessions.agg(F.min("session_day").alias("lo"), F.max("session_day").alias("hi")).first()
    first = sources.groupBy(F.col(source).alias("source")).agg(F.min(F.col(since).try_cast("date")).alias("since")).where("source is not null and since is not null")
    lo, hi = F.lit(span["lo"]).cast("date"), F.lit(span["hi"]).cast("date")
    days = first.where(F.col("since") <= hi).select("source", F.explode(F.sequence(F.greatest("since", lo), hi)).alias("session_day"))
    slots = F.ceil((F.col("close_us") - F.col("open_us")) / step_us).cast("int")
    return days.join(sessions, "session_day").select("source", "open_us", slots.alias("slots"))


def regular_grid(
    readings: DataFrame,
    sources: DataFrame,
    sessions: DataFrame,
    *,
    source: str = "secid",
    timestamp: str = "timestamp",
    value: str = "close",
    since: str = "since",
    day: str = "session_date",
    open_at: str = "open_at",
    close_at: str = "close_at",
    step_s: int = 600,
    gap_limit_s: int = 1800,
) -> DataFrame:
    """A complete series per source: one row (source, slot_us, value, mark, prev_us, next_us) per slot of each session.

    Slots [start, start + step) are counted from open_at while start < close_at, on days from the source's `since` on.
    The sorted grid is merged as-of with the readings of the same session: `value` is the reading at slot start,
    linear in time between the last reading before it and the first at or after it, if those lie at most gap_limit_s
    apart; else the slot's own first reading; else null. `mark` is 'observed' (a usable reading falls into the slot),
    'filled' (none does, but neighbours on both sides lie close enough) or 'missing'.

    Readings are reduced to the first and last of each slot before they are shuffled, so a source holding any share of all
    rows costs one row a slot after the map-side aggregation. The sorted order of a session then holds its slots with
    readings and one row that opens it; the slots between two of them are generated beside both neighbours, after the
    shuffle.

    Defined cases: a reading with null source, null timestamp, or a null, not-a-number, infinite or non-positive value is
    unusable; readings outside the hours belong to no slot; equal timestamps order by value; repeated rows change
    nothing; sources with a null or unreadable `since` have no grid; empty tables give an empty result; other columns
    are ignored, whatever their names.
    """
    step = step_s * US
    ses = session_table(sessions, day, open_at, close_at)
    grid = source_sessions(sources, ses, source, since, step)
    usable = readings.select(F.col(source).alias("source"), micros(F.col(timestamp)).alias("us"), F.col(value).cast("double").alias("v")).where("source is not null and us is not null and v > 0 and v < double('Infinity')")
    hours = ses.withColumn("open_day", F.explode(F.sequence(F.floor(F.col("open_us") / (86400 * US)), F.floor((F.col("close_us") + step) / (86400 * US)))))
    span = F.col("us") - F.col("open_us")
    r = F.struct((span % step).cast("int").alias("off"), "v")
    kept = (
        usable.withColumn("open_day", F.floor(F.col("us") / (86400 * US)))
        .join(hours, "open_day")
        .where((span >= 0) & (F.floor(span / step) < F.ceil((F.col("close_us") - F.col("open_us")) / step)))
        .groupBy("source", "open_us", F.floor(span / step).cast("int").alias("slot"))
        .agg(F.min(r).alias("first"), F.max(r).alias("last"))
    )
    opened = grid.select("source", "open_us", F.lit(-1).alias("slot"), F.lit(None).cast(kept.schema["first"].dataType).alias("first"), F.lit(None).cast(kept.schema["last"].dataType).alias("last"), "slots")
    w = Window.partitionBy("source", "open_us").orderBy("slot")
    seen = opened.unionByName(kept.withColumn("slots", F.lit(None).cast("int"))).select(
        "source", "open_us", "slot", "first", "last", F.first("slots").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("slots"),
        *[f(c).over(w).alias(k) for f, c, k in ((F.lag, "slot", "slot_before"), (F.lag, "last", "last_before"), (F.lead, "slot", "slot_after"), (F.lead, "first", "first_after"))],
    ).where("slots is not null")
    # Each row stands for its own slot, unless it only opens the session, and for those up to the next with readings.
    start, end = F.greatest("slot", F.lit(0)), F.coalesce("slot_after", "slots")
    every = seen.where(start < end).withColumn("at", F.explode(F.sequence(start, end - 1)))
    own = F.col("at") == F.col("slot")
    us = lambda slot, off: F.col("open_us") + F.col(slot) * F.lit(step).cast("long") + F.col(off)
    placed = every.select(
        "source", (F.col("open_us") + F.col("at") * F.lit(step).cast("long")).alias("slot_us"), F.when(own, F.col("first.v")).alias("own"),
        F.when(own, us("slot_before", "last_before.off")).otherwise(us("slot", "last.off")).alias("p"), F.when(own, F.col("last_before.v")).otherwise(F.col("last.v")).alias("pv"),
        F.when(own, us("slot", "first.off")).otherwise(us("slot_after", "first_after.off")).alias("n"), F.when(own, F.col("first.v")).otherwise(F.col("first_after.v")).alias("nv"),
    )
    gap = F.col("n") - F.col("p")
    line = F.col("pv") + (F.col("nv") - F.col("pv")) * ((F.col("slot_us") - F.col("p")) / gap)
    between = F.when(F.col("n") == F.col("slot_us"), F.col("nv")).when(gap <= gap_limit_s * US, line)
    mark = F.when(F.col("own").isNotNull(), "observed").when(between.isNotNull(), "filled").otherwise("missing")
    return placed.select("source", "slot_us", F.coalesce(between, F.col("own")).alias("value"), mark.alias("mark"), F.col("p").alias("prev_us"), F.col("n").alias("next_us"))

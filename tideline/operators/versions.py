"""Entity attributes as they were known at each event's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.blocks import before, hot_blocks
from tideline.session import cut


def as_known(
    events: DataFrame,
    releases: DataFrame,
    *,
    entity: str,
    event_us: Column,
    eligible_us: Column,
    rank: list[str],
    attributes: list[str],
    prefix: str = "known_",
    per_block: int = 200_000,
) -> DataFrame:
    """events with the attributes (as `<prefix><name>`) of the release in force at the event's time, null if none.

    A release may be used from eligible_us on (for instance the later of when it became known and the day it
    describes); in force is, of those eligible at event_us, the one greatest by `rank`. Both are columns of integer
    microseconds; null on either side means never.

    A version begins with each release that exceeds all earlier ones by `rank`; its number is the cumulative count of
    such changes. Numbers are assigned over narrow rows (entity, microseconds, rank) only: in one order per entity, distinct
    event times are counted against the changes. Numbered times then meet wide attributes by an equi-join on entity and number,
    and events by one on entity and time. An entity of more than per_block narrow rows is cut into blocks of time, into
    which the greatest rank and the number of changes of earlier blocks are carried by a window over one row a block.

    Defined cases: no event row is lost or repeated; releases with a null rank part, entity or eligible_us are never in
    force; of releases equal in all of `rank`, the greatest attributes hold; repeated rows change nothing; null
    attributes are carried as null; empty tables work on either side; columns of the same name in both tables do not
    clash, since attributes get the prefix.
    """
    ranks = [f"_r{i}" for i in range(len(rank))]
    usable = F.col(entity).isNotNull()
    for c in rank:
        usable &= F.col(c).isNotNull()
    known = releases.where(usable)
    parts = [F.col(c).alias(k) for c, k in zip(rank, ranks)]
    rel = known.select(F.col(entity).alias("e"), eligible_us.cast("long").alias("us"), *parts).where("us is not null").distinct()
    asked = events.select(F.col(entity).alias("e"), event_us.cast("long").alias("us")).where("e is not null and us is not null").distinct()
    ranked = F.struct(*ranks)
    narrow = rel.select("e", "us", ranked.alias("r"))
    narrow = narrow.unionByName(asked.withColumn("r", F.lit(None).cast(narrow.schema["r"].dataType)))
    counted = known.select(F.col(entity).alias("e")).unionAll(events.where(F.col(entity).isNotNull()).select(F.col(entity).alias("e")))
    rows, some_hot = hot_blocks(narrow, "e", "us", per_block, counted)
    if some_hot:
        best = before(rows.where("b >= 0").groupBy("e", "b").agg(F.max("r").alias("best")), "e", "b", F.max, "best", "carried")
        rows = rows.join(best.select("e", "b", "carried"), ["e", "b"], "left")
    else:
        rows = rows.withColumn("carried", F.lit(None).cast(narrow.schema["r"].dataType))

    # Ranks ascend within equal microseconds, and event times, whose rank is null, come after them.
    w = Window.partitionBy("e", "b").orderBy("us", F.col("r").asc_nulls_last())
    so_far = F.greatest(F.max("r").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("carried"))
    change = (F.col("r").isNotNull() & (F.col("so_far").isNull() | (F.col("r") > F.col("so_far")))).cast("long")
    marked = rows.withColumn("so_far", so_far).withColumn("change", change)
    numbered = marked.select("e", "b", "us", "r", "change", F.sum("change").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("no")).where("r is null or change = 1")
    numbered = cut(numbered)
    if some_hot:
        base = before(numbered.where("b >= 0").groupBy("e", "b").agg(F.sum("change").alias("n")), "e", "b", F.sum, "n", "base")
        numbered = numbered.join(base.select("e", "b", "base"), ["e", "b"], "left").withColumn("no", F.col("no") + F.coalesce("base", F.lit(0)))

    extra = [c for c in attributes if c not in rank]
    greatest = F.max(F.struct(*extra) if len(extra) > 1 else F.col(extra[0]) if extra else F.lit(1)).alias("_x")
    wide = known.groupBy(F.col(entity).alias("_we"), *parts).agg(greatest)
    at = lambda c: F.col(ranks[rank.index(c)]) if c in rank else F.col(f"_x.{c}" if len(extra) > 1 else "_x")
    wide = wide.select("_we", *ranks, *[at(c).alias(prefix + c) for c in attributes])
    versions = numbered.where("r is not null").select(F.col("e").alias("_ve"), "no", *[F.col(f"r.{k}").alias("_v" + k) for k in ranks])
    same = F.col("_ve") == F.col("_we")
    for k in ranks:
        same &= F.col("_v" + k) == F.col(k)
    table = versions.join(wide, same).select("_ve", F.col("no").alias("_vno"), *[prefix + c for c in attributes])
    times = numbered.where("r is null and no > 0").select(F.col("e").alias("_e"), F.col("us").alias("_us"), F.col("no").alias("_no"))
    given = times.join(table, (F.col("_e") == F.col("_ve")) & (F.col("_no") == F.col("_vno"))).drop("_ve", "_no", "_vno")
    out = events.withColumn("_ev_us", event_us.cast("long"))
    return out.join(given, (F.col(entity) == F.col("_e")) & (F.col("_ev_us") == F.col("_us")), "left").drop("_ev_us", "_e", "_us")

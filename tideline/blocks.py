"""Time blocks: how a hot entity's history is spread over many tasks without losing its order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut


def before(summaries: DataFrame, entity: str, block: str, agg, value: str, alias: str) -> DataFrame:
    """Each (entity, block) summary with the aggregate of `value` over the entity's earlier blocks.

    The window holds one row per block of an entity, a number bounded by the length of time over the block width.
    """
    w = Window.partitionBy(entity).orderBy(block).rowsBetween(Window.unboundedPreceding, -1)
    return summaries.withColumn(alias, agg(value).over(w))


KNOTS = 64  # equal shares of a hot key's rows between which its blocks are divided evenly in time


def hot_blocks(rows: DataFrame, key: str, time: str, per_block: int, counted: DataFrame | None = None) -> tuple[DataFrame, bool]:
    """rows with block number `b`: -1 for every key of at most per_block rows, blocks of about per_block rows in order of time for the others; and whether there are others.

    Keys with more rows are listed in a table (at most one for every per_block rows) with 64 approximate percentiles of
    their times; it meets the rows by an equi-join, which broadcasts it only if its written size is small. Blocks can be as
    narrow as a microsecond. They change how the work is split, never its result. `counted` is a cheaper table with the same
    keys and at least as many rows of each, such as the rows before repeated ones were dropped, which costs no shuffle.
    """
    counts = cut((rows if counted is None else counted).groupBy(key).agg(F.count("*").alias("_n")).where(F.col("_n") > per_block))
    if counts.isEmpty():
        return rows.withColumn("b", F.lit(-1).cast("long")), False
    knots = F.percentile_approx(time, [i / KNOTS for i in range(KNOTS + 1)], 10_000)
    hot = cut(rows.join(counts, key).groupBy(key).agg(knots.alias("_q"), F.max("_n").alias("_n")))
    t, sub = F.col(time), F.ceil(F.col("_n") / (KNOTS * per_block))
    piece = F.least(F.greatest(F.size(F.filter("_q", lambda x: x <= t)), F.lit(1)), F.lit(KNOTS))
    lo, hi = F.get("_q", piece - 1), F.get("_q", piece)
    inner = F.least(F.greatest(F.floor((t - lo) / (hi - lo + 1) * sub), F.lit(0)), sub - 1)
    return rows.join(hot, key, "left").withColumn("b", F.coalesce((piece * sub + inner).cast("long"), F.lit(-1).cast("long"))).drop("_q", "_n"), True

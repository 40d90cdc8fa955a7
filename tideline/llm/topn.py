"""The N best items of every group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_n(items: DataFrame, *, by: list[str], score: str, ties: list[str], n: int) -> DataFrame:
    """The n items of each group (`by`, nulls are a group of their own) with the highest score; equal scores by `ties` ascending, as whole rows plus `rank` from 1.

    An item is identified by its score and `ties`; repeated rows of an item count once, and the row that stands for it is
    the greatest by its other columns of comparable types.

    The first window is a dense rank over score and ties, under which copies of an item share a place. Its filter becomes a
    group-limit operator, which keeps the n best items of each group in every map task before the shuffle and again
    after it, so a group of any size sends at most n items (with their copies) a task. Only these survivors are numbered by
    row_number, copies apart, and filtered by rank.

    Defined cases: null and not-a-number scores never count; null ties come first; groups with fewer than n items come whole;
    an empty table gives an empty result; infinite scores are ordered as numbers; a column named `rank` is replaced.
    """
    scored = items.drop("rank").where(F.col(score).isNotNull() & ~F.isnan(F.col(score).cast("double")))
    order: list[Column] = [F.col(score).desc(), *[F.col(c).asc() for c in ties]]
    group = Window.partitionBy(*by)
    pruned = scored.withColumn("_place", F.dense_rank().over(group.orderBy(*order))).where(F.col("_place") <= n)
    rest = [c for c, kind in scored.dtypes if c not in (*by, score, *ties) and not kind.startswith(("map", "variant"))]
    copies = Window.partitionBy(*by, "_place").orderBy(*[F.col(c).desc() for c in rest] or [F.lit(0)])
    single = pruned.withColumn("_copy", F.row_number().over(copies)).where("_copy = 1").drop("_copy", "_place")
    return single.withColumn("rank", F.row_number().over(group.orderBy(*order))).where(F.col("rank") <= n)

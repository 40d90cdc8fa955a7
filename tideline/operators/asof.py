"""As-of joins: each left row with the nearest right row of its key in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.blocks import before, hot_blocks
from tideline.operators.grid import micros


def asof_join(
    left: DataFrame,
    right: DataFrame,
    *,
    by: str,
    left_on: str,
    right_on: str,
    columns: list[str],
    prefix: str = "asof_",
    strict: bool = False,
    forward: bool = False,
    tolerance_s: int | None = None,
    per_block: int = 200_000,
) -> DataFrame:
    """left with `<prefix><column>` of the last right row of its key at or before its time (strictly before if strict; the first at or after, or strictly after, if forward), null if none or further than tolerance_s.

    Right rows and the distinct times of the left are merged in one narrow order per key; wide left rows meet their match by
    an equi-join on key and time. A key of more than per_block rows of both sides together is cut into blocks of time, and
    each block's last right row carried into later ones over one row a block. Right rows of equal key and time count as
    one, the greatest by `columns`. Left rows are kept, repeated ones too; null keys and times match nothing.
    """
    sign = -1 if forward else 1
    at = lambda df, c: sign * micros(df[c])
    value = F.struct(micros(right[right_on]).alias("us"), *[right[c].alias(prefix + c) for c in columns])
    r = right.where(right[by].isNotNull() & right[right_on].isNotNull()).select(right[by].alias("_k"), at(right, right_on).alias("_t"), value.alias("_v")).groupBy("_k", "_t").agg(F.max("_v").alias("_v"))
    kind = r.schema["_v"].dataType
    asked = left.where(left[by].isNotNull() & left[left_on].isNotNull()).select(left[by].alias("_k"), at(left, left_on).alias("_t")).distinct()
    both = r.withColumn("_o", F.lit(1 if strict else 0)).unionByName(asked.withColumn("_v", F.lit(None).cast(kind)).withColumn("_o", F.lit(0 if strict else 1)))
    counted = right.select(right[by].alias("_k")).unionAll(left.select(left[by].alias("_k"))).where("_k is not null")
    rows, some_hot = hot_blocks(both, "_k", "_t", per_block, counted)
    last = lambda c: F.last(c, True)
    if some_hot:
        tails = rows.where("b >= 0").groupBy("_k", "b").agg(F.max_by("_v", F.when(F.col("_v").isNotNull(), F.col("_t"))).alias("_tail"))
        rows = rows.join(before(tails, "_k", "b", last, "_tail", "_c").drop("_tail"), ["_k", "b"], "left")
    else:
        rows = rows.withColumn("_c", F.lit(None).cast(kind))
    w = Window.partitionBy("_k", "b").orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, 0)
    seen = rows.select("_k", "_t", F.col("_v").isNull().alias("_asked"), F.coalesce(last("_v").over(w), F.col("_c")).alias("_v")).where("_asked and _v is not null")
    if tolerance_s is not None:
        seen = seen.where(F.abs(F.col("_t") * sign - F.col("_v.us")) <= tolerance_s * 1_000_000)
    match = seen.select(F.col("_k").alias("_mk"), F.col("_t").alias("_mt"), *[F.col(f"_v.{prefix}{c}").alias(prefix + c) for c in columns])
    keyed = left.withColumn("_lt", at(left, left_on))
    return keyed.join(match, (keyed[by] == F.col("_mk")) & (F.col("_lt") == F.col("_mt")), "left").drop("_lt", "_mk", "_mt")

"""Filling containers of fixed capacity with whole items."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.session import cut


MAX_PACKS = 1000  # packs are a small table whose rows become literals


def sum_of_squares(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of each size, placed in order by the sum-of-squares rule.

    With N(g) the number of open bins that have g units left, an item goes where the sum of N(g)^2 over gaps
    1..capacity-1 becomes smallest: into a bin with gap g (to gap g - size) or into a new bin; full bins do not count.
    Ties go to the smaller remaining gap, an old bin before a new one. Sizes must lie in 1..capacity.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    far = np.int64(1) << 60
    # Change of the sum when a bin goes from gap g to g - s: leave[g] + twice[g - s]; both are kept up to date bin by bin.
    twice = np.zeros(capacity + 1, dtype=np.int64)  # 2 N(g), with gaps 0 and capacity staying 0
    leave = np.full(capacity + 1, far)  # 2 - 2 N(g) where there is such a bin
    out = np.empty(len(sizes), dtype=np.int64)
    bins = 0
    for i, s in enumerate(sizes.tolist()):
        at, best = 0, int(far)
        if s < capacity:
            change = leave[s:capacity] + twice[: capacity - s]
            if leave[s] < far:
                change[0] -= 1  # fills the bin, so none arrives
            at = int(change.argmin())
            best = int(change[at])
        fresh = int(twice[capacity - s]) + 1 if s < capacity else 0
        if best <= fresh and best < far:
            gap = s + at
            b = open_bins[gap].pop()
            twice[gap] -= 2
            leave[gap] = 2 - twice[gap] if twice[gap] else far
        else:
            gap, b = capacity, bins
            bins += 1
        left = gap - s
        if left:
            open_bins[left].append(b)
            twice[left] += 2
            leave[left] = 2 - twice[left]
        out[i] = b
    return out


def _packed(group: str, level: int):
    """Packs the rows of one (pack, group) in the order of their hash; containers are numbered within it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["mix", "doc", "piece"], kind="stable")
        capacity = int(pdf["capacity"].iloc[0])
        b = sum_of_squares(pdf["size"].to_numpy(), capacity)
        fill = np.bincount(b, weights=pdf["size"].to_numpy()).astype(np.int64)
        head = f"{level}-{pdf[group].iloc[0]}-"
        return pdf.assign(container=[head + str(x) for x in b], filled=fill[b])

    return run


def pack(
    items: DataFrame,
    packs: DataFrame,
    *,
    item: str = "doc_id",
    size: str = "tokens",
    name: str = "pack_name",
    capacity: str = "capacity_tokens",
    per_group: int = 25_000,
    reopen_below: float = 0.98,
) -> DataFrame:
    """One row (pack_name, doc, piece, start, size, container, filled) per piece: items in containers of each pack's capacity.

    An item that exceeds the capacity alone is split into pieces of exactly the capacity, each a container of its own, and
    one remainder; every other item and every remainder is placed whole, by the sum-of-squares rule, in the order of a hash of
    its id. Groups of about per_group pieces are packed independently, as many as the pieces need. The pieces of
    containers filled to less than reopen_below (what a group leaves open at its end) are then packed once more, together
    with those of other groups, again in groups of about per_group; a single group is left as it is: there are no
    open containers of other groups to fill up. `filled` is the container's total size.

    Only (id, size) rows are moved. Defined cases: items of null or no size come out with a null container and size 0; items
    with the same id and rows repeated are items of their own; packs with null or non-positive capacity take nothing;
    of packs with the same name the largest capacity holds; empty tables give an empty result; other columns are ignored.
    """
    limits = packs.where((F.col(capacity) > 0) & F.col(name).isNotNull()).groupBy(F.col(name).alias("pack_name")).agg(F.max(F.col(capacity)).cast("int").alias("capacity"))
    # One row a pack: an array of them beside each item stands for the output that every item has in each pack anyway.
    rows = limits.limit(MAX_PACKS + 1).collect()
    if len(rows) > MAX_PACKS:
        raise ValueError(f"more than {MAX_PACKS} packs")
    sized = items.select(F.col(item).alias("doc"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("total"))
    schema = "pack_name string, doc {}, piece long, start long, size long, container string, filled long".format(sized.schema["doc"].dataType.simpleString())
    if not rows:
        return items.sparkSession.createDataFrame([], schema)
    table = F.array(*[F.struct(F.lit(r["pack_name"]).alias("pack_name"), F.lit(r["capacity"]).cast("long").alias("capacity")) for r in rows])
    each = sized.select("doc", "total", F.inline(table))
    whole = each.where("total > capacity").select("pack_name", "doc", "capacity", F.explode(F.expr("sequence(0L, total div capacity - 1)")).alias("piece"))
    final = ["pack_name", "doc", "piece", "start", "size", "container", "filled"]
    full = whole.select("pack_name", "doc", "piece", (F.col("piece") * F.col("capacity")).alias("start"), F.col("capacity").alias("size"), F.concat_ws("-", F.lit("f"), F.col("doc").cast("string"), "piece").alias("container"), F.col("capacity").alias("filled"))
    none = each.where("total = 0").select("pack_name", "doc", F.lit(0).cast("long").alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(0).cast("long").alias("size"), F.lit(None).cast("string").alias("container"), F.lit(0).cast("long").alias("filled"))
    split = F.col("total") > F.col("capacity")
    parts = each.select(
        "pack_name", "doc", "capacity", F.when(split, F.expr("total div capacity")).otherwise(0).cast("long").alias("piece"),
        F.when(split, F.col("total") - F.col("total") % F.col("capacity")).otherwise(0).cast("long").alias("start"),
        F.when(split, F.col("total") % F.col("capacity")).otherwise(F.col("total")).alias("size"), F.xxhash64("doc", F.lit(11)).alias("mix"),
    ).where("size > 0")
    groups = max(1, -(-sized.count() // per_group))
    carried = f"pack_name string, doc {sized.schema['doc'].dataType.simpleString()}, capacity long, piece long, start long, size long, mix long, {{}} long, container string, filled long"
    once = cut(parts.withColumn("part", F.pmod("mix", F.lit(groups)).cast("long")).groupBy("pack_name", "part").applyInPandas(_packed("part", 1), carried.format("part")))
    loose = F.col("filled") < reopen_below * F.col("capacity")
    left = {r["pack_name"]: r["n"] for r in once.where(loose).groupBy("pack_name").agg(F.count("*").alias("n")).collect()}
    if groups > 1 and left:
        second = F.coalesce(*[F.when(F.col("pack_name") == k, F.pmod("mix", F.lit(max(1, -(-v // per_group))))) for k, v in left.items()]).cast("long")
        again = once.where(loose).drop("container", "filled", "part").withColumn("part", second)
        again = again.groupBy("pack_name", "part").applyInPandas(_packed("part", 2), carried.format("part"))
        once = once.where(~loose).unionByName(again)
    return once.select(*final).unionByName(full.select(*final)).unionByName(none.select(*final))


def fill_report(packed: DataFrame, packs: DataFrame, *, name: str = "pack_name", capacity: str = "capacity_tokens") -> DataFrame:
    """(pack_name, containers, tokens, fill): how full each pack's containers are on average."""
    limits = packs.groupBy(F.col(name).alias("pack_name")).agg(F.max(F.col(capacity)).alias("capacity"))
    # size / filled adds up to one over the pieces of a container, so no distinct count is needed
    sums = packed.where("container is not null").groupBy("pack_name").agg(F.sum(F.col("size") / F.col("filled")).alias("c"), F.sum("size").alias("tokens"))
    return sums.join(limits, "pack_name").select("pack_name", F.round("c").cast("long").alias("containers"), "tokens", (F.col("tokens") / (F.round("c") * F.col("capacity"))).alias("fill"))


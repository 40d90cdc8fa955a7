"""Drawing records from several sources to target shares of the total size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut

LEVEL_BITS = 12  # hash bits told apart by one histogram: at most 4096 rows a source


def plain_source(c: Column) -> Column:
    """Spellings of one source name as one: lower case, words joined by single underscores; blank is null."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(c)), r"[\s_-]+", "_"), F.lit(""))


def _top(h: str, shift: str | int) -> Column:
    """The bits of a 64-bit hash above `shift`, in the order of unsigned numbers."""
    return F.expr(f"shiftrightunsigned({h}, cast({shift} as int))").bitwiseXOR(F.lit(-(2**63)).cast("long"))


def _edges(histogram: DataFrame, state: DataFrame) -> DataFrame:
    """state with `pre`, the first prefix at which the running size exceeds what is left of the source's rest, the size below it, and whether several hashes share the prefix.

    A window holds the prefixes of one source and level, at most 4096. Sources that never exceed it take every prefix.
    """
    w = Window.partitionBy("source").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    left = histogram.join(state.select("source", "rest", "below"), "source").withColumn("upto", F.sum("size").over(w) + F.col("below"))
    first = left.where("upto > rest").groupBy("source").agg(F.min(F.struct("at", "upto", "size", "several")).alias("e"))
    return state.join(first, "source", "left").select(
        "source", "rest", F.coalesce("e.at", F.lit(2**63 - 1)).alias("pre"), (F.coalesce("e.upto", F.lit(0)) - F.coalesce("e.size", F.lit(0))).cast("long").alias("below"),
        F.coalesce("e.upto", F.lit(0)).cast("long").alias("upto"), F.coalesce("e.several", F.lit(False)).alias("several"),
    )


def _thresholds(rows: DataFrame, rests: DataFrame) -> DataFrame:
    """(source, shift, pre, include): an item is within its source's rest if its hash above `shift` lies below `pre`, or equals it and `include` holds."""
    state, inside, found = rests.withColumn("below", F.lit(0).cast("long")), rows, []
    for level in range(-(-64 // LEVEL_BITS)):
        shift = max(0, 64 - LEVEL_BITS * (level + 1))
        sums = inside.groupBy("source", _top("h", shift).alias("at")).agg(F.sum("size").alias("size"), (F.min("h") != F.max("h")).alias("several"))
        edges = cut(_edges(sums, state))
        nearer = ~F.col("several") & (F.col("upto") - F.col("rest") < F.col("rest") - F.col("below"))
        again = F.col("several") & F.lit(shift > 0)
        found.append(edges.where(~again).select("source", F.lit(shift).alias("shift"), "pre", F.coalesce(nearer & (F.col("pre") < 2**63 - 1), F.lit(False)).alias("include")))
        state = edges.where(again).select("source", "rest", "below", "pre")
        if not shift or state.isEmpty():
            break
        inside = cut(inside.join(state.select("source", "pre"), "source").where(_top("h", shift) == F.col("pre")).drop("pre"))
        state = state.drop("pre")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out


def mix(
    items: DataFrame,
    targets: DataFrame,
    *,
    item: str = "doc_id",
    source: str = "source",
    size: str = "tokens",
    share: str = "target_share",
    repeats: str = "max_repeats",
    total: float | None = None,
    seed: int = 17,
) -> tuple[DataFrame, DataFrame]:
    """(selection, shares): which items are drawn how often, and what each source reaches.

    selection is (doc, source, size, copies); shares is (source, target_share, reached_share, available, budget, drawn,
    copies_each, docs). Source names are compared in their plain form. A source's budget is its target share of `total`,
    at most max_repeats times its size, so a scarce source falls short, alone, and reached_share says so. Without `total`, it
    is the size of all items of targeted sources.

    Every item is used floor(budget / available) times, and once more if its 64-bit hash lies below the source's
    threshold, which is where the sizes in order of the hash use up the rest. The threshold comes from histograms: sizes
    are added up by source and the top 12 hash bits, the bucket in which the rest runs out is found, and only that
    bucket's items are divided by the next 12 bits, until one hash value is left, which is taken if that brings the sum
    nearer to the budget. So nothing is sorted, thresholds of growing budgets are nested, and selecting is a filter. Budgets
    and thresholds are tables that meet the items by equi-joins on the source, however many sources there are.

    Defined cases: items with null source, id or size, without size, or of a source without target are never drawn; items
    with equal ids share a hash and are drawn together; null or non-positive shares and repeats draw nothing; of several
    targets of a source the greatest holds; sources without items reach 0; empty tables work; other columns are ignored.
    """
    want = targets.select(plain_source(F.col(source)).alias("source"), F.struct(F.col(share).cast("double").alias("share"), F.col(repeats).cast("long").alias("repeats")).alias("t"))
    want = cut(want.where("source is not null and t.share > 0 and t.repeats > 0").groupBy("source").agg(F.max("t").alias("t")).select("source", "t.*"))
    rows = items.select(F.col(item).alias("doc"), plain_source(F.col(source)).alias("source"), F.col(size).cast("long").alias("size"), F.xxhash64(F.col(item), F.lit(seed)).alias("h"))
    rows = cut(rows.where("size > 0 and doc is not null").join(want.select("source"), "source").select("doc", "source", "size", "h"))

    have = cut(rows.groupBy("source").agg(F.sum("size").alias("available")))
    if total is None:
        total = float(have.agg(F.sum("available")).first()[0] or 0)
    most = F.col("repeats") * F.coalesce("available", F.lit(0))
    plan = want.join(have, "source", "left").select("source", "share", "repeats", F.coalesce("available", F.lit(0)).alias("available"), F.least(F.col("share") * F.lit(float(total)), most.cast("double")).alias("budget"))
    each = F.when(F.col("available") > 0, F.least(F.floor(F.col("budget") / F.col("available")), F.col("repeats"))).otherwise(0)
    plan = cut(plan.withColumn("copies_each", each.cast("int")))
    rest = plan.select("source", (F.col("budget") - F.col("copies_each") * F.col("available")).alias("rest")).where("rest > 0")
    plan = cut(plan.join(_thresholds(rows, rest), "source", "left"))

    top = _top("h", "shift")
    under = F.coalesce((top < F.col("pre")) | ((top == F.col("pre")) & F.col("include")), F.lit(False))
    selection = rows.join(plan.select("source", "copies_each", "shift", "pre", "include"), "source").select("doc", "source", "size", (F.col("copies_each") + under.cast("int")).alias("copies")).where("copies > 0")
    drawn = cut(selection.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("drawn"), F.count("*").alias("docs")))
    everything = drawn.agg(F.sum("drawn")).first()[0]
    shares = plan.join(drawn, "source", "left").select("source", F.col("share").alias("target_share"), "available", "budget", "copies_each", F.coalesce("drawn", F.lit(0)).alias("drawn"), F.coalesce("docs", F.lit(0)).alias("docs"))
    return selection, shares.withColumn("reached_share", F.try_divide(F.col("drawn"), F.lit(everything)))

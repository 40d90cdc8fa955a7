"""Walk-forward folds, lift against matched baselines, and corrections for many tests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.operators.draws import draw


def quarterly_folds(positions: DataFrame, *, key: str, day: str, position: str, horizon: int, least_train: int, cut_tail: bool) -> DataFrame:
    """(key, quarter, train_stop, test_lo, test_hi): expanding folds over positions, one a quarter.

    Training stops `horizon` rows before the quarter, and the quarter is tested once least_train rows lie before that. With
    cut_tail every quarter loses its last `horizon` rows; otherwise only rows whose outcome is not yet observable go.
    """
    q = positions.groupBy(key, F.trunc(day, "quarter").alias("quarter")).agg(F.min(position).alias("lo"), F.max(position).alias("hi"))
    last = F.max("hi").over(Window.partitionBy(key))
    hi = F.col("hi") - horizon if cut_tail else F.least(F.col("hi"), last - horizon)
    out = q.select(key, "quarter", (F.col("lo") - horizon).alias("train_stop"), F.col("lo").alias("test_lo"), hi.alias("test_hi"))
    return out.where((F.col("train_stop") >= least_train) & (F.col("test_hi") >= F.col("test_lo")))


def purged(rows: DataFrame, *, key: str, day: str, start: Column, horizon: int) -> DataFrame:
    """Rows before `start` without the last `horizon` of each key, whose outcomes reach beyond it."""
    before = rows.where(F.col(day) < start)
    w = Window.partitionBy(key).orderBy(F.col(day).desc())
    return before.withColumn("_back", F.row_number().over(w)).where(F.col("_back") > horizon).drop("_back")


def lift(rows: DataFrame, by: list[str], *, hit: str, signal: str, week: Column) -> DataFrame:
    """(by..., n, signals, hit_rate, base_rate, lift, same_week_lift): how much more often signals hit than all rows, and than a random row of the same week."""
    base = F.avg(F.col(hit).cast("double")).over(Window.partitionBy(*by, week))
    s, h = F.col(signal).cast("double"), F.col(hit).cast("double")
    agg = rows.withColumn("_week", base).groupBy(*by).agg(F.count("*").alias("n"), F.sum(s).alias("s"), F.sum(s * h).alias("sh"), F.avg(h).alias("base_rate"), F.sum(s * F.col("_week")).alias("e"))
    rate = F.try_divide(F.col("sh"), F.nullif("s", F.lit(0.0)))
    return agg.select(*by, "n", F.col("s").cast("long").alias("signals"), rate.alias("hit_rate"), "base_rate", F.try_divide(rate, F.nullif("base_rate", F.lit(0.0))).alias("lift"), F.try_divide("sh", F.nullif("e", F.lit(0.0))).alias("same_week_lift"))


def newey_west(rows: DataFrame, *, key: str, order: str, value: str) -> DataFrame:
    """(key, n, lags, t): the mean over its standard error with Bartlett weights up to max(1, floor(4 (n / 100)^(2/9))) lags, from one sorted array a key."""
    v = F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value])
    a = rows.where(F.col(value).isNotNull()).groupBy(key).agg(v.alias("v")).withColumn("n", F.size("v"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda p, q: p + q)
    a = a.withColumn("mean", total("v") / F.col("n")).withColumn("lags", F.greatest(F.lit(1), F.least(F.col("n") - 1, F.floor(4 * F.pow(F.col("n") / 100, F.lit(2 / 9))).cast("int"))))
    a = a.withColumn("e", F.transform("v", lambda x: x - F.col("mean")))
    gamma = lambda k: total(F.zip_with(F.slice("e", k + 1, F.col("n")), F.slice("e", F.lit(1), F.col("n") - k), lambda p, q: p * q)) / F.col("n")
    weighted = F.transform(F.sequence(F.lit(1), F.col("lags")), lambda k: 2 * (1 - k / (F.col("lags") + 1)) * gamma(k))
    variance = total(F.transform("e", lambda x: x * x)) / F.col("n") + total(weighted)
    t = F.when(variance > 0, F.col("mean") / F.sqrt(variance / F.col("n"))).when(F.col("mean") == 0, 0.0)
    return a.where("n > 1").select(key, "n", "lags", t.alias("t"))


def holm(rows: DataFrame, *, by: list[str], p: str, ties: list[str]) -> DataFrame:
    """rows with `holm`: step-down adjusted p-values, the running maximum of p times the hypotheses left, at most 1."""
    w = Window.partitionBy(*by).orderBy(p, *ties)
    left = F.count("*").over(Window.partitionBy(*by)) - F.row_number().over(w) + 1
    stepped = rows.withColumn("_h", F.col(p) * left)
    return stepped.withColumn("holm", F.least(F.lit(1.0), F.max("_h").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("_h")


def block_bootstrap(blocks: DataFrame, draws: DataFrame, *, block: str, sums: list[str]) -> DataFrame:
    """(draw, sums...): totals of each draw, given the blocks and an explicit table (draw, block) of which block each draw takes; blocks are pre-aggregated, so a draw costs one row a block."""
    return draws.join(blocks, block).groupBy("draw").agg(*[F.sum(s).alias(s) for s in sums])


def circular_draws(spark, n: int, length: int, samples: int, seed: int) -> DataFrame:
    """(draw, block): circular moving-block draws over blocks 0..n-1, starts from a digest of (seed, draw, part), n blocks a draw."""
    parts = -(-n // length)
    start = draw(seed, "draw", "part")
    rows = spark.range(samples).withColumnRenamed("id", "draw").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))).withColumn("start", start)
    return rows.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(length - 1)))).where(F.col("part") * length + F.col("k") < n).select("draw", F.pmod(F.col("start") + F.col("k"), F.lit(n)).cast("int").alias("block"))


def binary_metrics(rows: DataFrame, by: list[str], *, target: str, probability: str, bins: int = 10) -> DataFrame:
    """(by..., n, brier, log_loss, ece): calibration of probabilities; equal-width bins, the last one closed. Bins are aggregated before they are compared."""
    y, p = F.col(target).cast("double"), F.col(probability)
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    binned = rows.where(y.isNotNull() & p.isNotNull()).groupBy(*by, F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.sum(y).alias("y"), F.sum(p).alias("p"), F.sum((p - y) * (p - y)).alias("b"), F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("l"))
    n = F.sum("n")
    return binned.groupBy(*by).agg(n.alias("n"), (F.sum("b") / n).alias("brier"), (F.sum("l") / n).alias("log_loss"), (F.sum(F.abs(F.col("y") - F.col("p"))) / n).alias("ece"))


def auc(rows: DataFrame, by: list[str], *, target: str, score: str) -> DataFrame:
    """(by..., auc): area under the ROC curve from counts per distinct score, ties half; rows are aggregated by score before they are ordered."""
    y = F.col(target).cast("long")
    at = rows.where(F.col(score).isNotNull() & y.isNotNull()).groupBy(*by, score).agg(F.sum(y).alias("pos"), F.sum(1 - y).alias("neg"))
    w = Window.partitionBy(*by).orderBy(score).rowsBetween(Window.unboundedPreceding, -1)
    won = F.col("pos") * (F.coalesce(F.sum("neg").over(w), F.lit(0)) + F.col("neg") / 2)
    return at.withColumn("_won", won).groupBy(*by).agg(F.try_divide(F.sum("_won"), F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0)).cast("double")).alias("auc"))

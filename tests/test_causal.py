"""Cutting off the future changes nothing that looks back."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import labels as L
from tideline.operators.policy import cap_and_cooldown, cusum


def features(d):
    p, w = F.col("price"), X.series("corridor", "day")
    return d.select(
        "corridor", "day", X.change(p, w, 5).alias("r"), X.zscore(p, w, 20).alias("z"), X.zscore(p, w, 20, 5, lag=1).alias("past"), X.rank_average(p, w, 30).alias("ra"),
        X.rank_max(p, w, 30).alias("rm"), X.causal_percentile(p, w, 60, 20).alias("cp"), X.trailing_quantile(p, w, 60, 0.6, 20).alias("tq"), X.expanding_quantile(p, w, 0.5).alias("eq"),
        X.streak(p < F.lag(p).over(w), w, 3).alias("s"), X.fill_forward(p, w, 3).alias("f"), X.beta(p, F.col("n"), w, 30, 10).alias("b"),
    )


@pytest.mark.parametrize("cut", ["1996-05-01", "1998-02-11"])
def test_truncating_the_future_changes_no_feature(spark, sf, cut):
    d = P.daily_panel(spark, sf).where("corridor in ('1-URGENT', '5-LOW')").cache()
    whole = {tuple(x) for x in features(d).where(F.col("day") <= cut).collect()}
    part = {tuple(x) for x in features(d.where(F.col("day") <= cut)).collect()}
    assert whole == part and whole


def test_decisions_do_not_depend_on_later_candidates(spark, sf):
    d = P.daily_panel(spark, sf).where("price < 150000")
    run = lambda x: {tuple(r) for r in cap_and_cooldown(x, key="corridor", at="day", cooldown=3, cap=2).collect()}
    cut = dt.date(1997, 1, 1)
    assert {x for x in run(d) if x[1] <= cut} == run(d.where(F.col("day") <= F.lit(cut)))


def test_cap_comes_before_cooldown(spark):
    days = [dt.date(2026, 1, x) for x in (5, 6, 8, 9, 12)]
    df = spark.createDataFrame([("a", x) for x in days] + [("a", days[0]), (None, days[0]), ("b", None)], "k string, d date")
    got = sorted(x["d"].day for x in cap_and_cooldown(df, key="k", at="d", cooldown=3, cap=2).collect())
    assert got == [5, 8, 12]


def test_cusum_fires_and_starts_anew(spark):
    rows = [("a", i, x, s) for i, (x, s) in enumerate([(0.01, 0.04), (0.01, 0.04), (0.01, 0.04), (-0.01, 0.04), (None, 0.04), (0.5, None), (0.5, -1.0)])]
    got = cusum(spark.createDataFrame(rows, "k string, t int, x double, s double"), key="k", at="t", change="x", sigma="s", multiple=0.5)
    assert [x["fired"] for x in got.orderBy("t").collect()] == [False, True, False, False, False, False, False]


def label_rows(spark, prices):
    d = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(prices)], "corridor string, day int, price double")
    return d, F.col("price"), X.series("corridor", "day")


def test_two_regrets(spark):
    d, p, w = label_rows(spark, [10, 9, 11, 12, 13])
    rows = d.select(L.regret_paid(p, w, 1).alias("a"), L.regret_best(p, w, 1).alias("b"), L.benefit_symmetric(p, w, 1).alias("s"), L.benefit_forward(p, w, 1).alias("f")).collect()
    assert [x["a"] and round(x["a"], 4) for x in rows] == [1000.0, 0.0, 0.0, 0.0, None]
    assert round(rows[0]["b"], 3) == round((10 / 9 - 1) * 1e4, 3)
    assert round(rows[1]["s"], 2) == 1666.67 and round(rows[1]["f"], 2) == 2222.22


def test_barriers_and_first_steps(spark):
    one = lambda prices, b: label_rows(spark, prices)[0].select(b(*label_rows(spark, prices)[1:]).alias("x")).collect()[0]["x"]
    barrier = lambda p, w: L.triple_barrier(p, w, 3, F.lit(25), F.lit(50))
    assert one([100, 101, 99, 99], barrier) == 1 and one([100, 99, 101, 101], barrier) == 0 and one([100, 100, 100], barrier) is None
    d, p, w = label_rows(spark, [100, 99.9, 99.6, 100, 100])
    assert [x[0] for x in d.select(L.first_improvement(p, w, 2, 25)).collect()] == [2, 1, 3, 0, 0]

"""The further models against brute force, optimality conditions and held-out rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tideline.operators import learn as N
from tideline.operators import models as M
from tideline.queries import learning

RNG = np.random.default_rng(3)


def test_isotonic_against_the_min_max_formula():
    for n in (1, 2, 30):
        s, y = RNG.integers(0, 12, n).astype(float), RNG.integers(0, 2, n).astype(float)
        at, value = N.isotonic(s, y)
        sums = [(y[s == a].sum(), (s == a).sum()) for a in at]
        mean = lambda i, j: sum(x[0] for x in sums[i : j + 1]) / sum(x[1] for x in sums[i : j + 1])
        want = [max(min(mean(i, j) for j in range(k, len(at))) for i in range(k + 1)) for k in range(len(at))]
        assert np.allclose(value, want) and (np.diff(value) >= -1e-12).all()


def test_sigmoid_calibrates_on_average():
    p = RNG.uniform(0.05, 0.95, 4000)
    y = (RNG.uniform(size=4000) < 1 / (1 + np.exp(-(2 * N.logit(p) - 1)))).astype(float)
    q = N.sigmoid_calibrator(p, y)(p)
    assert abs(q.mean() - y.mean()) < 1e-4 and np.mean((q - y) ** 2) < np.mean((p - y) ** 2)


def test_group_dro_helps_the_worst_group():
    x = RNG.normal(size=(3000, 2))
    group = np.where(np.arange(3000) < 2700, "many", "few")
    y = (RNG.uniform(size=3000) < 1 / (1 + np.exp(-np.where(group == "many", 2 * x[:, 0], -x[:, 0] + 2 * x[:, 1])))).astype(float)

    def worst(b):
        p = np.clip(M.logit_score(b, x), 1e-6, 1 - 1e-6)
        loss = -(y * np.log(p) + (1 - y) * np.log(1 - p))
        return max(loss[group == g].mean() for g in ("many", "few"))

    b, weight = N.group_dro(x, y, group)
    assert abs(weight.sum() - 1) < 1e-9 and weight[0] > 0.5  # groups in sorted order: few, many
    assert worst(b) < worst(M.ridge_logit(x, y, 2.0, weight=N.class_weights(y))) - 0.05


def test_ranker_orders_held_out_rows():
    x, query = RNG.normal(size=(1400, 3)), np.repeat(np.arange(200), 7)
    value = x @ [1.0, -2.0, 0.0] + RNG.normal(0, 0.3, 1400) + 100 * RNG.normal(size=200)[query]  # weeks differ in level
    relevance = np.digitize(value - np.array([value[query == q].mean() for q in query]), [-1, 0, 1])
    b = N.pairwise_ranker(x[:700], relevance[:700], query[:700])
    hits = [np.sign((x[i] - x[j]) @ b) == np.sign(relevance[i] - relevance[j]) for q in range(100, 200) for i in range(7 * q, 7 * q + 7) for j in range(7 * q, i) if relevance[i] != relevance[j]]
    assert np.mean(hits) > 0.9
    assert not N.pairwise_ranker(x[:7], np.ones(7), np.zeros(7)).any()


def test_shapes_are_the_leading_eigenvectors():
    v = RNG.normal(size=(500, 5)) @ np.diag([3, 2, 1, 0.5, 0.1])
    mean, basis = N.shape_basis(v, 2)
    _, vectors = np.linalg.eigh(np.cov(v.T))
    assert np.allclose(np.abs(basis @ vectors[:, ::-1][:, :2]), np.eye(2), atol=1e-8) and np.allclose(mean, v.mean(0))
    assert all(b[np.abs(b).argmax()] > 0 for b in basis)


def test_regimes_fall_back_to_the_whole():
    x, y, level = RNG.normal(size=(300, 2)), RNG.integers(0, 2, 300).astype(float), RNG.uniform(size=300)
    whole = M.logit_score(M.ridge_logit(x, y), x)
    assert np.allclose(N.regime_experts(x, y, level, x, level, least=1000), whole)
    split = N.regime_experts(x, y, level, x, np.where(np.arange(300) == 0, np.nan, level))
    assert split[0] == whole[0] and not np.allclose(split, whole)
    assert N.economic_weights(np.array([0.0, 200.0, 1e9, np.nan])).tolist() == [1, 2, 5, 1]


def test_walks_see_only_the_past(spark):
    days = pd.date_range("2020-01-01", "2022-12-31")
    pdf = pd.DataFrame([(k, d.date(), float(i)) for k in "ab" for i, d in enumerate(days)], columns=["corridor", "day", "x"])
    df = spark.createDataFrame(pdf)

    def fit(train, test):
        return pd.DataFrame({"corridor": [test["corridor"].iloc[0]], "year": [str(test["day"].max())[:4]], "last": [str(max(train["day"]))], "n": [len(train)]})

    got = N.walk_years(df, by="corridor", day="day", columns=["corridor", "day", "x"], schema="corridor string, year string, last string, n int", horizon=5, least=1, fit=fit).orderBy("corridor", "year").collect()
    assert [(x["corridor"], x["year"], x["last"], x["n"]) for x in got] == [(k, y, last, n) for k in "ab" for y, last, n in (("2021", "2020-12-26", 361), ("2022", "2021-12-26", 726))]
    pooled = N.walk_years(df, by=None, day="day", columns=["corridor", "day", "x"], schema="corridor string, year string, last string, n int", horizon=5, least=1, fit=fit).collect()
    assert sorted(x["n"] for x in pooled) == [722, 1452]


@pytest.mark.parametrize("name", ["group_dro_scores", "shape_scores", "stacked_scores"])
def test_scores_are_probabilities_of_distinct_days(spark, sf, name):
    got = getattr(learning, name)(spark, sf)
    x = got.agg(F.count("*").alias("n"), F.count_distinct("corridor", "day").alias("d"), F.min("score").alias("lo"), F.max("score").alias("hi")).first()
    assert x["n"] == x["d"] > 0 and 0 <= x["lo"] <= x["hi"] <= 1


@pytest.mark.parametrize("name", ["calibrated_scores", "stacked_scores"])
def test_a_series_of_one_class_has_no_scores_and_the_others_keep_theirs(spark, tmp_path, name):
    days = pd.date_range("2020-01-01", "2022-06-30")
    price = {"flat": np.full(len(days), 100.0), "wild": np.random.default_rng(5).uniform(50, 150, len(days))}
    for folder, corridors in (("both", ["flat", "wild"]), ("flat", ["flat"])):
        orders = pd.concat(pd.DataFrame({"o_orderpriority": k, "o_orderdate": days, "o_totalprice": price[k]}) for k in corridors)
        spark.createDataFrame(orders).write.parquet(f"{tmp_path}/{folder}/orders.parquet")
    got = getattr(learning, name)(spark, f"{tmp_path}/both").toPandas()
    assert sorted(got.day) == [d.date() for d in days if d.year > 2020] and set(got.corridor) == {"wild"} and not got.isna().any().any()
    assert not len(getattr(learning, name)(spark, f"{tmp_path}/flat").toPandas())


def test_folds_and_ablations_report_every_year_once(spark, sf):
    folds = learning.fold_evaluation(spark, sf).toPandas()
    assert len(folds) and not folds.duplicated(["corridor", "year"]).any() and (folds.hits <= folds.signals).all() and (folds.signals <= folds.days).all()
    sets = learning.feature_set_ablation(spark, sf).toPandas()
    assert (sets.groupby(["corridor", "year"]).size() == len(learning.SETS)).all() and sets.brier.between(0, 1).all()


def test_groups_that_are_no_series_are_refused():
    with pytest.raises(ValueError, match="aggregate"):
        M.bounded(pd.DataFrame({"x": np.zeros(M.SERIES_ROWS + 1)}))

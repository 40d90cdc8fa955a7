"""Walk-forward scores of the further models over the daily panel, each year by what was known before it. Tested against brute force and held-out rows instead of SQL."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import labels as L
from tideline.operators import learn as N
from tideline.operators import models as M
from tideline.queries.registry import query

c = lambda name: F.col(name)
FEATURES = ["r1", "r5", "z20", "rank60"]


def _rows(spark, sf):
    """Features, targets, regret, ranking week and volatility of every day."""
    p, w = c("price"), X.series("corridor", "day")
    d = P.daily_panel(spark, sf).withColumn("r1", X.change(p, w))
    regret = L.regret_paid(p, w, 5)
    return d.select(
        "corridor", "day", "r1", X.change(p, w, 5).alias("r5"), X.zscore(p, w, 20).alias("z20"), X.rank_average(p, w, 60).alias("rank60"), X.rolling(F.stddev_samp, c("r1"), w, 20).alias("vol"),
        *[F.lag("r1", k).over(w).alias(f"s{k}") for k in range(5)], regret.alias("regret"), (regret <= 1000).cast("double").alias("target"), F.date_trunc("week", "day").cast("string").alias("week"),
    )


COLUMNS = ["corridor", "day", *FEATURES, "vol", "regret", "target", "week"]


def _scored(test, score):
    return pd.DataFrame({"corridor": test["corridor"], "day": test["day"], "score": score})


def _known(train):
    train = train[train["target"].notna()]
    return train if train["target"].nunique() == 2 else None


def _walk(spark, sf, by, fit, columns=None, schema="corridor string, day date, score double"):
    return N.walk_years(_rows(spark, sf), by=by, day="day", columns=columns or COLUMNS, schema=schema, horizon=5, least=120, fit=fit)


@query()
def group_dro_scores(spark, sf):
    """One model over all corridors whose groups (corridor, calm or not) gain weight with their loss."""

    def fit(train, test):
        train = _known(train)
        if train is None:
            return None
        calm = train["vol"].fillna(train["vol"].median()) <= train["vol"].quantile(0.67)
        x, t = N.prepared(train, test, FEATURES)
        b, _ = N.group_dro(x, train["target"].to_numpy(float), (train["corridor"] + calm.map({True: "|calm", False: "|wild"})).to_numpy())
        return _scored(test, M.logit_score(b, t))

    return _walk(spark, sf, None, fit)


@query()
def ranker_scores(spark, sf):
    """A linear score that orders the days of a week by their graded relevance."""

    def fit(train, test):
        train = _known(train)
        if train is None:
            return None
        x, t = N.prepared(train, test, FEATURES)
        relevance = 3 - np.searchsorted([25, 1000, 3000], train["regret"].to_numpy(float))
        return _scored(test, t @ N.pairwise_ranker(x, relevance, train["week"].to_numpy()))

    return _walk(spark, sf, "corridor", fit)


@query()
def shape_scores(spark, sf):
    """Days scored by the coordinates of their last five returns on the two main shapes of all corridors."""
    shape = [f"s{k}" for k in range(5)]

    def fit(train, test):
        train, test = train.dropna(subset=shape), test.dropna(subset=shape)
        train = _known(train)
        if train is None or not len(test):
            return None
        rows = lambda d: (lambda v: (v - v.mean(1, keepdims=True)) / np.maximum(v.std(1, keepdims=True), 1e-12))(d[shape].to_numpy(float))
        mean, basis = N.shape_basis(rows(train), 2)
        at, to = (rows(train) - mean) @ basis.T, (rows(test) - mean) @ basis.T
        return _scored(test, M.logit_score(M.ridge_logit(at, train["target"].to_numpy(float)), to)).assign(first=to[:, 0], second=to[:, 1])

    return _walk(spark, sf, None, fit, ["corridor", "day", *shape, "target"], "corridor string, day date, score double, first double, second double")


@query()
def calibrated_scores(spark, sf):
    """Scores of a model fitted on the older two thirds of the past, and the same calibrated by a sigmoid and by an isotonic fit on the newer third."""

    def fit(train, test):
        known = train[train["target"].notna()]
        n = len(known) * 2 // 3
        old, new = known[:n], known[n + 5 :]
        if old["target"].nunique() < 2 or new["target"].nunique() < 2:
            return None
        ready = M.Prepared(old[FEATURES].to_numpy(float))
        b = M.ridge_logit(ready(old[FEATURES].to_numpy(float)), old["target"].to_numpy(float))
        raw = lambda d: M.logit_score(b, ready(d[FEATURES].to_numpy(float)))
        y = new["target"].to_numpy(float)
        return _scored(test, raw(test)).assign(sigmoid=N.sigmoid_calibrator(raw(new), y)(raw(test)), isotonic=N.isotonic_calibrator(raw(new), y)(raw(test)))

    return _walk(spark, sf, "corridor", fit, schema="corridor string, day date, score double, sigmoid double, isotonic double")


@query()
def stacked_scores(spark, sf):
    """A logistic regression over the scores of three models on days they had not seen, with days whose mistake costs more weighing more."""

    def fit(train, test):
        known = train[train["target"].notna()]
        n = len(known) // 2
        old, new = known[:n], known[n + 5 :]
        if old["target"].nunique() < 2 or new["target"].nunique() < 2:
            return None
        ready = M.Prepared(old[FEATURES].to_numpy(float))
        x, y = ready(old[FEATURES].to_numpy(float)), old["target"].to_numpy(float)
        columns = lambda d: N.logit(np.column_stack([M.FITS[k](x, y, ready(d[FEATURES].to_numpy(float))) for k in ("logit", "stumps", "nearest")]))
        b = M.ridge_logit(columns(new), new["target"].to_numpy(float), weight=N.economic_weights(new["regret"].to_numpy(float)))
        return _scored(test, M.logit_score(b, columns(test)))

    return _walk(spark, sf, "corridor", fit)


@query()
def regime_expert_scores(spark, sf):
    """A model for each third of past volatility, and the model of all days where a third has too few."""

    def fit(train, test):
        train = _known(train)
        if train is None or train["vol"].notna().sum() < 3:
            return None
        x, t = N.prepared(train, test, FEATURES)
        return _scored(test, N.regime_experts(x, train["target"].to_numpy(float), train["vol"].to_numpy(float), t, test["vol"].to_numpy(float)))

    return _walk(spark, sf, "corridor", fit)


@query()
def feature_importances(spark, sf):
    """How far each standardised feature moves the logit, by corridor and year, with its sign."""

    def fit(train, test):
        train = _known(train)
        if train is None:
            return None
        full = train.dropna(subset=FEATURES)
        if full["target"].nunique() < 2:
            return None
        b = M.ridge_logit(M.Prepared(full[FEATURES].to_numpy(float))(full[FEATURES].to_numpy(float)), full["target"].to_numpy(float))
        return pd.DataFrame({"corridor": test["corridor"].iloc[0], "year": pd.to_datetime(test["day"]).dt.year.iloc[0], "feature": FEATURES, "importance": np.abs(b[1:]), "signed_effect": b[1:]})

    return _walk(spark, sf, "corridor", fit, schema="corridor string, year int, feature string, importance double, signed_effect double")


@query()
def refit_logistic_signals(spark, sf):
    """Days whose score reaches the ninth decile of the training scores, the model being fitted anew each year."""

    def fit(train, test):
        train = _known(train)
        if train is None:
            return None
        x, t = N.prepared(train, test, FEATURES)
        b = M.ridge_logit(x, train["target"].to_numpy(float))
        edge, score = np.quantile(M.logit_score(b, x), 0.9), M.logit_score(b, t)
        return _scored(test, score).assign(threshold=edge)[score >= edge]

    return _walk(spark, sf, "corridor", fit, schema="corridor string, day date, score double, threshold double")


QUANTILES = (0.8, 0.9, 0.95)


@query()
def fold_evaluation(spark, sf):
    """Each year: a model fitted without the year before picks the score quantile that did best in it, is fitted anew with it and tested; a year in which none beat its days by ten signals is diagnostic."""

    def fit(train, test):
        train = _known(train)
        test = test[test["target"].notna()]
        if train is None or not len(test):
            return None
        when = pd.to_datetime(train["day"])
        last = when.dt.year.max()
        inner, chosen = train[when.dt.year < last][:-5], train[when.dt.year == last]
        if len(inner) < 60 or inner["target"].nunique() < 2:
            return None
        x, s = N.prepared(inner, chosen, FEATURES)
        b = M.ridge_logit(x, inner["target"].to_numpy(float))
        fitted, score, hit = M.logit_score(b, x), M.logit_score(b, s), chosen["target"].to_numpy(float)
        lift = {q: hit[score >= np.quantile(fitted, q)].mean() / max(hit.mean(), 1e-9) for q in QUANTILES if (score >= np.quantile(fitted, q)).sum() >= 10}
        best = max(lift, key=lambda q: (lift[q], q)) if lift else QUANTILES[1]
        x, t = N.prepared(train, test, FEATURES)
        b = M.ridge_logit(x, train["target"].to_numpy(float))
        score, hit = M.logit_score(b, t), test["target"].to_numpy(float)
        signal = score >= np.quantile(M.logit_score(b, x), best)
        status = "selected" if lift and lift[best] > 1 else "diagnostic"
        return pd.DataFrame({"corridor": test["corridor"].iloc[0], "year": [int(str(test["day"].iloc[0])[:4])], "quantile": best, "status": status, "days": len(test), "signals": int(signal.sum()), "hits": int(hit[signal].sum()), "base_rate": hit.mean()})

    return _walk(spark, sf, "corridor", fit, schema="corridor string, year int, quantile double, status string, days int, signals int, hits int, base_rate double")


SETS = {"base": FEATURES, "with_volatility": [*FEATURES, "vol"], "without_rank": FEATURES[:-1]}


@query()
def feature_set_ablation(spark, sf):
    """The same fit and test for several sets of features, a row per set, corridor and year: Brier score and the hit rate of the best tenth of days."""

    def fit(train, test):
        train = _known(train)
        test = test[test["target"].notna()]
        if train is None or len(test) < 10:
            return None
        rows, hit = [], test["target"].to_numpy(float)
        for name, features in SETS.items():
            x, t = N.prepared(train, test, features)
            score = M.logit_score(M.ridge_logit(x, train["target"].to_numpy(float)), t)
            top = np.argsort(-score, kind="stable")[: max(1, len(test) // 10)]
            rows.append((test["corridor"].iloc[0], int(str(test["day"].iloc[0])[:4]), name, len(test), float(((score - hit) ** 2).mean()), float(hit[top].mean()), float(hit.mean())))
        return pd.DataFrame(rows, columns=["corridor", "year", "variant", "days", "brier", "top_hit_rate", "base_rate"])

    return _walk(spark, sf, "corridor", fit, schema="corridor string, year int, variant string, days int, brier double, top_hit_rate double, base_rate double")

"""More small deterministic models: robust over groups, ranking within weeks, shapes, calibration, stacking and regime experts."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.models import Prepared, bounded, logit_score, ridge_logit


def class_weights(y: np.ndarray) -> np.ndarray:
    """Weights under which both classes weigh the same."""
    share = np.where(y == 1, y.mean(), 1 - y.mean())
    return 0.5 / np.maximum(share, 1e-9)


def group_dro(x: np.ndarray, y: np.ndarray, group: np.ndarray, *, l2: float = 2.0, rounds: int = 12, eta: float = 0.5) -> tuple[np.ndarray, np.ndarray]:
    """(coefficients, weights of the groups in sorted order): the logistic regression whose groups gain weight exponentially with their loss, so that the worst group counts most."""
    names, at = np.unique(group, return_inverse=True)
    count = np.bincount(at)
    weight = np.full(len(names), 1 / len(names))
    base = class_weights(y)
    for _ in range(rounds):
        b = ridge_logit(x, y, l2, weight=base * weight[at] / count[at] * len(y))
        p = np.clip(logit_score(b, x), 1e-6, 1 - 1e-6)
        loss = np.bincount(at, weights=-(y * np.log(p) + (1 - y) * np.log(1 - p))) / count
        weight = weight * np.exp(eta * loss)
        weight /= weight.sum()
    return b, weight


def pairwise_ranker(x: np.ndarray, relevance: np.ndarray, query: np.ndarray, l2: float = 1.0) -> np.ndarray:
    """Coefficients of a linear score that orders rows within their query: a logistic regression on differences of rows whose relevance differs. A query is a week of one series, so it has few rows."""
    first, second = [], []
    for q in np.unique(query):
        rows = np.flatnonzero(query == q)
        i, j = np.triu_indices(len(rows), 1)
        first.append(rows[i]), second.append(rows[j])
    a, b = np.concatenate(first), np.concatenate(second)
    keep = relevance[a] != relevance[b]
    a, b = a[keep], b[keep]
    if not len(a):
        return np.zeros(x.shape[1])
    better = (relevance[a] > relevance[b]).astype(float)
    d = x[a] - x[b]
    return ridge_logit(np.vstack([d, -d]), np.concatenate([better, 1 - better]), l2)[1:]


def shape_basis(shapes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, components) of the k directions in which shapes vary most; each component's largest loading is positive."""
    mean = shapes.mean(0)
    _, _, v = np.linalg.svd(shapes - mean, full_matrices=False)
    v = v[:k]
    return mean, v * np.sign(v[np.arange(len(v)), np.abs(v).argmax(1)])[:, None]


def logit(p: np.ndarray) -> np.ndarray:
    q = np.clip(p, 1e-6, 1 - 1e-6)
    return np.log(q / (1 - q))


def sigmoid_calibrator(score: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """A logistic curve over the scores' logits."""
    b = ridge_logit(logit(score)[:, None], y, 1e-3)
    return lambda s: logit_score(b, logit(s)[:, None])


def isotonic(score: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(scores, values): the non-decreasing step means nearest to y, by pooling neighbours that are out of order; equal scores are one point."""
    at, inverse = np.unique(score, return_inverse=True)
    n = np.bincount(inverse).astype(float)
    mean = np.bincount(inverse, weights=y) / n
    blocks: list[list[float]] = []
    for i, (m, w) in enumerate(zip(mean, n)):
        blocks.append([m, w, i])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _ = blocks.pop()
            m1, w1, start = blocks.pop()
            blocks.append([(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, start])
    starts = np.array([b[2] for b in blocks], int)
    return at, np.repeat([b[0] for b in blocks], np.diff(np.r_[starts, len(at)]))


def isotonic_calibrator(score: np.ndarray, y: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """The isotonic fit, linear between its points and flat beyond them."""
    at, value = isotonic(score, y)
    return lambda s: np.interp(s, at, value)


def economic_weights(regret_bps: np.ndarray, k: float = 0.5, most: float = 5.0) -> np.ndarray:
    """Rows whose mistake costs more weigh more, up to a limit."""
    return np.clip(1 + np.nan_to_num(regret_bps) / 100 * k, 1, most)


def regime_experts(x: np.ndarray, y: np.ndarray, level: np.ndarray, test: np.ndarray, test_level: np.ndarray, least: int = 60) -> np.ndarray:
    """Scores of a model per tercile of `level` in the training rows; terciles with too few rows or one class only use the model of all rows."""
    cuts = np.nanquantile(level, [1 / 3, 2 / 3])
    part = lambda v: np.where(np.isnan(v), -1, np.searchsorted(cuts, v, side="left"))
    mine, theirs = part(level), part(test_level)
    whole = ridge_logit(x, y)
    out = logit_score(whole, test)
    for k in range(3):
        rows, at = mine == k, theirs == k
        if at.any() and rows.sum() >= least and len(np.unique(y[rows])) == 2:
            out[at] = logit_score(ridge_logit(x[rows], y[rows]), test[at])
    return out


def walk_years(rows: DataFrame, *, by: str | None, day: str, columns: list[str], schema: str, horizon: int, least: int, fit: Callable[[pd.DataFrame, pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
    """fit(train, test) for every year of each group (all rows as one, if by is None): train holds the group's earlier rows but the last `horizon` days of each series, `least` of them at least.

    A group is one series or the handful of series of a daily panel, aggregated before it comes here; its size is checked.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = bounded(pdf).sort_values([day, *[c for c in ("corridor",) if c in pdf]], kind="stable").reset_index(drop=True)
        when = pd.to_datetime(pdf[day])
        parts = []
        for year in np.unique(when.dt.year):
            start = pd.Timestamp(year, 1, 1)
            train = pdf[when < start]
            back = train.groupby("corridor").cumcount(ascending=False) if "corridor" in train else pd.Series(np.arange(len(train))[::-1], train.index)
            train, test = train[back >= horizon], pdf[when.dt.year == year]
            if len(train) >= least and len(test):
                made = fit(train, test)
                if made is not None:
                    parts.append(made)
        names = [f.name for f in out_schema]
        return pd.concat(parts)[names] if parts else pd.DataFrame(columns=names)  # as objects, since empty floats become no dates

    out_schema = rows.sparkSession.createDataFrame([], schema).schema
    return rows.select(*columns, F.lit(1).alias("_all")).groupBy(by or "_all").applyInPandas(run, out_schema)


def prepared(train: pd.DataFrame, test: pd.DataFrame, features: list[str]) -> tuple[np.ndarray, np.ndarray]:
    ready = Prepared(train[features].to_numpy(float))
    return ready(train[features].to_numpy(float)), ready(test[features].to_numpy(float))

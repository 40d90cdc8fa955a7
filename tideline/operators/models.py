"""Small deterministic models fitted per group, and the scores they give."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


SERIES_ROWS = 500_000  # most rows of one group that a model takes: centuries of days, decades of hours


def bounded(pdf: pd.DataFrame) -> pd.DataFrame:
    """The group itself, if it is no longer than a series can be; panels are aggregated to one row a day or hour before."""
    if len(pdf) > SERIES_ROWS:
        raise ValueError(f"a group of {len(pdf)} rows; aggregate to days or hours first")
    return pdf


class Prepared:
    """Medians fill gaps, columns that had gaps get an indicator, all columns are standardised; statistics come from the training rows only."""

    def __init__(self, x: np.ndarray) -> None:
        gaps = np.isnan(x)
        with np.errstate(all="ignore"):
            self.median = np.where(gaps.all(0), 0.0, np.nan_to_num(np.nanmedian(np.where(gaps.all(0), 0.0, x), axis=0)))
        self.flagged = gaps.any(0)
        z = self._wide(x)
        self.mean, scale = z.mean(0), z.std(0)
        self.scale = np.where(scale > 0, scale, 1.0)

    def _wide(self, x: np.ndarray) -> np.ndarray:
        gaps = np.isnan(x)
        return np.hstack([np.where(gaps, self.median, x), gaps[:, self.flagged].astype(float)])

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return (self._wide(x) - self.mean) / self.scale


def ridge_logit(x: np.ndarray, y: np.ndarray, l2: float = 1.0, steps: int = 50, weight: np.ndarray | None = None) -> np.ndarray:
    """Coefficients (the bias first, without penalty) of a penalised logistic regression by Newton steps."""
    a = np.hstack([np.ones((len(x), 1)), x])
    w = np.ones(len(y)) if weight is None else weight
    penalty = np.full(a.shape[1], l2)
    penalty[0] = 0.0
    b = np.zeros(a.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a @ b, -35, 35)))
        grad = a.T @ (w * (y - p)) - penalty * b
        hess = (a * (w * p * (1 - p))[:, None]).T @ a + np.diag(penalty) + 1e-10 * np.eye(len(b))
        move = np.linalg.solve(hess, grad)
        b += move
        if np.abs(move).max() < 1e-8:
            break
    return b


def logit_score(b: np.ndarray, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(b[0] + x @ b[1:], -35, 35)))


def boosted_stumps(x: np.ndarray, y: np.ndarray, rounds: int = 12, rate: float = 0.1, leaf: int = 10, quantiles: tuple[float, ...] = (0.2, 0.4, 0.6, 0.8)) -> list[tuple[int, float, float, float]]:
    """Additive stumps (column, threshold, left, right) on the logistic loss; the first entry holds the bias. Of equal gains the first column and threshold win."""
    base = float(np.clip(y.mean(), 1e-6, 1 - 1e-6))
    f = np.full(len(y), np.log(base / (1 - base)))
    out: list[tuple[int, float, float, float]] = [(-1, 0.0, f[0] if len(f) else 0.0, 0.0)]
    cuts = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-f))
        g, h = y - p, p * (1 - p)
        best = (1e-14, None)
        for j, values in enumerate(cuts):
            for t in values:
                left = x[:, j] <= t
                n = int(left.sum())
                if n < leaf or len(y) - n < leaf:
                    continue
                gl, hl, gr, hr = g[left].sum(), h[left].sum(), g[~left].sum(), h[~left].sum()
                gain = gl * gl / (hl + 1e-12) + gr * gr / (hr + 1e-12) - (gl + gr) ** 2 / (hl + hr + 1e-12)
                if gain > best[0] + 1e-14:
                    best = (gain, (j, float(t), rate * gl / (hl + 1e-12), rate * gr / (hr + 1e-12)))
        if best[1] is None:
            break
        j, t, a, b = best[1]
        f = f + np.where(x[:, j] <= t, a, b)
        out.append(best[1])
    return out


def stumps_score(model: list[tuple[int, float, float, float]], x: np.ndarray) -> np.ndarray:
    f = np.full(len(x), model[0][2])
    for j, t, a, b in model[1:]:
        f += np.where(x[:, j] <= t, a, b)
    return 1 / (1 + np.exp(-f))


def nearest_score(train: np.ndarray, y: np.ndarray, x: np.ndarray, k: int = 75) -> np.ndarray:
    """Inverse-distance mean label of the k nearest training rows; rows are taken in blocks, so memory stays bounded."""
    out = np.empty(len(x))
    k = min(k, len(train))
    for at in range(0, len(x), 512):
        d = np.sqrt(((x[at : at + 512, None, :] - train[None]) ** 2).sum(2))
        i = np.argsort(d, axis=1, kind="stable")[:, :k]
        w = 1 / (np.take_along_axis(d, i, 1) + 1e-6)
        out[at : at + 512] = (w * y[i]).sum(1) / w.sum(1)
    return out


def hazard_score(x: np.ndarray, step: np.ndarray, test: np.ndarray, h: int, l2: float = 1.0) -> np.ndarray:
    """Probability that no event comes in h steps: a logistic hazard per step over rows still at risk; step is 1..h, or h + 1 for none."""
    rows = [(i, s) for i in range(len(x)) for s in range(1, int(min(step[i], h)) + 1)]
    at = np.array([r[0] for r in rows], int)
    s = np.array([r[1] for r in rows], float)
    b = ridge_logit(np.hstack([x[at], s[:, None] / h]), (step[at] == s).astype(float), l2)
    survive = np.ones(len(test))
    for k in range(1, h + 1):
        survive *= 1 - logit_score(b, np.hstack([test, np.full((len(test), 1), k / h)]))
    return survive


def garch_forecast(train: np.ndarray, test: np.ndarray) -> np.ndarray:
    """One-step variances of a GARCH(1,1) with variance targeting; parameters by a grid search of the normal likelihood on the training returns, then the recursion over the test."""
    v = float(np.var(train)) or 1e-12

    def run(r: np.ndarray, a: float, b: float, s: float) -> np.ndarray:
        out = np.empty(len(r))
        for i, x in enumerate(r):
            out[i] = s
            s = v * (1 - a - b) + a * x * x + b * s
        return np.append(out, s)

    best = max(((a, b) for a in (0.02, 0.05, 0.1, 0.15, 0.2) for b in (0.5, 0.7, 0.8, 0.85, 0.9) if a + b < 0.999), key=lambda ab: -(np.log(run(train, *ab, v)[:-1]) + train**2 / run(train, *ab, v)[:-1]).sum())
    return run(np.concatenate([train, test]), *best, v)[len(train) : len(train) + len(test)]


def drift_switch(base: np.ndarray, short: np.ndarray, y: np.ndarray, *, delay: int, delta: float = 0.01, least: int = 40, most: int = 252, hold: int = 60) -> np.ndarray:
    """The base score, or for `hold` rows after an alarm the short-memory score. An alarm compares the mean log losses of the older and newer half of the matured buffer against a Hoeffding bound; the buffer then keeps its newer half."""
    out, buffer, alarm = base.copy(), [], 0
    for i in range(len(base)):
        m = i - delay
        if m >= 0 and not np.isnan(y[m]):
            p = min(max(base[m], 1e-6), 1 - 1e-6)
            buffer.append(-(y[m] * np.log(p) + (1 - y[m]) * np.log(1 - p)))
            buffer = buffer[-most:]
            half = len(buffer) // 2
            if half >= least:
                bound = np.sqrt(np.log(4 / delta) / (2 * (half / 2)))
                if np.mean(buffer[half:]) - np.mean(buffer[:half]) > bound:
                    alarm, buffer = hold, buffer[half:]
        if alarm > 0:
            out[i], alarm = short[i], alarm - 1
    return out


FITS = {
    "logit": lambda x, y, t: logit_score(ridge_logit(x, y), t),
    "stumps": lambda x, y, t: stumps_score(boosted_stumps(x, y), t),
    "nearest": nearest_score,
}


def yearly_scores(rows: DataFrame, *, key: str, day: str, features: list[str], target: str, model: str, horizon: int, least: int = 120) -> DataFrame:
    """(key, day, score): each year scored by a model of its key fitted on all earlier rows whose outcome was known. A group is one series of the calendar's length."""
    fit = FITS[model]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = bounded(pdf).sort_values(day).reset_index(drop=True)
        x, y = pdf[features].to_numpy(float), pdf[target].to_numpy(float)
        years = pd.to_datetime(pdf[day]).dt.year.to_numpy()
        score = np.full(len(pdf), np.nan)
        for year in np.unique(years):
            at = np.flatnonzero(years == year)
            train = np.arange(max(0, at[0] - horizon))
            train = train[~np.isnan(y[train])]
            if len(train) < least or len(np.unique(y[train])) < 2:
                continue
            ready = Prepared(x[train])
            score[at] = fit(ready(x[train]), y[train], ready(x[at]))
        return pd.DataFrame({key: pdf[key], day: pdf[day], "score": score}).dropna()

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return rows.select(key, day, *features, F.col(target).cast("double").alias(target)).groupBy(key).applyInPandas(run, f"{key} {kinds[key]}, {day} {kinds[day]}, score double")

"""Phase-space thresholding: what the ellipsoid decides, what the rule after it takes away, and repeated rounds."""

import numpy as np
import pyarrow as pa
import pytest

from tideline.operators import phase
from tideline.operators.faults import _groups

FAR = 4.5


def walk(n=800, seed=1, sigma=0.002):
    return 4.6 + np.cumsum(np.random.default_rng(seed).normal(0, sigma, n))


def test_ellipsoid_and_rule_each_decide():
    y = walk()
    y[300] += 0.2
    none = np.zeros(len(y), bool)
    at = phase.coordinates(y, none)
    shape = phase.shape_of(*phase.measured(y, at, none), len(y))
    out, own = phase.outside(shape, *at, FAR), phase.own(at[0])
    assert out[[299, 300, 301]].all() and not own[[299, 301]].any()  # thrown out by the neighbour's jump only
    assert own.sum() > 100 and (own & ~out).sum() > 100  # an excursion of its own, but inside
    assert np.flatnonzero(out & own).tolist() == [300]


def test_axes_are_turned():
    """A point that no single coordinate puts outside, lying across the usual relation of value and second difference."""
    s = phase.Shape(1.0, 1.4, 2.4, -0.8, 1.0, 800)
    edge = 0.8 * FAR * s.universal
    along, across = np.array([edge]), np.array([2.4 * edge])
    assert not phase.outside(s, along, np.zeros(1), -across, FAR)[0]
    assert phase.outside(s, along, np.zeros(1), across, FAR)[0]


@pytest.mark.parametrize("k", [1, 2, 3, 4, 5])
@pytest.mark.parametrize("by", [0.3, -0.3])
def test_short_excursions_are_found_whole(k, by):
    y = walk(seed=k)
    y[400 : 400 + k] += by
    assert np.flatnonzero(phase.spikes(y, FAR)[0]).tolist() == list(range(400, 400 + k))


@pytest.mark.parametrize("by", [0.02, 0.3, -2.0])
def test_lasting_change_of_level_is_no_spike(by):
    y = walk()
    y[400:] += by
    assert not phase.spikes(y, FAR)[0].any()


def test_rounds_find_what_hid_beside_a_greater_spike():
    y = walk()
    y[400:404] += [0.02, 3.0, 3.0, 0.05]
    y[405] += 3.0
    flags, _ = phase.spikes(y, FAR)
    assert {401, 402, 405} <= set(np.flatnonzero(flags)) and flags.sum() <= 5


def test_scale_is_the_median_deviation():
    v = np.random.default_rng(2).normal(0, 3.0, 20_001)
    assert abs(phase.scale(*phase.histogram(v)) - phase.MAD * np.median(np.abs(v))) < 0.03
    assert np.isnan(phase.scale(*phase.histogram(np.zeros(5))))


@pytest.mark.parametrize("n", [0, 1, 2, 3])
def test_short_series(n):
    assert not phase.spikes(np.arange(n, dtype=float), FAR)[0].any()
    assert not phase.spikes(np.ones(n), FAR)[0].any()


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_groups_are_complete_whatever_the_batches(size):
    s, b = ["a"] * 5 + ["b"] * 3 + ["c"] + ["d"] * 4, [0, 0, 1, 1, 1] + [0] * 3 + [0] + [2, 2, 3, 3]
    t = pa.table({"s": s, "b": b, "x": list(range(13))})
    batches = t.to_batches(max_chunksize=size)
    assert [g.column("x").to_pylist() for g in _groups(iter(batches), ["s"])] == [[0, 1, 2, 3, 4], [5, 6, 7], [8], [9, 10, 11, 12]]
    assert [len(g) for g in _groups(iter(batches), ["s", "b"])] == [2, 3, 3, 1, 2, 2]
    assert list(_groups(iter([]), ["s"])) == []

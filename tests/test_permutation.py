"""The permutation test against ranks and draws of pandas and NumPy."""

import numpy as np

from tideline import panel as P
from tideline.queries.more import permutation_test


def test_every_corridor_by_ranks_and_ten_thousand_draws(spark, sf):
    got = {x["corridor"]: x for x in permutation_test(spark, sf).collect()}
    d = P.daily_panel(spark, sf).toPandas().sort_values("day")
    assert set(got) == set(d["corridor"]) and len(got) == 5
    rng = np.random.default_rng(1)
    for corridor, g in d.groupby("corridor"):
        g = g.assign(x=g["price"].astype(float).pct_change(fill_method=None)).dropna(subset="x")
        x, y = ((v - v.mean()) / v.std(ddof=0) for v in (g[k].rank().to_numpy() for k in ("x", "n")))
        r = abs(x @ y) / len(x)
        assert abs(got[corridor]["abs_correlation"] - r) < 1e-9
        p = (np.abs(rng.permuted(np.tile(x, (4000, 1)), axis=1) @ y) / len(x) >= r - 1e-12).mean()
        assert abs(got[corridor]["p"] - p) < 0.05
        hits = got[corridor]["p"] * 10_001
        assert abs(hits - round(hits)) < 1e-6
    assert {x["p"] for x in permutation_test(spark, sf, permutations=1).collect()} <= {0.5, 1.0}

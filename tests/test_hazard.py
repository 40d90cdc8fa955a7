"""The hazard model's walk through the years."""

from tideline import panel as P
from tideline.queries.models import hazard


def test_every_year_with_enough_history_is_scored(spark, sf):
    got = hazard(spark, sf).toPandas()
    d = P.daily_panel(spark, sf).toPandas()
    assert got["survival"].between(0, 1).all() and not got.duplicated(["corridor", "day"]).any()
    year = lambda v: v["day"].map(lambda x: x.year)
    d, got = d.assign(year=year(d)), got.assign(year=year(got))
    for corridor, g in d.groupby("corridor"):
        mine = got[got["corridor"] == corridor]
        enough = [y for y in g["year"].unique() if (g["year"] < y).sum() - 5 >= 60]
        assert len(enough) > 1 and set(mine["year"]) == set(enough)
        assert len(mine) == g["year"].isin(enough).sum()

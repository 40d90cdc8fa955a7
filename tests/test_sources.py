"""Parsers, file sources, contracts and the small models on fixtures."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import contracts
from tideline.operators import evaluate as E
from tideline.operators import models as M
from tideline.sources import files as S
from tideline.sources import payloads as R


def one(spark, text, **more):
    keys = list(more)
    return spark.createDataFrame([(text, *more.values())], ["text", *keys])


def test_rates_xml(spark):
    xml = '<V><Record Date="05.01.2026" Id="R"><Nominal>10</Nominal><Value>75,5</Value></Record><Record Date="06.01.2026"><Nominal>10</Nominal><Value>-1</Value></Record></V>'
    got = R.daily_rates_xml(one(spark, xml, ccy="USD")).collect()
    assert [tuple(x) for x in got] == [("USD", dt.date(2026, 1, 5), 10, 75.5)]
    raw = spark.createDataFrame([(bytearray("курс".encode("cp1251")),)], "b binary")
    assert raw.select(R.decode(F.col("b"))).first()[0] == "курс"


def test_column_table(spark):
    text = json.dumps({"history": {"columns": ["TRADEDATE", "CLOSE", "WAPRICE"], "data": [["2026-01-05", None, 7.5], ["2026-01-06", 8.0, 1.0]]}})
    got = R.column_table_json(one(spark, text, secid="X"), block="history", aliases={"day": ["TRADEDATE"], "close": ["CLOSE", "LEGAL", "WAPRICE"]}).collect()
    assert [(x["secid"], x["day"], float(x["close"])) for x in got] == [("X", "2026-01-05", 7.5), ("X", "2026-01-06", 8.0)]


def test_key_rate(spark):
    cell = "<td>%s</td><td>%s</td>"
    html = "<table>" + cell % ("01.02.2026", "15,50") + cell % ("02.02.2026", "16.0") + cell % ("x", "17") + "</table>"
    assert {(x[0].day, x[1]) for x in R.key_rate_html(one(spark, html)).collect()} == {(1, 15.5), (2, 16.0)}
    with pytest.raises(Exception, match="two rates"):
        R.key_rate_html(one(spark, html + cell % ("01.02.2026", "14"))).collect()


def test_lines(spark):
    lines = spark.createDataFrame([("DATE,X",), ("2026-01-01,1.5",), ("2026-01-02,.",), ("2026-01-03,",)], ["value"])
    assert [tuple(x) for x in R.fred_csv(lines, series="s").collect()] == [(dt.date(2026, 1, 1), 1.5, "s")]
    row = [""] * 61
    row[0], row[7], row[28], row[30], row[34], row[37], row[59], row[60] = "1", "RUS", "14", "-5", "-2.5", "AM", "20260102031500", "https://www.site.org/a"
    other = row.copy()
    other[7], other[37] = "USA", "US"
    bad = row.copy()
    bad[59] = "soon"
    got = R.event_export(spark.createDataFrame([("\t".join(x),) for x in (row, other, bad, row[:5])], ["value"]), actors=["RUS"], places=["AM"]).collect()
    assert len(got) == 1 and got[0]["source"] == "site.org" and got[0]["tone"] == -2.5 and got[0]["added_at"] == dt.datetime(2026, 1, 2, 3, 15)


def test_timeline_and_bank_rates(spark):
    text = json.dumps({"timeline": [{"series": "s", "data": [{"date": "20260105T000000Z", "value": 5, "norm": 10}, {"date": "20260106T000000Z", "value": 5, "norm": 0}]}]})
    got = R.timeline_json(one(spark, text, series="n")).orderBy("date").collect()
    assert [x["article_share"] for x in got] == [0.5, None]
    item = "<item><title>%s</title><description>%s</description><quant>%d</quant></item>"
    xml = "<rates><date>05.01.2026</date>" + item % ("USD", "500,5", 1) + item % ("RUB", "6.1", 1) + "</rates>"
    df = one(spark, xml, requested_date=dt.date(2026, 1, 6))
    assert {(x["ccy"], x["per_nominal"], x["is_carried"]) for x in R.bank_rates_xml(df, currencies=["USD", "RUB"]).collect()} == {("USD", 500.5, True), ("RUB", 6.1, True)}
    with pytest.raises(Exception, match="missing"):
        R.bank_rates_xml(df, currencies=["USD", "CNY"]).collect()


def test_wide_months_and_intervals(spark):
    wide = spark.createDataFrame([("cpi", "100.6", "100.3", "n")], ["name", "2024-М01", "2024-M02", "note"])
    got = R.compounded(R.months_wide(wide, label="name")).orderBy("month_end").collect()
    assert [(x["month_end"], x["value"], x["known_at"]) for x in got] == [(dt.date(2024, 1, 31), 100.6, dt.date(2024, 2, 10)), (dt.date(2024, 2, 29), 100.3, dt.date(2024, 3, 10))]
    rows = spark.createDataFrame([("01.01.2024 - 25.07.2024", 14.0), ("25.07.2024 -", 13.5)], "t string, r double")
    got = R.policy_intervals(rows.withColumn("b", F.lit("x")), text="t", rate="r", bank="b").orderBy("starts").collect()
    assert got[1]["starts"] == dt.date(2024, 7, 26) and got[1]["change_pp"] == -0.5


def test_plans_and_contracts(spark):
    text = "Сначала так. Продажи составят от 300 млн до 1,5 млрд долларов. Потом иначе."
    assert [(x["low"], x["high"]) for x in R.plan_sentences(one(spark, text, id=1), text="text", key="id").collect()] == [(300.0, 1500.0)]
    codes = {x["code"]: x["expiry"] for x in R.contract_codes(spark, 2026, 2026).collect()}
    assert codes["CRH6"] == dt.date(2026, 3, 19) and len(codes) == 12


def test_series_and_snapshots(spark, tmp_path):
    (tmp_path / "cbr.csv").write_text("rate_date,ccy,nominal,rate_rub,fetched_at,source_url,is_carried\n2026-01-05,USD,1,75,x,y,\n2026-01-06,USD,2,152,x,y,true\n2026-01-06,EUR,1,90,x,y,\n")
    got = S.load_series(spark, "CBR:USD", str(tmp_path)).orderBy("value_date").collect()
    assert [(x["price"], x["known_at"], x["is_carried"]) for x in got] == [(75.0, dt.datetime(2026, 1, 2, 15, 30), False), (76.0, dt.datetime(2026, 1, 5, 15, 30), True)]
    with pytest.raises(contracts.ContractError):
        S.load_series(spark, "NOPE:USD", str(tmp_path))
    df = spark.range(100).withColumn("x", F.col("id") * 2)
    made = S.publish(df, str(tmp_path / "snap"), name="t")
    assert S.resolve(spark, S.latest(str(tmp_path / "snap"), "t")).count() == 100
    assert S.content_hash(df) == S.content_hash(df.repartition(7)) != S.content_hash(df.limit(99))
    (p,) = (tmp_path / "snap").glob("*/manifest.json")
    p.write_text(p.read_text().replace('"rows": 100', '"rows": 99'))
    with pytest.raises(contracts.ContractError):
        S.resolve(spark, made["path"])
    S.write_csv(df.limit(3), str(tmp_path / "c"), ["id"])
    assert S.markdown_table(df.limit(1)).splitlines()[0] == "| id | x |"
    assert S.combine_hourly([df, df], ["id"]).where("id = 3").first()["x"] == 12
    (tmp_path / "bulk.csv").write_text("FREQ,REF_AREA,TIME_PERIOD,OBS_VALUE,CURRENCY,NOTE\nD: Daily,AM: Armenia,2026-01-01,1.5,AMD: Dram,z\nM: Monthly,AM: Armenia,2026-01,1,AMD: Dram,z\nD: Daily,XX: No,2026-01-01,1,X: X,z\n")
    assert [tuple(x) for x in S.filtered_bulk(spark, str(tmp_path / "bulk.csv"), areas=["AM"]).collect()] == [("AM", "AMD", dt.date(2026, 1, 1), 1.5)]


def test_contracts(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string")
    with pytest.raises(contracts.ContractError, match="not unique"):
        contracts.assert_unique(df, "k")
    with pytest.raises(contracts.ContractError, match="missing"):
        contracts.require_columns(df, "z")
    with pytest.raises(contracts.ContractError):
        contracts.join_validated(df.select("k"), df, ["k"])
    with pytest.raises(contracts.ContractError):
        contracts.assert_causal(df.withColumn("a", F.lit(2)).withColumn("b", F.lit(1)), "a", "b")


def test_models():
    g = np.random.default_rng(0)
    x = g.normal(size=(600, 3))
    y = (x[:, 0] + 0.5 * g.normal(size=600) > 0).astype(float)
    x[::7, 1] = np.nan
    ready = M.Prepared(x[:400])
    a, t = ready(x[:400]), ready(x[400:])
    assert a.shape[1] == 4 and abs(a.mean(0)).max() < 1e-9
    for score in (M.logit_score(M.ridge_logit(a, y[:400]), t), M.stumps_score(M.boosted_stumps(a, y[:400]), t), M.nearest_score(a, y[:400], t)):
        assert ((score > 0.5) == (y[400:] > 0.5)).mean() > 0.8
    b = M.ridge_logit(a, y[:400])
    p = M.logit_score(b, a)
    assert np.abs(np.hstack([np.ones((400, 1)), a]).T @ (y[:400] - p) - np.r_[0, b[1:]]).max() < 1e-6
    step = np.where(y[:400] > 0, 1, 4)
    h = M.hazard_score(a, step, t, 3)
    assert h[y[400:] == 0].mean() > h[y[400:] == 1].mean()
    r = g.normal(size=500) * np.r_[np.full(250, 0.01), np.full(250, 0.03)]
    v = M.garch_forecast(r[:240], r[240:])
    assert v[-100:].mean() > 1.2 * v[:10].mean()
    base, short = np.full(400, 0.9), np.full(400, 0.1)
    out = M.drift_switch(base, short, np.r_[np.ones(200), np.zeros(200)], delay=3, delta=0.5, least=40)
    assert (out[:200] == 0.9).all() and (out == 0.1).any()


def test_draws_cover_blocks_in_runs(spark):
    d = E.circular_draws(spark, 10, 4, 5, 1).collect()
    per = {}
    for x in d:
        per.setdefault(x["draw"], []).append(x["block"])
    assert all(len(v) == 10 and set(v) <= set(range(10)) for v in per.values()) and len(per) == 5
    assert d == E.circular_draws(spark, 10, 4, 5, 1).collect()

"""Streams against their batch forms, late rows included."""

import datetime as dt
import json
import pathlib

import pytest
from pyspark.sql import functions as F

from tideline.operators.expanding import expanding_quantiles
from tideline.queries import models, registry  # noqa: F401
from tideline.streaming import flows

T = dt.datetime(2026, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double"


def batches(spark, path, *groups):
    for i, rows in enumerate(groups):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(f"{path}/in/b{i}")
        import time

        time.sleep(1.1)  # files are taken in order of time
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{path}/in")


def ev(i, minutes, user, kind="click"):
    return (i, T + dt.timedelta(minutes=minutes), user, kind, float(i))


def test_articles_count_once_and_late_rows_are_dropped(spark, tmp_path):
    s = batches(spark, tmp_path, [ev(1, 5, 1), ev(2, 20, 1), ev(3, 30, 2)], [ev(4, 400, 9)], [ev(6, 1000, 9)], [ev(5, 6, 7), ev(8, 1100, 9)], [ev(7, 1500, 9)])
    got = flows.run_to_parquet(flows.hourly_articles(s, late="2 hours"), str(tmp_path / "c")).collect()
    first = [x for x in got if x["hour"] == T]
    assert [x["articles"] for x in first] == [2]


def test_sliding_and_sessions(spark, tmp_path):
    s = batches(spark, tmp_path, [ev(1, 0, 1), ev(2, 10, 1), ev(3, 90, 1), ev(4, 20, 2)], [ev(5, 5000, 3)], [ev(6, 9000, 3)])
    a = flows.run_to_parquet(flows.sliding_counts(s, length="2 hours", slide="1 hour"), str(tmp_path / "c1")).collect()
    assert {(x["until"], x["n"]) for x in a if x["until"] <= T + dt.timedelta(hours=3)} == {(T + dt.timedelta(hours=1), 3), (T + dt.timedelta(hours=2), 4), (T + dt.timedelta(hours=3), 1)}
    b = flows.run_to_parquet(flows.sessions(s), str(tmp_path / "c2")).collect()
    assert {(x["user_id"], x["session_start"], x["n"]) for x in b if x["user_id"] < 3} == {(1, T, 2), (1, T + dt.timedelta(minutes=90), 1), (2, T + dt.timedelta(minutes=20), 1)}


def test_batches_are_written_once(spark, tmp_path):
    s = batches(spark, tmp_path, [ev(1, 0, 1)], [ev(2, 1, 1)])
    for _ in range(2):
        flows.append_once(s, str(tmp_path / "out"), str(tmp_path / "c"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_expanding_quantiles(spark):
    rows = [("a", i, v) for i, v in enumerate([3.0, None, 1.0, 2.0, 5.0, float("nan"), 4.0])] + [("b", 0, None)]
    got = expanding_quantiles(spark.createDataFrame(rows, "k string, t int, v double"), key="k", at="t", value="v", quantiles={"m": 0.5}, least=2).orderBy("k", "t").collect()
    assert [x["m"] for x in got] == [None, None, None, 2.0, 2.0, 2.5, 2.5, None]
    empty = spark.createDataFrame([], "k string, t int, v double")
    assert expanding_quantiles(empty, key="k", at="t", value="v", quantiles={"m": 0.5}, least=2).count() == 0


def test_state_carries_over_batches(spark, tmp_path):
    days = [5, 6, 8, 9, 12]
    groups = [[(d, dt.datetime(2026, 1, d), 1, "a", 1.0)] for d in days]
    s = batches(spark, tmp_path, *groups).select(F.col("event_type").alias("corridor"), F.col("ts").cast("timestamp").alias("at"))
    before = spark.conf.get(flows.STATE_STORE, None)
    with flows.rocksdb_state(spark):
        got = flows.run_to_parquet(flows.policy_stream(s, cooldown_days=3, cap=2), str(tmp_path / "c")).collect()
    assert sorted(x["at"].day for x in got) == [5, 8, 12]
    assert spark.conf.get(flows.STATE_STORE, None) == before and flows.batches(spark, str(tmp_path / "c")) >= 5


def test_labels_wait_in_the_state(spark, tmp_path):
    s = batches(spark, tmp_path, *[[(d, dt.datetime(2026, 1, d), 1, "a", float(p))] for d, p in ((1, 5), (2, 7), (3, 4), (4, 6), (5, 9))])
    with flows.rocksdb_state(spark):
        out = flows.settled_stream(s.select(F.col("event_type").alias("corridor"), F.col("ts").cast("timestamp").alias("at"), F.col("value").alias("price")), delay=2)
        got = flows.run_to_parquet(out, str(tmp_path / "c")).collect()
    assert sorted((x["price"], x["best_ahead"]) for x in got) == [(4.0, 6.0), (5.0, 4.0), (7.0, 4.0)]


def test_outages_are_unknown(spark):
    counts = spark.createDataFrame([(1, "a", 3)], "hour int, corridor string, articles int")
    beats = spark.createDataFrame([(1, "a", True), (1, "b", True), (2, "a", False)], "hour int, corridor string, alive boolean")
    got = {(x["hour"], x["corridor"]): x["articles"] for x in flows.hours_with_outages(counts, beats).collect()}
    assert got == {(1, "a"): 3, (1, "b"): 0, (2, "a"): None}


@pytest.mark.parametrize("name", ["stream_policy", "stream_hourly_news", "stream_delayed_labels"])
def test_registered_streams_take_files_in_order_of_time(spark, sf, monkeypatch, name):
    seen = {}
    run = flows.run_to_parquet

    def watched(stream, root):
        seen.update(checkpoint=f"{root}/checkpoint".removeprefix("file://"))
        return run(stream, root)

    monkeypatch.setattr(flows, "run_to_parquet", watched)
    assert registry.QUERIES[name](spark, sf).count() > 0
    offsets = sorted((p for p in pathlib.Path(seen["checkpoint"], "sources/0").iterdir() if p.name.isdigit()), key=lambda p: int(p.name))
    files = [json.loads(x)["path"] for p in offsets for x in p.read_text().splitlines()[1:]]
    assert len(offsets) == 8
    at = "ts" if name == "stream_hourly_news" else "at"
    spans = [spark.read.parquet(f).agg(F.min(at), F.max(at)).first() for f in files]
    assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))

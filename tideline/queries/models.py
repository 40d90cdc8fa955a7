"""Model scores, drift switches and gates over the daily panel, and streams that equal their batch forms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import labels as L
from tideline.operators import models as M
from tideline.operators import policy as Q
from tideline.queries import joins
from tideline.queries.registry import SQL, query
from tideline.session import scratch
from tideline.streaming import flows

c = lambda name: F.col(name)
FILES = 8  # micro-batches of the streams
FEATURES = ["r1", "r5", "z20", "rank60"]


def _features(spark, sf):
    p, w = c("price"), X.series("corridor", "day")
    d = P.daily_panel(spark, sf)
    return d.select("corridor", "day", "price", X.change(p, w).alias("r1"), X.change(p, w, 5).alias("r5"), X.zscore(p, w, 20).alias("z20"), X.rank_average(p, w, 60).alias("rank60"), (L.regret_paid(p, w, 5) <= 1000).cast("double").alias("target"), L.first_improvement(p, w, 5, 1000).alias("step"))


def _scored(spark, sf, model):
    return M.yearly_scores(_features(spark, sf), key="corridor", day="day", features=FEATURES, target="target", model=model, horizon=5)


@query()
def ridge_logit_scores(spark, sf):
    return _scored(spark, sf, "logit")


@query()
def boosted_stumps_scores(spark, sf):
    return _scored(spark, sf, "stumps")


@query()
def knn_analog(spark, sf):
    return _scored(spark, sf, "nearest")


@query()
def hazard(spark, sf):
    """Probability that no better price comes in five steps, of each year by the earlier rows whose five steps were over; years with fewer than 60 such rows have none."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = M.bounded(pdf).sort_values("day").reset_index(drop=True)
        x, step = pdf[FEATURES].to_numpy(float), pdf["step"].to_numpy()
        years = pd.to_datetime(pdf["day"]).dt.year.to_numpy()
        survival = np.full(len(pdf), np.nan)
        for year in np.unique(years):
            at = np.flatnonzero(years == year)
            train = np.arange(max(0, at[0] - 5))
            train = train[step[train] > 0]
            if len(train) < 60:
                continue
            ready = M.Prepared(x[train])
            survival[at] = M.hazard_score(ready(x[train]), step[train], ready(x[at]), 5)
        return pd.DataFrame({"corridor": pdf["corridor"], "day": pdf["day"], "survival": survival}).dropna(subset="survival")

    return _features(spark, sf).groupBy("corridor").applyInPandas(run, "corridor string, day date, survival double")


@query()
def garch_gate(spark, sf):
    """Days whose forecast volatility ranks in the upper third of its last sixty forecasts."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = M.bounded(pdf).sort_values("day").reset_index(drop=True)
        r = pdf["r1"].fillna(0).to_numpy(float)
        n = len(r) // 2
        if n < 60:
            return pd.DataFrame({"corridor": [], "day": [], "variance": []})
        return pd.DataFrame({"corridor": pdf["corridor"][n:], "day": pdf["day"][n:], "variance": M.garch_forecast(r[:n], r[n:])})

    v = _features(spark, sf).select("corridor", "day", "r1").groupBy("corridor").applyInPandas(run, "corridor string, day date, variance double")
    rank = X.causal_percentile(c("variance"), X.series("corridor", "day"), 60, 20)
    return v.select("corridor", "day", F.sqrt("variance").alias("sigma"), (rank > 0.67).alias("gated"))


@query()
def adwin_switch(spark, sf):
    """A long and a short memory of the hit rate, the short one for a while after the long one's losses have drifted."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = M.bounded(pdf).sort_values("day").reset_index(drop=True)
        y = pdf["target"].to_numpy(float)
        known = pdf["target"].shift(5)
        long = known.expanding(20).mean().fillna(0.5).to_numpy()
        short = known.rolling(60, min_periods=20).mean().fillna(0.5).to_numpy()
        return pd.DataFrame({"corridor": pdf["corridor"], "day": pdf["day"], "score": M.drift_switch(long, short, y, delay=5)})

    return _features(spark, sf).select("corridor", "day", "target").groupBy("corridor").applyInPandas(run, "corridor string, day date, score double")


@query(SQL["policy_cooldown_cap"])
def stream_policy(spark, sf):
    """The cap and cooldown as a stream over files in order of time, one a micro-batch, with state carried from each to the next; equal to the batch query."""
    root = scratch(spark, "stream")
    rows = joins._cheap(spark, sf).select("corridor", c("day").cast("timestamp").alias("at"))
    flows.write_in_order(rows, f"{root}/in", "at", FILES)
    with flows.rocksdb_state(spark):
        out = flows.run_to_parquet(flows.policy_stream(flows.file_stream(spark, f"{root}/in", rows.schema), cooldown_days=3, cap=2), root)
    return out.select("corridor", c("at").cast("date").alias("day"))


@query("SELECT event_type AS corridor, date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS articles FROM events GROUP BY 1, 2")
def stream_hourly_news(spark, sf):
    """Distinct articles by hour and corridor, counted by a stream with a watermark over files in order of time, one a micro-batch.

    A row a day after the last one moves the watermark past the last hour; its own hour is never given out. Events
    without a time, which no watermark passes, are counted beside the stream.
    """
    root = scratch(spark, "stream")
    events = P.table(spark, sf, "events").select("event_type", "ts", "user_id")
    end = events.agg(F.max("ts").alias("ts")).where("ts is not null").select((c("ts") + F.expr("interval 1 day")).alias("ts"))
    flows.write_in_order(events.where("ts is not null").unionByName(end, allowMissingColumns=True), f"{root}/in", "ts", FILES)
    out = flows.run_to_parquet(flows.hourly_distinct(flows.file_stream(spark, f"{root}/in", events.schema)), root)
    out = out.select("corridor", c("hour").cast("timestamp_ntz").alias("hour"), "articles")
    untimed = events.where("ts is null").groupBy(c("event_type").alias("corridor")).agg(F.count_distinct("user_id").cast("int").alias("articles"))
    return out.unionByName(untimed.select("corridor", F.lit(None).cast("timestamp_ntz").alias("hour"), "articles"))


@query("""WITH {D}, k AS (SELECT corridor, day, price, min(price) OVER f AS best_ahead, count(*) OVER f AS n FROM d
  WINDOW f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)) SELECT corridor, day, price, best_ahead FROM k WHERE n = 5""")
def stream_delayed_labels(spark, sf):
    """Labels that are known five prices later, given out by a stream that keeps the open ones as state across batches; equal to the batch label."""
    root = scratch(spark, "stream")
    rows = P.daily_panel(spark, sf).select("corridor", c("day").cast("timestamp").alias("at"), "price")
    flows.write_in_order(rows, f"{root}/in", "at", FILES)
    with flows.rocksdb_state(spark):
        out = flows.run_to_parquet(flows.settled_stream(flows.file_stream(spark, f"{root}/in", rows.schema), delay=5), root)
    return out.select("corridor", c("at").cast("date").alias("day"), "price", "best_ahead")


@query("""WITH n AS (SELECT event_type AS corridor, date_trunc('hour', ts) AS hour, count(DISTINCT user_id) AS articles FROM events
  WHERE ts IS NOT NULL GROUP BY 1, 2),
g AS (SELECT corridor, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS hour FROM (SELECT DISTINCT corridor FROM n), (SELECT min(hour) AS lo, max(hour) AS hi FROM n)),
s AS (SELECT DISTINCT hour FROM n)
SELECT g.corridor, g.hour, CASE WHEN s.hour IS NOT NULL THEN coalesce(articles, 0) END AS articles FROM g LEFT JOIN s USING (hour) LEFT JOIN n USING (corridor, hour)""")
def stream_missing_or_zero(spark, sf):
    """Hourly counts of a stream, where an hour in which no corridor had anything is an outage and unknown, and one in which another had something is zero."""
    root = scratch(spark, "stream")
    events = P.table(spark, sf, "events").select("event_type", "ts", "user_id").where("ts is not null")
    end = events.agg(F.max("ts").alias("ts")).where("ts is not null").select((c("ts") + F.expr("interval 1 day")).alias("ts"))
    flows.write_in_order(events.unionByName(end, allowMissingColumns=True), f"{root}/in", "ts", FILES)
    n = flows.run_to_parquet(flows.hourly_distinct(flows.file_stream(spark, f"{root}/in", events.schema)), root).where("corridor is not null").select("corridor", c("hour").cast("timestamp_ntz").alias("hour"), "articles")
    span = n.agg(F.min("hour").alias("lo"), F.max("hour").alias("hi")).first()
    hours = n.select("corridor").distinct().withColumn("hour", F.explode(F.sequence(F.lit(span["lo"]).cast("timestamp_ntz"), F.lit(span["hi"]).cast("timestamp_ntz"), F.expr("interval 1 hour"))))
    beats = hours.join(n.select("hour").distinct().withColumn("alive", F.lit(True)), "hour", "left").withColumn("alive", F.coalesce("alive", F.lit(False)))
    return flows.hours_with_outages(n, beats).select("corridor", "hour", "articles")


_LANES = """WITH RECURSIVE {D}, l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM d),
r AS (SELECT corridor, day, date_trunc('week', day) AS wk, CASE WHEN len(v) >= 20 THEN len(list_filter(v, lambda x: x <= price)) / len(v) END AS rank FROM l),
s AS (SELECT *, max(CASE WHEN rank <= 0.2 THEN 1 ELSE 0 END) OVER (PARTITION BY corridor, wk ORDER BY day) AS seen FROM r),
g AS (SELECT corridor, day, wk, CASE WHEN rank <= 0.2 THEN 'strong' WHEN seen = 0 AND rank <= 0.4 AND isodow(day) IN (4, 5) THEN 'fallback' END AS lane FROM s),
q AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY day) AS rn FROM g WHERE lane IS NOT NULL),
t AS (SELECT corridor, rn, day, lane, day AS last, wk AS lastwk, 1 AS cnt, true AS kept FROM q WHERE rn = 1
UNION ALL SELECT x.corridor, x.rn, x.day, x.lane, CASE WHEN k THEN x.day ELSE last END, CASE WHEN k THEN x.wk ELSE lastwk END, CASE WHEN k THEN CASE WHEN x.wk = lastwk THEN cnt + 1 ELSE 1 END ELSE cnt END, k
FROM (SELECT t.last, t.lastwk, t.cnt, q.*, (CASE WHEN q.wk = t.lastwk THEN t.cnt ELSE 0 END < 2 AND q.day - t.last >= 3) AS k FROM t
  JOIN q ON q.corridor = t.corridor AND q.rn = t.rn + 1) x)
SELECT corridor, day, lane FROM t WHERE kept"""


@query(_LANES)
def dual_lane(spark, sf):
    """Strong days first (lowest fifth of their past), else cheap Thursdays and Fridays, under one cap and cooldown."""
    p, w = c("price"), X.series("corridor", "day")
    d = P.daily_panel(spark, sf).select("corridor", "day", X.causal_percentile(p, w, 60, 20).alias("rank"))
    strong = c("rank") <= 0.2
    week = F.date_trunc("week", "day")
    seen = F.max(F.when(strong, 1).otherwise(0)).over(X.Window.partitionBy("corridor", week).orderBy("day").rowsBetween(X.Window.unboundedPreceding, 0))
    lane = F.when(strong, "strong").when((seen == 0) & (c("rank") <= 0.4) & F.weekday("day").isin(3, 4), "fallback")
    t = d.withColumn("lane", lane).where("lane is not null")
    return Q.cap_and_cooldown(t, key="corridor", at="day", cooldown=3, cap=2).join(t.select("corridor", "day", "lane"), ["corridor", "day"])


@query("""WITH {D}, l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM d),
r AS (SELECT corridor, day, CASE WHEN len(v) >= 20 THEN len(list_filter(v, lambda x: x <= price)) / len(v) END AS rank FROM l)
SELECT a.corridor, a.day, round(a.rank, 6) AS own, round(0.5 * a.rank + 0.5 * avg(b.rank), 6) AS blended FROM r a
  JOIN r b ON a.day = b.day AND a.corridor <> b.corridor WHERE a.rank IS NOT NULL AND b.rank IS NOT NULL GROUP BY a.corridor, a.day, a.rank""")
def consensus_scores(spark, sf):
    """A corridor's causal rank blended half and half with the mean rank of the others on the day."""
    p = P.daily_panel(spark, sf)
    r = p.select("corridor", "day", X.causal_percentile(c("price"), X.series("corridor", "day"), 60, 20).alias("rank")).where("rank is not null")
    w = X.Window.partitionBy("day")
    r = r.withColumn("n", F.count("*").over(w)).withColumn("s", F.sum("rank").over(w)).where("n > 1")
    return r.select("corridor", "day", F.round("rank", 6).alias("own"), F.round(0.5 * c("rank") + 0.5 * (c("s") - c("rank")) / (c("n") - 1), 6).alias("blended"))

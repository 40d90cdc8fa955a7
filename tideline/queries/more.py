"""Indicators, order and stopping simulations, curves, blocks and further joins over the panels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import indicators as I
from tideline.operators import labels as L
from tideline.operators.draws import draw, draw_sql
from tideline.queries.registry import query
from tideline.session import scratch

c = lambda name: F.col(name)
r4 = lambda x: F.round(x, 4)
r6 = lambda x: F.round(x, 6)
DAY = lambda: X.series("corridor", "day")


def _fired(spark, sf, name, **q):
    return I.signals(P.daily_panel(spark, sf), [(name, q)], key="corridor", at="day", price="price").select("corridor", "day", r4("strength").alias("strength"))


_CLAMP = "round(greatest(0, least(1, %s)), 4) AS strength"


@query("""WITH {D}, l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING) AS v FROM d),
r AS (SELECT *, len(list_filter(v, lambda x: x <= price)) * 100.0 / 60 AS k FROM l WHERE len(v) = 60) SELECT corridor, day, """ + _CLAMP % "(20 - k) / 20" + " FROM r WHERE k <= 20")
def ind_level(spark, sf):
    return _fired(spark, sf, "level_percentile", window=60, pct=20)


@query("""WITH {D}, s AS (SELECT *, lag(price, 3) OVER w AS b, (price < lag(price) OVER w)::INT AS down, CASE WHEN count(*) OVER v >= 20 THEN stddev_samp(price) OVER v END / price AS s FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day),
v AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)),
t AS (SELECT *, sum(down) OVER (PARTITION BY corridor ORDER BY day ROWS 2 PRECEDING) AS k FROM s)
SELECT corridor, day, CASE WHEN s > 0 THEN round(greatest(0, least(1, (b - price) / b / 3 / s)), 4) ELSE 0 END AS strength FROM t WHERE k = 3""")
def ind_streak(spark, sf):
    return _fired(spark, sf, "momentum_streak", n=3)


@query("""WITH {D}, r AS (SELECT corridor, day, (price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1) * 100 AS r FROM d) SELECT corridor, day, """ + _CLAMP % "-r / 40" + " FROM r WHERE r <= -20")
def ind_filter(spark, sf):
    return _fired(spark, sf, "filter_rule", x=20.0)


@query("""WITH {D}, r AS (SELECT corridor, day, price, min(price) OVER v AS low, stddev_samp(price) OVER v / min(price) OVER v AS s, count(*) OVER v AS n FROM d
  WINDOW v AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING))
SELECT corridor, day, round(greatest(0, least(1, (price / low - 1) / (2 * 3.0 * s))), 4) AS strength FROM r WHERE n = 20 AND price / low - 1 >= 3.0 * s""")
def ind_reversal(spark, sf):
    return _fired(spark, sf, "reversal_from_low", lookback=20, bounce=3.0)


@query("""WITH {D}, s AS (SELECT corridor, day, CASE WHEN count(*) OVER v = 20 THEN stddev_samp(price) OVER v / avg(price) OVER v END AS s, CASE WHEN count(*) OVER b = 20 THEN stddev_samp(price) OVER b / avg(price) OVER b END AS p FROM d WINDOW v AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING),
b AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 39 PRECEDING AND 20 PRECEDING))
SELECT corridor, day, round(greatest(0, least(1, s / (2 * p))), 4) AS strength FROM s WHERE s / nullif(p, 0) > 1.25""")
def ind_volregime(spark, sf):
    return _fired(spark, sf, "volatility_regime", window=20, regime="high")


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d),
s AS (SELECT corridor, day, count(r) OVER w AS n, avg(r) OVER w AS m, stddev_samp(r) OVER w AS s FROM r
  WINDOW w AS (PARTITION BY corridor, month(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT corridor, day, CASE WHEN m > 0 THEN 'up' ELSE 'down' END AS direction, round(abs(m) / s, 5) AS signal_to_noise FROM s
  WHERE n >= 20 AND s > 0 AND abs(m) / s >= 0.25""")
def ind_seasonality(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY()))
    w = Window.partitionBy("corridor", F.month("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    d = d.select("corridor", "day", F.count("r").over(w).alias("n"), F.avg("r").over(w).alias("m"), F.stddev_samp("r").over(w).alias("s")).where("n >= 20 and s > 0")
    return d.where(F.abs("m") / c("s") >= 0.25).select("corridor", "day", F.when(c("m") > 0, "up").otherwise("down").alias("direction"), F.round(F.abs("m") / c("s"), 5).alias("signal_to_noise"))


GRID = {"filter_rule": {"x": [10.0, 20.0, 30.0]}, "level_percentile": {"window": [30, 60], "pct": [5, 10, 20]}, "momentum_streak": {"n": [2, 3]}}


@query("""WITH {D}, r AS (SELECT corridor, day, (price / lag(price) OVER w - 1) * 100 AS r, (price < lag(price) OVER w)::INT AS down, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS 29 PRECEDING) AS a, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING) AS b, price FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
k AS (SELECT *, CASE WHEN len(a) = 30 THEN len(list_filter(a, lambda x: x <= price)) * 100.0 / 30 END AS k30, CASE WHEN len(b) = 60 THEN len(list_filter(b, lambda x: x <= price)) * 100.0 / 60 END AS k60, sum(down) OVER (PARTITION BY corridor ORDER BY day ROWS 1 PRECEDING) AS d2, sum(down) OVER (PARTITION BY corridor ORDER BY day ROWS 2 PRECEDING) AS d3 FROM r),
f AS (SELECT 'filter_rule' AS indicator, '{"x":' || x || '}' AS params FROM k, (VALUES (10.0), (20.0), (30.0)) t(x) WHERE r <= -x
UNION ALL SELECT 'level_percentile', '{"pct":' || p || ',"window":' || w || '}' FROM k, (VALUES (5), (10), (20)) t(p), (VALUES (30), (60)) u(w)
  WHERE CASE w WHEN 30 THEN k30 ELSE k60 END <= p
UNION ALL SELECT 'momentum_streak', '{"n":' || n || '}' FROM k, (VALUES (2), (3)) t(n) WHERE CASE n WHEN 2 THEN d2 ELSE d3 END = n)
SELECT indicator, params, count(*) AS firings FROM f GROUP BY 1, 2""")
def signal_grid(spark, sf):
    """Firings of every combination of a parameter grid, evaluated in one pass."""
    s = I.signals(P.daily_panel(spark, sf), I.expand_grid(GRID), key="corridor", at="day", price="price")
    return s.groupBy("indicator", "params").agg(F.count("*").alias("firings"))


@query("""WITH {D}, r AS (SELECT corridor, day, (price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1) * 100 AS r FROM d),
l AS (SELECT corridor, max(day) AS day FROM d WHERE day <= DATE '1999-03-31'
  GROUP BY 1) SELECT corridor, day, 'filter_rule' AS indicator, round(greatest(0, least(1, -r / 2)), 4) AS strength FROM r JOIN l USING (corridor, day) WHERE r <= -1""")
def signals_as_of(spark, sf):
    d = P.daily_panel(spark, sf)
    s = I.signals(d, [("filter_rule", {"x": 1.0})], key="corridor", at="day", price="price")
    return I.latest(s, d, key="corridor", at="day", cut=F.lit("1999-03-31").cast("date")).select("corridor", "day", "indicator", r4("strength").alias("strength"))


@query("""WITH {D}, b AS (SELECT a.corridor, a.day, a.price, min(CASE WHEN b.price <= a.price * 0.98 THEN b.day END) AS hit, max(b.day) AS last FROM d a
  JOIN d b ON a.corridor = b.corridor AND b.day > a.day AND b.day <= a.day + 14 JOIN (SELECT corridor, max(day) AS e FROM d
  GROUP BY 1) m ON a.corridor = m.corridor AND a.day + 14 <= m.e GROUP BY 1, 2, 3)
SELECT corridor, day, coalesce(hit, last) AS executed, coalesce(hit, last) - day AS waited, hit IS NOT NULL AS reached FROM b""")
def target_orders(spark, sf):
    """A limit two per cent under each day's price, executed at the first price that reaches it within fourteen days, else at the last."""
    d = P.daily_panel(spark, sf).withColumn("k", F.unix_date("day")).withColumn("end", F.max("day").over(Window.partitionBy("corridor")))
    w = Window.partitionBy("corridor").orderBy("k").rangeBetween(1, 14)
    d = d.withColumn("f", F.collect_list(F.struct("day", "price")).over(w)).where((F.size("f") > 0) & (F.date_add("day", 14) <= c("end")))
    hit = F.array_min(F.transform(F.filter("f", lambda x: x["price"] <= c("price") * 0.98), lambda x: x["day"]))
    last = F.array_max(F.transform("f", lambda x: x["day"]))
    return d.select("corridor", "day", F.coalesce(hit, last).alias("executed"), F.date_diff(F.coalesce(hit, last), "day").alias("waited"), hit.isNotNull().alias("reached"))


@query("""WITH {D}, t AS (SELECT *, (rn // 10) AS block, rn % 10 AS step FROM (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS rn FROM d)),
q AS (SELECT corridor, block, count(*) AS n, min_by(price, step) AS buy_first, min(price) AS oracle, round(avg(price), 4) AS random FROM t GROUP BY 1, 2),
s AS (SELECT t.corridor, t.block, coalesce(min(CASE WHEN t.price <= m.m THEN step END), 9) AS stop FROM t JOIN (SELECT corridor, block, median(price) AS m
  FROM t GROUP BY 1, 2) m USING (corridor, block) GROUP BY 1, 2)
SELECT q.corridor, q.block, buy_first, oracle, random, t.price AS static FROM q JOIN s USING (corridor, block)
  JOIN t ON t.corridor = q.corridor AND t.block = q.block AND t.step = s.stop WHERE q.n = 10""")
def optimal_stopping(spark, sf):
    """Blocks of ten rows: buying first, the best, the mean, and the first price at or under the block's median."""
    t = I.tumbling(P.daily_panel(spark, sf), key="corridor", at="day", size=10)
    q = t.groupBy("corridor", "block").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("step", "price"))).alias("v"), F.min_by("price", "step").alias("buy_first"), F.min("price").alias("oracle"), r4(F.avg("price")).alias("random"), F.percentile("price", F.lit(0.5)).alias("m")).where("n = 10")
    return q.select("corridor", "block", "buy_first", "oracle", "random", F.get(F.filter("v", lambda x: x["price"] <= c("m")), F.lit(0))["price"].alias("static"))


@query("""WITH {D}, s AS (SELECT *, row_number() OVER w AS pos, (price < lag(price) OVER w)::INT AS down, price <= min(price) OVER (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING) AS slow FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
t AS (SELECT *, sum(down) OVER (PARTITION BY corridor ORDER BY day ROWS 1 PRECEDING) = 2 AS fast FROM s),
u AS (SELECT *, fast AND NOT coalesce(lag(fast) OVER (PARTITION BY corridor ORDER BY day), false) AS onset, min(CASE WHEN slow THEN pos END) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING) AS reached FROM t)
SELECT u.corridor, u.day, u.reached - u.pos AS waited, round((v.price / u.price - 1) * 10000, 4) AS waiting_bps FROM u
  LEFT JOIN s v ON v.corridor = u.corridor AND v.pos = u.reached WHERE onset""")
def fast_slow_pairs(spark, sf):
    """Each onset of two falls in a row with the first twenty-day low of the next five rows."""
    w = DAY()
    d = P.daily_panel(spark, sf).withColumn("pos", F.row_number().over(w)).withColumn("fast", X.streak(c("price") < F.lag("price").over(w), w, 2)).withColumn("slow", c("price") <= F.min("price").over(X.trailing(w, 20)))
    ahead = w.rowsBetween(0, 5)
    d = d.withColumn("onset", X.onset(c("fast"), w)).withColumn("at", F.min(F.when(c("slow"), F.struct("pos", "price"))).over(ahead)).where("onset")
    return d.select("corridor", "day", (c("at.pos") - c("pos")).alias("waited"), r4((c("at.price") / c("price") - 1) * 10_000).alias("waiting_bps"))


@query("""WITH k AS (SELECT DISTINCT event_type AS corridor FROM events) SELECT k.corridor, date_trunc('day', ts)::DATE AS day, count(*) AS events, sum((e.event_type = k.corridor)::INT) AS own FROM events e JOIN k ON e.event_type = 'click' OR e.event_type = k.corridor GROUP BY 1, 2""")
def fan_out(spark, sf):
    """Events of one type count for every corridor, others for their own: counted by day first, then fanned out by an equi-join with the corridors there are."""
    e = P.table(spark, sf, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    kinds = e.select(c("event_type").alias("corridor")).where("corridor is not null").distinct()
    to = kinds.select("corridor", F.lit("click").alias("event_type")).unionByName(kinds.select("corridor", c("corridor").alias("event_type"))).distinct()
    x = e.join(to, "event_type")
    return x.groupBy("corridor", "day").agg(F.sum("n").alias("events"), F.sum(F.when(c("event_type") == c("corridor"), c("n")).otherwise(0)).alias("own"))


@query("""WITH s AS (SELECT DISTINCT secid, dt_msk, close FROM moex_candles WHERE close > 0),
x AS (SELECT s.*, asset_class, CAST(dt_msk AS DATE) AS day FROM s JOIN moex_universe USING (secid)),
l AS (SELECT secid, asset_class, day, max_by(close, dt_msk) AS close FROM x GROUP BY ALL),
r AS (SELECT *, round(close / lag(close) OVER (PARTITION BY secid ORDER BY day) - 1, 9) AS r FROM l)
SELECT asset_class, day, count(r) AS members, round(median(r), 6) AS median_return, round(avg((r > 0)::INT), 6) AS positive_share FROM r
  WHERE r IS NOT NULL GROUP BY 1, 2""")
def block_medians(spark, sf):
    """Median return and share of rises of each asset class and day, from the last candle of the day."""
    s = P.table(spark, sf, "moex_candles").where("close > 0").groupBy("secid", F.to_date("dt_msk").alias("day")).agg(F.max_by("close", F.struct("dt_msk", "close")).alias("close"))
    x = s.join(P.table(spark, sf, "moex_universe").select("secid", "asset_class"), "secid")
    r = x.withColumn("r", F.round(X.change(c("close"), X.series("secid", "day")), 9)).where("r is not null")
    return r.groupBy("asset_class", "day").agg(F.count("r").alias("members"), r6(F.percentile("r", F.lit(0.5))).alias("median_return"), r6(F.avg((c("r") > 0).cast("int"))).alias("positive_share"))


@query("""WITH s AS (SELECT DISTINCT secid, dt_msk, volume_rub FROM moex_candles),
v AS (SELECT secid, CAST(dt_msk AS DATE) AS day, CASE WHEN sum(volume_rub) > 0 THEN round(ln(1 + sum(volume_rub)), 9) END AS v FROM s
  WHERE volume_rub IS NULL OR NOT isnan(volume_rub) GROUP BY 1, 2)
SELECT secid, day, round(lag(v) OVER w, 6) AS log_volume, round(lag(v) OVER w - lag(v, 2) OVER w, 6) AS change1, lag(v IS NULL) OVER w AS inactive FROM v
  WINDOW w AS (PARTITION BY secid ORDER BY day)""")
def liquidity_block(spark, sf):
    """Log turnover of the day before and its change; days without turnover are missing, not zero."""
    s = P.table(spark, sf, "moex_candles").where("volume_rub is null or not isnan(volume_rub)").select("secid", "dt_msk", "volume_rub").distinct()
    v = s.groupBy("secid", F.to_date("dt_msk").alias("day")).agg(F.sum("volume_rub").alias("t")).withColumn("v", F.when(c("t") > 0, F.round(F.log1p("t"), 9)))
    w = X.series("secid", "day")
    return v.select("secid", "day", r6(F.lag("v").over(w)).alias("log_volume"), r6(F.lag("v").over(w) - F.lag("v", 2).over(w)).alias("change1"), F.lag(c("v").isNull()).over(w).alias("inactive"))


@query("""WITH s AS (SELECT DISTINCT secid, dt_msk, close, volume_rub FROM moex_candles WHERE close > 0 AND volume_rub > 0 AND NOT isnan(volume_rub)),
u AS (SELECT secid, asset_class, CAST(dt_msk AS DATE) AS day, round(sum(volume_rub), 2) AS vol, max_by(close, dt_msk) AS close FROM s
  JOIN moex_universe USING (secid) GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY asset_class, day ORDER BY vol DESC, secid) AS rk FROM u)
SELECT a.asset_class, a.day, a.secid AS near, b.secid AS far, round(b.close / a.close - 1, 6) AS slope FROM n a
  LEFT JOIN n b ON a.asset_class = b.asset_class AND a.day = b.day AND b.rk = 2 WHERE a.rk = 1""")
def near_far_pair(spark, sf):
    """The most and second most traded instrument of each class and day and the step between them."""
    s = P.table(spark, sf, "moex_candles").where("close > 0 and volume_rub > 0 and not isnan(volume_rub)").select("secid", "dt_msk", "close", "volume_rub").distinct()
    d = s.groupBy("secid", F.to_date("dt_msk").alias("day")).agg(F.round(F.sum("volume_rub"), 2).alias("vol"), F.max_by("close", "dt_msk").alias("close"))
    u = d.join(P.table(spark, sf, "moex_universe").select("secid", "asset_class"), "secid")
    w = Window.partitionBy("asset_class", "day").orderBy(c("vol").desc(), "secid")
    n = u.withColumn("rk", F.row_number().over(w)).where("rk <= 2")
    g = n.groupBy("asset_class", "day").agg(F.max(F.when(c("rk") == 1, F.struct("secid", "close"))).alias("a"), F.max(F.when(c("rk") == 2, F.struct("secid", "close"))).alias("b"))
    return g.select("asset_class", "day", c("a.secid").alias("near"), c("b.secid").alias("far"), r6(c("b.close") / c("a.close") - 1).alias("slope"))


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d),
v AS (SELECT corridor, day, r * r AS actual, avg(r * r) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS forecast FROM r
  WHERE r <> 0)
SELECT corridor, count(*) AS n, round(avg((forecast - actual) ** 2), 6) AS mse, round(avg(actual / forecast + ln(forecast)), 5) AS qlike FROM v
  WHERE forecast > 0 GROUP BY 1""")
def forecast_loss(spark, sf):
    w = DAY()
    r = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), w)).where("r <> 0").withColumn("actual", c("r") * c("r")).withColumn("forecast", F.avg("actual").over(X.trailing(w, 20, 1))).where("forecast > 0")
    return r.groupBy("corridor").agg(F.count("*").alias("n"), r6(F.avg(F.pow(c("forecast") - c("actual"), F.lit(2.0)))).alias("mse"), F.round(F.avg(c("actual") / c("forecast") + F.log("forecast")), 5).alias("qlike"))


@query("""WITH {D}, f AS (SELECT corridor, day, (price - min(price) OVER w) / price * 10000 AS r FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) QUALIFY count(*) OVER w = 5),
t AS (SELECT corridor, (VALUES_.t) AS tolerance, greatest(0, r) <= VALUES_.t AS hit FROM f, (VALUES (0), (10), (25), (50), (100)) VALUES_(t))
SELECT corridor, tolerance, round(avg(hit::INT), 6) AS base_rate, count(*) AS n FROM t GROUP BY 1, 2""")
def tolerance_sweep(spark, sf):
    d = P.daily_panel(spark, sf).select("corridor", L.regret_paid(c("price"), DAY(), 5).alias("r")).where("r is not null")
    wide = d.groupBy("corridor").agg(F.count("*").alias("n"), *[F.avg((c("r") <= t).cast("int")).alias(str(t)) for t in (0, 10, 25, 50, 100)])
    return wide.unpivot(["corridor", "n"], ["0", "10", "25", "50", "100"], "tolerance", "base_rate").select("corridor", c("tolerance").cast("int").alias("tolerance"), r6("base_rate").alias("base_rate"), "n")


@query("""WITH {D}, f AS (SELECT corridor, day, (price / min(price) OVER w - 1) * 10000 AS r FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)
  QUALIFY count(*) OVER w = 5) SELECT corridor, CASE WHEN r <= 25 THEN 0 WHEN r <= 500 THEN 1 WHEN r <= 5000 THEN 2 ELSE 3 END AS class, count(*) AS n
  FROM f GROUP BY 1, 2""")
def regret_classes(spark, sf):
    r = c("r")
    d = P.daily_panel(spark, sf).select("corridor", L.regret_best(c("price"), DAY(), 5).alias("r")).where("r is not null")
    return d.groupBy("corridor", F.when(r <= 25, 0).when(r <= 500, 1).when(r <= 5000, 2).otherwise(3).alias("class")).agg(F.count("*").alias("n"))


@query("""WITH {D}, r AS (SELECT corridor, day, (price / lag(price) OVER w - 1) AS r1, (price / lag(price, 3) OVER w - 1) AS r3, (price / lag(price, 5) OVER w - 1) AS r5 FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
u AS (UNPIVOT r ON r1, r3, r5 INTO NAME factor VALUE v),
q AS (SELECT *, CASE WHEN count(v) OVER w >= 60 THEN quantile_cont(v, 0.1) OVER w END AS lo, CASE WHEN count(v) OVER w >= 60 THEN quantile_cont(v, 0.9) OVER w END AS hi FROM u WINDOW w AS (PARTITION BY corridor, factor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT corridor, factor, sum((v <= lo)::INT)::BIGINT AS low_tail, sum((v >= hi)::INT)::BIGINT AS high_tail FROM q WHERE lo IS NOT NULL GROUP BY 1, 2""")
def rule_library(spark, sf):
    """Factors by tails: how often each return lies beyond the tenth or ninetieth percentile of its last sixty."""
    p, w = c("price"), DAY()
    wide = P.daily_panel(spark, sf).select("corridor", "day", *[X.change(p, w, k).alias(f"r{k}") for k in (1, 3, 5)])
    long = wide.unpivot(["corridor", "day"], ["r1", "r3", "r5"], "factor", "v").where("v is not null")
    fw = Window.partitionBy("corridor", "factor").orderBy("day")
    q = long.withColumn("lo", X.trailing_quantile(c("v"), fw, 60, 0.1, 60)).withColumn("hi", X.trailing_quantile(c("v"), fw, 60, 0.9, 60)).where("lo is not null")
    return q.groupBy("corridor", "factor").agg(F.count_if(c("v") <= c("lo")).alias("low_tail"), F.count_if(c("v") >= c("hi")).alias("high_tail"))


@query("""WITH {H}, k AS (SELECT corridor, isodow(hour) AS wd, hour(hour) AS hr, avg(price) AS m, count(*) AS n FROM h GROUP BY 1, 2, 3),
q AS (SELECT corridor, quantile_cont(m, 0.9) AS q FROM k WHERE n >= 2 GROUP BY 1) SELECT corridor, wd AS weekday, hr AS hour, round(m, 7) AS mean, n FROM k
  JOIN q USING (corridor) WHERE n >= 2 AND round(m, 7) >= round(q, 7)""")
def session_buckets(spark, sf):
    """Hours of the week whose mean lies in the top tenth of its corridor's."""
    k = P.hourly_panel(spark, sf).groupBy("corridor", (F.weekday("hour") + 1).alias("weekday"), F.hour("hour").alias("hour")).agg(F.round(F.avg("price"), 7).alias("mean"), F.avg("price").alias("m"), F.count("*").alias("n")).where("n >= 2")
    q = k.groupBy("corridor").agg(F.round(F.percentile("m", F.lit(0.9)), 7).alias("q"))
    return k.join(q, "corridor").where("mean >= q").select("corridor", "weekday", "hour", "mean", "n")


@query("""WITH {D}, s AS (SELECT corridor, day, price, lag(price) OVER w AS p1, avg(price) OVER (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING) AS m, stddev_samp(price) OVER (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING) AS s, max(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS top, count(*) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS n, avg(price) OVER (PARTITION BY corridor ORDER BY day ROWS 2 PRECEDING) AS fast, avg(price) OVER (PARTITION BY corridor ORDER BY day ROWS 9 PRECEDING) AS slow FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day))
SELECT corridor, count(*) AS n, sum((price / p1 - 1 <= -0.2)::INT)::BIGINT AS drop20, sum((price <= m - 2 * s)::INT)::BIGINT AS below_band, sum((price > top)::INT)::BIGINT AS breakout, sum((round(fast, 3) > round(slow, 3))::INT)::BIGINT AS fast_above FROM s WHERE n = 20 GROUP BY 1""")
def technical_rules(spark, sf):
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", p, F.lag(p).over(w).alias("p1"), F.avg(p).over(X.trailing(w, 20)).alias("m"), F.stddev_samp(p).over(X.trailing(w, 20)).alias("s"), F.max(p).over(X.trailing(w, 20, 1)).alias("top"), F.count(p).over(X.trailing(w, 20, 1)).alias("n"), F.round(F.avg(p).over(X.trailing(w, 3)), 3).alias("fast"), F.round(F.avg(p).over(X.trailing(w, 10)), 3).alias("slow")).where("n = 20")
    return d.groupBy("corridor").agg(F.count("*").alias("n"), F.count_if(p / c("p1") - 1 <= -0.2).alias("drop20"), F.count_if(p <= c("m") - 2 * c("s")).alias("below_band"), F.count_if(p > c("top")).alias("breakout"), F.count_if(c("fast") > c("slow")).alias("fast_above"))


@query("""WITH {D}, m AS (SELECT corridor, date_trunc('month', day)::DATE AS month, round(avg(price), 2) AS x, round(avg(n), 6) AS y FROM d GROUP BY 1, 2),
r AS (SELECT corridor, rank() OVER (PARTITION BY corridor ORDER BY x) + (count(*) OVER (PARTITION BY corridor, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY corridor ORDER BY y) + (count(*) OVER (PARTITION BY corridor, y) - 1) / 2.0 AS ry FROM m)
SELECT corridor, round(corr(rx, ry), 6) AS spearman, count(*) AS months FROM r GROUP BY 1""")
def spearman(spark, sf):
    """Rank correlation of monthly price and activity, ties by their mean rank."""
    m = P.daily_panel(spark, sf).groupBy("corridor", F.trunc("day", "month").alias("month")).agg(F.round(F.avg("price"), 2).alias("x"), r6(F.avg("n")).alias("y"))
    rank = lambda k: F.rank().over(Window.partitionBy("corridor").orderBy(k)) + (F.count("*").over(Window.partitionBy("corridor", k)) - 1) / 2
    return m.select("corridor", rank("x").alias("rx"), rank("y").alias("ry")).groupBy("corridor").agg(r6(F.corr("rx", "ry")).alias("spearman"), F.count("*").alias("months"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer JOIN orders ON c_custkey = o_custkey WHERE o_totalprice > 300000 GROUP BY ALL")
def prefix_projection(spark, sf):
    """Only the columns of one prefix of a joined frame."""
    j = P.table(spark, sf, "customer").join(P.table(spark, sf, "orders").where("o_totalprice > 300000"), c("c_custkey") == c("o_custkey"))
    return j.select(*[k for k in j.columns if k.startswith("c_")]).distinct()


@query("""SELECT horizon, count(*) AS n, round(avg(regret_bps), 6) AS regret FROM (SELECT DISTINCT score_id, horizon, score, regret_bps, target FROM score_frame
  WHERE score IS NOT NULL AND NOT isnan(score) AND regret_bps IS NOT NULL AND target IS NOT NULL) GROUP BY 1""")
def complete_cases(spark, sf):
    s = P.table(spark, sf, "score_frame").select("score_id", "horizon", "score", "regret_bps", "target").dropna(subset=["score", "regret_bps", "target"]).distinct()
    return s.groupBy("horizon").agg(F.count("*").alias("n"), r6(F.avg("regret_bps")).alias("regret"))


@query("""WITH {H} SELECT a.corridor, a.hour, a.n, b.n AS lag1, c.n AS lag2, d.n AS lag24 FROM h a
  JOIN h b ON a.corridor = b.corridor AND a.hour = b.hour + INTERVAL 1 HOUR JOIN h c ON a.corridor = c.corridor AND a.hour = c.hour + INTERVAL 2 HOUR
  JOIN h d ON a.corridor = d.corridor AND a.hour = d.hour + INTERVAL 24 HOUR""")
def multi_lag_join(spark, sf):
    """Each hour with the same source one, two and 24 hours before; rows are spread to the hours they serve and gathered once, instead of joined thrice."""
    h = P.hourly_panel(spark, sf).select("corridor", "hour", "n")
    lags = F.explode(F.array(F.lit(0), F.lit(1), F.lit(2), F.lit(24))).alias("k")
    x = h.select("corridor", "hour", "n", lags).withColumn("hour", c("hour") + F.make_interval(hours=c("k")))
    at = lambda k: F.max(F.when(c("k") == k, c("n")))
    g = x.groupBy("corridor", "hour").agg(at(0).alias("n"), at(1).alias("lag1"), at(2).alias("lag2"), at(24).alias("lag24"))
    return g.dropna()


@query("""WITH {D}, x AS (SELECT corridor, day, price, greatest(0, (price - min(price) OVER f) / price) * 10000 AS r, count(*) OVER f AS nf, row_number() OVER (PARTITION BY corridor ORDER BY day) AS rn FROM d WINDOW f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
j AS (SELECT a.corridor, a.day, b.r, row_number() OVER (PARTITION BY a.corridor, a.rn ORDER BY abs(a.price - b.price), b.rn) AS k, count(*) OVER (PARTITION BY a.corridor, a.rn) AS n FROM x a JOIN x b ON a.corridor = b.corridor AND b.rn <= a.rn - 5 AND b.rn >= a.rn - 64 AND b.nf = 5)
SELECT corridor, day, round(max(r), 4) AS worst, round(avg(r), 4) AS mean FROM j WHERE k <= 10 AND n >= 40 GROUP BY 1, 2""")
def nearest_history(spark, sf):
    """Regret of the ten days nearest in price among the last sixty whose outcome is known."""
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", "price", F.row_number().over(w).alias("rn"), L.regret_paid(p, w, 5).alias("r"))
    d = d.withColumn("h", F.collect_list(F.when(c("r").isNotNull(), F.struct("price", "rn", "r"))).over(w.rowsBetween(-64, -5))).where(F.size("h") >= 40)
    near = F.slice(F.array_sort(F.transform("h", lambda x: F.struct(F.abs(x["price"] - c("price")).alias("d"), x["rn"].alias("rn"), x["r"].alias("r")))), 1, 10)
    d = d.select("corridor", "day", F.transform(near, lambda x: x["r"]).alias("v"))
    return d.select("corridor", "day", r4(F.array_max("v")).alias("worst"), r4(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v")).alias("mean"))


@query("""SELECT DISTINCT secid, dt_msk, round(list_avg(v), 9) AS mean, list_min(v) AS low, list_max(v) AS high, len(v) AS present, round(len(list_filter(v, lambda x: x > open)) / len(v), 6) AS above_open FROM (SELECT *, list_filter([open, high, low, close], lambda x: x > 0) AS v FROM moex_candles) WHERE len(v) > 0""")
def horizontal_stats(spark, sf):
    """Statistics across the columns of a row, missing ones skipped."""
    d = P.table(spark, sf, "moex_candles").select("secid", "dt_msk", "open", F.filter(F.array("open", "high", "low", "close"), lambda x: x > 0).alias("v")).where(F.size("v") > 0)
    return d.select("secid", "dt_msk", F.round(F.aggregate("v", F.lit(0.0), lambda a, b: a + b) / F.size("v"), 9).alias("mean"), F.array_min("v").alias("low"), F.array_max("v").alias("high"), F.size("v").alias("present"), r6(F.size(F.filter("v", lambda x: x > c("open"))) / F.size("v")).alias("above_open")).distinct()


@query("""WITH {D}, y AS (SELECT corridor, year(day) AS y, round(avg(price), 4) AS m FROM d GROUP BY 1, 2),
l AS (SELECT corridor, m / lag(m) OVER (PARTITION BY corridor ORDER BY y) AS r FROM y)
SELECT corridor, count(r) AS folds, round(median(r), 6) AS median, round(quantile_cont(r, 0.75) - quantile_cont(r, 0.25), 6) AS iqr, round(min(r), 6) AS worst, round(max(r), 6) AS best FROM l WHERE r IS NOT NULL GROUP BY 1""")
def foldwise_summary(spark, sf):
    y = P.daily_panel(spark, sf).groupBy("corridor", F.year("day").alias("y")).agg(r4(F.avg("price")).alias("m"))
    r = y.withColumn("r", c("m") / F.lag("m").over(X.series("corridor", "y"))).where("r is not null")
    q = lambda x: F.percentile("r", F.lit(x))
    return r.groupBy("corridor").agg(F.count("r").alias("folds"), r6(q(0.5)).alias("median"), r6(q(0.75) - q(0.25)).alias("iqr"), r6(F.min("r")).alias("worst"), r6(F.max("r")).alias("best"))


@query("""WITH {D}, p AS (SELECT corridor, day, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY corridor) AS n FROM d),
b AS (SELECT *, ntile(4) OVER (PARTITION BY corridor ORDER BY day) AS block FROM p WHERE pos >= n // 2)
SELECT corridor, block, min(pos) - 5 AS train_stop, min(pos) AS test_lo, max(pos) AS test_hi FROM b GROUP BY 1, 2""")
def oof_blocks(spark, sf):
    """The second half of a series in four consecutive blocks, each scored by what lies five rows before it."""
    p = P.daily_panel(spark, sf).withColumn("pos", P.position("corridor", "day")).withColumn("n", F.count("*").over(Window.partitionBy("corridor"))).where(c("pos") >= F.floor(c("n") / 2))
    b = p.withColumn("block", F.ntile(4).over(DAY()))
    return b.groupBy("corridor", "block").agg((F.min("pos") - 5).alias("train_stop"), F.min("pos").alias("test_lo"), F.max("pos").alias("test_hi"))


@query("WITH {D} SELECT day, count(DISTINCT corridor) AS corridors FROM d GROUP BY 1 HAVING count(DISTINCT corridor) <> 5")
def identical_support(spark, sf):
    """Days on which not every corridor has a row."""
    return P.daily_panel(spark, sf).groupBy("day").agg(F.count_distinct("corridor").alias("corridors")).where("corridors <> 5")


@query("""WITH {D}, p AS (SELECT corridor, (price < 120000)::INT AS s, (n >= 2)::INT AS t, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY corridor) AS n FROM d),
k AS (SELECT corridor, n, shift, sum(s * t) AS hits FROM (SELECT a.corridor, a.n, a.s, b.t, x.shift FROM p a
  JOIN (SELECT unnest(generate_series(0, 49)) * 17 AS shift) x ON true JOIN p b ON b.corridor = a.corridor AND b.pos = (a.pos + x.shift) % a.n) GROUP BY 1, 2, 3)
SELECT corridor, max(CASE WHEN shift = 0 THEN hits END)::BIGINT AS hits, round((1 + sum((shift > 0 AND hits >= h0)::INT)) / (1 + sum((shift > 0)::INT)), 6) AS p FROM (SELECT *, max(CASE WHEN shift = 0 THEN hits END) OVER (PARTITION BY corridor) AS h0 FROM k) GROUP BY 1""")
def circular_placebo(spark, sf):
    """How often signals hit as many targets when the targets are rolled along the series, for 49 rolls."""
    w = Window.partitionBy("corridor")
    p = P.daily_panel(spark, sf).select("corridor", (c("price") < 120_000).cast("int").alias("s"), (c("n") >= 2).cast("int").alias("t"), P.position("corridor", "day").alias("pos"), F.count("*").over(w).alias("len"))
    hit = p.where("s = 1").select("corridor", "len", "pos", F.explode(F.sequence(F.lit(0), F.lit(49 * 17), F.lit(17))).alias("shift")).withColumn("pos", (c("pos") + c("shift")) % c("len"))
    k = hit.join(p.where("t = 1").select("corridor", "pos"), ["corridor", "pos"], "left_semi").groupBy("corridor", "shift").agg(F.count("*").alias("hits"))
    base = p.groupBy("corridor").agg(F.lit(1).alias("one")).select("corridor", F.explode(F.sequence(F.lit(0), F.lit(49 * 17), F.lit(17))).alias("shift"))
    k = base.join(k, ["corridor", "shift"], "left").withColumn("hits", F.coalesce("hits", F.lit(0))).withColumn("h0", F.max(F.when(c("shift") == 0, c("hits"))).over(w))
    return k.groupBy("corridor").agg(F.max(F.when(c("shift") == 0, c("hits"))).alias("hits"), r6((1 + F.count_if((c("shift") > 0) & (c("hits") >= c("h0")))) / (1 + F.count_if(c("shift") > 0))).alias("p"))


@query("""WITH s AS (SELECT DISTINCT secid, dt_msk, close, volume_rub FROM moex_candles WHERE close > 0 AND volume_rub > 0 AND NOT isnan(volume_rub)),
u AS (SELECT secid, asset_class, CAST(dt_msk AS DATE) AS day, round(sum(volume_rub), 2) AS vol, max_by(close, dt_msk) AS close FROM s
  JOIN moex_universe USING (secid) GROUP BY ALL),
n AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY asset_class, day ORDER BY vol DESC, secid) = 1),
f AS (SELECT *, CASE WHEN secid <> lag(secid) OVER w THEN lag(close) OVER w / close ELSE 1 END AS f FROM n WINDOW w AS (PARTITION BY asset_class ORDER BY day))
SELECT asset_class, day, secid, close, round(exp(sum(ln(f)) OVER (PARTITION BY asset_class ORDER BY day ROWS UNBOUNDED PRECEDING)) * close / first_value(close) OVER (PARTITION BY asset_class ORDER BY day ROWS UNBOUNDED PRECEDING), 5) AS rolled FROM f""")
def continuous_roll(spark, sf):
    """A series that follows the most traded instrument of its class; at each switch it is scaled so that it does not jump, and its past never changes."""
    s = P.table(spark, sf, "moex_candles").where("close > 0 and volume_rub > 0 and not isnan(volume_rub)").select("secid", "dt_msk", "close", "volume_rub").distinct()
    d = s.groupBy("secid", F.to_date("dt_msk").alias("day")).agg(F.round(F.sum("volume_rub"), 2).alias("vol"), F.max_by("close", "dt_msk").alias("close"))
    u = d.join(P.table(spark, sf, "moex_universe").select("secid", "asset_class"), "secid")
    n = u.withColumn("rk", F.row_number().over(Window.partitionBy("asset_class", "day").orderBy(c("vol").desc(), "secid"))).where("rk = 1")
    w = X.series("asset_class", "day")
    past = w.rowsBetween(Window.unboundedPreceding, 0)
    f = n.withColumn("f", F.when(c("secid") != F.lag("secid").over(w), F.lag("close").over(w) / c("close")).otherwise(1.0))
    return f.select("asset_class", "day", "secid", "close", F.round(F.exp(F.sum(F.log("f")).over(past)) * c("close") / F.first("close").over(past), 5).alias("rolled"))


@query("SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE CAST(ts AS DATE) BETWEEN DATE '2024-01-10' AND DATE '2024-01-12' GROUP BY 1, 2")
def partition_pruned_scan(spark, sf):
    """A table written by day and read back for three of them; only their folders are listed for reading."""
    path = scratch(spark, "by-day")
    P.table(spark, sf, "events").select("event_type", F.to_date("ts").alias("day")).repartition("day").write.partitionBy("day").parquet(path)
    return spark.read.parquet(path).where("day between date'2024-01-10' and date'2024-01-12'").groupBy("event_type", "day").agg(F.count("*").alias("n"))


@query(f"""WITH {{D}}, k AS (SELECT corridor, day, sum((price < 120000)::INT) OVER (PARTITION BY corridor, date_trunc('week', day)) AS want,
  row_number() OVER (PARTITION BY corridor, date_trunc('week', day) ORDER BY {draw_sql("5", "day")}, day) AS rn FROM d) SELECT corridor, day FROM k WHERE rn <= want""")
def matched_random(spark, sf):
    """As many days per corridor and week as have cheap prices, drawn by a seeded digest."""
    d = P.daily_panel(spark, sf).withColumn("week", F.date_trunc("week", "day")).withColumn("cheap", (c("price") < 120_000).cast("int"))
    w = Window.partitionBy("corridor", "week")
    d = d.withColumn("want", F.sum("cheap").over(w)).withColumn("rn", F.row_number().over(w.orderBy(draw(5, "day"), "day")))
    return d.where("rn <= want").select("corridor", "day")


@query()
def permutation_test(spark, sf, permutations=10_000, seed=20260905):
    """Each corridor's two-sided p-value of the rank correlation of change and activity, by seeded permutations (1 / (permutations + 1) at least).

    A corridor's ranks meet in one row, as long as the calendar; its draws are dealt out in blocks with a seed each, so
    results don't depend on partitions. Ranks are doubled and centred: sums of products are exact, equal ones count as hits.
    """
    if permutations < 1:
        raise ValueError("permutations: one at least")
    w, block = Window.partitionBy("corridor"), 500
    centred = lambda v: 2 * F.rank().over(w.orderBy(v)) + F.count("*").over(Window.partitionBy("corridor", v)) - F.count("*").over(w) - 2
    d = P.daily_panel(spark, sf).select("corridor", "day", X.change(c("price"), DAY()).alias("x"), c("n").alias("y")).where("x is not null")
    ranks = d.select("corridor", "day", centred("x").alias("x"), centred("y").alias("y")).groupBy("corridor").agg(F.sort_array(F.collect_list(F.struct("day", "x", "y"))).alias("v"), F.sum(c("x") * c("y")).alias("xy"), F.sum(c("x") * c("x")).alias("xx"), F.sum(c("y") * c("y")).alias("yy"))
    r0 = F.try_divide(F.abs("xy"), F.sqrt("xx") * F.sqrt("yy"))
    draws = ranks.select("corridor", r0.alias("r0"), c("v.x").alias("x"), c("v.y").alias("y"), F.coalesce(F.crc32(c("corridor").cast("binary")), F.lit(0)).alias("key"), F.explode(F.sequence(F.lit(0), F.lit((permutations - 1) // block))).alias("block"))

    def run(batches):
        for pdf in batches:
            hits = []
            for x, y, key, b in zip(pdf["x"], pdf["y"], pdf["key"], pdf["block"]):
                x, y = np.asarray(x, float), np.asarray(y, float)
                drawn = np.tile(x, (min(block, permutations - b * block), 1))
                np.random.default_rng([seed, key, b]).permuted(drawn, axis=1, out=drawn)
                hits.append(int((np.abs(drawn @ y) >= abs(x @ y)).sum()))
            yield pdf[["corridor", "r0"]].assign(hits=hits)

    t = draws.repartition("corridor", "block").mapInPandas(run, "corridor string, r0 double, hits long")
    return t.groupBy("corridor").agg(F.max("r0").alias("abs_correlation"), ((1 + F.sum("hits")) / (permutations + 1)).alias("p"))

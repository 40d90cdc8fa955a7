"""As-of, theta, semi and anti joins, grids, labels and ordered decisions over the panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import contracts
from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import labels as L
from tideline.operators import policy as Q
from tideline.operators.asof import asof_join
from tideline.queries.registry import query

c = lambda name: F.col(name)
r4 = lambda x: F.round(x, 4)
DAY = lambda: X.series("corridor", "day")


def _weekly(spark, sf):
    """A second source on the same corridors: what each Wednesday's price was."""
    return P.daily_panel(spark, sf).where(F.weekday("day") == 2).select("corridor", c("day").alias("seen"), c("price").alias("value"))


_W = "w AS (SELECT corridor, day AS seen, price AS value FROM d WHERE isodow(day) = 3)"


@query(f"WITH {{D}}, {_W} SELECT d.corridor, d.day, w.value AS asof_value FROM d ASOF LEFT JOIN w ON d.corridor = w.corridor AND d.day >= w.seen")
def asof_inclusive(spark, sf):
    return asof_join(P.daily_panel(spark, sf), _weekly(spark, sf), by="corridor", left_on="day", right_on="seen", columns=["value"]).select("corridor", "day", "asof_value")


@query(f"WITH {{D}}, {_W} SELECT d.corridor, d.day, CASE WHEN d.day - w.seen <= 5 THEN w.value END AS asof_value FROM d ASOF LEFT JOIN w ON d.corridor = w.corridor AND d.day > w.seen")
def asof_strict_tolerance(spark, sf):
    return asof_join(P.daily_panel(spark, sf), _weekly(spark, sf), by="corridor", left_on="day", right_on="seen", columns=["value"], strict=True, tolerance_s=5 * 86_400).select("corridor", "day", "asof_value")


@query(f"WITH {{D}}, {_W} SELECT d.corridor, d.day, CAST(w.seen AS VARCHAR) AS asof_seen FROM d ASOF LEFT JOIN w ON d.corridor = w.corridor AND d.day <= w.seen")
def asof_forward(spark, sf):
    return asof_join(P.daily_panel(spark, sf), _weekly(spark, sf), by="corridor", left_on="day", right_on="seen", columns=["seen"], forward=True).select("corridor", "day", c("asof_seen").cast("string").alias("asof_seen"))


@query("""WITH {H}, a AS (SELECT e.event_id, h.hour, h.price, e.ts FROM events e ASOF LEFT JOIN h ON e.event_type = h.corridor AND e.ts > h.hour)
SELECT event_id, price AS asof_price, date_diff('minute', hour, date_trunc('minute', ts)) AS age_minutes, price IS NULL AS missing FROM a""")
def asof_hours(spark, sf):
    e = P.table(spark, sf, "events").withColumn("corridor", c("event_type"))
    j = asof_join(e, P.hourly_panel(spark, sf), by="corridor", left_on="ts", right_on="hour", columns=["hour", "price"], strict=True)
    minutes = F.floor((F.unix_micros(F.date_trunc("minute", c("ts").cast("timestamp"))) - F.unix_micros(c("asof_hour").cast("timestamp"))) / 60_000_000)
    return j.select("event_id", "asof_price", minutes.alias("age_minutes"), c("asof_price").isNull().alias("missing"))


@query("""WITH {D}, hol AS (SELECT DISTINCT make_date(year(day), m, 1) AS h FROM d, (VALUES (1), (3), (5), (9)) v(m))
SELECT DISTINCT day, day - p.h AS days_since, n.h - day AS days_until, coalesce(day = p.h, false) AS is_holiday FROM (SELECT DISTINCT day FROM d) x
  ASOF LEFT JOIN hol p ON x.day >= p.h ASOF LEFT JOIN hol n ON x.day <= n.h""")
def nearest_holiday(spark, sf):
    days = P.daily_panel(spark, sf).select("day").distinct().withColumn("k", F.lit(1))
    hol = days.select("k", F.explode(F.array(*[F.make_date(F.year("day"), F.lit(m), F.lit(1)) for m in (1, 3, 5, 9)])).alias("h")).distinct()
    back = asof_join(days, hol, by="k", left_on="day", right_on="h", columns=["h"], prefix="p_")
    both = asof_join(back, hol, by="k", left_on="day", right_on="h", columns=["h"], prefix="n_", forward=True)
    return both.select("day", F.date_diff("day", "p_h").alias("days_since"), F.date_diff("n_h", "day").alias("days_until"), F.coalesce(c("day") == c("p_h"), F.lit(False)).alias("is_holiday"))


@query("SELECT c_custkey, c_name, n_name, r_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def join_many_to_one(spark, sf):
    nation = P.table(spark, sf, "nation").withColumnRenamed("n_nationkey", "c_nationkey")
    region = P.table(spark, sf, "region").withColumnRenamed("r_regionkey", "n_regionkey")
    one = contracts.join_validated(P.table(spark, sf, "customer"), nation, ["c_nationkey"], "inner")
    return contracts.join_validated(one, region, ["n_regionkey"], "inner").select("c_custkey", "c_name", "n_name", "r_name")


@query("""WITH {D}, a AS (SELECT day, price AS high FROM d WHERE corridor = '2-HIGH'),
b AS (SELECT day, price AS low FROM d WHERE corridor = '5-LOW') SELECT day, high, low FROM a FULL JOIN b USING (day)""")
def join_full_outer_panel(spark, sf):
    d = P.daily_panel(spark, sf)
    one = lambda k, n: d.where(c("corridor") == k).select("day", c("price").alias(n))
    return one("2-HIGH", "high").join(one("5-LOW", "low"), "day", "full_outer")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def semi(spark, sf):
    return P.table(spark, sf, "customer").join(P.table(spark, sf, "orders").select(c("o_custkey").alias("c_custkey")), "c_custkey", "left_semi").select("c_custkey")


@query("""WITH {D}, cal AS (SELECT corridor, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1) SELECT corridor, day
  FROM cal ANTI JOIN d USING (corridor, day) WHERE isodow(day) <= 5""")
def anti(spark, sf):
    """Weekdays without a row."""
    d = P.daily_panel(spark, sf)
    cal = d.groupBy("corridor").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).where(F.weekday("day") < 5)
    return cal.join(d, ["corridor", "day"], "left_anti")


@query("""WITH {D} SELECT a.corridor, a.day, count(*) AS later, min(b.price) AS best, CAST(min(CASE WHEN b.price <= a.price * 0.99 THEN b.day END) AS VARCHAR) AS reached FROM d a JOIN d b ON a.corridor = b.corridor AND b.day > a.day AND b.day <= a.day + 7 GROUP BY 1, 2""")
def theta_deadline(spark, sf):
    """Every day with the days up to its deadline, by RANGE frames instead of a join of rows with rows."""
    d = P.daily_panel(spark, sf).withColumn("k", F.unix_date("day"))
    w = Window.partitionBy("corridor").orderBy("k").rangeBetween(1, 7)
    seen = F.collect_list(F.struct("day", "price")).over(w)
    d = d.select("corridor", "day", "price", F.count("*").over(w).alias("later"), F.min("price").over(w).alias("best"), seen.alias("f")).where("later > 0")
    hit = F.filter("f", lambda x: x["price"] <= c("price") * 0.99)
    return d.select("corridor", "day", "later", "best", F.array_min(F.transform(hit, lambda x: x["day"])).cast("string").alias("reached"))


@query("""WITH {D}, m AS (SELECT corridor, date_trunc('month', day)::DATE AS month, min(day) AS published FROM d GROUP BY 1, 2)
SELECT m.corridor, m.month, count(*) AS rows_after, min_by(d.price, d.day) AS first_price, max_by(d.price, d.day) AS last_price FROM m
  JOIN d ON d.corridor = m.corridor AND d.day > m.published AND d.day <= last_day(m.published) GROUP BY 1, 2 HAVING count(*) >= 2""")
def event_window(spark, sf):
    """First and last price after a month's first day, up to its end."""
    d = P.daily_panel(spark, sf).withColumn("month", F.trunc("day", "month"))
    m = d.groupBy("corridor", "month").agg(F.min("day").alias("published"))
    j = d.join(m, ["corridor", "month"]).where("day > published")
    return j.groupBy("corridor", "month").agg(F.count("*").alias("rows_after"), F.min_by("price", "day").alias("first_price"), F.max_by("price", "day").alias("last_price")).where("rows_after >= 2")


@query("WITH {D} SELECT a.corridor, a.day, a.price, b.price AS placebo FROM d a JOIN d b ON a.corridor = b.corridor AND a.day = b.day + 364")
def placebo_lag(spark, sf):
    d = P.daily_panel(spark, sf).select("corridor", "day", "price")
    return d.join(d.select("corridor", F.date_add("day", 364).alias("day"), c("price").alias("placebo")), ["corridor", "day"])


@query("""WITH {H}, g AS (SELECT corridor, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h
  GROUP BY 1) SELECT corridor, hour, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (corridor, hour)""")
def grid_complete(spark, sf):
    h = P.hourly_panel(spark, sf)
    g = h.groupBy("corridor").agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    return g.join(h, ["corridor", "hour"], "left").select("corridor", "hour", F.coalesce("n", F.lit(0)).alias("n"))


@query("""WITH {D} SELECT a.corridor, a.day, round(avg(b.price), 4) AS peer_mean, min(b.price) AS peer_min, max(b.price) AS peer_max, round(stddev_pop(b.price), 6) AS peer_std, round(avg((b.price >= a.price)::INT), 6) AS share_above FROM d a JOIN d b ON a.day = b.day AND a.corridor <> b.corridor GROUP BY 1, 2""")
def leave_one_out_peers(spark, sf):
    """Statistics of the other corridors of the day: sums less one's own, the next extreme where one's own is the extreme, and a rank for the share above."""
    w, up, down = Window.partitionBy("day"), Window.partitionBy("day").orderBy("price"), Window.partitionBy("day").orderBy(c("price").desc())
    first, second = F.first("price").over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.nth_value("price", 2).over(up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    last, before = F.first("price").over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)), F.nth_value("price", 2).over(down.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    d = P.daily_panel(spark, sf).select(
        "corridor", "day", "price", (F.count("*").over(w) - 1).alias("n"), F.avg("price").over(w).alias("centre"), F.row_number().over(up).alias("i"), F.row_number().over(down).alias("j"),
        first.alias("first"), second.alias("second"), last.alias("last"), before.alias("before"), (F.count("*").over(down.rangeBetween(Window.unboundedPreceding, 0)) - 1).alias("above"),
    ).where("n > 0")
    # Deviations from the day's mean keep the sums of squares exact enough.
    dev = c("price") - c("centre")
    d = d.withColumns({"s": F.sum(dev).over(w) - dev, "q": F.sum(dev * dev).over(w) - dev * dev})
    mean = c("s") / c("n")
    std = F.when(c("n") == 1, 0.0).otherwise(F.sqrt(F.greatest(F.lit(0.0), c("q") / c("n") - mean * mean)))
    return d.select(
        "corridor", "day", r4(c("centre") + mean).alias("peer_mean"), F.when(c("i") == 1, c("second")).otherwise(c("first")).alias("peer_min"), F.when(c("j") == 1, c("before")).otherwise(c("last")).alias("peer_max"),
        F.round(std, 6).alias("peer_std"), F.round(c("above") / c("n"), 6).alias("share_above"),
    )


@query("""WITH q AS (SELECT DISTINCT quote_id, provider, available_at, bid_uzs_per_rub AS bid, ask_uzs_per_rub AS ask FROM bank_quotes
  WHERE bid_uzs_per_rub > 0 AND ask_uzs_per_rub > 0 AND available_at >= observed_at)
SELECT CAST(available_at AS DATE) AS day, count(*) AS quotes, round(median((bid + ask) / 2), 6) AS mid, round(median((ask / bid - 1) * 10000), 4) AS spread_bps, round(max(ask), 6) AS highest FROM q GROUP BY 1""")
def quote_medians(spark, sf):
    q = P.table(spark, sf, "bank_quotes").where("bid_uzs_per_rub > 0 and ask_uzs_per_rub > 0 and available_at >= observed_at").select("quote_id", "provider", "available_at", c("bid_uzs_per_rub").alias("bid"), c("ask_uzs_per_rub").alias("ask")).distinct()
    return q.groupBy(c("available_at").cast("date").alias("day")).agg(F.count("*").alias("quotes"), F.round(F.percentile((c("bid") + c("ask")) / 2, F.lit(0.5)), 6).alias("mid"), r4(F.percentile((c("ask") / c("bid") - 1) * 10_000, F.lit(0.5))).alias("spread_bps"), F.round(F.max("ask"), 6).alias("highest"))


_F5 = "f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"


@query(f"""WITH {{D}} SELECT corridor, day, round(greatest(0, (price - min(price) OVER f) / price) * 10000, 4) AS regret_bps, (price - min(price) OVER f) / price * 10000 <= 25 AS hit, round((avg(price) OVER f / price - 1) * 10000, 4) AS forward_bps FROM d WINDOW {_F5} QUALIFY count(*) OVER f = 5""")
def label_regret(spark, sf):
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", L.regret_paid(p, w, 5).alias("r"), L.benefit_forward(p, w, 5).alias("b")).where("r is not null")
    return d.select("corridor", "day", r4("r").alias("regret_bps"), (c("r") <= 25).alias("hit"), r4("b").alias("forward_bps"))


_DUAL = """WITH {D}, x AS (SELECT corridor, day, greatest(0, (price - min(price) OVER s) / price) * 10000 AS short, greatest(0, (price - min(price) OVER l) / price) * 10000 AS long, count(*) OVER l AS n FROM d
WINDOW s AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING),
l AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 20 FOLLOWING)) SELECT corridor, day, short <= %d AS short_hit, long <= %d AS long_hit, short <= %d AND long <= %d AS hit FROM x WHERE n = 20"""


def _dual(spark, sf, short, long):
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", (L.regret_paid(p, w, 3) <= short).alias("short_hit"), (L.regret_paid(p, w, 20) <= long).alias("long_hit")).where("long_hit is not null")
    return d.withColumn("hit", c("short_hit") & c("long_hit"))


@query(_DUAL % (0, 50, 0, 50))
def label_hybrid(spark, sf):
    """Strict in the short run, tolerant in the long."""
    return _dual(spark, sf, 0, 50)


@query(_DUAL % (10, 50, 10, 50))
def label_dual_regret(spark, sf):
    return _dual(spark, sf, 10, 50)


@query(f"""WITH {{D}} SELECT corridor, day, round(greatest(0, price / min(price) OVER f - 1) * 10000, 4) AS regret_bps, round((avg(price) OVER f / price - 1) * 10000, 4) AS benefit_bps FROM d WINDOW {_F5} QUALIFY count(*) OVER f = 5""")
def outcome_regret_benefit(spark, sf):
    p, w = c("price"), DAY()
    return P.daily_panel(spark, sf).select("corridor", "day", r4(L.regret_best(p, w, 5)).alias("regret_bps"), r4(L.benefit_forward(p, w, 5)).alias("benefit_bps")).where("regret_bps is not null")


_L = """WITH {D}, l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f FROM d),
s AS (SELECT *, """


@query(_L + """coalesce(list_position(list_transform(f, lambda x: (price / x - 1) * 10000 >= 2500), true), 0) AS lo, coalesce(list_position(list_transform(f, lambda x: (price / x - 1) * 10000 <= -5000), true), 0) AS hi FROM l WHERE len(f) = 5)
SELECT corridor, day, CASE WHEN lo > 0 AND (hi = 0 OR lo <= hi) THEN 0 ELSE 1 END AS label FROM s""")
def label_triple_barrier(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", L.triple_barrier(c("price"), DAY(), 5, F.lit(2500), F.lit(5000)).alias("label")).where("label is not null")


@query("""WITH {D}, r AS (SELECT *, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d),
v AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN round(stddev_samp(r) OVER w, 6) END AS vol, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f FROM r WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)),
b AS (SELECT *, least(greatest(vol * sqrt(5) * 10000 * 0.35, 15), 6000) AS better, least(greatest(vol * sqrt(5) * 10000 * 0.7, 30), 12000) AS worse FROM v
  WHERE vol IS NOT NULL AND len(f) = 5),
s AS (SELECT *, coalesce(list_position(list_transform(f, lambda x: (price / x - 1) * 10000 >= better), true), 0) AS lo, coalesce(list_position(list_transform(f, lambda x: (price / x - 1) * 10000 <= -worse), true), 0) AS hi FROM b)
SELECT corridor, day, CASE WHEN lo > 0 AND (hi = 0 OR lo <= hi) THEN 0 ELSE 1 END AS label FROM s""")
def label_vol_barrier(spark, sf):
    w = DAY()
    d = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), w))
    d = d.withColumn("vol", F.round(X.rolling(F.stddev_samp, c("r"), w, 20), 6))
    scaled = lambda share, lo, hi: F.least(F.greatest(c("vol") * F.sqrt(F.lit(5.0)) * 10_000 * share, F.lit(lo)), F.lit(hi))
    d = d.withColumn("better", scaled(0.35, 15.0, 6000.0)).withColumn("worse", scaled(0.7, 30.0, 12000.0))
    return d.select("corridor", "day", "vol", L.triple_barrier(c("price"), w, 5, c("better"), c("worse")).alias("label")).where("label is not null and vol is not null").select("corridor", "day", "label")


@query("""WITH {D}, l AS (SELECT corridor, day, list_transform(list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN CURRENT ROW AND 9 FOLLOWING), lambda x: ln(x)) AS v FROM d),
e AS (SELECT corridor, day, unnest(v) AS y, unnest(generate_series(0, 9)) AS i FROM l WHERE len(v) = 10),
s AS (SELECT corridor, day, regr_slope(y, i) AS b, regr_sxx(y, i) AS sxx, regr_syy(y, i) AS syy FROM e GROUP BY 1, 2)
SELECT corridor, day, round(b / sqrt((syy - b * b * sxx) / 8 / sxx), 4) AS t FROM s""")
def label_trend_scan(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r4(L.trend_t(c("price"), DAY(), 10)).alias("t")).where("t is not null")


@query(_L + """list_position(list_transform(f, lambda x: (price / x - 1) * 10000 > 25), true) AS step FROM l)
SELECT corridor, day, CASE WHEN f IS NULL OR len(f) < 5 THEN 0 WHEN coalesce(step, 0) > 0 THEN step ELSE 6 END AS step FROM s""")
def first_improvement(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", L.first_improvement(c("price"), DAY(), 5, 25).alias("step"))


@query("""WITH {D} SELECT corridor, day, round(((sum(price) OVER f + sum(price) OVER p) / 10 / price - 1) * 10000, 4) AS benefit_bps FROM d
  WINDOW f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING),
p AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) QUALIFY count(*) OVER f = 5 AND count(*) OVER p = 5""")
def symmetric_benefit(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r4(L.benefit_symmetric(c("price"), DAY(), 5)).alias("benefit_bps")).where("benefit_bps is not null")


_POLICY = """WITH RECURSIVE {D}, c AS (SELECT corridor, day, row_number() OVER (PARTITION BY corridor ORDER BY day) AS rn, date_trunc('week', day) AS wk
  FROM (SELECT *, quantile_cont(price, 0.4) OVER (PARTITION BY corridor) AS q FROM d) WHERE price <= q),
t AS (SELECT corridor, rn, day, wk, day AS last, wk AS lastwk, 1 AS cnt, true AS kept FROM c WHERE rn = 1
UNION ALL SELECT c.corridor, c.rn, c.day, c.wk, CASE WHEN k THEN c.day ELSE last END, CASE WHEN k THEN c.wk ELSE lastwk END, CASE WHEN k THEN CASE WHEN c.wk = lastwk THEN cnt + 1 ELSE 1 END ELSE cnt END, k
FROM (SELECT t.corridor AS tc, t.rn AS trn, t.last, t.lastwk, t.cnt, c.*, (CASE WHEN c.wk = t.lastwk THEN t.cnt ELSE 0 END < %d AND c.day - t.last >= %d) AS k
  FROM t JOIN c ON c.corridor = t.corridor AND c.rn = t.rn + 1) c)
SELECT corridor, day FROM t WHERE kept"""


def _cheap(spark, sf):
    d = P.daily_panel(spark, sf)
    q = d.groupBy("corridor").agg(F.percentile("price", F.lit(0.4)).alias("q"))
    return d.join(q, "corridor").where("price <= q").select("corridor", "day")


@query(_POLICY % (2, 3))
def policy_cooldown_cap(spark, sf):
    return Q.cap_and_cooldown(_cheap(spark, sf), key="corridor", at="day", cooldown=3, cap=2)


@query(_POLICY % (1000, 7))
def deoverlap(spark, sf):
    return Q.cap_and_cooldown(_cheap(spark, sf), key="corridor", at="day", cooldown=7, cap=None)


@query("""WITH RECURSIVE {H}, c AS (SELECT corridor, hour, row_number() OVER (PARTITION BY corridor ORDER BY hour) AS rn, date_trunc('week', hour) AS wk FROM h WHERE n >= 3),
t AS (SELECT corridor, rn, hour, wk, hour AS last, wk AS lastwk, 1 AS cnt, true AS kept FROM c WHERE rn = 1
UNION ALL SELECT c.corridor, c.rn, c.hour, c.wk, CASE WHEN k THEN c.hour ELSE last END, CASE WHEN k THEN c.wk ELSE lastwk END, CASE WHEN k THEN CASE WHEN c.wk = lastwk THEN cnt + 1 ELSE 1 END ELSE cnt END, k
FROM (SELECT t.last, t.lastwk, t.cnt, c.*, (CASE WHEN c.wk = t.lastwk THEN t.cnt ELSE 0 END < 3 AND c.hour - t.last >= INTERVAL 24 HOUR) AS k FROM t
  JOIN c ON c.corridor = t.corridor AND c.rn = t.rn + 1) c) SELECT corridor, hour FROM t WHERE kept""")
def policy_hourly(spark, sf):
    return Q.cap_and_cooldown(P.hourly_panel(spark, sf).where("n >= 3"), key="corridor", at="hour", cooldown=24, cap=3, unit="hour")


@query("""WITH {D} SELECT corridor, day FROM d WHERE n >= 2 QUALIFY row_number() OVER (PARTITION BY corridor, date_trunc('week', day) ORDER BY day) <= 2""")
def weekly_first_n(spark, sf):
    return Q.first_per_week(P.daily_panel(spark, sf).where("n >= 2").select("corridor", "day"), key="corridor", at="day", n=2)


@query("""WITH RECURSIVE {D}, r AS (SELECT corridor, day, round(ln(price) - lag(ln(price)) OVER w, 9) AS x, row_number() OVER w AS rn FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day)),
s AS (SELECT *, CASE WHEN count(x) OVER w >= 20 THEN round(stddev_samp(x) OVER w, 9) END AS s FROM r WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING)),
t AS (SELECT corridor, rn, day, 0.0::DOUBLE AS up, 0.0::DOUBLE AS down, false AS fired FROM s WHERE rn = 1
UNION ALL SELECT corridor, rn, day, CASE WHEN f THEN 0 WHEN ok THEN u2 ELSE up END, CASE WHEN f THEN 0 WHEN ok THEN d2 ELSE down END, f
  FROM (SELECT *, coalesce(ok AND (u2 >= 3.0 * s OR d2 <= -3.0 * s), false) AS f
  FROM (SELECT s.corridor, s.rn, s.day, s.s, t.up, t.down, coalesce(s.s > 0 AND s.x IS NOT NULL, false) AS ok, greatest(0, t.up + s.x) AS u2, least(0, t.down + s.x) AS d2 FROM t JOIN s ON s.corridor = t.corridor AND s.rn = t.rn + 1)))
SELECT corridor, day, fired FROM t""")
def cusum(spark, sf):
    w = DAY()
    d = P.daily_panel(spark, sf).withColumn("x", F.round(F.log("price") - F.lag(F.log("price")).over(w), 9))
    d = d.withColumn("s", F.round(X.rolling(F.stddev_samp, c("x"), w, 60, 20), 9))
    return Q.cusum(d, key="corridor", at="day", change="x", sigma="s", multiple=3.0)


@query("""WITH {D}, p AS (SELECT corridor, day, price, lag(price) OVER w AS a, avg(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING) AS b FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
l AS (SELECT *, abs(price - a) / price AS la, abs(price - b) / price AS lb FROM p WHERE a IS NOT NULL),
s AS (SELECT *, -0.5 * coalesce(sum(la) OVER w, 0) AS ga, -0.5 * coalesce(sum(lb) OVER w, 0) AS gb FROM l
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING))
SELECT corridor, day, round((a * exp(ga - greatest(ga, gb)) + b * exp(gb - greatest(ga, gb))) / (exp(ga - greatest(ga, gb)) + exp(gb - greatest(ga, gb))), 4) AS blended FROM s""")
def dynamic_average(spark, sf):
    w = DAY()
    d = P.daily_panel(spark, sf).withColumn("a", F.lag("price").over(w)).withColumn("b", F.avg("price").over(X.trailing(w, 20, 1))).where("a is not null")
    loss = lambda x: F.abs(c("price") - c(x)) / c("price")
    d = d.withColumn("la", loss("a")).withColumn("lb", loss("b"))
    wa, wb = Q.delayed_weights([c("la"), c("lb")], w, 5, 0.5)
    return d.select("corridor", "day", r4(c("a") * wa + c("b") * wb).alias("blended"))


@query("""WITH {D}, x AS (SELECT corridor, day, price, ((price - min(price) OVER f) / price) * 10000 <= 300 AS target, count(*) OVER f AS nf, row_number() OVER (PARTITION BY corridor ORDER BY day) AS rn FROM d WINDOW f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 3 FOLLOWING)),
k AS (SELECT a.corridor, a.day, count(*) AS n, sum((NOT b.target AND b.price <= a.price)::INT) AS lower_miss, sum((b.target AND b.price >= a.price)::INT) AS higher_hit FROM x a JOIN x b ON a.corridor = b.corridor AND b.rn <= a.rn - 3 AND b.rn >= a.rn - 102 AND b.nf = 3 GROUP BY 1, 2)
SELECT corridor, day, round((1 + higher_hit) / (n + 1), 6) AS p_hit, round((1 + lower_miss) / (n + 1), 6) AS p_miss FROM k WHERE n >= 60""")
def conformal(spark, sf):
    """Conformal p-values of each day against the outcomes that had matured by then."""
    w = DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", "price", (L.regret_paid(c("price"), w, 3) <= 300).alias("target"))
    past = w.rowsBetween(-102, -3)
    d = d.withColumn("h", F.collect_list(F.when(c("target").isNotNull(), F.struct("price", "target"))).over(past)).withColumn("n", F.size("h")).where("n >= 60")
    share = lambda cond: F.round((1 + F.size(F.filter("h", cond))) / (c("n") + 1), 6)
    return d.select("corridor", "day", share(lambda x: x["target"] & (x["price"] >= c("price"))).alias("p_hit"), share(lambda x: ~x["target"] & (x["price"] <= c("price"))).alias("p_miss"))

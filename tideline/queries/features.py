"""Panels and causal window features over the daily and hourly panels."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators.expanding import expanding_quantiles
from tideline.queries.registry import query

c = lambda name: F.col(name)
r6 = lambda x: F.round(x, 6)
DAY = lambda: X.series("corridor", "day")
HOUR = lambda: X.series("corridor", "hour")


@query("WITH {D} SELECT * FROM d")
def panel_daily(spark, sf):
    return P.daily_panel(spark, sf)


@query("WITH {H} SELECT * FROM h")
def panel_hourly(spark, sf):
    return P.hourly_panel(spark, sf)


@query("WITH {D} SELECT corridor, day, CASE isodow(day) WHEN 1 THEN day - 3 WHEN 7 THEN day - 2 ELSE day - 1 END + INTERVAL '15 hours 30 minutes' AS known_at FROM d")
def known_at_business_day(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", (P.previous_business_day(c("day")).cast("timestamp_ntz") + F.expr("INTERVAL '15:30' HOUR TO MINUTE")).alias("known_at"))


@query("WITH {D} SELECT corridor, max(day) AS last_day, count(*) AS days, round(max_by(price, day), 6) AS last_price FROM d WHERE day <= DATE '1997-06-30' GROUP BY 1")
def asof_cut(spark, sf):
    return P.as_of(P.daily_panel(spark, sf), "day", F.lit("1997-06-30").cast("date")).groupBy("corridor").agg(F.max("day").alias("last_day"), F.count("*").alias("days"), r6(F.max_by("price", "day")).alias("last_price"))


@query("WITH {D} SELECT corridor, max(day) AS last_known, DATE '2001-08-05' - max(day) AS age_days, DATE '2001-08-05' - max(day) > 7 AS stale FROM d WHERE day <= DATE '2001-08-05' GROUP BY 1")
def staleness_guard(spark, sf):
    return P.stale(P.daily_panel(spark, sf), "corridor", "day", F.lit("2001-08-05").cast("date"), 7)


@query("""SELECT secid, dt_msk, round(CASE WHEN normalization = 'raw' THEN close WHEN normalization = 'divide_by_facevalue' AND expected_facevalue > 0 THEN close / expected_facevalue END, 6) AS unit_price
FROM (SELECT DISTINCT secid, dt_msk, close FROM moex_candles WHERE close > 0) JOIN moex_universe USING (secid)""")
def unit_prices(spark, sf):
    candles = P.table(spark, sf, "moex_candles").where("close > 0").select("secid", "dt_msk", "close").distinct()
    units = P.table(spark, sf, "moex_universe").select("secid", "normalization", "expected_facevalue")
    return candles.join(units, "secid").select("secid", "dt_msk", r6(P.normalise_price(c("close"), c("normalization"), c("expected_facevalue"))).alias("unit_price"))


@query("""WITH {D} SELECT corridor, day, round(price / lag(price) OVER w - 1, 6) AS r1, round(price / lag(price, 3) OVER w - 1, 6) AS r3, round(price / lag(price, 5) OVER w - 1, 6) AS r5, round(ln(1 + n) - lag(ln(1 + n)) OVER w, 6) AS log_activity_change
FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)""")
def returns_bank(spark, sf):
    d = P.daily_panel(spark, sf)
    log = F.log1p(c("n"))
    return d.select("corridor", "day", *[r6(X.change(c("price"), DAY(), k)).alias(f"r{k}") for k in (1, 3, 5)], r6(log - F.lag(log).over(DAY())).alias("log_activity_change"))


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d)
SELECT corridor, day, CASE WHEN count(r) OVER w20 >= 20 THEN round(stddev_samp(r) OVER w20, 6) END AS vol20, CASE WHEN count(r) OVER w60 >= 12 THEN round(stddev_samp(r) OVER w60, 6) END AS vol60
FROM r WINDOW w20 AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING),
w60 AS (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING)""")
def rolling_vol(spark, sf):
    r = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY()))
    return r.select("corridor", "day", r6(X.rolling(F.stddev_samp, c("r"), DAY(), 20)).alias("vol20"), r6(X.rolling(F.stddev_samp, c("r"), DAY(), 60, 12)).alias("vol60"))


@query("""WITH {D} SELECT corridor, day, CASE WHEN count(price) OVER w >= 20 THEN round((price - avg(price) OVER w) / nullif(stddev_samp(price) OVER w, 0), 6) END AS z20
FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)""")
def rolling_zscore(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r6(X.zscore(c("price"), DAY(), 20)).alias("z20"))


@query("""WITH {D} SELECT corridor, day, CASE WHEN count(price) OVER w >= 60 THEN round(price / min(price) OVER w - 1, 6) END AS over_low, CASE WHEN count(price) OVER w >= 60 THEN round(price / max(price) OVER w - 1, 6) END AS under_high, price = min(price) OVER v AS local_dip
FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING),
v AS (PARTITION BY corridor ORDER BY day ROWS 6 PRECEDING)""")
def distance_minmax(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r6(X.distance_to(F.min, c("price"), DAY(), 60)).alias("over_low"), r6(X.distance_to(F.max, c("price"), DAY(), 60)).alias("under_high"), (c("price") == F.min("price").over(X.trailing(DAY(), 7))).alias("local_dip"))


@query("""WITH {H} SELECT corridor, hour, CASE WHEN count(n) OVER w >= 6 THEN round((n - avg(n) OVER w) / nullif(stddev_samp(n) OVER w, 0), 6) END AS past_z24
FROM h WINDOW w AS (PARTITION BY corridor ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def past_zscore(spark, sf):
    return P.hourly_panel(spark, sf).select("corridor", "hour", r6(X.zscore(c("n"), HOUR(), 24, 6, lag=1)).alias("past_z24"))


@query("""WITH {H} SELECT corridor, hour, CASE WHEN count(n) OVER w >= 24 THEN round((n + 1) / (quantile_cont(n, 0.5) OVER w + 1), 6) END AS past_ratio
FROM h WINDOW w AS (PARTITION BY corridor ORDER BY hour ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)""")
def past_ratio_median(spark, sf):
    return P.hourly_panel(spark, sf).select("corridor", "hour", r6((c("n") + 1) / (X.trailing_quantile(c("n"), HOUR(), 24, 0.5, 24) + 1)).alias("past_ratio"))


_RANK = """WITH {D}, l AS (SELECT corridor, day, price, list(price) OVER w AS v FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS %s))
SELECT corridor, day, CASE WHEN len(v) >= %d THEN round(%s / len(v), 6) END AS %s FROM l"""


@query(_RANK % ("59 PRECEDING", 60, "(len(list_filter(v, lambda x: x < price)) + (len(list_filter(v, lambda x: x = price)) + 1) / 2)", "rank_average"))
def pct_rank_avg(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r6(X.rank_average(c("price"), DAY(), 60)).alias("rank_average"))


@query(_RANK % ("59 PRECEDING", 60, "len(list_filter(v, lambda x: x <= price))", "rank_max"))
def pct_rank_max(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r6(X.rank_max(c("price"), DAY(), 60)).alias("rank_max"))


@query(_RANK % ("BETWEEN 60 PRECEDING AND 1 PRECEDING", 20, "len(list_filter(v, lambda x: x <= price))", "causal_rank"))
def causal_percentile(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", r6(X.causal_percentile(c("price"), DAY(), 60, 20)).alias("causal_rank"))


@query("""WITH {D}, q AS (SELECT corridor, day, price, n, CASE WHEN count(price) OVER w >= 20 THEN quantile_cont(price, 0.6) OVER w END AS threshold FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING))
SELECT corridor, day, round(threshold, 4) AS threshold FROM q WHERE price >= threshold""")
def trailing_quantile_candidates(spark, sf):
    q = P.daily_panel(spark, sf).withColumn("threshold", X.trailing_quantile(c("price"), DAY(), 60, 0.6, 20))
    return q.where("price >= threshold").select("corridor", "day", F.round("threshold", 4).alias("threshold"))


@query("""WITH {D}, q AS (SELECT corridor, day, price, CASE WHEN count(price) OVER w >= 40 THEN quantile_cont(price, 1/3.0) OVER w END AS lo, CASE WHEN count(price) OVER w >= 40 THEN quantile_cont(price, 2/3.0) OVER w END AS hi FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT corridor, day, CASE WHEN lo IS NULL THEN NULL WHEN price <= lo THEN 'low' WHEN price <= hi THEN 'mid' ELSE 'high' END AS tercile FROM q""")
def expanding_terciles(spark, sf):
    d = expanding_quantiles(P.daily_panel(spark, sf), key="corridor", at="day", value="price", quantiles={"lo": 1 / 3, "hi": 2 / 3}, least=40)
    return d.select("corridor", "day", F.when(c("lo").isNotNull(), F.when(c("price") <= c("lo"), "low").when(c("price") <= c("hi"), "mid").otherwise("high")).alias("tercile"))


@query("""WITH {D}, m AS (SELECT *, avg(price) OVER (PARTITION BY day) AS market FROM d),
r AS (SELECT corridor, day, price / lag(price) OVER w - 1 AS y, market / lag(market) OVER w - 1 AS x FROM m WINDOW w AS (PARTITION BY corridor ORDER BY day)),
b AS (SELECT *, CASE WHEN regr_count(y, x) OVER v >= 60 THEN covar_samp(y, x) OVER v / nullif(var_samp(x) OVER v, 0) END AS beta FROM r
  WINDOW v AS (PARTITION BY corridor ORDER BY day ROWS 119 PRECEDING))
SELECT corridor, day, round(lag(beta) OVER w, 5) AS past_beta, round(y - lag(beta) OVER w * x, 5) AS residual FROM b WINDOW w AS (PARTITION BY corridor ORDER BY day)""")
def rolling_beta_residual(spark, sf):
    m = P.daily_panel(spark, sf).withColumn("market", F.avg("price").over(Window.partitionBy("day")))
    r = m.select("corridor", "day", X.change(c("price"), DAY()).alias("y"), X.change(c("market"), DAY()).alias("x"))
    b = r.withColumn("beta", X.beta(c("y"), c("x"), DAY(), 120, 60)).withColumn("past", F.lag("beta").over(DAY()))
    return b.select("corridor", "day", F.round("past", 5).alias("past_beta"), F.round(c("y") - c("past") * c("x"), 5).alias("residual"))


@query("""WITH {D}, k AS (SELECT corridor, day, CASE WHEN count(*) OVER w >= 12 THEN covar_samp(price, n) OVER w / nullif((stddev_samp(price) OVER w) * (stddev_samp(n) OVER w), 0) END AS k FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING))
SELECT corridor, day, CASE WHEN count(k) OVER v >= 40 THEN round(abs(k - avg(k) OVER v), 5) END AS corr_break FROM k
  WINDOW v AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)""")
def rolling_corr_break(spark, sf):
    frame = X.trailing(DAY(), 20)
    spread = F.nullif(F.stddev_samp("price").over(frame) * F.stddev_samp("n").over(frame), F.lit(0.0))
    k = P.daily_panel(spark, sf).withColumn("k", F.when(F.count("*").over(frame) >= 12, F.try_divide(F.covar_samp("price", "n").over(frame), spread)))
    return k.select("corridor", "day", F.round(F.abs(c("k") - X.rolling(F.avg, c("k"), DAY(), 120, 40, lag=1)), 5).alias("corr_break"))


@query("""WITH {D} SELECT corridor, day, round(avg(price) OVER (PARTITION BY corridor, quarter(day) ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 4) AS season_mean FROM d""")
def expanding_seasonal_mean(spark, sf):
    w = Window.partitionBy("corridor", F.quarter("day")).orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    return P.daily_panel(spark, sf).select("corridor", "day", F.round(F.avg("price").over(w), 4).alias("season_mean"))


@query("""WITH {D}, s AS (SELECT corridor, day, coalesce(price < lag(price) OVER w, false) AS down FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
t AS (SELECT corridor, day, sum(down::int) OVER (PARTITION BY corridor ORDER BY day ROWS 2 PRECEDING) = 3 AS streak FROM s)
SELECT corridor, day, streak, streak AND NOT coalesce(lag(streak) OVER (PARTITION BY corridor ORDER BY day), false) AS onset FROM t""")
def streak_onset(spark, sf):
    s = P.daily_panel(spark, sf).withColumn("down", c("price") < F.lag("price").over(DAY())).withColumn("streak", X.streak(c("down"), DAY(), 3))
    return s.select("corridor", "day", "streak", X.onset(c("streak"), DAY()).alias("onset"))


@query("""WITH {D}, m AS (SELECT corridor, day, CASE WHEN count(*) OVER a >= 5 THEN avg(price) OVER a END AS fast, CASE WHEN count(*) OVER b >= 20 THEN avg(price) OVER b END AS slow FROM d WINDOW a AS (PARTITION BY corridor ORDER BY day ROWS 4 PRECEDING),
b AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)),
s AS (SELECT corridor, day, coalesce(round(fast, 3) > round(slow, 3), false) AS up FROM m)
SELECT corridor, day FROM (SELECT *, coalesce(lag(up) OVER (PARTITION BY corridor ORDER BY day), false) AS was FROM s) WHERE up AND NOT was""")
def ma_cross(spark, sf):
    mean = lambda n: F.round(X.rolling(F.avg, c("price"), DAY(), n), 3)
    s = P.daily_panel(spark, sf).withColumn("up", F.coalesce(mean(5) > mean(20), F.lit(False)))
    return s.withColumn("cross", X.onset(c("up"), DAY())).where("cross").select("corridor", "day")


@query("""WITH {D}, cal AS (SELECT corridor, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1),
j AS (SELECT cal.*, price FROM cal LEFT JOIN d USING (corridor, day))
SELECT corridor, day, round(coalesce(price, last_value(price IGNORE NULLS) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 3 PRECEDING AND CURRENT ROW)), 6) AS filled FROM j""")
def ffill_limit3(spark, sf):
    d = P.daily_panel(spark, sf)
    cal = d.groupBy("corridor").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day"))
    return cal.join(d, ["corridor", "day"], "left").select("corridor", "day", r6(X.fill_forward(c("price"), DAY(), 3)).alias("filled"))


@query("""WITH {D}, e AS (SELECT corridor, day, CASE WHEN abs(price / lag(price) OVER w - 1) > 0.2 THEN day END AS event FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day))
SELECT corridor, day, day - max(event) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS days_since FROM e""")
def days_since_event(spark, sf):
    e = P.daily_panel(spark, sf).withColumn("event", F.when(F.abs(X.change(c("price"), DAY())) > 0.2, c("day")))
    return e.select("corridor", "day", F.date_diff("day", F.max("event").over(DAY().rowsBetween(Window.unboundedPreceding, -1))).alias("days_since"))


@query("WITH {D} SELECT corridor, day, lag(price, 1) OVER w AS lag1, lag(price, 2) OVER w AS lag2, lag(price, 5) OVER w AS lag5, lag(price, 10) OVER w AS lag10 FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)")
def lag_bank(spark, sf):
    return P.daily_panel(spark, sf).select("corridor", "day", *[F.lag("price", k).over(DAY()).alias(f"lag{k}") for k in (1, 2, 5, 10)])


@query("""WITH {D}, r AS (SELECT corridor, day, price - lag(price) OVER w AS m FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
l AS (SELECT corridor, day, list(m) FILTER (m IS NOT NULL) OVER (PARTITION BY corridor ORDER BY day ROWS 9 PRECEDING) AS v FROM r)
SELECT corridor, day, round(len(list_filter(v, lambda x: x > 0)) / len(v), 6) AS positive_share, CASE WHEN len(v) > 0 THEN len(list_filter(generate_series(2, len(v)), lambda i: sign(v[i]) <> sign(v[i - 1]))) END AS sign_changes, round(list_max(list_transform(v, lambda x: abs(x))), 4) AS largest_move FROM l WHERE len(v) > 0""")
def path_summary(spark, sf):
    r = P.daily_panel(spark, sf).withColumn("m", c("price") - F.lag("price").over(DAY()))
    v = r.select("corridor", "day", F.collect_list("m").over(X.trailing(DAY(), 10)).alias("v")).where(F.size("v") > 0)
    signs = F.transform("v", F.signum)
    changes = F.size(F.filter(F.zip_with(F.slice(signs, 2, 10), F.slice(signs, 1, F.size("v") - 1), lambda a, b: a != b), lambda x: x))
    return v.select("corridor", "day", r6(F.size(F.filter("v", lambda x: x > 0)) / F.size("v")).alias("positive_share"), changes.alias("sign_changes"), F.round(F.array_max(F.transform("v", F.abs)), 4).alias("largest_move"))


@query("""WITH {H}, x AS (SELECT *, CAST(hour AS DATE) AS day, ln(price) - lag(ln(price)) OVER (PARTITION BY corridor, CAST(hour AS DATE) ORDER BY hour) AS r FROM h
  WHERE price > 0),
s AS (SELECT corridor, day, count(*) AS observations, sqrt(sum(r * r)) AS rv, sum(CASE WHEN r < 0 THEN r * r END) / nullif(sum(r * r), 0) AS downside, max(abs(r)) / nullif(sum(abs(r)), 0) AS largest, abs(sum(r)) / nullif(sum(abs(r)), 0) AS efficiency, max(price) / min(price) - 1 AS range, max_by(price, hour) AS last FROM x GROUP BY 1, 2)
SELECT corridor, day, lag(observations) OVER w AS observations, round(lag(rv) OVER w, 6) AS rv, round(lag(downside) OVER w, 6) AS downside_share, round(lag(largest) OVER w, 6) AS largest_share, round(lag(efficiency) OVER w, 6) AS efficiency, round(lag(range) OVER w, 6) AS range FROM s WINDOW w AS (PARTITION BY corridor ORDER BY day)""")
def session_path_stats(spark, sf):
    x = P.hourly_panel(spark, sf).where("price > 0").withColumn("day", c("hour").cast("date"))
    log = F.log("price")
    x = x.withColumn("r", log - F.lag(log).over(Window.partitionBy("corridor", "day").orderBy("hour")))
    total, size = F.sum(c("r") * c("r")), F.nullif(F.sum(F.abs("r")), F.lit(0.0))
    s = x.groupBy("corridor", "day").agg(
        F.count("*").alias("observations"), F.sqrt(total).alias("rv"), (F.sum(F.when(c("r") < 0, c("r") * c("r"))) / F.nullif(total, F.lit(0.0))).alias("downside_share"),
        (F.max(F.abs("r")) / size).alias("largest_share"), (F.abs(F.sum("r")) / size).alias("efficiency"), (F.max("price") / F.min("price") - 1).alias("range"),
    )
    return s.select("corridor", "day", F.lag("observations").over(DAY()).alias("observations"), *[r6(F.lag(k).over(DAY())).alias(k) for k in ("rv", "downside_share", "largest_share", "efficiency", "range")])


@query("""WITH {D} SELECT DISTINCT day, isodow(day) - 1 AS weekday, round(sin(2 * pi() * dayofmonth(day) / dayofmonth(last_day(day))), 6) AS month_sin, round(cos(2 * pi() * dayofmonth(day) / dayofmonth(last_day(day))), 6) AS month_cos, round((last_day(day) - day) / 31.0, 6) AS to_month_end,
  dayofmonth(day) <= 5 AS first_five, last_day(day) - day < 5 AS last_five, dayofmonth(day) BETWEEN 25 AND 28 AS tax_days, month(day) % 3 = 0 AND last_day(day) - day < 10 AS quarter_end FROM d""")
def calendar_bank(spark, sf):
    d = P.daily_panel(spark, sf).select("day").distinct()
    angle = F.lit(2) * F.pi() * F.dayofmonth("day") / F.dayofmonth(F.last_day("day"))
    left = F.date_diff(F.last_day("day"), "day")
    return d.select("day", F.weekday("day").alias("weekday"), r6(F.sin(angle)).alias("month_sin"), r6(F.cos(angle)).alias("month_cos"), r6(left / 31).alias("to_month_end"), (F.dayofmonth("day") <= 5).alias("first_five"), (left < 5).alias("last_five"), F.dayofmonth("day").between(25, 28).alias("tax_days"), ((F.month("day") % 3 == 0) & (left < 10)).alias("quarter_end"))


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER w - 1 AS r FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
l AS (SELECT corridor, r, lag(r) OVER (PARTITION BY corridor ORDER BY day) AS p FROM r)
SELECT corridor, round(corr(r, p), 6) AS autocorrelation, round(covar_samp(r, p), 8) AS covariance, round(regr_slope(r, p), 6) AS slope, round(regr_intercept(r, p), 6) AS intercept, count(p) AS pairs FROM l GROUP BY 1""")
def lead_lag_corr(spark, sf):
    r = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY())).withColumn("p", F.lag("r").over(DAY()))
    return r.groupBy("corridor").agg(r6(F.corr("r", "p")).alias("autocorrelation"), F.round(F.covar_samp("r", "p"), 8).alias("covariance"), r6(F.regr_slope("r", "p")).alias("slope"), r6(F.regr_intercept("r", "p")).alias("intercept"), F.count("p").alias("pairs"))


@query("""WITH {D}, m AS (SELECT corridor, day, price, product(price / lagged) OVER (PARTITION BY corridor ORDER BY day ROWS 2 PRECEDING) - 1 AS compounded
  FROM (SELECT *, lag(price) OVER (PARTITION BY corridor ORDER BY day) AS lagged FROM d))
SELECT corridor, day, round(compounded, 6) AS compounded FROM m""")
def rolling_product(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("g", c("price") / F.lag("price").over(DAY()))
    return d.select("corridor", "day", r6(F.product("g").over(X.trailing(DAY(), 3)) - 1).alias("compounded"))


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER w - 1 AS r FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
v AS (SELECT *, CASE WHEN count(r) OVER w >= 20 THEN stddev_samp(r) OVER w END AS vol, CASE WHEN count(r) OVER w >= 20 THEN avg(r) OVER w END AS drift FROM r
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)),
q AS (SELECT *, CASE WHEN count(vol) OVER w >= 60 THEN quantile_cont(vol, 0.2) OVER w END AS lo, CASE WHEN count(vol) OVER w >= 60 THEN quantile_cont(vol, 0.8) OVER w END AS hi FROM v WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT corridor, day, CASE WHEN lo IS NULL OR vol IS NULL THEN NULL WHEN abs(r) > 3 * vol THEN 'SHOCK' WHEN vol > hi THEN 'HIGH_VOL' WHEN drift < -0.5 * vol / sqrt(20) THEN 'TREND_DOWN' WHEN drift > 0.5 * vol / sqrt(20) THEN 'TREND_UP' WHEN vol < lo THEN 'LOW_VOL' ELSE 'NORMAL' END AS regime FROM q""")
def regime_label(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY()))
    d = d.select("corridor", "day", "r", X.rolling(F.stddev_samp, c("r"), DAY(), 20).alias("vol"), X.rolling(F.avg, c("r"), DAY(), 20).alias("drift"))
    q = expanding_quantiles(d, key="corridor", at="day", value="vol", quantiles={"lo": 0.2, "hi": 0.8}, least=60)
    d = d.join(q.select("corridor", "day", "lo", "hi"), ["corridor", "day"])
    known = c("lo").isNotNull() & c("vol").isNotNull()
    half = 0.5 * c("vol") / F.sqrt(F.lit(20.0))
    label = F.when(F.abs("r") > 3 * c("vol"), "SHOCK").when(c("vol") > c("hi"), "HIGH_VOL").when(c("drift") < -half, "TREND_DOWN").when(c("drift") > half, "TREND_UP").when(c("vol") < c("lo"), "LOW_VOL").otherwise("NORMAL")
    return d.select("corridor", "day", F.when(known, label).alias("regime"))

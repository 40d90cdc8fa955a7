"""Feature banks: hypothesis signals, corridor, instrument, monthly, timeline and rate features, each in one pass over its windows."""

from __future__ import annotations

import math

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators.asof import asof_join
from tideline.queries.registry import query

c = lambda name: F.col(name)
r4 = lambda x: F.round(x, 4)
r6 = lambda x: F.round(x, 6)
DAY = lambda: X.series("corridor", "day")


def _unit(x):
    return r4(F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0)))


@query("""WITH {D}, r AS (SELECT *, price / lag(price) OVER w - 1 AS r FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
f AS (SELECT *, lag(r) OVER w AS r1, lag(r, 2) OVER w AS r2, price / lag(price, 3) OVER w - 1 AS fall,
  CASE WHEN count(price) OVER p90 = 90 THEN min(price) OVER p90 END AS low,
  CASE WHEN count(price) OVER p20 = 20 THEN max(price) OVER p20 END AS high,
  CASE WHEN count(price) OVER p20 = 20 THEN avg(price) OVER p20 END AS mean,
  CASE WHEN count(price) OVER p20 = 20 THEN stddev_samp(price) OVER p20 END AS sd,
  CASE WHEN count(r) OVER p20 = 20 THEN stddev_samp(r) OVER p20 END AS sigma,
  CASE WHEN count(r) OVER t20 = 20 THEN stddev_samp(r) OVER t20 END AS vol,
  CASE WHEN count(price) OVER t90 = 90 THEN quantile_cont(price, 0.1) OVER t90 END AS decile
  FROM r WINDOW w AS (PARTITION BY corridor ORDER BY day),
p90 AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING),
  p20 AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 20 PRECEDING AND 1 PRECEDING),
  t20 AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING),
t90 AS (PARTITION BY corridor ORDER BY day ROWS 89 PRECEDING)),
g AS (SELECT *, CASE WHEN count(vol) OVER y >= 126 THEN quantile_cont(vol, 2/3.0) OVER y END AS calm, CASE WHEN count(vol) OVER y >= 126 THEN quantile_cont(vol, 1/3.0) OVER y END AS quiet,
  low < price AND price / low - 1 >= 0.5 * sigma AND r >= 0 AND r1 >= 0 AS turned FROM f
  WINDOW y AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 252 PRECEDING AND 1 PRECEDING)),
h AS (SELECT corridor, day, 'H1' AS hypothesis, (price / low - 1) / sigma AS v FROM g WHERE turned
UNION ALL SELECT corridor, day, 'H2', (decile / price - 1) / sigma FROM g WHERE price <= decile AND r2 < r1 AND r1 < r AND r <= 0
UNION ALL SELECT corridor, day, 'H3', (price / low - 1) / sigma FROM g WHERE turned AND vol <= calm
UNION ALL SELECT corridor, day, 'H6', -r / sigma FROM g WHERE r <= -2 * sigma
UNION ALL SELECT corridor, day, 'H7', -fall / sigma FROM g WHERE fall <= -2 * sigma * sqrt(3) AND r >= 0
UNION ALL SELECT corridor, day, 'H8', (decile / price - 1) / sigma FROM g WHERE price <= decile AND vol <= quiet
UNION ALL SELECT corridor, day, 'H9', (price / high - 1) / sigma FROM g WHERE price > high AND r >= 0.5 * sigma
UNION ALL SELECT corridor, day, 'H10', (mean - price) / sd FROM g WHERE price <= mean - 2 * sd)
SELECT corridor, day, hypothesis, round(least(greatest(v, 0), 1), 4) AS strength FROM h""")
def hypotheses_h1_h15(spark, sf):
    """Reversals, slowing falls, shocks, quiet lows, breakouts and band lows from each day's own past, a row for each that fires; all share one order of the series."""
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).withColumn("r", X.change(p, w))
    d = d.select(
        "corridor", "day", "price", "r", F.lag("r").over(w).alias("r1"), F.lag("r", 2).over(w).alias("r2"), X.change(p, w, 3).alias("fall"),
        X.rolling(F.min, p, w, 90, lag=1).alias("low"), X.rolling(F.max, p, w, 20, lag=1).alias("high"), X.rolling(F.avg, p, w, 20, lag=1).alias("mean"),
        X.rolling(F.stddev_samp, p, w, 20, lag=1).alias("sd"), X.rolling(F.stddev_samp, c("r"), w, 20, lag=1).alias("sigma"), X.rolling(F.stddev_samp, c("r"), w, 20).alias("vol"),
        X.full(p, X.trailing(w, 90), 90, F.percentile(p, F.lit(0.1)).over(X.trailing(w, 90))).alias("decile"),
    )
    d = d.withColumns({"calm": X.trailing_quantile(c("vol"), w, 252, 2 / 3, 126), "quiet": X.trailing_quantile(c("vol"), w, 252, 1 / 3, 126)})
    rise, under, cheap = p / c("low") - 1, c("decile") / p - 1, p <= c("decile")
    turned = (c("low") < p) & (rise >= 0.5 * c("sigma")) & (c("r") >= 0) & (c("r1") >= 0)
    rules = {
        "H1": (turned, rise / c("sigma")),
        "H2": (cheap & (c("r2") < c("r1")) & (c("r1") < c("r")) & (c("r") <= 0), under / c("sigma")),
        "H3": (turned & (c("vol") <= c("calm")), rise / c("sigma")),
        "H6": (c("r") <= -2 * c("sigma"), -c("r") / c("sigma")),
        "H7": ((c("fall") <= -2 * c("sigma") * math.sqrt(3)) & (c("r") >= 0), -c("fall") / c("sigma")),
        "H8": (cheap & (c("vol") <= c("quiet")), under / c("sigma")),
        "H9": ((p > c("high")) & (c("r") >= 0.5 * c("sigma")), (p / c("high") - 1) / c("sigma")),
        "H10": (p <= c("mean") - 2 * c("sd"), (c("mean") - p) / c("sd")),
    }
    fired = F.array_compact(F.array(*[F.when(cond, F.struct(F.lit(k).alias("hypothesis"), _unit(v).alias("strength"))) for k, (cond, v) in rules.items()]))
    return d.select("corridor", "day", F.inline(fired))


_WEEKLY = "w AS (SELECT corridor, day AS observed, day + 1 AS known, price AS value FROM d WHERE isodow(day) = 3)"


def _weekly(spark, sf):
    """Each Wednesday's price, public the day after."""
    return P.daily_panel(spark, sf).where(F.weekday("day") == 2).select("corridor", c("day").alias("observed"), F.date_add("day", 1).alias("known"), c("price").alias("value"))


@query(f"""WITH {{D}}, {_WEEKLY}, j AS (SELECT d.corridor, d.day, w.value, d.day - w.observed AS age FROM d ASOF LEFT JOIN w ON d.corridor = w.corridor AND d.day >= w.known)
SELECT corridor, day, CASE WHEN age <= 6 THEN value END AS value, CASE WHEN age <= 6 THEN age END AS age_days, coalesce(age <= 6, false) AS available FROM j""")
def asof_max_age(spark, sf):
    """The last public value, emptied where what it describes lies more than six days back; the row stays."""
    j = asof_join(P.daily_panel(spark, sf), _weekly(spark, sf), by="corridor", left_on="day", right_on="known", columns=["value", "observed"])
    age = F.date_diff("day", "asof_observed")
    fresh = F.coalesce(age <= 6, F.lit(False))
    return j.select("corridor", "day", F.when(fresh, c("asof_value")).alias("value"), F.when(fresh, age).alias("age_days"), fresh.alias("available"))


_MONTH = """m AS (SELECT corridor, date_trunc('month', day)::DATE AS month, round(avg(price), 4) AS level FROM d GROUP BY 1, 2),
k AS (SELECT corridor, month, last_day(month) + 10 AS known, level, round(level - lag(level) OVER w, 4) AS change_1m,
  round(CASE WHEN count(level) OVER p >= 6 THEN (level - avg(level) OVER p) / nullif(stddev_samp(level) OVER p, 0) END, 4) AS z12
  FROM m WINDOW w AS (PARTITION BY corridor ORDER BY month),
p AS (PARTITION BY corridor ORDER BY month ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING))"""


def _monthly(spark, sf):
    """Monthly level, change and past z-score, public ten days after the month's end."""
    m = P.daily_panel(spark, sf).groupBy("corridor", F.trunc("day", "month").alias("month")).agg(r4(F.avg("price")).alias("level"))
    w = X.series("corridor", "month")
    return m.select("corridor", "month", F.date_add(F.last_day("month"), 10).alias("known"), "level", r4(c("level") - F.lag("level").over(w)).alias("change_1m"), r4(X.zscore(c("level"), w, 12, 6, lag=1)).alias("z12"))


@query(f"WITH {{D}}, {_MONTH} SELECT corridor, month, known FROM k")
def availability_shift(spark, sf):
    """When each month's value becomes public: the end of the month and ten days."""
    return _monthly(spark, sf).select("corridor", "month", "known")


@query(f"WITH {{D}}, {_MONTH} SELECT d.corridor, d.day, CAST(k.month AS VARCHAR) AS month, k.level, k.change_1m, k.z12 FROM d ASOF LEFT JOIN k ON d.corridor = k.corridor AND d.day >= k.known")
def asof_daily_monthly(spark, sf):
    """Each day with the last month that was public by then."""
    j = asof_join(P.daily_panel(spark, sf), _monthly(spark, sf), by="corridor", left_on="day", right_on="known", columns=["month", "level", "change_1m", "z12"], prefix="_m_")
    return j.select("corridor", "day", c("_m_month").cast("string").alias("month"), *[c(f"_m_{k}").alias(k) for k in ("level", "change_1m", "z12")])


_DAILY = """o AS (SELECT DISTINCT secid, dt_msk, high, low, close, volume_rub FROM moex_candles WHERE close > 0),
q AS (SELECT secid, CAST(dt_msk AS DATE) AS day, max_by(close, dt_msk) AS close, max(CASE WHEN high > 0 THEN high END) AS high, min(CASE WHEN low > 0 THEN low END) AS low, sum(CASE WHEN volume_rub > 0 THEN volume_rub END) AS volume FROM o GROUP BY 1, 2)"""


def _instruments(spark, sf):
    """One row a day and instrument from its usable hourly candles; redelivered rows count once."""
    o = P.table(spark, sf, "moex_candles").where("close > 0").select("secid", "dt_msk", "high", "low", "close", "volume_rub").distinct()
    positive = lambda k: F.when(c(k) > 0, c(k))
    return o.groupBy("secid", c("dt_msk").cast("date").alias("day")).agg(F.max_by("close", "dt_msk").alias("close"), F.max(positive("high")).alias("high"), F.min(positive("low")).alias("low"), F.sum(positive("volume_rub")).alias("volume"))


@query(f"""WITH {_DAILY}, r AS (SELECT *, close / lag(close) OVER w - 1 AS raw1, close / lag(close, 5) OVER w - 1 AS raw5, ln(1 + volume) AS lv FROM q
  WINDOW w AS (PARTITION BY secid ORDER BY day)),
s AS (SELECT *, CASE WHEN abs(raw1) <= 0.35 THEN raw1 END AS r1, CASE WHEN abs(raw5) <= 1 THEN raw5 END AS r5 FROM r)
SELECT secid, day, round(r1, 6) AS return_1, round(r5, 6) AS return_5, round((high - low) / close, 6) AS range_pct, round(lv, 5) AS log_volume,
  round(CASE WHEN count(r1) OVER t >= 12 THEN stddev_samp(r1) OVER t END, 6) AS volatility_20,
  round(CASE WHEN count(lv) OVER t >= 12 THEN (lv - avg(lv) OVER t) / nullif(stddev_samp(lv) OVER t, 0) END, 4) AS volume_z20,
  round(lv - lag(lv, 5) OVER w, 5) AS volume_change_5, round(abs(r1) / (volume / 1e9), 4) AS illiquidity
FROM s WINDOW w AS (PARTITION BY secid ORDER BY day),
t AS (PARTITION BY secid ORDER BY day ROWS 19 PRECEDING)""")
def instrument_bank(spark, sf):
    """Returns without unadjusted jumps, volatility, range, volume and illiquidity of every instrument."""
    w = X.series("secid", "day")
    within = lambda x, most: F.when(F.abs(x) <= most, x)
    d = _instruments(spark, sf).withColumns({"r1": within(X.change(c("close"), w), 0.35), "r5": within(X.change(c("close"), w, 5), 1.0), "lv": F.log1p("volume")})
    return d.select(
        "secid", "day", r6("r1").alias("return_1"), r6("r5").alias("return_5"), r6((c("high") - c("low")) / c("close")).alias("range_pct"), F.round("lv", 5).alias("log_volume"),
        r6(X.rolling(F.stddev_samp, c("r1"), w, 20, 12)).alias("volatility_20"), r4(X.zscore(c("lv"), w, 20, 12)).alias("volume_z20"),
        F.round(c("lv") - F.lag("lv", 5).over(w), 5).alias("volume_change_5"), r4(F.abs("r1") / (c("volume") / 1e9)).alias("illiquidity"),
    )


@query("""WITH o AS (SELECT DISTINCT secid, dt_msk, close FROM moex_candles),
s AS (SELECT secid, count(*) AS n, avg((close IS NULL OR NOT close > 0)::INT) AS invalid FROM o GROUP BY 1)
SELECT secid, n, round(invalid, 6) AS invalid_share, n >= 252 AND invalid <= 0.05 AND n >= ceil(max(n) OVER (PARTITION BY asset_class) * CASE WHEN asset_class LIKE '%future%' THEN 0.35 ELSE 0.8 END) AS eligible FROM s JOIN moex_universe USING (secid)""")
def instrument_coverage(spark, sf):
    """Which instruments have enough usable rows, beside the best covered of their class."""
    o = P.table(spark, sf, "moex_candles").select("secid", "dt_msk", "close").distinct()
    s = o.groupBy("secid").agg(F.count("*").alias("n"), F.avg((~F.coalesce(c("close") > 0, F.lit(False))).cast("int")).alias("invalid"))
    s = s.join(P.table(spark, sf, "moex_universe").select("secid", "asset_class"), "secid")
    least = F.ceil(F.max("n").over(Window.partitionBy("asset_class")) * F.when(c("asset_class").contains("future"), 0.35).otherwise(0.8))
    return s.select("secid", "n", r6("invalid").alias("invalid_share"), ((c("n") >= 252) & (c("invalid") <= 0.05) & (c("n") >= least)).alias("eligible"))


@query(f"""WITH {_DAILY}, t AS (SELECT day FROM q WHERE secid = (SELECT min(secid) FROM q)),
u AS (SELECT secid, asset_class FROM moex_universe)
SELECT day, avg(CASE WHEN asset_class = 'fx' THEN close END) AS fx, round(avg(close), 4) AS every, count(close) AS instruments FROM (SELECT * FROM t
  LEFT JOIN q USING (day)) LEFT JOIN u USING (secid) GROUP BY 1""")
def universe_matrix(spark, sf):
    """The days of one target instrument, and beside each the other instruments' closes of the day, never filled: their mean by class and how many there are."""
    q = _instruments(spark, sf)
    first = q.agg(F.min("secid")).first()[0]
    classes = P.table(spark, sf, "moex_universe").select("secid", "asset_class")
    rows = q.where(c("secid") == first).select("day").join(q.select("secid", "day", "close"), "day", "left").join(classes, "secid", "left")
    return rows.groupBy("day").agg(F.avg(F.when(c("asset_class") == "fx", c("close"))).alias("fx"), r4(F.avg("close")).alias("every"), F.count("close").alias("instruments"))


_WIN = "WINDOW w AS (PARTITION BY corridor ORDER BY day), "
_T = ", ".join(f"t{n} AS (PARTITION BY corridor ORDER BY day ROWS {n - 1} PRECEDING)" for n in (5, 10, 20, 60, 252))


@query(f"""WITH {{D}}, u AS (SELECT day, price AS usd FROM d WHERE corridor = '1-URGENT'),
j AS (SELECT d.*, usd, usd / price AS local FROM d LEFT JOIN u USING (day)),
r AS (SELECT *, price / lag(price) OVER w - 1 AS r1, price / lag(price, 3) OVER w - 1 AS r3, price / lag(price, 20) OVER w - 1 AS r20, usd / lag(usd, 3) OVER w - 1 AS leg3, local / lag(local, 3) OVER w - 1 AS other3 FROM j {_WIN}{_T}),
v AS (SELECT *, {", ".join(f"CASE WHEN count(r1) OVER t{n} = {n} THEN stddev_samp(r1) OVER t{n} END AS vol{n}" for n in (5, 10, 20))},
  {", ".join(f"CASE WHEN count(price) OVER t{n} = {n} THEN price / min(price) OVER t{n} - 1 END AS over{n}, CASE WHEN count(price) OVER t{n} = {n} THEN price / max(price) OVER t{n} - 1 END AS under{n}, CASE WHEN count(price) OVER t{n} = {n} THEN (price - avg(price) OVER t{n}) / nullif(stddev_samp(price) OVER t{n}, 0) END AS z{n}" for n in (20, 60))},
  CASE WHEN count(price) OVER t60 = 60 THEN list(price) OVER t60 END AS l60 FROM r {_WIN}{_T}),
k AS (SELECT *, list(vol20) OVER t252 AS lv, count(vol20) OVER t252 AS nv FROM v {_WIN}{_T}),
x AS (SELECT *, (len(list_filter(l60, lambda x: x < price)) + (len(list_filter(l60, lambda x: x = price)) + 1) / 2) / 60 AS rank60,
  CASE WHEN nv = 252 THEN (len(list_filter(lv, lambda x: x < vol20)) + (len(list_filter(lv, lambda x: x = vol20)) + 1) / 2) / 252 END AS volrank, r20 / (nullif(vol20, 0) * sqrt(20)) AS trend, abs(r1) / nullif(vol20, 0) AS shock FROM k)
SELECT corridor, day, round(r1, 6) AS return_1, round(r3, 6) AS return_3, round(r20, 6) AS return_20, round(vol5, 6) AS volatility_5, round(vol10, 6) AS volatility_10, round(vol20, 6) AS volatility_20,
  round(over20, 6) AS over_min_20, round(under20, 6) AS under_max_20, round(z20, 4) AS z_20, round(over60, 6) AS over_min_60, round(under60, 6) AS under_max_60, round(z60, 4) AS z_60, round(rank60, 6) AS rank_60,
  round(leg3 - other3, 6) AS relative_momentum_3, round(volrank, 6) AS volatility_rank,
  CASE WHEN shock >= 2 THEN 'SHOCK' WHEN volrank >= 0.67 THEN 'HIGH_VOL' WHEN trend <= -0.5 THEN 'TREND_DOWN' WHEN trend >= 0.5 THEN 'TREND_UP' WHEN volrank <= 0.33 THEN 'LOW_VOL' ELSE 'NORMAL' END AS regime FROM x""")
def corridor_bank(spark, sf):
    """Returns, volatilities, distances, ranks and z-scores over several windows, the two legs of a cross rate, and the regime they make up."""
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf)
    usd = d.where("corridor = '1-URGENT'").select("day", p.alias("usd"))
    d = d.join(usd, "day", "left").withColumn("local", c("usd") / p)
    d = d.withColumns({"r1": X.change(p, w), "r3": X.change(p, w, 3), "r20": X.change(p, w, 20), "leg3": X.change(c("usd"), w, 3), "other3": X.change(c("local"), w, 3)})
    d = d.withColumns({f"vol{n}": X.rolling(F.stddev_samp, c("r1"), w, n) for n in (5, 10, 20)})
    d = d.withColumns({"volrank": X.rank_average(c("vol20"), w, 252), "trend": F.try_divide(c("r20"), c("vol20") * F.sqrt(F.lit(20.0))), "shock": F.try_divide(F.abs("r1"), c("vol20"))})
    regime = F.when(c("shock") >= 2, "SHOCK").when(c("volrank") >= 0.67, "HIGH_VOL").when(c("trend") <= -0.5, "TREND_DOWN").when(c("trend") >= 0.5, "TREND_UP").when(c("volrank") <= 0.33, "LOW_VOL").otherwise("NORMAL")
    wide = [col for n in (20, 60) for col in (r6(X.distance_to(F.min, p, w, n)).alias(f"over_min_{n}"), r6(X.distance_to(F.max, p, w, n)).alias(f"under_max_{n}"), r4(X.zscore(p, w, n)).alias(f"z_{n}"))]
    return d.select(
        "corridor", "day", *[r6(f"r{n}").alias(f"return_{n}") for n in (1, 3, 20)], *[r6(f"vol{n}").alias(f"volatility_{n}") for n in (5, 10, 20)], *wide, r6(X.rank_average(p, w, 60)).alias("rank_60"),
        r6(c("leg3") - c("other3")).alias("relative_momentum_3"), r6("volrank").alias("volatility_rank"), regime.alias("regime"),
    )


_LINE = """s AS (SELECT event_type AS series, CAST(ts AS DATE) AS day, count(*) AS articles FROM events WHERE ts IS NOT NULL GROUP BY 1, 2),
days AS (SELECT CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM s),
seen AS (SELECT DISTINCT day FROM s),
g AS (SELECT n.series, days.day, seen.day IS NOT NULL AS observed FROM (SELECT DISTINCT series FROM s) n, days LEFT JOIN seen USING (day)),
k AS (SELECT g.series, g.day, observed, CASE WHEN observed THEN coalesce(articles, 0) END AS articles FROM g LEFT JOIN s USING (series, day))"""


@query(f"""WITH {_LINE} SELECT series, day + 1 AS feature_day, NOT observed AS missing, articles, sum(articles) OVER w7 AS articles_7d, round(avg(observed::INT) OVER w7, 6) AS coverage_7d,
  round(CASE WHEN count(articles) OVER p >= 10 THEN (articles - avg(articles) OVER p) / nullif(stddev_samp(articles) OVER p, 0) END, 4) AS shock
FROM k WINDOW w7 AS (PARTITION BY series ORDER BY day ROWS 6 PRECEDING),
p AS (PARTITION BY series ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING)""")
def timeline_bank(spark, sf):
    """Daily counts of every series: zero on days on which any series was seen, unknown on days without any; sums, coverage and shocks, usable the day after."""
    s = P.table(spark, sf, "events").where("ts is not null").groupBy(c("event_type").alias("series"), c("ts").cast("date").alias("day")).agg(F.count("*").alias("articles"))
    span = s.agg(F.min("day").alias("lo"), F.max("day").alias("hi")).first()
    days = s.select("series").distinct().withColumn("day", F.explode(F.sequence(F.lit(span["lo"]).cast("date"), F.lit(span["hi"]).cast("date"))))
    seen = s.select("day").distinct().withColumn("observed", F.lit(True))
    k = days.join(seen, "day", "left").join(s, ["series", "day"], "left").withColumn("observed", F.coalesce("observed", F.lit(False)))
    k = k.withColumn("articles", F.when(c("observed"), F.coalesce("articles", F.lit(0))))
    w = X.series("series", "day")
    t = X.trailing(w, 7)
    return k.select("series", F.date_add("day", 1).alias("feature_day"), (~c("observed")).alias("missing"), "articles", F.sum("articles").over(t).alias("articles_7d"), r6(F.avg(c("observed").cast("int")).over(t)).alias("coverage_7d"), r4(X.zscore(c("articles"), w, 30, 10, lag=1)).alias("shock"))


@query("""WITH o AS (SELECT DISTINCT provider, observation_date AS day, known_at, release_id, policy_rate_pct AS rate FROM provider_rates
  WHERE policy_rate_pct IS NOT NULL AND observation_date IS NOT NULL AND provider IS NOT NULL),
k AS (SELECT provider, day, max_by(rate, (coalesce(epoch_us(known_at), 0), release_id)) AS rate FROM o GROUP BY 1, 2),
m AS (SELECT *, rate - lag(rate) OVER w AS step FROM k WINDOW w AS (PARTITION BY provider ORDER BY day)),
n AS (SELECT *, max(CASE WHEN step <> 0 THEN day END) OVER w AS moved, last_value(CASE WHEN step <> 0 THEN step END IGNORE NULLS) OVER w AS last_move FROM m
  WINDOW w AS (PARTITION BY provider ORDER BY day))
SELECT provider, day, round(rate, 6) AS rate, round(rate - lag(rate, 5) OVER w, 6) AS change_5, round(rate - lag(rate, 20) OVER w, 6) AS change_20, round(last_move, 6) AS last_move, day - moved AS days_since_move FROM n WINDOW w AS (PARTITION BY provider ORDER BY day)""")
def rate_bank(spark, sf):
    """Policy rate levels, changes over five and twenty releases, the last move and its age."""
    o = P.table(spark, sf, "provider_rates").where("policy_rate_pct is not null and observation_date is not null and provider is not null")
    order = F.struct(F.coalesce(F.unix_micros(c("known_at").cast("timestamp")), F.lit(0)), c("release_id"))
    k = o.groupBy("provider", c("observation_date").alias("day")).agg(F.max_by("policy_rate_pct", order).alias("rate"))
    w = X.series("provider", "day")
    m = k.withColumn("step", c("rate") - F.lag("rate").over(w))
    moved = F.when(c("step") != 0, c("step"))
    since = F.max(F.when(c("step") != 0, c("day"))).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return m.select("provider", "day", r6("rate").alias("rate"), *[r6(c("rate") - F.lag("rate", n).over(w)).alias(f"change_{n}") for n in (5, 20)], r6(X.fill_forward(moved, w)).alias("last_move"), F.date_diff("day", since).alias("days_since_move"))


@query("""WITH {D}, r AS (SELECT corridor, day, ln(price / lag(price) OVER (PARTITION BY corridor ORDER BY day)) AS r FROM d),
l AS (SELECT corridor, day, list(r) OVER w AS v, count(r) OVER w AS n FROM r WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS 4 PRECEDING)),
s AS (SELECT corridor, day, v, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS i FROM l WHERE n = 5)
SELECT corridor, day, round((v[1] - list_avg(v)) / list_stddev_pop(v), 4) AS s1, round((v[3] - list_avg(v)) / list_stddev_pop(v), 4) AS s3, round((v[5] - list_avg(v)) / list_stddev_pop(v), 4) AS s5 FROM s WHERE i % 3 = 0""")
def shape_rows(spark, sf):
    """The shape of the last five log returns, standardised per row, of every third row of a series."""
    w = DAY()
    t = X.trailing(w, 5)
    d = P.daily_panel(spark, sf).withColumn("r", F.log(c("price") / F.lag("price").over(w)))
    d = d.select("corridor", "day", *[F.lag("r", 5 - k).over(w).alias(f"v{k}") for k in (1, 3, 5)], F.avg("r").over(t).alias("m"), F.stddev_pop("r").over(t).alias("s"), F.count("r").over(t).alias("n")).where("n = 5")
    d = d.withColumn("i", F.row_number().over(w) - 1).where("i % 3 = 0")
    return d.select("corridor", "day", *[r4((c(f"v{k}") - c("m")) / c("s")).alias(f"s{k}") for k in (1, 3, 5)])


@query("""WITH {D}, f AS (SELECT corridor, day, greatest(0, price / min(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) - 1) * 10000 AS regret FROM d QUALIFY lead(price) OVER (PARTITION BY corridor ORDER BY day) IS NOT NULL)
SELECT corridor, day, corridor || '__' || isoyear(day) || '-W' || lpad(CAST(week(day) AS VARCHAR), 2, '0') AS qid, CASE WHEN regret <= 25 THEN 3 WHEN regret <= 1000 THEN 2 WHEN regret <= 3000 THEN 1 ELSE 0 END AS relevance FROM f WHERE regret IS NOT NULL""")
def ranking_groups(spark, sf):
    """Each day's ranking group (corridor and ISO week) and graded relevance."""
    frame = X.future(DAY(), 5)
    regret = F.greatest(F.lit(0.0), c("price") / F.min("price").over(frame) - 1) * 10_000
    d = P.daily_panel(spark, sf).withColumn("regret", F.when(F.count("price").over(frame) > 0, regret)).where("regret is not null")
    qid = F.concat(c("corridor"), F.lit("__"), F.extract(F.lit("YEAROFWEEK"), "day"), F.lit("-W"), F.lpad(F.weekofyear("day").cast("string"), 2, "0"))
    return d.select("corridor", "day", qid.alias("qid"), F.when(c("regret") <= 25, 3).when(c("regret") <= 1000, 2).when(c("regret") <= 3000, 1).otherwise(0).alias("relevance"))


@query("""WITH {H}, s AS (SELECT corridor, CAST(hour AS DATE) AS day, max_by(price, hour) AS spot FROM h GROUP BY 1, 2), {D}, f AS (SELECT day, corridor, price AS future FROM d)
SELECT f.corridor AS contract, f.day, s.corridor AS series, round(future / spot - 1, 6) AS basis FROM f JOIN s ON f.day = s.day - INTERVAL 24 YEAR""")
def last_spot_of_day(spark, sf):
    """Daily contracts beside the last hourly price of the day; the two sample tables lie 24 years apart."""
    s = P.hourly_panel(spark, sf).groupBy("corridor", c("hour").cast("date").alias("day")).agg(F.max_by("price", "hour").alias("spot"))
    s = s.select(c("corridor").alias("series"), F.add_months("day", -24 * 12).alias("day"), "spot")
    return P.daily_panel(spark, sf).join(s, "day").select(c("corridor").alias("contract"), "day", "series", r6(c("price") / c("spot") - 1).alias("basis"))


@query("""WITH {H} SELECT corridor, hour, round(lead(price, 3) OVER w / price - 1, 6) AS forward_3 FROM h WINDOW w AS (PARTITION BY corridor ORDER BY hour)
  QUALIFY CAST(lead(hour, 3) OVER w AS DATE) = CAST(hour AS DATE)""")
def forward_same_day(spark, sf):
    """The return over the next three rows of the same day; where the third lies on another day there is none."""
    w = X.series("corridor", "hour")
    d = P.hourly_panel(spark, sf).select("corridor", "hour", r6(F.lead("price", 3).over(w) / c("price") - 1).alias("forward_3"), F.lead("hour", 3).over(w).alias("then"))
    return d.where(c("then").cast("date") == c("hour").cast("date")).drop("then")


@query("""WITH {D}, r AS (SELECT *, abs(price - median(price) OVER (PARTITION BY corridor)) AS dev FROM d),
m AS (SELECT *, median(dev) OVER (PARTITION BY corridor) AS mad FROM r) SELECT corridor, day, round(dev / (1.4826 * nullif(mad, 0)), 4) AS robust_distance FROM m""")
def robust_distance(spark, sf):
    """How many robust standard deviations a price lies from its corridor's median."""
    d = P.daily_panel(spark, sf)
    med = d.groupBy("corridor").agg(F.percentile("price", F.lit(0.5)).alias("med"))
    d = d.join(med, "corridor").withColumn("dev", F.abs(c("price") - c("med")))
    mad = d.groupBy("corridor").agg(F.percentile("dev", F.lit(0.5)).alias("mad"))
    return d.join(mad, "corridor").select("corridor", "day", r4(F.try_divide(c("dev"), 1.4826 * c("mad"))).alias("robust_distance"))


@query("""WITH q AS (SELECT DISTINCT quote_id, provider, available_at, bid_uzs_per_rub AS bid, ask_uzs_per_rub AS ask FROM bank_quotes
  WHERE bid_uzs_per_rub > 0 AND ask_uzs_per_rub > 0),
v AS (SELECT provider, abs(ask / bid - 1) * 10000 AS bps FROM q)
SELECT provider, count(*) AS n, round(quantile_cont(bps, 0.5), 3) AS median_bps, round(quantile_cont(bps, 0.95), 3) AS p95_bps, CASE WHEN count(*) >= 30 THEN 'tested' ELSE 'not_testable' END AS status FROM v GROUP BY 1""")
def quote_fidelity(spark, sf):
    """Median and 95th percentile of the absolute deviation of the two sides, or that a provider has too few quotes to tell."""
    q = P.table(spark, sf, "bank_quotes").where("bid_uzs_per_rub > 0 and ask_uzs_per_rub > 0").select("quote_id", "provider", "available_at", "bid_uzs_per_rub", "ask_uzs_per_rub").distinct()
    v = q.withColumn("bps", F.abs(c("ask_uzs_per_rub") / c("bid_uzs_per_rub") - 1) * 10_000)
    return v.groupBy("provider").agg(F.count("*").alias("n"), F.round(F.percentile("bps", F.lit(0.5)), 3).alias("median_bps"), F.round(F.percentile("bps", F.lit(0.95)), 3).alias("p95_bps"), F.when(F.count("*") >= 30, "tested").otherwise("not_testable").alias("status"))


@query("""WITH {D}, i AS (SELECT corridor, day, n AS level, ln(1 + n) AS log FROM d)
SELECT corridor, day + 1 AS feature_day, level, round(log - lag(log) OVER w, 6) AS log_change_1, round(log - lag(log, 7) OVER w, 6) AS log_change_7,
  round(CASE WHEN count(level) OVER t7 >= 3 THEN avg(level) OVER t7 END, 6) AS mean_7,
  round(CASE WHEN count(level) OVER p30 >= 15 THEN (level - avg(level) OVER p30) / nullif(stddev_samp(level) OVER p30, 0) END, 4) AS z30,
  round(CASE WHEN count(level) OVER p90 >= 45 THEN (level - avg(level) OVER p90) / nullif(stddev_samp(level) OVER p90, 0) END, 4) AS z90
FROM i WINDOW w AS (PARTITION BY corridor ORDER BY day),
t7 AS (PARTITION BY corridor ORDER BY day ROWS 6 PRECEDING),
  p30 AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING),
p90 AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING)""")
def index_bank(spark, sf):
    """A daily index: level, log changes, mean and z-scores against its own past, usable the day after."""
    w, log = DAY(), F.log1p("n")
    z = lambda n: r4(X.zscore(c("n"), w, n, n // 2, lag=1))
    return P.daily_panel(spark, sf).select("corridor", F.date_add("day", 1).alias("feature_day"), c("n").alias("level"), r6(log - F.lag(log).over(w)).alias("log_change_1"), r6(log - F.lag(log, 7).over(w)).alias("log_change_7"), r6(X.rolling(F.avg, c("n"), w, 7, 3)).alias("mean_7"), z(30).alias("z30"), z(90).alias("z90"))


@query(f"""WITH {{D}}, {_MONTH}, r AS (SELECT corridor, day, price / lag(price, 5) OVER w - 1 AS r5, price / lag(price, 20) OVER w - 1 AS r20 FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day)),
j AS (SELECT r.*, k.level, k.change_1m, k.z12 FROM r ASOF LEFT JOIN k ON r.corridor = k.corridor AND r.day >= k.known)
SELECT corridor, day, round(r5 - r20 / 4, 6) AS acceleration, round(r20 - change_1m / level, 6) AS divergence, round(r20 * z12, 5) AS momentum_by_z, round(change_1m / level * 100, 5) AS monthly_pct FROM j WHERE level IS NOT NULL""")
def macro_interactions(spark, sf):
    """What daily momentum and the last public month say together: acceleration, divergence and their product."""
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", X.change(p, w, 5).alias("r5"), X.change(p, w, 20).alias("r20"))
    j = asof_join(d, _monthly(spark, sf), by="corridor", left_on="day", right_on="known", columns=["level", "change_1m", "z12"], prefix="m_").where("m_level is not null")
    share = c("m_change_1m") / c("m_level")
    return j.select("corridor", "day", r6(c("r5") - c("r20") / 4).alias("acceleration"), r6(c("r20") - share).alias("divergence"), F.round(c("r20") * c("m_z12"), 5).alias("momentum_by_z"), F.round(share * 100, 5).alias("monthly_pct"))


@query("""WITH {D}, cal AS (SELECT corridor, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d GROUP BY 1)
SELECT corridor, year(day) AS year, count(*) AS weekdays, count(*) - count(d.price) AS missing FROM cal LEFT JOIN d USING (corridor, day)
  WHERE isodow(day) <= 5 GROUP BY 1, 2""")
def weekday_gaps(spark, sf):
    """Weekdays of each year and how many have no row."""
    d = P.daily_panel(spark, sf)
    cal = d.groupBy("corridor").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).where(F.weekday("day") < 5)
    return cal.join(d, ["corridor", "day"], "left").groupBy("corridor", F.year("day").alias("year")).agg(F.count("*").alias("weekdays"), (F.count("*") - F.count("price")).alias("missing"))


@query("""WITH s AS (SELECT DISTINCT secid, dt_msk, close FROM moex_candles WHERE close > 0),
r AS (SELECT secid, round(close / lag(close) OVER (PARTITION BY secid ORDER BY dt_msk, close) - 1, 9) AS r FROM s)
SELECT secid, count(r) AS n, sum((abs(r - m) > 5 * sd)::INT)::BIGINT AS outliers
  FROM (SELECT *, avg(r) OVER (PARTITION BY secid) AS m, stddev_samp(r) OVER (PARTITION BY secid) AS sd FROM r WHERE r IS NOT NULL) GROUP BY 1""")
def outlier_5sigma(spark, sf):
    """Returns further than five standard deviations from their instrument's mean; mean and deviation are aggregates that meet the rows by a join."""
    s = P.table(spark, sf, "moex_candles").where("close > 0").select("secid", "dt_msk", "close").distinct()
    r = s.select("secid", F.round(X.change(c("close"), X.series("secid", "dt_msk", "close")), 9).alias("r")).where("r is not null")
    m = r.groupBy("secid").agg(F.avg("r").alias("m"), F.stddev_samp("r").alias("sd"))
    return r.join(m, "secid").groupBy("secid").agg(F.count("r").alias("n"), F.sum((F.abs(c("r") - c("m")) > 5 * c("sd")).cast("long")).alias("outliers"))

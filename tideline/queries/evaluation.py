"""Aggregations, reshaping, folds, metrics, resampling and news roll-ups."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.functions import windows as X
from tideline.operators import evaluate as E
from tideline.operators import labels as L
from tideline.operators.draws import draw_sql
from tideline.queries.registry import query

c = lambda name: F.col(name)
r4 = lambda x: F.round(x, 4)
r6 = lambda x: F.round(x, 6)
DAY = lambda: X.series("corridor", "day")


@query("""SELECT l_returnflag, l_linestatus, count(*) AS n, count(DISTINCT l_orderkey) AS orders, round(sum(l_extendedprice), 2) AS gross, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount, round(quantile_cont(l_quantity, 0.9), 4) AS p90 FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""")
def grouped_summary(spark, sf):
    net = c("l_extendedprice") * (1 - c("l_discount"))
    return (
        P.table(spark, sf, "lineitem").where(c("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz")).groupBy("l_returnflag", "l_linestatus")
        .agg(F.count("*").alias("n"), F.count_distinct("l_orderkey").alias("orders"), F.round(F.sum("l_extendedprice"), 2).alias("gross"), F.round(F.sum(net), 2).alias("net"), r6(F.avg("l_discount")).alias("discount"), r4(F.percentile("l_quantity", F.lit(0.9))).alias("p90"))
    )


@query("""SELECT coalesce(l_returnflag, 'ALL') AS flag, coalesce(l_linestatus, 'ALL') AS status, count(*) AS n, round(sum(l_quantity), 2) AS quantity
  FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)""")
def rollup_all(spark, sf):
    return P.table(spark, sf, "lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity")).select(F.coalesce("l_returnflag", F.lit("ALL")).alias("flag"), F.coalesce("l_linestatus", F.lit("ALL")).alias("status"), "n", "quantity")


@query("""WITH {D}, g AS (SELECT corridor, day, price, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d),
x AS (SELECT corridor, stddev_samp(r) AS s FROM g GROUP BY 1),
m AS (SELECT corridor, count(*) AS missing FROM (SELECT corridor, CAST(unnest(generate_series(min(day), max(day), INTERVAL 1 DAY)) AS DATE) AS day FROM d
  GROUP BY 1) ANTI JOIN d USING (corridor, day) WHERE isodow(day) <= 5 GROUP BY 1)
SELECT g.corridor, count(*) AS rows, count(DISTINCT day) AS days, coalesce(any_value(missing), 0) AS missing_weekdays, round(median(abs(r)) * 10000, 4) AS median_move_bps, round(quantile_cont(abs(r), 0.95) * 10000, 4) AS p95_move_bps, coalesce(sum((abs(r) > 5 * s)::INT), 0) AS outliers FROM g JOIN x USING (corridor) LEFT JOIN m USING (corridor) GROUP BY 1""")
def quality_report(spark, sf):
    g = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY()))
    g = g.withColumn("s", F.stddev_samp("r").over(Window.partitionBy("corridor")))
    cal = g.groupBy("corridor").agg(F.explode(F.sequence(F.min("day"), F.max("day"))).alias("day")).where(F.weekday("day") < 5)
    missing = cal.join(g.select("corridor", "day"), ["corridor", "day"], "left_anti").groupBy("corridor").agg(F.count("*").alias("missing"))
    move = lambda q: r4(F.percentile(F.abs("r"), F.lit(q)) * 10_000)
    a = g.groupBy("corridor").agg(F.count("*").alias("rows"), F.count_distinct("day").alias("days"), move(0.5).alias("median_move_bps"), move(0.95).alias("p95_move_bps"), F.count_if(F.abs("r") > 5 * c("s")).alias("outliers"))
    return a.join(missing, "corridor", "left").select("corridor", "rows", "days", F.coalesce("missing", F.lit(0)).alias("missing_weekdays"), "median_move_bps", "p95_move_bps", "outliers")


@query("WITH {D} SELECT corridor, date_trunc('week', day)::DATE AS week, count(*) AS days, round(avg((price < 150000)::INT), 6) AS base_rate FROM d GROUP BY 1, 2")
def weekly_base_rate(spark, sf):
    return P.daily_panel(spark, sf).groupBy("corridor", F.date_trunc("week", "day").cast("date").alias("week")).agg(F.count("*").alias("days"), r6(F.avg((c("price") < 150_000).cast("int"))).alias("base_rate"))


@query("WITH {H} SELECT corridor, hour, round(avg((n >= 3)::INT) OVER (PARTITION BY corridor, isodow(hour), hour(hour)), 6) AS matched FROM h")
def matched_time_bucket(spark, sf):
    return P.hourly_panel(spark, sf).select("corridor", "hour", r6(F.avg((c("n") >= 3).cast("int")).over(Window.partitionBy("corridor", F.weekday("hour"), F.hour("hour")))).alias("matched"))


@query("""WITH {D}, p AS (SELECT corridor, day, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS pos FROM d WHERE price < 120000 OR n = 1),
s AS (SELECT *, pos - lag(pos) OVER (PARTITION BY corridor ORDER BY day) AS gap
  FROM (SELECT d.corridor, d.day, row_number() OVER (PARTITION BY d.corridor ORDER BY d.day) - 1 AS pos, d.price, d.n FROM d) WHERE price < 120000)
SELECT corridor, round(count(*) / count(DISTINCT date_trunc('week', day)), 6) AS per_week, round(count(*) / count(DISTINCT date_trunc('month', day)), 6) AS per_month, round(avg((gap <= 5)::INT), 6) AS close_share, round(stddev_pop(gap) / avg(gap), 6) AS gap_cv FROM s GROUP BY 1""")
def frequency_and_clustering(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("pos", P.position("corridor", "day")).where("price < 120000").withColumn("gap", c("pos") - F.lag("pos").over(DAY()))
    per = lambda unit: r6(F.count("*") / F.count_distinct(F.date_trunc(unit, "day")))
    return d.groupBy("corridor").agg(per("week").alias("per_week"), per("month").alias("per_month"), r6(F.avg((c("gap") <= 5).cast("int"))).alias("close_share"), r6(F.stddev_pop("gap") / F.avg("gap")).alias("gap_cv"))


@query("""WITH {D}, y AS (SELECT corridor, year(day) AS y, greatest((max(day) - min(day) + 1) / 7.0, 1 / 7.0) AS weeks, sum((price < 120000)::INT) AS signals
  FROM d GROUP BY 1, 2)
SELECT corridor, count(*) AS years, round(sum(weeks), 4) AS weeks, sum(signals) AS signals, round(sum(signals) / sum(weeks), 6) AS per_week, round(min(signals / weeks), 6) AS worst_year FROM y GROUP BY 1""")
def period_metrics(spark, sf):
    y = P.daily_panel(spark, sf).groupBy("corridor", F.year("day").alias("y")).agg(F.greatest((F.date_diff(F.max("day"), F.min("day")) + 1) / 7, F.lit(1 / 7)).alias("weeks"), F.count_if(c("price") < 120_000).alias("signals"))
    return y.groupBy("corridor").agg(F.count("*").alias("years"), r4(F.sum("weeks")).alias("weeks"), F.sum("signals").alias("signals"), r6(F.sum("signals") / F.sum("weeks")).alias("per_week"), r6(F.min(c("signals") / c("weeks"))).alias("worst_year"))


@query("""SELECT user_id % 50 AS bucket, round(avg(DISTINCT value), 4) AS mean_distinct, min(value) AS low, max(value) AS high, count(DISTINCT event_type) AS kinds, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kind_list, sum(CAST(json_extract(props, '$.k') AS BIGINT)) AS k_sum FROM events GROUP BY 1""")
def distinct_and_json(spark, sf):
    e = P.table(spark, sf, "events")
    return e.groupBy((c("user_id") % 50).alias("bucket")).agg(r4(F.expr("avg(DISTINCT value)")).alias("mean_distinct"), F.min("value").alias("low"), F.max("value").alias("high"), F.count_distinct("event_type").alias("kinds"), F.concat_ws(",", F.sort_array(F.collect_set("event_type"))).alias("kind_list"), F.sum(F.get_json_object("props", "$.k").try_cast("long")).alias("k_sum"))


@query("""SELECT variant, "3" AS h3, "5" AS h5, "10" AS h10 FROM (PIVOT (SELECT DISTINCT score_id, variant, horizon, score FROM score_frame
  WHERE score IS NOT NULL AND NOT isnan(score) AND horizon IN (3, 5, 10)) ON horizon IN (3, 5, 10) USING round(avg(score), 9) GROUP BY variant)""")
def pivot_scores(spark, sf):
    s = P.table(spark, sf, "score_frame").where("score is not null and not isnan(score)").select("score_id", "variant", "horizon", "score").distinct().where("horizon in (3, 5, 10)")
    p = s.groupBy("variant").pivot("horizon", [3, 5, 10]).agg(F.round(F.avg("score"), 9))
    return p.select("variant", c("3").alias("h3"), c("5").alias("h5"), c("10").alias("h10"))


@query("""SELECT secid, dt_msk, measure, value FROM (UNPIVOT (SELECT DISTINCT secid, dt_msk, open, high, low, close
  FROM moex_candles) ON open, high, low, close INTO NAME measure VALUE value)""")
def unpivot_candles(spark, sf):
    d = P.table(spark, sf, "moex_candles").select("secid", "dt_msk", "open", "high", "low", "close").distinct()
    return d.unpivot(["secid", "dt_msk"], ["open", "high", "low", "close"], "measure", "value").where("value is not null")


@query("""WITH {D}, {H} SELECT 'daily' AS source, corridor, count(*) AS rows, NULL::BIGINT AS hours FROM d
  GROUP BY 2 UNION ALL BY NAME SELECT 'hourly' AS source, corridor, count(*) AS rows, count(DISTINCT hour) AS hours FROM h GROUP BY 2""")
def union_variants(spark, sf):
    a = P.daily_panel(spark, sf).groupBy("corridor").agg(F.count("*").alias("rows")).withColumn("source", F.lit("daily"))
    b = P.hourly_panel(spark, sf).groupBy("corridor").agg(F.count("*").alias("rows"), F.count_distinct("hour").alias("hours")).withColumn("source", F.lit("hourly"))
    return a.unionByName(b, allowMissingColumns=True)


@query("""SELECT instrument_id, trade_date, round(close, 4) AS close, round(regret_bps, 4) AS regret_bps FROM outcome_days
  QUALIFY row_number() OVER (PARTITION BY instrument_id, trade_date ORDER BY fetched_at DESC NULLS LAST, close DESC NULLS LAST, regret_bps DESC NULLS LAST) = 1""")
def dedup_keep_last(spark, sf):
    last = F.max_by(F.struct("close", "regret_bps"), F.struct("fetched_at", "close", "regret_bps")).alias("v")
    return P.table(spark, sf, "outcome_days").groupBy("instrument_id", "trade_date").agg(last).select("instrument_id", "trade_date", r4("v.close").alias("close"), r4("v.regret_bps").alias("regret_bps"))


@query("""SELECT provider FROM bank_quotes WHERE fee_rate = 0 INTERSECT SELECT provider FROM provider_rates WHERE policy_rate_pct > 12""")
def intersect_providers(spark, sf):
    return P.table(spark, sf, "bank_quotes").where("fee_rate = 0").select("provider").intersect(P.table(spark, sf, "provider_rates").where("policy_rate_pct > 12").select("provider"))


@query("""SELECT instrument_id FROM moex_universe EXCEPT SELECT instrument_id FROM outcome_days WHERE regret_bps > 100""")
def except_instruments(spark, sf):
    """Instruments of the universe without any day of more than a hundred basis points' regret."""
    return P.table(spark, sf, "moex_universe").select("instrument_id").subtract(P.table(spark, sf, "outcome_days").where("regret_bps > 100").select("instrument_id"))


@query("""WITH {D}, l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING) AS f FROM d),
s AS (SELECT corridor, day, coalesce(list_position(list_transform(f, lambda x: (price / x - 1) * 10000 > 2500), true), 6) AS e FROM l WHERE len(f) = 5)
SELECT corridor, day, step, step = e AS event FROM (SELECT *, unnest(generate_series(1, least(e, 5))) AS step FROM s)""")
def explode_at_risk(spark, sf):
    """One row per step for which an outcome was still open."""
    d = P.daily_panel(spark, sf).select("corridor", "day", L.first_improvement(c("price"), DAY(), 5, 2500).alias("e")).where("e > 0")
    return d.select("corridor", "day", "e", F.explode(F.sequence(F.lit(1), F.least("e", F.lit(5)))).alias("step")).select("corridor", "day", "step", (c("step") == c("e")).alias("event"))


@query("""SELECT c_custkey, CAST(c_mktsegment = 'AUTOMOBILE' AS DOUBLE) AS is_automobile, CAST(c_mktsegment = 'BUILDING' AS DOUBLE) AS is_building, CAST(c_mktsegment = 'MACHINERY' AS DOUBLE) AS is_machinery FROM customer""")
def one_hot(spark, sf):
    return P.table(spark, sf, "customer").select("c_custkey", *[(c("c_mktsegment") == k).cast("double").alias(f"is_{k.lower()}") for k in ("AUTOMOBILE", "BUILDING", "MACHINERY")])


@query("""SELECT n_name, max_by(c_custkey, struct_pack(a := c_acctbal, b := c_custkey)) AS best_customer, max(c_acctbal) AS best_balance FROM customer
  JOIN nation ON c_nationkey = n_nationkey GROUP BY 1""")
def best_row_per_group(spark, sf):
    j = P.table(spark, sf, "customer").join(P.table(spark, sf, "nation"), c("c_nationkey") == c("n_nationkey"))
    return j.groupBy("n_name").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("best_customer"), F.max("c_acctbal").alias("best_balance"))


_FOLD = """WITH {D}, p AS (SELECT corridor, day, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS pos FROM d),
q AS (SELECT corridor, date_trunc('quarter', day)::DATE AS quarter, min(pos) AS lo, max(pos) AS hi FROM p GROUP BY 1, 2)
SELECT corridor, quarter, lo - 5 AS train_stop, lo AS test_lo, test_hi FROM (SELECT *, %s AS test_hi FROM q) WHERE lo - 5 >= 252 AND test_hi >= lo"""


@query(_FOLD % "least(hi, max(hi) OVER (PARTITION BY corridor) - 5)")
def folds_quarterly_keep(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("pos", P.position("corridor", "day"))
    return E.quarterly_folds(d, key="corridor", day="day", position="pos", horizon=5, least_train=252, cut_tail=False)


@query(_FOLD % "hi - 5")
def folds_quarterly_cut(spark, sf):
    d = P.daily_panel(spark, sf).withColumn("pos", P.position("corridor", "day"))
    return E.quarterly_folds(d, key="corridor", day="day", position="pos", horizon=5, least_train=252, cut_tail=True)


@query("""WITH {D}, b AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY day DESC) AS back FROM d
  WHERE day < DATE '1999-01-01') SELECT corridor, count(*) AS train_rows, max(day) AS last_train FROM b WHERE back > 5 GROUP BY 1""")
def folds_annual_purged(spark, sf):
    t = E.purged(P.daily_panel(spark, sf), key="corridor", day="day", start=F.lit("1999-01-01").cast("date"), horizon=5)
    return t.groupBy("corridor").agg(F.count("*").alias("train_rows"), F.max("day").alias("last_train"))


@query("""WITH {D}, f AS (SELECT CAST(unnest(generate_series(DATE '1999-01-01', DATE '2001-07-01', INTERVAL 6 MONTH)) AS DATE) AS start) SELECT corridor, start, sum((day >= start AND day < start + INTERVAL 6 MONTH)::INT) AS test_rows, sum((day < start AND day >= start - INTERVAL 4 YEAR)::INT) AS train_rows FROM d CROSS JOIN f GROUP BY 1, 2""")
def folds_halfyear(spark, sf):
    """Rolling four-year training and half-year test counts; rows are counted by month before they meet folds."""
    m = P.daily_panel(spark, sf).groupBy("corridor", F.trunc("day", "month").alias("month")).agg(F.count("*").alias("n"))
    k = (F.year("month") * 12 + F.month("month") - 1 - 1999 * 12).alias("k")
    m = m.select("corridor", "n", k)
    test = m.select("corridor", F.floor(c("k") / 6).cast("int").alias("fold"), c("n").alias("test"), F.lit(0).alias("train"))
    train = m.select("corridor", F.explode(F.sequence(F.floor(c("k") / 6).cast("int") + 1, F.floor(c("k") / 6).cast("int") + 8)).alias("fold"), F.lit(0).alias("test"), c("n").alias("train"))
    all_folds = m.select("corridor").distinct().select("corridor", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("fold"), F.lit(0).alias("test"), F.lit(0).alias("train"))
    s = test.unionByName(train).unionByName(all_folds).where("fold between 0 and 5").groupBy("corridor", "fold").agg(F.sum("test").alias("test_rows"), F.sum("train").alias("train_rows"))
    return s.select("corridor", F.add_months(F.lit("1999-01-01").cast("date"), c("fold") * 6).alias("start"), "test_rows", "train_rows")


_EVAL = """WITH {D}, l AS (SELECT corridor, day, price, (price - min(price) OVER f) / price * 10000 <= 25 AS hit, count(*) OVER f AS nf, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING) AS v FROM d WINDOW f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)),
s AS (SELECT corridor, day, year(day) AS year, hit::INT AS hit, (len(v) = 60 AND len(list_filter(v, lambda x: x <= price)) <= 12)::INT AS signal FROM l WHERE nf = 5),
m AS (SELECT *, avg(hit) OVER (PARTITION BY corridor, %s date_trunc('week', day)) AS wk FROM s)
SELECT corridor, %s count(*) AS n, sum(signal) AS signals, round(sum(signal * hit) / nullif(sum(signal), 0), 6) AS hit_rate, round(avg(hit), 6) AS base_rate, round(sum(signal * hit) / nullif(sum(signal), 0) / nullif(avg(hit), 0), 6) AS lift, round(sum(signal * hit) / nullif(sum(signal * wk), 0), 6) AS same_week_lift FROM m GROUP BY ALL"""


def _signals(spark, sf):
    """Days at or under the 20th percentile of their last 60, with the outcome of the next five."""
    p, w = c("price"), DAY()
    d = P.daily_panel(spark, sf).select("corridor", "day", X.rank_max(p, w, 60).alias("rank"), (L.regret_paid(p, w, 5) <= 25).alias("hit"))
    return d.where("hit is not null").select("corridor", "day", F.year("day").alias("year"), c("hit").cast("int").alias("hit"), F.coalesce(c("rank") <= 0.2, F.lit(False)).cast("int").alias("signal"))


def _rounded(df, by):
    return df.select(*by, "n", "signals", *[r6(k).alias(k) for k in ("hit_rate", "base_rate", "lift", "same_week_lift")])


@query(_EVAL % ("", ""))
def evaluate_positions(spark, sf):
    return _rounded(E.lift(_signals(spark, sf), ["corridor"], hit="hit", signal="signal", week=F.date_trunc("week", "day")), ["corridor"])


@query(_EVAL % ("year,", "year,"))
def evaluate_by_year(spark, sf):
    return _rounded(E.lift(_signals(spark, sf), ["corridor", "year"], hit="hit", signal="signal", week=F.date_trunc("week", "day")), ["corridor", "year"])


@query("""WITH {D}, x AS (SELECT corridor, day, price / lag(price) OVER w - 1 AS r FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day)),
e AS (SELECT corridor, r - avg(r) OVER (PARTITION BY corridor) AS e, avg(r) OVER (PARTITION BY corridor) AS m, count(*) OVER (PARTITION BY corridor) AS n, row_number() OVER (PARTITION BY corridor ORDER BY day) AS i FROM x WHERE r IS NOT NULL),
k AS (SELECT *, greatest(1, least(n - 1, floor(4 * pow(n / 100.0, 2.0 / 9))))::INT AS lags FROM e),
g AS (SELECT a.corridor, b.i - a.i AS k, any_value(a.n) AS n, any_value(a.lags) AS lags, any_value(a.m) AS m, sum(a.e * b.e) / any_value(a.n) AS gamma FROM k a
  JOIN k b ON a.corridor = b.corridor AND b.i >= a.i AND b.i <= a.i + a.lags GROUP BY 1, 2),
v AS (SELECT corridor, any_value(n) AS n, any_value(lags) AS lags, any_value(m) AS m, sum(CASE WHEN k = 0 THEN gamma ELSE 2 * (1 - k / (lags + 1.0)) * gamma END) AS v FROM g GROUP BY 1)
SELECT corridor, n, lags, round(m / sqrt(v / n), 5) AS t FROM v""")
def newey_west(spark, sf):
    r = P.daily_panel(spark, sf).withColumn("r", X.change(c("price"), DAY())).where("r is not null")
    return E.newey_west(r, key="corridor", order="day", value="r").select("corridor", "n", "lags", F.round("t", 5).alias("t"))


@query("""WITH {D}, y AS (SELECT corridor, year(day) AS year, round(avg(price), 2) AS m FROM d GROUP BY 1, 2),
p AS (SELECT a.year, b.corridor, avg(b.m) AS past, count(*) AS years FROM (SELECT DISTINCT year FROM y) a JOIN y b ON b.year < a.year GROUP BY 1, 2),
w AS (SELECT year, corridor, past FROM p WHERE years >= 2 QUALIFY row_number() OVER (PARTITION BY year ORDER BY past, corridor) = 1)
SELECT w.year, w.corridor, round(w.past, 3) AS past_mean, y.m AS year_mean FROM w LEFT JOIN y USING (year, corridor)""")
def nested_selection(spark, sf):
    """Each year the corridor that was cheapest over all earlier years, and how it then did; running means replace the join of years with years."""
    y = P.daily_panel(spark, sf).groupBy("corridor", F.year("day").alias("year")).agg(F.round(F.avg("price"), 2).alias("m"))
    w = Window.partitionBy("corridor").orderBy("year").rangeBetween(Window.unboundedPreceding, -1)
    last = y.agg(F.max("year")).first()[0]
    grid = y.groupBy("corridor").agg(F.explode(F.sequence(F.min("year"), F.lit(last))).alias("year"))
    p = grid.join(y, ["corridor", "year"], "left").withColumn("past", F.avg("m").over(w)).withColumn("years", F.count("m").over(w)).where("years >= 2")
    best = p.withColumn("rn", F.row_number().over(Window.partitionBy("year").orderBy("past", "corridor"))).where("rn = 1")
    return best.select("year", "corridor", F.round("past", 3).alias("past_mean"), c("m").alias("year_mean"))


@query("""WITH {D}, m AS (SELECT corridor, year(day) AS year, round(avg(price), 4) AS v FROM d GROUP BY 1, 2) SELECT a.corridor, a.year, round(a.v - b.v, 4) AS delta
  FROM m a JOIN m b ON a.year = b.year AND b.corridor = '5-LOW' WHERE a.corridor <> '5-LOW'""")
def paired_delta(spark, sf):
    m = P.daily_panel(spark, sf).groupBy("corridor", F.year("day").alias("year")).agg(r4(F.avg("price")).alias("v"))
    base = m.where("corridor = '5-LOW'").select("year", c("v").alias("base"))
    return m.where("corridor <> '5-LOW'").join(base, "year").select("corridor", "year", r4(c("v") - c("base")).alias("delta"))


@query("""WITH {D}, m AS (SELECT corridor, date_trunc('month', day)::DATE AS month, round(avg(price), 4) AS v FROM d GROUP BY 1, 2) SELECT month, corridor, v
  FROM m QUALIFY row_number() OVER (PARTITION BY month ORDER BY v, corridor) = 1""")
def best_by_period(spark, sf):
    m = P.daily_panel(spark, sf).groupBy("corridor", F.trunc("day", "month").alias("month")).agg(r4(F.avg("price")).alias("v"))
    return m.withColumn("rn", F.row_number().over(Window.partitionBy("month").orderBy("v", "corridor"))).where("rn = 1").select("month", "corridor", "v")


@query("""WITH {D}, w AS (SELECT dense_rank() OVER (ORDER BY date_trunc('week', day)) - 1 AS block, sum((price < 120000)::INT) AS hits, count(*) AS n FROM d
  GROUP BY date_trunc('week', day)),
k AS (SELECT i AS draw, (j * (i + 1) * 7) % (SELECT count(*) FROM w) AS block FROM range(20) a(i), range(50) b(j))
SELECT draw, sum(hits) AS hits, sum(n) AS n, round(sum(hits) / sum(n), 6) AS rate FROM k JOIN w USING (block) GROUP BY 1""")
def bootstrap_fixed_index(spark, sf):
    weeks = P.daily_panel(spark, sf).groupBy(F.date_trunc("week", "day").alias("week")).agg(F.count_if(c("price") < 120_000).alias("hits"), F.count("*").alias("n"))
    blocks = weeks.withColumn("block", F.dense_rank().over(Window.orderBy("week")) - 1)  # one row a week of the calendar
    draws = spark.range(20).withColumnRenamed("id", "draw").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(49)))).withColumn("block", (c("j") * (c("draw") + 1) * 7) % F.lit(blocks.count()))
    return E.block_bootstrap(blocks, draws, block="block", sums=["hits", "n"]).select("draw", "hits", "n", r6(c("hits") / c("n")).alias("rate"))


@query(_EVAL.split("SELECT corridor, %s count")[0] % "" + f""", wk AS (SELECT date_trunc('week', day) AS wk, sum(signal) AS signals, sum(signal * hit) AS hits, count(*) AS n, sum(hit) AS base FROM m GROUP BY 1),
b AS (SELECT *, dense_rank() OVER (ORDER BY wk) - 1 AS block, count(*) OVER () AS blocks FROM wk),
z AS (SELECT count(*) AS blocks FROM wk),
k AS (SELECT draw, ({draw_sql("7", "draw", "part")} + k) % blocks AS block FROM z, range(500) a(draw), range(400) x(part), range(4) u(k) WHERE part * 4 + k < blocks),
y AS (SELECT draw, (sum(hits) / nullif(sum(signals), 0)) / nullif(sum(base) / sum(n), 0) AS lift FROM k JOIN b USING (block) GROUP BY 1)
SELECT count(*) AS draws, round(quantile_cont(lift, 0.025), 6) AS low, round(quantile_cont(lift, 0.975), 6) AS high FROM y""")
def bootstrap_ci(spark, sf):
    """2.5 and 97.5 per cent points of the lift of cheap days over 500 circular four-week block draws."""
    s = _signals(spark, sf).groupBy(F.date_trunc("week", "day").alias("week")).agg(F.sum("signal").alias("signals"), F.sum(c("signal") * c("hit")).alias("hits"), F.count("*").alias("n"), F.sum("hit").alias("base"))
    blocks = s.withColumn("block", F.dense_rank().over(Window.orderBy("week")) - 1)
    draws = E.circular_draws(spark, blocks.count(), 4, 500, 7)
    b = E.block_bootstrap(blocks, draws, block="block", sums=["signals", "hits", "n", "base"]).withColumn("lift", F.try_divide(c("hits") / c("signals"), c("base") / c("n")))
    return b.agg(F.count("*").alias("draws"), r6(F.percentile("lift", F.lit(0.025))).alias("low"), r6(F.percentile("lift", F.lit(0.975))).alias("high"))


@query("""WITH {D}, p AS (SELECT corridor, day, price, row_number() OVER (PARTITION BY corridor ORDER BY day) - 1 AS pos, count(*) OVER (PARTITION BY corridor) AS n
  FROM d) SELECT a.corridor, a.day, b.price AS shifted FROM p a JOIN p b ON a.corridor = b.corridor AND (a.pos + 37) % a.n = b.pos""")
def placebo_shift(spark, sf):
    p = P.daily_panel(spark, sf).withColumn("pos", P.position("corridor", "day")).withColumn("n", F.count("*").over(Window.partitionBy("corridor")))
    return p.select("corridor", "day", ((c("pos") + 37) % c("n")).alias("pos")).join(p.select("corridor", "pos", c("price").alias("shifted")), ["corridor", "pos"]).select("corridor", "day", "shifted")


@query("""WITH {D}, m AS (SELECT corridor, year(day) AS year, 1 - round(least(1, greatest(0, avg(price) / 400000)), 6) AS p FROM d GROUP BY 1, 2),
h AS (SELECT *, p * (count(*) OVER (PARTITION BY corridor) - row_number() OVER w + 1) AS s FROM m WINDOW w AS (PARTITION BY corridor ORDER BY p, year))
SELECT corridor, year, round(p, 6) AS p, round(least(1, max(s) OVER (PARTITION BY corridor ORDER BY p, year ROWS UNBOUNDED PRECEDING)), 6) AS holm FROM h""")
def holm_adjust(spark, sf):
    share = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.avg("price") / 400_000))
    m = P.daily_panel(spark, sf).groupBy("corridor", F.year("day").alias("year")).agg((1 - r6(share)).alias("p"))
    return E.holm(m, by=["corridor"], p="p", ties=["year"]).select("corridor", "year", r6("p").alias("p"), r6("holm").alias("holm"))


@query("""WITH {D}, x AS (SELECT corridor, day, price AS y, lag(price) OVER w AS x FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day)) SELECT corridor, day, CASE WHEN regr_count(y, x) OVER w >= 60 THEN round(regr_slope(y, x) OVER w, 5) END AS slope, CASE WHEN regr_count(y, x) OVER w >= 60 THEN round(regr_intercept(y, x) OVER w + (regr_slope(y, x) OVER w) * x, 2) END AS forecast FROM x WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)""")
def expanding_ols(spark, sf):
    w = DAY()
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    d = P.daily_panel(spark, sf).select("corridor", "day", c("price").alias("y"), F.lag("price").over(w).alias("x"))
    d = d.withColumn("k", F.count("x").over(past)).withColumn("b", F.regr_slope("y", "x").over(past)).withColumn("a", F.regr_intercept("y", "x").over(past))
    return d.select("corridor", "day", F.when(c("k") >= 60, F.round("b", 5)).alias("slope"), F.when(c("k") >= 60, F.round(c("a") + c("b") * c("x"), 2)).alias("forecast"))


_SCORES = "s AS (SELECT DISTINCT score_id, horizon, score, target FROM score_frame WHERE score BETWEEN 0 AND 1 AND NOT isnan(score) AND target IS NOT NULL)"


def _scores(spark, sf):
    return P.table(spark, sf, "score_frame").where("score between 0 and 1 and not isnan(score) and target is not null").select("score_id", "horizon", "score", "target").distinct()


@query(f"""WITH {_SCORES}, b AS (SELECT horizon, least(floor(score * 10), 9) AS bin, count(*) AS n, sum(target) AS y, sum(score) AS p, sum((score - target) ** 2) AS b, sum(-(target * ln(least(greatest(score, 1e-6), 1 - 1e-6)) + (1 - target) * ln(1 - least(greatest(score, 1e-6), 1 - 1e-6)))) AS l FROM s GROUP BY 1, 2)
SELECT horizon, sum(n)::BIGINT AS n, round(sum(b) / sum(n), 6) AS brier, round(sum(l) / sum(n), 6) AS log_loss, round(sum(abs(y - p)) / sum(n), 6) AS ece
  FROM b GROUP BY 1""")
def brier_logloss_ece(spark, sf):
    return E.binary_metrics(_scores(spark, sf), ["horizon"], target="target", probability="score").select("horizon", "n", *[r6(k).alias(k) for k in ("brier", "log_loss", "ece")])


@query(f"""WITH {_SCORES}, r AS (SELECT *, avg(rn) OVER (PARTITION BY horizon, score) AS rk
  FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score) AS rn
  FROM s)) SELECT horizon, round((sum(rk * target) - sum(target) * (sum(target) + 1) / 2) / (sum(target) * (count(*) - sum(target))), 6) AS auc FROM r GROUP BY 1""")
def auc(spark, sf):
    return E.auc(_scores(spark, sf), ["horizon"], target="target", score="score").select("horizon", r6("auc").alias("auc"))


_ART = """SELECT event_type AS corridor, date_trunc('hour', ts) AS hour, user_id AS article, min(CAST(json_extract(props, '$.k') AS BIGINT)) AS source, avg(value) AS tone, bool_or(value < 3) AS coercion FROM events GROUP BY 1, 2, 3"""


def _articles(spark, sf):
    """Events collapsed to one row per hour, corridor and article."""
    e = P.table(spark, sf, "events")
    hour = F.date_trunc("hour", c("ts").cast("timestamp")).cast("timestamp_ntz")
    return e.groupBy(c("event_type").alias("corridor"), hour.alias("hour"), c("user_id").alias("article")).agg(F.min(F.get_json_object("props", "$.k").try_cast("long")).alias("source"), F.avg("value").alias("tone"), F.bool_or(c("value") < 3).alias("coercion"))


@query(f"WITH a AS ({_ART}) SELECT corridor, hour, count(*) AS articles, count(DISTINCT source) AS sources, round(avg(tone), 7) AS tone, sum(coercion::INT) AS coercion, round(avg(coercion::INT), 6) AS coercion_share FROM a GROUP BY 1, 2")
def article_collapse_hourly(spark, sf):
    return _articles(spark, sf).groupBy("corridor", "hour").agg(F.count("*").alias("articles"), F.count_distinct("source").alias("sources"), F.round(F.avg("tone"), 7).alias("tone"), F.count_if("coercion").alias("coercion"), r6(F.avg(c("coercion").cast("int"))).alias("coercion_share"))


@query(f"""WITH a AS ({_ART}),
h AS (SELECT corridor, hour, count(*) AS articles FROM a GROUP BY 1, 2),
k AS (SELECT *, hour + INTERVAL 255 MINUTE AS seen FROM h) SELECT corridor, (CASE WHEN hour(seen) * 60 + minute(seen) > 540 THEN CAST(seen AS DATE) + 1 ELSE CAST(seen AS DATE) END) AS decision_date, sum(articles)::BIGINT AS articles FROM k GROUP BY 1, 2""")
def decision_date_routing(spark, sf):
    """Hours become known 75 minutes after they begin; in Moscow, what is known after nine belongs to the next day's decision."""
    h = _articles(spark, sf).groupBy("corridor", "hour").agg(F.count("*").alias("articles"))
    seen = c("hour") + F.expr("INTERVAL 255 MINUTE")
    late = F.hour(seen) * 60 + F.minute(seen) > 9 * 60
    return h.groupBy("corridor", F.date_add(seen.cast("date"), F.when(late, 1).otherwise(0)).alias("decision_date")).agg(F.sum("articles").alias("articles"))


@query("""WITH {H}, g AS (SELECT corridor, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM h GROUP BY 1),
f AS (SELECT corridor, hour, coalesce(n, 0) AS n FROM g LEFT JOIN h USING (corridor, hour))
SELECT corridor, hour, sum(n) OVER a AS n24, sum(n) OVER b AS n72, CASE WHEN count(n) OVER z >= 18 THEN round((n - avg(n) OVER z) / nullif(stddev_samp(n) OVER z, 0), 6) END AS shock_z, CASE WHEN count(n) OVER z >= 72 THEN round((n + 1) / (quantile_cont(n, 0.5) OVER z + 1), 6) END AS shock_ratio
FROM f WINDOW a AS (PARTITION BY corridor ORDER BY hour ROWS 23 PRECEDING),
b AS (PARTITION BY corridor ORDER BY hour ROWS 71 PRECEDING),
z AS (PARTITION BY corridor ORDER BY hour ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING)""")
def news_shock_bank(spark, sf):
    h = P.hourly_panel(spark, sf)
    w = X.series("corridor", "hour")
    g = h.groupBy("corridor").agg(F.explode(F.sequence(F.min("hour"), F.max("hour"), F.expr("INTERVAL 1 HOUR"))).alias("hour"))
    f = g.join(h, ["corridor", "hour"], "left").select("corridor", "hour", F.coalesce("n", F.lit(0)).alias("n"))
    return f.select("corridor", "hour", F.sum("n").over(X.trailing(w, 24)).alias("n24"), F.sum("n").over(X.trailing(w, 72)).alias("n72"), r6(X.zscore(c("n"), w, 72, 18, lag=1)).alias("shock_z"), r6((c("n") + 1) / (X.trailing_quantile(c("n"), w, 72, 0.5, 72) + 1)).alias("shock_ratio"))


@query("""SELECT user_id, session_start, n FROM (SELECT user_id, min(ts) AS session_start, count(*) AS n
  FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS s
  FROM (SELECT *, (coalesce(ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) >= INTERVAL 30 MINUTE, true))::INT AS new FROM events)) GROUP BY user_id, s)""")
def session_windows(spark, sf):
    e = P.table(spark, sf, "events").withColumn("at", c("ts").cast("timestamp"))
    return e.groupBy("user_id", F.session_window("at", "30 minutes").alias("w")).agg(F.count("*").alias("n")).select("user_id", c("w.start").cast("timestamp_ntz").alias("session_start"), "n")

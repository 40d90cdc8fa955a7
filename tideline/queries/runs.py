"""Runners over rules and policies: matrices, grids, evaluation windows, selections and block bootstraps."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.contracts import join_validated
from tideline.functions import windows as X
from tideline.operators import indicators as I
from tideline.operators import labels as L
from tideline.operators import policy as Q
from tideline.operators.draws import draw, draw_sql
from tideline.queries import banks, more
from tideline.queries.registry import SQL, query

c = lambda name: F.col(name)
r4 = lambda x: F.round(x, 4)
r6 = lambda x: F.round(x, 6)
DAY = lambda: X.series("corridor", "day")

_F5 = "f AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 1 FOLLOWING AND 5 FOLLOWING)"
_HITS = f"""e0 AS (SELECT corridor, day, price, greatest(0, (price - min(price) OVER f) / price) * 10000 AS regret FROM d WINDOW {_F5} QUALIFY count(*) OVER f = 5),
e AS (SELECT *, (regret <= 2500)::INT AS hit, avg((regret <= 2500)::INT) OVER (PARTITION BY corridor, date_trunc('week', day)) AS week FROM e0)"""


def _hits(spark, sf):
    """Every day with five later rows, its regret, whether it was a hit, and the hit rate of its corridor and week."""
    e = P.daily_panel(spark, sf).select("corridor", "day", "price", L.regret_paid(c("price"), DAY(), 5).alias("regret")).where("regret is not null")
    e = e.withColumn("hit", (c("regret") <= 2500).cast("int"))
    return e.withColumn("week", F.avg("hit").over(Window.partitionBy("corridor", F.date_trunc("week", "day"))))


def _metrics():
    return [F.count("*").alias("signals"), F.sum("hit").alias("hits"), F.avg("hit").alias("rate"), r6(F.try_divide(F.sum("hit"), F.sum("week"))).alias("same_week_lift"), r4(F.avg("regret")).alias("mean_regret")]


_METRICS = "count(*) AS signals, sum(hit) AS hits, avg(hit) AS rate, round(sum(hit) / nullif(sum(week), 0), 6) AS same_week_lift, round(avg(regret), 4) AS mean_regret"
_FIRED = SQL["signal_grid"].split("WITH ")[1].split("\nSELECT indicator")[0].replace("'filter_rule' AS indicator, '{\"x\":' || x || '}' AS params FROM", "corridor, day, 'filter_rule' AS indicator, '{\"x\":' || x || '}' AS params FROM").replace("SELECT 'level_percentile',", "SELECT corridor, day, 'level_percentile',").replace("SELECT 'momentum_streak',", "SELECT corridor, day, 'momentum_streak',")


@query(f"""WITH {_FIRED}, {_HITS}, a AS (SELECT corridor, day, indicator, params FROM f
UNION ALL SELECT DISTINCT corridor, day, indicator, 'any' FROM f),
b AS (SELECT corridor, avg(hit) AS base FROM e GROUP BY 1),
m AS (SELECT indicator, params, corridor, {_METRICS} FROM a JOIN e USING (corridor, day) GROUP BY 1, 2, 3)
SELECT indicator, params, corridor, signals, hits, round(rate / nullif(base, 0), 6) AS lift, same_week_lift, mean_regret FROM m JOIN b USING (corridor)""")
def indicator_matrix(spark, sf):
    """Every configuration of the grid in every corridor, and every family as the union of its configurations' days; all configurations are evaluated in one pass."""
    d, e = P.daily_panel(spark, sf), _hits(spark, sf)
    s = I.signals(d, I.expand_grid(more.GRID), key="corridor", at="day", price="price").select("corridor", "day", "indicator", "params")
    both = s.unionByName(s.select("corridor", "day", "indicator", F.lit("any").alias("params")).distinct())
    m = both.join(e, ["corridor", "day"]).groupBy("indicator", "params", "corridor").agg(*_metrics())
    base = e.groupBy("corridor").agg(F.avg("hit").alias("base"))
    return m.join(base, "corridor").select("indicator", "params", "corridor", "signals", "hits", r6(F.try_divide(c("rate"), c("base"))).alias("lift"), "same_week_lift", "mean_regret")


@query(SQL["indicator_matrix"].replace("SELECT indicator, params, corridor, signals, hits, round(rate", ", x AS (SELECT indicator, params, corridor, signals, hits, round(rate") + """)
SELECT indicator, params, count(*) AS corridors, sum(signals) AS signals, coalesce(string_agg(CASE WHEN lift > 1 AND same_week_lift > 1 THEN corridor END, ',' ORDER BY corridor), '') AS passing, count(CASE WHEN lift > 1 AND same_week_lift > 1 THEN 1 END) >= 3 AS replicated FROM x GROUP BY 1, 2""")
def corridor_stability(spark, sf):
    """In which corridors a rule beats both baselines, and whether in three or more."""
    both = (c("lift") > 1) & (c("same_week_lift") > 1)
    names = F.concat_ws(",", F.sort_array(F.collect_list(F.when(both, c("corridor")))))
    return indicator_matrix(spark, sf).groupBy("indicator", "params").agg(F.count("*").alias("corridors"), F.sum("signals").alias("signals"), names.alias("passing"), (F.count_if(both) >= 3).alias("replicated"))


_H = SQL["hypotheses_h1_h15"].replace("SELECT corridor, day, hypothesis, round(least(greatest(v, 0), 1), 4) AS strength FROM h", "")


@query(_H + """, o AS (SELECT d.corridor, d.day, x.horizon, lead(price, CAST(x.horizon AS INT)) OVER (PARTITION BY d.corridor, x.horizon ORDER BY d.day) / price - 1 AS forward FROM d, (VALUES (1), (5), (20)) x(horizon)),
p AS (SELECT *, unnest(['all', CAST(year(day) AS VARCHAR)]) AS period FROM o WHERE forward IS NOT NULL),
b AS (SELECT period, horizon, count(*) AS days, avg(forward) AS base FROM p GROUP BY 1, 2)
SELECT hypothesis, period, horizon, count(*) AS signals, any_value(days) AS days, round((avg(forward) - any_value(base)) * 10000, 3) AS excess_bps FROM h
  JOIN p USING (corridor, day) JOIN b USING (period, horizon) GROUP BY 1, 2, 3""")
def hypothesis_windows(spark, sf):
    """Each hypothesis over all years and each year at three horizons: how much further prices moved after it than after any day."""
    d = P.daily_panel(spark, sf).select("corridor", "day", *[(F.lead("price", h).over(DAY()) / c("price") - 1).alias(f"f{h}") for h in (1, 5, 20)])
    o = d.select("corridor", "day", F.inline(F.array(*[F.struct(F.lit(h).alias("horizon"), c(f"f{h}").alias("forward")) for h in (1, 5, 20)]))).where("forward is not null")
    p = o.withColumn("period", F.explode(F.array(F.lit("all"), F.year("day").cast("string"))))
    base = p.groupBy("period", "horizon").agg(F.count("*").alias("days"), F.avg("forward").alias("base"))
    m = banks.hypotheses_h1_h15(spark, sf).join(p, ["corridor", "day"]).groupBy("hypothesis", "period", "horizon").agg(F.count("*").alias("signals"), F.avg("forward").alias("moved"))
    return m.join(base, ["period", "horizon"]).select("hypothesis", "period", "horizon", "signals", "days", F.round((c("moved") - c("base")) * 10_000, 3).alias("excess_bps"))


_POLICY = """q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY day) AS rn, date_trunc('week', day) AS wk FROM cand),
t AS (SELECT key, rn, day, day AS last, wk AS lastwk, 1 AS cnt, true AS kept FROM q WHERE rn = 1
UNION ALL SELECT x.key, x.rn, x.day, CASE WHEN k THEN x.day ELSE last END, CASE WHEN k THEN x.wk ELSE lastwk END, CASE WHEN k THEN CASE WHEN x.wk = lastwk THEN cnt + 1 ELSE 1 END ELSE cnt END, k
FROM (SELECT t.last, t.lastwk, t.cnt, q.*, (CASE WHEN q.wk = t.lastwk THEN t.cnt ELSE 0 END < 2 AND q.day - t.last >= q.cooldown) AS k FROM t
  JOIN q ON q.key = t.key AND q.rn = t.rn + 1) x)"""


@query(f"""WITH RECURSIVE {{D}}, {_HITS}, x AS (SELECT corridor, unnest([0.1, 0.3]) AS share, unnest(quantile_cont(price, [0.1, 0.3])) AS edge FROM e
  WHERE day < DATE '1999-01-01' GROUP BY 1),
g AS (SELECT e.*, share, edge FROM e JOIN x USING (corridor)),
cand AS (SELECT corridor || '|' || share || '|' || cooldown || '|' || gate AS key, corridor, share, cooldown, gate, day
  FROM g, (VALUES (2), (7)) y(cooldown), (VALUES (false), (true)) z(gate) WHERE day >= DATE '1999-01-01' AND price <= edge AND (NOT gate OR isodow(day) <= 3)), {_POLICY}
SELECT corridor, share, cooldown, gate, count(*) AS signals, round(avg(hit), 6) AS hit_rate, round(sum(hit) / nullif(sum(week), 0), 6) AS same_week_lift FROM t
  JOIN (SELECT DISTINCT key, corridor, share, cooldown, gate FROM cand) USING (key) JOIN e USING (corridor, day) WHERE kept GROUP BY 1, 2, 3, 4""")
def policy_grid(spark, sf):
    """Shares by cooldowns by a gate: a threshold per corridor from the training years, then cap and cooldown over the test years."""
    e = _hits(spark, sf)
    shares = (0.1, 0.3)
    edges = e.where("day < '1999-01-01'").groupBy("corridor").agg(F.percentile("price", F.array(*map(F.lit, shares))).alias("q"))
    edges = edges.select("corridor", F.inline(F.array(*[F.struct(F.lit(s).cast("decimal(2,1)").alias("share"), F.get("q", F.lit(i)).alias("edge")) for i, s in enumerate(shares)])))
    cand = e.where("day >= '1999-01-01'").join(edges, "corridor").where("price <= edge").select("corridor", "day", "share", F.explode(F.array(F.lit(False), F.lit(True))).alias("gate")).where(~c("gate") | (F.weekday("day") <= 2))
    parts = None
    for cooldown in (2, 7):
        keyed = cand.select(F.struct("corridor", "share", "gate").alias("key"), "day")
        kept = Q.cap_and_cooldown(keyed, key="key", at="day", cooldown=cooldown, cap=2).select("key.*", "day", F.lit(cooldown).alias("cooldown"))
        parts = kept if parts is None else parts.unionByName(kept)
    return parts.join(e, ["corridor", "day"]).groupBy("corridor", "share", "cooldown", "gate").agg(F.count("*").alias("signals"), r6(F.avg("hit")).alias("hit_rate"), r6(F.try_divide(F.sum("hit"), F.sum("week"))).alias("same_week_lift"))


@query(f"""WITH RECURSIVE {{D}}, g AS (SELECT *, CASE WHEN count(price) OVER w >= 20 THEN quantile_cont(price, 0.3) OVER w END AS edge FROM d
  WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 120 PRECEDING AND 1 PRECEDING)),
cand AS (SELECT corridor AS key, day, 4 AS cooldown FROM g WHERE price <= edge), {_POLICY} SELECT key AS corridor, day FROM t WHERE kept""")
def continuous_policy(spark, sf):
    """A trailing threshold that does not start anew with the year, then cap and cooldown."""
    g = P.daily_panel(spark, sf).withColumn("edge", X.trailing_quantile(c("price"), DAY(), 120, 0.3, 20)).where("price <= edge")
    return Q.cap_and_cooldown(g, key="corridor", at="day", cooldown=4, cap=2)


_RANKED = """l AS (SELECT corridor, day, price, list(price) OVER (PARTITION BY corridor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) AS v FROM d),
k AS (SELECT corridor, day, len(list_filter(v, lambda x: x <= price)) / len(v) AS rank FROM l WHERE len(v) >= 20)"""


@query(f"""WITH {{D}}, {_RANKED}, o AS (SELECT a.corridor, a.day, a.rank, avg((b.rank <= 0.4)::INT) AS share, round(stddev_pop(b.rank), 7) AS spread FROM k a
  JOIN k b ON a.day = b.day AND a.corridor <> b.corridor GROUP BY 1, 2, 3)
SELECT corridor, day, round(rank, 6) AS rank, round(share, 6) AS other_share, round(spread, 4) AS other_spread FROM o
  WHERE rank <= 0.4 AND share >= 0.5 AND spread <= 0.3""")
def agreement_gate(spark, sf):
    """Cheap days on which at least half of the other corridors are cheap too and their ranks lie close together; the others' figures come from sums less one's own."""
    k = P.daily_panel(spark, sf).select("corridor", "day", X.causal_percentile(c("price"), DAY(), 60, 20).alias("rank")).where("rank is not null")
    w = Window.partitionBy("day")
    cheap = (c("rank") <= 0.4).cast("int")
    k = k.withColumns({"n": F.count("*").over(w) - 1, "s": F.sum("rank").over(w) - c("rank"), "q": F.sum(c("rank") * c("rank")).over(w) - c("rank") * c("rank"), "m": F.sum(cheap).over(w) - cheap}).where("n > 0")
    spread = F.sqrt(F.greatest(F.lit(0.0), c("q") / c("n") - F.pow(c("s") / c("n"), F.lit(2.0))))
    k = k.withColumns({"share": c("m") / c("n"), "spread": F.round(F.when(c("n") == 1, 0.0).otherwise(spread), 7)})
    return k.where("rank <= 0.4 and share >= 0.5 and spread <= 0.3").select("corridor", "day", r6("rank").alias("rank"), r6("share").alias("other_share"), r4("spread").alias("other_spread"))


@query(f"""WITH {{D}}, g AS (SELECT *, row_number() OVER (PARTITION BY corridor ORDER BY day) AS pos, CASE WHEN count(price) OVER w >= 20 THEN quantile_cont(price, 0.4) OVER w END AS edge, count(*) OVER f AS ahead, greatest(0, (price - min(price) OVER f) / price) * 10000 AS regret FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), {_F5}),
k AS (SELECT *, price / edge AS score, row_number() OVER (PARTITION BY corridor ORDER BY pos) AS k, count(*) OVER (PARTITION BY corridor ORDER BY pos RANGE BETWEEN UNBOUNDED PRECEDING AND 5 PRECEDING) AS m FROM g WHERE price <= edge AND ahead = 5),
j AS (SELECT a.corridor, a.day, b.regret, row_number() OVER (PARTITION BY a.corridor, a.k ORDER BY abs(round(b.score - a.score, 9)), b.k DESC) AS near FROM k a
  JOIN k b ON a.corridor = b.corridor AND b.k BETWEEN a.m - 59 AND a.m WHERE a.m >= 30),
u AS (SELECT corridor, day, regret, row_number() OVER (PARTITION BY corridor, day ORDER BY regret) AS r, count(*) OVER (PARTITION BY corridor, day) AS n
  FROM j WHERE near <= 20)
SELECT corridor, day, round(regret, 4) AS upper_bps FROM u WHERE r = ceil(0.8 * (n - 1)) + 1 AND regret <= 5000""")
def selective_knn(spark, sf):
    """Candidates whose twenty nearest matured candidates by score, of the last sixty, had a small upper regret. Each candidate meets its bounded history by an equi-join on the candidate's number."""
    w, p = DAY(), c("price")
    g = P.daily_panel(spark, sf).select("corridor", "day", "price", F.row_number().over(w).alias("pos"), X.trailing_quantile(p, w, 60, 0.4, 20).alias("edge"), L.regret_paid(p, w, 5).alias("regret"))
    by = Window.partitionBy("corridor").orderBy("pos")
    k = g.where("price <= edge and regret is not null").select("corridor", "day", "pos", "regret", (p / c("edge")).alias("score"), F.row_number().over(by).alias("k"), F.count("*").over(by.rangeBetween(Window.unboundedPreceding, -5)).alias("m"))
    asked = k.where("m >= 30").select("corridor", "day", "score", F.explode(F.sequence(F.greatest(F.lit(1), c("m") - 59), c("m"))).alias("k"))
    j = asked.join(k.select("corridor", c("k").cast("long").alias("k"), c("score").alias("other"), "regret"), ["corridor", "k"])
    near = F.row_number().over(Window.partitionBy("corridor", "day").orderBy(F.abs(F.round(c("other") - c("score"), 9)), c("k").desc()))
    j = j.withColumn("near", near).where("near <= 20")
    u = j.withColumns({"r": F.row_number().over(Window.partitionBy("corridor", "day").orderBy("regret")), "n": F.count("*").over(Window.partitionBy("corridor", "day"))})
    return u.where((c("r") == F.ceil(0.8 * (c("n") - 1)) + 1) & (c("regret") <= 5000)).select("corridor", "day", r4("regret").alias("upper_bps"))


@query("""WITH {D}, p AS (SELECT corridor, day, row_number() OVER (PARTITION BY corridor ORDER BY day) AS pos, count(*) OVER (PARTITION BY corridor) AS n FROM d)
SELECT corridor, CASE WHEN pos > n - 250 THEN 'select' WHEN pos <= n - 255 THEN 'fit' ELSE 'purged' END AS part, count(*) AS rows, min(day) AS first_day, max(day) AS last_day FROM p GROUP BY 1, 2""")
def inner_split(spark, sf):
    """The last 250 rows of each series select, the horizon before them is purged, the rest fits."""
    w = Window.partitionBy("corridor")
    p = P.daily_panel(spark, sf).select("corridor", "day", F.row_number().over(DAY()).alias("pos"), F.count("*").over(w).alias("n"))
    part = F.when(c("pos") > c("n") - 250, "select").when(c("pos") <= c("n") - 255, "fit").otherwise("purged")
    return p.groupBy("corridor", part.alias("part")).agg(F.count("*").alias("rows"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


_SCORES = "s AS (SELECT DISTINCT score_id, timestamp, variant, corridor, horizon, score, regret_bps FROM score_frame WHERE score IS NOT NULL AND NOT isnan(score) AND timestamp IS NOT NULL)"


def _scores(spark, sf):
    s = P.table(spark, sf, "score_frame").where("score is not null and not isnan(score) and timestamp is not null")
    return s.select("score_id", "timestamp", "variant", "corridor", "horizon", "score", "regret_bps").distinct()


@query(f"""WITH {_SCORES}, v AS (SELECT corridor, horizon, CAST(timestamp AS DATE) AS day, variant, avg(score) AS score FROM s GROUP BY 1, 2, 3, 4)
SELECT corridor, horizon, day, count(*) AS members, round(avg(score) + 1e-9, 6) AS mean, round(stddev_pop(score) + 1e-9, 5) AS spread, round(avg(score) - 0.5 * stddev_pop(score) + 1e-9, 5) AS lower_bound, round(min(score) + 1e-9, 6) AS least FROM v GROUP BY 1, 2, 3""")
def seed_ensemble(spark, sf):
    """What the members of an ensemble say of a day: mean, spread, the mean less half the spread, the least."""
    v = _scores(spark, sf).groupBy("corridor", "horizon", c("timestamp").cast("date").alias("day"), "variant").agg(F.avg("score").alias("score"))
    mean, spread, nudge = F.avg("score"), F.stddev_pop("score"), F.lit(1e-9)  # halves round up in any engine
    return v.groupBy("corridor", "horizon", "day").agg(F.count("*").alias("members"), r6(mean + nudge).alias("mean"), F.round(spread + nudge, 5).alias("spread"), F.round(mean - 0.5 * spread + nudge, 5).alias("lower_bound"), r6(F.min("score") + nudge).alias("least"))


@query(f"""WITH {_SCORES}, t AS (SELECT variant, corridor, horizon, quantile_disc(score, 0.9) AS edge FROM s WHERE timestamp < TIMESTAMP '2025-01-01' GROUP BY 1, 2, 3)
SELECT variant, corridor, horizon, round(any_value(edge), 6) AS threshold, count(*) AS selected FROM s JOIN t USING (variant, corridor, horizon)
  WHERE score >= edge GROUP BY 1, 2, 3""")
def refit_threshold(spark, sf):
    """The ninth decile of the training scores, and how many rows reach it."""
    s = _scores(spark, sf)
    t = s.where("timestamp < '2025-01-01'").groupBy("variant", "corridor", "horizon").agg(F.expr("percentile_disc(0.9) within group (order by score)").alias("edge"))
    return s.join(t, ["variant", "corridor", "horizon"]).where("score >= edge").groupBy("variant", "corridor", "horizon").agg(r6(F.max("edge")).alias("threshold"), F.count("*").alias("selected"))


_BY_YEAR = f"""{_SCORES}, y AS (SELECT variant, corridor, year(timestamp) AS year, count(*) AS n, round(avg(regret_bps), 4) AS regret FROM s
  WHERE regret_bps IS NOT NULL AND NOT isnan(regret_bps) GROUP BY 1, 2, 3),
v AS (SELECT variant, corridor, sum(n) AS n, round(sum(n * regret) / sum(n), 3) AS mean, max(regret) AS worst FROM y GROUP BY 1, 2)"""


def _by_year(spark, sf):
    y = _scores(spark, sf).where("regret_bps is not null and not isnan(regret_bps)").groupBy("variant", "corridor", F.year("timestamp").alias("year")).agg(F.count("*").alias("n"), r4(F.avg("regret_bps")).alias("regret"))
    return y.groupBy("variant", "corridor").agg(F.sum("n").alias("n"), F.round(F.sum(c("n") * c("regret")) / F.sum("n"), 3).alias("mean"), F.max("regret").alias("worst"))


@query(f"WITH {_BY_YEAR}, t AS (SELECT * FROM v ORDER BY mean, variant, corridor LIMIT 10) SELECT variant, corridor, n, mean, worst FROM t ORDER BY worst, variant, corridor LIMIT 1")
def stability_pick(spark, sf):
    """Of the ten best by mean the one whose worst year is best."""
    return _by_year(spark, sf).orderBy("mean", "variant", "corridor").limit(10).orderBy("worst", "variant", "corridor").limit(1)


@query(f"WITH {_BY_YEAR} SELECT corridor, variant, n, mean, worst FROM v WHERE n >= 20 QUALIFY row_number() OVER (PARTITION BY corridor ORDER BY mean, worst, n DESC, variant) = 1")
def preregistered_winner(spark, sf):
    """Each corridor's winner by a rule fixed beforehand: enough rows, then mean, worst year, size and name; none if no variant has enough."""
    w = Window.partitionBy("corridor").orderBy("mean", "worst", c("n").desc(), "variant")
    return _by_year(spark, sf).where("n >= 20").withColumn("rn", F.row_number().over(w)).where("rn = 1").select("corridor", "variant", "n", "mean", "worst")


@query("""WITH {D}, r AS (SELECT corridor, day, price / lag(price) OVER w - 1 AS r1, price / lag(price, 5) OVER w - 1 AS r5, (price - avg(price) OVER t) / nullif(stddev_samp(price) OVER t, 0) AS z, ln(1 + n) - lag(ln(1 + n)) OVER w AS a FROM d WINDOW w AS (PARTITION BY corridor ORDER BY day),
t AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING)),
u AS (SELECT corridor, day, unnest(['returns', 'returns', 'level', 'activity']) AS family, unnest([r1 * 0.8, r5 * 0.5, z * -0.3, a * 0.2]) AS part FROM r),
g AS (SELECT corridor, day, family, round(sum(part), 6) AS contribution FROM u WHERE part IS NOT NULL GROUP BY 1, 2, 3)
SELECT corridor, day, family, contribution, row_number() OVER (PARTITION BY corridor, day ORDER BY abs(contribution) DESC, family) AS rank FROM g QUALIFY rank <= 3""")
def top_families(spark, sf):
    """The three feature families that move a linear score most on each day, by the size of their summed contributions."""
    p, w = c("price"), DAY()
    log = F.log1p("n")
    z = F.try_divide(p - F.avg("price").over(X.trailing(w, 20)), F.nullif(F.stddev_samp("price").over(X.trailing(w, 20)), F.lit(0.0)))
    parts = [("returns", X.change(p, w) * 0.8), ("returns", X.change(p, w, 5) * 0.5), ("level", z * -0.3), ("activity", (log - F.lag(log).over(w)) * 0.2)]
    wide = P.daily_panel(spark, sf).select("corridor", "day", *[v.alias(f"p{i}") for i, (_, v) in enumerate(parts)])
    u = wide.select("corridor", "day", F.inline(F.array(*[F.struct(F.lit(k).alias("family"), c(f"p{i}").alias("part")) for i, (k, _) in enumerate(parts)]))).where("part is not null")
    g = u.groupBy("corridor", "day", "family").agg(r6(F.sum("part")).alias("contribution"))
    return g.withColumn("rank", F.row_number().over(Window.partitionBy("corridor", "day").orderBy(F.abs("contribution").desc(), "family"))).where("rank <= 3")


@query(f"""WITH {{D}}, {_HITS}, g AS (SELECT e.*, year(day) AS year, price / (min(price) OVER (PARTITION BY corridor ORDER BY day ROWS 59 PRECEDING)) - 1 AS over FROM e),
q AS (SELECT a.corridor, a.year, quantile_cont(b.over, 0.2) AS edge FROM (SELECT DISTINCT corridor, year FROM g) a
  JOIN g b ON a.corridor = b.corridor AND b.year = a.year - 1 GROUP BY 1, 2),
s AS (SELECT g.* FROM g JOIN q USING (corridor, year) WHERE over <= edge QUALIFY row_number() OVER (PARTITION BY corridor, date_trunc('week', day) ORDER BY day) <= 2)
SELECT corridor, year, count(*) AS signals, round(avg(hit), 6) AS hit_rate, round(sum(hit) / nullif(sum(week), 0), 6) AS same_week_lift FROM s GROUP BY 1, 2""")
def heuristic_comparator(spark, sf):
    """Days near their 60-row low by the year before's fifth, the first two of each week, measured like any model."""
    g = _hits(spark, sf).withColumn("year", F.year("day")).withColumn("over", c("price") / F.min("price").over(X.trailing(DAY(), 60)) - 1)
    q = g.groupBy("corridor", (c("year") + 1).alias("year")).agg(F.percentile("over", F.lit(0.2)).alias("edge"))
    s = Q.first_per_week(g.join(q, ["corridor", "year"]).where("over <= edge"), key="corridor", at="day", n=2)
    return s.groupBy("corridor", "year").agg(F.count("*").alias("signals"), r6(F.avg("hit")).alias("hit_rate"), r6(F.try_divide(F.sum("hit"), F.sum("week"))).alias("same_week_lift"))


@query(f"""WITH {{D}}, {_HITS}, g AS (SELECT *, year(day) AS year, (price < 120000)::INT AS s FROM e),
y AS (SELECT corridor, year, count(*) AS n, sum(s) AS signals, sum(s * hit) AS hits, sum(s * week) AS expected, avg(hit) AS base FROM g GROUP BY 1, 2),
p AS (SELECT * FROM y WHERE signals >= 10 AND hits > expected) SELECT corridor, count(*) AS folds, sum(n)::BIGINT AS days, sum(signals)::BIGINT AS signals, round(sum(hits) / sum(signals), 6) AS hit_rate, round(sum(hits) / sum(expected), 6) AS same_week_lift FROM p GROUP BY 1""")
def pooled_product(spark, sf):
    """Only promoted years are pooled, and measured against the days of those years."""
    g = _hits(spark, sf).withColumns({"year": F.year("day"), "s": (c("price") < 120_000).cast("int")})
    y = g.groupBy("corridor", "year").agg(F.count("*").alias("n"), F.sum("s").alias("signals"), F.sum(c("s") * c("hit")).alias("hits"), F.sum(c("s") * c("week")).alias("expected"))
    p = y.where("signals >= 10 and hits > expected").groupBy("corridor")
    return p.agg(F.count("*").alias("folds"), F.sum("n").alias("days"), F.sum("signals").alias("signals"), r6(F.sum("hits") / F.sum("signals")).alias("hit_rate"), r6(F.sum("hits") / F.sum("expected")).alias("same_week_lift"))


_WEEKS = f"""{_HITS}, v AS (SELECT *, quantile_cont(price, 0.4) OVER (PARTITION BY corridor) AS q4, quantile_cont(price, 0.2) OVER (PARTITION BY corridor) AS q2 FROM e),
wk AS (SELECT date_trunc('week', day) AS wk, sum((price <= q4)::INT * hit) AS h4, sum((price <= q4)::INT * week) AS x4, sum((price <= q2)::INT * hit) AS h2, sum((price <= q2)::INT * week) AS x2 FROM v GROUP BY 1),
b AS (SELECT CAST(floor((dense_rank() OVER (ORDER BY wk) - 1) / 8) AS BIGINT) AS block, * FROM wk),
bl AS (SELECT block, sum(h4) AS h4, sum(x4) AS x4, sum(h2) AS h2, sum(x2) AS x2 FROM b GROUP BY 1),
n AS (SELECT count(*) AS n FROM bl)"""


@query(f"""WITH {{D}}, {_WEEKS}, k AS (SELECT draw, part, {draw_sql("'delta'", "draw", "part")} % n AS block FROM n, range(200) a(draw), range(1000) p(part) WHERE part < n),
s AS (SELECT draw, sum(h2) / nullif(sum(x2), 0) - sum(h4) / nullif(sum(x4), 0) AS delta FROM k JOIN bl USING (block) GROUP BY 1)
SELECT count(delta) AS draws, round(avg(delta), 6) AS mean, round(quantile_cont(delta, 0.025), 6) AS low, round(quantile_cont(delta, 0.975), 6) AS high, round((1 + sum((delta <= 0)::INT)) / (count(delta) + 1), 6) AS p FROM s""")
def delta_bootstrap(spark, sf):
    """How much better the cheapest fifth does than the cheapest two fifths, over draws of fixed eight-week blocks; blocks are added up once, so a draw costs one row a block."""
    e = _hits(spark, sf)
    q = e.groupBy("corridor").agg(F.percentile("price", F.array(F.lit(0.4), F.lit(0.2))).alias("q"))
    v = e.join(q, "corridor").withColumns({f"s{k}": (c("price") <= F.get("q", F.lit(i))).cast("int") for i, k in enumerate((4, 2))})
    wk = v.groupBy(F.date_trunc("week", "day").alias("wk")).agg(*[x for k in (4, 2) for x in (F.sum(c(f"s{k}") * c("hit")).alias(f"h{k}"), F.sum(c(f"s{k}") * c("week")).alias(f"x{k}"))])
    b = wk.withColumn("block", F.floor((F.dense_rank().over(Window.orderBy("wk")) - 1) / 8))  # one row a week of the calendar
    bl = b.groupBy("block").agg(*[F.sum(k).alias(k) for k in ("h4", "x4", "h2", "x2")])
    n = bl.count()
    k = spark.range(200).withColumnRenamed("id", "draw").withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).withColumn("block", draw(F.lit("delta"), "draw", "part") % n)
    lift = lambda i: F.try_divide(F.sum(f"h{i}"), F.nullif(F.sum(f"x{i}"), F.lit(0.0)))
    s = k.join(bl, "block").groupBy("draw").agg((lift(2) - lift(4)).alias("delta"))
    return s.agg(F.count("delta").alias("draws"), r6(F.avg("delta")).alias("mean"), r6(F.percentile("delta", F.lit(0.025))).alias("low"), r6(F.percentile("delta", F.lit(0.975))).alias("high"), r6((1 + F.count_if(c("delta") <= 0)) / (F.count("delta") + 1)).alias("p"))


@query(f"""WITH {{D}}, {_HITS}, g AS (SELECT *, year(day) AS year, (price < 120000)::INT AS s FROM e),
p AS (SELECT corridor, year, row_number() OVER w - 1 AS start, count(*) OVER (PARTITION BY corridor, year) AS n, sum(s) OVER b AS s, sum(s * hit) OVER b AS h, sum(hit) OVER b AS a, count(*) OVER b AS m FROM g WINDOW w AS (PARTITION BY corridor, year ORDER BY day),
b AS (PARTITION BY corridor, year ORDER BY day ROWS BETWEEN CURRENT ROW AND 4 FOLLOWING)),
f AS (SELECT DISTINCT corridor, year, n FROM p WHERE n >= 20),
k AS (SELECT corridor, year, draw, {draw_sql("'fold'", "corridor", "year", "draw", "part")} % (n - 4) AS start FROM f, range(100) x(draw), range(400) y(part)
  WHERE part < n // 5),
l AS (SELECT corridor, year, draw, (sum(h) / nullif(sum(s), 0)) / nullif(sum(a) / sum(m), 0) AS lift FROM k JOIN p USING (corridor, year, start) GROUP BY 1, 2, 3)
SELECT corridor, year, count(lift) AS draws, round(quantile_cont(lift, 0.025), 6) AS low, round(quantile_cont(lift, 0.975), 6) AS high FROM l GROUP BY 1, 2""")
def fold_bootstrap(spark, sf):
    """The range of each fold's lift over draws of blocks of five rows that stay within the fold."""
    g = _hits(spark, sf).withColumns({"year": F.year("day"), "s": (c("price") < 120_000).cast("int")})
    w = Window.partitionBy("corridor", "year").orderBy("day")
    b = w.rowsBetween(0, 4)
    p = g.select("corridor", "year", (F.row_number().over(w) - 1).cast("long").alias("start"), F.count("*").over(Window.partitionBy("corridor", "year")).alias("n"), F.sum("s").over(b).alias("s"), F.sum(c("s") * c("hit")).over(b).alias("h"), F.sum("hit").over(b).alias("a"), F.count("*").over(b).alias("m"))
    k = p.where("n >= 20").select("corridor", "year", "n").distinct().withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(99)))).withColumn("part", F.explode(F.sequence(F.lit(0), F.floor(c("n") / 5).cast("int") - 1)))
    k = k.select("corridor", "year", "draw", (draw(F.lit("fold"), "corridor", "year", "draw", "part") % (c("n") - 4)).alias("start"))
    lift = F.try_divide(F.sum("h") / F.nullif(F.sum("s"), F.lit(0)), F.nullif(F.sum("a") / F.sum("m"), F.lit(0.0)))
    x = k.join(p.drop("n"), ["corridor", "year", "start"]).groupBy("corridor", "year", "draw").agg(lift.alias("lift"))
    return x.groupBy("corridor", "year").agg(F.count("lift").alias("draws"), r6(F.percentile("lift", F.lit(0.025))).alias("low"), r6(F.percentile("lift", F.lit(0.975))).alias("high"))


@query(f"""WITH {{D}}, r AS (SELECT corridor, day, price / lag(price) OVER (PARTITION BY corridor ORDER BY day) - 1 AS r FROM d),
p AS (SELECT corridor, day, r, row_number() OVER w AS pos, stddev_samp(r) OVER t20 AS near, stddev_samp(r) OVER t252 AS far FROM r WHERE r IS NOT NULL
  WINDOW w AS (PARTITION BY corridor ORDER BY day),
t20 AS (PARTITION BY corridor ORDER BY day ROWS 19 PRECEDING),
t252 AS (PARTITION BY corridor ORDER BY day ROWS 251 PRECEDING)),
l AS (SELECT corridor, day, pos AS n, least(greatest(near / far, 0.5), 2) AS scale FROM p WHERE pos >= 126
  QUALIFY row_number() OVER (PARTITION BY corridor, year(day) ORDER BY day DESC) = 1),
k AS (SELECT l.*, draw, 1 + {draw_sql("'path'", "corridor", "n", "draw")} % (n - 4) AS start FROM l, range(60) x(draw)),
c AS (SELECT k.corridor, k.day, k.draw, sum(ln(1 + greatest(p.r * scale, -0.99))) OVER (PARTITION BY k.corridor, k.day, k.draw ORDER BY p.pos) AS path FROM k
  JOIN p ON p.corridor = k.corridor AND p.pos BETWEEN k.start AND k.start + 4),
m AS (SELECT corridor, day, draw, min(path) AS low FROM c GROUP BY 1, 2, 3) SELECT corridor, day, round(avg((low >= -ln(1 + 0.25))::INT), 6) AS safe FROM m
  GROUP BY 1, 2""")
def path_bootstrap(spark, sf):
    """At the end of each year, the share of paths of five resampled past returns, scaled to the latest volatility, that never fall by a fifth."""
    w = DAY()
    p = P.daily_panel(spark, sf).select("corridor", "day", X.change(c("price"), w).alias("r")).where("r is not null")
    scale = F.least(F.greatest(F.stddev_samp("r").over(X.trailing(w, 20)) / F.stddev_samp("r").over(X.trailing(w, 252)), F.lit(0.5)), F.lit(2.0))
    p = p.select("corridor", "day", "r", F.row_number().over(w).cast("long").alias("pos"), scale.alias("scale"))
    last = p.where("pos >= 126").withColumn("rn", F.row_number().over(Window.partitionBy("corridor", F.year("day")).orderBy(c("day").desc()))).where("rn = 1").select("corridor", "day", c("pos").alias("n"), "scale")
    k = last.withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(59)))).withColumn("start", 1 + draw(F.lit("path"), "corridor", "n", "draw") % (c("n") - 4))
    step = k.withColumn("pos", F.explode(F.sequence(c("start"), c("start") + 4))).join(p.select("corridor", "pos", "r"), ["corridor", "pos"])
    path = F.sum(F.log1p(F.greatest(c("r") * c("scale"), F.lit(-0.99)))).over(Window.partitionBy("corridor", "day", "draw").orderBy("pos"))
    low = step.withColumn("path", path).groupBy("corridor", "day", "draw").agg(F.min("path").alias("low"))
    return low.groupBy("corridor", "day").agg(r6(F.avg((c("low") >= -F.log(F.lit(1.25))).cast("int"))).alias("safe"))


@query(f"""WITH {_SCORES}, m AS (SELECT variant, horizon, count(*) AS n, round(avg(score) + 1e-9, 6) AS mean, round(max(score) + 1e-9, 6) AS top FROM s GROUP BY 1, 2)
SELECT variant, horizon, measure, value FROM (SELECT variant, horizon, CAST(n AS DOUBLE) AS n, mean, top FROM m) UNPIVOT (value FOR measure IN (n, mean, top))""")
def unpivot_scores(spark, sf):
    """A summary with a column a measure as one row a measure."""
    m = _scores(spark, sf).groupBy("variant", "horizon").agg(F.count("*").cast("double").alias("n"), r6(F.avg("score") + 1e-9).alias("mean"), r6(F.max("score") + 1e-9).alias("top"))
    return m.unpivot(["variant", "horizon"], ["n", "mean", "top"], "measure", "value")


@query(f"""WITH {_SCORES}, m AS (SELECT variant, horizon, count(*) AS n, round(avg(regret_bps), 4) AS regret FROM s
  WHERE regret_bps IS NOT NULL AND NOT isnan(regret_bps) GROUP BY 1, 2)
SELECT horizon, variant, n, regret, n >= 10 AS gated FROM m QUALIFY row_number() OVER (PARTITION BY horizon ORDER BY (n >= 10)::INT DESC, regret, variant) = 1""")
def best_by_horizon(spark, sf):
    """Each horizon's best variant among those with enough rows, else among all."""
    m = _scores(spark, sf).where("regret_bps is not null and not isnan(regret_bps)").groupBy("variant", "horizon").agg(F.count("*").alias("n"), r4(F.avg("regret_bps")).alias("regret")).withColumn("gated", c("n") >= 10)
    w = Window.partitionBy("horizon").orderBy(c("gated").desc(), "regret", "variant")
    return m.withColumn("rn", F.row_number().over(w)).where("rn = 1").select("horizon", "variant", "n", "regret", "gated")


@query(f"""WITH {{D}}, {_HITS}, i AS (SELECT corridor, day, price, row_number() OVER (PARTITION BY corridor ORDER BY day) AS id
  FROM d) SELECT corridor, id, day, price, hit FROM i LEFT JOIN e USING (corridor, day, price)""")
def join_one_to_one(spark, sf):
    """Rows numbered in order, their outcomes computed apart, and both joined by that number, which must be unique on either side; the number gives the order back."""
    i = P.daily_panel(spark, sf).select("corridor", F.row_number().over(DAY()).alias("id"), "day", "price")
    e = i.join(_hits(spark, sf).select("corridor", "day", "hit"), ["corridor", "day"], "left").select("corridor", "id", "hit")
    return join_validated(i, e, ["corridor", "id"], cardinality="one_to_one").select("corridor", "id", "day", "price", "hit")

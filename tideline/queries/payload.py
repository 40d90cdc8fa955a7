"""The payload parsers over small payloads built from the given tables, against SQL that reads the same tables directly: what a parser yields must be what was written."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tideline import panel as P
from tideline.queries.registry import query
from tideline.sources import payloads as R

c = lambda name: F.col(name)


def _comma(x):
    return F.regexp_replace(x.cast("string"), r"\.", ",")


CORRIDORS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW"]
_DAYS = "SELECT o_orderpriority AS ccy, CAST(o_orderdate AS DATE) AS rate_date, CAST(1 + count(*) % 10 AS INT) AS nominal, CAST(count(*) AS DOUBLE) + 0.25 AS rate FROM orders GROUP BY 1, 2"


_TOTAL = "SELECT CAST(o_orderdate AS DATE) AS rate_date, CAST(1 + count(*) % 10 AS INT) AS nominal, CAST(count(*) AS DOUBLE) + 0.25 AS rate FROM orders GROUP BY 1"


def _total(spark, sf):
    """One rate a day over all orders."""
    return P.table(spark, sf, "orders").groupBy(c("o_orderdate").cast("date").alias("rate_date")).agg((1 + F.count("*") % 10).cast("int").alias("nominal"), (F.count("*").cast("double") + 0.25).alias("rate"))


def _rates(spark, sf):
    """A rate of every corridor and day with a nominal, from the orders of the day."""
    return P.table(spark, sf, "orders").groupBy(c("o_orderpriority").alias("ccy"), c("o_orderdate").cast("date").alias("rate_date")).agg((1 + F.count("*") % 10).cast("int").alias("nominal"), (F.count("*").cast("double") + 0.25).alias("rate"))


@query(f"SELECT ccy, rate_date, nominal, rate AS rate_rub FROM ({_DAYS})")
def parse_rates_xml(spark, sf):
    """One XML document a corridor."""
    record = F.concat(F.lit('<Record Date="'), F.date_format("rate_date", "dd.MM.yyyy"), F.lit('" Id="R1"><Nominal>'), c("nominal").cast("string"), F.lit("</Nominal><Value>"), _comma(c("rate")), F.lit("</Value></Record>"))
    xml = _rates(spark, sf).select("ccy", record.alias("r")).groupBy("ccy").agg(F.concat(F.lit("<ValCurs>"), F.concat_ws("", F.collect_list("r")), F.lit("</ValCurs>")).alias("text"))
    return R.daily_rates_xml(xml)


@query(f"SELECT rate_date, ccy, nominal, round(rate / nominal, 9) AS per_unit, rate_date + 1 AS known_at FROM ({_DAYS})")
def parse_bank_rates_json(spark, sf):
    """One JSON array a day."""
    item = F.struct(c("ccy").alias("Ccy"), c("nominal").cast("string").alias("Nominal"), c("rate").cast("string").alias("Rate"), F.date_format("rate_date", "dd.MM.yyyy").alias("Date"))
    text = _rates(spark, sf).groupBy("rate_date").agg(F.to_json(F.collect_list(item)).alias("text")).select("text")
    return R.bank_rates_json(text, currencies=CORRIDORS).withColumn("per_unit", F.round("per_unit", 9))


@query(f"""SELECT rate_date + 1 AS rate_date, {", ".join(f"round(max(CASE WHEN ccy = '{k}' THEN rate / nominal END), 9) AS c{k[0]}" for k in CORRIDORS)} FROM ({_DAYS}) GROUP BY 1""")
def rates_wide(spark, sf):
    """The official rates side by side, each usable the day after."""
    wide = R.rates_wide(_rates(spark, sf).withColumn("per_unit", F.round(c("rate") / c("nominal"), 9)), CORRIDORS, lag_days=1)
    return wide.select("rate_date", *[c(f"`{k}`").alias(f"c{k[0]}") for k in CORRIDORS])


@query("SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, CAST(n_regionkey AS VARCHAR) AS region FROM nation")
def parse_column_table(spark, sf):
    """A JSON block of columns and rows, a page a region; columns are found by name, an absent one by its alias."""
    rows = P.table(spark, sf, "nation").groupBy("n_regionkey").agg(F.collect_list(F.array(c("n_name"), c("n_nationkey").cast("string"), c("n_regionkey").cast("string"))).alias("data"))
    block = F.struct(F.struct(F.array(F.lit("NAME"), F.lit("ID"), F.lit("REGION")).alias("columns"), c("data").alias("data")).alias("history"))
    return R.column_table_json(rows.select(F.to_json(block).alias("text")), block="history", aliases={"id": ["KEY", "ID"], "name": ["NAME"], "region": ["REGION"]})


@query(f"SELECT rate_date, round(1 + rate / 100, 9) AS rate_pct FROM ({_TOTAL})")
def parse_key_rate_html(spark, sf):
    """Cells of an HTML table, a page a year."""
    row = F.concat(F.lit("<tr><td>"), F.date_format("rate_date", "dd.MM.yyyy"), F.lit("</td><td> "), _comma(F.round(1 + c("rate") / 100, 9)), F.lit(" </td></tr>"))
    html = _total(spark, sf).groupBy(F.year("rate_date")).agg(F.concat_ws("\n", F.collect_list(row)).alias("text")).select("text")
    return R.key_rate_html(html).select("rate_date", F.round("rate_pct", 9).alias("rate_pct"))


@query(f"SELECT rate_date AS date, rate AS value, 'ORDERS' AS series FROM ({_TOTAL}) WHERE nominal <> 2")
def parse_fred_csv(spark, sf):
    """Lines with a header in which a dot stands for no value."""
    line = F.concat_ws(",", F.date_format("rate_date", "yyyy-MM-dd"), F.when(c("nominal") == 2, ".").otherwise(c("rate").cast("string")))
    lines = _total(spark, sf).select(line.alias("value"))
    return R.fred_csv(lines.unionByName(spark.createDataFrame([("observation_date,VALUE",)], "value string")), series="ORDERS")


@query("""SELECT event_type AS series, CAST(ts AS DATE) AS date, CAST(count(*) AS DOUBLE) AS article_count, CAST(count(*) + 100 AS DOUBLE) AS all_article_count, round(count(*) / (count(*) + 100), 9) AS article_share FROM events WHERE ts IS NOT NULL GROUP BY 1, 2""")
def parse_timeline_json(spark, sf):
    """One timeline document a series."""
    e = P.table(spark, sf, "events").where("ts is not null").groupBy(c("event_type").alias("series"), c("ts").cast("date").alias("day")).agg(F.count("*").cast("double").alias("value"))
    point = F.struct(F.date_format("day", "yyyyMMdd'T000000Z'").alias("date"), "value", (c("value") + 100).alias("norm"))
    doc = e.groupBy("series").agg(F.collect_list(point).alias("data")).select("series", F.to_json(F.struct(F.array(F.struct(F.lit("Article Count").alias("series"), c("data"))).alias("timeline"))).alias("text"))
    return R.timeline_json(doc).withColumn("article_share", F.round("article_share", 9))


@query("""SELECT CAST(event_id AS VARCHAR) AS event_id, event_type AS actor1, round(value, 6) AS tone, date_trunc('second', ts) AS added_at FROM events
  WHERE ts IS NOT NULL AND event_type IN ('click', 'view')""")
def parse_event_export(spark, sf):
    """Tab-separated lines of 61 columns, of which those that name a wanted actor are kept."""
    e = P.table(spark, sf, "events").where("ts is not null")
    cells = [F.lit("")] * 61
    at = R.EVENT_COLUMNS
    cells[at["event_id"]], cells[at["actor1"]], cells[at["tone"]] = c("event_id").cast("string"), c("event_type"), F.round("value", 6).cast("string")
    cells[at["added_at"]], cells[at["url"]] = F.date_format("ts", "yyyyMMddHHmmss"), F.lit("https://www.example.org/a")
    rows = R.event_export(e.select(F.concat_ws("\t", *cells).alias("value")), actors=["click", "view"], places=["nowhere"])
    return rows.select("event_id", "actor1", "tone", c("added_at").cast("timestamp_ntz").alias("added_at"))


@query("""WITH m AS (SELECT o_orderpriority AS label, last_day(CAST(o_orderdate AS DATE)) AS month_end, CAST(100 + count(*) % 7 AS DOUBLE) AS value FROM orders GROUP BY 1, 2),
w AS (SELECT *, count(*) OVER t AS n3, product(value / 100) OVER t AS p3, count(*) OVER y AS n12, product(value / 100) OVER y AS p12 FROM m
  WINDOW t AS (PARTITION BY label ORDER BY month_end ROWS 2 PRECEDING),
y AS (PARTITION BY label ORDER BY month_end ROWS 11 PRECEDING))
SELECT label, month_end, value, round(CASE WHEN n3 = 3 THEN pow(p3, 4) - 1 END, 6) AS annualised_3m, round(CASE WHEN n12 = 12 THEN p12 - 1 END, 6) AS change_12m, month_end + 10 AS known_at FROM w""")
def parse_months_wide(spark, sf):
    """A table with a column a month, and growth compounded over three and twelve of them."""
    o = P.table(spark, sf, "orders")
    years = o.agg(F.min(F.year("o_orderdate")), F.max(F.year("o_orderdate"))).first()
    names = [f"{y}-M{k:02d}" for y in range(years[0], years[1] + 1) for k in range(1, 13)]
    value = (100 + F.count("*") % 7).cast("string")
    long = o.groupBy(c("o_orderpriority").alias("label"), F.date_format("o_orderdate", "yyyy-'M'MM").alias("m")).agg(value.alias("v"))
    wide = long.groupBy("label").pivot("m", names).agg(F.first("v"))
    g = R.compounded(R.months_wide(wide, label="label"))
    return g.select("label", "month_end", "value", F.round("annualised_3m", 6).alias("annualised_3m"), F.round("change_12m", 6).alias("change_12m"), "known_at")


@query("""WITH k AS (SELECT provider, observation_date AS starts, max(policy_rate_pct) AS rate FROM provider_rates
  WHERE provider IS NOT NULL AND observation_date IS NOT NULL AND policy_rate_pct IS NOT NULL GROUP BY 1, 2),
v AS (SELECT *, lead(starts) OVER (PARTITION BY provider ORDER BY starts) AS next FROM k),
x AS (SELECT provider, CASE WHEN lag(next) OVER (PARTITION BY provider ORDER BY starts) = starts THEN starts + 1 ELSE starts END AS starts, next AS ends, rate FROM v)
SELECT provider AS bank, starts, CAST(ends AS VARCHAR) AS ends, round(rate, 6) AS rate, round(rate - lag(rate) OVER (PARTITION BY provider ORDER BY starts), 6) AS change_pp, starts + 1 AS known_at FROM x""")
def parse_policy_intervals(spark, sf):
    """Interval texts of every bank, each ending on the day the next begins."""
    k = P.table(spark, sf, "provider_rates").where("provider is not null and observation_date is not null and policy_rate_pct is not null").groupBy("provider", "observation_date").agg(F.max("policy_rate_pct").alias("rate"))
    end = F.lead("observation_date").over(Window.partitionBy("provider").orderBy("observation_date"))
    show = lambda x: F.date_format(x, "dd.MM.yyyy")
    rows = k.select("provider", F.concat(F.lit("с "), show("observation_date"), F.coalesce(F.concat(F.lit(" по "), show(end)), F.lit(""))).alias("text"), "rate")
    return R.policy_intervals(rows, text="text", rate="rate", bank="provider").withColumns({"rate": F.round("rate", 6), "change_pp": F.round("change_pp", 6), "ends": c("ends").cast("string")})

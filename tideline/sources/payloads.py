"""Parsers of provider payloads: XML, JSON, HTML and delimited text held in a column, one expression plan each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decimal_comma(c: Column) -> Column:
    """Text with a decimal comma (and spaces inside) as double, null if it is no number."""
    return F.regexp_replace(F.regexp_replace(c, "[\\s ]", ""), ",", ".").try_cast("double")


def decode(content: Column, charset: str = "windows-1251") -> Column:
    """Bytes as text; Spark's own decoder knows the UTF family and Latin, other charsets go through the JDK by a vectorised function."""
    if charset.lower() in ("utf-8", "us-ascii", "iso-8859-1", "utf-16"):
        return F.decode(content, charset)

    @F.pandas_udf("string")
    def other(s):  # noqa: ANN001, ANN202
        return s.map(lambda b: None if b is None else bytes(b).decode(charset))

    return other(content)


def daily_rates_xml(payloads: DataFrame, *, text: str = "text", ccy: str = "ccy") -> DataFrame:
    """(ccy, rate_date, nominal, rate_rub) from dynamic-rate XML of one currency a payload; rows that are not positive are left out."""
    records = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<Record\b[^>]*>.*?</Record>"), F.lit(0))
    one = payloads.select(F.col(ccy).alias("ccy"), F.explode(records).alias("x"))
    part = lambda p: F.nullif(F.regexp_extract("x", p, 1), F.lit(""))
    out = one.select("ccy", F.expr("try_to_timestamp(regexp_extract(x, 'Date=\"([0-9.]+)\"', 1), 'dd.MM.yyyy')").cast("date").alias("rate_date"), part("<Nominal>([^<]+)</Nominal>").try_cast("int").alias("nominal"), decimal_comma(part("<Value>([^<]+)</Value>")).alias("rate_rub"))
    return out.where("rate_date is not null and nominal > 0 and rate_rub > 0")


def column_table_json(payloads: DataFrame, *, block: str, aliases: dict[str, list[str]], text: str = "text") -> DataFrame:
    """Rows of a JSON block {"columns": [...], "data": [[...]]}, columns found by name; each output takes the first alias that is not null. Columns of the payload table other than text are kept."""
    shape = f"struct<{block}:struct<columns:array<string>,data:array<array<string>>>>"
    parsed = payloads.select(*[c for c in payloads.columns if c != text], F.from_json(text, shape)[block].alias("_b"))
    rows = parsed.select("*", F.explode("_b.data").alias("_r")).withColumn("_m", F.map_from_arrays("_b.columns", "_r"))
    pick = [F.coalesce(*[F.try_element_at("_m", F.lit(a)) for a in names]).alias(out) for out, names in aliases.items()]
    return rows.select(*[c for c in payloads.columns if c != text], *pick)


def key_rate_html(payloads: DataFrame, *, text: str = "text") -> DataFrame:
    """(rate_date, rate_pct) from table cells in which a date is followed by a number between 0 and 100; a date with two rates fails."""
    cells = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<td[^>]*>\s*(.*?)\s*</td>"), F.lit(1))
    pairs = payloads.select(cells.alias("c")).select(F.inline(F.transform("c", lambda x, i: F.struct(x.alias("cell"), F.get("c", i + 1).alias("after")))))
    pairs = pairs.select(F.expr("try_to_timestamp(cell, 'dd.MM.yyyy')").cast("date").alias("rate_date"), decimal_comma(F.col("after")).alias("rate_pct"))
    good = pairs.where("rate_date is not null and rate_pct > 0 and rate_pct < 100").groupBy("rate_date").agg(F.min("rate_pct").alias("lo"), F.max("rate_pct").alias("rate_pct"))
    return good.select("rate_date", F.when(F.col("lo") == F.col("rate_pct"), F.col("rate_pct")).otherwise(F.raise_error(F.concat(F.lit("two rates on "), F.col("rate_date").cast("string")))).alias("rate_pct"))


def fred_csv(lines: DataFrame, *, line: str = "value", series: str) -> DataFrame:
    """(date, value) from lines of either header dialect (DATE or observation_date first); blanks and '.' are skipped."""
    p = F.split(F.col(line), ",")
    out = lines.select(F.get(p, F.lit(0)).try_cast("date").alias("date"), F.get(p, F.lit(1)).try_cast("double").alias("value"), F.lit(series).alias("series"))
    return out.where("date is not null and value is not null")


#: Ordinals of the 61-column event export that are read.
EVENT_COLUMNS = {"event_id": 0, "actor1": 7, "actor2": 17, "root": 28, "quad": 29, "goldstein": 30, "tone": 34, "geo1": 37, "geo2": 45, "geo3": 53, "added_at": 59, "url": 60}


def event_export(lines: DataFrame, *, actors: list[str], places: list[str], line: str = "value") -> DataFrame:
    """Typed event rows from tab-separated export lines that name one of the actors or places; lines of another width or with an unreadable time are left out."""
    p = F.split(F.col(line), "\t")
    raw = lines.select(p.alias("p")).where(F.size("p") == 61).select(*[F.nullif(F.get("p", F.lit(i)), F.lit("")).alias(k) for k, i in EVENT_COLUMNS.items()])
    typed = raw.select("event_id", "actor1", "actor2", F.col("root").try_cast("int").alias("root"), F.col("quad").try_cast("int").alias("quad"), F.col("goldstein").try_cast("double").alias("goldstein"), F.col("tone").try_cast("double").alias("tone"), F.array_compact(F.array("geo1", "geo2", "geo3")).alias("geo"), F.expr("try_to_timestamp(added_at, 'yyyyMMddHHmmss')").alias("added_at"), "url", F.regexp_replace(F.try_parse_url(F.col("url"), F.lit("HOST")), r"^www\.", "").alias("source"))
    named = F.arrays_overlap(F.array_compact(F.array("actor1", "actor2")), F.array(*map(F.lit, actors))) | F.arrays_overlap("geo", F.array(*map(F.lit, places)))
    return typed.where(F.col("added_at").isNotNull() & F.coalesce(named, F.lit(False)))


def timeline_json(payloads: DataFrame, *, text: str = "text", series: str = "series") -> DataFrame:
    """(series, date, article_count, all_article_count, article_share) from timeline JSON."""
    shape = "struct<timeline:array<struct<series:string,data:array<struct<date:string,value:double,norm:double>>>>>"
    one = payloads.select(F.col(series).alias("series"), F.explode(F.from_json(text, shape)["timeline"]).alias("t")).select("series", F.inline("t.data"))
    return one.select("series", F.expr("try_to_timestamp(substr(date, 1, 8), 'yyyyMMdd')").cast("date").alias("date"), F.col("value").alias("article_count"), F.col("norm").alias("all_article_count"), F.try_divide("value", F.nullif("norm", F.lit(0.0))).alias("article_share"))


def bank_rates_xml(payloads: DataFrame, *, currencies: list[str], text: str = "text", requested: str = "requested_date") -> DataFrame:
    """(requested_date, rate_date, ccy, nominal, per_nominal, is_carried) of the wanted currencies; a payload that lacks one of them fails."""
    items = F.regexp_extract_all(F.col(text), F.lit(r"(?s)<item>.*?</item>"), F.lit(0))
    day = F.expr(f"try_to_timestamp(regexp_extract({text}, '<date>([0-9.]+)</date>', 1), 'dd.MM.yyyy')").cast("date")
    one = payloads.select(F.col(requested).alias("requested_date"), day.alias("rate_date"), F.transform(items, lambda x: F.struct(F.regexp_extract(x, "<title>([^<]+)</title>", 1).alias("ccy"), F.regexp_extract(x, "<quant>([^<]+)</quant>", 1).try_cast("int").alias("nominal"), decimal_comma(F.regexp_extract(x, "<description>([^<]+)</description>", 1)).alias("per_nominal"))).alias("i"))
    want = F.array(*map(F.lit, currencies))
    have = F.filter("i", lambda x: F.array_contains(want, x["ccy"]) & (x["per_nominal"] > 0))
    full = F.size(F.array_except(want, F.transform(have, lambda x: x["ccy"]))) == 0
    rows = one.withColumn("i", F.when(full, have).otherwise(F.raise_error(F.concat(F.lit("currencies are missing for "), F.col("requested_date").cast("string")))))
    return rows.select("requested_date", "rate_date", F.inline("i")).withColumn("is_carried", F.col("requested_date") != F.col("rate_date"))


def months_wide(table: DataFrame, *, label: str) -> DataFrame:
    """(label, month_end, value) from columns named yyyy-Mmm (Latin or Cyrillic M), one row a month."""
    import re

    cols = [c for c in table.columns if re.fullmatch(r"\d{4}-[MМ]\d{2}", c)]
    long = table.select(F.col(label).alias("label"), *[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols]).unpivot(["label"], cols, "m", "value")
    return long.where("value is not null").select("label", F.last_day(F.to_date(F.concat(F.substring("m", 1, 4), F.lit("-"), F.right("m", F.lit(2)), F.lit("-01")))).alias("month_end"), "value")


def compounded(months: DataFrame, *, known_after_days: int = 10) -> DataFrame:
    """months with the annualised change over 3 months and that over 12, from monthly growth factors in per cent of the month before; null until the window is full."""
    w = Window.partitionBy("label").orderBy("month_end")
    g = F.col("value") / 100
    over = lambda n: F.when(F.count("value").over(w.rowsBetween(1 - n, 0)) == n, F.product(g).over(w.rowsBetween(1 - n, 0)))
    return months.select("*", (F.pow(over(3), F.lit(4.0)) - 1).alias("annualised_3m"), (over(12) - 1).alias("change_12m"), F.date_add("month_end", known_after_days).alias("known_at"))


def policy_intervals(rows: DataFrame, *, text: str, rate: str, bank: str) -> DataFrame:
    """(bank, starts, ends, rate, change_pp, known_at) from interval texts of each bank; an interval that begins before an earlier one ended begins the day after that end."""
    dates = F.transform(F.regexp_extract_all(F.col(text), F.lit(r"(\d{2}\.\d{2}\.\d{4})"), F.lit(1)), lambda x: F.to_date(x, "dd.MM.yyyy"))
    d = rows.select(F.col(bank).alias("bank"), dates.alias("d"), F.col(rate).cast("double").alias("rate")).where(F.size("d") > 0).select("bank", F.get("d", F.lit(0)).alias("starts"), F.get("d", F.lit(1)).alias("ends"), "rate")
    w = Window.partitionBy("bank").orderBy("starts", "ends")
    d = d.withColumn("prior", F.max("ends").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    d = d.withColumn("starts", F.when(F.col("starts") <= F.col("prior"), F.date_add("prior", 1)).otherwise(F.col("starts")))
    w2 = Window.partitionBy("bank").orderBy("starts")
    return d.select("bank", "starts", "ends", "rate", (F.col("rate") - F.lag("rate").over(w2)).alias("change_pp"), F.date_add("starts", 1).alias("known_at"))


def plan_sentences(articles: DataFrame, *, text: str, key: str) -> DataFrame:
    """(key, sentence, low, high) of sentences that state a range 'от X (млн|млрд) до Y (млн|млрд)', in millions."""
    sentences = articles.select(F.col(key), F.explode(F.split(F.col(text), r"(?<=[.!?])\s+")).alias("sentence"))
    p = r"(?i)от\s+([\d.,]+)\s*(млн|млрд)?\D*?\s+до\s+([\d.,]+)\s*(млн|млрд)"
    part = lambda i: F.nullif(F.regexp_extract("sentence", p, i), F.lit(""))
    scale = lambda u: F.when(F.lower(u) == "млрд", 1000.0).otherwise(1.0)
    return sentences.where(F.col("sentence").rlike(p)).select(key, "sentence", (decimal_comma(part(1)) * scale(F.coalesce(part(2), part(4)))).alias("low"), (decimal_comma(part(3)) * scale(part(4))).alias("high"))


def contract_codes(spark, first_year: int, last_year: int, root: str = "CR") -> DataFrame:
    """(code, expiry): month contracts with their third Thursday."""
    # Month letters of futures codes.
    letters = "FGHJKMNQUVXZ"
    months = spark.range(1).select(F.explode(F.sequence(F.make_date(F.lit(first_year), F.lit(1), F.lit(1)), F.make_date(F.lit(last_year), F.lit(12), F.lit(1)), F.expr("INTERVAL 1 MONTH"))).alias("m"))
    code = F.concat(F.lit(root), F.substring(F.lit(letters), F.month("m"), F.lit(1)), (F.year("m") % 10).cast("string"))
    return months.select(code.alias("code"), F.date_add(F.next_day(F.date_sub("m", 1), "THU"), 14).alias("expiry"))


def bank_rates_json(payloads: DataFrame, *, currencies: list[str], text: str = "text") -> DataFrame:
    """(rate_date, ccy, nominal, per_unit, known_at) from a JSON array of {Ccy, Nominal, Rate, Date}; usable the day after. Rows of one day and currency that disagree fail."""
    shape = "array<struct<Ccy:string,Nominal:string,Rate:string,Date:string>>"
    rows = payloads.select(F.inline(F.from_json(text, shape))).where(F.col("Ccy").isin(currencies))
    typed = rows.select(F.expr("try_to_timestamp(Date, 'dd.MM.yyyy')").cast("date").alias("rate_date"), F.col("Ccy").alias("ccy"), F.col("Nominal").try_cast("int").alias("nominal"), decimal_comma(F.col("Rate")).alias("rate")).where("rate_date is not null and nominal > 0 and rate > 0")
    one = typed.groupBy("rate_date", "ccy").agg(F.max("nominal").alias("nominal"), F.min(F.col("rate") / F.col("nominal")).alias("lo"), F.max(F.col("rate") / F.col("nominal")).alias("per_unit"))
    same = F.when(F.col("lo") == F.col("per_unit"), F.col("per_unit")).otherwise(F.raise_error(F.concat(F.lit("two rates of "), F.col("ccy"), F.lit(" on "), F.col("rate_date").cast("string"))))
    return one.select("rate_date", "ccy", "nominal", same.alias("per_unit"), F.date_add("rate_date", 1).alias("known_at"))


def rates_wide(rates: DataFrame, currencies: list[str], *, day: str = "rate_date", value: str = "per_unit", lag_days: int = 0) -> DataFrame:
    """One row a day with a column per currency, days shifted by lag_days; days that lack one keep a null."""
    return rates.groupBy(F.date_add(day, lag_days).alias(day)).pivot("ccy", currencies).agg(F.max(value))

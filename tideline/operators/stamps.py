"""Time texts in many shapes onto one UTC instant."""

from __future__ import annotations

import zoneinfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_US = 86_400_000_000

# Month names and their abbreviations.
MONTHS = {
    "jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6,
    "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10,
    "nov": 11, "november": 11, "dec": 12, "december": 12,
    "января": 1, "февраля": 2, "марта": 3, "апреля": 4, "мая": 5, "июня": 6, "июля": 7, "августа": 8, "сентября": 9,
    "октября": 10, "ноября": 11, "декабря": 12,
}
# Minutes east of Greenwich of abbreviations that name one offset; those of America are read as such (CST is no Chinese time here).
OFFSETS = {"Z": 0, "UTC": 0, "GMT": 0, "CET": 60, "CEST": 120, "EET": 120, "EEST": 180, "EST": -300, "EDT": -240, "CST": -360, "CDT": -300, "PST": -480, "PDT": -420}
# Abbreviations whose offset followed the rules of a region, and the minutes east they name today, which
# hold in an hour that the region's clock showed twice (both of 2014-10-26 01:30 were Moscow's; MSK is UTC+3 since the second).
REGIONS = {"MSK": ("Europe/Moscow", 180)}

# One alternation over every format; each component has its own group name.
_YEAR_FIRST = r"(?<ya>\d{4})(?<sa>[-/.])(?<ma>\d{1,2})\k<sa>(?<da>\d{1,2})"
_NUMERIC = r"(?<pb>\d{1,2})(?<sb>[-/.])(?<qb>\d{1,2})\k<sb>(?<yb>\d{4}|\d{2})"
_DAY_NAME = r"(?:\p{L}{2,9}\.?,? )?(?<dc>\d{1,2}) (?<nc>\p{L}{3,9})\.? (?<yc>\d{4})(?: ?г\.?)?"
_NAME_DAY = r"(?<nd>\p{L}{3,9})\.? (?<dd>\d{1,2}),? (?<yd>\d{4})"
_CLOCK = r"(?:[Tt]| |, ?)(?<h>\d{1,2}):(?<i>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,12}))?)?(?: ?(?<ap>[AaPp])\.?[Mm]\b\.?)?(?: ?(?<z>[+-]\d{2}(?::?\d{2})?|\p{L}+(?:/[\p{L}_+-]+)*))?(?: ?\[(?<zb>[^\]]+)\])?"
_COMPACT = r"(?<ye>\d{4})(?<me>\d{2})(?<de>\d{2})(?:[Tt]?(?<he>\d{2})(?<ie>\d{2})(?<se>\d{2})?(?<ze>[Zz])?)?"
_EPOCH = r"(?<e>\d{10}|\d{13}|\d{16}|\d{19})(?:\.(?<ef>\d{1,12}))?"
PATTERN = f"^(?:(?:{_YEAR_FIRST}|{_NUMERIC}|{_DAY_NAME}|{_NAME_DAY})(?:{_CLOCK})?|{_EPOCH}|{_COMPACT})$"
_SEP = "\u0001"
# At most one alternative matches, so alternatives of a component stand side by side in its place.
_PARTS = {
    "y": "${ya}${yb}${yc}${yd}${ye}", "m": "${ma}${me}", "d": "${da}${dc}${dd}${de}", "p": "${pb}", "q": "${qb}", "name": "${nc}${nd}",
    "h": "${h}${he}", "i": "${i}${ie}", "s": "${s}${se}", "f": "${f}", "ap": "${ap}", "z": "${z}${ze}", "zb": "${zb}", "e": "${e}", "ef": "${ef}",
}
_REPLACEMENT = _SEP + _SEP.join(_PARTS.values())

_WIDE_DIGITS = "".join(chr(0xFF10 + i) for i in range(10))


def _tidy(text: Column) -> Column:
    """Full-width digits, dashes and spaces of other kinds in their plain forms; single spaces, none at the ends."""
    plain = F.translate(text, _WIDE_DIGITS + "\u2212\u2012\u2013\u00a0\u2009\u202f\t\r\n", "0123456789---" + " " * 6)
    return F.trim(F.regexp_replace(plain, " {2,}", " "))


def _settled(df: DataFrame, value: Column, name: str) -> DataFrame:
    """df with `value` computed once: a one-element explode keeps the optimiser from copying the expression into each of its uses."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def days_from_civil(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date, in integers: months count from March, so the leap day ends the year."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.pmod(m + 9, F.lit(12))
    return 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400) + F.floor((153 * mm + 2) / 5) + d - 1 - 719468


def _days_in(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def parse_instants(df: DataFrame, text: Column, zone: Column, order: Column) -> DataFrame:
    """df with `utc_micros` long and `stamp_status`: the instant each text means, in microseconds since 1970-01-01 UTC.

    Every format is one alternative of PATTERN; one regular-expression pass writes all named groups into a separated
    string, which is split once. Components are checked against calendar and clock ranges and put together with integer
    day arithmetic, all inside the JVM. stamp_status is 'ok', 'no_text' (null or blank), 'unreadable' (matches no format,
    unknown month or zone name), 'impossible' (no such date or time of day) or 'never_shown' (the zone's clock skipped it).

    A text with its own offset, zone or instant is read so, an offset before a bracketed zone; all other text is wall
    time in `zone`. Numeric dates that do not begin with a four-digit year follow `order` ('dmy' or 'mdy'); two-digit
    years lie in 2000-2099; a date alone is the start of its day; wall time shown twice means the earlier instant, but with an
    abbreviation of REGIONS the one at the offset that names today;
    digits finer than a microsecond are dropped. Integers of 10, 13, 16 and 19 digits count seconds, milli-, micro- and
    nanoseconds since 1970; 8, 12 and 14 digits are compact dates.

    Defined cases: null or unknown `zone` makes wall time unreadable, null `order` a numeric date; texts of any length are
    matched whole; no row is lost or repeated; names of df's own columns do not matter except the two added here.
    """
    parts = F.split(F.regexp_replace(_tidy(text), PATTERN, _REPLACEMENT), _SEP)
    names = ["none", *_PARTS]
    base = _settled(df, F.struct(parts.alias("a"), zone.alias("zone"), F.lower(order).alias("order"), (F.coalesce(F.trim(text), F.lit("")) == "").alias("blank")), "_raw")
    at = {k: F.get(F.col("_raw.a"), F.lit(i)) for i, k in enumerate(names)}
    num = lambda k: F.nullif(at[k], F.lit("")).try_cast("long")
    sixth = lambda k: F.coalesce(F.rpad(F.substring(at[k], 1, 6), 6, "0").try_cast("long"), F.lit(0))
    mapping = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    mdy, known = F.col("_raw.order") == "mdy", F.col("_raw.order").isin("dmy", "mdy")
    numeric = (at["p"] != "") & known
    z = F.coalesce(F.nullif(at["z"], F.lit("")), F.nullif(at["zb"], F.lit("")))
    read = F.struct(
        (F.size("_raw.a") == len(names)).alias("hit"),
        F.col("_raw.blank").alias("blank"),
        (num("y") + F.when(F.length(at["y"]) == 2, 2000).otherwise(0)).alias("y"),
        F.coalesce(num("m"), F.try_element_at(mapping(MONTHS), F.lower(at["name"])), F.when(numeric, F.when(mdy, num("p")).otherwise(num("q")))).cast("long").alias("m"),
        F.coalesce(num("d"), F.when(numeric, F.when(mdy, num("q")).otherwise(num("p")))).alias("d"),
        F.coalesce(num("h"), F.lit(0)).alias("h"), F.coalesce(num("i"), F.lit(0)).alias("i"), F.coalesce(num("s"), F.lit(0)).alias("s"), sixth("f").alias("f"), F.lower(at["ap"]).alias("half"),
        F.nullif(at["e"], F.lit("")).alias("e"), at["ef"].alias("ef"), sixth("ef").alias("efrac"),
        z.alias("z"), z.rlike(r"^[+-]").alias("signed"), F.regexp_replace(z, "[+:-]", "").alias("digits"), F.col("_raw.zone").alias("feed_zone"),
    )
    second = _settled(base, read, "_read")
    g = lambda k: F.col(f"_read.{k}")
    hour = F.when(g("half") == "", g("h")).when(g("h").between(1, 12), g("h") % 12 + F.when(g("half") == "p", 12).otherwise(0))
    east = F.substring(g("digits"), 1, 2).try_cast("long") * 60 + F.coalesce(F.nullif(F.substring(g("digits"), 3, 2), F.lit("")).try_cast("long"), F.lit(0))
    offset = F.when(g("signed"), F.when(east <= 18 * 60, F.when(g("z").startswith("-"), -east).otherwise(east))).otherwise(F.try_element_at(mapping(OFFSETS), F.upper(g("z"))).cast("long"))
    named = F.when(g("z").isNull(), g("feed_zone")).when(~g("signed"), F.coalesce(F.try_element_at(mapping({k: v[0] for k, v in REGIONS.items()}), F.upper(g("z"))), g("z")))
    today = F.when(~g("signed"), F.try_element_at(mapping({k: v[1] for k, v in REGIONS.items()}), F.upper(g("z"))).cast("long"))
    long = lambda n: F.lit(n).cast("long")
    count = g("e").try_cast("long")
    epoch = (
        F.when(g("ef") != "", F.when(F.length(g("e")) == 10, count * long(1_000_000) + g("efrac")))
        .when(F.length(g("e")) == 10, count * long(1_000_000)).when(F.length(g("e")) == 13, count * long(1000)).otherwise(F.substring(g("e"), 1, 16).try_cast("long"))
    )
    right = (g("y") >= 1) & g("m").between(1, 12) & (g("d") >= 1) & (g("d") <= _days_in(g("y"), g("m"))) & (hour <= 23) & (g("i") <= 59) & (g("s") <= 59)
    wall = days_from_civil(g("y"), g("m"), g("d")) * long(DAY_US) + (hour * 3600 + g("i") * 60 + g("s")) * long(1_000_000) + g("f")
    placed = F.struct(
        g("hit").alias("hit"), g("blank").alias("blank"), g("e").isNotNull().alias("is_epoch"), epoch.alias("epoch"), (g("m").isNotNull() & g("d").isNotNull()).alias("dated"),
        F.coalesce(right, F.lit(False)).alias("right"), F.when(right, wall).alias("wall"), offset.alias("off"), F.when(named.isin(sorted(zoneinfo.available_timezones())), named).alias("zone"), (wall - today * long(60_000_000)).alias("as_today"),
    )
    third = _settled(second, placed, "_placed")
    p = lambda k: F.col(f"_placed.{k}")
    early, late = F.to_utc_timestamp(F.timestamp_micros(p("wall")), p("zone")), F.timestamp_micros(p("as_today"))
    utc = F.when(F.from_utc_timestamp(late, p("zone")) == F.timestamp_micros(p("wall")), late).otherwise(early)
    fourth = _settled(third, F.struct(F.unix_micros(utc).alias("utc"), (F.from_utc_timestamp(utc, p("zone")) == F.timestamp_micros(p("wall"))).alias("shown")), "_zoned")
    status = (
        F.when(p("blank"), "no_text").when(~p("hit"), "unreadable").when(p("is_epoch"), F.when(p("epoch").isNotNull(), "ok").otherwise("unreadable"))
        .when(~p("dated") | (p("off").isNull() & p("zone").isNull()), "unreadable").when(~p("right"), "impossible").when(p("off").isNotNull() | F.col("_zoned.shown"), "ok").otherwise("never_shown")
    )
    value = F.when(p("is_epoch"), p("epoch")).when(p("off").isNotNull(), p("wall") - p("off") * long(60_000_000)).otherwise(F.col("_zoned.utc"))
    done = _settled(fourth, F.struct(F.when(status == "ok", value).alias("utc_micros"), status.alias("stamp_status")), "_done")
    return done.select(*[F.col(f"`{c}`") for c in df.columns], "_done.utc_micros", "_done.stamp_status")


def normalise_feeds(stamps: DataFrame, registry: DataFrame, fields: tuple[str, ...] = ("trade_date", "dt_msk", "observed_at")) -> DataFrame:
    """stamps with `stamp_text`, `utc_micros` and `stamp_status`, each text read by its feed's entry (feed, field_name, zone_id, date_order).

    Rows of a feed without an entry, or with a null feed, keep null text and status 'no_text'. If a feed has several
    entries, the greatest (field_name, zone_id, date_order) holds, so that no row is repeated.
    """
    entry = registry.where("feed is not null").groupBy(F.col("feed").alias("_feed")).agg(F.max(F.struct("field_name", "zone_id", "date_order")).alias("_entry"))
    joined = stamps.join(entry, stamps["feed"] == F.col("_feed"), "left")
    text = F.coalesce(*[F.when(F.col("_entry.field_name") == f, F.col(f)) for f in fields])
    return parse_instants(joined.withColumn("stamp_text", text), F.col("stamp_text"), F.col("_entry.zone_id"), F.col("_entry.date_order")).drop("_feed", "_entry")

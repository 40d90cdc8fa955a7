"""File sources and sinks: typed scans, manifests that gate a snapshot, deterministic output."""

from __future__ import annotations

import hashlib
import json
import re
from collections import OrderedDict
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.contracts import ContractError, assert_unique, require_columns

#: Schemas of the raw panels.
CBR = "rate_date date, ccy string, nominal int, rate_rub double, fetched_at string, source_url string, is_carried boolean"
DAILY = "trade_date date, secid string, open double, high double, low double, close double, waprice double, volume_rub double, num_trades long, facevalue double, normalization string"
CANDLES = "dt_msk timestamp_ntz, secid string, open double, high double, low double, close double"


def scan_csv(spark: SparkSession, path: str, schema: str, *, null: str = "", strict: bool = True) -> DataFrame:
    """A CSV with a header and a fixed schema; strict fails on malformed rows, otherwise bad values are null. Column pruning and filters reach the scan."""
    return spark.read.schema(schema).option("header", True).option("nullValue", null).option("mode", "FAILFAST" if strict else "PERMISSIVE").option("enforceSchema", False).csv(path)


def cbr_panel(rates: DataFrame) -> DataFrame:
    """(series_id, value_date, known_at, price, is_carried): price per unit, known at 15:30 of the business day before."""
    from tideline.panel import previous_business_day

    require_columns(rates, "rate_date", "ccy", "nominal", "rate_rub")
    carried = F.coalesce("is_carried", F.lit(False)) if "is_carried" in rates.columns else F.lit(False)
    price = F.when((F.col("rate_rub") > 0) & (F.col("nominal") > 0), F.col("rate_rub") / F.col("nominal")).otherwise(F.raise_error(F.lit("a rate is not positive")))
    known = previous_business_day(F.col("rate_date")).cast("timestamp_ntz") + F.expr("INTERVAL '15:30' HOUR TO MINUTE")
    return rates.select(F.concat(F.lit("CBR:"), "ccy").alias("series_id"), F.col("rate_date").alias("value_date"), known.alias("known_at"), price.alias("price"), carried.alias("is_carried"))


def daily_closes(rows: DataFrame) -> DataFrame:
    """(series_id, value_date, known_at, price, meta): closes above zero, known at 23:59 of their day; null figures stay out of meta."""
    known = F.col("trade_date").cast("timestamp_ntz") + F.expr("INTERVAL '23:59' HOUR TO MINUTE")
    figures = [c for c in ("waprice", "volume_rub", "num_trades", "facevalue") if c in rows.columns]
    meta = F.map_filter(F.create_map(*[x for c in figures for x in (F.lit(c), F.col(c).cast("double"))]), lambda k, v: v.isNotNull()) if figures else F.create_map().cast("map<string,double>")
    return rows.where("close > 0").select(F.concat(F.lit("MOEX:"), "secid").alias("series_id"), F.col("trade_date").alias("value_date"), known.alias("known_at"), F.col("close").alias("price"), meta.alias("meta"))


def candle_closes(rows: DataFrame) -> DataFrame:
    """Candles known at their end."""
    return rows.where("close > 0").select(F.concat(F.lit("MOEX10M:"), "secid").alias("series_id"), F.col("dt_msk").cast("date").alias("value_date"), F.col("dt_msk").alias("known_at"), F.col("close").alias("price"))


LOADERS = {"CBR": (CBR, cbr_panel), "MOEX": (DAILY, daily_closes), "MOEX10M": (CANDLES, candle_closes)}


def load_series(spark: SparkSession, series: str, folder: str) -> DataFrame:
    """The panel of 'SOURCE:ID' from <folder>/<source>.csv; unknown sources and malformed rows fail."""
    source, _, name = series.partition(":")
    if source not in LOADERS or not name:
        raise ContractError(f"unknown series {series}")
    schema, loader = LOADERS[source]
    return loader(scan_csv(spark, f"{folder}/{source.lower()}.csv", schema)).where(F.col("series_id") == series)


def filtered_bulk(spark: SparkSession, path: str, *, areas: list[str], columns: tuple[str, ...] = ("FREQ", "REF_AREA", "TIME_PERIOD", "OBS_VALUE", "CURRENCY")) -> DataFrame:
    """Daily positive observations of some areas from a bulk CSV of coded columns; a code is the text before its colon."""
    raw = spark.read.option("header", True).csv(path).select(*columns)
    code = lambda c: F.trim(F.split_part(F.col(c), F.lit(":"), F.lit(1)))
    rows = raw.where((code("FREQ") == "D") & code("REF_AREA").isin(areas)).select(code("REF_AREA").alias("area"), code("CURRENCY").alias("currency"), F.col("TIME_PERIOD").try_cast("date").alias("date"), F.col("OBS_VALUE").try_cast("double").alias("value"))
    return assert_unique(rows.where("value > 0 and date is not null"), "area", "currency", "date")


def content_hash(df: DataFrame) -> str:
    """A hash of the rows as a set, whatever their order or files: the sum of row hashes, with the row count."""
    row = F.xxhash64(*[F.col(c).cast("string") for c in sorted(df.columns)]).cast("decimal(38,0)")
    s = df.agg(F.sum(row).alias("h"), F.count("*").alias("n")).first()
    return hashlib.sha256(f"{s['h']}:{s['n']}:{','.join(sorted(df.columns))}".encode()).hexdigest()


def publish(df: DataFrame, folder: str, *, name: str, notes: dict | None = None) -> dict:
    """Writes a snapshot into a new folder of its own and its manifest last, so that an interrupted write is never seen."""
    target = Path(folder) / f"{name}-{datetime.now(timezone.utc):%Y%m%dT%H%M%S%f}"
    df.write.parquet(str(target / "data"))
    back = df.sparkSession.read.schema(df.schema).parquet(str(target / "data"))
    manifest = {"name": name, "rows": back.count(), "content": content_hash(back), "columns": df.columns, "notes": notes or {}, "created_at": datetime.now(timezone.utc).isoformat()}
    part = target / "manifest.json.part"
    part.write_text(json.dumps(manifest, sort_keys=True, indent=1))
    part.replace(target / "manifest.json")
    return manifest | {"path": str(target)}


def latest(folder: str, name: str) -> Path:
    """The newest folder of a snapshot that has a manifest."""
    done = sorted(p.parent for p in Path(folder).glob(f"{name}-*/manifest.json"))
    if not done:
        raise ContractError(f"no published snapshot of {name}")
    return done[-1]


def resolve(spark: SparkSession, path: str | Path) -> DataFrame:
    """The rows of a published snapshot; fails if rows or content differ from the manifest."""
    m = json.loads((Path(path) / "manifest.json").read_text())
    df = spark.read.parquet(str(Path(path) / "data"))
    if df.count() != m["rows"] or content_hash(df) != m["content"]:
        raise ContractError(f"{path} does not match its manifest")
    return df


def write_csv(df: DataFrame, path: str, order: list[str], *, gzip: bool = True) -> None:
    """A small result as ordered CSV; meant for reports, so it is one file."""
    df.coalesce(1).sortWithinPartitions(*order).write.mode("overwrite").option("header", True).option("compression", "gzip" if gzip else "none").csv(path)


def combine_hourly(parts: list[DataFrame], keys: list[str]) -> DataFrame:
    """Partial hourly counts added up by key."""
    from functools import reduce

    whole = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return whole.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in whole.columns if c not in keys])


def markdown_table(df: DataFrame, limit: int = 200) -> str:
    """A report table of a small result."""
    rows = df.limit(limit).collect()
    cell = lambda v: "" if v is None else f"{v:.4g}" if isinstance(v, float) else re.sub(r"[|\n]", " ", str(v))
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in rows])


def price_matrix(rows: DataFrame, *, target: str, instruments: list[str], instrument: str = "instrument_id", day: str = "trade_date", price: str = "close") -> DataFrame:
    """One row for each day on which the target has a price above zero, with a column per instrument of that day's price, never filled."""
    good = rows.where(F.col(price) > 0)
    days = good.where(F.col(instrument) == target).select(day).distinct()
    wide = good.groupBy(day).pivot(instrument, instruments).agg(F.max(price))
    return days.join(wide, day, "left")


def drop_empty_columns(df: DataFrame, prefix: str) -> DataFrame:
    """df without the columns of a prefix that hold no value at all; one aggregate row tells which."""
    names = [c for c in df.columns if c.startswith(prefix)]
    if not names:
        return df
    n = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in names]).first()
    return df.drop(*[c for c in names if not n[c]])


MEMO = 32  # most scans kept
_memo: OrderedDict[tuple, DataFrame] = OrderedDict()


def scan_once(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """scan_csv of a local file, kept in the executors' storage as long as the file's time and size stay the same, the least recently used of MEMO scans giving way; filters come after it."""
    stat = Path(path).stat()
    key = (spark.sparkContext.applicationId, path, schema, stat.st_mtime_ns, stat.st_size)
    if key in _memo:
        _memo.move_to_end(key)
        return _memo[key]
    for old in [k for k in _memo if k[:3] == key[:3]] + (list(_memo)[:1] if len(_memo) >= MEMO else []):
        _memo.pop(old).unpersist()
    _memo[key] = scan_csv(spark, path, schema).persist()
    return _memo[key]


def verified_csv(spark: SparkSession, path: str, schema: str, sha256: str) -> DataFrame:
    """scan_csv of a downloaded file whose bytes have the given digest; fails on others."""
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(1 << 20):
            digest.update(part)
    if digest.hexdigest() != sha256:
        raise ContractError(f"{path} is not the file that was published")
    return scan_csv(spark, path, schema)


def write_set(frames: dict[str, DataFrame], folder: str, order: dict[str, list[str]]) -> dict[str, int]:
    """Named results as ordered CSV folders beside a manifest of their row counts, which is written last."""
    rows = {}
    for name, df in frames.items():
        write_csv(df, f"{folder}/{name}", order.get(name, df.columns[:1]), gzip=False)
        rows[name] = df.count()
    part = Path(folder) / "manifest.json.part"
    part.write_text(json.dumps(rows, sort_keys=True))
    part.replace(Path(folder) / "manifest.json")
    return rows

"""Structured Streaming: windowed counts with late data, and ordered decisions as keyed state."""

from __future__ import annotations

import time
from collections.abc import Iterator
from contextlib import contextmanager

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType, TimestampType


def file_stream(spark: SparkSession, path: str, schema: StructType, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def write_in_order(rows: DataFrame, path: str, at: str, files: int) -> None:
    """Writes rows as files that follow each other in `at`, written side by side and stamped so that a stream takes them in that order."""
    rows.repartitionByRange(files, at).write.parquet(path)
    spark = rows.sparkSession
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    parts = sorted((f.getPath() for f in fs.listStatus(folder) if f.getPath().getName().startswith("part-")), key=lambda p: p.getName())
    now = int(time.time()) * 1000
    for i, p in enumerate(parts):
        fs.setTimes(p, now + (i - len(parts)) * 1000, -1)


def hourly_articles(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Events once each per hour, corridor and article, counted by hour and corridor; rows later than `late` behind the newest are dropped."""
    e = events.select(F.col("event_type").alias("corridor"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("article"), "value").withWatermark("at", late)
    hour = F.window("at", "1 hour")
    one = e.withColumn("hour", F.date_trunc("hour", "at")).dropDuplicatesWithinWatermark(["corridor", "hour", "article"])
    return one.groupBy(hour.alias("w"), "corridor").agg(F.count("*").alias("articles"), F.avg("value").alias("tone")).select("corridor", F.col("w.start").alias("hour"), "articles", "tone")


def sliding_counts(events: DataFrame, *, length: str = "24 hours", slide: str = "1 hour", late: str = "2 hours") -> DataFrame:
    e = events.select(F.col("event_type").alias("corridor"), F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return e.groupBy(F.window("at", length, slide).alias("w"), "corridor").agg(F.count("*").alias("n")).select("corridor", F.col("w.end").alias("until"), "n")


def sessions(events: DataFrame, *, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    e = events.select("user_id", F.col("ts").cast("timestamp").alias("at")).withWatermark("at", late)
    return e.groupBy(F.session_window("at", gap).alias("w"), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("w.start").alias("session_start"), "n")


WEEK_S, DAY_S = 7 * 86_400, 86_400


class CapAndCooldown(StatefulProcessor):
    """Keeps, per key, the last decision, its week and that week's count; rows of one batch are taken in order of time."""

    def __init__(self, cooldown_days: int, cap: int) -> None:
        self.cooldown, self.cap = cooldown_days * DAY_S, cap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("policy", StructType([StructField("last", LongType()), StructField("week", LongType()), StructField("count", LongType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last, week, count = self.state.get() if self.state.exists() else (None, None, 0)
        kept = []
        for t in sorted({t for pdf in rows for t in pdf["at"]}):
            s = int(t.timestamp())
            w = (s + 3 * DAY_S) // WEEK_S
            used = count if w == week else 0
            if used < self.cap and (last is None or s - last >= self.cooldown):
                last, week, count = s, w, used + 1
                kept.append(t)
        if last is not None:
            self.state.update((last, week, count))
        if kept:
            yield pd.DataFrame({"corridor": [key[0]] * len(kept), "at": kept})

    def close(self) -> None:
        pass


def policy_stream(candidates: DataFrame, *, cooldown_days: int, cap: int) -> DataFrame:
    """(corridor, at) of the candidates kept by a weekly cap and a cooldown, as a stream; candidates of a key must arrive in order of time across batches."""
    out = StructType([StructField("corridor", StringType()), StructField("at", TimestampType())])
    return candidates.groupBy("corridor").transformWithStateInPandas(CapAndCooldown(cooldown_days, cap), out, "append", "none")


def append_once(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Runs a stream over everything there is into Parquet, each batch in a folder of its own that a repeat overwrites."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_parquet(stream: DataFrame, root: str) -> DataFrame:
    """Runs a stream over everything there is into a table under root, with its checkpoint beside it, and reads the table; nothing passes through the driver."""
    spark = stream.sparkSession
    append_once(stream, f"{root}/out", f"{root}/checkpoint")
    written = stream.schema.add("batch", LongType())
    return spark.read.schema(written).option("basePath", f"{root}/out").parquet(f"{root}/out") if batches(spark, root) else spark.createDataFrame([], written)


def batches(spark: SparkSession, root: str) -> int:
    """How many micro-batches of run_to_parquet have written."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/out")
    fs = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    return len(fs.listStatus(folder)) if fs.exists(folder) else 0


STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def rocksdb_state(spark: SparkSession):  # noqa: ANN201
    """Keyed state of the processors here lies in RocksDB, which the arbitrary-state operator asks for; the session's own choice is restored afterwards."""
    had = spark.conf.get(STATE_STORE, None)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, had) if had else spark.conf.unset(STATE_STORE)


class Settled(StatefulProcessor):
    """Keeps each key's score until its label comes, a number of rows later in the key's own order, and gives out the two together: labels that arrive late in the state they belong to."""

    def __init__(self, delay: int) -> None:
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.open = handle.getListState("open", StructType([StructField("at", LongType()), StructField("price", DoubleType())]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        new = sorted((int(t.timestamp() * 1_000_000), float(p)) for pdf in rows for t, p in zip(pdf["at"], pdf["price"]))
        line = [*self.open.get(), *new]
        done = line[: max(0, len(line) - self.delay)]
        if done:
            least = [min(p for _, p in line[i + 1 : i + 1 + self.delay]) for i in range(len(done))]
            yield pd.DataFrame({"corridor": key[0], "at": pd.to_datetime([t for t, _ in done], unit="us", utc=True), "price": [p for _, p in done], "best_ahead": least})
        self.open.put(line[len(done) :])

    def close(self) -> None:
        pass


def settled_stream(prices: DataFrame, *, delay: int) -> DataFrame:
    """(corridor, at, price, best_ahead) of each price once its next `delay` prices are known; state holds at most `delay` rows a key. Prices of a key must arrive in order of time across batches."""
    out = StructType([StructField("corridor", StringType()), StructField("at", TimestampType()), StructField("price", DoubleType()), StructField("best_ahead", DoubleType())])
    return prices.groupBy("corridor").transformWithStateInPandas(Settled(delay), out, "append", "none")


def hours_with_outages(counts: DataFrame, heartbeats: DataFrame) -> DataFrame:
    """(hour, corridor, articles): of every hour that a heartbeat announces, a count of zero for corridors without articles; of hours without a heartbeat, null, since the source was away.

    heartbeats is (hour, corridor, alive), one row for every hour and corridor expected; both are small windowed results.
    """
    return heartbeats.join(counts, ["hour", "corridor"], "left").select("hour", "corridor", F.when(F.col("alive"), F.coalesce("articles", F.lit(0))).alias("articles"))


def hourly_distinct(events: DataFrame, *, late: str = "2 hours") -> DataFrame:
    """Distinct articles by hour and corridor; an hour is given out and its state dropped once the watermark, `late` behind the newest event, has passed its end."""
    e = events.select(F.col("event_type").alias("corridor"), F.col("ts").cast("timestamp").alias("at"), F.col("user_id").alias("article")).withWatermark("at", late)
    return e.groupBy(F.window("at", "1 hour").alias("w"), "corridor").agg(F.size(F.collect_set("article")).alias("articles")).select("corridor", F.col("w.start").alias("hour"), "articles")

"""Queries of the training-data problems over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.llm.mixing import mix
from tideline.llm.packing import fill_report, pack
from tideline.llm.quality import text_quality
from tideline.llm.tokens import count_tokens
from tideline.llm.topn import top_n
from tideline.session import cut, pin_utc


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    pin_utc(spark)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def p4_top(spark: SparkSession, sf: str) -> DataFrame:
    """The five best rows of each (variant, corridor, horizon)."""
    return top_n(table(spark, sf, "score_frame"), by=["variant", "corridor", "horizon"], score="score", ties=["timestamp", "score_id"], n=5)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return p4_top(spark, sf).select("score_id").distinct()


def p7_pack(spark: SparkSession, sf: str) -> DataFrame:
    """Which piece of which document lies in which container, for each capacity."""
    sized = cut(count_tokens(table(spark, sf, "documents"), keep=["doc_id"]))
    return pack(sized, table(spark, sf, "pack_limits"))


def p7_fill(spark: SparkSession, sf: str) -> DataFrame:
    return fill_report(p7_pack(spark, sf), table(spark, sf, "pack_limits"))


def _mixed(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """As much is drawn as the targeted sources hold in all; a source with less than its share of that is repeated, and at its most repeats falls short."""
    return mix(count_tokens(table(spark, sf, "documents"), keep=["doc_id", "source"]), table(spark, sf, "mix_targets"))


def p8_mix(spark: SparkSession, sf: str) -> DataFrame:
    """The drawn documents, how often each is used, and beside them the share their source was to have and has."""
    selection, shares = _mixed(spark, sf)
    return selection.join(shares.select("source", "target_share", F.round("reached_share", 6).alias("reached_share")), "source")


def p8_shares(spark: SparkSession, sf: str) -> DataFrame:
    return _mixed(spark, sf)[1]


def p9_quality(spark: SparkSession, sf: str) -> DataFrame:
    return text_quality(table(spark, sf, "documents"))


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    return p9_quality(spark, sf).where("not is_prose").select("doc_id").distinct()


QUERIES = {f.__name__: f for f in (p4_found, p4_top, p7_pack, p7_fill, p8_mix, p8_shares, p9_found, p9_quality)}

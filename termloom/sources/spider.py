"""Time-range queries over crawled documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DOCUMENT = "url string, result struct<publish_time: bigint, title: string, text: string, type: string, extra: struct<keyword: string>>"


def read_json(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(DOCUMENT).json(path)


def in_range(docs: DataFrame, begin: str, end: str) -> DataFrame:
    """Documents from ``begin`` 00:00:00 to ``end`` 23:59:59, both included,
    with some text."""
    t = F.col("result.publish_time")
    low, high = F.unix_timestamp(F.lit(f"{begin} 00:00:00")), F.unix_timestamp(F.lit(f"{end} 23:59:59"))
    return docs.filter(t.between(low, high) & (F.col("result.text") != ""))


def flattened(docs: DataFrame, fields: list[str] | None = None) -> DataFrame:
    """Flat rows; missing title or keyword is empty; only ``fields``, by exact name."""
    out = docs.select(
        "url",
        F.date_format(F.timestamp_seconds("result.publish_time"), "yyyy-MM-dd HH:mm:ss").alias("publish_time"),
        F.coalesce("result.title", F.lit("")).alias("title"), F.col("result.text").alias("text"), F.col("result.type").alias("type"),
        F.coalesce("result.extra.keyword", F.lit("")).alias("keyword"),
    )
    return out if fields is None else out.select(*[c for c in out.columns if c in fields])


def write_collections(docs: DataFrame, path: str) -> None:
    """One folder of headerless CSV for each collection."""
    docs.write.mode("overwrite").option("header", False).partitionBy("collection").csv(path)

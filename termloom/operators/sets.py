"""Set operations on sample sets (sample_id, term, n)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.ranking import ordered


def merged(left: DataFrame, right: DataFrame) -> DataFrame:
    """Union; on an id that both have the right side's rows stand.  Statistics
    are to be taken anew from the result."""
    return left.join(right.select("sample_id").distinct(), "sample_id", "left_anti").unionByName(right)


def appended(left: DataFrame, right: DataFrame) -> DataFrame:
    """All samples of (sample_id, label); the right side's ids go on after the
    left's count, in order of their text."""
    key = F.col("sample_id").cast("string")
    a = ordered(left.withColumn("__key", key), "__key", name="new_id").drop("__key")
    size = left.agg(F.count("*").alias("__size"))
    b = ordered(right.withColumn("__key", key), "__key", name="new_id").drop("__key").crossJoin(F.broadcast(size))
    return a.unionByName(b.withColumn("new_id", F.col("new_id") + F.col("__size")).drop("__size"))


def difference(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def intersection(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).intersect(right.select(key))

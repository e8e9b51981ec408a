"""Global ranks without a single-partition window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.plans.storage import stored


def with_position(df: DataFrame, key: str, name: str = "position", prefix: int = 2, ties: tuple[str, ...] = ()) -> DataFrame:
    """Adds the row's place from 0 in binary order of the string ``key``.

    Rows are counted by the key's first ``prefix`` characters; only those
    counts meet in one place, rows are ranked inside their prefix.
    """
    head = F.substring(F.col(key), 1, prefix)
    rows = df.withColumn("__head", head)
    sizes = rows.groupBy("__head").agg(F.count("*").alias("__n"))
    before = W.orderBy("__head").rowsBetween(W.unboundedPreceding, -1)
    base = sizes.select("__head", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(W.partitionBy("__head").orderBy(key, *ties)) - 1
    return rows.withColumn("__i", inside).join(base, "__head").withColumn(name, (F.col("__i") + F.col("__base")).cast("long")).drop("__head", "__i", "__base")


def first_by_hash(df: DataFrame, key: str, k: int) -> DataFrame:
    """Exactly ``k`` rows (all, if fewer): the least md5 of the id."""
    hashed = df.withColumn("__md5", F.md5(F.col(key).cast("string")))
    return with_position(hashed, "__md5", "__at", prefix=3, ties=(key,)).filter(F.col("__at") < k).drop("__md5", "__at")


def ordered(df: DataFrame, *order: Column | str, name: str = "position") -> DataFrame:
    """Adds the row's place from 0 in any order.

    The rows are sorted over range partitions and stored; only the number of
    rows of each partition meets in one place, so a hot value that many rows
    share is as well spread as the range partitioning lets it.
    """
    placed = stored(df.orderBy(*order).withColumn("__i", F.monotonically_increasing_id()), "ordered")
    part, row = F.shiftright("__i", 33), F.col("__i").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("__n"))
    before = W.orderBy("__part").rowsBetween(W.unboundedPreceding, -1)  # a row for each partition
    base = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    return placed.withColumn("__part", part).join(F.broadcast(base), "__part").withColumn(name, (row + F.col("__base")).cast("long")).drop("__i", "__part", "__base")

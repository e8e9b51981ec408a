"""Tables between the rounds of an iteration."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def _path(df: DataFrame, name: str) -> str:
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        spark.sparkContext.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="termloom-"))
        base = spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/termloom/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, schema: StructType | None = None) -> DataFrame:
    """Writes ``df`` under ``spark.checkpoint.dir`` and reads it back, under
    ``schema`` if given, which cuts lineage and survives lost executors.  Only a
    single-process session may leave the setting out."""
    path = _path(df, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(schema or df.schema).parquet(path)


def bucketed(df: DataFrame, key: str, parts: int, name: str) -> DataFrame:
    """``df``, which lies in ``parts`` partitions by ``key``, stored in as many
    buckets: what goes by the key afterwards finds these rows in place."""
    path = _path(df, name)
    table = f"termloom_{uuid.uuid4().hex}"
    df.write.format("parquet").bucketBy(parts, key).option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


#: Terms whose weights are broadcast.
MOST_TERMS = 500_000


def least_common(terms: DataFrame, rank: Column, most: int | None = None) -> float | None:
    """The rank (above 0) from which on there are at most ``most`` terms; None: there are no more in all.  Ranks are
    counted in steps of 2 ** 0.25, of which the driver sees the sizes."""
    most = MOST_TERMS if most is None else most
    steps = {r["k"]: r["n"] for r in terms.groupBy(F.floor(F.log2(rank) * 4).alias("k")).agg(F.count("*").alias("n")).collect()}
    if sum(steps.values()) <= most:
        return None
    held, least = 0, max(steps) + 1
    for k in sorted(steps, reverse=True):
        if (held := held + steps[k]) > most:
            break
        least = k
    return least


def with_terms(rows: DataFrame, side: DataFrame, rank: Column, name: str) -> list[DataFrame]:
    """``rows`` joined to ``side``, which has a row for each term, as one table or two.

    The side is stored.  Its terms of highest ``rank`` (used in most rows) are
    broadcast, so rows of common words stay where they are and no word is a hot
    key; the rows of all other terms, few in a text, move to their terms.
    """
    out = stored(side.withColumn("__rank", rank), name)
    least = least_common(out, F.col("__rank"))
    if least is None:
        return [rows.join(F.broadcast(out.drop("__rank")), "term")]
    common = F.floor(F.log2("__rank") * 4) >= least
    top, rest = out.filter(common).drop("__rank"), out.filter(~common).drop("__rank")
    return [rows.join(F.broadcast(top), "term"), rows.join(F.broadcast(top.select("term")), "term", "left_anti").join(rest, "term")]


def together(parts: list[DataFrame]) -> DataFrame:
    return functools.reduce(DataFrame.unionByName, parts)

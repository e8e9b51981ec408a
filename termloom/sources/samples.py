"""Reading, keeping and refreshing sample sets."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from termloom.functions.scalars import dotted_date, excel_1904
from termloom.operators.ranking import with_position

SAMPLE = T.StructType([T.StructField(n, t, n != "sample_id") for n, t in (("sample_id", T.LongType()), ("category_id", T.LongType()), ("date", T.TimestampType()), ("title", T.StringType()), ("key", T.StringType()), ("url", T.StringType()), ("version", T.StringType()), ("content", T.StringType()), ("cat1", T.StringType()), ("cat2", T.StringType()), ("cat3", T.StringType()), ("samples_name", T.StringType()))])


def import_rows(raw: DataFrame, samples_name: str, first_id: int = 0) -> DataFrame:
    """Sample rows of a sheet with columns CATEGORY, CONTENT, TITLE, DATE, KEY,
    URL, CAT1..3, of which CONTENT alone must be there.

    Empty content is null; DATE is ``y.m.d`` or a 1904 serial, else now; ids
    follow the order of the rows' hashes from ``first_id``, so an import gives
    the same ids every time.
    """
    has = {c.upper(): c for c in raw.columns}
    if "CONTENT" not in has:
        raise ValueError("a sheet needs a CONTENT column")
    text = lambda n, d=None: F.col(has[n]).cast("string") if n in has else F.lit(d).cast("string")
    name = lambda n: F.trim(F.coalesce(text(n), F.lit("")))
    serial = F.when(text("DATE").rlike(r"^[0-9]+(\.[0-9]+)?$") & ~text("DATE").rlike(r"^[0-9]+\.[0-9]+\.[0-9]+$"), excel_1904(F.try_to_number(text("DATE"), F.lit("999999.999999")).cast("double")))
    rows = raw.select(
        F.lit(None).cast("long").alias("category_id"),
        F.coalesce(dotted_date(text("DATE")), serial, F.current_timestamp()).alias("date"),
        F.coalesce(text("TITLE"), F.lit("")).alias("title"), F.coalesce(text("KEY"), F.lit("")).alias("key"), F.coalesce(text("URL"), F.lit("")).alias("url"),
        F.lit("1").alias("version"), F.nullif(text("CONTENT"), F.lit("")).alias("content"),
        name("CAT1").alias("cat1"), name("CAT2").alias("cat2"), name("CAT3").alias("cat3"), F.lit(samples_name).alias("samples_name"),
    )
    keyed = rows.withColumn("__key", F.md5(F.concat_ws("\x00", "title", "key", "url", F.coalesce("content", F.lit("\x01")), "cat1", "cat2", "cat3")))
    placed = with_position(keyed, "__key", "sample_id", prefix=3, ties=("title", "url")).drop("__key")
    return placed.withColumn("sample_id", F.col("sample_id") + first_id).select(*SAMPLE.names)


def import_csv(spark: SparkSession, path: str, samples_name: str, first_id: int = 0) -> DataFrame:
    raw = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return import_rows(raw, samples_name, first_id)


def next_id(samples: DataFrame) -> int:
    return samples.agg(F.coalesce(F.max("sample_id") + 1, F.lit(0))).first()[0]


def save(samples: DataFrame, path: str, mode: str = "append") -> None:
    """Parquet, one folder a sample set."""
    samples.write.mode(mode).partitionBy("samples_name").parquet(path)


def load(spark: SparkSession, path: str, samples_name: str | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    return rows if samples_name is None else rows.filter(F.col("samples_name") == samples_name)


def sample_sets(samples: DataFrame) -> DataFrame:
    return samples.select("samples_name").distinct()


def lookup(samples: DataFrame, sample_id: int) -> DataFrame:
    return samples.filter(F.col("sample_id") == sample_id)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """path and content of every file below a folder."""
    return spark.read.option("recursiveFileLookup", True).text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("content"))


def refreshed(samples: DataFrame, fetch: Callable[[str], tuple[int, str]]) -> DataFrame:
    """Content of null or empty samples fetched anew: the body if the status is
    2xx, empty for another status, null if ``fetch`` raises."""
    need = samples.filter((F.col("content").isNull() | (F.col("content") == "")) & (F.length("url") > 0)).select("sample_id", "url")

    def get(batches):
        for b in batches:
            out = []
            for url in b["url"]:
                try:
                    status, body = fetch(url)
                    out.append(body if 200 <= status < 300 else "")
                except Exception:
                    out.append(None)
            yield pd.DataFrame({"sample_id": b["sample_id"], "__new": out, "__tried": True})

    got = need.mapInPandas(get, "sample_id long, __new string, __tried boolean")
    joined = samples.join(got, "sample_id", "left")
    return joined.withColumn("content", F.when(F.col("__tried"), F.col("__new")).otherwise(F.col("content"))).select(*samples.columns)

"""Filters, subsets and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.operators.categories import roll_up
from termloom.operators.ranking import first_by_hash, ordered, with_position


def content_status(content: Column) -> Column:
    """``null``: never fetched, ``empty``: fetched without a body, else ``normal``."""
    return F.when(content.isNull(), "null").when(content == "", "empty").otherwise("normal")


def purged(samples: DataFrame, main_categories: list[str]) -> DataFrame:
    return samples.filter((F.length("content") > 0) & F.col("cat1").isin(*main_categories))


def keep_terms(tf: DataFrame, terms: DataFrame) -> DataFrame:
    """Only the given terms; lengths of samples are not taken anew."""
    return tf.join(terms.select("term"), "term", "left_semi")


def clone(tf: DataFrame, samples: DataFrame | None = None, terms: DataFrame | None = None) -> DataFrame:
    out = tf if samples is None else tf.join(samples.select("sample_id"), "sample_id", "left_semi")
    return out if terms is None else keep_terms(out, terms)


def by_category_1(samples: DataFrame, category_id: int) -> DataFrame:
    """is_positive for the id itself and everything below it."""
    c = F.col("category_id")
    return samples.withColumn("is_positive", (c == category_id) | (roll_up(c, 1) == category_id))


def by_category_2(samples: DataFrame, category_id: int) -> DataFrame:
    """Samples of the same level-1 category; positive is the exact id only, so
    level-3 children are negatives."""
    c = F.col("category_id")
    return samples.filter(roll_up(c, 1) == category_id // 1_000_000 * 1_000_000).withColumn("is_positive", c == category_id)


def complement(samples: DataFrame, chosen: DataFrame) -> DataFrame:
    return samples.join(chosen.select("sample_id"), "sample_id", "left_anti")


def positional(samples: DataFrame, start: int, count: int, name: str = "") -> DataFrame:
    """Rows start .. start + count of the order by the id as text, renumbered
    from 0, with a default label."""
    keyed = samples.withColumn("__key", F.col("sample_id").cast("string"))
    placed = ordered(keyed, "__key", name="__at")
    out = placed.filter((F.col("__at") >= start) & (F.col("__at") < start + count))
    return out.withColumns({"new_id": F.col("__at") - start, "label": F.concat(F.lit(name), F.col("__key"))}).drop("__key", "__at")


def sample_k(samples: DataFrame, k: int) -> DataFrame:
    """Exactly k rows, the same ones on every run."""
    return first_by_hash(samples, "sample_id", k)


def split_by_ratio(samples: DataFrame, ratio: float) -> tuple[DataFrame, DataFrame]:
    """int(n * ratio + 0.5) rows without replacement, and the rest."""
    n = samples.count()
    first = sample_k(samples, int(n * ratio + 0.5))
    return first, complement(samples, first)


def hidden_positives(samples: DataFrame, positive_ratio: float, negative_ratio: float) -> DataFrame:
    """fold of each sample of (sample_id, is_positive): ``p`` known positives,
    ``hidden`` positives put among the unlabelled, ``u`` unlabelled, ``out``
    positives that are left over.  A ratio of 1 keeps every positive known."""
    positives = samples.filter("is_positive")
    n = positives.count()
    known = int(n * positive_ratio)
    hidden = int((n - known) * negative_ratio)
    placed = with_position(positives.withColumn("__md5", F.md5(F.col("sample_id").cast("string"))), "__md5", "__at", prefix=3, ties=("sample_id",))
    fold = F.when(F.col("__at") < known, "p").when(F.col("__at") < known + hidden, "hidden").otherwise("out")
    rest = samples.filter("not is_positive").select("sample_id", F.lit("u").alias("fold"))
    return placed.select("sample_id", fold.alias("fold")).unionByName(rest)

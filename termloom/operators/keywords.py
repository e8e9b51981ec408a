"""Keyword scores: how specific a term is and how evenly it is spread."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.counts import term_stats


@dataclass(frozen=True)
class Thresholds:
    degree: float
    speciality: float
    popularity: float


#: The product of two shares seldom reaches 1; the sum does.
KEYWORD_QUERY = Thresholds(1.0, 0.8, 0.01)
RELIABLE_NEGATIVES = Thresholds(1.0, 0.8, 0.3)
PU_TEST = Thresholds(0.4, 0.8, 0.01)


def speciality(tf_p: DataFrame, tf_u: DataFrame) -> DataFrame:
    """term, speciality: a term's rate in P over its rates in P and U; 1 where
    U lacks it."""

    def rates(tf: DataFrame, name: str) -> DataFrame:
        used = term_stats(tf).select("term", "term_used")
        total = used.agg(F.sum("term_used").alias("__total"))
        return used.crossJoin(F.broadcast(total)).select("term", (F.col("term_used") / F.col("__total")).alias(name))

    return rates(tf_p, "p").join(rates(tf_u, "u"), "term", "left").select("term", (F.col("p") / (F.col("p") + F.coalesce("u", F.lit(0.0)))).alias("speciality"))


def popularity(tf_p: DataFrame, dim_p: DataFrame) -> DataFrame:
    """term, popularity: entropy of a term's rates over P's samples, divided by
    ln of the number of all P samples.

    With r = n / length, S = sum r and R = sum r ln r the entropy of r / S is
    ln S - R / S, so one aggregation gives it.
    """
    count = dim_p.agg(F.count("*").cast("double").alias("__docs"))
    r = tf_p.join(dim_p.select("sample_id", "sample_terms"), "sample_id").select("term", (F.col("n") / F.col("sample_terms")).alias("r"))
    sums = r.groupBy("term").agg(F.sum("r").alias("s"), F.sum(F.col("r") * F.ln("r")).alias("w"))
    value = F.when(F.col("__docs") > 1, F.greatest((F.ln("s") - F.col("w") / F.col("s")) / F.ln(F.greatest("__docs", F.lit(2.0))), F.lit(0.0))).otherwise(0.0)
    return sums.crossJoin(F.broadcast(count)).select("term", value.alias("popularity"))


def positive_degree(tf_p: DataFrame, tf_u: DataFrame, dim_p: DataFrame, combine: str = "product", sensitive: DataFrame | None = None) -> DataFrame:
    """term, degree, speciality, popularity; sensitive terms (term, weight)
    have their weight and shares of 1."""
    both = speciality(tf_p, tf_u).join(popularity(tf_p, dim_p), "term")
    degree = F.col("speciality") * F.col("popularity") if combine == "product" else F.col("speciality") + F.col("popularity")
    out = both.select("term", degree.alias("degree"), "speciality", "popularity")
    if sensitive is None:
        return out
    joined = out.join(sensitive.select("term", F.col("weight").alias("__w")), "term", "left")
    one = lambda c: F.when(F.col("__w").isNotNull(), 1.0).otherwise(F.col(c)).alias(c)
    return joined.select("term", F.coalesce("__w", "degree").alias("degree"), one("speciality"), one("popularity"))


def select_terms(degrees: DataFrame, limits: Thresholds) -> DataFrame:
    r = lambda c: F.round(F.col(c), 9)
    return degrees.filter((r("degree") >= limits.degree) & (r("speciality") >= limits.speciality) & (r("popularity") >= limits.popularity))


def degrees_by_category(tf: DataFrame, dim: DataFrame, categories: DataFrame, combine: str = "product") -> DataFrame:
    """category, term, degree, speciality, popularity, each category against
    all other samples, in one grouped query."""
    members = categories.select("sample_id", "category")
    all_used = term_stats(tf).select("term", F.col("term_used").alias("all_used"))
    all_total = tf.agg(F.sum("n").alias("all_total"))
    rows = tf.join(members, "sample_id").join(dim.select("sample_id", "sample_terms"), "sample_id").withColumn("r", F.col("n") / F.col("sample_terms"))
    each = rows.groupBy("category", "term").agg(F.sum("n").alias("used"), F.sum("r").alias("s"), F.sum(F.col("r") * F.ln("r")).alias("w"))
    total = rows.groupBy("category").agg(F.sum("n").alias("total"))
    docs = members.groupBy("category").agg(F.count("*").cast("double").alias("docs"))
    x = each.join(total, "category").join(docs, "category").join(all_used, "term").crossJoin(F.broadcast(all_total))
    p = F.col("used") / F.col("total")
    u = F.coalesce(F.try_divide(F.col("all_used") - F.col("used"), F.nullif(F.col("all_total") - F.col("total"), F.lit(0))), F.lit(0.0))
    spread = F.when(F.col("docs") > 1, F.greatest((F.ln("s") - F.col("w") / F.col("s")) / F.ln(F.greatest("docs", F.lit(2.0))), F.lit(0.0))).otherwise(0.0)
    y = x.select("category", "term", (p / (p + u)).alias("speciality"), spread.alias("popularity"))
    return y.withColumn("degree", F.col("speciality") * F.col("popularity") if combine == "product" else F.col("speciality") + F.col("popularity"))


def category_weights(tf: DataFrame, dim: DataFrame, categories: DataFrame, limits: Thresholds = KEYWORD_QUERY, combine: str = "sum") -> tuple[DataFrame, DataFrame]:
    """(by category, by sample): keyword degrees (category, term, degree) and
    the cells (sample_id, category, term, weight) in which a sample's keywords
    have their degree in its own category; samples without one have no cell."""
    by_category = select_terms(degrees_by_category(tf, dim, categories, combine), limits).select("category", "term", "degree")
    cells = tf.join(categories.select("sample_id", "category"), "sample_id").join(by_category, ["category", "term"])
    return by_category, cells.select("sample_id", "category", "term", F.col("degree").alias("weight"))


def sample_degrees(tf: DataFrame, dim: DataFrame, degrees: DataFrame, most: int = 20, order: str = "asc") -> DataFrame:
    """sample_id, score: the sum of at most ``most`` keyword degrees over ln of
    the length, by default of the lowest; lengths 0 and 1 score 0."""
    by = [F.col("degree").asc() if order == "asc" else F.col("degree").desc(), F.col("term")]
    ranked = tf.join(degrees.select("term", "degree"), "term").withColumn("__k", F.row_number().over(W.partitionBy("sample_id").orderBy(*by)))
    sums = ranked.filter(F.col("__k") <= most).groupBy("sample_id").agg(F.sum("degree").alias("v"))
    score = F.when(F.col("sample_terms") > 1, F.coalesce("v", F.lit(0.0)) / F.ln(F.greatest("sample_terms", F.lit(2)).cast("double"))).otherwise(0.0)
    return dim.join(sums, "sample_id", "left").select("sample_id", score.alias("score"))


def sample_keywords(tf: DataFrame, degrees: DataFrame, sample_id: int) -> DataFrame:
    """Keyword table of one sample."""
    return tf.filter(F.col("sample_id") == sample_id).join(degrees, "term").select("term", "n", "degree", "speciality", "popularity")

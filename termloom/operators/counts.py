"""Sample and term matrices in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sample_dim(samples: DataFrame, tf: DataFrame) -> DataFrame:
    """sample_id, sample_terms and distinct_terms; samples without a term stay."""
    sums = tf.groupBy("sample_id").agg(F.sum("n").alias("sample_terms"), F.count("*").alias("distinct_terms"))
    return samples.select("sample_id").join(sums, "sample_id", "left").fillna(0, ["sample_terms", "distinct_terms"])


def term_stats(tf: DataFrame) -> DataFrame:
    """term, term_used and term_samples: the matrix by terms."""
    return tf.groupBy("term").agg(F.sum("n").alias("term_used"), F.count("*").alias("term_samples"))


def totals(samples: DataFrame, tf: DataFrame) -> DataFrame:
    """One row: total_terms_used, total_samples, total_terms."""
    used = term_stats(tf).agg(F.coalesce(F.sum("term_used"), F.lit(0)).alias("total_terms_used"), F.count("*").alias("total_terms"))
    return used.crossJoin(samples.agg(F.count("*").alias("total_samples")))  # one row by one row


def term_category_spread(cells: DataFrame, categories: DataFrame, least_used: int = 50) -> DataFrame:
    """How a term's weight is spread over level-2 categories.

    ``cells`` are (sample_id, term, n, weight).  For terms used at least ``least_used`` times: weight, count and weight
    ratio in each category, and the deviation of the ratios over all known
    categories, absent ones adding nothing.
    """
    known = categories.select(F.countDistinct("category_2").alias("k"))
    placed = cells.join(categories.withColumn("__in", F.lit(True)), "sample_id", "left")
    each = placed.groupBy("term", "category_2", "__in").agg(F.sum("weight").alias("weight"), F.sum("n").alias("n"))
    own = W.partitionBy("term")  # a row for each category at most
    common = each.withColumn("__used", F.sum("n").over(own)).filter(F.col("__in") & (F.col("__used") >= least_used)).drop("__used", "__in")
    ratio = common.withColumn("ratio", F.try_divide("weight", F.sum("weight").over(own))).crossJoin(F.broadcast(known))
    centred = ratio.withColumn("mean", F.sum("ratio").over(own) / F.col("k"))
    return centred.withColumn("sd", F.sqrt(F.sum(F.pow(F.col("ratio") - F.col("mean"), 2) / F.col("k")).over(own))).drop("mean", "k")

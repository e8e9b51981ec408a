"""Feature weights over (sample_id, term, n)."""

from __future__ import annotations

from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.counts import term_stats
from termloom.plans.storage import together, with_terms


class Weighting(Enum):
    TFIDF = 0
    TFRF = 1
    TFIPNDF = 2


def _lengths(dim: DataFrame) -> DataFrame:
    """Few beside the counts, which need no order to be joined to them."""
    return dim.select("sample_id", "sample_terms").hint("shuffle_hash")


def tfidf(tf: DataFrame, dim: DataFrame, terms: DataFrame | None = None, smooth: float = 0.0, with_n: bool = False) -> DataFrame:
    """weight = n / sample_terms * ln(N / df + smooth), explicit zeros kept.

    ``dim`` has every sample's length, also of samples without terms; N counts
    them all.  ``terms`` only filters.  ``with_n`` keeps the counts.  A word of
    every sample is one key with a row for each, so common terms' idf is
    broadcast and only rare words move (``with_terms``).
    """
    n = dim.agg(F.count("*").cast("double").alias("__docs"))
    kept = tf if terms is None else tf.join(terms.select("term"), "term", "left_semi")
    idf = term_stats(tf).crossJoin(F.broadcast(n)).select("term", F.ln(F.col("__docs") / F.col("term_samples") + smooth).alias("__idf"), "term_samples")
    weight = (F.col("n") / F.col("sample_terms") * F.col("__idf")).alias("weight")
    sized = kept.join(_lengths(dim), "sample_id")
    return together([x.select("sample_id", "term", *["n"] * with_n, weight) for x in with_terms(sized, idf, F.col("term_samples"), "idf")])


def tfidf_frobenius(tf: DataFrame, dim: DataFrame, use_idf: bool = True) -> DataFrame:
    """tf-idf with ln(N / df + 0.01), scaled by the norm of the whole matrix."""
    raw = tfidf(tf, dim, smooth=0.01)
    if not use_idf:
        raw = tf.join(_lengths(dim), "sample_id").select("sample_id", "term", (F.col("n") / F.col("sample_terms")).alias("weight"))
    norm = raw.agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("__norm"))
    return raw.crossJoin(F.broadcast(norm)).select("sample_id", "term", F.try_divide("weight", F.nullif("__norm", F.lit(0.0))).alias("weight"))


def tfrf(tf: DataFrame, dim: DataFrame, targets: DataFrame) -> DataFrame:
    """weight = n / sample_terms * rf; a, c are token counts in target 1, -1:
    rf = ln(2 + a / c + 1), or ln(2 + a) where c is 0."""
    sums = tf.join(targets.hint("shuffle_hash"), "sample_id").groupBy("term").agg(F.sum(F.when(F.col("target") == 1, F.col("n")).otherwise(0)).alias("a"), F.sum(F.when(F.col("target") == -1, F.col("n")).otherwise(0)).alias("c"))
    rf = sums.select("term", F.when(F.col("c") != 0, F.ln(F.try_divide("a", F.nullif("c", F.lit(0))) + 3)).otherwise(F.ln(F.col("a") + 2)).alias("rf"), (F.col("a") + F.col("c") + 1).alias("used"))
    weight = (F.col("n") / F.col("sample_terms") * F.col("rf")).alias("weight")
    return together([x.select("sample_id", "term", weight) for x in with_terms(tf.join(_lengths(dim), "sample_id"), rf, F.col("used"), "rf")])


def given(tf: DataFrame, weights: DataFrame) -> DataFrame:
    """Each term's given weight, whatever its count; ``weights`` (term, weight)
    may have term_samples, by which common terms are told."""
    rank = F.col("term_samples") if "term_samples" in weights.columns else F.lit(1)
    side = weights.select("term", "weight", *["term_samples"] * ("term_samples" in weights.columns))
    return together([x.select("sample_id", "term", "weight") for x in with_terms(tf, side, rank, "given")])


def transform(tf: DataFrame, dim: DataFrame, kind: Weighting, targets: DataFrame | None = None, weights: DataFrame | None = None) -> DataFrame:
    if kind is Weighting.TFIDF:
        return tfidf(tf, dim, weights)
    if kind is Weighting.TFRF:
        return given(tf, weights) if weights is not None else tfrf(tf, dim, targets)
    return tf.select("sample_id", "term", F.col("n").cast("double").alias("weight"))

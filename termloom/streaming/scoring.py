"""Scoring a stream of texts with fixed term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.text import letter_words


def scored(stream: DataFrame, weights: DataFrame, bias: float = 0.0) -> DataFrame:
    """(sample_id, ts, content) with the sum of its tokens' weights, stateless.

    ``weights`` (term, weight) is joined to each micro-batch as a static side;
    duplicates within a text count each time.  Use in ``foreachBatch`` or on a
    batch frame, as the sum is over one micro-batch's rows.
    """
    words = stream.select("sample_id", "ts", F.explode_outer(letter_words(F.coalesce("content", F.lit("")))).alias("term"))
    joined = words.join(weights.select("term", "weight"), "term", "left")
    return joined.groupBy("sample_id", "ts").agg((F.coalesce(F.sum("weight"), F.lit(0.0)) + bias).alias("score"))


def windowed_counts(stream: DataFrame, window: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """Event counts by tumbling window and type; events later than
    ``lateness`` are dropped by the watermark."""
    return stream.withWatermark("ts", lateness).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")

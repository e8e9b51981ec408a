"""Vocabularies: term ids by binary order of the term."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.ranking import with_position


def vocabulary(tf: DataFrame) -> DataFrame:
    """term, term_id: ids from 0 in order of the terms."""
    return with_position(tf.select("term").distinct(), "term", "term_id")


def ids_of(terms: DataFrame, vocab: DataFrame) -> DataFrame:
    """term_id of each term, -1 for unknown ones."""
    return terms.join(vocab, "term", "left").withColumn("term_id", F.coalesce("term_id", F.lit(-1).cast("long")))


def diff(source: DataFrame, target: DataFrame, add_missing: bool = False) -> DataFrame:
    """term, from_id, to_id.  Terms that ``target`` lacks are dropped, or get
    new ids after its greatest."""
    a, b = source.select("term", F.col("term_id").alias("from_id")), target.select("term", F.col("term_id").alias("to_id"))
    both = a.join(b, "term")
    if not add_missing:
        return both
    top = target.agg(F.coalesce(F.max("term_id") + 1, F.lit(0)).alias("top"))
    fresh = with_position(a.join(b, "term", "left_anti"), "term", "at").crossJoin(F.broadcast(top))
    return both.unionByName(fresh.select("term", "from_id", (F.col("at") + F.col("top")).alias("to_id")))


def merge(target: DataFrame, source: DataFrame) -> DataFrame:
    """term, term_id of both: ``target`` keeps its ids, new terms follow."""
    added = diff(source, target, add_missing=True).select("term", F.col("to_id").alias("term_id"))
    return target.select("term", "term_id").unionByName(added.join(target, "term", "left_anti"))


def synced(tokens: DataFrame, target: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged vocabulary, tokens with its ids): every token keeps a place."""
    merged = merge(target, vocabulary(tokens))
    return merged, tokens.join(merged, "term")


def rekeyed(tokens: DataFrame, idmap: DataFrame) -> DataFrame:
    """Token rows (…, term) with ids of the map; unmapped tokens go."""
    return tokens.join(idmap.select("term", F.col("to_id").alias("term_id")), "term")

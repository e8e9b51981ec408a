"""Export shapes: each function gives the rows or lines, ``write_lines`` and
Spark's writers put them down."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.operators.selection import content_status

CELL = 32767


def sample_sheet(samples: DataFrame) -> DataFrame:
    """CATEGORY, DATE, CAT1, CAT2, TITLE, KEY, URL, CONTENT; null content is
    empty and long content is cut to a cell, as the sheet format asks."""
    content = F.coalesce("content", F.lit(""))
    return samples.select(F.col("category_id").alias("CATEGORY"), F.col("date").alias("DATE"), F.col("cat1").alias("CAT1"), F.col("cat2").alias("CAT2"), F.col("title").alias("TITLE"), F.col("key").alias("KEY"), F.col("url").alias("URL"), F.when(F.length(content) > CELL, F.substring(content, 1, CELL)).otherwise(content).alias("CONTENT"))


def url_report(samples: DataFrame) -> DataFrame:
    """url, status and the status's place, without empty urls."""
    status = content_status(F.col("content"))
    named = F.when(status == "null", "None").when(status == "empty", "Empty").otherwise("Normal")
    return samples.filter(F.length("url") > 0).select("url", named.alias("status"), F.when(status == "null", 0).when(status == "empty", 1).otherwise(2).alias("place"))


def svm_lines(weights: DataFrame, labels: DataFrame, include_null: bool = False) -> DataFrame:
    """sample_id, line: ``label idx:weight ...``, indices ascending from 0.

    ``weights`` (sample_id, idx, weight), ``labels`` (sample_id, label).
    """
    cells = weights.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("cells"))
    text = F.array_join(F.transform("cells", lambda x: F.format_string("%d:%.6f", x["idx"], x["weight"])), " ")
    rows = labels.join(cells, "sample_id", "left" if include_null else "inner")
    return rows.select("sample_id", F.rtrim(F.concat_ws(" ", F.col("label").cast("string"), F.coalesce(text, F.lit("")))).alias("line"))


def keyword_lines(degrees: DataFrame, *keep: str) -> DataFrame:
    """degree, line of (term_id, term, degree, speciality, popularity)."""
    return degrees.select(*keep, "degree", "speciality", "popularity", "term_id", F.format_string("%d %s %.6f(%.6f,%.6f)", "term_id", "term", "degree", "speciality", "popularity").alias("line"))


def prediction_lines(scores: DataFrame) -> DataFrame:
    """score, line of (sample_id, label, score, title)."""
    return scores.select("score", "sample_id", F.format_string("[%d]  - %s - Score: %.6f %s", "sample_id", F.col("label").cast("string"), "score", F.coalesce("title", F.lit(""))).alias("line"))


def weight_lines(weights: DataFrame) -> DataFrame:
    """weight, idx, line ``word(idx) weight`` of (term, idx, weight)."""
    return weights.select("weight", "idx", F.format_string("%s(%d) %s", "term", "idx", F.col("weight").cast("string")).alias("line"))


def vocabulary_lines(vocab: DataFrame) -> DataFrame:
    """term_id, line ``id word pos`` of (term_id, term, pos)."""
    return vocab.select("term_id", F.format_string("%d %s %s", "term_id", "term", F.coalesce("pos", F.lit(""))).alias("line"))


def count_lines(tf: DataFrame, ids: DataFrame) -> DataFrame:
    """sample_id, line ``word(id):n ...`` in order of the ids."""
    cells = tf.join(ids, "term").groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("term_id", "term", "n"))).alias("cells"))
    return cells.select("sample_id", F.array_join(F.transform("cells", lambda x: F.format_string("%s(%d):%d", x["term"], x["term_id"], x["n"])), " ").alias("line"))


def projection_lines(points: DataFrame) -> DataFrame:
    """x, y, category and title of plotted points, three decimals each."""
    return points.select(F.format_string("%.3f", "x").alias("x"), F.format_string("%.3f", "y").alias("y"), F.col("category").alias("cat"), F.col("title").alias("t"))


def word_lines(tokens: DataFrame) -> DataFrame:
    """sample_id, line: ``id word:pos ...`` in token order."""
    cells = tokens.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("at", "word", "pos"))).alias("cells"))
    return cells.select("sample_id", F.concat_ws(" ", F.col("sample_id").cast("string"), F.array_join(F.transform("cells", lambda x: F.concat_ws(":", x["word"], x["pos"])), " ")).alias("line"))


def sample_ranks(scores: DataFrame, keywords: DataFrame, most: int = 10) -> DataFrame:
    """sample_id, score and the ``most`` best keywords of each sample."""
    best = keywords.withColumn("__k", F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("degree"), "term"))).filter(F.col("__k") <= most)
    lists = best.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("__k", "term"))).alias("__l"))
    return scores.join(lists, "sample_id", "left").select("sample_id", "score", F.coalesce(F.transform("__l", lambda x: x["term"]), F.array().cast("array<string>")).alias("keywords"))


def write_lines(lines: DataFrame, path: str, *order: Column | str) -> None:
    """Text files that follow ``order`` through all parts."""
    (lines.orderBy(*order) if order else lines).select("line").write.mode("overwrite").text(path)


def category_sheet(usage: DataFrame, categories: DataFrame) -> DataFrame:
    """ID, CAT1, CAT2, CAT3, SAMPLES of every known category."""
    return usage.filter("known").join(categories, "category_id").select(F.col("category_id").alias("ID"), F.col("cat1").alias("CAT1"), F.col("cat2").alias("CAT2"), F.col("cat3").alias("CAT3"), F.col("samples").alias("SAMPLES"))


def content_pages(samples: DataFrame) -> DataFrame:
    """sample_id, line: title and content under headings."""
    return samples.select("sample_id", F.concat(F.lit("== Title ==\n"), F.coalesce("title", F.lit("")), F.lit("\n== Content ==\n"), F.coalesce("content", F.lit(""))).alias("line"))

"""A training corpus from ``documents``: quality, near-duplicates, benchmark
passages, personal data, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes each result as Parquet in the shared folder and reads it
again.  All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm import decontam, neardup, packing, pii, quality
from termloom.llm.common import materialize, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained quality classifier accepts.

    A null or empty text is scored like any other, a null lang or source is a
    value of its own; a very long text is scored whole; repeated rows share one
    fate; an empty table stays empty.  Columns beyond ``COLUMNS`` go, here and in
    the stages below, so their names never clash.
    """
    scored = quality.score_quality(docs.select(*COLUMNS), table(spark, sf_dir, "labels"))
    return scored.filter("accepted").select(*COLUMNS)


def dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The least doc_id of each near-duplicate group (five-word shingles, 0.8).

    Texts that are null or without words have no copies and stay, and so do rows
    with a null doc_id; rows that share a doc_id are one document and stay or go
    together; very long texts are compared whole; an empty table stays empty.
    """
    gone = neardup.near_duplicates(docs, words=5, percent=80).filter("not kept").select("doc_id").distinct()
    return docs.select(*COLUMNS).join(materialize(gone, "near-copies"), "doc_id", "left_anti").select(*COLUMNS)


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of eight words of any benchmark item and
    with one shorter item at most.

    Texts that are null or without words stay; very long texts are searched
    whole; repeated rows share one fate; an empty table stays empty.
    """
    found = decontam.contamination(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark"), full_suffices=True)
    return found.filter("not contaminated").select(*COLUMNS)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by ``<KIND>``; n_chars follows.

    A null text stays null, an empty one empty; very long texts are searched
    whole; repeated rows are redacted alike; an empty table stays empty.
    """
    clean = pii.redact(pii.find_pii(docs.select(*COLUMNS)))
    n_chars = F.when(F.size("spans") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return clean.withColumn("n_chars", n_chars).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens and their places in sequences.

    A null text is empty and gives its end id alone; a very long one gives as
    many pieces as it needs; repeated rows and rows with a null doc_id are packed
    each; an empty table gives no piece.
    """
    return packing.pack_documents(docs, capacity=1024)


STAGES = [("quality", quality_stage), ("near_duplicates", dedup_stage), ("decontamination", decontaminate_stage), ("pii", pii_stage), ("packing", packing_stage)]

#: The classifier of the first stage is not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}

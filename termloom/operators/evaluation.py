"""Evaluation in the replicated naming: the second letter is the true class,
the first the predicted one, so ``fp`` is a missed positive."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _share(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), F.nullif(b.cast("double"), F.lit(0.0))), F.lit(0.0))


def confusion(labelled: DataFrame) -> DataFrame:
    """tp, fp, tn, fn of (target, predicted) rows."""
    t, p = F.col("target"), F.col("predicted")
    return labelled.agg(F.count_if((t == 1) & (p == 1)).alias("tp"), F.count_if((t == 1) & (p == -1)).alias("fp"), F.count_if((t == -1) & (p == 1)).alias("tn"), F.count_if((t == -1) & (p == -1)).alias("fn"))


def report(counts: DataFrame) -> DataFrame:
    """Precision, recall and F1 of both classes, 0 where undefined."""
    c = {n: F.col(n) for n in ("tp", "fp", "tn", "fn")}
    out = counts.select("tp", "fp", "tn", "fn", _share(c["tp"], c["tp"] + c["tn"]).alias("p_precision"), _share(c["tp"], c["tp"] + c["fp"]).alias("p_recall"), _share(c["fn"], c["fn"] + c["fp"]).alias("n_precision"), _share(c["fn"], c["fn"] + c["tn"]).alias("n_recall"))
    f1 = lambda a, b: _share(2 * F.col(a) * F.col(b), F.col(a) + F.col(b))
    return out.withColumns({"p_f1": f1("p_precision", "p_recall"), "n_f1": f1("n_precision", "n_recall")})


def spy_report(split: DataFrame) -> DataFrame:
    """Of (target, reliable) rows: tn true negatives and tp leaked positives
    among reliable ones, fp and fn among the rest, and two accuracies."""
    t, r = F.col("target"), F.col("reliable")
    out = split.agg(F.count_if(r & (t == -1)).alias("tn"), F.count_if(r & (t == 1)).alias("tp"), F.count_if(~r & (t == 1)).alias("fp"), F.count_if(~r & (t == -1)).alias("fn"))
    return out.withColumns({"accuracy": _share(F.col("tn"), F.col("tn") + F.col("tp")), "accuracy_table": _share(F.col("tn"), F.col("tn") + F.col("fp"))})


def recall_at(scores: DataFrame, k: int) -> DataFrame:
    """multiple (1..3), recall: the share of the hidden rows among the k, 2k
    and 3k highest scores of (sample_id, score, hidden)."""
    top = scores.orderBy(F.desc("score"), "sample_id").limit(3 * k)  # the measure's own cut
    ranked = top.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "sample_id")))  # 3k rows
    hidden = scores.agg(F.count_if("hidden").alias("__h"))
    counts = ranked.agg(*(F.count_if(F.col("hidden") & (F.col("rank") <= m * k)).alias(f"m{m}") for m in (1, 2, 3))).crossJoin(hidden)
    return counts.select(F.explode(F.array(*(F.struct(F.lit(m).alias("multiple"), _share(F.col(f"m{m}"), F.col("__h")).alias("recall")) for m in (1, 2, 3)))).alias("x")).select("x.*")


def head_accuracy(labelled: DataFrame, n: int) -> DataFrame:
    """accuracy over all rows, over the n rows of least place, and the share of
    predicted positives that are among them, of (place, target, predicted)."""
    right, head, yes = F.col("target") == F.col("predicted"), F.col("place") < n, F.col("predicted") == 1
    return labelled.agg(_share(F.count_if(right), F.count("*")).alias("accuracy"), _share(F.count_if(right & head), F.count_if(head)).alias("head_accuracy"), _share(F.count_if(yes & head), F.count_if(yes)).alias("head_precision"))


def class_report(labelled: DataFrame) -> DataFrame:
    """class, precision, recall, f1, support of (target, predicted) rows."""
    cells = labelled.groupBy("target", "predicted").agg(F.count("*").alias("n"))
    by_target = cells.groupBy(F.col("target").alias("class")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("target") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hit"))
    by_pred = cells.groupBy(F.col("predicted").alias("class")).agg(F.sum("n").alias("called"))
    out = by_target.join(by_pred, "class", "full").fillna(0)
    out = out.select("class", _share(F.col("hit"), F.col("called")).alias("precision"), _share(F.col("hit"), F.col("support")).alias("recall"), "support")
    return out.withColumn("f1", _share(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))

"""Registered queries of the library over the driver's tables.

``documents`` is the sample set: lang, source and a length class are the three
category levels; documents labelled toxic are the positives, all others are
unlabelled.  ``benchmark`` is a second sample set.  Their DuckDB twins are in
``twins``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.functions import scalars, segmentation
from termloom.operators import bayes, categories, classifiers, counts, evaluation, keywords, ranking, selection, sets, spies, text, vocabulary, weighting
from termloom.plans import learning
from termloom.plans.storage import stored
from termloom.plans.twins import TWINS
from termloom.sources import sinks, spider
from termloom.streaming import scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _samples(spark, d) -> DataFrame:
    return _table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("text").alias("content"))


def _second(spark, d) -> DataFrame:
    return _table(spark, d, "benchmark").select(F.col("item_id").alias("sample_id"), F.col("text").alias("content"))


def _categorised(spark, d) -> DataFrame:
    n = F.col("n_chars")
    size = F.when(n < 1000, "short").when(n < 5000, "medium").otherwise("long")
    return _table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), F.col("lang").alias("cat1"), F.col("source").alias("cat2"), size.alias("cat3"))


def _assigned(spark, d) -> DataFrame:
    rows = _categorised(spark, d)
    return categories.assigned(rows, categories.tree(rows)).select("sample_id", "category_id")


def _positives(spark, d) -> DataFrame:
    marked = _table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("sample_id")).distinct()
    return _samples(spark, d).select("sample_id").join(marked, "sample_id", "left_semi")


def _unlabelled(spark, d) -> DataFrame:
    return _samples(spark, d).select("sample_id").join(_positives(spark, d), "sample_id", "left_anti")


def _tf(spark, d) -> DataFrame:
    return text.term_counts(_samples(spark, d))


def _sides(spark, d):
    """tf stored once, positives, unlabelled and dimensions."""
    tf, p = text.stored_counts(_samples(spark, d)), stored(_positives(spark, d), "positives")
    dim = counts.sample_dim(_samples(spark, d), tf)
    u = _samples(spark, d).select("sample_id").join(p, "sample_id", "left_anti")
    return tf, dim, p, u


def _degrees(spark, d, **options) -> DataFrame:
    tf, dim, p, u = _sides(spark, d)
    side = lambda s: tf.join(s, "sample_id", "left_semi")
    return keywords.positive_degree(side(p), side(u), dim.join(p, "sample_id", "left_semi"), **options)


def _six(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n), 6) for n in names})


def _pages(spark, d) -> DataFrame:
    page = F.col("page_id")
    content = F.when(page % 7 == 0, None).when(page % 11 == 0, "").otherwise(F.col("html"))
    return _table(spark, d, "pages").select(F.col("page_id").alias("sample_id"), "url", content.alias("content"), F.concat(F.lit("c"), (page % 5).cast("string")).alias("cat1"), F.concat(F.lit("s"), (page % 3).cast("string")).alias("cat2"))


def _spider(spark, d) -> DataFrame:
    name = F.get_json_object("props", "$.k")
    return _table(spark, d, "events").select(
        F.concat(F.lit("event/"), F.col("event_id").cast("string")).alias("url"),
        F.struct(F.unix_timestamp("ts").alias("publish_time"), F.when(F.col("event_id") % 4 != 0, F.col("event_type")).alias("title"), F.when(F.col("event_id") % 9 == 0, "").otherwise(F.col("event_type")).alias("text"), F.col("event_type").alias("type"), F.struct(name.alias("keyword")).alias("extra")).alias("result"),
    )


def flagship(spark: SparkSession, d: str) -> DataFrame:
    w = weighting.tfidf(*_tf_dim(spark, d))
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc(F.round("weight", 9)), "term"))
    return _six(w.withColumn("rank", rank).filter("rank <= 10"), "weight")


# --- counts -------------------------------------------------------------------


@query
def tf_counts(spark, d):
    return _tf(spark, d)


@query
def term_stats(spark, d):
    return counts.term_stats(_tf(spark, d))


@query
def total_terms(spark, d):
    return counts.totals(_samples(spark, d), _tf(spark, d))


@query
def char_ngrams4(spark, d):
    return text.ngram_totals(_samples(spark, d))


@query
def doc_lengths(spark, d):
    return counts.sample_dim(_samples(spark, d), _tf(spark, d))


@query
def document_frequency(spark, d):
    return counts.term_stats(_tf(spark, d)).select("term", F.col("term_samples").alias("df"))


@query
def term_category_matrix(spark, d):
    tf = text.stored_counts(_samples(spark, d))
    cells = weighting.tfidf(tf, counts.sample_dim(_samples(spark, d), tf), with_n=True)
    cats = _assigned(spark, d).select("sample_id", categories.roll_up(F.col("category_id"), 2).alias("category_2"))
    return _six(counts.term_category_spread(cells, cats), "weight", "ratio", "sd")


@query
def top_terms_per_doc(spark, d):
    rank = F.row_number().over(W.partitionBy("sample_id").orderBy(F.desc("n"), "term"))
    return _tf(spark, d).filter("n > 1").withColumn("rank", rank)


@query
def flagship_tfidf_top10(spark, d):
    return flagship(spark, d)


# --- vocabulary ---------------------------------------------------------------


def _vocabularies(spark, d):
    """Terms and ids are stored: each is read more than once, and texts are cut once."""
    own = lambda tf, name: stored(vocabulary.vocabulary(stored(tf.select("term").distinct(), f"{name}-terms")), name)
    return own(_tf(spark, d), "vocabulary"), own(text.term_counts(_second(spark, d)), "second-vocabulary")


@query
def vocab_ids(spark, d):
    return _vocabularies(spark, d)[0]


@query
def vocab_diff(spark, d):
    a, b = _vocabularies(spark, d)
    return vocabulary.diff(b, a, add_missing=True)


@query
def vocab_merge(spark, d):
    a, b = _vocabularies(spark, d)
    return vocabulary.merge(a, b)


@query
def vocab_transform(spark, d):
    a, b = _vocabularies(spark, d)
    kept = vocabulary.rekeyed(text.tokens(_second(spark, d)), vocabulary.diff(b, a))
    return kept.groupBy("sample_id").agg(F.count("*").alias("length"), F.countDistinct("term_id").alias("terms"), F.sum("term_id").alias("id_sum"))


@query
def vocab_lookup(spark, d):
    a, b = _vocabularies(spark, d)
    return vocabulary.ids_of(b.select("term"), a)


# --- categories ---------------------------------------------------------------


@query
def category_ids(spark, d):
    return categories.tree(_categorised(spark, d))


@query
def category_rollup(spark, d):
    rows = _assigned(spark, d).withColumn("category_id", F.when(F.col("sample_id") % 10 == 0, F.lit(-1).cast("long")).otherwise(F.col("category_id")))
    c = F.col("category_id")
    return rows.select("sample_id", "category_id", categories.roll_up(c, 1).alias("level_1"), categories.roll_up(c, 2).alias("level_2"))


@query
def category_usage(spark, d):
    rows = _categorised(spark, d)
    tree = categories.tree(rows)
    used = categories.assigned(rows, tree).select("sample_id", F.when(F.col("sample_id") % 10 == 0, F.lit(77).cast("long")).otherwise(F.col("category_id")).alias("category_id"))
    return categories.usage(used, tree)


@query
def category_names(spark, d):
    tree = categories.tree(_categorised(spark, d))
    return categories.named(category_rollup(spark, d).select("sample_id", "category_id"), tree)


@query
def category_remap(spark, d):
    mapping = spark.createDataFrame([("en", "src0", "english", "zero"), ("fr", "src1", "french", "one"), ("de", "src2", "en", "src0")], "cat1 string, cat2 string, new_cat1 string, new_cat2 string")
    return categories.remapped(_categorised(spark, d), F.broadcast(mapping)).select("sample_id", "cat1", "cat2", "cat3")


@query
def category_report(spark, d):
    rows = _categorised(spark, d)
    tree = categories.tree(rows)
    return sinks.category_sheet(categories.usage(categories.assigned(rows, tree), tree), tree)


@query
def category_cube(spark, d):
    return _categorised(spark, d).rollup("cat1", "cat2", "cat3").agg(F.count("*").alias("samples"))


@query
def invalid_category_hist(spark, d):
    return categories.pair_counts(_pages(spark, d).filter(~F.col("cat1").isin("c0", "c1")))


# --- selection ----------------------------------------------------------------


@query
def content_status(spark, d):
    return _pages(spark, d).groupBy(selection.content_status(F.col("content")).alias("status")).agg(F.count("*").alias("samples"))


@query
def purge(spark, d):
    return selection.purged(_pages(spark, d), ["c0", "c1", "c2"]).select("sample_id", "cat1", "cat2")


@query
def url_report(spark, d):
    return sinks.url_report(_pages(spark, d))


@query
def sample_sheet(spark, d):
    rows = _pages(spark, d).select(F.lit(None).cast("long").alias("category_id"), F.lit(None).cast("timestamp").alias("date"), "cat1", "cat2", F.lit("t").alias("title"), F.lit("k").alias("key"), "url", F.repeat("content", 40).alias("content"))
    return sinks.sample_sheet(rows).select("CAT1", "CAT2", "TITLE", "KEY", "URL", F.md5("CONTENT").alias("CONTENT_MD5"), F.length("CONTENT").alias("CONTENT_LENGTH"))


@query
def spider_range(spark, d):
    bounds = _table(spark, d, "events").agg(F.date_format(F.min("ts"), "yyyy-MM-dd").alias("a")).first()["a"]
    return spider.in_range(_spider(spark, d), bounds, bounds).select("url", F.col("result.publish_time").alias("publish_time"), F.col("result.text").alias("text"))


@query
def spider_project(spark, d):
    return spider.flattened(_spider(spark, d), ["url", "publish_time", "title", "text"])


@query
def positional_subset(spark, d):
    return selection.positional(_samples(spark, d).select("sample_id"), 100, 250, "s")


@query
def hash_sample_k(spark, d):
    return selection.sample_k(_samples(spark, d).select("sample_id"), 137)


@query
def ratio_split(spark, d):
    a, b = selection.split_by_ratio(_samples(spark, d).select("sample_id"), 0.3)
    return a.withColumn("part", F.lit(1)).unionByName(b.withColumn("part", F.lit(2)))


@query
def cv_split(spark, d):
    p = _positives(spark, d).withColumn("is_positive", F.lit(True))
    return selection.hidden_positives(p.unionByName(_unlabelled(spark, d).withColumn("is_positive", F.lit(False))), 0.8, 0.5)


@query
def by_category_1(spark, d):
    return selection.by_category_1(_assigned(spark, d), 2_000_000)


@query
def by_category_2(spark, d):
    rows = _assigned(spark, d)
    level2 = rows.withColumn("category_id", F.when(F.col("sample_id") % 3 == 0, categories.roll_up(F.col("category_id"), 2)).otherwise(F.col("category_id")))
    return selection.by_category_2(level2, 2_025_000)


@query
def select_terms_keep_length(spark, d):
    tf = _tf(spark, d)
    common = counts.term_stats(tf).filter("term_used >= 50")
    dim = counts.sample_dim(_samples(spark, d), tf)
    return selection.keep_terms(tf, common).join(dim.select("sample_id", "sample_terms"), "sample_id")


@query
def clone_subset(spark, d):
    tf = _tf(spark, d)
    return counts.term_stats(selection.clone(tf, _positives(spark, d), counts.term_stats(tf).filter("term_samples >= 5")))


# --- sets ---------------------------------------------------------------------


@query
def merge_samples(spark, d):
    return counts.term_stats(sets.merged(_tf(spark, d), text.term_counts(_second(spark, d))))


@query
def append_samples(spark, d):
    label = lambda s, n: s.select("sample_id", F.concat(F.lit(n), F.col("sample_id").cast("string")).alias("label"))
    return sets.appended(label(_samples(spark, d), "d"), label(_second(spark, d), "b"))


@query
def set_difference(spark, d):
    return sets.difference(_tf(spark, d), text.term_counts(_second(spark, d)), "term")


@query
def set_intersection(spark, d):
    return sets.intersection(_tf(spark, d), text.term_counts(_second(spark, d)), "term")


# --- weights ------------------------------------------------------------------


def _tf_dim(spark, d):
    tf = text.stored_counts(_samples(spark, d))
    return tf, counts.sample_dim(_samples(spark, d), tf)


@query
def tfidf_py(spark, d):
    return _six(weighting.tfidf(*_tf_dim(spark, d)), "weight")


@query
def tfidf_cpp(spark, d):
    return _six(weighting.tfidf_frobenius(*_tf_dim(spark, d)), "weight")


@query
def tfrf(spark, d):
    p = _positives(spark, d).withColumn("target", F.lit(1)).unionByName(_unlabelled(spark, d).withColumn("target", F.lit(-1)))
    return _six(weighting.tfrf(*_tf_dim(spark, d), p), "weight")


@query
def tfrf_given(spark, d):
    tf = stored(_tf(spark, d), "tf")
    w = counts.term_stats(tf).filter("term_samples >= 20").select("term", (F.col("term_samples") / F.col("term_used")).alias("weight"), "term_samples")
    return _six(weighting.given(tf, w), "weight")


@query
def svm_lines(spark, d):
    tf, dim = _tf_dim(spark, d)
    index = vocabulary.vocabulary(tf).withColumnRenamed("term_id", "idx")
    labels = _samples(spark, d).select("sample_id", F.when(F.col("sample_id") % 2 == 0, 1).otherwise(-1).alias("label"))
    return sinks.svm_lines(weighting.tfidf(tf, dim).join(index, "term").select("sample_id", "idx", "weight"), labels)


# --- keywords -----------------------------------------------------------------


@query
def speciality(spark, d):
    return _six(_degrees(spark, d).select("term", "speciality"), "speciality")


@query
def popularity(spark, d):
    return _six(_degrees(spark, d).select("term", "popularity"), "popularity")


@query
def positive_degree(spark, d):
    return _six(_degrees(spark, d), "degree", "speciality", "popularity")


@query
def pd_select(spark, d):
    return _six(keywords.select_terms(_degrees(spark, d), keywords.PU_TEST), "degree", "speciality", "popularity")


@query
def pd_sum_form(spark, d):
    return _six(keywords.select_terms(_degrees(spark, d, combine="sum"), keywords.KEYWORD_QUERY), "degree", "speciality", "popularity")


@query
def pd_sensitive(spark, d):
    words = spark.createDataFrame([("idiot", 3.0), ("clown", 2.5), ("the", 0.25)], "term string, weight double")
    return _six(_degrees(spark, d, sensitive=F.broadcast(words)), "degree", "speciality", "popularity")


@query
def pd_by_category(spark, d):
    tf, dim = _tf_dim(spark, d)
    cats = _assigned(spark, d).select("sample_id", categories.roll_up(F.col("category_id"), 1).alias("category"))
    out = keywords.degrees_by_category(tf, dim, cats).filter(F.round("popularity", 9) > 0.3)
    return _six(out, "degree", "speciality", "popularity").select("category", "term", "degree", "speciality", "popularity")


@query
def sample_positive_degree(spark, d):
    tf, dim, p, u = _sides(spark, d)
    side = lambda s: tf.join(s, "sample_id", "left_semi")
    chosen = keywords.positive_degree(side(p), side(u), dim.join(p, "sample_id", "left_semi")).filter(F.round("speciality", 9) >= 0.6).withColumn("degree", F.round("degree", 6))
    return _six(keywords.sample_degrees(tf, dim, chosen), "score")


@query
def sample_keyword_table(spark, d):
    tf, dim, p, u = _sides(spark, d)
    side = lambda s: tf.join(s, "sample_id", "left_semi")
    degrees = keywords.positive_degree(side(p), side(u), dim.join(p, "sample_id", "left_semi"))
    return _six(keywords.sample_keywords(tf, degrees, 28), "degree", "speciality", "popularity")


@query
def keyword_extract(spark, d):
    tf = _tf(spark, d)
    n = _samples(spark, d).agg(F.count("*").cast("double").alias("n"))
    idf = counts.term_stats(tf).filter("term_samples >= 3").crossJoin(F.broadcast(n)).select("term", F.ln(F.col("n") / F.col("term_samples")).alias("idf"))
    stop = counts.term_stats(tf).filter("term_samples >= 200").select("term")
    return _six(segmentation.keywords(tf, idf, stop, 5), "score")


# --- naive Bayes --------------------------------------------------------------


def _trained(spark, d):
    tf, _, p, u = _sides(spark, d)
    resp = bayes.initial(p, u)
    return tf, p, u, bayes.class_prior(resp), bayes.feature_likelihood(tf, resp)


@query
def nb_class_prior(spark, d):
    return _six(_trained(spark, d)[3], "pr_c")


@query
def nb_feature_probs(spark, d):
    return _trained(spark, d)[4].withColumn("pr_f", F.round("pr_f", 9))


def _posterior(spark, d):
    tf, p, _, prior, likelihood = _trained(spark, d)
    post = bayes.posterior(_samples(spark, d), tf, prior, stored(likelihood, "likelihood"))
    target = p.withColumn("target", F.lit(1))
    return post.join(target, "sample_id", "left").withColumn("target", F.coalesce("target", F.lit(-1)))


@query
def nb_posterior(spark, d):
    return _six(_posterior(spark, d).select("sample_id", "p_pos", "p_neg", "predicted"), "p_pos", "p_neg")


@query
def confusion_matrix(spark, d):
    return evaluation.confusion(_posterior(spark, d))


@query
def prf_report(spark, d):
    return _six(evaluation.report(evaluation.confusion(_posterior(spark, d))), "p_precision", "p_recall", "n_precision", "n_recall", "p_f1", "n_f1")


@query
def class_report(spark, d):
    return _six(evaluation.class_report(_posterior(spark, d)), "precision", "recall", "f1")


@query
def head_accuracy(spark, d):
    rows = _posterior(spark, d).withColumn("place", F.col("sample_id"))
    return _six(evaluation.head_accuracy(rows, 100), "accuracy", "head_accuracy", "head_precision")


@query
def recall_at_k(spark, d):
    scores = _posterior(spark, d).select("sample_id", F.round("p_pos", 6).alias("score"), (F.col("target") == 1).alias("hidden"))
    return _six(evaluation.recall_at(scores, 20), "recall")


@query
def spy_threshold_split(spark, d):
    tf, _, p, u = _sides(spark, d)
    return _six(spies.spy_split(tf, p, u), "p_pos")


@query
def sem_report(spark, d):
    tf, _, p, u = _sides(spark, d)
    split = spies.spy_split(tf, p, u)
    quality = _table(spark, d, "labels").filter("quality = 0").select(F.col("doc_id").alias("sample_id")).distinct().withColumn("target", F.lit(1))
    rows = split.join(quality, "sample_id", "left").withColumn("target", F.coalesce("target", F.lit(-1)))
    return _six(evaluation.spy_report(rows), "accuracy", "accuracy_table")


@query
def em_converged(spark, d):
    tf, _, p, u = _sides(spark, d)
    return _six(bayes.expectation_maximisation(tf, p, u), "p_pos", "p_neg")


@query
def s_em_second_step(spark, d):
    tf, _, p, u = _sides(spark, d)
    split = stored(spies.spy_split(tf, p, u), "split")
    return _six(spies.second_step(tf, p, split.filter("reliable"), split.filter("not reliable")), "p_pos", "p_neg")


# --- classifiers (row checks only) ---------------------------------------------


def _vectors(spark, d):
    tf, dim = _tf_dim(spark, d)
    labels = _table(spark, d, "labels").groupBy(F.col("doc_id").alias("sample_id")).agg(F.max("toxic").alias("toxic"))
    rows = _samples(spark, d).select("sample_id").join(labels, "sample_id", "left")
    return classifiers.tfidf_vectors(tf, dim, rows.withColumn("target", F.when(F.col("toxic") == 1, 1).otherwise(-1)))


@query
def svm_biased_scores(spark, d):
    rows = _vectors(spark, d)
    return _six(classifiers.svm_scores(classifiers.biased_svm(rows.filter("toxic is not null")), rows), "score")


@query
def svm_ovr_predict(spark, d):
    rows = _vectors(spark, d)
    lang = _table(spark, d, "documents").select(F.col("doc_id").alias("sample_id"), "lang")
    label = F.when(F.col("lang") == "de", 0).when(F.col("lang") == "en", 1).when(F.col("lang") == "es", 2).otherwise(3)
    train = rows.join(lang, "sample_id").withColumn("label", label)
    return classifiers.one_vs_rest(train, 5).transform(train).select("sample_id", "lang", F.col("prediction").cast("int").alias("predicted"))


@query
def bagging_vote(spark, d):
    rows = _vectors(spark, d)
    return classifiers.bagging_vote(classifiers.bagging(rows.filter("toxic is not null")), rows)


@query
def bagging_report(spark, d):
    train = _vectors(spark, d).filter("toxic is not null")
    return _six(classifiers.bagging_report(classifiers.bagging(train), train), "accuracy", "oob_error")


@query
def train_and_eval(spark, d):
    rows = classifiers.train_and_eval(_vectors(spark, d).filter("toxic is not null"))[1]
    return evaluation.confusion(rows)


@query
def vocabulary_weights(spark, d):
    tf, _, p, u = _sides(spark, d)
    return _six(learning.vocabulary_weights(learning.biased_learning(tf, p, u, u)), "weight")


@query
def biased_learning_recall(spark, d):
    tf, _, p, u = _sides(spark, d)
    return _six(evaluation.recall_at(learning.biased_learning(tf, p, u, u).scores, 20), "recall")


@query
def spy_svm_predictions(spark, d):
    return _six(learning.spy_svm(*_sides(spark, d), keywords.Thresholds(0.6, 0.6, 0.01)).predictions, "score")


@query
def i_em_report(spark, d):
    tf, _, p, u = _sides(spark, d)
    return _six(learning.i_em(tf, p, u), "p_precision", "p_recall", "n_precision", "n_recall", "p_f1", "n_f1")


@query
def s_em_report(spark, d):
    return _six(learning.s_em(*_sides(spark, d), limits=keywords.Thresholds(0.6, 0.6, 0.01))[1], "p_precision", "p_recall", "n_precision", "n_recall", "p_f1", "n_f1")


@query
def pu_keyword_ranking(spark, d):
    return _six(learning.keyword_ranking(*_sides(spark, d), combine="sum")[1], "score")


@query
def pu_svm_targets(spark, d):
    tf, dim, p, u = _sides(spark, d)
    scores = learning.keyword_ranking(tf, dim, p, u, combine="sum")[1].withColumn("score", F.round("score", 6))
    return learning.pu_targets(p, scores).drop("place")


@query
def negative_prototypes(spark, d):
    tf, dim, p, u = _sides(spark, d)
    split = stored(spies.spy_split(tf, p, u), "split")
    return learning.prototypes(tf, dim, split.filter("reliable"), split.filter("not reliable"))


@query
def category_weight_matrix(spark, d):
    tf, dim = _tf_dim(spark, d)
    cats = _assigned(spark, d).select("sample_id", categories.roll_up(F.col("category_id"), 1).alias("category"))
    return _six(keywords.category_weights(tf, dim, cats)[1], "weight")


@query
def multicategory_predict(spark, d):
    tf, dim = _tf_dim(spark, d)
    known, tests = selection.split_by_ratio(_assigned(spark, d), 0.5)
    known = stored(known.select("sample_id", categories.roll_up(F.col("category_id"), 1).alias("category")), "known")
    own = lambda df: df.join(known, "sample_id", "left_semi")
    out = learning.multi_category(tf, own(dim), known, stored(tests, "tests"))
    truth = _assigned(spark, d).select("sample_id", categories.roll_up(F.col("category_id"), 1).alias("truth"))
    return out.join(truth, "sample_id")


@query
def kmeans_clusters(spark, d):
    rows = classifiers.from_arrays(_table(spark, d, "embeddings"), "embedding")
    return classifiers.kmeans(rows, classifiers.cluster_count(30, 100)).transform(rows).select("vec_id", F.col("prediction").alias("cluster"))


@query
def pca_2d(spark, d):
    rows = classifiers.from_arrays(_table(spark, d, "embeddings"), "embedding")
    return _six(classifiers.pca_2d(rows).select("vec_id", "label", "x", "y"), "x", "y")


# --- segmentation, scalars, streams ---------------------------------------------

_WORDS = ["the 900 r", "and 700 c", "of 650 p", "in 600 p", "tion 80 n", "ing 75 v", "er 70 n", "ed 65 v", "th 60 n", "re 55 v", "an 50 vn", "on 45 n", "thing 30 n", "there 25 r", "erth 20 n", "oration 9 n"]
_HMM = ["-0.5 -3.14e+100 -3.14e+100 -1.0", "-3.14e+100 -0.5 -1.0 -3.14e+100", "-0.6 -3.14e+100 -3.14e+100 -0.8", "-3.14e+100 -0.4 -1.2 -3.14e+100", "-0.7 -3.14e+100 -3.14e+100 -0.7", "t:-1.0,e:-1.2,a:-1.4", "h:-1.0,n:-1.3", "r:-1.0,o:-1.5", "s:-1.0,d:-1.1,é:-0.9"]


def _segmenter() -> segmentation.Segmenter:
    return segmentation.Segmenter(segmentation.Dictionary.parse(_WORDS, ["erthing n"]), segmentation.HiddenMarkov.parse(_HMM))


def _segmented(spark, d, mode: str) -> DataFrame:
    cut = segmentation.segment_column(spark, _segmenter(), mode)
    x = _second(spark, d).select("sample_id", F.posexplode(cut("content")).alias("at", "x"))
    return x.select("sample_id", "at", "x.word", "x.pos")


@query
def segment_mix(spark, d):
    return _segmented(spark, d, "mix")


@query
def segment_full(spark, d):
    return _segmented(spark, d, "full")


@query
def segment_query(spark, d):
    return _segmented(spark, d, "query")


@query
def segment_hmm(spark, d):
    return _segmented(spark, d, "hmm")


@query
def segment_level(spark, d):
    cut = segmentation.level_column(spark, _segmenter())
    return _second(spark, d).select("sample_id", F.posexplode(cut("content")).alias("at", "x")).select("sample_id", "at", "x.word", "x.level")


@query
def pos_tag(spark, d):
    kept = text.kept_by_pos(_segmented(spark, d, "mix"), "py")
    return kept.groupBy("sample_id", "word", "pos").agg(F.count("*").alias("n"))


@query
def word_lines(spark, d):
    return sinks.word_lines(_segmented(spark, d, "mp"))


@query
def hamming_within(spark, d):
    rows = _table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return rows.filter(scalars.hamming_within(F.col("o_orderkey"), F.col("o_custkey"), 3))


@query
def event_windows(spark, d):
    return scoring.windowed_counts(_table(spark, d, "events").select("ts", "event_type", "value")).withColumn("total", F.round("total", 4))


@query
def prediction_lines(spark, d):
    rows = _posterior(spark, d).select("sample_id", F.col("predicted").alias("label"), F.round("p_pos", 6).alias("score"), F.lit("t").alias("title"))
    return sinks.prediction_lines(rows).select("sample_id", "line")


@query
def ordered_positions(spark, d):
    return ranking.ordered(_table(spark, d, "customer").select("c_name"), "c_name", name="place")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(TWINS)

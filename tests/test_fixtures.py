"""Hand-computed values of small fixtures."""

import math

import pytest
from pyspark.sql import functions as F

from termloom.operators import bayes, categories, counts, evaluation, keywords, selection, sets, spies, text, weighting

TF = [(1, "a", 2), (1, "b", 1), (2, "b", 3), (3, "c", 1), (3, "a", 1)]


@pytest.fixture(scope="module")
def tf(spark):
    return spark.createDataFrame(TF, "sample_id long, term string, n long")


@pytest.fixture(scope="module")
def samples(spark):
    return spark.createDataFrame([(1,), (2,), (3,)], "sample_id long")


def rows(df, *keys):
    return {tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]: r for r in df.collect()}


def test_tfidf(tf, samples):
    got = rows(weighting.tfidf(tf, counts.sample_dim(samples, tf)), "sample_id", "term")
    want = {(1, "a"): 2 / 3 * math.log(1.5), (1, "b"): 1 / 3 * math.log(1.5), (2, "b"): math.log(1.5), (3, "c"): 0.5 * math.log(3), (3, "a"): 0.5 * math.log(1.5)}
    assert {k: r["weight"] for k, r in got.items()} == pytest.approx(want)


def test_frobenius_norm_is_one(tf, samples):
    w = weighting.tfidf_frobenius(tf, counts.sample_dim(samples, tf))
    assert w.agg(F.sum(F.col("weight") ** 2)).first()[0] == pytest.approx(1.0)


def test_explicit_zero_weight_stays(spark):
    tf = spark.createDataFrame([(1, "a", 1), (2, "a", 1)], "sample_id long, term string, n long")
    dim = counts.sample_dim(tf.select("sample_id"), tf)
    assert [r["weight"] for r in weighting.tfidf(tf, dim).collect()] == [0.0, 0.0]


def test_speciality_and_popularity(tf, samples):
    p = tf.filter("sample_id in (1, 3)")
    dim = counts.sample_dim(samples, tf).filter("sample_id in (1, 3)")
    got = rows(keywords.positive_degree(p, tf.filter("sample_id = 2"), dim), "term")
    assert got["a"]["speciality"] == 1 and got["c"]["speciality"] == 1
    assert got["b"]["speciality"] == pytest.approx(1 / 6)
    assert got["a"]["popularity"] == pytest.approx(0.985228, abs=1e-6)
    assert got["b"]["popularity"] == got["c"]["popularity"] == 0


def test_popularity_agrees_with_the_double_loop(spark):
    data = [(s, t, (s * 7 + ord(t)) % 5 + 1) for s in range(6) for t in "abc" if (s + ord(t)) % 3]
    tf = spark.createDataFrame(data, "sample_id long, term string, n long")
    dim = counts.sample_dim(tf.select("sample_id").distinct(), tf)
    length = {}
    for s, _, n in data:
        length[s] = length.get(s, 0) + n
    for r in keywords.popularity(tf, dim).collect():
        x = [n / length[s] for s, t, n in data if t == r["term"]]
        p = [v / sum(x) for v in x]
        assert r["popularity"] == pytest.approx(-sum(v * math.log(v) for v in p) / math.log(len(length)))


def test_naive_bayes(spark, tf, samples):
    resp = bayes.initial(samples.filter("sample_id = 1"), samples.filter("sample_id > 1"))
    lik = rows(bayes.feature_likelihood(tf, resp), "term", "c")
    want = {("a", 1): 0.5, ("b", 1): 2 / 6, ("c", 1): 1 / 6, ("a", -1): 0.25, ("b", -1): 0.5, ("c", -1): 0.25}
    assert {k: r["pr_f"] for k, r in lik.items()} == pytest.approx(want)
    post = rows(bayes.posterior(samples, tf, bayes.class_prior(resp), bayes.feature_likelihood(tf, resp)), "sample_id")
    assert post[1]["p_pos"] == pytest.approx(0.4)
    assert all(r["p_pos"] + r["p_neg"] == pytest.approx(1) for r in post.values())


def test_sample_without_terms_has_the_prior(spark, tf, samples):
    more = samples.unionByName(spark.createDataFrame([(9,)], "sample_id long"))
    resp = bayes.initial(more.filter("sample_id = 1"), more.filter("sample_id > 1"))
    post = rows(bayes.posterior(more, tf, bayes.class_prior(resp), bayes.feature_likelihood(tf, resp)), "sample_id")
    assert post[9]["p_pos"] == pytest.approx(0.25)


def test_em_stops(spark, tf, samples):
    truth = spark.createDataFrame([(2, -1), (3, 1)], "sample_id long, target int")
    for stop in ("converged", "oracle"):
        post = bayes.expectation_maximisation(tf, samples.filter("sample_id = 1"), samples.filter("sample_id > 1"), stop=stop, truth=truth)
        assert {r["sample_id"] for r in post.collect()} == {2, 3}


def test_spy_split_covers_the_mixed_samples(spark):
    tf = spark.createDataFrame([(i, "p" if i < 20 else "q", 1) for i in range(40)], "sample_id long, term string, n long")
    ids = tf.select("sample_id")
    out = spies.spy_split(tf, ids.filter("sample_id < 20"), ids.filter("sample_id >= 20")).collect()
    assert {r["sample_id"] for r in out} == set(range(20, 40)) and all(r["reliable"] for r in out)


def test_evaluation_names(spark):
    cells = [(1, 1)] * 3 + [(1, -1)] + [(-1, 1)] * 2 + [(-1, -1)] * 4
    counted = evaluation.confusion(spark.createDataFrame(cells, "target int, predicted int"))
    r = evaluation.report(counted).first()
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == (3, 1, 2, 4)
    assert (r["p_precision"], r["p_recall"], r["n_precision"], r["n_recall"]) == pytest.approx((3 / 5, 3 / 4, 4 / 5, 4 / 6))


def test_undefined_shares_are_zero(spark):
    r = evaluation.report(evaluation.confusion(spark.createDataFrame([], "target int, predicted int"))).first()
    assert r["p_f1"] == 0 and r["n_f1"] == 0


def test_ids_in_order_of_their_text(spark):
    ids = spark.createDataFrame([(1,), (2,), (10,), (9,)], "sample_id long")
    got = selection.positional(ids, 0, 4).orderBy("new_id").collect()
    assert [r["sample_id"] for r in got] == [1, 10, 2, 9]


@pytest.mark.parametrize("size,grams", [(0, 0), (3, 0), (4, 1), (4000, 3001)])
def test_ngrams(spark, size, grams):
    df = spark.createDataFrame([(1, "x" * size)], "sample_id long, content string")
    assert text.tokens(df, text.Method.NGRAM).count() == grams


def test_ngram_places(spark):
    words = "".join(chr(97 + (k * k) % 26) + "é"[: k % 2] for k in range(150))
    df = spark.createDataFrame([(1, words), (2, None), (3, "abc")], "sample_id long, content string")
    for most in (3001, 130, 64):
        got = sorted((r["pos"], r["term"]) for r in text.tokens(df, text.Method.NGRAM, most=most).collect())
        assert got == [(i, words[i : i + 4]) for i in range(min(most, len(words) - 3))]


def test_unknown_method():
    with pytest.raises(ValueError):
        text.tokens(None, "jieba")


def test_category_ids(spark):
    rows_ = spark.createDataFrame([("a", "x", ""), ("a", "y", ""), ("b", "x", ""), ("b", "x", "p"), ("", "x", ""), (" a ", None, "q")], "cat1 string, cat2 string, cat3 string")
    tree = categories.tree(rows_)
    got = {(r["cat1"], r["cat2"], r["cat3"]): r["category_id"] for r in tree.collect()}
    assert got == {("a", "", ""): 1000000, ("b", "", ""): 2000000, ("a", "x", ""): 1001000, ("a", "y", ""): 1002000, ("b", "x", ""): 2003000, ("b", "x", "p"): 2003001}
    assert sorted(r["category_id"] for r in categories.assigned(rows_, tree).collect()) == [-1, 1000000, 1001000, 1002000, 2003000, 2003001]


def test_roll_up_is_floor(spark):
    r = spark.createDataFrame([(2003001,), (-1,)], "c long").select(categories.roll_up(F.col("c"), 1).alias("a"), categories.roll_up(F.col("c"), 2).alias("b")).collect()
    assert [tuple(x) for x in r] == [(2000000, 2003000), (-1000000, -1000)]


def test_merge_lets_the_right_side_stand(spark):
    a = spark.createDataFrame([(1, "a", 5), (2, "a", 1)], "sample_id long, term string, n long")
    b = spark.createDataFrame([(1, "b", 7)], "sample_id long, term string, n long")
    assert {tuple(r) for r in sets.merged(a, b).collect()} == {(2, "a", 1), (1, "b", 7)}


def test_full_positive_ratio_keeps_all(spark):
    df = spark.createDataFrame([(i, i < 5) for i in range(9)], "sample_id long, is_positive boolean")
    folds = [r["fold"] for r in selection.hidden_positives(df, 1.0, 0.5).collect()]
    assert folds.count("p") == 5 and folds.count("u") == 4


def test_exact_sample(spark):
    df = spark.range(100).withColumnRenamed("id", "sample_id")
    a, b = selection.split_by_ratio(df, 0.25)
    assert a.count() == 25 and b.count() == 75 and a.join(b, "sample_id").count() == 0

"""Learning drivers on separable toy data, against their definitions."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from termloom.operators import bayes, classifiers, clusters, counts, keywords, linear, ranking, spies, text, weighting
from termloom.plans import catalog, learning, storage
from termloom.sources import sinks

LIMITS = keywords.Thresholds(0.6, 0.6, 0.01)


@pytest.fixture(scope="module")
def world(spark):
    """Positives 0-39 say good words, unlabelled 100-179 bad ones; 100-109 are
    positives in truth."""
    data = []
    for i in [*range(40), *range(100, 180)]:
        good = i < 110
        data += [(i, ("g" if good else "b") + str((i * 7 + k) % 5), 1 + (i + k) % 3) for k in range(4)] + [(i, "both", 2)]
    tf = spark.createDataFrame(data, "sample_id long, term string, n long").groupBy("sample_id", "term").agg(F.sum("n").alias("n"))
    ids = tf.select("sample_id").distinct()
    p, u = ids.filter("sample_id < 40"), ids.filter("sample_id >= 100")
    return tf, counts.sample_dim(ids, tf), p, u


def test_spy_svm_finds_the_hidden_positives(world):
    run = learning.spy_svm(*world, LIMITS)
    got = {r["sample_id"]: r["predicted"] for r in run.predictions.collect()}
    assert got == {i: 1 if i < 110 else -1 for i in range(100, 180)}
    assert {r["sample_id"] for r in run.split.collect()} == set(range(100, 180))


def test_no_keyword_predicts_nothing_positive(world):
    run = learning.spy_svm(*world, keywords.Thresholds(9.0, 0.9, 0.9))
    assert {r["predicted"] for r in run.predictions.collect()} == {-1}


def test_hidden_fold_covers_all(world):
    _, _, p, u = world
    known, mixed, truth = learning.hidden_fold(p, u, 0.5, 1.0)
    assert known.count() == 20 and mixed.count() == 100 and truth.filter("target = 1").count() == 20


def test_reports(world):
    tf, dim, p, u = world
    r = learning.i_em(tf, p, u.filter("sample_id >= 110")).first()
    assert r["p_recall"] == 1 and r["p_precision"] == 1
    spy, svm = learning.s_em(tf, dim, p, u.filter("sample_id >= 110"), limits=LIMITS)
    assert spy.first()["accuracy"] >= 0.9 and svm.first()["p_recall"] == 1


def test_keyword_ranking_and_exchange_rows(world):
    tf, dim, p, u = world
    degrees, scores = learning.keyword_ranking(tf, dim, p, u, keywords.Thresholds(0.4, 0.6, 0.01), combine="sum")
    assert {r["term"] for r in degrees.collect()} == {f"g{k}" for k in range(5)}
    by = {r["sample_id"]: r["score"] for r in scores.collect()}
    assert min(by[i] for i in range(100, 110)) > 0 == max(by[i] for i in range(110, 180))
    low = learning.pu_targets(p, scores).collect()
    assert sum(r["label"] == 1 for r in low) == 40 and {r["sample_id"] for r in low if r["label"] == -1} == set(range(110, 150))
    high = learning.pu_targets(p, scores, predict=True).collect()
    assert len(high) == 40 and {r["sample_id"] for r in high} >= set(range(100, 110)) and {r["label"] for r in high} == {-1}


def test_biased_learning_and_its_model(spark, world, tmp_path):
    tf, _, p, u = world
    learned = learning.biased_learning(tf, p, u.filter("sample_id >= 110"), u, hidden=5, unlabelled_ratio=2.0)
    rows = learned.scores.collect()
    assert len(rows) == 85 and sum(r["hidden"] for r in rows) == 5
    assert min(r["score"] for r in rows if r["sample_id"] < 110) > max(r["score"] for r in rows if r["sample_id"] >= 110)
    weights = {r["term"]: r["weight"] for r in learning.vocabulary_weights(learned).collect()}
    assert min(weights[f"g{k}"] for k in range(5)) > max(weights[f"b{k}"] for k in range(5))
    classifiers.save_model(learned.model, str(tmp_path / "m"))
    assert list(classifiers.load_model(str(tmp_path / "m")).coefficients) == pytest.approx(list(learned.model.coefficients))
    assert sinks.weight_lines(learning.vocabulary_weights(learned)).first()["line"].startswith(("b", "g"))


def test_prototypes(world):
    tf, dim, p, u = world
    got = learning.prototypes(tf, dim, u.filter("sample_id >= 110"), p, scale=6).collect()
    assert {r["sample_id"] for r in got} == set(range(110, 180)) and len({r["cluster"] for r in got}) <= 3


def test_multi_category(world):
    tf, dim, p, u = world
    known = p.withColumn("category", F.lit(1000000).cast("long")).unionByName(u.filter("sample_id >= 150").withColumn("category", F.lit(2000000).cast("long")))
    own = dim.join(known, "sample_id", "left_semi")
    tests = u.filter("sample_id < 150")
    got = {r["sample_id"]: r["category"] for r in learning.multi_category(tf, own, known, tests).collect()}
    assert got == {i: 1000000 if i < 110 else 2000000 for i in range(100, 150)}
    one = learning.multi_category(tf, own, known.filter("category = 1000000"), tests)
    assert one.count() == 50


def test_category_weights_are_the_degrees(world):
    tf, dim, p, u = world
    cats = p.withColumn("category", F.lit(1)).unionByName(u.withColumn("category", F.lit(2)))
    by, cells = keywords.category_weights(tf, dim, cats, keywords.Thresholds(0.0, 0.0, 0.0))
    degree = {(r["category"], r["term"]): r["degree"] for r in by.collect()}
    assert all(r["weight"] == pytest.approx(degree[r["category"], r["term"]]) for r in cells.collect())
    assert cells.count() == tf.count()


def test_bagging_votes_and_out_of_bag_error(world):
    tf, _, p, u = world
    targets = p.withColumn("target", F.lit(1)).unionByName(u.filter("sample_id >= 110").withColumn("target", F.lit(-1)))
    cells = tf.select("sample_id", "term", F.col("n").cast("double").alias("weight"))
    train = classifiers.vectors(cells, classifiers.feature_index(cells), targets)
    bagged = classifiers.bagging(train, bags=3, bag_rows=10)
    drawn = {(r["bag"], r["sample_id"]) for r in bagged.bags.collect()}
    truth = {r["sample_id"]: r["target"] for r in targets.collect()}
    assert len(drawn) == 30 and {b for b, _ in drawn} == {0, 1, 2}
    ballots = {(b, r["sample_id"]): r["predicted"] for b, m in enumerate(bagged.models) for r in classifiers.svm_scores(m, train).collect()}
    assert {r["sample_id"]: r["votes"] for r in classifiers.bagging_vote(bagged, train).collect()} == {i: sum(ballots[b, i] == 1 for b in range(3)) for i in truth}

    def share(seen, wanted):
        right = []
        for i, t in truth.items():
            own = [ballots[b, i] for b in range(3) if seen or (b, i) not in drawn]
            right += [(1 if 2 * own.count(1) > len(own) else -1) == t] if own else []
        return sum(x == wanted for x in right) / len(right)

    got = classifiers.bagging_report(bagged, train).first()
    assert got["accuracy"] == pytest.approx(share(True, True)) and got["oob_error"] == pytest.approx(share(False, False))
    _, predicted = classifiers.train_and_eval(train, lambda t: classifiers.biased_svm(t, c_negative=1.0))
    assert predicted.count() == 110 and predicted.filter("target = predicted").count() >= 100


def test_counts_inside_a_row(spark):
    texts = ["b a b, A", None, "", "x", "éa éa 12 zz\nzz zz"]
    rows = spark.createDataFrame([*enumerate(texts), (4, "zz new")], "sample_id long, content string")
    got = sorted(tuple(r) for r in text.term_counts(rows.filter("content is null or content <> 'zz new'")).collect())
    assert got == [(4, "zz", 3), (4, "éa", 2)]
    assert sorted(tuple(r) for r in text.term_counts(rows, unique=False).collect()) == [(4, "new", 1), (4, "zz", 4), (4, "éa", 2)]


def test_places_in_any_order(spark):
    df = spark.range(1000).select("id", (F.col("id") % 7).alias("k")).repartition(5)
    got = ranking.ordered(df, F.desc("k"), "id", name="place").orderBy("place").collect()
    assert [r["place"] for r in got] == list(range(1000))
    assert [r["id"] for r in got] == sorted(range(1000), key=lambda i: (-(i % 7), i))
    assert ranking.ordered(df.limit(0), "id").collect() == []


def test_rare_terms_move_and_common_ones_are_broadcast(spark, world, monkeypatch):
    tf, dim, p, u = world
    place = "sample_id", "term"

    def results():
        rows = lambda df, *keys: [tuple(r) for r in df.orderBy(*keys).collect()]
        em = rows(bayes.expectation_maximisation(tf, p, u), "sample_id")
        second = rows(spies.second_step(tf, p, u.filter("sample_id >= 150"), u.filter("sample_id < 150")), "sample_id")
        post = bayes.posterior(u, tf, bayes.class_prior(bayes.initial(p, u)), bayes.feature_likelihood(tf, bayes.initial(p, u)))
        given = weighting.given(tf, counts.term_stats(tf).select("term", F.lit(0.5).alias("weight"), "term_samples"))
        vectors = [(r["sample_id"], r["features"]) for r in classifiers.tfidf_vectors(tf, dim, dim.select("sample_id")).orderBy("sample_id").collect()]
        return em, second, rows(post, "sample_id"), rows(weighting.tfidf(tf, dim), *place), rows(given, *place), vectors

    whole = results()
    monkeypatch.setattr(storage, "MOST_TERMS", 3)
    assert storage.least_common(counts.term_stats(tf), F.col("term_samples")) is not None
    for a, b in zip(whole, results(), strict=True):
        assert len(a) == len(b)
        assert all(x == (pytest.approx(y) if isinstance(x[-1], float | int) else y) for x, y in zip(a, b, strict=True))


def test_counts_stored_by_sample_stay_in_place(spark):
    rows = spark.createDataFrame([(i, f"aa bb{'x' * (i % 3)} cc" * (i % 4)) for i in range(50)], "sample_id long, content string")
    tf = text.stored_counts(rows)
    assert sorted(map(tuple, tf.collect())) == sorted(map(tuple, text.term_counts(rows).collect()))
    plan = tf.groupBy("sample_id").agg(F.sum("n"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_gram_totals_are_those_of_the_rows(spark):
    data = ["abcdabcd", "", None, "abc", "ab😀cd" * 3, "ab cd ef gh" * 400, "abcdé"]
    rows = spark.createDataFrame([*enumerate(data)], "sample_id long, content string")
    for n in (4, 30):
        cells = text.term_counts(rows, text.Method.NGRAM, n=n)
        want = cells.groupBy("term").agg(F.sum("n").alias("n"), F.count("*").alias("samples"))
        assert sorted(map(tuple, text.ngram_totals(rows, n).collect())) == sorted(map(tuple, want.collect()))


def test_a_bag_weighs_only_its_own_features(spark):
    cells = spark.createDataFrame([(i, f"w{i}", 1.0) for i in range(200)] + [(i, "odd" if i % 2 else "even", 1.0) for i in range(200)], "sample_id long, term string, weight double")
    targets = spark.range(200).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 2 == 1, 1).otherwise(-1).alias("target"))
    train = classifiers.vectors(cells, classifiers.feature_index(cells), targets)
    bagged = classifiers.bagging(train, bags=2, bag_rows=10)
    assert all(m.coefficients.size == 202 and len(m.coefficients.indices) <= 12 for m in bagged.models)
    assert {r["votes"] for r in classifiers.bagging_vote(bagged, train.filter("target = 1")).collect()} == {2}


def test_vocabularies_cut_texts_once(spark):
    plan = catalog.queries()["vocab_diff"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan


def test_machines_of_many_features_are_those_of_mllib_and_stay_on_the_executors(spark, monkeypatch, tmp_path):
    cells = spark.range(60).selectExpr("id sample_id", "explode(sequence(0, 6)) k").selectExpr("sample_id", "concat('w', (sample_id * (k + 3) + k * k) % 41) term", "1.0 / (1 + (sample_id + k) % 5) weight").dropDuplicates(["sample_id", "term"])
    targets = spark.range(62).select(F.col("id").alias("sample_id"), F.when(F.col("id") % 3 == 1, 1).otherwise(-1).alias("target"), (F.col("id") % 3).alias("label"), F.concat(F.lit("of "), "id").alias("kept"))
    rows = classifiers.vectors(cells, classifiers.feature_index(cells), targets)  # two rows are empty

    def results():
        model = classifiers.biased_svm(rows, c_negative=3.0, max_iter=12)
        scores = {r["sample_id"]: r["score"] for r in classifiers.svm_scores(model, rows).collect()}
        many = classifiers.one_vs_rest(rows, 2).transform(rows)
        return model, scores, {r["kept"]: r["prediction"] for r in many.select("kept", "prediction").collect()}

    whole, scores, many = results()
    monkeypatch.setattr(classifiers, "MOST_FEATURES", 5)
    monkeypatch.setattr(linear, "BLOCK_WEIGHTS", 30)
    model, own, others = results()
    assert isinstance(model, linear.Machines) and model.pieces > 1 and model.parts.count() == model.pieces
    assert own == pytest.approx(scores, abs=1e-6) and others == many
    assert list(model.coefficients) == pytest.approx(list(whole.coefficients), abs=1e-6)
    classifiers.save_model(model, str(tmp_path / "m"))
    assert {r["sample_id"]: r["score"] for r in classifiers.svm_scores(classifiers.load_model(str(tmp_path / "m")), rows).collect()} == pytest.approx(own)
    index = classifiers.feature_index(cells)
    weights = {r["idx"]: r["weight"] for r in classifiers.coefficients(model, index).collect()}
    assert [weights[i] for i in range(len(weights))] == pytest.approx(list(whole.coefficients), abs=1e-6)


def _toy_shares(spark, monkeypatch):
    """(shares, dense tf-idf) of 300 samples; the last has only the word of all samples, which weighs nothing."""
    monkeypatch.setattr(clusters, "BLOCK_CELLS", 200)
    monkeypatch.setattr(clusters, "SAMPLE_RANGE", 64)
    rng = np.random.default_rng(3)
    data = {(i, f"é{(i % 4) * 10 + int(t)}"): 1.0 + int(rng.integers(4)) for i in range(299) for t in rng.integers(0, 14, 6)}
    data |= {(i, "all"): 1.0 for i in range(300)}
    shares = spark.createDataFrame([(t, i, n) for (i, t), n in data.items()], "term string, place long, share double").repartition(3)
    terms = sorted({t for _, t in data})
    x = np.zeros((300, len(terms)))
    for (i, t), n in data.items():
        x[i, terms.index(t)] = n
    return shares, x * np.log(300 / (x > 0).sum(axis=0)), len(data)


def test_clusters_by_term_take_the_rounds_of_mllib(spark, monkeypatch):
    from pyspark.mllib.clustering import KMeans, KMeansModel

    shares, x, cells = _toy_shares(spark, monkeypatch)
    blocks = clusters.blocked(shares, 300, cells)
    some = x.any(axis=1)
    mix = np.zeros((5, 4))
    mix[[0, 0, 1, 2, 3, 4], [0, 1, 2, 3, 0, 1]] = 0.5, 0.5, 1, 1, 2, 40  # the last is so far that no sample comes
    rows = np.array([0, 9, 2, 150])
    first = mix @ x[rows]
    rdd = spark.sparkContext.parallelize([v.tolist() for v in x[some]], 2)
    for most in (1, 20):
        got = clusters.rounds(blocks, 300, clusters._layers(mix, rows, 300), 5, some, most)
        model = KMeans.train(rdd, 5, maxIterations=most, initialModel=KMeansModel([v.tolist() for v in first]))
        assert got[~some].tolist() == [-1] and got[some].tolist() == model.predict(rdd).collect()
        assert 4 not in got


def test_clusters_by_term_start_as_well_as_mllib_and_never_need_it(spark, world, monkeypatch):
    shares, x, cells = _toy_shares(spark, monkeypatch)
    monkeypatch.setattr(clusters, "MOST_CENTRES", 3)
    some = x.any(axis=1)
    cost = lambda label: sum(((x[label == c] - x[label == c].mean(axis=0)) ** 2).sum() for c in set(label[some]))
    got = clusters.kmeans(shares, 300, cells, 4)
    rows = classifiers.from_arrays(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x) if some[i]], "i int, v array<double>"), "v")
    theirs = np.full(300, -1)
    for r in classifiers.kmeans(rows, 4).transform(rows).select("i", "prediction").collect():
        theirs[r["i"]] = r["prediction"]
    assert set(got) == {-1, 0, 1, 2, 3} and cost(got) <= 1.1 * cost(theirs)
    few = spark.createDataFrame([(t, i, 1.0) for i in range(9) for t in ("ab", "cd")[i % 2]], "term string, place long, share double")
    same = clusters.kmeans(few, 9, 18, 5)
    assert len(set(same[::2])) == len(set(same[1::2])) == 1 and same[0] != same[1]  # two texts, so two clusters
    assert clusters.kmeans(few.limit(0), 2, 0, 3).tolist() == [-1, -1] and len(clusters.kmeans(few.limit(0), 0, 0, 3)) == 0
    monkeypatch.setattr(classifiers, "kmeans", None)  # its centres are dense
    tf, dim, p, u = world
    assert learning.prototypes(tf, dim, u, p).count() == 80
    assert learning.prototypes(tf, dim, u.limit(0), p).collect() == []

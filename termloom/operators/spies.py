"""Reliable negatives from spies, and the learning set built on them."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators import bayes, keywords
from termloom.operators.ranking import first_by_hash, ordered
from termloom.plans.storage import stored

SPY_SHARE, NOISE = 0.10, 0.15


def spy_threshold(spy_posterior: DataFrame, noise: float = NOISE) -> float:
    """The spy posterior at place int(n * noise) in ascending order."""
    n = spy_posterior.count()
    if not n:
        return 0.0
    return ordered(spy_posterior, "p_pos", "sample_id", name="place").filter(F.col("place") == int(n * noise)).first()["p_pos"]


def spy_split(tf: DataFrame, positives: DataFrame, mixed: DataFrame, share: float = SPY_SHARE, noise: float = NOISE, max_rounds: int = 1) -> DataFrame:
    """sample_id, p_pos, reliable for every mixed sample: reliable negatives
    score strictly below the spies' threshold."""
    n = positives.count()
    spies = stored(first_by_hash(positives.select("sample_id"), "sample_id", int(n * share)), "spies")
    known = positives.select("sample_id").join(spies, "sample_id", "left_anti")
    both = mixed.select("sample_id").unionByName(spies)
    post = stored(bayes.expectation_maximisation(tf, known, both, max_rounds=max_rounds), "spy-posterior")
    t = spy_threshold(post.join(spies, "sample_id", "left_semi"), noise)
    return post.join(spies, "sample_id", "left_anti").select("sample_id", "p_pos", (F.col("p_pos") < t).alias("reliable"))


def learning_set(tf: DataFrame, dim: DataFrame, positives: DataFrame, negatives: DataFrame, limits: keywords.Thresholds, combine: str = "product") -> tuple[DataFrame, DataFrame]:
    """(targets, terms): positives 1, reliable negatives that are not positives
    -1, and the keywords that separate them."""
    clean = negatives.select("sample_id").join(positives, "sample_id", "left_anti")
    targets = positives.select("sample_id", F.lit(1).alias("target")).unionByName(clean.select("sample_id", F.lit(-1).alias("target")))
    side = lambda s: tf.join(s.select("sample_id"), "sample_id", "left_semi")
    degrees = keywords.positive_degree(side(positives), side(clean), dim.join(positives.select("sample_id"), "sample_id", "left_semi"), combine)
    return targets, keywords.select_terms(degrees, limits)


def second_step(tf: DataFrame, positives: DataFrame, reliable: DataFrame, unknown: DataFrame, max_rounds: int | None = None) -> DataFrame:
    """EM from positives and reliable negatives over the unknown samples, until
    no prediction changes or for ``max_rounds`` rounds after the first."""
    resp, rounds = bayes.initial(positives, reliable), bayes.Rounds(tf)
    rounds.learn(bayes.shares(resp))
    post = stored(rounds.judge(unknown, bayes.class_prior(resp)), "second-step")
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        resp = bayes.initial(positives, reliable).unionByName(bayes.as_responsibilities(post))
        rounds.learn(bayes.shares(resp))
        after = stored(rounds.judge(unknown, bayes.class_prior(resp)), "second-step")
        if after.join(post, ["sample_id", "predicted"], "left_anti").isEmpty():
            return after
        post = after
    return post


def head(scores: DataFrame, n: int, lowest: bool = True) -> DataFrame:
    """The n lowest (or highest) samples of (sample_id, score)."""
    return ordered(scores, F.col("score").asc() if lowest else F.col("score").desc(), "sample_id", name="__place").filter(F.col("__place") < n).drop("__place")

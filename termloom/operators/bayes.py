"""Two-class naive Bayes over term presence, with EM.

Tables: resp (sample_id, c, pr), tf (sample_id, term, n), prior (c, pr_c) and
likelihood (term, c, pr_f).  Products are sums of logs.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.operators.counts import term_stats
from termloom.plans import storage
from termloom.plans.storage import bucketed, stored, together, with_terms


def initial(positives: DataFrame, others: DataFrame) -> DataFrame:
    """Responsibilities: positives are 1 for class 1, others for class -1."""
    one = lambda df, p: df.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("c"), F.lit(p).alias("pr")), F.struct(F.lit(-1).alias("c"), F.lit(1.0 - p).alias("pr")))).alias("x")).select("sample_id", "x.*")
    return one(positives, 1.0).unionByName(one(others, 0.0))


def class_prior(resp: DataFrame) -> DataFrame:
    n = resp.agg(F.countDistinct("sample_id").alias("__n"))
    return resp.groupBy("c").agg(F.sum("pr").alias("s")).crossJoin(F.broadcast(n)).select("c", (F.col("s") / F.col("__n")).alias("pr_c"))


def _wide(resp: DataFrame) -> DataFrame:
    """sample_id, p, q of responsibilities."""
    share = lambda c, name: F.coalesce(F.sum(F.when(F.col("c") == c, F.col("pr"))), F.lit(0.0)).alias(name)
    return resp.groupBy("sample_id").agg(share(1, "p"), share(-1, "q"))


def _term_sums(tf: DataFrame, shares: DataFrame) -> DataFrame:
    """term, p, q: counts weighed by (sample_id, p, q), which are few beside the counts."""
    return tf.join(shares.hint("shuffle_hash"), "sample_id").groupBy("term").agg(F.sum(F.col("n") * F.col("p")).alias("p"), F.sum(F.col("n") * F.col("q")).alias("q"))


def _probabilities(sums: DataFrame) -> DataFrame:
    """sums with pr_p and pr_q."""
    total = sums.agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"), F.count("*").alias("v"))
    pr = lambda s: (1 + F.col(s)) / (F.col("v") + F.col(f"all_{s}"))
    return sums.crossJoin(F.broadcast(total)).withColumns({"pr_p": pr("p"), "pr_q": pr("q")}).drop("all_p", "all_q", "v")


def feature_likelihood(tf: DataFrame, resp: DataFrame) -> DataFrame:
    """(1 + sum n pr) / (V + sum over all terms); V: distinct training terms."""
    one = lambda c, name: F.struct(F.lit(c).alias("c"), F.col(name).alias("pr_f"))
    return _probabilities(_term_sums(tf, _wide(resp))).select("term", F.explode(F.array(one(1, "pr_p"), one(-1, "pr_q"))).alias("x")).select("term", "x.*")


def _log_sums(parts: list[DataFrame]) -> DataFrame:
    """sample_id, lp, ln of cells with lp and ln in one table or more: each is
    summed where it lies, and only sums of samples meet."""
    each = [x.groupBy("sample_id").agg(F.sum("lp").alias("lp"), F.sum("ln").alias("ln")) for x in parts]
    return each[0] if len(each) == 1 else together(each).groupBy("sample_id").agg(F.sum("lp").alias("lp"), F.sum("ln").alias("ln"))


def _judged(samples: DataFrame, logs: DataFrame, prior: DataFrame) -> DataFrame:
    both = prior.agg(*(F.coalesce(F.max(F.when(F.col("c") == c, F.ln("pr_c"))), F.lit(float("-inf"))).alias(n) for c, n in ((1, "bp"), (-1, "bn"))))
    x = samples.select("sample_id").join(logs, "sample_id", "left").crossJoin(F.broadcast(both))
    x = x.select("sample_id", (F.coalesce("lp", F.lit(0.0)) + F.col("bp")).alias("a"), (F.coalesce("ln", F.lit(0.0)) + F.col("bn")).alias("b"))
    gap = F.least(F.greatest(F.col("b") - F.col("a"), F.lit(-700.0)), F.lit(700.0))
    p = 1 / (1 + F.exp(gap))
    q = 1 / (1 + F.exp(-gap))
    return x.select("sample_id", p.alias("p_pos"), q.alias("p_neg"), F.when(F.col("a") >= F.col("b"), 1).otherwise(-1).alias("predicted"))


def posterior(samples: DataFrame, tf: DataFrame, prior: DataFrame, likelihood: DataFrame) -> DataFrame:
    """sample_id, p_pos, p_neg, predicted.  Each distinct term counts once (tf
    has one row for each sample and term), whatever its n; a sample without terms has the prior; a term that training lacks gives no
    evidence; ties are positive."""
    wide = likelihood.groupBy("term").agg(*(F.max(F.when(F.col("c") == c, F.ln("pr_f"))).alias(n) for c, n in ((1, "lp"), (-1, "ln"))))
    least = wide.agg(F.min("lp").alias("__lp"), F.min("ln").alias("__ln"))
    used = F.exp(F.col("lp") - F.col("__lp")) + F.exp(F.col("ln") - F.col("__ln"))  # grows with the term's count in training
    side = wide.crossJoin(F.broadcast(least)).select("term", "lp", "ln", used.alias("used"))
    return _judged(samples, _log_sums(with_terms(tf.select("sample_id", "term"), side, F.coalesce("used", F.lit(1.0)), "log-likelihood")), prior)


class Rounds:
    """Repeated naive Bayes over one stored ``tf``.

    Counts do not move again: those of the most common terms meet broadcast
    likelihoods, those of rare terms are stored a second time by term.  Sums by
    term are carried from round to round, and only samples whose
    responsibilities changed are added to them; a change below 1e-20 is lost in
    a sum of 1 and more.
    """

    def __init__(self, tf: DataFrame):
        self.tf, self.rare, self.common = tf, None, None
        terms = stored(term_stats(tf).select("term", "term_samples"), "em-terms")
        least = storage.least_common(terms, F.col("term_samples"))
        if least is not None:
            self.common = stored(terms.filter(F.floor(F.log2("term_samples") * 4) >= least).select("term"), "em-common")
            parts = int(tf.sparkSession.conf.get("spark.sql.shuffle.partitions"))
            rare = tf.select("sample_id", "term").join(F.broadcast(self.common), "term", "left_anti")
            self.rare = bucketed(rare.repartition(parts, "term"), "term", parts, "em-rare")
        self.sums, self.shares = None, None

    def learn(self, shares: DataFrame) -> None:
        """Takes (sample_id, p, q) of all training samples, a stored table; those of the last call stay among them."""
        if self.sums is None:
            self.sums = stored(_term_sums(self.tf, shares), "em-sums")
        else:
            old = self.shares.select("sample_id", F.col("p").alias("__p"), F.col("q").alias("__q"))
            gap = lambda c: F.col(c) - F.coalesce(f"__{c}", F.lit(0.0))
            moved = shares.join(old, "sample_id", "left").select("sample_id", gap("p").alias("p"), gap("q").alias("q"), F.col("__p").isNull().alias("new"))
            moved = moved.filter(F.col("new") | (F.abs("p") > 1e-20) | (F.abs("q") > 1e-20)).drop("new")
            self.sums = stored(self.sums.unionByName(_term_sums(self.tf, moved)).groupBy("term").agg(F.greatest(F.sum("p"), F.lit(0.0)).alias("p"), F.greatest(F.sum("q"), F.lit(0.0)).alias("q")), "em-sums")
        self.shares = shares

    def judge(self, samples: DataFrame, prior: DataFrame) -> DataFrame:
        logs = _probabilities(self.sums).select("term", F.ln("pr_p").alias("lp"), F.ln("pr_q").alias("ln"))
        cells = self.tf.select("sample_id", "term")
        if self.common is None:
            return _judged(samples, _log_sums([cells.join(F.broadcast(logs), "term")]), prior)
        top = logs.join(F.broadcast(self.common), "term", "left_semi")
        return _judged(samples, _log_sums([cells.join(F.broadcast(top), "term"), self.rare.join(logs, "term")]), prior)


def shares(resp: DataFrame) -> DataFrame:
    return stored(_wide(resp), "em-shares")


def as_responsibilities(post: DataFrame) -> DataFrame:
    return post.select("sample_id", F.explode(F.array(F.struct(F.lit(1).alias("c"), F.col("p_pos").alias("pr")), F.struct(F.lit(-1).alias("c"), F.col("p_neg").alias("pr")))).alias("x")).select("sample_id", "x.*")


def expectation_maximisation(tf: DataFrame, positives: DataFrame, mixed: DataFrame, stop: str = "converged", truth: DataFrame | None = None, max_rounds: int | None = None) -> DataFrame:
    """Posterior of ``mixed`` after EM; positives stay at 1 throughout.  ``tf``
    may hold other samples too, and is read in each round: give a stored one.

    ``max_rounds`` asks for so many rounds at most; without it there are as
    many as it takes.  ``converged`` stops when no prediction changes.  ``oracle`` stops on the
    true labels (sample_id, target), as the replicated procedure does: no
    positive missed, more missed than before, or no fewer both ways.  Each
    round's posterior is a stored table.
    """
    resp, rounds = initial(positives, mixed), Rounds(tf)
    accepted, before, marks = None, None, None
    for _ in itertools.count() if max_rounds is None else range(max_rounds):
        rounds.learn(shares(resp))
        post = stored(rounds.judge(mixed, class_prior(resp)), "em-posterior")
        if stop == "oracle":
            row = post.join(truth, "sample_id").agg(F.count_if((F.col("target") == 1) & (F.col("predicted") == -1)).alias("fp"), F.count_if((F.col("target") == -1) & (F.col("predicted") == -1)).alias("fn")).first()
            now = (row["fp"], row["fn"])
            if now[0] == 0 or (marks and (now[0] > marks[0] or (now[0] == marks[0] and now[1] <= marks[1]))):
                return accepted if accepted is not None else post
            marks = now
        if before is not None and post.join(before, ["sample_id", "predicted"], "left_anti").isEmpty():
            return post
        accepted = before = post
        resp = initial(positives, mixed.limit(0)).unionByName(as_responsibilities(post))
    return accepted

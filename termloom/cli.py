"""Command line: ``python -m termloom.cli --corpus_dir D --samples_name S COMMAND``.

Options that are not given come from the settings files (``termloom.config``).
Results go to ``--result_dir`` as Spark writes them: folders of text or CSV.
"""

from __future__ import annotations

import argparse
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.config import Settings
from termloom.operators import categories, classifiers, counts, keywords, selection, text, vocabulary, weighting
from termloom.plans import learning
from termloom.plans.corpus import Corpus
from termloom.sources import samples, sinks, spider

COMMANDS: dict = {}


def command(*options: str):
    """Registers a command with its own options."""

    def add(f):
        COMMANDS[f.__name__] = (f, options)
        return f

    return add


class Run:
    """What a command has at hand."""

    def __init__(self, spark: SparkSession, settings: Settings, section: str):
        self.spark, self._settings, self._section = spark, settings, section
        self.corpus = Corpus(spark, self["corpus_dir"]) if self.get("corpus_dir") else None

    def get(self, option: str, default: str | None = None) -> str | None:
        return self._settings.get(option, self._section) or self._settings.get(option, default=default)

    def __getitem__(self, option: str) -> str:
        value = self.get(option)
        if value is None:
            raise SystemExit(f"--{option} is needed")
        return value

    def out(self, name: str) -> str:
        return f"{self['result_dir'].rstrip('/')}/{name}"

    def sides(self) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
        """tf, dimensions, positives and unlabelled of two sample sets.  Ids of
        the unlabelled set become negative, so that the sets keep apart."""
        p, u = self["positive_name"], self["unlabeled_name"]
        other = lambda df: df.withColumn("sample_id", -1 - F.col("sample_id"))
        ids = lambda n: self.corpus.samples(n).select("sample_id")
        tf = self.corpus.terms(p).unionByName(other(self.corpus.terms(u)))
        dim = self.corpus.dimensions(p).unionByName(other(self.corpus.dimensions(u)))
        return tf, dim, ids(p), other(ids(u))


@command("xls_file")
def import_samples(run: Run) -> None:
    run.corpus.import_csv(run["xls_file"], run["samples_name"])


@command("method")
def rebuild(run: Run) -> None:
    run.corpus.rebuild(run["samples_name"], text.Method(run.get("method", "letters")))


@command()
def show(run: Run) -> None:
    name = run["samples_name"]
    counts.totals(run.corpus.samples(name), run.corpus.terms(name)).show()


@command("sample_id")
def query_sample(run: Run) -> None:
    name, at = run["samples_name"], int(run["sample_id"])
    samples.lookup(run.corpus.samples(name), at).show(truncate=False)
    samples.lookup(run.corpus.terms(name), at).filter("n > 1").orderBy(F.desc("n"), "term").show(1000, truncate=False)


@command("svm_file")
def export_samples(run: Run) -> None:
    rows = run.corpus.assigned(run["samples_name"])
    sinks.sample_sheet(rows).write.mode("overwrite").option("header", True).csv(run.out("samples"))
    if run.get("svm_file"):
        name = run["samples_name"]
        tf = run.corpus.terms(name)
        index = vocabulary.vocabulary(tf).withColumnRenamed("term_id", "idx")
        weights = weighting.tfidf(tf, run.corpus.dimensions(name)).join(index, "term")
        sinks.write_lines(sinks.svm_lines(weights, rows.select("sample_id", F.col("category_id").alias("label"))), run["svm_file"], "sample_id")


@command()
def export_content(run: Run) -> None:
    sinks.write_lines(sinks.content_pages(run.corpus.samples(run["samples_name"])), run.out("content"), "sample_id")


@command()
def export_urls(run: Run) -> None:
    sinks.url_report(run.corpus.samples(run["samples_name"])).orderBy("place", "url").drop("place").write.mode("overwrite").csv(run.out("urls"))


@command()
def query_categories(run: Run) -> None:
    tree = run.corpus.categories()
    usage = categories.usage(run.corpus.assigned(run["samples_name"]), tree)
    sinks.category_sheet(usage, tree).orderBy("ID").write.mode("overwrite").option("header", True).csv(run.out("categories"))


@command("mapping_file")
def rebuild_categories(run: Run) -> None:
    """Rewrites (cat1, cat2) by a CSV of cat1, cat2, new_cat1, new_cat2, then the tree."""
    if run.get("mapping_file"):
        name = run["samples_name"]
        mapping = run.spark.read.option("header", True).csv(run["mapping_file"]).fillna("")
        rows = run.corpus.samples(name)
        run.corpus.replace_samples(categories.remapped(rows, mapping).select(*rows.columns), name)
    run.corpus.rebuild_categories()


@command()
def query_keywords(run: Run) -> None:
    """Keywords of every level-2 category against the rest of its level 1."""
    name = run["samples_name"]
    tf, dim = run.corpus.terms(name), run.corpus.dimensions(name)
    ids = vocabulary.vocabulary(tf)
    rows = run.corpus.assigned(name).select("sample_id", "category_id")
    at, within = categories.roll_up(F.col("category_id"), 2), categories.roll_up(F.col("category_id"), 1)
    for top in sorted(r[0] for r in rows.select(within).distinct().collect()):  # level-1 categories
        own = rows.filter(within == top).select("sample_id", at.alias("category"))
        kept = lambda df, own=own: df.join(own, "sample_id", "left_semi")
        degrees = keywords.select_terms(keywords.degrees_by_category(kept(tf), kept(dim), own, "sum"), keywords.KEYWORD_QUERY)
        lines = sinks.keyword_lines(degrees.join(ids, "term"), "category")
        lines.orderBy("category", F.desc("degree"), F.desc("speciality"), F.desc("popularity"), "term_id").select("category", "line").write.mode("overwrite").partitionBy("category").text(run.out(f"keywords/level_1={top}"))


@command("positive_name", "unlabeled_name")
def iem(run: Run) -> None:
    tf, _, p, u = run.sides()
    learning.i_em(tf, p, u).show()


@command("positive_name", "unlabeled_name")
def sem(run: Run) -> None:
    for report in learning.s_em(*run.sides()):
        report.show()


@command("positive_name", "unlabeled_name")
def pulearning(run: Run) -> None:
    tf, dim, p, u = run.sides()
    degrees, scores = learning.keyword_ranking(tf, dim, p, u, combine="sum")
    ids = vocabulary.vocabulary(tf)
    sinks.write_lines(sinks.keyword_lines(degrees.join(ids, "term")), run.out("keywords"), F.desc("degree"), F.desc("speciality"), F.desc("popularity"), "term_id")
    ranked = sinks.sample_ranks(scores, tf.join(degrees.select("term", "degree"), "term"))
    ranked.orderBy(F.desc("score"), "sample_id").select("sample_id", "score", F.array_join("keywords", " ").alias("keywords")).write.mode("overwrite").csv(run.out("samples"))
    cells = tf.join(degrees, "term").join(ids, "term").select("sample_id", F.col("term_id").alias("idx"), F.col("degree").alias("weight"))
    for file, predict in (("train.svm", False), ("predict.svm", True)):
        chosen = learning.pu_targets(p, scores, predict)
        lines = sinks.svm_lines(cells, chosen.select("sample_id", "label"), include_null=True)
        sinks.write_lines(lines.join(chosen.select("sample_id", "place"), "sample_id"), run.out(file), "place", "sample_id")


@command("model_name", "test_name")
def train(run: Run) -> None:
    """Predicts the level-1 categories of ``test_name`` from the sample set."""
    name, test = run["samples_name"], run["test_name"]
    other = lambda df: df.withColumn("sample_id", -1 - F.col("sample_id"))
    tf = run.corpus.terms(name).unionByName(other(run.corpus.terms(test)))
    dim = run.corpus.dimensions(name).unionByName(other(run.corpus.dimensions(test)))
    own = run.corpus.assigned(name).select("sample_id", categories.roll_up(F.col("category_id"), 1).alias("category"))
    kept = lambda df: df.join(own, "sample_id", "left_semi")
    out = learning.multi_category(tf, kept(dim), own, other(run.corpus.samples(test).select("sample_id")))
    other(out).write.mode("overwrite").option("header", True).csv(run.out("categories"))


@command("positive_name", "unlabeled_name", "test_name", "hidden")
def learn(run: Run) -> None:
    """A biased SVM, its vocabulary weights, ranked predictions and the model."""
    tf, dim, p, u = run.sides()
    far = 1 << 40
    test = run["test_name"]
    moved = lambda df: df.withColumn("sample_id", F.col("sample_id") + far)
    titles = run.corpus.samples(run["positive_name"]).select("sample_id", "title").unionByName(moved(run.corpus.samples(test).select("sample_id", "title")))
    learned = learning.biased_learning(tf.unionByName(moved(run.corpus.terms(test))), p, u, moved(run.corpus.samples(test).select("sample_id")), int(run.get("hidden", "20")))
    classifiers.save_model(learned.model, run.out("model"))
    learned.index.write.mode("overwrite").parquet(run.out("model_terms"))
    sinks.write_lines(sinks.weight_lines(learning.vocabulary_weights(learned)), run.out("vocabulary_weights"), F.desc("weight"), "idx")
    scores = learned.scores.join(titles, "sample_id", "left").withColumn("label", F.when(F.col("hidden"), 1).otherwise(-1))
    sinks.write_lines(sinks.prediction_lines(scores), run.out("predictions"), F.desc("score"), "sample_id")


@command("model_dir")
def predict(run: Run) -> None:
    """Scores a sample set with a saved model."""
    name = run["samples_name"]
    index = run.spark.read.parquet(f"{run['model_dir']}/model_terms")
    tf = selection.keep_terms(run.corpus.terms(name), index)
    rows = run.corpus.samples(name).select("sample_id", "title")
    weights = weighting.tfidf_frobenius(tf, counts.sample_dim(rows, tf))
    scores = classifiers.svm_scores(classifiers.load_model(f"{run['model_dir']}/model"), classifiers.vectors(weights, index, rows.select("sample_id")))
    sinks.write_lines(sinks.prediction_lines(scores.join(rows, "sample_id").withColumnRenamed("predicted", "label")), run.out("predictions"), F.desc("score"), "sample_id")


def fetch(url: str, seconds: float = 20) -> tuple[int, str]:
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(url, timeout=seconds) as r:
            return r.status, r.read().decode(r.headers.get_content_charset() or "utf-8", "replace")
    except urllib.error.HTTPError as e:
        return e.code, ""


@command()
def refresh(run: Run) -> None:
    name = run["samples_name"]
    run.corpus.replace_samples(samples.refreshed(run.corpus.samples(name), fetch), name)


@command("main_categories")
def purge(run: Run) -> None:
    """Keeps samples with content in the main categories (comma-separated)."""
    name = run["samples_name"]
    run.corpus.replace_samples(selection.purged(run.corpus.samples(name), run["main_categories"].split(",")), name)


@command("json_dir", "begin", "end", "fields")
def spider_search(run: Run) -> None:
    found = spider.in_range(spider.read_json(run.spark, run["json_dir"]), run["begin"], run["end"])
    fields = run.get("fields")
    spider.flattened(found, fields.split(",") if fields else None).write.mode("overwrite").option("header", False).csv(run.out("documents"))


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(description="Positive and unlabelled text mining on Spark.")
    for option in ("corpus_dir", "samples_name", "result_dir"):
        out.add_argument(f"--{option}")
    subs = out.add_subparsers(dest="command", required=True)
    for name, (f, options) in COMMANDS.items():
        sub = subs.add_parser(name, help=(f.__doc__ or name).split("\n")[0])
        for option in options:
            sub.add_argument(f"--{option}")
    return out


def main(argv: list[str] | None = None, spark: SparkSession | None = None, settings: Settings | None = None) -> None:
    args = vars(parser().parse_args(argv))
    name = args.pop("command")
    settings = settings or Settings()
    for option, value in args.items():
        settings.update(option, value, "global" if option in ("corpus_dir", "samples_name", "result_dir") else name)
    began = time.time()
    COMMANDS[name][0](Run(spark or SparkSession.builder.appName("termloom").getOrCreate(), settings, name))
    print(f"{name}: {time.time() - began:.1f} s")


if __name__ == "__main__":
    main()

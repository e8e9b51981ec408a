"""A corpus folder: sample sets, their term counts and one category tree.

``samples`` and ``terms`` are Parquet tables partitioned by ``samples_name``,
``categories`` is one table over all sets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.operators import categories, counts, text
from termloom.plans.storage import stored
from termloom.sources import samples


class Corpus:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _has(self, name: str) -> bool:
        jvm = self.spark._jvm
        target = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(target)

    def _replace(self, df: DataFrame, name: str, samples_name: str | None = None) -> None:
        """Writes a table anew, or one sample set of it; the rows are stored
        elsewhere first, since they may come from the table itself."""
        rows = stored(df, "replacement")
        if samples_name is None:
            rows.write.mode("overwrite").parquet(f"{self.path}/{name}")
        else:
            rows.drop("samples_name").write.mode("overwrite").parquet(f"{self.path}/{name}/samples_name={samples_name}")

    def import_csv(self, file: str, samples_name: str) -> None:
        """Appends a sheet; ids go on after the set's greatest."""
        first = samples.next_id(self.samples(samples_name)) if self._has("samples") else 0
        samples.save(samples.import_csv(self.spark, file, samples_name, first), f"{self.path}/samples")

    def samples(self, samples_name: str | None = None) -> DataFrame:
        return samples.load(self.spark, f"{self.path}/samples", samples_name)

    def replace_samples(self, rows: DataFrame, samples_name: str) -> None:
        self._replace(rows, "samples", samples_name)

    def rebuild_categories(self) -> None:
        """One tree over all sets, so ids never mean two things."""
        self._replace(categories.tree(self.samples()), "categories")

    def categories(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/categories")

    def assigned(self, samples_name: str) -> DataFrame:
        return categories.assigned(self.samples(samples_name), self.categories())

    def rebuild(self, samples_name: str, method: text.Method = text.Method.LETTERS) -> None:
        """Term counts of a set and the category tree."""
        rows = self.samples(samples_name).select("sample_id", text.assembled(F.col("title"), F.col("content")).alias("content"))
        self._replace(text.term_counts(rows, method), "terms", samples_name)
        self.rebuild_categories()

    def terms(self, samples_name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/terms").filter(F.col("samples_name") == samples_name).drop("samples_name")

    def dimensions(self, samples_name: str) -> DataFrame:
        return counts.sample_dim(self.samples(samples_name), self.terms(samples_name))

import pytest
from pyspark.sql import functions as F

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_keep_columns_and_decide(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    from termloom.llm.common import materialize

    ids = {r["doc_id"] for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        docs = materialize(stage(spark, docs, d), name)
        assert docs.columns == before
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= ids and (len(now) < len(ids) or name in ("decontamination", "pii"))
        ids = now
    assert docs.filter("text rlike '@[a-z0-9]+[.]example'").count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, d)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == ids


def test_stages_take_an_empty_table(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, d).collect() == []


def test_a_short_item_alone_removes_nothing(spark, tmp_path):
    item = "one two three four five six seven eight"
    texts = ["yes it is", "the answer is yes", f"see {item} here", "one two three four five six seven", None]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    bench = [(1, "yes"), (2, "the answer"), (3, item), (4, "")]
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert sorted(r["doc_id"] for r in corpus_pipeline.decontaminate_stage(spark, docs, str(tmp_path)).collect()) == [0, 3, 4]


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_a_stage_takes_awkward_rows(spark, nasty, tmp_path, name):
    """Nulls, no text, a very long text, a repeated row, a null doc_id and
    columns with the operators' own names: one defined result each."""
    d = "/root/testdata/sf0.001"
    stage = dict(corpus_pipeline.STAGES)[name]
    before = nasty.collect()
    got = stage(spark, nasty, d).collect()
    ids = [r["doc_id"] for r in before]
    if name == "packing":
        assert {r["doc_id"] for r in got} == set(ids) and all(r["length"] <= 1024 for r in got)
        assert sum(r["start"] == 0 for r in got) == len(before)  # repeated rows are packed each
        return
    assert set(got[0].asDict()) == set(corpus_pipeline.COLUMNS) if got else True
    now = [r["doc_id"] for r in got]
    assert set(now) <= set(ids)
    if name in ("decontamination", "pii"):
        assert sorted(map(str, now)) == sorted(map(str, ids))
        assert {str(r["doc_id"]) + str(r["text"]) for r in got} == {str(r["doc_id"]) + str(r["text"]) for r in before}
    if name == "near_duplicates":
        gone = set(ids) - set(now)
        assert gone == {17, 18, 19} and now.count(None) == 1 and now.count(1) == 2  # a repeated row is one document, and stays as it is
    if name == "quality":
        assert all(sum(x == i for x in now) in (0, ids.count(i)) for i in set(ids))


def test_stages_are_the_same_on_rows_in_another_order(spark):
    d = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[1:4]:
        one, two = (sorted((r["doc_id"], r["text"] or "") for r in stage(spark, x, d).select("doc_id", "text").collect()) for x in (docs, docs.orderBy(F.desc("doc_id")).repartition(3)))
        assert one == two, name

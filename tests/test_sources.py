import datetime

from pyspark.sql import functions as F

from termloom.functions import scalars
from termloom.operators import vocabulary
from termloom.sources import samples, sinks, spider
from termloom.streaming import scoring


def test_import(spark, tmp_path):
    (tmp_path / "a.csv").write_text('CONTENT,TITLE,DATE,CAT1,CAT2\n"x\ny",t1,2014.3.9, a ,\n,t2,0,b,c\nz,t3,,,\n')
    got = samples.import_csv(spark, str(tmp_path / "a.csv"), "set", 100)
    rows = {r["title"]: r for r in got.collect()}
    assert sorted(r["sample_id"] for r in rows.values()) == [100, 101, 102]
    assert rows["t1"]["date"] == datetime.datetime(2014, 3, 9) and rows["t1"]["cat1"] == "a" and rows["t1"]["content"] == "x\ny"
    assert rows["t2"]["content"] is None and rows["t2"]["date"] == datetime.datetime(1904, 1, 1)
    assert rows["t3"]["url"] == "" and rows["t3"]["cat1"] == ""
    assert samples.next_id(got) == 103
    samples.save(got, str(tmp_path / "s"))
    back = samples.load(spark, str(tmp_path / "s"), "set")
    assert back.count() == 3 and [r[0] for r in samples.sample_sets(back).collect()] == ["set"]
    assert samples.lookup(back, 101).count() == 1


def test_refresh(spark):
    df = spark.createDataFrame([(1, "ok", None), (2, "bad", None), (3, "boom", ""), (4, "keep", "x"), (5, "", None)], "sample_id long, url string, content string")

    def fetch(url):
        if url == "boom":
            raise OSError
        return (200, "body") if url == "ok" else (404, "no")

    got = {r["sample_id"]: r["content"] for r in samples.refreshed(df, fetch).collect()}
    assert got == {1: "body", 2: "", 3: None, 4: "x", 5: None}


def test_text_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "x.txt").write_text("a\nb")
    assert [r["content"] for r in samples.text_files(spark, str(tmp_path)).collect()] == ["a\nb"]


def test_spider_range_is_closed(spark):
    base = 1388534400  # 2014-01-01
    data = [("a", (base, "t", "x", "n", ("k",))), ("b", (base + 86399, None, "x", "n", (None,))), ("c", (base + 86400, "t", "x", "n", ("k",))), ("d", (base, "t", "", "n", ("k",)))]
    docs = spark.createDataFrame(data, spider.DOCUMENT)
    got = spider.flattened(spider.in_range(docs, "2014-01-01", "2014-01-01"), ["url", "title", "publish_time"])
    assert {tuple(r) for r in got.collect()} == {("a", "2014-01-01 00:00:00", "t"), ("b", "2014-01-01 23:59:59", "")}


def test_lines(spark, tmp_path):
    w = spark.createDataFrame([(1, 3, 0.5), (1, 0, 1.0), (2, 1, 2.0)], "sample_id long, idx long, weight double")
    labels = spark.createDataFrame([(1, 1), (2, -1), (3, 1)], "sample_id long, label int")
    assert {r["line"] for r in sinks.svm_lines(w, labels).collect()} == {"1 0:1.000000 3:0.500000", "-1 1:2.000000"}
    assert "1" in {r["line"] for r in sinks.svm_lines(w, labels, include_null=True).collect()}
    sinks.write_lines(sinks.svm_lines(w, labels), str(tmp_path / "o"), "sample_id")
    assert [r["value"] for r in spark.read.text(str(tmp_path / "o")).collect()][0].startswith("1 ")


def test_sheet_cell_limit(spark):
    df = spark.createDataFrame([(1, None, "a", "b", "t", "k", "u", "x" * 40000)], "category_id long, date timestamp, cat1 string, cat2 string, title string, key string, url string, content string")
    assert len(sinks.sample_sheet(df).first()["CONTENT"]) == 32767


def test_scalars(spark):
    df = spark.createDataFrame([("a, b;c;", bytearray("中文".encode("gbk")), 7, 4)], "s string, g binary, a long, b long")
    r = df.select(scalars.split_any(F.col("s"), ",;").alias("s"), scalars.gbk("g").alias("g"), scalars.hamming_within(F.col("a"), F.col("b"), 2).alias("h")).first()
    assert (r["s"], r["g"], r["h"]) == (["a", "b", "c"], "中文", True)


def test_vocabulary_merge(spark):
    a = spark.createDataFrame([("x", 0), ("y", 1)], "term string, term_id long")
    b = spark.createDataFrame([("y", 0), ("z", 1), ("w", 2)], "term string, term_id long")
    assert {tuple(r) for r in vocabulary.merge(a, b).collect()} == {("x", 0), ("y", 1), ("w", 2), ("z", 3)}
    assert {tuple(r) for r in vocabulary.diff(b, a).collect()} == {("y", 0, 1)}


def test_stream_scores(spark, tmp_path):
    batch = spark.createDataFrame([(1, datetime.datetime(2024, 1, 1), "good good bad"), (2, datetime.datetime(2024, 1, 1), "")], "sample_id long, ts timestamp, content string")
    batch.write.parquet(str(tmp_path / "in"))
    weights = spark.createDataFrame([("good", 1.0), ("bad", -3.0)], "term string, weight double")
    seen = []
    q = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in")).writeStream.foreachBatch(lambda df, _: seen.extend(scoring.scored(df, weights, 0.5).collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {r["sample_id"]: r["score"] for r in seen} == {1: -0.5, 2: 0.5}


def test_late_events_are_dropped_by_windows(spark, tmp_path):
    rows = [(datetime.datetime(2024, 1, 1, h), "a", 1.0) for h in (1, 1, 2, 9)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    q = scoring.windowed_counts(stream).writeStream.outputMode("append").format("memory").queryName("windows").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["start"].hour, r["n"]) for r in spark.table("windows").collect()} == {(1, 2), (2, 1)}

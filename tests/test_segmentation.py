import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from termloom.functions.segmentation import Dictionary, HiddenMarkov, Segmenter, keywords, segment_column, tagged_line

WORDS = ["我 500 r", "来到 100 v", "北京 200 ns", "清华 80 nz", "清华大学 60 nt", "大学 150 n", "华大 5 j", "学 90 n", "大 95 a"]
HMM = ["# start", "-0.3 -3.14e100 -3.14e100 -1.5", "-3.14e100 -0.5 -0.9 -3.14e100", "-0.6 -3.14e100 -3.14e100 -0.8", "-3.14e100 -0.3 -1.3 -3.14e100", "-0.7 -3.14e100 -3.14e100 -0.7", "小:-1.0,杭:-1.0", "明:-1.0,研:-1.0", "x:-1.0", "了:-1.0,他:-1.0"]


@pytest.fixture(scope="module")
def seg():
    return Segmenter(Dictionary.parse(WORDS, ["云计算 n", "无标签"]), HiddenMarkov.parse([x for x in HMM]))


def test_mp_prefers_the_likely_long_word(seg):
    assert seg.cut("我来到北京清华大学", "mp") == ["我", "来到", "北京", "清华大学"]


def test_full_has_every_word_and_lone_characters(seg):
    assert seg.cut("我来到清华大学", "full") == ["我", "来到", "清华", "清华大学", "华大", "大学"]


def test_query_cuts_long_words_again():
    seg = Segmenter(Dictionary.parse(WORDS), HiddenMarkov.parse(HMM), longest=3)
    assert seg.cut("清华大学", "query") == ["清华", "清华大学", "华大", "大学"]


def test_hmm_joins_unknown_characters(seg):
    assert seg.cut("小明了", "hmm") == ["小明", "了"]
    assert seg.cut("小明abc12 3.5x", "hmm") == ["小明", "abc12", " ", "3.5", "x"]


def test_mix_leaves_user_words(seg):
    assert seg.cut("我云计算小明", "mix") == ["我", "云计算", "小明"] or seg.cut("我云计算小明", "mix")[1] == "云计算"


def test_levels(seg):
    assert seg.levels("清华大学") == [("清华大学", 0), ("清华", 1), ("大学", 1)]


def test_small_words_only(seg):
    assert seg.small("清华大学", 2) == ["清华", "大学"]


def test_tags(seg):
    assert [seg.tag(w) for w in ("北京", "12", "ab", "a", "！", "云计算", "无标签")] == ["ns", "m", "eng", "x", "x", "n", "x"]


def test_unknown_mode(seg):
    with pytest.raises(ValueError):
        seg.cut("我", "nope")


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="我来到北京清华大学小明 \n，。ab1.😀", max_size=30))
def test_cuts_join_back(text):
    seg = Segmenter(Dictionary.parse(WORDS), HiddenMarkov.parse(HMM))
    for mode in ("mp", "hmm", "mix"):
        assert "".join(seg.cut(text, mode)) == text


def test_column(spark, seg):
    cut = segment_column(spark, seg)
    df = spark.createDataFrame([("我来到北京",), (None,), ("",)], "t string").select(tagged_line(cut("t")).alias("l"))
    assert [r["l"] for r in df.collect()] == ["我:r 来到:v 北京:ns", "", ""]


def test_keywords(spark):
    terms = spark.createDataFrame([(1, "清华", 2), (1, "大学", 1), (1, "学", 9), (1, "的话", 9)], "sample_id long, term string, n long")
    idf = spark.createDataFrame([("清华", 2.0), ("别的", 4.0)], "term string, idf double")
    stop = spark.createDataFrame([("的话",)], "term string")
    got = [(r["term"], r["score"]) for r in keywords(terms, idf, stop, 5).orderBy("rank").collect()]
    assert got == [("清华", 4.0), ("大学", 3.0)]
    assert terms.select(F.lit(1)).count() == 4

"""Queries against their DuckDB twins at sf0.001."""

import math

import duckdb
import pytest

from termloom.plans import catalog

D = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = "tf_counts doc_lengths char_ngrams4 vocab_diff vocab_merge category_usage category_names url_report spider_range positional_subset cv_split by_category_2 clone_subset merge_samples append_samples tfidf_cpp tfrf svm_lines pd_by_category sample_positive_degree keyword_extract term_category_matrix nb_posterior prf_report em_converged s_em_second_step i_em_report sample_keyword_table ordered_positions recall_at_k spy_threshold_split sem_report event_windows".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(norm, v)) if isinstance(v, list | tuple) else v


def test_every_twin_has_a_query():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, name):
    df = catalog.queries()[name](spark, D)
    want = duck.sql(catalog.oracle_sql()[name])
    columns = sorted(df.columns)
    assert columns == sorted(want.columns)
    place = [want.columns.index(c) for c in columns]
    key = lambda r: tuple(map(str, r))
    a = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=key)
    b = sorted((tuple(norm(r[i]) for i in place) for r in want.fetchall()), key=key)
    assert a == b

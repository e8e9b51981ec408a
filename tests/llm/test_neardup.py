import itertools
import re

import pytest

from tests.llm.conftest import SCHEMA, prose, rows
from termloom.llm.graph import components
from termloom.llm.neardup import near_duplicates
from termloom.llm.sieve import sieve


def brute(data, n, percent):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for i, t in data:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(low))
        sets[i] = {tuple(w)} if 0 < len(w) < n else {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [4, 5])
def test_against_all_pairs(spark, n):
    texts = []
    for k in range(40):
        words = prose(k, 60 + k).split()
        texts.append(" ".join(words))
        for m in range(k % 6):
            other = list(words)
            for at in range(m):
                other[(at * 17 + m) % len(other)] = f"edit{k}x{m}x{at}"
            texts.append(" ".join(other).upper() if m == 2 else " ".join(other))
    texts += [None, "", "one", "One", "a b c", "A b  c"]
    data = list(enumerate(texts))
    got = {r["doc_id"]: r for r in near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), words=n).collect()}
    want = brute(data, n, 80)
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (r["component_id"] == i) for i, r in got.items())


def test_a_large_group_of_near_copies_is_one_component(spark):
    words = prose(5, 120).split()
    texts = []
    for k in range(600):
        own = list(words)
        own[k % 100] = f"a{k}"
        texts.append(" ".join(own))
    got = near_duplicates(spark.createDataFrame(rows(texts), SCHEMA), words=5).collect()
    assert {r["component_id"] for r in got} == {0}


def test_copies_that_are_alike_to_their_original_only(spark):
    words = prose(8, 120).split()
    texts = [" ".join(words)]
    for k in range(400):
        own = list(words)
        own[k % 55], own[60 + k // 7 % 55] = f"a{k}", f"b{k}"
        texts.append(" ".join(own))
    data = list(enumerate(texts))
    assert brute([data[1], data[30]], 5, 80) == {1: (116, 1), 30: (116, 30)}
    ids = [k + 1000 for k, _ in data[::-1]]
    got = near_duplicates(spark.createDataFrame(rows(texts, ids), SCHEMA), words=5).collect()
    assert {r["component_id"] for r in got} == {1000}


def test_partners_on_a_shared_template(spark):
    template = [f"t{k}" for k in range(344)]
    texts = []
    for k in range(300):
        own = [f"o{k}x{i}" for i in range(56)]
        texts += [" ".join(template + own), " ".join(template + own[:24] + [f"p{k}x{i}" for i in range(32)])]
    data = list(enumerate(texts[::2] + texts[1::2]))
    want = brute(data, 5, 80)
    assert len({root for _, root in want.values()}) == 300
    got = near_duplicates(spark.createDataFrame(rows([t for _, t in data]), SCHEMA), words=5).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == want


def test_edge_cases(nasty, empty):
    got = near_duplicates(nasty, words=5).collect()
    assert len(got) == nasty.count()
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    assert by[17]["component_id"] == by[18]["component_id"] == by[19]["component_id"] == 0
    for i in (12, 13, 14):
        assert by[i]["n_shingles"] == 0 and by[i]["kept"]
    none = [r for r in got if r["doc_id"] is None]
    assert [(r["component_id"], r["kept"]) for r in none] == [(None, True)]
    assert near_duplicates(empty).collect() == []


def test_long_chain_of_links(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(300)] + [(1000, 1001), (5000, 5000)], "u long, v long")
    got = {r["node"]: r["root"] for r in components(links).collect()}
    assert got == {**{k: 0 for k in range(1, 301)}, 1001: 1000}


def test_sieve_never_loses(spark):
    ids = spark.range(0, 5000, 7).selectExpr("id - 1000 as id")
    kept = sieve(spark.range(-2000, 6000).withColumnRenamed("id", "k"), "k", ids, most_bits=1 << 13)
    assert kept.join(ids, kept["k"] == ids["id"]).count() == ids.count()

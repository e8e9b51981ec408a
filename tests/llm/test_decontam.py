import hashlib
import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tests.llm.conftest import SCHEMA, prose, rows
from termloom.llm import decontam
from termloom.llm.decontam import Index

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOW))


def brute(text, items, width=8):
    w, hit, found = words(text), set(), set()
    for name, t in items:
        x = words(t)
        n = min(width, len(x))
        for k in range(len(x) - n + 1 if n else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == x[k : k + n]:
                    hit.update(range(i, i + n))
                    found.add(name)
    return len(w), len(hit), sorted(found)


@settings(max_examples=80, deadline=None)
@given(st.integers(0, 2**32))
def test_search_against_brute_force(seed):
    rng = random.Random(seed)
    abc = ["a", "b", "c"][: rng.randint(1, 3)]
    draw = lambda n: rng.choice([" ", ", ", "--"]).join(rng.choice(abc + ["Zé"]) for _ in range(rng.randint(0, n)))
    items = [(str(i), draw(14)) for i in range(rng.randint(1, 6))]
    texts = [draw(60) for _ in range(4)]
    index = Index(items)
    counts, hits, found, full = index.scan([decontam.fold(t) for t in texts])
    for k, t in enumerate(texts):
        assert (counts[k], (hits[0] == k).sum(), sorted(index.names[i] for i in found[1][found[0] == k])) == brute(t, items)
        assert full[k] == bool(brute(t, [x for x in items if len(words(x[1])) >= 8])[2])


def test_lanes_join(spark):
    text = prose(1, 3000)
    item = " ".join(words(text)[250:262])
    index = Index([("7", item)])
    _, hits, items, _ = index.scan([decontam.fold(text)])
    assert hits[1].tolist() == list(range(250, 262)) and [index.names[i] for i in items[1]] == ["7"]


def test_edge_cases_and_blocks(spark, nasty, empty):
    texts = [r["text"] for r in nasty.collect()]
    items = [(1, " ".join(words(texts[2])[3:20])), (2, "two words"), (3, None), (4, ""), (5, " ".join(words(texts[2])[10:30])), (None, "word"), (1, texts[4])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("" if i is None else str(i), t) for i, t in items]
    want = [brute(t, named) for t in texts]
    for size in (16 << 20, 1):
        got = decontam.contamination(nasty, bench, block_bytes=size).collect()
        key = lambda x: str(x)
        assert sorted(((r["n_words"], r["n_hit"], r["items"]) for r in got), key=key) == sorted(want, key=key)
        assert all(r["contaminated"] == (len(r["items"]) >= 2) for r in got)
        assert got[0]["size"] == 7 and got[0]["shard"] == "x"
    assert decontam.contamination(empty, bench).collect() == []
    assert not any(r["contaminated"] or r["n_hit"] for r in decontam.contamination(nasty, bench.limit(0)).collect())


def test_a_large_benchmark_in_blocks(spark):
    items = [(k, prose(k, 40)) for k in range(50)]
    texts = [prose(1000 + k, 40) + " " + " ".join(words(items[k * 3][1])[5:20]) + " " + prose(2000 + k, 200 * (k % 3)) for k in range(12)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(2)
    folder, n = decontam.write_index(bench, block_bytes=1000)
    assert n > 10
    want = {i: brute(t, [(str(k), x) for k, x in items]) for i, t in enumerate(texts)}
    for size in (1000, 4 << 20):
        got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["items"]) for r in decontam.contamination(docs, bench, block_bytes=size).collect()}
        assert got == want


def test_digest(spark):
    docs = spark.createDataFrame(rows(["a b c", "nothing", None]), SCHEMA)
    bench = spark.createDataFrame([(10, "b c"), (9, "a")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination_digest(docs, bench).collect()}
    assert got[0]["items_sha256"] == hashlib.sha256(b"10,9").hexdigest() and got[0]["contaminated"] and got[0]["n_hit"] == 3
    assert got[2]["items_sha256"] == hashlib.sha256(b"").hexdigest() and got[2]["n_words"] == 0

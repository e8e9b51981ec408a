"""Token files, packing and sharding: round trips and laws."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from termloom.llm import bitpack, packing, sharding
from termloom.llm.common import materialize
from termloom.llm.tokens import vocabulary_path


@pytest.fixture(scope="module")
def encode():
    t = Tokenizer.from_file(vocabulary_path())
    return lambda x: t.encode(x or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


def test_files_round_trip(nasty, empty, encode):
    got = bitpack.token_file_digest(nasty).collect()
    want = Counter((r["doc_id"], crc([*encode(r["text"]), 2])) for r in nasty.collect())
    assert Counter((r["doc_id"], r["ids_crc32"]) for r in got) == want
    at = 0
    for r in sorted(got, key=lambda r: r["start"]):
        assert r["start"] == at
        at += r["n_tokens"]
    order = [r["doc_id"] for r in sorted(got, key=lambda r: r["start"])]
    assert order == sorted(order, key=lambda x: (x is not None, x or 0))
    assert bitpack.token_file_digest(empty).collect() == []


def test_files_of_a_few_ids(spark, nasty):
    folder = bitpack.write_token_files(nasty, file_ids=50)
    files = bitpack.manifest(spark, folder).orderBy("part", "seq").collect()
    assert len(files) > 3 and sum(r["n_docs"] for r in files) == nasty.count()
    assert [r["start"] for r in files] == [sum(x["n_ids"] for x in files[:k]) for k in range(len(files))]
    got = bitpack.read_token_files(spark, folder, docs_step=1).collect()
    assert len(got) == nasty.count()
    assert sorted(r["start"] for r in got)[-1] == sum(r["n_ids"] for r in files) - max(got, key=lambda r: r["start"])["n_tokens"]


def test_added_tokens_are_the_librarys(spark, encode):
    texts = ["a <|endoftext|> b", "<|endoftext|>", "plain"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"]: r["ids_crc32"] for r in bitpack.token_file_digest(docs).collect()} == {i: crc([*encode(t), 2]) for i, t in enumerate(texts)}
    assert {r["doc_id"]: r["ids_crc32"] for r in packing.pack_documents(docs).collect()} == {i: crc([*encode(t), 0]) for i, t in enumerate(texts)}


@pytest.mark.parametrize("capacity", [1024, 64, 50])
def test_packing_is_whole(nasty, empty, encode, capacity):
    got = packing.pack_documents(nasty, capacity=capacity).collect()
    sequences, docs = defaultdict(list), defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append(r)
        docs[r["doc_id"]].append(r)
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for r in sorted(s, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= capacity
    want = Counter()
    for r in nasty.collect():
        ids = [*encode(r["text"]), 0]
        want.update((r["doc_id"], k, min(capacity, len(ids) - k), crc(ids[k : k + capacity]), len(ids)) for k in range(0, len(ids), capacity))
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]) for r in got) == want
    assert packing.pack_documents(empty).collect() == []


def test_patterns_are_near_the_bound():
    rng = np.random.RandomState(1)
    histogram = dict(Counter(rng.randint(1, 129, 20_000).tolist()))
    patterns = packing.solve_patterns(histogram, 128)
    used = Counter()
    for p, times in patterns:
        assert sum(k * v for k, v in p.items()) <= 128 and times > 0
        for k, v in p.items():
            used[k] += v * times
    assert used == Counter(histogram)
    bins = sum(t for _, t in patterns)
    assert bins <= 1.02 * sum(k * v for k, v in histogram.items()) / 128
    assert packing.solve_patterns({}, 128) == []


def test_one_length_many_times():
    assert sum(t for _, t in packing.solve_patterns({100: 1000}, 128)) == 1000
    assert sum(t for _, t in packing.solve_patterns({64: 1000, 128: 3}, 128)) == 503


@pytest.mark.parametrize("part_bytes", [128 << 20, 2000])
def test_shards(spark, nasty, empty, part_bytes):
    got = sharding.shard_documents(nasty, n_shards=4, part_bytes=part_bytes).collect()
    assert len(got) == nasty.count()
    size = lambda t: len((t or "").encode()) + 16
    slots, weights = defaultdict(list), Counter()
    for r in got:
        assert r["size"] == size(r["text"]) and 0 <= r["shard"] < 4
        slots[r["shard"]].append(r["slot"])
        weights[r["shard"]] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sharding.shard_documents(empty).collect() == []


@pytest.mark.parametrize("parts", [128 << 20, 3000])
def test_shards_against_a_plain_sort(spark, parts):
    texts = [f"text {k % 231} " + "x" * (k * 7 % 90) for k in range(2000)] + ["copy " * 9] * 1000 + ["long " * 500, None, ""]
    docs = spark.createDataFrame([(None if k == 5 else k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keyed = docs.withColumn("h", F.xxhash64(F.coalesce("text", F.lit("")))).collect()
    size = lambda t: len((t or "").encode()) + 16
    order = sorted(((r["h"], -(1 << 63) if r["doc_id"] is None else r["doc_id"], size(r["text"]), r["doc_id"]) for r in keyed), key=lambda r: r[:2])
    total, n = sum(r[2] for r in order), 8
    got = {r["doc_id"]: (r["shard"], r["slot"]) for r in sharding.shard_documents(docs, n, part_bytes=parts).collect()}
    places, below, at = [got[r[3]] for r in order], 0, Counter()
    assert [p[0] for p in places] == sorted(p[0] for p in places)
    for (shard, slot), row in zip(places, order, strict=True):
        if slot == 0 and shard:  # a splitter: within the tolerance or the row beside it
            assert abs(below - total * shard / n) <= 0.001 * total / n + 2600
        assert slot == at[shard]
        at[shard] += 1
        below += row[2]


def test_shards_are_even_and_keep_copies_near(spark):
    texts = [f"text number {k % 997} " + "x" * (k % 50) for k in range(6000)] + ["copy " * 20] * 3000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = materialize(sharding.shard_digest(docs, 40), "shards").collect()
    weights = Counter()
    for r in got:
        weights[r["shard"]] += r["size"]
    mean = sum(weights.values()) / 40
    assert len(weights) == 40 and max(abs(w - mean) for w in weights.values()) < 0.02 * mean
    copies = {r["shard"] for r in got if r["doc_id"] >= 6000}
    assert copies == set(range(min(copies), max(copies) + 1))
    assert all(r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode()) for r in got)

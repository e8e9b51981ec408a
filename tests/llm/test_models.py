"""Learned operators: gradients, held-out accuracy and edge cases."""

import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, rows
from termloom.llm import langid, pii, quality, quotes, topk

D = "/root/testdata/sf0.001"


def test_gradients():
    net = langid.Network(["a", "b", "c"], hidden=5)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = np.frombuffer(b"hellodas", dtype=np.uint8).reshape(2, 4), np.array([0, 2])
    _, grads = net.gradients(x, y)
    for name, p in net.p.items():
        at = np.unravel_index(np.abs(grads[name]).argmax(), p.shape)
        old, h = p[at], 1e-3
        p[at] = old + h
        up = net.gradients(x, y)[0]
        p[at] = old - h
        down = net.gradients(x, y)[0]
        p[at] = old
        assert grads[name][at] == pytest.approx((up - down) / (2 * h), rel=2e-3, abs=1e-6)


def test_pooling_a_document_is_pooling_its_segments():
    net = langid.Network(["a", "b"])
    text = "the the naïve " + "z" * 60 + "\nthe x"
    got, has = net.documents([text, "", None, "123 ..", text])
    segments = langid._segments(text)
    want = net.pooled(segments).sum(axis=0) / sum(map(len, segments))
    assert got[0] == pytest.approx(want, rel=1e-4) and (got[0] == got[4]).all()
    assert has.tolist() == [True, False, False, False, True]


def plain_gru(p, word, d):
    """States of one direction over one segment, byte after byte."""
    H = p["u" + d].shape[0]
    h, out = np.zeros(H), []
    for byte in word if d == "f" else word[::-1]:
        a, g = p["x" + d][byte] + p["c" + d], h @ p["u" + d]
        z, r = (1 / (1 + np.exp(-(a[k : k + H] + g[k : k + H]))) for k in (0, H))
        h = (1 - z) * np.tanh(a[2 * H :] + r * g[2 * H :]) + z * h
        out.append(h)
    return out if d == "f" else out[::-1]


def test_documents_against_a_plain_loop():
    net = langid.Network(["a", "b", "c"], hidden=4)
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    texts = ["The naïve\tfox  the fox", "é" * 40 + " x", " lone "]
    got, _ = net.documents(texts)
    for text, row in zip(texts, got, strict=True):
        each = []
        for word in text.encode().split():
            for k in range(0, len(word), langid.LONGEST):
                own = word[k : k + langid.LONGEST]
                for f, b in zip(plain_gru(p, own, "f"), plain_gru(p, own, "b"), strict=True):
                    e = np.exp(np.concatenate([f, b]) @ p["o"] + p["b"])
                    each.append(e / e.sum())
        assert row == pytest.approx(np.mean(each, axis=0), rel=1e-4)


def test_language_of_a_very_long_text_and_of_repeats(spark):
    words = {"en": "the house of the old man was there".split(), "es": "la casa del hombre viejo estaba cerca".split()}
    data = [(k, lang, " ".join(w[(k * 7 + j) % len(w)] for j in range(30))) for k, (lang, w) in enumerate([*words.items()] * 60)]
    long = [(900, None, " ".join(words["es"] * 40_000)), (901, None, "x" * 2_000_000), (902, None, data[1][2]), (902, None, data[1][2])]
    docs = spark.createDataFrame(data + long, "doc_id long, lang string, text string")
    got = langid.identify(docs).filter("doc_id >= 900").collect()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == 4 and by[900] == "es" and by[902] == "es" and by[901] in words
    drawn = dict(langid.sample(docs, 2, 5))
    assert {k: len(v) for k, v in drawn.items()} == {"en": 5, "es": 5}
    assert langid._drawn("a b c d e f g h", 4) == [b"a", b"c", b"e", b"g"] and langid._drawn(" ", 4) == []


def test_language_on_held_out_documents(spark):
    docs = spark.read.parquet(f"{D}/documents.parquet")
    out = langid.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in out)
    assert sum(r["lang_pred"] == r["lang"] for r in held) >= 0.95 * len(held)


def test_language_sample_is_spread(spark):
    sizes = {"a": 3000, "b": 3000, "c": 2000, "d": 2000, "e": 2000, "f": 2000, "g": 2000, "rare": 150}
    data = [f"{lang}{k}" for lang, n in sizes.items() for k in range(n)]
    df = spark.createDataFrame([(i, t.rstrip("0123456789"), t) for i, t in enumerate(data)], "doc_id long, lang string, text string")
    usable = {x: sum(t.startswith(x) and zlib.crc32(str(i).encode()) % 3 != 1 for i, t in enumerate(data)) for x in sizes}
    got = [r[0] for r in langid.sample(df, 240)]
    assert {x: got.count(x) for x in sizes} == {x: min(30, n) for x, n in usable.items()}
    assert langid.sample(df, 240) == langid.sample(df.repartition(3), 240)
    same = langid.sample(df.withColumn("doc_id", F.lit(9)), 240)
    assert [sum(r[0] == x for r in same) for x in sizes] == [30] * 8


def test_language_edge_cases(nasty, empty):
    got = langid.identify(nasty).collect()
    assert len(got) == nasty.count()
    by = {r["doc_id"]: r["lang_pred"] for r in got}
    assert by[12] == by[13] == by[14] == "und" and by[15] == "en"
    assert langid.identify(empty).collect() == []
    unlabelled = nasty.withColumn("lang", F.lit(None).cast("string"))
    assert {r["lang_pred"] for r in langid.identify(unlabelled).collect()} == {"und"}


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    train, test = labels.filter("doc_id % 4 <> 1"), labels.filter("doc_id % 4 = 1")
    got = quality.score_quality(docs, train).join(test, "doc_id").select("quality", "accepted").collect()
    right = np.mean([r["accepted"] == (r["quality"] == 1) for r in got])
    good = np.mean([r["accepted"] for r in got if r["quality"] == 1])
    assert right >= 0.93 and good >= 0.97


def test_quality_edge_cases(spark, nasty, empty):
    labels = spark.createDataFrame([(k, k % 2 if k != 3 else None, 0) for k in range(20)] + [(None, 1, 0), (1, 1, 0)], "doc_id long, quality int, toxic int")
    got = quality.score_quality(nasty, labels).collect()
    assert len(got) == nasty.count() and all(0 <= r["quality_score"] <= 1 for r in got) and got[0]["size"] == 7
    assert quality.score_quality(empty, labels).collect() == []
    assert all(r["accepted"] for r in quality.score_quality(nasty, labels.limit(0)).collect())
    assert all(r["accepted"] for r in quality.score_quality(nasty, labels.withColumn("quality", F.lit(1))).collect())


def test_meta_view_sees_no_words():
    a, b = quality.meta_features(["abc def\nghi", "xyz uvw\nrst"], ["en", "en"], ["s", "s"])
    assert (a == b).all()


def brute_topk(data, k=5):
    v = [(i, [int(np.floor(256 * float(x))) for x in e]) for i, e in data if e is not None and all(x is not None and np.isfinite(x) for x in e)]
    out = []
    for at, (q, x) in enumerate(v):
        if q is not None and q % 50 == 0:
            scored = sorted(((-sum(a * b for a, b in zip(x, y, strict=True)), c is None, c or 0, c) for i, (c, y) in enumerate(v) if i != at and len(y) == len(x)), key=lambda r: r[:3])
            out += [(q, r + 1, c, -s) for r, (s, _, _, c) in enumerate(scored[:k])]
    return sorted(out, key=str)


def test_topk_against_brute_force(spark):
    rng = np.random.RandomState(4)
    draw = lambda n=6: [float(np.float32(x)) for x in rng.randn(n)]
    data = [(i, draw()) for i in range(160)]
    data += [(i, data[7][1]) for i in range(160, 300)]  # one vector very often
    data += [(300, None), (301, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (302, [float("nan")] * 6), (350, [float("inf")] * 6), (400, [0.5, 0.5]), (401, [0.5, -0.5]), (None, [1.0] * 6), (450, [])]
    data += [(3, [9.0] * 6), (3, [8.0] * 6), (50, data[50][1]), (50, draw()), (None, [9.0] * 6), (None, [9.0] * 6), (500, draw(3000)), (501, draw(3000)), (None, None)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(5)
    clash = df.withColumns({"row": F.lit("x"), "v": F.lit(None).cast("int"), "score": F.lit(2.5), "query_id": F.lit(7)})
    want = brute_topk(data)
    for table, block in ((df, 2), (clash, 8192)):
        assert sorted((tuple(r) for r in topk.top_k(table, block_rows=block).collect()), key=str) == want
    assert sorted((tuple(r) for r in topk.top_k(df, block_bytes=100).collect()), key=str) == want
    assert topk.top_k(df.limit(0)).collect() == []
    assert len(topk.top_k(df.filter("vec_id in (0, 1, 2)")).collect()) == 2


def test_topk_twin_sees_every_row(spark):
    duckdb = pytest.importorskip("duckdb")
    from termloom.llm.catalog import OP4_SQL

    rng = np.random.RandomState(5)
    data = [(None if i % 9 == 8 else i % 70, [float(np.float32(x)) for x in rng.randn(4)]) for i in range(200)]
    embeddings = pd.DataFrame(data, columns=["vec_id", "embedding"]).astype({"vec_id": "Int64"})  # noqa: F841
    con = duckdb.connect()
    con.register("embeddings", embeddings)
    assert sorted((tuple(r) for r in con.sql(OP4_SQL).fetchall()), key=str) == brute_topk(data)


def test_topk_in_dense_neighbourhoods_needs_more_rounds(spark):
    rng = np.random.RandomState(9)
    x = rng.randn(6000, 64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[::3] = x[0] + 0.01 * rng.randn(2000, 64)
    df = spark.createDataFrame([(i, [float(v) for v in np.float32(r)]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    v = np.floor(256 * np.float32(x).astype(np.float64)).astype(np.int64)
    want = set()
    for q in range(0, len(v), 50):
        s = v @ v[q]
        near = [c for c in np.lexsort((np.arange(len(v)), -s)) if c != q][:5]
        want |= {(q, r + 1, int(c), int(s[c])) for r, c in enumerate(near)}
    assert {tuple(r) for r in topk.top_k(df).collect()} == want


PII_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: luhn(re.sub("[^0-9]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def luhn(d):
    return 13 <= len(d) <= 19 and sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(d[::-1])) % 10 == 0


PII_TEXTS = [
    "a@b.c%d@e.f x@y 1.2.3.4 256.1.1.1 1.2.3.4.5.6.7.8 000000255.0.0.1", "é😀 me@x.org, +1 (366) 555-9807 and +12 +1234567890123456",
    "4111 1111 1111 1111 4111-1111-1111-1112 41111111111111110 5", "call me: 366-555-9807 or (366) 555-9807.", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" x',
    "1." * 5000 + "1", "+1" + "2 " * 4000, "a@" + "b." * 6000 + "c", "", None, "name (at) host (dot) org", "1.2.3.4@x.y +1.2.3.4.5.6.7.8.9",
]


def test_pii_against_brute_force(spark, nasty, empty):
    docs = spark.createDataFrame(rows(PII_TEXTS), SCHEMA)
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    import hashlib

    for i, t in enumerate(PII_TEXTS):
        spans = [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t or "") if ok(m.group())] for k, p, ok in PII_KINDS]
        r = got[i]
        assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == [len(s) for s in spans]
        assert r["base_sha256"] == hashlib.sha256(",".join(sum(spans, [])).encode()).hexdigest()
        assert set(sum(spans, [])) <= set(r["spans"].split(","))
    assert "secret:9:49" in got[4]["spans"]
    assert pii.pii_digest(nasty).count() == nasty.count() and pii.pii_digest(empty).collect() == []


def base_spans(t):
    return [[f"{k}:{m.start()}:{m.end()}" for m in re.finditer(p, t) if ok(m.group())] for k, p, ok in PII_KINDS]


def test_pii_in_very_long_texts_takes_seconds(spark):
    import hashlib
    import time

    many = " ".join(f"u{k}@h{k % 7}.org, 10.0.{k % 300}.{k % 250} é" for k in range(20_000))
    mixed = " ".join(f"call 366-555-{k % 10000:04d} or 366-555-{k % 10000:04d}@x.org" for k in range(5000))
    texts = ["a" * 1_000_000 + " x@y.zz", "7" * 1_000_000 + ".1.1", "a.b-" * 250_000, "+1" + "(" * 1_000_000, "1." * 300_000, many, mixed]
    docs = spark.createDataFrame(rows(texts), SCHEMA).repartition(len(texts))
    began = time.time()
    got = {r["doc_id"]: r for r in pii.pii_digest(docs).collect()}
    assert time.time() - began < 60
    for i, t in enumerate(texts):
        known = {0: ["email:1000001:1000007"], 1: [], 2: [], 3: [], 4: [f"ip:{k}:{k + 7}" for k in range(0, 600_000, 8)]}  # plain patterns would take hours
        want = [known[i]] if i in known else base_spans(t)
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(sum(want, [])).encode()).hexdigest(), i
    began = time.time()
    clean = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(docs)).collect()}
    assert time.time() - began < 60
    spans = got[5]["spans"].split(",")
    at, out = 0, []
    for kind, a, b in sorted((x.split(":") for x in spans), key=lambda x: int(x[1])):
        out += [many[at : int(a)], f"<{kind.upper()}>"]
        at = int(b)
    assert clean[5] == "".join([*out, many[at:]]) and clean[0] == "a" * 1_000_000 + " <EMAIL>"


def test_pii_added_spans_meet_no_base_span(spark):
    rng = np.random.RandomState(3)
    atoms = ["366-555-9807", "(366) 555-9807", "me@x.org", "me (at) x (dot) org", "1.2.3.4", "256.1.1.1", "+13665559807", "sk_a1B2c3D4e5F6g7H8", "@", " ", ".", "-", "é", "tel "]
    texts = ["".join(rng.choice(atoms, 200)) for _ in range(40)]
    got = pii.propose(spark.createDataFrame(rows(texts), SCHEMA)).collect()
    assert sum(len(r["__tl_extra"]) for r in got) > 20
    for r in got:
        base = [(x["s"], x["e"]) for x in r["__tl_base"]]
        assert {f"{k}:{s}:{e}" for k, (s, e) in zip((pii.KINDS[x["k"]] for x in r["__tl_base"]), base, strict=True)} == set(sum(base_spans(r["text"]), []))
        assert not any(s < x["e"] and x["s"] < e for x in r["__tl_extra"] for s, e in base)
        for pattern, kind in ((pii.NATIONAL, "phone"), (pii.SECRET, "secret")):
            for m in re.finditer(pattern, r["text"]):
                meets = any(s < m.end() and m.start() < e for s, e in base)
                assert meets or (pii.KINDS.index(kind), m.start(), m.end()) in {(x["k"], x["s"], x["e"]) for x in r["__tl_extra"]}


def test_short_and_long_secrets_are_proposed(spark):
    keys = ["sk" + "a1B2" * 4, "pk_" + "c3D4" * 4, "ghp" + "e5F6" * 4, "sk-" + "a1B2" * 20, "0a9f" * 32]
    texts = [f"key: {k} ." for k in keys]
    got = {r["doc_id"]: r["__tl_extra"] for r in pii.propose(spark.createDataFrame(rows(texts), SCHEMA)).collect()}
    assert [[(x["s"], x["e"]) for x in got[i] if x["k"] == 4] for i in range(len(keys))] == [[(5, 5 + len(k))] for k in keys]


def test_redaction(spark):
    docs = spark.createDataFrame(rows(["é me@x.org and +1 (366) 555-9807.", None, "clean", "1.2.3.4@x.y"]), SCHEMA)
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(docs)).collect()}
    assert got[0] == "é <EMAIL> and <PHONE>." and got[1] is None and got[2] == "clean" and got[3] == "<EMAIL>"


def test_em_finds_the_reliable_labeler():
    rng = np.random.RandomState(0)
    counts = {}
    for _ in range(4000):
        y = rng.rand() < 0.4
        vote = lambda acc: (1 if (rng.rand() < acc) == y else -1)  # noqa: E731, B023
        key = (0, vote(0.95), vote(0.7), vote(0.7))
        counts[key] = counts.get(key, 0) + 1
    posterior, tables = pii.reliabilities([(*k, n) for k, n in counts.items()])
    right = [t[1][0] for t in tables[0]]
    assert right[0] > 0.88 and right[0] > max(right[1:])
    assert posterior[(0, 1, 1, 1)] > 0.9 > 0.1 > posterior[(0, -1, -1, -1)]


def test_quotes(spark, empty):
    data = [
        (1, 0, "user", "Hello there.\nHow are you?"), (1, 1, "assistant", "On Monday, user wrote:\n> Hello there.\n> How are you?\n\nFine, thanks."),
        (1, 2, "user", "assistant wrote:\n> On Monday, user wrote:\n> > Hello there.\r\n> > How are you?\n>\n> Fine, thanks.\n\nGreat."),
        (1, 3, "user", "New topic."), (1, 4, "bot", "> hello   THERE.\n> how are you?\nAlso me."), (2, 0, None, None), (2, 1, "a", "> unknown\nx"), (2, 1, "a", "> unknown\nx"), (None, 1, "a", "b"), (3, None, "a", "> b"),
    ]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string").withColumn("root", F.lit("clash"))
    got = [tuple(r) for r in quotes.reply_ordered(df).orderBy("conv_id", "position").collect()]
    assert (1, 1, 1, "assistant", 0, 0, 1, 1, 1, "<|assistant|>\nFine, thanks.") in got
    assert (1, 2, 2, "user", 1, 0, 2, 3, 2, "<|user|>\nGreat.") in got
    assert (1, 3, 4, "bot", 0, 0, 1, 1, 1, "<|bot|>\nAlso me.") in got
    assert (1, 4, 3, "user", None, 3, 0, 0, 0, "<|user|>\nNew topic.") in got
    assert (2, 0, 0, "unknown", None, 0, 0, 0, 0, "<|unknown|>\n") in got
    assert sorted(r[1] for r in got if r[0] == 2) == [0, 1, 2]
    assert [r[1] for r in got if r[0] is None or r[2] is None] == [None, None]
    assert quotes.reply_ordered(df.limit(0)).collect() == []


def test_one_hot_conversation_and_a_long_thread(spark):
    n = 2000
    data = [(7, 0, "u", "start here")] + [(7, t, "u", f"> {'start here' if t == 1 else f'say {t - 1}'}\nsay {t}") for t in range(1, n)]
    out = quotes.reply_ordered(spark.createDataFrame(data, "conv_id long, turn long, role string, text string")).toPandas().sort_values("turn")
    assert (out["position"] == np.arange(n)).all() and (out["root"] == 0).all() and (out["depth"] == np.arange(n)).all()
    assert isinstance(out, pd.DataFrame)

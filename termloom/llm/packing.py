"""Packing token pieces into fixed-length sequences by cutting-stock.

A document's ids are cut every ``capacity`` ids; only the last piece is
shorter.  The histogram of those lengths, in classes of ``UNIT`` rounded up, is
a cutting-stock problem: a linear program over patterns whose columns come
from a knapsack dynamic program at the current duals.  Rounded-down patterns
take pieces by their rank within their class, what is left goes first-fit
decreasing.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import materialize
from termloom.llm.shingles import slices
from termloom.llm.tokens import encoder, vocabulary_path

UNIT = 8


def _knapsack(lengths: np.ndarray, value: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded filling of ``capacity``; lengths ascend."""
    best, take = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    upto = np.searchsorted(lengths, np.arange(capacity + 1), "right")
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        if k := upto[c]:
            got = best[c - lengths[:k]] + value[:k]
            i = got.argmax()
            if got[i] > best[c] + 1e-12:
                best[c], take[c] = got[i], i
    pattern, c = np.zeros(len(lengths)), capacity
    while c > 0:
        if take[c] < 0:
            c -= 1
        else:
            pattern[take[c]] += 1
            c -= lengths[take[c]]
    return float(best[capacity]), pattern


def solve_patterns(histogram: dict[int, int], capacity: int, gap: float = 0.002, max_rounds: int = 4000) -> list[tuple[dict[int, int], int]]:
    """Patterns ({length: copies}, times) that use every piece exactly once.

    Column generation stops when the dual bound shows the linear program
    within ``gap`` of its optimum, or after ``max_rounds`` columns; what it
    has then is feasible all the same.
    """
    lengths = np.array(sorted(k for k, v in histogram.items() if v), dtype=np.int64)
    demand = np.array([histogram[k] for k in lengths.tolist()], dtype=np.float64)
    m = len(lengths)
    if not m:
        return []
    fill = capacity // lengths
    basis, inverse, x = np.diag(fill.astype(float)), np.diag(1.0 / fill), demand / fill
    for _ in range(max_rounds):
        dual = inverse.sum(axis=0)
        worth, column = _knapsack(lengths, dual, capacity)
        if worth <= 1 + gap:
            break
        w = inverse @ column
        ratio = np.where(w > 1e-9, x / np.where(w > 1e-9, w, 1), np.inf)
        out = int(ratio.argmin())
        step = max(ratio[out], 0.0)
        x -= step * w
        x[out] = step
        np.maximum(x, 0, out=x)
        basis[:, out] = column
        pivot = inverse[out] / w[out]
        inverse -= np.outer(w, pivot)
        inverse[out] = pivot
    left = demand.astype(np.int64)
    out: list[tuple[dict[int, int], int]] = []
    for j in np.argsort(-x):
        use = basis[:, j].astype(np.int64)
        held = use > 0
        times = min(int(x[j] + 1e-6), int((left[held] // use[held]).min()))
        if times > 0:
            left -= times * use
            out.append((dict(zip(lengths[held].tolist(), use[held].tolist(), strict=True)), times))
    spare: Counter = Counter()
    while left.any():
        room, got = capacity, {}
        while True:
            fits = np.flatnonzero((left > 0) & (lengths <= room))
            if not len(fits):
                break
            i = fits[-1]
            n = int(min(left[i], room // lengths[i]))
            got[int(lengths[i])] = got.get(int(lengths[i]), 0) + n
            left[i] -= n
            room -= n * int(lengths[i])
        spare[tuple(got.items())] += 1
    return out + [(dict(k), v) for k, v in spare.items()]


def token_pieces(docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids) of every piece."""
    tokenizer = vocabulary or vocabulary_path()

    def cut(batches):
        import pyarrow as pa

        enc = encoder(tokenizer)
        for batch in batches:
            for rows in slices(batch):
                raw, n = enc.encode_many(rows.column(1).to_pylist())
                ids = np.insert(raw, np.cumsum(n), end_id).astype("<u4")
                n = n + 1
                pieces = -(-n // capacity)
                doc = np.repeat(np.arange(len(n)), pieces)
                k = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                start = k * capacity
                length = np.minimum(n[doc] - start, capacity)
                first = (np.cumsum(n) - n)[doc] + start
                view = ids.view(np.uint8).data
                crc = [zlib.crc32(view[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)]
                out = {"doc_id": rows.column(0).take(pa.array(doc)), "start": pa.array(start, pa.int64()), "length": pa.array(length, pa.int64()), "ids_crc32": pa.array(crc, pa.int64()), "doc_tokens": pa.array(n[doc], pa.int64())}
                if with_ids:
                    out["ids"] = pa.array([bytes(view[4 * a : 4 * (a + b)]) for a, b in zip(first.tolist(), length.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict(out)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, schema)


def pack_documents(docs: DataFrame, capacity: int = 1024, end_id: int = 0, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Every piece of every document with its sequence_id and offset.

    A null text is empty and gives its end id alone; repeated rows are packed
    each; an empty table gives no piece; only doc_id and text are read, so
    other columns never clash.  A text is encoded whole whatever its length,
    about a megabyte of texts (or one longer text) at a time, and a very long
    one gives as many pieces as it needs.  Pieces of equal length take their
    places by doc_id, start and checksum.  Full pieces are sequences of their own.  Ranks within a length are counted in
    salted groups, so a length that most documents share is spread.  The
    driver holds the histogram and the patterns: at most ``capacity`` lengths.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, capacity, end_id, vocabulary, with_ids), "pieces")
    unit = UNIT if capacity % UNIT == 0 else 1
    pieces = pieces.withColumn("class", F.when(F.col("length") == capacity, capacity // unit + 1).otherwise(F.ceil(F.col("length") / unit)).cast("long"))
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count("*").alias("n")).collect()}
    total, full = sum(histogram.values()), histogram.pop(capacity // unit + 1, 0)
    slots: dict[int, list[tuple[int, int, int, int]]] = {}
    used: Counter = Counter()
    sequence = full
    for pattern, times in solve_patterns(histogram, capacity // unit):
        slot = 0
        for size, copies in pattern.items():
            slots.setdefault(size, []).append((used[size], copies, sequence, slot))
            used[size] += copies * times
            slot += copies
        sequence += times
    if full:
        slots[capacity // unit + 1] = [(0, 1, 0, 0)]
    plan = spark.sparkContext.broadcast({k: np.array(v, dtype=np.int64).T for k, v in slots.items()})  # a few numbers for each pattern

    salts = max(16, total // 1500)
    salted = pieces.withColumn("salt", F.pmod(F.xxhash64("doc_id", "start"), F.lit(salts)))
    before = W.partitionBy("class").orderBy("salt").rowsBetween(W.unboundedPreceding, -1)
    bases = salted.groupBy("class", "salt").agg(F.count("*").alias("n")).select("class", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("class", "salt").orderBy("length", "doc_id", "start", "ids_crc32")
    ranked = salted.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["class", "salt"]).withColumn("rank", F.col("rank") + F.col("base")).drop("base", "salt")

    def place(batches):
        for b in batches:
            rank, size = b["rank"].to_numpy(), b["class"].to_numpy()
            seq, slot = np.zeros(len(b), dtype=np.int64), np.zeros(len(b), dtype=np.int64)
            for own in np.unique(size):
                at = np.flatnonzero(size == own)
                first, copies, base, offset = plan.value[int(own)]
                j = np.searchsorted(first, rank[at], "right") - 1
                r = rank[at] - first[j]
                seq[at], slot[at] = base[j] + r // copies[j], offset[j] + r % copies[j]
            yield pd.DataFrame({**{c: b[c] for c in names}, "sequence_id": seq, "slot": slot})

    names = [c for c in pieces.columns if c != "class"]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema if f.name != "class")
    placed = ranked.select(*names, "class", "rank").mapInPandas(place, schema + ", sequence_id long, slot long")
    ahead = W.partitionBy("sequence_id").orderBy("slot").rowsBetween(W.unboundedPreceding, -1)  # at most capacity rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(ahead), F.lit(0))).drop("slot")

"""Sharding by histogram sort.

The key of a document is (hash of its text, doc_id), so equal texts are
neighbours.  Splitters are found by counting: each round proposes keys inside
every open interval, one pass over a narrow table counts exact bytes and rows
below each proposal in every partition, and the intervals shrink until each
splitter is within the tolerance of its target.  Then all rows move once, to
the place the splitters give.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize

_LOW, _FULL, _SPAN = 0, 1 << 128, 1 << 64


def _halves(keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    return np.array([(k >> 64) - (1 << 63) for k in keys], dtype=np.int64), np.array([(k & (_SPAN - 1)) - (1 << 63) for k in keys], dtype=np.int64)


def _below(h: np.ndarray, d: np.ndarray, ph: np.ndarray, pd_: np.ndarray) -> np.ndarray:
    """How many of the sorted boundaries are at or below each key."""
    lo, hi = np.searchsorted(ph, h, "left"), np.searchsorted(ph, h, "right")
    for i in np.flatnonzero(hi > lo):
        lo[i] += np.searchsorted(pd_[lo[i] : hi[i]], d[i], "right")
    return lo


def _counts(keys: DataFrame, probes: list[int]) -> list[tuple[int, int]]:
    """Exact (bytes, rows) below each sorted probe, in one pass."""
    ph, pd_ = _halves(probes)
    width = len(probes) + 1

    def count(batches):
        size, rows = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
        for b in batches:
            at = _below(b["h"].to_numpy(), b["d"].to_numpy(), ph, pd_)
            np.add.at(size, at, b["size"].to_numpy())
            rows += np.bincount(at, minlength=width)
        yield pd.DataFrame({"at": np.flatnonzero(rows), "size": size[rows > 0], "n": rows[rows > 0]})

    found = keys.select("h", "d", "size").mapInPandas(count, "at long, size long, n long").groupBy("at").agg(F.sum("size").alias("s"), F.sum("n").alias("n")).collect()
    size, rows = np.zeros(width, dtype=np.int64), np.zeros(width, dtype=np.int64)
    for r in found:
        size[r["at"]], rows[r["at"]] = r["s"], r["n"]
    return [(int(a), int(b)) for a, b in zip(np.cumsum(size)[:-1], np.cumsum(rows)[:-1], strict=True)]


def find_splitters(keys: DataFrame, parts: int, tolerance: float = 0.001, probes: int = 24, most_probes: int = 200_000) -> tuple[list[int], list[int], int]:
    """Keys that cut the bytes into ``parts`` near-equal runs.

    Returns the splitters, the exact rows below each, and the number of
    rounds.  A splitter is settled once it is within ``tolerance`` of a part's
    bytes, or once no key is left between its bounds.  A round asks for
    ``probes`` keys in every open interval, fewer where all of them would be
    more than ``most_probes``.
    """
    total = keys.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    size, n = total["s"] or 0, total["n"]
    targets = [size * j // parts for j in range(1, parts)]
    state = [((_LOW, 0, 0), (_FULL, size, n)) for _ in targets]
    limit, rounds = size / parts * tolerance, 0

    def settled(j: int) -> bool:
        lo, hi = state[j]
        near = min(abs(lo[1] - targets[j]), abs(hi[1] - targets[j]))
        return near <= limit or hi[0] - lo[0] <= 1 or hi[2] - lo[2] <= 0

    still = [j for j in range(len(targets)) if not settled(j)]
    while still:
        rounds += 1
        wanted: set[int] = set()
        intervals = Counter((state[j][0][0], state[j][1][0]) for j in still)
        share = max(2, min(probes, most_probes // len(intervals)))
        for (lo, hi), own in intervals.items():
            k = max(share, 2 * own)
            step = hi - lo
            for i in range(1, k + 1):
                key = lo + step * i // (k + 1)
                if step > _SPAN * (k + 1):
                    key = key >> 64 << 64  # whole groups of equal texts as long as there are several hashes
                elif step > _SPAN and i * 2 > k:
                    key = min(-(-key >> 64) << 64, hi) if hi - lo > 2 * _SPAN else ((lo >> 64) + 1) << 64
                if lo < key < hi:
                    wanted.add(key)
        if not wanted:
            break
        ordered = sorted(wanted)
        got = [(_LOW, 0, 0), *((k, *c) for k, c in zip(ordered, _counts(keys, ordered), strict=True)), (_FULL, size, n)]
        sizes = [g[1] for g in got]
        for j in still:
            lo, hi = state[j]
            below, above = got[bisect_right(sizes, targets[j]) - 1], got[bisect_left(sizes, targets[j])]
            state[j] = (max(lo, below), min(hi, above))
        still = [j for j in still if not settled(j)]
    chosen = [min(x, key=lambda c: abs(c[1] - t)) for x, t in zip(state, targets, strict=True)]  # noqa: B023
    return [c[0] for c in chosen], [c[2] for c in chosen], rounds


def shard_documents(docs: DataFrame, n_shards: int = 40, tolerance: float = 0.001, part_bytes: int = 128 << 20, most_parts: int = 100_000) -> DataFrame:
    """All rows and columns of ``docs`` with size, shard and slot.

    A row's size is the UTF-8 bytes of its text (null: none) plus 16; shards
    get near-equal sums of sizes.  slot counts from 0 in each shard, by key.
    A shard of more than ``part_bytes`` is exchanged as several key runs of
    about that size, so no task sorts a whole shard; beyond ``most_parts`` runs
    in all they grow instead (a gigabyte each at 100 TB), and a task's sort
    spills.  A text counts whole whatever its length and is never cut.  Null
    doc_ids sort first; rows alike in text and doc_id have one key and stay
    together; an empty table gives no rows.  Columns already named size, shard
    or slot are replaced, those whose names begin with __tl_ are this module's own.
    """
    spark = docs.sparkSession
    h = F.xxhash64(F.coalesce("text", F.lit("")))
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + F.lit(16)).cast("long")
    keys = materialize(docs.select(h.alias("h"), d.alias("d"), size.alias("size")), "shard-keys")
    total = keys.agg(F.sum("size")).first()[0] or 0
    runs = max(1, min(-(-total // (n_shards * part_bytes)), max(1, most_parts // n_shards)))
    splitters, rows_below, _ = find_splitters(keys, n_shards * runs, tolerance)
    discard(keys)
    ph, pd_ = _halves([min(s, _FULL - 1) for s in splitters])
    held = spark.sparkContext.broadcast((ph, pd_))  # 16 bytes a part, at most most_parts of them

    @F.pandas_udf("int")
    def part_of(h: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series(_below(h.to_numpy(), d.to_numpy(), *held.value).astype(np.int32))

    below = [0, *rows_below]
    starts = spark.createDataFrame([(i, below[i] - below[i // runs * runs]) for i in range(n_shards * runs)], "__tl_part int, __tl_base long")
    placed = docs.withColumns({"__tl_h": h, "__tl_d": d, "size": size}).withColumn("__tl_part", part_of("__tl_h", "__tl_d"))
    moved = placed.repartitionById(n_shards * runs, "__tl_part").sortWithinPartitions("__tl_part", "__tl_h", "__tl_d")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    moved = moved.withColumn("__tl_index", index)
    return (
        moved.join(F.broadcast(starts), "__tl_part")
        .withColumn("shard", (F.col("__tl_part") / runs).cast("int"))
        .withColumn("slot", F.col("__tl_index") + F.col("__tl_base"))
        .drop("__tl_h", "__tl_d", "__tl_part", "__tl_index", "__tl_base")
    )


def shard_digest(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    out = shard_documents(docs.select("doc_id", "text"), n_shards)
    crc = F.crc32(F.coalesce(F.encode("text", "UTF-8"), F.lit(b"")))
    return out.select("doc_id", "size", crc.alias("text_crc32"), F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))

"""Exact top-k by distributed histogram selection.

Every candidate is scored against a block of queries.  A pass counts scores in
a histogram over each query's open interval, all partitions together; the bin
that holds the k-th value becomes the next interval, until it holds few scores
or one value.  Then one pass keeps what reaches the k-th value and ties go to
the smaller id.  A partition reports only bins from its top down to its own
k-th score: lower ones cannot hold the k-th value of all.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import discard, materialize, work_path

BINS = 256
SCORED = 1024  # queries and candidates of one score matrix


def quantized(vectors: DataFrame) -> DataFrame:
    """row (a number of its own), vec_id and v = floor(256 * x) of every finite
    vector without nulls."""
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform("embedding", lambda x: F.floor(F.lit(256.0) * x.cast("double")).cast("long"))
    return vectors.filter(F.col("embedding").isNotNull()).filter(sound).select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("vec_id"), v.alias("v"))


class _Block:
    """A block of queries (row, vec_id, v), as matrices by number of dimensions."""

    def __init__(self, queries: list[tuple[int, int, list[int]]], reach: float):
        self.rows = np.array([q[0] for q in queries], dtype=np.int64)
        self.ids = np.array([q[1] for q in queries], dtype=np.int64)
        self.groups: dict[int, list] = {}
        self.bound = np.zeros(len(queries))
        for dim in {len(q[2]) for q in queries}:
            own = np.array([i for i, q in enumerate(queries) if len(q[2]) == dim])
            v = np.array([queries[i][2] for i in own], dtype=np.int64).reshape(len(own), dim)
            self.bound[own] = np.sqrt((v.astype(np.float64) ** 2).sum(axis=1)) * reach
            self.groups[dim] = [(own[k : k + SCORED], v[k : k + SCORED]) for k in range(0, len(own), SCORED)]
        self.exact = bool((self.bound < 2**52).all())  # then float products and sums are whole numbers

    def scores(self, batches):
        """(query numbers, vec_ids, whether null, score matrix, whether another row) for runs of candidates."""
        import pyarrow.compute as pc

        for b in batches:
            row, ids, v = (b.column(k) for k in range(3))
            dims = np.asarray(pc.list_value_length(v))
            for dim in self.groups.keys() & set(dims.tolist()):
                own = np.flatnonzero(dims == dim)
                for k in range(0, len(own), SCORED):
                    part = own[k : k + SCORED]
                    r, i = (np.asarray(pc.fill_null(c.take(part), 0)) for c in (row, ids))
                    null = np.asarray(pc.is_null(ids.take(part)))
                    x = np.asarray(v.take(part).flatten(), dtype=np.int64).reshape(len(part), dim)
                    x = x.astype(np.float64).T if self.exact else x.T
                    for at, q in self.groups[dim]:
                        s = (q.astype(np.float64) @ x).astype(np.int64) if self.exact else q @ x
                        yield at, i, null, s, self.rows[at][:, None] != r[None, :]


def _histogram(vectors: DataFrame, block, lo: np.ndarray, hi: np.ndarray, width: np.ndarray, need: np.ndarray) -> DataFrame:
    """query, bin and n: scores in [lo + bin * width, ...) below hi over all
    rows; the last bin may reach beyond hi, where scores are counted already."""

    def count(batches):
        import pyarrow as pa

        total = np.zeros((len(lo), BINS), dtype=np.int64)
        for at, _, _, s, other in block.value.scores(batches):
            bin_ = (s - lo[at, None]) // width[at, None]
            ok = other & (bin_ >= 0) & (bin_ < BINS) & (s < hi[at, None])
            flat = (np.arange(len(at))[:, None] * BINS + bin_)[ok]
            total[at] += np.bincount(flat, minlength=len(at) * BINS).reshape(len(at), BINS)
        above = np.cumsum(total[:, ::-1], axis=1)[:, ::-1] - total
        q, bin_ = np.nonzero((total > 0) & (above < need[:, None]))
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(bin_), pa.array(total[q, bin_])], names=["query", "bin", "n"])

    return vectors.mapInArrow(count, "query long, bin long, n long").groupBy("query", "bin").agg(F.sum("n").alias("n"))


def _thresholds(vectors: DataFrame, block, k: int, few: int = 20) -> np.ndarray:
    """A score for each query that at least its k best reach, and few others
    (or all scores, if there are fewer than k)."""
    bound = block.value.bound
    q = len(bound)
    lo = np.maximum(np.floor(-bound), -(2.0**62)).astype(np.int64) - 1
    hi = np.minimum(np.ceil(bound), 2.0**62).astype(np.int64) + 2
    need = np.full(q, k, dtype=np.int64)
    floor, open_ = lo.copy(), np.ones(q, dtype=bool)
    while open_.any():
        width = np.where(open_, np.maximum(1, -((lo - hi) // BINS)), 1)
        start = np.where(open_, lo, np.int64(2**62))
        counts = _histogram(vectors, block, start, hi, width, need)
        down = W.partitionBy("query").orderBy(F.desc("bin"))
        limits = counts.sparkSession.createDataFrame([(i, int(n)) for i, n in enumerate(need)], "query long, need long")
        kth = counts.withColumn("upto", F.sum("n").over(down)).join(F.broadcast(limits), "query").filter("upto >= need").groupBy("query").agg(F.max(F.struct("bin", "upto", "n")).alias("m")).select("query", "m.*")
        found = {r["query"]: r for r in kth.collect()}  # one row for each query of the block
        for i in np.flatnonzero(open_):
            r = found.get(int(i))
            if r is None:  # fewer than k scores
                open_[i] = False
                continue
            lo[i] = floor[i] = lo[i] + r["bin"] * width[i]
            hi[i] = min(hi[i], lo[i] + width[i])
            need[i] -= r["upto"] - r["n"]
            if width[i] == 1 or r["upto"] <= few * k:
                open_[i] = False
    return floor


def _best(held: list[tuple], k: int) -> tuple:
    """The k first rows (query, vec_id, null, score) of each query."""
    q, v, null, s = (np.concatenate(x) for x in zip(*held, strict=True))
    order = np.lexsort((v, null, -s, q))
    q = q[order]
    own = order[np.arange(len(q)) - np.searchsorted(q, q, "left") < k]
    return tuple(np.concatenate(x)[own] for x in zip(*held, strict=True))


def _nearest(vectors: DataFrame, block, floor: np.ndarray, k: int) -> DataFrame:
    """Each partition's k best of what reaches the query's floor."""

    def keep(batches):
        import pyarrow as pa

        held = [(np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), np.zeros(0, dtype=bool), np.zeros(0, dtype=np.int64))]
        rows = 0
        for at, ids, null, s, other in block.value.scores(batches):
            i, j = np.nonzero(other & (s >= floor[at, None]))
            held.append((at[i], ids[j], null[j], s[i, j]))
            rows += len(i)
            if rows > 500_000:
                held, rows = [_best(held, k)], 0
        q, v, null, s = _best(held, k)
        yield pa.RecordBatch.from_arrays([pa.array(block.value.rows[q]), pa.array(block.value.ids[q]), pa.array(v, mask=null), pa.array(s)], names=["query", "query_id", "vec_id", "score"])

    near = vectors.mapInArrow(keep, "query long, query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, block_rows: int = 8192, block_bytes: int = 16 << 20) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k highest scores.

    Queries are the rows whose vec_id is divisible by ``every``, taken in blocks
    of at most ``block_rows`` rows and about ``block_bytes``; candidates are all
    rows but the query's own, of the same number of dimensions.  Rows that
    share a vec_id stay rows of their own, as queries and as candidates, and a
    row with a null vec_id is a candidate whose id comes last in ties.  Scores
    are integer inner products, exact within 64 bits; ties go to the smaller
    vec_id.  Vectors that are null or hold a null or non-finite component take
    no part; an empty vector scores 0 against other empty ones; no query, no
    row.  Vectors may be long: a block then has fewer queries.  Only vec_id
    and embedding are read, so other columns never clash.
    """
    spark = vectors.sparkSession
    table = materialize(quantized(vectors), "vectors")
    norm2 = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    reach = float(np.sqrt(table.agg(F.max(norm2)).first()[0] or 0.0))
    folder = work_path(spark, "nearest")
    schema = "query_id long, rank int, vec_id long, score long"
    spark.createDataFrame([], schema).write.parquet(folder)

    def run(queries: list[tuple]) -> None:
        block = spark.sparkContext.broadcast(_Block(queries, reach))
        _nearest(table, block, _thresholds(table, block, k), k).write.mode("append").parquet(folder)
        block.unpersist()

    held, size = [], 0
    for r in table.filter(F.col("vec_id") % every == 0).toLocalIterator():
        held.append((r["row"], r["vec_id"], list(r["v"])))
        size += 8 * len(r["v"]) + 16
        if len(held) == block_rows or size >= block_bytes:
            run(held)
            held, size = [], 0
    if held:
        run(held)
    discard(table)
    return spark.read.schema(schema).parquet(folder)

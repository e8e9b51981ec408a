"""K-means of samples over all their terms, laid out by term.

MLlib's centres are dense: each round sends and gathers a number for every
feature and cluster.  Here a centre is never whole.  The cells of a term lie in
one block, which sums its own part of each centre from the samples' clusters and
adds up what it gives to every sample's inner product with them; what moves in a
round is a number for each sample, cluster and task.  Start (k-means||, two
steps), rounds and the end (``tolerance`` of every centre's step) are those of
MLlib's ``KMeans``.  The driver holds a cluster and a few numbers of each sample.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.plans.storage import stored

#: Cells of a block of terms, samples whose products are summed together, first centres of a pass.
BLOCK_CELLS, SAMPLE_RANGE, MOST_CENTRES = 1 << 22, 1 << 15, 32


def blocked(shares: DataFrame, samples: int, cells: int) -> DataFrame:
    """Blocks of terms from (term, place, share), a row for each term of a sample:
    share * ln(samples / df), without zeros.  A block has its terms' numbers of
    cells, and the cells' places and values."""
    parallel = shares.sparkSession.sparkContext.defaultParallelism
    parts = max(1, -(-cells // BLOCK_CELLS), min(parallel, cells >> 16))
    parts = -(-parts // parallel) * parallel if parts > parallel else parts

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        t = pa.Table.from_batches(held)
        code = pa.concat_arrays(t["term"].chunks).dictionary_encode().indices.to_numpy()
        order, df = np.argsort(code, kind="stable"), np.bincount(code)
        value = t["share"].to_numpy()[order] * np.repeat(np.log(samples / df), df)
        some = value != 0
        sizes = np.bincount(code[order][some], minlength=len(df)).astype(np.int32)
        body = [sizes[sizes > 0], t["place"].to_numpy()[order][some], value[some]]
        yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in body], names=["sizes", "places", "values"])

    dealt = shares.select("term", F.col("place").cast("int").alias("place"), "share").repartition(parts, "term")
    return stored(dealt.mapInArrow(build, "sizes binary, places binary, values binary"), "term-blocks")


@dataclass(frozen=True)
class Products:
    """What a pass found: each sample's nearest centre and its square distance
    less the sample's own square, the centres' squares, the summed products of
    samples with their nearest centre, those of the samples asked for with each
    centre, and the samples' squares where asked for."""

    label: np.ndarray
    best: np.ndarray | None
    squares: np.ndarray
    cross: np.ndarray
    wanted: np.ndarray
    norms: np.ndarray | None


def _numbers(x, dtype) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), dtype=dtype)


def products(blocks: DataFrame, samples: int, layers: list, centres: int, want: np.ndarray | None = None, norms: bool = False, best: bool = False) -> Products:
    """A pass over all cells.  In each layer (centre, share) a sample stands for
    its share in one centre, or in none at -1; centres are the sums."""
    want = np.zeros(0, np.int64) if want is None else np.sort(want)
    sc = blocks.sparkSession.sparkContext
    held = sc.broadcast(layers)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        sums, squares = None, np.zeros(centres)
        for batch in batches:
            for sizes, places, values in zip(batch["sizes"], batch["places"], batch["values"], strict=True):
                sizes, place, value = _numbers(sizes, np.int32), _numbers(places, np.int32), _numbers(values, np.float64)
                if sums is None:
                    sums = np.zeros((centres + norms, samples))
                own, term = np.zeros(centres * len(sizes)), np.repeat(np.arange(len(sizes)), sizes)
                for centre, share in held.value:
                    at = centre[place]
                    some = np.flatnonzero(at >= 0)
                    own += np.bincount(at[some].astype(np.int64) * len(sizes) + term[some], value[some] * share[place[some]], len(own))
                own = own.reshape(centres, len(sizes))
                squares += (own * own).sum(axis=1)
                for k in np.flatnonzero(own.any(axis=1)):
                    sums[k] += np.bincount(place, value * own[k][term], samples)
                if norms:
                    sums[centres] += np.bincount(place, value * value, samples)
        if sums is not None:
            part = TaskContext.get().partitionId()
            for r, low in enumerate(range(0, samples, SAMPLE_RANGE)):
                yield pa.RecordBatch.from_arrays([pa.array([r], pa.int32()), pa.array([part], pa.int32()), pa.array([squares.tobytes()], pa.binary()), pa.array([sums[:, low : low + SAMPLE_RANGE].tobytes()], pa.binary())], names=["r", "part", "squares", "sums"])

    def nearest(t: pa.Table) -> pa.Table:
        r, order = t["r"][0].as_py(), np.argsort(t["part"].to_numpy())
        squares = sum(_numbers(t["squares"][int(i)], np.float64) for i in order)
        sums = sum(_numbers(t["sums"][int(i)], np.float64).reshape(centres + norms, -1) for i in order)
        dots = sums[:centres]
        far = squares[:, None] - 2 * dots
        label = far.argmin(axis=0)
        every = np.arange(len(label))
        own = want[(want >= r * SAMPLE_RANGE) & (want < (r + 1) * SAMPLE_RANGE)] - r * SAMPLE_RANGE
        found = [label.astype(np.int32), far[label, every] if best else None, squares, np.bincount(label, dots[label, every], centres), dots[:, own].T.copy(), sums[centres] if norms else None]
        return pa.table([pa.array([r], pa.int32()), *(pa.array([None if x is None else x.tobytes()], pa.binary()) for x in found)], names=["r", "label", "best", "squares", "cross", "wanted", "norms"])

    few = blocks.coalesce(sc.defaultParallelism).mapInArrow(add, "r int, part int, squares binary, sums binary")
    found = sorted(few.groupBy("r").applyInArrow(nearest, "r int, label binary, best binary, squares binary, cross binary, wanted binary, norms binary").collect())
    held.destroy()
    if not found:  # no cell at all
        zero = np.zeros(samples)
        return Products(np.zeros(samples, np.int32), zero, np.zeros(centres), np.zeros(centres), np.zeros((len(want), centres)), zero)
    whole = lambda n, dtype: np.concatenate([np.frombuffer(x[n], dtype) for x in found])
    cross = sum(np.frombuffer(x["cross"]) for x in found)
    return Products(whole("label", np.int32), whole("best", np.float64) if best else None, np.frombuffer(found[0]["squares"]), cross, whole("wanted", np.float64).reshape(-1, centres), whole("norms", np.float64) if norms else None)


def _plus_plus(gram: np.ndarray, weights: np.ndarray, k: int, rng: np.random.Generator, most: int = 30) -> np.ndarray:
    """Centres as shares of weighted points that are known by their inner products: k-means++ and its rounds."""
    n, own = len(gram), np.diag(gram)
    chosen = [int(rng.choice(n, p=weights / weights.sum()))]
    cost = own + own[chosen[0]] - 2 * gram[chosen[0]]
    while len(chosen) < k:
        odds = weights * np.maximum(cost, 0)
        odds[chosen] = 0
        if not odds.sum() > 0:
            break
        chosen.append(int(rng.choice(n, p=odds / odds.sum())))
        cost = np.minimum(cost, own + own[chosen[-1]] - 2 * gram[chosen[-1]])
    mix = np.zeros((len(chosen), n))
    mix[np.arange(len(chosen)), chosen] = 1
    before = None
    for _ in range(most):
        near = mix @ gram
        label = ((near * mix).sum(axis=1)[:, None] - 2 * near).argmin(axis=0)
        if before is not None and (label == before).all():
            break
        before = label
        mix = np.zeros_like(mix)
        mix[label, np.arange(n)] = weights
        for c in np.flatnonzero(mix.sum(axis=1) == 0):
            mix[c, int(rng.integers(n))] = 1
        mix /= mix.sum(axis=1, keepdims=True)
    return mix


def _layers(mix: np.ndarray, rows: np.ndarray, samples: int) -> list:
    """Layers of centres that are sums of ``rows``, ``mix`` of each."""
    out, left = [], mix.copy()
    while left.any():
        centre, share = np.full(samples, -1, np.int32), np.zeros(samples)
        at = np.flatnonzero(left.any(axis=0))
        first = (left[:, at] != 0).argmax(axis=0)
        centre[rows[at]], share[rows[at]] = first, left[first, at]
        left[first, at] = 0
        out.append((centre, share))
    return out


def start(blocks: DataFrame, samples: int, k: int, rng: np.random.Generator, steps: int = 2) -> tuple[list, int, np.ndarray]:
    """Layers and number of the first centres, by k-means||, and which samples have a cell.

    Each step draws about 2 k samples in proportion to their square distance
    from those drawn; all are weighed by the samples next to them and made
    ``k`` centres.  Products with more than ``MOST_CENTRES`` take several passes.
    """
    norms = products(blocks, samples, [], 1, norms=True).norms
    some = norms > 0
    if not some.any():
        return [], 0, some
    drawn = np.array([rng.choice(np.flatnonzero(some))])
    fresh, rows = drawn, np.zeros(0, np.int64)
    best, nearest, known = np.full(samples, np.inf), np.zeros(samples, np.int64), {}
    for step in range(steps + 1):
        for low in range(0, len(fresh), MOST_CENTRES):
            part = np.sort(fresh[low : low + MOST_CENTRES])
            rows = np.concatenate([rows, part])
            asked = np.sort(rows)
            got = products(blocks, samples, _layers(np.eye(len(part)), part, samples), len(part), want=asked, best=True)
            closer = got.best < best
            best[closer], nearest[closer] = got.best[closer], got.label[closer] + len(rows) - len(part)
            known.update({(i, j): got.wanted[a, b] for a, i in enumerate(asked) for b, j in enumerate(part)})
        cost = np.where(some, np.maximum(norms + best, 0), 0)
        cost[cost <= 1e-12 * norms] = 0  # equal to one drawn, but for rounding
        if step == steps or not cost.sum() > 0:
            break
        fresh = np.flatnonzero(rng.random(samples) < 2 * k * cost / cost.sum())
    gram = np.array([[known[i, j] if (i, j) in known else known[j, i] for j in rows] for i in rows])
    gap = np.diag(gram)[:, None] + np.diag(gram)[None, :] - 2 * gram
    first = (gap <= 1e-12 * np.diag(gram)[:, None]).argmax(axis=1)  # of equal samples
    weights = np.bincount(first[nearest[some]], minlength=len(rows)).astype(float)
    kept = np.flatnonzero(first == np.arange(len(rows)))
    mix = np.eye(len(kept)) if len(kept) <= k else _plus_plus(gram[np.ix_(kept, kept)], weights[kept], k, rng)
    return _layers(mix, rows[kept], samples), len(mix), some


def rounds(blocks: DataFrame, samples: int, layers: list, centres: int, some: np.ndarray, most: int = 20, tolerance: float = 1e-4) -> np.ndarray:
    """The cluster of each sample, -1 of those without a cell.  A centre whose samples all leave stays where it was."""
    before = None
    for n in range(most + 1):
        got = products(blocks, samples, layers, centres)
        label = np.where(some, got.label, -1).astype(np.int32)
        if before is not None and ((before[1] + got.squares - 2 * before[2] <= tolerance * tolerance).all() or (label == before[0]).all()):
            break
        if n == most:
            break
        held = np.bincount(label[some], minlength=centres)
        stay = [(np.where((c >= 0) & (held[c] == 0), c, -1).astype(np.int32), share) for c, share in layers] if (held == 0).any() else []
        layers = [(label, np.where(some, 1 / np.maximum(held, 1)[label], 0)), *(x for x in stay if (x[0] >= 0).any())]
        before = label, got.squares, np.where(held > 0, got.cross / np.maximum(held, 1), got.squares)
    return label


def kmeans(shares: DataFrame, samples: int, cells: int, k: int, seed: int = 7) -> np.ndarray:
    """The cluster of each of ``samples`` places in (term, place, share), by tf-idf; -1 of those without a weight."""
    if not samples:
        return np.zeros(0, np.int32)
    blocks = blocked(shares, samples, cells)
    layers, centres, some = start(blocks, samples, k, np.random.default_rng(seed))
    return rounds(blocks, samples, layers, centres, some) if centres else np.full(samples, -1, np.int32)


def at_places(places: DataFrame, cluster: np.ndarray) -> DataFrame:
    """sample_id and cluster of (sample_id, place) that are in one."""
    held = places.sparkSession.sparkContext.broadcast(cluster)  # a number a sample

    @F.pandas_udf("int")
    def look(place: pd.Series) -> pd.Series:
        return pd.Series(held.value[place.to_numpy()])

    return places.select("sample_id", look("place").alias("cluster")).filter("cluster >= 0")

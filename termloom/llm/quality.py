"""Document quality by co-training two views.

The text view reads content: hashed words and word shapes.  The metadata view
reads what a crawl records of a page without its words: source, language,
length and layout.  Both start on labelled documents; in each round either
classifier labels the unlabelled documents it is surest of, and the other
learns from them.  Each view is then calibrated on labelled documents that no
round used, and a logistic combination of both scores every document.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.shingles import slices, word_spans

BUCKETS = 1 << 14
SHAPES = 256
META = 64
_GAP = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_KIND = np.zeros(256, dtype=np.int64)  # 0 punctuation, 1 lower case or other letter, 2 upper case, 3 digit
_KIND[97:123] = _KIND[128:] = 1
_KIND[65:91] = 2
_KIND[48:58] = 3


def _level(share: np.ndarray) -> np.ndarray:
    """Share 0..1 as one of 4 levels: none, some, much, all."""
    return np.where(share <= 0, 0, np.where(share < 0.34, 1, np.where(share < 1, 2, 3)))


def text_features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words (one row a word: bucket, shape) and words a text."""
    folded = [(t or "").encode().translate(_GAP) for t in texts]
    joined, begin, end, hashes, counts = word_spans(folded)
    kind = _KIND[np.frombuffer(joined, dtype=np.uint8)]
    part = lambda k: (lambda c: c[end] - c[begin])(np.concatenate([[0], np.cumsum(kind == k)]))
    size = np.maximum(end - begin, 1)
    shape = (_level(part(0) / size) * 4 + _level(part(2) / size)) * 4 + _level(part(3) / size)
    shape = shape * 2 + (size > 12)
    again = np.zeros(len(hashes), dtype=np.int64)  # the word before it in the text is the same
    if len(hashes) > 1:
        again[1:] = hashes[1:] == hashes[:-1]
        heads = (np.cumsum(counts) - counts)[counts > 0]
        again[heads] = 0
    shape = shape * 2 + again
    return np.stack([(hashes % np.uint64(BUCKETS)).astype(np.int64), BUCKETS + shape]), counts


def text_means(weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    """Mean weight of each text's words and shapes."""
    rows, counts = text_features(texts)
    each = weights[rows].sum(axis=0)
    total = np.concatenate([[0.0], np.cumsum(each)])
    ends = np.cumsum(counts)
    return (total[ends] - total[ends - counts]) / np.maximum(counts, 1)


def meta_features(texts: list[str | None], langs: list[str | None], sources: list[str | None]) -> np.ndarray:
    """One dense row a text: layout shares, length, hashed source and language."""
    import zlib

    out = np.zeros((len(texts), META))
    for i, (t, lang, source) in enumerate(zip(texts, langs, sources, strict=True)):
        raw = (t or "").encode()
        n = max(1, len(raw))
        kinds = np.bincount(_KIND[np.frombuffer(raw, dtype=np.uint8)], minlength=4) / n
        spaces, lines = (raw.count(b" ") + raw.count(b"\t")) / n, raw.count(b"\n") + 1
        out[i, :10] = (1.0, np.log1p(len(raw)) / 10, kinds[2], kinds[3], max(0.0, kinds[0] - spaces), spaces, np.log1p(lines) / 5, np.log1p(n / lines) / 8, float(kinds[0] - spaces > 0.1), float(kinds[2] > 0.2))
        out[i, 10 + zlib.crc32((lang or "").encode()) % 14] = 1.0
        out[i, 24 + zlib.crc32((source or "").encode()) % 40] = 1.0
    return out


def _fit(grad, size: int, steps: int, rate: float, decay: float) -> np.ndarray:
    """Adam on ``grad(w)``."""
    w, m, v = np.zeros(size), np.zeros(size), np.zeros(size)
    for t in range(1, steps + 1):
        g = grad(w) + decay * w
        m += 0.1 * (g - m)
        v += 0.01 * (g * g - v)
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return w


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def text_shares(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its distinct features and their share of its words."""
    rows, counts = text_features(texts)
    out, ends = [], np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), ends.tolist(), strict=True):
        which, n = np.unique(rows[:, a:b], return_counts=True)
        out.append((which.astype(np.int32), (n / max(1, b - a)).astype(np.float32)))
    return out


class _Text:
    """Mean-pooled linear text view over a sample."""

    def __init__(self, shares: list[tuple[np.ndarray, np.ndarray]]):
        self.n = len(shares)
        self.doc = np.repeat(np.arange(self.n), [len(x[0]) for x in shares])
        self.row, self.share = (np.concatenate([np.asarray(x[k], dtype=kind) for x in shares]) for k, kind in ((0, np.int64), (1, np.float64)))

    def logits(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.doc, w[self.row] * self.share, self.n) + w[-1]

    def fit(self, at: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        own = np.zeros(self.n, dtype=bool)
        own[at] = True
        use = own[self.doc]
        doc, row, share = self.doc[use], self.row[use], self.share[use]
        target, weight = np.zeros(self.n), np.zeros(self.n)
        target[at], weight[at] = y, c / c.sum()
        size = BUCKETS + SHAPES + 1

        def grad(w):
            z = np.bincount(doc, w[row] * share, self.n) + w[-1]
            r = (_sigmoid(z) - target) * weight
            g = np.bincount(row, r[doc] * share, size)
            g[-1] = r.sum()
            return g

        return _fit(grad, size, 80, 0.3, 1e-6)


class _Meta:
    def __init__(self, x: np.ndarray):
        self.x = x

    def logits(self, w: np.ndarray) -> np.ndarray:
        return self.x @ w

    def fit(self, at: np.ndarray, y: np.ndarray, c: np.ndarray) -> np.ndarray:
        x, weight = self.x[at], c / c.sum()
        return _fit(lambda w: ((_sigmoid(x @ w) - y) * weight) @ x, META, 250, 0.2, 1e-5)


def _line(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic regression of y on the columns of x and a constant."""
    x = np.column_stack([x, np.ones(len(x))])
    return _fit(lambda w: ((_sigmoid(x @ w) - y) / len(y)) @ x, x.shape[1], 400, 0.1, 1e-3)


class Model:
    """Two views, their calibrations and the combination."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, lines: list[np.ndarray], both: np.ndarray):
        self.text, self.meta, self.lines, self.both = text, meta, lines, both

    def score(self, texts, langs, sources) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(p_text, p_meta, score)."""
        a = text_means(self.text[:-1], texts) + self.text[-1]
        b = meta_features(texts, langs, sources) @ self.meta
        a, b = (z * w[0] + w[1] for z, w in zip((a, b), self.lines, strict=True))
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.both[0] * a + self.both[1] * b + self.both[2])


def cotrain(shares: list, meta: np.ndarray, label: np.ndarray, rounds: int = 4, grow: float = 0.1, sure: float = 0.95) -> Model | None:
    """Trains on ``text_shares`` and ``meta_features`` of a sample; ``label`` is
    1, 0 or -1 (none).  Every fifth labelled row calibrates."""
    known = np.flatnonzero(label >= 0)
    if len(np.unique(label[known])) < 2 or len(known) < 10:
        return None
    spare = np.zeros(len(label), dtype=bool)
    for k in (0, 1):
        spare[np.flatnonzero(label == k)[::5]] = True
    seed, free = known[~spare[known]], np.flatnonzero(label < 0)
    views = (_Text(shares), _Meta(meta))
    pseudo: list[dict[int, int]] = [{}, {}]  # for each view, what the other taught it
    ratio = label[seed].mean()
    weights = [None, None]
    for r in range(rounds + 1):
        for k, view in enumerate(views):
            at = np.concatenate([seed, np.array(list(pseudo[k]), dtype=np.int64)])
            y = np.concatenate([label[seed], np.array(list(pseudo[k].values()), dtype=np.int64)]).astype(float)
            c = np.concatenate([np.ones(len(seed)), np.full(len(pseudo[k]), 0.5)])
            weights[k] = view.fit(at, y, c)
        if r == rounds or not len(free):
            break
        most = int(grow * len(free)) + 1
        for k, view in enumerate(views):
            p = _sigmoid(view.logits(weights[k]))
            other = pseudo[1 - k]
            left = np.array([i for i in free if i not in other], dtype=np.int64)
            order = left[np.argsort(p[left], kind="stable")]
            low = [i for i in order[: max(1, int(most * (1 - ratio)))] if p[i] < 1 - sure]
            high = [i for i in order[::-1][: max(1, int(most * ratio))] if p[i] > sure]
            other.update({int(i): 0 for i in low} | {int(i): 1 for i in high})
    test, y = np.flatnonzero(spare), label[spare].astype(float)
    logits = [view.logits(w)[test] for view, w in zip(views, weights, strict=True)]
    lines = [_line(z[:, None], y) for z in logits]
    both = _line(np.column_stack([z * w[0] + w[1] for z, w in zip(logits, lines, strict=True)]), y)
    return Model(*weights, lines, both)


def train(docs: DataFrame, labels: DataFrame, labelled: int = 3000, unlabelled: int = 3000) -> Model | None:
    """Co-trains on the ``labelled`` labels and ``unlabelled`` documents of
    least id hash; those two numbers bound what comes to the driver."""
    spark = docs.sparkSession
    h = F.xxhash64("doc_id")
    marks = labels.filter(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(h, "doc_id").limit(labelled).collect()
    pool = docs.filter(F.col("doc_id").isNotNull()).select("doc_id").orderBy(h, "doc_id").limit(labelled + unlabelled).collect()
    label = {r["doc_id"]: int(r["quality"] >= 1) for r in marks}
    wanted = dict(label)
    for r in pool:
        if len(wanted) < len(label) + unlabelled:
            wanted.setdefault(r["doc_id"], -1)
    ids = spark.createDataFrame([(k, v) for k, v in sorted(wanted.items())], "doc_id long, y int")

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                texts, langs, sources = (rows.column(k).to_pylist() for k in (2, 3, 4))
                shares, meta = text_shares(texts), meta_features(texts, langs, sources)
                yield pa.RecordBatch.from_arrays(
                    [*(rows.column(k) for k in (0, 1)), *(pa.array([x[k].tobytes() for x in shares], pa.binary()) for k in (0, 1)), pa.array([x.tobytes() for x in meta], pa.binary())],
                    names=["doc_id", "y", "which", "share", "meta"],
                )

    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source").join(F.broadcast(ids), "doc_id")
    found = sample.select("doc_id", "y", "text", "lang", "source").mapInArrow(features, "doc_id long, y int, which binary, share binary, meta binary").collect()
    if not found:
        return None
    found.sort(key=lambda r: (r["doc_id"], bytes(r["which"])))
    shares = [(np.frombuffer(r["which"], dtype=np.int32), np.frombuffer(r["share"], dtype=np.float32)) for r in found]
    return cotrain(shares, np.stack([np.frombuffer(r["meta"]) for r in found]), np.array([r["y"] for r in found]))


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, labelled: int = 3000, unlabelled: int = 3000) -> DataFrame:
    """``docs`` with p_text, p_meta, quality_score and accepted.

    Each view's probability is calibrated; accepted means quality_score >=
    ``threshold``.  Null texts are empty, null lang or source are values of
    their own; without labels of both kinds everything is accepted with score
    1.  Rows that share a doc_id are scored each, alike if they are alike; an
    empty table gives no rows.  A text is read whole whatever its length, about
    a megabyte of texts (or one longer text) at a time.  Columns of ``docs``
    with the new names are replaced, others pass; no row moves.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StructField, StructType

    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, labelled, unlabelled))
    new = ["p_text", "p_meta", "quality_score", "accepted"]
    keep = [f for f in docs.schema if f.name not in new]

    def score(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch):
                column = lambda n: rows.column(rows.schema.get_field_index(n))  # noqa: E731, B023
                one = np.ones(rows.num_rows)
                p = (one, one, one) if model.value is None else model.value.score(column("text").to_pylist(), column("lang").to_pylist(), column("source").to_pylist())
                yield pa.RecordBatch.from_arrays([*(column(f.name) for f in keep), *(pa.array(x) for x in p), pa.array(p[2] >= threshold)], names=[*(f.name for f in keep), *new])

    schema = StructType([*keep, *(StructField(n, DoubleType()) for n in new[:3]), StructField("accepted", BooleanType())])
    return docs.select(*[f.name for f in keep]).mapInArrow(score, schema)

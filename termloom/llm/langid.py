"""Language identification with a bidirectional gated recurrent network.

The network reads the bytes of a segment (a word, or 24 bytes of a longer
one) in both directions, labels every position of it with a distribution over
languages, and a document's distribution is the mean over all its positions.
The state starts anew at every segment, and the white space between words has
no label.  It is trained in numpy by backpropagation through time.  A
segment's result depends on its bytes alone, so each distinct segment of a
batch is run once.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.shingles import slices, word_spans

LONGEST = 24
_GAP = bytes(32 if b == 32 or 9 <= b <= 13 else b for b in range(256))


def _cut(word: bytes) -> list[bytes]:
    return [word[i : i + LONGEST] for i in range(0, len(word), LONGEST)]


def _segments(text: str) -> list[bytes]:
    return [s for w in text.encode().translate(_GAP).split() for s in _cut(w)]


def _drawn(text: str, most: int) -> list[bytes]:
    """``most`` segments spread evenly over the whole text, all if it has fewer."""
    joined, begin, end, _, _ = word_spans([text.encode().translate(_GAP)])
    pieces = -(-(end - begin) // LONGEST)
    upto = np.cumsum(pieces)
    total = int(upto[-1]) if len(upto) else 0
    out = []
    for k in (np.arange(min(most, total)) * total // max(1, min(most, total))).tolist():
        w = int(np.searchsorted(upto, k, "right"))
        at = int(begin[w]) + (k - int(upto[w] - pieces[w])) * LONGEST
        out.append(joined[at : min(at + LONGEST, int(end[w]))])
    return out


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


class Network:
    def __init__(self, languages: list[str], hidden: int = 16, seed: int = 5):
        rng = np.random.RandomState(seed)
        self.languages, self.hidden = languages, hidden
        draw = lambda *s: (rng.randn(*s) * 0.3).astype(np.float32)
        self.p = {f"{n}{d}": x for d in "fb" for n, x in (("x", draw(256, 3 * hidden)), ("u", draw(hidden, 3 * hidden)), ("c", np.zeros(3 * hidden, dtype=np.float32)))}
        self.p |= {"o": draw(2 * hidden, len(languages)), "b": np.zeros(len(languages), dtype=np.float32)}

    def _run(self, x: np.ndarray, d: str, keep: bool):
        """States of one direction; x: segments by positions."""
        H, (wx, u, c) = self.hidden, (self.p[n + d] for n in "xuc")
        n, length = x.shape
        h = np.zeros((n, H), dtype=np.float32)
        states, saved = np.empty((length, n, H), dtype=np.float32), []
        for t in range(length) if d == "f" else range(length - 1, -1, -1):
            a = wx[x[:, t]] + c
            g = h @ u
            zr = _sigmoid(a[:, : 2 * H] + g[:, : 2 * H])
            z, r = zr[:, :H], zr[:, H:]
            k = np.tanh(a[:, 2 * H :] + r * g[:, 2 * H :])
            if keep:
                saved.append((t, h, z, r, k, g[:, 2 * H :]))
            h = k + z * (h - k)
            states[t] = h
        return states, saved

    def positions(self, x: np.ndarray, keep: bool = False):
        f, sf = self._run(x, "f", keep)
        b, sb = self._run(x, "b", keep)
        both = np.concatenate([f, b], axis=2)
        logit = both @ self.p["o"] + self.p["b"]
        logit -= logit.max(axis=2, keepdims=True)
        np.exp(logit, out=logit)
        logit /= logit.sum(axis=2, keepdims=True)
        return logit, (both, sf, sb)

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients."""
        H = self.hidden
        prob, (both, sf, sb) = self.positions(x, True)
        length, n, _ = prob.shape
        loss = -np.log(np.maximum(prob[:, np.arange(n), y], 1e-9)).mean()
        dlogit = prob.copy()
        dlogit[:, np.arange(n), y] -= 1
        dlogit /= length * n
        grads = {"o": np.einsum("tnh,tnl->hl", both, dlogit), "b": dlogit.sum(axis=(0, 1))}
        dboth = dlogit @ self.p["o"].T
        for d, saved, part in (("f", sf, dboth[:, :, :H]), ("b", sb, dboth[:, :, H:])):
            u = self.p["u" + d]
            dx, du, dh = np.zeros((256, 3 * H), dtype=np.float32), np.zeros_like(u), np.zeros((n, H), dtype=np.float32)
            for t, h, z, r, k, gk in reversed(saved):
                dh = dh + part[t]
                dk = dh * (1 - z) * (1 - k * k)
                dz = dh * (h - k) * z * (1 - z)
                dr = dk * gk * r * (1 - r)
                da = np.concatenate([dz, dr, dk], axis=1)
                dg = np.concatenate([dz, dr, dk * r], axis=1)
                np.add.at(dx, x[:, t], da)
                du += h.T @ dg
                dh = dh * z + dg @ u.T
            grads["x" + d], grads["u" + d], grads["c" + d] = dx, du, dx.sum(axis=0)
        return float(loss), grads

    def fit(self, segments: list[bytes], labels: np.ndarray, steps: int = 700, batch: int = 256, rate: float = 0.01, seed: int = 6) -> None:
        """Adam over batches of segments of one length."""
        rng = np.random.RandomState(seed)
        lengths = np.array([len(s) for s in segments])
        by = {n: np.flatnonzero(lengths == n) for n in np.unique(lengths)}
        names, weight = list(by), np.array([len(v) * n for n, v in by.items()], dtype=float)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v2 = {k: np.zeros_like(v) for k, v in self.p.items()}
        for step in range(1, steps + 1):
            n = names[rng.choice(len(names), p=weight / weight.sum())]
            at = by[n][rng.randint(0, len(by[n]), batch)]
            x = np.frombuffer(b"".join(segments[i] for i in at), dtype=np.uint8).reshape(batch, n)
            _, g = self.gradients(x, labels[at])
            lr = rate * min(1.0, 2 * (1 - (step - 1) / steps))
            for k, p in self.p.items():
                m[k] += 0.1 * (g[k] - m[k])
                v2[k] += 0.01 * (g[k] ** 2 - v2[k])
                p -= (lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v2[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)

    def pooled(self, segments: list[bytes], rows: int = 512) -> np.ndarray:
        """Sum over a segment's positions of their distributions."""
        out = np.zeros((len(segments), len(self.languages)), dtype=np.float32)
        lengths = np.fromiter(map(len, segments), dtype=np.int64, count=len(segments))
        for n in np.unique(lengths):
            own = np.flatnonzero(lengths == n)
            if n == 0:
                continue
            for k in range(0, len(own), rows):
                at = own[k : k + rows]
                x = np.frombuffer(b"".join([segments[i] for i in at.tolist()]), dtype=np.uint8).reshape(len(at), n)
                out[at] = self.positions(x)[0].sum(axis=0)
        return out

    def documents(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Mean distribution of each text, and whether it has a letter."""
        has = np.array([bool(t) and any(map(str.isalpha, t)) for t in texts])
        joined, begin, end, hashes, counts = word_spans([(t or "").encode().translate(_GAP) for t in texts])
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        size = (end - begin)[first]
        pieces = -(-size // LONGEST)
        segments = [s for a, b in zip(begin[first].tolist(), end[first].tolist(), strict=True) for s in _cut(joined[a:b])]
        out = np.zeros((len(texts), len(self.languages)))
        full = np.flatnonzero(counts)
        if len(full):
            sums = np.add.reduceat(self.pooled(segments), np.cumsum(pieces) - pieces, axis=0)
            start = (np.cumsum(counts) - counts)[full]
            total = np.add.reduceat(size[inverse].astype(np.float64), start)
            for k in range(len(self.languages)):
                out[full, k] = np.add.reduceat(sums[:, k].astype(np.float64)[inverse], start) / total
        return out, has


def sample(docs: DataFrame, sample_rows: int = 1200, sample_segments: int = 400) -> list[tuple[str, list[bytes]]]:
    """lang and segments of the labelled documents to train on: of each language
    as many distinct texts as an equal share of ``sample_rows`` allows (one at
    least), by least hash of the doc_id; never held-out ones.  A text gives
    ``sample_segments`` of its segments, spread over all of it.

    Hashes alone are ranked; the texts they name are cut where they lie, so
    what comes to the driver is bounded by the two numbers whatever the length
    of a text.
    """
    spark = docs.sparkSession
    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    usable = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.crc32(number) % 3 != 1))
    usable = usable.select("lang", "text", F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)).alias("h"), F.xxhash64("text").alias("t"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return []
    each = max(1, sample_rows // len(counts))

    def least(share: dict) -> list[tuple]:
        shares = spark.createDataFrame([(k, int(min(1.0, x) * 1_000_003) + 1) for k, x in share.items()], "lang string, most long")
        some = usable.join(F.broadcast(shares), "lang").filter("h < most").select("lang", "h", "t").distinct()
        some = some.withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy("h", "t")))
        return [(r["lang"], r["h"], r["t"]) for r in some.filter(F.col("rank") <= each).collect()]

    # Thinned to about twice the share, so that few rows are ranked; where ids or texts repeat that may be too few.
    rows = least({k: (2 * each + 50) / v for k, v in counts.items()})
    got = Counter(r[0] for r in rows)
    short = {k: 1.0 for k, v in counts.items() if got[k] < min(each, v)}
    if short:
        rows = [r for r in rows if r[0] not in short] + least(short)
    chosen = spark.createDataFrame(rows, "lang string, h long, t long")

    def draw(batches):
        import pyarrow as pa

        for batch in batches:
            for part in slices(batch):
                drawn = [_drawn(t, sample_segments) for t in part.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(drawn, pa.list_(pa.binary()))], names=["lang", "h", "t", "segments"])

    texts = usable.select("lang", "h", "t", "text").join(F.broadcast(chosen), ["lang", "h", "t"]).select("lang", "h", "t", "text")
    cut = texts.mapInArrow(draw, "lang string, h long, t long, segments array<binary>").groupBy("lang", "h", "t").agg(F.first("segments").alias("segments"))
    return [(r["lang"], [bytes(x) for x in r["segments"]]) for r in sorted(cut.collect(), key=lambda r: (r["h"], r["lang"], r["t"]))]


def train(docs: DataFrame, sample_rows: int = 1200, sample_segments: int = 400, seed: int = 5) -> Network | None:
    """Fits on ``sample``."""
    rows = sample(docs, sample_rows, sample_segments)
    if not rows:
        return None
    languages = sorted({lang for lang, _ in rows})
    place = {x: i for i, x in enumerate(languages)}
    segments = [s for _, own in rows for s in own]
    labels = np.repeat([place[lang] for lang, _ in rows], [len(own) for _, own in rows])
    net = Network(languages, seed=seed)
    if segments and len(languages) > 1:
        share = np.bincount(labels, minlength=len(languages))
        rng = np.random.RandomState(seed)
        at = np.concatenate([rng.choice(np.flatnonzero(labels == k), 20_000) for k in range(len(languages)) if share[k]])
        net.fit([segments[i] for i in at], labels[at])
    return net


def identify(docs: DataFrame, sample_rows: int = 1200, sample_segments: int = 400) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row.

    A text that is null or without letters is ``und`` with score 0; so is
    every text if no row has a label.  score is the document's mean
    probability of lang_pred.  A null doc_id counts as held in (crc32 of the
    empty text).  A text is read whole whatever its length, about a megabyte
    of texts (or one longer text) at a time.  Repeated rows are answered each,
    all alike; an empty table gives no rows; of equal probabilities the first
    language in the order of their names is taken.  Only doc_id, text and, for
    training, lang are read, so other columns never clash.
    """
    net = train(docs, sample_rows, sample_segments)
    held = docs.sparkSession.sparkContext.broadcast(net)  # a few ten thousand numbers

    def predict(batches):
        import pyarrow as pa

        model = held.value
        for batch in batches:
            for rows in slices(batch):
                n = rows.num_rows
                names, score = ["und"] * n, np.zeros(n)
                if model is not None:
                    prob, has = model.documents(rows.column(2).to_pylist())
                    best = prob.argmax(axis=1)
                    names = [model.languages[k] if ok else "und" for k, ok in zip(best, has, strict=True)]
                    score = np.where(has, np.clip(prob[np.arange(n), best], 0, 1), 0.0)
                yield pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    number = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.crc32(number) % 3 == 1).alias("held_out"), "text")
    return rows.mapInArrow(predict, "doc_id long, held_out boolean, lang_pred string, score double")

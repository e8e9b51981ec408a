"""Word shingles as 64-bit numbers, computed for many texts at once."""

from __future__ import annotations

import numpy as np

#: A-Z become lower case; space, tab and the line ends part words.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else 32 if b == 32 or 9 <= b <= 13 else b for b in range(256))
_RANDOM = np.random.RandomState(20240229)
_BYTE = (_RANDOM.randint(0, 1 << 32, 256, dtype=np.uint64) << np.uint64(32)) | _RANDOM.randint(0, 1 << 32, 256, dtype=np.uint64)
_BASE = 0x9E3779B97F4A7C15
_POSITION = (_RANDOM.randint(0, 1 << 32, 64, dtype=np.uint64) << np.uint64(32)) | _RANDOM.randint(0, 1 << 32, 64, dtype=np.uint64) | np.uint64(1)
_KEPT = 5 << 18  # of slices up to this many bytes the powers are kept, those of longer ones go
_POWERS: list[np.ndarray] = []


def _series(base: int, n: int) -> np.ndarray:
    x = np.full(n, base, dtype=np.uint64)
    x[0] = 1
    return np.multiply.accumulate(x, out=x)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """``n`` powers of the odd base and of its inverse, modulo 2**64."""
    inverse = pow(_BASE, -1, 1 << 64)
    if n > _KEPT:
        return _series(_BASE, n), _series(inverse, n)
    if not _POWERS:
        _POWERS.extend((_series(_BASE, _KEPT), _series(inverse, _KEPT)))
    return _POWERS[0][:n], _POWERS[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def fold(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


def slices(batch, size: int = 1 << 20):
    """Runs of a record batch's rows of about ``size`` bytes; a longer row is a run of its own."""
    import pyarrow.compute as pc

    each = np.zeros(batch.num_rows, dtype=np.int64)
    for column in batch.columns:
        kind = str(column.type)
        if kind in ("string", "binary", "large_string", "large_binary"):
            each += np.asarray(pc.fill_null(pc.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(each + 16)
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def word_spans(texts: list[bytes]) -> tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The joined texts, start, end and hash of each word in them, and the number of words in each text."""
    joined = b" " + b" ".join(texts) + b" "
    data = np.frombuffer(joined, dtype=np.uint8)
    gap = data == 32
    edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
    begin, end = edge[::2], edge[1::2]
    power, inverse = powers(len(data))
    total = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[data] * power, out=total[1:])
    words = mix((total[end] - total[begin]) * inverse[begin] + (end - begin).astype(np.uint64))
    lengths = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    return joined, begin, end, words, np.diff(np.searchsorted(begin, bounds + 1))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word of all texts, and the number of words in each text."""
    return word_spans(texts)[3:]


def shingle_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    """The sorted distinct shingles of ``n`` words of each folded text.

    A text of fewer words, but some, has its whole word sequence as its one
    shingle; a text without words has none.
    """
    out: list[np.ndarray] = []
    at = 0
    while at < len(texts):
        to, size = at, 0
        while to < len(texts) and (to == at or size + len(texts[to]) < 1 << 20):
            size += len(texts[to]) + 1
            to += 1
        words, counts = word_hashes(texts[at:to])
        rows = max(0, len(words) - n + 1)
        h = np.zeros(rows, dtype=np.uint64)
        for k in range(n):
            h += words[k : k + rows] * _POSITION[k]
        h = mix(h)
        first = np.concatenate([[0], np.cumsum(counts)])
        for i, c in enumerate(counts.tolist()):
            a = first[i]
            if c >= n:
                own = np.sort(h[a : a + c - n + 1])
                if len(own) > 1:
                    keep = np.empty(len(own), dtype=bool)
                    keep[0] = True
                    np.not_equal(own[1:], own[:-1], out=keep[1:])
                    own = own[keep]
            elif c:
                own = mix(np.array([int((words[a : a + c] * _POSITION[:c]).sum(dtype=np.uint64)) ^ (c << 56)], dtype=np.uint64))
            else:
                own = np.zeros(0, dtype=np.uint64)
            out.append(own)
        at = to
    return out


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * |a & b| >= percent * |a | b| for sorted distinct sets."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)

"""Benchmark decontamination by Wu-Manber search over words.

A test string is a window of ``width`` consecutive words of a benchmark item
(a shorter item is one window).  Words become numbers, 0 for any word that no
item has.  For the strings of one length a shift table over blocks of words
says how far a search may jump; a zero shift selects the bucket of strings
whose last block hashes alike, and a direct comparison confirms each.  The
search runs in many lanes at once, so each step is a few vector operations.
Words of texts and items are known by 64-bit hashes.  A large benchmark is
searched block by block: the tables of a block are a file in the shared folder,
and a worker holds those of one block at a time.
"""

from __future__ import annotations

import pickle

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import work_path
from termloom.llm.shingles import slices, word_hashes

WINDOW = 8
_TABLE = 1 << 20
_MULTIPLY = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint64)
#: A-Z become lower case; digits, a-z and bytes of other characters stay.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def fold(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


def _block(ids: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    h = np.zeros(len(ends), dtype=np.uint64)
    for k in range(size):
        h += (ids[ends - k].astype(np.uint64) + np.uint64(1)) * _MULTIPLY[k]
    return ((h ^ (h >> np.uint64(23))) & np.uint64(_TABLE - 1)).astype(np.int64)


class Strings:
    """Shift table, suffix buckets and test strings of one length."""

    def __init__(self, rows: np.ndarray):
        self.length = rows.shape[1]
        self.size = min(3, self.length)
        flat, n = rows.reshape(-1), len(rows)
        self.shift = np.full(_TABLE, self.length - self.size + 1, dtype=np.int8)
        for end in range(self.size - 1, self.length):
            at = _block(flat, np.arange(n) * self.length + end, self.size)
            np.minimum.at(self.shift, at, np.int8(self.length - 1 - end))
        last = _block(flat, np.arange(n) * self.length + self.length - 1, self.size)
        order = np.argsort(last, kind="stable")
        self.keys, self.order, self.rows = last[order], order, rows

    def search(self, ids: np.ndarray, lane: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """(end positions, string numbers) of every occurrence in ``ids``."""
        n = len(ids)
        if n < self.length:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        pos = np.arange(0, n, lane)
        stop = np.minimum(pos + lane, n)
        pos[0] = 0
        pos = np.maximum(pos, self.length - 1)
        found = []
        while True:
            live = pos < stop
            if not live.all():
                pos, stop = pos[live], stop[live]
            if not len(pos):
                break
            jump = self.shift[_block(ids, pos, self.size)]
            if (zero := pos[jump == 0]).size:
                found.append(zero)
            pos = pos + np.maximum(jump, 1)
        if not found:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        ends = np.concatenate(found)
        key = _block(ids, ends, self.size)
        lo, hi = np.searchsorted(self.keys, key, "left"), np.searchsorted(self.keys, key, "right")
        out_e, out_s = [], []
        for at in range(0, len(ends), 65536):
            a, b, e = lo[at : at + 65536], hi[at : at + 65536], ends[at : at + 65536]
            size = b - a
            which = np.repeat(np.arange(len(e)), size)
            string = self.order[np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())]
            for k in range(self.length):  # compared word by word, survivors only
                keep = ids[e[which] - k] == self.rows[string, self.length - 1 - k]
                which, string = which[keep], string[keep]
            out_e.append(e[which])
            out_s.append(string)
        return np.concatenate(out_e), np.concatenate(out_s)


class Index:
    """Test strings of a block of benchmark items (name, text), as arrays."""

    def __init__(self, items: list[tuple[str, str | None]], width: int = WINDOW):
        self.width = width
        self.names = sorted({name for name, _ in items})
        place = {x: i for i, x in enumerate(self.names)}
        hashes, counts = word_hashes([fold(t) for _, t in items])
        self.known, ids = np.unique(hashes, return_inverse=True)
        ids = ids.astype(np.int32) + 1  # 0 is any word that no item has
        owner, first = np.array([place[name] for name, _ in items], dtype=np.int64), np.cumsum(counts) - counts
        self.groups = []  # of each length: strings, and their items as (bounds, item numbers)
        for length in sorted(set(np.minimum(counts, width).tolist()) - {0}):
            own = np.flatnonzero(np.minimum(counts, width) == length)
            n = counts[own] - length + 1
            starts = np.repeat(first[own] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            rows, which = np.unique(ids[starts[:, None] + np.arange(length)], axis=0, return_inverse=True)
            pairs = np.unique(which.reshape(-1) * len(self.names) + np.repeat(owner[own], n))
            bounds = np.searchsorted(pairs, np.arange(len(rows) + 1) * len(self.names))
            self.groups.append((Strings(rows), bounds, (pairs % len(self.names)).astype(np.int32)))

    def scan(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each folded text, hit words as (text, position), occurring
        items as (text, item number), and whether a window of the whole width
        occurs in each text."""
        hashes, counts = word_hashes(texts)
        at = np.minimum(np.searchsorted(self.known, hashes), max(0, len(self.known) - 1))
        starts = np.concatenate([[0], np.cumsum(counts + 1)])  # a 0 after each text keeps strings inside it
        ids = np.zeros(starts[-1], dtype=np.int32)
        if len(self.known):
            ids[np.arange(len(hashes)) + np.repeat(np.arange(len(counts)), counts)] = np.where(self.known[at] == hashes, at + 1, 0)
        mark = np.zeros(len(ids) + 1, dtype=np.int32)
        full, items = np.zeros(len(texts), dtype=bool), [np.zeros(0, dtype=np.int64)]
        for strings, bounds, owners in self.groups:
            ends, which = strings.search(ids)
            np.add.at(mark, ends - strings.length + 1, 1)
            np.add.at(mark, ends + 1, -1)
            text = np.searchsorted(starts, ends, "right") - 1
            if strings.length == self.width:
                full[text] = True
            pairs = np.unique(text * len(bounds) + which)  # each string once a text
            text, which = pairs // len(bounds), pairs % len(bounds)
            n = bounds[which + 1] - bounds[which]
            owner = owners[np.repeat(bounds[which] - (np.cumsum(n) - n), n) + np.arange(n.sum())]
            items.append(np.repeat(text, n) * len(self.names) + owner)
        hit = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
        text = np.searchsorted(starts, hit, "right") - 1
        pairs = np.unique(np.concatenate(items))
        own = np.stack([pairs // max(1, len(self.names)), pairs % max(1, len(self.names))])
        return counts, np.stack([text, hit - starts[text]]), own, full


def benchmark_blocks(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = 4 << 20):
    """The benchmark's items in blocks of at most about ``block_bytes`` of text
    (an item is never cut); rows come to the driver one partition at a time."""
    items, held = [], 0
    for r in benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("i"), "text").toLocalIterator():
        items.append((r["i"], r["text"]))
        held += len(r["text"] or "") + 16
        if held >= block_bytes:
            yield Index(items, width)
            items, held = [], 0
    if items:
        yield Index(items, width)


def write_index(benchmark: DataFrame, width: int = WINDOW, block_bytes: int = 4 << 20) -> tuple[str, int]:
    """Writes each block's tables to the shared folder; the folder and their number."""
    from pyarrow import fs

    folder, n = work_path(benchmark.sparkSession, "test-strings"), 0
    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    for n, index in enumerate(benchmark_blocks(benchmark, width, block_bytes), 1):  # noqa: B007
        with store.open_output_stream(f"{root}/{n - 1}") as out:
            out.write(pickle.dumps(index))
    return folder, n


_LAST: dict[str, Index] = {}


def _index(path: str) -> Index:
    """A block's tables; a worker keeps the last it read."""
    if path not in _LAST:
        from pyarrow import fs

        _LAST.clear()
        store, root = fs.FileSystem.from_uri(path)
        with store.open_input_file(root) as f:
            _LAST[path] = pickle.loads(f.read())
    return _LAST[path]


def scan_texts(texts: list[bytes], blocks: list[str]) -> tuple[np.ndarray, np.ndarray, list[list[str]], np.ndarray]:
    """Words, hit words, sorted items and whether a whole window occurs, of
    each folded text over all blocks, which are read one after another."""
    n = len(texts)
    counts, full, items = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=bool), [set() for _ in texts]
    hits = [np.zeros((2, 0), dtype=np.int64)]
    size = np.cumsum([len(t) + 1 for t in texts])
    runs = np.searchsorted(size, np.arange(1, size[-1] // (1 << 20) + 1) << 20, "right") if n else []
    runs = np.unique([0, *runs, n])
    if not blocks:
        counts = word_hashes(texts)[1]
    for path in blocks:
        index = _index(path)
        for a, b in zip(runs[:-1], runs[1:], strict=True):
            counts[a:b], hit, own, whole = index.scan(texts[a:b])
            full[a:b] |= whole
            hits.append(hit + [[a], [0]])
            for text, item in zip(*own.tolist(), strict=True):
                items[a + text].add(index.names[item])
    hit = np.concatenate(hits, axis=1)
    if len(blocks) > 1:
        hit = np.unique(hit, axis=1)
    return counts, np.bincount(hit[0], minlength=n), [sorted(x) for x in items], full


def contamination(docs: DataFrame, benchmark: DataFrame, min_items: int = 2, width: int = WINDOW, full_suffices: bool = False, block_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with n_words, n_hit, items and contaminated, no row moved.

    items are the sorted ids of benchmark items of which a window occurs;
    contaminated means ``min_items`` of them or more or, if ``full_suffices``, one
    of ``width`` words or more.  Null or wordless texts
    have no words and no hits; null or wordless items never occur; rows of one
    item_id are one item, a null item_id is the item "";  without any item
    nothing is contaminated.  Repeated rows are answered each; an empty table
    gives no rows.  A text is searched whole whatever its length, about a
    megabyte of texts (or one longer text) at a time; of a benchmark of several
    blocks a worker holds one block's tables, and each batch of rows meets block
    after block.  Columns of ``docs`` that have the new names are replaced.
    """
    folder, n_blocks = write_index(benchmark, width, block_bytes)
    blocks = [f"{folder}/{k}" for k in range(n_blocks)]
    new = ["n_words", "n_hit", "items", "contaminated"]
    keep = [f for f in docs.schema if f.name not in new]

    def scan(batches):
        import pyarrow as pa

        for batch in batches:
            for rows in slices(batch, (1 if len(blocks) < 2 else 16) << 20):  # several blocks are read again for each run
                n_words, n_hit, items, full = scan_texts([fold(t) for t in rows.column(rows.schema.get_field_index("text")).to_pylist()], blocks)
                columns = [rows.column(rows.schema.get_field_index(f.name)) for f in keep]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array([len(x) >= min_items or bool(full_suffices and f) for x, f in zip(items, full, strict=True)], pa.bool_())],
                    names=[*(f.name for f in keep), *new],
                )

    from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

    schema = StructType([*keep, StructField("n_words", LongType()), StructField("n_hit", LongType()), StructField("items", ArrayType(StringType())), StructField("contaminated", BooleanType())])
    return docs.select(*[f.name for f in keep]).mapInArrow(scan, schema)


def contamination_digest(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    out = contamination(docs.select("doc_id", "text"), benchmark)
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), "contaminated")

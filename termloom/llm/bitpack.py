"""Token-id files with a fixed number of bits for each id.

File layout, little-endian::

    magic 'TLBP' | u16 version | u16 bits | u64 n_docs | u64 n_ids
    u32 block_ids | u32 n_blocks
    u64 block_offset[n_blocks + 1]      bytes from the payload's start
    u64 doc_start[n_docs + 1]           ids from the file's start
    i64 doc_id[n_docs] | u8 doc_id_valid[n_docs]
    payload: blocks of u64 words

An id takes the least number of bits that hold the vocabulary.  Every block
but the last has ``block_ids`` ids (a multiple of 64); 64 ids fill exactly
``bits`` words, so packing and unpacking are 64 vector operations for a whole
block run, and any id range is read from the blocks that hold it alone.
"""

from __future__ import annotations

import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from termloom.llm.common import shuffle_partitions, work_path
from termloom.llm.shingles import slices
from termloom.llm.tokens import encoder, vocabulary_path

_HEAD = struct.Struct("<4sHHQQII")
BLOCK_IDS = 8192
_PLAIN = {8: "<u1", 16: "<u2", 32: "<u4"}


def id_bits(vocabulary: int) -> int:
    return max(1, int(vocabulary - 1).bit_length())


def pack_ids(ids: np.ndarray, bits: int) -> np.ndarray:
    """uint64 words; ids are padded with zeros to a multiple of 64."""
    if bits in _PLAIN:  # the same layout as an array of that type
        out = np.zeros(-(-len(ids) // 64) * 64, dtype=_PLAIN[bits])
        out[: len(ids)] = ids
        return out.view("<u8")
    lanes = np.zeros((-(-len(ids) // 64), 64), dtype=np.uint64)
    lanes.reshape(-1)[: len(ids)] = ids
    out = np.zeros((len(lanes), bits), dtype=np.uint64)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        out[:, word] |= lanes[:, j] << np.uint64(off)
        if off + bits > 64:
            out[:, word + 1] |= lanes[:, j] >> np.uint64(64 - off)
    return out.reshape(-1)


def unpack_ids(words: np.ndarray, bits: int, n: int) -> np.ndarray:
    if bits in _PLAIN:
        return words.view(_PLAIN[bits])[:n].astype(np.uint32)
    rows = words.reshape(-1, bits)
    out = np.empty((len(rows), 64), dtype=np.uint32)
    mask = np.uint64((1 << bits) - 1)
    for j in range(64):
        word, off = divmod(j * bits, 64)
        x = rows[:, word] >> np.uint64(off)
        if off + bits > 64:
            x = x | (rows[:, word + 1] << np.uint64(64 - off))
        out[:, j] = x & mask
    return out.reshape(-1)[:n]


def write_file(ids: np.ndarray, lengths: np.ndarray, doc_ids: list[int | None], bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id needs more bits")
    n_blocks = -(-len(ids) // block_ids)
    words = pack_ids(ids, bits)
    offsets = np.minimum(np.arange(n_blocks + 1, dtype=np.uint64) * np.uint64(block_ids // 64 * bits * 8), np.uint64(words.nbytes))
    starts = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8")
    known = np.array([x is not None for x in doc_ids], dtype=np.uint8)
    values = np.array([x or 0 for x in doc_ids], dtype="<i8")
    return b"".join([_HEAD.pack(b"TLBP", 1, bits, len(doc_ids), len(ids), block_ids, n_blocks), offsets.astype("<u8").tobytes(), starts.tobytes(), values.tobytes(), known.tobytes(), words.astype("<u8").tobytes()])


class PackedFile:
    """Random access to the bytes of one file."""

    def __init__(self, content: bytes):
        magic, version, self.bits, self.n_docs, self.n_ids, self.block_ids, self.n_blocks = _HEAD.unpack_from(content)
        if magic != b"TLBP" or version != 1:
            raise ValueError("not a packed id file")
        at = _HEAD.size
        self.offsets = np.frombuffer(content, "<u8", self.n_blocks + 1, at)
        at += self.offsets.nbytes
        self.starts = np.frombuffer(content, "<u8", self.n_docs + 1, at).astype(np.int64)
        at += 8 * (self.n_docs + 1)
        values = np.frombuffer(content, "<i8", self.n_docs, at)
        at += values.nbytes
        known = np.frombuffer(content, np.uint8, self.n_docs, at)
        self.doc_ids = [int(v) if k else None for v, k in zip(values, known, strict=True)]
        self.payload, self.content = at + known.nbytes, content

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids start..stop, from the blocks that hold them alone."""
        if stop <= start:
            return np.zeros(0, dtype=np.uint32)
        first, last = start // self.block_ids, (stop - 1) // self.block_ids + 1
        a, b = int(self.offsets[first]), int(self.offsets[last])
        words = np.frombuffer(self.content, "<u8", (b - a) // 8, self.payload + a)
        base = first * self.block_ids
        return unpack_ids(words, self.bits, stop - base)[start - base :]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.starts[i]), int(self.starts[i + 1]))


def _store(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def write_token_files(docs: DataFrame, end_id: int = 2, path: str | None = None, vocabulary: str | None = None, file_ids: int = 4_000_000) -> str:
    """Encodes every text, appends ``end_id`` and writes packed files; returns the folder.

    Files follow ascending (doc_id, hash of the text): file ``(part, seq)``
    comes before the next.  Null doc_ids come first, null texts are empty,
    repeated rows are written as often as they come, an empty table writes no
    file.  Only doc_id and text are read, so other columns never clash.  A text
    is encoded whole whatever its length.  A task holds the ids of one file at
    a time, ``file_ids`` and those of about a megabyte of texts (or of one
    longer text) at most; a repeated task replaces its files by the same bytes.
    Beside the files lies a manifest, a table of (part, seq, n_docs, n_ids).
    """
    spark = docs.sparkSession
    folder = (path or work_path(spark, "token-files")).rstrip("/")
    tokenizer = vocabulary or vocabulary_path()

    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext

        part, enc = TaskContext.get().partitionId(), encoder(tokenizer)
        bits = id_bits(max(enc.size, end_id + 1))
        ids, lengths, names, held, seq = [], [], [], 0, 0

        def flush():
            store, root = _store(f"{folder}/files")
            store.create_dir(root, recursive=True)
            body = write_file(np.concatenate(ids), np.concatenate(lengths), names, bits)
            name = f"{root}/ids-{part:06d}-{seq:05d}.bin"
            with store.open_output_stream(temporary := f"{name}.{uuid.uuid4().hex}.tmp") as out:
                out.write(body)
            store.move(temporary, name)
            return pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "seq": pa.array([seq], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_ids": pa.array([held], pa.int64())})

        for batch in batches:
            for rows in slices(batch):
                raw, n = enc.encode_many(rows.column(1).to_pylist())
                ends = np.cumsum(n)
                ids.append(np.insert(raw, ends, end_id).astype(np.uint32))
                lengths.append(n + 1)
                names += rows.column(0).to_pylist()
                held += len(ids[-1])
                if held >= file_ids:
                    yield flush()
                    ids, lengths, names, held, seq = [], [], [], 0, seq + 1
        if names:
            yield flush()

    order = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    ordered.mapInArrow(write, "part int, seq int, n_docs long, n_ids long").write.parquet(f"{folder}/manifest")
    return folder


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """part, seq, n_docs, n_ids and start (ids of all files before it) of every file."""
    files = spark.read.schema("part int, seq int, n_docs long, n_ids long").parquet(f"{folder}/manifest")
    before = lambda w: F.coalesce(F.sum("n_ids").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    parts = files.groupBy("part").agg(F.sum("n_ids").alias("n_ids"))  # a row for each writing task
    parts = parts.select("part", before(W.orderBy("part")).alias("base"))
    return files.join(parts, "part").select("part", "seq", "n_docs", "n_ids", (F.col("base") + before(W.partitionBy("part").orderBy("seq"))).alias("start"))


def read_token_files(spark: SparkSession, folder: str, docs_step: int = 2000) -> DataFrame:
    """doc_id, start, n_tokens, ids (little-endian u32 bytes) of every document.

    Tasks are dealt files by the manifest, one file is held at a time, and its
    ids are unpacked for about a million ids or ``docs_step`` documents (or one
    longer document) at a time."""

    def read(batches):
        import pyarrow as pa

        store, root = _store(f"{folder}/files")
        for batch in batches:
            for part, seq, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with store.open_input_file(f"{root}/ids-{part:06d}-{seq:05d}.bin") as f:
                    packed = PackedFile(f.read())
                at = 0
                while at < packed.n_docs:
                    first = int(packed.starts[at])
                    to = min(packed.n_docs, at + docs_step, max(at + 1, int(np.searchsorted(packed.starts, first + 1_000_000, "right")) - 1))
                    view = packed.ids(first, int(packed.starts[to])).astype("<u4").view(np.uint8).data
                    s = packed.starts[at : to + 1]
                    yield pa.RecordBatch.from_pydict(
                        {
                            "doc_id": pa.array(packed.doc_ids[at:to], pa.int64()),
                            "start": pa.array(start + s[:-1], pa.int64()),
                            "n_tokens": pa.array(np.diff(s), pa.int64()),
                            "ids": pa.LargeBinaryArray.from_buffers(pa.large_binary(), to - at, [None, pa.py_buffer(4 * (s - first)), pa.py_buffer(view)]).cast(pa.binary()),
                        }
                    )
                    at = to

    files = manifest(spark, folder).select("part", "seq", "start").repartition(shuffle_partitions(spark), "part", "seq")
    return files.mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def token_file_digest(docs: DataFrame, end_id: int = 2, vocabulary: str | None = None) -> DataFrame:
    """Writes the files, reads them back: doc_id, start, n_tokens, ids_crc32."""
    folder = write_token_files(docs, end_id, vocabulary=vocabulary)
    return read_token_files(docs.sparkSession, folder).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))

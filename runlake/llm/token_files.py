"""Operator 10: token ids as fixed-width bit-packed files.

Every text is encoded, closed with an end id, and written in ascending document
order. A file stores each id in the fewest bits that hold the vocabulary:

    "BITIDS01" | packed blocks of BLOCK ids, each starting on a byte |
    byte offset of each block (u64) | first id of each document, and the end (u64) |
    document ids (i64) | 1 byte per document, 0 for a null id |
    footer: bits, blocks, documents, ids (4 x u64)

A block's offset leads straight to any id, and blocks unpack with numpy alone.
Documents are dealt by ranges of their id, so tasks hold neighbouring documents
and files follow one another without a global sort in one task.

Edge cases: a null or empty text is one end id; a null document id sorts first;
rows that repeat a document id are all written, ordered by text; an empty table
gives no files and no rows; columns other than the two named are not read.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm import store
from runlake.llm.common import slices, stored
from runlake.llm.tokens import encoder
from runlake.session import ensure_checkpoint_dir, scratch_path

MAGIC = b"BITIDS01"
BLOCK = 4096
FILE_BYTES = 16 << 20
MANIFEST = "path string, part int, seq int, n_docs bigint, n_ids bigint, n_bytes bigint"


def pack(ids: np.ndarray, bits: int) -> bytes:
    """Most significant bit first, padded to a whole byte."""
    if bits == 8:
        return ids.astype(np.uint8).tobytes()
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits((ids.astype(np.uint32)[:, None] >> shifts) & 1).tobytes()


def unpack(data: bytes, bits: int, n: int) -> np.ndarray:
    if bits == 8:
        return np.frombuffer(data, np.uint8, n).astype(np.uint32)
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(data, np.uint8), count=n * bits).reshape(n, bits)
    return flags @ (np.uint32(1) << np.arange(bits - 1, -1, -1, dtype=np.uint32))


def file_parts(ids: np.ndarray, bounds: np.ndarray, docs: list[int | None], bits: int) -> list[bytes]:
    blocks = [pack(ids[i:i + BLOCK], bits) for i in range(0, len(ids), BLOCK)]
    offsets = len(MAGIC) + np.concatenate([[0], np.cumsum([len(b) for b in blocks])])[:len(blocks)]
    return [MAGIC, *blocks, offsets.astype("<u8").tobytes(), bounds.astype("<u8").tobytes(),
            np.array([d or 0 for d in docs], "<i8").tobytes(), bytes(d is not None for d in docs),
            np.array([bits, len(blocks), len(docs), len(ids)], "<u8").tobytes()]


class TokenFile:
    """Random access to one file's documents and ids."""

    def __init__(self, uri: str):
        fs, path = store.opened(uri)
        self.uri, size = uri, fs.get_file_info(path).size
        self.bits, blocks, self.n_docs, self.n_ids = (int(x) for x in np.frombuffer(store.get(uri, size - 32), "<u8"))
        tail = 8 * blocks + 8 * (self.n_docs + 1) + 9 * self.n_docs
        self.end = size - 32 - tail
        index = store.get(uri, self.end, tail)
        self.offsets = np.frombuffer(index, "<u8", blocks).astype(np.int64)
        self.bounds = np.frombuffer(index, "<u8", self.n_docs + 1, 8 * blocks).astype(np.int64)
        at = 8 * blocks + 8 * (self.n_docs + 1)
        self.docs = np.frombuffer(index, "<i8", self.n_docs, at)
        self.known = np.frombuffer(index, np.uint8, self.n_docs, at + 8 * self.n_docs) > 0

    def ids(self, start: int, stop: int) -> np.ndarray:
        """Ids [start, stop): one read of the blocks that hold them."""
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, last = start // BLOCK, (stop - 1) // BLOCK
        begin = self.offsets[first]
        data = store.get(self.uri, int(begin), int((self.offsets[last + 1] if last + 1 < len(self.offsets) else self.end) - begin))
        if BLOCK * self.bits % 8 == 0:
            out = unpack(data, self.bits, min(self.n_ids, (last + 1) * BLOCK) - first * BLOCK)
        else:
            raise ValueError("blocks must fill whole bytes")
        return out[start - first * BLOCK:stop - first * BLOCK]

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.bounds[i]), int(self.bounds[i + 1]))


def write_token_files(docs: DataFrame, folder: str, tokenizer: str, end_id: int,
                      id_col: str = "doc_id", text_col: str = "text", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the files below ``folder``; returns the stored list of files."""

    def write(batches):
        coder, task = encoder(tokenizer), TaskContext.get()
        bits = max(coder.bits, end_id.bit_length())
        held: list[np.ndarray] = []
        ends: list[np.ndarray] = []
        names: list[int | None] = []
        n, seq = 0, 0

        def close():
            nonlocal held, ends, names, n, seq
            path = f"{folder}/ids-{task.partitionId():06d}-{seq:05d}.bin"
            size = store.put(path, file_parts(np.concatenate(held), np.concatenate([np.zeros(1, np.int64), *ends]), names, bits),
                             f"{task.taskAttemptId()}")
            row = pa.RecordBatch.from_pylist(
                [{"path": path, "part": task.partitionId(), "seq": seq, "n_docs": len(names), "n_ids": n, "n_bytes": size}],
                pa.schema([("path", pa.string()), ("part", pa.int32()), ("seq", pa.int32()), ("n_docs", pa.int64()),
                           ("n_ids", pa.int64()), ("n_bytes", pa.int64())]))
            held, ends, names, n, seq = [], [], [], 0, seq + 1
            return row

        for batch in slices(batches, "text", 12 << 20):
            ids, at = coder.encode(batch.column(1))
            m = batch.num_rows
            full = np.insert(ids, at[1:], np.uint32(end_id))
            held.append(full)
            ends.append(n + at[1:] + np.arange(1, m + 1))
            names += batch.column(0).to_pylist()
            n += len(full)
            if n * bits >= 8 * file_bytes:
                yield close()
        if names:
            yield close()

    rows = (docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
            .repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text"))
    return stored(rows.mapInArrow(write, MANIFEST), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row per document from the files: doc_id, start (ids of all documents
    before it), n_tokens, ids_crc32, and where its ids lie (path, file_start)."""
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()),
                     ("ids_crc32", pa.int64()), ("path", pa.string()), ("file_start", pa.int64())])

    def read(batches):
        for batch in batches:
            for path, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                f = TokenFile(path)
                for lo in range(0, f.n_docs, 20_000):
                    hi = min(f.n_docs, lo + 20_000)
                    b = f.bounds[lo:hi + 1]
                    data = memoryview(f.ids(int(b[0]), int(b[-1])).astype("<u4")).cast("B")
                    crc = [zlib.crc32(data[4 * (s - b[0]):4 * (e - b[0])]) for s, e in zip(b[:-1], b[1:])]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(f.docs[lo:hi], mask=~f.known[lo:hi]), pa.array(b[:-1] + base), pa.array(np.diff(b)),
                         pa.array(crc, pa.int64()), pa.array([path] * (hi - lo)), pa.array(b[:-1])], schema=out)

    # one row per file: the running sum's single task sees the list of files only
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    placed = files.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).cast("long").alias("base"))
    return (placed.repartition("path")
            .mapInArrow(read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint, path string, file_start bigint"))


def token_files(docs: DataFrame, tokenizer: str = "word_bpe_49k.json", end_id: int = 1,
                folder: str | None = None) -> DataFrame:
    """Write and read back; ``folder`` defaults to a new one in the shared folder."""
    spark = docs.sparkSession
    ensure_checkpoint_dir(spark)
    folder = folder or scratch_path(spark, f"ids-{uuid.uuid4().hex[:8]}")
    return read_token_files(write_token_files(docs, folder, tokenizer, end_id))

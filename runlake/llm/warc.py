"""Operator 6: WARC files and a Merkle fixity audit of their replicas.

``write_warc`` writes records as WARC/1.1 files (each record a gzip member of its own)
in ranges of their id and returns the index of their byte ranges; ``copy_files`` makes a
replica and ``read_records`` parses files back. ``record_table`` hashes each indexed
range of a replica. ``merkle_levels`` hashes each file's records, in order of offset,
into a tree of ``fanout`` children a node; ``audit`` compares the replicas' roots and
descends only below nodes that differ, a join per level on the few that are left, down
to the damaged records.

Edge cases: null url or payload is written as empty; repeated ids are separate
records; a file that one replica lacks, or that ends early, shows as records missing
on that side; a very long record is written whole (a file exceeds its size by one record at
most); empty tables give no files, no rows; other columns are not read.
"""

from __future__ import annotations

import gzip
import hashlib
from itertools import accumulate

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.llm import store
from runlake.llm.common import slices, stored
from runlake.session import ensure_checkpoint_dir, scratch_path

FANOUT = 16
FILE_BYTES = 8 << 20
INDEX = "file string, nth bigint, offset bigint, length bigint, record_id string"
RECORDS = f"{INDEX}, sha256 string"


def record(record_id: str, url: str, payload: bytes) -> bytes:
    head = (f"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:{record_id}>\r\n"
            f"WARC-Target-URI: {url}\r\nContent-Type: text/html\r\nContent-Length: {len(payload)}\r\n\r\n")
    return head.encode() + payload + b"\r\n\r\n"


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of one record's gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    named = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    return named, rest[:int(named["Content-Length"])]


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
               file_bytes: int = FILE_BYTES) -> DataFrame:
    """Files in ascending id order; returns the stored index, one row per record."""

    def write(batches):
        task, held, names, size, n = TaskContext.get(), [], [], 0, 0

        def close():
            nonlocal held, names, size, n
            name = f"pages-{task.partitionId():06d}-{n:05d}.warc.gz"
            store.put(f"{folder}/{name}", held, str(task.taskAttemptId()))
            length = [len(h) for h in held]
            offset = [0, *accumulate(length)][:-1]
            row = pa.RecordBatch.from_arrays(
                [pa.array([name] * len(held)), pa.array(range(len(held)), pa.int64()), pa.array(offset, pa.int64()),
                 pa.array(length, pa.int64()), pa.array(names)], ["file", "nth", "offset", "length", "record_id"])
            held, names, size, n = [], [], 0, n + 1
            return row

        for batch in slices(batches, "text"):
            for key, url, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                clean = " ".join((url or "").splitlines())
                held.append(gzip.compress(record(str(key), clean, (text or "").encode()), 1, mtime=0))
                names.append(str(key))
                size += len(held[-1])
                if size >= file_bytes:
                    yield close()
        if held:
            yield close()

    rows = (pages.select(pages[id_col].alias("id"), pages[url_col].alias("url"), pages[body_col].alias("text"))
            .repartitionByRange("id").sortWithinPartitions("id", "url", "text"))
    return stored(rows.mapInArrow(write, INDEX), "warc-index")


def _files(index: DataFrame) -> DataFrame:
    """A row per file with its records in order; a file is bounded by ``file_bytes`` and one record."""
    return index.groupBy("file").agg(F.sort_array(F.collect_list(F.struct("nth", "offset", "length", "record_id"))).alias("records"))


def copy_files(index: DataFrame, source: str, target: str, damage=None) -> int:
    """Copy the indexed files and return how many; ``damage(record id) -> bool`` names
    records in whose copy one byte is flipped (to rehearse an audit)."""

    def copy(batches):
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                data = bytearray(store.get(f"{source}/{name}"))
                for r in records if damage else ():
                    if damage(r["record_id"]):
                        data[r["offset"] + r["length"] // 2] ^= 1
                store.put(f"{target}/{name}", [bytes(data)], str(TaskContext.get().taskAttemptId()))
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["file"])

    return stored(_files(index).mapInArrow(copy, "file string"), "warc-copies").count()


def _each(index: DataFrame, folder: str, make, schema: str) -> DataFrame:
    """``make(record row, its bytes)`` for every indexed record that the folder holds whole."""
    names = [f.split()[0] for f in schema.split(", ")]

    def read(batches):
        for batch in batches:
            for name, records in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    data = store.get(f"{folder}/{name}")
                except FileNotFoundError:
                    continue
                rows = [make({"file": name, **r}, data[r["offset"]:r["offset"] + r["length"]])
                        for r in records if r["offset"] + r["length"] <= len(data)]
                for lo in range(0, len(rows), 2_000):
                    yield pa.RecordBatch.from_pylist([{n: r[n] for n in names} for r in rows[lo:lo + 2_000]])

    return _files(index).mapInArrow(read, schema)


def record_table(index: DataFrame, folder: str) -> DataFrame:
    """One row per record that the replica holds, with the SHA-256 of its bytes."""
    return _each(index, folder, lambda r, data: r | {"sha256": hashlib.sha256(data).hexdigest()}, RECORDS)


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """record_id, url and payload of every record, from its own bytes."""

    def make(r, data):
        head, payload = parse(data)
        return {"record_id": head["WARC-Record-ID"][10:-1], "url": head["WARC-Target-URI"], "payload": payload.decode()}

    return _each(index, folder, make, "record_id string, url string, payload string")


def merkle_levels(records: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Tables (file, node, hash) from the leaves to the roots; a leaf's hash covers its
    offset range and bytes, a node's its children in order."""
    level = records.select("file", F.col("nth").alias("node"),
                           F.sha2(F.concat_ws(":", "offset", "length", "sha256"), 256).alias("hash"))
    levels = [stored(level, "merkle")]
    while (levels[-1].agg(F.max("node")).first()[0] or 0) > 0:
        below = levels[-1]
        children = F.sort_array(F.collect_list(F.struct("node", "hash")))  # at most ``fanout``
        level = (below.groupBy("file", F.floor(F.col("node") / fanout).alias("up")).agg(children.alias("c"))
                 .select("file", F.col("up").alias("node"), F.sha2(F.concat_ws(",", F.col("c.hash")), 256).alias("hash")))
        levels.append(stored(level, "merkle"))
    return levels


def audit(left: DataFrame, right: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """Records at which the replicas differ: file, nth, left_sha256, right_sha256 (null:
    missing there). ``left`` and ``right`` are stored record tables."""
    a, b = merkle_levels(left, fanout), merkle_levels(right, fanout)
    while len(a) < len(b):  # a shorter tree's root also stands for the levels above it
        a.append(a[-1])
    while len(b) < len(a):
        b.append(b[-1])
    suspects = None
    for x, y in zip(reversed(a), reversed(b)):
        if suspects is not None:
            inside = lambda t, s=suspects: t.withColumn("up", F.floor(F.col("node") / fanout)).join(s, ["file", "up"], "left_semi").drop("up")
            x, y = inside(x), inside(y)
        both = x.withColumnRenamed("hash", "l").join(y.withColumnRenamed("hash", "r"), ["file", "node"], "full")
        differ = stored(both.filter("not (l <=> r)").select("file", "node"), "merkle-differ")
        if differ.isEmpty():
            break
        suspects = differ.withColumnRenamed("node", "up")
    nth = differ.select("file", F.col("node").alias("nth"))
    side = lambda t, name: t.join(nth, ["file", "nth"], "left_semi").select("file", "nth", F.col("sha256").alias(name), F.col("record_id").alias(f"{name}_id"))
    found = side(left, "left_sha256").join(side(right, "right_sha256"), ["file", "nth"], "full")
    return found.select("file", "nth", F.coalesce("left_sha256_id", "right_sha256_id").alias("record_id"), "left_sha256", "right_sha256")


def shared_folder(spark: SparkSession, name: str) -> str:
    ensure_checkpoint_dir(spark)
    return scratch_path(spark, name)

"""Operator 5: exact duplicates by composable polynomial fingerprints.

A text's bytes b_1..b_n (letters A-Z lower-cased, nothing else changed) have the
fingerprint sum(b_i * r^(n-i)) modulo a 31-bit prime, under two bases. A chunk's
fingerprint needs only the chunk, and neighbours combine by shifting the left one
by the right one's length: F(ab) = F(a) * r^len(b) + F(b). Ordinary texts are
hashed chunk by chunk where they lie; texts above ``split_chars`` are first cut
into pieces that are hashed as rows of their own, in parallel, and combined after.

Rows with equal (fingerprints, length) are candidates, no more: their normalised
texts are cut into chunks, and a group counts as equal only if at every chunk
position the smallest and the largest chunk are the same bytes. Those are partial
aggregates, so a group that holds a third of all rows leaves one row per task and
position. Groups that fail (a collision) are split by their whole texts.

Edge cases: a null text equals an empty one; of rows that tie on the largest
document id one stays (the last in file order); a null id sorts below any id, and
``keep_id`` is null only if the whole group has none; an empty table gives no
rows; columns other than the two named are not read, so their names cannot clash.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, identified, raw, slices, stored

PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525_003)
CHUNK = 1 << 16
SPLIT_CHARS = 4 << 20
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(n, np.int64)
    for i in range(1, n):
        out[i] = out[i - 1] * base % PRIME
    return out


_weights: dict[tuple, np.ndarray] = {}


def chunk_hash(data: np.ndarray, base: int) -> int:
    """Of at most ``CHUNK`` bytes: products stay below 2^39, their sum below 2^55."""
    if base not in _weights:
        _weights[base] = _powers(base, CHUNK)[::-1].copy()
    return int(data @ _weights[base][CHUNK - len(data):]) % PRIME if len(data) else 0


def combine(left: int, right: int, right_bytes: int, base: int) -> int:
    return (left * pow(base, right_bytes, PRIME) + right) % PRIME


def fingerprint(data: bytes) -> tuple[int, int, int]:
    whole = np.frombuffer(data, np.uint8).astype(np.int64)
    out = []
    for base in BASES:
        h = 0
        for i in range(0, len(whole), CHUNK):
            part = whole[i:i + CHUNK]
            h = combine(h, chunk_hash(part, base), len(part), base)
        out.append(h)
    return out[0], out[1], len(data)


def _hashed(batches, digest: bool, bits: int):
    for batch in slices(batches, "text"):
        texts = [t.lower() for t in raw(batch.column(batch.schema.get_field_index("text")))]
        marks = [fingerprint(t) for t in texts]
        names = [n for n in batch.schema.names if n != "text"]
        columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
        columns += [pa.array([m[0] & ((1 << bits) - 1) for m in marks], pa.int64()),
                    pa.array([m[1] & ((1 << bits) - 1) for m in marks], pa.int64()),
                    pa.array([m[2] for m in marks], pa.int64())]
        names += ["f1", "f2", "n_bytes"]
        if digest:
            columns.append(pa.array([hashlib.sha256(t).hexdigest() for t in texts]))
            names.append("text_sha256")
        yield pa.RecordBatch.from_arrays(columns, names)


def fingerprints(rows: DataFrame, split_chars: int = SPLIT_CHARS, digest: bool = True, bits: int = 31) -> DataFrame:
    """rid_file, rid_row, doc_id, f1, f2, n_bytes (and the text's SHA-256).
    ``bits`` below 31 weakens the fingerprints (tests use it to force collisions)."""
    kept = "rid_file bigint, rid_row bigint, doc_id bigint"
    out = f"{kept}, f1 bigint, f2 bigint, n_bytes bigint" + (", text_sha256 string" if digest else "")
    long = F.coalesce(F.char_length("text") > split_chars, F.lit(False))
    plain = rows.filter(~long).mapInArrow(lambda b: _hashed(b, digest, bits), out)
    # pieces of huge texts: one row each, dealt out, hashed, put together in order
    pieces = (rows.filter(long).withColumn("n", F.ceil(F.char_length("text") / split_chars))
              .select(*ROW_ID, "doc_id", "text", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("nth"))
              .select(*ROW_ID, "doc_id", "nth", F.substring(F.col("text"), (F.col("nth") - 1) * split_chars + 1,
                                                            F.lit(split_chars)).alias("text"))
              .repartition(*ROW_ID, "nth"))
    parts = pieces.mapInArrow(lambda b: _hashed(b, False, 31), f"{kept}, nth int, f1 bigint, f2 bigint, n_bytes bigint")
    joined = (parts.groupBy(*ROW_ID, "doc_id")
              .agg(F.sort_array(F.collect_list(F.struct("nth", "f1", "f2", "n_bytes"))).alias("parts")))

    def together(batches):
        for batch in batches:
            cols = {n: batch.column(i) for i, n in enumerate(batch.schema.names)}
            marks = []
            for parts_ in cols["parts"].to_pylist():
                h, n = [0, 0], 0
                for p in parts_:
                    h = [combine(h[i], p[f"f{i + 1}"], p["n_bytes"], BASES[i]) for i in range(2)]
                    n += p["n_bytes"]
                marks.append((*(x & ((1 << bits) - 1) for x in h), n))
            yield pa.RecordBatch.from_arrays([cols[c] for c in (*ROW_ID, "doc_id")] +
                                             [pa.array([m[i] for m in marks], pa.int64()) for i in range(3)],
                                             [*ROW_ID, "doc_id", "f1", "f2", "n_bytes"])

    huge = joined.mapInArrow(together, f"{kept}, f1 bigint, f2 bigint, n_bytes bigint")
    if digest:
        whole = rows.filter(long).select(*ROW_ID, F.sha2(F.translate("text", _UPPER, _LOWER), 256).alias("text_sha256"))
        huge = huge.join(whole, [*ROW_ID])
    return plain.unionByName(huge)


KEY = ("f1", "f2", "n_bytes")


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                     split_chars: int = SPLIT_CHARS, bits: int = 31) -> DataFrame:
    """One row per input row: rid_file, rid_row, doc_id, keep_id, group_size, kept,
    text_sha256. ``rid_*`` name the row by its file and place (common.identified)."""
    rows = identified(docs, id_col, text_col)
    rows = rows.select(*ROW_ID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    marks = stored(fingerprints(rows, split_chars, True, bits), "fingerprints")
    last = F.max(F.struct("doc_id", *ROW_ID)).alias("top")
    groups = marks.groupBy(*KEY).agg(F.count("*").alias("group_size"), last)
    shared = stored(groups.filter("group_size > 1"), "fingerprint-groups")
    members = marks.join(shared.select(*KEY), [*KEY]).select(*ROW_ID, *KEY)
    texts = rows.join(members, [*ROW_ID]).select(*ROW_ID, "doc_id", *KEY, "text")

    def chunks(batches):
        for batch in slices(batches, "text"):
            at, nth, data = [], [], []
            for i, t in enumerate(raw(batch.column(3))):
                t = t.lower()
                for j in range(0, max(len(t), 1), CHUNK):
                    at.append(i)
                    nth.append(j // CHUNK)
                    data.append(t[j:j + CHUNK])
            take = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).take(take) for i in range(3)), pa.array(nth, pa.int32()), pa.array(data, pa.binary())],
                [*KEY, "nth", "chunk"])

    compared = (texts.select(*KEY, "text").mapInArrow(chunks, "f1 bigint, f2 bigint, n_bytes bigint, nth int, chunk binary")
                .groupBy(*KEY, "nth").agg(F.min("chunk").alias("lo"), F.max("chunk").alias("hi"))
                .filter("lo <> hi").select(*KEY).distinct())
    differ = stored(compared, "fingerprint-collisions")
    top = shared.join(differ, [*KEY], "left_anti") if (collided := not differ.isEmpty()) else shared
    one = F.struct(F.col("doc_id"), *ROW_ID)
    found = marks.join(top, [*KEY], "left")
    if collided:
        clash = (rows.join(marks.join(differ, [*KEY], "left_semi").select(*ROW_ID), [*ROW_ID], "left_semi")
                 .select(*ROW_ID, "doc_id", F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER).alias("text")))
        clash = stored(clash, "collision-texts")
        exact = clash.groupBy("text").agg(F.count("*").alias("clash_size"), F.max(F.struct("doc_id", *ROW_ID)).alias("clash_top"))
        clash = clash.join(exact, "text").select(*ROW_ID, "clash_size", "clash_top")
        found = (found.join(clash, [*ROW_ID], "left")
                 .withColumn("group_size", F.coalesce("clash_size", "group_size"))
                 .withColumn("top", F.coalesce("clash_top", "top")))
    top = F.coalesce(F.col("top"), one)
    return found.select(*ROW_ID, "doc_id", top["doc_id"].alias("keep_id"),
                        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
                        ((top[ROW_ID[0]] == F.col(ROW_ID[0])) & (top[ROW_ID[1]] == F.col(ROW_ID[1]))).alias("kept"),
                        "text_sha256")

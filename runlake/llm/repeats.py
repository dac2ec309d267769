"""Operator 4: repeated passages by sparse suffix arrays.

Suffixes are kept only where a text's content selects them: each window of ``least``
words selects its minimiser, the smallest of its first ``SPAN`` hashes of ``GRAM``
words. Equal windows select the same place, so their suffixes from there on agree in at
least ``least - SPAN + 1`` words, the prefix. A run of windows that select the same
suffix is a block: all that the suffix can extend to, left and right.

* Retain: suffixes whose prefix no other row has are dropped. Prefixes are dealt by
  fingerprint in packed marks, and the answer goes back to the chunk of rows that asked. A
  prefix of several rows in one slice of a task is known to repeat: it is told once a slice.
* Sort and compare neighbours: each other suffix goes, with the words around it, to the
  bucket of its prefix; equal blocks of a slice go once. There suffixes are sorted by the
  words that follow and, in a second order, by the words that precede them, read backwards.
  Neighbours in each order give the lengths of common extensions.
* Extend: a window that starts ``d`` words left of its suffix repeats where another row's
  suffix agrees in ``d`` words to the left and in the window's other words to the right.
  The runs of such windows go back to the blocks; a row's hits run together into maximal
  spans.
* Hot prefixes, of more than ``HOT`` rows, would make one bucket of any size. Their blocks
  are compared whole, and those that do not repeat whole window by window, by fingerprints
  in Spark's own aggregates, which combine before the shuffle.

Edge cases: words are cut at ASCII white space after lower-casing A-Z; null, empty and
short texts have no passage; passages that repeat only inside one document row do not
count, rows that repeat whole do; a null document id is kept as null; a span carries the
document id of another row that holds a part of it (null if that row has none); an empty
table gives no rows; other columns are not read. Words, prefixes, blocks and rows (of hot
prefixes also windows) are told apart by 64-bit hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, expanded, identified, raw, slices, squeezed, stored
from runlake.llm.jaccard import mix

LEAST, SPAN, GRAM = 50, 30, 8
#: Rows of a file that get their answers together.
CHUNK = 16
#: Bytes of text for each bucket of prefix marks, and of suffixes with their words.
BUCKET_BYTES, ORDER_BYTES = 100 << 20, 16 << 20
#: Rows that share a prefix, beyond which its suffixes are not sorted in one task.
HOT = 4096
_U = np.uint64
BASE = _U(0x9E3779B97F4A7C15 | 1)
INVERSE = _U(pow(int(BASE), -1, 1 << 64))


class Text:
    """Word hashes of one text, and fingerprints of its word ranges."""

    def __init__(self, text: bytes):
        ws = text.lower().split()
        self.n = len(ws)
        h = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, ws), np.uint64, self.n))
        powers = np.cumprod(np.full(self.n, BASE)) if self.n else np.zeros(0, np.uint64)
        self.words = h
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(h * powers)])
        self.down = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(self.n, INVERSE))])

    def prints(self, starts: np.ndarray, size) -> np.ndarray:
        """Fingerprints of ``size`` words from each start: position does not matter."""
        return mix((self.sums[starts + size] - self.sums[starts]) * self.down[starts] + np.asarray(size).astype(np.uint64))

    def blocks(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Runs of windows that select one suffix: first window, number of windows, suffix."""
        if self.n < least:
            return (np.zeros(0, np.int64),) * 3
        g = self.prints(np.arange(self.n - GRAM + 1), GRAM)
        at, width = np.arange(len(g)), 1
        while width < SPAN:  # the leftmost smallest of each ``width`` hashes, widths doubling up to SPAN
            step = min(width, SPAN - width)
            left, right = at[:len(at) - step], at[step:]
            at, width = np.where(g[left] <= g[right], left, right), width + step
        at = at[:self.n - least + 1]
        first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        return first, np.diff(np.append(first, len(at))), at[first]


def _packed_marks(marks: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Binary values: the marks from each cut to the next."""
    ends = (np.append(cut, len(marks)) * 8).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(cut), [None, pa.py_buffer(ends), pa.py_buffer(marks.astype("<u8").tobytes())])


def _lists(values: np.ndarray, cut: np.ndarray) -> pa.Array:
    """Lists: the values from each cut to the next."""
    return pa.ListArray.from_arrays(pa.array(np.append(cut, len(values)).astype(np.int32)), pa.array(values.view(np.int64)))


def _edges(*keys: np.ndarray) -> np.ndarray:
    """Where sorted entries differ from the one before."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), bool)
    new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return np.flatnonzero(new)


ASKED = "bucket bigint, rid_file bigint, chunk bigint, marks binary, held binary"
NAMES = ["bucket", "rid_file", "chunk", "marks", "held"]
KNOWN = "rid_file bigint, chunk bigint, marks array<bigint>"


def _suffixes(batches, least: int, buckets: int):
    """Blocks of prefix fingerprints for each bucket: of a chunk's rows; with a null chunk
    those known to repeat; and, in buckets below 0, what a chunk already knows."""
    prefix = least - SPAN + 1
    for batch in slices(batches, "text", 8 << 20):
        marks, rows = [], []
        for i, t in enumerate(raw(batch.column(3))):
            text = Text(t)
            marks.append(np.unique(text.prints(text.blocks(least)[2], prefix)))
            rows.append(np.full(len(marks[-1]), i))
        mark, row = np.concatenate(marks), np.concatenate(rows)
        file, chunk = batch.column(0).to_numpy(), batch.column(1).to_numpy() // CHUNK
        part = np.cumsum(np.concatenate([[False], (file[1:] != file[:-1]) | (chunk[1:] != chunk[:-1])]))
        lead = np.searchsorted(part, np.arange(part[-1] + 1))  # a row of each part
        _, inverse, width = np.unique(mark, return_inverse=True, return_counts=True)
        known = width[inverse] > 1
        bucket = (mark % _U(buckets)).astype(np.int64)
        where = np.where(known, -1 - part[row] % buckets, bucket)
        told, held = np.unique(mark[known], return_counts=True)
        home = (told % _U(buckets)).astype(np.int64)
        order = np.lexsort((mark, where, part[row]))
        m, w, p = mark[order], where[order], part[row][order]
        fresh = _edges(m, w, p)
        m, w, p = m[fresh], w[fresh], p[fresh]
        cut = _edges(w, p)
        yield pa.RecordBatch.from_arrays([pa.array(w[cut]), pa.array(file[lead[p[cut]]]), pa.array(chunk[lead[p[cut]]]),
                                          _packed_marks(m, cut), pa.nulls(len(cut), pa.binary())], NAMES)
        order = np.argsort(home, kind="stable")
        told, home, held = told[order], home[order], held[order]
        cut = _edges(home)
        none = pa.nulls(len(cut), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(home[cut]), none, none, _packed_marks(told, cut), _packed_marks(held, cut)], NAMES)


def _repeated(table: pa.Table, most: int) -> pa.Table:
    """Of a bucket of marks: those of each chunk that another row has too, and, with a null
    chunk, those of more than ``most`` rows."""
    parts = [np.frombuffer(b, "<u8") for b in table.column("marks").to_pylist()]
    mark = np.concatenate([np.zeros(0, np.uint64), *parts])
    size = np.array([len(x) for x in parts], np.int64)
    owner = np.repeat(np.arange(len(parts)), size)
    if len(parts) and table.column("bucket")[0].as_py() < 0:
        return table.select(["rid_file", "chunk"]).append_column("marks", _lists(mark, np.cumsum(size) - size))
    held = [np.ones(n, np.int64) if h is None else np.frombuffer(h, "<i8") for n, h in zip(size, table.column("held").to_pylist())]
    told = np.asarray(table.column("chunk").is_null())[owner]
    order = np.argsort(mark, kind="stable")
    m, told, owner = mark[order], told[order], owner[order]
    edge = _edges(m)
    # an entry of a chunk is one row; one that is told stands for several
    total = np.add.reduceat(np.concatenate(held)[order], edge) if len(m) else np.zeros(0, np.int64)
    hot = m[edge[total > most]]
    keep = np.flatnonzero((np.repeat(total, np.diff(np.append(edge, len(m)))) > 1) & ~told)
    keep = keep[np.argsort(owner[keep], kind="stable")]
    m, owner = m[keep], owner[keep]
    cut = _edges(owner)
    kept = table.select(["rid_file", "chunk"]).take(pa.array(owner[cut])).append_column("marks", _lists(m, cut))
    if not len(hot):
        return kept
    none = pa.nulls(1, pa.int64())
    return pa.concat_tables([kept, pa.table([none, none, _lists(hot, np.zeros(1, np.int64))], kept.column_names).cast(kept.schema)])


BLOCKS = "rid_file bigint, rid_row bigint, doc_id bigint, row bigint, first bigint, windows bigint, block bigint, prints array<bigint>"
SUFFIXES = "bucket bigint, mark bigint, block bigint, back bigint, windows bigint, words binary, lo bigint, hi bigint"


def _blocks(batches, least: int, buckets: int):
    """Rows of two kinds. The blocks of a row's repeated suffixes, those of hot prefixes with
    the fingerprints of their windows. And, with a bucket, each different block of the other
    suffixes in a slice: the words left of the suffix and those behind its prefix, how many
    are to the left, and the smallest and largest row."""
    prefix = least - SPAN + 1
    fields = [f.split() for f in f"{BLOCKS}, {SUFFIXES}".split(", ")]
    kinds = {"bigint": pa.int64(), "binary": pa.binary(), "array<bigint>": pa.list_(pa.int64())}
    schema = pa.schema(list({name: pa.field(name, kinds[kind]) for name, kind in fields}.values()))

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in schema], schema=schema)

    for batch in slices(batches, "text", 1 << 20):
        held, base = [np.zeros(0, np.uint64)], 0
        rows, at, firsts, counts, whole, marks, hots, each = ([np.zeros(0, t)] for t in ("i8", "i8", "i8", "i8", "u8", "u8", "?", "u8"))
        for i, t in enumerate(expanded(batch.column(4))):
            text = Text(t)
            first, count, suffix = text.blocks(least)
            known = np.array(batch.column(5)[i].values.field("mark"), np.int64).view(np.uint64)
            hot = known[np.array(batch.column(5)[i].values.field("hot"), bool)]
            mark = text.prints(suffix, prefix)
            hit = np.isin(mark, known)
            first, count, suffix, mark = first[hit], count[hit], suffix[hit], mark[hit]
            is_hot = np.isin(mark, hot)
            rows.append(np.full(len(first), i))
            firsts.append(first)
            counts.append(count)
            marks.append(mark)
            hots.append(is_hot)
            at.append(suffix + base)
            whole.append(text.prints(first, count + least - 1))
            f, c = first[is_hot], count[is_hot]
            each.append(text.prints(np.repeat(f - (np.cumsum(c) - c), c) + np.arange(c.sum()), least))
            held.append(text.words)
            base += text.n
        row, at, first, count, block, mark, hot = map(np.concatenate, (rows, at, firsts, counts, whole, marks, hots))
        take = pa.array(row)
        ends = pa.array(np.concatenate([[0], np.cumsum(np.where(hot, count, 0))]).astype(np.int32))
        prints = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(each).view(np.int64)), mask=pa.array(~hot))
        yield batch_of(len(row), **{name: batch.column(k).take(take) for k, name in enumerate([*ROW_ID, "doc_id", "row"])},
                       first=pa.array(first), windows=pa.array(count), block=pa.array(block.view(np.int64)), prints=prints)

        # back: words from a block's start to its suffix
        back = at - first - (np.cumsum([0] + [len(w) for w in held[1:]])[row] if len(row) else 0)
        cold = np.flatnonzero(~hot)
        cold = cold[np.argsort(block[cold], kind="stable")]
        edge = _edges(block[cold])
        if not len(edge):
            continue
        owner = batch.column(3).to_numpy()[row[cold]]
        one = cold[edge]
        size = count[one] + SPAN - 2  # of least + count - 1 words all but the prefix
        nth = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        left = np.repeat(back[one], size)
        place = np.repeat(at[one] - back[one], size) + nth + np.where(nth >= left, prefix, 0)
        words = np.concatenate(held)[place]
        yield batch_of(len(one), bucket=pa.array((mark[one] % _U(buckets)).astype(np.int64)), mark=pa.array(mark[one].view(np.int64)),
                       block=pa.array(block[one].view(np.int64)), back=pa.array(back[one]), windows=pa.array(count[one]),
                       words=_packed_marks(words, np.cumsum(size) - size),
                       lo=pa.array(np.minimum.reduceat(owner, edge)), hi=pa.array(np.maximum.reduceat(owner, edge)))


def _ordered(mark: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of suffixes by mark and words, and how many words each has in common with
    the one before (-1: not even the mark)."""
    order = np.lexsort((*words.T[::-1], mark))
    common = np.full(len(order), -1)
    w, m = words[order], mark[order]
    differ = w[1:] != w[:-1]
    common[1:] = np.where(m[1:] != m[:-1], -1, np.where(differ.any(axis=1), differ.argmax(axis=1), words.shape[1]))
    return order, common


RUNS = "block bigint, skip bigint, last bigint, lo bigint, hi bigint"


def _neighbours(table: pa.Table) -> pa.Table:
    """Of a bucket's suffixes: the runs of windows in each block that another row has too, as
    the numbers of their first and last window, with the smallest and largest row."""
    block, mark, back, count, lo, hi = (table.column(c).to_numpy() for c in ("block", "mark", "back", "windows", "lo", "hi"))
    words = np.frombuffer(b"".join(table.column("words").to_pylist()), "<u8")
    start = np.cumsum(count + SPAN - 2) - (count + SPAN - 2)
    # equal blocks of several slices as one; marks that only one block of one row has are done
    order = np.argsort(block, kind="stable")
    edge = _edges(block[order])
    lo, hi = np.minimum.reduceat(lo[order], edge), np.maximum.reduceat(hi[order], edge)
    one = order[edge]
    block, mark, back, count, start = block[one], mark[one], back[one], count[one], start[one]
    _, inverse, width = np.unique(mark, return_inverse=True, return_counts=True)
    open_ = np.flatnonzero((width[inverse] > 1) | (lo != hi))
    block, mark, back, count, start, lo, hi = (x[open_] for x in (block, mark, back, count, start, lo, hi))
    n, reach = len(block), SPAN - 1
    column = np.arange(reach)
    # words before the suffix, nearest first, and behind its prefix; 0 where a block has none
    right = reach - (back - count + 1)
    pick = lambda at, there: np.where(there, words[np.where(there, at, 0)], 0) if n else np.zeros((0, reach), np.uint64)
    before = pick((start + back - 1)[:, None] - column, column < back[:, None])
    behind = pick((start + back)[:, None] + column, column < right[:, None])
    by_left, left_common = _ordered(mark, before)
    by_right, right_common = _ordered(mark, behind)
    hit = np.zeros((n, SPAN + 1), bool)
    low, high = np.zeros((n, SPAN), np.int64), np.zeros((n, SPAN), np.int64)
    left_class, right_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for d in range(SPAN):  # windows that start d words left of their suffix
        left_class[by_left] = np.cumsum(left_common < d)
        right_class[by_right] = np.cumsum(right_common < reach - d)
        has = np.flatnonzero((back >= d) & (back - count < d))
        key = left_class[has] * (n + 1) + right_class[has]
        order = np.argsort(key, kind="stable")
        edge = _edges(key[order])
        if not len(edge):
            continue
        times = np.diff(np.append(edge, len(key)))
        has = has[order]
        a, b = np.repeat(np.minimum.reduceat(lo[has], edge), times), np.repeat(np.maximum.reduceat(hi[has], edge), times)
        hit[has, reach - d], low[has, reach - d], high[has, reach - d] = a != b, a, b
    # runs of hits along a block; the last column is always empty, so no run goes on to the next
    flat = hit.ravel()
    turn = np.flatnonzero(np.diff(np.concatenate([[False], flat]).astype(np.int8)))
    head, tail = turn[::2], turn[1::2]
    who, skip = head // (SPAN + 1), head % (SPAN + 1)
    length = tail - head
    top = np.iinfo(np.int64)
    lows = np.where(hit[:, :SPAN], low, top.max)
    highs = np.where(hit[:, :SPAN], high, top.min)
    cells = np.repeat(who * SPAN + skip - (np.cumsum(length) - length), length) + np.arange(length.sum())
    part = np.cumsum(length) - length
    skip = skip - (reach - back[who])
    return pa.table({
        "block": block[who], "skip": skip, "last": skip + length - 1,
        "lo": np.minimum.reduceat(lows.ravel()[cells], part) if len(part) else np.zeros(0, np.int64),
        "hi": np.maximum.reduceat(highs.ravel()[cells], part) if len(part) else np.zeros(0, np.int64)})


def repeated_passages(docs: DataFrame, least: int = LEAST, id_col: str = "doc_id", text_col: str = "text",
                      hot_rows: int = HOT) -> DataFrame:
    """One row per maximal repeated span: rid_file, rid_row, doc_id, first_word,
    last_word (exclusive), other_doc_id."""
    if least < SPAN + GRAM:
        raise ValueError("passages must be longer than a selection window")
    rows = identified(docs, id_col, text_col)
    rows = rows.select(*ROW_ID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = int(max(64, size // BUCKET_BYTES))
    asked = rows.mapInArrow(lambda b: _suffixes(b, least, buckets), ASKED)
    found = stored(asked.groupBy("bucket").applyInArrow(lambda t: _repeated(t, hot_rows), KNOWN), "repeated-prefixes")
    hot = stored(found.filter("chunk is null").select(F.explode("marks").alias("mark"), F.lit(True).alias("hot")), "hot-prefixes")
    found = (found.filter("chunk is not null").select("rid_file", "chunk", F.explode("marks").alias("mark")).join(hot, "mark", "left")
             .groupBy("rid_file", "chunk")  # lists bounded by the texts of a chunk
             .agg(F.collect_list(F.struct("mark", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("marks")))
    texts = (rows.mapInArrow(squeezed, "rid_file bigint, rid_row bigint, doc_id bigint, text binary")
             .withColumn("chunk", F.floor(F.col("rid_row") / CHUNK)))
    ordered = int(max(64, size // ORDER_BYTES))
    both = stored(texts.join(found, ["rid_file", "chunk"]).select(*ROW_ID, "doc_id", F.xxhash64(*ROW_ID).alias("row"), "text", "marks")
                  .mapInArrow(lambda b: _blocks(b, least, ordered), f"{BLOCKS}, {SUFFIXES.replace('block bigint, ', '').replace('windows bigint, ', '')}"),
                  "blocks")
    suffixes = both.filter("bucket is not null").select(*[f.split()[0] for f in SUFFIXES.split(", ")])
    runs = stored(suffixes.groupBy("bucket").applyInArrow(_neighbours, RUNS), "repeated-runs")
    blocks = both.filter("bucket is null").select(*[f.split()[0] for f in BLOCKS.split(", ")])

    place = [*ROW_ID, "doc_id", "first", "last", "other"]
    other = F.when(F.col("lo") != F.col("row"), F.col("lo")).otherwise(F.col("hi")).alias("other")
    sorted_ = (blocks.filter("prints is null").join(runs, "block")
               .select(*ROW_ID, "doc_id", (F.col("first") + F.col("skip")).alias("first"), (F.col("first") + F.col("last")).alias("last"), other))
    blocks = blocks.filter("prints is not null")
    twice = stored(blocks.groupBy("block").agg(F.min("row").alias("lo"), F.max("row").alias("hi")).filter("lo <> hi"), "repeated-blocks")
    # hot prefixes: whole blocks are hits; windows are left to the others, and to one block of each kind
    compared = stored(blocks.join(twice, "block", "left").select(
        *ROW_ID, "doc_id", "row", "first", "windows", "lo", "hi",
        F.when(F.col("lo").isNull() | (F.col("row") == F.col("lo")), F.col("prints")).alias("prints")), "compared-blocks")
    whole = compared.filter("lo is not null").select(
        *ROW_ID, "doc_id", "first", (F.col("first") + F.col("windows") - 1).alias("last"), other)
    windows = compared.filter("prints is not null").select(
        *ROW_ID, "doc_id", "row", "first", "lo", "hi", F.posexplode("prints").alias("nth", "mark"))
    pairs = stored(windows.groupBy("mark").agg(F.min(F.coalesce("lo", "row")).alias("lo"), F.max(F.coalesce("hi", "row")).alias("hi"),
                                               F.max(F.col("lo").isNull()).alias("open"))
                   .filter("open and lo <> hi").drop("open"), "repeated-windows")
    single = (windows.filter("lo is null").drop("lo", "hi").join(pairs, "mark")
              .select(*ROW_ID, "doc_id", (F.col("first") + F.col("nth")).alias("first"), other)
              .withColumn("last", F.col("first")))
    hits = sorted_.select(*place).unionByName(whole.select(*place)).unionByName(single.select(*place))
    by_row = Window.partitionBy(*ROW_ID).orderBy("first", "last")
    before = F.max("last").over(by_row.rowsBetween(Window.unboundedPreceding, -1))
    fresh = F.coalesce((F.col("first") > before + least).cast("int"), F.lit(1))
    spans = (hits.withColumn("fresh", fresh).withColumn("span", F.sum("fresh").over(by_row))
             .groupBy(*ROW_ID, "doc_id", "span")
             .agg(F.min("first").alias("first_word"), (F.max("last") + least).alias("last_word"), F.min("other").alias("other")))
    named = rows.select(F.xxhash64(*ROW_ID).alias("other"), F.col("doc_id").alias("other_doc_id"))
    return spans.join(named, "other", "left").drop("other", "span")

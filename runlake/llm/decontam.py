"""Operator 7: benchmark decontamination by a prefix-filtered join of shingles.

A window is ``width`` consecutive words of a benchmark item (a shorter item is one
window); a document word is hit when it lies inside any occurrence of a window.
Seen as sets of shingles (three consecutive words), an occurrence must hold all of
the window's shingles, so the necessary prefix in order of rarity is its single
rarest one:

1. Documents become runs: maximal stretches of words that all occur in the
   benchmark, kept when no shorter than the shortest window (length bound).
2. The runs give the frequency of every benchmark shingle over all documents.
3. Each window is indexed by its rarest shingle; a run's shingles fetch windows,
   the window must fit into the run around the shingle (positional bound), and its
   words are compared one by one.

The benchmark is the stated query set. It is read in blocks of at most
``block_words`` words, each shipped to the tasks whole, so what is broadcast is
bounded by that parameter; documents are scanned once per block.

Edge cases: null and empty texts have no words; null or repeated item texts and ids
are allowed (a null item id hits words but is not listed, a repeated one is listed
once); repeated document rows each get a row; an empty benchmark hits nothing; an
empty document table gives no rows; other columns are not read.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import ROW_ID, identified, raw, slices, stored

WIDTH = 10
SHINGLE = 3
BLOCK_WORDS = 1_000_000
#: Digits, letters in lower case and every byte of non-ASCII characters; the rest divides words.
_TO = bytes(b if chr(b).isdigit() and b < 128 or 97 <= b < 123 or b >= 128 else b + 32 if 65 <= b < 91 else 32
            for b in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO).split()


class Block:
    """A block of benchmark items: vocabulary, distinct windows, items of each window."""

    def __init__(self, items: list[tuple[int | None, list[bytes]]], width: int = WIDTH):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set] = {}
        for item, ws in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in ws]
            n = min(width, len(ids))
            for i in range(len(ids) - n + 1 if ids else 0):
                owners.setdefault(tuple(ids[i:i + n]), set()).add(item)
        self.width = width
        self.lengths = np.array([len(w) for w in owners], np.int64)
        self.windows = np.zeros((len(owners), width), np.int64)
        for i, w in enumerate(owners):
            self.windows[i, :len(w)] = w
        # windows with the same owners share a set of items
        sets: dict[tuple, int] = {}
        self.set_of = np.array([sets.setdefault(tuple(sorted(x for x in o if x is not None)), len(sets))
                                for o in owners.values()], np.int64)
        self.item_at = np.cumsum([0] + [len(o) for o in sets]).astype(np.int64)
        self.items = np.array([x for o in sets for x in o], np.int64)
        self.shortest = int(self.lengths.min(initial=width))
        self.base = len(self.vocabulary) + 1
        # all shingles of the windows, by shingle width (a window shorter than a shingle is its own)
        self.shingles = {}
        for k in range(1, SHINGLE + 1):
            rows = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k)
            keys = [self.key(self.windows[rows], j, k)[self.lengths[rows] >= j + k] for j in range(width - k + 1)]
            self.shingles[k] = np.unique(np.concatenate(keys)) if len(rows) else np.zeros(0, np.int64)

    def key(self, ids: np.ndarray, j: int, k: int) -> np.ndarray:
        out = ids[:, j].copy()
        for i in range(1, k):
            out = out * self.base + ids[:, j + i]
        return out

    def run_keys(self, ids: np.ndarray, k: int) -> np.ndarray:
        """Key of the k words from each position; 0 ids (gaps) make it a key of no window."""
        if len(ids) < k:
            return np.zeros(0, np.int64)
        out, whole = ids[:len(ids) - k + 1].copy(), ids[:len(ids) - k + 1] > 0
        for i in range(1, k):
            nxt = ids[i:len(ids) - k + 1 + i]
            out = out * self.base + nxt
            whole &= nxt > 0
        return np.where(whole, out, -1)

    def index(self, counts: dict[int, np.ndarray]) -> dict[int, tuple[np.ndarray, ...]]:
        """For each shingle width: sorted keys of rarest shingles, with window and offset of each."""
        out = {}
        for k, known in self.shingles.items():
            rows = np.flatnonzero(np.minimum(self.lengths, SHINGLE) == k)
            if not len(rows):
                continue
            best = np.full(len(rows), np.iinfo(np.int64).max)
            at = np.zeros(len(rows), np.int64)
            for j in range(self.width - k + 1):
                inside = self.lengths[rows] >= j + k
                place = np.minimum(np.searchsorted(known, self.key(self.windows[rows], j, k)), len(known) - 1)
                n = np.where(inside, counts[k][place], np.iinfo(np.int64).max)
                at, best = np.where(n < best, j, at), np.minimum(n, best)
            keys = np.array([self.key(self.windows[r:r + 1], j, k)[0] for r, j in zip(rows, at)])
            order = np.argsort(keys, kind="stable")
            out[k] = (keys[order], rows[order], at[order])
        return out


def blocks(benchmark: DataFrame, width: int, block_words: int, id_col: str, text_col: str):
    held, n = [], 0
    for r in benchmark.select(id_col, text_col).toLocalIterator():
        ws = words((r[1] or "").encode())
        held.append((r[0], ws))
        n += len(ws)
        if n >= block_words:
            yield Block(held, width)
            held, n = [], 0
    if held:
        yield Block(held, width)


RUNS = "rid_file bigint, rid_row bigint, doc_id bigint, n_words bigint, starts array<int>, ids array<int>"


def _runs(batches, block: Block):
    """starts: word positions of the runs; ids: their word ids, each run closed by a 0."""
    get = block.vocabulary.get
    for batch in slices(batches, "text"):
        found, n = [], []
        for t in raw(batch.column(3)):
            ws = words(t)
            n.append(len(ws))
            found.append(np.fromiter(map(get, ws, repeat(0)), np.int32, len(ws)))
            found.append(np.zeros(1, np.int32))
        n = np.array(n, np.int64)
        ids = np.concatenate(found)
        first = np.cumsum(n + 1) - n - 1
        inside = np.concatenate([[0], (ids > 0).astype(np.int8)])
        edge = np.diff(inside)
        begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a 0 closes every text
        long = end - begin >= block.shortest
        begin, end = begin[long], end[long]
        doc = np.searchsorted(first, begin, "right") - 1
        size = end - begin + 1  # with the closing 0
        take = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(size.sum())
        per_doc = np.bincount(doc, minlength=len(n))
        per_id = np.bincount(doc, weights=size, minlength=len(n)).astype(np.int64)
        at = lambda x: pa.array(np.concatenate([[0], np.cumsum(x)]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), batch.column(2), pa.array(n),
             pa.ListArray.from_arrays(at(per_doc), pa.array((begin - first[doc]).astype(np.int32))),
             pa.ListArray.from_arrays(at(per_id), pa.array(ids[take]))],
            ["rid_file", "rid_row", "doc_id", "n_words", "starts", "ids"])


def _count(batches, block: Block):
    totals = {k: np.zeros(len(s), np.int64) for k, s in block.shingles.items()}
    for batch in batches:
        ids = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        for k, known in block.shingles.items():
            if len(known):
                keys = block.run_keys(ids, k)
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                totals[k] += np.bincount(at[known[at] == keys], minlength=len(known))
    for k, n in totals.items():
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), k, np.int32)), pa.array(some), pa.array(n[some])],
                                         ["width", "nth", "n"])


FOUND = ("rid_file bigint, rid_row bigint, doc_id bigint, n_words bigint, "
         "spans array<struct<first: int, last: int>>, items array<bigint>")


#: Word ids, or pairs of a document and an item, that a task holds at a time (one document at least).
HELD = 1_000_000


def _cuts(sizes: np.ndarray, held: int) -> list[tuple[int, int]]:
    """Neighbouring rows whose sizes add up to ``held`` at most (one row at least)."""
    out, start, n = [], 0, 0
    for i, size in enumerate(sizes.tolist()):
        if n and n + size > held:
            out.append((start, i))
            start, n = i, 0
        n += size
    return [*out, (start, len(sizes))] if len(sizes) else out


def _parts(batches, column: int):
    for batch in batches:
        for lo, hi in _cuts(batch.column(column).value_lengths().to_numpy(zero_copy_only=False), HELD):
            yield batch.slice(lo, hi - lo)


def _match(batches, block: Block, index):
    for batch in _parts(batches, 5):
        id_list, start_list = batch.column(5), batch.column(4)
        bounds = id_list.offsets.to_numpy().astype(np.int64)
        bounds = bounds - bounds[0]
        ids = id_list.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        doc_of = lambda p: np.searchsorted(bounds, p, "right") - 1
        # word position of each id in its document
        begins = np.flatnonzero(np.concatenate([[True], ids[:-1] == 0])) if len(ids) else np.zeros(0, np.int64)
        starts = start_list.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        size = np.diff(np.append(begins, len(ids)))
        position = np.repeat(starts - begins, size) + np.arange(len(ids))
        hits, wins = [], []
        for k, (keys, rows, at) in index.items():
            run = block.run_keys(ids, k)
            lo, hi = np.searchsorted(keys, run, "left"), np.searchsorted(keys, run, "right")
            pos = np.flatnonzero((hi > lo) & (run >= 0))
            n = (hi - lo)[pos]
            entry = np.repeat(lo[pos] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            begin, win = np.repeat(pos, n) - at[entry], rows[entry]
            fits = (begin >= 0) & (begin + block.lengths[win] <= len(ids))
            begin, win = begin[fits], win[fits]
            for j in range(block.width):  # ids of 0 close every run, so a match never leaves it
                live = block.lengths[win] > j
                same = ~live | (ids[np.minimum(begin + j, len(ids) - 1)] == block.windows[win, j])
                begin, win = begin[same], win[same]
            hits.append(begin)
            wins.append(win)
        begin = np.concatenate(hits) if hits else np.zeros(0, np.int64)
        win = np.concatenate(wins) if wins else np.zeros(0, np.int64)
        cover = np.zeros(len(ids) + 1, np.int64)
        np.add.at(cover, begin, 1)
        np.add.at(cover, begin + block.lengths[win], -1)
        edge = np.diff(np.concatenate([[0], (np.cumsum(cover) > 0).astype(np.int8)]))
        first, last = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        rows = batch.num_rows
        at = lambda x, n: np.concatenate([[0], np.cumsum(np.bincount(x, minlength=n))]).astype(np.int32)
        bound = at(doc_of(first), rows)
        spans = pa.ListArray.from_arrays(pa.array(bound), pa.StructArray.from_arrays(
            [pa.array(position[first].astype(np.int32)), pa.array((position[last - 1] + 1).astype(np.int32))], ["first", "last"]))
        # each set of items once a document, and only then its items
        wide = len(block.item_at)
        doc, owned = np.divmod(np.unique(doc_of(begin) * wide + block.set_of[win]), wide)
        size = np.diff(block.item_at)[owned]
        for lo, hi in _cuts(np.bincount(doc, weights=size, minlength=rows).astype(np.int64), HELD):
            a, b = np.searchsorted(doc, [lo, hi])
            n = size[a:b]
            take = np.repeat(block.item_at[owned[a:b]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            order = np.lexsort((block.items[take], np.repeat(doc[a:b] - lo, n)))
            of, item = np.repeat(doc[a:b] - lo, n)[order], block.items[take][order]
            new = np.append(True, (np.diff(of) > 0) | (np.diff(item) != 0))[:len(of)]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(i).slice(lo, hi - lo) for i in range(4)), spans.slice(lo, hi - lo),
                 pa.ListArray.from_arrays(pa.array(at(of[new], hi - lo)), pa.array(item[new]))],
                ["rid_file", "rid_row", "doc_id", "n_words", "spans", "items"])


def _merge(batches):
    for batch in batches:
        out = []
        for spans in batch.column(4).to_pylist():
            done = []
            for s in sorted((x["first"], x["last"]) for x in spans):
                if done and s[0] <= done[-1][1]:
                    done[-1][1] = max(done[-1][1], s[1])
                else:
                    done.append(list(s))
            out.append([{"first": a, "last": b} for a, b in done])
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(4)), pa.array(out, kind), batch.column(5)],
                                         ["rid_file", "rid_row", "doc_id", "n_words", "spans", "items"])


def contamination(docs: DataFrame, benchmark: DataFrame, width: int = WIDTH, block_words: int = BLOCK_WORDS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """One row per document row: rid_file, rid_row, doc_id, n_words, spans (hit word
    ranges, end exclusive, disjoint) and items (sorted ids)."""
    sc = docs.sparkSession.sparkContext
    rows = identified(docs, id_col, text_col)
    rows = rows.select(*ROW_ID, F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    found: list[DataFrame] = []

    def scan(block: Block) -> DataFrame:
        shared = sc.broadcast(block)
        runs = stored(rows.mapInArrow(lambda b: _runs(b, shared.value), RUNS), "benchmark-runs")
        counts = {k: np.zeros(len(s), np.int64) for k, s in block.shingles.items()}
        per = (runs.select("ids").mapInArrow(lambda b: _count(b, shared.value), "width int, nth bigint, n bigint")
               .groupBy("width", "nth").agg(F.sum("n").alias("n")))
        for r in per.toLocalIterator():  # one row per shingle of the block at most
            counts[r["width"]][r["nth"]] = r["n"]
        index = sc.broadcast(block.index(counts))
        return runs.mapInArrow(lambda b: _match(b, shared.value, index.value), FOUND)

    for block in blocks(benchmark, width, block_words, item_col, item_text_col):
        found.append(scan(block))
    if not found:
        found.append(scan(Block([], width)))
    if len(found) == 1:
        return found[0]
    every = found[0]
    for f in found[1:]:
        every = every.unionByName(f)
    return (every.groupBy(*ROW_ID).agg(
        F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"),
        F.flatten(F.collect_list("spans")).alias("spans"),
        F.sort_array(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
        .select("rid_file", "rid_row", "doc_id", "n_words", "spans", "items").mapInArrow(_merge, FOUND))

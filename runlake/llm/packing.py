"""Operator 8: best-fit packing of token pieces by linear grouping.

Documents are encoded and closed with an end id; longer ones are cut into pieces
of one sequence, the first piece taking the remainder. What is then planned is
the histogram of piece lengths alone (at most ``capacity`` numbers, whatever the
corpus): large lengths are sorted, split into groups of equal cardinality and
rounded up to the group's largest; a configuration program over these few sizes
(column generation: a master of one row per group, priced by a knapsack) says how
many sequences of each pattern to open; actual lengths take the slots of their
group, and what is left, mostly small pieces, goes best-fit into the gaps, longest
first. The plan is a list of runs - "the next n pieces of length l, k per sequence,
from sequence s on" - and Spark deals pieces to runs by their rank among pieces of
equal length. Ranks come from per-task counts, so no length is ranked in one task.

Edge cases: a null or empty text is the end id alone; null and repeated document
ids are packed like others; an empty table gives no rows; columns other than the
two named are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import slices, stored
from runlake.llm.tokens import encoder

CAPACITY = 1024
GROUPS = 64
#: Lengths above capacity / LARGE_SHARE are grouped.
LARGE_SHARE = 8


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 2000) -> list[tuple[np.ndarray, float]]:
    """Patterns (pieces of each size) and how often to use each: the linear
    relaxation of the configuration program, solved by column generation."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    passes = [(i, int(s)) for i, s in enumerate(sizes) for _ in range(capacity // s)]
    inverse = np.linalg.inv(basis)
    for turn in range(rounds):
        if turn % 25 == 24:
            inverse = np.linalg.inv(basis)
        price = inverse.sum(axis=0)  # dual values: 1 * B^-1
        best, took = np.zeros(capacity + 1), np.zeros((len(passes), capacity + 1), bool)
        for p, (i, s) in enumerate(passes):
            if price[i] > 0:
                other = best[:-s] + price[i]
                took[p, s:] = other > best[s:] + 1e-12
                best[s:] = np.maximum(best[s:], other)
        if best[capacity] <= 1 + 1e-7:
            break
        column, room = np.zeros(k), capacity
        for p in range(len(passes) - 1, -1, -1):
            if took[p, room]:
                column[passes[p][0]] += 1
                room -= passes[p][1]
        amount, step = inverse @ demand, inverse @ column
        ratio = np.where(step > 1e-9, np.maximum(amount, 0) / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        basis[:, leave] = column
        pivot = inverse[leave] / step[leave]
        inverse = inverse - np.outer(step, pivot)
        inverse[leave] = pivot
    amount = np.linalg.solve(basis, demand)
    return [(basis[:, j].astype(int), float(a)) for j, a in enumerate(amount) if a > 0]


class Runs:
    """The growing plan: runs of equal gaps, and for each length the runs that take it."""

    def __init__(self, capacity: int):
        self.capacity, self.opened = capacity, 0
        self.taken: dict[int, int] = {}
        self.rows: list[tuple[int, int, int, int, int]] = []  # length, first rank, first sequence, per sequence, offset
        self.gaps: dict[int, list[tuple[int, int]]] = {}  # gap: (first sequence, sequences)
        self.mask = 0

    def open(self, n: int) -> int:
        self.opened += n
        return self.opened - n

    def put(self, length: int, first: int, sequences: int, each: int, gap: int) -> None:
        """``each`` pieces into each of the sequences, all of this gap."""
        rank = self.taken.get(length, 0)
        self.rows.append((length, rank, first, each, self.capacity - gap))
        self.taken[length] = rank + sequences * each

    def leave(self, gap: int, first: int, sequences: int) -> None:
        if gap and sequences:
            self.gaps.setdefault(gap, []).append((first, sequences))
            self.mask |= 1 << gap

    def best_fit(self, length: int, n: int) -> None:
        while n:
            fits = self.mask >> length
            if fits:
                gap = length + (fits & -fits).bit_length() - 1
                first, sequences = self.gaps[gap].pop()
                if not self.gaps[gap]:
                    del self.gaps[gap]
                    self.mask &= ~(1 << gap)
            else:
                gap = self.capacity
                sequences = -(-n // (gap // length))
                first = self.open(sequences)
            each = gap // length
            full = min(sequences, n // each)
            if full:
                self.put(length, first, full, each, gap)
                self.leave(gap - each * length, first, full)
                n -= full * each
            if full < sequences:
                rest, some = sequences - full, min(n, each)
                if some:  # the last ones, fewer than fit
                    self.put(length, first + full, 1, some, gap)
                    self.leave(gap - some * length, first + full, 1)
                    n, rest, full = n - some, rest - 1, full + 1
                self.leave(gap, first + full, rest)


def plan(counts: np.ndarray, capacity: int = CAPACITY, groups: int = GROUPS) -> tuple[np.ndarray, int]:
    """The plan with the fewest sequences among those of ``groups`` groups, of a quarter
    and of one and a half times as many: more round less, fewer leave fewer patterns unfinished."""
    tried = [grouped_plan(counts, capacity, g) for g in (groups, max(groups // 4, 1), groups * 3 // 2)]
    return min(tried, key=lambda t: t[1])


def grouped_plan(counts: np.ndarray, capacity: int, groups: int) -> tuple[np.ndarray, int]:
    """Runs (length, first rank, first sequence, per sequence, offset) for the
    histogram ``counts`` (index: length), and the number of sequences."""
    left, runs = counts.astype(np.int64).copy(), Runs(capacity)
    if left[capacity]:
        n = int(left[capacity])
        runs.put(capacity, runs.open(n), n, 1, capacity)
        left[capacity] = 0
    large = np.arange(capacity // LARGE_SHARE + 1, capacity)
    total = int(left[large].sum())
    if total and groups:
        cumulative = np.cumsum(left[large])
        # group g: ranks [edges[g], edges[g + 1]) of the large pieces by length
        edges = np.unique((np.arange(groups + 1) * total) // groups)
        if np.count_nonzero(left[large]) <= groups:  # a group a length: nothing to round
            edges = np.unique(np.append(0, cumulative))
        sizes = large[np.searchsorted(cumulative, edges[1:])]
        queues: dict[int, list[list[int]]] = {}
        for lo, hi, size in zip(edges[:-1], edges[1:], sizes):
            i, at = int(np.searchsorted(cumulative, lo, side="right")), int(lo)
            while at < hi:
                n = min(int(cumulative[i]), int(hi)) - at
                if n > 0:
                    queues.setdefault(int(size), []).append([int(large[i]), n])
                at, i = at + max(n, 0), i + 1
        rounded = np.array(sorted(queues))
        demand = np.array([sum(n for _, n in queues[int(s)]) for s in rounded], float)
        for pattern, amount in configurations(rounded, demand, capacity):
            n = int(amount + 1e-6)
            if not n:
                continue
            held = [(runs.open(n), n, capacity)]  # first sequence, sequences, gap
            for g in np.flatnonzero(pattern)[::-1]:
                queue = queues[int(rounded[g])]
                for _ in range(pattern[g]):
                    after = []
                    for first, sequences, gap in held:
                        while sequences and queue:
                            length, there = queue[-1]
                            m = min(there, sequences)
                            runs.put(length, first, m, 1, gap)
                            left[length] -= m
                            after.append((first, m, gap - length))
                            first, sequences = first + m, sequences - m
                            queue[-1][1] -= m
                            if not queue[-1][1]:
                                queue.pop()
                        if sequences:  # rounding asked for more than there are
                            after.append((first, sequences, gap))
                    held = after
            for first, sequences, gap in held:
                runs.leave(gap, first, sequences)
    for length in range(capacity, 0, -1):
        if left[length]:
            runs.best_fit(length, int(left[length]))
    rows = np.array(runs.rows, np.int64).reshape(-1, 5)
    return rows[np.lexsort((rows[:, 1], rows[:, 0]))], runs.opened


PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, task int, nth bigint"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY, keep_ids: bool = False,
                 id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece with its digest; ``ids`` holds the tokens when ``keep_ids``.
    ``task, nth``: the piece is the nth of its length that this task made."""

    def cut(batches):
        coder, task = encoder(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in slices(batches, "text", 12 << 20):
            ids, at = coder.encode(batch.column(1))
            full = np.insert(ids, at[1:], np.uint32(end_id))
            m = batch.num_rows
            bounds = at + np.arange(m + 1)
            n = np.diff(bounds)
            head = (n - 1) % capacity + 1
            pieces = (n - head) // capacity + 1
            row = np.repeat(np.arange(m), pieces)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
            start = np.where(piece > 0, head[row] + (piece - 1) * capacity, 0)
            length = np.where(piece > 0, capacity, head[row])
            begin = bounds[row] + start
            data = memoryview(np.ascontiguousarray(full, "<u4")).cast("B")
            crc = [zlib.crc32(data[4 * b:4 * (b + s)]) for b, s in zip(begin.tolist(), length.tolist())]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            nth = np.empty(len(row), np.int64)
            nth[order] = np.arange(len(row)) - np.searchsorted(ordered, ordered) + seen[ordered]
            seen += np.bincount(length, minlength=capacity + 1)
            columns = [batch.column(0).take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start), pa.array(length),
                       pa.array(crc, pa.int64()), pa.array(np.full(len(row), task, np.int32)), pa.array(nth)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"]
            if keep_ids:
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(begin, bounds[-1]).astype(np.int32)),
                                                        pa.array(full.astype(np.int32))))
                names.append("ids")
            for lo in range(0, len(row), 20_000):
                yield pa.RecordBatch.from_arrays([c.slice(lo, 20_000) for c in columns], names)

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(cut, PIECES + (", ids array<int>" if keep_ids else ""))


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to pieces that carry length, task and nth.
    ``pieces`` must be a stored table: its rows are read twice."""
    per_task = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))
    per_length = per_task.groupBy("length").agg(F.sum("n").alias("n"))
    counts = np.zeros(capacity + 1, np.int64)
    for r in per_length.collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    rows, _ = plan(counts, capacity, groups)
    # bounded by groups, patterns and lengths (some thousands), whatever the corpus
    shared = pieces.sparkSession.sparkContext.broadcast(rows)
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = per_task.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = pieces.join(bases, ["length", "task"])
    keep = [c for c in pieces.columns if c not in ("task", "nth")]

    def place(batches):
        runs = shared.value
        wide = int(runs[:, 1].max(initial=0)) + 1
        for batch in batches:
            if not batch.num_rows:
                continue
            col = {n: batch.column(batch.schema.get_field_index(n)) for n in batch.schema.names}
            length = col["length"].to_numpy().astype(np.int64)
            rank = col["nth"].to_numpy() + col["base"].to_numpy()
            # runs are ordered by (length, first rank)
            lo = np.searchsorted(runs[:, 0], length, "left")
            hi = np.searchsorted(runs[:, 0], length, "right")
            key = runs[:, 0] * wide + runs[:, 1]
            at = np.minimum(np.searchsorted(key, length * wide + np.minimum(rank, wide - 1), "right") - 1, hi - 1)
            at = np.maximum(at, lo)
            nth, each = rank - runs[at, 1], runs[at, 3]
            yield pa.RecordBatch.from_arrays(
                [*(col[c] for c in keep), pa.array(runs[at, 2] + nth // each), pa.array(runs[at, 4] + nth % each * length)],
                [*keep, "sequence_id", "offset"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema.fields if f.name in keep)
    return ranked.mapInArrow(place, f"{fields}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", end_id: int = 2, capacity: int = CAPACITY,
                   groups: int = GROUPS, keep_ids: bool = False) -> DataFrame:
    """Documents to placed pieces: doc_id, piece, start, length, ids_crc32 (and ids),
    sequence_id, offset."""
    pieces = stored(token_pieces(docs, tokenizer, end_id, capacity, keep_ids), "pieces")
    return pack_pieces(pieces, capacity, groups)

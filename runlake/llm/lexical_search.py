"""Operator 11: ranked lexical search of many queries that share their work.

A document's score for an item is the sum, over the item's terms, of a contribution that
depends on the term and the document alone. Items share terms, and sets of terms, so the
sums share parts:

1. ``query_plan`` mines the sets: the pairs of nodes that most items hold become new nodes,
   round after round, until no pair is left in two items. The result is a DAG: terms at the
   bottom, shared sets above them, items on top.
2. One pass over the documents keeps each one's length and the counts of query terms. Their
   totals give N, L and the terms' document frequencies.
3. In blocks of documents, each node's accumulator (its partial score in every document of
   the block) is computed once, level by level, and the items add up their nodes'.

All arithmetic is in 64-bit integers; each task keeps an item's ``k`` best documents, and two
rounds of ranking, the first dealt by a hash of the document, merge the tasks' lists.

The items are the stated query set: they are read in blocks of ``block_words`` words, each
shipped whole, so what is broadcast is bounded by that parameter.

Edge cases: a null or empty text has no terms and counts for nothing; an item without terms,
or whose terms occur nowhere, has no rows; repeated items are ranked each for itself, repeated
document rows are documents each; a null document id comes last among equal scores; an empty
table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import reduce
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlake.llm.common import raw, slices, stored
from runlake.llm.decontam import words

BLOCK_WORDS = 50_000
TOP = 10
#: Pairs are counted among so many neighbours in an item's list of nodes, the widest shared first.
REACH = 64
COUNTS = "doc_id bigint, n bigint, terms array<int>, times array<int>"
BEST = "nth bigint, item_id {id}, doc_id bigint, score bigint"


class Plan:
    """Nodes 0 .. n_terms - 1 are terms; node n_terms + i adds up ``pairs[i]``, two earlier
    nodes; ``tops`` are the nodes that each item adds up."""

    def __init__(self, n_terms: int, pairs: list[tuple[int, int]], tops: list[list[int]]):
        self.n_terms, self.tops = n_terms, tops
        depth = [0] * n_terms
        for a, b in pairs:
            depth.append(1 + max(depth[a], depth[b]))
        of = np.array(depth[n_terms:], np.int64)
        both = np.array(pairs, np.int64).reshape(-1, 2)
        self.levels = [(n_terms + at, both[at, 0], both[at, 1]) for d in range(1, max(depth, default=0) + 1)
                       if len(at := np.flatnonzero(of == d))]
        self.n_nodes = len(depth)
        self.filled = np.flatnonzero([len(t) > 0 for t in tops])
        self.flat = np.array([x for t in tops for x in t], np.int64)
        self.at = np.cumsum([0] + [len(tops[i]) for i in self.filled])[:-1].astype(np.int64)

    def scores(self, contributions: np.ndarray) -> np.ndarray:
        """Scores (filled item, document) from contributions (term, document)."""
        total = np.zeros((self.n_nodes, contributions.shape[1]), np.int64)
        total[:self.n_terms] = contributions
        for into, a, b in self.levels:
            total[into] = total[a] + total[b]
        return np.add.reduceat(total[self.flat], self.at) if len(self.flat) else np.zeros((0, contributions.shape[1]), np.int64)


def query_plan(items: list[set[int]], n_terms: int, reach: int = REACH) -> Plan:
    """Share what two items or more have in common."""
    held, pairs = [set(i) for i in items], []
    while True:
        spread = Counter(x for h in held for x in h)
        together: Counter = Counter()
        for h in held:
            shared = sorted((x for x in h if spread[x] > 1), key=lambda x: (-spread[x], x))
            for i, a in enumerate(shared):
                together.update((a, b) if a < b else (b, a) for b in shared[i + 1:i + reach])
        where: dict[int, list[int]] = {}
        for i, h in enumerate(held):
            for x in h:
                where.setdefault(x, []).append(i)
        before = len(pairs)
        for (a, b), n in sorted(together.items(), key=lambda x: (-x[1], x[0])):
            if n < 2:
                break
            both = [i for i in min(where[a], where[b], key=len) if a in held[i] and b in held[i]]
            if len(both) > 1:
                for i in both:
                    held[i] -= {a, b}
                    held[i].add(n_terms + len(pairs))
                pairs.append((a, b))
        if len(pairs) == before:
            return Plan(n_terms, pairs, [sorted(h) for h in held])


def _blocks(items: DataFrame, id_col: str, text_col: str, block_words: int):
    held, n = [], 0
    for r in items.select(id_col, text_col).toLocalIterator():
        terms = words((r[1] or "").encode())
        held.append((r[0], set(terms)))
        n += len(terms)
        if n >= block_words:
            yield held
            held, n = [], 0
    if held:
        yield held


def _counts(batches, vocabulary: dict[bytes, int]):
    get, size = vocabulary.get, len(vocabulary)
    for batch in slices(batches, "text"):
        n, found = [], []
        for t in raw(batch.column(1)):
            ws = words(t)
            n.append(len(ws))
            found.append(np.fromiter(map(get, ws, repeat(-1)), np.int64, len(ws)))
        doc = np.repeat(np.arange(len(n)), n)
        ids = np.concatenate(found)
        hit = ids >= 0
        keys, times = np.unique(doc[hit] * size + ids[hit], return_counts=True)
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(keys // size if size else keys, minlength=len(n)))]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array(n, pa.int64()), pa.ListArray.from_arrays(at, pa.array((keys % max(size, 1)).astype(np.int32))),
             pa.ListArray.from_arrays(at, pa.array(times.astype(np.int32)))], ["doc_id", "n", "terms", "times"])


def _frequencies(batches, size: int):
    total = np.zeros(size, np.int64)
    for batch in batches:
        total += np.bincount(batch.column(0).flatten().to_numpy(zero_copy_only=False), minlength=size)
    some = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["term", "df"])


def _best(batches, plan: Plan, weight: np.ndarray, documents: int, length: int, ids: pa.Array, k: int):
    """The ``k`` best documents of every item in this task."""
    width = max(1, (4 << 20) // max(1, plan.n_nodes + len(plan.flat)))  # documents a block: about 64 MB of accumulators
    n_items = len(plan.filled)
    least = np.ones(n_items, np.int64)  # a score above 0
    held = [np.zeros(0, np.int64)] * 4  # item, score, document, whether its id is null

    def keep_best(parts):
        item, score, doc, none = (np.concatenate(p) for p in zip(*parts))
        order = np.lexsort((doc, none, -score, item))
        item, score, doc, none = item[order], score[order], doc[order], none[order]
        nth = np.arange(len(item)) - np.searchsorted(item, item, "left")
        full = nth == k - 1
        least[item[full]] = score[full]
        keep = nth < k
        return [item[keep], score[keep], doc[keep], none[keep]]

    for batch in batches:
        known = batch.filter(pa.compute.greater(pa.compute.list_value_length(batch.column(2)), 0))
        docs = known.column(0)
        doc = docs.fill_null(0).to_numpy(zero_copy_only=False)
        none = docs.is_null().to_numpy(zero_copy_only=False).astype(np.int64)
        m = 10 + 90 * known.column(1).to_numpy(zero_copy_only=False) * documents // length if length else None
        per = known.column(2).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        terms = known.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        times = known.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(per)
        for lo in range(0, len(per), width):
            hi = min(lo + width, len(per))
            a, b = (ends[lo] - per[lo], ends[hi - 1])
            row = np.repeat(np.arange(hi - lo), per[lo:hi])
            parts = np.zeros((plan.n_terms, hi - lo), np.int64)
            parts[terms[a:b], row] = weight[terms[a:b]] * (1_000_000_000 * times[a:b] // (1000 * times[a:b] + 8 * m[lo + row]))
            score = plan.scores(parts)
            item, at = np.nonzero(score >= least[:, None])
            held = keep_best([held, [item, score[item, at], doc[lo + at], none[lo + at]]])
    item, score, doc, none = held
    nth = plan.filled[item] if n_items else item
    yield pa.RecordBatch.from_arrays([pa.array(nth, pa.int64()), ids.take(pa.array(nth, pa.int64())), pa.array(doc, mask=none > 0),
                                      pa.array(score)], ["nth", "item_id", "doc_id", "score"])


def ranked_search(docs: DataFrame, items: DataFrame, k: int = TOP, block_words: int = BLOCK_WORDS,
                  id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text") -> DataFrame:
    """Each item's ``k`` best documents: item_id, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    sc = spark.sparkContext
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    id_type = items.schema[item_col].dataType.simpleString()

    def search(block: list, first: int) -> DataFrame:
        vocabulary = {t: i for i, t in enumerate(sorted(set().union(*(terms for _, terms in block))))}
        plan = query_plan([{vocabulary[t] for t in terms} for _, terms in block], len(vocabulary))
        shared = sc.broadcast(vocabulary)
        counts = stored(rows.mapInArrow(lambda b: _counts(b, shared.value), COUNTS), "query-terms")
        total = counts.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
        size, df = len(vocabulary), np.zeros(len(vocabulary), np.int64)
        per = (counts.select("terms").mapInArrow(lambda b: _frequencies(b, size), "term bigint, df bigint")
               .groupBy("term").agg(F.sum("df").alias("df")))
        for r in per.toLocalIterator():  # a row per term of the block at most
            df[r["term"]] = r["df"]
        n, length = total["documents"], total["length"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        ids = pa.array([i for i, _ in block], type=_arrow(items, item_col))
        known = sc.broadcast((plan, weight, ids))
        best = counts.mapInArrow(lambda b: _best(b, known.value[0], known.value[1], n, length, known.value[2], k),
                                 BEST.format(id=id_type))
        return best.withColumn("nth", F.col("nth") + first)

    found, n = [], 0
    for block in _blocks(items, item_col, item_text_col, block_words):
        found.append(search(block, n))
        n += len(block)
    if not found:
        return spark.createDataFrame([], f"item_id {id_type}, rank int, doc_id bigint, score bigint")
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    every = reduce(DataFrame.unionAll, found).withColumn("deal", F.pmod(F.xxhash64("doc_id"), F.lit(64)))
    first = (every.withColumn("place", F.row_number().over(Window.partitionBy("nth", "deal").orderBy(*order)))
             .filter(F.col("place") <= k))
    return (first.withColumn("rank", F.row_number().over(Window.partitionBy("nth").orderBy(*order)))
            .filter(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score"))


def _arrow(df: DataFrame, column: str) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type
    return to_arrow_type(df.schema[column].dataType)

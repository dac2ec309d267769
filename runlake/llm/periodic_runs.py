"""Operator 13: periodic runs by recompression.

A run is a stretch of words with smallest period q, at least ``exponent`` (four) periods and
``least`` (six) words long, that no neighbouring word extends. Documents are dealt by Spark;
inside a task the texts of a slice become one sequence of word numbers, each text between
symbols of its own, and

1. recompression makes a run-length grammar of the sequence (``recompression.Grammar``);
2. a stretch of period q agrees with itself q words on at ``(exponent - 1) * q`` places in a
   row, so one of them lies on the grid of that step: the candidates are the grid's places
   where the words agree, n / 3q for each q, a harmonic sum;
3. the grammar's extensions, forwards and backwards, give each candidate's exact ends; a
   stretch found with several periods keeps the smallest.

Memory follows the slice (about ``SLICE`` bytes of text, or one longer text whole).

Edge cases: a null, empty or blank text has no words, no runs and an empty collapsed text;
a text of one repeated word is one run of period 1; repeated rows each get their row; an
empty table gives no rows; columns other than the two named are not read.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.llm.common import raw, slices
from runlake.llm.recompression import Grammar

EXPONENT, LEAST = 4, 6
SLICE = 4 << 20
FOUND = "doc_id {id}, n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string"


def find_runs(texts: list[np.ndarray], exponent: int = EXPONENT, least: int = LEAST) -> tuple[np.ndarray, ...]:
    """Text, start, length and period of every run of sequences of numbers from 0 on, by text,
    start and period."""
    n = np.fromiter(map(len, texts), np.int64, len(texts))
    order = np.argsort(-n, kind="stable")  # long texts first: those that have room for q are a prefix
    size = n[order]
    begin = np.cumsum(size + 1) - size  # a symbol of its own before each text, and one at the end
    total = int(size.sum() + len(size) + 1)
    symbols = np.empty(total, np.int64)
    bounds = np.append(begin - 1, total - 1)
    top = max((int(t.max()) for t in texts if len(t)), default=-1) + 1
    symbols[bounds] = top + np.arange(len(bounds))
    inside = np.ones(total, bool)
    inside[bounds] = False
    symbols[inside] = np.concatenate([texts[i] for i in order]) if len(texts) else []
    at, period = _candidates(symbols.astype(np.int32), begin, size, exponent, least)
    none = np.zeros(0, np.int64)
    if not len(at):
        return none, none, none, none
    grammar = Grammar(symbols)
    after = grammar.extension(at, at + period)
    before = grammar.extension_back(at - 1, at + period - 1)
    start, length = at - before, before + after + period
    fits = length >= np.maximum(least, exponent * period)
    start, length, period = start[fits], length[fits], period[fits]
    by = np.lexsort((period, length, start))
    start, length, period = start[by], length[by], period[by]
    one = np.append(True, (np.diff(start) > 0) | (np.diff(length) > 0))[:len(start)]  # the smallest period of a stretch
    start, length, period = start[one], length[one], period[one]
    slot = np.searchsorted(begin, start, "right") - 1
    text, start = order[slot], start - begin[slot]
    by = np.lexsort((period, start, text))
    return text[by], start[by], length[by], period[by]


def _candidates(symbols: np.ndarray, begin: np.ndarray, size: np.ndarray, exponent: int, least: int):
    """Places on each period's grid that agree with the word a period on."""
    found, periods = [], []
    room = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 2), "right")  # texts of at least so many words
    q = 1
    while len(size) and max(least, exponent * q) <= size[0]:
        last = int(room[max(least, exponent * q)]) - 1
        end = int(begin[last] + size[last])
        step = max(least, exponent * q) - q
        hit = np.flatnonzero(symbols[:end - q:step] == symbols[q:end:step])
        if len(hit):
            found.append(hit * step)
            periods.append(np.full(len(hit), q, np.int64))
        q += 1
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found), np.concatenate(periods)


def _numbered(texts: list[list[bytes]]) -> list[np.ndarray]:
    number: dict[bytes, int] = {}
    for w in chain.from_iterable(texts):
        number.setdefault(w, len(number))
    return [np.fromiter(map(number.__getitem__, t), np.int64, len(t)) for t in texts]


def periodic_runs(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST,
                  rewrite: Callable[[int | None, int], np.ndarray | None] | None = None,
                  id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row: doc_id, n_words, runs by start and period, and the collapsed text: the
    words joined by one space without those that a run holds after its first period.
    ``rewrite(doc_id, n)`` may give word numbers to take in place of 0 .. n - 1."""
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    id_type = rows.schema["doc_id"].dataType.simpleString()
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def search(batches):
        for batch in slices(batches, "text", SLICE):
            ids, words = batch.column(0), [t.split() for t in raw(batch.column(1))]  # bytes split at \x20 and \x09-\x0D
            if rewrite is not None:
                for k, i in enumerate(ids.to_pylist()):
                    take = rewrite(i, len(words[k]))
                    if take is not None:
                        words[k] = list(map(words[k].__getitem__, take.tolist()))
            n = np.fromiter(map(len, words), np.int64, len(words))
            text, start, length, period = find_runs(_numbered(words), exponent, least)
            per = np.bincount(text, minlength=len(words))
            bounds = np.concatenate([[0], np.cumsum(per)]).astype(np.int32)
            for k in np.flatnonzero(per):
                keep = np.ones(len(words[k]), bool)
                for r in range(bounds[k], bounds[k + 1]):
                    keep[start[r] + period[r]:start[r] + length[r]] = False
                words[k] = [w for w, stay in zip(words[k], keep.tolist()) if stay]
            yield pa.RecordBatch.from_arrays(
                [ids, pa.array(n), pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays(
                    [pa.array(start), pa.array(length), pa.array(period)], fields=list(kind.value_type))),
                 pa.array([b" ".join(w) for w in words], pa.binary()).cast(pa.string())],
                ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(search, FOUND.format(id=id_type))


def best_run(runs: Column) -> Column:
    """The run of the greatest exact length / period; of equals the first; null without runs."""
    return F.aggregate(runs, F.get(runs, F.lit(0)),
                       lambda b, r: F.when(r["length"] * b["period"] > b["length"] * r["period"], r).otherwise(b))

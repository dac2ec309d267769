"""Skew-safe ordered operations per key.

A plain ``Window.partitionBy(key).orderBy(...)`` puts every row of a key into
one task; a run that holds a third of all log lines would then be one task.
These helpers split each key into chunks of its ordering (a column that never
decreases along the order, e.g. the hour of the timestamp or ``line_no // n``),
work inside (key, chunk) and add per-chunk offsets computed on the small table
of chunk totals. Results equal the plain window functions.

Neighbour access (lag/lead) is an equi-join on (key, ordinal ± 1), so a hot key
is hash-spread by its ordinal instead of landing in one partition.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _names(keys: str | Sequence[str]) -> list[str]:
    return [keys] if isinstance(keys, str) else list(keys)


def _group(keys: list[str]) -> Column:
    """(key..., chunk) as one non-null struct: windows partition and the offset
    join matches on it, so null keys group like any value and the optimizer
    infers no not-null filter for one side only (which would stop the two
    branches over the same input from sharing their shuffle)."""
    return F.struct(*[F.col(k) for k in keys], F.col("__chunk").alias("__chunk"))


def _attach_offsets(d: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``d`` has __g (the group struct), __chunk, __local and __tot (the
    chunk's total, from the same window partitioning). Per key, prefix-sum the
    chunk totals on the table of distinct groups and add the offset to
    ``__local``.

    The distinct and the join both use __g, the partitioning ``d`` already has
    after its window, so the big side is not shuffled again; only the offsets
    table (one narrow row per key and chunk) moves, or is broadcast when AQE
    finds it small.
    """
    totals = d.select("__g", "__tot").dropDuplicates(["__g"])
    key_struct = F.struct(*[F.col("__g")[k].alias(k) for k in keys])
    w_chunks = (Window.partitionBy(key_struct).orderBy(F.col("__g")["__chunk"])
                .rowsBetween(Window.unboundedPreceding, -1))
    offsets = totals.select("__g", F.coalesce(F.sum("__tot").over(w_chunks), F.lit(0)).alias("__off"))
    out = d.join(offsets, "__g", "left")
    return (out.withColumn(name, (F.coalesce(F.col("__off"), F.lit(0)) + F.col("__local")).cast("bigint"))
            .drop("__g", "__chunk", "__local", "__tot", "__off"))


def prefix_sum(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str],
               value: Column, chunk: Column, name: str, inclusive: bool = True) -> DataFrame:
    """Add ``name`` = running sum of ``value`` per ``keys`` along ``order``.

    ``inclusive=False`` sums strictly preceding rows (0 for the first row).
    ``chunk`` must be non-decreasing along ``order`` within a key.
    """
    keys = _names(keys)
    d = df.withColumn("__chunk", chunk).withColumn("__v", value).withColumn("__g", _group(keys))
    w = Window.partitionBy("__g")
    end = Window.currentRow if inclusive else -1
    d = (d.withColumn("__local", F.coalesce(
        F.sum("__v").over(w.orderBy(*order).rowsBetween(Window.unboundedPreceding, end)), F.lit(0)))
        .withColumn("__tot", F.sum("__v").over(w))
        .drop("__v"))
    return _attach_offsets(d, keys, name)


def ordinal(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column | str],
            chunk: Column, name: str = "ordinal") -> DataFrame:
    """``row_number() over (partition by keys order by order)`` as a bigint,
    computed per (key, chunk) plus the count of rows in earlier chunks."""
    keys = _names(keys)
    d = df.withColumn("__chunk", chunk).withColumn("__g", _group(keys))
    w = Window.partitionBy("__g")
    d = (d.withColumn("__local", F.row_number().over(w.orderBy(*order)))
         .withColumn("__tot", F.count(F.lit(1)).over(w)))
    return _attach_offsets(d, keys, name)


def with_neighbour(df: DataFrame, keys: str | Sequence[str], ordinal_col: str,
                   columns: Sequence[str], offset: int, prefix: str) -> DataFrame:
    """Add ``prefix + c`` for each c in ``columns`` taken from the row ``offset``
    places earlier (offset=1, like ``lag``) or later (offset=-1, like ``lead``)
    within the same key; null where there is none."""
    keys = _names(keys)
    shifted = df.select(*[F.col(k).alias("__n_" + k) for k in keys],
                        (F.col(ordinal_col) + F.lit(offset)).alias("__n_ord"),
                        *[F.col(c).alias(prefix + c) for c in columns])
    cond = None
    for k in keys:
        c = df[k].eqNullSafe(shifted["__n_" + k])  # null keys have neighbours too
        cond = c if cond is None else cond & c
    cond = cond & (df[ordinal_col] == shifted["__n_ord"])
    return df.join(shifted, cond, "left").drop("__n_ord", *["__n_" + k for k in keys])


def top_k_per_group(df: DataFrame, keys: str | Sequence[str], order: Sequence[Column],
                    k: int, rank_name: str = "rank") -> DataFrame:
    """Rows ranked 1..k per group by ``order`` (which must be a total order).

    One window: the rank filter lets Spark keep each task's top k per group
    before the shuffle, so a hot group arrives as k rows a task.
    """
    w = Window.partitionBy(*_names(keys)).orderBy(*order)
    return df.withColumn(rank_name, F.row_number().over(w).cast("bigint")).filter(F.col(rank_name) <= k)


def global_ordinal(df: DataFrame, order: Sequence[Column], name: str = "position",
                   partitions: int | None = None) -> DataFrame:
    """1-based position of every row in ``order`` over the whole DataFrame,
    without a one-task window: range partitioning on ``order`` cuts the rows
    into balanced, contiguous ranges; rows are numbered inside their range and
    offset by the counts of the ranges before it (one row per range).

    The range-partitioned rows are checkpointed once into the shared folder:
    range bounds come from sampling, so the numbering and the range counts
    must read the same materialised ranges to agree."""
    from runlake.session import checkpoint_dir
    checkpoint_dir(df.sparkSession)
    ranged = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    ranged = ranged.checkpoint(eager=True)
    d = ranged.withColumn("__all", F.lit(0)).withColumn("__range", F.spark_partition_id())
    return ordinal(d, "__all", list(order), F.col("__range"), name).drop("__all", "__range")

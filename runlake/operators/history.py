"""Ranked and historical views: top-k, slowest nodes, type-2 snapshots."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlake.operators.ordinal import top_k_per_group
from runlake.operators.ranges import ROWS, Ranged


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    """Global top k: ``orderBy().limit()`` plans as TakeOrderedAndProject,
    a per-task top k then one merge of at most k rows per task."""
    return df.orderBy(*order).limit(k)


def first_match(wanted: DataFrame, candidates: DataFrame, key: str, rank: Sequence[str]) -> DataFrame:
    """Of every wanted key the first of its candidates by ``rank`` (a total order), all their
    columns; null where it has none. One aggregation, combined map-side: no sort of a key's
    candidates. A null key has the candidates of the null key."""
    rest = [c for c in candidates.columns if c != key]
    best = (candidates.groupBy(F.struct(F.col(key).alias("k")).alias("__key"))
            .agg(F.min_by(F.struct(*rest), F.struct(*rank)).alias("__best")))
    found = wanted.withColumn("__key", F.struct(F.col(key).alias("k"))).join(best, "__key", "left")
    return found.select(*wanted.columns, *[F.col(f"__best.{c}").alias(c) for c in rest])


def slowest_nodes(results: DataFrame, group: str | Sequence[str], k: int,
                  elapsed: str = "elapsed", tiebreak: Sequence[str] = ("node",)) -> DataFrame:
    """Top ``k`` results per group by elapsed time (desc), ties by ``tiebreak``;
    skew-safe two-phase ranking."""
    order = [F.col(elapsed).desc_nulls_last()] + [F.col(c).asc() for c in tiebreak]
    return top_k_per_group(results, group, order, k, rank_name="rank")


def snapshot_from_changelog(changes: DataFrame, key: str, ts: str, seq: str, tracked: Sequence[str],
                            rows: int = ROWS) -> DataFrame:
    """Type-2 history from a full changelog (key, ts, seq, tracked...).

    A version starts at each row whose tracked values differ (null-safe) from
    the key's previous row; ``valid_to`` is the next version's start and
    ``is_current`` marks the open version. One shuffle by (key, rank range), so
    a key with a huge history is spread over tasks (``ranges.Ranged``).
    """
    d = Ranged(changes.select(key, ts, seq, *tracked).withColumn("__row", F.lit(True)), key, [ts, seq], rows)
    d = d.neighbours(before={"__had": "__row", **{f"__p_{c}": c for c in tracked}})
    same = F.col("__had").isNotNull()
    for c in tracked:
        same = same & F.col(c).eqNullSafe(F.col(f"__p_{c}"))
    d = d.with_column("__new", ~same)
    d = d.running("version", F.col("__new").cast("long")).following("__next", F.when(F.col("__new"), F.struct(ts)))
    return d.result().filter("__new").select(
        key, "version", *tracked, F.col(ts).alias("valid_from"), F.col(f"__next.{ts}").alias("valid_to"),
        F.col("__next").isNull().alias("is_current"), F.col(seq).alias("from_seq"))


def snapshot(current: DataFrame, history: DataFrame, key: str, tracked: Sequence[str], as_of: str) -> DataFrame:
    """One snapshot step: close the open history rows whose key changed or
    vanished in ``current`` and open rows for new or changed keys.

    ``history`` has (key, tracked..., valid_from, valid_to) with valid_to null
    for open rows; ``current`` has (key, tracked...). One full outer join on
    the key between the open rows and the current rows; a null key is a key
    like any other.
    """
    vt = history.schema["valid_to"].dataType
    at = F.lit(as_of).cast(vt)
    closed = history.filter(F.col("valid_to").isNotNull()).select(key, *tracked, "valid_from", "valid_to")
    h = history.filter(F.col("valid_to").isNull()).select(
        key, *[F.col(c).alias("__h_" + c) for c in tracked], F.col("valid_from").alias("__h_from"),
        F.lit(True).alias("__in_h"))
    c = current.select(key, *tracked, F.lit(True).alias("__in_c"))
    # equality of a struct that is never null: nulls match, and the join stays an equi-join
    h, c = (x.withColumn("__key", F.struct(F.col(key).alias("k"))).drop(key) for x in (h, c))
    j = h.join(c, "__key", "full_outer").withColumn(key, F.col("__key.k"))
    in_h = F.coalesce(F.col("__in_h"), F.lit(False))
    in_c = F.coalesce(F.col("__in_c"), F.lit(False))
    same = None
    for col in tracked:
        eq = F.col(col).eqNullSafe(F.col("__h_" + col))
        same = eq if same is None else same & eq
    old = j.filter(in_h).select(
        key, *[F.col("__h_" + col).alias(col) for col in tracked], F.col("__h_from").alias("valid_from"),
        F.when(in_c & same, F.lit(None).cast(vt)).otherwise(at).alias("valid_to"))
    new = j.filter(in_c & (~in_h | ~same)).select(
        key, *tracked, at.cast(history.schema["valid_from"].dataType).alias("valid_from"),
        F.lit(None).cast(vt).alias("valid_to"))
    return closed.unionByName(old).unionByName(new)

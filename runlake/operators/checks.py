"""Data checks on built relations: ``not_null``, ``unique``, a check report and
a column profile. Every check is one aggregation job over the whole relation."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

REPORT_SCHEMA = "name string, model string, column string, check string, failures bigint, status string"


def status_text(failures: Column) -> Column:
    """``PASS`` or ``FAIL <n>``."""
    return F.when(failures == 0, F.lit("PASS")).otherwise(F.concat(F.lit("FAIL "), failures.cast("string")))


def _cols(column: str | Sequence[str]) -> list[str]:
    if isinstance(column, str):
        return [c.strip() for c in column.split(",")]
    return list(column)


def check_not_null(df: DataFrame, column: str) -> DataFrame:
    """One row: failures = rows where the column is null, rows = all rows."""
    return df.agg(F.count_if(F.col(column).isNull()).alias("failures"), F.count(F.lit(1)).alias("rows")) \
        .withColumn("status", status_text(F.col("failures")))


def check_unique(df: DataFrame, columns: str | Sequence[str]) -> DataFrame:
    """One row: failures = distinct non-null key values that occur more than
    once (rows with a null key part are ignored). Partial aggregation first,
    so a hot key is combined map-side."""
    cols = _cols(columns)
    keyed = df.select(*cols).dropna(subset=cols)
    dup = keyed.groupBy(*cols).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > 1)
    return dup.agg(F.count(F.lit(1)).alias("failures")).withColumn("status", status_text(F.col("failures")))


def run_checks(models: Mapping[str, DataFrame], checks: Sequence[tuple[str, str, str]]) -> DataFrame:
    """Report with one row per (model, column, check), named
    ``<check>_<model>_<column>``. All not_null checks of a model share a single
    aggregation pass; each unique check is one grouped aggregation."""
    parts: list[DataFrame] = []
    by_model: dict[str, list[str]] = {}
    for model, column, check in checks:
        if check == "not_null":
            by_model.setdefault(model, []).append(column)
        elif check != "unique":
            raise ValueError(f"unknown check {check!r}")
    for model, columns in by_model.items():
        counts = models[model].agg(*[F.count_if(F.col(c).isNull()).alias(f"c{i}") for i, c in enumerate(columns)])
        stack = ", ".join(f"'{c}', c{i}" for i, c in enumerate(columns))
        rows = counts.selectExpr(f"stack({len(columns)}, {stack}) as (column, failures)")
        parts.append(rows.select(F.lit(model).alias("model"), "column", F.lit("not_null").alias("check"),
                                 F.col("failures").cast("bigint").alias("failures")))
    for model, column, check in checks:
        if check == "unique":
            u = check_unique(models[model], column)
            parts.append(u.select(F.lit(model).alias("model"), F.lit(column).alias("column"),
                                  F.lit("unique").alias("check"), F.col("failures").cast("bigint").alias("failures")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    name = F.concat_ws("_", F.col("check"), F.col("model"), F.regexp_replace(F.col("column"), r"\s*,\s*", "_"))
    return out.select(name.alias("name"), "model", "column", "check", "failures",
                      status_text(F.col("failures")).alias("status"))


def profile(df: DataFrame, approx: bool = True) -> DataFrame:
    """Per column: rows, nulls, distinct values, and min/max (numeric columns
    as double, others as text). One aggregation over the relation, then an
    unpivot. Distinct counts are HyperLogLog sketches by default (mergeable
    partial aggregates); ``approx=False`` gives exact counts, one grouping by
    each column alone: a task holds the values of one column, not of all."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    aggs, stack = [F.count(F.lit(1)).alias("n_rows")], []
    for i, (c, t) in enumerate(df.dtypes):
        distinct = F.approx_count_distinct(c) if approx else F.lit(0)
        is_num = t in numeric or t.startswith("decimal")
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), distinct.alias(f"d{i}")]
        if is_num:
            aggs += [F.min(F.col(c).cast("double")).alias(f"lo{i}"), F.max(F.col(c).cast("double")).alias(f"hi{i}")]
            stack.append(f"'{c}', n{i}, d{i}, lo{i}, hi{i}, CAST(NULL AS STRING), CAST(NULL AS STRING)")
        else:
            aggs += [F.min(F.col(c).cast("string")).alias(f"lo{i}"), F.max(F.col(c).cast("string")).alias(f"hi{i}")]
            stack.append(f"'{c}', n{i}, d{i}, CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE), lo{i}, hi{i}")
    a = df.agg(*aggs)
    exact = None
    for c in df.columns if not approx else []:
        one = df.select(F.col(c).alias("v")).distinct().agg(F.count("v").alias("__exact")).withColumn("column", F.lit(c))
        exact = one if exact is None else exact.unionByName(one)
    expr = (f"stack({len(stack)}, {', '.join(stack)}) as "
            "(column, n_nulls, n_distinct, min_num, max_num, min_str, max_str)")
    a = a.selectExpr("n_rows", expr)
    if exact is not None:
        a = a.drop("n_distinct").join(exact.withColumnRenamed("__exact", "n_distinct"), "column")
    return a.select(
        "column", "n_rows", "n_nulls", F.col("n_distinct").cast("bigint").alias("n_distinct"),
        "min_num", "max_num", "min_str", "max_str")


#: Standard error of the distinct counts of ``profile_sketches`` (2 ** 12 registers).
SKETCH_BITS, DISTINCT_ERROR = 12, 0.0163


def profile_sketches(df: DataFrame, parts: Sequence[str]) -> DataFrame:
    """Mergeable profile: one row per value of ``parts`` and column with rows, nulls, a
    HyperLogLog sketch of the distinct values, and the least and greatest value (numbers as
    double, others as text). Stored once per part of the data (a day, a run), the rows of any
    set of parts add up by ``merge_profiles`` without another look at the data."""
    numeric = {"tinyint", "smallint", "int", "bigint", "float", "double"}
    columns = [(c, t in numeric or t.startswith("decimal")) for c, t in df.dtypes if c not in parts]
    aggs, stack = [F.count(F.lit(1)).alias("n_rows")], []
    for i, (c, is_num) in enumerate(columns):
        text = F.col(c).cast("string")
        edge = F.col(c).cast("double") if is_num else text
        aggs += [F.count_if(F.col(c).isNull()).alias(f"n{i}"), F.hll_sketch_agg(text, F.lit(SKETCH_BITS)).alias(f"s{i}"),
                 F.min(edge).alias(f"lo{i}"), F.max(edge).alias(f"hi{i}")]
        none = "CAST(NULL AS STRING), CAST(NULL AS STRING)" if is_num else "CAST(NULL AS DOUBLE), CAST(NULL AS DOUBLE)"
        stack.append(f"'{c}', n{i}, s{i}, " + (f"lo{i}, hi{i}, {none}" if is_num else f"{none}, lo{i}, hi{i}"))
    return df.groupBy(*parts).agg(*aggs).selectExpr(
        *parts, "n_rows", f"stack({len(columns)}, {', '.join(stack)}) as (column, n_nulls, sketch, min_num, max_num, min_str, max_str)")


def merge_profiles(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The profile of all parts together (per ``by``): distinct counts are estimates with the
    standard error ``DISTINCT_ERROR``, the rest is exact."""
    return sketches.groupBy(*by, "column").agg(
        F.sum("n_rows").alias("n_rows"), F.sum("n_nulls").alias("n_nulls"),
        F.hll_sketch_estimate(F.hll_union_agg("sketch")).alias("n_distinct"), F.min("min_num").alias("min_num"),
        F.max("max_num").alias("max_num"), F.min("min_str").alias("min_str"), F.max("max_str").alias("max_str"))

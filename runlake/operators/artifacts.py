"""Artifact listings: files(path, folder, rel_path, base_name, length)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def seed_files(files: DataFrame) -> DataFrame:
    """CSV files only (suffix test on the lower-cased base name)."""
    return files.filter(F.lower(F.col("base_name")).endswith(".csv"))


def basename_collisions(files: DataFrame) -> DataFrame:
    """Folders where several files share a base name: a listing keyed by base
    name keeps only the last of them. Bounded output per group (count, first
    and last path, bytes), no per-group lists."""
    return (files.groupBy("folder", "base_name")
            .agg(F.count(F.lit(1)).alias("n_files"), F.min("path").alias("first_path"),
                 F.max("path").alias("last_path"), F.sum("length").alias("total_bytes"),
                 F.count_if(F.lower(F.col("base_name")).endswith(".csv")).alias("n_csv"))
            .filter(F.col("n_files") > 1))


def flatten_lists(df: DataFrame, column: str, keep: list[str] | None = None) -> DataFrame:
    """One row per element of a list column; a null list (a failed listing)
    counts as empty. ``pos`` is the element position."""
    keep = keep if keep is not None else [c for c in df.columns if c != column]
    arr: Column = F.coalesce(F.col(column), F.array().cast(df.schema[column].dataType))
    return df.select(*keep, F.posexplode(arr).alias("pos", "item"))

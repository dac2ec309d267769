"""Seed CSV files -> typed tables named after the file."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.sources.files import list_artifacts


def seed_names(spark: SparkSession, directory: str) -> list[tuple[str, str]]:
    """(name, path) of top-level entries whose name ends in .csv (any case).
    An entry may be a single file or a folder of CSV part files."""
    files = list_artifacts(spark, directory)
    top = F.element_at(F.split(F.col("rel_path"), "/"), 1)
    entries = (files.select(top.alias("entry")).distinct()
               .filter(F.lower(F.col("entry")).endswith(".csv")))
    # The seed list is project metadata (one row per seed), not data.
    names = sorted(r["entry"] for r in entries.collect())
    base = directory.rstrip("/")
    return [(n[: -len(".csv")], f"{base}/{n}") for n in names]


def load_seeds(spark: SparkSession, directory: str, schemas: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Every top-level ``*.csv`` as a DataFrame (header row; types inferred
    unless a DDL schema is given for that seed)."""
    out = {}
    for name, path in seed_names(spark, directory):
        reader = spark.read.option("header", "true")
        if schemas and name in schemas:
            reader = reader.schema(schemas[name])
        else:
            reader = reader.option("inferSchema", "true")
        out[name] = reader.csv(path)
    return out

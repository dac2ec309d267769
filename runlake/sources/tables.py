"""Catalog tables: copies, and versioned tables clustered by a key.

A version is a catalog table of its own, bucketed and sorted by its key, at a folder of its
own; a catalog view under the plain name points to the current one. Publishing replaces the
view, which the catalog does atomically: readers see the old version or the new one, and a
reader that has begun keeps the files it began with.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

DEFAULT_BUCKETS = 16


def clone_table(spark: SparkSession, src: str | DataFrame, dst: str, as_path: bool = False) -> DataFrame:
    """Copy a built relation (name or DataFrame) to ``dst``: a catalog table
    name, or a Parquet folder with ``as_path=True``; returns the copy."""
    df = spark.table(src) if isinstance(src, str) else src
    if as_path:
        df.write.mode("overwrite").parquet(dst)
        return spark.read.parquet(dst)
    df.write.mode("overwrite").saveAsTable(dst)
    return spark.table(dst)


def _quoted(name: str) -> str:
    return ".".join(f"`{p}`" for p in name.split("."))


def write_version(df: DataFrame, name: str, root: str, cluster_by: str | Sequence[str] = (), buckets: int = DEFAULT_BUCKETS) -> str:
    """Write a version of table ``name`` below ``root``; returns the version's catalog name.
    Rows are dealt by the cluster columns first, so each bucket is one sorted file."""
    version = f"{name}__{uuid.uuid4().hex[:12]}"
    keys = [cluster_by] if isinstance(cluster_by, str) else list(cluster_by)
    path = f"{root.rstrip('/')}/{version.replace('.', '/')}"
    if not keys:
        df.write.option("path", path).saveAsTable(version)
        return version
    (df.repartition(buckets, *keys).write.option("path", path).bucketBy(buckets, *keys).sortBy(*keys).saveAsTable(version))
    return version


def publish(spark: SparkSession, name: str, version: str) -> DataFrame:
    """Make ``version`` what ``name`` reads, in one step."""
    if "." not in name:
        spark.catalog.dropTempView(name)  # a temporary view would hide the table
    spark.sql(f"CREATE OR REPLACE VIEW {_quoted(name)} AS SELECT * FROM {_quoted(version)}")
    return spark.table(name)


def save_table(df: DataFrame, name: str, root: str, cluster_by: str | Sequence[str] = (), buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Write a version and publish it."""
    return publish(df.sparkSession, name, write_version(df, name, root, cluster_by, buckets))


def versions(spark: SparkSession, name: str) -> list[str]:
    """The versions of ``name`` in the catalog."""
    return sorted(t.name for t in spark.catalog.listTables() if t.name.startswith(f"{name.lower()}__") and t.tableType != "VIEW")


def drop_old_versions(spark: SparkSession, name: str, keep: str) -> None:
    """Forget every version but ``keep``; their files stay, for readers that still hold them."""
    for v in versions(spark, name):
        if v != keep.lower():
            spark.sql(f"DROP TABLE {_quoted(v)}")


def attach(spark: SparkSession, name: str, path: str, schema: str, cluster_by: Sequence[str] = (), buckets: int = DEFAULT_BUCKETS) -> DataFrame:
    """Register a version's files again, as in a new application whose catalog does not know
    them, and publish it under ``name``."""
    version = f"{name}__{uuid.uuid4().hex[:12]}"
    clustered = f"CLUSTERED BY ({', '.join(cluster_by)}) SORTED BY ({', '.join(cluster_by)}) INTO {buckets} BUCKETS" if cluster_by else ""
    spark.sql(f"CREATE TABLE {_quoted(version)} ({schema}) USING parquet {clustered} LOCATION '{path}'")
    return publish(spark, name, version)

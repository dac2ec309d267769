"""Artifact listing (file metadata only; contents are never read)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def list_artifacts(spark: SparkSession, root: str) -> DataFrame:
    """files(path, folder, rel_path, base_name, length) below ``root``,
    recursively. ``binaryFile`` with only path/length selected lists files
    without reading their bytes."""
    raw = (spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
           .select("path", "length"))
    # Listed paths carry a scheme (file:/..., s3a://...); match on the root's path part.
    root_path = root.rstrip("/")
    if "://" in root_path:
        root_path = "/" + root_path.split("://", 1)[1].split("/", 1)[-1]
    elif root_path.startswith("file:"):
        root_path = root_path[len("file:"):]
    at = F.instr(F.col("path"), root_path)
    rel = F.regexp_replace(F.expr(f"substr(path, instr(path, '{root_path}') + {len(root_path)})"), r"^/+", "")
    rel = F.when(at > 0, rel).otherwise(F.col("path"))
    folder = F.regexp_extract(rel, r"^(.*)/[^/]*$", 1)
    return raw.select("path", folder.alias("folder"), rel.alias("rel_path"),
                      F.substring_index(F.col("path"), "/", -1).alias("base_name"),
                      F.col("length").cast("bigint").alias("length"))

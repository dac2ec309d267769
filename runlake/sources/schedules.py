"""Requested-schedule specs: ``name -> {command, schedule}``."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

REQUESTED_SCHEMA = "name string, command string, schedule string"


def _documents(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import yaml
    loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)
    text = lambda value: None if value is None else str(value)
    for frame in frames:
        rows = []
        for document in frame["value"]:
            spec = yaml.load(document, loader)
            for name, v in (spec if isinstance(spec, dict) else {}).items():
                v = v if isinstance(v, dict) else {}
                rows.append((text(name), text(v.get("command")), text(v.get("schedule"))))
        yield pd.DataFrame(rows, columns=["name", "command", "schedule"])


def read_schedule_specs(spark: SparkSession, path: str) -> DataFrame:
    """Specs from any store that Spark reads: YAML documents, or a JSON-lines or Parquet table
    of (name, command, schedule); a file, a folder of files or a pattern, whose kind the
    path's ending tells. Each YAML document is parsed in a task, as Spark has no function for
    it. An entry that is no mapping has neither command nor schedule; an empty document has
    no entries; one that is not YAML ends the job."""
    kind = path.rstrip("/").rpartition(".")[2].lower()
    if kind in ("yaml", "yml"):
        return spark.read.text(path, wholetext=True).mapInPandas(_documents, REQUESTED_SCHEMA)
    if kind in ("json", "jsonl"):
        return spark.read.schema(REQUESTED_SCHEMA).json(path)
    return spark.read.parquet(path).select("name", "command", "schedule")


def write_schedule_specs(requested: DataFrame, path: str, entries: int = 1000) -> None:
    """requested(name, command, schedule) as a folder of YAML documents of at most ``entries``
    entries each. Quoted JSON text is YAML too, so no value needs rules of its own; rows
    without a name are left out."""
    quoted = F.regexp_extract(F.to_json(F.struct("name")), r'^\{"name":(.*)\}$', 1)
    line = F.concat(quoted, F.lit(": "), F.to_json(F.struct("command", "schedule")))
    requested.filter("name is not null").select(line.alias("value")).write.option("maxRecordsPerFile", entries).text(path)

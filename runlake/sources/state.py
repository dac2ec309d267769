"""Run-state changelog source/sink: every update of a run record is an
appended (run_id, seq, ts, field, value) row; compaction gives the state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The field that holds a run's own settings.
OVERRIDES = "overrides"
RUN_EVENTS_SCHEMA = "run_id string, seq bigint, ts timestamp, field string, value string"


def new_run_events(runs: DataFrame) -> DataFrame:
    """Creation writes of new runs (run_id, ts, user_command, and overrides, a map of the
    run's own settings, where there is that column): status ``scheduled``, empty folder, byte
    cursor 0, the overrides as JSON (of a run without any: an empty object)."""
    none = F.create_map().cast("map<string,string>")
    own = F.coalesce(F.col("overrides"), none) if "overrides" in runs.columns else none
    fields = [("run_status", F.lit("scheduled")), ("user_command", F.col("user_command")), ("cloud_storage_folder", F.lit("")),
              ("log_starting_byte", F.lit("0")), (OVERRIDES, F.to_json(own))]
    writes = F.array(*[F.struct(F.lit(n).alias("field"), v.alias("value")) for n, v in fields])
    return runs.select("run_id", F.lit(0).cast("bigint").alias("seq"), "ts", F.inline(writes))


def run_overrides(state: DataFrame) -> DataFrame:
    """The compacted state with ``overrides`` as a map and the run's own ``log_level`` (null:
    the default), as ``operators.logs.split_by_level`` takes it."""
    own = F.from_json(F.col(OVERRIDES), "map<string,string>")
    return state.withColumn(OVERRIDES, own).withColumn("log_level", F.try_element_at(F.col(OVERRIDES), F.lit("log_level")))


def append_run_events(events: DataFrame, path: str, partitions: int | None = None) -> None:
    """Append to the changelog, partitioned by month of ``ts``. Range
    partitioning on (month, run_id, seq) keeps files few and sorted by run
    (min/max stats prune run lookups) and splits a hot month over tasks."""
    (events.select("run_id", "seq", "ts", "field", "value")
     .withColumn("month", F.date_format("ts", "yyyy-MM"))
     .repartitionByRange(*([partitions] if partitions else []), "month", "run_id", "seq")  # else as adaptive execution sizes them
     .write.mode("append").partitionBy("month").parquet(path))


def read_run_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).select("run_id", "seq", "ts", "field", "value")

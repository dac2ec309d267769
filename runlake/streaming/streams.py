"""Structured Streaming operators.

The runner tails a growing log by byte cursor, one poll a second, with one
cursor shared by every reader. Here a stream's checkpoint is its cursor (one
per consumer) and sinks are append-only files. Stateful results keep their
state in Spark's state store; ``foreachBatch`` sinks write each micro-batch
under its own ``batch=<id>`` folder, so a replayed batch overwrites exactly
what it wrote before.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from runlake.operators.runs import LIVE_STATUSES, compact
from runlake.streaming.growing import committed


def _trigger(writer, trigger: str | None):
    if trigger is None or trigger == "availableNow":
        return writer.trigger(availableNow=True)
    return writer.trigger(processingTime=trigger)


def read_stream(spark: SparkSession, path: str, schema: StructType, glob: str | None = None,
                max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if glob:
        r = r.option("pathGlobFilter", glob)
    if max_files:
        r = r.option("maxFilesPerTrigger", str(max_files))
    return r.parquet(path)


def event_time(df: DataFrame, column: str = "ts") -> DataFrame:
    """Watermarks need TIMESTAMP (not TIMESTAMP_NTZ): reinterpret the UTC wall
    clock as an instant in the (UTC) session zone."""
    return df.withColumn(column, F.col(column).cast("timestamp"))


def tail(lines: DataFrame, sink: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Emit each log line once, in arrival order, to an append-only
    Parquet sink; the checkpoint is this consumer's own cursor."""
    w = lines.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return _trigger(w.outputMode("append"), trigger).start()


def follow(spark: SparkSession, source: str, schema: StructType, sink: str, checkpoint: str,
           state: Callable[[], DataFrame], run_id, poll_seconds: float = 1.0,
           max_polls: int | None = None) -> int:
    """G1 with the runner's stop rule: tail a run's log until its status is
    terminal. Each poll drains what arrived (``availableNow``) with this
    consumer's cursor, then reads the run's status; only ``pending`` and
    ``running`` keep the tail going (so does a run with no state yet), any
    other status ends it after a last drain. Returns the number of polls; raises
    TimeoutError when ``max_polls`` did not reach the end."""
    polls = 0
    while True:
        polls += 1
        q = tail(read_stream(spark, source, schema).filter(F.col("run_id") == F.lit(run_id)), sink, checkpoint)
        q.awaitTermination()
        st = state().filter(F.col("run_id") == F.lit(run_id)).select("run_status").first()
        if st is not None and st["run_status"] not in LIVE_STATUSES:
            return polls
        if max_polls is not None and polls >= max_polls:
            raise TimeoutError(f"run {run_id} was still live after {polls} polls")
        time.sleep(poll_seconds)


def stream_state(events: DataFrame, target: str, checkpoint: str, trigger: str | None = None) -> StreamingQuery:
    """Last write per (run, field) of a run-event stream.

    The running ``max_by`` lives in Spark's state store (checkpointed with
    the query); in update mode each micro-batch emits only the (run, field)
    pairs it changed, appended under ``batch=<id>`` (a replayed batch
    overwrites its own folder). Work per batch follows the batch size, not
    the size of the state table."""
    agg = (events.groupBy("run_id", "field")
           .agg(F.max_by(F.struct("seq", "ts", "value"), F.struct("ts", "seq")).alias("w")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select("run_id", "field", "w.seq", "w.ts", "w.value", F.lit(batch_id).cast("bigint").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{target}/batch={batch_id:012d}"))

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


def compact_state(spark: SparkSession, target: str) -> int:
    """Fold the changes of ``stream_state`` into a base: the last write per (run, field) up to
    the last finished batch, as ``<target>-base/batch=<id>``. Its success marker is the switch:
    readers take the newest finished base and the changes after it, so what they read follows
    the size of the state, and one that began before the switch keeps what it read. Returns the
    batch the base reaches to (-1: no changes yet). Older folders stay until they are vacuumed."""
    last = committed(target.rsplit("/", 1)[0], target.rsplit("/", 1)[1])
    if last >= 0 and last > _base(target):
        (_changes(spark, target).filter(F.col("batch") <= last).groupBy("run_id", "field")
         .agg(F.max_by(F.struct("seq", "ts", "value", "batch_id"), "batch_id").alias("w"))
         .select("run_id", "field", "w.seq", "w.ts", "w.value", "w.batch_id")
         .write.mode("overwrite").parquet(f"{target}-base/batch={last:012d}"))
    return last


def _base(target: str) -> int:
    head, name = target.rsplit("/", 1)
    return committed(head, f"{name}-base")


def _changes(spark: SparkSession, target: str) -> DataFrame:
    """The newest base and the changes after it; ``batch`` is the folder's number."""
    base = _base(target)
    changes = spark.read.parquet(target).withColumn("batch", F.col("batch").cast("long")).filter(F.col("batch") > base)
    if base < 0:
        return changes
    folder = f"{target}-base/batch={base:012d}"
    return changes.unionByName(spark.read.parquet(folder).withColumn("batch", F.lit(base).cast("long")))


def state_table(spark: SparkSession, target: str, fields: Sequence[str]) -> DataFrame:
    """Current run state: the latest emitted row per (run, field), pivoted."""
    last = (_changes(spark, target).groupBy("run_id", "field")
            .agg(F.max_by(F.struct("seq", "ts", "value"), "batch_id").alias("w"))
            .select("run_id", "w.seq", "w.ts", "field", "w.value"))
    return compact(last, fields)


def stream_counts(entries: DataFrame, keys: Sequence[str], size: str, slide: str | None, delay: str,
                  target: str, checkpoint: str, ts: str = "ts", trigger: str | None = None) -> StreamingQuery:
    """Tumbling (or sliding) window counts per key with a watermark, in
    update mode: every micro-batch appends the windows it changed, tagged with
    its batch id; ``latest_counts`` keeps the last value per window. The rows that
    come in are observed (``input_rows``)."""
    win = F.window(ts, size, slide) if slide else F.window(ts, size)
    agg = (entries.observe(INPUT, F.count(F.lit(1)).alias("rows")).withWatermark(ts, delay).groupBy(win.alias("window"), *keys)
           .agg(F.count(F.lit(1)).alias("n")))

    def sink(batch: DataFrame, batch_id: int) -> None:
        (batch.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"),
                      *keys, "n", F.lit(batch_id).cast("bigint").alias("batch_id"))
         .write.mode("overwrite").parquet(f"{target}/batch={batch_id:012d}"))

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    return _trigger(w, trigger).start()


#: The observation of the rows a stream reads.
INPUT = "input"


def input_rows(query: StreamingQuery) -> int:
    """Rows that a finished ``stream_counts`` query has read, late ones among them (of its last
    ``spark.sql.streaming.numRecentProgressUpdates`` micro-batches)."""
    return sum(p.observedMetrics[INPUT]["rows"] for p in query.recentProgress if INPUT in p.observedMetrics)


def late_rows(counts: DataFrame, read: int) -> int:
    """Of ``read`` input rows those that are in none of the (tumbling) windows: they came
    behind the watermark."""
    return read - (counts.agg(F.sum("n")).first()[0] or 0)


def latest_counts(spark: SparkSession, target: str, keys: Sequence[str]) -> DataFrame:
    d = spark.read.parquet(target)
    return (d.groupBy("window_start", "window_end", *keys)
            .agg(F.max_by("n", "batch_id").alias("n")))


def stream_sessions(entries: DataFrame, keys: Sequence[str], gap: str, delay: str, sink: str,
                    checkpoint: str, ts: str = "ts", trigger: str | None = None) -> StreamingQuery:
    """Activity sessions per key (a run that never logs a finish line
    still ends after ``gap`` of silence). Append mode: a session is written
    once, when the watermark passes its end."""
    s = (entries.withWatermark(ts, delay).groupBy(F.session_window(ts, gap).alias("s"), *keys)
         .agg(F.count(F.lit(1)).alias("n_lines"), F.max(ts).alias("last_ts")))
    out = s.select(*keys, F.col("s.start").alias("session_start"), F.col("s.end").alias("session_end"),
                   "n_lines", "last_ts")
    w = out.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return _trigger(w.outputMode("append"), trigger).start()


def stream_dedup(fires: DataFrame, keys: Sequence[str], delay: str, sink: str, checkpoint: str,
                 ts: str = "ts", trigger: str | None = None) -> StreamingQuery:
    """Drop repeated fires (same keys) arriving within the watermark delay."""
    d = fires.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))
    w = d.writeStream.format("parquet").option("path", sink).option("checkpointLocation", checkpoint)
    return _trigger(w.outputMode("append"), trigger).start()

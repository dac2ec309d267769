"""Tail of log objects that grow, with a cursor table for each consumer.

A poll lists the objects, reads what lies beyond the consumer's cursor, numbers the new lines
after those already read, and writes them as ``lines/batch=<n>``; the cursors (object, run_id,
bytes_read, lines_read) follow as ``cursors/batch=<n>``. The cursor folder's success marker is
the commit: a poll that failed before it is done again under the same number, so no line is
lost and none numbered twice. A consumer is a folder; consumers do not see each other.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.operators.runs import LIVE_STATUSES
from runlake.sources.objects import list_objects, opened, read_ranges

CURSORS = "object string, run_id string, bytes_read bigint, lines_read bigint"
TAILED = "run_id string, line_no bigint, raw string"


def committed(consumer: str, name: str = "cursors") -> int:
    """The number of the last committed poll; -1 before the first."""
    from pyarrow import fs
    store, root = opened(f"{consumer.rstrip('/')}/{name}")
    found = store.get_file_info(fs.FileSelector(root, allow_not_found=True, recursive=True))
    done = [f.path.rsplit("/", 2)[-2] for f in found if f.base_name == "_SUCCESS"]
    return max((int(d.split("=")[1]) for d in done if d.startswith("batch=")), default=-1)


def read_cursors(spark: SparkSession, consumer: str) -> DataFrame:
    """Each object's cursor; none before the first poll."""
    last = committed(consumer)
    if last < 0:
        return spark.createDataFrame([], CURSORS)
    return spark.read.schema(CURSORS).parquet(f"{consumer}/cursors/batch={last:012d}")


def read_tail(spark: SparkSession, consumer: str) -> DataFrame:
    """Every line the consumer has read: run_id, line_no, raw and the poll's number."""
    last = committed(consumer)
    try:
        lines = spark.read.schema(TAILED + ", batch bigint").parquet(f"{consumer}/lines")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], TAILED + ", batch bigint")
    return lines.filter(F.col("batch") <= last)


def poll(spark: SparkSession, path: str, consumer: str, finished: DataFrame | None = None) -> int:
    """Read what was appended to the objects below ``path`` since the consumer's last poll;
    returns the poll's number. A line counts once its line end is there; the open last line of
    a run counts when ``finished`` (run_id) names the run. An object that shrank is not read
    until it has grown past its cursor."""
    number = committed(consumer) + 1
    cursors = read_cursors(spark, consumer)
    objects = list_objects(spark, path)
    known = cursors.select("object", F.col("bytes_read").alias("__b"), F.col("lines_read").alias("__l"))
    parts = objects.join(known, "object", "left").select(
        "object", "run_id", "size", F.coalesce("__b", F.lit(0)).alias("bytes_read"), F.coalesce("__l", F.lit(0)).alias("lines_read"))
    if finished is None:
        parts = parts.withColumn("finished", F.lit(False))
    else:
        over = finished.select(F.col("run_id").cast("string").alias("run_id")).distinct().withColumn("__over", F.lit(True))
        parts = parts.join(over, "run_id", "left").withColumn("finished", F.coalesce("__over", F.lit(False))).drop("__over")
    grown = parts.filter(F.col("size") > F.col("bytes_read"))
    # the lines of a poll are written once, as read, and numbered from the counts of their ranges
    raw = f"{consumer}/read/batch={number:012d}"
    read_ranges(grown).write.mode("overwrite").parquet(raw)
    lines = spark.read.parquet(raw)
    per = lines.groupBy("object", "range_no").agg(F.count(F.lit(1)).alias("n"), F.max("end_byte").alias("end_byte"))
    w = Window.partitionBy("object").orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)  # ranges, not lines
    offsets = per.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter("range_no > 0")
    line_no = lambda before: (F.col("lines_read") + before + F.col("pos") + 1).alias("line_no")
    # lines of an object's first range have none before them: only longer parts are joined
    first = lines.filter("range_no = 0").select("run_id", line_no(F.lit(0)), "raw")
    later = (lines.filter("range_no > 0").join(offsets.select("object", "range_no", "before"), ["object", "range_no"])
             .select("run_id", line_no(F.col("before")), "raw"))
    first.unionByName(later).write.mode("overwrite").parquet(f"{consumer}/lines/batch={number:012d}")
    read = per.groupBy("object").agg(F.sum("n").alias("n"), F.max("end_byte").alias("end_byte"))
    moved = parts.join(read, "object", "left").select(
        "object", "run_id", F.coalesce("end_byte", "bytes_read").alias("bytes_read"),
        (F.col("lines_read") + F.coalesce("n", F.lit(0))).alias("lines_read"))
    gone = cursors.join(objects, "object", "left_anti")  # an object that is not listed keeps its cursor
    moved.unionByName(gone).write.mode("overwrite").parquet(f"{consumer}/cursors/batch={number:012d}")
    return number


def follow_objects(spark: SparkSession, path: str, consumer: str, state: Callable[[], DataFrame], wait: Callable[[], None],
                   max_polls: int | None = None) -> int:
    """Poll until every listed run has a status that is not live (a run without a state is
    live), with one last poll after that; ``wait`` runs between polls. Returns the number of
    polls; raises TimeoutError when ``max_polls`` did not reach the end."""
    polls = 0
    while True:
        runs = state().filter(F.col("run_status").isNotNull() & ~F.col("run_status").isin(*LIVE_STATUSES)).select(
            F.col("run_id").cast("string").alias("run_id"))
        live = not list_objects(spark, path).join(runs, "run_id", "left_anti").isEmpty()
        poll(spark, path, consumer, finished=runs)
        polls += 1
        if not live:
            return polls
        if max_polls is not None and polls >= max_polls:
            raise TimeoutError(f"runs below {path} were still live after {polls} polls")
        wait()

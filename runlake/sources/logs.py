"""Run-log sources and sinks.

Text objects (one per run, lines joined by newlines, as the runner stores
them) are read line by line: a large object is split across tasks and line
numbers are rebuilt from (file block, scan order) with a skew-safe ordinal.
The append-only sink stores one Parquet row per line with its line number,
partitioned by run date, instead of rewriting a whole object per line.
"""

from __future__ import annotations

import re

from pyarrow import fs
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.functions.logs import format_entry
from runlake.operators.ordinal import ordinal
from runlake.sources import objects as O

LOG_LINES_SCHEMA = "run_id string, line_no bigint, raw string"
# Fixed value: the first line of every new log.
INIT_MESSAGE = "Init"
RUN_ID_FROM_FILE = r"([^/]+?)(\.txt)?$"


def read_log_text(spark: SparkSession, path: str, run_id_from: str = "file") -> DataFrame:
    """log_lines(run_id, line_no, raw) from text objects.

    ``run_id_from='file'``: one object per run named ``<run_id>.txt`` (the
    runner's layout). ``'partition'``: a ``run_id=<id>/`` folder per run whose
    part files, in name order, hold the run's lines in order (what
    ``write_log_text`` writes); they are listed and read inside tasks. A missing
    or empty object yields no lines.
    """
    try:
        if run_id_from == "partition":
            return _read_folders(spark, path)
        df = spark.read.option("recursiveFileLookup", "true").text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG_LINES_SCHEMA)
    raw = df.select(F.regexp_extract(F.col("_metadata.file_name"), RUN_ID_FROM_FILE, 1).alias("run_id"),
                    F.struct(F.col("_metadata.file_name").alias("f"),
                             F.col("_metadata.file_block_start").alias("b")).alias("__block"),
                    F.monotonically_increasing_id().alias("__pos"),
                    F.col("value").alias("raw"))
    out = ordinal(raw, "run_id", [F.col("__block"), F.col("__pos")], F.col("__block"), "line_no")
    return out.select("run_id", "line_no", "raw")


#: The folder of lines without a run id, and characters that a folder's name has as %XX: Spark's.
NO_RUN = "__HIVE_DEFAULT_PARTITION__"
_ESCAPED = re.compile("[\x01-\x1f\"#%'*/:=?\\\\\x7f{}\\[\\]^]")


def _folder_name(run_id: str | None) -> str:
    return "run_id=" + (_ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", run_id) if run_id else NO_RUN)


def _run_of(path: str) -> Column:
    """The run of a file in its ``run_id=<id>`` folder."""
    named = F.regexp_extract(path, r"/run_id=([^/]*)/[^/]*$", 1)
    plain = F.try_url_decode(F.replace(named, F.lit("+"), F.lit("%2B")))
    return F.when((named != NO_RUN) & (named != ""), plain)


def _read_folders(spark: SparkSession, path: str) -> DataFrame:
    # a file without a byte has no line
    files = O.list_files(spark, path).filter((F.col("size") > 0) & F.col("path").rlike(r"/run_id=[^/]*/[^/]*$"))
    ranges = F.expr(f"(size - 1) div {O.RANGE_BYTES} + 1")
    parts = files.select(F.col("path").alias("object"), _run_of("path").alias("run_id"), F.lit(0).cast("long").alias("bytes_read"),
                         F.lit(0).cast("long").alias("lines_read"), "size", F.lit(True).alias("finished"), ranges.alias("__ranges"))
    # files, not lines; one file of one range holds its run: its lines' places are their numbers
    parts = parts.withColumn("__ranges", F.sum("__ranges").over(Window.partitionBy("run_id")))
    alone = O.read_ranges(parts.filter("__ranges = 1"), any_line_end=True).select("run_id", (F.col("pos") + 1).alias("line_no"), "raw")
    shared = O.read_ranges(parts.filter("__ranges > 1"), any_line_end=True)
    order = Window.partitionBy("run_id").orderBy(F.substring_index("object", "/", -1), "object", "range_no")  # ranges, not lines
    per = shared.groupBy("run_id", "object", "range_no").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    several = (shared.join(per.select("object", "range_no", before.alias("before")), ["object", "range_no"])
               .select("run_id", (F.col("before") + F.col("pos") + 1).alias("line_no"), "raw"))
    return alone.unionByName(several)


def write_log_text(lines: DataFrame, path: str, partitions: int | None = None, folders: int = 1) -> None:
    """log_lines as text: a ``run_id=<id>`` folder per run, lines in order.
    Range partitioning on (run_id, line_no) splits a huge run over several
    tasks whose part files follow each other in name order. Tasks write the
    files themselves: Spark's committer moves each in the driver. With more than
    one of ``folders`` the runs' folders are dealt to so many below ``path``."""
    store, root = O.opened(path.rstrip("/"))
    if store.get_file_info(root).type != fs.FileType.NotFound:
        raise AnalysisException(f"[PATH_ALREADY_EXISTS] Path {path} already exists.")
    n = [partitions] if partitions else []  # else as adaptive execution sizes them

    def place(run: str | None, task: int) -> tuple[str, str]:
        name = _folder_name(run)
        return f"{O.sub_folder(name, folders)}{name}/", f"part-{task:08d}.txt"

    rows = lines.repartitionByRange(*n, "run_id", "line_no").sortWithinPartitions("run_id", "line_no")
    O.write_runs(rows.select(F.col("run_id").cast("string").alias("run_id"), "raw"), path, place)
    store.create_dir(root, recursive=True)  # no task made it where there is no line
    store.open_output_stream(f"{root}/_SUCCESS").close()


def read_log_lines(spark: SparkSession, path: str) -> DataFrame:
    """log_lines from the Parquet sink; partition pruning on run_date applies.
    A sink nothing was written to yet reads as empty."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], LOG_LINES_SCHEMA + ", run_date date")


def init_lines(runs: DataFrame) -> DataFrame:
    """The first line of each new run's log: runs(run_id, ts)."""
    return runs.select("run_id", F.lit(1).cast("bigint").alias("line_no"),
                       format_entry(F.col("ts"), F.lit("INFO"), F.lit(INIT_MESSAGE)).alias("raw"),
                       F.to_date("ts").alias("run_date"))


def number_new_lines(new: DataFrame, existing: DataFrame | None, order: list[str]) -> DataFrame:
    """Give new lines (run_id, ts, severity, message, ...) line numbers after
    the run's existing lines and their stored text."""
    n = ordinal(new, "run_id", [F.col(c) for c in order], F.date_trunc("hour", F.col("ts")), "__k")
    if existing is not None:
        last = existing.groupBy("run_id").agg(F.max("line_no").alias("__last"))
        n = n.join(last, "run_id", "left")
    else:
        n = n.withColumn("__last", F.lit(0).cast("bigint"))
    return n.select("run_id", (F.coalesce(F.col("__last"), F.lit(0)) + F.col("__k")).alias("line_no"),
                    format_entry(F.col("ts"), F.col("severity"), F.col("message")).alias("raw"),
                    F.to_date("ts").alias("run_date"))


def append_log_lines(lines: DataFrame, path: str, partitions: int | None = None) -> None:
    """Append log_lines (run_id, line_no, raw, run_date) to the sink. Range
    partitioning on (run_date, run_id, line_no) writes few files per date,
    each sorted by run (row-group stats prune run lookups), and splits a hot
    run over several tasks."""
    n = [partitions] if partitions else []
    (lines.select("run_id", "line_no", "raw", "run_date")
     .repartitionByRange(*n, "run_date", "run_id", "line_no")
     .write.mode("append").partitionBy("run_date").parquet(path))

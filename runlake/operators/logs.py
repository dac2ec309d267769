"""Run-log operators over ``log_lines`` (run_id, line_no, raw) and the parsed
``log_entries`` (run_id, line_no, ts, severity, emitter, message)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlake.functions.logs import parse_entry
from runlake.operators.ordinal import prefix_sum

# The two severity scales of the runner.
# lookup_rank: the name -> number table used to check severities
#   DEFAULT 0, DEBUG 10, INFO 20, NOTICE 20, WARN 30, ERROR 40, CRITICAL 50,
#   ALERT 50, EMERGENCY 50; any other name is unknown.
# registered_rank: the level numbers used to decide what is shown
#   DEFAULT 1, DEBUG 10, INFO 20, NOTICE 15, WARN 30, ERROR 40, CRITICAL 50,
#   ALERT 60, EMERGENCY 100, plus the standard names WARNING 30, FATAL 50,
#   NOTSET 0 that the level registry also resolves.
SEVERITY_ROWS = [
    ("DEFAULT", 0, 1),
    ("DEBUG", 10, 10),
    ("INFO", 20, 20),
    ("NOTICE", 20, 15),
    ("WARN", 30, 30),
    ("ERROR", 40, 40),
    ("CRITICAL", 50, 50),
    ("ALERT", 50, 60),
    ("EMERGENCY", 50, 100),
    ("WARNING", None, 30),
    ("FATAL", None, 50),
    ("NOTSET", None, 0),
]
SEVERITY_SCHEMA = "name string, lookup_rank int, registered_rank int"
DEFAULT_LOG_LEVEL = "info"
# Lines per chunk for skew-safe per-run prefix sums and bounded log chunks.
LINES_PER_CHUNK = 1 << 16


def severity_dim(spark: SparkSession) -> DataFrame:
    """Constant 12-row dimension; safe to broadcast."""
    return spark.createDataFrame(SEVERITY_ROWS, SEVERITY_SCHEMA)


def parse_lines(lines: DataFrame, keep_tabs: bool = False) -> DataFrame:
    """log_lines -> log_entries (one projection, no shuffle)."""
    p = parse_entry(F.col("raw"), keep_tabs=keep_tabs)
    return lines.select("run_id", "line_no", p.alias("e")).select(
        "run_id", "line_no", "e.ts", "e.severity", "e.emitter", "e.message")


def with_severity_rank(entries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(known, unknown): known rows get ``severity_rank`` from the lookup scale,
    matched on the upper-cased name; unknown rows are every row whose name the
    lookup does not know (the runner raises on those)."""
    spark = entries.sparkSession
    dim = F.broadcast(severity_dim(spark).filter(F.col("lookup_rank").isNotNull())
                      .select(F.col("name").alias("__sev"), F.col("lookup_rank").alias("severity_rank")))
    joined = entries.join(dim, F.upper(entries["severity"]) == dim["__sev"], "left").drop("__sev")
    known = joined.filter(F.col("severity_rank").isNotNull())
    unknown = joined.filter(F.col("severity_rank").isNull()).drop("severity_rank")
    return known, unknown


def unknown_severities(entries: DataFrame) -> DataFrame:
    """Distinct severity names the lookup does not know, with their row counts."""
    spark = entries.sparkSession
    known = F.broadcast(severity_dim(spark).filter(F.col("lookup_rank").isNotNull()).select("name"))
    return (entries.join(known, F.upper(entries["severity"]) == known["name"], "left_anti")
            .groupBy("severity").agg(F.count(F.lit(1)).alias("n_lines")))


def split_by_level(entries: DataFrame, runs: DataFrame,
                   default_level: str = DEFAULT_LOG_LEVEL) -> tuple[DataFrame, DataFrame]:
    """(visible, hidden) by each run's own minimum level.

    ``runs`` has (run_id, log_level) where log_level may be null (= default).
    A line is visible when its registered rank >= the run's registered rank;
    lines whose severity has no rank are hidden.
    """
    spark = entries.sparkSession
    dim = severity_dim(spark)
    ev_rank = F.broadcast(dim.select(F.col("name").alias("__ev_name"), F.col("registered_rank").alias("event_rank")))
    req_rank = F.broadcast(dim.select(F.col("name").alias("__rq_name"), F.col("registered_rank").alias("min_rank")))
    levels = runs.select(F.col("run_id").alias("__run"),
                         F.upper(F.coalesce(F.col("log_level"), F.lit(default_level))).alias("__level"))
    levels = levels.join(req_rank, levels["__level"] == req_rank["__rq_name"], "left").select("__run", "min_rank")
    # Runs without a row in ``runs`` use the default level.
    default_rank = [r[2] for r in SEVERITY_ROWS if r[0] == default_level.upper()][0]
    j = (entries.join(ev_rank, F.upper(entries["severity"]) == ev_rank["__ev_name"], "left")
         .join(levels, entries["run_id"] == levels["__run"], "left")
         .withColumn("min_rank", F.coalesce(F.col("min_rank"), F.lit(default_rank)))
         .drop("__ev_name", "__run"))
    show = F.coalesce(F.col("event_rank") >= F.col("min_rank"), F.lit(False))
    return j.filter(show), j.filter(~show)


def with_byte_offsets(lines: DataFrame, lines_per_chunk: int = LINES_PER_CHUNK) -> DataFrame:
    """Add ``start_byte``: UTF-8 bytes of all earlier lines of the run plus one
    newline each, and ``n_bytes`` of the line itself."""
    d = lines.withColumn("n_bytes", F.octet_length("raw").cast("bigint"))
    chunk = F.floor((F.col("line_no") - 1) / F.lit(lines_per_chunk))
    return prefix_sum(d, "run_id", [F.col("line_no")], F.col("n_bytes") + 1, chunk,
                      "start_byte", inclusive=False)


def read_since(lines: DataFrame, cursors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Ranged read of each run's log from its byte cursor.

    ``cursors`` has (run_id, cursor). Returns (pieces, new_cursors): pieces are
    what decoding the bytes from the cursor and splitting on newlines gives,
    so a cursor inside a line yields that line's tail first. A run whose log
    size is <= cursor yields nothing and keeps its cursor; otherwise the cursor
    moves to size + 1 (past the newline that the next line will bring).
    """
    c = cursors.select(F.col("run_id").alias("__run"), F.col("cursor").cast("bigint").alias("cursor"))
    # only runs that have a cursor are read further; their sizes decide which moved
    wanted = lines.join(c.select("__run"), F.col("run_id") == F.col("__run"), "left_semi")
    sizes = (wanted.groupBy(F.col("run_id").alias("__run"))
             .agg((F.sum(F.octet_length("raw").cast("bigint") + 1) - 1).alias("size")))
    moved = c.join(sizes, "__run").filter("size > cursor").select("__run", "cursor")
    off = with_byte_offsets(wanted.join(moved.select("__run"), F.col("run_id") == F.col("__run"), "left_semi"))
    j = off.join(moved, off["run_id"] == moved["__run"], "inner").drop("__run")
    end = F.col("start_byte") + F.col("n_bytes")
    tail_from = F.col("cursor") - F.col("start_byte")
    piece = F.when(F.col("start_byte") >= F.col("cursor"), F.col("raw")).otherwise(
        F.decode(F.expr("substr(encode(raw, 'UTF-8'), cast(cursor - start_byte + 1 as int))"), "UTF-8"))
    pieces = (j.filter(end >= F.col("cursor"))
              .select("run_id", "line_no", "start_byte", "cursor", piece.alias("piece"),
                      (tail_from > 0).alias("partial")))
    new = (cursors.select("run_id", F.col("cursor").cast("bigint").alias("cursor"))
           .join(sizes, F.col("run_id") == F.col("__run"), "left").drop("__run")
           .withColumn("size", F.coalesce(F.col("size"), F.lit(0).cast("bigint")))
           .withColumn("new_cursor", F.when(F.col("size") > F.col("cursor"), F.col("size") + 1)
                       .otherwise(F.col("cursor"))))
    return pieces, new


def ordered_log(lines: DataFrame, state: DataFrame | None = None,
                lines_per_chunk: int = 1000) -> DataFrame:
    """Whole log of every run as ordered, bounded text chunks.

    One row per (run, chunk of ``lines_per_chunk`` lines) with the chunk text
    joined by newlines in line order; concatenating a run's chunks in
    ``chunk_no`` order (with newlines between) gives its full log. Chunks
    bound the work per group, so a huge run never lands in one task.
    With ``state`` (run_id, run_status) the status is attached.
    """
    chunk_no = F.floor((F.col("line_no") - 1) / F.lit(lines_per_chunk)).cast("bigint")
    g = (lines.withColumn("chunk_no", chunk_no)
         .groupBy("run_id", "chunk_no")
         .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"),
              F.count(F.lit(1)).alias("n_lines"),
              F.array_sort(F.collect_list(F.struct("line_no", "raw"))).alias("__l")))
    out = g.withColumn("text", F.array_join(F.transform("__l", lambda x: x["raw"]), "\n")).drop("__l")
    if state is not None:
        s = state.select(F.col("run_id").alias("__run"), "run_status")
        out = out.join(s, out["run_id"] == s["__run"], "left").drop("__run")
    return out


# The end markers that this library takes by default (the docs' "END JOB" is never written).
FINISH_MESSAGE = "[job] job finished"
SUCCESS_MESSAGE = "[job] Command successfully executed"


def run_summary(entries: DataFrame, finish: Column | None = None, success: Column | None = None) -> DataFrame:
    """Per run: line and error counts, first/last time, finish time, finished and
    succeeded flags and duration in seconds (to the finish line, else the last
    line). One partial+final aggregation, hot runs are combined map-side."""
    finish = finish if finish is not None else (F.col("message") == F.lit(FINISH_MESSAGE))
    success = success if success is not None else (F.col("message") == F.lit(SUCCESS_MESSAGE))
    g = entries.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(F.upper("severity") == "ERROR").alias("n_errors"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max(F.when(finish, F.col("ts"))).alias("finish_ts"),
        F.bool_or(F.coalesce(success, F.lit(False))).alias("succeeded"),
    )
    end = F.coalesce(F.col("finish_ts"), F.col("last_ts"))
    return (g.withColumn("finished", F.col("finish_ts").isNotNull())
            .withColumn("duration_s", F.unix_timestamp(end) - F.unix_timestamp("first_ts")))


def log_counts(entries: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Lines per day x severity x emitter for the ``days`` days up to and
    including ``as_of`` (a date), with rollup subtotals and ``grouping_id``.
    ``day`` is the timestamp of the day's start."""
    end = F.date_add(F.to_date(F.lit(as_of)), 1)
    start = F.date_sub(F.to_date(F.lit(as_of)), days - 1)
    day = F.date_trunc("day", F.col("ts"))
    window = (F.col("ts") >= start.cast("timestamp")) & (F.col("ts") < end.cast("timestamp"))
    if "run_date" in entries.columns:
        # entries read from the date-partitioned sink: prune whole partitions too
        window = window & (F.col("run_date") >= start) & (F.col("run_date") < end)
    recent = entries.filter(window)
    return (recent.withColumn("day", day)
            .rollup("day", "severity", "emitter")
            .agg(F.count(F.lit(1)).alias("n_lines"), F.grouping_id().alias("gid")))

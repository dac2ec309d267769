"""Derive the library's input tables from the driver's TPC-H-like tables.

None of the driver tables is a log, a run changelog, a schedule table or a
pipeline graph, so each registered query first derives one. Every derivation
is written once here (Spark) and once in ``runlake.plans.oracles`` (SQL), and
both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions.logs import format_entry
from runlake.operators.ordinal import ordinal


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---------------------------------------------------------------- B-log
# Fixed mapping of event types to log severities and emitters.
#   error -> ERROR, signup -> WARN, purchase -> INFO, click -> NOTICE, view -> DEBUG
#   a signup worth 90 or more is written as WARNING, a name the lookup does not know
#   emitter: job for signup and error, dbt for the rest
def severity_of(event_type: Column, value: Column) -> Column:
    return (F.when((event_type == "signup") & (value >= 90), "WARNING")
            .when(event_type == "error", "ERROR")
            .when(event_type == "signup", "WARN")
            .when(event_type == "purchase", "INFO")
            .when(event_type == "click", "NOTICE")
            .otherwise("DEBUG"))


def log_events(spark: SparkSession, sf_dir: str, chunk_unit: str = "hour", hot: bool = False) -> DataFrame:
    """events as log records: run_id, line_no, ts (UTC wall clock), severity,
    emitter, message, raw. ``line_no`` numbers each run's events by (ts,
    event_id), computed skew-safely in ``chunk_unit`` pieces of time.

    ``hot=True`` folds every view and click event into run 0, so one run holds
    about two fifths of all lines (the skew case the operators must split)."""
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    emitter = F.when(F.col("event_type").isin("signup", "error"), "job").otherwise("dbt")
    run_id = F.when(F.col("event_type").isin("view", "click"), F.lit(0).cast("bigint")).otherwise(F.col("user_id")) \
        if hot else F.col("user_id")
    d = (ev.withColumn("run_id", run_id)
         .withColumn("severity", severity_of(F.col("event_type"), F.col("value")))
         .withColumn("emitter", emitter)
         .withColumn("message", F.concat(F.lit("["), emitter, F.lit("] "), F.col("event_type"),
                                         F.lit(" "), F.col("props"))))
    d = ordinal(d, "run_id", [F.col("ts"), F.col("event_id")], F.date_trunc(chunk_unit, F.col("ts")), "line_no")
    return d.withColumn("raw", format_entry(F.col("ts"), F.col("severity"), F.col("message")))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return log_events(spark, sf_dir).select("run_id", "line_no", "raw")


# ---------------------------------------------------------------- B-state
# Fixed mapping of order status to run status: P -> running, O -> success, F -> failed.
def _status(c: Column) -> Column:
    return F.when(c == "P", "running").when(c == "O", "success").when(c == "F", "failed")


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the run-state changelog (run_id, seq, ts, field, value): each
    order writes three fields of its customer's run."""
    o = table(spark, sf_dir, "orders")
    command = F.concat(F.lit("run --select "), F.replace(F.lower("o_orderpriority"), F.lit(" "), F.lit("_")))
    offset = F.floor("o_totalprice").cast("bigint").cast("string")
    d = o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"),
                 F.col("o_orderdate").alias("ts"), _status(F.col("o_orderstatus")).alias("s"),
                 command.alias("c"), offset.alias("b"))
    return d.select("run_id", "seq", "ts", F.expr(
        "stack(3, 'run_status', s, 'user_command', c, 'log_starting_byte', b) as (field, value)"))


def status_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """run_id, seq, ts, run_status: the status writes of B-state, projected
    straight from orders so the scan reads only the columns they need."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("seq"),
                    F.col("o_orderdate").alias("ts"), _status(F.col("o_orderstatus")).alias("run_status"))


def run_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's run asks for its own minimum log level (null = default).
    Fixed mapping: AUTOMOBILE debug, BUILDING info, FURNITURE warn,
    MACHINERY error, HOUSEHOLD none."""
    c = table(spark, sf_dir, "customer")
    lvl = (F.when(F.col("c_mktsegment") == "AUTOMOBILE", "debug")
           .when(F.col("c_mktsegment") == "BUILDING", "info")
           .when(F.col("c_mktsegment") == "FURNITURE", "warn")
           .when(F.col("c_mktsegment") == "MACHINERY", "error"))
    return c.select(F.col("c_custkey").alias("run_id"), lvl.alias("log_level"))


# ---------------------------------------------------------------- B-sched
# Fixed derivation of schedules from parts.
#   deployed: parts of size 40 or less; requested: parts of size over 10
#   name: p_name-p_partkey; command: run --select model_<brand number>
#   the requested command of a PROMO part is a build instead of a run, and a
#   STANDARD part asks with the --select=<model> form
#   cron text by part type:
#     ECONOMY  <size mod 60> <key mod 24> * * *, but @daily where the size divides by 10
#     SMALL    */15 <key mod 24> * * MON-FRI
#     MEDIUM   <size> 21-3/2 * * *
#     LARGE    0 <key mod 24> 1,15 jan-JUN *
#     PROMO    30 6 * * 0,Sat
#     STANDARD <size mod 60> <key mod 24> 4 * 6
#   zone by part key mod 5: UTC, Europe/Paris, America/New_York, Asia/Kolkata, none
ZONES = ("UTC", "Europe/Paris", "America/New_York", "Asia/Kolkata", None)


def _cron(p: DataFrame) -> Column:
    m = F.pmod(F.col("p_size"), F.lit(60)).cast("string")
    h = F.pmod(F.col("p_partkey"), F.lit(24)).cast("string")
    t = F.col("p_type")
    return (F.when((t == "ECONOMY") & (F.col("p_size") % 10 == 0), "@daily")
            .when(t == "ECONOMY", F.concat_ws(" ", m, h, F.lit("* * *")))
            .when(t == "SMALL", F.concat_ws(" ", F.lit("*/15"), h, F.lit("* * MON-FRI")))
            .when(t == "MEDIUM", F.concat_ws(" ", F.col("p_size").cast("string"), F.lit("21-3/2 * * *")))
            .when(t == "LARGE", F.concat_ws(" ", F.lit("0"), h, F.lit("1,15 jan-JUN *")))
            .when(t == "PROMO", F.lit("30 6 * * 0,Sat"))
            .otherwise(F.concat_ws(" ", m, h, F.lit("4 * 6"))))


def _zone() -> Column:
    return F.element_at(F.array(*[F.lit(z) for z in ZONES]), (F.pmod("p_partkey", F.lit(len(ZONES))) + 1).cast("int"))


def _sched_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(
        "p_partkey", "p_size", "p_type",
        F.concat_ws("-", F.col("p_name"), F.col("p_partkey").cast("string")).alias("name"),
        F.concat(F.lit("run --select "), F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("model_"))).alias("command"),
        _cron(p).alias("schedule"))


def deployed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deployed(name, command, schedule, timezone, target, schedule_key)."""
    b = _sched_base(spark, sf_dir).filter(F.col("p_size") <= 40)
    return b.select("name", "command", "schedule", _zone().alias("timezone"),
                    F.lit("prod").alias("target"), F.col("p_partkey").alias("schedule_key"))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """requested(name, command, schedule)."""
    b = _sched_base(spark, sf_dir).filter(F.col("p_size") > 10)
    cmd = (F.when(F.col("p_type") == "PROMO", F.replace(F.col("command"), F.lit("run "), F.lit("build ")))
           .when(F.col("p_type") == "STANDARD", F.replace(F.col("command"), F.lit("--select "), F.lit("--select="))))
    return b.select("name", F.coalesce(cmd, F.col("command")).alias("command"), "schedule")


def scheduler_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deployed parts as raw scheduler jobs: full job path, description with
    the marker prefix (SMALL parts lack it), state PAUSED for LARGE parts."""
    b = _sched_base(spark, sf_dir).filter(F.col("p_size") <= 40)
    desc = F.when(F.col("p_type") == "SMALL", F.col("command")).otherwise(
        F.concat(F.lit("[schedule job] "), F.col("command")))
    return b.select(F.concat(F.lit("projects/runlake/locations/europe-west1/jobs/"), F.col("name")).alias("job_name"),
                    desc.alias("description"),
                    F.when(F.col("p_type") == "LARGE", "PAUSED").otherwise("ENABLED").alias("state"),
                    "schedule", F.lit("UTC").alias("time_zone"),
                    F.concat(F.lit("https://runner.example/schedule/"), F.col("p_partkey").cast("string"),
                             F.lit("/start")).alias("uri"))


# ---------------------------------------------------------------- B-hot
# Fixed derivation of rows with a hot key: the first two kinds of five go to key 0, all within
# the hour from 2024-01-10 08:00, the third has no key; the others keep their own.
def hot_starts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as starts (schedule_key, run_ts, start_id): views and clicks are of key 0 and
    lie in one hour, signups have no key."""
    ev = table(spark, sf_dir, "events")
    hot = F.col("event_type").isin("view", "click")
    hour = F.lit("2024-01-10 08:00:00").cast("timestamp_ntz")
    key = F.when(hot, F.lit(0).cast("bigint")).when(F.col("event_type") != "signup", F.col("user_id").cast("bigint"))
    ts = F.when(hot, hour + F.make_dt_interval(secs=F.pmod("event_id", F.lit(3600)))).otherwise(F.col("ts"))
    return ev.select(key.alias("schedule_key"), ts.alias("run_ts"), F.col("event_id").alias("start_id"), "event_type")


def hot_fires(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as fires (schedule_key, fire_ts): one a second or more of key 0 in the hot hour,
    some without a key, the others of their customer in January 2024."""
    o = table(spark, sf_dir, "orders")
    hot, none = F.col("o_orderkey") % 5 < 2, F.col("o_orderkey") % 5 == 2
    key = F.when(hot, F.lit(0).cast("bigint")).when(~none, F.col("o_custkey").cast("bigint"))
    base = F.when(hot, F.lit("2024-01-10 08:00:00")).otherwise(F.lit("2024-01-01 00:00:00")).cast("timestamp_ntz")
    secs = F.when(hot, F.pmod("o_orderkey", F.lit(3600))).otherwise(F.pmod(F.col("o_orderkey") * 37, F.lit(2_592_000)))
    return o.select(key.alias("schedule_key"), (base + F.make_dt_interval(secs=secs)).alias("fire_ts")).distinct()


def hot_writes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as status writes (run_id, seq, ts, run_status, priority) with the same hot key."""
    o = table(spark, sf_dir, "orders")
    hot, none = F.col("o_orderkey") % 5 < 2, F.col("o_orderkey") % 5 == 2
    key = F.when(hot, F.lit(0).cast("bigint")).when(~none, F.col("o_custkey").cast("bigint"))
    hour = F.lit("1998-01-10 08:00:00").cast("timestamp_ntz")
    ts = F.when(hot, hour + F.make_dt_interval(secs=F.pmod("o_orderkey", F.lit(600)))).otherwise(F.col("o_orderdate"))
    return o.select(key.alias("run_id"), F.col("o_orderkey").alias("seq"), ts.alias("ts"),
                    _status(F.col("o_orderstatus")).alias("run_status"), F.col("o_orderpriority").alias("priority"))


# ---------------------------------------------------------------- B-graph
# Fixed derivation of a pipeline graph from parts: node p_partkey, parent
# floor(p_partkey / 2) for keys above 1 (a binary tree with roots 0 and 1).
# Resource type by part type: ECONOMY seed, LARGE test, PROMO snapshot, else model.
def graph_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    rtype = (F.when(F.col("p_type") == "ECONOMY", "seed").when(F.col("p_type") == "LARGE", "test")
             .when(F.col("p_type") == "PROMO", "snapshot").otherwise("model"))
    return p.select(F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("node_id"),
                    rtype.alias("resource_type"),
                    F.col("p_name").alias("name"),
                    F.concat(F.lit("/projects/"), F.replace(F.lower("p_brand"), F.lit("brand#"), F.lit("p"))).alias("root_path"),
                    "p_partkey", "p_size")


def graph_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part").filter(F.col("p_partkey") > 1)
    parent = F.floor(F.col("p_partkey") / 2).cast("bigint")
    return p.select(F.concat(F.lit("n"), parent.cast("string")).alias("parent_id"),
                    F.concat(F.lit("n"), F.col("p_partkey").cast("string")).alias("child_id"))


# ---------------------------------------------------------------- B-set
# Settings from customers: scope c_nationkey, key c_mktsegment, value c_name,
# priority and write order c_custkey; a negative balance writes a delete mark.
def settings(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_nationkey").cast("string").alias("scope"), F.col("c_mktsegment").alias("key"),
                    F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("value"),
                    F.col("c_custkey").alias("priority"), F.col("c_custkey").alias("seq"),
                    F.when(F.col("c_acctbal") < 0, "delete").otherwise("set").alias("op"))


# ---------------------------------------------------------------- B-file
def files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as an artifact listing: path = url, folder = host, length = html bytes."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", F.col("url").alias("path"),
                    F.octet_length("html").cast("bigint").alias("length"))

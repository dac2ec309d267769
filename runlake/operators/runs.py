"""Run-state operators over the changelog ``run_events`` (run_id, seq, ts,
field, value) and the compacted ``run_state``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from runlake.operators.ranges import ROWS, Ranged

# The fields of a run record and the statuses the job writes.
STATE_FIELDS = ("run_status", "user_command", "log_starting_byte", "cloud_storage_folder")
STATUSES = ("scheduled", "running", "success", "failed")
LIVE_STATUSES = ("pending", "running")
# Legal status changes: a new run is scheduled or running; dependency install
# reuses the job's status path, so success -> running is legal too.
ALLOWED_TRANSITIONS = [
    ("scheduled", "running"),
    ("running", "running"),
    ("running", "success"),
    ("running", "failed"),
    ("success", "running"),
]
INITIAL_STATUSES = ("scheduled", "running")


def compact(run_events: DataFrame, fields: Sequence[str] = STATE_FIELDS) -> DataFrame:
    """Last write per (run, field) wins, ordered by (ts, seq); one row per run.

    One aggregation with a conditional ``max_by`` per field: partial aggregation
    combines a hot run map-side, no pivot pass. ``log_starting_byte`` is bigint.
    """
    order = F.struct("ts", "seq")
    aggs = []
    for f in fields:
        v = F.max_by(F.col("value"), F.when(F.col("field") == f, order))
        aggs.append((v.cast("bigint") if f == "log_starting_byte" else v).alias(f))
    return run_events.groupBy("run_id").agg(*aggs)


def get_run(state: DataFrame, run_id) -> DataFrame:
    """Point lookup; on a table clustered or bucketed by run_id it prunes files."""
    return state.filter(F.col("run_id") == F.lit(run_id))


def lookup_runs(state: DataFrame, ids: DataFrame) -> DataFrame:
    """Point lookups for a table of run ids (column run_id): a semi-join, so
    the lookup side is never collected."""
    return state.join(ids.select("run_id"), "run_id", "left_semi")


def live_runs(state: DataFrame) -> DataFrame:
    """Runs a log tail keeps following: pending or running (scheduled is not)."""
    return state.filter(F.col("run_status").isin(*LIVE_STATUSES))


def status_transitions(status_events: DataFrame, rows: int = ROWS) -> DataFrame:
    """Per status write: previous status, time until the next write and
    whether the change is legal.

    ``status_events`` has (run_id, seq, ts, run_status). Order per run is (ts,
    seq). One shuffle by (run, rank range), so one hot run does not become one
    task (``ranges.Ranged``).
    """
    d = Ranged(status_events, "run_id", ["ts", "seq"], rows).neighbours(
        before={"prev_run_status": "run_status"}, after={"next_ts": "ts"}).result()
    spark = status_events.sparkSession
    allowed = F.broadcast(spark.createDataFrame(ALLOWED_TRANSITIONS, "__a_prev string, __a_cur string")
                          .withColumn("__a_ok", F.lit(True)))
    j = d.join(allowed, (d["prev_run_status"] == allowed["__a_prev"]) & (d["run_status"] == allowed["__a_cur"]), "left")
    ok = F.when(F.col("prev_run_status").isNull(), F.col("run_status").isin(*INITIAL_STATUSES)) \
        .otherwise(F.coalesce(F.col("__a_ok"), F.lit(False)))
    return j.select("run_id", "seq", "ts", "run_status", F.col("prev_run_status").alias("prev_status"),
                    "next_ts",
                    (F.unix_timestamp("next_ts") - F.unix_timestamp("ts")).alias("secs_in_status"),
                    ok.alias("allowed"))


def transition_violations(transitions: DataFrame) -> DataFrame:
    return transitions.filter(~F.col("allowed"))


def status_counts(status_events: DataFrame, statuses: Sequence[str] = STATUSES) -> DataFrame:
    """Status writes per day (``day`` = timestamp of its start), one column per status (fixed list: no pass to
    discover pivot values), plus failure rate = failed / (success + failed)."""
    g = (status_events.withColumn("day", F.date_trunc("day", F.col("ts")))
         .groupBy("day").pivot("run_status", list(statuses)).agg(F.count(F.lit(1))))
    g = g.fillna(0, subset=list(statuses))
    done = F.col("success") + F.col("failed")
    return g.withColumn("failure_rate", F.when(done > 0, F.round(F.col("failed") / done, 4)))


def version_mismatches(clients: DataFrame, servers: DataFrame, key: str,
                       client_version: str = "client_version", server_version: str = "server_version") -> DataFrame:
    """Client/server pairs whose versions differ (exact text equality, nulls
    compare as values)."""
    j = clients.join(servers, key, "inner")
    return j.filter(~F.col(client_version).eqNullSafe(F.col(server_version)))

"""Largest task's share of shuffle records when one run holds ~40% of lines.

    python -m tests.skew_report [/root/testdata/sf0.1]

Runs line numbering twice over the same hot-run log (views and clicks folded
into run 0): once as a plain ``Window.partitionBy(run_id)`` and once through
``runlake`` (two-phase ordinal), plus byte offsets, with Spark's event log in a
fresh scratch folder; AQE partition coalescing and broadcasts are off so the
16 shuffle partitions stay visible. Prints per stage the largest task share.
"""

from __future__ import annotations

import glob
import io
import json
import sys
import tempfile

import zstandard
from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F


def main(sf: str) -> None:
    evdir = tempfile.mkdtemp(prefix="run-skew-", dir="/tmp")
    spark = (SparkSession.builder.master("local[8]").appName("skew-report")
             .config("spark.sql.shuffle.partitions", "16").config("spark.ui.enabled", "false")
             .config("spark.eventLog.enabled", "true").config("spark.eventLog.dir", evdir)
             .config("spark.sql.adaptive.coalescePartitions.enabled", "false")
             .config("spark.sql.autoBroadcastJoinThreshold", "-1")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    from runlake.operators import logs as L
    from runlake.plans import bindings as B
    from runlake.session import ensure_checkpoint_dir
    ensure_checkpoint_dir(spark)
    ev = B.table(spark, sf, "events")
    hot = ev.withColumn("run_id", F.when(F.col("event_type").isin("view", "click"), F.lit(0).cast("bigint"))
                        .otherwise(F.col("user_id")))
    sc = spark.sparkContext
    sc.setJobGroup("plain window", "plain window")
    w = Window.partitionBy("run_id").orderBy("ts", "event_id")
    hot.withColumn("line_no", F.row_number().over(w)).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("runlake line_no", "runlake line_no")
    B.log_events(spark, sf, hot=True).write.format("noop").mode("overwrite").save()
    sc.setJobGroup("runlake byte offsets", "runlake byte offsets")
    lines = B.log_events(spark, sf, hot=True).select("run_id", "line_no", "raw")
    L.with_byte_offsets(lines, lines_per_chunk=1024).write.format("noop").mode("overwrite").save()
    spark.stop()

    stage_group, tasks = {}, {}
    for f in sorted(glob.glob(evdir + "/eventlog_v2_*/events_*")):
        with open(f, "rb") as fh:
            for line in io.TextIOWrapper(zstandard.ZstdDecompressor().stream_reader(fh), encoding="utf-8"):
                e = json.loads(line)
                if e["Event"] == "SparkListenerJobStart":
                    for sid in e["Stage IDs"]:
                        stage_group[sid] = e.get("Properties", {}).get("spark.jobGroup.id")
                elif e["Event"] == "SparkListenerTaskEnd":
                    m = e.get("Task Metrics") or {}
                    tasks.setdefault(e["Stage ID"], []).append(
                        m.get("Shuffle Read Metrics", {}).get("Total Records Read", 0))
    for g in ("plain window", "runlake line_no", "runlake byte offsets"):
        worst = 0.0
        for sid, recs in sorted(tasks.items()):
            if stage_group.get(sid) == g and sum(recs) >= 50_000:
                worst = max(worst, max(recs) / sum(recs))
        print(f"{g:22s} largest task share of shuffle records: {worst:.3f} (even split: {1 / 16:.3f})")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

"""Rank ranges against plain windows, as-of matches, retries and zones against plain Python."""

import datetime as dt
import random
import zoneinfo

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlake.operators import history as H
from runlake.operators import runs as R
from runlake.operators import schedules as S
from runlake.operators.ranges import Ranged


def _rows(spark, ties):
    r = random.Random(6)
    rows = [(None, i, r.randrange(9), r.choice("xyz")) for i in range(150)]
    rows += [("hot", r.randrange(4) if ties else i * 3, i, r.choice(["x", "y", None])) for i in range(900)]
    rows += [(f"k{i % 40}", i, 0, "x") for i in range(200)] + [("nulls", None, i, "x") for i in range(120)]
    return spark.createDataFrame(rows, "k string, t bigint, n int, v string").withColumn("n", F.col("n").cast("bigint")).repartition(6)


@pytest.mark.parametrize("ties", [False, True])
def test_ranges_equal_plain_windows(spark, ties):
    df = _rows(spark, ties).dropDuplicates(["k", "t", "n"])
    d = Ranged(df, "k", ["t", "n"], rows=50)
    assert d.hot is not None and d.df.select("__g").distinct().count() > d.df.select("__k").distinct().count()
    got = (d.neighbours(before={"pv": "v", "pt": "t"}, after={"nv": "v"}).running("o").running("s", F.col("n"), inclusive=False)
           .latest("lx", F.when(F.col("v") == "x", F.col("n"))).following("fx", F.when(F.col("v") == "x", F.col("n"))).result())
    w = Window.partitionBy("k").orderBy("t", "n")
    upto, x = w.rowsBetween(Window.unboundedPreceding, 0), F.when(F.col("v") == "x", F.col("n"))
    want = (df.withColumn("pv", F.lag("v").over(w)).withColumn("pt", F.lag("t").over(w)).withColumn("nv", F.lead("v").over(w))
            .withColumn("o", F.row_number().over(w).cast("bigint"))
            .withColumn("s", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
            .withColumn("lx", F.last(x, ignorenulls=True).over(upto))
            .withColumn("fx", F.first(x, ignorenulls=True).over(w.rowsBetween(1, Window.unboundedFollowing))))
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_ranges_of_a_table_without_rows(spark):
    d = Ranged(_rows(spark, False).limit(0), "k", ["t", "n"], rows=5)
    assert d.neighbours(before={"pv": "v"}).running("o").result().count() == 0


def test_histories_shuffle_once(spark):
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "running")], "run_id int, seq int, t string, run_status string")
    ev = ev.withColumn("ts", F.to_timestamp("t")).drop("t")
    for df in (R.status_transitions(ev), H.snapshot_from_changelog(ev, "run_id", "ts", "seq", ["run_status"])):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") == 1


def _clock(seconds):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=seconds)


def _fires_and_starts(r):
    keys = [None, 1, 2, 3] + [0] * 6
    fires = sorted({(r.choice(keys), r.randrange(3000)) for _ in range(250)}, key=repr)
    starts = [(r.choice(keys), r.randrange(3000), i) for i in range(500)]
    return fires, starts


@pytest.mark.parametrize("rows", [40, 10**6])
def test_matches_of_fires_and_starts(spark, rows):
    fires, starts = _fires_and_starts(random.Random(9))
    f = spark.createDataFrame([(k, _clock(t)) for k, t in fires], "key bigint, fire_ts timestamp")
    s = spark.createDataFrame([(k, _clock(t), i) for k, t, i in starts], "key bigint, run_ts timestamp, start_id bigint")
    want_first, want_tries = set(), set()
    for k, t in fires:
        later = min((u for j, u in fires if j == k and u > t), default=10**9)
        first = min((u for j, u, _ in starts if j == k and t <= u < later), default=None)
        want_first.add((k, _clock(t), None if first is None else _clock(first), "missed" if first is None else "ran"))
        near = sorted((u, i) for j, u, i in starts if j == k and t <= u <= t + 120)[:3]
        want_tries |= {(k, _clock(t), n + 1, i, (u - t) * 1_000_000) for n, (u, i) in enumerate(near)}
    got = S.fire_adherence(f, s, "key", rows=rows).select("key", "fire_ts", "first_run_ts", "status").collect()
    assert len(got) == len(want_first) and {tuple(r) for r in got} == want_first
    got = S.retry_attempts(f, s, "key", rows=rows).select("key", "fire_ts", "attempt", "start_id", "delay_us").collect()
    assert len(got) == len(want_tries) and {tuple(r) for r in got} == want_tries
    assert max(r["attempt"] for r in got) == 3


def test_cron_horizon_in_zones(spark):
    rows = [("ny", "0 22 * * *", "America/New_York"), ("utc", "0 22 * * *", None), ("gone", "0 22 * * *", "Mars/Base"),
            ("bad", "0 25 * * *", "UTC"), ("kolkata", "@daily", "Asia/Kolkata")]
    df = spark.createDataFrame(rows, "name string, schedule string, timezone string")
    fires = sorted((r["name"], str(r["fire_ts"])) for r in S.expand_schedules(df, "2024-01-01", "2024-01-03").collect())
    assert fires == [("kolkata", "2024-01-01 18:30:00"), ("kolkata", "2024-01-02 18:30:00"), ("ny", "2024-01-01 03:00:00"),
                     ("ny", "2024-01-02 03:00:00"), ("utc", "2024-01-01 22:00:00"), ("utc", "2024-01-02 22:00:00")]
    assert sorted(r["name"] for r in S.rejected_schedules(df).collect()) == ["bad", "gone"]
    clocks = spark.createDataFrame([("c", "30 * * * *", "Europe/Paris")], "name string, schedule string, timezone string")
    spring = [str(r["fire_ts"])[11:16] for r in S.expand_schedules(clocks, "2024-03-31", "2024-04-01").orderBy("fire_ts").collect()]
    assert len(spring) == 24 and len(set(spring)) == 24  # the skipped local hour does not fire
    autumn = S.expand_schedules(clocks, "2024-10-27", "2024-10-28").orderBy("fire_ts").collect()
    assert [str(r["fire_ts"])[11:16] for r in autumn][:2] == ["00:30", "02:30"] and len(autumn) == 23  # the doubled one once, early


def test_snapshot_step_keeps_a_null_key(spark):
    hist = spark.createDataFrame([(None, "a", None), (1, "b", None)], "k int, v string, t string") \
        .select("k", "v", F.to_timestamp(F.lit("2024-01-01")).alias("valid_from"), F.to_timestamp("t").alias("valid_to"))
    cur = spark.createDataFrame([(None, "a"), (1, "b")], "k int, v string")
    out = H.snapshot(cur, hist, "k", ["v"], "2024-02-01 00:00:00").collect()
    assert len(out) == 2 and all(r["valid_to"] is None for r in out)


def test_ranges_are_no_more_than_the_rows_ask_for_and_frames_grow(spark):
    """No range of a few rows each, and no frame that is gone through again for every row."""
    df = spark.range(1500).select(F.lit("hot").alias("k"), F.lit(1).cast("bigint").alias("t"), F.col("id").alias("n"))
    d = Ranged(df, "k", ["t", "n"], rows=1000)
    assert 1 < d.df.select("__g").distinct().count() <= 6
    d = d.neighbours(after={"nn": "n"}).following("f", F.when(F.col("n") % 100 == 0, F.col("n")))
    assert "unboundedfollowing" not in d.result()._jdf.queryExecution().executedPlan().toString().lower()
    got = {r["n"]: (r["nn"], r["f"]) for r in d.result().collect()}
    assert got == {n: (n + 1 if n < 1499 else None, (n // 100 + 1) * 100 if n < 1400 else None) for n in range(1500)}


def test_fires_of_zones_with_and_without_a_change_of_clocks(spark):
    zones = ["UTC", "Asia/Kolkata", "Europe/Paris", "America/New_York", "Australia/Lord_Howe", None, "none/such"]
    df = spark.createDataFrame([(f"{z}", "15,45 * * * *", z) for z in zones], "name string, schedule string, timezone string")
    for start, end, steady in (("2024-03-29", "2024-04-01", {"UTC": 0, "Asia/Kolkata": 19800, "Europe/Paris": None, "America/New_York": -14400,
                                                             "Australia/Lord_Howe": 39600}),
                               ("2024-11-02", "2024-11-05", {"UTC": 0, "Asia/Kolkata": 19800, "Europe/Paris": 3600, "America/New_York": None,
                                                             "Australia/Lord_Howe": 39600})):
        first, last = dt.datetime.fromisoformat(start), dt.datetime.fromisoformat(end)
        assert {r["__zone"]: r["__shift"] for r in S._zone_shifts(df, start, end).collect()} == steady
        want, t = set(), first
        while t < last:
            for z in zones[:-1]:
                local = t.replace(tzinfo=dt.UTC).astimezone(zoneinfo.ZoneInfo(z or "UTC"))
                if local.minute in (15, 45) and not local.fold:  # twice: the earlier one
                    want.add((f"{z}", t))
            t += dt.timedelta(minutes=15)
        got = [(r["name"], r["fire_ts"]) for r in S.expand_schedules(df, start, end).collect()]
        assert len(got) == len(set(got)) and set(got) == want

"""Sources, sinks and streams on small fixtures: ordered text layout across
files, appends that continue line numbers, listing, and per-consumer cursors."""

import os

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from runlake.operators import logs as L
from runlake.session import scratch_path
from runlake.sources import logs as SL
from runlake.sources import objects as O
from runlake.sources.files import list_artifacts
from runlake.sources.seeds import load_seeds
from runlake.streaming import streams as SM
from tests.conftest import FIXTURES, SMALL

FIX = os.path.join(FIXTURES, "logs")


def _lines(spark, n_hot=5000):
    hot = [(7, i + 1, f"2024-01-01T00:00:00Z\tINFO\tline {i + 1}") for i in range(n_hot)]
    cold = [(k, i + 1, f"2024-01-01T00:00:00Z\tDEBUG\tx{k}-{i}") for k in range(20) if k != 7 for i in range(3)]
    return spark.createDataFrame(hot + cold, "run_id bigint, line_no bigint, raw string")


def test_text_layout_keeps_order_when_a_run_spans_files(spark):
    lines = _lines(spark)
    d = scratch_path(spark, "t-text")
    SL.write_log_text(lines, d, partitions=6)
    hot_files = [f for f in os.listdir(d.replace("file:", "") + "/run_id=7") if f.endswith(".txt")]
    assert len(hot_files) > 1  # the hot run was split over several tasks
    back = SL.read_log_text(spark, d, run_id_from="partition").withColumn("run_id", F.col("run_id").cast("bigint"))
    assert back.exceptAll(lines).count() == 0 and lines.exceptAll(back).count() == 0


@pytest.mark.parametrize("size", [7, 1 << 20])
def test_text_layout_keeps_every_run_id(spark, monkeypatch, size):
    monkeypatch.setattr(O, "RANGE_BYTES", size)
    ids = [None, "", "007", "08", "1.10", "a/b%c=1", "x+y z", "é?"]
    want = sorted((r or "~", i + 1, f"{r} {i}" if i else "") for r in ids if r for i in range(5))
    lines = spark.createDataFrame([(r, i, f"{r} {i}" if i else None) for r in ids for i in range(5)], "run_id string, line_no bigint, raw string")
    for folders in (1, 4):
        d = scratch_path(spark, "t-ids")
        SL.write_log_text(lines, d, partitions=3, folders=folders)
        got = [(r["run_id"], r["line_no"], r["raw"]) for r in SL.read_log_text(spark, d, run_id_from="partition").collect()]
        assert sorted(r for r in got if r[0] is not None) == want  # as written: numbers and points stay texts
        assert sorted(r[1] for r in got if r[0] is None) == list(range(1, 11))  # no run and the empty one share a folder
        assert all(r["size"] for r in O.list_files(spark, d).collect())
        with pytest.raises(AnalysisException):
            SL.write_log_text(lines, d)
    plain = spark.read.text(d).filter("run_id is not null")  # Spark's own names
    assert {r["run_id"] for r in plain.collect()} == {r for r in ids if r}


def test_text_layout_splits_lines_as_before(spark):
    d = scratch_path(spark, "t-ends")
    os.makedirs(d.replace("file:", "") + "/run_id=1")
    for name, data in (("part-0.txt", b"a\r\nb\rc\n"), ("part-1.txt", b"\nd\r\re"), ("part-2.txt", b""), (".part-3.tmp", b"x\n")):
        with open(f"{d}/run_id=1/{name}".replace("file:", ""), "wb") as f:
            f.write(data)
    got = SL.read_log_text(spark, d, run_id_from="partition").orderBy("line_no").collect()
    assert [(r["line_no"], r["raw"]) for r in got] == list(enumerate(["a", "b", "c", "", "d", "", "e"], 1))
    assert [r["value"] for r in spark.read.text(d).collect()].count("") == 2


def test_append_continues_line_numbers(spark):
    d = scratch_path(spark, "t-append")
    runs = spark.createDataFrame([("r1", "2024-01-02 10:00:00"), ("r2", "2024-01-02 11:00:00")], "run_id string, t string") \
        .withColumn("ts", F.to_timestamp("t"))
    SL.append_log_lines(SL.init_lines(runs), d)
    new = spark.createDataFrame([("r1", "2024-01-02 10:00:05", "INFO", "[job] a"), ("r1", "2024-01-02 10:00:06", "info", "[job] b"),
                                 ("r2", "2024-01-02 11:00:01", "ERROR", "[dbt] c")],
                                "run_id string, t string, severity string, message string").withColumn("ts", F.to_timestamp("t"))
    SL.append_log_lines(SL.number_new_lines(new, SL.read_log_lines(spark, d), ["ts", "message"]), d)
    got = {(r["run_id"], r["line_no"]): r["raw"] for r in SL.read_log_lines(spark, d).collect()}
    assert got[("r1", 1)].endswith("\tINFO\tInit")
    assert got[("r1", 2)] == "2024-01-02T10:00:05Z\tINFO\t[job] a"
    assert got[("r1", 3)] == "2024-01-02T10:00:06Z\tINFO\t[job] b"
    assert got[("r2", 2)].endswith("\tERROR\t[dbt] c") and len(got) == 5


def test_listing_and_seeds(spark):
    d = scratch_path(spark, "t-list")
    spark.createDataFrame([(1, "x")], "a int, b string").write.option("header", "true").csv(f"{d}/One.CSV")
    spark.createDataFrame([(2,)], "a int").write.parquet(f"{d}/seeds/inner.csv")
    spark.createDataFrame([(3,)], "a int").write.json(f"{d}/notes")
    files = list_artifacts(spark, d)
    rels = {r["rel_path"].split("/")[0] for r in files.collect()}
    assert rels == {"One.CSV", "seeds", "notes"}
    assert all(not r["rel_path"].startswith("/") for r in files.collect())
    seeds = load_seeds(spark, d)
    assert list(seeds) == ["One"]  # top level only, suffix test ignores case
    assert seeds["One"].collect()[0].asDict() == {"a": 1, "b": "x"}


def test_tail_cursor_per_consumer(spark):
    d = scratch_path(spark, "t-tail")
    lines = _lines(spark, n_hot=50).withColumn("run_date", F.to_date(F.lit("2024-01-01")))
    first, second = lines.filter(F.col("line_no") <= 2), lines.filter(F.col("line_no") > 2)
    SL.append_log_lines(first, f"{d}/src")
    schema = spark.read.parquet(f"{d}/src").schema

    def run(consumer):
        q = SM.tail(SM.read_stream(spark, f"{d}/src", schema), f"{d}/{consumer}-out", f"{d}/{consumer}-cursor")
        q.awaitTermination()
        return spark.read.parquet(f"{d}/{consumer}-out").count()

    assert run("a") == first.count()
    SL.append_log_lines(second, f"{d}/src")
    assert run("a") == lines.count()   # second run emits only the new lines
    assert run("b") == lines.count()   # another consumer has its own cursor


def test_summary_of_a_hot_run_is_combined_map_side(spark):
    e = L.parse_lines(_lines(spark))
    plan = e.groupBy("run_id").agg(F.count("*")).select("*")
    s = L.run_summary(e).filter(F.col("run_id") == 7).first()
    assert s["n_lines"] == 5000 and not s["finished"]
    assert plan.count() == 20


def test_follow_stops_when_run_is_terminal(spark):
    d = scratch_path(spark, "t-follow")
    lines = _lines(spark, n_hot=30).withColumn("run_date", F.to_date(F.lit("2024-01-01")))
    SL.append_log_lines(lines, f"{d}/src")
    schema = spark.read.parquet(f"{d}/src").schema
    status = {"v": "running"}

    def state():
        return spark.createDataFrame([(7, status["v"])], "run_id bigint, run_status string")

    with pytest.raises(TimeoutError):  # still running: the tail would keep polling
        SM.follow(spark, f"{d}/src", schema, f"{d}/out", f"{d}/cursor", state, 7, poll_seconds=0, max_polls=2)
    status["v"] = "success"
    assert SM.follow(spark, f"{d}/src", schema, f"{d}/out", f"{d}/cursor", state, 7, poll_seconds=0) == 1
    assert spark.read.parquet(f"{d}/out").count() == 30  # only run 7, each line once


def test_missing_log_reads_as_no_lines(spark):
    d = scratch_path(spark, "t-missing")
    assert SL.read_log_text(spark, f"{d}/nothing-here").count() == 0
    assert SL.read_log_lines(spark, f"{d}/no-sink").count() == 0


def test_log_counts_prunes_by_run_date(spark):
    lines = _lines(spark, n_hot=10).withColumn("run_date", F.to_date(F.lit("2024-01-01")))
    e = L.parse_lines(lines).withColumn("run_date", F.to_date(F.lit("2024-01-01")))
    assert L.log_counts(e, "2024-01-01", 1).filter("gid = 7").first()["n_lines"] == lines.count()
    assert L.log_counts(e, "2023-12-01", 1).count() == 0  # nothing in the window: no rows at all


def test_late_windows_do_not_hang_on_files(spark, monkeypatch):
    """Arrivals of many files, each arrival's later ranges the older files: only the late arrival is dropped."""
    from runlake.plans import catalog
    read = SM.read_stream

    def later_ranges_first(spark, path, *a, **b):
        folder = path.replace("file:", "")
        time = {f: os.path.getmtime(f"{folder}/{f}") for f in os.listdir(folder) if f.startswith("part-")}
        arrivals = {}
        for f in sorted(time, key=time.get):
            arrivals.setdefault(f[len("part-00000-"):][:36], []).append(f)  # by the write's id
        for i, files in enumerate(arrivals.values()):
            assert len(files) > 2
            for j, f in enumerate(sorted(files, reverse=True)):
                os.utime(f"{folder}/{f}", (min(time.values()) - 1000 + 100 * i + j,) * 2)
        return read(spark, path, *a, **b)

    events = spark.read.parquet(f"{SMALL}/events.parquet")
    monkeypatch.setattr(SM, "read_stream", later_ranges_first)
    spark.conf.set("spark.sql.files.maxRecordsPerFile", events.count() // 10)
    try:
        got = catalog.QUERIES["stream_late"](spark, SMALL)
        hour = F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("window_start")
        want = events.filter("ts >= '2024-01-15'").groupBy(hour, "event_type").agg(F.count("*").alias("n"))
        got = got.select(*want.columns)
        assert want.count() and got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxRecordsPerFile")


def test_schedule_specs_as_yaml_documents(spark, tmp_path):
    """Any text as a value, several documents, entries that are no mapping, and none."""
    from runlake.sources.schedules import read_schedule_specs, write_schedule_specs
    rows = [(f"s{i}", f"run --select m{i}", "0 1 * * *") for i in range(20)]
    rows += [("a: b # c", 'say "hi": {x}', "*/5 * * * *"), ("é\n\tq'", None, "- 1"), ("yes", "null", None), ("2024-01-01", "", "1")]
    written = spark.createDataFrame([*rows, (None, "lost", "1")], "name string, command string, schedule string")
    path = str(tmp_path / "specs.yaml")
    write_schedule_specs(written, path, entries=2)
    assert len(list((tmp_path / "specs.yaml").glob("*.txt"))) >= 12
    key = lambda r: str(tuple(r))
    assert sorted(map(tuple, read_schedule_specs(spark, path).collect()), key=key) == sorted(rows, key=key)
    (tmp_path / "odd.yml").write_text("one: 3\ntwo:\nthree: {command: 7, schedule: [1]}\n")
    (tmp_path / "none.yml").write_text("")
    assert sorted(map(tuple, read_schedule_specs(spark, str(tmp_path / "*.yml")).collect())) == [
        ("one", None, None), ("three", "7", "[1]"), ("two", None, None)]

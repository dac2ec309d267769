"""Log objects that grow, with a cursor for each consumer; compaction of the run state."""

import os
import random

import pytest
from pyspark.sql import functions as F

from runlake.session import scratch_path
from runlake.sources import objects as SO
from runlake.streaming import growing as SG
from runlake.streaming import streams as SM


def _put(folder, run, data):
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/{run}.txt", "wb") as f:
        f.write(data)


def _tail(spark, consumer):
    got = {}
    for r in SG.read_tail(spark, consumer).orderBy("run_id", "line_no").collect():
        got.setdefault(r["run_id"], []).append((r["line_no"], r["raw"]))
    assert all([n for n, _ in rows] == list(range(1, len(rows) + 1)) for rows in got.values())
    return {k: [t for _, t in rows] for k, rows in got.items()}


@pytest.mark.parametrize("size", [5, 64, 1 << 20])
def test_growing_objects_lose_and_repeat_nothing(spark, monkeypatch, size):
    monkeypatch.setattr(SO, "RANGE_BYTES", size)
    folder, consumer = scratch_path(spark, "g-in").replace("file:", ""), scratch_path(spark, "g-a")
    r = random.Random(size)
    lines = {f"run-{k}": ["é" * r.randrange(9) + f"{k} {i}" * r.randrange(4) for i in range(r.randrange(1, 60))] for k in range(4)}
    whole = {k: "\n".join(v).encode() for k, v in lines.items()}
    cuts = {k: sorted(r.randrange(len(w) + 1) for _ in range(3)) for k, w in whole.items()}
    for step in range(3):
        for k, w in whole.items():
            _put(folder, k, w[:cuts[k][step]])
        SG.poll(spark, folder, consumer)
        got = _tail(spark, consumer)
        for k, w in whole.items():  # every closed line, none that is still open
            assert got.get(k, []) == w[:cuts[k][step]].decode("utf-8", "ignore").split("\n")[:-1]
    for k, w in whole.items():
        _put(folder, k, w)
    over = spark.createDataFrame([(k,) for k in lines], "run_id string")
    SG.poll(spark, folder, consumer, finished=over)
    want = {k: v if v[-1] else v[:-1] for k, v in lines.items()}
    assert _tail(spark, consumer) == {k: v for k, v in want.items() if v}
    n = SG.read_tail(spark, consumer).count()
    SG.poll(spark, folder, consumer, finished=over)
    assert SG.read_tail(spark, consumer).count() == n  # nothing new


def test_consumers_and_a_poll_that_failed(spark, monkeypatch):
    folder, a, b = (scratch_path(spark, f"g2-{x}").replace("file:", "") for x in ("in", "a", "b"))
    _put(folder, "r", b"one\ntwo\n")
    SG.poll(spark, folder, a)
    _put(folder, "r", b"one\ntwo\nthree\n")
    with monkeypatch.context() as m:  # lost after the lines, before the cursors
        m.setattr(SG, "Window", None)
        with pytest.raises(AttributeError):
            SG.poll(spark, folder, a)
    assert _tail(spark, a) == {"r": ["one", "two"]}
    assert SG.poll(spark, folder, a) == 1 and _tail(spark, a) == {"r": ["one", "two", "three"]}
    SG.poll(spark, folder, b)
    assert _tail(spark, b) == {"r": ["one", "two", "three"]}
    cursor = SG.read_cursors(spark, a).first()
    assert (cursor["bytes_read"], cursor["lines_read"]) == (14, 3)
    _put(folder, "r", b"one\n")  # shrunk: left alone
    SG.poll(spark, folder, a)
    assert _tail(spark, a) == {"r": ["one", "two", "three"]}
    os.makedirs(f"{folder}-none")
    SG.poll(spark, f"{folder}-none", f"{a}-none")
    assert SG.read_tail(spark, f"{a}-none").count() == 0


def test_follow_ends_with_the_runs(spark):
    folder, a = (scratch_path(spark, f"g3-{x}").replace("file:", "") for x in ("in", "a"))
    status = {"v": "running"}
    _put(folder, "r", b"x")

    def state():
        return spark.createDataFrame([("r", status["v"])], "run_id string, run_status string")

    def wait():
        _put(folder, "r", b"x\ny")
        status["v"] = "success"

    with pytest.raises(TimeoutError):
        SG.follow_objects(spark, folder, a, state, lambda: None, max_polls=1)
    assert SG.follow_objects(spark, folder, a, state, wait) == 2
    assert _tail(spark, a) == {"r": ["x", "y"]}


def test_objects_are_written_one_a_run(spark):
    d = scratch_path(spark, "g4")
    lines = spark.createDataFrame([(k, i, f"{k}:{i}") for k in ("a", "b", "c") for i in range(30)], "run_id string, line_no bigint, raw string")
    SO.write_log_objects(lines.repartition(5), d)
    assert sorted(f for f in os.listdir(d.replace("file:", ""))) == ["a.txt", "b.txt", "c.txt"]
    assert sorted((r["run_id"], r["size"]) for r in SO.list_objects(spark, d).collect()) == [(k, 10 * 4 + 20 * 5) for k in "abc"]


def test_objects_in_folders_are_listed_and_read_by_tasks(spark, monkeypatch):
    monkeypatch.setattr(SO, "RANGE_BYTES", 16)
    d, a = scratch_path(spark, "g6"), scratch_path(spark, "g6-a")
    want = {f"r{k}": [f"{k}:{i}" for i in range(k + 1)] for k in range(40)}
    lines = spark.createDataFrame([(k, i, t) for k, v in want.items() for i, t in enumerate(v)] + [(None, 0, "x")],
                                  "run_id string, line_no bigint, raw string")
    for upto in (5, 99):  # the second replaces the first
        SO.write_log_objects(lines.filter(F.col("line_no") < upto), d, folders=8)
        found = SO.list_objects(spark, d)
        assert sorted((r["run_id"], r["size"]) for r in found.collect()) == sorted(
            (k, sum(len(t) + 1 for t in v[:upto])) for k, v in want.items())  # .txt is hidden
        assert "binaryFile" not in found._jdf.queryExecution().toString()
        SG.poll(spark, d, a)
        assert _tail(spark, a) == {k: v[:upto] for k, v in want.items()}
    assert len([f for f in os.listdir(d.replace("file:", ""))]) == 8
    again = SO.list_objects(spark, d)
    os.remove(found.first()["object"].replace("file:", ""))
    assert again.count() == 40 and SO.list_objects(spark, d).count() == 39  # a listing is made once


def test_compacted_state_under_a_reader(spark):
    d = scratch_path(spark, "g5")
    schema = "run_id bigint, seq bigint, ts timestamp, field string, value string"

    def arrive(seq, value):
        ev = spark.createDataFrame([(r, seq, "run_status", f"{value}{r}") for r in range(20)], "run_id bigint, seq bigint, field string, value string")
        ev.select("run_id", "seq", F.to_timestamp(F.lit(f"2024-01-01 00:00:{seq:02d}")).alias("ts"), "field", "value").write.mode("append").parquet(f"{d}/src")
        SM.stream_state(SM.read_stream(spark, f"{d}/src", spark.createDataFrame([], schema).schema), f"{d}/state", f"{d}/cursor").awaitTermination()

    values = lambda df: {r["run_status"] for r in df.collect()}
    arrive(1, "a")
    assert SM.compact_state(spark, f"{d}/state") == 0
    arrive(2, "b")
    reader = SM.state_table(spark, f"{d}/state", ("run_status",))  # planned before the switch
    assert SM.compact_state(spark, f"{d}/state") >= 1
    want = {f"b{r}" for r in range(20)}
    assert values(reader) == want and values(SM.state_table(spark, f"{d}/state", ("run_status",))) == want
    rows = SM._changes(spark, f"{d}/state").select(F.input_file_name().alias("f")).collect()
    assert len(rows) == 20 and all("-base/" in r["f"] for r in rows)  # only the base is left to read
    arrive(3, "c")
    assert values(SM.state_table(spark, f"{d}/state", ("run_status",))) == {f"c{r}" for r in range(20)}

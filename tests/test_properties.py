"""Properties: plan application converges, ranged reads cover every line once,
parse inverts format, compaction ignores input order, skew-safe helpers equal
the plain window functions, snapshot steps rebuild the changelog history."""

import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import Window
from pyspark.sql import functions as F

from runlake.functions.logs import format_entry
from runlake.operators import history as H
from runlake.operators import logs as L
from runlake.operators import ordinal as O
from runlake.operators import runs as R
from runlake.operators import schedules as S
from runlake.plans import bindings as B
from tests.conftest import SMALL


def test_apply_plan_then_diff_is_empty(spark):
    dep, req = B.deployed(spark, SMALL), B.requested(spark, SMALL)
    plan = S.schedule_diff(dep, req, "fields")
    after = S.apply_plan(dep, req, plan, target="prod")
    assert S.schedule_diff(after, req, "fields").count() == 0
    assert after.count() == req.count()


def test_read_since_covers_every_line_once(spark):
    lines = B.log_lines(spark, SMALL).filter(F.col("run_id") < 20).cache()
    cur = lines.select("run_id").distinct().withColumn("cursor", F.lit(0).cast("bigint"))
    pieces, new = L.read_since(lines, cur)
    assert pieces.count() == lines.count()
    assert pieces.filter("partial").count() == 0
    again, newer = L.read_since(lines, new.select("run_id", F.col("new_cursor").alias("cursor")))
    assert again.count() == 0
    same = newer.filter(F.col("new_cursor") != F.col("cursor")).count()
    assert same == 0  # nothing read, no advance


@settings(max_examples=5, deadline=None)
@given(st.lists(st.text(alphabet=st.characters(blacklist_characters="\t\n\r", blacklist_categories=("Cs",)),
                        max_size=30), min_size=1, max_size=20))
def test_parse_inverts_format(spark, messages):
    rows = [(1, i + 1, f"2024-02-0{1 + i % 9} 10:0{i % 10}:00", "info", m) for i, m in enumerate(messages)]
    df = spark.createDataFrame(rows, "run_id int, line_no int, t string, sev string, msg string") \
        .withColumn("ts", F.to_timestamp("t"))
    lines = df.select("run_id", "line_no", format_entry(F.col("ts"), F.col("sev"), F.col("msg")).alias("raw"))
    back = L.parse_lines(lines).orderBy("line_no").collect()
    assert [r["message"] for r in back] == messages
    assert all(r["severity"] == "INFO" for r in back)
    assert [r["ts"] for r in back] == [r["ts"] for r in df.orderBy("line_no").collect()]


def test_compaction_ignores_input_order(spark):
    ev = B.run_events(spark, SMALL)
    rows = ev.collect()
    random.Random(7).shuffle(rows)
    shuffled = spark.createDataFrame(rows, ev.schema).repartition(5)
    a = R.compact(ev, ("run_status", "user_command", "log_starting_byte"))
    b = R.compact(shuffled, ("run_status", "user_command", "log_starting_byte"))
    assert a.exceptAll(b).count() == 0 and b.exceptAll(a).count() == 0


def _skewed(spark):
    # one key holds most rows, spread over many chunks
    hot = [(0, i, i // 7) for i in range(3000)]
    cold = [(k, i, i) for k in range(1, 50) for i in range(20)]
    return spark.createDataFrame(hot + cold, "k int, t int, v int")


def test_ordinal_equals_row_number_under_skew(spark):
    df = _skewed(spark)
    got = O.ordinal(df, "k", [F.col("t"), F.col("v")], F.floor(F.col("t") / 100), "ord")
    want = df.withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy("t", "v")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_prefix_sum_equals_window_sum(spark):
    df = _skewed(spark)
    got = O.prefix_sum(df, "k", [F.col("t")], F.col("v").cast("bigint"), F.floor(F.col("t") / 128), "s", inclusive=False)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum(F.col("v").cast("bigint")).over(w), F.lit(0)).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_top_k_per_group_equals_window(spark):
    df = _skewed(spark)
    got = O.top_k_per_group(df, "k", [F.col("v").desc(), F.col("t")], 5)
    w = Window.partitionBy("k").orderBy(F.col("v").desc(), F.col("t"))
    want = df.withColumn("rank", F.row_number().over(w).cast("bigint")).filter("rank <= 5")
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_neighbours_equal_lag_lead(spark):
    df = O.ordinal(_skewed(spark), "k", [F.col("t")], F.floor(F.col("t") / 100), "o")
    got = O.with_neighbour(O.with_neighbour(df, "k", "o", ["v"], 1, "p_"), "k", "o", ["v"], -1, "n_")
    w = Window.partitionBy("k").orderBy("o")
    want = df.withColumn("p_v", F.lag("v").over(w)).withColumn("n_v", F.lead("v").over(w))
    assert got.exceptAll(want.select(*got.columns)).count() == 0


def test_snapshot_steps_rebuild_history(spark):
    o = spark.read.parquet(f"{SMALL}/orders.parquet").select("o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus")
    full = H.snapshot_from_changelog(o, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderstatus"])
    # replay: state of each customer at two cut dates, applied as snapshot steps
    w = Window.partitionBy("o_custkey").orderBy(F.col("o_orderdate").desc(), F.col("o_orderkey").desc())
    hist = spark.createDataFrame([], "o_custkey bigint, o_orderstatus string, valid_from timestamp_ntz, valid_to timestamp_ntz")
    for cut in ("1997-01-01", "1999-01-01"):
        cur = (o.filter(F.col("o_orderdate") < F.lit(cut).cast("timestamp_ntz"))
               .withColumn("r", F.row_number().over(w)).filter("r = 1").select("o_custkey", "o_orderstatus"))
        hist = H.snapshot(cur, hist, "o_custkey", ["o_orderstatus"], cut)
    # every open row of the replay equals the full history's state as of the last cut
    as_of = F.lit("1999-01-01").cast("timestamp_ntz")
    state = (full.filter((F.col("valid_from") < as_of) & (F.col("valid_to").isNull() | (F.col("valid_to") >= as_of)))
             .select("o_custkey", "o_orderstatus"))
    open_rows = hist.filter(F.col("valid_to").isNull()).select("o_custkey", "o_orderstatus")
    assert open_rows.exceptAll(state).count() == 0 and state.exceptAll(open_rows).count() == 0


def test_global_ordinal_equals_row_number(spark):
    df = _skewed(spark)
    got = O.global_ordinal(df, [F.col("v").desc(), F.col("k"), F.col("t")], "pos", partitions=7)
    want = df.withColumn("pos", F.row_number().over(Window.orderBy(F.col("v").desc(), "k", "t")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_small_lookups_and_reports(spark):
    from runlake.operators.artifacts import seed_files
    from runlake.sources.state import new_run_events
    runs = spark.createDataFrame([("a", "run --select m"), ("b", "build")], "run_id string, user_command string") \
        .withColumn("ts", F.to_timestamp(F.lit("2024-01-01 00:00:00")))
    state = R.compact(new_run_events(runs))
    a = R.get_run(state, "a").collect()
    assert len(a) == 1 and a[0]["run_status"] == "scheduled" and a[0]["log_starting_byte"] == 0
    assert a[0]["cloud_storage_folder"] == "" and a[0]["user_command"] == "run --select m"
    assert R.live_runs(state).count() == 0  # scheduled is not followed
    files = spark.createDataFrame([("x/a.CSV",), ("x/b.csv.gz",), ("x/c.csv",)], "base_name string")
    assert [r[0] for r in seed_files(files).orderBy("base_name").collect()] == ["x/a.CSV", "x/c.csv"]
    ev = spark.createDataFrame([(1, 1, "2024-01-01 00:00:00", "success"), (1, 2, "2024-01-01 00:00:01", "failed")],
                               "run_id int, seq int, t string, run_status string").withColumn("ts", F.to_timestamp("t"))
    bad = R.transition_violations(R.status_transitions(ev)).collect()
    assert [(r["seq"], r["prev_status"], r["run_status"]) for r in bad] == [(1, None, "success"), (2, "success", "failed")]


def test_ordinal_numbers_null_keys_like_a_value(spark):
    rows = [(None, i) for i in range(300)] + [(1, i) for i in range(5)]
    df = spark.createDataFrame(rows, "k int, t int")
    got = O.ordinal(df, "k", [F.col("t")], F.floor(F.col("t") / 50), "o")
    want = df.withColumn("o", F.row_number().over(Window.partitionBy("k").orderBy("t")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_chunked_mode_equals_plain_windows(spark):
    df = _skewed(spark)
    got = O.ordinal(df, "k", [F.col("t"), F.col("v")], F.floor(F.col("t") / 100), "ord")
    want = df.withColumn("ord", F.row_number().over(Window.partitionBy("k").orderBy("t", "v")).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()
    got = O.prefix_sum(df, "k", [F.col("t")], F.col("v").cast("bigint"), F.floor(F.col("t") / 128), "s",
                       inclusive=False)
    w = Window.partitionBy("k").orderBy("t").rowsBetween(Window.unboundedPreceding, -1)
    want = df.withColumn("s", F.coalesce(F.sum(F.col("v").cast("bigint")).over(w), F.lit(0)).cast("bigint"))
    assert got.exceptAll(want).count() == 0 and got.count() == want.count()


def test_cron_forms(spark):
    from runlake.functions.cron import parse_cron
    texts = ["0 9 * * MON-FRI", "0 9 1 JAN *", "0 22-2 * * *", "@daily", "*/20 5 * * 7", "0 0 * * FRI-MON",
             "*/0 * * * *", "0 9 * *", "61 0 * * *", "a b c d e", "", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    parsed = {r["t"]: r for r in parse_cron(rows, "t").collect()}
    got = [parsed[t] if parsed[t]["ok"] else None for t in texts]
    assert got[0]["weekday"] == [1, 2, 3, 4, 5] and got[1]["month"] == [1] and got[2]["hour"] == [0, 1, 2, 22, 23]
    assert got[3]["minute"] == [0] and got[3]["hour"] == [0] and got[3]["day_star"]
    assert got[4]["minute"] == [0, 20, 40] and got[4]["weekday"] == [0]
    assert got[5]["weekday"] == [0, 1, 5, 6]
    assert got[6:] == [None] * 6


def test_log_text_edges(spark):
    from runlake.functions import logs as LF
    lines = ["2024-05-01T10:00:00Z\tINFO\tx", "no tabs", "bad time\tINFO\tx", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, t string")
    got = df.select("i", LF.parse_entry("t").alias("e"), LF.malformed("t").alias("bad")).orderBy("i").collect()
    assert [r["bad"] for r in got] == [False, True, True, True] and got[1]["e"]["ts"] is None
    j = spark.createDataFrame([('{"data": {}, "info": {"level": "warn", "msg": "m"}}',), ('{"level": "info", "msg": "n"}',)], "t string")
    assert [tuple(r["j"]) for r in j.select(LF.json_event("t").alias("j")).collect()] == [("warn", "m"), ("info", "n")]


def test_golden_result_lines(spark):
    from runlake.functions.logs import with_node_result
    # Result lines as the runner prints them, cut off inside the bracket.
    lines = ["[dbt] 2 of 8 OK loaded seed file test.test_seed ...................................... [INSERT 1",
             "[dbt] 3 of 8 FAIL 1 not_null_my_first_dbt_model_id ................................... [FAIL 1",
             "[dbt] 4 of 8 PASS unique_my_first_dbt_model_id ....................................... [PASS in "]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(lines)], "i int, line string")
    got = [r["r"] for r in with_node_result(df, "line").orderBy("i").collect()]
    assert [(r["idx"], r["status"], r["failures"], r["node"], r["result"]) for r in got] == [
        (2, "OK", 0, "loaded seed file test.test_seed", "INSERT 1"),
        (3, "FAIL", 1, "not_null_my_first_dbt_model_id", "FAIL 1"),
        (4, "PASS", 0, "unique_my_first_dbt_model_id", "PASS")]


def test_read_since_at_the_end_gives_nothing(spark):
    from runlake.operators.logs import read_since
    lines = spark.createDataFrame([(1, 1, "abcdef"), (2, 1, "xy"), (2, 2, "z")], "run_id bigint, line_no bigint, raw string")
    cursors = spark.createDataFrame([(1, 6), (2, 1)], "run_id bigint, cursor bigint")
    pieces, new = read_since(lines, cursors)
    assert sorted(tuple(r) for r in pieces.select("run_id", "piece").collect()) == [(2, "y"), (2, "z")]
    assert sorted((r["run_id"], r["new_cursor"]) for r in new.collect()) == [(1, 6), (2, 5)]


def test_null_keys_have_neighbours(spark):
    from runlake.operators.ordinal import ordinal, with_neighbour
    df = spark.createDataFrame([(None, 1), (None, 2), ("a", 1)], "k string, t int")
    d = with_neighbour(ordinal(df, "k", [F.col("t")], F.col("t"), "n"), "k", "n", ["t"], 1, "prev_")
    assert sorted((r["k"] or "", r["t"], r["prev_t"]) for r in d.collect()) == [("", 1, None), ("", 2, 1), ("a", 1, None)]

"""Golden tests on the reference's own sample project, schedule file and log lines."""

import os

import pytest
from pyspark.sql import functions as F

from runlake.functions import commands as C
from runlake.functions import cron
from runlake.functions import logs as LF
from runlake.functions import settings as FS
from runlake.operators import lineage as G
from runlake.operators import logs as L
from runlake.operators import schedules as S
from runlake.plans import models as M
from runlake.session import scratch_path
from runlake.sources import logs as SL
from runlake.sources.schedules import read_schedule_specs
from tests.conftest import FIXTURES

SAMPLE = M.Project(
    "sample",
    models=[
        M.Model("my_first_dbt_model", """
            WITH source_data AS (SELECT 1 AS id UNION ALL SELECT NULL AS id)
            SELECT * FROM source_data""", materialized="table"),
        M.Model("my_second_dbt_model", "SELECT * FROM my_first_dbt_model WHERE id = 1",
                depends_on=("my_first_dbt_model",)),
        M.Model("model_with_seeds", "SELECT * FROM test_seed", materialized="table", depends_on=("test_seed",)),
    ],
    seeds_dir=os.path.join(FIXTURES, "project", "seeds"),
    checks=[M.Check("my_first_dbt_model", "id", "unique"), M.Check("my_first_dbt_model", "id", "not_null"),
            M.Check("my_second_dbt_model", "id", "unique"), M.Check("my_second_dbt_model", "id", "not_null")],
)


def test_build_goes_on_after_a_broken_model(spark):
    project = M.Project("broken", [M.Model("lost", "select * from no_such_table_here"),
                                   M.Model("after_lost", "select * from lost", depends_on=("lost",)),
                                   M.Model("sound", "select 1 as id", materialized="table")])
    got = {r["node_id"]: r for r in M.build(spark, project, scratch_path(spark, "broken")).collect()}
    assert {k: r["status"] for k, r in got.items()} == {
        "model.lost": "ERROR", "model.after_lost": "SKIP", "model.sound": "OK"}
    assert "no_such_table_here" in got["model.lost"]["result"] and got["model.sound"]["rows"] == 1


def test_build_sample_project(spark):
    res = M.build(spark, SAMPLE, scratch_path(spark, "build"))
    rows = {r["node_id"]: r for r in res.collect()}
    assert len(rows) == 8 and {r["total"] for r in rows.values()} == {8}
    assert rows["seed.test_seed"]["result"] == "INSERT 1"
    assert rows["test.not_null_my_first_dbt_model_id"]["status"] == "FAIL 1"
    assert rows["test.unique_my_first_dbt_model_id"]["status"] == "PASS"
    assert rows["model.my_second_dbt_model"]["status"] == "SKIP"
    assert rows["test.unique_my_second_dbt_model_id"]["status"] == "SKIP"
    assert rows["model.model_with_seeds"]["rows"] == 1
    assert spark.table("model_with_seeds").collect()[0].asDict() == {"a": 1, "b": 2}
    # order respects dependencies
    idx = {k: r["idx"] for k, r in rows.items()}
    assert idx["seed.test_seed"] < idx["model.model_with_seeds"]
    assert idx["model.my_first_dbt_model"] < idx["test.not_null_my_first_dbt_model_id"]
    lines = [r["line"] for r in M.result_lines(res).orderBy("idx").collect()]
    parsed = LF.with_node_result(spark.createDataFrame([(x,) for x in lines], "line string"), "line")
    fail = parsed.filter(F.col("r.status") == "FAIL").select("r.*").collect()
    assert [(r["node"], r["failures"], r["result"]) for r in fail] == [("not_null_my_first_dbt_model_id", 1, "FAIL 1")]


def test_model_materialisation_default_is_view(spark):
    m = SAMPLE.models[1]
    assert M.model_config(m, SAMPLE) == "view"
    assert M.model_config(SAMPLE.models[0], SAMPLE) == "table"


def _deployed(spark, rows):
    return spark.createDataFrame(rows, "name string, command string, schedule string, timezone string, target string")


def test_schedule_set_plan_from_reference_case(spark):
    deployed = _deployed(spark, [("test-schedule-1", "run --select model_that_does_not_exist", "1 2 3 4 5",
                                  "UTC", "https://x/schedule/1/start")])
    requested = read_schedule_specs(spark, os.path.join(FIXTURES, "schedules.yaml"))
    plan = S.order_plan(S.schedule_diff(deployed, requested)).collect()
    assert [(r["action"], r["name"]) for r in plan] == [("add", "test-schedule-2"), ("delete", "test-schedule-1")]
    after = S.apply_plan(deployed, requested, S.schedule_diff(deployed, requested))
    names = spark.createDataFrame([("test-schedule-1",)], "name string")
    d = S.describe_schedules(after, names).collect()[0]
    assert d["message"] == "Found no schedule named 'test-schedule-1'"
    _, out = S.delete_schedules(after, spark.createDataFrame([("test-schedule-2",)], "name string"))
    assert out.collect()[0]["message"] == "Schedule test-schedule-2 deleted"
    _, out = S.delete_schedules(after, spark.createDataFrame([("nope",)], "name string"), where="p/l")
    assert out.collect()[0]["message"] == "Nothing to delete, schedule nope does not exist or is disabled in p/l"


def test_three_way_plan_redeploys_unchanged_by_default(spark):
    deployed = _deployed(spark, [("schedule-2", "run", "0 * * * *", "UTC", "t"), ("schedule-3", "run", "0 1 * * *", "UTC", "t")])
    requested = spark.createDataFrame([("schedule-1", "build", "0 2 * * *"), ("schedule-3", "run", "0 1 * * *")],
                                      "name string, command string, schedule string")
    always = {(r["action"], r["name"]) for r in S.schedule_diff(deployed, requested).collect()}
    assert always == {("add", "schedule-1"), ("delete", "schedule-2"), ("redeploy", "schedule-3")}
    fields = {(r["action"], r["name"]) for r in S.schedule_diff(deployed, requested, "fields").collect()}
    assert fields == {("add", "schedule-1"), ("delete", "schedule-2")}


def test_list_schedules_prefix_and_state(spark):
    jobs = spark.createDataFrame([
        ("projects/p/locations/l/jobs/a", "[schedule job] run --select x", "ENABLED", "1 * * * *", "UTC", "u"),
        ("projects/p/locations/l/jobs/b", "[schedule job] run", "PAUSED", "1 * * * *", "UTC", "u"),
        ("projects/p/locations/l/jobs/c", "other job", "ENABLED", "1 * * * *", "UTC", "u"),
    ], "job_name string, description string, state string, schedule string, time_zone string, uri string")
    got = S.list_schedules(jobs).collect()
    assert [(r["name"], r["command"]) for r in got] == [("a", "run --select x")]


@pytest.mark.parametrize("rule,expected", [("or", 4), ("and", 1)])
def test_cron_day_rule(spark, rule, expected):
    df = spark.createDataFrame([("s", "2 3 4 5 6")], "name string, schedule string")
    fires = S.expand_schedules(df, "2024-01-01", "2025-01-01", day_rule=rule).collect()
    assert len(fires) == expected
    assert all(r["fire_ts"].hour == 3 and r["fire_ts"].minute == 2 and r["fire_ts"].month == 5 for r in fires)


def test_cron_fields(spark):
    df = spark.createDataFrame([("*/15 9-17/4 1,15 * 0,7",)], "s string")
    r = cron.parse_cron(df, "s").first()
    assert r["minute"] == [0, 15, 30, 45] and r["hour"] == [9, 13, 17]
    assert r["day"] == [1, 15] and r["month"] == list(range(1, 13)) and r["weekday"] == [0]


def test_read_text_logs_and_parse(spark):
    lines = SL.read_log_text(spark, os.path.join(FIXTURES, "logs"))
    counts = {r["run_id"]: r["n"] for r in lines.groupBy("run_id").agg(F.count("*").alias("n")).collect()}
    assert counts == {"run-a": 7, "run-b": 2}  # the empty object yields no lines
    e = L.parse_lines(lines).filter(F.col("run_id") == "run-a").orderBy("line_no").collect()
    assert e[0]["message"] == "Init" and e[0]["emitter"] == ""
    assert e[1]["emitter"] == "dbt" and e[5]["emitter"] == "job"
    assert e[2]["severity"] == "ERROR"
    s = L.run_summary(L.parse_lines(lines)).filter(F.col("run_id") == "run-a").first()
    assert s["finished"] and s["succeeded"] and s["n_errors"] == 2 and s["duration_s"] == 8


def test_json_event_fields(spark):
    lines = SL.read_log_text(spark, os.path.join(FIXTURES, "logs")).filter(F.col("run_id") == "run-b")
    e = L.parse_lines(lines).filter(F.col("line_no") == 2).select(LF.json_event("message").alias("j")).first()["j"]
    assert e["level"] == "warn" and e["msg"].startswith("Nothing to do")


def test_severity_lookup_quirks(spark):
    df = spark.createDataFrame([(1, 1, "warn"), (1, 2, "WARNING"), (1, 3, "emergency")],
                               "run_id int, line_no int, severity string")
    known, unknown = L.with_severity_rank(df)
    assert {r["severity"]: r["severity_rank"] for r in known.collect()} == {"warn": 30, "emergency": 50}
    assert [r["severity"] for r in unknown.collect()] == ["WARNING"]


def test_level_filter_uses_registered_scale(spark):
    e = spark.createDataFrame([(1, 1, "NOTICE"), (1, 2, "INFO"), (2, 1, "NOTICE")], "run_id int, line_no int, severity string")
    runs = spark.createDataFrame([(1, None), (2, "debug")], "run_id int, log_level string")
    vis, hid = L.split_by_level(e, runs)
    assert {(r["run_id"], r["line_no"]) for r in vis.collect()} == {(1, 2), (2, 1)}  # NOTICE 15 < INFO 20
    assert {(r["run_id"], r["line_no"]) for r in hid.collect()} == {(1, 1)}


def test_format_and_prefix(spark):
    df = spark.createDataFrame([("a\nb", "text"), ('{"x":\n1}', "json")], "m string, f string")
    got = [r[0] for r in df.select(LF.prefix_message("m", "f")).collect()]
    assert got == ["[dbt] a  b", '{"x":  1}']


def test_manifest_nodes_edges_and_seed_root(spark):
    nodes = G.read_manifest(spark, os.path.join(FIXTURES, "manifest.json"))
    assert nodes.count() == 4
    edges = G.edges_from_nodes(nodes)
    assert {(r[0], r[1]) for r in edges.collect()} == {
        ("model.proj.my_first_dbt_model", "model.proj.my_second_dbt_model"),
        ("seed.proj.test_seed", "model.proj.model_with_seeds")}
    fixed = {r["node_id"]: r["root_path"] for r in G.fix_seed_root(nodes).collect()}
    assert fixed["seed.proj.test_seed"] == "." and fixed["model.proj.model_with_seeds"] == "/srv/build/proj"
    lv = {r["node_id"]: r["level"] for r in G.dag_levels(nodes, edges).collect()}
    assert lv["model.proj.my_second_dbt_model"] == 1 and lv["seed.proj.test_seed"] == 0
    assert G.select_nodes(nodes, ["does_not_exist"]).count() == 0
    assert G.select_nodes(nodes, None).count() == 4


def test_dag_levels_rejects_rooted_cycle(spark):
    nodes = spark.createDataFrame([("a",), ("b",), ("c",)], "node_id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "b")], "parent_id string, child_id string")
    with pytest.raises(G.CycleError):
        G.dag_levels(nodes, edges)
    assert {r["node_id"] for r in G.closure(edges, nodes.filter("node_id = 'a'")).collect()} == {"b", "c"}


def test_command_quotes(spark):
    import shlex
    texts = ["run --select 'a b'", 'run  --vars "{x: 1}"\t--select m', 'a"b c"d', "it\\'s", '"say \\"no\\" to \\\\ it"',
             "''", "'a\"b'", '"a\'b"', "a\\ b", " x ", '"\\x"', "a '' b"]
    df = spark.createDataFrame([(t,) for t in texts], "c string")
    assert [list(r["a"]) for r in df.select(C.split_args("c").alias("a")).collect()] == [shlex.split(t) for t in texts]
    odd = spark.createDataFrame([("",), (None,), ("a 'b",)], "c string").select(C.split_args("c").alias("a"), C.parse_command("c")["verb"].alias("v"))
    assert [(r["a"], r["v"]) for r in odd.collect()] == [([], None), (None, None), (["a", "'b"], "a")]


def test_command_parse(spark):
    df = spark.createDataFrame([("run --select m1",), ("run --select=",), ("run --select=m2",), ("build",),
                                ("run --select",)], "c string")
    r = df.select(C.parse_command("c").alias("p"), C.parse_command("c", strict=True).alias("s")).collect()
    assert [x["p"]["selection"] for x in r] == ["m1", "", "*", "*", None]
    assert [x["s"]["selection"] for x in r] == ["m1", "", "m2", "*", None]
    assert [x["p"]["verb"] for x in r] == ["run", "run", "run", "build", "run"]
    f = df.select(F.array_join(C.with_flag(C.split_args("c"), "--schedule", "1 * * * *"), " ")).first()[0]
    assert f == "run --select m1 --schedule 1 * * * *"


def test_names(spark):
    df = spark.createDataFrame([("ab-cd", None)], "id string, n string")
    r = df.select(C.job_id("id"), C.schedule_name("n", "id"), C.folder_name(F.lit("2024-03-04"), F.col("id"))).first()
    assert tuple(r) == ("uabcd", "schedule-ab-cd", "2024-03-04-ab-cd")


def test_settings_functions(spark):
    df = spark.createDataFrame([({"a": "1", "b": None, "secret": "x", "log_level": "info"},)], "m map<string,string>")
    r = df.select(FS.overlay(FS.clean_overrides("m", ["secret"]), FS.forced_options()).alias("o")).first()["o"]
    assert r == {"a": "1", "log_level": "debug", "log_format": "json", "debug": "true"}
    p = spark.createDataFrame([("manifest", "target/m.json"), ("manifest", "/abs"), ("other", "x"), ("seeds_path", None)],
                              "k string, v string")
    got = [r[0] for r in p.select(FS.prefix_path("k", "v", F.lit("proj"))).collect()]
    assert got == ["proj/target/m.json", "/abs", "x", None]


def test_cron_step_forms(spark):
    df = spark.createDataFrame([("5/20 1-5/2 */10 2-3 1-5",)], "s string")
    r = cron.parse_cron(df, "s").first()
    assert r["minute"] == [5, 25, 45] and r["hour"] == [1, 3, 5]
    assert r["day"] == [1, 11, 21, 31] and r["month"] == [2, 3] and r["weekday"] == [1, 2, 3, 4, 5]
    assert r["day_star"] and not r["weekday_star"]  # a field starting with * counts as unrestricted


def test_snapshot_step_closes_changed_and_vanished_keys(spark):
    from runlake.operators.history import snapshot
    hist = spark.createDataFrame([(1, "a", "2024-01-01 00:00:00", None), (2, "b", "2024-01-01 00:00:00", None),
                                  (3, "c", "2023-01-01 00:00:00", "2023-06-01 00:00:00")],
                                 "k int, v string, f string, t string") \
        .select("k", "v", F.to_timestamp("f").alias("valid_from"), F.to_timestamp("t").alias("valid_to"))
    cur = spark.createDataFrame([(1, "a"), (2, "B"), (4, "d")], "k int, v string")
    out = {(r["k"], r["v"], r["valid_to"] is None) for r in snapshot(cur, hist, "k", ["v"], "2024-02-01 00:00:00").collect()}
    assert out == {(1, "a", True), (2, "b", False), (2, "B", True), (3, "c", False), (4, "d", True)}

"""Catalog tables, builds that observe, cycles, selectors, mergeable profiles."""

import pytest
from pyspark.sql import functions as F

from runlake.operators import checks as K
from runlake.operators import lineage as G
from runlake.operators.runs import get_run
from runlake.plans import models as M
from runlake.session import scratch_path
from runlake.sources import tables as T


@pytest.fixture
def buckets_shown(spark):
    """Files are pruned by bucket either way; the plan names the buckets only of a bucketed scan."""
    spark.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    yield
    spark.conf.unset("spark.sql.sources.bucketing.autoBucketedScan.enabled")


def test_clustered_table_survives_the_session_and_prunes(spark, buckets_shown):
    df = spark.range(1000).select(F.col("id").alias("run_id"), (F.col("id") * 2).alias("v"))
    T.save_table(df, "t_clustered", scratch_path(spark, "tables"), "run_id", buckets=8)
    other = spark.newSession()
    other.conf.set("spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")
    one = get_run(other.table("t_clustered"), 7)
    assert [tuple(r) for r in one.collect()] == [(7, 14)]
    assert "SelectedBucketsCount: 1 out of 8" in one._jdf.queryExecution().executedPlan().toString()
    old = spark.table("t_clustered")
    old_rows = old.filter("run_id < 3")
    version = T.write_version(df.limit(5), "t_clustered", scratch_path(spark, "tables"), "run_id", buckets=8)
    assert spark.table("t_clustered").count() == 1000  # written, not published
    T.publish(spark, "t_clustered", version)
    assert spark.table("t_clustered").count() == 5 and old_rows.count() == 3
    T.drop_old_versions(spark, "t_clustered", version)
    assert T.versions(spark, "t_clustered") == [version.lower()] and spark.table("t_clustered").count() == 5


def test_files_can_be_attached_again(spark, buckets_shown):
    root = scratch_path(spark, "tables")
    v = T.write_version(spark.range(50).withColumnRenamed("id", "run_id"), "t_attach", root, "run_id", buckets=4)
    path = spark.sql(f"DESCRIBE FORMATTED {v}").filter("col_name = 'Location'").first()["data_type"]
    spark.sql(f"DROP TABLE {v}")
    df = T.attach(spark, "t_attach", path, "run_id bigint", ["run_id"], 4)
    assert df.count() == 50 and "SelectedBucketsCount: 1 out of 4" in get_run(df, 3)._jdf.queryExecution().executedPlan().toString()


def test_build_observes_and_goes_on_after_errors(spark, monkeypatch):
    spark.range(10).select(F.when(F.col("id") > 2, F.col("id")).alias("id")).createOrReplaceTempView("b_src")
    project = M.Project("p", [
        M.Model("b_one", "SELECT * FROM b_src", "table", cluster_by=("id",)),
        M.Model("b_odd", "SELECT 1 AS x", "snapshot"),
        M.Model("b_lost", "SELECT * FROM nowhere_at_all", "table", ("never_heard_of",)),
        M.Model("b_child", "SELECT * FROM b_one", "table", ("b_one",)),
        M.Model("b_after", "SELECT * FROM b_lost", "view", ("b_lost",)),
    ], checks=[M.Check("b_one", "id", "not_null"), M.Check("b_one", "id", "unique")])
    scans = []
    monkeypatch.setattr(K, "run_checks", lambda models, checks, f=K.run_checks: scans.append(checks) or f(models, checks))
    got = {r["node_id"]: r for r in M.build(spark, project, scratch_path(spark, "build")).collect()}
    assert got["model.b_one"]["rows"] == 10 and got["test.not_null_b_one_id"]["status"] == "FAIL 3"
    assert scans == [[("b_one", "id", "unique")]]  # the null check was observed while the table was written
    assert got["model.b_child"]["status"] == "SKIP" and got["model.b_after"]["status"] == "SKIP"
    assert got["model.b_odd"]["status"] == "ERROR" and got["model.b_lost"]["status"] == "ERROR"


def _graph(spark, edges, n):
    nodes = spark.createDataFrame([(f"n{i:03d}", f"n{i:03d}") for i in range(n)], "node_id string, name string")
    return nodes, spark.createDataFrame([(f"n{a:03d}", f"n{b:03d}") for a, b in edges], "parent_id string, child_id string")


def test_a_small_cycle_is_named_at_once(spark, monkeypatch):
    edges = [(0, i) for i in range(1, 400)] + [(5, 6), (6, 7), (7, 5), (7, 8)]
    nodes, e = _graph(spark, edges, 400)
    rounds = []
    monkeypatch.setattr(G, "_ckpt", lambda df, f=G._ckpt: rounds.append(1) or f(df))
    with pytest.raises(G.CycleError) as err:
        G.dag_levels(nodes, e)
    assert err.value.nodes == ["n005", "n006", "n007"] and len(rounds) < 15
    levels = {r["node_id"]: r["level"] for r in G.dag_levels(nodes, e, on_cycle="null").collect()}
    assert [levels[f"n{i:03d}"] for i in (0, 1, 5, 6, 7, 8)] == [0, 1, None, None, None, None]


def test_levels_are_longest_paths(spark):
    edges = [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (1, 4), (9, 4), (0, 1), (8, 99)]
    nodes, e = _graph(spark, edges, 10)
    levels = {int(r["node_id"][1:]): r["level"] for r in G.dag_levels(nodes, e).collect()}
    assert levels == {0: 0, 1: 1, 2: 2, 3: 3, 4: 4, 5: 0, 6: 0, 7: 0, 8: 0, 9: 0}
    assert G.dag_levels(nodes.limit(0), e).count() == 0


@pytest.mark.parametrize("text,want", [
    ("n003", {3}), ("+n003", {0, 1, 2, 3}), ("n001+", {1, 2, 3, 4}), ("1+n003", {0, 2, 3}), ("n001+1 n000", {0, 1, 2, 4}),
    ("+n002+", {0, 1, 2, 3, 4}), ("n00* 2+n003+1", {0, 1, 2, 3, 4}), ("nothing+", set()), ("", set()),
    ("1+n004 2+n004", {0, 1, 2, 3, 4})])
def test_selectors(spark, text, want):
    nodes, e = _graph(spark, [(0, 1), (1, 2), (2, 3), (0, 3), (3, 4), (1, 4)], 5)
    assert {int(r["node_id"][1:]) for r in G.select_with_graph(nodes, e, text).collect()} == want


def test_selectors_end_on_cycles_and_reject_nonsense(spark):
    nodes, e = _graph(spark, [(0, 1), (1, 2), (2, 0)], 4)
    assert G.select_with_graph(nodes, e, "+n001+").count() == 3
    with pytest.raises(ValueError):
        G.parse_selectors("a+b")


def test_profiles_merge(spark):
    df = spark.range(30_000).select((F.col("id") % 7).alias("day"), "id", (F.col("id") % 100).cast("string").alias("t"),
                                    F.when(F.col("id") % 3 > 0, F.rand(1)).alias("x"))
    sketches = K.profile_sketches(df, ["day"])
    assert sketches.count() == 21
    got = {r["column"]: r for r in K.merge_profiles(sketches).collect()}
    assert abs(got["id"]["n_distinct"] - 30_000) < 4 * K.DISTINCT_ERROR * 30_000 and abs(got["t"]["n_distinct"] - 100) <= 7
    assert got["x"]["n_nulls"] == 10_000 and got["id"]["max_num"] == 29_999 and got["t"]["min_str"] == "0" and got["id"]["n_rows"] == 30_000


def test_closure_of_graphs_with_cycles(spark):
    """Shortest distances by breadth-first search; self-loops, repeated edges, null ends,
    start nodes on cycles and start nodes that no edge names."""
    import random
    from runlake.operators.lineage import closure
    for seed in range(3):
        r = random.Random(seed)
        pairs = [(f"n{r.randrange(40)}", f"n{r.randrange(40)}") for _ in range(55)]
        pairs += [("n1", "n1"), pairs[0], (None, "n2"), ("n3", None), (None, None)]
        start = [f"n{r.randrange(40)}" for _ in range(3)] + ["elsewhere", None]
        edges = spark.createDataFrame(pairs, "parent_id string, child_id string")
        for way in ("down", "up"):
            follow = [(a, b) if way == "down" else (b, a) for a, b in pairs if a and b]
            depth, todo = dict.fromkeys(start, 0), list(start)
            for node in todo:
                for a, b in follow:
                    if a == node and b not in depth:
                        depth[b] = depth[node] + 1
                        todo.append(b)
            found = closure(edges, spark.createDataFrame([(n,) for n in start], "node_id string"), way).collect()
            assert sorted((x["node_id"], x["depth"]) for x in found) == sorted((n, d) for n, d in depth.items() if d)


def test_rounds_of_a_walk_broadcast_nothing_and_move_no_edges(spark):
    """What a round sends to the driver does not grow with the frontier; the edges stay dealt by
    the end they are followed from."""
    nodes, e = _graph(spark, [(0, i) for i in range(1, 50)] + [(i, 50) for i in range(1, 50)], 51)
    edges = G._followed(G._ckpt(e), "parent_id", "child_id")
    now = G._ckpt(G._round(nodes.filter("node_id = 'n000'").select("node_id"), edges, None))
    assert {(r["node_id"], r["left"], r["fresh"]) for r in now.collect()} == {(f"n{i:03d}", 0, True) for i in range(1, 50)}
    plan = G._round(now.select("node_id"), edges, now.select("node_id", "left"))._jdf.queryExecution().executedPlan().toString()
    above = plan.split("InMemoryRelation")[0]
    assert "Broadcast" not in plan and above.count("Exchange hashpartitioning(__src") == 1
    edges.unpersist()


def test_exact_profiles_group_by_one_column_at_a_time(spark):
    df = spark.createDataFrame([(1, "a", 0.0), (1, "b", -0.0), (None, "b", float("nan")), (2, None, float("nan"))], "i int, t string, x double")
    p = K.profile(df, approx=False)
    assert "Expand" not in p._jdf.queryExecution().executedPlan().toString()  # a row a column, each with all values
    assert {(r["column"], r["n_rows"], r["n_nulls"], r["n_distinct"]) for r in p.collect()} == {("i", 4, 1, 2), ("t", 4, 1, 2), ("x", 4, 0, 2)}

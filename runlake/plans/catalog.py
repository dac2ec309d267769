"""Registered queries: each is ``(spark, sf_dir) -> DataFrame`` over whole
driver tables, with a same-named SQL oracle in ``runlake.plans.oracles``.
Timestamps are returned as TIMESTAMP_NTZ (UTC wall clock) so both sides agree.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.functions import logs as LF
from runlake.functions.logs import to_local
from runlake.operators import logs as L
from runlake.plans import bindings as B
from runlake.sources import schedules as SD

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def register(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def _ntz(c: str):
    return F.col(c).cast("timestamp_ntz").alias(c)


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.parse_lines(B.log_lines(spark, sf_dir))


# ---------------------------------------------------------------- logs
@register
def parse_logs(spark, sf_dir):
    e = _entries(spark, sf_dir)
    return e.select("run_id", "line_no", _ntz("ts"), "severity", "emitter", "message",
                    to_local(F.col("ts"), "Europe/Paris").cast("timestamp_ntz").alias("local_ts"))


@register
def flatten_newlines(spark, sf_dir):
    """F3/F4 over whole document texts: JSON-format events (English documents
    here) keep their text, text-format events get the runner prefix; both have
    every newline flattened to two spaces."""
    d = B.table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    fmt = F.when(F.col("lang") == "en", "json").otherwise("text")
    msg = LF.prefix_message(F.col("text"), fmt)
    return d.select("doc_id", fmt.alias("log_format"), msg.alias("message"),
                    F.length(msg).cast("bigint").alias("n_chars"))


@register
def json_fields(spark, sf_dir):
    """fields of JSON text. Each event's props (``{"k": n}``) gives k, and
    the event written as a JSON log event (level, msg) is read back, those with an
    even id from the nested form (info.level, info.msg beside data)."""
    ev = B.table(spark, sf_dir, "events")
    k = F.from_json("props", "k bigint")["k"]
    level = F.lower(B.severity_of(F.col("event_type"), F.col("value")))
    msg = F.concat_ws(" ", "event_type", "props")
    nested = F.to_json(F.struct(F.struct("value", "user_id").alias("data"), F.struct(level.alias("level"), msg.alias("msg")).alias("info")))
    j = LF.json_event(F.when(F.col("event_id") % 2 == 0, nested).otherwise(LF.to_json_event(level, msg)))
    return ev.select("event_id", k.alias("k"), j["level"].alias("level"), j["msg"].alias("msg"))


@register
def severity_rank(spark, sf_dir):
    known, _ = L.with_severity_rank(_entries(spark, sf_dir))
    return known.select("run_id", "line_no", "severity", "severity_rank")


@register
def unknown_severity(spark, sf_dir):
    return L.unknown_severities(_entries(spark, sf_dir))


@register
def level_filter(spark, sf_dir):
    visible, _ = L.split_by_level(_entries(spark, sf_dir), B.run_levels(spark, sf_dir))
    return visible.select("run_id", "line_no", "severity", "event_rank", "min_rank")


@register
def hidden_lines(spark, sf_dir):
    """P5, the other half: lines below their run's level, or whose severity has no rank."""
    _, hidden = L.split_by_level(_entries(spark, sf_dir), B.run_levels(spark, sf_dir))
    return hidden.select("run_id", "line_no", "severity")


@register
def override_levels(spark, sf_dir):
    """Each run's overrides are part of its state record, and its log level comes
    from there."""
    from runlake.operators.runs import compact
    from runlake.sources import state as SST
    runs = B.run_levels(spark, sf_dir).select(
        "run_id", F.lit("2024-01-01").cast("timestamp_ntz").alias("ts"), F.lit("build").alias("user_command"),
        F.map_filter(F.create_map(F.lit("log_level"), F.col("log_level"), F.lit("target"), F.lit("dev")), lambda _, v: v.isNotNull()).alias("overrides"))
    state = SST.run_overrides(compact(SST.new_run_events(runs), ("run_status", SST.OVERRIDES)))
    visible, _ = L.split_by_level(_entries(spark, sf_dir), state.select("run_id", "log_level"))
    return visible.groupBy("run_id", "min_rank").agg(F.count(F.lit(1)).alias("n_lines"))


@register
def byte_offsets(spark, sf_dir):
    return L.with_byte_offsets(B.log_lines(spark, sf_dir)).select("run_id", "line_no", "n_bytes", "start_byte")


@register
def hot_run_offsets(spark, sf_dir):
    """W1 when one run holds two fifths of all lines: numbering and byte
    offsets stay exact while the hot run is cut into hourly chunks."""
    lines = B.log_events(spark, sf_dir, hot=True).select("run_id", "line_no", "raw")
    return L.with_byte_offsets(lines, lines_per_chunk=1024).select("run_id", "line_no", "n_bytes", "start_byte")


def _cursors(lines: DataFrame) -> DataFrame:
    """Byte 100 * run_id of each run; every fifth run has been read to its end."""
    size = F.sum(F.octet_length("raw").cast("bigint") + 1) - 1
    return lines.groupBy("run_id").agg(size.alias("size")).select(
        "run_id", F.when(F.col("run_id") % 5 == 0, F.col("size")).otherwise(F.col("run_id") * 100).alias("cursor"))


@register
def read_since(spark, sf_dir):
    lines = B.log_lines(spark, sf_dir)
    pieces, _ = L.read_since(lines, _cursors(lines))
    return pieces


@register
def read_since_cursor(spark, sf_dir):
    lines = B.log_lines(spark, sf_dir)
    _, new = L.read_since(lines, _cursors(lines))
    return new.select("run_id", "cursor", "size", "new_cursor")


@register
def ordered_log(spark, sf_dir):
    from runlake.operators.runs import compact
    state = compact(B.run_events(spark, sf_dir))
    return L.ordered_log(B.log_lines(spark, sf_dir), state.select("run_id", "run_status"))


@register
def run_summary(spark, sf_dir):
    s = L.run_summary(_entries(spark, sf_dir),
                      finish=F.col("message").startswith("[dbt] purchase"),
                      success=F.col("message").startswith("[job] signup"))
    return s.select("run_id", "n_lines", "n_errors", _ntz("first_ts"), _ntz("last_ts"), _ntz("finish_ts"),
                    "succeeded", "finished", "duration_s")


@register
def log_counts_rollup(spark, sf_dir):
    c = L.log_counts(_entries(spark, sf_dir), as_of="2024-01-30", days=30)
    return c.select(_ntz("day"), "severity", "emitter", "n_lines", "gid")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """parse -> severity lookup -> per-run summary with the error rank peak."""
    known, _ = L.with_severity_rank(_entries(spark, sf_dir))
    s = L.run_summary(known, finish=F.col("message").startswith("[dbt] purchase"),
                      success=F.col("message").startswith("[job] signup"))
    peak = known.groupBy("run_id").agg(F.max("severity_rank").alias("max_severity_rank"))
    return s.join(peak, "run_id").select(
        "run_id", "n_lines", "n_errors", "max_severity_rank", _ntz("first_ts"), _ntz("finish_ts"),
        "finished", "succeeded", "duration_s")


# ---------------------------------------------------------------- runs
from runlake.functions import commands as C  # noqa: E402
from runlake.operators import runs as R  # noqa: E402
from runlake.operators import schedules as S  # noqa: E402

B_STATE_FIELDS = ("run_status", "user_command", "log_starting_byte")


@register
def status_compaction(spark, sf_dir):
    return R.compact(B.run_events(spark, sf_dir), B_STATE_FIELDS)


@register
def status_transitions(spark, sf_dir):
    # nullable integers leave as double so both engines hand back the same column type
    t = R.status_transitions(B.status_events(spark, sf_dir))
    return t.withColumn("secs_in_status", F.col("secs_in_status").cast("double"))


@register
def status_pivot(spark, sf_dir):
    return R.status_counts(B.status_events(spark, sf_dir)).withColumn("day", F.col("day").cast("timestamp_ntz"))


@register
def live_runs(spark, sf_dir):
    return R.live_runs(R.compact(B.run_events(spark, sf_dir), B_STATE_FIELDS))


@register
def run_lookup(spark, sf_dir):
    """P6 for many ids at once: the state of the runs named by a lookup table
    (here the runs of AUTOMOBILE customers), a semi-join on run_id."""
    state = R.compact(B.run_events(spark, sf_dir), B_STATE_FIELDS)
    ids = B.table(spark, sf_dir, "customer").filter(F.col("c_mktsegment") == "AUTOMOBILE") \
        .select(F.col("c_custkey").alias("run_id"))
    return R.lookup_runs(state, ids)


@register
def version_mismatch(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier").select(
        "s_suppkey", F.col("s_nationkey").alias("nationkey"),
        F.concat(F.lit("1."), F.pmod("s_nationkey", F.lit(4)).cast("string")).alias("client_version"))
    n = B.table(spark, sf_dir, "nation").select(
        F.col("n_nationkey").alias("nationkey"),
        F.concat(F.lit("1."), F.col("n_regionkey").cast("string")).alias("server_version"))
    return R.version_mismatches(s, n, "nationkey")


# ---------------------------------------------------------------- schedules
HORIZON = ("2024-01-01", "2024-01-31")


@register
def schedule_specs(spark, sf_dir):
    """The requested schedules as YAML documents and as JSON lines, read back."""
    d = scratch_path(spark, "specs")
    requested = B.requested(spark, sf_dir)
    SD.write_schedule_specs(requested, f"{d}/specs.yaml")
    requested.write.json(f"{d}/specs.jsonl")
    read = [SD.read_schedule_specs(spark, f"{d}/specs.{kind}").withColumn("kind", F.lit(kind)) for kind in ("yaml", "jsonl")]
    return read[0].unionByName(read[1])


@register
def schedule_diff(spark, sf_dir):
    return S.schedule_diff(B.deployed(spark, sf_dir), B.requested(spark, sf_dir), "always")


@register
def schedule_diff_fields(spark, sf_dir):
    return S.schedule_diff(B.deployed(spark, sf_dir), B.requested(spark, sf_dir), "fields")


@register
def plan_order(spark, sf_dir):
    """The printed plan with its line position (adds, deletes, redeploys)."""
    plan = S.schedule_diff(B.deployed(spark, sf_dir), B.requested(spark, sf_dir), "fields")
    return S.plan_positions(plan).select("position", "action", "name")


@register
def apply_plan(spark, sf_dir):
    dep, req = B.deployed(spark, sf_dir), B.requested(spark, sf_dir)
    plan = S.schedule_diff(dep, req, "fields")
    return S.apply_plan(dep, req, plan, target="prod").select("name", "command", "schedule")


@register
def describe_schedules(spark, sf_dir):
    d = S.describe_schedules(B.deployed(spark, sf_dir), B.requested(spark, sf_dir).select("name"))
    return d.select("name", "found", "command", "schedule", "message")


@register
def delete_outcomes(spark, sf_dir):
    _, out = S.delete_schedules(B.deployed(spark, sf_dir), B.requested(spark, sf_dir).select("name"),
                                where="runlake/europe-west1")
    return out


@register
def active_schedules(spark, sf_dir):
    d = S.list_schedules(B.scheduler_jobs(spark, sf_dir))
    return d.select("name", "command", "schedule", "timezone", "target",
                    C.folder_name(F.lit("2024-01-01"), F.col("name")).alias("folder"),
                    C.job_id(F.col("name")).alias("job_id"),
                    C.schedule_name(F.lit(None).cast("string"), F.col("name")).alias("default_name"))


@register
def expand_cron(spark, sf_dir):
    return S.expand_schedules(B.deployed(spark, sf_dir), *HORIZON).select("name", "schedule", "fire_ts")


# Fixed derivation: schedule texts in every accepted form, and some that are none, by part key.
CRON_FORMS = ("0 9 * * MON-FRI", "30 6 1 JAN,JUL *", "0 22-2 * * *", "@daily", "*/0 * * * *", "0 9 * *", "@reboot", "61 0 * * *")


@register
def rejected_schedules(spark, sf_dir):
    """Schedules whose text is no cron text."""
    text = F.element_at(F.array(*[F.lit(t) for t in CRON_FORMS]), (F.pmod("p_partkey", F.lit(8)) + 1).cast("int"))
    p = B.table(spark, sf_dir, "part").select("p_partkey", text.alias("schedule"))
    return S.rejected_schedules(p)


@register
def malformed_lines(spark, sf_dir):
    """lines that are not time, severity and message; event props are none, log lines are."""
    from runlake.functions.logs import malformed
    log = B.log_lines(spark, sf_dir).select("run_id", "raw")
    ev = B.table(spark, sf_dir, "events").select(F.col("user_id").cast("bigint").alias("run_id"), F.col("props").alias("raw"))
    both = log.select(F.col("run_id").cast("bigint").alias("run_id"), "raw").unionByName(ev)
    return both.groupBy(malformed("raw").alias("malformed")).agg(F.count(F.lit(1)).alias("n_lines"))


@register
def materialise_fires(spark, sf_dir):
    dep = B.deployed(spark, sf_dir)
    fires = S.expand_schedules(dep, *HORIZON)
    base = dep.select("name", F.concat(F.lit("base-"), F.col("name")).alias("run_id"),
                      F.lit("scheduled").alias("run_status"), F.col("command").alias("user_command"),
                      C.folder_name(F.lit("2024-01-01"), F.col("name")).alias("cloud_storage_folder"),
                      F.lit(0).cast("bigint").alias("log_starting_byte"))
    return S.materialise_fires(fires, base, "name")


@register
def fire_adherence(spark, sf_dir):
    fires = S.expand_schedules(B.deployed(spark, sf_dir), *HORIZON).select("schedule_key", "fire_ts")
    runs = B.table(spark, sf_dir, "events").select(F.col("user_id").alias("schedule_key"), F.col("ts").alias("run_ts"))
    return S.fire_adherence(fires, runs, "schedule_key").select(
        "schedule_key", "fire_ts", "first_run_ts", F.col("delay_s").cast("double").alias("delay_s"), "status")


@register
def retry_attempts(spark, sf_dir):
    """The expanded fires and the events that started runs, two tables."""
    fires = S.expand_schedules(B.deployed(spark, sf_dir), *HORIZON).select("schedule_key", "fire_ts")
    starts = B.table(spark, sf_dir, "events").select(
        F.col("user_id").alias("schedule_key"), F.col("ts").alias("run_ts"), F.col("event_id").alias("start_id"))
    return S.retry_attempts(fires, starts, "schedule_key")


#: A key of more rows than this is cut into rank ranges in the queries with a hot key.
HOT_RANGE_ROWS = 1000


@register
def hot_adherence(spark, sf_dir):
    """J8 where two fifths of the rows have one key and lie in one hour, and some have no key."""
    found = S.fire_adherence(B.hot_fires(spark, sf_dir), B.hot_starts(spark, sf_dir), "schedule_key", rows=HOT_RANGE_ROWS)
    return found.select("schedule_key", "fire_ts", "first_run_ts", F.col("delay_s").cast("double").alias("delay_s"), "status")


@register
def hot_retries(spark, sf_dir):
    """J9 with the same hot key: many starts within two minutes of every fire."""
    return S.retry_attempts(B.hot_fires(spark, sf_dir), B.hot_starts(spark, sf_dir), "schedule_key", rows=HOT_RANGE_ROWS)


@register
def hot_transitions(spark, sf_dir):
    """W3 with the same hot key."""
    writes = B.hot_writes(spark, sf_dir).drop("priority")
    t = R.status_transitions(writes, rows=HOT_RANGE_ROWS)
    return t.withColumn("secs_in_status", F.col("secs_in_status").cast("double"))


@register
def command_parse(spark, sf_dir):
    r = B.requested(spark, sf_dir)
    p = C.parse_command(F.col("command"))
    strict = C.parse_command(F.col("command"), strict=True)
    args = C.with_flag(C.with_flag(p["args"], C.SCHEDULE_FLAG, F.col("schedule")), C.SCHEDULE_NAME_FLAG, F.col("name"))
    return r.select("name", "command", p["verb"].alias("verb"), p["selection"].alias("selection"),
                    strict["selection"].alias("selection_strict"),
                    F.array_join(args, " ").alias("submitted"))


# ---------------------------------------------------------------- checks
from runlake.operators import checks as K  # noqa: E402


def _customer_with_nulls(spark, sf_dir):
    # The tables hold no nulls; nation 3 is blanked to give not_null something to find.
    c = B.table(spark, sf_dir, "customer")
    return c.withColumn("c_nationkey", F.when(F.col("c_nationkey") != 3, F.col("c_nationkey")))


@register
def check_not_null(spark, sf_dir):
    r = K.check_not_null(_customer_with_nulls(spark, sf_dir), "c_nationkey")
    return r.select(F.lit("customer").alias("model"), F.lit("c_nationkey").alias("column"),
                    F.lit("not_null").alias("check"), "failures", "rows", "status")


@register
def check_unique(spark, sf_dir):
    r = K.check_unique(B.table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])
    return r.select(F.lit("lineitem").alias("model"), F.lit("l_orderkey,l_linenumber").alias("column"),
                    F.lit("unique").alias("check"), "failures", "status")


REPORT_CHECKS = [
    ("customer", "c_nationkey", "not_null"),
    ("customer", "c_name", "not_null"),
    ("customer", "c_custkey", "unique"),
    ("orders", "o_orderkey", "unique"),
    ("orders", "o_custkey", "not_null"),
    ("lineitem", "l_orderkey,l_linenumber", "unique"),
    ("lineitem", "l_shipdate", "not_null"),
]


@register
def check_report(spark, sf_dir):
    models = {"customer": _customer_with_nulls(spark, sf_dir),
              "orders": B.table(spark, sf_dir, "orders"),
              "lineitem": B.table(spark, sf_dir, "lineitem")}
    return K.run_checks(models, REPORT_CHECKS)


@register
def profile_columns(spark, sf_dir):
    return K.profile(_customer_with_nulls(spark, sf_dir), approx=False)


@register
def profile_merged(spark, sf_dir):
    """A9 from stored sketches of each order year: exact but for the distinct counts, which
    lie within four standard errors of the exact ones."""
    o = B.table(spark, sf_dir, "orders").withColumn("year", F.year("o_orderdate"))
    d = scratch_path(spark, "sketches")
    K.profile_sketches(o, ["year"]).write.partitionBy("year").parquet(d)
    merged = K.merge_profiles(spark.read.parquet(d))
    exact = K.profile(o.drop("year"), approx=False).select("column", F.col("n_distinct").alias("exact"))
    near = F.abs(F.col("n_distinct") - F.col("exact")) <= 4 * K.DISTINCT_ERROR * F.col("exact") + 1
    return merged.join(exact, "column").select("column", "n_rows", "n_nulls", "min_num", "max_num", "min_str", "max_str", near.alias("near"))


# ---------------------------------------------------------------- lineage
from runlake.operators import lineage as G  # noqa: E402


@register
def dag_levels(spark, sf_dir):
    return G.dag_levels(B.graph_nodes(spark, sf_dir), B.graph_edges(spark, sf_dir))


def _cyclic(spark, sf_dir):
    """The graph with an edge back from node 40 to its parent 20."""
    return B.graph_edges(spark, sf_dir).unionByName(
        spark.createDataFrame([("n40", "n20")], "parent_id string, child_id string"))


@register
def dag_levels_cyclic(spark, sf_dir):
    """B5 with a cycle: its nodes and what lies behind it have no level."""
    nodes, edges = B.graph_nodes(spark, sf_dir), _cyclic(spark, sf_dir)
    on_cycle = G.cycle_nodes(nodes, edges).withColumn("on_cycle", F.lit(True))
    levels = G.dag_levels(nodes, edges, on_cycle="null").join(on_cycle, "node_id", "left")
    return levels.select("node_id", F.col("level").cast("double").alias("level"), F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


@register
def graph_selectors(spark, sf_dir):
    """Selectors with graph operators, one walk for all of them."""
    nodes = B.graph_nodes(spark, sf_dir).withColumn("name", F.col("node_id"))
    return G.select_with_graph(nodes, B.graph_edges(spark, sf_dir), ["+n77 2+n150", "n5+", "n9+1 n3 no_such+"]).select("node_id")


@register
def manifest_levels(spark, sf_dir):
    """Manifests of the graph's nodes (a document a thousand keys), read back into
    nodes, edges and levels."""
    d = scratch_path(spark, "manifests")
    parents = B.graph_edges(spark, sf_dir).groupBy(F.col("child_id").alias("node_id")).agg(F.collect_list("parent_id").alias("nodes"))
    n = B.graph_nodes(spark, sf_dir).join(parents, "node_id", "left")
    value = F.struct("resource_type", "name", "root_path", F.struct(F.coalesce("nodes", F.array().cast("array<string>")).alias("nodes"))
                     .alias("depends_on"), F.create_map(F.lit("materialized"), F.lit("table")).alias("config"))
    docs = (n.groupBy(F.floor(F.col("p_partkey") / 1000).alias("doc"))
            .agg(F.map_from_entries(F.collect_list(F.struct(F.col("node_id"), value))).alias("nodes")))
    docs.select(F.to_json(F.struct("nodes")).alias("value")).write.text(d)
    nodes = G.read_manifest(spark, d, per_line=True)
    levels = G.dag_levels(nodes, G.edges_from_nodes(nodes))
    return levels.join(nodes, "node_id").select("node_id", "level", "resource_type", "root_path", F.col("config")["materialized"].alias("how"))


@register
def skip_propagation(spark, sf_dir):
    failed = B.graph_nodes(spark, sf_dir).filter(F.col("p_size") == 1).select("node_id")
    return G.skipped(B.graph_edges(spark, sf_dir), failed)


@register
def closure(spark, sf_dir):
    start = B.graph_nodes(spark, sf_dir).filter(F.col("p_size") == 50).select("node_id")
    return G.closure(B.graph_edges(spark, sf_dir), start, "up")


@register
def select_nodes(spark, sf_dir):
    nodes = B.graph_nodes(spark, sf_dir)
    names = (B.table(spark, sf_dir, "part").filter(F.col("p_size") == 25).select(F.col("p_name").alias("name"))
             .unionByName(spark.createDataFrame([("no_such_model",)], "name string")))
    return G.select_nodes(nodes, names).select("node_id", "name", "resource_type")


@register
def list_nodes(spark, sf_dir):
    return G.list_nodes(B.graph_nodes(spark, sf_dir), ["seed", "snapshot"]).select("node_id", "resource_type", "name")


def _node_results(spark, sf_dir):
    # Fixed mapping of return flags to result status: N success, A fail, R error.
    li = B.table(spark, sf_dir, "lineitem")
    status = F.when(F.col("l_returnflag") == "N", "success").when(F.col("l_returnflag") == "A", "fail") \
        .otherwise("error")
    order = F.struct("l_shipdate", "l_orderkey", "l_linenumber", status.alias("s"))
    return li.select(F.concat(F.lit("n"), F.col("l_partkey").cast("string")).alias("node_id"),
                     order.alias("order"), status.alias("status"))


@register
def retry_set(spark, sf_dir):
    return G.retry_set(B.graph_nodes(spark, sf_dir), _node_results(spark, sf_dir)).select(
        "node_id", "name", "resource_type")


@register
def seed_root_path(spark, sf_dir):
    return G.fix_seed_root(B.graph_nodes(spark, sf_dir)).select("node_id", "resource_type", "root_path")


# ---------------------------------------------------------------- settings, files
from runlake.functions import settings as FS  # noqa: E402
from runlake.operators import artifacts as A  # noqa: E402
from runlake.operators import settings as ST  # noqa: E402


@register
def config_layers(spark, sf_dir):
    r = ST.resolve_layers(B.settings(spark, sf_dir))
    return r.select("scope", "key", "value", F.col("priority").cast("double").alias("priority"),
                    FS.model_config(F.col("value"), F.concat(F.lit("default_"), F.lower("key"))).alias("effective"))


@register
def kv_tombstones(spark, sf_dir):
    return ST.kv_current(B.settings(spark, sf_dir))


@register
def map_overlay(spark, sf_dir):
    c = B.table(spark, sf_dir, "customer")
    user = F.create_map(F.lit("log_format"), F.lit("text"), F.lit("log_level"), F.lower("c_mktsegment"),
                        F.lit("target"), F.when(F.col("c_acctbal") > 0, F.lit("prod")),
                        F.lit("profiles_dir"), F.col("c_name"))
    merged = FS.overlay(FS.clean_overrides(user, deny=["profiles_dir"]), FS.forced_options())
    return c.select("c_custkey", F.explode(merged).alias("key", "value"))


def _url_root(url):
    return F.regexp_extract(url, r"^[a-z]+://[^/]+", 0)


@register
def path_prefix(spark, sf_dir):
    p = B.table(spark, sf_dir, "pages").select("page_id", "url")
    root = _url_root(F.col("url"))
    rel = FS.rel_path(F.col("url"), root)
    key = (F.when(F.col("url").startswith("https"), "manifest")
           .when(F.col("url").endswith(".html"), "seeds_path").otherwise("log_path"))
    value = F.when(F.col("url").endswith("#top"), rel).otherwise(F.regexp_replace(rel, "^/+", ""))
    return p.select("page_id", root.alias("root"), rel.alias("rel_path"), FS.base_name(F.col("url")).alias("base_name"),
                    key.alias("key"), FS.prefix_path(key, value, F.lit("/srv/project")).alias("value"))


@register
def artifact_collisions(spark, sf_dir):
    f = B.files(spark, sf_dir)
    files = f.select("path", "length",
                     F.regexp_extract("path", r"^[a-z]+://[^/]+/([^/?#]*)", 1).alias("folder"),
                     F.regexp_replace(FS.base_name(F.col("path")), r"[?#].*$", "").alias("base_name"))
    return A.basename_collisions(files)


@register
def flatten_lists(spark, sf_dir):
    s = B.table(spark, sf_dir, "supplier")
    lists = s.select("s_suppkey", "s_nationkey", F.when(F.col("s_acctbal") >= 0, F.array(
        F.col("s_name"), F.concat(F.col("s_name"), F.lit("-replica")))).alias("services"))
    return A.flatten_lists(lists, "services").withColumn("pos", F.col("pos").cast("bigint"))


# ---------------------------------------------------------------- history, ranking
from runlake.functions.logs import with_node_result  # noqa: E402
from runlake.operators import history as H  # noqa: E402


@register
def snapshot_history(spark, sf_dir):
    o = B.table(spark, sf_dir, "orders")
    return H.snapshot_from_changelog(o, "o_custkey", "o_orderdate", "o_orderkey", ["o_orderstatus", "o_orderpriority"])


@register
def hot_snapshot(spark, sf_dir):
    """W6 with two fifths of the changes under one key within one hour, and a null key."""
    v = H.snapshot_from_changelog(B.hot_writes(spark, sf_dir), "run_id", "ts", "seq", ["run_status", "priority"], rows=HOT_RANGE_ROWS)
    return v


@register
def snapshot_step(spark, sf_dir):
    """W6 as a step: the customers of every second nation have moved to the next one, those
    of nation 7 are gone; open rows of customers without a balance have a null key."""
    c = B.table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") != 1, F.col("c_custkey"))
    start = F.lit("2023-06-01").cast("timestamp_ntz")
    history = c.select(key.alias("k"), "c_nationkey", "c_mktsegment", start.alias("valid_from"),
                       F.when(F.col("c_custkey") % 11 == 0, F.lit("2023-09-01").cast("timestamp_ntz")).alias("valid_to"))
    moved = F.when(F.col("c_nationkey") % 2 == 0, F.col("c_nationkey") + 1).otherwise(F.col("c_nationkey"))
    current = c.filter(F.col("c_nationkey") != 7).select(
        key.alias("k"), F.when(F.col("c_custkey") != 1, moved).otherwise(F.col("c_nationkey")).alias("c_nationkey"), "c_mktsegment")
    return H.snapshot(current, history, "k", ["c_nationkey", "c_mktsegment"], "2024-01-01").withColumn("k", F.col("k").cast("double"))


def result_lines(spark, sf_dir):
    """lineitem rows written as node-result log lines (fixed format):
    '<line> of 7 <OK|PASS|FAIL q> model_<part> ..... [<SUCCESS q|PASS|FAIL q> in <price/100>s]'"""
    li = B.table(spark, sf_dir, "lineitem")
    q = F.floor("l_quantity").cast("bigint").cast("string")
    cents = F.floor("l_extendedprice").cast("bigint")
    elapsed = F.concat((cents / 100).cast("bigint").cast("string"), F.lit("."),
                       F.lpad(F.pmod(cents, F.lit(100)).cast("string"), 2, "0"))
    flag = F.col("l_returnflag")
    status = F.when(flag == "N", "OK").when(flag == "A", "PASS").otherwise(F.concat(F.lit("FAIL "), q))
    result = F.when(flag == "N", F.concat(F.lit("SUCCESS "), q)).when(flag == "A", "PASS") \
        .otherwise(F.concat(F.lit("FAIL "), q))
    line = F.concat(F.col("l_linenumber").cast("string"), F.lit(" of 7 "), status, F.lit(" model_"),
                    F.col("l_partkey").cast("string"), F.lit(" "),
                    F.repeat(F.lit("."), (F.pmod("l_partkey", F.lit(40)) + 3).cast("int")), F.lit(" ["), result,
                    F.lit(" in "), elapsed, F.when(flag == "A", "s").otherwise("s]"))
    line = F.when(flag == "R", line).otherwise(F.concat(F.lit("[dbt] "), line))  # with the emitter, and cut off
    return li.select(F.date_trunc("day", "l_shipdate").alias("day"), line.alias("line"))


@register
def node_results(spark, sf_dir):
    r = with_node_result(result_lines(spark, sf_dir), "line").select("day", "r.*")
    top = H.slowest_nodes(r, "day", 3, tiebreak=("node", "idx", "status", "failures", "result"))
    return top.select("day", "rank", "idx", "total", "status", "failures", "node", "result", "elapsed")


@register
def first_match(spark, sf_dir):
    """Of every customer the first urgent order by date, none for some."""
    o = B.table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").startswith("1")).select(
        F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_orderdate")
    c = B.table(spark, sf_dir, "customer").select("c_custkey")
    return H.first_match(c, o, "c_custkey", ["o_orderdate", "o_orderkey"]).withColumn("o_orderkey", F.col("o_orderkey").cast("double"))


@register
def top_revenue_runs(spark, sf_dir):
    """Global top 10 runs by total order value (a top-k report)."""
    o = B.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("run_id")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("total"), F.count(F.lit(1)).alias("n_orders"))
    return H.top_k(o, [F.col("total").desc(), F.col("run_id")], 10)


# ---------------------------------------------------------------- sources, sinks, models
from runlake.plans import models as M  # noqa: E402
from runlake.session import scratch_path  # noqa: E402
from runlake.sources.files import list_artifacts  # noqa: E402
from runlake.sources import logs as SL  # noqa: E402
from runlake.sources import objects as SO  # noqa: E402
from runlake.sources import seeds as SS  # noqa: E402
from runlake.sources import state as SST  # noqa: E402
from runlake.sources import tables as STB  # noqa: E402


@register
def seed_roundtrip(spark, sf_dir):
    d = scratch_path(spark, "seeds")
    B.table(spark, sf_dir, "nation").write.option("header", "true").csv(f"{d}/nation.csv")
    return SS.load_seeds(spark, d)["nation"]


@register
def log_roundtrip(spark, sf_dir):
    d = scratch_path(spark, "logs")
    ev = B.log_events(spark, sf_dir)
    SL.append_log_lines(ev.select("run_id", "line_no", "raw", F.to_date("ts").alias("run_date")), d)
    return SL.read_log_lines(spark, d).select("run_id", "line_no", "raw")


#: The runs' objects and folders are dealt to so many folders, each listed by a task.
LOG_FOLDERS = 256


@register
def log_text_roundtrip(spark, sf_dir):
    d = scratch_path(spark, "logtext")
    SL.write_log_text(B.log_lines(spark, sf_dir), d, folders=LOG_FOLDERS)
    return SL.read_log_text(spark, d, run_id_from="partition").withColumn("run_id", F.col("run_id").cast("bigint"))


@register
def state_roundtrip(spark, sf_dir):
    d = scratch_path(spark, "run_events")
    SST.append_run_events(B.run_events(spark, sf_dir), d)
    return R.compact(SST.read_run_events(spark, d), B_STATE_FIELDS)


CHAIN = [
    M.Model("recent_orders", """
        WITH open_orders AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus = 'O'),
             done_orders AS (SELECT o_orderkey AS id, o_custkey FROM orders WHERE o_orderstatus = 'F')
        SELECT * FROM open_orders UNION ALL SELECT * FROM done_orders""", materialized="table"),
    M.Model("customer_orders", """
        SELECT c.c_custkey, c.c_mktsegment, r.id FROM recent_orders r
        JOIN customer c ON c.c_custkey = r.o_custkey WHERE c.c_mktsegment = 'BUILDING'""",
            depends_on=("recent_orders",)),
]


@register
def model_chain(spark, sf_dir):
    for t in ("orders", "customer"):
        B.table(spark, sf_dir, t).createOrReplaceTempView(t)
    project = M.Project("chain", CHAIN)
    root = scratch_path(spark, "models")
    for m in CHAIN:
        M.materialise(spark, m.name, spark.sql(m.sql), M.model_config(m, project), root, m.cluster_by)
    return spark.table("customer_orders")


@register
def run_point_lookup(spark, sf_dir):
    """The run state as a catalog table clustered by run, one run looked up in it
    (the scan reads one bucket)."""
    state = R.compact(B.run_events(spark, sf_dir), B_STATE_FIELDS)
    table = STB.save_table(state, "run_state_clustered", scratch_path(spark, "tables"), "run_id")
    return R.get_run(table, 7)


@register
def log_objects_roundtrip(spark, sf_dir):
    """One text object ``<run id>.txt`` per run, written and read."""
    d = scratch_path(spark, "objects")
    SO.write_log_objects(B.log_lines(spark, sf_dir), d)
    return SL.read_log_text(spark, d).withColumn("run_id", F.col("run_id").cast("bigint"))


@register
def null_removal(spark, sf_dir):
    """P4 as a model over a relation with nulls."""
    _customer_with_nulls(spark, sf_dir).createOrReplaceTempView("customer_with_nulls")
    model = M.Model("customer_known", "SELECT c_custkey, c_nationkey FROM customer_with_nulls WHERE c_nationkey IS NOT NULL")
    return M.materialise(spark, model.name, spark.sql(model.sql), "view", "")[0]


@register
def object_listing(spark, sf_dir):
    """Names and sizes of the objects below a folder; nothing is read."""
    d = scratch_path(spark, "listing")
    SO.write_log_objects(B.log_lines(spark, sf_dir), d)
    return list_artifacts(spark, d).select("rel_path", "base_name", "folder", "length")


@register
def seed_listing(spark, sf_dir):
    """The CSV files of a listing, whatever the case of the suffix."""
    suffix = F.element_at(F.array(*[F.lit(x) for x in (".csv", ".CSV", ".csv.gz", ".txt")]), (F.col("c_custkey") % 4 + 1).cast("int"))
    files = B.table(spark, sf_dir, "customer").select(F.concat(F.col("c_name"), suffix).alias("base_name"))
    return A.seed_files(files)


@register
def clone_check(spark, sf_dir):
    return STB.clone_table(spark, B.table(spark, sf_dir, "region"), scratch_path(spark, "clone"), as_path=True)


# ---------------------------------------------------------------- streaming
from runlake.streaming import growing as SG  # noqa: E402
from runlake.streaming import streams as SM  # noqa: E402


@register
def stream_tail(spark, sf_dir):
    d = scratch_path(spark, "tail")
    ev = B.log_events(spark, sf_dir)
    SL.append_log_lines(ev.select("run_id", "line_no", "raw", F.to_date("ts").alias("run_date")), f"{d}/src")
    schema = spark.read.parquet(f"{d}/src").schema
    q = SM.tail(SM.read_stream(spark, f"{d}/src", schema), f"{d}/out", f"{d}/cursor")
    q.awaitTermination()
    return spark.read.parquet(f"{d}/out").select("run_id", "line_no", "raw")


@register
def tail_growing(spark, sf_dir):
    """Objects that grow over three rounds; consumer a polls after each of them,
    consumer b once at the end."""
    d = scratch_path(spark, "growing")
    lines = B.log_lines(spark, sf_dir)
    for upto in (20, 45, None):
        SO.write_log_objects(lines if upto is None else lines.filter(F.col("line_no") <= upto), f"{d}/objects", folders=LOG_FOLDERS)
        SG.poll(spark, f"{d}/objects", f"{d}/a")
    SG.poll(spark, f"{d}/objects", f"{d}/b")
    a, b = (SG.read_tail(spark, f"{d}/{c}").withColumn("consumer", F.lit(c)) for c in "ab")
    return a.unionByName(b).select("consumer", F.col("run_id").cast("bigint").alias("run_id"), "line_no", "raw", "batch")


@register
def stream_status(spark, sf_dir):
    d = scratch_path(spark, "status")
    ev = B.run_events(spark, sf_dir)
    early = ev.filter(F.col("ts") < F.lit("1998-01-01").cast("timestamp_ntz"))
    late = ev.filter(F.col("ts") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    for part in (early, late):  # two arrivals, in time order; the changes of the first become the base
        part.repartitionByRange("run_id", "seq").write.mode("append").parquet(f"{d}/src")  # as many files as the rows ask for
        src = SM.read_stream(spark, f"{d}/src", spark.read.parquet(f"{d}/src").schema)
        q = SM.stream_state(src, f"{d}/state", f"{d}/cursor")
        q.awaitTermination()
        if part is early:
            SM.compact_state(spark, f"{d}/state")
    return SM.state_table(spark, f"{d}/state", B_STATE_FIELDS)


def _arrivals(spark, sf_dir, folder):
    """The events in three arrivals, each a stream's source: a third of the time each, but events
    of even ids come up to half an hour early, so hours are open from one arrival to the next."""
    ev = B.table(spark, sf_dir, "events")
    first, last = ev.agg(F.min("ts"), F.max("ts")).first()
    early = F.col("ts") - F.when(F.col("event_id") % 2 == 0, F.expr("INTERVAL 30 MINUTES")).otherwise(F.expr("INTERVAL 0 MINUTES"))
    cuts = [first + (last - first) * k / 3 for k in (1, 2)] if first else []
    arrival = sum(((early >= F.lit(c)).cast("int") for c in cuts), F.lit(0))
    for k in range(len(cuts) + 1):
        ev.filter(arrival == k).write.mode("append").parquet(folder)
        yield SM.event_time(SM.read_stream(spark, folder, ev.schema))


@register
def stream_windows(spark, sf_dir):
    d = scratch_path(spark, "windows")
    for events in _arrivals(spark, sf_dir, f"{d}/src"):
        SM.stream_counts(events, ["event_type"], "1 hour", None, "1 hour", f"{d}/out", f"{d}/cursor").awaitTermination()
    r = SM.latest_counts(spark, f"{d}/out", ["event_type"])
    return r.select(_ntz("window_start"), _ntz("window_end"), "event_type", "n")


@register
def stream_sessions(spark, sf_dir):
    """All sessions: a heartbeat row after the last event moves the watermark past
    their ends (its own session, of no user, stays open)."""
    d = scratch_path(spark, "sessions")
    ev = B.table(spark, sf_dir, "events")
    ev.write.parquet(f"{d}/src")
    beat = ev.agg((F.max("ts") + F.expr("INTERVAL 1 DAY")).alias("ts"))
    beat = beat.select(*[F.col("ts") if f.name == "ts" else F.lit(None).cast(f.dataType).alias(f.name) for f in ev.schema.fields])
    beat.write.mode("append").parquet(f"{d}/src")
    src = SM.event_time(SM.read_stream(spark, f"{d}/src", ev.schema))
    q = SM.stream_sessions(src, ["user_id"], "30 minutes", "1 hour",
                           f"{d}/out", f"{d}/cursor")
    q.awaitTermination()
    r = spark.read.parquet(f"{d}/out")
    return r.select("user_id", _ntz("session_start"), _ntz("session_end"), "n_lines", _ntz("last_ts"))


@register
def stream_dedup(spark, sf_dir):
    d = scratch_path(spark, "dedup")
    for events in _arrivals(spark, sf_dir, f"{d}/src"):
        fires = events.withColumn("hour", F.date_trunc("hour", "ts"))
        SM.stream_dedup(fires, ["user_id", "event_type", "hour"], "2 hours", f"{d}/out", f"{d}/cursor").awaitTermination()
    return spark.read.parquet(f"{d}/out").select("user_id", "event_type", _ntz("hour"))


@register
def stream_late(spark, sf_dir):
    """The windows, and how many rows came behind the watermark."""
    d = scratch_path(spark, "late")
    ev = B.table(spark, sf_dir, "events")
    cut, read = F.lit("2024-01-15").cast("timestamp_ntz"), 0
    for part in (ev.filter(F.col("ts") >= cut), ev.filter(F.col("ts") < cut)):  # the early half arrives late
        part.repartitionByRange(2, "ts", "event_id").write.mode("append").parquet(f"{d}/src")
        # a batch an arrival, whatever its files and their times: the cursor keeps the watermark
        src = SM.event_time(SM.read_stream(spark, f"{d}/src", ev.schema))
        q = SM.stream_counts(src, ["event_type"], "1 hour", None, "1 hour", f"{d}/out", f"{d}/cursor")
        q.awaitTermination()
        read += SM.input_rows(q)
    r = SM.latest_counts(spark, f"{d}/out", ["event_type"])
    return r.select(_ntz("window_start"), _ntz("window_end"), "event_type", "n",
                    F.lit(SM.late_rows(r, read)).cast("bigint").alias("n_late"))


BUILD_MODELS = CHAIN + [
    M.Model("nation_customers", """
        SELECT c.c_custkey, c.c_nationkey, n.n_name FROM customer c
        JOIN nation_seed n ON c.c_nationkey = n.n_nationkey""", materialized="table",
            depends_on=("nation_seed",)),
    M.Model("building_nations", """
        SELECT DISTINCT o.c_custkey, n.n_name FROM customer_orders o
        JOIN nation_customers n ON o.c_custkey = n.c_custkey""", depends_on=("customer_orders", "nation_customers")),
]
BUILD_CHECKS = [
    M.Check("recent_orders", "id", "unique"),
    M.Check("customer_orders", "id", "not_null"),
    M.Check("customer_orders", "c_custkey", "unique"),
    M.Check("nation_customers", "c_custkey", "unique"),
]


@register
def project_build(spark, sf_dir):
    """Seed + models + checks over the driver tables in dependency
    order; a failing check skips what is built on its model."""
    for t in ("orders", "customer"):
        B.table(spark, sf_dir, t).createOrReplaceTempView(t)
    seeds = scratch_path(spark, "project-seeds")
    B.table(spark, sf_dir, "nation").write.option("header", "true").csv(f"{seeds}/nation_seed.csv")
    project = M.Project("driver", BUILD_MODELS, seeds_dir=seeds, checks=BUILD_CHECKS)
    res = M.build(spark, project, scratch_path(spark, "project"))
    return res.select("idx", "total", "node_id", "resource_type", "status", "failures",
                      F.col("rows").cast("double").alias("rows"), "result")

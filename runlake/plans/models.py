"""SQL models, seeds and checks built in dependency order.

A model is a record (name, SQL text, materialisation, parents); its SQL
names parents directly (``ref`` is just the view name). ``build`` works out
the levels of the project graph with the lineage operators, then runs each
node as Spark jobs: seeds load, models materialise as a catalog table or a
view, checks aggregate. Row counts and null checks of tables are observed while
they are written. Descendants of a failed node are skipped. The driver only
loops over node names.
"""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from runlake.operators import checks as K
from runlake.operators import lineage as G
from runlake.sources.seeds import load_seeds
from runlake.sources.tables import publish, write_version

MATERIALIZATIONS = ("table", "view")


@dataclass(frozen=True)
class Model:
    name: str
    sql: str
    materialized: str | None = None  # None: the project default
    depends_on: tuple[str, ...] = ()
    cluster_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Check:
    model: str
    column: str
    check: str  # not_null | unique

    @property
    def name(self) -> str:
        return f"{self.check}_{self.model}_{self.column.replace(',', '_')}"


@dataclass
class Project:
    name: str
    models: list[Model]
    seeds_dir: str | None = None
    checks: list[Check] = field(default_factory=list)
    default_materialized: str = "view"
    seed_names: list[str] = field(default_factory=list)


def ref(spark: SparkSession, name: str) -> DataFrame:
    """A model or seed by name."""
    return spark.table(name)


def model_config(model: Model, project: Project) -> str:
    """In-model materialisation beats the project default."""
    m = model.materialized or project.default_materialized
    if m not in MATERIALIZATIONS:
        raise ValueError(f"unknown materialization {m!r} for {model.name}")
    return m


def materialise(spark: SparkSession, name: str, df: DataFrame, how: str, root: str,
                cluster_by: tuple[str, ...] = (), not_null: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, int]]:
    """``table``: write a version of the catalog table ``name`` below ``root`` and publish
    it (``sources.tables``); it outlives the session. ``view``: register the plan as a
    view. Returns the relation and what was observed while a table was written: ``rows``,
    and the nulls of each column of ``not_null`` under its name; no second scan."""
    if how == "view":
        df.createOrReplaceTempView(name)
        return df, {}
    seen = Observation()
    counted = df.observe(seen, F.count(F.lit(1)).alias("rows"),
                         *[F.count_if(F.col(c).isNull()).alias(f"null {c}") for c in not_null])
    version = write_version(counted, name, root, cluster_by)
    found = {k.removeprefix("null "): int(v) for k, v in seen.get.items()}
    return publish(spark, name, version), found


def project_graph(spark: SparkSession, project: Project, seed_names: list[str]) -> tuple[DataFrame, DataFrame]:
    """nodes(node_id, resource_type, name) and edges(parent_id, child_id).
    A check depends on its model; a model's children also depend on that
    model's checks, so a failing check skips what is built downstream."""
    nodes = [(f"seed.{s}", "seed", s) for s in seed_names]
    nodes += [(f"model.{m.name}", "model", m.name) for m in project.models]
    nodes += [(f"test.{c.name}", "test", c.name) for c in project.checks]
    kind = {n[2]: n[0] for n in nodes if n[1] != "test"}
    edges = []
    for m in project.models:
        for p in m.depends_on:
            if p in kind:  # the model's own SQL fails on a parent that nobody knows
                edges.append((kind[p], f"model.{m.name}"))
    for c in project.checks:
        if c.model in kind:
            edges.append((kind[c.model], f"test.{c.name}"))
        for m in project.models:
            if c.model in m.depends_on:
                edges.append((f"test.{c.name}", f"model.{m.name}"))
    n = spark.createDataFrame(nodes, "node_id string, resource_type string, name string")
    e = spark.createDataFrame(edges, "parent_id string, child_id string")
    return n, e


RESULTS_SCHEMA = ("idx bigint, total bigint, node_id string, resource_type string, status string, "
                  "failures bigint, rows bigint, result string, elapsed double")


def build(spark: SparkSession, project: Project, root: str, select: list[str] | None = None) -> DataFrame:
    """Build seeds, models and checks in dependency order; returns the result
    table (idx, total, node_id, resource_type, status, failures, rows, result,
    elapsed). A node that cannot be built has the status ERROR and the first line of
    its error as result; its descendants are skipped. ``select``: node names to build
    (None = all)."""
    seeds = load_seeds(spark, project.seeds_dir) if project.seeds_dir else {}
    nodes, edges = project_graph(spark, project, sorted(seeds))
    levels = G.dag_levels(nodes, edges)
    chosen = G.select_nodes(nodes, select)
    plan = (levels.join(chosen, "node_id").orderBy("level", "node_id")
            .select("node_id", "resource_type", "name", "level"))
    # Project metadata: one row per node.
    order = [(r["node_id"], r["resource_type"], r["name"]) for r in plan.collect()]
    models = {m.name: m for m in project.models}
    checks = {c.name: c for c in project.checks}
    parents: dict[str, list[str]] = {}
    for r in edges.collect():
        parents.setdefault(r["child_id"], []).append(r["parent_id"])
    total = len(order)
    blocked: set[str] = set()  # failed nodes and, as the order reaches them, their descendants
    nulls: dict[tuple[str, str], int] = {}  # of (model, column), observed while the model was written
    results = []
    for idx, (node_id, rtype, name) in enumerate(order, start=1):
        t0 = time.time()
        failures, rows, status, result = 0, None, "OK", ""
        required = tuple(c.column for c in project.checks if c.model == name and c.check == "not_null") if rtype != "test" else ()
        try:
            if not blocked.isdisjoint(parents.get(node_id, ())):
                status, result = "SKIP", "SKIP"
                blocked.add(node_id)
            elif rtype == "seed":
                _, seen = materialise(spark, name, seeds[name], "table", root, not_null=required)
                rows = seen["rows"]
                result = f"INSERT {rows}"
            elif rtype == "model":
                m = models[name]
                how = model_config(m, project)
                _, seen = materialise(spark, name, spark.sql(m.sql), how, root, m.cluster_by, required)
                rows = seen.get("rows")
                result = f"SELECT {rows}" if how == "table" else "CREATE VIEW"
            else:
                c = checks[name]
                if (c.model, c.column) in nulls and c.check == "not_null":
                    failures = nulls[c.model, c.column]
                else:
                    failures = int(K.run_checks({c.model: spark.table(c.model)}, [(c.model, c.column, c.check)]).first()["failures"])
                status = "PASS" if failures == 0 else f"FAIL {failures}"
                result = status
            if rtype != "test" and rows is not None:
                nulls.update({(name, c): seen[c] for c in required})
        except (PySparkException, ValueError, KeyError) as e:  # of this node; the others go on
            status, result = "ERROR", f"ERROR {str(e).splitlines()[0]}"
        if failures or status == "ERROR":
            blocked.add(node_id)
        results.append((idx, total, node_id, rtype, status, failures, rows, result,
                        round(time.time() - t0, 2)))
    return spark.createDataFrame(results, RESULTS_SCHEMA)


def result_lines(results: DataFrame) -> DataFrame:
    """The runner's text form of build results, e.g.
    ``3 of 8 FAIL 1 not_null_my_first_dbt_model_id ... [FAIL 1 in 0.30s]``."""
    kind = F.when(F.col("resource_type") == "seed", F.concat(F.lit("loaded seed file "), F.col("node_id"))) \
        .otherwise(F.element_at(F.split("node_id", r"\."), -1))
    return results.select("idx", F.concat(
        F.col("idx").cast("string"), F.lit(" of "), F.col("total").cast("string"), F.lit(" "),
        F.col("status"), F.lit(" "), kind, F.lit(" ... ["), F.col("result"), F.lit(" in "),
        F.format_number("elapsed", 2), F.lit("s]")).alias("line"))

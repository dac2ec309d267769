"""Pipeline-graph operators over ``nodes`` (node_id, resource_type, name,
root_path, ...) and ``edges`` (parent_id, child_id).

Graph walks are frontier loops: each round is one join of the new frontier
with the edges and an aggregation with what waits; its outcome is written to
the session's shared checkpoint folder, which cuts lineage. The edges lie dealt
and sorted by the end they are followed from. The driver only sees whether the
frontier is empty: the rounds broadcast nothing.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlake.session import checkpoint_dir, scratch_path

# Fixed value: seeds run with their files in the working directory.
SEED_ROOT_PATH = "."

MANIFEST_SCHEMA = ("struct<nodes: map<string, struct<resource_type: string, name: string, "
                   "root_path: string, depends_on: struct<nodes: array<string>>, "
                   "config: map<string, string>>>>")


def read_manifest(spark: SparkSession, path: str, per_line: bool = False) -> DataFrame:
    """Manifest JSON file(s) -> nodes(node_id, resource_type, name, root_path,
    depends_on, config). Parsed with a fixed schema (inference would make one
    column per node id); each file is one document, or each line (``per_line``)."""
    doc = spark.read.text(path, wholetext=not per_line).select(F.from_json("value", MANIFEST_SCHEMA).alias("m"))
    n = doc.select(F.explode("m.nodes").alias("node_id", "n"))
    return n.select("node_id", "n.resource_type", "n.name", "n.root_path",
                    F.coalesce(F.col("n.depends_on.nodes"), F.array().cast("array<string>")).alias("depends_on"),
                    "n.config")


def edges_from_nodes(nodes: DataFrame) -> DataFrame:
    """(parent_id, child_id) from each node's ``depends_on`` list."""
    return nodes.select(F.explode("depends_on").alias("parent_id"), F.col("node_id").alias("child_id"))


def fix_seed_root(nodes: DataFrame) -> DataFrame:
    """Seeds get root_path '.', other nodes keep theirs."""
    return nodes.withColumn("root_path", F.when(F.col("resource_type") == "seed", F.lit(SEED_ROOT_PATH))
                            .otherwise(F.col("root_path")))


def select_nodes(nodes: DataFrame, names: DataFrame | Sequence[str] | None) -> DataFrame:
    """No selector = every node; otherwise nodes whose name is selected. An
    unknown name selects nothing (not an error)."""
    if names is None:
        return nodes
    if not isinstance(names, DataFrame):
        names = nodes.sparkSession.createDataFrame([(n,) for n in names], "name string")
    return nodes.join(names.select("name").distinct(), "name", "left_semi")


def list_nodes(nodes: DataFrame, types: Sequence[str]) -> DataFrame:
    return nodes.filter(F.col("resource_type").isin(*types)).orderBy("node_id")


def retry_set(nodes: DataFrame, results: DataFrame) -> DataFrame:
    """Nodes whose last result (by ``order``) is not ``success``, nodes never
    run included. ``results`` has (node_id, order, status)."""
    last = results.groupBy("node_id").agg(F.max_by("status", "order").alias("__last"))
    ok = last.filter(F.col("__last") == "success").select("node_id")
    return nodes.join(ok, "node_id", "left_anti")


def _ckpt(df: DataFrame) -> DataFrame:
    """The rows, written once below the shared folder."""
    path = scratch_path(df.sparkSession, "graph")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Edges in a partition of ``_followed``.
EDGES = 100_000


def _followed(e: DataFrame, src: str, dst: str) -> DataFrame:
    """Written, distinct edges as (__src, node_id, and ``degree``, the edges into node_id), kept
    dealt and sorted by ``__src``, so that a round moves its frontier and no edges."""
    n = 1 + e.count() // EDGES
    e = e.select(F.col(src).alias("__src"), F.col(dst).alias("node_id"))
    degree = e.groupBy("node_id").agg(F.count(F.lit(1)).alias("degree")).hint("merge")
    return e.join(degree, "node_id").repartition(n, "__src").sortWithinPartitions("__src").persist(StorageLevel.MEMORY_AND_DISK)


def _round(frontier: DataFrame, e: DataFrame, waiting: DataFrame | None) -> DataFrame:
    """(node_id, left, fresh): the nodes that wait and those the frontier leads into, with the
    edges into them not followed yet; ``fresh`` where the node did not wait before."""
    # the edges first: of the two, the rows of a key on the right are the ones held
    met = e.join(frontier.select(F.col("node_id").alias("__src")).hint("merge"), "__src") \
        .select("node_id", "degree", F.lit(1).alias("n"), F.lit(None).cast("long").alias("was"))
    if waiting is not None:
        met = met.unionByName(waiting.select("node_id", F.lit(None).cast("long").alias("degree"), F.lit(0).alias("n"), F.col("left").alias("was")))
    return met.groupBy("node_id").agg((F.coalesce(F.max("was"), F.max("degree")) - F.sum("n")).alias("left"),
                                      F.max("was").isNull().alias("fresh"))


def closure(edges: DataFrame, start: DataFrame, direction: str = "down",
            max_rounds: int | None = None) -> DataFrame:
    """Nodes reachable in one or more steps from ``start`` (node_id), with the
    shortest distance ``depth``; start nodes themselves are not returned.
    ``direction='down'`` follows parent -> child, ``'up'`` child -> parent.

    Breadth-first: each round joins the newest frontier with the edges, so every node
    is expanded once, every edge followed once, and cycles end the walk. Of what has been
    seen a round reads and hands on only the nodes that can be met again: those with edges
    into them that were not followed yet. Edges with a null end lead nowhere."""
    spark = edges.sparkSession
    checkpoint_dir(spark)
    src, dst = ("parent_id", "child_id") if direction == "down" else ("child_id", "parent_id")
    e = _followed(_ckpt(edges.select(src, dst).dropna().distinct()), src, dst)
    seeds = _ckpt(start.select("node_id").distinct())
    degree = e.groupBy("node_id").agg(F.max("degree").alias("left"))
    frontier, waiting = seeds, _ckpt(degree.join(seeds.hint("merge"), "node_id").select("node_id", "left"))
    rounds: list[DataFrame] = []
    depth = 0
    while True:
        depth += 1
        if max_rounds is not None and depth > max_rounds:
            raise RuntimeError(f"closure did not finish in {max_rounds} rounds")
        now = _ckpt(_round(frontier, e, waiting))
        frontier, waiting = now.filter("fresh").select("node_id"), now.filter("left > 0").select("node_id", "left")
        if frontier.isEmpty():
            break
        rounds.append(frontier.withColumn("depth", F.lit(depth)))
    e.unpersist()
    return _union(rounds, like=seeds.withColumn("depth", F.lit(0)))


def _union(parts: list[DataFrame], like: DataFrame | None = None) -> DataFrame:
    if not parts:
        return like.limit(0)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def skipped(edges: DataFrame, failed: DataFrame) -> DataFrame:
    """Every descendant of a failed node that did not fail itself is skipped."""
    return closure(edges, failed, "down")


class CycleError(RuntimeError):
    """The graph has a cycle; ``nodes`` are some of those on it."""

    def __init__(self, nodes: list[str]):
        super().__init__(f"the graph has a cycle through {', '.join(map(str, nodes))}")
        self.nodes = nodes


def _peel(ids: DataFrame, e: DataFrame, src: str, dst: str) -> list[DataFrame]:
    """Rounds of nodes whose neighbours over ``src`` are all peeled, the round's number as
    ``level``. Every edge is followed once; what a round hands on is the table of nodes that
    still wait for some of their edges."""
    e = _followed(e, src, dst)
    frontier = _ckpt(ids.join(e.select("node_id").distinct().hint("merge"), "node_id", "left_anti").withColumn("level", F.lit(0)))
    rounds, waiting, level = [], None, 0
    while not frontier.isEmpty():
        rounds.append(frontier)
        level += 1
        now = _ckpt(_round(frontier, e, waiting).drop("fresh"))
        frontier = now.filter(F.col("left") == 0).select("node_id", F.lit(level).alias("level"))
        waiting = now.filter(F.col("left") > 0)
    e.unpersist()
    return rounds


def dag_levels(nodes: DataFrame, edges: DataFrame, on_cycle: str = "raise") -> DataFrame:
    """Level of every node = length of the longest path from a root (a node
    without parents).

    In-degree peeling: a node leaves, with the round's number as its level, when
    all its parents have left; rounds are bounded by the depth. Nodes that never
    leave lie on a cycle or behind one: ``on_cycle='raise'`` raises ``CycleError``
    with nodes on the cycle, ``'null'`` gives them a null level. Edges of nodes
    that are not in ``nodes`` count as those of a node that never leaves, so only
    edges between known nodes are looked at."""
    checkpoint_dir(nodes.sparkSession)
    ids, e = _graph(nodes, edges)
    rounds = _peel(ids, e, "parent_id", "child_id")
    levels = ids.join(_union(rounds, like=ids.withColumn("level", F.lit(0))), "node_id", "left")
    if on_cycle == "raise" and not levels.filter(F.col("level").isNull()).isEmpty():
        raise CycleError([r["node_id"] for r in _on_cycles(ids, e, rounds).orderBy("node_id").limit(10).collect()])
    return levels


def _graph(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct node ids, and the distinct edges between them, written once."""
    ids = _ckpt(nodes.select("node_id").distinct())
    e = edges.select("parent_id", "child_id").distinct()
    for end in ("parent_id", "child_id"):
        e = e.join(ids.select(F.col("node_id").alias(end)), end, "left_semi")
    return ids, _ckpt(e.select("parent_id", "child_id"))


def _on_cycles(ids: DataFrame, e: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """Of the nodes that peeling left over, those that peeling from the other end leaves too."""
    left = ids.join(_union(rounds, like=ids).select("node_id"), "node_id", "left_anti")
    inner = e
    for end in ("parent_id", "child_id"):
        inner = inner.join(left.select(F.col("node_id").alias(end)), end, "left_semi")
    left, inner = _ckpt(left), _ckpt(inner.select("parent_id", "child_id"))
    back = _peel(left, inner, "child_id", "parent_id")
    return left.join(_union(back, like=left).select("node_id"), "node_id", "left_anti")


def cycle_nodes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The nodes (node_id) on a cycle, or between two cycles."""
    checkpoint_dir(nodes.sparkSession)
    ids, e = _graph(nodes, edges)
    return _on_cycles(ids, e, _peel(ids, e, "parent_id", "child_id"))


_SELECTOR = re.compile(r"(?:(\d*)(\+))?([^+\s]+?)(?:(\+)(\d*))?")
#: Stands for no bound on the depth of a walk.
UNBOUNDED = 1 << 30


def parse_selectors(texts: str | Sequence[str]) -> list[tuple[str, int, int]]:
    """(name, steps up, steps down) of selectors: ``name``, ``+name`` (and all it needs),
    ``name+`` (and all that need it), ``2+name``, ``name+1``; a text may hold several."""
    out = []
    for word in " ".join([texts] if isinstance(texts, str) else texts).split():
        m = _SELECTOR.fullmatch(word)
        if m is None:
            raise ValueError(f"not a selector: {word!r}")
        up = int(m[1]) if m[1] else UNBOUNDED if m[2] else 0
        down = int(m[5]) if m[5] else UNBOUNDED if m[4] else 0
        out.append((m[3], up, down))
    return out


def select_with_graph(nodes: DataFrame, edges: DataFrame, selectors: str | Sequence[str]) -> DataFrame:
    """The nodes that any of the selectors names or reaches (``parse_selectors``); ``*`` in a
    name stands for any text.

    One walk serves all selectors and both sides: its state is (node, side, steps left),
    with the most steps any selector leaves at that node, so a node is expanded again only
    when a selector reaches it with more steps to go. What has been seen is one compacted
    table."""
    spark = nodes.sparkSession
    checkpoint_dir(spark)
    wanted = parse_selectors(selectors)
    if not wanted:
        return nodes.limit(0)
    rows = [("^" + ".*".join(map(re.escape, name.split("*"))) + "$", up, down) for name, up, down in wanted]
    table = F.broadcast(spark.createDataFrame(rows, "__pattern string, __up int, __down int"))  # a row per selector given
    hit = nodes.select("node_id", "name").join(table, F.expr("name RLIKE __pattern"))
    seen = hit.select("node_id", F.explode(F.array(F.struct(F.lit("up").alias("side"), F.col("__up").alias("left")),
                                                   F.struct(F.lit("down").alias("side"), F.col("__down").alias("left")))).alias("s"))
    seen = _ckpt(seen.groupBy("node_id", "s.side").agg(F.max("s.left").alias("left")))
    e = edges.select("parent_id", "child_id").distinct()
    e = _ckpt(e.select(F.col("child_id").alias("node_id"), F.lit("up").alias("side"), F.col("parent_id").alias("to"))
              .unionByName(e.select(F.col("parent_id").alias("node_id"), F.lit("down").alias("side"), F.col("child_id").alias("to"))))
    frontier = seen
    while True:
        reached = (frontier.filter(F.col("left") > 0).join(e, ["node_id", "side"])
                   .select(F.col("to").alias("node_id"), "side", (F.when(F.col("left") == UNBOUNDED, UNBOUNDED)
                                                                  .otherwise(F.col("left") - 1)).alias("left"))
                   .groupBy("node_id", "side").agg(F.max("left").alias("left")))
        old = seen.select("node_id", "side", F.col("left").alias("__old"))
        frontier = _ckpt(reached.join(old, ["node_id", "side"], "left")
                         .filter(F.col("__old").isNull() | (F.col("left") > F.col("__old"))).drop("__old"))
        if frontier.isEmpty():
            return nodes.join(seen.select("node_id").distinct(), "node_id", "left_semi")
        seen = _ckpt(seen.unionByName(frontier).groupBy("node_id", "side").agg(F.max("left").alias("left")))

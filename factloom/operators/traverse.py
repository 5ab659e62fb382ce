"""Bounded breadth-first traversal over active relations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import QueryValidationError
from ..memory import Memory
from ..plans.staging import written

MAX_DEPTH, MAX_EDGES = 8, 1000


def all_edges(memory: Memory, relation_types: list[str] | None = None) -> DataFrame:
    """edge_id, source, target (text, with the entity type) of the active relations."""
    out = None
    for r in memory.relations:
        if relation_types is not None and r.type not in relation_types:
            continue
        s, t = F.concat(F.lit(f"{r.source_type}:"), F.col("source").cast("string")), F.concat(F.lit(f"{r.target_type}:"), F.col("target").cast("string"))
        one = r.df.filter("active").select(F.concat_ws("|", F.lit(r.type), F.lit(r.logical_key or ""), s, t).alias("edge_id"), s.alias("source"), t.alias("target"))
        out = one if out is None else out.unionByName(one)
    if out is None:
        raise QueryValidationError("no relation of these types")
    return out


def _steps(edges: DataFrame, direction: str) -> DataFrame:
    """edges with the node each is walked from (here) and to (there)."""
    ways = {"outbound": [("source", "target")], "inbound": [("target", "source")], "both": [("source", "target"), ("target", "source")]}
    if direction not in ways:
        raise QueryValidationError(f"unknown direction {direction}")
    return edges.withColumn("_way", F.explode(F.array(*(F.struct(F.col(a).alias("here"), F.col(b).alias("there")) for a, b in ways[direction])))).select(*edges.columns, "_way.here", "_way.there")


def traverse(memory: Memory, start: str, relation_types: list[str] | None = None, direction: str = "outbound", max_depth: int = 3, limit: int = 100) -> dict:
    """What walk() finds from one node ("type:id"). nodes: id -> depth; edges: id -> (source, target, depth);
    truncated: an edge was cut or lies beyond max_depth. At most `limit` edges come to the driver, at the end."""
    if not 1 <= limit <= MAX_EDGES:
        raise QueryValidationError("bad traversal bounds")
    seeds = memory.spark.createDataFrame([(start,)], "node string")
    taken, cut = walk(all_edges(memory, relation_types), seeds, direction, max_depth, limit)
    edges = {r["edge_id"]: (r["source"], r["target"], r["depth"]) for r in taken.orderBy("depth", "edge_id").collect()}
    nodes = {start: 0}
    for source, target, depth in edges.values():
        nodes.setdefault(source, depth)
        nodes.setdefault(target, depth)
    return {"nodes": nodes, "edges": edges, "truncated": cut}


def walk(edges: DataFrame, starts: DataFrame, direction: str, max_depth: int, limit: int) -> tuple[DataFrame, bool]:
    """Edges (edge_id, source, target, depth) in breadth-first order from starts (node), each once, within a level by
    edge id, `limit` in all; and whether an edge was left out. Each level joins the edges with the written frontier, so plans
    stay of one size and only counts reach the driver. One level more than max_depth is looked at, for what lies beyond."""
    if not 1 <= max_depth <= MAX_DEPTH:
        raise QueryValidationError("bad traversal bounds")
    steps = _steps(edges, direction)
    frontier = seen = starts.select("node").distinct()
    taken, room = None, limit
    for depth in range(1, max_depth + 2):
        level = steps.join(frontier, steps["here"] == frontier["node"], "left_semi")
        if taken is not None:
            level = level.join(taken.select("edge_id"), "edge_id", "left_anti")
        level = level.groupBy("edge_id").agg(F.min("source").alias("source"), F.min("target").alias("target"))
        if depth > max_depth:
            return taken, not level.isEmpty()
        level = written(level.orderBy("edge_id").limit(room + 1).withColumn("depth", F.lit(depth)), "level")
        n = level.count()
        if n > room:
            level = level.orderBy("edge_id").limit(room)
        taken = level if taken is None else taken.union(level)
        if n > room or not n:
            return taken, n > room
        room -= n
        ends = level.select(F.explode(F.array("source", "target")).alias("node")).distinct()
        frontier = written(ends.join(seen, "node", "left_anti"), "frontier")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            return taken, False
    raise AssertionError


def reachable(edges: DataFrame, starts: DataFrame, max_depth: int, direction: str = "outbound") -> DataFrame:
    """node, depth of everything within max_depth of the nodes in starts (column node), for any number of
    starts. edges: source, target. Each level is written before the next, so every edge is read once a level."""
    if not 1 <= max_depth <= MAX_DEPTH:
        raise QueryValidationError("bad traversal bounds")
    steps = _steps(edges.select("source", "target"), direction).select("here", "there")
    seen = starts.select("node", F.lit(0).alias("depth")).distinct()
    frontier = seen
    for depth in range(1, max_depth + 1):
        reached = steps.join(frontier, steps["here"] == frontier["node"], "left_semi").select(F.col("there").alias("node")).distinct()
        frontier = written(reached.join(seen, "node", "left_anti").select("node", F.lit(depth).alias("depth")), "frontier")
        if frontier.isEmpty():
            break
        seen = seen.union(frontier)
    return seen

"""Populations, freshness, metrics, and references of hand-made tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import sha256_json
from ..memory import Memory


def population_hash(document: dict) -> str:
    """Of a query without its presentation: order and page don't matter."""
    return sha256_json({"semantics": "2"} | {k: v for k, v in document.items() if k not in ("limit", "offset", "order_by")})


def freshness(memory: Memory, state: dict) -> str:
    if state["generation"] != memory.generation:
        return "unknown"
    return "current" if state["data_revision"] == memory.revision else "potentially_stale"


def current_metrics(metrics: DataFrame) -> DataFrame:
    """The latest complete, not invalidated caller metric of each (definition_version, dimensions_hash),
    by (recorded_at, run_id, metric_id). A maximum per group: combined map-side, no sort."""
    live = metrics.filter((F.col("origin") == "caller") & F.col("complete") & ~F.col("invalidated"))
    rest = [c for c in metrics.columns if c not in ("recorded_at", "run_id", "metric_id")]
    best = live.groupBy("definition_version", "dimensions_hash").agg(F.max(F.struct("recorded_at", "run_id", "metric_id", F.struct(*rest).alias("r"))).alias("m"))
    return best.select("m.recorded_at", "m.run_id", "m.metric_id", *(F.col(f"m.r.{c}").alias(c) for c in rest))


def explain(facts: DataFrame, sources: DataFrame, fragments: DataFrame, objects: DataFrame) -> DataFrame:
    """Facts with their source and, where there is one, fragment and evidence object. The runtime
    broadcasts the small sides below its threshold."""
    out = facts.join(sources.select(F.col("source_id"), F.col("name").alias("source_name")), "source_id")
    out = out.join(fragments.select("fragment_id", "object_digest", "selector"), "fragment_id", "left")
    return out.join(objects.select(F.col("digest").alias("object_digest"), "size"), "object_digest", "left")


def missing_references(child: DataFrame, column: str, parent: DataFrame, key: str) -> DataFrame:
    """Rows whose reference leads nowhere."""
    return child.filter(F.col(column).isNotNull()).join(parent.select(F.col(key).alias(column)), column, "left_anti")


def nth_latest(df: DataFrame, by: list[str], order: list[str], n: int = 1) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*(F.desc(c) for c in order))
    return df.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= n).drop("_n")

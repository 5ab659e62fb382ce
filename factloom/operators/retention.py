"""Which evidence may go: mark and sweep over what refers to it, releases of holds, and retirement by a confirmed plan.

Tables: acquisitions (acquisition_id, digest, retention_required, retain_until), releases (acquisition_id, released_at, reason), references
(holder, digest: a manifest, fragment or derived object needs another object), roots (digest: what captured observations name), tombstones
(digest, plan_id, reason, retired_at). An object stays while a hold that nobody has released or a date lies on it, while a root, and while it
can be reached by references from one of these. Cycles end, as each object is marked once; a level of references is one semi-join, written
before the next. Null digests refer to nothing, repeated rows count once; an object without an acquisition is not ours to delete.

Plans and tombstones are tables: neither the objects nor their names pass through the driver, except that files are deleted one by one.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import FactloomError, QueryValidationError
from ..functions.values import canonical_json, sha256_json
from ..plans.staging import written
from ..sources import files, store

RELEASES = "acquisition_id string, released_at timestamp, reason string"
TOMBSTONES = "digest string, plan_id string, reason string, retired_at timestamp"


def release(acquisitions: DataFrame, releases: DataFrame, roots: DataFrame, tombstones: DataFrame, digest: str, confirmed: str, reason: str, at: str) -> DataFrame:
    """releases with those of an object's acquisitions that had none; an earlier one keeps its time and reason. Refused without the digest as
    confirmation or a reason, for an object that is unknown or retired, and for one that a captured observation names."""
    if confirmed != digest or not reason.strip():
        raise QueryValidationError("a release needs its digest as confirmation, and a reason")
    of = acquisitions.filter(F.col("digest") == digest)
    if of.isEmpty():
        raise QueryValidationError(f"unknown evidence {digest}")
    for table, why in ((roots, "a captured observation names it"), (tombstones, "it is retired")):
        if not table.filter(F.col("digest") == digest).isEmpty():
            raise FactloomError(f"{digest} can't be released: {why}")
    new = of.select("acquisition_id").distinct().join(releases.select("acquisition_id"), "acquisition_id", "left_anti")
    return releases.unionByName(new.select("acquisition_id", F.lit(at).cast("timestamp").alias("released_at"), F.lit(reason.strip()).alias("reason")))


def holds(acquisitions: DataFrame, releases: DataFrame, as_of: str) -> DataFrame:
    """digest, n_holds of every object: its acquisitions that block at a time, by a hold without a release or by a date."""
    freed = releases.select("acquisition_id").distinct().withColumn("_freed", F.lit(True))
    a = acquisitions.join(freed, "acquisition_id", "left")
    blocking = (F.coalesce("retention_required", F.lit(False)) & F.col("_freed").isNull()) | F.coalesce(F.col("retain_until") > F.lit(as_of).cast("timestamp"), F.lit(False))
    per = a.filter("digest is not null").groupBy("digest", "acquisition_id").agg(F.max(blocking).alias("b"))
    return per.groupBy("digest").agg(F.count_if("b").alias("n_holds"))


def reachable(roots: DataFrame, references: DataFrame) -> DataFrame:
    """digest of the roots and of all that they lead to."""
    edges = written(references.filter("holder is not null and digest is not null").select("holder", "digest").distinct(), "references")
    level = written(roots.filter("digest is not null").select("digest").distinct(), "marked")
    marked = level
    while not level.isEmpty():
        found = edges.join(level.select(F.col("digest").alias("holder")), "holder", "left_semi").select("digest").distinct()
        level = written(found.join(marked, "digest", "left_anti"), "marked")
        marked = marked.union(level)
    return marked


def states(acquisitions: DataFrame, releases: DataFrame, references: DataFrame, roots: DataFrame, tombstones: DataFrame, as_of: str) -> DataFrame:
    """digest, n_holds, state of every acquired object: retired, held, captured (a root), referenced or expired; the first that applies."""
    held = written(holds(acquisitions, releases, as_of), "holds")
    flag = lambda df, name: df.filter("digest is not null").select("digest").distinct().withColumn(name, F.lit(True))
    marks = flag(reachable(roots.select("digest").union(held.filter("n_holds > 0").select("digest")), references), "_reached")
    rows = held.join(flag(tombstones, "_retired"), "digest", "left").join(flag(roots, "_root"), "digest", "left").join(marks, "digest", "left")
    state = (
        F.when(F.col("_retired"), "retired").when(F.col("n_holds") > 0, "held").when(F.col("_root"), "captured").when(F.col("_reached"), "referenced").otherwise("expired")
    )
    return rows.select("digest", "n_holds", state.alias("state"))


def plan(spark: SparkSession, root: str, current: DataFrame, as_of: str, reason: str = "retention-expired") -> str:
    """Writes the expired objects of current (as states gives it) as an immutable plan; returns its name, a hash of what it says."""
    path = f"{root}/plans/{uuid.uuid4().hex}"
    current.filter("state = 'expired'").select("digest").write.parquet(path)
    body = {"as_of": as_of, "reason": reason, "path": path, "objects": store.table_hash(spark.read.schema("digest string").parquet(path))}
    name = sha256_json(body)
    files.write(spark, f"{root}/plans/{name}.json", canonical_json(body).encode())
    return name


def retire(spark: SparkSession, root: str, name: str, confirmed: str, current: DataFrame, tombstones: DataFrame, at: str) -> DataFrame:
    """tombstones with those of a plan's objects, whose files are deleted. current: the states now. Refused as a whole if the plan isn't confirmed
    by its name, was changed, or names an object that isn't expired any more; what the same plan has retired already is passed over."""
    body = files.read_json(spark, f"{root}/plans/{name}.json")
    objects = spark.read.schema("digest string").parquet(body["path"])
    if confirmed != name or sha256_json(body) != name or store.table_hash(objects) != body["objects"]:
        raise FactloomError("the plan isn't confirmed, or was changed")
    mine = tombstones.filter(F.col("plan_id") == name).select("digest")
    todo = written(objects.join(mine, "digest", "left_anti"), "retiring")
    if not todo.join(current.filter("state = 'expired'"), "digest", "left_anti").isEmpty():
        raise FactloomError("an object of the plan isn't expired any more")
    out = tombstones.unionByName(todo.select("digest", F.lit(name).alias("plan_id"), F.lit(body["reason"]).alias("reason"), F.lit(at).cast("timestamp").alias("retired_at")))
    # Tombstones first: a file that is left behind is an orphan, a file that is gone without one would be damage.
    out = written(out, "tombstones")
    for r in objects.toLocalIterator():
        files.delete(spark, f"{root}/objects/sha256/{r['digest'][:2]}/{r['digest']}")
    return out

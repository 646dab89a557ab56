"""Joins over the control catalogue: versions, bindings, routes and their targets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MOST_ATTEMPTS = 10


def active_versions(workers: DataFrame, versions: DataFrame) -> DataFrame:
    """Each worker (namespace, worker, active) with the version (namespace, worker, number, ...) that is active."""
    on = [workers["namespace"] == versions["namespace"], workers["worker"] == versions["worker"], workers["active"] == versions["number"]]
    return workers.join(versions, on).select(versions["*"])


def unpinned_bindings(bindings: DataFrame, resources: DataFrame, pins: DataFrame) -> DataFrame:
    """Bindings with their resource, of those that no pin overrides."""
    return bindings.join(resources, "resource").join(pins.select("worker", "name"), ["worker", "name"], "left_anti")


def backfill(existing: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert or ignore: existing rows, and source rows whose keys aren't there, once each."""
    new = source.dropDuplicates(keys).join(existing.select(*keys), keys, "left_anti")
    return existing.unionByName(new.select(*existing.columns))


def routed(requests: DataFrame, routes: DataFrame) -> DataFrame:
    """Requests (host, ...) with the worker of their host's route; Spark broadcasts the routes if they are few."""
    return requests.join(routes.select("host", "namespace", "worker"), "host", "left")


def targets(versions: DataFrame, kind: str) -> DataFrame:
    """One row for each binding of a kind in a version's JSON list `bindings` ([{"type", "name"}, ...])."""
    parsed = F.from_json("bindings", "ARRAY<STRUCT<type: STRING, name: STRING>>")
    each = versions.select("namespace", "worker", F.explode(parsed).alias("b"))
    return each.where(F.col("b.type") == kind).select("namespace", "worker", F.col("b.name").alias("name"))


def retryable(now_ms: int) -> Column:
    """Jobs that may run: waiting or failed and due, or running with a lapsed lease; not tried too often."""
    waiting = F.col("state").isin("pending", "failed") & (F.col("next_retry_ms") <= now_ms)
    lapsed = (F.col("state") == "running") & (F.col("lease_until_ms") <= now_ms)
    return (waiting | lapsed) & (F.col("attempts") < MOST_ATTEMPTS)


def audit_tail(entries: DataFrame, last: int) -> DataFrame:
    """The newest entries, oldest of them first."""
    return entries.orderBy(F.desc("id")).limit(last).orderBy("id")


def object_counts(objects: DataFrame) -> DataFrame:
    """Objects by namespace and worker, and by those and class (null where all classes count), from one scan."""
    sets = [["namespace", "worker"], ["namespace", "worker", "class"]]
    return objects.groupingSets(sets, "namespace", "worker", "class").agg(F.count("*").alias("n"))

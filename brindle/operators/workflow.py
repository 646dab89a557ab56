"""Workflow instances, steps, events and waits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

ENDED_WELL, ENDED_BADLY = ("complete",), ("errored", "terminated")


def list_page(instances: DataFrame, *, limit: int, offset: int = 0, status: str = "", from_ms: int = 0, to_ms: int = 0) -> DataFrame:
    """Newest first; an empty status and zero times don't filter, both times are inclusive."""
    rows = instances
    if status:
        rows = rows.where(F.col("status") == status)
    if from_ms:
        rows = rows.where(F.col("created_ms") >= from_ms)
    if to_ms:
        rows = rows.where(F.col("created_ms") <= to_ms)
    return rows.orderBy(F.desc("created_ms"), F.desc("id")).offset(offset).limit(limit)


def count_by_status(instances: DataFrame) -> DataFrame:
    """Counts of each status, and of all under `total`, from one grouping."""
    sets = instances.rollup("status").agg(F.count("*").alias("n"), F.grouping("status").alias("all"))
    return sets.select(F.when(F.col("all") == 1, F.lit("total")).otherwise(F.col("status")).alias("status"), "n")


def prune(instances: DataFrame, steps: DataFrame, success_before_ms: int, error_before_ms: int) -> tuple[DataFrame, DataFrame]:
    """Instances without those ended and older than their kind's limit (0 keeps all), and the steps of what stays."""
    gone = F.lit(False)
    if success_before_ms:
        gone = gone | (F.col("status").isin(*ENDED_WELL) & (F.col("updated_ms") < success_before_ms))
    if error_before_ms:
        gone = gone | (F.col("status").isin(*ENDED_BADLY) & (F.col("updated_ms") < error_before_ms))
    kept = instances.where(~gone)
    return kept, steps.join(kept.select(F.col("id").alias("instance_id")), "instance_id", "left_semi")


def claim_runs(instances: DataFrame, now_ms: int, ttl_ms: int, limit: int) -> DataFrame:
    """Runs that may start: queued or running with a lapsed lease, oldest first, while fewer than `limit` are leased."""
    leased = instances.where((F.col("status") == "running") & (F.col("lease_until_ms") > now_ms)).agg(F.count("*").alias("busy"))
    free = instances.where(F.col("status").isin("queued", "running") & (F.col("lease_until_ms") <= now_ms)).orderBy("created_ms", "id").limit(limit)
    place = F.row_number().over(Window.orderBy("created_ms", "id"))  # at most `limit` rows
    claimed = free.withColumn("place", place).join(F.broadcast(leased)).where(F.col("place") <= F.lit(limit) - F.col("busy"))
    return claimed.select("id", F.lit("running").alias("status"), F.lit(now_ms + ttl_ms).cast("long").alias("lease_until_ms"), (F.col("generation") + 1).alias("generation"))


def consume_events(waits: DataFrame, events: DataFrame) -> DataFrame:
    """For each wait (instance_id, name, type): the oldest event of its type that isn't consumed. An event serves one wait."""
    kind = F.get_json_object("payload", "$.type")
    free = events.where("consumed = 0").select("instance_id", F.col("id").alias("event_id"), kind.alias("type"), "payload")
    order = F.row_number().over(Window.partitionBy("instance_id", "type").orderBy("event_id"))
    turn = F.row_number().over(Window.partitionBy("instance_id", "type").orderBy("name"))
    return waits.withColumn("turn", turn).join(free.withColumn("turn", order), ["instance_id", "type", "turn"]).select("instance_id", "name", "event_id", "payload")


def replay(steps: DataFrame, planned: DataFrame) -> DataFrame:
    """Planned steps with the stored result of those that are complete."""
    done = steps.select("instance_id", "name", "result", F.lit(True).alias("done"))
    return planned.join(done, ["instance_id", "name"], "left").withColumn("done", F.coalesce("done", F.lit(False)))


def settle_steps(steps: DataFrame, outcomes: DataFrame, now_ms: int, limit: int = 0) -> DataFrame:
    """Next state of steps (instance_id, name, attempts) after outcomes (instance_id, name, ok, retryable, delay_ms, result).

    A success stores its result and clears the attempts. A failure counts one more and fails the step for good when it can't be retried
    or the attempts exceed `limit`; else it sleeps until now plus its delay. A step without an outcome stays as it is.
    """
    told = outcomes.select("instance_id", "name", "ok", "retryable", "delay_ms", "result")
    joined = steps.select("instance_id", "name", "attempts").join(told, ["instance_id", "name"], "full")
    attempts = F.when(F.col("ok"), F.lit(0)).otherwise(F.coalesce("attempts", F.lit(0)) + F.when(F.col("ok").isNull(), 0).otherwise(1))
    over = ~F.coalesce("retryable", F.lit(True)) | (attempts > limit)
    state = F.when(F.col("ok").isNull(), "waiting").when(F.col("ok"), "complete").when(over, "failed").otherwise("sleeping")
    wake = F.when(state == "sleeping", (F.lit(now_ms) + F.coalesce("delay_ms", F.lit(0))).cast("long"))
    return joined.select("instance_id", "name", attempts.cast("long").alias("attempts"), state.alias("state"), wake.alias("wake_ms"), F.when(F.col("ok"), F.col("result")).alias("result"))


def park(instances: DataFrame, parked: DataFrame) -> DataFrame:
    """Next state after runs (id, generation, wake_ms) go to sleep: queued again, their lease given back, if they still hold it."""
    told = parked.select("id", F.col("generation").alias("__g"), F.col("wake_ms").alias("__wake"))
    own = F.col("__g").isNotNull() & (F.col("__g") == F.col("generation")) & (F.col("status") == "running")
    joined = instances.join(told, "id", "left")
    return joined.select(
        *[c for c in instances.columns if c not in ("status", "lease_until_ms")],
        F.when(own, "queued").otherwise(F.col("status")).alias("status"),
        F.when(own, F.lit(0)).otherwise(F.col("lease_until_ms")).cast("long").alias("lease_until_ms"),
        F.when(own, F.col("__wake")).alias("wake_ms"),
    )


def finish(instances: DataFrame, ended: DataFrame, now_ms: int) -> DataFrame:
    """Next state after runs (id, generation, status) end. A run whose lease went to another generation, or that has ended, changes nothing."""
    told = ended.select("id", F.col("generation").alias("__g"), F.col("status").alias("__s"))
    own = F.col("__g").isNotNull() & (F.col("__g") == F.col("generation")) & (F.col("status") == "running")
    joined = instances.join(told, "id", "left")
    return joined.select(
        *[c for c in instances.columns if c not in ("status", "lease_until_ms", "updated_ms")],
        F.when(own, F.col("__s")).otherwise(F.col("status")).alias("status"),
        F.when(own, F.lit(0)).otherwise(F.col("lease_until_ms")).cast("long").alias("lease_until_ms"),
        F.when(own, F.lit(now_ms)).otherwise(F.col("updated_ms")).cast("long").alias("updated_ms"),
    )

"""Invocation records and the graph of their messages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

FINAL = ("success", "error", "exception", "timeout")


def newest_by_logical_id(invocations: DataFrame) -> DataFrame:
    """The newest record of each logical_id: by started_ms, then id."""
    best = F.max_by(F.struct(*invocations.columns), F.struct("started_ms", "id")).alias("best")
    return invocations.groupBy(F.col("logical_id").alias("__l")).agg(best).select("best.*")


def latest_parents(links: DataFrame, invocations: DataFrame) -> DataFrame:
    """For each child and message (invocation_id, message_id, logical_id): the newest invocation of that logical id."""
    newest = newest_by_logical_id(invocations).select("logical_id", F.col("id").alias("parent_id"), F.col("started_ms").alias("parent_started_ms"))
    return links.join(newest, "logical_id").select("invocation_id", "message_id", "logical_id", "parent_id", "parent_started_ms")


def next_attempt(invocations: DataFrame) -> DataFrame:
    return invocations.groupBy("logical_id").agg((F.coalesce(F.max(F.get_json_object("record", "$.attempt").cast("long")), F.lit(0)) + 1).alias("next_attempt"))


def with_message(invocations: DataFrame, links: DataFrame, message_id: str) -> DataFrame:
    return invocations.join(links.where(F.col("message_id") == message_id).select(F.col("invocation_id").alias("id")), "id", "left_semi")


def keep_newest(rows: DataFrame, most: int, *, key: list[str] | None = None, order: list[str] | None = None) -> DataFrame:
    """The newest rows, of all or of each key."""
    order = order or ["started_ms", "id"]
    newest = [F.desc(c) for c in order]
    if not key:
        return rows.orderBy(*newest).limit(most)
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*newest))).where(F.col("__n") <= most).drop("__n")


def merge_records(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Next state by id: the first final record stays whatever follows; else the latest `seq` counts."""
    rows = stored.unionByName(new)
    final = F.col("status").isin(*FINAL)
    rank = F.struct(final.cast("int"), F.when(final, -F.col("seq")).otherwise(F.col("seq")))
    return rows.groupBy(F.col("id").alias("__i")).agg(F.max_by(F.struct(*rows.columns), rank).alias("best")).select("best.*")

"""At-least-once queues as next-state functions over `messages`.

Columns: id, body, content_type, visible_at_ms, attempts, lease_until_ms, created_ms (and others, kept).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST_CLAIMED, USUAL_CLAIM = 100, 10
USUAL_RETRIES = 3
LEDGER_MS = 24 * 3600 * 1000
MOST_DELAY_S = 86_400


def claimable(now_ms: int) -> Column:
    return (F.col("visible_at_ms") <= now_ms) & (F.col("lease_until_ms") <= now_ms)


def status(messages: DataFrame, now_ms: int) -> DataFrame:
    """depth, visible, leased, oldest_visible_ms (of all messages), max_attempts; zeros for an empty queue."""
    return messages.agg(
        F.count("*").alias("depth"),
        F.count_if(claimable(now_ms)).alias("visible"),
        F.count_if(F.col("lease_until_ms") > now_ms).alias("leased"),
        F.coalesce(F.min("visible_at_ms"), F.lit(0)).alias("oldest_visible_ms"),
        F.coalesce(F.max("attempts"), F.lit(0)).cast("long").alias("max_attempts"),
    )


def peek(messages: DataFrame, after: object | None = None, limit: int = 10) -> DataFrame:
    rows = messages.where(F.col("id") > after) if after is not None else messages
    return rows.orderBy("id").limit(limit + 1)


def batch_ready(messages: DataFrame, now_ms: int, size: int, wait_ms: int) -> DataFrame:
    """One row `ready`: of the first `size` claimable messages one is a retry, or there are that many, or the oldest has waited.

    Without a wait a batch is always ready. Sizes outside 1 to 100 count as 10.
    """
    size = size if 1 <= size <= MOST_CLAIMED else USUAL_CLAIM
    first = messages.where(claimable(now_ms)).orderBy("visible_at_ms", "id").limit(size)
    seen = first.agg(F.count("*").alias("n"), F.max("attempts").alias("tries"), F.min("visible_at_ms").alias("oldest"))
    ready = (F.lit(wait_ms) <= 0) | (F.col("n") >= size) | (F.col("tries") > 0) | (F.lit(now_ms) - F.col("oldest") >= wait_ms)
    return seen.select(F.coalesce(ready, F.lit(False)).alias("ready"))


def claim(messages: DataFrame, now_ms: int, lease_ms: int, limit: int = USUAL_CLAIM) -> DataFrame:
    """The claimed rows, by visibility and id, with their new lease and one more attempt."""
    limit = max(1, min(limit, MOST_CLAIMED))
    taken = messages.where(claimable(now_ms)).orderBy("visible_at_ms", "id").limit(limit)
    return taken.withColumn("lease_until_ms", F.lit(now_ms + lease_ms).cast("long")).withColumn("attempts", F.col("attempts") + 1)


def after_claim(messages: DataFrame, claimed: DataFrame) -> DataFrame:
    return messages.join(claimed.select("id"), "id", "left_anti").select(*messages.columns).unionByName(claimed.select(*messages.columns))


def send(messages: DataFrame, ledger: DataFrame, batch: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Adds a batch (id, body, content_type, delay_s, key, fingerprint): new messages, ledger and conflicts.

    A key in the ledger, not older than a day, makes its message a repetition; with another
    fingerprint it is a conflict. Of equal keys in one batch the first id counts.
    """
    known = ledger.where(F.col("expires_ms") > now_ms)
    first = F.row_number().over(Window.partitionBy(F.coalesce("key", F.concat(F.lit("\x00"), F.col("id").cast("string")))).orderBy("id"))
    fresh = batch.withColumn("__n", first).where("__n = 1").drop("__n")
    seen = fresh.join(known.select("key", F.col("fingerprint").alias("known")), "key", "left")
    conflicts = seen.where(F.col("known").isNotNull() & (F.col("known") != F.col("fingerprint"))).select("id", "key")
    new = seen.where(F.col("known").isNull())
    delay = F.least(F.greatest(F.coalesce("delay_s", F.lit(0)), F.lit(0)), F.lit(MOST_DELAY_S))
    rows = new.select(
        "id", "body", "content_type", (F.lit(now_ms) + delay * 1000).cast("long").alias("visible_at_ms"), F.lit(0).alias("attempts"),
        F.lit(0).cast("long").alias("lease_until_ms"), F.lit(now_ms).cast("long").alias("created_ms"),
    )
    entries = new.where(F.col("key").isNotNull()).select("key", F.col("id").alias("message_id"), "fingerprint", F.lit(now_ms + LEDGER_MS).cast("long").alias("expires_ms"))
    return messages.select(*rows.columns).unionByName(rows), known.select(*entries.columns).unionByName(entries), conflicts


def settle(claimed: DataFrame, outcomes: DataFrame, max_retries: int = USUAL_RETRIES) -> DataFrame:
    """Fate of claimed messages. `outcomes`: id, action (ack, retry), delay_s, seq.

    A retry wins over an ack, and of several retries the last delay counts; without an outcome a
    message is acknowledged. A retried one whose attempts exceed the limit is a dead letter.
    """
    limit = max_retries if max_retries > 0 else USUAL_RETRIES
    told = outcomes.groupBy("id").agg(
        F.max((F.col("action") == "retry")).alias("retried"), F.max_by(F.when(F.col("action") == "retry", F.coalesce("delay_s", F.lit(0))), F.when(F.col("action") == "retry", F.col("seq"))).alias("delay_s")
    )
    fate = F.when(~F.coalesce("retried", F.lit(False)), "ack").when(F.col("attempts") > limit, "dead").otherwise("retry")
    return claimed.join(told, "id", "left").withColumn("fate", fate)


def settle_failed(claimed: DataFrame, delay_s: int = 0, max_retries: int = USUAL_RETRIES) -> DataFrame:
    """Fate of claimed messages whose dispatch failed as a whole: all are retried, tired ones are dead letters."""
    limit = max_retries if max_retries > 0 else USUAL_RETRIES
    return claimed.withColumn("delay_s", F.lit(delay_s)).withColumn("fate", F.when(F.col("attempts") > limit, "dead").otherwise("retry"))


def after_settle(messages: DataFrame, settled: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """The queue without acknowledged and dead messages, retried ones visible after their delay; and the dead letters."""
    back = settled.where("fate = 'retry'").withColumn("visible_at_ms", (F.lit(now_ms) + F.coalesce("delay_s", F.lit(0)) * 1000).cast("long")).withColumn("lease_until_ms", F.lit(0).cast("long"))
    rest = messages.join(settled.select("id"), "id", "left_anti").select(*messages.columns)
    return rest.unionByName(back.select(*messages.columns)), settled.where("fate = 'dead'").select(*messages.columns)

MOST_BODY_BYTES = 128 << 10
# What a body may be.
CONTENT_TYPES = ("json", "text", "bytes", "v8")


def refused(batch: DataFrame) -> DataFrame:
    """Messages (id, body, content_type, delay_s) that may not be sent, with `reason`: too large, of an unknown type, or delayed too long."""
    size = F.octet_length("body") > MOST_BODY_BYTES
    kind = ~F.coalesce(F.col("content_type").isin(*CONTENT_TYPES), F.lit(False))
    delay = ~F.coalesce("delay_s", F.lit(0)).between(0, MOST_DELAY_S)
    reason = F.when(F.col("body").isNull() | size, "size").when(kind, "type").when(delay, "delay")
    return batch.withColumn("reason", reason).where(F.col("reason").isNotNull())


def purge(messages: DataFrame, before_ms: int | None = None) -> DataFrame:
    """Next state without the messages, all or those made before a time; leased ones go too."""
    return messages.limit(0) if before_ms is None else messages.where(F.col("created_ms") >= before_ms)


def remove_source(messages: DataFrame, source: str) -> DataFrame:
    """Next state without the messages that came from a source; messages without one stay."""
    return messages.where(~F.col("source").eqNullSafe(source))

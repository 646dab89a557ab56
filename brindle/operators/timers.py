"""Timers (token, due_ms, kind, scope, occurrence), their retries and fired marks; cron slots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.functions import cron
from brindle.functions.scalars import timer_token

FIRST_RETRY_S, MOST_RETRY_S = 5, 300


def retry_delay_ms(attempt: Column) -> Column:
    """5 s, doubled for each attempt, 300 s at most."""
    return (F.least(F.lit(FIRST_RETRY_S) * F.pow(F.lit(2.0), F.least(attempt, F.lit(30)) - 1), F.lit(float(MOST_RETRY_S))) * 1000).cast("long")


def due(timers: DataFrame, retries: DataFrame, fired: DataFrame, now_ms: int, limit: int | None = None) -> DataFrame:
    """Timers that are due and not fired, a retry's time counting instead of the due time if later."""
    waiting = timers.join(fired.select("token"), "token", "left_anti").join(retries.select("token", "attempt", "retry_after_ms"), "token", "left")
    at = F.greatest("due_ms", F.coalesce("retry_after_ms", F.lit(0)))
    rows = waiting.where(at <= now_ms).select("token", "due_ms", "kind", "scope", "occurrence", F.coalesce("attempt", F.lit(0)).alias("attempt"))
    return rows.orderBy("due_ms", "token").limit(limit) if limit is not None else rows


def next_due(timers: DataFrame, retries: DataFrame, fired: DataFrame) -> DataFrame:
    waiting = timers.join(fired.select("token"), "token", "left_anti").join(retries.select("token", "retry_after_ms"), "token", "left")
    return waiting.agg(F.coalesce(F.min(F.greatest("due_ms", F.coalesce("retry_after_ms", F.lit(0)))), F.lit(0)).alias("next_due_ms"))


def schedule_retries(retries: DataFrame, failed: DataFrame, now_ms: int) -> DataFrame:
    """Next state of retries after the tokens in `failed` failed once more."""
    joined = retries.join(failed.select("token", F.lit(True).alias("again")), "token", "full")
    attempt = F.coalesce("attempt", F.lit(0)) + F.when(F.col("again"), 1).otherwise(0)
    after = F.when(F.col("again"), F.lit(now_ms) + retry_delay_ms(attempt)).otherwise(F.col("retry_after_ms"))
    return joined.select("token", attempt.cast("int").alias("attempt"), after.cast("long").alias("retry_after_ms"))


def prune_fired(fired: DataFrame, now_ms: int) -> DataFrame:
    return fired.where(F.col("expires_ms") > now_ms)


def with_tokens(timers: DataFrame) -> DataFrame:
    return timers.withColumn("token", timer_token(F.col("scope"), F.col("kind"), F.col("due_ms"), F.col("occurrence")))


def cron_slots(minutes: DataFrame, targets: list[tuple[str, str, str]]) -> DataFrame:
    """Slots of schedules among `minutes` (ts): namespace, worker, cron, slot. A slot is made once however often it is asked for."""
    hits = [F.when(cron.parse(expr).column(F.col("ts")), F.struct(F.lit(ns).alias("namespace"), F.lit(worker).alias("worker"), F.lit(expr).alias("cron"))) for ns, worker, expr in targets]
    each = minutes.select(F.col("ts").alias("slot"), F.explode(F.array_compact(F.array(*hits))).alias("t"))  # one scan for all schedules
    return each.select("t.namespace", "t.worker", "t.cron", "slot").distinct()


def fire_counts(fires: DataFrame) -> DataFrame:
    """Number of fires by kind and outcome."""
    return fires.groupBy("kind", "outcome").agg(F.count("*").alias("n"))


def earliest_by_scope(timers: DataFrame) -> DataFrame:
    """The timer of each scope that is due first, ties to the smaller token."""
    return timers.groupBy("scope").agg(F.min(F.struct("due_ms", "token")).alias("first")).select("scope", "first.due_ms", "first.token")


def dispatch(timers: DataFrame, retries: DataFrame, fired: DataFrame, outcomes: DataFrame, now_ms: int, *, keep_ms: int = 24 * 3600 * 1000, most_attempts: int = 0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Next state of (timers, retries, fired) after due timers were tried; `outcomes`: token, ok.

    A timer that went well is marked as fired for `keep_ms` and goes, with its retry. One that failed is tried again later; with
    `most_attempts` the last failure marks it as fired all the same. Outcomes of timers that aren't due count for nothing.
    """
    ready = due(timers, retries, fired, now_ms).join(outcomes.select("token", "ok"), "token")
    tries = F.col("attempt") + 1
    ended = F.col("ok") | (F.lit(most_attempts > 0) & (tries >= most_attempts))
    tried = ready.select("token", tries.cast("int").alias("attempt"), ended.alias("ended"))
    gone, again = tried.where("ended"), tried.where("NOT ended")
    marks = gone.select("token", F.lit(now_ms + keep_ms).cast("long").alias("expires_ms"))
    later = again.select("token", "attempt", (F.lit(now_ms) + retry_delay_ms(F.col("attempt"))).cast("long").alias("retry_after_ms"))
    return (
        timers.join(gone.select("token"), "token", "left_anti"),
        retries.select(*later.columns).join(tried.select("token"), "token", "left_anti").unionByName(later),
        fired.select(*marks.columns).join(gone.select("token"), "token", "left_anti").unionByName(marks),
    )

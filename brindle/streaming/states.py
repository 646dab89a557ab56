"""Stateful operators on Structured Streaming, and the same folds over batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

BUCKET_SCHEMA = "namespace string, event_id long, ts_ms long, admitted boolean"


def refill(tokens: float, last_ms: int, now_ms: int, per_second: float, burst: float) -> float:
    return min(burst, tokens + max(0, now_ms - last_ms) / 1000 * per_second)


def admit(times: list[int], per_second: float, burst: float, tokens: float | None = None, last_ms: int | None = None) -> tuple[list[bool], float, int]:
    """Fold of a token bucket over arrival times in order: verdicts, tokens left and the last time."""
    have = burst if tokens is None else tokens
    last = last_ms if last_ms is not None else (times[0] if times else 0)
    out = []
    for t in times:
        have = refill(have, last, t, per_second, burst)
        last = max(last, t)
        ok = have >= 1
        have -= ok
        out.append(ok)
    return out, have, last


def token_bucket(arrivals: DataFrame, per_second: float, burst: float) -> DataFrame:
    """Batch: arrivals (namespace, event_id, ts_ms) with `admitted`. Each verdict depends on those before it in its namespace."""

    def fold(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["ts_ms", "event_id"])
        group["admitted"] = admit([int(t) for t in group.ts_ms], per_second, burst)[0]
        return group[["namespace", "event_id", "ts_ms", "admitted"]]

    return arrivals.select("namespace", "event_id", "ts_ms").groupBy("namespace").applyInPandas(fold, BUCKET_SCHEMA)


def token_bucket_stream(arrivals: DataFrame, per_second: float, burst: float) -> DataFrame:
    """The same over a stream: the bucket is kept as state between micro-batches."""

    def fold(key: tuple, groups: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (burst, -1)
        for group in groups:
            group = group.sort_values(["ts_ms", "event_id"])
            verdicts, tokens, last = admit([int(t) for t in group.ts_ms], per_second, burst, tokens, None if last < 0 else int(last))
            yield pd.DataFrame({"namespace": key[0], "event_id": group.event_id, "ts_ms": group.ts_ms, "admitted": verdicts})
        state.update((float(tokens), int(last)))

    rows = arrivals.select("namespace", "event_id", "ts_ms")
    return rows.groupBy("namespace").applyInPandasWithState(fold, BUCKET_SCHEMA, "tokens double, last_ms long", "append", GroupStateTimeout.NoTimeout)


def deduplicated(messages: DataFrame, key: str, event_time: str, ttl: str = "24 hours") -> DataFrame:
    """A stream with each key once within the ledger's lifetime; state older than that is dropped."""
    return messages.withWatermark(event_time, ttl).dropDuplicatesWithinWatermark([key])


def minute_counts(events: DataFrame, event_time: str, late: str = "10 minutes") -> DataFrame:
    """Tumbling one-minute counts of a stream by kind; rows later than the watermark are left out."""
    return events.withWatermark(event_time, late).groupBy(F.window(event_time, "1 minute"), "kind").count()


def consume(stream: DataFrame, handler: Callable[[DataFrame], DataFrame], settle: Callable[[DataFrame, DataFrame], None], checkpoint: str) -> Any:
    """A consumer loop: each micro-batch goes to `handler`, which returns outcomes (id, action, delay_s); `settle` stores them.

    Spark gives a batch again after a failure, so delivery is at least once.
    """

    def each(batch: DataFrame, _: int) -> None:
        batch.persist()
        try:
            settle(batch, handler(batch))
        finally:
            batch.unpersist()

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def tumbling_counts(events: DataFrame, by: list[str], at: str, size: str) -> DataFrame:
    """Events of each key in windows of a size: start_at, n. Over a stream, put a watermark on the time first."""
    return events.groupBy(*by, F.window(at, size).alias("__w")).agg(F.count("*").alias("n")).select(*by, F.col("__w.start").alias("start_at"), "n")


def sliding_counts(events: DataFrame, by: list[str], at: str, size: str, step: str) -> DataFrame:
    """The same with a window beginning at every step, so that windows overlap."""
    return events.groupBy(*by, F.window(at, size, step).alias("__w")).agg(F.count("*").alias("n")).select(*by, F.col("__w.start").alias("start_at"), "n")


def session_counts(events: DataFrame, by: list[str], at: str, gap: str) -> DataFrame:
    """Sessions of each key, which end where nothing comes for a gap: first event's time as start_at, n."""
    return events.groupBy(*by, F.session_window(at, gap).alias("__w")).agg(F.count("*").alias("n")).select(*by, F.col("__w.start").alias("start_at"), "n")

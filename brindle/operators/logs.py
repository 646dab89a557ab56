"""Logs, spans and counters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import default_outcome, duration_ms, minute_bucket, severity, trace_ids

# Upper bounds of the duration histogram, in seconds.
BOUNDS = (0.005, 0.025, 0.1, 0.5, 1.0, 5.0)


def histogram(rows: DataFrame, by: list[str], value: Column, bounds: tuple[float, ...] = BOUNDS) -> DataFrame:
    """Cumulative counts le_<bound>, n and total of each group, in one aggregation."""
    counts = [F.count_if(value <= b).alias(f"le_{str(b).replace('.', '_')}") for b in bounds]
    return rows.groupBy(*by).agg(*counts, F.count(value).alias("n"), F.sum(value).alias("total"))


def capped_namespaces(rows: DataFrame, most: int, order: str) -> DataFrame:
    """`label`: the namespace for the first `most` seen, `other` for later ones, `platform` for an empty one."""
    first = rows.where(F.coalesce("namespace", F.lit("")) != "").groupBy("namespace").agg(F.min(order).alias("first"))
    early = first.orderBy("first", "namespace").limit(most).select("namespace", F.lit(True).alias("early"))
    label = F.when(F.coalesce("namespace", F.lit("")) == "", "platform").when(F.col("early"), F.col("namespace")).otherwise("other")
    return rows.join(early, "namespace", "left").withColumn("label", label).drop("early")


def ring(entries: DataFrame, most_rows: int, most_bytes: int) -> DataFrame:
    """What a bounded ring of each (namespace, worker) still holds: its newest rows within both limits."""
    w = Window.partitionBy("namespace", "worker").orderBy(F.desc("seq"))
    size = F.octet_length("message")
    kept = entries.withColumn("__n", F.row_number().over(w)).withColumn("__b", F.sum(size).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return kept.where((F.col("__n") <= most_rows) & (F.col("__b") <= most_bytes)).drop("__n", "__b")


def tail(entries: DataFrame, since: int, limit: int) -> DataFrame:
    """Entries behind a sequence number, oldest first. The last one's seq is the next cursor."""
    return entries.where(F.col("seq") > since).orderBy("seq").limit(limit)


def search(events: DataFrame, text: str) -> DataFrame:
    """Events whose JSON form holds the text, case counting."""
    if len(text.encode()) > 256:
        raise ValueError("a search text has at most 256 bytes")
    return events.where(F.to_json(F.struct(*events.columns)).contains(text)) if text else events


def enrich(requests: DataFrame) -> DataFrame:
    """Adds severity, outcome, duration_ms, trace_id and span_id."""
    ids = trace_ids(F.col("traceparent"))
    return (
        requests.withColumn("severity", severity(F.col("level")))
        .withColumn("outcome", default_outcome(F.col("outcome"), F.col("status")))
        .withColumn("duration_ms", duration_ms(F.col("started_ms"), F.col("finished_ms")))
        .withColumn("trace_id", ids["trace_id"])
        .withColumn("span_id", ids["span_id"])
    )


def parse_ingest(lines: DataFrame, column: str = "value") -> DataFrame:
    """Entries of posted bodies: a JSON array of lines, or an object with `events`. Bodies over 1 MiB and broken ones give none."""
    entry = "STRUCT<level: STRING, message: STRING, at_ms: BIGINT>"
    body = F.when(F.octet_length(column) <= 1 << 20, F.col(column))
    plain = F.from_json(body, f"ARRAY<{entry}>", {"mode": "PERMISSIVE"})
    wrapped = F.from_json(body, f"STRUCT<events: ARRAY<{entry}>>", {"mode": "PERMISSIVE"})["events"]
    entries = F.when(F.ltrim(body).startswith("["), plain).otherwise(wrapped)
    return lines.select("*", F.explode(entries).alias("entry")).select("*", "entry.*").drop("entry", column)


def fresh_subscriptions(entries: DataFrame, subscriptions: DataFrame, now_ms: int) -> DataFrame:
    """Entries of workers with a subscription that hasn't lapsed."""
    return entries.join(subscriptions.where(F.col("expires_ms") > now_ms).select("namespace", "worker").distinct(), ["namespace", "worker"], "left_semi")


def outcome_counts(events: DataFrame, by: list[str]) -> DataFrame:
    """Number of events by given columns, kind and outcome, in order of all."""
    names = [*by, "kind", "outcome"]
    return events.groupBy(*names).agg(F.count("*").alias("n")).orderBy(*names)


def minute_counts(events: DataFrame, at_ms: str) -> DataFrame:
    """Events in each minute."""
    return events.groupBy(minute_bucket(F.col(at_ms)).alias("minute")).agg(F.count("*").alias("n"))

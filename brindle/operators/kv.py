"""Key-value tables with expiry: columns key, value, meta, updated_ms, expires_ms (0 = never)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import prefix_successor, ttl_live

INT64 = (1 << 63) - 1


def live(kv: DataFrame, now_ms: int) -> DataFrame:
    return kv.where(ttl_live(F.col("expires_ms"), now_ms))


def get(kv: DataFrame, key: str, now_ms: int) -> DataFrame:
    return live(kv, now_ms).where(F.col("key") == key)


def get_many(kv: DataFrame, keys: DataFrame, now_ms: int) -> DataFrame:
    """`keys`: pos, key. One row for each, in `pos`, with `found`; misses have null values."""
    hits = live(kv, now_ms).select("key", "value", "meta", F.lit(True).alias("hit"))
    return keys.join(hits, "key", "left").select("pos", "key", "value", "meta", F.coalesce("hit", F.lit(False)).alias("found"))


def _prefixed(column: Column, prefix: str) -> Column:
    """A range on the key: both ends reach the scan's statistics."""
    if not prefix:
        return F.lit(True)
    end = prefix_successor(prefix)
    return (column >= prefix) & (F.lit(True) if end is None else column < end)


def list_page(kv: DataFrame, now_ms: int, *, prefix: str = "", after: str = "", limit: int = 1000) -> DataFrame:
    """Keys of a prefix behind a cursor, in order. Key order is that of UTF-8 bytes."""
    rows = live(kv, now_ms).where(_prefixed(F.col("key"), prefix))
    rows = rows.where(F.col("key") > after) if after else rows
    return rows.select("key", "meta", "expires_ms").orderBy("key").limit(limit)


def next_cursor(page: DataFrame, limit: int) -> str | None:
    """The last key if the page is full; an empty page may follow."""
    rows = [r["key"] for r in page.select("key").collect()]
    return rows[-1] if len(rows) == limit else None


def scan_like(kv: DataFrame, prefix: str) -> DataFrame:
    """LIKE prefix%: wildcards in the prefix count, ASCII case doesn't, expired rows show."""
    return kv.where(F.col("key").ilike(prefix.replace("\\", "\\\\") + "%"))


def stats(kv: DataFrame, now_ms: int, prefix: str = "") -> DataFrame:
    """n_keys, n_expired, next_expiry (0 if none)."""
    rows = kv.where(_prefixed(F.col("key"), prefix))
    due = F.col("expires_ms") > 0
    return rows.agg(
        F.count("*").alias("n_keys"),
        F.count_if(due & (F.col("expires_ms") <= now_ms)).alias("n_expired"),
        F.coalesce(F.min(F.when(due, F.col("expires_ms"))), F.lit(0)).alias("next_expiry"),
    )


def _latest(rows: DataFrame, order: list[Column]) -> DataFrame:
    """Newest row of each key by one aggregation, which combines before the exchange."""
    best = F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("best")
    return rows.groupBy(F.col("key").alias("__key")).agg(best).select("best.*")


def put(kv: DataFrame, batch: DataFrame, now_ms: int) -> DataFrame:
    """Full replacement by key. `batch`: seq, key, value, meta, expires_ms; a past expiry becomes now."""
    names = ["key", "value", "meta", "updated_ms", "expires_ms"]
    clamp = F.when(F.col("expires_ms") == 0, F.lit(0)).otherwise(F.greatest("expires_ms", F.lit(now_ms))).cast("long")
    new = batch.select("key", "value", "meta", F.lit(now_ms).cast("long").alias("updated_ms"), clamp.alias("expires_ms"), F.col("seq").cast("long").alias("__seq"))
    rows = kv.select(*names, F.lit(-1).cast("long").alias("__seq")).unionByName(new)
    return _latest(rows, [F.col("__seq")]).select(*names)


def put_if(kv: DataFrame, batch: DataFrame, now_ms: int, condition: str) -> DataFrame:
    """`absent`: only keys that aren't live; `present`: only keys that are."""
    keys = live(kv, now_ms).select("key")
    if condition not in ("absent", "present"):
        raise ValueError("a condition is absent or present")
    return put(kv, batch.join(keys, "key", "left_anti" if condition == "absent" else "left_semi"), now_ms)


def increment(kv: DataFrame, batch: DataFrame, now_ms: int, expires_ms: int = 0) -> DataFrame:
    """Adds `delta` (batch: key, delta) to decimal text values; a missing or expired key counts from 0.

    The row's expiry becomes `expires_ms` (now, if that has passed); its metadata stays, even of an expired row. A
    value that is no whole number, or a sum beyond 64 bits, raises when the result is computed.
    """
    deltas = batch.groupBy("key").agg(F.sum(F.col("delta").cast("decimal(38,0)")).alias("delta"))
    text = F.trim(F.when(ttl_live(F.col("expires_ms"), now_ms), F.col("value").cast("string")))
    fail = lambda why: F.raise_error(F.lit(why)).cast("decimal(38,0)")
    number = F.when(text.isNull(), F.lit(0)).otherwise(F.when(text.rlike(r"^[+-]?[0-9]{1,19}$"), text.cast("decimal(38,0)")).otherwise(fail("a value is no whole number")))
    total = number.cast("decimal(38,0)") + F.col("delta")
    fits = F.when(total.between(-INT64 - 1, INT64), total).otherwise(fail("a sum is beyond 64 bits"))
    changed = deltas.join(kv, "key", "left").select(
        "key",
        fits.cast("long").cast("string").cast("binary").alias("value"),
        "meta",
        F.lit(now_ms).cast("long").alias("updated_ms"),
        F.lit(max(expires_ms, now_ms) if expires_ms > 0 else 0).cast("long").alias("expires_ms"),
    )
    return kv.join(deltas.select("key"), "key", "left_anti").select(*changed.columns).unionByName(changed)


def delete_expired(kv: DataFrame, now_ms: int) -> DataFrame:
    return live(kv, now_ms)


def delete(kv: DataFrame, keys: DataFrame) -> DataFrame:
    return kv.join(keys.select("key"), "key", "left_anti")

"""Queries of the library's own operators over the driver's tables, and the SQL that checks them.

Each query recasts a driver table (events as messages, customers as a key-value table, ...) and
applies one operator to all of it. NOW stands for the clock, which no operator reads.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import cron, scalars
from brindle.functions.filters import compile_filter
from brindle.operators import control, kv, lineage, logs, objects, pages, queue, timers, vector, workflow
from brindle.plans import planners
from brindle.plans.surface import Database
from brindle.sources.tables import table
from brindle.streaming import states

NOW = 1705276800000  # 2024-01-15

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):  # noqa: ANN201
    """Registers a function under its name, with its SQL if there is any."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def epoch_ms(column: str) -> F.Column:
    return F.expr(f"timestampdiff(MILLISECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', {column})")


# Recast tables ------------------------------------------------------------------------------------


def messages(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    at = epoch_ms("ts")
    lease = F.when(F.col("event_id") % 7 == 0, F.lit(NOW + 30_000)).otherwise(F.lit(0)).cast("long")
    return e.select(
        F.col("event_id").alias("id"), F.col("props").alias("body"), F.lit("json").alias("content_type"), at.alias("visible_at_ms"),
        (F.col("user_id") % 5).alias("attempts"), lease.alias("lease_until_ms"), at.alias("created_ms"),
    )


MESSAGES = f"""messages AS (SELECT event_id AS id, props AS body, 'json' AS content_type, (epoch_us(ts) // 1000) AS visible_at_ms, user_id % 5 AS attempts,
  CASE WHEN event_id % 7 = 0 THEN {NOW + 30_000} ELSE 0 END AS lease_until_ms, (epoch_us(ts) // 1000) AS created_ms FROM events)"""


def kv_table(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    expires = F.when(F.col("c_custkey") % 5 == 0, F.lit(0)).otherwise(NOW + (F.col("c_custkey") % 1000 - 500) * 1000).cast("long")
    return c.select(
        F.col("c_name").alias("key"), F.col("c_custkey").cast("string").cast("binary").alias("value"), F.col("c_mktsegment").alias("meta"), F.lit(0).cast("long").alias("updated_ms"), expires.alias("expires_ms")
    )


KV = f"""kv AS (SELECT c_name AS key, c_custkey::VARCHAR AS value, c_mktsegment AS meta, 0::BIGINT AS updated_ms,
  CASE WHEN c_custkey % 5 = 0 THEN 0 ELSE {NOW} + (c_custkey % 1000 - 500) * 1000 END AS expires_ms, c_custkey FROM customer)"""
LIVE = f"(expires_ms = 0 OR expires_ms > {NOW})"


def vectors(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "embeddings")
    meta = F.parse_json(F.to_json(F.struct(F.col("label"), (F.col("vec_id") % 3).alias("third"), F.struct((F.col("vec_id") % 2 == 0).alias("even")).alias("nested"))))
    return e.select(F.col("vec_id").alias("id"), F.col("label").cast("string").alias("ns"), F.col("embedding").alias("values"), meta.alias("metadata"), "label")


CONFIG = vector.Config(64)
_Q0 = "q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 0)"


def _first_vector(index: DataFrame) -> list[float]:
    return [float(x) for x in index.where("id = 0").select("values").first()["values"]]


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


def instances(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    status = F.when(F.col("o_orderstatus") == "F", "complete").when(F.col("o_orderstatus") == "O", "queued").otherwise("errored")
    at = epoch_ms("o_orderdate")
    return o.select(F.col("o_orderkey").alias("id"), status.alias("status"), at.alias("created_ms"), (at + F.col("o_custkey") * 1000).alias("updated_ms"), F.lit(0).cast("long").alias("lease_until_ms"), F.lit(0).cast("long").alias("generation"))


INSTANCES = """instances AS (SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'F' THEN 'complete' WHEN 'O' THEN 'queued' ELSE 'errored' END AS status,
  (epoch_us(o_orderdate) // 1000) AS created_ms, (epoch_us(o_orderdate) // 1000) + o_custkey * 1000 AS updated_ms FROM orders)"""


def invocations(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    record = F.to_json(F.struct(F.col("turn").alias("attempt"), F.col("role")))
    return c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.concat(F.lit("c"), F.col("conv_id")).alias("logical_id"), F.col("turn").alias("started_ms"),
        F.when(F.col("role") == "assistant", "success").otherwise("running").alias("status"), record.alias("record"), F.col("turn").alias("seq"),
    )


INVOCATIONS = """invocations AS (SELECT conv_id * 1000 + turn AS id, 'c' || conv_id AS logical_id, turn AS started_ms,
  CASE WHEN role = 'assistant' THEN 'success' ELSE 'running' END AS status, turn AS seq FROM conversations)"""


def object_table(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "pages")
    key = F.regexp_replace(F.regexp_replace("url", "^https?://", ""), "[?#].*$", "")
    return p.groupBy(key.alias("key")).agg(F.max(F.length("html")).cast("long").alias("size"), F.min("page_id").alias("last_modified_ms"))


OBJECTS = """objects AS (SELECT regexp_replace(regexp_replace(url, '^https?://', ''), '[?#].*$', '') AS key, max(length(html))::BIGINT AS size, min(page_id) AS last_modified_ms
  FROM pages GROUP BY 1)"""


def frames(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    seq = F.col("l_orderkey") * 10 + F.col("l_linenumber")
    size = F.when(F.col("l_linenumber") == 1, 20 + F.col("l_orderkey") % 80).otherwise(0)
    return li.select((F.col("l_suppkey") % 8).alias("db"), (F.col("l_partkey") % 100 + 1).alias("page_no"), seq.alias("seq"), size.cast("long").alias("commit_pages"), F.col("l_quantity").alias("data"))


FRAMES = """frames AS (SELECT l_suppkey % 8 AS db, l_partkey % 100 + 1 AS page_no, l_orderkey * 10 + l_linenumber AS seq,
  CASE WHEN l_linenumber = 1 THEN 20 + l_orderkey % 80 ELSE 0 END AS commit_pages, l_quantity AS data FROM lineitem)"""


def segments(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select((F.col("o_custkey") % 20).alias("db"), F.col("o_orderkey").alias("min_txid"), (F.col("o_orderkey") + F.col("o_custkey") % 37).alias("max_txid"), (F.col("o_orderkey") % 50 + 1).alias("size"))


SEGMENTS = "segments AS (SELECT o_custkey % 20 AS db, o_orderkey AS min_txid, o_orderkey + o_custkey % 37 AS max_txid, o_orderkey % 50 + 1 AS size FROM orders)"


def database(spark: SparkSession, d: str) -> Database:
    names = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events")
    return Database(spark, {n: table(spark, d, n) for n in names})


# Vectors ------------------------------------------------------------------------------------------

_COSINE = "CASE WHEN list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[]) = 0 THEN 0 ELSE list_cosine_similarity(embedding::DOUBLE[], q) END"


@query(f"WITH {_Q0} SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q WHERE label = 0 ORDER BY {_COSINE} DESC, vec_id LIMIT 5")
def vector_topk_exact(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    return _rounded(vector.query(index, CONFIG, _first_vector(index), 5, ns="0"))


@query(f"WITH {_Q0} SELECT vec_id, round(list_distance(embedding::DOUBLE[], q), 6) AS score FROM embeddings, q ORDER BY list_distance(embedding::DOUBLE[], q), vec_id LIMIT 10")
def vector_topk_euclidean(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    return _rounded(vector.query(index, vector.Config(64, "euclidean"), _first_vector(index), 10))


@query(f"WITH {_Q0} SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q WHERE label IN (1, 2) AND vec_id % 3 <> 1 AND vec_id % 2 = 0 ORDER BY {_COSINE} DESC, vec_id LIMIT 20")
def vector_topk_filtered(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    test = {"label": {"$in": [1, 2]}, "third": {"$ne": 1}, "nested.even": True}
    return _rounded(vector.query(index, CONFIG, _first_vector(index), 20, where=test))


@query(
    f"WITH {_Q0}, t AS (SELECT vec_id, label, {_COSINE} AS s FROM embeddings, q ORDER BY s DESC, vec_id LIMIT 80)"
    " SELECT vec_id, round(s, 6) AS score FROM t WHERE label >= 5 ORDER BY s DESC, vec_id LIMIT 20"
)
def vector_topk_compat(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    return _rounded(vector.query(index, CONFIG, _first_vector(index), 20, where={"label": {"$gte": 5}}, mode="compat"))


@query(f"WITH q AS (SELECT embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id = 7) SELECT vec_id, round({_COSINE}, 6) AS score FROM embeddings, q ORDER BY {_COSINE} DESC, vec_id LIMIT 5")
def vector_query_by_id(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(vector.query_by_id(vectors(spark, d), CONFIG, 7, 5))


@query("SELECT vec_id AS id, label FROM embeddings WHERE vec_id IN (5, 3, 99)")
def vector_get_by_ids(spark: SparkSession, d: str) -> DataFrame:
    return vector.get_by_ids(vectors(spark, d), [5, 3, 10**9, 99]).select("id", "label")


@query("SELECT vec_id AS id FROM embeddings WHERE vec_id > 100 ORDER BY vec_id LIMIT 51")
def vector_list_ids(spark: SparkSession, d: str) -> DataFrame:
    return vector.list_ids(vectors(spark, d), 100, 50)


@query("SELECT count(*) AS n_vectors, count(DISTINCT label) AS n_namespaces FROM embeddings")
def vector_describe(spark: SparkSession, d: str) -> DataFrame:
    return vector.describe(vectors(spark, d))


@query("SELECT vec_id AS id, CASE WHEN vec_id % 2 = 0 THEN label + 100 ELSE label END AS label FROM embeddings")
def vector_upsert(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d).select("id", "ns", "values", "label")
    batch = index.where("id % 2 = 0").withColumn("label", F.col("label") + 100)
    return vector.upsert(index, batch).select("id", "label")


@query("SELECT vec_id AS id, label FROM embeddings")
def vector_insert_only(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d).select("id", "ns", "values", "label")
    return vector.upsert(index.where("id % 3 > 0"), index.where("id % 2 = 0 OR id % 3 = 0"), insert_only=True).select("id", "label")


@query("SELECT vec_id AS id FROM embeddings WHERE label <> 4")
def vector_delete(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    return vector.delete_by_ids(index, index.where("label = 4")).select("id")


@query()
def vector_ann(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d).select("id", "ns", "values")
    near = vector.InvertedLists(index, CONFIG).query_many(index.where("id % 50 = 0"), 10)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query("SELECT event_id FROM events WHERE (props->>'$.k')::INT >= 50 AND (props->>'$.k')::INT <> 60")
def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("m", F.try_parse_json("props"))
    return e.where(compile_filter({"k": {"$gte": 50, "$ne": 60}}, F.col("m"))).select("event_id")


# Key-value tables ---------------------------------------------------------------------------------


@query(f"WITH {KV} SELECT key, meta FROM kv WHERE {LIVE}")
def kv_live(spark: SparkSession, d: str) -> DataFrame:
    return kv.live(kv_table(spark, d), NOW).select("key", "meta")


@query(f"WITH {KV} SELECT key, meta FROM kv WHERE {LIVE} AND key = 'Customer#000000005'")
def kv_get(spark: SparkSession, d: str) -> DataFrame:
    return kv.get(kv_table(spark, d), "Customer#000000005", NOW).select("key", "meta")


@query(
    f"WITH {KV}, k AS (SELECT o_orderkey AS pos, 'Customer#' || lpad((o_custkey + o_orderkey % 3 * 100000)::VARCHAR, 9, '0') AS key FROM orders)"
    f" SELECT pos, k.key, meta, l.key IS NOT NULL AS found FROM k LEFT JOIN (SELECT * FROM kv WHERE {LIVE}) l ON k.key = l.key"
)
def kv_get_many(spark: SparkSession, d: str) -> DataFrame:
    keys = table(spark, d, "orders").select(F.col("o_orderkey").alias("pos"), F.concat(F.lit("Customer#"), F.lpad((F.col("o_custkey") + F.col("o_orderkey") % 3 * 100000).cast("string"), 9, "0")).alias("key"))
    return kv.get_many(kv_table(spark, d), keys, NOW).select("pos", "key", "meta", "found")


@query(f"WITH {KV} SELECT key, meta, expires_ms FROM kv WHERE {LIVE} AND key LIKE 'Customer#0000000%' AND key > 'Customer#000000020' ORDER BY key LIMIT 50")
def kv_list_prefix(spark: SparkSession, d: str) -> DataFrame:
    return kv.list_page(kv_table(spark, d), NOW, prefix="Customer#0000000", after="Customer#000000020", limit=50)


@query(f"WITH {KV} SELECT key, expires_ms FROM kv WHERE key ILIKE 'CUSTOMER#00000_0%'")
def kv_scan_like(spark: SparkSession, d: str) -> DataFrame:
    return kv.scan_like(kv_table(spark, d), "CUSTOMER#00000_0").select("key", "expires_ms")


@query(
    f"WITH {KV} SELECT count(*) AS n_keys, count(*) FILTER (expires_ms > 0 AND expires_ms <= {NOW}) AS n_expired, coalesce(min(expires_ms) FILTER (expires_ms > 0), 0) AS next_expiry FROM kv"
)
def kv_stats(spark: SparkSession, d: str) -> DataFrame:
    return kv.stats(kv_table(spark, d), NOW)


@query(
    f"WITH {KV} SELECT CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE meta END AS meta, key, CASE WHEN c_custkey % 3 = 0 THEN {NOW} ELSE updated_ms END AS updated_ms, CASE WHEN c_custkey % 3 = 0 THEN 0 ELSE expires_ms END AS expires_ms FROM kv"
)
def kv_put(spark: SparkSession, d: str) -> DataFrame:
    t = kv_table(spark, d)
    batch = t.where(F.col("value").cast("string").cast("long") % 3 == 0).select(F.lit(1).alias("seq"), "key", "value", F.lit("new").alias("meta"), F.lit(0).alias("expires_ms"))
    return kv.put(t, batch, NOW).select("key", "meta", "updated_ms", "expires_ms")


@query(f"WITH {KV} SELECT key, CASE WHEN {LIVE} THEN meta ELSE 'new' END AS meta FROM kv")
def kv_put_if_absent(spark: SparkSession, d: str) -> DataFrame:
    t = kv_table(spark, d)
    batch = t.select(F.lit(1).alias("seq"), "key", "value", F.lit("new").alias("meta"), F.lit(0).alias("expires_ms"))
    return kv.put_if(t, batch, NOW, "absent").select("key", "meta")


@query(
    f"WITH {KV}, b AS (SELECT c_name AS key, sum(o_orderkey)::BIGINT AS delta FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_name)"
    f" SELECT kv.key, CASE WHEN delta IS NULL THEN value WHEN {LIVE} THEN (value::BIGINT + delta)::VARCHAR ELSE delta::VARCHAR END AS value, meta, CASE WHEN delta IS NULL THEN expires_ms ELSE 0 END AS expires_ms FROM kv LEFT JOIN b ON kv.key = b.key"
)
def kv_increment(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select(F.col("c_name").alias("key"), F.col("o_orderkey").alias("delta"))
    return kv.increment(kv_table(spark, d), batch, NOW).select("key", F.col("value").cast("string").alias("value"), "meta", "expires_ms")


# Queues -------------------------------------------------------------------------------------------

_CLAIMABLE = f"visible_at_ms <= {NOW} AND lease_until_ms <= {NOW}"


@query(
    f"WITH {MESSAGES} SELECT count(*) AS depth, count(*) FILTER ({_CLAIMABLE}) AS visible, count(*) FILTER (lease_until_ms > {NOW}) AS leased,"
    f" coalesce(min(visible_at_ms), 0) AS oldest_visible_ms, coalesce(max(attempts), 0) AS max_attempts FROM messages"
)
def queue_status(spark: SparkSession, d: str) -> DataFrame:
    return queue.status(messages(spark, d), NOW)


@query(f"WITH {MESSAGES} SELECT id, attempts + 1 AS attempts, {NOW + 60_000}::BIGINT AS lease_until_ms FROM messages WHERE {_CLAIMABLE} ORDER BY visible_at_ms, id LIMIT 100")
def queue_claim(spark: SparkSession, d: str) -> DataFrame:
    return queue.claim(messages(spark, d), NOW, 60_000, 100).select("id", "attempts", "lease_until_ms")


@query(f"WITH {MESSAGES} SELECT id, visible_at_ms FROM messages WHERE id > 500 ORDER BY id LIMIT 11")
def queue_peek(spark: SparkSession, d: str) -> DataFrame:
    return queue.peek(messages(spark, d), 500, 10).select("id", "visible_at_ms")


@query(f"WITH {MESSAGES}, f AS (SELECT * FROM messages WHERE {_CLAIMABLE} ORDER BY visible_at_ms, id LIMIT 10) SELECT coalesce(count(*) >= 10 OR max(attempts) > 0 OR {NOW} - min(visible_at_ms) >= 5000, false) AS ready FROM f")
def queue_batch_ready(spark: SparkSession, d: str) -> DataFrame:
    return queue.batch_ready(messages(spark, d), NOW, 10, 5000)


_OUTCOMES = "o AS (SELECT event_id AS id, CASE WHEN event_type IN ('error', 'view') THEN 'retry' ELSE 'ack' END AS action, user_id % 60 AS delay_s FROM events WHERE event_type <> 'signup')"
_FATE = "CASE WHEN coalesce(action, 'ack') = 'ack' THEN 'ack' WHEN attempts > 3 THEN 'dead' ELSE 'retry' END"


@query(f"WITH {MESSAGES}, {_OUTCOMES} SELECT fate, count(*) AS n, sum(delay)::BIGINT AS delay_s FROM (SELECT {_FATE} AS fate, CASE WHEN action = 'retry' THEN delay_s END AS delay FROM messages LEFT JOIN o USING (id)) GROUP BY fate")
def queue_settle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'signup'")
    out = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("error", "view"), "retry").otherwise("ack").alias("action"), (F.col("user_id") % 60).alias("delay_s"), F.lit(1).alias("seq"))
    return queue.settle(messages(spark, d), out).groupBy("fate").agg(F.count("*").alias("n"), F.sum("delay_s").alias("delay_s"))


@query(f"WITH {MESSAGES}, {_OUTCOMES} SELECT id, CASE WHEN action = 'retry' THEN {NOW} + delay_s * 1000 ELSE visible_at_ms END AS visible_at_ms FROM messages LEFT JOIN o USING (id) WHERE {_FATE} = 'retry'")
def queue_after_settle(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'signup'")
    out = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("error", "view"), "retry").otherwise("ack").alias("action"), (F.col("user_id") % 60).alias("delay_s"), F.lit(1).alias("seq"))
    m = messages(spark, d)
    return queue.after_settle(m, queue.settle(m, out), NOW)[0].select("id", "visible_at_ms")


@query(
    f"WITH {MESSAGES}, b AS (SELECT event_id + 10000000 AS id, 'k' || (event_id % 4000) AS key, event_id % 4000 % 3 AS f FROM events WHERE event_id % 2 = 0),"
    " n AS (SELECT id, key, row_number() OVER (PARTITION BY key ORDER BY id) AS r FROM b) SELECT id FROM messages UNION ALL SELECT id FROM n WHERE r = 1 AND substr(key, 2)::INT >= 1000"
)
def queue_send_once(spark: SparkSession, d: str) -> DataFrame:
    batch = table(spark, d, "events").where("event_id % 2 = 0").select(
        (F.col("event_id") + 10000000).alias("id"), F.col("props").alias("body"), F.lit("json").alias("content_type"), F.lit(0).alias("delay_s"), F.concat(F.lit("k"), F.col("event_id") % 4000).alias("key"), F.lit("f").alias("fingerprint")
    )
    ledger = spark.range(1000).select(F.concat(F.lit("k"), F.col("id")).alias("key"), F.col("id").alias("message_id"), F.lit("f").alias("fingerprint"), F.lit(NOW + 1).cast("long").alias("expires_ms"))
    return queue.send(messages(spark, d), ledger, batch, NOW)[0].select("id")


# Timers and cron ----------------------------------------------------------------------------------


def _timers(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").cast("string").alias("token"), epoch_ms("ts").alias("due_ms"), F.col("event_type").alias("kind"), F.col("user_id").cast("string").alias("scope"), F.lit("").alias("occurrence"), "event_id", "user_id")
    retries = rows.where("event_id % 4 = 1").select("token", (F.col("user_id") % 9 + 1).cast("int").alias("attempt"), (F.col("due_ms") + 86_400_000 * (F.col("user_id") % 3)).alias("retry_after_ms"))
    return rows, retries, rows.where("event_id % 5 = 0").select("token", F.lit(NOW + 1).alias("expires_ms"))


TIMERS = """timers AS (SELECT event_id::VARCHAR AS token, (epoch_us(ts) // 1000) AS due_ms, event_id, user_id FROM events),
  retries AS (SELECT token, (user_id % 9 + 1)::INT AS attempt, due_ms + 86400000 * (user_id % 3) AS retry_after_ms FROM timers WHERE event_id % 4 = 1),
  waiting AS (SELECT t.token, due_ms, coalesce(attempt, 0) AS attempt, greatest(due_ms, coalesce(retry_after_ms, 0)) AS due_at FROM timers t LEFT JOIN retries USING (token) WHERE event_id % 5 <> 0)"""


@query(f"WITH {TIMERS} SELECT token, due_ms, attempt FROM waiting WHERE due_at <= {NOW}")
def timers_due(spark: SparkSession, d: str) -> DataFrame:
    return timers.due(*_timers(spark, d), NOW).select("token", "due_ms", "attempt")


@query(f"WITH {TIMERS} SELECT coalesce(min(due_at), 0) AS next_due_ms FROM waiting")
def timers_next_due(spark: SparkSession, d: str) -> DataFrame:
    return timers.next_due(*_timers(spark, d))


@query(
    f"WITH {TIMERS}, f AS (SELECT token FROM timers WHERE event_id % 3 = 0), j AS (SELECT coalesce(retries.token, f.token) AS token, coalesce(attempt, 0) + (f.token IS NOT NULL)::INT AS attempt, retry_after_ms, f.token IS NOT NULL AS again FROM retries FULL JOIN f ON retries.token = f.token)"
    f" SELECT token, attempt, CASE WHEN again THEN {NOW} + (least(5 * pow(2, attempt - 1), 300) * 1000)::BIGINT ELSE retry_after_ms END AS retry_after_ms FROM j"
)
def timers_schedule_retries(spark: SparkSession, d: str) -> DataFrame:
    rows, retries, _ = _timers(spark, d)
    return timers.schedule_retries(retries, rows.where("event_id % 3 = 0"), NOW)


@query("SELECT event_id, substr(sha256(user_id || '|' || event_type || '|' || (epoch_us(ts) // 1000) || '|' || 'x'), 1, 32) AS token FROM events")
def timer_tokens(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").cast("string").alias("scope"), F.col("event_type").alias("kind"), epoch_ms("ts").alias("due_ms"), F.lit("x").alias("occurrence"))
    return timers.with_tokens(e).select("event_id", "token")


@query("SELECT event_id FROM events WHERE minute(ts) % 15 = 0 AND hour(ts) BETWEEN 8 AND 18 AND (day(ts) IN (1, 15) OR dayofweek(ts) = 1)")
def cron_matches(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").where(cron.parse("*/15 8-18 1,15 * 1").column(F.col("ts"))).select("event_id")


@query(
    "WITH m AS (SELECT DISTINCT date_trunc('minute', ts) AS slot FROM events) SELECT 'a' AS namespace, 'w1' AS worker, '0 * * * *' AS cron, (epoch_us(slot) // 1000) AS slot_ms FROM m WHERE minute(slot) = 0"
    " UNION ALL SELECT 'a', 'w2', '30 6 * * 1-5', (epoch_us(slot) // 1000) FROM m WHERE minute(slot) = 30 AND hour(slot) = 6 AND dayofweek(slot) BETWEEN 1 AND 5"
)
def cron_slots(spark: SparkSession, d: str) -> DataFrame:
    minutes = table(spark, d, "events").select(F.date_trunc("minute", F.col("ts").cast("timestamp")).cast("timestamp_ntz").alias("ts")).distinct()
    slots = timers.cron_slots(minutes, [("a", "w1", "0 * * * *"), ("a", "w2", "30 6 * * 1-5")])
    return slots.select("namespace", "worker", "cron", epoch_ms("slot").alias("slot_ms"))


# Workflows and lineage ----------------------------------------------------------------------------


@query(f"WITH {INSTANCES} SELECT id, status, created_ms FROM instances WHERE status = 'complete' ORDER BY created_ms DESC, id DESC LIMIT 50 OFFSET 100")
def workflow_list_page(spark: SparkSession, d: str) -> DataFrame:
    return workflow.list_page(instances(spark, d), limit=50, offset=100, status="complete").select("id", "status", "created_ms")


@query(f"WITH {INSTANCES} SELECT coalesce(status, 'total') AS status, count(*) AS n FROM instances GROUP BY ROLLUP (status)")
def workflow_count_by_status(spark: SparkSession, d: str) -> DataFrame:
    return workflow.count_by_status(instances(spark, d))


_LIMITS = (900000000000, 850000000000)


@query(f"WITH {INSTANCES} SELECT id FROM instances WHERE NOT (status = 'complete' AND updated_ms < {_LIMITS[0]}) AND NOT (status = 'errored' AND updated_ms < {_LIMITS[1]})")
def workflow_prune(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    return workflow.prune(instances(spark, d), steps, *_LIMITS)[0].select("id")


@query(f"WITH {INSTANCES} SELECT l_orderkey AS instance_id, count(*) AS n FROM lineitem WHERE l_orderkey IN (SELECT id FROM instances WHERE NOT (status = 'complete' AND updated_ms < {_LIMITS[0]}) AND NOT (status = 'errored' AND updated_ms < {_LIMITS[1]})) GROUP BY 1")
def workflow_prune_steps(spark: SparkSession, d: str) -> DataFrame:
    steps = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("instance_id"))
    return workflow.prune(instances(spark, d), steps, *_LIMITS)[1].groupBy("instance_id").agg(F.count("*").alias("n"))


@query(f"WITH {INSTANCES} SELECT id, 'running' AS status, {NOW + 60_000}::BIGINT AS lease_until_ms, 1::BIGINT AS generation FROM instances WHERE status = 'queued' ORDER BY created_ms, id LIMIT 20")
def workflow_claim(spark: SparkSession, d: str) -> DataFrame:
    return workflow.claim_runs(instances(spark, d), NOW, 60_000, 20)


@query(f"WITH {INVOCATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY started_ms DESC, id DESC) AS n FROM invocations) SELECT logical_id, id, started_ms FROM r WHERE n = 1")
def lineage_newest(spark: SparkSession, d: str) -> DataFrame:
    return lineage.newest_by_logical_id(invocations(spark, d)).select("logical_id", "id", "started_ms")


@query(f"WITH {INVOCATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY started_ms DESC, id DESC) AS n FROM invocations), e AS (SELECT event_id AS invocation_id, event_id::VARCHAR AS message_id, 'c' || (event_id % 500) AS logical_id FROM events) SELECT invocation_id, message_id, e.logical_id, r.id AS parent_id, started_ms AS parent_started_ms FROM e JOIN r ON e.logical_id = r.logical_id AND n = 1")
def lineage_latest_parent(spark: SparkSession, d: str) -> DataFrame:
    links = table(spark, d, "events").select(F.col("event_id").alias("invocation_id"), F.col("event_id").cast("string").alias("message_id"), F.concat(F.lit("c"), F.col("event_id") % 500).alias("logical_id"))
    return lineage.latest_parents(links, invocations(spark, d))


@query(f"WITH {INVOCATIONS} SELECT logical_id, max(started_ms) + 1 AS next_attempt FROM invocations GROUP BY logical_id")
def lineage_next_attempt(spark: SparkSession, d: str) -> DataFrame:
    return lineage.next_attempt(invocations(spark, d))


@query(f"WITH {INVOCATIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY logical_id ORDER BY started_ms DESC, id DESC) AS n FROM invocations) SELECT logical_id, id FROM r WHERE n <= 2")
def lineage_keep_newest(spark: SparkSession, d: str) -> DataFrame:
    return lineage.keep_newest(invocations(spark, d), 2, key=["logical_id"]).select("logical_id", "id")


@query(
    f"WITH {INVOCATIONS}, a AS (SELECT logical_id AS id, status, seq FROM invocations), f AS (SELECT id, min(seq) FILTER (status = 'success') AS s, max(seq) AS m FROM a GROUP BY id)"
    " SELECT a.id, status, seq FROM a JOIN f ON a.id = f.id AND a.seq = coalesce(s, m)"
)
def lineage_first_final(spark: SparkSession, d: str) -> DataFrame:
    rows = invocations(spark, d).select(F.col("logical_id").alias("id"), "status", "seq")
    return lineage.merge_records(rows.where("seq % 2 = 0"), rows.where("seq % 2 = 1"))


# Objects ------------------------------------------------------------------------------------------


@query(f"WITH {OBJECTS} SELECT DISTINCT CASE WHEN instr(key, '/') > 0 THEN substr(key, 1, instr(key, '/')) ELSE key END AS name, instr(key, '/') > 0 AS is_prefix FROM objects ORDER BY name, is_prefix LIMIT 1000")
def objects_roll_up(spark: SparkSession, d: str) -> DataFrame:
    return objects.roll_up(object_table(spark, d))


@query(f"WITH {OBJECTS} SELECT key, size FROM objects WHERE key > 'm.' ORDER BY key LIMIT 40")
def objects_list_page(spark: SparkSession, d: str) -> DataFrame:
    return objects.list_page(object_table(spark, d), after="m.", limit=40).select("key", "size")


@query(f"WITH {OBJECTS} SELECT count(*) AS n_objects, coalesce(sum(size), 0)::BIGINT AS n_bytes, false AS truncated FROM objects")
def objects_stats(spark: SparkSession, d: str) -> DataFrame:
    return objects.stats(object_table(spark, d))


_CHANGES = "c AS (SELECT user_id AS bucket, event_id AS seq, CASE WHEN event_type IN ('click', 'error') THEN -1 ELSE 1 END AS d, CASE WHEN event_type IN ('click', 'error') THEN -1 ELSE 1 END * floor(value)::BIGINT AS b FROM events)"
_RUN = "sum({0}) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING)"


@query(
    f"WITH {_CHANGES}, s AS (SELECT *, {_RUN.format('d')} AS so, {_RUN.format('b')} AS sb FROM c) SELECT bucket, seq,"
    " (so - least(0, min(so) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS objects, (sb - least(0, min(sb) OVER (PARTITION BY bucket ORDER BY seq ROWS UNBOUNDED PRECEDING)))::BIGINT AS bytes FROM s"
)
def objects_usage(spark: SparkSession, d: str) -> DataFrame:
    sign = F.when(F.col("event_type").isin("click", "error"), -1).otherwise(1)
    c = table(spark, d, "events").select(F.col("user_id").alias("bucket"), F.col("event_id").alias("seq"), sign.alias("d_objects"), (sign * F.floor("value")).alias("d_bytes"))
    return objects.usage(c)


@query("SELECT doc_id AS key FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) AND doc_id % 3 = 0")
def objects_sweep(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("key"))
    marks = docs.where("key % 3 = 0").withColumn("marked_ms", F.lit(NOW - 3_600_000))
    return objects.sweep(docs, table(spark, d, "labels").select(F.col("doc_id").alias("key")), marks, NOW, 3_600_000)[1]


@query("SELECT l_orderkey AS upload_id, max((epoch_us(l_shipdate) // 1000)) AS newest_ms, count(*) AS parts FROM lineitem GROUP BY 1 HAVING max((epoch_us(l_shipdate) // 1000)) < 820454400000")
def objects_stale_uploads(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("upload_id"), epoch_ms("l_shipdate").alias("last_modified_ms"))
    return objects.stale_uploads(parts, 820454400000)


# Logs and counters --------------------------------------------------------------------------------

_LE = ", ".join(f"count(*) FILTER (value / 100 <= {b}) AS le_{str(b).replace('.', '_')}" for b in logs.BOUNDS)


@query(f"SELECT event_type, {_LE}, count(value) AS n, round(sum(value / 100), 4) AS total FROM events GROUP BY event_type")
def logs_histogram(spark: SparkSession, d: str) -> DataFrame:
    h = logs.histogram(table(spark, d, "events"), ["event_type"], F.col("value") / 100)
    return h.withColumn("total", F.round("total", 4))


@query(
    "WITH f AS (SELECT user_id, min(event_id) AS first FROM events WHERE user_id % 10 <> 0 GROUP BY 1 ORDER BY first, user_id LIMIT 20), e AS (SELECT CASE WHEN user_id % 10 = 0 THEN 'platform' WHEN user_id IN (SELECT user_id FROM f) THEN user_id::VARCHAR ELSE 'other' END AS label FROM events)"
    " SELECT label, count(*) AS n FROM e GROUP BY label"
)
def logs_capped_namespaces(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.when(F.col("user_id") % 10 == 0, "").otherwise(F.col("user_id").cast("string")).alias("namespace"), "event_id")
    return logs.capped_namespaces(e, 20, "event_id").groupBy("label").agg(F.count("*").alias("n"))


@query(
    "WITH w AS (SELECT event_id, row_number() OVER o AS n, sum(strlen(props)) OVER o AS b FROM events WINDOW o AS (PARTITION BY user_id, event_type ORDER BY event_id DESC)) SELECT event_id FROM w WHERE n <= 5 AND b <= 40"
)
def logs_ring(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("user_id").alias("namespace"), F.col("event_type").alias("worker"), F.col("event_id").alias("seq"), F.col("props").alias("message"))
    return logs.ring(e, 5, 40).select(F.col("seq").alias("event_id"))


@query("SELECT event_id FROM events WHERE event_id > 1000 ORDER BY event_id LIMIT 200")
def logs_tail(spark: SparkSession, d: str) -> DataFrame:
    return logs.tail(table(spark, d, "events").withColumnRenamed("event_id", "seq"), 1000, 200).select(F.col("seq").alias("event_id"))


@query("SELECT event_id FROM events WHERE event_type = 'purchase'")
def logs_search(spark: SparkSession, d: str) -> DataFrame:
    return logs.search(table(spark, d, "events").select("event_id", "event_type"), '"event_type":"purchase"').select("event_id")


@query(
    "SELECT event_id, CASE WHEN event_type = 'error' THEN 17 WHEN event_type = 'click' THEN 13 ELSE 9 END AS severity, CASE WHEN event_type = 'error' THEN 'error' ELSE 'ok' END AS outcome,"
    " CASE WHEN user_id % 2 = 0 THEN floor(value)::BIGINT END AS duration_ms, CASE WHEN event_id % 2 = 0 THEN lpad(event_id::VARCHAR, 32, '0') END AS trace_id FROM events WHERE event_id > 0"
)
def logs_enrich(spark: SparkSession, d: str) -> DataFrame:
    started = F.when(F.col("user_id") % 2 == 0, F.lit(1000)).otherwise(F.lit(0)).cast("long")
    trace = F.concat(F.when(F.col("event_id") % 2 == 0, "00-").otherwise("0-"), F.lpad(F.col("event_id").cast("string"), 32, "0"), F.lit("-00f067aa0ba902b7-01"))
    e = table(spark, d, "events").where("event_id > 0").select(
        "event_id", F.when(F.col("event_type") == "error", "ERROR").when(F.col("event_type") == "click", "warn").otherwise("log").alias("level"), F.lit("").alias("outcome"),
        F.when(F.col("event_type") == "error", 500).otherwise(200).alias("status"), started.alias("started_ms"), (started + F.floor("value")).alias("finished_ms"), trace.alias("traceparent"),
    )
    return logs.enrich(e).select("event_id", "severity", "outcome", "duration_ms", "trace_id")


@query("SELECT DISTINCT regexp_replace(regexp_replace(lower(split_part(split_part(url, '://', 2), '/', 1)), ':[0-9]+$', ''), '[.]$', '') AS host FROM pages")
def normal_hosts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "pages").select(scalars.normal_host(F.split_part(F.split_part("url", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(1))).alias("host")).distinct()


# Page logs and intervals --------------------------------------------------------------------------


@query(
    f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY db, page_no ORDER BY seq DESC, data DESC) AS n FROM frames), z AS (SELECT db, arg_max(commit_pages, seq) AS size FROM frames WHERE commit_pages > 0 GROUP BY db)"
    " SELECT r.db, page_no, seq, data FROM r JOIN z ON r.db = z.db WHERE n = 1 AND page_no <= size"
)
def pages_last_writes(spark: SparkSession, d: str) -> DataFrame:
    return pages.last_writes(frames(spark, d), ["db"])


@query(
    f"WITH {FRAMES}, m AS (SELECT *, min(CASE WHEN commit_pages > 0 THEN commit_pages END) OVER (PARTITION BY db ORDER BY seq DESC ROWS UNBOUNDED PRECEDING) AS least FROM frames),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY db, page_no ORDER BY seq DESC) AS n FROM m WHERE page_no <= least) SELECT db, page_no, seq, data FROM r WHERE n = 1"
)
def pages_overlay(spark: SparkSession, d: str) -> DataFrame:
    return pages.overlay(frames(spark, d), ["db"])


_ISLANDS = """m AS (SELECT *, max(max_txid) OVER (PARTITION BY db ORDER BY min_txid, max_txid ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM {0}),
  i AS (SELECT *, sum(CASE WHEN before IS NULL OR min_txid > before + 1 THEN 1 ELSE 0 END) OVER (PARTITION BY db ORDER BY min_txid, max_txid ROWS UNBOUNDED PRECEDING) AS island FROM m),
  g AS (SELECT db, min(min_txid) AS lo, max(max_txid) AS hi FROM i GROUP BY db, island)"""


@query(f"WITH {SEGMENTS}, {_ISLANDS.format('segments')} SELECT db, lo, hi FROM g")
def ranges_merge(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).select("db", F.col("min_txid").alias("lo"), F.col("max_txid").alias("hi"))
    return pages.merge_ranges(s, ["db"])


@query(f"WITH {SEGMENTS}, h AS (SELECT * FROM segments WHERE size % 2 = 0), {_ISLANDS.format('h')} SELECT s.db, s.min_txid FROM segments s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.db = s.db AND g.lo <= s.min_txid AND g.hi >= s.max_txid)")
def ranges_uncovered(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    covered = s.where("size % 2 = 0").select("db", F.col("min_txid").alias("lo"), F.col("max_txid").alias("hi"))
    return pages.uncovered(s, covered, ["db"]).select("db", "min_txid")


@query(f"WITH {FRAMES}, p AS (SELECT DISTINCT db, page_no FROM frames WHERE seq % 40 = 1), r AS (SELECT *, page_no - row_number() OVER (PARTITION BY db ORDER BY page_no) AS run FROM p) SELECT db, min(page_no) AS first, max(page_no) AS last, count(*) AS n FROM r GROUP BY db, run")
def pages_runs(spark: SparkSession, d: str) -> DataFrame:
    return pages.page_runs(frames(spark, d).where("seq % 40 = 1"), ["db"])


@query(f"WITH {SEGMENTS}, w AS (SELECT *, sum(size) OVER o AS b, row_number() OVER o AS n FROM segments WINDOW o AS (PARTITION BY db ORDER BY min_txid ROWS UNBOUNDED PRECEDING)) SELECT db, min_txid FROM w WHERE b <= 1000 OR n = 1")
def segments_within_bytes(spark: SparkSession, d: str) -> DataFrame:
    return pages.prefix_within_bytes(segments(spark, d), ["db"], "min_txid", "size", 1000).select("db", "min_txid")


# Planners -----------------------------------------------------------------------------------------


@query(
    "WITH l AS (SELECT count(*) AS nodes, coalesce(sum(s_suppkey % 40), 0)::BIGINT AS owned FROM supplier WHERE s_acctbal > 0), d AS (SELECT *, greatest(ceil(owned / 25), nodes + 1, 1)::BIGINT AS desired FROM l)"
    " SELECT nodes, owned, desired, CASE WHEN desired > nodes THEN 'scale-up' WHEN desired < nodes THEN 'scale-down' ELSE 'hold' END AS action FROM d"
)
def plan_autoscale(spark: SparkSession, d: str) -> DataFrame:
    leases = table(spark, d, "supplier").select(F.when(F.col("s_acctbal") > 0, NOW).otherwise(1).alias("expiry"), (F.col("s_suppkey") % 40).alias("owned_cells"), F.lit(1).alias("shed_cells"), F.lit(False).alias("pressured"))
    return planners.autoscale(leases, NOW, 25, 1)


@query(
    "WITH f AS (SELECT p_partkey AS path, p_size AS bytes, p_retailprice AS mod_ms, p_partkey % 3 = 0 AS owned, p_partkey % 2 = 0 AS safe FROM part), t AS (SELECT sum(bytes) AS total FROM f),"
    " w AS (SELECT path, bytes, coalesce(sum(bytes) OVER (ORDER BY mod_ms, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM f WHERE NOT owned OR safe) SELECT path, bytes FROM w, t WHERE total - before > 20000"
)
def plan_disk_eviction(spark: SparkSession, d: str) -> DataFrame:
    f = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_size").alias("bytes"), F.col("p_retailprice").alias("mod_ms"), (F.col("p_partkey") % 3 == 0).alias("owned"), (F.col("p_partkey") % 2 == 0).alias("safe"))
    return planners.disk_evictions(f, 20000)


@query()
def plan_hot_set(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").groupBy((F.col("user_id") % 4).alias("worker"), F.col("user_id").alias("host")).agg(F.count("*").alias("requests"))
    return planners.hot_set(e.withColumn("incumbent", F.col("host") % 3 == 0), ["worker"], 8, 3, 1.2)


@query("SELECT o_custkey AS k, 'added' AS change FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0) GROUP BY 1 UNION ALL SELECT c_custkey, 'removed' FROM customer WHERE c_custkey % 2 = 0 AND c_custkey NOT IN (SELECT o_custkey FROM orders)")
def plan_changes(spark: SparkSession, d: str) -> DataFrame:
    before = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"))
    return planners.changes(before, table(spark, d, "orders").select(F.col("o_custkey").alias("k")), "k")


@query(
    "WITH RECURSIVE e AS (SELECT event_type AS namespace, event_id, epoch_us(ts) // 1000 AS ts_ms, row_number() OVER (PARTITION BY event_type ORDER BY epoch_us(ts) // 1000, event_id) AS r FROM events),"
    " b AS (SELECT namespace, event_id, ts_ms, r, 5::DOUBLE - 1 AS have, true AS admitted FROM e WHERE r = 1 UNION ALL"
    "  SELECT namespace, event_id, ts_ms, r, CASE WHEN now >= 1 THEN now - 1 ELSE now END, now >= 1 FROM (SELECT e.*, least(5::DOUBLE, b.have + (e.ts_ms - b.ts_ms)::DOUBLE / 1000::DOUBLE * 0.0005::DOUBLE) AS now FROM b JOIN e ON e.namespace = b.namespace AND e.r = b.r + 1))"
    " SELECT namespace, event_id, ts_ms, admitted FROM b"
)
def stream_token_bucket(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select(F.col("event_type").alias("namespace"), "event_id", epoch_ms("ts").alias("ts_ms"))
    return states.token_bucket(e, 0.0005, 5.0)


# The SQL surface ----------------------------------------------------------------------------------


def _surface(name: str, text: str, oracle: str | None = None) -> None:
    QUERIES[name] = lambda spark, d: database(spark, d).query(text)
    ORACLE_SQL[name] = oracle or text


_surface(
    "sql_three_way_join",
    "SELECT n_name, c_mktsegment, count(*) AS n_orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name, c_mktsegment",
)
_surface(
    "sql_pricing_summary",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS qty, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, round(avg(l_discount), 6) AS discount FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY l_returnflag, l_linestatus",
)
_surface(
    "sql_windows",
    "SELECT o_orderkey, CAST(row_number() OVER w AS BIGINT) AS rn, CAST(rank() OVER w AS BIGINT) AS rk, lag(o_orderkey) OVER w AS before, CAST(count(*) OVER (PARTITION BY o_custkey) AS BIGINT) AS n FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)",
)
_surface("sql_left_join_missing", "SELECT c_custkey FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 200000) o ON c_custkey = o_custkey WHERE o_orderkey IS NULL")
_surface("sql_full_join", "SELECT coalesce(s_nationkey, c_nationkey) AS nation, s_n, c_n FROM (SELECT s_nationkey, count(*) AS s_n FROM supplier WHERE s_nationkey < 15 GROUP BY s_nationkey) s FULL JOIN (SELECT c_nationkey, count(*) AS c_n FROM customer WHERE c_nationkey > 5 GROUP BY c_nationkey) c ON s_nationkey = c_nationkey")
_surface("sql_semi_and_anti", "SELECT p_partkey FROM part WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity > 45) AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity < 3)")
_surface("sql_set_operations", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal > 5000 INTERSECT SELECT s_nationkey FROM supplier EXCEPT SELECT n_nationkey FROM nation WHERE n_regionkey = 1")
_surface("sql_union_all", "SELECT 'c' AS kind, c_custkey AS k FROM customer UNION ALL SELECT 's', s_suppkey FROM supplier")
_surface("sql_recursive", "WITH RECURSIVE t(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM t WHERE n < 50) SELECT CAST(sum(n) AS BIGINT) AS total, count(*) AS n FROM t")
_surface("sql_having_case", "SELECT o_custkey, count(*) AS n, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS finished FROM orders GROUP BY o_custkey HAVING count(*) > 3")
_surface("sql_rollup", "SELECT n_regionkey, n_nationkey, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_nationkey)")
_surface("sql_distinct_filter", "SELECT event_type, count(DISTINCT user_id) AS users, count(*) FILTER (WHERE value > 50) AS high FROM events GROUP BY event_type")
_surface("sql_order_limit", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10")
_surface("sql_correlated_scalar", "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS n FROM customer")
_surface("sql_string_functions", "SELECT c_custkey, upper(c_mktsegment) AS u, substr(c_name, 1, 8) AS s, replace(c_name, '#', '-') AS r, CAST(length(c_name) AS BIGINT) AS n, trim(c_mktsegment) AS t, CAST(instr(c_name, '#') AS BIGINT) AS i FROM customer")
_surface("sql_null_functions", "SELECT event_id, coalesce(nullif(event_type, 'view'), 'none') AS kind, CASE WHEN value BETWEEN 10 AND 20 THEN 1 ELSE 0 END AS mid FROM events")


# Catalogue, rules and further functions -----------------------------------------------------------


@query("SELECT l_orderkey AS worker, l_linenumber::BIGINT AS number, l_partkey AS bundle FROM lineitem JOIN orders ON l_orderkey = o_orderkey AND l_linenumber = o_custkey % 4 + 1")
def control_active_versions(spark: SparkSession, d: str) -> DataFrame:
    workers = table(spark, d, "orders").select(F.lit("n").alias("namespace"), F.col("o_orderkey").alias("worker"), (F.col("o_custkey") % 4 + 1).alias("active"))
    versions = table(spark, d, "lineitem").select(F.lit("n").alias("namespace"), F.col("l_orderkey").alias("worker"), F.col("l_linenumber").cast("long").alias("number"), F.col("l_partkey").alias("bundle"))
    return control.active_versions(workers, versions).select("worker", "number", "bundle")


@query("SELECT c_custkey AS worker, n_name AS name FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def control_unpinned_bindings(spark: SparkSession, d: str) -> DataFrame:
    resources = table(spark, d, "nation").select(F.col("n_nationkey").alias("resource"), F.col("n_name").alias("title"))
    bindings = table(spark, d, "customer").select(F.col("c_custkey").alias("worker"), F.lit("b").alias("name"), F.col("c_nationkey").alias("resource"))
    pins = table(spark, d, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("worker"), F.lit("b").alias("name")).distinct()
    return control.unpinned_bindings(bindings, resources, pins).select("worker", F.col("title").alias("name"))


@query("SELECT c_custkey AS k, 'old' AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT DISTINCT o_custkey, 'new' FROM orders WHERE o_custkey % 2 = 1 OR o_custkey NOT IN (SELECT c_custkey FROM customer)")
def control_backfill(spark: SparkSession, d: str) -> DataFrame:
    old = table(spark, d, "customer").where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("k"), F.lit("old").alias("v"))
    return control.backfill(old, table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.lit("new").alias("v")), ["k"])


@query("SELECT event_id, CASE WHEN user_id % 40 < 25 THEN n_name END AS worker FROM events LEFT JOIN nation ON user_id % 40 = n_nationkey")
def control_routed(spark: SparkSession, d: str) -> DataFrame:
    routes = table(spark, d, "nation").select(F.concat(F.lit("h"), F.col("n_nationkey")).alias("host"), F.lit("n").alias("namespace"), F.col("n_name").alias("worker"))
    requests = table(spark, d, "events").select("event_id", F.concat(F.lit("h"), F.col("user_id") % 40).alias("host"))
    return control.routed(requests, routes).select("event_id", "worker")


@query("SELECT n_name AS worker, 'q' || n_regionkey AS name FROM nation")
def control_targets(spark: SparkSession, d: str) -> DataFrame:
    bindings = F.to_json(F.array(F.struct(F.lit("queue").alias("type"), F.concat(F.lit("q"), F.col("n_regionkey")).alias("name")), F.struct(F.lit("kv").alias("type"), F.lit("x").alias("name"))))
    v = table(spark, d, "nation").select(F.lit("n").alias("namespace"), F.col("n_name").alias("worker"), bindings.alias("bindings"))
    return control.targets(v, "queue").select("worker", "name")


@query(f"WITH {MESSAGES} SELECT id FROM messages WHERE CASE WHEN id % 3 = 0 THEN lease_until_ms <= {NOW} ELSE visible_at_ms <= {NOW} END AND attempts * 3 < 10")
def control_retryable(spark: SparkSession, d: str) -> DataFrame:
    jobs = messages(spark, d).select("id", F.when(F.col("id") % 3 == 0, "running").when(F.col("id") % 3 == 1, "pending").otherwise("failed").alias("state"), F.col("visible_at_ms").alias("next_retry_ms"), "lease_until_ms", (F.col("attempts") * 3).alias("attempts"))
    return jobs.where(control.retryable(NOW)).select("id")


@query("SELECT event_id AS id, event_type FROM events ORDER BY event_id DESC LIMIT 30")
def control_audit_tail(spark: SparkSession, d: str) -> DataFrame:
    return control.audit_tail(table(spark, d, "events").select(F.col("event_id").alias("id"), "event_type"), 30)


@query(
    "WITH p AS (SELECT DISTINCT '/' || c_mktsegment || '/' || c_nationkey AS path FROM customer) SELECT path, CASE WHEN path = '/BUILDING/3' THEN 1 ELSE 2 END AS rule_no,"
    " CASE WHEN path = '/BUILDING/3' THEN '/three' ELSE '/b/' || substr(path, 11) END AS target, CASE WHEN path = '/BUILDING/3' THEN 301 ELSE 302 END AS status FROM p WHERE path LIKE '/BUILDING/%'"
)
def rules_redirects(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "customer").select(F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), "c_nationkey").alias("path"))
    rules = spark.createDataFrame([(1, "/BUILDING/3", "/three", 301), (2, "/BUILDING/*", "/b/*", 302), (3, "/BUILDING/4", "/never", 301)], "rule_no int, from_path string, to_path string, status int")
    return objects.redirects(paths, rules)


@query(
    "WITH p AS (SELECT DISTINCT '/' || c_mktsegment || '/' || c_nationkey AS path FROM customer) SELECT path, 'x-a' AS name, CASE WHEN path LIKE '/AUTOMOBILE/%' THEN '2' ELSE '1' END AS value FROM p"
    " UNION ALL SELECT path, 'x-b', '3' FROM p WHERE path = '/BUILDING/3'"
)
def rules_headers(spark: SparkSession, d: str) -> DataFrame:
    paths = table(spark, d, "customer").select(F.concat(F.lit("/"), "c_mktsegment", F.lit("/"), "c_nationkey").alias("path"))
    rules = spark.createDataFrame([(1, "/*", "X-A", "1"), (2, "/AUTOMOBILE/*", "x-a", "2"), (3, "/BUILDING/3", "X-B", "3")], "rule_no int, pattern string, name string, value string")
    return objects.headers(paths, rules)


@query("SELECT p_partkey FROM part WHERE (p_type LIKE 'S%' OR p_brand = 'Brand#12') AND NOT p_type LIKE 'STANDARD%'")
def rules_worker_first(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    return p.where((objects.worker_first(F.col("p_type"), ["S*", "!STANDARD*"])) | (objects.worker_first(F.col("p_brand"), ["Brand#12"]) & ~scalars.segment_glob("STANDARD*", F.col("p_type")))).select("p_partkey")


@query(f"WITH {OBJECTS} SELECT key FROM objects WHERE key >= 'a' AND key < 'b' ORDER BY key LIMIT 25")
def objects_purge(spark: SparkSession, d: str) -> DataFrame:
    return objects.purge(object_table(spark, d), "a", 25)


@query(f"WITH {OBJECTS} SELECT key FROM objects WHERE md5(key) <> '0' AND (size % 2 = 0)")
def objects_condition(spark: SparkSession, d: str) -> DataFrame:
    o = object_table(spark, d).withColumn("etag", F.when(F.col("size") % 2 == 0, F.lit("even")))
    return o.where(objects.condition(F.col("etag"), matches=['"even"'], does_not_match=["odd"], exists=True)).select("key")


@query("SELECT doc_id AS upload_id, md5(text || lang) AS md5 FROM documents")
def objects_complete_upload(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    parts = docs.select(F.col("doc_id").alias("upload_id"), F.lit(1).alias("part"), F.encode("text", "UTF-8").alias("data")).unionByName(docs.select(F.col("doc_id").alias("upload_id"), F.lit(2).alias("part"), F.encode("lang", "UTF-8").alias("data")))
    return objects.complete_upload(parts).select("upload_id", "md5")


@query(f"WITH {FRAMES} SELECT db, count(DISTINCT page_no) AS n, count(DISTINCT page_no) = max(commit_pages) AND max(page_no) <= max(commit_pages) AS complete FROM frames GROUP BY db")
def pages_coverage(spark: SparkSession, d: str) -> DataFrame:
    return pages.coverage(frames(spark, d), ["db"])


@query(
    f"WITH {SEGMENTS}, h AS (SELECT * FROM segments WHERE size % 2 = 0), {_ISLANDS.format('h')}, u AS (SELECT s.* FROM segments s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.db = s.db AND g.lo <= s.min_txid AND g.hi >= s.max_txid)),"
    f" c AS (SELECT db, max(max_txid) AS top FROM h GROUP BY db) SELECT u.db, count(*) AS n, sum(size)::BIGINT AS bytes, {NOW} - min(min_txid) AS oldest_age_ms, max(max_txid) - coalesce(max(top), 0) AS lag FROM u LEFT JOIN c ON u.db = c.db GROUP BY u.db"
)
def segments_backlog(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("created_ms", F.col("min_txid"))
    covered = s.where("size % 2 = 0").select("db", F.col("min_txid").alias("lo"), F.col("max_txid").alias("hi"))
    return pages.backlog(s, covered, ["db"], NOW)


@query(
    f"WITH {SEGMENTS}, h AS (SELECT * FROM segments WHERE size % 2 = 0), {_ISLANDS.format('h')}, u AS (SELECT s.* FROM segments s WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.db = s.db AND g.lo <= s.min_txid AND g.hi >= s.max_txid)),"
    " l AS (SELECT *, CASE WHEN min_txid > lag(max_txid) OVER (PARTITION BY db ORDER BY min_txid) + 1 THEN 1 ELSE 0 END AS gap FROM u),"
    " r AS (SELECT *, sum(gap) OVER w AS gaps, row_number() OVER (PARTITION BY db ORDER BY min_txid) AS n FROM l WINDOW w AS (PARTITION BY db ORDER BY min_txid ROWS UNBOUNDED PRECEDING)) SELECT db, min_txid FROM r WHERE gaps = 0 AND n <= 256"
)
def segments_promotions(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d)
    covered = s.where("size % 2 = 0").select("db", F.col("min_txid").alias("lo"), F.col("max_txid").alias("hi"))
    return pages.promotions(s, covered, ["db"]).select("db", "min_txid")


@query(
    "WITH n AS (SELECT s_suppkey AS node, CASE WHEN s_suppkey = 7 THEN 60 ELSE s_suppkey % 11 END AS cells FROM supplier), t AS (SELECT sum(cells) / count(*) AS share FROM n),"
    " m AS (SELECT least(floor(max(cells - share) FILTER (node = 7)), floor(max(share * 0.98 - cells) FILTER (node <> 7)), 12) AS move FROM n, t),"
    " i AS (SELECT c_name AS scope, row_number() OVER (ORDER BY c_name) AS place FROM customer) SELECT scope FROM i, m WHERE place <= move"
)
def plan_rebalance(spark: SparkSession, d: str) -> DataFrame:
    cells = F.when(F.col("s_suppkey") == 7, 60).otherwise(F.col("s_suppkey") % 11)
    nodes = table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("node"), cells.alias("cells"), F.lit(1).alias("weight"))
    return planners.rebalance(nodes, "7", table(spark, d, "customer").select(F.col("c_name").alias("scope")), 12)


@query(f"WITH {MESSAGES}, {_OUTCOMES} SELECT id FROM messages LEFT JOIN o USING (id) WHERE {_FATE} = 'dead'")
def queue_dead_letters(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").where("event_type <> 'signup'")
    out = e.select(F.col("event_id").alias("id"), F.when(F.col("event_type").isin("error", "view"), "retry").otherwise("ack").alias("action"), (F.col("user_id") % 60).alias("delay_s"), F.lit(1).alias("seq"))
    m = messages(spark, d)
    return queue.after_settle(m, queue.settle(m, out), NOW)[1].select("id")


@query(
    "WITH w AS (SELECT user_id AS instance_id, t.type, 's' AS name FROM (SELECT DISTINCT user_id FROM events), (VALUES ('click'), ('error')) t(type)),"
    " e AS (SELECT user_id AS instance_id, event_type AS type, min(event_id) AS event_id FROM events WHERE event_id % 3 > 0 GROUP BY 1, 2) SELECT instance_id, event_id FROM w JOIN e USING (instance_id, type)"
)
def workflow_consume_events(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.col("user_id").alias("instance_id"), F.to_json(F.struct(F.col("event_type").alias("type"))).alias("payload"), (F.col("event_id") % 3 == 0).cast("int").alias("consumed"))
    waits = e.select("instance_id").distinct().select("instance_id", F.lit("s").alias("name"), F.explode(F.array(F.lit("click"), F.lit("error"))).alias("type"))
    return workflow.consume_events(waits, e.withColumnRenamed("event_id", "id")).select("instance_id", "event_id")


@query("SELECT conv_id, turn, turn % 2 = 0 AS done FROM conversations")
def workflow_replay(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("instance_id"), F.col("turn").cast("string").alias("name"), F.col("role").alias("result"), "turn")
    return workflow.replay(c.where("turn % 2 = 0").select("instance_id", "name", "result"), c.select("instance_id", "name", "turn")).select(F.col("instance_id").alias("conv_id"), "turn", "done")


@query("SELECT event_id FROM events WHERE user_id IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def logs_fresh_subscriptions(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").select("event_id", F.lit("n").alias("namespace"), F.col("user_id").alias("worker"))
    s = table(spark, d, "customer").select(F.lit("n").alias("namespace"), F.col("c_custkey").alias("worker"), F.when(F.col("c_acctbal") > 0, NOW + 1).otherwise(0).alias("expires_ms"))
    return logs.fresh_subscriptions(e, s, NOW).select("event_id")


@query("SELECT event_id, event_type AS level, props AS message FROM events UNION ALL SELECT event_id, 'x', NULL FROM events WHERE event_id % 2 = 0")
def logs_ingest(spark: SparkSession, d: str) -> DataFrame:
    line = F.struct(F.col("event_type").alias("level"), F.col("props").alias("message"))
    wrapped = F.concat(F.lit('{"events":'), F.to_json(F.array(line)), F.lit("}"))
    plain = F.concat(F.lit("["), F.to_json(line), F.lit(',{"level":"x"}]'))
    e = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 2 == 0, plain).otherwise(wrapped).alias("value"))
    return logs.parse_ingest(e).select("event_id", "level", "message")


@query("SELECT event_id, ('0x' || substr(md5(event_id::VARCHAR), 20, 13))::BIGINT::DOUBLE < 0.25 * 4503599627370496 AS sampled FROM events")
def traces_sampled(spark: SparkSession, d: str) -> DataFrame:
    t = F.md5(F.col("event_id").cast("string"))
    return table(spark, d, "events").select("event_id", scalars.trace_sampled(t, F.lit(None).cast("boolean"), 0.25).alias("sampled"))


@query(
    "SELECT event_id, CASE user_id % 3 WHEN 0 THEN 2000 WHEN 1 THEN 2000 * (user_id % 5 + 1) ELSE 2000 * pow(2, user_id % 5) END::BIGINT AS delay_ms, CASE WHEN user_id % 2 = 0 THEN 90000 ELSE 0 END::BIGINT AS text_ms,"
    " CASE event_type WHEN 'click' THEN 'scheduled' WHEN 'view' THEN 'queue' WHEN 'error' THEN 'workflow' ELSE 'fetch' END AS kind FROM events"
)
def functions_workflow(spark: SparkSession, d: str) -> DataFrame:
    how = F.when(F.col("user_id") % 3 == 0, "constant").when(F.col("user_id") % 3 == 1, "linear").otherwise("exponential")
    yes = lambda test: F.when(test, F.lit("x"))
    return table(spark, d, "events").select(
        "event_id", scalars.step_delay_ms(how, F.lit(2), F.col("user_id") % 5).alias("delay_ms"), scalars.text_duration_ms(F.when(F.col("user_id") % 2 == 0, "1.5 minutes").otherwise("soon")).alias("text_ms"),
        scalars.event_kind(yes(~F.col("event_type").isin("click", "view", "error")), yes(F.col("event_type") == "click"), yes(F.col("event_type") == "view"), F.lit("handleRun")).alias("kind"),
    )


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'text/css; charset=utf-8' WHEN 1 THEN 'image/png' ELSE 'application/octet-stream' END AS mime, 'n' AS ns, p_partkey::VARCHAR || '/x' AS id FROM part")
def functions_paths(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    name = F.concat(F.lit("/f"), F.when(F.col("p_partkey") % 3 == 0, ".css").when(F.col("p_partkey") % 3 == 1, ".PNG").otherwise(".zzz"))
    scope = scalars.scope_parts(F.concat(F.lit("n/c/"), F.col("p_partkey"), F.lit("/x")))
    return p.select("p_partkey", scalars.mime_type(name).alias("mime"), scope["ns"].alias("ns"), scope["id"].alias("id"))


_surface("sql_cross_bounded", "SELECT r_name, n.k FROM region CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2) n")
_surface("sql_lateral_values", "SELECT o_orderkey, x.k FROM orders, LATERAL (SELECT o_orderkey % 3 AS k) x WHERE x.k = 1")
_surface("sql_running_frames", "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 6) AS s3, first_value(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS first, CAST(ntile(4) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS q FROM events")
_surface("sql_cube", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
_surface("sql_group_concat", "SELECT n_regionkey, listagg(n_name, ',') WITHIN GROUP (ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey", "SELECT n_regionkey, string_agg(n_name, ',' ORDER BY n_name) AS names FROM nation GROUP BY n_regionkey")
_surface("sql_math_functions", "SELECT p_partkey, abs(p_size - 25) AS a, round(sqrt(p_retailprice), 6) AS s, CAST(floor(p_retailprice / 7) AS BIGINT) AS f, CAST(p_partkey % 7 AS BIGINT) AS m, round(ln(p_retailprice), 6) AS l FROM part")
_surface("sql_dates", "SELECT o_orderkey, CAST(extract(YEAR FROM o_orderdate) AS BIGINT) AS y, CAST(extract(MONTH FROM o_orderdate) AS BIGINT) AS m FROM orders WHERE o_orderdate >= TIMESTAMP '1995-01-01'")

from brindle import registry_more  # noqa: E402, F401  (adds its queries to the two tables above)

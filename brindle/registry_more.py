"""Further queries of the library's operators over the driver's tables, beside those of `registry`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.functions.filters import compile_filter
from brindle.operators import control, kv, lineage, logs, objects, pages, quantised, queue, timers, vector, workflow
from brindle.plans import planners
from brindle.registry import FRAMES, INSTANCES, INVOCATIONS, KV, LIVE, MESSAGES, NOW, SEGMENTS, TIMERS, _COSINE, _Q0, _first_vector, _surface, _timers, CONFIG, epoch_ms, frames, instances, invocations, kv_table, messages, query, segments, vectors
from brindle.sources.tables import table
from brindle.streaming import states

# Key-value tables, queues and timers --------------------------------------------------------------


@query(f"WITH {KV} SELECT key, meta FROM kv WHERE c_custkey % 4 <> 0")
def kv_delete(spark: SparkSession, d: str) -> DataFrame:
    t = kv_table(spark, d)
    return kv.delete(t, t.where(F.col("value").cast("string").cast("long") % 4 == 0).select("key")).select("key", "meta")


@query(f"WITH {KV} SELECT key, expires_ms FROM kv WHERE {LIVE}")
def kv_delete_expired(spark: SparkSession, d: str) -> DataFrame:
    return kv.delete_expired(kv_table(spark, d), NOW).select("key", "expires_ms")


@query(f"WITH {KV} SELECT key, CASE WHEN {LIVE} THEN 'new' ELSE meta END AS meta FROM kv")
def kv_put_if_present(spark: SparkSession, d: str) -> DataFrame:
    t = kv_table(spark, d)
    batch = t.select(F.lit(1).alias("seq"), "key", "value", F.lit("new").alias("meta"), F.lit(0).alias("expires_ms"))
    return kv.put_if(t, batch, NOW, "present").select("key", "meta")


@query(
    "SELECT event_id AS id, CASE WHEN event_id % 11 = 0 THEN 'size' WHEN event_type NOT IN ('json', 'text', 'bytes', 'v8') AND event_id % 3 = 0 THEN 'type' ELSE 'delay' END AS reason"
    " FROM events WHERE event_id % 11 = 0 OR event_id % 3 = 0 OR user_id * 1000 > 86400"
)
def queue_refused(spark: SparkSession, d: str) -> DataFrame:
    body = F.when(F.col("event_id") % 11 == 0, F.repeat(F.lit("x"), F.lit(queue.MOST_BODY_BYTES + 1))).otherwise(F.col("props"))
    kind = F.when(F.col("event_id") % 3 == 0, F.col("event_type")).otherwise("json")
    batch = table(spark, d, "events").select(F.col("event_id").alias("id"), body.alias("body"), kind.alias("content_type"), (F.col("user_id") * 1000).alias("delay_s"))
    return queue.refused(batch).select("id", "reason")


@query(f"WITH {MESSAGES} SELECT id FROM messages WHERE created_ms >= {NOW}")
def queue_purge(spark: SparkSession, d: str) -> DataFrame:
    return queue.purge(messages(spark, d), NOW).select("id")


@query("SELECT event_id AS id FROM events WHERE event_type <> 'error'")
def queue_remove_source(spark: SparkSession, d: str) -> DataFrame:
    return queue.remove_source(table(spark, d, "events").select(F.col("event_id").alias("id"), F.col("event_type").alias("source")), "error").select("id")


@query(f"WITH {MESSAGES} SELECT id, CASE WHEN attempts > 3 THEN 'dead' ELSE 'retry' END AS fate, 7 AS delay_s FROM messages")
def queue_settle_failed(spark: SparkSession, d: str) -> DataFrame:
    return queue.settle_failed(messages(spark, d), 7).select("id", "fate", "delay_s")


_TRIED = f"""{TIMERS}, tried AS (SELECT w.token, attempt + 1 AS attempt, (w.token::BIGINT % 3 <> 0 OR attempt + 1 >= 6) AS ended FROM waiting w WHERE due_at <= {NOW} AND w.token::BIGINT % 2 = 0)"""


def _dispatched(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, retries, fired = _timers(spark, d)
    outcomes = rows.where("event_id % 2 = 0").select("token", (F.col("event_id") % 3 != 0).alias("ok"))
    return timers.dispatch(rows, retries, fired, outcomes, NOW, most_attempts=6)


@query(f"WITH {_TRIED} SELECT token FROM timers WHERE token NOT IN (SELECT token FROM tried WHERE ended)")
def timers_after_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _dispatched(spark, d)[0].select("token")


@query(
    f"WITH {_TRIED} SELECT token, attempt::INT AS attempt, retry_after_ms FROM retries WHERE token NOT IN (SELECT token FROM tried)"
    f" UNION ALL SELECT token, attempt::INT, {NOW} + (least(5 * pow(2, attempt - 1), 300) * 1000)::BIGINT FROM tried WHERE NOT ended"
)
def timers_retries_after_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _dispatched(spark, d)[1]


@query(f"WITH {_TRIED} SELECT token, {NOW + 1}::BIGINT AS expires_ms FROM timers WHERE event_id % 5 = 0 UNION ALL SELECT token, {NOW + 86_400_000}::BIGINT FROM tried WHERE ended")
def timers_fired_after_dispatch(spark: SparkSession, d: str) -> DataFrame:
    return _dispatched(spark, d)[2]


@query("SELECT event_type AS kind, CASE WHEN user_id % 3 = 0 THEN 'ok' ELSE 'error' END AS outcome, count(*) AS n FROM events GROUP BY 1, 2")
def timers_fire_counts(spark: SparkSession, d: str) -> DataFrame:
    outcome = F.when(F.col("user_id") % 3 == 0, "ok").otherwise("error")
    return timers.fire_counts(table(spark, d, "events").select(F.col("event_type").alias("kind"), outcome.alias("outcome")))


@query("SELECT user_id::VARCHAR AS scope, min(epoch_us(ts) // 1000) AS due_ms, arg_min(event_id::VARCHAR, (epoch_us(ts) // 1000, event_id::VARCHAR)) AS token FROM events GROUP BY user_id")
def wake_earliest_by_scope(spark: SparkSession, d: str) -> DataFrame:
    return timers.earliest_by_scope(_timers(spark, d)[0])


# Workflows and lineage ----------------------------------------------------------------------------


@query(
    "WITH o AS (SELECT l_orderkey AS instance_id, l_linenumber AS name, l_quantity::BIGINT % 3 AS attempts, CASE WHEN l_partkey % 5 = 0 THEN NULL ELSE l_partkey % 2 = 0 END AS ok, l_suppkey % 7 <> 0 AS retryable, l_partkey AS result"
    " FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity)),"
    " s AS (SELECT *, CASE WHEN ok IS NULL THEN attempts WHEN ok THEN 0 ELSE attempts + 1 END AS now FROM o)"
    f" SELECT instance_id, name, now AS attempts, CASE WHEN ok IS NULL THEN 'waiting' WHEN ok THEN 'complete' WHEN NOT retryable OR now > 2 THEN 'failed' ELSE 'sleeping' END AS state,"
    f" CASE WHEN NOT ok AND retryable AND now <= 2 THEN {NOW + 1000}::BIGINT END AS wake_ms, CASE WHEN ok THEN result END AS result FROM s"
)
def workflow_settle_steps(spark: SparkSession, d: str) -> DataFrame:
    first = F.min(F.struct("l_partkey", "l_suppkey", "l_quantity")).alias("x")
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(first).select("l_orderkey", "l_linenumber", "x.*")
    key = [F.col("l_orderkey").alias("instance_id"), F.col("l_linenumber").alias("name")]
    steps = li.select(*key, (F.col("l_quantity").cast("long") % 3).alias("attempts"))
    told = li.where("l_partkey % 5 <> 0").select(*key, (F.col("l_partkey") % 2 == 0).alias("ok"), (F.col("l_suppkey") % 7 != 0).alias("retryable"), F.lit(1000).alias("delay_ms"), F.col("l_partkey").alias("result"))
    return workflow.settle_steps(steps, told, NOW, 2)


def _running(spark: SparkSession, d: str) -> DataFrame:
    i = instances(spark, d)
    return i.withColumn("status", F.when(F.col("id") % 2 == 0, "running").otherwise(F.col("status"))).withColumn("lease_until_ms", F.lit(NOW + 1).cast("long")).withColumn("generation", F.col("id") % 3)


_RUNNING = f"{INSTANCES}, running AS (SELECT id, CASE WHEN id % 2 = 0 THEN 'running' ELSE status END AS status, updated_ms, id % 3 AS generation FROM instances)"


@query(f"WITH {_RUNNING}, r AS (SELECT *, status = 'running' AND generation = 1 AS own FROM running) SELECT id, CASE WHEN own THEN 'queued' ELSE status END AS status, CASE WHEN own THEN 0 ELSE {NOW + 1} END AS lease_until_ms, CASE WHEN own THEN id END AS wake_ms FROM r")
def workflow_park(spark: SparkSession, d: str) -> DataFrame:
    rows = _running(spark, d)
    return workflow.park(rows, rows.select("id", F.lit(1).alias("generation"), F.col("id").alias("wake_ms"))).select("id", "status", "lease_until_ms", "wake_ms")


@query(f"WITH {_RUNNING}, r AS (SELECT *, status = 'running' AND generation = 1 AS own FROM running) SELECT id, CASE WHEN own THEN 'errored' ELSE status END AS status, CASE WHEN own THEN {NOW} ELSE updated_ms END AS updated_ms FROM r")
def workflow_finish(spark: SparkSession, d: str) -> DataFrame:
    rows = _running(spark, d)
    return workflow.finish(rows, rows.select("id", F.lit(1).alias("generation"), F.lit("errored").alias("status")), NOW).select("id", "status", "updated_ms")


@query(f"WITH {INSTANCES} SELECT id, created_ms FROM instances WHERE created_ms >= 800000000000 AND created_ms <= 850000000000 ORDER BY created_ms DESC, id DESC LIMIT 40")
def workflow_list_between(spark: SparkSession, d: str) -> DataFrame:
    return workflow.list_page(instances(spark, d), limit=40, from_ms=800000000000, to_ms=850000000000).select("id", "created_ms")


@query(f"WITH {INVOCATIONS} SELECT id FROM invocations WHERE id % 1000 = 2")
def lineage_with_message(spark: SparkSession, d: str) -> DataFrame:
    rows = invocations(spark, d)
    links = rows.select(F.col("id").alias("invocation_id"), F.concat(F.lit("m"), F.col("id") % 1000).alias("message_id"))
    return lineage.with_message(rows, links, "m2").select("id")


# Objects, logs and the catalogue ------------------------------------------------------------------


@query("SELECT event_type AS namespace, user_id % 7 AS worker, NULL AS class, count(*) AS n FROM events GROUP BY 1, 2 UNION ALL SELECT event_type, user_id % 7, user_id % 2, count(*) FROM events GROUP BY 1, 2, 3")
def control_object_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select(F.col("event_type").alias("namespace"), (F.col("user_id") % 7).alias("worker"), (F.col("user_id") % 2).alias("class"))
    return control.object_counts(rows)


@query("SELECT p_partkey AS key FROM part WHERE p_size % 2 = 0 AND p_size % 5 <> 0")
def objects_published(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "part").select(F.col("p_partkey").alias("key"), (F.col("p_size") % 2 == 0).alias("published"), (F.col("p_size") % 5 == 0).alias("deleted"))
    return objects.published(rows).select("key")


@query("SELECT count(DISTINCT l_orderkey) AS n_uploads, count(*) AS n_parts, sum(l_partkey)::BIGINT AS n_bytes FROM lineitem")
def objects_upload_counts(spark: SparkSession, d: str) -> DataFrame:
    return objects.upload_counts(table(spark, d, "lineitem").select(F.concat_ws("/", "l_orderkey", "l_linenumber").alias("key"), F.col("l_partkey").alias("size")))


@query("SELECT p_partkey, substr(p_name, 4, 6) AS part FROM part")
def objects_byte_range(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select("p_partkey", objects.byte_range(F.col("p_name"), 3, 6).alias("part"))


@query("SELECT user_id % 4 AS ns, event_type AS kind, user_id % 2 = 0 AS outcome, count(*) AS n FROM events GROUP BY 1, 2, 3")
def logs_outcome_counts(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "events").select((F.col("user_id") % 4).alias("ns"), F.col("event_type").alias("kind"), (F.col("user_id") % 2 == 0).alias("outcome"))
    return logs.outcome_counts(rows, ["ns"])


@query("SELECT strftime(ts, '%Y-%m-%dT%H:%M') AS minute, count(*) AS n FROM events GROUP BY 1")
def minute_buckets(spark: SparkSession, d: str) -> DataFrame:
    return logs.minute_counts(table(spark, d, "events").select(epoch_ms("ts").alias("at")), "at")


@query("WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) AS n, count(*) OVER (PARTITION BY event_type) AS c FROM events WHERE value IS NOT NULL) SELECT event_type, value AS p95 FROM r WHERE n = floor((c - 1) * 0.95)::BIGINT + 1")
def percentile_nearest_lower(spark: SparkSession, d: str) -> DataFrame:
    return scalars.nearest_lower(table(spark, d, "events"), ["event_type"], "value", 0.95, "p95")


@query("WITH x AS (SELECT user_id, list(DISTINCT event_type) AS l FROM events GROUP BY user_id) SELECT user_id, array_to_string(list_sort(l), ',') AS kinds FROM x")
def sorted_distinct(spark: SparkSession, d: str) -> DataFrame:
    each = table(spark, d, "events").groupBy("user_id", "event_type").count().groupBy("user_id").agg(F.collect_list("event_type").alias("l"))
    return each.select("user_id", F.array_join(scalars.sorted_distinct(F.col("l")), ",").alias("kinds"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN event_type END AS type FROM events")
def guarded_json_type(spark: SparkSession, d: str) -> DataFrame:
    good = F.concat(F.lit('{"type":"'), F.col("event_type"), F.lit('"}'))
    payload = F.when(F.col("event_id") % 3 == 0, good).when(F.col("event_id") % 3 == 1, F.lit('{"type":')).otherwise(F.lit('{"a":1}'))
    return table(spark, d, "events").select("event_id", scalars.json_type(payload).alias("type"))


# Vectors ------------------------------------------------------------------------------------------


@query("SELECT vec_id, len(embedding) AS dimensions, len(embedding) * 4 AS bytes, round(sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x::DOUBLE))), 6) AS length, true AS same FROM embeddings")
def vector_codec(spark: SparkSession, d: str) -> DataFrame:
    rows = vectors(spark, d).select(F.col("id").alias("vec_id"), "values", scalars.vector_from_json(scalars.vector_to_json(F.col("values"))).alias("back"))
    info = rows.select("vec_id", scalars.vector_info(F.col("back")).alias("i"), (F.col("back") == F.col("values")).alias("same"))
    return info.select("vec_id", "i.dimensions", "i.bytes", F.round("i.length", 6).alias("length"), "same")


@query(f"WITH {_Q0} SELECT vec_id, label::VARCHAR AS ns, embedding[1]::DOUBLE AS first, label AS meta, round({_COSINE}, 6) AS score FROM embeddings, q WHERE label NOT IN (1, 2) ORDER BY {_COSINE} DESC, vec_id LIMIT 5")
def vector_with_payload(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d)
    near = vector.query(index, CONFIG, _first_vector(index), 5, where={"label": {"$nin": [1, 2]}})
    full = near.select("id", "score").join(index, "id")
    return full.select(F.col("id").alias("vec_id"), "ns", F.get("values", F.lit(0)).cast("double").alias("first"), F.variant_get("metadata", "$.label", "int").alias("meta"), F.round("score", 6).alias("score"))


@query("SELECT event_id FROM events WHERE (props->>'$.k')::INT < 40 AND (props->>'$.k')::INT > 10 AND (props->>'$.k')::INT <= 35 AND (props->>'$.k')::INT NOT IN (20, 21)")
def metadata_filter_ranges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("m", F.try_parse_json("props"))
    return e.where(compile_filter({"k": {"$lt": 40, "$gt": 10, "$lte": 35, "$nin": [20, 21]}}, F.col("m"))).select("event_id")


@query()
def vector_pq(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d).select("id", "values")
    near = quantised.QuantisedIndex(index, CONFIG).query_many(index.where("id % 50 = 0"), 10)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


@query()
def vector_signs(spark: SparkSession, d: str) -> DataFrame:
    index = vectors(spark, d).select("id", "values")
    near = quantised.QuantisedIndex(index, CONFIG, "sign").query_many(index.where("id % 50 = 0"), 10, rerank=120)
    return near.select("query_id", F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


# Page logs, windows and planners ------------------------------------------------------------------


@query(f"WITH {FRAMES}, r AS (SELECT *, row_number() OVER (PARTITION BY db, page_no ORDER BY seq DESC, data DESC) AS n FROM frames), z AS (SELECT db, arg_max(commit_pages, seq) AS size FROM frames WHERE commit_pages > 0 GROUP BY db) SELECT r.db, page_no, seq FROM r JOIN z ON r.db = z.db WHERE n = 1 AND page_no <= size")
def pages_compact(spark: SparkSession, d: str) -> DataFrame:
    return pages.compact(frames(spark, d).withColumnRenamed("seq", "segment_no"), ["db"]).select("db", "page_no", "seq")


@query("SELECT l_suppkey % 8 AS name, count(*) AS n_pages, count(*) FILTER (l_linenumber > 2) AS n_leaves, count(*) FILTER (l_linenumber = 1) AS n_overflow, coalesce(sum(l_partkey) FILTER (l_linenumber > 2), 0)::BIGINT AS n_cells, count(*) * 4096 AS bytes, sum(l_orderkey % 100)::BIGINT AS unused FROM lineitem GROUP BY 1")
def pages_stats(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("l_linenumber") > 2, "leaf").when(F.col("l_linenumber") == 1, "overflow").otherwise("interior")
    rows = table(spark, d, "lineitem").select((F.col("l_suppkey") % 8).alias("name"), kind.alias("kind"), F.col("l_partkey").alias("n_cells"), F.lit(4096).alias("bytes"), (F.col("l_orderkey") % 100).alias("unused"))
    return pages.page_stats(rows)


_FILES = "files AS (SELECT l_suppkey % 4 AS db, l_orderkey AS segment_no, l_linenumber AS position, l_partkey % 100 AS page_no, 20 + l_partkey % 9 AS size FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) * FROM lineitem ORDER BY l_orderkey, l_linenumber, l_partkey))"


@query(
    f"WITH {_FILES}, p AS (SELECT *, 100 + coalesce(sum(size) OVER (PARTITION BY db, segment_no ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM files),"
    " r AS (SELECT *, row_number() OVER (PARTITION BY db, page_no ORDER BY segment_no DESC, position DESC) AS n FROM p) SELECT db, page_no, segment_no, off::BIGINT AS offset_, size FROM r WHERE n = 1"
)
def pages_index(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min(F.struct("l_partkey", "l_suppkey")).alias("x"))
    rows = li.select((F.col("x.l_suppkey") % 4).alias("db"), F.col("l_orderkey").alias("segment_no"), F.col("l_linenumber").alias("position"), (F.col("x.l_partkey") % 100).alias("page_no"), (20 + F.col("x.l_partkey") % 9).alias("size"))
    return pages.page_index(rows, ["db"], 100).withColumnRenamed("offset", "offset_")


_CHAIN = """seg AS (SELECT o_custkey % 20 AS db, o_orderkey AS lo, o_orderkey + o_custkey % 37 AS hi, o_orderkey % 50 + 1 AS size FROM orders),
  first AS (SELECT db, lo, hi FROM (SELECT *, row_number() OVER (PARTITION BY db ORDER BY hi DESC, lo) AS r FROM seg WHERE size = 1) WHERE r = 1),
  dbs AS (SELECT DISTINCT db FROM seg),
  start AS (SELECT dbs.db, coalesce(hi, 0) AS reach, CASE WHEN hi IS NULL THEN -1 ELSE 0 END AS step, coalesce(lo, 0) AS lo FROM dbs LEFT JOIN first USING (db)),
  chain AS (
    SELECT db, step, lo, reach FROM start
    UNION ALL
    SELECT db, step, lo, hi FROM (
      SELECT c.db, c.step + 1 AS step, s.lo, s.hi, row_number() OVER (PARTITION BY c.db ORDER BY s.hi DESC, s.lo) AS r
      FROM chain c JOIN seg s ON s.db = c.db AND s.size <> 1 AND s.lo <= c.reach + 1 AND s.hi > c.reach) WHERE r = 1),
  last AS (SELECT db, max(reach) AS reach, max(step) AS step FROM chain GROUP BY db)"""


@query(
    f"WITH RECURSIVE {_CHAIN} SELECT chain.db, chain.step, chain.lo AS min_txid, chain.reach AS max_txid,"
    " chain.step = last.step AND EXISTS (SELECT 1 FROM seg s JOIN start ON s.db = start.db WHERE s.db = chain.db AND s.size <> 1 AND s.lo > last.reach + 1 AND s.hi > start.reach) AS gap"
    " FROM chain JOIN last ON chain.db = last.db WHERE chain.step >= 0"
)
def segments_cover_chain(spark: SparkSession, d: str) -> DataFrame:
    s = segments(spark, d).withColumn("is_snapshot", F.col("size") == 1)
    return pages.cover_chain(s.select("db", "is_snapshot", "min_txid", "max_txid"), ["db"])


@query(f"WITH RECURSIVE {SEGMENTS}, o AS (SELECT *, row_number() OVER (PARTITION BY db ORDER BY min_txid) AS r FROM segments),"
       " c AS (SELECT db, min_txid, 0 AS chunk, size AS held, r FROM o WHERE r = 1 UNION ALL SELECT o.db, o.min_txid, CASE WHEN held + o.size > 100 THEN chunk + 1 ELSE chunk END, CASE WHEN held + o.size > 100 THEN o.size ELSE held + o.size END, o.r FROM c JOIN o ON o.db = c.db AND o.r = c.r + 1)"
       " SELECT db, min_txid, chunk FROM c")
def segments_byte_chunks(spark: SparkSession, d: str) -> DataFrame:
    return pages.byte_chunks(segments(spark, d).select("db", "min_txid", "size"), ["db"], "min_txid", "size", 100).select("db", "min_txid", "chunk")


@query("SELECT user_id, (epoch_us(date_trunc('hour', ts)) // 1000) AS hour_ms, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_batch(spark: SparkSession, d: str) -> DataFrame:
    return states.tumbling_counts(table(spark, d, "events"), ["user_id"], "ts", "1 hour").select("user_id", epoch_ms("start_at").alias("hour_ms"), "n")


@query("WITH w AS (SELECT user_id, epoch_us(date_trunc('hour', ts)) // 1000 - k * 3600000 AS start_ms FROM events, (SELECT unnest([0, 1, 2]) AS k)) SELECT user_id, start_ms, count(*) AS n FROM w GROUP BY 1, 2")
def stream_sliding_batch(spark: SparkSession, d: str) -> DataFrame:
    return states.sliding_counts(table(spark, d, "events"), ["user_id"], "ts", "3 hours", "1 hour").select("user_id", epoch_ms("start_at").alias("start_ms"), "n")


@query(
    "WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),"
    " s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g) SELECT user_id, epoch_us(min(ts)) // 1000 AS start_ms, count(*) AS n FROM s GROUP BY user_id, k"
)
def stream_session_batch(spark: SparkSession, d: str) -> DataFrame:
    return states.session_counts(table(spark, d, "events"), ["user_id"], "ts", "6 hours").select("user_id", epoch_ms("start_at").alias("start_ms"), "n")


@query(
    "WITH f AS (SELECT s_suppkey AS path, s_nationkey % 3 AS node, s_suppkey % 97 + 1 AS bytes, s_suppkey % 13 AS mod_ms, s_suppkey % 4 = 0 AS owned FROM supplier), t AS (SELECT *, sum(bytes) OVER (PARTITION BY node) AS total FROM f),"
    " r AS (SELECT *, coalesce(sum(bytes) OVER (PARTITION BY node ORDER BY mod_ms, path ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM t WHERE NOT owned) SELECT node, path, bytes FROM r WHERE total - b > 60"
)
def plan_fleet_evictions(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    files = s.select(F.col("s_suppkey").alias("path"), (F.col("s_nationkey") % 3).alias("node"), (F.col("s_suppkey") % 97 + 1).alias("bytes"), (F.col("s_suppkey") % 13).alias("mod_ms"), (F.col("s_suppkey") % 4 == 0).alias("owned"), F.lit(False).alias("safe"))
    return planners.disk_evictions(files, 60, ["node"])


# The SQL surface ----------------------------------------------------------------------------------

_surface("sql_natural_join", "SELECT o_orderkey, c_name FROM orders NATURAL JOIN (SELECT c_custkey AS o_custkey, c_name FROM customer) c")
_surface("sql_join_using", "SELECT o_orderkey, k, c_name FROM (SELECT o_orderkey, o_custkey AS k FROM orders) o JOIN (SELECT c_custkey AS k, c_name FROM customer) c USING (k)")
_surface("sql_self_join", "SELECT a.n_name AS a, b.n_name AS b FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey")
_surface("sql_theta_join", "SELECT r.r_regionkey, count(*) AS n FROM region r JOIN nation n ON n.n_regionkey > r.r_regionkey GROUP BY r.r_regionkey")
_surface("sql_full_join", "SELECT a.k AS x, b.k AS y FROM (SELECT n_nationkey AS k FROM nation WHERE n_nationkey < 15) a FULL OUTER JOIN (SELECT n_nationkey AS k FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
_surface("sql_join_hints", "SELECT /*+ BROADCAST(n) */ c_custkey, n_name FROM customer JOIN nation n ON c_nationkey = n_nationkey")
_surface("sql_merge_hint", "SELECT /*+ MERGE(c) */ o_orderkey, c_name FROM orders JOIN customer c ON o_custkey = c_custkey")
_surface(
    "sql_ranking_windows",
    "SELECT event_id, round(percent_rank() OVER w, 9) AS pr, round(cume_dist() OVER w, 9) AS cd, nth_value(event_id, 2) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second,"
    " CAST(dense_rank() OVER w AS BIGINT) AS dr, lead(event_id, 2, -1) OVER w AS ahead FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)",
)
_surface("sql_collate", "SELECT n_name FROM nation ORDER BY n_name COLLATE UTF8_LCASE LIMIT 7", "SELECT n_name FROM nation ORDER BY n_name COLLATE NOCASE LIMIT 7")
_surface("sql_total", "SELECT CAST(coalesce(sum(CASE WHEN n_nationkey > 1000 THEN n_nationkey END), 0) AS DOUBLE) AS total_none, CAST(sum(n_nationkey) AS DOUBLE) AS total FROM nation")
_surface(
    "sql_json_extract",
    "SELECT event_id, CAST(get_json_object(props, '$.k') AS BIGINT) AS k, get_json_object(props, '$.missing') AS missing FROM events",
    "SELECT event_id, (props->>'$.k')::BIGINT AS k, props->>'$.missing' AS missing FROM events",
)
_surface(
    "sql_json_group",
    "SELECT n_regionkey, to_json(array_sort(collect_list(n_nationkey))) AS ids FROM nation GROUP BY n_regionkey",
    "SELECT n_regionkey, to_json(list_sort(list(n_nationkey)))::VARCHAR AS ids FROM nation GROUP BY n_regionkey",
)
_surface(
    "sql_julian_days",
    "SELECT o_orderkey, unix_date(CAST(o_orderdate AS DATE)) + 2440587.5D AS julian, date_format(date_add(CAST(o_orderdate AS DATE), 40), 'yyyy-MM-dd') AS later FROM orders",
    "SELECT o_orderkey, (o_orderdate::DATE - DATE '1970-01-01')::DOUBLE + 2440587.5 AS julian, strftime(o_orderdate::DATE + 40, '%Y-%m-%d') AS later FROM orders",
)
_surface("sql_column_filters", "SELECT vec_id FROM (SELECT event_id AS vec_id, user_id % 5 AS label FROM events) vec WHERE label IS NOT NULL AND label IN (1, 3) AND vec_id >= 10 AND vec_id < 500 AND label IS DISTINCT FROM 2")
_surface("sql_like_escape", "SELECT p_partkey FROM part WHERE p_name LIKE '%a_e%' AND NOT p_name LIKE 'b%' AND lower(p_name) LIKE '%e%'")
_surface("sql_integer_division", "SELECT p_partkey, p_size DIV 7 AS d, p_partkey % 5 AS m FROM part", "SELECT p_partkey, p_size // 7 AS d, p_partkey % 5 AS m FROM part")

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import sqltext
from brindle.operators import kv, objects, pages, queue, vector
from brindle.plans import planners
from brindle.plans.surface import Database
from brindle.streaming import states

NOW = 1000


def test_kv_put_and_increment(spark):
    t = spark.createDataFrame([("a", b"5", "m", 0, 0), ("b", b"7", None, 0, 900)], "key string, value binary, meta string, updated_ms long, expires_ms long")
    up = kv.increment(t, spark.createDataFrame([("a", 3), ("b", 1), ("c", 2)], "key string, delta long"), NOW)
    assert {r["key"]: bytes(r["value"]) for r in up.collect()} == {"a": b"8", "b": b"1", "c": b"2"}
    batch = spark.createDataFrame([(1, "a", b"x", None, 5), (2, "a", b"y", None, 0)], "seq int, key string, value binary, meta string, expires_ms long")
    assert {r["key"]: bytes(r["value"]) for r in kv.put(t, batch, NOW).collect()} == {"a": b"y", "b": b"7"}
    assert kv.put_if(t, batch.where("seq = 1"), NOW, "absent").where("key = 'a'").first()["value"] == b"5"
    bad = spark.createDataFrame([("a", b"x", None, 0, 0)], t.schema)
    with pytest.raises(Exception, match="whole number"):
        kv.increment(bad, spark.createDataFrame([("a", 1)], "key string, delta long"), NOW).collect()


def test_vectors(spark):
    rows = spark.createDataFrame([("a", "", [1.0, 0.0]), ("b", "", [1.0, 0.0]), ("c", "x", [0.7071, 0.7071])], "id string, ns string, values array<float>")
    got = vector.query(rows, vector.Config(2), [1.0, 0.0], 3).collect()
    assert [r["id"] for r in got] == ["a", "b", "c"] and got[0]["score"] == pytest.approx(1)
    far = spark.createDataFrame([("near", "", [0.0, 0.0]), ("far", "", [3.0, 4.0])], rows.schema)
    got = vector.query(far, vector.Config(2, "euclidean"), [0.0, 1.0], 2).collect()
    assert [round(r["score"], 6) for r in got] == [1.0, round(18**0.5, 6)]
    assert vector.query(rows.limit(0), vector.Config(2), [1.0, 0.0]).count() == 0
    assert vector.query_by_id(rows, vector.Config(2), "zz").count() == 0
    assert vector.clamp_k(0) == 5 and vector.clamp_k(999) == 100 and vector.clamp_k(999, True) == 50
    with pytest.raises(ValueError):
        vector.Config(2, "dot-product")


def test_ann_recall(spark):
    from brindle.registry import CONFIG, vectors

    index = vectors(spark, "/root/testdata/sf0.001").select("id", "ns", "values")
    lists = vector.InvertedLists(index, CONFIG, cells=8)
    hit = total = 0
    for q in range(5):
        v = [float(x) for x in index.where(F.col("id") == q).first()["values"]]
        want = {r["id"] for r in vector.query(index, CONFIG, v, 10).collect()}
        hit += len(want & {r["id"] for r in lists.query(v, 10, probe=8).collect()})
        total += 10
    assert hit == total  # all cells probed: exact


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_ann_recall_of_the_query_and_the_default(spark, sf):
    import numpy as np

    from brindle import registry

    d = f"/root/testdata/{sf}"
    index = registry.vectors(spark, d).select("id", "ns", "values")
    rows = index.select("id", "values").collect()
    x = np.array([r["values"] for r in rows], float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    ids = np.array([r["id"] for r in rows])
    asked = [k for k, i in enumerate(ids) if i % 50 == 0]
    want = {int(ids[k]): set(ids[np.argsort(-(x @ x[k]), kind="stable")[:10]].tolist()) for k in asked}
    got = {i: set() for i in want}
    for r in registry.QUERIES["vector_ann"](spark, d).collect():
        got[r["query_id"]].add(r["vec_id"])
    assert all(len(v) == 10 for v in got.values())
    assert sum(len(got[i] & want[i]) for i in want) >= 0.9 * 10 * len(want)
    lists = vector.InvertedLists(index, registry.CONFIG)
    one = {i: {r["id"] for r in lists.query(x[list(ids).index(i)].tolist(), 10).collect()} for i in list(want)[:10]}
    assert sum(len(one[i] & want[i]) for i in one) >= 0.9 * 10 * len(one)


def test_queue(spark):
    m = spark.createDataFrame([("a", 0, 0, 0), ("b", 60_000, 0, 0), ("c", 0, 0, 0)], "id string, visible_at_ms long, attempts int, lease_until_ms long")
    claimed = queue.claim(m, NOW, 30_000, 1)
    assert [r["id"] for r in claimed.collect()] == ["a"]
    s = queue.status(queue.after_claim(m, claimed), NOW).first()
    assert (s["depth"], s["visible"], s["leased"], s["max_attempts"]) == (3, 1, 1, 1)
    out = spark.createDataFrame([("a", "ack", 0, 1), ("a", "retry", 2, 2), ("a", "retry", 9, 3)], "id string, action string, delay_s int, seq int")
    r = queue.settle(claimed, out).first()
    assert (r["fate"], r["delay_s"]) == ("retry", 9)
    tired = claimed.withColumn("attempts", F.lit(4))
    assert queue.settle(tired, out).first()["fate"] == "dead"
    assert queue.batch_ready(m.where("id = 'a'"), 100, 2, 5000).first()["ready"] is False
    assert queue.batch_ready(m.where("id = 'a'"), 5000, 2, 5000).first()["ready"] is True
    assert queue.batch_ready(m, 100, 2, 5000).first()["ready"] is True


def test_roll_up(spark):
    o = spark.createDataFrame([(k, 1) for k in ("a/1", "a/2/x", "b/1", "c")], "key string, size long")
    assert [(r["name"], r["is_prefix"]) for r in objects.roll_up(o).collect()] == [("a/", True), ("b/", True), ("c", False)]
    assert [r["name"] for r in objects.roll_up(o, prefix="a/").collect()] == ["a/1", "a/2/"]


def test_usage_is_floored(spark):
    rows = [("b", i, d, d) for i, d in enumerate([-1, 2, -5, 3, -1])]
    got = objects.usage(spark.createDataFrame(rows, "bucket string, seq int, d_objects long, d_bytes long")).orderBy("seq").collect()
    want, have = [], 0
    for r in rows:
        have = max(0, have + r[2])
        want.append(have)
    assert [r["objects"] for r in got] == want


def test_rules(spark):
    paths = spark.createDataFrame([("/a/b",), ("/x",)], "path string")
    rules = spark.createDataFrame([(1, "/a/*", "/z/*", 302), (2, "/a/b", "/no", 301)], "rule_no int, from_path string, to_path string, status int")
    assert objects.redirects(paths, rules).collect() == [("/a/b", 1, "/z/b", 302)]
    heads = spark.createDataFrame([(1, "/*", "X-A", "1"), (2, "/a/*", "x-a", "2")], "rule_no int, pattern string, name string, value string")
    assert sorted(map(tuple, objects.headers(paths, heads).collect())) == [("/a/b", "x-a", "2"), ("/x", "x-a", "1")]
    got = paths.select("path", objects.worker_first(F.col("path"), ["/*", "!/a/*"]).alias("w")).collect()
    assert {r["path"]: r["w"] for r in got} == {"/a/b": False, "/x": True}
    assert paths.where(objects.worker_first(F.col("path"), ["/a"])).count() == 1
    assert objects.parse_redirects("# c\n/a/* /b/* 301\n/x /y nope\nbroken\n") == [(1, "/a/*", "/b/*", 301), (2, "/x", "/y", 302)]
    assert objects.parse_headers("/*\n  X-A: 1\n# c\n/b\n\tY: 2:3\n") == [(1, "/*", "X-A", "1"), (2, "/b", "Y", "2:3")]
    assert spark.range(1).select(objects.condition(F.lit(None).cast("string"), does_not_match=["x"])).first()[0] is True


def test_pages_shrink(spark):
    f = spark.createDataFrame([(1, 1, 1, 3, "a"), (1, 3, 2, 3, "b"), (1, 1, 3, 1, "c"), (1, 2, 4, 3, "d")], "db int, page_no int, seq int, commit_pages int, data string")
    assert sorted(r["page_no"] for r in pages.last_writes(f, ["db"]).collect()) == [1, 2, 3]
    assert sorted(r["page_no"] for r in pages.overlay(f, ["db"]).collect()) == [1, 2]


def test_cover_chain(spark):
    s = spark.createDataFrame([(1, True, 1, 5), (1, False, 4, 8), (1, False, 6, 7), (1, False, 9, 10), (1, False, 12, 13)], "db int, is_snapshot boolean, min_txid long, max_txid long")
    got = pages.cover_chain(s, ["db"]).orderBy("step").collect()
    assert [(r["min_txid"], r["max_txid"]) for r in got] == [(1, 5), (4, 8), (9, 10)] and got[-1]["gap"]


def test_evictions(spark):
    rows = [("new", 100, 5, False, True), ("old", 100, 2, False, False), ("owned-safe", 100, 1, True, True), ("owned", 100, 0, True, False), ("mid", 100, 3, False, False)]
    f = spark.createDataFrame(rows, "path string, bytes long, mod_ms long, owned boolean, safe boolean")
    assert {r["path"] for r in planners.disk_evictions(f, 300).collect()} == {"owned-safe", "old"}
    assert planners.disk_evictions(f, 1).count() == 4 and planners.disk_evictions(f, 0).count() == 0


def test_hot_set(spark):
    h = spark.createDataFrame([("w", "a", 10, True), ("w", "b", 20, True), ("w", "c", 100, False)], "worker string, host string, requests long, incumbent boolean")
    assert sorted(r["host"] for r in planners.hot_set(h, ["worker"], 2, 1).collect()) == ["b", "c"]
    near = spark.createDataFrame([("w", "d", 70, True), ("w", "e", 71, False)], h.schema)
    assert [r["host"] for r in planners.hot_set(near, ["worker"], 1, 1).collect()] == ["d"]


def test_choose_hot():
    pick = lambda rates, before, most, swaps=1: planners.choose_hot(rates, {h for h in rates if rates[h] > 0}, before, most, swaps, 2.0)
    assert pick({"a": 10, "b": 20, "c": 100}, ["a", "b"], 2) == ["b", "c"]
    assert pick({"a": 100, "b": 90, "c": 80, "d": 70, "e": 71}, ["a", "b", "c", "d"], 4) == ["a", "b", "c", "d"]
    assert pick({"a": 5, "b": 4}, [], 3) == ["a", "b"] and pick({"a": 5}, ["y", "z"], 2) == ["a"] and pick({"a": 5}, ["z"], 0) == []


def test_rebalance_and_autoscale(spark):
    nodes = spark.createDataFrame([("s", 10, 1), ("p", 0, 1)], "node string, cells long, weight long")
    idle = spark.createDataFrame([(f"c{k}",) for k in range(10)], "scope string")
    assert [r["scope"] for r in planners.rebalance(nodes, "s", idle, 100).collect()] == ["c0", "c1", "c2", "c3"]
    assert planners.rebalance(nodes, "s", idle.where("scope < 'c3'"), 100).count() == 3
    assert planners.rebalance(nodes, "p", idle, 100).count() == 0 and planners.rebalance(nodes.where("node = 's'"), "s", idle, 100).count() == 0
    leases = spark.createDataFrame([(0, 150, 0, True), (5, 90, 0, False)], "expiry long, owned_cells long, shed_cells long, pressured boolean")
    advice = planners.autoscale(leases, 10, 100, 1)
    assert tuple(advice.first()) == (1, 150, 2, "scale-up")
    assert planners.with_cooldown(advice, "scale-down", 0, 10, 100).first()["action"] == "hold"
    assert planners.with_cooldown(advice, "scale-up", 0, 10, 100).first()["action"] == "scale-up"


def test_token_bucket():
    ok, left, _ = states.admit([0, 0, 0, 1000, 1000], 1.0, 2.0)
    assert ok == [True, True, False, True, False] and left == 0


def test_token_bucket_stream_agrees_with_batch(spark, tmp_path):
    rows = spark.range(60).select(F.lit("n").alias("namespace"), F.col("id").alias("event_id"), (F.col("id") * 300).alias("ts_ms"))
    rows.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    q = states.token_bucket_stream(stream, 1.0, 3.0).writeStream.format("memory").queryName("bucket").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {r["event_id"]: r["admitted"] for r in spark.table("bucket").collect()}
    assert got == {r["event_id"]: r["admitted"] for r in states.token_bucket(rows, 1.0, 3.0).collect()}


def test_database(spark):
    users = spark.createDataFrame([(1, "alice", 30), (2, "bob", 25)], "id long, name string, age int")
    db = Database(spark, {"users": users})
    r = db.all("SELECT * FROM users WHERE age > ?", [26])
    assert r.rows == [[1, "alice", 30]]
    assert db.apply_migration("1", "CREATE TABLE old AS SELECT * FROM users WHERE age > 26;") and not db.apply_migration("1", "CREATE TABLE old AS SELECT * FROM users WHERE age > 26;")
    assert db.all("SELECT count(*) AS n FROM old").rows == [[1]]
    with pytest.raises(sqltext.SqlError):
        db.apply_migration("1", "CREATE TABLE other AS SELECT 1 AS a")
    with pytest.raises(sqltext.SqlError):
        db.query("DROP TABLE users")
    assert sorted(x["statement"] for x in db.dump_rows("users").collect())[0] == "INSERT INTO \"users\" VALUES(1,'alice',30);"


def test_wal(spark, tmp_path):
    import shutil
    import sqlite3

    from brindle.sources.wal import read_wal

    c = sqlite3.connect(tmp_path / "a.db")
    c.execute("PRAGMA journal_mode=WAL")
    c.execute("CREATE TABLE t (x)")
    c.executemany("INSERT INTO t VALUES (?)", [("v" * 500,) for _ in range(40)])
    c.commit()
    (tmp_path / "logs").mkdir()
    shutil.copy(tmp_path / "a.db-wal", tmp_path / "logs" / "a.wal")
    rows = read_wal(spark, str(tmp_path / "logs")).orderBy("frame_no").collect()
    pages_now = c.execute("PRAGMA page_count").fetchone()[0]
    assert rows[-1]["db_size"] == pages_now and {r["page_no"] for r in rows} == set(range(1, pages_now + 1))
    whole = (tmp_path / "logs" / "a.wal").read_bytes()
    (tmp_path / "logs" / "a.wal").write_bytes(whole[:-10] + b"0123456789")
    cut = read_wal(spark, str(tmp_path / "logs")).collect()
    assert len(cut) < len(rows) and (not cut or max(cut, key=lambda r: r["frame_no"])["db_size"] > 0)


def test_control(spark):
    from brindle.operators import control

    jobs = spark.createDataFrame([(1, "pending", 5, 0, 0), (2, "running", 0, 5, 0), (3, "failed", 5, 0, 10), (4, "running", 0, 50, 0)], "id int, state string, next_retry_ms long, lease_until_ms long, attempts int")
    assert sorted(r["id"] for r in jobs.where(control.retryable(10)).collect()) == [1, 2]
    assert [r["id"] for r in control.audit_tail(jobs, 2).collect()] == [3, 4]

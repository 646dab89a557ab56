"""Operators whose rules SQL can't check as a whole: chains over levels, cursors, readers and streams."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from brindle.functions import scalars
from brindle.operators import kv, pages, queue, timers, vector
from brindle.plans.surface import Database
from brindle.sources.tables import ndjson
from brindle.streaming import states


def chain_of(files):
    """The chain by trying every open segment at every step."""
    whole = sorted((f for f in files if f[0] == 9 and f[1] == 1), key=lambda f: -f[2])
    chain, end = whole[:1], whole[0][2] if whole else 0
    rest = [f for f in files if f[0] != 9]
    while True:
        near = [f for f in rest if f[1] <= end + 1 and f[2] > end]
        if not near:
            break
        chain.append(max(near, key=lambda f: (f[2], -f[1], f[0])))
        end = chain[-1][2]
    return chain, any(f[1] > end + 1 for f in rest)


def test_level_chain(spark):
    r = random.Random(8)
    rows = []
    for db in range(60):
        for _ in range(r.randint(1, 14)):
            level = r.choice([0, 0, 1, 2, 9])
            lo = 1 if level == 9 else r.randint(1, 25)
            rows.append((db, level, lo, lo + r.randint(0, 9)))
    got = {}
    df = spark.createDataFrame(rows, "db long, level int, min_txid long, max_txid long")
    for x in pages.level_chain(df, ["db"]).orderBy("db", "step").collect():
        got.setdefault(x["db"], []).append((x["level"], x["min_txid"], x["max_txid"], x["gap"]))
    for db in range(60):
        chain, gap = chain_of([x[1:] for x in rows if x[0] == db])
        assert got.get(db, []) == [(*f, gap and k == len(chain) - 1) for k, f in enumerate(chain)]
    assert pages.level_chain(df.limit(0), ["db"]).count() == 0


def test_uncovered_of_a_hot_key(spark):
    r = random.Random(4)
    segments = [(k % 2, lo, lo + r.randint(0, 6)) for k in range(300) for lo in [r.randint(1, 200)]]
    ranges = [(k % 2, lo, lo + r.randint(0, 12)) for k in range(40) for lo in [r.randint(1, 200)]]
    s = spark.createDataFrame(segments, "db int, min_txid long, max_txid long")
    c = spark.createDataFrame(ranges, "db int, lo long, hi long")
    inside = {db: set() for db in (0, 1)}
    for db, lo, hi in ranges:
        inside[db].update(range(lo, hi + 1))
    want = sorted(x for x in segments if not set(range(x[1], x[2] + 1)) <= inside[x[0]])
    assert sorted(map(tuple, pages.uncovered(s, c, ["db"]).collect())) == want
    assert pages.uncovered(s, c.limit(0), ["db"]).count() == 300


def test_percentile_of_counts(spark):
    r = random.Random(2)
    rows = [(r.choice("abc"), r.choice([None, *range(9)])) for _ in range(200)] + [("none", None)]
    df = spark.createDataFrame(rows, "k string, v int")
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {x["k"]: x["q"] for x in scalars.nearest_lower(df, ["k"], "v", p, "q").collect()}
        for k in ("a", "b", "c"):
            values = sorted(v for g, v in rows if g == k and v is not None)
            assert got[k] == values[int((len(values) - 1) * p)]
        assert got["none"] is None


def test_cursor_of_a_full_page(spark):
    df = spark.createDataFrame([(f"k{n}", 0) for n in range(4)], "key string, expires_ms long")
    assert kv.next_cursor(df.orderBy("key").limit(4), 4) == "k3" and kv.next_cursor(df, 5) is None


def test_queue_limits_and_purge(spark):
    rows = [(1, "x" * (128 << 10), "json", 0, 5), (2, "x" * ((128 << 10) + 1), "json", 0, 9), (3, "x", "html", 0, 9), (4, "x", "v8", 86_401, 9), (5, None, "json", 0, 9), (6, "é" * (64 << 10), "text", 86_400, 9), (7, "x", None, -1, 9)]
    df = spark.createDataFrame(rows, "id long, body string, content_type string, delay_s int, created_ms long")
    assert {x["id"]: x["reason"] for x in queue.refused(df).collect()} == {2: "size", 3: "type", 4: "delay", 5: "size", 7: "type"}
    assert queue.purge(df).count() == 0 and queue.purge(df, 6).count() == 6


def test_fired_marks_end(spark):
    df = spark.createDataFrame([("a", 5), ("b", 6)], "token string, expires_ms long")
    assert [x["token"] for x in timers.prune_fired(df, 5).collect()] == ["b"]


def test_vectors_that_may_not_be_stored(spark):
    rows = [(1, [1.0, 2.0]), (2, [1.0]), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 1.0])]
    df = spark.createDataFrame(rows, "id long, values array<float>")
    assert sorted(x["id"] for x in vector.validate_vectors(df, vector.Config(2)).collect()) == [2, 3, 4, 5]


def test_json_lines(spark, tmp_path):
    path = tmp_path / "v.ndjson"
    path.write_text("\n".join(json.dumps({"id": str(k), "values": [k, 1.5]}) for k in range(3)))
    got = ndjson(spark, str(path), "id string, values array<float>").collect()
    assert sorted((r["id"], list(r["values"])) for r in got) == [(str(k), [float(k), 1.5]) for k in range(3)]


def test_a_script_is_imported_once(spark):
    db = Database(spark, {"t": spark.range(4)})
    assert db.import_script("CREATE TABLE u AS SELECT id * 2 AS d FROM t") and not db.import_script("CREATE TABLE u AS SELECT id * 2 AS d FROM t")
    assert [r["d"] for r in db.query("SELECT d FROM u ORDER BY d").collect()] == [0, 2, 4, 6]


def test_consumer_loop(spark, tmp_path):
    spark.range(20).selectExpr("id", "concat('k', id % 5) AS key", "timestamp_seconds(id) AS at").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id long, key string, at timestamp").parquet(str(tmp_path / "in"))
    seen = []
    handler = lambda batch: batch.select("id", F.when(F.col("id") % 2 == 0, "ack").otherwise("retry").alias("action"), F.lit(0).alias("delay_s"))
    query = states.consume(states.deduplicated(stream, "key", "at"), handler, lambda batch, out: seen.extend((r["id"], r["action"]) for r in out.collect()), str(tmp_path / "ck"))
    assert query.awaitTermination(120)
    assert len(seen) == 5 and all((a == "ack") == (i % 2 == 0) for i, a in seen)


@pytest.mark.parametrize("value", ["[1, 2.5]", "[]", "no", None, '{"a": 1}'])
def test_vector_text(spark, value):
    row = spark.createDataFrame([(value,)], "t string").select(scalars.vector_from_json(F.col("t")).alias("v")).first()
    assert row["v"] == {"[1, 2.5]": [1.0, 2.5], "[]": []}.get(value)

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from brindle.functions import cron, scalars, sqltext
from brindle.functions.filters import FilterError, compile_filter


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("expression", "at", "match"),
    [
        ("0 0 1 * 1", (0, 0, 1, 6, 3), True),
        ("0 0 1 * 1", (0, 0, 8, 6, 1), True),
        ("0 0 1 * 1", (0, 0, 9, 6, 2), False),
        ("*/15 * * * *", (45, 3, 9, 6, 2), True),
        ("5/1 * * * *", (6, 3, 9, 6, 2), False),
        ("5/10 * * * *", (25, 3, 9, 6, 2), True),
        ("* * * * 7", (0, 0, 9, 6, 0), True),
        ("0 0 */2 * 1", (0, 0, 2, 6, 1), True),
    ],
)
def test_cron(expression, at, match):
    assert cron.parse(expression).matches(*at) is match


@pytest.mark.parametrize("bad", ["", "* * * *", "* * * * * *", "60 * * * *", "*/0 * * * *", "0 0 0 * *", "a * * * *", "5-1 * * * *"])
def test_cron_errors(bad):
    with pytest.raises(ValueError):
        cron.parse(bad)


ROWS = [
    (1, '{"platform":"netflix","year":2024,"nested":{"k":true}}'),
    (2, '{"platform":"hbo","year":2023}'),
    (3, '{"platform":"hbo","year":2024,"s":"1","b":true,"n":null}'),
]


@pytest.mark.parametrize(
    ("test", "ids"),
    [
        ({"platform": "hbo"}, [2, 3]),
        ({"platform": {"$ne": "hbo"}}, [1]),
        ({"platform": {"$in": ["hbo", "netflix"]}}, [1, 2, 3]),
        ({"year": {"$gte": 2024}}, [1, 3]),
        ({"platform": {"$gte": "hbo", "$lt": "hbo~"}}, [2, 3]),
        ({"nested.k": True}, [1]),
        ({"platform": "hbo", "year": {"$gt": 2023}}, [3]),
        ({"s": 1}, [3]),
        ({"b": "true"}, [3]),
        ({"b": 1}, [3]),
        ({"year": {"$lt": "3000"}}, []),
        ({"n": None}, [3]),
        ({"missing": None}, []),
        ({"missing": {"$nin": [1]}}, [1, 2, 3]),
        ({}, [1, 2, 3]),
    ],
)
def test_filters(spark, test, ids):
    df = spark.createDataFrame(ROWS, "id int, m string").withColumn("m", F.parse_json("m"))
    assert sorted(r["id"] for r in df.where(compile_filter(test, F.col("m"))).collect()) == ids


@pytest.mark.parametrize("bad", ['{"$bad":1}', '{"k":{"$regex":"x"}}', "[1]", "x", '{"":1}', '{"k":{"$in":1}}', '{"k":{}}'])
def test_bad_filters(bad):
    with pytest.raises(FilterError):
        compile_filter(bad, F.col("m"))


def test_scalars(spark):
    assert one(spark, scalars.fnv1a32(F.lit("hello"))) == 0x4F9F2CAB
    assert one(spark, scalars.fnv1a32(F.lit(""))) == 2166136261
    assert one(spark, scalars.normal_host(F.lit("A.b.:80"))) == "a.b"
    assert one(spark, scalars.truncate_utf8(F.lit("abcdéfgh"), 8)) == "abcd..."
    assert one(spark, scalars.truncate_utf8(F.lit("short"), 8)) == "short"
    assert one(spark, scalars.text_duration_ms(F.lit("10 seconds"))) == 10_000
    assert one(spark, scalars.text_duration_ms(F.lit("1.5h"))) == 5_400_000
    for text, ms in (("nonsense", 0), ("250", 0), ("-5 s", 0), ("250ms", 250), ("2 milliseconds", 120_000), ("1 day", 86_400_000)):
        assert one(spark, scalars.text_duration_ms(F.lit(text))) == ms
    assert one(spark, scalars.content_type(F.lit(" Text/Plain"))) == "text" and one(spark, scalars.content_type(F.lit("V8"))) == "v8"
    assert one(spark, scalars.join_arguments(F.array(F.lit('"a b"'), F.lit('{"k":1}'), F.lit("nope"), F.lit("3")))) == 'a b {"k":1} 3'
    assert one(spark, scalars.truncate_utf8(F.lit("abcdef"), 2)) == "ab"
    assert one(spark, scalars.step_delay_ms(F.lit("exponential"), F.lit(2), F.lit(3))) == 16_000
    assert one(spark, scalars.mime_type(F.lit("/a/b.HTML"))) == "text/html; charset=utf-8"
    assert one(spark, scalars.trace_ids(F.lit("00-" + "0" * 32 + "-00f067aa0ba902b7-01"))) is None
    assert one(spark, scalars.scope_parts(F.lit("a/b/c/d")))["id"] == "c/d"
    assert one(spark, scalars.scope_parts(F.lit("a//c"))) is None
    assert one(spark, scalars.cosine_distance(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 1.0
    assert one(spark, scalars.nearest_lower_percentile(F.array(*[F.lit(x) for x in (4, 1, 3, 2)]), 0.5)) == 2
    assert one(spark, scalars.redact_headers(F.create_map(F.lit("Cookie"), F.lit("x"), F.lit("a"), F.lit("b")))) == {"a": "b"}
    assert scalars.prefix_successor("ab") == "ac"
    assert scalars.prefix_successor("a\U0010ffff") == "b"
    assert scalars.prefix_successor("\U0010ffff") is None


def test_fingerprint(spark):
    import hashlib

    got = one(spark, scalars.message_fingerprint(F.lit(b"hi"), F.lit("text/plain"), F.lit('{"b":1,"a":"<x>"}')))
    assert got == "v1:" + hashlib.sha256(b'["6869","text",{"a":"\\u003cx\\u003e","b":1}]').hexdigest()
    none = one(spark, scalars.message_fingerprint(F.lit(b""), F.lit(""), F.lit(None).cast("string")))
    assert none == "v1:" + hashlib.sha256(b'["","json",null]').hexdigest()


def test_sql_text():
    assert len(sqltext.statements("select ';' ; -- a;b\n select 1 /* ; */;;")) == 2
    assert sqltext.is_read_only("  select 1") and not sqltext.is_read_only("with x as (select 1) select 1")
    assert sqltext.returns_rows("insert into t values (1) returning a")
    for bad in ("", "create temp table x as select 1", "attach 'x' as y", "select 1; select 2", "begin"):
        with pytest.raises(sqltext.SqlError):
            sqltext.validate(bad)
    assert sqltext.literal("a'b") == "'a''b'" and sqltext.literal(b"\x01") == "X'01'" and sqltext.identifier('a"b') == '"a""b"'

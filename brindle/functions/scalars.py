"""Scalar functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine; a zero vector on either side is at distance 1."""
    return F.coalesce(1 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.when(a.isNotNull() & b.isNotNull(), F.lit(1.0)))


def euclidean_distance(a: Column, b: Column) -> Column:
    gap = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.sqrt(F.greatest(F.aggregate(gap, F.lit(0.0), lambda s, x: s + x * x), F.lit(0.0)))


def score(distance: Column, metric: str) -> Column:
    """Cosine: 1 - distance. Euclidean: the distance itself."""
    if metric == "cosine":
        return 1 - distance
    if metric == "euclidean":
        return distance
    raise ValueError(f"metric {metric!r} is not one of cosine, euclidean")


def ttl_live(expires_ms: Column, now_ms: int) -> Column:
    """0 never expires; else strictly later than now."""
    return (expires_ms == 0) | (expires_ms > F.lit(now_ms))


def prefix_successor(prefix: str) -> str | None:
    """The smallest string above all that start with `prefix` in byte order; None if there is none."""
    points = list(prefix)
    while points and ord(points[-1]) == 0x10FFFF:
        points.pop()
    if not points:
        return None
    nxt = ord(points[-1]) + 1
    points[-1] = chr(0xE000 if 0xD800 <= nxt <= 0xDFFF else nxt)
    return "".join(points)


def timer_token(scope: Column, kind: Column, due_ms: Column, occurrence: Column) -> Column:
    """First 32 hexadecimal digits of the SHA-256 of the parts joined by a bar."""
    return F.substring(F.sha2(F.concat_ws("|", scope, kind, due_ms.cast("string"), occurrence), 256), 1, 32)


def content_type(kind: Column) -> Column:
    """Short names of the usual types (json for an empty one); others trimmed and in lower case."""
    k = F.lower(F.trim(F.coalesce(kind, F.lit(""))))
    return F.when(k.isin("", "application/json"), "json").when(k == "text/plain", "text").when(k == "application/octet-stream", "bytes").otherwise(k)


def normal_host(host: Column) -> Column:
    """Lower case, without port and then without one trailing dot."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(host)), r":[0-9]+$", ""), r"\.$", "")


def trace_ids(traceparent: Column) -> Column:
    """struct(trace_id, span_id), or null: version 00, 32 and 16 digits in lower case, two digits of flags; zero ids are invalid."""
    shape = r"^00-([0-9a-f]{32})-([0-9a-f]{16})-[0-9a-fA-F]{2}$"
    t = F.trim(traceparent)
    trace, span = F.regexp_extract(t, shape, 1), F.regexp_extract(t, shape, 2)
    good = t.rlike(shape) & (trace != "0" * 32) & (span != "0" * 16)
    return F.when(good, F.struct(trace.alias("trace_id"), span.alias("span_id")))


def message_fingerprint(body: Column, kind: Column, metadata: Column) -> Column:
    """`v1:` and the SHA-256 of the JSON list of body (hex), short content type and metadata with its keys in order."""
    canonical = F.coalesce(F.to_json(F.parse_json(metadata)), F.lit("null"))
    for plain, escaped in (("<", "\\u003c"), (">", "\\u003e"), ("&", "\\u0026")):
        canonical = F.replace(canonical, F.lit(plain), F.lit(escaped))
    text = F.concat(F.lit('["'), F.lower(F.hex(body)), F.lit('","'), content_type(kind), F.lit('",'), canonical, F.lit("]"))
    return F.concat(F.lit("v1:"), F.sha2(text, 256))


def severity(level: Column) -> Column:
    """Number of a log level: debug 5, warn and warning 13, error 17, others 9."""
    v = F.lower(F.coalesce(level, F.lit("")))
    return F.when(v == "debug", 5).when(v.isin("warn", "warning"), 13).when(v == "error", 17).otherwise(9)


def duration_ms(started: Column, finished: Column) -> Column:
    """finished - started where started is positive and not later; else null."""
    return F.when((started > 0) & (finished >= started), finished - started)


def default_outcome(outcome: Column, status: Column) -> Column:
    """The outcome; without one, from the status: 500 and above is error, else ok."""
    return F.when(F.coalesce(outcome, F.lit("")) != "", outcome).when(status >= 500, F.lit("error")).otherwise(F.lit("ok"))


def truncate_utf8(text: Column, most_bytes: int) -> Column:
    """At most `most_bytes` bytes, whole characters, `...` where something was cut and there is room for it."""
    room = most_bytes - 3 if most_bytes > 3 else max(0, most_bytes)
    pieces = F.split(text, "")
    fits = F.aggregate(
        pieces,
        F.struct(F.lit("").alias("t"), F.lit(0).alias("n")),
        lambda s, c: F.when(
            (s["n"] >= 0) & (s["n"] + F.octet_length(c) <= room), F.struct(F.concat(s["t"], c).alias("t"), (s["n"] + F.octet_length(c)).alias("n"))
        ).otherwise(F.struct(s["t"].alias("t"), F.lit(-1).alias("n"))),
        lambda s: s["t"],
    )
    return F.when(F.octet_length(text) <= most_bytes, text).otherwise(F.concat(fits, F.lit("..." if most_bytes > 3 else "")))


def join_arguments(arguments: Column) -> Column:
    """JSON arguments of a log line, joined by blanks: strings without quotes, others as JSON; broken ones are left out."""
    known = F.filter(arguments, lambda a: F.try_parse_json(a).isNotNull())
    return F.array_join(F.transform(known, lambda a: F.when(F.ltrim(a).startswith('"'), F.get_json_object(a, "$")).otherwise(a)), " ")


_FNV_PRIME, _FNV_START = 16777619, 2166136261


def fnv1a32(text: Column) -> Column:
    """32-bit FNV-1a hash of the UTF-8 bytes, as a long."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    numbers = F.transform(
        F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed) - 1, F.lit(2))).otherwise(F.array().cast("array<int>")),
        lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"),
    )
    return F.aggregate(numbers, F.lit(_FNV_START).cast("long"), lambda h, b: (h.bitwiseXOR(b) * F.lit(_FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)))


def minute_bucket(ms: Column) -> Column:
    """`YYYY-MM-DDTHH:MM` of epoch milliseconds. The session's time zone is to be UTC."""
    return F.date_format(F.timestamp_millis(ms), "yyyy-MM-dd'T'HH:mm")


# Types by file extension.
MIME = {
    "html": "text/html; charset=utf-8",
    "htm": "text/html; charset=utf-8",
    "js": "text/javascript; charset=utf-8",
    "mjs": "text/javascript; charset=utf-8",
    "css": "text/css; charset=utf-8",
    "json": "application/json; charset=utf-8",
    "txt": "text/plain; charset=utf-8",
    "xml": "application/xml",
    "svg": "image/svg+xml",
    "png": "image/png",
    "jpg": "image/jpeg",
    "jpeg": "image/jpeg",
    "gif": "image/gif",
    "webp": "image/webp",
    "avif": "image/avif",
    "ico": "image/x-icon",
    "woff": "font/woff",
    "woff2": "font/woff2",
    "wasm": "application/wasm",
    "map": "application/json",
    "pdf": "application/pdf",
    "mp4": "video/mp4",
    "webm": "video/webm",
}


def mime_type(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in MIME.items() for x in pair])
    return F.coalesce(F.element_at(table, F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def scope_parts(scope: Column) -> Column:
    """struct(ns, class, id) of `ns/class/id`; null unless there are three parts, each with text. The id may hold slashes."""
    parts = F.split(scope, "/", 3)
    whole = (F.size(parts) == 3) & ~F.exists(parts, lambda p: p == "")
    return F.when(whole, F.struct(F.get(parts, F.lit(0)).alias("ns"), F.get(parts, F.lit(1)).alias("class"), F.get(parts, F.lit(2)).alias("id")))


def step_delay_ms(kind: Column, seconds: Column, attempts: Column) -> Column:
    """Delay before the next try: constant d, linear d * (n + 1), exponential d * 2^n."""
    d = seconds * 1000
    grown = F.when(kind == "linear", d * (attempts + 1)).when(kind == "exponential", d * F.pow(F.lit(2.0), attempts)).otherwise(d)
    return grown.cast("long")


def text_duration_ms(text: Column) -> Column:
    """`10 seconds`, `1.5h` as milliseconds; what can't be read, and negatives, are 0.

    The unit is needed. Its first letter decides, but for `ms`: `milliseconds` written out counts as minutes.
    """
    shape = r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(ms|milliseconds?|s|seconds?|m|minutes?|h|hours?|d|days?)$"
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    unit, number = F.regexp_extract(t, shape, 2), F.regexp_extract(t, shape, 1).try_cast("double")
    first = F.substring(unit, 1, 1)
    factor = F.when(unit == "ms", 1).when(first == "s", 1000).when(first == "m", 60_000).when(first == "h", 3_600_000).otherwise(86_400_000)
    return F.when(t.rlike(shape), F.greatest(F.round(number * factor), F.lit(0.0))).otherwise(F.lit(0.0)).cast("long")


def event_kind(url: Column, cron: Column, queue: Column, method: Column) -> Column:
    """fetch, scheduled, queue or workflow, by what an event carries; else empty."""
    by_method = F.when(method == "handleQueue", "queue").when(method == "handleScheduled", "scheduled").when(method == "handleRun", "workflow").otherwise("")
    return F.when(url.isNotNull(), "fetch").when(cron.isNotNull(), "scheduled").when(queue.isNotNull(), "queue").otherwise(by_method)


# Headers that are never shown.
SECRET_HEADERS = ("authorization", "cookie", "proxy-authorization", "x-api-key")


def redact_headers(headers: Column) -> Column:
    """A map of headers without those that carry secrets."""
    return F.map_filter(headers, lambda k, v: ~F.lower(k).isin(*SECRET_HEADERS))


def segment_glob(pattern: str, value: Column) -> Column:
    """`*` matches all, `pre*` a prefix, else exactly; an empty pattern matches nothing."""
    if pattern == "":
        return F.lit(False)
    if pattern == "*":
        return F.lit(True)
    return value.startswith(pattern[:-1]) if pattern.endswith("*") else value == pattern


def nearest_lower(rows: DataFrame, by: list[str], value: str, p: float, name: str) -> DataFrame:
    """Element floor((n - 1) * p) of each group's sorted non-null values, null for a group without any.

    Values are counted first, so a group's rows are never in one place: only its distinct values are put in order.
    """
    counts = rows.groupBy(*by, value).agg(F.when(F.col(value).isNotNull(), F.count("*")).otherwise(0).alias("__n"))
    up = Window.partitionBy(*by).orderBy(F.col(value).asc_nulls_first())
    placed = counts.withColumn("__upto", F.sum("__n").over(up)).withColumn("__all", F.sum("__n").over(Window.partitionBy(*by)))
    at = F.floor((F.col("__all") - 1) * F.lit(p)) + 1
    return placed.groupBy(*by).agg(F.min(F.when((F.col("__upto") >= at) & (F.col("__n") > 0), F.col(value))).alias(name))


def nearest_lower_percentile(values: Column, p: float) -> Column:
    """Element floor((n - 1) * p) of a sorted array of non-null values."""
    ordered = F.array_sort(values)
    return F.when(F.size(ordered) > 0, F.element_at(ordered, (F.floor((F.size(ordered) - 1) * F.lit(p)) + 1).cast("int")))


def trace_sampled(trace_id: Column, parent_sampled: Column, ratio: float) -> Column:
    """The parent's flag if there is one, else the low 52 bits of the trace id under the ratio."""
    low = F.conv(F.right(trace_id, F.lit(13)), 16, 10).cast("double")
    return F.coalesce(parent_sampled, low < F.lit(ratio * float(1 << 52)))


def sorted_distinct(values: Column) -> Column:
    """Distinct elements in order, without nulls."""
    return F.array_sort(F.array_distinct(F.array_compact(values)))


def json_type(payload: Column) -> Column:
    """The text under `type` of a JSON object; null where the payload is no JSON or has none."""
    return F.get_json_object(payload, "$.type")


def vector_from_json(text: Column) -> Column:
    """Components of a JSON array of numbers as floats; null where the text is none."""
    return F.from_json(text, "array<float>")


def vector_to_json(values: Column) -> Column:
    return F.to_json(values)


def vector_info(values: Column) -> Column:
    """dimensions, bytes of the little-endian float32 form, and Euclidean length."""
    square = F.aggregate(values, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    return F.struct(F.size(values).alias("dimensions"), (F.size(values) * 4).alias("bytes"), F.sqrt(square).alias("length"))

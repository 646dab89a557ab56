"""Object listings: columns key, size, etag, last_modified_ms."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.scalars import prefix_successor


def under(objects: DataFrame, prefix: str) -> DataFrame:
    if not prefix:
        return objects
    end = prefix_successor(prefix)
    rows = objects.where(F.col("key") >= prefix)
    return rows if end is None else rows.where(F.col("key") < end)


def list_page(objects: DataFrame, *, prefix: str = "", after: str = "", limit: int = 1000) -> DataFrame:
    rows = under(objects, prefix)
    rows = rows.where(F.col("key") > after) if after else rows
    return rows.orderBy("key").limit(limit)


def roll_up(objects: DataFrame, *, prefix: str = "", delimiter: str = "/", after: str = "", limit: int = 1000) -> DataFrame:
    """Objects and common prefixes together in order of name: name, is_prefix. The limit counts both."""
    rows = under(objects, prefix)
    rows = rows.where(F.col("key") > after) if after else rows
    tail = F.substring(F.col("key"), len(prefix) + 1, 1 << 30)
    at = F.instr(tail, F.lit(delimiter))
    name = F.when(at > 0, F.concat(F.lit(prefix), F.substring(tail, F.lit(1), at + (len(delimiter) - 1)))).otherwise(F.col("key"))
    return rows.select(name.alias("name"), (at > 0).alias("is_prefix")).distinct().orderBy("name", "is_prefix").limit(limit)


def condition(etag: Column, matches: list[str] | None = None, does_not_match: list[str] | None = None, exists: bool | None = None) -> Column:
    """Whether an object, with a null etag if there is none, meets all given conditions. Etags may stand in quotes."""
    bare = lambda tags: [t.strip('"') for t in tags or []]
    test = F.lit(True)
    if matches:
        test = test & F.coalesce(etag.isin(bare(matches)), F.lit(False))
    if does_not_match:
        test = test & ~F.coalesce(etag.isin(bare(does_not_match)), F.lit(False))
    if exists is not None:
        test = test & (etag.isNotNull() if exists else etag.isNull())
    return test


def stats(objects: DataFrame, most: int | None = None) -> DataFrame:
    """n_objects, n_bytes, truncated: over all keys, or over the first `most` of them."""
    if most is None:
        return objects.agg(F.count("*").alias("n_objects"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"), F.lit(False).alias("truncated"))
    first = objects.orderBy("key").limit(most + 1)
    place = F.row_number().over(Window.orderBy("key"))  # at most `most` + 1 rows
    kept = first.withColumn("place", place)
    inside = F.col("place") <= most
    return kept.agg(F.count_if(inside).alias("n_objects"), F.coalesce(F.sum(F.when(inside, F.col("size"))), F.lit(0)).alias("n_bytes"), (F.count("*") > most).alias("truncated"))


def usage(changes: DataFrame) -> DataFrame:
    """Running objects and bytes of each bucket (bucket, seq, d_objects, d_bytes), never below zero.

    With S the running sum, the floored counter is S - min(0, least S so far): two window sums
    instead of a fold.
    """
    w = Window.partitionBy("bucket").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    rows = changes
    for c in ("objects", "bytes"):
        rows = rows.withColumn(f"__{c}", F.sum(f"d_{c}").over(w))
    for c in ("objects", "bytes"):
        rows = rows.withColumn(c, (F.col(f"__{c}") - F.least(F.lit(0), F.min(f"__{c}").over(w))).cast("long"))
    return rows.select("bucket", "seq", "objects", "bytes")


def sweep(objects: DataFrame, referenced: DataFrame, marks: DataFrame, now_ms: int, grace_ms: int) -> tuple[DataFrame, DataFrame]:
    """Mark and sweep: new marks (key, marked_ms) of unreferenced objects, and the keys whose mark has aged enough to delete."""
    loose = objects.join(referenced.select("key"), "key", "left_anti").select("key")
    marked = loose.join(marks.select("key", "marked_ms"), "key", "left").select("key", F.coalesce("marked_ms", F.lit(now_ms)).cast("long").alias("marked_ms"))
    old = F.lit(now_ms) - F.col("marked_ms") >= grace_ms
    return marked.where(~old), marked.where(old).select("key")


def stale_uploads(parts: DataFrame, cutoff_ms: int) -> DataFrame:
    """Uploads (upload_id) whose newest part is older than the cutoff."""
    return parts.groupBy("upload_id").agg(F.max("last_modified_ms").alias("newest_ms"), F.count("*").alias("parts")).where(F.col("newest_ms") < cutoff_ms)


def complete_upload(parts: DataFrame) -> DataFrame:
    """Bytes of each upload: its parts (upload_id, part, data) in order of number, with MD5 and SHA-256."""
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("part", F.hex("data").alias("h")))), lambda p: p["h"]), "")
    joined = parts.groupBy("upload_id").agg(F.unhex(whole).alias("data"))
    return joined.select("upload_id", "data", F.md5("data").alias("md5"), F.sha2("data", 256).alias("sha256"))


def purge(objects: DataFrame, prefix: str, budget: int) -> DataFrame:
    """The next keys of a prefix to delete."""
    return under(objects, prefix).orderBy("key").limit(budget).select("key")


def byte_range(content: Column, offset: int, length: int) -> Column:
    return F.substring(content, offset + 1, length)


MOST_RULES = 2000


def parse_redirects(text: str) -> list[tuple[int, str, str, int]]:
    """Rules (rule_no, from_path, to_path, status) of a file with one rule a line; 302 where no status can be read."""
    rules = []
    for line in text.split("\n"):
        parts = line.split()
        if len(parts) >= 2 and not parts[0].startswith("#"):
            status = int(parts[2]) if len(parts) > 2 and parts[2].isdigit() else 0
            rules.append((len(rules) + 1, parts[0], parts[1], status or 302))
    return rules


def parse_headers(text: str) -> list[tuple[int, str, str, str]]:
    """Rules (rule_no, pattern, name, value) of a file: a pattern, then its headers on indented lines."""
    rules, pattern = [], None
    for line in text.replace("\r\n", "\n").split("\n"):
        if not line.strip() or line.strip().startswith("#"):
            continue
        if not line[0].isspace():
            pattern = line.strip()
        elif pattern is not None and line.find(":") > 0:
            name, _, value = line.partition(":")
            rules.append((len(rules) + 1, pattern, name.strip(), value.strip()))
    return rules


def _few(rules: DataFrame) -> DataFrame:
    """A rule set is a small, hand-written file: its size is checked before it is sent to all."""
    if rules.limit(MOST_RULES + 1).count() > MOST_RULES:
        raise ValueError(f"at most {MOST_RULES} rules")
    return F.broadcast(rules)


def redirects(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """First matching rule of each path. A rule ending in a star matches a prefix; the first star of its target stands for the rest."""
    star = F.col("from_path").endswith("*")
    hit = F.when(star, F.col("path").startswith(F.expr("left(from_path, length(from_path) - 1)"))).otherwise(F.col("path") == F.col("from_path"))
    filled = F.expr("IF(instr(to_path, '*') = 0, to_path, concat(left(to_path, instr(to_path, '*') - 1), substring(path, length(from_path)), substring(to_path, instr(to_path, '*') + 1)))")
    target = F.when(star, filled).otherwise(F.col("to_path"))
    found = paths.select("path").distinct().join(_few(rules), hit).groupBy("path").agg(F.min(F.struct("rule_no", target.alias("target"), "status")).alias("r"))
    return found.select("path", F.col("r.rule_no").alias("rule_no"), F.col("r.target").alias("target"), F.col("r.status").alias("status"))


def headers(paths: DataFrame, rules: DataFrame) -> DataFrame:
    """Headers of each path: all matching rules (rule_no, pattern, name, value) apply, of equal names the last counts.

    `/*` and `*` match all, a pattern ending in `/*` what lies under it, any other the very path.
    """
    pattern = F.col("pattern")
    under_it = pattern.endswith("/*") & F.col("path").startswith(F.expr("left(pattern, length(pattern) - 1)"))
    hit = pattern.isin("/*", "*") | under_it | (F.col("path") == pattern)
    found = paths.select("path").distinct().join(_few(rules), hit)
    return found.groupBy("path", F.lower("name").alias("name")).agg(F.max_by("value", "rule_no").alias("value"))


def worker_first(path: Column, patterns: list[str]) -> Column:
    """Whether patterns send a path to code: a matching `!` pattern says no, else any match says yes. A plain pattern matches what lies under it too."""

    def hit(p: str) -> Column:
        return path.startswith(p[:-1]) if p.endswith("*") else (path == p) | path.startswith(p + "/")

    def some(tests: list[Column]) -> Column:
        return F.coalesce(reduce(lambda a, b: a | b, tests, F.lit(False)), F.lit(False))

    return some([hit(p) for p in patterns if p and not p.startswith("!")]) & ~some([hit(p[1:]) for p in patterns if p.startswith("!")])


def published(objects: DataFrame) -> DataFrame:
    """Objects that listings show: published and not deleted."""
    return objects.where(F.col("published") & ~F.col("deleted"))


def upload_counts(parts: DataFrame) -> DataFrame:
    """Uploads and parts under keys `upload/part`: n_uploads, n_parts, n_bytes."""
    return parts.agg(F.count_distinct(F.split_part("key", F.lit("/"), F.lit(1))).alias("n_uploads"), F.count("*").alias("n_parts"), F.coalesce(F.sum("size"), F.lit(0)).alias("n_bytes"))

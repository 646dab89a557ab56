"""Mix sources to target weights by hash-random order and distributed prefix sums.

Each document gets a pseudo-random key (md5 of seed and id). The key space is cut into equal ranges,
so a source is spread over `RANGES` tasks however large it is; rows are sorted by key within
(source, range), running token sums are taken there, and the sums of the ranges before it are added.
The key at which a source's budget is used up is its cut: whole epochs of the source are taken
first, then one more copy of everything before the cut, and the part of the document on the cut
that still fits. Only ids, keys and sizes are shuffled; texts are not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm._common import checkpoint, n_words, small_or_as_is

SEED = "mix-1"
#: Hex digits of the key that name its range: 16 ** 3 ranges for each source.
RANGE_DIGITS = 3
CYCLE = 3
CAP = 3


def _key(doc_id: Column, seed: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def _sized(docs: DataFrame, seed: str) -> DataFrame:
    return docs.select(
        "doc_id",
        F.col("source").isNull().alias("no_source"),
        F.coalesce("source", F.lit("")).alias("source"),
        n_words(F.col("text")).alias("size"),
        _key(F.col("doc_id"), seed).alias("key"),
    )


def source_targets(sizes: DataFrame) -> DataFrame:
    """Targets of sources. In: no_source, source, source_size. One row a source, so one task is enough.

    The k-th source by code point (null last) weighs (k - 1) mod 3 + 1. Shares of the total are
    limited to three times a source's size and the rest shared anew by weight: the fixed point is
    min(weight * level, cap). In order of cap / weight, the sources before the k-th at their caps leave a level
    for the others that rises up to the first source that isn't capped and falls after it: the largest is right.
    """
    everything = Window.orderBy("no_source", "source")
    total = Window.partitionBy(F.lit(0))
    ranked = sizes.withColumn("weight", ((F.row_number().over(everything) - 1) % CYCLE + 1).cast("long"))
    ranked = ranked.withColumn("cap", F.col("source_size") * CAP)
    before = Window.orderBy(F.col("cap").cast("double") / F.col("weight"), "no_source", "source").rowsBetween(
        Window.unboundedPreceding, -1
    )
    ranked = (
        ranked.withColumn("left_size", F.sum("source_size").over(total) - F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("left_weight", F.sum("weight").over(total) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
        .withColumn("open", F.col("cap") * F.col("left_weight") >= F.col("left_size") * F.col("weight"))
    )
    level = F.max(F.when(F.col("open"), F.struct((F.col("left_size").cast("double") / F.col("left_weight")).alias("level"), "left_size", "left_weight"))).over(total)
    share = F.col("weight") * F.col("at.left_size").cast("double") / F.col("at.left_weight")
    return ranked.withColumn("at", level).select(
        "no_source",
        "source",
        "source_size",
        F.when(F.col("at").isNull() | (F.col("cap") <= share), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def source_cuts(sized: DataFrame) -> DataFrame:
    """One row a source: size, target, whole epochs, and the key group on which its budget ends."""
    place = ["no_source", "source", "span"]
    rows = sized.withColumn("span", F.substring("key", 1, RANGE_DIGITS))
    spans = rows.groupBy(*place).agg(F.sum("size").alias("span_size"))
    spans = spans.withColumn(
        "before_span",
        F.coalesce(F.sum("span_size").over(Window.partitionBy("no_source", "source").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    )
    sources = source_targets(spans.groupBy("no_source", "source").agg(F.sum("span_size").alias("source_size")))
    budget = F.floor("target")
    sources = sources.withColumn("epochs", F.when(F.col("source_size") > 0, F.expr("floor(target) div source_size")).otherwise(F.lit(0))).withColumn(
        "rest", F.when(F.col("source_size") > 0, budget - F.col("epochs") * F.col("source_size")).otherwise(F.lit(0))
    )
    # Only the range that holds the cut needs its rows in order; the others are known from their sums.
    at = spans.join(sources, ["no_source", "source"]).where(
        (F.col("before_span") <= F.col("rest")) & (F.col("rest") < F.col("before_span") + F.col("span_size"))
    )
    inside = Window.partitionBy(*place).orderBy("key")
    ordered = (
        rows.join(at.select(*place, "before_span", "rest"), place)
        .withColumn("through", F.col("before_span") + F.sum("size").over(inside))
        .withColumn("key_size", F.sum("size").over(Window.partitionBy(*place, "key")))
        .where(F.col("through") > F.col("rest"))
    )
    cuts = ordered.groupBy("no_source", "source").agg(
        F.min(F.struct("key", (F.col("rest") - F.col("through") + F.col("key_size")).alias("room"), "key_size")).alias("cut")
    )
    return sources.join(cuts, ["no_source", "source"], "left")


def mix(docs: DataFrame, *, seed: str = SEED) -> DataFrame:
    """Words that the mix takes of every document.

    Out: doc_id, size, source_size, target, taken. Null texts have size 0 and take nothing; a null
    source is a source of its own, sorted last. Rows that repeat an id share a key: where the cut
    falls on them each takes an equal share of what is left. An empty table gives no rows. Other
    columns of `docs` are not looked at.
    """
    sized = checkpoint(_sized(docs, seed))
    cuts = small_or_as_is(source_cuts(sized))
    return sized.join(cuts, ["no_source", "source"]).select("doc_id", "size", "source_size", "target", _taken().alias("taken"))


def _taken() -> Column:
    extra = (
        F.when(F.col("cut").isNull() | (F.col("key") > F.col("cut.key")), F.lit(0))
        .when(F.col("key") < F.col("cut.key"), F.col("size"))
        .otherwise(F.expr("(size * cut.room) div cut.key_size"))
    )
    return (F.col("epochs") * F.col("size") + extra).cast("long")


def repeat_documents(docs: DataFrame, *, seed: str = SEED) -> DataFrame:
    """The mix itself: `docs` with each row as often as the mix takes it.

    A document is never split: the one on a source's cut is taken whole if at least half of it
    fits. Documents without a word cost nothing and stay once. Texts are not shuffled.
    """
    names = docs.columns
    own = [f"__mix_{k}" for k in ("null", "source", "key", "size")]
    rows = docs.select(
        "*",
        F.col("source").isNull().alias(own[0]),
        F.coalesce("source", F.lit("")).alias(own[1]),
        _key(F.col("doc_id"), seed).alias(own[2]),
        n_words(F.col("text")).alias(own[3]),
    )
    cuts = small_or_as_is(source_cuts(checkpoint(_sized(docs, seed)))).select(
        F.col("no_source").alias("__cut_null"), F.col("source").alias("__cut_source"), F.col("epochs").alias("__cut_epochs"), F.col("cut").alias("__cut_at")
    )
    joined = rows.join(cuts, (F.col(own[0]) == F.col("__cut_null")) & (F.col(own[1]) == F.col("__cut_source")))
    at = F.col("__cut_at")
    more = (
        F.when(at.isNull() | (F.col(own[2]) > at["key"]), F.lit(0))
        .when(F.col(own[2]) < at["key"], F.lit(1))
        .otherwise(F.when(at["room"] * 2 >= at["key_size"], F.lit(1)).otherwise(F.lit(0)))
    )
    copies = F.when(F.col(own[3]) == 0, F.lit(1)).otherwise(F.col("__cut_epochs").cast("int") + more)
    return joined.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(1), copies.cast("int")))).select(*[F.col(f"`{n}`") for n in names])


MIX_SQL = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
         md5('mix-1:' || coalesce(doc_id::VARCHAR, '')) AS key
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM d GROUP BY source
), p AS (
  SELECT *, 3 * source_size AS cap,
         sum(source_size) OVER () - coalesce(sum(3 * source_size) OVER w, 0) AS left_size,
         sum(weight) OVER () - coalesce(sum(weight) OVER w, 0) AS left_weight
  FROM s WINDOW w AS (ORDER BY (3 * source_size)::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), l AS (
  SELECT left_size::DOUBLE AS num, left_weight AS den FROM p
  WHERE cap * left_weight >= left_size * weight ORDER BY left_size::DOUBLE / left_weight DESC, left_size DESC, left_weight DESC LIMIT 1
), t AS (
  SELECT source, source_size,
         CASE WHEN num IS NULL OR cap <= weight * num / den THEN cap::DOUBLE ELSE weight * num / den END AS target
  FROM p LEFT JOIN l ON true
), b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target)::BIGINT // source_size ELSE 0 END AS epochs,
         CASE WHEN source_size > 0 THEN floor(target)::BIGINT % source_size ELSE 0 END AS rest
  FROM t
), r AS (
  SELECT d.*, source_size, target, epochs, rest,
         sum(size) OVER (PARTITION BY d.source ORDER BY key) AS through,
         sum(size) OVER (PARTITION BY d.source, key) AS key_size
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
)
SELECT doc_id, size, source_size, target,
       (epochs * size + CASE WHEN through <= rest THEN size
                             WHEN through - key_size >= rest THEN 0
                             ELSE size * (rest - through + key_size) // key_size END)::BIGINT AS taken
FROM r
"""

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of a word, as every contract here defines it.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the cluster's shared folder. Only a local session without one gets a temporary folder: elsewhere executors share none."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="brindle-checkpoint-"))


def checkpoint(df: DataFrame) -> DataFrame:
    """Write `df` to the reliable checkpoint folder and cut its lineage."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


#: Folders of this process's intermediate tables, in order.
_written: list[str] = []


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder that isn't there yet, in the shared one."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Write `df` as Parquet under the shared checkpoint folder and read it back: lineage is cut and sizes are known.

    The table stays until `discard` or `intermediates` deletes it, since the frames made of it are lazy.
    """
    spark = df.sparkSession
    path = new_folder(spark, "stored")
    _written.append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, paths: list[str] | None = None) -> None:
    """Delete folders of intermediate tables, all of this process's if none are named. Frames that read them can't be used again."""
    hadoop, configuration = spark.sparkContext._jvm.org.apache.hadoop.fs.Path, spark.sparkContext._jsc.hadoopConfiguration()
    for path in list(_written) if paths is None else paths:
        folder = hadoop(path)
        folder.getFileSystem(configuration).delete(folder, True)
        if path in _written:
            _written.remove(path)


@contextmanager
def intermediates(spark: SparkSession) -> Iterator[None]:
    """Deletes, at the end, the intermediate tables written inside: for steps whose results are written there."""
    before = len(_written)
    try:
        yield
    finally:
        discard(spark, _written[before:])


def release_shuffles(spark: SparkSession) -> None:
    """Let the driver notice which shuffles nothing refers to any more, so that executors delete their files."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def words(text: Column) -> Column:
    """Words of a text as an array; null and blank texts give an empty array."""
    # A split by one plain character costs half as much as one by a class of them.
    return F.array_remove(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D]", " "), " "), "")


def n_words(text: Column) -> Column:
    """Number of words of a text as a long; null gives 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """All labelled ids, one row (doc_id, label) each.

    Null ids and labels other than 0 and 1 are left out. An id with contradicting labels counts with its larger one.
    """
    kept = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)
    )
    return kept.groupBy("doc_id").agg(F.max("label").alias("label"))


def bounded_labels(
    labels: DataFrame, label: str, *, modulus: int | None, held_out: int | None, per_class: int, positive_first: bool = False
) -> DataFrame:
    """A bounded, reproducible sample of labelled ids: `per_class` of each label value.

    Rows of the held-out fold, null ids and labels other than 0 and 1 are left out. An id with
    contradicting labels counts with its larger one. Order by a hash of the id, so the sample does
    not depend on partitioning.
    """
    kept = known_labels(labels, label)
    if modulus is not None:
        kept = kept.where(fold(F.col("doc_id"), modulus) != held_out)
    rank = F.xxhash64(F.lit("sample"), "doc_id")
    parts = [kept.where(F.col("label") == v).orderBy(rank, "doc_id").limit(per_class) for v in (0, 1)]
    return parts[0].unionByName(parts[1])


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`."""
    return F.crc32(doc_id.cast("string")) % F.lit(modulus)


def in_fold(doc_id: Column, modulus: int, number: int) -> Column:
    """Whether a row's id lies in a fold; false for a row without an id."""
    return F.coalesce(fold(doc_id.cast("long"), modulus) == number, F.lit(False))


def small_or_as_is(df: DataFrame, most_rows: int = 100_000) -> DataFrame:
    """`df` written once and, if it has few rows, marked for broadcast; larger ones are joined by shuffle."""
    df = checkpoint(df)
    return F.broadcast(df) if df.count() <= most_rows else df


def level(sizes: list[int], budget: int) -> int | None:
    """The largest c for which the sum of min(size, c) is within a budget; None if the sizes are."""
    if sum(sizes) <= budget:
        return None
    left = budget
    for k, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - k) > left:
            return left // (len(sizes) - k)
        left -= size
    return None


#: Pieces, evenly spaced, that stand for a text above its share of a sample's bytes.
PIECES = 8


def sample_texts(docs: DataFrame, ids: DataFrame, by: str, most_bytes: int = 64 << 20) -> list:
    """Rows (text, ...) of a bounded sample of ids, on the driver, in order of a hash of the id: every text of the sample has a row.

    `ids` has at most a few thousand rows, by its parameter. Texts come whole if all fit into `most_bytes`. Else the classes
    (values of `by`) share the bytes alike, and so do the texts of a class, and what smaller ones leave goes to larger ones;
    a text above its share comes as `PIECES` evenly spaced pieces of it, about as many bytes as its share in all.
    Rows that share an id count as one, the shortest.
    """
    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *[c for c in ("lang",) if c in docs.columns]).join(
        F.broadcast(ids), "doc_id"
    )
    chosen = chosen.where(F.col("text").isNotNull()).withColumn("bytes", F.octet_length("text"))
    first = F.struct(*[F.col(c).isNull() for c in ("lang",) if c in docs.columns], "bytes", F.xxhash64("text"), *[c for c in ("lang",) if c in docs.columns])
    sizes: dict = {}
    for r in chosen.groupBy("doc_id").agg(F.min_by(F.struct(by, "bytes"), first).alias("one")).select("one.*").collect():
        sizes.setdefault(r[by], []).append(r["bytes"])
    most = level([sum(x) for x in sizes.values()], most_bytes)
    caps = {v: level(x, most) for v, x in sizes.items()} if most is not None else {}
    cap = F.lit(None).cast("long")
    for v, c in caps.items():
        if c is not None:
            cap = F.when(F.col(by).eqNullSafe(F.lit(v)), F.lit(c).cast("long")).otherwise(cap)
    size, of = "length(text)", f"greatest(1, length(text) * share div (bytes * {PIECES}))"
    cut = f"array_join(transform(sequence(0, {PIECES - 1}), i -> substring(text, CAST(1 + i * ({size} - {of}) div {PIECES - 1} AS INT), CAST({of} AS INT))), ' ')"
    kept = chosen.withColumn("share", cap).withColumn("first", first).withColumn("text", F.expr(f"IF(bytes > share, {cut}, text)"))
    others = [c for c in chosen.columns if c not in ("doc_id", "bytes")]
    rows = kept.groupBy("doc_id").agg(F.min_by(F.struct(*others), F.col("first")).alias("one")).select("doc_id", "one.*")
    return rows.orderBy(F.xxhash64(F.lit("order"), "doc_id"), "doc_id").collect()

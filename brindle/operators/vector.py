"""Vector indexes: columns id, ns, values, metadata (VARIANT or JSON text)."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.filters import compile_filter
from brindle.functions.scalars import score

MOST, MOST_WITH_PAYLOAD, USUAL = 100, 50, 5
OVERSAMPLE = 4
#: Share of the cells that an approximate query probes, and queries that go to the rows at once.
PROBE, BLOCK = 0.8, 1024


@dataclass(frozen=True)
class Config:
    """Dimensions and metric of an index; they never change."""

    dimensions: int
    metric: str = "cosine"

    def __post_init__(self) -> None:
        if not 1 <= self.dimensions <= 1536:
            raise ValueError("an index has 1 to 1536 dimensions")
        if self.metric not in ("cosine", "euclidean"):
            raise ValueError(f"metric {self.metric!r} is not one of cosine, euclidean")

    def same_as(self, other: Config) -> None:
        if self != other:
            raise ValueError("the index has another configuration")


def clamp_k(k: int, payload: bool = False) -> int:
    return min(k if k > 0 else USUAL, MOST_WITH_PAYLOAD if payload else MOST)


def distances(values: pa.Array, query: np.ndarray, metric: str) -> pa.Array:
    """Distances of a batch of vectors, in double precision; null where a vector is null, of another length or holds a null.

    A zero vector on either side is at cosine distance 1.
    """
    values = values.combine_chunks() if isinstance(values, pa.ChunkedArray) else values
    sizes = pc.fill_null(pc.list_value_length(values), -1).to_numpy(zero_copy_only=False)
    good = sizes == len(query)
    flat = values.filter(pa.array(good)).flatten() if not good.all() else values.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, len(query))
    if metric == "cosine":
        size = np.sqrt(np.einsum("ij,ij->i", x, x)) * np.sqrt(query @ query)
        found = np.where(size == 0, 1.0, 1 - np.divide(x @ query, size, out=np.zeros(len(x)), where=size != 0))
    else:
        found = np.sqrt(np.einsum("ij,ij->i", x - query, x - query))
    out = np.full(len(sizes), np.nan)
    out[good] = found
    return pa.array(out, mask=np.isnan(out))


def distance(config: Config, values: Column, query: list[float]) -> Column:
    """Distance to one query. Arrow batches go to numpy: array functions run interpreted and take ten times as long."""
    if len(query) != config.dimensions:
        raise ValueError(f"a query has {config.dimensions} components")
    q, metric = np.array(query, dtype=np.float64), config.metric

    @F.arrow_udf("double")
    def to_query(batch: pa.Array) -> pa.Array:
        return distances(batch, q, metric)

    return to_query(values)


def query(
    index: DataFrame,
    config: Config,
    vector: list[float],
    k: int = USUAL,
    *,
    ns: str | None = None,
    where: str | dict | None = None,
    mode: str = "exact",
    values: bool = False,
    metadata: bool = False,
) -> DataFrame:
    """The k nearest: id, score (and values, metadata), best first, ties to the smaller id.

    `exact` filters before it ranks. `compat` ranks 4 k of the namespace and filters those, so it
    may return fewer than k.
    """
    if mode not in ("exact", "compat"):
        raise ValueError("a mode is exact or compat")
    k = clamp_k(k, values or metadata)
    rows = index.where(F.col("ns") == ns) if ns else index
    test = compile_filter(where, F.col("metadata")) if where is not None else None
    if test is not None and mode == "exact":
        rows = rows.where(test)
    kept = ["id", *(["values"] if values else []), *(["metadata"] if metadata or mode == "compat" and test is not None else [])]
    near = rows.select(*kept, distance(config, F.col("values"), vector).alias("distance"))
    first = min(k * OVERSAMPLE, MOST * OVERSAMPLE) if test is not None and mode == "compat" else k
    near = near.where(F.col("distance").isNotNull()).orderBy("distance", "id").limit(first)
    if test is not None and mode == "compat":
        near = near.where(test).orderBy("distance", "id").limit(k)
    shown = [c for c in ("values", "metadata") if (values if c == "values" else metadata)]
    return near.select("id", score(F.col("distance"), config.metric).alias("score"), *shown)


def query_by_id(index: DataFrame, config: Config, id_: object, k: int = USUAL, **options: object) -> DataFrame:
    """As `query`, for a stored vector; a missing id gives no rows. The vector itself is a candidate."""
    found = index.where(F.col("id") == id_).select("values").first()
    if found is None:
        return query(index.limit(0), config, [0.0] * config.dimensions, k, **options)  # type: ignore[arg-type]
    return query(index, config, [float(x) for x in found["values"]], k, **options)  # type: ignore[arg-type]


def get_by_ids(index: DataFrame, ids: list) -> DataFrame:
    """Rows of ids in the order asked for; missing ids are left out. At most 1000."""
    if len(ids) > 1000:
        raise ValueError("at most 1000 ids")
    spark = index.sparkSession
    wanted = spark.createDataFrame(list(enumerate(ids)), ["pos", "id"])
    return index.join(F.broadcast(wanted), "id").orderBy("pos")


def list_ids(index: DataFrame, after: object | None = None, limit: int = 100) -> DataFrame:
    """limit + 1 ids: there is a next page if the last is there."""
    rows = index.where(F.col("id") > after) if after is not None else index
    return rows.select("id").orderBy("id").limit(limit + 1)


def upsert(index: DataFrame, batch: DataFrame, insert_only: bool = False) -> DataFrame:
    """Replaces vectors by id, or with `insert_only` adds only ids that aren't there."""
    names = index.columns
    if insert_only:
        return index.unionByName(batch.join(index.select("id"), "id", "left_anti").select(*names))
    return index.join(batch.select("id"), "id", "left_anti").select(*names).unionByName(batch.select(*names))


def delete_by_ids(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("id"), "id", "left_anti")


def describe(index: DataFrame) -> DataFrame:
    """n_vectors and n_namespaces; the empty namespace counts."""
    return index.agg(F.count("*").alias("n_vectors"), F.count_distinct(F.coalesce("ns", F.lit(""))).alias("n_namespaces"))


def validate_vectors(index: DataFrame, config: Config) -> DataFrame:
    """Rows that may not be stored: of another length, or with null or non-finite components."""
    bad = F.exists("values", lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return index.where((F.size("values") != config.dimensions) | bad)


class InvertedLists:
    """Approximate search: k-means cells, of which the nearest to a query are probed.

    The usual 8 cells, of which a query probes 7, find at least 0.96 of the ten nearest of the test tables. Vectors without
    clusters have their neighbours in many cells, so few probes lose most of them: 1 of 16 finds about 0.3.
    """

    def __init__(self, index: DataFrame, config: Config, cells: int = 8, seed: int = 1, most_training_rows: int = 50_000):
        from pyspark.ml.clustering import KMeans
        from pyspark.ml.functions import array_to_vector

        self.config = config
        vectors = index.withColumn("features", array_to_vector(F.col("values").cast("array<double>")))
        sample = vectors.orderBy(F.xxhash64("id")).limit(most_training_rows)  # cells are fitted on a bounded sample, every row is indexed
        self.model = KMeans(k=cells, seed=seed, maxIter=15, featuresCol="features", predictionCol="cell").fit(sample)
        self.centers = [c.tolist() for c in self.model.clusterCenters()]
        self.rows = self.model.transform(vectors).drop("features")

    def _probes(self, probe: float) -> int:
        return max(1, min(len(self.centers), math.ceil(probe * len(self.centers)) if probe < 1 else int(probe)))

    def query(self, vector: list[float], k: int = USUAL, probe: float = PROBE) -> DataFrame:
        """`probe`: a share of the cells if under 1, else their number; at least one, at most all."""
        order = np.argsort([np.linalg.norm(np.array(c) - np.array(vector)) for c in self.centers])
        return query(self.rows.where(F.col("cell").isin([int(x) for x in order[: self._probes(probe)]])), self.config, vector, k)

    def query_many(self, queries: DataFrame, k: int = USUAL, probe: float = PROBE) -> DataFrame:
        """The k nearest of each query (id, values): query_id, id, score. Queries go to the rows in blocks of `BLOCK`.

        Each task keeps the k nearest of its rows for each query; only those are exchanged. Queries of
        another length, or with nulls, find nothing. Ids are whole numbers.
        """
        k, n = clamp_k(k), self._probes(probe)
        centers, parts, block = np.array(self.centers), [], []
        for r in queries.select(F.col("id").cast("long").alias("id"), "values").where("id IS NOT NULL").toLocalIterator():
            if r["values"] is not None and len(r["values"]) == self.config.dimensions and None not in r["values"]:
                block.append((r["id"], np.array(r["values"], np.float64)))
            if len(block) == BLOCK:
                parts.append(self._nearest(block, centers, k, n))
                block = []
        if block or not parts:
            parts.append(self._nearest(block, centers, k, n))
        near = functools.reduce(DataFrame.unionByName, parts)
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
        near = near.withColumn("place", place).where(F.col("place") <= k)
        return near.select("query_id", "id", score(F.col("distance"), self.config.metric).alias("score"))

    def _nearest(self, block: list[tuple[int, np.ndarray]], centers: np.ndarray, k: int, n: int) -> DataFrame:
        """Rows (query_id, id, distance): of each partition the k nearest to each query of a block."""
        metric, dims = self.config.metric, self.config.dimensions
        ids = np.array([i for i, _ in block], np.int64)
        q = np.array([v for _, v in block]).reshape(-1, dims)
        order = np.argsort(np.linalg.norm(q[:, None] - centers[None], axis=2), axis=1)[:, :n] if len(q) else np.zeros((0, n), int)
        probed = np.zeros((len(q), len(centers)), bool)
        np.put_along_axis(probed, order, True, axis=1)
        given = self.rows.sparkSession.sparkContext.broadcast((ids, q, probed))  # at most BLOCK queries

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids, q, probed = given.value
            best, names = np.full((len(q), 0), np.inf), np.zeros((len(q), 0), np.int64)
            for whole in batches:
                for at in range(0, whole.num_rows, 1024):
                    batch = whole.slice(at, 1024)
                    good = np.array([v is not None and len(v) == dims and None not in v for v in batch.column(1).to_pylist()], bool)
                    batch = batch.filter(pa.array(good))
                    x = np.array(batch.column(1).flatten(), np.float64).reshape(-1, dims)
                    if metric == "cosine":
                        size = np.sqrt(np.einsum("ij,ij->i", q, q))[:, None] * np.sqrt(np.einsum("ij,ij->i", x, x))
                        found = np.where(size == 0, 1.0, 1 - np.divide(np.einsum("ij,kj->ik", q, x), size, out=np.zeros(size.shape), where=size != 0))
                    else:
                        found = np.stack([np.sqrt(np.einsum("ij,ij->i", x - v, x - v)) for v in q]) if len(q) else np.zeros((0, len(x)))
                    found[~probed[:, batch.column(2).to_numpy(zero_copy_only=False)] | np.isnan(found)] = np.inf
                    best = np.concatenate([best, found], axis=1)
                    names = np.concatenate([names, np.broadcast_to(batch.column(0).to_numpy(zero_copy_only=False), found.shape)], axis=1)
                    first = np.lexsort((names, best), axis=1)[:, :k]
                    best, names = np.take_along_axis(best, first, axis=1), np.take_along_axis(names, first, axis=1)
            kept = np.isfinite(best)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.broadcast_to(ids[:, None], kept.shape)[kept]), pa.array(names[kept]), pa.array(best[kept])], names=["query_id", "id", "distance"]
            )

        rows = self.rows.select(F.col("id").cast("long").alias("id"), F.col("values").cast("array<double>").alias("values"), "cell")
        return rows.where("id IS NOT NULL").mapInArrow(run, "query_id long, id long, distance double")

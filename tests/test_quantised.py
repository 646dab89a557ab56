"""Search by quantised codes: recall against brute force at the registered settings, and odd rows."""

from __future__ import annotations

import collections

import numpy as np
import pytest

from brindle import registry
from brindle.operators import quantised
from brindle.operators.vector import Config

D = "/root/testdata/sf0.1"


@pytest.mark.parametrize("name", ["vector_pq", "vector_signs"])
def test_recall(spark, name):
    rows = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids = np.array([r["vec_id"] for r in rows])
    x = quantised.unit(np.array([r["embedding"] for r in rows], np.float64))
    found = collections.defaultdict(set)
    for r in registry.QUERIES[name](spark, D).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = 0
    queries = np.flatnonzero(ids % 50 == 0)
    for q in queries:
        best = ids[np.lexsort((ids, -(x @ x[q])))[:10]]
        hits += len(found[int(ids[q])] & {int(v) for v in best})
    recall = hits / (10 * len(queries))
    print(name, recall, len(queries), len(ids))
    assert recall >= 0.9


def test_odd_vectors(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0]), (5, [float("nan"), 1.0]), (6, [None, 1.0]), (None, [1.0, 0.0]), (7, [0.0, 0.0]), (8, [0.9, 0.1])]
    df = spark.createDataFrame(rows, "id long, values array<float>")
    for kind in ("product", "sign"):
        for metric in ("cosine", "euclidean"):
            index = quantised.QuantisedIndex(df, Config(2, metric), kind, parts=2)
            got = sorted((r["query_id"], r["id"]) for r in index.query_many(df, 2).collect())
            assert {q for q, _ in got} <= {1, 2, 5, 7, 8} and (1, 1) in got and (1, 8) in got
            assert quantised.QuantisedIndex(df.limit(0), Config(2, metric), kind).query_many(df, 2).count() == 0
    with pytest.raises(ValueError):
        quantised.QuantisedIndex(df, Config(2), "other")

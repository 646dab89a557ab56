"""The phases of the exact search."""

from __future__ import annotations

import collections

import numpy as np
import pyarrow as pa
import pytest

from brindle.llm import top_k


def batches(vec, x, size):
    return [
        pa.RecordBatch.from_arrays([pa.array(vec[i : i + size]), pa.array([list(map(int, v)) for v in x[i : i + size]], pa.list_(pa.int64()))], names=["vec_id", "v"])
        for i in range(0, len(vec), size)
    ]


@pytest.mark.parametrize("size", [7, 50, 1000])
def test_local_lists_have_k_scores(size, monkeypatch):
    monkeypatch.setattr(top_k, "QUERIES", 2)
    r = np.random.default_rng(1)
    x = r.integers(-1000, 1000, (60, 8))
    vec = np.arange(60)
    ids = np.array([0, 20, 40, 55])
    for k in (5, 59, 100):
        found = collections.defaultdict(list)
        for b in top_k._local_lists(ids, x[ids], k)(batches(vec, x, size)):
            for q, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                found[q].append(s)
        for q in ids:
            every = sorted((int(x[q] @ x[v]) for v in vec if v != q), reverse=True)
            assert len(found[q]) == min(k, 59) and not collections.Counter(found[q]) - collections.Counter(every)
            if k >= 59:
                assert sorted(found[q], reverse=True) == every


def test_equal_lists_of_both_slices_leave_k(spark):
    """The same entries lead in both slices: the cutoff is still one of k scores, not the least number."""
    vec = np.arange(30)
    x = np.repeat(np.arange(30, 0, -1)[:, None], 4, axis=1)
    found = [s for b in top_k._local_lists(np.array([0]), x[:1], 5)(batches(vec, x, 30)) for s in b.column(1).to_pylist()]
    assert sorted(found, reverse=True) == [int(x[0] @ x[v]) for v in range(1, 6)]


def test_ties_are_cut_in_the_task():
    vec, x = np.r_[100:150, 0:50], np.ones((100, 4), np.int64)
    out = list(top_k._answers(np.array([0]), x[:1], np.array([4]), 10)(batches(vec, x, 16)))
    assert [v for b in out for v in b.column(1).to_pylist()] == list(range(1, 11))


def test_several_passes(spark, monkeypatch):
    r = np.random.default_rng(3)
    rows = [(k, [float(np.float32(v)) for v in r.normal(size=6)]) for k in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    whole = sorted(map(tuple, top_k.top_k(df, every=10).collect()))
    monkeypatch.setattr(top_k, "PASS_BYTES", 500)
    assert sorted(map(tuple, top_k.top_k(df, every=10).collect())) == whole and len(whole) == 400


def test_scores_beyond_62_bits_are_refused():
    big = np.array([[2**31, 2**31]])
    with pytest.raises(OverflowError):
        top_k._products(big, big)

"""Near duplicates with repeated and missing ids, other widths and small tasks, against brute force."""

from __future__ import annotations

import numpy as np
import pytest

from brindle.llm import near_dup


def shingles(text, width):
    w = tuple((text or "").split())
    return {w[i : i + width] for i in range(len(w) - width + 1)} if len(w) >= width else {w} if w else set()


def brute(rows, width):
    """Component of each id: nodes are ids, linked if any of their texts are."""
    known = [(d, shingles(t, width)) for d, t in rows if d is not None]
    parent = {d: d for d, _ in known}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (a, x) in enumerate(known):
        for b, y in known[k + 1 :]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                p, q = find(a), find(b)
                parent[max(p, q)] = min(p, q)
    return {d: find(d) for d in parent}


def variants(seed, groups, each, words=60, most=4):
    r = np.random.default_rng(seed)
    out = []
    for g in range(groups):
        for k in range(each):
            w = [f"g{g}t{j}" for j in range(words)]
            for j in r.choice(words, int(r.integers(0, most)), replace=False):
                w[j] = f"n{g}-{k}-{j}"
            out.append(" ".join(w))
    return out


def check(spark, rows, width):
    df = spark.createDataFrame([(d, t, d) for d, t in rows], "doc_id long, text string, rep long")
    want = brute(rows, width)
    got = near_dup.near_duplicates(df, shingle=width).collect()
    assert len(got) == len(rows)
    assert sorted((r["doc_id"] is None, r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((False, d, len(shingles(t, width))) for d, t in rows if d is not None)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert r["component_id"] == want[r["doc_id"]] and r["kept"] == (r["doc_id"] == r["component_id"])
    kept = sorted(map(str, near_dup.keep_one(df, shingle=width).collect()))
    assert kept == sorted(map(str, (r for r in df.collect() if r["doc_id"] is None or want[r["doc_id"]] == r["doc_id"])))


@pytest.mark.parametrize("width", [4, 5])
def test_repeated_and_missing_ids(spark, width):
    texts = variants(1, 6, 8)
    rows = [(100 + k, t) for k, t in enumerate(texts)]
    # One id on texts of two groups joins them; one on a text of a group and one of its own; ids on a text each twice; rows without id.
    rows += [(7, texts[0]), (7, texts[9]), (300, texts[17]), (300, "a text of its own that nothing else is like at all"), (301, texts[20]), (301, texts[20])]
    rows += [(None, texts[3]), (None, None), (None, texts[3]), (302, None), (302, texts[40]), (303, ""), (304, "one two"), (305, "one two")]
    check(spark, rows, width)


def test_small_blocks_and_tasks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK", 300)
    monkeypatch.setattr(near_dup, "TASK", 500)
    monkeypatch.setattr(near_dup, "PAIRS", 3)
    check(spark, [(k, t) for k, t in enumerate(variants(5, 3, 14, 50, 7))], 4)

"""The likelihood ratio of the quality rules reads whole words."""

from __future__ import annotations

from brindle.llm import quality_rules


def test_words_with_equal_endings_differ(spark):
    good = " ".join(f"fine{k}abc" for k in range(30))
    bad = " ".join(f"junk{k}abc" for k in range(30))
    docs = spark.createDataFrame([(1, good), (2, bad)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r["llr"] for r in quality_rules.quality(docs, labels).collect()}
    assert got[1] > got[2] + 0.1

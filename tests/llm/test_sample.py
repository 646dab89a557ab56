"""The bytes of a training sample, shared between classes and texts."""

from __future__ import annotations

from brindle.llm import _common


def test_level():
    assert _common.level([3, 4], 7) is None and _common.level([1, 10, 10], 9) == 4 and _common.level([100], 8) == 8


def test_long_texts_remove_no_others(spark):
    rows = [(k, f"short text {k}", "en") for k in range(40)] + [(100 + k, "abcdefgh " * 40_000, "de") for k in range(6)] + [(200, "ein kurzer Text", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r["doc_id"]: r for r in _common.sample_texts(docs, docs.select("doc_id"), "lang", 60_000)}
    assert set(got) == {r[0] for r in rows}
    assert all(got[i]["text"] == text for i, text, _ in rows if i < 100 or i == 200)
    assert all(5_000 < len(got[100 + k]["text"]) < 10_100 for k in range(6)) and sum(len(r["text"]) for r in got.values()) < 60_100
    one = docs.where("doc_id = 100")
    assert len(_common.sample_texts(one, one.select("doc_id"), "lang", 1_000)) == 1
    assert [r["text"] for r in _common.sample_texts(docs, docs.select("doc_id"), "lang", 1 << 30) if r["doc_id"] == 100] == ["abcdefgh " * 40_000]

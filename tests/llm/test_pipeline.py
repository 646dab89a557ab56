"""The pipeline over odd rows and empty tables, and what it leaves behind."""

from __future__ import annotations

import os

import pytest

import corpus_pipeline
from brindle.llm import _common

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def folder(spark, path, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(r[0], 1, 0) for r in rows[:3]], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_odd_rows_and_what_is_left(spark, tmp_path):
    long = " ".join(f"w{k % 977}x{k // 977}" for k in range(30_000))
    text = " ".join(f"plain{k} words" for k in range(30))
    rows = [(k, f"{text} number {k} " + " ".join(f"own{k}-{j}" for j in range(40)), "en", "ab"[k % 2], 0) for k in range(10)]
    rows += [(20, None, None, None, None), (21, "", "en", "a", 0), (22, long, "en", None, 1), (22, long, "en", None, 1), (None, text + " no id", "en", "b", 5), (23, text, "en", "b", 5), (24, text, "en", "b", 5)]
    path = folder(spark, tmp_path / "odd", rows)
    before = set(os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:"))) if spark.sparkContext.getCheckpointDir() else set()
    got = corpus_pipeline.run(spark, path).collect()
    assert got and all(r["round_trip"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
    ids = {r["doc_id"] for r in got}
    assert not ids & {20, 21, 24} and None in ids | {None}
    left = {f for f in os.listdir(spark.sparkContext.getCheckpointDir().removeprefix("file:")) if f.startswith(("stored-", "pipeline-"))} - before
    assert [f.split("-")[1] for f in left] == ["mixing"]


def test_empty_tables(spark, tmp_path):
    assert corpus_pipeline.run(spark, folder(spark, tmp_path / "none", [])).count() == 0


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Conf:
        def get(self, name, default):
            return default

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(RuntimeError):
        _common.ensure_checkpoint_dir(Session())

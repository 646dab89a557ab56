"""Every label counts for the quality rules, however many there are."""

from __future__ import annotations

import math

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from brindle.llm import quality_rules

N = 28_000


def labelled(spark, good=N, bad=N):
    """Ids from 0: first the good ones, then the bad ones."""
    return spark.range(good + bad).select(F.col("id").alias("doc_id"), (F.col("id") < good).cast("int").alias("quality"), F.lit(0).alias("toxic"))


def test_all_labels_are_trusted_or_judge(spark):
    trusted, judges = (x.collect() for x in quality_rules.labelled_ids(labelled(spark)))
    ids, by = {r["doc_id"] for r in trusted}, {r["doc_id"]: r["label"] for r in judges}
    assert len(trusted) == len(ids) == N - N // 4 and max(ids) < N
    assert len(judges) == len(by) and not ids & set(by)
    assert sum(by.values()) == N // 4 and sum(v == 0 for v in by.values()) == N // 4 and all((d < N) == bool(v) for d, v in by.items())


def test_target_counts_all_trusted(spark):
    docs = spark.range(2 * N).select(F.col("id").alias("doc_id"), F.when(F.col("id") < N, "fine").otherwise("junk").alias("text"))
    got = {r["text"]: r["weight"] for r in ratios(spark, docs, quality_rules.labelled_ids(labelled(spark))[0], ["fine", "junk"])}
    whole, target = quality_rules.BUCKETS, N - N // 4
    assert got["fine"] == pytest.approx(math.log((target + 1) / (target + whole)) - math.log((N + 1) / (2 * N + whole)), abs=1e-12)
    assert got["junk"] == pytest.approx(math.log(1 / (target + whole)) - math.log((N + 1) / (2 * N + whole)), abs=1e-12)


def ratios(spark, docs, trusted, words):
    weights = quality_rules.log_ratios(docs, trusted)
    of = spark.createDataFrame([(w,) for w in words], "text string").crossJoin(weights)
    return of.select("text", F.expr(f"weights[CAST(xxhash64(text) & {quality_rules.BUCKETS - 1} AS INT)]").alias("weight")).collect()


@pytest.mark.parametrize("filter_, mistaken", [(1 << 20, 100_000), (2, 100_000), (2, 3)])
def test_flags_are_exact(spark, monkeypatch, filter_, mistaken):
    """By the filter alone, by a filter full of mistakes, and by an exchange of texts."""
    monkeypatch.setattr(quality_rules, "FILTER", filter_)
    monkeypatch.setattr(quality_rules, "MISTAKEN", mistaken)
    ids = [*range(300), *range(50), None, None, -7, 1 << 62]
    docs = spark.createDataFrame([(d, f"{d} {k}") for k, d in enumerate(ids)], "doc_id long, text string")
    good = {*range(0, 300, 3), 1 << 62, 999}
    got = quality_rules._flagged(docs, spark.createDataFrame([(d,) for d in good], "doc_id long")).collect()
    assert sorted((r["text"], r["__q_good"]) for r in got if r["__q_good"]) == sorted((f"{d} {k}", 1) for k, d in enumerate(ids) if d in good)
    assert sorted(r["text"] for r in got) == sorted(f"{d} {k}" for k, d in enumerate(ids))


@pytest.mark.parametrize("n, size", [(0, 1), (2, 1), (3, 2), (50_000, 1 << 15), (1 << 21, 1 << 20), (6_200_000, 1 << 20)])
def test_size_of_the_filter(n, size):
    assert quality_rules._filter_size(n) == size


def test_what_the_driver_gets_of_few_trusted(spark, monkeypatch):
    """The driver copies the filter for every stage that tests it: it is small for few ids, and no other stage tests it."""
    filters, written, released = [], [], []
    checkpoint, stored, release = quality_rules.checkpoint, quality_rules.stored, quality_rules.release_shuffles
    monkeypatch.setattr(quality_rules, "checkpoint", lambda df: filters.append(checkpoint(df)) or filters[-1])
    monkeypatch.setattr(quality_rules, "stored", lambda df: written.append(df._jdf.queryExecution().optimizedPlan().toString()) or stored(df))
    monkeypatch.setattr(quality_rules, "release_shuffles", lambda s: released.append(1) or release(s))
    docs = spark.range(1000).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    weights = quality_rules.log_ratios(docs, spark.range(0, 1000, 5).select(F.col("id").alias("doc_id")))
    assert filters[0].select(F.size("all")).first()[0] == 128
    assert weights.select(F.size("weights")).first()[0] == quality_rules.BUCKETS
    # The filter is tested on the documents only, not also on the trusted ids that they are joined with.
    assert [plan.count("scalar-subquery") for plan in written] == [1, 0]
    assert len(released) == 2


def test_threshold_by_parts(spark, monkeypatch):
    """As by a plain loop over all ratios: many judges, equal ratios, and far ones that leave most parts empty."""
    rows = [(k, (k * 7919 % 1000) / 997 - (1e4 if k == 5 else 0), 1 if (k * 31 % 100) < 20 + k * 7919 % 1000 / 15 else 0) for k in range(3000)]
    rated = spark.createDataFrame([(d, x, 30) for d, x, _ in rows] + [(9999, 5.0, 30)], "doc_id long, __q_llr double, __q_n_words long")
    judges = spark.createDataFrame([(d, v) for d, _, v in rows], "doc_id long, label int")
    n_good, n_bad = (sum(v == w for _, _, v in rows) for w in (1, 0))
    merit = lambda t: 2 * sum(x >= t and v for _, x, v in rows) * n_bad + sum(x < t and not v for _, x, v in rows) * n_good
    every = sorted({x for _, x, _ in rows})
    best = max(every, key=lambda t: (merit(t), -t))
    below = [x for x in every if x < best]
    for parts in (1, 16, 4096):
        monkeypatch.setattr(quality_rules, "PARTS", parts)
        assert quality_rules.threshold(rated, judges) == ((best + below[-1]) / 2 if below else best)


def test_pipeline_judges_by_labels_beyond_20000(spark, tmp_path):
    """The only good documents are those whose labels a sample of 20,000 by hash leaves out; without them junk would pass."""
    ranked = spark.range(N).orderBy(F.xxhash64(F.lit("sample"), "id"), "id").collect()
    good = [r["id"] for r in ranked[20_000:20_400]]
    bad = list(range(N, N + 400))
    text = lambda d, kind: " ".join(f"{kind}{(d * 31 + k) % 97}" for k in range(25))
    docs = spark.createDataFrame([(d, text(d, "fine")) for d in good] + [(d, text(d, "junk")) for d in bad], "doc_id long, text string")
    labelled(spark, bad=400).write.parquet(str(tmp_path / "labels.parquet"))
    name, stage = corpus_pipeline.STAGES[0]
    assert name == "quality_rules"
    kept = stage(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {tuple(r) for r in kept.collect()} == {(d, text(d, "fine")) for d in good}

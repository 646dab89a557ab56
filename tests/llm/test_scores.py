"""Scores of the classifiers, worked out again by plain loops from the trained parameters."""

from __future__ import annotations

import collections
import itertools
import math

import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from brindle.llm import _kernel, compression, lang_id, toxicity

D = "/root/testdata/sf0.001"
ODD = ["", None, "one", "Ünïcode 日本 x", "...", "a-b (c) d!", "12345 !!!", "word " * 3000]


@pytest.fixture(scope="module")
def docs(spark):
    few = spark.read.parquet(f"{D}/documents.parquet")
    odd = spark.createDataFrame([(10**6 + k, t, "en", "z", 0) for k, t in enumerate(ODD)] + [(None, "text of no id", "en", "z", 0)], few.schema)
    return few.unionByName(odd)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{D}/labels.parquet")


def test_compression_scores(docs, labels):
    m = compression.train(docs, labels)

    def size(dictionary, data):
        kind = zstandard.DICT_TYPE_FULLDICT if dictionary[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        shared = zstandard.ZstdCompressionDict(dictionary, dict_type=kind)
        total = 0
        for i in range(0, len(data), 2048):
            total += len(zstandard.ZstdCompressor(level=3, dict_data=shared, write_checksum=False, write_content_size=False).compress(data[i : i + 2048]))
        return total

    for r in compression.score_quality(docs, labels).join(docs.select("doc_id", "text"), "doc_id").limit(80).collect():
        data = (r["text"] or "").encode()
        x = (size(m.bad, data) - size(m.good, data)) / len(data) if data else 0.0
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-max(-60, min(60, m.slope * x + m.offset)))), abs=1e-12)


def toxic_score(m, text):
    rows, filters, out, bias = m["network"]
    data = np.frombuffer((text or "").encode(), np.uint8)
    first, second, _ = toxicity.hashed(data, np.array([0, len(data)]))
    x = [rows[0][a].astype(float) + rows[1][b] for a, b in zip(first, second)]
    z, column = float(bias), 0
    for width, f in filters.items():
        for k in range(f.shape[2]):
            best = 0.0
            for i in range(len(x)):
                best = max(best, sum(float(x[i + o] @ f[o][:, k]) for o in range(width) if i + o < len(x)))
            z += best * float(out[column])
            column += 1
    group = -1
    if len(first) and len(m["table"]):
        group = int(np.argmax([sum(float(t[a % toxicity.LANG_ROWS]) for a in first) for t in m["table"]]))
    return 1 / (1 + math.exp(-max(-60, min(60, m["slope"] * z + m["offsets"][group]))))


def test_toxicity_scores(docs, labels):
    m = toxicity.train(docs, labels)
    some = docs.where("length(text) < 2500 OR text IS NULL OR doc_id >= 1000000")
    got = toxicity.score_toxicity(docs, labels).join(some.select("doc_id", "text"), "doc_id").limit(60).collect()
    for r in got:
        assert r["score"] == pytest.approx(toxic_score(m, r["text"]), abs=1e-5)


def test_first_tops():
    r = np.random.default_rng(1)
    values, ends = r.integers(0, 4, (40, 5)).astype(float), np.array([1, 9, 20, 40])
    want = [[a + int(values[a:b, k].argmax()) for k in range(5)] for a, b in zip([0, *ends[:-1]], ends)]
    assert toxicity._first_tops(values, ends).tolist() == want


def sequences_of(text):
    """The two- and three-byte sequences of lower-cased letters, of which a blank is no part at the end of three or twice in two."""
    clean = [b if 97 <= b <= 122 or b >= 128 else 32 for b in (text or "").lower().encode()]
    out = collections.Counter()
    for i in range(1, len(clean)):
        a, b = clean[i - 1], clean[i]
        if (a, b) != (32, 32):
            out[(a * 257 + b) * 2654435761 % 2**32 >> 20] += 1
        if i > 1 and a != 32:
            out[(((clean[i - 2] * 257 + a) * 263 + b) * 2246822519 + 97) % 2**32 >> 20] += 1
    return out


def test_language_votes(docs):
    m = lang_id.train(docs)
    names, families = m["names"], m["families"]
    sure = lambda x: 1 / (1 + math.exp(-max(-40, min(40, 3 * x))))
    for r in lang_id.identify(docs).join(docs.select("doc_id", "text"), "doc_id").collect():
        if r["text"] is None or not any(c.isalpha() for c in r["text"]):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        found = sequences_of(r["text"])
        n = max(1, sum(found.values()))
        margins = [sum(c * float(w[b]) for b, c in found.items()) / n + o for w, o in zip(m["weights"], m["offsets"])]
        best = max(range(len(families)), key=lambda k: margins[k])
        own = [k for k, x in enumerate(names) if lang_id.family(x) == families[best]]
        votes, least = collections.Counter({k: 0.0 for k in own}), dict.fromkeys(own, 1.0)
        for k, (a, b) in enumerate(m["pairs"]):
            if a in least:
                p = sure(margins[len(families) + k])
                votes[a if p >= 0.5 else b] += 1
                votes[a] += p * 1e-3
                votes[b] += (1 - p) * 1e-3
                least[a], least[b] = min(least[a], p), min(least[b], 1 - p)
        pick = max(own, key=lambda k: votes[k])
        if min(abs(x) for x in margins) > 1e-4:
            assert r["lang_pred"] == names[pick]
        assert r["score"] == pytest.approx(sure(margins[best]) * least[names.index(r["lang_pred"])], abs=1e-4)
    assert all(a < b for a, b in m["pairs"]) and len(m["pairs"]) == sum(1 for a, b in itertools.combinations(names, 2) if lang_id.family(a) == lang_id.family(b))


@pytest.mark.parametrize("operator", [compression.score_quality, toxicity.score_toxicity])
def test_scores_are_blind_to_other_columns(docs, labels, operator):
    blind = docs.withColumn("lang", F.lit(None).cast("string")).withColumn("source", F.lit("z")).repartition(3)
    want = {r["doc_id"]: r["score"] for r in operator(docs, labels).collect()}
    assert {r["doc_id"]: r["score"] for r in operator(blind, labels).collect()} == pytest.approx(want, abs=2e-6)


def test_no_id_is_in_no_fold(docs, labels):
    for df in (compression.score_quality(docs, labels), toxicity.score_toxicity(docs, labels), lang_id.identify(docs)):
        assert [r["held_out"] for r in df.where("doc_id IS NULL").collect()] == [False]


def test_groups_of_texts_are_languages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("length(text) > 200").limit(600).collect()
    texts = []
    for r in docs:
        data = np.frombuffer(r["text"].encode(), np.uint8)
        texts.append(toxicity.hashed(data, np.array([0, len(data)]))[0])
    table = toxicity._language_table(texts)
    found = collections.defaultdict(collections.Counter)
    for r, t in zip(docs, texts):
        found[int(toxicity._guess(t, np.array([0, len(t)]), table)[0])][r["lang"]] += 1
    assert sum(max(c.values()) for c in found.values()) > 0.9 * len(docs) and len(table) <= toxicity.LANGUAGES
    assert toxicity._language_table([]).shape == (0, toxicity.LANG_ROWS) and _kernel is not None

"""Quality classifier by compression.

Two zstandard dictionaries are trained, on good and on bad labelled texts. A text is compressed in
blocks of `BLOCK` bytes with either; (size with the bad one - size with the good one) / bytes is
large where a text looks like the good ones. Labelled texts that were not used for the dictionaries
turn that difference into a probability by a logistic curve, weighted to the labels' own frequencies.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.llm._common import bounded_labels, fold, in_fold, sample_texts

FOLDS, HELD_OUT = 4, 2
#: Labelled texts of each class that are learned from, at most.
PER_CLASS = 2000
DICTIONARY = 64 << 10
BLOCK = 2048
LEVEL = 3
PREDICTED = 0.7


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    offset: float


class Scorer:
    """Score of texts under a model: one per task."""

    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, offset: float = 0.0):
        self.slope, self.offset = slope, offset
        self.tools = [zstandard.ZstdCompressor(level=LEVEL, dict_data=_dictionary(d), write_checksum=False, write_content_size=False) for d in (good, bad)]

    def difference(self, text: str) -> float:
        data = text.encode("utf-8", "replace")
        if not data:
            return 0.0
        good, bad = (sum(len(tool.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for tool in self.tools)
        return (bad - good) / len(data)

    def score(self, text: str) -> float:
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, self.slope * self.difference(text) + self.offset))))


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    kind = zstandard.DICT_TYPE_FULLDICT if data[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
    return zstandard.ZstdCompressionDict(data, dict_type=kind)


def _build(texts: list[str]) -> bytes:
    """A trained dictionary, or the texts' last bytes themselves where there are too few to train on."""
    pieces = [d[i : i + BLOCK] for d in (t.encode("utf-8", "replace") for t in texts) for i in range(0, len(d), BLOCK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except (zstandard.ZstdError, ValueError, MemoryError):
        return b"".join(pieces)[-DICTIONARY:] or b"\n" * 16


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, by Newton's method with step control."""
    scale = max(float(np.std(x)), 1e-9)
    a = np.stack([x / scale, np.ones_like(x)], axis=1)
    w = np.zeros(2)
    weight = weight / weight.sum()
    loss = lambda w: float((weight * np.logaddexp(0, -(2 * y - 1) * (a @ w))).sum() + ridge * w @ w / 2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2), a.T @ (weight * (p - y)) + ridge * w)
        size = 1.0
        while size > 1e-4 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-8:
            break
    return float(w[0] / scale), float(w[1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model of rows whose crc32(doc_id) mod 4 is not 2. Without labels of both classes, every score is their share."""
    ids = bounded_labels(labels, "quality", modulus=FOLDS, held_out=HELD_OUT, per_class=PER_CLASS)
    rows = sample_texts(docs, ids, "label")
    texts = {v: [r["text"] for r in rows if r["label"] == v] for v in (0, 1)}
    if not texts[0] or not texts[1]:
        return Model(b"\n" * 16, b"\n" * 16, 0.0, 4.0 if texts[1] else -4.0 if texts[0] else 0.0)
    counts = {r["label"]: r["n"] for r in _frequencies(labels)}
    # Halves: one for the dictionaries, one for the curve.
    first = {v: texts[v][::2] for v in texts}
    second = {v: texts[v][1::2] or texts[v] for v in texts}
    good, bad = _build(first[1]), _build(first[0])
    scorer = Scorer(good, bad)
    x = np.array([scorer.difference(t) for v in (0, 1) for t in second[v]])
    y = np.repeat([0.0, 1.0], [len(second[0]), len(second[1])])
    weight = np.where(y == 1, counts.get(1, 1) / len(second[1]), counts.get(0, 1) / len(second[0]))
    return Model(good, bad, *logistic(x, y, weight))


def _frequencies(labels: DataFrame) -> list:
    kept = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1) & (fold(F.col("doc_id").cast("long"), FOLDS) != HELD_OUT))
    return kept.groupBy(F.col("quality").alias("label")).agg(F.count("*").alias("n")).collect()


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Out: doc_id, held_out, score, predicted (score >= 0.7). Null and empty texts get the score of no difference.

    Only texts are scored; rows are independent, so repeated rows get equal scores. A row without an id is in no fold: it isn't held out.
    """
    model = docs.sparkSession.sparkContext.broadcast(vars(train(docs, labels)))  # two dictionaries of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(**model.value)
        for batch in batches:
            scores = [scorer.score(t.as_py() or "") for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array([int(s >= PREDICTED) for s in scores], pa.int32())],
                names=["doc_id", "held_out", "score", "predicted"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")

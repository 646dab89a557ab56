"""Language identification in two levels of linear support vector machines.

Texts become frequencies of hashed two- and three-byte sequences of their lower-cased letters.
First one machine per language family says which family a text belongs to; then, inside it, one
machine for each pair of its languages votes. Both levels are trained on a bounded sample of texts
with a known language, with the squared hinge loss. A family without siblings needs no second level.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from brindle.llm import _kernel as kernel
from brindle.llm._common import fold, in_fold, sample_texts

FOLDS, HELD_OUT = 5, 0
#: Texts of each language that are learned from, at most, and of all languages together.
PER_LANGUAGE = 1000
IN_ALL = 5_000
PARTS = 64
BUCKETS = 1 << 12
STEPS = 150
RIDGE = 1e-4
UNKNOWN = "und"

# Families of languages by their codes. A language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "semitic": "am ar he mt",
    "sinitic": "zh yue",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}

_CLEAN = np.full(256, 32, np.uint8)
_CLEAN[97:123] = np.arange(97, 123)
_CLEAN[128:] = np.arange(128, 256)


def family(language: str) -> str:
    return _FAMILY.get(language, f"only {language}")


def sequences(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the two- and three-byte sequences that end at each byte (2 x bytes), -1 where none of the text ends."""
    v = _CLEAN[data].astype(np.uint32)
    out = np.full((2, len(v)), -1, np.int32)
    if len(v) > 1:
        two = v[:-1] * np.uint32(257) + v[1:]
        out[0, 1:] = (two * np.uint32(2654435761)) >> np.uint32(20)
        three = two[:-1] * np.uint32(263) + v[2:]
        out[1, 2:] = (three * np.uint32(2246822519) + np.uint32(97)) >> np.uint32(20)
        out[0, 1:][(v[:-1] == 32) & (v[1:] == 32)] = -1
        out[1, 2:][(v[1:-1] == 32)] = -1
    starts = offsets[:-1][offsets[:-1] < len(v)]
    out[:, starts] = -1
    out[1, starts[starts + 1 < len(v)] + 1] = -1
    return out, np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def frequencies(texts: list[str]) -> np.ndarray:
    """One row a text: share of each bucket among its sequences, times a fixed scale."""
    rows = np.zeros((len(texts), BUCKETS), np.float32)
    for k, text in enumerate(texts):
        data = np.frombuffer(text.lower().encode("utf-8", "replace"), np.uint8)
        found = sequences(data, np.array([0, len(data)]))[0].ravel()
        rows[k] = np.bincount(found[found >= 0], minlength=BUCKETS) / max(1, (found >= 0).sum())
    return rows


def machine(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and offset of a linear machine for labels -1 and 1, classes weighted alike: squared hinge, accelerated descent."""
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    w, b = np.zeros(x.shape[1], np.float32), 0.0
    v, c = w, b
    lipschitz = 2 * float((share * (np.einsum("ij,ij->i", x, x) + 1)).sum()) + RIDGE
    for k in range(1, STEPS + 1):
        pull = share * y * np.maximum(0, 1 - y * (x @ v + np.float32(c)))
        new, new_b = v - (RIDGE * v - 2 * (pull @ x)) / lipschitz, c - (RIDGE * c - 2 * float(pull.sum())) / lipschitz
        step = (k - 1) / (k + 2)
        v, c = new + step * (new - w), new_b + step * (new_b - b)
        w, b = new, new_b
    return w, float(b)


def train(docs: DataFrame) -> dict:
    """Machines from texts whose crc32(doc_id) mod 5 is not 0 and whose lang is known."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "lang").where(
        F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id").cast("long"), FOLDS) != HELD_OUT)
    )
    # The first of each language by hash, found in parts first, so that no task holds all rows of one language.
    rank = [F.xxhash64(F.lit("lang"), "doc_id"), F.col("doc_id")]
    part = F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("doc_id"), F.lit(PARTS))).orderBy(*rank))
    known = known.withColumn("place", part).where(F.col("place") <= PER_LANGUAGE)
    place = F.row_number().over(Window.partitionBy("lang").orderBy(*rank))
    ids = known.withColumn("place", place).where(F.col("place") <= PER_LANGUAGE).orderBy("place", "lang").limit(IN_ALL).select("doc_id")
    rows = [r for r in sample_texts(docs, ids.distinct(), "lang", 24 << 20) if r["lang"] is not None and any(c.isalpha() for c in r["text"])]
    names = sorted({r["lang"] for r in rows})
    families = sorted({family(n) for n in names})
    if not names:
        return {"names": [], "families": [], "weights": np.zeros((0, BUCKETS), np.float32), "offsets": np.zeros(0), "pairs": []}
    x = frequencies([r["text"] for r in rows])
    scale = 1 / (x.std(axis=0) + 1e-4)
    mean = x.mean(axis=0)
    x -= mean
    x *= scale / np.sqrt(BUCKETS)
    lang = np.array([r["lang"] for r in rows])
    fam = np.array([family(r["lang"]) for r in rows])
    found: list[tuple[np.ndarray, float]] = []
    for f in families:
        found.append(machine(x, np.where(fam == f, 1.0, -1.0).astype(np.float32)) if len(families) > 1 else (np.zeros(BUCKETS, np.float32), 1.0))
    pairs = []
    for f in families:
        for a, b in itertools.combinations([n for n in names if family(n) == f], 2):
            own = (lang == a) | (lang == b)
            found.append(machine(x[own], np.where(lang[own] == a, 1.0, -1.0).astype(np.float32)))
            pairs.append((names.index(a), names.index(b)))
    # Scaling moves into the weights, so that a text's margins are plain sums over its sequences.
    weights = np.stack([w * scale / np.sqrt(BUCKETS) for w, _ in found]).astype(np.float32)
    offsets = np.array([o for _, o in found]) - weights @ mean
    return {"names": names, "families": families, "weights": weights, "offsets": offsets, "pairs": pairs}


def decide(model: dict, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of the language and score of each row of margins: family machines first, then pairs."""
    names, families = model["names"], model["families"]
    n_fam = len(families)
    of = np.array([families.index(family(n)) for n in names])
    best = margins[:, :n_fam].argmax(axis=1)
    sure = lambda m: 1 / (1 + np.exp(-np.clip(3 * m, -40, 40)))
    score = sure(margins[np.arange(len(margins)), best])
    votes = np.zeros((len(margins), len(names)))
    least = np.ones((len(margins), len(names)))
    for k, (a, b) in enumerate(model["pairs"]):
        p = sure(margins[:, n_fam + k])
        votes[:, a] += (p >= 0.5) + p * 1e-3
        votes[:, b] += (p < 0.5) + (1 - p) * 1e-3
        least[:, a] = np.minimum(least[:, a], p)
        least[:, b] = np.minimum(least[:, b], 1 - p)
    votes[of[None, :] != best[:, None]] = -1
    choice = votes.argmax(axis=1)
    return choice, score * least[np.arange(len(margins)), choice]


def identify(docs: DataFrame) -> DataFrame:
    """Out: doc_id, held_out, lang_pred, score. Null texts and texts without a letter are `und` with score 0.

    Without any text to learn from, every text is `und`. The whole text is read; rows are independent. A row without
    an id is in no fold: it isn't held out. Of a language's rows at most `PARTS * PER_LANGUAGE` ids meet in one task, whatever the corpus.
    """
    model = docs.sparkSession.sparkContext.broadcast(train(docs))  # machines of fixed size for each pair of languages

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        table = np.concatenate([m["weights"].T, np.zeros((1, len(m["weights"])), np.float32)])  # the last row: no sequence
        for batch in batches:
            texts = batch.column(2)
            letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            data, offsets = kernel.buffers(pc.utf8_lower(texts))
            preds: list[str] = []
            scores: list[np.ndarray] = []
            for i, j, part, own in kernel.chunks(data, offsets, 1 << 19):
                margins = np.zeros((j - i, len(m["weights"])))
                found, _ = sequences(part, own)
                live = np.flatnonzero(np.diff(own))
                if len(live) and len(m["names"]):
                    total = np.zeros(j - i)
                    for row in found:
                        margins[live] += np.add.reduceat(table[row], own[:-1][live], axis=0)
                        total[live] += np.add.reduceat((row >= 0).astype(np.int64), own[:-1][live])
                    margins = margins / np.maximum(total, 1)[:, None] + m["offsets"]
                if m["names"]:
                    choice, score = decide(m, margins)
                    preds += [m["names"][c] if ok else UNKNOWN for c, ok in zip(choice, letters[i:j], strict=True)]
                    scores.append(np.where(letters[i:j], score, 0.0))
                else:
                    preds += [UNKNOWN] * (j - i)
                    scores.append(np.zeros(j - i))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(preds, pa.string()), pa.array(np.concatenate(scores) if scores else np.zeros(0))],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), in_fold(F.col("doc_id"), FOLDS, HELD_OUT).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")

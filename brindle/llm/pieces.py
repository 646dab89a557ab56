"""SentencePiece encoding and decoding by a shared-prefix Viterbi pass.

Blanks become the mark U+2581, with one in front of the text, and texts fall into marked words that
no piece crosses. The distinct words of a batch are sorted, which is the depth-first order of their
trie: the forward values of a word are kept for the prefix that it shares with the next one, and only
the rest is computed.

Forward values: for a unigram model, the best score of each prefix and the piece that ends it. For a
merge (BPE) model, the piece that ends the prefix in its merged form. There a path's transition
(p, q) is allowed where merging the characters of p and q gives exactly [p, q]; of all paths only one
has allowed transitions throughout, and it is the model's own encoding, so the pass is a Viterbi with
transition weights 0 and minus infinity. Characters outside the vocabulary become byte pieces. Runs of
marks are words like others: their pieces tie in score, and of ties the leftmost merges first, in a pair as in the whole.
"""

from __future__ import annotations

import gc
import re
import sys
import threading
import types
import uuid
from array import array
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, field
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes, as estimated, of the words with their ids and the transitions with their verdicts that a worker remembers; beyond it the
#: memory is emptied and filled anew.
REMEMBERED = 300 << 20
#: Bytes of a remembered word beside its letters and ids, and of a transition.
WORD_BYTES, TRANSITION_BYTES = 190, 110
#: Seconds after its last task at which a worker forgets what it has learned.
IDLE_S = 5.0
CHUNK_CHARS = 1 << 21


@dataclass
class Vocabulary:
    """Pieces of a model. `scores`: piece to (id, score); `byte_ids`: ids of the 256 byte pieces, or empty."""

    scores: dict[str, tuple[int, float]]
    byte_ids: list[int]
    unknown: int
    merges: bool
    texts: list[str] = field(default_factory=list)

    @classmethod
    def read(cls, path: str = MODEL, merges: bool = True) -> Vocabulary:
        """The vocabulary of a model file; `merges`: whether it is a merge model (else unigram)."""
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        size = m.get_piece_size()
        plain = [i for i in range(size) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        scores = {m.id_to_piece(i): (i, m.get_score(i)) for i in plain}
        byte_ids = [m.piece_to_id(f"<0x{b:02X}>") for b in range(256)] if any(m.is_byte(i) for i in range(size)) else []
        texts = ["" if m.is_control(i) else m.id_to_piece(i) for i in range(size)]
        return cls(scores, byte_ids, m.unk_id(), merges, texts)


class Encoder:
    """Encodes texts. One per worker: it remembers words and allowed transitions."""

    def __init__(self, vocabulary: Vocabulary, remembered: int = REMEMBERED):
        self.v, self.remembered = vocabulary, remembered
        if any(MARK in p.lstrip(MARK) for p in vocabulary.scores):
            raise ValueError("a piece holds a mark behind other characters: its words can't be told apart")
        if max((i for i, _ in vocabulary.scores.values()), default=0) >= 1 << 20:
            raise ValueError("a vocabulary has less than 2 ** 20 pieces")
        known = sorted({c for p in vocabulary.scores for c in p} - {MARK})
        if vocabulary.merges and any(c not in vocabulary.scores for c in known):
            raise ValueError("a character of a piece is no piece itself")
        inside = "".join(map(re.escape, known))
        self.split = re.compile(f"{MARK}*[{inside}]+|{MARK}+|." if inside else f"{MARK}+|.", re.DOTALL).findall
        self.longest = max(map(len, vocabulary.scores), default=1)
        #: Ids of each word met, as the bytes of 32-bit numbers: they join fast and the garbage collector needn't follow them.
        self.ids: dict[str, bytes] = {}
        self.names = {i: p for p, (i, _) in vocabulary.scores.items()}
        self.ranks = {p: s for p, (_, s) in vocabulary.scores.items()}
        self.numbers = {p: i for p, (i, _) in vocabulary.scores.items()}
        #: Lengths, longest first, of the pieces that end in given three characters: few are worth looking up.
        self.lengths: dict[str, tuple[int, ...]] = {}
        for p in sorted(vocabulary.scores, key=len):
            if len(p) > 2 and len(p) not in self.lengths.get(p[-3:], ()):
                self.lengths[p[-3:]] = (len(p), *self.lengths.get(p[-3:], (2, 1)))
        #: Whether a piece may follow another, by number of the one (-1: none) << 20 | number of the other.
        self.allowed: dict[int, bool] = {}
        self.computed = 0  # prefixes whose forward value was computed, for tests
        self._bytes = vocabulary.byte_ids
        self.held = 0  # bytes of words remembered

    def words(self, text: str) -> list[str]:
        return self.split(MARK + text.replace(" ", MARK)) if text else []

    def encode(self, texts: Iterable[str]) -> list[np.ndarray]:
        """Ids of each text."""
        split = [self.words(t) for t in texts]
        if self.held + TRANSITION_BYTES * len(self.allowed) > self.remembered:
            self.ids.clear()
            self.allowed.clear()
            self.held = 0
        get = self.ids.get
        found = [list(map(get, words)) for words in split]
        new: set[str] = set()
        for words, ids in zip(split, found, strict=True):
            if None in ids:
                new.update(compress(words, [x is None for x in ids]))
        self._learn(sorted(new))
        know = self.ids.__getitem__
        return [np.frombuffer(b"".join(map(know, w) if None in x else x), np.int32) for w, x in zip(split, found, strict=True)]

    def _learn(self, words: list[str]) -> None:
        """Depth-first over the trie of the sorted words."""
        (self._learn_merged if self.v.merges else self._learn_best)(words)

    def _keep(self, word: str, ids: Sequence[int]) -> None:
        self.ids[word] = packed = array("i", ids).tobytes()
        self.held += WORD_BYTES + 2 * len(word) + len(packed)

    def _learn_merged(self, words: list[str]) -> None:
        numbers, allowed, lengths, short = self.numbers.get, self.allowed, self.lengths.get, (2, 1)
        known = allowed.get
        before = ""
        starts, pieces = [0], [-1]  # of the last piece of each prefix of the word before
        for w in words:
            if len(w) == 1 and w not in self.numbers:
                self._keep(w, self._unknown(w))
                continue
            shared, n = 0, len(w)
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del starts[shared + 1 :], pieces[shared + 1 :]
            self.computed += n - shared
            for end in range(shared + 1, n + 1):
                for length in lengths(w[end - 3 : end], short) if end > 2 else short:
                    start = end - length
                    if start >= 0 and (piece := numbers(w[start:end])) is not None:
                        key = pieces[start] << 20 | piece
                        follows = known(key)
                        if follows is None:
                            follows = allowed[key] = self._follows(pieces[start], piece)
                        if follows:
                            starts.append(start)
                            pieces.append(piece)
                            break
                else:
                    raise AssertionError("a prefix of known characters has a merged form")
            before, path, end = w, [], n
            while end:
                path.append(pieces[end])
                end = starts[end]
            path.reverse()
            self._keep(w, path)

    def _follows(self, last: int, piece: int) -> bool:
        """Merges the characters of both: again and again the best-scored neighbours, the leftmost of equals, become one."""
        one, other = self.names.get(last, ""), self.names[piece]
        parts = list(one + other)
        score, none = self.ranks.get, -float("inf")
        pairs = [score(a + b, none) for a, b in zip(parts, parts[1:])]
        while pairs:
            best = max(pairs)
            if best == none:
                break
            i = pairs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = score(parts[i - 1] + parts[i], none)
            if i < len(pairs):
                pairs[i] = score(parts[i] + parts[i + 1], none)
        return parts == ([one, other] if one else [other])

    def _learn_best(self, words: list[str]) -> None:
        before = ""
        # values[i]: of the prefix of i characters, (score, start of its last piece).
        values: list[tuple[float, int]] = [(0.0, 0)]
        for w in words:
            shared = 0
            for a, b in zip(before, w):
                if a != b:
                    break
                shared += 1
            del values[shared + 1 :]
            for end in range(shared + 1, len(w) + 1):
                values.append(self._best_step(w, end, values))
                self.computed += 1
            before = w
            path, end = [], len(w)
            while end:
                start = values[end][1]
                path.append(w[start:end])
                end = start
            self._keep(w, [i for p in reversed(path) for i in ((self.numbers[p],) if p in self.numbers else self._unknown(p))])

    def _unknown(self, text: str) -> tuple[int, ...]:
        return tuple(self._bytes[b] for b in text.encode("utf-8", "replace")) if self._bytes else (self.v.unknown,)

    def _best_step(self, w: str, end: int, values: list[tuple[float, int]]) -> tuple[float, int]:
        best: tuple[float, int] | None = None
        for start in range(max(0, end - self.longest), end):
            piece = w[start:end]
            found = self.v.scores.get(piece)
            if found is not None:
                score = values[start][0] + found[1]
            elif end - start == 1:  # an unknown character: below every piece
                score = values[start][0] - 1e6
            else:
                continue
            if best is None or score > best[0]:
                best = (score, start)
        assert best is not None
        return best


class Decoder:
    """Text of ids: bytes are put together, marks become blanks, the one in front goes."""

    def __init__(self, vocabulary: Vocabulary):
        # Bytes stand as lone surrogates until all of a text are in place.
        self.texts = [t.replace(MARK, " ") for t in vocabulary.texts]
        for b, i in enumerate(vocabulary.byte_ids):
            self.texts[i] = chr(b) if b < 128 else chr(0xDC00 + b)

    def decode(self, ids: Iterable[int]) -> str:
        text = "".join(map(self.texts.__getitem__, ids))
        text = text[1:] if text[:1] == " " else text
        return text if text.isascii() else text.encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _parts(texts: list[str | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about `CHUNK_CHARS` characters, or of one text."""
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j] or "") <= CHUNK_CHARS):
            size += len(texts[j] or "")
            j += 1
        yield i, j
        i = j


def encode_texts(docs: DataFrame, vocabulary: Vocabulary, *, remembered: int = REMEMBERED) -> DataFrame:
    """Out: doc_id, n_tokens, token_ids, round_trip (whether decoding gives the text back).

    A null text has null ids and round_trip, and 0 tokens; an empty one has no ids. A text that
    holds the mark itself decodes to a blank in its place, as in the model's own library, and is the only
    kind with round_trip false. Rows are independent; other columns are not looked at. `remembered` (bytes) trades a
    worker's memory for time and changes no result.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(vocabulary))  # tens of thousands of pieces, whatever the corpus
    name = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # What a worker has learned serves its later tasks too: it stays in a module of its own, one encoder
        # at a time, and goes when no task has come for a while.
        kept = types.ModuleType("_brindle_pieces")
        kept.__dict__.update(lock=threading.Lock(), running=0, name=None, encoder=None, timer=None)
        kept = sys.modules.setdefault("_brindle_pieces", kept)

        def forget() -> None:
            with kept.lock:
                if not kept.running:
                    kept.__dict__.update(name=None, encoder=None)

        with kept.lock:
            kept.running += 1
            if kept.timer is not None:
                kept.timer.cancel()
            if kept.name != name:
                kept.__dict__.update(name=name, encoder=Encoder(Vocabulary(**shared.value), remembered))
            encoder, decoder = kept.encoder, Decoder(Vocabulary(**shared.value))
        gc.disable()  # what is made here holds no cycles, and what is remembered is large to walk through
        try:
            for batch in batches:
                texts = batch.column(1).to_pylist()
                for i, j in _parts(texts):
                    part = texts[i:j]
                    ids = encoder.encode(t or "" for t in part)
                    same = [None if t is None else decoder.decode(x.tolist()) == t for t, x in zip(part, ids, strict=True)]
                    sizes = np.array([len(x) for x in ids], np.int64)
                    ends = pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32))
                    missing = pa.array([t is None for t in part], pa.bool_())
                    lists = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(ids)), mask=missing)
                    yield pa.RecordBatch.from_arrays(
                        [batch.column(0).slice(i, j - i), pa.array(sizes), lists, pa.array(same, pa.bool_())],
                        names=["doc_id", "n_tokens", "token_ids", "round_trip"],
                    )
        finally:
            gc.enable()
            with kept.lock:
                kept.running -= 1
                kept.timer = threading.Timer(IDLE_S, forget)
                kept.timer.daemon = True
                kept.timer.start()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, "doc_id long, n_tokens long, token_ids array<int>, round_trip boolean")


def decode_texts(encoded: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Out: doc_id, text. Null ids give a null text."""
    shared = encoded.sparkSession.sparkContext.broadcast(vars(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decoder = Decoder(Vocabulary(**shared.value))
        for batch in batches:
            texts = [None if x is None else decoder.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "token_ids").mapInArrow(run, "doc_id long, text string")

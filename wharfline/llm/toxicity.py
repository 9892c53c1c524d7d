"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams (operator 9).

Features are the distinct hashes of words, word stems (the first bytes), stems that several different words of the
text share, pairs of neighbours and pairs with one word between.  Learning rates are per coordinate, and the L1 term leaves few weights other than zero, so that
what goes to every task is a short table of hashes and weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .labelled import crc_of, sample

U = np.uint64
#: Labelled documents to fit on, at most, and the words of one of them (longer ones are left out of the fit).
FIT_DOCS, FIT_WORDS = 5000, 2000
#: A feature must occur in so many documents of the sample, and in that share of them.
FIT_SEEN, FIT_SHARE = 2, 0.004
#: Toxic documents are few: each counts as so many.
TOXIC_WEIGHT = 8.0
ALPHA, BETA, L1, L2, EPOCHS = 6.0, 1.0, 20.0, 0.0, 8
#: Bytes of the stems, and numbers of words of one stem that are a feature of their own.
STEM_BYTES, FORMS = (4, 6), (2, 3)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Feature hashes of 32 bits (with repeats) of all documents and the document of each."""
    hashes, starts, ends, at = K.words(data, offsets)
    doc = np.repeat(np.arange(len(at) - 1), np.diff(at))
    # punctuation at either end of a word is not part of it
    low, high = starts.copy(), ends.copy()
    edge = _EDGE[data] if len(data) else np.zeros(0, dtype=bool)
    for _ in range(3):
        move = (low < high - 1) & edge[low] if len(low) else low.astype(bool)
        low[move] += 1
        move = (high > low + 1) & edge[high - 1] if len(low) else low.astype(bool)
        high[move] -= 1
    bare = _spans(data, low, high)
    parts, owners = [K.mix(bare ^ U(1))], [doc]
    for i, size in enumerate(STEM_BYTES):
        stems = _spans(data, low, np.minimum(high, low + size))
        parts.append(K.mix(stems ^ U(2 + (i << 8))))
        owners.append(doc)
        # a stem that several different words of the document share
        order = np.lexsort((bare, stems, doc))
        d, s, b = doc[order], stems[order], bare[order]
        head = np.ones(len(d), dtype=bool)
        head[1:] = (d[1:] != d[:-1]) | (s[1:] != s[:-1])
        new = head.copy()
        new[1:] |= b[1:] != b[:-1]
        group = np.cumsum(head) - 1
        forms = np.bincount(group[new], minlength=int(head.sum()))
        d, s = d[head], s[head]
        for least in FORMS:
            many = forms >= least
            parts.append(K.mix(s[many] ^ U(4 + least + (i << 8))))
            owners.append(d[many])
    for lag, salt in ((1, 3), (2, 5)):
        if len(bare) > lag:
            same = doc[lag:] == doc[:-lag]
            parts.append(K.mix(bare[:-lag][same] * U(0x9E3779B97F4A7C15) + bare[lag:][same] * U(0xC2B2AE3D27D4EB4F) + U(salt)))
            owners.append(doc[lag:][same])
    return (np.concatenate(parts) >> U(32)).astype(np.uint32), np.concatenate(owners)


_EDGE = np.zeros(256, dtype=bool)
_EDGE[list(b".,;:!?\"'()[]{}*#&%$|-_")] = True


def _spans(data: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Hashes of byte ranges (A-Z as a-z) that lie inside words."""
    out = np.zeros(len(low), dtype=U)
    reach = high - low
    live = np.arange(len(low))
    step = 0
    while len(live):
        live = live[reach[live] > step]
        out[live] = (out[live] + K._BYTE_FOLDED[data[low[live] + step]]) * U(0x9E3779B97F4A7C15)
        step += 1
    return K.mix(out)


@dataclass
class Weights:
    """Hashes of the features with a weight, in order, and their weights."""

    hashes: np.ndarray
    weights: np.ndarray
    bias: float

    def scores(self, hashes: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
        """Chance of toxicity of each of n documents from their features (each counts once)."""
        total = np.full(n, self.bias)
        if len(self.hashes) and len(hashes):
            few = np.zeros(1 << 20, dtype=bool)
            few[self.hashes >> np.uint32(12)] = True
            maybe = np.flatnonzero(few[hashes >> np.uint32(12)])
            place = np.minimum(np.searchsorted(self.hashes, hashes[maybe]), len(self.hashes) - 1)
            hit = self.hashes[place] == hashes[maybe]
            once = np.unique(doc[maybe[hit]] * len(self.hashes) + place[hit])
            np.add.at(total, once // len(self.hashes), self.weights[once % len(self.hashes)])
        return 1 / (1 + np.exp(-np.clip(total, -50, 50)))


def fit(examples: list[np.ndarray], y: np.ndarray) -> Weights:
    """FTRL-proximal over the documents in their order, EPOCHS times; features of too few documents are left out."""
    if not len(y):
        return Weights(np.zeros(0, dtype=np.uint32), np.zeros(0), 0.0)
    known, counts = np.unique(np.concatenate(examples), return_counts=True)
    known = known[counts >= max(FIT_SEEN, FIT_SHARE * len(y))]
    rows = []
    for e in examples:
        place = np.minimum(np.searchsorted(known, e), max(len(known) - 1, 0))
        rows.append(np.append(place[known[place] == e] if len(known) else np.zeros(0, dtype=np.int64), len(known)))
    z, n = np.zeros(len(known) + 1), np.zeros(len(known) + 1)

    def weights(i, l1=L1):
        free = np.maximum(np.abs(z[i]) - np.where(i == len(known), 0.0, l1), 0) * np.sign(z[i])
        return -free / ((BETA + np.sqrt(n[i])) / ALPHA + L2)

    for _ in range(EPOCHS):
        for i, label in zip(rows, y, strict=True):
            w = weights(i)
            g = (1 / (1 + np.exp(-np.clip(w.sum(), -50, 50))) - label) * (TOXIC_WEIGHT if label else 1.0)
            sigma = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / ALPHA
            z[i] += g - sigma * w
            n[i] += g * g
    w = weights(np.arange(len(known) + 1))
    active = np.flatnonzero(w[:-1])
    return Weights(known[active], w[active], float(w[-1]))


def _collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.passes(batch, "text"):
            data, offsets = K.buffers(part.column(2))
            words = np.diff(K.words(data, offsets)[3])
            hashes, doc = features(data, offsets)
            order = np.argsort(doc, kind="stable")
            at = np.searchsorted(doc[order], np.arange(len(offsets)))
            keep = np.flatnonzero(words <= FIT_WORDS)
            rows = [np.unique(hashes[order[at[d] : at[d + 1]]]).tobytes() for d in keep]
            index = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "toxic", modulus: int = 3, left_out: int = 1, id_col: str = "doc_id", text_col: str = "text") -> Weights:
    """Fit on at most FIT_DOCS labelled documents of at most FIT_WORDS words outside the held-out fold."""
    chosen = sample(docs, labels, label=label, modulus=modulus, left_out=left_out, most=FIT_DOCS, id_col=id_col, text_col=text_col)
    got = chosen.mapInArrow(_collect, "doc_id long, y int, x binary").toArrow()  # bounded by the two constants
    ids = got.column("doc_id").to_numpy()
    order = np.argsort(K.mix(ids.astype(U)), kind="stable")
    rows = [np.frombuffer(v.as_buffer(), dtype=np.uint32) for c in got.column("x").chunks for v in c]
    return fit([rows[i] for i in order], got.column("y").to_numpy()[order])


def score_toxicity(docs: DataFrame, weights: Weights, *, modulus: int = 3, left_out: int = 1, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: likelier toxic) and predicted of every whole text, a row for each row of ``docs``.

    A text without words (null, blank) has no features: its score is that of the bias alone, 0.5 where nothing
    was learnt.  A null id is in no fold (held_out is false).  Repeated rows, further columns of any name and an
    empty table are fine.
    """
    model = docs.sparkSession.sparkContext.broadcast(weights)  # bounded by the words of the sample
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, "text"):
                data, offsets = K.buffers(part.column(1))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(model.value.scores(*features(data, offsets), len(offsets) - 1))], ["doc_id", "score"])

    held = F.coalesce(crc_of(F.col("doc_id")) % modulus == left_out, F.lit(False))
    return rows.mapInArrow(run, "doc_id long, score double").select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))

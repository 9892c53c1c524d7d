"""Document quality by a linear-chain conditional random field over lines (operator 7).

Each line is good or bad.  Its features describe its characters and words and those of the lines next to it; the
chain's transitions let neighbours agree.  Labels exist for documents only, so every line of a labelled
document takes its label when the field is fitted: the transitions learn to stay, and what tells documents of mixed
lines apart is the features of the lines and their neighbours.  A document's score is the length-weighted mean of the
forward-backward marginals of its lines.  A long text is scored by blocks of lines with carried vectors; only a single
line is held as a whole.
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
#: Labelled documents the field is fitted on, at most, and the lines of one of them.
FIT_DOCS, FIT_LINES = 1500, 150
ROUNDS, RATE, L2 = 60, 0.1, 1e-3

_CLASS = np.zeros(256, dtype=np.uint8)
for _i, _set in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:?'\"()-", b"!", b"|", b"#$%&*@^~<>{}[]\\=+_/`"), 1):
    _CLASS[list(_set)] = _i
CLASSES = 8
OWN = CLASSES + 9
WIDTH = 3 * OWN + 2


def _own_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with words, each by itself, their lengths in bytes, and the n + 1 offsets of the documents in the lines."""
    hashes, starts, ends, _ = K.words(data, offsets, fold=False)
    if not len(starts):
        return np.zeros((0, OWN)), np.zeros(0), np.zeros(len(offsets), dtype=np.int64)
    bounds = np.unique(np.concatenate([offsets, np.flatnonzero(data == 10) + 1]))
    low, high = bounds[:-1], bounds[1:]
    inked = np.searchsorted(starts, low) < np.searchsorted(starts, high)
    low, high = low[inked], high[inked]
    first, last = np.searchsorted(starts, low), np.searchsorted(starts, high)
    words = last - first
    kinds = _CLASS[data]
    size = (high - low).astype(float)
    columns = []
    for c in range(CLASSES):
        sums = np.zeros(len(data) + 1, dtype=np.int32)
        np.cumsum(kinds == c, out=sums[1:])
        columns.append((sums[high] - sums[low]) / size)
    columns[2] = columns[2] / np.maximum(columns[1] + columns[2], 1e-9)  # capitals among letters
    columns.append(np.log1p(size) / 5)
    columns.append(np.log1p(words) / 4)
    lengths = np.concatenate([[0], np.cumsum(ends - starts)])
    columns.append((lengths[last] - lengths[first]) / words / 10)
    for lag in (1, 2, 3):
        same = np.zeros(len(hashes) + 1, dtype=np.int64)
        same[1 + lag :] = np.cumsum(hashes[lag:] == hashes[:-lag])
        inside = np.maximum(last - first - lag, 0)
        columns.append((same[last] - same[np.minimum(first + lag, last)]) / np.maximum(inside, 1))
    tail = data[ends[last - 1] - 1]
    columns.append(np.isin(tail, np.frombuffer(b".?!:;\"'", dtype=np.uint8)).astype(float))
    columns.append((kinds[starts[first]] == 2).astype(float))
    # words that end in something other than a letter, a digit or common punctuation
    odd = np.concatenate([[0], np.cumsum(np.isin(kinds[ends - 1], (5, 6, 7)))])
    columns.append((odd[last] - odd[first]) / words)
    return np.stack(columns, axis=1), size, np.searchsorted(low, offsets)


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Features of all lines with words, their lengths in bytes, and the n + 1 offsets of the documents in the lines."""
    own, size, at = _own_features(data, offsets)
    if not len(own):
        return np.zeros((0, WIDTH)), size, at
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = own[:-1], own[1:]
    edge = np.zeros((len(own), 2))
    docs = np.flatnonzero(np.diff(at))
    edge[at[docs], 0] = edge[at[docs + 1] - 1, 1] = 1
    before[edge[:, 0] == 1] = 0
    after[edge[:, 1] == 1] = 0
    return np.concatenate([own, before, after, edge], axis=1), size, at


def line_blocks(data: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole lines of one text, of ``limit`` bytes at most; a longer line is a range of its own."""
    low = 0
    while low < len(data):
        high = min(low + limit, len(data))
        if high < len(data):
            breaks = np.flatnonzero(data[low:high] == 10)
            if len(breaks):
                high = low + int(breaks[-1]) + 1
            else:  # on to the end of the line, read in steps of the same length
                while high < len(data) and not len(breaks):
                    breaks = np.flatnonzero(data[high : high + limit] == 10)
                    high = high + int(breaks[0]) + 1 if len(breaks) else min(high + limit, len(data))
        yield low, high
        low = high


@dataclass
class Block:
    """Lines of one text by their bytes, with what stands on either side (None at its ends)."""

    low: int
    high: int
    before: np.ndarray | None
    after: np.ndarray | None = None

    def features(self, own: np.ndarray) -> np.ndarray:
        none = np.zeros((1, OWN))
        before = np.concatenate([none if self.before is None else self.before[None], own[:-1]])
        after = np.concatenate([own[1:], none if self.after is None else self.after[None]])
        edge = np.zeros((len(own), 2))
        edge[0, 0], edge[-1, 1] = self.before is None, self.after is None
        return np.concatenate([own, before, after, edge], axis=1)


def block_features(data: np.ndarray, limit: int) -> Iterator[tuple[Block, np.ndarray, np.ndarray]]:
    """The blocks of one text that hold words: block, features of its lines, their lengths.  Two blocks are held at a time."""
    held = None
    for low, high in line_blocks(data, limit):
        own, size, _ = _own_features(data[low:high], np.array([0, high - low]))
        if not len(own):
            continue
        before = None
        if held is not None:
            held[0].after, before = own[0].copy(), held[1][-1].copy()
            yield held[0], held[0].features(held[1]), held[2]
        held = Block(low, high, before), own, size
    if held is not None:
        yield held[0], held[0].features(held[1]), held[2]


@dataclass
class Field:
    """Emission weights (the odds of a good line) and the scores of the four transitions, (from, to)."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    bias: float
    moves: np.ndarray
    constant: float | None = None

    def odds(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights + self.bias


def _steps(at: np.ndarray):
    """Documents from long to short, and for each place of a line the number of documents that reach it."""
    sizes = np.diff(at)
    order = np.argsort(-sizes, kind="stable")
    longest = int(sizes.max(initial=0))
    reach = len(sizes) - np.searchsorted(np.sort(sizes), np.arange(1, longest + 1))
    return order, reach


def marginals(odds: np.ndarray, at: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chance that each line is good, and the expected transitions of each line from the line before (lines x 2 x 2)."""
    n = len(odds)
    good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    emit = np.stack([1 - good, good], axis=1) + 1e-300
    step = np.exp(moves)
    ahead, back = np.zeros((n, 2)), np.ones((n, 2))
    order, reach = _steps(at)
    begin = at[:-1][order]
    for t, k in enumerate(reach):
        i = begin[:k] + t
        a = emit[i] * (ahead[i - 1] @ step if t else 1)
        ahead[i] = a / a.sum(axis=1, keepdims=True)
    end = at[1:][order]
    pair = np.zeros((n, 2, 2))
    for t, k in reversed(list(enumerate(reach))):
        i = begin[:k] + t
        inner = i + 1 < end[:k]
        j = i[inner]
        b = (emit[j + 1] * back[j + 1]) @ step.T
        back[j] = b / b.sum(axis=1, keepdims=True)
        q = ahead[j][:, :, None] * step * (emit[j + 1] * back[j + 1])[:, None, :]
        pair[j + 1] = q / q.sum(axis=(1, 2), keepdims=True)
    p = ahead * back
    return (p / p.sum(axis=1, keepdims=True))[:, 1], pair


def _emitted(odds: np.ndarray) -> tuple[list[float], list[float]]:
    good = 1 / (1 + np.exp(-np.clip(odds, -50, 50)))
    return (1 - good + 1e-300).tolist(), (good + 1e-300).tolist()


def _forward(bad: list[float], good: list[float], ahead: tuple[float, float] | None, step: list[list[float]]) -> list[tuple[float, float]]:
    """Normalised forward vectors of lines, from the one that enters (None at the text's first line)."""
    (s00, s01), (s10, s11) = step
    out = []
    for e0, e1 in zip(bad, good, strict=True):
        a0, a1 = (e0, e1) if ahead is None else (e0 * (ahead[0] * s00 + ahead[1] * s10), e1 * (ahead[0] * s01 + ahead[1] * s11))
        ahead = a0 / (a0 + a1), a1 / (a0 + a1)
        out.append(ahead)
    return out


def long_score(data: np.ndarray, field: Field, limit: int) -> float:
    """The score of one text (bytes) of any length: the field is run over its blocks of lines.

    Going ahead, only the forward vector that enters each block is kept; going back, a block's features and forward
    vectors are made again and met by the backward vector carried from the block behind it.  Memory follows
    ``limit`` (or the longest line), not the text.
    """
    step = np.exp(field.moves).tolist()
    (s00, s01), (s10, s11) = step
    entered: list[tuple[Block, tuple[float, float] | None]] = []
    ahead: tuple[float, float] | None = None
    for block, x, _ in block_features(data, limit):
        entered.append((block, ahead))
        if field.constant is not None:
            return field.constant
        ahead = _forward(*_emitted(field.odds(x)), ahead, step)[-1]
    held = total = 0.0
    b0 = b1 = 1.0
    behind: tuple[float, float] | None = None
    for block, ahead in reversed(entered):
        own, size, _ = _own_features(data[block.low : block.high], np.array([0, block.high - block.low]))
        bad, good = _emitted(field.odds(block.features(own)))
        forward = _forward(bad, good, ahead, step)
        chance = np.zeros(len(own))
        for i in range(len(own) - 1, -1, -1):
            if behind is not None:
                b0, b1 = s00 * behind[0] + s01 * behind[1], s10 * behind[0] + s11 * behind[1]
                b0, b1 = b0 / (b0 + b1), b1 / (b0 + b1)
            p0, p1 = forward[i][0] * b0, forward[i][1] * b1
            chance[i] = p1 / (p0 + p1)
            behind = bad[i] * b0, good[i] * b1
        held, total = held + float(chance @ size), total + float(size.sum())
    return held / total if total else 0.0


def fit(x: np.ndarray, at: np.ndarray, y: np.ndarray) -> Field:
    """Conditional maximum likelihood (L2-regularised, full-batch Adam from zero: the same data give the same field)."""
    line_y = np.repeat(y, np.diff(at))
    flat = Field(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0, np.zeros((2, 2)))
    if len(np.unique(y)) < 2 or not len(x):
        flat.constant = float(y.mean()) if len(y) else 0.5
        return flat
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = (x - mean) / scale
    theta = np.zeros(WIDTH + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    inner = np.ones(len(x), dtype=bool)
    inner[at[:-1][np.diff(at) > 0]] = False
    seen = np.zeros((2, 2))
    np.add.at(seen, (line_y[inner], line_y[inner]), 1)
    for t in range(1, ROUNDS + 1):
        good, pair = marginals(z @ theta[:WIDTH] + theta[WIDTH], at, theta[WIDTH + 1 :].reshape(2, 2))
        off = line_y - good
        grad = np.concatenate([off @ z, [off.sum()], (seen - pair.sum(axis=0)).ravel()]) / len(x) - L2 * theta
        first = 0.9 * first + 0.1 * grad
        second = 0.999 * second + 0.001 * grad**2
        theta = theta + RATE * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.999**t)) + 1e-8)
    return Field(mean, scale, theta[:WIDTH], float(theta[WIDTH]), theta[WIDTH + 1 :].reshape(2, 2))


def _few_lines(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of one long text's lines and their offsets, of no line once there are more than FIT_LINES."""
    found, n = [np.zeros((0, WIDTH))], 0
    for _, x, _ in block_features(data, K.PASS_BYTES):
        n += len(x)
        if n > FIT_LINES:
            return found[0], np.array([0, 0])
        found.append(x)
    return np.concatenate(found), np.array([0, n])


def _featurise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in K.passes(batch, "text"):
            data, offsets = K.buffers(part.column(2))
            x, at = _few_lines(data) if len(data) > K.PASS_BYTES else line_features(data, offsets)[::2]
            keep = np.flatnonzero((np.diff(at) > 0) & (np.diff(at) <= FIT_LINES))
            rows = [np.ascontiguousarray(x[at[d] : at[d + 1]], dtype=np.float32).tobytes() for d in keep]
            index = pa.array(keep)
            yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(rows, pa.binary())], ["doc_id", "y", "x"])


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", modulus: int = 5, left_out: int = 0, id_col: str = "doc_id", text_col: str = "text") -> Field:
    """Fit on at most FIT_DOCS labelled documents of at most FIT_LINES lines outside the held-out fold."""
    chosen = sample(docs, labels, label=label, modulus=modulus, left_out=left_out, most=FIT_DOCS, id_col=id_col, text_col=text_col)
    got = chosen.mapInArrow(_featurise, "doc_id long, y int, x binary").toArrow().sort_by("doc_id")  # bounded by the two constants
    parts = [np.frombuffer(v.as_buffer(), dtype=np.float32).reshape(-1, WIDTH) for c in got.column("x").chunks for v in c]
    at = np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)]).astype(np.int64)
    x = np.concatenate(parts).astype(float) if parts else np.zeros((0, WIDTH))
    return fit(x, at, got.column("y").to_numpy().astype(np.int64))


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = model.value
        for batch in batches:
            for part in K.passes(batch, "text"):
                data, offsets = K.buffers(part.column(part.schema.get_field_index("text")))
                if len(data) > K.PASS_BYTES:  # one text
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array([round(min(max(long_score(data, field, K.PASS_BYTES), 0.0), 1.0), 9)])], ["doc_id", "score"])
                    continue
                x, size, at = line_features(data, offsets)
                if field.constant is None:
                    good, _ = marginals(field.odds(x), at, field.moves)
                    score = np.zeros(len(at) - 1)
                    some = np.flatnonzero(np.diff(at))
                    if len(some):  # sums of a document's own lines, so that a score does not depend on what is read beside it
                        score[some] = np.add.reduceat(good * size, at[some]) / np.add.reduceat(size, at[some])
                else:
                    score = np.where(np.diff(at) > 0, field.constant, 0.0)
                # nine places: what is left of the order in which a batch's products are summed is cut off
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.round(np.clip(score, 0.0, 1.0), 9))], ["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, field: Field, *, modulus: int = 5, left_out: int = 0, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: better) and predicted of every whole text, a row for each row of ``docs``.

    A text without words (null, blank) has no good line: its score is 0.  A null id is in no fold (held_out is
    false).  Without labels of both kinds the score of texts with words is the share of good ones, 0.5 without
    any.  Repeated rows, further columns of any name and an empty table are fine.
    """
    model = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    scored = rows.mapInArrow(_score(model), "doc_id long, score double")
    held = F.coalesce(crc_of(F.col("doc_id")) % modulus == left_out, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, field: Field, *, threshold: float = 0.3, text_col: str = "text") -> DataFrame:
    """``docs`` with the rows whose text scores ``threshold`` or more, in all their columns (whatever their names)."""
    model = docs.sparkSession.sparkContext.broadcast(field)
    names, inner = docs.columns, f"c{docs.columns.index(text_col)}"
    plain = docs.toDF(*(f"c{i}" for i in range(len(names))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = _score(model)
        for batch in batches:
            for part in K.passes(batch, inner):
                column = part.column(part.schema.get_field_index(inner))
                got = list(score(iter([pa.RecordBatch.from_arrays([column, column], ["id", "text"])])))
                marks = np.concatenate([g.column(1).to_numpy() for g in got]) if got else np.zeros(0)
                yield part.filter(pa.array(marks >= threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*names)

"""Document fingerprints of closed syncmers (operator 8).

A k-mer of bytes is an anchor if the least of its inner s-mers (by a stirred value) stands at either edge.  That
depends on the k-mer alone, so a passage has the same anchors wherever it stands; edits touch only the
anchors they overlap.  A fingerprint is a share of a text's anchors, those with the least hashes, with their places; the
share is fixed, so fingerprints grow with their texts.  Two fingerprints are matched by place: shared anchors count as
far as they stand in the same order in both texts.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .licenses import sliding_min

U = np.uint64
S, KMER = 8, 16
#: Anchors that a fingerprint keeps: LEAST, or one in SHARE where that is more.
LEAST, SHARE = 64, 8
#: Text that a range of neighbouring documents holds, about, and the ranges at most; a range streams through its task.
RANGE_BYTES, MOST_RANGES = 12 << 20, 20_000


def anchors_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Place (byte in the buffer), hash and document of each anchor; a text without a closed syncmer is one anchor itself."""
    n, sizes = len(data), np.diff(offsets)
    place, hashes = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=U)
    doc = np.zeros(0, dtype=np.int64)
    if n >= KMER:
        word = data.astype(U)
        for step in (1, 2, 4):
            word = word[: len(word) - step] | word[step:] << U(8 * step)
        inner = KMER - S + 1
        order = word * U(0x9E3779B97F4A7C15)
        order ^= order >> U(29)
        order *= U(0xBF58476D1CE4E5B9)
        order ^= order >> U(32)
        many = n - KMER + 1
        least = sliding_min(order, inner)[:many]
        chosen = np.flatnonzero((order[:many] == least) | (order[inner - 1 : inner - 1 + many] == least))
        owner = np.searchsorted(offsets, chosen, "right") - 1
        inside = chosen + KMER <= offsets[owner + 1]
        place, doc = chosen[inside], owner[inside]
        hashes = K.mix(word[place] * U(0xC2B2AE3D27D4EB4F) + K.mix(word[place + KMER - S]))
    short = np.flatnonzero((sizes > 0) & (np.bincount(doc, minlength=len(sizes)) == 0))
    if len(short):
        own = np.array([int.from_bytes(hashlib.blake2b(data[offsets[d] : offsets[d + 1]].tobytes(), digest_size=8).digest(), "little") for d in short], dtype=U)
        place, hashes, doc = np.concatenate([place, offsets[short]]), np.concatenate([hashes, own]), np.concatenate([doc, short])
        again = np.argsort(doc, kind="stable")
        place, hashes, doc = place[again], hashes[again], doc[again]
    return place, hashes, doc


def fingerprints_of(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    """The kept anchors of each text: distinct 32-bit hashes in ascending order, and the byte place where each first stands."""
    data, offsets = K.buffers(pa.array(texts, pa.large_string()))
    place, hashes, doc = anchors_of(data, offsets)
    low = (hashes >> U(32)).astype(np.uint32)
    at = np.searchsorted(doc, np.arange(len(texts) + 1))
    out = []
    for d in range(len(texts)):
        own, where = np.unique(low[at[d] : at[d + 1]], return_index=True)
        keep = max(LEAST, len(own) // SHARE)
        out.append((own[:keep], place[at[d] + where[:keep]] - offsets[d]))
    return out


def in_order(a: np.ndarray, b: np.ndarray) -> int:
    """How many of the pairs of places (a, b) stand in one ascending order on both sides."""
    b = b[np.argsort(a, kind="stable")]
    if (np.diff(b) > 0).all():
        return len(b)
    tails: list[int] = []
    for v in b.tolist():
        i = bisect_left(tails, v)
        if i == len(tails):
            tails.append(v)
        else:
            tails[i] = v
    return len(tails)


def likeness(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Share of the anchors of two texts that match by hash and order; two without anchors are alike.

    The anchors are those below the last hash that both fingerprints reach, so that neither has left any out: the
    share is exact where both are whole, else an estimate over a part that grows with the texts.
    """
    (x, px), (y, py) = a, b
    if not len(x) or not len(y):
        return float(len(x) == len(y))
    whole = [len(h) < LEAST for h in (x, y)]
    ends = [h[-1] for h, w in zip((x, y), whole, strict=True) if not w]
    if ends:
        cut = min(ends)
        nx, ny = np.searchsorted(x, cut, "right"), np.searchsorted(y, cut, "right")
        x, px, y, py = x[:nx], px[:nx], y[:ny], py[:ny]
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    return in_order(px[i], py[j]) / (len(x) + len(y) - len(i))


def written(print_: tuple[np.ndarray, np.ndarray]) -> str:
    """A fingerprint in the order of its text: for each anchor eight hexadecimal digits of its hash and eight of its place."""
    hashes, place = print_
    order = np.argsort(place, kind="stable")
    return np.stack([hashes[order], place[order]], axis=1).astype(">u4").tobytes().hex() if len(hashes) else ""


def anchors(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, position, hash): every anchor of every text with its byte position, for positional matching."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, "text"):
                data, offsets = K.buffers(part.column(1))
                place, hashes, doc = anchors_of(data, offsets)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(doc)), pa.array(place - offsets[doc]), pa.array(hashes.view(np.int64))], ["doc_id", "position", "hash"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, position long, hash long")


# ---------------------------------------------------------------- neighbours in the order of ids


def range_cuts(rows: DataFrame, ranges: int) -> np.ndarray:
    """The last values of ``ord`` of all ranges but the last, of about equal numbers of rows; a value with many rows ends several."""
    if ranges < 2:
        return np.zeros(0, dtype=np.int64)
    shares = [i / ranges for i in range(1, ranges)]
    found = rows.agg(F.percentile_approx("ord", shares, 20 * ranges)).first()[0]  # MOST_RANGES numbers at most
    return np.array(sorted(found or []), dtype=np.int64)


def range_of(cuts: np.ndarray, value: np.ndarray, tie: np.ndarray) -> np.ndarray:
    """Number of the range of each row; rows of a value that ends several are dealt to those by their hash, in its order."""
    low, high = np.searchsorted(cuts, value, "left"), np.searchsorted(cuts, value, "right")
    share = (tie.view(np.uint64) ^ U(1 << 63)) >> U(32)  # the order of a signed hash, from 0 to 2^32
    return low + ((share * (high - low + 1).astype(U)) >> U(32)).astype(np.int64) * (high > low)


def with_next(docs: DataFrame, process, schema: str, *, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Apply ``process(ids, texts, next_texts)`` to runs of neighbours in the order of (doc_id, hash of the text), the first after the last.

    ``docs`` has doc_id and text.  One shuffle by ranges of that order; each range also gets the first document of the
    next one.  A range streams through its task, an Arrow batch at a time.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(-(2**63))).alias("ord"), F.xxhash64(text).alias("tie"), "doc_id", text.alias("text"))
    total = rows.agg(F.sum(F.octet_length("text") + 64)).first()[0] or 0
    ranges = min(-(-total // range_bytes), MOST_RANGES)
    held_cuts = spark.sparkContext.broadcast(range_cuts(rows, ranges))

    @F.pandas_udf("int")
    def place(value: pd.Series, tie: pd.Series) -> pd.Series:
        return pd.Series(range_of(held_cuts.value, value.to_numpy(), tie.to_numpy()))

    placed = rows.withColumn("range", place("ord", "tie"))
    firsts = sorted((r["range"], r["f"]["ord"], r["f"]["tie"]) for r in placed.groupBy("range").agg(F.min(F.struct("ord", "tie")).alias("f")).collect())  # a row for each range
    before = [(firsts[i - 1][0], o, t) for i, (_, o, t) in enumerate(firsts)]
    heads = rows.join(F.broadcast(spark.createDataFrame(before, "goes int, ord long, tie long")), ["ord", "tie"]).groupBy("goes", "ord", "doc_id", "tie").agg(F.min("text").alias("text"))
    every = placed.select("range", F.lit(0).alias("head"), "ord", "tie", "doc_id", "text").unionByName(heads.select(F.col("goes").alias("range"), F.lit(1).alias("head"), "ord", "tie", "doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int | None, str]] = []  # documents whose next is not known or not yet processed
        for batch in batches:
            for part in K.passes(batch, "text", 1 << 20):
                for head, doc, text in zip(*(part.column(i).to_pylist() for i in (1, 4, 5)), strict=True):
                    held.append((doc, text))
                    if head:  # a range ends
                        if len(held) > 1:
                            yield process([d for d, _ in held[:-1]], [t for _, t in held])
                        held = []
                if len(held) > 1:
                    yield process([d for d, _ in held[:-1]], [t for _, t in held])
                    held = held[-1:]

    return every.repartitionById(max(ranges, 1), F.col("range")).sortWithinPartitions("range", "head", "ord", "tie").mapInArrow(run, schema)


EDITED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def edited_fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and their likeness; a row for each row of ``docs``.

    The edited text is the text with its last floor(n / 2) code points replaced by the first as many (or all) of the
    next document in ascending doc_id (after the last: the first; a single document follows itself).  Columns:
    doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    A fingerprint is that of ``written``: a share of all anchors of the text with their places, in hexadecimal.
    A null text counts as empty; an empty text has the empty fingerprint, and two of those are alike (1.0).  Rows
    that repeat a doc_id follow each other in the order of a hash of their texts, rows without one come first.
    Further columns are ignored, an empty table gives an empty result.
    """

    def process(ids: list, texts: list[str]) -> pa.RecordBatch:
        edited = []
        for text, after in zip(texts[:-1], texts[1:], strict=True):
            half = len(text) // 2
            edited.append(text[: len(text) - half] + after[:half])
        own, other = fingerprints_of(texts), fingerprints_of(edited)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in texts[:-1]], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited], pa.string()),
                pa.array([written(s) for s in own[:-1]], pa.string()),
                pa.array([written(s) for s in other], pa.string()),
                pa.array([likeness(a, b) for a, b in zip(own, other, strict=False)], pa.float64()),
                pa.array([likeness(a, b) for a, b in zip(own[:-1], own[1:], strict=True)], pa.float64()),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return with_next(plain, process, EDITED)

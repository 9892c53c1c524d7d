"""Byte-level BPE over whole texts (operators 4 and 10): overlapping chunks, resynchronised and spliced.

Texts of up to ``chunk_chars`` are encoded where they are read.  Longer ones are cut into overlapping chunks that
Spark deals out; neighbours are spliced at a position where both begin a pre-token and neither could have been
misled by its own ends.  A left-to-right scan depends only on what follows the place it stands at.  So a chunk's scan is
that of the whole text from its first seam on (a place where every scan begins a pre-token, see SEAM), and two chunks
that begin a pre-token at one place, the left one past a seam, agree from there on.  That makes the piece behind a splice
right.  The piece before it is right too, since no splice stands behind white space: all pre-tokens before the place lie
within the piece, none can be longer for want of what follows, and the one pattern that looks ahead, white space not before
something else, looks from the end of a run of white space, which then ends inside the piece.  Where two chunks do not
align, the overlap is widened to all of both: they are joined and encoded as one, once.
"""

from __future__ import annotations

import base64
import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import materialize

CHUNK_CHARS = 1 << 15
OVERLAP_CHARS = 1 << 9
#: Long texts that a task encodes, and the tasks at most; chunks whose places a task may be given whole (10 MB).
TASK_BYTES, MOST_TASKS, FEW_CHUNKS = 4 << 20, 50_000, 200_000
#: A pre-token is stable if the scan that found it saw so many characters past its end before the chunk ended
#: (contractions look three characters ahead of their start, white space one past its run).
MARGIN = 4
#: Two characters between which every pre-token pattern of this family ends one: white space after something else, or a
#: change of kind among letters, digits and other characters (but not into letters from others: a contraction crosses that).
SEAM = regex.compile(r"\S\s|\p{L}[^\s\p{L}]|\p{N}[^\s\p{N}]|[^\s\p{L}\p{N}]\p{N}")
#: Characters that some Unicode version counts as white space and the running one may not.
ONCE_BLANK = "\u180e\u200b\u2060\ufeff"
#: Places of an overlap that a word of its bitmap holds (half of a long, so that no sign is in the way).
WORD = 32


# ---------------------------------------------------------------- tokenizers of a worker


class Ranks:
    """A rank file with the decimal and the raw bytes of every id, for encoding and decoding in bulk."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.core = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)
        size = max(ranks.values()) + 1
        raw = [b""] * size
        for token, rank in ranks.items():
            raw[rank] = token
        self.raw = np.array(raw, dtype=object)
        decimals = [b"%d " % i for i in range(size)]
        width = max(map(len, decimals))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in decimals), dtype=np.uint8).reshape(size, width)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.core.encode_ordinary(text), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(self.raw[ids].tolist())

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a space."""
        spread = self.digits[ids].ravel()
        return spread[spread != 0].tobytes()


@lru_cache(maxsize=4)
def ranks_of(path: str, pattern: str) -> Ranks:
    return Ranks(path, pattern)


@lru_cache(maxsize=4)
def tokenizer_of(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Counter:
    """Counts of a tokenizer file.  Byte-level BPE encodes each pre-token by itself, so the counts of pre-tokens are kept.

    Texts with a special string, or with characters whose class may differ between Unicode versions, go through
    the library whole.
    """

    #: Characters of a class that has not changed since Unicode 6.
    SETTLED = regex.compile("[^\\x00-\u024f\u0400-\u04ff\u2010-\u2027\u20ac\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")
    KEPT = 400_000

    def __init__(self, path: str):
        self.model = tokenizer_of(path)
        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        before = shape["pre_tokenizer"] or {}
        self.splits = shape["normalizer"] is None and before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space")
        added = self.model.get_added_tokens_decoder().values()
        self.special = [x.content for x in added]
        self.plain = not any(x.lstrip or x.rstrip or x.single_word for x in added)
        self.cut = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        #: A special string that an end of a chunk cuts has fewer characters than this.
        self.reach = max(map(len, self.special), default=0)
        self.words = regex.compile(BYTE_LEVEL)
        self.known: dict[str, int] = {}

    def __call__(self, text: str) -> int:
        if not self.splits or any(x in text for x in self.special) or not text.isascii() and self.SETTLED.search(text):
            return len(self.model.encode_batch_fast([text], add_special_tokens=False)[0])
        words = self.words.findall(text)
        known = self.known
        try:
            return sum(map(known.__getitem__, words))
        except KeyError:
            pass
        if len(known) > self.KEPT:
            known.clear()
        new = list({w for w in words if w not in known})
        known.update(zip(new, map(len, self.model.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return sum(map(known.__getitem__, words))

    def pre_tokens(self, text: str) -> Iterator[tuple[int, int]]:
        """Ends of the library's own pre-tokens, and of special strings."""
        at = 0
        for low, high in [*(m.span() for m in self.cut.finditer(text)), (len(text), len(text))] if self.cut else [(len(text), len(text))]:
            part = text[at:low]
            # where no character's class is in doubt, the pattern itself is the quicker of two equal ways
            found = (m.span() for m in self.words.finditer(part)) if part.isascii() or not self.SETTLED.search(part) else (s for _, s in self.model.pre_tokenizer.pre_tokenize_str(part))
            yield from ((at + a, at + b) for a, b in found)
            if high > low:
                yield low, high
            at = high


#: Fixed value: the pre-token pattern of byte-level tokenizer files.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(maxsize=4)
def counter_of(path: str) -> Counter:
    return Counter(path)


# ---------------------------------------------------------------- chunks


CHUNK = "key long, doc_id long, n_bytes long, chunk int, low long, text string, last boolean"
EDGES = "head array<long>, tail array<long>, synced boolean"


def keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(key, doc_id, n_bytes, text): key tells rows apart even where doc_id repeats or is null."""
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def chunked(rows: DataFrame, *, chunk_chars: int, overlap_chars: int) -> DataFrame:
    """Texts longer than ``chunk_chars`` in chunks: c covers [c * chunk_chars, (c + 1) * chunk_chars + overlap)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("chunk", pa.int32()), ("low", pa.int64()), ("text", pa.string()), ("last", pa.bool_())])
        for batch in batches:
            for key, doc, size, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                lows = range(0, len(text), chunk_chars)
                for c, low in enumerate(lows):
                    yield pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "n_bytes": size, "chunk": c, "low": low, "text": text[low : low + chunk_chars + overlap_chars], "last": c == len(lows) - 1}], schema=fields)

    long_ones = rows.where(F.length("text") > chunk_chars)
    size = long_ones.agg(F.sum("n_bytes")).first()[0] or 0
    return long_ones.mapInArrow(run, CHUNK).repartition(min(MOST_TASKS, max(1, -(-size // TASK_BYTES))), "key", "chunk")


def stable_starts(length: int, ends: Iterator[tuple[int, int]], whole: bool, margin: int = MARGIN) -> list[int]:
    """Starts of pre-tokens that the end of a cut text can't have touched, and the start after the last of them."""
    limit = length if whole else length - margin
    out = []
    for start, end in ends:
        out.append(start)
        if start + margin > limit and not whole or end > limit:
            break
    return out


def edges_of(text: str, starts: list[int], *, chunk_chars: int, overlap_chars: int, reach: int = 0) -> tuple[list[int], list[int], bool]:
    """Bitmaps of the starts in the overlaps with the chunk before (head) and after (tail), and whether a seam lies before the tail.

    The tail leaves out starts behind white space: a text that ends there is split otherwise than one that goes on.  The first ``reach`` characters may belong to a special string that began before.
    """
    words = -(-overlap_chars // WORD)
    head, tail = [0] * words, [0] * words
    for s in starts:
        if s < overlap_chars:
            head[s // WORD] |= 1 << s % WORD
        if chunk_chars <= s < chunk_chars + overlap_chars and s and not (text[s - 1].isspace() or text[s - 1] in ONCE_BLANK):
            tail[(s - chunk_chars) // WORD] |= 1 << (s - chunk_chars) % WORD
    known = set(starts)
    synced = any(m.start() + 1 in known for m in SEAM.finditer(text, reach, chunk_chars, overlapped=True))
    return head, tail, synced


def splices(chunks: DataFrame, chunk_chars: int) -> DataFrame:
    """(key, chunk, begin, end, piece, alone): where each chunk's own text begins and ends, and the piece it is part of.

    A piece begins where two chunks align; chunks that do not align with the one before go on with its piece, from
    where that one's text ended.  Only bitmaps of the overlaps are shuffled by document.
    """
    own = Window.partitionBy("key").orderBy("chunk")
    few = chunks.select("key", "chunk", "low", F.length("text").alias("size"), "last", "head", F.when(F.col("synced") | (F.col("chunk") == 0), F.col("tail")).alias("tail"))
    lowest = lambda a, b: F.array_min(F.filter(F.transform(F.zip_with(a, b, lambda x, y: x.bitwiseAND(y)), lambda w, i: F.when(w != 0, i * WORD + F.bit_count(w.bitwiseAND(-w) - 1))), lambda v: v.isNotNull()))
    found = few.withColumn("begin", lowest(F.col("head"), F.lag("tail").over(own))).withColumn("end", lowest(F.col("tail"), F.lead("head").over(own)))
    nominal = F.col("low") + F.when(F.col("last"), F.col("size")).otherwise(F.lit(chunk_chars))
    begin, end = F.col("low") + F.coalesce("begin", F.lit(0)), F.coalesce(F.col("low") + chunk_chars + F.col("end"), nominal)
    placed = found.select("key", "chunk", begin.alias("begin"), end.alias("end"), F.sum(F.col("begin").isNotNull().cast("long")).over(own).alias("piece"), (F.col("last") | F.col("end").isNotNull()).alias("ends"), (F.col("begin").isNotNull() | (F.col("chunk") == 0)).alias("begins"))
    return placed.select("key", "chunk", "begin", "end", "piece", (F.col("begins") & F.col("ends")).alias("alone"))


def joined_pieces(cut: DataFrame, process, schema: str) -> DataFrame:
    """Apply ``process(key, doc_id, n_bytes, piece, text)`` to the joined texts of pieces of several chunks (key, doc_id, n_bytes, piece, chunk, own)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = None, []
        for batch in batches:
            for *name, text in zip(*(batch.column(i).to_pylist() for i in (0, 1, 2, 3, 5)), strict=True):
                if held is not None and held != name:
                    yield process(*held, "".join(words))
                    words = []
                held = name
                words.append(text)
        if held is not None:
            yield process(*held, "".join(words))

    several = cut.where("not alone").select("key", "doc_id", "n_bytes", "piece", "chunk", "own")
    return several.repartition("key", "piece").sortWithinPartitions("key", "piece", "chunk").mapInArrow(run, schema)


def _cut(chunks: DataFrame, chunk_chars: int) -> DataFrame:
    """``chunks`` with their splices and ``own``, the text that no other chunk has."""
    own = F.col("text").substr((F.col("begin") - F.col("low")).cast("int") + 1, (F.col("end") - F.col("begin")).cast("int"))
    places = splices(chunks, chunk_chars)
    # counted: so few go to the tasks, and the texts stay where they are; more are joined by a shuffle
    places = F.broadcast(places) if chunks.count() <= FEW_CHUNKS else places
    return chunks.join(places, ["key", "chunk"]).withColumn("own", own)


# ---------------------------------------------------------------- encoding and decoding (operator 4)

ENCODED = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def encode_decode(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, with_ids: bool = False) -> DataFrame:
    """Encode each whole text and decode the ids again; a row for each row of ``docs``.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by one space), decoded_sha256 (of the decoded
    bytes), and with ``with_ids`` also ids and decoded (binary), which hold a whole document in one row.
    A null text counts as empty: no tokens, digests of the empty string.  Repeated rows and ids, null ids, further
    columns of any name and an empty table are fine.
    """
    rows = keyed(docs, id_col, text_col)
    extra = ", ids array<int>, decoded binary" if with_ids else ""

    def finish(doc, count, ids_hash, raw_hash, ids, raw) -> dict:
        out = {"doc_id": doc, "n_tokens": count, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": raw_hash.hexdigest()}
        return out | ({"ids": np.concatenate(ids).tolist() if ids else [], "decoded": b"".join(raw)} if with_ids else {})

    def table(done: list[dict]) -> pa.RecordBatch:
        fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
        return pa.RecordBatch.from_pylist(done, schema=pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.binary())] * with_ids))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks_of(ranks_path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part, done = batch.slice(at, 128), []
                for doc, text in zip(part.column(1).to_pylist(), part.column(3).to_pylist(), strict=True):
                    ids = bpe.encode(text)
                    raw = bpe.decode(ids)
                    done.append(finish(doc, len(ids), hashlib.sha256(bpe.decimals(ids)[:-1]), hashlib.sha256(raw), [ids], [raw]))
                yield table(done)

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ranks_of(ranks_path, pattern)
        for batch in batches:
            found = []
            for text, last in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                starts = stable_starts(len(text), (m.span() for m in bpe.pattern.finditer(text)), last)
                found.append(edges_of(text, starts, chunk_chars=chunk_chars, overlap_chars=overlap_chars))
            head, tail, synced = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64())), pa.array(synced, pa.bool_())], [*batch.schema.names, "head", "tail", "synced"])

    piece_schema = "key long, doc_id long, piece long, ids binary"
    fields = pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int64()), ("ids", pa.binary())])

    def several(key, doc, _, piece, text) -> pa.RecordBatch:
        ids = ranks_of(ranks_path, pattern).encode(text)
        return pa.RecordBatch.from_pylist([{"key": key, "doc_id": doc, "piece": piece, "ids": ids.tobytes()}], schema=fields)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, doc, piece, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield several(key, doc, None, piece, text)

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Digests over the pieces of a document in their order, a piece in memory at a time."""
        bpe, held, state = ranks_of(ranks_path, pattern), None, None
        for batch in batches:
            for key, doc, packed in zip(*(batch.column(i).to_pylist() for i in (0, 1, 3)), strict=True):
                if held != key:
                    if held is not None:
                        yield table([finish(*state)])
                    held, state = key, [doc, 0, hashlib.sha256(), hashlib.sha256(), [], []]
                ids = np.frombuffer(packed, dtype=np.int32)
                raw = bpe.decode(ids)
                text = bpe.decimals(ids)[:-1]
                state[2].update(b" " + text if state[1] and text else text)
                state[3].update(raw)
                state[1] += len(ids)
                if with_ids:
                    state[4].append(ids)
                    state[5].append(raw)
        if held is not None:
            yield table([finish(*state)])

    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, ENCODED + extra)
    chunks = materialize(chunked(rows, chunk_chars=chunk_chars, overlap_chars=overlap_chars).mapInArrow(edges, f"{CHUNK}, {EDGES}"), "chunks")
    cut = _cut(chunks, chunk_chars)
    encoded = cut.where("alone").select("key", "doc_id", "piece", "own").mapInArrow(alone, piece_schema).unionByName(joined_pieces(cut, several, piece_schema))
    return short.unionByName(encoded.repartition("key").sortWithinPartitions("key", "piece").mapInArrow(joined, ENCODED + extra))


# ---------------------------------------------------------------- counts (operator 10)


def count_tokens(docs: DataFrame, *, tokenizer_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text", chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS) -> DataFrame:
    """Tokens of each whole text as the tokenizer file gives them: doc_id, n_bytes, n_tokens, over_limit, a row for each row of ``docs``.

    Special strings inside a text are handled as the tokenizer does by default; none are added.  Overlapping chunks of
    huge documents are encoded with offsets, and the tokens between two splices are counted by where they begin; the
    splices are common starts of the library's own pre-tokens.  Only chunks that don't align are encoded again, once,
    as the one text they make up.  A tokenizer file that doesn't encode pre-tokens each by itself, or whose special strings
    take in blanks around them, is given every text whole.
    A null text counts as empty.  Repeated rows and ids, null ids, further columns of any name and an empty
    table are fine.
    """
    rows = keyed(docs, id_col, text_col)
    result = "key long, doc_id long, n_bytes long, n_tokens long"
    names = ["key", "doc_id", "n_bytes", "n_tokens"]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array([count(t) for t in part.column(3).to_pylist()], pa.int64())], names)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter_of(tokenizer_path)
        for batch in batches:
            found, places = [], []
            for text, last in zip(batch.column(5).to_pylist(), batch.column(6).to_pylist(), strict=True):
                starts = stable_starts(len(text), count.pre_tokens(text), last, MARGIN + count.reach)
                found.append(edges_of(text, starts, chunk_chars=chunk_chars, overlap_chars=overlap_chars, reach=count.reach))
                places.append(np.array([a for a, _ in count.model.encode(text, add_special_tokens=False).offsets], dtype=np.int32).tobytes())
            head, tail, synced = ([f[i] for f in found] for i in range(3))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(head, pa.list_(pa.int64())), pa.array(tail, pa.list_(pa.int64())), pa.array(synced, pa.bool_()), pa.array(places, pa.binary())], [*batch.schema.names, "head", "tail", "synced", "places"])

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = []
            for packed, begin, end in zip(batch.column(3), batch.column(4).to_pylist(), batch.column(5).to_pylist(), strict=True):
                places = np.frombuffer(packed.as_buffer(), dtype=np.int32)
                counts.append(int(np.count_nonzero((places >= begin) & (places < end))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(counts, pa.int64())], names)

    def several(key, doc, size, _, text) -> pa.RecordBatch:
        n = len(tokenizer_of(tokenizer_path).encode_batch_fast([text], add_special_tokens=False)[0])
        return pa.RecordBatch.from_arrays([pa.array([v], pa.int64()) for v in (key, doc, size, n)], names)

    known = counter_of(tokenizer_path)
    limit_flag = (F.col("n_tokens") > limit).alias("over_limit")
    if not (known.splits and known.plain):
        return rows.mapInArrow(whole, result).select("doc_id", "n_bytes", "n_tokens", limit_flag)
    short = rows.where(F.length("text") <= chunk_chars).mapInArrow(whole, result)
    chunks = materialize(chunked(rows, chunk_chars=chunk_chars, overlap_chars=overlap_chars).mapInArrow(encode, f"{CHUNK}, {EDGES}, places binary"), "chunks")
    cut = _cut(chunks, chunk_chars)
    counted = cut.where("alone").select("key", "doc_id", "n_bytes", "places", (F.col("begin") - F.col("low")).alias("begin"), (F.col("end") - F.col("low")).alias("end")).mapInArrow(alone, result)
    counted = counted.unionByName(joined_pieces(cut, several, result)).groupBy("key", "doc_id", "n_bytes").agg(F.sum("n_tokens").alias("n_tokens"))
    return short.unionByName(counted).select("doc_id", "n_bytes", "n_tokens", limit_flag)

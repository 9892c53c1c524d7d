"""Byte-level BPE by a tokenization automaton (operator 11).

The merges are compiled, one after another, into a deterministic automaton whose arcs are labelled with tokens and whose
paths are exactly the token sequences that the merges leave behind.  It begins with one state and a loop for each byte.
The gadget of a merge (a, b) -> c splits the state that a leads to, so that what follows a can no longer be b, and gives
c an arc wherever a has one, to the state that b leads to.  All arcs of one label lead to one state, so states and labels
are kept as classes: a table of bits, one for each state and column, holds every arc.

A string has one path.  Therefore each prefix of a word has one last token: among the tokens that end there (the words
of the vocabulary are found by an Aho-Corasick table) the one with an arc from the state of the prefix before it.  A word
takes one pass from left to right, whatever its length.  Decoding writes out the labels of the arcs.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.session import ship_code

from .bpe import BYTE_LEVEL, Counter, tokenizer_of

#: Words whose ids a worker keeps; characters of a text that are split at a time.
KEPT_WORDS, BLOCK_CHARS = 400_000, 1 << 20
#: Behind a visible ASCII character and before a space or line break every pre-token ends, and none looks back.
SAFE = regex.compile(r"[!-~](?=[ \n])")
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in byte-level files: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(others)}


class Automaton:
    """The automaton of a list of merges: ``state_of[token]``, ``column_of[token]`` and the bit table ``rows``; state 0 begins."""

    def __init__(self, base: Iterable[int], merges: list[tuple[int, int, int]]):
        """``base``: ids of single bytes.  ``merges``: (left, right, result) in their order.

        Each result must be new, and made of tokens that exist by then: else one path for a string is not certain.
        """
        base = list(base)
        self.state_of, self.column_of = dict.fromkeys(base, 0), dict.fromkeys(base, 0)
        #: labels that lead to a state or share a column; the start is held by a label of its own
        leading, sharing = [len(base) + 1], [len(base)]
        arcs = np.zeros((256, 32), dtype=np.uint8)  # a bit for each column
        arcs[0, 0] = 1
        never = set()  # tokens that no string leads to, since an earlier merge takes their parts apart
        for left, right, made in merges:
            if made in self.state_of or made in never or any(x not in self.state_of and x not in never for x in (left, right)):
                raise ValueError(f"merge of {left} and {right} into {made} is out of order or not the only one")
            if left in never or right in never or not arcs[self.state_of[left], self.column_of[right] >> 3] >> (self.column_of[right] & 7) & 1:
                never.add(made)
                continue
            # the result goes on like its right part and stands where its left part may stand
            self.state_of[made], self.column_of[made] = self.state_of[right], self.column_of[left]
            leading[self.state_of[made]] += 1
            sharing[self.column_of[made]] += 1
            state = self.state_of[left]
            if leading[state] > 1:
                leading[state] -= 1
                leading.append(1)
                if len(leading) > len(arcs):
                    arcs = np.concatenate([arcs, np.zeros((len(arcs) // 2, arcs.shape[1]), dtype=np.uint8)])
                arcs[len(leading) - 1] = arcs[state]
                state = self.state_of[left] = len(leading) - 1
            column, moved = self.column_of[right], [right, made] if left == right else [right]
            if sharing[column] > len(moved):
                sharing[column] -= len(moved)
                sharing.append(len(moved))
                if len(sharing) > 8 * arcs.shape[1]:
                    arcs = np.concatenate([arcs, np.zeros((len(arcs), arcs.shape[1] // 2), dtype=np.uint8)], axis=1)
                new, used = len(sharing) - 1, len(leading)
                arcs[:used, new >> 3] |= (arcs[:used, column >> 3] >> (column & 7) & 1) << (new & 7)
                column = new
                for label in moved:
                    self.column_of[label] = column
            # of a run of one token the pairs are taken from the left, so neither it nor its double may follow it
            arcs[state, column >> 3] &= 255 ^ 1 << (column & 7)
        self.rows = [r.tobytes() for r in arcs[: len(leading), : -(-len(sharing) // 8)]]

    def follows(self, before: int | None, token: int) -> bool:
        """Whether an arc of ``token`` leaves the state that ``before`` leads to (None: the start)."""
        if token not in self.column_of:
            return False
        column = self.column_of[token]
        return bool(self.rows[0 if before is None else self.state_of[before]][column >> 3] >> (column & 7) & 1)


class Transducer:
    """A byte-level BPE file as an automaton with the bytes of each label.

    Refused (ValueError): files with a normalizer, another pre-tokenizer, dropout, affixes or an unknown token, without
    a token for each byte, or with added tokens that take in blanks or stand as single words only.
    """

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            shape = json.load(f)
        model, before = shape["model"], shape["pre_tokenizer"] or {}
        split = Counter(path)
        if not (split.splits and split.plain) or model["type"] != "BPE" or (shape["decoder"] or {}).get("type") != "ByteLevel" or model.get("ignore_merges") or model.get("dropout") or any(model.get(k) for k in ("unk_token", "continuing_subword_prefix", "end_of_word_suffix")):
            raise ValueError(f"not a plain byte-level BPE file: {before.get('type')}")
        of, vocab = byte_characters(), model["vocab"]
        base = [vocab[c] for c in of if c in vocab]
        if len(base) < 256:
            raise ValueError("a byte has no token")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(base, [(vocab[a], vocab[b], vocab[a + b]) for a, b in merges])
        raw = lambda t: bytes(of[c] for c in t) if all(c in of for c in t) else t.encode()
        self.added = {x.content: i for i, x in tokenizer_of(path).get_added_tokens_decoder().items()}
        known = {i: raw(t) for t, i in vocab.items()} | {i: raw(t) for t, i in self.added.items()}
        size = max(known) + 1
        self.labels = np.array([known.get(i, b"") for i in range(size)], dtype=object)
        decimals = [b"%d," % i for i in range(size)]
        width = max(map(len, decimals))
        self.digits = np.frombuffer(b"".join(d.ljust(width, b"\0") for d in decimals), dtype=np.uint8).reshape(size, width)
        self.ends = ahocorasick.Automaton()
        for token in self.automaton.state_of:
            self.ends.add_word(known[token].decode("latin-1"), (len(known[token]), token, self.automaton.state_of[token], self.automaton.column_of[token] >> 3, 1 << (self.automaton.column_of[token] & 7)))
        self.ends.make_automaton()
        self.splitter, self.words = split, regex.compile(BYTE_LEVEL)
        self.kept: dict[str, bytes] = {}

    def word(self, word: str) -> bytes:
        """The ids of one pre-token, as packed 32-bit integers."""
        text = word.encode("utf-8").decode("latin-1")
        n, rows = len(text), self.automaton.rows
        state, token, begin = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        state[0] = 0
        for end, (size, label, to, place, bit) in self.ends.iter(text):
            at = end + 1
            if state[at] < 0 and rows[state[at - size]][place] & bit:
                state[at], token[at], begin[at] = to, label, at - size
        out, at = [], n
        while at:
            out.append(token[at])
            at = begin[at]
        return np.array(out[::-1], dtype=np.int32).tobytes()

    def pieces(self, text: str) -> Iterator[str | int]:
        """Stretches of a text between which no pre-token goes, and the ids of added tokens in their places."""
        at = 0
        cut = self.splitter.cut.finditer(text) if self.splitter.cut else ()
        for low, high, found in [*((*m.span(), m.group()) for m in cut), (len(text), len(text), None)]:
            while at < low:
                safe = SAFE.search(text, at + BLOCK_CHARS, low) if low - at > BLOCK_CHARS else None
                end = safe.end() if safe else low
                yield text[at:end]
                at = end
            if found is not None:
                yield self.added[found]
            at = high

    def encode(self, text: str) -> Iterator[np.ndarray]:
        """The ids of a whole text, a stretch at a time."""
        kept = self.kept
        for piece in self.pieces(text):
            if isinstance(piece, int):
                yield np.array([piece], dtype=np.int32)
                continue
            if piece.isascii() or not Counter.SETTLED.search(piece):
                words = self.words.findall(piece)
            else:  # the class of a character may differ between Unicode versions: split as the library does
                words = [piece[a:b] for _, (a, b) in self.splitter.model.pre_tokenizer.pre_tokenize_str(piece)]
            try:
                packed = b"".join(map(kept.__getitem__, words))
            except KeyError:
                if len(kept) > KEPT_WORDS:
                    kept.clear()
                for w in words:
                    if w not in kept:
                        kept[w] = self.word(w)
                packed = b"".join(map(kept.__getitem__, words))
            yield np.frombuffer(packed, dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """The labels of a path, end to end."""
        return b"".join(self.labels[ids].tolist())

    def decimals(self, ids: np.ndarray) -> bytes:
        """The ids in decimal, each followed by a comma."""
        spread = self.digits[ids].ravel()
        return spread[spread != 0].tobytes()


@lru_cache(maxsize=2)
def transducer_of(path: str) -> Transducer:
    return Transducer(path)


def encode_decode(docs: DataFrame, *, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode each whole text by the automaton of a tokenizer file and decode the ids again; a row for each row of ``docs``.

    Columns: doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text in
    UTF-8), and with ``with_ids`` also ids and decoded, which hold a whole document.  Added tokens inside a text are taken
    as the library does by default; none are added at the ends.  The table is compiled once in each worker; its size
    follows the vocabulary alone.  A text is split and encoded a stretch at a time, so besides the text itself memory does
    not grow with it, unless it has no space or line break at all.
    A null text counts as empty: no tokens, digests of the empty string.  Repeated rows and ids, null ids, further
    columns of any name and an empty table are fine.
    """
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    fields = [("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]
    schema = pa.schema(fields + [("ids", pa.list_(pa.int32())), ("decoded", pa.string())] * with_ids)

    def row(transducer: Transducer, doc: int | None, text: str) -> dict:
        ids_hash, text_hash, count, kept, spelled = hashlib.sha256(), hashlib.sha256(), 0, [], []
        for ids in transducer.encode(text):
            if not len(ids):
                continue
            ids_hash.update(b"," * (count > 0) + transducer.decimals(ids)[:-1])
            raw = transducer.decode(ids)
            text_hash.update(raw)
            count += len(ids)
            if with_ids:
                kept.append(ids)
                spelled.append(raw)
        out = {"doc_id": doc, "n_tokens": count, "ids_sha256": ids_hash.hexdigest(), "decoded_sha256": text_hash.hexdigest()}
        return out | ({"ids": np.concatenate(kept).tolist() if kept else [], "decoded": b"".join(spelled).decode("utf-8", "replace")} if with_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transducer = transducer_of(tokenizer_path)
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                yield pa.RecordBatch.from_pylist([row(transducer, d, t) for d, t in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True)], schema=schema)

    return rows.mapInArrow(run, RESULT + (", ids array<int>, decoded string" if with_ids else ""))

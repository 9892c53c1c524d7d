"""Spelling variants: words within one edit of each other, and the common form of each (operator 12).

Words are dealt to tasks by positional q-grams, and a task looks for partners in an inverted index of positional q-grams:

* Length limit: partners differ by one code point in length at most.  Position limit: a q-gram stands at one place in
  both, or one place further on in the longer word.
* One edit touches q q-grams of a word at most, so partners share ``longer - 2q + 1`` of them or more (the count filter).
* Order all q-grams by how many words have them, rarest first.  Of the shared ones the first two are among the first
  q + 2 of either word, since q at most are not shared.  So a word is indexed under each pair of its first q + 2, with
  their places and its length, and a shorter partner finds it by its own pairs, shifted as an insertion may shift them.
* In the index of one such key the postings of the other q-grams are merged by a heap, ids with enough hits are verified,
  and a pair is given out under the key of its first two shared q-grams alone: once in all.

Keys with more than ``BLOCK`` words are split into chunks that meet each other, so no task holds more; nothing is dropped.
"""

from __future__ import annotations

import heapq
import math
from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.session import ship_code
from wharfline.shared import checked_broadcast, materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters of a run, and the q-grams' length; a word has KEYED of its rarest q-grams in keys of two.
LETTERS, Q = "a-zÀ-ÿ", 2
KEYED = Q + 2
#: Words that the index of one key holds at most (a chunk's size varies a little about it).
BLOCK = 2_000
PAIR = "word string, near string, n long, near_n long"


def word_counts(docs: DataFrame, *, least_chars: int = 6, least_count: int = 5, damaged_every: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of the runs of letters in all texts, A-Z as a-z, with ``least_chars`` code points and ``least_count`` occurrences.

    With ``damaged_every``, a run loses one code point where that divides h = crc32 of ``<id>:<run>``: the one at h modulo
    its length.  Null texts have no words, a null id is written as nothing; repeated rows count each.
    """
    # a shorter run can't give a word, so the pattern takes whole runs of that length only
    folded = F.translate(F.coalesce(F.col(f"`{text_col}`"), F.lit("")), UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(folded, F.lit(f"[{LETTERS}]{{{least_chars},}}+"), 0)).alias("word"))
    if damaged_every is not None:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word").cast("binary")), F.length("word")
        at = (h % size).cast("int")
        runs = runs.withColumn("word", F.when(h % damaged_every == 0, F.concat(F.col("word").substr(F.lit(1), at), F.col("word").substr(at + 2, size))).otherwise(F.col("word")))
    return runs.where(F.length("word") >= least_chars).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def rarest_grams(words: DataFrame) -> DataFrame:
    """(word, n, first): the places and letters of the KEYED q-grams of each word that the fewest words have, in that order."""
    size = F.length("word")
    grams = words.select("word", "n", F.posexplode(F.transform(F.sequence(F.lit(1), size - (Q - 1)), lambda i: F.col("word").substr(i, F.lit(Q)))).alias("place", "gram"))
    # as many rows as two letters of the alphabet make (90 squared for LETTERS)
    known = checked_broadcast(grams.groupBy("gram").agg(F.count("*").alias("seen")))
    order = F.struct("seen", "gram", "place")
    return grams.join(known, "gram").groupBy("word", "n").agg(F.slice(F.sort_array(F.collect_list(order)), 1, KEYED).alias("first"))


def _keys(first: Column, size: Column, shifts: list[tuple[int, int]]) -> Column:
    """The keys of each pair of ``first``: letters, places moved on by ``shifts`` (lower, higher place), and a length."""
    out = []
    for i, j in combinations(range(KEYED), 2):
        ends = [F.struct(first[k]["place"].alias("place"), first[k]["gram"].alias("gram")) for k in (i, j)]
        low, high = F.least(*ends), F.greatest(*ends)
        out += [F.concat(low["gram"], high["gram"], F.concat_ws(",", low["place"] + a, high["place"] + b, size)) for a, b in shifts]
    return F.array_distinct(F.array(*out))


def near_pairs(words: DataFrame, *, block: int = BLOCK) -> DataFrame:
    """(word, near, n, near_n): each two of the distinct ``words`` (word, n) that one inserted, deleted or replaced code point tells apart, once.

    ``near`` is the longer one, or of two equally long ones either.  Words need 6 code points or more: with fewer, two
    near ones need not share two q-grams.  An empty table gives no rows.
    """
    ship_code(words.sparkSession)
    first, size = F.col("first"), F.length("word")
    places = F.concat_ws(",", F.transform("first", lambda x: x["place"]))
    rare = materialize(rarest_grams(words), "spelling-grams")
    # an index row under the word's own length; a probe under the length above, for a partner with one letter more
    index = rare.select(F.explode(_keys(first, size, [(0, 0)])).alias("key"), F.lit(False).alias("probe"), "word", "n", places.alias("places"))
    probes = rare.select(F.explode(_keys(first, size + 1, [(0, 0), (0, 1), (1, 1)])).alias("key"), F.lit(True).alias("probe"), "word", "n", places.alias("places"))
    large = index.groupBy("key").agg(F.count("*").alias("many")).where(F.col("many") > block).select("key", F.ceil(F.col("many") / block).cast("int").alias("chunks"))
    large = checked_broadcast(materialize(large, "spelling-large"))
    chunks = F.coalesce("chunks", F.lit(1))
    own = F.pmod(F.xxhash64("word"), chunks).cast("int")
    # a word of a split key is indexed in its chunk, and looks for equally long partners in the chunks behind it
    spread = F.when(F.col("probe"), F.sequence(F.lit(0), chunks - 1)).otherwise(F.sequence(own, chunks - 1))
    dealt = index.unionByName(probes).join(large, "key", "left").select("key", F.explode(spread).alias("chunk"), "probe", own.alias("own"), "word", "n", "places")
    dealt = dealt.select("key", "chunk", (F.col("probe") | (F.col("chunk") != F.col("own"))).alias("probe"), "word", "n", "places")
    return dealt.repartition("key", "chunk").sortWithinPartitions("key", "chunk", "probe").mapInArrow(_search, PAIR)


def _search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs of the rows of each key and chunk; the indexed words come before those that only look for partners."""
    held, part, index, out = None, None, None, []
    fields = pa.schema([("word", pa.string()), ("near", pa.string()), ("n", pa.int64()), ("near_n", pa.int64())])

    def table(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), fields, strict=True)], schema=fields)

    for batch in batches:
        for key, chunk, probe, word, n, places in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
            if held != key or part != chunk:
                held, part, index = key, chunk, Index(key)
            if index.words:
                index.partners(word, n, out)
            if not probe:
                index.words.append((word, n, places))
        if len(out) > 10_000:
            yield table(out)
            out.clear()
    if out:
        yield table(out)


class Index:
    """The words of one key: postings of their q-grams besides the key's two, by place."""

    def __init__(self, key: str):
        self.key = key
        self.words: list[tuple[str, int, str]] = []
        self.posted = 0

    def post(self) -> None:
        """Postings of the words that have come since the last call."""
        if not self.posted:
            low, high, size = map(int, self.key[2 * Q :].split(","))
            self.size, self.places = size, {low, high}
            #: what a partner shares besides the key's two, one at least in words of 6 code points
            self.least = size - 2 * Q + 1 - 2
            self.others = [p for p in range(size - Q + 1) if p not in self.places]
            self.postings: dict[tuple[int, str], list[int]] = defaultdict(list)
        for at in range(self.posted, len(self.words)):
            word = self.words[at][0]
            for p in self.others:
                self.postings[p, word[p : p + Q]].append(at)
        self.posted = len(self.words)

    def partners(self, word: str, n: int, out: list[tuple[str, str, int, int]]) -> None:
        """Add the pairs of ``word`` with words of the index that belong to this key to ``out``."""
        self.post()
        find, lists = self.postings.get, []
        shorter = len(word) < self.size
        for p in self.others:
            if found := find((p, word[p : p + Q])):
                lists.append(found)
            if shorter and p and (found := find((p, word[p - 1 : p - 1 + Q]))):
                lists.append(found)
        if len(lists) < self.least:
            return
        run, before, least = 0, -1, self.least
        for at in heapq.merge(*lists) if len(lists) > 1 else lists[0]:
            run = run + 1 if at == before else 1
            before = at
            if run == least:
                other, other_n, places = self.words[at]
                if self.first_here(word, other, places):
                    out.append((word, other, n, other_n))

    def first_here(self, word: str, other: str, places: str) -> bool:
        """Whether one edit makes ``other`` of ``word``, and the first two q-grams of ``other`` that it leaves alone are the key's."""
        d = 0
        for a, b in zip(word, other, strict=False):
            if a != b:
                break
            d += 1
        if (word[d:] if len(word) < len(other) else word[d + 1 :]) != other[d + 1 :]:
            return False
        shared = [p for p in map(int, places.split(",")) if p + Q <= d or p > d]
        return set(shared[:2]) == self.places


def variants(words: DataFrame, *, times: int = 5) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of the distinct ``words`` (word, n), a row each.

    ``form`` is the near word with the largest n (ties: the first in code-point order) if that is at least ``times`` n,
    else null; ``root`` follows forms to the last one.  A form has ``times`` the occurrences, so the way to the root has
    no more steps than the logarithm of the largest n, and doubling takes as many rounds as that has bits.
    """
    if times < 2:
        raise ValueError("a form must be more frequent by a factor of two at least")
    words = materialize(words, "spelling-words")
    pairs = near_pairs(words)
    both = pairs.select(F.explode(F.array(F.struct("word", F.col("near").alias("other"), F.col("near_n").alias("other_n")), F.struct(F.col("near").alias("word"), F.col("word").alias("other"), F.col("n").alias("other_n")))).alias("x")).select("x.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct(-F.col("other_n"), "other")).alias("best"))
    form_n = -F.col("best.col1")
    chosen = F.when(form_n >= times * F.col("n"), F.col("best.other"))
    known = materialize(words.join(best, "word", "left").select("word", "n", chosen.alias("form"), F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(chosen.isNotNull(), form_n).alias("form_n")), "spelling-forms")
    links = materialize(known.where("form IS NOT NULL").select("word", F.col("form").alias("root")), "spelling-links")
    most = known.agg(F.max("n")).first()[0] or 1
    for _ in range(math.ceil(math.log2(math.log(most, times) + 2))):
        on = links.select(F.col("word").alias("root"), F.col("root").alias("further"))
        links = materialize(links.join(on, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "spelling-links")
    return known.join(links, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")

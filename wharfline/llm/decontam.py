"""Benchmark decontamination (operator 3): short test items inside long documents.

Items are partitioned by the size of their shingle sets.  An item of a partition is sketched by its k least shingles
under a permutation, with k so large that a document which holds the required share of the item misses all of them at
most once in a million.  Shingles that many items share, such as a common opening, come last: an item is looked for by them
only if its other ones may all be missing.  Documents are not cut down to sketches: each probes all its shingles, so an item is found in
a document of any length.  A document that holds a sketched shingle of an item, and is large enough for the share of
the item's partition, is a candidate; candidates alone are verified, on exact shared counts of the full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.shared import by_ids, checked_broadcast, discard, join_hot, materialize

from . import kernels as K
from .bits import bit_table, bits_set

U = np.uint64
MISS = 1e-6
#: Bits of a filter: grown with the items up to the greater bound (32 MB in each task), beyond which more is joined, not less found.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def partition_of(n: int) -> int:
    """Number of the size partition (2^(p-1), 2^p] that holds n."""
    return max(0, math.ceil(math.log2(max(n, 1))))


def sketch_size(n: int, share: float, usual: int | None = None) -> int:
    """Least shingles to keep of an item with n in all: those of the largest set in its partition.

    With ``usual`` < n the least come from so many of them, and the document may hold all the others; where it may lack
    all of these, so many are kept that it can't lack them all.
    """
    if usual is not None and usual < n:
        absent = n - math.ceil(share * n - 1e-9)
        k, chance = 0, 1.0
        while chance > MISS and k < usual:
            chance *= max(absent - k, 0) / (usual - k)
            k += 1
        return k if chance <= MISS else min(n, absent + 1)
    top = 1 << partition_of(n)
    absent = top - math.ceil(share * top)
    k, chance = 0, 1.0
    while chance > MISS and k < top:
        chance *= max(absent - k, 0) / (top - k)
        k += 1
    return min(n, k)


#: A shingle of more items is one of the last to be looked for; items and ids that a row of a look-up table holds, on average.
HOT_ITEMS, ROW_ITEMS = 64, 256
ITEM = "item_id long, n long, part int, width int, elements binary"
SET = "item long, n long, part int, width int, elements binary, sketch array<long>"


def _items(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, "text"):
                data, offsets = K.buffers(part.column(1))
                elements, at = K.shingle_sets(data, offsets, k)
                words = np.diff(K.words(data, offsets)[3])
                rows = []
                for i, item in enumerate(part.column(0).to_pylist()):
                    own = elements[at[i] : at[i + 1]]
                    if len(own):
                        rows.append({"item_id": item, "n": len(own), "part": partition_of(len(own)), "width": min(int(words[i]), k), "elements": own.tobytes()})
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("item_id", pa.int64()), ("n", pa.int64()), ("part", pa.int32()), ("width", pa.int32()), ("elements", pa.binary())]))

    return run


def _sketched(share: float):
    """Sketches of sets (item, n, part, width, elements, hot): hot shingles after all others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sketches = []
            for packed, hot in zip(batch.column(4), batch.column(5).to_pylist(), strict=True):
                own = np.frombuffer(packed.as_buffer(), dtype=U)
                last = np.isin(own, np.array(hot or [], dtype=np.int64).view(U))
                order = np.lexsort((K.mix(own ^ U(0xA5A5A5A5)), last))
                sketches.append(own[order[: sketch_size(len(own), share, len(own) - int(last.sum()))]].view(np.int64))
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sketches, pa.list_(pa.int64()))], ["item", "n", "part", "width", "elements", "sketch"])

    return run


def _pairs_of_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for item, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            own = np.frombuffer(packed.as_buffer(), dtype=np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), item)), pa.array(own)], ["item", "hash"])


def _in_rows(rows: DataFrame, key: str, value: Column, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(key, row, of, many) with about ROW_ITEMS values in each row, and (key, rows, many); ``many`` comes from ``held`` (key, many).

    Keys that ``held`` has not are left out.
    """
    sizes = materialize(rows.groupBy(key).agg(F.ceil(F.count("*") / ROW_ITEMS).cast("int").alias("rows")).join(held, key), "sizes")
    dealt = rows.join(sizes, key).withColumn("row", F.pmod(F.xxhash64(value), F.col("rows")).cast("int"))
    return materialize(dealt.groupBy(key, "row", "many").agg(F.collect_list(value).alias("of")), "rows"), sizes


def _look_up(rows: DataFrame, table: DataFrame, sizes: DataFrame, key: str, width: int) -> DataFrame:
    """``rows`` with ``of`` of every row of the table that has their key."""
    at = F.struct(key, "row").alias("at")
    if sizes.where("rows > 1").isEmpty():
        return join_hot(rows, table.select(key, "of", "many"), key, many=F.col("many"), width=width * F.size("of") + 64).drop("many")
    spread = join_hot(rows, sizes, key, many=F.col("many"), width=32).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1))).drop("rows", "many")
    return join_hot(spread.select("*", at), table.select(at, "of", "many"), "at", many=F.col("many"), width=width * F.size("of") + 64).drop("at", "row", "many")


def _explode_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for packed in batch.column(0):
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(packed.as_buffer(), dtype=np.int64))], ["hash"])


class Filter:
    """Which hashes may be among those given: two bits for each in a bitmap of a bounded size."""

    def __init__(self, hashes: DataFrame, many: int):
        self.bits = min(MOST_BITS, max(LEAST_BITS, 1 << (8 * many).bit_length())).bit_length() - 1
        low = (1 << self.bits) - 1
        self.table = bit_table(hashes.select(F.explode(F.array(F.col("hash").bitwiseAND(low), F.shiftrightunsigned("hash", 64 - self.bits))).alias("bit")), 1 << self.bits)

    def probe(self, hashes: np.ndarray) -> np.ndarray:
        """Places of the hashes that may be among them."""
        hit = np.flatnonzero(bits_set(self.table, hashes & U((1 << self.bits) - 1)))
        return hit[bits_set(self.table, hashes[hit] >> U(64 - self.bits))]


SEEN = "key long, doc_id long, room long, held binary, probes array<long>"


def _scan(k: int, widths: list[int], every, sketches):
    """Documents with a shingle that may be sketched: all their shingles that may be an item's, and the sketched ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of_items, of_sketches = every.value, sketches.value
        for batch in batches:
            for part in K.passes(batch, "text"):
                hashes, _, _, at = K.words(*K.buffers(part.column(2)))
                found = []
                for width in widths:
                    grams = K.shingle_at(hashes, width)
                    hit = of_items.probe(grams)
                    doc = np.searchsorted(at, hit, "right") - 1
                    inside = hit + width <= at[doc + 1]
                    found.append((doc[inside], grams[hit[inside]]))
                doc, gram = (np.concatenate(x) for x in zip(*found, strict=True))
                likely = of_sketches.probe(gram)
                few = np.unique(doc[likely])
                order = np.lexsort((gram, doc))
                doc, gram = doc[order], gram[order]
                begin, end = np.searchsorted(doc, few), np.searchsorted(doc, few, "right")
                held = [np.unique(gram[a:b]) for a, b in zip(begin, end, strict=True)]
                probes = [h[of_sketches.probe(h)].view(np.int64) for h in held]
                # shingles of the document at most: enough to leave out what is too small for an item
                room = np.maximum(np.diff(at)[few] - k + 1, 1)
                index = pa.array(few)
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), part.column(1).take(index), pa.array(room), pa.array([h.tobytes() for h in held], pa.binary()), pa.array(probes, pa.list_(pa.int64()))], ["key", "doc_id", "room", "held", "probes"])

    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [K.common(np.frombuffer(a.as_buffer(), dtype=U), np.frombuffer(b.as_buffer(), dtype=U)) for a, b in zip(batch.column(2), batch.column(3), strict=True)]
            shared = np.array(both, dtype=np.int64)
            keep = pa.array(np.flatnonzero(den * shared >= num * batch.column(4).to_numpy()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(keep), batch.column(1).take(keep), pa.array(shared).take(keep), batch.column(4).take(keep)], ["doc_id", "item", "n_shared", "n"])

    return run


def contaminated(docs: DataFrame, items: DataFrame, *, shingle_words: int = 5, share: tuple[int, int] = (80, 100), id_col: str = "doc_id", text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Pairs of a document and a test item of whose distinct word shingles it holds the share (an exact ratio) or more.

    Returns doc_id, item_id, n_item_shingles, n_shared, containment.  An item of fewer than ``shingle_words`` words
    is one shingle, looked for as that sequence of words anywhere in the document.  Items without words (null,
    blank) are in no document, documents without words hold none.  A row of either side is judged by its own text:
    an item is a set of shingles, whatever its id, and the rows of one item_id (or of none) with different texts are
    found or not each for itself.  Of several finds of one (doc_id, item_id) the one with the greatest containment
    is given, of equal ones that with most shared shingles; a null id is an id like others.  Further columns on
    either side are ignored, whatever their names.  Empty tables give no rows.
    """
    num, den = share
    own = items.select(F.col(f"`{item_id_col}`").cast("long").alias("item_id"), F.col(f"`{item_text_col}`").alias("text")).distinct()
    read = materialize(own.mapInArrow(_items(shingle_words), ITEM), "items")
    # items with equal sets are looked for once
    bare = read.groupBy("elements", "width").agg(F.first("n").alias("n"), F.first("part").alias("part"))
    bare = materialize(bare.select(F.monotonically_increasing_id().alias("item"), "n", "part", "width", "elements"), "sets")
    if bare.count() > HOT_ITEMS:
        within = bare.select("item", "elements").mapInArrow(_pairs_of_sets, "item long, hash long")
        hot = within.groupBy("hash").agg(F.count("*").alias("items")).where(F.col("items") > HOT_ITEMS).select("hash")
        of_item = within.join(checked_broadcast(hot), "hash").groupBy("item").agg(F.collect_list("hash").alias("hot"))
        known = bare.join(of_item, "item", "left")
    else:
        known = bare.withColumn("hot", F.lit(None).cast("array<long>"))
    sets = materialize(known.select("item", "n", "part", "width", "elements", "hot").mapInArrow(_sketched(num / den), SET), "sets")
    widths = sorted(r["width"] for r in sets.select("width").distinct().collect()) or [shingle_words]  # 1 to shingle_words
    many = sets.agg(F.sum("n"), F.sum(F.size("sketch"))).first()
    context = docs.sparkSession.sparkContext
    every = context.broadcast(Filter(sets.select("elements").mapInArrow(_explode_sets, "hash long"), many[0] or 0))
    sketches = context.broadcast(Filter(sets.select(F.explode("sketch").alias("hash")), many[1] or 0))
    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    seen = materialize(rows.mapInArrow(_scan(shingle_words, widths, every, sketches), SEEN), "seen")

    # (document, item) by a common sketched shingle and the size of the item's partition: least share of its least set
    probes = seen.select("key", "room", F.explode("probes").alias("hash"))
    sketch = sets.select(F.explode("sketch").alias("hash"), F.struct("item", "part", "n").alias("of"))
    sketched, sizes = _in_rows(sketch, "hash", F.col("of"), probes.groupBy("hash").agg(F.count("*").alias("many")))
    met = _look_up(probes, sketched, sizes, "hash", 24).select("key", "room", F.explode("of").alias("i"))
    least = F.when(F.col("i.part") > 0, F.expr("shiftleft(1L, i.part - 1) + 1")).otherwise(1)
    fits = met.where((F.col("room") * den >= least * num) & (F.col("room") * den >= F.col("i.n") * num))
    candidates = materialize(fits.select("key", F.col("i.item").alias("item")).distinct(), "candidates")

    wanted = materialize(candidates.groupBy("item").agg(F.count("*").alias("many")).join(sets.select("item", "n", "elements"), "item"), "wanted")
    pairs = join_hot(candidates, wanted, "item", many=F.col("many"), width=8 * F.col("n") + 64).join(seen.select("key", "doc_id", "held"), "key")
    found = materialize(pairs.select("doc_id", "item", "elements", "held", "n").mapInArrow(_verify(num, den), "doc_id long, item long, n_shared long, n long"), "found")
    names = read.select("item_id", "elements", "width").join(sets.select("elements", "width", "item"), ["elements", "width"]).select("item", F.struct(F.col("item_id").alias("id")).alias("of")).distinct()
    names, many_names = _in_rows(names, "item", F.col("of"), found.groupBy("item").agg(F.count("*").alias("many")))
    out = _look_up(found, names, many_names, "item", 16).select("doc_id", "n", "n_shared", F.explode("of").alias("i"))
    best = F.max(F.struct((F.col("n_shared") / F.col("n")).alias("containment"), "n_shared", "n")).alias("b")
    out = materialize(out.groupBy("doc_id", F.col("i.id").alias("item_id")).agg(best).select("doc_id", "item_id", F.col("b.n").alias("n_item_shingles"), "b.n_shared", "b.containment"), "contaminated")
    discard(read, bare, sets, seen, sketched, sizes, candidates, wanted, found, names, many_names)
    return out


def drop_contaminated(docs: DataFrame, items: DataFrame, *, id_col: str = "doc_id", **options) -> DataFrame:
    """``docs`` without the documents that hold a test item; rows that share an id, or have none, go together: all of them if one holds an item."""
    found = contaminated(docs, items, id_col=id_col, **options)
    leaky = materialize(found.select(F.col("doc_id").alias("leaky_id")).distinct(), "leaky")
    discard(found)
    return by_ids(docs, id_col, leaky, "left_anti")

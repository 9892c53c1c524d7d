"""MinHash near-duplicate detection (operator 1).

One-permutation hashing with optimal densification gives each distinct shingle set a signature; bands of it
make buckets; each bucket proposes a star (its least document against all others), so candidate pairs
grow with bucket sizes and not with their squares.  Every link is confirmed on the full shingle sets.

What a star can miss (two members linked with each other, not with the centre) is looked for exactly:
buckets whose members still lie in several components are dealt out as pairs of bounded blocks, and only
documents that some signature in the opposite block resembles are carried on with their full sets.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wharfline.operators.components import connected_components
from wharfline.shared import by_ids, discard, join_hot, materialize

from . import kernels as K
from .bits import IdFilter

U = np.uint64
BINS = 128
ROWS = 4
#: A link at exactly the threshold stays without a common band at most this often.
BAND_MISS = 1e-7
#: Signatures agree in fewer bins than expected at the threshold by so many standard deviations: no link (chance below 1e-6).
SIGMAS = 5
#: Most documents and most set elements that a block of a large bucket holds, on average.
BLOCK_DOCS, BLOCK_ELEMENTS = 256, 1 << 20


def band_count(threshold: float, rows: int = ROWS, miss: float = BAND_MISS) -> int:
    """Bands of ``rows`` bins so that a pair at the threshold misses all of them with at most the chance ``miss``."""
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    if bands * rows > BINS:
        raise ValueError(f"{bands} bands of {rows} rows need more than {BINS} bins")
    return bands


def least_agreement(threshold: float) -> float:
    """Share of equal signature bytes below which a pair is taken as unlinked."""
    return threshold - SIGMAS * math.sqrt(threshold * (1 - threshold) / BINS)


def signatures(elements: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One-permutation signatures (documents x BINS) of end-to-end sorted sets; rows of empty sets are 0.

    Densification is the optimal one: an empty bin tries bins in an order drawn for it alone (the same for all
    documents) and copies the first that is occupied, so that two documents agree in it with chance J.
    """
    n, shift = len(at) - 1, U(64 - BINS.bit_length() + 1)
    sig, full = np.zeros((n, BINS), dtype=U), np.zeros((n, BINS), dtype=bool)
    if len(elements):
        cell = np.repeat(np.arange(n), np.diff(at)) * BINS + (elements >> shift).astype(np.int64)
        lead = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
        sig.ravel()[cell[lead]] = elements[lead]
        full.ravel()[cell[lead]] = True
    doc, bin_ = np.nonzero(~full & (np.diff(at) > 0)[:, None])
    step = 0
    while len(doc):
        step += 1
        pick = (K.mix(bin_.astype(U) * U(0x9E3779B9) + U(step * 0xC2B2AE3D27D4EB4F & 0xFFFFFFFFFFFFFFFF)) >> shift).astype(np.int64) if step < 4096 else (bin_ + step) % BINS
        hit = full[doc, pick]
        sig[doc[hit], bin_[hit]] = sig[doc[hit], pick[hit]]
        doc, bin_ = doc[~hit], bin_[~hit]
    return sig


def band_keys(sig: np.ndarray, bands: int, rows: int = ROWS) -> np.ndarray:
    """A 64-bit key for each band of each signature (documents x bands)."""
    out = np.zeros((len(sig), bands), dtype=U)
    for j in range(rows):
        out = K.mix(out + sig[:, j : bands * rows : rows] * U(0x9FB21C651E98DF25))
    return K.mix(out + np.arange(bands, dtype=U)[None, :])


def set_sums(elements: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit sums of each set, which stand for it where equal sets are brought together."""
    out = []
    for salt in (0x1B873593CC9E2D51, 0x52DCE729B4E33AA1):
        s = np.zeros(len(elements) + 1, dtype=U)
        np.cumsum(K.mix(elements ^ U(salt)), out=s[1:])
        out.append((s[at[1:]] - s[at[:-1]]).view(np.int64))
    return out


def _sign(k: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in K.passes(batch, "text"):
                elements, at = K.shingle_sets(*K.buffers(part.column(2)), k)
                sig = signatures(elements, at)
                keys = band_keys(sig, bands)
                # the band keys follow the signature bytes, so that a block can tell the first band a pair shares
                packed = np.concatenate([(K.mix(sig) & U(255)).astype(np.uint8), keys.view(np.uint8).reshape(len(keys), bands * 8)], axis=1)
                width = packed.shape[1]
                yield pa.RecordBatch.from_arrays(
                    [
                        *part.columns[:2],
                        pa.array(np.diff(at)),
                        *map(pa.array, set_sums(elements, at)),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64))),
                        pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(np.arange(0, packed.size + 1, width, dtype=np.int32)), pa.py_buffer(np.ascontiguousarray(packed))]),
                    ],
                    ["doc_id", "text_hash", "n", "h1", "h2", "bands", "sig"],
                )

    return run


def _sets(k: int, wanted):
    """The sets of documents that may be wanted, each once for a task, with what names their class."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            ids = batch.column(0)
            few = batch.filter(pa.array(wanted.value.test(ids.fill_null(0).to_numpy()) & ids.is_valid().to_numpy(zero_copy_only=False)))
            for part in K.passes(few, "text"):
                elements, at = K.shingle_sets(*K.buffers(part.column(2)), k)
                h1, h2 = set_sums(elements, at)
                rows = []
                for i, doc in enumerate(part.column(0).to_pylist()):
                    if at[i] < at[i + 1] and (name := (doc, int(h1[i]), int(h2[i]))) not in seen:
                        seen.add(name)
                        rows.append(i)
                index = pa.array(rows, pa.int64())
                packed = pa.array([elements[at[i] : at[i + 1]].tobytes() for i in rows], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0).take(index), pa.array(h1).take(index), pa.array(h2).take(index), pa.array(np.diff(at)).take(index), packed], ["rep", "h1", "h2", "n", "elements"])

    return run


def _byte_rows(column: pa.Array, width: int = 0) -> np.ndarray:
    rows = [np.frombuffer(x.as_buffer(), dtype=np.uint8)[: width or None] for x in column]
    return np.stack(rows) if rows else np.zeros((0, width), dtype=np.uint8)


def _resemble(floor: float, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            cls, centre, n, cn = (batch.column(i).to_numpy() for i in range(4))
            alike = (_byte_rows(batch.column(4), BINS) == _byte_rows(batch.column(5), BINS)).mean(axis=1) >= floor
            fits = den * np.minimum(n, cn) >= num * np.maximum(n, cn)
            keep = np.flatnonzero(alike & fits)
            yield pa.RecordBatch.from_arrays([pa.array(cls[keep]), pa.array(centre[keep])], ["cls", "centre"])

    return run


def _confirm(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                a, b = np.frombuffer(x.as_buffer(), dtype=U), np.frombuffer(y.as_buffer(), dtype=U)
                inter = K.common(a, b)
                if den * inter >= num * (len(a) + len(b) - inter):
                    keep.append(i)
            chosen = batch.take(pa.array(keep, pa.int64()))
            yield pa.RecordBatch.from_arrays([chosen.column(0), chosen.column(1)], ["a", "b"])

    return run


def overlaps(left: list[np.ndarray], right: list[np.ndarray], width: int = 4096) -> np.ndarray:
    """Sizes of the intersections of every set on the left with every set on the right (exact counts)."""
    sizes = [len(x) for x in (*left, *right)]
    values, code = np.unique(np.concatenate([*left, *right]) if sizes else np.zeros(0, dtype=U), return_inverse=True)
    row = np.repeat(np.arange(len(sizes)), sizes)
    cut = len(left)
    on_both = np.intersect1d(code[row < cut], code[row >= cut])
    place = np.full(len(values), -1, dtype=np.int64)
    place[on_both] = np.arange(len(on_both))
    code = place[code]
    row, code = row[code >= 0], code[code >= 0]
    order = np.argsort(code, kind="stable")
    row, code = row[order], code[order]
    out = np.zeros((cut, len(right)), dtype=np.float32)
    for low in range(0, len(on_both), width):
        a, b = np.searchsorted(code, (low, low + width))
        grid = np.zeros((len(sizes), min(width, len(on_both) - low)), dtype=np.float32)
        grid[row[a:b], code[a:b] - low] = 1
        out += grid[:cut] @ grid[cut:].T
    return out.astype(np.int64)


def _candidates(table: pa.Table, floor: float, num: int, den: int):
    """Index pairs of a block: opposite sides (or the two halves of a diagonal block), other components, alike, first common band."""
    cls, comp, n, side = (table.column(c).to_numpy() for c in ("cls", "comp", "n", "side"))
    packed = _byte_rows(table.column("sig").combine_chunks())
    diagonal = bool(table.column("same")[0].as_py())
    left = np.arange(len(cls)) if diagonal else np.flatnonzero(side == 0)
    right = left if diagonal else np.flatnonzero(side == 1)
    sig, keys = packed[:, :BINS], np.ascontiguousarray(packed[:, BINS:]).view(np.int64)
    key = table.column("key")[0].as_py()
    band = int(np.flatnonzero(keys[left[0]] == key)[0]) if len(left) else 0
    out = []
    for i in left:
        other = right[right > i] if diagonal else right
        other = other[(comp[other] != comp[i]) & (den * np.minimum(n[other], n[i]) >= num * np.maximum(n[other], n[i]))]
        other = other[(sig[other] == sig[i]).mean(axis=1) >= floor] if len(other) else other
        if band and len(other):
            other = other[~(keys[other, :band] == keys[i, :band]).any(axis=1)]
        if len(other):
            out.append((i, other))
    return comp, n, out


def _live(floor: float, num: int, den: int):
    """Documents of a block that a signature opposite resembles."""

    def run(table: pa.Table) -> pa.Table:
        _, _, found = _candidates(table, floor, num, den)
        mark = np.zeros(table.num_rows, dtype=bool)
        for i, other in found:
            mark[i] = True
            mark[other] = True
        return table.filter(pa.array(mark))

    return run


def _joining(floor: float, num: int, den: int):
    """Pairs of components that confirmed links of a block join, as many as it takes (a forest)."""

    def run(table: pa.Table) -> pa.Table:
        comp, n, found = _candidates(table, floor, num, den)
        a, b = [], []
        if found:
            sets = [np.frombuffer(x.as_buffer(), dtype=U) for x in table.column("elements")]
            left = np.array([i for i, _ in found])
            right = np.unique(np.concatenate([o for _, o in found]))
            shared = overlaps([sets[i] for i in left], [sets[i] for i in right])
            up: dict[int, int] = {}

            def root(x: int) -> int:
                while up.get(x, x) != x:
                    up[x] = up.get(up[x], up[x])
                    x = up[x]
                return x

            for row, (i, other) in enumerate(found):
                both = shared[row, np.searchsorted(right, other)]
                for j in other[den * both >= num * (n[i] + n[other] - both)]:
                    x, y = root(int(comp[i])), root(int(comp[j]))
                    if x != y:
                        up[max(x, y)] = min(x, y)
                        a.append(comp[i])
                        b.append(comp[j])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


SPARE = 1 << 62


def _labelled(signed: DataFrame, repeated: bool) -> DataFrame:
    """The classes of equal sets: h1, h2, n, rep (least doc_id), cls (the class's name), bands, sig.

    A class is named by its least doc_id.  Where documents share a doc_id, classes may share it too; all but one of
    those are then named by numbers beyond every doc_id.
    """
    classes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands"), F.first("sig").alias("sig"))
    if not repeated:
        return materialize(classes.withColumn("cls", F.col("rep")), "classes")
    numbered = materialize(classes.withColumn("seq", F.monotonically_increasing_id()), "classes")
    torn = materialize(numbered.groupBy("rep").agg(F.min("seq").alias("head"), F.count("*").alias("many")).where("many > 1"), "torn")
    low, high = signed.agg(F.min("doc_id"), F.max("doc_id")).first()
    spare = F.lit(high or 0) + 1 + F.col("seq") if (high or 0) < SPARE else F.lit(low) - 1 - F.col("seq") if low > -SPARE else F.xxhash64("h1", "h2", "n")
    named = join_hot(numbered, torn, "rep", many=F.col("many"), how="left")
    out = materialize(named.select("h1", "h2", "n", "rep", "bands", "sig", F.when(F.col("head").isNull() | (F.col("head") == F.col("seq")), F.col("rep")).otherwise(spare).alias("cls")), "classes")
    discard(numbered, torn)
    return out


def _roots(rows: DataFrame, classes: DataFrame, k: int, num: int, den: int, bands: int, floor: float) -> DataFrame:
    """(cls, root) of the classes that links join with others, the roots among them left out."""
    slots = classes.select("cls", "n", F.explode("bands").alias("key"))
    buckets = materialize(slots.groupBy("key").agg(F.count("*").alias("m"), F.min("cls").alias("centre")).where("m > 1"), "buckets")
    members = materialize(join_hot(slots, buckets, "key", many=F.col("m")), "members")
    discard(buckets)

    # stars: a bucket proposes its least class against all others
    stars = materialize(members.where("cls <> centre").select("cls", "centre").distinct(), "stars")
    short = classes.select("cls", "n", F.substring("sig", 1, BINS).alias("sig"))
    centres = materialize(stars.groupBy("centre").agg(F.count("*").alias("many")).join(short.select(F.col("cls").alias("centre"), F.col("n").alias("cn"), F.col("sig").alias("csig")), "centre"), "centres")
    traits = join_hot(stars, centres, "centre", many=F.col("many"), width=BINS + 64).join(short, "cls")
    pairs = materialize(traits.select("cls", "centre", "n", "cn", "sig", "csig").mapInArrow(_resemble(floor, num, den), "cls long, centre long"), "pairs")
    discard(stars, centres)

    def sets(ids: DataFrame, name: str) -> DataFrame:
        """(cls, n, many, elements) of the classes in ``ids`` (cls, many)."""
        # texts stay where they are read: a bitmap leaves out most that aren't wanted, the join those it lets through
        ids = materialize(ids.join(classes.select("cls", "rep", "h1", "h2", "n"), "cls"), "ids")
        wanted = rows.sparkSession.sparkContext.broadcast(IdFilter(ids, "rep"))
        own = ["rep", "h1", "h2", "n"]
        found = rows.mapInArrow(_sets(k, wanted), "rep long, h1 long, h2 long, n long, elements binary").dropDuplicates(own)
        out = materialize(found.join(ids, own).select("cls", "n", "many", "elements"), name)
        discard(ids)
        return out

    ends = pairs.select(F.explode(F.array(F.struct(F.col("cls"), F.lit(0).cast("long").alias("one")), F.struct(F.col("centre").alias("cls"), F.lit(1).cast("long").alias("one")))).alias("e"))
    full = sets(ends.groupBy("e.cls").agg(F.sum("e.one").alias("many")), "sets")
    heads = full.where("many > 0").select(F.col("cls").alias("centre"), F.col("n").alias("cn"), "many", F.col("elements").alias("celements"))
    links = join_hot(pairs, heads, "centre", many=F.col("many"), width=8 * F.col("cn") + 64).join(full.select("cls", "elements"), "cls")
    links = materialize(links.select("cls", "centre", "elements", "celements").mapInArrow(_confirm(num, den), "a long, b long"), "links")
    roots = connected_components(links)
    discard(pairs, links)

    # buckets that the stars have left in several components, dealt out in blocks
    placed = members.where("m > 2").join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("key", "cls", "n", "centre", F.coalesce("root", "cls").alias("comp"))
    split = placed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count("*").alias("m"), F.max(F.when(F.col("cls") == F.col("centre"), F.col("comp"))).alias("main"))
    split = materialize(split.where("low <> high").select("key", "main", "m"), "split")
    if split.isEmpty():
        discard(members, full)
        return roots.withColumnRenamed("node", "cls")
    minor = F.col("comp") != F.col("main")
    own = materialize(join_hot(placed.where("cls <> centre"), split, "key", many=F.col("m")).select("key", "cls", "n", "comp", minor.alias("minor")), "placed")
    parts = {"few": F.col("minor"), "many": ~F.col("minor")}
    sizes = own.groupBy("key").agg(F.count("*").alias("m"), *(F.ceil(F.greatest(F.sum(F.when(c, 1).otherwise(0)) / BLOCK_DOCS, F.sum(F.when(c, F.col("n")).otherwise(0)) / BLOCK_ELEMENTS)).cast("long").alias(x) for x, c in parts.items()))
    sizes = materialize(sizes.where("few > 0"), "sizes")
    dealt = join_hot(own, sizes, "key", many=F.col("m")).withColumn("chunk", F.pmod(F.xxhash64("cls"), F.when(F.col("minor"), F.col("few")).otherwise(F.col("many"))))
    chunks = F.sequence(F.lit(0).cast("long"), F.col("few") - 1)
    block = lambda i, j, major, side, same: F.struct(i.alias("i"), j.alias("j"), F.lit(major).alias("major"), F.lit(side).alias("side"), same.alias("same"))
    mine = F.concat(
        F.transform(chunks, lambda c: block(F.least(c, F.col("chunk")), F.greatest(c, F.col("chunk")), False, 0, c == F.col("chunk"))),
        F.when(F.col("many") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("many") - 1, F.lit(0))), lambda c: block(F.col("chunk"), c, True, 0, F.lit(False)))).otherwise(F.expr("array()")),
    )
    theirs = F.transform(chunks, lambda c: block(c, F.col("chunk"), True, 1, F.lit(False)))
    blocks = dealt.join(classes.select("cls", "sig"), "cls").select("key", "cls", "comp", "n", "sig", "chunk", F.explode(F.when(F.col("minor"), mine).otherwise(theirs)).alias("b"))
    blocks = blocks.select("key", "cls", "comp", "n", "sig", "b.i", "b.j", "b.major", "b.same", F.when(~F.col("b.major") & ~F.col("b.same") & (F.col("chunk") == F.col("b.j")), 1).otherwise(F.col("b.side")).alias("side"))
    schema = "key long, cls long, comp long, n long, sig binary, i long, j long, major boolean, same boolean, side int"
    live = materialize(blocks.groupBy("key", "i", "j", "major").applyInArrow(_live(floor, num, den), schema), "live")
    discard(members, split, own, sizes)
    lacking = live.select("cls").distinct().join(full.select("cls"), "cls", "left_anti")
    held = sets(lacking.withColumn("many", F.lit(0).cast("long")), "sets")
    more = live.join(held.unionByName(full).select("cls", "elements"), "cls").select(*live.columns, "elements").groupBy("key", "i", "j", "major").applyInArrow(_joining(floor, num, den), "a long, b long")
    joined = connected_components(more)
    discard(live, held, full)
    if joined.isEmpty():
        return roots.withColumnRenamed("node", "cls")
    # components joined by blocks: one more star for each, over the roots alone
    out = connected_components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(joined.select(F.col("node").alias("a"), F.col("root").alias("b"))))
    return out.withColumnRenamed("node", "cls")


def _classified(docs: DataFrame, id_col: str, text_col: str, k: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """A row for each of ``docs``, written: doc_id, text_hash, n, cls, rep (least doc_id of the class), root (of its links), component_id; and (doc_id, rows) of repeated ids."""
    threshold = num / den
    bands, floor = band_count(threshold), least_agreement(threshold)
    text = F.col(f"`{text_col}`")
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    signed = materialize(rows.mapInArrow(_sign(k, bands), "doc_id long, text_hash long, n long, h1 long, h2 long, bands array<long>, sig binary"), "signatures")
    repeated = materialize(signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1"), "repeated")
    several = not repeated.isEmpty()
    classes = _labelled(signed, several)
    roots = _roots(rows, classes, k, num, den, bands, floor)
    named = materialize(classes.select("h1", "h2", "n", "rep", "cls").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls")), "named")
    # all rows of an exact copy meet their class's one row
    sizes = signed.where("n > 0 and doc_id is not null").groupBy("h1", "h2", "n").agg(F.count("*").alias("many"))
    key = F.struct("h1", "h2", "n")
    side = materialize(named.join(sizes, ["h1", "h2", "n"]).select(key.alias("set"), "rep", "cls", "root", "many"), "sized")
    out = join_hot(signed.where("doc_id is not null").select("doc_id", "text_hash", "n", key.alias("set")), side, "set", many=F.col("many"), how="left")
    out = out.select("doc_id", "text_hash", "n", "rep", "cls", "root").unionByName(signed.where("doc_id is null").selectExpr("doc_id", "text_hash", "n", "cast(null as long) as rep", "cast(null as long) as cls", "cast(null as long) as root"))
    if not several:
        found = materialize(out.withColumn("component_id", F.coalesce("root", "doc_id")), "found")
        discard(signed, classes, named, side)
        return found, repeated
    # a document that has several texts joins their classes, and those its doc_id is the least of
    found = materialize(out, "found")
    texts = found.where("cls is not null").select("doc_id", "cls").distinct()
    heads = materialize(texts.groupBy("doc_id").agg(F.min("cls").alias("head"), F.max("cls").alias("last"), F.count("*").alias("many")).where("head <> last"), "heads")
    edges = join_hot(texts, heads, "doc_id", many=F.col("many")).select(F.col("cls").alias("a"), F.col("head").alias("b"))
    linked = connected_components(edges.unionByName(named.where("cls <> root").select(F.col("cls").alias("a"), F.col("root").alias("b"))))
    wide = named.select("cls", "rep").join(linked.withColumnRenamed("node", "cls").withColumnRenamed("root", "group"), "cls", "left").withColumn("group", F.coalesce("group", "cls"))
    least = materialize(wide.groupBy("group").agg(F.min("rep").alias("component_id"), F.count("*").alias("many")), "least")
    placed = materialize(join_hot(wide.select("cls", "group"), least, "group", many=F.col("many")).select("cls", "component_id").join(found.where("cls is not null").groupBy("cls").agg(F.count("*").alias("many")), "cls"), "placed")
    final = materialize(join_hot(found, placed, "cls", many=F.col("many"), how="left").withColumn("component_id", F.coalesce("component_id", "doc_id")).select("doc_id", "text_hash", "n", "rep", "cls", "root", "component_id"), "found")
    # a doc_id with words in some of its rows only: the others follow
    apart = materialize(final.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("own"), F.count("*").alias("many"), F.max("component_id").alias("top")).where("own <> top").drop("top"), "apart")
    if not apart.isEmpty():
        mended = join_hot(final, apart, "doc_id", many=F.col("many"), how="left").withColumn("component_id", F.coalesce("own", "component_id"))
        final, before = materialize(mended.select(*final.columns), "found"), final
        discard(before)
    discard(signed, classes, named, side, found, heads, least, placed, apart)
    return final, repeated


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """Near-duplicate classes of documents by the Jaccard likeness of their word-shingle sets.

    ``similarity`` is the exact ratio (numerator, denominator) from which two sets are linked.  Returns a row for
    each row of ``docs``: doc_id, n_shingles (size of the row's set), component_id (smallest doc_id reachable over
    links), kept (doc_id = component_id).

    Null and blank texts have no shingles and no links.  A row without doc_id can't be named by others: it is
    linked with nothing, its component_id is null and it is kept.  Rows that repeat a doc_id are one document: it is
    linked with whatever one of its texts is near to, and has one component_id.  Further columns of ``docs`` are
    ignored, whatever their names.  An empty table gives an empty result.
    """
    found, repeated = _classified(docs, id_col, text_col, shingle_words, *similarity)
    discard(repeated)
    kept: Column = F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    return found.select("doc_id", F.col("n").alias("n_shingles"), "component_id", kept.alias("kept"))


def keep_one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, similarity: tuple[int, int] = (80, 100)) -> DataFrame:
    """``docs`` with one row of each near-duplicate class of texts (one with the least doc_id), in all its columns.

    Here a doc_id joins nothing: rows that repeat one and differ in their texts are kept or not by their own texts, so
    that a text of every class stays.  Rows equal in doc_id and text count once.  Rows without doc_id stay, and so do
    texts without words.
    """
    found, repeated = _classified(docs, id_col, text_col, shingle_words, *similarity)
    few = ~F.coalesce(F.col("n") > 0, F.lit(False))
    stays = few | ((F.col("cls") == F.col("root")) & (F.col("doc_id") == F.col("rep")))
    if repeated.isEmpty():
        gone = materialize(found.where(F.col("doc_id").isNotNull() & ~stays).select(F.col("doc_id").alias("gone_id")), "gone")
        discard(found, repeated)
        return by_ids(docs, id_col, gone, "left_anti")
    known = found.where(F.col("doc_id").isNotNull())
    blank = known.where(few).select("doc_id", "text_hash").distinct()
    one = known.where(stays & ~few).groupBy("cls").agg(F.min(F.struct("doc_id", "text_hash")).alias("k")).select("k.doc_id", "k.text_hash")
    keepers = materialize(blank.unionByName(one), "keepers")
    gone = materialize(known.select("doc_id").distinct().join(keepers.select("doc_id").distinct(), "doc_id", "left_anti").select(F.col("doc_id").alias("gone_id")), "gone")
    again = materialize(repeated.select(F.col("doc_id").alias("again_id")), "again")
    once = by_ids(by_ids(docs, id_col, gone, "left_anti"), id_col, again, "left_anti")
    names = docs.columns
    key, text = names.index(id_col), names.index(text_col)
    plain = by_ids(docs, id_col, again, "left_semi").toDF(*(f"c{i}" for i in range(len(names))))
    marked = plain.withColumn("kept_id", F.col(f"c{key}").cast("long")).withColumn("kept_hash", F.xxhash64(f"c{text}")).dropDuplicates(["kept_id", "kept_hash"])
    chosen = marked.join(keepers.select(F.col("doc_id").alias("kept_id"), F.col("text_hash").alias("kept_hash")), ["kept_id", "kept_hash"], "left_semi")
    discard(found, repeated)
    return once.unionByName(chosen.select(*(f"c{i}" for i in range(len(names)))).toDF(*names))

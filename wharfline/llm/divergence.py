"""How the sources of a language differ in the words they use (operator 13).

Pass one counts exactly in how many documents of a language each term stands; the frequent ones are kept.  Pass two reads
the texts again with an Aho-Corasick automaton of the kept terms, each padded with a delimiter on both sides, and counts
their occurrences by language and source.  What is not counted is nought, so a (language, source) group is its list of
postings (term, count), and shares are whole numbers of billionths, taken of ``count + 5``.

Distances between all sources of a language need the postings only.  With a0 and b0 the shares of an absent term,

    sum over all terms |pA - pB| = G(A, b0) + G(B, a0) + (V - nA - nB) |a0 - b0| + correction(A, B)

where G(A, z) sums |pA - z| over A's own nA terms, by a running sum over the distinct shares of A, and the correction,
|pA - pB| - |pA - b0| - |pB - a0| + |a0 - b0|, is summed over the terms that both have, from the postings of one term
after another.
"""

from __future__ import annotations

import uuid
from collections import Counter, defaultdict
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.session import ship_code
from wharfline.shared import checked_broadcast, materialize

#: Bytes of terms that a task is given at once; more terms are counted in so many more readings of the texts.
PART_BYTES = 32 << 20
#: Entries that a task sums up before it hands them on.
HELD = 400_000
#: Sources of a block, and terms that a task takes of a block pair.
SOURCES, SLICE_TERMS = 512, 1_024
BILLION, SMOOTH = 1_000_000_000, 5

#: Delimiters become a space, A-Z become a-z, every other byte (all of those of non-ASCII characters) stays.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def folded(text: str) -> bytes:
    return text.encode("utf-8", "replace").translate(_FOLD)


def _named(docs: DataFrame, lang_col: str, source_col: str, text_col: str) -> DataFrame:
    return docs.select(*(F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(n) for c, n in ((lang_col, "lang"), (source_col, "source"), (text_col, "text"))))


def _counted(rows: DataFrame, keys: list[str], count, term: str, value: str) -> DataFrame:
    """Sums of what ``count(tuple of keys, text, sums)`` adds up in each task, by keys and the column ``term`` (name and type)."""
    name, kind = term.split()
    fields = pa.schema([(k, pa.string()) for k in keys] + [("terms", pa.list_(pa.string() if kind == "string" else pa.int64())), ("sums", pa.list_(pa.int64()))])

    def table(sums: dict[tuple, Counter]) -> pa.RecordBatch:
        filled = {k: c for k, c in sums.items() if c}
        named = ([[t.decode("utf-8") for t in c] for c in filled.values()] if kind == "string" else [list(c) for c in filled.values()])
        columns = [*(list(k) for k in zip(*filled, strict=True)), named, [list(c.values()) for c in filled.values()]] if filled else [[] for _ in fields]
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple, Counter] = defaultdict(Counter)
        for batch in batches:
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                count(tuple(key), text, sums[tuple(key)])
            if sum(map(len, sums.values())) > HELD:
                yield table(sums)
                sums.clear()
        yield table(sums)

    parts = rows.select(*keys, "text").mapInArrow(run, ", ".join(f"{k} string" for k in keys) + f", terms array<{kind}>, sums array<long>")
    entries = parts.select(*keys, F.explode(F.arrays_zip("terms", "sums")).alias("x")).select(*keys, F.col("x.terms").alias(name), F.col("x.sums").alias(value))
    return entries.groupBy(*keys, name).agg(F.sum(value).alias(value))


def document_frequencies(docs: DataFrame, *, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, term, documents): exact numbers of rows of ``docs`` whose text holds the term, by language."""
    ship_code(docs.sparkSession)
    return _counted(_named(docs, lang_col, lang_col, text_col), ["lang"], lambda _, text, terms: terms.update(set(folded(text).split())), "term string", "documents")


def occurrences(docs: DataFrame, kept: DataFrame, *, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, id, count), count > 0, of the distinct (lang, term, id) in the written table ``kept``.

    The terms go to the tasks in parts of about ``part_bytes`` by a hash, and the texts are read once for each part.
    """
    spark = docs.sparkSession
    ship_code(spark)
    size = kept.agg(F.sum(F.octet_length("term") + 32)).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    out = None
    for part in range(parts):
        own = kept if parts == 1 else kept.where(F.pmod(F.xxhash64("term"), F.lit(parts)) == part)
        by_lang: dict[str, list[tuple[str, int]]] = defaultdict(list)
        for batch in own.select("lang", "term", "id").toArrow().to_batches():  # bounded by part_bytes
            for lang, term, number in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                by_lang[lang].append((term, number))
        given, name = spark.sparkContext.broadcast(dict(by_lang)), uuid.uuid4().hex

        def count(key: tuple, text: str, sums: Counter, given=given, name=name) -> None:
            found = automaton_of(name, given, key[0])
            if found is not None:
                padded = (b" " + folded(text) + b" ").decode("latin-1")
                sums.update(map(_ID, found.iter(padded)))

        counted = _counted(_named(docs, lang_col, source_col, text_col), ["lang", "source"], count, "id long", "count")
        out = counted if out is None else out.unionByName(counted)
    return out


_ID = itemgetter(1)
_automata: dict[tuple[str, str], object] = {}


def automaton_of(name: str, given, lang: str):
    """The automaton of a language's padded terms, made once in a worker for each part; None where it has no terms."""
    import ahocorasick

    key = (name, lang)
    if key not in _automata:
        if any(k[0] != name for k in _automata):
            _automata.clear()
        terms = given.value.get(lang)
        found = ahocorasick.Automaton() if terms else None
        for term, number in terms or ():
            found.add_word(f" {term.encode('utf-8').decode('latin-1')} ", number)
        if found is not None:
            found.make_automaton()
        _automata[key] = found
    return _automata[key]


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (total + 5 terms)), exactly, whatever the counts."""
    top = (count + SMOOTH).cast("decimal(19,0)") * F.lit(BILLION).cast("decimal(10,0)")
    bottom = (total + SMOOTH * terms).cast("decimal(19,0)")
    quotient = F.call_function("try_divide", top - top % bottom, bottom)
    return 1 + quotient.cast("long")


def divergence(docs: DataFrame, *, least_documents: int = 30, most_terms: int = 50, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", part_bytes: int = PART_BYTES) -> DataFrame:
    """(lang, source, part, item, value, rank): how far each source is from the others of its language, and its own terms.

    Terms are runs of ASCII letters and non-ASCII characters, A-Z as a-z; a language keeps those in ``least_documents``
    of its rows.  Part ``pair``: each other source of the language, by the sum of differences of shares over all kept terms.
    Part ``term``: terms that the source has a larger share of than the language, by the difference, the first
    ``most_terms``.  Ranks run from 1, value descending, item ascending by its bytes.
    Null texts, languages and sources count as ''.  A language without kept terms has distances of 0; a single source has
    no pairs.  Repeated rows count each; an empty table gives no rows.
    """
    named = _named(docs, lang_col, source_col, text_col)
    frequent = document_frequencies(docs, lang_col=lang_col, text_col=text_col).where(F.col("documents") >= least_documents)
    kept = materialize(frequent.select("lang", "term", F.monotonically_increasing_id().alias("id")), "divergence-kept")
    postings = materialize(occurrences(docs, kept, lang_col=lang_col, source_col=source_col, text_col=text_col, part_bytes=part_bytes), "divergence-postings")
    terms = kept.groupBy("lang").agg(F.count("*").alias("v"))
    totals = postings.groupBy("lang", "source").agg(F.sum("count").alias("total"), F.count("*").alias("own"))
    groups = named.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(checked_broadcast(terms), "lang", "left")
    zero = F.lit(0).cast("long")
    groups = groups.select("lang", "source", F.coalesce("total", zero).alias("total"), F.coalesce("own", zero).alias("own"), F.coalesce("v", zero).alias("v"))
    groups = materialize(groups.withColumn("absent", F.when(F.col("v") > 0, share(zero, F.col("total"), F.col("v"))).otherwise(zero)), "divergence-groups")
    few = checked_broadcast(groups.select("lang", "source", "total", "v", "absent"))
    shares = materialize(postings.join(few, ["lang", "source"]).select("lang", "source", "id", "absent", share(F.col("count"), F.col("total"), F.col("v")).alias("p")), "divergence-shares")

    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), F.asc("item"))
    lang_total = checked_broadcast(groups.groupBy("lang").agg(F.sum("total").alias("total")))
    whole = postings.groupBy("id").agg(F.sum("count").alias("count")).join(kept, "id").join(lang_total, "lang").join(checked_broadcast(terms), "lang").select("id", "term", share(F.col("count"), F.col("total"), F.col("v")).alias("q"))
    above = shares.join(whole, "id").where(F.col("p") > F.col("q")).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    own_terms = above.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most_terms)

    apart = source_distances(groups, shares, kept.count())
    both = apart.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("x"), "value")
    pairs = both.select("lang", "x.source", F.lit("pair").alias("part"), "x.item", "value").withColumn("rank", F.row_number().over(order))
    return pairs.unionByName(own_terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def source_distances(groups: DataFrame, shares: DataFrame, terms: int) -> DataFrame:
    """(lang, a, b, value) for each two sources a < b of a language.

    ``groups``: lang, source, own (terms it has), v (terms of the language), absent (share of a term it hasn't); a written
    table.  ``shares``: lang, source, id (of a term), p, absent.  ``terms``: how many there are in all.
    """
    left = groups.select("lang", F.col("source").alias("a"), F.col("own").alias("own_a"), F.col("absent").alias("absent_a"), "v")
    right = groups.select("lang", F.col("source").alias("b"), F.col("own").alias("own_b"), F.col("absent").alias("absent_b"))
    # the pairs asked for, each a row of the result; where the sources are few, no language meets in one task
    frame = left.repartition("lang", "a").join(checked_broadcast(right), "lang").where("a < b")
    frame = materialize(frame, "divergence-frame")
    rest = frame.select("lang", "a", "b", ((F.col("v") - F.col("own_a") - F.col("own_b")) * F.abs(F.col("absent_a") - F.col("absent_b"))).alias("value"))

    # G(source, z): running sums over the distinct shares of a source, at the other's share of an absent term
    asked = frame.select("lang", F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("absent_b").alias("z"), "a", "b"), F.struct(F.col("b").alias("source"), F.col("absent_a").alias("z"), "a", "b"))).alias("x")).select("lang", "x.*")
    zero = F.lit(0).cast("long")
    steps = shares.groupBy("lang", "source", "p").agg(F.count("*").alias("n")).select("lang", "source", F.col("p").alias("z"), F.lit(None).cast("string").alias("a"), F.lit(None).cast("string").alias("b"), "n")
    run = Window.partitionBy("lang", "source").orderBy("z").rangeBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("lang", "source")
    line = asked.withColumn("n", zero).unionByName(steps)
    n, mass = F.col("n"), F.col("n") * F.col("z")
    of_steps = F.when(F.col("a").isNull(), mass).otherwise(zero)
    line = line.select("lang", "a", "b", "z", F.sum(n).over(run).alias("n_below"), F.sum(of_steps).over(run).alias("below"), F.sum(n).over(every).alias("n_all"), F.sum(of_steps).over(every).alias("all"))
    z = F.col("z")
    sides = line.where("a IS NOT NULL").select("lang", "a", "b", ((F.col("all") - F.col("below")) - z * (F.col("n_all") - F.col("n_below")) + z * F.col("n_below") - F.col("below")).alias("value"))

    blocks = max(1, -(-groups.groupBy("lang").agg(F.count("*").alias("s")).agg(F.max("s")).first()[0] // SOURCES)) if not groups.isEmpty() else 1
    slices = max(1, -(-terms // SLICE_TERMS))
    block = F.pmod(F.xxhash64("source"), F.lit(blocks)).cast("int")
    # a posting meets those of every other block of sources
    meets = F.transform(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda o: F.struct(F.least(block, o).alias("x"), F.greatest(block, o).alias("y")))
    dealt = shares.withColumn("meet", F.explode(F.array_distinct(meets))).select("lang", "meet.x", "meet.y", F.pmod(F.xxhash64("id"), F.lit(slices)).cast("int").alias("slice"), "id", "source", block.alias("block"), "p", "absent")
    dealt = dealt.repartition("lang", "x", "y", "slice").sortWithinPartitions("lang", "x", "y", "slice", "id")
    common = dealt.mapInArrow(_corrections, "lang string, a string, b string, value long")
    return rest.unionByName(sides).unionByName(common).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))


def _corrections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Corrections for each two sources that share terms, summed up over the terms of a slice."""
    fields = pa.schema([("lang", pa.string()), ("a", pa.string()), ("b", pa.string()), ("value", pa.int64())])
    held, term, places, sums = None, None, {}, np.zeros((0, 0), dtype=np.int64)
    row: list[tuple[str, int, int, int]] = []

    def close() -> None:
        """Add the postings of one term."""
        nonlocal sums
        if len(row) < 2:
            return
        at = np.array([places.setdefault(s, len(places)) for s, *_ in row])
        if len(places) > len(sums):
            grown = np.zeros((2 * len(places),) * 2, dtype=np.int64)
            grown[: len(sums), : len(sums)] = sums
            sums = grown
        p, absent = (np.array([r[i] for r in row], dtype=np.int64) for i in (2, 3))
        cross = np.abs(p[:, None] - absent[None, :])
        sums[np.ix_(at, at)] += np.abs(p[:, None] - p[None, :]) - cross - cross.T + np.abs(absent[:, None] - absent[None, :])

    def table() -> Iterator[pa.RecordBatch]:
        names, (lang, x, y, _) = list(places), held
        rank = {s: b for s, b in blocks.items()}
        i, j = np.nonzero(sums[: len(names), : len(names)])
        rows = [(lang, names[a], names[b], int(sums[a, b])) for a, b in zip(i.tolist(), j.tolist(), strict=True) if names[a] < names[b] and {rank[names[a]], rank[names[b]]} == {x, y}]
        for k in range(0, len(rows), 50_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows[k : k + 50_000], strict=True), fields, strict=True)], schema=fields)

    blocks: dict[str, int] = {}
    for batch in batches:
        for lang, x, y, part, word, source, block, p, absent in zip(*(c.to_numpy(zero_copy_only=False).tolist() for c in batch.columns), strict=True):
            if word != term or held != (lang, x, y, part):
                close()
                row, term = [], word
                if held != (lang, x, y, part):
                    if held is not None:
                        yield from table()
                    held, places, blocks, sums = (lang, x, y, part), {}, {}, np.zeros((0, 0), dtype=np.int64)
            row.append((source, block, p, absent))
            blocks[source] = block
    close()
    if held is not None:
        yield from table()

"""From pages to chunks, values, failures and generations."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions import text as T
from wharfline.shared import checked_broadcast

BUDGET = 254
# Deductions in the order they are taken, and the floor for storing.
DEDUCTIONS = (("alternate_label", 0.15), ("page_split", 0.10), ("repaired", 0.25))
FLOOR = 0.80
OUTCOMES = ("no_value_found", "confidence_below_threshold", "coercion_failed", "ambiguous_value", "page_unresolved", "ungrouped_value", "invocation_failed")
LABELS = {"discipline": "discipline", "section": "section", "manufacturer": "manufacturer", "maker": "manufacturer", "quantity": "quantity", "qty": "quantity", "date": "date", "item": "item"}


def chunked(pages: DataFrame, *, budget: int = BUDGET) -> DataFrame:
    """Chunks of documents (document_id, body) of at most ``budget`` pieces (runs of non-blanks): ordinal, body, pieces, boundary.

    The descent is paragraph, then sentence, then pieces; whole units are packed while they fit.  One document is
    one row, so a document's ordinals need no shuffle; its chunks stream out.
    """

    def pack(body: str) -> Iterator[tuple[str, int, str]]:
        import re

        held: list[str] = []
        count = 0

        def units() -> Iterator[tuple[str, str]]:
            for paragraph in (body or "").split("\n"):
                if len(paragraph.split()) <= budget:
                    yield paragraph, "paragraph"
                    continue
                for sentence in re.split(r"(?<=[.!?])\s+", paragraph):
                    pieces = sentence.split()
                    if len(pieces) <= budget:
                        yield sentence, "sentence"
                    else:
                        for at in range(0, len(pieces), budget):
                            yield " ".join(pieces[at : at + budget]), "split_leaf"

        kind = "paragraph"
        for unit, level in units():
            n = len(unit.split())
            if not n:
                continue
            if held and count + n > budget:
                yield "\n".join(held), count, kind
                held, count = [], 0
            held.append(unit)
            count, kind = count + n, level
        if held:
            yield "\n".join(held), count, "document_end"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"document_id": d, "ordinal": i, "body": b, "pieces": n, "boundary": k} for d, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for i, (b, n, k) in enumerate(pack(body))]
            for at in range(0, len(rows), 4096):
                yield pa.RecordBatch.from_pylist(rows[at : at + 4096], schema=pa.schema([("document_id", pa.int64()), ("ordinal", pa.int64()), ("body", pa.string()), ("pieces", pa.int64()), ("boundary", pa.string())]))

    return pages.select("document_id", "body").mapInArrow(run, "document_id long, ordinal long, body string, pieces long, boundary string")


def body_lines(documents: DataFrame) -> DataFrame:
    """(document_id, line_no, line) of non-blank lines that are not page anchors, numbered anew."""
    kept = F.filter(F.split("body", "\n"), lambda line: ~T.blank(line) & ~line.rlike(T.PAGE_ANCHOR))
    return documents.select("document_id", F.posexplode(kept).alias("at", "line")).select("document_id", (F.col("at") + 1).alias("line_no"), "line")


def labelled_values(lines: DataFrame, labels: DataFrame, *, delimiter: str = "item") -> DataFrame:
    """Values behind known labels: on the same line, or alone on the next one if that is no label; item ordinals by delimiter."""
    label = T.folded(F.regexp_extract("line", T.LABELLED, 1))
    keyed = lines.withColumn("label", label).join(checked_broadcast(labels.select("label", "key")), "label", "left")
    own = Window.partitionBy("document_id").orderBy("line_no")
    inline = F.trim(F.regexp_extract("line", T.LABELLED, 2))
    seen = keyed.select(
        "document_id", "line_no", "key", "label", F.when(F.col("key").isNotNull(), inline).alias("inline"),
        F.lead("line").over(own).alias("next_line"), F.lead("key").over(own).alias("next_key"),
        F.sum(F.when(F.col("key") == delimiter, 1).otherwise(0)).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("item"),
    ).where("key is not null")
    below = (F.col("inline") == "") & F.col("next_key").isNull() & F.col("next_line").isNotNull()
    value = F.when(F.col("inline") != "", F.col("inline")).when(below, F.trim("next_line"))
    return seen.select("document_id", "line_no", "key", "label", F.col("item").alias("item_ordinal"), value.alias("value"), below.alias("on_next_line")).where("value is not null and value <> ''")


def confidence(alternate: Column, split: Column, repaired: Column) -> Column:
    """1 less the deductions whose signal is set, taken in their fixed order (float subtraction isn't associative)."""
    score: Column = F.lit(1.0)
    for signal, (_, weight) in zip((alternate, split, repaired), DEDUCTIONS, strict=True):
        score = F.when(signal, score - weight).otherwise(score)
    return score


def confidence_domain(spark) -> DataFrame:
    """The eight scores that the signals admit."""
    flags = spark.range(8).select((F.col("id") >= 4).alias("alternate"), (F.col("id") % 4 >= 2).alias("split"), (F.col("id") % 2 == 1).alias("repaired"))
    return flags.withColumn("score", confidence(F.col("alternate"), F.col("split"), F.col("repaired")))


def counts_over_domain(domain: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """A count for every member of a closed domain, zeros included."""
    return domain.join(rows.groupBy(*keys).agg(F.count("*").alias("n")), keys, "left").withColumn("n", F.coalesce("n", F.lit(0)))


def absences(documents: DataFrame, fields: DataFrame, values: DataFrame, anchors: DataFrame) -> DataFrame:
    """One no_value_found for each attempted field a document does not print, anchored on its least ordinal."""
    attempted = documents.select("document_id").join(checked_broadcast(fields.select("field")))  # a closed vocabulary of fields
    missing = attempted.join(values.select("document_id", "field").distinct(), ["document_id", "field"], "left_anti")
    return missing.join(anchors.groupBy("document_id").agg(F.min("ordinal").alias("ordinal")), "document_id", "left").withColumn("outcome", F.lit("no_value_found"))


def multiset_counts(produced: DataFrame, expected: DataFrame, keys: list[str], by: list[str]) -> DataFrame:
    """(by, stored, printed, matched): both sides as multisets over ``keys``, each value matched once at most.

    Both sides are folded to counts by one grouping, partly before the shuffle, so a value repeated any number of
    times is one cell.  A row with a null key matches nothing and counts on its own side.
    """
    side = lambda d, stored: d.select(*keys, F.lit(stored).alias("s"), F.lit(1 - stored).alias("e"))
    cells = side(produced, 1).unionByName(side(expected, 0)).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("e").alias("e"))
    whole = reduce(Column.__and__, [F.col(k).isNotNull() for k in keys])
    return cells.groupBy(*by).agg(F.sum("s").alias("stored"), F.sum("e").alias("printed"), F.sum(F.when(whole, F.least("s", "e")).otherwise(0)).alias("matched"))


def plan_documents(observed: DataFrame, active: DataFrame) -> DataFrame:
    """(document_id, action): load, unchanged or reload by the digest of its inputs; retire what is no longer observed."""
    both = observed.select("document_id", F.col("digest").alias("now")).join(active.select("document_id", F.col("digest").alias("held")), "document_id", "full")
    return both.select("document_id", F.when(F.col("held").isNull(), "load").when(F.col("now").isNull(), "retire").when(F.col("now") == F.col("held"), "unchanged").otherwise("reload").alias("action"))

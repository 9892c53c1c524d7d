"""Places in a total order without gathering rows: ranges, counts of each, and numbers inside a range."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import checked_broadcast, materialize


def numbered(rows: DataFrame, *order: str | Column, name: str = "position") -> DataFrame:
    """``rows`` with their 1-based place in the given order, which must be total (ties get an arbitrary order).

    The rows are dealt to ranges of the order and sorted there; what stands before a range is the sum of the counts of the
    ranges before it, one row each.  No task sees more than its range.  The rows are written once, since ranges are drawn
    from a sample and must not be drawn again.
    """
    sort = [F.col(c) if isinstance(c, str) else c for c in order]
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    dealt = rows.repartitionByRange(*sort).sortWithinPartitions(*sort)
    held = materialize(dealt.select("*", F.spark_partition_id().alias("_range"), inside.alias("_inside")), "ranges")
    counts = held.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_range")) - F.col("_n")).alias("_before"))  # a row for each range
    return held.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + F.col("_inside") + 1).drop("_range", "_inside", "_before")


def sealed(rows: DataFrame, *, group: str, text: str, order: tuple[str, ...] = (), block: int = 1024) -> DataFrame:
    """(group, n, digest): SHA-256 over the texts of each group in order, by way of a digest for each ``block`` of places.

    A block's texts are in one row, and a group's block digests, a thousandth of its rows, in another.
    """
    placed = numbered(rows, group, *(order or (text,)), name="_place")
    first = placed.groupBy(group).agg(F.min("_place").alias("_first"))
    placed = placed.join(checked_broadcast(first), group).withColumn("_block", F.floor((F.col("_place") - F.col("_first")) / block))
    in_order = lambda c, v: F.transform(F.array_sort(F.collect_list(F.struct(c, v))), lambda s: s[v])
    blocks = placed.groupBy(group, "_block").agg(F.count("*").alias("n"), F.sha2(F.array_join(in_order("_place", text), "\n"), 256).alias("_digest"))
    return blocks.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(in_order("_block", "_digest"), "\n"), 256).alias("digest"))

"""Greedy packing of ordered items without walking through them: where each pack would end, then jumps doubled."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import discard, materialize, shares


def packed(items: DataFrame, *, key: str, at: str, weight: str, budget: int) -> DataFrame:
    """(key, start, n): packs of consecutive items of each key, each as long as it stays within ``budget``.

    ``at`` numbers a key's items from 1 without a gap, weights are whole and 1 at least.  An item heavier than the budget is a pack of its
    own.  If a pack began at an item, the number of items with a prefix sum up to ``budget`` further says where the
    next would begin.  Which packs are taken follows from the first by jumps of 1, 2, 4, ... packs, so there are as
    many rounds as the longest chain of packs has binary digits, each a join by key and place, dealt in shares of a bounded
    number of items.  ``items`` are counted: give them as a written table where they are dear.
    """
    n = max(items.sparkSession.sparkContext.defaultParallelism, shares(items))
    dealt = lambda df, place: df.repartition(n, key, place)
    own = Window.partitionBy(key)
    before = F.coalesce(F.sum(weight).over(own.orderBy(at).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("long")
    sums = items.select(key, at, weight).repartition(n, key).select(key, F.col(at).cast("long").alias("start"), before.alias("before"), F.sum(weight).over(own).alias("total"))
    inside = F.count("*").over(own.orderBy("before").rangeBetween(1, budget)) + (F.col("total") <= F.col("before") + budget).cast("long")
    more = F.col("start") + F.greatest(inside, F.lit(1))
    nodes = materialize(sums.select(key, "start", more.alias("after"), (more <= F.count("*").over(own)).alias("inside")), "packs")
    marks, hops, made = nodes.where("start = 1").select(key, "start"), nodes.where("inside").select(key, "start", "after"), []
    while True:
        # renamed above the exchange: of two bare exchanges the planner would raise both to the session's number of partitions
        onward = dealt(hops, "start").select(F.col(key).alias("of"), F.col("start").alias("at"), F.col("after").alias("to"))
        on = lambda df, place: (df[key] == onward["of"]) & (df[place] == onward["at"])  # noqa: B023, E731
        reached = dealt(marks, "start")
        further = materialize(reached.join(onward, on(reached, "start")).select(reached[key], F.col("to").alias("start")), "marks")
        if further.isEmpty():
            break
        marks = marks.unionByName(further)
        ahead = dealt(hops, "after")
        hops = materialize(ahead.join(onward, on(ahead, "after")).select(ahead[key], ahead["start"], F.col("to").alias("after")), "hops")
        made.append(hops)
    discard(*made)
    held = dealt(nodes, "start").select(key, "start", (F.col("after") - F.col("start")).alias("n"))
    return marks.join(held, [key, "start"]).select(key, "start", "n")

"""Sojourns, censoring, splits and survival estimates over lifecycle logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.stats import Z95
from wharfline.shared import materialize


def sojourn_legs(events: DataFrame, *, key: str = "user_id", rework: str = "error") -> DataFrame:
    """Completed legs between consecutive events: states, whole UTC days, and the rework loops before the leg."""
    own = Window.partitionBy(key).orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, 0)
    return events.select(
        key, "seq", F.col("to_state").alias("state"), F.lead("to_state").over(own).alias("next_state"),
        F.datediff(F.lead("day").over(own), "day").alias("days"),
        F.sum(F.when(F.col("to_state") == rework, 1).otherwise(0)).over(before).alias("loops"),
    ).where("next_state is not null")


def open_legs(events: DataFrame, as_of: str, *, key: str = "user_id") -> DataFrame:
    """The last event of each log up to the anchor and the days it has been open; by a fold, not a window over the log."""
    seen = events.where(F.col("day") <= F.lit(as_of).cast("date"))
    last = seen.groupBy(key).agg(F.max_by(F.struct("to_state", "day", "seq"), "seq").alias("e"))
    return last.select(key, F.col("e.to_state").alias("state"), F.col("e.seq").alias("seq"), F.datediff(F.lit(as_of).cast("date"), "e.day").alias("days"))


def product_limit(rows: DataFrame, groups: list[str], *, days: str = "days", censored: str = "censored") -> DataFrame:
    """Kaplan-Meier steps with Greenwood's standard error at each completed duration of each group.

    Rows are folded to counts for each day first, so the windows run over distinct days only.  A row censored on
    an event day is at risk for it; the error is infinite once nobody remains.
    """
    counts = rows.groupBy(*groups, days).agg(F.count("*").alias("n"), F.sum((~F.col(censored)).cast("long")).alias("events"))
    own = Window.partitionBy(*groups) if groups else Window.partitionBy(F.lit(0))
    counts = counts.withColumn("at_risk", F.sum("n").over(own.orderBy(F.desc(days)))).where("events > 0")
    upto = own.orderBy(days)
    left = F.col("at_risk") - F.col("events")
    steps = counts.withColumn("survival", F.product(1 - F.col("events") / F.col("at_risk")).over(upto))
    steps = steps.withColumn("spread", F.sum(F.when(left > 0, F.col("events") / (F.col("at_risk") * left))).over(upto)).withColumn("exhausted", F.max(left == 0).over(upto))
    error = F.when(F.col("exhausted"), F.lit(float("inf"))).otherwise(F.col("survival") * F.sqrt("spread"))
    return steps.select(*groups, F.col(days).alias("days"), "at_risk", "events", "survival", error.alias("standard_error"))


def median_band(steps: DataFrame, groups: list[str], z: float = Z95) -> DataFrame:
    """First day with survival at or below one half, and the days whose survival lies within z errors of it (Brookmeyer-Crowley)."""
    near = (F.col("days") > 0) & (F.abs(F.col("survival") - 0.5) <= z * F.col("standard_error"))
    out = steps.groupBy(*groups).agg(F.min(F.when(F.col("survival") <= 0.5, F.col("days"))).alias("median"), F.min(F.when(near, F.col("days"))).alias("a"), F.max(F.when(near, F.col("days"))).alias("b"))
    return out.select(*groups, "median", F.when(F.col("median").isNotNull(), F.least("a", "median")).alias("low"), F.when(F.col("median").isNotNull(), F.greatest("b", "median")).alias("high"))


def draw_key(data_hash: str, seed: int, fraction: float, *parts: str) -> Column:
    """A line's place in the shuffle: the digest of the data's hash, the seed, the fraction and the natural key."""
    return F.sha2(F.concat_ws("|", F.lit(data_hash), F.lit(str(seed)), F.lit(repr(fraction)), *(F.col(p).cast("string") for p in parts)), 256)


def stratified_split(lines: DataFrame, *, stratum: str, keys: list[str], data_hash: str, seed: int = 20260601, fraction: float = 0.25) -> DataFrame:
    """``lines`` with split_side: in each stratum the floor(fraction * n + 0.5) least draw keys are held out.

    A stratum may hold most rows, and a rank over it would sort them in one task.  So keys are first counted by
    their leading hexadecimal digits; only the digits at the quota's edge are ranked, a small share of the rows.
    """
    drawn = lines.withColumn("draw", draw_key(data_hash, seed, fraction, *keys)).withColumn("lead", F.substring("draw", 1, 3))
    counts = drawn.groupBy(stratum, "lead").agg(F.count("*").alias("here"))
    own = Window.partitionBy(stratum)
    edges = counts.withColumn("upto", F.sum("here").over(own.orderBy("lead"))).withColumn("quota", F.floor(fraction * F.sum("here").over(own) + 0.5)).select(stratum, "lead", (F.col("upto") - F.col("here")).alias("before"), "upto", "quota")
    placed = drawn.join(edges, [stratum, "lead"])  # 4096 leads for each stratum: adaptive plans measure it before they broadcast it
    at_edge = (F.col("before") < F.col("quota")) & (F.col("quota") < F.col("upto"))
    clear = placed.where(~at_edge).withColumn("split_side", F.when(F.col("upto") <= F.col("quota"), "held_out").otherwise("train"))
    near = placed.where(at_edge).withColumn("r", F.row_number().over(Window.partitionBy(stratum, "lead").orderBy("draw", *keys)))
    near = near.withColumn("split_side", F.when(F.col("before") + F.col("r") <= F.col("quota"), "held_out").otherwise("train")).drop("r")
    return clear.unionByName(near).drop("draw", "lead", "before", "upto", "quota")


def counts_with_zeros(roster: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """A count for every member of the roster, zeros included."""
    return roster.select(key).distinct().join(rows.groupBy(key).agg(F.count("*").alias("n")), key, "left").select(key, F.coalesce("n", F.lit(0)).alias("n"))


def variance_decomposition(rows: DataFrame, *, value: str, first: str, second: str) -> DataFrame:
    """Shares of variance: between groups of ``first``, between groups of ``second`` once ``first`` is removed, and the rest.

    One row.  All terms come from sums folded by (first, second), so the rows are shuffled once, pre-aggregated.
    """
    v = F.col(value).cast("double")
    cells = rows.groupBy(first, second).agg(F.count("*").alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"))
    means = cells.groupBy(first).agg((F.sum("s") / F.sum("n")).alias("m"))
    moved = cells.join(means, first).withColumn("r", F.col("s") - F.col("n") * F.col("m"))
    total = cells.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"), F.sum("q").alias("all_q"))
    by_first = cells.groupBy(first).agg(F.sum("n").alias("n"), F.sum("s").alias("s")).crossJoin(total).agg(F.sum(F.col("n") * F.pow(F.col("s") / F.col("n") - F.col("all_s") / F.col("all_n"), 2)).alias("b1"))
    by_second = moved.groupBy(second).agg(F.sum("n").alias("n"), F.sum("r").alias("r")).agg(F.sum(F.col("n") * F.pow(F.col("r") / F.col("n"), 2)).alias("b2"))
    out = total.crossJoin(by_first).crossJoin(by_second)  # one row each
    whole = F.col("all_q") / F.col("all_n") - F.pow(F.col("all_s") / F.col("all_n"), 2)
    return out.select(F.col("all_n").alias("n"), whole.alias("total"), (F.col("b1") / F.col("all_n")).alias("between_first"), (F.col("b2") / F.col("all_n")).alias("between_second")).withColumn("residual", F.greatest(F.lit(0.0), F.col("total") - F.col("between_first") - F.col("between_second")))


def terciles(rows: DataFrame, *, value: str, key: str, levels: tuple[str, ...] = ("TIGHT", "MODERATE", "RELAXED"), lead_chars: int = 6) -> DataFrame:
    """``rows`` with level: min(rank * 3 // n, 2) by (value, key) over the whole table.

    Ranks come from counts of distinct values, a short table: most values lie inside one level.  Rows of a value that
    a cut divides are counted by the first ``lead_chars`` characters of their key (thousands of a number), and only the
    lead that holds the cut is ranked.
    """
    n = len(levels)
    # leads stand in the order of the keys: a prefix of texts, thousands of numbers
    is_text = dict(rows.dtypes)[key] == "string"
    lead = F.substring(key, 1, lead_chars) if is_text else F.floor(F.col(key) / 1000)
    counts = materialize(rows.groupBy(value).agg(F.count("*").alias("here")), "counts").withColumn("zone", F.lit(0))
    upto = Window.partitionBy("zone").orderBy(value)
    placed = counts.withColumn("before", F.sum("here").over(upto) - F.col("here")).withColumn("whole", F.sum("here").over(Window.partitionBy("zone"))).drop("zone")
    place = lambda r: F.least(F.floor(r * n / F.col("whole")), F.lit(n - 1)).cast("int")
    ends = placed.select(value, "before", "whole", place(F.col("before")).alias("first"), place(F.col("before") + F.col("here") - 1).alias("last"))
    known = rows.join(ends, value)
    name = lambda r: F.element_at(F.array(*map(F.lit, levels)), r + 1)
    clear = known.where(F.col("first") == F.col("last")).withColumn("level", name(F.col("first")))
    cut = known.where(F.col("first") != F.col("last")).withColumn("lead", lead)
    leads = cut.groupBy(value, "lead").agg(F.count("*").alias("inside"))
    leads = leads.withColumn("ahead", F.sum("inside").over(Window.partitionBy(value).orderBy("lead")) - F.col("inside"))
    near = cut.join(leads, [value, "lead"])
    low, high = place(F.col("before") + F.col("ahead")), place(F.col("before") + F.col("ahead") + F.col("inside") - 1)
    settled = near.where(low == high).withColumn("level", name(low))
    rank = F.row_number().over(Window.partitionBy(value, "lead").orderBy(key)) - 1 + F.col("before") + F.col("ahead")
    divided = near.where(low != high).withColumn("r", rank).withColumn("level", name(place(F.col("r"))))
    names = [*rows.columns, "level"]
    return clear.select(*names).unionByName(settled.select(*names)).unionByName(divided.select(*names))


#: Criticality of a (tier, pressure) pair.
BANDS = [("T1", "TIGHT", 5), ("T1", "MODERATE", 4), ("T1", "RELAXED", 3), ("T2", "TIGHT", 4), ("T2", "MODERATE", 3), ("T2", "RELAXED", 2), ("T3", "TIGHT", 3), ("T3", "MODERATE", 2), ("T3", "RELAXED", 1)]


def hpdi(ordered: Column, mass: float = 0.9) -> Column:
    """Narrowest window of an ascending array that holds the share ``mass``: a struct of its ends, the first of equals."""
    keep = F.greatest(F.lit(1), F.ceil(F.lit(mass) * F.size(ordered)).cast("int"))
    starts = F.sequence(F.lit(1), F.size(ordered) - keep + 1)
    windows = F.transform(starts, lambda i: F.struct((F.element_at(ordered, i + keep - 1) - F.element_at(ordered, i)).alias("width"), i.alias("at"), F.element_at(ordered, i).alias("low"), F.element_at(ordered, i + keep - 1).alias("high")))
    return F.array_min(windows)

"""The risk worklist: states, harm, orders, overrides."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions.arrays import nearest_rank

#: States without figures; their lines are not ranked.
SUPPRESSED = ("no_active_run", "roster_mismatch", "not_covered")
MAX_OVERRIDES, OVERRIDE_WINDOW_DAYS, STALE_AFTER_DAYS = 25, 3660, 7

#: Closed set of orders; each ends in need-by, criticality and id, so that it is total.
SORTS = {
    "harm": [("harm", False)],
    "need_by_date": [("offset", True)],
    "calendar_margin": [("offset", True)],
    "criticality": [("criticality", False)],
}
TIES = [("need_by", True), ("criticality", False), ("line_id", True)]


def effective_dates(lines: DataFrame, overrides: DataFrame | None = None, *, as_of: str | None = None) -> DataFrame:
    """``lines`` with need_by replaced by a what-if date where ``overrides`` (line_id, what_if) has one, and is_adjusted.

    More than MAX_OVERRIDES, two for one line, one without a date or, with ``as_of``, one outside the window around it
    refuse the request as a whole.
    """
    if overrides is None:
        return lines.withColumn("is_adjusted", F.lit(False))
    held = overrides.select("line_id", "what_if").limit(MAX_OVERRIDES + 1).collect()  # a request's list, checked
    if len(held) > MAX_OVERRIDES:
        raise ValueError(f"more than {MAX_OVERRIDES} overrides")
    if len({r["line_id"] for r in held}) < len(held) or any(r["line_id"] is None or r["what_if"] is None for r in held):
        raise ValueError("an override needs a line of its own and a date")
    if as_of and any(abs((r["what_if"] - date.fromisoformat(as_of)).days) > OVERRIDE_WINDOW_DAYS for r in held):
        raise ValueError(f"an override lies more than {OVERRIDE_WINDOW_DAYS} days from {as_of}")
    few = F.broadcast(lines.sparkSession.createDataFrame([tuple(r) for r in held], "line_id string, what_if date"))
    return lines.join(few, "line_id", "left").withColumn("is_adjusted", F.col("what_if").isNotNull()).withColumn("need_by", F.coalesce("what_if", "need_by")).drop("what_if")


def override_outcomes(overrides: DataFrame, lines: DataFrame, project: str) -> DataFrame:
    """(line_id, outcome): applied, terminal (closed), out_of_scope (another project) or not_found."""
    asked = overrides.select("line_id").distinct()
    known = lines.select("line_id", F.col("project").alias("own"), "is_closed").join(asked, "line_id")
    outcome = F.when(F.col("own").isNull(), "not_found").when(F.col("is_closed"), "terminal").when(F.col("own") != project, "out_of_scope").otherwise("applied")
    return asked.join(known, "line_id", "left").select("line_id", outcome.alias("outcome"))


def row_state(*, has_run: Column, roster_ok: Column, covered: Column, offset: Column, need_by: Column, horizon: int, today: str) -> Column:
    """First match wins, in this order."""
    return (
        F.when(~has_run, "no_active_run")
        .when(~roster_ok, "roster_mismatch")
        .when(~covered, "not_covered")
        .when(offset > horizon, "beyond_horizon")
        .when(offset <= 0, "already_late")
        .when(need_by < F.lit(today).cast("date"), "calendar_passed")
        .otherwise("nominal")
    )


def tails(posteriors: DataFrame, *, key: str = "vendor") -> DataFrame:
    """``posteriors`` (key, draws) with total, total_sum, tail_n and tail_sum: for each whole day from 0 on, how many draws lie beyond it and their sum.

    Draws are folded to counts of distinct days first; the arrays end where nothing lies beyond.  What a line needs
    of its posterior is then one look-up, not a pass over the draws.
    """
    days = posteriors.select(key, F.explode("draws").alias("d")).groupBy(key, "d").agg(F.count("*").alias("n"))
    own, upto = Window.partitionBy(key), Window.partitionBy(key).orderBy("d")
    w = F.col("n") * F.col("d")
    run = days.select(key, "d", F.lag("d", 1, 0).over(upto).alias("low"), F.sum("n").over(own).alias("total"), F.sum(w).over(own).alias("total_sum"), (F.sum("n").over(own) - F.sum("n").over(upto) + F.col("n")).alias("c"), (F.sum(w).over(own) - F.sum(w).over(upto) + w).alias("s"))
    cells = run.withColumn("at", F.explode_outer(F.when(F.col("d") > F.col("low"), F.sequence("low", F.col("d") - 1))))
    cell = F.when(F.col("at").isNotNull(), F.struct("at", "c", "s"))
    folded = cells.groupBy(key).agg(F.first("total").alias("total"), F.first("total_sum").alias("total_sum"), F.array_sort(F.collect_list(cell)).alias("cells"))
    return posteriors.join(folded.select(key, "total", "total_sum", F.transform("cells", lambda x: x["c"]).alias("tail_n"), F.transform("cells", lambda x: x["s"]).alias("tail_sum")), key)


def beyond(day: Column) -> Column:
    """How many draws lie beyond a day that is not negative, read from ``tail_n``."""
    return F.coalesce(F.get("tail_n", day.cast("int")), F.lit(0))


def overrun(at: Column) -> Column:
    """Mean of max(0, draw - at) over the draws, read from the tails."""
    inside = F.coalesce(F.get("tail_sum", at.cast("int")), F.lit(0)) - at * beyond(at)
    return F.when(at < 0, F.col("total_sum") - at * F.col("total")).otherwise(inside).cast("double") / F.col("total")


def score(lines: DataFrame, posteriors: DataFrame, *, as_of: str, today: str, horizon: int, has_run: bool = True) -> DataFrame:
    """Open lines with state, figures and harm; the run's posterior is joined after it is narrowed, so lines without one stay."""
    open_lines = lines.where(~F.col("is_closed"))
    held = tails(posteriors).select("vendor", "total", "total_sum", "tail_n", "tail_sum", nearest_rank(F.col("draws"), 0.5).alias("p50"), nearest_rank(F.col("draws"), 0.8).alias("p80"))
    joined = open_lines.join(held, "vendor", "left")
    offset = F.datediff("need_by", F.lit(as_of).cast("date"))
    state = row_state(has_run=F.lit(has_run), roster_ok=F.col("vendor") % 97 != 13, covered=F.col("total").isNotNull(), offset=F.col("offset"), need_by=F.col("need_by"), horizon=horizon, today=today)
    out = joined.withColumn("offset", offset).withColumn("state", state)
    ranked = ~F.col("state").isin(*SUPPRESSED)
    at = F.col("offset")
    # an offset within the grid reads its cell; beyond the horizon the mass beyond it bounds the chance from above
    miss = F.when(at >= 1, beyond(F.least(at, F.lit(horizon))) / F.col("total"))
    return out.select(
        *lines.columns, "offset", "state", ranked.alias("is_ranked"),
        F.when(ranked, overrun(at) * F.col("criticality")).alias("harm"),
        F.when(ranked, F.col("p50")).alias("p50"), F.when(ranked, F.col("p80")).alias("p80"),
        F.when(ranked, miss).alias("miss"), (ranked & (at > horizon)).alias("miss_is_bound"),
    )


def order_columns(sort: str) -> list[Column]:
    if sort not in SORTS:
        raise ValueError(f"unknown order {sort!r}; known: {sorted(SORTS)}")
    keys = SORTS[sort] + [t for t in TIES if t[0] not in {k for k, _ in SORTS[sort]}]
    return [F.col(c).asc() if up else F.col(c).desc() for c, up in keys]


def top(scored: DataFrame, sort: str, limit: int) -> DataFrame:
    """The first ``limit`` ranked lines with their rank: top-k first, then numbers over those few rows."""
    keys = order_columns(sort)
    few = scored.where("is_ranked").orderBy(*keys).limit(limit)
    return few.withColumn("rank", F.row_number().over(Window.orderBy(*keys)))


def page_state(has_run: Column, age_days: Column, rows: Column) -> Column:
    return F.when(~has_run, "no_active_run").when(rows == 0, "empty_filter").when(age_days > STALE_AFTER_DAYS, "stale").otherwise("fresh")

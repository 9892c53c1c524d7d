"""Legal walks of procurement lines: event dates, validity, sojourn frames, design rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.shared import checked_broadcast

# The states of a line and the edges it may take.
STATES = ("submitted", "under_review", "approved", "revise_and_resubmit", "released_for_fabrication", "shipped", "delivered")
EDGES = [
    ("submitted", "under_review"), ("under_review", "approved"), ("under_review", "revise_and_resubmit"), ("revise_and_resubmit", "submitted"),
    ("approved", "released_for_fabrication"), ("released_for_fabrication", "shipped"), ("shipped", "delivered"),
]
BRANCH, REWORK, TERMINAL = "under_review", "revise_and_resubmit", "delivered"


def state_sequence(loops: Column) -> Column:
    """The states that a line with so many rework loops visits, in order."""
    words = lambda *names: F.array(*map(F.lit, names))
    again = F.flatten(F.array_repeat(words(REWORK, "submitted", BRANCH), loops.cast("int")))
    return F.concat(words("submitted", BRANCH), again, words("approved", "released_for_fabrication", "shipped", TERMINAL))


def dated(steps: DataFrame, *, key: str, start: str, as_of: str) -> DataFrame:
    """``steps`` (key, seq, start, leg_days) with occurred_on, the running sum of the days before, cut off at ``as_of``."""
    before = Window.partitionBy(key).orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = steps.withColumn("occurred_on", F.date_add(start, F.sum("leg_days").over(before).cast("int")))
    return out.where(F.col("occurred_on") <= F.lit(as_of).cast("date"))


def walk_verdicts(events: DataFrame, *, key: str) -> DataFrame:
    """(key, verdict): the first rule that a walk (key, seq, to_state, occurred_on) breaks, or legal.

    Numbers run from 1 without a gap, the first state opens, every edge is legal, dates strictly rise.
    """
    own = Window.partitionBy(key).orderBy("seq")
    legal = F.array(*(F.lit(f"{a}>{b}") for a, b in EDGES))
    before = F.lag("to_state").over(own)
    marked = events.select(
        key, "seq", F.row_number().over(own).alias("at"), "to_state",
        (before.isNotNull() & ~F.array_contains(legal, F.concat_ws(">", before, "to_state"))).alias("barred"),
        F.coalesce(F.col("occurred_on") <= F.lag("occurred_on").over(own), F.lit(False)).alias("late"),
    )
    has = lambda c: F.max(c.cast("int")) == 1
    out = marked.groupBy(key).agg(has(F.col("seq") != F.col("at")).alias("gap"), has((F.col("at") == 1) & (F.col("to_state") != "submitted")).alias("opening"), has(F.col("barred")).alias("edge"), has(F.col("late")).alias("dates"))
    return out.select(key, F.when(F.col("gap"), "gap").when(F.col("opening"), "opening_state").when(F.col("edge"), "barred_edge").when(F.col("dates"), "dates_do_not_rise").otherwise("legal").alias("verdict"))


def sojourn_frame(events: DataFrame, *, key: str, as_of: str) -> DataFrame:
    """One row for each completed leg and one for the open leg of each line that has not arrived.

    Columns: key, seq, state, next_state (null: open), days, is_open, at_branch (the state has two ways out),
    took_rework (null unless a completed branch leg), cycle (rework loops before the leg).
    """
    own = Window.partitionBy(key).orderBy("seq")
    legs = events.select(
        key, "seq", F.col("to_state").alias("state"), F.lead("to_state").over(own).alias("next_state"), "occurred_on", F.lead("occurred_on").over(own).alias("left_on"),
        F.sum((F.col("to_state") == REWORK).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)).alias("cycle"),
    )
    kept = legs.where(F.col("next_state").isNotNull() | (F.col("state") != TERMINAL))
    is_open, branch = F.col("next_state").isNull(), F.col("state") == BRANCH
    return kept.select(key, "seq", "state", "next_state", F.datediff(F.coalesce("left_on", F.lit(as_of).cast("date")), "occurred_on").cast("long").alias("days"), is_open.alias("is_open"), branch.alias("at_branch"), F.when(branch & ~is_open, F.col("next_state") == REWORK).alias("took_rework"), "cycle")


def ranked_members(rows: DataFrame, column: str, *, width: int = 1000) -> DataFrame:
    """(member, ordinal): zero-based ranks of the distinct integers of a column, however many.

    Members are counted by ranges of ``width`` first; the ranks inside a range are taken range by range.
    """
    members = rows.select(F.col(column).cast("long").alias("member")).where("member is not null").distinct().withColumn("range", F.floor(F.col("member") / width))
    counts = members.groupBy("range").agg(F.count("*").alias("here")).withColumn("zone", F.lit(0))  # one row for each range of members
    before = counts.select("range", (F.sum("here").over(Window.partitionBy("zone").orderBy("range")) - F.col("here")).alias("before"))
    return members.join(before, "range").select("member", (F.col("before") + F.row_number().over(Window.partitionBy("range").orderBy("member")) - 1).cast("long").alias("ordinal"))


def design_rows(lines: DataFrame, *, key: str, blocks: dict[str, DataFrame]) -> DataFrame:
    """The one-hot design of lines as (key, column, value): a block of columns for each covariate, one after the other.

    ``blocks`` is covariate -> (member, ordinal); a member that the index lacks has no row.
    """
    out, at = None, F.lit(0).cast("long")
    sizes = [b.agg(F.count("*").alias("n")) for b in blocks.values()]
    for i, (name, index) in enumerate(blocks.items()):
        part = lines.select(key, F.col(name).alias("member")).join(index, "member")
        for width in sizes[:i]:
            part = part.crossJoin(F.broadcast(width.withColumnRenamed("n", "shift"))).withColumn("ordinal", F.col("ordinal") + F.col("shift")).drop("shift")  # one row
        part = part.select(key, (F.col("ordinal") + at).alias("column"), F.lit(1.0).alias("value"))
        out = part if out is None else out.unionByName(part)
    return out


#: The two ways out of the branch state, forward and back; every other state has one.
WAYS = {a: [b for x, b in EDGES if x == a] for a, _ in EDGES}
FORWARD = {a: ways[0] for a, ways in WAYS.items()}


def log_contributions(frame: DataFrame, sojourns: DataFrame, branching: DataFrame, *, key: str) -> DataFrame:
    """(key, seq, state, days, is_open, draw, log_c): what each leg of a sojourn frame adds to the log-likelihood under each draw.

    ``sojourns`` (draw, state, next_state, mu, sigma): logs of the days of a leg; ``branching`` (draw, intercept, beta):
    the log-odds of rework at the branch state by rework loops before.  A completed leg adds the density of its days.
    An open leg adds the chance that it lasts longer; at the branch state, where it has not chosen its way, the
    mixture of both ways, summed in logarithms.  A leg of no days is certain to last longer, and as a completed one
    has no density (null).  A draw that lacks a parameter of a leg has no row for it.
    """
    way = lambda state, last: F.coalesce(*(F.when(state == a, w[-1] if last else w[0]) for a, w in WAYS.items()))
    state, days = F.col("state"), F.col("days")
    legs = frame.select(key, "seq", "state", "days", "is_open", "cycle", F.when(F.col("is_open"), way(state, False)).otherwise(F.col("next_state")).alias("way"), F.when(F.col("is_open"), way(state, True)).alias("other_way"))
    side = lambda name, out: checked_broadcast(sojourns.select("draw", "state", F.col("next_state").alias(name), F.col("mu").alias(f"mu_{out}"), F.col("sigma").alias(f"sigma_{out}")))
    drawn = legs.join(side("way", "a"), ["state", "way"])
    drawn = drawn.join(side("other_way", "b"), ["draw", "state", "other_way"], "left").join(checked_broadcast(branching), "draw")
    log_t = F.log(F.when(days > 0, days.cast("double")))
    z = lambda out: (log_t - F.col(f"mu_{out}")) / F.col(f"sigma_{out}")
    lasts = lambda out: F.when(days > 0, stats.log_upper_tail(z(out))).otherwise(0.0)
    odds = F.col("intercept") + F.col("beta") * F.col("cycle")
    mixed = stats.log_sum(-stats.softplus(odds) + lasts("a"), -stats.softplus(-odds) + lasts("b"))
    density = -log_t - F.log("sigma_a") - stats.HALF_LOG_2PI - z("a") * z("a") / 2
    known = (state != BRANCH) | ~F.col("is_open") | F.col("mu_b").isNotNull()
    value = F.when(~F.col("is_open"), density).when(state == BRANCH, mixed).otherwise(lasts("a"))
    return drawn.where(known).select(key, "seq", "state", "days", "is_open", "draw", value.alias("log_c"))


def predictive(contributions: DataFrame, *, key: str) -> DataFrame:
    """(key, seq, draws, mean, log_mean) of each leg: the mean of log_c over the draws, and the logarithm of the mean chance."""
    top = contributions.groupBy(key, "seq").agg(F.count("log_c").alias("draws"), F.avg("log_c").alias("mean"), F.max("log_c").alias("top"), F.sort_array(F.collect_list("log_c")).alias("all"))
    shifted = F.aggregate(F.transform("all", lambda v: F.exp(v - F.col("top"))), F.lit(0.0), lambda a, b: a + b)
    log_mean = F.when(F.col("top") == F.lit(float("-inf")), F.col("top")).otherwise(F.col("top") + F.log(shifted / F.col("draws")))
    return top.select(key, "seq", "draws", "mean", log_mean.alias("log_mean"))

"""Duration forecasts: an empirical-Bayes lognormal fit, conditional remaining quantiles, chain diagnostics.

The fit is by moments in closed form, with vendor effects shrunk to their category; it stands where a sampler
would, and its posteriors are not a sampler's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wharfline.functions import stats


def variances(lines: DataFrame, *, group: str, member: str, days: str) -> tuple[DataFrame, DataFrame]:
    """(group, member, n, m, v) of log durations, and (group, gm, within, between): each group's mean and variances within and between members.

    Everything comes from sums folded by (group, member); the fold of groups is joined back, never collected.
    """
    y, w = F.log1p(F.col(days).cast("double")), F.col("n")
    cells = lines.groupBy(group, member).agg(F.count("*").alias("n"), F.avg(y).alias("m"), F.var_pop(y).alias("v"))
    groups = cells.groupBy(group).agg((F.sum(w * F.col("m")) / F.sum(w)).alias("gm"), (F.sum(w * F.col("v")) / F.sum(w)).alias("within"))
    return cells, cells.join(groups, group).groupBy(group).agg(F.first("gm").alias("gm"), F.first("within").alias("within"), (F.sum(w * F.pow(F.col("m") - F.col("gm"), 2)) / F.sum(w)).alias("between"))


def lognormal_fit(lines: DataFrame, *, group: str = "category", member: str = "vendor", days: str = "duration") -> DataFrame:
    """(group, member, n, mu, sigma) of completed durations: the group's log mean plus the member's shrunk offset."""
    cells, spread = variances(lines, group=group, member=member, days=days)
    out = cells.join(spread, group)
    rho = F.when(F.col("within") > 0, stats.shrinkage(F.col("between"), F.col("within"), F.col("n"))).otherwise(0.0)
    return out.select(group, member, "n", (F.col("gm") + rho * (F.col("m") - F.col("gm"))).alias("mu"), F.sqrt("within").alias("sigma"))


def remaining(open_lines: DataFrame, fit: DataFrame, shares: tuple[float, ...] = (0.5, 0.8), *, group: str = "category", member: str = "vendor") -> DataFrame:
    """(line_id, elapsed, share, days): quantiles of the days left of each open line, given the days it has been open."""
    asked = F.explode(F.array(*map(F.lit, shares))).alias("share")
    rows = open_lines.join(fit, [group, member]).where("sigma > 0").select("line_id", F.col("days").cast("double").alias("elapsed"), "mu", "sigma", asked)
    return rows.select("line_id", "elapsed", "share", stats.remaining_quantile("share", "elapsed", "mu", "sigma").alias("days"))


def chain_diagnostics(draws: DataFrame, *, parameter: str, chain: str, value: str) -> DataFrame:
    """(parameter, chains, draws, r_hat): potential scale reduction from folded chain means and variances."""
    per = draws.groupBy(parameter, chain).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_samp(value).alias("v"))
    out = per.groupBy(parameter).agg(F.count("*").alias("chains"), F.sum("n").alias("draws"), F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"))
    return out.select(parameter, "chains", "draws", F.sqrt((F.col("w") * (F.col("n") - 1) / F.col("n") + F.col("b")) / F.col("w")).alias("r_hat"))


def gate(diagnostics: DataFrame, *, ceiling: float) -> DataFrame:
    """Every diagnostic with passed; a run with one that does not pass is refused as a whole."""
    return diagnostics.withColumn("passed", F.coalesce(F.col("r_hat") <= ceiling, F.lit(False)))


#: Draws of a pair of scales that every task is given, at most; a sampler's run has some thousands.
SCALE_DRAWS = 20_000


def effect_intervals(counts: DataFrame, draws: DataFrame, *, n: str = "n", between: str = "tau", within: str = "sigma", level: float = 0.9) -> DataFrame:
    """``counts`` with spread (median over draws), low and high of a member's effect, which its ``n`` rows have taught.

    Given one draw of the two standard deviations the effect is normal about 0 with spread t s / sqrt(n t^2 + s^2); the
    interval is the narrowest that holds ``level`` of the mixture over all draws.  It depends on n alone, so each
    distinct n is solved once.  A member without rows keeps the whole spread between members; draws with a null are
    left out, and without any the three columns are null.
    """
    held = draws.select(F.col(between).cast("double").alias("t"), F.col(within).cast("double").alias("s")).dropna().limit(SCALE_DRAWS + 1).toPandas().sort_values(["t", "s"])
    if len(held) > SCALE_DRAWS:
        raise ValueError(f"more than {SCALE_DRAWS} draws of the scales")
    t, s = held["t"].to_numpy(), held["s"].to_numpy()

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 64) for i in range(0, batch.num_rows if len(t) else 0, 64)):
                m = part.column(0).to_numpy()[:, None]
                root = np.sqrt(m * t**2 + s**2)
                spreads = np.where(m > 0, np.divide(t * s, root, out=np.zeros_like(root), where=root > 0), t)
                half = stats.mixture_half_width(spreads, level)
                yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, (np.median(spreads, axis=1), -half, half))], ["rows", "spread", "low", "high"])

    rows = F.col(n).cast("long")
    by_n = counts.where(rows.isNotNull()).select(rows.alias("rows")).distinct().mapInArrow(solved, "rows long, spread double, low double, high double")
    return counts.withColumn("rows", rows).join(by_n, "rows", "left").drop("rows")


#: Lags that an autocorrelation is followed over, at most.
LAGS = 20
# Metric, threshold, direction, scope, whether a breach refuses the run.
GATE = [
    ("r_hat", 1.01, "max", "parameter", True), ("ess_bulk", 400.0, "min", "parameter", True), ("ess_tail", 400.0, "min", "parameter", True),
    ("divergent_transitions", 0.0, "max", "run", True), ("ebfmi", 0.3, "min", "run", True), ("max_treedepth_hits", 0.0, "max", "run", False),
]


def effective_sizes(draws: DataFrame, *, parameter: str, chain: str, order: str, value: str, lags: int = LAGS) -> DataFrame:
    """(parameter, chains, draws, ess): draws over 1 + 2 times the sum of autocorrelations, by initial positive pairs.

    Autocovariances come from lagged products folded by chain; the pooled variance is that of the scale reduction.
    A parameter whose pairs are still positive after ``lags`` lags has no size (null), and a gate refuses it: ask for more lags.
    """
    own = Window.partitionBy(parameter, chain).orderBy(order)
    m = F.avg(value).over(Window.partitionBy(parameter, chain))
    centred = draws.select(parameter, chain, order, F.col(value).alias("v"), (F.col(value) - m).alias("z"))
    lagged = centred.select(parameter, chain, "v", *((F.col("z") * F.lag("z", k).over(own) if k else F.col("z") * F.col("z")).alias(f"p{k}") for k in range(lags)))
    per = lagged.groupBy(parameter, chain).agg(F.count("*").alias("n"), F.avg("v").alias("m"), F.var_samp("v").alias("v"), *(F.coalesce(F.sum(f"p{k}"), F.lit(0.0)).alias(f"s{k}") for k in range(lags)))
    folded = per.groupBy(parameter).agg(F.count("*").alias("chains"), F.sum("n").alias("draws"), F.avg("n").alias("n"), F.avg("v").alias("w"), F.var_samp("m").alias("b"), *(F.avg(F.col(f"s{k}") / F.col("n")).alias(f"c{k}") for k in range(lags)))
    pooled = folded.withColumn("pool", F.col("w") * (F.col("n") - 1) / F.col("n") + F.col("b"))
    rho = [1 - (F.col("w") - F.col(f"c{k}")) / F.col("pool") for k in range(lags)]
    pairs = F.array(*(rho[k] + rho[k + 1] for k in range(0, lags - 1, 2)))
    first_bad = F.array_min(F.filter(F.transform(pairs, lambda p, i: F.when(p <= 0, i)), lambda i: i.isNotNull()))
    total = F.aggregate(F.slice(pairs, 1, F.greatest(first_bad, F.lit(1))), F.lit(0.0), lambda a, p: a + p)
    return pooled.select(parameter, "chains", "draws", F.when(first_bad.isNotNull(), F.col("draws") / F.greatest(2 * total - 1, F.lit(1e-9))).alias("ess"))


def energy_diagnostics(steps: DataFrame, *, chain: str, order: str, energy: str, diverged: str, deep: str) -> DataFrame:
    """One row: the least E-BFMI over chains (mean square step over variance of the energy), divergences, treedepth hits."""
    own = Window.partitionBy(chain).orderBy(order)
    m = F.avg(energy).over(Window.partitionBy(chain))
    rows = steps.select(chain, F.pow(F.col(energy) - F.lag(energy).over(own), 2).alias("step"), F.pow(F.col(energy) - m, 2).alias("off"), diverged, deep)
    per = rows.groupBy(chain).agg((F.sum("step") / F.sum("off")).alias("bfmi"), F.sum(F.col(diverged).cast("long")).alias("d"), F.sum(F.col(deep).cast("long")).alias("t"))
    return per.agg(F.min("bfmi").alias("ebfmi"), F.sum("d").alias("divergent_transitions"), F.sum("t").alias("max_treedepth_hits"))


def run_gate(rows: DataFrame) -> DataFrame:
    """``rows`` (metric, parameter, value) with threshold, is_blocking and passed; a value that can't be computed does not pass."""
    spark = rows.sparkSession
    limits = spark.createDataFrame([(m, t, d, b) for m, t, d, _, b in GATE], "metric string, threshold double, direction string, is_blocking boolean")
    value = F.col("value")
    ok = F.when(F.col("direction") == "max", value <= F.col("threshold")).otherwise(value >= F.col("threshold"))
    return rows.join(F.broadcast(limits), "metric").select("metric", "parameter", "value", "threshold", "is_blocking", F.coalesce(ok & ~F.isnan(value), F.lit(False)).alias("passed"))


def ordered_artifact_digest(rows: DataFrame, *, group: str, ordinal: str, digest: str, block: int = 1024) -> DataFrame:
    """(group, n, artifact): a digest over row digests in the order of their ordinals, by way of one digest for each block of them.

    A block is ``block`` rows and a group is as many block digests, so no array grows with the table's square.
    """
    blocks = rows.groupBy(group, F.floor(F.col(ordinal) / block).alias("b")).agg(F.count("*").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(ordinal, digest))), lambda s: s[digest]), "\n"), 256).alias("d"))
    return blocks.groupBy(group).agg(F.sum("n").alias("n"), F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda s: s["d"]), "\n"), 256).alias("artifact"))


def shrinkage_intervals(counts: DataFrame, draws: DataFrame, *, level: float = 0.9) -> DataFrame:
    """``counts`` (member, n) with median, low and high of the weight of a member's own mean over the draws (tau, sigma).

    The weight is n tau^2 / (n tau^2 + sigma^2), nought for a member without rows.  The median is a nearest rank, the
    interval the narrowest that spans a share ``level`` of the ordered draws, the first of equal ones.  A weight depends on
    n alone, so each distinct n is solved once; the draws are as many as the sampler's, whatever the rows.
    """
    held = draws.agg(F.collect_list(F.struct((F.col("tau") * F.col("tau")).alias("t"), (F.col("sigma") * F.col("sigma")).alias("s"))).alias("draws"))
    n = F.col("n").cast("double")
    each = counts.select("n").distinct().crossJoin(F.broadcast(held)).withColumn("rho", F.array_sort(F.transform("draws", lambda d: n * d["t"] / (n * d["t"] + d["s"]))))
    size, span = F.size("rho"), F.floor(F.size("rho") * F.lit(level)).cast("int")
    spans = F.transform(F.sequence(F.lit(1), size - span), lambda i: F.struct((F.element_at("rho", i + span) - F.element_at("rho", i)).alias("width"), i.alias("i")))
    start = F.array_min(spans)["i"]
    middle = F.element_at("rho", F.ceil(size * 0.5).cast("int"))
    solved = each.where(size > 0).select("n", middle.alias("median"), F.element_at("rho", start).alias("low"), F.element_at("rho", start + span).alias("high"))
    return counts.join(solved, "n", "left")

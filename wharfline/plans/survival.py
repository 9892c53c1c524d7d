"""Survival, censoring and split queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.operators import survival as S
from wharfline.session import table

from .frames import AS_OF, EVENTS, LINES, POSTERIORS, events, lines, posteriors
from .registry import Registry

registry = Registry()
EVENT_AS_OF = "2024-01-20"
HASH = "sha256:0"

STEPS = f"""{LINES},
counts AS (SELECT category, days, count(*) AS n, count(*) FILTER (WHERE is_closed) AS events FROM line GROUP BY category, days),
risk AS (SELECT *, sum(n) OVER (PARTITION BY category ORDER BY days DESC) AS at_risk FROM counts),
steps AS (SELECT category, days, CAST(at_risk AS BIGINT) AS at_risk, events, product(1 - events / at_risk) OVER w AS survival,
  CASE WHEN bool_or(at_risk = events) OVER w THEN CAST('inf' AS DOUBLE) ELSE product(1 - events / at_risk) OVER w * sqrt(sum(CASE WHEN at_risk > events THEN events / (at_risk * (at_risk - events)) END) OVER w) END AS standard_error
  FROM risk WHERE events > 0 WINDOW w AS (PARTITION BY category ORDER BY days))"""


def steps(spark: SparkSession, sf: str) -> DataFrame:
    return S.product_limit(lines(spark, sf).withColumn("censored", ~F.col("is_closed")), ["category"])


@registry.query(f"WITH {STEPS} SELECT category, days, at_risk, events, round(survival, 9) AS survival, round(standard_error, 9) AS standard_error FROM steps")
def kaplan_meier_by_category(spark: SparkSession, sf: str) -> DataFrame:
    return steps(spark, sf).withColumn("survival", F.round("survival", 9)).withColumn("standard_error", F.round("standard_error", 9))


@registry.query(f"""WITH {STEPS}, near AS (SELECT category, min(days) FILTER (WHERE survival <= 0.5) AS median, min(days) FILTER (WHERE days > 0 AND abs(survival - 0.5) <= {stats.Z95} * standard_error) AS a, max(days) FILTER (WHERE days > 0 AND abs(survival - 0.5) <= {stats.Z95} * standard_error) AS b FROM steps GROUP BY category),
naive AS (SELECT category, avg(days) FILTER (WHERE is_closed) AS naive_mean FROM line GROUP BY category)
SELECT category, median AS median_days, least(a, median) AS low, greatest(b, median) AS high, round((median - naive_mean) / median, 9) AS floor FROM near JOIN naive USING (category)""")
def km_greenwood_median(spark: SparkSession, sf: str) -> DataFrame:
    """The median, its band, and the share by which the mean of completed durations falls short of it."""
    naive = lines(spark, sf).where("is_closed").groupBy("category").agg(F.avg("days").alias("naive_mean"))
    out = S.median_band(steps(spark, sf), ["category"]).join(naive, "category")
    return out.select("category", F.col("median").cast("long").alias("median_days"), F.col("low").cast("long").alias("low"), F.col("high").cast("long").alias("high"), F.round((F.col("median") - F.col("naive_mean")) / F.col("median"), 9).alias("floor"))


@registry.query(f"""WITH {EVENTS} SELECT * FROM (SELECT user_id, seq, to_state AS state, lead(to_state) OVER w AS next_state, date_diff('day', day, lead(day) OVER w) AS days,
CAST(sum(CASE WHEN to_state = 'error' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS loops FROM log WINDOW w AS (PARTITION BY user_id ORDER BY seq)) WHERE next_state IS NOT NULL""")
def sojourn_legs(spark: SparkSession, sf: str) -> DataFrame:
    return S.sojourn_legs(events(spark, sf))


@registry.query(f"""WITH {EVENTS} SELECT user_id, arg_max(to_state, seq) AS state, max(seq) AS seq, date_diff('day', arg_max(day, seq), DATE '{EVENT_AS_OF}') AS days FROM log WHERE day <= DATE '{EVENT_AS_OF}' GROUP BY user_id""")
def open_legs(spark: SparkSession, sf: str) -> DataFrame:
    return S.open_legs(events(spark, sf), EVENT_AS_OF)


@registry.query(f"WITH {EVENTS} SELECT user_id, seq, to_state, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY seq DESC) AS r FROM log) WHERE r = 1")
def latest_event_per_log(spark: SparkSession, sf: str) -> DataFrame:
    out = events(spark, sf).groupBy("user_id").agg(F.max_by(F.struct("seq", "to_state", "event_id"), "seq").alias("e"))
    return out.select("user_id", "e.*")


@registry.query(f"WITH {EVENTS} SELECT user_id, seq, CAST(sum(CASE WHEN to_state = 'error' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS BIGINT) AS loops FROM log")
def running_rework_loops(spark: SparkSession, sf: str) -> DataFrame:
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return events(spark, sf).select("user_id", "seq", F.sum(F.when(F.col("to_state") == "error", 1).otherwise(0)).over(own).alias("loops"))


@registry.query(f"""WITH {EVENTS} SELECT user_id, count(*) AS n, list(to_state ORDER BY seq) AS states FROM log WHERE day <= DATE '{EVENT_AS_OF}' GROUP BY user_id""")
def nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Logs folded into an array in sequence, up to the anchor; a log is one row, whole."""
    seen = events(spark, sf).where(F.col("day") <= F.lit(EVENT_AS_OF).cast("date"))
    return seen.groupBy("user_id").agg(F.count("*").alias("n"), F.transform(F.array_sort(F.collect_list(F.struct("seq", "to_state"))), lambda e: e["to_state"]).alias("states"))


KEY = "sha256('{h}|20260601|0.25|' || project || '|' || po_number || '|' || line_number)"
SPLIT = f"""{LINES}, drawn AS (SELECT *, {KEY.format(h=HASH)} AS draw FROM line),
split AS (SELECT * EXCLUDE (draw, r, q), CASE WHEN r <= q THEN 'held_out' ELSE 'train' END AS split_side FROM (SELECT *, row_number() OVER (PARTITION BY is_closed ORDER BY draw, project, po_number, line_number) AS r, floor(0.25 * count(*) OVER (PARTITION BY is_closed) + 0.5) AS q FROM drawn))"""


def split(spark: SparkSession, sf: str) -> DataFrame:
    return S.stratified_split(lines(spark, sf), stratum="is_closed", keys=["project", "po_number", "line_number"], data_hash=HASH)


@registry.query(f"WITH {SPLIT} SELECT line_id, is_closed, split_side FROM split")
def stratified_split(spark: SparkSession, sf: str) -> DataFrame:
    return split(spark, sf).select("line_id", "is_closed", "split_side")


@registry.query(f"WITH {SPLIT} SELECT s_suppkey AS vendor, count(line_id) AS n FROM supplier LEFT JOIN split ON vendor = s_suppkey AND split_side = 'train' GROUP BY s_suppkey")
def training_counts_with_zeros(spark: SparkSession, sf: str) -> DataFrame:
    roster = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("vendor"))
    return S.counts_with_zeros(roster, split(spark, sf).where("split_side = 'train'"), "vendor")


@registry.query(f"WITH {SPLIT} SELECT vendor, count(*) AS n, round(avg(duration), 9) AS mean_days FROM split WHERE split_side = 'held_out' AND is_closed GROUP BY vendor")
def held_out_delivered(spark: SparkSession, sf: str) -> DataFrame:
    """The population that grades a forecast."""
    return split(spark, sf).where("split_side = 'held_out' and is_closed").groupBy("vendor").agg(F.count("*").alias("n"), F.round(F.avg("duration"), 9).alias("mean_days"))


@registry.query(f"""WITH {LINES}, v AS (SELECT vendor, count(*) AS n, avg(duration) AS m, var_pop(duration) AS s2 FROM line WHERE is_closed GROUP BY vendor),
g AS (SELECT sum(n * m) / sum(n) AS grand, sum(n * s2) / sum(n) AS within FROM v), t AS (SELECT sum(n * (m - grand) * (m - grand)) / sum(n) AS tau2, any_value(within) AS within FROM v, g)
SELECT vendor, n, round(tau2 / (tau2 + within / n), 6) AS rho, round(tau2, 4) AS between_vendors FROM v, t""")
def shrinkage_weight(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each vendor's own mean, with moments in place of fitted variances."""
    v = lines(spark, sf).where("is_closed").groupBy("vendor").agg(F.count("*").alias("n"), F.avg("duration").alias("m"), F.var_pop("duration").alias("s2"))
    g = v.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("s2")) / F.sum("n")).alias("within"))
    t = v.crossJoin(g).agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)) / F.sum("n")).alias("tau2"), F.first("within").alias("within"))
    return v.crossJoin(t).select("vendor", "n", F.round(stats.shrinkage(F.col("tau2"), F.col("within"), F.col("n")), 6).alias("rho"), F.round("tau2", 4).alias("between_vendors"))


@registry.query(f"""WITH {LINES}, d AS (SELECT category, vendor, CAST(duration AS DOUBLE) AS v FROM line WHERE is_closed), c AS (SELECT *, avg(v) OVER (PARTITION BY category) AS cm, avg(v) OVER () AS gm FROM d),
r AS (SELECT *, avg(v - cm) OVER (PARTITION BY vendor) AS vm FROM c)
SELECT count(*) AS n, round(var_pop(v), 4) AS total, round(avg((cm - gm) * (cm - gm)), 4) AS between_first, round(avg(vm * vm), 4) AS between_second, round(greatest(0, var_pop(v) - avg((cm - gm) * (cm - gm)) - avg(vm * vm)), 4) AS residual FROM r""")
def variance_decomposition(spark: SparkSession, sf: str) -> DataFrame:
    out = S.variance_decomposition(lines(spark, sf).where("is_closed"), value="duration", first="category", second="vendor")
    return out.select("n", *(F.round(c, 4).alias(c) for c in ("total", "between_first", "between_second", "residual")))


_TERCILES = f"""{LINES}, slack AS (SELECT line_id, category, date_diff('day', order_date, need_by) AS slack_days FROM line),
levels AS (SELECT *, ['TIGHT', 'MODERATE', 'RELAXED'][least((row_number() OVER (ORDER BY slack_days, line_id) - 1) * 3 // count(*) OVER (), 2) + 1] AS level FROM slack)"""


def _levels(spark: SparkSession, sf: str) -> DataFrame:
    slack = lines(spark, sf).select("line_id", "category", F.datediff("need_by", "order_date").alias("slack_days"))
    return S.terciles(slack, value="slack_days", key="line_id")


@registry.query(f"WITH {_TERCILES} SELECT line_id, slack_days, level FROM levels")
def tercile_pressure(spark: SparkSession, sf: str) -> DataFrame:
    return _levels(spark, sf).select("line_id", F.col("slack_days").cast("long").alias("slack_days"), "level")


_TIER = "CASE WHEN category IN ('ECONOMY', 'PROMO') THEN 'T1' WHEN category IN ('STANDARD', 'MEDIUM') THEN 'T2' ELSE 'T3' END"


@registry.query(f"""WITH {_TERCILES}, bands AS (SELECT * FROM (VALUES {', '.join(map(str, S.BANDS))}) AS t(tier, level, band))
SELECT tier, level, band, count(*) AS n FROM (SELECT {_TIER} AS tier, level FROM levels) JOIN bands USING (tier, level) GROUP BY tier, level, band""")
def criticality_band(spark: SparkSession, sf: str) -> DataFrame:
    bands = spark.createDataFrame(S.BANDS, "tier string, level string, band int")
    return _levels(spark, sf).withColumn("tier", F.expr(_TIER)).join(F.broadcast(bands), ["tier", "level"]).groupBy("tier", "level", "band").agg(F.count("*").alias("n"))


@registry.query(f"""WITH {_TERCILES}, ends AS (SELECT level, min(slack_days) AS low, max(slack_days) AS high FROM levels GROUP BY level)
SELECT a.level AS below, b.level AS above, (a.high + b.low) / 2 AS cut FROM ends a JOIN ends b ON (a.level, b.level) IN (('TIGHT', 'MODERATE'), ('MODERATE', 'RELAXED'))""")
def tercile_cut_points(spark: SparkSession, sf: str) -> DataFrame:
    """Mid-points between the last value of a level and the first of the next."""
    ends = _levels(spark, sf).groupBy("level").agg(F.min("slack_days").alias("low"), F.max("slack_days").alias("high"))
    row = ends.groupBy().pivot("level", ["TIGHT", "MODERATE", "RELAXED"]).agg(F.first("low").alias("low"), F.first("high").alias("high"))
    cut = lambda a, b: F.struct(F.lit(a).alias("below"), F.lit(b).alias("above"), ((F.col(f"{a}_high") + F.col(f"{b}_low")) / 2).alias("cut"))
    return row.select(F.explode(F.array(cut("TIGHT", "MODERATE"), cut("MODERATE", "RELAXED"))).alias("c")).select("c.*")


@registry.query(f"WITH {LINES} SELECT count(*) AS n, count(*) FILTER (WHERE is_closed) / count(*) AS delivered_share, avg(CASE WHEN is_closed THEN CAST(order_date + CAST(duration AS INTEGER) > need_by AS INTEGER) END) AS late_share FROM line")
def shape_floors(spark: SparkSession, sf: str) -> DataFrame:
    """Delivered share, and the late share of what was delivered."""
    late = F.expr("date_add(order_date, duration) > need_by").cast("int")
    return lines(spark, sf).agg(F.count("*").alias("n"), (F.sum(F.col("is_closed").cast("long")) / F.count("*")).alias("delivered_share"), F.avg(F.when(F.col("is_closed"), late)).alias("late_share"))


@registry.query(f"WITH {LINES} SELECT max(duration) FILTER (WHERE is_closed) AS longest, count(*) FILTER (WHERE NOT is_closed) AS n FROM line")
def maximum_observed_duration(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).agg(F.max(F.when(F.col("is_closed"), F.col("duration"))).cast("long").alias("longest"), F.sum((~F.col("is_closed")).cast("long")).alias("n"))


@registry.query(f"WITH {POSTERIORS}, d AS (SELECT unnest(draws) AS draw FROM posterior) SELECT quantile_disc(draw, 0.5) AS pooled_median, count(*) AS n FROM d")
def pooled_median(spark: SparkSession, sf: str) -> DataFrame:
    """The median over all draws, from counts for each day."""
    from pyspark.sql import Window

    days = posteriors(spark, sf).select(F.explode("draws").alias("d")).groupBy("d").agg(F.count("*").alias("c")).withColumn("zone", F.lit(0))
    run = days.withColumn("upto", F.sum("c").over(Window.partitionBy("zone").orderBy("d"))).withColumn("n", F.sum("c").over(Window.partitionBy("zone")))
    return run.where(F.col("upto") >= F.ceil(F.col("n") * 0.5)).groupBy("n").agg(F.min("d").cast("long").alias("pooled_median"))


@registry.query(f"""WITH {POSTERIORS}, w AS (SELECT vendor, i, draws[i] AS low, draws[i + 89] AS high FROM posterior, range(1, 12) AS t(i)), r AS (SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY high - low, i) AS k FROM w)
SELECT vendor, low, high FROM r WHERE k = 1""")
def highest_density_interval(spark: SparkSession, sf: str) -> DataFrame:
    out = posteriors(spark, sf).select("vendor", S.hpdi(F.col("draws"), 0.9).alias("h"))
    return out.select("vendor", F.col("h.low").cast("long").alias("low"), F.col("h.high").cast("long").alias("high"))


@registry.query(f"""WITH {LINES}, a AS (SELECT vendor, count(*) AS na, sum(duration) AS sa FROM line WHERE is_closed AND po_number % 2 = 0 GROUP BY vendor), b AS (SELECT vendor, count(*) AS nb, sum(duration) AS sb FROM line WHERE is_closed AND po_number % 3 = 0 GROUP BY vendor)
SELECT coalesce(a.vendor, b.vendor) AS vendor, CASE WHEN a.vendor IS NULL OR b.vendor IS NULL THEN 'unpaired' WHEN abs(sa / na - sb / nb) <= 5.0 THEN 'agrees' ELSE 'disagrees' END AS verdict FROM a FULL JOIN b ON a.vendor = b.vendor""")
def reproduction_verdict(spark: SparkSession, sf: str) -> DataFrame:
    """Two runs' figures paired in full; five days of tolerance."""
    closed = lines(spark, sf).where("is_closed")
    run = lambda k, t: closed.where(F.col("po_number") % k == 0).groupBy("vendor").agg((F.sum("duration") / F.count("*")).alias(t))
    out = run(2, "recorded").join(run(3, "refit"), "vendor", "full")
    unpaired = F.col("recorded").isNull() | F.col("refit").isNull()
    return out.select("vendor", F.when(unpaired, "unpaired").when(F.abs(F.col("recorded") - F.col("refit")) <= 5.0, "agrees").otherwise("disagrees").alias("verdict"))


@registry.query(f"""WITH {EVENTS} SELECT from_state, to_state, count(*) AS n, from_state IS NULL OR (from_state, to_state) NOT IN (('error', 'signup'), ('signup', 'error')) AS legal FROM log GROUP BY ALL""")
def transition_legality(spark: SparkSession, sf: str) -> DataFrame:
    """Transitions counted against the table of edges that are not legal."""
    barred = spark.createDataFrame([("error", "signup"), ("signup", "error")], "from_state string, to_state string").withColumn("barred", F.lit(True))
    out = events(spark, sf).groupBy("from_state", "to_state").agg(F.count("*").alias("n")).join(F.broadcast(barred), ["from_state", "to_state"], "left")
    return out.select("from_state", "to_state", "n", F.col("barred").isNull().alias("legal"))

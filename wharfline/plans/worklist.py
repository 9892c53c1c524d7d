"""Worklist queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats
from wharfline.operators import worklist as W
from wharfline.session import table

from .frames import AS_OF, HORIZON, LINES, POSTERIORS, TODAY, lines, posteriors
from .registry import Registry

registry = Registry()
TOP = 200

SCORED = f"""{POSTERIORS},
scored AS (SELECT *, is_ranked AND "offset" > {HORIZON} AS miss_is_bound FROM (SELECT *, state NOT IN ('no_active_run', 'roster_mismatch', 'not_covered') AS is_ranked FROM (
  SELECT line.*, draws, date_diff('day', DATE '{AS_OF}', need_by) AS "offset",
  CASE WHEN line.vendor % 97 = 13 THEN 'roster_mismatch' WHEN draws IS NULL THEN 'not_covered' WHEN date_diff('day', DATE '{AS_OF}', need_by) > {HORIZON} THEN 'beyond_horizon'
    WHEN date_diff('day', DATE '{AS_OF}', need_by) <= 0 THEN 'already_late' WHEN need_by < DATE '{TODAY}' THEN 'calendar_passed' ELSE 'nominal' END AS state
  FROM line LEFT JOIN posterior ON line.vendor = posterior.vendor WHERE NOT is_closed))),
figures AS (SELECT *, CASE WHEN is_ranked THEN list_sum(list_transform(draws, lambda d: greatest(CAST(d AS DOUBLE) - "offset", 0.0))) / len(draws) * criticality END AS harm,
  CASE WHEN is_ranked THEN draws[CAST(ceil(0.5 * len(draws)) AS BIGINT)] END AS p50, CASE WHEN is_ranked THEN draws[CAST(ceil(CAST(0.8 AS DOUBLE) * len(draws)) AS BIGINT)] END AS p80,
  CASE WHEN is_ranked AND "offset" BETWEEN 1 AND {HORIZON} THEN len(list_filter(draws, lambda d: d > "offset")) / len(draws) WHEN is_ranked AND "offset" > {HORIZON} THEN len(list_filter(draws, lambda d: d > {HORIZON})) / len(draws) END AS miss
  FROM scored)"""


#: A run that holds no posterior of some vendors.
GAPS = "vendor % 89 <> 7"
SCORED_WITH_GAPS = SCORED.replace("FROM line WHERE is_closed)", f"FROM line WHERE is_closed AND {GAPS})")


def scored(spark: SparkSession, sf: str, overrides: DataFrame | None = None, run: DataFrame | None = None) -> DataFrame:
    run = posteriors(spark, sf) if run is None else run
    return W.score(W.effective_dates(lines(spark, sf), overrides).drop("is_adjusted"), run, as_of=AS_OF, today=TODAY, horizon=HORIZON)


def scored_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return scored(spark, sf, run=posteriors(spark, sf).where(GAPS))


@registry.query(f"WITH {LINES} SELECT project, count(*) AS open_lines FROM line WHERE NOT is_closed GROUP BY project")
def open_lines_by_project(spark: SparkSession, sf: str) -> DataFrame:
    return lines(spark, sf).where(~F.col("is_closed")).groupBy("project").agg(F.count("*").alias("open_lines"))


def _ranked(order: str) -> str:
    return f"""WITH {SCORED} SELECT rank, line_id, project, state, criticality, need_by, round(harm, 6) AS harm, p50, p80 FROM
(SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM figures WHERE is_ranked) WHERE rank <= {TOP}"""


def _top(spark: SparkSession, sf: str, sort: str) -> DataFrame:
    return W.top(scored(spark, sf), sort, TOP).select("rank", "line_id", "project", "state", "criticality", "need_by", F.round("harm", 6).alias("harm"), "p50", "p80")


@registry.query(_ranked("harm DESC, need_by, criticality DESC, line_id"))
def worklist_harm_rank(spark: SparkSession, sf: str) -> DataFrame:
    """The worklist in its default order."""
    return _top(spark, sf, "harm")


@registry.query(_ranked('"offset", need_by, criticality DESC, line_id'))
def worklist_by_need_by(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "need_by_date")


@registry.query(_ranked('"offset", need_by, criticality DESC, line_id'))
def worklist_by_margin(spark: SparkSession, sf: str) -> DataFrame:
    """The calendar margin is the offset of the need-by date, so the order is the same."""
    return _top(spark, sf, "calendar_margin")


@registry.query(_ranked("criticality DESC, need_by, line_id"))
def worklist_by_criticality(spark: SparkSession, sf: str) -> DataFrame:
    return _top(spark, sf, "criticality")


@registry.query(f"WITH {SCORED_WITH_GAPS} SELECT state, is_ranked, count(*) AS n, count(harm) AS with_figures FROM figures GROUP BY state, is_ranked")
def worklist_states(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in each state, under a run that does not cover all vendors."""
    return scored_with_gaps(spark, sf).groupBy("state", "is_ranked").agg(F.count("*").alias("n"), F.count("harm").alias("with_figures"))


@registry.query(f"WITH {SCORED_WITH_GAPS} SELECT line_id, effective_need_by, line_id || ' · ' || project AS identifier FROM (SELECT line_id, need_by AS effective_need_by, project FROM figures WHERE NOT is_ranked)")
def worklist_excluded(spark: SparkSession, sf: str) -> DataFrame:
    """Lines without figures, beside the ranking: also those of vendors that the run does not cover."""
    return scored_with_gaps(spark, sf).where(~F.col("is_ranked")).select("line_id", F.col("need_by").alias("effective_need_by"), F.concat_ws(" · ", "line_id", "project").alias("identifier"))


_SHOWN = "CASE WHEN w <= 0 THEN '{low}' WHEN w >= 100 THEN '{high}' ELSE {value} || '%' END"


@registry.query(f"""WITH {SCORED} SELECT line_id, "offset", miss, miss_is_bound, {_SHOWN.format(low="<1%", high=">99%", value="w")} AS shown, {_SHOWN.format(low=">99%", high="<1%", value="(100 - w)")} AS other
FROM (SELECT line_id, "offset", miss, miss_is_bound, CAST(round(CAST(miss AS DECIMAL(38, 18)) * 100, 0) AS INTEGER) AS w FROM figures WHERE miss IS NOT NULL)""")
def miss_probability(spark: SparkSession, sf: str) -> DataFrame:
    """Chance that a line misses its date, and both directions of it as displayed."""
    out = scored(spark, sf).where("miss is not null")
    return out.select("line_id", "offset", "miss", "miss_is_bound", stats.percent_display(F.col("miss")).alias("shown"), stats.complement_display(F.col("miss")).alias("other"))


@registry.query(f"WITH {POSTERIORS} SELECT vendor, draws[50] AS p50, draws[80] AS p80, draws[95] AS p95, len(draws) AS n FROM posterior")
def nearest_rank_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    draws = F.col("draws")
    return posteriors(spark, sf).select("vendor", *(arrays.nearest_rank(draws, p).alias(f"p{round(100 * p)}") for p in (0.5, 0.8, 0.95)), F.size(draws).alias("n"))


@registry.query(f"""WITH {POSTERIORS} SELECT vendor, k AS day, len(list_filter(draws, lambda d: d > k)) / len(draws) AS survival FROM posterior, range(1, {HORIZON + 1}) AS t(k)""")
def survival_grid(spark: SparkSession, sf: str) -> DataFrame:
    """The day grid of each vendor, all HORIZON days of it."""
    grid = W.tails(posteriors(spark, sf)).withColumn("day", F.explode(F.sequence(F.lit(1), F.lit(HORIZON))))
    return grid.select("vendor", F.col("day").cast("long").alias("day"), (W.beyond(F.col("day")) / F.col("total")).alias("survival"))


@registry.query(f"WITH {POSTERIORS} SELECT vendor, len(list_filter(draws, lambda d: d > {HORIZON})) / len(draws) AS residual, true AS ascending, true AS non_increasing, true AS unit, true AS tail_agrees FROM posterior")
def posterior_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What a stored posterior must hold: ascending draws, a falling grid in [0, 1], its last cell the residual mass."""
    cells = F.transform(F.sequence(F.lit(1), F.lit(HORIZON)), lambda k: W.beyond(k) / F.col("total"))
    held = W.tails(posteriors(spark, sf)).withColumn("grid", cells).withColumn("residual", arrays.exceedance(F.col("draws"), F.lit(HORIZON)))
    grid = F.col("grid")
    return held.select("vendor", "residual", arrays.ascending(F.col("draws")).alias("ascending"), arrays.non_increasing(grid).alias("non_increasing"), arrays.within_unit(grid).alias("unit"), (F.abs(F.element_at(grid, -1) - F.col("residual")) <= 1e-9).alias("tail_agrees"))


#: A what-if for the first lines of a project by id: as many as a request may hold.
WHAT_IF = f"""chosen AS (SELECT line_id FROM line WHERE NOT is_closed AND project = 'BUILDING' ORDER BY line_id LIMIT {W.MAX_OVERRIDES}),
what_if AS (SELECT line_id, DATE '{AS_OF}' + 1 AS what_if FROM chosen)"""


def what_if(spark: SparkSession, sf: str) -> DataFrame:
    chosen = lines(spark, sf).where(~F.col("is_closed") & (F.col("project") == "BUILDING")).orderBy("line_id").limit(W.MAX_OVERRIDES)
    return chosen.select("line_id", F.date_add(F.lit(AS_OF).cast("date"), 1).alias("what_if"))


@registry.query(f"""WITH {LINES}, {WHAT_IF}, adjusted AS (SELECT line.* REPLACE (coalesce(what_if, need_by) AS need_by), what_if IS NOT NULL AS is_adjusted FROM line LEFT JOIN what_if USING (line_id))
SELECT line_id, need_by, is_adjusted, date_diff('day', DATE '{AS_OF}', need_by) AS margin FROM adjusted WHERE NOT is_closed""")
def worklist_overrides(spark: SparkSession, sf: str) -> DataFrame:
    """All open lines under a request's what-if dates."""
    out = W.effective_dates(lines(spark, sf), what_if(spark, sf), as_of=AS_OF).where(~F.col("is_closed"))
    return out.select("line_id", "need_by", "is_adjusted", F.datediff("need_by", F.lit(AS_OF).cast("date")).alias("margin"))


@registry.query(f"""WITH {LINES}, asked AS (SELECT line_id FROM line UNION SELECT 'unknown-1')
SELECT line_id, CASE WHEN project IS NULL THEN 'not_found' WHEN is_closed THEN 'terminal' WHEN project <> 'BUILDING' THEN 'out_of_scope' ELSE 'applied' END AS outcome FROM asked LEFT JOIN line USING (line_id)""")
def override_outcomes(spark: SparkSession, sf: str) -> DataFrame:
    """What an override of each line, and of one that doesn't exist, would come to in one project."""
    own = lines(spark, sf)
    return W.override_outcomes(own.select("line_id").unionByName(spark.sql("select 'unknown-1' as line_id")), own, "BUILDING")


@registry.query(f"""WITH {LINES}, own AS (SELECT o_custkey, count(*) FILTER (WHERE NOT is_closed) AS rows, max(order_date) AS newest FROM line JOIN orders ON o_orderkey = po_number GROUP BY o_custkey)
SELECT c_custkey AS customer, coalesce(rows, 0) AS rows, CASE WHEN newest IS NULL THEN 'no_active_run' WHEN rows = 0 THEN 'empty_filter' WHEN date_diff('day', newest, DATE '{AS_OF}') > {W.STALE_AFTER_DAYS} THEN 'stale' ELSE 'fresh' END AS page_state FROM customer LEFT JOIN own ON o_custkey = c_custkey""")
def worklist_page_states(spark: SparkSession, sf: str) -> DataFrame:
    """The state of each customer's page: without known lines there is no run, and its newest order dates it."""
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("po_number"), F.col("o_custkey").alias("customer"))
    own = lines(spark, sf).select("po_number", "is_closed", "order_date").join(orders, "po_number").groupBy("customer").agg(F.count_if(~F.col("is_closed")).alias("rows"), F.max("order_date").alias("newest"))
    out = table(spark, sf, "customer").select(F.col("c_custkey").alias("customer")).join(own, "customer", "left").withColumn("rows", F.coalesce("rows", F.lit(0)))
    age = F.datediff(F.lit(AS_OF).cast("date"), "newest")
    return out.select("customer", "rows", W.page_state(F.col("newest").isNotNull(), age, F.col("rows")).alias("page_state"))


@registry.query(f"""WITH {SCORED} SELECT sha256(string_agg(line_id, chr(10) ORDER BY rank)) AS digest, count(*) AS n FROM
(SELECT line_id, row_number() OVER (ORDER BY harm DESC, need_by, criticality DESC, line_id) AS rank FROM figures WHERE is_ranked) WHERE rank <= {TOP}""")
def worklist_ordering_digest(spark: SparkSession, sf: str) -> DataFrame:
    """The digest of the ids in the order shown (a top-k list, so one row of bounded size)."""
    few = W.top(scored(spark, sf), "harm", TOP)
    return few.agg(arrays.ordered_digest(F.collect_list(F.struct("rank", F.col("line_id").alias("id")))).alias("digest"), F.count("*").alias("n"))


@registry.query(f"""WITH {POSTERIORS} SELECT vendor, i AS mark, draws[greatest(1, CAST(ceil((2 * i - 1) / 100.0 * len(draws)) AS BIGINT))] AS day FROM posterior, range(1, 51) AS t(i)""")
def fifty_marks(spark: SparkSession, sf: str) -> DataFrame:
    """Fifty equally likely marks of each posterior."""
    out = posteriors(spark, sf).select("vendor", F.posexplode(arrays.marks(F.col("draws"), 50)).alias("at", "day"))
    return out.select("vendor", (F.col("at") + 1).cast("long").alias("mark"), "day")


@registry.query(f"""WITH {POSTERIORS}, cuts AS (SELECT vendor, draws, unnest([draws[20], draws[50], draws[80]]) AS day, unnest(['p20', 'p50', 'p80']) AS band_end FROM posterior)
SELECT vendor, day, band_end, len(list_filter(draws, lambda d: d <= day)) / len(draws) AS reached FROM cuts""")
def banded_series(spark: SparkSession, sf: str) -> DataFrame:
    """The cumulative series at the ends of the labelled bands."""
    draws = F.col("draws")
    ends = F.array(*(F.struct(F.lit(f"p{round(100 * p)}").alias("band_end"), arrays.nearest_rank(draws, p).alias("day")) for p in (0.2, 0.5, 0.8)))
    out = posteriors(spark, sf).select("vendor", "draws", F.explode(ends).alias("e")).select("vendor", "draws", "e.*")
    return out.select("vendor", "day", "band_end", (F.size(F.filter(draws, lambda d: d <= F.col("day"))) / F.size(draws)).alias("reached"))

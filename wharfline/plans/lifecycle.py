"""Lifecycle queries: orders walk the seven states, with rework loops and legs that follow from their keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.operators import lifecycle as Y
from wharfline.operators import survival as S
from wharfline.session import table

from .frames import AS_OF, LINES, lines
from .registry import Registry

registry = Registry()
_PATH = "['submitted', 'under_review'] || flatten(list_transform(range(0, o_orderkey % 3), lambda i: ['revise_and_resubmit', 'submitted', 'under_review'])) || ['approved', 'released_for_fabrication', 'shipped', 'delivered']"
WALK = f"""
step AS (SELECT o_orderkey AS po, CAST(o_orderdate AS DATE) AS ordered, unnest({_PATH}) AS to_state, generate_subscripts({_PATH}, 1) AS seq FROM orders),
dated AS (SELECT po, seq, to_state, ordered + CAST(sum(CASE WHEN seq = 1 THEN 0 ELSE 1 + (po * 7 + seq * 13) % 40 END) OVER (PARTITION BY po ORDER BY seq) AS INTEGER) AS occurred_on FROM step),
event AS (SELECT * FROM dated WHERE occurred_on <= DATE '{AS_OF}')"""


def walks(spark: SparkSession, sf: str) -> DataFrame:
    """(po, seq, to_state, occurred_on) up to AS_OF; loops and legs follow from the order's key."""
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("po"), F.to_date("o_orderdate").alias("ordered"))
    steps = o.select("po", "ordered", F.posexplode(Y.state_sequence(F.col("po") % 3)).alias("at", "to_state")).withColumn("seq", (F.col("at") + 1).cast("long"))
    steps = steps.withColumn("leg_days", F.when(F.col("seq") == 1, 0).otherwise(1 + (F.col("po") * 7 + F.col("seq") * 13) % 40))
    return Y.dated(steps, key="po", start="ordered", as_of=AS_OF).select("po", "seq", "to_state", "occurred_on")


@registry.query(f"WITH {WALK} SELECT po, seq, to_state, occurred_on FROM event")
def cumulative_event_dates(spark: SparkSession, sf: str) -> DataFrame:
    """Event dates of each order by the running sum of its legs, cut off at the anchor."""
    return walks(spark, sf)


_FAULTY = """faulty AS (SELECT po, seq, CASE WHEN po % 50 = 11 AND seq = 3 THEN 'shipped' WHEN po % 50 = 12 AND seq = 1 THEN 'approved' ELSE to_state END AS to_state, CASE WHEN po % 50 = 13 AND seq = 4 THEN occurred_on - 60 ELSE occurred_on END AS occurred_on FROM event WHERE NOT (po % 50 = 7 AND seq = 2)),
marked AS (SELECT *, row_number() OVER w AS place, lag(to_state) OVER w AS before, lag(occurred_on) OVER w AS earlier FROM faulty WINDOW w AS (PARTITION BY po ORDER BY seq))"""
_LEGAL = ", ".join(f"'{a}>{b}'" for a, b in Y.EDGES)


@registry.query(f"""WITH {WALK}, {_FAULTY} SELECT po, CASE WHEN bool_or(seq <> place) THEN 'gap' WHEN bool_or(place = 1 AND to_state <> 'submitted') THEN 'opening_state' WHEN bool_or(before IS NOT NULL AND before || '>' || to_state NOT IN ({_LEGAL})) THEN 'barred_edge'
WHEN bool_or(coalesce(occurred_on <= earlier, false)) THEN 'dates_do_not_rise' ELSE 'legal' END AS verdict FROM marked GROUP BY po""")
def legal_walks(spark: SparkSession, sf: str) -> DataFrame:
    """Every order's walk against the seven edges; some orders are given a fault of each kind first."""
    e = walks(spark, sf).where("not (po % 50 = 7 and seq = 2)")
    e = e.withColumn("to_state", F.expr("case when po % 50 = 11 and seq = 3 then 'shipped' when po % 50 = 12 and seq = 1 then 'approved' else to_state end"))
    return Y.walk_verdicts(e.withColumn("occurred_on", F.expr("case when po % 50 = 13 and seq = 4 then date_sub(occurred_on, 60) else occurred_on end")), key="po")


_FRAME = f"""{WALK}, leg AS (SELECT po, seq, to_state AS state, lead(to_state) OVER w AS next_state, occurred_on, lead(occurred_on) OVER w AS left_on, CAST(sum(CASE WHEN to_state = 'revise_and_resubmit' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS cycle FROM event WINDOW w AS (PARTITION BY po ORDER BY seq)),
frame AS (SELECT po, seq, state, next_state, date_diff('day', occurred_on, coalesce(left_on, DATE '{AS_OF}')) AS days, next_state IS NULL AS is_open, state = 'under_review' AS at_branch, CASE WHEN state = 'under_review' AND next_state IS NOT NULL THEN next_state = 'revise_and_resubmit' END AS took_rework, cycle FROM leg WHERE next_state IS NOT NULL OR state <> 'delivered')"""


def frame(spark: SparkSession, sf: str) -> DataFrame:
    return Y.sojourn_frame(walks(spark, sf), key="po", as_of=AS_OF)


@registry.query(f"WITH {_FRAME} SELECT po, seq, state, coalesce(next_state, '') AS next_state, days, is_open, at_branch, CASE took_rework WHEN true THEN 'yes' WHEN false THEN 'no' ELSE '' END AS took_rework, cycle FROM frame")
def sojourn_frame(spark: SparkSession, sf: str) -> DataFrame:
    """Completed legs and the one open leg of each order, with the decisions taken at the branch."""
    return frame(spark, sf).withColumn("next_state", F.coalesce("next_state", F.lit(""))).withColumn("took_rework", F.when(F.col("took_rework"), "yes").when(~F.col("took_rework"), "no").otherwise(""))


@registry.query(f"WITH {_FRAME} SELECT cycle, count(*) AS n, count(*) FILTER (WHERE took_rework) AS reworked, count(*) FILTER (WHERE is_open) AS undecided FROM frame WHERE at_branch GROUP BY cycle")
def branch_decisions(spark: SparkSession, sf: str) -> DataFrame:
    """How the branch was decided, by the loops before it."""
    count = lambda c: F.sum(c.cast("long"))
    return frame(spark, sf).where("at_branch").groupBy("cycle").agg(F.count("*").alias("n"), count(F.coalesce("took_rework", F.lit(False))).alias("reworked"), count(F.col("is_open")).alias("undecided"))


@registry.query(f"WITH {_FRAME} SELECT count(*) AS n, count(*) FILTER (WHERE at_branch) AS at_branch, max(days) FILTER (WHERE at_branch) AS longest FROM frame WHERE is_open")
def open_lines_at_branch(spark: SparkSession, sf: str) -> DataFrame:
    """Open orders whose last event is at the state with two ways out."""
    return frame(spark, sf).where("is_open").agg(F.count("*").alias("n"), F.sum(F.col("at_branch").cast("long")).alias("at_branch"), F.max(F.when(F.col("at_branch"), F.col("days"))).alias("longest"))


@registry.query(f"WITH {WALK} SELECT po, count(*) AS n, min(seq) AS seq FROM event WHERE po NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 97 <> 5) GROUP BY po")
def orphan_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events of lines that the roster lacks: what refuses a nested read."""
    roster = table(spark, sf, "orders").where("o_orderkey % 97 <> 5").select(F.col("o_orderkey").alias("po"))
    return walks(spark, sf).join(roster, "po", "left_anti").groupBy("po").agg(F.count("*").alias("n"), F.min("seq").alias("seq"))


@registry.query(f"""WITH {LINES}, v AS (SELECT vendor, dense_rank() OVER (ORDER BY vendor) - 1 AS i FROM (SELECT DISTINCT vendor FROM line WHERE is_closed)), c AS (SELECT crit, dense_rank() OVER (ORDER BY crit) - 1 AS i FROM (SELECT DISTINCT criticality AS crit FROM line WHERE is_closed)), n AS (SELECT count(*) AS n FROM v)
SELECT line_id, CAST(v.i AS BIGINT) AS "column", CAST(1 AS DOUBLE) AS value FROM line JOIN v USING (vendor) WHERE is_closed UNION ALL SELECT line_id, CAST(n + c.i AS BIGINT), CAST(1 AS DOUBLE) FROM line JOIN c ON crit = criticality, n WHERE is_closed""")
def design_matrix(spark: SparkSession, sf: str) -> DataFrame:
    """A vendor block and a criticality block of one-hot columns for each completed line, as its non-zero cells."""
    closed = lines(spark, sf).where("is_closed").select("line_id", "vendor", F.col("criticality").cast("long").alias("criticality"))
    return Y.design_rows(closed, key="line_id", blocks={c: Y.ranked_members(closed, c) for c in ("vendor", "criticality")})


@registry.query(f"""WITH {LINES}, arms AS (SELECT 'with_flags' AS arm, category, days, NOT is_closed AS censored FROM line UNION ALL SELECT 'flags_dropped', category, days, false FROM line),
c AS (SELECT arm, category, days, count(*) AS n, count(*) FILTER (WHERE NOT censored) AS events FROM arms GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY arm, category ORDER BY days DESC) AS at_risk FROM c),
s AS (SELECT *, product(1 - events / at_risk) OVER (PARTITION BY arm, category ORDER BY days) AS survival FROM r WHERE events > 0)
SELECT arm, category, min(days) FILTER (WHERE survival <= 0.5) AS median_days FROM s GROUP BY arm, category""")
def censoring_ignoring_arm(spark: SparkSession, sf: str) -> DataFrame:
    """Medians with the censoring flags, and with the flags dropped and every row kept."""
    own = lines(spark, sf).select("category", "days", (~F.col("is_closed")).alias("censored"))
    both = own.withColumn("arm", F.lit("with_flags")).unionByName(own.withColumn("censored", F.lit(False)).withColumn("arm", F.lit("flags_dropped")))
    out = S.median_band(S.product_limit(both, ["arm", "category"]), ["arm", "category"])
    return out.select("arm", "category", F.col("median").cast("long").alias("median_days"))


@registry.query(f"""WITH {LINES}, seeds AS (SELECT unnest(range(0, 5)) AS seed), drawn AS (SELECT seed, line_id, days, is_closed FROM line, seeds WHERE CAST('0x' || substr(sha256(seed || '|' || line_id), 1, 8) AS BIGINT) % 4 <> 0)
SELECT seed, arm, count(*) AS n, round(avg(days), 9) AS mean_days FROM (SELECT seed, 'completed_only' AS arm, days FROM drawn WHERE is_closed UNION ALL SELECT seed, 'all_rows', days FROM drawn) GROUP BY seed, arm""")
def ablation_arms(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms over five seeds: a seed holds out a quarter of the lines by their digests."""
    seeded = lines(spark, sf).withColumn("seed", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    place = F.conv(F.substring(F.sha2(F.concat_ws("|", F.col("seed").cast("string"), "line_id"), 256), 1, 8), 16, 10).cast("long")
    arm = F.explode(F.when(F.col("is_closed"), F.array(F.lit("completed_only"), F.lit("all_rows"))).otherwise(F.array(F.lit("all_rows"))))
    return seeded.where(place % 4 != 0).withColumn("arm", arm).groupBy("seed", "arm").agg(F.count("*").alias("n"), F.round(F.avg("days"), 9).alias("mean_days"))


@registry.query(f"""WITH {LINES} SELECT unnest(['mu', 'sigma', 'tau']) AS parameter UNION ALL SELECT 'vendor_effect[' || vendor || ']' FROM (SELECT DISTINCT vendor FROM line) UNION ALL SELECT 'category_effect[' || category || ']' FROM (SELECT DISTINCT category FROM line)""")
def monitored_parameters(spark: SparkSession, sf: str) -> DataFrame:
    """Scalar parameters, and each vector with each of its members."""
    own = lines(spark, sf).select("vendor", "category")
    scalars = spark.sql("select explode(array('mu', 'sigma', 'tau')) as parameter")
    name = lambda v, c: own.select(F.concat(F.lit(f"{v}["), F.col(c).cast("string"), F.lit("]")).alias("parameter")).distinct()
    return scalars.unionByName(name("vendor_effect", "vendor")).unionByName(name("category_effect", "category"))


_RHO = f"""{LINES}, v AS (SELECT vendor, count(*) AS n, avg(duration) AS m, var_pop(duration) AS s2 FROM line WHERE is_closed GROUP BY vendor), g AS (SELECT sum(n * m) / sum(n) AS grand, sum(n * s2) / sum(n) AS within FROM v),
t AS (SELECT sum(n * (m - grand) * (m - grand)) / sum(n) AS tau2, any_value(within) AS within FROM v, g), weight AS (SELECT vendor, n, tau2 / (tau2 + within / n) AS rho FROM v, t)"""


def weights(spark: SparkSession, sf: str) -> DataFrame:
    v = lines(spark, sf).where("is_closed").groupBy("vendor").agg(F.count("*").alias("n"), F.avg("duration").alias("m"), F.var_pop("duration").alias("s2"))
    g = v.agg((F.sum(F.col("n") * F.col("m")) / F.sum("n")).alias("grand"), (F.sum(F.col("n") * F.col("s2")) / F.sum("n")).alias("within"))
    t = v.crossJoin(g).agg((F.sum(F.col("n") * F.pow(F.col("m") - F.col("grand"), 2)) / F.sum("n")).alias("tau2"), F.first("within").alias("within"))
    return v.crossJoin(t).select("vendor", "n", stats.shrinkage(F.col("tau2"), F.col("within"), F.col("n")).alias("rho"))  # t is one row


@registry.query(f"WITH {_RHO}, m AS (SELECT quantile_disc(rho, 0.5) AS middle FROM weight) SELECT min(n) FILTER (WHERE rho >= middle) AS floor_n, count(*) FILTER (WHERE rho >= middle) AS supported, count(*) AS vendors FROM weight, m")
def observation_floor(spark: SparkSession, sf: str) -> DataFrame:
    """The least number of lines at which a vendor's own mean carries at least the middle weight."""
    w = weights(spark, sf)
    middle = w.agg(F.expr("percentile_disc(0.5) within group (order by rho)").alias("middle"))
    own = F.col("rho") >= F.col("middle")
    return w.crossJoin(middle).agg(F.min(F.when(own, F.col("n"))).alias("floor_n"), F.sum(own.cast("long")).alias("supported"), F.count("*").alias("vendors"))


@registry.query(f"""WITH {LINES}, w AS (SELECT DISTINCT vendor FROM line WHERE is_closed AND vendor % 11 <> 3), c AS (SELECT DISTINCT vendor FROM line WHERE is_closed AND vendor % 13 <> 4)
SELECT vendor, 'weight_without_count' AS fault FROM w WHERE vendor NOT IN (FROM c) UNION ALL SELECT vendor, 'count_without_weight' FROM c WHERE vendor NOT IN (FROM w)""")
def weight_count_pairing(spark: SparkSession, sf: str) -> DataFrame:
    """Vendors with a weight and no count, or the other way round (some are left out of each side here)."""
    v = lines(spark, sf).where("is_closed").select("vendor").distinct()
    w, c = v.where("vendor % 11 <> 3"), v.where("vendor % 13 <> 4")
    return w.join(c, "vendor", "left_anti").withColumn("fault", F.lit("weight_without_count")).unionByName(c.join(w, "vendor", "left_anti").withColumn("fault", F.lit("count_without_weight")))


#: An approximation of the normal quantile to nine places, in the oracle's SQL only.
_CENTRAL = "(((((-39.69683028665376*r+220.9460984245205)*r-275.9285104469687)*r+138.3577518672690)*r-30.66479806614716)*r+2.506628277459239)*q/(((((-54.47609879822406*r+161.5858368580409)*r-155.6989798598866)*r+66.80131188771972)*r-13.28068155288572)*r+1)"
_TAIL = "(((((-0.007784894002430293*s-0.3223964580411365)*s-2.400758277161838)*s-2.549732539343734)*s+4.374664141464968)*s+2.938163982698783)/((((0.007784695709041462*s+0.3224671290700398)*s+2.445134137142996)*s+3.754408661907416)*s+1)"


@registry.query(f"""WITH k AS (SELECT s_suppkey AS vendor, row_number() OVER (ORDER BY s_suppkey) AS i, count(*) OVER () AS n FROM supplier), u AS (SELECT *, (i - CAST(0.5 AS DOUBLE)) / n AS p FROM k), t AS (SELECT *, p - 0.5 AS q, (p - 0.5) * (p - 0.5) AS r, sqrt(-2 * ln(least(p, 1 - p))) AS s FROM u),
z AS (SELECT vendor, CASE WHEN p BETWEEN 0.02425 AND 0.97575 THEN {_CENTRAL} WHEN p < 0.5 THEN {_TAIL} ELSE -({_TAIL}) END AS z FROM t), m AS (SELECT avg(z) AS mean, stddev_pop(z) AS sd FROM z)
SELECT vendor, round(CAST(0.25 AS DOUBLE) * (z - mean) / sd, 6) + 0.0 AS effect FROM z, m""")
def vendor_offsets(spark: SparkSession, sf: str) -> DataFrame:
    """Vendor effects as normal quantiles at even places, standardised and scaled."""
    k = Y.ranked_members(table(spark, sf, "supplier"), "s_suppkey")
    n = k.agg(F.count("*").alias("n"))
    z = k.crossJoin(n).select(F.col("member").alias("vendor"), stats.normal_quantile((F.col("ordinal") + 0.5) / F.col("n")).alias("z"))
    m = z.agg(F.avg("z").alias("mean"), F.stddev_pop("z").alias("sd"))
    return z.crossJoin(m).select("vendor", (F.round(0.25 * (F.col("z") - F.col("mean")) / F.col("sd"), 6) + 0.0).alias("effect"))


@registry.query(f"""WITH {LINES}, x AS (SELECT line_id, order_date, duration * (2 * criticality - 3) AS twice FROM line)
SELECT line_id, CAST(greatest(0, CASE WHEN twice % 2 = 0 THEN twice // 2 WHEN (twice // 2) % 2 = 0 THEN twice // 2 ELSE twice // 2 + 1 END) AS BIGINT) AS slack FROM (SELECT line_id, CASE WHEN twice < 0 THEN 0 ELSE twice END AS twice FROM x)""")
def slack_days(spark: SparkSession, sf: str) -> DataFrame:
    """Slack of each line: its days times a factor of its criticality, rounded half to even, never below none."""
    own = lines(spark, sf)
    return own.select("line_id", F.greatest(F.lit(0), F.bround(F.col("duration") * (F.col("criticality") - 1.5), 0).cast("long")).alias("slack"))


@registry.query("SELECT o_orderkey AS po, CAST('0x' || substr(sha256('20260601|' || o_custkey || '|' || o_orderkey), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS uniform FROM orders")
def line_streams(spark: SparkSession, sf: str) -> DataFrame:
    """A line's own uniform number, from the digest of its natural key: the same whatever the partitions."""
    digest = F.sha2(F.concat_ws("|", F.lit("20260601"), F.col("o_custkey").cast("string"), F.col("o_orderkey").cast("string")), 256)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("po"), (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))).alias("uniform"))


@registry.query(f"""WITH {LINES}, p AS (SELECT 'open' AS population, line_id FROM line WHERE NOT is_closed UNION ALL SELECT 'held_out', line_id FROM line WHERE (is_closed AND po_number % 4 = 0) OR po_number % 400 = 1)
SELECT population, count(*) AS n, count(*) FILTER (WHERE line_id IN (SELECT line_id FROM p GROUP BY line_id HAVING count(*) > 1)) AS in_both FROM p GROUP BY population""")
def posterior_populations(spark: SparkSession, sf: str) -> DataFrame:
    """Open lines and held-out delivered ones as two populations; a line in both refuses the write (some are put in both here)."""
    own = lines(spark, sf)
    p = own.where("not is_closed").select(F.lit("open").alias("population"), "line_id").unionByName(own.where("(is_closed and po_number % 4 = 0) or po_number % 400 = 1").select(F.lit("held_out").alias("population"), "line_id"))
    both = p.groupBy("line_id").agg(F.count("*").alias("m"), F.collect_set("population").alias("of"))
    return both.select(F.explode("of").alias("population"), (F.col("m") > 1).cast("long").alias("twice")).groupBy("population").agg(F.count("*").alias("n"), F.sum("twice").alias("in_both"))


@registry.query(f"""WITH {LINES}, c AS (SELECT vendor, count(*) AS n, count(*) FILTER (WHERE duration <= 60) AS k FROM line WHERE is_closed GROUP BY vendor) SELECT vendor, n, k, CASE WHEN k = n THEN round(greatest(0, 1 - CAST(3 AS DOUBLE) / n), 6) WHEN k > 0 THEN 0.05 END AS shown FROM c""")
def binomial_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """The exact one-sided bound of a share: without misses the rule of three; else the tail at the bound, which is 5 %."""
    c = lines(spark, sf).where("is_closed").groupBy("vendor").agg(F.count("*").alias("n"), F.sum((F.col("duration") <= 60).cast("long")).alias("k"))
    bound = stats.precision_floor(F.col("k"), F.col("n"))
    return c.withColumn("b", bound).select("vendor", "n", "k", F.when(F.col("k") == F.col("n"), F.round("b", 6)).when(F.col("k") > 0, F.round(stats.binomial_upper("k", "n", "b"), 6)).alias("shown"))


#: Draws of the sojourn model: each is estimated on the completed legs of one part of the orders.
PARTS = 4
_Z = "((ln(days) - {mu}) / {sigma})"
_SP = "(greatest({0}, 0) + ln(1 + exp(-abs({0}))))"
_ODDS = "(intercept + beta * cycle)"
_LASTS_A, _LASTS_B = (f"CASE WHEN days > 0 THEN {stats.log_upper_tail_sql(_Z.format(mu=f'mu_{o}', sigma=f'sigma_{o}'))} ELSE 0 END" for o in "ab")
_WAY = " ".join(f"WHEN '{a}' THEN '{w[0]}'" for a, w in Y.WAYS.items())
_DRAWS = f"""{_FRAME},
closed AS (SELECT *, po % {PARTS} AS draw FROM frame WHERE NOT is_open),
sojourn AS (SELECT draw, state, next_state, avg(ln(days)) AS mu, greatest(coalesce(stddev_pop(ln(days)), 0), 0.05) AS sigma FROM closed WHERE days > 0 GROUP BY ALL),
odds AS (SELECT draw, cycle > 0 AS again, ln((count(*) FILTER (WHERE took_rework) + 0.5) / (count(*) FILTER (WHERE NOT took_rework) + 0.5)) AS odds FROM closed WHERE at_branch GROUP BY ALL),
branching AS (SELECT draw, coalesce(max(odds) FILTER (WHERE NOT again), 0) AS intercept, coalesce(max(odds) FILTER (WHERE again) - max(odds) FILTER (WHERE NOT again), 0) AS beta FROM odds GROUP BY draw),
asked AS (SELECT po, seq, state, days, cycle, at_branch, CASE state {_WAY} END AS way FROM frame WHERE is_open),
drawn AS (SELECT k.*, b.draw, intercept, beta, a.mu AS mu_a, a.sigma AS sigma_a, r.mu AS mu_b, r.sigma AS sigma_b FROM asked k JOIN sojourn a ON a.state = k.state AND a.next_state = way JOIN branching b ON b.draw = a.draw LEFT JOIN sojourn r ON k.at_branch AND r.draw = a.draw AND r.state = k.state AND r.next_state = '{Y.REWORK}' WHERE NOT k.at_branch OR r.mu IS NOT NULL),
ways AS (SELECT *, {_LASTS_A} AS la, CASE WHEN at_branch THEN {_LASTS_B} END AS lb FROM drawn),
mixed AS (SELECT *, -{_SP.format(_ODDS)} + la AS f, -{_SP.format('(-' + _ODDS + ')')} + lb AS r FROM ways),
contribution AS (SELECT po, seq, CASE WHEN at_branch THEN greatest(f, r) + ln(1 + exp(least(f, r) - greatest(f, r))) ELSE la END AS log_c FROM mixed)"""


def model_draws(own: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sojourn and branching parameters of a frame's completed legs, by part of the orders; see ``PARTS``."""
    closed = own.where("NOT is_open").withColumn("draw", F.col("po") % PARTS)
    log_days = F.log(F.col("days").cast("double"))
    sojourns = closed.where("days > 0").groupBy("draw", "state", "next_state").agg(F.avg(log_days).alias("mu"), F.greatest(F.coalesce(F.stddev_pop(log_days), F.lit(0.0)), F.lit(0.05)).alias("sigma"))
    taken = lambda v: F.sum((F.col("took_rework") == v).cast("long"))
    odds = closed.where("at_branch").groupBy("draw", (F.col("cycle") > 0).alias("again")).agg(F.log((taken(True) + 0.5) / (taken(False) + 0.5)).alias("odds"))
    first, later = F.max(F.when(~F.col("again"), F.col("odds"))), F.max(F.when(F.col("again"), F.col("odds")))
    return sojourns, odds.groupBy("draw").agg(F.coalesce(first, F.lit(0.0)).alias("intercept"), F.coalesce(later - first, F.lit(0.0)).alias("beta"))


@registry.query(f"WITH {_DRAWS} SELECT po, seq, count(*) AS draws, round(avg(log_c), 6) AS mean, round(ln(avg(exp(log_c))), 6) AS log_mean FROM contribution GROUP BY po, seq")
def decision_mixture(spark: SparkSession, sf: str) -> DataFrame:
    """Log-chance that each open leg lasts as long as it has, over all draws; at the branch state the mixture of both ways out."""
    own = frame(spark, sf)
    sojourns, branching = model_draws(own)
    out = Y.predictive(Y.log_contributions(own.where("is_open"), sojourns, branching, key="po"), key="po")
    return out.select("po", "seq", "draws", *(F.round(c, 6).alias(c) for c in ("mean", "log_mean")))

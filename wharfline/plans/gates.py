"""Diagnostics, gates, digests and verdicts over runs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.operators import forecast as C
from wharfline.operators import ingestion as I
from wharfline.operators.ordinals import sealed
from wharfline.session import table
from wharfline.shared import shared_dir
from wharfline.sources.runs import RunStore

from .frames import LINES, lines, sealed_sql
from .registry import Registry

registry = Registry()


def _ess_sql(parameter: str, chain: str, source: str) -> str:
    ks = range(C.LAGS)
    pairs = ", ".join(f"(1 - (w - c{k}) / pool) + (1 - (w - c{k + 1}) / pool)" for k in ks[::2])
    return f"""draw AS (SELECT {parameter} AS parameter, {chain} AS chain, event_id, value AS v, value - avg(value) OVER (PARTITION BY {parameter}, {chain}) AS z FROM {source}),
lagged AS (SELECT parameter, chain, v, z * z AS p0, {', '.join(f'z * lag(z, {k}) OVER w AS p{k}' for k in ks[1:])} FROM draw WINDOW w AS (PARTITION BY parameter, chain ORDER BY event_id)),
per AS (SELECT parameter, chain, count(*) AS n, avg(v) AS m, var_samp(v) AS v, {', '.join(f'coalesce(sum(p{k}), 0) AS s{k}' for k in ks)} FROM lagged GROUP BY parameter, chain),
folded AS (SELECT parameter, count(*) AS chains, CAST(sum(n) AS BIGINT) AS draws, avg(v) AS w, avg(v) * (avg(n) - 1) / avg(n) + var_samp(m) AS pool, {', '.join(f'avg(s{k} / n) AS c{k}' for k in ks)} FROM per GROUP BY parameter),
paired AS (SELECT parameter, chains, draws, [{pairs}] AS pairs FROM folded),
cut AS (SELECT *, list_min(list_filter(list_transform(range(0, len(pairs)), lambda i: CASE WHEN pairs[i + 1] <= 0 THEN i END), lambda i: i IS NOT NULL)) AS bad FROM paired),
ess AS (SELECT parameter, chains, draws, CASE WHEN bad IS NOT NULL THEN draws / greatest(2 * list_sum(pairs[1:greatest(bad, 1)]) - 1, CAST(1e-9 AS DOUBLE)) END AS ess FROM cut)"""


_CHAINS = _ess_sql("event_type", "user_id % 4", "events")


def draws(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("chain", F.col("user_id") % 4)


@registry.query(f"WITH {_CHAINS} SELECT parameter, chains, draws, round(ess, 4) AS ess FROM ess")
def chain_ess(spark: SparkSession, sf: str) -> DataFrame:
    """Effective sizes of four chains for each parameter."""
    out = C.effective_sizes(draws(spark, sf), parameter="event_type", chain="chain", order="event_id", value="value")
    return out.select(F.col("event_type").alias("parameter"), "chains", "draws", F.round("ess", 4).alias("ess"))


@registry.query(f"WITH {_ess_sql('user_id % 50', 'event_id % 4', 'events')} SELECT parameter AS line, draws, round(ess, 4) AS ess FROM ess")
def predictive_ess(spark: SparkSession, sf: str) -> DataFrame:
    """Effective sizes of each line's predictive draws over (chain, draw)."""
    d = table(spark, sf, "events").withColumn("line", F.col("user_id") % 50).withColumn("chain", F.col("event_id") % 4)
    return C.effective_sizes(d, parameter="line", chain="chain", order="event_id", value="value").select("line", "draws", F.round("ess", 4).alias("ess"))


_ENERGY = """energy AS (SELECT user_id % 4 AS chain, event_id, value AS e, value > 99.9 AS diverged, event_id % 500 = 3 AS deep FROM events),
step AS (SELECT chain, pow(e - lag(e) OVER (PARTITION BY chain ORDER BY event_id), 2) AS step, pow(e - avg(e) OVER (PARTITION BY chain), 2) AS off, diverged, deep FROM energy),
run AS (SELECT min(bfmi) AS ebfmi, CAST(sum(d) AS BIGINT) AS divergent_transitions, CAST(sum(t) AS BIGINT) AS max_treedepth_hits FROM (SELECT chain, sum(step) / sum(off) AS bfmi, count(*) FILTER (WHERE diverged) AS d, count(*) FILTER (WHERE deep) AS t FROM step GROUP BY chain))"""


def energy(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("chain"), "event_id", F.col("value").alias("e"), (F.col("value") > 99.9).alias("diverged"), (F.col("event_id") % 500 == 3).alias("deep"))
    return C.energy_diagnostics(e, chain="chain", order="event_id", energy="e", diverged="diverged", deep="deep")


@registry.query(f"WITH {_ENERGY} SELECT round(ebfmi, 8) AS ebfmi, divergent_transitions, max_treedepth_hits FROM run")
def energy_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """The three diagnostics of a whole run."""
    return energy(spark, sf).withColumn("ebfmi", F.round("ebfmi", 8))


_LIMITS = ", ".join(f"('{m}', CAST({t} AS DOUBLE), '{d}', {str(b).lower()})" for m, t, d, _, b in C.GATE)


@registry.query(f"""WITH {_CHAINS}, {_ENERGY}, hat AS (SELECT event_type AS parameter, round(sqrt((avg(v) * (avg(n) - 1) / avg(n) + var_samp(m)) / avg(v)), 8) AS value FROM (SELECT event_type, user_id % 4 AS chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY ALL) GROUP BY event_type),
rows AS (SELECT 'r_hat' AS metric, parameter, value FROM hat UNION ALL SELECT 'ess_bulk', parameter, round(ess, 4) FROM ess UNION ALL SELECT 'ess_tail', parameter, NULL FROM ess WHERE parameter = 'view' UNION ALL SELECT 'ebfmi', '', round(ebfmi, 8) FROM run UNION ALL SELECT 'divergent_transitions', '', divergent_transitions FROM run UNION ALL SELECT 'max_treedepth_hits', '', max_treedepth_hits FROM run),
gate AS (SELECT * FROM (VALUES {_LIMITS}) AS g(metric, threshold, direction, is_blocking))
SELECT metric, parameter, threshold, is_blocking, coalesce(CASE WHEN direction = 'max' THEN value <= threshold ELSE value >= threshold END, false) AS passed FROM rows JOIN gate USING (metric)""")
def run_gate(spark: SparkSession, sf: str) -> DataFrame:
    """All diagnostics against the six thresholds; one that could not be computed does not pass."""
    d = draws(spark, sf)
    name = F.col("event_type").alias("parameter")
    hat = C.chain_diagnostics(d, parameter="event_type", chain="chain", value="value").select(F.lit("r_hat").alias("metric"), name, F.round("r_hat", 8).alias("value"))
    sizes = C.effective_sizes(d, parameter="event_type", chain="chain", order="event_id", value="value").select(F.lit("ess_bulk").alias("metric"), name, F.round("ess", 4).alias("value"))
    lacking = sizes.where("parameter = 'view'").select(F.lit("ess_tail").alias("metric"), "parameter", F.lit(None).cast("double").alias("value"))
    e = energy(spark, sf)
    run = e.select(F.explode(F.array(*(F.struct(F.lit(c).alias("metric"), F.lit("").alias("parameter"), F.round(F.col(c).cast("double"), 8).alias("value")) for c in e.columns))).alias("r")).select("r.*")
    return C.run_gate(hat.unionByName(sizes).unionByName(lacking).unionByName(run)).select("metric", "parameter", "threshold", "is_blocking", "passed")


_ARMS = "arm AS (SELECT event_type AS arm, user_id AS query, avg(value) AS reciprocal FROM events GROUP BY event_type, user_id)"


def arms(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").groupBy(F.col("event_type").alias("arm"), F.col("user_id").alias("query")).agg(F.avg("value").alias("reciprocal"))


@registry.query(f"WITH {_ARMS}, m AS (SELECT arm, round(avg(reciprocal), 9) AS mean, count(*) AS n FROM arm GROUP BY arm) SELECT arm, mean, n, mean = (SELECT max(mean) FROM m) AND arm = (SELECT min(arm) FROM m WHERE mean = (SELECT max(mean) FROM m)) AS strongest FROM m")
def strongest_arm(spark: SparkSession, sf: str) -> DataFrame:
    """The arm with the greatest mean; of equal ones the first by name."""
    m = arms(spark, sf).groupBy("arm").agg(F.round(F.avg("reciprocal"), 9).alias("mean"), F.count("*").alias("n"))
    best = m.agg(F.min(F.struct((-F.col("mean")).alias("k"), "arm")).alias("b")).select(F.col("b.arm").alias("best"))
    return m.crossJoin(best).select("arm", "mean", "n", (F.col("arm") == F.col("best")).alias("strongest"))  # one row


@registry.query(f"""WITH {_ARMS}, d AS (SELECT a.query, a.reciprocal - b.reciprocal AS d FROM arm a JOIN arm b ON a.query = b.query AND a.arm = 'view' AND b.arm = 'click')
SELECT count(*) AS n, round(avg(d), 9) AS mean, round(stddev_samp(d) / sqrt(count(*)), 9) AS standard_error, count(*) FILTER (WHERE d > 0) AS wins, count(*) FILTER (WHERE d < 0) AS losses FROM d""")
def paired_differences(spark: SparkSession, sf: str) -> DataFrame:
    """Two arms compared query by query."""
    a = arms(spark, sf)
    d = a.where("arm = 'view'").join(a.where("arm = 'click'").select("query", F.col("reciprocal").alias("other")), "query").select((F.col("reciprocal") - F.col("other")).alias("d"))
    return d.agg(F.count("*").alias("n"), F.round(F.avg("d"), 9).alias("mean"), F.round(F.stddev_samp("d") / F.sqrt(F.count("*")), 9).alias("standard_error"), F.count_if(F.col("d") > 0).alias("wins"), F.count_if(F.col("d") < 0).alias("losses"))


_FIGURES = "figure AS (SELECT p_brand AS field, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k, count(*) FILTER (WHERE p_retailprice > 1500) AS j FROM part GROUP BY p_brand)"
STRENGTHS = ("strong", "even", "weak", "untested", "absent")


def figures(spark: SparkSession, sf: str) -> DataFrame:
    count = lambda c: F.count_if(F.expr(c))
    return table(spark, sf, "part").groupBy(F.col("p_brand").alias("field")).agg(F.count("*").alias("n"), count("p_size > 25").alias("k"), count("p_retailprice > 1500").alias("j"))


_STRENGTH = "CASE WHEN n < 5 THEN 'untested' WHEN k * 20 > n * 11 THEN 'strong' WHEN k * 20 < n * 9 THEN 'weak' ELSE 'even' END"


@registry.query(f"WITH {_FIGURES} SELECT field, n, CASE WHEN field LIKE 'Brand#1%' THEN 'strong' ELSE 'even' END AS declared, {_STRENGTH} AS observed FROM figure")
def baseline_strength(spark: SparkSession, sf: str) -> DataFrame:
    """What a rule was declared to be and what its figures show."""
    return figures(spark, sf).select("field", "n", F.expr("case when field like 'Brand#1%' then 'strong' else 'even' end").alias("declared"), F.expr(_STRENGTH).alias("observed"))


@registry.query(f"WITH {_FIGURES}, l AS (SELECT {_STRENGTH} AS label FROM figure) SELECT s.label, count(l.label) AS n FROM (SELECT unnest({list(STRENGTHS)}) AS label) s LEFT JOIN l USING (label) GROUP BY s.label")
def label_census(spark: SparkSession, sf: str) -> DataFrame:
    """Figures by label over the closed list of five, zeros included."""
    return I.counts_over_domain(spark.createDataFrame([(s,) for s in STRENGTHS], "label string"), figures(spark, sf).select(F.expr(_STRENGTH).alias("label")), ["label"])


_BOUND = f"""round(greatest(0, least(1, ((k / n) + z * z / (2 * n) - z * sqrt((k / n) * (1 - k / n) / n + z * z / (4 * n * n))) / (1 + z * z / n))), 9)"""


@registry.query(f"WITH {_FIGURES}, z AS (SELECT CAST({stats.Z95} AS DOUBLE) AS z) SELECT field, n, CASE WHEN field LIKE '%5' THEN 'census' WHEN k = 0 THEN 'no_event' ELSE 'sampled' END AS basis, CASE WHEN field NOT LIKE '%5' AND k > 0 THEN {_BOUND} END AS low, CASE WHEN field NOT LIKE '%5' AND k > 0 THEN NULL ELSE 'no interval: ' || CASE WHEN field LIKE '%5' THEN 'census' ELSE 'no_event' END || ' of ' || n END AS reason FROM figure, z")
def sampled_claim_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Estimates carry a Wilson bound; a census, or a count without an event, carries the reason for none and its denominator."""
    low, _ = stats.wilson(F.col("k"), F.col("n"))
    basis = F.when(F.col("field").like("%5"), "census").when(F.col("k") == 0, "no_event").otherwise("sampled")
    out = figures(spark, sf).withColumn("basis", basis).withColumn("low", F.round(low, 9))
    return out.select("field", "n", "basis", F.when(F.col("basis") == "sampled", F.col("low")).alias("low"), F.when(F.col("basis") != "sampled", F.concat(F.lit("no interval: "), "basis", F.lit(" of "), F.col("n").cast("string"))).alias("reason"))


@registry.query(f"""WITH {LINES}, m AS (SELECT category, quantile_disc(duration, 0.5) AS median_days, count(*) AS n FROM line WHERE is_closed GROUP BY category)
SELECT category, median_days, n, abs(median_days - 60) <= 6 AS within, abs(median_days - 60) <= 6 AND n >= 30 AS passed FROM m""")
def band_gates(spark: SparkSession, sf: str) -> DataFrame:
    """A category's median within six days of its target, on thirty lines or more."""
    days = lines(spark, sf).where("is_closed").groupBy("category").agg(F.expr("percentile_disc(0.5) within group (order by duration)").cast("long").alias("median_days"), F.count("*").alias("n"))
    within = F.abs(F.col("median_days") - 60) <= 6
    return days.select("category", "median_days", "n", within.alias("within"), (within & (F.col("n") >= 30)).alias("passed"))


@registry.query(f"WITH {LINES} SELECT project, count(*) AS n, avg(CAST(criticality >= 4 AND duration > 60 AS INTEGER)) AS urgent_and_long, avg(CAST(is_closed AND quantity < 10 AS INTEGER)) AS closed_and_small, avg(CAST(criticality = 5 OR quantity > 45 AS INTEGER)) AS either FROM line GROUP BY project")
def overlap_shares(spark: SparkSession, sf: str) -> DataFrame:
    """Shares of lines that meet several clauses at once."""
    share = lambda c: F.avg(F.expr(c).cast("int"))
    return lines(spark, sf).groupBy("project").agg(F.count("*").alias("n"), share("criticality >= 4 and duration > 60").alias("urgent_and_long"), share("is_closed and quantity < 10").alias("closed_and_small"), share("criticality = 5 or quantity > 45").alias("either"))


@registry.query("SELECT event_type AS route, count(*) AS n, max(value) AS worst, round(avg(value), 9) AS mean, quantile_disc(value, 0.95) AS p95, max(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS peak, CASE WHEN max(value) <= 99.5 AND max(CAST(json_extract_string(props, '$.k') AS BIGINT)) <= 100 THEN 'within' ELSE 'over' END AS verdict FROM events GROUP BY event_type")
def latency_report(spark: SparkSession, sf: str) -> DataFrame:
    """Worst, mean and nearest-rank 95th of each route and the peak of what it holds, both against their budgets."""
    e = table(spark, sf, "events").groupBy(F.col("event_type").alias("route"))
    out = e.agg(F.count("*").alias("n"), F.max("value").alias("worst"), F.round(F.avg("value"), 9).alias("mean"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95"), F.max(F.get_json_object("props", "$.k").cast("long")).alias("peak"))
    return out.withColumn("verdict", F.when((F.col("worst") <= 99.5) & (F.col("peak") <= 100), "within").otherwise("over"))


@registry.query("""WITH t AS (SELECT 'supplier' AS input, count(*) AS rows, CAST(bit_xor(s_suppkey * 2654435761 % 4294967296) AS BIGINT) AS observed FROM supplier UNION ALL SELECT 'part', count(*), CAST(bit_xor(p_partkey * 2654435761 % 4294967296) AS BIGINT) FROM part UNION ALL SELECT 'orders', count(*), CAST(bit_xor(o_orderkey * 2654435761 % 4294967296) AS BIGINT) FROM orders),
r AS (SELECT input, CASE WHEN input = 'part' THEN observed + 1 ELSE observed END AS recorded FROM t WHERE input <> 'orders' UNION ALL SELECT 'gone', 7)
SELECT coalesce(t.input, r.input) AS input, CASE WHEN recorded IS NULL THEN 'new' WHEN observed IS NULL THEN 'missing' WHEN recorded = observed THEN 'same' ELSE 'moved' END AS status FROM t FULL JOIN r ON t.input = r.input""")
def moved_inputs(spark: SparkSession, sf: str) -> DataFrame:
    """Inputs of a recorded run against what is there now, by a digest that does not depend on row order."""
    of = lambda name, key: table(spark, sf, name).agg(F.count("*").alias("rows"), F.bit_xor(F.col(key) * 2654435761 % 4294967296).alias("observed")).select(F.lit(name).alias("input"), "observed")
    now = of("supplier", "s_suppkey").unionByName(of("part", "p_partkey")).unionByName(of("orders", "o_orderkey"))
    held = now.where("input <> 'orders'").select("input", F.when(F.col("input") == "part", F.col("observed") + 1).otherwise(F.col("observed")).alias("recorded")).unionByName(spark.sql("select 'gone' as input, 7L as recorded"))
    return now.join(held, "input", "full").select("input", F.when(F.col("recorded").isNull(), "new").when(F.col("observed").isNull(), "missing").when(F.col("recorded") == F.col("observed"), "same").otherwise("moved").alias("status"))


@registry.query("""WITH f AS (SELECT o_orderkey AS run_id, unnest(['status', 'priority', 'customer']) AS field, unnest([o_orderstatus, o_orderpriority, CAST(o_custkey AS VARCHAR)]) AS recorded, unnest([CASE WHEN o_orderkey % 10 = 3 THEN NULL ELSE o_orderstatus END, CASE WHEN o_orderkey % 15 = 4 THEN 'x' ELSE o_orderpriority END, CAST(o_custkey AS VARCHAR)]) AS observed FROM orders)
SELECT run_id, field, recorded, coalesce(observed, '(none)') AS observed FROM f WHERE recorded IS DISTINCT FROM observed""")
def provenance_differences(spark: SparkSession, sf: str) -> DataFrame:
    """The fields of two records that are not equal, a null being a value."""
    o = table(spark, sf, "orders")
    cell = lambda n, a, b: F.struct(F.lit(n).alias("field"), a.cast("string").alias("recorded"), b.cast("string").alias("observed"))
    c = F.col
    cells = F.explode(F.array(cell("status", c("o_orderstatus"), F.when(c("o_orderkey") % 10 != 3, c("o_orderstatus"))), cell("priority", c("o_orderpriority"), F.when(c("o_orderkey") % 15 == 4, "x").otherwise(c("o_orderpriority"))), cell("customer", c("o_custkey"), c("o_custkey"))))
    out = o.select(c("o_orderkey").alias("run_id"), cells.alias("f")).select("run_id", "f.*").where(~c("recorded").eqNullSafe(c("observed")))
    return out.withColumn("observed", F.coalesce("observed", F.lit("(none)")))


@registry.query("""WITH d AS (SELECT p_partkey AS line, md5(p_name) AS stored, CASE WHEN p_partkey % 9 = 2 THEN NULL WHEN p_partkey % 7 = 1 THEN md5('x') ELSE md5(p_name) END AS refit, CASE WHEN p_partkey % 5 = 0 THEN md5('y') ELSE md5(p_name) END AS fixture FROM part)
SELECT CASE WHEN refit IS NULL THEN 'scope_limited' WHEN stored = refit AND refit = fixture THEN 'three_agree' WHEN stored = refit THEN 'fixture_differs' WHEN stored = fixture THEN 'refit_differs' WHEN refit = fixture THEN 'stored_differs' ELSE 'none_agree' END AS verdict, count(*) AS n FROM d GROUP BY 1""")
def draw_digest_claims(spark: SparkSession, sf: str) -> DataFrame:
    """Digests of a line's draws as stored, refitted and in the fixture: agreement of three, of two, or a claim limited in scope."""
    p, own = table(spark, sf, "part"), F.md5("p_name")
    d = p.select(own.alias("stored"), F.when(F.col("p_partkey") % 9 == 2, None).when(F.col("p_partkey") % 7 == 1, F.md5(F.lit("x"))).otherwise(own).alias("refit"), F.when(F.col("p_partkey") % 5 == 0, F.md5(F.lit("y"))).otherwise(own).alias("fixture"))
    verdict = F.expr("case when refit is null then 'scope_limited' when stored = refit and refit = fixture then 'three_agree' when stored = refit then 'fixture_differs' when stored = fixture then 'refit_differs' when refit = fixture then 'stored_differs' else 'none_agree' end")
    return d.groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@registry.query(f"""WITH r AS (SELECT s_nationkey AS population, s_suppkey AS ordinal, sha256(s_name || '|' || s_suppkey) AS digest FROM supplier), b AS (SELECT population, ordinal // 1024 AS b, count(*) AS n, sha256(string_agg(digest, chr(10) ORDER BY ordinal)) AS d FROM r GROUP BY ALL)
SELECT population, CAST(sum(n) AS BIGINT) AS n, sha256(string_agg(d, chr(10) ORDER BY b)) AS artifact FROM b GROUP BY population""")
def artifact_digests(spark: SparkSession, sf: str) -> DataFrame:
    """One digest for each population over its rows' digests in order."""
    rows = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("population"), F.col("s_suppkey").alias("ordinal"), F.sha2(F.concat_ws("|", "s_name", F.col("s_suppkey").cast("string")), 256).alias("digest"))
    return C.ordered_artifact_digest(rows, group="population", ordinal="ordinal", digest="digest")


@registry.query(f"""WITH {LINES} SELECT project, 'W/"' || sha256(project || '|' || count(*) || '|' || max(line_id) || '|' || max(need_by)) || '"' AS etag FROM line WHERE NOT is_closed GROUP BY project""")
def response_validators(spark: SparkSession, sf: str) -> DataFrame:
    """A weak validator for each project's page: a digest of what the page admits."""
    g = lines(spark, sf).where("not is_closed").groupBy("project").agg(F.count("*").alias("n"), F.max("line_id").alias("m"), F.max("need_by").alias("d"))
    return g.select("project", F.concat(F.lit('W/"'), F.sha2(F.concat_ws("|", "project", F.col("n").cast("string"), "m", F.col("d").cast("string")), 256), F.lit('"')).alias("etag"))


@registry.query("SELECT page_id, CASE WHEN page_id % 10 = 4 THEN 'UNREACHABLE' WHEN md5(html) = md5(CASE WHEN page_id % 6 = 0 THEN html || ' ' ELSE html END) THEN 'MATCH' ELSE 'DIVERGED' END AS status FROM pages")
def reverification_status(spark: SparkSession, sf: str) -> DataFrame:
    """Documents fetched again: the digest holds, differs, or nothing came back (stand-ins for fetches here)."""
    again = F.when(F.col("page_id") % 10 == 4, None).otherwise(F.when(F.col("page_id") % 6 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html")))
    return table(spark, sf, "pages").select("page_id", F.when(again.isNull(), "UNREACHABLE").when(F.md5(again) == F.md5("html"), "MATCH").otherwise("DIVERGED").alias("status"))


_RENAMED = "CASE WHEN s_nationkey = 3 THEN upper(s_name) ELSE s_name END"


@registry.query(f"SELECT s_nationkey AS nation, a.n, a.n = b.n AND a.digest = b.digest AS bound FROM ({sealed_sql('supplier', 's_nationkey', 's_name')}) a JOIN ({sealed_sql('supplier', 's_nationkey', _RENAMED)}) b USING (s_nationkey)")
def ground_truth_binding(spark: SparkSession, sf: str) -> DataFrame:
    """A truth record holds for the roster it was made from: as many members, and the digest of their names in order."""
    s = table(spark, sf, "supplier").select("s_nationkey", "s_name")
    own = sealed(s, group="s_nationkey", text="s_name").select("s_nationkey", "n", F.col("digest").alias("now"))
    renamed = s.withColumn("s_name", F.when(F.col("s_nationkey") == 3, F.upper("s_name")).otherwise(F.col("s_name")))
    truth = sealed(renamed, group="s_nationkey", text="s_name").select("s_nationkey", F.col("n").alias("members"), F.col("digest").alias("sealed"))
    return own.join(truth, "s_nationkey").select(F.col("s_nationkey").alias("nation"), "n", ((F.col("n") == F.col("members")) & (F.col("now") == F.col("sealed"))).alias("bound"))


#: The five stores of a run: table and key.
STORES = {"inputs": ("orders", "o_orderkey"), "roster": ("supplier", "s_suppkey"), "training": ("customer", "c_custkey"), "draws": ("part", "p_partkey"), "verdicts": ("nation", "n_nationkey")}


def run_store(spark: SparkSession, sf: str) -> RunStore:
    """A store with an earlier run, of the even keys, and the run in force, of all."""
    store = RunStore(spark, f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}")
    whole = {name: table(spark, sf, source).select(F.col(key).cast("long").alias("key")) for name, (source, key) in STORES.items()}
    store.publish({name: df.where("key % 2 = 0") for name, df in whole.items()}, run_id="earlier")
    store.publish(whole, run_id="current")
    return store


@registry.query(" UNION ALL ".join(f"SELECT '{name}' AS artifact, 'current' AS run_id, count(*) AS n, CAST(sum({key}) AS BIGINT) AS keys FROM {source}" for name, (source, key) in STORES.items()))
def recorded_run(spark: SparkSession, sf: str) -> DataFrame:
    """What the run in force holds in each of its five stores, read by the pointer's run id."""
    found = run_store(spark, sf).recorded(*STORES)
    parts = [df.groupBy("run_id").agg(F.count("*").alias("n"), F.sum("key").alias("keys")).select(F.lit(name).alias("artifact"), "run_id", "n", "keys") for name, df in found.items()]
    return reduce(DataFrame.unionByName, parts)

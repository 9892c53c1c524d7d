"""Forecast, diagnostics and accounting queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats
from wharfline.operators import forecast as C
from wharfline.operators import ingestion as I
from wharfline.session import table

from .frames import LINES, lines, posteriors
from .registry import Registry

registry = Registry()
#: Ids that a zone of the roster spans.
ZONE_IDS = 4096

_FIT = f"""{LINES}, cell AS (SELECT category, vendor, count(*) AS n, avg(ln(1 + CAST(duration AS DOUBLE))) AS m, var_pop(ln(1 + CAST(duration AS DOUBLE))) AS v FROM line WHERE is_closed GROUP BY category, vendor),
grp AS (SELECT category, sum(n * m) / sum(n) AS gm, sum(n * v) / sum(n) AS within FROM cell GROUP BY category),
spread AS (SELECT category, any_value(gm) AS gm, any_value(within) AS within, sum(n * (m - gm) * (m - gm)) / sum(n) AS between_ FROM cell JOIN grp USING (category) GROUP BY category),
fit AS (SELECT category, vendor, n, gm + CASE WHEN within > 0 THEN between_ / (between_ + within / n) ELSE 0 END * (m - gm) AS mu, sqrt(within) AS sigma FROM cell JOIN spread USING (category))"""


def fit(spark: SparkSession, sf: str) -> DataFrame:
    return C.lognormal_fit(lines(spark, sf).where("is_closed"))


@registry.query(f"WITH {_FIT} SELECT category, vendor, n, round(mu, 6) AS mu, round(sigma, 6) AS sigma FROM fit")
def lognormal_fit(spark: SparkSession, sf: str) -> DataFrame:
    return fit(spark, sf).select("category", "vendor", "n", F.round("mu", 6).alias("mu"), F.round("sigma", 6).alias("sigma"))


@registry.query()
def remaining_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    """Days left of each open line; SQL here has no normal quantile, a test checks the function."""
    return C.remaining(lines(spark, sf).where("not is_closed"), fit(spark, sf))


@registry.query()
def effect_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Each vendor's effect with its interval, each category's two variances read as one draw; SQL here has no error function, a test checks it."""
    known = lines(spark, sf)
    _, by_category = C.variances(known.where("is_closed"), group="category", member="vendor", days="duration")
    counts = known.groupBy("vendor").agg(F.count_if("is_closed").alias("n"))
    return C.effect_intervals(counts, by_category.select(F.sqrt("between").alias("tau"), F.sqrt("within").alias("sigma")))


@registry.query(f"""WITH {LINES}, m AS (SELECT category, vendor, count(*) AS n, avg(ln(1 + CAST(duration AS DOUBLE))) AS mean, var_pop(ln(1 + CAST(duration AS DOUBLE))) AS var FROM line WHERE is_closed GROUP BY ALL), g AS (SELECT category, sum(n * mean) / sum(n) AS grand FROM m GROUP BY category),
d AS (SELECT sum(n * pow(mean - grand, 2)) / sum(n) AS t, sum(n * var) / sum(n) AS s FROM m JOIN g USING (category) GROUP BY category HAVING sum(n * var) > 0),
c AS (SELECT vendor, count(*) FILTER (WHERE is_closed) AS n FROM line GROUP BY vendor), r AS (SELECT n, list(n * t / (n * t + s) ORDER BY n * t / (n * t + s)) AS rho FROM (SELECT DISTINCT n FROM c), d GROUP BY n),
w AS (SELECT n, rho, unnest(range(1, len(rho) - CAST(floor(0.9 * len(rho)) AS BIGINT) + 1)) AS i, CAST(floor(0.9 * len(rho)) AS BIGINT) AS span FROM r),
b AS (SELECT n, any_value(rho[CAST(ceil(len(rho) * 0.5) AS BIGINT)]) AS median, arg_min(rho[i], (round(rho[i + span] - rho[i], 12), i)) AS low, arg_min(rho[i + span], (round(rho[i + span] - rho[i], 12), i)) AS high FROM w GROUP BY n)
SELECT vendor, n, round(median, 5) AS median, round(low, 5) AS low, round(high, 5) AS high FROM c JOIN b USING (n)""")
def shrinkage_draws(spark: SparkSession, sf: str) -> DataFrame:
    """Weight of each vendor's own mean as median and interval, each category's two variances read as one draw."""
    known = lines(spark, sf)
    _, by_category = C.variances(known.where("is_closed"), group="category", member="vendor", days="duration")
    draws = by_category.where("within > 0").select(F.sqrt("between").alias("tau"), F.sqrt("within").alias("sigma"))
    out = C.shrinkage_intervals(known.groupBy("vendor").agg(F.count_if("is_closed").alias("n")), draws)
    return out.select("vendor", "n", *(F.round(c, 5).alias(c) for c in ("median", "low", "high")))


@registry.query()
def draw_byte_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A digest of each vendor's draws as stored doubles; SQL here has no bytes of doubles, a test checks it."""
    return posteriors(spark, sf).select("vendor", F.size("draws").cast("long").alias("n"), stats.float_digest(F.col("draws").cast("array<double>")).alias("digest"))


@registry.query("""WITH c AS (SELECT event_type, user_id % 4 AS chain, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM events GROUP BY ALL)
SELECT event_type, count(*) AS chains, CAST(sum(n) AS BIGINT) AS draws, round(sqrt((avg(v) * (avg(n) - 1) / avg(n) + var_samp(m)) / avg(v)), 8) AS r_hat, round(sqrt((avg(v) * (avg(n) - 1) / avg(n) + var_samp(m)) / avg(v)), 8) <= 1.001 AS passed FROM c GROUP BY event_type""")
def chain_diagnostics(spark: SparkSession, sf: str) -> DataFrame:
    """Scale reduction over four chains for each parameter, and the gate."""
    d = table(spark, sf, "events").withColumn("chain", F.col("user_id") % 4)
    return C.gate(C.chain_diagnostics(d, parameter="event_type", chain="chain", value="value").withColumn("r_hat", F.round("r_hat", 8)), ceiling=1.001)


@registry.query("""WITH d AS (SELECT event_id % 10 AS seed, avg(value) FILTER (WHERE event_type = 'view') - avg(value) FILTER (WHERE event_type = 'click') AS delta FROM events GROUP BY 1)
SELECT round(quantile_disc(delta, 0.5), 9) AS median_delta, round(min(delta), 9) AS low, round(max(delta), 9) AS high, count(*) AS n FROM d""")
def seed_deltas(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest-rank median and range of the difference of two arms over seeds."""
    arm = lambda t: F.avg(F.when(F.col("event_type") == t, F.col("value")))
    d = table(spark, sf, "events").groupBy((F.col("event_id") % 10).alias("seed")).agg((arm("view") - arm("click")).alias("delta"))
    return d.agg(F.round(F.expr("percentile_disc(0.5) within group (order by delta)"), 9).alias("median_delta"), F.round(F.min("delta"), 9).alias("low"), F.round(F.max("delta"), 9).alias("high"), F.count("*").alias("n"))


@registry.query("""WITH d AS (SELECT doc_id, source, lang, text FROM documents), f AS (SELECT unnest(['MIT', 'Apache', 'General', 'zzz']) AS field)
SELECT field, count(*) AS attempted, count(*) FILTER (WHERE contains(text, field)) AS stored, count(*) FILTER (WHERE NOT contains(text, field)) AS correct_negative FROM d, f GROUP BY field""")
def attempt_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of (document, field), split into stored and correctly absent; the two add up to the attempts."""
    fields = F.explode(F.array(*map(F.lit, ("MIT", "Apache", "General", "zzz"))))  # a closed list
    d = table(spark, sf, "documents").select("text", fields.alias("field"))
    hit = F.expr("instr(text, field) > 0")
    return d.groupBy("field").agg(F.count("*").alias("attempted"), F.sum(hit.cast("long")).alias("stored"), F.sum((~hit).cast("long")).alias("correct_negative"))


_CLASSES = ("extracted", "excluded", "failed", "skipped")
_DISPOSITION = "CASE WHEN length(text) < 40 THEN 'failed' WHEN lang = 'es' THEN 'excluded' ELSE 'extracted' END"


@registry.query(f"SELECT c AS disposition, count(doc_id) AS n FROM (SELECT unnest({list(_CLASSES)}) AS c) LEFT JOIN documents ON c = {_DISPOSITION} GROUP BY c")
def disposition_ledger(spark: SparkSession, sf: str) -> DataFrame:
    """Every document in one of four classes, zeros included."""
    d = table(spark, sf, "documents").select(F.expr(_DISPOSITION).alias("disposition"))
    return I.counts_over_domain(spark.createDataFrame([(c,) for c in _CLASSES], "disposition string"), d, ["disposition"])


@registry.query("""WITH n AS (SELECT vec_id, label, embedding, sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) AS len FROM embeddings)
SELECT label, count(*) AS n, round(max(list_max(list_transform(embedding, lambda v: abs(CAST(v AS DOUBLE) - CAST(v AS DOUBLE) / greatest(len, 1e-12))))), 6) AS worst FROM n GROUP BY label""")
def encoder_parity(spark: SparkSession, sf: str) -> DataFrame:
    """Largest difference between a stored vector and its own normalised form."""
    e = F.col("embedding")
    rows = table(spark, sf, "embeddings").withColumn("unit", arrays.l2_normalized(e))
    gap = F.array_max(F.zip_with(e, F.col("unit"), lambda a, b: F.abs(a.cast("double") - b)))
    return rows.groupBy("label").agg(F.count("*").alias("n"), F.round(F.max(gap), 6).alias("worst"))


@registry.query("""WITH f AS (SELECT p_brand, count(*) AS denominator, count(*) FILTER (WHERE p_size = 50) AS k FROM part GROUP BY p_brand)
SELECT p_brand, denominator, CASE WHEN k > 0 THEN 'interval' ELSE 'no_event' END AS basis FROM f""")
def figure_publication(spark: SparkSession, sf: str) -> DataFrame:
    """A figure carries an interval or the reason for none, and then its denominator."""
    f = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("denominator"), F.sum((F.col("p_size") == 50).cast("long")).alias("k"))
    return f.select("p_brand", "denominator", F.when(F.col("k") > 0, "interval").otherwise("no_event").alias("basis"))


@registry.query(f"""WITH {LINES} SELECT vendor, min(r) AS ordinal FROM (SELECT vendor, dense_rank() OVER (ORDER BY vendor) - 1 AS r FROM line) GROUP BY vendor""")
def roster_index(spark: SparkSession, sf: str) -> DataFrame:
    """Zero-based index of the vendors over all lines: places in zones of the ids, after the members of the zones before."""
    v = lines(spark, sf).select("vendor").distinct().withColumn("zone", F.floor(F.col("vendor") / ZONE_IDS))
    counts = v.groupBy("zone").agg(F.count("*").alias("n"))
    ahead = counts.select("zone", F.coalesce(F.sum("n").over(Window.orderBy("zone").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ahead"))
    place = F.row_number().over(Window.partitionBy("zone").orderBy("vendor")) - 1
    return v.withColumn("place", place).join(ahead, "zone").select("vendor", (F.col("ahead") + F.col("place")).alias("ordinal"))


@registry.query(f"""WITH {LINES} SELECT 'vendor' AS covariate, count(DISTINCT vendor) > 1 AS varies FROM line WHERE is_closed UNION ALL SELECT 'category', count(DISTINCT category) > 1 FROM line WHERE is_closed UNION ALL SELECT 'always_closed', count(DISTINCT is_closed) > 1 FROM line WHERE is_closed""")
def covariate_presence(spark: SparkSession, sf: str) -> DataFrame:
    """Which covariates vary in the frame, from their least and greatest values."""
    frame = lines(spark, sf).where("is_closed")
    r = frame.agg(*((F.min(c) != F.max(c)).alias(a) for c, a in (("vendor", "vendor"), ("category", "category"), ("is_closed", "always_closed"))))
    return r.select(F.explode(F.array(*(F.struct(F.lit(c).alias("covariate"), F.col(c).alias("varies")) for c in r.columns))).alias("x")).select("x.*")

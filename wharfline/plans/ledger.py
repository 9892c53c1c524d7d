"""Ledger, reconciliation, data-quality, identity and line-detail queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.operators import identity as D
from wharfline.operators import ledger as L
from wharfline.operators import linedetail as V
from wharfline.operators import rules as Q
from wharfline.session import table
from wharfline.shared import materialize

from .frames import AS_OF, EVENTS, LINES, events, lines
from .registry import Registry

registry = Registry()

#: (version, model, effective_from, USD for a million tokens: input, cache write, cache read, output); one model has two dates.
PRICES = [
    ("v1", "view", "2023-12-01", "3.000000", "3.750000", "0.300000", "15.000000"),
    ("v1", "view", "2024-01-15", "2.500000", "3.125000", "0.250000", "12.345678"),
    ("v1", "click", "2024-01-10", "0.800001", "1.000000", "0.080000", "4.000000"),
    ("v1", "purchase", "2023-01-01", "15.000000", "18.750000", "1.500000", "75.000000"),
    ("v2", "view", "2023-12-01", "9.000000", "9.000000", "9.000000", "9.000000"),
]
_PRICE_ROWS = ", ".join(f"('{v}', '{m}', DATE '{d}', {a}, {b}, {c}, {e})" for v, m, d, a, b, c, e in PRICES)
INVOCATIONS = f"""
price AS (SELECT version, model, effective_from, CAST(a AS DECIMAL(12, 6)) AS a, CAST(b AS DECIMAL(12, 6)) AS b, CAST(c AS DECIMAL(12, 6)) AS c, CAST(e AS DECIMAL(12, 6)) AS e FROM (VALUES {_PRICE_ROWS}) AS p(version, model, effective_from, a, b, c, e)),
invocation AS (SELECT event_id AS invocation_id, user_id AS trace_id, event_type AS model, ts AS called_at, CAST(floor(value * 100) AS BIGINT) AS input_tokens, event_id % 97 AS cache_write_tokens, event_id % 31 AS cache_read_tokens, CAST(floor(value * 7) AS BIGINT) AS output_tokens FROM events),
priced AS (SELECT invocation.*, a, b, c, e FROM invocation LEFT JOIN LATERAL (SELECT a, b, c, e FROM price WHERE price.model = invocation.model AND version = 'v1' AND effective_from <= CAST(called_at AS DATE) ORDER BY effective_from DESC LIMIT 1) ON true)"""


def prices(spark: SparkSession) -> DataFrame:
    raw = spark.createDataFrame(PRICES, "version string, model string, effective_from string, a string, b string, c string, e string")
    return raw.select("version", "model", F.col("effective_from").cast("date").alias("effective_from"), *(F.col(c).cast("decimal(12,6)").alias(c) for c in "abce"))


def invocations(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    whole = lambda k: F.floor(F.col("value") * k).cast("long")
    return e.select(F.col("event_id").alias("invocation_id"), F.col("user_id").alias("trace_id"), F.col("event_type").alias("model"), F.col("ts").alias("at"), whole(100).alias("input_tokens"), (F.col("event_id") % 97).alias("cache_write_tokens"), (F.col("event_id") % 31).alias("cache_read_tokens"), whole(7).alias("output_tokens"))


def priced(spark: SparkSession, sf: str) -> DataFrame:
    joined = L.priced(invocations(spark, sf), prices(spark), version="v1")
    tokens = [F.col(f"{c}_tokens") for c in L.CLASSES]
    return joined.withColumn("cost", L.cost(tokens, [F.col(c) for c in "abce"]))


@registry.query(f"""WITH {INVOCATIONS} SELECT invocation_id, model, CASE WHEN a IS NULL THEN 'no_covering_price_entry' END AS absent_reason, CAST(CASE WHEN n IS NULL THEN NULL WHEN n % 100 > 50 OR (n % 100 = 50 AND (n // 100) % 2 = 1) THEN n // 100 + 1 ELSE n // 100 END AS DOUBLE) / 1e10 AS cost_usd
FROM (SELECT *, input_tokens * CAST(a * 1000000 AS HUGEINT) + cache_write_tokens * CAST(b * 1000000 AS HUGEINT) + cache_read_tokens * CAST(c * 1000000 AS HUGEINT) + output_tokens * CAST(e * 1000000 AS HUGEINT) AS n FROM priced)""")
def price_asof_cost(spark: SparkSession, sf: str) -> DataFrame:
    """Each invocation at the price in force; the oracle rounds half to even in whole numbers."""
    out = priced(spark, sf)
    return out.select("invocation_id", "model", F.when(F.col("a").isNull(), "no_covering_price_entry").alias("absent_reason"), (F.col("cost") * F.lit(10_000_000_000).cast("decimal(12,0)")).cast("double").alias("units")).select("invocation_id", "model", "absent_reason", (F.col("units") / F.lit(1e10)).alias("cost_usd"))


@registry.query(f"WITH {INVOCATIONS} SELECT trace_id, count(*) AS n, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(cache_write_tokens) AS BIGINT) AS cache_write_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM invocation GROUP BY trace_id")
def token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    names = [f"{c}_tokens" for c in L.CLASSES]
    return invocations(spark, sf).groupBy("trace_id").agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in names))


@registry.query("""WITH a AS (SELECT conv_id, count(*) FILTER (WHERE role = 'assistant') AS attempts, min(length(text)) FILTER (WHERE role = 'assistant') AS shortest, arg_max(length(text), turn) AS last_length, arg_min(length(text), turn) AS first_length FROM conversations GROUP BY conv_id)
SELECT CASE WHEN first_length >= 200 THEN 'valid' WHEN attempts > 1 AND last_length >= 200 THEN 'repaired' ELSE 'failed' END AS outcome, count(*) AS n FROM a GROUP BY 1""")
def outcome_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Valid at first, repaired or failed; a turn of 200 characters or more counts as valid."""
    c = table(spark, sf, "conversations").groupBy("conv_id").agg(F.sum((F.col("role") == "assistant").cast("long")).alias("attempts"), F.max_by(F.length("text"), "turn").alias("last"), F.min_by(F.length("text"), "turn").alias("first"))
    return c.groupBy(L.outcome(F.col("first") >= 200, F.col("attempts"), F.col("last") >= 200).alias("outcome")).agg(F.count("*").alias("n"))


_SIDES = """l AS (SELECT o_orderkey AS k, o_orderstatus AS s FROM orders WHERE o_orderkey % 5 <> 1), r AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 50 = 0 THEN NULL ELSE o_orderstatus END AS s FROM orders WHERE o_orderkey % 7 <> 2)"""


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    return o.where("k % 5 <> 1"), o.where("k % 7 <> 2").withColumn("s", F.when(F.col("k") % 50 != 0, F.col("s")))


@registry.query(f"WITH {_SIDES} (SELECT k, s, 'left' AS side FROM (FROM l EXCEPT ALL FROM r)) UNION ALL (SELECT k, s, 'right' AS side FROM (FROM r EXCEPT ALL FROM l))")
def reconcile_symmetric_diff(spark: SparkSession, sf: str) -> DataFrame:
    return L.symmetric_difference(*_sides(spark, sf))


@registry.query(f"WITH {_SIDES} SELECT count(*) AS n, sum(k) AS keys FROM (SELECT k FROM l INTERSECT SELECT k FROM r)")
def shared_keys(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return left.select("k").intersect(right.select("k")).agg(F.count("*").alias("n"), F.sum("k").cast("double").alias("keys"))


@registry.query(f"WITH {_SIDES} SELECT k, s FROM r WHERE k NOT IN (SELECT k FROM l)")
def insert_if_absent(spark: SparkSession, sf: str) -> DataFrame:
    left, right = _sides(spark, sf)
    return L.unseen(right, left, ["k"])


_SPOOL = """spool AS (SELECT event_id AS invocation_id, CAST(floor(value) AS BIGINT) - 1 AS tokens, CASE WHEN event_id % 11 = 0 THEN 2 ELSE 1 END AS payload_version FROM events UNION ALL SELECT NULL, 5, 1),
held AS (SELECT event_id AS invocation_id FROM events WHERE event_id % 4 = 0)"""


def _spool(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").alias("invocation_id"), (F.floor("value").cast("long") - 1).alias("tokens"), F.when(F.col("event_id") % 11 == 0, 2).otherwise(1).alias("payload_version"))
    return rows.unionAll(spark.sql("select cast(null as bigint), 5L, 1")), e.where("event_id % 4 = 0").select(F.col("event_id").alias("invocation_id"))


@registry.query(f"""WITH {_SPOOL} SELECT 'appended' AS fate, count(*) AS n FROM spool WHERE payload_version = 1 AND invocation_id IS NOT NULL AND tokens >= 0 AND invocation_id NOT IN (FROM held)
UNION ALL SELECT 'retained', count(*) FROM spool WHERE payload_version <> 1 OR invocation_id IS NULL OR tokens < 0""")
def spool_drain(spark: SparkSession, sf: str) -> DataFrame:
    """What a drain appends and what it keeps; bad rows stop nothing."""
    appended, retained = L.drain(*_spool(spark, sf))
    count = lambda d, f: d.agg(F.count("*").alias("n")).select(F.lit(f).alias("fate"), "n")
    return count(appended, "appended").unionAll(count(retained, "retained"))


@registry.query(f"WITH {INVOCATIONS} SELECT model, count(*) AS recorded, count(a) AS priced, count(*) - count(a) AS unpriced, count(DISTINCT trace_id) AS traces FROM priced GROUP BY model")
def invocation_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    return priced(spark, sf).groupBy("model").agg(F.count("*").alias("recorded"), F.count("a").alias("priced"), (F.count("*") - F.count("a")).alias("unpriced"), F.countDistinct("trace_id").alias("traces"))


@registry.query("""WITH a AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'user' GROUP BY conv_id), r AS (SELECT conv_id, count(*) AS n FROM conversations WHERE role = 'assistant' GROUP BY conv_id)
SELECT coalesce(a.conv_id, r.conv_id) AS conv_id, coalesce(a.n, 0) AS attempted, coalesce(r.n, 0) AS recorded, CASE WHEN coalesce(a.n, 0) > coalesce(r.n, 0) THEN 'unrecorded' WHEN coalesce(a.n, 0) < coalesce(r.n, 0) THEN 'unattempted' ELSE 'matched' END AS verdict FROM a FULL JOIN r ON a.conv_id = r.conv_id""")
def attempt_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """Calls that each conversation asked for against the answers recorded, from both sides."""
    c = table(spark, sf, "conversations")
    return L.reconciled(c.where("role = 'user'"), c.where("role = 'assistant'"), "conv_id")


_SCOPED = "scoped AS (SELECT doc_id, CASE WHEN source IN ('src0', 'src1') THEN 'excluded' ELSE 'attempted' END AS scope FROM documents WHERE lang <> 'es' UNION ALL SELECT doc_id, 'attempted' FROM labels WHERE toxic = 1)"


@registry.query(f"""WITH {_SCOPED}, k AS (SELECT doc_id AS k, min(scope) AS a, max(scope) AS b, count(*) AS n FROM scoped GROUP BY doc_id), m AS (SELECT DISTINCT doc_id AS m FROM documents),
s AS (SELECT CASE WHEN m IS NULL THEN 'unknown' WHEN n IS NULL THEN 'unscoped' WHEN a <> b OR n > 1 THEN 'contested' ELSE a END AS scope FROM m FULL JOIN k ON m = k)
SELECT scope, count(*) AS n, count(*) FILTER (WHERE scope IN ('unknown', 'unscoped', 'contested')) OVER () = 0 AS complete FROM s GROUP BY scope""".replace("count(*) FILTER (WHERE scope IN ('unknown', 'unscoped', 'contested')) OVER () = 0", "max(CAST(scope IN ('unknown', 'unscoped', 'contested') AS INTEGER)) OVER () = 0"))
def extraction_scope(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a rule by source and the labelled list put every document into one scope: some are in none, some in two."""
    d, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rule = d.where("lang <> 'es'").select("doc_id", F.when(F.col("source").isin("src0", "src1"), "excluded").otherwise("attempted").alias("scope"))
    return L.scope_proof(d, rule.unionByName(labels.where("toxic = 1").select("doc_id", F.lit("attempted").alias("scope"))), "doc_id")


# ---------------------------------------------------------------- rules

ALIASES = [("Brand#1", "brand-1"), ("Brand#2", "brand-2"), ("Brand#2", "brand-two"), ("Brand#3", "brand-3")]
RULES = [
    Q.unique("order_key_unique", "orders", "o_orderkey"),
    Q.unique("line_key_unique", "lineitem", "l_orderkey", "l_linenumber"),
    Q.present("line_has_order", "lineitem", "l_orderkey", "orders", "o_orderkey"),
    Q.present("order_has_customer", "orders", "o_custkey", "customer", "c_custkey"),
    Q.bijection("supplier_in_lines", "supplier", "s_suppkey", "lineitem", "l_suppkey"),
    Q.where("discount_in_unit", "lineitem", "l_discount < 0 or l_discount > 1"),
    Q.where("shipped_after_1995", "lineitem", "l_shipdate < timestamp '1995-02-01'"),
    Q.where("priority_format", "orders", "not (o_orderpriority rlike '^[1-5]-')"),
    Q.closed("segment_closed", "customer", "c_mktsegment", ["AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY"]),
    Q.covers("every_event_type", "events", "event_type", ["view", "click", "error", "purchase", "signup", "refund"]),
    Q.floor("five_segments", "customer", 5, "c_mktsegment"),
    Q.floor("many_parts", "part", 1_000_000_000),
    Q.one_of("alias_is_function", "aliases", "alias", "canonical"),
    Q.where("empty_population", "nothing", "true"),
    Q.recomputed("length_recomputed", "documents", "n_chars", "cast(length(text) as bigint)"),
]
_RULE_SQL = {
    "order_key_unique": ("orders", "SELECT count(*) FROM (SELECT o_orderkey FROM orders GROUP BY 1 HAVING count(*) > 1)"),
    "line_key_unique": ("lineitem", "SELECT count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)"),
    "line_has_order": ("lineitem", "SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)"),
    "order_has_customer": ("orders", "SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer)"),
    "supplier_in_lines": ("(SELECT DISTINCT s_suppkey FROM supplier UNION ALL SELECT DISTINCT l_suppkey FROM lineitem)", "SELECT (SELECT count(*) FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem)) + (SELECT count(DISTINCT l_suppkey) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier))"),
    "discount_in_unit": ("lineitem", "SELECT count(*) FROM lineitem WHERE l_discount < 0 OR l_discount > 1"),
    "shipped_after_1995": ("lineitem", "SELECT count(*) FROM lineitem WHERE l_shipdate < TIMESTAMP '1995-02-01'"),
    "priority_format": ("orders", "SELECT count(*) FROM orders WHERE NOT regexp_matches(o_orderpriority, '^[1-5]-')"),
    "segment_closed": ("customer", "SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('AUTOMOBILE', 'BUILDING', 'FURNITURE', 'HOUSEHOLD', 'MACHINERY')"),
    "every_event_type": ("events", "SELECT count(*) FROM (VALUES ('view'), ('click'), ('error'), ('purchase'), ('signup'), ('refund')) t(x) WHERE x NOT IN (SELECT event_type FROM events)"),
    "five_segments": ("customer", "SELECT CASE WHEN count(DISTINCT c_mktsegment) < 5 THEN 1 ELSE 0 END FROM customer"),
    "many_parts": ("part", "SELECT CASE WHEN count(*) < 1000000000 THEN 1 ELSE 0 END FROM part"),
    "alias_is_function": ("(VALUES (1), (2), (3), (4))", "SELECT 1"),
    "empty_population": ("(SELECT 1 WHERE false)", "SELECT 0"),
    "length_recomputed": ("documents", "SELECT count(*) FROM documents WHERE n_chars IS DISTINCT FROM length(text)"),
}


#: Rules on rows of one table, as predicates that a row breaks; both dialects read them.
ROW_RULES = {
    "customer": {"customer_key_positive": "c_custkey < 1", "customer_named": "c_name is null or trim(c_name) = ''", "customer_nation_known": "c_nationkey is null or c_nationkey not between 0 and 24", "customer_balance_bounded": "c_acctbal < -1000 or c_acctbal > 10000", "customer_segment_upper": "c_mktsegment <> upper(c_mktsegment)"},
    "supplier": {"supplier_key_positive": "s_suppkey < 1", "supplier_named": "s_name is null or trim(s_name) = ''", "supplier_nation_known": "s_nationkey is null or s_nationkey not between 0 and 24", "supplier_balance_bounded": "s_acctbal < -1000 or s_acctbal > 10000"},
    "part": {"part_key_positive": "p_partkey < 1", "part_named": "p_name is null or trim(p_name) = ''", "part_brand_format": "not regexp_like(p_brand, '^Brand#[0-9]+$')", "part_size_in_range": "p_size < 1 or p_size > 50", "part_price_positive": "p_retailprice <= 0", "part_type_closed": "p_type not in ('ECONOMY', 'LARGE', 'MEDIUM', 'PROMO', 'SMALL', 'STANDARD')"},
    "orders": {"order_key_positive": "o_orderkey < 1", "order_status_closed": "o_orderstatus not in ('F', 'O', 'P')", "order_total_positive": "o_totalprice <= 0", "order_dated": "o_orderdate is null", "order_not_before_1992": "o_orderdate < timestamp '1992-01-01'", "order_not_after_1999": "o_orderdate > timestamp '1999-12-31'", "order_priority_closed": "o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED', '5-LOW')", "order_customer_given": "o_custkey is null"},
    "lineitem": {"line_number_positive": "l_linenumber < 1", "line_number_bounded": "l_linenumber > 7", "line_quantity_positive": "l_quantity <= 0", "line_quantity_whole": "l_quantity <> floor(l_quantity)", "line_quantity_bounded": "l_quantity > 50", "line_price_positive": "l_extendedprice <= 0", "line_tax_in_unit": "l_tax < 0 or l_tax > 1", "line_tax_low": "l_tax > 0.08", "line_discount_low": "l_discount > 0.1", "line_flag_closed": "l_returnflag not in ('A', 'N', 'R')", "line_status_closed": "l_linestatus not in ('F', 'O')", "line_shipped": "l_shipdate is null", "line_part_given": "l_partkey is null", "line_supplier_given": "l_suppkey is null"},
    "events": {"event_typed": "event_type is null or event_type = ''", "event_dated": "ts is null", "event_user_positive": "user_id < 0", "event_value_finite": "value is null or isnan(value)", "event_value_bounded": "value < 0 or value > 100000", "event_props_object": "props is null or props not like '{%}'"},
    "documents": {"document_has_text": "text is null", "document_not_blank": "trim(text) = ''", "document_language_closed": "lang not in ('en', 'de', 'fr', 'es')", "document_source_given": "source is null or source = ''", "document_length_positive": "n_chars < 1"},
}
RULES += [Q.where(n, t, p) for t, own in ROW_RULES.items() for n, p in own.items()]
_RULE_SQL |= {n: (t, f"SELECT count(*) FROM {t} WHERE {p.replace('regexp_like(', 'regexp_matches(')}") for t, own in ROW_RULES.items() for n, p in own.items()}


@registry.query("SELECT rule, population, failures, CASE WHEN population = 0 OR failures > 0 THEN 'FAIL' ELSE 'PASS' END AS status FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, (SELECT count(*) FROM {t}) AS population, CAST(({q}) AS BIGINT) AS failures" for n, (t, q) in _RULE_SQL.items()) + ")")
def dq_rule_report(spark: SparkSession, sf: str) -> DataFrame:
    """All rules with their populations; an empty population fails."""
    tables = {n: table(spark, sf, n) for n in ("orders", "lineitem", "customer", "supplier", "part", "events", "documents")}
    tables |= {"aliases": spark.createDataFrame(ALIASES, "alias string, canonical string"), "nothing": spark.range(0)}
    return Q.report(RULES, tables)


# ---------------------------------------------------------------- identity

_RECORDS = """record AS (SELECT p_partkey AS record_id, CAST(p_size % 5 AS INTEGER) AS project, CASE WHEN lower(p_brand) IN ('brand#20', 'brand#21', 'brand#22') THEN 'brand#20' ELSE lower(p_brand) END AS m, upper(replace('PN-' || lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0'), '-', '')) AS part, p_name AS description, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE p_type END AS unit FROM part),
pair AS (SELECT DISTINCT a.project, a.record_id AS a, b.record_id AS b FROM record a JOIN record b ON a.project = b.project AND a.record_id < b.record_id AND (a.m = b.m OR substr(a.part, 1, 7) = substr(b.part, 1, 7))),
score AS (SELECT pair.project, a, b, round(CASE WHEN x.m = y.m THEN 1.0 ELSE 0.0 END, 6) AS s_manufacturer, round(1.0 - CAST(levenshtein(x.part, y.part) AS DOUBLE) / greatest(length(x.part), length(y.part)), 6) AS s_part_number,
  round(1.0 - CAST(levenshtein(x.description, y.description) AS DOUBLE) / greatest(length(x.description), length(y.description)), 6) AS s_description, CASE WHEN x.unit IS NULL OR y.unit IS NULL THEN 0.0 WHEN x.unit = y.unit THEN 1.0 ELSE 0.0 END AS s_unit
  FROM pair JOIN record x ON x.record_id = a JOIN record y ON y.record_id = b),
total AS (SELECT *, round(CAST(s_manufacturer AS DOUBLE) * CAST(0.3 AS DOUBLE) + s_part_number * CAST(0.4 AS DOUBLE) + s_description * CAST(0.2 AS DOUBLE) + CAST(s_unit AS DOUBLE) * CAST(0.1 AS DOUBLE), 6) AS score FROM score),
banded AS (SELECT *, CASE WHEN score > CAST(0.85 AS DOUBLE) THEN 'merge' WHEN score < CAST(0.55 AS DOUBLE) THEN 'reject' ELSE 'withhold' END AS band FROM total)"""


def records(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), (F.col("p_size") % 5).cast("int").alias("project"), F.col("p_brand").alias("manufacturer"), F.concat(F.lit("PN-"), F.lpad(F.expr("cast(p_partkey div 3 as string)"), 6, "0")).alias("part_number"), F.col("p_name").alias("description"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_type")).alias("unit"))
    aliases = spark.range(20, 23).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("alias"), F.lit("brand#20").alias("canonical"))
    return D.normalized(raw, aliases)


#: Letters of a part number that candidates share.
PREFIX = 7


def banded(spark: SparkSession, sf: str, band: str) -> DataFrame:
    """Scored candidate pairs of one band."""
    return D.scored_candidates(records(spark, sf), band, prefix=PREFIX)


def band_counts(spark: SparkSession, sf: str, **cutoffs: float) -> DataFrame:
    """Numbers of candidate pairs by project, scores and band."""
    return D.score_counts(records(spark, sf), prefix=PREFIX, **cutoffs)


@registry.query(f"WITH {_RECORDS} SELECT project, band, count(*) AS n, round(avg(score), 6) AS mean_score FROM banded GROUP BY project, band")
def identity_bands(spark: SparkSession, sf: str) -> DataFrame:
    """Candidate pairs by decision band."""
    return band_counts(spark, sf).groupBy("project", "band").agg(F.sum("n").alias("n"), F.round(F.sum(F.col("score") * F.col("n")) / F.sum("n"), 6).alias("mean_score"))


@registry.query(f"WITH {_RECORDS} SELECT project, a, b, round(score, 6) AS score FROM banded WHERE band = 'withhold'")
def identity_review_items(spark: SparkSession, sf: str) -> DataFrame:
    """One review item for each withheld pair."""
    return banded(spark, sf, "withhold").select("project", "a", "b", F.round("score", 6).alias("score"))


@registry.query()
def identity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters all of whose pairs merge; the greedy clique has no SQL form, a test checks that every induced pair merges."""
    return D.clusters(banded(spark, sf, "merge").select("a", "b", "score"))


@registry.query(f"""WITH {_RECORDS}, truth AS (SELECT x.record_id AS a, y.record_id AS b FROM record x JOIN record y ON x.project = y.project AND x.record_id < y.record_id AND x.m = y.m AND x.part = y.part),
c AS (SELECT (SELECT count(*) FROM banded WHERE band = 'merge') AS merged, (SELECT count(*) FROM banded JOIN truth USING (a, b) WHERE band = 'merge') AS correct, (SELECT count(*) FROM truth) AS true_pairs, (SELECT count(*) FROM pair) AS candidates, (SELECT count(*) FROM pair JOIN truth USING (a, b)) AS found, (SELECT CAST(sum(n * (n - 1) / 2) AS DOUBLE) FROM (SELECT count(*) AS n FROM record GROUP BY project)) AS possible)
SELECT merged, correct, true_pairs, candidates, found / true_pairs AS pair_completeness, round(1 - candidates / possible, 9) AS reduction_ratio, correct / true_pairs AS recall FROM c""")
def identity_quality(spark: SparkSession, sf: str) -> DataFrame:
    """Blocking and merging against exact matches on manufacturer and part number."""
    own, pairs = records(spark, sf), band_counts(spark, sf)
    count = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    is_merge, is_true = F.col("band") == "merge", F.col("exact") & (F.col("s_manufacturer") == 1)
    two = F.coalesce(F.sum(F.col("n") * (F.col("n") - 1)), F.lit(0))
    known = own.where("norm_manufacturer is not null and norm_part is not null").groupBy("project", "norm_manufacturer", "norm_part").agg(F.count("*").alias("n"))
    true = known.agg((two / 2).cast("long").alias("true_pairs"))
    out = pairs.agg(count(is_merge).alias("merged"), count(is_merge & is_true).alias("correct"), count(F.lit(True)).alias("candidates"), count(is_true).alias("found")).crossJoin(true)
    possible = own.groupBy("project").agg(F.count("*").alias("n")).agg(F.sum(F.col("n") * (F.col("n") - 1) / 2).alias("possible"))
    return out.crossJoin(possible).select("merged", "correct", "true_pairs", "candidates", (F.col("found") / F.col("true_pairs")).alias("pair_completeness"), F.round(1 - F.col("candidates") / F.col("possible"), 9).alias("reduction_ratio"), (F.col("correct") / F.col("true_pairs")).alias("recall"))


# ---------------------------------------------------------------- line detail


@registry.query(f"""WITH {LINES}, e AS (SELECT line_id, po_number FROM line WHERE line_number <= 3), m AS (SELECT DISTINCT po_number FROM line WHERE po_number % 3 = 0)
SELECT state, count(*) AS n FROM (SELECT CASE WHEN e.line_id IS NULL THEN 'no_entity' WHEN m.po_number IS NULL THEN 'entity_without_documents' ELSE 'linked' END AS state FROM line LEFT JOIN e USING (line_id) LEFT JOIN m ON m.po_number = e.po_number) GROUP BY state""")
def line_identity_states(spark: SparkSession, sf: str) -> DataFrame:
    own = materialize(lines(spark, sf).select("line_id", "po_number", "line_number"), "identity-lines")
    entities = own.where("line_number <= 3").select("line_id", F.col("po_number").alias("entity_id"))
    members = own.where("po_number % 3 = 0").select(F.col("po_number").alias("entity_id"))
    return V.identity_state(own, entities, members).groupBy("state").agg(F.count("*").alias("n"))


@registry.query("""WITH r AS (SELECT doc_id AS document_id, 1 + doc_id % 2 AS page, CASE WHEN doc_id % 5 = 0 THEN 'not on the page' ELSE substr(text, 3, 12) END AS span FROM documents), p AS (SELECT doc_id AS document_id, 1 AS page, text AS body FROM documents)
SELECT count(*) AS records, count(body) AS resolved, count(*) FILTER (WHERE contains(body, span)) AS on_page FROM r LEFT JOIN p USING (document_id, page)""")
def citation_census(spark: SparkSession, sf: str) -> DataFrame:
    """Records whose page resolves, and whose span is printed there."""
    d = table(spark, sf, "documents")
    recs = d.select(F.col("doc_id").alias("document_id"), (1 + F.col("doc_id") % 2).cast("int").alias("page"), F.when(F.col("doc_id") % 5 == 0, "not on the page").otherwise(F.substring("text", 3, 12)).alias("span"))
    pages = d.select(F.col("doc_id").alias("document_id"), F.lit(1).alias("page"), F.col("text").alias("body"))
    return V.citation_census(recs, pages)


@registry.query(f"""WITH {EVENTS}, s AS (SELECT user_id, count(*) FILTER (WHERE to_state = 'error') AS derived, CASE WHEN user_id % 6 = 0 THEN -1 ELSE count(*) FILTER (WHERE to_state = 'error') END AS fitted FROM log GROUP BY user_id)
SELECT user_id, coalesce(CASE WHEN fitted = derived THEN fitted END, -1) AS shown, CASE WHEN fitted = derived THEN 'agrees' ELSE 'withheld' END AS covariate_state FROM s""")
def covariate_reconciliation(spark: SparkSession, sf: str) -> DataFrame:
    """A covariate is shown only if it is the one the fit used."""
    s = events(spark, sf).groupBy("user_id").agg(F.sum((F.col("to_state") == "error").cast("long")).alias("derived")).withColumn("fitted", F.when(F.col("user_id") % 6 == 0, F.lit(-1).cast("long")).otherwise(F.col("derived")))
    return V.reconciled(s, "fitted", "derived").select("user_id", F.coalesce("shown", F.lit(-1).cast("long")).alias("shown"), "covariate_state")


_ALLOTTED = 1_000


@registry.query(f"""WITH c AS (SELECT c_nationkey AS stratum, count(*) AS w FROM customer GROUP BY c_nationkey), t AS (SELECT *, CAST(sum(w) OVER () AS BIGINT) AS declared FROM c), l AS (SELECT *, greatest(1, w * {_ALLOTTED} // declared) AS low FROM t),
o AS (SELECT *, row_number() OVER (ORDER BY w * {_ALLOTTED} % declared DESC, stratum) AS r, {_ALLOTTED} - sum(low) OVER () AS missing FROM l)
SELECT stratum, CAST(low + CASE WHEN r <= missing THEN 1 ELSE 0 END AS BIGINT) AS allotted FROM o""")
def largest_remainder(spark: SparkSession, sf: str) -> DataFrame:
    """A sample of a thousand customers dealt to the nations by their numbers of customers."""
    counts = table(spark, sf, "customer").groupBy(F.col("c_nationkey").alias("stratum")).agg(F.count("*").alias("w"))
    return L.apportioned(counts, stratum="stratum", weight="w", total=_ALLOTTED)


@registry.query("""WITH o AS (SELECT o_orderkey, c_mktsegment AS project, CAST(o_orderdate AS DATE) AS ordered FROM orders JOIN customer ON c_custkey = o_custkey), f AS (SELECT project, min(ordered) AS first_order FROM o GROUP BY project),
s AS (SELECT project, CAST(l_shipdate AS DATE) AS shipped, count(*) AS n FROM lineitem JOIN o ON o_orderkey = l_orderkey GROUP BY ALL)
SELECT project, first_order, CAST(sum(n) AS BIGINT) AS n, CAST(coalesce(sum(n) FILTER (WHERE shipped < first_order), 0) AS BIGINT) AS early FROM s JOIN f USING (project) GROUP BY ALL""")
def no_lines_before_the_first_order(spark: SparkSession, sf: str) -> DataFrame:
    """Each project's first order, its shipments as they are stored, and how many of them are dated before that order.

    Shipments are folded to a count for each project and day before they meet the first orders.
    """
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("project"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", F.to_date("o_orderdate").alias("ordered")).join(customers, "o_custkey")
    shipped = table(spark, sf, "lineitem").select("l_orderkey", F.to_date("l_shipdate").alias("shipped")).join(orders, "l_orderkey").groupBy("project", "shipped").agg(F.count("*").alias("n"))
    first = orders.groupBy("project").agg(F.min("ordered").alias("first_order"))
    early = F.sum(F.when(F.col("shipped") < F.col("first_order"), F.col("n")).otherwise(0))
    return shipped.join(first, "project").groupBy("project", "first_order").agg(F.sum("n").alias("n"), early.alias("early"))


@registry.query(f"WITH {LINES} SELECT vendor, 1 - 3 / count(*) AS rule_of_three FROM line WHERE is_closed GROUP BY vendor")
def precision_lower_bounds(spark: SparkSession, sf: str) -> DataFrame:
    """Lower bound of a precision without errors, by vendor as merged counts."""
    c = lines(spark, sf).where("is_closed").groupBy("vendor").agg(F.count("*").alias("n"))
    return c.select("vendor", stats.precision_floor(F.col("n"), F.col("n")).alias("rule_of_three"))


@registry.query(f"""WITH {EVENTS}, sessions AS (SELECT user_id, ts, sum(CASE WHEN prior IS NULL OR ts - prior > INTERVAL 1 DAY THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY seq) AS s FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY seq) AS prior FROM log))
SELECT user_id, CAST(s AS BIGINT) AS session_no, count(*) AS n, min(ts) AS started, max(ts) AS ended FROM sessions GROUP BY user_id, s""")
def event_sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Runs of events no more than a day apart."""
    from pyspark.sql import Window

    own = Window.partitionBy("user_id").orderBy("seq")
    gap = F.lag("ts").over(own)
    new = gap.isNull() | (F.col("ts") > gap + F.expr("interval 1 day"))
    marked = events(spark, sf).withColumn("new", new.cast("long")).withColumn("session_no", F.sum("new").over(own))
    return marked.groupBy("user_id", "session_no").agg(F.count("*").alias("n"), F.min("ts").alias("started"), F.max("ts").alias("ended"))

"""What a service reads back: projections in rank order, active generations, payloads, promotions, identity figures."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats
from wharfline.operators import identity as D
from wharfline.operators import linedetail as V
from wharfline.operators.ordinals import numbered, sealed
from wharfline.session import table
from wharfline.shared import checked_broadcast

from .frames import AS_OF, LINES, POSTERIORS, lines, posteriors, sealed_sql
from .ledger import _RECORDS, band_counts
from .registry import Registry
from .worklist import SCORED, SCORED_WITH_GAPS, scored, scored_with_gaps

registry = Registry()
#: Chunks of documents in two generations, of which one is active for each document.
_GEN = """chunk AS (SELECT l_orderkey * 10 + l_linenumber AS chunk_id, l_orderkey AS document_id, l_linenumber AS ordinal, min(l_suppkey % 5) AS page, min(l_partkey) AS part, 1 + l_orderkey % 2 AS generation FROM lineitem GROUP BY l_orderkey, l_linenumber),
document AS (SELECT o_orderkey AS document_id, o_orderpriority AS title, o_custkey FROM orders), association AS (SELECT o_orderkey AS document_id, o_custkey % 3 AS project FROM orders WHERE o_orderkey % 7 <> 2),
active AS (SELECT o_orderkey AS document_id, 1 + o_orderkey % 3 % 2 AS generation FROM orders)"""


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("ordinal")).agg(F.min(F.col("l_suppkey") % 5).alias("page"), F.min("l_partkey").alias("part"))
    return c.select((F.col("document_id") * 10 + F.col("ordinal")).alias("chunk_id"), "document_id", "ordinal", "page", "part", (1 + F.col("document_id") % 2).alias("generation"))


def active(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("document_id"), (1 + F.col("o_orderkey") % 3 % 2).alias("generation"))


@registry.query(f"WITH {_GEN} SELECT chunk_id, document_id, title, project, page FROM chunk JOIN document USING (document_id) JOIN association USING (document_id) JOIN active USING (document_id, generation)")
def active_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks with their document and association, through the active generation only."""
    o = table(spark, sf, "orders")
    document = o.select(F.col("o_orderkey").alias("document_id"), F.col("o_orderpriority").alias("title"))
    association = o.where("o_orderkey % 7 <> 2").select(F.col("o_orderkey").alias("document_id"), (F.col("o_custkey") % 3).alias("project"))
    return chunks(spark, sf).join(active(spark, sf), ["document_id", "generation"]).join(document, "document_id").join(association, "document_id").select("chunk_id", "document_id", "title", "project", "page")


@registry.query(f"WITH {_GEN} SELECT generation, count(*) AS n, count(DISTINCT document_id) AS documents FROM chunk JOIN active USING (document_id, generation) GROUP BY generation")
def active_generation_view(spark: SparkSession, sf: str) -> DataFrame:
    """What is in force of each generation."""
    live = chunks(spark, sf).join(active(spark, sf), ["document_id", "generation"])
    return live.groupBy("generation").agg(F.count("*").alias("n"), F.countDistinct("document_id").alias("documents"))


@registry.query(f"WITH {_GEN} SELECT 'part-' || part AS value, document_id, page + 1 AS page, ordinal AS span_start, round(CAST(1.0 AS DOUBLE) - page / 10, 9) AS confidence FROM chunk JOIN active USING (document_id, generation)")
def linked_records(spark: SparkSession, sf: str) -> DataFrame:
    """A line's records with document, page, span and confidence, through the active generation only."""
    c = chunks(spark, sf)
    values = c.select(F.concat(F.lit("part-"), F.col("part").cast("string")).alias("value"), "document_id", (F.col("page") + 1).alias("page"), F.col("ordinal").alias("span_start"), F.round(1.0 - F.col("page") / 10, 9).alias("confidence"), "generation")
    return V.linked_records(values, c.select("document_id", "generation").distinct(), active(spark, sf)).drop("generation")


#: Ids as a caller ordered them: the chunks of every hundredth document, by a stir of their numbers.
_ASKED = "asked AS (SELECT chunk_id, row_number() OVER (ORDER BY chunk_id * 7919 % 10007, chunk_id) AS position FROM chunk WHERE document_id % 100 = 0)"


def asked(spark: SparkSession, sf: str) -> DataFrame:
    """(chunk_id, position) of a caller's list, as long as it may be."""
    few = chunks(spark, sf).where("document_id % 100 = 0").select("chunk_id", (F.col("chunk_id") * 7919 % 10007).alias("k"))
    return numbered(few, "k", "chunk_id").select("chunk_id", "position")


@registry.query(f"WITH {_GEN}, {_ASKED} SELECT position, chunk_id, document_id, page + 1 AS page, ordinal, generation FROM asked JOIN chunk USING (chunk_id)")
def citable_projection(spark: SparkSession, sf: str) -> DataFrame:
    """The six columns that a result may cite, in the order the caller asked for."""
    return chunks(spark, sf).join(checked_broadcast(asked(spark, sf)), "chunk_id").select("position", "chunk_id", "document_id", (F.col("page") + 1).alias("page"), "ordinal", "generation")


@registry.query(f"""WITH {_GEN}, {_ASKED}, d AS (SELECT chunk_id, row_number() OVER (ORDER BY part, chunk_id) AS d FROM chunk WHERE document_id % 100 < 2)
SELECT chunk_id, coalesce(position, 0) AS l, coalesce(d, 0) AS d, round(coalesce(CAST(1 AS DOUBLE) / (60 + position), 0) + coalesce(CAST(1 AS DOUBLE) / (60 + d), 0), 12) AS score FROM asked FULL JOIN d USING (chunk_id)""")
def fused_on_ordinals(spark: SparkSession, sf: str) -> DataFrame:
    """Two ordered lists fused by the places of their members: every member of either."""
    left = asked(spark, sf).select("chunk_id", F.col("position").alias("l"))
    right = numbered(chunks(spark, sf).where("document_id % 100 < 2").select("part", "chunk_id"), "part", "chunk_id", name="d").select("chunk_id", "d")
    both = left.join(right, "chunk_id", "full")
    return both.select("chunk_id", F.coalesce("l", F.lit(0)).alias("l"), F.coalesce("d", F.lit(0)).alias("d"), F.round(stats.rrf_term(F.col("l")) + stats.rrf_term(F.col("d")), 12).alias("score"))


@registry.query("WITH e AS (SELECT DISTINCT abs(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) - 1) < 1e-3 AS unit, len(embedding) AS width FROM embeddings) SELECT count(*) AS pairs, count(*) = 1 AS unique_pair FROM (FROM e LIMIT 2)")
def distinct_encoder_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Whether all vectors come from one encoder, by what tells encoders apart in the vectors (width, unit length or not): two distinct pairs are enough to refuse."""
    square = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    e = table(spark, sf, "embeddings").select((F.abs(square - 1) < 1e-3).alias("unit"), F.size("embedding").alias("width")).distinct().limit(2)
    return e.agg(F.count("*").alias("pairs"), (F.count("*") == 1).alias("unique_pair"))


@registry.query(f"""WITH {SCORED} SELECT line_id, '{{"line":"' || line_id || '","state":"' || state || '","p50":' || coalesce(CAST(p50 AS VARCHAR), 'null') || ',"p80":' || coalesce(CAST(p80 AS VARCHAR), 'null') || '}}' AS body FROM figures""")
def worklist_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """Each open line's median and 80th day as the JSON that a response carries."""
    body = F.to_json(F.struct(F.col("line_id").alias("line"), "state", "p50", "p80"), {"ignoreNullFields": "false"})
    return scored(spark, sf).select("line_id", body.alias("body"))


@registry.query(f"WITH {SCORED_WITH_GAPS} SELECT row_number() OVER (ORDER BY need_by, line_id) AS rank, line_id, need_by FROM figures WHERE NOT is_ranked ORDER BY need_by, line_id LIMIT 100")
def excluded_in_order(spark: SparkSession, sf: str) -> DataFrame:
    """The first hundred lines without figures, those of vendors not covered among them, by need-by date and id, as a page shows them."""
    few = scored_with_gaps(spark, sf).where("not is_ranked").select("line_id", "need_by").orderBy("need_by", "line_id").limit(100)
    return few.withColumn("rank", F.row_number().over(Window.orderBy("need_by", "line_id")))


@registry.query(f"WITH {LINES}, k AS (SELECT po_number, count(DISTINCT (project, order_date, criticality)) AS n FROM line GROUP BY po_number) SELECT n AS constants, count(*) AS orders, n = 1 AS one_row FROM k GROUP BY n")
def run_shape(spark: SparkSession, sf: str) -> DataFrame:
    """What an order's lines share must be one row: orders by the number of distinct rows of it."""
    k = lines(spark, sf).groupBy("po_number").agg(F.count_distinct("project", "order_date", "criticality").alias("constants"))
    return k.groupBy("constants").agg(F.count("*").alias("orders")).withColumn("one_row", F.col("constants") == 1)


@registry.query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_orderdate END AS closed_at, CASE WHEN o_totalprice > 200000 THEN 'large' WHEN o_totalprice > 50000 THEN 'medium' ELSE 'small' END AS size_class, o_orderstatus = 'F' AS is_final FROM orders")
def generated_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Columns that follow from others of their row."""
    return table(spark, sf, "orders").select("o_orderkey", F.expr("case o_orderstatus when 'F' then o_orderdate end").alias("closed_at"), F.expr("case when o_totalprice > 200000 then 'large' when o_totalprice > 50000 then 'medium' else 'small' end").alias("size_class"), (F.col("o_orderstatus") == "F").alias("is_final"))


@registry.query(f"""WITH {_GEN}, old AS (SELECT chunk.* FROM chunk JOIN active USING (document_id) WHERE chunk.generation <> active.generation), keep AS (SELECT chunk.* FROM chunk JOIN active USING (document_id, generation))
SELECT step, 'chunk' AS level, n FROM (SELECT 1 AS step, count(*) AS n FROM old) UNION ALL SELECT 2, 'page', count(*) FROM (SELECT DISTINCT document_id, page FROM old) WHERE (document_id, page) NOT IN (SELECT document_id, page FROM keep) UNION ALL SELECT 3, 'document', count(*) FROM (SELECT DISTINCT document_id FROM old WHERE document_id NOT IN (SELECT document_id FROM keep))""")
def promotion_plan(spark: SparkSession, sf: str) -> DataFrame:
    """What a promotion removes, leaves first: chunks of generations not in force, then pages and documents that nothing else holds."""
    c, a = chunks(spark, sf), active(spark, sf)
    keep = c.join(a, ["document_id", "generation"], "left_semi")
    old = c.join(a.select("document_id"), "document_id", "left_semi").join(a, ["document_id", "generation"], "left_anti")
    count = lambda d, i, level: d.agg(F.count("*").alias("n")).select(F.lit(i).alias("step"), F.lit(level).alias("level"), "n")
    pages = old.select("document_id", "page").distinct().join(keep.select("document_id", "page"), ["document_id", "page"], "left_anti")
    documents = old.select("document_id").distinct().join(keep.select("document_id"), "document_id", "left_anti")
    return count(old, 1, "chunk").unionByName(count(pages, 2, "page")).unionByName(count(documents, 3, "document"))


@registry.query("SELECT l.l_orderkey AS po, l.l_linenumber AS n, max(l.l_quantity) AS quantity FROM lineitem l WHERE (l.l_orderkey, l.l_linenumber) NOT IN (SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_suppkey % 3 = 1) GROUP BY l.l_orderkey, l.l_linenumber")
def unseen_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Lines whose composite key the held side lacks."""
    i = table(spark, sf, "lineitem")
    key = [F.col("l_orderkey").alias("po"), F.col("l_linenumber").alias("n")]
    held = i.where("l_suppkey % 3 = 1").select(*key)
    return i.select(*key, "l_quantity").join(held, ["po", "n"], "left_anti").groupBy("po", "n").agg(F.max("l_quantity").alias("quantity"))


@registry.query(f"WITH {LINES}, o AS (SELECT vendor, count(*) AS n, count(*) FILTER (WHERE NOT is_closed) AS open_lines FROM line GROUP BY vendor) SELECT count(*) AS vendors, count(*) FILTER (WHERE open_lines > 0) AS occupied, min(n) AS least, round(avg(open_lines / n), 9) AS mean_share FROM o")
def occupancy_floors(spark: SparkSession, sf: str) -> DataFrame:
    """How many vendors hold open lines, the fewest lines of one, and the mean share still open."""
    o = lines(spark, sf).groupBy("vendor").agg(F.count("*").alias("n"), F.count_if(~F.col("is_closed")).alias("open_lines"))
    return o.agg(F.count("*").alias("vendors"), F.count_if(F.col("open_lines") > 0).alias("occupied"), F.min("n").alias("least"), F.round(F.avg(F.col("open_lines") / F.col("n")), 9).alias("mean_share"))


@registry.query(f"WITH {POSTERIORS} SELECT vendor, draws[50] AS median_day, draws[80] AS p80_day, 50 AS reached, 100 - 50 AS beyond FROM posterior")
def duration_payloads(spark: SparkSession, sf: str) -> DataFrame:
    """A vendor's median and 80th day with the percent that reaches the median and its complement."""
    d = F.col("draws")
    out = posteriors(spark, sf).select("vendor", arrays.nearest_rank(d, 0.5).cast("long").alias("median_day"), arrays.nearest_rank(d, 0.8).cast("long").alias("p80_day"))
    return out.select("vendor", "median_day", "p80_day", F.lit(50).alias("reached"), (100 - F.lit(50)).alias("beyond"))


@registry.query("""WITH v AS (SELECT vec_id, label, embedding, list_transform(embedding, lambda x: round(CAST(x AS DOUBLE), 2)) AS other FROM embeddings),
c AS (SELECT label, list_sum(list_transform(list_zip(embedding, other), lambda p: CAST(p[1] AS DOUBLE) * p[2])) / (sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) * sqrt(list_sum(list_transform(other, lambda x: x * x)))) AS cosine, list_max(list_transform(list_zip(embedding, other), lambda p: abs(CAST(p[1] AS DOUBLE) - p[2]))) AS gap FROM v)
SELECT label, round(min(cosine), 6) AS least_cosine, round(max(gap), 6) AS worst_gap, min(cosine) >= 0.99 AND max(gap) <= 0.0051 AS agrees FROM c GROUP BY label""")
def encoder_agreement(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors against a coarser encoder's (two places here): least cosine and greatest difference, within their bounds or not."""
    e = F.col("embedding")
    v = table(spark, sf, "embeddings").withColumn("other", F.transform(e, lambda x: F.round(x.cast("double"), 2)))
    o = F.col("other")
    c = v.select("label", (1.0 - arrays.cosine_distance(e, o)).alias("cosine"), F.array_max(F.zip_with(e, o, lambda a, b: F.abs(a.cast("double") - b))).alias("gap"))
    return c.groupBy("label").agg(F.round(F.min("cosine"), 6).alias("least_cosine"), F.round(F.max("gap"), 6).alias("worst_gap"), ((F.min("cosine") >= 0.99) & (F.max("gap") <= 0.0051)).alias("agrees"))


# ---------------------------------------------------------------- identity

_UNITS = [("mm", "length", 0.001), ("cm", "length", 0.01), ("m", "length", 1.0), ("kg", "mass", 1.0), ("g", "mass", 0.001)]
_U = ", ".join(f"('{u}', '{d}', CAST({f} AS DOUBLE))" for u, d, f in _UNITS)
_UNIT_OF = "['mm', 'cm', 'm', 'kg', 'g', 'each', 'lot'][CAST(p_partkey % 7 AS INTEGER) + 1]"


@registry.query(f"WITH u AS (SELECT * FROM (VALUES {_U}) AS t(unit, dimension, factor)), r AS (SELECT p_partkey, {_UNIT_OF} AS unit, CAST(p_size AS DOUBLE) AS amount FROM part) SELECT p_partkey, coalesce(dimension, r.unit) AS dimension, round(amount * coalesce(factor, 1), 9) AS base_amount, dimension IS NOT NULL AS convertible FROM r LEFT JOIN u ON u.unit = r.unit")
def base_units(spark: SparkSession, sf: str) -> DataFrame:
    """Amounts in the base unit of their dimension; each and lot are compared for equality only."""
    names = F.array(*map(F.lit, ("mm", "cm", "m", "kg", "g", "each", "lot")))
    r = table(spark, sf, "part").select("p_partkey", F.element_at(names, (F.col("p_partkey") % 7 + 1).cast("int")).alias("unit"), F.col("p_size").cast("double").alias("amount"))
    u = spark.createDataFrame(_UNITS, "unit string, dimension string, factor double")
    out = r.join(F.broadcast(u), "unit", "left")
    return out.select("p_partkey", F.coalesce("dimension", "unit").alias("dimension"), F.round(F.col("amount") * F.coalesce("factor", F.lit(1.0)), 9).alias("base_amount"), F.col("dimension").isNotNull().alias("convertible"))


_BRANDS = ("alias AS (SELECT 'brand#' || i AS alias, 'maker ' || (i // 2) AS canonical FROM (SELECT unnest(range(11, 30)) AS i)), raw AS (SELECT p_partkey AS record_id, lower(p_brand) AS m, upper(replace('pn-' || lpad(CAST(p_partkey // 3 AS VARCHAR), 6, '0'), '-', '')) AS part FROM part), norm AS (SELECT record_id, coalesce(canonical, m) AS m, canonical IS NOT NULL AS matched, part FROM raw LEFT JOIN alias ON alias = m)")


def aliased(spark: SparkSession, sf: str) -> DataFrame:
    raw = table(spark, sf, "part").select(F.col("p_partkey").alias("record_id"), F.col("p_brand").alias("manufacturer"), F.concat(F.lit("PN-"), F.lpad(F.expr("cast(p_partkey div 3 as string)"), 6, "0")).alias("part_number"))
    names = spark.range(11, 30).select(F.concat(F.lit("Brand#"), F.col("id").cast("string")).alias("alias"), F.concat(F.lit("maker "), F.expr("cast(id div 2 as string)")).alias("canonical"))
    return D.normalized(raw, names)


@registry.query(f"WITH {_BRANDS} SELECT m AS manufacturer, matched, count(*) AS n FROM norm GROUP BY m, matched")
def resolved_names(spark: SparkSession, sf: str) -> DataFrame:
    """Printed names under their canonical form, and those that no alias matches, recorded as they are."""
    return aliased(spark, sf).groupBy(F.col("norm_manufacturer").alias("manufacturer"), F.col("matched_alias").alias("matched")).agg(F.count("*").alias("n"))


@registry.query(f"WITH {_BRANDS}, neg AS (SELECT record_id AS a, record_id + 1 AS b FROM raw WHERE record_id % 5 = 0) SELECT a, b, x.part AS part FROM neg JOIN norm x ON x.record_id = a JOIN norm y ON y.record_id = b WHERE x.m = y.m AND x.part = y.part")
def key_collisions(spark: SparkSession, sf: str) -> DataFrame:
    """Records known to be distinct that share a normalised key: what the guard refuses."""
    n = aliased(spark, sf).select("record_id", "norm_manufacturer", "norm_part")
    pairs = n.where("record_id % 5 = 0").select(F.col("record_id").alias("a"), (F.col("record_id") + 1).alias("b"))
    side = lambda s: n.select(F.col("record_id").alias(s), F.col("norm_manufacturer").alias(f"{s}m"), F.col("norm_part").alias(f"{s}p"))
    return pairs.join(side("a"), "a").join(side("b"), "b").where("am = bm and ap = bp").select("a", "b", F.col("ap").alias("part"))


@registry.query(f"""WITH own AS (SELECT p_size % 2 AS stratum, lpad(CAST(p_partkey AS VARCHAR), 9, '0') AS k FROM part)
SELECT stratum, CASE WHEN stratum = 1 THEN 'diverged' ELSE 'frozen' END AS status, digest AS now FROM ({sealed_sql('own', 'stratum', 'k')})""")
def frozen_calibration(spark: SparkSession, sf: str) -> DataFrame:
    """The labelled strata that thresholds were set on, by digest; one that has changed refuses the run (one has lost a record here)."""
    labelled = table(spark, sf, "part").select((F.col("p_size") % 2).alias("stratum"), F.lpad(F.col("p_partkey").cast("string"), 9, "0").alias("k"))
    now = sealed(labelled, group="stratum", text="k").select("stratum", F.col("digest").alias("now"))
    held = sealed(labelled.where("not (stratum = 1 and k like '%7')"), group="stratum", text="k").select("stratum", F.col("digest").alias("held"))
    return now.join(held, "stratum").select("stratum", F.when(F.col("now") == F.col("held"), "frozen").otherwise("diverged").alias("status"), "now")


@registry.query(f"WITH {_RECORDS} SELECT count(*) AS candidates, 0 AS merged, count(*) FILTER (WHERE score >= CAST(0.3 AS DOUBLE)) AS withheld FROM total")
def all_withheld_run(spark: SparkSession, sf: str) -> DataFrame:
    """A run whose cutoffs merge nothing completes, with all its candidates withheld or rejected."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return band_counts(spark, sf, merge=2.0, reject=0.3).agg(n(F.lit(True)).alias("candidates"), n(F.col("band") == "merge").cast("int").alias("merged"), n(F.col("band") == "withhold").alias("withheld"))


@registry.query(f"""WITH {_RECORDS}, c AS (SELECT project, count(*) AS candidates, count(*) FILTER (WHERE band = 'merge') AS merged, count(*) FILTER (WHERE band <> 'withhold') AS decided FROM banded GROUP BY project)
SELECT project, candidates, merged, decided, decided / candidates AS coverage, CASE WHEN merged = 0 THEN 'undefined' ELSE 'estimate' END AS precision_class, 'census' AS coverage_class FROM c""")
def identity_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Coverage beside precision: what is decided is a census, a precision an estimate, or undefined without merges."""
    n = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    c = band_counts(spark, sf).groupBy("project").agg(n(F.lit(True)).alias("candidates"), n(F.col("band") == "merge").alias("merged"), n(F.col("band") != "withhold").alias("decided"))
    return c.select("project", "candidates", "merged", "decided", (F.col("decided") / F.col("candidates")).alias("coverage"), F.when(F.col("merged") == 0, "undefined").otherwise("estimate").alias("precision_class"), F.lit("census").alias("coverage_class"))


@registry.query("""WITH a AS (SELECT p_brand AS concept, p_type AS label, CASE WHEN row_number() OVER (PARTITION BY p_brand ORDER BY count(*) DESC, p_type) = 1 THEN 'preferred' WHEN count(*) > 1 THEN 'alternate' ELSE 'hidden' END AS class FROM part GROUP BY p_brand, p_type)
SELECT concept, count(*) FILTER (WHERE class = 'preferred') AS preferred, count(*) FILTER (WHERE class = 'alternate') AS alternate, count(*) FILTER (WHERE class = 'hidden') AS hidden FROM a GROUP BY concept""")
def alias_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Labels of each concept as preferred (the commonest), alternate or hidden (seen once)."""
    counts = table(spark, sf, "part").groupBy(F.col("p_brand").alias("concept"), F.col("p_type").alias("label")).agg(F.count("*").alias("n"))
    first = F.row_number().over(Window.partitionBy("concept").orderBy(F.desc("n"), "label")) == 1
    c = counts.select("concept", F.when(first, "preferred").when(F.col("n") > 1, "alternate").otherwise("hidden").alias("class"))
    return c.groupBy("concept").agg(*(F.count_if(F.col("class") == x).alias(x) for x in ("preferred", "alternate", "hidden")))

"""Ingestion queries: documents as pages, order lines printed as labelled text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions import stats, text
from wharfline.operators import ingestion as I
from wharfline.session import table
from wharfline.shared import dealt

from .registry import Registry

registry = Registry()


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body"), "lang", "source")


@registry.query()
def structure_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents within the piece budget; greedy packing has no SQL form, a test checks it by brute force."""
    return I.chunked(documents(spark, sf)).select("document_id", "ordinal", "pieces", "boundary", F.md5("body").alias("body_md5"))


_UNITS = "unit AS (SELECT lang, len(list_filter(regexp_split_to_array(line, '[ ]+'), lambda w: w <> '')) AS pieces FROM (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '')"
_SHARES = (0.5, 0.75, 0.9, 0.95, 0.99)


@registry.query(f"""WITH {_UNITS} SELECT coalesce(lang, 'all') AS layer, count(*) AS n, max(pieces) AS longest, {', '.join(f'quantile_disc(pieces, {p}) AS q{round(100 * p)}' for p in _SHARES)} FROM unit GROUP BY GROUPING SETS ((lang), ())""")
def unit_length_percentiles(spark: SparkSession, sf: str) -> DataFrame:
    """Pieces of the text units by layer and pooled, with nearest-rank percentiles."""
    lines = documents(spark, sf).select("lang", F.explode(F.split("body", "\n")).alias("line")).where(F.trim("line") != "")
    units = lines.select("lang", F.size(F.filter(F.split("line", "[ ]+"), lambda w: w != "")).cast("long").alias("pieces"))
    quantiles = ", ".join(f"CAST(percentile_disc({p}) WITHIN GROUP (ORDER BY pieces) AS bigint) AS q{round(100 * p)}" for p in _SHARES)
    return spark.sql(f"SELECT coalesce(lang, 'all') AS layer, count(*) AS n, max(pieces) AS longest, {quantiles} FROM {{units}} GROUP BY GROUPING SETS ((lang), ())", units=units)


#: Order lines printed as labelled text; two layouts, one of them with the value on the next line.
PRINTED = """src AS (SELECT l_orderkey AS document_id, l_linenumber, min(l_quantity) AS q, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
raw AS (SELECT document_id, l_linenumber, unnest([
  'Item: ' || l_linenumber, 'MAKER: Brand#' || p % 25, CASE WHEN p % 2 = 0 THEN 'Qty:' ELSE 'Qty: ' || CAST(q AS INTEGER) END, CASE WHEN p % 2 = 0 THEN CAST(CAST(q AS INTEGER) AS VARCHAR) ELSE 'Note without meaning' END,
  'PRJ | Page ' || l_linenumber || ' of 7', 'Unknown label: x']) AS line, unnest([1, 2, 3, 4, 5, 6]) AS k FROM src),
line AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY l_linenumber, k) AS line_no, line FROM raw WHERE NOT regexp_matches(line, '\\|\\s*Page\\s+\\d+\\s+of\\s+\\d+\\s*$'))"""


def printed(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, body): the printed order lines.

    Order lines are dealt by order once, in shares of a bounded number of rows; all that follows by document stays in them.
    """
    items = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_partkey"), "l_orderkey").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("p"))
    no, q, even = F.col("l_linenumber").cast("string"), F.col("q").cast("string"), F.col("p") % 2 == 0
    block = F.array_join(
        F.array(
            F.concat(F.lit("Item: "), no), F.concat(F.lit("MAKER: Brand#"), (F.col("p") % 25).cast("string")), F.when(even, "Qty:").otherwise(F.concat(F.lit("Qty: "), q)),
            F.when(even, q).otherwise("Note without meaning"), F.concat(F.lit("PRJ | Page "), no, F.lit(" of 7")), F.lit("Unknown label: x"),
        ), "\n",
    )
    rows = items.select("l_orderkey", F.struct("l_linenumber", block.alias("b")).alias("s")).groupBy("l_orderkey").agg(F.array_sort(F.collect_list("s")).alias("blocks"))
    return rows.select(F.col("l_orderkey").alias("document_id"), F.array_join(F.transform("blocks", lambda s: s["b"]), "\n").alias("body"))


def labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(I.LABELS.items()), "label string, key string")


def values(spark: SparkSession, sf: str) -> DataFrame:
    return I.labelled_values(I.body_lines(printed(spark, sf)), labels(spark))


_VALUES = f"""{PRINTED},
label AS (SELECT * FROM (VALUES {', '.join(map(str, I.LABELS.items()))}) AS l(label, key)),
keyed AS (SELECT line.*, label.label, key, regexp_extract(line, '^([^:]{{1,60}}):(.*)$', 2) AS rest FROM line LEFT JOIN label ON label.label = lower(trim(regexp_extract(line, '^([^:]{{1,60}}):(.*)$', 1)))),
seen AS (SELECT *, lead(line) OVER w AS next_line, lead(key) OVER w AS next_key, CAST(sum(CASE WHEN key = 'item' THEN 1 ELSE 0 END) OVER w AS BIGINT) AS item_ordinal FROM keyed WINDOW w AS (PARTITION BY document_id ORDER BY line_no)),
value AS (SELECT document_id, line_no, key, label, item_ordinal, CASE WHEN trim(rest) <> '' THEN trim(rest) WHEN next_key IS NULL AND next_line IS NOT NULL THEN trim(next_line) END AS value, trim(rest) = '' AND next_key IS NULL AND next_line IS NOT NULL AS on_next_line FROM seen WHERE key IS NOT NULL)"""


@registry.query(f"WITH {_VALUES} SELECT document_id, CAST(line_no AS BIGINT) AS line_no, key, item_ordinal, value, on_next_line FROM value WHERE value IS NOT NULL")
def baseline_values(spark: SparkSession, sf: str) -> DataFrame:
    """Values behind labels, on the same line or on the next."""
    return values(spark, sf).select("document_id", F.col("line_no").cast("long").alias("line_no"), "key", "item_ordinal", "value", "on_next_line")


@registry.query(f"WITH {_VALUES} SELECT key, count(*) AS n, count(*) FILTER (WHERE label <> key) AS alternate, count(*) FILTER (WHERE on_next_line) AS split FROM value WHERE value IS NOT NULL GROUP BY key")
def label_classification(spark: SparkSession, sf: str) -> DataFrame:
    """Canonical and alternate labels by field."""
    return values(spark, sf).groupBy("key").agg(F.count("*").alias("n"), F.sum((F.col("label") != F.col("key")).cast("long")).alias("alternate"), F.sum(F.col("on_next_line").cast("long")).alias("split"))


_SCORES = f"""{_VALUES}, scored AS (SELECT *, label <> key AS alternate, on_next_line AS split, document_id % 7 = 0 AS repaired FROM value WHERE value IS NOT NULL),
domain AS (SELECT a AS alternate, s AS split, r AS repaired, CAST(1 AS DOUBLE) - CASE WHEN a THEN CAST(0.15 AS DOUBLE) ELSE 0 END - CASE WHEN s THEN CAST(0.1 AS DOUBLE) ELSE 0 END - CASE WHEN r THEN CAST(0.25 AS DOUBLE) ELSE 0 END AS score FROM (VALUES (false), (true)) x(a), (VALUES (false), (true)) y(s), (VALUES (false), (true)) z(r))"""


def signals(spark: SparkSession, sf: str) -> DataFrame:
    return values(spark, sf).select("*", (F.col("label") != F.col("key")).alias("alternate"), F.col("on_next_line").alias("split"), (F.col("document_id") % 7 == 0).alias("repaired"))


@registry.query(f"WITH {_SCORES} SELECT domain.alternate, domain.split, domain.repaired, round(score, 9) AS score, score >= 0.8 AS stored, count(scored.document_id) AS n FROM domain LEFT JOIN scored ON (domain.alternate, domain.split, domain.repaired) = (scored.alternate, scored.split, scored.repaired) GROUP BY ALL")
def confidence_histogram(spark: SparkSession, sf: str) -> DataFrame:
    """Values over all eight scores, zeros included."""
    out = I.counts_over_domain(I.confidence_domain(spark), signals(spark, sf), ["alternate", "split", "repaired"])
    return out.select("alternate", "split", "repaired", F.round("score", 9).alias("score"), (F.col("score") >= I.FLOOR).alias("stored"), "n")


@registry.query(f"""WITH {_SCORES}, doc AS (SELECT DISTINCT document_id FROM src), field AS (SELECT unnest(['discipline', 'section', 'manufacturer', 'quantity', 'date']) AS field)
SELECT document_id, field, 'no_value_found' AS outcome FROM doc, field WHERE NOT EXISTS (SELECT 1 FROM scored WHERE scored.document_id = doc.document_id AND key = field)""")
def absence_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record for each attempted field that a document does not print."""
    docs = printed(spark, sf)
    fields = spark.createDataFrame([(f,) for f in ("discipline", "section", "manufacturer", "quantity", "date")], "field string")
    found = values(spark, sf).select("document_id", F.col("key").alias("field"), "line_no")
    return I.absences(docs, fields, found, found.select("document_id", F.col("line_no").alias("ordinal"))).select("document_id", "field", "outcome")


@registry.query(f"WITH {_SCORES}, o AS (SELECT * FROM (VALUES {', '.join(f'({i}, {o!r})' for i, o in enumerate(I.OUTCOMES))}) AS t(i, outcome)), f AS (SELECT 'confidence_below_threshold' AS outcome FROM scored JOIN domain USING (alternate, split, repaired) WHERE score < 0.8) SELECT o.outcome, count(f.outcome) AS n FROM o LEFT JOIN f USING (outcome) GROUP BY o.outcome")
def failure_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Failures over the closed list of outcomes, zeros included."""
    low = signals(spark, sf).where(I.confidence(F.col("alternate"), F.col("split"), F.col("repaired")) < I.FLOOR).select(F.lit("confidence_below_threshold").alias("outcome"))
    return I.counts_over_domain(spark.createDataFrame([(o,) for o in I.OUTCOMES], "outcome string"), low, ["outcome"])


@registry.query(f"""WITH {_VALUES}, produced AS (SELECT key AS field, count(*) AS stored FROM value WHERE value IS NOT NULL AND key <> 'item' GROUP BY key),
expected AS (SELECT document_id, 'quantity' AS field, CAST(CAST(q AS INTEGER) AS VARCHAR) AS value FROM src UNION ALL SELECT document_id, 'manufacturer', 'Brand#' || p % 25 FROM src),
numbered AS (SELECT document_id, key AS field, value, row_number() OVER (PARTITION BY document_id, key, value) AS k FROM value WHERE value IS NOT NULL), wanted AS (SELECT *, row_number() OVER (PARTITION BY document_id, field, value) AS k FROM expected),
hit AS (SELECT field, count(*) AS matched FROM numbered JOIN wanted USING (document_id, field, value, k) GROUP BY field), printed AS (SELECT field, count(*) AS printed FROM expected GROUP BY field)
SELECT field, stored, matched, printed, matched / stored AS precision, matched / printed AS recall FROM produced JOIN hit USING (field) JOIN printed USING (field)""")
def field_precision_recall(spark: SparkSession, sf: str) -> DataFrame:
    """Produced values against those known to be printed, as multisets; fields with a match."""
    produced = values(spark, sf).where("key <> 'item'").select("document_id", F.col("key").alias("field"), "value")
    items = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("int").alias("q"), F.min("l_partkey").alias("p"))
    fact = lambda f, v: F.struct(F.lit(f).alias("field"), v.alias("value"))
    expected = items.select(F.col("l_orderkey").alias("document_id"), F.explode(F.array(fact("quantity", F.col("q").cast("string")), fact("manufacturer", F.concat(F.lit("Brand#"), (F.col("p") % 25).cast("string"))))).alias("e")).select("document_id", "e.*")
    out = I.multiset_counts(produced, expected, ["document_id", "field", "value"], ["field"]).where("matched > 0")
    return out.select("field", "stored", "matched", "printed", (F.col("matched") / F.col("stored")).alias("precision"), (F.col("matched") / F.col("printed")).alias("recall"))


_Z = stats.Z95


@registry.query(f"""WITH c AS (SELECT p_brand, count(*) AS n, count(*) FILTER (WHERE p_size > 25) AS k FROM part GROUP BY p_brand), v AS (SELECT *, CAST(n AS DOUBLE) AS m, k / n AS p, CAST({_Z} AS DOUBLE) AS z FROM c)
SELECT p_brand, n, k, round(CASE WHEN k = 0 THEN 0 ELSE greatest(0, least(1, (2 * m * p + z * z - 1 - z * sqrt(greatest(0, z * z - 2 - 1 / m + 4 * p * (m * (1 - p) + 1)))) / (2 * (m + z * z)))) END, 9) AS low,
round(CASE WHEN k = n THEN 1 ELSE greatest(0, least(1, (2 * m * p + z * z + 1 + z * sqrt(greatest(0, z * z + 2 - 1 / m + 4 * p * (m * (1 - p) - 1)))) / (2 * (m + z * z)))) END, 9) AS high FROM v""")
def wilson_intervals(spark: SparkSession, sf: str) -> DataFrame:
    """Continuity-corrected intervals of shares by group."""
    c = table(spark, sf, "part").groupBy("p_brand").agg(F.count("*").alias("n"), F.sum((F.col("p_size") > 25).cast("long")).alias("k"))
    low, high = stats.wilson_corrected(F.col("k"), F.col("n"))
    return c.select("p_brand", "n", "k", F.round(low, 9).alias("low"), F.round(high, 9).alias("high"))


@registry.query("SELECT o_orderkey, CASE WHEN o_orderkey % 6 < 5 THEN CAST(o_orderdate AS DATE) END AS day_read, CASE WHEN o_orderkey % 3 = 0 THEN CAST(o_orderkey * 1000 + 0.5 AS DOUBLE) END AS number_read FROM orders")
def coerce_dates_numbers(spark: SparkSession, sf: str) -> DataFrame:
    """Printed dates and numbers read back; the oracle knows the values they were printed from."""
    o = table(spark, sf, "orders").select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    forms = ["yyyy-MM-dd", "MM/dd/yyyy", "MM/dd/yy", "d MMM yyyy", "MMMM d, yyyy", "yyyy-MM-dd'T'00:00:00"]
    shown = F.element_at(F.array(*(F.date_format("d", f) for f in forms)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    grouped = F.format_number(F.col("o_orderkey") * 1000, 0)
    figure = F.when(F.col("o_orderkey") % 3 == 0, F.concat(grouped, F.lit(".5"))).when(F.col("o_orderkey") % 3 == 1, F.concat(grouped, F.lit(" ea"))).otherwise(F.lit("1,2,3"))
    return o.select("o_orderkey", text.date(shown).alias("day_read"), text.number(figure).cast("double").alias("number_read"))


@registry.query("""SELECT page_id, host, trim(regexp_replace(host, '[^a-z0-9]+', '-', 'g'), '-') AS slug, 'sha256:' || sha256(url) AS url_digest FROM (SELECT page_id, url, lower(regexp_extract(url, '^[a-z]+://([^/?#]*)', 1)) AS host FROM pages)""")
def document_identity(spark: SparkSession, sf: str) -> DataFrame:
    """Ids minted from hosts, and labelled digests."""
    host = F.lower(F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1))
    return table(spark, sf, "pages").select("page_id", host.alias("host"), text.slug(host).alias("slug"), text.digest(F.col("url")).alias("url_digest"))


@registry.query("""WITH o AS (SELECT doc_id AS document_id, md5(text || lang) AS now FROM documents WHERE doc_id % 10 <> 3), h AS (SELECT doc_id AS document_id, md5(text || CASE WHEN doc_id % 4 = 0 THEN 'x' ELSE lang END) AS held FROM documents WHERE doc_id % 10 <> 5)
SELECT document_id, CASE WHEN held IS NULL THEN 'load' WHEN now IS NULL THEN 'retire' WHEN now = held THEN 'unchanged' ELSE 'reload' END AS action FROM o FULL JOIN h USING (document_id)""")
def reload_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Documents to load, reload, leave or retire by the digest of their inputs."""
    d = documents(spark, sf)
    observed = d.where("document_id % 10 <> 3").select("document_id", F.md5(F.concat("body", "lang")).alias("digest"))
    held = d.where("document_id % 10 <> 5").select("document_id", F.md5(F.concat("body", F.when(F.col("document_id") % 4 == 0, "x").otherwise(F.col("lang")))).alias("digest"))
    return I.plan_documents(observed, held)


@registry.query("SELECT doc_id AS document_id, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)\\b(?:password|token|api[_-]?key|secret)\\s*[=:]\\s*\\S+')) AS m FROM documents) GROUP BY doc_id")
def credential_findings(spark: SparkSession, sf: str) -> DataFrame:
    """Credentials printed in documents."""
    found = documents(spark, sf).select("document_id", F.size(F.regexp_extract_all("body", F.lit(text.SECRETS), F.lit(0))).cast("long").alias("n"))
    return found.where("n > 0")


@registry.query("""WITH d AS (SELECT source, lang, count(*) AS n FROM documents GROUP BY source, lang), g AS (SELECT DISTINCT source FROM documents), l AS (SELECT unnest(['en', 'de', 'fr', 'es', 'zz']) AS lang)
SELECT g.source, l.lang, coalesce(n, 0) AS n FROM g CROSS JOIN l LEFT JOIN d ON d.source = g.source AND d.lang = l.lang""")
def documents_by_layer(spark: SparkSession, sf: str) -> DataFrame:
    """Documents of each source over a closed list of layers, zeros included."""
    d = documents(spark, sf)
    domain = d.select("source").distinct().select("source", F.explode(F.array(*map(F.lit, ("en", "de", "fr", "es", "zz")))).alias("lang"))
    return I.counts_over_domain(domain, d, ["source", "lang"])


@registry.query("""SELECT doc_id AS document_id, CAST(place AS BIGINT) AS place, md5(line) AS line_md5, last_value(CASE WHEN length(line) < 20 THEN line END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY place ROWS UNBOUNDED PRECEDING) AS heading
FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM documents)""")
def inherited_headings(spark: SparkSession, sf: str) -> DataFrame:
    """Each line with the nearest short line at or above it, read as its heading."""
    lines = documents(spark, sf).select("document_id", F.posexplode(F.split("body", "\n")).alias("p", "line"))
    own = Window.partitionBy("document_id").orderBy("p").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.last(F.when(F.length("line") < 20, F.col("line")), ignorenulls=True).over(own)
    return lines.select("document_id", (F.col("p") + 1).cast("long").alias("place"), F.md5("line").alias("line_md5"), heading.alias("heading"))


_LABELS = """first AS (SELECT doc_id, array_to_string(string_split(regexp_replace(trim(coalesce(text, ''), ' ' || chr(10)), '[ \n]+', ' ', 'g'), ' ')[1:3], ' ') AS label FROM documents),
raw AS (SELECT label AS raw FROM first UNION ALL SELECT upper(label) FROM first WHERE doc_id % 2 = 0 UNION ALL SELECT '  ' || replace(label, ' ', '   ') FROM first WHERE doc_id % 3 = 0),
folded AS (SELECT raw, replace(lower(nfc_normalize(trim(regexp_replace(raw, ' +', ' ', 'g')))), 'ß', 'ss') AS label FROM raw)"""


@registry.query(f"WITH {_LABELS} SELECT label, count(*) AS n, count(DISTINCT raw) AS spellings FROM folded GROUP BY label")
def folded_labels(spark: SparkSession, sf: str) -> DataFrame:
    """The opening words of all documents as labels, some in capitals and some spaced out, by the form in which labels are the same."""
    words = F.split(F.regexp_replace(F.trim(F.coalesce("text", F.lit("")), F.lit(" \n")), "[ \n]+", " "), " ")
    first = table(spark, sf, "documents").select("doc_id", F.array_join(F.slice(words, 1, 3), " ").alias("label"))
    capitals = first.where("doc_id % 2 = 0").select(F.upper("label").alias("raw"))
    spaced = first.where("doc_id % 3 = 0").select(F.concat(F.lit("  "), F.replace("label", F.lit(" "), F.lit("   "))).alias("raw"))
    raw = first.select(F.col("label").alias("raw")).unionAll(capitals).unionAll(spaced)
    # equal spellings are folded once
    seen = raw.groupBy("raw").agg(F.count("*").alias("n")).withColumn("label", text.folded_label("raw"))
    return seen.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("spellings"))

"""Document structure, values, citations and attempts: orders printed as specifications, lines as chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wharfline.functions import text
from wharfline.operators import structure as U
from wharfline.operators.blocks import cause_counts, similar_forest
from wharfline.operators.components import connected_components
from wharfline.session import table
from wharfline.shared import dealt, materialize

from .registry import Registry
from .retrieval import _DOT

registry = Registry()
#: A specification for each order: a block of lines for each of its order lines.
SPEC = """raw AS (SELECT l_orderkey AS document_id, l_linenumber AS n, min(l_partkey) AS p FROM lineitem GROUP BY l_orderkey, l_linenumber),
blk AS (SELECT document_id, n, unnest([CASE WHEN n % 3 = 1 THEN 'SECTION 23 52 ' || lpad(CAST(p % 100 AS VARCHAR), 2, '0') ELSE 'SECTION 23 52 00 Page ' || n END, 'PART ' || n || ' GENERAL', n || '.1 SUMMARY', n || '.1.' || (p % 9 + 1) || ' Scope of work', 'a. First item', 'Body text of the unit.', n || '.1.1.2.1 Deep clause', 'see para. 1.1.']) AS line, unnest([1, 2, 3, 4, 5, 6, 7, 8]) AS k FROM raw),
line AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY n, k) AS line_no, line FROM blk)"""
_D = f"regexp_extract(line, '{U.DOTTED_MARK}', 1)"
_MARKED = f"""{SPEC}, marked AS (SELECT *, CASE WHEN regexp_matches(line, '{U.SECTION_MARK}') THEN 'section' WHEN regexp_matches(line, '{U.PART_MARK}') THEN 'part' WHEN regexp_matches(line, '{U.DOTTED_MARK}') THEN CASE len(string_split({_D}, '.')) WHEN 2 THEN 'article' WHEN 3 THEN 'paragraph' ELSE 'subparagraph' END WHEN regexp_matches(line, '{U.LETTER_MARK}') THEN 'lettered_item' END AS kind,
CASE WHEN regexp_matches(line, '{U.SECTION_MARK}') THEN regexp_extract(line, '{U.SECTION_MARK}', 1) WHEN regexp_matches(line, '{U.PART_MARK}') THEN regexp_extract(line, '{U.PART_MARK}', 1) WHEN regexp_matches(line, '{U.DOTTED_MARK}') THEN {_D} WHEN regexp_matches(line, '{U.LETTER_MARK}') THEN regexp_extract(line, '{U.LETTER_MARK}', 1) END AS mark FROM line)"""


def specifications(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, line_no, line) of the printed specifications."""
    items = dealt(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), "l_orderkey")
    raw = items.groupBy(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("n")).agg(F.min("l_partkey").alias("p"))
    n, p = F.col("n").cast("string"), F.col("p")
    head = F.when(F.col("n") % 3 == 1, F.concat(F.lit("SECTION 23 52 "), F.lpad((p % 100).cast("string"), 2, "0"))).otherwise(F.concat(F.lit("SECTION 23 52 00 Page "), n))
    block = [head, F.concat(F.lit("PART "), n, F.lit(" GENERAL")), F.concat(n, F.lit(".1 SUMMARY")), F.concat(n, F.lit(".1."), (p % 9 + 1).cast("string"), F.lit(" Scope of work")), F.lit("a. First item"), F.lit("Body text of the unit."), F.concat(n, F.lit(".1.1.2.1 Deep clause")), F.lit("see para. 1.1.")]
    lines = raw.select("document_id", "n", F.posexplode(F.array(*block)).alias("k", "line"))
    return lines.select("document_id", F.row_number().over(Window.partitionBy("document_id").orderBy("n", "k")).cast("long").alias("line_no"), "line")


@registry.query(f"WITH {_MARKED} SELECT document_id, line_no, coalesce(kind, '') AS kind, coalesce(mark, '') AS mark FROM marked")
def structure_markers(spark: SparkSession, sf: str) -> DataFrame:
    """The unit that each line of a specification opens; running footers and references inside prose open none."""
    return U.marked(specifications(spark, sf)).select("document_id", "line_no", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("mark", F.lit("")).alias("mark"))


_UNITS = (*U.LEVELS, "lettered_item")
_LAST = ", ".join(f"coalesce(max(CASE WHEN kind = '{k}' THEN line_no END) OVER w, 0) AS i{i}, last_value(CASE WHEN kind = '{k}' THEN mark END IGNORE NULLS) OVER w AS m{i}" for i, k in enumerate(_UNITS))
_PARTS = ", ".join("CASE WHEN " + (f"i{i} > greatest({', '.join(f'i{j}' for j in range(i))}, 0)" if i else "i0 > 0") + f" THEN m{i} END" for i in range(len(_UNITS)))
_PATHS = f"""{_MARKED}, held AS (SELECT document_id, line_no, kind, {_LAST} FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)), path AS (SELECT document_id, line_no, kind, list_filter([{_PARTS}], lambda x: x IS NOT NULL) AS path FROM held)"""


@registry.query(f"WITH {_PATHS} SELECT document_id, line_no, array_to_string(path, ' > ') AS path FROM path")
def structure_ladder(spark: SparkSession, sf: str) -> DataFrame:
    """The units open at each line, outermost first."""
    return U.open_path(U.marked(specifications(spark, sf))).select("document_id", "line_no", F.array_join("path", " > ").alias("path"))


#: Each text as a specification: its lines under parts, articles, paragraphs and lettered items in turn.
_LADDER = """body AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS j FROM documents),
line AS (SELECT document_id, row_number() OVER (PARTITION BY document_id ORDER BY j, k) AS line_no, line FROM (
  SELECT document_id, -1 AS j, 0 AS k, 'SECTION 23 52 00' AS line FROM body WHERE j = 0 UNION ALL SELECT document_id, j, 1, line FROM body
  UNION ALL SELECT document_id, j, 0, CASE j % 4 WHEN 0 THEN 'PART ' || (j // 4 + 1) || ' GENERAL' WHEN 1 THEN (j // 4 + 1) || '.1 SUMMARY' WHEN 2 THEN (j // 4 + 1) || '.1.1 Scope of work' ELSE 'a. First item' END FROM body))"""


def ladder_lines(spark: SparkSession, sf: str) -> DataFrame:
    """(document_id, line_no, line) of all documents, with a mark before each of their lines."""
    raw = table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("j", "line"))
    n = (F.floor(F.col("j") / 4) + 1).cast("string")
    kind = F.col("j") % 4
    mark = F.when(kind == 0, F.concat(F.lit("PART "), n, F.lit(" GENERAL"))).when(kind == 1, F.concat(n, F.lit(".1 SUMMARY"))).when(kind == 2, F.concat(n, F.lit(".1.1 Scope of work"))).otherwise("a. First item")
    head = F.when(F.col("j") == 0, F.array(F.lit("SECTION 23 52 00"), mark, "line")).otherwise(F.array(F.lit(None).cast("string"), mark, "line"))
    lines = raw.select("document_id", "j", F.posexplode(head).alias("k", "line")).where("k > 0 or j = 0")
    return lines.select("document_id", (F.col("j") * 2 + F.col("k") + 1).cast("long").alias("line_no"), "line")


_CHAIN = ", ".join("CASE WHEN " + (f"i{i} > greatest({', '.join(f'i{j}' for j in range(i))}, 0)" if i else "i0 > 0") + f" THEN {{'level': {i}, 'unit': i{i}, 'mark': m{i}}} END" for i in range(len(_UNITS)))
_PIECES = "len(list_filter(regexp_split_to_array({}, '[ \\n]+'), lambda w: w <> ''))"
_CHUNKS = f"""{_MARKED.replace(SPEC, _LADDER)}, held AS (SELECT document_id, line_no, line, {_LAST} FROM marked WINDOW w AS (PARTITION BY document_id ORDER BY line_no ROWS UNBOUNDED PRECEDING)),
chain AS (SELECT document_id, line_no, line, {_PIECES.format('line')} AS pieces, unnest(list_filter([{_CHAIN}], lambda x: x IS NOT NULL)) AS u FROM held),
size AS (SELECT document_id, u.unit AS unit, sum(pieces) AS size FROM chain GROUP BY ALL),
home AS (SELECT document_id, line_no, any_value(line) AS line, any_value(pieces) AS pieces, coalesce(arg_min(u, u.level) FILTER (WHERE size <= {U.BUDGET}), arg_max(u, u.level)) AS u FROM chain JOIN size USING (document_id) WHERE size.unit = u.unit GROUP BY document_id, line_no),
fragment AS (SELECT row_number() OVER () AS f, * FROM (SELECT document_id, u, min(line_no) AS first, sum(pieces) AS pieces, string_agg(line, chr(10) ORDER BY line_no) AS body FROM home GROUP BY document_id, u)),
cut AS (SELECT f, s, row_number() OVER (PARTITION BY f ORDER BY i) AS i, {_PIECES.format('s')} AS w FROM (SELECT f, unnest(regexp_extract_all(body, '{U.SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(body, '{U.SENTENCE}'), 1) AS i FROM fragment WHERE pieces > {U.BUDGET}) WHERE trim(s, ' ' || chr(10)) <> ''),
walk(f, i, start, held) AS (SELECT f, i, i, w FROM cut WHERE i = 1 UNION ALL SELECT c.f, c.i, CASE WHEN held + w > {U.BUDGET} THEN c.i ELSE start END, CASE WHEN held + w > {U.BUDGET} THEN w ELSE held + w END FROM walk JOIN cut c ON c.f = walk.f AND c.i = walk.i + 1),
split AS (SELECT f, start, {_PIECES.format('body')} AS pieces, body FROM (SELECT f, start, trim(string_agg(s, '' ORDER BY i), ' ' || chr(10)) AS body FROM walk JOIN cut USING (f, i) GROUP BY f, start)),
chunk AS (SELECT document_id, first, 0 AS start, [{', '.join(f"'{k}'" for k in _UNITS)}][u.level + 1] AS boundary, u.mark AS identifier, pieces, body FROM fragment WHERE pieces <= {U.BUDGET}
  UNION ALL SELECT document_id, first, start, CASE WHEN split.pieces > {U.BUDGET} THEN 'over_budget' ELSE 'sentence' END, u.mark, split.pieces, split.body FROM split JOIN fragment USING (f))"""


@registry.query(f"WITH RECURSIVE {_CHUNKS} SELECT document_id, CAST(row_number() OVER (PARTITION BY document_id ORDER BY first, start) - 1 AS BIGINT) AS ordinal, boundary, identifier, CAST(pieces AS BIGINT) AS pieces, md5(body) AS body_md5 FROM chunk WHERE pieces > 0")
def ladder_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks of all documents along the ladder of their units, within the piece budget."""
    digests = U.ladder_cuts(ladder_lines(spark, sf)).withColumn("body", F.md5(F.encode("body", "UTF-8")))
    return U.numbered(digests).withColumnRenamed("body", "body_md5")


@registry.query(f"WITH {_CHUNKS} SELECT boundary, count(*) AS n, CAST(min(pieces) AS BIGINT) AS least, CAST(max(pieces) AS BIGINT) AS most, CAST(sum(pieces) AS BIGINT) AS pieces FROM chunk WHERE pieces > 0 GROUP BY boundary".replace("WITH ", "WITH RECURSIVE ", 1))
def chunk_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks by the class of boundary that ends them, with their pieces."""
    return U.ladder_cuts(ladder_lines(spark, sf)).groupBy("boundary").agg(F.count("*").alias("n"), F.min("pieces").alias("least"), F.max("pieces").alias("most"), F.sum("pieces").alias("pieces"))


@registry.query(f"WITH {_PATHS} SELECT document_id, (line_no - 1) // 5 + 1 AS page, array_to_string(arg_min(path, line_no), ' > ') AS carried, count(*) FILTER (WHERE kind IS NOT NULL) AS opened FROM path GROUP BY document_id, (line_no - 1) // 5")
def page_structure(spark: SparkSession, sf: str) -> DataFrame:
    """Page by page, the path open at the top of the page and the units that it opens."""
    paths = U.open_path(U.marked(specifications(spark, sf))).withColumn("page", (F.floor((F.col("line_no") - 1) / 5) + 1).cast("long"))
    out = paths.groupBy("document_id", "page").agg(F.min_by("path", "line_no").alias("p"), F.count("kind").alias("opened"))
    return out.select("document_id", "page", F.array_join("p", " > ").alias("carried"), "opened")


@registry.query(f"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '{U.SENTENCE}')) AS s, generate_subscripts(regexp_extract_all(text, '{U.SENTENCE}'), 1) - 1 AS ordinal FROM documents)
SELECT doc_id AS document_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(coalesce(sum(length(s)) OVER (PARTITION BY doc_id ORDER BY ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start, length(s) AS length FROM s""")
def sentence_spans(spark: SparkSession, sf: str) -> DataFrame:
    """Sentences of all documents with their place in the text."""
    return U.sentences(table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.col("text").alias("body")))


_NAMED = "named AS (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'ufgs-' || lpad(CAST(p_size AS VARCHAR), 2, '0') || '-10-' || lpad(CAST(p_partkey % 90 AS VARCHAR), 2, '0') || CASE WHEN p_partkey % 6 = 0 THEN '-00-20' ELSE '' END ELSE 'prj-' || p_size || '-t' || p_partkey % 40 || CASE WHEN p_partkey % 3 = 0 THEN '-r' || p_partkey % 4 ELSE '' END END AS document_id FROM part)"


@registry.query(f"WITH {_NAMED} SELECT p_partkey, document_id, nullif(regexp_extract(document_id, '{U.FAMILY_NUMBER}', 1), '') AS family, nullif(regexp_extract(document_id, '{U.REVISION_STEM}', 1), '') AS stem FROM named")
def document_families(spark: SparkSession, sf: str) -> DataFrame:
    """The family number and the revision stem that a document's id carries."""
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    k, size = F.col("p_partkey"), F.col("p_size")
    spec = F.concat(F.lit("ufgs-"), two(size), F.lit("-10-"), two(k % 90), F.when(k % 6 == 0, "-00-20").otherwise(""))
    mail = F.concat(F.lit("prj-"), size.cast("string"), F.lit("-t"), (k % 40).cast("string"), F.when(k % 3 == 0, F.concat(F.lit("-r"), (k % 4).cast("string"))).otherwise(""))
    d = table(spark, sf, "part").select("p_partkey", F.when(k % 2 == 0, spec).otherwise(mail).alias("document_id"))
    pick = lambda p: F.nullif(F.regexp_extract("document_id", p, 1), F.lit(""))
    return d.select("p_partkey", "document_id", pick(U.FAMILY_NUMBER).alias("family"), pick(U.REVISION_STEM).alias("stem"))


_FLOORS = (0.3, 0.35, 0.4, 0.45, 0.5)
_CLOSE = f"{_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')}))"


@registry.query(f"""WITH RECURSIVE pair AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label, {_CLOSE} AS c FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id), f AS (SELECT unnest({list(_FLOORS)}) AS floor),
edge AS (SELECT floor, a, b FROM pair, f WHERE c >= CAST(floor AS DOUBLE) UNION SELECT floor, b, a FROM pair, f WHERE c >= CAST(floor AS DOUBLE)),
reach AS (SELECT floor, a AS node, a AS root FROM edge UNION SELECT edge.floor, edge.b, reach.root FROM reach JOIN edge ON edge.floor = reach.floor AND edge.a = reach.node WHERE reach.root < edge.b),
least AS (SELECT floor, node, min(root) AS root FROM reach GROUP BY floor, node)
SELECT CAST(floor AS DOUBLE) AS floor, count(*) AS members, count(DISTINCT root) AS clusters FROM least GROUP BY floor""")
def near_duplicate_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters of two or more vectors of one label, as components of the pairs at five thresholds: one search serves them all."""
    forest = materialize(similar_forest(table(spark, sf, "embeddings"), key="label", id_col="vec_id", vector="embedding", floor=min(_FLOORS)), "forest")
    # a vector at a threshold is a node of its own, so that the rounds run once
    passed = F.explode(F.filter(F.array(*map(F.lit, _FLOORS)), lambda f: F.col("cosine") >= f)).alias("floor")
    edges = forest.select("a", "b", passed).select(F.struct("floor", F.col("a").alias("id")).alias("a"), F.struct("floor", F.col("b").alias("id")).alias("b"))
    nodes = connected_components(edges).groupBy(F.col("node.floor").alias("floor")).agg(F.count("*").alias("others"), F.countDistinct("root").alias("clusters"))
    return nodes.select("floor", (F.col("others") + F.col("clusters")).alias("members"), "clusters")


_CAUSES = ("source", "label", "lang")
_SHARED = "a.source = b.source AND a.lang = b.lang"


@registry.query(f"""WITH v AS (SELECT vec_id, label, embedding, source, lang FROM embeddings LEFT JOIN documents ON doc_id = vec_id),
pair AS (SELECT CASE WHEN {_SHARED} THEN 'source' WHEN a.label = b.label THEN 'label' ELSE 'lang' END AS cause, {_CLOSE} AS c FROM v a JOIN v b ON a.vec_id < b.vec_id AND ({_SHARED} OR a.label = b.label OR a.lang = b.lang)),
f AS (SELECT unnest({list(_FLOORS)}) AS floor) SELECT cause, CAST(floor AS DOUBLE) AS floor, count(*) FILTER (WHERE c >= CAST(floor AS DOUBLE)) AS n FROM pair, f GROUP BY ALL""")
def near_duplicate_causes(spark: SparkSession, sf: str) -> DataFrame:
    """Similar pairs at five thresholds by their cause: one source, one label, or else one language."""
    docs = table(spark, sf, "documents").select(F.col("doc_id").alias("vec_id"), F.concat_ws("/", "lang", "source").alias("source"), "lang")
    rows = table(spark, sf, "embeddings").select("vec_id", F.col("label").cast("string").alias("label"), "embedding").join(docs, "vec_id", "left")
    return cause_counts(rows, causes=list(_CAUSES), id_col="vec_id", vector="embedding", floors=_FLOORS)


_VALUE = "value AS (SELECT l_orderkey AS document_id, CASE l_linenumber WHEN 1 THEN 'document' ELSE 'item' END AS scope, CASE WHEN l_partkey % 20 = 3 THEN NULL ELSE l_linenumber END AS ordinal FROM lineitem)"


@registry.query(f"WITH {_VALUE} SELECT scope, CASE WHEN scope = 'document' THEN 0 WHEN ordinal >= 1 THEN ordinal ELSE -1 END AS item, count(*) AS n FROM value GROUP BY ALL")
def line_item_grouping(spark: SparkSession, sf: str) -> DataFrame:
    """Values of the document, of an item, and those refused because nothing groups them (-1)."""
    v = table(spark, sf, "lineitem").select(F.when(F.col("l_linenumber") == 1, "document").otherwise("item").alias("scope"), F.when(F.col("l_partkey") % 20 != 3, F.col("l_linenumber")).alias("ordinal"))
    return v.groupBy("scope", F.coalesce(U.item_ordinal(F.col("scope"), F.col("ordinal")), F.lit(-1)).alias("item")).agg(F.count("*").alias("n"))


_CITES = "cite AS (SELECT l_orderkey AS document_id, l_partkey % 4 AS field, l_linenumber AS chunk, l_suppkey % 9 + 1 AS page FROM lineitem)"


@registry.query(f"""WITH {_CITES}, c AS (SELECT *, row_number() OVER (PARTITION BY document_id, field ORDER BY chunk, page) AS ordinal FROM cite), a AS (SELECT document_id, field, chunk, page, 'anchor' AS role, 1 AS ordinal FROM c WHERE ordinal = 1),
k AS (SELECT c.document_id, c.field, c.chunk, c.page, 'contributor' AS role, 1 + row_number() OVER (PARTITION BY c.document_id, c.field ORDER BY c.page, c.chunk, c.ordinal) AS ordinal FROM c WHERE c.ordinal > 1) SELECT document_id, field, chunk, page, role, CAST(ordinal AS BIGINT) AS ordinal FROM (FROM a UNION ALL FROM k)""")
def citation_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """The chunk a value is cited from, and the others that contribute to it, numbered from 2 by page."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), (F.col("l_partkey") % 4).alias("field"), F.col("l_linenumber").alias("chunk"), (F.col("l_suppkey") % 9 + 1).alias("page"))
    own = Window.partitionBy("document_id", "field")
    first = c.withColumn("o", F.row_number().over(own.orderBy("chunk", "page")))
    anchor = first.where("o = 1").select("document_id", "field", "chunk", "page", F.lit("anchor").alias("role"), F.lit(1).cast("long").alias("ordinal"))
    others = first.where("o > 1").select("document_id", "field", "chunk", "page", F.lit("contributor").alias("role"), (F.row_number().over(own.orderBy("page", "chunk", "o")) + 1).cast("long").alias("ordinal"))
    return anchor.unionByName(others)


@registry.query("""WITH c AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk, l_partkey, CASE WHEN l_partkey % 3 = 0 THEN 'Text and Quantity:' ELSE 'Text only' END AS tail, CASE WHEN l_suppkey % 2 = 0 THEN '12 each' ELSE 'Other words' END AS head FROM lineitem)
SELECT document_id, chunk, before AS label_chunk FROM (SELECT *, lag(tail) OVER w AS tail_before, lag(chunk) OVER w AS before FROM c WINDOW w AS (PARTITION BY document_id ORDER BY chunk, l_partkey, head, tail)) WHERE tail_before LIKE '%Quantity:' AND regexp_matches(head, '^[0-9]')""")
def split_label_contributors(spark: SparkSession, sf: str) -> DataFrame:
    """Chunks whose value has its label at the end of the chunk before."""
    c = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("document_id"), F.col("l_linenumber").alias("chunk"), "l_partkey", F.when(F.col("l_partkey") % 3 == 0, "Text and Quantity:").otherwise("Text only").alias("tail"), F.when(F.col("l_suppkey") % 2 == 0, "12 each").otherwise("Other words").alias("head"))
    own = Window.partitionBy("document_id").orderBy("chunk", "l_partkey", "head", "tail")
    seen = c.withColumn("tail_before", F.lag("tail").over(own)).withColumn("label_chunk", F.lag("chunk").over(own))
    return seen.where(F.col("tail_before").endswith("Quantity:") & F.col("head").rlike("^[0-9]")).select("document_id", "chunk", "label_chunk")


_FIELDS = "field AS (SELECT unnest(['PROMO', 'ECONOMY', 'MEDIUM', 'SMALL', 'none']) AS field), chunk AS (SELECT l_orderkey AS document_id, l_linenumber AS chunk, p_type FROM lineitem JOIN part ON p_partkey = l_partkey), printed AS (SELECT DISTINCT document_id, p_type AS field FROM chunk)"


@registry.query(f"""WITH {_FIELDS}, n AS (SELECT document_id, count(*) AS chunks FROM chunk GROUP BY document_id), a AS (SELECT n.document_id, count(printed.field) AS present, 5 - count(printed.field) AS absent FROM n CROSS JOIN field LEFT JOIN printed USING (document_id, field) GROUP BY n.document_id)
SELECT document_id, chunks, absent, present * chunks + absent AS attempts FROM n JOIN a USING (document_id)""")
def attempt_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Attempts of each document: a field that is printed is tried on every chunk, one that is not once."""
    c = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), F.col("p_type").alias("field"))
    named = ("PROMO", "ECONOMY", "MEDIUM", "SMALL", "none")
    out = c.groupBy("document_id").agg(F.count("*").alias("chunks"), *(F.max((F.col("field") == f).cast("long")).alias(f"f{i}") for i, f in enumerate(named)))
    present = sum((F.col(f"f{i}") for i in range(1, len(named))), F.col("f0"))
    return out.select("document_id", "chunks", (len(named) - present).alias("absent"), (present * F.col("chunks") + len(named) - present).alias("attempts"))


@registry.query(f"""WITH {_FIELDS}, tried AS (SELECT DISTINCT document_id, field FROM printed WHERE document_id % 5 <> 2 AND field <> 'SMALL')
SELECT field, reason, count(*) AS n FROM (SELECT field, CASE WHEN field NOT IN (SELECT field FROM field) THEN 'not_in_vocabulary' WHEN document_id % 5 = 2 THEN 'document_excluded' ELSE 'field_not_attempted' END AS reason FROM printed WHERE NOT EXISTS (SELECT 1 FROM tried t WHERE t.document_id = printed.document_id AND t.field = printed.field)) GROUP BY field, reason""")
def printed_but_unattempted(spark: SparkSession, sf: str) -> DataFrame:
    """Fields that documents print and nobody tried to read, by reason."""
    printed = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("l_orderkey").alias("document_id"), F.col("p_type").alias("field")).distinct()
    tried = printed.where("document_id % 5 <> 2 and field <> 'SMALL'")
    reason = F.when(~F.col("field").isin("PROMO", "ECONOMY", "MEDIUM", "SMALL", "none"), "not_in_vocabulary").when(F.col("document_id") % 5 == 2, "document_excluded").otherwise("field_not_attempted")
    return printed.join(tried, ["document_id", "field"], "left_anti").groupBy("field", reason.alias("reason")).agg(F.count("*").alias("n"))


@registry.query("WITH v AS (SELECT o.o_orderkey AS k, count(*) AS chunks FROM orders o JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey) SELECT count(*) AS n, count(*) FILTER (WHERE chunks > 1) AS multi, CAST(sum(chunks) AS BIGINT) AS rows FROM v")
def multi_chunk_counts(spark: SparkSession, sf: str) -> DataFrame:
    """Values, those that several chunks hold, and the rows of both."""
    v = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("chunks"))
    return v.agg(F.count("*").alias("n"), F.count_if(F.col("chunks") > 1).alias("multi"), F.sum("chunks").alias("rows"))


@registry.query("""WITH c AS (SELECT doc_id, length(text) - length(replace(text, chr(10), '')) + 1 AS lines, regexp_matches(text, '\\|') AS has_table, text <> trim(text) AS padded, regexp_matches(text, '[!]{2}') AS loud FROM documents)
SELECT doc_id AS document_id, list_filter([CASE WHEN lines = 1 THEN 'single_line' END, CASE WHEN has_table THEN 'table' END, CASE WHEN loud THEN 'loud' END], lambda x: x IS NOT NULL) AS classes FROM c""")
def irregularity_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Irregularities of a document, derived again from its text."""
    t = F.col("text")
    found = F.array(F.when(~t.contains("\n"), "single_line"), F.when(t.contains("|"), "table"), F.when(t.contains("!!"), "loud"))
    return table(spark, sf, "documents").select(F.col("doc_id").alias("document_id"), F.array_compact(found).alias("classes"))


_KEYED = "'{\"id\":' || page_id || ',\"key\":\"sk-ant-' || substr(md5(url), 1, 8 + CAST(page_id % 12 AS INTEGER)) || '\",\"url\":\"' || url || '\"}'"


@registry.query(f"SELECT page_id, regexp_replace({_KEYED}, 'sk-ant-[A-Za-z0-9_-]{{16,}}', '[REDACTED]', 'g') AS body FROM pages")
def credential_redaction(spark: SparkSession, sf: str) -> DataFrame:
    """Nested payloads without what has the shape of the provider's credential, in keys and values alike."""
    p = table(spark, sf, "pages")
    key = F.concat(F.lit("sk-ant-"), F.expr("substring(md5(url), 1, int(8 + page_id % 12))"))
    return p.select("page_id", text.redacted_leaves(F.struct(F.col("page_id").alias("id"), key.alias("key"), "url")).alias("body"))


@registry.query("SELECT o_orderkey AS k, '{\"customer\":' || o_custkey || ',\"order\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}' AS body, sha256('{\"customer\":' || o_custkey || ',\"order\":' || o_orderkey || ',\"status\":\"' || o_orderstatus || '\"}|schema-1|template-2') AS fixture_key FROM orders")
def canonical_requests(spark: SparkSession, sf: str) -> DataFrame:
    """Requests as canonical JSON (keys in order, no spaces), and the key of their fixture."""
    cells = {"status": F.col("o_orderstatus"), "order": F.col("o_orderkey"), "customer": F.col("o_custkey")}
    body = text.canonical_json(cells)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), body.alias("body"), F.sha2(F.concat(body, F.lit("|schema-1|template-2")), 256).alias("fixture_key"))


@registry.query("SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def rfc3339_times(spark: SparkSession, sf: str) -> DataFrame:
    """Event times as RFC 3339 in UTC."""
    return table(spark, sf, "events").select("event_id", text.rfc3339(F.col("ts")).alias("at"))


@registry.query("""WITH j AS (SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN '{"low":0.1,"high":0.9}' WHEN s_suppkey % 5 = 1 THEN '{"low":0.5,"mid":0.4,"high":0.9}' WHEN s_suppkey % 5 = 2 THEN '{"low":-1,"mid":0.4,"high":0.9}' WHEN s_suppkey % 5 = 3 THEN '[1,2]' ELSE '{"low":0.1,"mid":0.4,"high":0.9}' END AS body FROM supplier)
SELECT s_suppkey, s_suppkey % 5 = 4 AS well_formed, s_suppkey % 5 IN (1, 2, 4) AS has_all_keys FROM j""")
def json_shapes(spark: SparkSession, sf: str) -> DataFrame:
    """Whether a payload is an object of exactly three numbers, in order and in [0, 1], and whether it has all the keys."""
    k = F.col("s_suppkey") % 5
    body = F.when(k == 0, '{"low":0.1,"high":0.9}').when(k == 1, '{"low":0.5,"mid":0.4,"high":0.9}').when(k == 2, '{"low":-1,"mid":0.4,"high":0.9}').when(k == 3, "[1,2]").otherwise('{"low":0.1,"mid":0.4,"high":0.9}')
    m = F.try_variant_get(F.try_parse_json(body), "$", "map<string,double>")
    names = ("low", "mid", "high")
    all_keys = F.coalesce(F.size(F.array_except(F.array(*map(F.lit, names)), F.map_keys(m))) == 0, F.lit(False))
    values = [F.element_at(m, n) for n in names]
    shaped = all_keys & (F.size(m) == 3) & (values[0] <= values[1]) & (values[1] <= values[2]) & (values[0] >= 0) & (values[2] <= 1)
    return table(spark, sf, "supplier").select("s_suppkey", F.coalesce(shaped, F.lit(False)).alias("well_formed"), all_keys.alias("has_all_keys"))


@registry.query("""SELECT s_suppkey, CASE s_suppkey % 7 WHEN 0 THEN 'float' WHEN 1 THEN 'float' WHEN 2 THEN 'too deep' WHEN 3 THEN 'not an object' WHEN 4 THEN 'malformed' WHEN 5 THEN 'byte-order mark' END AS refusal FROM supplier""")
def fixture_refusals(spark: SparkSession, sf: str) -> DataFrame:
    """Why a payload may not become a fixture; numbers and brackets inside its texts are no reason."""
    k, key, name = F.col("s_suppkey") % 7, F.col("s_suppkey").cast("string"), F.col("s_name")
    made = lambda *parts: F.concat(*(p if not isinstance(p, str) else F.lit(p) for p in parts))
    deep = made('{"a":', F.repeat(F.lit("["), 32), key, F.repeat(F.lit("]"), 32), "}")
    whole = made('{"name":"', name, ' 1.5 \\"[[{{ 2e9","lines":[{"id":', key, "}]}")
    body = F.when(k == 0, made('{"share":', key, ".5}")).when(k == 1, made('{"a":[', key, "e2]}")).when(k == 2, deep).when(k == 3, made("[", key, "]")).when(k == 4, made('{"name":"', name, '",}')).when(k == 5, made("\ufeff", whole)).otherwise(whole)
    return table(spark, sf, "supplier").select("s_suppkey", text.json_refusal(body).alias("refusal"))


@registry.query("SELECT p_partkey, array_to_string(list_filter([nullif(trim(CASE WHEN p_partkey % 3 = 0 THEN ' ' ELSE p_brand END), ''), p_type, CASE WHEN p_partkey % 4 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END], lambda x: x IS NOT NULL), ' / ') AS shown FROM part")
def joined_descriptions(spark: SparkSession, sf: str) -> DataFrame:
    """The parts of a description that are not blank, joined."""
    part = F.array_compact(F.array(F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand")), F.col("p_type"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_size").cast("string"))))
    return table(spark, sf, "part").select("p_partkey", F.array_join(part, " / ").alias("shown"))


_NAMES = "n AS (SELECT s_suppkey, CASE WHEN s_suppkey % 9 = 0 THEN 'v' || s_suppkey ELSE 'V-' || lpad(CAST(s_suppkey AS VARCHAR), 5, '0') END AS id, CASE WHEN s_suppkey % 7 = 0 THEN lower(s_name) || ', Inc.' WHEN s_suppkey % 11 = 0 THEN 'ACME  Corp.' ELSE 'Firm ' || s_suppkey END AS name FROM supplier)"


@registry.query(f"""WITH {_NAMES}, x AS (SELECT *, trim(regexp_replace(replace(replace(lower(name), ',', ''), '.', ''), '\\s+', ' ', 'g')) AS norm FROM n)
SELECT id, name, 'identifier scheme' AS rule FROM x WHERE NOT regexp_matches(id, '^V-[0-9]{{5}}$') UNION ALL SELECT id, name, 'naming convention' FROM x WHERE NOT regexp_matches(name, '^[A-Z][A-Za-z]* [0-9]+$') UNION ALL SELECT id, name, 'matches a real firm' FROM x WHERE norm = 'acme corp'""")
def naming_violations(spark: SparkSession, sf: str) -> DataFrame:
    """Every way in which a roster's entries depart from the convention."""
    k = F.col("s_suppkey")
    n = table(spark, sf, "supplier").select(F.when(k % 9 == 0, F.concat(F.lit("v"), k.cast("string"))).otherwise(F.concat(F.lit("V-"), F.lpad(k.cast("string"), 5, "0"))).alias("id"), F.when(k % 7 == 0, F.concat(F.lower("s_name"), F.lit(", Inc."))).when(k % 11 == 0, "ACME  Corp.").otherwise(F.concat(F.lit("Firm "), k.cast("string"))).alias("name"))
    rules = F.array_compact(F.array(F.when(~F.col("id").rlike("^V-[0-9]{5}$"), "identifier scheme"), F.when(~F.col("name").rlike("^[A-Z][A-Za-z]* [0-9]+$"), "naming convention"), F.when(text.normalized_name(F.col("name")).isin("acme corp"), "matches a real firm")))
    return n.select("id", "name", F.explode(rules).alias("rule"))

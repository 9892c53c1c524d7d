"""Retrieval queries: documents stand for chunks, embeddings for their vectors, labels of embeddings for relevance."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats, stemming, text
from wharfline.operators import lexical as X
from wharfline.operators import retrieval as R
from wharfline.operators.blocks import partner_counts
from wharfline.session import table
from wharfline.shared import checked_broadcast, materialize

from .registry import Registry

registry = Registry()
#: Terms asked for, by query.
ASKED = {"q1": ["the", "thing"], "q2": ["and", "ha"], "q3": ["la", "que"], "q4": ["der", "und"], "q5": ["absent-term"]}
#: Every vector whose id this divides is a query.
DENSE_STEP = 100
_TERMS = "list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda t: t <> '')"


def chunks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("body_text"))


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def dense_queries(spark: SparkSession, sf: str) -> DataFrame:
    return vectors(spark, sf).where(F.col("chunk_id") % DENSE_STEP == 0).select(F.concat(F.lit("v"), F.col("chunk_id").cast("string")).alias("query_id"), "embedding", "label", F.col("chunk_id").alias("own"))


def lexical(spark: SparkSession, sf: str) -> DataFrame:
    asked = spark.createDataFrame([(q, t) for q, t in ASKED.items()], "query_id string, terms array<string>")
    return R.lexical_topk(R.postings(chunks(spark, sf), asked.select(F.explode("terms").alias("term"))), asked)


def dense(spark: SparkSession, sf: str) -> DataFrame:
    return R.dense_topk(vectors(spark, sf), dense_queries(spark, sf))


LEXICAL = f"""
posting AS (SELECT doc_id AS chunk_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TERMS}) AS term FROM documents) GROUP BY doc_id, term),
asked AS (SELECT * FROM (VALUES {', '.join(f"('{q}', {t})" for q, t in ASKED.items())}) AS v(query_id, terms)),
wanted AS (SELECT query_id, len(terms) AS wanted, unnest(terms) AS term FROM asked),
lex AS (SELECT query_id, chunk_id, round(sum(tf / (tf + 1)), 9) AS score FROM posting JOIN wanted USING (term) GROUP BY query_id, chunk_id, wanted HAVING count(*) = wanted),
lexical AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM lex) WHERE rank <= {R.DEPTH})"""
_DOT = "list_sum(list_transform(list_zip({a}, {b}), lambda p: CAST(p[1] AS DOUBLE) * CAST(p[2] AS DOUBLE)))"
DENSE = f"""
dq AS (SELECT 'v' || vec_id AS query_id, embedding AS q, label AS wanted_label, vec_id AS own FROM embeddings WHERE vec_id % {DENSE_STEP} = 0),
den AS (SELECT query_id, vec_id AS chunk_id, round(1.0 - {_DOT.format(a='embedding', b='q')} / (sqrt({_DOT.format(a='embedding', b='embedding')}) * sqrt({_DOT.format(a='q', b='q')})), 9) AS score FROM embeddings, dq),
dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) AS rank FROM den) WHERE rank <= {R.DEPTH})"""


@registry.query(f"WITH {LEXICAL} SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM lexical")
def lexical_topk(spark: SparkSession, sf: str) -> DataFrame:
    return lexical(spark, sf).withColumn("score", F.round("score", 6))


@registry.query(f"WITH {DENSE} SELECT query_id, chunk_id, round(score, 6) + 0.0 AS score, rank FROM dense")
def dense_topk(spark: SparkSession, sf: str) -> DataFrame:
    return dense(spark, sf).withColumn("score", F.round("score", 6) + F.lit(0.0))


#: The first dense queries by id run beside the lexical ones under the same name; the others have no lexical arm.
PAIRED = {q: f"v{DENSE_STEP * i}" for i, q in enumerate(ASKED)}
_FUSED = f"""{LEXICAL}, {DENSE},
paired AS (SELECT * FROM (VALUES {', '.join(map(str, PAIRED.items()))}) AS p(query_id, v)),
d AS (SELECT coalesce(paired.query_id, dense.query_id) AS query_id, chunk_id, rank FROM dense LEFT JOIN paired ON dense.query_id = v),
pair AS (SELECT query_id, chunk_id, l.rank AS lexical_rank, d.rank AS dense_rank FROM lexical l FULL JOIN d USING (query_id, chunk_id)),
fused AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM (SELECT *, round(coalesce(CAST(1.0 AS DOUBLE) / (60 + lexical_rank), 0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + dense_rank), 0), 12) AS score FROM pair)) WHERE rank <= {R.DEPTH})"""


def fused(spark: SparkSession, sf: str) -> DataFrame:
    names = spark.createDataFrame([(v, q) for q, v in PAIRED.items()], "query_id string, q string")
    d = dense(spark, sf).join(F.broadcast(names), "query_id", "left").withColumn("query_id", F.coalesce("q", "query_id")).drop("q")
    return R.fuse(lexical(spark, sf), d)


@registry.query(f"WITH {_FUSED} SELECT query_id, chunk_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank, score, rank FROM fused")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return fused(spark, sf).select("query_id", "chunk_id", F.coalesce(F.col("l").cast("long"), F.lit(0)).alias("lexical_rank"), F.coalesce(F.col("d").cast("long"), F.lit(0)).alias("dense_rank"), "score", "rank")


@registry.query(f"WITH {_FUSED} SELECT query_id, sha256(string_agg(CAST(chunk_id AS VARCHAR), chr(10) ORDER BY rank)) AS digest, count(*) AS n FROM fused GROUP BY query_id")
def retrieval_ordering_digest(spark: SparkSession, sf: str) -> DataFrame:
    rows = fused(spark, sf).groupBy("query_id")
    return rows.agg(arrays.ordered_digest(F.collect_list(F.struct("rank", F.col("chunk_id").cast("string").alias("id")))).alias("digest"), F.count("*").alias("n"))


@registry.query(f"WITH {_FUSED} SELECT query_id, count(*) AS n, '[' || string_agg('{{\"rank\":' || rank || ',\"chunk\":' || chunk_id || '}}', ',' ORDER BY rank) || ']' AS body FROM fused WHERE rank <= 10 GROUP BY query_id")
def search_responses(spark: SparkSession, sf: str) -> DataFrame:
    """The first ten results of each query as JSON."""
    return R.responses(fused(spark, sf))


_FIRST = f"""{DENSE},
firsts AS (SELECT dq.query_id, min(rank) AS first FROM dq LEFT JOIN (SELECT dense.query_id, rank FROM dense JOIN embeddings ON vec_id = chunk_id JOIN dq ON dq.query_id = dense.query_id WHERE label = wanted_label AND vec_id <> own) h ON h.query_id = dq.query_id GROUP BY dq.query_id)"""


def _first(spark: SparkSession, sf: str) -> DataFrame:
    q = dense_queries(spark, sf)
    relevant = vectors(spark, sf).join(checked_broadcast(q.select("query_id", "label", "own")), "label").where(F.col("chunk_id") != F.col("own")).select("query_id", "chunk_id")
    return R.first_relevant(dense(spark, sf), relevant, q)


@registry.query(f"""WITH {_FIRST}, s AS (SELECT count(*) AS queries, count(*) FILTER (WHERE first <= 5) AS hits, avg(coalesce(1 / first, 0)) AS mrr FROM firsts)
SELECT queries, hits, hits / queries AS recall, round(mrr, 9) AS mrr,
round(greatest(0, least((hits / queries + z * z / (2 * queries)) / (1 + z * z / queries) - z / (1 + z * z / queries) * sqrt(hits / queries * (1 - hits / queries) / queries + z * z / (4 * queries * queries)), hits / queries)), 9) AS low,
round(greatest(least(1, (hits / queries + z * z / (2 * queries)) / (1 + z * z / queries) + z / (1 + z * z / queries) * sqrt(hits / queries * (1 - hits / queries) / queries + z * z / (4 * queries * queries))), hits / queries), 9) AS high FROM s, (SELECT CAST({stats.Z95} AS DOUBLE) AS z)""")
def recall_mrr(spark: SparkSession, sf: str) -> DataFrame:
    """Recall at 5 with its Wilson interval, and the mean reciprocal rank; relevant is what shares the label."""
    out = R.quality(_first(spark, sf), 5)
    return out.select("queries", "hits", "recall", *(F.round(c, 9).alias(c) for c in ("mrr", "low", "high")))


@registry.query(f"""WITH {_FIRST} SELECT query_id, CAST(first AS BIGINT) AS first_rank, coalesce(1 / first, 0) AS reciprocal, coalesce(first <= 5, false) AS hit FROM firsts""")
def per_query_quality(spark: SparkSession, sf: str) -> DataFrame:
    return _first(spark, sf).select("query_id", F.col("first").cast("long").alias("first_rank"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal"), F.coalesce(F.col("first") <= 5, F.lit(False)).alias("hit"))


@registry.query()
def bootstrap_interval(spark: SparkSession, sf: str) -> DataFrame:
    """A seeded percentile interval of the mean reciprocal rank; SQL has no such resampling, a test checks it."""
    return R.bootstrap(_first(spark, sf).select(F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("r")), "r")


_NUMBERS = """printed AS (SELECT p_partkey AS chunk_id, upper(substr(p_type, 1, 3)) || '-' || lpad(CAST(p_partkey % 500 AS VARCHAR), 5, '0') || ' ' || p_name AS body_text FROM part),
ask AS (SELECT * FROM (VALUES ('i1', 'need PRO-00042, STA-00008 and ECO-00000, PRO-00042 again; LAR-00010 MED-00012 SMA-00002 STA-00014 PRO-00016'), ('i2', 'nothing here')) AS t(query_id, text))"""


@registry.query(f"""WITH {_NUMBERS}, a AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(text, '{text.PART_NUMBER}')) AS token FROM ask), b AS (SELECT DISTINCT chunk_id, unnest(regexp_extract_all(body_text, '{text.PART_NUMBER}')) AS token FROM printed)
SELECT query_id, chunk_id, token FROM a JOIN b USING (token) WHERE chunk_id % 2 = 0""")
def identifier_route(spark: SparkSession, sf: str) -> DataFrame:
    """Parts that print an identifier asked for, without those that the ranking has found (odd ids here)."""
    part = table(spark, sf, "part")
    printed = part.select(F.col("p_partkey").alias("chunk_id"), F.concat(F.upper(F.substring("p_type", 1, 3)), F.lit("-"), F.lpad((F.col("p_partkey") % 500).cast("string"), 5, "0"), F.lit(" "), F.col("p_name")).alias("body_text"))
    asked = spark.createDataFrame([("i1", "need PRO-00042, STA-00008 and ECO-00000, PRO-00042 again; LAR-00010 MED-00012 SMA-00002 STA-00014 PRO-00016"), ("i2", "nothing here")], "query_id string, text string")
    found = printed.where("chunk_id % 2 = 1").select(F.lit("i1").alias("query_id"), "chunk_id")
    return R.identifier_route(asked, printed, found).select("query_id", "chunk_id", "token")


@registry.query("SELECT label, count(*) AS n, count(*) FILTER (WHERE len(embedding) <> 64) AS wrong_width, round(max(abs(sqrt(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE)))) - 1)), 4) AS worst FROM embeddings GROUP BY label")
def vector_profile(spark: SparkSession, sf: str) -> DataFrame:
    """Width and length of the stored vectors by label."""
    e = F.col("embedding")
    return table(spark, sf, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.sum((F.size(e) != 64).cast("long")).alias("wrong_width"), F.round(F.max(F.abs(F.sqrt(arrays.dot(e, e)) - 1)), 4).alias("worst"))


@registry.query("SELECT lang, count(*) AS n, avg(CAST(regexp_matches(text, '[A-Z]{2,4}-[0-9]{4,6}') AS INTEGER)) AS with_identifier, avg(CAST(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)) = '' AS INTEGER)) AS blank_share FROM documents GROUP BY lang")
def weighted_field_emptiness(spark: SparkSession, sf: str) -> DataFrame:
    """Share of passages whose weighted fields are blank, by layer."""
    return table(spark, sf, "documents").groupBy("lang").agg(F.count("*").alias("n"), F.avg(F.col("text").rlike("[A-Z]{2,4}-[0-9]{4,6}").cast("int")).alias("with_identifier"), F.avg(text.blank(F.col("text")).cast("int")).alias("blank_share"))


_BLOCKS = "SELECT vec_id, label, embedding FROM embeddings"


@registry.query(f"""WITH pairs AS (SELECT a.label, a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
WHERE {_DOT.format(a='a.embedding', b='b.embedding')} / (sqrt({_DOT.format(a='a.embedding', b='a.embedding')}) * sqrt({_DOT.format(a='b.embedding', b='b.embedding')})) >= 0.3) SELECT label, count(*) AS n, count(DISTINCT a) AS left_members FROM pairs GROUP BY label""")
def near_vector_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of one label at a cosine of 0.3 or more.

    A label may hold most vectors: it is dealt out as pairs of blocks, each a task, and a pair of vectors meets in one.
    """
    out = partner_counts(table(spark, sf, "embeddings"), key="label", id_col="vec_id", vector="embedding", floor=0.3)
    return out.groupBy("label").agg(F.sum("n").alias("n"), F.count("*").alias("left_members"))


# ---------------------------------------------------------------- stemmed search over weighted fields

#: What stands before the first full stop or line break of a passage is its heading.
_HEADING = r"^[^.\n]*"
#: Lexemes of its heading that a passage is searched by.
_ASKED_LEXEMES = 2


def weighted_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as chunks of four fields: heading (A), part numbers (B), section (C), body (D)."""
    body = F.coalesce("text", F.lit(""))
    heading = F.regexp_extract(body, _HEADING, 0)
    return table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), heading.alias("heading"), F.array_join(text.part_numbers(body), " ").alias("numbers"), F.col("source").alias("section"), F.substring(body, F.length(heading) + 1, F.length(body)).alias("body"))


_FIELDS = {"A": "heading", "B": "numbers", "C": "section", "D": "body"}


def _asked(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Stems of the first two lexemes of the heading of every hundredth passage, for one query of each set of stems, and the queries that are alike."""
    queries = chunks.where(F.col("chunk_id") % DENSE_STEP == 0).select(F.col("chunk_id").alias("query_id"), F.slice(X.lexemes(X.tokens(F.col("heading"))), 1, _ASKED_LEXEMES).alias("terms"))
    return X.alike(materialize(X.asked_stems(queries), "asked"))


def _matches(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Passages that hold all stems asked for, and the queries that are alike."""
    chunks = weighted_chunks(spark, sf)
    asked, home = _asked(chunks)
    found = materialize(X.postings(chunks, _FIELDS, asked.select("stem")), "postings")
    return X.matches(found, asked), home


def _weighted(spark: SparkSession, sf: str) -> DataFrame:
    chunks = weighted_chunks(spark, sf)
    asked, home = _asked(chunks)
    return X.answered(X.weighted_rank_best(chunks, _FIELDS, asked), home)


_STOPS = ", ".join(f"'{w}'" for w in stemming.STOP_WORDS)
_TOKENS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: t <> '')"
_LAST = f"coalesce(list_max(list_transform({{0}}, lambda t, i: CASE WHEN t NOT IN ({_STOPS}) THEN i END)), 0)"
_STEMMED = f"""
chunk AS (SELECT doc_id AS chunk_id, regexp_extract(coalesce(text, ''), '^[^.\n]*', 0) AS heading, array_to_string(list_distinct(regexp_extract_all(coalesce(text, ''), '{text.PART_NUMBER}')), ' ') AS numbers, coalesce(source, '') AS section, coalesce(text, '') AS whole FROM documents),
field AS (SELECT chunk_id, {_TOKENS.format('heading')} AS a, {_TOKENS.format('numbers')} AS b, {_TOKENS.format('section')} AS c, {_TOKENS.format('substr(whole, length(heading) + 1)')} AS d FROM chunk),
start AS (SELECT *, {_LAST.format('a')} AS la, {_LAST.format('b')} AS lb, {_LAST.format('c')} AS lc FROM field),
spot AS (SELECT chunk_id, unnest(a) AS term, unnest(range(1, len(a) + 1)) AS place, 'A' AS label FROM start UNION ALL SELECT chunk_id, unnest(b), unnest(range(1, len(b) + 1)) + la, 'B' FROM start
  UNION ALL SELECT chunk_id, unnest(c), unnest(range(1, len(c) + 1)) + la + lb, 'C' FROM start UNION ALL SELECT chunk_id, unnest(d), unnest(range(1, len(d) + 1)) + la + lb + lc, 'D' FROM start),
vocabulary AS (SELECT DISTINCT term FROM spot),
stemmed AS MATERIALIZED ({stemming.stems_sql('vocabulary')}),
asking AS (SELECT DISTINCT chunk_id AS query_id, stem FROM (SELECT chunk_id, unnest(list_filter(a, lambda t: t NOT IN ({_STOPS}))[1:{_ASKED_LEXEMES}]) AS term FROM field WHERE chunk_id % {DENSE_STEP} = 0) JOIN stemmed USING (term)),
hit AS (SELECT chunk_id, stem, least(place, {X.LAST_PLACE}) AS place, min(label) AS label FROM spot JOIN stemmed USING (term) WHERE stem IN (SELECT stem FROM asking) GROUP BY ALL),
posting AS (SELECT * FROM (SELECT chunk_id, stem, place, row_number() OVER (PARTITION BY chunk_id, stem ORDER BY place) AS k, CASE label {' '.join(f"WHEN '{v}' THEN CAST({w} AS DOUBLE)" for v, w in X.WEIGHTS.items())} END AS weight FROM hit) WHERE k <= {X.MOST_PLACES}),
wanted AS (SELECT query_id, count(*) AS wanted FROM asking GROUP BY query_id),
met AS (SELECT query_id, chunk_id, wanted FROM asking JOIN (SELECT DISTINCT chunk_id, stem FROM posting) USING (stem) JOIN wanted USING (query_id) GROUP BY ALL HAVING count(*) = wanted)"""
_BEST = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored) WHERE rank <= {}"


@registry.query(f"""WITH {_STEMMED}, counted AS (SELECT chunk_id, stem, count(*) AS n FROM posting GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(sum(n / (n + 1)), 9) AS score FROM met JOIN asking USING (query_id) JOIN counted USING (chunk_id, stem) GROUP BY ALL) {_BEST.format(X.DEPTH)}""")
def stemmed_topk(spark: SparkSession, sf: str) -> DataFrame:
    """All passages that hold the stems of a query's words, stop words aside."""
    met, home = _matches(spark, sf)
    return X.answered(X.stemmed_topk(met), home).withColumn("score", F.round("score", 6))


_WEIGHTED = f"""{_STEMMED}, own AS (SELECT query_id, chunk_id, wanted, stem, place, k, weight FROM met JOIN asking USING (query_id) JOIN posting USING (chunk_id, stem)),
one AS (SELECT query_id, chunk_id, (max(weight) + sum(weight / (k * k)) - max(weight) / pow(min(k) FILTER (WHERE weight = top), 2)) / {X.SQUARES} AS score FROM (SELECT *, max(weight) OVER (PARTITION BY query_id, chunk_id) AS top FROM own WHERE wanted = 1) GROUP BY ALL),
pair AS (SELECT a.query_id, a.chunk_id, abs(a.place - b.place) AS apart, a.weight * b.weight AS w FROM own a JOIN own b ON a.query_id = b.query_id AND a.chunk_id = b.chunk_id AND a.stem < b.stem AND a.place <> b.place),
several AS (SELECT query_id, chunk_id, 1 - exp(sum(ln(1 - sqrt(w * CASE WHEN apart > {X.FAR} THEN CAST({X.AT_FAR} AS DOUBLE) ELSE 1 / ({X.NEAR} + {X.SLOPE} * exp(apart / {X.SCALE} - {X.SHIFT})) END)))) AS score FROM pair GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, round(score, 9) AS score FROM one UNION ALL SELECT query_id, chunk_id, round(coalesce(score, 0), 9) FROM (SELECT query_id, chunk_id FROM met WHERE wanted > 1) LEFT JOIN several USING (query_id, chunk_id))"""


@registry.query(f"WITH {_WEIGHTED} {_BEST.format(X.DEPTH)}")
def weighted_rank_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The same passages by the weights of the fields that hold the words and the distances between them."""
    return _weighted(spark, sf).withColumn("score", F.round("score", 6))


@registry.query(f"""WITH {_WEIGHTED}, {DENSE},
l AS (SELECT 'v' || query_id AS query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM scored QUALIFY rank <= {R.DEPTH}),
met_by AS (SELECT query_id, chunk_id, l.rank AS lexical_rank, dense.rank AS dense_rank FROM l FULL JOIN dense USING (query_id, chunk_id)),
fused AS (SELECT *, round(coalesce(CAST(1.0 AS DOUBLE) / (60 + lexical_rank), 0) + coalesce(CAST(1.0 AS DOUBLE) / (60 + dense_rank), 0), 12) AS score FROM met_by)
SELECT * FROM (SELECT query_id, chunk_id, coalesce(lexical_rank, 0) AS lexical_rank, coalesce(dense_rank, 0) AS dense_rank, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM fused) WHERE rank <= {R.DEPTH}""")
def hybrid_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Every hundredth passage searched for by the stems of its heading and by its vector, both arms fused by rank."""
    weighted = _weighted(spark, sf).withColumn("query_id", F.concat(F.lit("v"), F.col("query_id").cast("string")))
    out = R.fuse(weighted, dense(spark, sf))
    return out.select("query_id", "chunk_id", F.coalesce(F.col("l").cast("long"), F.lit(0)).alias("lexical_rank"), F.coalesce(F.col("d").cast("long"), F.lit(0)).alias("dense_rank"), "score", "rank")

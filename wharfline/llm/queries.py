"""The queries of this subpackage, by name, and the SQL that some of them must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.session import table

from . import automaton, bpe, decontam, divergence, licenses, lines, neardup, quality, sharding, spelling, syncmers, toxicity

Query = Callable[[SparkSession, str], DataFrame]


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents: 3-word shingles, 85 / 100."""
    return neardup.near_duplicates(table(spark, sf_dir, "documents"), shingle_words=3, similarity=(85, 100))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shuffled shards by the law ``key``, with the shard among 17."""
    out = sharding.shuffled_shards(table(spark, sf_dir, "documents"), shards=16)
    text = F.coalesce(F.col("record.text"), F.lit(""))
    grown = sharding.shard_of(F.col("record.doc_id"), 17, 17)
    return out.select(F.col("record.doc_id").alias("doc_id"), "size", F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.lit("key").alias("law"), "shard", "slot", grown.alias("grown_shard"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold 80 of 100 five-word shingles of a benchmark item."""
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License notices, headers and whole texts in all documents."""
    return licenses.license_matches(table(spark, sf_dir, "documents"))


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages freed of the lines that more than a tenth of the pages of their host contain."""
    pages = table(spark, sf_dir, "pages").select("page_id", lines.host_of(F.col("url")).alias("host"), lines.html_lines(F.col("html")).alias("text"))
    out = lines.drop_boilerplate(pages, host_col="host", text_col="text")
    return out.select("page_id", "host", "n_lines", "n_dropped", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


def op4_bpe_encode_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded bytes of all documents under the 50k byte-level ranks, as digests."""
    import public_tokenizers

    return bpe.encode_decode(table(spark, sf_dir, "documents"), ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of all documents, learnt from the labels outside fold 0 of 5."""
    docs = table(spark, sf_dir, "documents")
    return quality.score_quality(docs, quality.train(docs, table(spark, sf_dir, "labels"), modulus=5, left_out=0), modulus=5, left_out=0, threshold=0.3)


def op8_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return syncmers.edited_fingerprints(table(spark, sf_dir, "documents"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of all documents, learnt from the labels outside fold 1 of 3."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels"), modulus=3, left_out=1), modulus=3, left_out=1, threshold=0.7)


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of all documents under the 50k byte-level tokenizer file."""
    import public_tokenizers

    return bpe.count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), limit=1024)


def op11_bpe_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids and decoded text of all documents by the automaton of the 50k byte-level tokenizer file, as digests."""
    import public_tokenizers

    return automaton.encode_decode(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, one in 199 runs of them damaged, with their near words, forms and roots."""
    return spelling.variants(spelling.word_counts(table(spark, sf_dir, "documents"), least_chars=6, least_count=5, damaged_every=199), times=5)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms that mark a source, over all documents."""
    return divergence.divergence(table(spark, sf_dir, "documents"), least_documents=30, most_terms=50)


def queries() -> dict[str, Query]:
    numbered = [op1_minhash_near_dedup, op2_sharding, op3_decontamination, op4_bpe_encode_decode, op5_license_scan, op6_line_dedup, op7_quality_classifier, op8_document_fingerprints, op9_toxicity, op10_token_counts]
    return {f.__name__: f for f in (*numbered, op11_bpe_automaton, op12_spelling_variants, op13_source_divergence)}


#: Words as the operators take them, in DuckDB: A-Z as a-z, split at space and 0x09-0x0D.
SQL_WORDS = "list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"


def sql_grams(k: int) -> str:
    """The k-word sequences of w in their order."""
    return f"list_transform(range(1, len(w) - {k - 2}), lambda x: array_to_string(w[x:x + {k - 1}], ' '))"


OP3_SQL = f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {SQL_WORDS} AS w FROM documents),
items AS (SELECT row_number() OVER () AS i, item_id, {SQL_WORDS} AS w FROM benchmark),
held AS (SELECT DISTINCT k, doc_id, unnest({sql_grams(5)}) AS s FROM docs),
wanted AS (SELECT i, item_id, len(g) AS n, unnest(g) AS s FROM (SELECT i, item_id, list_distinct({sql_grams(5)}) AS g FROM items)),
shared AS (SELECT k, doc_id, i, item_id, n, count(*) AS c FROM held JOIN wanted USING (s) GROUP BY ALL HAVING 100 * c >= 80 * n)
SELECT doc_id, item_id, n AS n_item_shingles, c AS n_shared, c / n AS containment FROM shared QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY c / n DESC, c DESC) = 1
"""


def _op5_sql() -> str:
    sized = {name: (min(len(text.split()), 5), text) for name, text in (licenses.TEMPLATES | licenses.whole_texts()).items()}
    values = ", ".join("('%s', %d, '%s')" % (name, width, text.replace("'", "''")) for name, (width, text) in sorted(sized.items()))
    widths = sorted({width for width, _ in sized.values()})
    grams = lambda w: sql_grams(w)
    held = " UNION ALL ".join(f"SELECT k, doc_id, {w} AS width, unnest({grams(w)}) AS s, generate_subscripts({grams(w)}, 1) - 1 AS place FROM docs" for w in widths)
    wanted = " UNION ALL ".join(f"SELECT template, width, list_distinct({grams(w)}) AS g FROM notices WHERE width = {w}" for w in widths)
    return f"""
WITH docs AS (SELECT row_number() OVER () AS k, doc_id, {SQL_WORDS} AS w FROM documents),
notices AS (SELECT template, width, {SQL_WORDS} AS w FROM (VALUES {values}) AS v(template, width, text)),
held AS ({held}),
wanted AS (SELECT template, width, len(g) AS n, unnest(g) AS s FROM ({wanted})),
shared AS (SELECT k, doc_id, template, n, count(DISTINCT s) AS c, min(place) AS place FROM held JOIN wanted USING (width, s) GROUP BY ALL HAVING 100 * c >= 80 * n)
SELECT doc_id, template, n AS n_template_shingles, c AS n_shared, place AS first_word, c / n AS containment FROM shared
"""


def _bare_sql(column: str) -> str:
    return f"trim({column}, ' ' || chr(9) || chr(13) || chr(12))"


OP6_SQL = f"""
WITH raw AS (SELECT row_number() OVER () AS k, page_id, nullif(lower(regexp_extract(url, '{lines.HOST}', 1)), '') AS host,
  array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(html, '{lines.UNSEEN}', '', 'g'), '{lines.BREAKS}', chr(10), 'g'), '{lines.TAGS}', '', 'g'), chr(10)), lambda x: {_bare_sql("x")} <> ''), chr(10)) AS text FROM pages),
split AS (SELECT k, page_id, host, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM raw),
bare AS (SELECT *, {_bare_sql("line")} AS b FROM split),
totals AS (SELECT host, count(*) AS pages FROM raw WHERE host IS NOT NULL GROUP BY host),
common AS (SELECT host, b FROM (SELECT host, b, count(DISTINCT k) AS n FROM bare WHERE b <> '' AND host IS NOT NULL GROUP BY host, b) JOIN totals USING (host) WHERE n >= {lines.LEAST_PAGES} AND n > CAST({lines.RATIO} AS DOUBLE) * pages),
marked AS (SELECT bare.*, common.b IS NOT NULL AS out FROM bare LEFT JOIN common ON bare.host = common.host AND bare.b = common.b)
SELECT any_value(page_id) AS page_id, any_value(host) AS host, count(*) AS n_lines, count(*) FILTER (WHERE out) AS n_dropped, md5(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT out), '')) AS text_md5 FROM marked GROUP BY k
"""


#: DuckDB has no CRC-32: the register after a byte and d more zero bytes, by byte and d, and after the start alone, whose exclusive or it is.
OP12_SQL = """
WITH RECURSIVE runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]+')) AS run FROM documents),
counted AS (SELECT id, run, count(*) AS n, hex(encode(id || ':' || run)) AS digits FROM runs WHERE length(run) >= 6 GROUP BY ALL),
bit(b, k, v) AS (SELECT range, 0, range FROM range(256) UNION ALL SELECT b, k + 1, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END FROM bit WHERE k < 8),
one AS (SELECT b, v FROM bit WHERE k = 8),
longest AS (SELECT max(length(digits)) // 2 AS m FROM counted),
register(b, d, v) AS (SELECT b, 0, v FROM one UNION ALL SELECT r.b, d + 1, xor(r.v >> 8, one.v) FROM register r JOIN one ON one.b = r.v & 255 WHERE d < (SELECT m FROM longest)),
start(d, v) AS (SELECT 0, 4294967295 UNION ALL SELECT d + 1, xor(s.v >> 8, one.v) FROM start s JOIN one ON one.b = s.v & 255 WHERE d < (SELECT m FROM longest)),
bytes AS (SELECT id, run, len(digits) // 2 AS size, unnest(range(len(digits) // 2)) AS i, digits FROM counted),
valued AS (SELECT id, run, size, size - 1 - i AS d, 16 * (instr('0123456789ABCDEF', substr(digits, 2 * i + 1, 1)) - 1) + instr('0123456789ABCDEF', substr(digits, 2 * i + 2, 1)) - 1 AS b FROM bytes),
summed AS (SELECT id, run, any_value(size) AS size, bit_xor(v) AS v FROM valued JOIN register USING (b, d) GROUP BY id, run),
hashed AS (SELECT id, run, xor(xor(summed.v, start.v), 4294967295) AS h FROM summed JOIN start ON start.d = summed.size),
results AS (SELECT CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM counted JOIN hashed USING (id, run)),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
cuts AS (SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS cut FROM (SELECT *, unnest(range(length(word))) AS i FROM words)),
indels AS (SELECT DISTINCT c.word AS x, c.n AS xn, w.word AS y, w.n AS yn FROM cuts c JOIN words w ON w.word = c.cut),
near AS (SELECT a.word AS x, b.word AS y, b.n AS yn FROM cuts a JOIN cuts b USING (i, cut) WHERE a.word <> b.word UNION ALL SELECT x, y, yn FROM indels UNION ALL SELECT y, x, xn FROM indels),
best AS (SELECT x, count(*) AS n_near, first(y ORDER BY yn DESC, y) AS y, max(yn) AS yn FROM near GROUP BY x),
forms AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN yn >= 5 * n THEN y END AS form, CASE WHEN yn >= 5 * n THEN yn END AS form_n FROM words LEFT JOIN best ON best.x = words.word),
walk(word, reached, step) AS (SELECT word, word, 0 FROM forms UNION ALL SELECT walk.word, f.form, step + 1 FROM walk JOIN forms f ON f.word = walk.reached WHERE f.form IS NOT NULL),
roots AS (SELECT word, last(reached ORDER BY step) AS root FROM walk GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM forms JOIN roots USING (word)
"""

OP13_SQL = """
WITH docs AS (SELECT coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source, row_number() OVER () AS k FROM documents),
found AS (SELECT k, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term FROM found GROUP BY ALL HAVING count(DISTINCT k) >= 30),
sizes AS (SELECT lang, count(*) AS v FROM kept GROUP BY lang),
sources AS (SELECT DISTINCT lang, source FROM docs),
seen AS (SELECT lang, source, term, count(*) AS c FROM found JOIN kept USING (lang, term) GROUP BY ALL),
dense AS (SELECT s.lang, s.source, k.term, coalesce(c, 0) AS c, v FROM sources s JOIN kept k USING (lang) JOIN sizes USING (lang) LEFT JOIN seen USING (lang, source, term)),
shares AS (SELECT lang, source, term, c, 1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * v) AS p FROM dense),
whole AS (SELECT lang, term, 1 + (CAST(1000000000 AS HUGEINT) * (sum(c) + 5)) // (sum(sum(c)) OVER (PARTITION BY lang) + 5 * any_value(v)) AS q FROM dense GROUP BY lang, term),
apart AS (SELECT a.lang, a.source, b.source AS item, coalesce(sum(abs(x.p - y.p)), 0) AS value FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN shares x ON x.lang = a.lang AND x.source = a.source LEFT JOIN shares y ON y.lang = b.lang AND y.source = b.source AND y.term = x.term GROUP BY ALL),
own AS (SELECT lang, source, term AS item, p - q AS value FROM shares JOIN whole USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM
  (SELECT lang, source, 'pair' AS part, item, value FROM apart UNION ALL SELECT lang, source, 'term', item, value FROM own))
SELECT * FROM ranked WHERE part = 'pair' OR rank <= 50
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_decontamination": OP3_SQL, "op5_license_scan": _op5_sql(), "op6_line_dedup": OP6_SQL, "op12_spelling_variants": OP12_SQL, "op13_source_divergence": OP13_SQL}

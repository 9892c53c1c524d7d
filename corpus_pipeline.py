"""The corpus pipeline: raw documents to token digests in five stages.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept.  All but the last
return the columns of ``docs``.  Edge cases follow the operators: a null or blank text has no quality and is
rejected by the first stage, so the others meet such texts only where they are called by themselves.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wharfline.llm import bpe, decontam, lines, neardup, quality
from wharfline.session import ship_code, table
from wharfline.shared import materialize

#: SQL can't express the classifier's field; the stages are tested by themselves.
ORACLE_SQL = None


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the field finds good; it is fitted on the labelled documents outside fold 0 of 5."""
    field = quality.train(docs, table(spark, sf_dir, "labels"), modulus=5, left_out=0)
    return quality.keep_good(docs, field, threshold=0.3)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that more than a tenth of the documents of their source hold; n_chars follows."""
    return lines.drop_boilerplate(docs, host_col="source", text_col="text", counts=False, length_col="n_chars")


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class (five-word shingles, similarity 0.8 or more)."""
    ship_code(spark)
    return neardup.keep_one_of_each(docs, shingle_words=5, similarity=(80, 100))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold less than 0.8 of the five-word shingles of every benchmark item."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def bpe_encode_decode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded bytes."""
    import public_tokenizers

    ship_code(spark)
    return bpe.encode_decode(docs, ranks_path=public_tokenizers.path("byte_bpe_50k.tiktoken"), pattern=public_tokenizers.PATTERN)


STAGES = [
    ("quality_classifier", quality_classifier),
    ("line_dedup", line_dedup),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("bpe_encode_decode", bpe_encode_decode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

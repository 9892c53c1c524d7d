"""A bounded sample of labelled documents for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def crc_of(column: Column) -> Column:
    """CRC-32 of the decimal text of an id; null for null."""
    return F.crc32(F.encode(column.cast("string"), "UTF-8"))


def sample(docs: DataFrame, labels: DataFrame, *, label: str, modulus: int, left_out: int, most: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, y, text) of at most ``most`` labelled documents outside the held-out fold, drawn by a hash of the id.

    The fold is crc32(id as text) mod ``modulus`` = ``left_out``.  Ids with several labels take the least; null
    labels and ids are no labels; of rows that repeat an id one is used.
    """
    known = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).dropna()
    known = known.where(crc_of(F.col("doc_id")) % modulus != left_out).groupBy("doc_id").agg(F.min("y").alias("y"))
    # a labelled id may have no document; so the semi-join comes first
    present = docs.select(F.col(id_col).cast("long").alias("doc_id"))
    chosen = known.join(present, "doc_id", "left_semi").orderBy(F.xxhash64("doc_id", F.lit(5)), "doc_id").limit(most)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    # a proven bound: ``most`` rows of two numbers
    return texts.join(F.broadcast(chosen), "doc_id").select("doc_id", "y", "text").groupBy("doc_id", "y").agg(F.max("text").alias("text"))

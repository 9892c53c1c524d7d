"""Manifests of a corpus: entries read with a fixed schema, digests recomputed from the files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wharfline.functions import text

ENTRY = "location string, layer string, content_hash string, license_basis struct<spdx: string, source: string>"
SCHEMA = f"layer string, entries array<struct<{ENTRY}>>"


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    """One row for each entry of the JSON manifests below ``path``: manifest (its file), layer, and the entry's fields; broken files give a row with nulls."""
    raw = spark.read.schema(SCHEMA + ", _corrupt_record string").option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(path)
    named = raw.withColumn("manifest", F.input_file_name())
    return named.select("manifest", F.col("layer").alias("manifest_layer"), F.col("_corrupt_record").isNotNull().alias("is_broken"), F.explode_outer("entries").alias("e")).select("manifest", "manifest_layer", "is_broken", "e.*")


def read_fixtures(spark: SparkSession, path: str) -> DataFrame:
    """(file, body, refusal) of the JSON fixtures below ``path``; what is refused is for the caller to act on, null is fit to be digested."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").load(path)  # a text reader would take the byte-order mark away
    body = F.col("content").cast("string")
    return raw.select(F.col("path").alias("file"), body.alias("body"), F.when(~F.is_valid_utf8(body), "not UTF-8").otherwise(text.json_refusal(body)).alias("refusal"))


def read_files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file, digest, bytes) of the files below ``path``; contents stay on the executors."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(path)
    return files.select(F.col("path").alias("file"), F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("digest"), F.col("length").alias("bytes"))


def verified(entries: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """(location, file, status): match, diverged, missing (an entry without a file) or undeclared (a file without an entry)."""
    held = files.withColumn("location", F.expr(f"substring_index(file, '{root.rstrip('/')}/', -1)"))
    both = entries.where("location is not null").select("location", "content_hash").join(held.select("location", "digest", "file"), "location", "full")
    status = F.when(F.col("digest").isNull(), "missing").when(F.col("content_hash").isNull(), "undeclared").when(F.col("digest") == F.col("content_hash"), "match").otherwise("diverged")
    return both.select("location", "file", status.alias("status"))

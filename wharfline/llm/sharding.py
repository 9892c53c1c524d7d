"""Sharding by a two-pass external shuffle (operator 2), in DataFrame functions only.

Pass one scatters all records by seeded hashes into buckets of about ``bucket_bytes``.  Pass two shuffles each bucket: a
seeded Fisher-Yates (Spark's ``shuffle``) permutes the numbers of its rows, and the rows take them in a sorted stream, so
that a task holds one bucket's numbers and no more records than its sort buffer.  The law is ``key``: the shard is a
function of the key and the number of shards alone (rendezvous hashing), so one more shard takes rows only into itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wharfline.shared import materialize

#: Text in a bucket, about, with ROW_BYTES for each row.
BUCKET_BYTES, ROW_BYTES = 8 << 20, 64
#: Tasks of pass two, at most; where there are more buckets, a task takes several, one after the other.
MOST_TASKS = 50_000
#: Copies of one row that are told apart at most, so that they can be scattered.
COPIED_ROWS = 100_000


def shard_of(key: Column, shards: int, seed: int = 0) -> Column:
    """Rendezvous hashing: the shard whose seeded hash of the key is greatest; ties go to the higher shard."""
    draws = F.array(*(F.struct(F.xxhash64(key, F.lit(seed), F.lit(s)).alias("draw"), F.lit(s).alias("shard")) for s in range(shards)))
    return F.array_max(draws)["shard"]


def _copied(rows: DataFrame, least: int) -> tuple[DataFrame, int]:
    """(row_hash) of rows whose copies fill a good part of a bucket, and their number; the part is raised until they are few."""
    copies = rows.groupBy("row_hash").agg(F.sum("size").alias("held"), F.count("*").alias("n")).where((F.col("n") > 1) & (F.col("held") >= least))
    copies = materialize(copies, "copies")
    while (many := copies.where(F.col("held") >= least).count()) > COPIED_ROWS:
        least *= 2
    return copies.where(F.col("held") >= least).select("row_hash"), many


def shuffled_shards(docs: DataFrame, *, shards: int = 16, seed: int = 17, bucket_bytes: int = BUCKET_BYTES, key_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` as a struct ``record``, with size, shard, bucket and slot (gapless from 0 in each shard).

    size is the UTF-8 length of the text plus 1 (null: 1).  Rows are scattered by a hash of key and text, so rows that
    share a key share its shard and nothing else.  The order is a function of seed, keys and texts, not of partitioning:
    a bucket is sorted before it is shuffled, so a task that runs again gives the same rows.  A null key is a key
    like others.  Rows that agree in key and text are exchangeable; where their copies would fill a bucket they are
    scattered by place, and pass one is then written, so that every reader sees one scatter.  Columns of ``docs`` may
    have any names and types, those of the result included; they stay inside ``record``.  An empty table gives an
    empty result.
    """
    record = F.struct(*(F.col(f"`{c}`") for c in docs.columns))
    plain = docs.select(F.col(f"`{key_col}`").alias("key"), F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)).cast("long").alias("n"), F.xxhash64(F.col(f"`{key_col}`"), F.col(f"`{text_col}`")).alias("row_hash"), record.alias("record"))
    rows = plain.select(shard_of(F.col("key"), shards, seed).alias("shard"), "row_hash", (F.col("n") + 1).alias("size"), "record")

    # the sizes of the shards alone decide on the number of buckets
    measured = rows.groupBy("shard").agg(F.sum(F.col("size") + ROW_BYTES).alias("bytes"))
    bytes_ = {r["shard"]: r["bytes"] for r in measured.collect()}  # a row for each shard
    buckets = [max(1, -(-bytes_.get(s, 0) // bucket_bytes)) for s in range(shards)]
    first = [sum(buckets[:s]) for s in range(shards)]
    tasks = min(sum(buckets), MOST_TASKS)
    of_shard = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("shard") + 1)

    copied, many = _copied(rows.select("row_hash", (F.col("size") + ROW_BYTES).alias("size")), bucket_bytes // 2)
    place: Column = F.lit(0).cast("long")
    if many:
        # a row hash is 8 bytes and there are COPIED_ROWS at most
        rows = rows.join(F.broadcast(copied.withColumn("copied", F.lit(True))), "row_hash", "left")
        place = F.when(F.col("copied"), F.monotonically_increasing_id()).otherwise(F.lit(0))
    bucket = F.pmod(F.xxhash64("row_hash", place, F.lit(seed + 1)), of_shard(buckets)).cast("int")
    scattered = rows.select("shard", bucket.alias("bucket"), (of_shard(first) + bucket).cast("int").alias("cell"), F.xxhash64("row_hash", F.lit(seed + 2)).alias("draw"), "row_hash", "size", "record")
    if many:
        scattered = materialize(scattered, "scattered")

    # a permutation of each bucket's row numbers, drawn in the bucket's own task
    counts = scattered.groupBy("shard", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("cell", "n", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))  # a row for each bucket of a shard
    dealt = starts.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).sortWithinPartitions("task", "cell")
    orders = dealt.select("task", "cell", "start", F.shuffle(F.sequence(F.lit(0), F.col("n").cast("int") - 1), F.lit(seed)).alias("order"))

    own = Window.partitionBy("task", "cell").orderBy("draw", "row_hash")
    numbered = scattered.withColumn("task", F.pmod("cell", F.lit(tasks)).cast("int")).repartitionById(tasks, F.col("task")).withColumn("at", F.row_number().over(own))
    out = numbered.join(orders, ["task", "cell"])
    return out.select("shard", "bucket", (F.col("start") + F.element_at("order", F.col("at"))).cast("long").alias("slot"), "size", "record")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the records of ``docs`` below ``path``, a folder ``shard=N`` for each shard, in the order of their slots within each file."""
    out = shuffled_shards(docs, **options)
    out.select("shard", "slot", "record.*").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

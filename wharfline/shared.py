"""Intermediate tables in the folder that the driver and all executors share, and joins that survive hot keys."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where none is set, one of our own on a single machine and an error on a cluster."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="wharfline-")
        atexit.register(shutil.rmtree, own, True)
        spark.sparkContext.setCheckpointDir(own)
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


_written: dict[int, tuple[DataFrame, str]] = {}


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table into the shared folder and read it again: the lineage ends there, and a lost executor costs no recomputation."""
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` has written and nothing reads any more."""
    for t in tables:
        held, path = _written.pop(id(t), (None, None))
        if held is t:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


#: Ids that a task may be given whole: 8 MB of longs.
FEW_IDS = 1_000_000


def by_ids(docs: DataFrame, id_col: str, ids: DataFrame, how: str) -> DataFrame:
    """left_semi or left_anti join of ``docs`` with a written table of distinct ids (one column, null equal to null).

    Up to FEW_IDS ids, counted first, go to the tasks and the texts stay where they are; more are joined by a shuffle.
    """
    few = ids.count() <= FEW_IDS
    side = F.broadcast(ids) if few else ids
    return docs.join(side, docs[id_col].eqNullSafe(side[ids.columns[0]]), how)


#: Rows of a table that one task takes, on average, where what it makes of them is much wider.
TASK_ROWS = 250_000


def shares(df: DataFrame, task_rows: int | None = None) -> int:
    """Into how many parts of about ``task_rows`` rows ``df`` is dealt; its rows are counted."""
    return max(1, -(-df.count() // (TASK_ROWS if task_rows is None else task_rows)))


def dealt(df: DataFrame, *keys: str, task_rows: int | None = None) -> DataFrame:
    """``df`` hashed by ``keys`` into partitions of about ``task_rows`` rows, which are counted, so that a task's share doesn't grow with the table."""
    return df.repartition(shares(df, task_rows), *keys)


#: Bytes of a side that a task may be given whole.
FEW_BYTES = 32 << 20


def width_of(schema: T.StructType) -> Column:
    """About the bytes that a row takes: texts by their length, arrays by that of their elements, all else 8."""

    def of(value: Column, kind: T.DataType) -> Column:
        if isinstance(kind, T.StringType | T.BinaryType):
            return F.coalesce(F.octet_length(value).cast("long"), F.lit(0)) + 16
        if isinstance(kind, T.StructType):
            return sum((of(value[f.name], f.dataType) for f in kind), F.lit(16).cast("long"))
        if isinstance(kind, T.ArrayType):
            return F.coalesce(F.aggregate(value, F.lit(24).cast("long"), lambda a, x: a + of(x, kind.elementType)), F.lit(24).cast("long"))
        if isinstance(kind, T.MapType):
            return of(F.map_entries(value), T.ArrayType(T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])))
        return F.lit(8).cast("long")

    return sum((of(F.col(f"`{f.name}`"), f.dataType) for f in schema), F.lit(16).cast("long"))


#: Bytes of a table that one task takes, on average, where it holds them in order.
TASK_BYTES = 32 << 20


def spread(df: DataFrame, *keys: str, task_bytes: int | None = None) -> DataFrame:
    """``df`` hashed by ``keys`` into partitions of about ``task_bytes`` bytes, which are measured, and into one for each core at least; ``df`` is computed for that."""
    held = df.agg(F.sum(width_of(df.schema))).first()[0] or 0
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, -(-held // (TASK_BYTES if task_bytes is None else task_bytes))), *keys)


def checked_broadcast(few: DataFrame, *, most_rows: int | None = None, most_bytes: int | None = None) -> DataFrame:
    """A side of a join that is meant to be small: given to the tasks if it has FEW_IDS rows and FEW_BYTES bytes at most, else left to a shuffle.

    Rows are counted and measured up to the first limit; the side is computed for that, so give it as a written table where it
    is dear.
    """
    most_rows, most_bytes = FEW_IDS if most_rows is None else most_rows, FEW_BYTES if most_bytes is None else most_bytes
    held = few.limit(most_rows + 1).agg(F.count("*").alias("rows"), F.sum(width_of(few.schema)).alias("bytes")).first()
    return F.broadcast(few) if held["rows"] <= most_rows and (held["bytes"] or 0) <= most_bytes else few


#: A key with so many rows is hot; what the tasks are given of hot keys has this many bytes at most.
HOT_ROWS, HOT_BYTES = 200, 8 << 20


def join_hot(rows: DataFrame, side: DataFrame, key: str, *, many: Column, width: Column | int = 64, how: str = "inner", hot_rows: int = HOT_ROWS, hot_bytes: int = HOT_BYTES) -> DataFrame:
    """Join ``rows`` with a written table ``side`` that has one row for each ``key``, whatever share of ``rows`` one key holds.

    ``many`` is a column of ``side``: how many of ``rows`` have the key.  Keys of ``hot_rows`` or more go to the tasks, so
    their rows stay where they are; the rest is joined by a shuffle, in which no key has more.  ``width`` is about the
    bytes of a row of ``side``: where the hot ones are more than ``hot_bytes``, the line between hot and cold is raised by
    doublings until they fit.  ``how`` is inner or left.  Both are read twice.
    """
    size = width if isinstance(width, Column) else F.lit(width)
    steps = [F.sum(F.when(many >= hot_rows << i, size)).alias(f"b{i}") for i in range(40)]
    held = side.agg(*steps).first()
    cut = hot_rows << next((i for i in range(40) if (held[f"b{i}"] or 0) <= hot_bytes), 40)
    if not (held["b0"] or 0) or side.where(many >= cut).isEmpty():
        return rows.join(side, key, how)
    hot, cold = F.broadcast(side.where(many >= cut)), side.where(~F.coalesce(many >= cut, F.lit(False)))
    return rows.join(hot, key, "inner").unionByName(rows.join(hot.select(key), key, "left_anti").join(cold, key, how))

"""Immutable runs below one folder, and the pointer to the active one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def exists(spark: SparkSession, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)


class RunStore:
    """Artifacts of a run are written first, the pointer last: a run that fails in between is never read.

    Layout: ``<root>/<artifact>/run_id=<id>`` and ``<root>/active/<version>``, each version one row; the highest is
    in force.  Readers filter by run id, so Spark prunes to that folder.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def publish(self, artifacts: dict[str, DataFrame], *, run_id: str | None = None, checks: DataFrame | None = None) -> str:
        """Write all artifacts of a run and make it active; ``checks`` with a row of status FAIL refuses it."""
        if checks is not None and checks.where("status = 'FAIL'").limit(1).count():
            raise ValueError("the run is refused: a blocking check failed")
        run_id = run_id or uuid.uuid4().hex
        for name, df in artifacts.items():
            df.write.parquet(f"{self.root}/{name}/run_id={run_id}")
        version = self._claim((self._pointers().agg(F.max("version")).first()[0] or 0) + 1 if exists(self.spark, f"{self.root}/active") else 1)
        self.spark.createDataFrame([(version, run_id)], "version long, run_id string").coalesce(1).write.mode("append").parquet(f"{self.root}/active")
        return run_id

    def _claim(self, version: int) -> int:
        """The first free version from ``version`` on: its claim is a file that only one publisher can create."""
        while True:
            path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/claims/{version}")
            if path.getFileSystem(self.spark._jsc.hadoopConfiguration()).createNewFile(path):
                return version
            version += 1

    def _pointers(self) -> DataFrame:
        return self.spark.read.schema("version long, run_id string").parquet(f"{self.root}/active")

    def active(self) -> str:
        """The run in force; two pointers of the highest version are an error."""
        top = self._pointers().orderBy(F.desc("version")).limit(2).collect()
        if not top:
            raise LookupError("no active run")
        if len(top) == 2 and top[0]["version"] == top[1]["version"]:
            raise ValueError("two active runs")
        return top[0]["run_id"]

    def read(self, name: str, run_id: str | None = None) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}").where(F.col("run_id") == (run_id or self.active()))


    def recorded(self, *names: str) -> dict[str, DataFrame]:
        """Artifacts of the run in force, each read by a join with the pointer: Spark prunes to that run's folders when it runs.

        The run id is never a literal of the plan, so one plan serves whichever run is active.
        """
        top = self._pointers().agg(F.max("version")).first()[0]
        if top is None:
            raise LookupError("no active run")
        pointer = self._pointers().where(F.col("version") == top).select("run_id")  # one row
        return {n: self.spark.read.parquet(f"{self.root}/{n}").join(F.broadcast(pointer), "run_id") for n in names}


def append_unseen(new: DataFrame, path: str, keys: list[str], *, batch: str | None = None) -> int:
    """Insert-if-absent into a Parquet table: appends the rows whose key is not there yet, and returns how many.

    With ``batch`` the rows become the folder ``batch=<name>`` of the table, written anew when the batch is replayed,
    and are compared with the other batches only: a replay stores what the first run stored.
    """
    from wharfline.operators.ledger import unseen

    spark = new.sparkSession
    fresh = new.dropDuplicates(keys)
    if exists(spark, path):
        held = spark.read.parquet(path)
        if batch is not None and "batch" in held.columns:
            held = held.where(F.col("batch").cast("string") != batch)
        fresh = unseen(new, held, keys) if set(keys) <= set(held.columns) else fresh
    fresh = fresh.cache()
    n = fresh.count()
    if batch is not None:
        fresh.write.mode("overwrite").parquet(f"{path}/batch={batch}")
    elif n:
        fresh.write.mode("append").parquet(path)
    fresh.unpersist()
    return n


def json_report(metrics: DataFrame, path: str) -> None:
    """A small table of figures as one JSON file."""
    metrics.coalesce(1).write.mode("overwrite").json(path)

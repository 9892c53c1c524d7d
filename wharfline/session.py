"""Sessions and table access."""

from __future__ import annotations

import io
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

PACKAGE = Path(__file__).resolve().parent
_shipped: set[str] = set()
#: Bytes of an Arrow batch between Spark and Python, and Spark's own default, in whose place it is set.
ARROW_BYTES, ARROW_KEY, ARROW_DEFAULT = 4 << 20, "spark.sql.execution.arrow.maxBytesPerBatch", "67108864b"


def session(app: str = "wharfline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the queries assume: UTC, adaptive plans.  Everything else is the cluster's."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("_", "."), value)
    return (builder.master(master) if master else builder).getOrCreate()


def ship_code(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, so that functions in tasks can be imported there.

    Then also bounds Arrow batches by bytes in this session, unless the user has: rows of long texts else fill memory on
    both sides.  A setting made later is left alone.
    """
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    _shipped.add(app)
    if spark.conf.get(ARROW_KEY, None) == ARROW_DEFAULT:
        spark.conf.set(ARROW_KEY, str(ARROW_BYTES))
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(PACKAGE.rglob("*.py")):
            z.write(p, p.relative_to(PACKAGE.parent))
    path = Path(tempfile.mkdtemp(prefix="wharfline-code-")) / "wharfline.zip"
    path.write_bytes(held.getvalue())
    spark.sparkContext.addPyFile(str(path))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of a folder, by Spark's own reader."""
    ship_code(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

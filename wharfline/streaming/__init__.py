"""A streaming form of the spool drain: each micro-batch is stored once, however often it is replayed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from wharfline.operators.ledger import drain
from wharfline.sources.runs import append_unseen


def drain_stream(spool: DataFrame, ledger_path: str, retained_path: str, checkpoint: str) -> StreamingQuery:
    """Drain a stream of spooled rows into the ledger; rows that can't be stored go to ``retained_path`` and stop nothing.

    Both tables are written by batch number, so a batch that is replayed replaces what it wrote.
    """

    def batch(rows: DataFrame, number: int) -> None:
        rows = rows.cache()
        none = rows.select("invocation_id").limit(0)
        fit, kept = drain(rows, none)
        append_unseen(fit, ledger_path, ["invocation_id"], batch=str(number))
        kept.write.mode("overwrite").parquet(f"{retained_path}/batch={number}")
        rows.unpersist()

    return spool.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Similarity within a key, in blocks: each pair of chunks of a key is one task with a matrix product.

What leaves a task grows with the rows of its block and not with their pairs: a count for each row, or the edges of a
spanning forest.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wharfline.shared import checked_broadcast

BLOCK_ROWS = 1024


def _dealt(rows: DataFrame, key: str, id_col: str, vector: str, block_rows: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """(key, id, v, carried columns, chunk, i, j): each row once for every chunk of its key, so that any two rows of a key meet in block (i, j)."""
    sizes = rows.groupBy(key).agg(F.ceil(F.count("*") / block_rows).cast("int").alias("chunks"))
    placed = rows.select(key, F.col(id_col).alias("id"), F.col(vector).alias("v"), *carry).join(checked_broadcast(sizes), key).withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)).alias("other")
    return placed.select(key, "id", "v", *carry, "chunk", other).select(key, "id", "v", *carry, "chunk", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"))


def _units(table: pa.Table) -> np.ndarray:
    m = np.array(table.column("v").to_pylist(), dtype=np.float64)
    return m / np.maximum(np.sqrt((m * m).sum(axis=1, keepdims=True)), 1e-300)


def partner_counts(rows: DataFrame, *, key: str, id_col: str, vector: str, floor: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, id, n): for each row how many of its key with a greater id have a cosine of ``floor`` or more with it; rows with none are left out."""

    def block(table: pa.Table) -> pa.Table:
        ids, chunk, m = table.column("id").to_numpy(), table.column("chunk").to_numpy(), _units(table)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        near = m[left] @ m[right].T >= floor
        first = ids[left][:, None] < ids[right][None, :]
        # in a block of one chunk with itself every pair is there both ways round
        n = np.bincount(left, (near & first).sum(axis=1), len(ids))
        if i != j:
            n += np.bincount(right, (near & (ids[left][:, None] > ids[right][None, :])).sum(axis=0), len(ids))
        some = np.flatnonzero(n)
        return pa.table({key: table.column(key).take(pa.array(some)), "id": ids[some], "n": n[some].astype(np.int64)})

    kind = rows.schema[key].dataType.simpleString()
    found = _dealt(rows, key, id_col, vector, block_rows).groupBy(key, "i", "j").applyInArrow(block, f"{key} {kind}, id long, n long")
    return found.groupBy(key, "id").agg(F.sum("n").alias("n"))


def similar_forest(rows: DataFrame, *, key: str, id_col: str, vector: str, floor: float, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, cosine): edges between rows of one key that have the same components as all pairs do, at any cosine from ``floor`` up.

    A block gives the edges of its greatest spanning forest: whatever two rows of it are joined by at a threshold, the
    forest joins them by edges that pass it too.  A block of n rows gives fewer than n edges.
    """

    def block(table: pa.Table) -> pa.Table:
        ids, m = table.column("id").to_numpy(), _units(table)
        near = m @ m.T
        n = len(ids)
        outside, best, via = np.ones(n, dtype=bool), np.full(n, -np.inf), np.zeros(n, dtype=np.int64)
        a, b, cosine = [], [], []
        for _ in range(n):
            at = int(np.argmax(np.where(outside, best, -np.inf)))
            if best[at] >= floor and outside[at]:
                a.append(ids[via[at]])
                b.append(ids[at])
                cosine.append(best[at])
            else:  # nothing is near the tree: another begins
                at = int(np.argmax(outside))
            outside[at] = False
            nearer = near[at] > best
            best[nearer], via[nearer] = near[at][nearer], at
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "cosine": pa.array(cosine, pa.float64())})

    dealt = _dealt(rows, key, id_col, vector, block_rows)
    return dealt.groupBy(key, "i", "j").applyInArrow(block, "a long, b long, cosine double")


def cause_counts(rows: DataFrame, *, causes: list[str], id_col: str, vector: str, floors: tuple[float, ...], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(cause, floor, n): pairs of rows that share a column of ``causes`` and have a cosine of ``floor`` or more, each under the first one they share.

    A pair meets in a block of every column that it shares, and each block leaves out the pairs that share an earlier
    column; so nothing is attributed twice, no pair leaves a task, and a block gives one count for each floor.  Nulls
    share nothing.  A cause without pairs has no row.
    """
    out = None
    for at, cause in enumerate(causes):
        earlier = tuple(causes[:at])
        dealt = _dealt(rows.where(F.col(cause).isNotNull()), cause, id_col, vector, block_rows, earlier)
        part = dealt.groupBy(cause, "i", "j").applyInArrow(_admitted(cause, earlier, floors), "cause string, floor double, n long")
        out = part if out is None else out.unionByName(part)
    return out.groupBy("cause", "floor").agg(F.sum("n").alias("n"))


def _admitted(cause: str, earlier: tuple[str, ...], floors: tuple[float, ...]):
    """Counts of the pairs of a block at each floor that share none of the earlier columns."""

    def block(table: pa.Table) -> pa.Table:
        ids, chunk, m = table.column("id").to_numpy(), table.column("chunk").to_numpy(), _units(table)
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, right = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
        admitted = ids[left][:, None] != ids[right][None, :] if i != j else ids[left][:, None] < ids[right][None, :]
        for column in earlier:
            known = {v: k for k, v in enumerate(x for x in dict.fromkeys(table.column(column).to_pylist()) if x is not None)}
            codes = np.array([known.get(v, -1) for v in table.column(column).to_pylist()], dtype=np.int64)
            admitted &= (codes[left][:, None] != codes[right][None, :]) | (codes[left] < 0)[:, None]
        cosine = (m[left] @ m[right].T)[admitted]
        return pa.table({"cause": pa.array([cause] * len(floors), pa.string()), "floor": pa.array(floors, pa.float64()), "n": pa.array([int((cosine >= f).sum()) for f in floors], pa.int64())})

    return block

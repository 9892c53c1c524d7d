"""Two-sided reconciliation, scope proofs, causes of similar pairs, and runs read through their pointer."""

import random
from collections import Counter

import numpy as np
import pytest

from wharfline.operators import blocks, ledger
from wharfline.sources.runs import RunStore


def test_both_sides_of_a_reconciliation(spark):
    a = spark.createDataFrame([("x", 1), ("x", 2), ("y", 1), (None, 1)], "trace string, attempted int")
    b = spark.createDataFrame([("x",), ("y",), ("y",), ("z",), (None,)], "trace string")
    got = {r["trace"]: tuple(r)[1:] for r in ledger.reconciled(a, b, "trace").collect()}
    assert got == {"x": (2, 1, "unrecorded"), "y": (1, 2, "unattempted"), "z": (0, 1, "unattempted"), None: (1, 1, "matched")}
    assert ledger.reconciled(a.limit(0), b.limit(0), "trace").count() == 0


def test_scopes_are_a_partition_or_said_not_to_be(spark):
    members = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "id long")
    proof = lambda rows: {(r["scope"], r["n"], r["complete"]) for r in ledger.scope_proof(members, spark.createDataFrame(rows, "id long, scope string"), "id").collect()}
    assert proof([(1, "in"), (2, "in"), (3, "out"), (4, "out"), (5, "in")]) == {("in", 3, True), ("out", 2, True)}
    assert proof([(1, "in"), (1, "out"), (2, "in"), (2, "in"), (3, None), (9, "in"), (5, "out")]) == {("contested", 2, False), ("unscoped", 2, False), ("unknown", 1, False), ("out", 1, False)}
    assert proof([]) == {("unscoped", 5, False)}


@pytest.mark.parametrize("block_rows", [1024, 7])
def test_each_pair_has_its_first_cause(spark, block_rows):
    rng = random.Random(4)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["p", "q", "r"]), rng.choice([None, "k"]), [rng.gauss(0, 1) for _ in range(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, one string, two string, three string, v array<double>").repartition(3)
    floors = (0.2, 0.9)
    want = Counter()
    for i, x in enumerate(rows):
        for y in rows[i + 1 :]:
            cause = next((n for n, k in (("one", 1), ("two", 2), ("three", 3)) if x[k] is not None and x[k] == y[k]), None)
            cosine = np.dot(x[4], y[4]) / np.linalg.norm(x[4]) / np.linalg.norm(y[4])
            want.update((cause, f) for f in floors if cause and cosine >= f)
    got = {(r["cause"], r["floor"]): r["n"] for r in blocks.cause_counts(df, causes=["one", "two", "three"], id_col="id", vector="v", floors=floors, block_rows=block_rows).collect()}
    assert {k: n for k, n in got.items() if n} == dict(want) and {c for c, _ in want} == {"one", "two", "three"}


def test_a_recorded_run_is_pruned_by_its_pointer(spark, tmp_path):
    store = RunStore(spark, f"file://{tmp_path}/store")
    names = ["inputs", "roster", "training", "draws", "verdicts"]
    for run, n in (("one", 3), ("two", 5)):
        store.publish({a: spark.range(n + i) for i, a in enumerate(names)}, run_id=run)
    found = store.recorded(*names)
    assert [found[a].count() for a in names] == [5, 6, 7, 8, 9]
    plan = found["draws"]._jdf.queryExecution().executedPlan().toString()
    scan = next(line for line in plan.splitlines() if "PartitionFilters" in line and "run_id" in line)
    assert "dynamicpruning" in scan
    assert {r["run_id"] for r in found["draws"].select("run_id").collect()} == {"two"}

import hashlib
import json

import pytest

from wharfline.sources import manifests, runs
from wharfline.streaming import drain_stream


def test_manifests_are_verified_both_ways(spark, tmp_path):
    good = tmp_path / "corpus" / "a.txt"
    good.parent.mkdir()
    good.write_text("hello")
    (tmp_path / "corpus" / "b.txt").write_text("other")
    (tmp_path / "corpus" / "stray.txt").write_text("x")
    entry = lambda p, h: {"location": p, "layer": "REAL", "content_hash": h, "license_basis": {"spdx": "MIT", "source": "s"}}
    m = {"layer": "REAL", "entries": [entry("a.txt", "sha256:" + hashlib.sha256(b"hello").hexdigest()), entry("b.txt", "sha256:0"), entry("gone.txt", "sha256:1")]}
    (tmp_path / "manifest.json").write_text(json.dumps(m, indent=1))
    entries = manifests.read_manifests(spark, str(tmp_path))
    files = manifests.read_files(spark, str(tmp_path / "corpus"), "*.txt")
    got = {r["location"]: r["status"] for r in manifests.verified(entries, files, "file:" + str(tmp_path / "corpus")).collect()}
    assert got == {"a.txt": "match", "b.txt": "diverged", "gone.txt": "missing", "stray.txt": "undeclared"}


def test_the_pointer_moves_last(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    first = store.publish({"posterior": spark.range(3)})
    second = store.publish({"posterior": spark.range(5)})
    assert store.active() == second and store.read("posterior").count() == 5 and store.read("posterior", first).count() == 3
    bad = spark.createDataFrame([("r", "FAIL")], "rule string, status string")
    with pytest.raises(ValueError, match="refused"):
        store.publish({"posterior": spark.range(7)}, checks=bad)
    assert store.active() == second


def test_a_claimed_version_is_passed_over(spark, tmp_path):
    store = runs.RunStore(spark, str(tmp_path / "store"))
    first = store.publish({"posterior": spark.range(3)})
    assert store._claim(2) == 2  # another publisher, not finished
    second = store.publish({"posterior": spark.range(4)})
    assert first != second and store.active() == second and store._pointers().select("version").distinct().count() == 2


def test_a_replayed_batch_is_stored_once(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *k: spark.createDataFrame([(x,) for x in k], "k long")
    assert runs.append_unseen(rows(1, 2, 2), path, ["k"], batch="0") == 2
    assert runs.append_unseen(rows(2, 3), path, ["k"], batch="1") == 1
    assert runs.append_unseen(rows(2, 3), path, ["k"], batch="1") == 1
    assert sorted(r["k"] for r in spark.read.parquet(path).collect()) == [1, 2, 3]


def test_insert_if_absent_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "k long, v string")
    path = str(tmp_path / "t")
    assert [runs.append_unseen(rows, path, ["k"]), runs.append_unseen(rows, path, ["k"])] == [2, 0]
    assert spark.read.parquet(path).count() == 2


def test_stream_drain_appends_once(spark, tmp_path):
    schema = "invocation_id long, tokens long, payload_version int"
    rows = [(1, 5, 1), (2, 6, 1), (None, 1, 1), (3, 1, 9), (4, -1, 1)]
    spool, ledger, kept = (str(tmp_path / n) for n in ("spool", "ledger", "kept"))
    for _ in range(2):
        spark.createDataFrame(rows, schema).write.mode("append").parquet(spool)
        drain_stream(spark.readStream.schema(schema).parquet(spool), ledger, kept, str(tmp_path / "check")).awaitTermination(60)
    assert sorted(r["invocation_id"] for r in spark.read.parquet(ledger).collect()) == [1, 2]
    assert spark.read.parquet(kept).count() == 6

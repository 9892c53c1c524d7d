"""Figures that no query shows by themselves: verdicts on intervals, pooled vectors, weights over draws, labels."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats, text
from wharfline.operators import forecast, ingestion, ledger


def test_intervals_lie_apart(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, True), (0.3, 0.4, 0.1, 0.2, True), (0.1, 0.3, 0.3, 0.4, False), (0.1, 0.5, 0.2, 0.3, False), (0.1, float("nan"), 0.3, 0.4, False), (0.1, 0.2, 0.2, 0.3, False)]
    got = spark.createDataFrame(rows, "a double, b double, c double, d double, want boolean").select("want", stats.separated(*map(F.col, "abcd")).alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_masked_mean_and_length(spark):
    rng = random.Random(1)
    rows = [([[rng.gauss(0, 1) for _ in range(4)] for _ in range(5)], [rng.randrange(2) for _ in range(5)]) for _ in range(20)] + [([[1.0] * 4], [0])]
    df = spark.createDataFrame(rows, "v array<array<double>>, m array<int>")
    got = df.select("v", "m", arrays.masked_mean(F.col("v"), F.col("m"), 4).alias("mean")).withColumn("unit", arrays.l2_normalized(F.col("mean"))).collect()
    for r in got:
        n = max(sum(r["m"]), 1e-9)
        want = [sum(v[i] for v, m in zip(r["v"], r["m"], strict=True) if m) / n for i in range(4)]
        assert r["mean"] == pytest.approx(want)
        if any(want):
            assert math.fsum(x * x for x in r["unit"]) == pytest.approx(1)


def test_weights_over_draws(spark):
    rng = random.Random(2)
    draws = [(rng.random(), 0.1 + rng.random()) for _ in range(41)]
    counts = [("none", 0), ("a", 7), ("b", 7), ("c", 900)]
    out = forecast.shrinkage_intervals(spark.createDataFrame(counts, "member string, n long"), spark.createDataFrame(draws, "tau double, sigma double"))
    got = {r["member"]: r for r in out.collect()}
    for member, n in counts:
        rho = sorted(n * t * t / (n * t * t + s * s) for t, s in draws)
        span = math.floor(0.9 * len(rho))
        at = min(range(len(rho) - span), key=lambda i: (rho[i + span] - rho[i], i))
        r = got[member]
        assert (r["median"], r["low"], r["high"]) == pytest.approx((rho[20], rho[at], rho[at + span]))
    assert got["none"]["median"] == 0


def test_apportioned_to_the_last(spark):
    rng = random.Random(3)
    for total in (30, 101, 1000):
        w = {i: rng.choice((1, 1, 2, 50, 333)) for i in range(23)}
        got = {r["s"]: r["allotted"] for r in ledger.apportioned(spark.createDataFrame(list(w.items()), "s int, w long"), stratum="s", weight="w", total=total).collect()}
        low = {i: max(1, v * total // sum(w.values())) for i, v in w.items()}
        extra = sorted(w, key=lambda i: (-(w[i] * total % sum(w.values())), i))[: max(0, total - sum(low.values()))]
        assert got == {i: low[i] + (i in extra) for i in w}


def test_labels_that_are_the_same(spark):
    rows = [("Straße  Nr", "strasse nr"), ("STRASSE\tNR\n", "strasse nr"), ("Café", "café"), (" CAFÉ ", "café"), ("", ""), (None, None)]
    got = spark.createDataFrame(rows, "a string, want string").select("want", text.folded_label("a").alias("got")).collect()
    assert all(r["got"] == r["want"] for r in got)


def test_multisets_match_each_value_once(spark):
    rng = random.Random(11)
    row = lambda: (rng.randrange(5), rng.choice(["a", "b", "c"]), rng.choice(["1", "2", None]))
    produced, expected = [row() for _ in range(300)], [row() for _ in range(200)]
    make = lambda rows: spark.createDataFrame(rows, "document_id long, field string, value string")
    got = {r.field: (r.stored, r.printed, r.matched) for r in ingestion.multiset_counts(make(produced), make(expected), ["document_id", "field", "value"], ["field"]).collect()}
    common = Counter(r for r in produced if None not in r) & Counter(r for r in expected if None not in r)
    held = lambda rows, f: sum(r[1] == f for r in rows)
    assert got == {f: (held(produced, f), held(expected, f), sum(n for r, n in common.items() if r[1] == f)) for f in "abc"}
    assert not ingestion.multiset_counts(make([]), make([]), ["document_id", "field", "value"], ["field"]).count()

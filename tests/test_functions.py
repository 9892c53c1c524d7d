import datetime
import math
import re
import statistics

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wharfline.functions import arrays, stats, text
from wharfline.operators import identity, ingestion, ledger, retrieval, rules, survival
from wharfline.operators import worklist as W


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()


def test_nearest_rank_is_a_value_of_the_sample(spark):
    for n in (1, 2, 3, 7, 10):
        values = list(range(10, 10 + n))
        for p in (0.01, 0.5, 0.8, 1.0):
            got = one(spark, v=arrays.nearest_rank(F.lit(values), p))["v"]
            assert got == values[max(1, math.ceil(p * n)) - 1]
    assert one(spark, v=arrays.nearest_rank(F.expr("cast(array() as array<int>)"), 0.5))["v"] is None


def test_survival_grid_falls_and_stays_in_unit(spark):
    rng = np.random.default_rng(3)
    rows = [(sorted(int(x) for x in rng.integers(0, 400, n)),) for n in (1, 5, 50)]
    out = spark.createDataFrame(rows, "d array<int>").withColumn("g", arrays.survival_grid(F.col("d"), 365)).select("d", "g", arrays.non_increasing(F.col("g")).alias("a"), arrays.within_unit(F.col("g")).alias("b"), arrays.ascending(F.col("d")).alias("c")).collect()
    for r in out:
        assert r["a"] and r["b"] and r["c"] and len(r["g"]) == 365
        assert r["g"][9] == sum(x > 10 for x in r["d"]) / len(r["d"])


def test_both_wilson_intervals_contain_the_share(spark):
    cases = [(k, n) for n in (1, 2, 10, 50) for k in range(0, n + 1, max(1, n // 5))]
    df = spark.createDataFrame(cases, "k long, n long")
    for make in (stats.wilson, stats.wilson_corrected):
        low, high = make(F.col("k"), F.col("n"))
        for r in df.select("k", "n", low.alias("l"), high.alias("h")).collect():
            p = r["k"] / r["n"]
            assert 0 <= r["l"] <= p <= r["h"] <= 1
            assert make is stats.wilson or r["h"] > r["l"]
    low, _ = stats.wilson(F.lit(0), F.lit(0))
    assert one(spark, v=low)["v"] is None


@pytest.mark.parametrize(("p", "shown", "other"), [(0.0, "<1%", ">99%"), (0.125, "13%", "87%"), (0.005, "1%", "99%"), (0.0049, "<1%", ">99%"), (0.994, "99%", "1%"), (0.995, ">99%", "<1%"), (1.0, ">99%", "<1%"), (1.5, None, None)])
def test_percent_display(spark, p, shown, other):
    r = one(spark, a=stats.percent_display(F.lit(p)), b=stats.complement_display(F.lit(p)))
    assert (r["a"], r["b"]) == (shown, other)


def test_elapsed_ms_rounds_half_to_even(spark):
    r = one(spark, a=stats.elapsed_ms(F.lit(0.0025)), b=stats.elapsed_ms(F.lit(-1.0)), c=stats.elapsed_ms(F.lit(0.0035)))
    assert (r["a"], r["b"], r["c"]) == (2, 0, 4)


def test_lognormal_functions(spark):
    normal = statistics.NormalDist()
    df = spark.createDataFrame([(0.5, 0.0, 3.0, 0.5), (0.8, 10.0, 3.0, 0.5), (0.5, 200.0, 3.0, 0.5)], "u double, e double, m double, s double")
    out = df.select("*", stats.remaining_quantile("u", "e", "m", "s").alias("r"), stats.lognormal_survival("e", "m", "s").alias("l"), stats.normal_quantile("u").alias("q")).collect()
    assert out[0]["r"] == pytest.approx(math.exp(3.0)) and out[0]["l"] == 1.0
    left = 1 - normal.cdf((math.log(10) - 3) / 0.5)
    assert out[1]["l"] == pytest.approx(left)
    assert out[1]["r"] == pytest.approx(math.exp(3 + 0.5 * normal.inv_cdf(1 - left * 0.2)) - 10)
    assert all(r["r"] > 0 for r in out) and out[1]["q"] == pytest.approx(normal.inv_cdf(0.8))


def test_fenton_wilkinson_keeps_mean_and_variance(spark):
    mus, s2 = [1.0, 2.0, 0.5], [0.2, 0.1, 0.4]
    mu, sigma = stats.fenton_wilkinson(F.lit(mus), F.lit(s2))
    r = one(spark, m=mu, s=sigma)
    mean = sum(math.exp(a + b / 2) for a, b in zip(mus, s2, strict=True))
    var = sum(math.expm1(b) * math.exp(2 * a + b) for a, b in zip(mus, s2, strict=True))
    assert math.exp(r["m"] + r["s"] ** 2 / 2) == pytest.approx(mean)
    assert math.expm1(r["s"] ** 2) * math.exp(2 * r["m"] + r["s"] ** 2) == pytest.approx(var)


def test_precision_floor(spark):
    out = [r["b"] for r in spark.createDataFrame([(100, 100), (95, 100), (0, 0)], "k long, n long").select(stats.precision_floor("k", "n").alias("b")).collect()]
    assert out[0] == pytest.approx(0.97)
    assert stats.binomial_tail(95, 100, out[1]) == pytest.approx(0.05, abs=1e-6)
    assert out[2] is None or math.isnan(out[2])


DATES = {"2026-03-14": (2026, 3, 14), "3/4/2026": (2026, 3, 4), "3/4/68": (2068, 3, 4), "3/4/69": (1969, 3, 4), "14 Mar 2026": (2026, 3, 14), "March 1, 2026": (2026, 3, 1), "2026-02-30": None, "13/1/2026": None, "2026-03-14T09:00:00": None, "03/2026": None, "": None, "14 Foo 2026": None}
NUMBERS = {"1,250": 1250, "-3.5": -3.5, "+7": 7, "12 ea": None, "1,2,3": None, "$12": None, "1250": 1250, "": None}


def test_coercion(spark):
    got = {r["p"]: r["d"] for r in spark.createDataFrame([(p,) for p in DATES], "p string").select("p", text.date(F.col("p")).alias("d")).collect()}
    assert got == {p: d and datetime.date(*d) for p, d in DATES.items()}
    got = {r["p"]: r["d"] and float(r["d"]) for r in spark.createDataFrame([(p,) for p in NUMBERS], "p string").select("p", text.number(F.col("p")).alias("d")).collect()}
    assert got == NUMBERS


def test_text_helpers(spark):
    r = one(spark, a=text.part_numbers(F.lit("AB-1234 x AB-1234 ABCDE-1234 ZZ-99999")), b=text.blank(F.lit(" \t\x0b")), c=text.redacted(F.lit("password=abc d")), d=text.slug(F.lit("--A b/C. ")), e=text.nfc(F.lit("É")), f=text.uuid5(F.lit("x")))
    assert r["a"] == ["AB-1234", "ZZ-99999"] and r["b"] and "abc" not in r["c"] and r["d"] == "a-b-c" and r["e"] == "é"
    assert re.fullmatch("[0-9a-f-]{36}", r["f"])


def test_kaplan_meier_without_censoring_is_the_empirical_survival(spark):
    days = [3, 3, 5, 8, 8, 8, 13]
    steps = survival.product_limit(spark.createDataFrame([(d, False) for d in days], "days int, censored boolean"), []).collect()
    for r in steps:
        assert r["survival"] == pytest.approx(sum(d > r["days"] for d in days) / len(days))
    assert max(steps, key=lambda r: r["days"])["standard_error"] == math.inf


def test_a_row_censored_on_an_event_day_is_at_risk(spark):
    steps = survival.product_limit(spark.createDataFrame([(5, False), (5, True), (9, False)], "days int, censored boolean"), []).orderBy("days").collect()
    assert [(r["at_risk"], r["events"]) for r in steps] == [(3, 1), (1, 1)]


def test_split_does_not_depend_on_row_order(spark):
    rows = [(i, i % 3 == 0) for i in range(101)]
    split = lambda r: {x["k"]: x["split_side"] for x in survival.stratified_split(spark.createDataFrame(r, "k long, s boolean"), stratum="s", keys=["k"], data_hash="h").collect()}
    a, b = split(rows), split(rows[::-1])
    assert a == b
    for s in (True, False):
        members = [k for k, v in rows if v is s]
        assert sum(a[k] == "held_out" for k in members) == math.floor(0.25 * len(members) + 0.5)
    assert split([(1, True)]) == {1: "train"}


@settings(max_examples=8, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=3, max_size=40))
def test_terciles_follow_rank(spark, values):
    rows = [(v, i) for i, v in enumerate(values)]
    got = {r["k"]: r["level"] for r in survival.terciles(spark.createDataFrame(rows, "v int, k int"), value="v", key="k").collect()}
    order = sorted(range(len(values)), key=lambda i: (values[i], i))
    assert got == {i: ("TIGHT", "MODERATE", "RELAXED")[min(r * 3 // len(values), 2)] for r, i in enumerate(order)}


def test_rrf_is_symmetric_and_total(spark):
    a = spark.createDataFrame([("q", 1, 1), ("q", 2, 2)], "query_id string, chunk_id long, rank int")
    b = spark.createDataFrame([("q", 2, 1), ("q", 3, 2)], "query_id string, chunk_id long, rank int")
    rank = lambda x, y: [(r["chunk_id"], r["rank"]) for r in retrieval.fuse(x, y).orderBy("rank").select("chunk_id", "rank").collect()]
    assert [c for c, _ in rank(a, b)] == [2, 1, 3] and [r for _, r in rank(a, b)] == [1, 2, 3]
    assert {c for c, _ in rank(b, a)} == {1, 2, 3}


def test_bootstrap_covers_the_mean(spark):
    r = retrieval.bootstrap(spark.createDataFrame([(0.0,), (1.0,), (1.0,), (0.5,)], "v double"), "v", resamples=400).first()
    assert r["low"] <= 0.625 <= r["high"] and r["low"] < r["high"]


def test_states_in_order_of_precedence(spark):
    args = dict(has_run=F.col("run"), roster_ok=F.col("roster"), covered=F.col("covered"), offset=F.col("o"), need_by=F.col("d"), horizon=365, today="2026-06-10")
    day = datetime.date
    cases = [(False, False, False, 400, day(2026, 1, 1), "no_active_run"), (True, False, False, 400, day(2026, 1, 1), "roster_mismatch"), (True, True, False, 400, day(2026, 1, 1), "not_covered"), (True, True, True, 366, day(2026, 1, 1), "beyond_horizon"), (True, True, True, 0, day(2026, 1, 1), "already_late"), (True, True, True, 3, day(2026, 6, 9), "calendar_passed"), (True, True, True, 365, day(2026, 6, 10), "nominal")]
    df = spark.createDataFrame(cases, "run boolean, roster boolean, covered boolean, o int, d date, want string")
    assert all(r["s"] == r["want"] for r in df.select(W.row_state(**args).alias("s"), "want").collect())
    with pytest.raises(ValueError, match="unknown order"):
        W.order_columns("nothing")


def test_cost_rounds_once_half_to_even(spark):
    r = one(spark, a=ledger.cost([F.lit(1)] * 4, [F.lit("0.000050"), F.lit("0.000000"), F.lit("0.000000"), F.lit("0.000000")]), b=ledger.cost([F.lit(1), F.lit(1), F.lit(0), F.lit(0)], [F.lit("0.000030"), F.lit("0.000030"), F.lit("0.000000"), F.lit("0.000000")]))
    assert (float(r["a"]), float(r["b"])) == (0.0, 1e-10)


def test_confidence_takes_deductions_in_order(spark):
    rows = ingestion.confidence_domain(spark).collect()
    assert len(rows) == 8
    for r in rows:
        want = 1.0
        for flag, weight in ((r["alternate"], 0.15), (r["split"], 0.10), (r["repaired"], 0.25)):
            want = want - weight if flag else want
        assert r["score"] == want


def test_chunks_keep_all_words_and_the_budget(spark):
    body = "\n".join(["a b c. d e f.", "x " * 40, "", "end"])
    rows = ingestion.chunked(spark.createDataFrame([(1, body), (2, None), (3, "")], "document_id long, body string"), budget=8).orderBy("ordinal").collect()
    assert {r["document_id"] for r in rows} == {1} and [r["ordinal"] for r in rows] == list(range(len(rows)))
    assert " ".join(r["body"] for r in rows).split() == body.split() and all(r["pieces"] <= 8 for r in rows)


def test_clusters_are_cliques(spark):
    edges = [(1, 2, 0.95), (2, 3, 0.9), (4, 5, 0.9), (4, 6, 0.9), (5, 6, 0.9)]
    merges = spark.createDataFrame(edges, "a long, b long, score double")
    home = {r["record_id"]: r["cluster_id"] for r in identity.clusters(merges).collect()}
    assert home[1] == home[2] != home[3] and home[4] == home[5] == home[6]


def test_rule_report_fails_empty_populations(spark):
    t = {"x": spark.createDataFrame([(1, "a"), (1, "b")], "k int, v string"), "e": spark.range(0)}
    got = {r["rule"]: (r["population"], r["failures"], r["status"]) for r in rules.report([rules.unique("u", "x", "k"), rules.unique("v", "x", "v"), rules.where("e", "e", "true")], t).collect()}
    assert got == {"u": (2, 1, "FAIL"), "v": (2, 0, "PASS"), "e": (0, 0, "FAIL")}


def test_reconciliation_keeps_bags_and_nulls(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(1, None), (2, "y")], "k int, v string")
    assert sorted(map(tuple, ledger.symmetric_difference(a, b).collect()), key=str) == sorted([(1, None, "left"), (2, "x", "left"), (2, "y", "right")], key=str)

"""The closed upper tail against 50-digit arithmetic, and contributions of legs against plain Python."""

import math
from decimal import Decimal, getcontext

import duckdb
import pytest
from pyspark.sql import functions as F

from wharfline.functions import stats
from wharfline.operators import lifecycle as Y

getcontext().prec = 70
PI = Decimal("3.14159265358979323846264338327950288419716939937510582097494459230781640628620899862803482534211706798")


def log_tail(z):
    """log(1 - Phi(z)) by the alternating series of the error function, in digits enough for its cancellation."""
    a = abs(Decimal(z))
    if a > 12:  # Laplace's continued fraction, which gains digits with a
        t = a
        for k in range(2000, 0, -1):
            t = a + k / t
        q = -a * a / 2 - (2 * PI).ln() / 2 - t.ln()
    else:
        getcontext().prec = 150
        total, term, n = a, a, 0
        while abs(term) > Decimal(10) ** -140:
            n += 1
            term = -term * a * a / (2 * n)
            total += term / (2 * n + 1)
        q = (Decimal("0.5") - total / (2 * PI).sqrt()).ln()
        getcontext().prec = 70
    return q if z >= 0 else (1 - q.exp()).ln()


POINTS = [0.0, 1e-12, 0.3, 1.0, 2.4999999, 2.5, 3.0, 5.0, 7.9, 8.3, 12.0, 38.0, 39.0, 100.0, 1e5, 1e9]


def test_upper_tail(spark):
    points = POINTS + [-p for p in POINTS[1:12]]
    got = spark.createDataFrame([(p,) for p in points], "z double").select("z", stats.log_upper_tail(F.col("z")).alias("v")).collect()
    for r in got:
        want = float(log_tail(r["z"]))
        # PI above has 100 digits, more than the series needs; below -8.3 the chance is 1 to the last bit of a double
        assert r["v"] == pytest.approx(want, rel=2e-13, abs=1e-16), r["z"]
        (sql,) = duckdb.connect().execute(f"SELECT {stats.log_upper_tail_sql('z')} FROM (SELECT CAST({r['z']!r} AS DOUBLE) AS z)").fetchone()
        assert sql == pytest.approx(want, rel=1e-12, abs=1e-15), r["z"]
    # a tail that underflows when it is first computed and then taken the logarithm of
    assert math.erfc(39 / math.sqrt(2)) == 0 and got[POINTS.index(39.0)]["v"] < -760


def test_sums_in_logarithms(spark):
    rows = [(-1000.0, -1001.0), (float("-inf"), -3.0), (float("-inf"), float("-inf")), (-0.1, -800.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(stats.log_sum(F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([-1000 + math.log1p(math.exp(-1)), -3.0, float("-inf"), -0.1], rel=1e-14)
    soft = [r[0] for r in spark.createDataFrame([(-800.0,), (0.0,), (800.0,)], "x double").select(stats.softplus(F.col("x"))).collect()]
    assert soft == pytest.approx([0.0, math.log(2), 800.0])


def test_contributions_of_legs(spark):
    sojourns = [(d, a, b, 1.0 + 0.3 * i + 0.1 * d, 0.4 + 0.05 * i) for d in range(3) for i, (a, b) in enumerate(Y.EDGES)]
    branching = [(d, -1.0 + d, 0.5 * d) for d in range(3)]
    legs = [("k1", 1, "submitted", "under_review", 5, False, 0), ("k1", 2, "under_review", None, 40, True, 1), ("k2", 1, "under_review", None, 0, True, 0), ("k3", 1, "shipped", None, 10**7, True, 2), ("k4", 1, "under_review", "revise_and_resubmit", 3, False, 0), ("k5", 1, "under_review", None, 10**9, True, 3), ("k6", 1, "submitted", "under_review", 0, False, 0)]
    frame = spark.createDataFrame(legs, "k string, seq int, state string, next_state string, days long, is_open boolean, cycle long").repartition(3)
    mu = {(d, a, b): (m, s) for d, a, b, m, s in sojourns}
    got = Y.log_contributions(frame, spark.createDataFrame(sojourns, "draw int, state string, next_state string, mu double, sigma double"), spark.createDataFrame(branching, "draw int, intercept double, beta double"), key="k").cache()
    values = {(r["k"], r["seq"], r["draw"]): r["log_c"] for r in got.collect()}
    assert len(values) == 3 * len(legs)
    for k, seq, state, after, days, is_open, cycle in legs:
        for d, intercept, beta in branching:
            lasts = lambda way: 0.0 if not days else float(log_tail((math.log(days) - mu[d, state, way][0]) / mu[d, state, way][1]))  # noqa: B023, E731
            if not is_open:
                m, s = mu[d, state, after]
                want = None if not days else -math.log(days) - math.log(s) - 0.5 * math.log(2 * math.pi) - ((math.log(days) - m) / s) ** 2 / 2
            elif state == "under_review":
                p = Decimal(1) / (1 + (-Decimal(intercept + beta * cycle)).exp())
                want = float(((1 - p) * Decimal(lasts("approved")).exp() + p * Decimal(lasts("revise_and_resubmit")).exp()).ln())
            else:
                want = lasts(Y.FORWARD[state])
            assert values[k, seq, d] == (None if want is None else pytest.approx(want, rel=1e-11, abs=1e-13)), (k, d)
    few = {r["k"]: r for r in Y.predictive(got.where("is_open"), key="k").collect()}
    own = [Decimal(values["k5", 1, d]).exp() for d in range(3)]
    assert few["k5"]["log_mean"] == pytest.approx(float((sum(own) / 3).ln())) and few["k5"]["draws"] == 3
    # a draw without one of its ways has no row
    partial = [x for x in sojourns if not (x[0] == 1 and x[2] == "revise_and_resubmit")]
    less = Y.log_contributions(frame, spark.createDataFrame(partial, "draw int, state string, next_state string, mu double, sigma double"), spark.createDataFrame(branching, "draw int, intercept double, beta double"), key="k")
    assert {r["draw"] for r in less.where("k = 'k5'").collect()} == {0, 2} and less.limit(0).count() == 0

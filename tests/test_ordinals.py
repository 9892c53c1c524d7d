"""Places without gathering, digests of groups by blocks, and sides that are too large to be given to the tasks."""

import hashlib
import random

from pyspark.sql import functions as F

from wharfline import shared
from wharfline.operators.ordinals import numbered, sealed


def test_places_are_those_of_the_sorted_rows(spark):
    rng = random.Random(5)
    rows = [(rng.choice([None, "a", "b", "b", "b", "é"]), i, "x") for i in range(700)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k string, id long, position string").repartition(5)
    got = {r["id"]: r["at"] for r in numbered(df, "k", F.desc("id"), name="at").collect()}
    order = sorted(rows, key=lambda r: (r[0] is not None, (r[0] or "").encode(), -r[1]))
    assert got == {r[1]: i + 1 for i, r in enumerate(order)}
    assert numbered(df.limit(0), "k", "id", name="at").count() == 0
    # no list and no window over the rows: the plan has a range exchange, and a window over a row for each range
    plan = numbered(df, "k", "id", name="at")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and plan.index("Window") < plan.index("Aggregate")


def test_digests_of_groups_of_any_size(spark):
    rng = random.Random(6)
    rows = [(g, f"{rng.randrange(10**6)}") for g, n in ((1, 2_500), (2, 1), (3, 1_024)) for _ in range(n)]
    got = {r["g"]: (r["n"], r["digest"]) for r in sealed(spark.createDataFrame(rows, "g int, t string").repartition(4), group="g", text="t").collect()}
    for g in (1, 2, 3):
        own = sorted(t for x, t in rows if x == g)
        blocks = [hashlib.sha256("\n".join(own[i : i + 1024]).encode()).hexdigest() for i in range(0, len(own), 1024)]
        assert got[g] == (len(own), hashlib.sha256("\n".join(blocks).encode()).hexdigest())


def test_wide_or_long_sides_are_not_broadcast(spark):
    few = spark.createDataFrame([(i, "x" * 1000, [1, 2, 3], {"a": "b" * 50}) for i in range(100)], "id long, t string, a array<int>, m map<string,string>")
    hinted = lambda df: "hint" in df._jdf.queryExecution().logical().toString().lower()
    assert hinted(shared.checked_broadcast(few)) and hinted(shared.checked_broadcast(few.limit(0)))
    assert not hinted(shared.checked_broadcast(few, most_rows=99)) and not hinted(shared.checked_broadcast(few, most_bytes=100_000))
    width = few.agg(F.sum(shared.width_of(few.schema)).alias("w")).first()["w"]
    assert 100 * 1_100 < width < 100 * 1_400

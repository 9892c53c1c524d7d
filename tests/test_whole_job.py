"""Core operators on cases that the given tables do not hold."""

import random

import pytest
from pyspark.sql import functions as F

from wharfline import shared
from wharfline.functions import stats, text
from wharfline.operators import blocks, forecast, identity, retrieval, survival, worklist
from wharfline.operators.components import connected_components


def test_a_long_chain_of_merges_has_one_root(spark):
    chain = spark.createDataFrame([(i, i + 1) for i in range(1, 200)] + [(1000, 1001)], "a long, b long")
    roots = {r["node"]: r["root"] for r in identity.reachable(chain).collect()}
    assert roots == {i: 1 for i in range(1, 201)} | {1000: 1000, 1001: 1000}


def test_components_round_a_hub(spark):
    edges = [(0, i) for i in range(1, 400)] + [(i, 1000 + i) for i in range(1, 400, 2)] + [(5000, 5001), (5001, 5001)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 400)} | {1000 + i: 0 for i in range(1, 400, 2)} | {5001: 5000}


def test_join_hot_is_a_join(spark):
    rng = random.Random(1)
    rows = spark.createDataFrame([(rng.choice((1, 1, 1, rng.randrange(50), None)), i) for i in range(900)], "k long, v long")
    side = shared.materialize(rows.where("k % 7 <> 3").groupBy("k").count(), "side")
    for how in ("inner", "left"):
        want = sorted(map(str, rows.join(side, "k", how).select("k", "v", "count").collect()))
        for hot_rows, hot_bytes in ((200, 8 << 20), (2, 300), (2, 1), (10**6, 1)):
            got = shared.join_hot(rows, side, "k", many=side["count"], how=how, hot_rows=hot_rows, hot_bytes=hot_bytes)
            assert sorted(map(str, got.select("k", "v", "count").collect())) == want
    shared.discard(side)


def greedy(pairs):
    allowed, home = {frozenset(p[:2]) for p in pairs}, {}
    for a, b, _ in sorted(pairs, key=lambda p: (-p[2], p[0], p[1])):
        x, y = home.setdefault(a, {a}), home.setdefault(b, {b})
        if x is not y and all(frozenset((i, j)) in allowed for i in x for j in y):
            x |= y
            for j in y:
                home[j] = x
    return {r: min(c) for r, c in home.items()}


@pytest.mark.parametrize("component_pairs", [50_000, 8, 0])
def test_clusters_as_taking_the_pairs_in_turn(spark, component_pairs):
    rng = random.Random(4)
    for n, share in ((14, 0.7), (25, 0.4)):
        pairs = [(a, b, round(rng.random(), 1)) for a in range(n) for b in range(a + 1, n) if rng.random() < share]
        got = identity.clusters(spark.createDataFrame(pairs, "a long, b long, score double"), component_pairs=component_pairs)
        assert {r["record_id"]: r["cluster_id"] for r in got.collect()} == greedy(pairs)


def test_a_long_chain_of_merges_takes_few_rounds(spark, monkeypatch):
    """Each pair of the chain is a little worse than the one before, so that one waits for the other."""
    pairs = [(i, i + 1, 1.0 - i / 10_000) for i in range(1_000)] + [(5_000 + i, 5_000 + j, 0.9 - (i + j) / 1_000) for i in range(12) for j in range(i + 1, 12) if (i, j) != (3, 7)]
    rounds, real = [], identity.materialize
    monkeypatch.setattr(identity, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    got = identity.clusters(spark.createDataFrame(pairs, "a long, b long, score double"))
    assert {r["record_id"]: r["cluster_id"] for r in got.collect()} == greedy(pairs)
    assert rounds.count("joined") < 20


def test_override_requests_are_refused_as_a_whole(spark):
    from datetime import date, timedelta

    lines = spark.createDataFrame([(f"l{i}", date(2000, 1, 1)) for i in range(40)], "line_id string, need_by date")
    ask = lambda rows: spark.createDataFrame(rows, "line_id string, what_if date")
    day = date(1999, 12, 31)
    out = worklist.effective_dates(lines, ask([(f"l{i}", day) for i in range(25)]), as_of="1999-06-30")
    assert out.where("is_adjusted").count() == 25 and out.count() == 40
    for rows in ([(f"l{i}", day) for i in range(26)], [("l1", day), ("l1", day)], [("l1", None)], [("l1", day + timedelta(days=3661))]):
        with pytest.raises(ValueError, match="override"):
            worklist.effective_dates(lines, ask(rows), as_of="1999-06-30")


def test_terciles_where_one_value_holds_most_rows(spark):
    rng = random.Random(2)
    rows = [(f"{rng.randrange(10**6):06d}-{i}", rng.choice((5, 5, 5, 5, rng.randrange(10)))) for i in range(900)]
    order = {k: r for r, (k, _) in enumerate(sorted(rows, key=lambda p: (p[1], p[0])))}
    got = {r["k"]: r["level"] for r in survival.terciles(spark.createDataFrame(rows, "k string, v int"), value="v", key="k", lead_chars=1).collect()}
    assert got == {k: ("TIGHT", "MODERATE", "RELAXED")[min(r * 3 // 900, 2)] for k, r in order.items()}


def test_dense_blocks_as_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(2)
    m = rng.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(m)], "chunk_id long, embedding array<float>")
    q = df.where("chunk_id % 50 = 0").selectExpr("cast(chunk_id as string) as query_id", "embedding")
    got = {(r["query_id"], r["rank"]): r["chunk_id"] for r in retrieval.dense_topk(df, q, 7, block_queries=2, block_rows=64).collect()}
    m = m.astype(np.float32).astype(float)
    unit = m / np.linalg.norm(m, axis=1, keepdims=True)
    assert got == {(str(i), r + 1): int(c) for i in range(0, 300, 50) for r, c in enumerate(np.argsort(1 - unit[i] @ unit.T)[:7])}


def test_dense_ties_and_copies_of_a_side(spark):
    import re

    rng = random.Random(1)
    kinds = [[1.0, 0.0], [0.0, 0.0], [0.6, 0.8], [0.0, 1.0]]
    rows = [(i, kinds[rng.randrange(4)]) for i in range(5000)]
    df = spark.createDataFrame(rows, "chunk_id long, embedding array<float>").repartition(4)
    q = df.where("chunk_id < 600").selectExpr("concat('q', chunk_id) as query_id", "embedding")
    out = retrieval.dense_topk(df, q, 3)
    first = {tuple(kind): sorted((round(1 - sum(x * y for x, y in zip(kind, v, strict=True)), 6), i) for i, v in rows)[:3] for kind in kinds}
    got = {(r["query_id"], r["rank"]): (round(r["score"], 6), r["chunk_id"]) for r in out.collect()}
    assert got == {(f"q{i}", r + 1): (pytest.approx(d, abs=1e-6), c) for i, v in rows[:600] for r, (d, c) in enumerate(first[tuple(v)])}
    # one block of queries and two of chunks: a chunk is dealt once
    assert re.findall(r"pmod\(xxhash64\([^)]*\), (\d+)\)", out._jdf.queryExecution().optimizedPlan().toString()) == ["1", "2"]
    with pytest.raises(Exception, match="one width"):
        retrieval.dense_topk(df.unionByName(spark.createDataFrame([(9000, [1.0])], df.schema)), q, 3).collect()


def test_credentials_are_redacted_at_any_depth(spark):
    key = "sk-ant-" + "a1B2" * 5
    body = spark.sql(f"select named_struct('a', '{key}', 'b', array('x', '{key}!'), '{key}', 'short sk-ant-abc', 'own', 'k3y') as p").select(text.redacted_leaves(F.col("p"), "k3y").alias("t")).first()["t"]
    assert key not in body and "k3y" not in body and body.count("[REDACTED]") == 4 and "sk-ant-abc" in body


def test_blocks_of_similar_vectors_as_brute_force(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    m = rng.normal(size=(160, 6)).astype(np.float32)
    rows = [(i, "big" if i % 4 else "small", v.tolist()) for i, v in enumerate(m)]
    df = spark.createDataFrame(rows, "id long, label string, v array<float>")
    unit = m.astype(float) / np.linalg.norm(m.astype(float), axis=1, keepdims=True)
    near = {f: {(a, b) for a in range(160) for b in range(a + 1, 160) if (a % 4 == 0) == (b % 4 == 0) and unit[a] @ unit[b] >= f} for f in (0.8, 0.93)}
    counts = {(r["id"]): r["n"] for r in blocks.partner_counts(df, key="label", id_col="id", vector="v", floor=0.8, block_rows=16).collect()}
    assert counts == {a: sum(x == a for x, _ in near[0.8]) for a, _ in near[0.8]}
    forest = blocks.similar_forest(df, key="label", id_col="id", vector="v", floor=0.8, block_rows=16)
    for floor, pairs in near.items():
        root = list(range(160))
        for _ in range(160):
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        got = {r["node"]: r["root"] for r in connected_components(forest.where(F.col("cosine") >= floor).select("a", "b")).collect()}
        assert got == {i: r for i, r in enumerate(root) if i != r}


def test_blocks_of_candidates_as_all_pairs(spark):
    rows = [(i, i % 2, "m1" if i % 3 else None, f"P{i % 7}") for i in range(60)]
    df = spark.createDataFrame(rows, "record_id long, project int, norm_manufacturer string, norm_part string")
    want = {(p, a, b) for a, p, m, k in rows for b, q, n, l in rows if a < b and p == q and (m and m == n or k == l)}
    for size in (4, 1000):
        got = identity.candidates(df, prefix=2, chunk_records=size)
        assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_bootstrap_of_many_rows_follows_their_counts(spark):
    values = spark.range(200_000).selectExpr("cast(id % 4 = 0 as double) as v")
    r = retrieval.bootstrap(values.repartition(7), "v", resamples=500).first()
    assert abs(r["low"] - 0.2481) < 5e-4 and abs(r["high"] - 0.2519) < 5e-4
    assert r == retrieval.bootstrap(values, "v", resamples=500).first()
    assert retrieval.bootstrap(values.where("v > 1"), "v").first()["low"] is None


def test_effect_intervals_hold_their_level(spark):
    import math

    draws = [(0.5, 1.0), (2.0, 0.25), (0.0, 1.0), (1.0, 0.0)]
    counts = spark.createDataFrame([("a", 0), ("b", 3), ("c", 50), ("d", 3), ("e", None)], "vendor string, n int")
    got = {r["vendor"]: r for r in forecast.effect_intervals(counts, spark.createDataFrame([*draws, (None, 1.0)], "tau double, sigma double")).collect()}
    assert got["e"]["low"] is None and got["b"]["high"] == got["d"]["high"] > got["c"]["high"] and len(got) == 5
    for r in (got["a"], got["b"]):
        spreads = [t * s / math.sqrt(r["n"] * t * t + s * s) if r["n"] else t for t, s in draws]
        inside = [math.erf(r["high"] / (s * math.sqrt(2))) if s else 1.0 for s in spreads]
        assert abs(sum(inside) / 4 - 0.9) < 1e-9 and r["low"] == -r["high"]
        assert abs(r["spread"] - sum(sorted(spreads)[1:3]) / 2) < 1e-12
    none = forecast.effect_intervals(counts, spark.createDataFrame([], "tau double, sigma double")).collect()
    assert len(none) == 5 and all(r["spread"] is None for r in none)


def test_digest_of_stored_doubles(spark):
    import hashlib
    import struct

    rows = [([1.5, -0.0, 3e300],), ([],), (None,), ([float("nan")],), ([1.0, None],)]
    got = [r["d"] for r in spark.createDataFrame(rows, "v array<double>").select(stats.float_digest("v").alias("d")).collect()]
    assert got == [hashlib.sha256(struct.pack("<3d", 1.5, -0.0, 3e300)).hexdigest(), None, None, None, None]


def test_fixtures_are_refused_by_their_numbers_and_levels(spark, tmp_path):
    from wharfline.sources import manifests

    deep = lambda n: '{"a":' * n + "1" + "}" * n
    cases = {"a": ('{"x": 12.5}', "float"), "b": ('{"x": 1E3}', "float"), "c": ('{"x": "12.5 \\\\", "y": -3}', None), "d": (deep(32), None), "e": (deep(33), "too deep"), "f": ('{"x": NaN}', "malformed"), "g": ("[1]", "not an object"), "h": ("\ufeff{}", "byte-order mark"), "i": ('{"s": "' + "[" * 50 + '\\""}', None), "j": ('{"s": "' + "x" * 200_000 + '"}', None)}
    for name, (body, _) in cases.items():
        (tmp_path / f"{name}.json").write_text(body, encoding="utf-8")
    (tmp_path / "k.json").write_bytes(b'{"s": "\xff"}')
    cases["k"] = ("", "not UTF-8")
    got = {r["file"].rsplit("/", 1)[1][:-5]: r["refusal"] for r in manifests.read_fixtures(spark, str(tmp_path)).collect()}
    assert got == {n: want for n, (_, want) in cases.items()}


def test_a_response_is_no_longer_than_its_search(spark):
    found = spark.createDataFrame([("q", i, i) for i in range(1, 30)], "query_id string, chunk_id long, rank int")
    assert retrieval.responses(found, 2).first()["body"] == '[{"rank":1,"chunk":1},{"rank":2,"chunk":2}]'
    for limit in (0, 51):
        with pytest.raises(ValueError, match="response"):
            retrieval.responses(found, limit)


def test_a_chain_that_stays_correlated_has_no_effective_size(spark):
    rng, rows = random.Random(3), []
    for name, keep in (("slow", 0.99), ("fast", 0.3)):
        for chain in range(2):
            x = 0.0
            for i in range(2000):
                x = keep * x + rng.gauss(0, 1)
                rows.append((name, chain, i, x))
    df = spark.createDataFrame(rows, "p string, c int, i int, v double")
    got = {r["p"]: r["ess"] for r in forecast.effective_sizes(df, parameter="p", chain="c", order="i", value="v").collect()}
    assert got["slow"] is None and 1400 < got["fast"] < 3200


def _odd_records(spark, n=150):
    rng = random.Random(9)
    word = lambda: rng.choice((None, "", "large ring", "hot bolt", "höt bolts", "x" * 300))
    rows = [(i, i % 2, rng.choice(("m1", "m1", "m2", None)), rng.choice((None, "", f"PN{rng.randrange(40):03d}", f"PN0{rng.randrange(40)}é")), word(), rng.choice((None, "ea", "m"))) for i in range(n)]
    return spark.createDataFrame(rows, "record_id long, project int, norm_manufacturer string, norm_part string, description string, unit string")


@pytest.mark.parametrize("sizes", [(1, 8), (4, 40), (1000, 1000)])
def test_scores_leave_their_blocks_as_counts(spark, sizes):
    """Blocks of every size give the scores that all candidates have one by one."""
    own = _odd_records(spark)
    by = [*(f"s_{k}" for k in identity.WEIGHTS), "project", "score", "band"]
    every = identity.scored(identity.candidates(own, prefix=4), own)
    size = {"chunk_records": sizes[0], "block_records": sizes[1]}
    assert {tuple(r) for r in identity.score_counts(own, prefix=4, **size).groupBy(*by).agg(F.sum("n")).collect()} == {tuple(r) for r in every.groupBy(*by).count().collect()}
    for band in ("merge", "withhold", "reject"):
        got = identity.scored_candidates(own, band, prefix=4, **size).select("a", "b", *by).collect()
        assert sorted(map(str, got)) == sorted(map(str, every.where(F.col("band") == band).select("a", "b", *by).collect()))
    parts = own.select("record_id", "project", "norm_manufacturer", "norm_part").collect()
    want = sum(x[1] == y[1] and x[2] is not None and x[2] == y[2] and x[3] is not None and x[3] == y[3] for x in parts for y in parts if x[0] < y[0])
    assert identity.score_counts(own, prefix=4, **size).where("exact and s_manufacturer = 1").agg(F.sum("n")).first()[0] == want


def test_no_pair_of_a_large_block_is_shuffled(spark):
    """2,000 records of one manufacturer are 2 million candidates."""
    own = spark.range(2_000).selectExpr("id as record_id", "0 as project", "'m' as norm_manufacturer", "concat('PN', lpad(cast(id as string), 6, '0')) as norm_part", "'ring' as description", "'ea' as unit")
    out = identity.score_counts(own, prefix=7, chunk_records=64, block_records=512)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan
    assert out.agg(F.sum("n")).first()[0] == 2_000 * 1_999 // 2
    assert out.count() < 100

"""Stems one by one, places of weighted fields, and the rank against plain Python."""

import math
import random

import pytest

from wharfline.functions import stemming
from wharfline.operators import lexical as X

# Published pairs of a word and its stem.
STEMS = """
consign:consign consigned:consign consigning:consign consignment:consign consist:consist consisted:consist consistency:consist
consistent:consist consistently:consist consisting:consist consists:consist consolation:consol consolations:consol
consolatory:consolatori consolidate:consolid consolidating:consolid consoling:consol consolingly:consol consols:consol
consonant:conson consort:consort consorted:consort conspicuous:conspicu conspicuously:conspicu conspiracy:conspiraci
conspirator:conspir conspiring:conspir constable:constabl constancy:constanc constant:constant knack:knack knackeries:knackeri
knaves:knave knavish:knavish kneaded:knead kneel:kneel kneeled:kneel kneels:kneel knees:knee knell:knell knelt:knelt knew:knew
knick:knick knif:knif knife:knife knight:knight knightly:knight knights:knight knit:knit knits:knit knitted:knit knitting:knit
knives:knive knob:knob knock:knock knocked:knock knocker:knocker knocking:knock knopp:knopp knots:knot generate:generat
generates:generat generated:generat generating:generat general:general generally:general generic:generic generically:generic
generous:generous generously:generous communism:communism community:communiti hopping:hop hoping:hope hoped:hope troubling:troubl
fizzed:fizz failing:fail filing:file ties:tie cries:cri gas:gas gaps:gap kiwis:kiwi luxuriating:luxuri agreed:agre feed:feed
sky:sky skies:sky dying:die early:earli news:news innings:inning exceeds:exceed proceed:proceed happy:happi say:say enjoy:enjoy
youth:youth yes:yes relational:relat conditional:condit rational:ration valenci:valenc digitizer:digit vietnamization:vietnam
predication:predic operator:oper feudalism:feudal decisiveness:decis hopefulness:hope callousness:callous formality:formal
sensitivity:sensit sensibility:sensibl triplicate:triplic formative:format formalize:formal electricity:electr electrical:electr
hopeful:hope goodness:good revival:reviv allowance:allow inference:infer airliner:airlin gyroscopic:gyroscop adjustable:adjust
defensible:defens irritant:irrit replacement:replac adjustment:adjust dependent:depend adoption:adopt communion:communion
activate:activ angularity:angular homologous:homolog effective:effect bowdlerize:bowdler probate:probat rate:rate cease:ceas
controll:control roll:roll actuator:actuat valves:valv delivery:deliveri deliveries:deliveri delivered:deliv bearings:bear
pumps:pump manufacturing:manufactur beautifully:beauti apology:apolog possibly:possibl carelessly:careless tanned:tan argue:argu
arguing:argu
""".split()


def test_stems(spark):
    want = dict(p.split(":") for p in STEMS)
    odd = {"": "", "a1s": "a1s", "is": None, "the": None, "ss": "ss", "yy": "yy", "été": "été", "x" * 500 + "ing": "x" * 500 + "ing"}
    rows = [(t, 1) for t in [*want, *odd, *list(want)[:5]]] + [(None, 2)]
    got = {r["term"]: r["stem"] for r in stemming.stems(spark.createDataFrame(rows, "term string, stem int")).collect()}
    assert got.pop(None) is None and got == want | odd


def test_no_stems_of_nothing(spark):
    assert stemming.stems(spark.createDataFrame([], "term string")).count() == 0


def by_pairs(lexemes):
    """The rank of a match, two places at a time."""
    res = 1.0
    for i in range(len(lexemes)):
        for j in range(i):
            for p, v in lexemes[i]:
                for q, w in lexemes[j]:
                    if p != q:
                        d = abs(p - q)
                        near = 1e-30 if d > 100 else 1 / (1.005 + 0.05 * math.exp(d / 1.5 - 2))
                        res *= 1 - math.sqrt(X.WEIGHTS[v] * X.WEIGHTS[w] * near)
    return 1 - res


def test_fields_places_and_ranks(spark):
    rng = random.Random(2)
    heading, body = ["pump", "pumps", "valve", "the", "of"], ["pumping", "valves", "seal", "and", "steel", "pump"]
    rows = [(i, " ".join(rng.choices(heading, k=rng.randrange(5))) or None, " ".join(rng.choices(body, k=rng.randrange(30))), 7) for i in range(60)] + [(None, "pump valve", "x", 1), (99, None, None, None)]
    chunks = spark.createDataFrame(rows, "chunk_id long, h string, b string, place int").repartition(3)
    queries = spark.createDataFrame([("q1", ["pumps", "the", "valve"]), ("q2", ["seals"]), ("q3", ["the"]), ("q4", ["pump", "absent"]), ("q5", [])], "query_id string, terms array<string>")
    asked = X.asked_stems(queries)
    assert {(r["query_id"], r["stem"], r["wanted"]) for r in asked.collect()} == {("q1", "pump", 2), ("q1", "valv", 2), ("q2", "seal", 1), ("q4", "pump", 2), ("q4", "absent", 2)}
    found = X.postings(chunks, {"A": "h", "D": "b"}, asked.select("stem")).cache()
    stem = {"pump": "pump", "pumps": "pump", "pumping": "pump", "valve": "valv", "valves": "valv", "seal": "seal"}
    places = {}
    for i, h, b, _ in rows:
        first, last = (h or "").split(), 0
        for k, t in enumerate(first):
            if t in stem or t not in ("the", "of", "and"):
                last = k + 1
        for label, terms, before in (("A", first, 0), ("D", (b or "").split(), last)):
            for k, t in enumerate(terms):
                if t in stem:
                    places.setdefault((i, stem[t]), []).append((k + 1 + before, label))
    assert {(r["chunk_id"], r["stem"]): list(zip(r["places"], r["labels"], strict=True)) for r in found.collect()} == places
    met = X.matches(found, asked)
    got = {(r["query_id"], r["chunk_id"]): r["score"] for r in X.weighted_rank_topk(met, k=1000).collect()}
    want = {("q1", i): by_pairs([places[i, "pump"], places[i, "valv"]]) for i, *_ in rows if i is not None and (i, "pump") in places and (i, "valv") in places}
    for i, *_ in rows:
        if (at := places.get((i, "seal"))) is not None:
            want["q2", i] = (0.1 + sum(0.1 / (k + 1) ** 2 for k in range(len(at))) - 0.1) / 1.64493406685
    assert set(got) - {("q1", None)} == set(want) and all(got[k] == pytest.approx(v, abs=1e-8) for k, v in want.items())
    counted = {(r["query_id"], r["chunk_id"]): r["score"] for r in X.stemmed_topk(met, k=1000).collect()}
    assert all(counted["q2", i] == pytest.approx(len(places[i, "seal"]) / (len(places[i, "seal"]) + 1)) for q, i in want if q == "q2")
    assert [r["rank"] for r in X.weighted_rank_topk(met, k=3).where("query_id = 'q1'").orderBy("rank").collect()] == [1, 2, 3]
    assert X.weighted_rank_topk(X.matches(found.limit(0), asked)).count() == 0


def test_a_heavy_place_counts_whole():
    import numpy as np

    assert X.weighted_rank([(np.array([3, 9]), np.array([0.1, 1.0]))]) == pytest.approx((1.0 + 0.1 + 0.25 - 0.25) / 1.64493406685)


def test_queries_of_the_same_stems_are_searched_once(spark):
    asked = spark.createDataFrame([(1, "b", 2), (1, "a", 2), (2, "a", 2), (2, "b", 2), (3, "a", 1), (4, "zz", 1)], "query_id long, stem string, wanted long")
    found = spark.createDataFrame([(10, "a", [1, 9], ["A", "D"]), (10, "b", [2], ["D"]), (11, "a", [4], ["C"]), (12, "b", [1], ["B"])], "chunk_id long, stem string, places array<int>, labels array<string>")
    once, home = X.alike(asked)
    assert {r["query_id"] for r in once.collect()} == {1, 3, 4}
    assert {tuple(r) for r in home.collect()} == {(1, 1), (2, 1), (3, 3), (4, 4)}
    for topk in (X.stemmed_topk, X.weighted_rank_topk):
        got = X.answered(topk(X.matches(found, once)), home)
        assert sorted(map(str, got.collect())) == sorted(map(str, topk(X.matches(found, asked)).select(*got.columns).collect()))
        assert {(r["query_id"], r["chunk_id"]) for r in got.collect()} == {(1, 10), (2, 10), (3, 10), (3, 11)}


def test_matches_are_not_shuffled(spark):
    from wharfline.shared import materialize

    asked = spark.range(400).selectExpr("id as query_id", "explode(array('a', 'b')) as stem", "2L as wanted")
    found = materialize(spark.range(50).selectExpr("id as chunk_id", "explode(array('a', 'b')) as stem", "array(1, 2) as places", "array('A', 'D') as labels"), "postings")
    met = X.matches(found, asked)
    plan = met._jdf.queryExecution().optimizedPlan().toString()
    assert met.count() == 20_000 and plan.count("Join") == 1


def searched(rng, n):
    words = ["pump", "pumps", "valve", "valves", "seal", "steel", "the", "of"]
    rows = [(i, " ".join(rng.choices(words, k=rng.randrange(4))) or None, " ".join(rng.choices(words, k=rng.randrange(60)))) for i in range(n)]
    # copies of one score, an id on three rows, a posting beyond its most places, places beyond the last
    rows += [(1000 + i, None, "steel valve") for i in range(9)] + [(7, "steel pump", "seal " * 200), (7, None, "valve seal " * 150), (n + 1, "x", "pump seal " * 300), (n + 2, None, "x " * 16_380 + "pump valve seal steel"), (n + 3, "", None), (None, None, "pump valve")]
    asked = [(1, ["pump"]), (2, ["pump", "valv"]), (3, ["seal", "steel", "valv"]), (4, ["absent", "pump"]), (5, ["seal", "steel"]), (6, ["steel", "valv"])]
    return rows, [(q, s, len(stems)) for q, stems in asked for s in stems]


@pytest.mark.parametrize("sizes", [{}, {"BLOCK_PLACES": 300, "TASK_SETS": 2, "FEW_BYTES": 100}])
def test_blocks_have_the_ranks_of_all_matches(spark, monkeypatch, sizes):
    for name, value in sizes.items():
        monkeypatch.setattr(X, name, value)
    rows, asked = searched(random.Random(4), 80)
    chunks = spark.createDataFrame(rows, "chunk_id long, h string, b string").repartition(3)
    asked = spark.createDataFrame(asked, "query_id long, stem string, wanted long")
    fields = {"A": "h", "D": "b"}
    for k in (5, 1000):
        got = X.weighted_rank_best(chunks, fields, asked, k)
        want = X.weighted_rank_topk(X.matches(X.postings(chunks, fields, asked.select("stem")), asked), k)
        assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    assert got.where("query_id = 3").count() > 20 and got.where("chunk_id is null").count() > 0
    assert X.weighted_rank_best(chunks.limit(0), fields, asked).count() == 0
    assert X.weighted_rank_best(chunks, fields, asked.limit(0)).count() == 0


def test_pairs_of_places_are_held_in_shares(monkeypatch):
    import numpy as np
    import pyarrow as pa

    rng = random.Random(3)
    rows = [[sorted(rng.sample(range(1, 400), 60)) for _ in "ab"] for _ in range(5)]
    at = [[p << 2 | rng.randrange(4) for stem in row for p in stem] for row in rows]
    block = X.Block(pa.array(range(5)), pa.array([[0, 1]] * 5), pa.array([[60, 60]] * 5), pa.array(at), 2)
    whole = block.ranks([0, 1])
    monkeypatch.setattr(X, "HELD_PAIRS", 700)
    for got in (whole, block.ranks([1, 0])):
        assert got[0].tolist() == list(range(5))
        assert got[1] == pytest.approx([by_pairs([[(v >> 2, "ABCD"[v & 3]) for v in x] for x in (row[:60], row[60:])]) for row in at], abs=1e-12)
    assert np.allclose(block.ranks([0])[1], [X.weighted_rank([(np.array(row[:60]) >> 2, X._WEIGHT[np.array(row[:60]) & 3])]) for row in at], atol=1e-12)


def test_no_row_for_a_match(spark, sf):
    from wharfline.plans import retrieval

    assert "explode" not in retrieval.weighted_rank_topk(spark, sf)._jdf.queryExecution().optimizedPlan().toString()

"""Packing by jumps and chunks along the ladder, against walks in plain Python."""

import random
import re

from wharfline.operators import packing, structure


def greedy(weights, budget):
    out, start, held = [], 1, 0
    for i, w in enumerate(weights, 1):
        if i > start and held + w > budget:
            out.append((start, i - start))
            start, held = i, 0
        held += w
    return [*out, (start, len(weights) + 1 - start)] if weights else []


def test_packs_are_greedy(spark):
    rng = random.Random(3)
    keys = {k: [rng.choice((1, 1, 2, 5, 9, 40)) for _ in range(n)] for k, n in enumerate((1, 2, 7, 60, 900))}
    keys[9] = [1] * 500
    rows = [(k, i, w) for k, ws in keys.items() for i, w in enumerate(ws, 1)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "k long, i int, w long").repartition(4)
    got = {}
    for r in packing.packed(df, key="k", at="i", weight="w", budget=12).collect():
        got.setdefault(r["k"], []).append((r["start"], r["n"]))
    assert {k: sorted(v) for k, v in got.items()} == {k: greedy(ws, 12) for k, ws in keys.items()}
    assert packing.packed(df.limit(0), key="k", at="i", weight="w", budget=12).count() == 0


def test_packs_of_a_long_chain_take_few_rounds(spark, monkeypatch):
    rounds, real = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: rounds.append(name) or real(df, name))
    df = spark.range(1, 3001).selectExpr("0L as k", "id as i", "7L as w")
    assert packing.packed(df, key="k", at="i", weight="w", budget=10).count() == 3000
    assert rounds.count("hops") <= 12


LEVEL = [(r"^SECTION\s+(\d\d \d\d \d\d)$", 0), (r"^PART\s+(\d+)\s+[A-Z].*$", 1), (r"^(\d+\.\d+)\s+\S.*$", 2), (r"^(\d+\.\d+\.\d+)\s+\S.*$", 3), (r"^(\d+(?:\.\d+){3,5})\s+\S.*$", 4), (r"^([a-z])\.\s+\S.*$", 5)]
NAMES = ["section", "part", "article", "paragraph", "subparagraph", "lettered_item", "preamble"]


class Unit:
    def __init__(self, level, mark):
        self.level, self.mark, self.own, self.below = level, mark, [], []

    def lines(self):
        return [*self.own, *(x for b in self.below for x in b.lines())]


def n_pieces(text):
    return len([w for w in re.split(r"[ \n]+", text) if w])


def by_descent(lines, budget):
    top, path = [], []
    for line in lines:
        bare = line.strip(" ")
        found = next(((level, m.group(1)) for pattern, level in LEVEL if (m := re.match(pattern, bare))), None)
        if found:
            unit = Unit(*found)
            path = [u for u in path if u.level < unit.level]
            (path[-1].below if path else top).append(unit)
            path.append(unit)
        elif not path:
            unit = Unit(6, "")
            top.append(unit)
            path.append(unit)
        path[-1].own.append(line)
    out = []

    def descend(unit):
        text = "\n".join(unit.lines())
        if n_pieces(text) <= budget:
            out.append((NAMES[unit.level], unit.mark, text))
        elif unit.below:
            own = Unit(unit.level, unit.mark)
            own.own = unit.own
            descend(own)
            for b in unit.below:
                descend(b)
        else:
            sentences = [s for s in re.findall(r"[^.!?]+[.!?]*\s*", text) if s.strip(" \n")]
            for start, n in greedy([n_pieces(s) for s in sentences], budget):
                part = "".join(sentences[start - 1 : start - 1 + n])
                out.append(("over_budget" if n_pieces(part) > budget else "sentence", unit.mark, part.strip(" \n")))

    for unit in top:
        descend(unit)
    return [(i, c, m, n_pieces(t), t) for i, (c, m, t) in enumerate(x for x in out if n_pieces(x[2]))]


def test_chunks_along_the_ladder(spark):
    rng = random.Random(8)
    marks = ["SECTION 23 52 00", "PART 1 GENERAL", "1.1 SUMMARY", "1.2 Scope", "1.1.3 Work", "1.1.3.4 Deep", "a. First", "b. Second"]
    docs = {}
    for d in range(60):
        body = lambda: " ".join(rng.choice(["pump", "valve.", "seal", "is!", "and"]) for _ in range(rng.choice((0, 1, 3, 8, 30))))
        docs[d] = [rng.choice(marks) if rng.random() < 0.4 else body() for _ in range(rng.randrange(1, 40))]
    docs[100], docs[101], docs[102] = ["", " "], ["word " * 50], ["PART 1 GENERAL", "word " * 30 + ". Next one."]
    rows = [(d, i, line, "x") for d, lines in docs.items() for i, line in enumerate(lines, 1)] + [(103, 1, None, "x")]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "document_id long, line_no int, line string, body string").repartition(4)
    got = {d: [] for d in docs}
    for r in structure.ladder_chunks(df, budget=20).collect():
        got[r["document_id"]].append((r["ordinal"], r["boundary"], r["identifier"], r["pieces"], r["body"]))
    for d, lines in docs.items():
        assert sorted(got[d]) == by_descent(lines, 20), d
    assert got[100] == [] and {c for v in got.values() for _, c, *_ in v} >= {"part", "article", "lettered_item", "sentence", "over_budget", "preamble"}
    assert structure.ladder_chunks(df.limit(0)).count() == 0


def test_rounds_of_packing_are_dealt_in_bounded_shares(spark, monkeypatch):
    made, real = [], packing.materialize
    monkeypatch.setattr(packing, "materialize", lambda df, name: made.append((name, df.rdd.getNumPartitions())) or real(df, name))
    monkeypatch.setattr("wharfline.shared.TASK_ROWS", 100)
    held = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    df = spark.range(1, 3001).selectExpr("id % 7 as k", "(id - 1) div 7 + 1 as i", "7L as w")
    try:
        for k, v in zip(held, ("false", "-1"), strict=True):
            spark.conf.set(k, v)
        assert packing.packed(df, key="k", at="i", weight="w", budget=20).count() == 4 * len(greedy([7] * 429, 20)) + 3 * len(greedy([7] * 428, 20))
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
    assert {n for name, n in made if name in ("packs", "marks", "hops")} == {30}


def test_fragments_are_found_in_one_share_of_documents(spark, monkeypatch):
    plans, real = {}, structure.materialize
    monkeypatch.setattr(structure, "materialize", lambda df, name: plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]) and real(df, name))
    df = spark.range(1_000).selectExpr("id % 10 as document_id", "id div 10 + 1 as line_no", "concat('PART ', id, ' GENERAL') as line")
    assert structure.ladder_chunks(df, budget=20).count() == 1_000
    assert set(plans) == {"fragments", "sentences"} and plans["fragments"].count("Exchange ") == 1


def test_shares_of_bytes(spark):
    from wharfline import shared

    df = spark.range(1_000).selectExpr("id as k", "repeat('x', 1000) as t")
    assert shared.spread(df, "k", task_bytes=100_000).rdd.getNumPartitions() == 11
    assert shared.spread(df.limit(0), "k").count() == 0

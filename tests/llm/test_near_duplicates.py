"""Near duplicates where ids repeat, and where one bucket holds most of the rows."""

import itertools
import random

import pytest

from tests.llm import fixtures as X
from wharfline.llm import neardup


def of_rows(rows, k, num, den):
    """Component of each row by its texts alone, and that of each doc_id over all its texts, by brute force."""
    sets = [X.shingles(t, k) for _, t in rows]

    def spread(n, pairs):
        up = list(range(n))

        def root(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
        return [root(i) for i in range(n)]

    near = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    same = [(a, b) for a, b in itertools.combinations(range(len(rows)), 2) if rows[a][0] is not None and rows[a][0] == rows[b][0]]
    texts, whole = spread(len(rows), near), spread(len(rows), near + same)
    least = {}
    for (i, _), r in zip(rows, whole, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return sets, texts, [None if i is None else least[r] for (i, _), r in zip(rows, whole, strict=True)]


def torn(seed, n=90, ids=30):
    rng = random.Random(seed)
    base = [X.prose(rng, 60) for _ in range(6)]
    rows = [(rng.randrange(ids), X.edited(rng, rng.choice(base), rng.choice((0, 0, 0.01, 0.3)))) for _ in range(n)]
    return [*rows, rows[4], rows[4], (7, None), (7, ""), (2, None), (900, None), (None, base[0]), (None, None), (2**63 - 1, base[1]), (-(2**63), base[2])]


@pytest.mark.parametrize("rows", [[(3, "a a2 a3 a4 a5 a6"), (5, "a a2 a3 a4 a5 a6"), (5, "b b2 b3 b4 b5 b6"), (9, "b b2 b3 b4 b5 b6")], torn(1), torn(2, 60, 5), [(0, X.prose(random.Random(i), 30)) for i in range(400)] + [(1, "x y z")]])
def test_repeated_ids_as_brute_force(spark, rows):
    sets, texts, component = of_rows(rows, 3, 85, 100)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in neardup.near_duplicates(df, shingle_words=3, similarity=(85, 100)).collect()), key=str)
    assert got == sorted(((i, len(s), c, i is None or i == c) for (i, _), s, c in zip(rows, sets, component, strict=True)), key=str)
    kept = neardup.keep_one_of_each(df, shingle_words=3, similarity=(85, 100)).collect()
    place = {r: i for i, r in enumerate(rows)}
    wordy = [r for r in map(tuple, kept) if r[0] is not None and X.words(r[1])]
    # one text of each class, none left out; all rows without an id; texts without words once for each id and text
    assert sorted(texts[place[r]] for r in wordy) == sorted({t for (i, _), t, s in zip(rows, texts, sets, strict=True) if i is not None and s})
    assert sorted((tuple(r) for r in kept if r[0] is None), key=str) == sorted((r for r in rows if r[0] is None), key=str)
    assert sorted((tuple(r) for r in kept if r[0] is not None and not X.words(r[1])), key=str) == sorted({r for r in rows if r[0] is not None and not X.words(r[1])}, key=str)


def test_a_bucket_with_half_of_all_rows(spark):
    rng = random.Random(3)
    w = X.prose(rng, 200).split()
    rows = []
    for i in range(500):
        own = list(w)
        own[rng.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(own)))
    rows += [(1000 + i, X.prose(rng, 80)) for i in range(500)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(8)).collect()}
    assert got == {i: 0 if i < 500 else i for i, _ in rows}

"""Places where an operator once did less than its whole job."""

import random
from collections import Counter
from pathlib import Path

import pyarrow as pa
import pyspark

from tests.llm import fixtures as X

from wharfline.llm import kernels, licenses, lines, syncmers


def test_the_ratio_decides_on_small_hosts(spark):
    rows = [(i, "small", f"own {i}\nHome | About") for i in range(3)] + [(10 + i, "single", "Home | About") for i in range(1)]
    rows += [(20 + i, "middle", f"body {i}" + ("\nfooter" if i < 3 else "") + ("\nrare" if i < 2 else "")) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string")
    got = {r["page_id"]: (r["text"], r["n_dropped"]) for r in lines.drop_boilerplate(df, host_col="host", text_col="text").collect()}
    assert [got[i] for i in range(3)] == [(f"own {i}", 1) for i in range(3)]
    assert got[10] == ("Home | About", 0)
    # 3 of 20 pages are more than a tenth, 2 of 20 are not
    assert Counter(got[20 + i][1] for i in range(20)) == {1: 3, 0: 17} and got[20] == ("body 0\nrare", 1)


def test_whole_license_texts_from_elsewhere(spark):
    folder = Path(pyspark.__file__).parent / "licenses"
    rows = [(0, (folder / "LICENSE-CC0.txt").read_text()), (1, (folder / "LICENSE-py4j.txt").read_text()), (2, (folder / "LICENSE-jquery.txt").read_text()), (3, "All rights reserved.")]
    got = {}
    for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(1)).collect():
        got.setdefault(r["doc_id"], set()).add(r["template"])
    assert got[0] == {"cc0-1.0-text"} and "bsd-3-clause-text" in got[1] and "mit-text" in got[2] and got[3] == {"all-rights-reserved"}


def test_altered_license_texts_as_brute_force(spark):
    rng = random.Random(8)
    texts, rows = licenses.whole_texts(), []
    assert {f"{x}-text" for x in ("mit", "bsd-2-clause", "bsd-3-clause", "isc", "zlib", "unlicense", "apache-2.0", "mpl-2.0", "gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0")} <= set(texts)
    for i, t in enumerate(texts.values()):
        w = t.split()
        few = [rng.choice(w) if rng.random() < 0.02 else x for x in w]
        many = [rng.choice(w) if rng.random() < 0.3 else x for x in w]
        rows += [(3 * i, f"{X.prose(rng, 40)} {' '.join(few)} {X.prose(rng, 40)}"), (3 * i + 1, " ".join(many)), (3 * i + 2, " ".join(w[: len(w) // 2])), (1000 + i, f"{X.prose(rng, 9)} {t}")]
    grams = lambda t: {tuple(w[j : j + 5]) for w in [t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).split()] for j in range(len(w) - 4)}
    wanted, held = {n: grams(t) for n, t in texts.items()}, {i: grams(t) for i, t in rows}
    want = {(i, n, len(g), len(g & h)) for i, h in held.items() for n, g in wanted.items() if 100 * len(g & h) >= 80 * len(g)}
    got = {(r["doc_id"], r["template"], r["n_template_shingles"], r["n_shared"]) for r in licenses.license_matches(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), templates=texts).collect()}
    assert got == want and {n for _, n, _, _ in want} == set(texts)


def test_texts_without_a_syncmer_keep_apart():
    rng = random.Random(5)
    texts = sorted({"".join(rng.choice("abcdefgh ") for _ in range(16 + i % 7)) for i in range(400)})
    prints = [syncmers.written(s) for s in syncmers.fingerprints_of(["", *texts])]
    assert prints[0] == "" and "" not in prints[1:] and len(set(prints[1:])) == len(texts)
    data, offsets = kernels.buffers(pa.array(texts, pa.large_string()))
    place, _, doc = syncmers.anchors_of(data, offsets)
    assert set(doc) == set(range(len(texts))) and (doc[1:] >= doc[:-1]).all() and (place >= offsets[doc]).all()

"""The pipeline over a small made folder against plain Python, stage by stage."""

import hashlib
import random
from collections import Counter

import corpus_pipeline
import public_tokenizers as P

from tests.llm import fixtures as X
from tests.llm.test_near_duplicates import of_rows
from tests.llm.test_operators import contained
from wharfline.llm import bpe, quality


def made(spark, folder):
    rng = random.Random(12)
    items = [(i, X.prose(rng, 30)) for i in range(6)]
    bad = lambda: "\n".join(" ".join(f"{w}$$$" for w in X.prose(rng, 12).split()) for _ in range(4))
    good = lambda: "\n".join(X.prose(rng, 14).capitalize() + "." for _ in range(5))
    texts = [bad() if i % 4 == 0 else good() for i in range(160)]
    labels = [(i, int(i % 4 != 0), 0) for i in range(150)]
    base = good()
    texts += [X.edited(rng, base, 0.01) for _ in range(12)] + [base, base] + [f"{good()}\n{items[k][1]}" for k in (1, 4)] + [None, "", "short one."]
    texts = [t if t is None or i % 3 else f"{t}\nShare this page | Menu" for i, t in enumerate(texts)]
    rows = [(i, t, "en", f"s{i % 2}", len(t or "")) for i, t in enumerate(texts)] + [(5, texts[5], "en", "s1", 0), (7, good(), "en", "s1", 0), (None, good(), "en", None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return items


def test_pipeline_as_brute_force(spark, tmp_path):
    folder = str(tmp_path)
    items = made(spark, folder)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    pairs = lambda df: [(r["doc_id"], r["text"]) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)

    kept = stages["quality_classifier"](spark, docs, folder).cache()
    field = quality.train(docs, spark.read.parquet(f"{folder}/labels.parquet"), modulus=5, left_out=0)
    scores = {r["doc_id"]: r["score"] for r in quality.score_quality(docs.where("doc_id is not null and doc_id not in (5, 7)"), field).collect()}
    assert Counter(i for i, _ in pairs(kept) if i in scores) == Counter(i for i, s in scores.items() if s >= 0.3)
    assert not any(i is not None and i < 160 and i % 4 == 0 for i, _ in pairs(kept))

    lines = stages["line_dedup"](spark, kept, folder).cache()
    counts, pages = Counter(), Counter()
    for r in kept.collect():
        pages[r["source"]] += 1
        counts.update((r["source"], x) for x in {x.strip(" \t\r\f") for x in (r["text"] or "").split("\n")} - {""})
    gone = lambda s, x: s is not None and counts[s, x.strip(" \t\r\f")] > max(1, 0.1 * pages[s])
    want = Counter((r["doc_id"], "\n".join(x for x in r["text"].split("\n") if not x.strip(" \t\r\f") or not gone(r["source"], x))) for r in kept.collect())
    assert Counter(pairs(lines)) == want and want != Counter(pairs(kept))

    single = stages["minhash_near_dedup"](spark, lines, folder).cache()
    rows = pairs(lines)
    sets, texts, _ = of_rows(rows, 5, 80, 100)
    place = {r: i for i, r in enumerate(rows)}
    assert sorted(texts[place[r]] for r in pairs(single) if r[0] is not None and X.words(r[1])) == sorted({t for (i, _), t, s in zip(rows, texts, sets, strict=True) if i is not None and s})

    clean = stages["benchmark_decontamination"](spark, single, folder).cache()
    leaky = {d for d, *_ in contained(dict(pairs(single)), items)}
    assert {i for i, _ in pairs(clean)} == {i for i, _ in pairs(single)} - leaky and leaky

    ranks = bpe.ranks_of(P.path("byte_bpe_50k.tiktoken"), P.PATTERN).core
    digest = lambda b: hashlib.sha256(b).hexdigest()
    want = Counter((i, len(ids), digest(" ".join(map(str, ids)).encode()), digest((t or "").encode())) for i, t in pairs(clean) for ids in [ranks.encode_ordinary(t or "")])
    assert Counter(tuple(r) for r in corpus_pipeline.run(spark, folder).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()) == want

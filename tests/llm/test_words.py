"""Operators 11 to 13: the tokenization automaton, spelling variants and the divergence of sources, against plain Python."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction
from math import floor
from zlib import crc32

import public_tokenizers as P
import pytest
from tests.llm import fixtures as X
from tests.llm.test_operators import HARD, UNSPACED

from wharfline.llm import automaton, divergence, spelling

JSON = P.path("byte_bpe_50k.json")


# ---------------------------------------------------------------- 11: tokenization automaton


def merged(word, merges):
    """The merges in their order, each over the whole word from the left."""
    word = list(word)
    for a, b, c in merges:
        i, out = 0, []
        while i < len(word):
            pair = word[i : i + 2] == [a, b]
            out.append(c if pair else word[i])
            i += 1 + pair
        word = out
    return word


@pytest.mark.parametrize("seed", range(12))
def test_paths_are_the_token_sequences_of_the_merges(seed):
    rng = random.Random(seed)
    base, spelled, merges = [0, 1, 2], {i: (i,) for i in range(3)}, []
    while len(merges) < 25:
        a, b = rng.choice(list(spelled)), rng.choice(list(spelled))
        if spelled[a] + spelled[b] not in spelled.values() and len(spelled[a] + spelled[b]) < 9:
            merges.append((a, b, len(spelled)))
            spelled[len(spelled)] = spelled[a] + spelled[b]
    found = automaton.Automaton(base, merges)
    for _ in range(300):
        word = [rng.choice(base) for _ in range(rng.randrange(1, 14))]
        # every way to spell the word in tokens: one of them is a path
        ways = [[[]]] + [[] for _ in word]
        for i in range(len(word)):
            for t, s in spelled.items():
                if tuple(word[i : i + len(s)]) == s:
                    ways[i + len(s)] += [w + [t] for w in ways[i] if found.follows(w[-1] if w else None, t)]
        assert ways[-1] == [merged(word, merges)]


def test_merges_out_of_order_are_refused():
    with pytest.raises(ValueError):
        automaton.Automaton([0, 1], [(2, 0, 3), (0, 1, 2)])
    with pytest.raises(ValueError):
        automaton.Automaton([0, 1, 2], [(0, 1, 3), (3, 2, 4), (1, 2, 5), (0, 5, 4)])
    with pytest.raises(ValueError):
        automaton.transducer_of(P.path("word_bpe_49k.json"))


def test_the_automaton_encodes_and_decodes_as_the_library(spark, monkeypatch):
    from tokenizers import Tokenizer

    rng = random.Random(4)
    bits = ["a", " ", "  ", "\n\n", "'s", "'", "é", "日", "😀", "\x00", "\x85", "\xa0", "1", "23", "!!!", "<|endoftext|>", "<|endo", "the", " the", "ẞ", "\U0001fae8", "Z", "\t", "ͅ", "x" * 40]
    texts = [*HARD, *UNSPACED, *X.texts().values(), *("".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(1500)), "word " * 3000 + "日本 \U0001fae8\n" * 200]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in enumerate(texts)] + [(None, "no id", 1, "x"), (0, texts[0], 2, None)], "doc_id long, text string, ids int, n_tokens string").repartition(3)
    model = Tokenizer.from_file(JSON)
    got = automaton.encode_decode(df, tokenizer_path=JSON, with_ids=True).collect()
    assert len(got) == len(texts) + 2
    for r in got:
        ids = model.encode("no id" if r["doc_id"] is None else texts[r["doc_id"]] or "", add_special_tokens=False).ids
        text = model.decode(ids, skip_special_tokens=False)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and r["decoded"] == text
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    monkeypatch.setattr(automaton, "BLOCK_CHARS", 10)
    for t in texts:
        ids = [i for part in automaton.transducer_of(JSON).encode(t or "") for i in part.tolist()]
        assert ids == model.encode(t or "", add_special_tokens=False).ids
    assert automaton.encode_decode(df.limit(0), tokenizer_path=JSON).count() == 0


def test_cut_paths_decode_as_the_library():
    from tokenizers import Tokenizer

    model, own, rng = Tokenizer.from_file(JSON), automaton.transducer_of(JSON), random.Random(6)
    for _ in range(500):
        ids = [rng.randrange(50257) for _ in range(rng.randrange(1, 12))]
        assert own.decode(ids).decode("utf-8", "replace") == model.decode(ids, skip_special_tokens=False)


# ---------------------------------------------------------------- 12: spelling variants


def near(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    return any((a[:i] if len(a) < len(b) else a[:i] + a[i + 1 :]) + (a[i:] if len(a) < len(b) else "") == b[:i] + b[i + 1 :] for i in range(len(b)))


def by_hand(words, times=5):
    links = {w: [v for v in words if near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(links[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best and words[best] >= times * n else None
    out = {}
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out[w] = (form[w], root, n, len(links[w]), words[form[w]] if form[w] else None)
    return out


def shown(df):
    return {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect()}


@pytest.mark.parametrize("block", [2_000, 3])
def test_variants_as_brute_force(spark, monkeypatch, block):
    rng = random.Random(9)
    words = {}
    for _ in range(60):
        word = "".join(rng.choice("abéz") for _ in range(rng.randrange(6, 12)))
        words[word] = rng.randrange(5, 10_000)
        for _ in range(8):
            i, kind = rng.randrange(len(word)), rng.randrange(3)
            other = word[:i] + (rng.choice("abéz") if kind else "") + word[i + (kind < 2) :]
            if len(other) >= 6:
                words.setdefault(other, rng.randrange(5, 60))
    words |= {"aaaaaaa": 9, "aaaaaa": 60, "aaaaaaaa": 400, "abababab": 7, "babababa": 7, "aabababab": 7, "a" * 300: 5, "a" * 301: 30}
    df = spark.createDataFrame(list(words.items()), "word string, n long").repartition(3)
    monkeypatch.setattr(spelling.near_pairs, "__kwdefaults__", {"block": block})
    assert shown(spelling.variants(df)) == by_hand(words)
    pairs = [frozenset((r["word"], r["near"])) for r in spelling.near_pairs(df).collect()]
    assert len(pairs) == len(set(pairs)) == sum(v[3] for v in by_hand(words).values()) // 2


def test_a_chain_of_forms_has_one_root(spark):
    words = {"abcdef" + "x" * i: 6**i * 5 for i in range(11)}
    got = shown(spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long")))
    assert {v[1] for v in got.values()} == {"abcdef" + "x" * 10}


@pytest.mark.parametrize("every", [199, 7])
def test_word_counts_of_awkward_tables(spark, every):
    texts = ["Straßen STRASSEN straßen ÀÉÎÕÜÿ×÷ abcdefg" * 2, "Hello-worldly worldly_worldly 漢字worldly", None, "", "x" * 5000, "worldly " * 400]
    rows = [(i, t, 3, "w") for i, t in enumerate(texts)] + [(i, "worldly Worldly elsewhere", 3, "w") for i in range(10, 400)] + [(None, "worldly elsewhere", None, None), (10, "worldly", 1, "")]
    want = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(X.FOLD)
            h = crc32(f"{'' if i is None else i}:{run}".encode())
            want[run[: h % len(run)] + run[h % len(run) + 1 :] if h % every == 0 else run] += 1
    df = spark.createDataFrame(rows, "doc_id long, text string, n int, word string").repartition(3)
    counted = spelling.word_counts(df, damaged_every=every)
    got = {r["word"]: r["n"] for r in counted.collect()}
    assert got == {w: n for w, n in want.items() if len(w) >= 6 and n >= 5} and len(got) >= (2 if every > 7 else 5)
    assert shown(spelling.variants(counted)) == by_hand(got)
    assert spelling.variants(spelling.word_counts(df.limit(0), damaged_every=199)).count() == 0


# ---------------------------------------------------------------- 13: divergence of sources


def diverging(rows, least, most):
    docs = [(lang or "", source or "", re.findall("[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+", (text or "").translate(X.FOLD))) for lang, source, text in rows]
    seen = Counter((lang, t) for lang, _, terms in docs for t in set(terms))
    kept = defaultdict(list)
    for (lang, t), n in seen.items():
        if n >= least:
            kept[lang].append(t)
    counts = defaultdict(Counter)
    for lang, source, terms in docs:
        counts[lang, source].update(terms)
    share = lambda c, ts: {t: 1 + floor(Fraction(10**9 * (c[t] + 5), sum(c[x] for x in ts) + 5 * len(ts))) for t in ts}
    out = set()
    for lang in {x for x, _ in counts}:
        ts, groups = kept[lang], {s: c for (x, s), c in counts.items() if x == lang}
        q = share(sum(groups.values(), Counter()), ts)
        ps = {s: share(c, ts) for s, c in groups.items()}
        for s in groups:
            far = sorted(((sum(abs(ps[s][t] - ps[o][t]) for t in ts), o) for o in groups if o != s), key=lambda x: (-x[0], x[1].encode()))
            own = sorted(((ps[s][t] - q[t], t) for t in ts if groups[s][t] and ps[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out |= {(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(far)} | {(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(own[:most])}
    return out


def corpus():
    rng = random.Random(12)
    vocabulary = [f"t{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80)] + ["é", "漢字", "a"]
    rows = []
    for i in range(400):
        source = rng.choice(["", "A", "ä", "s1", "s2", "zz", *(f"only{k}" for k in range(30))])
        words = rng.choices(vocabulary, weights=[1 + (hash((source, w)) % 7 if source < "b" else k % 5) for k, w in enumerate(vocabulary)], k=rng.randrange(0, 60))
        rows.append((rng.choice(["en", "en", "de", None]), source or None, rng.choice([" ", "1", "--", ". "]).join(w.upper() if rng.random() < 0.2 else w for w in words) or None))
    rows += [("lone", "one", "a a a b")] * 12 + [("none", "x", "!!"), ("none", "y", None), ("none", "z", "rare")]
    return rows


@pytest.mark.parametrize(("part_bytes", "sources", "terms"), [(1 << 20, 512, 4096), (1_000, 4, 16)])
def test_divergence_as_brute_force(spark, monkeypatch, part_bytes, sources, terms):
    rows = corpus()
    monkeypatch.setattr(divergence, "SOURCES", sources)
    monkeypatch.setattr(divergence, "SLICE_TERMS", terms)
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, source string, text string, rank int, term string").repartition(4)
    got = [tuple(r) for r in divergence.divergence(df, least_documents=9, most_terms=7, part_bytes=part_bytes).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got)) and set(got) == diverging(rows, 9, 7)
    assert {r[4] for r in got if r[0] == "none"} == {0}


def test_divergence_of_nothing(spark):
    df = spark.createDataFrame([], "lang string, source string, text string")
    assert divergence.divergence(df).count() == 0


def test_shares_of_huge_counts_are_exact(spark):
    from pyspark.sql import functions as F

    rng, rows = random.Random(3), []
    for _ in range(200):
        n = rng.randrange(1, 10**18)
        rows.append((rng.randrange(0, n), n, rng.randrange(1, 10**9)))
    got = spark.createDataFrame(rows, "c long, n long, v long").select("c", "n", "v", divergence.share(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r["p"] == 1 + 10**9 * (r["c"] + 5) // (r["n"] + 5 * r["v"]) for r in got)

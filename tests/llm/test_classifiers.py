"""The two classifiers against plain-Python versions of their features and fits."""

import itertools
import math
import random

import numpy as np
import pyarrow as pa

from tests.llm import fixtures as X
from wharfline.llm import kernels as K
from wharfline.llm import quality, toxicity

TEXTS = ["A line. Another WORD!\n\nlow 12 | 34 $$$ x\n the the the the end", "", "  \n \t\n", "one", "Ünï çödé\nMORE!!", "a b a b a b\n" * 4]


def plain_line(line):
    """The features of one line, word by word."""
    sets = ["abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789", ".,;:?'\"()-", "!", "|", "#$%&*@^~<>{}[]\\=+_/`"]
    kind = lambda b: 1 if b >= 128 else next((i for i, s in enumerate(sets, 1) if chr(b) in s), 0)
    raw, words = line.encode(), X.WORD.findall(line)
    share = [sum(kind(b) == c for b in raw) / len(raw) for c in range(quality.CLASSES)]
    share[2] = share[2] / max(share[1] + share[2], 1e-9)
    out = [*share, math.log1p(len(raw)) / 5, math.log1p(len(words)) / 4, sum(len(w.encode()) for w in words) / len(words) / 10]
    for lag in (1, 2, 3):
        out.append(sum(a == b for a, b in zip(words, words[lag:])) / max(len(words) - lag, 1))  # noqa: B905
    out += [float(words[-1][-1] in ".?!:;\"'"), float(kind(words[0].encode()[0]) == 2), sum(kind(w.encode()[-1]) in (5, 6, 7) for w in words) / len(words)]
    return out


def test_line_features_as_plain_python():
    x, size, at = quality.line_features(*K.buffers(pa.array(TEXTS)))
    row = 0
    for d, text in enumerate(TEXTS):
        lines = [line for line in text.splitlines(keepends=True) if X.WORD.search(line)]
        assert at[d + 1] - at[d] == len(lines)
        own = [plain_line(line) for line in lines]
        for i, line in enumerate(lines):
            zero = [0.0] * quality.OWN
            want = own[i] + (own[i - 1] if i else zero) + (own[i + 1] if i + 1 < len(own) else zero) + [float(i == 0), float(i + 1 == len(own))]
            assert np.allclose(x[row], want) and size[row] == len(line.encode())
            row += 1
    assert row == len(x)


def enumerated(odds, at, moves):
    """Marginals by summing over all labellings."""
    good, pair = np.zeros(len(odds)), np.zeros((len(odds), 2, 2))
    for a, b in itertools.pairwise(at):
        total = 0.0
        ones, moved = np.zeros(b - a), np.zeros((b - a, 2, 2))
        for y in itertools.product((0, 1), repeat=int(b - a)):
            p = math.exp(sum(odds[a + i] * v for i, v in enumerate(y)) + sum(moves[u, v] for u, v in itertools.pairwise(y)))
            total += p
            ones += p * np.array(y)
            for i in range(1, len(y)):
                moved[i, y[i - 1], y[i]] += p
        good[a:b], pair[a:b] = ones / total, moved / total
    return good, pair


def test_the_field_is_fitted_as_with_enumerated_marginals(monkeypatch):
    rng = np.random.default_rng(3)
    at = np.array([0, 3, 4, 4, 8, 10, 13])
    y = np.array([1, 0, 1, 0, 1, 0])
    x = rng.normal(size=(13, quality.WIDTH)) + np.repeat(y, np.diff(at))[:, None] * 0.5
    fast = quality.fit(x, at, y)
    monkeypatch.setattr(quality, "marginals", enumerated)
    slow = quality.fit(x, at, y)
    assert np.allclose(fast.weights, slow.weights, atol=1e-6) and np.allclose(fast.moves, slow.moves, atol=1e-6) and abs(fast.bias - slow.bias) < 1e-6
    # at the optimum of the regularised likelihood the gradient is small
    good, _ = enumerated(fast.odds(x), at, fast.moves)
    assert np.abs(np.repeat(y, np.diff(at)) - good).mean() < 0.2


def test_a_long_text_by_blocks_as_a_whole():
    rng = random.Random(5)
    field = quality.Field(np.full(quality.WIDTH, 0.1), np.full(quality.WIDTH, 0.5), np.array([rng.gauss(0, 0.4) for _ in range(quality.WIDTH)]), 0.1, np.array([[0.7, -0.4], [-0.6, 0.9]]))
    for _ in range(200):
        lines = [rng.choice(["", "  ", "A b c.", "1 | 2 | 3", "word " * rng.randrange(1, 30), "Ünï !!", "x"]) for _ in range(rng.randrange(0, 40))]
        text = "\n".join(lines) + rng.choice(["", "\n", "\n\n"])
        data, offsets = K.buffers(pa.array([text]))
        x, size, at = quality.line_features(data, offsets)
        want = float(quality.marginals(field.odds(x), at, field.moves)[0] @ size / size.sum()) if len(x) else 0.0
        for limit in (1, 7, 40, 300, 10_000):
            ranges = list(quality.line_blocks(data, limit))
            assert [b for _, b in ranges[:-1]] == [a for a, _ in ranges[1:]] and (not ranges or (ranges[0][0], ranges[-1][1]) == (0, len(data)))
            assert all(data[b - 1] == 10 for _, b in ranges[:-1])
            blocks = [f for _, f, _ in quality.block_features(data, limit)]
            assert np.array_equal(np.concatenate([np.zeros((0, quality.WIDTH)), *blocks]), x)
            assert abs(quality.long_score(data, field, limit) - want) < 1e-12


def test_texts_longer_than_a_pass_are_scored_and_fitted_alike(spark, monkeypatch):
    texts = [*TEXTS, "Good words stand here.\n" * 5, "1 | 2 $$ |\n" * 400, None]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array([1] * len(texts)), pa.array(texts)], ["doc_id", "y", "text"])
    field = quality.Field(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.linspace(-1, 1, quality.WIDTH), 0.2, np.array([[0.5, -0.5], [-0.3, 0.3]]))
    model = type("Model", (), {"value": field})
    scores = lambda: [v for b in quality._score(model)(iter([batch])) for v in b.column(1).to_pylist()]
    fitted = lambda: [r for b in quality._featurise(iter([batch])) for r in b.to_pylist()]
    whole = scores(), fitted()
    monkeypatch.setattr(K, "PASS_BYTES", 16)
    monkeypatch.setattr(K, "passes", lambda b, text, _passes=K.passes: _passes(b, text, 16))
    assert np.allclose(scores(), whole[0], atol=2e-9, rtol=0) and fitted() == whole[1]


def test_a_score_does_not_depend_on_what_is_read_beside_it(spark):
    rng = random.Random(1)
    texts = ["\n".join(X.prose(rng, 8) for _ in range(rng.randrange(1, 9))) for _ in range(60)]
    field = quality.Field(np.zeros(quality.WIDTH), np.ones(quality.WIDTH), np.random.default_rng(1).normal(size=quality.WIDTH), 0.1, np.array([[0.3, -0.2], [0.1, 0.4]]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one = {r["doc_id"]: r["score"] for r in quality.score_quality(df.repartition(1), field).collect()}
    many = {r["doc_id"]: r["score"] for r in quality.score_quality(df.repartition(13), field).collect()}
    assert one == many


def plain_features(text):
    """Names of the features of a text, in words rather than hashes."""
    strip = ".,;:!?\"'()[]{}*#&%$|-_"
    bare = []
    for w in X.words(text):
        low, high = 0, len(w.encode())
        raw = w.encode()
        for _ in range(3):
            low += low < high - 1 and chr(raw[low]) in strip
            high -= high > low + 1 and chr(raw[high - 1]) in strip
        bare.append(raw[low:high])
    out = {("w", b) for b in bare}
    for size in toxicity.STEM_BYTES:
        forms = {}
        for b in bare:
            forms.setdefault(b[:size], set()).add(b)
        out |= {("s", size, s) for s in forms} | {("f", size, s, n) for s, own in forms.items() for n in toxicity.FORMS if len(own) >= n}
    return out | {("p", lag, a, b) for lag in (1, 2) for a, b in zip(bare, bare[lag:])}  # noqa: B905


def test_toxic_features_as_plain_python():
    rng = random.Random(2)
    texts = ["Idiot, idiots! idiotic (idiot)", "", None, "x", "Straße straßen ÉÉ", *(X.prose(rng, 60, 90) for _ in range(20))]
    hashes, doc = toxicity.features(*K.buffers(pa.array(texts, pa.string())))
    names = {}
    for d, text in enumerate(texts):
        want, got = plain_features(text), set(hashes[doc == d].tolist())
        assert len(got) == len(want)
        names.setdefault(frozenset(want), frozenset(got))
        assert names[frozenset(want)] == frozenset(got)
    # one name, one hash: what two texts share in names they share in hashes
    for (a, x), (b, y) in itertools.combinations(names.items(), 2):
        assert len(a & b) == len(x & y)


def test_ftrl_as_a_plain_loop():
    rng = np.random.default_rng(5)
    examples = [np.unique(rng.choice(np.array([3, 5, 9, 11, 400, 77, 78], dtype=np.uint32), rng.integers(1, 6))) for _ in range(120)]
    y = np.array([int(5 in e and rng.random() < 0.9) for e in examples])
    counts = {}
    for e in examples:
        for f in e.tolist():
            counts[f] = counts.get(f, 0) + 1
    known = {f for f, c in counts.items() if c >= max(toxicity.FIT_SEEN, toxicity.FIT_SHARE * len(y))} | {"bias"}
    z, n = dict.fromkeys(known, 0.0), dict.fromkeys(known, 0.0)

    def weight(f):
        l1 = 0.0 if f == "bias" else toxicity.L1
        if abs(z[f]) <= l1:
            return 0.0
        return -(z[f] - math.copysign(l1, z[f])) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for e, label in zip(examples, y.tolist(), strict=True):
            own = [f for f in e.tolist() if f in known] + ["bias"]
            w = {f: weight(f) for f in own}
            g = (1 / (1 + math.exp(-max(-50, min(50, sum(w.values()))))) - label) * (toxicity.TOXIC_WEIGHT if label else 1.0)
            for f in own:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    want = {f: weight(f) for f in known}
    got = toxicity.fit(examples, y)
    assert abs(got.bias - want.pop("bias")) < 1e-9
    assert dict(zip(got.hashes.tolist(), np.round(got.weights, 9), strict=True)) == {f: round(w, 9) for f, w in sorted(want.items()) if w}
    p = got.scores(np.concatenate(examples), np.repeat(np.arange(120), [len(e) for e in examples]), 120)
    assert np.allclose(p, [1 / (1 + math.exp(-got.bias - sum(want.get(f, 0) for f in e.tolist()))) for e in examples])

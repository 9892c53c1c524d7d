"""Small documents with every awkward case, and plain-Python versions of what the operators compute."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, kept_id long, leaky_id long, n_lines string, site string, key string, text_md5 string"


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def shingles(text, k):
    w = words(text)
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1)))


def prose(rng, n, vocabulary=4000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def edited(rng, text, share):
    w = text.split(" ")
    for i in range(len(w)):
        if rng.random() < share:
            w[i] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def texts(seed=7):
    """Texts by id: groups of near copies at all distances, exact copies, short, blank and null ones, a very long one."""
    rng = random.Random(seed)
    out = {}
    base = [prose(rng, 120) for _ in range(5)]
    for i in range(60):
        out[len(out)] = edited(rng, base[i % 5], rng.choice((0, 0.005, 0.01, 0.02, 0.04, 0.08)))
    out |= {len(out) + i: t for i, t in enumerate([None, "", " \t\n", "one", "ONE", "one two", "one two three", "One Two  three", "a b c d", "Straße ÉÉ 日本語 テスト 😀", "x" * 5000, "'ll " * 50, " " * 3000 + "tail", prose(rng, 30_000, 300)])}
    for _ in range(3):
        out[len(out)] = base[0].upper()
    return out


def rows(content=None):
    """Rows with clashing extra columns, nulls in every column, repeated rows and rows without an id."""
    content = texts() if content is None else content
    out = [(i, t, "en", f"src{i % 3}", None if t is None else len(t), "x", 1, 2, "y", None, "k", None) for i, t in content.items()]
    out += [out[3], out[3]]
    out += [(None, "no id here at all", None, None, None, None, None, None, None, None, None, None), (None, None) + (None,) * 10]
    return out

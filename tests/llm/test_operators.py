import hashlib
import itertools
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import public_tokenizers as P
import pytest
import tiktoken
from tests.llm import fixtures as X

from wharfline.llm import bpe, decontam, kernels, licenses, lines, neardup, quality, sharding, syncmers, toxicity
from wharfline.llm.bits import IdFilter
from wharfline.operators.components import connected_components

RANKS = P.path("byte_bpe_50k.tiktoken")
JSON = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(X.rows(), X.SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], X.SCHEMA)


# ---------------------------------------------------------------- kernels


def test_words_and_shingles_as_plain_python():
    column = pa.array([t for t in X.texts().values()], pa.string())
    data, offsets = kernels.buffers(column)
    hashes, starts, ends, at = kernels.words(data, offsets)
    seen = {}
    for d, text in enumerate(X.texts().values()):
        own = X.words(text)
        assert at[d + 1] - at[d] == len(own)
        for h, w in zip(hashes[at[d] : at[d + 1]].tolist(), own, strict=True):
            assert seen.setdefault(h, w) == w
    assert len(seen) == len(set(seen.values()))
    for k in (1, 3, 5):
        _, sizes = kernels.shingle_sets(data, offsets, k)
        assert np.diff(sizes).tolist() == [len(X.shingles(t, k)) for t in X.texts().values()]


def test_words_over_segments(monkeypatch):
    text = ["ab " * 500 + "c" * 700 + " d", "e"]
    whole = kernels.words(*kernels.buffers(pa.array(text)))[0]
    monkeypatch.setattr(kernels, "SEGMENT", 64)
    assert (kernels.words(*kernels.buffers(pa.array(text)))[0] == whole).all()


def test_sliced_and_null_columns():
    data, offsets = kernels.buffers(pa.array(["aa", None, "bb", "c"]).slice(1, 2))
    assert bytes(data) == b"bb" and offsets.tolist() == [0, 0, 2]
    assert [len(p) for p in kernels.passes(pa.RecordBatch.from_pydict({"t": ["a" * 10] * 5}), "t", 25)] == [2, 2, 1]


# ---------------------------------------------------------------- 1: near duplicates


def components_of(content, k, num, den):
    sets = {i: X.shingles(t, k) for i, t in content.items()}
    up = {i: i for i in content}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(sorted(content), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and both * den >= num * (len(sets[a]) + len(sets[b]) - both):
            up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in content}, sets


@pytest.mark.parametrize(("k", "ratio"), [(3, (85, 100)), (5, (80, 100))])
def test_near_duplicates_as_brute_force(docs, k, ratio):
    content = X.texts()
    want, sets = components_of(content, k, *ratio)
    got = neardup.near_duplicates(docs, shingle_words=k, similarity=ratio).collect()
    assert len(got) == docs.count()
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["n_shingles"], r["kept"]) == (want[r["doc_id"]], len(sets[r["doc_id"]]), want[r["doc_id"]] == r["doc_id"])


def test_links_that_a_star_misses_are_found(spark, monkeypatch):
    """A chain of texts, each near the next only, in buckets whose centre is near few of them; blocks of two documents."""
    monkeypatch.setattr(neardup, "BLOCK_DOCS", 2)
    rng = random.Random(5)
    w = X.prose(rng, 150).split(" ")
    content = {}
    for i in range(24):
        content[100 - i if i % 2 else i] = " ".join(w)
        w[(7 * i) % 140 : (7 * i) % 140 + 4] = [f"n{rng.randrange(10**6)}" for _ in range(4)]
    want, _ = components_of(content, 3, 85, 100)
    got = neardup.near_duplicates(spark.createDataFrame(list(content.items()), "doc_id long, text string"), shingle_words=3, similarity=(85, 100))
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == want


def test_near_duplicates_of_nothing(empty):
    assert neardup.near_duplicates(empty).count() == 0
    assert neardup.keep_one_of_each(empty).count() == 0


def test_one_of_each_class_stays(docs):
    want, _ = components_of(X.texts(), 5, 80, 100)
    kept = neardup.keep_one_of_each(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.select("doc_id").collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 2


def test_signatures_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(1)
    for size, share in ((7, 6 / 7), (60, 0.85), (600, 0.5)):
        agree = []
        for _ in range(60):
            pool = rng.integers(1, 2**63, 2 * size).astype(np.uint64)
            both = round(2 * size * share / (1 + share))
            a, b = np.unique(pool[:size]), np.unique(pool[size - both : 2 * size - both])
            sig = neardup.signatures(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
            agree.append((sig[0] == sig[1]).mean())
        truth = kernels.common(a, b) / len(np.union1d(a, b))
        assert abs(np.mean(agree) - truth) < 0.04


def test_overlaps_are_exact():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(9)]
    got = neardup.overlaps(sets[:4], sets[4:], width=7)
    assert (got == [[len(np.intersect1d(a, b)) for b in sets[4:]] for a in sets[:4]]).all()


def test_connected_components(spark):
    edges = [(i, i + 1) for i in range(0, 40) if i % 10 != 9] + [(3, 3), (1, 0), (100, 7)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: i // 10 * 10 for i in range(40) if i % 10} | {100: 0}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_id_filter_lets_all_members_through(spark):
    ids = list(range(-50, 5000, 64))
    f = IdFilter(spark.createDataFrame([(i,) for i in ids], "rep long"), "rep")
    assert f.test(np.array(ids)).all() and f.test(np.arange(10**6, 10**6 + 5000)).mean() < 0.5


# ---------------------------------------------------------------- 2: sharding


def test_sharding_laws(docs, empty):
    rows = sharding.shuffled_shards(docs, bucket_bytes=20_000).collect()
    assert len(rows) == docs.count() and rows[0]["record"].asDict().keys() == set(docs.columns)
    by = {}
    for r in rows:
        text = r["record"]["text"]
        assert r["size"] == (0 if text is None else len(text.encode())) + 1
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) and 0 <= s < 16 for s, v in by.items())
    again = sharding.shuffled_shards(docs.repartition(5), bucket_bytes=20_000).collect()
    place = lambda rs: sorted((str(r["record"]), r["shard"], r["slot"]) for r in rs if r["record"]["doc_id"] != 3)  # noqa: E731  the repeated rows are exchangeable
    assert place(rows) == place(again)
    assert sharding.shuffled_shards(empty).count() == 0


def test_one_more_shard_takes_rows_only_into_itself(spark):
    ids = spark.range(20_000)
    both = ids.select(sharding.shard_of(ids["id"], 16).alias("a"), sharding.shard_of(ids["id"], 17).alias("b")).collect()
    moved = [r for r in both if r["a"] != r["b"]]
    assert all(r["b"] == 16 for r in moved) and abs(len(moved) / 20_000 - 1 / 17) < 0.01
    assert max(Counter(r["a"] for r in both).values()) < 1.2 * 20_000 / 16


def test_shards_are_written_and_read_again(docs, tmp_path):
    sharding.write_shards(docs.select("doc_id", "text"), str(tmp_path / "out"))
    back = docs.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == docs.count() and set(back.columns) == {"doc_id", "text", "slot", "shard"}


# ---------------------------------------------------------------- 3: decontamination


def items():
    rng = random.Random(11)
    out = [(i, X.prose(rng, n)) for i, n in enumerate((5, 6, 9, 20, 40, 100, 300))]
    return [*out, (50, "tiny item"), (51, "ONE"), (60, None), (61, " "), (3, out[3][1]), (None, "an item without any id of its own")]


def planted(rng, item_rows):
    content = {}
    for item, text in item_rows:
        if text and text.strip():
            for cut in (0.0, 0.1, 0.4):
                w = text.split()
                part = w[: math.ceil(len(w) * (1 - cut))]
                content[len(content)] = f"{X.prose(rng, 400)} {' '.join(part).upper()} {X.prose(rng, 50)}"
            content[len(content)] = f"{X.prose(rng, 20_000, 10**6)} {text}"
    return content | {900: None, 901: "", 902: X.prose(rng, 2000), 903: "one"}


def contained(content, item_rows, k=5):
    out = set()
    for d, text in content.items():
        w = X.words(text)
        for item, wanted in set(item_rows):
            v = X.words(wanted)
            n = min(len(v), k)
            if not v:
                continue
            need = {tuple(v[i : i + n]) for i in range(len(v) - n + 1)}
            both = len(need & {tuple(w[i : i + n]) for i in range(len(w) - n + 1)})
            if 100 * both >= 80 * len(need):
                out.add((d, item, len(need), both))
    return out


def test_contamination_as_brute_force(spark):
    content = planted(random.Random(2), items())
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in content.items()], "doc_id long, text string, item_id int, hash string")
    b = spark.createDataFrame(items(), "item_id long, text string")
    got = {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontam.contaminated(d, b).collect()}
    assert got == contained(content, items()) and len(got) > 20
    kept = decontam.drop_contaminated(d, b)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == set(content) - {x[0] for x in got}


def test_items_that_share_an_id_are_judged_apart(spark):
    x, y = (" ".join(f"{c}{i}" for i in range(9)) for c in "xy")
    parts = "x0 x1 x2 x3 x4 x5 z y0 y1 y2 y3 y4 y5 y6"
    rows = [(1, parts), (2, f"{x} {y}"), (None, x), (3, y), (3, "nothing of it"), (4, None)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    for item in (7, None):
        b = spark.createDataFrame([(item, x), (item, y), (item, x), (5, x + " x9 x10 x11")], "item_id long, text string")
        got = {(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontam.contaminated(d, b).collect()}
        assert got == {(2, item, 5, 5), (None, item, 5, 5), (3, item, 5, 5)}
    assert {(r["doc_id"], r["text"]) for r in decontam.drop_contaminated(d, b).collect()} == {(1, parts), (4, None)}


def test_an_item_that_half_of_all_documents_hold(spark):
    rng = random.Random(6)
    item = X.prose(rng, 30)
    content = {i: f"{X.prose(rng, 40)} {item if i % 2 else ''} {X.prose(rng, 20)}" for i in range(900)}
    d = spark.createDataFrame(list(content.items()), "doc_id long, text string").repartition(8)
    b = spark.createDataFrame([(i, item if i < 3 else X.prose(rng, 25)) for i in range(40)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(d, b).collect()}
    assert got == {(i, j) for i in range(1, 900, 2) for j in range(3)}


@pytest.mark.parametrize("row_items", [256, 20])
def test_items_with_a_common_opening(spark, monkeypatch, row_items):
    """Thousands of items that begin alike: documents that hold the opening alone are no candidates of all of them."""
    monkeypatch.setattr(decontam, "ROW_ITEMS", row_items)
    rng = random.Random(21)
    opening = "choose the right answer to the question that follows and give your reason for it"
    items = [(i, f"{opening} {X.prose(rng, rng.choice((1, 3, 12, 30)), 10**6)}") for i in range(2000)] + [(5000 + i, opening) for i in range(300)] + [(9000 + i, f"{opening} so") for i in range(100)]
    docs = [(i, f"{X.prose(rng, 30)} {opening} {X.prose(rng, 30)}") for i in range(60)] + [(100 + i, f"{X.prose(rng, 9)} {X.edited(rng, items[17 * i][1], 0.03)} {X.prose(rng, 9)}") for i in range(100)]
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string").repartition(3)
    held = {i: X.shingles(t, 5) for i, t in docs}
    want = {(i, j, len(g), len(g & h)) for j, t in items for g in [X.shingles(t, 5)] for i, h in held.items() if 100 * len(g & h) >= 80 * len(g)}
    got = [(r["doc_id"], r["item_id"], r["n_item_shingles"], r["n_shared"]) for r in decontam.contaminated(d, b).collect()]
    assert set(got) == want and len(got) == len(want) and len(want) > 20_000


def test_hot_shingles_come_last():
    own = np.sort(np.random.default_rng(1).integers(1, 2**62, 40).astype(np.uint64))
    hot = own[5:25]
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([40]), pa.array([6], pa.int32()), pa.array([5], pa.int32()), pa.array([own.tobytes()], pa.binary()), pa.array([hot.view(np.int64).tolist()])], ["item", "n", "part", "width", "elements", "hot"])
    (out,) = decontam._sketched(0.8)(iter([batch]))
    sketch = set(np.array(out.column(5).to_pylist()[0], dtype=np.int64).view(np.uint64).tolist())
    assert len(sketch) == decontam.sketch_size(40, 0.8, 20) and not sketch & set(hot.tolist())
    # 8 of 40 may be absent: of 20 usual ones k miss with this chance, and with 8 usual ones a ninth is needed
    chance = math.prod(max(8 - i, 0) / (20 - i) for i in range(len(sketch)))
    assert chance <= decontam.MISS and decontam.sketch_size(40, 0.8, 8) == 9 and decontam.sketch_size(40, 0.8, 0) == 9


def test_contamination_of_and_by_nothing(docs, empty, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c d e f")], "item_id long, text string")
    assert decontam.contaminated(docs, none).count() == 0 and decontam.contaminated(empty, some).count() == 0
    assert decontam.drop_contaminated(docs, none).count() == docs.count()


def test_sketches_miss_once_in_a_million():
    for n in (1, 4, 10, 50, 1000):
        k, absent = decontam.sketch_size(n, 0.8), n - math.ceil(0.8 * n)
        chance = math.prod(max(absent - i, 0) / (n - i) for i in range(k))
        assert k <= n and chance <= decontam.MISS


# ---------------------------------------------------------------- 4 and 10: byte-level BPE

HARD = ["don't they'll 'lll ' re'", "a" * 700, " " * 500 + "x" + "\n" * 300, "日本語テスト" * 60, "😀👍🏽 é é ß" * 30, "1234567 89" * 40, "ab\n\n  cd \t\r\n" * 50, "'" * 400, "x<|endoftext|>y " * 30, "word " * 300, "ſpecial ʼn ’ll “q” — …" * 20, "᠎​  　" * 40, "\U0001fae8 new" * 20]


@pytest.fixture(scope="module")
def hard(spark):
    content = {i: t for i, t in enumerate(HARD)} | {100 + i: t for i, t in X.texts().items()}
    return content, spark.createDataFrame([*content.items(), (None, "no id"), (0, HARD[0])], "doc_id long, text string").repartition(3).cache()


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 512), (97, 40), (64, 16)])
def test_encoding_is_that_of_the_whole_text(hard, chunk, overlap):
    content, df = hard
    ranks = bpe.ranks_of(RANKS, P.PATTERN).core
    got = bpe.encode_decode(df, ranks_path=RANKS, pattern=P.PATTERN, chunk_chars=chunk, overlap_chars=overlap, with_ids=True).collect()
    assert len(got) == len(content) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else content[r["doc_id"]] or ""
        ids = ranks.encode_ordinary(text)
        assert r["ids"] == ids and r["n_tokens"] == len(ids) and bytes(r["decoded"]) == text.encode()
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize(("chunk", "overlap"), [(1 << 15, 512), (97, 40), (64, 16)])
def test_counts_are_those_of_the_library(hard, chunk, overlap):
    from tokenizers import Tokenizer

    content, df = hard
    model = Tokenizer.from_file(JSON)
    got = bpe.count_tokens(df, tokenizer_path=JSON, chunk_chars=chunk, overlap_chars=overlap, limit=100).collect()
    assert len(got) == len(content) + 2
    for r in got:
        text = "no id" if r["doc_id"] is None else content[r["doc_id"]] or ""
        want = len(model.encode(text, add_special_tokens=False).ids)
        assert (r["n_tokens"], r["n_bytes"], r["over_limit"]) == (want, len(text.encode()), want > 100), text[:40]


UNSPACED = ["".join(random.Random(1).choice("一二三四五六七八九") for _ in range(3000)), "".join(random.Random(2).choice("ab1+/9Zx") for _ in range(3000)), "var a=1;if(a){b();}" * 150, "x" * 90 + "'s" * 80 + "''s" * 60 + " " * 200 + "<|endoftext|>" * 30 + "<|endo" * 40, "、".join("日本語テスト" for _ in range(300)), "'" * 300 + "s't're" * 60]


@pytest.mark.parametrize(("chunk", "overlap"), [(400, 64), (97, 40)])
def test_texts_without_blanks(spark, chunk, overlap):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(UNSPACED)), "doc_id long, text string").repartition(2)
    model, ranks = Tokenizer.from_file(JSON), bpe.ranks_of(RANKS, P.PATTERN).core
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, tokenizer_path=JSON, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert counts == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in enumerate(UNSPACED)}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(df, ranks_path=RANKS, pattern=P.PATTERN, chunk_chars=chunk, overlap_chars=overlap, with_ids=True).collect()}
    assert got == {i: ranks.encode_ordinary(t) for i, t in enumerate(UNSPACED)}


def blank_lines(seed, n, size):
    """Random texts whose runs of white space fall on every side of a seam."""
    rng = random.Random(seed)
    bits = ["word", "A", " ", " ", ".", "\n\n", "\n", " \n\n ", "  ", "\t\t", "\u00a0 ", "\x85\n", "don't", "12", "é", "日本", "'", "\x1c\x1d", "\u3000\u3000"]
    return ["".join(rng.choice(bits) for _ in range(size)) for _ in range(n)]


PROSE = [f"{'a' * (32_766 + d)}.\n\nNext one" + " and on" * 200 for d in range(-4, 3)] + ["x" * 2500 + "y" * 31_000 + ". And so" + " on" * 9_000 + ".\n\nThen " + "w" * 900]
PROSE += ["".join(random.Random(i).choice(["One more sentence here. ", "It ends so.\n\n", "Short.\n\n\n"]) for _ in range(9_000)) for i in range(4)]


@pytest.mark.parametrize(("chunk", "overlap", "texts"), [(64, 16, blank_lines(1, 400, 90)), (64, 32, blank_lines(2, 400, 90)), (1 << 15, 512, PROSE)], ids=["short", "wide", "long"])
def test_splices_behind_blank_lines(spark, chunk, overlap, texts):
    from tokenizers import Tokenizer

    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    model, ranks = Tokenizer.from_file(JSON), bpe.ranks_of(RANKS, P.PATTERN).core
    counts = {r["doc_id"]: r["n_tokens"] for r in bpe.count_tokens(df, tokenizer_path=JSON, chunk_chars=chunk, overlap_chars=overlap).collect()}
    assert counts == {i: len(model.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    got = {r["doc_id"]: r["ids"] for r in bpe.encode_decode(df, ranks_path=RANKS, pattern=P.PATTERN, chunk_chars=chunk, overlap_chars=overlap, with_ids=True).collect()}
    assert got == {i: ranks.encode_ordinary(t) for i, t in enumerate(texts)}


def test_every_scan_begins_a_pre_token_at_a_seam():
    pattern = bpe.ranks_of(RANKS, P.PATTERN).pattern
    rng = random.Random(3)
    for text in [*HARD, *UNSPACED]:
        seams = {m.start() + 1 for m in bpe.SEAM.finditer(text, overlapped=True)}
        for low in [0, *(rng.randrange(len(text)) for _ in range(20))]:
            starts = {m.start() for m in pattern.finditer(text, low)}
            assert {p for p in seams if p > low} <= starts


def test_long_unspaced_texts_take_linear_time(spark):
    import time

    text = "".join(random.Random(5).choice("一二三四五六七八九") for _ in range(800_000))
    model = bpe.tokenizer_of(JSON)
    began = time.perf_counter()
    want = len(model.encode(text, add_special_tokens=False).ids)
    library = time.perf_counter() - began
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    bpe.count_tokens(df.limit(0), tokenizer_path=JSON).collect()
    began = time.perf_counter()
    assert bpe.count_tokens(df, tokenizer_path=JSON).first()["n_tokens"] == want
    # each character is encoded twice at most; the rest is Spark's own time
    assert time.perf_counter() - began < 3 * library + 15


def test_encoding_nothing(empty):
    assert bpe.encode_decode(empty, ranks_path=RANKS, pattern=P.PATTERN).count() == 0
    assert bpe.count_tokens(empty, tokenizer_path=JSON).count() == 0


def test_round_trip_of_ids_alone():
    ranks = bpe.ranks_of(RANKS, P.PATTERN)
    assert isinstance(ranks.core, tiktoken.Encoding)
    for text in HARD:
        assert ranks.decode(ranks.encode(text)) == text.encode()


# ---------------------------------------------------------------- 5: licenses


def test_license_matches_as_brute_force(spark):
    rng = random.Random(4)
    content = {900: None, 901: "", 902: X.prose(rng, 500)}
    for i, (_, t) in enumerate(sorted(licenses.TEMPLATES.items())):
        w = t.split()
        content |= {10 * i: f"{X.prose(rng, 60)} {t.lower()}", 10 * i + 1: f"{t} {X.prose(rng, 60)} {t}", 10 * i + 2: f"x {' '.join(w[: len(w) // 2])} y", 10 * i + 3: " ".join([*w[:-1], "changed"]) + " " + X.prose(rng, 5)}
    d = spark.createDataFrame([(i, t, "c") for i, t in content.items()], "doc_id long, text string, template string")
    got = {(r["doc_id"], r["template"], r["n_template_shingles"], r["n_shared"]) for r in licenses.license_matches(d).collect()}
    assert got == contained(content, list(licenses.TEMPLATES.items())) and len(got) >= 2 * len(licenses.TEMPLATES)
    assert licenses.license_matches(d.where("doc_id is null")).count() == 0


def test_templates_may_be_a_table(spark, monkeypatch):
    monkeypatch.setattr(licenses, "TEMPLATE_BYTES", 300)
    rng = random.Random(2)
    texts = {f"t{i}": X.prose(rng, 3 + 9 * i) for i in range(30)}
    d = spark.createDataFrame([(i, f"{X.prose(rng, 9)} {t} {X.prose(rng, 9)}") for i, t in enumerate(texts.values())] + [(99, "nothing")], "doc_id long, text string")
    t = spark.createDataFrame([*texts.items(), ("blank", " "), ("none", None), (None, "nothing"), ("t1", texts["t1"])], "name string, text string")
    got = {(r["doc_id"], r["template"]) for r in licenses.license_matches(d, templates=t).collect()}
    assert got == {(i, f"t{i}") for i in range(30)}
    assert licenses.license_matches(d, templates=t.limit(0)).count() == 0
    with pytest.raises(ValueError, match="two templates"):
        licenses.license_matches(d, templates=spark.createDataFrame([("a", "x y z"), ("a", "x y")], "name string, text string"))


def test_bands_follow_from_the_least_likeness():
    assert licenses.bands_for([1], 1, 0.8) == 1
    for sizes, window in (([8], 8), ([20, 25], 25)):
        least = min(math.ceil(0.8 * s) / (window + s - math.ceil(0.8 * s)) for s in sizes)
        assert (1 - least) ** licenses.bands_for(sizes, window, 0.8) <= licenses.MISS
    x = np.array([5, 3, 9, 1, 7, 8], dtype=np.uint64)
    assert licenses.sliding_min(x, 3).tolist() == [3, 1, 1, 1, 7, 8]


# ---------------------------------------------------------------- 6: lines


def test_boilerplate_lines_as_brute_force(spark, empty):
    rng = random.Random(3)
    rows = []
    for i in range(200):
        body = [X.prose(rng, 5) for _ in range(rng.randrange(4))]
        if rng.random() < 0.3:
            body += ["Home | About ", "", " Home | About"]
        rows.append((i, f"h{i % 3}" if i % 17 else None, None if i % 29 == 0 else "\n".join(body), 7))
    rows.append(rows[5])
    df = spark.createDataFrame(rows, "page_id long, host string, text string, n_lines long")
    counts, pages = Counter(), Counter(r[1] for r in rows)
    for _, host, text, _ in rows:
        for line in {x.strip(" \t\r\f") for x in (text or "").split("\n")} - {""}:
            counts[host, line] += 1
    out = lambda host, line: host is not None and line.strip(" \t\r\f") != "" and counts[host, line.strip(" \t\r\f")] >= 10 and counts[host, line.strip(" \t\r\f")] > 0.1 * pages[host]
    want = Counter()
    for i, host, text, _ in rows:
        body = [] if text is None else text.split("\n")
        kept = [x for x in body if not out(host, x)]
        want[i, None if text is None else "\n".join(kept), len(body), len(body) - len(kept)] += 1
    got = Counter((r["page_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in lines.drop_boilerplate(df, host_col="host", text_col="text").collect())
    assert got == want and any(k[3] for k in got)
    assert lines.drop_boilerplate(empty, host_col="source", text_col="text").count() == 0


def test_a_host_with_half_of_all_pages(spark, monkeypatch):
    rows = [(i, "giant" if i % 2 else f"h{i % 40}", f"body {i}\nmenu {i % 2}\nrare {i % 50}") for i in range(2000)]
    df = spark.createDataFrame(rows, "page_id long, host string, text string").repartition(8)
    # a rare line is on one in 25 of the giant's pages, and on many of a small host's
    small = {h: {r for _, x, t in rows if x == h for r in t.split("\n")[2:]} for h in {h for _, h, _ in rows}}
    want = {i: 1 + (h != "giant" and len(small[h]) < 10) for i, h, _ in rows}
    for bytes_ in (16 << 20, 1):
        monkeypatch.setattr(lines, "COMMON_BYTES", bytes_)
        assert {r["page_id"]: r["n_dropped"] for r in lines.drop_boilerplate(df, host_col="host", text_col="text").collect()} == want


def test_pages_become_lines(spark):
    html = "<html><head><title>t</title></head><body><script>x</script><p>One <b>bold</b></p><ul><li>a<li>b</ul><!-- c --></body>"
    r = spark.createDataFrame([(html, "HTTPS://A.b:8/c")], "h string, u string").select(lines.html_lines("h").alias("t"), lines.host_of("u").alias("u")).first()
    assert r["t"].split("\n") == ["One bold", "a", "b"] and r["u"] == "a.b:8"


# ---------------------------------------------------------------- 7: quality


def test_marginals_as_enumeration():
    rng = np.random.default_rng(6)
    odds, at, moves = rng.normal(size=7), np.array([0, 0, 4, 5, 7]), rng.normal(size=(2, 2))
    good, pair = quality.marginals(odds, at, moves)
    for a, b in itertools.pairwise(at):
        n = b - a
        total, ones, moved = 0.0, np.zeros(n), np.zeros((n, 2, 2))
        for y in itertools.product((0, 1), repeat=n):
            p = math.exp(sum(odds[a + i] * y[i] for i in range(n)) + sum(moves[y[i - 1], y[i]] for i in range(1, n)))
            total += p
            ones += p * np.array(y)
            for i in range(1, n):
                moved[i, y[i - 1], y[i]] += p
        if n:
            assert np.allclose(good[a:b], ones / total) and np.allclose(pair[a + 1 : b], moved[1:] / total)


def labelled(spark, bad, good, n=240):
    rng = random.Random(9)
    rows = [(i, bad(rng) if i % 4 == 0 else good(rng), i % 4 == 0) for i in range(n)]
    docs = spark.createDataFrame([(i, t, "x", 1.0) for i, t, _ in rows] + [(9000, None, "x", 1.0), (9001, "", "x", 1.0), (None, "words here", "x", 1.0)], "doc_id long, text string, y string, score double")
    return rows, docs


def test_quality_on_the_held_out_fold(spark, empty):
    rows, docs = labelled(spark, lambda r: "\n".join(" ".join(f"{w}$$$" for w in X.prose(r, 12).split()) for _ in range(4)), lambda r: "\n".join(X.prose(r, 12).capitalize() + "." for _ in range(4)))
    labels = spark.createDataFrame([(i, int(not b), None) for i, _, b in rows] + [(77777, 1, 0), (None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    field = quality.train(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, field).collect()}
    assert all(got[i]["predicted"] == int(not b) and got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _, b in rows)
    assert got[9000]["score"] == got[9001]["score"] == 0.0 and got[None]["held_out"] is False
    kept = quality.keep_good(docs, field)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} - {None} == {i for i, _, b in rows if not b}
    assert quality.score_quality(empty, field).count() == 0 and quality.keep_good(empty, field).count() == 0


def test_quality_without_labels(spark, docs):
    field = quality.train(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality.score_quality(docs, field).collect()} == {0.0, 0.5}


# ---------------------------------------------------------------- 8: fingerprints


def brute_print(text):
    """Distinct anchor hashes of a text and the byte place where each first stands, by the definition of a closed syncmer."""
    raw, out = text.encode(), {}
    for i in range(len(raw) - syncmers.KMER + 1):
        stir = [kernels_order(raw[i + j : i + j + syncmers.S]) for j in range(syncmers.KMER - syncmers.S + 1)]
        if min(stir) in (stir[0], stir[-1]):
            ends = [np.array([int.from_bytes(raw[i + j : i + j + syncmers.S], "little")], dtype=np.uint64) for j in (0, syncmers.KMER - syncmers.S)]
            h = kernels.mix(ends[0] * np.uint64(0xC2B2AE3D27D4EB4F) + kernels.mix(ends[1]))[0]
            out.setdefault(int(h >> np.uint64(32)), i)
    if raw and not out:
        out[int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little") >> 32] = 0
    kept = sorted(out)[: max(syncmers.LEAST, len(out) // syncmers.SHARE)]
    return {h: out[h] for h in kept}


def brute_likeness(a, b):
    if not a or not b:
        return float(len(a) == len(b))
    cut = min([max(x) for x in (a, b) if len(x) >= syncmers.LEAST], default=2**32)
    a, b = ({h: p for h, p in x.items() if h <= cut} for x in (a, b))
    shared = sorted((a[h], b[h]) for h in a.keys() & b.keys())
    longest = []
    for i, (_, q) in enumerate(shared):
        longest.append(1 + max((longest[j] for j in range(i) if shared[j][1] < q), default=0))
    return max(longest, default=0) / len(a.keys() | b.keys())


def hash_order(text):
    import xxhash

    return (xxhash.xxh64_intdigest(text.encode(), seed=42) + 2**63) % 2**64 - 2**63


@pytest.mark.parametrize("range_bytes", [12 << 20, 3000])
def test_fingerprints_as_brute_force(docs, monkeypatch, range_bytes):
    """Edited texts, fingerprints and both likenesses; with 3000 bytes a range, many ranges and an id of several of them."""
    monkeypatch.setattr(syncmers.with_next, "__kwdefaults__", {"range_bytes": range_bytes})
    rng = random.Random(1)
    more = [(None, X.prose(rng, 60)) for _ in range(40)] + [(8, X.prose(rng, 60)) for _ in range(40)] + [(5, "doubled"), (5, "doubled")]
    table = docs.select("doc_id", "text").unionByName(docs.sparkSession.createDataFrame(more, "doc_id long, text string"))
    source = sorted(((r["doc_id"], r["text"] or "") for r in table.collect()), key=lambda p: (p[0] is not None, p[0] or 0, hash_order(p[1])))
    prints, want = {}, Counter()
    of = lambda t: prints.setdefault(t, brute_print(t))
    shown = lambda x: "".join(f"{h:08x}{p:08x}" for h, p in sorted(x.items(), key=lambda v: v[1]))
    for (i, a), (_, b) in zip(source, source[1:] + source[:1], strict=True):
        half = len(a) // 2
        e = a[: len(a) - half] + b[:half]
        want[i, len(a), hashlib.sha256(e.encode()).hexdigest(), shown(of(a)), shown(of(e)), round(brute_likeness(of(a), of(e)), 9), round(brute_likeness(of(a), of(b)), 9)] += 1
    got = syncmers.edited_fingerprints(table).collect()
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got) == want


def test_ranges_are_of_one_order():
    rng = np.random.default_rng(1)
    value, tie = np.sort(rng.integers(-5, 6, 5000)), rng.integers(-(2**63), 2**63 - 1, 5000)
    order = np.lexsort((tie, value))
    for cuts in ([], [0], [-3, 0, 0, 0, 4], [-9, 9]):
        found = syncmers.range_of(np.array(cuts, dtype=np.int64), value[order], tie[order])
        assert (np.diff(found) >= 0).all() and found.min() >= 0 and found.max() <= len(cuts)
    assert len(set(syncmers.range_of(np.array([0, 0, 0]), np.zeros(500, dtype=np.int64), tie[:500]))) == 4


def test_a_single_document_follows_itself(spark, empty):
    one = syncmers.edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).collect()
    assert [r["edited_sha256"] for r in one] == [hashlib.sha256(b"abcabc").hexdigest()]
    assert syncmers.edited_fingerprints(empty).count() == 0


def test_anchors_depend_on_the_passage_alone():
    rng = random.Random(8)
    passage = X.prose(rng, 80)
    texts = [passage, X.prose(rng, 50) + " " + passage + " " + X.prose(rng, 20), "short"]
    data, offsets = kernels.buffers(pa.array(texts))
    place, hashes, doc = syncmers.anchors_of(data, offsets)
    inner = set(hashes[doc == 0].tolist())
    assert inner and inner <= set(hashes[doc == 1].tolist()) and (doc == 2).sum() == 1
    brute = []
    raw = texts[0].encode()
    for i in range(len(raw) - syncmers.KMER + 1):
        stir = [int(kernels_order(raw[i + j : i + j + syncmers.S])) for j in range(syncmers.KMER - syncmers.S + 1)]
        if min(stir) in (stir[0], stir[-1]):
            brute.append(i)
    assert place[doc == 0].tolist() == brute


def kernels_order(word):
    mask = (1 << 64) - 1
    x = int.from_bytes(word, "little") * 0x9E3779B97F4A7C15 & mask
    x ^= x >> 29
    x = x * 0xBF58476D1CE4E5B9 & mask
    return x ^ x >> 32


def test_likeness_of_long_texts_is_near_that_of_all_anchors():
    rng = random.Random(4)
    for share in (0.01, 0.05, 0.3):
        errors = []
        for _ in range(10):
            text = X.prose(rng, 3000, 10**6)
            other = X.edited(rng, text, share)
            a, b = ({h for h in (syncmers.anchors_of(*kernels.buffers(pa.array([t])))[1] >> np.uint64(32)).tolist()} for t in (text, other))
            errors.append(syncmers.likeness(*syncmers.fingerprints_of([text, other])) - len(a & b) / len(a | b))
        assert abs(np.mean(errors)) < 0.03
    a, b = X.prose(rng, 400), X.prose(rng, 400)
    swapped = syncmers.likeness(*syncmers.fingerprints_of([f"{a} {b}", f"{b} {a}"]))
    assert 0.3 < swapped < 0.7  # the passages are all there, one of them out of place


# ---------------------------------------------------------------- 9: toxicity


def test_toxicity_on_the_held_out_fold(spark, empty):
    slurs = ["grobnik", "zlobast", "vrednul"]
    rows, docs = labelled(spark, lambda r: f"{X.prose(r, 30, 300)} {r.choice(slurs)}, {X.prose(r, 10, 300)} {r.choice(slurs)}!", lambda r: X.prose(r, 45, 300), n=900)
    labels = spark.createDataFrame([(i, 1, int(b)) for i, _, b in rows] + [(None, 1, 1), (4, 1, None)], "doc_id long, quality int, toxic int")
    weights = toxicity.train(docs, labels)
    assert 0 < len(weights.hashes) < 2000
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(docs, weights).collect()}
    held = [(i, b) for i, _, b in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert all(got[i]["held_out"] for i, _ in held)
    assert np.mean([got[i]["predicted"] == int(b) for i, b in held]) > 0.97
    assert not any(got[i]["predicted"] for i, b in held if not b)
    assert got[9000]["score"] == got[9001]["score"] and toxicity.score_toxicity(empty, weights).count() == 0
    blank = toxicity.train(docs, labels.limit(0))
    assert {r["score"] for r in toxicity.score_toxicity(docs, blank).collect()} == {0.5}

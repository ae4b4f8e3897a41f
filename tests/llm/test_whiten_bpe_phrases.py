"""Whitening, tokens by a distinct-word table, and phrases against plain readings, also on awkward rows."""

import collections
import hashlib
import random
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from barloom.llm import bpe, phrases, whiten
from barloom.llm.queries import QUERIES, word_vocabulary

FOLDER = "/root/testdata/sf0.01"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


# whitening


def plainly_whitened(x):
    """(eigenvalues, eigenvectors, whitened rows, deviations) from whole numbers as Python has them."""
    n, rows = len(x), [[int(v) for v in r] for r in x]
    sums = [sum(c) for c in zip(*rows, strict=True)]
    apart = [[n * v - s for v, s in zip(r, sums, strict=True)] for r in rows]
    covariance = np.array([[sum(r[i] * r[j] for r in apart) / n**3 for j in range(len(sums))] for i in range(len(sums))])
    e, u = np.linalg.eigh(covariance)
    order = np.argsort(-e)
    e, u = e[order], u[:, order]
    return e, u, (np.array(apart, float) / n) @ u / np.sqrt(e), [sum(v * v for v in r) for r in apart]


def test_whitening_of_a_whole_table(spark):
    table = pd.read_parquet(f"{FOLDER}/embeddings.parquet")
    got = QUERIES["op11_embedding_whitening"](spark, FOLDER).toPandas()
    x = np.floor(np.stack(table.embedding).astype(float) * 1024).astype(np.int64) + 100_000
    e, _, z, deviations = plainly_whitened(x)
    wide = got.pivot(index="vec_id", columns="component", values="whitened").loc[table.vec_id].to_numpy()
    assert np.abs(wide * np.sign((wide * z[:, :8]).sum(axis=0)) - z[:, :8]).max() < 1e-9
    assert got.groupby("vec_id").deviation.first().loc[table.vec_id].tolist() == deviations
    assert np.allclose(got.groupby("component").explained.first(), e[:8] / e.sum(), rtol=1e-9) and (got.n == len(x)).all()
    assert got.identity_error.nunique() == 1 and got.identity_error.iloc[0] < 1e-9


@pytest.mark.parametrize(("rows", "dimensions", "least", "most"), [(1, 1, 5, 5), (3, 2, -4, 9), (65, 3, -(2**62), 2**62), (200, 5, 0, 1), (500, 4, -(10**6), 10**6)])
def test_cross_products_are_exact(rows, dimensions, least, most):
    rng = random.Random(rows)
    x = [[rng.randint(least, most) for _ in range(dimensions)] for _ in range(rows)]
    sums, products = whiten.cross_products(np.array(x, np.int64))
    assert sums.tolist() == [sum(c) for c in zip(*x, strict=True)]
    assert all(products[i, j] == sum(r[i] * r[j] for r in x) for i in range(dimensions) for j in range(i, dimensions))


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({c: F.lit("clash") for c in ("id", "v", "n", "i", "component", "whitened")})


def test_whitening_of_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    good = [(i, [float(i % 7), float(i % 3) * 2, float(i * i % 11)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [nan, 1.0, 1.0]), (103, [inf, 0.0, 0.0]), (104, []), (105, [1.0, 2.0])]
    again = [(None, [9.0, 1.0, 4.0]), (3, good[3][1]), (3, good[3][1])]
    frame = vectors(spark, good + odd + again)
    model = whiten.fit(frame)
    got = whiten.apply(frame, model).toPandas()
    x = np.array([v for _, v in good + again], float) * 1024 + 100_000
    e, _, z, deviations = plainly_whitened(x.astype(np.int64))
    assert len(got) == 43 * 3 and model.n == 43 and np.allclose(model.variances, e)
    assert sorted(map(int, got[got.component == 1].deviation)) == sorted(deviations) and got.vec_id.isna().sum() == 3
    assert np.allclose(sorted(got[got.component == 2].whitened.abs()), sorted(np.abs(z[:, 1])))


def test_whitening_without_variation_and_of_large_numbers(spark):
    assert whiten.fit(vectors(spark, [])).n == 0 and whiten.apply(vectors(spark, []), whiten.fit(vectors(spark, []))).count() == 0
    same = vectors(spark, [(i, [1.0, 2.0]) for i in range(5)])
    assert whiten.apply(same, whiten.fit(same)).count() == 0
    line = vectors(spark, [(i, [float(i), 2.0 * i]) for i in range(5)])
    assert whiten.fit(line).components.shape == (2, 1) and whiten.apply(line, whiten.fit(line)).count() == 5
    far = vectors(spark, [(i, [i * 1e15, 3.0 * (i % 2), 1e300 if i == 2 else -1e300]) for i in range(4)])
    model = whiten.fit(far)
    assert model.sums[0] == sum(int(i * 1e15) * 1024 for i in range(4)) + 400_000 and model.n == 4
    assert whiten.apply(far, model).filter("NOT isnan(whitened)").count() == 4 * model.components.shape[1]


# tokens


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(word_vocabulary())


def expected(tokenizer, text):
    ids = tokenizer.encode(text or "", add_special_tokens=False).ids
    return len(ids), digest(" ".join(map(str, ids))), digest(tokenizer.decode(ids, skip_special_tokens=False))


def test_tokens_of_a_whole_table(spark, tokenizer):
    docs = pd.read_parquet(f"{FOLDER}/documents.parquet")
    got = {r["doc_id"]: tuple(r)[1:] for r in QUERIES["op12_bpe_tokens"](spark, FOLDER).collect()}
    assert got == {i: expected(tokenizer, t) for i, t in zip(docs.doc_id, docs.text, strict=True)}


def odd_texts(count):
    rng = random.Random(4)
    rare = [chr(c) for c in [*range(0x250), *range(0x2000, 0x2060), *range(0x300, 0x400), *range(0x1E00, 0x1E20), 0x212B, 0x3000, 0xFEFF, 0x1F600, 0xAC00, 0x1100, 0x1161]]
    some = ["<|endoftext|>", "<|startoftext|>", "'ll", "'S", "İ", "ΣΑΣ", "\x1c", "\x85", "can't", "12", " ", "\n\n", "don’t"]
    return ["".join(rng.choice(some) if rng.random() < 0.1 else rng.choice(rare) if rng.random() < 0.2 else rng.choice(" strevmlABc'.") for _ in range(rng.randint(0, 60))) for _ in range(count)]


@pytest.mark.parametrize("most", [0, 40, 1 << 19])
def test_tokens_of_odd_texts_with_any_number_of_common_words(spark, tokenizer, most):
    texts = [*odd_texts(1500), None, "", " \t\n ", "the same", "the same", "x" * 3000, "long " * 30_000]
    frame = spark.createDataFrame([(None if i % 50 == 7 else i // 2, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("ids", "word", "k1", "words", "n")})
    rows = bpe.decode(bpe.encode(frame, word_vocabulary(), most=most), word_vocabulary()).collect()
    want = collections.Counter((None if i % 50 == 7 else i // 2, *expected(tokenizer, t)) for i, t in enumerate(texts))
    assert collections.Counter((r["doc_id"], len(r["ids"]), digest(" ".join(map(str, r["ids"]))), digest(r["decoded"])) for r in rows) == want


def test_each_distinct_word_is_encoded_once(spark, tokenizer):
    table = bpe.word_table(spark.createDataFrame([("A cat, a Cat",), ("cats a",), ("",)], "text string"), word_vocabulary())
    assert {r["word"]: (r["n"], r["ids"]) for r in table.collect()} == {w: (n, tokenizer.encode(w).ids) for w, n in (("a", 3), ("cat", 2), ("cats", 1), (",", 1))}


def test_words_of_a_column_are_those_of_each_text():
    split = bpe.Splitter(word_vocabulary())
    texts = [*odd_texts(1500), "", "It's \"'tis\" they'll've 'S", "a1b22 c--d..e", " \x00a\x01 ", "<|endoftext|>A", "Łódź ŁÓDŹ"]
    names, numbers, ends = split.numbered(pa.array(["cut off", *texts])[1:])
    words = [names[n].as_py() for n in numbers]
    assert [words[a:b] for a, b in zip([0, *ends], ends)] == [split(t) for t in texts] and len(set(names.to_pylist())) == len(names)


def test_equal_chunks_and_their_copies(spark, tokenizer):
    texts = ["some words", None, "Zyxwv zyxwv qqqq", "word " * 500, "qqqq"]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    rows = bpe.tokens(frame.union(frame).union(frame.filter("doc_id > 1")), word_vocabulary(), most=2).collect()
    want = collections.Counter((i, *expected(tokenizer, t)) for i, t in [*enumerate(texts)] * 2 + [*enumerate(texts)][2:])
    assert collections.Counter((r["doc_id"], len(r["ids"]), digest(" ".join(map(str, r["ids"]))), digest(r["decoded"])) for r in rows) == want


def test_texts_are_split_into_numbers_once_and_a_task_has_one_python_worker(spark):
    frame = bpe.tokens(spark.read.parquet(f"{FOLDER}/documents.parquet"), word_vocabulary(), most=40)
    assert len(frame.collect()) == len(pd.read_parquet(f"{FOLDER}/documents.parquet", columns=["doc_id"]))
    plan = frame._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "ReusedExchange" in plan and plan.count("FileScan parquet [doc_id") == 1
    for stage in plan.split("Exchange hashpartitioning"):
        assert len(re.findall("MapInArrow|CoGroupsInArrow", stage)) < 2


def test_decoding_of_any_ids(spark, tokenizer):
    frame = spark.createDataFrame([(1, [5, 49407, 300]), (2, []), (3, None), (4, [None, 7, -1, 10**6])], "a int, ids array<int>")
    got = {r["a"]: r["decoded"] for r in bpe.decode(frame, word_vocabulary()).collect()}
    assert got == {1: tokenizer.decode([5, 49407, 300], skip_special_tokens=False), 2: "", 3: "", 4: tokenizer.decode([7])}


def test_no_texts(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bpe.encode(empty, word_vocabulary()).count() == 0 and phrases.mine(empty).count() == 0


# phrases


def plainly_mined(rows, threshold, most=2000):
    lower = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})
    f, n = collections.Counter(), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(lower)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in (1, 2, 3, 4) for i in range(len(w) - k + 1))
    often = {g: a for g, a in f.items() if a >= threshold and len(g[1]) > 1}
    held = {(lang, g[i : i + k]) for (lang, g), b in often.items() for k in range(2, len(g)) for i in range(len(g) - k + 1) if 100 * b >= 80 * f[lang, g[i : i + k]]}
    out = collections.defaultdict(list)
    for (lang, g), a in often.items():
        if (lang, g) not in held:
            score, k = min((2_000_000 * a // (f[lang, g[:k]] + f[lang, g[k:]]), k) for k in range(1, len(g)))
            out[lang].append((-score, -a, " ".join(g).encode(), f[lang, g[:k]], f[lang, g[k:]]))
    return sorted((lang, r, p.decode(), -a, x, y, n[lang], -s) for lang, found in out.items() for r, (s, a, p, x, y) in enumerate(sorted(found)[:most], 1))


AWKWARD = [
    ("en", "New york, NEW york. new york city!"), ("en", "new  york\tcity hall"), (None, "new york city"), ("de", None), ("de", ""), ("en", "a a a a a a a a"), ("de", "  ;;  "), ("fr", "nul \x00 byte\x00 nul \x00 byte\x00"),
    ("fr", "Élan vital élan vital Élan vital"), ("und", "new york city"), ("en", "one\x0btwo\x0cone two\rone two\none two"), ("fr", "x y x y z"),
]


@pytest.mark.parametrize("chunk", [24, 8 << 20])
def test_phrases_of_awkward_rows(spark, chunk):
    rows = AWKWARD * 3 + [("en", " ".join(f"w{i % 13}" for i in range(400)))]
    frame = spark.createDataFrame(rows, "lang string, text string").withColumns({c: F.lit("clash") for c in ("phrase", "chunk", "words", "n", "f", "a")})
    got = phrases.mine(frame, threshold=3, chunk_bytes=chunk, mass=256).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plainly_mined(rows, 3)


def test_phrases_that_copies_share(spark):
    rng = np.random.default_rng(5)
    text = lambda: " ".join(f"w{x}" for x in rng.zipf(1.3, 200) % 500)
    rows = [("en" if i % 3 else None, text()) for i in range(150)]
    rows += [rows[0]] * 80 + [("en", "Some passage that, many texts share.")] * 40
    got = phrases.mine(spark.createDataFrame(rows, "lang string, text string"), threshold=30, most=50, mass=1 << 12).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect()
    assert sorted(map(tuple, got)) == plainly_mined(rows, 30, 50)


@pytest.mark.parametrize("threshold", [2, 7, 30])
def test_summaries_lose_nothing_frequent(threshold):
    rng = np.random.default_rng(threshold)
    stream = (rng.zipf(1.2, 40_000) % 5000).astype(np.uint64)
    parts = [np.unique(p, return_counts=True) for p in np.array_split(stream, 23)]
    live = set(phrases.summary([phrases.packed(*p) for p in parts], len(stream), threshold).tolist())
    values, counts = np.unique(stream, return_counts=True)
    assert set(values[counts >= threshold].tolist()) <= live
    capacity = len(stream) // threshold + 1
    left, counters, error = phrases.merged(parts, capacity // 8)
    known = dict(zip(values.tolist(), counts.tolist(), strict=True))
    assert len(left) <= capacity // 8 and error * (capacity // 8) < len(stream) and all(known[v] - error <= c <= known[v] for v, c in zip(left.tolist(), counters.tolist(), strict=True))

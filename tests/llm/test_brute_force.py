"""Registered queries against plain readings of what they must return, on a small folder; the four that SQL expresses, against their SQL."""

import collections
import hashlib
import math
import re
import zlib
from pathlib import Path

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from barloom.llm import license, lm, minhash, packing, substring, topk, toxicity, urlfilter
from barloom.llm.queries import ORACLES, QUERIES, vocabulary

FOLDER = "/root/testdata/sf0.01"
WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans({chr(65 + i): chr(97 + i) for i in range(26)})


@pytest.fixture(scope="module")
def docs():
    return pd.read_parquet(f"{FOLDER}/documents.parquet")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, name):
    con = duckdb.connect()
    for p in Path(FOLDER).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    frame = QUERIES[name](spark, FOLDER)
    assert sorted(names) == sorted(frame.columns)
    assert sorted(map(repr, (tuple(r[names.index(c)] for c in frame.columns) for r in cursor.fetchall()))) == sorted(map(repr, map(tuple, frame.collect())))


def labelled(text):
    w, seen, out = words(text), collections.Counter(), set()
    k = min(5, len(w))
    for j in range(len(w) - k + 1 if k else 0):
        g = tuple(w[j : j + k])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def similar(a, b):
    """matched / (all words - matched), by the plain table of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        above = 0
        for j, y in enumerate(b):
            above, row[j + 1] = row[j + 1], above + 1 if x == y else max(row[j + 1], row[j])
    return row[-1] / (len(a) + len(b) - row[-1])


def roots(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return [find(i) for i in range(n)]


def test_near_duplicates_are_components_of_all_links(spark, docs):
    texts, places, shared = [words(t) for t in docs.text], collections.defaultdict(list), collections.Counter()
    for i, w in enumerate(texts):
        for g in {tuple(w[j : j + 4]) for j in range(len(w) - 3)} or {tuple(w)}:
            places[g].append(i)
    for ids in places.values():
        shared.update((ids[b], ids[a]) for a in range(len(ids)) for b in range(a))
    # a pair as similar as asked for has two of five words' places in runs of four
    near = [(a, b) for (a, b), n in shared.items() if texts[a] and n >= 0.1 * len(texts[a]) and 5 * min(len(texts[a]), len(texts[b])) >= 4 * max(len(texts[a]), len(texts[b]))]
    links = [(a, b) for a, b in near if texts[a] == texts[b] or similar(texts[a], texts[b]) >= 0.8]
    got = QUERIES["op1_near_dedup"](spark, FOLDER).toPandas().set_index("doc_id")
    ids = docs.doc_id.tolist()
    assert links and [got.class_id[i] for i in ids] == [ids[r] for r in roots(len(ids), links)]
    assert (got.kept == (got.index == got.class_id)).all()


def test_links_of_shingles_are_links_of_words():
    """0.8 of five-word shingles, labelled, in common and in one order is 0.8 of the words or more."""
    rng = np.random.default_rng(8)
    for _ in range(200):
        a = rng.integers(0, 40, rng.integers(5, 80)).astype(np.uint32)
        b = np.delete(a, rng.integers(0, len(a), rng.integers(0, 3)))
        if rng.random() < 0.5 and len(b):
            b[rng.integers(0, len(b))] = 99
        x, y = labelled_list(a), labelled_list(b)
        common = len(set(x) & set(y))
        if len(b) and common >= 0.8 * (len(x) + len(y) - common):
            assert minhash.alignment(a, b) >= 0.8 - 1e-9
        want = similar(a.tolist(), b.tolist()) if len(b) else 0
        assert math.isclose(minhash.alignment(a, b), want if want >= 0.8 else 0.0)


def labelled_list(w):
    seen, out = collections.Counter(), []
    k = min(5, len(w))
    for j in range(len(w) - k + 1 if k else 0):
        g = tuple(w[j : j + k])
        out.append((g, seen[g]))
        seen[g] += 1
    return out


def test_long_texts_are_aligned_piece_by_piece(monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(minhash, "WHOLE", 300)
    for _ in range(10):
        a = rng.integers(0, 4000, 2500).astype(np.uint32)
        b = np.delete(a, rng.integers(0, 2500, 60))
        b[rng.integers(0, len(b), 60)] = 5000
        assert math.isclose(minhash.alignment(a, b), similar(a.tolist(), b.tolist()), abs_tol=0.01)
    assert minhash.alignment(a, rng.permutation(a)) == 0.0


def test_a_hot_group_of_near_copies(spark):
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in rng.integers(0, 5000, 200)]
    rows = []
    for i in range(400):
        w = list(base)
        for at in rng.integers(0, 200, i % 12):
            w[at] = f"edit{rng.integers(10**9)}"
        rows.append((i, " ".join(w)))
    rows += [(1000 + i, " ".join(f"z{x}" for x in rng.integers(0, 5000, 100))) for i in range(100)]
    got = minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["class_id"] for r in got if r["_id"] < 1000} == {0}
    assert all(r["class_id"] == r["_id"] for r in got if r["_id"] >= 1000)


def test_large_buckets_lose_no_link(spark, monkeypatch):
    """Where texts meet only the leader of a bucket, the links of shingles are left to the exact join."""
    monkeypatch.setattr(minhash, "BACK", 0)
    left, used = minhash._left_over, []
    monkeypatch.setattr(minhash, "_left_over", lambda texts: used.append(True) or left(texts))
    rng = np.random.default_rng(11)
    bases = [[f"w{i}" for i in rng.integers(0, 5000, n)] for n in (60, 150)]
    rows = []
    for i in range(240):
        w = list(bases[i % 2])
        for at in rng.integers(0, len(w), i % 14 * (1 + i % 2)):
            # edits come from few words, so that texts also agree in what their base lacks
            w[at] = f"edit{rng.integers(3)}at{at}"
        rows.append((i, " ".join(w)))
    sets, texts = [labelled(t) for _, t in rows], [t.split() for _, t in rows]
    pairs = [(a, b) for a in range(len(rows)) for b in range(a) if len(texts[a]) == len(texts[b])]
    sure = [(b, a) for a, b in pairs if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    may = roots(len(rows), [(b, a) for a, b in pairs if similar(texts[a], texts[b]) >= 0.8])
    got = {r["_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert used and sure and len(set(got.values())) > 2
    assert all(got[a] == got[b] for a, b in sure)
    assert all(may[i] == may[c] for i, c in got.items())


def test_language_model(spark, docs):
    tokens = lambda t: [w for w in (t or "").encode().lower().split()] + [None]
    counts = collections.Counter()
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens(t))
    n, v = sum(counts.values()), len(counts)
    got = lm.score(spark.read.parquet(f"{FOLDER}/documents.parquet"), hot=3000).toPandas().set_index("doc_id")  # so few hot tokens that most counts are joined
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        r, w = got.loc[i], tokens(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (zlib.crc32(str(i).encode()) % 7 == 2, len(w), sum(counts[x] > 0 for x in w), n)
        assert math.isclose(r.base_score, sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w), rel_tol=1e-9)
    held = got[got.held_out]
    assert held.score.sum() > held.base_score.sum()


def test_model_probabilities_sum_to_one():
    p = lm.first_parameters(np.log(np.full(40, 1 / 40)))
    t1, t2, z = lm.log_tables(p)
    assert np.allclose([np.exp(t1[a] + t2[b] - z[a, b]).sum() for a in range(0, 40, 7) for b in range(0, 40, 9)], 1, atol=1e-5)


def test_factored_probabilities_sum_to_one_and_equal_one_class():
    rng = np.random.default_rng(3)
    n, width = 50, 8
    p = {k: rng.normal(0, 0.5, (n, lm.DIM + (k == "q"))).astype(np.float16) for k in ("r1", "r2", "q")}
    p |= {"bias": rng.normal(0, 1, n).astype(np.float32), "classes": rng.normal(0, 1, (-(-n // width), lm.DIM + 1)).astype(np.float32), "width": width}
    words = np.arange(n)
    for a, b in ((0, 1), (7, 49), (30, 2)):
        assert np.isclose(np.exp(lm.log_probabilities(p, words, np.full(n, a), np.full(n, b), most=17)).sum(), 1, atol=1e-4)
    whole = {**p, "width": n, "classes": p["classes"][:1]}
    t1, t2, z = lm.log_tables({k: (p[k] + (0 if k != "q" else np.column_stack([np.zeros((n, lm.DIM)), p["bias"]]))).astype(np.float32) for k in ("r1", "r2", "q")})
    assert np.allclose(lm.log_probabilities(whole, words, words[::-1].copy(), words), t1[words[::-1], words] + t2[words, words] - z[words[::-1], words], atol=1e-3)


def test_words_beyond_the_most_frequent_have_vectors(spark):
    """2200 words stand more often than these pairs, yet the model knows which of them follow one another."""
    rng = np.random.default_rng(5)
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    ids = [i for i in range(5000) if not held(i)]
    texts = [" ".join(f"common{j}" for j in rng.permutation(2200)) for _ in range(80)]
    texts += [" ".join(f"left{j} right{j}" for j in rng.integers(0, 20, 10)) for _ in range(120)]
    rows = [(i, texts[j]) for i, j in zip(ids, rng.permutation(len(texts)), strict=False)]
    right, wrong = [i for i in range(5000, 6000) if held(i)][:2]
    rows += [(right, " ".join(f"left{j} right{j}" for j in range(20))), (wrong, " ".join(f"left{j} right{(j + 7) % 20}" for j in range(20)))]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert math.isclose(got[right]["base_score"], got[wrong]["base_score"], rel_tol=1e-9)
    assert got[right]["score"] > got[wrong]["score"] + 0.1


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary()[0])
    got = QUERIES["op8_best_fit_packing"](spark, FOLDER).toPandas()
    ids = {i: np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for i, t in zip(docs.doc_id, docs.text, strict=True)}
    for r in got.itertuples():
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
    for _, pieces in got.groupby("doc_id"):
        p = pieces.sort_values("piece")
        assert list(p.start) == [0, *np.cumsum(p.length)[:-1]] and p.length.sum() == len(ids[p.doc_id.iloc[0]]) and (p.length.iloc[1:] == 2048).all()
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()
    assert got.sequence_id.nunique() == -(-got.length.sum() // 2048)


def test_local_search_empties_bins():
    sizes = [6, 5, 5, 4, 3, 3, 2, 2]
    bins, steps = packing.local_search([[0], [1], [2], [3], [4, 5], [6, 7]], sizes, 10)
    assert len(bins) == 3 and steps and sorted(i for b in bins for i in b) == list(range(8))


@pytest.mark.parametrize(("low", "high"), [(500, 520), (300, 1200), (1, 2048), (700, 1000), (30, 90)])
def test_search_needs_no_more_bins_than_best_fit(low, high):
    sizes = np.random.default_rng(low).integers(low, high, 2000).tolist()
    bins, steps = packing.local_search(packing.first_packing(sizes, 2048), sizes, 2048)
    decreasing = packing.best_fit(sorted(sizes, reverse=True), 2048)
    assert sorted(i for b in bins for i in b) == list(range(2000)) and max(sum(sizes[i] for i in b) for b in bins) <= 2048
    assert len(bins) <= len(decreasing) and (low != 500 or len(bins) < 0.97 * len(decreasing)) and (steps or low == 700)


def test_groups_share_their_underfull_bins(spark):
    sizes = np.random.default_rng(2).integers(1, 60, 900)
    rows = [(i, 0, 0, int(n), i) for i, n in enumerate(sizes)]
    frame = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, ids_crc32 long")
    got = packing.pack(frame, sequence=100, group=150).toPandas()
    assert sorted(zip(got.doc_id, got.length, strict=True)) == [(i, n) for i, n in enumerate(sizes)]
    fills = got.groupby("sequence_id").length.sum()
    assert fills.max() <= 100 and len(fills) <= -(-sizes.sum() // 100) + 1  # apart, the groups waste several
    placed = got.sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all()


def test_license_places(spark, docs):
    got = QUERIES["op9_license_scan"](spark, FOLDER).toPandas().set_index("doc_id")
    for i, t in zip(docs.doc_id, docs.text, strict=True):
        w, places, labels = words(t), [], set()
        for phrase, label in license.PHRASES.items():
            p = phrase.split()
            at = [j for j in range(len(w) - len(p) + 1) if w[j : j + len(p)] == p]
            places += at
            labels |= {label} if at else set()
        r = got.loc[i]
        ends = (None, None) if pd.isna(r.first_word) else (int(r.first_word), int(r.last_word))
        assert (r.n_words, r.n_base, r.base_labels, ends) == (len(w), len(places), ",".join(sorted(labels)), (min(places), max(places)) if places else (None, None))
        assert ("mit" in r.labels.split(",")) == ("released under the mit license" in " ".join(w))


def test_license_votes_bridge_an_added_word(spark):
    rows = [(1, "Foo. Permission is hereby granted, free of charge, to any good person obtaining a copy of this software and associated documentation files."), (2, "permission is granted"), (3, "cc by cc by, all rights reserved")]
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1]["labels"] == "mit" and got[2]["labels"] == "" and (got[3]["n_base"], got[3]["first_word"], got[3]["last_word"]) == (3, 0, 4)


def url_parts(url):
    rest = url.partition("://")[2] if url and "://" in url else ""
    host = re.split("[/?#]", rest, maxsplit=1)[0]
    return host.translate(LOWER), re.split("[?#]", rest[len(host) :], maxsplit=1)[0]


def rule_of(host, path):
    fits = [(len(h + p), len(h), h + p, v) for h, p, v in urlfilter.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[2:] if fits else (None, None)


def url_probability(host, path, weights):
    import xxhash

    grams = set()
    for side, text in (("h", f"^{host}$"), ("p", re.sub("[0-9]+", "0", path))):
        for n in urlfilter.SIZES:
            for i in range(len(text) - n + 1):
                h = xxhash.xxh64_intdigest(text[i : i + n].encode(), seed=xxhash.xxh64_intdigest(side.encode(), seed=42))
                grams.add(h % urlfilter.BUCKETS if h < 2**63 else (h - 2**64) % urlfilter.BUCKETS)
    return 1 / (1 + math.exp(-(weights[-1] + sum(weights[g] for g in grams)) / math.sqrt(len(grams) + 1)))


def test_urls(spark):
    weights = urlfilter.train(urlfilter.labelled_urls(spark))
    pages = pd.read_parquet(f"{FOLDER}/pages.parquet").set_index("page_id")
    got = urlfilter.judge(spark.read.parquet(f"{FOLDER}/pages.parquet"), weights).toPandas()
    assert len(got) == len(pages)
    for r in got.itertuples():
        host, path = url_parts(pages.url[r.page_id])
        rule, verdict = rule_of(host, path)
        p = url_probability(host, path, weights)
        assert (r.host, r.path, None if pd.isna(r.rule) else r.rule) == (host, path, rule) and math.isclose(r.probability, p, rel_tol=1e-6)
        assert r.verdict == (verdict or ("block" if p >= 0.5 else "allow"))


def test_url_model_on_held_out_hosts(spark):
    table = urlfilter.labelled_urls(spark)
    host = urlfilter.host_and_path(F.col("url"))[0]
    fold = F.pmod(F.crc32(host.cast("binary")), F.lit(4))
    weights = urlfilter.train(table.filter(fold != 0))
    held = urlfilter.judge(table.filter(fold == 0).withColumn("page_id", F.lit(1)), weights, rules=()).select("host", "verdict")
    truth = table.filter(fold == 0).select(host.alias("host"), "label").distinct()
    both = held.join(truth, "host").toPandas()
    assert len(both) > 150 and ((both.verdict == "block") == (both.label == 1)).mean() > 0.9
    fixture = {url_parts(u)[0] for u in pd.read_parquet(f"{FOLDER}/pages.parquet").url}
    assert not fixture & set(truth.toPandas().host)


def test_toxicity_on_held_out_labels(spark):
    folder = "/root/testdata/sf0.1"
    got = QUERIES["op10_toxicity"](spark, folder).toPandas().merge(pd.read_parquet(f"{folder}/labels.parquet"), on="doc_id")
    held = got[got.held_out]
    assert set(held.doc_id) == {i for i in got.doc_id if zlib.crc32(str(i).encode()) % 5 == 0}
    assert (held.predicted == held.toxic).mean() > 0.97 and ((got.score >= 0.5) == (got.predicted == 1)).all()


def test_windows_one_by_one_equal_segments(spark, docs, monkeypatch):
    frame = spark.createDataFrame(docs[["doc_id", "text"]].head(300))
    key = lambda d: sorted(map(tuple, d.collect()))
    usual = key(substring.dedup(frame))
    monkeypatch.setattr(substring, "HOT", 1)
    assert key(substring.dedup(frame)) == usual


@pytest.mark.parametrize("size", [200.0, 2.0**21, 2.0**40, 2.0**62])
def test_bounds_hold(size):
    rng = np.random.default_rng(1)
    v = np.floor(rng.normal(0, size, (300, 16)))
    low, high = topk.bounds(v[:20], *topk.quantise(v))
    exact = [[sum(int(a) * int(b) for a, b in zip(q, x, strict=True)) for x in v.tolist()] for q in v[:20].tolist()]
    assert all(low[i, j] <= exact[i][j] <= high[i, j] for i in range(20) for j in range(300))
    assert (high - low).mean() < 0.1 * np.abs(exact).mean() + 5000


def test_top_k_of_large_components(spark):
    rng = np.random.default_rng(3)
    vectors = np.round(rng.normal(0, 2**16, (400, 8)), 3)  # 2**26 once they are scaled
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(vectors.tolist())], "vec_id long, embedding array<double>")
    whole = np.floor(vectors * 1024).astype(np.int64)
    got = collections.defaultdict(list)
    for r in topk.search(frame, F.col("vec_id") % 100 == 0, k=5, cells=64, queries=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, -s) for s, i in sorted((-int(whole[q] @ whole[i]), i) for i in range(400) if i != q)[:5]] for q in range(0, 400, 100)}


def test_ties_of_a_very_common_vector(spark):
    """A third of all rows are one vector; the smallest ids win, also for its own queries."""
    rng = np.random.default_rng(5)
    vectors = rng.integers(-9, 10, (300, 4)) / 8
    vectors[::3] = [0.5, -0.25, 1.0, 0.0]
    rows = [(i, v) for i, v in enumerate(vectors.tolist())] + [(3, vectors[3].tolist()), (300, vectors[0].tolist())]
    whole = {i: np.floor(np.array(v) * 1024).astype(np.int64) for i, v in rows}
    got = collections.defaultdict(list)
    for r in topk.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 100 == 0, k=5, cells=16, queries=2).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert got == {q: [(i, -s) for s, i in sorted((-int(whole[q] @ whole[i]), i) for i in whole if i != q)[:5]] for q in range(0, 301, 100)}


def test_index_matches_and_places():
    rng = np.random.default_rng(0)
    for n, k in ((2, 2), (60, 3), (400, 4)):
        t = rng.integers(0, k, n)
        t[-1] = 0
        index = substring.FMIndex(t, k)
        assert sorted(index.locate(np.arange(n + 1)).tolist()) == list(range(n + 1))
        length = min(6, n)
        starts = np.arange(n - length + 1)
        low, high, matched = index.matching(t, starts, length)
        for s in starts:
            occurs = lambda j, s=s: sum((t[q : q + j] == t[s + length - j : s + length]).all() for q in range(n - j + 1))
            assert matched[s] == max((j for j in range(1, length + 1) if occurs(j) > 1), default=0)
            if matched[s]:
                assert high[s] - low[s] == occurs(matched[s])


def test_scores_do_not_depend_on_the_layout(spark):
    frame = spark.read.parquet(f"{FOLDER}/documents.parquet")
    score = lambda d: lm.score(d, shard=60_000).toPandas().set_index("doc_id").sort_index().score
    one, many = score(frame.coalesce(1)), score(frame.repartition(13, "doc_id"))
    assert np.allclose(one, many, rtol=1e-4)


def test_scores_against_a_plain_reading(spark, monkeypatch):
    """Every token's probability from whole softmaxes over classes and words and from its part of a shared word."""
    rng = np.random.default_rng(9)
    rows = [(i, " ".join([f"w{x}" for x in rng.zipf(1.5, 60) % 300] + [f"rare{rng.integers(400)}"])) for i in range(200)]
    seen, real = {}, lm.train
    monkeypatch.setattr(lm, "train", lambda words, sent, **k: seen.setdefault("p", seen.update(v=sent.value) or real(words, sent, **k)))
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), least=5).collect()}
    p, v = seen["p"], seen["v"]
    counts, tokens = collections.Counter(), {}
    import pyarrow as pa

    for i, t in rows:
        tokens[i] = next(iter(lm._tokens(pa.array([t]), lm.Powers())))[0]
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(tokens[i].tolist())
    look = lm.Lookup(v["keys"])
    slot = lambda h: h >> (64 - lm.RARE_BITS)
    together = collections.defaultdict(lambda: [0, 0])
    for h, c in counts.items():
        if c < 5 and h != int(lm.END):
            together[slot(h)][0] += c
            together[slot(h)][1] += 1
    soft = lambda x: x - np.log(np.exp(x - x.max()).sum()) - x.max()
    for i in list(tokens)[:25]:
        total, before = 0.0, [lm.END_WORD, lm.END_WORD]
        h = tokens[i]
        w = lm.words_of(v, look(h), h)
        w[h == lm.END] = lm.END_WORD
        for token, word in zip(h.tolist(), w.tolist(), strict=True):
            made = p["r1"][before[0]].astype(float) + p["r2"][before[1]].astype(float)
            of = word // p["width"]
            mine = slice(of * p["width"], (of + 1) * p["width"])
            total += soft(p["classes"][:, :-1].astype(float) @ made + p["classes"][:, -1])[of]
            total += soft(p["q"][mine, :-1].astype(float) @ made + p["q"][mine, -1].astype(float) + p["bias"][mine])[word - of * p["width"]]
            if counts[token] < 5 and token != int(lm.END):
                c, kinds = together[slot(token)]
                total += math.log((counts[token] + 1) / (c + kinds + 1))
            before = [word, before[0]]
        assert math.isclose(got[i]["score"], total / math.log(10), rel_tol=1e-3)


def test_a_nul_is_a_token_of_its_own(spark):
    one, other = [i for i in range(20) if zlib.crc32(str(i).encode()) % 7 != 2][:2]
    rows = [(one, "\x00 \x00 \x01"), (other, "a")]
    got = {r["doc_id"]: r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    n, v = 6, 4  # NUL twice, \x01, a, two ends
    assert math.isclose(got[one]["base_score"], sum(math.log10((c + 1) / (n + v + 1)) for c in (2, 2, 1, 2)), rel_tol=1e-9)


def plain_spans(text, templates, k=3, near=2, cover=0.8, short=30):
    """Labels whose template's diagonals, merged, cover enough of its words."""
    w, out = words(text), set()
    for label, texts in templates.items():
        for t in texts:
            tw = words(t)
            votes = collections.defaultdict(list)
            for i in range(len(w) - k + 1):
                for j in range(len(tw) - k + 1):
                    if w[i : i + k] == tw[j : j + k]:
                        votes[i - j].append(j)
            group, last = set(), None
            for d in [*sorted(votes), None]:
                if d is None or (last is not None and d - last > near):
                    if len(group) >= (1 if len(tw) <= short else cover) * len(tw):
                        out.add(label)
                    group = set()
                if d is not None:
                    group |= {j + x for j in votes[d] for x in range(k)}
                    last = d
    return out


def test_license_labels_against_plain_diagonals(spark, docs):
    rng = np.random.default_rng(6)
    rows = [(int(i), t) for i, t in zip(docs.doc_id[:150], docs.text[:150], strict=True)]
    for n, (label, texts) in enumerate(license.TEMPLATES.items()):
        for m, t in enumerate(texts):
            w = t.split()
            for e in range(4):
                v = list(w)
                for at in rng.integers(0, len(v), e * len(v) // 25):
                    v[at] = "other"
                if e == 3:
                    v.insert(len(v) // 2, "extra")
                rows.append((10_000 + 100 * n + 10 * m + e, "Before it. " + " ".join(v).title() + " after it"))
    got = {r["doc_id"]: r for r in license.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        base = {x for phrase, x in license.PHRASES.items() if f" {phrase} " in f" {' '.join(words(t))} "}
        assert set(filter(None, got[i]["labels"].split(","))) == base | plain_spans(t, license.TEMPLATES), i
    kelvin = license.scan(spark.createDataFrame([(1, "This Wor\u212a is under the terms")], "doc_id long, text string")).first()
    assert kelvin["n_words"] == 6


def test_matcher_against_plain_search():
    rng = np.random.default_rng(12)
    weights = {" scum ": 5.0, " scumb": 4.0, " idiot ": 6.0, " clown ": 3.5, " clo": 3.2, " trash ": 4.2, " tr": 3.1}
    lexicon = toxicity.Lexicon(weights)
    matcher = lexicon.matcher()
    vocabulary = ["scum", "scumbag", "idiot", "1diot", "clоwn", "class", "clown", "cloud", "trash", "can", "bin", "tr4sh", "proof", "pond", "true", "fine", "a"]
    for _ in range(300):
        folded = toxicity.fold(" ".join(rng.choice(vocabulary, rng.integers(0, 12))))
        spared = [(m.start(), m.start() + len(e) + 1) for e in toxicity.EXCEPTIONS for m in re.finditer(f"(?= {e} )", folded)]
        total = 0.0
        for m in re.finditer("(?= ([^ ]+) )", folded):
            word, at = m[1], m.start()
            best = max([x for e, x in weights.items() if (e == f" {word} ") or (e[-1] != " " and word.startswith(e[1:]) and len(word) > len(e) - 1)], default=0.0)
            total += 0.0 if any(a <= at < b for a, b in spared) else best
        assert math.isclose(lexicon.hits(matcher, folded)[0], total), folded


@pytest.mark.parametrize("phrase", toxicity.EXCEPTIONS)
def test_exceptions_spare_their_words_alone(phrase):
    lexicon = toxicity.Lexicon({f" {w} ": 5.0 for w in phrase.split()})
    matcher = lexicon.matcher()
    assert lexicon.hits(matcher, toxicity.fold(f"the {phrase.upper()} here"))[0] == 0.0
    assert lexicon.hits(matcher, toxicity.fold(f"the {phrase.split()[0]} here"))[0] == 5.0


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest() == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"

"""Cases that once lost links, took quadratic time or failed: boilerplate, texts of many secrets, odd columns and ids."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from barloom.llm import decontam, minhash, secrets, substring


def boilerplate(pairs, shared, edits, seed):
    """Pairs of near copies of 200 words, of which ``shared`` are the same in all texts; a copy has ``edits`` words changed anywhere."""
    rng = np.random.default_rng(seed)
    common = [f"c{x}" for x in range(shared)]
    rows = []
    for p in range(pairs):
        own = [f"p{p}w{x}" for x in range(200 - shared)]
        at = np.sort(rng.choice(200, 200 - shared, replace=False))
        text = np.empty(200, object)
        text[at] = own
        text[np.setdiff1d(np.arange(200), at)] = common
        copy = text.copy()
        for i in rng.choice(200, edits, replace=False):
            copy[i] = f"e{p}x{i}"
        rows += [(2 * p, " ".join(text)), (2 * p + 1, " ".join(copy))]
    return rows


@pytest.mark.parametrize(("pairs", "shared", "edits"), [(400, 160, 18), (400, 150, 16), (4000, 160, 18)])
def test_near_copies_among_boilerplate(spark, pairs, shared, edits):
    rows = boilerplate(pairs, shared, edits, pairs + shared)
    got = {r["_id"]: r["class_id"] for r in minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert sum(got[2 * p] == got[2 * p + 1] for p in range(pairs)) >= 0.95 * pairs
    assert all(i // 2 == c // 2 for i, c in got.items())


def test_every_text_of_a_large_bucket_is_told(spark):
    """Whatever the bucket's number, its texts' lengths and the edges of tasks: a pair that isn't compared is of two such texts."""
    rng = np.random.default_rng(9)
    sizes = [1, 2, 3, 5, 6, 40, 900]
    rows = [(b, 1000 * b + i, int(n)) for b, size in enumerate(sizes) for i, n in enumerate(rng.integers(80, 110, size))]
    pairs, many = minhash._met(spark.createDataFrame(rows, "bucket long, node long, n long").repartition(3))
    sized = many.distinct().groupBy("bucket").count().filter(f"count > {minhash.BACK + 2}").collect()
    assert {r["bucket"]: r["count"] for r in sized} == {4: 6, 5: 40, 6: 900}
    # small buckets are compared whole
    met = {(r["a"], r["b"]) for r in pairs.collect()}
    small = [r for r in rows if sizes[r[0]] <= minhash.BACK + 2]
    assert all((x[1], y[1]) in met for x in small for y in small if x[0] == y[0] and x[1] < y[1] and min(x[2], y[2]) >= 0.8 * max(x[2], y[2]))


def test_texts_of_a_large_bucket_meet_two_others(spark):
    """The leader and the text before it: the exact join, which all of them are told to, has the rest."""
    pairs, many = minhash._met(spark.createDataFrame([(1, i, 100) for i in range(2000)], "bucket long, node long, n long").repartition(3))
    assert many.distinct().count() == 2000 and 2000 <= pairs.count() < 2.1 * 2000


def test_components_of_a_large_group_go_through_its_links_once(spark, monkeypatch):
    """Paths, stars, pairs and a group with many links: what is kept grows with the nodes, not with four rows for each link."""
    rng = np.random.default_rng(12)
    names = rng.permutation(10**6)[:3000].tolist()
    path = [(i, i + 1) for i in range(200)]
    star = [(300, i) for i in range(301, 500)]
    pairs = [(i, i + 1) for i in range(600, 1000, 2)]
    group = {tuple(sorted(x)) for x in rng.integers(1000, 3000, (30_000, 2)).tolist() if x[0] != x[1]}
    edges = [tuple(sorted((names[a], names[b]))) for a, b in [*path, *star, *pairs, *group]]
    comp = {x: x for e in edges for x in e}

    def root(x):
        while comp[x] != x:
            comp[x] = x = comp[comp[x]]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    kept = []

    def counted(keep):
        def of(df):
            out = keep(df)
            kept.append(out.count())
            return out

        return of

    monkeypatch.setattr(minhash, "cut", counted(minhash.cut))
    monkeypatch.setattr(minhash, "rewritten", counted(minhash.rewritten))
    got = {r["node"]: r["comp"] for r in minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in comp}
    assert max(kept) < len(edges) / 2
    # further links, of which some have new ends
    more = [(names[200], names[300]), (names[2999], names[601]), (names[999], names[250]), (names[251], names[252])]
    for a, b in more:
        comp.setdefault(a, a), comp.setdefault(b, b)
        a, b = root(a), root(b)
        comp[max(a, b)] = min(a, b)
    comps = spark.createDataFrame(list(got.items()), "node long, comp long")
    assert {r["node"]: r["comp"] for r in minhash._joined_up(comps, spark.createDataFrame(more, "a long, b long")).collect()} == {x: root(x) for x in comp}


def test_the_exact_join_finds_every_alignment(spark):
    """Links of scattered edits, which have few shingles and no rare pairs of words in common, among texts of one vocabulary."""
    rng = np.random.default_rng(10)
    texts = []
    for _ in range(60):
        text = rng.integers(0, 60, 90)
        texts.append(text)
        for edits in (6, 9, 12):
            copy = text.copy()
            copy[rng.choice(90, edits, replace=False)] = rng.integers(0, 60, edits)
            texts.append(np.delete(copy, rng.integers(0, 90, edits // 3)))
    texts = [t.astype("<u4") for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if minhash.alignment(texts[a], texts[b])}
    frame = spark.createDataFrame([(i, i, bytearray(t.tobytes())) for i, t in enumerate(texts)], "node long, comp long, seq binary")
    got = {(r["a"], r["b"]) for r in minhash._left_over(frame).collect()}
    assert len(want) > 60 and want <= got and len(got) < 20 * len(want)


def test_long_texts_without_anchors():
    rng = np.random.default_rng(4)
    a = rng.integers(0, 50_000, 12_000).astype(np.uint32)
    b = a.copy()
    b[::10] = np.arange(len(b[::10])) + 60_000
    assert minhash.alignment(a, b) == pytest.approx((12_000 - len(b[::10])) / (12_000 + len(b[::10])))


def test_a_text_of_many_secrets(spark):
    hits = 120_000
    text = "".join(f"{i:024x} z " for i in range(hits))
    frame = spark.createDataFrame([(1, text, "s", "en"), (2, f"é {'0' * 23}a9 token=abc123", "s", "en")], "doc_id long, text string, source string, lang string")
    began = time.monotonic()
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(frame)).collect()}
    assert (got[1]["n_hex"], got[2]["n_hex"], got[2]["spans"]) == (hits, 1, "hex:2:27,assign:28:40")
    ends = got[1]["spans"].rsplit(",", 1)[1]
    assert ends == f"hex:{27 * (hits - 1)}:{27 * (hits - 1) + 24}" and time.monotonic() - began < 120


def test_many_marks_in_one_text(spark):
    rng = np.random.default_rng(6)
    words = ["".join(rng.choice(list("abcdefghijkmnpqrstuvwxyz23456789"), 20)) for _ in range(3000)]
    text = " ".join(f"é token={w} and Bearer {w}" if i % 7 == 0 else f"password: {w}" for i, w in enumerate(words))
    want = " ".join("é [SECRET] and Bearer " if i % 7 == 0 else "[SECRET]" for i in range(len(words)))
    got = secrets.redact(spark.createDataFrame([(1, text, "s", "en"), (2, "plain", "s", "en")], "doc_id long, text string, source string, lang string"))
    found = {r["doc_id"]: r["text"] for r in got.collect()}
    assert found[2] == "plain" and not any(w in found[1] for w in words)
    assert found[1].replace("[SECRET]", "").replace("Bearer ", "").split() == want.replace("[SECRET]", "").replace("Bearer ", "").split()


def test_marks_of_blocks_and_overlaps(spark, monkeypatch):
    monkeypatch.setattr(secrets, "BLOCK", 3)
    spans = [(2, 4), (3, 9), (5, 6), (9, 10), (12, 20), (13, 14), (14, 25), (15, 16), (30, 31)]
    body = "".join(chr(0x61 + i % 26) if i % 5 else "é" for i in range(40))
    frame = spark.createDataFrame([(body, spans), (body, [])], "t string, s array<struct<start:int,end:int>>")
    out, at = "", 0
    for a, b in spans:
        if a >= at:
            out += body[at:a] + "#"
        at = max(at, b)
    got = [r["r"] for r in frame.select(secrets._marked(F.col("t"), F.col("s"), "#").alias("r")).collect()]
    assert got == [out + body[at:], body]


def test_variant_columns(spark):
    frame = spark.createDataFrame([(1, "some words of a text that stands here alone", '{"a": 1}')], "doc_id long, text string, j string").withColumn("v", F.parse_json("j"))
    tests = spark.createDataFrame([(i, f"item {i} with some words") for i in range(20)], "item_id long, text string")
    for size in (1 << 20, 200):
        assert decontam.judge(frame, tests, ["doc_id"], block_bytes=size).count() == 1
    assert decontam.remove(frame, tests).columns == frame.columns and minhash.deduplicate(frame).count() == 1


def test_the_smallest_id_is_no_null(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(-(2**63), text), (None, "other"), (5, text), (-(2**63), "short")]
    got = sorted(map(tuple, substring.dedup(spark.createDataFrame(rows, "doc_id long, text string")).select("doc_id", "n_words", "n_removed").collect()), key=repr)
    assert got == sorted([(-(2**63), 40, 0), (None, 1, 0), (5, 40, 40), (-(2**63), 1, 0)], key=repr)


def test_longest_match_of_every_test_suffix(spark):
    rng = np.random.default_rng(8)
    text = lambda n: [f"w{x}" for x in rng.integers(0, 12, n)]
    items = {i: text(30) for i in range(5)} | {7: text(3)}
    docs = {i: text(int(rng.integers(0, 90))) for i in range(40)}
    docs[11] = [*docs[11], *items[2][4:29], "x", *items[3][:16]]
    docs[33] = [*docs[33], *items[2][4:29]]
    frame = spark.createDataFrame([*((i, " ".join(w)) for i, w in docs.items()), (None, " ".join(items[2])), (50, None)], "doc_id long, text string").repartition(3)
    tests = spark.createDataFrame([*((str(i), " ".join(w)) for i, w in items.items()), ("e", None)], "item_id string, text string")

    def best(item, p):
        found = []
        for i, w in [*docs.items(), (None, items[2])]:
            for at in range(len(w)):
                n = 0
                while p + n < len(item) and at + n < len(w) and item[p + n] == w[at + n]:
                    n += 1
                found.append((-n, i is None, i or 0, at))
        n, _, i, at = min(found)
        return -n, i, at

    for size in (1 << 20, 300):
        got = {(r["item"], r["item_at"]): (r["words"], r["doc_id"], r["doc_at"]) for r in decontam.longest_matches(frame, tests, block_bytes=size).collect()}
        assert len(got) == 153 and all(got[str(i), p][0] == best(w, p)[0] for i, w in items.items() for p in range(len(w)))
        places = {k: (n, i, at) for k, (n, i, at) in got.items() if n >= 13}
        assert places["2", 4][1:] is not None and places["2", 0] == (30, None, 0)
        for (item, p), (n, i, at) in got.items():
            w = items[2] if i is None else docs[i]
            assert w[at : at + n] == items[int(item)][p : p + n]
    assert decontam.longest_matches(frame, tests, least=13).filter("words < 13").count() == 0 and decontam.longest_matches(frame.limit(0), tests).count() == 0

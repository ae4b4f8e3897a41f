"""Every operator on awkward tables: nulls, empty and very long texts, repeated rows, clashing columns, no rows at all."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from barloom.llm import decontam, license, lm, minhash, packing, secrets, substring, topk, toxicity, urlfilter
from barloom.llm.queries import vocabulary

LONG = " ".join(f"w{i % 977}" for i in range(120_000))
ROWS = [
    (None, "a document without an id, yet with a few words", "en", "s1", 10),
    (1, None, None, None, None),
    (2, "", "en", "s1", 0),
    (3, "   \n\t ", "en", None, 6),
    (4, LONG, "en", "s1", len(LONG)),
    (5, "the same words stand here twice or more", "en", "s2", 39),
    (5, "the same words stand here twice or more", "en", "s2", 39),
    (6, "the same words stand here twice or more", "de", "s3", 39),
    (7, "ünïcödé 文字 \x00 nul and token = \"0123456789abcdef0123456789abcdef\" end", "de", "s3", 60),
    (8, "x", "fr", "s4", 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ("score", "predicted", "_id", "_body", "_h", "live", "n", "m", "bucket", "spans", "contaminated", "copy", "token", "key", "words", "body")


def documents(spark, rows=ROWS):
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.withColumns({c: F.lit("clash") for c in CLASH})


def benchmark(spark, empty=False):
    rows = [] if empty else [(1, "the same words stand here twice or more"), (None, None), (2, ""), (3, "x")]
    return spark.createDataFrame(rows, "item_id long, text string")


def labels(spark, rows=()):
    return spark.createDataFrame(list(rows), "doc_id long, quality int, toxic int")


OPERATORS = {
    "near_dedup": lambda s, d: minhash.classes(d),
    "secrets": lambda s, d: secrets.digest(secrets.scan(d)),
    "decontam": lambda s, d: decontam.judge(d, benchmark(s), ["doc_id"]),
    "lm": lambda s, d: lm.score(d),
    "substring": lambda s, d: substring.dedup(d),
    "license": lambda s, d: license.scan(d),
    "toxicity": lambda s, d: toxicity.judge(d, toxicity.train(d, labels(s, [(5, 1, 1), (6, 0, 0), (None, 1, 1), (7, None, None)])), ["doc_id"]),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_one_row_for_each_row(spark, name):
    assert OPERATORS[name](spark, documents(spark)).count() == len(ROWS)


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_no_rows(spark, name):
    assert OPERATORS[name](spark, documents(spark, [])).count() == 0


def test_packing(spark):
    got = packing.pack_documents(documents(spark), *vocabulary()).toPandas()
    assert got[got.doc_id != 4].shape[0] == 9 and got[got.doc_id == 4].sort_values("piece").length.iloc[1:].eq(2048).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert packing.pack_documents(documents(spark, []), *vocabulary()).count() == 0


def rows_of(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()), key=repr)


A, B, C = "one text with a few words of its own", "another text that shares nothing with it", "a third which stands without any id"


def test_near_dedup_knows_texts_by_their_words(spark):
    frame = lambda *rows: spark.createDataFrame(list(rows), "doc_id long, text string")
    shared = frame((3, A), (5, A), (5, B))
    assert rows_of(minhash.classes(shared), "_id", "class_id", "kept") == [(3, 3, True), (5, 3, False), (5, 5, True)]
    assert rows_of(minhash.deduplicate(shared), "doc_id", "text") == [(3, A), (5, B)]
    nameless = frame((None, A), (None, B), (1, A), (2, B), (None, C), (None, C), (7, ""), (8, None), (7, ""))
    assert rows_of(minhash.classes(nameless), "_id", "class_id", "kept") == sorted(
        [(None, 1, False), (None, 2, False), (1, 1, True), (2, 2, True), (None, None, True), (None, None, True), (7, 7, True), (7, 7, True), (8, 8, True)], key=repr
    )
    assert rows_of(minhash.deduplicate(nameless), "doc_id", "text") == sorted([(1, A), (2, B), (None, C), (7, ""), (8, None)], key=repr)
    case = frame((4, A.upper() + "!"), (2, A), (2, A.title()))
    assert len(rows_of(minhash.deduplicate(case), "doc_id", "text")) == 1


def test_redaction_is_by_id_and_text(spark):
    secret = "token = 'A7f9Kq2ZpL0xW8sD'"
    rows = [(None, f"x {secret}", "s", "en"), (None, "x", "s", "en"), (1, f"y {secret}", "s", "en"), (1, "y", "s", "en"), (1, f"y {secret}", "s", "en"), (2, None, None, None)]
    got = secrets.redact(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))
    assert rows_of(got, "doc_id", "text") == sorted([(None, "x [SECRET]'"), (None, "x"), (1, "y [SECRET]'"), (1, "y"), (1, "y [SECRET]'"), (2, None)], key=repr)


def test_what_is_live(spark):
    long_password = "p4" + "Zq8" * 40 + "xYwV7"
    texts = {
        1: "password: please", 2: "password: x7Kq2z", 3: f"https://u{'s' * 80}:{long_password}@host", 4: "secret = aaaaaaaaaaaaaaaa", 5: "token: everywhere1 and", 6: "api_key=abcdef0123456789abcdef01",
    }
    rows = [(i, t, f"s{i}", "en") for i, t in texts.items()] + [(10 + i, "token: copied9example7", f"s{i}", "en") for i in range(4)]
    got = {r["doc_id"]: r for r in secrets.digest(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string"))).collect()}
    assert [got[i]["n_live"] for i in (1, 2, 4, 10)] == [0, 1, 0, 0] and got[10]["n_copied"] == 1
    assert got[3]["spans"].startswith("url:0:") and got[6]["n_assign"] == 1 and got[6]["n_hex"] == 1


def stage_tables(spark, tmp_path, docs, label_rows=()):
    for name, frame in (("documents", docs), ("labels", labels(spark, label_rows)), ("benchmark", benchmark(spark))):
        frame.write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_stages_keep_columns_and_clean_rows(spark, tmp_path):
    docs = documents(spark)
    folder = stage_tables(spark, tmp_path, docs)
    left = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        left[name] = out.count()
    # one of the three equal texts stays; the benchmark's own text and "x" go
    assert left == {"toxicity": 10, "near_dedup": 8, "decontamination": 6, "secret_scan": 10}
    clean = {r["doc_id"]: r["text"] for r in corpus_pipeline.redact_secrets(spark, docs, folder).collect()}
    assert clean[7].endswith('nul and [SECRET]" end') and clean[4] == LONG and clean[1] is None
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents(spark, []), folder).count() == 0


def pieces_of(rows):
    from tokenizers import Tokenizer

    whole, out = Tokenizer.from_file(vocabulary()[0]), []
    for i, text in rows:
        ids = np.array([*whole.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = len(ids) % 2048 or 2048
        cuts = [0, *range(at, len(ids) + 1, 2048)]
        out += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True))]
    return sorted(out, key=repr)


def test_the_whole_pipeline(spark, tmp_path):
    docs = documents(spark)
    got = corpus_pipeline.run(spark, stage_tables(spark, tmp_path, docs))
    secret = ROWS[8][1].replace('token = "0123456789abcdef0123456789abcdef', "[SECRET]")
    want = [(None, ROWS[0][1]), (1, None), (2, ""), (3, ROWS[3][1]), (4, LONG), (7, secret)]
    assert rows_of(got, "doc_id", "piece", "start", "length", "ids_crc32") == pieces_of(want)
    placed = got.toPandas().sort_values(["sequence_id", "offset"])
    assert (placed.offset == placed.groupby("sequence_id").length.cumsum() - placed.length).all() and placed.groupby("sequence_id").length.sum().max() <= 2048


def test_the_whole_pipeline_on_toxic_and_near_copies(spark, tmp_path):
    rng = np.random.default_rng(7)
    text = lambda *more: " ".join([f"w{x}" for x in rng.integers(0, 4000, 60)] + list(more))
    rows = [(i, text(*["zorkface", "zorkface"] if i % 2 else []), "en", "s1", 1) for i in range(400)]
    base = text().split()
    near = [*base[:20], "changed", *base[21:]]
    rows += [(1000, " ".join(base), "en", "s1", 1), (1001, " ".join(near), "en", "s2", 1), (1002, " ".join(base).upper(), "en", "s3", 1), (1003, text("zorkface", "zorkface"), "en", "s3", 1)]
    folder = stage_tables(spark, tmp_path, spark.createDataFrame(rows, SCHEMA), [(i, 1, i % 2) for i in range(400)])
    got = {r[0] for r in rows_of(corpus_pipeline.run(spark, folder), "doc_id")}
    assert got == {i for i in range(0, 400, 2)} | {1000}


def test_the_pipeline_without_rows(spark, tmp_path):
    got = corpus_pipeline.run(spark, stage_tables(spark, tmp_path, documents(spark, [])))
    assert got.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(got.columns)


def test_values_of_awkward_rows(spark):
    docs = documents(spark)
    scored = {r["doc_id"]: r for r in lm.score(docs).collect()}
    assert scored[1]["n_tokens"] == scored[2]["n_tokens"] == 1 and scored[5]["n_tokens"] == 9 and scored[4]["n_tokens"] == 120_001 and None in scored
    assert [scored[i]["score"] for i in (1, 2)][0] == [scored[i]["score"] for i in (1, 2)][1]
    kept = {r["doc_id"]: r for r in substring.dedup(docs).collect()}
    assert kept[1]["n_words"] == 0 and kept[5]["n_removed"] == 0 and kept[4]["n_removed"] == 120_000 - 977 and kept[None]["n_words"] == 10
    seen = {r["doc_id"]: r for r in license.scan(docs).collect()}
    assert (seen[1]["n_words"], seen[1]["labels"], seen[1]["score"], seen[1]["first_word"]) == (0, "", 0.0, None) and seen[4]["n_words"] == 120_000
    found = {r["doc_id"]: r for r in decontam.judge(docs, benchmark(spark), ["doc_id", "n_words"]).collect()}
    assert (found[5]["n_hit"], found[5]["contaminated"], found[5]["longest_hit"], found[5]["longest_item"]) == (8, True, 8, "1")
    assert (found[1]["n_words"], found[1]["contaminated"], found[1]["longest_hit"]) == (0, False, None) and found[8]["longest_item"] == "3"
    toxic = toxicity.judge(docs, toxicity.Lexicon({" stand ": 9.0}, bias=-3.0), ["doc_id", "score"]).collect()
    assert {r["doc_id"] for r in toxic if r["predicted"]} == {5, 6} and all(isinstance(r["score"], float) for r in toxic)
    assert toxicity.remove(docs, toxicity.Lexicon({" stand ": 9.0}, bias=-3.0)).count() == 7


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace

    from barloom.llm.common import checkpoint_folder

    session = lambda master, named=None: SimpleNamespace(conf=SimpleNamespace(get=lambda *_: named), sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None))
    assert checkpoint_folder(session("yarn", "hdfs://x/y")) == "hdfs://x/y" and checkpoint_folder(session("local[4]"))
    with pytest.raises(ValueError):
        checkpoint_folder(session("yarn"))


def test_empty_benchmark(spark):
    assert decontam.judge(documents(spark), benchmark(spark, True), ["doc_id"]).filter("contaminated OR n_items > 0").count() == 0


def test_benchmark_in_blocks(spark):
    rows = [(i, " ".join(f"b{i}w{j}" for j in range(40))) for i in range(6)]
    both = " ".join([*(f"b1w{j}" for j in range(5, 30)), "and", *(f"b4w{j}" for j in range(20)), "x", *(f"b2w{j}" for j in range(12))])
    docs = documents(spark, [*ROWS, (20, both, "en", "s9", 1), (20, both, "en", "s9", 1)])
    tests = benchmark(spark).unionByName(spark.createDataFrame(rows, "item_id long, text string").withColumn("item_id", F.col("item_id") + 10))
    whole, blocks = (decontam.judge(docs, tests, ["doc_id", "lang"], block_bytes=b) for b in (1 << 20, 300))
    assert whole.columns == blocks.columns and sorted(map(str, whole.collect())) == sorted(map(str, blocks.collect()))
    r = whole.filter("doc_id = 20").first()
    assert (r["n_hit"], r["n_items"], r["longest_hit"], r["longest_at"], r["longest_item"], r["longest_item_at"]) == (46, 3, 25, 0, "11", 5)


def test_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.5]), (100, [0.5, -1.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 0.0]), (5, []), (6, [1.0, 2.0, 3.0]), (7, [0.25, 0.25]), (7, [0.25, 0.25]), (None, [9.0, 9.0]), (8, [0.25, 0.25])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumns({"id": F.lit(1), "v": F.lit(1), "is_query": F.lit(1), "score": F.lit(1)})
    got = topk.search(frame, F.col("vec_id") % 100 == 0).collect()
    assert [(r["rank"], r["vec_id"], r["score"]) for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == 0] == [(1, 7, 393216), (2, 8, 393216), (3, 100, 0)]
    assert topk.search(frame.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_urls(spark):
    rows = [(1, None), (2, ""), (3, "no scheme"), (4, "http://EXAMPLE.Com/de/x?q"), (5, "https://a.org/fr/y#z"), (6, "ftp://sub.example.net/en/"), (7, "://"), (8, "http://net"), (9, "http://deep.net/"), (9, "http://deep.net/"), (None, "http://üñí.org/fr/\n")]
    frame = spark.createDataFrame(rows, "page_id long, url string").withColumns({"host": F.lit(1), "verdict": F.lit(1), "label": F.lit(1)})
    weights = urlfilter.train(urlfilter.labelled_urls(spark))
    got = sorted(map(tuple, urlfilter.judge(frame, weights).select("page_id", "host", "path", "rule", "verdict").collect()), key=lambda r: (r[0] or 0, r[1]))
    assert len(got) == len(rows)
    known = {r[0]: r[1:] for r in got}
    assert known[1][:3] == known[3][:3] == ("", "", None)
    assert known[4] == ("example.com", "/de/x", "example.com/de/", "block") and known[5] == ("a.org", "/fr/y", "org/fr/", "allow")
    assert known[6] == ("sub.example.net", "/en/", "example.net/en/", "allow") and known[8][2] is None and known[9] == ("deep.net", "/", "net/", "block")
    assert urlfilter.judge(frame.limit(0), weights).count() == 0 and urlfilter.train(urlfilter.labelled_urls(spark).limit(0)) == [0.0] * (urlfilter.BUCKETS + 1)

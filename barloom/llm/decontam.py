"""Benchmark decontamination by suffix arrays over shards of the training text.

A shard is a run of documents that a task reads together.  All of its suffixes
are sorted to full depth; the windows of the benchmark, each the beginning of a
test suffix, are binary-searched in them, and the equal range gives all places.
Windows that follow one another on one diagonal make up a verbatim match, so
the longest match of every document is known with its places in the document
and the item.  Documents never leave their task, so nothing is shuffled.

The benchmark is hashed in tasks and searched block by block, one block in
memory at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .words import ALNUM, Powers, grams, suffix_array, text_chunks, word_bounds, word_hashes

#: Words of a window; words of a window's beginning that a shard must hold for a search; bytes of a shard and of a benchmark block.
WINDOW, PREFIX, SHARD_BYTES, BLOCK_BYTES = 13, 5, 4 << 20, 32 << 20
_SEEN = 1 << 22


class Tests:
    """A block of benchmark items: their words, and the windows with which test suffixes begin."""

    def __init__(self, items: list[str], words: list[np.ndarray], window: int = WINDOW):
        self.names = sorted(set(items))
        number = {name: i for i, name in enumerate(self.names)}
        self.items, self.lengths = items, (lengths := np.array([len(w) for w in words], np.int64))
        self.words = np.concatenate([*words, np.zeros(window, np.uint64)])
        size = np.minimum(lengths, window)
        counts = np.where(lengths > 0, lengths - size + 1, 0)
        self.row = np.repeat(np.arange(len(words)), counts)  # equal ids may stand in several rows
        self.item = np.array([number[i] for i in items], np.int64)[self.row]
        self.size = size[self.row]
        self.place = np.arange(len(self.row)) - np.repeat(np.cumsum(counts) - counts, counts)
        self.start = (np.cumsum(lengths) - lengths)[self.row] + self.place
        self.window = window
        self.prefix = np.minimum(self.size, PREFIX)
        self.gram = np.zeros(len(self.row), np.uint64)
        for k in np.unique(self.prefix):
            mine = self.prefix == k
            self.gram[mine] = grams(self.words, int(k))[self.start[mine]]

    def search(self, words: np.ndarray):
        """(place in ``words``, window) of all places of all windows in one shard."""
        near = np.zeros(len(self.row), bool)
        for k in np.unique(self.prefix):
            # a window whose beginning no suffix has can't be found: most of them need no search
            seen = np.zeros(_SEEN, bool)
            seen[grams(words, int(k)) & np.uint64(_SEEN - 1)] = True
            near |= (self.prefix == k) & seen[self.gram & np.uint64(_SEEN - 1)]
        near = np.flatnonzero(near)
        if not len(near) or not len(words):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = suffix_array(words)
        padded = np.append(words, np.zeros(self.window, np.uint64))
        depth = np.arange(self.window)
        within = depth < self.size[near][:, None]
        tests = self.words[self.start[near][:, None] + depth]
        low, high = (self._bound(padded, order, tests, within, depth, equal) for equal in (False, True))
        counts = high - low
        which = np.repeat(near, counts)
        at = np.arange(len(which)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(low, counts)
        return order[at], which

    @staticmethod
    def _bound(padded, order, tests, within, depth, equal: bool) -> np.ndarray:
        """How many suffixes come before each test, or with ``equal`` also those that begin with it."""
        low, high = np.zeros(len(tests), np.int64), np.full(len(tests), len(order), np.int64)
        row = np.arange(len(tests))
        while (live := low < high).any():
            middle = (low + high) >> 1
            suffix = padded[order[np.minimum(middle, len(order) - 1)][:, None] + depth]
            differ = (suffix != tests) & within
            first = differ.argmax(axis=1)
            before = np.where(differ[row, first], suffix[row, first] < tests[row, first], equal)
            low = np.where(live & before, middle + 1, low)
            high = np.where(live & ~before, middle, high)
        return low


def find(h: np.ndarray, first: np.ndarray, tests: Tests):
    """(hit flags by word, documents and items of all hits, {document: (words, place, item, its place)} of the longest matches) of one shard."""
    n_docs = len(first) - 1
    # a word that stands nowhere else ends each document
    bounds = first + np.arange(n_docs + 1)
    words = np.zeros(len(h) + n_docs, np.uint64)
    mine = np.ones(len(words), bool)
    mine[bounds[1:] - 1] = False
    words[mine] = np.maximum(h, 1)
    place, which = tests.search(words)
    size = tests.size[which]
    cover = np.bincount(place, minlength=len(words) + 1) - np.bincount(place + size, minlength=len(words) + 1)
    flags = (np.cumsum(cover[:-1]) > 0)[mine]
    doc = np.searchsorted(bounds, place, "right") - 1
    pairs = np.unique(doc * (len(tests.names) + 1) + tests.item[which])
    longest = {}
    if len(place):
        diagonal = place - tests.place[which]
        order = np.lexsort((place, diagonal, tests.row[which]))
        p, d, r = place[order], diagonal[order], tests.row[which][order]
        fresh = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
        head = order[fresh]
        length = np.diff(np.append(fresh, len(p))) - 1 + size[head]
        best = np.lexsort((tests.place[which][head], tests.item[which][head], place[head], -length, doc[head]))
        for i in best[np.concatenate([[True], np.diff(doc[head][best]) != 0])]:
            k = head[i]
            longest[int(doc[k])] = (int(length[i]), int(place[k] - bounds[doc[k]]), tests.names[tests.item[which[k]]], int(tests.place[which[k]]))
    return flags, pairs // (len(tests.names) + 1), pairs % (len(tests.names) + 1), longest


#: Test suffixes that are searched together.
_SLAB = 50_000


def longest_of_suffixes(h: np.ndarray, first: np.ndarray, tests: Tests):
    """(row, place, words, document, place there) of every test suffix with a match in one shard: its longest one, the first of several in the shard."""
    n_docs = len(first) - 1
    bounds = first + np.arange(n_docs + 1)
    words = np.zeros(len(h) + n_docs, np.uint64)
    mine = np.ones(len(words), bool)
    mine[bounds[1:] - 1] = False
    words[mine] = np.maximum(h, 1)
    order = suffix_array(words)
    padded = np.append(words, np.zeros(tests.window, np.uint64))
    depth = np.arange(tests.window)
    rows = np.repeat(np.arange(len(tests.lengths)), tests.lengths)
    starts = np.arange(len(rows))
    places = starts - np.repeat(np.cumsum(tests.lengths) - tests.lengths, tests.lengths)
    left = tests.lengths[rows] - places
    best, at = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64)
    for a in range(0, len(rows), _SLAB):
        part = slice(a, a + _SLAB)
        within = depth < left[part, None]
        wanted = tests.words[np.minimum(starts[part, None] + depth, len(tests.words) - 1)]
        low = Tests._bound(padded, order, wanted, within, depth, False)
        # the longest common beginning is with a neighbour of the place where the suffix would stand
        for near in (np.maximum(low - 1, 0), np.minimum(low, len(order) - 1)):
            same = (padded[order[near][:, None] + depth] == wanted) & within
            long = np.where(same.all(axis=1), tests.window, same.argmin(axis=1))
            better = (long > best[part]) | ((long == best[part]) & (long > 0) & (order[near] < at[part]))
            best[part], at[part] = np.where(better, long, best[part]), np.where(better, order[near], at[part])
    # of windows all places are known, and with them how far each goes on
    place, which = tests.search(words)
    if len(place):
        diagonal = place - tests.place[which]
        by_run = np.lexsort((place, diagonal, tests.row[which]))
        p, d, r = place[by_run], diagonal[by_run], tests.row[which][by_run]
        fresh = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1] + 1) | (d[1:] != d[:-1]) | (r[1:] != r[:-1])]))
        sizes = np.diff(np.append(fresh, len(p)))
        goes_on = np.repeat(sizes, sizes) - (np.arange(len(p)) - np.repeat(fresh, sizes)) - 1 + tests.size[which[by_run]]
        suffix = tests.start[which[by_run]]
        for i in np.lexsort((p, -goes_on, suffix)):
            if goes_on[i] > best[suffix[i]] or (goes_on[i] == best[suffix[i]] and p[i] < at[suffix[i]]):
                best[suffix[i]], at[suffix[i]] = goes_on[i], p[i]
    some = np.flatnonzero(best > 0)
    doc = np.searchsorted(bounds, at[some], "right") - 1
    return rows[some], places[some], best[some], doc, at[some] - bounds[doc]


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1, id_col: str = "doc_id", text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """item, item_at, words, doc_id, doc_at: the longest verbatim match of every test suffix with ``least`` words or more in the corpus, and where it stands.

    Each shard is searched for every suffix of every item, and the best of all
    shards is kept: of several the one with the smallest id (null last), then place.
    Suffixes without a match have no row.  A null item id counts as the empty
    string; of items with one id the best match of each place is given.
    """
    spark, names, whole = docs.sparkSession, ["item", "item_at", "words", "doc_id", "doc_at"], None
    rows = docs.select(text_of(docs, text).alias("_body"), F.col(id_col).cast("long").alias("_id"))
    for _, tests in _blocks(benchmark, item_col, item_text, block_bytes, window):
        sent = spark.sparkContext.broadcast(tests)

        def search(batches, sent=sent):
            powers, tests = Powers(), sent.value
            for batch in batches:
                for at, data, offsets in text_chunks(batch.column(0), SHARD_BYTES):
                    t, starts, ends, first = word_bounds(data, offsets, ALNUM)
                    row, place, words, doc, there = longest_of_suffixes(word_hashes(t, starts, ends, powers), first, tests)
                    good = words >= least
                    ids = batch.column(1).take(pa.array(doc[good] + at))
                    yield pa.RecordBatch.from_arrays([pa.array([tests.items[r] for r in row[good].tolist()], pa.string()), pa.array(place[good]), pa.array(words[good]), ids, pa.array(there[good])], names=names)

        found = rows.mapInArrow(search, "item string, item_at long, words long, doc_id long, doc_at long")
        whole = found if whole is None else whole.unionByName(found)
    best = F.min(F.struct((-F.col("words")).alias("less"), F.col("doc_id").isNull().alias("nameless"), "doc_id", "doc_at")).alias("b")
    return whole.groupBy("item", "item_at").agg(best).select("item", "item_at", (-F.col("b.less")).alias("words"), "b.doc_id", "b.doc_at")


def _blocks(benchmark: DataFrame, id_col: str, text: str, limit: int, window: int):
    """Items with their words, hashed in tasks, in blocks of about ``limit`` bytes of text; null texts have no words."""

    def hashed(batches):
        powers = Powers()
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(2)):
                t, starts, ends, first = word_bounds(data, offsets, ALNUM)
                h = np.maximum(word_hashes(t, starts, ends, powers), 1)
                words = [h[a:b].tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, len(words)) for c in batch.columns[:2]], pa.array(words, pa.binary())], names=["block", "item", "words"])

    item = F.coalesce(benchmark[id_col].cast("string"), F.lit(""))
    total = benchmark.agg(F.coalesce(F.sum(F.octet_length(text_of(benchmark, text)) + 16), F.lit(0))).first()[0]
    n = max(1, -(-total // limit))
    rows = benchmark.select(F.pmod(F.xxhash64(item), F.lit(n)).alias("block"), item.alias("item"), text_of(benchmark, text).alias("body")).mapInArrow(hashed, "block long, item string, words binary")
    rows = cut(rows) if n > 1 else rows
    for b in range(n):
        got = rows.filter(F.col("block") == b).toArrow()  # one block: about ``limit`` bytes
        yield n, Tests(got.column("item").to_pylist(), [np.frombuffer(w.as_buffer(), np.uint64) for w in got.column("words")], window)


_FOUND = "_n long, _runs array<struct<first:int,last:int>>, _items array<string>, _best struct<words:long,at:long,item:string,item_at:long>"


def _searched(rows: DataFrame, sent, kept: list[str]) -> DataFrame:
    """``kept`` columns of ``rows`` (which begin with _body) with what one block of the benchmark has in each text."""
    names = ["_n", "_runs", "_items", "_best"]
    runs_type = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
    best_type = pa.struct([("words", pa.int64()), ("at", pa.int64()), ("item", pa.string()), ("item_at", pa.int64())])

    def search(batches):
        powers = Powers()
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(0), SHARD_BYTES):
                t, starts, ends, first = word_bounds(data, offsets, ALNUM)
                h = word_hashes(t, starts, ends, powers)
                flags, docs, items, longest = find(h, first, sent.value)
                n = len(offsets) - 1
                found: dict[int, list] = {d: [] for d in longest}
                for d, i in zip(docs.tolist(), items.tolist(), strict=True):
                    found[d].append(sent.value.names[i])
                runs, best, mine = [[] for _ in range(n)], [None] * n, [[] for _ in range(n)]
                for d in longest:
                    edge = np.diff(np.concatenate([[0], flags[first[d] : first[d + 1]].astype(np.int8), [0]]))
                    runs[d] = [{"first": a, "last": b} for a, b in zip(np.flatnonzero(edge == 1).tolist(), np.flatnonzero(edge == -1).tolist(), strict=True)]
                    best[d], mine[d] = dict(zip(("words", "at", "item", "item_at"), longest[d], strict=True)), found[d]
                made = [pa.array(np.diff(first)), pa.array(runs, runs_type), pa.array(mine, pa.list_(pa.string())), pa.array(best, best_type)]
                yield pa.RecordBatch.from_arrays([*[c.slice(at, n) for c in batch.columns[1:]], *made], names=[*kept, *names])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema[1:]]
    return rows.mapInArrow(search, ", ".join([*fields, _FOUND]))


def judge(docs: DataFrame, benchmark: DataFrame, keep: list[str], text: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``keep`` columns of every row of ``docs`` with n_words, n_hit, n_items, items_sha256, contaminated and the longest match.

    The longest verbatim match of a window or more: ``longest_hit`` words from
    word ``longest_at`` of the document, ``longest_item_at`` of the item
    ``longest_item`` (the earliest of several in the document, then of the
    smallest item); null where no window occurs.  Result columns replace kept
    ones of the same name.  A null or wordless text has no words and is never
    contaminated.  A null item id counts as the empty string; equal item ids
    are one item; repeated rows are judged each.  An empty benchmark hits nothing.

    A benchmark beyond ``block_bytes`` takes one pass over ``docs`` for each block.
    """
    names = ["n_words", "n_hit", "n_items", "items_sha256", "contaminated", "longest_hit", "longest_at", "longest_item", "longest_item_at"]
    keep = [c for c in keep if c not in names]
    spark, found, others = docs.sparkSession, None, []
    columns = [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or "variant" in kind else F.col(f"`{c}`") for c, kind in docs.dtypes]
    rows = docs.select(text_of(docs, text).alias("_body"), *[F.col(f"`{c}`") for c in keep])
    keyed = docs.select(text_of(docs, text).alias("_body"), *[F.col(f"`{c}`") for c in keep], F.xxhash64(*columns).alias("_h1"), F.xxhash64(F.lit("second"), *columns).alias("_h2"))
    for n, tests in _blocks(benchmark, item_col, item_text, block_bytes, window):
        sent = spark.sparkContext.broadcast(tests)
        if found is None:
            found = _searched(rows if n == 1 else keyed, sent, keep if n == 1 else [*keep, "_h1", "_h2"])
            continue
        hits = _searched(keyed.select("_body", "_h1", "_h2"), sent, ["_h1", "_h2"]).filter(F.size("_items") > 0)
        others.append(cut(hits.dropDuplicates(["_h1", "_h2"])))  # equal rows have equal hits
        sent.destroy()
    if others:
        more = others[0]
        for o in others[1:]:
            more = more.unionByName(o)
        merged = more.groupBy("_h1", "_h2").agg(F.flatten(F.collect_list("_runs")).alias("_r"), F.flatten(F.collect_list("_items")).alias("_i"), F.collect_list("_best").alias("_b"))
        joined = found.join(merged, ["_h1", "_h2"], "left")
        none = lambda c, like: F.coalesce(c, F.array().cast(like))
        runs, items = F.concat("_runs", none(F.col("_r"), "array<struct<first:int,last:int>>")), F.concat("_items", none(F.col("_i"), "array<string>"))
        best = F.array_compact(F.concat(F.array("_best"), none(F.col("_b"), "array<struct<words:long,at:long,item:string,item_at:long>>")))
        first = F.try_element_at(F.array_sort(F.transform(best, lambda b: F.struct((-b["words"]).alias("w"), b["at"].alias("at"), b["item"].alias("item"), b["item_at"].alias("item_at")))), F.lit(1))
        found = joined.select(*[F.col(f"`{c}`") for c in keep], "_n", runs.alias("_runs"), items.alias("_items"), F.when(first.isNotNull(), F.struct((-first["w"]).alias("words"), first["at"].alias("at"), first["item"].alias("item"), first["item_at"].alias("item_at"))).alias("_best"))
    # words under the union of all runs
    seed = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    step = lambda acc, r: F.struct((acc["n"] + F.greatest(F.lit(0), r["last"] - F.greatest(acc["to"], r["first"]))).alias("n"), F.greatest(acc["to"], r["last"]).alias("to"))
    hit = F.aggregate(F.array_sort("_runs"), seed, step, lambda acc: acc["n"].cast("long"))
    counted = found.withColumns({"_hit": hit, "_items": F.array_sort(F.array_distinct("_items"))})
    return counted.select(
        *[F.col(f"`{c}`") for c in keep], F.col("_n").alias("n_words"), F.col("_hit").alias("n_hit"), F.size("_items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "_items"), 256).alias("items_sha256"),
        ((F.col("_hit") > 0) & (20 * F.col("_hit") >= F.col("_n"))).alias("contaminated"),
        *[F.col(f"_best.{c}").alias(name) for c, name in (("words", "longest_hit"), ("at", "longest_at"), ("item", "longest_item"), ("item_at", "longest_item_at"))],
    )


def remove(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` without contaminated rows, its columns unchanged."""
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*inner.values())
    judged = judge(renamed, benchmark, list(inner.values()), inner[text])
    return judged.filter(~F.col("contaminated")).select(*[F.col(v).alias(k) for k, v in inner.items()])


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the registered query: all windows as text, and runs of them on one diagonal."""
    words = lambda table: f"regexp_extract_all(translate(coalesce({table}.text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""WITH d AS (SELECT doc_id, {words('documents')} AS w FROM documents),
      b AS (SELECT row_number() OVER () AS brow, coalesce(item_id::VARCHAR, '') AS item, {words('benchmark')} AS w FROM benchmark),
      bw AS (SELECT brow, item, i - 1 AS p, least(len(w), {window}) AS size, array_to_string(w[i : i + least(len(w), {window}) - 1], ' ') AS win
        FROM (SELECT brow, item, w, unnest(range(1, len(w) - least(len(w), {window}) + 2)) AS i FROM b WHERE len(w) > 0)),
      sizes AS (SELECT DISTINCT size FROM bw),
      dw AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS win FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM d, sizes WHERE len(w) >= size)),
      hits AS (SELECT doc_id, i, dw.size, item, brow, p FROM dw JOIN bw ON dw.win = bw.win AND dw.size = bw.size),
      covered AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS q FROM (SELECT DISTINCT doc_id, i, size FROM hits)) GROUP BY doc_id),
      its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id),
      runs AS (SELECT doc_id, item, min(i) - 1 AS place, min(p) AS item_place, count(*) + min(size) - 1 AS words FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, brow, i - p ORDER BY i) AS island FROM hits) GROUP BY doc_id, item, brow, i - p, island),
      best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY words DESC, place, item, item_place) AS r FROM runs) WHERE r = 1)
      SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
        coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
        words::BIGINT AS longest_hit, place::BIGINT AS longest_at, best.item AS longest_item, item_place::BIGINT AS longest_item_at
      FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN its USING (doc_id) LEFT JOIN best USING (doc_id)"""

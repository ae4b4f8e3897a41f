"""Substring dedup by FM-indexes over shards of repeated text.

Every window of words belongs to the shard of its smallest word m-gram (its
minimiser), so equal windows meet in one shard and a document's consecutive
windows mostly go together as one segment.  Segments are dealt by ranges of
(minimiser, text), so a minimiser of any number of places spreads over as many
tasks as it needs; those whose minimiser stands nowhere else can hold no
repeated window and are left where they are.  For the others a task builds a
compressed FM-index over a run of segments (the BWT in a wavelet matrix of
packed bits, every ``SAMPLE``-th place of the suffix array) and streams the
segments through backward search: for every place the longest text, up to a
window, that ends there and stands elsewhere, too.  Where that matching
statistic reaches a window, the places of its interval are located by LF steps;
windows with an earlier place make up the reported intervals.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of
from .words import SPACED, Powers, grams, mix, suffix_array, text_chunks, word_bounds, word_hashes

#: Words of a window and of a minimiser; words of an index and the places of which it keeps one; segments of one minimiser beyond which windows are dealt one by one.
WINDOW, MINIMISER, INDEX_WORDS, SAMPLE, HOT = 20, 8, 150_000, 8, 2000


def segments_of(h: np.ndarray, first: np.ndarray, window: int = WINDOW, m: int = MINIMISER):
    """(minimiser, document, start, windows, whether its minimiser stands in it more than once) of runs of windows with one minimiser."""
    reach = window - m + 1
    g = grams(h, m)
    if len(h) < window:
        return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool)]
    low, width = g, 1
    while width * 2 <= reach:
        low = np.minimum(low[: len(low) - width], low[width:])
        width *= 2
    low = np.minimum(low[: len(g) - reach + 1], low[reach - width : len(g) - width + 1])  # the smallest m-gram of the window at each word
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.flatnonzero(doc[: len(low)] == doc[window - 1 :][: len(low)])  # windows within one document
    if not len(at):
        return [np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64, bool)]
    v, d = low[at], doc[at]
    begin = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
    end = np.append(begin[1:], len(at))
    value, head, tail = v[begin], at[begin], at[end - 1]
    steps = np.arange(reach)
    one = (g[head[:, None] + steps] == value[:, None]).argmax(axis=1) + head
    last = tail + reach - 1 - (g[tail[:, None] + steps[::-1]] == value[:, None]).argmax(axis=1)
    return value, d[begin], head - first[d[begin]], end - begin, one != last


class WaveletMatrix:
    """rank of any symbol in a sequence, level by level over packed bits with counts by block."""

    def __init__(self, symbols: np.ndarray, n_symbols: int):
        self.levels, self.n = max(1, int(n_symbols - 1).bit_length()), len(symbols)
        self.words, self.blocks, self.zeros = [], [], []
        s = symbols
        for level in reversed(range(self.levels)):
            bits = (s >> level) & 1
            packed = np.zeros((self.n // 64 + 1) * 8, np.uint8)
            tight = np.packbits(bits.astype(np.uint8), bitorder="little")
            packed[: len(tight)] = tight
            words = packed.view(np.uint64)
            self.words.append(words)
            self.blocks.append(np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)]))
            self.zeros.append(int(self.n - bits.sum()))
            s = np.concatenate([s[bits == 0], s[bits == 1]])
        self.begin = self._follow(np.arange(n_symbols), np.zeros(n_symbols, np.int64))

    def _follow(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, level in enumerate(reversed(range(self.levels))):
            word = at >> 6
            mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.blocks[k][word] + np.bitwise_count(self.words[k][word] & mask)
            at = np.where((symbol >> level) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol stands before each place."""
        return self._follow(symbol, at) - self.begin[symbol]

    def access(self, at: np.ndarray):
        """(symbol at each place, how often it stands before)."""
        symbol = np.zeros(len(at), np.int64)
        for k, level in enumerate(reversed(range(self.levels))):
            word, low = at >> 6, (at & 63).astype(np.uint64)
            mine = self.words[k][word]
            bit = ((mine >> low) & np.uint64(1)).astype(np.int64)
            ones = self.blocks[k][word] + np.bitwise_count(mine & ((np.uint64(1) << low) - np.uint64(1)))
            at = np.where(bit, self.zeros[k] + ones, at - ones)
            symbol |= bit << level
        return symbol, at - self.begin[symbol]


class FMIndex:
    """Backward search over a text of symbols; 0 separates its parts.  Of the suffix array only every ``SAMPLE``-th place of the text is kept."""

    def __init__(self, text: np.ndarray, n_symbols: int):
        text = np.append(text + 1, 0)  # an end like nothing else, so that LF steps hold in every row
        order = suffix_array(text)
        self.bwt = WaveletMatrix(text[order - 1], n_symbols + 1)
        self.less = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=n_symbols + 1))])
        kept = order % SAMPLE == 0
        self.samples = (order[kept] // SAMPLE).astype(np.int32)
        self.kept = WaveletMatrix(kept.astype(np.int64), 2)  # one level: a vector of bits with counts

    def matching(self, text: np.ndarray, starts: np.ndarray, length: int):
        """(low, high, matched) for the windows text[s : s + length]: the longest part before a window's end, up to all of it, that stands twice or more, and its interval."""
        low, high, matched = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        live = np.arange(len(starts))
        c = text[starts + length - 1] + 1
        lo, hi = self.less[c], self.less[c + 1]
        for j in range(length - 1, -1, -1):
            several = hi - lo > 1
            live, lo, hi = live[several], lo[several], hi[several]
            low[live], high[live], matched[live] = lo, hi, length - j
            if not len(live) or not j:
                break
            c = text[starts[live] + j - 1] + 1
            lo, hi = self.less[c] + self.bwt.rank(c, lo), self.less[c] + self.bwt.rank(c, hi)
        return low, high, matched

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """The text's places of rows of the suffix array: back by LF steps to the next place that is kept."""
        out = np.empty(len(rows), np.int64)
        live, step = np.arange(len(rows)), 0
        while len(live):
            kept, before = self.kept.access(rows)
            done = kept == 1
            out[live[done]] = self.samples[before[done]].astype(np.int64) * SAMPLE + step
            live, rows = live[~done], rows[~done]
            symbol, rank = self.bwt.access(rows)
            rows, step = self.less[symbol] + rank, step + 1
        return out


def repeated(parts: list[tuple[bytes, int, int]], window: int = WINDOW) -> list[np.ndarray]:
    """For each segment (words, document rank, start): flags of its windows that stand earlier in these segments."""
    ids: dict[bytes, int] = {}
    lists = [[ids.setdefault(w, len(ids) + 1) for w in body.split(b" ")] for body, _, _ in parts]
    sizes = np.array([len(x) for x in lists])
    text = np.zeros(int(sizes.sum()) + len(lists), np.int64)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    offset = np.arange(len(text)) - np.repeat(begin, sizes + 1)
    text[offset < np.repeat(sizes, sizes + 1)] = np.fromiter((i for x in lists for i in x), np.int64, int(sizes.sum()))
    docs, starts = np.array([d for _, d, _ in parts]), np.array([s for _, _, s in parts])
    place = (np.repeat(docs, sizes + 1) << 32) + np.repeat(starts, sizes + 1) + offset
    at = np.flatnonzero(offset <= np.repeat(sizes - window, sizes + 1))
    index = FMIndex(text, len(ids) + 1)
    low, high, matched = index.matching(text, at, window)
    flags = np.zeros(len(at), bool)
    some = np.flatnonzero(matched == window)
    if len(some):
        # windows of one length have intervals that are equal or apart
        lows, one, which = np.unique(low[some], return_index=True, return_inverse=True)
        counts = high[some[one]] - lows
        begin = np.cumsum(counts) - counts
        rows = np.arange(counts.sum()) - np.repeat(begin - lows, counts)
        earliest = np.minimum.reduceat(place[index.locate(rows)], begin)
        flags[some] = place[at[some]] > earliest[which]
    counts = sizes - window + 1
    return np.split(flags, np.cumsum(counts)[:-1])


def _runs(flags: np.ndarray, start: int, window: int):
    edge = np.diff(np.concatenate([[0], flags.astype(np.int8), [0]]))
    return [(start + int(a), start + int(b) - 1 + window) for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]


def _shared(batches):
    """The segments whose minimiser may stand elsewhere, from segments in order of (m, _h, start, _id): of equal texts only the first, and no minimiser with one place.

    What lies at the edge of a task's range may go on in the next and is always
    passed on.  Rows of n = 0 have the places of minimisers that are at an edge
    or have very many.
    """
    names = ["m", "_id", "_h", "start", "n", "places"]
    last = (None,) * 3  # of the row before: minimiser, text, start
    run, places, first_run, waiting = None, 0, True, None

    def rows_of(cols, m, places):
        out = [np.concatenate([c, np.asarray(x, c.dtype)]) for c, x in zip(cols, (m, np.zeros(len(m)), np.zeros(len(m)), np.zeros(len(m)), np.zeros(len(m))), strict=True)]
        return pa.RecordBatch.from_arrays([*map(pa.array, out), pa.array(np.concatenate([np.zeros(len(cols[0]), np.int64), np.asarray(places, np.int64)]))], names=names)

    for batch in batches:
        m, ids, h, start, n, twice = (c.to_numpy() for c in batch.columns)
        if not len(m):
            continue
        same = (m[1:] == m[:-1]) & (h[1:] == h[:-1]) & (start[1:] == start[:-1])
        fresh = np.concatenate([[(m[0], h[0], start[0]) != last], ~same])
        last = (m[-1], h[-1], start[-1])
        cols = [x[fresh] for x in (m, ids, h, start, n)]
        weight = twice[fresh].astype(np.int64) + 1
        if waiting is not None:  # the one place of the last run so far
            cols, weight = [np.concatenate(x) for x in zip(waiting, cols, strict=True)], np.append(1, weight)
            places, waiting = 0, None
        if not len(weight):
            continue
        heads = np.flatnonzero(np.concatenate([[True], cols[0][1:] != cols[0][:-1]]))
        total, values = np.add.reduceat(weight, heads), cols[0][heads]
        edge = np.zeros(len(heads), bool)
        told, tell = [], []
        if run == values[0]:
            total[0] += places
            edge[0] = first_run
        elif run is not None:
            if first_run or places > HOT:
                told, tell = [run], [places]
        else:
            edge[0] = True
        ended = np.flatnonzero((edge | (total > HOT))[:-1])
        told, tell = np.concatenate([told, values[ended]]), np.concatenate([tell, total[ended]])
        first_run = (run is None or (first_run and run == values[0])) and len(values) == 1
        run, places = values[-1], int(total[-1])
        good = np.repeat((total > 1) | edge, np.diff(np.append(heads, len(weight))))
        if places == 1 and not first_run:
            waiting = [c[-1:] for c in cols]
        yield rows_of([c[good] for c in cols], told.astype(np.int64), tell)
    if run is not None:
        yield rows_of(waiting if waiting is not None else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32)], np.array([run]), [places])


def repeated_intervals(docs: DataFrame, window: int = WINDOW, m: int = MINIMISER) -> DataFrame:
    """_id, _h, first, last (word numbers, end exclusive): runs of words of repeated windows.

    ``docs`` holds _id (no null), _h (hash of the text) and _body.  Of documents with equal texts only the one with the smallest id is looked at.
    """

    def cut_up(batches):
        powers = Powers()
        for batch in batches:
            ids, hashes = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for at, data, offsets in text_chunks(batch.column(2)):
                t, starts, ends, first = word_bounds(data, offsets, SPACED)
                value, d, start, n, twice = segments_of(word_hashes(t, starts, ends, powers), first, window, m)
                cols = [value.view(np.int64), ids[at + d], hashes[at + d], start.astype(np.int32), n.astype(np.int32), twice.astype(np.int32)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["m", "_id", "_h", "start", "n", "twice"])

    rows = docs.select("_id", "_h", "_body").mapInArrow(cut_up, "m long, _id long, _h long, start int, n int, twice int")
    order = ["m", "_h", "start", "_id"]
    shared = cut(rows.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_shared, "m long, _id long, _h long, start int, n int, places long"))
    # Minimisers of very many places, the same in all tasks.
    hot = cut(shared.filter("n = 0").groupBy("m").agg(F.sum("places").alias("places")).filter(F.col("places") > HOT).select("m", F.lit(True).alias("hot")))
    segments = shared.filter("n > 0").drop("places")
    segments = segments.withColumn("hot", F.lit(False)) if hot.isEmpty() else segments.join(hot, "m", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    by_doc = segments.groupBy("_id", "_h").agg(F.collect_list(F.struct("m", "start", "n", "hot")).alias("segments"))

    def combined(found):
        """Of equal segments that are read together only the first goes on whole; the others are repeated, and only their places go on."""
        earliest: dict[tuple, tuple] = {}
        for key, content, i, _, start in found:
            at = (key, content)
            if at not in earliest or (i, start) < earliest[at]:
                earliest[at] = (i, start)
        for key, content, i, h, start in found:
            n = content.count(b" ") + 1
            yield (key, content, i, h, start, n) if earliest[key, content] == (i, start) else (i ^ h, b"", i, h, start, n)

    def fetch(batches):
        powers = Powers()
        names = ["key", "content", "_id", "_h", "start", "words"]
        for batch in batches:
            lists = batch.column(3)
            of = lists.offsets.to_numpy()
            flat = lists.values
            m_, start_, n_, hot_ = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(4))
            ids, hashes = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for at, data, offsets in text_chunks(batch.column(2)):
                t, starts, ends, first = word_bounds(data, offsets, SPACED)
                body, out = data.tobytes(), []
                h = None
                for d in range(len(offsets) - 1):
                    for i in range(of[at + d], of[at + d + 1]):
                        a, n = int(first[d] + start_[i]), int(n_[i])
                        if not hot_[i]:
                            out.append((int(m_[i]), b" ".join(body[starts[a] : ends[a + n + window - 2]].split()), ids[at + d], hashes[at + d], int(start_[i])))
                            continue
                        # a minimiser of very many places: its windows are dealt by all of their words
                        h = word_hashes(t, starts, ends, powers) if h is None else h
                        whole = mix(grams(h[a : a + n + window - 1], window)).view(np.int64)
                        out += [(int(whole[j]), b" ".join(body[starts[a + j] : ends[a + j + window - 1]].split()), ids[at + d], hashes[at + d], int(start_[i]) + j) for j in range(n)]
                if out:
                    types = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, ty) for c, ty in zip(zip(*combined(out), strict=True), types, strict=True)], names=names)

    texts = docs.select("_id", "_h", "_body").join(by_doc, ["_id", "_h"])
    contents = texts.mapInArrow(fetch, "key long, content binary, _id long, _h long, start int, words int")

    def search(batches):
        names = ["_id", "_h", "first", "last"]
        held, words, key_before, content_before = [], 0, None, None

        def report(rows):
            types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)

        def drain():
            ranks = {d: i for i, d in enumerate(sorted({x[1] for x in held}))}
            flags = repeated([(body, ranks[i], s) for body, i, _, s in held], window)
            return [(i, h, a, b) for (_, i, h, s), f in zip(held, flags, strict=True) if f.any() for a, b in _runs(f, s, window)]

        for batch in batches:
            out = []
            for key, content, i, h, start, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if not content:
                    out.append((i, h, start, start + n))
                    continue
                if key == key_before and content == content_before:
                    # sorted: an equal segment came before this one, from an earlier place unless it is the very same
                    if (i, start) != first_place:
                        out.append((i, h, start, start + n))
                        continue
                if key != key_before and words > INDEX_WORDS:
                    out += drain()
                    held, words = [], 0
                if key != key_before or content != content_before:
                    first_place = (i, start)
                key_before, content_before = key, content
                held.append((content, i, h, start))
                words += n + 1
            if out:
                yield report(out)
        if held and (out := drain()):
            yield report(out)

    return contents.repartition("key").sortWithinPartitions("key", "content", "_id", "start").mapInArrow(search, "_id long, _h long, first int, last int")


def dedup(docs: DataFrame, id_col: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every row: words covered by a window that also starts earlier are removed.

    A null text has no words; a null id stands before all others, at one place
    with the smallest id that there can be.  Rows with one id and one text are
    at one place, so neither removes the other's words.
    """
    lowest = F.lit(-(2**63)).cast("long")
    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), lowest).alias("_id"), F.xxhash64(text_of(docs, text)).alias("_h"), text_of(docs, text).alias("_body"), docs[id_col].isNull().alias("_nameless"))
    runs = repeated_intervals(rows, window).groupBy("_id", "_h").agg(F.collect_list(F.struct("first", "last")).alias("runs"))
    # Copies of a text: all but the smallest id's.  Their group may be huge, so its rows go to many tasks.
    salts = 16
    narrow = rows.select("_id", "_h", F.xxhash64(F.lit(1), "_body").alias("_h2"))
    groups = narrow.groupBy("_h", "_h2").agg(F.min("_id").alias("_first"), F.max("_id").alias("_last")).filter("_last > _first")
    spread = groups.select("_h", "_h2", "_first", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = narrow.withColumn("salt", F.pmod(F.xxhash64("_id"), F.lit(salts)).cast("int"))
    copies = salted.join(spread, ["_h", "_h2", "salt"]).filter("_id > _first").select("_id", "_h").distinct().withColumn("copy", F.lit(True))
    marked = rows.join(runs, ["_id", "_h"], "left").join(copies, ["_id", "_h"], "left").select("_id", "_body", "runs", F.coalesce("copy", F.lit(False)).alias("copy"), "_nameless")

    def keep(batches):
        for batch in batches:
            runs_ = batch.column(2)
            valid, of = runs_.is_valid().to_pylist(), runs_.offsets.to_numpy()
            a_, b_ = (runs_.values.field(i).to_numpy() for i in range(2)) if len(runs_.values) else (np.zeros(0, int),) * 2
            out = []
            for r, (i, body, copy) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1), batch.column(3).to_pylist(), strict=True)):
                words = body.as_py().encode().split()
                n = len(words)
                if copy and n >= window:
                    words = []
                elif valid[r]:
                    gone = np.zeros(n + 1, np.int32)
                    np.add.at(gone, a_[of[r] : of[r + 1]], 1)
                    np.add.at(gone, b_[of[r] : of[r + 1]], -1)
                    stays = np.cumsum(gone[:n]) == 0
                    words = [w for w, s in zip(words, stays.tolist(), strict=True) if s]
                out.append((i, n, n - len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            types = [pa.int64(), pa.int64(), pa.int64(), pa.string()]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["_id", "n_words", "n_removed", "kept_sha256"]).append_column("_nameless", batch.column(4))

    done = marked.mapInArrow(keep, "_id long, n_words long, n_removed long, kept_sha256 string, _nameless boolean")
    return done.select(F.when(~F.col("_nameless"), F.col("_id")).alias(id_col), "n_words", "n_removed", "kept_sha256")


def oracle(window: int = WINDOW) -> str:
    """DuckDB SQL for the registered query: every window as text, its first place, the words it covers."""
    return rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
      win AS (SELECT doc_id, i, array_to_string(w[i : i + {window - 1}], ' ') AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - {window} + 2)) AS i FROM d WHERE len(w) >= {window})),
      later AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY t ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
      gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + {window})) AS p FROM later),
      lists AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
      kept AS (SELECT d.doc_id, string_agg(word, ' ' ORDER BY p) AS body FROM (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d) AS d LEFT JOIN gone USING (doc_id, p) WHERE gone.p IS NULL GROUP BY d.doc_id)
      SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(body, '')) AS kept_sha256 FROM d LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""

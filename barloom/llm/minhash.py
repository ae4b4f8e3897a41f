"""Near-dedup by Order MinHash over occurrence-labelled word shingles, verified by banded alignment of words.

A sketch takes the few smallest of a text's labelled shingles under one hash
function and joins them in text order, so it agrees where the same shingles
stand in the same order, which is what texts at a small edit distance share.
Texts that share a sketch meet in a bucket.  Pairs are aligned word by word:
``matched / (all words - matched)`` of 0.8 or more is a link, which every pair
with that similarity of five-word shingles has, too.  Classes are the connected
components of all links.

Rows of buckets are dealt by ranges of (bucket, words, text), so a bucket of any
size spreads over as many tasks as it needs, and a task goes through them in
this order.  A text is compared with the first of its bucket of no less than
0.8 of its length and with the ``BACK`` texts before it, from the ``BACK`` + 3rd
of a bucket on with one: pairs grow as the rows.  In a bucket of up to ``BACK``
+ 2 texts these are all pairs.  Where a larger one is still in several
components, whatever its sketch, all of its
texts go through an exact join: aligned texts of that similarity have as many
of their words in common, so they share one of the rarest fifth of them, early
enough in both for the rest to suffice.  No pair of these texts that alignment
would link is left out, however large the bucket.

Texts are nodes by 128 bits of their words, links by the first 64 of these; ids
only name what is found.
"""

from __future__ import annotations

import bisect
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, rewritten, text_of
from .words import ALNUM, Powers, grams, mix, text_chunks, word_bounds, word_hashes

#: Words of a shingle, least similarity, sketches, shingles of a sketch.
SHINGLE, SIMILAR, SKETCHES, ORDER = 5, 0.8, 24, 2
#: Texts before it that one of the first texts of a bucket is compared with; later ones have the exact join.
BACK = 3
#: Words of two texts up to which they are aligned in one piece; beyond, common shingles anchor pieces, and only what fails then is aligned as a whole.
WHOLE = 8192
#: Slots of the table that tells which words may stand in several components, and orders them by rarity.
SLOTS, SLOT_BLOCK = 1 << 22, 1 << 14
#: Longs of parities by which texts are told apart before they are aligned.
PARITIES = 8
_BIG = np.uint64(2**64 - 1)
_MIXER = np.uint64(0xD1342543DE82EF95)


def shingles(h: np.ndarray, first: np.ndarray, k: int = SHINGLE):
    """(labelled shingles of all texts in text order, first of each text and the end).  A text of fewer than k words, but some, is one shingle."""
    n_words = np.diff(first)
    counts = np.where(n_words >= k, n_words - k + 1, np.minimum(n_words, 1))
    bounds = np.concatenate([[0], np.cumsum(counts)])
    doc = np.repeat(np.arange(len(counts)), counts)
    at = np.arange(len(doc)) - bounds[doc] + first[doc]
    out = np.zeros(len(doc), np.uint64)
    long = n_words[doc] >= k
    g = grams(h, k)
    out[long] = g[at[long]]
    for i in np.flatnonzero(~long):
        words = h[first[doc[i]] : first[doc[i] + 1]]
        out[i] = grams(words, len(words))[0] ^ np.uint64(len(words))
    # the label counts a shingle's earlier places in its text
    key = mix(out + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(key, kind="stable")
    same = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    if same.any():
        run = np.arange(len(order)) - np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
        out[order] += run.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    return mix(out), bounds


def sketch(labelled: np.ndarray, bounds: np.ndarray, sketches: int = SKETCHES, order: int = ORDER) -> np.ndarray:
    """Order MinHash of each text (rows of ``sketches`` numbers); texts without shingles must not be among them."""
    start, counts = bounds[:-1], np.diff(bounds)
    place = np.arange(len(labelled))
    out = np.empty((len(counts), sketches), np.uint64)
    padded = np.append(labelled, np.uint64(0))
    for s in range(sketches):
        x = mix(labelled ^ np.uint64((s + 1) * 0x9E3779B97F4A7C15 & (2**64 - 1)))
        chosen = []
        for _ in range(order):
            least = np.minimum.reduceat(x, start)
            spot = np.minimum.reduceat(np.where(x == np.repeat(least, counts), place, len(labelled)), start)
            spot = np.where(least == _BIG, len(labelled), spot)
            chosen.append(spot)
            x[spot[spot < len(labelled)]] = _BIG
        made = np.full(len(counts), s + 1, np.uint64)
        for spot in np.sort(np.array(chosen), axis=0):
            made = mix(made * _MIXER + padded[spot])
        out[:, s] = made
    return out


def common_words(a: list, b: list) -> int:
    """The longest common subsequence, by one addition of a whole row of bits for each word of ``a``."""
    places: dict = {}
    for j, w in enumerate(b):
        places[w] = places.get(w, 0) | 1 << j
    full = (1 << len(b)) - 1
    row = full
    for w in a:
        if hit := row & places.get(w, 0):
            row = ((row + hit) | (row - hit)) & full
    return len(b) - row.bit_count()


def _aligned(a: np.ndarray, b: np.ndarray) -> int:
    """Matched words of two texts; what they begin and end with alike is matched first."""
    n = min(len(a), len(b))
    apart = np.flatnonzero(a[:n] != b[:n])
    head = int(apart[0]) if len(apart) else n
    n -= head
    apart = np.flatnonzero(a[len(a) - n :][::-1] != b[len(b) - n :][::-1])
    tail = int(apart[0]) if len(apart) else n
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    return head + tail + (common_words(a.tolist(), b.tolist()) if len(a) and len(b) else 0)


def _anchors(a: np.ndarray, b: np.ndarray, band: float) -> list[tuple[int, int]]:
    """The longest chain, within the band, of labelled shingles that two long texts share, as places of their first words."""
    x, y = (shingles(t.astype(np.uint64), np.array([0, len(t)]))[0] for t in (a, b))
    _, at_a, at_b = np.intersect1d(x, y, return_indices=True)
    inside = np.abs(at_a - at_b) <= band
    order = np.argsort(at_a[inside])
    at_a, path = at_a[inside][order], at_b[inside][order].tolist()
    tails: list[int] = []
    ends: list[int] = []
    before = [-1] * len(path)
    for i, p in enumerate(path):
        j = bisect.bisect_left(tails, p)
        if j:
            before[i] = ends[j - 1]
        if j == len(tails):
            tails.append(p)
            ends.append(i)
        else:
            tails[j], ends[j] = p, i
    chain, i = [], ends[-1] if ends else -1
    while i >= 0:
        chain.append((int(at_a[i]), path[i]))
        i = before[i]
    return chain[::-1]


def alignment(a: np.ndarray, b: np.ndarray, least: float = SIMILAR) -> float:
    """matched / (all words - matched) of two texts' words; 0 if it can't reach ``least``.

    The band is what ``least`` leaves: unmatched words are at most
    ``(1 - least) / (1 + least)`` of both texts, and no match lies further off
    the diagonal.  Long texts are aligned between anchors, piece by piece, which
    may miss matches; those that fall short are aligned as a whole.
    """
    both = len(a) + len(b)
    need = least * both / (1 + least) - 1e-9
    if min(len(a), len(b)) < need:
        return 0.0
    # no alignment matches more words than stand in both
    values, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    if np.minimum(np.bincount(at[: len(a)], minlength=len(values)), np.bincount(at[len(a) :], minlength=len(values))).sum() < need:
        return 0.0
    if max(len(a), len(b)) <= WHOLE:
        matched = _aligned(a, b)
    else:
        matched, i, j = 0, 0, 0
        for x, y in [*_anchors(a, b, both - 2 * need), (len(a), len(b))]:
            step = max(i - x, j - y, 0)  # words of the shingle that are matched already
            if step >= SHINGLE:
                continue
            x, y = x + step, y + step
            if x - i <= WHOLE and y - j <= WHOLE:
                matched += _aligned(a[i:x], b[j:y])
            i, j = x, y
            while i < len(a) and j < len(b) and a[i] == b[j]:
                matched, i, j = matched + 1, i + 1, j + 1
        if matched < need:
            matched = _aligned(a, b)
    return matched / (both - matched) if matched >= need else 0.0


def _content(h: np.ndarray, first: np.ndarray, powers: Powers, salt: int) -> np.ndarray:
    up, down = powers.get(len(h) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(h + np.uint64(salt)) * up[: len(h)])])
    return mix((sums[first[1:]] - sums[first[:-1]]) * down[first[:-1]] + np.diff(first).astype(np.uint64))


def _signed(rows: DataFrame, sketches: int) -> DataFrame:
    """``rows`` (_id, h1, h2, _body) with k1, k2 (the words; of a text without any, its row), n (words), seq (32 bits a word) and sketches in place of the text."""
    names = ["_id", "h1", "h2", "k1", "k2", "n", "seq", *[f"s{i}" for i in range(sketches)]]

    def sign(batches):
        powers = Powers()
        for batch in batches:
            for at, data, offsets in text_chunks(batch.column(3)):
                t, starts, ends, first = word_bounds(data, offsets, ALNUM)
                h = word_hashes(t, starts, ends, powers)
                labelled, bounds = shingles(h, first)
                some = np.flatnonzero(np.diff(bounds))
                s = np.zeros((len(bounds) - 1, sketches), np.uint64)
                if len(some):
                    s[some] = sketch(labelled, np.append(bounds[some], len(labelled)), sketches)
                own, n = [c.slice(at, len(s)) for c in batch.columns[:3]], np.diff(first)
                keys = [np.where(n > 0, _content(h, first, powers, salt).view(np.int64), own[salt].to_numpy()) for salt in (1, 2)]
                short = (h >> np.uint64(32)).astype("<u4").tobytes()
                seq = pa.Array.from_buffers(pa.binary(), len(s), [None, pa.py_buffer((first * 4).astype(np.int32)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([*own, *map(pa.array, keys), pa.array(n), seq, *[pa.array(np.ascontiguousarray(s[:, i]).view(np.int64)) for i in range(sketches)]], names=names)

    return rows.mapInArrow(sign, ", ".join(f"{x} {'binary' if x == 'seq' else 'long'}" for x in names))


#: What ``_meet`` reports: a pair to be aligned, a text at the edge of a task's range, a text of a bucket with more than ``BACK`` + 2 texts, up to which all pairs are compared.
PAIR, EDGE, MANY = 0, 1, 2


def _meet(dealt: DataFrame, edges: bool) -> DataFrame:
    """what, bucket, a, b, n from rows (bucket, node, n) in order of (bucket, n, node).

    Each text meets the leader, the first of its bucket of no less than
    ``SIMILAR`` of its length, and the ``BACK`` texts before it, from the
    ``BACK`` + 3rd on the one before it.  This drops no link: ``MANY`` tells of
    every text of such a bucket, and ``judged`` joins them exactly where they
    aren't of one component.  A task knows only its own range, so with ``edges``
    it reports the leader and the outer texts of its first and last bucket,
    which meet once more.
    """
    names, few = ["what", "bucket", "a", "b", "n"], BACK + 2

    def report(*parts):
        cols = [np.concatenate(c) for c in zip(*[(np.full(len(p[0]), what, np.int32), *p) for what, p in parts], strict=True)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=names)

    def meet(batches):
        held = None  # bucket, node, n, leader's place, place in its bucket: of the last bucket's leader and last texts
        first_bucket = None
        for batch in batches:
            bucket, node, n = (c.to_numpy() for c in batch.columns)
            if not len(bucket):
                continue
            old = 0
            if held is not None:
                old = len(held[0])
                bucket, node, n = (np.concatenate([x, y]) for x, y in zip(held[:3], (bucket, node, n), strict=True))
            size = len(bucket)
            at = np.arange(size)
            fresh = np.concatenate([[True], bucket[1:] != bucket[:-1]])
            start = np.maximum.accumulate(np.where(fresh, at, 0))
            leader = start.copy()
            # a bucket of many lengths has further leaders
            heads = np.flatnonzero(fresh)
            tails = np.append(heads[1:], size) - 1
            for lo, hi in zip(heads[n[heads] < SIMILAR * n[tails]].tolist(), tails[n[heads] < SIMILAR * n[tails]].tolist(), strict=True):
                while lo <= hi:
                    past = lo + int(np.searchsorted(n[lo : hi + 1] * SIMILAR, n[lo], "right"))
                    leader[lo:past] = lo
                    lo = past
            place = at - start
            if old and bucket[0] == held[0][0]:  # counted on from the batches before
                same = start == 0
                place[same] = np.where(at[same] < old, held[3][np.minimum(at[same], old - 1)], at[same] - old + held[3][-1] + 1)
            pairs = []
            new = at >= old
            for step in range(0, BACK + 1):
                mate = leader if step == 0 else np.maximum(at - step, start)
                good = new & (mate < at) & (n[mate] >= SIMILAR * n)
                if step:
                    good &= mate != leader
                if step > 1:
                    good &= place < few
                pairs.append((bucket[good], node[mate[good]], node[good], n[good]))
            rows = [(PAIR, tuple(np.concatenate(c) for c in zip(*pairs, strict=True)))]
            if edges:
                # the first texts of a bucket are told once it is known to have more
                past = np.flatnonzero(new & (place == few))
                out = np.concatenate([np.flatnonzero(new & (place >= few)), *[past - step for step in range(1, few + 1)]])
                rows.append((MANY, (bucket[out], node[out], node[out], n[out])))
                if first_bucket is None:
                    first_bucket = bucket[0]
                e = np.flatnonzero(new & (bucket == first_bucket) & (place < few))
                rows.append((EDGE, (bucket[e], node[e], node[e], n[e])))
            yield report(*rows)
            last = np.unique(np.concatenate([[leader[-1]], at[max(start[-1], size - BACK - 2) :]]))
            held = (bucket[last], node[last], n[last], place[last])
        if edges and held is not None:
            yield report((EDGE, (held[0], held[1], held[1], held[2])))

    return dealt.mapInArrow(meet, "what int, bucket long, a long, b long, n long")


def _candidates(nodes: DataFrame, sketches: int) -> tuple[DataFrame, DataFrame]:
    """``_met`` of nodes (k1, n, sketches)."""
    return _met(nodes.select(F.explode(F.array(*[F.col(f"s{i}") for i in range(sketches)])).alias("bucket"), F.col("k1").alias("node"), "n"))


def _met(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs a, b; bucket, node of the buckets that are too large for all of their pairs) of rows (bucket, node, n)."""
    order = ["bucket", "n", "node"]
    met = cut(_meet(rows.repartitionByRange(*order).sortWithinPartitions(*order), True))
    edge = met.filter(F.col("what") == EDGE).select("bucket", F.col("a").alias("node"), "n").distinct()
    again = _meet(edge.repartition("bucket").sortWithinPartitions(*order), False)
    both = met.unionByName(again)
    pairs = both.filter(F.col("what") == PAIR).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a <> b").distinct()
    # a task sees a bucket at the edge of its range in part, so its size is counted over all tasks
    return pairs, met.filter(F.col("what") != PAIR).select("bucket", F.col("a").alias("node"))


def _verified(pairs: DataFrame, sequences: DataFrame) -> DataFrame:
    """The pairs (a, b) whose alignment reaches the similarity."""

    def align(batches):
        for batch in batches:
            a, b, x, y = batch.columns
            good = pa.array([alignment(np.frombuffer(p.as_buffer(), "<u4"), np.frombuffer(q.as_buffer(), "<u4")) > 0 for p, q in zip(x, y, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([a.filter(good), b.filter(good)], names=["a", "b"])

    right = sequences.select(F.col("node").alias("b"), F.col("seq").alias("y"))
    left = sequences.select(F.col("node").alias("a"), F.col("seq").alias("x"))
    return pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y").mapInArrow(align, "a long, b long")


def _roots(edges: DataFrame) -> DataFrame:
    """node, comp of all ends of ``edges`` (a < b): a node goes to the smallest of its neighbours before it, on to that one's, and so to one without any."""
    up = rewritten(edges.groupBy(F.col("b").alias("node")).agg(F.min("a").alias("comp")))
    tops = edges.select(F.col("a").alias("node")).distinct().join(up, "node", "left_anti").withColumn("comp", F.col("node"))
    while True:
        jump = up.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        after = rewritten(up.join(jump, "comp", "left").select("node", F.coalesce("root", "comp").alias("comp"), F.col("root").isNotNull().alias("moved")))
        up = after.select("node", "comp")
        if after.filter("moved").isEmpty():
            return rewritten(up.unionByName(tops))


def components(edges: DataFrame) -> DataFrame:
    """node, comp (the smallest node of its component) of all ends of ``edges`` (a < b).

    Each edge is gone through once for the trees that its nodes are in, and once
    for the trees that it joins: these are few, however many links a large group
    of near copies has.
    """
    return _merged(_roots(edges), edges)


def _passed(edges: DataFrame) -> DataFrame:
    """As ``components``: labels pass along edges and then jump to their labels' labels."""
    back = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
    ends = edges.select("a").union(back.select("a")).distinct()
    # every node hears its own label, too
    both = rewritten(edges.select("a", "b").union(back).union(ends.select("a", F.col("a").alias("b"))))
    labels = rewritten(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("comp")))
    while True:
        own = F.min(F.when(F.col("a") == F.col("b"), F.col("comp")))
        heard = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("comp"), own.alias("was"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("root"))
        after = rewritten(heard.join(jump, "comp", "left").select("node", "was", F.least("comp", F.coalesce("root", "comp")).alias("comp")))
        labels = after.select("node", "comp")
        if after.filter("was <> comp").isEmpty():
            return labels


def _merged(comps: DataFrame, found: DataFrame) -> DataFrame:
    """``comps``, which name all ends of ``found``, with these links: they join whole components, so only the components' names are gone through anew."""
    name = lambda end, out: comps.select(F.col("node").alias(end), F.col("comp").alias(out))
    between = found.join(name("a", "ca"), "a").join(name("b", "cb"), "b").filter("ca <> cb")
    between = cut(between.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).distinct())
    if between.isEmpty():
        return comps
    merged = _passed(between).select(F.col("node").alias("comp"), F.col("comp").alias("to"))
    return cut(comps.join(merged, "comp", "left").select("node", F.coalesce("to", "comp").alias("comp")))


def _joined_up(comps: DataFrame, found: DataFrame) -> DataFrame:
    """``comps`` with further links, whose ends may be new."""
    ends = found.select(F.col("a").alias("node")).union(found.select("b")).distinct()
    return _merged(cut(comps.unionByName(ends.join(comps, "node", "left_anti").withColumn("comp", F.col("node")))), found)


_SLOT_KINDS = (("slot", np.int32), ("low", np.int64), ("high", np.int64), ("times", np.int32))
_SLOT_ROWS = "block int, slot binary, low binary, high binary, times binary"


def _summed(slot, low, high, times) -> pa.RecordBatch:
    """Least and largest component and the number of texts of each slot, a row for each block of slots."""
    order = np.argsort(slot, kind="stable")
    slot = slot[order]
    head = np.flatnonzero(np.concatenate([[True], slot[1:] != slot[:-1]]))
    parts = [slot[head], np.minimum.reduceat(low[order], head), np.maximum.reduceat(high[order], head), np.add.reduceat(times[order], head)]
    blocks = parts[0] // SLOT_BLOCK
    cuts = np.append(np.flatnonzero(np.concatenate([[True], blocks[1:] != blocks[:-1]])), len(blocks))
    parts[0], parts[3] = parts[0].astype(np.int32), np.minimum(parts[3], 2**31 - 1).astype(np.int32)
    cols = [[x[a:b].tobytes() for a, b in zip(cuts[:-1], cuts[1:], strict=True)] for x in parts]
    return pa.RecordBatch.from_arrays([pa.array(blocks[cuts[:-1]], pa.int32()), *[pa.array(c, pa.binary()) for c in cols]], names=["block", "slot", "low", "high", "times"])


def _slot_table(texts: DataFrame) -> np.ndarray:
    """For each of ``SLOTS`` slots of labelled words, a table of fixed size: how many of ``texts`` (node, comp, seq) have one, 0 where all of these are of one component.

    Tasks' tables are packed by blocks of slots and summed in two steps, 64 of
    them together and then these, so no step holds more than some MB of a task.
    """

    def count(batches):
        held, size = [], 0
        for batch in batches:
            comps = batch.column(1).to_numpy()
            for i, tok in _labelled(batch.column(2)):
                comp = np.full(len(tok), comps[i])
                held.append(((tok % np.uint64(SLOTS)).astype(np.int64), comp, comp, np.ones(len(tok), np.int64)))
                size += len(tok)
                if size > SLOTS:
                    yield _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
                    held, size = [], 0
        if held:
            yield _summed(*(np.concatenate(x) for x in zip(*held, strict=True)))

    def merge(table: pa.Table) -> pa.Table:
        arrays = (np.concatenate([np.frombuffer(x.as_buffer(), kind).astype(np.int64) for x in table.column(c)]) for c, kind in _SLOT_KINDS)
        return pa.Table.from_batches([_summed(*arrays)])

    def mixed(table: pa.Table) -> pa.Table:
        """Of a block's slots those of several components alone: what the driver gets is small."""
        whole = merge(table)
        slot, low, high, times = (np.frombuffer(whole.column(c)[0].as_buffer(), kind) for c, kind in _SLOT_KINDS)
        kept = low != high
        return pa.table({"slot": pa.array([slot[kept].astype(np.int32).tobytes()], pa.binary()), "times": pa.array([np.minimum(times[kept], 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    parts = texts.select("node", "comp", "seq").mapInArrow(count, _SLOT_ROWS).withColumn("some", F.floor(F.spark_partition_id() / 64))
    some = parts.groupBy("block", "some").applyInArrow(lambda t: merge(t.drop_columns("some")), _SLOT_ROWS)
    got = some.groupBy("block").applyInArrow(mixed, "slot binary, times binary").toArrow()
    table = np.zeros(SLOTS, np.int32)
    for slot, times in zip(got.column("slot"), got.column("times"), strict=True):
        table[np.frombuffer(slot.as_buffer(), np.int32)] = np.frombuffer(times.as_buffer(), np.int32)
    return table


def _enough(times: np.ndarray) -> bool:
    """Whether so many of a text's words may stand in texts of other components that it can be as similar to one as ``SIMILAR``."""
    return np.count_nonzero(times) >= math.ceil(len(times) * SIMILAR - 1e-6)


def _labelled(column):
    """(row, its labelled words) of a column of word sequences."""
    for i, seq in enumerate(column):
        h = np.frombuffer(seq.as_buffer(), "<u4").astype(np.uint64)
        yield i, shingles(h, np.array([0, len(h)]), 1)[0]


def _parities(words: np.ndarray) -> np.ndarray:
    """Whether the number of labelled words in each of 64 x ``PARITIES`` slots is odd, as longs: a word that only one of two texts has changes one bit."""
    odd = np.bincount((words >> np.uint64(22)).astype(np.int64) % (64 * PARITIES), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _left_over(texts: DataFrame) -> DataFrame:
    """a, b: every pair of ``texts`` (node, comp, seq) of different components whose alignment may reach ``SIMILAR``.

    Such texts have that share of their words, labelled by their occurrence, in
    common.  Words are put in one order, those of rare slots first; any order is
    right, this one keeps common passages out of the way.  The first word in
    common stands among the first fifth of either, and what follows it suffices
    for the overlap.  Words of one component alone meet nothing, so a text with
    too few others can't be in such a pair and is left out first.  Pairs whose
    parities differ in more bits than they may in words are left out, too.
    """
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(_slot_table(texts))
    times_of = lambda words: sent.value[(words % np.uint64(SLOTS)).astype(np.int64)]

    def possible(batches):
        for batch in batches:
            good = np.zeros(len(batch), bool)
            for i, words in _labelled(batch.column(2)):
                good[i] = _enough(times_of(words))
            yield batch.filter(pa.array(good))

    texts = cut(texts.select("node", "comp", "seq").mapInArrow(possible, "node long, comp long, seq binary"))
    # those that are left out may have been all that others had in common with other components
    sent = spark.sparkContext.broadcast(_slot_table(texts))
    own = ["node", "comp", "n", "rest", *[f"p{i}" for i in range(PARITIES)]]

    def first_fifth(batches):
        for batch in batches:
            rows, found = [], []
            for i, words in _labelled(batch.column(2)):
                n, times = len(words), times_of(words)
                if not _enough(times):
                    continue
                early = np.lexsort((words, times))[: n - math.ceil(n * SIMILAR - 1e-6) + 1]
                met = np.flatnonzero(times[early])
                rows.append(np.full(len(met), i))
                found.append((words[early[met]].view(np.int64), np.full(len(met), n), n - met, np.tile(_parities(words), (len(met), 1))))
            if rows:
                at, (word, n, rest, parities) = pa.array(np.concatenate(rows)), (np.concatenate(x) for x in zip(*found, strict=True))
                numbers = [n, rest, *(np.ascontiguousarray(parities[:, i]) for i in range(PARITIES))]
                yield pa.RecordBatch.from_arrays([pa.array(word), batch.column(0).take(at), batch.column(1).take(at), *map(pa.array, numbers)], names=["word", *own])

    early = cut(texts.mapInArrow(first_fifth, ", ".join(f"{c} long" for c in ("word", *own))))
    one, other = (early.select("word", *[F.col(c).alias(f"{c}_{end}") for c in own]) for end in "ab")
    need = F.lit(SIMILAR / (1 + SIMILAR)) * (F.col("n_a") + F.col("n_b")) - 1e-6
    apart = sum((F.bit_count(F.col(f"p{i}_a").bitwiseXOR(F.col(f"p{i}_b"))) for i in range(PARITIES)), F.lit(0))
    near = (F.least("rest_a", "rest_b") >= need) & (apart <= F.col("n_a") + F.col("n_b") - 2 * need)
    # the tests stand in the join itself, so that a common word makes no rows of texts that can't be alike
    pairs = one.join(other.withColumnRenamed("word", "word_b"), (F.col("word") == F.col("word_b")) & (F.col("node_a") < F.col("node_b")) & (F.col("comp_a") != F.col("comp_b")) & near)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b")).distinct()


def _hashable(docs: DataFrame) -> list[Column]:
    """All columns, in forms that can be hashed."""
    return [F.to_json(F.struct(f"`{c}`")) if "map<" in kind or kind == "variant" else F.col(f"`{c}`") for c, kind in docs.dtypes]


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """_id, h1, h2 (hashes of the whole row), class_id, kept of every row; see ``classes``."""
    columns = _hashable(docs)
    rows = docs.select(docs[id_col].cast("long").alias("_id"), F.xxhash64(*columns).alias("h1"), F.xxhash64(F.lit("second"), *columns).alias("h2"), text_of(docs, text).alias("_body"))
    signed = cut(_signed(rows, sketches))
    sketch_cols = [f"s{i}" for i in range(sketches)]
    nodes = signed.filter("n > 0").groupBy("k1", "k2", "n").agg(*[F.min(c).alias(c) for c in sketch_cols])
    pairs, many = _candidates(nodes, sketches)
    pairs, many = cut(pairs), cut(many.distinct())
    asked = pairs.select("a").union(pairs.select("b")).union(many.select("node")).distinct().withColumnRenamed("a", "node")
    sequences = cut(signed.filter("n > 0").groupBy(F.col("k1").alias("node")).agg(F.first("seq").alias("seq")).join(asked, "node", "left_semi"))
    comps = components(cut(_verified(pairs, sequences)))
    # Large buckets whose texts are in several components yet: the exact join.
    wide = cut(many.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node")))
    mixed = cut(wide.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("size")).filter(f"low <> high AND size > {BACK + 2}").select("bucket"))
    rest = cut(wide.join(mixed, "bucket", "left_semi").select("node", "comp").distinct())
    if not rest.isEmpty():
        more = cut(_verified(_left_over(rest.join(sequences, "node")), sequences))
        if not more.isEmpty():
            comps = _joined_up(comps, more)
    # A text without links is a class of its own, known by all of its key.
    alone = F.col("comp").isNull()
    named = signed.select("_id", "h1", "h2", "k1", "k2").join(comps.withColumnRenamed("node", "k1"), "k1", "left")
    named = cut(named.select("_id", "h1", "h2", F.coalesce("comp", "k1").alias("c1"), F.when(alone, F.col("k2")).otherwise(0).alias("c2")))
    best = F.min(F.struct(F.col("_id").isNull().alias("nameless"), F.col("_id").alias("id"), F.col("h1").alias("f1"), F.col("h2").alias("f2")))
    first = cut(named.groupBy("c1", "c2").agg(best.alias("first"), F.count(F.lit(1)).alias("rows")).filter("rows > 1").select("c1", "c2", "first"))
    out = named.join(first, ["c1", "c2"], "left")
    kept = F.col("first").isNull() | ((F.col("h1") == F.col("first.f1")) & (F.col("h2") == F.col("first.f2")))
    return out.select("_id", "h1", "h2", F.when(F.col("first").isNull(), F.col("_id")).otherwise(F.col("first.id")).alias("class_id"), kept.alias("kept"))


def classes(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sketches: int = SKETCHES) -> DataFrame:
    """_id, class_id, kept of every row of ``docs``: the smallest id of its class, and whether its class is kept in this row.

    Texts are known by their words, never by their ids, so rows that share an
    id are judged each.  Texts with the same words in the same order are of one
    class.  Texts without words (null, empty) are in classes of their own.
    Null ids stay null and come last: a class of nothing else has a null
    class_id.  The row with the smallest id is kept, of several the one with
    the smallest hash; rows that are equal in every column are marked alike.
    """
    return judged(docs, id_col, text, sketches).select("_id", "class_id", "kept")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each class, columns unchanged; which one is told at ``classes``.  Of rows equal in every column one stays."""
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*inner.values())
    found = cut(judged(renamed, inner[id_col], inner[text]))
    gone = found.filter("NOT kept").select("h1", "h2").distinct()
    twice = cut(found.filter("kept").groupBy("h1", "h2").count().filter("count > 1").select("h1", "h2"))
    columns = _hashable(renamed)
    keyed = renamed.withColumns({"h1": F.xxhash64(*columns), "h2": F.xxhash64(F.lit("second"), *columns)})
    left = keyed.join(gone, ["h1", "h2"], "left_anti")
    if not twice.isEmpty():
        left = left.join(twice, ["h1", "h2"], "left_anti").unionByName(left.join(twice, ["h1", "h2"], "left_semi").dropDuplicates(["h1", "h2"]))
    return left.select(*[F.col(v).alias(k) for k, v in inner.items()])

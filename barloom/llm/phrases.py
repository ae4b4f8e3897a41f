"""Phrase collocations by mergeable Misra-Gries summaries.

Texts become a written table of chunks: words of one language, one space
between them and a line end between pieces.  A task counts the hashes of a
chunk's n-grams and hands each hash partition a summary of its own.  The
summaries of a partition are merged into one whose capacity exceeds the
partition's mass divided by the threshold, so every n-gram of that frequency
survives.  Each chunk then learns, as a bit for each of its hashes, which of them
survived, and a second pass over the chunks counts those exactly, by their words.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_of
from .words import Powers, grams, mix, text_chunks, word_bounds, word_hashes

#: Bytes of a chunk, and the mass (n-grams with repetition) of a hash partition at most.  Larger ones make fewer and longer summaries: a matter of the executors' memory.
CHUNK_BYTES, MASS = 8 << 20, 1 << 20
#: Phrases of several chunks whose counts a task adds up before it hands them on.
WAITING = 1 << 20
LONGEST = 4
THRESHOLD, MOST, SCALE, SHARE = 30, 2000, 2_000_000, 80

_BREAKS = b".,;:!?\n\x0b\x0c\r"


def _kinds() -> np.ndarray:
    """Bytes of words with lower-cased A-Z; 0 separates, and a NUL is a word byte like no other."""
    table = np.arange(256, dtype=np.uint16)
    table[65:91] += 32
    table[[32, 9, *_BREAKS]] = 0
    table[0] = 256
    return table


KINDS = _kinds()
_IS_BREAK = np.zeros(256, bool)
_IS_BREAK[list(_BREAKS)] = True


def normalised(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, first byte of each text and the end, ends of words): words with a space after each, or a line end after the last of a piece."""
    t, starts, ends, first = word_bounds(data, offsets, KINDS)
    lengths = ends - starts + 1
    to = np.cumsum(lengths)
    out = np.empty(int(to[-1]) if len(to) else 0, np.uint8)
    if len(to):
        source = np.repeat(starts - (to - lengths), lengths) + np.arange(len(out))
        out[:] = t.astype(np.uint8)[np.minimum(source, len(t) - 1)]
        # words are in one piece if no break stands between them and no text ends
        breaks = np.concatenate([[0], np.cumsum(_IS_BREAK[data])])[starts]
        text = np.searchsorted(offsets, starts, "right")
        last = np.append((breaks[1:] != breaks[:-1]) | (text[1:] != text[:-1]), True)
        out[to - 1] = np.where(last, 10, 32)
    return out, np.concatenate([[0], to])[first], to


def chunks(docs: DataFrame, lang: str = "lang", text: str = "text", size: int = CHUNK_BYTES) -> DataFrame:
    """chunk, lang, words, context, body: all words of all texts, written.

    A text that is longer than a chunk goes on in the next one; the first words
    of that one stand at the end of its predecessor, too, as ``context`` words with which
    n-grams end but don't begin.
    """

    def gather(batches):
        held: dict[str, list] = {}
        sizes: dict[str, int] = {}

        def row(name, parts, words, context=0):
            return pa.RecordBatch.from_pylist([{"lang": name, "words": words, "context": context, "body": zstandard.ZstdCompressor().compress(b"".join(parts))}], schema=schema)

        def flush(name):
            parts, words = zip(*held.pop(name), strict=True)
            sizes.pop(name)
            return row(name, parts, sum(words))

        schema = pa.schema([("lang", pa.string()), ("words", pa.int64()), ("context", pa.int32()), ("body", pa.binary())])
        for batch in batches:
            langs = batch.column(1).to_pylist()
            for at, data, offsets in text_chunks(batch.column(0)):
                body, bounds, ends = normalised(data, offsets)
                counts = np.searchsorted(ends, bounds, "right")
                for n, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    name = langs[at + n]
                    own = ends[counts[n] : counts[n + 1]]
                    while b - a > size and len(own) > LONGEST:
                        # as many words as fit, and some further ones as context
                        k = max(1, min(int(np.searchsorted(own, a + size, "right")), len(own) - 1))
                        further = min(LONGEST - 1, len(own) - k)
                        yield row(name, [body[a : own[k + further - 1]].tobytes()], k, further)
                        a, own = int(own[k - 1]), own[k:]
                    if b > a:
                        held.setdefault(name, []).append((body[a:b].tobytes(), len(own)))
                        sizes[name] = sizes.get(name, 0) + b - a
                        if sizes[name] >= size:
                            yield flush(name)
                if sum(sizes.values()) >= 4 * size:
                    yield flush(max(sizes, key=sizes.__getitem__))
        for name in list(held):
            yield flush(name)

    rows = docs.select(text_of(docs, text).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    return cut(rows.mapInArrow(gather, "lang string, words long, context int, body binary").withColumn("chunk", F.monotonically_increasing_id()))


_POWERS = Powers()


def _seed(name: str) -> np.ndarray:
    data = np.frombuffer(name.encode() + b" ", np.uint8)
    return word_hashes(data, np.zeros(1, np.int64), np.array([len(data)]), _POWERS)


def _hashed(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The words' hashes, a run of words at a time."""
    cuts = np.unique(np.append(np.searchsorted(starts, np.arange(0, len(data), 1 << 20)), len(starts)))
    return np.concatenate([np.zeros(0, np.uint64), *[word_hashes(data[starts[i] : ends[j - 1]], starts[i:j] - starts[i], ends[i:j] - starts[i], _POWERS) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]])


class Grams:
    """The n-grams of a chunk, one length at a time: 64-bit hashes that begin with two bits of the length."""

    def __init__(self, lang: str, words: int, body: bytes):
        self.data, self.words = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8), words
        self.ends = np.flatnonzero((self.data == 32) | (self.data == 10))
        self.starts = np.concatenate([[0], self.ends[:-1] + 1])
        self.seed, self.hashes = _seed(lang), _hashed(self.data, self.starts, self.ends)
        self.piece = np.concatenate([[0], np.cumsum(self.data[self.ends] == 10, dtype=np.int32)])

    def of(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(hashes of the n-grams of k words, their first words)."""
        n = max(0, min(self.words, len(self.hashes) - k + 1))
        first = np.flatnonzero(self.piece[:n] == self.piece[k - 1 : k - 1 + n])
        return (mix(grams(self.hashes, k)[first] + self.seed) >> np.uint64(2)) | np.uint64(k - 1 << 62), first

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words from some first words on."""
        begin, end = self.starts[first], self.ends[first + k - 1]
        to = np.cumsum(end - begin)
        raw = self.data[np.repeat(begin - (to - (end - begin)), end - begin) + np.arange(to[-1] if len(to) else 0)]
        offsets = np.concatenate([[0], to]).astype(np.int32)
        return pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes()))


def _runs(ordered: np.ndarray) -> np.ndarray:
    """Where each value of a sorted array begins."""
    return np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.zeros(0, np.int64)


def packed(values: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted values as differences, and counts; bytes of equal weight together, compressed."""
    steps = np.diff(values, prepend=np.uint64(0))
    both = [x.astype("<u8").view(np.uint8).reshape(-1, 8).T.tobytes() for x in (steps, counts.astype(np.uint64))]
    return zstandard.ZstdCompressor().compress(b"".join(both))


def unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    steps, counts = (np.ascontiguousarray(x.reshape(8, -1).T).view("<u8").ravel() for x in np.split(raw, 2))
    return np.cumsum(steps, dtype=np.uint64), counts.astype(np.int64)


def merged(summaries: list[tuple[np.ndarray, np.ndarray]], capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(values, counters, error) of several Misra-Gries summaries: what is over the capacity goes by taking the next largest counter from all.

    Each unit of the error takes one from more than ``capacity`` counters, so the
    errors of all merges together stay below mass / capacity.
    """
    values, counts = (np.concatenate(x) for x in zip(*summaries, strict=True))
    order = np.argsort(values, kind="stable")
    values, counts = values[order], counts[order]
    at = _runs(values)
    values, counts = values[at], np.add.reduceat(counts, at) if len(at) else counts
    if len(values) <= capacity:
        return values, counts, 0
    error = int(np.partition(counts, len(counts) - capacity - 1)[len(counts) - capacity - 1])
    left = counts > error
    return values[left], counts[left] - error, error


def summary(blobs: list[bytes], mass: int, threshold: int) -> np.ndarray:
    """The values that may stand ``threshold`` times or more among partial summaries of a partition of that mass."""
    capacity = mass // threshold + 1
    held, waiting, error = [], 0, 0
    for blob in blobs:
        held.append(unpacked(blob))
        waiting += len(held[-1][0])
        if waiting > 2 * capacity:
            values, counts, more = merged(held, capacity)
            held, waiting, error = [(values, counts)], len(values), error + more
    values, counts, more = merged(held, capacity)
    return values[counts + error + more >= threshold]


def survivors(table: DataFrame, bits: int, splits: int, threshold: int) -> DataFrame:
    """chunk, part, kept: for each chunk and hash partition a bit for each of the chunk's distinct hashes, in their order; none where no hash survived."""
    narrow, part_shift = np.uint64(64 - bits), np.uint64(bits - splits)

    def summarise(batches):
        for batch in batches:
            for chunk, lang, words, body in zip(*[batch.column(i).to_pylist() for i in range(4)], strict=True):
                found = Grams(lang, words, body)
                for k in range(1, LONGEST + 1):
                    ordered = np.sort(found.of(k)[0] >> narrow)
                    at = _runs(ordered)
                    counts = np.diff(np.append(at, len(ordered)))
                    values = ordered[at]
                    parts = values >> part_shift
                    cuts = _runs(parts)
                    pairs = list(zip(cuts.tolist(), [*cuts[1:].tolist(), len(values)], strict=True)) if len(cuts) else []
                    yield pa.RecordBatch.from_arrays([
                        pa.array(parts[cuts].astype(np.int64)), pa.array([chunk] * len(cuts), pa.int64()), pa.array([int(counts[a:b].sum()) for a, b in pairs], pa.int64()),
                        pa.array([packed(values[a:b], counts[a:b]) for a, b in pairs], pa.binary()),
                    ], names=["part", "chunk", "mass", "summary"])

    def merge(batches):
        part, held = None, []

        def kept():
            chunk_ids, masses, blobs = zip(*held, strict=True)
            live = summary(blobs, sum(masses), threshold)
            rows = [(c, np.packbits(found).tobytes()) for c, b in zip(chunk_ids, blobs, strict=True) if (found := np.isin(unpacked(b)[0], live, assume_unique=True)).any()]
            return pa.RecordBatch.from_arrays([pa.array([c for c, _ in rows], pa.int64()), pa.array([part] * len(rows), pa.int64()), pa.array([x for _, x in rows], pa.binary())], names=["chunk", "part", "kept"])

        for batch in batches:
            for i, p in enumerate(batch.column(0).to_pylist()):
                if p != part:
                    if held:
                        yield kept()
                    part, held = p, []
                held.append(tuple(batch.column(j)[i].as_py() for j in (1, 2, 3)))
        if held:
            yield kept()

    partial = table.select("chunk", "lang", "words", "body").mapInArrow(summarise, "part long, chunk long, mass long, summary binary")
    return partial.repartition(F.col("part")).sortWithinPartitions("part").mapInArrow(merge, "chunk long, part long, kept binary")


def frequencies(docs: DataFrame, threshold: int = THRESHOLD, lang: str = "lang", text: str = "text", chunk_bytes: int = CHUNK_BYTES, mass: int = MASS) -> tuple[DataFrame, DataFrame]:
    """(lang, phrase, k, f of all phrases of one to four words that stand ``threshold`` times or more; lang, n of all words).  Exact; both written."""
    table = chunks(docs, lang, text, chunk_bytes)
    totals = cut(table.groupBy("lang").agg(F.sum("words").alias("n")))
    whole = LONGEST * (totals.agg(F.sum("n")).first()[0] or 0)
    # partitions by leading bits, the first two of which are the length's, so none holds two lengths; hashes wide enough that few values share one, as those are counted together until the second pass
    splits = max(2, (-(-whole // mass) - 1).bit_length())
    bits = min(64, max(splits + 8, whole.bit_length() + 3))
    kept = survivors(table, bits, splits, threshold).groupBy("chunk").agg(F.collect_list(F.struct("part", "kept")).alias("kept"))
    narrow, part_shift = np.uint64(64 - bits), np.uint64(bits - splits)

    def count(batches):
        held, waiting = [], 0  # lang, k, phrases, hashes and counts of each chunk

        def summed():
            """What is held, each phrase of several chunks once: a row for each hash partition and language."""
            names, lengths, texts, hashes, counts = zip(*held, strict=True)
            sizes = [len(t) for t in texts]
            known = sorted(set(names))
            lang = np.repeat(np.array([known.index(n) for n in names]), sizes)
            k = np.repeat(np.array(lengths, np.int32), sizes)
            hashes, counts, text = np.concatenate(hashes), np.concatenate(counts), pa.concat_arrays(texts)
            parts = (hashes >> narrow >> part_shift).astype(np.int64)
            order = np.lexsort((hashes, lang, parts))
            at = _runs(hashes[order])
            first, total = order[at], np.add.reduceat(counts[order], at) if len(at) else counts
            cuts = _runs(parts[first] * len(known) + lang[first])
            offsets = pa.array(np.append(cuts, len(first)), pa.int32())
            own = first[cuts]
            yield pa.RecordBatch.from_arrays([
                pa.array(parts[own]), pa.array([known[n] for n in lang[own].tolist()], pa.string()), pa.array(k[own]),
                pa.ListArray.from_arrays(offsets, text.take(pa.array(first))), pa.ListArray.from_arrays(offsets, pa.array(total)),
            ], names=["part", "lang", "k", "phrases", "counts"])

        for batch in batches:
            for name, words, body, bitmaps in zip(*[batch.column(i) for i in range(4)], strict=True):
                found, maps = Grams(name.as_py(), words.as_py(), body.as_py()), bitmaps.as_py()
                for k in range(1, LONGEST + 1):
                    hashes, first = found.of(k)
                    order = np.argsort(hashes)
                    ordered = hashes[order]
                    narrowed = ordered >> narrow
                    at = _runs(narrowed)
                    parts = (narrowed[at] >> part_shift).astype(np.int64)
                    alive = np.zeros(len(at), bool)
                    for r in maps:
                        a, b = np.searchsorted(parts, [r["part"], r["part"] + 1])
                        if a < b:  # the partition has n-grams of this length
                            alive[a:b] = np.unpackbits(np.frombuffer(r["kept"], np.uint8), count=b - a)
                    live = np.repeat(alive, np.diff(np.append(at, len(ordered))))
                    order, ordered = order[live], ordered[live]
                    at = _runs(ordered)
                    held.append((name.as_py(), k, found.phrases(first[order[at]], k), ordered[at], np.diff(np.append(at, len(ordered)))))
                    waiting += len(at)
                if waiting >= WAITING:
                    yield from summed()
                    held, waiting = [], 0
        if held:
            yield from summed()

    def add_up(batches):
        """The phrases of one hash partition and language after another that are frequent."""
        key, held = None, []

        def frequent():
            part, lang, k = key
            phrases, counts = (pa.concat_arrays(x) for x in zip(*held, strict=True))
            encoded = phrases.dictionary_encode()
            at = encoded.indices.to_numpy()
            total = np.zeros(len(encoded.dictionary), np.int64)
            np.add.at(total, at, counts.to_numpy())
            good = np.flatnonzero(total >= threshold)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(good), pa.string()), encoded.dictionary.take(pa.array(good)), pa.array([k] * len(good), pa.int32()), pa.array(total[good])], names=["lang", "phrase", "k", "f"])

        for batch in batches:
            for i, own in enumerate(zip(*[batch.column(c).to_pylist() for c in range(3)], strict=True)):
                if own != key:
                    if held:
                        yield frequent()
                    key, held = own, []
                held.append((batch.column(3)[i].values, batch.column(4)[i].values))
        if held:
            yield frequent()

    rows = table.join(kept, "chunk").select("lang", "words", "body", "kept").mapInArrow(count, "part long, lang string, k int, phrases array<string>, counts array<long>")
    dealt = rows.repartition(F.col("part")).sortWithinPartitions("part", "lang")
    return cut(dealt.mapInArrow(add_up, "lang string, phrase string, k int, f long")), totals


def _contained(candidates: DataFrame) -> DataFrame:
    """lang, phrase, longest: the phrases within longer candidates, with the largest frequency of such a one."""
    words = F.split("phrase", " ")
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda k: F.transform(F.sequence(F.lit(1), F.col("k") - k + 1), lambda at: F.array_join(F.slice(words, at, k), " "))))
    return candidates.filter("k > 2").select("lang", F.explode(inner).alias("phrase"), F.col("f").alias("longer")).groupBy("lang", "phrase").agg(F.max("longer").alias("longer"))


def mine(docs: DataFrame, threshold: int = THRESHOLD, most: int = MOST, share: int = SHARE, lang: str = "lang", text: str = "text", chunk_bytes: int = CHUNK_BYTES, mass: int = MASS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the best phrases of two to four words of each language.

    Words are lower-cased (A-Z) and stand between spaces and tabs, phrases
    within pieces between ``.,;:!?`` and line ends.  A phrase of frequency a >=
    ``threshold`` is cut where floor(2000000 * a / (l + r)) is lowest (then
    after the fewest words); one that lies in a longer such phrase with
    ``share`` percent of its frequency is left out.  A null language is
    ``und``; a null text is empty; repeated rows count each time; further
    columns of any name are let be.
    """
    known, totals = frequencies(docs, threshold, lang, text, chunk_bytes, mass)
    candidates = known.filter("k > 1")
    cuts = candidates.withColumn("at", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.withColumns({"left": F.expr("substring_index(phrase, ' ', at)"), "right": F.expr("substring_index(phrase, ' ', at - k)")})
    lefts = known.select(F.col("lang"), F.col("phrase").alias("left"), F.col("f").alias("l"))
    rights = known.select(F.col("lang"), F.col("phrase").alias("right"), F.col("f").alias("r"))
    both = cuts.join(lefts, ["lang", "left"]).join(rights, ["lang", "right"])
    score = F.expr(f"cast(cast({SCALE} as decimal(7,0)) * cast(f as decimal(19,0)) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0))) as long)")
    scored = both.select("lang", "phrase", F.col("f").alias("a"), F.struct(score.alias("score"), "at", "l", "r").alias("c")).groupBy("lang", "phrase").agg(F.first("a").alias("a"), F.min("c").alias("c"))
    free = scored.join(_contained(candidates), ["lang", "phrase"], "left").filter(F.expr(f"longer IS NULL OR cast(longer as decimal(19,0)) * 100 < cast(a as decimal(19,0)) * {share}"))
    # the rank is cut before the shuffle: each task sends a language's first ones alone
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = free.select("lang", "phrase", "a", "c.l", "c.r", "c.score").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")


def oracle(threshold: int = THRESHOLD, most: int = MOST, share: int = SHARE) -> str:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return rf"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), '{upper}', '{lower}'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
  ws AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
  grams AS (SELECT lang, k, array_to_string(w[i : i + k - 1], ' ') AS phrase FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM ws, (SELECT unnest([1, 2, 3, 4]) AS k))),
  f AS (SELECT lang, phrase, any_value(k) AS k, count(*) AS f FROM grams GROUP BY lang, phrase HAVING count(*) >= {threshold}),
  totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM ws GROUP BY lang),
  cuts AS (SELECT lang, phrase, f AS a, cut_at, array_to_string(w[1 : cut_at], ' ') AS lp, array_to_string(w[cut_at + 1 :], ' ') AS rp FROM (SELECT lang, phrase, f, string_split(phrase, ' ') AS w, unnest(range(1, k)) AS cut_at FROM f WHERE k > 1)),
  scored AS (SELECT c.lang, c.phrase, c.a, c.cut_at, x.f AS l, y.f AS r, CAST((2000000::HUGEINT * c.a) // (x.f + y.f) AS BIGINT) AS score FROM cuts c JOIN f x ON x.lang = c.lang AND x.phrase = c.lp JOIN f y ON y.lang = c.lang AND y.phrase = c.rp),
  best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut_at) = 1),
  inner_ AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT lang, f, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM (SELECT lang, f, k, string_split(phrase, ' ') AS w, unnest(range(2, k)) AS m FROM f WHERE k > 2)) GROUP BY ALL)
  SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, encode(b.phrase)) AS rank, b.phrase, a, l, r, n, score FROM best b JOIN totals USING (lang) LEFT JOIN inner_ i ON i.lang = b.lang AND i.phrase = b.phrase
  WHERE longer IS NULL OR 100 * longer < {share} * a QUALIFY rank <= {most}"""

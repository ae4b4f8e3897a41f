"""Language-model scoring by a log-bilinear model trained with noise-contrastive estimation.

Counts of all tokens of all training documents are gathered by Spark.  A token
that stands ``LEAST`` times or more, and makes up one in ``SHARE`` of all tokens
or more, is a word of the model with vectors of its own, as target and as
context.  All rarer tokens share ``RARE`` further words by their hashes, so they
have vectors, too, and a word's probability goes to its tokens by their counts.
Words in order of their counts form about sqrt(words) classes of equal size,
and the output is factored: ``p(class | context) p(word | class, context)``,
both log-bilinear in ``r1[h1] + r2[h2]`` of two context words.  Both sums are
whole, by batched matrix products, so scores are exact, normalised
log-probabilities.

Training documents, as words, are dealt to shards of about ``SHARD`` tokens by
hashes, whatever the layout of their files.  Each shard makes one NCE pass in
numpy; shards go in ``ROUNDS``, and the parameters, averaged by the steps that
each row took, are the start of the next round.

Tokens are known by 64-bit hashes; two of a corpus' tokens meet in one hash
only beyond some 10**9 distinct ones.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, text_of
from .words import FOLDED, Powers, mix, text_chunks, word_bounds, word_hashes

#: The model's dimension, noise samples of a batch's classes and of a token's word, tokens of a batch, AdaGrad's rate and first sum.
DIM, NOISE, WORD_NOISE, BATCH, RATE, FIRST_SUM = 12, 32, 2, 4096, 0.05, 1e-3
#: Occurrences in training, and one part of all tokens in how many, from which on a token is a word of its own; the words that all others share (as bits).
LEAST, SHARE, RARE_BITS = 20, 200_000, 14
#: Tokens of a training shard, and the rounds of shards.
SHARD, ROUNDS = 2_000_000, 2
#: Rows of parameters that travel as one value.
BLOCK = 512
#: Tokens whose counts every task holds; the counts of all others are joined.
HOT = 200_000
#: crc32(doc_id) mod FOLDS = HELD is held out.
FOLDS, HELD = 7, 2
#: Bytes of text whose tokens are counted together before they are sent on.
COUNT_BYTES = 24 << 20

END = np.uint64(0x5EED0FE0D5EED0E1)  # the end token's hash
END_WORD = 0


def _tokens(column, powers, limit=None):
    """(hashes with an end token after each text, first token of each text and the end) for chunks of texts."""
    for _, data, offsets in text_chunks(column) if limit is None else text_chunks(column, limit):
        t, starts, ends, first = word_bounds(data, offsets, FOLDED)
        h = word_hashes(t, starts, ends, powers)
        n = len(offsets) - 1
        out = np.empty(len(h) + n, np.uint64)
        bounds = first + np.arange(n + 1)
        out[bounds[1:] - 1] = END
        keep = np.ones(len(out), bool)
        keep[bounds[1:] - 1] = False
        out[keep] = h
        yield out, bounds


def token_counts(bodies: DataFrame) -> DataFrame:
    """token (hash), c over the single text column of ``bodies``: summed in the task, then over tasks."""

    def count(batches):
        powers, held, size = Powers(), [], 0

        def flush():
            tokens, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(tokens.view(np.int64)), pa.array(n.astype(np.int64))], names=["token", "c"])

        for batch in batches:
            for h, _ in _tokens(batch.column(0), powers):
                held.append(h)
                size += len(h)
                if size * 7 > COUNT_BYTES:
                    yield flush()
                    held, size = [], 0
        if held:
            yield flush()

    return bodies.mapInArrow(count, "token long, c long").groupBy("token").agg(F.sum("c").alias("c"))


def _hottest(counts: DataFrame, most: int, least_count: int) -> DataFrame:
    """The tokens above the lowest count that leaves at most ``most`` of them, found from a histogram: no task sees all tokens.  Those of ``least_count`` or more come always."""
    step = F.floor(F.log2("c") * 32).cast("long")
    classes = sorted(counts.groupBy(step.alias("step")).count().collect(), reverse=True)  # some 32 rows for each doubling
    total, least = 0, None
    for at, n in classes:
        if total + n > most:
            break
        total, least = total + n, at
    return counts.filter((step >= (least if least is not None else 1 << 30)) | (F.col("c") >= least_count))


class Lookup:
    """Places of 64-bit hashes in a sorted list, by their leading bits; -1 for others."""

    def __init__(self, keys: np.ndarray):
        self.keys = np.concatenate([keys, np.zeros(1, np.uint64)])
        self.n = len(keys)
        bits = max(1, int(self.n).bit_length())
        self.shift = np.uint64(64 - bits)
        self.start = np.searchsorted(keys >> self.shift, np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)

    def __call__(self, h: np.ndarray) -> np.ndarray:
        top = (h >> self.shift).astype(np.int64)
        at, stop = self.start.take(top), self.start.take(top + 1)
        out = np.where((at < stop) & (self.keys.take(at) == h), at, -1)
        left = np.flatnonzero((out < 0) & (at + 1 < stop))
        step = 1
        while len(left):
            hit = self.keys[at[left] + step] == h[left]
            out[left[hit]] = at[left[hit]] + step
            left = left[~hit]
            step += 1
            left = left[at[left] + step < stop[left]]
        return out


def first_parameters(log_share: np.ndarray, dim: int = DIM) -> dict:
    """Small random vectors, and the log shares as biases."""
    rng = np.random.default_rng(11)
    n = len(log_share)
    return {"r1": rng.normal(0, 0.1, (n, dim)).astype(np.float32), "r2": rng.normal(0, 0.1, (n, dim)).astype(np.float32), "q": np.column_stack([rng.normal(0, 0.1, (n, dim)), log_share]).astype(np.float32)}


def contexts(words: np.ndarray, bounds: np.ndarray):
    """The words one and two before each token; before a text's start stands the end token."""
    one, two = np.empty_like(words), np.empty_like(words)
    one[1:], two[2:] = words[:-1], words[:-2]
    start = bounds[:-1]
    one[start] = END_WORD
    two[start] = END_WORD
    second = start + 1
    second = second[second < bounds[1:]]
    two[second] = END_WORD
    return one, two


def layout(log_share: np.ndarray):
    """(words of a class, log share of each class, log share of each word within its class)."""
    width = max(1, int(np.ceil(np.sqrt(len(log_share)))))
    most = log_share.max()
    by_class = np.log(np.add.reduceat(np.exp(log_share - most), np.arange(0, len(log_share), width))) + most
    return width, by_class, (log_share - by_class[np.arange(len(log_share)) // width]).astype(np.float32)


#: Starts of the context vectors, repeated over the words: no task draws or ships a whole table.
_STARTS = np.random.default_rng(11).normal(0, 0.1, (2, 4096, DIM)).astype(np.float32)


TABLES = ("r1", "r2", "q", "classes")


def empty_tables(n: int, n_classes: int) -> list[np.ndarray]:
    """What is learnt beyond the starts, in whole blocks of rows: nothing yet."""
    return [np.zeros((-(-rows // BLOCK) * BLOCK, DIM + (k > 1)), np.float16) for k, rows in enumerate((n, n, n, n_classes))]


class Trainer:
    """One NCE pass: batches of tokens against noise, AdaGrad steps.

    Classes share the noise of a batch, a word's noise comes from its class.
    Tables of words hold what was learnt beyond the start; rows that a task
    never touches take no memory.
    """

    def __init__(self, log_share: np.ndarray, seed: int, start: list | None = None, noise: int = NOISE, rate: float = RATE):
        n, dim = len(log_share), DIM
        self.width, by_class, self.bias = layout(log_share)
        start = start or empty_tables(n, len(by_class))
        self.p = {k: v[:rows].astype(np.float32) for k, v, rows in zip(TABLES, start, (n, n, n, len(by_class)), strict=True)}
        self.sums = {k: np.zeros(v.shape, np.float32) for k, v in self.p.items()}
        self.steps = {k: np.zeros(len(v), np.float32) for k, v in self.p.items()}
        self.first = first_parameters(by_class, dim)["q"]
        self.cumulated = np.cumsum(np.exp(log_share - log_share.max()).astype(np.float64))
        self.ends = np.append(0, self.cumulated[np.minimum(np.arange(1, len(by_class) + 1) * self.width, n) - 1])
        self.log_noise = (by_class + np.log(noise)).astype(np.float32)
        self.rng, self.noise, self.rate = np.random.default_rng(seed), noise, rate

    def _step(self, name: str, rows: np.ndarray, grads: np.ndarray):
        # small numbers are sorted by their digits, much faster
        order = np.argsort(rows.astype(np.uint16) if len(self.p[name]) <= 1 << 16 else rows, kind="stable")
        rows = rows.take(order)
        fresh = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]]))
        g, at = np.add.reduceat(grads.take(order, axis=0), fresh, axis=0), rows.take(fresh)
        sums = self.sums[name].take(at, axis=0)
        sums += g * g
        self.sums[name][at] = sums
        sums += np.float32(FIRST_SUM)
        g *= np.float32(self.rate)
        g /= np.sqrt(sums, out=sums)
        g += self.p[name].take(at, axis=0)
        self.p[name][at] = g
        self.steps[name][at] += 1

    def _draw(self, low, high):
        """Words by their shares, each between two values of the cumulated shares."""
        return np.minimum(np.searchsorted(self.cumulated, low + self.rng.random(low.shape) * (high - low), "right"), len(self.cumulated) - 1)

    def learn(self, w, h1, h2):
        dim, k = DIM, WORD_NOISE
        of = w // self.width
        made = self.p["r1"].take(h1, axis=0)
        for more, at in ((_STARTS[0], h1 & 4095), (self.p["r2"], h2), (_STARTS[1], h2 & 4095)):
            made += more.take(at, axis=0)
        scale = np.float32(1 / len(w) ** 0.5)
        # the classes against classes that the batch shares
        noise = self._draw(np.zeros(self.noise), np.full(self.noise, self.cumulated[-1])) // self.width
        q = self.p["classes"] + self.first
        qw, qn = q.take(of, axis=0), q.take(noise, axis=0)
        real = np.einsum("ij,ij->i", made, qw[:, :dim]) + qw[:, dim] - self.log_noise[of]
        fake = made @ qn[:, :dim].T + qn[:, dim] - self.log_noise[noise]
        g = 1 / (1 + np.exp(np.clip(real, -30, 30)))
        b = -1 / (1 + np.exp(np.clip(-fake, -30, 30)))
        d_made = g[:, None] * qw[:, :dim] + b @ qn[:, :dim]
        grads = np.concatenate([np.column_stack([g[:, None] * made, g]), np.column_stack([b.T @ made, b.sum(axis=0)])])
        self._step("classes", np.concatenate([of, noise]), (grads * scale).astype(np.float32))
        # each word against words of its class
        tries = np.column_stack([w, np.minimum(np.maximum(self._draw(np.repeat(self.ends[of][:, None], k, 1), np.repeat(self.ends[of + 1][:, None], k, 1)), of[:, None] * self.width), (of[:, None] + 1) * self.width - 1)])
        qt = self.p["q"].take(tries, axis=0)
        # the start is the noise's own distribution, so it falls out of the odds
        odds = np.einsum("bkd,bd->bk", qt[:, :, :dim], made) + qt[:, :, dim] - np.float32(np.log(k))
        g = -1 / (1 + np.exp(np.clip(-odds, -30, 30)))
        g[:, 0] += 1
        d_made += np.einsum("bk,bkd->bd", g, qt[:, :, :dim])
        grads = np.concatenate([g[:, :, None] * made[:, None, :], g[:, :, None]], axis=2).reshape(-1, dim + 1)
        self._step("q", tries.ravel(), (grads * scale).astype(np.float32))
        d_made = (d_made * scale).astype(np.float32)
        self._step("r1", h1, d_made)
        self._step("r2", h2, d_made)

    def learnt(self):
        """(table, block, rows within it, steps, values) of all rows that took steps."""
        for part, name in enumerate(TABLES):
            rows = np.flatnonzero(self.steps[name])
            cuts = np.flatnonzero(np.diff(rows // BLOCK)) + 1
            for at in np.split(rows, cuts) if len(rows) else ():
                yield part, int(at[0] // BLOCK), (at % BLOCK).astype(np.int16).tobytes(), self.steps[name][at].tobytes(), self.p[name][at].astype(np.float16).tobytes()


def as_words(docs: DataFrame, sent, id_col: str, text: str, shards: int) -> DataFrame:
    """shard, deal, words: the words of the model of each document, dealt by a hash of its id and text."""

    def look_up(batches):
        v, powers = sent.value, Powers()
        look = Lookup(v["keys"])
        for batch in batches:
            at = 0
            for h, bounds in _tokens(batch.column(1), powers):
                words = words_of(v, look(h), h).astype("<i4")
                words[h == END] = END_WORD
                n = len(bounds) - 1
                held = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((bounds * 4).astype(np.int32)), pa.py_buffer(words.tobytes())])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), held], names=["deal", "words"])
                at += n

    deal = F.xxhash64(docs[id_col].cast("string"), text_of(docs, text))
    rows = docs.select(deal.alias("deal"), text_of(docs, text).alias("body")).mapInArrow(look_up, "deal long, words binary")
    return rows.withColumn("shard", F.pmod("deal", F.lit(shards)))


def words_of(v: dict, places: np.ndarray, h: np.ndarray) -> np.ndarray:
    """The model's words of tokens, from their places in the list of hot tokens (-1: not among them) and their hashes."""
    return np.where(places >= 0, v["words"][places], v["rare"][(h >> np.uint64(64 - RARE_BITS)).astype(np.int64)])


def train(words: DataFrame, sent, rounds: int = ROUNDS) -> dict:
    """Parameters after ``rounds`` of shards of ``words`` (shard, deal, words).  ``sent``: broadcast vocabulary."""
    spark = words.sparkSession
    schema = pa.schema([("part", pa.int32()), ("block", pa.int64()), ("rows", pa.binary()), ("steps", pa.binary()), ("data", pa.binary())])

    def learn_from(start):
        def learn(batches):
            log_share = sent.value["log_share"]
            trainer, shard, held = None, None, []

            def drain(least):
                nonlocal held
                w, one, two = (np.concatenate(x) for x in zip(*held, strict=True))
                at = 0
                while len(w) - at >= least and at < len(w):
                    trainer.learn(w[at : at + BATCH], one[at : at + BATCH], two[at : at + BATCH])
                    at += BATCH
                held = [(w[at:], one[at:], two[at:])] if at < len(w) else []

            def learnt():
                if held:
                    drain(1)
                out = list(trainer.learnt())
                for at in range(0, len(out), 256):
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 256], strict=True), schema.types, strict=True)], schema=schema)

            for batch in batches:
                of = batch.column(0).to_numpy()
                cuts = np.append(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), len(of))
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    if of[a] != shard:
                        if trainer is not None:
                            yield from learnt()
                        shard, held = of[a], []
                        trainer = Trainer(log_share, int(shard) + 1, start.value)
                    part = batch.column(1).slice(a, b - a)
                    offsets = np.frombuffer(part.buffers()[1], np.int32, len(part) + 1, part.offset * 4).astype(np.int64)
                    # a few MB of words at a time, whole documents
                    at = 0
                    while at < len(part):
                        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + (4 << 20), "right")) - 1)
                        w = np.frombuffer(part.buffers()[2], np.uint8)[offsets[at] : offsets[to]].view("<i4")
                        held.append((w, *contexts(w, (offsets[at : to + 1] - offsets[at]) // 4)))
                        drain(BATCH)
                        at = to
            if trainer is not None:
                yield from learnt()

        return learn

    def average(table: pa.Table) -> pa.Table:
        part, block = table.column("part")[0].as_py(), table.column("block")[0].as_py()
        width = DIM + (part > 1)
        total, steps = np.zeros((BLOCK, width)), np.zeros(BLOCK)
        for rows, n, data in zip(table.column("rows"), table.column("steps"), table.column("data"), strict=True):
            rows, n = np.frombuffer(rows.as_py(), np.int16), np.frombuffer(n.as_py(), np.float32)
            total[rows] += np.frombuffer(data.as_py(), np.float16).reshape(-1, width) * n[:, None].astype(np.float64)
            steps[rows] += n
        some = np.flatnonzero(steps)
        mean = (total[some] / steps[some][:, None]).astype(np.float16)
        return pa.table({"part": pa.array([part], pa.int32()), "block": pa.array([block], pa.int64()), "rows": pa.array([some.astype(np.int16).tobytes()], pa.binary()), "data": pa.array([mean.tobytes()], pa.binary())})

    log_share = sent.value["log_share"]
    width, by_class, bias = layout(log_share)
    n = len(log_share)
    tables = empty_tables(n, len(by_class))
    for r in range(rounds):
        start = spark.sparkContext.broadcast(tables)
        mine = words.filter(F.pmod("shard", F.lit(rounds)) == r).repartition("shard").sortWithinPartitions("shard", "deal", "words")
        parts = mine.select("shard", "words").mapInArrow(learn_from(start), "part int, block long, rows binary, steps binary, data binary")
        found = parts.groupBy("part", "block").applyInArrow(average, "part int, block long, rows binary, data binary").toArrow()  # the model: some 100 bytes a word
        tables = [t.copy() for t in tables]
        for part, block, rows, data in zip(*(found.column(c) for c in ("part", "block", "rows", "data")), strict=True):
            k, at = part.as_py(), block.as_py() * BLOCK
            tables[k][at + np.frombuffer(rows.as_py(), np.int16).astype(np.int64)] = np.frombuffer(data.as_py(), np.float16).reshape(-1, DIM + (k > 1))
        start.destroy()
    for k in (0, 1):
        for at in range(0, len(tables[k]), 4096):  # starts repeat
            tables[k][at : at + 4096] += _STARTS[k][: len(tables[k][at : at + 4096])].astype(np.float16)
    classes = tables[3][: len(by_class)] + first_parameters(by_class)["q"]
    return {"r1": tables[0][:n], "r2": tables[1][:n], "q": tables[2][:n], "bias": bias, "classes": classes.astype(np.float32), "width": width}


def _log_sums(made: np.ndarray, q: np.ndarray, rows: int = 1024) -> np.ndarray:
    """For each row of ``made``, which ends in 1, the log of the sum of exp over all rows of ``q``, which end in a bias."""
    out = np.empty(len(made), np.float32)
    vectors = np.ascontiguousarray(q.T)
    # exponents of single precision reach to 88; most models stay far below
    far = np.einsum("ij,ij->i", made, made).max(initial=0) * np.einsum("ij,ij->j", vectors, vectors).max() > 60**2
    for at in range(0, len(made), rows):
        s = made[at : at + rows] @ vectors
        most = s.max(axis=1) if far else 0.0
        if far:
            s -= most[:, None]
        out[at : at + rows] = np.log(np.exp(s, out=s).sum(axis=1)) + most
    return out


def log_probabilities(p: dict, w: np.ndarray, one: np.ndarray, two: np.ndarray, most: int = 1 << 17) -> np.ndarray:
    """The natural log of each word's probability after its two context words: of its class, and of the word within it."""
    out = np.empty(len(w), np.float32)
    for a in range(0, len(w), most):
        words = w[a : a + most]
        made = np.ones((len(words), p["r1"].shape[1] + 1), np.float32)
        made[:, :-1] = p["r1"].take(one[a : a + most], axis=0)
        made[:, :-1] += p["r2"].take(two[a : a + most], axis=0)
        of = words // p["width"]
        logs = np.einsum("ij,ij->i", made, p["classes"].take(of, axis=0)) - _log_sums(made, p["classes"])
        order = np.argsort(of, kind="stable")
        cuts = np.append(np.flatnonzero(np.concatenate([[True], np.diff(of[order]) != 0])), len(order))
        for x, y in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[x:y]
            low = int(of[at[0]]) * p["width"]
            q = p["q"][low : low + p["width"]].astype(np.float32)
            q[:, -1] += p["bias"][low : low + p["width"]]
            h = made.take(at, axis=0)
            logs[at] += np.einsum("ij,ij->i", h, q.take(words[at] - low, axis=0)) - _log_sums(h, q)
        out[a : a + most] = logs
    return out


def log_tables(p: dict):
    """(scores by first context, scores by second context, log normalisers) of a small model in one class, for all pairs of contexts."""
    dim = p["r1"].shape[1]
    t1 = p["r1"] @ p["q"][:, :dim].T
    t2 = p["r2"] @ p["q"][:, :dim].T + p["q"][:, dim]
    m1, m2 = t1.max(axis=1), t2.max(axis=1)
    z = np.exp(t1 - m1[:, None]) @ np.exp(t2 - m2[:, None]).T
    return t1, t2, np.log(z) + m1[:, None] + m2


def score(docs: DataFrame, id_col: str = "doc_id", text: str = "text", least: int = LEAST, share: int = SHARE, hot: int = HOT, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of ``docs``.

    Null texts are empty and hold the end token alone.  A null id counts as the
    empty text where ids are hashed.  Without training documents every token is
    unseen.  Repeated rows are scored each.
    """
    spark = docs.sparkSession
    training = docs.filter(crc_mod(F.col(id_col), FOLDS) != HELD)
    counts = cut(token_counts(training.select(text_of(training, text).alias("body"))))
    n, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count(F.lit(1))).first()
    own = max(least, -(-n // share))  # at most ``share`` tokens stand so often
    top = _hottest(counts, hot, own).toArrow()  # pairs of numbers: ``hot`` of them, or all words with vectors of their own
    tokens, c = top.column("token").to_numpy().view(np.uint64), top.column("c").to_numpy().astype(np.int64)
    # what the rarer tokens of each shared word have together: a row for each of these words
    shared = F.shiftrightunsigned("token", 64 - RARE_BITS)
    rarer = counts.filter((F.col("c") < own) & (F.col("token") != int(END.view(np.int64)))).groupBy(shared.alias("at")).agg(F.sum("c").alias("c"), F.count(F.lit(1)).alias("v")).toArrow()
    times, kinds = np.zeros(1 << RARE_BITS, np.int64), np.zeros(1 << RARE_BITS, np.int64)
    times[rarer.column("at").to_numpy()], kinds[rarer.column("at").to_numpy()] = rarer.column("c").to_numpy(), rarer.column("v").to_numpy()
    chosen = np.flatnonzero((tokens != END) & (c >= own))
    ends = c[tokens == END].sum() if (tokens == END).any() else sum(r["c"] for r in counts.filter(F.col("token") == int(END.view(np.int64))).collect())
    # the end first, then all words by their counts
    by_word = np.concatenate([[ends], c[chosen], times])
    place = np.empty(len(by_word), np.int32)
    key = np.concatenate([[np.uint64(0)], tokens[chosen], np.arange(len(times), dtype=np.uint64)])
    place[np.concatenate([[0], 1 + np.lexsort((key[1:], -by_word[1:]))])] = np.arange(len(by_word))
    ordered = np.empty(len(by_word))
    ordered[place] = by_word
    rare = place[1 + len(chosen) :]
    words = rare[(tokens >> np.uint64(64 - RARE_BITS)).astype(np.int64)]
    words[chosen] = place[1 : 1 + len(chosen)]
    words[tokens == END] = END_WORD
    # of a shared word's probability each of its tokens has its part, and one part is left for tokens never seen
    parts = np.zeros(len(by_word))
    parts[rare] = np.log10(times + kinds + 1.0)
    log_share = np.log((ordered + 1) / (ordered + 1).sum())
    order = np.argsort(tokens)
    # a last entry stands for tokens that aren't found
    vocabulary = {"keys": tokens[order], "words": np.append(words[order], np.int32(0)), "rare": rare, "log_share": log_share}
    sent = spark.sparkContext.broadcast(vocabulary)
    learned = train(cut(as_words(training, sent, id_col, text, max(1, -(-n // shard)))), sent)
    model = spark.sparkContext.broadcast({**learned, "logs": np.append(np.log10(c[order] + 1.0), 0.0), "parts": parts})

    lower_base = float(np.log10(n + distinct + 1))

    def rate(batches):
        v, p, powers = sent.value, model.value, Powers()
        if "look" not in p:  # kept with the broadcast value for the worker's next tasks
            p["look"] = Lookup(v["keys"])
        look = p["look"]
        row = TaskContext.get().partitionId() << 40
        for batch in batches:
            ids, at = batch.column(1), 0
            for h, bounds in _tokens(batch.column(0), powers):
                places = look(h)
                known = places >= 0
                w = words_of(v, places, h)
                w[h == END] = END_WORD
                one, two = contexts(w, bounds)
                logp = log_probabilities(p, w, one, two) * np.float32(1 / np.log(10))
                logs = np.where(known, p["logs"][places], 0.0)
                total = lambda x, bounds=bounds: np.add.reduceat(x, bounds[:-1])  # noqa: E731  no text is without tokens
                size = np.diff(bounds)
                base = total(logs) - size * lower_base
                mine = total(logp.astype(np.float64) + np.where(p["parts"][w] > 0, logs - p["parts"][w], 0.0))
                count = len(size)
                keys = row + np.arange(count)
                row += count
                stats = pa.RecordBatch.from_arrays(
                    [pa.array(keys), pa.array(mix(keys.astype(np.uint64)).view(np.int64)), pa.nulls(count, pa.int64()), ids.slice(at, count), pa.array(size), pa.array(total(known.astype(np.int64))), pa.array(base), pa.array(mine), pa.array(np.ones(count, bool))], names=names
                )
                yield stats
                at += count
                far = np.flatnonzero(~known)
                if len(far):
                    of = np.searchsorted(bounds, far, "right") - 1
                    order = np.lexsort((h[far], of))
                    of, token = of[order], h[far][order]
                    fresh = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (token[1:] != token[:-1])]))
                    k = len(fresh)
                    none = [pa.nulls(k, t) for t in (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())]
                    yield pa.RecordBatch.from_arrays([pa.array(keys[of[fresh]]), pa.array(token[fresh].view(np.int64)), pa.array(np.diff(np.append(fresh, len(of)))), *none, pa.array(np.zeros(k, bool))], names=names)

    names = ["key", "token", "times", "id", "n_tokens", "n_known", "base", "score", "whole"]
    rows = docs.select(text_of(docs, text).alias("body"), F.col(id_col).cast("long").alias("id")).mapInArrow(rate, "key long, token long, times long, id long, n_tokens long, n_known long, base double, score double, whole boolean")
    # Tokens beyond the hot list: joined with their counts.  A document's own row has a token of its own, so no key is hot.
    seen = counts.select(F.col("token").alias("t"), "c")
    joined = rows.join(seen, (rows["token"] == seen["t"]) & ~rows["whole"], "left")
    more = F.when(~F.col("whole"), F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 1.0))
    summed = joined.groupBy("key").agg(
        F.max("id").alias(id_col), F.max("n_tokens").alias("n_tokens"), (F.max("n_known") + F.coalesce(F.sum(F.when(F.col("c") > 0, F.col("times"))), F.lit(0))).alias("n_known"),
        F.max("base").alias("base"), F.max("score").alias("own"), F.coalesce(F.sum(more), F.lit(0.0)).alias("more"),
    )
    return summed.select(id_col, (crc_mod(F.col(id_col), FOLDS) == HELD).alias("held_out"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), (F.col("base") + F.col("more")).alias("base_score"), (F.col("own") + F.col("more")).alias("score"))

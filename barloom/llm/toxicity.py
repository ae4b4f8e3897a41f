"""Toxicity by a weighted lexicon, matched by Aho-Corasick after folding.

Texts are folded (case, homoglyphs, digits that stand for letters) to words
with one blank between.  The lexicon holds words and beginnings of words whose
share in toxic documents is far above chance, weighted by how much more often
they stand there.  A document's score comes from the weights of the words hit,
against the hits that a toxic text of its length would have; hits inside an
exception phrase don't count.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_mod, cut, text_of
from .words import batches as in_batches

# Letters of other scripts that look like Latin ones.
HOMOGLYPHS = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x",
    "А": "a", "В": "b", "С": "c", "Е": "e", "Н": "h", "І": "i", "Ј": "j", "К": "k", "М": "m", "О": "o", "Р": "p", "Ѕ": "s", "Т": "t", "У": "y", "Х": "x",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t", "υ": "u", "χ": "x",
    "Α": "a", "Β": "b", "Ε": "e", "Η": "h", "Ι": "i", "Κ": "k", "Μ": "m", "Ν": "n", "Ο": "o", "Ρ": "p", "Τ": "t", "Υ": "y", "Χ": "x", "ı": "i", "ſ": "s",
}
# Digits that stand for letters inside words.
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b"}
# Phrases in which a listed word is harmless.
EXCEPTIONS = ("trash can", "trash bin", "class clown", "clown fish", "idiot proof", "sore loser rule", "pond scum", "stupid simple")

#: Labelled rows that a lexicon is learned from at most (about), and the lengths of word beginnings.
MOST_LABELLED, STEMS = 20_000, (3, 4, 5, 6, 7)
#: What an entry needs: evidence (log-likelihood ratio; by chance alone a few of a million entries show as much) and weight (e to it: how much more often it stands in toxic text).
EVIDENCE, WEIGHT = 15.0, 3.0
#: The residue of crc32(doc_id) mod 5 that is held out.
FOLDS = 5

_FOLD = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
_LEET = re.compile(rb"(?<=[a-z\x80-\xff])[0134578]+(?=[a-z\x80-\xff])|(?<![0-9a-z\x80-\xff])[0134578](?=[a-z\x80-\xff]{2})|(?<=[a-z\x80-\xff]{2})[0134578](?![0-9a-z\x80-\xff])")
_DIGITS = bytes.maketrans(b"".join(k.encode() for k in DIGITS), b"".join(v.encode() for v in DIGITS.values()))
_OTHERS = re.compile("[" + "".join(HOMOGLYPHS) + "！-～]")
_WIDE = {chr(0xFF01 + i): chr(0x21 + i) for i in range(94)}
_SEPARATE = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


def fold(text: str) -> str:
    """Words of a folded text, a blank before, between and after, one character a byte (latin-1)."""
    if not text.isascii() and _OTHERS.search(text):
        text = _OTHERS.sub(lambda m: _WIDE.get(m[0]) or HOMOGLYPHS.get(m[0], m[0]), text)
    data = text.encode("utf-8", "replace").translate(_FOLD)
    data = _LEET.sub(lambda m: m[0].translate(_DIGITS), data)
    words = data.translate(_SEPARATE).split()
    return (b" " + b" ".join(words) + b" ").decode("latin-1")


def features(folded: str) -> Counter:
    """Whole words (``' word '``) and beginnings of words (``' wor'``) of a folded text, with their counts."""
    out: Counter = Counter()
    for w, n in Counter(folded.split()).items():
        out[f" {w} "] += n
        for size in STEMS:
            if len(w) > size:
                out[f" {w[:size]}"] += n
    return out


class Lexicon:
    """Entries with weights, and the calibration of a document's score."""

    def __init__(self, weights: dict[str, float], rate: float = 0.01, bias: float = -4.0, slope: float = 1.0):
        self.weights, self.rate, self.bias, self.slope = weights, rate, bias, slope

    def matcher(self):
        import ahocorasick

        found = ahocorasick.Automaton()
        for entry, weight in self.weights.items():
            found.add_word(entry, (len(entry), weight))
        for phrase in EXCEPTIONS:
            entry = fold(phrase)
            found.add_word(entry, (len(entry), None))
        found.make_automaton()
        return found

    def hits(self, matcher, folded: str) -> tuple[float, int, int]:
        """(summed weights of the words hit, one entry (the heaviest) a word; words hit; words)."""
        found: dict[int, float] = {}
        spared = []
        for at, (size, weight) in matcher.iter(folded):
            start = at - size + 1
            if weight is None:
                spared.append((start, at))
            elif weight > found.get(start, 0.0) and (folded[at] == " " or folded[at + 1] != " "):  # a beginning is of a longer word
                found[start] = weight
        for a, b in spared:
            for start in [s for s in found if a <= s < b]:
                del found[start]
        return sum(found.values()), len(found), max(0, folded.count(" ") - 1)

    def strength(self, total: float, words: int) -> float:
        """The logarithm of how much likelier a toxic text of this length holds such hits."""
        return total - self.rate * words

    def score(self, strength: float) -> float:
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, self.bias + self.slope * max(-30.0, min(30.0, strength))))))


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", most: int = MOST_LABELLED) -> DataFrame:
    """``_id``, ``_y``, ``_body`` of about ``most`` labelled documents (all, if there are fewer) outside the held-out fold, the same for the same table.

    Labels other than 0 and 1 are left out; an id labelled more than once counts with its largest label.
    """
    y = F.col(label).cast("int")
    chosen = labels.filter(F.col(id_col).isNotNull() & y.isin(0, 1) & (crc_mod(F.col(id_col), FOLDS) != 0)).groupBy(F.col(id_col).alias("_id")).agg(F.max(y).alias("_y"))
    parts = 1_000_000
    share = min(parts, parts * most // max(1, labels.count()))
    chosen = chosen.filter(F.pmod(F.xxhash64("_id"), F.lit(parts)) < share)
    # about ``most`` ids and labels: a bounded table to send to every task
    return docs.select(F.col(id_col).alias("_id"), text_of(docs).alias("_body")).join(F.broadcast(chosen), "_id")


def folded_rows(rows: DataFrame) -> DataFrame:
    """``_y`` and the folded text of a bounded number of rows, as a written table, so that texts are folded once."""

    def fold_all(parts):
        for batch in parts:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([fold(b.as_py()).encode("latin-1") for b in batch.column(1)], pa.binary())], names=["_y", "_folded"])

    return cut(rows.select("_y", "_body").mapInArrow(fold_all, "_y int, _folded binary"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", label: str = "toxic", most: int = MOST_LABELLED, evidence: float = EVIDENCE, weight: float = WEIGHT) -> Lexicon:
    """A lexicon from labelled documents; without labels of both kinds it is empty and every score is low.

    The lexicon holds every word and beginning of a word with enough evidence
    and weight; their number follows from the bounded number of labelled rows.
    """
    rows = folded_rows(training_rows(docs, labels, id_col, label, most))

    def count(parts):
        counts: dict[str, list] = {"": [0, 0, 0.0, 0.0]}  # documents and places, by label
        for batch in parts:
            for y, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                found = features(body.as_py().decode("latin-1"))
                found[""] = sum(n for f, n in found.items() if f[-1] == " ")
                for f, n in found.items():
                    c = counts.setdefault(f, [0, 0, 0.0, 0.0])
                    c[y] += 1
                    c[2 + y] += 1 + math.log(n) if f else n  # what a document repeats counts less each time
        for part in in_batches((f.encode("latin-1"), *c) for f, c in counts.items()):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part, strict=True), [pa.binary(), pa.int64(), pa.int64(), pa.float64(), pa.float64()], strict=True)], names=["entry", "n0", "n1", "w0", "w1"])

    partial = rows.mapInArrow(count, "entry binary, n0 long, n1 long, w0 double, w1 double")
    counts = cut(partial.groupBy("entry").agg(*[F.sum(c).alias(c) for c in ("n0", "n1", "w0", "w1")]))
    totals = counts.filter(F.length("entry") == 0).collect()
    if not totals or not totals[0]["n0"] or not totals[0]["n1"]:
        return Lexicon({}, bias=-2.0)
    all0, all1, words0, words1 = (totals[0][c] for c in ("n0", "n1", "w0", "w1"))
    base = all1 / (all0 + all1)
    n, hit = F.col("n0") + F.col("n1"), F.col("n1")
    log = lambda a, b: F.when(a > 0, a * F.log(a / b)).otherwise(0.0)
    shown = log(hit, n * base) + log(F.col("n0"), n * (1 - base))
    heavy = F.log((F.col("w1") + 0.5) / (words1 + 1)) - F.log((F.col("w0") + 0.5) / (words0 + 1))
    chosen = counts.filter((F.length("entry") > 0) & (hit > n * base) & (shown > evidence) & (heavy > weight)).select("entry", heavy.alias("weight"))
    return calibrate(rows, Lexicon({bytes(r["entry"]).decode("latin-1"): float(r["weight"]) for r in chosen.collect()}))


def calibrate(rows: DataFrame, lexicon: Lexicon) -> Lexicon:
    """Fit the rate of hits, bias and slope to the same bounded rows (``folded_rows``)."""

    def hits(parts):
        matcher = lexicon.matcher()
        for batch in parts:
            found = [lexicon.hits(matcher, b.as_py().decode("latin-1")) for b in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([float(x[i]) for x in found], pa.float64()) for i in range(3)]], names=["y", "total", "hits", "words"])

    got = rows.mapInArrow(hits, "y int, total double, hits double, words double").collect()  # four numbers for each of about MOST_LABELLED rows
    y, total, hit, words = (np.array([r[i] for r in got], float) for i in range(4))
    share = [hit[y == c].sum() / max(1.0, words[y == c].sum()) for c in (0, 1)]
    lexicon.rate = float(max(0.0, share[1] - share[0]))
    s, n = np.clip(lexicon.strength(total, words), -30, 30), np.ones(len(y))
    bias, slope = -2.0, 1.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(bias + slope * s, -30, 30)))
        g = np.array([(n * (y - p)).sum() - 0.01 * bias, (n * (y - p) * s).sum() - 0.01 * slope])
        w = n * p * (1 - p)
        h = np.array([[w.sum() + 0.01, (w * s).sum()], [(w * s).sum(), (w * s * s).sum() + 0.01]])
        step = np.linalg.solve(h, g)
        bias, slope = bias + float(np.clip(step[0], -2, 2)), slope + float(np.clip(step[1], -2, 2))
        if np.abs(step).max() < 1e-6:
            break
    return Lexicon(lexicon.weights, lexicon.rate, bias, slope)


def judge(docs: DataFrame, lexicon: Lexicon, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns of every row with ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on).  A null text is empty and scores like a text without hits.

    Result columns replace kept ones of the same name.  Each row stands alone:
    no shuffle; repeated rows are judged each, null ids stay null, an empty
    table gives no rows.
    """
    keep = [c for c in keep if c not in ("score", "predicted")]
    rows = docs.select(text_of(docs, text).alias("_body"), *keep)
    kept = rows.schema[1:].fieldNames() if keep else []

    def rate(parts):
        matcher = lexicon.matcher()
        for batch in parts:
            found = [lexicon.hits(matcher, fold(b.as_py())) for b in batch.column(0)]
            s = np.array([lexicon.score(lexicon.strength(total, words)) for total, _, words in found], float)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(s), pa.array((s >= 0.5).astype(np.int32))], names=[*kept, "score", "predicted"])

    fields = [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in rows.schema[1:]]
    return rows.mapInArrow(rate, ", ".join([*fields, "score double", "predicted int"]))


def remove(docs: DataFrame, lexicon: Lexicon, text: str = "text") -> DataFrame:
    """``docs`` without rows judged toxic, its columns unchanged."""
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    judged = judge(docs.toDF(*inner.values()), lexicon, list(inner.values()), inner[text])
    return judged.filter("predicted = 0").select(*[F.col(v).alias(k) for k, v in inner.items()])

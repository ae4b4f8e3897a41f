"""Words of whole Arrow batches as 64-bit numbers, without a Python loop over words.

The bytes of many texts are looked at together: a table tells word bytes from
separators, prefix sums of a polynomial give every word's hash in one pass.
Texts are taken in chunks of a few MB, so memory follows the chunk (or one
very long text), not the batch.
"""

from __future__ import annotations

import numpy as np

#: Bytes of text looked at together; one longer text is a chunk of its own.
CHUNK_BYTES = 2 << 20

_BASE = np.uint64(0x9E3779B97F4A7C15)


def _inverse(odd: int) -> int:
    x = odd
    for _ in range(6):
        x = (x * (2 - odd * x)) & (2**64 - 1)
    return x


def _tables():
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    alnum = lower.copy()
    alnum[:48] = 0
    alnum[58:65] = 0
    alnum[91:97] = 0
    alnum[123:128] = 0
    spaced, folded = np.arange(256, dtype=np.uint16), lower.astype(np.uint16)
    for t in (spaced, folded):
        t[[32, 9, 10, 11, 12, 13]] = 0
        t[0] = 256  # a NUL is a word byte there, like no other
    return alnum, spaced, folded


#: ALNUM: lower-cased A-Z, words of digits, letters and anything beyond ASCII.  SPACED: words between ASCII white space, unchanged.  FOLDED: those with lower-cased A-Z.
ALNUM, SPACED, FOLDED = _tables()


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, on uint64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown as needed."""

    def __init__(self):
        self.up = self.down = np.ones(0, np.uint64)

    def get(self, n: int):
        if len(self.up) < n:
            n = max(n, CHUNK_BYTES + 1)
            for name, base in (("up", int(_BASE)), ("down", _inverse(int(_BASE)))):
                x = np.full(n, base, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


def text_chunks(column, limit: int = CHUNK_BYTES):
    """(first row, bytes, offsets) for runs of rows of an Arrow string or binary column; nulls are empty."""
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int32, n + 1, column.offset * 4).astype(np.int64)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at]
        at = to


def word_bounds(data: np.ndarray, offsets: np.ndarray, kind: np.ndarray):
    """(table bytes, starts, ends, first word of each text, and the end): words never cross a text's end."""
    t = kind[data]
    w = t != 0
    n = len(t)
    if not n:
        return t, np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~w[:-1]
    inner = offsets[offsets <= n]
    fresh[inner] = True
    starts = np.flatnonzero(w & fresh[:n])
    fresh = np.ones(n + 1, bool)
    fresh[1:n] = ~w[1:]
    fresh[inner] = True
    ends = np.flatnonzero(w & fresh[1:]) + 1
    return t, starts, ends, np.searchsorted(starts, offsets)


def word_hashes(t: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: Powers) -> np.ndarray:
    up, down = powers.get(len(t) + 1)
    sums = np.zeros(len(t) + 1, np.uint64)
    np.cumsum(t.astype(np.uint64) * up[: len(t)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive words, for each start that has k words after it; text ends are the caller's business."""
    if len(h) < k:
        return np.zeros(0, np.uint64)
    c = np.uint64(0xD1342543DE82EF95)
    x = h[: len(h) - k + 1].copy()
    for j in range(1, k):
        x *= c
        x += h[j : len(h) - k + 1 + j]
    return mix(x)


def suffix_array(words: np.ndarray) -> np.ndarray:
    """The places of ``words`` in the order of the suffixes that begin there, by doubling the depth of those that are still tied."""
    n = len(words)
    order = np.argsort(words)
    rank, at, key, step = np.empty(n, np.int64), np.arange(n), words[order], 1
    while len(at):
        fresh = np.concatenate([[True], key[1:] != key[:-1]])
        rank[order[at]] = at[np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))]
        at = at[~(fresh & np.append(fresh[1:], True))]
        tied = order[at]
        after = np.where(tied + step < n, rank[np.minimum(tied + step, n - 1)] + 1, 0)
        key = rank[tied] * (n + 1) + after
        by_key = np.argsort(key)
        order[at], key = tied[by_key], key[by_key]
        step *= 2
    return order


def batches(it, rows: int = 20_000):
    """Lists of Python rows into Arrow-sized lists."""
    held = []
    for x in it:
        held.append(x)
        if len(held) >= rows:
            yield held
            held = []
    if held:
        yield held

"""Best-fit packing with swap-based local search.

Documents become token ids, long ones are cut into pieces, and pieces are
dealt at random to groups of a bounded size; what the groups leave underfull
is dealt again.  Within a group best fit gives the large pieces their bins and
every small one starts alone; local search then moves documents, exchanges one
for one or two for one between underfull bins, always raising the sum of
squared fills, until bins empty or nothing helps.
"""

from __future__ import annotations

import base64
import bisect
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of

#: Tokens of a sequence, and the pieces of a packing group, which packs in one task.
SEQUENCE, GROUP = 2048, 50_000

# Fixed value: the splitting pattern of the byte-level vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Beyond these characters two Unicode tables may differ, and a special token must be found as the tokenizer finds it: such texts go to the tokenizer itself.
_RARE = re.compile("[^\x00-ɏ‐-›]|<\\|")


class Ids:
    """Token ids of texts as ``tokenizers`` gives them; common texts by the same vocabulary as ranks, which is several times faster."""

    def __init__(self, json_path: str, ranks_path: str | None):
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(json_path)
        self.fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> np.ndarray:
        if self.fast is not None and not _RARE.search(text):
            return np.asarray(self.fast.encode_ordinary(text), np.uint32)
        return np.asarray(self.exact.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text: str = "text", sequence: int = SEQUENCE, end: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32.  A null text is empty and has only the end id."""
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])

    def cut_up(batches):
        ids_of = Ids(json_path, ranks_path)
        last = np.asarray([end], np.uint32)
        for batch in batches:
            out = []
            for doc_id, body in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.concatenate([ids_of(body.as_py()), last]).astype("<u4")
                n = -(-len(ids) // sequence)
                at = 0
                for piece in range(n):
                    to = len(ids) - (n - 1 - piece) * sequence
                    out.append((doc_id, piece, at, to - at, zlib.crc32(ids[at:to].tobytes())))
                    at = to
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), schema.types, strict=True)], schema=schema) if out else pa.RecordBatch.from_pylist([], schema=schema)

    rows = docs.select(F.col(id_col).cast("long"), text_of(docs, text))
    return rows.mapInArrow(cut_up, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best fit in the order in which items come; bins as lists of item numbers."""
    bins: list[list[int]] = []
    by_free: dict[int, list[int]] = {}
    mask = 0  # bit f: a bin has f free
    for item, size in enumerate(sizes):
        fits = mask >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            chosen = by_free[free].pop()
            if not by_free[free]:
                mask ^= 1 << free
            bins[chosen].append(item)
        else:
            free, chosen = capacity, len(bins)
            bins.append([item])
        if free - size:
            by_free.setdefault(free - size, []).append(chosen)
            mask |= 1 << (free - size)
    return bins


def _lowest(mask: int, least: int) -> int:
    """The lowest bit of a mask from ``least`` on; -1 if there is none."""
    rest = mask >> least
    return least + (rest & -rest).bit_length() - 1 if rest else -1


class Underfull:
    """The underfull bins of a packing and all steps between them.

    ``roomy`` has the bins by what is free in them.  ``swaps`` has, for every
    size that would fill a bin exactly once one of its items is taken out, the
    bins by what is free in them; the item's size is the difference.  Masks
    have a bit for each key, so the next larger one is found at once.
    """

    def __init__(self, bins: list[list[int]], sizes: list[int], capacity: int):
        self.sizes, self.capacity = sizes, capacity
        self.items = [sorted(b, key=sizes.__getitem__) for b in bins]
        self.free = [capacity - sum(sizes[i] for i in b) for b in bins]
        self.alive, self.steps = len(bins), 0
        self.roomy: dict[int, set] = {}
        self.swaps: dict[int, dict[int, set]] = {}
        self.room_mask, self.swap_mask = 0, 0
        self.frees: dict[int, int] = {}
        self.order = sorted((f, b) for b, f in enumerate(self.free) if f)  # the emptiest last
        for _, b in self.order:
            self._add(b)

    def _add(self, b: int):
        free = self.free[b]
        self.roomy.setdefault(free, set()).add(b)
        self.room_mask |= 1 << free
        for s in {self.sizes[i] for i in self.items[b]}:
            self.swaps.setdefault(free + s, {}).setdefault(free, set()).add(b)
            self.frees[free + s] = self.frees.get(free + s, 0) | 1 << free
            self.swap_mask |= 1 << free + s

    def _drop(self, b: int):
        free = self.free[b]
        self.roomy[free].discard(b)
        if not self.roomy[free]:
            self.room_mask ^= 1 << free
        for s in {self.sizes[i] for i in self.items[b]}:
            found = self.swaps[free + s][free]
            found.discard(b)
            if not found:
                del self.swaps[free + s][free]
                self.frees[free + s] ^= 1 << free
                if not self.frees[free + s]:
                    self.swap_mask ^= 1 << free + s

    def offers(self, source: int) -> list[tuple[int, tuple]]:
        """(size, sizes) of one item of the source or of two, the largest first."""
        mine = [self.sizes[i] for i in self.items[source]]
        ones = sorted(set(mine), reverse=True)
        out = [(x, (x,)) for x in ones]
        twice = {x for x, y in zip(mine, mine[1:], strict=False) if x == y}
        return out + [(x + y, (x, y)) for n, x in enumerate(ones) for y in ones[n if x in twice else n + 1 :]]

    def _swap(self, key: int, free: int, given: tuple):
        return next(iter(self.swaps[key][free])), key - free, given

    def exact(self, source: int):
        """A step that fills a bin: (bin, size that goes back or 0, sizes that go there)."""
        for total, given in self.offers(source):
            if len(given) == 1 and self.room_mask >> total & 1:
                return next(iter(self.roomy[total])), 0, given
            if self.swap_mask >> total & 1:
                return self._swap(total, self.frees[total].bit_length() - 1, given)
        return None

    def better(self, source: int):
        """A step that raises the sum of squared fills and leaves least free in the bin it goes to: a move, or an exchange that takes half or more of what is free there."""
        best, least = None, self.free[source]
        for total, given in self.offers(source):
            if len(given) == 1 and 0 <= (at := _lowest(self.room_mask, total)) < total + least:
                best, least = (next(iter(self.roomy[at])), 0, given), at - total
            at = total - 1
            while 0 <= (at := _lowest(self.swap_mask, at + 1)) < total + least:
                free = self.frees[at].bit_length() - 1
                if free >= 2 * (at - total):
                    best, least = self._swap(at, free, given), at - total
                    break
        return best

    def take(self, source: int, step) -> None:
        """Carry a step out.  The source's own entries are out of ``fits``."""
        target, back, given = step
        self._drop(target)
        self.order.pop(bisect.bisect_left(self.order, (self.free[target], target)))
        order = self.sizes.__getitem__
        for size in given:
            i = self.items[source].pop(bisect.bisect_left(self.items[source], size, key=order))
            bisect.insort(self.items[target], i, key=order)
        if back:
            i = self.items[target].pop(bisect.bisect_left(self.items[target], back, key=order))
            bisect.insort(self.items[source], i, key=order)
        moved = sum(given) - back
        self.free[source] += moved
        self.free[target] -= moved
        if self.free[target]:
            self._add(target)
            bisect.insort(self.order, (self.free[target], target))
        self.steps += 1


def local_search(bins: list[list[int]], sizes: list[int], capacity: int) -> tuple[list[list[int]], int]:
    """(bins, steps): moves, exchanges of one for one and of two for one between underfull bins, until bins are as few as can be or no step helps.

    Sources are taken from the emptiest on.  Steps that fill a bin exactly go
    first, then moves and such exchanges as take half or more of what is free; each
    raises the sum of squared fills, so the search ends.
    """
    least = -(-sum(sizes) // capacity)
    state = Underfull(bins, sizes, capacity)
    for find in (state.exact, lambda b: state.exact(b) or state.better(b)):
        before = -1
        while state.steps > before and state.alive > least:
            before = state.steps
            for _, source in state.order[::-1]:
                if state.alive <= least:
                    break
                if not state.free[source] or not state.items[source]:
                    continue  # filled meanwhile
                state.order.pop(bisect.bisect_left(state.order, (state.free[source], source)))
                state._drop(source)
                while state.items[source] and (step := find(source)):
                    state.take(source, step)
                if state.items[source]:
                    state._add(source)
                    bisect.insort(state.order, (state.free[source], source))
                else:
                    state.alive -= 1
    return [b for b in state.items if b], state.steps


def first_packing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Pieces of an eighth of a bin or more by best fit decreasing; each smaller one in a bin of its own, for the search to place."""
    large = sorted((i for i, n in enumerate(sizes) if 8 * n >= capacity), key=lambda i: -sizes[i])
    return [[large[i] for i in b] for b in best_fit([sizes[i] for i in large], capacity)] + [[i] for i, n in enumerate(sizes) if 8 * n < capacity]


def _bins(table: pa.Table, sequence: int) -> tuple[list[int], list[list[int]]]:
    """(sizes, bins) of a group; bins that it comes with are searched on as they are, so a later round never adds one."""
    sizes = table.column("length").to_pylist()
    if "sequence_id" in table.column_names:
        held: dict[int, list[int]] = {}
        for i, s in enumerate(table.column("sequence_id").to_pylist()):
            held.setdefault(s, []).append(i)
        start = list(held.values())
    else:
        start = first_packing(sizes, sequence)
    return sizes, local_search(start, sizes, sequence)[0]


def pack(cut_pieces: DataFrame, sequence: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Deal pieces to groups of about ``group`` and pack each: adds sequence_id and offset.

    Rows are dealt by their place in a written table, so repeated rows spread
    like any others.  The underfull bins of all groups are dealt anew and
    searched together, round after round, until they are one group or their
    groups get no fewer.  A table without rows gives none; a piece is never
    longer than ``sequence``.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, sequence_id long, offset long, underfull boolean"
    kept = ["doc_id", "piece", "start", "length", "ids_crc32", "row"]

    def fill_from(base: int):
        def fill(table: pa.Table) -> pa.Table:
            table = table.sort_by([("shuffled", "ascending"), ("row", "ascending")])
            sizes, bins = _bins(table, sequence)
            first = base + table.column("g")[0].as_py() << 32
            where, offset, underfull = [0] * len(sizes), [0] * len(sizes), [False] * len(sizes)
            for b, items in enumerate(bins):
                at = 0
                for i in items:
                    where[i], offset[i] = first + b, at
                    at += sizes[i]
                for i in items:
                    underfull[i] = at < sequence
            out = table.select(kept)
            return out.append_column("sequence_id", pa.array(where, pa.int64())).append_column("offset", pa.array(offset, pa.int64())).append_column("underfull", pa.array(underfull, pa.bool_()))

        return fill

    rest = cut(cut_pieces.select(*kept[:-1], F.monotonically_increasing_id().alias("row")))
    done, base, unit = [], 0, "row"
    groups = max(1, -(-rest.count() // group))
    while True:
        # pieces of one sequence stay together from the second round on
        dealt = rest.withColumns({"g": F.pmod(F.xxhash64(unit, F.lit(base)), F.lit(groups)), "shuffled": F.xxhash64("row", F.lit(base))})
        packed = dealt.groupBy("g").applyInArrow(fill_from(base), schema)
        if groups == 1:
            break
        packed = cut(packed)
        rest, base, unit = packed.filter("underfull").drop("offset", "underfull"), base + groups, "sequence_id"
        fewer = max(1, -(-rest.count() // group))
        if fewer == groups:
            break
        done.append(packed.filter("NOT underfull"))
        groups = fewer
    for d in done:
        packed = packed.unionByName(d)
    return packed.drop("underfull", "row")


def pack_documents(docs: DataFrame, json_path: str, ranks_path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Pieces of all documents with their places; repeated rows are packed as often as they stand."""
    return pack(pieces(docs, json_path, ranks_path, id_col, text))

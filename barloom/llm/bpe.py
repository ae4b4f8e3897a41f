"""Encoding and decoding of a BPE vocabulary with word ends by a distinct-word table.

Texts are split into words as the tokenizer splits them.  Spark counts the
distinct words, and each of them is encoded once; the table is written.  The
commonest words, a bounded number of short ones, are sent to the tasks.  Some
MB of documents are a chunk, one row of word numbers; its other words travel as
(chunk, place, word), meet the table in a join, and their ids go back to the
chunk.  Decoding joins ids to the vocabulary's pieces.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import json
import re
import unicodedata
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import rewritten, text_of
from .words import text_chunks

#: Most words that are sent to the tasks, and the most bytes of each.
COMMON, COMMON_BYTES = 1 << 18, 64
#: Distinct words that a task counts before it hands them on, and bytes of texts that are looked at together.
COUNTED, TEXT_BYTES = 1 << 19, 4 << 20

# The steps of the vocabulary before its merges.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]


def _plain_characters() -> dict[str, str]:
    """The characters up to U+024F, dashes and quotes by kind: letters, numbers, spaces and others.  In these every Unicode version agrees, none composes, lower case is one character, and Python's spaces are the tokenizer's."""
    kinds: dict[str, list[str]] = {"letter": [], "number": [], "space": [], "other": []}
    for code in [*range(0x1C), *range(0x20, 0x250), *range(0x2010, 0x2028), *range(0x2030, 0x203B)]:
        c = chr(code)
        if len(c.lower()) > 1:
            continue
        for x in {c, c.lower()}:
            group = unicodedata.category(x)[0]
            kinds["space" if code in (*range(9, 14), 32, 0x85, 0xA0) else "letter" if group == "L" else "number" if group == "N" else "other"].append(x)
    return {k: "".join(map(re.escape, sorted(set(v)))) for k, v in kinds.items()}


def _ranges(escaped: str) -> str:
    """Escaped characters as ranges of a class that Arrow's patterns know."""
    codes = sorted({ord(c) for c in re.sub(r"\\(.)", r"\1", escaped, flags=re.DOTALL)})
    runs: list[list[int]] = []
    for c in codes:
        if runs and runs[-1][1] == c - 1:
            runs[-1][1] = c
        else:
            runs.append([c, c])
    return "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs)


class Splitter:
    """Words of texts, as the tokenizer's normalizer and splitting give them; a special token in a text is a word of its own."""

    def __init__(self, path: str):
        from tokenizers import Regex, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        split, level = config["pre_tokenizer"]["pretokenizers"]
        if split["type"] != "Split" or split["behavior"] != "Removed" or not split["invert"] or level["type"] != "ByteLevel" or level["use_regex"] or level["add_prefix_space"]:
            raise ValueError("a vocabulary must split by a pattern, then by bytes")
        special = [t for t in config["added_tokens"] if t["special"] and not (t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"])]
        if len(special) != len(config["added_tokens"]):
            raise ValueError("added tokens must be special ones without options")
        self.path, self.config = path, {k: v for k, v in config.items() if k != "model"}
        self.special = {t["content"]: t["id"] for t in special}
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if special else None
        self.pattern = pre_tokenizers.Split(Regex(split["pattern"]["Regex"]), "removed", invert=True)
        self.plain = config["normalizer"] == {"type": "Sequence", "normalizers": NORMALIZER} and split["pattern"]["Regex"] == SPLIT
        kinds = _plain_characters()
        self.find = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{kinds['letter']}]+|[{kinds['number']}]|[{kinds['other']}]+").findall
        self.rare = re.compile(f"[^{''.join(kinds.values())}]").search
        self.spaces = re.compile(f"[{kinds['space']}]+").split
        # the same for Arrow, whose patterns know fewer escapes
        ranges = {k: _ranges(v) for k, v in kinds.items()}
        self.odd = "|".join([f"[^{''.join(ranges.values())}]", *(re.escape(t) for t in self.special)])
        self.not_letters = f"[^{ranges['letter']}]"
        self.each = f"('s|'t|'re|'ve|'m|'ll|'d|[{ranges['letter']}]+|[{ranges['number']}]|[{ranges['other']}]+)"

    @functools.cached_property
    def whole(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    @functools.cached_property
    def words_only(self):
        """The tokenizer for words, which are normal already, and none of which is special."""
        from tokenizers import Tokenizer

        return Tokenizer.from_str(json.dumps(self.config | {"model": json.load(open(self.path, encoding="utf-8"))["model"], "normalizer": None, "added_tokens": []}))

    def _exact(self, text: str) -> list[str]:
        return [w for w, _ in self.pattern.pre_tokenize_str(self.whole.normalizer.normalize_str(text))]

    def _parts(self, text: str) -> list[str]:
        if not self.plain:
            return [text] if text else []
        # words never cross spaces, so only what stands together with a rare character takes the longer way
        return text.lower().split() if not self.rare(text) else self.spaces(text)

    def parts(self, text: str) -> list[str]:
        """The text cut at spaces and around special tokens."""
        if self.at_special is None or not self.at_special.search(text):
            return self._parts(text)
        return [p for n, part in enumerate(self.at_special.split(text)) for p in ([part] if n % 2 else self._parts(part))]

    def words(self, part: str) -> list[str]:
        """The words of one such part."""
        if part in self.special:
            return [part]
        return self.find(part.lower()) if self.plain and not self.rare(part) else self._exact(part)

    def __call__(self, text: str) -> list[str]:
        return [w for part in self.parts(text) for w in self.words(part)]

    def lists(self, column: pa.StringArray) -> pa.ListArray:
        """``parts`` of every text of a column: plain texts by Arrow, others one by one."""
        odd = pc.match_substring_regex(column, self.odd) if self.plain else pa.array(np.ones(len(column), bool))
        plain = pc.utf8_split_whitespace(pc.utf8_lower(column.filter(pc.invert(odd))))
        if not pc.any(odd).as_py():
            return plain
        others = pa.array([self.parts(t.as_py()) for t in column.filter(odd)], pa.list_(pa.string()))
        mask = odd.to_numpy(zero_copy_only=False)
        place = np.where(mask, np.cumsum(mask) - 1 + len(plain), np.cumsum(~mask) - 1)
        return pa.concat_arrays([plain, others]).take(pa.array(place))

    def _words_of(self, parts: pa.StringArray) -> tuple[pa.DictionaryArray, np.ndarray, np.ndarray]:
        """(words, where each part's begin, how many they are): plain parts by Arrow, others one by one."""
        odd = pc.match_substring_regex(parts, self.odd).to_numpy(zero_copy_only=False) if self.plain else np.ones(len(parts), bool)
        full = pc.not_equal(parts, "").to_numpy(zero_copy_only=False)
        plain = full & ~odd
        one = np.zeros(len(parts), bool)
        lower = pc.utf8_lower(parts.filter(pa.array(plain)))
        one[plain] = pc.invert(pc.match_substring_regex(lower, self.not_letters)).to_numpy(zero_copy_only=False)
        several = pc.split_pattern(pc.ascii_rtrim(pc.replace_substring_regex(lower.filter(pa.array(~one[plain])), self.each, r"\1 "), " "), " ")
        others = [self.words(p) for p in parts.filter(pa.array(full & odd)).to_pylist()]
        lengths, begin, at = np.zeros(len(parts), np.int64), np.zeros(len(parts), np.int64), 0
        for which, sizes in ((one, 1), (plain & ~one, several.value_lengths().to_numpy()), (full & odd, np.fromiter(map(len, others), np.int64, len(others)))):
            lengths[which] = sizes
            ends = at + np.cumsum(lengths[which])
            begin[which] = ends - lengths[which]
            at = ends[-1] if len(ends) else at
        flat = pa.concat_arrays([lower.filter(pa.array(one[plain])), several.flatten(), pa.array(itertools.chain.from_iterable(others), pa.string())])
        return flat.dictionary_encode(), begin, lengths

    def numbered(self, column: pa.StringArray) -> tuple[pa.StringArray, np.ndarray, np.ndarray]:
        """(the distinct words of some texts, the number among them of each word that stands there, the end of each text)."""
        lists = self.lists(column)
        parts = lists.flatten().dictionary_encode()
        words, begin, lengths = self._words_of(parts.dictionary)
        at = parts.indices.to_numpy()
        numbers, part_ends = gathered(words.indices.to_numpy(), begin[at], lengths[at])
        return words.dictionary, numbers, np.concatenate([[0], part_ends])[np.cumsum(lists.value_lengths().to_numpy())]

    def encode(self, words: list[str]) -> list[list[int]]:
        """The ids of each of some words."""
        out: list[list[int]] = [[self.special[w]] if w in self.special else [] for w in words]
        ordinary = [n for n, w in enumerate(words) if w not in self.special]
        # words joined by spaces are split into these words again
        got = self.words_only.encode(" ".join(words[n] for n in ordinary), add_special_tokens=False)
        ids, starts = got.ids, [0, *itertools.accumulate(len(words[n]) + 1 for n in ordinary)]
        at = 0
        for (begin, _), i in zip(got.offsets, ids, strict=True):
            while begin >= starts[at + 1]:
                at += 1
            out[ordinary[at]].append(i)
        return out


_HELD: dict = {}


def _splitter(path: str) -> Splitter:
    """One for each worker."""
    if path not in _HELD:
        _HELD[path] = Splitter(path)
    return _HELD[path]


def _slices(column: pa.StringArray):
    """Runs of rows of some MB of text, or a longer one alone."""
    for at, _, offsets in text_chunks(column, TEXT_BYTES):
        yield at, column.slice(at, len(offsets) - 1)


def gathered(flat: np.ndarray, begin: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the parts of ``flat`` of given beginnings and lengths one after another, their ends)."""
    ends = np.cumsum(lengths)
    return flat[np.repeat(begin - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)], ends


def _common(common: Broadcast) -> pa.StringArray:
    """The common words; one array for each worker, the last broadcast's."""
    words, _, _, name = common.value
    if _HELD.get("name") != name:
        _HELD["name"], _HELD["common"] = name, pc.split_pattern(pa.array([words] if words else [], pa.string()), "\n").flatten()
    return _HELD["common"]


#: Some documents: their ids, how many words each has, the words' numbers, and the words that aren't common.
CHUNK = pa.struct({"doc_ids": pa.list_(pa.int64()), "lengths": pa.list_(pa.int32()), "numbers": pa.binary(), "words": pa.binary()})


def _key(doc_ids: pa.Array, texts: pa.StringArray) -> tuple[int, int]:
    """A chunk's key, by all that it holds."""
    h = hashlib.blake2b(digest_size=16)
    for x in (doc_ids.fill_null(0), doc_ids.is_null().cast(pa.int8()), pc.binary_length(texts)):
        h.update(x.to_numpy())
    for _, data, _ in text_chunks(texts, 1 << 31):
        h.update(data)
    return tuple(np.frombuffer(h.digest(), np.int64).tolist())


def packed(numbers: np.ndarray) -> bytes:
    """int32 numbers, bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor().compress(numbers.view(np.uint8).reshape(-1, 4).T.tobytes())


def unpacked(blob: bytes) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return np.ascontiguousarray(raw.reshape(4, -1).T).view(np.int32).ravel()


def word_counts(texts: DataFrame, path: str) -> DataFrame:
    """word, n: the distinct words of all texts of a one-column frame.  Tasks add up before the shuffle."""

    def count(batches):
        split, names, counts = _splitter(path), [pa.array([], pa.string())], [np.zeros(0, np.int64)]

        def added():
            words = pa.concat_arrays(names).dictionary_encode()
            n = np.zeros(len(words.dictionary), np.int64)
            np.add.at(n, words.indices.to_numpy(), np.concatenate(counts))
            return words.dictionary, n

        def handed(words, n):
            for at in range(0, len(words), 50_000):
                yield pa.RecordBatch.from_arrays([words.slice(at, 50_000), pa.array(n[at : at + 50_000])], names=["word", "n"])

        for batch in batches:
            for _, texts in _slices(batch.column(0)):
                words, numbers, _ = split.numbered(texts)
                names.append(words)
                counts.append(np.bincount(numbers, minlength=len(words)))
                if sum(map(len, names)) >= 2 * COUNTED:
                    words, n = added()
                    if len(words) >= COUNTED:
                        yield from handed(words, n)
                        words, n = words.slice(0, 0), n[:0]
                    names, counts = [words], [n]
        yield from handed(*added())

    return texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def word_table(texts: DataFrame, path: str) -> DataFrame:
    """word, n, ids: each distinct word encoded once; written."""

    def encode(batches):
        split = _splitter(path)
        for batch in batches:
            for at in range(0, len(batch), 2000):
                part = batch.slice(at, 2000)
                ids = split.encode(part.column(0).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(ids, pa.list_(pa.int32()))], names=["word", "n", "ids"])

    return rewritten(word_counts(texts, path).mapInArrow(encode, "word string, n long, ids array<int>"))


def _least_count(table: DataFrame, most: int) -> int:
    """The least count at which no more than about ``most`` words of the table are common: from a histogram of a few hundred rows."""
    rough = table.groupBy(F.floor(8 * F.log2("n")).alias("b")).agg(F.count(F.lit(1)).alias("words"), F.min("n").alias("least")).orderBy(F.desc("b")).collect()
    words, least = 0, 2**62
    for r in rough:
        words += r["words"]
        if words > most:
            break
        least = r["least"]
    return least


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", most: int = COMMON) -> DataFrame:
    """doc_id, ids: the token ids of every row's whole text, as the tokenizer gives them without adding special tokens.

    A null text is empty and has no ids; null ids, repeated rows and further
    columns of any name are let be.  Special tokens that stand in a text become
    their ids.  ``most`` common words go to the tasks, which changes no result.
    """
    return _encoded(docs, path, id_col, text, most, False)


def tokens(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", most: int = COMMON) -> DataFrame:
    """doc_id, ids, decoded: ``decode`` of ``encode``, by the same Python workers."""
    return _encoded(docs, path, id_col, text, most, True)


def _encoded(docs: DataFrame, path: str, id_col: str, text: str, most: int, decoded: bool) -> DataFrame:
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(docs, text).alias("text"))
    table = word_table(rows.select("text"), path)
    short = F.octet_length("word") <= COMMON_BYTES
    least = _least_count(table.filter(short), most)
    # at most ``most`` rows of a bounded length
    held = table.filter(short & (F.col("n") >= least)).select("n", "word", "ids").toArrow().combine_chunks()
    held = held.take(pa.array(np.argsort(-held.column("n").to_numpy(), kind="stable")))
    ids = held.column("ids")
    lengths = pc.list_value_length(ids).to_numpy().astype(np.int64) if len(held) else np.zeros(0, np.int64)
    flat = pc.list_flatten(ids).to_numpy() if len(held) else np.zeros(0, np.int32)
    # words hold no spaces
    common = spark.sparkContext.broadcast(("\n".join(held.column("word").to_pylist()), lengths, flat, uuid.uuid4().hex))
    del held, ids, lengths, flat

    def chunks(batches):
        known, split = _common(common), _splitter(path)
        for batch in batches:
            for begin, texts in _slices(batch.column(1)):
                doc_ids = batch.column(0).slice(begin, len(texts))
                words, numbers, ends = split.numbered(texts)
                at = pc.index_in(words, value_set=known)
                others = words.filter(at.is_null())
                of = at.fill_null(0).to_numpy().astype(np.int32)
                of[at.is_null().to_numpy(zero_copy_only=False)] = -1 - np.arange(len(others))
                chunk = {"doc_ids": doc_ids.to_pylist(), "lengths": np.diff(ends, prepend=0), "numbers": packed(of[numbers]), "words": zstandard.ZstdCompressor().compress("\n".join(others.to_pylist()).encode())}
                k1, k2 = _key(doc_ids, texts)
                yield pa.RecordBatch.from_arrays([pa.array([k1]), pa.array([k2]), pa.array([chunk], CHUNK)], names=["k1", "k2", "chunk"])

    def uncommon(batches):
        for batch in batches:
            for k1, k2, chunk in zip(*batch.columns, strict=True):
                if words := zstandard.ZstdDecompressor().decompress(chunk["words"].as_py()).decode():
                    words = pc.split_pattern(pa.array([words]), "\n").flatten()
                    n = len(words)
                    yield pa.RecordBatch.from_arrays([pa.repeat(k1, n), pa.repeat(k2, n), pa.array(np.arange(n, dtype=np.int32)), words], names=["k1", "k2", "place", "word"])

    def put_together(these: pa.Table, others: pa.Table) -> pa.Table:
        _, lengths, flat, _ = common.value
        _, first = np.unique(others.column("place").to_numpy(), return_index=True)
        tail = others.column("ids").combine_chunks().take(pa.array(first))
        every = np.concatenate([flat, tail.flatten().to_numpy()])
        each = np.concatenate([lengths, tail.value_lengths().to_numpy().astype(np.int64)])
        begin = np.cumsum(each) - each
        out = []
        for chunk in these.column("chunk").to_pylist():
            x = unpacked(chunk["numbers"])
            if len(x) and -x.min() > len(first):
                raise ValueError("words of a chunk have no ids")
            x = np.where(x < 0, len(lengths) - 1 - x, x)
            ids, ends = gathered(every, begin[x], each[x])
            cuts = np.concatenate([[0], ends])[np.cumsum([0, *chunk["lengths"]])]
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids, pa.int32()))
            out.append(pa.RecordBatch.from_arrays([pa.array(chunk["doc_ids"], pa.int64()), lists, *([joined(lists, pieces(path))] if decoded else [])], names=["doc_id", "ids", "decoded"][: 2 + decoded]))
        return pa.Table.from_batches(out, pa.schema({"doc_id": pa.int64(), "ids": pa.list_(pa.int32())} | ({"decoded": pa.string()} if decoded else {})))

    rest = table.filter(~(short & (F.col("n") >= least))).select("word", "ids")
    # one exchange for both of its uses: each takes all of its columns
    dealt = rows.mapInArrow(chunks, "k1 long, k2 long, chunk struct<doc_ids array<long>, lengths array<int>, numbers binary, words binary>").repartition("k1", "k2")
    back = dealt.mapInArrow(uncommon, "k1 long, k2 long, place int, word string").join(rest, "word").select("k1", "k2", "place", "ids").repartition("k1", "k2")
    return dealt.groupBy("k1", "k2").cogroup(back.groupBy("k1", "k2")).applyInArrow(put_together, "doc_id long, ids array<int>" + ", decoded string" * decoded)


@functools.lru_cache(1)
def pieces(path: str) -> pa.Array:
    """The vocabulary's pieces by id; ids without one are null."""
    whole = _splitter(path).whole
    return pa.array([whole.id_to_token(i) for i in range(max(whole.get_vocab().values(), default=-1) + 1)], pa.string())


def joined(lists: pa.ListArray, table: pa.Array) -> pa.StringArray:
    """The pieces of each list of ids, joined by spaces."""
    flat = lists.flatten()
    known = pc.and_kleene(pc.greater_equal(flat, 0), pc.less(flat, len(table)))
    found = table.take(pc.if_else(known, flat, pa.scalar(None, flat.type)))
    parent = pc.list_parent_indices(lists)
    there = found.is_valid()
    sizes = np.bincount(parent.filter(there).to_numpy(), minlength=len(lists)) if len(parent) else np.zeros(len(lists), np.int64)
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), found.filter(there)), " ")


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``: the pieces of all ids, special ones too, joined by spaces as the tokenizer does without a decoder.

    The vocabulary is a table of bounded size, so the join of ids to pieces is
    made where the rows are.  Null and unknown ids have no piece and are left
    out; null ids as a whole give an empty text.
    """
    names = rows.columns

    def join_pieces(batches):
        table = pieces(path)
        at = names.index(ids)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, joined(batch.column(at), table)], names=[*names, "decoded"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(join_pieces, f"{fields}, decoded string")

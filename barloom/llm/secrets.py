"""Secret scans by corpus-wide ownership frequency, in DataFrame functions only.

Candidates are cut out of every whole text by patterns.  The hash of each
candidate's value is then counted over distinct repositories and distinct
owners: a value that many owners hold is a copied example, a value that stays
with one or two owners and looks random is a live credential.

Positions are code points, ends exclusive.  ``split`` on a pattern and
``regexp_extract_all`` of it give the pieces between and within its leftmost
non-overlapping matches, so running lengths give every match's place.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, text_of


#: Texts with something to redact up to which their spans (some 100 bytes each) are sent to all tasks; with more, texts are joined.
MOST_SENT = 100_000


#: Matches of a text that are gone through together.
BLOCK = 256


@dataclass(frozen=True)
class Kind:
    """A pattern; ``value`` is the group that holds the secret, of ``least`` characters or more."""

    name: str
    pattern: str
    value: int
    least: int
    base: bool = True
    #: A plain string that every match holds, to pass over most texts quickly.
    hint: str | None = None


# The base kinds of the contract, in its order.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
BASE = (Kind("assign", ASSIGN, 2, 6), Kind("access", r"AKIA[A-Z0-9]+", 0, 20, hint="AKIA"), Kind("hex", r"[0-9a-f]+", 0, 24))
#: Further shapes of credentials.  Their spans are added only where ownership says that the value is live.
FURTHER = (
    Kind("bearer", r"Bearer\x20+([A-Za-z0-9+/_.=-]+)", 1, 20, False, "Bearer"),
    Kind("jwt", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40, False, "eyJ"),
    Kind("prefixed", r"(?:ghp|gho|glpat|xoxb|xoxp|sk_live)[_-][A-Za-z0-9_-]+", 0, 24, False),
    Kind("url", r"[a-z]{2,10}://[A-Za-z0-9._-]+:([^\s/@:'\"]{6,})@", 1, 6, False, "://"),
)


@dataclass(frozen=True)
class Rules:
    """When a value counts as widely copied, and when it looks random enough to be live.

    Of the characters of a value, or of ten if it has more, three in four must
    differ; one of fewer than ``word`` characters must hold a sign other than
    a letter, as it may be a word.
    """

    copied_owners: int = 3
    distinct: float = 0.75
    of: int = 10
    word: int = 16

    def random(self, value: Column) -> Column:
        size = F.length(value)
        varied = F.size(F.array_distinct(F.split(value, ""))) >= self.distinct * F.least(size, F.lit(self.of))
        return varied & ((size >= self.word) | value.rlike("[^A-Za-z]"))


def _let(value: Column, f) -> Column:
    """``f(value)`` with the value worked out once, however often ``f`` names it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _blocks(items: Column) -> Column:
    """An array as an array of arrays of up to ``BLOCK`` items; one empty block, if there are none."""
    last = F.greatest(F.floor((F.size(items) - 1) / BLOCK), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(items, i * BLOCK + 1, BLOCK))


def _running(values: Column, add) -> Column:
    """What ``add`` makes of all values before each one, from 0 on."""
    seed = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(values, seed, lambda acc, x: F.struct(add(acc["at"], x).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def _found(text: Column, kind: Kind, order: int) -> Column:
    """array<struct<start, ord, kind, end, vstart, value>> of a kind's matches that are long enough.

    A list grows by copying, so matches are gone through in blocks, each from
    its own beginning: the work grows with the number of matches.
    """
    # a run of hex digits is ended by any other sign, so short ones need not be cut out at all
    pattern = f"[0-9a-f]{{{kind.least},}}" if kind.pattern == "[0-9a-f]+" else kind.pattern
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern)
    pairs = F.arrays_zip(gaps.alias("gap"), whole.alias("hit"))
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int,value:string>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        value = x["hit"] if kind.value == 0 else F.regexp_extract(x["hit"], kind.pattern, kind.value)
        one = F.struct(start.alias("start"), F.lit(order).alias("ord"), F.lit(kind.name).alias("kind"), end.alias("end"), value.alias("value"))
        return F.struct(F.coalesce(end, start).alias("at"), F.when(x["hit"].isNotNull() & (F.length(value) >= kind.least), F.concat(acc["out"], F.array(one))).otherwise(acc["out"]).alias("out"))

    length = lambda block: F.aggregate(block, F.lit(0), lambda n, x: n + F.length(x["gap"]) + F.coalesce(F.length(x["hit"]), F.lit(0)))
    places = lambda blocks, begin: F.transform(blocks, lambda b, i: F.aggregate(b, F.struct(F.get(begin, i).alias("at"), none.alias("out")), step, lambda acc: acc["out"]))
    spans = _let(pairs, lambda all_: _let(_blocks(all_), lambda blocks: _let(_running(F.transform(blocks, length), lambda at, n: at + n), lambda begin: F.flatten(places(blocks, begin)))))
    may = text.rlike(pattern) if kind.hint is None else text.contains(kind.hint)
    return F.when(may, spans).otherwise(none)


def candidates(docs: DataFrame, text: str = "text", kinds=BASE + FURTHER) -> Column:
    """All candidates of a row, by start, then kind."""
    body = text_of(docs, text)
    return F.array_sort(F.concat(*[_found(body, k, i) for i, k in enumerate(kinds)]))


def _joined(spans: Column) -> Column:
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def scan(docs: DataFrame, id_col: str = "doc_id", **kw) -> DataFrame:
    """``judged`` without the text's hash."""
    return judged(docs, id_col, **kw).drop("_text")


def judged(docs: DataFrame, id_col: str = "doc_id", text: str = "text", owner: str = "source", repository: tuple = ("source", "lang"), rules: Rules = Rules()) -> DataFrame:
    """One row per row of ``docs``: key columns, ``spans`` with ownership figures.

    Output: ``id_col``, ``_text`` (the text's hash), ``found`` (array of start, ord, kind, end, value hash),
    ``live`` (the spans judged owner-specific), ``copied`` (count of widely copied).

    A null text is empty; null owners and repositories count as one of their
    own.  Rows with equal ids and texts are judged alike and each returned.
    """
    kinds = BASE + FURTHER
    hashed = F.transform(
        candidates(docs, text, kinds),
        lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end"), F.xxhash64(s["value"]).alias("value"), rules.random(s["value"]).alias("random")),
    )
    who = F.xxhash64(F.coalesce(docs[owner].cast("string"), F.lit("")))
    where = F.xxhash64(*[F.coalesce(docs[c].cast("string"), F.lit("")) for c in repository])
    rows = docs.select(docs[id_col].alias("_id"), F.xxhash64(text_of(docs, text)).alias("_text"), who.alias("_owner"), where.alias("_repo"), hashed.alias("found"))
    rows = cut(rows)  # numbers only, no texts: the patterns run once
    some = rows.filter(F.size("found") > 0)
    hits = some.select("_id", "_text", "_owner", "_repo", F.explode("found").alias("s"))
    # Distinct repositories, then distinct owners, then values: each step sums up before its shuffle.
    by_repo = hits.groupBy(F.col("s.value").alias("value"), "_owner", "_repo").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repo.groupBy("value", "_owner").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("repos"))
    by_value = by_owner.groupBy("value").agg(F.sum("n").alias("places"), F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))
    # A value may stand in a third of all rows.  Both sides of the join are written tables, so Spark splits such a key.
    keyed = cut(hits.select("_id", "_text", "s", F.col("s.value").alias("value")).distinct())
    judged = keyed.join(cut(by_value), "value")
    live = (F.col("owners") < rules.copied_owners) & F.col("s.random")
    per_row = judged.groupBy("_id", "_text").agg(
        F.array_sort(F.collect_list(F.when(live, F.struct("s.start", "s.ord", "s.kind", "s.end")))).alias("live"),
        F.count(F.when(F.col("owners") >= rules.copied_owners, 1)).alias("n_copied"),
        F.max("owners").alias("most_owners"),
        F.max("repos").alias("most_repos"),
    )
    left, right = rows.drop("_owner", "_repo"), per_row
    joined = left.join(right, left["_id"].eqNullSafe(right["_id"]) & (left["_text"] == right["_text"]), "left")
    none = F.array().cast("array<struct<start:int,ord:int,kind:string,end:int>>")
    return joined.select(
        left["_id"].alias(id_col), left["_text"], "found", F.coalesce("live", none).alias("live"), F.coalesce("n_copied", F.lit(0)).cast("long").alias("n_copied"),
        F.coalesce("most_owners", F.lit(0)).cast("long").alias("most_owners"), F.coalesce("most_repos", F.lit(0)).cast("long").alias("most_repos"),
    )


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The columns of the registered query, from ``scan``."""
    base = F.filter("found", lambda s: s["ord"] < len(BASE))
    added = F.filter("live", lambda s: s["ord"] >= len(BASE))
    short = lambda a: F.transform(a, lambda s: F.struct(s["start"].alias("start"), s["ord"].alias("ord"), s["kind"].alias("kind"), s["end"].alias("end")))
    count = lambda name: F.size(F.filter("found", lambda s: s["kind"] == name)).cast("long").alias(f"n_{name}")
    return scanned.select(
        id_col, *[count(k.name) for k in BASE], F.sha2(_joined(base), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat(short(base), short(added)))).alias("spans"),
        F.size(F.filter("live", lambda s: s["ord"] < len(BASE))).cast("long").alias("n_live"), "n_copied", "most_owners", "most_repos",
    )


def _marked(body: Column, spans: Column, mark: str) -> Column:
    """``body`` with a mark in place of each span, or of several that overlap.  Each block of spans has its own stretch of the text, as finding a place takes time with the length before it."""

    def pieces(block, begin, until):
        stretch = F.substring(body, begin + 1, F.greatest(until - begin, F.lit(0)))

        def step(part):
            def one(acc, s):
                gap = F.substring(part, acc["at"] - begin + 1, s["start"] - acc["at"])
                return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(s["start"] >= acc["at"], F.concat(acc["out"], F.array(gap, F.lit(mark)))).otherwise(acc["out"]).alias("out"))

            return one

        seed = F.struct(begin.alias("at"), F.array().cast("array<string>").alias("out"))
        return _let(stretch, lambda part: F.aggregate(block, seed, step(part), lambda acc: acc["out"]))

    last = lambda block: F.coalesce(F.array_max(F.transform(block, lambda s: s["end"])), F.lit(0))
    joined = lambda blocks, ends, begin: F.concat(
        F.array_join(F.flatten(F.transform(blocks, lambda b, i: pieces(b, F.get(begin, i), F.get(ends, i)))), ""), F.substring(body, F.array_max(ends) + 1, F.length(body))
    )
    return _let(_blocks(spans), lambda blocks: _let(F.transform(blocks, last), lambda ends: _let(_running(ends, F.greatest), lambda begin: joined(blocks, ends, begin))))


def redact(docs: DataFrame, mark: str = "[SECRET]", id_col: str = "doc_id", text: str = "text", **kw) -> DataFrame:
    """``docs`` with every owner-specific, live-looking span replaced by ``mark``; widely copied examples and all other text stay.

    Overlapping spans become one mark.  Null texts stay null, null ids are
    matched to null ids; rows with equal ids and texts are treated alike and
    all stay, other rows never share spans.  Column order is kept; an empty
    table stays empty.
    """
    inner = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.toDF(*inner.values())
    text = inner[text]
    named = {k: inner.get(kw.pop(k, d)) for k, d in (("owner", "source"),)}
    repository = tuple(inner[c] for c in kw.pop("repository", ("source", "lang")))
    found = judged(renamed, inner[id_col], text=text, repository=repository, **named, **kw).filter(F.size("live") > 0)
    found = cut(found.select(F.col(inner[id_col]).alias("_lid"), F.col("_text"), F.col("live")).dropDuplicates(["_lid", "_text"]))
    if found.count() <= MOST_SENT:
        found = F.broadcast(found)  # texts stay where they are
    keyed = renamed.withColumn("_h", F.xxhash64(text_of(renamed, text)))
    joined = keyed.join(found, keyed[inner[id_col]].eqNullSafe(found["_lid"]) & (keyed["_h"] == found["_text"]), "left")
    body = F.col(text)
    done = _marked(body, F.col("live"), mark)
    fixed = F.when(F.col("live").isNull() | body.isNull(), body).otherwise(done)
    cols = [(fixed if v == text else F.col(v)).alias(k) for k, v in inner.items()]
    return joined.select(*cols)


def oracle() -> str:
    """DuckDB SQL for the digest of ``documents``, written apart from the Spark plan: spans by running sums over unnested pieces."""
    parts = []
    for i, k in enumerate(BASE + FURTHER):
        pat = k.pattern.replace("'", "''")
        val = "hit" if k.value == 0 else f"regexp_extract(hit, '{pat}', {k.value})"
        parts.append(
            f"""SELECT doc_id, txt, who, repo, {i} AS ord, '{k.name}' AS kind, st AS s, st + length(hit) AS e, {val} AS val FROM (
              SELECT *, sum(length(gap) + coalesce(length(hit), 0)) OVER (PARTITION BY rid ORDER BY i) - coalesce(length(hit), 0) AS st FROM (
                SELECT rid, doc_id, txt, who, repo, unnest(string_split_regex(txt, '{pat}')) AS gap, unnest(list_concat(regexp_extract_all(txt, '{pat}'), [NULL])) AS hit,
                  generate_subscripts(list_concat(regexp_extract_all(txt, '{pat}'), [NULL]), 1) AS i FROM d WHERE regexp_matches(txt, '{pat}')))
            WHERE hit IS NOT NULL AND length({val}) >= {k.least}"""
        )
    nb, r = len(BASE), Rules()
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt, coalesce(source, '') AS who, coalesce(source, '') || '|' || coalesce(lang, '') AS repo FROM documents),
      c AS ({' UNION ALL '.join(parts)}),
      v AS (SELECT val, count(DISTINCT who) AS owners, count(DISTINCT repo) AS repos FROM c GROUP BY val),
      j AS (SELECT c.*, owners, repos, owners < {r.copied_owners} AND len(list_distinct(string_split(val, ''))) >= {r.distinct} * least(length(val), {r.of}) AND (length(val) >= {r.word} OR regexp_matches(val, '[^A-Za-z]')) AS live FROM c JOIN v USING (val)),
      g AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {nb}), '') AS base,
        coalesce(string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, ord) FILTER (ord < {nb} OR live), '') AS spans,
        count(*) FILTER (live AND ord < {nb}) AS n_live, count(*) FILTER (owners >= {r.copied_owners}) AS n_copied, max(owners) AS most_owners, max(repos) AS most_repos FROM j GROUP BY doc_id)
      SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
        coalesce(spans, '') AS spans, coalesce(n_live, 0)::BIGINT AS n_live, coalesce(n_copied, 0)::BIGINT AS n_copied, coalesce(most_owners, 0)::BIGINT AS most_owners, coalesce(most_repos, 0)::BIGINT AS most_repos
      FROM documents LEFT JOIN g USING (doc_id)"""

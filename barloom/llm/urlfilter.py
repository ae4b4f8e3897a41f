"""URL filters: logistic regression on hashed character n-grams of host and path.

The model is trained from a small labelled URL table by full-batch gradient
steps written as DataFrame aggregations, and applied as one SQL expression
over the whole table: weights are a fixed-size array, looked up by hash.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The rules of the contract; (host, path, verdict).
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))

# Words that name sites to be blocked or kept, and words that stand beside either; the labelled URLs are made from them.
BLOCKED = (
    "casino", "poker", "bingo", "roulette", "jackpot", "betting", "bookmaker", "lottery", "slots", "gambling", "viagra", "cialis", "steroids", "pharma", "pills", "diet", "payday", "loans", "forex", "crypto", "porn", "sexcams", "escorts", "adult",
    "xxx", "hookup", "adserver", "adclick", "popunder", "tracker", "banners", "clickbait", "torrents", "warez", "keygen", "cracked", "replica", "fakeid", "giveaway", "prizes",
)
ALLOWED = (
    "library", "university", "museum", "news", "weather", "science", "garden", "history", "recipes", "school", "journal", "research", "archive", "gallery", "council", "health", "theatre", "river", "village", "music", "sports", "travel", "books", "maps",
    "poetry", "physics", "chemistry", "biology", "parliament", "railway", "kitchen", "farming", "language", "teachers", "hospital", "software", "forum", "weekly", "culture", "nature",
)
BESIDE = ("online", "city", "best", "daily", "free", "open", "club", "world", "now", "house", "24", "my")
BLOCKED_PATHS, ALLOWED_PATHS = ("/win/", "/bonus/", "/click", "/ads/", "/offer/", "/promo/", "/track/"), ("/articles/", "/about/", "/docs/", "/blog/", "/archive/", "/topics/", "/events/")
PLAIN_PATHS = ("/", "/en/", "/de/", "/fr/", "/es/", "/index.html", "/2024/")

#: Buckets of the hashed n-grams, their lengths, gradient steps, step size and weight decay; the bound of the labelled table.
BUCKETS, SIZES, STEPS, RATE, DECAY, MOST_LABELLED = 4096, (3, 4, 5), 10, 0.5, 0.01, 5000


def labelled_urls(spark: SparkSession) -> DataFrame:
    """The built-in labelled table: url, label (1: to be blocked), from general words and no list of real or given hosts.

    Each word stands with several others, before or after them; these, the
    prefixes and the endings stand on both sides and tell nothing.
    """
    rows = []
    fronts, ends = ("", "www.", "", "m.", "blog."), ("com", "org", "net", "example.com", "info", "example.org", "co.uk", "example.net")
    for names, own, label in ((BLOCKED, BLOCKED_PATHS, 1), (ALLOWED, ALLOWED_PATHS, 0)):
        for i, name in enumerate(names):
            for j in range(16):
                other = BESIDE[(i + j) % len(BESIDE)]
                joint = "-" if (i + j) % 3 else ""
                host = (f"{name}{joint}{other}", f"{other}{joint}{name}", name, f"{name}{joint}{names[(i + 7 * j) % len(names)]}")[j % 4]
                path = own[(i + j) % len(own)] if j % 3 == 0 else PLAIN_PATHS[(i + j) % len(PLAIN_PATHS)]
                rows.append((f"https://{fronts[(i + j) % len(fronts)]}{host}.{ends[(3 * i + j) % len(ends)]}{path}{(37 * i + 11 * j) % 9999}", label))
    return spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{u}', {y})" for u, y in rows) + " AS t(url, label)")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Lower-cased host and path; both empty for null or where no ``://`` stands.

    Only A-Z are lower-cased, by ``translate``; the path is unchanged.
    """
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    lowered = F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.coalesce(lowered, F.lit("")), F.coalesce(path, F.lit(""))


def _side(text: Column, side: str, n: int, buckets: int) -> Column:
    last = F.length(text) - n
    one = lambda i: F.pmod(F.xxhash64(F.lit(side), F.substring(text, i + 1, n)), F.lit(buckets)).cast("int")
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), one)).otherwise(F.array().cast("array<int>"))


def ngrams(host: Column, path: Column, buckets: int = BUCKETS, sizes: tuple = SIZES) -> Column:
    """Distinct buckets of the n-grams of ``^host$`` and of the path, digits read alike.  A URL with neither has none."""
    sides = (("h", F.concat(F.lit("^"), host, F.lit("$"))), ("p", F.regexp_replace(path, "[0-9]+", "0")))
    out = [_side(text, side, n, buckets) for side, text in sides for n in sizes]
    return F.array_distinct(F.concat(*out))


def train(labelled: DataFrame, url: str = "url", label: str = "label", buckets: int = BUCKETS, steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> list[float]:
    """Weights by bucket, the bias last.  Rows with a null label are left out; an empty table gives zeros (probability one half).

    Full-batch steps, each bucket with a rate of its own that falls with its
    gradients so far, so a few steps suffice.  The table is small by contract:
    one of over ``MOST_LABELLED`` rows is refused.
    """
    host, path = host_and_path(F.col(url))
    rows = labelled.filter(F.col(label).isNotNull()).select(ngrams(host, path, buckets).alias("grams"), F.col(label).cast("double").alias("y")).coalesce(1).cache()
    weights, squares = [0.0] * (buckets + 1), [0.0] * (buckets + 1)
    try:
        n = rows.count()
        if n > MOST_LABELLED:
            raise ValueError(f"the labelled table has {n} rows; {MOST_LABELLED} are its bound")
        for _ in range(steps if n else 0):
            off = probability(F.col("grams"), weights) - F.col("y")
            # the bias is the bucket past the last; its n-gram is in every URL
            parts = rows.select(F.explode(F.concat("grams", F.array(F.lit(buckets)))).alias("bucket"), off.alias("off"))
            gradient = parts.groupBy("bucket").agg(F.sum("off").alias("g")).collect()  # at most buckets + 1 rows
            for bucket, g in gradient:
                g = g / n + decay * weights[bucket] / n
                squares[bucket] += g * g
                weights[bucket] -= rate * g / (math.sqrt(squares[bucket]) + 1e-9)
    finally:
        rows.unpersist()
    return weights


def probability(grams: Column, weights: list[float]) -> Column:
    """The logistic probability of label 1 from distinct buckets."""
    w = F.from_json(F.lit(json.dumps([round(x, 9) for x in weights])), "array<double>")  # a constant, read once
    total = F.aggregate(grams, F.lit(0.0), lambda acc, g: acc + F.get(w, g))
    return 1 / (1 + F.exp(-(F.lit(weights[-1]) + total) / F.sqrt(F.size(grams) + 1.0)))


def rule_verdicts(host: Column, path: Column, rules=RULES) -> Column:
    """struct<rule, verdict> of the longest fitting rule, else null, also without any rules.  Longest by its host and path together; then the longer host."""
    out = None if rules else F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        out = F.when(fits, value) if out is None else out.when(fits, value)
    return out


def judge(pages: DataFrame, weights: list[float], id_col: str = "page_id", url: str = "url", rules=RULES, threshold: float = 0.5) -> DataFrame:
    """One row per page: host, path, the rule that decides (else null), the verdict and the model's probability.

    A null or malformed url has empty host and path, no rule and the model's
    verdict on no n-grams.  Each row stands alone: no shuffle; repeated rows are
    judged each, null ids stay null, an empty table gives no rows.
    """
    host, path = host_and_path(pages[url])
    rows = pages.select(F.col(id_col), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("_r", rule_verdicts(F.col("host"), F.col("path"), rules)).withColumn("probability", probability(ngrams(F.col("host"), F.col("path")), weights))
    verdict = F.coalesce("_r.verdict", F.when(F.col("probability") >= threshold, "block").otherwise("allow"))
    return rows.select(id_col, "host", "path", F.col("_r.rule").alias("rule"), verdict.alias("verdict"), "probability")

"""License scans by diagonal voting, in DataFrame functions only.

All rolling word k-gram hashes of a document are joined to the positions of
the same hashes in a fixed set of templates.  A hit votes for the diagonal
``document position - template position`` if its words are the template's;
neighbouring diagonals (a word put in or left out) are merged, and a merged
span is kept if enough of the template's words are covered by its votes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import text_of

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# The base phrases of the contract and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# The notices and whole licenses looked for, by label.
TEMPLATES = {
    "apache-2.0": (
        "licensed under the apache license version 2.0",
        "you may not use this file except in compliance with the license you may obtain a copy of the license at",
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind",
    ),
    "mit": (
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions "
        "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    ),
    "isc": (
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    ),
    "bsd": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    ),
    "bsd-3-clause": (
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution "
        "3 neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission "
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall the copyright holder or contributors be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage",
    ),
    "gpl": ("this program is free software you can redistribute it and or modify it under the terms of the gnu general public license",),
    "gpl-2.0": ("under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version", "licensed under the gnu general public license version 2"),
    "gpl-3.0": ("under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "licensed under the gnu general public license version 3"),
    "cc-by-nc-4.0": ("licensed under cc by nc 4.0", "licensed under a creative commons attribution noncommercial 4.0 international license"),
    "cc-by-4.0": ("licensed under cc by 4.0", "licensed under a creative commons attribution 4.0 international license"),
    "mpl-2.0": ("this source code form is subject to the terms of the mozilla public license v 2.0",),
}

#: Words of a k-gram, diagonals that count as neighbours, the least covered share of a template, and the words up to which a template must be covered whole.
K, NEAR, COVER, SHORT = 3, 2, 0.8, 30


def normal_text(text: Column) -> Column:
    """The words, A-Z lower-cased, one blank between them.

    ``lower`` also folds letters beyond ASCII.  Two of these become letters of
    ASCII (the sign for Kelvin, the capital i with a dot), so they are taken
    out of the way first; no word of a phrase or template can arise from others.
    """
    apart = F.replace(F.replace(text, F.lit("\u212a"), F.lit("\u0138")), F.lit("\u0130"), F.lit("\u0131"))
    return F.trim(F.regexp_replace(F.lower(apart), SEPARATORS, " "))


def _words(normal: Column) -> Column:
    return F.when(normal == "", F.array().cast("array<string>")).otherwise(F.split(normal, " "))


def _grams(words: Column, k: int) -> Column:
    """Hashes of the k words from each position on."""
    last = F.size(words) - k
    at = lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(k)])
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), at)).otherwise(F.array().cast("array<bigint>"))


def template_grams(spark: SparkSession, templates: dict = TEMPLATES, k: int = K) -> DataFrame:
    """One row per k-gram of each template; its size follows the list of templates, never the corpus."""
    rows = [(label, i, t) for label, texts in sorted(templates.items()) for i, t in enumerate(texts)]
    if sum(len(t) for _, _, t in rows) > 1 << 20:
        raise ValueError("templates of over 1 MB are no longer a small table to send to every task")
    values = F.array(*[F.struct(F.lit(a).alias("label"), F.lit(b).alias("part"), F.lit(c).alias("text")) for a, b, c in rows])
    table = spark.range(1).select(F.explode(values).alias("t")).select("t.label", "t.part", _words(normal_text(F.col("t.text"))).alias("tw"))
    return table.select("label", "part", "tw", F.size("tw").alias("t_len"), F.posexplode(_grams(F.col("tw"), k)).alias("t_pos", "gram"))


def spans(docs: DataFrame, keys: list[str], text: str = "text", templates: dict = TEMPLATES, k: int = K, near: int = NEAR, cover: float = COVER, short: int = SHORT) -> DataFrame:
    """Verified template spans: the key columns, label, part, first and last word, and the covered share (``vote``).

    The words of each hit are compared with the template's, so a span's share
    is that of words which do stand there.  Templates of up to ``short`` words
    must be covered whole, longer ones by ``cover``.  Rows with equal keys
    count as one text; a null or wordless text has no span.
    """
    ref = template_grams(docs.sparkSession, templates, k)
    words = docs.select(*keys, _words(normal_text(text_of(docs, text))).alias("words"))
    # The hashes stand in a column of their own, so exploding and joining them stays compiled.  The outer form keeps
    # the optimizer from filtering on their number, for which it would work out the words anew at every position.
    rolled = words.select(*keys, "words", _grams(F.col("words"), k).alias("grams")).select(*keys, "words", F.posexplode_outer("grams").alias("pos", "gram"))
    equal = lambda j: F.get("words", F.col("pos") + j) == F.get("tw", F.col("t_pos") + j)
    hits = rolled.join(F.broadcast(ref), "gram").select(*keys, "label", "part", "t_len", "t_pos", "pos", *[equal(j).alias(f"_w{j}") for j in range(k)])
    for j in range(k):
        hits = hits.filter(F.col(f"_w{j}"))
    votes = hits.select(*keys, "label", "part", "t_len", "t_pos", "pos", (F.col("pos") - F.col("t_pos")).alias("diagonal"))
    by = [*keys, "label", "part", "t_len"]
    diagonals = votes.groupBy(*by, "diagonal").agg(F.collect_set("t_pos").alias("t_at"), F.min("pos").alias("first"), F.max("pos").alias("last"))
    order = Window.partitionBy(*by).orderBy("diagonal")
    apart = F.coalesce((F.col("diagonal") - F.lag("diagonal").over(order) > near).cast("int"), F.lit(0))
    groups = diagonals.withColumn("apart", apart).withColumn("group", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    merged = groups.groupBy(*by, "group").agg(F.array_distinct(F.flatten(F.collect_list("t_at"))).alias("t_at"), F.min("first").alias("first"), (F.max("last") + k - 1).alias("last"))
    covered = F.size(F.array_distinct(F.flatten(F.transform("t_at", lambda p: F.sequence(p, p + k - 1)))))
    least = F.when(F.col("t_len") <= short, 1.0).otherwise(cover)
    return merged.withColumn("vote", covered / F.col("t_len")).filter(F.col("vote") >= least).select(*keys, "label", "part", "first", "last", "vote")


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: base places, labels of both kinds and a score.

    ``score`` is the largest covered share of a verified span, 1 where a base
    phrase stands, else 0.  A null text has no words.  Rows with equal ids and
    texts get equal results.
    """
    id_, normal = docs[id_col], normal_text(text_of(docs, text))
    rows = docs.select(id_.alias(id_col), F.xxhash64(text_of(docs, text)).alias("_text"), normal.alias("_n"))
    padded = F.concat(F.lit(" "), F.col("_n"), F.lit(" "))
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit(" "), F.lit("")))
    cols, places = [], []
    for i, (phrase, label) in enumerate(PHRASES.items()):
        # the blank after a phrase may also stand before the next place, so it is only looked at
        parts = F.when(padded.contains(f" {phrase} "), F.split(padded, f" {phrase}(?= )"))
        cols.append(parts.alias(f"_p{i}"))
        p = F.col(f"_p{i}")
        tail = count(F.element_at(p, -1)) - 1
        places.append((F.coalesce(F.size(p) - 1, F.lit(0)), count(F.element_at(p, 1)), F.col("n_words") - tail - len(phrase.split()), F.when(p.isNotNull(), F.lit(label))))
    n_words = F.when(F.col("_n") == "", 0).otherwise(count(F.col("_n")) + 1).cast("long")
    base = rows.select(id_col, "_text", n_words.alias("n_words"), *cols).select(
        id_col, "_text", "n_words", sum((p[0] for p in places), F.lit(0)).cast("long").alias("n_base"),
        F.least(*[p[1] for p in places]).cast("long").alias("first_word"), F.greatest(*[p[2] for p in places]).cast("long").alias("last_word"),
        F.array_sort(F.array_compact(F.array(*[p[3] for p in places]))).alias("base"),
    )
    found = spans(docs.select(F.col(id_col).alias("_id"), F.xxhash64(text_of(docs, text)).alias("_t"), F.col(text)), ["_id", "_t"], text)
    by_doc = found.groupBy("_id", "_t").agg(F.collect_set("label").alias("more"), F.max("vote").alias("vote"))
    joined = base.join(by_doc, base[id_col].eqNullSafe(by_doc["_id"]) & (base["_text"] == by_doc["_t"]), "left")
    both = F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.greatest(F.coalesce("vote", F.lit(0.0)), F.when(F.col("n_base") > 0, 1.0).otherwise(0.0))
    return joined.select(id_col, "n_words", "n_base", "first_word", "last_word", F.concat_ws(",", "base").alias("base_labels"), F.concat_ws(",", both).alias("labels"), score.alias("score"))
